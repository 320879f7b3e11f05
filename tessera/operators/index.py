"""TF/IDF token index and top-k similarity joins, for any of the retrieval channels in one plan.

A token table has one row for each record in a channel: channel, country, side (``s`` the
clean register, ``r`` the other records), id, toks (its distinct tokens). A channel is asked
from one side and answered from the other, with the channel as part of each key. Tokens are
weighed once, by a join with the vocabulary; from then on a record is one row of token
numbers, and records are compared in tiles of a bounded number of queries and answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DF_LIMIT = 50_000
#: A token in so many records may be looked up whatever the share of its channel says.
DF_LEAST = 20
#: Queries and answers of a tile, and the products that are summed at a time.
TILE, PRODUCTS = 1 << 16, 1 << 20


@dataclass(frozen=True)
class Channel:
    """What a channel asks with (``asked``: the side of the queries), and how far it looks."""

    name: str
    tokens: Callable[[], Column]
    asked: str
    k: int
    query_tokens: int
    df_frac: float


def token_rows(records: DataFrame, tokens: Column) -> DataFrame:
    """country, id, tok (distinct within a record)."""
    return records.select(F.col("country_norm").alias("country"), F.col("entity_id").alias("id"), F.explode(F.array_distinct(tokens)).alias("tok"))


def token_table(records: DataFrame, channels: list[Channel]) -> DataFrame:
    """channel, country, side, id, toks, from one pass over the records."""
    side = F.when(F.col("tier") == 1, "s").otherwise("r")
    of = F.explode(F.array(*[F.struct(F.lit(c.name).alias("channel"), F.array_distinct(c.tokens()).alias("toks")) for c in channels]))
    rows = records.select(F.col("country_norm").alias("country"), side.alias("side"), F.col("entity_id").alias("id"), of.alias("x"))
    return rows.select("x.channel", "country", "side", "id", "x.toks")


def single_tokens(tokens: DataFrame) -> DataFrame:
    """channel, country, side, id, tok of a token table."""
    return tokens.select("channel", "country", "side", "id", F.explode("toks").alias("tok"))


def _by_channel(channels: list[Channel], value: Callable[[Channel], object]) -> Column:
    out = F.lit(None)
    for c in channels:
        out = F.when(F.col("channel") == c.name, F.lit(value(c))).otherwise(out)
    return out


def vocabulary(records: DataFrame, tokens: DataFrame, channels: list[Channel]) -> DataFrame:
    """channel, country, tok, df, idf, indexable of the answering side; its size counts empty records too."""
    sizes = records.groupBy(F.col("country_norm").alias("country"), F.when(F.col("tier") == 1, "s").otherwise("r").alias("side")).agg(F.count(F.lit(1)).alias("n_docs"))
    df = single_tokens(tokens.where(F.col("side") != _by_channel(channels, lambda c: c.asked))).groupBy("channel", "country", "side", "tok").agg(F.count(F.lit(1)).alias("df"))
    cap = F.least(F.lit(DF_LIMIT), F.greatest(F.lit(DF_LEAST), F.floor(F.col("n_docs") * _by_channel(channels, lambda c: c.df_frac))))
    idf = F.log(1 + F.col("n_docs") / (1 + F.col("df")))
    # One row a country and side: a bounded broadcast.
    return df.join(F.broadcast(sizes), ["country", "side"]).select("channel", "country", "tok", "df", idf.alias("idf"), (F.col("df") <= cap).alias("indexable"))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a record from its weighed tokens, which come together; a negative weight only counts in the norm."""
    carry: pa.Table | None = None
    for batch in batches:
        whole = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
        rid = whole["rid"].to_numpy()
        cut = int(np.searchsorted(rid, rid[-1])) if len(rid) else 0
        carry = whole.slice(cut)
        if cut:
            yield from _profile(whole.slice(0, cut)).to_batches()
    if carry is not None and len(carry):
        yield from _profile(carry).to_batches()


def _profile(rows: pa.Table) -> pa.Table:
    rid, tid, idf = rows["rid"].to_numpy(), rows["tid"].to_numpy(), rows["idf"].to_numpy()
    new = np.append(True, rid[1:] != rid[:-1])
    rec = np.cumsum(new) - 1
    norm = np.sqrt(np.add.reduceat(idf * idf, np.flatnonzero(new)))
    at = np.flatnonzero(idf > 0)
    at = at[np.lexsort((tid[at], -idf[at], rec[at]))]
    sizes = np.bincount(rec[at], minlength=len(norm))
    # Each record has one row that names it.
    who = rows["who"].combine_chunks()
    who = pa.table(who.filter(who.is_valid()).flatten(), ["channel", "country", "side", "id"])
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    tids, idfs = (pa.ListArray.from_arrays(ends, pa.array(v[at])) for v in (tid, idf))
    out = who.append_column("norm", pa.array(norm)).append_column("tids", tids).append_column("idfs", idfs)
    return out.filter(pa.array(sizes > 0))


def weigh(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """channel, country, side, id, norm, tids, idfs: of each record its indexable tokens, the rarest first.

    ``norm`` counts all tokens that the answering side knows. Token numbers are in the order
    of the tokens, which breaks ties of equally rare ones.
    """
    numbered = vocab.orderBy("tok").select("channel", "country", "tok", F.monotonically_increasing_id().alias("tid"), F.when(F.col("indexable"), F.col("idf")).otherwise(-F.col("idf")).alias("idf"))
    rows = tokens.withColumn("rid", F.monotonically_increasing_id()).select("rid", "channel", "country", "side", "id", F.posexplode("toks").alias("pos", "tok"))
    known = rows.join(numbered.hint("shuffle_hash"), ["channel", "country", "tok"], "left").where("idf is not null or pos = 0")
    who = F.when(F.col("pos") == 0, F.struct("channel", "country", "side", "id"))
    slim = known.select("rid", F.coalesce("tid", F.lit(-1)).alias("tid"), F.coalesce("idf", F.lit(0.0)).alias("idf"), who.alias("who"))
    schema = "channel string, country string, side string, id string, norm double, tids array<bigint>, idfs array<double>"
    return slim.repartition("rid").sortWithinPartitions("rid").mapInArrow(_profiles, schema)


def _flat(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    lists = rows[column].combine_chunks()
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _best(rows: pa.Table, k: int) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Queries and answers of a tile; of each query's k best answers: their places in both and the score in millionths."""
    asks = rows["asks"].combine_chunks()
    queries, answers = rows.filter(asks), rows.filter(pc.invert(asks))
    answers = answers.take(pc.sort_indices(answers["id"]))
    none = np.zeros(0, np.int64)
    if not len(queries) or not len(answers):
        return queries, answers, none, none, none
    (tok, doc), (asked, query), weight = _flat(answers, "tids"), _flat(queries, "tids"), _flat(queries, "idfs")[0] ** 2
    order = np.argsort(tok, kind="stable")
    tok, doc, n = tok[order], doc[order], len(answers)
    first = np.searchsorted(tok, asked)
    count = np.searchsorted(tok, asked, "right") - first
    qn, dn = queries["norm"].to_numpy(), answers["norm"].to_numpy()
    upto = np.cumsum(np.bincount(query, count, len(queries)).astype(np.int64))
    found = []
    lo = 0
    while lo < len(queries):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PRODUCTS, "right")))
        a, b = np.searchsorted(query, [lo, hi])
        own = count[a:b]
        total = int(own.sum())
        if total:
            rep = np.repeat(np.arange(a, b), own)
            places = np.arange(total) + np.repeat(first[a:b] - (np.cumsum(own) - own), own)
            key, w = (query[rep] - lo) * n + doc[places], weight[rep]
            if (hi - lo) * n <= 8 * total:
                sums = np.bincount(key, w, (hi - lo) * n)
                key = np.flatnonzero(sums)
                sums = sums[key]
            else:
                order = np.argsort(key, kind="stable")
                key = key[order]
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                key, sums = key[start], np.add.reduceat(w[order], start)
            q, d = key // n, key % n
            score = np.floor(sums / (qn[lo + q] * dn[d]) * 1e6 + 0.5).astype(np.int64)
            # Query, falling score, answer in the order of ids: one number, as scores are at most 1.
            key = np.sort((q * (1 << 20) + ((1 << 20) - 1 - score)) * n + d)
            q = key // n >> 20
            start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            key = key[np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k]
            found.append(((key // n >> 20) + lo, key % n, (1 << 20) - 1 - (key // n & (1 << 20) - 1)))
        lo = hi
    return (queries, answers, *(np.concatenate(x) if found else none for x in (zip(*found, strict=True) if found else (none, none, none))))


def top_k(weighted: DataFrame, channels: list[Channel]) -> DataFrame:
    """channel, country, q, d, score, rank (0-based) of the records nearest to each query.

    Only the rarest indexable tokens of a query are looked up; the df cap bounds the
    answers that a token can bring. The products are summed inside a tile of at most about
    ``TILE`` queries and answers, so that none of them is written; each tile keeps its k best.
    """
    weighted = weighted.where(F.col("channel").isin([c.name for c in channels]))
    asks = (F.col("side") == _by_channel(channels, lambda c: c.asked)).alias("asks")
    rows = weighted.select("channel", "country", asks, "id", "norm", "tids", "idfs")
    tiles = lambda side: F.ceil(F.count(F.when(side, 1)) / TILE).cast("int")
    # One row a channel and country: a bounded broadcast.
    sizes = rows.groupBy("channel", "country").agg(tiles(F.col("asks")).alias("nq"), tiles(~F.col("asks")).alias("nd")).where("nq > 0 and nd > 0")
    sized = rows.join(F.broadcast(sizes), ["channel", "country"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    head = lambda c: F.slice(c, 1, _by_channel(channels, lambda x: x.query_tokens).cast("int"))
    asked = sized.where("asks").select("channel", "country", own("nq").alias("tq"), every("nd").alias("td"), "asks", "id", "norm", head("tids").alias("tids"), head("idfs").alias("idfs"))
    answers = sized.where("not asks").select("channel", "country", every("nq").alias("tq"), own("nd").alias("td"), "asks", "id", "norm", "tids", F.array().cast("array<double>").alias("idfs"))
    most = {c.name: c.k for c in channels}

    def best(rows: pa.Table) -> pa.Table:
        channel, country = rows["channel"][0].as_py(), rows["country"][0].as_py()
        queries, answers, q, d, score = _best(rows, most[channel])
        same = lambda x: pa.array([x] * len(q), pa.string())
        return pa.table({"channel": same(channel), "country": same(country), "q": queries["id"].take(pa.array(q)), "d": answers["id"].take(pa.array(d)), "score": pa.array(score / 1e6)})

    scored = asked.unionByName(answers).groupBy("channel", "country", "tq", "td").applyInArrow(best, "channel string, country string, q string, d string, score double")
    best_first = Window.partitionBy("channel", "country", "q").orderBy(F.desc("score"), "d")
    ranked = scored.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= _by_channel(channels, lambda c: c.k))
    return ranked.withColumn("rank", (F.col("rank") - 1).cast("long"))


def index_stats(vocab: DataFrame) -> DataFrame:
    """Per channel and country: tokens, postings and indexable tokens of the answering side."""
    return vocab.groupBy("channel", "country").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("df").alias("n_postings"), F.sum(F.col("indexable").cast("long")).alias("n_indexable"), F.max("df").alias("max_df"))
