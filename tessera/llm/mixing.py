"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a repetition rate: its share of the wanted rows over the rows it has.
A document's number of copies is the inverse of the Poisson distribution with that mean
at a uniform number hashed from the seed and the document id; copies are exploded and
dealt out in hash order. A rate above ``STEP`` is drawn as a sum of independent Poisson
numbers of equal mean, so that the table of cumulated probabilities stays short.

The random number is taken from md5, so any engine can repeat it. Rows with equal ids
draw equally and are all kept; a null id or source draws like the empty string; a null
source is a source of its own; ties in the order (equal ids) stay in any order; a very long
text is carried as it is; an empty table gives an empty one. Other columns are
kept, whatever their names; ``copy_no``, ``copies``, ``rate`` and ``shuffle_key`` are added
by the operator (a column of that name in the input is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

STEP = 8.0
TERMS = 60
SMALL_SOURCES = 10_000
ADDED = ("copies", "copy_no", "rate", "shuffle_key")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts."""
    text = F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def cumulated(mean: Column) -> Column:
    """P(X <= k) of a Poisson number with that mean, for k from 0 to TERMS - 1."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["all"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0) -> DataFrame:
    """One row a source: its rows, rate, the number of draws and their cumulated probabilities.

    ``weights`` are relative target shares by source (absent sources get none); without
    them the share is the source's rows to the power ``temperature``. ``size`` is the
    wanted number of rows over the number there are.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.round(F.pow(F.col("n").cast("double"), F.lit(temperature)), 6)
    else:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    shared = counts.withColumn("share", share.cast("decimal(28,6)"))
    total = shared.agg(F.sum("share").cast("double").alias("all_share"), F.sum("n").alias("all_n"))
    rate = F.when(F.col("all_share") > 0, F.round(F.col("share").cast("double") / F.col("all_share") * F.col("all_n") * F.lit(float(size)) / F.col("n"), 9)).otherwise(0.0)
    # One row on the right: the totals.
    rated = shared.join(F.broadcast(total)).withColumn("rate", rate)
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")
    return rated.select("source", "n", "rate", draws.alias("draws")).withColumn("cdf", cumulated(F.col("rate") / F.col("draws")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: str = "mix", key: str = "doc_id") -> DataFrame:
    """Every document as often as drawn, in globally shuffled order."""
    docs = docs.drop(*ADDED)
    names = docs.columns
    safe = [f"_c{i}" for i in range(len(names))]
    source, by = (F.col(safe[names.index(c)]) for c in ("source", key))
    rates = materialize(source_rates(docs, weights, temperature, size), "source-rates").withColumnRenamed("source", "_source")
    # A hot source beyond the broadcast: both sides of the join are plain exchanges, which Spark splits.
    few = rates.limit(SMALL_SOURCES + 1).count() <= SMALL_SOURCES
    joined = docs.toDF(*safe).join(F.broadcast(rates) if few else rates, source.eqNullSafe(F.col("_source")))
    one = lambda i: F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), i, by)))
    copies = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda acc, i: acc + one(i))
    drawn = joined.withColumn("copies", copies).where("copies > 0")
    exploded = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    keyed = exploded.withColumn("shuffle_key", F.md5(F.concat_ws("-", F.lit(seed), F.lit("order"), F.coalesce(by.cast("string"), F.lit("")), F.col("copy_no"))))
    out = keyed.select(*[F.col(c).alias(n) for c, n in zip(safe, names, strict=True)], *ADDED)
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixing_sql(temperature: float = 0.5, seed: str = "mix") -> str:
    """The same rows in DuckDB SQL (for rates up to STEP)."""
    return f"""
with counts as (select source, count(*) as n from documents group by source),
shared as (select source, n, round(pow(n::double, {temperature}), 6)::decimal(28,6) as share from counts),
total as (select sum(share)::double as all_share, sum(n)::double as all_n from shared),
rated as (select source, round(share::double / all_share * all_n * 1.0 / n, 9) as rate from shared, total),
drawn as (
  select d.*, r.rate,
    ('0x' || substr(md5('{seed}' || '-1-' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 as u
  from documents d join rated r on d.source is not distinct from r.source),
pmf as (select rate, k, exp(-rate + case when k = 0 then 0 else k * ln(rate) - lgamma(k + 1.0) end) as p
  from (select distinct rate from rated) r, range(0, {TERMS}) as t(k)),
cdf as (select rate, k, sum(p) over (partition by rate order by k) as c from pmf),
counted as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rate,
    (select count(*) from cdf where cdf.rate = d.rate and cdf.c <= d.u)::int as copies from drawn d)
select doc_id, text, lang, source, n_chars, copies, i::int as copy_no, rate,
  md5('{seed}' || '-order-' || coalesce(doc_id::varchar, '') || '-' || i) as shuffle_key
from counted, unnest(range(1, copies + 1)) as t(i)
"""
