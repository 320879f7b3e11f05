"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct word shingles. The hash space
is cut into ``REGISTERS`` buckets; for the least hash of each bucket a register keeps
the number of leading zeros (6 bits) and the 10 bits after the leading one. An empty
bucket takes the register of that filled bucket which ranks first in a fixed random
order of its own, so that short texts fill all registers. Bands of ``ROWS`` registers
give buckets of candidates; at a similarity of 0.85 a pair misses all of them with
probability below 1e-9.

Documents with equal sets are folded into one first. The members of a bucket go with
its smallest member (the pivot), in blocks of at most about ``BLOCK``. There the stored
registers are compared: their Jaccard estimate, corrected for the chance collisions that
the two set sizes make likely, rejects beyond six standard deviations only. Members
without a likely partner go no further; the others form clusters, and only then texts
move, filtered at the scan, and links are confirmed on full sets.

Pivots of several blocks whose members are still in several components are open. Their
members get new, more selective buckets (``WIDE_ROWS`` registers, ``WIDE`` draws), which
grow with the members, not with their square. What is open after that is compared
block by block, on registers of 256 bytes; likewise the parts of one cluster of more than
``TEXTS`` texts. No link between different components is lost.

Words are split at ASCII white space and A-Z are lowered. A text with fewer words than a
shingle is one shingle; a text that is null or without words has the empty set and
links with nothing. Rows with a null doc_id get a null component and are kept; repeated
rows are returned each, and an id that repeats has the least component of its texts; ties go
to the smaller id; a very long text is hashed whole, alone in its step; an empty table gives
an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, semi_by_id, tidy
from .components import UnionFind, components
from .textvec import LOWER, chunks, mix, span_hashes, words

REGISTERS = 128
ROWS = 4
BANDS = REGISTERS // ROWS
WIDE_ROWS = 8
WIDE = 96
#: Members of a pivot whose registers are compared in one step, and texts in one step.
BLOCK = 1024
TEXTS = 192
#: A pivot's members are spread over so many tasks where its block count joins them.
SALTS = 64
#: Chance that the registers of different least hashes of sets of equal size are equal:
#: the constant of the published HyperMinHash estimate over the 10 bits of a register.
COLLISION = 0.169919487159739 / 1024
_rng = np.random.Generator(np.random.PCG64(77))
_RANK = _rng.random((REGISTERS, REGISTERS))
_TIMES = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DRAWS = np.stack([_rng.permutation(REGISTERS)[:WIDE_ROWS] for _ in range(WIDE)])
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = LOWER[buf]
    starts, ends, first = words(low, off)
    n_words = np.diff(first)
    word = span_hashes(low, starts, ends)
    rolled = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for j in range(width):
        rolled += word[j : j + len(rolled)] * _TIMES[j]
    rolled = mix(rolled)
    out = []
    for i, n in enumerate(n_words.tolist()):
        a = int(first[i])
        if n >= width:
            h = np.sort(rolled[a : a + n - width + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif n:
            out.append(mix(np.array([(word[a : a + n] * _TIMES[:n]).sum(dtype=np.uint64) + np.uint64(n)])))
        else:
            out.append(rolled[:0])
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a non-empty sorted set."""
    at = np.searchsorted(hashes, _EDGES)
    stop = np.append(at[1:], len(hashes))
    filled = np.flatnonzero(at < stop)
    fraction, exponent = np.frexp((hashes[at[filled]] << np.uint64(7)).astype(np.float64))
    zeros = np.minimum(64 - exponent, 63)
    own = (zeros.astype(np.uint16) << np.uint16(10)) | np.minimum(((fraction - 0.5) * 2048).clip(0), 1023).astype(np.uint16)
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = own
    if len(filled) < REGISTERS:
        empty = np.setdiff1d(np.arange(REGISTERS), filled, assume_unique=True)
        out[empty] = own[_RANK[np.ix_(empty, filled)].argmax(1)]
    return out


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key, regs = [], [], []
            for _, buf, off in chunks(batch.column(1)):
                for h in shingle_sets(buf, off, width):
                    size.append(len(h))
                    if len(h):
                        key.append(np.array([mix(h).sum(dtype=np.uint64), (mix(h ^ _TIMES[63]) * _TIMES[62]).sum(dtype=np.uint64), len(h)], np.uint64).tobytes())
                        regs.append(registers(h).tobytes())
                    else:
                        key.append(None)
                        regs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "regs"])

    return run


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, on sorted distinct hashes."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How likely registers of different least hashes are equal, by the sizes of the sets."""
    return COLLISION * 4 * a * b / (a + b) ** 2


def may_link(regs: np.ndarray, size: np.ndarray, i: int, num: int, den: int) -> np.ndarray:
    """Which of the members before ``i`` may reach the similarity, by sizes and registers."""
    a, b = size[:i], size[i]
    least = num / den
    same = chance(a, b)
    estimate = ((regs[:i] == regs[i]).mean(1) - same) / (1 - same)
    filled = REGISTERS * -np.expm1(-np.minimum(a, b) / REGISTERS)
    spread = np.sqrt(least * (1 - least) * (1 / filled + (1 - filled / REGISTERS) / REGISTERS))
    return (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (estimate >= least - 6 * spread)


def clusters(regs: np.ndarray, size: np.ndarray, known: np.ndarray, side: np.ndarray, num: int, den: int) -> np.ndarray:
    """A label for members with a likely partner that they are not connected with, else -1.

    ``known``: components so far, -1 for none; ``side``: 0 and 1 where only pairs across count, else 2.
    """
    label, likely = np.arange(len(regs)), np.zeros(len(regs), bool)
    for i in range(1, len(regs)):
        wanted = ((known[:i] != known[i]) | (known[i] < 0)) & ((side[:i] == 2) | (side[:i] != side[i]))
        if not wanted.any():
            continue
        near = np.flatnonzero(wanted & may_link(regs, size, i, num, den))
        if len(near):
            likely[near] = likely[i] = True
            joined = np.unique(np.append(label[near], label[i]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return np.where(likely, label, -1)


CLUSTER = "pivot long, part long, head long, sub long, subs long, rid long, known long"


def _cuts(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal rows of sorted columns."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cut = [0, *(np.flatnonzero(new) + 1).tolist(), n] if n else [0]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _sifter(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pivot", "ascending"), ("part", "ascending"), ("rid", "ascending")])
        pivot, part, rid, known, side = (table[c].to_numpy() for c in ("pivot", "part", "rid", "known", "side"))
        size = table["n_shingles"].to_numpy().astype(np.float64)
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(len(rid), -1)
        out: list[np.ndarray] = []
        for a, b in _cuts(pivot, part):
            label = clusters(regs[a:b], size[a:b], known[a:b], side[a:b], num, den)
            for one in np.unique(label[label >= 0]).tolist():
                rows = np.flatnonzero(label == one) + a
                subs = max(1, -(-(len(rows) - 1) // TEXTS))
                for sub in range(subs):
                    own = np.append(rows[0], rows[1 + sub * TEXTS : 1 + (sub + 1) * TEXTS])
                    keys = [np.full(len(own), x, np.int64) for x in (pivot[a], part[a], rid[rows[0]], sub, subs)]
                    out.append(np.stack([*keys, rid[own], known[own]]))
        names = [c.split()[0] for c in CLUSTER.split(", ")]
        found = np.concatenate(out, axis=1) if out else np.empty((len(names), 0), np.int64)
        give_back()
        return pa.table([pa.array(c) for c in found], names=names)

    return run


def _link_block(ids: list[int], sets: list[np.ndarray], known: list[int], sides: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the links between members that are not connected yet."""
    regs = np.stack([registers(s) for s in sets])
    size = np.array([len(s) for s in sets], np.float64)
    local, first, edges = UnionFind(len(ids)), {}, []
    for i, c in enumerate(known):
        if c >= 0:
            local.join(i, first.setdefault(c, i))
    side = np.array(sides)
    # Components of the rows before, kept current by relabelling.
    comp = np.array([local.find(i) for i in range(len(ids))])
    for i in range(1, len(ids)):
        wanted = (comp[:i] != comp[i]) & ((side[:i] == 2) | (side[:i] != side[i]))
        if not wanted.any():
            continue
        for j in np.flatnonzero(wanted & may_link(regs, size, i, num, den)).tolist():
            if comp[j] != comp[i] and similar(sets[i], sets[j], num, den):
                edges.append((ids[i], ids[j]))
                a, b = comp[i], comp[j]
                comp[comp == max(a, b)] = min(a, b)
    return edges


def _verifier(width: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        keys = ("pivot", "part", "head", "sub")
        table = table.sort_by([(c, "ascending") for c in (*keys, "rid")])
        rid, known, side = table["rid"].to_pylist(), table["known"].to_pylist(), table["side"].to_pylist()
        text = table["text"].combine_chunks()
        edges: list[tuple[int, int]] = []
        for a, b in _cuts(*(table[c].to_numpy() for c in keys)):
            sets = [h for _, buf, off in chunks(text.slice(a, b - a)) for h in shingle_sets(buf, off, width)]
            edges += _link_block(rid[a:b], sets, known[a:b], side[a:b], num, den)
        x, y = zip(*edges, strict=True) if edges else ((), ())
        give_back()
        return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return run


def _groups(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def _blocks(keyed: DataFrame) -> DataFrame:
    """pivot, rid, part, parts: the members of each bucket (rid, band, key) with its smallest, in blocks."""
    shared = materialize(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("pivot")).where("n > 1").drop("n"), "buckets")
    stars = materialize(keyed.join(shared, ["band", "key"]).select("pivot", "rid").where("rid <> pivot").distinct(), "stars")
    blocks = materialize(stars.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "pivots")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    salted = stars.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    counted = salted.join(blocks.where("parts > 1").withColumn("salt", salts), ["pivot", "salt"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = counted.select("pivot", "rid", "parts", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("rid"), F.col("parts"))).otherwise(0).cast("long").alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<bigint>"))
    return materialize(dealt.unionByName(blocks.select("pivot", F.col("pivot").alias("rid"), "parts", every.alias("part"))), "blocks")


def _wide_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        keys = np.zeros((batch.num_rows, WIDE), np.uint64)
        for j in range(WIDE_ROWS):
            keys = mix(keys + (regs[:, _DRAWS[:, j]].astype(np.uint64) + np.uint64(1)) * _TIMES[j])
        rid = np.repeat(batch.column(0).to_numpy(), WIDE)
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.tile(np.arange(WIDE, dtype=np.int32), batch.num_rows)), pa.array(keys.reshape(-1).view(np.int64))], names=["rid", "band", "key"])


class _Links:
    """The links found so far and the classes they make."""

    def __init__(self, reps: DataFrame, rows: DataFrame, width: int, num: int, den: int):
        self.reps, self.law = reps, (width, num, den)
        self.texts = rows.where("doc_id is not null").withColumnRenamed("doc_id", "rid")
        self.edges: DataFrame | None = None
        self.found: DataFrame | None = None

    def known(self, members: DataFrame) -> DataFrame:
        """Members with ``known``: the class of each, its own id without links."""
        if self.found is None:
            return members.withColumn("known", F.lit(-1).cast("long"))
        return members.join(self.found.select(F.col("id").alias("rid"), F.col("component").alias("known")), "rid", "left").withColumn("known", F.coalesce("known", "rid"))

    def compare(self, members: DataFrame) -> None:
        """Registers first, then full sets, of members pivot, part, rid, known, side."""
        members = materialize(members.select("pivot", "part", "rid", "known", "side"), "members")
        grp = F.pmod(F.xxhash64("pivot", "part"), F.lit(_groups(members, 4 * BLOCK)))
        full = members.join(self.reps.select("rid", "n_shingles", "regs"), "rid").withColumn("grp", grp)
        likely = materialize(full.groupBy("grp").applyInArrow(_sifter(*self.law[1:]), CLUSTER), "likely")
        self._verify(likely.withColumn("side", F.lit(2)))
        # Clusters of several parts whose members are in several components: pairs of parts.
        many = self.known(likely.where("subs > 1").drop("known"))
        key = ["pivot", "part", "head"]
        open_ = many.groupBy(key).agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo < hi").select(key)
        rest = materialize(many.join(open_, key, "left_semi"), "open-clusters")
        if rest.limit(1).count():
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))
            crossed = rest.withColumn("other", other).where("other <> sub").withColumn("side", F.when(F.col("sub") < F.col("other"), 0).otherwise(1))
            self._verify(crossed.withColumn("sub", F.least("sub", "other") * F.lit(1 << 24) + F.greatest("sub", "other")).drop("other"))

    def _verify(self, members: DataFrame) -> None:
        ids = materialize(members.select("rid").distinct(), "survivors")
        texts = semi_by_id(self.texts, ids, "rid")
        grp = F.pmod(F.xxhash64("pivot", "part", "head", "sub"), F.lit(_groups(members, 2 * TEXTS)))
        full = members.join(texts, "rid").withColumn("grp", grp)
        new = materialize(full.groupBy("grp").applyInArrow(_verifier(*self.law), "a long, b long"), "links")
        if new.limit(1).count() or self.found is None:
            self.edges = new if self.edges is None else self.edges.unionByName(new)
            self.found = materialize(components(self.edges), "components")

    def open(self, blocks: DataFrame) -> DataFrame:
        """The members of pivots with several blocks and several components."""
        many = self.known(blocks.where("parts > 1"))
        spans = many.groupBy("pivot").agg(F.min("known").alias("lo"), F.max("known").alias("hi"), F.max("parts").alias("parts"))
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<bigint>"))
        return materialize(many.join(spans.where("lo < hi").select("pivot", every.alias("part")), ["pivot", "part"], "left_semi"), "open")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(rows.mapInArrow(tidy(_sketcher(width)), "doc_id long, n_shingles long, set_key binary, regs binary"), "sketches")
    sets = sketches.where("set_key is not null and doc_id is not null")
    reps = materialize(sets.groupBy("set_key").agg(F.min("doc_id").alias("rid"), F.first("regs").alias("regs"), F.first("n_shingles").alias("n_shingles")), "sets")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS)).alias("key"))))
    links = _Links(reps, rows, width, num, den)
    side = F.lit(2).alias("side")
    if sets.groupBy("doc_id").count().where("count > 1").limit(1).count():
        links.texts = links.texts.dropDuplicates()
    blocks = _blocks(reps.select("rid", band.alias("x")).select("rid", "x.*"))
    links.compare(links.known(blocks).withColumn("side", side))
    rest = links.open(blocks)
    if rest.limit(1).count():
        again = materialize(rest.select("rid").distinct(), "open-ids")
        blocks = _blocks(reps.select("rid", "regs").join(again, "rid", "left_semi").mapInArrow(tidy(_wide_keys), "rid long, band int, key long"))
        links.compare(links.known(blocks).withColumn("side", side))
        rest = links.open(blocks)
        if rest.limit(1).count():
            other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<bigint>"))
            crossed = rest.withColumn("other", other).where("other <> part").withColumn("side", F.when(F.col("part") < F.col("other"), 0).otherwise(1))
            links.compare(crossed.withColumn("part", F.least("part", "other") * F.lit(1 << 24) + F.greatest("part", "other")))
    class_of = reps.select("set_key", "rid").join(links.found.withColumnRenamed("id", "rid"), "rid", "left").select("set_key", F.coalesce("component", "rid").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(class_of, "set_key", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates_sql(width: int = 3, num: int = 85, den: int = 100) -> str:
    """The same rows in DuckDB SQL, from the words themselves."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < {width} then array_to_string(w, ' ') else unnest(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) end as x from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where {den} * both_ >= {num} * (na.n + nb.n - both_)),
step as (select a, b from links union select b, a from links),
reach as (select a, b from step union select r.a, s.b from reach r join step s on s.a = r.b),
least as (select a as doc_id, min(b) as c from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(l.c, d.doc_id)) as component_id, d.doc_id <= coalesce(l.c, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join least l on l.doc_id = d.doc_id
"""
