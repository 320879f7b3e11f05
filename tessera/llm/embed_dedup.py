"""Embedding near-duplicates by randomised-rotation binary codes with correction factors.

Unit vectors are rotated at random, as often as ``BANDS * BAND_BITS`` signs need. Stored for
each vector: its signs, packed; the factor, the inner product of the rotated vector with its
own signs; and the vector in steps of one byte with the length of what they miss. The signs
of one vector and the bytes of another give an unbiased estimate of their cosine, once
divided by the factor, and the same numbers bound its error. Pairs whose bound stays below
the threshold are dropped there; vectors move only for those that are left, and their
cosines are computed exactly in double precision.

Candidates come from bands of ``BAND_BITS`` sign bits over ``BANDS`` bands: a pair at cosine
0.98 misses all bands with a probability below 1e-6. Identical vectors of a label are folded
first. A bucket of many vectors is cut into blocks, and pairs of blocks are compared by
matrix products; each pair counts in the first band that holds it, and tasks return sums of
links and a forest of the links, never the pairs.

Vectors that are null, zero or hold null or non-finite components, and rows with a null
label or vec_id, link with nothing: n_links 0 and their own id as component (null for
a null id, which is kept; kept is true for both). Repeated rows link with each other; an id
with several vectors is one member of its component; an empty table gives an empty one;
other columns are ignored, whatever their names. Vectors of unequal length link with
nothing; a very long vector is coded like any other, with at least one rotation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, tidy
from .components import UnionFind, components

BANDS = 48
BAND_BITS = 20
BLOCK = 1024
SIGNS = BANDS * BAND_BITS
SIGMAS = 6.0
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotations(dim: int, bits: int) -> np.ndarray:
    """Orthogonal matrices side by side, at least ``bits`` columns, from a fixed seed."""
    if (dim, bits) not in _ROTATIONS:
        rng = np.random.Generator(np.random.PCG64(dim * 1_000_003 + 9))
        _ROTATIONS[dim, bits] = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))], axis=1)
    return _ROTATIONS[dim, bits]


def _unit(column: list) -> np.ndarray:
    x = np.array(column, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotated(unit: np.ndarray) -> np.ndarray:
    return unit @ rotations(unit.shape[1], SIGNS)[:, :SIGNS]


CODED = "rid long, label long, embedding array<double>, copies long, dim int, keys array<int>, signs binary, factor double, steps binary, step double, missed double"


def _coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    power = np.int64(1) << np.arange(BAND_BITS, dtype=np.int64)
    for whole in batches:
        for batch in (whole.slice(lo, 2000) for lo in range(0, whole.num_rows, 2000)):
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            n = len(vectors)
            keys, factor, step, missed = np.zeros((n, BANDS), np.int32), np.zeros(n), np.zeros(n), np.zeros(n)
            signs, steps = [b""] * n, [b""] * n
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                unit = _unit([vectors[i] for i in rows])
                turned = rotated(unit)
                bits = turned > 0
                keys[rows] = (bits.reshape(len(rows), BANDS, BAND_BITS) * power).sum(2)
                factor[rows] = np.abs(turned).sum(1) / np.sqrt(dim)
                step[rows] = np.abs(unit).max(1) / 127
                near = np.rint(unit / step[rows, None])
                missed[rows] = np.linalg.norm(unit - near * step[rows, None], axis=1)
                packed, small = np.packbits(bits, axis=1), near.astype(np.int8)
                for k, i in enumerate(rows.tolist()):
                    signs[i], steps[i] = packed[k].tobytes(), small[k].tobytes()
            made = [pa.array(sizes, pa.int32()), pa.array(list(keys), pa.list_(pa.int32())), pa.array(signs, pa.binary()), pa.array(factor), pa.array(steps, pa.binary()), pa.array(step), pa.array(missed)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f.split()[0] for f in CODED.split(", ")])


class Codes:
    """Stored codes of vectors of one length, with bounds on the cosines of pairs."""

    def __init__(self, dim: int, signs: list[bytes], factor: np.ndarray, steps: list[bytes], step: np.ndarray, missed: np.ndarray):
        self.dim, self.factor, self.missed = dim, factor, missed
        self.bits = np.unpackbits(np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), -1), axis=1, count=SIGNS)
        self.near = np.frombuffer(b"".join(steps), np.int8).reshape(len(steps), dim) * step[:, None]

    def bands(self, rows: np.ndarray) -> np.ndarray:
        """The bits of each band as one number."""
        return (self.bits[rows].reshape(len(rows), BANDS, BAND_BITS) * (np.int64(1) << np.arange(BAND_BITS))).sum(2)

    def estimates(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Estimated cosines: signs of the left vectors, rotated bytes of the right ones, over the factors."""
        turned = rotated(self.near[right]).astype(np.float32)
        signs = (self.bits[left].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.dim))
        return signs @ turned.T / self.factor[left, None]

    def open(self, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
        """Pairs whose cosine may reach the threshold, by the confidence bound of the estimate."""
        turns = SIGNS / self.dim
        mean = np.clip(self.factor[left] / turns, 1e-9, 1.0)
        # The error comes from the part of a vector that stands off the other one.
        spread = np.sqrt((1 - mean**2) / mean**2 * (1 - threshold**2) / (max(self.dim - 1, 1) * max(turns, 1.0)))
        slack = SIGMAS * spread[:, None] + self.missed[right][None, :] / mean[:, None] + 1e-4
        return self.estimates(left, right) + slack >= threshold


def undecided(codes: Codes, band: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows, rows) of left and right that meet first in this band and may be linked."""
    a, b = codes.bands(left), codes.bands(right)
    first = a[:, band][:, None] == b[:, band][None, :]
    for k in range(band):
        first &= a[:, k][:, None] != b[:, k][None, :]
    if left is right:
        first &= np.tri(len(left), k=-1, dtype=bool).T
    if first.any():
        first &= codes.open(left, right, threshold)
    i, j = np.nonzero(first)
    return left[i], right[j]


GROUP = ("label", "band", "key", "x", "y", "dim")


def _groups(table: pa.Table) -> Iterator[tuple[int, int, int, pa.Table]]:
    """(band, x, y, rows) of each pair of blocks."""
    table = table.sort_by([(c, "ascending") for c in (*GROUP, "rid")]).combine_chunks()
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in GROUP:
        v = table[c].to_numpy()
        new |= v[1:] != v[:-1]
    cut = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a > 1:
            rows = table.slice(a, b - a)
            yield rows["band"][0].as_py(), rows["x"][0].as_py(), rows["y"][0].as_py(), rows


def _sides(rows: pa.Table, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    block = rows["block"].to_numpy()
    left = np.flatnonzero(block == x)
    return left, left if x == y else np.flatnonzero(block == y)


def _codes(rows: pa.Table) -> Codes:
    plain = lambda c: rows[c].to_numpy()
    return Codes(rows["dim"][0].as_py(), rows["signs"].to_pylist(), plain("factor"), rows["steps"].to_pylist(), plain("step"), plain("missed"))


MEMBER = "rid long, label long, band int, key int, block int, x int, y int"


def _sifter(threshold: float):
    """Members of a pair of blocks that some pair leaves undecided."""
    names = [f.split()[0] for f in MEMBER.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        out = []
        for band, x, y, rows in _groups(table):
            i, j = undecided(_codes(rows), band, *_sides(rows, x, y), threshold)
            if len(i):
                out.append(rows.take(pa.array(np.union1d(i, j))).select(names))
        give_back()
        return pa.concat_tables(out) if out else table.select(names).slice(0, 0)

    return run


def _linker(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        out = {"id": [], "other": [], "links": []}
        for band, x, y, rows in _groups(table):
            i, j = undecided(_codes(rows), band, *_sides(rows, x, y), threshold)
            if not len(i):
                continue
            unit, ids, copies = _unit(rows["embedding"].to_pylist()), rows["rid"].to_numpy(), rows["copies"].to_numpy()
            good = np.zeros(len(i), bool)
            for lo in range(0, len(i), 50_000):
                part = slice(lo, lo + 50_000)
                good[part] = np.einsum("ij,ij->i", unit[i[part]], unit[j[part]]) >= threshold
            i, j = i[good], j[good]
            if not len(i):
                continue
            sums = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            hit = np.flatnonzero(sums)
            out["id"].append(ids[hit])
            out["other"].append(np.full(len(hit), -1))
            out["links"].append(sums[hit].astype(np.int64))
            local = UnionFind(len(ids))
            forest = [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if local.join(a, b)] if len(i) < 4 * len(ids) else _forest(i, j, local)
            a, b = np.array(forest).T
            out["id"].append(ids[a])
            out["other"].append(ids[b])
            out["links"].append(np.zeros(len(a), np.int64))
        cols = {k: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for k, v in out.items()}
        give_back()
        return pa.table({**cols, "is_edge": cols["links"] == 0})

    return run


def _forest(i: np.ndarray, j: np.ndarray, local: UnionFind) -> list[tuple[int, int]]:
    """A forest of many pairs: rows that are connected already are dropped in bulk."""
    out = []
    while len(i):
        roots = np.array([local.find(k) for k in range(len(local.up))])
        open_ = roots[i] != roots[j]
        i, j = i[open_], j[open_]
        head = max(1024, len(local.up))
        out += [(a, b) for a, b in zip(i[:head].tolist(), j[:head].tolist(), strict=True) if local.join(a, b)]
        i, j = i[head:], j[head:]
    return out


def _grouped(members: DataFrame, coded: DataFrame):
    """Members with what is stored of them, some thousands to a group of pairs of blocks."""
    groups = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-members.count() // 4000))
    return members.join(coded, "rid").withColumn("grp", F.pmod(F.xxhash64("label", "band", "key", "x", "y"), F.lit(groups))).groupBy("grp")


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    x = F.col("embedding")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
    fine &= ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    valid = rows.where("fine")
    reps = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("copies"))
    coded = materialize(reps.select("rid", "label", "embedding", "copies").mapInArrow(tidy(_coder), CODED), "codes")
    banded = coded.select("rid", "label", F.posexplode("keys").alias("band", "key"))
    shared = materialize(banded.groupBy("label", "band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "band", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    members = banded.join(shared, ["label", "band", "key"]).withColumn("block", F.pmod(F.xxhash64("rid", "band"), F.col("blocks")).cast("int"))
    paired = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rid", "label", "band", "key", "block", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"))
    paired = materialize(paired, "members")
    code = ["dim", "signs", "factor", "steps", "step", "missed"]
    likely = materialize(_grouped(paired, coded.select("rid", *code)).applyInArrow(_sifter(threshold), MEMBER), "likely")
    found = materialize(_grouped(likely, coded.select("rid", "embedding", "copies", *code)).applyInArrow(_linker(threshold), "id long, other long, links long, is_edge boolean"), "links")
    links = found.where("not is_edge").groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.where("is_edge").select(F.col("id").alias("a"), F.col("other").alias("b")))
    # Classes of identical vectors with what they link to; singles need no join back by vector.
    state = coded.select("rid", "label", "embedding", "copies").join(links.withColumnRenamed("id", "rid"), "rid", "left").join(comps.withColumnRenamed("id", "rid"), "rid", "left").where("copies > 1 or links is not null").select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("component"))
    out = rows.withColumn("label", F.when(F.col("fine"), F.col("label"))).join(state, ["label", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def near_vectors_sql(threshold: float = 0.98) -> str:
    """The same rows in DuckDB SQL, from all pairs of a label."""
    return f"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as x from embeddings
  where label is not null and vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= {threshold}),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
n as (select a as vec_id, count(*) as n from links group by 1),
least as (select a as vec_id, min(b) as c from reach group by 1)
select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(l.c, e.vec_id)) as component_id, e.vec_id <= coalesce(l.c, e.vec_id) as kept
from embeddings e left join n on n.vec_id = e.vec_id left join least l on l.vec_id = e.vec_id
"""
