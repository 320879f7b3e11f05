"""Sharding by sampled splitters, in DataFrame functions only.

Rows are ordered by (60 bits of the text's md5, doc_id), so equal texts lie side by side and a
shard boundary falls inside such a group only where it must. A sample of keys drawn
with a probability proportional to the row's bytes gives quantile boundaries; records
fall into the ranges between them. Ranges with too many rows are subdivided in the same
order: by even steps of the hash, and where one text fills a step, by even steps of its
ids. The bytes of all ranges, cumulated exactly, then place every record in
one of ``shards`` shards of near equal bytes (law ``bytes``): a record goes where the
middle of its bytes lies.

A null text has size 1 and the crc of the empty text; null ids sort first; repeated
rows and ties are rows of their own; a very long text is read once, for its size and hash;
an empty table gives an empty one. Other columns are kept, whatever their names, unless
they carry the name of an added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, utf8_size

SAMPLE = 40_000
RANGES = 512
RANGE_ROWS = 20_000
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of boundaries that are at most (_h, _k), by binary search in literals."""
    if not bounds:
        return F.lit(0)
    hs, ks = F.array(*[F.lit(h) for h, _ in bounds]), F.array(*[F.lit(k) for _, k in bounds])
    steps = len(bounds).bit_length()

    def halve(acc: Column, _: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        h, k = F.get(hs, mid), F.get(ks, mid)
        under = (h < F.col("_h")) | ((h == F.col("_h")) & (k <= F.col("_k")))
        return F.when(lo >= hi, acc).when(under, F.struct((mid + 1).alias("lo"), hi.alias("hi"))).otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: acc["lo"])


def _subdivided(placed: DataFrame) -> DataFrame:
    """Ranges in steps of about RANGE_ROWS rows, and steps that one text fills in parts, in the order of (_h, _k)."""
    even = lambda c, lo, hi, n: F.least(n - 1, F.floor((c.cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double") + 1.0) * n)).cast("int")
    # At most RANGES rows: a bounded broadcast.
    spans = F.broadcast(placed.groupBy("_range").agg(F.ceil(F.count(F.lit(1)) / RANGE_ROWS).cast("int").alias("_n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi")))
    stepped = placed.join(spans, "_range").withColumn("_step", even(F.col("_h"), F.col("_lo"), F.col("_hi"), F.col("_n"))).drop("_n", "_lo", "_hi")
    texts = stepped.groupBy("_range", "_step", "_h").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo"), F.max("_k").alias("hi"))
    hot = texts.where(F.col("n") > RANGE_ROWS).groupBy("_range", "_step").agg(F.max(F.struct("n", F.col("_h").alias("h"), "lo", "hi")).alias("t"))
    hot = materialize(hot.select("_range", "_step", F.col("t.h").alias("_hot"), F.ceil(F.col("t.n") / RANGE_ROWS).cast("int").alias("_n"), F.col("t.lo").alias("_lo"), F.col("t.hi").alias("_hi")), "hot-texts")
    part = F.when(F.col("_hot").isNull() | (F.col("_h") < F.col("_hot")), 0).when(F.col("_h") > F.col("_hot"), F.col("_n") + 1).otherwise(even(F.col("_k"), F.col("_lo"), F.col("_hi"), F.col("_n")) + 1)
    return stepped.join(hot, ["_range", "_step"], "left").withColumn("_part", part.cast("int")).drop("_hot", "_n", "_lo", "_hi")


def shard_documents(docs: DataFrame, shards: int = 16, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and size, text_crc32, law, shard, slot, grown_shard."""
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ADDED]
    safe = [f"_c{i}" for i in range(len(names))]
    text = F.col("text").cast("string")
    keyed = docs.select(
        *[F.col(c).alias(a) for c, a in zip(names, safe, strict=True)],
        (utf8_size(text) + 1).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
        F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long").alias("_h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_k"),
    )
    keyed = materialize(keyed, "shard-keys")
    total = keyed.agg(F.sum("size").alias("b")).first()["b"] or 1
    # A size-weighted sample of about SAMPLE keys at most, whatever the input's size.
    chance = F.col("size") * F.lit(SAMPLE / total)
    draw = F.pmod(F.xxhash64("_h", "_k", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = sorted((r["_h"], r["_k"]) for r in keyed.where(draw < chance).select("_h", "_k").collect())
    bounds = sorted({sample[len(sample) * i // RANGES] for i in range(1, RANGES)}) if sample else []
    placed = keyed.withColumn("_range", _range_of(bounds))
    fine = _subdivided(placed)
    at = ("_range", "_step", "_part")
    inner = Window.partitionBy(*at).orderBy("_h", "_k", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    local = fine.withColumns({"_bytes": F.sum("size").over(inner), "_rows": F.count(F.lit(1)).over(inner)})
    # Bytes and rows before each part, in two steps: within a range, then one row a range.
    sums = fine.groupBy(*at).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_range, over = Window.partitionBy("_range").orderBy("_step", "_part"), Window.orderBy("_range")
    ranges = sums.groupBy("_range").agg(F.sum("b").alias("rb"), F.sum("n").alias("rn")).select("_range", before("rb", over).alias("rb"), before("rn", over).alias("rn"))
    offsets = sums.select(*at, before("b", in_range).alias("pb"), before("n", in_range).alias("pn")).join(F.broadcast(ranges), "_range").select(*at, (F.col("pb") + F.col("rb")).alias("_b0"), (F.col("pn") + F.col("rn")).alias("_n0"))
    middle = (F.col("_b0") + F.col("_bytes")) * 2 - F.col("size")
    numbered = local.join(offsets, list(at)).withColumn("_m", middle).withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast((_m * {shards}) div {2 * total} as int)")))
    numbered = materialize(numbered.select(*safe, "size", "text_crc32", "shard", (F.col("_n0") + F.col("_rows") - 1).alias("_row")), "shard-rows")
    # One row a shard.
    first = F.broadcast(numbered.groupBy("shard").agg(F.min("_row").alias("_first")))
    return numbered.join(first, "shard").select(*[F.col(a).alias(c) for c, a in zip(names, safe, strict=True)], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharding_sql(shards: int = 16) -> str:
    """The same rows in DuckDB SQL; the crc is taken byte by byte from a table of its own polynomial."""
    return f"""
with t as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end) as c from range(256) r(i))),
b as (select doc_id, coalesce(text, '') as text, flatten(list_transform(string_split(coalesce(text, ''), ''), lambda c: case when unicode(c) < 128 then [unicode(c)] when unicode(c) < 2048 then [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]
  when unicode(c) < 65536 then [224 + (unicode(c) >> 12), 128 + (unicode(c) >> 6 & 63), 128 + (unicode(c) & 63)] else [240 + (unicode(c) >> 18), 128 + (unicode(c) >> 12 & 63), 128 + (unicode(c) >> 6 & 63), 128 + (unicode(c) & 63)] end)) as b from documents),
k as (select doc_id, strlen(text) + 1 as size, case when text = '' then 0 else xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(b, lambda x: x::bigint)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) end as text_crc32,
  ('0x' || substr(md5(text), 1, 15))::bigint as h from b, t),
o as (select *, sum(size) over w as upto, sum(size) over () as total, row_number() over w as row from k window w as (order by h, doc_id nulls first, text_crc32 rows unbounded preceding)),
s as (select *, least({shards - 1}, ((2 * upto - size) * {shards}) // (2 * total))::int as shard from o)
select doc_id, size, text_crc32, 'bytes' as law, shard, row - min(row) over (partition by shard) as slot, null::int as grown_shard from s
"""
