"""Repeated passages: a distributed merge sort of sampled suffixes that knows common prefixes.

All strings of ``LENGTH`` bytes that start at two or more places are found; matches never
cross documents. Sorting the suffixes at every byte would move far more data than the
texts hold, so the suffixes sorted are those at anchors: each window of ``LENGTH`` bytes
picks the place of its least gram hash, which equal windows do alike. Grams that occur
once are dropped by a count. For the others the suffix from the anchor (padded to
``LENGTH``), continued by the reversed text before it, is a fixed-width string.

1. Tasks sort their strings into runs, fold equal ones (those windows are decided) and
   write the runs front-coded: the length shared with the string before, and the rest.
2. Sampled splitters cut the runs into ranges of bounded size, which are exchanged. They
   fall between grams; only a gram that fills ranges alone is split inside. Beyond
   ``COARSE`` ranges each coarse range draws splitters of its own, so the number of
   ranges follows the input. A loser tree merges the runs of a range; each contender
   carries its common prefix with the last winner, so characters known to be equal are
   never compared again.
3. Neighbours in that order give each anchor its longest match to the right, and
   matches in both directions against the neighbours.
4. The distinct strings are merged once more with the left side first, which gives the
   longest match to the left. Windows that fit within both limits but match neither
   neighbour are the only open ones; they are counted exactly by a 128-bit hash.

Equal texts are removed whole (if as long as ``LENGTH``) by their key. Null text is
empty; null ids and repeated rows are kept as rows; texts shorter than ``LENGTH`` stay
whole; a very long text is read in pieces of bounded size; ties (equal strings) are one
entry of a run; an empty table gives an empty one; other columns are kept by
``cut_repeats``, whatever their names, but for those named like an added one, which are
replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize, remove, slices, table_path, tidy
from .windows import GRAM, window_anchors

LENGTH = 200
LEFT = LENGTH - GRAM
WIDTH = LENGTH + LEFT
RUN = 24_000
BLOCK = 500
RANGE = 12_000
SAMPLE = 20_000
#: Ranges of one level of splitters.
COARSE = 2_000
SEEN = 50_000
_PAD = b"\xff"
OWNER = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("a", "<i4"), ("ll", "u1"), ("rl", "u1"), ("multi", "u1"), ("er", "u1"), ("lo1", "u1"), ("hi1", "u1"), ("lo2", "u1"), ("hi2", "u1")])
RUNS = "kind int, run long, seq int, first binary, rest binary, lcp binary, owners binary, k1 long, k2 long, s int, e int"
_RUN_FIELDS = [f.split()[0] for f in RUNS.split(", ")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_RUN_SCHEMA = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in RUNS.split(", ")])


def text_key() -> list[Column]:
    """96 bits of the text and its size name a distinct text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), (F.crc32(F.encode(text, "UTF-8")) * F.lit(1 << 31) + F.octet_length(text)).alias("k2")]


# --- strings ---------------------------------------------------------------------------


def context(text: bytes, a: int, first: int, last: int) -> tuple[bytes, int, int]:
    """The suffix at an anchor and its reversed left side, with their lengths."""
    right, left = text[a : last + LENGTH], text[first:a][::-1]
    return right + _PAD * (LENGTH - len(right)) + left + _PAD * (LEFT - len(left)), len(left), len(right)


def left_first(s: bytes) -> bytes:
    return s[:GRAM] + s[LENGTH:] + s[GRAM:LENGTH]


def shared(x: bytes, y: bytes, known: int = 0) -> int:
    """The common prefix of two strings of one length that agree in ``known`` bytes."""
    x, y = x[known:], y[known:]
    n = len(x)
    return known + n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)


def front_code(strings: list[bytes]) -> tuple[bytes, bytes]:
    """(rests, shared lengths) of a sorted list; the first is kept whole."""
    lcp, rests, before = [], [], None
    for s in strings:
        n = 0 if before is None else shared(before, s)
        lcp.append(n)
        rests.append(s[n:])
        before = s
    return b"".join(rests), np.array(lcp, "<u2").tobytes()


def decode(rest: bytes, lcp: bytes) -> Iterator[tuple[int, bytes]]:
    at, before = 0, b""
    for n in np.frombuffer(lcp, "<u2").tolist():
        before = before[:n] + rest[at : at + WIDTH - n]
        at += WIDTH - n
        yield n, before


def merge_runs(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merge sorted runs of (shared length with the one before, string, payload).

    A loser tree: ``common`` holds each contender's common prefix with the last winner.
    The longer one wins unseen; only contenders with equal prefixes are compared, and
    only beyond that prefix. Yields (shared length with the string before, ...).
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    head: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    string: list = [h[1] if h else None for h in head]
    common = [0] * k
    loser = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        a, b = string[x], string[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        m, n = common[x], common[y]
        if m != n:
            return (x, y) if m > n else (y, x)
        n = shared(a, b, m)
        if a <= b if n < WIDTH else x < y:
            common[y] = n
            return x, y
        common[x] = n
        return y, x

    tops = [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        tops[node], loser[node] = play(tops[2 * node], tops[2 * node + 1])
    w = tops[1] if k > 1 else 0
    while string[w] is not None:
        yield common[w], string[w], head[w][2]
        head[w] = nxt = next(runs[w], None) if w < len(runs) else None
        if nxt is None:
            string[w] = None
        else:
            common[w], string[w] = nxt[0], nxt[1]
        node = (w + k) >> 1
        while node:
            w, loser[node] = play(w, loser[node])
            node >>= 1


# --- runs ------------------------------------------------------------------------------


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{c: r.get(c) for c in _RUN_FIELDS} for r in rows], schema=_RUN_SCHEMA)


def _blocks(run: int, strings: list[bytes], owners: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(strings), BLOCK):
        part = strings[lo : lo + BLOCK]
        rest, lcp = front_code(part)
        yield _rows([{"kind": 0, "run": run, "seq": lo, "first": part[0], "rest": rest, "lcp": lcp, "owners": owners[lo : lo + BLOCK].tobytes()}])


def _spans(found: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Decided spans (k1, k2, s, e), merged within each text."""
    if not found:
        return
    x = np.array(sorted(found), np.int64)
    same = (x[1:, 0] == x[:-1, 0]) & (x[1:, 1] == x[:-1, 1])
    out, (k1, k2, s, e) = [], x[0].tolist()
    for row, joined in zip(x[1:].tolist(), same.tolist(), strict=True):
        if joined and row[2] <= e:
            e = max(e, row[3])
        else:
            out.append((k1, k2, s, e))
            k1, k2, s, e = row
    out.append((k1, k2, s, e))
    for lo in range(0, len(out), 5000):
        k1, k2, s, e = zip(*out[lo : lo + 5000], strict=True)
        n = len(k1)
        empty = [pa.nulls(n, _RUN_SCHEMA.field(c).type) for c in ("run", "seq", "first", "rest", "lcp", "owners")]
        yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), *empty, pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], schema=_RUN_SCHEMA)


def _run_maker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the candidate anchors of each text, as sorted runs."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 20
    held: list[tuple[bytes, int, int, int, int, int]] = []

    def flush():
        held.sort()
        strings, owners, decided, i = [], [], [], 0
        while i < len(held):
            s, k1, k2, a, ll, rl = held[i]
            j = i + 1
            while j < len(held) and held[j][0] == s:
                j += 1
            if j - i > 1:
                decided += [(x[1], x[2], x[3] - ll, x[3] + rl) for x in held[i:j]]
            strings.append(s)
            owners.append((k1, k2, a, ll, rl, j - i > 1, 0, 1, 0, 1, 0))
            i = j
        yield from _spans(decided)
        yield from _blocks(number, strings, np.array(owners, OWNER))

    for batch in (part for whole in batches for part in slices(whole, 2)):
        k1s, k2s, wanted = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for k1, k2, grams, text in zip(k1s, k2s, wanted, batch.column(2), strict=True):
            text = text.as_py().encode()
            at, first, last, _ = window_anchors(np.frombuffer(text, np.uint8), LENGTH)
            use = np.isin(at, np.array(grams, np.int64))
            for a, l, r in zip(at[use].tolist(), first[use].tolist(), last[use].tolist(), strict=True):
                s, ll, rl = context(text, a, l, r)
                held.append((s, k1, k2, a, ll, rl))
            if len(held) >= RUN:
                yield from flush()
                held, number = [], number + 1
    if held:
        yield from flush()


def _merge_group(table: pa.Table) -> Iterator[tuple[int, bytes, list]]:
    """(common prefix with the string before, string, owners) of the distinct strings of a range."""
    table = table.sort_by([("run", "ascending"), ("seq", "ascending")])
    run, rest, lcp, owners = (table[c].to_pylist() for c in ("run", "rest", "lcp", "owners"))
    by_run: dict[int, list[int]] = {}
    for i, r in enumerate(run):
        by_run.setdefault(r, []).append(i)

    def stream(parts: list[int]):
        before = None
        for i in parts:
            own = np.frombuffer(owners[i], OWNER).tolist()
            for k, (n, s) in enumerate(decode(rest[i], lcp[i])):
                yield (n if k or before is None else shared(before, s)), s, own[k]
                before = s

    current, group, start = None, [], 0
    for n, s, own in merge_runs([stream(p) for p in by_run.values()]):
        if current is not None and n >= WIDTH:
            group.append(own)
            continue
        if current is not None:
            yield start, current, group
        current, group, start = s, [own], n
    if current is not None:
        yield start, current, group


def _limits(n: int, x: bytes, y: bytes, ox: tuple, oy: tuple) -> tuple[int, int]:
    """Match to the left and right of the anchors of two strings that share n bytes."""
    right = min(n, ox[4], oy[4], LENGTH)
    left = min(n - LENGTH if n >= LENGTH else shared(x[LENGTH:], y[LENGTH:]), ox[3], oy[3])
    return left, right


def _right_merger(key: tuple, table: pa.Table) -> pa.Table:
    """First merge: decide what neighbours decide, and write the strings left side first."""
    below, above = _edges(table)
    items = list(_merge_group(table))
    decided, out = [], []
    for i, (n, s, group) in enumerate(items):
        own = group[0]
        multi = len(group) > 1 or bool(own[5])
        if len(group) > 1:
            decided += [(o[0], o[1], o[2] - o[3], o[2] + o[4]) for o in group if not o[5]]
        most, fits = (own[4] if below and i == 0 or above and i == len(items) - 1 else 0), [(1, 0), (1, 0)]
        for side, j in enumerate((i - 1, i + 1)):
            if 0 <= j < len(items):
                left, right = _limits(n if j < i else items[j][0], s, items[j][1], own, items[j][2][0])
                most = max(most, right)
                if left + right >= LENGTH:
                    fits[side] = (LENGTH - right, left)
                    if not multi:
                        decided.append((own[0], own[1], own[2] - left, own[2] + right))
        out.append((left_first(s), (*own[:5], multi, most, *fits[0], *fits[1])))
    out.sort(key=lambda x: x[0])
    run = key[0].as_py() if hasattr(key[0], "as_py") else int(key[0])
    batches = [*_spans(decided), *_blocks(run, [x for x, _ in out], np.array([o for _, o in out], OWNER))]
    give_back()
    return pa.Table.from_batches(batches, _RUN_SCHEMA)


def _mask(lo: int, hi: int) -> int:
    return ((1 << hi + 1) - 1) >> lo << lo if hi >= lo else 0


def _left_merger(key: tuple, table: pa.Table) -> pa.Table:
    """Second merge: spans decided by neighbours (kind 1) and open windows (kind 2, hash in first)."""
    below, above = _edges(table)
    items = list(_merge_group(table))
    decided, masks, opens = [], [], []
    for i, (n, s, group) in enumerate(items):
        own = group[0]
        most, done = (own[3] if below and i == 0 or above and i == len(items) - 1 else 0), _mask(own[7], own[8]) | _mask(own[9], own[10])
        for j in (i - 1, i + 1):
            if 0 <= j < len(items):
                other, m = items[j], n if j < i else items[j][0]
                if m < GRAM:
                    continue
                left = min(m - GRAM, LEFT, own[3], other[2][0][3])
                right = min(GRAM + shared(s[LENGTH:], other[1][LENGTH:]), own[4], other[2][0][4])
                most = max(most, left)
                if left + right >= LENGTH:
                    done |= _mask(LENGTH - right, left)
                    if not own[5]:
                        decided.append((own[0], own[1], own[2] - left, own[2] + right))
        reach = _mask(LENGTH - own[6], min(own[3], most))
        masks.append(reach)
        opens.append(0 if own[5] else reach & ~done)
    rows, i = [], 0
    while i < len(items):
        j = i + 1
        while j < len(items) and items[j][0] >= GRAM:
            j += 1
        edge = below and i == 0 or above and j == len(items)  # the gram goes on in the next range
        wanted = -1 if edge else 0
        for m in opens[i:j] if not edge else ():
            wanted |= m
        for (_, s, group), reach, open_ in zip(items[i:j], masks[i:j], opens[i:j], strict=True):
            own, left = group[0], s[GRAM:LENGTH]
            right = s[:GRAM] + s[LENGTH:]
            m = reach & wanted
            while m:
                o = (m & -m).bit_length() - 1
                m &= m - 1
                window = left[:o][::-1] + right[: LENGTH - o]
                # Decided windows only count as partners of open ones.
                rows.append((hashlib.blake2b(window, digest_size=16).digest(), own[0] if open_ >> o & 1 else None, own[1], own[2] - o))
        i = j
    batches = list(_spans(decided))
    for lo in range(0, len(rows), 5000):
        h, k1, k2, s = zip(*rows[lo : lo + 5000], strict=True)
        n = len(h)
        no = lambda c: pa.nulls(n, _RUN_SCHEMA.field(c).type)
        cols = {"kind": pa.array([2] * n, pa.int32()), "first": pa.array(h, pa.binary()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "s": pa.array(s, pa.int32())}
        batches.append(pa.RecordBatch.from_arrays([cols.get(c, no(c)) for c in _RUN_FIELDS], schema=_RUN_SCHEMA))
    return pa.Table.from_batches(batches, _RUN_SCHEMA)


_CUT = pa.schema([("range", pa.int64()), ("edge", pa.int32()), ("run", pa.int64()), ("seq", pa.int32()), ("n", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("rest", pa.binary()), ("lcp", pa.binary()), ("owners", pa.binary())])
CUT = "range long, edge int, run long, seq int, n int, first binary, last binary, rest binary, lcp binary, owners binary"


def _edges(table: pa.Table) -> tuple[bool, bool]:
    """Whether the first and the last gram of a range go on in its neighbours."""
    edge = table["edge"][0].as_py()
    return bool(edge & 1), bool(edge & 2)


def _edge(lower: bytes | None, upper: bytes | None) -> int:
    """A splitter of a whole string lies inside a gram; one of a gram's length does not."""
    return (lower is not None and len(lower) > GRAM) | (upper is not None and len(upper) > GRAM) << 1


def _cutter(bounds: list[bytes] | None = None):
    """Deal the blocks of the runs into the ranges between the bounds.

    Without ``bounds`` each row brings those inside it (``inner``), the one before and after
    them (``lower``, ``upper``), and the number of its first range (``range``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                r = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                inner, base = (bounds, 0) if bounds is not None else (r["inner"], r["range"])
                lower, upper = (None, None) if bounds is not None else (r["lower"], r["upper"])
                own = np.frombuffer(r["owners"], OWNER)
                strings = [s for _, s in decode(r["rest"], r["lcp"])]
                lo = 0
                while lo < len(strings):
                    place = bisect_right(inner, strings[lo])
                    hi = len(strings) if place == len(inner) else lo + bisect_right(_Less(strings, lo, inner[place]), False)
                    rest, lcp = front_code(strings[lo:hi])
                    edge = _edge(inner[place - 1] if place else lower, inner[place] if place < len(inner) else upper)
                    rows.append({"range": base + place, "edge": edge, "run": r["run"], "seq": r["seq"] + lo, "n": hi - lo, "first": strings[lo], "last": strings[hi - 1], "rest": rest, "lcp": lcp, "owners": own[lo:hi].tobytes()})
                    lo, held = hi, held + len(rest)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_CUT)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_CUT)

    return tidy(run)


class _Less:
    """False for the strings from ``lo`` on that lie below a bound, True for the rest."""

    def __init__(self, strings: list[bytes], lo: int, bound: bytes):
        self.strings, self.lo, self.bound = strings, lo, bound

    def __len__(self) -> int:
        return len(self.strings) - self.lo

    def __getitem__(self, i: int) -> bool:
        return self.strings[self.lo + i] >= self.bound


def split_points(keys: list[bytes], ranges: int) -> list[bytes]:
    """At most ``ranges - 1`` splitters from sorted sample keys: grams, or whole strings inside a gram that comes again."""
    out: list[bytes] = []
    for i in range(1, ranges):
        key = keys[len(keys) * i // ranges]
        new = key if out and out[-1][:GRAM] == key[:GRAM] else key[:GRAM]
        if not out or new > out[-1]:
            out.append(new)
    return out


def _fine_ranges(coarse: DataFrame) -> DataFrame:
    """Rows cut again at splitters that each coarse range draws from its own blocks."""
    share = F.least(F.lit(1.0), F.lit(SAMPLE) / F.col("blocks"))
    # At most COARSE rows: a bounded broadcast.
    sizes = coarse.groupBy("range").agg(F.sum("n").alias("strings"), F.count(F.lit(1)).alias("blocks")).select("range", F.ceil(F.col("strings") / RANGE).cast("int").alias("parts"), share.alias("share"))
    draw = F.pmod(F.xxhash64("first", "run", "seq"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    keys = coarse.join(F.broadcast(sizes), "range").where(draw).groupBy("range").agg(F.sort_array(F.collect_list("first")).alias("keys"), F.first("parts").alias("parts"))

    @F.udf("array<binary>")
    def points(keys: list, parts: int) -> list:
        return split_points([bytes(k) for k in keys], min(parts, COARSE)) if keys else []

    bounds = materialize(keys.select("range", points("keys", "parts").alias("bounds")), "splitters")
    met = coarse.join(bounds, "range", "left").withColumn("bounds", F.coalesce("bounds", F.array().cast("array<binary>")))
    under = lambda c: F.size(F.filter("bounds", lambda b: b <= F.col(c)))
    lo, hi = F.col("_lo"), F.col("_hi")
    met = met.withColumns({"_lo": under("first"), "_hi": under("last")})
    outer = lambda i, bit: F.coalesce(F.get("bounds", i), F.when(F.col("edge").bitwiseAND(F.lit(bit)) > 0, F.col("first")))
    return met.select(
        (F.col("range") * COARSE + lo).alias("range"), F.when(hi > lo, F.slice("bounds", lo + 1, hi - lo)).otherwise(F.array().cast("array<binary>")).alias("inner"),
        F.when(lo > 0, F.get("bounds", lo - 1)).otherwise(F.when(F.col("edge").bitwiseAND(F.lit(1)) > 0, F.col("first"))).alias("lower"), outer(hi, 2).alias("upper"), "run", "seq", "rest", "lcp", "owners",
    )


def _merge_sort(runs: DataFrame, merger, path: str) -> DataFrame:
    """Exchange the front-coded runs by sampled splitters and merge each range."""
    blocks = runs.where("kind = 0")
    n = blocks.count()
    draw = F.pmod(F.xxhash64("first", "run"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))
    # A sample of about SAMPLE keys of bounded length.
    keys = sorted(bytes(r["first"]) for r in blocks.where(draw).select("first").collect())
    ranges = max(1, -(-n * BLOCK // RANGE))
    bounds = split_points(keys, min(ranges, COARSE)) if keys else []
    dealt = blocks.select("run", "seq", "rest", "lcp", "owners").mapInArrow(_cutter(bounds), CUT)
    if ranges > COARSE:
        coarse = materialize(dealt, "coarse-ranges")
        dealt = _fine_ranges(coarse).mapInArrow(_cutter(), CUT)
    return materialize(dealt.select("range", "edge", "run", "seq", "rest", "lcp", "owners").groupBy("range").applyInArrow(merger, RUNS), "merged", path)


# --- the operator ------------------------------------------------------------------------


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    for batch in (part for whole in batches for part in slices(whole, 2)):
        out, keys = [], ([], [])
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (k1, k2) in seen:  # a copy within the task adds nothing
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.add((k1, k2))
            at, _, _, grams = window_anchors(np.frombuffer(text.as_py().encode(), np.uint8), LENGTH)
            if len(at):
                out.append(np.stack([grams.view(np.int64), at]))
                keys[0].append(np.full(len(at), k1))
                keys[1].append(np.full(len(at), k2))
        if out:
            both = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(np.concatenate(keys[0])), pa.array(np.concatenate(keys[1])), pa.array(both[1].astype(np.int32))], names=["gram", "k1", "k2", "a"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k1, k2, copies, spans: what to remove from each distinct text that has repeats."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    keyed = docs.select(*text_key(), text, F.col("doc_id").cast("long").alias("doc_id"))
    slim = materialize(keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep")), "texts")
    anchors = materialize(keyed.select("k1", "k2", "text").mapInArrow(tidy(_anchor_rows), "gram long, k1 long, k2 long, a int"), "anchors")
    common = materialize(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    wanted = anchors.join(common, "gram").groupBy("k1", "k2").agg(F.collect_set("a").alias("at"))
    lists = wanted.join(slim.select("k1", "k2", "rep"), ["k1", "k2"])
    texts = keyed.join(lists, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("k1", "k2", "text", "at")
    paths = [table_path(spark, "suffix-runs") for _ in range(3)]
    runs = materialize(texts.mapInArrow(tidy(_run_maker), RUNS), "runs", paths[0])
    right = _merge_sort(runs, _right_merger, paths[1])
    spans = [materialize(runs.where("kind = 1").select("k1", "k2", "s", "e"), "spans")]
    remove(spark, paths[0])
    left = _merge_sort(right, _left_merger, paths[2])
    spans.append(materialize(right.where("kind = 1").select("k1", "k2", "s", "e"), "spans"))
    remove(spark, paths[1])
    spans.append(left.where("kind = 1").select("k1", "k2", "s", "e"))
    open_ = left.where("kind = 2").select(F.col("first").alias("window"), "k1", "k2", "s")
    twice = open_.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    spans.append(open_.where("k1 is not null").join(twice, "window", "left_semi").select("k1", "k2", "s", (F.col("s") + LENGTH).cast("int").alias("e")))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    per_text = every.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    copied = slim.where("copies > 1").select("k1", "k2", "copies")
    return materialize(per_text.join(copied, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "spans"), "repeats")


def covered(n: int, copies: int, spans: list | None) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of n bytes."""
    if copies > 1:
        return [(0, n)] if n >= LENGTH else []
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def whole_characters(text: bytes, s: int, e: int) -> tuple[int, int]:
    """The span without the UTF-8 characters that it would cut."""
    while s < e and text[s] & 0xC0 == 0x80:
        s += 1
    while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
        e -= 1
    return s, e


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(docs: DataFrame, characters: bool = True) -> DataFrame:
    """All columns of ``docs`` with the text cut, and n_bytes, n_removed, n_spans, kept_sha256.

    With ``characters`` spans are shrunk to whole characters; otherwise the counts and the
    digest hold for bytes, and the text has replacement signs where a character is cut.
    """
    docs = docs.drop(*ADDED)
    names, place, width = docs.columns, docs.columns.index("text"), len(docs.columns)
    safe = docs.toDF(*[c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(names)])
    joined = safe.select("*", *text_key()).join(repeated_spans(safe), ["k1", "k2"], "left")
    plain = joined.select(*safe.columns, "copies", "spans")
    schema = T.StructType([*[f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields], *[T.StructField(c, T.LongType()) for c in ADDED[:3]], T.StructField(ADDED[3], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole.set_column(place, whole.schema.names[place], whole.column(place).cast(pa.string())), place)):
            kept, size, gone, count, digest = [], [], [], [], []
            for text, copies, spans in zip(batch.column(place), batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                text = text.as_py()
                raw = (text or "").encode()
                cuts = covered(len(raw), copies or 1, spans)
                if characters:
                    cuts = [c for c in (whole_characters(raw, *x) for x in cuts) if c[0] < c[1]]
                left, at = [], 0
                for s, e in cuts:
                    left.append(raw[at:s])
                    at = e
                rest = b"".join([*left, raw[at:]]) if cuts else raw
                kept.append(text if not cuts else rest.decode("utf-8", "replace"))
                size.append(len(raw))
                gone.append(sum(e - s for s, e in cuts))
                count.append(len(cuts))
                digest.append(hashlib.sha256(rest).hexdigest())
            columns = [pa.array(kept, pa.string()) if i == place else c for i, c in enumerate(batch.columns[:width])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=[f.name for f in schema.fields])

    return plain.mapInArrow(tidy(run), schema)


def suffix_digest(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut_repeats(rows, characters=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def suffix_sql(length: int = LENGTH) -> str:
    """The same rows in DuckDB SQL, from every string of the length (as hex digits, two a byte)."""
    return f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, {2 * length})) as m from (select doc_id, h, unnest(range(0, length(h) // 2 - {length - 1})) as i from d where length(h) >= {2 * length})),
twice as (select doc_id, i from (select *, count(*) over (partition by m) as c from w) where c > 1),
runs as (select *, sum(fresh::int) over (partition by doc_id order by i) as run from (select *, coalesce(i - lag(i) over (partition by doc_id order by i) > {length}, true) as fresh from twice)),
cut as (select doc_id, run, min(i) as a, max(i) + {length} as b from runs group by 1, 2),
kept as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from cut union all select doc_id, max(b), 1099511627776::bigint from cut group by 1),
rest as (select k.doc_id, string_agg(substr(d.h, 2 * k.a + 1, 2 * (least(k.b, length(d.h) // 2) - k.a)), '' order by k.a) as h from kept k join d on d.doc_id = k.doc_id group by 1),
sums as (select doc_id, sum(b - a)::bigint as gone, count(*) as n from cut group by 1)
select d.doc_id, length(d.h) // 2 as n_bytes, coalesce(s.gone, 0) as n_removed, coalesce(s.n, 0) as n_spans, sha256(unhex(case when s.n is null then d.h else r.h end)) as kept_sha256
from d left join sums s on s.doc_id = d.doc_id left join rest r on r.doc_id = d.doc_id
"""
