import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import embed_dedup, minhash, mixing, packing, queries, sharding, suffix_dedup, token_counts, token_files, topk_search, toxicity, windows
from tessera.llm.components import components
from tessera.llm.encoders import encoder, public_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, k1 int, rid string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeéü", k=rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " \n ", "one", "One", "two words", "x" * 900, "ab " * 400, passage, passage]
    for i in range(60):
        body = [word() for _ in range(rng.randint(1, 300))]
        if i % 5 == 0:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        out.append(" ".join(body))
        if i % 7 == 0:
            changed = list(body)
            changed[rng.randrange(len(changed))] = "zzz"
            out += [" ".join(changed), " ".join(body)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else "s0", len(t or ""), "s", "h", 1, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id here", None, None, None, None, None, None, None)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sets_of(texts, k):
    out = []
    for t in texts:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def classes(n, linked):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_minhash(docs, texts, empty):
    s = sets_of(texts, 3)
    want = classes(len(s), lambda i, j: bool(s[i] and s[j]) and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 3, 85, 100).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(s))] == [(len(s[i]), want[i], want[i] == i) for i in range(len(s))]
    assert got[None].kept and got[None].component_id is None
    assert minhash.near_duplicates(empty, 3, 85, 100).count() == 0


def test_minhash_large_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = f"v{rng.randrange(9)}"
        texts.append(" ".join(t))
    s = sets_of(texts, 3)
    want = classes(len(s), lambda i, j: 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85, 100).collect()}
    assert [got[i] for i in range(60)] == want


def suffix_want(raw):
    count = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        cut = bytearray(len(b))
        for j in range(len(b) - 199):
            if count[b[j : j + 200]] > 1:
                cut[j : j + 200] = b"\1" * 200
        kept = bytes(c for c, x in zip(b, cut) if not x)
        spans = sum(x and not (j and cut[j - 1]) for j, x in enumerate(cut))
        out.append((len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, texts, empty):
    raw = [(t or "").encode() for t in texts] + [b"no id here"]
    got = {r.doc_id: r for r in suffix_dedup.suffix_digest(docs).collect()}
    for i, want in enumerate(suffix_want(raw)[:-1]):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    assert suffix_dedup.suffix_digest(empty).count() == 0
    clash = docs.withColumnsRenamed({"k1": "copies", "rid": "spans", "shard": "k2", "score": "n_spans"})
    cut = suffix_dedup.cut_repeats(clash)
    assert set(cut.columns) == set(clash.columns) | set(suffix_dedup.ADDED)
    assert {(r.copies, r.spans, r.k2) for r in cut.collect()} == {(1, "r", "h"), (None, None, None)}


def test_suffix_dedup_many_ranges(spark, monkeypatch):
    """Two levels of splitters, ranges inside one frequent gram, and texts of several pieces."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(1, 7)))
    line = " ".join(word() for _ in range(12))
    shared = [" ".join(word() for _ in range(80)) for _ in range(6)]
    texts = []
    for i in range(150):
        parts = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts)), line)
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts)), rng.choice(shared)[rng.randint(0, 60) :])
        texts.append(" ".join(parts))
    texts += ["a" * 3000, "b" + "a" * 900, line * 9]
    for module, name, value in ((suffix_dedup, "RUN", 60), (suffix_dedup, "BLOCK", 6), (suffix_dedup, "RANGE", 10), (suffix_dedup, "COARSE", 4), (windows, "PIECE", 700)):
        monkeypatch.setattr(module, name, value)
    want = suffix_want([t.encode() for t in texts])
    got = {r.doc_id: r for r in suffix_dedup.suffix_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 5000


def test_merge_of_runs():
    rng = random.Random(2)
    strings = sorted({bytes(rng.choices(b"ab", k=suffix_dedup.WIDTH)) for _ in range(300)} | {b"a" * suffix_dedup.WIDTH})
    runs = [sorted(rng.sample(strings, 90)) for _ in range(5)]
    parts = []
    for run in runs:
        rest, lcp = suffix_dedup.front_code(run)
        parts.append((n, s, None) for n, s in suffix_dedup.decode(rest, lcp))
    merged = list(suffix_dedup.merge_runs(parts))
    assert [s for _, s, _ in merged] == sorted(s for run in runs for s in run)
    for (_, x, _), (n, y, _) in zip(merged, merged[1:]):
        assert n == suffix_dedup.shared(x, y)


def test_packing(docs, texts, empty):
    path = public_path("word_bpe_49k.json")
    tok = encoder(path, "word")
    rows = [r for r in packing.pack_digest(docs, path).collect() if r.doc_id is not None]
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in packing.pack_digest(docs, path).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
    for r in rows:
        pieces[r.doc_id].append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t in enumerate(texts):
        ids = [*tok.direct(t or "").tolist(), 1]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert packing.pack_digest(empty, path).count() == 0
    lengths = np.array([5, 9, 3, 7, 2, 9])
    bins, _ = packing.first_fit_decreasing(lengths, 10)
    open_, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, room in enumerate(open_) if room >= lengths[i]), len(open_))
        open_ += [10] if b == len(open_) else []
        open_[b] -= lengths[i]
        want[int(i)] = b
    assert [want[i] for i in range(6)] == bins.tolist()


def test_token_files(docs, texts, empty):
    path = public_path("byte_bpe_50k.json")
    tok = encoder(path, "byte")
    got = {r.doc_id: r for r in token_files.token_digest(docs, path).collect()}
    start = len(tok.direct("no id here")) + 1  # the null id comes first
    for i, t in enumerate(texts):
        ids = np.array([*tok.direct(t or "").tolist(), 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_digest(empty, path).count() == 0
    values = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    assert token_files.unpack_values(*token_files.pack_values(values), len(values)).tolist() == values.tolist()


@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_encoders_equal_the_library(kind, name):
    rng = random.Random(4)
    tok = encoder(public_path(name), kind)
    texts = ["", " a", "a  b", "it's DON'T", "x\ty\x1cz", "ΑΣ Σ İ", "éa", "a b", "<|endoftext|>", "日本語 テ", "␞ a␞."]
    texts += ["".join(rng.choices(" \n\tab.,'1é́ \x1c²␞", k=rng.randint(0, 12))) for _ in range(3000)]
    for t, ids in zip(texts, tok.texts(pa.array(texts))):
        assert ids.tolist() == tok.direct(t).tolist(), t


def test_token_counts(docs, texts, empty):
    path = public_path("piece_bpe_32k.model")
    vocabulary = set(token_counts.piece_vocabulary(path))
    longest = max(map(len, vocabulary))

    def greedy(w):
        n = i = 0
        while i < len(w):
            j = next((j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in vocabulary), None)
            if j is None:
                return 1
            i, n = j, n + 1
        return n

    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_tokens) == (len((t or "").split()), sum(greedy("▁" + w) for w in (t or "").split()))
    assert token_counts.count_tokens(empty, path).count() == 0
    machine = token_counts.LongestMatch(["a", "ab", "abcd", "bc", "c"])
    assert [machine.count(w) for w in ("", "abc", "abcd", "abcab", "d", "abd")] == [0, 2, 1, 3, 1, 1]


def test_mixing(docs, empty, spark, tmp_path):
    clash = mixing.mix(docs.withColumnsRenamed({"score": "cdf", "shard": "draws", "k1": "_source", "rid": "_c1"}))
    assert {"cdf", "draws", "_source", "_c1"} < set(clash.columns) and {(r["_source"], r.cdf) for r in clash.collect()} <= {(1, "s"), (None, None)}
    out = mixing.mix(docs.drop("score", "shard", "k1", "rid"))
    docs.drop("score", "shard", "k1", "rid").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    found = con.execute(mixing.mixing_sql())
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(out.columns)
    assert sorted(repr([r[c] for c in cols]) for r in out.collect()) == sorted(repr(list(r)) for r in found.fetchall())
    assert mixing.mix(empty).count() == 0
    many = spark.range(2000).selectExpr("id as doc_id", "'x' as text", "if(id < 1900, 'big', 'small') as source")
    counts = {r.source: r["count"] for r in mixing.mix(many, weights={"big": 1, "small": 1}).groupBy("source").count().collect()}
    assert abs(counts["small"] - 1000) < 200 and abs(counts["big"] - 1000) < 150


def test_sharding_keeps_equal_texts_together(spark, monkeypatch):
    """A hot text, ties of ids, and ranges that are subdivided: still the order of text and id."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 5)
    monkeypatch.setattr(sharding, "RANGES", 3)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 40}") for i in range(300)] + [(7, "hot"), (7, "hot"), (None, "hot")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, _h int, _k int, size int")
    out = sharding.shard_documents(docs, 4).collect()
    assert len(out) == len(rows) and {(r["_h"], r["_k"]) for r in out} == {(1, 2)}
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    runs = [t for t, before in zip([r.text for r in order], [None, *[r.text for r in order]]) if t != before]
    assert len(runs) == len(set(runs))
    hot = [r.doc_id if r.doc_id is not None else -1 for r in order if r.text == "hot"]
    assert hot == sorted(hot)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 20


def test_sharding(docs, texts, empty):
    rows = sharding.shard_documents(docs, 16).collect()
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert r["size"] == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(texts) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    assert sharding.shard_documents(empty, 16).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        body = ["w%d" % rng.randrange(200) for _ in range(60)]
        for _ in range(3 if bad else 0):
            body[rng.randrange(60)] = rng.choice(["Scum,", "idiotic", "idiots"])
        rows.append((i, " ".join(body), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(10_001, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_digest(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i, _, _ in rows)
    assert sum(got[i].predicted == rows[i][2] for i in held) >= 0.97 * len(held)
    assert 0 <= got[10_001].score <= 1 and None in got
    assert toxicity.toxicity_digest(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_digest(docs, labels.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("law", ["either", "both"])
def test_toxicity_of_pairs(spark, law):
    """Terms that decide the label only together: no weight alone tells anything (either) or enough (both)."""
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        body = ["w%d" % min(rng.randrange(300), rng.randrange(300)) for _ in range(50)]
        if insult:
            body[rng.randrange(25)] = "scum"
        if group:
            body[25 + rng.randrange(25)] = "northerners"
        rows.append((i, " ".join(body), int(insult != group if law == "either" else insult and group)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]

    def right(m):
        buf = np.frombuffer("".join(t for _, t, _ in held).encode(), np.uint8)
        off = np.cumsum([0, *(len(t) for _, t, _ in held)])
        return np.mean((m.score(buf, off) >= 0.5) == np.array([y for *_, y in held], bool))

    plain = toxicity.Machine(machine.bias, machine.weights, np.zeros_like(machine.factors))
    assert right(machine) >= 0.98
    assert right(machine) >= right(plain) + 0.1


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "scum %d" % i if i % 2 else "fine %d" % i) for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic")
    few = toxicity.train(docs, labels, sample_bytes=4000)
    assert few.weights is not None and toxicity.train(docs, labels, sample_rows=0).bias == 0.0


def vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(200):
        v = base[i % 30] + rng.normal(size=16) * 0.08 * (i % 3)
        rows.append((i, [float(np.float32(x)) for x in v], i % 30 % 4))
    rows += [(200, rows[0][1], 0), (201, None, 1), (202, [0.0] * 16, 1), (203, [1.0, None], 1), (204, [float("nan")] * 16, 1), (205, rows[1][1], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def test_embed_dedup(spark):
    df, rows = vectors(spark)
    ok = [bool(v and None not in v and np.isfinite(v).all() and any(v)) and y is not None for _, v, y in rows]
    x = [np.array(v, np.float64) / np.linalg.norm(v) if k else None for (_, v, _), k in zip(rows, ok)]
    linked = lambda i, j: ok[i] and ok[j] and rows[i][2] == rows[j][2] and x[i] @ x[j] >= 0.98
    want = classes(len(rows), linked)
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(rows))] == [(sum(linked(i, j) for j in range(len(rows)) if i != j), want[i]) for i in range(len(rows))]
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_embed_recall_and_bounds(spark, monkeypatch):
    """Planted pairs just at and above the threshold are all found; pairs below are none; codes drop most others."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    rng = np.random.default_rng(11)
    n, dim = 1200, 64
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(n, dim))
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = np.repeat([0.9, 0.97, 0.9799, 0.9801, 0.985, 0.995], n // 6)[:, None]
    y = cos * x + np.sqrt(1 - cos**2) * off
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    got = {r.vec_id: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i].n_links for i in range(n)] == (cos[:, 0] >= 0.98).astype(int).tolist()
    assert all(got[n + i].component_id == (i if cos[i, 0] >= 0.98 else n + i) for i in range(n))
    table = pa.Table.from_batches(list(embed_dedup._coder(iter([pa.record_batch([pa.array([r[0] for r in rows]), pa.array([1] * 2 * n), pa.array([r[1] for r in rows]), pa.array([1] * 2 * n)], names=["rid", "label", "embedding", "copies"])]))))
    codes = embed_dedup._codes(table)
    left, right = np.arange(n), np.arange(n, 2 * n)
    open_, estimate = np.diag(codes.open(left, right, 0.98)), np.diag(codes.estimates(left, right))
    assert open_[cos[:, 0] >= 0.98].all() and not open_[cos[:, 0] == 0.9].any()
    assert abs((estimate - cos[:, 0]).mean()) < 0.002  # unbiased


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk_search, "TILE_ROWS", 2)
    monkeypatch.setattr(topk_search, "SAMPLE", 30)
    df, rows = vectors(spark)
    df = df.unionByName(df.where("vec_id in (7, 8, 50)"))  # repeated rows
    rows = rows + [r for r in rows if r[0] in (7, 8, 50)]
    q = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    want = []
    for i, x in {i: x for i, x in q if i % 50 == 0}.items():
        best = sorted((-int(x @ y), j) for j, y in q if j != i)[:5]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in topk_search.top_k(df).collect()) == sorted(want)
    assert topk_search.top_k(df.limit(0)).count() == 0
    assert topk_search.top_k(df.limit(3)).count() <= 10


def test_impact_index_stops_on_proof():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(3000, 32)) / 6).astype(np.int64)
    index = topk_search.ImpactIndex(x)
    read = 0
    for i, rows, score in index.search(x[:20], np.eye(20, 3000, dtype=bool), np.full(20, -np.inf), 5):
        exact = x @ x[i]
        exact[i] = -(1 << 60)
        assert set(np.sort(exact)[-5:]) <= set(score.tolist()) and (score == (x @ x[i])[rows]).all()
        read += len(rows)
    assert read < 0.2 * 20 * 3000


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 0, i % 9 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) toxic").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL)))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in found.fetchall())


def test_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
