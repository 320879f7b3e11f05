"""Every operator and stage on awkward tables, and the stages against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import embed_dedup, minhash, mixing, packing, sharding, stages, suffix_dedup, token_counts, token_files, topk_search, toxicity, windows
from tessera.llm.encoders import public_path

from test_operators import classes, sets_of, suffix_want  # noqa: I001

#: Names that operators use inside, each as an extra column of the input.
CLASH = (
    "rid known side pivot part grp regs set_key k1 k2 copies spans gram at range first rest owners cdf draws rate_ _source _c0 _c1 copy_ _h _k _range _step _part _row size_ "
    "toxic terms deal ids length_ start_ shard_ segment local base doc_tokens_ ids_crc32_ n_words_ label other links"
).split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)


def awkward_texts():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdeéü", k=rng.randint(1, 7)))
    long = " ".join(word() for _ in range(60_000))
    some = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(25)]
    odd = [None, "", " ", "\t\n ", "one", "tie tie tie", "tie tie tie", "<|endoftext|> and <|startoftext|>x", "hello <|endoftext|> world", "x" * 5000, "日本語 テスト ࠀ", "a b c"]
    return [*odd, long, long[:200_000], *some, *some[:3]]


@pytest.fixture(scope="module")
def awkward(spark):
    texts = awkward_texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    # Repeated rows, one id with two texts, and null ids that repeat.
    rows += [(3, texts[3]), (20, texts[20]), (20, texts[20]), (21, "another text of this id"), (None, "no id"), (None, "no id"), (None, None)]
    full = [(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), *[7] * len(CLASH)) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3), rows


def plain(rows):
    """Rows whose id comes once."""
    n = Counter(i for i, _ in rows)
    return {i: t for i, t in rows if i is not None and n[i] == 1}


def key(i):
    return (i is not None, i or 0)


def test_token_counts(awkward):
    docs, rows = awkward
    got = token_counts.count_tokens(docs, public_path("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len((t or "").split())) for i, t in rows)


def test_suffix_dedup(awkward):
    docs, rows = awkward
    got = suffix_dedup.suffix_digest(docs).collect()
    want = suffix_want([(t or "").encode() for _, t in rows])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    cut = suffix_dedup.cut_repeats(docs)
    kept = [c for c in docs.columns if c not in suffix_dedup.ADDED]
    assert cut.columns == [*kept, *suffix_dedup.ADDED] and {r.k1 for r in cut.select("k1").collect()} == {7}


def test_anchors_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = windows.window_anchors(buf, 200)
    monkeypatch.setattr(windows, "PIECE", 333)
    pieces = windows.window_anchors(buf, 200)
    spread = lambda w: {s: a for a, lo, hi in zip(*map(np.ndarray.tolist, w[:3]), strict=True) for s in range(lo, hi + 1)}
    assert spread(whole) == spread(pieces) and len(spread(whole)) == 5000 - 199


def test_mixing(awkward, spark):
    docs, rows = awkward
    out = mixing.mix(docs)
    assert set(docs.columns) - {"copies"} <= set(out.columns)
    counts = Counter(f"s{(i or 0) % 3}" if i != 5 else None for i, _ in rows)
    total = sum(round(math.sqrt(n), 6) for n in counts.values())
    want = Counter()
    for i, _ in rows:
        source = f"s{(i or 0) % 3}" if i != 5 else None
        rate = round(round(math.sqrt(counts[source]), 6) / total * len(rows) / counts[source], 9)
        u = int(hashlib.md5(f"mix-1-{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want[i] += k
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == +want


@pytest.mark.parametrize("partitions", [4, 200])
def test_packing(awkward, spark, partitions):
    docs, rows = awkward
    path = public_path("word_bpe_49k.json")
    plainly = Tokenizer.from_file(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = packing.pack_digest(docs, path).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = Counter()
    tokens = 0
    for i, t in rows:
        ids = [*plainly.encode(t or "", add_special_tokens=False).ids, 1]
        tokens += len(ids)
        for a in range(0, len(ids), 2048):
            want[i, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert len(sequences) <= math.ceil(tokens / 2048 * 1.02) + 1


def test_token_files(awkward):
    docs, rows = awkward
    path = public_path("byte_bpe_50k.json")
    plainly = Tokenizer.from_file(path)
    made = lambda t: np.array([*plainly.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    got = token_files.token_digest(docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(made(t)), zlib.crc32(made(t).tobytes())) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [key(r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_minhash(awkward):
    docs, rows = awkward
    got = minhash.near_duplicates(docs, 3, 85, 100).collect()
    assert len(got) == len(rows)
    own = [(i, t) for i, t in rows if i is not None]
    s = sets_of([t for _, t in own], 3)
    group = classes(len(s), lambda a, b: own[a][0] == own[b][0] or bool(s[a] and s[b]) and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]))
    least = defaultdict(lambda: 1 << 60)
    for (i, _), g in zip(own, group, strict=True):
        least[g] = min(least[g], i)
    for (i, _), g, x in zip(own, group, s, strict=True):
        rows_of = [r for r in got if r.doc_id == i]
        assert all(r.component_id == least[g] and r.kept == (i == least[g]) for r in rows_of) and len(x) in {r.n_shingles for r in rows_of}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_sharding(awkward):
    docs, rows = awkward
    out = sharding.shard_documents(docs, 16)
    assert set(out.columns) == set(docs.columns) | set(sharding.ADDED)
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r._h == r._k == 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)


def test_toxicity(awkward, spark):
    docs, rows = awkward
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 5) for i in range(40)] + [(1, 1, 5), (None, 1, 5), (2, None, 5)], "doc_id long, toxic int, text int")
    got = toxicity.toxicity_digest(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in got)
    assert len({(r.doc_id, r.score) for r in got if r.doc_id == 20}) == 1


def test_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(12, 8))
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)]
    rows += [(0, v[0].tolist(), 0), (0, v[0].tolist(), 0), (30, v[0].tolist(), 0), (31, [1.0], 0), (32, [2.0], 0), (33, [], 0), (34, [float("inf")] * 8, 0), (None, v[1].tolist(), 1), (None, None, None), (50, (v[2] * 3).tolist(), 0)]
    rows += [(60, rng.normal(size=5000).tolist(), 1), (61, v[3].tolist(), None)]
    df = spark.createDataFrame([(*r, *[1] * len(CLASH)) for r in rows], "vec_id long, embedding array<double>, label_ int, " + ", ".join(f"{c} int" for c in CLASH))
    df = df.drop("label").withColumnRenamed("label_", "label")
    got = embed_dedup.near_vectors(df).collect()
    assert len(got) == len(rows)
    of = {r.vec_id: r for r in got}
    assert of[0].n_links == 3 and of[30].component_id == 0 and not of[30].kept  # three equal rows and another id
    assert of[50].component_id == 2 and of[32].component_id == 31 and of[60].n_links == 0 and of[61].component_id == 61
    assert all(r.kept and r.n_links == 0 for r in got if r.vec_id in (33, 34, None))
    top = topk_search.top_k(df).collect()
    assert [r.rank for r in sorted((r for r in top if r.query_id == 50), key=lambda r: r.rank)] == [1, 2, 3, 4, 5]
    assert {r.query_id for r in top} == {0, 50}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.createOrReplaceTempView("none")
    for name, op in {
        "count": lambda: token_counts.count_tokens(docs, public_path("piece_bpe_32k.model")), "suffix": lambda: suffix_dedup.cut_repeats(docs), "mix": lambda: mixing.mix(docs),
        "pack": lambda: packing.pack_digest(docs, public_path("word_bpe_49k.json")), "minhash": lambda: minhash.near_duplicates(docs), "shard": lambda: sharding.shard_documents(docs),
        "toxicity": lambda: toxicity.toxicity_digest(docs, labels), "files": lambda: token_files.token_digest(docs, public_path("byte_bpe_50k.json")),
    }.items():
        assert op().count() == 0, name


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == DOCS.replace(",", "").split()[::2] and now.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def score_by_hand(machine, text):
    """The factorization machine by its definition: a sum over all pairs of terms."""
    buf = np.frombuffer((text or "").encode(), np.uint8)
    slots = toxicity.chunk_terms(buf, np.array([0, len(buf)]))[1]
    z = machine.bias + machine.weights[slots].sum(dtype=np.float64)
    v = machine.factors[slots].astype(np.float64)
    z += sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i) if v[i].any() and v[j].any())
    return 1 / (1 + math.exp(-z))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage of the pipeline against plain Python on its own input."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choices("abcdefghikmnoprstu", k=rng.randint(2, 8))) + rng.choice(["", "", "é"]) for _ in range(600)]
    body = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = " ".join(body(70))
    rows = []
    for i in range(160):
        w = body(rng.randint(20, 160))
        if i % 6 == 0:
            w[len(w) // 2 : len(w) // 2] = ["scum", "filth"]
        if i % 9 == 1:
            w.insert(len(w) // 3, passage)
        rows.append((i, " ".join(w)))
        if i % 10 == 3:
            near = " ".join(w).split()
            near[rng.randrange(len(near))] = "changed"
            rows += [(1000 + i, " ".join(near)), (2000 + i, " ".join(w))]
    docs = spark.createDataFrame([(i, t, "en", f"s{0 if i % 5 else 1}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    clean = stages.toxicity(spark, docs, sf)
    machine = toxicity.train(docs, labels)
    assert set(texts(clean)) == {i for i, t in rows if score_by_hand(machine, t) < 0.5}
    assert not {i for i, t in texts(clean).items() if "scum filth" in t}

    single = stages.near_dedup(spark, clean, sf)
    ids = sorted(texts(clean))
    s = sets_of([dict(rows)[i] for i in ids], 5)
    group = classes(len(ids), lambda a, b: bool(s[a] and s[b]) and 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b]))
    assert set(texts(single)) == {ids[g] for g in group} and len(set(group)) < len(ids)

    cut = stages.passage_dedup(spark, single, sf)
    have = texts(single)
    count = Counter(b[k : k + 200] for b in (t.encode() for t in have.values()) for k in range(len(b) - 199))
    for i, t in have.items():
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        # Characters that a span would cut stay whole.
        left, at = [], 0
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                left.append(c)
            at += n
        assert texts(cut)[i] == "".join(left) if i in (1, 10, 19) else True
    assert any(len(texts(cut)[i]) < len(have[i]) for i in have)

    mixed = stages.mix_sources(spark, cut, sf)
    want = mixing.mix(cut).groupBy("doc_id").count().collect()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r["count"] for r in want})

    packed = stages.pack(spark, mixed, sf).collect()
    plainly = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    need = Counter()
    for r in mixed.collect():
        made = [*plainly.encode(r.text, add_special_tokens=False).ids, 1]
        for a in range(0, len(made), 2048):
            need[r.doc_id, a, np.array(made[a : a + 2048], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in packed) == need
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) == need
