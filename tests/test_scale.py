"""Tests of what keeps the matching queries small: channels on their own, tiles, wanted features."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions import tokens
from tessera.operators import features, index, learning
from tessera.operators import matching as m
from tessera.plans import catalog, stages
from tessera.plans.stages import Stages

SF = "/root/testdata/sf0.001"


@pytest.fixture
def made(spark):
    stages.forget(spark)
    return lambda: {k[2] for k in stages._MADE if k[0] == spark.sparkContext.applicationId}


def test_a_channel_makes_no_other(spark, made):
    assert catalog.QUERIES["topk_addr_word"](spark, SF).count() > 0
    assert made() == {"records", "tokens-E", "vocabulary-E", "weighted-E", "found-E"}


def test_tiles_do_not_change_what_is_found(spark, monkeypatch):
    s = Stages(spark, SF)
    rec = s.records()
    weighted = index.weigh(index.token_table(rec, m.CHANNELS), index.vocabulary(rec, index.token_table(rec, m.CHANNELS), m.CHANNELS))
    whole = sorted(map(str, index.top_k(weighted, m.channels("ER")).collect()))
    monkeypatch.setattr(index, "TILE", 7)
    assert sorted(map(str, index.top_k(weighted, m.channels("ER")).collect())) == whole and whole


@pytest.mark.parametrize("products", [1, 50, 1 << 20])
def test_best_of_a_tile(monkeypatch, products):
    monkeypatch.setattr(index, "PRODUCTS", products)
    rng = np.random.default_rng(5)
    rows, k = [], 3
    for i in range(90):
        tids = sorted(rng.choice(60, rng.integers(1, 8), replace=False).tolist())
        rows.append({"asks": i % 2 == 0, "id": f"r{i * 37 % 100}", "norm": 9.0 + i % 3, "tids": tids, "idfs": [1 + t % 4 / 2 for t in tids] if i % 2 == 0 else []})
    queries, answers, q, d, score = index._best(pa.Table.from_pylist(rows), k)
    got = [(queries["id"][int(a)].as_py(), answers["id"][int(b)].as_py(), int(s)) for a, b, s in zip(q, d, score, strict=True)]
    want = []
    for a in (r for r in rows if r["asks"]):
        found = []
        for b in (r for r in rows if not r["asks"]):
            common = [w * w for t, w in zip(a["tids"], a["idfs"], strict=True) if t in b["tids"]]
            if common:
                found.append((-int(np.floor(sum(common) / (a["norm"] * b["norm"]) * 1e6 + 0.5)), b["id"]))
        want += [(a["id"], i, -s) for s, i in sorted(found)[:k]]
    assert got == want


def test_scores_need_no_other_features(spark):
    s = Stages(spark, SF)
    for name in ("features", "signatures", "linear", "scored", "tokens-F"):
        stages._MADE.pop(s._key(name), None)
    scored = sorted(map(str, s.scored().collect()))
    assert not {"features", "signatures", "tokens-F"} & {k[2] for k in stages._MADE if k[:2] == s._key("")[:2]}
    assert scored == sorted(map(str, learning.linear_scores(s.features()).collect())) and scored
    for prefix in (("n",), ("a", "x"), ("r", "rv", "s"), ("k",), ("amb", "cor")):
        names = [n for n in features.PLAIN if n.split("_")[0] in prefix]
        alone = features.pair_features(s.compressed(), features.signatures(s.records(), features.kinds_of(names)), names)
        assert sorted(map(str, alone.collect())) == sorted(map(str, s.features().select(alone.columns).collect())), prefix


def test_tokens_of_batches_equal_native_ones(spark):
    odd = [("", ""), ("a", "0"), ("phrstt 5tar 1100", "007 0 00 b 12b ckx mg rd"), ("xx aa xx", "9 9 9"), (None, "1"), ("q", None), ("zz 0o0 h", "hhh 1 yy")]
    df = Stages(spark, SF).records().select("name_core", "addr_street").unionByName(spark.createDataFrame(odd, "name_core string, addr_street string"))
    both = df.select(t.tok4(F.col("name_core"), F.col("addr_street")).alias("a"), tokens.tok4("name_core", "addr_street").alias("b"))
    assert both.where("not (a <=> b)").limit(5).collect() == [] and both.count() > 1000
