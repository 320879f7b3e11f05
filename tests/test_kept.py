"""Tests of queries on compressed candidates: made in tiles, so that no table of pairs is written or shuffled."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.operators import features, learning, tiles
from tessera.operators import matching as m
from tessera.plans import catalog, stages
from tessera.plans.stages import Stages

SF = "/root/testdata/sf0.001"
#: Tables that may be written: packed vocabularies and counts, and links of the records.
FEW = {"records", *[f"{x}-{c}" for x in ("words", "weights") for c in "DEJR"], *[f"{x}-{c}" for x in ("words", "counts") for c in "KW"], "reverse"}
KEY = ["country", "s1_id", "rec_id"]


def rows(df):
    return sorted(map(str, df.collect()))


#: Queries, the tables of their own that they may write, and whether pairs may be shuffled once they are decided.
CASES = {
    "anchors": (set(), False),
    "compress_adaptive": (set(), False),
    "decide_unique": (set(), True),
    "f05_loss": (set(), True),
    "feat_name": (set(), False),
    "blend_fit": ({"labelled"}, True),
    "candidate_metrics": (set(), True),
    "decide_margin": (set(), True),
    "entity_f05": (set(), True),
    "feat_address": (set(), False),
    "feat_phonetic": (set(), False),
    "blend_scores": (set(), False),
    "cheap_rank_weighted": (set(), False),
    "decide_threshold": (set(), False),
    "error_attribution": ({"claims-0.7"}, True),
    "feat_corroboration": (set(), False),
}


@pytest.mark.parametrize("name", CASES)
def test_no_pairs_are_written_or_shuffled(spark, name):
    own, shuffled = CASES[name]
    stages.forget(spark)
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() > 0
    assert {k[2] for k in stages._MADE if k[0] == spark.sparkContext.applicationId} <= FEW | own
    if not shuffled:
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The last tile step is the deepest of those above the layout.
        above = plan[: plan.rindex("MapInArrow")]
        assert "Exchange" not in above and "Join" not in above and "Window" not in above


def test_columns_equal_the_plans_on_whole_tables(spark):
    s = Stages(spark, SF)
    whole = s.compressed()
    given = ["rank_score", "rn", "budget", "protected"]
    assert rows(s.kept([*KEY, *given])) == rows(whole.select(*KEY, *given)) != []
    signed = features.signatures(s.records())
    made = s._featured(features.FEATURE_NAMES)
    assert rows(made) == rows(features.pair_features(whole, signed).select(made.columns))
    sizes = m.entity_counts(s.universe(), s.truth(), whole)
    assert rows(m.counts_of(s.universe(), s.true_counts(), s.in_tiles("sizes"))) == rows(sizes)


def test_weighted_ranks_equal_the_plan_on_whole_tables(spark):
    s = Stages(spark, SF)
    sim = catalog.similarities("weighted_ratio")
    ranked = s.ranked().drop("name_sim", "addr_sim", "exact_name", "house_match", "postal_match", "n_channels", "rank_score")
    pairs = ranked.withColumns({"_n": sim("q_name_core", "c_name_core"), "_a": sim("q_addr_street", "c_addr_street")})
    want = m.rank_score(pairs, F.col("_n.weighted_ratio"), F.col("_a.weighted_ratio")).select(*KEY, F.round("name_sim", 6).alias("name_sim"), F.round("addr_sim", 6).alias("addr_sim"), "rank_score")
    assert rows(catalog.cheap_rank_weighted(spark, SF)) == rows(want) != []


def test_decisions_equal_the_plans_on_whole_tables(spark):
    s = Stages(spark, SF)
    scored = learning.linear_scores(features.pair_features(s.compressed(), features.signatures(s.records())))
    own, unique = s.truth(), m.decide(scored, catalog.THRESHOLD, unique=True)
    assert rows(catalog.anchors(spark, SF)) == rows(learning.anchors(scored)) != []
    for name, how in (("decide_threshold", {}), ("decide_margin", {"margin": 0.1}), ("decide_unique", {"unique": True})):
        assert rows(catalog.QUERIES[name](spark, SF)) == rows(m.decide(scored, catalog.THRESHOLD, **how).select(*KEY, "p")) != []
    counts = m.entity_counts(s.universe(), own, unique)
    assert rows(catalog.entity_f05(spark, SF).drop("f05")) == rows(counts)
    assert rows(catalog.f05_loss(spark, SF)) == rows(m.loss_by_kind(counts))
    found, kept = {(r.s1_id, r.rec_id) for r in unique.collect()}, {(r.s1_id, r.rec_id): r for r in s.features().collect()}
    true = {(r.s1_id, r.rec_id) for r in own.collect()}
    owner = {b: a for a, b in true}
    kinds = [("fn_matcher" if x in kept else "fn_blocking") for x in true - found]
    kinds += ["fp_other_owner" if x[1] in owner else "fp_sibling" if kept[x].k_num_close > 0 else "fp_unowned" for x in found - true]
    assert {r.kind: r.n for r in catalog.error_attribution(spark, SF).collect()} == {k: kinds.count(k) for k in kinds}


def test_blends_equal_the_plans_on_whole_tables(spark):
    s = Stages(spark, SF)
    side = lambda p: F.concat_ws(" ; ", p + "name_alnum", p + "addr_street")
    near = s.scored().where(F.col("p").between(*learning.BAND)).select(*KEY)
    texts = m.with_texts(near, *s.sides()).select(*KEY, side("q_").alias("a"), side("c_").alias("b"))
    second = learning.second_scores(texts).withColumn("second", F.round("second", 6))
    both = learning.blend(s.scored().join(second, KEY, "left"), 0.679, 0.621, 0.0).withColumn("blended", F.round("blended", 6))
    assert rows(catalog.blend_scores(spark, SF)) == rows(both.select("s1_id", "rec_id", "blended")) != []
    assert rows(catalog.QUERIES["second_scores"](spark, SF)) == rows(second.select("s1_id", "rec_id", "second"))
    own = s.truth().select("s1_id", "rec_id", F.lit(1).alias("label"))
    want = learning.fit_blend(both.join(own, ["s1_id", "rec_id"], "left").na.fill(0, ["label"]))
    assert np.allclose(catalog.blend_fit(spark, SF).first(), want, rtol=0, atol=1e-9)


def _entities(seed):
    rng = random.Random(seed)
    out = []
    for e in range(40):
        recs = [f"r{i}" for i in rng.sample(range(100), rng.randrange(1, 9))]
        out += [(f"c{e % 3}", f"s{e // 2}", r, rng.choice([0.0, 0.019999, 0.02, 0.5, 0.9, 0.9, 0.95, 0.98, 0.980001, 1.0])) for r in recs]
    return sorted(out, key=lambda x: x[:2])


@pytest.mark.parametrize("held", [1, 7, 1 << 16])
def test_anchors_in_order(spark, held):
    """Ties, own places, entities of one id in several countries, and batches that end inside an entity."""
    df = spark.createDataFrame(_entities(held), "country string, s1_id string, rec_id string, p double").coalesce(1)
    want = {}
    by = {}
    for c, e, r, p in _entities(held):
        by.setdefault((c, e), []).append((-p, r))
    for (c, e), xs in by.items():
        for p, r in xs:
            best = [-q for q, o in sorted(xs) if o != r and -q >= 0.9][:3]
            if 0.02 <= -p <= 0.98 and best:
                want.setdefault((e, r), []).append((best[0], round(sum(best) / len(best), 6), len(best)))
    got = {}
    for r in learning.anchors_in_order(df, rows=held).collect():
        got.setdefault((r.s1_id, r.rec_id), []).append((r.a_max, round(r.a_mean, 6), r.n))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(got) > 20


@pytest.mark.parametrize("compared", [1, 5, 1 << 15])
def test_numbers_of_pairs(monkeypatch, compared):
    """Close numbers and shared extra numbers against brute force, some of them long, repeated or with zeros."""
    monkeypatch.setattr(tiles, "COMPARED", compared)
    rng = random.Random(compared)
    text = lambda: " ".join(rng.choice(["7", "007", "19", "33", "1234567", "1234570", "x12b", "road", "0", "40"]) for _ in range(rng.randrange(5)))
    table = lambda n: pa.table({"name_core": pa.chunked_array([["a"] * n]), "addr_street": pa.chunked_array([[text() for _ in range(n)]])})

    class Tile:
        queries, pool, counts = table(6), table(20), {}

    kept = object.__new__(tiles._Kept)
    kept.facts, kept.tile = tiles._Facts(Tile), Tile
    pairs = sorted({(rng.randrange(6), rng.randrange(20)) for _ in range(70)})
    kept.q, kept.at = (np.array(x) for x in zip(*pairs, strict=True))
    numbers = lambda rows: [set(tiles.tk._numbers(x)) for x in rows["addr_street"].to_pylist()]
    q, c = numbers(Tile.queries), numbers(Tile.pool)
    close = [any(len(x) <= 6 and len(y) <= 6 and 1 <= abs(int(x) - int(y)) <= 20 for x in q[i] - c[j] for y in c[j] - q[i]) for i, j in pairs]
    assert kept.num_close().tolist() == close and any(close)
    support = [sum(1 for k, o in pairs if k == i and o != j and (c[o] - q[i]) & (c[j] - q[i])) for i, j in pairs]
    assert kept.num_support().tolist() == support and max(support) > 1


def test_only_tokens_of_queries_are_held(monkeypatch):
    """Sets are read in parts, and an answer's tokens that no query has are counted only."""
    monkeypatch.setattr(tiles, "READ", 3)
    table = lambda addrs: pa.table({"name_core": pa.chunked_array([["ab cd"] * len(addrs)]), "addr_street": pa.chunked_array([addrs])})

    class Tile:
        queries, pool = table(["1 main rd", "2 side st"]), table([f"{i} main x{i} {'rd' if i % 2 else 'st'}" for i in range(8)])

    words = [set(x.split()) for x in Tile.queries["addr_street"].to_pylist()], [set(x.split()) for x in Tile.pool["addr_street"].to_pylist()]
    sets = tiles._Sets(Tile, *tiles._SETS["a"])
    assert set(sets.words.to_pylist()) == words[0][0] | words[0][1]
    q, at = np.repeat([0, 1], 8), np.tile(np.arange(8), 2)
    digits = [{x for x in words[0][i] & words[1][j] if x.isdigit()} for i, j in zip(q, at, strict=True)]
    assert sets.hits(q, at).sum(1).tolist() == [len(words[0][i] & words[1][j]) for i, j in zip(q, at, strict=True)]
    assert sets.hits(q, at)[:, 1].tolist() == [len(x) for x in digits] and sets.sizes[1].sum(1).tolist() == [4] * 8


def test_windows_are_compared_in_step(monkeypatch):
    """Pairs of short strings are not compared one by one, and the result is that of one pair by itself."""
    rng = random.Random(4)
    text = lambda sizes: "".join(rng.choice("ab c") for _ in range(rng.choice(sizes)))
    a, b = [text((0, 1, 3, 9, 20, 64)) for _ in range(400)], [text((1, 5, 20, 40, 64, 130)) for _ in range(400)]
    one = [similarity.partial_ratio(x, y) for x, y in zip(a, b, strict=True)]
    tokens = [similarity.partial_token_ratio(x, y) for x, y in zip(a, b, strict=True)]
    monkeypatch.setattr(similarity, "WINDOWS", 500)
    assert similarity.partial_ratios(a, b).tolist() == one and similarity.partial_token_ratios(a, b).tolist() == tokens
    monkeypatch.setattr(similarity, "partial_ratio", None)
    monkeypatch.setattr(similarity, "lcs", None)
    words = ["acme tools", "the acme tools company of the north", "a b", "zeta 12", "zeta"]
    both = [(x, y) for x in words for y in words]
    assert len(set(similarity.weighted_ratios([x for x, _ in both], [y for _, y in both]).tolist())) > 5
