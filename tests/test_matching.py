import decimal
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tessera import __main__ as command
from tessera import scratch
from tessera.functions import similarity as sim
from tessera.functions import text as t
from tessera.operators import index, learning
from tessera.operators import matching as m
from tessera.plans import catalog
from tessera.plans.stages import Stages
from tessera.sources import records

SF = "/root/testdata/sf0.001"


def test_skeletons(spark):
    words = {"first": ("frst", "frst"), "phrstt": ("frst", "prst"), "swastik": ("svstk", "sstk"), "1100": ("10", "10"), "5tar": ("str", "5tr"), "xerox": ("ksrks", "xrx"), "mama": ("m", "mm"), "engineering": ("angnrng", "engnrng")}
    rows = spark.createDataFrame([(w,) for w in words], "tok string").select("tok", t.skeleton(F.col("tok")).alias("a"), t.joint_skeleton(F.col("tok")).alias("b")).collect()
    assert {r.tok: (r.a, r.b) for r in rows} == words


def test_normalisation(spark):
    raw = spark.createDataFrame(
        [("1", "Acme Pvt. Ltd.", "12 Park Road, Suite 5", " IN "), ("2", "Limited", "94/26 MG Road 560001", "us"), ("3", "Co Op Company Stores", "Plot 7", "us"), ("4", "", "", "")],
        records.RAW,
    )
    r = {x.entity_id: x for x in records.normalize(raw).collect()}
    assert (r["1"].name_core, r["1"].addr_street, r["1"].country_norm) == ("acme", "12 park rd ste 5", "in")
    assert (r["2"].name_core, r["2"].house_number, r["2"].postal_code, r["2"].digits) == ("limited", "94", "560001", "94 26 560001")
    assert (r["3"].name_core, r["3"].postal_code) == ("op stores", None)
    assert (r["4"].name_alnum, r["4"].house_number, r["4"].digits) == ("", None, "")


def test_f_half(spark):
    rows = [(2, 3, 2, 0.714286), (0, 0, 0, 1.0), (1, 0, 0, 0.0), (0, 1, 0, 0.0), (4, 2, 2, 0.833333)]
    df = spark.createDataFrame(rows, "n_true long, n_pred long, n_hit long, want double")
    assert all(r.f == r.want for r in df.withColumn("f", F.round(m.f_half(), 6)).collect())


def test_uniqueness(spark):
    pairs = spark.createDataFrame([("c", "A", "r", 0.9), ("c", "B", "r", 0.8)], "country string, s1_id string, rec_id string, p double")
    assert [r.s1_id for r in m.decide(pairs, 0.71, unique=True).collect()] == ["A"]


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1_1\tA "b\t\tIN\nS1_2\tx\n', encoding="utf-8")
    rows = records.read_tsv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("S1_1", 'A "b', "", "IN"), ("S1_2", "x", "", "")]


words = st.text(alphabet="abc ", max_size=12)


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_similarities(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
    assert sim.lcs(a, b) == row[-1][-1] == sim.common_lengths([a], [b])[0]
    for name, f in sim.BATCH.items():
        one = f([a], [b])[0]
        assert abs(one - f([b], [a])[0]) < 1e-9 and 0 <= one <= 100, name
    if a:
        assert sim.jaro_winklers([a], [a])[0] == 1.0 and sim.ratios([a], [a])[0] == 100.0


def windows(a, b):
    if len(a) == len(b):
        return max(slid(a, b), slid(b, a))
    return slid(*sorted((a, b), key=len))


def slid(a, b):
    return max((sim.ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b))), default=0.0)


def jaro(a, b):
    reach, used, found = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == c:
                used.add(j)
                found.append(c)
                break
    n, swaps = len(found), sum(x != b[j] for x, j in zip(found, sorted(used), strict=True)) // 2
    value = (n / len(a) + n / len(b) + (n - swaps) / n) / 3 if n else 0.0
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return value + 0.1 * prefix * (1 - value) if value > 0.7 else value


def set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    both, p, q = sorted(x & y), sorted(x - y), sorted(y - x)
    if not x or not y:
        return 0.0
    if both and (not p or not q):
        return 100.0
    base, left, right = " ".join(both), " ".join(both + p), " ".join(both + q)
    return max(sim.ratio(base, left) if base else 0.0, sim.ratio(base, right) if base else 0.0, sim.ratio(left, right))


def weighted(a, b):
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best, order = sim.ratio(a, b), lambda s: " ".join(sorted(s.split()))
    if spread < 1.5:
        return max(best, 0.95 * max(sim.ratio(order(a), order(b)), set_ratio(a, b)))
    scale = 0.9 if spread <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    token = 100.0 if x & y else max(windows(order(a), order(b)), windows(" ".join(sorted(x)), " ".join(sorted(y))))
    return max(best, scale * windows(a, b), 0.95 * scale * token)


def test_similarities_against_brute_force():
    rng = random.Random(4)
    pairs = []
    for n in range(500):
        a = "x" + "".join(rng.choices("ab cdefgh"[: 3 + n % 7], k=rng.randint(0, 70)))
        b = "y" + "".join(rng.choices("ab cdefgé"[: 3 + n % 7], k=rng.randint(0, 90)))
        pairs.append((a, b + a + b[:9] if n % 3 == 0 else b))
    a, b = map(list, zip(*pairs, strict=True))
    for name, brute in (("ratio", sim.ratio), ("partial_ratio", windows), ("jaro_winkler", jaro), ("token_set_ratio", set_ratio), ("weighted_ratio", weighted)):
        got = sim.BATCH[name](a, b)
        assert max(abs(x - brute(*p)) for x, p in zip(got, pairs, strict=True)) < 1e-9, name
    got = sim.all_of(("ratio",), ["", "ab", "ab"], ["x", "ab", "ab"])["ratio"]
    assert got.tolist() == [0.0, 1.0, 1.0]


def test_letters_of_other_scripts(spark):
    want = {"लिमिटेड": "limittedd", "महाराष्ट्र": "mhaaraassttr", "Ünïversität ß": "universitat ss", "ΑΘΗΝΑ": "athena", "१२": "12", "plain": "plain", "Đà": "da"}
    df = spark.createDataFrame([(k,) for k in want], "x string")
    assert {r.x: r.y for r in df.withColumn("y", t.to_ascii(F.col("x"))).collect()} == want


SQL = sorted(catalog.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("customer", "supplier", "nation", "part", "orders", "pages"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(catalog.ORACLE_SQL[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == names
    plain = lambda v: float(v) if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else v
    want = sorted(repr([plain(r[cols.index(c)]) for c in names]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert got == want and len(got) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"gbt_results", "model_benchmark", "stage2_gate"}))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_order_of_input_does_not_matter(spark):
    rec = Stages(spark, SF).records()
    weighted = lambda r: index.weigh(index.token_table(r, m.CHANNELS), index.vocabulary(r, index.token_table(r, m.CHANNELS), m.CHANNELS))
    key = lambda r: sorted(map(str, index.top_k(weighted(r), m.channels("JR")).collect()))
    assert key(rec) == key(rec.orderBy(F.desc("digits")).repartition(3))


def test_links_against_brute_force(spark):
    """Owners of each record by the definition: rarest tokens asked, all known tokens in the norms."""
    s = Stages(spark, SF)
    tokens, side = defaultdict(set), {}
    for r in s.tokens().where("channel = 'R' and country = 'nation_3'").collect():
        tokens[r.id].add(r.tok)
        side[r.id] = r.side
    s1, rec = [x for x in tokens if side[x] == "s"], [x for x in tokens if side[x] == "r"]
    n = s.sides()[0].where("country_norm = 'nation_3'").count()
    df = Counter(tok for x in s1 for tok in tokens[x])
    idf = {tok: math.log(1 + n / (1 + k)) for tok, k in df.items()}
    norm = lambda x: math.sqrt(sum(idf[tok] ** 2 for tok in tokens[x] if tok in idf))
    want = set()
    for q in rec:
        known = sorted((df[tok], tok) for tok in tokens[q] if tok in df and df[tok] <= max(20, math.floor(n * 0.01)))
        sums = defaultdict(float)
        for _, tok in known[:20]:
            for d in s1:
                sums[d] += idf[tok] ** 2 if tok in tokens[d] else 0
        best = sorted((-round(v / (norm(q) * norm(d)), 6), d) for d, v in sums.items() if v)
        want |= {(q, d, -v) for v, d in best[:3]}
    got = {(r.rec_id, r.s1_id, r.score) for r in catalog.QUERIES["reverse_top3"](spark, SF).where("country = 'nation_3'").collect()}
    assert got == want and len(got) > 50


def test_edit_features_against_brute_force(spark):
    s = Stages(spark, SF)
    texts = {(r.s1_id, r.rec_id): r for r in s.compressed().select("s1_id", "rec_id", "q_name_core", "c_name_core", "q_addr_street", "c_addr_street").limit(300).collect()}
    for r in s.features().collect():
        x = texts.get((r.s1_id, r.rec_id))
        if x is not None:
            pair = (x.q_name_core, x.c_name_core)
            assert abs(r.n_ratio - sim.ratio(*pair) / 100) < 1e-6 and abs(r.n_partial_ratio - windows(*pair) / 100) < 1e-6 and abs(r.n_token_set - set_ratio(*pair) / 100) < 1e-6
            assert abs(r.a_ratio - (sim.ratio(x.q_addr_street, x.c_addr_street) / 100 if x.q_addr_street and x.c_addr_street else 0)) < 1e-6


def test_rules_against_brute_force(spark):
    rng = random.Random(3)
    scored = [("c", f"s{i % 7}", f"r{rng.randrange(12)}", round(rng.random(), 2)) for i in range(60)]
    scored = list({(c, a, b): p for c, a, b, p in scored}.items())
    scored = [(*k, p) for k, p in scored]
    truth = [("c", f"s{rng.randrange(8)}", f"r{i}") for i in range(12)]
    universe = [f"s{i}" for i in range(9)]
    df = spark.createDataFrame(scored, "country string, s1_id string, rec_id string, p double")
    tr, un = spark.createDataFrame(truth, "country string, s1_id string, rec_id string"), spark.createDataFrame([(u,) for u in universe], "s1_id string")
    grid = [(x, mg, u) for x in (0.3, 0.5, 0.75) for mg, u in ((None, False), (0.1, False), (None, True))]
    got = {(r.threshold, r.margin, r["unique"]): r.macro_f05 for r in m.sweep(m.entity_lists(un, tr, df), grid).collect()}
    own = {u: {b for _, a, b in truth if a == u} for u in universe}

    def f(have, true):
        hit = len(have & true)
        return 1.0 if not have and not true else 0.0 if not hit else 1.25 * hit / (len(have) + 0.25 * len(true))

    for x, mg, u in grid:
        first = {b: min((-p, a) for _, a, c, p in scored if c == b)[1] for _, _, b, _ in scored}
        total = 0.0
        for e in universe:
            mine = [(b, p) for _, a, b, p in scored if a == e]
            top = max((p for _, p in mine), default=0)
            total += f({b for b, p in mine if p >= x and (mg is None or p >= round(top - mg, 9)) and (not u or first[b] == e)}, own[e])
        assert abs(got[x, mg, u] - total / len(universe)) < 1e-6


def test_blend_fit(spark):
    rng = np.random.default_rng(1)
    p, second = rng.uniform(0.05, 0.95, 3000), rng.normal(size=3000)
    z = 0.8 * np.log(p / (1 - p)) + 0.5 * second - 0.3
    y = rng.random(3000) < 1 / (1 + np.exp(-z))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(p, second, y)], "p double, second double, label int")
    got = learning.fit_blend(df)
    assert np.abs(np.array(got) - [0.8, 0.5, -0.3]).max() < 0.2
    x = np.stack([np.log(p / (1 - p)), second, np.ones(3000)], 1)
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ np.array(got)))) - np.array([got[0] / 10, got[1] / 10, 0])
    assert np.abs(slope).max() < 1e-4


def test_learned_models(spark):
    s = Stages(spark, SF)
    for name, learner in learning.models(5, 4).items():
        held = learning.fitted(learner, s.features(), s.truth()).where("held_out").collect()
        assert np.mean([(r.p >= 0.5) == (r.label == 1.0) for r in held]) > 0.9, name
    gate = catalog.QUERIES["stage2_gate"](spark, SF).collect()
    assert {r.model for r in gate} == {"blend", "stage2"} and all(0 <= r.macro_f05 <= 1 for r in gate)


def test_sinks(spark, tmp_path):
    s1 = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "entity_id string, row int")
    found = spark.createDataFrame([("a", "r2"), ("a", "r1"), ("c", "r9")], "s1_id string, rec_id string")
    records.write_id_lists(s1, found, str(tmp_path / "m"), "matched_entity_ids", "row")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*"))).split("\n")
    assert [x for x in lines if x and not x.startswith("source1")] == ["a\tr1,r2", "b\t", "c\tr9"]
    back = {(r.s1_id, r.rec_id) for r in records.read_truth(spark, str(tmp_path / "m")).collect()}
    assert back == {("a", "r1"), ("a", "r2"), ("b", None), ("c", "r9")}
    records.write_report(found.groupBy().count(), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["count"] == 3
    rec = Stages(spark, SF).records().drop("tier", "owner")
    records.write_norm(rec, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == rec.count()


def test_command_line_over_files(spark, tmp_path):
    """TSV files in, candidate and match lists and reports out, in the order of the register."""
    raw = records.business_records(spark, SF).collect()
    columns = ("entity_id", "business_name", "business_address", "country")
    for tier in (1, 2, 3):
        lines = ["\t".join(columns)] + ["\t".join(r[c] for c in columns) for r in raw if r.tier == tier]
        (tmp_path / f"s{tier}.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    owned = defaultdict(list)
    for r in raw:
        if r.tier > 1 and r.owner is not None:
            owned[f"S1_{r.owner}"].append(r.entity_id)
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{k}\t{','.join(v)}\n" for k, v in owned.items()), encoding="utf-8")
    files = (str(tmp_path / "s1.tsv"), [str(tmp_path / "s2.tsv"), str(tmp_path / "s3.tsv")])
    command.run(spark, "diagnose", *files, str(tmp_path / "out"), str(tmp_path / "truth.tsv"))
    got = {r.s1_id: r.n for r in records.read_truth(spark, str(tmp_path / "out" / "matching_results")).groupBy("s1_id").agg(F.count("rec_id").alias("n")).collect()}
    want = {r.source1_entity_id: len([x for x in r.matched_entity_ids.split(",") if x]) for r in catalog.QUERIES["matching_results"](spark, SF).collect()}
    assert got == want
    report = spark.read.json(str(tmp_path / "out" / "match_report")).first()
    assert report.macro_f05 == catalog.QUERIES["macro_f05"](spark, SF).first().macro_f05
    command.run(spark, "normalize", *files, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n" / "norm")).count() == len(raw)


def test_scratch_is_refused_on_a_cluster(spark):
    class Unset:
        @staticmethod
        def get(*_):
            return None

    class Far:
        conf = Unset

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://far:7077", "x"
            getConf = Unset

    with pytest.raises(RuntimeError):
        scratch.scratch_root(Far)
    Far.sparkContext.master = "local[2]"
    assert scratch.scratch_root(Far).startswith("file://")


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
