"""Learned matchers, second scores, blending, anchors, group statistics and gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import jaro_winklers
from tessera.sources.records import split_bucket

from . import matching as m
from .features import FEATURE_NAMES

#: A fixed linear matcher on features that any engine can compute.
LINEAR = {
    "n_jaro_winkler": 4.0, "a_jaro_winkler": 3.0, "n_tok_jaccard": 2.0, "a_tok_jaccard": 1.5, "k_name_jac": 3.0, "k_num_jac": 1.5,
    "a_postal_match": 2.0, "a_house_match": 1.0, "rv_is_top1": 1.5, "rv_score": 2.0, "r_is_top1": 0.5, "k_num_close": -1.0,
}
INTERCEPT = -11.0
BAND = (0.02, 0.98)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def linear_scores(pairs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """country, s1_id, rec_id, score (the linear form) and p of featured pairs, and the columns ``also``."""
    z = F.lit(INTERCEPT)
    for name, weight in LINEAR.items():
        z = z + F.lit(weight) * F.col(name)
    return pairs.select("country", "s1_id", "rec_id", F.round(z, 8).alias("score"), F.round(1 / (1 + F.exp(-z)), 6).alias("p"), *also)


# --- second scores -------------------------------------------------------------------------

Scorer = Callable[[list[str], list[str]], np.ndarray]


def stand_in_scorer(a: list[str], b: list[str]) -> np.ndarray:
    """A second score where no text model is at hand: Jaro-Winkler of the whole texts, from -4 to 4."""
    return 8 * (jaro_winklers(a, b) - 0.5)


def second_scores(pairs: DataFrame, scorer: Scorer = stand_in_scorer, batch: int = 256) -> DataFrame:
    """country, s1_id, rec_id, second of pairs with texts a and b; texts of like length are scored together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            order = (df["a"].str.len() + df["b"].str.len()).to_numpy().argsort(kind="stable")
            out = np.zeros(len(df))
            for lo in range(0, len(df), batch):
                part = order[lo : lo + batch]
                out[part] = scorer(df["a"].iloc[part].tolist(), df["b"].iloc[part].tolist())
            yield df[["country", "s1_id", "rec_id"]].assign(second=out)

    return pairs.select("country", "s1_id", "rec_id", "a", "b").mapInPandas(run, "country string, s1_id string, rec_id string, second double")


def second_score(a: Column, b: Column, scorer: Scorer = stand_in_scorer, batch: int = 256) -> Column:
    """The second score of two texts as a column; null where the first text is null, which is not scored."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        own = np.flatnonzero(x.notna().to_numpy())
        order = own[(x.iloc[own].str.len() + y.iloc[own].str.len()).to_numpy(int).argsort(kind="stable")] if len(own) else own
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            out[part] = scorer(x.iloc[part].tolist(), y.iloc[part].tolist())
        return pd.Series(out).astype(object).where(x.notna().to_numpy(), None)

    return run(a, F.when(a.isNotNull(), b))


def missing_scores(pairs: DataFrame, done: DataFrame, scorer: Scorer = stand_in_scorer) -> DataFrame:
    """``done`` and the scores of the pairs that it lacks."""
    return done.unionByName(second_scores(pairs.join(done, ["country", "s1_id", "rec_id"], "left_anti"), scorer))


def blend(scored: DataFrame, on_logit: float, on_second: float, constant: float, low: float = BAND[0], high: float = BAND[1], second: str = "second") -> DataFrame:
    """Logistic blend of p with a second score inside the uncertain band; p elsewhere and without a second score."""
    z = on_logit * logit(F.col("p")) + on_second * F.col(second) + constant
    return scored.withColumn("blended", F.when(F.col("p").between(low, high) & F.col(second).isNotNull(), 1 / (1 + F.exp(-z))).otherwise(F.col("p")))


def fit_blend(labelled: DataFrame, c: float = 10.0, steps: int = 25) -> tuple[float, float, float]:
    """Coefficients of logit(p), second and the constant, by Newton steps on sums over all pairs (p, second, label)."""
    x = [logit(F.col("p")), F.col("second"), F.lit(1.0)]
    rows = labelled.where("second is not null").select(*[v.alias(f"x{i}") for i, v in enumerate(x)], F.col("label").cast("double").alias("y"))
    w = np.zeros(3)
    ridge = np.diag([1 / c, 1 / c, 0.0])
    for _ in range(steps):
        z = reduce(lambda a, b: a + b, [F.lit(float(w[i])) * F.col(f"x{i}") for i in range(3)])
        q = rows.withColumn("q", 1 / (1 + F.exp(-z)))
        sums = [F.sum((F.col("y") - F.col("q")) * F.col(f"x{i}")) for i in range(3)] + [F.sum(F.col("q") * (1 - F.col("q")) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(3) for j in range(3)]
        got = np.array([v or 0.0 for v in q.agg(*sums).first()], np.float64)
        step = np.linalg.solve(got[3:].reshape(3, 3) + ridge + 1e-9 * np.eye(3), got[:3] - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def pair_quality(scored: DataFrame) -> DataFrame:
    """n, positives, accuracy at 0.5 and AUC (rank sum, ties at their mean rank) of labelled scores p, label."""
    # Equal scores are counted together first: the ordered pass is over distinct scores of a bounded grid.
    by_p = scored.groupBy(F.round("p", 4).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"), F.sum(F.when((F.col("p") >= 0.5).cast("int") == F.col("label"), 1).otherwise(0)).alias("right"))
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by_p.withColumn("won", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return won.agg(F.sum("n").alias("n"), pos.alias("positives"), F.round(F.sum("right") / F.sum("n"), 6).alias("accuracy"), F.round(F.try_divide(F.sum("won"), pos * neg), 6).alias("auc"))


# --- context of a pair ---------------------------------------------------------------------


def anchors(scored: DataFrame, confident: float = 0.9, n: int = 3, low: float = BAND[0], high: float = BAND[1]) -> DataFrame:
    """For uncertain pairs: best, mean and number of up to n confident ones of their entity."""
    best = Window.partitionBy("country", "s1_id").orderBy(F.desc("p"), "rec_id")
    sure = scored.where(F.col("p") >= confident).withColumn("r", F.row_number().over(best)).where(F.col("r") <= n + 1).select("country", "s1_id", F.col("rec_id").alias("anchor"), F.col("p").alias("ap"))
    near = scored.where(F.col("p").between(low, high)).select("country", "s1_id", "rec_id").join(sure, ["country", "s1_id"]).where("anchor <> rec_id")
    w = Window.partitionBy("country", "s1_id", "rec_id").orderBy(F.desc("ap"), "anchor")
    top = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return top.groupBy("s1_id", "rec_id").agg(F.max("ap").alias("a_max"), F.round(F.avg("ap"), 6).alias("a_mean"), F.count(F.lit(1)).alias("n"))


def anchors_in_order(scored: DataFrame, confident: float = 0.9, n: int = 3, low: float = BAND[0], high: float = BAND[1], rows: int = 1 << 16) -> DataFrame:
    """``anchors`` of pairs of which those of an entity come one after another, as tiles return them: no pair is shuffled."""

    def some(t: pa.Table) -> pa.RecordBatch:
        t = t.append_column("e", pa.array(_runs(t))).append_column("i", pa.array(np.arange(len(t))))
        sure = t.filter(pc.greater_equal(t["p"], confident))
        order = pc.sort_indices(sure, [("e", "ascending"), ("p", "descending"), ("rec_id", "ascending")])
        e, i, p = (sure[c].to_numpy()[order.to_numpy()] for c in ("e", "i", "p"))
        at = np.arange(len(e)) - np.searchsorted(e, e)
        e, i, p, at = (x[at <= n] for x in (e, i, p, at))
        entities = int(t["e"][-1].as_py()) + 1
        held, count, place = np.zeros((entities, n + 1)), np.bincount(e, minlength=entities), np.full(len(t), n + 1)
        held[e, at], place[i] = p, at
        near = np.flatnonzero((t["p"].to_numpy() >= low) & (t["p"].to_numpy() <= high))
        e, place = t["e"].to_numpy()[near], place[near]
        # The places of others: a pair's own one is passed over.
        other = np.arange(n) + (np.arange(n) >= place[:, None])
        there = other < count[e][:, None]
        p = np.where(there, held[e[:, None], other], 0.0)
        found = there[:, 0]
        rows = t.take(pa.array(near[found]))
        return pa.RecordBatch.from_pydict({"s1_id": rows["s1_id"].combine_chunks(), "rec_id": rows["rec_id"].combine_chunks(), "a_max": p[found, 0], "a_sum": p[found].sum(1), "n": there[found].sum(1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= rows:
                t = pa.Table.from_batches(held).combine_chunks()
                e = _runs(t)
                end = int(np.searchsorted(e, e[-1]))
                if end:
                    yield some(t.slice(0, end))
                held = t.slice(end).combine_chunks().to_batches()
        if sum(map(len, held)):
            yield some(pa.Table.from_batches(held).combine_chunks())

    # Pairs below the band neither are anchors nor have them.
    pairs = scored.where(F.col("p") >= min(low, confident)).select("country", "s1_id", "rec_id", "p")
    found = pairs.mapInArrow(run, "s1_id string, rec_id string, a_max double, a_sum double, n long")
    return found.select("s1_id", "rec_id", "a_max", F.round(F.col("a_sum") / F.col("n"), 6).alias("a_mean"), "n")


def _runs(t: pa.Table) -> np.ndarray:
    """The number of the entity of each row, in the order of the rows."""
    change = np.zeros(len(t), bool)
    for c in ("country", "s1_id"):
        x = t[c].combine_chunks()
        change[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(change)


def group_stats(scored: DataFrame) -> DataFrame:
    """Of each pair's entity: best, second best, sum, size, strong pairs; its own place and its neighbours' p."""
    w = Window.partitionBy("country", "s1_id")
    o = w.orderBy(F.desc("p"), "rec_id")
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return scored.withColumns(
        {
            "g_max": F.max("p").over(w), "g_second": F.coalesce(F.nth_value("p", 2).over(whole), F.lit(0.0)), "g_sum": F.sum("p").over(w), "g_size": F.count(F.lit(1)).over(w),
            "g_strong": F.sum((F.col("p") > 0.5).cast("long")).over(w), "g_rank": F.row_number().over(o).cast("long"), "g_before": F.lag("p").over(o), "g_after": F.lead("p").over(o),
        }
    )


# --- learned models ------------------------------------------------------------------------


def _labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    own = truth.select("s1_id", "rec_id", F.lit(1.0).alias("label"))
    return pairs.join(own, ["s1_id", "rec_id"], "left").na.fill(0.0, ["label"]).withColumn("held_out", split_bucket(F.col("s1_id")) < 5)


def models(rounds: int = 20, depth: int = 5) -> dict[str, object]:
    return {
        "gbt": GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.85, minInstancesPerNode=20, seed=7),
        "forest": RandomForestClassifier(numTrees=rounds, maxDepth=depth + 2, minInstancesPerNode=20, seed=7),
        "logistic": LogisticRegression(maxIter=50, regParam=1e-4),
    }


def fitted(learner, pairs: DataFrame, truth: DataFrame, names: list[str] = FEATURE_NAMES) -> DataFrame:
    """country, s1_id, rec_id, label, held_out, p of a model fitted on the entities not held out."""
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(_labelled(pairs, truth))
    model = learner.fit(vectors.where("not held_out"))
    return model.transform(vectors).select("country", "s1_id", "rec_id", "label", "held_out", F.round(vector_to_array("probability")[1], 6).alias("p"))


def gbt_matcher(pairs: DataFrame, truth: DataFrame, rounds: int = 20, depth: int = 5) -> DataFrame:
    return fitted(models(rounds, depth)["gbt"], pairs, truth)


def model_benchmark(pairs: DataFrame, truth: DataFrame, universe: DataFrame, learners: dict[str, object] | None = None) -> DataFrame:
    """model, threshold, margin, macro_f05 on the held-out entities, each at its own best rule; ``best``."""
    held = universe.where(split_bucket(F.col("s1_id")) < 5)
    rows = []
    for name, learner in (learners or models()).items():
        lists = m.entity_lists(held, truth.join(held, "s1_id", "left_semi"), fitted(learner, pairs, truth).where("held_out"))
        # One row a model.
        rows.append(m.optimise_threshold(lists).where("chosen").select(F.lit(name).alias("model"), "threshold", "margin", "macro_f05"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("macro_f05"), "model")
    return reduce(DataFrame.unionByName, rows).withColumn("best", F.row_number().over(order) == 1)


STAGE2 = ["l_p", "x_second", "has_second", "blended", "g_max", "g_gap", "g_second", "g_rank", "g_size", "g_sum", "g_strong", "a_max", "a_mean", "a_n", "has_anchor"]


def stage2_features(scored: DataFrame) -> DataFrame:
    """country, s1_id, rec_id, p, blended and the second-stage features of pairs p, second, blended."""
    s = scored.withColumnRenamed("p", "p0").withColumn("p", F.col("blended"))
    stats, near = group_stats(s), anchors(s).withColumnsRenamed({"n": "a_n"})
    full = stats.join(near, ["s1_id", "rec_id"], "left")
    flag = lambda c: F.col(c).isNotNull().cast("double")
    made = {"l_p": logit(F.col("p0")), "x_second": F.coalesce("second", F.lit(0.0)), "has_second": flag("second"), "g_gap": F.col("p") - F.col("g_max"), "has_anchor": flag("a_max")}
    full = full.withColumns(made).na.fill(0, ["a_max", "a_mean", "a_n"])
    return full.select("country", "s1_id", "rec_id", F.col("p0").alias("p"), *[F.col(c).cast("double").alias(c) for c in STAGE2])


def fold_of(s1_id: Column) -> Column:
    return split_bucket(s1_id) % 2


def stage2(featured: DataFrame, truth: DataFrame, rounds: int = 10) -> DataFrame:
    """``featured`` with p2: the second-stage probability from a model fitted on the other half of the entities."""
    own = truth.select("s1_id", "rec_id", F.lit(1.0).alias("label"))
    rows = featured.join(own, ["s1_id", "rec_id"], "left").na.fill(0.0, ["label"]).withColumn("fold", fold_of(F.col("s1_id")))
    vectors = VectorAssembler(inputCols=STAGE2, outputCol="features").transform(rows)
    learner = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.1, minInstancesPerNode=20, seed=7)
    parts = [learner.fit(vectors.where(F.col("fold") != f)).transform(vectors.where(F.col("fold") == f)) for f in (0, 1)]
    return reduce(DataFrame.unionByName, [p.withColumn("p2", F.round(vector_to_array("probability")[1], 6)).drop("features", "rawPrediction", "probability", "prediction") for p in parts])
