"""Blocking, candidates, compression, decisions and metrics of record matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.tokens import tok4

from . import index

NAME = lambda: t.char_ngrams(F.col("name_core"), 5)
ADDR_WORDS = lambda: t.tokens(F.col("addr_street"))
ADDR_GRAMS = lambda: t.char_ngrams(F.col("addr_street"), 5)
JOINT = lambda: t.joint_tokens(F.col("name_core"), F.col("addr_street"))
TOK4 = lambda: tok4("name_core", "addr_street")

# How many each channel returns, its rarest tokens asked, and its document share.
CHANNELS = [
    index.Channel("D", NAME, "s", 50, 12, 0.005),
    index.Channel("E", ADDR_WORDS, "s", 50, 10, 0.005),
    index.Channel("F", ADDR_GRAMS, "s", 20, 10, 0.002),
    index.Channel("J", JOINT, "s", 20, 16, 0.002),
    index.Channel("R", TOK4, "r", 3, 20, 0.01),
]
LINKS_PER_ENTITY = 40


def block_key(kind: str) -> Column:
    """The key of an exact channel; null never matches."""
    if kind == "exact_name":
        key = F.col("name_alnum")
    elif kind == "core":
        key = F.col("name_core")
    elif kind == "sorted":
        key = t.sorted_tokens(F.col("name_core"))
    else:
        return F.when(F.col("postal_code").isNotNull() & F.col("house_number").isNotNull(), F.concat_ws("|", "postal_code", "house_number"))
    return F.when(key != "", key)


def block(s1: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """country, s1_id, rec_id of the pairs that agree on an exact key."""
    side = lambda df, name: df.select(F.col("country_norm").alias("country"), F.col("entity_id").alias(name), block_key(kind).alias("key")).where("key is not null")
    return side(s1, "s1_id").join(side(records, "rec_id"), ["country", "key"]).select("country", "s1_id", "rec_id")


def channels(names: str) -> list[index.Channel]:
    return [c for c in CHANNELS if c.name in names]


def reverse_links(found: DataFrame) -> DataFrame:
    """country, rec_id, s1_id, score, rank, margin: each record's nearest owners, from channel R."""
    links = found.where("channel = 'R'").select("country", F.col("q").alias("rec_id"), F.col("d").alias("s1_id"), "score", "rank")
    w = Window.partitionBy("country", "rec_id")
    top = F.max("score").over(w)
    second = F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w), F.lit(0.0))
    return links.withColumn("margin", F.round(F.when(F.col("rank") == 0, top - second).otherwise(F.col("score") - top), 6))


def cap_links(links: DataFrame, n: int = LINKS_PER_ENTITY) -> DataFrame:
    w = Window.partitionBy("country", "s1_id").orderBy(F.desc("score"), "rec_id")
    return links.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


EXACT = {"A": "exact_name", "B": "core", "C": "sorted", "G": "postal_house"}
EVIDENCE = [*EXACT, "d_score", "d_rank", "e_score", "e_rank", "f_score", "f_rank", "j_score", "j_rank", "r_score", "r_rank", "r_margin"]


def exact_pairs(s1: DataFrame, records: DataFrame) -> DataFrame:
    """country, s1_id, rec_id, kind of the pairs that agree on any exact key, in one join."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.explode(F.array(*[F.struct(F.lit(flag).alias("kind"), block_key(kind).alias("key")) for flag, kind in EXACT.items()]))
        return df.select(F.col("country_norm").alias("country"), F.col("entity_id").alias(name), keys.alias("x")).select("country", name, "x.*").where("key is not null")

    return keyed(s1, "s1_id").join(keyed(records, "rec_id"), ["country", "kind", "key"]).select("country", "s1_id", "rec_id", "kind")


def key_growth(s1: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """What the largest keys of a channel would bring: key, n_s1, n_rec, n_pairs."""
    count = lambda df, n: df.select(F.col("country_norm").alias("country"), block_key(kind).alias("key")).where("key is not null").groupBy("country", "key").agg(F.count(F.lit(1)).alias(n))
    return count(s1, "n_s1").join(count(records, "n_rec"), ["country", "key"]).withColumn("n_pairs", F.col("n_s1") * F.col("n_rec"))


def candidates(s1: DataFrame, records: DataFrame, found: DataFrame, names: str = "DEJ") -> DataFrame:
    """One row a pair with its evidence from all channels; null where one did not fire.

    ``found``: what the retrieval channels returned; ``names``: those that count, beside R.
    """

    def shaped(df: DataFrame, given: dict[str, Column]) -> DataFrame:
        return df.select("country", "s1_id", "rec_id", *[given.get(c, F.lit(None)).cast("double").alias(c) for c in EVIDENCE])

    exact = shaped(exact_pairs(s1, records), {k: F.when(F.col("kind") == k, 1.0) for k in EXACT})
    forward = found.where(F.col("channel").isin(list(names))).withColumnsRenamed({"q": "s1_id", "d": "rec_id"})
    given = {f"{n.lower()}_{c}": F.when(F.col("channel") == n, F.col(c)) for n in names for c in ("score", "rank")}
    reverse = cap_links(reverse_links(found))
    union = exact.unionByName(shaped(forward, given)).unionByName(shaped(reverse, {f"r_{c}": F.col(c) for c in ("score", "rank", "margin")}))
    return union.groupBy("country", "s1_id", "rec_id").agg(*[F.max(c).alias(c) for c in EVIDENCE])


def with_texts(pairs: DataFrame, s1: DataFrame, records: DataFrame, few: bool = False) -> DataFrame:
    """Pairs with the text columns of both sides, prefixed q_ and c_. ``few``: the pairs are broadcast in place of shuffling the records."""
    names = ["name_alnum", "name_core", "addr_street", "house_number", "postal_code"]
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), *[F.coalesce(c, F.lit("")).alias(p + c) for c in names])
    sent = F.broadcast if few else lambda df: df
    return sent(sent(pairs).join(side(s1, "s1_id", "q_"), "s1_id")).join(side(records, "rec_id", "c_"), "rec_id")


def rank_score(pairs: DataFrame, name_sim: Column, addr_sim: Column) -> DataFrame:
    """The cheap rank score of the pairs of ``with_texts``; ``pairs`` keeps its columns."""
    n_channels = sum((F.col(c).isNotNull().cast("int") for c in (*EXACT, "d_score", "e_score", "f_score", "j_score")), F.lit(0))
    same = lambda c: (F.col("q_" + c) != "") & (F.col("q_" + c) == F.col("c_" + c))
    out = pairs.withColumns({"name_sim": name_sim, "addr_sim": addr_sim, "exact_name": same("name_core").cast("int"), "house_match": same("house_number").cast("int"), "postal_match": same("postal_code").cast("int"), "n_channels": n_channels})
    return with_score(out)


def with_score(pairs: DataFrame) -> DataFrame:
    """Pairs with the rank score of their similarities, flags and channels."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.expr("2 * name_sim + 2 * addr_sim + 1.5D * exact_name + 0.8D * n_channels + house_match + postal_match") + 0.5 * zero(F.col("d_score")) + 0.5 * zero(F.col("e_score")) + 1.5 * zero(F.col("j_score"))
    # Half of a score of six places has seven.
    return pairs.withColumn("rank_score", F.round(score, 7))


# How many candidates an entity keeps, by how sure its best one is; the settings that a sweep tries.
BUDGETS = (12, 20, 30, 50)
BUDGET_GRID = ((2, 5, 12, 25), (3, 8, 20, 40), (3, 10, 30, 60), (5, 15, 40, 80), BUDGETS)


def tiers(scored: DataFrame) -> DataFrame:
    """``scored`` with rn (the candidate's place), tier (0 the surest entity, 3 the least sure) and protected."""
    w = Window.partitionBy("country", "s1_id").orderBy(F.desc("rank_score"), "rec_id")
    best = F.first(F.struct("exact_name", "name_sim", "addr_sim", "postal_match", "house_match")).over(w)
    ranked = scored.withColumns({"rn": F.row_number().over(w).cast("long"), "_b": best})
    strong = (F.col("_b.exact_name") == 1) & ((F.col("_b.addr_sim") > 0.8) | (F.col("_b.postal_match") == 1) | (F.col("_b.house_match") == 1))
    tier = F.when(strong, 0).when((F.col("_b.exact_name") == 1) | (F.col("_b.name_sim") > 0.92), 1).when((F.col("_b.name_sim") > 0.75) | (F.col("_b.addr_sim") > 0.85), 2).otherwise(3)
    safe = [F.coalesce(c, F.lit(False)) for c in (F.col("d_rank") < 5, F.col("e_rank") < 5, F.col("j_rank") < 12)]
    return ranked.withColumns({"tier": tier, "protected": safe[0] | safe[1] | safe[2] | F.col("r_score").isNotNull()}).drop("_b")


def compress(scored: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """Keep as many candidates of an entity as its best one warrants, and protected ones."""
    budget = F.element_at(F.array(*map(F.lit, budgets)), F.col("tier") + 1).cast("long")
    return tiers(scored).withColumn("budget", budget).where((F.col("rn") <= F.col("budget")) | F.col("protected"))


def budget_sweep(scored: DataFrame, universe: DataFrame, truth: DataFrame, grid: tuple[tuple[int, ...], ...] = BUDGET_GRID, tolerance: float = 0.005) -> DataFrame:
    """Recall and size of the candidates under each setting; ``chosen``: the smallest with a recall near the best."""
    own = truth.select("s1_id", "rec_id", F.lit(1).alias("hit"))
    placed = tiers(scored).select("s1_id", "rec_id", "rn", "tier", "protected").join(own, ["s1_id", "rec_id"], "left")
    return choose_budget(budget_counts(placed, grid), universe, truth, grid, tolerance)


def budget_counts(placed: DataFrame, grid: tuple[tuple[int, ...], ...] = BUDGET_GRID) -> DataFrame:
    """s1_id, and how many candidates and hits it keeps under each setting: n0, h0, n1, ...; ``placed``: rn, tier, protected and hit of each candidate."""
    kept = [(F.col("protected") | (F.col("rn") <= F.element_at(F.array(*map(F.lit, b)), F.col("tier") + 1))).cast("long") for b in grid]
    # One row an entity: settings are columns until the sizes are known.
    return placed.groupBy("s1_id").agg(*[F.sum(k).alias(f"n{i}") for i, k in enumerate(kept)], *[F.sum(k * F.coalesce("hit", F.lit(0))).alias(f"h{i}") for i, k in enumerate(kept)])


def choose_budget(per: DataFrame, universe: DataFrame, truth: DataFrame, grid: tuple[tuple[int, ...], ...] = BUDGET_GRID, tolerance: float = 0.005) -> DataFrame:
    """``budget_sweep`` from the counts of each entity."""
    each = F.explode(F.array(*[F.struct(F.lit("/".join(map(str, b))).alias("budgets"), F.col(f"n{i}").alias("n_pred"), F.col(f"h{i}").alias("n_hit")) for i, b in enumerate(grid)]))
    every = universe.select("s1_id").distinct().join(per, "s1_id", "left").na.fill(0)
    sizes = every.select(each.alias("x")).select("x.*")
    n_true = truth.agg(F.count(F.lit(1)).alias("n_true"))
    out = sizes.groupBy("budgets").agg(F.sum("n_hit").alias("n_hit"), F.round(F.avg("n_pred"), 6).alias("avg_candidates"))
    out = out.join(size_percentiles(sizes, "budgets", {"p95": 0.95}), "budgets").join(F.broadcast(n_true)).select("budgets", F.round(F.try_divide("n_hit", "n_true"), 6).alias("recall"), "avg_candidates", "p95")
    # One row a setting.
    viable = F.col("recall") >= F.max("recall").over(Window.partitionBy(F.lit(1))) - tolerance
    first = F.row_number().over(Window.partitionBy(viable).orderBy("avg_candidates", "budgets"))
    return out.withColumn("chosen", viable & (first == 1))


def size_percentiles(sizes: DataFrame, by: str, wanted: dict[str, float]) -> DataFrame:
    """The element at floor(q * n) of the sorted n_pred of each ``by``, from a histogram of sizes, which is small."""
    counts = sizes.groupBy(by, "n_pred").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by)
    stepped = counts.select(by, "n_pred", F.sum("c").over(w.orderBy("n_pred")).alias("upto"), F.sum("c").over(w).alias("n"))
    return stepped.groupBy(by).agg(*[F.min(F.when(F.col("upto") >= F.least(F.col("n"), F.floor(F.lit(q) * F.col("n")) + 1), F.col("n_pred"))).alias(name) for name, q in wanted.items()])


# --- decisions and metrics ---------------------------------------------------------------


def decide(scored: DataFrame, threshold: float, margin: float | None = None, unique: bool = False) -> DataFrame:
    """s1_id, rec_id, p of the accepted pairs."""
    kept = scored.where(F.col("p") >= threshold)
    if unique:
        w = Window.partitionBy("country", "rec_id").orderBy(F.desc("p"), "s1_id")
        kept = kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    elif margin is not None:
        best = F.max("p").over(Window.partitionBy("country", "s1_id"))
        kept = kept.withColumn("_m", best).where(F.col("p") >= F.round(F.col("_m") - margin, 9)).drop("_m")
    return kept


def entity_counts(universe: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """s1_id, n_true, n_pred, n_hit for every entity of the universe."""
    both = truth.select("s1_id", "rec_id", F.lit(1).alias("t"), F.lit(0).alias("m")).unionByName(matches.select("s1_id", "rec_id", F.lit(0).alias("t"), F.lit(1).alias("m")))
    pairs = both.groupBy("s1_id", "rec_id").agg(F.max("t").alias("t"), F.max("m").alias("m"))
    sums = pairs.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("m").alias("n_pred"), F.sum(F.col("t") * F.col("m")).alias("n_hit"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_true", "n_pred", "n_hit")]
    return universe.select("s1_id").distinct().join(sums, "s1_id", "left").select("s1_id", *zero)


def counts_of(universe: DataFrame, true: DataFrame, found: DataFrame) -> DataFrame:
    """``entity_counts`` of n_true (``true``), n_pred and n_hit (``found``) by s1_id, where they are already counted."""
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_true", "n_pred", "n_hit")]
    return universe.select("s1_id").distinct().join(true, "s1_id", "left").join(found, "s1_id", "left").select("s1_id", *zero)


def f_half(hit: str = "n_hit", pred: str = "n_pred", true: str = "n_true") -> Column:
    """F0.5 of one entity; both sets empty count 1."""
    h, p, n = F.col(hit), F.col(pred), F.col(true)
    return F.when((p == 0) & (n == 0), 1.0).when(h == 0, 0.0).otherwise(1.25 * h / (p + 0.25 * n))


def macro_metrics(counts: DataFrame) -> DataFrame:
    alone = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("int"))
    return counts.agg(
        F.round(F.avg(f_half()), 6).alias("macro_f05"), F.sum("n_hit").alias("tp"), F.sum(F.col("n_pred") - F.col("n_hit")).alias("fp"), F.sum(F.col("n_true") - F.col("n_hit")).alias("fn"),
        F.round(F.try_divide(F.sum("n_hit"), F.sum("n_pred")), 6).alias("micro_precision"), F.round(F.try_divide(F.sum("n_hit"), F.sum("n_true")), 6).alias("micro_recall"), F.count(F.lit(1)).alias("n_entities"),
        F.round(F.avg(alone), 6).alias("singleton_accuracy"),
    )


def candidate_metrics(counts: DataFrame, corpus_size: DataFrame) -> DataFrame:
    """One row on the candidate sets (counts of ``entity_counts``); ``corpus_size``: one row, n_corpus."""
    sizes = counts.withColumn("all", F.lit(1))
    share = size_percentiles(sizes, "all", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).drop("all")
    totals = counts.agg(
        F.sum("n_hit").alias("n_hit"), F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pairs"), F.round(F.try_divide(F.sum("n_hit"), F.sum("n_true")), 6).alias("recall"), F.round(F.try_divide(F.sum("n_hit"), F.sum("n_pred")), 6).alias("precision"),
        F.round(F.avg("n_pred"), 6).alias("avg_size"), F.max("n_pred").alias("max_size"), F.sum((F.col("n_pred") == 0).cast("long")).alias("n_empty"), F.count(F.lit(1)).alias("n_entities"),
    )
    ratio = F.round(1 - F.col("n_pairs") / (F.col("n_entities") * F.col("n_corpus")), 9)
    # One row on each side.
    return totals.join(F.broadcast(share)).join(F.broadcast(corpus_size)).withColumn("reduction_ratio", ratio).drop("n_entities", "n_corpus")


def loss_by_kind(counts: DataFrame) -> DataFrame:
    """Macro F0.5 points lost by the kind of an entity's error."""
    fp, fn = F.col("n_pred") > F.col("n_hit"), F.col("n_true") > F.col("n_hit")
    kind = F.when(F.col("n_true") == 0, "singleton_given_matches").when(F.col("n_pred") == 0, "predicted_empty").when(fp & fn, "has_fp_and_fn").when(fp, "has_fp_only").otherwise("has_fn_only")
    n = counts.agg(F.count(F.lit(1)).alias("n"))
    lost = counts.withColumn("f", f_half()).where("f < 1").groupBy(kind.alias("kind")).agg(F.sum(1 - F.col("f")).alias("lost"), F.count(F.lit(1)).alias("n_entities"))
    return lost.join(F.broadcast(n)).select("kind", "n_entities", F.round(F.col("lost") / F.col("n"), 6).alias("loss"))


# --- search of decisions -----------------------------------------------------------------


def entity_lists(universe: DataFrame, truth: DataFrame, scored: DataFrame) -> DataFrame:
    """s1_id, n_true, top, pairs (p, hit, first: no entity has a higher claim) of every entity.

    An entity has as many pairs as it has candidates, which compression bounds.
    """
    claim = F.row_number().over(Window.partitionBy("country", "rec_id").orderBy(F.desc("p"), "s1_id")) == 1
    own = truth.select("s1_id", "rec_id", F.lit(1).alias("hit"))
    flagged = scored.select("country", "s1_id", "rec_id", "p").withColumn("first", claim).join(own, ["s1_id", "rec_id"], "left")
    lists = flagged.groupBy("s1_id").agg(F.collect_list(F.struct("p", F.coalesce("hit", F.lit(0)).alias("hit"), "first")).alias("pairs"), F.max("p").alias("top"))
    true = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    out = universe.select("s1_id").distinct().join(true, "s1_id", "left").join(lists, "s1_id", "left")
    return out.select("s1_id", F.coalesce("n_true", F.lit(0)).alias("n_true"), "top", F.coalesce("pairs", F.array().cast("array<struct<p:double,hit:int,first:boolean>>")).alias("pairs"))


Rule = tuple[float, float | None, bool]


def sweep(lists: DataFrame, grid: list[Rule], by: list[str] | None = None) -> DataFrame:
    """threshold, margin, unique, macro_f05 and n_pred of each rule, in one pass over the entities."""
    rules = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(m).cast("double").alias("margin"), F.lit(u).alias("unique")) for t, m, u in grid]))
    each = lists.withColumn("r", rules)
    taken = F.filter("pairs", lambda x: (x["p"] >= F.col("r.threshold")) & (F.col("r.margin").isNull() | (x["p"] >= F.round(F.col("top") - F.col("r.margin"), 9))) & (~F.col("r.unique") | x["first"]))
    each = each.withColumn("taken", taken).withColumns({"n_pred": F.size("taken"), "n_hit": F.aggregate("taken", F.lit(0), lambda acc, x: acc + x["hit"])})
    return each.groupBy(*(by or []), "r.threshold", "r.margin", "r.unique").agg(F.round(F.avg(f_half()), 6).alias("macro_f05"), F.sum("n_pred").alias("n_pred"))


COARSE = [round(0.30 + 0.05 * i, 3) for i in range(14)]
MARGINS = (None, 0.1, 0.2)


def best_rule(swept: DataFrame) -> dict:
    """The best row; ties to the lower threshold, no margin, no uniqueness."""
    # A grid has a few hundred rows.
    return swept.orderBy(F.desc("macro_f05"), "threshold", F.col("margin").asc_nulls_first(), "unique").first().asDict()


def optimise_threshold(lists: DataFrame, margins: tuple[float | None, ...] = MARGINS) -> DataFrame:
    """The swept rules of a coarse grid and a fine one around its best; ``chosen``: the best of all."""
    coarse = [(t, m, False) for m in margins for t in COARSE]
    near = best_rule(sweep(lists, coarse))["threshold"]
    lo, hi = max(0.05, near - 0.05), min(0.99, near + 0.05)
    fine = [(round(lo + 0.005 * i, 4), m, False) for m in margins for i in range(int(round((hi - lo) / 0.005)))]
    out = sweep(lists, sorted({*coarse, *fine}, key=str))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("macro_f05"), "threshold", F.col("margin").asc_nulls_first())
    return out.drop("unique").withColumn("chosen", F.row_number().over(order) == 1)


def uniqueness_gate(lists: DataFrame, threshold: float, margin: float | None = None) -> DataFrame:
    """One row: the macro F0.5 with and without one owner a record, and whether it is kept (only if better)."""
    both = sweep(lists, [(threshold, margin, False), (threshold, None, True)])
    f = lambda u: F.max(F.when(F.col("unique") == u, F.col("macro_f05")))
    return both.agg(f(False).alias("plain_f05"), f(True).alias("unique_f05")).withColumn("use_unique", F.col("unique_f05") > F.col("plain_f05"))


TUNED = [(round(0.30 + 0.025 * i, 4), None, u) for u in (False, True) for i in range(27)]


def two_fold_gate(lists: dict[str, DataFrame], fold: Column, least_gain: float = 0.0005) -> DataFrame:
    """model, fold, threshold, unique, macro_f05: rules tuned on one half of the entities, measured on the other.

    ``gain``: the model's mean over that of the first one; ``kept``: whether it is enough.
    """
    parts = []
    order = Window.partitionBy("fold").orderBy(F.desc("macro_f05"), "threshold", "unique")
    for name, df in lists.items():
        # A few hundred rows: each rule on each half.
        swept = sweep(df.withColumn("fold", fold), TUNED, ["fold"])
        best = swept.withColumn("_n", F.row_number().over(order)).where("_n = 1").select((1 - F.col("fold")).alias("fold"), "threshold", "unique")
        parts.append(swept.select("fold", "threshold", "unique", "macro_f05").join(F.broadcast(best), ["fold", "threshold", "unique"]).select(F.lit(name).alias("model"), "fold", "threshold", "unique", "macro_f05"))
    out = reduce(DataFrame.unionByName, parts)
    mean = lambda which: F.avg(F.when(which, F.col("macro_f05"))).over(Window.partitionBy(F.lit(1)))
    own = F.avg("macro_f05").over(Window.partitionBy("model"))
    gain = F.round(own - mean(F.col("model") == next(iter(lists))), 6)
    return out.withColumn("gain", gain).withColumn("kept", F.col("gain") > least_gain)


def overlay(base: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """Base decisions, with those of the entities ``ids`` (s1_id) replaced by the new ones."""
    return base.join(ids.distinct(), "s1_id", "left_anti").unionByName(new.join(ids.distinct(), "s1_id", "left_semi"))
