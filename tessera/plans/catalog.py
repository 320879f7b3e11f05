"""The registered queries; the SQL of each is in ``oracles``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.similarity import NAMES, similarities
from tessera.operators import features, index, learning
from tessera.operators import matching as m
from tessera.scratch import table_path
from tessera.sources import records

from .oracles import ORACLE_SQL as ORACLE_SQL
from .stages import Stages

FLAGSHIP = "matching_results"
THRESHOLD = 0.7
GRID = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
KEY = ["country", "s1_id", "rec_id"]


# --- records -------------------------------------------------------------------------------


def raw_records(spark, d):
    return records.business_records(spark, d)


def norm_record(spark, d):
    return Stages(spark, d).records().drop("tier", "owner")


def legal_suffix(spark, d):
    return Stages(spark, d).records().where("name_core <> name_alnum").groupBy("name_alnum", "name_core").agg(F.count(F.lit(1)).alias("n"))


def street_abbrev(spark, d):
    return Stages(spark, d).records().where("addr_alnum <> addr_street").select("entity_id", "addr_alnum", "addr_street")


def digit_groups(spark, d):
    return Stages(spark, d).records().select("entity_id", F.posexplode(F.split("digits", " ")).alias("place", "digit_group")).where("digit_group <> ''")


def countries(spark, d):
    return records.countries(*Stages(spark, d).sides())


def country_corpus(spark, d):
    """The corpus written by country and read back for a few of them: partitions are pruned."""
    path = table_path(spark, "corpus")
    records.write_norm(Stages(spark, d).sides()[1].drop("tier", "owner"), path)
    back = spark.read.parquet(path).where("country_norm in ('nation_3', 'nation_7')")
    return back.groupBy(F.col("country_norm").cast("string").alias("country_norm")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("postal_code").alias("n_postal"))


def _words(spark, d):
    rec = Stages(spark, d).records()
    return rec.select(F.explode(F.array_distinct(t.tokens(F.concat_ws(" ", "name_alnum", "addr_alnum", "addr_street")))).alias("tok")).distinct()


def phonetic_skeleton(spark, d):
    return _words(spark, d).select("tok", t.skeleton(F.col("tok")).alias("skeleton"))


def joint_skeleton(spark, d):
    return _words(spark, d).select("tok", t.joint_skeleton(F.col("tok")).alias("skeleton"))


def _tokens(spark, d, channel):
    return Stages(spark, d).tokens(channel).select("country", "id", "tok")


def char_ngrams_df(spark, d):
    return _tokens(spark, d, "D").groupBy("country", "tok").agg(F.count(F.lit(1)).alias("df"))


def url_tokens(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    words = F.array_distinct(t.tokens(F.regexp_replace(F.lower("url"), "[^a-z0-9]", " ")))
    return pages.select("page_id", F.explode(words).alias("tok")).distinct().groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


def name_key_counts(spark, d):
    return Stages(spark, d).records().groupBy(F.col("country_norm").alias("country"), t.name_key(F.col("name_core")).alias("name_key")).agg(F.count(F.lit(1)).alias("n"))


def twin_counts(spark, d):
    keyed = Stages(spark, d).records().select("entity_id", "country_norm", t.twin_key(F.col("name_core"), F.col("addr_street")).alias("twin_key"))
    return keyed.select("entity_id", "twin_key", (F.count(F.lit(1)).over(Window.partitionBy("country_norm", "twin_key")) - 1).alias("twins"))


# --- retrieval -----------------------------------------------------------------------------


def _block(spark, d, kind):
    return m.block(*Stages(spark, d).sides(), kind)


def block_sizes(spark, d):
    return m.key_growth(*Stages(spark, d).sides(), "core")


def idf_vocab(spark, d):
    return Stages(spark, d).vocabulary().withColumn("idf", F.round("idf", 6))


def index_stats(spark, d):
    s = Stages(spark, d)
    return index.index_stats(s.vocabulary())


def _top(spark, d, channel):
    return Stages(spark, d).found(channel).select("country", F.col("q").alias("s1_id"), F.col("d").alias("rec_id"), "score", "rank")


def reverse_top3(spark, d):
    return m.reverse_links(Stages(spark, d).found("R"))


def reverse_capped(spark, d):
    return Stages(spark, d).links()


def reverse_counts(spark, d):
    return Stages(spark, d).links().groupBy("country", "s1_id").agg(F.count(F.lit(1)).alias("n"))


def candidate_union(spark, d):
    return Stages(spark, d).in_tiles("evidence")


def candidate_union_all(spark, d):
    """With the optional channel F."""
    return Stages(spark, d).in_tiles("evidence", "DEFJ")


# --- candidates ----------------------------------------------------------------------------


def _texts(spark, d):
    s = Stages(spark, d)
    return m.with_texts(s.compressed().select(*KEY), *s.sides())


def sim_jaro_winkler(spark, d):
    sim = similarities("jaro_winkler")("q_name_core", "c_name_core")
    return _texts(spark, d).withColumn("x", sim).select("s1_id", "rec_id", F.round("x.jaro_winkler", 6).alias("sim"))


def sim_levenshtein(spark, d):
    a, b = F.col("q_name_core"), F.col("c_name_core")
    distance = F.levenshtein(a, b)
    sim = F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.try_divide(distance, F.greatest(F.length(a), F.length(b))))
    return _texts(spark, d).select("s1_id", "rec_id", distance.cast("long").alias("distance"), F.round(sim, 6).alias("sim"))


def sim_indel_family(spark, d):
    sims = similarities(*NAMES)("q_name_core", "c_name_core")
    return _texts(spark, d).withColumn("x", sims).select("s1_id", "rec_id", *[F.round(f"x.{n}", 6).alias(n) for n in NAMES])


def cheap_rank(spark, d):
    return Stages(spark, d).ranked().select(*KEY, "name_sim", "addr_sim", "exact_name", "house_match", "postal_match", "n_channels", "rank_score")


def cheap_rank_weighted(spark, d):
    """The rank score with weighted ratios in place of Jaro-Winkler."""
    ranked = m.with_score(Stages(spark, d).in_tiles("weighted_ratio"))
    return ranked.select(*KEY, F.round("name_sim", 6).alias("name_sim"), F.round("addr_sim", 6).alias("addr_sim"), "rank_score")


def compress_adaptive(spark, d):
    return Stages(spark, d).kept([*KEY, "rank_score", "rn", "budget", "protected"])


def candidate_pairs(spark, d):
    """The candidate lists as they are written for each S1 entity."""
    return Stages(spark, d).in_tiles("lists").select(F.col("s1_id").alias("source1_entity_id"), F.col("ids").alias("candidate_entity_ids"))


def budget_sweep(spark, d):
    s = Stages(spark, d)
    return m.choose_budget(s.budget_counts(), s.universe(), s.truth())


def candidate_metrics(spark, d):
    s = Stages(spark, d)
    corpus = s.sides()[1].agg(F.count(F.lit(1)).alias("n_corpus"))
    return m.candidate_metrics(m.counts_of(s.universe(), s.true_counts(), s.in_tiles("sizes").groupBy("s1_id").agg(*[F.sum(c).alias(c) for c in ("n_pred", "n_hit")])), corpus)


def _features(spark, d, prefix):
    names = [n for n in features.PLAIN if n.split("_")[0] in prefix]
    return Stages(spark, d).features_of(names).select("s1_id", "rec_id", *names)


def pair_features(spark, d):
    return Stages(spark, d).features()


# --- splits, labels, scores ----------------------------------------------------------------


def split_buckets(spark, d):
    bucket = records.split_bucket(F.col("entity_id"))
    return Stages(spark, d).records().select("entity_id", bucket.alias("bucket"), (bucket < 5).alias("held_out"))


def split_files(spark, d):
    """The split tables as written and read back: sizes of train and val."""
    path = table_path(spark, "splits")
    records.write_splits(Stages(spark, d).universe(), path)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("s1_id").alias("first_id"))


def first_queries(spark, d):
    """The feature is the limit: the first ten entities of each country."""
    return records.first_rows(Stages(spark, d).sides()[0].select("country_norm", "entity_id"), 10, "country_norm", "entity_id")


def truth_in_corpus(spark, d):
    return Stages(spark, d).truth()


def training_truth(spark, d):
    """The truth of the entities that are not held out."""
    s = Stages(spark, d)
    held = s.universe().where(records.split_bucket(F.col("s1_id")) < 5)
    return s.truth().join(held, "s1_id", "left_anti").select(*KEY)


def label_pairs(spark, d):
    s = Stages(spark, d)
    own = s.truth().select("s1_id", "rec_id", F.lit(1).alias("label"))
    return s.compressed().select("country", "s1_id", "rec_id").join(own, ["s1_id", "rec_id"], "left").na.fill(0, ["label"]).select("s1_id", "rec_id", "label")


def positive_rate(spark, d):
    s = Stages(spark, d)
    labels = label_pairs(spark, d).join(s.compressed().select(*KEY), ["s1_id", "rec_id"])
    return labels.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("positive_rate"))


def scored_pairs(spark, d):
    return Stages(spark, d).scored()


def pair_quality(spark, d):
    s = Stages(spark, d)
    held = s.scored().where(records.split_bucket(F.col("s1_id")) < 5)
    return learning.pair_quality(held.join(label_pairs(spark, d), ["s1_id", "rec_id"]))


def ce_pair_text(spark, d):
    return Stages(spark, d).in_tiles("texts")


def ce_train_set(spark, d):
    """Labelled reverse links of entities not held out: a seeded sample of 200 a country (the feature is the sample)."""
    s = Stages(spark, d)
    sample = s.train_sample()
    # 200 rows a country: bounded broadcasts.
    own = s.truth().join(F.broadcast(sample.select("s1_id", "rec_id")), ["s1_id", "rec_id"], "left_semi").select("s1_id", "rec_id", F.lit(1).alias("label"))
    side = lambda p: F.concat_ws(" ; ", p + "name_alnum", p + "addr_street")
    full = m.with_texts(sample, *s.sides(), few=True).join(own, ["s1_id", "rec_id"], "left").na.fill(0, ["label"])
    return full.select("s1_id", "rec_id", side("q_").alias("a"), side("c_").alias("b"), "label")


def second_scores(spark, d):
    return Stages(spark, d).blended().where("second is not null").select("s1_id", "rec_id", "second")


def second_scores_rest(spark, d):
    """Scores made in two goes: what the first one lacks is scored in the second."""
    s = Stages(spark, d)
    pairs = s.pair_texts()
    done = learning.second_scores(pairs.where(learning.fold_of(F.col("s1_id")) == 0))
    return learning.missing_scores(pairs, done).select("s1_id", "rec_id", F.round("second", 6).alias("second"))


def blend_scores(spark, d):
    return Stages(spark, d).blending().select("s1_id", "rec_id", "blended")


def blend_fit(spark, d):
    return spark.createDataFrame([learning.fit_blend(Stages(spark, d).labelled())], "on_logit double, on_second double, constant double")


def anchors(spark, d):
    return learning.anchors_in_order(Stages(spark, d).judged())


def stage2_group_stats(spark, d):
    stats = learning.group_stats(Stages(spark, d).scored())
    return stats.select("s1_id", "rec_id", "p", "g_max", "g_second", F.round("g_sum", 6).alias("g_sum"), "g_size", "g_strong", "g_rank", "g_before", "g_after")


# --- decisions and measures ----------------------------------------------------------------


def _decided(spark, d, **how):
    return m.decide(Stages(spark, d).scores(), THRESHOLD, **how).select(*KEY, "p")


def _counts(spark, d):
    s = Stages(spark, d)
    found = m.decide(s.judged("hit").select(*KEY, "p", "hit"), THRESHOLD, unique=True)
    return m.counts_of(s.universe(), s.true_counts(), found.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("hit").alias("n_hit")))


def entity_f05(spark, d):
    return _counts(spark, d).withColumn("f05", F.round(m.f_half(), 6))


def macro_f05(spark, d):
    return m.macro_metrics(_counts(spark, d))


def f05_loss(spark, d):
    return m.loss_by_kind(_counts(spark, d))


def threshold_sweep(spark, d):
    swept = m.sweep(Stages(spark, d).lists(), [(x, None, False) for x in GRID])
    return swept.select("threshold", "macro_f05", "n_pred")


def threshold_search(spark, d):
    return m.optimise_threshold(Stages(spark, d).lists())


def uniqueness_gate(spark, d):
    return m.uniqueness_gate(Stages(spark, d).lists(), THRESHOLD)


def tune(spark, d):
    """Threshold and uniqueness on the blended scores."""
    s = Stages(spark, d)
    return m.sweep(s.lists(s.blended().withColumn("p", F.col("blended"))), m.TUNED).select("threshold", "unique", "macro_f05", "n_pred")


def _fold():
    return learning.fold_of(F.col("s1_id"))


def two_fold_gate(spark, d):
    s = Stages(spark, d)
    return m.two_fold_gate({"plain": s.lists(), "blend": s.lists(s.blended().withColumn("p", F.col("blended")))}, _fold())


def stage2_gate(spark, d):
    """The blend against the second-stage model, each half judged by a model of the other half."""
    s = Stages(spark, d)
    second = learning.stage2(learning.stage2_features(s.blended()), s.truth())
    return m.two_fold_gate({"blend": s.lists(s.blended().withColumn("p", F.col("blended"))), "stage2": s.lists(second.withColumn("p", F.col("p2")))}, _fold(), 0.001)


def overlay_decisions(spark, d):
    """Plain decisions, with those of the entities that have second scores replaced by the blend's."""
    s = Stages(spark, d)
    blended = s.blended().withColumn("p", F.col("blended"))
    new = m.decide(blended, THRESHOLD, unique=True).select(*KEY, "p")
    return m.overlay(_decided(spark, d, unique=True), new, s.blended().where("second is not null").select("s1_id")).select(*KEY, "p")


def error_attribution(spark, d):
    """Misses by the step that lost them; false positives by whose record it is: another's, a look-alike with a near number, or nobody's."""
    s = Stages(spark, d)
    claims = s.claims(THRESHOLD)
    found = m.decide(claims.select(*KEY, "p", "hit", "owner", "k_num_close"), THRESHOLD, unique=True)
    # The misses need no pairs: what is true, what of it compression kept and what of that was found are counts.
    total = s.true_counts().agg(F.coalesce(F.sum("n_true"), F.lit(0)).alias("n_true"))
    kept = claims.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("n_kept"))
    right = found.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))
    # One row on each side.
    missed = total.join(F.broadcast(kept)).join(F.broadcast(right))
    misses = F.explode(F.array(F.struct(F.lit("fn_blocking").alias("kind"), (F.col("n_true") - F.col("n_kept")).alias("n")), F.struct(F.lit("fn_matcher").alias("kind"), (F.col("n_kept") - F.col("n_found")).alias("n"))))
    register = s.sides()[0].select(F.col("country_norm").alias("country"), F.col("entity_id").alias("owner"), F.lit(True).alias("known")).distinct()
    false = found.where("hit = 0").join(register, ["country", "owner"], "left")
    kinds = false.select(F.when(F.col("known"), "fp_other_owner").when(F.col("k_num_close") > 0, "fp_sibling").otherwise("fp_unowned").alias("kind"))
    return missed.select(misses.alias("x")).select("x.*").where("n > 0").unionByName(kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


def matching_results(spark, d):
    """The decided matches of each S1 entity, from candidates over features and model to one owner a record."""
    return records.id_lists(Stages(spark, d).sides()[0], _decided(spark, d, unique=True), "matched_entity_ids")


# --- learned models ------------------------------------------------------------------------


def gbt_matcher(spark, d):
    s = Stages(spark, d)
    return learning.gbt_matcher(s.features(), s.truth())


def gbt_results(spark, d):
    """The decided matches by the boosted model in place of the linear one."""
    s = Stages(spark, d)
    return records.id_lists(s.sides()[0], m.decide(gbt_matcher(spark, d), THRESHOLD, unique=True), "matched_entity_ids")


def model_benchmark(spark, d):
    s = Stages(spark, d)
    return learning.model_benchmark(s.features(), s.truth(), s.universe())


_PLAIN = (
    raw_records, norm_record, legal_suffix, street_abbrev, digit_groups, countries, country_corpus, phonetic_skeleton, joint_skeleton, char_ngrams_df, url_tokens, name_key_counts, twin_counts,
    block_sizes, idf_vocab, index_stats, reverse_top3, reverse_capped, reverse_counts, candidate_union, candidate_union_all, sim_jaro_winkler, sim_levenshtein, sim_indel_family, cheap_rank, cheap_rank_weighted,
    compress_adaptive, candidate_pairs, budget_sweep, candidate_metrics, pair_features, split_buckets, split_files, first_queries, truth_in_corpus, training_truth, label_pairs, positive_rate, scored_pairs,
    pair_quality, ce_pair_text, ce_train_set, second_scores, second_scores_rest, blend_scores, blend_fit, anchors, stage2_group_stats, entity_f05, macro_f05, f05_loss, threshold_sweep, threshold_search,
    uniqueness_gate, tune, two_fold_gate, stage2_gate, overlay_decisions, error_attribution, matching_results, gbt_matcher, gbt_results, model_benchmark,
)
QUERIES = {f.__name__: f for f in _PLAIN}
QUERIES |= {f"block_{k}": partial(_block, kind=k) for k in ("exact_name", "core", "sorted", "postal_house")}
QUERIES |= {f"{n}_tokens": partial(_tokens, channel=c) for n, c in (("tok4", "R"), ("joint", "J"), ("addr_word", "E"), ("addr_ngram", "F"))}
QUERIES |= {f"topk_{n}": partial(_top, channel=c) for n, c in (("name_ngram", "D"), ("addr_word", "E"), ("addr_ngram", "F"), ("joint", "J"))}
QUERIES |= {f"feat_{n}": partial(_features, prefix=p) for n, p in (("name", ("n",)), ("address", ("a", "x")), ("retrieval", ("r", "rv", "s")), ("phonetic", ("k",)), ("corroboration", ("amb", "cor")))}
QUERIES |= {"decide_threshold": _decided, "decide_margin": partial(_decided, margin=0.1), "decide_unique": partial(_decided, unique=True)}
