"""The pair features, in contract order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.similarity import similarities

from . import matching as m

# The names and order of the features.
FEATURE_NAMES = """
n_exact_alnum n_exact_core n_exact_compact n_sorted_eq n_jaro_winkler n_ratio n_partial_ratio n_token_sort n_token_set
n_lev_norm n_prefix4 n_len_ratio n_tok_jaccard n_tok_containment n_rare_tok_overlap
a_exact a_ratio a_token_sort a_token_set a_jaro_winkler a_tok_jaccard a_tok_containment a_len_ratio a_house_match
a_postal_match a_digit_jaccard a_digit_overlap_n a_missing_q a_missing_c
x_name_x_addr x_name_plus_addr x_both_strong x_either_strong
r_n_channels r_exact_hash_hit r_d_score r_d_rank r_e_score r_e_rank r_g_hit r_rank_score r_cand_set_size
r_score_margin_top r_is_top1 s_is_s3 r_j_score r_j_rank
rv_hit rv_score rv_rank rv_margin rv_is_top1
k_name_jac k_addr_jac k_bigram_jac k_bigram_shared k_namepair_shared k_code_shared k_all_jac
k_num_jac k_num_s1_missing k_num_close
amb_s1_name_count amb_rec_name_count amb_rec_count_if_noaddr
cor_global_twin cor_local_twin cor_name_support cor_extra_num_support
""".split()
#: Features of edit similarities that SQL engines lack; the others need only native functions and Jaro-Winkler.
EDIT = ("n_ratio", "n_partial_ratio", "n_token_sort", "n_token_set", "a_ratio", "a_token_sort", "a_token_set")
PLAIN = [n for n in FEATURE_NAMES if n not in EDIT]
_EDIT_OF = {"ratio": "ratio", "partial_ratio": "partial_ratio", "token_sort": "token_sort_ratio", "token_set": "token_set_ratio"}


def _both(hit: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Jaccard and containment of token sets from what they share and their sizes; 0 when either is empty."""
    none, zero = (x == 0) | (y == 0), F.lit(0.0)
    return F.when(none, zero).otherwise(F.try_divide(hit, x + y - hit)), F.when(none, zero).otherwise(F.try_divide(hit, F.least(x, y)))


def _share(hit: Column, sizes: Column) -> Column:
    """Jaccard from what two sets share and the sum of their sizes; -1 when both are empty."""
    return F.when(sizes == 0, F.lit(-1.0)).otherwise(F.try_divide(hit, sizes - hit))


def _length_ratio(a: str, b: str) -> Column:
    x, y = F.length(a), F.length(b)
    return F.when((x == 0) | (y == 0), 0.0).otherwise(F.try_divide(F.least(x, y), F.greatest(x, y)))


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _close(a: Column, b: Column) -> Column:
    short = lambda xs: F.filter(xs, lambda x: F.length(x) <= 6)
    x, y = short(F.array_except(a, b)), short(F.array_except(b, a))
    return F.exists(x, lambda i: F.exists(y, lambda j: F.abs(i.cast("long") - j.cast("long")).between(1, 20)))


SIGNED = ("t", "n", "sorted", "a", "digits", "num", "_key")


#: Features that compare tokens of other kinds than the name's own.
OF_KINDS = {"k_addr_jac", "k_bigram_jac", "k_bigram_shared", "k_namepair_shared", "k_code_shared", "k_all_jac"}


def kinds_of(wanted: list[str]) -> tuple[str, ...]:
    """The kinds of tokens that these features compare."""
    return t.KINDS if OF_KINDS & set(wanted) else ("n",)


def signatures(records: DataFrame, kinds: tuple[str, ...] = t.KINDS) -> DataFrame:
    """What features compare, computed once a record: tokens by kind, word sets, numbers and keys."""
    by_kind = t.tok4_kinds(F.col("name_core"), F.col("addr_street")) if kinds == t.KINDS else F.struct(F.array_distinct(t.name_skeletons(F.col("name_core"))).alias("n"))
    words = lambda c: F.array_distinct(t.tokens(F.col(c)))
    return records.select(
        "entity_id", "country_norm", "tier", by_kind.alias("t"), words("name_core").alias("n"), F.array_join(F.array_sort(words("name_core")), " ").alias("sorted"),
        words("addr_street").alias("a"), F.filter(words("addr_street"), lambda x: x.rlike("^[0-9]+$")).alias("digits"),
        t.numbers(F.col("addr_street")).alias("num"), t.name_key(F.col("name_core")).alias("_key"), t.twin_key(F.col("name_core"), F.col("addr_street")).alias("twin"),
    )


def _number_support(base: DataFrame, extra: Column) -> DataFrame:
    """How many candidates of an entity carry a number beyond the entity's own that this one carries too."""
    by_number = base.select("country", "s1_id", "rec_id", F.explode(extra).alias("num"))
    other = by_number.select("country", "s1_id", F.col("rec_id").alias("o"), "num")
    return by_number.join(other, ["country", "s1_id", "num"]).where("o <> rec_id").groupBy("country", "s1_id", "rec_id").agg(F.countDistinct("o").alias("num_support"))


def pair_features(pairs: DataFrame, signed: DataFrame, wanted: list[str] = FEATURE_NAMES) -> DataFrame:
    """country, s1_id, rec_id and the features of compressed candidates (with texts and rank score), from ``signatures``.

    Joins, counts and similarities that no wanted feature needs are left out.
    """
    kinds = kinds_of(wanted)
    names = signed.where("tier = 1").groupBy(F.col("country_norm").alias("country"), F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("count"))
    count = lambda side: names.select("country", F.col("key").alias(side + "_key"), F.col("count").alias(side + "_count"))
    records = signed.where("tier > 1").withColumn("global_twin", F.count(F.lit(1)).over(Window.partitionBy("country_norm", "twin")) - 1)
    left = signed.where("tier = 1").select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias("q" + c) for c in SIGNED])
    right = records.select(F.col("entity_id").alias("rec_id"), *[F.col(c).alias("c" + c) for c in SIGNED], "twin", "global_twin")
    base = pairs.join(left, "s1_id").join(right, "rec_id")
    if any(n.startswith("amb_") for n in wanted):
        base = base.join(count("q"), ["country", "q_key"], "left").join(count("c"), ["country", "c_key"], "left")
    own = Window.partitionBy("country", "s1_id")
    extra = F.array_except("cnum", "qnum")
    if "cor_extra_num_support" in wanted:
        base = base.join(_number_support(base, extra), ["country", "s1_id", "rec_id"], "left")
    # What two sets share is counted once a pair; kinds of tokens by their letter, lists by their name.
    both = {**{f"kind_{k}": (F.col("qt")[k], F.col("ct")[k]) for k in kinds}, **{k: (F.col("q" + k), F.col("c" + k)) for k in ("n", "a", "digits", "num")}}
    first = base.withColumns({f"hit_{k}": F.size(F.array_intersect(x, y)) for k, (x, y) in both.items()} | {f"size_{s}_{k}": F.size(v) for k, xs in both.items() for s, v in zip("qc", xs, strict=True)})
    others = lambda *by: F.count(F.lit(1)).over(Window.partitionBy("country", "s1_id", *by)) - 1
    first = first.withColumns({
        "num_extra": F.size(extra), "num_close": _close(F.col("qnum"), F.col("cnum")), "top": F.max("rank_score").over(own), "set_size": F.count(F.lit(1)).over(own),
        "is_top1": F.row_number().over(own.orderBy(F.desc("rank_score"), "rec_id")) == 1, "local_twin": others("twin"), "name_support": others("c_key"),
    })
    # All similarities of a pair of strings come from one pass.
    first = first.withColumns({f"{x}_sims": similarities("jaro_winkler", *_edits(wanted)[x])(f"q_{c}", f"c_{c}") for x, c in _COMPARED.items()})
    return from_columns(first.withColumns({f"{x}_jaro": F.col(f"{x}_sims.jaro_winkler") for x in "na"}), wanted)


_COMPARED = {"n": "name_core", "a": "addr_street"}


def _edits(wanted: list[str]) -> dict[str, list[str]]:
    return {x: [n for f, n in _EDIT_OF.items() if f"{x}_{f}" in wanted] for x in "na"}


def with_edits(pairs: DataFrame, wanted: list[str]) -> DataFrame:
    """Pairs with the edit similarities that features want."""
    return pairs.withColumns({f"{x}_sims": similarities(*sims)(f"q_{_COMPARED[x]}", f"c_{_COMPARED[x]}") for x, sims in _edits(wanted).items() if sims})


def columns_of(wanted: list[str]) -> list[str]:
    """The columns that ``from_columns`` reads for some features (beside ``with_edits``)."""
    values = _values([])
    found = {x for n in wanted if n in values for x in re.findall(r"\w+", str(values[n])) if x in COLUMNS}
    return sorted(found | {f"{p}_{_COMPARED[x]}" for x, sims in _edits(wanted).items() if sims for p in "qc"})


#: What features are made of; ``tiles`` has the same columns.
COLUMNS = {
    *[f"{p}_{c}" for p in "qc" for c in ("name_alnum", "name_core", "addr_street", "house_number", "postal_code", "count")], *[f"{x}_{k}" for x in ("hit", "size_q", "size_c") for k in ("n", "a", "digits", "num", *[f"kind_{k}" for k in t.KINDS])],
    *m.EVIDENCE, "rank_score", "n_channels", "n_jaro", "a_jaro", "top", "is_top1", "set_size", "num_close", "num_extra", "num_support", "global_twin", "local_twin", "name_support",
}


def from_columns(first: DataFrame, wanted: list[str] = FEATURE_NAMES, also: tuple[str, ...] = ()) -> DataFrame:
    """The features from what is known of each pair by itself, and the columns ``also``."""
    full = first.withColumns({n: v for n, v in _values(wanted).items() if n in wanted})
    return full.select("country", "s1_id", "rec_id", *[F.round(F.col(n).cast("double"), 7).alias(n) for n in FEATURE_NAMES if n in wanted], *also)


def _values(wanted: list[str]) -> dict[str, Column]:
    q, c = (lambda x: F.col("q_" + x)), (lambda x: F.col("c_" + x))
    same = lambda x: (q(x) != "") & (q(x) == c(x))
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    # Kinds of tokens have no token in common, so all sets follow from what each kind shares.
    size = lambda k: F.col("size_q_" + k) + F.col("size_c_" + k)
    jac = lambda ks: _share(sum(F.col("hit_kind_" + k) for k in ks), sum(size("kind_" + k) for k in ks))
    longest = F.greatest(F.length("q_name_core"), F.length("c_name_core"))
    words = lambda x: _both(F.col("hit_" + x), F.col("size_q_" + x), F.col("size_c_" + x))
    (n_jac, n_con), (a_jac, a_con), (d_jac, _) = (words(x) for x in ("n", "a", "digits"))
    score = lambda x, default: F.coalesce(F.col(x), F.lit(float(default)))
    edit = {f"{x}_{f}": F.col(f"{x}_sims.{n}") for x in "na" for f, n in _EDIT_OF.items() if n in _edits(wanted)[x]}
    name, addr = F.col("n_jaro"), F.col("a_jaro")
    strong_n, strong_a = _flag(name > 0.90), _flag(addr > 0.85)
    return {
        "n_exact_alnum": _flag(same("name_alnum")), "n_exact_core": _flag(same("name_core")),
        "n_exact_compact": _flag((q("name_core") != "") & (bare(q("name_core")) == bare(c("name_core")))),
        "n_sorted_eq": _flag((F.col("size_q_n") > 0) & (F.col("hit_n") == F.col("size_q_n")) & (F.col("hit_n") == F.col("size_c_n"))),
        **edit, "n_jaro_winkler": name, "a_jaro_winkler": addr,
        "n_lev_norm": F.when((q("name_core") == "") | (c("name_core") == ""), 0.0).otherwise(1 - F.try_divide(F.levenshtein(q("name_core"), c("name_core")), longest)),
        "n_prefix4": _flag((q("name_core") != "") & (F.substring(q("name_core"), 1, 4) == F.substring(c("name_core"), 1, 4))),
        "n_len_ratio": _length_ratio("q_name_core", "c_name_core"), "n_tok_jaccard": n_jac, "n_tok_containment": n_con, "n_rare_tok_overlap": F.lit(0.0),
        "a_exact": _flag(same("addr_street")),
        "a_tok_jaccard": a_jac, "a_tok_containment": a_con, "a_len_ratio": _length_ratio("q_addr_street", "c_addr_street"),
        "a_house_match": _flag(same("house_number")), "a_postal_match": _flag(same("postal_code")),
        "a_digit_jaccard": d_jac, "a_digit_overlap_n": F.col("hit_digits"),
        "a_missing_q": _flag(q("addr_street") == ""), "a_missing_c": _flag(c("addr_street") == ""),
        "x_name_x_addr": name * addr, "x_name_plus_addr": name + addr,
        "x_both_strong": strong_n * strong_a, "x_either_strong": F.greatest(strong_n, strong_a),
        "r_n_channels": F.col("n_channels").cast("double"), "r_exact_hash_hit": _flag(F.coalesce("A", "B", "C").isNotNull()),
        "r_d_score": score("d_score", 0), "r_d_rank": score("d_rank", 999), "r_e_score": score("e_score", 0), "r_e_rank": score("e_rank", 999),
        "r_g_hit": _flag(F.col("G").isNotNull()), "r_rank_score": F.col("rank_score"), "r_cand_set_size": F.col("set_size"),
        "r_score_margin_top": F.col("rank_score") - F.col("top"), "r_is_top1": _flag(F.col("is_top1")), "s_is_s3": _flag(F.col("rec_id").startswith("S3")),
        "r_j_score": score("j_score", 0), "r_j_rank": score("j_rank", 999),
        "rv_hit": _flag(F.col("r_score").isNotNull()), "rv_score": score("r_score", 0), "rv_rank": score("r_rank", 99), "rv_margin": score("r_margin", -1), "rv_is_top1": _flag(F.col("r_rank") == 0),
        "k_name_jac": jac("n"), "k_addr_jac": jac("a"), "k_bigram_jac": jac("b"), "k_bigram_shared": F.col("hit_kind_b"), "k_namepair_shared": F.col("hit_kind_p"), "k_code_shared": F.col("hit_kind_c"),
        "k_all_jac": jac(t.KINDS), "k_num_jac": _share(F.col("hit_num"), size("num")),
        "k_num_s1_missing": F.when(F.col("size_q_num") == 0, -1.0).otherwise(F.try_divide(F.col("size_q_num") - F.col("hit_num"), F.col("size_q_num"))), "k_num_close": _flag(F.col("num_close")),
        "amb_s1_name_count": score("q_count", 0), "amb_rec_name_count": score("c_count", 0), "amb_rec_count_if_noaddr": F.when(c("addr_street") == "", score("c_count", 0)).otherwise(0.0),
        "cor_global_twin": F.col("global_twin"), "cor_local_twin": F.col("local_twin"),
        "cor_name_support": F.col("name_support"),
        "cor_extra_num_support": F.when(F.col("num_extra") == 0, -1.0).otherwise(score("num_support", 0)),
    }
