"""Sources and sinks of records: TSV files, ground truth, and business records of the order tables.

The business records take whole fields. The clean register (tier 1) has one record for each
customer; each order and each supplier gives a noisy record (tiers 2 and 3), whose name and
address are miswritten in a way that its key decides. An order's record belongs to its
customer, a supplier's to nobody, so the truth is known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as t

RAW = "entity_id string, business_name string, business_address string, country string"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Raw records; no quoting, missing fields are empty, blank lines are dropped."""
    raw = spark.read.schema(RAW).option("sep", "\t").option("quote", "").option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in raw.columns])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, rec_id (null for an entity without matches)."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).where(~F.col("value").startswith("source1_entity_id")).where("value <> ''")
    ids = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: x != "")
    return rows.select(F.get(parts, F.lit(0)).alias("s1_id"), F.explode_outer(ids).alias("rec_id"))


def normalize(raw: DataFrame) -> DataFrame:
    """The nine normalised columns of raw records, and others that they carry."""
    name, addr = t.alnum_only(t.to_ascii(F.col("business_name"))), t.alnum_only(t.to_ascii(F.col("business_address")))
    other = [c for c in raw.columns if c not in ("entity_id", "business_name", "business_address", "country")]
    country = F.lower(F.regexp_replace("country", r"^\s+|\s+$", ""))
    base = raw.select("entity_id", country.alias("country_norm"), name.alias("name_alnum"), addr.alias("addr_alnum"), t.digit_groups(F.col("business_address")).alias("g"), *other)
    return base.select(
        "entity_id", "country_norm", "name_alnum", t.strip_legal_suffix(F.col("name_alnum")).alias("name_core"), "addr_alnum", t.norm_street(F.col("addr_alnum")).alias("addr_street"),
        t.house_number(F.col("g")).alias("house_number"), t.postal_code(F.col("g")).alias("postal_code"), F.array_join("g", " ").alias("digits"), *other,
    )


#: Fixed parts of the made-up business fields, by remainder of the key.
SUFFIXES = (" Pvt. Ltd.", " Inc", " LLC", " Company", "")
STREETS = ("Road", "Street", "Avenue", "Lane", "Park Road, Suite 5")


def tsv_records(spark: SparkSession, s1: str, others: list[str], truth: str | None = None) -> DataFrame:
    """Raw records of the clean register (tier 1) and other sources (tiers 2 and on), with the owner that the truth names."""
    parts = [read_tsv(spark, p).withColumn("tier", F.lit(tier)) for tier, p in enumerate([s1, *others], 1)]
    raw = reduce(DataFrame.unionByName, parts)
    if truth is None:
        return raw.withColumn("owner", F.lit(None).cast("string"))
    own = read_truth(spark, truth).where("rec_id is not null").groupBy(F.col("rec_id").alias("entity_id")).agg(F.min("s1_id").alias("owner"))
    return raw.join(own, "entity_id", "left")


def _choice(values: tuple[str, ...], key: str) -> str:
    return "case " + " ".join(f"when {key} % {len(values)} = {i} then '{v}'" for i, v in enumerate(values)) + " end"


def business_sql(key: str, kind: str, again: str) -> dict[str, str]:
    """SQL of the clean fields of a business; ``again`` is an engine's replacement of each digit's letter."""
    return {
        "stem": "coalesce(p_name, 'general') || ' ' || " + kind, "made": again, "suffix": _choice(SUFFIXES, key),
        "house": f"{key} * 7 % 997 + 1", "street": f"lower(coalesce(p_type, 'main')) || ' ' || {_choice(STREETS, key)}",
        "brand": "lower(replace(coalesce(p_brand, 'x'), '#', ' '))", "postal": f"10000 + {key} * 37 % 89999",
    }


MADE = "regexp_replace(translate(cast({0} * 37 % 9973 as string), '0123456789', 'bdfgklmnrt'), '(.)', '$1o')"
NAME = "stem || ' ' || made || suffix"
ADDRESS = "house || ' ' || street || ', ' || brand || ' ' || postal"
#: What an order's key does to the clean name and address; ``double`` and ``vowels`` differ between engines.
NAME_NOISE = (
    NAME, "{vowels}", "{double}", "made || ' ' || stem", f"upper({NAME})", f"replace(replace({NAME}, 'k', 'c'), 'f', 'ph')",
    "stem || suffix", f"replace({NAME}, 'o', 'ö') || ' लिमिटेड'",
)
ADDRESS_NOISE = (
    ADDRESS, "''", "(house + nudge) || ' ' || street || ', ' || brand || ' ' || postal", "house || ' ' || street || ', ' || brand || ' ' || (postal + nudge)",
    f"replace(replace(replace({ADDRESS}, 'Road', 'Rd'), 'Street', 'St'), 'Avenue', 'Ave')", "house || ' ' || street || ' ' || postal", f"{ADDRESS} || ' unit 12'", f"upper({ADDRESS})", ADDRESS,
)


def noise_sql(vowels: str, double: str) -> tuple[str, str]:
    """SQL of the miswritten name and address, by ``noise`` (the record's key)."""
    name = "case " + " ".join(f"when (noise * 7919 + 13) % 8 = {i} then " + x.format(vowels=vowels, double=double) for i, x in enumerate(NAME_NOISE)) + " end"
    return name, "case " + " ".join(f"when (noise * 104729 + 7) % 9 = {i} then {x}" for i, x in enumerate(ADDRESS_NOISE)) + " end"


def business_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with tier and the key of the owner (null: nobody's)."""
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    # nation has one row a country: a bounded broadcast.
    nation, part = F.broadcast(read("nation", "n_nationkey", "n_name")), read("part", "p_partkey", "p_name", "p_type", "p_brand")

    def fields(df: DataFrame, key: str, kind: str) -> DataFrame:
        placed = df.join(part, F.col(key) == F.col("p_partkey"), "left").join(nation, F.col("n") == F.col("n_nationkey"), "left")
        made = business_sql(key, kind, MADE.format(key))
        return placed.select(F.col(key).alias("key"), F.coalesce("n_name", F.lit("none")).alias("country"), *[F.expr(x).alias(c) for c, x in made.items()])

    customers = fields(read("customer", "c_custkey", F.col("c_nationkey").alias("n"), "c_mktsegment"), "c_custkey", "lower(coalesce(c_mktsegment, ''))")
    suppliers = fields(read("supplier", "s_suppkey", F.col("s_nationkey").alias("n")), "s_suppkey", "'supply'")
    clean = customers.select(F.concat(F.lit("S1_"), "key").alias("entity_id"), F.expr(NAME).alias("business_name"), F.expr(ADDRESS).alias("business_address"), F.concat(F.lit(" "), "country", F.lit(" ")).alias("country"), F.lit(1).alias("tier"), F.col("key").alias("owner"))
    orders = read("orders", F.col("o_orderkey").alias("noise"), F.col("o_custkey").alias("key")).join(customers, "key")
    orders = orders.withColumns({"tier": (F.col("noise") % 2 + 2).cast("int"), "owner": F.col("key"), "id": F.col("noise").cast("string")})
    unowned = suppliers.withColumns({"noise": F.col("key"), "tier": F.lit(3), "owner": F.lit(None).cast("long"), "id": F.concat(F.lit("U"), "key")})
    noisy = orders.unionByName(unowned.select(*orders.columns)).withColumn("nudge", F.col("noise") % 20 + 1)
    name, address = noise_sql("regexp_replace(" + NAME + ", '[aeiou]', '')", "regexp_replace(" + NAME + ", '([lnrst])', '$1$1')")
    noisy = noisy.select(F.concat(F.lit("S"), "tier", F.lit("_"), "id").alias("entity_id"), F.expr(name).alias("business_name"), F.expr(address).alias("business_address"), "country", "tier", "owner")
    return clean.unionByName(noisy)


def write_norm(df: DataFrame, path: str) -> None:
    df.write.partitionBy("country_norm").parquet(path)


def write_splits(universe: DataFrame, path: str) -> None:
    """The S1 ids as two tables, train and val, by bucket."""
    split = F.when(split_bucket(F.col("s1_id")) < 5, "val").otherwise("train")
    universe.select("s1_id", split.alias("split")).write.partitionBy("split").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as JSON lines."""
    df.coalesce(1).write.json(path)


def countries(*tables: DataFrame) -> DataFrame:
    """The countries of any of the tables."""
    return reduce(DataFrame.union, [t.select("country_norm") for t in tables]).distinct()


def write_id_lists(s1: DataFrame, matches: DataFrame, path: str, column: str, order: str = "entity_id") -> None:
    """One row for each S1 id, ids sorted and joined by commas, as TSV in the order of a column of ``s1``."""
    rows = id_lists(s1, matches, column).join(s1.groupBy(F.col("entity_id").alias("source1_entity_id")).agg(F.min(order).alias("_order")), "source1_entity_id")
    rows.orderBy("_order").drop("_order").write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def id_lists(s1: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    lists = matches.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("rec_id")), ",").alias(column))
    return s1.select(F.col("entity_id").alias("s1_id")).distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def split_bucket(entity_id) -> Column:
    """md5 bucket of 100; buckets 0 to 4 are held out."""
    return (F.conv(F.substring(F.md5(entity_id), 1, 8), 16, 10).cast("long") % 100).cast("int")


def first_rows(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The first n rows of each ``by``, in the order of a unique column."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def seeded_sample(df: DataFrame, n: int, by: str, key: list[str], seed: str) -> DataFrame:
    """n rows of each ``by`` without replacement, in the order of a seeded md5 of the key."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws("|", F.lit(seed), *key)), *key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
