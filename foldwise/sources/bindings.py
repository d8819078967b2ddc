"""The driver tables bound to the canonical tables of the library.

``cohort matrix``  customer left join orders: cohort = market segment, label = balance above 4500
``cell``           the matrix in long form, some values hidden by hash
``predictions``    two methods x two scenarios x five repeats of deterministic scores
``holdout``        25 stratified splits with scores

The scores are hash-derived so that every operator over predictions can be checked without a fit;
the fitted plans (``foldwise.plans``) read the same matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalars import clean_id, hash_uniform
from foldwise.operators.rules import RULE_SCHEMA, resolve_rules
from foldwise.operators.resample import OUTER_REPEATS, OUTER_SPLITS, holdout_splits, stratified_folds

FEATURES = ["f_orders", "f_spend", "f_max", "f_bal", "f_pending", "f_void"]
# scenario, method, signal strength of the bound scores
SCORE_MODELS = [
    ("primary", "nested", 0.3),
    ("primary", "non_nested", 0.7),
    ("knn", "nested", 0.25),
    ("knn", "non_nested", 0.65),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Wide cohort matrix: cohort, id, y and six features (one of them always missing)."""
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("o_totalprice"), 2).alias("spend"),
        F.max("o_totalprice").alias("top"),
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
    )
    customer = table(spark, folder, "customer")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left").select(
        F.col("c_mktsegment").alias("cohort"),
        F.col("c_custkey").cast("string").alias("id"),
        (F.col("c_acctbal") > 4500).cast("int").alias("y"),
        F.coalesce("n", F.lit(0)).cast("double").alias("f_orders"),
        F.col("spend").alias("f_spend"),
        F.col("top").alias("f_max"),
        F.col("c_acctbal").alias("f_bal"),
        F.coalesce("pending", F.lit(0)).cast("double").alias("f_pending"),
        F.lit(None).cast("double").alias("f_void"),
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """cohort, id, y: the orders table is pruned from this plan."""
    return table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("cohort"),
        F.col("c_custkey").cast("string").alias("id"),
        (F.col("c_acctbal") > 4500).cast("int").alias("y"),
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """cohort, id, feature, value; one sixteenth of the values is hidden by hash."""
    long = matrix(spark, folder).unpivot(["cohort", "id"], FEATURES, "feature", "value")
    hidden = F.substring(F.md5(F.concat(F.lit("miss"), "feature", "id")), 1, 1) == "0"
    return long.withColumn("value", F.when(~hidden, F.col("value")))


def folds(spark: SparkSession, folder: str) -> DataFrame:
    """cohort, id, y, repeat, outer_fold."""
    return stratified_folds(
        samples(spark, folder), ["cohort"], "repeat", "outer_fold", OUTER_SPLITS, OUTER_REPEATS, "outer"
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """cohort, scenario, method, id, repeat, outer_fold, y_true, p."""
    models = F.array(
        *[
            F.struct(F.lit(s).alias("scenario"), F.lit(m).alias("method"), F.lit(g).alias("gain"))
            for s, m, g in SCORE_MODELS
        ]
    )
    return (
        folds(spark, folder)
        .withColumn("m", F.explode(models))
        .select(
            "cohort",
            F.col("m.scenario").alias("scenario"),
            F.col("m.method").alias("method"),
            "id",
            "repeat",
            "outer_fold",
            F.col("y").alias("y_true"),
            _score(F.col("m.gain"), "pred", F.col("m.scenario"), F.col("m.method"), F.col("repeat")).alias("p"),
        )
    )


def holdout(spark: SparkSession, folder: str) -> DataFrame:
    """cohort, id, split, split_role, subset, y_true, p."""
    return holdout_of(samples(spark, folder))


def source_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a rare label, one cohort per source."""
    rows = table(spark, folder, "documents").select("doc_id", F.col("source").alias("cohort"))
    return (
        rows.join(table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")
        .where(F.col("cohort").isNotNull() & F.col("y").isNotNull())
        .select("cohort", F.col("doc_id").cast("string").alias("id"), "y")
    )


def holdout_of(rows: DataFrame) -> DataFrame:
    """Holdout splits of (cohort, id, y) with a score for every row of every split."""
    return holdout_splits(rows, ["cohort"]).select(
        "cohort",
        "id",
        "split",
        "split_role",
        "subset",
        F.col("y").alias("y_true"),
        _score(F.lit(0.4), "hold", F.col("split")).alias("p"),
    )


def _score(gain, purpose, *parts):
    label = F.col("y") * 2 - 1
    z = gain * label + 4.0 * (hash_uniform(purpose, *parts, F.col("id")) - 0.5)
    return F.round(1.0 / (1.0 + F.exp(-z)), 4)


def noisy(labelled: DataFrame) -> DataFrame:
    """Three sixteenths of the labels turned by hash: fits see a label that no feature determines."""
    turned = F.substring(F.md5(F.concat(F.lit("noise"), "id")), 1, 1) < "3"
    return labelled.withColumn("y", F.when(turned, 1 - F.col("y")).otherwise(F.col("y")))


# Text staging: the matrix as it could arrive in text files ---------------------------------------

PADDED = [f" {f} " for f in FEATURES]
_MISSING_FORMS = [("3", "NA"), ("7", " n/a "), ("b", "")]
_POSITIVE_FORMS = [("3", "Responder"), ("7", "1"), ("b", " R "), ("f", "positive")]
_NEGATIVE_FORMS = [("3", "Non_Responder"), ("7", "0"), ("b", "NR"), ("f", "false")]


def _by_digit(digit, forms, default=None):
    out = None
    for last, text in forms:
        out = F.when(digit <= last, text) if out is None else out.when(digit <= last, text)
    return out if default is None else out.otherwise(default)


def _digit(purpose, *parts, n=1):
    return F.substring(F.md5(F.concat(F.lit(purpose), *parts)), 1, n)


def staging(spark: SparkSession, folder: str) -> DataFrame:
    """cohort, raw_id, raw_label and one text column per feature, with padded headers."""
    m = matrix(spark, folder)

    def token(f):
        name, bad = F.lit(f), _digit("bad", F.lit(f), F.col("id"), n=2)
        hidden = F.col(f).isNull() | (_digit("miss", name, F.col("id")) == "0")
        return (
            F.when(hidden, _by_digit(_digit("tok", name, F.col("id")), _MISSING_FORMS))
            .when(bad == "00", "abc")
            .when(bad == "01", "Infinity")
            .otherwise(F.col(f).cast("decimal(18,2)").cast("string"))
        )

    id_digit, label_digit = _digit("id", F.col("id")), _digit("label", F.col("id"))
    unclear = _digit("unclear", F.col("id"), n=2) == "00"
    return m.select(
        "cohort",
        F.when(id_digit == "0", F.concat("id", F.lit(".0")))
        .when(id_digit == "1", F.concat(F.lit(" "), "id", F.lit(" ")))
        .otherwise(F.col("id"))
        .alias("raw_id"),
        F.when(unclear, "unclear")
        .when(F.col("y") == 1, _by_digit(label_digit, _POSITIVE_FORMS))
        .otherwise(_by_digit(label_digit, _NEGATIVE_FORMS))
        .alias("raw_label"),
        *[token(f).alias(p) for f, p in zip(FEATURES, PADDED)],
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """The staged matrices dealt into batches by hash; half of the batches are sound, some hold samples twice."""
    owner = clean_id("raw_id")
    rows = staging(spark, folder).withColumn("batch", _digit("batch", owner))
    unit = (F.col("cohort"), F.col("batch"))
    sound = _digit("fault", *unit) > "7"
    twice = (_digit("twin", *unit) == "0") & (_digit("again", owner) < "4")
    return rows.select(
        "cohort",
        "batch",
        "raw_id",
        F.when(sound & (F.col("raw_label") == "unclear"), "0").otherwise(F.col("raw_label")).alias("raw_label"),
        *[F.when(sound & F.col(p).isin("abc", "Infinity"), "NA").otherwise(F.col(p)).alias(p) for p in PADDED],
        F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def arrival_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths as files could be named on arrival: unknown time points, numbers out of range, padded numbers."""
    nation = F.col("c_nationkey")
    stage = F.element_at(F.array(*map(F.lit, ("pre", "post1", "post2", "mid"))), (nation % 4 + 1).cast("int"))
    stem = F.when(nation % 5 == 0, "Dataset0").otherwise("dataset")
    path = F.concat(F.lit("in/"), "c_mktsegment", F.lit("/"), stem, (nation % 9).cast("string"), F.lit("_"), stage, F.lit(".csv"))
    return table(spark, folder, "customer").select(path.alias("path")).distinct()


# Rule tables of the bound cohorts (fixed configuration) ------------------------------------------

def named_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("F_Bal", "identity", False, False, False, "derived_log10_ratio")], f"feature string, {RULE_SCHEMA}"
    )


def rule_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            ("BUILDING", " f_pending", "log1p", False, True, False, "linear"),
            ("MACHINERY", "F_ORDERS ", "identity", False, False, False, "linear"),
        ],
        f"cohort string, feature string, {RULE_SCHEMA}",
    )


def input_scales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("FURNITURE", "log10")], "cohort string, input_scale string")


def feature_names(spark: SparkSession, folder: str) -> DataFrame:
    """(cohort, feature) present in the matrix."""
    cohorts = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("cohort")).distinct()
    return cohorts.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in FEATURES])))


def rules(spark: SparkSession, folder: str, scale_aware: bool = False) -> DataFrame:
    return resolve_rules(
        feature_names(spark, folder),
        named_rules(spark),
        rule_overrides(spark),
        input_scales(spark) if scale_aware else None,
    )


def label_variants(spark: SparkSession, folder: str) -> DataFrame:
    """cohort, id, variant, y: a middle band is excluded, counted as negative, or as positive."""
    balance = F.col("c_acctbal")
    stable = (balance > 3500) & (balance <= 4500)
    one = lambda name, label: F.struct(F.lit(name).alias("variant"), label.cast("int").alias("y"))
    variants = F.array(
        one("primary", F.when(~stable, balance > 4500)),
        one("stable_as_negative", balance > 4500),
        one("stable_as_positive", balance > 3500),
    )
    return (
        table(spark, folder, "customer")
        .select(F.col("c_mktsegment").alias("cohort"), F.col("c_custkey").cast("string").alias("id"), F.explode(variants).alias("v"))
        .select("cohort", "id", "v.*")
        .where(F.col("y").isNotNull())
    )
