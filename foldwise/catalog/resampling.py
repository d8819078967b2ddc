"""Queries over sample sizes, folds, holdout splits and class weights."""

from pyspark.sql import functions as F

from foldwise.catalog.oracle import folds_sql
from foldwise.catalog.registry import register
from foldwise.operators import resample
from foldwise.sources import bindings as b

INNER = {
    "b_train": """
SELECT s.cohort, s.id, s.y, s.repeat, f.outer_fold
FROM b_fold s JOIN (SELECT DISTINCT cohort, repeat, outer_fold FROM b_fold) f
  ON s.cohort = f.cohort AND s.repeat = f.repeat AND s.outer_fold <> f.outer_fold""",
    "b_inner": folds_sql(
        "b_train", "cohort, repeat, outer_fold", "inner_repeat", "inner_fold", 3, 5,
        "'inner|' || repeat || '|' || outer_fold",
    ),
}


@register("fold_assignment", "R1 W9", "SELECT cohort, id, y, repeat, outer_fold FROM b_fold")
def fold_assignment(spark, folder):
    return b.folds(spark, folder)


@register(
    "fold_feasibility",
    "R1",
    """
SELECT lang AS cohort, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positive,
       CAST(count(*) - sum(toxic) AS BIGINT) AS negative,
       CASE WHEN least(sum(toxic), count(*) - sum(toxic)) >= 2
            THEN CAST(least(sum(toxic), count(*) - sum(toxic), 5) AS BIGINT) END AS splits,
       CASE WHEN least(sum(toxic), count(*) - sum(toxic)) < 2 THEN 'minority_below_2'
            WHEN least(sum(toxic), count(*) - sum(toxic)) < 5 THEN 'reduced' ELSE 'ok' END AS status
FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def fold_feasibility(spark, folder):
    rare = (
        b.table(spark, folder, "documents")
        .select("doc_id", "lang")
        .join(b.table(spark, folder, "labels"), "doc_id")
        .select(F.col("lang").alias("cohort"), F.col("toxic").alias("y"))
    )
    plan = resample.feasible_splits(rare, ["cohort"], resample.OUTER_SPLITS)
    return plan.withColumn(
        "status",
        F.when(F.col("splits").isNull(), "minority_below_2")
        .when(F.col("splits") < resample.OUTER_SPLITS, "reduced")
        .otherwise("ok"),
    )


@register(
    "rare_label_folds",
    "R1",
    """
SELECT cohort, repeat, outer_fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS positive
FROM b_rare_fold GROUP BY ALL""",
    {
        "b_rare": "SELECT lang AS cohort, CAST(doc_id AS VARCHAR) AS id, toxic AS y FROM documents JOIN labels USING (doc_id)",
        "b_rare_fold": folds_sql("b_rare", "cohort", "repeat", "outer_fold", 5, 5, "'outer'"),
    },
)
def rare_label_folds(spark, folder):
    """Folds for imbalanced cohorts: fewer splits where the minority is small, none below two."""
    rare = (
        b.table(spark, folder, "documents")
        .select("doc_id", "lang")
        .join(b.table(spark, folder, "labels"), "doc_id")
        .select(F.col("lang").alias("cohort"), F.col("doc_id").cast("string").alias("id"), F.col("toxic").alias("y"))
    )
    plan = resample.stratified_folds(rare, ["cohort"], "repeat", "outer_fold", 5, 5, "outer")
    return plan.groupBy("cohort", "repeat", "outer_fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positive")
    )


@register(
    "inner_fold_assignment",
    "R3",
    "SELECT cohort, repeat, outer_fold, inner_repeat, inner_fold, id, y FROM b_inner",
    INNER,
)
def inner_fold_assignment(spark, folder):
    return resample.inner_folds(b.folds(spark, folder), ["cohort"])


@register(
    "holdout_assignment",
    "R2 R4",
    "SELECT cohort, split, split_role, id, subset, y_true FROM b_hold",
)
def holdout_assignment(spark, folder):
    return resample.holdout_splits(b.samples(spark, folder), ["cohort"]).withColumnRenamed("y", "y_true")


@register(
    "holdout_split_checks",
    "R4",
    """
SELECT cohort, split, count(*) AS n, count(DISTINCT id) AS ids,
       count(*) FILTER (subset = 'test') AS test_n,
       CAST(sum(y_true) FILTER (subset = 'test') AS BIGINT) AS test_positive,
       CAST(sum(y_true) FILTER (subset = 'train') AS BIGINT) AS train_positive
FROM b_hold GROUP BY ALL""",
)
def holdout_split_checks(spark, folder):
    plan = resample.holdout_splits(b.samples(spark, folder), ["cohort"])
    test = F.col("subset") == "test"
    per_id = plan.groupBy("cohort", "split", "id").agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(test).alias("t"),
        F.sum(F.when(test, F.col("y")).otherwise(0)).alias("tp"),
        F.sum(F.when(~test, F.col("y")).otherwise(0)).alias("rp"),
    )
    return per_id.groupBy("cohort", "split").agg(
        F.sum("c").alias("n"),
        F.count(F.lit(1)).alias("ids"),
        F.sum("t").alias("test_n"),
        F.sum("tp").alias("test_positive"),
        F.sum("rp").alias("train_positive"),
    )


@register(
    "class_counts",
    "A1",
    """SELECT cohort, count(*) AS n, CAST(sum(y) AS BIGINT) AS positive, CAST(count(*) - sum(y) AS BIGINT) AS negative
FROM b_sample GROUP BY cohort""",
)
def class_counts(spark, folder):
    return resample.class_counts(b.samples(spark, folder), ["cohort"])


COUNTS = {
    "b_counts": """
SELECT f.cohort, f.repeat, f.outer_fold,
       count(*) FILTER (s.outer_fold <> f.outer_fold) AS train_n,
       CAST(sum(y) FILTER (s.outer_fold <> f.outer_fold) AS BIGINT) AS train_positive,
       CAST(sum(1 - y) FILTER (s.outer_fold <> f.outer_fold) AS BIGINT) AS train_negative,
       count(*) FILTER (s.outer_fold = f.outer_fold) AS test_n,
       CAST(sum(y) FILTER (s.outer_fold = f.outer_fold) AS BIGINT) AS test_positive,
       CAST(sum(1 - y) FILTER (s.outer_fold = f.outer_fold) AS BIGINT) AS test_negative
FROM (SELECT DISTINCT cohort, repeat, outer_fold FROM b_fold) f JOIN b_fold s USING (cohort, repeat) GROUP BY ALL"""
}


@register("outer_fold_counts", "A2", "SELECT * FROM b_counts", COUNTS)
def outer_fold_counts(spark, folder):
    return resample.fold_counts(b.folds(spark, folder), ["cohort", "repeat"], "outer_fold")


@register(
    "inner_fold_counts",
    "A2",
    """
SELECT cohort, repeat, outer_fold, inner_repeat, inner_fold,
  CAST(sum(n) OVER w - n AS BIGINT) AS train_n, CAST(sum(pos) OVER w - pos AS BIGINT) AS train_positive,
  CAST(sum(n - pos) OVER w - (n - pos) AS BIGINT) AS train_negative,
  n AS test_n, pos AS test_positive, n - pos AS test_negative
FROM (SELECT cohort, repeat, outer_fold, inner_repeat, inner_fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM b_inner GROUP BY ALL)
WINDOW w AS (PARTITION BY cohort, repeat, outer_fold, inner_repeat)""",
    INNER,
)
def inner_fold_counts(spark, folder):
    inner = resample.inner_folds(b.folds(spark, folder), ["cohort"])
    return resample.fold_counts(inner, ["cohort", "repeat", "outer_fold", "inner_repeat"], "inner_fold")


@register(
    "class_weights",
    "A3",
    """
SELECT cohort, repeat, outer_fold, train_n, round(train_n / (2.0e0 * train_positive), 8) AS weight_positive,
       round(train_n / (2.0e0 * train_negative), 8) AS weight_negative FROM b_counts""",
    COUNTS,
)
def class_weights(spark, folder):
    counts = resample.fold_counts(b.folds(spark, folder), ["cohort", "repeat"], "outer_fold")
    one, zero = resample.balanced_weights("train_n", "train_positive", "train_negative")
    return counts.select(
        "cohort",
        "repeat",
        "outer_fold",
        "train_n",
        F.round(one, 8).alias("weight_positive"),
        F.round(zero, 8).alias("weight_negative"),
    )
