"""Quality classifier: a sparse rule ensemble.

A forest of shallow trees on text statistics proposes rules: every path from a root to a node is a
conjunction of comparisons. Logistic regression with an L1 penalty weighs the rules, most get weight zero,
and what is left is compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.words import SPACED, chunks, session_limits, split_words, utf8
from foldwise.session import settle

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "sign", "bar", "bang", "mark", "beyond_ascii", "space",
    "distinct", "repeated", "same_pairs", "sign_ends", "stop_ends", "words_per_line", "repeated_lines",
)
TREES = 24
DEPTH = 3
PENALTY = 0.0005
Rule = tuple[tuple[int, str, float], ...]


def _share(a, b) -> np.ndarray:
    return a / np.maximum(b, 1)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text; all zero for an empty text."""
    out = []
    for x, y in chunks(texts):
        part = texts[x:y]
        words = split_words(part, SPACED)
        n_words = np.diff(words.first)
        edge = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in part], out=edge[1:])
        raw = np.frombuffer(words.data, np.uint8)
        size = np.diff(edge) - 1

        def count(low: int, high: int | None = None) -> np.ndarray:
            hit = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw >= low) & (raw <= (high or low)), out=hit[1:])
            return hit[edge[1:] - 1] - hit[edge[:-1]]

        upper, lower, digit = count(65, 90), count(97, 122), count(48, 57)
        sign = count(33, 47) + count(58, 64) + count(91, 96) + count(123, 126)

        def per_text(flag: np.ndarray) -> np.ndarray:
            return np.bincount(words.text_of[flag], minlength=len(part)) if len(words) else np.zeros(len(part), np.int64)

        last = raw[words.end - 1] if len(words) else np.zeros(0, np.uint8)
        letter = ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | ((last >= 48) & (last <= 57)) | (last >= 128)
        stop = (last == 46) | (last == 44)
        same = np.zeros(len(words), bool)
        same[1:] = (words.names[1:] == words.names[:-1]) & (words.text_of[1:] == words.text_of[:-1]) if len(words) else False
        order = np.lexsort((words.names, words.text_of)) if len(words) else np.zeros(0, np.int64)
        new = np.ones(len(words), bool)
        new[1:] = (words.names[order][1:] != words.names[order][:-1]) | (words.text_of[order][1:] != words.text_of[order][:-1])
        distinct = np.bincount(words.text_of[order][new], minlength=len(part)) if len(words) else np.zeros(len(part))
        pair = words.names[:-1] * np.uint64(3) + words.names[1:] if len(words) > 1 else np.zeros(0, np.uint64)
        inner = words.text_of[:-1] == words.text_of[1:] if len(words) > 1 else np.zeros(0, bool)
        o2 = np.lexsort((pair[inner], words.text_of[:-1][inner])) if len(words) > 1 else np.zeros(0, np.int64)
        p2, t2 = (pair[inner][o2], words.text_of[:-1][inner][o2]) if len(words) > 1 else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        again = np.zeros(len(p2), bool)
        again[1:] = (p2[1:] == p2[:-1]) & (t2[1:] == t2[:-1])
        lines = [[s for s in t.split(b"\n") if s.strip()] for t in part]
        n_lines = np.array([len(s) for s in lines])
        out.append(np.stack([
            np.log1p(np.maximum(size, 0)), np.log1p(n_words), _share(np.bincount(words.text_of, words.end - words.start, minlength=len(part)) if len(words) else n_words, n_words),
            _share(upper, upper + lower), _share(digit, size), _share(sign, size), _share(count(124), size), _share(count(33), size),
            _share(count(35, 38) + count(42), size), _share(count(128, 255), size), _share(count(9, 13) + count(32), size),
            _share(distinct, n_words), _share(per_text(same), n_words), _share(np.bincount(t2[again], minlength=len(part)), n_words),
            _share(per_text(~letter & ~stop), n_words), _share(per_text(stop), n_words), _share(n_words, n_lines),
            _share(n_lines - np.array([len(set(s)) for s in lines]), n_lines),
        ], axis=1).astype(float))
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


def with_statistics(docs: DataFrame, text_col: str = "text", into: str = "stats") -> DataFrame:
    """Add a struct of STATISTICS; a null text counts as empty."""
    session_limits(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(statistics([utf8(t) for t in texts]), columns=list(STATISTICS))

    return docs.withColumn(into, measure(F.col(text_col)))


def paths(tree: str) -> list[Rule]:
    """Every path of a printed tree, as comparisons (statistic, sign, threshold)."""
    found, stack = [], []
    for line in tree.splitlines():
        hit = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if hit:
            depth = len(hit[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, (int(hit[2]), hit[3], float(hit[4]))))
            found.append(tuple(c for _, c in stack))
    return found


def condition(rule: Rule, column) -> Column:
    return reduce(
        lambda a, b: a & b,
        [(column(STATISTICS[i]) <= t if sign == "<=" else column(STATISTICS[i]) > t) for i, sign, t in rule],
    )


def fit_rules(measured: DataFrame, label_col: str = "label", stats_col: str = "stats", order_col: str = "doc_id") -> tuple[float, list[tuple[float, Rule]]]:
    """Bias and weighted rules from all rows of ``measured`` with label 0 or 1.

    Without rows, or with one label only, there is no rule and the bias is the smoothed share's logit.
    """
    rows = settle(
        measured.filter(F.col(label_col).isin(0, 1))
        .select(order_col, F.col(label_col).cast("double").alias("label"), *[F.col(stats_col)[s].alias(s) for s in STATISTICS])
        .sortWithinPartitions(order_col, *STATISTICS)
    )
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if positive in (0, n):
        return bias, []
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="onethird", subsamplingRate=0.8, minInstancesPerNode=5).fit(vectors)
    rules = list(dict.fromkeys(p for tree in forest.trees for p in paths(tree.toDebugString)))
    if not rules:
        return bias, []
    flags = rows.select("label", *[condition(r, F.col).cast("double").alias(f"r{j}") for j, r in enumerate(rules)])
    flags = VectorAssembler(inputCols=[f"r{j}" for j in range(len(rules))], outputCol="features").transform(flags)
    model = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=40, standardization=False).fit(flags.select("label", "features"))
    weights = model.coefficients.toArray()
    return float(model.intercept), [(float(w), r) for w, r in zip(weights, rules) if w]


def rule_score(bias: float, rules: list[tuple[float, Rule]], stats_col: str = "stats") -> Column:
    """The fitted rules as one column expression between 0 and 1."""
    column = lambda s: F.col(stats_col)[s]
    total = reduce(lambda a, b: a + b, [F.when(condition(r, column), F.lit(w)).otherwise(0.0) for w, r in rules], F.lit(bias))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, stats, score) for every row; only labels of rows with ``train`` are learned from.

    Statistics see the text alone. Empty and null texts have a score like any other; null labels are left
    out; rows that repeat an id have a score each.
    """
    measured = settle(with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), "__text").select("doc_id", "stats"))
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("label"))
    learned = measured.filter(train).join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "label", "stats")
    bias, rules = fit_rules(learned)
    return measured.select("doc_id", "stats", rule_score(bias, rules).alias("score"))
