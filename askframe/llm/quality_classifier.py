"""Quality classifier: a sparse rule ensemble over document statistics.

Boosted trees over a bounded labelled sample propose conjunctive rules (every
path from a root to a node), a lasso logistic fit keeps a few of them, and the
kept rules become one Spark column expression over the statistics' columns.

Defined cases: a null text counts as empty; an empty text has all statistics 0
and gets the score those give; repeated rows are scored one by one; an empty
table gives no rows; texts of any length are measured whole; rows with equal
statistics have equal scores; without labels of both classes every score is the smoothed
share of label 1.  Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import common, docstats, trees

STATS_SCHEMA = "doc_id bigint, " + ", ".join(f"s_{x} double" for x in docstats.FEATURES)


def text_statistics(docs: DataFrame, keep: str = "doc_id bigint") -> DataFrame:
    """Columns ``keep`` (names and types) and the statistics of ``text`` as ``s_*``."""
    kept = [x.split()[0] for x in keep.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [docstats.features(*docstats.profile(t or b""))
                    for t in batch.column("text").cast(pa.binary()).to_pylist()]
            X = np.asarray(rows, dtype=np.float64).reshape(-1, len(docstats.FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(x) for x in X.T.copy()],
                                             kept + [f"s_{x}" for x in docstats.FEATURES])

    schema = keep + ", " + STATS_SCHEMA.split(", ", 1)[1]
    return docs.select(*common.typed(keep), "text").mapInArrow(run, schema)


class RuleModel:
    """Intercept and weighted rules; a rule is a list of (feature, is_upper_bound, threshold)."""

    def __init__(self, bias: float, rules: list[tuple[float, list[tuple[int, bool, float]]]]):
        self.bias, self.rules = bias, rules

    def column(self, prefix: str = "s_") -> Column:
        """The score as a Spark expression over the statistics' columns."""
        z = F.lit(float(self.bias))
        for weight, rule in self.rules:
            met = F.lit(True)
            for f, upper, cut in rule:
                c = F.col(prefix + docstats.FEATURES[f])
                met = met & (c <= cut if upper else c > cut)
            z = z + F.when(met, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def score(self, X: np.ndarray) -> np.ndarray:
        z = np.full(len(X), self.bias)
        for weight, rule in self.rules:
            z += weight * _met(X, rule)
        return trees.sigmoid(z)


def _met(X: np.ndarray, rule) -> np.ndarray:
    met = np.ones(len(X), dtype=bool)
    for f, upper, cut in rule:
        met &= X[:, f] <= cut if upper else X[:, f] > cut
    return met


def tree_rules(model: trees.Trees) -> list[list[tuple[int, bool, float]]]:
    """Every path from a root to a node below it, tests on one feature merged, each rule once."""
    found: dict[tuple, None] = {}

    def walk(at: int, tests: dict):
        if tests:
            found[tuple(sorted((f, up, cut) for (f, up), cut in tests.items()))] = None
        if model.left[at] == at:
            return
        f, cut = model.feature[at], model.threshold[at]
        for child, up in ((model.left[at], True), (model.right[at], False)):
            old = tests.get((f, up), np.inf if up else -np.inf)
            walk(child, tests | {(f, up): min(cut, old) if up else max(cut, old)})

    for root in model.roots:
        walk(root, {})
    return [list(r) for r in found]


def lasso_logistic(A: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Weights of the logistic loss with an L1 penalty (accelerated proximal gradient); no penalty on the bias."""
    w = w / w.sum()
    scale = 0.25 * max(1e-12, float(np.linalg.eigvalsh((A * w[:, None]).T @ A)[-1]) + 1.0)
    mean = float(np.clip((w * y).sum(), 1e-6, 1 - 1e-6))
    x = np.zeros(A.shape[1] + 1)
    x[0] = np.log(mean / (1 - mean))
    fast, t = x.copy(), 1.0
    for _ in range(steps):
        r = w * (trees.sigmoid(fast[0] + A @ fast[1:]) - y)
        step = fast - np.concatenate([[r.sum()], A.T @ r]) / (2 * scale)
        step[1:] = np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - penalty / (2 * scale), 0)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        fast, x, t = step + (t - 1) / nxt * (step - x), step, nxt
    return float(x[0]), x[1:]


def fit_rules(X: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 2e-4) -> RuleModel:
    """Propose rules from a few seeded boosted trees, keep what the lasso keeps."""
    proposed = trees.boost(X, y, w, trees=24, depth=3, rate=0.3, share=0.6, min_rows=max(3, min(20, len(y) // 50)))
    rules = tree_rules(proposed)
    if not rules:
        return RuleModel(proposed.base, [])
    A = np.stack([_met(X, r) for r in rules], axis=1).astype(np.float64)
    bias, weight = lasso_logistic(A, y.astype(np.float64), w, penalty)
    return RuleModel(bias, [(float(v), r) for v, r in zip(weight, rules) if abs(v) > 1e-9])


def train(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = 12_000) -> RuleModel:
    """Fit on about ``max_rows`` labelled rows outside ``held_out`` (bounded, so it may reach the driver)."""
    sample = common.labelled_sample(docs, labels, "quality", held_out, max_rows)
    rows = text_statistics(sample, "doc_id bigint, y int, w double").orderBy("doc_id").toPandas()
    X = rows[[f"s_{x}" for x in docstats.FEATURES]].to_numpy(dtype=np.float64)
    return fit_rules(X, rows["y"].to_numpy(dtype=np.float64), rows["w"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: RuleModel, keep: str = "doc_id bigint") -> DataFrame:
    """``keep`` and ``score``: the probability of label 1 for every row of ``docs``."""
    kept = [x.split()[0] for x in keep.split(", ")]
    return text_statistics(docs, keep).select(*kept, model.column().alias("score"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    common.ready(spark)
    docs, held = common.read(spark, sf_dir, "documents"), common.in_fold(F.col("doc_id"), 5, 0)
    model = train(docs, common.read(spark, sf_dir, "labels"), held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score",
                                     (F.col("score") >= 0.3).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose score reaches 0.3, with their columns as they were."""
    common.ready(spark)
    model = train(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"),
                  common.in_fold(F.col("doc_id"), 5, 0))
    return keep_rows(docs, lambda t: model.score(
        np.asarray([docstats.features(*docstats.profile(x)) for x in t], dtype=np.float64)
        .reshape(-1, len(docstats.FEATURES))) >= 0.3)


def keep_rows(docs: DataFrame, keeps) -> DataFrame:
    """Rows of ``docs`` whose text ``keeps`` (list of UTF-8 texts -> booleans) accepts; all columns, no shuffle."""
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(np.asarray(keeps(texts), dtype=bool)))

    return docs.mapInArrow(run, docs.schema)
