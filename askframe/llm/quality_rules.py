"""Quality rules: fixed base rules, then boosted trees over document statistics.

The trees are flattened into node arrays and score whole batches; the
probability of quality never rises with the share of symbols, repeated lines,
repeated windows or exclamation marks (monotone features).

Defined cases: a null text is an empty one (no words: the base rules fail it);
repeated rows are judged one by one; texts of any length are measured whole;
rows with equal statistics have equal verdicts; an empty table gives no rows; without
labels of both classes the verdict is the constant smoothed share.  Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import common, docstats, trees

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
NAMES = [*docstats.FEATURES, "repeat_share"]
FALLING = {NAMES.index(x): -1 for x in ("symbol_share", "bang_share", "dup_line_share", "repeat_share",
                                        "adjacent_share", "top_share")}
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F], dtype=np.uint64)  # odd multipliers, one per word of a window


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found at least twice.

    Windows are told apart by a mixed hash first; only where two hashes are
    equal are the words themselves compared.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        mixed += h[k:k + n] * MIX[k % len(MIX)]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, dtype=bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    first: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i in np.flatnonzero(maybe).tolist():
        window = tuple(words[i:i + size])
        j = first.setdefault(window, i)
        if j != i:
            for k in (i, j):
                covered[k] += 1
                covered[k + size] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measured(docs: DataFrame, keep: str = "doc_id bigint") -> DataFrame:
    """``keep``, the contract's counts and the trees' features (array ``x``) of every row."""
    kept = [c.split()[0] for c in keep.split(", ")]

    def run(batches):
        for batch in batches:
            counts, X = table_of([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(c) for c in counts.T.copy()] + [pa.array(x) for x in X.T.copy()],
                kept + COUNTS + [f"x_{n}" for n in NAMES])

    schema = ", ".join([keep, *(f"{c} bigint" for c in COUNTS), *(f"x_{n} double" for n in NAMES)])
    return docs.select(*common.typed(keep), "text").mapInArrow(run, schema)


def table_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows x ``COUNTS``) and features (rows x ``NAMES``) of texts."""
    counts, X = [], []
    for raw in texts:
        count, words = docstats.profile(raw)
        again = repeat_words(words)
        counts.append([*(count[c] for c in COUNTS[:4]), again])
        X.append([*docstats.features(count, words), again / max(1, len(words))])
    return (np.asarray(counts, dtype=np.int64).reshape(-1, len(COUNTS)),
            np.asarray(X, dtype=np.float64).reshape(-1, len(NAMES)))


def train(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = 12_000) -> trees.Trees:
    """Boosted trees on about ``max_rows`` labelled rows outside ``held_out``."""
    sample = common.labelled_sample(docs, labels, "quality", held_out, max_rows)
    rows = measured(sample, "doc_id bigint, y int, w double").orderBy("doc_id").toPandas()
    return trees.boost(rows[[f"x_{n}" for n in NAMES]].to_numpy(dtype=np.float64), rows["y"].to_numpy(dtype=np.float64),
                       rows["w"].to_numpy(dtype=np.float64), trees=40, depth=3, rate=0.2,
                       min_rows=max(3, min(20, len(rows) // 50)), monotone=FALLING)


def judge(docs: DataFrame, model: trees.Trees, threshold: float = 0.3) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept of every row."""
    names = ["doc_id", *COUNTS, "base_failed", "kept", "score"]

    def run(batches):
        for batch in batches:
            counts, X = table_of([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            n, again = counts[:, 0], counts[:, 4]
            failed = (n < 10) | (100 * again > 20 * n)
            score = trees.sigmoid(model.score(X))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts.T.copy()), pa.array(failed),
                 pa.array(~failed & (score >= threshold)), pa.array(score)], names)

    schema = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in COUNTS), "base_failed boolean", "kept boolean", "score double"])
    return docs.select(*common.typed("doc_id bigint"), "text").mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the counts, base_failed, kept and the trees' score."""
    common.ready(spark)
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs, common.read(spark, sf_dir, "labels"), common.in_fold(F.col("doc_id"), 5, 0))
    return judge(docs, model)
