"""LM scoring: a log-bilinear neural model over word classes, trained with noise-contrastive estimation.

The vocabulary is open and its counts cover every training document.  The most
frequent words (and the end) are classes of their own; every other word, known
or not, belongs to the class of its ending.  The probability of a token is

    P(class | two classes before) * P(word | class)

The first factor is the neural part: context vectors are added, multiplied
with the class vectors and normalised exactly (one batched matrix product over
all pairs of context classes gives every normaliser).  The second is the
smoothed share of the word among the training tokens of its class, with one
share left for all unknown words, so the probabilities of a context add up to 1.

On Spark: a pass over the texts writes blocks (a local vocabulary and token
numbers); the local vocabularies are counted by word and joined back; training
runs over all blocks in parallel from a common start and averages the
parameters; blocks and their counts are co-grouped for scoring.  Only class
parameters and class totals, whose number is a constant, reach the driver.

Defined cases: a null or empty text is one end token; repeated rows are scored
(and, outside the held-out fold, counted) one by one; a null id is scored and
falls into the fold of the empty text; bytes that are not UTF-8 are read as
U+FFFD; texts of any length are scored whole (a block ends after the text that
fills it); words of equal count are told apart by their letters when classes of
their own are given out; an empty table gives no rows; without
training tokens all classes are equally likely.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import common

END = "\n"  # cannot be a word
BLOCK_TOKENS = 2_000_000
OWN_CLASSES, ENDING_CLASSES = 384, 128
CLASSES = OWN_CLASSES + ENDING_CLASSES
START = CLASSES  # a context before the first token
DIM, NOISE, BATCH = 16, 32, 4096
START_STEPS, SMALL_BATCH = 3000, 512  # updates that fit the common start, and their size

BLOCK_SCHEMA = ("block bigint, tokens array<string>, train_counts array<bigint>, ids binary, n_ids bigint, "
                "doc_ids array<bigint>, held_out array<boolean>, lengths array<bigint>")


def blocks(docs: DataFrame, held_out, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of about ``block_tokens`` tokens: their distinct words, training counts and token numbers."""
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        hold = _Block()
        for batch in batches:
            texts = [t.encode() for t in common.texts(batch.column("text"))]
            for doc, held, raw in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), texts):
                hold.add(doc, held, raw)
                if hold.size >= block_tokens:
                    yield hold.row((part << 33) + made)
                    hold, made = _Block(), made + 1
        if hold.lengths:
            yield hold.row((part << 33) + made)

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out.alias("held"))
            .mapInArrow(run, BLOCK_SCHEMA))


class _Block:
    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.docs, self.held, self.lengths, self.size = [], [], [], 0
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.end = self.vocabulary[END.encode()]

    def add(self, doc, held: bool, raw: bytes) -> None:
        words = raw.lower().split()
        ids = np.empty(len(words) + 1, dtype=np.int32)
        ids[:-1] = np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.int32, count=len(words))
        ids[-1] = self.end
        self.ids.append(ids)
        self.docs.append(doc)
        self.held.append(held)
        self.lengths.append(len(ids))
        self.size += len(ids)

    def row(self, number: int) -> pa.RecordBatch:
        train = [i for i, h in zip(self.ids, self.held) if not h]
        n = np.bincount(np.concatenate(train), minlength=len(self.vocabulary)) if train else np.zeros(len(self.vocabulary), np.int64)
        packed = pa.compress(np.concatenate(self.ids).tobytes(), codec="zstd", asbytes=True)
        tokens = pa.array(list(self.vocabulary), pa.binary()).cast(pa.string())
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), lists(tokens, pa.string()), lists(n, pa.int64()), pa.array([packed], pa.binary()),
             pa.array([self.size]), lists(self.docs, pa.int64()), lists(self.held, pa.bool_()), lists(self.lengths, pa.int64())],
            ["block", "tokens", "train_counts", "ids", "n_ids", "doc_ids", "held_out", "lengths"])


def unpack(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(ids, decompressed_size=4 * n, codec="zstd"), dtype=np.int32)


def ending_class(token: str) -> int:
    """Class of a word without one of its own; the same as ``ending_class_column``."""
    return OWN_CLASSES + zlib.crc32(token[-3:].encode()) % ENDING_CLASSES


def ending_class_column(token):
    return (F.crc32(F.right(token, F.lit(3))) % ENDING_CLASSES + OWN_CLASSES).cast("int")


def contexts(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two before each token, START before a text's first token."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    one = np.empty_like(classes)
    two = np.empty_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[starts] = two[starts] = START
    second = starts + 1
    two[second[second < len(classes)]] = START  # a one-token text: the next start is set again below
    two[starts] = START
    return one, two


@dataclass
class Model:
    """Context vectors for both positions, class vectors, biases, and Adagrad's sums for each."""

    parts: list[np.ndarray]
    sums: list[np.ndarray]

    @staticmethod
    def start(noise: np.ndarray) -> Model:
        draw = np.random.default_rng(11)
        shape = [(CLASSES + 1, DIM), (CLASSES + 1, DIM), (CLASSES, DIM)]
        parts = [draw.normal(0, 0.1, s).astype(np.float32) for s in shape] + [np.log(noise).astype(np.float32)]
        return Model(parts, [np.full(p.shape, 1e-3, np.float32) for p in parts])

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    @staticmethod
    def of(flat: np.ndarray, sums: list[np.ndarray]) -> Model:
        parts, at = [], 0
        for s in sums:
            parts.append(np.asarray(flat[at:at + s.size], dtype=np.float32).reshape(s.shape))
            at += s.size
        return Model(parts, [s.copy() for s in sums])

    def learn(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, noise: np.ndarray, seed: int,
              rate: float = 0.08, size: int = BATCH) -> None:
        """One pass of noise-contrastive estimation: tell data from ``NOISE`` draws of the unigram shares."""
        draw = np.random.default_rng(seed)
        cdf, log_noise = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        order = draw.permutation(len(target))
        for at in range(0, len(order), size):
            rows = order[at:at + size]
            a, b, t = one[rows], two[rows], target[rows]
            wrong = np.minimum(np.searchsorted(cdf, draw.random(NOISE) * cdf[-1], side="right"), CLASSES - 1)
            A, B, R, bias = self.parts
            q = A[a] + B[b]
            Rt, Rw = R[t], R[wrong]
            dt = 1 - _sigmoid(np.einsum("ij,ij->i", q, Rt) + bias[t] - log_noise[t])
            dw = -_sigmoid(q @ Rw.T + bias[wrong] - log_noise[wrong])
            gq = dt[:, None] * Rt + dw @ Rw
            gR = _scatter(t, dt[:, None] * q, CLASSES)
            np.add.at(gR, wrong, dw.T @ q)
            gb = np.bincount(t, weights=dt, minlength=CLASSES)
            np.add.at(gb, wrong, dw.sum(axis=0))
            grads = [_scatter(a, gq, CLASSES + 1), _scatter(b, gq, CLASSES + 1), gR, gb.astype(np.float32)]
            for p, s, g in zip(self.parts, self.sums, grads):
                g = g / np.float32(len(rows))
                s += g * g
                p += np.float32(rate) * g / np.sqrt(s)

    def normalisers(self) -> np.ndarray:
        """log of the sum over classes of exp(score), for every pair of contexts (two before, one before)."""
        A, B, R, bias = self.parts
        out = np.empty((CLASSES + 1, CLASSES + 1), dtype=np.float32)
        for two in range(CLASSES + 1):
            s = (A + B[two]) @ R.T + bias
            top = s.max(axis=1)
            out[two] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return out

    def log10(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, log_z: np.ndarray) -> np.ndarray:
        """log10 of the class probabilities, in slices of bounded memory."""
        A, B, R, bias = self.parts
        out = np.empty(len(target), dtype=np.float64)
        for at in range(0, len(target), 100_000):
            a, b, t = one[at:at + 100_000], two[at:at + 100_000], target[at:at + 100_000]
            out[at:at + 100_000] = np.einsum("ij,ij->i", A[a] + B[b], R[t]) + bias[t] - log_z[b, a]
        return out / np.log(10)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    at = (rows[:, None].astype(np.int64) * DIM + np.arange(DIM)).ravel()
    return np.bincount(at, weights=values.ravel(), minlength=n * DIM).reshape(n, DIM).astype(np.float32)


def _train_rows(batch: pa.RecordBatch, own: dict[str, int]):
    """Class, contexts and length of the training tokens of each block in ``batch``."""
    for row in batch.to_pylist():
        of = np.fromiter((own[t] if t in own else ending_class(t) for t in row["tokens"]), dtype=np.int32, count=len(row["tokens"]))
        lengths = np.asarray(row["lengths"], dtype=np.int64)
        classes = of[unpack(row["ids"], row["n_ids"])]
        one, two = contexts(classes, lengths)
        train = np.repeat(~np.asarray(row["held_out"], dtype=bool), lengths)
        if train.any():
            yield one[train], two[train], classes[train], row["block"]


def train(table: DataFrame, own: dict[str, int], noise: np.ndarray, warm_blocks: int = 2) -> Model:
    """Fit the classes' vectors on all training tokens of ``table``.

    A task fits a common start with ``START_STEPS`` small updates on
    ``warm_blocks`` blocks; from it each task learns from its own blocks, and
    the mean of their parameters, weighted by tokens, is the model.  The means
    are taken by Spark, one row per parameter.
    """
    model = Model.start(noise)
    columns = ["block", "tokens", "ids", "n_ids", "held_out", "lengths"]
    sizes = model.sums

    def row(values: np.ndarray, seen: float) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * seen),
                                           pa.array(np.full(len(values), seen))], ["at", "value", "weight"])

    def begin(batches):
        data = [x for batch in batches for x in _train_rows(batch, own)]
        if not data:
            return
        one, two, target = (np.concatenate([d[i] for d in data]) for i in range(3))
        fresh = Model.of(model.flat(), sizes)
        draw, steps = np.random.default_rng(3), 0
        while steps < START_STEPS:
            some = draw.permutation(len(target))[:SMALL_BATCH * (START_STEPS - steps)]
            fresh.learn(one[some], two[some], target[some], noise, seed=steps, size=SMALL_BATCH)
            steps += -(-len(some) // SMALL_BATCH)
        yield row(np.concatenate([fresh.flat().astype(np.float64), *(s.ravel() for s in fresh.sums)]), 1.0)

    def learner(flat: np.ndarray, sums: list[np.ndarray]):
        def run(batches):
            mine, seen = Model.of(flat, sums), 0
            for batch in batches:
                for one, two, target, block in _train_rows(batch, own):
                    mine.learn(one, two, target, noise, seed=block % 2**31)
                    seen += len(target)
            if seen:
                yield row(mine.flat().astype(np.float64), float(seen))
        return run

    def mean(df: DataFrame) -> np.ndarray | None:
        rows = df.groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("v")).orderBy("at").toPandas()
        return rows["v"].to_numpy() if len(rows) else None

    schema = "at int, value double, weight double"
    some = [r["block"] for r in table.where(F.exists("held_out", lambda h: ~h)).select("block").orderBy("block").limit(warm_blocks).collect()]
    first = table.select(*columns).where(F.col("block").isin(some)).repartition(1)  # only these blocks move
    got = mean(first.mapInArrow(begin, schema))
    if got is None:
        return model
    at, warm = model.flat().size, []
    for s in sizes:
        warm.append(got[at:at + s.size].astype(np.float32).reshape(s.shape))
        at += s.size
    got = mean(table.select(*columns).mapInArrow(learner(got[:model.flat().size], warm), schema))
    return Model.of(got, sizes)


def score(docs: DataFrame, held_out, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    table = common.written(blocks(docs, held_out, block_tokens), "lm-blocks")
    words = table.select("block", F.posexplode(F.arrays_zip("tokens", "train_counts")).alias("pos", "w")) \
        .select("block", "pos", F.col("w.tokens").alias("token"), F.col("w.train_counts").alias("n"))
    counts = common.written(words.groupBy("token").agg(F.sum("n").alias("c")).where("c > 0"), "lm-counts")
    top = [r["token"] for r in counts.where(F.col("token") != END).orderBy(F.desc("c"), "token").limit(OWN_CLASSES - 1).collect()]
    own = {END: 0} | {t: i + 1 for i, t in enumerate(top)}
    own_rows = docs.sparkSession.createDataFrame(list(own.items()), "token string, own int")

    def classed(df: DataFrame) -> DataFrame:
        """``df`` with the class ``k`` of ``token``; the words with classes of their own are OWN_CLASSES rows at most."""
        return (df.join(F.broadcast(own_rows), "token", "left")
                .withColumn("k", F.coalesce("own", ending_class_column(F.col("token")))).drop("own"))

    totals = classed(counts).groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        n_class[r["k"]], v_class[r["k"]] = r["n"], r["v"]
    total, distinct = int(n_class.sum()), int(v_class.sum())
    noise = (n_class + 0.5) / (n_class + 0.5).sum()
    model = train(table, own, noise)
    log_z = model.normalisers()
    alone = np.zeros(CLASSES, dtype=bool)
    alone[list(own.values())] = True

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        pos, c = right.column("pos").to_numpy(), np.zeros(right.num_rows, dtype=np.int64)
        of = np.zeros(len(c), dtype=np.int32)
        c[pos], of[pos] = right.column("c").to_numpy(), right.column("k").to_numpy()
        ids, lengths = unpack(row["ids"], row["n_ids"]), np.asarray(row["lengths"], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        inside = np.where(alone[of], 0.0, np.log10((c + 0.5) / (n_class[of] + 0.5 * (v_class[of] + 1))))
        classes = of[ids]
        one, two = contexts(classes, lengths)
        p = model.log10(one, two, classes, log_z) + inside[ids]
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()),
                         "n_tokens": lengths, "n_known": np.add.reduceat((c > 0)[ids].astype(np.int64), starts),
                         "train_tokens": np.full(len(lengths), total, dtype=np.int64),
                         "base_score": np.add.reduceat(base[ids], starts), "score": np.add.reduceat(p, starts)})

    known = (classed(words.select("block", "pos", "token").join(counts, "token", "left"))
             .select(F.col("block").alias("of_block"), "pos", F.coalesce("c", F.lit(0)).alias("c"), "k"))
    texts = table.select("block", "ids", "n_ids", "doc_ids", "held_out", "lengths")
    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose crc32(doc_id) mod 5 is not 1."""
    common.ready(spark)
    return score(common.read(spark, sf_dir, "documents"), common.in_fold(F.col("doc_id"), 5, 1))
