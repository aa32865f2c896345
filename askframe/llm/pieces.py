"""SentencePiece encoding and decoding with seeded merge-dropout.

The merge table of a public SentencePiece model (type BPE, a file given by
path) is applied by an agenda: the best merge candidate of a word goes first,
and each candidate is skipped if a keyed hash of (seed, variant, word, place)
falls below the dropout rate.  Skipped merges give other segmentations of the
same text, and every one of them decodes to exactly that text.  A document's
variant is a hash of its id, so the same input always gives the same pieces.

All new words of a batch take part in the agenda at once: each round applies
the best candidate of every word with numpy (a very long word has a heap of its
own).  Words a worker has met lately are remembered, up to a bound.

Encoding follows the model's own rules (a space before the text, spaces as
U+2581, bytes for what has no piece); without dropout it gives the library's
ids.  U+2581 in a text itself is written as bytes, so that decoding can't take
it for a space.

Defined cases: a null or empty text has no pieces; repeated rows are encoded
alike; a null id has the variant of the empty text; bytes that are not UTF-8 are
read as U+FFFD; texts and words of any length are encoded whole (long words with
a heap); of candidates of equal rank the leftmost merges; an empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, VARIANTS, SEED = 0.1, 4, 7
SPACE = "▁"
CACHE_WORDS = 400_000  # of each of the two generations that a worker remembers
ROUND_WORDS = 50_000   # words whose agendas run together
LONG_WORD = 400        # bytes beyond which a word has an agenda of its own
WIDTHS = (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, LONG_WORD)
NEVER = np.iinfo(np.int32).max
# No piece joins a space to what stands before it, so these parts of a text never merge with each other.
CHUNKS = re.compile(rb" *[^ ]+| +")


class PieceModel:
    """Pieces, merge ranks and byte pieces of a SentencePiece BPE model."""

    def __init__(self, raw: bytes):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = lib.get_piece_size()
        self.byte_id = np.zeros(256, dtype=np.int32)
        self.bytes_of: list[bytes] = []
        self.id_of: dict[str, int] = {}
        rank = np.zeros(n, dtype=np.int64)
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                self.id_of[piece] = i
                rank[i] = round(-lib.get_score(i))
        keys, ranks, merged = [], [], []
        for piece, i in self.id_of.items():
            for cut in range(1, len(piece)):
                a, b = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(rank[i])
                    merged.append(i)
        self.n = n
        self.space = self.id_of[SPACE]
        self.merge_of = dict(zip(keys, zip(ranks, merged)))
        # the same as arrays: an open-addressing table of the merges, and the piece of each code point
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.slot_key = np.full(self.mask + 1, -1, dtype=np.int64)
        self.slot_rank = np.full(self.mask + 1, NEVER, dtype=np.int32)
        self.slot_to = np.full(self.mask + 1, -1, dtype=np.int32)
        self.depth = 1
        for key, (r, to) in self.merge_of.items():
            at, depth = int(_mix(np.array([key], dtype=np.uint64))[0]) & self.mask, 1
            while self.slot_key[at] >= 0:
                at, depth = (at + 1) & self.mask, depth + 1
            self.slot_key[at], self.slot_rank[at], self.slot_to[at] = key, r, to
            self.depth = max(self.depth, depth)
        self.of_code_point = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1 and piece != SPACE:
                self.of_code_point[ord(piece)] = i
        self.of_code_point[ord(" ")] = self.space

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER: no such merge) and result of merging neighbouring pieces; ids below 0 never merge."""
        key = left.astype(np.int64) * self.n + right
        key[(left < 0) | (right < 0)] = -2
        at = (_mix(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)
        slot = np.full(key.shape, -1, dtype=np.int64)
        todo = np.arange(key.size)
        for _ in range(self.depth):
            here = at[todo]
            held = self.slot_key[here]
            same = held == key[todo]
            slot[todo[same]] = here[same]
            todo = todo[(held >= 0) & ~same]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
        return np.where(slot >= 0, self.slot_rank[slot], NEVER), np.where(slot >= 0, self.slot_to[slot], -1)

    def letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First pieces of all words, where each starts in its word, and pieces per word.

        A letter without a piece becomes bytes, which are below 0 until the end.
        """
        raw = b"".join(words)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        ids = self.of_code_point[points]
        parts = np.where(ids >= 0, 1, width)
        first = np.cumsum(width) - width  # byte at which each letter starts
        at = np.repeat(first, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ids = np.repeat(ids, parts)
        missing = ids < 0
        ids[missing] = -1 - self.byte_id[np.frombuffer(raw, dtype=np.uint8)[at[missing]]]
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))])
        edges = np.searchsorted(at, begins)
        counts = np.diff(edges)
        return ids, at - np.repeat(begins[:-1], counts), counts


_MODELS: dict[str, PieceModel] = {}


def model_of(raw: bytes) -> PieceModel:
    """The parsed model, once per Python worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(raw)
    return _MODELS[key]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate that joins [start, middle) and [middle, end) is skipped, by a hash under ``key``."""
    place = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    return _mix(_mix(key ^ place) + place) < np.uint64(min(2**64 - 1, int(dropout * 2**64)))


def skipped_one(key: int, start: int, middle: int, end: int, dropout: float) -> bool:
    """``skipped`` for one candidate, in Python's integers."""
    full = 2**64 - 1

    def mix(x: int) -> int:
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    place = ((start << 42) ^ (middle << 21) ^ end) & full
    return mix((mix(key ^ place) + place) & full) < min(full, int(dropout * 2**64))


def word_keys(words: list[bytes], seed: int, variant: int) -> np.ndarray:
    """A 64-bit key of each word under (seed, variant)."""
    salt = xxhash.xxh64_intdigest(b"%d/%d" % (seed, variant))
    return np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in words), dtype=np.uint64, count=len(words))


def segment(model: PieceModel, words: list[bytes], keys: np.ndarray, dropout: float) -> list[bytes]:
    """Ids of each word, as the bytes of an int32 array."""
    if not words:
        return []
    ids, starts, counts = model.letters(words)
    edges = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out: list[bytes] = [b""] * len(words)
    lower = 0
    for width in WIDTHS:  # words of like length form one matrix
        rows = np.flatnonzero((counts > lower) & (counts <= width))
        lower = width
        if not len(rows):
            continue
        column = np.arange(width)
        inside = column < counts[rows][:, None]
        at = np.where(inside, edges[rows][:, None] + column, 0)
        piece = np.where(inside, ids[at], -NEVER).astype(np.int32)
        bound = np.concatenate([np.where(inside, starts[at], sizes[rows][:, None]), sizes[rows][:, None]], axis=1).astype(np.int32)
        for row, found in _agenda(model, rows, piece, bound, keys[rows], dropout):
            flat = found[found != -NEVER]
            flat = np.where(flat < 0, -1 - flat, flat).astype(np.int32).tobytes()
            ends = np.cumsum((found != -NEVER).sum(axis=1) * 4).tolist()
            for w, a, b in zip(row.tolist(), [0, *ends], ends):
                out[w] = flat[a:b]
    return out


def _agenda(model: PieceModel, rows: np.ndarray, piece: np.ndarray, bound: np.ndarray, keys: np.ndarray, dropout: float):
    """Yields (rows, their pieces) when words have no candidate left.

    ``piece`` is words x letters, ``bound`` where each piece begins and the last
    ends.  Each round merges in every word the candidate of lowest rank, the
    leftmost of equals, and looks at the two candidates that this changes.
    """
    def candidates(w: np.ndarray, j: np.ndarray) -> np.ndarray:
        r, _ = model.pairs(piece[w, j], piece[w, j + 1])
        if dropout > 0:
            known = np.flatnonzero(r != NEVER)
            a, b = w[known], j[known]
            r[known[skipped(keys[a], bound[a, b], bound[a, b + 1], bound[a, b + 2], dropout)]] = NEVER
        return r

    n, width = piece.shape
    if width < 2:
        yield rows, piece
        return
    w, j = (x.ravel() for x in np.indices((n, width - 1)))
    rank = candidates(w, j).reshape(n, width - 1).astype(np.int32)
    while True:
        best = rank.argmin(axis=1)
        going = rank[np.arange(len(rows)), best] != NEVER
        if not going.all():
            yield rows[~going], piece[~going]
            rows, piece, bound, rank, keys, best = (x[going] for x in (rows, piece, bound, rank, keys, best))
        if not len(rows):
            return
        width = piece.shape[1]
        if width == 2:
            yield rows, model.pairs(piece[:, 0], piece[:, 1])[1][:, None]
            return
        w = np.arange(len(rows))
        piece[w, best] = model.pairs(piece[w, best], piece[w, best + 1])[1]
        piece = _without(piece, best + 1)
        bound = _without(bound, best + 1)
        rank = _without(rank, np.minimum(best + 1, width - 2))
        last = piece.shape[1] - 1
        left, right = np.flatnonzero(best > 0), np.flatnonzero(best < last)
        rank[left, best[left] - 1] = candidates(left, best[left] - 1)
        rank[right, best[right]] = candidates(right, best[right])


def _without(x: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The matrix without the entry ``gone`` of each row."""
    return x[np.arange(x.shape[1]) != gone[:, None]].reshape(len(x), x.shape[1] - 1)


def segment_long(model: PieceModel, word: bytes, key: int, dropout: float) -> bytes:
    """As ``segment`` for one word, with a heap: time grows with n log n."""
    ids, starts, _ = model.letters([word])
    ids, starts = ids.tolist(), starts.tolist()
    n = len(ids)
    ends, following, before = starts[1:] + [len(word)], list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(at: int) -> None:
        to = following[at]
        if to >= n or ids[at] < 0 or ids[to] < 0:
            return
        merge = model.merge_of.get(ids[at] * model.n + ids[to])
        if merge is None:
            return
        if not dropout or not skipped_one(key, starts[at], starts[to], ends[to], dropout):
            heapq.heappush(heap, (merge[0], starts[at], at, to, merge[1]))

    for i in range(n - 1):
        offer(i)
    gone = [False] * n
    while heap:
        _, _, at, to, piece = heapq.heappop(heap)
        if gone[at] or gone[to] or following[at] != to or model.merge_of.get(ids[at] * model.n + ids[to], (0, -1))[1] != piece:
            continue  # one of the two has merged with another piece since
        ids[at], ends[at], following[at], gone[to] = int(piece), ends[to], following[to], True
        if following[at] < n:
            before[following[at]] = at
            offer(at)
        if before[at] >= 0:
            offer(before[at])
    return np.array([-1 - i if i < 0 else i for i, g in zip(ids, gone) if not g], dtype=np.int32).tobytes()


class Encoder:
    """Encodes texts; remembers the pieces of (variant, word) in two generations of bounded size."""

    def __init__(self, model: PieceModel, dropout: float = DROPOUT, seed: int = SEED):
        self.model, self.dropout, self.seed = model, dropout, seed
        self.young: dict[int, dict[bytes, bytes]] = {}
        self.old: dict[int, dict[bytes, bytes]] = {}

    def encode(self, texts: list[bytes], variants: list[int]) -> list[np.ndarray]:
        """Ids of each text."""
        chunks = [CHUNKS.findall(b" " + t) if t else [] for t in texts]
        if sum(map(len, self.young.values())) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        new: dict[int, set[bytes]] = {}
        for parts, v in zip(chunks, variants):
            new.setdefault(v, set()).update(parts)
        for v, words in new.items():
            young, old = self.young.setdefault(v, {}), self.old.get(v, {})
            words = words.difference(young)
            met = words.intersection(old)
            young.update(zip(met, map(old.__getitem__, met)))
            self._learn(v, list(words - met))
        return [np.frombuffer(b"".join(map(self.young[v].__getitem__, parts)), dtype=np.int32) for parts, v in zip(chunks, variants)]

    def _learn(self, variant: int, words: list[bytes]) -> None:
        known = self.young[variant]
        short = [w for w in words if len(w) <= LONG_WORD]
        for at in range(0, len(short), ROUND_WORDS):
            some = short[at:at + ROUND_WORDS]
            known.update(zip(some, segment(self.model, some, word_keys(some, self.seed, variant), self.dropout)))
        for w in words:
            if len(w) > LONG_WORD:
                known[w] = segment_long(self.model, w, int(word_keys([w], self.seed, variant)[0]), self.dropout)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(raw: bytes, dropout: float, seed: int) -> Encoder:
    """The worker's encoder: what it remembers serves all tasks of the worker."""
    model = model_of(raw)
    key = (id(model), dropout, seed)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model, dropout, seed)
    return _ENCODERS[key]


def decode(model: PieceModel, ids) -> bytes:
    """The text of pieces: their bytes, without the space put before the text."""
    return b"".join(map(model.bytes_of.__getitem__, ids))[1:]


def encode(docs: DataFrame, keep: list[str], model_path: str = MODEL, dropout: float = DROPOUT, variants: int = VARIANTS,
           seed: int = SEED) -> DataFrame:
    """``keep``, variant, n_pieces, ids and lossless (whether the ids decode to the text) of every row.

    The model file is read on the driver and travels with the tasks.
    """
    with open(model_path, "rb") as f:
        raw = f.read()

    def run(batches):
        model, encoder = model_of(raw), encoder_of(raw, dropout, seed)
        for batch in batches:
            texts = [t.encode() for t in common.texts(batch.column("__text"))]
            variant = [zlib.crc32(b"%d:%s" % (seed, d or b"")) % variants
                       for d in batch.column("__key").cast(pa.binary()).to_pylist()]
            ids = encoder.encode(texts, variant)
            lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
            same = [decode(model, i.tolist()) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(variant, pa.int32()), pa.array(lengths), lists, pa.array(same, pa.bool_())],
                [*keep, "variant", "n_pieces", "ids", "lossless"])

    given = docs.select(*keep, F.col("text").alias("__text"), F.col("doc_id").cast("string").alias("__key"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("variant", T.IntegerType()),
                           T.StructField("n_pieces", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("lossless", T.BooleanType())])
    return given.mapInArrow(run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, variant, n_pieces, ids, lossless."""
    common.ready(spark)
    return encode(common.read(spark, sf_dir, "documents"), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document as pieces, with its id, language and source."""
    common.ready(spark)
    return encode(docs, ["doc_id", "lang", "source"])
