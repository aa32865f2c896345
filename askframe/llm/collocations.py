"""Phrase collocations by Toivonen mining: a sample proposes phrases, full passes count them exactly.

1. A share of the documents (by hash of the row) is mined level by level with a
   lowered threshold.  What it finds is the proposal ``S``.
2. One pass over all documents counts ``S`` and its negative border exactly.
   The border is never listed: a phrase that occurs belongs to ``S`` or its
   border just if both phrases one word shorter, its first and its last words,
   are in ``S`` (for single words: always).
3. A border phrase that reaches ``min_count`` is a failure of the sample: what
   it makes possible was not counted.  An expansion pass then counts every
   phrase not counted before whose parts are frequent, or not counted before
   and possible themselves.  Passes go on until no failure is left.

The proposal travels as a bit filter of fixed size (``filter_bits``, a blocked
Bloom filter).  A false positive makes a pass count a phrase that could have
been left out, in all its occurrences, so counts stay exact; more phrases than
the filter has room for cost work, never results.

Documents are cut into streams of word numbers inside a task; numpy counts
phrases per window of about ``WINDOW`` words, and only those partial counts are
shuffled by (lang, phrase).

Defined cases: null text counts as empty, null lang as ``und``; repeated rows
count each time; texts of any length are counted whole (a long one passes
through several windows that overlap); bytes that are not UTF-8 are kept as
they are; an empty table gives no rows; equal scores are ranked by count, then
phrase in byte order; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askframe.llm import common

WINDOW = 2_000_000    # words counted at once inside a task
SLICE = 4 << 20       # bytes of a text split into words at once
SAMPLE_RATE = 0.25
FILTER_BITS = 25      # 2 ** 25 bits: 4 MB travel to the tasks
PARTS = 64            # a language's phrases are ranked in so many parts first
OUT_ROWS = 100_000    # rows of one Arrow batch of counts
SEGMENT_BITS = 19     # a filter consists of segments of 64 KB, each filled by one group of rows

# Every character that ends a piece becomes ".", A-Z become a-z.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(46 if b in _ENDS else b for b in bytes(range(256)).lower())
_MIX = np.uint64(0x9E3779B97F4A7C15)

# A counted phrase between tasks: one key of "1" (open) or "0", the language, a tab and the phrase, which holds no tab.
COUNTS = "key binary, n bigint"


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of a phrase from those of the words before its last, and of the last."""
    x = (left ^ (left >> np.uint64(29))) * _MIX + right
    return x ^ (x >> np.uint64(32))


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang))


def phrase_hash(lang: bytes, phrase: bytes) -> int:
    """The hash of a phrase (words joined by one space), as tasks compute it for windows of words."""
    words = phrase.split(b" ")
    h = np.array([_word_hash(lang, words[0])], dtype=np.uint64)
    for w in words[1:]:
        h = _mixed(h, np.array([_word_hash(lang, w)], dtype=np.uint64))
    return int(h[0])


class Filter:
    """A set of phrase hashes as a bit array of ``2 ** bits`` bits: may hold more, never fewer."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    @staticmethod
    def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Segment of each hash and its three bit places inside the segment."""
        segment_bits = min(SEGMENT_BITS, bits)
        count = np.uint64(bits - segment_bits)
        segment = h >> (np.uint64(64) - count) if count else np.zeros_like(h)
        mask = np.uint64((1 << segment_bits) - 1)
        return segment, [(h & mask), ((h >> np.uint64(19)) & mask), ((h * _MIX >> np.uint64(37)) & mask)]

    def has(self, h: np.ndarray) -> np.ndarray:
        if len(self.table) == 0:
            return np.zeros(len(h), dtype=bool)
        segment, places = self.places(h, self.bits)
        at = segment << np.uint64(min(SEGMENT_BITS, self.bits))
        found = np.ones(len(h), dtype=bool)
        for p in places:
            bit = at + p
            found &= (self.table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def filter_of(phrases: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """The filter of the (lang, phrase) rows; each segment is filled by one task's rows, ``2 ** bits`` bits reach the driver."""
    segment_bytes = 1 << (min(SEGMENT_BITS, bits) - 3)

    def hashes(batches):
        for batch in batches:
            rows = zip(batch.column("lang").cast(pa.binary()).to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist())
            h = np.fromiter((phrase_hash(lang, p) for lang, p in rows), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(Filter.places(h, bits)[0].astype(np.int64)), pa.array(h.view(np.int64))],
                                             ["segment", "h"])

    def fill(batches):
        segments: dict[int, np.ndarray] = {}
        for batch in batches:
            segment = batch.column("segment").to_numpy()
            places = Filter.places(batch.column("h").to_numpy().view(np.uint64), bits)[1]
            for s in np.unique(segment).tolist():
                part = segments.setdefault(s, np.zeros(segment_bytes, dtype=np.uint8))
                for p in places:
                    p = p[segment == s]
                    np.bitwise_or.at(part, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        if segments:
            yield pa.RecordBatch.from_arrays([pa.array(list(segments), pa.int64()),
                                              pa.array([x.tobytes() for x in segments.values()], pa.binary())], ["segment", "bits"])

    rows = (phrases.select("lang", "phrase").mapInArrow(hashes, "segment bigint, h bigint")
            .repartition("segment").mapInArrow(fill, "segment bigint, bits binary"))
    table = np.zeros(0, dtype=np.uint8)
    for r in rows.toLocalIterator():
        if not len(table):
            table = np.zeros(1 << (bits - 3), dtype=np.uint8)
        at = r["segment"] * segment_bytes
        table[at:at + segment_bytes] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Filter(table, bits)


class _Numbers(dict):
    """Numbers words in order of appearance; several languages share the sequence."""

    def __init__(self, words: list[bytes], langs: list[int], lang: int):
        super().__init__({b".": 0})
        self.words, self.langs, self.lang = words, langs, lang

    def __missing__(self, word):
        self[word] = number = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return number


def _slices(raw: bytes) -> Iterator[bytes]:
    """A text in slices of about ``SLICE`` bytes that end between words."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, a place of each distinct key)."""
    order = np.argsort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def count_phrases(docs: DataFrame, levels: set[int], accepted: Filter | None = None, counted: list[Filter] = (),
                  expand: bool = False, at_least: int = 1, window: int = WINDOW) -> DataFrame:
    """Exact counts (lang, words, phrase, n, open) of phrases of ``levels`` words that reach ``at_least``.

    The row of 0 words holds a language's words in all.

    A phrase of two words or more is counted if both its parts, one word
    shorter, are possible, and were not both in one of the filters ``counted``
    (it was counted then).  Possible are phrases in ``accepted`` and, with
    ``expand``, those not counted before.  ``open`` says that the phrase itself
    was not possible here, so that nothing longer was counted.
    """
    spark, top = docs.sparkSession, max(levels)
    shared = spark.sparkContext.broadcast((accepted, list(counted)))

    def solve(ids: np.ndarray, limit: int, words: list[bytes], langs: list[int], names: list[bytes]):
        """Batches of counts of the phrases that start at the first ``limit`` of the words numbered ``ids``."""
        keep, old = shared.value
        hashes = np.zeros(len(words), dtype=np.uint64)  # number 0 has none
        hashes[1:] = np.fromiter((_word_hash(names[g], w) for g, w in zip(langs[1:], words[1:])), dtype=np.uint64, count=len(words) - 1)
        texts, lang_of = pa.array(words, pa.binary()), np.asarray(langs, dtype=np.int64)
        start = {flag: pa.array([flag + name + b"\t" for name in names], pa.binary()) for flag in (b"0", b"1")}

        def batches(n, places, counts, open_):
            for flag, which in ((b"0", ~open_), (b"1", open_)):
                of_flag, counts_of = places[which], counts[which]
                for at in range(0, len(of_flag), OUT_ROWS):
                    yield batch(n, of_flag[at:at + OUT_ROWS], counts_of[at:at + OUT_ROWS], start[flag])

        def batch(n, places, counts, starts):
            keys = pc.binary_join_element_wise(starts.take(pa.array(lang_of[ids[places]])), texts.take(pa.array(ids[places])), b"")
            for k in range(1, n):
                keys = pc.binary_join_element_wise(keys, texts.take(pa.array(ids[places + k])), b" ")
            return pa.RecordBatch.from_arrays([keys, pa.array(counts)], ["key", "n"])

        # level 1: the numbers are the words'
        gram, gram_hash = ids.copy(), hashes
        starts = np.arange(len(ids)) < limit
        n_of = np.bincount(ids[starts], minlength=len(words))
        n_of[0] = 0
        if 1 in levels:
            seen = np.flatnonzero(n_of)
            place = np.zeros(len(words), dtype=np.int64)
            place[ids[::-1]] = np.arange(len(ids))[::-1]
            yield from batches(1, place[seen], n_of[seen], ~keep.has(hashes[seen]) if keep else np.ones(len(seen), dtype=bool))
            per = np.bincount(lang_of, weights=n_of, minlength=len(names)).astype(np.int64)[:len(names)]
            yield pa.RecordBatch.from_arrays([start[b"0"], pa.array(per)], ["key", "n"])
        possible = keep.has(gram_hash) if keep else np.ones(len(gram_hash), dtype=bool)
        possible[0] = False
        inside = [f.has(gram_hash) for f in old]
        valid = ids > 0
        for n in range(2, top + 1):
            # a phrase of n words at i: both parts of n - 1 words, at i and i + 1, are possible
            both = np.zeros(len(ids), dtype=bool)
            both[:-1] = valid[:-1] & valid[1:]
            both[:-1] &= possible[gram[:-1]] & possible[gram[1:]]
            at = np.flatnonzero(both)
            if not len(at):
                return
            number, place = _dense(gram[at] * np.int64(len(words)) + ids[at + n - 1])
            place = at[place]
            before = np.zeros(len(place), dtype=bool)
            reached = [has[gram[place]] & has[gram[place + 1]] for has in inside]
            for then in reached:
                before |= then
            new_hash = _mixed(gram_hash[gram[place]], hashes[ids[place + n - 1]])
            now = keep.has(new_hash) if keep else np.ones(len(place), dtype=bool)
            if expand:
                now |= ~before
            counts = np.bincount(number[at < limit], minlength=len(place))
            if n in levels:
                out = np.flatnonzero(~before & (counts > 0))
                yield from batches(n, place[out], counts[out], ~now[out])
            gram = np.zeros(len(ids), dtype=np.int64)
            gram[at] = number
            valid = both
            # a filter may hold a phrase by chance that its pass never reached: nothing longer was counted there
            gram_hash, possible, inside = new_hash, now, [f.has(new_hash) & then for f, then in zip(old, reached)]

    def run(batches):
        names: list[bytes] = []       # languages
        words: list[bytes] = [b"."]   # number 0 ends a piece
        langs: list[int] = [0]
        numbers: dict[bytes, _Numbers] = {}
        parts: list[np.ndarray] = []
        size = 0

        def of(lang: bytes) -> _Numbers:
            if lang not in numbers:
                numbers[lang] = _Numbers(words, langs, len(names))
                names.append(lang)
            return numbers[lang]

        def flush(last: bool):
            nonlocal parts, size, names, words, langs, numbers
            ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            limit = len(ids) if last else max(0, len(ids) - (top - 1))
            if limit:
                yield from solve(ids, limit, words, langs, names)
            # the words after the limit start the next window, numbered anew
            rest = [(names[langs[i]], words[i]) if i else None for i in ids[limit:].tolist()]
            names, words, langs, numbers = [], [b"."], [0], {}
            parts = [np.asarray([of(x[0])[x[1]] if x else 0 for x in rest], dtype=np.int64)]
            size = len(rest)

        for batch in batches:
            for lang, raw in zip(batch.column("lang").cast(pa.binary()).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                for piece in _slices(raw):
                    tokens = piece.translate(_FOLD).replace(b".", b" . ").split()
                    parts.append(np.fromiter(map(of(lang).__getitem__, tokens), dtype=np.int64, count=len(tokens)))
                    size += len(tokens)
                    if size >= window:
                        yield from flush(False)
                parts.append(np.zeros(1, dtype=np.int64))
                size += 1
        yield from flush(True)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("key").cast("string")
    counts = (rows.mapInArrow(run, COUNTS).groupBy("key").agg(F.sum("n").alias("n"))
              .where((F.col("n") >= at_least) | text.endswith("\t"))
              .withColumn("phrase", F.substring_index(text, "\t", -1)))
    lang = F.expr("CAST(substring(key, 2, octet_length(key) - octet_length(phrase) - 2) AS STRING)")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ", -1)))
    return counts.select(lang.alias("lang"), words.alias("words"), "phrase", "n", text.startswith("1").alias("open"))


def frequent_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, sample_rate: float = SAMPLE_RATE,
                     filter_bits: int = FILTER_BITS, lowered: int | None = None, window: int = WINDOW) -> DataFrame:
    """(lang, words, phrase, n): every phrase of up to ``max_words`` words with at least ``min_count`` occurrences.

    ``words`` 0 gives each language's number of words.  ``lowered`` is the
    threshold inside the sample; the default is below what a phrase of
    ``min_count`` occurrences can be expected to have there, 2 at least.
    """
    if lowered is None:
        lowered = max(2, int(0.6 * min_count * sample_rate))
    sample = docs.where(common.uniform(F.xxhash64("doc_id", "text"), "phrase sample") < sample_rate)
    proposed, accepted = None, None
    for n in range(1, max_words):  # the longest phrases make nothing longer possible: none has to be proposed
        found = common.written(count_phrases(sample, {n}, accepted, at_least=lowered, window=window).where("words > 0"),
                               f"phrase-sample-{n}")
        proposed = found if proposed is None else proposed.unionByName(found)
        accepted = filter_of(proposed, filter_bits)
    accepted = accepted or Filter(np.zeros(0, dtype=np.uint8), filter_bits)
    found = common.written(count_phrases(docs, set(range(1, max_words + 1)), accepted, at_least=min_count, window=window), "phrases-1")
    counted, latest = [accepted], found
    while max_words > 1 and not latest.where(F.col("open") & F.col("words").between(1, max_words - 1)).isEmpty():
        known = filter_of(found.where(F.col("words").between(1, max_words - 1)), filter_bits)
        latest = common.written(count_phrases(docs, set(range(2, max_words + 1)), known, counted, expand=True, at_least=min_count,
                                              window=window), f"phrases-{len(counted) + 1}")
        counted.append(known)
        found = found.unionByName(latest)
    return found.select("lang", "words", "phrase", "n")


def score_phrases(frequent: DataFrame, max_words: int = 3, absorbed: int = 50) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of candidates, each by its lowest-scoring cut, without absorbed ones.

    ``floor(1000000 * a * a / (l * r))`` is computed in decimals of 38 digits
    (exact for counts below 10 ** 15).  A candidate is absorbed if a phrase
    longer than it, with at least ``absorbed`` percent of its count, holds it.
    """
    counts = frequent.where("words > 0").select("lang", "words", "phrase", "n")
    cand = counts.where("words > 1")
    none = cand.select("lang", "words", "phrase", F.col("n").alias("a"), F.lit(0).alias("k"),
                       F.col("phrase").alias("head"), F.col("phrase").alias("tail")).limit(0)
    cuts, held = none, cand.select("lang", "phrase", F.col("n").alias("longer")).limit(0)
    for n in range(2, max_words + 1):  # substring_index takes numbers of words as constants
        of_n = cand.where(F.col("words") == n)
        for k in range(1, n):
            cuts = cuts.unionByName(of_n.select("lang", "words", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"),
                                                F.substring_index("phrase", " ", k).alias("head"),
                                                F.substring_index("phrase", " ", k - n).alias("tail")))
        for m in range(2, n):
            for end in range(m, n + 1):
                inner = F.substring_index(F.substring_index("phrase", " ", end), " ", -m)
                held = held.unionByName(of_n.select("lang", inner.alias("phrase"), F.col("n").alias("longer")))
    # both sides of each join are rows of tables: Spark splits a word that begins or ends many phrases
    side = counts.select("lang", "phrase", "n")
    scored = (cuts.join(side.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
              .join(side.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
              .withColumn("score", F.expr("(CAST(1000000 AS DECIMAL(8,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))))"
                                          " div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")))
    best = (scored.groupBy("lang", "words", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
            .select("lang", "words", "phrase", "cut.a", "cut.l", "cut.r", "cut.score"))
    longest = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return (best.join(longest, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))).drop("longer"))


def collocations(docs: DataFrame, top: int = 2000, max_words: int = 3, min_count: int = 10, **mining) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    frequent = frequent_phrases(docs, max_words, min_count, **mining)
    totals = frequent.where("words = 0").select("lang", F.col("n"))  # one row per language
    # ranked in parts first, so that the last ranking sees PARTS x top rows of a language at most
    best_first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = score_phrases(frequent, max_words).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    ahead = (scored.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best_first)))
             .where(F.col("rank") <= top).drop("rank"))
    ranked = ahead.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best_first)).cast("bigint"))
    return (ranked.where(F.col("rank") <= top).join(totals, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two or three words of each language of all documents."""
    common.ready(spark)
    return collocations(common.read(spark, sf_dir, "documents"))
