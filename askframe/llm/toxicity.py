"""Toxicity: Levenshtein automata intersected with a lexicon trie, read in context windows.

The lexicon is learned from labelled rows: words, and stems shared by several
words, that texts of label 1 use in many different places and others do not.
Its trie and the Levenshtein automata of its terms are run together as one
lazily built automaton, so a misspelled word is found in one walk over its
letters.  Each hit is read in its window: hits inside quotation marks are
counted apart from open ones, and hits near each other count as a run.  A
logistic model over these counts gives the score.

Defined cases: a null text counts as empty; an empty text has no hits and gets
the model's lowest kind of score, the one of a text without hits; repeated rows
are scored one by one; texts and words of any length are read whole (only what is remembered of words is bounded), and ties
cannot arise, since each row is scored alone; an empty table gives no rows; without labels the
lexicon is empty and all texts score alike.  Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import common, quality_classifier, trees

EVIDENCE = 9.0                     # log-likelihood ratio a term needs
STEM_LETTERS = range(4, 9)
PLACE_ROWS = 200_000  # (term, place) pairs a worker gathers before it hands them on
CACHE_WORDS, CACHE_STEPS, CACHE_SETS = 300_000, 400_000, 1_000_000

# Common stand-ins for letters, and quotation marks.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
OPENING, CLOSING = "\"'“„«‘‚‹", "\"'”“»’‘›"
EDGES = re.compile(r"^(?:[^\w@$]|_)+|[\W_]+$")
# Letter runs of any script: letters, digits, stand-ins, and the marks and joiners that belong to letters.
MARKS = "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.category(c) in ("Mn", "Mc")) + "\u200c\u200d"
RUN = re.compile(rf"(?:[^\W_]|[@${MARKS}])+")
ASCII_RUN = re.compile(rb"[A-Za-z0-9@$]+")
# Scripts without spaces: windows of so many letters stand for words.
UNSPACED = re.compile("(?P<w2>[\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+)"
                      "|(?P<w4>[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]+)")
APOSTROPHES = "'’‘"
QUOTE_BYTES = re.compile("|".join(sorted(set(OPENING + CLOSING))).encode())

FEATURES = ["any_open", "log_open", "rate", "log_runs", "edit_share", "log_quoted"]
# What the fitted weights are drawn towards: open hits speak for label 1, hits with edits a little less, quoted ones not.
PRIOR = np.array([-4.5, 1.5, 2.0, 2.5, 0.5, -1.0, 0.0])
WEIGHT = np.array([0.0, 1.0, 1.0, 0.8, 0.6])  # of a hit by its kind


def plain(word: bytes) -> str:
    """A word in lower case without marks at its ends; stand-ins for letters resolved if it has letters."""
    w = EDGES.sub("", word.decode("utf-8", "replace").lower())
    return w.translate(STAND_INS) if any(c.isalpha() for c in w) else w


def split_words(word: bytes) -> list[bytes]:
    """The words of one token without ASCII space: its letter runs, with the marks beside them.

    Of the marks between two runs, an opening quotation mark goes to the run
    after it and the rest to the run before; a lone apostrophe goes to neither.
    In scripts without spaces, overlapping windows of letters are words.
    """
    if word.isascii() and len(ASCII_RUN.findall(word)) < 2:
        return [word]
    text = word.decode("utf-8", "replace")
    spans = [m.span() for m in RUN.finditer(text)]
    spaced = UNSPACED.search(text) is None
    if len(spans) < 2 and spaced:
        return [word]
    out, before, inside = [], text[:spans[0][0]] if spans else "", False
    for i, (a, b) in enumerate(spans):
        gap = text[b:spans[i + 1][0]] if i + 1 < len(spans) else text[b:]
        after, following = gap, ""
        if i + 1 < len(spans):
            inside ^= (before.count('"') & 1) == 1
            if len(gap) == 1 and gap in APOSTROPHES:
                after = ""
            elif gap[-1] in OPENING and (gap[-1] not in CLOSING or len(gap) > 1 or not inside):
                after, following = gap[:-1], gap[-1]
            inside ^= (after.count('"') & 1) == 1
        after = after[:max(map(after.rfind, CLOSING)) + 1]
        parts = [text[a:b]] if spaced else windows(text[a:b])
        parts[0] = before + parts[0]
        parts[-1] += after
        out += [p.encode("utf-8", "replace") for p in parts]
        before = following
    return out or [word]


def windows(run: str) -> list[str]:
    """A letter run, with its stretches of scripts without spaces as windows of letters."""
    out, done = [], 0
    for m in UNSPACED.finditer(run):
        if m.start() > done:
            out.append(run[done:m.start()])
        part, n = m.group(), 2 if m.group("w2") else 4
        out += [part[i:i + n] for i in range(max(1, len(part) - n + 1))]
        done = m.end()
    return out + ([run[done:]] if done < len(run) else [])


def least_letters(word: str) -> int:
    return 2 if UNSPACED.match(word) else 3


def edits_allowed(term: str) -> int:
    """One edit in four letters or more, two in nine or more; with an edit most words of three letters meet another word."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


EXACT, STEM, EDIT1, EDIT2 = 1, 2, 3, 4


class Matcher:
    """The product of a lexicon trie and its terms' Levenshtein automata, made deterministic as it is used.

    A state is the set of (trie node, edits so far) that the letters read can
    have reached; steps are remembered up to a bound, so most words cost a few
    lookups.  Edits are allowed at any letter, the first one too.
    """

    def __init__(self, words: list[str], stems: list[str], fuzzy: list[str], clean: set[str] = frozenset()):
        self.clean = clean
        self.children: list[dict[str, int]] = [{}]
        self.word: list[bool] = [False]
        self.stem: list[bool] = [False]
        self.limit: list[int] = [0]  # most edits any fuzzy term below the node allows
        self.ends: list[int] = [-1]  # edits a fuzzy term ending here allows
        for term in stems:
            self.stem[self._insert(term)] = True
        for term in words:
            self.word[self._insert(term)] = True
        for term in fuzzy:
            self.ends[self._insert(term, edits_allowed(term))] = edits_allowed(term)
        self._forget()

    def _insert(self, term: str, edits: int = 0) -> int:
        at = 0
        self.limit[0] = max(self.limit[0], edits)
        for ch in term:
            if ch not in self.children[at]:
                self.children[at][ch] = len(self.children)
                self.children.append({})
                for array, x in ((self.word, False), (self.stem, False), (self.limit, 0), (self.ends, -1)):
                    array.append(x)
            at = self.children[at][ch]
            self.limit[at] = max(self.limit[at], edits)
        return at

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.kinds: list[int] = []
        self.held = 0  # numbers in all sets
        self.start = self._state({(0, 0)})

    def _state(self, reached: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        todo = list(reached)
        while todo:  # a letter of the term may be missing: move down the trie at the price of an edit
            node, e = todo.pop()
            if best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(c, e + 1) for c in self.children[node].values() if e < self.limit[c]]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.held += len(key)
            found = [e for node, e in key if self.ends[node] >= e]
            exact = any(self.word[node] and e == 0 for node, e in key) or 0 in found
            self.kinds.append(EXACT if exact else (EDIT1 if min(found) == 1 else EDIT2) if found else 0)
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        reached: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            child = self.children[node].get(ch)
            if child is not None:
                reached.add((child, e))
            if e < self.limit[node]:
                reached.add((node, e + 1))  # one letter too many
            reached.update((c, e + 1) for c in self.children[node].values() if e < self.limit[c])  # another letter
        to = self._state(reached) if reached else -1
        self.steps[state, ch] = to
        return to

    def kind(self, word: str) -> int:
        """EXACT, STEM, EDIT1, EDIT2, or 0 for no match."""
        if len(self.steps) > CACHE_STEPS or self.held > CACHE_SETS:
            self._forget()
        state, node, stem = self.start, 0, False
        for ch in word:
            if node is not None:
                node = self.children[node].get(ch)
                stem = stem or (node is not None and self.stem[node])
            if state >= 0:
                to = self.steps.get((state, ch))
                state = self._step(state, ch) if to is None else to
            elif node is None:
                break
        found = self.kinds[state] if state >= 0 else 0
        if found == EXACT:
            return EXACT
        return STEM if stem else 0 if found and word in self.clean else found


class Kinds(dict):
    """Kind of each raw token, remembered up to a bound.

    A token of several words that are not to be looked up as one gets
    ``-(2 * words + 1)`` if one of them matches, otherwise ``-2 * words``.
    """

    def __init__(self, matcher: Matcher):
        self.matcher = matcher
        self.words: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        kind = self.words.get(word)
        if kind is None:
            kind = self.matcher.kind(plain(word))
            if len(word) < 200:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = kind
        return kind

    def __missing__(self, token: bytes) -> int:
        words = split_words(token)
        if len(words) == 1:
            kind = self.matcher.kind(plain(token))
        elif any(map(self.word, words)):
            kind = -(2 * len(words) + 1)
        else:  # marks may stand inside a word
            kind = self.matcher.kind(plain(token)) or -2 * len(words)
        if len(token) < 200:  # longer ones are not remembered
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[token] = kind
        return kind


def quoted(words: list[bytes], at: int, window: int = 12) -> bool:
    """Whether the word at ``at`` lies between an opening and a closing quotation mark in its window."""
    text = [w.decode("utf-8", "replace") for w in words[max(0, at - window):at + window + 1]]
    k = min(at, window)
    opened = any(text[i][0] in OPENING and not any(t[-1] in CLOSING or t.rstrip(".,;:!?")[-1:] in CLOSING for t in text[i:k])
                 for i in range(k, -1, -1))
    return opened and any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in text[k:])


def hit_counts(raw: bytes, kinds: Kinds, window: int = 10) -> list[float]:
    """``FEATURES`` of one text."""
    words = raw.split()
    found = np.fromiter(map(kinds.__getitem__, words), dtype=np.int64, count=len(words))
    if not ((found > 0) | (found < 0) & (found % 2 == 1)).any():
        return [0.0] * len(FEATURES)
    if (found < 0).any():  # tokens of several words: each word has its place
        split = [split_words(w) if k < 0 else [w] for w, k in zip(words, found.tolist())]
        found = np.fromiter((k if k >= 0 else kinds.word(w) for ws, k in zip(split, found.tolist()) for w in ws), dtype=np.int64)
        words = [w for ws in split for w in ws]
    at = np.flatnonzero(found)
    inside = np.zeros(len(at), dtype=bool)
    if QUOTE_BYTES.search(raw):
        inside = np.fromiter((quoted(words, i) for i in at.tolist()), dtype=bool, count=len(at))
    open_at = at[~inside]
    kind = found[open_at]
    n = float(WEIGHT[kind].sum())
    runs = int((np.diff(open_at) <= window).sum())
    return [float(len(open_at) > 0), float(np.log1p(n)), min(1.0, 100 * n / len(words)), float(np.log1p(runs)),
            float((kind >= EDIT1).mean()) if len(kind) else 0.0, float(np.log1p(inside.sum()))]


@dataclass
class ToxicModel:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    fuzzy: list[str] = field(default_factory=list)
    clean: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def kinds(self) -> Kinds:
        return Kinds(Matcher(self.words, self.stems, self.fuzzy, set(self.clean)))

    def score(self, texts: list[bytes], kinds: Kinds) -> np.ndarray:
        X = np.asarray([hit_counts(t, kinds) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
        return trees.sigmoid(self.weights[0] + X @ self.weights[1:])


def learned(token: bytes) -> list[tuple[str, int | None]]:
    """The words of a token as (word or "" if it is no term, its hash as a place); first the whole token, if it has several."""
    words = split_words(token)
    whole = [token] if len(words) > 1 else []
    terms = [w if least_letters(w) <= len(w) and w[0].isalpha() else "" for w in map(plain, whole + words)]
    return list(zip(terms, [None] * len(whole) + list(map(zlib.crc32, words))))


def term_contexts(sample: DataFrame) -> DataFrame:
    """(term, stem, t0, c0, t1, c1, t, c): in how many places a term occurs in texts of label 1 (t) and 0 (c).

    Counted for each half of the sample and for both.  Copies of a text add
    nothing: for a word the place is a hash of the word before it, for a stem
    the whole word.  Each place counts once, however many there are.
    """
    def run(batches):
        known: dict[bytes, list[tuple[str, int | None]]] = {}

        def rows(seen: dict[tuple[str, int], int], words: dict[str, int]) -> pa.RecordBatch:
            stems: dict[tuple[str, int], int] = {}
            for w, mask in words.items():
                place = zlib.crc32(w.encode())
                for k in STEM_LETTERS:
                    if k < len(w):
                        stems[w[:k], place] = stems.get((w[:k], place), 0) | mask
            keys = [*seen, *stems]
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([False] * len(seen) + [True] * len(stems), pa.bool_()),
                 pa.array([k[1] for k in keys], pa.int64()), pa.array([*seen.values(), *stems.values()], pa.int32())],
                ["term", "stem", "place", "mask"])

        for batch in batches:
            seen: dict[tuple[str, int], int] = {}
            words: dict[str, int] = {}
            for y, half, raw in zip(batch.column("y").to_pylist(), batch.column("half").to_pylist(),
                                    batch.column("text").cast(pa.binary()).to_pylist()):
                slot, before = 1 << (2 * half + (1 - y)), 0
                for token in (raw or b"").split():
                    words_in = known.get(token)
                    if words_in is None:
                        words_in = learned(token)
                        if len(token) < 200:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            known[token] = words_in
                    for w, place in words_in:
                        if w:
                            seen[w, before] = seen.get((w, before), 0) | slot
                            words[w] = words.get(w, 0) | slot
                        before = before if place is None else place
                if len(seen) > PLACE_ROWS:
                    yield rows(seen, words)
                    seen, words = {}, {}
            yield rows(seen, words)

    of = {"t0": 1, "c0": 2, "t1": 4, "c1": 8, "t": 5, "c": 10}
    places = (sample.mapInArrow(run, "term string, stem boolean, place bigint, mask int")
              .groupBy("term", "stem", "place").agg(F.bit_or("mask").alias("mask")))
    return places.groupBy("term", "stem").agg(*(F.count_if(F.col("mask").bitwiseAND(F.lit(m)) != 0).alias(x) for x, m in of.items()))


def pick_terms(contexts: DataFrame, t: Column, c: Column, share: float) -> tuple[list[str], list[str], list[str]]:
    """Words, stems and words for fuzzy matching whose places lie in texts of label 1 beyond chance.

    ``share`` is label 1's share of the sample's text.  The sample is bounded, and so are its terms.
    """
    n = t + c
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    rows = (contexts.withColumn("t", t.cast("double")).withColumn("c", c.cast("double"))
            .withColumn("g", part(F.col("t"), share) + part(F.col("c"), 1 - share))
            .where((F.col("g") >= EVIDENCE) & (F.col("t") >= 3) & (F.col("t") >= 6 * F.col("c"))))
    top = lambda stem: [r["term"] for r in rows.where(F.col("stem") == stem).orderBy(F.desc("g"), "term").collect()]
    words, stems = top(False), []
    kept: set[str] = set()
    for s in sorted(top(True), key=lambda s: (len(s), s)):  # the shortest stem stands for the longer ones
        if not any(s[:k] in kept for k in range(1, len(s))):
            kept.add(s)
            stems.append(s)
    return words, stems, [w for w in words if edits_allowed(w)]


def known_clean(contexts: DataFrame, t: Column, c: Column, model: ToxicModel) -> list[str]:
    """Words of the sample that match only with edits and that texts of label 0 use: no misspellings."""
    words, stems, fuzzy = model.words, model.stems, model.fuzzy

    def run(batches):
        matcher = Matcher(words, stems, fuzzy)
        for batch in batches:
            yield batch.filter(pa.array([matcher.kind(w) in (EDIT1, EDIT2) for w in batch.column("term").to_pylist()], pa.bool_()))

    rows = contexts.where(~F.col("stem") & (c > 0) & (2 * t < F.lit(6) * c)).select("term").mapInArrow(run, "term string")
    return [r["term"] for r in rows.orderBy("term").collect()]


def fit_weights(X: np.ndarray, y: np.ndarray, pull: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic weights by Newton steps, drawn towards ``PRIOR``."""
    A, w = np.hstack([np.ones((len(X), 1)), X]), PRIOR.copy()
    P = pull * np.eye(len(w))
    P[0, 0] = pull / 10
    for _ in range(steps):
        p = trees.sigmoid(A @ w)
        g = A.T @ (y - p) - P @ (w - PRIOR)
        H = (A * (p * (1 - p))[:, None]).T @ A + P
        step = np.linalg.solve(H, g)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = 12_000) -> ToxicModel:
    """Lexicon and weights from about ``max_rows`` labelled rows outside ``held_out``.

    The weights are fitted on one half of the sample with the lexicon of the
    other half, so that they show how a lexicon does on texts it has not seen;
    the lexicon that is kept comes from both halves.
    """
    picked = common.labelled_sample(docs, labels, "toxic", held_out, max_rows, balanced=False)
    half = (common.uniform(F.col("doc_id"), "halves") < 0.4).cast("int")
    sample = common.written(picked.withColumn("half", half), "toxic-sample")
    sizes = {r["y"]: float(r["n"] or 0) for r in sample.groupBy("y").agg(F.sum(F.length("text")).alias("n")).collect()}
    share = (sizes.get(1, 0.0) + 1) / (sum(sizes.values()) + 2)
    contexts = common.written(term_contexts(sample), "toxic-terms")
    halfway = ToxicModel(*pick_terms(contexts, F.col("t0"), F.col("c0"), share))
    halfway.clean = known_clean(contexts, F.col("t0"), F.col("c0"), halfway)

    def run(batches):
        kinds = halfway.kinds()
        for batch in batches:
            X = np.asarray([hit_counts(x or b"", kinds) for x in batch.column("text").cast(pa.binary()).to_pylist()],
                           dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(x) for x in X.T.copy())],
                                             ["doc_id", "y", *FEATURES])

    rows = (sample.where("half = 1").mapInArrow(run, "doc_id bigint, y int, " + ", ".join(f"{f} double" for f in FEATURES))
            .orderBy("doc_id").toPandas())
    model = ToxicModel(*pick_terms(contexts, F.col("t"), F.col("c"), share))
    model.clean = known_clean(contexts, F.col("t"), F.col("c"), model)
    if len(rows):
        model.weights = fit_weights(rows[FEATURES].to_numpy(dtype=np.float64), rows["y"].to_numpy(dtype=np.float64))
    return model


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    common.ready(spark)
    docs, held = common.read(spark, sf_dir, "documents"), common.in_fold(F.col("doc_id"), 4, 2)
    model = train(docs, common.read(spark, sf_dir, "labels"), held)

    def run(batches):
        kinds = model.kinds()
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(texts, kinds))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose score stays below 0.3, with their columns as they were."""
    common.ready(spark)
    model = train(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"),
                  common.in_fold(F.col("doc_id"), 4, 2))
    held: list[Kinds] = []

    def keeps(texts: list[bytes]) -> np.ndarray:
        if not held:
            held.append(model.kinds())
        return model.score(texts, held[0]) < 0.3

    return quality_classifier.keep_rows(docs, keeps)
