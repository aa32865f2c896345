"""The best documents of one block for each of its questions, scoring few pairs exactly.

A block is a bounded number of questions and documents (``similarity`` splits
hot cells).  Both scorers bound every pair's cosine first and score exactly
only pairs that can still be among the best ``k`` and reach ``need``, a limit
per question; what they leave out is proven out, so results do not change.

* ``quantised_pairs``: real vectors.  Unit vectors become 8-bit integers with a
  scale per vector and the length of what rounding took away.  By the
  Cauchy-Schwarz inequality the integer dot product, scaled back, is off by at
  most those lengths, which gives a lower and an upper bound of each cosine.
* ``posting_pairs``: count vectors.  The block's documents are inverted into
  posting lists with the largest impact (count over the document's norm) of
  each list.  A question reads its lists in the order of what they can add
  (max-score): lists that cannot lift a document to ``need`` together are not
  read for new documents but looked up, some at a time, for those still in the
  running; a document whose partial sum plus all that can still come stays below
  ``need`` or below the k-th best partial sum is dropped.
* ``product_pairs``: both kinds.  Float32 matrix products give every cosine to
  within the rounding of their sums, for which there is a bound; they cost a
  fixed few nanoseconds a pair whatever the data, so large blocks use them, in
  tiles (``near_pairs``).  ``Documents`` holds a block's documents for that.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np

SLACK = 1e-9          # far above rounding of float64 sums of unit vectors
PAIRS_AT_ONCE = 1 << 18
TILE_QUESTIONS, TILE_DOCS = 256, 2048  # sides of a matrix of products: 2 MB
HELD_PAIRS = 1 << 18  # pairs held while their question's k-th best product is still rising
UNITS_AT_ONCE = 512   # rows whose float64 copies exist at once
LOOKED_UP = 16        # posting lists looked up at once for the documents in the running


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; zero rows stay zero."""
    n = np.sqrt((m * m).sum(axis=1))
    return np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)


def unit_float32(m: np.ndarray) -> np.ndarray:
    """``unit_rows`` of any kind of numbers in float32; float64 copies are made of some rows at a time, not of the whole block."""
    out = np.empty(m.shape, dtype=np.float32)
    for at in range(0, len(m), UNITS_AT_ONCE):
        out[at:at + UNITS_AT_ONCE] = unit_rows(m[at:at + UNITS_AT_ONCE].astype(np.float64))
    return out


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit codes, scale, rest) of unit rows: ``codes * scale`` misses the row by a vector of length ``rest``."""
    u = unit_rows(m)
    scale = np.abs(u).max(axis=1, initial=0.0) / 127.0
    codes = np.rint(np.divide(u, scale[:, None], out=np.zeros_like(u), where=scale[:, None] > 0))
    return codes.astype(np.int8), scale, np.sqrt(((u - codes * scale[:, None]) ** 2).sum(axis=1))


def _kth_largest(m: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; -inf where there are fewer."""
    if m.shape[1] < k:
        return np.full(len(m), -np.inf)
    return -np.partition(-m, k - 1, axis=1)[:, k - 1]


def quantised_pairs(q: np.ndarray, d: np.ndarray, k: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(question, document) numbers of all pairs that may be among a question's best ``k`` with a cosine of ``need``."""
    (qc, qs, qr), (dc, ds, dr) = quantise(q), quantise(d)
    # sums of products of 8-bit integers are exact in float32 up to 2 ** 24
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (qc.astype(kind) @ dc.astype(kind).T).astype(np.float64) * qs[:, None] * ds[None, :]
    off = dr[None, :] + qr[:, None] * (1.0 + dr)[None, :] + SLACK
    floor = np.maximum(need - SLACK, _kth_largest(near - off, k))
    return np.nonzero(near + off >= floor[:, None])


def pack(v: np.ndarray) -> bytes:
    """A vector as bytes: the type of its numbers in three letters, then the numbers, whole ones in the least type that holds them."""
    if v.dtype.kind in "iu":
        least, most = v.min(initial=0), v.max(initial=0)
        v = v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))
    return v.dtype.str.encode() + v.tobytes()


def unpack(packed) -> np.ndarray:
    """The matrix of packed vectors, in the least type that holds them all: a byte a number for small counts."""
    return np.stack([np.frombuffer(x, x[:3].decode(), offset=3) for x in packed])


def product_pairs(q: np.ndarray, d: np.ndarray, k: int, need: np.ndarray, visits: np.ndarray, start: np.ndarray):
    """Yields (question, document) numbers of all pairs that may be among a question's best ``k`` with a cosine of ``need``.

    ``q`` and ``d`` are unit rows in float32.  ``visits`` (a row per question, a column per part) says which parts a question may
    meet; part ``p`` are the documents from ``start[p]`` to ``start[p + 1]``.
    """
    part = np.repeat(np.arange(len(start) - 1), np.diff(start))
    yield near_pairs(q, ((at, d[at:at + TILE_DOCS], part[at:at + TILE_DOCS]) for at in range(0, len(d), TILE_DOCS)), k, need, visits)


def near_pairs(q: np.ndarray, tiles, k: int, need: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``product_pairs`` over documents that come as ``tiles``: (number of the first, unit rows in float32, their parts in order).

    A tile meets only the questions that visit one of its parts, ``TILE_QUESTIONS`` at a time, so that products stay in the
    processor's cache.  The best ``k`` products of each question so far raise what the next tiles have to reach.
    """
    off = (q.shape[1] + 8) * 2.0 ** -24 + SLACK  # rounding to float32, of the products and of their sums in any order
    need, top = need.astype(np.float64), np.full((len(q), k), -np.inf, dtype=np.float32)
    none = np.zeros(0, dtype=np.int64)
    found, most = [(none, none, np.zeros(0, dtype=np.float32))], HELD_PAIRS

    def tile(rows, begin, d, spans):
        near = q[rows] @ d.T
        for p, a, b in spans:
            near[~visits[rows, p], a:b] = -np.inf
        floor = (need[rows] - off).astype(np.float32)
        hit = np.flatnonzero(near >= floor[:, None])
        if not len(hit):
            return
        i = hit // near.shape[1]
        many = np.flatnonzero(np.bincount(i, minlength=len(rows)) > 4 * k)
        if len(many):
            best = near[many]
            best[np.isnan(best)] = -np.inf
            floor[many] = np.maximum(floor[many], (_kth_largest(best, k) - 2 * off).astype(np.float32))
            hit = hit[near.ravel()[hit] >= floor[i]]
            i = hit // near.shape[1]
        val = near.ravel()[hit]
        order = np.lexsort((-val, i))
        place = np.arange(len(i)) - np.searchsorted(i, i)
        first = place < k
        new = np.full((len(rows), 2 * k), -np.inf, dtype=np.float32)
        new[:, :k] = top[rows]
        new[i[first], k + place[first]] = val[order][first]
        top[rows] = -np.partition(-new, k - 1, axis=1)[:, :k]
        need[rows] = np.maximum(need[rows], top[rows].min(axis=1) - off)
        found.append((rows[i], hit % near.shape[1] + begin, val))

    def kept():
        rows, cols, val = (np.concatenate(x) for x in zip(*found))
        reach = val >= (need[rows] - off).astype(np.float32)
        return rows[reach], cols[reach], val[reach]

    for begin, d, part in tiles:
        here, at = np.unique(part, return_index=True)
        ends = np.append(at[1:], len(part))
        asks = np.flatnonzero(visits[:, here].any(axis=1))
        for some in (asks[x:x + TILE_QUESTIONS] for x in range(0, len(asks), TILE_QUESTIONS)):
            shut = ~visits[np.ix_(some, here)].all(axis=0)
            tile(some, begin, d, [(here[x], at[x], ends[x]) for x in np.flatnonzero(shut)])
        if sum(len(x[0]) for x in found) > most:  # what later tiles have outdone goes
            found = [kept()]
            most = max(HELD_PAIRS, 2 * len(found[0][0]))
    return kept()[:2]


def dots_in_order(q: np.ndarray, d: np.ndarray, qi: np.ndarray, di: np.ndarray) -> np.ndarray:
    """Dot products of the pairs, summed in float64 in the order of dimensions (the number any engine gets that sums so)."""
    out = np.zeros(len(qi))
    qt, dt = np.ascontiguousarray(q.T), np.ascontiguousarray(d.T)
    for at in range(0, len(qi), PAIRS_AT_ONCE):
        a, b, s = qi[at:at + PAIRS_AT_ONCE], di[at:at + PAIRS_AT_ONCE], out[at:at + PAIRS_AT_ONCE]
        for x, y in zip(qt, dt):
            s += x[a].astype(np.float64) * y[b].astype(np.float64)
    return out


class Documents:
    """The documents of a block, which its questions pass by: vectors in the type they travel in, by tiles.

    They are added in the order of their parts, of a part in that of their ids.  Of equal vectors in a part only the ``k`` first
    can be among the best ``k``: the others are not held.
    """

    def __init__(self, k: int):
        self.k, self.tiles, self.numbers, self.size = k, [], [], 0  # numbers: of the documents added, which ones are held
        self._equal: Counter = Counter()
        self._part, self._waiting = None, []

    def add(self, packed: list, parts: np.ndarray, number: int) -> None:
        """Documents of which the first has this number."""
        for i, (v, part) in enumerate(zip(packed, parts.tolist())):
            if part != self._part:
                self._part = part
                self._equal.clear()
            digest = hashlib.blake2b(v, digest_size=16).digest()
            self._equal[digest] += 1
            if self._equal[digest] <= self.k:
                self._waiting.append((v, part, number + i))
                if len(self._waiting) == TILE_DOCS:
                    self._close()

    def _close(self) -> None:
        if self._waiting:
            packed, parts, numbers = zip(*self._waiting)
            self.tiles.append((self.size, unpack(packed), np.asarray(parts)))
            self.numbers.append(np.asarray(numbers))
            self.size += len(packed)
            self._waiting = []

    def pairs(self, q: np.ndarray, k: int, need: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, document, dot product) of all pairs that may be among a question's best ``k`` with a cosine of ``need``."""
        self._close()
        rows, cols = near_pairs(unit_float32(q), ((at, unit_float32(m), part) for at, m, part in self.tiles), k, need, visits)
        dots = np.zeros(len(rows))
        order = np.argsort(cols, kind="stable")
        ends = np.searchsorted(cols[order], [at + len(m) for at, m, _ in self.tiles])
        for (at, m, _), a, b in zip(self.tiles, np.append(0, ends[:-1]), ends):
            some = order[a:b]
            if len(some):
                met, row = np.unique(rows[some], return_inverse=True)
                dots[some] = dots_in_order(q[met], m, row, cols[some] - at)
        return rows, np.concatenate([np.zeros(0, dtype=np.int64), *self.numbers])[cols], dots


class Postings:
    """Posting lists of a block of count vectors: per dimension its documents, their impacts and the largest of these."""

    def __init__(self, d: np.ndarray, norms: np.ndarray):
        self.rows, dims = d, d.shape[1]
        dim, self.doc = np.nonzero(d.T)
        self.inverse = np.divide(1.0, norms, out=np.zeros_like(norms), where=norms > 0)
        self.impact = d[self.doc, dim] * self.inverse[self.doc]
        self.start = np.searchsorted(dim, np.arange(dims + 1))
        self.peak = np.zeros(dims)
        np.maximum.at(self.peak, dim, self.impact)

    def candidates(self, q: np.ndarray, k: int, need: float) -> tuple[np.ndarray, int]:
        """Documents that may be among the best ``k`` for the unit question ``q`` with a cosine of ``need``; how many were touched."""
        n = len(self.rows)
        terms = np.flatnonzero(q * self.peak)
        terms = terms[np.argsort(-(q[terms] * self.peak[terms]), kind="stable")]
        bound = q[terms] * self.peak[terms]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)  # what the lists from each one on can add together
        read = int(np.argmax(rest < need - SLACK)) if need > SLACK else len(terms)
        length = self.start[terms[:read] + 1] - self.start[terms[:read]]
        at = np.arange(length.sum()) + np.repeat(self.start[terms[:read]] - np.cumsum(length) + length, length)
        seen = np.bincount(self.doc[at], weights=np.repeat(q[terms[:read]], length) * self.impact[at], minlength=n)
        floor = need
        if n >= k:
            floor = max(need, np.partition(seen, n - k)[n - k])
        left = np.flatnonzero(seen + rest[read] >= floor - SLACK)
        part, touched = seen[left], int((seen > 0).sum())
        while read < len(terms) and len(left) > 2 * k:
            some = terms[read:read + LOOKED_UP]
            part = part + (self.rows[np.ix_(left, some)] * self.inverse[left, None]) @ q[some]
            read += len(some)
            if len(left) >= k:
                floor = max(floor, np.partition(part, len(left) - k)[len(left) - k])
            keep = part + rest[read] >= floor - SLACK
            left, part = left[keep], part[keep]
        return left, touched


def posting_pairs(q: np.ndarray, d: np.ndarray, q_norms: np.ndarray, d_norms: np.ndarray, k: int,
                  need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(question, document, dot product) of all pairs that may matter, and how many pairs the lists read have touched.

    Counts are whole numbers of 0 or more, so sums of their products are exact in float64 whatever the order.
    """
    lists, touched = Postings(d, d_norms), 0
    qi, di, dots = [], [], []
    for i, (row, norm) in enumerate(zip(q, q_norms)):
        docs, seen = lists.candidates(row / norm if norm > 0 else row, k, float(need[i]))
        touched += seen
        qi.append(np.full(len(docs), i))
        di.append(docs)
        dots.append(d[docs] @ row)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *qi]), np.concatenate([none, *di]), np.concatenate([np.zeros(0), *dots]), touched
