"""Conversation structure repair: the cheapest edits that give a conversation its turn order.

A repaired conversation's role initials match ``(s?(ua)+)?``.  The edit lattice
has a node per (rows consumed, state of that pattern) and edges Keep (0),
Rerole to user/assistant (2), Delete (3) and Insert an empty user/assistant
message (2); a truncated row that stays costs 1 more; blank and duplicate rows
must go.  In each state one of user/assistant can follow, so the initials of
the edits (the audit) say everything about them.

``cheapest`` searches the lattice from both ends (bidirectional Dijkstra): a
forward and a reverse heap hold (cost, rows left, audit), nodes of equal cost
come in the order in which free edges lead, and each keeps the least audit of
its cost.  When the heaps' tops add up to more than the best path seen, every
edge between the two sides whose costs add up to the best is a crossing; the
least concatenation wins.  Two audits of equal cost at one node are never
prefixes of each other (they would differ by inserts, which cost), so least
prefix and least suffix give the least whole.

A long conversation is searched in blocks of ``BLOCK`` rows, from every state
to every state, and the blocks are chained over the four states.  What the four
audits have in common is final: its rows are hashed and forgotten.  So the one
task that reads a hot conversation needs time, not memory (rows are sorted by
Spark, which spills); the digest of a conversation is sequential by nature.

Defined cases: rows with the same turn go by role, then text (null turns
first); null role, text, ids and turns enter the damage and the faults as one
space; a role without the initial s, u or a can only be reroled or deleted; a
conversation without rows has zeros, an empty audit and the digest of the empty
string; repeated rows are duplicates; a null conv_id is one conversation;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askframe.llm import common

BLOCK = 512         # rows of a conversation searched at once
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# The pattern (s?(ua)+)? as an automaton: state -> {initial: next state}; ENDS accept.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
SPACE = b" \t\n\x0b\x0c\r"

# What each state can become, and a state's labels that cost more than that of state 3 by more than this cannot win:
# whatever follows state 0 or 1 can follow state 3 as well, but for a kept system message (one Delete).
REACHED = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
DOMINATED = {0: DELETE, 1: 0}

# A row is a code: its role's initial if that is s, u or a (else "-"), with a fault: "x" blank or duplicate, "t" truncated, "." none.
Code = str


def _edges(code: Code, state: int):
    """(letter, cost, next state) of the edits that consume a row; the least letter first."""
    initial, fault = code
    yield "D", DELETE, state
    if fault == "x":
        return
    extra = TRUNCATED if fault == "t" else 0
    for role, to in STEPS[state].items():
        if role == initial:
            yield "K", KEEP + extra, to
        if role in ROLE:
            yield "R", REROLE + extra, to


def _inserts(state: int):
    return [("I", INSERT, to) for role, to in STEPS[state].items() if role in ROLE]


def cheapest(codes: tuple[Code, ...], start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest way from ``start`` to one of ``ends`` over all rows; None if there is none."""
    n = len(codes)
    ahead: list[list[list[tuple]]] = [[_steps(codes, i, s) for s in range(4)] for i in range(n + 1)]
    behind: list[list[list[tuple]]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    for i in range(n + 1):
        for s in range(4):
            for letter, cost, j, t in ahead[i][s]:
                behind[j][t].append((letter, cost, i, s))
    # best (cost, audit) per node, and heaps in the order of cost, then of the rows a free edge leads along
    fwd, rev = {(0, start): (0, "")}, {(n, e): (0, "") for e in ends}
    fheap, rheap = [(0, 0, start)], [(0, 0, e) for e in ends]
    fdone, rdone = set(), set()
    best = 0 if n == 0 and start in ends else None
    while fheap and rheap and (best is None or fheap[0][0] + rheap[0][0] <= best):
        if fheap[0][0] <= rheap[0][0]:
            cost, i, s = heappop(fheap)
            if (i, s) in fdone or cost > fwd[i, s][0]:
                continue
            fdone.add((i, s))
            audit = fwd[i, s][1]
            for letter, c, j, t in ahead[i][s]:
                new, old = (cost + c, audit + letter), fwd.get((j, t))
                if old is None or new < old:
                    fwd[j, t] = new
                    if old is None or new[0] < old[0]:
                        heappush(fheap, (new[0], j, t))
                if (j, t) in rev and (best is None or new[0] + rev[j, t][0] < best):
                    best = new[0] + rev[j, t][0]
        else:
            cost, left, s = heappop(rheap)
            i = n - left
            if (i, s) in rdone or cost > rev[i, s][0]:
                continue
            rdone.add((i, s))
            audit = rev[i, s][1]
            for letter, c, j, t in behind[i][s]:
                new, old = (cost + c, letter + audit), rev.get((j, t))
                if old is None or new < old:
                    rev[j, t] = new
                    if old is None or new[0] < old[0]:
                        heappush(rheap, (new[0], n - j, t))
                if (j, t) in fwd and (best is None or new[0] + fwd[j, t][0] < best):
                    best = new[0] + fwd[j, t][0]
    if best is None:
        return None
    found = [""] if n == 0 and start in ends and best == 0 else []
    for (i, s), (cost, prefix) in fwd.items():
        for letter, c, j, t in ahead[i][s]:
            other = rev.get((j, t))
            if other is not None and cost + c + other[0] == best:
                found.append(prefix + letter + other[1])
    return best, min(found)


def _steps(codes: tuple[Code, ...], i: int, s: int) -> list[tuple]:
    out = [(letter, cost, i, t) for letter, cost, t in _inserts(s)]
    if i < len(codes):
        out += [(letter, cost, i + 1, t) for letter, cost, t in _edges(codes[i], s)]
    return out


@lru_cache(maxsize=50_000)
def _remembered(codes: tuple[Code, ...], start: int, ends: tuple[int, ...]):
    return cheapest(codes, start, ends)


def search(codes: tuple[Code, ...], start: int = 0, ends: tuple[int, ...] = ENDS):
    """``cheapest``; that of short conversations, which repeat, is remembered."""
    return _remembered(codes, start, ends) if len(codes) <= 32 else cheapest(codes, start, ends)


class Repair:
    """One conversation as its rows come: faults, cheapest edits and the digest of what they give."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.codes: list[Code] = []
        self.waiting: list[tuple[bytes, bytes]] = []   # rows whose edit is not final
        self.labels: dict[int, tuple[int, str]] = {0: (0, "")}   # state -> (cost, audit after the final part)
        self.audit: list[str] = []
        self.state = 0                                  # of the pattern, after the final part
        self.digest, self.first = hashlib.sha256(), True
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial = 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def row(self, turn: int | None, role: bytes, text: bytes, duplicate: bool) -> None:
        shown = text.strip(SPACE)
        kind = "blank" if not shown else "duplicate" if duplicate else "truncated" if shown[-1:] not in b".!?" else None
        if kind:
            self.faults[kind] += 1
        initial = role[:1].decode("latin-1")
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        self.codes.append((initial if initial in ("s", "u", "a") else "-") + ("t" if kind == "truncated" else "x" if kind else "."))
        self.waiting.append((role, text))
        if len(self.codes) == self.block:
            self._chain(range(4))

    def _chain(self, ends) -> None:
        """Carry the labels over the rows collected; what all of them share is final."""
        codes, self.codes = tuple(self.codes), []
        new: dict[int, tuple[int, str]] = {}
        for s, (cost, audit) in self.labels.items():
            for e in set(ends) & set(REACHED[s]):
                way = search(codes, s, (e,))
                if way is not None:
                    label = (cost + way[0], audit + way[1])
                    if e not in new or label < new[e]:
                        new[e] = label
        if 3 in new:
            new = {s: label for s, label in new.items() if label[0] <= new[3][0] + DOMINATED.get(s, label[0])}
        audits = [audit for _, audit in new.values()]
        low, high = min(audits), max(audits)
        k = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        self._apply(low[:k])
        self.labels = {s: (cost, audit[k:]) for s, (cost, audit) in new.items()}

    def _apply(self, letters: str) -> None:
        """Take edits as final: hash what they leave."""
        at = 0
        for letter in letters:
            if letter == "I":
                self._put(None, b"")
                continue
            role, text = self.waiting[at]
            at += 1
            if letter != "D":
                self._put(role if letter == "K" else None, text)
        self.waiting = self.waiting[at:]
        self.audit.append(letters)

    def _put(self, role: bytes | None, text: bytes) -> None:
        if role is None:  # the role that can follow; after the start and after "a" that is the user
            initial = "a" if self.state == 2 else "u"
            role = ROLE[initial].encode()
        else:
            initial = role[:1].decode("latin-1")
        self.state = STEPS[self.state][initial]
        self.digest.update((b"" if self.first else b"\n") + role + b":")
        self.digest.update(text)
        self.first = False

    def finish(self) -> dict:
        if len(self.labels) == 1 and not self.audit and self.codes:
            cost, audit = search(tuple(self.codes))
            self.labels, self.codes = {0: (cost, audit)}, []
        elif self.codes:
            self._chain(ENDS)
        cost, audit = min(label for s, label in self.labels.items() if s in ENDS)
        self._apply(audit)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit),
                "repaired_sha256": self.digest.hexdigest()}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the damage of the query; a dropped row stays as a marker with ``gone``."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                (F.crc32(key) % 20).alias("fault"))
    fault = F.col("fault")
    return rows.select(
        "conv_id", "turn", F.when(fault == 0, "").when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (fault == 0).alias("gone"), F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    ).drop("copy")


RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")


def repair_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): its faults, cheapest edits and repaired digest.

    One shuffle by conversation: the numbering of equal messages and the order
    of turns are two sorts inside the same partitions.
    """
    seen = W.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    ordered = (rows.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1)
               .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")
               .select("conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"),
                       "gone", "again"))
    fields = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        held, current, out = None, None, []

        def table():
            return pa.RecordBatch.from_pydict({f: [r[f] for r in out] for f in fields}, schema=schema)

        schema = pa.schema([(f, pa.string() if f in ("audit", "repaired_sha256") else pa.int64()) for f in fields])
        for batch in batches:
            for conv, turn, role, text, gone, again in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or conv != current:
                    if held is not None:
                        out.append({"conv_id": current, **held.finish()})
                    held, current = Repair(block), conv
                if not gone:
                    held.row(turn, role, text, again)
            if len(out) >= 500:
                yield table()
                out = []
        if held is not None:
            out.append({"conv_id": current, **held.finish()})
        if out:
            yield table()

    return ordered.mapInArrow(run, RESULT)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the contract's rule and repaired."""
    common.ready(spark)
    return repair_conversations(damaged(common.read(spark, sf_dir, "conversations")))
