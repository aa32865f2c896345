import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from askframe.llm import conversation_repair as R

CODES = [a + b for a in "sua-" for b in ".tx"]


def slow(codes, start=0, ends=R.ENDS):
    """Least (cost, audit) by relaxing every edge until nothing changes."""
    best = {(0, start): (0, "")}
    changed = True
    while changed:
        changed = False
        for (i, s), (cost, audit) in list(best.items()):
            for letter, c, j, t in R._steps(tuple(codes), i, s):
                new = (cost + c, audit + letter)
                if (j, t) not in best or new < best[j, t]:
                    best[j, t] = new
                    changed = True
    found = [best[len(codes), e] for e in ends if (len(codes), e) in best]
    return min(found) if found else None


def written_out(codes):
    """Least (cost, audit) over all edit sequences with at most two inserts in a row, checked by the pattern itself."""
    best = None
    letters = []
    for code in codes:
        choices = ["D"] if code[1] == "x" else ["D", "K", "Ru", "Ra"]
        letters.append(choices)
    gaps = ["", "u", "a", "ua", "au"]
    for rows in itertools.product(*letters):
        for inserts in itertools.product(gaps, repeat=len(codes) + 1):
            roles, audit, cost = "", "", 0
            for code, edit, gap in zip([None, *codes], [None, *rows], inserts):
                if edit:
                    audit += edit[0]
                    cost += {"D": 3, "K": 0, "R": 2}[edit[0]] + (edit != "D" and code[1] == "t")
                    roles += "" if edit == "D" else code[0] if edit == "K" else edit[1]
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 2 * len(gap)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_search_equals_enumeration_of_edits():
    rng = random.Random(3)
    for _ in range(60):
        codes = tuple(rng.choice(CODES) for _ in range(rng.randint(0, 2)))
        assert R.cheapest(codes) == written_out(codes)


def test_bidirectional_search_equals_relaxation():
    rng = random.Random(5)
    for _ in range(1500):
        codes = tuple(rng.choice(CODES) for _ in range(rng.randint(0, 12)))
        start, ends = rng.choice([(0, R.ENDS), (0, (2,)), (1, (3,)), (2, (2,)), (2, (0,)), (3, (3,)), (3, (1,))])
        assert R.cheapest(codes, start, ends) == slow(codes, start, ends)


def brute(rows, damage=True):
    """Everything the query returns, from plain rows, one conversation at a time."""
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kept = conversations[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20 if damage else -1
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, faults = set(), [], defaultdict(int)
        for turn, role, text in kept:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            kind = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            faults[kind] += 1
            codes.append((role[:1] if role[:1] in tuple("sua") else "-") + {"truncated": "t", None: "."}.get(kind, "x"))
        cost, audit = slow(codes)
        turns = [t for t, _, _ in kept if t is not None]
        lines, state, at = [], 0, 0
        for letter in audit:
            if letter == "I":
                role, text = None, ""
            else:
                role, text = kept[at][1:]
                at += 1
                if letter == "D":
                    continue
            if letter != "K":
                role = "assistant" if state == 2 else "user"
            state = R.STEPS[state][role[0]]
            lines.append(f"{role}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"],
                     faults["truncated"], sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    assert df.columns[0] == "conv_id"
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def some_rows(seed, conversations=60):
    rng = random.Random(seed)
    texts = ["Hello.", "What is it?", "no end", "", "  \n", "Stop!  ", "fin…", "é.", " ", None, "Hello.", "a\x1c"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(c, t if rng.random() < .9 else None, roles[(t + (rng.random() < .2)) % 2] if rng.random() < .8 else rng.choice(roles),
             rng.choice(texts)) for c in range(conversations) for t in range(rng.randint(1, 9))] + [(None, 3, "user", "Hi.")] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tables, seed):
    rows = some_rows(seed)
    assert result(R.op13(spark, tables(conversations=rows))) == brute(rows)


def test_all_rows_dropped(spark, tables):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    got = result(R.op13(spark, tables(conversations=[(dropped, 1, "user", "Hi.")])))
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversations_in_blocks(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "", f"{t}!", f"{t}"]))
            for c in range(3) for t in range(60 + 7 * c)] + [(7, t, "tool", "") for t in range(40)] + [(8, t, "system", f"{t}.") for t in range(40)]
    df = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, gone boolean")
    want = brute(rows, damage=False)
    for block in (1, 5, 16, 512):
        assert result(R.repair_conversations(df, block)) == want
    held = R.Repair(8)
    for t in range(4000):  # a hot conversation leaves nothing behind but its audit
        held.row(t, (b"user", b"assistant", b"assistant")[t % 3], b"%d." % t, False)
        assert len(held.waiting) < 100
    assert held.finish()["cost"] > 0


def test_empty_table_extra_columns_and_one_shuffle(spark, tables):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair_conversations(R.damaged(empty)).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 5), (1, 1, "assistant", "Yes.", "y", 6)],
                                 "conv_id long, turn long, role string, text string, audit string, fault long")
    df = R.repair_conversations(R.damaged(rows))
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
