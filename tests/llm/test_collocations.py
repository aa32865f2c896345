import random
import re
from collections import Counter, defaultdict

import pytest

from askframe.llm import collocations as C

ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs, max_words):
    """lang -> number of words -> phrase -> occurrences, plainly."""
    f = defaultdict(lambda: defaultdict(Counter))
    for _, text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ABC)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                f[lang or "und"][k].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return f


def brute(docs, top=2000, max_words=3, min_count=10):
    out = []
    for lang, by in counted(docs, max_words).items():
        count = {p: n for c in by.values() for p, n in c.items()}
        total = sum(by[1].values())
        cand = {p: n for p, n in count.items() if len(p) > 1 and n >= min_count}
        rows = []
        for p, a in cand.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


def some_docs(seed, n=120):
    rng = random.Random(seed)
    common = ["the", "of", "To", "é", "a", "\x1c", "in"]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 80)):
            words.append(rng.choice(common) if rng.random() < .6 else f"w{rng.randint(0, 60)}")
            if rng.random() < .08:
                words.append("New york city" if rng.random() < .7 else "NEW York")
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for w in words)
        out.append((i, text, rng.choice(["en", "en", "de", None])))
    return out + [(n, None, "en"), (n + 1, "", None), (n + 2, "x", "fr"), (None, " \n.,", "fr")] + out[:3]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(spark, seed):
    docs = some_docs(seed)
    got = sorted(map(tuple, C.collocations(frame(spark, docs), window=700).collect()))
    assert got == brute(docs) and len(got) > 30


@pytest.mark.parametrize("rate,lowered,bits", [(0.02, None, 12), (0.5, 2, 12), (0.2, 1, 4), (1.0, 10, 19), (0.0, None, 10)])
def test_any_sample_and_any_filter_give_the_same_counts(spark, rate, lowered, bits):
    docs = some_docs(3)
    found = C.frequent_phrases(frame(spark, docs), max_words=4, min_count=5, sample_rate=rate, lowered=lowered, filter_bits=bits, window=900)
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in found.collect() if r["words"]}
    want = {(lang, p): n for lang, by in counted(docs, 4).items() for c in by.values() for p, n in c.items() if n >= 5}
    assert got == want


def test_a_failure_of_the_sample_starts_an_expansion_pass(spark, monkeypatch):
    passes = []
    original = C.count_phrases
    monkeypatch.setattr(C, "count_phrases", lambda *a, **k: passes.append(k.get("expand", False)) or original(*a, **k))
    docs = [(i, "alpha beta gamma", "en") for i in range(30)]
    C.frequent_phrases(frame(spark, docs), sample_rate=0.0)  # proposes nothing: every word fails
    assert passes == [False, False, False, True]
    passes.clear()
    C.frequent_phrases(frame(spark, docs), sample_rate=1.0)
    assert passes == [False, False, False]


def test_long_texts_pass_through_windows(spark, monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice(["a", "b", "c d", "e."]) for _ in range(30_000))
    docs = [(1, text, "en"), (2, "q" * 300_000 + " a b", "en"), (3, " " * 200_000 + "a b", "en")]
    want = {(p, n) for c in counted(docs, 3)["en"].values() for p, n in c.items() if n >= 10}
    monkeypatch.setattr(C, "SLICE", 1000)
    found = C.frequent_phrases(frame(spark, docs), window=2500)
    assert {(tuple(r["phrase"].split(" ")), r["n"]) for r in found.collect() if r["words"]} == want


def test_empty_table_other_columns_and_bytes(spark):
    assert C.collocations(frame(spark, [])).collect() == []
    raw = spark.createDataFrame([(bytearray(b"\xff\xfe caf\xe9 A"),)] * 12, "b binary").selectExpr(
        "1L AS doc_id", "CAST(b AS STRING) AS text", "'en' AS lang", "2 AS n", "'x' AS phrase", "true AS open")
    rows = C.collocations(raw).selectExpr("CAST(phrase AS BINARY) AS p", "a", "n").collect()
    assert [(bytes(r["p"]), r["a"], r["n"]) for r in rows] == [(b"\xff\xfe caf\xe9 a", 12, 36)]


def test_large_counts_score_exactly(spark):
    big = 999_999_999_998
    rows = [("en", 1, "x", big), ("en", 1, "y", big - 7), ("en", 2, "x y", big - 9)]
    got = C.score_phrases(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).first()
    assert got["score"] == 1_000_000 * (big - 9) ** 2 // (big * (big - 7))


def test_a_phrase_that_a_filter_holds_by_chance_was_not_counted_before(spark):
    docs = frame(spark, [(i, "alpha beta gamma", "en") for i in range(12)])
    of = lambda *phrases: C.filter_of(spark.createDataFrame([("en", p) for p in phrases], "lang string, phrase string"), 19)
    by_chance = of("alpha", "gamma", "alpha beta", "beta gamma")  # both pairs, but not the word they share: neither was reached
    assert C.count_phrases(docs, {2, 3}, by_chance).count() == 0
    found = C.count_phrases(docs, {2, 3}, of("alpha", "beta", "gamma"), [by_chance], expand=True)
    assert {r["phrase"]: r["n"] for r in found.collect()} == {"alpha beta": 12, "beta gamma": 12, "alpha beta gamma": 12}
