"""Quality classifier (8), quality rules (9) and toxicity (1): held-out accuracy and exact parts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askframe.llm import common, docstats, quality_classifier, quality_rules, toxicity, trees

from corpora import INSULTS, documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(tables):
    docs, labels = documents(400)
    return tables(documents=docs, labels=labels + [(3, None, None), (99_999, 0, 1), (None, 1, 1)])


def rest(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


@pytest.mark.parametrize("op, modulus, held, target", [(quality_classifier.op8, 5, 0, 1), (toxicity.op1, 4, 2, 2)])
def test_held_out_rows_are_told_apart(spark, folder, op, modulus, held, target):
    docs, labels = documents(400)
    truth = {x[0]: x[target] for x in labels}
    rows = op(spark, folder).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in docs)
    assert all(r["held_out"] == (rest(r["doc_id"], modulus) == held) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    seen = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert {y for y, _ in seen} == {0, 1} and sum(y == p for y, p in seen) >= 0.97 * len(seen)
    repeated = {r["doc_id"]: r["score"] for r in rows}
    assert all(repeated[r["doc_id"]] == r["score"] for r in rows)


def test_labels_of_the_held_out_fold_and_other_columns_are_not_read(spark, folder, tables):
    docs, labels = documents(400)
    flipped = [(d, q if rest(d, 5) else 1 - q, t if rest(d, 4) != 2 else 1 - t) for d, q, t in labels]
    other = tables(documents=[(d, t, "xx", "yy", 0) for d, t, *_ in docs], labels=flipped)
    for op in (quality_classifier.op8, toxicity.op1):
        assert sorted(op(spark, folder).collect(), key=repr) == sorted(op(spark, other).collect(), key=repr)


@pytest.mark.parametrize("op", [quality_classifier.op8, toxicity.op1, quality_rules.op9])
def test_empty_tables_and_missing_labels(spark, tables, op):
    assert op(spark, tables(documents=[], labels=[])).collect() == []
    rows = op(spark, tables(documents=documents(5)[0], labels=[])).collect()
    assert len(rows) == 11


def slow_counts(t):
    t = t or ""
    words = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) for k in range(5) if windows[tuple(words[i:i + 5])] > 1}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)]


def test_op9_equals_brute_force(spark, tables):
    docs, labels = documents(120)
    extra = ["a b c d e a b c d e", "x " * 40, "l\n l\nl\nl\n\n\n", "é é é é é é é é é", "one\vtwo\fthree", "| # " * 9, "a b c d e f " * 3 + "g h"]
    docs += [(1000 + i, t, None, None, None) for i, t in enumerate(extra)]
    rows = {r["doc_id"]: r for r in quality_rules.op9(spark, tables(documents=docs, labels=labels)).collect()}
    for d, t, *_ in docs:
        got, want = [rows[d][c] for c in quality_rules.COUNTS], slow_counts(t)
        assert got == want, (d, t and t[:60])
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert rows[d]["base_failed"] == failed and not (failed and rows[d]["kept"])
    good = [d for d, q, _ in labels if q]
    bad = [d for d, q, _ in labels if not q]
    assert np.mean([rows[d]["kept"] for d in good]) > 0.97 and np.mean([rows[d]["kept"] for d in bad]) < 0.1


def test_flat_trees_score_as_nested_ones():
    draw = np.random.default_rng(0)
    X = draw.normal(size=(600, 4))
    y = ((X[:, 0] > 0) ^ (X[:, 1] > 0.5)).astype(float)
    model = trees.boost(X, y, np.ones(600), trees=20, depth=3)

    def walk(x, at):
        while model.left[at] != at:
            at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
        return model.value[at]

    slow = [model.base + model.rate * sum(walk(x, r) for r in model.roots) for x in X]
    assert np.allclose(model.score(X), slow) and ((model.score(X) > 0) == y).mean() > 0.9


def test_monotone_features_stay_monotone():
    draw = np.random.default_rng(1)
    X = draw.random((800, 3))
    y = (draw.random(800) < 0.5 + 0.4 * np.sin(9 * X[:, 0])).astype(float)  # goes up and down
    model = trees.boost(X, y, np.ones(800), trees=40, monotone={0: -1})
    for row in X[:20]:
        line = np.repeat(row[None], 200, axis=0)
        line[:, 0] = np.linspace(0, 1, 200)
        assert (np.diff(model.score(line)) <= 1e-9).all()


def test_rules_as_columns_equal_numpy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_classifier.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), common.in_fold(F.col("doc_id"), 5, 0))
    stats = quality_classifier.text_statistics(docs).withColumn("score", model.column()).toPandas()
    X = stats[[f"s_{f}" for f in docstats.FEATURES]].to_numpy()
    assert 0 < len(model.rules) and np.allclose(stats["score"], model.score(X))


def test_lasso_drops_noise():
    draw = np.random.default_rng(2)
    A = (draw.random((500, 30)) < 0.5).astype(float)
    y = (draw.random(500) < trees.sigmoid(4 * A[:, 3] - 2)).astype(float)
    _, w = quality_classifier.lasso_logistic(A, y, np.ones(500), 0.03)
    assert w[3] > 1 and (np.abs(np.delete(w, 3)) > 1e-9).sum() <= 3


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, z in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != z)))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["gromblat", "fizwort", "snarkel", "nasty", "abominables", "cat"]
    m = toxicity.Matcher(terms, [], terms)
    draw = np.random.default_rng(3)
    letters = "abcefgilmnorstwyz"
    for _ in range(4000):
        w = list(terms[draw.integers(len(terms))])
        for _ in range(draw.integers(0, 4)):
            at = int(draw.integers(1, len(w) + 1))
            what = draw.integers(3)
            if what == 0:
                w.insert(at, letters[draw.integers(len(letters))])
            elif at < len(w) and what == 1:
                w[at] = letters[draw.integers(len(letters))]
            elif at < len(w) and len(w) > 1:
                del w[at]
        w = "".join(w)
        near = [edit_distance(w, t) for t in terms if t[0] == w[0] and edit_distance(w, t) <= toxicity.edits_allowed(t)]
        want = 0 if not near else {0: toxicity.EXACT, 1: toxicity.EDIT1, 2: toxicity.EDIT2}[min(near)]
        assert m.kind(w) == want, (w, near)


def test_automaton_allows_edits_at_the_first_letter(monkeypatch):
    terms = ["stupid", "idiot", "gromblat", "abominables", "cat"]
    m = toxicity.Matcher(terms, [], terms)
    assert [m.kind(w) for w in ("ztupid", "tupid", "xidiot", "diot", "bat", "xxabominables")] == [toxicity.EDIT1] * 4 + [0, toxicity.EDIT2]
    monkeypatch.setattr(toxicity, "CACHE_SETS", 50)  # what is forgotten is built again
    draw, letters = np.random.default_rng(5), "abdgiopstuz"
    for _ in range(3000):
        w = list(terms[draw.integers(len(terms))])
        for _ in range(draw.integers(0, 4)):
            at, what = int(draw.integers(0, len(w))), draw.integers(3)
            w[at:at + (what > 0)] = [letters[draw.integers(len(letters))]] if what < 2 else []
            w = w or ["a"]
        w = "".join(w)
        near = [edit_distance(w, t) for t in terms if edit_distance(w, t) <= toxicity.edits_allowed(t)]
        want = 0 if not near else {0: toxicity.EXACT, 1: toxicity.EDIT1, 2: toxicity.EDIT2}[min(near)]
        assert m.kind(w) == want, (w, near)


def test_short_terms_take_one_edit_but_no_clean_word():
    """Every word at one edit of a term of four letters is found, clean words of the sample are not."""
    m = toxicity.Matcher(["scum", "cad"], [], ["scum"], {"scam", "sum"})
    letters = "abcdefghijklmnopqrstuvwxyz"
    near = {"scum"[:i] + c + "scum"[j:] for i in range(5) for j in (i, i + 1) if j <= 4 for c in ["", *letters]} - {"scum"}
    assert all(edit_distance(w, "scum") == 1 for w in near) and len(near) > 200
    assert {w for w in near if m.kind(w) != toxicity.EDIT1} == {"scam", "sum"}
    assert m.kind("scum") == toxicity.EXACT and m.kind("sucm") == m.kind("bad") == 0 and toxicity.edits_allowed("cad") == 0


def test_a_term_in_many_toxic_places_may_be_in_some_clean_ones(spark):
    rows = [(i, f"w{i}x gromblat", 1, i % 2) for i in range(400)] + [(1000 + i, f"v{i}x gromblat", 0, i % 2) for i in range(12)]
    rows += [(2000 + i, "w0x gromblat", 1, i % 2) for i in range(5)]  # copies of a place count once
    contexts = toxicity.term_contexts(spark.createDataFrame(rows, "doc_id long, text string, y int, half int"))
    r = contexts.where("term = 'gromblat' and not stem").first()
    assert (r["t0"], r["c0"], r["t1"], r["c1"], r["t"], r["c"]) == (200, 6, 201, 6, 400, 12)  # w0x in both halves
    words, _, _ = toxicity.pick_terms(contexts, F.col("t"), F.col("c"), 0.5)
    assert words == ["gromblat"]


def test_misspelled_stand_ins_stems_and_quotes():
    kinds = toxicity.Kinds(toxicity.Matcher(["snarkel"], ["grom"], ["snarkel"], {"snarke"}))
    f = dict(zip(toxicity.FEATURES, toxicity.hit_counts(b"you Snarkel!! and sn4rkel, snarkl snarke gromette", kinds)))
    # two exact hits, one stem, one misspelling; "snarke" is a known word
    assert math.isclose(math.expm1(f["log_open"]), 3.8) and f["edit_share"] == 0.25 and f["any_open"] == 1
    f = dict(zip(toxicity.FEATURES, toxicity.hit_counts('He said: "what a snarkel you are", and left'.encode(), kinds)))
    assert f["any_open"] == 0 and f["log_quoted"] > 0
    f = dict(zip(toxicity.FEATURES, toxicity.hit_counts('"Good day" snarkel you "bye"'.encode(), kinds)))
    assert f["any_open"] == 1


def test_words_without_ascii_spaces_count_as_words():
    m = lambda: toxicity.Kinds(toxicity.Matcher(["snarkel", "gromblat", "मूर्ख", "笨蛋"], [], ["snarkel"]))
    words = ["ba"] * 40 + ["snarkel", "do", "gromblat", "मूर्ख"] + ["lu"] * 60
    want = toxicity.hit_counts(" ".join(words).encode(), m())
    assert want[0] == 1 and want[1] == np.log1p(3)
    for sep in (",", "/", "-", "\u00a0", "_", "、", "\u2003"):
        text = sep.join(words).encode()
        assert len(text) > 200 and toxicity.hit_counts(text, m()) == want, sep
    assert math.isclose(math.expm1(toxicity.hit_counts(("你是个笨蛋吗" * 50).encode(), m())[1]), 50)
    # marks inside a word are still edits, whole tokens still one word
    assert toxicity.hit_counts(b"you snar*kel", m())[:2] == [1.0, np.log1p(0.8)]
    assert toxicity.hit_counts(b"x" * 500 + b" y", m()) == [0.0] * 6
    f = toxicity.hit_counts('He/said:"what,a,snarkel"/and,left'.encode(), m())
    assert f[0] == 0 and f[5] > 0
    f = toxicity.hit_counts('"don\'t/be,a,snarkel"'.encode(), m())
    assert f[0] == 0 and f[5] > 0
    assert toxicity.hit_counts('ba"lu"snarkel"do"me'.encode(), m())[0] == 1


def test_words_without_ascii_spaces_are_learned(spark):
    rows = [(i, f"ba{i}x,gromblat/lu f*zt\u00a0do", 1, 0) for i in range(9)] + [(50 + i, f"v{i}x lu do", 0, 0) for i in range(9)]
    contexts = toxicity.term_contexts(spark.createDataFrame(rows, "doc_id long, text string, y int, half int"))
    t = {r["term"]: r["t"] for r in contexts.where("not stem").collect()}
    assert t["gromblat"] == 9 and t["f*zt\u00a0do"] == 1


def test_all_lexicon_words_are_matched_with_edits(spark):
    draw = np.random.default_rng(9)
    terms = sorted({"".join(draw.choice(list("bdfgklmnprstvz"), 9)) for _ in range(900)})
    contexts = spark.createDataFrame([(t, False, 40, 0) for t in terms], "term string, stem boolean, t long, c long")
    words, _, fuzzy = toxicity.pick_terms(contexts, F.col("t"), F.col("c"), 0.5)
    assert sorted(words) == sorted(fuzzy) == terms
    m = toxicity.Matcher(words, [], fuzzy)
    assert all(m.kind("a" + t) == toxicity.EDIT1 for t in terms)


def test_quoted_insult_scores_below_open_one_and_misspelling_above_clean(spark, folder):
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"),
                           common.in_fold(F.col("doc_id"), 4, 2))
    assert set(INSULTS) <= set(model.words)
    plain = "ba do ki lu me no pra " * 6
    clean, opened, quoted, wrong = model.score([x.encode() for x in (plain, plain + "gromblat you snarkel", plain + '"gromblat, you snarkel"',
                                                                     plain + "gromblatt you snarkle")], model.kinds())
    assert clean < 0.3 <= opened and quoted < opened and wrong > clean


def test_stages_keep_the_rest_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("x")).withColumn("y", F.lit(None).cast("int"))
    for op, stage, keep in ((quality_classifier.op8, quality_classifier.stage, 1), (toxicity.op1, toxicity.stage, 0)):
        kept = {r["doc_id"] for r in op(spark, folder).collect() if r["predicted"] == keep}
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == kept
        assert got.exceptAll(docs).isEmpty()
