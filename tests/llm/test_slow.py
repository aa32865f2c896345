"""Scores and choices of op1, op3, op4 and op8 beside slow versions written from their definitions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from askframe.llm import docstats, lm, mixing, quality_classifier, toxicity

from corpora import documents
from test_classifiers import edit_distance
from test_lm import rest, split


def keep_model(monkeypatch, module):
    """The models that ``module.train`` gives from now on, with its arguments."""
    kept, real = [], module.train

    def train(*args, **more):
        kept.append((real(*args, **more), args))
        return kept[-1][0]

    monkeypatch.setattr(module, "train", train)
    return kept


def test_op3_scores(spark, tables, monkeypatch):
    docs = documents(60)[0] + [(7000, "Ä É Straße É", None, None, None), (None, "no id", None, None, None), (7001, None, None, None, None)]
    kept = keep_model(monkeypatch, lm)
    got = {r["doc_id"]: r["score"] for r in lm.op3(spark, tables(documents=docs)).collect()}
    (model, (_, own, _)), = kept
    A, B, R, bias = (p.astype(np.float64) for p in model.parts)
    word = lambda w: lm.END if w is None else w
    k = lambda w: own[w] if w in own else lm.ending_class(w)
    c = Counter(word(w) for d, t, *_ in docs if rest(d) != 1 for w in split(t))
    n, v = Counter(), Counter()
    for w, x in c.items():
        n[k(w)] += x
        v[k(w)] += 1
    contexts = {}

    def log10_class(one, two):
        if (one, two) not in contexts:
            s = (A[one] + B[two]) @ R.T + bias
            contexts[one, two] = (s - s.max() - np.log(np.exp(s - s.max()).sum())) / np.log(10)
        return contexts[one, two]

    for d, t, *_ in docs:
        one = two = lm.START
        want = 0.0
        for w in map(word, split(t)):
            want += log10_class(one, two)[k(w)]
            if w not in own:
                want += math.log10((c[w] + 0.5) / (n[k(w)] + 0.5 * (v[k(w)] + 1)))
            one, two = k(w), one
        assert math.isclose(got[d], want, rel_tol=1e-4, abs_tol=1e-3), d


def slow_statistics(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars, lines = max(1, len(words)), max(1, len(t)), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda test: sum(map(test, t)) / chars
    wide = sum(len(ch.encode()) - 1 for ch in t)
    return {"n_chars": len(t), "n_words": len(words), "mean_word": sum(map(len, words)) / n, "distinct_share": len(set(words)) / n,
            "top_share": max(Counter(words).values(), default=0) / n, "adjacent_share": sum(a == b for a, b in zip(words, words[1:])) / n,
            "short_share": sum(len(w.encode()) < 4 for w in words) / n, "symbol_share": share(lambda ch: ch in "#*$%&|<>"),
            "upper_share": share(lambda ch: "A" <= ch <= "Z"), "bang_share": share(lambda ch: ch == "!"),
            "digit_share": share(lambda ch: "0" <= ch <= "9"),
            "mark_share": share(lambda ch: "!" <= ch <= "~" and not ch.isalnum() and ch not in "#*$%&|<>!.,"), "wide_share": wide / chars,
            "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)), "line_words": len(words) / max(1, len(lines))}


def test_op8_scores(spark, tables, monkeypatch):
    docs, labels = documents(150)
    docs += [(5000, None, None, None, None), (5001, "", None, None, None), (5002, "é É\n\n#1! a_b\té", None, None, None)]
    kept = keep_model(monkeypatch, quality_classifier)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.op8(spark, tables(documents=docs, labels=labels)).collect()}
    model = kept[0][0]
    assert model.rules
    for d, t, *_ in docs:
        s = slow_statistics(t or "")
        z = model.bias
        for weight, rule in model.rules:
            z += weight * all(s[docstats.FEATURES[f]] <= cut if upper else s[docstats.FEATURES[f]] > cut for f, upper, cut in rule)
        assert math.isclose(got[d], 1 / (1 + math.exp(-z)), rel_tol=1e-9), d


def slow_kind(word, model):
    w = re.sub(r"^[^a-z0-9@$]+|[^a-z0-9]+$", "", word.lower())
    if re.search("[a-z]", w):
        w = w.translate(toxicity.STAND_INS)
    if w in model.words:
        return "exact"
    if any(w.startswith(s) for s in model.stems):
        return "stem"
    edits = [edit_distance(w, t) for t in model.fuzzy if edit_distance(w, t) <= (0 if len(t) < 4 else 1 if len(t) < 9 else 2)]
    return None if not edits or w in model.clean else ("exact", "edit1", "edit2")[min(edits)]


def test_op1_scores(spark, tables, monkeypatch):
    docs, labels = documents(250)
    docs = [(d, t if t is None or t.isascii() else t.encode("ascii", "ignore").decode(), *more) for d, t, *more in docs]
    kept = keep_model(monkeypatch, toxicity)
    got = {r["doc_id"]: r["score"] for r in toxicity.op1(spark, tables(documents=docs, labels=labels)).collect()}
    model, kinds, compared = kept[0][0], {}, 0
    assert model.words
    for d, t, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if any(len(re.findall("[A-Za-z0-9@$]+", w)) > 1 or '"' in w or "'" in w for w in words):
            continue  # tokens of several words and quotations have tests of their own
        hits = []
        for i, w in enumerate(words):
            if w not in kinds:
                kinds[w] = slow_kind(w, model)
            if kinds[w]:
                hits.append((i, kinds[w]))
        weight = sum({"exact": 1.0, "stem": 1.0, "edit1": 0.8, "edit2": 0.6}[x] for _, x in hits)
        runs = sum(b - a <= 10 for (a, _), (b, _) in zip(hits, hits[1:]))
        x = [bool(hits), math.log1p(weight), min(1.0, 100 * weight / max(1, len(words))), math.log1p(runs),
             sum(x.startswith("edit") for _, x in hits) / max(1, len(hits)), 0.0]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x))
        assert math.isclose(got[d], 1 / (1 + math.exp(-z)), rel_tol=1e-9), (d, hits)
        compared += 1
    assert compared > 200 and any(kinds.values())


def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the hash before it as the seed; null changes nothing."""
    h = 42
    for v in values:
        if v is not None:
            kind, x = v if isinstance(v, tuple) else ("text", v)
            raw = x.encode() if kind == "text" else int(x).to_bytes(4 if kind == "int" else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def test_op4_choices(spark):
    data = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 3 else f"s{i % 5}") for i in range(400)] + [(900, None, None)]
    rows = mixing.sized(spark.createDataFrame(data, "doc_id long, text string, source string"))
    sources, uses = mixing.plan(rows, block_tokens=60)
    got = Counter((r["doc_id"], r["epoch"], r["block"]) for r in mixing.apply_plan(rows, sources, uses).collect())
    plans = {r["__s"]: r for r in sources.collect()}
    size = {d: len((t or "x").split()) for d, t, _ in data}
    blocks, number = defaultdict(lambda: defaultdict(list)), {}
    for d, t, s in data:
        name = "" if s is None else "=" + s
        same = spark_hash("row", name, ("int", 0), ("long", d), ("int", t is None), t)
        number[d] = ("long", spark_hash("key", ("long", same), ("long", 0)))
        blocks[name][spark_hash(("int", 0), "deal", number[d]) % plans[name]["n_blocks"]].append(d)
    want = Counter()
    for name, dealt in blocks.items():
        left, epoch = plans[name]["quota"], 0
        while left > 0:
            for b in sorted(dealt, key=lambda b: spark_hash(("int", 0), "block", ("long", epoch), name, ("long", b))):
                for d in sorted(dealt[b], key=lambda d: spark_hash(("int", 0), "cut", number[d])):
                    if left > 0:
                        want[d, epoch, b] += 1
                        left -= size[d]
                left = max(left, 0)
            epoch += 1
    assert sum(want.values()) > len(data) and got == want
