import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from askframe.llm import simhash

from corpora import documents, text


def slow_fingerprint(t):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ") \
        .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def slow_components(rows):
    """{row number: smallest doc_id reachable} by comparing all fingerprints."""
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return fps, [least.get(root(i)) for i in range(len(rows))]


def near_copies():
    draw = random.Random(4)
    rows = []
    for g in range(12):
        base = text(draw, 400).split()
        for c in range(draw.randint(1, 6)):
            words = list(base)
            for _ in range(c):
                words[draw.randrange(len(words))] = "other"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Ein Wort"), (904, "ein\tWORT"), (905, "É"), (906, "é"), (None, rows[0][1]),
             (None, "no id here at all, alone"), (None, "no id here at all, alone")]
    return rows + rows[:3]


def test_spark_hash_is_the_contracts(spark):
    got = spark.range(1).select(F.hex(F.xxhash64(F.lit("ab cd é x")))).first()[0]
    assert int(got, 16) == xxhash.xxh64("ab cd é x".encode(), seed=42).intdigest()


def test_op6_equals_brute_force(spark, tables):
    rows = near_copies()
    folder = tables(documents=[(d, t, "en", "s", 1) for d, t in rows])
    got = sorted(map(tuple, simhash.op6(spark, folder).collect()), key=repr)
    fps, parts = slow_components(rows)
    assert got == sorted([(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, parts)], key=repr)
    assert len({c for c in parts}) < len(set(fps)) < len(rows)  # the fixture has exact and near copies


def test_links_do_not_depend_on_blocks_or_splits(spark):
    draw = np.random.default_rng(3)
    fps = []
    for base in draw.integers(0, 2**63, 30).tolist():
        fps += [base] + [base ^ sum(1 << int(b) for b in draw.choice(63, int(draw.integers(1, 6)), replace=False)) for _ in range(8)]
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")

    def parts(**options):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4, **options)).collect()}
        groups = {}
        for f in set(fps):
            groups.setdefault(roots.get(f, f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    expected = {f: f for f in fps}

    def root(f):
        while expected[f] != f:
            f = expected[f]
        return f

    for a in set(fps):
        for b in set(fps):
            if bin(a ^ b).count("1") <= 4:
                expected[root(a)] = root(b)
    groups = {}
    for f in set(fps):
        groups.setdefault(root(f), set()).add(f)
    want = sorted(map(sorted, groups.values()))
    assert parts() == parts(split_rows=10) == parts(group_rows=0) == want


def test_pivots_never_lose_a_near_pair():
    draw = np.random.default_rng(8)
    a = draw.integers(0, 2**64, 500, dtype=np.uint64)
    for bits in range(5):
        flips = np.array([sum(1 << int(b) for b in draw.choice(64, bits, replace=False)) for _ in a], dtype=np.uint64)
        d = np.abs(simhash.pivot_table(a) - simhash.pivot_table(a ^ flips)).max()
        assert d <= bits


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 41)}


def test_stage_keeps_one_of_each_group_and_all_columns(spark, tables):
    rows = near_copies()
    folder = tables(documents=[(d, t, "en", "s", 1) for d, t in rows])
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("component_id", F.lit("mine")).withColumn("fp", F.lit(1))
    got = simhash.stage(spark, docs, folder)
    assert got.columns == docs.columns
    _, parts = slow_components(rows)
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({p for p in parts if p is not None})
    assert ids.count(None) == 1  # rows without an id are copies of each other like any others


def test_stage_picks_by_row_where_rows_share_an_id(spark, tables):
    draw = random.Random(6)
    a, b, c, d = (text(draw, 300) for _ in range(4))
    # 5 and 7 have two texts each, in two components; 7's first text is a copy of 5's first
    rows = [(5, a), (5, b), (7, a), (7, c), (8, d), (8, d), (9, b)]
    folder = tables(documents=[(i, t, "en", "s", 1) for i, t in rows])
    got = simhash.stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(5, a), (5, b), (7, c), (8, d)])


def test_empty_table(spark, tables):
    folder = tables(documents=[])
    assert simhash.op6(spark, folder).collect() == []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert simhash.stage(spark, docs, folder).collect() == []


def test_whole_text_counts():
    docs, _ = documents()
    long = max((t for _, t, *_ in docs if t), key=len)
    assert simhash.fingerprint(long.encode()) == slow_fingerprint(long)
    assert simhash.fingerprint(long.encode()) != simhash.fingerprint(long[:2000].encode())
