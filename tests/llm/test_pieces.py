import numpy as np
import pytest
import sentencepiece

from askframe.llm import pieces

from corpora import documents

TEXTS = ["  Hello  world\n", "a▁b", "▁", "    a   b     ", "日本語 é\t\n x", "ab" * 900, "ab" * 30 + " " + "x" * 3000, "🎉 ok", " ", "\x00",
         "The quick brown fox, thes estndha!"]


@pytest.fixture(scope="module")
def raw():
    with open(pieces.MODEL, "rb") as f:
        return f.read()


def test_without_dropout_the_ids_are_the_librarys(raw):
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
    model = pieces.model_of(raw)
    texts = [t for t in TEXTS if "▁" not in t] + [t for _, t, *_ in documents()[0] if t]
    got = pieces.Encoder(model, 0.0).encode([t.encode() for t in texts], [0] * len(texts))
    assert [g.tolist() for g in got] == lib.encode(texts)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_any_segmentation_decodes_to_the_text(raw, dropout):
    model = pieces.model_of(raw)
    for variant in (0, 1):
        for t, ids in zip(TEXTS, pieces.Encoder(model, dropout).encode([t.encode() for t in TEXTS], [variant] * len(TEXTS))):
            assert pieces.decode(model, ids.tolist()) == t.encode()


def slow_agenda(model, word, key, dropout):
    """One candidate at a time: the best that is not skipped, then the next."""
    ids, starts, at = [], [], 0
    for ch in word.decode():
        i = model.space if ch == " " else None if ch == pieces.SPACE else model.id_of.get(ch)
        ids += [i] if i is not None else [-1 - int(model.byte_id[b]) for b in ch.encode()]
        starts += [at] if i is not None else range(at, at + len(ch.encode()))
        at += len(ch.encode())
    ends = starts[1:] + [len(word)]
    while True:
        best = None
        for i in range(len(ids) - 1):
            merge = model.merge_of.get(ids[i] * model.n + ids[i + 1]) if min(ids[i:i + 2]) >= 0 else None
            if merge is None:
                continue
            place = (np.array([x], dtype=np.uint64) for x in (key, starts[i], starts[i + 1], ends[i + 1]))
            if dropout and pieces.skipped(*place, dropout)[0]:
                continue
            if best is None or merge[0] < best[0]:
                best = (merge[0], i, merge[1])
        if best is None:
            return [-1 - i if i < 0 else i for i in ids]
        _, i, t = best
        ids[i:i + 2], ends[i:i + 2] = [t], [ends[i + 1]]
        del starts[i + 1]


@pytest.mark.parametrize("dropout", [0.0, 0.2])
def test_rounds_and_heap_follow_the_agenda(raw, dropout):
    model = pieces.model_of(raw)
    words = [w for t in TEXTS for w in pieces.CHUNKS.findall(b" " + t.encode()) if len(w) < 120] + [b" " + b"ab" * 150]
    keys = pieces.word_keys(words, 3, 1)
    got = [np.frombuffer(g, dtype=np.int32).tolist() for g in pieces.segment(model, words, keys, dropout)]
    assert got == [slow_agenda(model, w, int(k), dropout) for w, k in zip(words, keys)]
    assert got == [np.frombuffer(pieces.segment_long(model, w, int(k), dropout), dtype=np.int32).tolist() for w, k in zip(words, keys)]


def test_what_is_remembered_does_not_change_the_pieces(raw, monkeypatch):
    model = pieces.model_of(raw)
    texts = [t.encode() for _, t, *_ in documents()[0] if t]
    whole = pieces.Encoder(model, 0.1).encode(texts, [0] * len(texts))
    monkeypatch.setattr(pieces, "CACHE_WORDS", 20)
    small = pieces.Encoder(model, 0.1)
    assert [small.encode([t], [0])[0].tolist() for t in texts] == [w.tolist() for w in whole]


def test_variants_differ_and_seeds_repeat(raw):
    model = pieces.model_of(raw)
    texts = [t.encode() for _, t, *_ in documents()[0] if t]
    a, b, c = (pieces.Encoder(model, 0.1, seed).encode(texts, [v] * len(texts)) for seed, v in ((7, 0), (7, 1), (7, 0)))
    assert [x.tolist() for x in a] == [x.tolist() for x in c] != [x.tolist() for x in b]


def test_op7_whole_table(spark, tables, raw):
    docs, _ = documents()
    rows = pieces.op7(spark, tables(documents=docs)).collect()
    assert len(rows) == len(docs) and all(r["lossless"] for r in rows)
    model = pieces.model_of(raw)
    texts = {}
    for d, t, *_ in docs:
        texts[d] = (t or "").encode()
    assert all(pieces.decode(model, r["ids"]) == texts[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert len({r["variant"] for r in rows}) == pieces.VARIANTS


def test_empty_table_and_clashing_columns(spark, tables):
    folder = tables(documents=[])
    assert pieces.op7(spark, folder).collect() == []
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, ids int, lossless int")
    assert pieces.encode(docs, ["doc_id"]).first()["lossless"]


def test_scalar_hash_equals_the_vectors():
    import numpy as np
    draw = np.random.default_rng(3)
    x = draw.integers(0, 2**21, (4, 500)).astype(np.uint64)
    x[0] = draw.integers(0, 2**64, 500, dtype=np.uint64)
    assert [pieces.skipped_one(*map(int, c), 0.3) for c in x.T] == pieces.skipped(*x, 0.3).tolist()
