from askframe.operators import evaluate as EV
from askframe.operators import sft as S
from askframe.operators.vectors import kb_vectors


def _kb(spark):
    rows = [("doc_0000", "Cards", "block card now", "Call us.", 0),
            ("doc_0001", "Cards", "card fee amount", "Waived.", 1),
            ("doc_0002", "Loans", "  ", "Loans text only.", 2),
            ("doc_0003", "Loans", "zzzz qqqq", "Unrelated.", 3)]
    kb = spark.createDataFrame(rows, "id string, category string, question string, answer string, ord long")
    return kb.selectExpr("*", "'s' AS source", "'x' AS source_sheet",
                         "concat('Product: ', category, '\\n', question, '\\n', answer) AS text")


def test_hit_rates(spark):
    kb = _kb(spark)
    r = EV.hit_rates(kb, kb_vectors(kb), k=5).first()
    assert r.n == 3 and r.top1_match == 1.0 and r.topk_match == 1.0
    by_k = [tuple(x) for x in EV.hit_rates_by_k(kb, kb_vectors(kb), [1, 3, 5, 5]).orderBy("top_k").collect()]
    assert [x[0] for x in by_k] == [1, 3, 5] and all(x[1] == 3 for x in by_k)
    limited = EV.hit_rates(kb, kb_vectors(kb), k=5, limit=2).first()
    assert limited.n == 2


def test_sft_rows_messages_profile(spark):
    kb = _kb(spark)
    rows = S.sft_rows(kb).orderBy("id").collect()
    assert rows[0].instruction == "Product: Cards\nQuestion: block card now" and rows[0].response == "Call us."
    assert rows[2].instruction == "Product: Loans\nSummarize the following information."
    msgs = S.sft_messages(S.sft_rows(kb)).orderBy("id").first()
    assert [m.role for m in msgs.messages] == ["system", "user", "assistant"]
    assert msgs.text.endswith("<|im_start|>assistant\nCall us.<|im_end|>\n")
    lens = spark.createDataFrame([("a", "a"), ("bb", "bb"), ("dddd", "dddd"), ("x" * 9, "x" * 9)],
                                 "instruction string, response string")
    prof = {r.field: r for r in S.length_profile(lens).collect()}
    r = prof["instruction_len"]
    assert (r.n, r.min, r.p25, r.p50, r.p75, r.max, r.mean) == (4, 1.0, 1.75, 3.0, 5.25, 9.0, 4.0)


def test_search_options_pass_through(spark):
    kb = _kb(spark)
    vecs = kb_vectors(kb)
    exact = EV.hit_rates(kb, vecs, k=5).first()
    approx = EV.hit_rates(kb, vecs, k=5, mode="approx", nprobe=1, cell_rows=2).first()
    assert approx.n == exact.n and 0.0 <= approx.topk_match <= exact.topk_match


def test_no_hit_at_all_is_zero(spark):
    from askframe.operators import evaluate as EV
    from askframe.operators.vectors import kb_vectors
    schema = "id string, category string, source string, source_sheet string, question string, answer string, text string, ord long"
    kb = spark.createDataFrame([("d0", "C", "s", "x", "alpha beta", "one", "gamma", 0)], schema)
    got = EV.hit_rates(kb, kb_vectors(kb)).first()
    assert (got.n, got.top1_match, got.topk_match) == (1, 0.0, 0.0)
    none = EV.hit_rates(kb.filter("false"), kb_vectors(kb)).first()
    assert (none.n, none.top1_match, none.topk_match) == (0, 0.0, 0.0)
