"""The SQL of the corpus operators beside their queries, on tables with nulls, ties, repeated rows and odd texts."""

import duckdb
import pytest

from askframe.llm import chat, conversation_repair, url_filters
from askframe.llm.queries import ORACLE

import test_conversation_repair
import test_url_filters


def answer(key, folder, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = con.execute(ORACLE[key])
    return [x[0] for x in got.description], got.fetchall()


def same(df, key, folder, table):
    names, rows = answer(key, folder, table)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


def test_chat_formatting(spark, tables):
    odd = ["<|im_end|>", "<\\|im_start|>x", "\\<|", "a\nb", "", None, "é🎉", "<|im_start|>assistant\nhi<|im_end|>\n", "<<||<\\\\|"]
    rows = [(c, k, ["user", "assistant", None, "tool\nrole <|nl|>"][(c + k) % 4], odd[(c * 3 + k) % len(odd)]) for c in range(12) for k in range(c + 1)]
    rows += [(60, 1, "user", "same"), (60, 1, "user", "same"), (60, 1, "assistant", "b"), (60, None, "user", "first"),
             (None, 0, "user", "no id"), (61, 2, None, "z"), (61, 2, "", "a"), (61, 2, None, None)]
    folder = tables(conversations=rows)
    same(chat.op2(spark, folder), "op2_chat_formatting", folder, "conversations")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_conversation_repair_of_damaged_rows(spark, tables, seed):
    folder = tables(conversations=test_conversation_repair.some_rows(seed) + [(900 + i, 1, "user", "Hi.") for i in range(40)])
    same(conversation_repair.op13(spark, folder), "op13_conversation_repair", folder, "conversations")


def test_url_rules(spark, tables):
    folder = tables(pages=[(i, u, "") for i, u in enumerate(test_url_filters.URLS)] + [(None, "http://a.com/", None), (3, "http://com/", "")])
    same(url_filters.op12(spark, folder), "op12_url_filters", folder, "pages")


@pytest.mark.parametrize("key", ["op2_chat_formatting", "op13_conversation_repair", "op12_url_filters"])
def test_empty_tables(tables, key):
    table = "pages" if "url" in key else "conversations"
    assert [r[0] for r in answer(key, tables(**{table: []}), table)[1]] == ([-1] if "chat" in key else [])
