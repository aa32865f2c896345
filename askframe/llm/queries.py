"""The queries of this subpackage by name, and SQL for those that SQL can express.

Chat formatting, phrases, URL filters and conversation repair have SQL.  The
others have none: fitted models, XXH64 and public vocabularies are not in
DuckDB's SQL; the tests compare each with a brute-force version, an exact round
trip or held-out accuracy.
"""

from __future__ import annotations

from askframe.llm import (chat, collocations, conversation_repair, lm, mixing, partitions, pieces, quality_classifier,
                          quality_rules, simhash, token_counts, toxicity, url_filters)

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_chat_formatting": chat.op2,
    "op3_lm_scoring": lm.op3,
    "op4_mixing": mixing.op4,
    "op5_ann_partitions": partitions.op5,
    "op6_simhash_dedup": simhash.op6,
    "op7_sentencepiece": pieces.op7,
    "op8_quality_classifier": quality_classifier.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_token_counts": token_counts.op10,
    "op11_collocations": collocations.op11,
    "op12_url_filters": url_filters.op12,
    "op13_conversation_repair": conversation_repair.op13,
}

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _collocations_sql() -> str:
    """Every phrase of every piece counted plainly, scored in 128-bit integers (joined on one key: two would let lang alone join)."""
    pieces = (f"SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece FROM "
              f"(SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_ABC}) AS t FROM documents)")
    words = ("SELECT lang, pid, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM "
             f"(SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^ \\t]+') AS w FROM ({pieces}))")
    after = ("SELECT lang, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third FROM "
             f"({words}) WINDOW o AS (PARTITION BY pid ORDER BY pos)")
    grams = ("SELECT lang, 1 AS k, word AS phrase FROM p UNION ALL SELECT lang, 2, word || ' ' || second FROM p WHERE second IS NOT NULL "
             "UNION ALL SELECT lang, 3, word || ' ' || second || ' ' || third FROM p WHERE third IS NOT NULL")
    cuts = (("2", "1", "w[1]", "w[2]"), ("3", "1", "w[1]", "w[2] || ' ' || w[3]"), ("3", "2", "w[1] || ' ' || w[2]", "w[3]"))
    cut = " UNION ALL ".join(f"SELECT lang, phrase, a, {c} AS cut, {x} AS head, {y} AS tail FROM c WHERE k = {k}" for k, c, x, y in cuts)
    return (f"WITH p AS ({after}), "
            f"f AS (SELECT lang, k, phrase, lang || ':' || phrase AS key, count(*) AS n FROM ({grams}) GROUP BY ALL), "
            "t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang), "
            "c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10), "
            f"x AS (SELECT u.*, h.n AS l, r.n AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(h.n AS HUGEINT) * r.n) AS BIGINT) AS score "
            f"FROM ({cut}) u JOIN f h ON h.key = u.lang || ':' || head JOIN f r ON r.key = u.lang || ':' || tail "
            "QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, cut) = 1), "
            "y AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 "
            "UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL) "
            "SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank, x.phrase, a, l, r, t.n, score "
            "FROM x JOIN t ON t.lang = x.lang LEFT JOIN y ON y.lang = x.lang AND y.phrase = x.phrase "
            "WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000")


def _url_filters_sql() -> str:
    """Every rule tried on every page."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filters.RULES)
    return (f"WITH u AS (SELECT page_id, row_number() OVER () AS row, CASE WHEN contains(url, '://') "
            f"THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), "
            f"p AS (SELECT page_id, row, translate(regexp_extract(rest, '^[^/?#]*'), {_ABC}) AS host, "
            f"regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u), "
            f"r(rule_host, rule_path, verdict) AS (VALUES {rules}) "
            "SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, "
            "coalesce(arg_max(verdict, length(rule_host || rule_path)), 'allow') AS verdict FROM p LEFT JOIN r "
            "ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, row, host, path")


def _chat_sql() -> str:
    """Digests of the turns and of the assistants' texts, and the lengths of markers, texts and escapes, without formatting."""
    text = "<|im_end|><|im_start|>assistant ok"
    escapes = "len(regexp_extract_all({}, '<\\\\*\\|'))"  # one character for each string that would be a marker
    size = (f"24 + length(role) + {escapes.format('role')} + 5 * (length(role) - length(replace(role, chr(10), ''))) "
            f"+ length(text) + {escapes.format('text')}")
    trained = "CASE WHEN role = 'assistant' THEN text ELSE '' END"
    return ("WITH c AS (SELECT conv_id, turn, role, text FROM conversations "
            f"UNION ALL VALUES (-1, 0, 'user', '{text}'), (-1, 1, 'assistant', '{text}')), "
            "o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, "
            "row_number() OVER (ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM c) "
            "SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, "
            "sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, "
            f"CAST(sum(length({trained})) AS BIGINT) AS loss_chars, sha256(string_agg({trained}, '' ORDER BY pos)) AS loss_sha256, "
            f"CAST(sum({size}) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id")


def _conversation_repair_sql() -> str:
    """Damage and faults; then the least (cost, audit) of every state, row after row, inserts first."""
    crc32 = ("xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)), "
             "lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)")
    blank = "'[\x20\x09-\x0D]'"
    inserts = ("(0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'user:|'), "
               "(0, 3, 4, 'II', 'user:|assistant:|'), (1, 2, 2, 'I', 'user:|'), (1, 3, 4, 'II', 'user:|assistant:|'), "
               "(2, 3, 2, 'I', 'assistant:|'), (3, 2, 2, 'I', 'user:|')")
    edits = ("('D', 0, '', 0), ('D', 1, '', 1), ('D', 2, '', 2), ('D', 3, '', 3), "
             "('K', 0, 's', 1), ('K', 0, 'u', 2), ('K', 1, 'u', 2), ('K', 2, 'a', 3), ('K', 3, 'u', 2), "
             "('R', 0, 'u', 2), ('R', 1, 'u', 2), ('R', 2, 'a', 3), ('R', 3, 'u', 2)")
    cost = "w.cost + n.cost + CASE letter WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CASE WHEN letter <> 'D' AND fault = 't' THEN 1 ELSE 0 END"
    line = ("CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) "
            "ELSE CASE e.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10) END")
    return ("WITH RECURSIVE g AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)), "
            "a AS (SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, "
            "coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k "
            "FROM conversations c JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id), "
            f"b AS (SELECT g, turn, role, text, {crc32} % 20 AS damage FROM a), "
            "d AS (SELECT g, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role, "
            "CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, "
            "unnest(CASE damage WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM b), "
            "o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d), "
            f"q AS (SELECT *, regexp_replace(text, {blank}, '', 'g') AS shown, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS times, "
            "lag(role) OVER (PARTITION BY g ORDER BY i) AS before FROM o), "
            "f AS (SELECT g, i, turn, role, text, left(role, 1) AS initial, CASE WHEN shown = '' THEN 'b' WHEN times > 1 THEN 'd' "
            "WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault, "
            "before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM q), "
            f"n(s, t, cost, letters, lines) AS (VALUES {inserts}), e(letter, s, initial, t) AS (VALUES {edits}), "
            "w AS (SELECT g, CAST(0 AS BIGINT) AS i, 0 AS s, 0 AS cost, '' AS audit, '' AS lines FROM g UNION ALL "
            "SELECT g, i, s, least_way.cost, least_way.audit, least_way.lines FROM (SELECT w.g, f.i, e.t AS s, "
            f"min(struct_pack(cost := {cost}, audit := audit || letters || letter, "
            f"lines := w.lines || replace(n.lines, '|', chr(10)) || {line})) AS least_way "
            "FROM w JOIN f ON f.g = w.g AND f.i = w.i + 1 JOIN n ON n.s = w.s JOIN e ON e.s = n.t AND (letter = 'D' "
            "OR fault IN ('t', '.') AND (letter = 'R' OR e.initial = f.initial)) GROUP BY w.g, f.i, e.t)), "
            "x AS (SELECT g, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, "
            "count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, "
            "count_if(illegal) AS illegal FROM f GROUP BY g), "
            "z AS (SELECT w.g, min(struct_pack(cost := w.cost + n.cost, audit := audit || letters, "
            "lines := w.lines || replace(n.lines, '|', chr(10)))) AS best FROM w LEFT JOIN x ON x.g = w.g JOIN n ON n.s = w.s "
            "WHERE w.i = coalesce(rows, 0) AND n.t IN (0, 3) GROUP BY w.g) "
            "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, "
            + "".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}, " for c in ("blank", "duplicate", "truncated", "illegal")) +
            "CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, "
            "sha256(left(best.lines, greatest(length(best.lines) - 1, 0))) AS repaired_sha256 "
            "FROM g JOIN z ON z.g = g.g LEFT JOIN x ON x.g = g.g")


ORACLE: dict[str, str] = {"op2_chat_formatting": _chat_sql(), "op11_collocations": _collocations_sql(),
                          "op12_url_filters": _url_filters_sql(), "op13_conversation_repair": _conversation_repair_sql()}
