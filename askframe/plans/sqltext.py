"""SQL text builders for the DuckDB cross-check (the oracle side of every query).

These mirror the column builders in ``askframe.functions`` in plain SQL so the
driver can run them on the same parquet files.
"""

from __future__ import annotations

from askframe import rules
from askframe.functions import pii
from askframe.functions.guard import jailbreak_pattern


def lit(s: str) -> str:
    """A SQL string expression for ``s``; control and invisible characters go through ``chr()``."""
    parts, buf = [], []

    def flush():
        if buf:
            parts.append("'" + "".join(buf).replace("'", "''") + "'")
            buf.clear()
    for ch in s:
        o = ord(ch)
        if o < 32 or 0x7f <= o <= 0xa0 or ch in rules.WHITESPACE or o in (0x200b, 0xfeff):
            if ch == " ":
                buf.append(ch)
                continue
            flush()
            parts.append(f"chr({o})")
        else:
            buf.append(ch)
    flush()
    if not parts:
        return "''"
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


WS = lit(rules.WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def fix(x: str) -> str:
    out = f"coalesce({x}, '')"
    for bad, good in rules.MOJIBAKE_REPLACEMENTS:
        if bad != good:
            out = f"replace({out}, {lit(bad)}, {lit(good)})"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(out)


def re2(p: str) -> str:
    """A Python/Java pattern as a SQL literal for RE2 (no ``(?U)``: RE2 classes are ASCII)."""
    return lit(p.replace("(?iU)", "(?i)").replace("(?isU)", "(?is)").replace("(?U)", ""))


def redact_ingest(x: str, profile: rules.Profile = rules.DEFAULT_PROFILE) -> str:
    """Ingest pack.  RE2 has no look-ahead: own-domain addresses are shielded by a sentinel."""
    out = x
    for pattern, label in pii.ingest_pack(profile)[:4]:
        out = f"regexp_replace({out}, {re2('(?i)' + pattern)}, {lit(label)}, 'g')"
    prefix = profile.own_email_prefix
    out = f"regexp_replace({out}, {re2('(?i)@(' + pii._escape_literal(prefix) + ')')}, '@' || chr(1) || '\\1', 'g')"
    email = rules.PII_EMAIL_LOCAL + rules.PII_EMAIL_DOMAIN
    out = f"regexp_replace({out}, {re2('(?i)' + email)}, {lit(rules.LABEL_EMAIL)}, 'g')"
    return f"replace({out}, chr(1), '')"


def sanitize_output(x: str) -> str:
    out = f"coalesce({x}, '')"
    for pattern, label in pii.output_pack():
        out = f"regexp_replace({out}, {re2(pattern)}, {lit(label)}, 'g')"
    alts = "|".join(r"<\s*" + n + r"\s*>.*?</\s*" + n + r"\s*>" for n in rules.ANSWER_TAG_NAMES)
    out = f"regexp_replace({out}, {re2('(?is)' + alts)}, '', 'g')"
    return strip(out)


def final_answer(x: str) -> str:
    s = sanitize_output(x)
    return f"CASE WHEN {s} <> '' THEN {s} ELSE coalesce({x}, '') END"


def is_question(x: str) -> str:
    return f"ends_with(regexp_replace({strip(x)}, '^\\d+\\.\\s*', ''), '?')"


def clean_cell(x: str) -> str:
    s = strip(x)
    return (f"CASE WHEN {x} IS NULL THEN '' WHEN starts_with({s}, '=') THEN '' "
            f"WHEN regexp_full_match({s}, '\\d+\\.?\\d*') THEN '' ELSE {fix(s)} END")


def row_to_text(cells: str) -> str:
    dropped = ", ".join(lit(w) for w in rules.DROPPED_CELL_WORDS)
    return (f"array_to_string(list_filter(list_transform({cells}, lambda c: {clean_cell('c')}), "
            f"lambda p: p <> '' AND lower(p) NOT IN ({dropped})), {lit(rules.CELL_SEPARATOR)})")


def doc_text(cat: str, q: str, a: str) -> str:
    return (f"CASE WHEN {q} <> '' THEN 'Product: ' || {cat} || chr(10) || 'Question: ' || {q} || chr(10) "
            f"|| 'Answer: ' || {a} ELSE 'Product: ' || {cat} || chr(10) || {a} END")


def doc_id(n: str) -> str:
    return f"'doc_' || CASE WHEN {n} < 10000 THEN lpad(CAST({n} AS VARCHAR), 4, '0') ELSE CAST({n} AS VARCHAR) END"


def first_line(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"


def after_first_line(x: str) -> str:
    return f"CASE WHEN strpos({x}, chr(10)) > 0 THEN substr({x}, strpos({x}, chr(10)) + 1) ELSE '' END"


def jailbreak(x: str) -> str:
    return f"regexp_matches({x}, {re2(jailbreak_pattern())})"


def input_pii(x: str) -> str:
    return f"regexp_matches({x}, {re2(pii.input_warning_pattern())})"


def keyword_match(x: str, profile: rules.Profile = rules.DEFAULT_PROFILE) -> str:
    kws = list(dict.fromkeys(k.lower() for k in rules.domain_keywords(profile)))
    lx = f"lower(coalesce({x}, ''))"
    return "(" + " OR ".join(f"contains({lx}, {lit(k)})" for k in kws) + ")"


def guard_reason(x: str, max_len: int = rules.MAX_INPUT_LENGTH) -> str:
    parts = [f"WHEN {x} IS NULL OR {strip(x)} = '' THEN {lit(rules.REASON_EMPTY)}",
             f"WHEN length({x}) > {max_len} THEN {lit(rules.REASON_TOO_LONG)}",
             f"WHEN {jailbreak(x)} THEN {lit(rules.REASON_JAILBREAK)}"]
    for t in rules.BLOCKED_TOPICS:
        parts.append(f"WHEN contains(lower({x}), {lit(t.lower())}) THEN {lit(rules.REASON_TOPIC_PREFIX + t)}")
    return "CASE " + " ".join(parts) + " ELSE '' END"


def guard_message(reason: str, profile: rules.Profile = rules.DEFAULT_PROFILE,
                  max_len: int = rules.MAX_INPUT_LENGTH) -> str:
    t = rules.texts(profile, max_len)
    return (f"CASE WHEN {reason} = {lit(rules.REASON_EMPTY)} THEN {lit(t.msg_empty)} "
            f"WHEN {reason} = {lit(rules.REASON_TOO_LONG)} THEN {lit(t.msg_too_long)} "
            f"WHEN {reason} = {lit(rules.REASON_JAILBREAK)} THEN {lit(t.msg_jailbreak)} "
            f"WHEN starts_with({reason}, {lit(rules.REASON_TOPIC_PREFIX)}) THEN {lit(t.msg_topic)} ELSE '' END")


def hashed_counts(table: str, id_col: str, text_col: str, dim: int = rules.VECTOR_SIZE) -> str:
    """``(id, dim, cnt)`` rows: token bucket counts of a text column."""
    return (f"SELECT {id_col} AS id, CAST((('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim}) AS INTEGER) AS dim, "
            f"count(*) AS cnt FROM (SELECT {id_col}, unnest(regexp_split_to_array(lower({text_col}), '[^\\p{{L}}\\p{{N}}]+')) "
            f"AS tok FROM {table}) WHERE tok <> '' GROUP BY ALL")


def dense_counts(counts: str, dim: int = rules.VECTOR_SIZE) -> str:
    """``(id, v DOUBLE[], sq)`` from ``(id, dim, cnt)`` rows (every id with at least one token)."""
    return (f"SELECT id, list_transform(range({dim}), lambda i: CAST(coalesce(m[CAST(i AS INTEGER)], 0) AS DOUBLE)) AS v, "
            f"sq FROM (SELECT id, map_from_entries(list(struct_pack(k := dim, v := cnt))) AS m, "
            f"sum(cnt * cnt) AS sq FROM ({counts}) GROUP BY id)")


def topk(qvec: str, dvec: str, k: int = rules.TOP_K, threshold: float = rules.SCORE_THRESHOLD,
         doc_filter: str = "TRUE") -> str:
    """``(query_id, doc_id, rank, raw)`` from ``(id, v, sq)`` relations, ties by doc id."""
    return (f"SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, raw FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM ("
            f"SELECT q.id AS query_id, d.id AS doc_id, CASE WHEN q.sq > 0 AND d.sq > 0 "
            f"THEN list_inner_product(q.v, d.v) / sqrt(CAST(q.sq AS DOUBLE) * CAST(d.sq AS DOUBLE)) ELSE 0 END AS raw "
            f"FROM ({qvec}) q, ({dvec}) d WHERE {doc_filter}) WHERE raw >= {threshold!r}) WHERE rank <= {k}")
