"""Text repair and shaping as built-in column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askframe import rules


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(col) -> Column:
    """Strip the characters Python's ``str.strip()`` strips (Spark ``trim`` only strips spaces)."""
    return F.btrim(_c(col), F.lit(rules.WHITESPACE))


def fix_encoding(col) -> Column:
    """Repair mojibake by ordered literal replacement, fold 3+ newlines to 2, strip.

    A null input becomes the empty string.
    """
    src = F.coalesce(_c(col), F.lit(""))
    out = src
    for bad, good in rules.MOJIBAKE_REPLACEMENTS:
        if bad != good:
            out = F.replace(out, F.lit(bad), F.lit(good))
    # one scan for the first characters of all sequences before running the chain
    leads = "".join(sorted({bad[0] for bad, good in rules.MOJIBAKE_REPLACEMENTS if bad != good}))
    out = F.when(src.rlike("[" + leads + "]"), out).otherwise(src)
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return py_strip(out)


def is_question(col) -> Column:
    """True when the stripped text, without a leading ``12.`` number, ends with ``?``."""
    t = F.regexp_replace(py_strip(_c(col)), r"(?U)^\d+\.\s*", "")
    return t.endswith("?")


def clean_cell(col) -> Column:
    """One sheet cell to clean text: formulas and bare numbers become empty."""
    s = py_strip(_c(col))
    return (F.when(_c(col).isNull(), F.lit(""))
            .when(s.startswith("="), F.lit(""))
            .when(s.rlike(r"(?U)^\d+\.?\d*\z"), F.lit(""))
            .otherwise(fix_encoding(s)))


def row_to_text(cells_col) -> Column:
    """Merge a row's cleaned, non-empty cells with the cell separator."""
    dropped = F.array(*[F.lit(w) for w in rules.DROPPED_CELL_WORDS])
    parts = F.transform(_c(cells_col), clean_cell)
    kept = F.filter(parts, lambda p: (p != "") & ~F.array_contains(dropped, F.lower(p)))
    return F.array_join(kept, rules.CELL_SEPARATOR)


def doc_text(category, question, answer) -> Column:
    """Embedding text of a knowledge-base row; the question line is left out when empty."""
    q = F.coalesce(_c(question), F.lit(""))
    a = F.coalesce(_c(answer), F.lit(""))
    cat = F.coalesce(_c(category), F.lit(""))
    return (F.when(q != "", F.concat(F.lit("Product: "), cat, F.lit("\nQuestion: "), q,
                                     F.lit("\nAnswer: "), a))
            .otherwise(F.concat(F.lit("Product: "), cat, F.lit("\n"), a)))


def first_line(col) -> Column:
    return F.substring_index(_c(col), "\n", 1)


def after_first_line(col) -> Column:
    pos = F.instr(_c(col), "\n")
    return F.when(pos > 0, F.substr(_c(col), pos + F.lit(1))).otherwise(F.lit(""))


def stripped_equal(a, b) -> Column:
    return py_strip(F.coalesce(_c(a), F.lit(""))) == py_strip(F.coalesce(_c(b), F.lit("")))


def dedup_question_key(category, question) -> Column:
    """``category::lower(strip(question))`` — the keep-first key."""
    return F.concat(F.coalesce(_c(category), F.lit("")), F.lit("::"),
                    py_strip(F.lower(F.coalesce(_c(question), F.lit("")))))


def min_width_number(n, width: int = 4) -> Column:
    """``{n:0<width>d}``: zero-padded to ``width`` but never truncated."""
    s = _c(n).cast("string")
    return F.when(_c(n) < 10 ** width, F.lpad(s, width, "0")).otherwise(s)


def doc_id(n, prefix: str = "doc_") -> Column:
    return F.concat(F.lit(prefix), min_width_number(n))
