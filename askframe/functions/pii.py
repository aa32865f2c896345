"""Personal-data redaction and detection as ``regexp_replace`` / ``rlike`` chains.

Java regex is ASCII-only for ``\\d \\s \\b`` unless ``(?U)`` is set; Python's
``str`` patterns are Unicode-aware, so every pattern gets ``(?U)``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from askframe import rules
from askframe.functions.text import _c, py_strip


def _escape_literal(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s)


def email_pattern(own_prefix: str) -> str:
    """E-mail rule that keeps addresses whose domain starts with ``own_prefix``."""
    look = f"(?!{_escape_literal(own_prefix)})" if own_prefix else ""
    return rules.PII_EMAIL_LOCAL + look + rules.PII_EMAIL_DOMAIN


def _phone(profile: rules.Profile) -> str:
    return rules.PII_PHONE_FIXED if profile.phone_plus_fix else rules.PII_PHONE


def ingest_pack(profile: rules.Profile = rules.DEFAULT_PROFILE) -> list[tuple[str, str]]:
    """Case-insensitive rules used while building the knowledge base (with e-mail)."""
    return [
        (rules.PII_NATIONAL_ID, rules.LABEL_NATIONAL_ID),
        (rules.PII_IBAN, rules.LABEL_IBAN),
        (_phone(profile), rules.LABEL_PHONE),
        (rules.PII_CARD_LONG, rules.LABEL_ACCOUNT),
        (email_pattern(profile.own_email_prefix), rules.LABEL_EMAIL),
    ]


def output_pack(profile: rules.Profile = rules.DEFAULT_PROFILE) -> list[tuple[str, str]]:
    """Case-sensitive rules applied to generated answers (no e-mail rule)."""
    return [
        (rules.PII_NATIONAL_ID, rules.LABEL_NATIONAL_ID),
        (rules.PII_IBAN, rules.LABEL_IBAN),
        (_phone(profile), rules.LABEL_PHONE),
        (rules.PII_CARD_LONG, rules.LABEL_ACCOUNT),
    ]


def input_warning_pattern(profile: rules.Profile = rules.DEFAULT_PROFILE) -> str:
    """One alternation flagging personal data in a question (card rule without the 4th group)."""
    return "(?iU)" + "|".join([rules.PII_NATIONAL_ID, rules.PII_IBAN, _phone(profile),
                               rules.PII_CARD_SHORT])


def redact(col, pack: list[tuple[str, str]], ignore_case: bool) -> Column:
    flags = "(?iU)" if ignore_case else "(?U)"
    out = _c(col)
    for pattern, label in pack:
        out = F.regexp_replace(out, flags + pattern, label.replace("$", "\\$"))
    return out


def _guarded(col, digit_rules: list[tuple[str, str]], ignore_case: bool) -> Column:
    """The digit-bearing rules only run on texts that contain a digit (each of them needs one)."""
    c = _c(col)
    return F.when(c.rlike(r"(?U)\d"), redact(c, digit_rules, ignore_case)).otherwise(c)


def redact_ingest(col, profile: rules.Profile = rules.DEFAULT_PROFILE) -> Column:
    """Ingest pack.  Rules 1-4 need a digit and the e-mail rule an ``@``, and no rule adds or
    removes either, so texts without them skip those regexes (same result, fewer scans)."""
    c = _c(col)
    pack = ingest_pack(profile)
    out = _guarded(c, pack[:4], ignore_case=True)
    return F.when(c.contains("@"), redact(out, pack[4:], ignore_case=True)).otherwise(out)


def tag_block_pattern() -> str:
    names = "|".join(rules.ANSWER_TAG_NAMES)
    return r"(?isU)<\s*(" + names + r")\s*>.*?</\s*\1\s*>"


def sanitize_output(col, profile: rules.Profile = rules.DEFAULT_PROFILE) -> Column:
    """Redact (case-sensitive), drop chat-role tag blocks, strip.

    The redactions need a digit and the tag rule a ``<``; texts without them skip those regexes.
    """
    c = _c(col)
    out = _guarded(c, output_pack(profile), ignore_case=False)
    out = F.when(c.contains("<"), F.regexp_replace(out, tag_block_pattern(), "")).otherwise(out)
    return py_strip(out)


def has_input_pii(col, profile: rules.Profile = rules.DEFAULT_PROFILE) -> Column:
    return _c(col).rlike(input_warning_pattern(profile))
