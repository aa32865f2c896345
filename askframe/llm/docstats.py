"""Statistics of one text, computed on its UTF-8 bytes in a few vector operations."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np

FEATURES = ["n_chars", "n_words", "mean_word", "distinct_share", "top_share", "adjacent_share", "short_share",
            "symbol_share", "upper_share", "bang_share", "digit_share", "mark_share", "wide_share",
            "dup_line_share", "line_words"]

# The symbols a quality rule counts.
SYMBOLS = b"#*$%&|<>"


def _kinds() -> np.ndarray:
    """256 x 7: which bytes are white space, continuation, symbol, upper case, '!', digit, other mark."""
    kinds = np.zeros((256, 7), dtype=np.int64)
    for b in range(256):
        kinds[b] = [b in b" \t\n\r\x0b\x0c", 0x80 <= b < 0xC0, b in SYMBOLS, 65 <= b <= 90, b == 33, 48 <= b <= 57,
                    33 <= b < 127 and not chr(b).isalnum() and b not in SYMBOLS and b not in b"!.,"]
    return kinds


KINDS = _kinds()


def profile(raw: bytes) -> tuple[dict, list[bytes]]:
    """Counts of a text and its words."""
    words = raw.split()
    n = len(words)
    bytes_of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    space, more, symbols, upper, bang, digits, marks = (int(x) for x in bytes_of @ KINDS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return {"n_words": n, "chars": len(raw) - more, "word_chars": len(raw) - space - more, "n_symbols": symbols,
            "n_dup_lines": len(lines) - len(set(lines)), "upper": upper, "bang": bang, "digits": digits,
            "marks": marks, "wide": more, "lines": len(lines)}, words


def features(count: dict, words: list[bytes]) -> list[float]:
    """``FEATURES`` of a text from its counts; shares of nothing are 0."""
    n, chars = max(1, count["n_words"]), max(1, count["chars"])
    seen = Counter(words)
    return [count["chars"], count["n_words"], count["word_chars"] / n, len(seen) / n,
            max(seen.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
            sum(map((4).__gt__, map(len, words))) / n, count["n_symbols"] / chars, count["upper"] / chars,
            count["bang"] / chars, count["digits"] / chars, count["marks"] / chars, count["wide"] / chars,
            count["n_dup_lines"] / max(1, count["lines"]), count["n_words"] / max(1, count["lines"])]
