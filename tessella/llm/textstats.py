"""Statistics of whole texts, in one Arrow pass: the inputs of the quality rules and of the quality classifier.

Defined results: null and empty texts have zeros everywhere; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WORD = re.compile(f"[^{BLANKS}]+")
#: The statistics, all long, in the order of ``statistics``.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_upper", "n_digits", "n_marks")
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str | None) -> tuple[int, ...]:
    """The statistics ``NAMES`` of a text; null counts as empty.

    Words are runs of other characters than space and tab to carriage return. n_dup_lines: lines with a word that equal
    an earlier one. n_repeat_words: words that stand in a 3-word window which occurs twice or more. n_marks: ``!`` and ``?``.
    """
    if not text:
        return (0,) * len(NAMES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    blanks = sum(text.count(c) for c in BLANKS)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        hit = np.fromiter((often[w] > 1 for w in windows), bool, len(windows))
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(hit)] |= hit
        repeat = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        n, len(text) - blanks, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat, len(set(words)), len(lines),
        len(data) - len(data.translate(None, _UPPER)), len(data) - len(data.translate(None, _DIGITS)), text.count("!") + text.count("?"),
    )


@F.pandas_udf(StructType([StructField(n, LongType()) for n in NAMES]))
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=list(NAMES))


def stats(text: Column) -> Column:
    """A struct of the statistics ``NAMES`` of a text column."""
    return _statistics(text)


#: Features of learned models: name and SQL over the statistics; all defined for empty texts.
FEATURES = {
    "log_words": "log1p(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "lines_per_word": "n_lines / greatest(n_words, 1)",
}


def features(prefix: str = "") -> dict[str, Column]:
    """The features as columns over statistics columns (or over the fields of a struct column ``prefix``)."""
    at = f"{prefix}." if prefix else ""
    sql = {name: re.sub(r"\b(n_[a-z_]+|word_chars)\b", rf"{at}\1", text) for name, text in FEATURES.items()}
    return {name: F.expr(f"cast({text} as double)") for name, text in sql.items()}
