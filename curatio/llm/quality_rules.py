"""Quality rules: a threshold table compiled into one projection (no user functions, no shuffle).

Every metric is an integer numerator over an integer denominator, so a verdict
is decided by integer products (``low * den <= 1000 * num <= high * den``) and is
the same in any engine. Counting repeated word windows sorts one packed number
per window inside the row: no explode, no shuffle, whatever the text's length.

Cases: null text counts as empty; a text without words fails the base rule
(fewer than ``MIN_WORDS`` words); repeated rows are judged alike, one row out per
row in; an empty table gives an empty result; further columns pass through
(columns named like an output are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: word blanks, the base rules' symbols and limits
BLANK_CLASS = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Function words of English, German, French and Spanish (own short lists).
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was", "be",
              "der", "die", "und", "das", "den", "von", "zu", "mit", "ist",
              "de", "la", "le", "et", "les", "des", "en", "un", "une", "que",
              "el", "y", "los", "se", "del", "las", "por")

#: metric: (numerator, denominator, low, high); the limits are thousandths of the ratio, None is no limit.
THRESHOLDS = {
    "word_length": ("word_chars", "n_words", 2000, 15000),
    "symbols": ("n_symbols", "n_words", None, 100),
    "exclamations": ("n_bangs", "n_words", None, 200),
    "duplicate_lines": ("n_dup_lines", "n_lines", None, 500),
    "repeated_words": ("n_repeat_words", "n_words", None, 450),
    "stop_words": ("n_stop_words", "n_words", 60, None),
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bangs")


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, evaluated once (a lambda variable is never copied)."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _repeat_words(w: str) -> str:
    """SQL: number of words of array ``w`` that lie in a 3-word window found twice or more.

    A window becomes one number: the high bits of its hash, and its position in the low
    ``b`` bits (as many as the row needs). Sorted, equal windows are neighbours; the words
    themselves decide. The covered words are then counted from the sorted positions.
    """
    mask = "(shiftleft(1L, b) - 1L)"

    def same(y: str) -> str:
        words = " AND ".join(f"get({w}, cast(x & {mask} AS int) + {k}) = get({w}, cast({y} & {mask} AS int) + {k})"
                             for k in range(3))
        return f"coalesce(shiftrightunsigned(x, b) = shiftrightunsigned({y}, b) AND {words}, false)"

    number = f"shiftleft(shiftrightunsigned(xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2)), b), b) | cast(i AS bigint)"
    sums = "aggregate(transform(p, (x, j) -> least(3L, coalesce(get(p, j + 1) - x, 3L))), 0L, (n, v) -> n + v)"
    found = f"sort_array(transform(filter(s, (x, j) -> {same('get(s, j - 1)')} OR {same('get(s, j + 1)')}), x -> x & {mask}))"
    body = _let("s", f"sort_array(transform(sequence(0, size({w}) - 3), i -> {number}))", _let("p", found, sums))
    return f"CASE WHEN size({w}) < 3 THEN 0L ELSE {_let('b', f'cast(ceil(log2(size({w}) + 1)) AS int)', body)} END"


def _counts(t: str, stop_words) -> str:
    """SQL: struct of ``COUNTS`` of the text expression ``t`` (a lambda variable)."""
    stops = ", ".join(f"'{s}'" for s in stop_words)
    drop = "translate({0}, concat(' ', char(9), char(10), char(11), char(12), char(13)), '')"
    lines = f"filter(split({t}, '\\\\n'), l -> {drop.format('l')} != '')"
    fields = {
        "n_words": "cast(size(w) AS bigint)",
        "word_chars": f"cast(length({drop.format(t)}) AS bigint)",
        "n_symbols": f"cast(length({t}) - length(translate({t}, '{SYMBOLS}', '')) AS bigint)",
        "n_dup_lines": "cast(size(ls) - size(array_distinct(ls)) AS bigint)",
        "n_repeat_words": _repeat_words("w"),
        "n_lines": "cast(size(ls) AS bigint)",
        "n_stop_words": f"cast(size(filter(w, x -> lower(x) IN ({stops}))) AS bigint)",
        "n_bangs": f"cast(length({t}) - length(replace({t}, '!', '')) AS bigint)",
    }
    struct = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    trimmed = f"btrim({t}, concat(' ', char(9), char(10), char(11), char(12), char(13)))"
    word_list = _let("u", trimmed, f"CASE WHEN u = '' THEN cast(array() AS array<string>) ELSE split(u, '{BLANK_CLASS}') END")
    return _let("w", word_list, _let("ls", lines, struct))


def compile_rules(thresholds: dict) -> str:
    """SQL condition over the counts: every ratio within its limits."""
    parts = []
    for num, den, low, high in thresholds.values():
        if low is not None:
            parts.append(f"{low} * {den} <= 1000 * {num}")
        if high is not None:
            parts.append(f"1000 * {num} <= {high} * {den}")
    return " AND ".join(parts) if parts else "true"


def quality_rules(docs: DataFrame, text_col: str = "text", thresholds: dict | None = None,
                  stop_words=STOP_WORDS) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept`` added."""
    thresholds = THRESHOLDS if thresholds is None else thresholds
    t = f"coalesce(cast(`{text_col}` AS string), '')"
    counted = docs.withColumn("_counts", F.expr(_let("t", t, _counts("t", stop_words))))
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return (counted.withColumns({c: F.col("_counts")[c] for c in COUNTS}).drop("_counts")
            .withColumn("base_failed", F.expr(failed))
            .withColumn("kept", F.expr(f"NOT base_failed AND ({compile_rules(thresholds)})")))
