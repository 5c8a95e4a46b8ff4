"""Native (JVM-side, codegen-able) text expressions used by the stages.

Everything here maps a Column to a Column with built-in functions only, so it
stays inside whole-stage codegen. The only Python parsing in the library is the
literal parser in ``functions/literal.py``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.isspace() characters, as a Java regex class: the ASCII whitespace
# plus \x1c-\x1f, \x85 and every Unicode separator (Zs, Zl, Zp).
PY_SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` (differs from ``trim``, which only drops ' ')."""
    return F.regexp_replace(col_(c), rf"^{PY_SPACE}+|{PY_SPACE}+\z", "")


def drop_final_dot(c) -> Column:
    """Remove one trailing '.' (``\\z``: a final newline is not skipped as with ``$``)."""
    return F.regexp_replace(col_(c), r"\.\z", "")


def numbered_split_regex(n: int) -> str:
    """Delimiters ``\\n1. `` … ``\\nN. `` then ``\\n1.`` … ``\\nN.``; the dot is a regex
    wildcard on purpose (``(?d)``: it matches anything but ``\\n``, like Python)."""
    alts = [f"\\n{i}. " for i in range(1, n + 1)] + [f"\\n{i}." for i in range(1, n + 1)]
    return "(?d)" + "|".join(alts)


def numbered_split(c, n: int) -> Column:
    """Split a numbered list into its pieces (first piece has no number)."""
    return F.split(col_(c), numbered_split_regex(n), -1)


# Prefix match of "<sent> (<key>: <value>)"; the bracket classes also hold '|'.
LIST_ITEM_RE = r"(?d)^(.*) [\(|\[](.*): (.*)[\)|\]]"


def list_item_fields(c) -> tuple[Column, Column, Column, Column]:
    """(matched, sent, key, value) of one list piece."""
    c = col_(c)
    return (c.rlike(LIST_ITEM_RE), F.regexp_extract(c, LIST_ITEM_RE, 1),
            F.regexp_extract(c, LIST_ITEM_RE, 2), F.regexp_extract(c, LIST_ITEM_RE, 3))


def title_case(c) -> Column:
    """Python ``str.title()``: a cased letter is upper-cased when the previous
    character is not a cased letter, else lower-cased (``initcap`` only looks at spaces)."""
    chars = F.split(col_(c), "", -1)
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    return F.array_join(
        F.transform(chars, lambda ch, i: F.when(
            (i > 0) & F.get(chars, i - 1).rlike(cased), F.lower(ch)).otherwise(F.upper(ch))), "")


def render(template: str, **slots) -> Column:
    """``template.format(**slots)`` as one ``concat``; the template is parsed once
    on the driver, slot values are never re-parsed (braces in data are safe)."""
    parts = re.split(r"\{(\w+)\}", template)
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append(F.lit(p))
        else:
            if p not in slots:
                raise KeyError(f"template slot {p!r} has no column")
            out.append(col_(slots[p]).cast("string"))
    return F.concat(*out) if out else F.lit("")


def count_substr(c, sub: str) -> Column:
    """Python ``str.count(sub)`` for a non-empty literal ``sub``."""
    c = col_(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / len(sub)).cast("bigint")


def strip_json_fence(c) -> Column:
    """Remove the opening fence marker, keep text before the next fence."""
    return F.substring_index(F.replace(col_(c), F.lit("```json"), F.lit("")), "```", 1)


def strip_all_fences(c) -> Column:
    """Remove the opening marker and every fence."""
    return F.replace(F.replace(col_(c), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))


def norm_similarity(a, b) -> Column:
    """``1 - levenshtein/max(len)``; NULL for two empty strings (0/0)."""
    a, b = col_(a), col_(b)
    return 1 - F.try_divide(F.levenshtein(a, b).cast("double"),
                            F.greatest(F.length(a), F.length(b)).cast("double"))


def ret_tag_extract(c) -> Column:
    """Text between the last ``<h>`` and the next ``</h>`` when ``<RET>`` is present."""
    c = col_(c)
    return F.when(c.contains("<RET>"),
                  py_strip(F.substring_index(F.substring_index(c, "<h>", -1), "</h>", 1))).otherwise(c)


def repair_utf8(binary_col) -> Column:
    """Text from raw bytes, invalid UTF-8 sequences replaced (U+FFFD)."""
    return F.make_valid_utf8(col_(binary_col).cast("string"))


def is_valid_utf8(binary_col) -> Column:
    return F.is_valid_utf8(col_(binary_col).cast("string"))
