"""Document fingerprints by I-Match with randomised lexicon subsets, in SQL expressions only.

A term is the 64-bit hash of a lower-cased word. The lexicon holds the terms whose document frequency
lies in [LOW, HIGH] of all documents (an inverse-document-frequency band, counted over the whole table).
The band bounds it: a term in it is in ``LOW`` of the documents or more, so there are at most (mean number
of distinct terms of a document) / ``LOW`` of them, however many documents there are. Up to ``table_terms``
terms go into the plan as one hash table, an array of short arrays; a larger lexicon stays a table
and is joined to the terms of the different texts. A document's distinct lexicon terms are sorted, and
each of 64 randomised subsets of the lexicon is hashed over them: 8 resolutions with cells of 1/8 to
1/1024 of the lexicon, 8 disjoint cells of each. Small cells agree between texts that share much, large
ones between texts that share nearly all, whatever their length. A subset without terms of the document
is empty (0).

Likeness of two fingerprints: 1 if they are equal; else the largest share, over the resolutions with
four filled subsets or more, of filled subsets that agree; over all subsets if there is no such one.

Cases: null text counts as empty; a text without lexicon terms is fingerprinted by all its terms, one
without words has the all-empty fingerprint; equal texts have equal fingerprints; an empty table
gives an empty result; a caller's column named like an added one is replaced.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.common import LOWER, UPPER, stored

TABLE_TERMS = 1 << 18
MAX_RANGES = 1 << 14
LOW, HIGH = 0.002, 0.05
RESOLUTIONS, CELLS = 8, 8
BLANKS = "concat(' ', char(9), char(10), char(11), char(12), char(13))"


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def term_ids(t: str) -> str:
    """SQL: the distinct terms of text ``t``."""
    split = r"split(u, '[\\x20\\x09-\\x0D]+')"
    words = _let("u", f"btrim(translate({t}, '{UPPER}', '{LOWER}'), {BLANKS})",
                 f"CASE WHEN u = '' THEN cast(array() AS array<string>) ELSE {split} END")
    return f"array_distinct(transform({words}, w -> xxhash64(w)))"


def _text(text_col: str) -> str:
    return f"coalesce(cast(`{text_col}` AS string), '')"


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """The terms (column ``term``) whose document frequency is in the band, as a stored table."""
    n = docs.count()
    freq = docs.select(F.explode(F.expr(_let("t", _text(text_col), term_ids("t")))).alias("term")).groupBy("term").count()
    return stored(freq.filter(F.col("count").between(max(2.0, low * n), high * n)).select("term"), "lexicon")


def hash_table(terms: DataFrame) -> str:
    """SQL: the terms by their low bits, an array of short arrays (folded to one literal)."""
    own = [r.term for r in terms.collect()]
    cells: list[list[int]] = [[] for _ in range(1 << max(1, len(own)).bit_length())]
    for x in own:
        cells[x & len(cells) - 1].append(x)
    return f"from_json('{str(cells).replace(' ', '')}', 'array<array<bigint>>')"


def known_terms(table: str) -> str:
    """SQL: those of the terms ``ids`` that the hash table of the lexicon holds."""
    return f"filter(ids, x -> array_contains(get({table}, cast(x & (size({table}) - 1) AS int)), x))"


def fingerprint(ids: str, known: str) -> str:
    """SQL: array of 64 ints, the fingerprint of a text with the terms ``ids``, of which the lexicon holds ``known``."""
    levels = []
    for r in range(RESOLUTIONS):
        cell = f"(shiftrightunsigned(xxhash64(x, {r}), 8) & {(CELLS << r) - 1}L)"
        levels.append(_let("near", f"filter(terms, x -> {cell} < {CELLS})",
                           f"transform(sequence(0, {CELLS - 1}), k -> "
                           + _let("own", f"filter(near, x -> {cell} = k)",
                                  "CASE WHEN size(own) = 0 THEN 0 ELSE CASE WHEN shiftright(xxhash64(own), 32) = 0 THEN 1 "
                                  "ELSE cast(shiftright(xxhash64(own), 32) AS int) END END") + ")"))
    body = f"concat({', '.join(levels)})"
    chosen = _let("k", known, "CASE WHEN size(k) = 0 THEN ids ELSE k END")
    return _let("ids", ids, _let("terms", f"sort_array({chosen})", body))


def as_text(fp: str) -> str:
    return f"lower(array_join(transform({fp}, x -> right(lpad(hex(x), 16, '0'), 8)), ''))"


def likeness(a: str, b: str) -> str:
    """SQL: likeness (0 to 1) of two fingerprint arrays."""
    both = f"zip_with({a}, {b}, (x, y) -> named_struct('f', cast(x != 0 OR y != 0 AS int), 's', cast(x = y AND x != 0 AS int)))"

    def total(items: str, f: str) -> str:
        return f"aggregate({items}, 0, (n, v) -> n + v.{f})"
    level = f"transform(sequence(0, {RESOLUTIONS - 1}), r -> " + _let(
        "q", f"slice(z, r * {CELLS} + 1, {CELLS})",
        f"CASE WHEN {total('q', 'f')} >= 4 THEN cast({total('q', 's')} AS double) / {total('q', 'f')} END") + ")"
    overall = f"coalesce(try_divide(cast({total('z', 's')} AS double), {total('z', 'f')}), 0D)"
    return f"CASE WHEN {a} = {b} THEN 1D ELSE {_let('z', both, f'coalesce(array_max({level}), {overall})')} END"


def _dealer(df: DataFrame, key: str, out: str, ranges: int):
    """Range ``out`` of each row by approximate quantiles of ``key``; a value that several quantiles fall on is a range of its own."""
    from pyspark.ml.feature import Bucketizer
    found = df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    splits = set(found) | {math.nextafter(a, math.inf) for a, b in zip(found, found[1:]) if a == b}
    inner = sorted(x for x in splits if math.isfinite(x)) or [sys.float_info.max]
    return Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol=key, outputCol=out)


def with_next(docs: DataFrame, key: str, carry: list[str], rows_per_range: int = 1000, max_ranges: int = MAX_RANGES) -> DataFrame:
    """``docs`` with ``next_<c>`` of each carried column: the row after it by descending ``key`` (after the last: the first).

    Null keys come last; rows of one key follow by a hash of their first carried column, then the columns. Rows are
    dealt once, to parts of at most ``2 * max_ranges + 1`` ranges of the key; a range that one key fills is split by that hash
    into parts of a usual range's rows, at most ``max_ranges`` more in all. The first row of each part is also sent
    to the part before it, so a window inside a part sees every neighbour. One row per range or part is broadcast.
    """
    added = [f"next_{c}" for c in carry]
    own = [c for c in docs.columns if c not in added]
    n = docs.count()
    ranges = max(2, min(max_ranges, -(-n // rows_per_range)))
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.struct(*own).alias("row"), F.bitwise_not(k).alias("after"), k.cast("double").alias("at"),
                       F.shiftrightunsigned(F.xxhash64(carry[0]), 1).alias("tie"))
    dealt = _dealer(rows.select("at"), "at", "r", ranges).transform(rows)
    size = F.ceil(F.count("*") * F.lit(ranges) / F.lit(max(1, n)))
    stats = dealt.groupBy("r").agg(F.when(F.min("after") == F.max("after"), size).otherwise(1).cast("bigint").alias("parts"))
    parts = dealt.join(F.broadcast(stats), "r").withColumns({
        "r": -F.col("r").cast("bigint"), "s": F.shiftright(F.shiftright("tie", 39) * F.col("parts"), 24)})
    tops = parts.groupBy("r", "s").agg(F.min(F.struct("after", "tie")).alias("top"))
    order, everything = Window.orderBy("r", "s"), Window.partitionBy()                  # one row per part
    edges = tops.withColumn("p", F.struct("r", "s")).select("r", "s", "top", F.coalesce(
        F.lag("p").over(order), F.max("p").over(everything)).alias("before"))
    here = F.struct(F.col("r"), F.col("s"), F.lit(0).alias("tail"))
    there = F.struct(F.col("before.r").alias("r"), F.col("before.s").alias("s"), F.lit(1).alias("tail"))
    sent = parts.join(F.broadcast(edges), ["r", "s"]).select("row", "after", "tie", F.explode(
        F.when(F.struct("after", "tie") == F.col("top"), F.array(here, there)).otherwise(F.array(here))).alias("to"))
    values = {c: F.col("row").getField(c) for c in carry}
    w = Window.partitionBy("to.r", "to.s").orderBy("to.tail", "after", "tie", *values.values())
    out = sent.select("row", "to.tail", *[F.lead(v).over(w).alias(f"next_{c}") for c, v in values.items()]).filter("tail = 0")
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], *added)


def imatch(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", terms: DataFrame | None = None,
           table_terms: int = TABLE_TERMS) -> DataFrame:
    """``docs`` with ``out_col``: the fingerprint as an array of 64 ints. ``terms``: the lexicon (default: that of ``docs``)."""
    terms = lexicon(docs, text_col) if terms is None else terms
    t = _text(text_col)
    if terms.count() <= table_terms:
        return docs.withColumn(out_col, F.expr(_let("t", t, fingerprint(term_ids("t"), known_terms(hash_table(terms))))))
    name = F.sha2(F.expr(t), 256).alias("_imatch_text")
    known = docs.select(name, F.explode(F.expr(_let("t", t, term_ids("t")))).alias("term")).distinct() \
        .join(terms, "term", "left_semi").groupBy("_imatch_text").agg(F.collect_list("term").alias("_imatch_known"))
    joined = docs.select("*", name).join(known, "_imatch_text", "left")
    held = "coalesce(`_imatch_known`, cast(array() AS array<bigint>))"
    return joined.withColumn(out_col, F.expr(_let("t", t, fingerprint(term_ids("t"), held)))).drop("_imatch_text", "_imatch_known")
