"""Exact removal of repeated byte strings with a sparse enhanced suffix array and its common-prefix interval tree.

Every string of ``MATCH`` = 100 bytes holds one anchor: the smallest hash among its 32-byte grams
(leftmost among equals), a choice of the content alone. Equal strings have their anchors at the same
place, so it is enough to compare the surroundings of anchors with equal grams: the 68 bytes before and
the 100 bytes from the anchor on, all that a string holding the anchor can cover.

1. Anchors (about one per 35 bytes) go to their gram's task as (gram hash, surroundings' hash, place).
   Within a slice of a task's texts equal surroundings are reduced to the first before that.
2. Equal surroundings: all but the first are repeats in full. Grams with several different surroundings
   go on, one row per different surrounding; all others are done.
3. Those surroundings are fetched from the texts and sorted by (gram, bytes from the anchor on): the
   suffix array of the anchors. A stack scan over the common prefixes of neighbours yields the interval
   tree; in each interval the same scan over the bytes before the anchors, backwards, yields the left
   extensions. A group that is right- and left-diverse is a maximal repeat, reported with all its members:
   all but the first are repeats.
4. A gram with over ``group_limit`` different surroundings is not held by a task: its rows pass through,
   and the 100-byte windows around them are compared by a pre-aggregated minimum per window hash.

Cases: null text counts as empty; texts under 100 bytes have no repeats; a repeated row (same key and
text) is the same document and gets the same result; keys may repeat with different texts; a null key
counts as the smallest; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.common import stored, text_slices

MATCH, GRAM = 100, 32
BEFORE = MATCH - GRAM                       # bytes before an anchor that a string holding it can cover
GROUP_LIMIT = 20_000
SLICE = 1 << 20
NO_KEY = -(1 << 63)
OFF = (1 << 31) - 1
POS = (1 << 24) - 1
MULT = 0x9E3779B97F4A7C15                  # any odd number


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place on (polynomial by doubling, then mixed)."""
    rng = np.random.Generator(np.random.PCG64(6))
    h = rng.integers(0, 1 << 63, 256, dtype=np.uint64)[data]
    span, m = 1, MULT
    while span < GRAM:
        h = h[:-span] * np.uint64(m) + h[span:]
        span, m = span * 2, m * m & 0xFFFFFFFFFFFFFFFF
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, grams: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Places of the anchors of the 100-byte strings that start at firsts[i] <= s < lasts[i]."""
    low = (grams & np.uint64(0xFFFFFFFFFFFFFFFF ^ POS)) | np.arange(len(grams), dtype=np.uint64)
    span, wide = 1, BEFORE + 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[:len(low) - (wide - span)], low[wide - span:])
    marks = np.zeros(len(low) + 1, dtype=np.int32)
    np.add.at(marks, firsts, 1)
    np.add.at(marks, lasts, -1)
    at = (low[np.cumsum(marks[:-1]) > 0] & np.uint64(POS)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def _parts(texts: list[bytes]) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Groups of (text, from, first string start, last start + 1, to) whose bytes fit a slice; long texts in overlapping parts."""
    group, size = [], 0
    for i, t in enumerate(texts):
        starts = len(t) - MATCH + 1
        for a in range(0, starts, SLICE):
            z = min(starts, a + SLICE)
            part = (i, max(0, a - BEFORE), a, z, min(len(t), z + MATCH + BEFORE))
            if group and size + part[4] - part[1] > SLICE + 4 * MATCH:
                yield group
                group, size = [], 0
            group.append(part)
            size += part[4] - part[1]
    if group:
        yield group


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (gram, around, key, place, again): the anchors; ``again``: the slice has equal surroundings earlier
    (such rows go to any task). place = crc32 of the text, offset."""
    names = ["gram", "around", "key", "place", "again"]
    digest = xxhash.xxh3_64_intdigest
    for b in text_slices(batches, SLICE):
        texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
        keys = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        crcs = [zlib.crc32(t) for t in texts]
        for group in _parts(texts):
            raw = b"".join(texts[i][lo:hi] for i, lo, _, _, hi in group)
            data = np.frombuffer(raw, dtype=np.uint8)
            sizes = np.array([hi - lo for _, lo, _, _, hi in group])
            base = np.cumsum(sizes) - sizes                                  # where a part's bytes begin in raw
            info = np.array(group, dtype=np.int64)
            grams = gram_hashes(data)
            at = anchors(data, grams, base + info[:, 2] - info[:, 1], base + info[:, 3] - info[:, 1])
            part = np.searchsorted(base, at, side="right") - 1
            off = at - base[part] + info[part, 1]                            # place in the text
            length = np.array([len(texts[i]) for i in info[:, 0]])[part]
            left, right = np.minimum(off, BEFORE), np.minimum(length - off, MATCH)
            around = np.fromiter((digest(raw[x:y], s) for x, y, s in
                                  zip((at - left).tolist(), (at + right).tolist(), left.tolist())), dtype=np.uint64, count=len(at)).view(np.int64)
            gram = grams[at].view(np.int64)
            text = info[part, 0]
            key, place = keys[text], (np.array(crcs, dtype=np.int64)[text] << 31) | off
            order = np.lexsort((place, key, around, gram))
            gram, around, key, place = gram[order], around[order], key[order], place[order]
            head = np.concatenate([[True], (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            again = (key != key[lead]) | (place != place[lead])
            keep = head | again                                              # a repeated row's anchors are there once
            gram = np.where(again, (key.astype(np.uint64) * np.uint64(MULT)).view(np.int64) ^ place, gram)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, around, key, place, again)], names=names)


FULL, NEED, HOT = 0, 1, 2


def _second_pass(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, around, key, place) -> (gram, key, place, kind): repeats in full, surroundings to compare."""
    names = ["gram", "key", "place", "kind"]
    held = [np.zeros(0, dtype=np.int64)] * 4
    hot_gram = None

    def rows(gram, key, place, kind):
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(key), pa.array(place),
                                           pa.array(np.full(len(gram), kind, dtype=np.int32))], names=names)

    def done(cols, hot):
        """``cols`` hold whole (gram, around) runs; whole grams unless ``hot`` names the one that goes on."""
        gram, around, key, place = cols
        if not len(gram):
            return
        head = np.concatenate([[True], (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        again = (key != key[lead]) | (place != place[lead])
        if again.any():
            yield rows(gram[again], key[again], place[again], FULL)
        gram, key, place = gram[head], key[head], place[head]
        cut = np.concatenate([[True], gram[1:] != gram[:-1]])
        n = np.diff(np.append(np.flatnonzero(cut), len(gram)))
        n = np.repeat(n, n)
        big = (n > limit) | ((gram == hot) if hot is not None else False)
        for which, kind in (((n > 1) & ~big, NEED), (big, HOT)):
            if which.any():
                yield rows(gram[which], key[which], place[which], kind)

    for b in batches:
        if not b.num_rows:
            continue
        again = b.column("again").to_numpy(zero_copy_only=False)
        new = [b.column(c).to_numpy() for c in ("gram", "around", "key", "place")]
        if again.any():
            yield rows(new[0][again], new[2][again], new[3][again], FULL)
            new = [c[~again] for c in new]
            if not len(new[0]):
                continue
        cols = [np.concatenate([h, c]) for h, c in zip(held, new)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))                     # the last gram may go on
        yield from done([c[:cut] for c in cols], hot_gram)
        held = [c[cut:] for c in cols]
        if len(held[0]) > limit:                                             # too long to hold: whole runs pass on
            run = int(np.flatnonzero(held[1] != held[1][-1]).max() + 1) if (held[1] != held[1][-1]).any() else 0
            if run:
                hot_gram = held[0][-1]
                yield from done([c[:run] for c in held], hot_gram)
                held = [c[run:] for c in held]
            else:                                                            # one run: keep its first row
                same = (held[2] != held[2][0]) | (held[3] != held[3][0])
                if same.any():
                    yield rows(held[0][same], held[2][same], held[3][same], FULL)
                held = [c[:1] for c in held]
    yield from done(held, hot_gram)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, crc, text, needs [(gram, off, kind)]) -> (gram, key, place, kind, before (reversed), onward)."""
    names = ["gram", "key", "place", "kind", "before", "onward"]
    for b in text_slices(batches, SLICE):
        out = []
        for key, crc, text, needs in zip(b.column("key").to_pylist(), b.column("crc").to_pylist(),
                                         b.column("text").cast(pa.binary()).to_pylist(), b.column("needs").to_pylist()):
            for n in needs:
                at = n["off"]
                out.append((n["gram"], key, crc << 31 | at, n["kind"], text[max(0, at - BEFORE):at][::-1], text[at:at + MATCH]))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=_CONTEXT)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=_CONTEXT)


_CONTEXT = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("kind", pa.int64()),
                      ("before", pa.binary()), ("onward", pa.binary())])


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(prefix: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of the common prefixes of neighbours (prefix[i]: of suffixes i-1 and i): every interval
    (length, first, last) of suffixes with a common prefix of ``least`` or more, children before parents."""
    stack: list[list[int]] = []                          # [length, first]
    for i in range(1, len(prefix) + 1):
        now = prefix[i] if i < len(prefix) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append([now, first])


def maximal_repeats(before: list[bytes], onward: list[bytes], least: int = MATCH,
                    gram: int = GRAM) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) of every maximal repeat of ``least`` bytes or more around the anchors of one gram.

    The anchors are sorted by ``onward``. The members of an interval with common prefix ``right`` are sorted by the
    bytes before them (backwards), whose intervals give every left extension of ``least - right`` bytes or more;
    a group whose members also share a longer prefix belongs to a child.
    """
    prefix = [0] + [_common(a, b) for a, b in zip(onward, onward[1:])]
    for right, first, last in intervals(prefix, gram):
        order = sorted(range(first, last + 1), key=before.__getitem__)
        back = [-1] + [_common(before[a], before[b]) for a, b in zip(order, order[1:])]
        for left, lo, hi in intervals(back, max(0, least - right)):
            members = order[lo:hi + 1]
            if _common(onward[min(members)], onward[max(members)]) == right:
                yield left, right, members


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(gram, its rows (key, place, before, onward)) of rows sorted by (gram, onward), grams with several rows only."""
    current, rows = None, []
    for b in batches:
        for gram, *row in zip(*(b.column(c).to_pylist() for c in ("gram", "key", "place", "before", "onward"))):
            if gram != current:
                if len(rows) > 1:
                    yield current, rows
                current, rows = gram, []
            rows.append(row)
    if len(rows) > 1:
        yield current, rows


def _held(before: bytes, onward: bytes, left: int, right: int) -> bool:
    """Whether the anchor is the anchor of a 100-byte string inside the repeat: then every occurrence of the repeat has it."""
    data = np.frombuffer(before[:left][::-1] + onward[:right], dtype=np.uint8)
    return left in anchors(data, gram_hashes(data), np.array([0]), np.array([len(data) - MATCH + 1]))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings sorted by (gram, onward) -> members (gram, number, key, place, left, right) of the maximal repeats around
    the anchors, and each surrounding that no other one contains as a group of its own (its copies are the members)."""
    schema = pa.schema([(c, pa.int64()) for c in ("gram", "number", "key", "place", "left", "right")])
    out: list[tuple] = []
    for gram, rows in _grams(batches):
        before, onward = [r[2] for r in rows], [r[3] for r in rows]
        number, whole = 0, set()
        for left, right, members in maximal_repeats(before, onward):
            whole.update(m for m in members if left == len(before[m]) and right == len(onward[m]))
            if _held(before[members[0]], onward[members[0]], left, right):
                out.extend((gram, number, rows[m][0], rows[m][1], left, right) for m in members)
                number += 1
        alone = [m for m in range(len(rows)) if m not in whole]
        out.extend((gram, number + n, rows[m][0], rows[m][1], len(before[m]), len(onward[m])) for n, m in enumerate(alone))
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)


def _anchored_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 100-byte windows of surroundings whose anchor is the surroundings' own: (w1, w2, key, place of its start)."""
    schema = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "key", "place")])
    for b in batches:
        out = []
        for key, place, before, onward in zip(*(b.column(c).to_pylist() for c in ("key", "place", "before", "onward"))):
            whole = before[::-1] + onward
            grams = gram_hashes(np.frombuffer(whole, dtype=np.uint8)) & np.uint64(0xFFFFFFFFFFFFFFFF ^ POS)
            for s in range(len(whole) - MATCH + 1):
                if s + int(grams[s:s + BEFORE + 1].argmin()) == len(before):
                    d = xxhash.xxh3_128_digest(whole[s:s + MATCH])
                    out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), key, place - len(before) + s))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings sorted by (gram, onward) -> (key, place, left, right): the bytes around each anchor that maximal
    repeats with an earlier member cover (all hold the anchor, so together they are one stretch)."""
    schema = pa.schema([(c, pa.int64()) for c in ("key", "place", "left", "right")])
    out: list[tuple] = []
    for _, rows in _grams(batches):
        where = [(r[0], r[1]) for r in rows]
        wide: dict[int, list[int]] = {}
        for left, right, members in maximal_repeats([r[2] for r in rows], [r[3] for r in rows]):
            least = min(where[m] for m in members)
            for m in members:
                if where[m] != least:
                    most = wide.setdefault(m, [0, 0])
                    most[:] = max(most[0], left), max(most[1], right)
        out.extend((*where[m], left, right) for m, (left, right) in wide.items())
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every 100-byte window of the surroundings of long groups: (w1, w2, key, place of its start)."""
    for b in batches:
        w1, w2, keys, places = [], [], [], []
        for key, place, before, onward in zip(*(b.column(c).to_pylist() for c in ("key", "place", "before", "onward"))):
            whole = before[::-1] + onward
            for s in range(len(whole) - MATCH + 1):
                d = xxhash.xxh3_128_intdigest(whole[s:s + MATCH])
                w1.append(d >> 64)
                w2.append(d & 0xFFFFFFFFFFFFFFFF)
                keys.append(key)
                places.append(place - len(before) + s)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(w1, dtype=np.uint64).view(np.int64)), pa.array(np.array(w2, dtype=np.uint64).view(np.int64)),
                                          pa.array(keys, pa.int64()), pa.array(places, pa.int64())], names=["w1", "w2", "key", "place"])


def _keyed(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("key"),
                       F.crc32(text).alias("crc"), text.alias("text"))


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, order[0]).sortWithinPartitions(*order)


def surroundings(src: DataFrame, group_limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Of (key, crc, text): repeats in full (key, place), and the surroundings to compare (gram, key, place, kind, before, onward)."""
    rows = src.select("key", "text").mapInArrow(
        _first_pass, "gram bigint, around bigint, key bigint, place bigint, again boolean")
    split = _dealt(rows, "gram", "around", "key", "place").mapInArrow(
        lambda it: _second_pass(it, group_limit), "gram bigint, key bigint, place bigint, kind int")
    split = stored(split, "anchors")
    needs = split.filter(F.col("kind") != FULL).select("key", "place", "gram", "kind")
    per_text = needs.groupBy("key", F.shiftright("place", 31).alias("crc")).agg(F.collect_list(F.struct(
        "gram", F.col("place").bitwiseAND(F.lit(OFF).cast("bigint")).alias("off"), "kind")).alias("needs"))
    # one row per (key, text): a repeated row would send its surroundings twice, which changes nothing but the size
    found = src.join(per_text, ["key", "crc"]).select("key", "crc", "text", "needs").mapInArrow(
        _surroundings, "gram bigint, key bigint, place bigint, kind bigint, before binary, onward binary")
    found = stored(found, "surroundings")
    return split.filter(F.col("kind") == FULL).select("key", "place"), found


def repeated_windows(found: DataFrame) -> DataFrame:
    """(key, place) of the 100-byte windows in the surroundings of long groups that also start earlier."""
    windows = found.filter(F.col("kind") == HOT).select("key", "place", "before", "onward").mapInArrow(
        _windows, "w1 bigint, w2 bigint, key bigint, place bigint")
    least = windows.groupBy("w1", "w2").agg(F.min(F.struct("key", "place")).alias("least"), F.count("*").alias("n")).filter("n > 1")
    return windows.join(least, ["w1", "w2"]).filter("struct(key, place) != least").select("key", "place")


def _place(place: str = "place") -> tuple[Column, Column]:
    """crc and offset of a place."""
    return F.shiftright(place, 31), F.col(place).bitwiseAND(F.lit(OFF).cast("bigint"))


def _anchor_groups(src: DataFrame, group_limit: int) -> DataFrame:
    """(g1, g2, key, crc, start, stop): every string of 100 bytes or more around an anchor that has several occurrences and
    is maximal within the anchors' surroundings, with all its occurrences."""
    rows = src.select("key", "text").mapInArrow(_first_pass, "gram bigint, around bigint, key bigint, place bigint, again boolean")
    anchor = stored(rows.select("around", "key", "place").distinct(), "occurrences")
    found = surroundings(src, group_limit)[1].dropDuplicates(["key", "place"])         # a repeated row's are there twice
    lead = found.join(anchor, ["key", "place"])
    # grams with several surroundings: the interval tree's groups, every surrounding with its copies
    tree = _dealt(found.filter(F.col("kind") == NEED), "gram", "onward").mapInArrow(
        _members, "gram bigint, number bigint, key bigint, place bigint, left bigint, right bigint") \
        .join(anchor, ["key", "place"]).select(F.col("gram").alias("g1"), F.col("number").alias("g2"), "left", "right", "around") \
        .join(anchor, "around").select("g1", "g2", "key", "place", "left", "right")
    # grams with one surrounding: its copies
    copied = anchor.groupBy("around").count().filter("count > 1").join(lead.select("around"), "around", "left_anti")
    crc, off = _place()
    size = src.select("key", "crc", F.octet_length("text").cast("bigint").alias("size")).distinct()
    alone = anchor.join(copied, "around", "left_semi").withColumn("crc", crc).join(size, ["key", "crc"]).select(
        F.col("around").alias("g1"), F.lit(-1).cast("bigint").alias("g2"), "key", "place",
        F.least(off, F.lit(BEFORE)).alias("left"), F.least(F.col("size") - off, F.lit(MATCH)).alias("right"))
    # grams with too many surroundings for one task: the 100-byte windows of all occurrences, by their digests
    windows = lead.filter(F.col("kind") == HOT).select("around", "before", "onward").join(anchor, "around") \
        .mapInArrow(_anchored_windows, "w1 bigint, w2 bigint, key bigint, place bigint").distinct() \
        .select(F.col("w1").alias("g1"), F.col("w2").alias("g2"), "key", "place",
                F.lit(0).cast("bigint").alias("left"), F.lit(MATCH).cast("bigint").alias("right"))
    both = tree.unionByName(alone).unionByName(windows)
    return both.select("g1", "g2", "key", crc.alias("crc"), (off - F.col("left")).alias("start"), (off + F.col("right")).alias("stop"))


def _edges(span: int):
    """(key, crc, text, needs [(g1, g2, start, stop)]) -> (g1, g2, before (reversed), onward): ``span`` bytes at both ends."""
    schema = pa.schema([("g1", pa.int64()), ("g2", pa.int64()), ("before", pa.binary()), ("onward", pa.binary())])

    def read(batches):
        for b in text_slices(batches, SLICE):
            for text, needs in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("needs").to_pylist()):
                for at in range(0, len(needs), max(1, (4 << 20) // span)):
                    part = [(n["g1"], n["g2"], text[max(0, n["start"] - span):n["start"]][::-1], text[n["stop"]:n["stop"] + span])
                            for n in needs[at:at + max(1, (4 << 20) // span)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
    return read


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest and largest edge of each group -> how far all its occurrences agree (e_left, e_right)."""
    for b in batches:
        low, high, down, up = (b.column(c).to_pylist() for c in ("b1", "b2", "o1", "o2"))
        yield pa.RecordBatch.from_arrays([b.column("g1"), b.column("g2"), pa.array(map(_common, low, high), pa.int64()),
                                          pa.array(map(_common, down, up), pa.int64())], names=["g1", "g2", "e_left", "e_right"])


def repeat_groups(docs: DataFrame, key: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Maximal repeats of 100 bytes or more with all their occurrences: (group, key, crc, start, n_bytes, first).

    Groups around anchors (exact copies are occurrences like any other) that have the same occurrences at the same
    distances and meet are one repeat; then each is widened to both sides while all its occurrences agree, 64 bytes in
    the first round, twice as many in each further one (the bytes all share are those of the smallest and the largest).
    A null key is the smallest bigint; rows of equal key and text are one document; crc tells texts of one key apart.

    Limit: a repeat is found if one stretch of it has no occurrences beyond its own: the surroundings of one of its anchors
    (168 bytes), or one 100-byte string where the anchor's gram has over ``group_limit`` surroundings. A repeat that overlaps
    others so that every such stretch also occurs elsewhere (long runs of one short period) is reported as those only.
    """
    src = _keyed(docs, key, text_col).select("key", "crc", "text")
    members = stored(_anchor_groups(src, group_limit), "members")
    first = members.groupBy("g1", "g2").agg(F.min(F.struct("key", "crc", "start")).alias("f"), F.count("*").alias("n"),
                                            F.max(F.col("stop") - F.col("start")).alias("size")).filter("n > 1")
    shift = F.col("start") - F.col("f.start")
    marks = members.join(first, ["g1", "g2"]).groupBy("g1", "g2", "f", "n", "size").agg(
        F.bit_xor(F.xxhash64("key", "crc", shift)).alias("s1"), F.bit_xor(F.xxhash64(shift, "crc", "key")).alias("s2"))
    same = ["f.key", "f.crc", "n", "s1", "s2"]                              # occurrences at the same distances
    line = Window.partitionBy(*same).orderBy("f.start", "g1", "g2")
    end = F.col("f.start") + F.col("size")
    fresh = F.col("f.start") > F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    parts = marks.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("stretch", F.sum("fresh").over(line))
    parts = parts.groupBy(*same, "stretch").agg(F.min(F.struct("f.start", "g1", "g2")).alias("h"), F.max(end).alias("stop"))
    groups = stored(parts.select("h.g1", "h.g2", "key", "crc", "n", "s1", "s2", F.col("h.start").alias("start"),
                                 (F.col("stop") - F.col("h.start")).alias("size"), F.lit(0).cast("bigint").alias("back"),
                                 F.lit(True).alias("open")), "groups")
    own = members.select("g1", "g2", "key", "crc", "start")
    span = 64
    while not groups.filter("open").isEmpty():
        needs = own.join(groups.filter("open").select("g1", "g2", "size", "back"), ["g1", "g2"]).groupBy("key", "crc").agg(F.collect_list(
            F.struct("g1", "g2", (F.col("start") - F.col("back")).alias("start"),
                     (F.col("start") - F.col("back") + F.col("size")).alias("stop"))).alias("needs"))
        edges = src.join(needs, ["key", "crc"]).mapInArrow(_edges(span), "g1 bigint, g2 bigint, before binary, onward binary")
        wider = edges.groupBy("g1", "g2").agg(F.min("before").alias("b1"), F.max("before").alias("b2"), F.min("onward").alias("o1"),
                                              F.max("onward").alias("o2")).mapInArrow(
            _shared, "g1 bigint, g2 bigint, e_left bigint, e_right bigint")
        left, right = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("e_left", "e_right"))
        groups = stored(groups.join(wider, ["g1", "g2"], "left").withColumns({
            "size": F.col("size") + left + right, "back": F.col("back") + left, "open": F.greatest(left, right) == span})             .drop("e_left", "e_right"), "groups")
        span *= 2
    one = groups.withColumn("start", F.col("start") - F.col("back")).groupBy("key", "crc", "n", "s1", "s2", "start", "size") \
        .agg(F.min(F.struct("g1", "g2", "back")).alias("g"))
    one = one.select("g.*", "size", F.struct("key", "crc", "start").alias("f"))
    return own.join(one, ["g1", "g2"]).withColumn("start", F.col("start") - F.col("back")).select(
        F.xxhash64("g1", "g2").alias("group"), F.col("key").alias(key), "crc", "start", F.col("size").alias("n_bytes"),
        (F.struct("key", "crc", "start") == F.col("f")).alias("first"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(key, n_bytes, n_removed, spans [(from, to)], kept binary) of every row of ``docs``."""
    src = _keyed(docs, key, text_col)
    full, found = surroundings(src, group_limit)
    later = _dealt(found.filter(F.col("kind") == NEED), "gram", "onward").mapInArrow(
        _later, "key bigint, place bigint, left bigint, right bigint")
    windows = repeated_windows(found)
    # A mark is one number: place in the text, bytes before it, bytes from it on.
    off = F.shiftleft(F.col("place").bitwiseAND(F.lit(OFF).cast("bigint")), 16)
    crc = F.shiftright("place", 31).alias("crc")
    whole, onward = F.lit(BEFORE << 8 | MATCH), F.lit(MATCH)
    marks = full.select("key", crc, off.bitwiseOR(whole).alias("mark")) \
        .unionByName(later.select(
            "key", crc, off.bitwiseOR(F.shiftleft("left", 8)).bitwiseOR(F.col("right")).alias("mark"))) \
        .unionByName(windows.select("key", crc, off.bitwiseOR(onward).alias("mark")))
    spans = marks.groupBy("key", "crc").agg(F.collect_list("mark").alias("marks"))

    def cut(batches):
        for b in text_slices(batches, SLICE):
            size, gone, spans_out, kept = [], [], [], []
            for text, ms in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("marks").to_pylist()):
                own = _merged([(max(0, (m >> 16) - (m >> 8 & 255)), min(len(text), (m >> 16) + (m & 255))) for m in ms or ()])
                keep, last = [], 0
                for x, y in own:
                    keep.append(text[last:x])
                    last = y
                keep.append(text[last:])
                size.append(len(text))
                gone.append(sum(y - x for x, y in own))
                spans_out.append([{"from": x, "to": y} for x, y in own])
                kept.append(b"".join(keep))
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans_out, kind),
                                              pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "spans", "kept"])
    kind = src.schema["id"].dataType.simpleString()
    return src.join(spans, ["key", "crc"], "left").select("id", "text", "marks").mapInArrow(
        cut, f"id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<from: bigint, to: bigint>>, kept binary") \
        .withColumnRenamed("id", key)
