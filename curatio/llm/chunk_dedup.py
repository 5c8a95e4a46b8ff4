"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text's bytes are cut where the gear hash of the last 16 bytes is small, at least ``MIN_CHUNK`` and at
most ``MAX_CHUNK`` bytes after the cut before, always between characters; an insertion moves only the
cuts near it. Chunks are equal if their 128-bit digests are. Of equal chunks the first (smallest key,
then place in the text) stays; the others are duplicates, and a run of duplicate chunks next to each
other is removed if it has ``min_run`` bytes or more (shorter repeats are ordinary phrases).

One shuffle by digest: within each slice of a task's texts equal chunks are reduced to the first one
(the others are duplicates whatever the rest of the corpus holds), so a chunk that half of all
documents share sends one row per slice. Duplicates then join their documents by key.

Cases: null text counts as empty and stays null; texts without repeats come back as they are; a
repeated row (same key and text) is the same document and gets the same result, the copies of a text
under other keys are emptied; keys may repeat with different texts; a null key counts as the smallest;
an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.common import stored, text_slices

WINDOW = 16
MIN_CHUNK, MEAN_EXTRA, MAX_CHUNK = 16, 20, 256
MIN_RUN = 96
SLICE = 4 << 20
NO_KEY = -(1 << 63)

GEAR = np.random.Generator(np.random.PCG64(4)).integers(0, 1 << 32, 256, dtype=np.uint64)   # any fixed random numbers


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, over the last ``WINDOW`` bytes: sum of GEAR[byte] << age, by doubling."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        older = h[:-span] << np.uint64(span)
        h = h.copy()
        h[span:] += older
        span *= 2
    return h


def cut_points(data: np.ndarray) -> np.ndarray:
    """Possible cuts (places before a character) by the hash; the limits on sizes come later."""
    h = gear_hash(data) & np.uint64(0xFFFFFFFF)
    places = np.flatnonzero(h < np.uint64((1 << 32) // MEAN_EXTRA)) + 1
    places = places[places < len(data)]
    return places[(data[places] & 0xC0) != 0x80]


def chunk_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each text (bytes starts[i]:ends[i] of ``data``) the ends of its chunks."""
    cuts = cut_points(data).tolist() if len(data) else []
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        own, at = [], a
        low = bisect_left(cuts, a + MIN_CHUNK)
        while b - at > MIN_CHUNK:
            while low < len(cuts) and cuts[low] < at + MIN_CHUNK:
                low += 1
            nxt = cuts[low] if low < len(cuts) else b
            if nxt > at + MAX_CHUNK:
                nxt = at + MAX_CHUNK
                while nxt < b and data[nxt] & 0xC0 == 0x80:
                    nxt -= 1
            if nxt >= b:
                break
            own.append(nxt)
            at = nxt
        if at < b:
            own.append(b)
        out.append(own)
    return out


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column with each text's start and end in them."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], ends[:-1]]), ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> rows (d1, d2, key, place, again): chunks first in their slice, with their digest; for the
    others one row per text with the list of their places."""
    for b in text_slices(batches, SLICE):
        data, starts, ends = _bytes_of(b.column("text"))
        keys = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        raw = data.tobytes()
        d1, d2, owner, place = [], [], [], []
        for i, own in enumerate(chunk_ends(data, starts, ends)):
            a, base = int(starts[i]), zlib.crc32(raw[starts[i]:ends[i]]) << 31
            for n, e in enumerate(own):
                d = xxhash.xxh3_128_intdigest(raw[a:e])
                d1.append(d >> 64)
                d2.append(d & 0xFFFFFFFFFFFFFFFF)
                owner.append(i)
                place.append(base | n)
                a = e
        if not d1:
            continue
        one, two = np.array(d1, dtype=np.uint64).view(np.int64), np.array(d2, dtype=np.uint64).view(np.int64)
        key, place = keys[np.array(owner)], np.array(place, dtype=np.int64)
        order = np.lexsort((place, key, two, one))
        one, two, key, place = one[order], two[order], key[order], place[order]
        head = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        again = (key != key[lead]) | (place != place[lead])
        first = head
        n = int(first.sum())
        empty = pa.nulls(n, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(one[first]), pa.array(two[first]), pa.array(key[first]),
                                          pa.array(place[first]), empty], names=["d1", "d2", "key", "place", "again"])
        if again.any():
            key, place = key[again], place[again]
            order = np.lexsort((place, key))
            key, place = key[order], place[order]
            cut = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(place >> 31) != 0)) + 1])
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(key)).astype(np.int32)), pa.array(place))
            spread = key[cut] * np.int64(0x9E3779B1) ^ place[cut]             # any value: these rows go anywhere
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(place[cut]), pa.array(key[cut]),
                                              pa.array(place[cut]), lists], names=["d1", "d2", "key", "place", "again"])


def duplicate_places(docs: DataFrame) -> DataFrame:
    """(key, crc, places): numbers of the duplicate chunks of each (key, text) that has any; ``docs`` has key, text."""
    rows = docs.mapInArrow(_chunks, "d1 bigint, d2 bigint, key bigint, place bigint, again array<bigint>")
    w = Window.partitionBy("d1", "d2", F.col("again").isNotNull()).orderBy("key", "place")
    later = rows.withColumn("_rank", F.rank().over(w)).filter("again IS NOT NULL OR _rank > 1") \
        .select("key", F.explode(F.coalesce("again", F.array("place"))).alias("place"))
    return later.groupBy("key", F.shiftright("place", 31).alias("crc")) \
        .agg(F.collect_set(F.col("place").bitwiseAND(F.lit((1 << 31) - 1).cast("bigint"))).alias("places"))


def _spans(own: list[int], start: int, places: set[int], min_run: int) -> list[tuple[int, int]]:
    """Byte spans (in the text) of the runs of duplicate chunks that are long enough."""
    out, run, a = [], None, start
    for n, e in enumerate(own):
        if n in places:
            run = (run[0], e) if run else (a, e)
        elif run:
            out.append(run)
            run = None
        a = e
    if run:
        out.append(run)
    return [(x - start, y - start) for x, y in out if y - x >= min_run]


def deduplicate(docs: DataFrame, key: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the repeats cut out of ``text_col``, and n_bytes, n_removed and n_spans added."""
    out = ["n_bytes", "n_removed", "n_spans"]
    keep = [c for c in docs.columns if c not in out]
    at = keep.index(text_col)
    keyed = F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY))
    found = stored(duplicate_places(docs.select(keyed.alias("key"), F.col(text_col).alias("text"))), "chunks")
    found = found.select(F.col("key").alias("_key"), F.col("crc").alias("_crc"), F.col("places").alias("_places"))
    src = docs.select(*keep).withColumns({"_key": keyed, "_crc": F.crc32(F.coalesce(text_col, F.lit("")))})
    joined = src.join(found, ["_key", "_crc"], "left").select(*keep, "_places")

    def cut(batches):
        for b in text_slices(batches, SLICE, at):
            data, starts, ends = _bytes_of(b.column(at))
            places = b.column(len(keep)).to_pylist()
            bounds = chunk_ends(data, starts, ends)
            raw, texts, removed, spans = data.tobytes(), [], [], []
            valid = b.column(at).is_valid().to_pylist()
            for i, own in enumerate(bounds):
                a, e = int(starts[i]), int(ends[i])
                gone = _spans(own, a, set(places[i]), min_run) if places[i] else []
                kept, last = [], a
                for x, y in gone:
                    kept.append(raw[last:a + x])
                    last = a + y
                kept.append(raw[last:e])
                texts.append(b"".join(kept).decode() if valid[i] else None)
                removed.append(sum(y - x for x, y in gone))
                spans.append(len(gone))
            cols = [b.column(i) for i in range(len(keep))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ends - starts), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.int64())], names=[*keep, *out])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return joined.mapInArrow(cut, f"{schema}, n_bytes bigint, n_removed bigint, n_spans bigint")
