"""SimHash near-duplicates: inverted index over combinations of byte positions, then connected components.

Fingerprints are 64 bits over hashed word shingles. Two fingerprints with at most ``MAX_BITS`` = 4
differing bits differ in at most 4 of their 8 bytes, so they share at least 4 positional bytes. The
index therefore has a list per (4 byte positions, their values); every pair that can link meets in
one. This replaces a tally over lists per single byte position, whose 256 values would make every list
hot; members of a list share the minimum already, so only their bit distance is verified. Only distinct fingerprints are indexed (copies share one), and a list
yields a spanning forest of its links, at most its length, never all pairs.

A list longer than ``list_limit`` is not held by a task: its members are passed on, and the other 32
bits are expanded into the 529 values within 2 flipped bits. Two members link exactly when they have
such a value in common, so each links to the smallest member of the value (a pre-aggregated minimum).

Components: alternating large-star and small-star steps on stored edges until nothing changes.

Cases: null text counts as empty; a text without words has fingerprint 0 and links like any other;
fewer than 4 words form one shingle; repeated rows link; component_id ignores null keys (null if the
whole component has none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import stored, text_slices

MAX_BITS = 4
SHINGLE = 4
SEED = 42
LIST_LIMIT = 30_000
SETS = list(combinations(range(8), 8 - MAX_BITS))       # byte positions shared at least


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode().lower().split()                # bytes: lower() is A-Z only, split() at ASCII blanks
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
        starts = np.concatenate([[0], ends[:n - shingle] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    h = np.array(hashes, dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):                 # bounded memory for very long texts
        part = h[lo:lo + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, 8 << 20):
        fp = np.array([simhash(t or "", shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(fp.view(np.int64))],
                                         names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(keys..., fp): the fingerprint of every row as a signed 64-bit number, stored."""
    src = docs.select(*keys, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", fp bigint"
    return stored(src.mapInArrow(lambda it: _fingerprints(it, shingle), schema), "simhash")


def index_keys(fp: Column) -> Column:
    """The 70 lists a fingerprint is in: list number of the byte set, and the bytes there."""
    def key(n: int, where: tuple[int, ...]) -> Column:
        out = F.lit(n << 32).cast("bigint")
        for i, b in enumerate(where):
            byte = F.shiftrightunsigned(fp, 8 * b).bitwiseAND(F.lit(255).cast("bigint"))
            out = out.bitwiseOR(F.shiftleft(byte, 8 * i))
        return out
    return F.explode(F.array(*[key(n, s) for n, s in enumerate(SETS)]))


def _distance_ok(one: np.uint64, others: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of ``others`` are within ``max_bits`` of ``one``."""
    return np.bitwise_count(others ^ one) <= max_bits


def forest(members: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints (breadth first; each is compared with those not reached yet)."""
    left, edges = members, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            hit = _distance_ok(one, left, max_bits)
            if hit.any():
                found = left[hit]
                edges.extend((int(one), int(f)) for f in found)
                todo.extend(found)
                left = left[~hit]
    return edges


def _links(batches: Iterator[pa.RecordBatch], limit: int, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (list, fp) sorted by list -> links (a, b); members of a list over ``limit`` go out as (list, fp, hot)."""
    names = ["a", "b", "hot"]
    held: list[np.ndarray] = []                          # the list that the batch's end may have cut
    n_held, current, hot = 0, None, False

    def out(a, b, h):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, dtype=np.int64)), pa.array(np.asarray(b, dtype=np.int64)),
                                           pa.array(np.full(len(a), h))], names=names)

    def links(groups: list[np.ndarray]):
        edges = [e for g in groups if len(g) > 1 for e in forest(g.view(np.uint64), max_bits)]
        if edges:
            e = np.array(edges, dtype=np.uint64).view(np.int64).reshape(-1, 2)
            yield out(e[:, 0], e[:, 1], False)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column("list").to_numpy(), batch.column("fp").to_numpy()
        cut = np.flatnonzero(np.diff(key)) + 1
        keys, groups = key[np.concatenate([[0], cut])], np.split(fp, cut)
        ready = []
        for k, g in zip(keys.tolist(), groups):
            if k != current:
                if held and not hot and n_held > 1:
                    ready.append(np.concatenate(held))
                held, n_held, current, hot = [], 0, k, False
            held.append(g)
            n_held += len(g)
            if n_held > limit:
                hot = True
                m = np.concatenate(held)
                yield out(np.full(len(m), k), m, True)
                held = []
        yield from links(ready)
    if held and not hot:
        yield from links([np.concatenate(held)])


def _flips() -> list[int]:
    one = [1 << i for i in range(32)]
    return [0, *one, *(a | b for a, b in combinations(one, 2))]


def _hot_links(hot: DataFrame) -> DataFrame:
    """Links inside long lists by common values within 2 flipped bits of the 32 bits the list does not fix."""
    rest = None
    for n, where in enumerate(SETS):
        others = [b for b in range(8) if b not in where]
        bits = F.lit(0).cast("bigint")
        for i, b in enumerate(others):
            bits = bits.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 8 * b).bitwiseAND(F.lit(255).cast("bigint")), 8 * i))
        rest = F.when(F.shiftright("list", 32) == n, bits) if rest is None else rest.when(F.shiftright("list", 32) == n, bits)
    flips = F.array(*[F.lit(f).cast("bigint") for f in _flips()])
    spread = hot.withColumn("rest", rest).withColumn("value", F.explode(F.transform(flips, lambda f: F.col("rest").bitwiseXOR(f))))
    least = spread.groupBy("list", "value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return spread.join(least, ["list", "value"]).filter("a != fp").select("a", F.col("fp").alias("b")).distinct()


def links(distinct_fp: DataFrame, limit: int = LIST_LIMIT, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp`` whose components equal those of all links."""
    lists = distinct_fp.select(index_keys(F.col("fp")).alias("list"), "fp")
    n = distinct_fp.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_lists = lists.repartition(int(n), "list").sortWithinPartitions("list", "fp")
    found = stored(sorted_lists.mapInArrow(lambda it: _links(it, limit, max_bits), "a bigint, b bigint, hot boolean"), "links")
    near = found.filter("NOT hot").select("a", "b").distinct()
    hot = found.filter("hot").select(F.col("a").alias("list"), F.col("b").alias("fp"))
    return near.unionByName(_hot_links(hot)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of ``edges`` (a, b), for every node but the roots."""
    e = stored(edges.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).filter("root != node"), "edges")
    seen = None
    while True:
        # large star: neighbours above a node go to the smallest of the node and its neighbours
        sym = e.select("node", "root").union(e.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = sym.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("least"))
        large = sym.join(least, "node").filter("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")) \
            .filter("root != node").distinct()
        large = stored(large, "large")
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("node").agg(F.min("root").alias("least"))
        kept = large.join(low, "node")
        small = kept.select(F.col("root").alias("node"), F.col("least").alias("root")) \
            .union(kept.select("node", F.col("least").alias("root"))).filter("root != node").distinct()
        e = stored(small, "small")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return e.select("node", "root")
        seen = tuple(state)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT, carry: dict | None = None) -> DataFrame:
    """(key, carried columns, fp, root, component_id): component_id is the smallest key reachable over links, root a
    number of the component that is never null.

    ``carry``: {name: Column of ``docs``} that go along with the key.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the index is complete up to 4 differing bits")
    src = docs.select(F.col(key), *[c.alias(n) for n, c in (carry or {}).items()], F.col(text_col).alias("_text"))
    fps = fingerprints(src, [key, *(carry or {})], "_text", shingle)
    classes = stored(fps.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    roots = stored(components(links(classes.select("fp"), list_limit, max_bits)), "roots")
    owner = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(owner.join(ids, "root").select("fp", "root", "component_id"), "members")
    return fps.join(named, "fp")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
