"""Approximate nearest neighbours by inner product: hierarchical k-means tree, searched best bin first.

* Index: vectors get one more component, ``sqrt(M^2 - |x|^2)`` with M the largest norm, after which the largest
  inner product with a query is the smallest distance to it. The tree is fitted by k-means within k-means on
  about ``sample`` vectors chosen by a hash of their key (a documented bound: the fit only places cells, and the
  driver holds ``sample`` x dimensions numbers); every vector of the table is then put into its leaf.
* Copies: at most k + 1 keys of one vector can be among a query's k nearest, so only the smallest k + 1 keys of
  equal vectors are indexed, found by a partial and a final limit: exact, and no copies flood a leaf.
* Search: a query walks the tree with a priority queue over distances to cell centres and visits leaves until it
  has seen ``visits`` of them and k candidates. ``visits`` is the smallest number at which ``calibration`` queries,
  whose true neighbours are found by one scan of all vectors, reach the recall ``target``.
* Work: leaves are packed into regions of about ``region_rows`` vectors (larger leaves are cut into blocks); a
  query goes to the regions of its leaves and is scored there against those leaves only. A region that very many
  queries visit is repeated for blocks of ``region_queries`` of them. A task holds one region and streams queries.

Scores are summed in doubles component by component, so equal vectors tie exactly; ties go to the smaller key.

Defined results: rows with a null key take no part, nor do vectors that are null, empty, zero, hold null or
non-finite components, or have another length than most (ties: the longer); equal rows count once; a query's own
rows are all rows with its key; one key with several vectors asks once for each; with no vectors the result is
empty; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.common import stored

SAMPLE = 16_384              # vectors the tree is fitted on
BRANCHES = 8                 # cells of an inner node
LEAF = 24                    # sample vectors of a leaf at most
ROUNDS = 12                  # k-means rounds of a node
CALIBRATION = 128            # queries whose true neighbours set the number of visits
TARGET = 0.96                # their recall
REGION_ROWS = 4096
REGION_QUERIES = 50_000
AT_ONCE = 512                # queries scored together


class Tree:
    """Cells of hierarchical k-means: node 0 is the root, ``kids[i]`` a range of nodes, ``leaf[i]`` a leaf number or -1."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, self.kids, self.leaf = [points.mean(axis=0)], [(0, 0)], [-1]
        todo, leaves = [(0, points)], 0
        while todo:
            node, own = todo.pop()
            parts = _split(own, rng) if len(own) > LEAF else []
            if len(parts) < 2:
                self.leaf[node] = leaves
                leaves += 1
                continue
            self.kids[node] = (len(centres), len(centres) + len(parts))
            for part in parts:
                todo.append((len(centres), part))
                centres.append(part.mean(axis=0))
                self.kids.append((0, 0))
                self.leaf.append(-1)
        self.centres, self.leaves = np.array(centres), leaves

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points to all cell centres (less the points' own squares)."""
        return (self.centres ** 2).sum(axis=1) - 2 * points @ self.centres.T

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point: the nearest cell at every level."""
        near, out = self.distances(points), np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            lo, hi = self.kids[node]
            to = lo + near[rows, lo:hi].argmin(axis=1)
            todo += [(kid, rows[to == kid]) for kid in range(lo, hi) if (to == kid).any()]
        return out

    def visit(self, near: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order for one point, from its row of ``distances``."""
        heap, near = [(0.0, 0)], near.tolist()
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for kid in range(*self.kids[node]):
                heapq.heappush(heap, (near[kid], kid))


def _split(points: np.ndarray, rng) -> list[np.ndarray]:
    """Points in up to ``BRANCHES`` k-means cells (fewer than two cells: they cannot be told apart)."""
    centres = points[rng.choice(len(points), min(BRANCHES, len(points)), replace=False)]
    for _ in range(ROUNDS):
        of = ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        size = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, points)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    of = ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
    return [points[of == c] for c in range(len(centres)) if (of == c).any()]


def _matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest norm, with the component that makes every one of them a unit vector."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(1 - (x ** 2).sum(axis=1), 0))[:, None]])


def _asked(x: np.ndarray) -> np.ndarray:
    return np.hstack([x / np.sqrt((x ** 2).sum(axis=1))[:, None], np.zeros((len(x), 1))])


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, component after component."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _top(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, found: tuple, k: int):
    """The k best of (query row, vector row, rough score) per query, exact scores, ties by key."""
    a, b, s = found
    fits = q_id[a] != x_id[b]
    a, b, s = a[fits], b[fits], s[fits]
    order = np.lexsort((-s, a))
    a, b, s = a[order], b[order], s[order]
    at = np.searchsorted(a, np.arange(len(q)))
    kth = s[np.minimum(at[a] + k - 1, np.searchsorted(a, a, side="right") - 1)]
    slack = 1e-9 * np.sqrt((q ** 2).sum(axis=1))[a] * math.sqrt((x ** 2).sum(axis=1).max())
    keep = s >= kth - slack
    a, b = a[keep], b[keep]
    s = dot(q[a], x[b])
    order = np.lexsort((x_id[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], s[keep]


def _rough(q: np.ndarray, x: np.ndarray, k: int, seen: np.ndarray | None = None):
    """Candidates among vectors: all that reach the k-th best rough score (k + 1 for the query's own row); ``seen``
    (queries, vectors) leaves out the vectors of leaves that a query does not visit."""
    out = []
    for lo in range(0, len(q), AT_ONCE):
        part = q[lo:lo + AT_ONCE]
        s = part @ x.T
        if seen is not None:
            s[~seen[lo:lo + AT_ONCE]] = -np.inf
        least = np.full(len(part), -np.inf)
        if s.shape[1] > k + 1:
            least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, -k - 1]
        size = np.sqrt((part ** 2).sum(axis=1)) * math.sqrt((x ** 2).sum(axis=1).max())
        a, b = np.nonzero((s >= (least - 1e-9 * size)[:, None]) & (s > -np.inf))
        out.append((a + lo, b, s[a, b]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


FOUND = "query_id bigint, query_hash bigint, vec_id bigint, score double"


def _scan(queries, dims: int, k: int):
    """Arrow step: the k nearest of each given (id, hash, vector) among the task's vectors, with their leaves."""
    q_id = np.array([r[0] for r in queries], np.int64)
    q_hash = np.array([r[1] for r in queries], np.int64)
    q = np.array([r[2] for r in queries], np.float64)

    def scan(batches):
        for b in batches:
            if b.num_rows:
                x, x_id = _matrix(b.column("v"), dims), np.asarray(b.column("id"))
                a, r, s = _top(q, q_id, x, x_id, _rough(q, x, k), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_id[a]), pa.array(q_hash[a]), pa.array(x_id[r]), pa.array(s),
                                                  pa.array(np.asarray(b.column("leaf"))[r])],
                                                 ["query_id", "query_hash", "vec_id", "score", "leaf"])
    return scan


def _region_search(dims: int, k: int):
    """Arrow step over rows sorted by (region, part, kind): a region's vectors, then the queries that visit it."""
    def search(batches):
        now, held, x = None, [], None               # the region's vectors: at most about REGION_ROWS
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            key = np.asarray(t["region"]) * (1 << 24) + np.asarray(t["part"])
            asks = np.asarray(t["kind"]) == 1
            cut = np.nonzero((np.diff(key) != 0) | np.diff(asks))[0] + 1
            for lo, hi in zip([0, *cut], [*cut, len(key)], strict=True):
                own = t.slice(lo, hi - lo).combine_chunks()
                if key[lo] != now:
                    now, held, x = key[lo], [], None
                if not asks[lo]:
                    held.append(own)
                    continue
                if not held:
                    continue
                if x is None:
                    all_of = pa.concat_tables(held).combine_chunks().sort_by("leaf")
                    x, x_id = _matrix(all_of["v"].combine_chunks(), dims), np.asarray(all_of["id"])
                    leaf, of_leaf = np.unique(np.asarray(all_of["leaf"]), return_inverse=True)
                for at in range(0, own.num_rows, AT_ONCE):
                    yield from answer(own.slice(at, AT_ONCE).combine_chunks(), x, x_id, leaf, of_leaf)

    def answer(own, x, x_id, leaf, of_leaf):
        q, q_id = _matrix(own["v"].combine_chunks(), dims), np.asarray(own["id"])
        of = np.repeat(np.arange(len(q)), np.asarray(pa.compute.list_value_length(own["leaves"])))
        asked = np.asarray(own["leaves"].combine_chunks().flatten())
        at = np.minimum(np.searchsorted(leaf, asked), len(leaf) - 1)
        here = leaf[at] == asked
        visits = np.zeros((len(q), len(leaf)), bool)
        visits[of[here], at[here]] = True
        if here.any():
            a, r, s = _top(q, q_id, x, x_id, _rough(q, x, k, visits[:, of_leaf]), k)
            yield pa.RecordBatch.from_arrays([pa.array(q_id[a]), pa.array(np.asarray(own["hash"])[a]), pa.array(x_id[r]), pa.array(s)],
                                             ["query_id", "query_hash", "vec_id", "score"])
    return search


def usable(vector: Column) -> Column:
    """A vector that takes part: not null or empty, no null or non-finite component, not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            sample: int = SAMPLE, calibration: int = CALIBRATION, target: float = TARGET, region_rows: int = REGION_ROWS,
            region_queries: int = REGION_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k found nearest of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(v)).select(
        F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    most = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        return nothing
    dims = most["dims"]
    rows = rows.filter(F.size("v") == dims).withColumn("hash", F.xxhash64("v"))
    copies = Window.partitionBy("hash", "v").orderBy("id")
    few = rows.select("hash", "v", "id").withColumn("_place", F.dense_rank().over(copies)).filter(F.col("_place") <= k + 1)
    few = stored(few.select("hash", "v", "id").dropDuplicates(["hash", "v", "id"]), "vectors")
    asked = stored(rows.filter("asks").select("id", "hash", "v").dropDuplicates(["id", "hash", "v"]), "asked")
    total, longest = few.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()

    chosen = few if total <= sample else few.filter(F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(1 << 40)) < int(sample / total * (1 << 40)))
    points = np.array([r["v"] for r in chosen.select("v").limit(2 * sample).collect()], np.float64)      # 2 x: never reached, a bound
    tree = Tree(_lifted(points, longest)) if len(points) else Tree(np.zeros((1, dims + 1)))

    def place(batches):
        for b in batches:
            leaf = tree.assign(_lifted(_matrix(b.column("v"), dims), longest)) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], ["id", "v", "leaf"])

    placed = stored(few.select("id", "v").mapInArrow(place, "id bigint, v array<double>, leaf int"), "placed")
    size = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():                                                   # one row a leaf
        size[r["leaf"]] = r["count"]
    visits = _calibrate(tree, placed, asked, dims, k, calibration, target)

    region, blocks, used = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64), 0
    room = 0
    for leaf in range(tree.leaves):
        if size[leaf] > room:
            blocks[leaf] = max(1, -(-size[leaf] // region_rows))
            region[leaf], room = used, region_rows
            used += blocks[leaf]
        else:
            region[leaf] = used - 1
        room = room - size[leaf] if blocks[leaf] == 1 else 0

    def deal(batches):
        for b in batches:
            leaf = np.asarray(b.column("leaf"))
            ids = np.asarray(b.column("id")).astype(np.uint64)
            turn = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % blocks[leaf].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region[leaf] + turn.astype(np.int64))], ["id", "v", "leaf", "region"])

    rows_of, first_region, n_blocks = size.tolist(), region.tolist(), blocks.tolist()

    def ask(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near = tree.distances(_asked(_matrix(b.column("v"), dims)))
            row, where, ends, leaves = [], [], [0], []
            for i in range(b.num_rows):
                own: dict[int, list[int]] = {}
                seen = left = 0
                for leaf in tree.visit(near[i]):
                    if seen >= visits and left > k:
                        break
                    seen, left = seen + 1, left + rows_of[leaf]
                    for r in range(first_region[leaf], first_region[leaf] + n_blocks[leaf]):
                        own.setdefault(r, []).append(leaf)
                for r, found in own.items():
                    row.append(i)
                    where.append(r)
                    leaves += found
                    ends.append(len(leaves))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(row, pa.int64())) for c in b.columns), pa.array(where, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaves, pa.int32()))], ["id", "hash", "v", "region", "leaves"])

    spread = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "hash")
    visits_of = stored(spread.mapInArrow(ask, "id bigint, hash bigint, v array<double>, region bigint, leaves array<int>"), "visits")
    parts = visits_of.groupBy("region").agg(F.ceil(F.count("*") / region_queries).cast("int").alias("parts"))
    held = placed.mapInArrow(deal, "id bigint, v array<double>, leaf int, region bigint").join(parts, "region")
    held = held.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
                       "id", F.lit(0).cast("bigint").alias("hash"), "v", "leaf", F.array().cast("array<int>").alias("leaves"))
    asks = visits_of.join(parts, "region").select("region", F.pmod(F.xxhash64("id", "hash"), "parts").cast("int").alias("part"),
                                                  F.lit(1).alias("kind"), "id", "hash", "v", F.lit(-1).alias("leaf"), "leaves")
    work = held.unionByName(asks).repartition("region", "part").sortWithinPartitions("region", "part", "kind")
    found = work.mapInArrow(_region_search(dims, k), FOUND)
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _calibrate(tree: Tree, placed: DataFrame, asked: DataFrame, dims: int, k: int, calibration: int, target: float) -> int:
    """Smallest number of leaves whose visit gives the calibration queries the target recall of their true nearest."""
    chosen = asked.orderBy(F.xxhash64(F.lit(3), "id", "hash"), "id", "hash").limit(calibration).collect()
    if not chosen:
        return 1
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    true = placed.mapInArrow(_scan([(r["id"], r["hash"], r["v"]) for r in chosen], dims, k), FOUND + ", leaf int") \
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "query_hash", "leaf").collect()
    if not true:
        return 1
    near = tree.distances(_asked(np.array([r["v"] for r in chosen], np.float64)))
    order = {}
    for r, own in zip(chosen, near, strict=True):
        order[(r["id"], r["hash"])] = {leaf: i + 1 for i, leaf in enumerate(tree.visit(own))}
    needed = np.sort([order[(r["query_id"], r["query_hash"])][r["leaf"]] for r in true])
    return int(needed[max(0, math.ceil(target * len(needed)) - 1)])
