"""Exact top-k inner-product retrieval per (query, source), by a grid of query blocks and vector chunks.

Vectors are dealt to chunks and queries to blocks, both by hash; every cell of the grid (one chunk, one block) is one
partition. Its task holds the chunk (``CHUNK_BYTES``, whatever the size of the table), sorted by source, and takes
the block's queries in batches whose size in bytes is checked (``batch_bytes``): a batch is multiplied with the
chunk, the best k per (query, source) are handed on at once. A partial and a final ``row_number() <= k`` join the
chunks' winners. Neither queries nor vectors pass through the driver, and the plan is the same for any number of
batches. What a winner is called (``carry``: its image path) travels with it, so no lookup of paths follows (J9).

A source with a third of all vectors is spread over all chunks like the others. The work is the product of queries
and vectors, as in any exact search; only the number of cells grows with it. Scores are summed component by
component, so equal vectors tie exactly; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ship this module's functions to Python workers by value: a worker whose path does
# not include the package (a driver started from another folder) can still run them.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

BATCH_BYTES = 64 << 20       # bytes of one query batch at most
CHUNK_BYTES = 32 << 20       # bytes of the vectors a task holds; its worker needs about five times as much at most
BLOCK_BYTES = 16 << 20       # bytes of the queries of a cell: its winners are sorted in one task
CELL_PAIRS = 1 << 26         # pairs that are worth a cell of their own
SCORES_AT_ONCE = 1 << 21     # scores held at a time
QUERIES_AT_ONCE = 256        # queries multiplied at a time, fewer if a source of the chunk has many vectors
SUMS_AT_ONCE = 1 << 16       # candidates whose exact scores are summed at a time


def l2_normalise(v: Column) -> Column:
    """X17 in the JVM: ``x / ||v||`` as DOUBLE."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))
    return F.transform(d, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays (DOUBLE)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _sums(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``a`` of q and ``b`` of x, component after component."""
    total = np.zeros(len(a))
    for lo in range(0, len(a), SUMS_AT_ONCE):
        s = slice(lo, lo + SUMS_AT_ONCE)
        left, right = q[a[s]], x[b[s]]
        for i in range(q.shape[1]):
            total[s] += left[:, i] * right[:, i]
    return total


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best vectors of each query, ties to the smaller id."""
    out, longest = [], math.sqrt(np.einsum("ij,ij->i", x, x).max())
    step = max(1, min(QUERIES_AT_ONCE, SCORES_AT_ONCE // len(x)))
    for lo in range(0, len(q), step):
        part = q[lo:lo + step]
        rough = part @ x.T
        if len(x) > k:      # all that reach the k-th best rough score, rounding allowed for
            least = np.partition(rough, len(x) - k, axis=1)[:, -k]
            size = np.sqrt((part ** 2).sum(axis=1)) * longest
            a, b = np.nonzero(rough >= (least - 1e-9 * size)[:, None])
        else:
            a, b = np.nonzero(np.ones_like(rough, bool))
        out.append(_ranked(a + lo, b, _sums(part, x, a, b), ids, k))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _ranked(a, b, score, ids, k):
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], score[keep]


def _first_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray | None:
    """Rows without the copies of a vector that k smaller ids beat whatever the query; None if that leaves all."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8)))[:, 0]
    order = np.argsort(whole, kind="stable")             # numbers in place of the vectors: no sorted copy of them
    vector = np.zeros(len(order), dtype=np.int64)
    for lo in range(0, len(order) - 1, SUMS_AT_ONCE):
        near = order[lo:lo + SUMS_AT_ONCE + 1]
        vector[lo + 1:lo + len(near)] = whole[near[1:]] != whole[near[:-1]]
    vector[order] = np.cumsum(vector)
    order = np.lexsort((ids, vector))
    vector = vector[order]
    keep = order[np.arange(len(order)) - np.searchsorted(vector, vector) < k]
    return np.sort(keep) if len(keep) < len(x) else None


def _chunk(held: list[pa.Table], dims: int, k: int, carry: list[str]) -> list[tuple]:
    """(source, vectors, ids, rows to hand on) of every source of the held vectors."""
    out, t = [], pa.concat_tables(held)
    for source in t["source"].unique().to_pylist():
        own = t.filter(pa.compute.equal(t["source"], source) if source is not None else pa.compute.is_null(t["source"]))
        x, ids = _matrix(own["vec"].combine_chunks(), dims), np.asarray(own["vec_id"])
        rows, keep = own.select(["vec_id", *carry]), _first_copies(x, ids, k)
        del own
        if keep is not None:
            x, ids, rows = x[keep], ids[keep], rows.take(pa.array(keep))
        out.append((source, x, ids, rows.combine_chunks()))
    return out


def _search(dims: int, k: int, batch: int, carry: list[str], names: list[str]):
    """Arrow step over (cell, asks, qid, source, vec_id, vec, carry...), a cell's vectors before its queries: the
    k best of the cell per (query, source), ``batch`` queries at a time."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, chunk = None, [], None           # vectors of the cell as they came; by source once a query comes
        for whole in batches:
            if not whole.num_rows:
                continue
            t = pa.Table.from_batches([whole])
            kind = np.asarray(t["cell"]) * 2 + np.asarray(t["asks"])
            starts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(kind)), strict=True):
                now, asks = divmod(int(kind[lo]), 2)
                if now != cell:
                    cell, held, chunk = now, [], None
                if not asks:
                    held.append(t.slice(lo, hi - lo).select(["source", "vec_id", "vec", *carry]))
                    continue
                if chunk is None:
                    chunk, held = _chunk(held, dims, k, carry) if held else [], []
                for at in range(lo, hi, batch):
                    part = t.slice(at, min(batch, hi - at)).combine_chunks()
                    q, q_ids = _matrix(part["vec"].combine_chunks(), dims), part["qid"].combine_chunks()
                    for source, x, ids, rows in chunk:
                        a, b, s = _best(q, x, ids, k)
                        found = rows.take(pa.array(b)).combine_chunks()
                        columns = [q_ids.take(pa.array(a)), pa.array([source] * len(a), pa.string()),
                                   *(found[c].combine_chunks() for c in ["vec_id", *carry])]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(s)], names)
    return search


def grid(n_queries: int, n_vectors: int, dims: int, tasks: int) -> tuple[int, int]:
    """(query blocks, vector chunks): chunks and blocks of bounded bytes, and a cell for each of ``tasks`` as far as
    there are pairs for them."""
    chunks = max(1, math.ceil(n_vectors * 8 * dims / CHUNK_BYTES))
    wanted = min(tasks, math.ceil(n_queries * n_vectors / CELL_PAIRS))
    return max(1, math.ceil(n_queries * 8 * dims / BLOCK_BYTES), math.ceil(wanted / chunks)), chunks


def topk_per_source(queries: DataFrame, db: DataFrame, k: int = 5, batch_bytes: int = BATCH_BYTES,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """``queries(qid, qvec ARRAY<DOUBLE>)`` × ``db(source, vec_id BIGINT, vec ARRAY, carry...)`` →
    ``(qid, source, rank, vec_id, carry..., score)`` with ``rank <= k`` ordered by score desc, vec_id asc.
    Null vectors match nothing; all others need one length."""
    queries = queries.filter(F.col("qvec").isNotNull()).select("qid", F.col("qvec").cast("array<double>").alias("vec"))
    n_queries, dims = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    schema = {f.name: f.dataType.simpleString() for f in db.schema}
    names = ["qid", "source", "vec_id", *carry, "score"]
    out = f"qid {queries.schema['qid'].dataType.simpleString()}, source string, vec_id bigint, " + \
        "".join(f"{c} {schema[c]}, " for c in carry) + "score double"
    vectors = db.filter(F.col("vec").isNotNull()).select("source", F.col("vec_id").cast("bigint").alias("vec_id"),
                                                         F.col("vec").cast("array<double>").alias("vec"), *carry)
    blocks, chunks = grid(n_queries, vectors.count(), dims, queries.sparkSession.sparkContext.defaultParallelism)

    def dealt(n: int, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.withColumn("_c", dealt(chunks, "vec_id", "vec")).withColumn("_b", each(blocks)) \
        .select((F.col("_b") * chunks + F.col("_c")).alias("cell"), F.lit(0).alias("asks"), "source", "vec_id", "vec", *carry)
    asked = queries.withColumn("_b", dealt(blocks, "qid", "vec")).withColumn("_c", each(chunks)) \
        .select((F.col("_b") * chunks + F.col("_c")).alias("cell"), F.lit(1).alias("asks"), "qid", "vec")
    cells = held.unionByName(asked, allowMissingColumns=True).repartitionById(blocks * chunks, F.col("cell")) \
        .sortWithinPartitions("cell", "asks").select("cell", "asks", "qid", "source", "vec_id", "vec", *carry)
    batch = max(1, batch_bytes // (8 * max(dims, 1)))
    found = cells.mapInArrow(_search(dims, k, batch, list(carry), names), out)
    place = Window.partitionBy("qid", "source").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place).cast("bigint")).filter(F.col("rank") <= k) \
        .select("qid", "source", "rank", "vec_id", *carry, "score")
