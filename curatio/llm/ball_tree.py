"""Ranked lexical search: exact maximum inner products by a sparse ball tree.

The score of a document for a query is the inner product of the query's term counts and the document's weighted
term values, all of them whole numbers, so only the queries' own terms matter: one pass over the texts keeps, for
every document, its number of terms and the counts of those terms, next to sums over the whole table (documents,
terms, documents per term). A second pass turns counts into weighted values (frequent terms weigh little, so they
do not widen the balls) and searches them:

* a task takes its documents in slices (``SLICE_CELLS`` bounds the centroids of one slice) and builds a ball
  tree over each: a node is a centroid and a radius that covers its documents, split between two far documents;
* for query q no document of a node scores above ``q.centroid + |q| * radius``, nor above ``q.(centroid + reach)``
  where reach is the radius along each term; the smaller of the two counts (of 10,000 texts and 200 queries the first
  alone leaves 99 % of the documents to score, both leave 41 %). Bounds are computed in doubles and raised by
  ``SAFE`` times themselves plus one, more than rounding can take from them, so no document is lost;
* nodes are taken best first from a priority queue until the next bound lies under the k-th best score the task
  has for that query (from earlier slices, too); equal bounds are followed, since ties go to the smaller key;
  leaves are scored in whole numbers.

Every task hands on at most k rows a query; a window keeps the k best of them. Equal documents of a slice are
one point of the tree with their k smallest keys.

Defined results: null or empty texts have no terms and never match; equal query rows are answered once; equal
document rows are documents of their own; null document keys come last among equals; an empty table on either
side gives no rows; columns other than keys and texts are not read. Queries are searched in blocks whose terms
are bounded by ``block_terms`` (one query alone may hold more); each block reads the documents once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.common import ascii_lower, let, stored, text_slices

LEAF = 32                    # points of a leaf
SLICE_CELLS = 1 << 23        # centroid cells (nodes x query terms) of one slice
SLICE_ROWS = 8192            # documents of one slice at most
BLOCK_TERMS = 1 << 15        # terms of the queries searched together
SAFE = 1e-9                  # rounding takes under terms * 2^-52 of a bound: safe to 4 million terms a query
SLACK = 1e-5                 # of the norms, on a radius: a difference of squares loses half of its digits; safe to 400,000 terms a document
LAST = (1 << 63) - 1         # stands for a null key

# ASCII letters and digits and every byte of other characters form terms; A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
TERM_RULE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

COUNTS = "doc long, n bigint, ids array<int>, tfs array<int>"
FOUND = "query bigint, doc long, score bigint"


def _term_counts(vocabulary: dict[bytes, int]):
    def count(batches):
        for b in text_slices(batches, 8 << 20, 1):
            ns, ids, tfs, ends = [], [], [], [0]
            for text in b.column(1).to_pylist():
                terms = text.translate(TERM_BYTES).split()
                known = np.array([vocabulary[t] for t in terms if t in vocabulary], np.int32)
                own, times = np.unique(known, return_counts=True)
                ns.append(len(terms))
                ids.append(own)
                tfs.append(times.astype(np.int32))
                ends.append(ends[-1] + len(own))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tfs)))], ["doc", "n", "ids", "tfs"])
    return count


class BallTree:
    """Ball tree over sparse rows, none empty (``ids`` and ``values`` between ``starts``), centroids over ``width`` terms."""

    def __init__(self, starts: np.ndarray, ids: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.ids, self.values, self.width = starts, ids, values, width
        self.norm2 = self._sums(np.arange(len(starts) - 1), values * values)
        self.centre, self.reach, self.radius, self.kids, self.rows = [], [], [], [], []
        self._grow(np.arange(len(starts) - 1))
        self.centre, self.reach, self.radius = np.array(self.centre), np.array(self.reach), np.array(self.radius)

    def _flat(self, rows):
        """Positions of the entries of some rows, and where each row begins among them."""
        size = self.starts[rows + 1] - self.starts[rows]
        begin = np.concatenate([[0], np.cumsum(size)])
        return np.arange(begin[-1]) + np.repeat(self.starts[rows] - begin[:-1], size), begin

    def _sums(self, rows, per_entry):
        """Sum of a value per entry for each row."""
        at, begin = self._flat(rows)
        return np.add.reduceat(per_entry[at], begin[:-1])

    def _distance(self, rows, point):
        """Distances of rows to a dense point."""
        dot = self._sums(rows, point[self.ids] * self.values)
        return np.sqrt(np.maximum(self.norm2[rows] + point @ point - 2 * dot, 0))

    def _row(self, row):
        point = np.zeros(self.width)
        own = slice(self.starts[row], self.starts[row + 1])
        point[self.ids[own]] = self.values[own]
        return point

    def _grow(self, rows) -> int:
        at, _ = self._flat(rows)
        centre = np.bincount(self.ids[at], weights=self.values[at], minlength=self.width) / len(rows)
        away = self._distance(rows, centre)
        node = len(self.radius)
        top = np.zeros(self.width)
        np.maximum.at(top, self.ids[at], self.values[at])
        self.centre.append(centre)
        self.reach.append(top - centre)
        self.radius.append(float(away.max()) + SLACK * math.sqrt(float(self.norm2[rows].max() + centre @ centre)))
        self.kids.append(None)
        self.rows.append(rows)
        if len(rows) > LEAF:
            one = self._row(rows[int(away.argmax())])
            to_one = self._distance(rows, one)
            to_two = self._distance(rows, self._row(rows[int(to_one.argmax())]))
            order = np.argsort(to_one - to_two, kind="stable")
            half = len(rows) // 2
            self.kids[node] = (self._grow(rows[order[:half]]), self._grow(rows[order[half:]]))
            self.rows[node] = None
        return node

    def bounds(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """No document of a node scores above its bound."""
        q = counts.astype(float)
        middle = self.centre[:, terms] @ q
        bounds = middle + np.minimum(self.reach[:, terms] @ q, math.sqrt(float(q @ q)) * self.radius)
        return bounds + SAFE * bounds + 1

    def search(self, bounds: np.ndarray, scores_of, least) -> int:
        """Best-first walk: ``scores_of(leaf)`` scores a leaf, ``least()`` is the score that a node's bound has to
        reach. Returns the number of documents scored."""
        heap, scored = [(-bounds[0], 0)], 0
        while heap and -heap[0][0] >= least():
            _, node = heapq.heappop(heap)
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(heap, (-bounds[kid], kid))
            else:
                scores_of(node)
                scored += len(self.rows[node])
        return scored


class Best:
    """The k best (score, key) of one query so far: higher scores, then smaller keys."""

    def __init__(self, k: int):
        self.k, self.keys, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, keys, scores):
        keep = scores >= self.least()
        if keep.any():
            keys, scores = np.concatenate([self.keys, keys[keep]]), np.concatenate([self.scores, scores[keep]])
            order = np.lexsort((keys, -scores))[:self.k]
            self.keys, self.scores = keys[order], scores[order]


def _searcher(queries: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Arrow step over ``COUNTS`` rows: the k best documents of the task for each (query, term ids, counts)."""
    width = len(weight)
    rows_a_slice = int(min(SLICE_ROWS, max(LEAF, SLICE_CELLS // max(width, 1) * LEAF // 4)))

    def one_slice(docs, ns, starts, ids, tfs, best):
        sizes = np.diff(starts)
        m = 25 + (75 * ns * n_docs) // n_terms
        values = weight[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, sizes)))
        # equal rows are one point with their k smallest keys
        groups: dict[bytes, list[int]] = {}
        for row in np.lexsort((docs,)):
            own = slice(starts[row], starts[row + 1])
            groups.setdefault(ids[own].tobytes() + values[own].tobytes(), []).append(row)
        same = [rows[:k] for rows in groups.values()]
        lead = np.array([rows[0] for rows in same])
        at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in lead])
        tree = BallTree(np.concatenate([[0], np.cumsum(sizes[lead])]), ids[at], values[at].astype(float), width)
        whole = values[at]
        leaves = {}
        for node, rows in enumerate(tree.rows):
            if rows is not None:
                entries, begin = tree._flat(rows)
                leaves[node] = rows, tree.ids[entries], whole[entries], begin[:-1]
        times = np.array([len(rows) for rows in same])
        first = np.concatenate([[0], np.cumsum(times)])
        keys = docs[np.concatenate(same)]
        dense = np.zeros(width, np.int64)
        for j, (_, terms, counts) in enumerate(queries):
            dense[terms] = counts

            def scores_of(leaf, to=best[j]):
                rows, ids, values, begin = leaves[leaf]
                scores = np.add.reduceat(dense[ids] * values, begin)
                good = scores >= to.least()
                rows, scores = rows[good], scores[good]
                if len(rows):
                    copies = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
                    to.add(keys[copies], np.repeat(scores, times[rows]))

            tree.search(tree.bounds(terms, counts), scores_of, best[j].least)
            dense[terms] = 0

    def search(batches: Iterator[pa.RecordBatch]):
        best = [Best(k) for _ in queries]
        for b in batches:
            table = pa.Table.from_batches([b])
            table = table.filter(pa.compute.greater(pa.compute.list_value_length(table["ids"]), 0))
            for lo in range(0, table.num_rows, rows_a_slice):
                part = table.slice(lo, rows_a_slice).combine_chunks()
                ids, tfs = part["ids"].combine_chunks(), part["tfs"].combine_chunks()
                starts = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(ids)))])
                one_slice(np.asarray(pa.compute.fill_null(part["doc"], LAST)), np.asarray(part["n"]), starts,
                          np.asarray(ids.flatten()), np.asarray(tfs.flatten()).astype(np.int64), best)
        number = [q for q, _, _ in queries]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(number, [len(x.keys) for x in best]), pa.int64()),
             pa.array(np.concatenate([x.keys for x in best]), pa.int64()),
             pa.array(np.concatenate([x.scores for x in best]), pa.int64())], ["query", "doc", "score"])
    return search


def _terms(text: str) -> dict[bytes, int]:
    times: dict[bytes, int] = {}
    for t in text.encode().translate(TERM_BYTES).split():
        times[t] = times.get(t, 0) + 1
    return times


def _search_block(docs: DataFrame, block: list[tuple[int, str]], k: int) -> DataFrame | None:
    asked = [(number, _terms(text)) for number, text in block]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, times in asked for t in times}))}
    counts = stored(docs.mapInArrow(_term_counts(vocabulary), COUNTS), "counts")
    n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_terms:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("ids").alias("id")).groupBy("id").count().collect():     # a row per query term
        df[r["id"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries = []
    for number, times in asked:
        ids = np.array([vocabulary[t] for t in times], np.int64)
        queries.append((number, ids, np.array(list(times.values()), np.int64)))
    return counts.mapInArrow(_searcher(queries, weight, n_docs, n_terms, k), FOUND)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key_col: str = "doc_id", text_col: str = "text",
           query_key: str = "item_id", query_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``query_key, rank, key_col, score``: each query's ``k`` documents of highest score above 0."""
    key_type, doc_type = queries.schema[query_key].dataType, docs.schema[key_col].dataType
    rows = docs.select(F.col(key_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    asked = queries.select(F.col(query_key).alias("item"), F.coalesce(F.col(query_text), F.lit("")).alias("text")).distinct()
    # numbered and cut into blocks by the running number of terms: one query is never divided
    terms = let(ascii_lower(F.col("text")), lambda t: F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(TERM_RULE), F.lit(0)))))
    asked = stored(asked.select("item", "text", terms.cast("bigint").alias("terms"), F.xxhash64("item", "text").alias("query")), "asked")
    parts = max(1, math.ceil((asked.agg(F.sum("terms")).first()[0] or 0) / block_terms))
    found = []
    for part in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).select("query", "text").collect()
        if block and (hits := _search_block(rows, [tuple(r) for r in block], k)) is not None:
            found.append(hits)
    if not found:
        found = [docs.sparkSession.createDataFrame([], FOUND)]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    place = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    top = hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return top.join(asked.select("query", "item"), "query").select(
        F.col("item").cast(key_type).alias(query_key), "rank", F.when(F.col("doc") != LAST, F.col("doc")).cast(doc_type).alias(key_col), "score")
