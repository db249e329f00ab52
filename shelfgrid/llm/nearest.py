"""Nearest neighbours by inner product through multiprobe p-stable hashing."""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfgrid.llm.common import written

_TASK = "table int, cell int, part int, queries int, query boolean, id long, places binary, near double, bound double, least double, vector binary"
_HITS = "query_id long, rep long, score double"
_STEP = 4  # the search of all rows follows searches of a 1/_STEP, 1/_STEP**2, ... of them, which say what a neighbour must score
_LEAST = 0.05  # neighbours below this cosine can be in any bucket: all are visited
_CDF = np.vectorize(lambda z: 0.5 * (1 + erf(z / sqrt(2))))


class Hashes:
    """``tables`` x ``functions`` p-stable hashes of unit vectors, the last component being what a shorter vector lacks."""

    def __init__(self, dimension: int, tables: int, functions: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.tables, self.functions, self.width = tables, functions, width
        self.directions = rng.normal(size=(dimension + 1, tables * functions))
        self.shifts = rng.uniform(0, width, tables * functions)
        self.most = int(np.ceil(5.0 / width)) + 1  # cells on either side; those further out are one

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections, (rows, tables, functions)."""
        return np.einsum("ij,jk->ik", x, self.directions).reshape(-1, self.tables, self.functions)

    def cells(self, places: np.ndarray) -> np.ndarray:
        cells = np.floor((places + self.shifts.reshape(self.tables, self.functions)) / self.width).astype(np.int64)
        return np.clip(cells, -self.most, self.most) + self.most

    def chances(self, places: np.ndarray, table: int, near: np.ndarray) -> np.ndarray:
        """(rows, functions, cells): chance that a neighbour of the row's cosine ``near`` lies in each cell."""
        edges = np.arange(-self.most, self.most + 2) * self.width
        shift = self.shifts.reshape(self.tables, self.functions)[table]
        near = near[:, None, None]
        spread = np.sqrt(np.maximum(1 - near * near, 1e-6))
        below = _CDF((edges[None, None, :] - shift[None, :, None] - near * places[:, :, None]) / spread)
        below[:, :, 0], below[:, :, -1] = 0, 1
        return np.diff(below, axis=2)

    def bounds(self, chances: np.ndarray, success: float) -> np.ndarray:
        """Chance of the last bucket to visit, if buckets are visited by falling chance until ``success`` is reached."""
        out = np.empty(len(chances))
        for i, c in enumerate(chances):
            joint = c[0]
            for row in c[1:]:
                joint = np.multiply.outer(joint, row).ravel()
                joint = joint[joint > 1e-9]
            joint = np.sort(joint)[::-1]
            at = int(np.searchsorted(np.cumsum(joint), success))
            out[i] = joint[min(at, len(joint) - 1)]
        return out


def _usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _joint(chances: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """(rows, buckets): chance of each bucket, given as its cells."""
    out = np.ones((len(chances), len(cells)))
    for f in range(cells.shape[1]):
        out *= chances[:, f, cells[:, f]]
    return out


def _unit(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Inner products as cosines: rows are shortened by the longest norm and filled up, queries made unit vectors."""
    norm = np.sqrt((x * x).sum(axis=1))
    if query:
        return np.column_stack([x / norm[:, None], np.zeros(len(x))])
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(1 - (norm / longest) ** 2, 0))])


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 2, functions: int = 4, width: float = 1.0, success: float = 0.94,
    sample: int = 2000, block: int = 4096, seed: int = 11,
) -> DataFrame:
    """``k`` nearest rows of each query row: query_id, rank (from 1), vec_id, score (inner product, in doubles).

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` marks the queries. A row is no candidate of itself; ties go to the smaller
    ``vec_id``; with fewer candidates than ``k`` all found are returned. Vectors that are null, zero, of another length than
    most, or hold nulls or non-finite numbers take no part, nor do rows without an id. Rows that repeat an id count as one
    (the first in order of their vector). An empty table gives no rows.

    Equal vectors are searched as one and listed by their ``k + 1`` smallest ids, which is all that can be returned. Each
    table hashes by ``functions`` projections into cells of ``width``. How near its ``k``-th neighbour is, is guessed for each
    query from its cosines with ``sample`` rows (of smallest hash); with it, a query visits perturbed buckets of a table by
    falling chance to hold that neighbour, until their chances together make the share that brings all tables together to
    ``success``. Every row is indexed. Candidates of all tables are merged and ranked by exact inner products.

    Those of the sampled rows that a query visits give a score that the ``k``-th row it finds has at least, and so do searches
    of growing hashed shares of the rows, each four times the one before, which visit the same buckets and come first. A search
    returns only rows that score as much, some hundreds for a query however many rows and blocks there are.

    The true ``k``-th neighbour is at least as near as the ``k``-th found. Queries that found it farther off than guessed
    search once more with the cosine found, and those that found fewer than ``k`` search all rows; so ``success`` holds
    whatever the guess was, and the guess decides the work only.

    A task is a block of at most about ``block`` candidates with neighbouring buckets against a block of queries, so a
    bucket with a third of all rows is many tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & _usable("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = size["n"]
    rows = written(rows.where(F.size("v") == dimension).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "vectors")
    first = Window.partitionBy("v").orderBy("id")
    members = written(rows.select("id", "v").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1), "vector-members")
    distinct = members.where("n = 1").select("id", "v")
    members = members.join(distinct.withColumnRenamed("id", "rep"), "v").select("rep", F.col("id").alias("vec_id"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).first()
    there, longest = facts["n"], facts["longest"]
    seen = distinct.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    seen_ids, seen_rows = np.array([r["id"] for r in seen], np.int64), np.array([r["v"] for r in seen]).reshape(-1, dimension)
    base = _unit(seen_rows, longest, False)
    expected = len(seen) * k / max(there, 1)  # neighbours in the sample; some more make the guess a careful one
    place = min(len(seen) - 1, int(expected + 2 * sqrt(expected)) + 1) if seen else 0
    by_table = 1 - (1 - success) ** (1 / tables)
    hashes = Hashes(dimension, tables, functions, width, seed)
    seen_cells = hashes.cells(hashes.places(base))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.array(column.to_pylist(), float).reshape(-1, dimension)

    def bounded(chances: np.ndarray, near: np.ndarray) -> np.ndarray:
        return np.where(near > _LEAST, hashes.bounds(chances, by_table), 0) if there > k + 1 else np.zeros(len(near))

    def reached(chances: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(rows, cells): the first cells that hold a bucket to visit."""
        return chances[:, 0] * chances[:, 1:].max(axis=2).prod(axis=1)[:, None] >= bounds[:, None]

    def visited(places: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Which of the sampled rows lie in a bucket that a query visits."""
        out = np.zeros((len(near), len(base)), bool)
        for t in range(tables):
            chances = hashes.chances(places[:, t], t, near)
            bounds = bounded(chances, near)
            sent = reached(chances, bounds)[:, seen_cells[:, t, 0]]
            out |= sent & (_joint(chances, seen_cells[:, t]) >= bounds[:, None] * (1 - 1e-9))
        return out

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = np.array(batch.column("id").to_pylist(), np.int64), matrix(batch.column("v"))
            near, least = np.empty(len(ids)), np.full(len(ids), -np.inf)
            for at in range(0, len(ids), 512):
                own = slice(at, at + 512)
                unit = _unit(x[own], longest, True)
                cosines = unit @ base.T
                cosines[ids[own, None] == seen_ids] = -1
                near[own] = np.minimum(-np.partition(-cosines, place, axis=1)[:, place], 0.999)
                if there > k + 1 and len(seen) > k:
                    scores = x[own] @ seen_rows.T
                    scores[~visited(hashes.places(unit), near[own])] = -np.inf
                    slack = 1e-9 * longest * np.sqrt((x[own] ** 2).sum(axis=1))
                    least[own] = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)] - slack
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(near), pa.array(least)], names=["id", "v", "near", "least"])

    queries = written(rows.where("q").select("id", "v").mapInArrow(guess, "id long, v array<double>, near double, least double"), "vector-queries")

    def cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = hashes.cells(hashes.places(_unit(matrix(batch.column("v")), longest, False)))[:, :, 0]
            found = [(t, *x) for t in range(tables) for x in zip(*np.unique(cells[:, t], return_counts=True), strict=True)]
            yield pa.record_batch([pa.array([int(f[i]) for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["t", "c", "n"])

    counts = distinct.select("v").mapInArrow(cell_counts, "t int, c int, n long").groupBy("t", "c").agg(F.sum("n").alias("n")).collect()

    def spread(role: bool, query_blocks: int, parts: dict):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ids, x = np.array(part.column("id").to_pylist(), np.int64), matrix(part.column("v"))
                    near, least = (np.array(part.column(n).to_pylist(), float) if role else None for n in ("near", "least"))
                    places = hashes.places(_unit(x, longest, role))
                    cells = hashes.cells(places)
                    mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    out = []
                    for t in range(tables):
                        if role:
                            chances = hashes.chances(places[:, t], t, near)
                            bounds = bounded(chances, near)
                            to_reach = reached(chances, bounds)
                        for i in range(len(ids)):
                            if role:
                                stored = np.ascontiguousarray(places[i, t]).tobytes()
                                to = [(c, p, mix[i] % query_blocks) for c in np.flatnonzero(to_reach[i]) for p in range(parts.get((t, int(c)), 0))]
                            else:
                                stored = cells[i, t].astype("<i8").tobytes()
                                c = int(cells[i, t, 0])
                                to = [(c, mix[i] % parts[t, c], b) for b in range(query_blocks)]
                            out += [(t, int(c), int(p), int(b), role, int(ids[i]), stored, float(near[i]) if role else None, float(bounds[i]) if role else None, float(least[i]) if role else None, x[i].tobytes()) for c, p, b in to]
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.binary())
                    yield pa.record_batch([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=[f.split()[0] for f in _TASK.split(", ")])

        return work

    def search(group: pa.Table) -> pa.Table:
        role = np.array(group.column("query").to_pylist(), bool)
        ids = np.array(group.column("id").to_pylist(), np.int64)
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), float).reshape(-1, dimension)
        stored, bounds, near, floor = (group.column(n).to_pylist() for n in ("places", "bound", "near", "least"))
        table = group.column("table")[0].as_py()
        q, c = np.flatnonzero(role), np.flatnonzero(~role)
        out: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(c):
            cells = np.frombuffer(b"".join(stored[i] for i in c), "<i8").reshape(-1, functions)
            kinds, of = np.unique(cells, axis=0, return_inverse=True)
            of = of.ravel()
            for at in range(0, len(q), 256):
                own = q[at:at + 256]
                places = np.frombuffer(b"".join(stored[i] for i in own), float).reshape(-1, functions)
                chances = hashes.chances(places, table, np.array([near[i] for i in own]))
                visit = _joint(chances, kinds) >= np.array([bounds[i] for i in own])[:, None] * (1 - 1e-9)
                scores = x[own] @ x[c].T
                scores[~visit[:, of] | (scores < np.array([floor[i] for i in own])[:, None])] = -np.inf
                least = np.partition(scores, -min(k + 1, len(c)), axis=1)[:, -min(k + 1, len(c))]
                row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                value = np.einsum("ij,ij->i", x[own[row]], x[c[col]])
                order = np.lexsort((ids[c[col]], -value, row))
                row, col, value = row[order], col[order], value[order]
                within = np.arange(len(row)) - np.searchsorted(row, row)
                best = within <= k
                out.append((ids[own[row[best]]], ids[c[col[best]]], value[best]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "rep": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(float))})

    def searched(queries: DataFrame, share: int = 1) -> DataFrame:
        """Hits of ``queries`` (id, v, near, least) among one row in ``share``."""
        blocks = max(1, -(-queries.count() // block))
        parts = {(r["t"], r["c"]): -(-r["n"] // (share * block)) for r in counts}
        some = distinct if share == 1 else distinct.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
        tasks = some.mapInArrow(spread(False, blocks, parts), _TASK).unionByName(queries.mapInArrow(spread(True, blocks, parts), _TASK))
        return tasks.groupBy("table", "cell", "part", "queries").applyInArrow(search, _HITS)

    def best(hits: DataFrame) -> DataFrame:
        better = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
        return hits.distinct().withColumn("n", F.row_number().over(better)).where(F.col("n") <= k + 1)

    def ranked(hits: DataFrame) -> DataFrame:
        found = best(hits).drop("n").join(members, "rep").where("vec_id != query_id")
        final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    slack = F.lit(1e-9 * (longest or 0)) * norm  # the same product, summed in another order, may be a little less
    if there <= k + 1:
        return ranked(searched(queries))
    share = 1
    while there // (share * _STEP) >= 2 * sample:
        share *= _STEP
    while share > 1:  # one of k + 1 rows found may be the query's own
        last = best(searched(queries, share)).where(F.col("n") == k + 1).select(F.col("query_id").alias("id"), "score")
        least = F.greatest(F.col("least"), F.col("score") - slack)
        queries = written(queries.join(last, "id", "left").select("id", "v", "near", least.alias("least")), "vector-queries")
        share //= _STEP
    hits = written(searched(queries), "vector-hits")
    last = ranked(hits).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    cosine = F.coalesce(F.col("score") / F.lit(longest) / norm, F.lit(-1.0))
    again = queries.where(F.col("near") > _LEAST).join(last, "id", "left").where(cosine < F.col("near"))
    again = written(again.select("id", "v", cosine.alias("near"), F.greatest(F.col("least"), F.col("score") - slack).alias("least")), "vector-queries-again")
    if again.count():
        hits = hits.unionByName(searched(again))
    return ranked(hits)
