"""Exact top-k inner products by MaxScore over an inverted index of integer vectors.

A term is a dimension; its postings are the vectors with a positive and those with a negative component. A query
term can add at most |q| times the largest component of the sign that it shares. Terms are ordered by these bounds,
and the longest run of small ones whose bounds together stay below the k-th best score so far is non-essential: a
vector in no essential posting cannot enter. Essential postings of both signs are traversed, the other dimensions are
probed only for vectors that can still reach the threshold, largest bounds first.

Shards of the index are runs of rows; queries go to them in chunks of at most ``chunk_bytes``, and each task keeps
the k best of each query over its shards. A last grouping merges the tasks' lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.stage import stored

CHUNK_BYTES = 16 << 20
SHARD_ROWS = 8192
QUERY_ROWS = 128
EXACT = float(1 << 53)


def _packed(vectors: DataFrame, scale: float) -> DataFrame:
    """Shards (shard, dims, ids, matrix): floor(scale * x) as doubles, without rows that take no part.

    Shards of about SHARD_ROWS rows, whatever the input's files, keep the work of a query in long arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                rows = batch.slice(at, SHARD_ROWS)
                lists = rows["vector"]
                size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
                ids = rows["vec_id"].to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ends = np.cumsum(size).astype(np.int64)
                for dims in np.unique(size[size > 0]).astype(int):
                    which = np.flatnonzero(size == dims)
                    matrix = flat[(ends[which] - dims)[:, None] + np.arange(dims)]
                    fine = np.isfinite(matrix).all(1)
                    if fine.any():
                        matrix = np.floor(scale * matrix[fine])
                        values = [[part * (1 << 32) + number], [dims], [ids[which[fine]].astype(np.int64).tobytes()], [matrix.tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "dims", "ids", "matrix"])
                        number += 1

    shards = 1 + vectors.count() // SHARD_ROWS
    vectors = vectors.repartition(shards, F.xxhash64("vec_id", "vector"))
    usable = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull())
    return vectors.where(usable).mapInArrow(run, "shard long, dims int, ids binary, matrix binary")


def _matrix(value: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(value, np.float64).reshape(-1, dims)


class Shard:
    """Postings by dimension and sign, laid out as rows of one matrix, and the vectors themselves to probe."""

    def __init__(self, matrix: np.ndarray, exact: bool) -> None:
        # Whole numbers: doubles where every sum is exact in them, else Python's own.
        self.rows = matrix if exact else np.frompyfunc(int, 1, 1)(matrix)
        self.postings = np.concatenate((np.maximum(self.rows.T, 0), np.maximum(-self.rows.T, 0)))
        self.most = self.postings.max(axis=1)

    def search(self, queries: np.ndarray, floors: list, skip: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the rows, and their whole scores, among which are all that reach its floor (None: no floor yet).

        The row ``skip`` of a query is left out. Essential postings of all queries are traversed together.
        """
        dims = self.rows.shape[1]
        terms = np.where(queries > 0, np.arange(dims), np.arange(dims) + dims)
        bound = np.abs(queries) * self.most[terms]
        order = np.argsort(-bound.astype(float), axis=1, kind="stable")
        sorted_ = np.take_along_axis(bound, order, 1)
        rest = np.concatenate((np.cumsum(sorted_[:, ::-1], axis=1)[:, ::-1], 0 * sorted_[:, :1]), axis=1)
        weight, essential = np.zeros((len(queries), 2 * dims), self.rows.dtype), np.zeros(len(queries), int)
        for i, floor in enumerate(floors):
            if floor is not None and floor > 0:
                essential[i] = int(np.flatnonzero(rest[i] < floor)[0])
                own = order[i, : essential[i]]
                weight[i, terms[i, own]] = np.abs(queries[i, own])
                weight[i, (terms[i, own] + dims) % (2 * dims)] = -np.abs(queries[i, own])
        gain = weight @ self.postings
        for i, floor in enumerate(floors):
            first = essential[i]
            # Without essential terms every row is a candidate; else one in none of their postings is below the floor.
            alive = np.flatnonzero(gain[i] + rest[i, first] >= floor) if first else np.arange(len(self.rows))
            alive = alive[alive != skip[i]]
            score = gain[i, alive]
            for low in range(first, dims, 8):
                high = min(low + 8, dims)
                columns = order[i, low:high]
                score = score + self.rows[np.ix_(alive, columns)] @ queries[i, columns]
                if floor is not None:
                    keep = score + rest[i, high] >= floor
                    alive, score = alive[keep], score[keep]
            yield i, alive, score


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), int)
    return scores[order[:k]], ids[order[:k]]


def _scan(shards: DataFrame, chunk: list, k: int) -> DataFrame:
    sent = shards.sparkSession.sparkContext.broadcast([(r["number"], r["dims"], r["shard"], r["place"], r["vec_id"], bytes(r["vector"])) for r in chunk])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(number, dims, home, place, np.frombuffer(v, np.float64)) for number, dims, home, place, _, v in sent.value]
        largest = max((np.abs(q[4]).max() for q in queries), default=0.0)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dims, number = batch["dims"][i].as_py(), batch["shard"][i].as_py()
                matrix, ids = _matrix(batch["matrix"][i].as_py(), dims), np.frombuffer(batch["ids"][i].as_py(), np.int64)
                exact = max(np.abs(matrix).max(), 1) * max(largest, 1) * dims < EXACT
                shard = Shard(matrix, exact)
                own = [q for q in queries if q[1] == dims]
                for at in range(0, len(own), QUERY_ROWS):
                    part = own[at : at + QUERY_ROWS]
                    block = np.stack([q[4] for q in part])
                    block = block if exact else np.frompyfunc(int, 1, 1)(block)
                    skip = [q[3] if q[2] == number else -1 for q in part]
                    floors = []
                    first = shard.rows[:256] @ block.T  # the first rows give a first threshold
                    for j, (query, *_) in enumerate(part):
                        have = best.get(query)
                        seen = np.sort(first[np.arange(len(first)) != skip[j], j])
                        known = [x for x in (have[0][-1] if have and len(have[0]) == k else None, seen[-k] if len(seen) >= k else None) if x is not None]
                        floors.append(max(known) if known else None)
                    for j, rows, score in shard.search(block, floors, skip):
                        if len(rows):
                            query, found = part[j][0], ids[rows]
                            if query in best:
                                score, found = np.concatenate((best[query][0], score)), np.concatenate((best[query][1], found))
                            best[query] = _best(score, found, k)
        rows = [(query, int(v), int(max(min(s, (1 << 63) - 1), -(1 << 63)))) for query, (scores, ids) in best.items() for s, v in zip(scores, ids, strict=True)]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "vec_id", "score"])

    return shards.mapInArrow(run, "number long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row of ``vectors`` (vec_id, vector) its k best other rows.

    ``is_query`` is a condition on vec_id. Components become floor(scale * x); the score is the integer inner
    product (beyond a long: its nearest end), ties go to the smaller vec_id. Rows whose id, vector or a component is
    null, whose vector is empty or holds a component that isn't finite take no part; vectors of other lengths are
    not compared. Rows that repeat an id are rows of their own. An empty table gives an empty result.
    """
    shards = stored(_packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")), scale), "shards")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch["dims"][i].as_py()
                ids, width = np.frombuffer(batch["ids"][i].as_py(), np.int64), 8 * dims
                data = batch["matrix"][i].as_py()
                vector = pa.array([data[j * width : (j + 1) * width] for j in range(len(ids))], pa.binary())
                columns = [pa.array(np.full(len(ids), batch["shard"][i].as_py())), pa.array(np.full(len(ids), dims, np.int32)), pa.array(np.arange(len(ids))), pa.array(ids), vector]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "dims", "place", "vec_id", "vector"])

    queries = shards.mapInArrow(rows, "shard long, dims int, place long, vec_id long, vector binary").where(is_query)
    queries = stored(queries.withColumn("number", F.monotonically_increasing_id()), "queries")
    size = queries.agg(F.sum(F.octet_length("vector"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    found = None
    for chunk in range(chunks):
        part = _scan(shards, queries.where(F.pmod(F.xxhash64("number"), F.lit(chunks)) == chunk).collect(), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.join(queries.select("number", F.col("vec_id").alias("query_id")), "number").select("query_id", "rank", "vec_id", "score")
