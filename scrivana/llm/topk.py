"""Exact top-k inner products by columnar branch and bound.

Queries are staged in blocks of bounded size, one folder each; one pass over the candidates meets them all: a task
holds some thousands of candidates and reads block after block of queries. So the driver sees no vector, and no task
holds more than one block of either side. Candidates are held in vertical layout (one row of numbers per dimension). Scores grow by one block of
dimensions at a time; what a pair can still gain is at most the product of the two vectors' remaining lengths,
and candidates that can no longer reach a query's k-th score are compacted away before the next block.

Components become floor(1024 * x), so scores are exact integers. Vectors that are null, or hold a null, NaN or
infinity, take no part, nor do rows without an id. Only vectors of equal dimension meet; rows with the query's
own id are never its candidates; rows that repeat an id are searched and found one by one. A score beyond the
range of a long is given as the nearest long. Fewer than k candidates are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivana.llm.common import Scratch, filesystem, parts_for

SCALE = 1024
DIMS = 16
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
#: Numbers of candidates that a task holds while all queries pass by, and blocks of queries it may keep from group to group.
HELD = 4 << 20
KEPT_BLOCKS = 4
EXACT = float(1 << 52)
LONG = (1 << 63) - 1


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and components of the rows that take part, as doubles."""
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


class QueryBlock:
    """Queries of one dimension: quantised, with the length of what each block of dimensions leaves over."""

    def __init__(self, numbers: list[int], ids: list[int], vectors: list[list[float]]):
        self.numbers, self.ids = np.array(numbers), np.array(ids, dtype=np.int64)
        self.q = np.floor(np.array(vectors, dtype=np.float64).reshape(len(ids), -1) * SCALE)
        self.rest = tails(self.q)
        self.top = float(np.abs(self.q).max(initial=0))


def tails(x: np.ndarray) -> np.ndarray:
    """Length of each row from every block's first dimension on; a last column of zeros."""
    squares = np.concatenate([np.add.reduceat(x * x, np.arange(0, x.shape[1], DIMS), axis=1), np.zeros((len(x), 1))], axis=1) if x.shape[1] else np.zeros((len(x), 1))
    return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])


class Best:
    """The k best so far of each query of a block."""

    def __init__(self, queries: QueryBlock, k: int):
        self.queries, self.k = queries, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in queries.ids]

    def least(self, i: int) -> float:
        return float(self.found[i][-1][0]) if len(self.found[i]) == self.k else -np.inf

    def offer(self, i: int, ids: np.ndarray, scores: list[int] | np.ndarray) -> None:
        if len(ids) > self.k and isinstance(scores, np.ndarray):
            near = np.argpartition(-scores, self.k - 1)
            kth = scores[near[self.k - 1]]
            near = np.flatnonzero(scores >= kth)
            ids, scores = ids[near], scores[near]
        merged = self.found[i] + [(int(s), int(v)) for s, v in zip(scores, ids)]
        merged.sort(key=lambda x: (-x[0], x[1]))
        self.found[i] = merged[: self.k]

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        c, q = np.floor(vectors * SCALE), self.queries.q
        dim = q.shape[1]
        if self.queries.top * float(np.abs(c).max(initial=0)) * max(dim, 1) >= EXACT:
            self._meet_large(ids, c)
            return
        rest, vertical = tails(c), np.ascontiguousarray(c.T)
        first = q[:, :DIMS] @ vertical[:DIMS] if dim else np.zeros((len(q), len(c)))
        for i in range(len(q)):
            alive, score, block = np.flatnonzero(ids != self.queries.ids[i]), None, 1
            score = first[i, alive]
            least = self.least(i)
            while block * DIMS < dim:
                gain = self.queries.rest[i, block] * rest[alive, block]
                keep = score + gain * (1 + 1e-9) + 1 >= least
                if not keep.all():
                    alive, score = alive[keep], score[keep]
                if not len(alive):
                    break
                a, b = block * DIMS, min(dim, (block + 1) * DIMS)
                part = vertical[a:b] if len(alive) == len(c) else vertical[a:b, alive]
                score = score + q[i, a:b] @ part
                block += 1
            if len(alive):
                keep = score >= least
                self.offer(i, ids[alive[keep]], score[keep])

    def _meet_large(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Numbers beyond what doubles add exactly: integers without a limit."""
        whole = [[int(x) for x in row] for row in c]
        for i, row in enumerate(self.queries.q):
            mine = [int(x) for x in row]
            for v, other in zip(ids, whole):
                if v != self.queries.ids[i]:
                    s = sum(a * b for a, b in zip(mine, other))
                    self.offer(i, np.array([v]), [max(-LONG - 1, min(LONG, s))])

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        for number, own, found in zip(self.queries.numbers, self.queries.ids, self.found):
            for score, v in found:
                yield int(number), int(own), v, score


def read_block(folder: str) -> list[QueryBlock]:
    """The queries of one staged block, by dimension."""
    import pyarrow.parquet as pq

    files, at = filesystem(folder)
    rows = pq.read_table(at, columns=["at", "id", "v"], filesystem=files)
    dims = np.diff(rows.column("v").combine_chunks().offsets.to_numpy()) if rows.num_rows else np.zeros(0, dtype=int)
    return [QueryBlock(*(rows.filter(pa.array(dims == d)).column(c).to_pylist() for c in ("at", "id", "v"))) for d in np.unique(dims)]


SEARCHED = pa.schema([("at", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def held_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Candidates in groups of some HELD numbers, by dimension: ids and vectors."""
    held: dict[int, list] = {}
    size = 0
    for batch in batches:
        lists = batch.column(1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        flat, dims, ids = lists.values.to_numpy(zero_copy_only=False), np.diff(ends), batch.column(0).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            held.setdefault(int(dim), []).append((ids[at], flat[ends[at][:, None] + np.arange(dim)]))
        size += len(flat) + len(ids)
        if size >= HELD:
            yield {d: tuple(map(np.concatenate, zip(*x))) for d, x in held.items()}
            held, size = {}, 0
    if held:
        yield {d: tuple(map(np.concatenate, zip(*x))) for d, x in held.items()}


def top_k(spark: SparkSession, rows: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every row for which ``queries`` holds."""
    scratch = scratch or Scratch(spark, "topk")
    # a number of its own for each query, so that equal rows stay apart and blocks even
    asked = scratch.put("asked", whole_vectors(rows.where(queries), key, vector).withColumn("at", F.monotonically_increasing_id()))
    n_blocks = parts_for(asked.count(), QUERY_BLOCK)
    folder = f"{scratch.root}/blocks"
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(n_blocks)))
    dealt.repartition(n_blocks, "block").write.partitionBy("block").parquet(folder)
    there = sorted(r[0] for r in dealt.select("block").distinct().collect())  # numbers only: some may have no query

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[QueryBlock]] = {}
        for group in held_candidates(batches):
            for block in there:
                own = kept.get(block) or read_block(f"{folder}/block={block}")
                if len(there) <= KEPT_BLOCKS:
                    kept[block] = own
                for q in own:
                    ids, vectors = group.get(q.q.shape[1], ((), ()))
                    best = Best(q, k)
                    for i in range(0, len(ids), CANDIDATE_BLOCK):
                        best.meet(ids[i : i + CANDIDATE_BLOCK], vectors[i : i + CANDIDATE_BLOCK])
                    found = list(best.rows())
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), SEARCHED.types)], schema=SEARCHED)

    found = scratch.put("found", whole_vectors(rows, key, vector).mapInArrow(search, "at long, query_id long, vec_id long, score long"))
    best = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
