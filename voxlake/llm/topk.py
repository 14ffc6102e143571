"""Exact top-k search by columnar branch and bound.

Vectors become whole numbers (floor(1024 * x)), so scores are exact. Candidates are dealt into parts and kept there in
vertical layout, dimension block by dimension block. A block of queries accumulates its products block by block; after every
block, the first one included, a candidate whose product so far plus the bound on the remaining mass (norm of the query's
rest times norm of the candidate's rest) is below the k-th best product that is already certain is dropped, and the
survivors are compacted. Every part gives its k best for each query; a second ranking merges the parts.

Queries meet each part of the candidates once, as a block: the stated query set goes against all rows, and a block of
queries has a fixed number of rows, so a task holds one part and one block whatever the table's size.

Defined results: scores must fit in 64 bits; vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros; rows without an id take no part; ties go to the smaller id; fewer candidates
than k give fewer rows; ids name rows, so rows that share a query's id are none of its candidates, and rows that repeat
another id are each a candidate; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Whole numbers up to this are exact in a double.
_EXACT = 1 << 53
_TOP = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """(components of all rows, ends of the rows, longest row)."""
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), sizes, int(sizes.max(initial=0))


def _matrix(values: np.ndarray, sizes: np.ndarray, dims: int) -> np.ndarray:
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def best_of_part(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int, together: int = 256) -> list[np.ndarray]:
    """The k best candidates of one part for each query: (query id, id, score) columns.

    Dimensions are taken by falling mass, `block` at a time. The first block is multiplied for `together` queries at once; the
    candidates that it ranks first are then scored whole, and the k-th best of their scores is certain: what cannot reach it
    is dropped after this block and after every other.
    """
    order = np.argsort(ids, kind="stable")
    ids, columns = ids[order], vectors[order].T
    dims, n = columns.shape
    largest = int(np.abs(columns).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(dims, 1)
    kind = np.float64 if largest < _EXACT else np.int64
    heavy = np.argsort(-(columns.astype(np.float64) ** 2).sum(1), kind="stable")
    columns, queries = np.ascontiguousarray(columns[heavy]).astype(kind), np.ascontiguousarray(queries[:, heavy]).astype(kind)
    cuts = [*range(0, dims, block), dims]
    square = lambda x: x.astype(np.float64) ** 2
    rests = [np.sqrt(square(columns[c:]).sum(0)) for c in cuts]
    query_rests = [np.sqrt(square(queries[:, c:]).sum(1)) for c in cuts]
    first = cuts[1] if dims else 0
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(queries), together):
        heads = queries[at : at + together, :first] @ columns[:first]
        for q, sums in enumerate(heads, at):
            alive = np.flatnonzero(ids != query_ids[q])
            sums = sums[alive]
            sure = -np.inf
            if len(alive) > 4 * k:
                likely = np.argpartition(sums, len(alive) - 2 * k)[-2 * k :]
                whole = sums[likely] + queries[q, first:] @ columns[first:, alive[likely]]
                sure = np.partition(whole, k)[k]
            for b in range(1, len(cuts) - 1):
                stays = sums + rests[b][alive] * query_rests[b][q] * (1 + 1e-9) + 1 >= sure
                alive, sums = alive[stays], sums[stays]
                sums = sums + queries[q, cuts[b] : cuts[b + 1]] @ columns[cuts[b] : cuts[b + 1], alive]
            best = np.lexsort((ids[alive], -sums))[:k]
            for column, values in zip(out, (np.full(len(best), query_ids[q]), ids[alive[best]], sums[best].astype(np.int64))):
                column.append(values)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]


def _search(k: int, block: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _TOP.empty_table()
        (queries, many, a), (vectors, sizes, b) = _vectors(left), _vectors(right)
        dims = max(a, b)
        query_ids, ids = (t.column("id").to_numpy() for t in (left, right))
        found = best_of_part(_matrix(queries, many, dims), query_ids, _matrix(vectors, sizes, dims), ids, k, block)
        return pa.table([pa.array(c, pa.int64()) for c in found], schema=_TOP)

    return search


def exact_top_k(vectors: DataFrame, queries_where: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, part_rows: int = 8192, query_rows: int = 32768, block: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with every other row.

    queries_where: SQL predicate on `id` that states the query set. part_rows, query_rows: rows of a part and of a block of
    queries, about, fewer where vectors are longer than 64; both are numbers of rows in a task, not limits on what is
    searched. Every vector is sent once for each block of queries, every query once for each part.
    """
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    queries = rows.where(queries_where)
    n, m, dims = rows.agg(F.count("*"), F.count_if(F.expr(queries_where)), F.max(F.size("v"))).first()
    wide = max(1.0, (dims or 0) / 64)
    parts, blocks = max(1, math.ceil(n * wide / part_rows)), max(1, math.ceil(m * wide / query_rows))
    dealt = lambda c, number: F.pmod(F.xxhash64(c), F.lit(number)).cast("int")
    left = queries.withColumn("block", dealt("id", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("part", dealt("id", parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_search(k, block), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
