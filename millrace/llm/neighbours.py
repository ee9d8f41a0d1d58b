"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Each row is coded once. Rows and queries are dealt into blocks of bounded size, and each pair of blocks is one task's unit of work: packed bits and factors give an estimate
and an error bound for each pair; the exact products of the best estimates set a threshold, and every row whose
upper bound reaches it is ranked by its exact product. The best of all blocks are merged for each query. Vectors stay in the type they are stored in until a task computes with them, in doubles.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of different lengths aren't compared. Ties go to the smaller id.
Rows that repeat an id are rows of their own, but a query's own id is never its neighbour. Without candidates a query has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from . import rabitq
from .common import table, tidy

FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, id_column: str, vector_column: str, *more: Column) -> DataFrame:
    """vec_id, v (floats where they are stored so, else doubles), dim, of the rows that take part."""
    kind = rows.schema[vector_column].dataType
    v = F.col(vector_column).cast("array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>")
    fine = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), *more).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return fine.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def coded(rows: DataFrame) -> DataFrame:
    """The rows (of usable()) with the packed code and the factor of each v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, unit in rabitq.by_dim(batches):
            bits, factors = rabitq.encode(unit)
            yield pa.RecordBatch.from_arrays([*some.columns, rabitq.binary(bits), pa.array(factors, pa.float64())], names=[*some.schema.names, "code", "factor"])

    return rows.mapInArrow(tidy(run), StructType(list(rows.schema)).add("code", "binary").add("factor", "double"))


def _block(query_ids, queries, ids, base, bits, factors, k: int):
    """(query, row, exact score) of the candidates that can be among the k best in this block."""
    norms, lengths = np.linalg.norm(base, axis=1), np.linalg.norm(queries, axis=1)
    for at in range(0, len(queries), 256):
        q, qn = queries[at : at + 256], lengths[at : at + 256]
        guess, bound = rabitq.estimate(q / qn[:, None], bits, factors)
        guess, margin = guess * norms, bound * norms  # in units of the query's length
        own = query_ids[at : at + 256, None] == ids[None, :]
        guess[own] = -np.inf
        first = min(2 * k, guess.shape[1])
        for i in range(len(q)):
            top = np.argpartition(-guess[i], first - 1)[:first]
            exact = base[top] @ q[i]
            exact[own[i, top]] = -np.inf
            floor = np.sort(exact)[::-1][min(k, first) - 1]
            some = np.flatnonzero((guess[i] + margin) * qn[i] >= floor)
            some = some[~own[i, some]]
            score = (base[some] * q[i]).sum(axis=1)
            keep = np.lexsort((ids[some], -score))[:k]
            yield query_ids[at + i], ids[some[keep]], score[keep]


def search(queries: DataFrame, rows: DataFrame, k: int = 20, block: int = 8192, query_block: int = 2048) -> DataFrame:
    """The k best rows of each query: query_id, rank, vec_id, score. Both come from usable()."""
    n, m = rows.count(), queries.count()
    blocks, query_blocks = max(1, ceil(n / block)), max(1, ceil(m / query_block))
    left = coded(queries.select("vec_id", "v", "dim")).select(F.col("vec_id").alias("id"), "v", "dim", "code", "factor", (F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks))).cast("int").alias("qb"))
    left = left.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(0))
    right = coded(rows.select("vec_id", "v", "dim")).select(F.col("vec_id").alias("id"), "v", "dim", "code", "factor", (F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).cast("int").alias("rb"))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("side", F.lit(1))
    units = blocks * query_blocks
    columns = ["qb", "rb", "dim", "side", "id", "v", "code", "factor"]
    both = left.select(columns).unionByName(right.select(columns))
    dealt = both.repartitionByRange(min(units, 4096), "qb", "rb", "dim").sortWithinPartitions("qb", "rb", "dim", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, ids, v, code, factor) in groups(batches, 3):
            query, base = side == 0, side == 1
            if query.any() and base.any():
                out = list(_block(ids[query], v[query], ids[base], v[base], rabitq.packed(code[base]), factor[base], k))
                counts = [len(x[1]) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], counts)), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(tidy(run), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def groups(batches: Iterator[pa.RecordBatch], keys: int, alone: bool = True):
    """The key and the other columns' arrays of each run of rows with equal values in the first `keys` columns; list columns become matrices, binary ones arrays of their values, which may differ in length. Only one run is held at a time.
    Without `alone`, runs of one row are left out."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts, ends = np.append(0, change), np.append(change, batch.num_rows)
        if not alone:  # the first run may go on from the last batch, the last run in the next one
            some = ends - starts > 1
            some[[0, -1]] = True
            starts, ends = starts[some], ends[some]
        for a, b in zip(starts.tolist(), ends.tolist()):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                if alone or len(held) > 1 or held[0].num_rows > 1:
                    yield last, _joined(held, keys)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held and (alone or len(held) > 1 or held[0].num_rows > 1):
        yield last, _joined(held, keys)


def _joined(held: list[pa.RecordBatch], keys: int) -> list[np.ndarray]:
    rows = pa.Table.from_batches(held).combine_chunks()
    out = []
    for c in rows.columns[keys:]:
        c = c.chunk(0) if c.num_chunks else c.combine_chunks()
        out.append(rabitq.vectors(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False))
    return out


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows.where(F.col("vec_id") % 20 == 0), rows)
