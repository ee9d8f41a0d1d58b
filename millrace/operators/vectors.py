"""Exact vector search by cosine, as one lazy plan: filter, score, threshold, top k."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class VectorError(ValueError):
    pass


def cosine(column: Column, query: Sequence[float]) -> Column:
    """Cosine of an array column with a vector, in doubles; 0 where the row's vector is zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = column.cast("array<double>")
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), zero, lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, zero, lambda s, x: s + x * x))
    return F.when(norm > 0, dot / (norm * float(sum(float(x) ** 2 for x in query) ** 0.5))).otherwise(0.0)


def comparable(column: Column, dim: int) -> Column:
    """Vectors of the right length with finite components."""
    return (F.size(column) == dim) & F.forall(column.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def search(rows: DataFrame, column: str, query: Sequence[float], allowed: Column | None = None, min_score: float | None = None, limit: int = 10, offset: int = 0, id_column: str = "id") -> DataFrame:
    """The rows of the page with _score, best first, ties by id. Vectors that are null or can't be compared take no part; skipped() counts the latter.

    Only the id and the vector are read for ranking; the page's rows are joined to their other columns afterwards.
    """
    query = [float(x) for x in query]
    if not query or not all(map(isfinite, query)) or not any(query):
        raise VectorError("the query vector must be finite and not zero")
    if not 1 <= limit <= 200 or offset < 0:
        raise VectorError("limit is 1 to 200, offset not negative")
    source = rows if allowed is None else rows.where(allowed)
    scored = source.where(F.col(column).isNotNull() & comparable(F.col(column), len(query))).select(id_column, cosine(F.col(column), query).alias("_score"))
    if min_score is not None:
        scored = scored.where(F.col("_score") >= float(min_score))
    ordered = scored.orderBy(F.desc("_score"), id_column)
    top = (ordered.offset(offset) if offset else ordered).limit(limit)
    return rows.join(F.broadcast(top), id_column).orderBy(F.desc("_score"), id_column)  # at most 200 rows


def skipped(rows: DataFrame, column: str, dim: int, allowed: Column | None = None) -> int:
    source = rows if allowed is None else rows.where(allowed)
    return source.where(F.col(column).isNotNull() & ~comparable(F.col(column), dim)).count()
