"""Embedding near-dedup by randomised-rotation binary codes.

Equal vectors of a label are one row with a count, coded once. Each row has several keys, each of some bits of its rotated sign codes; rows
that share a label and a key meet, in one shuffle. Their packed codes and correction factors give an unbiased estimate and a confidence bound of each cosine: pairs
whose upper bound is below the threshold are left, all others are recomputed in double precision. Two vectors at the threshold share no
key with a probability of `miss` / rows, which the number of keys follows from: of a table whose vectors have a link at the threshold each, `miss` links are lost.

Keys with more rows than a block are counted first and split into tiles, pairs of bounded blocks, so a group of any size is spread over tasks. A tile gives one row for each vector: how many
linked vectors it has there (a pair counts under the first key that it shares) and the smallest id it is linked with, never the pairs themselves.

Vectors that are null, zero, or hold null or non-finite components, or whose label is null, link with nothing; lengths are never mixed. Rows with a null id are dropped.
Repeated rows (same id) count as vectors of their own in n_links and give a row each; where an id has different vectors, each of its rows has the links of all of them and one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StructType

from . import rabitq
from .common import MOST_IDS, table, tidy, written
from .components import components
from .neighbours import groups, usable


def shape(n: int, largest: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a key and number of keys for n rows. Only rows of a label meet, so the bits follow from the rows of the largest one: about 64 of them share a key by chance."""
    bits = min(20, max(6, ceil(log2(max(largest, 2) / 64))))
    same = 1 - acos(threshold) / pi
    return bits, ceil(log(miss / max(n, 1)) / log(1 - same**bits))


def keyed(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """Each row with its code, its factor and its keys, an array of `tables` numbers from disjoint bits of as many rotations as are needed."""
    kind, width = (ShortType(), pa.int16()) if bits < 16 else (IntegerType(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, dim, unit in rabitq.by_dim(batches):
            signs, seed = [], 1
            while sum(c.shape[1] for c in signs) < bits * tables:
                signs.append((unit.astype(np.float32) @ rabitq.rotation(dim, seed).T) > 0)
                seed += 1
            sign = np.concatenate(signs, axis=1)[:, : bits * tables].reshape(len(unit), tables, bits)
            keys = sign @ (1 << np.arange(bits, dtype=np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel(), width))
            code, factor = rabitq.encode(unit)
            yield pa.RecordBatch.from_arrays([*some.columns, rabitq.binary(code), pa.array(factor, pa.float64()), flat], names=[*some.schema.names, "code", "factor", "keys"])

    some = rows.select("vec_id", "label", "dim", "v", "n")
    return some.mapInArrow(tidy(run), StructType(list(some.schema)).add("code", "binary").add("factor", "double").add("keys", ArrayType(kind)))


def _tile(table: int, first: bool, side, ids, n, keys, v, code, factor, threshold: float):
    """(id, linked, root) of the rows of one tile that are linked in it; side 0 meets side 1, or itself in a tile of one block."""
    left = np.flatnonzero(side == 0)
    right = left if first else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return None
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    bits, factors = code[right], factor[right]
    a, b = [], []
    for at in range(0, len(left), 512):
        some = left[at : at + 512]
        guess, bound = rabitq.estimate(unit[some], bits, factors)
        i, j = np.nonzero(guess + bound >= threshold)
        i, j = some[i], right[j]
        keep = i < j if first else slice(None)
        i, j = i[keep], j[keep]
        for s in range(0, len(i), 65536):
            x, y = i[s : s + 65536], j[s : s + 65536]
            near = (unit[x] * unit[y]).sum(axis=1) >= threshold
            a.append(x[near])
            b.append(y[near])
    if not a:
        return None
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return None
    new = ~(keys[a, :table] == keys[b, :table]).any(axis=1) if table else np.ones(len(a), bool)
    linked = np.bincount(a[new], n[b[new]], len(ids)) + np.bincount(b[new], n[a[new]], len(ids))
    order = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    low = order.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, before[a])
        if (low == before).all():
            break
    root = np.argsort(order)[low]
    got = np.unique(np.concatenate([a, b]))
    return ids[got], linked[got].astype(np.int64), ids[root[got]]


def links(rows: DataFrame, threshold: float = 0.93, miss: float = 1e-3, block: int = 1024) -> DataFrame:
    """vec_id, linked, root: partial results of tiles over rows (vec_id, label, dim, v, n)."""
    sizes = rows.groupBy("label", "dim").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    bits, tables = shape(*sizes, threshold, miss)
    each = written(keyed(rows, bits, tables), "codes").select("*", F.posexplode("keys").alias("table", "key"))
    of = ["label", "dim", "table", "key"]
    split = written(each.groupBy(of).agg(F.count("*").alias("size")).where(F.col("size") > block).select(*of, F.ceil(F.col("size") / block).cast("int").alias("blocks")), "split")
    met = each.join(F.broadcast(split) if split.count() <= MOST_IDS else split, of, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = met.withColumn("other", other).select(
        *of, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "vec_id", "n", "keys", "v", "code", "factor"
    )
    dealt = tiles.repartition("label", "dim", "table", "key", "i", "j").sortWithinPartitions("label", "dim", "table", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        for key, (side, ids, n, keys, v, code, factor) in groups(batches, 6, alone=False):
            got = _tile(int(key[2]), key[4] == key[5], side, ids, n, keys.astype(np.int64), v, rabitq.packed(code), factor, threshold)
            if got is not None:
                for column, x in zip(out, got):
                    column.append(x)
                if len(out[0]) >= 200:
                    yield _rows(out)
                    out = [[], [], []]
        if out[0]:
            yield _rows(out)

    return dealt.mapInArrow(tidy(run), "vec_id long, linked long, root long")


def _rows(out):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["vec_id", "linked", "root"])


def dedup(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = 0.93, miss: float = 1e-3) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row with an id."""
    fine = usable(vectors, id_column, vector_column, F.col(label_column).cast("long").alias("label")).where(F.col("label").isNotNull())
    same = written(fine.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "vectors")
    found = written(links(same, threshold, miss), "links")
    near = found.groupBy("vec_id").agg(F.sum("linked").alias("linked"))
    classes = components(found.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    heads = same.join(near, "vec_id", "left").join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("label", "dim", "v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    known = fine.join(heads, ["label", "dim", "v"]).select("vec_id", "n_links", "component_id")
    others = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("raw"), F.col(label_column).cast("long").alias("label")).where(F.col("vec_id").isNotNull())
    v = F.col("raw").cast("array<double>")
    takes_part = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    alone = others.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, by a plain join.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(max(k.n), 0) AS n_links, min(r.c) AS component_id, v.vec_id = min(r.c) AS kept FROM v JOIN r ON r.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id GROUP BY v.vec_id
"""
