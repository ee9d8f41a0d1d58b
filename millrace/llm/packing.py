"""Vector best-fit packing of tokenised documents into sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths). Pieces of one length are interchangeable, so the heuristic runs on the histogram of
lengths, at most one class for each length, whatever the number of documents: longest first, a class goes to
the kind of bin (same residual vector) that scores best among those in which every residual suffices, either by
the smallest weighted norm of what is left ("norm") or by the largest weighted dot product of demand and residual ("dot").
All bins of a kind are filled in one step. The finished plan says where the r-th piece of each length goes, so
executors place pieces on their own: a piece's rank is its place in its task plus what tasks before hold.

Null texts are empty: such a document is its end id alone. Repeated rows are packed each on its own.
An empty table gives an empty result. Documents longer than a sequence, and only these, are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, table, tidy, tokenizer_file, written
from .stretches import PLAIN, Codes, apart, gathered, numbered

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


class Tokenised:
    """Ids of whole texts by the tokenizers library, which is asked once for each different part of a batch that the worker hasn't met."""

    def __init__(self, path: str, memo: int = 160_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        library = Tokenizer.from_file(path)
        apart(library)
        library.no_truncation()
        library.no_padding()
        bare = Tokenizer(library.model)  # for words in lower case, which normalisers leave as they are and no pattern parts
        bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def ids(new: list[str]) -> Iterator[list[int]]:
            for at in range(0, len(new), 4096):  # an Encoding holds much more than its ids
                some = new[at : at + 4096]
                fine = pc.match_substring_regex(pa.array(some, pa.string()), f"^[{PLAIN}]+$").to_pylist()
                plain = iter(bare.encode_batch_fast([x.lower() for x, f in zip(some, fine) if f], add_special_tokens=False))  # without offsets, which are most of the work
                other = iter(library.encode_batch_fast([x for x, f in zip(some, fine) if not f], add_special_tokens=False))
                yield from [next(plain if f else other).ids for f in fine]

        self.codes = Codes(ids, memo)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(where each text's ids begin and end, the ids of all texts)."""
        ends, numbers, parts = numbered(texts)
        return gathered(ends, numbers, *self.codes.of(parts))


_LOADED: dict[str, Tokenised] = {}


def cut(documents: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of every document, with the task that made them and their place among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = Tokenised(vocabulary)
        tokenised, end = _LOADED[vocabulary], np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches, 1000, 3 << 19):
            ends, ids = tokenised.batch(batch.column(1))
            raw, ends = ids.astype("<u4").tobytes(), ends.tolist()
            out: list[list] = [[] for _ in range(6)]
            for doc, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                own = raw[4 * a : 4 * b] + end
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    piece = own[at : at + 4 * capacity]
                    n = len(piece) // 4
                    for column, value in zip(out, (doc, k, at // 4, n, zlib.crc32(piece), seen[n])):
                        column.append(value)
                    seen[n] += 1
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
            arrays.insert(5, pa.array([task] * len(out[0]), pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), PIECES)


def best_fit(histogram: dict[int, int], capacities: tuple[int, int, int], weights=(1.0, 1e-6, 1e-6), score: str = "norm") -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for the counts of each length: [(contents as [(length, copies)], number of such bins)].

    A length that exceeds a capacity even alone is refused, since cutting is the caller's.
    """
    capacity = np.array(capacities, float)
    weight = np.array(weights, float)
    left = np.empty((0, 3))
    count = np.empty(0, np.int64)
    inside: list[list[tuple[int, int]]] = []
    for length in sorted(histogram, reverse=True):
        todo, demand = histogram[length], np.array([length, 1, length * length], float)
        if (demand > capacity).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        new_left, new_count, new_inside = [], [], []
        while todo:
            fits = (left >= demand).all(axis=1) & (count > 0) if len(left) else np.zeros(0, bool)
            if fits.any():
                at = np.flatnonzero(fits)
                a, b = left[at] / capacity, demand / capacity
                value = ((a - b) ** 2 * weight).sum(axis=1) if score == "norm" else -(a * b * weight).sum(axis=1)
                k = at[int(np.argmin(value))]
                room, there, base = left[k], int(count[k]), inside[k]
            else:
                k, room, there, base = None, capacity, NEVER_ENDS, []
            copies = int(min(room // demand))
            full = min(there, todo // copies)
            for bins, each in ((full, copies), (1 if full < there and todo % copies and todo // copies == full else 0, todo % copies)):
                if bins:
                    new_left.append(room - each * demand)
                    new_count.append(bins)
                    new_inside.append([*base, (length, each)])
                    todo -= bins * each
                    if k is not None:
                        count[k] -= bins
        keep = np.flatnonzero(count > 0)
        left = np.vstack([left[keep], *new_left])
        count = np.concatenate([count[keep], np.array(new_count, np.int64)])
        inside = [inside[i] for i in keep] + new_inside
    return [(x, int(n)) for x, n in zip(inside, count)]


NEVER_ENDS = 1 << 62


def placements(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first bin, copies in a bin, offset) in order of rank."""
    rows: dict[int, list[list[int]]] = {}
    reach: dict[int, int] = {}
    first = 0
    for contents, n in bins:
        offset = 0
        for length, copies in contents:
            rows.setdefault(length, []).append([reach.get(length, 0), first, copies, offset])
            reach[length] = reach.get(length, 0) + n * copies
            offset += length * copies
        first += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(documents: DataFrame, vocabulary: str, tokens: int = 2048, most_documents: int | None = None, attention: int | None = None, weights=(1.0, 1e-6, 1e-6), score: str = "norm") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    most_documents and attention default to what any full sequence can reach, and so don't bind.
    """
    pieces = written(cut(documents, vocabulary, tokens), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `tokens` rows
    places = placements(best_fit(histogram, (tokens, most_documents or tokens, attention or tokens * tokens), weights, score))
    held = pieces.groupBy("task", "length").agg((F.max("place") + 1).alias("held"))
    before = held.select("task", "length", (F.sum("held").over(Window.partitionBy("length").orderBy("task")) - F.col("held")).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at, plan = np.flatnonzero(length == n), places[int(n)]
                row = plan[np.searchsorted(plan[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(5)], pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in schema.split(", ")])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(tidy(run), schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
