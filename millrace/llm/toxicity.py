"""Toxicity by multiple-instance learning.

Labels say only whether a document is toxic. A sentence is a bag of hashed words and word beginnings with a logistic score p; a document's score is the
noisy-or of its sentences, 1 - prod(1 - p), and the word weights are fitted to the documents' labels through it. Sentence scores then show
where the offence is.

Fitting takes a bounded sample of labelled rows: `most`, half of each label, the smallest by a hash of the id, as far as `characters` of whole texts go for each label; rows that repeat
an id are one there. Scoring takes whole texts of all rows. Stretches without letters are no sentences, in fitting and in scoring. Null and empty texts have no sentence and score 0. Rows that
repeat get the same score. Without labelled rows of both kinds every score is 0 but for rounding. Ids may be of any integer type; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bounded, fold, release, slices, table, tidy

BITS = 18
SENTENCES = re.compile(r"[^.!?\n]+")
NOT_WORD = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")
MOST, CHARACTERS = 8_000, 20_000_000


def features(word: str, bits: int = BITS) -> tuple[int, int, int]:
    """Hashed features of a word: itself and its first four and five letters, which inflections share."""
    of = [word, word[:4] + "*" if len(word) > 4 else word, word[:5] + "*" if len(word) > 5 else word]
    return tuple(zlib.crc32(x.encode()) & ((1 << bits) - 1) for x in of)


def bare(stretch: str) -> str:
    """The letters of a stretch without white space, in lower case."""
    return NOT_WORD.sub("", stretch.lower())


def taught(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """doc_id and y, one label for each document of the folds that are learnt from."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), modulus) != held)).select("doc_id", F.col(label).cast("int").alias("y"))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def share_of(labels: DataFrame, label: str, modulus: int, held: int) -> float:
    """The share of label 1 among the documents that are learnt from."""
    kinds = {r[0]: r[1] for r in taught(labels, label, modulus, held).groupBy("y").count().collect()}
    return kinds.get(1, 0) / max(1, sum(kinds.values()))


def sampled(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, characters: int, more: tuple = ()) -> DataFrame:
    """doc_id, text, more columns and y of the rows to learn from: at most `most`, half for each label, so that joining them by broadcast is bounded, and `characters` of text for each label."""
    rows, few = taught(labels, label, modulus, held), None
    for value in (1, 0):
        part = rows.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        few = part if few is None else few.unionByName(part)
    of = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more).join(F.broadcast(few.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    one = of.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("text"), F.xxhash64("text")))).where("copy = 1")
    reach = F.sum(F.length("text").cast("long")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return one.withColumn("reach", reach).where(F.col("reach") <= characters).drop("copy", "reach")


def bags(sample: DataFrame) -> pa.Table:
    """For each sampled row (doc_id, y, words, sizes): the words' three features in one number each, and the sentences' numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(stretch: str) -> int:
            return sum(f << BITS * k for k, f in enumerate(features(w))) if (w := bare(stretch)) else -1

        memo = Bounded(packed)
        for batch in slices(batches):
            words, sizes = [], []
            for text in batch.column(1).to_pylist():
                found = [np.fromiter(map(memo.__getitem__, s.split()), np.int64) for s in SENTENCES.findall(text or "") if LETTER.search(s)]
                found = [s[s >= 0] for s in found]
                words.append(np.concatenate([*found, np.zeros(0, np.int64)]).tobytes())
                sizes.append(np.array([len(s) for s in found], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], names=["doc_id", "y", "words", "sizes"])

    return sample.select("doc_id", "text", "y").mapInArrow(tidy(run), "doc_id long, y int, words binary, sizes binary").toArrow()


def fit(rows: pa.Table, share: float | None = None, epochs: int = 80, rate: float = 0.7, sparse: float = 1.0, decay: float = 0.02, least: int = 3) -> tuple[np.ndarray, float]:
    """Feature weights and bias, by Adagrad with soft thresholds on the likelihood of the documents' labels under noisy-or.

    `share` is the share of toxic documents among all labelled ones outside the held-out fold; label 0 is weighted so that the sample has it too.
    """
    rows = rows.filter(pc.greater(pc.binary_length(rows["sizes"]), 0)).sort_by("doc_id").combine_chunks()
    weight, bias = np.zeros(1 << BITS), -6.0
    y = rows["y"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return weight, -np.inf
    cost = np.where(y > 0, 1.0, 1.0 if not share else (1 - share) / share * y.sum() / (len(y) - y.sum()))
    counts = pc.binary_length(rows["sizes"]).to_numpy() // 4
    sizes = np.frombuffer(b"".join(x.as_py() for x in rows["sizes"]), np.int32)
    coded = pa.array(np.frombuffer(b"".join(x.as_py() for x in rows["words"]), np.int64)).dictionary_encode()
    words, different = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    del rows, coded
    starts, firsts = (np.concatenate([[0], np.cumsum(x)[:-1]]) for x in (sizes, counts))
    owner = np.repeat(np.arange(len(y)), counts)
    of = (different[:, None] >> BITS * np.arange(3) & ((1 << BITS) - 1)).astype(np.int32)
    seen, reach = np.zeros(len(different)), [*starts[firsts].tolist(), len(words)]
    for a, b in zip(reach, reach[1:]):
        seen[np.unique(words[a:b])] += 1
    known = np.max([np.bincount(of[:, k], seen, 1 << BITS) for k in range(3)], axis=0) >= least
    squares, bias_square = np.full(1 << BITS, 10.0), 10.0
    for _ in range(epochs):
        z = np.clip(bias + np.add.reduceat(weight[of].sum(axis=1)[words], starts), -40, 40)
        q = np.exp(z)
        p = q / (1 + q)
        clean = np.exp(-np.add.reduceat(np.log1p(q), firsts))
        g = np.where(y[owner] > 0, p * (clean / np.maximum(1 - clean, 1e-9))[owner], -p) * cost[owner]
        each = np.bincount(words, np.repeat(g, sizes), len(different))
        grad = sum(np.bincount(of[:, k], each, 1 << BITS) for k in range(3)) * known - decay * weight
        squares += grad * grad
        step = rate / np.sqrt(squares)
        weight += step * grad
        weight = np.sign(weight) * np.maximum(np.abs(weight) - step * sparse, 0)
        bias_square += g.sum() ** 2
        bias += rate * g.sum() / np.sqrt(bias_square)
    return weight, float(bias)


def _scorer(model: tuple[np.ndarray, float]):
    """The function from a sentence to its logit, and the one from a text to its noisy-or score; pieces without letters count in neither."""
    from math import exp, expm1, log1p

    weight, bias = model[0].astype(np.float32), model[1]
    get, letter = Bounded(lambda x: float(weight[list(features(w))].sum()) if (w := bare(x)) else 0.0).__getitem__, LETTER.search

    def logit(sentence: str) -> float:
        return max(-40.0, min(40.0, bias + sum(map(get, sentence.split()))))

    def whole(text: str | None) -> float:
        return abs(expm1(-sum([log1p(exp(logit(s))) for s in SENTENCES.findall(text or "") if letter(s)])))

    return logit, whole


def score(documents: DataFrame, model: tuple[np.ndarray, float], cut: float = 0.5) -> DataFrame:
    """doc_id, score and the offending sentences (start, end, score), which are given where the document reaches `cut`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import exp

        logit, whole = _scorer(model)
        for batch in slices(batches):
            scores, found = [], []
            for text in batch.column(1).to_pylist():
                scores.append(p := whole(text))
                spans = []
                if p >= cut:
                    for m in SENTENCES.finditer(text):
                        if LETTER.search(m[0]) and (q := 1 / (1 + exp(-logit(m[0])))) >= cut / 2:
                            spans.append({"start": m.start(), "end": m.end(), "score": q})
                found.append(spans)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "offending"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>")


def clean(documents: DataFrame, model: tuple[np.ndarray, float], cut: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below `cut`."""
    where = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, whole = _scorer(model)
        for batch in slices(batches):
            yield batch.filter(pa.array([whole(t) < cut for t in batch.column(where).to_pylist()], pa.bool_()))

    return documents.mapInArrow(tidy(run), documents.schema)


def learn(documents: DataFrame, labels: DataFrame, most: int = MOST, characters: int = CHARACTERS) -> tuple[np.ndarray, float]:
    model = fit(bags(sampled(documents, labels, "toxic", 5, 0, most, characters)), share_of(labels, "toxic", 5, 0))
    release()
    return model


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents, learn(documents, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))
