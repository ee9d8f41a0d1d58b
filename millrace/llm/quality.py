"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is taken in linear time as
half the sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2. Words are hashed, with square roots of their counts scaled to unit
length; statistics are standardised and also enter as one-hot bins between quantiles; metadata columns are numbers and count as statistics, with an
indicator where they are null.

Fitting takes a bounded sample of labelled rows: `most`, half of each label, the smallest by a hash of the id, as far as `characters` of whole texts go for each label; rows that repeat an id
are one there. Scoring takes whole texts of all rows. Ids may be of any integer type. Null texts are empty; an empty text is scored by its statistics. Repeated rows get the same score. Without labelled rows of both kinds every score is the share of label 1, or 0.5 without labels.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, fold, release, slices, table, tidy
from .toxicity import NOT_WORD, sampled, share_of

BITS, FACTORS, BINS = 16, 8, 12
MOST, CHARACTERS = 10_000, 25_000_000

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence end, 5 other punctuation, 6 blank, 7 line feed, 8 beyond ASCII
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in b".!?":
    _CLASS[_c] = 4
for _c in b"\"#$%&'()*+,-/:;<=>@[\\]^_`{|}~":
    _CLASS[_c] = 5
for _c in b" \t\r":
    _CLASS[_c] = 6
_CLASS[10] = 7
_CLASS[128:] = 8


def hashed(stretch: str) -> int:
    return zlib.crc32((NOT_WORD.sub("", stretch.lower()) or stretch[:8]).encode()) & ((1 << BITS) - 1)


def features(text: str | None, memo: Bounded) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed words, their values, and structure statistics of one whole text."""
    text = text or ""
    stretches = text.split()
    n = len(stretches)
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=9) / max(1, len(raw))
    counts = Counter(stretches)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(stretches, stretches[1:])))
    most = max(counts.values(), default=0)
    long = sum(c for s, c in counts.items() if len(s) > 20)
    single = sum(c for s, c in counts.items() if len(s) == 1)
    stats = [np.log1p(len(text)), np.log1p(n), np.log1p(len(lines)), len(text) / max(1, n), *kinds, len(counts) / max(1, n), pairs / max(1, n - 1), most / max(1, n), long / max(1, n), single / max(1, n), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), np.log1p(max(map(len, lines), default=0))]
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), stats
    of: dict[int, int] = {}
    for s, c in counts.items():
        i = memo[s]
        of[i] = of.get(i, 0) + c
    ids, values = np.fromiter(of.keys(), np.int32, len(of)), np.sqrt(np.fromiter(of.values(), np.float32, len(of)))
    return ids, values / np.sqrt((values * values).sum()), stats


def _columns(documents: DataFrame, metadata: list[str]):
    return [F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(m).cast("double").alias(m) for m in metadata]]


def _with_metadata(stats: list[float], values: tuple) -> list[float]:
    return stats + [x for v in values for x in ((0.0, 1.0) if v is None or v != v else (float(np.sign(v) * np.log1p(abs(v))), 0.0))]


def examples(sample: DataFrame, metadata: list[str]) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Bounded(hashed)
        for batch in slices(batches):
            out: list[list] = [[], [], []]
            for _, text, _, *meta in zip(*[c.to_pylist() for c in batch.columns]):
                ids, values, stats = features(text, memo)
                for column, x in zip(out, (ids.tobytes(), values.tobytes(), np.array(_with_metadata(stats, meta)).tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(x, pa.binary()) for x in out]], names=["doc_id", "y", "ids", "x", "stats"])

    return sample.mapInArrow(tidy(run), "doc_id long, y int, ids binary, x binary, stats binary").collect()


class Machine:
    """Weights: w0, w and V for hashed words, one-hot bins of statistics and standardised statistics, in one index space."""

    def __init__(self, edges: np.ndarray, mean: np.ndarray, spread: np.ndarray, seed: int = 7):
        self.edges, self.mean, self.spread = edges, mean, spread
        n = len(mean)
        self.bins, self.dense = 1 << BITS, (1 << BITS) + n * (BINS + 1)
        size = self.dense + n
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.03, (size, FACTORS)).astype(np.float32)

    def row(self, ids: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.mean)
        place = (self.edges <= stats[:, None]).sum(axis=1)
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) * 0.25
        return (
            np.concatenate([ids, self.bins + np.arange(n) * (BINS + 1) + place, self.dense + np.arange(n)]),
            np.concatenate([values, np.full(n, 0.3), scaled]).astype(np.float32),
        )

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        z = self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
        return z, sums, vx


def fit(rows: list, share: float | None = None, epochs: int = 10, batch: int = 250, rate: float = 0.08, decay: float = 2e-5, least: int = 3) -> Machine | float:
    """By Adagrad on the logistic loss over batches in a fixed random order, label 0 weighted to its share among the labels of the folds learnt from. A number, the share of label 1, where only one label or none is there."""
    rows = sorted(rows, key=lambda r: r[0])
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    stats = np.stack([np.frombuffer(r[4]) for r in rows])
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    m = Machine(edges, stats.mean(axis=0), stats.std(axis=0) + 1e-6)
    cost = np.where(y > 0, 1.0, 1.0 if not share else (1 - share) / share * y.sum() / (len(y) - y.sum())).astype(np.float32)
    cost /= cost.mean()
    m.w0 = float(np.log((y * cost).sum() / ((1 - y) * cost).sum()))
    got = [m.row(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32), s) for r, s in zip(rows, stats)]
    known = np.bincount(np.concatenate([g[0] for g in got]), minlength=len(m.w)) >= least
    known[m.bins :] = True
    m.v[~known] = 0
    gw, gv, g0 = np.full(len(m.w), 1e-4, np.float32), np.full(m.v.shape, 1e-4, np.float32), 1e-4
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = order[at : at + batch]
            index, value = (np.concatenate([got[i][k] for i in some]) for k in (0, 1))
            sizes = np.array([len(got[i][0]) for i in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            z, sums, vx = m.logits(index, value, starts)
            error = (1 / (1 + np.exp(-z)) - y[some]) * cost[some] / len(some)
            of = np.repeat(np.arange(len(some)), sizes)
            touched, inverse = np.unique(index, return_inverse=True)
            e = error[of] * value
            mask = known[touched]
            dw = (np.bincount(inverse, e, len(touched)) + decay * m.w[touched]) * mask
            dv = np.stack([np.bincount(inverse, e * (sums[of, f] - vx[:, f]), len(touched)) for f in range(FACTORS)], axis=1)
            dv = (dv + decay * m.v[touched]) * mask[:, None]
            gw[touched] += dw**2
            gv[touched] += dv**2
            m.w[touched] -= rate * dw / np.sqrt(gw[touched])
            m.v[touched] -= rate * 0.5 * dv / np.sqrt(gv[touched])
            g0 += float(error.sum()) ** 2
            m.w0 -= rate * float(error.sum()) / g0**0.5
    return m


def score(documents: DataFrame, model: Machine | float, metadata: list[str]) -> DataFrame:
    """doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Bounded(hashed)
        for batch in slices(batches, 500):
            if isinstance(model, float):
                out = np.full(batch.num_rows, model)
            else:
                rows = []
                for _, text, *meta in zip(*[c.to_pylist() for c in batch.columns]):
                    ids, values, stats = features(text, memo)
                    rows.append(model.row(ids, values, np.array(_with_metadata(stats, meta))))
                sizes = np.array([len(r[0]) for r in rows])
                z, _, _ = model.logits(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                out = 1 / (1 + np.exp(-z.astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return documents.select(*_columns(documents, metadata)).mapInArrow(tidy(run), "doc_id long, score double")


def learn(documents: DataFrame, labels: DataFrame, metadata: list[str], most: int = MOST, characters: int = CHARACTERS) -> Machine | float:
    rows = sampled(documents, labels, "quality", 4, 2, most, characters, tuple(F.col(m).cast("double").alias(m) for m in metadata))
    model = fit(examples(rows.select("doc_id", "text", "y", *metadata), metadata), share_of(labels, "quality", 4, 2))
    release()
    return model


def op7_quality(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents, learn(documents, labels, ["n_chars"]), ["n_chars"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
