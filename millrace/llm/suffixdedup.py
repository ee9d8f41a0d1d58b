"""Exact removal of repeated substrings over a corpus, by suffix order.

A byte goes if a `width`-byte string that also starts earlier (smaller doc_id, or same document and earlier start) covers it; strings are judged on the input, and never
cross documents.

1. Each window of `width` bytes has the smallest hashed k-gram in it as its anchor (ties: the leftmost). Runs of windows with the same anchor place are records (anchor, hash of the
   run's bytes, document, start, windows). Equal windows have equal anchors, and the windows of one record differ from each other. Records of equal bytes are repeats of the first of
   them in all their windows; a task leaves out its own repeats before the shuffle by anchor.
2. Records that are the first of their bytes, at an anchor that other bytes have too, may hold windows that others hold at another place. Their bytes are read again and their suffixes ordered by
   linear grouping (lyndon.py), over symbols that end with a blank and rank as their bytes do. Windows that agree up to their first blank and whose rests are neighbours in this order
   with enough common bytes are equal; all but the first of them are repeats.
3. Anchors with over `heavy` different records (a frequent line of less than a window) aren't ordered in one task: their windows are grouped by digest, which has no group to gather.

Null texts are empty. Texts shorter than a window lose nothing. Rows that repeat an id are taken for one document, and each gives its row. Rows with a null id come before and after nothing: removed() drops them, without_repeats() keeps them as they are.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, tidy, unused, written
from .lyndon import suffix_order

GRAM, SEGMENT = 32, 1 << 18
HEAVY = 2000
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values for bytes, powers of the base and of its inverse modulo 2^64."""
    table = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=U)
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.empty(4 * SEGMENT, U)
        x[0] = 1
        np.multiply.accumulate(np.full(len(x) - 1, U(base)), out=x[1:])
        out.append(x)
    return table, *out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _prefix(raw: np.ndarray) -> np.ndarray:
    table, power, _ = _powers()
    return np.concatenate([np.zeros(1, U), np.cumsum(table[raw] * power[: len(raw)], dtype=U)])


def anchors(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int):
    """Records (text number, start in it, windows, anchor, hash of the bytes) of texts that stand one after another in raw."""
    table, power, inverse = _powers()
    none = np.zeros(0, np.int64)
    fine = lengths >= width
    if not fine.any():
        return none, none, none, none.view(U), none.view(U)
    h, size = table[raw], 1
    gram = min(GRAM, 1 << ((width // 2).bit_length() - 1))
    while size < gram:
        h = h[:-size] * power[size] + h[size:]
        size *= 2
    v = _mixed(h)
    low = U(0xFFFFFF)
    m, size, grams = (v & ~low) | np.arange(len(v), dtype=U), 1, width - gram + 1
    while size * 2 <= grams:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = grams - size
    m = np.minimum(m[: len(m) - rest], m[rest:])
    change = np.ones(len(m) + 1, bool)
    change[1:-1] = m[1:] != m[:-1]
    change[starts[fine]] = True
    change[starts[fine] + lengths[fine] - width + 1] = True
    at = np.flatnonzero(change)
    text = np.searchsorted(starts, at, "right") - 1
    end = np.append(at[1:], len(m))
    keep = at < starts[text] + lengths[text] - width + 1
    at, end, text = at[keep], end[keep], text[keep]
    anchor = v[(m[at] & low).astype(np.int64)]
    sums = _prefix(raw)
    own = (sums[end - 1 + width] - sums[at]) * inverse[at]
    return text, at - starts[text], end - at, anchor, _mixed(own + (end - at).astype(U) * U(0x632BE59BD9B4E019)) ^ anchor


def _parts(ids: list, texts: list[bytes], width: int):
    """(ids, offsets, raw, starts, lengths) of texts joined up to a bounded size; long texts in segments that overlap by width - 1 bytes."""
    held, size = [], 0
    for doc, text in zip(ids, texts):
        for at in range(0, max(1, len(text) - width + 1), SEGMENT):
            part = text[at : at + SEGMENT + width - 1]
            if len(part) >= width:
                held.append((doc, at, part))
                size += len(part)
            if size >= SEGMENT:
                yield _one(held)
                held, size = [], 0
    if held:
        yield _one(held)


def _one(held):
    lengths = np.array([len(p) for _, _, p in held], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.array([d for d, _, _ in held], np.int64), np.array([a for _, a, _ in held], np.int64), np.frombuffer(b"".join([p for _, _, p in held]), np.uint8), starts, lengths


RECORD = "anchor long, bytes long, doc_id long, at long, windows int, kind int"
FIRST, REPEAT, OPEN = 0, 1, 2


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.int32()) for c, k in zip(columns, kinds)], names=list(names))


def records(documents: DataFrame, width: int) -> DataFrame:
    """The task's first record for each bytes (FIRST); repeats in the same task as REPEAT, at an anchor of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, 4 << 20):
            ids = batch.column(0).to_numpy()
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            order = np.argsort(ids, kind="stable")
            got = []
            for owner, offset, raw, starts, lengths in _parts([ids[k] for k in order], [texts[k] for k in order], width):
                text, at, n, anchor, own = anchors(raw, starts, lengths, width)
                got.append((owner[text], at + offset[text], n, anchor, own))
            if not got:
                continue
            doc, at, n, anchor, own = (np.concatenate(x) for x in zip(*got))
            _, first, back = np.unique(own, return_index=True, return_inverse=True)
            lead = first[back]
            kind = np.where((doc == doc[lead]) & (at == at[lead]), FIRST, REPEAT)
            kind[lead[kind == FIRST]] = FIRST
            keep = (kind == REPEAT) | (np.arange(len(doc)) == lead)
            key = np.where(kind == REPEAT, _mixed(own + doc.astype(U) * U(_BASE) + at.astype(U)), anchor)
            if keep.any():
                yield _batch(RECORD, key[keep].view(np.int64), np.where(kind == REPEAT, 0, own.view(np.int64))[keep], doc[keep], at[keep], n[keep], kind[keep])

    return documents.mapInArrow(tidy(run), RECORD)


def resolved(dealt: DataFrame) -> DataFrame:
    """Of records in order of anchor, bytes, doc_id and at: the repeats, and the first ones of bytes whose anchor has other bytes too (OPEN)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # anchor, bytes, doc_id and at of the leader that the last record had
        many = False  # whether the last anchor has had two leaders
        waiting = None  # its leader, while it has had only one
        for batch in batches:
            anchor, own, doc, at, n, kind = (c.to_numpy() for c in batch.columns)
            done = kind == REPEAT
            if done.any():
                yield _batch(RECORD, *(x[done] for x in (anchor, own, doc, at, n, kind)))
            anchor, own, doc, at, n = (x[~done] for x in (anchor, own, doc, at, n))
            if not len(anchor):
                continue
            new_anchor, new_own = (np.concatenate([[True], x[1:] != x[:-1]]) for x in (anchor, own))
            goes_on = last is not None and last[0] == anchor[0]
            if goes_on:
                new_anchor[0], new_own[0] = False, last[1] != own[0]
            new_own |= new_anchor
            lead = np.maximum.accumulate(np.where(new_own, np.arange(len(anchor)), -1))
            lead_doc, lead_at = (np.where(lead >= 0, x[lead], last[k] if last else 0) for x, k in ((doc, 2), (at, 3)))
            repeat = ~new_own & ((doc != lead_doc) | (at != lead_at))
            group = np.cumsum(new_anchor)  # 0 while the last batch's anchor goes on
            leaders = np.bincount(group, new_own, group[-1] + 1)
            shared = leaders > 1
            shared[0] = goes_on and (many or leaders[0] > 0)
            if waiting is not None and shared[0]:
                yield _batch(RECORD, *[np.array([x]) for x in waiting], np.array([OPEN]))
            if shared[0] or group[-1]:
                waiting = None
            many = bool(shared[group[-1]])
            if group[-1] and not many:
                k = np.flatnonzero(new_anchor)[-1]
                waiting = (anchor[k], own[k], doc[k], at[k], n[k])
            opened = new_own & shared[group]
            some = repeat | opened
            yield _batch(RECORD, anchor[some], own[some], doc[some], at[some], n[some], np.where(opened, OPEN, REPEAT)[some])
            last = (anchor[-1], own[-1], lead_doc[-1], lead_at[-1])

    return dealt.mapInArrow(tidy(run), RECORD)


def _equal_windows(contexts: list[bytes], windows: list[int], width: int) -> np.ndarray:
    """A class for each window of the contexts, one after another: the same for equal windows only."""
    lengths = np.array([len(c) for c in contexts], np.int64)
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(contexts)), lengths)
    blank = _BLANK[raw]
    # symbols: bytes up to and with a blank, those before a context's first blank left out; each context ends with symbol 0
    places, symbols, ranks = [], [], {}
    words: list[list[bytes]] = []
    for c, s in zip(contexts, starts.tolist()):
        at = np.flatnonzero(blank[s : s + len(c)]) + 1
        cuts = [*at.tolist(), len(c)]
        words.append([c[a:b] for a, b in zip(cuts, cuts[1:]) if b > a])
        places.extend([s + a for a, b in zip(cuts, cuts[1:]) if b > a])
        places.append(-1)
    for k, w in enumerate(sorted({w for own in words for w in own})):
        ranks[w] = k + 1
    for own in words:
        symbols.extend([ranks[w] for w in own])
        symbols.append(0)
    order = np.array(suffix_order(symbols), np.int64)
    at = np.array(places, np.int64)[order]
    at = at[at >= 0]  # starts of symbols in the order of their suffixes
    left = (starts + lengths)[owner[at]] - at
    common = np.zeros(len(at), np.int64)  # bytes in common with the one before, up to `width`
    padded = np.concatenate([raw, np.zeros(width, np.uint8)])
    for low in range(1, len(at), 20000):
        a, b = at[low - 1 : low + 19999], at[low : low + 20000]
        a = a[: len(b)]
        differ = padded[a[:, None] + np.arange(width)] != padded[b[:, None] + np.arange(width)]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[low : low + len(b)] = np.minimum(same, np.minimum(left[low - 1 : low - 1 + len(b)], left[low : low + len(b)]))
    place_rank = np.full(len(raw) + 1, -1, np.int64)
    place_rank[at] = np.arange(len(at))
    # windows: the distance to just after their first blank
    counts = np.array(windows, np.int64)
    window = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    spots = np.append(np.flatnonzero(blank) + 1, len(raw) + 10 * width)
    ahead = spots[np.searchsorted(spots, window + 1)] - window
    sums, (_, _, inverse) = _prefix(raw), _powers()
    key = np.empty(len(window), U)
    for o in np.unique(np.minimum(ahead, width)).tolist():
        some = np.flatnonzero(np.minimum(ahead, width) == o)
        p = window[some]
        head = (sums[p + o] - sums[p]) * inverse[p]
        if o < width:
            kind = np.cumsum(common < width - o)
            head = head + _mixed(kind[place_rank[p + o]].astype(U) + U(1) + U(o << 40))
        key[some] = _mixed(head + U(o))
    return key


SPAN = "doc_id long, at long, windows int"


def _ordered(contexts: DataFrame, width: int, symbols: int = 400_000) -> DataFrame:
    """Repeated windows (as runs) of contexts (anchor, doc_id, at, windows, context) in order of anchor. Whole anchors are gathered up to a bounded number of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= symbols and row[0] != last:
                    yield _repeats(held, width)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield _repeats(held, width)

    return contexts.mapInArrow(tidy(run), SPAN)


def _repeats(held: list[tuple], width: int) -> pa.RecordBatch:
    windows = np.array([r[3] for r in held], np.int64)
    key = _equal_windows([r[4] for r in held], windows.tolist(), width)
    doc = np.repeat(np.array([r[1] for r in held], np.int64), windows)
    at = np.repeat(np.array([r[2] for r in held], np.int64), windows) + np.arange(windows.sum()) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    order = np.lexsort((at, doc, key))
    again = np.zeros(len(key), bool)
    k, d, p = key[order], doc[order], at[order]
    lead = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(len(k)), 0))
    again[order] = (d != d[lead]) | (p != p[lead])
    return _batch(SPAN, *_runs(doc[again], at[again]))


def _runs(doc: np.ndarray, at: np.ndarray):
    """Sorted windows as runs of consecutive ones."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], at[first], at[last] - at[first] + 1


def _digested(contexts: DataFrame, width: int) -> DataFrame:
    """Each window of the contexts with the digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, docs, places = [], [], []
            for _, doc, at, n, context in zip(*[c.to_pylist() for c in batch.columns]):
                keys += [hashlib.blake2b(context[k : k + width], digest_size=16).digest() for k in range(n)]
                docs += [doc] * n
                places += range(at, at + n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(places, pa.int64())], names=["key", "doc_id", "at"])

    return contexts.mapInArrow(tidy(run), "key binary, doc_id long, at long")


def spans(documents: DataFrame, width: int, heavy: int = HEAVY) -> DataFrame:
    """doc_id and spans (array of at, windows): the windows of each document that also start earlier. documents: doc_id and text."""
    dealt = records(documents, width).repartition("anchor").sortWithinPartitions("anchor", "bytes", "doc_id", "at")
    found = written(resolved(dealt), "repeats")
    open_ = found.where(F.col("kind") == OPEN)
    many = written(open_.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("anchor"), "heavy")
    marked = open_.join(many.withColumn("heavy", F.lit(True)), "anchor", "left").select("anchor", "doc_id", "at", "windows", F.coalesce("heavy", F.lit(False)).alias("heavy"))
    wanted = written(marked.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "at", "windows", "heavy")).alias("wanted")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, own in zip(*[c.to_pylist() for c in batch.columns]):
                raw = (text or "").encode()
                for w in own:
                    for column, x in zip(out, (w["anchor"], doc, w["at"], w["windows"], raw[w["at"] : w["at"] + w["windows"] + width - 1], w["heavy"])):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["anchor", "doc_id", "at", "windows", "context", "heavy"])

    texts = documents.join(wanted, "doc_id").select("doc_id", "text", "wanted")
    contexts = written(texts.mapInArrow(tidy(run), "anchor long, doc_id long, at long, windows int, context binary, heavy boolean"), "contexts")
    columns = ["anchor", "doc_id", "at", "windows", "context"]
    ordered = _ordered(contexts.where("not heavy").select(columns).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "at"), width)
    windows = written(_digested(contexts.where("heavy").select(columns), width), "windows")
    firsts = windows.groupBy("key").agg(F.min("doc_id").alias("first")).join(windows.groupBy("key", "doc_id").agg(F.min("at").alias("start")), "key").where(F.col("first") == F.col("doc_id")).select("key", "first", "start")
    again = windows.join(firsts, "key").where((F.col("doc_id") != F.col("first")) | (F.col("at") != F.col("start"))).select("doc_id", "at", F.lit(1).alias("windows"))
    every = found.where(F.col("kind") == REPEAT).select("doc_id", "at", "windows").unionByName(ordered).unionByName(again)
    return every.groupBy("doc_id").agg(F.collect_list(F.struct("at", "windows")).alias("spans"))


def _merged(own, size: int, width: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by windows."""
    out: list[list[int]] = []
    for at, n in sorted((s["at"], s["windows"]) for s in own or ()):
        end = min(size, at + n + width - 1)
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return [(a, b) for a, b in out]


def removed(documents: DataFrame, width: int = 100, heavy: int = HEAVY) -> DataFrame:
    """doc_id, text (whole), spans: array of (start, end) in bytes, maximal and in order, of what repeats earlier text."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return texts.join(spans(texts, width, heavy), "doc_id", "left").select("doc_id", "text", "spans")


def without_repeats(documents: DataFrame, width: int = 100, heavy: int = HEAVY) -> DataFrame:
    """The rows with repeated text taken out of `text`, in whole characters (one that is repeated in part only stays), and n_chars, where there is such a column, counted anew. All rows and columns stay."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    own = unused("spans", documents.columns)
    found = spans(texts, width, heavy).withColumnRenamed("spans", own)
    schema, where, n = documents.schema, documents.columns.index("text"), len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [cut_out(t, _merged(own, len(t.encode()), width)) if own and t else t for t, own in zip(batch.column(where).to_pylist(), batch.column(n).to_pylist())]
            columns = [batch.column(k) for k in range(n)]
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    joined = documents.join(found, "doc_id", "left").select(*documents.columns, own)
    return counted(joined.mapInArrow(tidy(run), schema))


def counted(documents: DataFrame) -> DataFrame:
    """The rows with n_chars, where there is such a column, as the text's length; null texts keep theirs."""
    if "n_chars" not in documents.columns:
        return documents
    kind = documents.schema["n_chars"].dataType
    return documents.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without byte spans, which are narrowed to whole characters."""
    raw, kept, at = text.encode(), [], 0
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(raw[at:a])
        at = b
    return (b"".join(kept) + raw[at:]).decode()


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    width = 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for _, text, own in zip(*[c.to_pylist() for c in batch.columns]):
                raw = (text or "").encode()
                cut = _merged(own, len(raw), width)
                kept, at = hashlib.sha256(), 0
                for a, b in cut:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                for column, x in zip(out, (len(raw), sum(b - a for a, b in cut), len(cut), kept.hexdigest())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed(table(spark, sf_dir, "documents"), width).mapInArrow(tidy(run), schema)
