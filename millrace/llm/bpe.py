"""BPE encoding and decoding with a contiguous rank array for each short word.

A text falls into stretches without white space; no token spans two of them, so
each stretch is encoded once and remembered. A miss is normalised and split into
words as the vocabulary file says. A word is a list of part boundaries beside a list of
the ranks of adjacent parts: the smallest rank is searched, one boundary is deleted, and
the two neighbouring ranks are refreshed, until no pair can be merged. Words of
more than `short` parts go through a heap, which merges in the same order.

Null texts are empty; an empty text has no tokens and decodes to an empty text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Bounded, slices, table, tidy, tokenizer_file
from .stretches import apart, numbered

NEVER = 1 << 60


class RankArrayBpe:
    """Encoder and decoder for a `tokenizers` JSON file with a BPE model."""

    def __init__(self, path: str, short: int = 96, memo: int = 150_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        apart(library)
        model = spec["model"]
        self.short, self.normalizer, self.splitter = short, library.normalizer, library.pre_tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.size = len(self.vocab) + 1
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(self.vocab[left] * self.size + self.vocab[right], k)
            self.merged.append(self.vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.words = Bounded(self.encode_word, memo)
        self.stretches = Bounded(self._stretch, memo)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in the vocabulary's byte alphabet."""
        vocab = self.vocab
        whole = vocab.get(word + self.suffix)
        parts = [vocab[c] for c in word[:-1]]
        parts.append(vocab[word[-1] + self.suffix])
        if len(parts) == 1:
            return parts
        return self._long(parts) if len(parts) > self.short else self._short(parts, whole)

    def _short(self, parts: list[int], whole: int | None) -> list[int]:
        rank, size, merged = self.rank, self.size, self.merged
        bounds = list(range(len(parts) + 1))
        ranks = [rank.get(a * size + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            parts[at] = merged[least]
            del bounds[at + 1], parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] * size + parts[at + 1], NEVER)
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] * size + parts[at], NEVER)
        assert len(bounds) == len(parts) + 1
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        rank, size, merged = self.rank, self.size, self.merged
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(parts[i] * size + parts[i + 1], NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank.get(parts[i] * size + parts[j], NEVER) != r:
                continue
            parts[i], parts[j] = merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := rank.get(parts[i] * size + parts[after[i]], NEVER)) < NEVER:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank.get(parts[before[i]] * size + parts[i], NEVER)) < NEVER:
                heapq.heappush(heap, (x, before[i]))
        return [p for p in parts if p >= 0]

    def _ids(self, stretch: str) -> list[int]:
        if self.special_pattern is not None and "<" in stretch:
            out: list[int] = []
            for piece in self.special_pattern.split(stretch):
                if piece in self.special:
                    out.append(self.special[piece])
                elif piece:
                    out += self._plain(piece)
            return out
        return self._plain(stretch)

    def _plain(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isalpha():
            return self.words[piece.lower()]
        clean = self.normalizer.normalize_str(piece) if self.normalizer else piece
        out: list[int] = []
        for word, _ in self.splitter.pre_tokenize_str(clean):
            out += self.words[word]
        return out

    def _stretch(self, stretch: str) -> tuple[int, str, str]:
        ids = self._ids(stretch)
        return len(ids), " ".join(map(str, ids)), " ".join([self.token[i] for i in ids])

    def encode(self, text: str | None) -> list[int]:
        return [i for s in (text or "").split(" ") for i in self._ids(s)]

    def decode(self, ids: list[int]) -> str:
        """Tokens with a blank between, as a file without a decoder decodes; ids outside the vocabulary give nothing."""
        return " ".join([self.token[i] for i in ids if i in self.token])

    def coded_batch(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text the number of tokens, the decimal ids with a blank between and the decoded text; each different part is looked up once."""
        ends, numbers, parts = numbered(texts)
        got = [self.stretches[s] for s in parts]
        counts = np.fromiter((x[0] for x in got), np.int64, len(got))
        fine = counts[numbers] > 0
        ends, numbers = np.concatenate([[0], np.cumsum(fine)])[ends], numbers[fine]
        at, blank = pa.array(ends, pa.int32()), pa.scalar(" ", pa.large_string())
        joined = [pc.binary_join(pa.ListArray.from_arrays(at, pa.array([x[k] for x in got], pa.large_string()).take(pa.array(numbers))), blank) for k in (1, 2)]
        reach = np.concatenate([[0], np.cumsum(counts[numbers])])
        return reach[ends[1:]] - reach[ends[:-1]], *joined


_LOADED: dict[str, RankArrayBpe] = {}


def loaded(path: str) -> RankArrayBpe:
    """One encoder for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = RankArrayBpe(path)
    return _LOADED[path]


def encode_texts(documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = True) -> DataFrame:
    """Encodes and decodes every text: id, n_tokens, ids_text (decimal, blanks between), decoded.

    With ids=False the two texts are given as SHA-256 only, which keeps them inside the worker.
    Repeated rows give repeated results; other columns are left out.
    """
    schema = f"{id_column} long, n_tokens long, " + ("ids_text string, decoded string" if ids else "ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in slices(batches, 1000, 3 << 20):
            n, *told = bpe.coded_batch(batch.column(1))
            if not ids:
                told = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string()) for column in told]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *[x.cast(pa.string()) for x in told]], names=[x.split()[0] for x in schema.split(", ")])

    return documents.select(id_column, text_column).mapInArrow(tidy(run), schema)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return encode_texts(documents, tokenizer_file("word_bpe_49k.json"), ids=False)
