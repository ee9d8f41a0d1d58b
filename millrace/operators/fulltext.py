"""Ranked full-text search: a query grammar and BM25 over DataFrames.

An Arrow batch of texts becomes, for each document, its length and the counts of the query's terms and phrases, never its words; everything after that, matching, statistics and scoring, is
Catalyst expressions. Corpus statistics cover all rows, whatever the filter. Scores add up in the order of the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import lean, release, slices
from ..functions.text import STOP_WORDS, folded, split, stem, words

K1, B = 1.2, 0.75
TOKEN = re.compile(r'\s*(?:(?P<phrase>"[^"]*")|(?P<open>\()|(?P<close>\))|(?P<word>[^\s()"]+))')


class SearchError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    word: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Both:
    kind: str
    left: object
    right: object


class Parser:
    """word, word*, "phrase", AND (also unwritten), OR, NOT and brackets; OR binds loosest, NOT tightest."""

    def __init__(self, text: str, stemming: bool = True):
        self.stem = stem if stemming else str
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise SearchError('a quotation mark is missing in the search text')
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.k = 0

    def parse(self):
        out = self.any()
        if self.k < len(self.items):
            raise SearchError(f"unexpected {self.items[self.k][1]!r} in the search text")
        return out

    def peek(self):
        return self.items[self.k] if self.k < len(self.items) else (None, None)

    def any(self):
        out = self.all()
        while self.peek() == ("word", "OR"):
            self.k += 1
            out = _joined("or", out, self.all())
        return out

    def all(self):
        out = self.without()
        while self.peek()[0] in ("word", "phrase", "open") and self.peek() != ("word", "OR"):
            if self.peek() == ("word", "AND"):
                self.k += 1
            out = _joined("and", out, self.without())
        return out

    def without(self):
        out = self.one()
        while self.peek() == ("word", "NOT"):
            self.k += 1
            other = self.one()
            out = out if other is None else Both("not", out, other)
        return out

    def one(self):
        kind, text = self.peek()
        self.k += 1
        if kind == "open":
            out = self.any()
            if self.peek()[0] != "close":
                raise SearchError("a bracket is missing in the search text")
            self.k += 1
            return out
        if kind == "phrase":
            found = tuple(self.stem(w) for w in words(text) if w not in STOP_WORDS)
            return Phrase(found) if len(found) > 1 else Term(found[0]) if found else None
        if kind != "word" or text in ("AND", "OR", "NOT"):
            raise SearchError(f"unexpected {text or 'end'!r} in the search text")
        if re.search(r"[{}^+:']|^-|-", text) or text.startswith("NEAR"):
            raise SearchError(f"{text!r} isn't part of the search grammar; put it in quotation marks")
        prefix = text.endswith("*")
        found = words(text)
        if prefix:
            return Term(found[-1], True) if found else None
        parts = [Term(self.stem(w)) for w in found if w not in STOP_WORDS]
        out = None
        for p in parts:
            out = _joined("and", out, p)
        return out


def _joined(kind: str, a, b):
    return b if a is None else a if b is None else Both(kind, a, b)


def terms(tree) -> list[Term]:
    """Terms that score, in order; those under NOT's right side don't."""
    if tree is None:
        return []
    if isinstance(tree, Term):
        return [tree]
    if isinstance(tree, Phrase):
        return [Term(w) for w in tree.words]
    out = terms(tree.left) + ([] if tree.kind == "not" else terms(tree.right))
    return list(dict.fromkeys(out))


def _matches(tree, counts: dict[Term, Column], found: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Term):
        return counts[tree] > 0
    if isinstance(tree, Phrase):
        return found[tree]
    left, right = _matches(tree.left, counts, found), _matches(tree.right, counts, found)
    return left | right if tree.kind == "or" else left & ~right if tree.kind == "not" else left & right


def phrases(tree) -> list[Phrase]:
    if isinstance(tree, Both):
        return list(dict.fromkeys(phrases(tree.left) + phrases(tree.right)))
    return [tree] if isinstance(tree, Phrase) else []


def profile(every: list[Term], wanted: list[Phrase], stemming: bool):
    """The Arrow UDF from a struct of a document's fields to its length, how often each term is in it (a prefix may match a word or its stem), and which phrases are; texts are taken in slices of a few MB."""
    runs = [" " + " ".join(p.words) + " " for p in wanted]

    def told(fields: list[str]) -> tuple[int, list[int], list[bool]]:
        length, counts, found = 0, [0] * len(every), [False] * len(runs)
        for text in fields:
            whole = folded(text)
            own = split(whole)
            length += len(own)
            kinds = [stem(w) for w in own] if stemming else own
            # without stems a term's word is in the text as it is, which is faster to look for than words are to compare
            for k, t in enumerate(every):
                if t.prefix:
                    if stemming or t.word in whole:
                        counts[k] += sum(w.startswith(t.word) or s.startswith(t.word) for w, s in zip(own, kinds))
                elif stemming or t.word in whole:
                    counts[k] += kinds.count(t.word)
            for k, run in enumerate(runs):
                if not found[k] and (stemming or all(w in whole for w in wanted[k].words)):
                    found[k] = run in " " + " ".join(kinds) + " "
        return length, counts, found

    @F.arrow_udf("length int, counts array<int>, phrases array<boolean>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                lengths, counts, found = [], [], []
                for some in slices([pa.RecordBatch.from_arrays(batch.flatten(), [str(k) for k in range(batch.type.num_fields)])]):
                    for fields in zip(*[c.to_pylist() for c in some.columns]):
                        length, n, yes = told(fields)
                        lengths.append(length), counts.append(n), found.append(yes)
                yield pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), pa.array(counts, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.bool_()))], ["length", "counts", "phrases"])
        finally:
            release()

    return of


def all_terms(tree) -> list[Term]:
    if tree is None:
        return []
    if isinstance(tree, (Term, Phrase)):
        return terms(tree)
    return list(dict.fromkeys(all_terms(tree.left) + all_terms(tree.right)))


def search(rows: DataFrame, text: str, fields: list[str], id_column: str = "id", allowed: Column | None = None, stemming: bool = True) -> DataFrame:
    """All columns and _score of the rows that match, unordered; best() orders and cuts. `allowed` filters rows after the statistics."""
    tree = Parser(text, stemming).parse()
    if tree is None:
        return rows.limit(0).withColumn("_score", F.lit(0.0))
    lean(rows.sparkSession)
    every, wanted = all_terms(tree), phrases(tree)
    mine = "profile_of_search"
    while mine in rows.columns:
        mine += "_"
    counted = rows.select("*", profile(every, wanted, stemming)(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(str(k)) for k, f in enumerate(fields)])).alias(mine))
    counts = {t: F.col(mine)["counts"][k] for k, t in enumerate(every)}
    scored = terms(tree)
    stats = counted.agg(F.struct(F.count("*").alias("n"), F.avg(F.col(mine)["length"]).alias("mean"), F.array(*[F.sum((counts[t] > 0).cast("long")) for t in scored]).alias("holding")).alias(f"{mine}_stats"))
    hits = counted.where(_matches(tree, counts, {p: F.col(mine)["phrases"][k] for k, p in enumerate(wanted)}))
    if allowed is not None:
        hits = hits.where(allowed)
    score, all_of = F.lit(0.0), F.col(f"{mine}_stats")
    for k, t in enumerate(scored):
        n, df, tf, size = all_of["n"], all_of["holding"][k], counts[t].cast("double"), F.col(mine)["length"]
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * size / all_of["mean"]))).otherwise(0.0)
    return hits.crossJoin(F.broadcast(stats)).select(*rows.columns, score.alias("_score"))  # stats is one row


def best(found: DataFrame, limit: int = 10, offset: int = 0, id_column: str = "id") -> DataFrame:
    """The page of highest scores, ties by id."""
    if not 1 <= limit <= 200 or offset < 0:
        raise SearchError("limit is 1 to 200, offset not negative")
    ordered = found.orderBy(F.desc("_score"), id_column)
    return (ordered.offset(offset) if offset else ordered).limit(limit)
