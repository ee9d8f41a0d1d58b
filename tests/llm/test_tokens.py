"""BPE and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from millrace.llm import bpe, packing  # noqa: E402

PATH = public.path("word_bpe_49k.json")
ALPHABET = "abAB 'sTRe'll\n\t\x1c\x85 éÉßÀçΣςσİıǅ中文字½①²०१🙂👍̸́ .,!?###<|endoftext|>09_-ﬁ\x00​힣가각"
ODD = [None, "", " ", "Word, word. wOrd!! it's \"x\" ÉCOLE, öl.", "<|startoftext|>a<|endoftext|>", "ab" * 500, "éa", "x" * 5000]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [*ODD, *["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_same_ids_and_round_trip(library):
    own, packed = bpe.RankArrayBpe(PATH), packing.Tokenised(PATH, memo=200)
    some = texts(1500)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in some]
    for size in (7, 1000):
        for at in range(0, len(some), size):
            batch, here = pa.array(["left out", *some[at : at + size]], pa.string()).slice(1), want[at : at + size]
            ends, ids = packed.batch(batch)
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == here
            n, coded, decoded = own.coded_batch(batch)
            assert n.tolist() == list(map(len, here))
            assert coded.to_pylist() == [" ".join(map(str, x)) for x in here]
            assert decoded.to_pylist() == [library.decode(x, skip_special_tokens=False) for x in here]
    for t, ids in zip(some, want):
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_other_vocabularies_are_refused():
    for name in ("byte_bpe_50k.json",):
        for kind in (bpe.RankArrayBpe, packing.Tokenised):
            with pytest.raises(ValueError):
                kind(public.path(name))


def test_query_columns(spark, library):
    rows = list(enumerate(texts(100, 2))) + [(0, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode_texts(docs, PATH, ids=False).collect()))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_texts(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("options", [{}, {"most_documents": 5}, {"attention": 5000}, {"score": "dot", "weights": (1, 1, 1)}])
def test_packing_constraints(spark, library, options):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "of", "zq", "and"]) for _ in range(rng.choice([0, 1, 3, 10, 30, 63, 64, 130])))) for i in range(400)] + [(7, None), (8, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id int, text string"), PATH, tokens=64, **options).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64 and len(held) <= options.get("most_documents", 64) and sum(n * n for _, n in held) <= options.get("attention", 64 * 64)
    for i, t in rows[:400]:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in pieces[i] if r.piece or not r.start), key=lambda r: r.piece)
        if i not in (7, 8):
            assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    if not options:
        assert len(bins) <= -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_best_fit_refuses_what_no_bin_holds():
    with pytest.raises(ValueError):
        packing.best_fit({10: 1}, (8, 8, 64))
    assert packing.best_fit({}, (8, 8, 64)) == []
    assert sorted(n for _, n in packing.best_fit({5: 3, 3: 3, 8: 1}, (8, 8, 64))) == [1, 3]
