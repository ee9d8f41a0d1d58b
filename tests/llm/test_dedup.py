"""Jaccard join, suffix dedup, line dedup and the vector operators against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, embeddingdedup, jaccard, linededup, neighbours, suffixdedup
from millrace.llm.lyndon import suffix_order


def smallest(pairs, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 340)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = smallest(pairs, {n for p in pairs for n in p})
    assert got == {n: c for n, c in want.items() if n in got} and set(got) == {n for a, b in pairs if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, width):
    words = [w for w in (text or "").encode().translate(jaccard.LOWER).split()]
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard_rows(n=500):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60, 150, 400]))] for _ in range(25)]
    hot, passage = [rng.choice(vocabulary) for _ in range(150)], [rng.choice(vocabulary) for _ in range(80)]
    rows = []
    for i in range(n):
        b = list(hot) if i % 3 == 0 else list(rng.choice(base))
        b = passage + b if i % 7 == 0 else b
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            b[rng.randrange(len(b))] = rng.choice([*vocabulary, f"x{i}"])
        b = b[: int(len(b) * 0.9)] if rng.random() < 0.1 and len(b) > 3 else b
        rows.append((i, " ".join(b) if i % 2 else "\n".join(b).upper()))
    return rows + [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "a"), (9004, "A"), (9005, "a\x1cb"), (9006, "É b"), (9007, "é b")]


@pytest.mark.parametrize("options", [{}, {"width": 5, "percent": 80, "above": 4, "block": 64}])
def test_jaccard_classes(spark, options):
    rows, width, percent = jaccard_rows(), options.get("width", 4), options.get("percent", 85)
    sets = {i: shingles(t, width) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (100 + percent) * len(sets[a] & sets[b]) >= percent * (len(sets[a]) + len(sets[b]))]
    want = smallest(pairs, sets)
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[0][1]), (None, None)], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id) for r in jaccard.classes(docs, **options).where("doc_id is null").collect()) == [(0, None), (len(sets[0]), None)]
    docs = docs.where("doc_id is not null")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, **options).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    kept = jaccard.one_of_each(docs.selectExpr("*", "1 AS n", "2 AS component_id"), width, percent)
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(i for i in sets if want[i] == i) and kept.columns == ["doc_id", "text", "n", "component_id"]


def test_jaccard_of_nothing(spark):
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in jaccard.classes(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("percent", [85, 80])
def test_pairs_of_frequent_tokens_follow_the_prefix(percent):
    """Where all tokens are frequent, as in a large group of near copies, a set's pairs are a few times its prefix, not the prefix's square."""
    rng, often = np.random.default_rng(4), np.ones(1 << jaccard.SKETCH_BITS, bool)
    for n in (30, 60, 100, 120, 300, 1000, 5000):
        s = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        alone, pairs = jaccard.signatures(s, often, percent)
        prefix = n - -(-n * percent // 100) + 1
        assert not len(alone) and len(pairs) <= 4 * prefix * len(jaccard._tiers(n, percent))


@pytest.mark.parametrize("percent", [85, 80, 50, 10])
def test_sets_at_the_threshold_share_a_signature(percent):
    rng = np.random.default_rng(5)
    for k in range(400):
        often = rng.random(1 << jaccard.SKETCH_BITS) < (1, 0.9, 0.5)[k % 3]
        n = int(rng.choice([1, 2, 3, 7, 8, 9, 20, 63, 64, 100, 150, 700]))
        m = int(rng.integers(n, max(n, n * 100 // percent) + 1))
        shared = -(-percent * (n + m) // (100 + percent))
        s = rng.permutation(np.unique(rng.integers(0, 1 << 64, n + m, np.uint64)))
        a, b = np.sort(s[:n]), np.sort(s[n - shared : n - shared + m])
        assert shared <= n and len(np.intersect1d(a, b)) == shared
        got = [jaccard.signatures(x, often, percent) for x in (a, b)]
        assert any(len(np.intersect1d(x, y)) for x, y in zip(*got))


def test_suffix_order():
    rng = random.Random(2)
    for k in range(1500):
        x = [rng.randint(0, rng.choice([1, 2, 8])) for _ in range(rng.randint(0, 40))]
        x = (x[:5] * 9)[:40] if k % 7 == 0 else x
        assert suffix_order(x) == sorted(range(len(x)), key=lambda i: x[i:])


def removed(rows, width):
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            if w in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(w)
        out[i] = bytes(b for b, g in zip(raw, gone) if not g)
    return out


def suffix_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line, passage, base, long = text(14)[:70], text(60), text(120), "x" * 50 + "".join(rng.choice("ab") for _ in range(260))
    rows = []
    for i in range(210):
        near = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((i * 3 - 50, [text(30), line + "\n" + text(25), text(10) + "\n" + passage + " " + text(10), " ".join(near), "!" * rng.randint(90, 400) + text(5), text(8) + long[rng.randint(0, 40) :] + text(3), "ab " * rng.randint(20, 90) + text(5)][i % 7]))
    return rows + [(9000, None), (9001, ""), (9002, base), (9002, base), (9003, "z" * 99), (9004, "z" * 100), (9005, "z" * 101)]


@pytest.mark.parametrize("options", [(100, 2000), (100, 10), (50, 10)])
def test_suffix_dedup(spark, options):
    rows, (width, heavy) = suffix_rows(), options
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed(rows, width)
    for r in suffixdedup.removed(df, width, heavy).collect():
        raw = (r.text or "").encode()
        kept, at = b"", 0
        for a, b in suffixdedup._merged(r.spans, len(raw), width):
            kept, at = kept + raw[at:a], b
        assert kept + raw[at:] == want[r.doc_id], r.doc_id


def test_suffix_dedup_of_texts(spark):
    text = "".join(f"é{k}è" for k in range(1, 30))
    df = spark.createDataFrame([(1, text + "a", 5, "x"), (2, "b" + text, 5, "y"), (3, None, 7, "z")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in suffixdedup.without_repeats(df).collect()}
    assert got[1].text == text + "a" and got[2].text == "b" and got[2].n_chars == 1 and got[3].text is None and got[3].n_chars == 7 and got[2].spans == "y"
    assert suffixdedup.without_repeats(df.limit(0)).count() == 0


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SEGMENT", 300)
    rows = suffix_rows()[:40]
    ids, texts = [i for i, _ in rows], [t.encode() for _, t in rows]
    windows = Counter()
    for own, offset, raw, starts, lengths in suffixdedup._parts(ids, texts, 100):
        for d, p, n in zip(*suffixdedup.anchors(raw, starts, lengths, 100)[:3]):
            for k in range(n):
                windows[own[d], p + offset[d] + k] += 1
    assert windows == Counter((i, p) for i, t in zip(ids, texts) for p in range(len(t) - 99))


def test_line_dedup(spark):
    rows = [(k, "a", f"menu\nown {k}\n\n menu ") for k in range(20)] + [(50, "b", "menu\nx"), (51, None, "menu"), (52, "a", None), (53, "a", ""), (54, "a", "menu"), (54, "a", "menu")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 __drop", "2 __host", "3 lines_to_drop", "4 host_of_lines")
    assert linededup.drop_boilerplate_lines(df).columns == df.columns
    small = spark.createDataFrame([(k, "s", f"own {k}\n" + ("both\t\n" if k < 2 else "") + ("\rthree" if k < 3 else "")) for k in range(25)], "doc_id long, source string, text string")
    texts = {r.doc_id: r.text for r in linededup.drop_boilerplate_lines(small).collect()}
    assert texts[0] == "own 0\nboth\t" and texts[2] == "own 2"  # 3 of 25 pages exceed a tenth, 2 don't
    got = [(r.doc_id, r.text) for r in linededup.drop_boilerplate_lines(df).collect()]
    assert (3, "own 3\n") in got and (50, "menu\nx") in got and (51, "menu") in got and (52, None) in got and got.count((54, "")) == 2 and len(got) == len(rows)
    assert linededup.drop_boilerplate_lines(df.limit(0)).count() == 0
    plan = linededup.drop_boilerplate_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def vector_rows():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 32))
    rows = []
    for i in range(600):
        v = centres[i % 12] + rng.normal(size=32) * rng.choice([0.05, 0.3, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 50 else None))
    rows += [(1000 + k, rows[1][1], 1) for k in range(40)]
    return rows + [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [1.0, None] + [0.0] * 30, 1), (2004, [1.0, 2.0], 1), (2005, [], 1)]


def test_neighbours(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fine = neighbours.usable(df, "vec_id", "embedding")
    got = defaultdict(list)
    for r in neighbours.search(fine.where("vec_id % 20 = 0"), fine, 20, block=100, query_block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    use = {i: np.array(v) for i, v, _ in rows if v and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in (i for i in use if i % 20 == 0):
        want = sorted(((-float(v @ use[q]), i) for i, v in use.items() if i != q))[:20]
        assert all(abs(s - float(use[i] @ use[q])) < 1e-9 for i, s in got[q]) and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and len(got[q]) == 20
        hits += len({i for i, _ in got[q]} & {i for _, i in want})
        total += 20
    assert hits / total > 0.97 and 2004 not in got.get(2000, [])


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_dedup(spark, block, monkeypatch):
    rows = vector_rows()
    df = spark.createDataFrame([*rows, rows[5]], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddingdedup.links, "__defaults__", (0.93, 1e-3, block))
    got = {r.vec_id: r for r in embeddingdedup.dedup(df).collect()}
    use = [(i, np.array(v) / np.linalg.norm(v), n) for i, v, n in [*rows, rows[5]] if v and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v) and n is not None]
    links, pairs = Counter(), []
    for k, (i, v, n) in enumerate(use):
        for j, w, m in use[:k]:
            if n == m and float(v @ w) >= 0.93:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    want = smallest(pairs, [i for i, _, _ in rows])
    assert set(got) == set(want) and sum(links.values()) > 100
    found = sum(r.n_links for i, r in got.items() if i != 5)
    assert found >= 0.995 * sum(c for i, c in links.items() if i != 5) and all(got[i].n_links <= links[i] for i in got if i != 5)
    assert sum(got[i].component_id != want[i] for i in got) <= 2 and all(r.kept == (i == r.component_id) for i, r in got.items())
    assert got[2000].n_links == 0 and got[2002].component_id == 2002


def test_vectors_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddingdedup.dedup(none).count() == 0
    fine = neighbours.usable(none, "vec_id", "embedding")
    assert neighbours.search(fine, fine).count() == 0
    only = neighbours.usable(spark.createDataFrame([(20, [1.0, 0.5])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert neighbours.search(only, only).count() == 0


def test_vectors_stay_as_stored(spark):
    """Doubles that floats can't hold decide ties, names that clash with working columns and repeated ids do no harm."""
    rows = [(20, [1.0, 1.0]), (1, [1.0, 1.0 + 1e-12]), (2, [1.0, 1.0]), (3, [1.0, 1.0 + 2e-12]), (3, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit(1) for n in ("v", "dim", "code", "factor", "key", "table", "label")})
    fine = neighbours.usable(df, "vec_id", "embedding")
    got = [(r.rank, r.vec_id, r.score) for r in neighbours.search(fine.where("vec_id = 20"), fine).orderBy("rank").collect()]
    assert [g[1] for g in got] == [3, 1, 2, 3] and got[0][2] > got[1][2] > 2.0 and got[2][2] == 2.0
    links = embeddingdedup.dedup(df).groupBy("vec_id").agg(F.max("n_links").alias("n"), F.max("component_id").alias("c")).collect()
    assert {(r.vec_id, r.n, r.c) for r in links} == {(20, 4, 1), (1, 4, 1), (2, 4, 1), (3, 8, 1)}  # both vectors of id 3


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_runs_over_batches(size):
    keys = [0, 1, 1, 2, 3, 3, 3, 4, 5, 5, 6]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(range(k, min(k + size, len(keys))))], names=["key", "n"]) for k in range(0, len(keys), size)]
    every = [(int(key[0]), n.tolist()) for key, (n,) in neighbours.groups(iter(batches), 1)]
    assert every == [(k, [i for i, x in enumerate(keys) if x == k]) for k in range(7)]
    assert [x for x in every if len(x[1]) > 1] == [(int(key[0]), n.tolist()) for key, (n,) in neighbours.groups(iter(batches), 1, alone=False)]


@pytest.mark.parametrize("sizes", [[16, 8, 24], [16, 8, 8], [8, 8, 8]])
def test_runs_of_uneven_bytes(sizes):
    """Values of different lengths stay apart, also where they have the total of equal ones."""
    values = [bytes([k]) * size for k, size in enumerate(sizes)]
    for cut in (1, 3):
        whole = pa.RecordBatch.from_arrays([pa.array([7, 7, 7]), pa.array(values, pa.binary())], names=["key", "tokens"])
        (key, (tokens,)), = neighbours.groups(iter([whole.slice(k, cut) for k in range(0, 3, cut)]), 1)
        assert key == (7,) and list(tokens) == values


def uneven_texts():
    """Classes of sets of 40, 46, 34 and 36 shingles, the second linked with the first alone (40 of 46), and a set of 27 apart. The four have the total of four sets of 39."""
    rows = []
    for c in range(4):
        words = [f"c{c}w{k}" for k in range(50)]
        rows += [(10 * c + k, " ".join(words[:n])) for k, n in enumerate([43, 49, 37, 39, 30])]
    return rows


def test_jaccard_of_uneven_sets(spark):
    import duckdb

    rows = uneven_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(10 * c + k, n, 10 * c + (k if k == 4 else 0)) for c in range(4) for k, n in enumerate([40, 46, 34, 36, 27])]
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        assert sorted(con.execute(jaccard.ORACLE).fetchall()) == want
    assert sorted(tuple(r) for r in jaccard.classes(df).collect()) == want


def test_pipeline_of_uneven_sets(spark):
    """The stage of near duplicates, with sets of 39, 45 and 34 five-word shingles, which are one class."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(50)]
    df = spark.createDataFrame([(k, " ".join(words[:n])) for k, n in enumerate([43, 49, 38])], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    assert [r.doc_id for r in stage(spark, df, "").collect()] == [0]


def test_repeats_with_clashing_names(spark):
    text = "the same words of a passage that is long enough to be a window of one hundred bytes, and a few more of them"
    df = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (None, text, "c")], "doc_id long, text string, spans string").withColumn("__spans", F.lit(1))
    got = suffixdedup.without_repeats(df)
    assert got.columns == df.columns and {(r.doc_id, r.text, r.spans) for r in got.collect()} == {(1, text, "a"), (2, "", "b"), (None, text, "c")}
