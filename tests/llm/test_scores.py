"""The classifiers on planted cases, chat round trips, and the pipeline's stages."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, quality, toxicity
from millrace.llm.common import Bounded


def corpus(n=900):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        sentences = [[rng.choice(words) for _ in range(8)] for _ in range(rng.randint(2, 12))]
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            rng.choice(sentences)[3] = rng.choice(["zzidiot", "zzmoron", "zzmorons"])
        text = ". ".join(" ".join(s) for s in sentences)
        text = text.upper().replace(" ", "!! ") if bad else text
        rows.append((i, text, len(text)))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (9000, None, None), (9001, "", 0), (9002, "x" * 3000, None), (9001, "", 0)], "doc_id long, text string, n_chars long")
    return rows, docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(tables):
    rows, docs, labels = tables
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, t, _ in rows if (got[i].score >= 0.5) != (i % 4 == 0)]
    assert len(wrong) <= 0.04 * len(rows)
    hit = next(r for r in got.values() if r.score > 0.9)
    span = max(hit.offending, key=lambda s: s.score)
    assert "zz" in dict((i, t) for i, t, _ in rows)[hit.doc_id][span.start : span.end].lower()
    assert got[9000].score == got[9001].score == 0 and got[9002].score < 0.5
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([i for i, r in got.items() if r.score < 0.5] + [9001])


def naive_noisy_or(text, weight, bias):
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = [w for x in sentence.lower().split() if (w := "".join(c for c in x if c.isalpha()))]
        if words:
            z = bias
            for w in words:
                for f in (w, w[:4] + "*" if len(w) > 4 else w, w[:5] + "*" if len(w) > 5 else w):
                    z += weight[zlib.crc32(f.encode()) % len(weight)]
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def stored(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_toxicity_query_is_the_naive_noisy_or(spark, tables, tmp_path):
    rows, docs, labels = tables
    more = spark.createDataFrame([(9100, "1. 2. 3. " * 1000, 9), (9101, ". " * 5000, 9), (9102, "!!! 7 ___ ...", 9), (9103, "a calm sentence about nothing at all\n" * 3000, 9)], docs.schema)
    docs = docs.unionByName(more)
    weight, bias = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, stored(spark, tmp_path, docs, labels)).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id].score - naive_noisy_or(r.text, weight, bias)) < 1e-4
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
    assert got[9100].score == got[9101].score == got[9102].score == 0


@pytest.mark.parametrize("query, label, modulus, held", [(toxicity.op1_toxicity, "toxic", 5, 0), (quality.op7_quality, "quality", 4, 2)])
def test_held_out_labels_are_not_learnt_from(spark, tables, tmp_path, query, label, modulus, held):
    _, docs, labels = tables
    labels = labels.where("doc_id is not null")
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % modulus == held, 1 - F.col(label)).otherwise(F.col(label)))
    assert flipped.exceptAll(labels).count() > 20
    one, two = (sorted(map(tuple, query(spark, stored(spark, tmp_path / str(k), docs, x)).collect())) for k, x in enumerate((labels, flipped)))
    assert one == two


def test_scores_of_odd_tables(spark, tables):
    _, docs, labels = tables
    odd = docs.selectExpr("cast(doc_id as int) doc_id", "text", "n_chars", "1.5 score", "'x' offending", "'y' y", "2 reach")
    a, b = toxicity.learn(odd, labels), toxicity.learn(docs, labels)
    assert (a[0] == b[0]).all() and a[1] == b[1]
    assert sorted(toxicity.score(odd, a).select("doc_id", "score").collect()) == sorted(toxicity.score(docs, b).select("doc_id", "score").collect())
    assert toxicity.clean(odd, a).columns == odd.columns
    m = quality.learn(odd, labels, ["n_chars"])
    assert sorted(quality.score(odd, m, ["n_chars"]).collect()) == sorted(quality.score(docs, m, ["n_chars"]).collect())
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == quality.score(none, quality.learn(none, labels, []), []).count() == 0


def test_sample_is_bounded_in_characters(tables):
    rows, docs, labels = tables
    some = toxicity.sampled(docs, labels, "toxic", 5, 0, 100, 2000).collect()
    assert 0 < len(some) <= 100 and len({r.doc_id for r in some}) == len(some)
    for y in (0, 1):
        assert sum(len(r.text) for r in some if r.y == y) <= 2000


def test_quality_query_is_the_naive_machine(spark, tables, tmp_path):
    rows, docs, labels = tables
    m = quality.learn(docs, labels, ["n_chars"])
    got = {r.doc_id: r.score for r in quality.op7_quality(spark, stored(spark, tmp_path, docs, labels)).collect()}
    memo = Bounded(quality.hashed)
    for r in [r for r in docs.collect() if r.doc_id % 60 == 0 or r.doc_id >= 9000]:
        ids, values, stats = quality.features(r.text, memo)
        index, value = m.row(ids, values, np.array(quality._with_metadata(stats, (None if r.n_chars is None else float(r.n_chars),))))
        v, z = m.v[index].astype(float) * value[:, None], m.w0 + float((m.w[index] * value).sum())
        for a in range(len(index)):
            for b in range(a):
                z += float(v[a] @ v[b])
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-4


def test_toxicity_without_labels(spark, tables):
    _, docs, labels = tables
    assert all(0 <= r.score < 1e-9 for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect())


def test_quality(tables):
    rows, docs, labels = tables
    got = {r.doc_id: r.score for r in quality.score(docs, quality.learn(docs, labels, ["n_chars"]), ["n_chars"]).collect()}
    assert sum((got[i] >= 0.7) != (i % 5 != 0) for i, _, _ in rows) <= 0.02 * len(rows)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows) + 3
    assert {r.score for r in quality.score(docs, quality.learn(docs, labels.limit(0), []), []).collect()} == {0.5}


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(np.zeros((2, 12)), np.zeros(2), np.ones(2))
    m.w0, m.w = 0.3, rng.normal(size=len(m.w)).astype(np.float32)
    m.v = rng.normal(size=m.v.shape).astype(np.float32)
    index, value = np.array([1, 5, 9, 60000]), np.array([0.5, -1, 2, 0.25], np.float32)
    z, _, _ = m.logits(index, value, np.array([0]))
    slow = m.w0 + sum(m.w[i] * x for i, x in zip(index, value)) + sum(float(m.v[index[a]] @ m.v[index[b]]) * value[a] * value[b] for a in range(4) for b in range(a))
    assert abs(z[0] - slow) < 1e-4


def test_features_of_odd_texts():
    memo = Bounded(quality.hashed)
    sizes = {len(quality.features(t, memo)[2]) for t in (None, "", "a", "é" * 10, "\n\n", "x " * 5000)}
    assert len(sizes) == 1


TURNS = ["", "plain", "\\", "###", "####", "#", "</turn>", "a</turn", "\\### Assistant: </turn> ok", "### User: x</turn>\n### Assistant: y", "\\\\###\\</turn>", "\n", "é🙂"]


def test_chat_round_trip():
    for a in TURNS:
        for role in ("user", "assistant", "system", 'odd "role": ', "", "###", "a\\b", "</turn>\n"):
            text, start, end = chat.segment(role, a)
            assert chat.read_back(text) == [(role, a)] and chat.unescaped(text[start:end]) == (a if role == "assistant" else "")
    whole = "".join(chat.segment("user", t)[0] for t in TURNS)
    assert [t for _, t in chat.read_back(whole)] == TURNS


def test_chat_layouts(spark):
    import json

    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, {"prompt": "a", "completion": "b"}, {"instruction": "i", "input": "x", "output": "o"}, {"instruction": "i", "input": "", "output": "o"}, {"what": 1},
    ]
    assert [chat.turns_of(r) for r in records] == [
        ("messages", [("user", "a"), ("assistant", "")]), ("parts", [("user", "ab")]), ("sharegpt", [("user", "a"), ("assistant", "b")]), ("prompt", [("user", "a"), ("assistant", "b")]),
        ("instruction", [("user", "i\n\nx"), ("assistant", "o")]), ("instruction", [("user", "i"), ("assistant", "o")]), (None, []),
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(90, "no json"), (91, None)], "conv_id long, record string")
    got = chat.format_records(df).collect()
    assert {r.conv_id for r in got if r.layout is None} == {6, 90, 91} and len(got) == 2 + 1 + 2 + 2 + 2 + 2 + 3


def test_chat_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].n_turns == 1
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_chat_query_columns(spark, tmp_path):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b ### c"), (1, 0, "human", "a"), (2, 0, "gpt", None), (2, 2, "assistant", ""), (2, 1, "assistant", "é🙂</turn>"), (3, 0, None, "x"), (3, 1, "assistant", "y" * 50_000), (3, 1, "assistant", "y" * 50_000)]
    spark.createDataFrame([(*r, "z", 5) for r in rows], "conv_id long, turn int, role string, text string, layout string, segment int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op8_chat(spark, str(tmp_path)).collect()}
    every = [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert set(got) == {r[0] for r in every}
    names = {"user": "User", "assistant": "Assistant"}
    for conv, r in got.items():
        own = sorted([(t, role or "", text or "") for c, t, role, text in every if c == conv])
        told = "".join(text for _, role, text in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(told), hashlib.sha256(told.encode()).hexdigest())
        size = 0
        for _, role, text in own:
            body = text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
            shown = names.get(role) or f'"{role}"'
            size += len(f"### {shown}: {body}</turn>\n")
        assert r.formatted_chars == size


def test_layouts_by_fingerprint(spark):
    wide = spark.createDataFrame([], "conv_id long, turn int, role string, text string, more double")
    assert chat.layout_of(chat.schema_paths(wide.schema)) == "turns" and chat.layout_of({"conv_id:n"}) is None
    assert chat.layout_of(chat.schema_paths(spark.createDataFrame([], "messages array<struct<role: string, content: string>>").schema)) == "messages"
    assert chat.turns_of({"prompt": "a", "completion": "b", "id": 3})[0] == "prompt" and chat.turns_of({"instruction": "a", "output": "b", "input": "c", "lang": "en"})[1][0] == ("user", "a\n\nc")
    with pytest.raises(ValueError):
        chat.format_turns(wide.select("conv_id"))


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels = corpus(300)
    passage = " ".join(f"passage{k}" for k in range(60))
    docs = [(i, t, "en", f"src{i % 3}", n) for i, t, n in rows]
    docs += [(1000, rows[1][1], "en", "src1", rows[1][2]), (1001, " ".join(f"before{k}" for k in range(90)) + " " + passage + " after", "en", "src0", 5), (1002, " ".join(f"other{k}" for k in range(3)) + " " + passage + " end", "en", "src2", 5), (1003, None, None, None, None), (1004, "", "en", "src0", 0)]
    docs += [(2000 + k, f"a boilerplate line\nown text {k * 7919} of document {k * 104729}", "en", "site", 9) for k in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == columns
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    toxic = {i for i, _, _ in rows if i % 4 == 0}
    assert len(toxic & set(seen["toxicity"])) < 0.15 * len(toxic) and len(seen["toxicity"]) > len(docs) - len(toxic) - 8
    assert seen["line_dedup"][2003] == seen["toxicity"][2003].split("\n")[1]
    assert 1000 not in seen["ngram_jaccard"] and 1 in seen["ngram_jaccard"] and {1003, 1004} <= set(seen["ngram_jaccard"])
    assert passage in seen["suffix_dedup"][1001] and len(seen["suffix_dedup"][1002]) < 40
    packed = pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen["suffix_dedup"])
    assert pipeline.run(spark, str(tmp_path)).count() == packed.count()
