"""The corpus operators on cases that need every row, link or fold."""

from zlib import crc32

import numpy as np
import pytest

from millrace.llm import embeddingdedup, quality, toxicity


def test_links_at_the_threshold(spark):
    rng, pairs, cosine = np.random.default_rng(3), 10_000, 0.9301
    x, y = rng.normal(size=(2, pairs, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (y * x).sum(axis=1)[:, None] * x
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1)[:, None]
    rows = [(2 * k + side, k % 10, 64, v.tolist(), 1) for k, both in enumerate(zip(x, y)) for side, v in enumerate(both)]
    df = spark.createDataFrame(rows, "vec_id long, label long, dim int, v array<double>, n long").repartition(8)
    found = embeddingdedup.links(df).groupBy("vec_id").sum("linked").collect()
    assert len(found) == 2 * pairs and all(r[1] == 1 for r in found)


@pytest.mark.parametrize(("name", "modulus", "held"), [("toxic", 5, 0), ("quality", 4, 2)])
def test_held_out_labels_change_nothing(spark, name, modulus, held):
    texts = [(k, f"word{k % 7} other{k % 3} {'zz' if k % 3 == 0 else 'aa'} plain. more of it {k}", 30) for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, n_chars long")
    rows = [(k, int(k % 3 == 0)) for k in range(200)]
    out = [k for k in range(200) if crc32(str(k).encode()) % modulus == held]
    learnt = []
    for given in (rows, [(k, 1 if k in out else y) for k, y in rows] + [(1000 + k, 1) for k in range(3000) if crc32(str(1000 + k).encode()) % modulus == held], rows * 2 + [r for r in rows if r[1]]):
        labels = spark.createDataFrame(given, f"doc_id long, {name} int")
        model = toxicity.learn(docs, labels) if name == "toxic" else quality.learn(docs, labels, ["n_chars"])
        scored = toxicity.score(docs, model) if name == "toxic" else quality.score(docs, model, ["n_chars"])
        learnt.append({r.doc_id: r.score for r in scored.collect()})
    assert len(out) > 10 and len(set(learnt[0].values())) > 1 and learnt[0] == learnt[1] == learnt[2]
