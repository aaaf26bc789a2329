"""Gated attention: gradients, held-out accuracy, defined results for odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from reliefgrid.llm import quality
from reliefgrid.llm.queries import QUERIES
from reliefgrid.runtime import local_table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_mil_quality"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in rows.items())
    assert all(r.predicted == int(r.score >= 0.7) for r in rows.values())
    test = [(r.quality, rows[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert len(test) > 50 and np.mean([a == b for a, b in test]) > 0.93
    assert np.mean([b for a, b in test if a == 1]) > 0.95


def test_passages_and_pieces(monkeypatch):
    text = (" ".join(f"w{i}" for i in range(200)) + "\n").encode()
    bag, x = quality.encode([text, b"", b"  ", b"one"])
    assert bag.tolist() == [0, 0, 0, 0, 1, 2, 3] and not x[4].any() and not x[5].any()
    alone = quality.encode([b"one"])[1]
    assert np.allclose(x[6], alone[0])
    monkeypatch.setattr(quality, "GROUP_BYTES", 100)
    cut = quality.encode([text, b"", b"one"])
    assert set(cut[0].tolist()) == {0, 1, 2} and len(cut[0]) > len(bag) and (np.diff(cut[0]) >= 0).all()
    assert len(quality.encode([])[0]) == 0


def test_learns_one_bad_passage():
    rng = np.random.default_rng(1)
    bags, y = [], []
    for k in range(300):
        x = rng.normal(0, 1, (rng.integers(2, 12), 10)).astype(np.float32)
        if k % 3 == 0:
            x[rng.integers(len(x)), 0] = 6
        bags.append(x)
        y.append(k % 3 != 0)
    number = lambda b: np.repeat(np.arange(len(b)), [len(v) for v in b])
    model = quality.fit(np.concatenate(bags[:200]), number(bags[:200]), np.array(y[:200], float), epochs=60)
    logit, state = model.bags(np.concatenate(bags[200:]), number(bags[200:]))
    assert np.mean((logit > 0) == np.array(y[200:])) > 0.85
    assert np.allclose(np.add.reduceat(state["a"], state["first"]), 1, atol=1e-5)


def test_odd_rows(spark):
    docs = local_table(spark, [(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (3, "", None)], "doc_id long, text string, score string")
    none = local_table(spark, [], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert model.constant == 1.0
    assert docs.select(quality.score(F.col("text"), model)).count() == 4
    labels = local_table(spark, [(i, i % 2) for i in range(1, 40)] + [(None, 1), (2, None), (1, 7)], "doc_id long, quality int")
    many = local_table(spark, [(i, "GOOD!! " * 20 if i % 2 else "fine words here. " * 9, "x") for i in range(1, 40)] + [(None, None, None), (50, "", "")], "doc_id long, text string, score string")
    model = quality.train(many, labels)
    got = many.withColumn("_p", quality.score(F.col("text"), model)).collect()
    assert got[-1]["_p"] == got[-2]["_p"] and got[0]["_p"] > 0.7 > got[1]["_p"]
    assert quality.score(F.col("text"), model) is not None and many.limit(0).select(quality.score(F.col("text"), model)).count() == 0


def test_scores_depend_on_the_text_alone(monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 700))).encode() for _ in range(60)] + [b"", b"a b", b"a b c a b c"]
    bag, x = quality.encode(texts)
    model = quality.fit(x, bag, np.arange(len(texts)) % 2 * 1.0, epochs=3)
    alone = np.concatenate([model.score([t]) for t in texts])
    assert np.array_equal(model.score(texts), alone) and np.array_equal(model.score(texts[::-1])[::-1], alone)
    whole = 1 / (1 + np.exp(-model.bags(x, bag)[0]))
    assert np.allclose(alone, whole, atol=1e-9)
    # a running softmax over pieces, and repeats known from earlier pieces
    long = (" ".join(rng.choice(words, 300)) + " ").encode() * 3
    monkeypatch.setattr(quality, "GROUP_BYTES", 400)
    bag, x = quality.encode([b"x y z", long, b"x y z"])
    logit, _ = model.bags(x, bag)
    assert np.allclose(model.score([b"x y z", long, b"x y z"]), 1 / (1 + np.exp(-logit)), atol=1e-9)
    late = x[bag == 1][-3:, 13 + 5]
    assert (late > 0.9).all() and not x[bag == 2][0, 13 + 5]


def test_training_takes_whole_documents(spark):
    docs = local_table(spark, [(i, ("good words here. " if i % 2 else "BAD!! ") * (400 if i == 7 else 40)) for i in range(1, 30)], "doc_id long, text string")
    labels = local_table(spark, [(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    seen = []
    keep = quality.fit
    try:
        quality.fit = lambda x, bag, y, **k: seen.append(np.bincount(bag)) or keep(x, bag, y, epochs=1)
        quality.train(docs, labels)
        quality.train(docs, labels, passages=12)
    finally:
        quality.fit = keep
    sizes, few = seen
    assert sizes.max() in (2, 19) and few.sum() <= 12 and len(few) >= 6


def test_neighbours_in_a_batch_leave_no_trace():
    texts = [b"one two", b"", b"  three one two", b"\n", b"one two", b"a b c", b"a b c"]
    bag, x = quality.encode(texts)
    for k, t in enumerate(texts):
        assert np.array_equal(x[bag == k], quality.encode([t])[1])
