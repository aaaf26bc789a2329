"""Windows of documents against benchmark items, by brute force."""

import random
import re
from collections import Counter

from reliefgrid.llm import decontaminate
from reliefgrid.llm.queries import QUERIES
from reliefgrid.runtime import local_table

DOCS = "doc_id long, text string, item_id string, start string"
ITEMS = "item_id long, text string, doc_id string"


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    if not w:
        return [], 0
    return ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]), len(w)


def brute(docs, items, t=0.8):
    out = {}
    index = {}
    for i, x in items:
        for g in grams(x)[0]:
            index.setdefault(g, set()).add((i, x))
    for d, text in docs:
        g, n = grams(text)
        for i, x in {pair for v in set(g) for pair in index.get(v, ())}:
            want = Counter(grams(x)[0])
            size = min(len(g), sum(want.values()))
            for s in range(len(g) - size + 1):
                both = sum((Counter(g[s : s + size]) & want).values())
                sim = both / (size + sum(want.values()) - both)
                if sim >= t - 1e-12 and sim > out.get((d, i), (0,))[0] + 1e-12:
                    out[d, i] = (sim, s, size + 4 if n >= 5 else n)
    return out


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in QUERIES["op9_decontaminate"](spark, sf).collect()}
    assert got and got == brute(docs, items)


def test_edited_passages_and_odd_rows(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choices("abcdefghij", k=4)) for _ in range(400)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(6, 40)))) for i in range(25)]
    items += [(100, "aa bb"), (101, "aa aa aa aa aa aa aa aa aa"), (102, None), (103, " ... "), (3, items[3][1]), (None, "null id item words are here now")]
    docs = []
    for k in range(60):
        w = rnd.choice(items[:25])[1].split()
        for _ in range(k % 3):
            j = rnd.randrange(len(w))
            w[j : j + rnd.randint(0, 1)] = [rnd.choice(vocab)]
        pre, post = rnd.choices(vocab, k=rnd.randint(0, 30)), rnd.choices(vocab, k=rnd.randint(0, 30))
        docs.append((k, " ".join(pre) + "\n" + ", ".join(w).upper() + "! " + " ".join(post)))
    docs += [(200, "aa bb"), (201, "AA, bb."), (202, "aa " * 30), (203, None), (204, ""), (None, items[0][1]), (0, docs[0][1])]
    docs += [(205, "see: Null id, item words are here now"), (206, items[5][1][: len(items[5][1]) // 2])]
    frame = local_table(spark, [(d, t, "a", "b") for d, t in docs], DOCS)
    bench = local_table(spark, [(i, t, "c") for i, t in items], ITEMS)
    found = decontaminate.leaks(frame, bench).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in found}
    want = brute(docs, items)
    assert len(got) == len(found) and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1:] == want[k][1:] for k in want)
    assert {(200, 100), (201, 100), (202, 101), (None, 0), (205, None)} <= got.keys() and len(got) > 20
    near = decontaminate.leaks(frame, bench, radius=1).collect()  # what lies beyond the radius is found by the counts
    assert any(r.hamming > 1 for r in near)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in near} == got
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns
    bad = {d for d, _ in want}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.clean(frame, bench.limit(0)).count() == len(docs)


def test_no_python_in_the_plan(spark):
    sf = "/root/testdata/sf0.001"
    plan = QUERIES["op9_decontaminate"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
