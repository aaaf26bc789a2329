"""The pipeline stage by stage on a small table."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from __spark_entry__ import queries
from reliefgrid.runtime import local_table, scratch_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        ids[name] = {r.doc_id for r in rows}
        assert ids[name] <= set(before) and len(ids[name]) == len(rows) and all(before[r.doc_id] == r.text for r in rows)
        assert docs.columns[: len(columns)] == columns and (name == "shard" or docs.columns == columns)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0}
    assert len(bad & ids["quality"]) <= 0.1 * len(bad)
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in words(r.text) for r in rows for i in items)
    per = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        per[r.text].add(r.doc_id)
    assert all(len(v & ids["near_dedup"]) <= 1 for v in per.values())
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1
    assert queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double"
    rows = [(None, None, None, None, None, None, None)] * 2 + [(1, "a b c", "en", "s", 5, "x", 1.0)] * 2 + [(2, "", "en", None, 0, None, None)]
    for frame in (local_table(spark, rows, schema), local_table(spark, [], schema)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, frame, SF)
            assert set(frame.columns) <= set(out.columns)
            frame = spark.createDataFrame(out.collect(), out.schema)
        assert frame.count() <= 3
