"""WARC derivatives: links between records, digests, plain text, files written and read again."""

import hashlib
import html
import re

from pyspark.sql import functions as F

from reliefgrid.llm import warc
from reliefgrid.llm.queries import QUERIES
from reliefgrid.runtime import local_table, scratch_path

sha = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()


def brute_text(page):
    page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style|title)[^>]*>.*?</\1>", "", page)
    parts = re.split(r"</?(?:html|body|head|nav|ul|li|div|article|h1|p|footer|meta)\b[^>]*>", page)
    parts = [" ".join(html.unescape(re.sub(r"</?(?:a|b)\b[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in parts if x)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {(r.page_id, r.warc_type): r for r in QUERIES["op1_warc_derivatives"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == 2 * len(pages) == len({r.record_id for r in rows.values()})
    for p in pages:
        body = (p.html or "").encode()
        meta, text = rows[p.page_id, "metadata"], rows[p.page_id, "conversion"]
        assert meta.refers_to == text.refers_to and meta.target_uri == text.target_uri == p.url
        assert meta.payload_digest == text.payload_digest == sha(body)
        for r in (meta, text):
            assert r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
        lines = meta.block.split("\r\n")
        assert f"source-record-id: {meta.refers_to}" in lines and "payload-digest-holds: true" in lines
        assert f"source-warc-WARC-Payload-Digest: {sha(body)}" in lines and f"source-http-Content-Length: {len(body)}" in lines
        assert [v for v in lines if v.startswith("outlink: ")] == ["outlink: " + u for u in re.findall(r'<a href="([^"]*)"', p.html)]
        assert text.block == brute_text(p.html)


def test_files_round_trip(spark):
    path = scratch_path(spark, "warc")
    made = warc.derivatives(warc.page_responses(local_table(spark, [(k, f"http://x/{k}", f"<p>é {k}\r\n\r\nb</p>") for k in range(20)], "page_id long, url string, html string"), "2024-01-01T00:00:00Z"))
    warc.write_warc(made.repartition(3), path)
    back = warc.read_warc(spark, path)
    assert back.count() == 40 and back.filter("complete").count() == 40
    got = {(warc_id, bytes(b).decode()) for warc_id, b in back.select(warc.header(F.col("headers"), "WARC-Record-ID"), "block").collect()}
    assert got == {(r.record_id, r.block) for r in made.collect()}
    raw = scratch_path(spark, "warc")
    body = "HTTP/1.1 200 OK\r\nX-A: b\r\n\r\n<p>hello</p>"
    one = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: {len(body)}\r\n\r\n{body}"
    spark.createDataFrame([(one,)], "value string").write.option("lineSep", "\r\n\r\n").text(raw)
    found = {r.warc_type: r for r in warc.derivatives(warc.responses(warc.read_warc(spark, raw))).collect()}
    assert found["conversion"].block == "hello" and found["conversion"].refers_to == "<urn:uuid:1>"
    assert "payload-digest-holds: false" in found["metadata"].block and "source-http-X-A: b" in found["metadata"].block


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "http://a\r\nX: y", "", 1), (1, "http://a", "plain", 1), (1, "http://a", "plain", 1)]
    pages = local_table(spark, rows, "page_id long, url string, html string, block long")
    got = warc.derivatives(warc.page_responses(pages), ["page_id"]).collect()
    assert len(got) == 8 and sorted(r.block for r in got if r.warc_type == "conversion") == ["", "", "plain", "plain"]
    assert all("\r\nX:" not in (r.target_uri or "") for r in got)
    assert warc.derivatives(warc.page_responses(pages.limit(0))).count() == 0
    bare = local_table(spark, [(None, None, None, None, None, None)], "record_id string, target_uri string, date string, headers string, http string, payload binary")
    assert {r.warc_type: r.content_length for r in warc.derivatives(bare).collect()}["conversion"] == 0
    binary = bare.select(*bare.columns[:5], F.lit(b"<p>\xff</p>").alias("payload"))
    assert [r.block for r in warc.derivatives(binary).collect() if r.warc_type == "conversion"] == ["�"]


def test_other_version_and_embedded_records(spark, tmp_path):
    inner = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 70000\r\n\r\nin the payload"
    blocks = [
        b"HTTP/1.1 200 OK\r\n\r\n<p>one</p>",
        b"HTTP/1.1 200 OK\r\n\r\n<p>two</p>\r\n\r\n" + inner + b"\r\n\r\n" + inner + b"\xff",
        b"",
        inner,
        b"WARC/1.1 begins it\r\n\r\nWARC/1.WARC/1.",
        "é last".encode(),
    ]

    def record(version, k, block, length=None):
        lines = f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
        return lines.encode() + block + b"\r\n\r\n"

    for version in ("1.0", "1.1"):
        (tmp_path / f"{version}.warc").write_bytes(b"".join(record(version, f"{version}-{k}", b) for k, b in enumerate(blocks)))
    (tmp_path / "mixed.warc").write_bytes(b"".join(record("1.%d" % (k % 2), f"m-{k}", b) for k, b in enumerate(blocks)))
    (tmp_path / "short.warc").write_bytes(record("1.0", "s-0", b"wrong length", 500) + record("1.0", "s-1", b"good") + record("1.0", "s-2", b"cut off", 90))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in (old, "64"):  # whole files, and files split between tasks
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            rows = warc.read_warc(spark, str(tmp_path)).select(warc.header(F.col("headers"), "WARC-Record-ID").alias("id"), "headers", "block", "complete").collect()
            assert all(r.headers.startswith("WARC-Type: response") for r in rows)
            got = {r.id: (bytes(r.block), r.complete) for r in rows}
            want = {f"<urn:{v}-{k}>": (b, True) for v in ("1.0", "1.1", "m") for k, b in enumerate(blocks)}
            assert len(rows) == len(got) == len(want) + 3 and want.items() <= got.items()
            assert [got[f"<urn:s-{k}>"][1] for k in range(3)] == [False, True, False] and got["<urn:s-1>"][0] == b"good"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_links_title_and_charset(spark):
    page = """<title>A &amp; B\n C</title><a href=/x>1</a><a class='k' href="/it's">2</a><A HREF='/q?a=1&amp;b=&#50;'>3</A><!-- <a href="/no"> -->
    <script>var s = '<a href="/no">';</script><a name="top">4</a><a href=" /sp\nace ">5</a><a title="x > y" href="/z">6</a>"""
    assert warc.outlinks(page) == ["/x", "/it's", "/q?a=1&b=2", "/space", "/z"] and warc.page_title(page) == "A & B C"
    rows = [("<urn:uuid:1>", "u", None, "WARC-Type: response", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={c}", "<p>größe</p>".encode(e)) for c, e in (("ISO-8859-1", "latin-1"), ("utf-8", "utf-8"), ("nonsense", "utf-8"))]
    rows.append(("<urn:uuid:2>", "u", None, None, None, "<p>größe</p>".encode()))
    frame = local_table(spark, rows, "record_id string, target_uri string, date string, headers string, http string, payload binary")
    assert [r.block for r in warc.derivatives(frame).filter("warc_type = 'conversion'").collect()] == ["größe"] * 4
