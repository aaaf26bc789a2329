"""Derivatives of WARC responses: linked metadata records and plain-text conversion records.

Each response gives two records that name it in WARC-Refers-To: ``metadata`` (application/warc-fields)
with the source's WARC and HTTP header lines, its payload's digest and whether a declared digest holds,
title and links; and ``conversion`` (text/plain) with the visible text, one block a line. Target URI and
date are kept, block digests are of the new blocks, record ids follow from the source's id, so a second
run gives the same records.

Results: a null payload is empty and gives an empty conversion; null URI, date or headers leave their
lines out; a null record id gives records without WARC-Refers-To; repeated responses give repeated
records; an empty table gives an empty one. Line breaks in header values become spaces. Payloads are read in the
charset of their Content-Type, else as UTF-8, what doesn't decode is replaced; digests are of the bytes as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.llm.blocks import attributes, blocks, elements
from reliefgrid.llm.tables import saved

END = "\r\n\r\n"
VERSION = "WARC/1.1"
#: What records of all read versions begin with.
MARK = "WARC/1."


def urn(*parts: Column) -> Column:
    """A record id made from the sha256 of ``parts`` (an RFC 9562 version 8 UUID)."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def header(lines: Column, name: str) -> Column:
    """Value of the first header of that name, null if there is none."""
    found = F.regexp_extract(lines, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(F.regexp_like(lines, F.lit(rf"(?im)^{name}:")), found)


def plain_text(page: str) -> str:
    """Visible text of a page, one block a line."""
    return "\n".join(b.text for b in blocks(page, named=False))


def decoded(data: bytes, charset: str | None) -> str:
    """The payload's text in the charset that its headers name; UTF-8 if that is none."""
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def outlinks(page: str) -> list[str]:
    """Targets of the page's links in order, references decoded, without white space around them or line breaks."""
    found = (attributes(raw).get("href", "") for raw in elements(page, "a"))
    return [link for link in (re.sub(r"[\r\n\t]", "", f).strip() for f in found) if link]


def page_title(page: str) -> str:
    m = re.search(r"<title[^>]*>(.*?)</title", page, re.S | re.I)
    return " ".join(html.unescape(m[1]).split()) if m else ""


def page_parts(payload: Column, http: Column) -> Column:
    """``text``, ``title`` and ``links`` of a payload."""

    @F.pandas_udf("text string, title string, links array<string>")
    def run(pages: pd.Series, charsets: pd.Series) -> pd.DataFrame:
        texts = [decoded(b, c or None) for b, c in zip(pages, charsets)]
        return pd.DataFrame({"text": [plain_text(t) for t in texts], "title": [page_title(t) for t in texts], "links": [outlinks(t) for t in texts]})

    charset = F.regexp_extract(F.coalesce(http, F.lit("")), r"(?im)^content-type:[^\r\n]*?charset=[\"']?([\w.:-]+)", 1)
    return run(payload, charset)


def page_responses(pages: DataFrame, date: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as responses: a response record with a record id, headers and digest for every row."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload))
    base = pages.select(
        F.col(id_col).alias("page_id"),
        urn(F.lit("response"), F.col(id_col).cast("string"), F.col(url_col)).alias("record_id"),
        F.regexp_replace(F.col(url_col), r"[\r\n]+", " ").alias("target_uri"),
        F.lit(date).cast("string").alias("date"),
        http.alias("http"),
        payload.alias("payload"),
    )
    lines = _lines(("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Payload-Digest", digest(F.col("payload"))))
    return base.withColumn("headers", lines)


def _lines(*fields: tuple[str, Column], prefix: str = "") -> Column:
    """``name: value`` lines; a null value leaves its line out."""
    return F.concat_ws("\r\n", *[F.concat(F.lit(f"{prefix}{k}: "), v) for k, v in fields])


def derivatives(responses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep``, then ``warc_type``, ``record_id``, ``refers_to``, ``target_uri``, ``date``, ``content_type``,
    ``payload_digest`` (of the source), ``block_digest``, ``content_length`` and ``block`` of the two records of each response.

    ``responses`` has ``record_id``, ``target_uri``, ``date``, ``headers`` and ``http`` (raw header lines) and ``payload`` (binary).
    """
    payload = F.coalesce(F.col("payload"), F.lit("").cast("binary"))
    actual = digest(payload)
    declared = header(F.col("headers"), "WARC-Payload-Digest")
    # only digests of the same algorithm can be compared
    holds = F.when(declared.isNull() | ~F.startswith(F.lower(declared), F.lit("sha256:")), "unknown").when(F.lower(declared) == actual, "true").otherwise("false")
    responses = responses.withColumn("_page", page_parts(payload, F.col("http")))
    title = F.col("_page.title")
    links = F.transform(F.col("_page.links"), lambda u: F.concat(F.lit("outlink: "), u))
    told = lambda c, prefix: F.transform(F.filter(F.split(c, r"\r?\n"), lambda v: v != ""), lambda v: F.concat(F.lit(prefix), v))
    fields = F.concat_ws(
        "\r\n",
        _lines(("source-record-id", F.col("record_id")), ("payload-digest", actual), ("payload-digest-holds", holds), ("payload-length", F.octet_length(payload).cast("string")), ("title", title)),
        told(F.col("headers"), "source-warc-"),
        told(F.col("http"), "source-http-"),
        links,
    )
    both = responses.select(
        *[F.col(k) for k in keep],
        F.col("record_id").alias("refers_to"),
        F.regexp_replace("target_uri", r"[\r\n]+", " ").alias("target_uri"),
        F.col("date"),
        actual.alias("payload_digest"),
        F.array(
            F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(fields, F.lit("\r\n")).alias("block")),
            F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_page.text").alias("block")),
        ).alias("_two"),
    )
    each = both.select(*keep, "refers_to", "target_uri", "date", "payload_digest", F.inline_outer("_two"))
    identity = urn(F.col("warc_type"), F.coalesce("refers_to", "target_uri"), F.col("payload_digest"))
    return each.select(
        *keep, "warc_type", identity.alias("record_id"), "refers_to", "target_uri", "date", "content_type", "payload_digest",
        digest(F.col("block").cast("binary")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"), "block",
    )


def record_text(records: DataFrame) -> DataFrame:
    """``value``: each record as it stands in a file, but for the two line breaks that end it."""
    lines = _lines(
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    )
    return records.select(F.concat(F.lit(f"{VERSION}\r\n"), lines, F.lit(END), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files in the folder ``path``, one per partition, on any store Spark writes to."""
    record_text(records).write.option("lineSep", END).option("compression", compression).mode("errorifexists").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``headers`` (raw lines), ``block`` (binary) and ``complete`` of every record of WARC files, version 1.0 or 1.1.

    Files are cut wherever one record could end and the next begin, and Content-Length decides: a part that
    falls short of it is put together with those that follow, if it ends where one of them ends.
    ``complete`` is false if its length is missing or no end in the file agrees with it. Uncompressed files
    are split between tasks; of a file only the lengths of its parts meet in one task.
    """
    raw = spark.read.option("lineSep", END + MARK).format("text").load(path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_row")]
    raw = saved(raw.select(*place, F.col("value").cast("binary").alias("_v")), "warc")
    # only the first part of a file has its mark
    lead = raw.groupBy("_file").agg(F.min(F.struct("_from", "_row")).alias("_lead"))
    raw = raw.join(F.broadcast(lead), "_file")
    cut = F.when((F.struct("_from", "_row") == F.col("_lead")) & (F.substring(F.col("_v"), 1, len(MARK)) == F.lit(MARK.encode())), len(MARK)).otherwise(0)
    raw = raw.select("_file", "_from", "_row", F.substring(F.col("_v"), cut + 1, F.lit(2**31 - 1)).alias("_v"))
    lines = F.substring_index(F.col("_v").cast("string"), END, 1)
    need = F.octet_length(lines) + len(END) + header(lines, "Content-Length").cast("long")
    sizes = raw.select("_file", "_from", "_row", F.octet_length("_v").cast("long").alias("_size"), need.alias("_need"))

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(["_from", "_row"])
        size, wanted = parts["_size"].tolist(), parts["_need"].astype("Int64").tolist()
        first, at = list(range(len(size))), 0
        while at < len(size):
            last, have = at, size[at]
            if not pd.isna(wanted[at]):
                while have < wanted[at] and last + 1 < len(size):
                    last += 1
                    have += len(END + MARK) + size[last]
                if have != wanted[at] and not (last + 1 == len(size) and have == wanted[at] + len(END)):
                    last = at
            first[at : last + 1] = [at] * (last + 1 - at)
            at = last + 1
        parts = parts.assign(_first=first, _no=range(len(first)))
        return parts[parts["_first"].duplicated(keep=False)][["_file", "_from", "_row", "_first", "_no"]]

    found = saved(sizes.groupBy("_file").applyInPandas(joined, "_file string, _from bigint, _row bigint, _first bigint, _no bigint"), "warc-parts")
    alone = raw.join(found, ["_file", "_from", "_row"], "left_anti").select("_v")
    several = raw.join(found, ["_file", "_from", "_row"]).groupBy("_file", "_first").agg(F.sort_array(F.collect_list(F.struct("_no", F.col("_v").cast("string").alias("_v")))).alias("_parts"))
    several = several.select(F.array_join("_parts._v", END + MARK).cast("binary").alias("_v"))
    # what is left of the version, then the header lines
    lines = F.substring_index(F.col("_v").cast("string"), END, 1)
    rest = F.substring(F.col("_v"), F.octet_length(lines) + len(END) + 1, F.lit(2**31 - 1))
    got = alone.unionByName(several).select(F.regexp_replace(lines, r"^[0-9.]*\r\n", "").alias("headers"), rest.alias("_b"))
    length = header(F.col("headers"), "Content-Length").cast("long")
    # the last record of a file still has its ending
    got = got.withColumn("block", F.when(F.octet_length("_b") == length + len(END), F.substring(F.col("_b"), F.lit(1), length.cast("int"))).otherwise(F.col("_b")))
    return got.select("headers", "block", F.coalesce(F.octet_length("block") == length, F.lit(False)).alias("complete"))


def responses(records: DataFrame) -> DataFrame:
    """The response records of :func:`read_warc` as input of :func:`derivatives`."""
    found = records.filter(F.lower(header(F.col("headers"), "WARC-Type")) == "response")
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    return found.select(
        header(F.col("headers"), "WARC-Record-ID").alias("record_id"),
        header(F.col("headers"), "WARC-Target-URI").alias("target_uri"),
        header(F.col("headers"), "WARC-Date").alias("date"),
        "headers",
        http.alias("http"),
        F.substring(F.col("block"), F.octet_length(http) + len(END) + 1, F.lit(2**31 - 1)).alias("payload"),
    )
