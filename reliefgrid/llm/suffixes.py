"""Repeated passages by sparse suffix arrays.

Of every text only the suffixes at minimiser positions are kept: in each run of ``LENGTH`` words the
leftmost of the smallest hashes of ``ANCHOR`` words. The choice depends on the run's words alone, so equal
runs keep the same suffix wherever they stand. The kept suffixes are range-partitioned and sorted by their first
``HEAD`` words, the words up to ``ANCHOR``, and their text; words are ordered by hash. Neighbours are compared in one pass over
each partition (:func:`neighbours`): a suffix without ``ANCHOR`` words in common with a suffix of another text is done. The
others are extended to the left and right, to the runs of ``LENGTH`` words that they stand in; those are sorted and
compared in the same way, and the runs that another text has too are joined to the longest spans. So a span is exactly
the union of the runs of ``LENGTH`` words that another document holds as well, whatever else it repeats.

A suffix that very many texts share fills several partitions of the sort, which are split by text; what spans a border is
settled from the first and last row of each partition. No group is collected anywhere.

Results: words are parted by ASCII white space, and compared as they are; null and short texts have no
spans; a text that another row repeats is one span from end to end; rows of the same id and text count as
copies; null ids are kept; an empty table gives an empty one; other columns are not looked at. Texts are
told apart by 64 bits of hash, runs of words as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.llm.tables import saved, whole_text
from reliefgrid.runtime import local_table

#: Words of the shortest passage, of the part that suffixes are compared by, and of the first part of their order.
LENGTH = 50
ANCHOR = 26
HEAD = 4
#: Runs whose smallest hash is looked for at a time.
CHUNK = 1 << 18
#: Kinds of rows that a partition of the sort hands on.
SHARED, OPEN, EDGE, EDGE_SHARED = 0, 1, 2, 3
WORD = r"[^\x20\x09-\x0D]+"
_BASE = 0x9E3779B97F4A7C15


def word_hashes(text: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, text.split()), np.uint64)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, from sums of a polynomial modulo 2**64."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(len(words), _BASE, np.uint64))
    back = np.cumprod(np.full(len(words), pow(_BASE, -1, 1 << 64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)])
    h = (total[n:] - total[:-n]) * back[: len(words) - n + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def minimisers(anchors: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` hashes the place of its leftmost smallest one."""
    n = len(anchors) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(anchors, width)
    return np.concatenate([np.arange(lo, min(n, lo + CHUNK)) + view[lo : lo + CHUNK].argmin(axis=1) for lo in range(0, n, CHUNK)])


def repeated_passages(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``start_word`` (from 0) and ``n_words`` of every span that another document has too."""
    width = length - anchor + 1
    text = whole_text(text_col)
    key = F.xxhash64(F.md5(text)).alias("_text")
    ids = saved(docs.select(F.col(id_col).alias("doc_id"), key, F.regexp_count(text, F.lit(WORD)).alias("_words")), "ids")
    copies = ids.groupBy("_text").agg(F.count("*").alias("_copies"), F.max("_words").alias("_words"))
    whole = copies.filter((F.col("_copies") > 1) & (F.col("_words") >= length)).select("_text", F.lit(0).alias("start_word"), F.col("_words").alias("n_words"))

    def kept(batches):
        for b in batches:
            for k, t in zip(b.column("_text"), b.column("_t")):
                words = word_hashes(t.as_py())
                anchors = run_hashes(words, anchor)
                places = np.unique(minimisers(anchors, width))
                if len(places):
                    first = first_words(words)[places]
                    yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(anchors[places].view(np.int64)), pa.array(np.full(len(places), k.as_py())), pa.array(places.astype(np.int32))], names=["_head", "_h", "_text", "_place"])

    suffixes = saved(docs.select(key, text.cast("binary").alias("_t")).mapInArrow(kept, "_head bigint, _h bigint, _text bigint, _place int"), "suffixes")
    places = neighbours(suffixes, ["_head", "_h"], "_place").groupBy("_text").agg(F.collect_set("_place").alias("_places"))
    # map-side, so that the copies of a text are not sent
    texts = docs.select(key, text.alias("_t")).groupBy("_text").agg(F.first("_t").cast("binary").alias("_t"))

    def extended(batches):
        for b in batches:
            for k, t, p in zip(b.column("_text"), b.column("_t"), b.column("_places")):
                words = word_hashes(t.as_py())
                at = minimisers(run_hashes(words, anchor), width)
                starts = np.nonzero(np.isin(at, np.array(p.as_py())))[0]
                h = run_hashes(words, length)[starts]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(starts), k.as_py())), pa.array(starts.astype(np.int32))], names=["_h", "_text", "_start"])

    runs = saved(texts.join(places, "_text").select("_text", "_t", "_places").mapInArrow(extended, "_h bigint, _text bigint, _start int"), "runs")
    found = neighbours(runs, ["_h"], "_start")
    before = Window.partitionBy("_text").orderBy("_start")
    fresh = F.coalesce(F.col("_start") > F.lag("_start").over(before) + length, F.lit(True)).cast("int")
    parts = found.withColumn("_new", fresh).withColumn("_part", F.sum("_new").over(before))
    spans = parts.groupBy("_text", "_part").agg(F.min("_start").alias("start_word"), (F.max("_start") + length - F.min("_start")).alias("n_words"))
    spans = spans.select("_text", "start_word", "n_words").join(whole.select("_text"), "_text", "left_anti").unionByName(whole)
    return ids.select("doc_id", "_text").join(spans, "_text").select("doc_id", "start_word", "n_words")


def first_words(words: np.ndarray) -> np.ndarray:
    """For every place its first ``HEAD`` words as one number that sorts like them (16 bits of each hash)."""
    short = np.concatenate([words >> np.uint64(48), np.zeros(HEAD, np.uint64)])
    key = np.zeros(len(words), np.uint64)
    for k in range(HEAD):
        key = (key << np.uint64(16)) | short[k : k + len(words)]
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def neighbours(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """``_text`` and ``place`` of the rows whose ``keys`` stand in another text too.

    The rows are sorted over range partitions by keys, text and place. Equal keys are one stretch, ordered by text, so a
    stretch whose first and last text differ is shared. One of a single text that ends at the border of its partition is left
    open, and kept if the neighbouring partitions hold another text of it; they are known by their first and last rows.
    """
    order = [*keys, "_text", place]

    def run(batches):
        number = TaskContext.get().partitionId()
        held: list[np.ndarray] | None = None  # the stretch that goes on: its rows so far, or one row if it is shared
        shared = start = True
        edges: list[tuple] = []

        def made(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
            n = len(columns[0])
            arrays = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, number, np.int32)), *(pa.array(c.astype(np.int64)) for c in columns)]
            return pa.RecordBatch.from_arrays(arrays, names=["_kind", "_p", *order])

        for b in batches:
            columns = [b.column(c).to_numpy(zero_copy_only=False) for c in order]
            if not len(columns[0]):
                continue
            if held is None:
                yield made(EDGE, [c[:1] for c in columns])
                shared = False
            else:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            n, told = len(columns[0]), 1 if held is not None and shared else 0
            new = np.concatenate([[True], np.logical_or.reduce([columns[i][1:] != columns[i][:-1] for i in range(len(keys))])])
            begin = np.nonzero(new)[0]
            end = np.append(begin[1:], n) - 1
            two = columns[len(keys)][begin] != columns[len(keys)][end]
            two[0] |= bool(told)
            keep = np.repeat(two, end - begin + 1)
            keep[:told] = False  # the row that stands for those handed on before
            last = begin[-1]
            settled = keep.copy()
            settled[last:] &= two[-1]
            if settled.any():
                yield made(SHARED, [c[settled] for c in columns])
            if start and len(begin) > 1:
                yield made(EDGE_SHARED, [c[:1] for c in columns]) if two[0] else made(OPEN, [c[: begin[1]] for c in columns])
            start = start and len(begin) == 1
            shared = bool(two[-1])
            held = [c[-1:] if shared else c[last:] for c in columns]
        if held is not None:
            yield made(EDGE_SHARED if shared else EDGE, [c[-1:] for c in held])
            if not shared:
                yield made(OPEN, held)

    schema = "_kind int, _p int, " + ", ".join(f"`{c}` bigint" for c in order)
    sorted_ = rows.select(*[F.col(c).cast("long").alias(c) for c in order]).repartitionByRange(*order).sortWithinPartitions(*order)
    marked = saved(sorted_.mapInArrow(run, schema), "neighbours")
    texts: dict[tuple, set[int]] = {}
    for r in marked.filter(F.col("_kind") >= EDGE).collect():  # three rows a partition at most
        texts.setdefault(tuple(r[c] for c in keys), set()).update((r["_text"], None) if r["_kind"] == EDGE_SHARED else (r["_text"],))
    across = local_table(rows.sparkSession, [k for k, v in texts.items() if len(v) > 1], ", ".join(f"`{c}` bigint" for c in keys))
    opened = marked.filter(F.col("_kind") == OPEN).join(F.broadcast(across), keys, "left_semi")
    out = marked.filter(F.col("_kind") == SHARED).select("_text", place).unionByName(opened.select("_text", place))
    return out.withColumn(place, F.col(place).cast("int"))
