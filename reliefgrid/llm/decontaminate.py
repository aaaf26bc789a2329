"""Benchmark decontamination by SimHash windows, DataFrame functions only.

A document leaks an item if a window of it with as many shingles as the item (the whole text where it
has fewer) reaches ``similarity`` to the item. Words are runs of letters and digits in lower case,
shingles five words (texts with fewer: all of them), similarity the weighted Jaccard index, the weight
of a shingle being its number of occurrences.

1. Shingle hashes of all documents meet those of the benchmark. A window that reaches the similarity
   holds at least ``need`` of the item's shingles, which bounds the windows worth a fingerprint; none
   that could pass is left out.
2. Those windows get a SimHash. Multi-index blocks find the items: fingerprints within ``radius`` bits
   agree in at least one of ``radius + 1`` blocks, so joining on block values misses none.
3. The exact weighted similarity verifies the candidates; the best window of each item is returned. Pairs
   whose fingerprints lie further apart, but which share enough shingles by step 1, are verified as well, so the
   radius loses none.

Results: null texts count as empty; texts and items without words leak nothing; repeated rows of a
document, and repeated rows of an item, give one row; null ids are kept as null; an empty table gives
an empty result; among equally similar windows the first counts. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.tables import whole_text
from reliefgrid.runtime import cut

SHINGLE = 5
SIMILARITY = 0.8
#: Bits; a pair at similarity 0.8 differs in 10 of 64 on average, and seldom in over 20 (those are verified apart).
RADIUS = 20
#: A benchmark of at most so many distinct shingles is broadcast (12 MB); a larger one is joined by shuffle.
BROADCAST_SHINGLES = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_SHINGLES) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


WORD = r"[\p{L}\p{N}]+"


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """Hashes of the text's shingles in order; none if it has no words.

    The word hashes are bound to a lambda variable: as a column of their own, an inferred filter could
    repeat them inside the lambda, once per shingle.
    """
    hashes = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        short = F.array(F.xxhash64(F.concat_ws(",", h.cast("array<string>"))))
        return F.when(F.size(h) >= words, each).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(hashes), of), F.lit(0))


def needed(size: Column, item: Column, similarity: float) -> Column:
    """Shared shingles (with repeats) that two bags of these sizes need for the similarity."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (size + item) - F.lit(1e-9)).cast("int")


def simhash_of(windows: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """SimHash of the hashes of each key: 64 sums that are combined before the shuffle."""
    sums = [F.sum(F.shiftright(hash_col, b).bitwiseAND(1)).alias(f"_b{b}") for b in range(64)]
    counted = windows.groupBy(*keys).agg(F.count("*").alias("_k"), *sums)
    bits = [F.when(F.col(f"_b{b}") * 2 > F.col("_k"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(0) for b in range(64)]
    return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def blocks(fp: Column, radius: int) -> Column:
    """(block number, value) of the ``radius + 1`` blocks of a fingerprint."""
    n = radius + 1
    ends = [64 * k // n for k in range(n + 1)]
    cells = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND((1 << (hi - lo)) - 1).alias("value")) for k, (lo, hi) in enumerate(zip(ends, ends[1:]))]
    return F.array(*cells)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_key``, ``doc_id``, ``item_id``, ``start`` (words before the window), ``n_words``, ``hamming``, ``similarity``.

    ``doc_key`` is :func:`doc_key` of the document, for joining the result back to rows.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.xxhash64(item_col, whole_text(item_text)).alias("_item"), shingle_hashes(whole_text(item_text), words).alias("_g"))
    items = cut(items.filter("size(_g) > 0").select("item_id", "_item", F.size("_g").alias("_size"), "_g").distinct())
    in_items = items.select("item_id", "_item", "_size", F.explode("_g").alias("_s"))
    counts = cut(in_items.groupBy("item_id", "_item", "_size", "_s").agg(F.count("*").alias("_ci")))
    known = bounded(counts.select("_item", F.col("_size").alias("_is"), "_s"))

    texts = docs.select(doc_key(id_col, text_col).alias("doc_key"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("_t"))
    arrays = texts.select("doc_key", "doc_id", "_t", shingle_hashes(F.col("_t"), words).alias("_g"))
    # outer, as an inner explode would add a filter that hashes every text a second time
    met = arrays.select("doc_key", F.size("_g").alias("_dn"), F.posexplode_outer("_g").alias("_pos", "_s")).join(known, "_s")
    spots = met.groupBy("doc_key", "_dn", "_item", "_is").agg(F.array_sort(F.collect_set("_pos")).alias("_p"))
    spots = spots.withColumn("_size", F.least("_dn", "_is"))
    spots = cut(spots.withColumn("_need", needed(F.col("_size"), F.col("_is"), similarity)).filter("_need <= _size and _need <= size(_p)"))
    # windows that hold enough of the item's shingles: the first of them at p, the others within reach
    slack = F.col("_size") - F.col("_need")
    first = F.filter("_p", lambda p, i: F.get("_p", i + F.col("_need") - 1) - p < F.col("_size"))
    starts = F.transform(first, lambda p: F.sequence(F.greatest(p - slack, F.lit(0)), F.least(p, F.col("_dn") - F.col("_size"))))
    starts = F.array_distinct(F.flatten(F.filter(starts, lambda s: F.size(s) > 0)))
    counted = cut(spots.select("doc_key", "_is", "_size", "_item", F.explode_outer(starts).alias("_start")).filter("_start is not null").distinct())
    windows = cut(counted.select("doc_key", "_is", "_size", "_start").distinct())

    own = arrays.join(bounded(windows.select("doc_key").distinct()), "doc_key", "left_semi").groupBy("doc_key")
    own = own.agg(F.first("doc_id").alias("doc_id"), F.first(F.regexp_count("_t", F.lit(WORD))).alias("_n"), F.first("_g").alias("_g"))
    inside = F.slice("_g", F.col("_start") + 1, F.col("_size"))
    filled = windows.join(own, "doc_key").select("doc_key", "doc_id", "_n", "_is", "_size", "_start", F.explode_outer(inside).alias("_s"))
    at = ["doc_key", "_is", "_start"]
    filled = cut(filled.groupBy(*at, "doc_id", "_n", "_size", "_s").agg(F.count("*").alias("_cw")))
    prints = cut(simhash_of(filled.select(*at, F.explode(F.array_repeat("_s", F.col("_cw").cast("int"))).alias("_s")), at, "_s"))
    item_prints = cut(simhash_of(in_items.withColumnRenamed("_size", "_is"), ["_item", "_is"], "_s"))
    left = prints.select(*at, "fp", F.inline(blocks(F.col("fp"), radius)))
    right = item_prints.select("_item", F.col("_is").alias("_ris"), F.col("fp").alias("_rfp"), F.inline(blocks(F.col("fp"), radius)).alias("_rb", "_rv"))
    pairs = left.join(bounded(right), (F.col("_is") == F.col("_ris")) & (F.col("block") == F.col("_rb")) & (F.col("value") == F.col("_rv")))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("_rfp"))).alias("hamming")
    pairs = cut(pairs.select(*at, "_item", far).filter(F.col("hamming") <= radius).distinct())
    # what the counts allow beyond the radius
    rest = counted.select(*at, "_item").join(pairs, [*at, "_item"], "left_anti").join(prints, at)
    rest = rest.join(bounded(item_prints.select("_item", F.col("fp").alias("_rfp"))), "_item")
    pairs = pairs.unionByName(rest.select(*at, "_item", far))

    # exact weighted similarity
    c = counts.select("item_id", "_item", "_s", "_ci")
    shared = pairs.join(filled, at).join(bounded(c), ["_item", "_s"])
    shared = shared.groupBy(*at, "item_id", "_item", "hamming", "doc_id", "_n", "_size").agg(F.sum(F.least("_cw", "_ci")).alias("_both"))
    sim = F.col("_both") / (F.col("_size") + F.col("_is") - F.col("_both"))
    found = shared.withColumn("similarity", sim).filter(F.col("similarity") >= similarity - 1e-12)
    found = found.withColumn("n_words", F.when(F.col("_n") < words, F.col("_n")).otherwise(F.col("_size") + words - 1))
    best = found.groupBy("doc_key", "doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("_start").alias("start"), "n_words", "hamming")).alias("_m"))
    return best.select("doc_key", "doc_id", "item_id", "_m.start", "_m.n_words", "_m.hamming", (-F.col("_m.s")).alias("similarity"))


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Key of a document's text under its id."""
    return F.xxhash64(F.col(id_col), whole_text(text_col))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = cut(leaks(docs, benchmark, **options).select(F.col("doc_key").alias("_leak")).distinct())
    # the key is packed beside the row, so that no column of it can clash
    rows = docs.select(doc_key(id_col, text_col).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(found, F.col("_key") == F.col("_leak"), "left_anti").select("_row.*")
