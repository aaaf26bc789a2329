"""Document fingerprints from closed syncmers, DataFrame functions only.

A k-mer of code points is a closed syncmer if its smallest s-mer (by XXH64) stands at its first or last
place. That looks at nothing outside the k-mer, so the same passage has the same anchors in every text,
and the anchors of a text put together from parts are those of the parts and of the k-mers across the
seams: the edited text of a document is fingerprinted without reading its parts again. A fingerprint is
the ``SKETCH`` smallest distinct anchor hashes; two of them estimate the likeness (Jaccard index) of the
anchor sets, exactly where both texts have no more anchors than that.

Results: a null text is empty; an empty text has the empty fingerprint, two of which have likeness 1;
a text without anchors, as any shorter than k, is hashed whole; equal texts have equal fingerprints. Documents follow each
other by descending id, equal ids by the md5 of the text, those without id last, the first after the
last; repeated rows are documents of their own. An empty table gives an empty one; other columns are not
looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.llm.tables import let, whole_text

#: k = S + WINDOW - 1 code points; one k-mer in WINDOW / 2 is an anchor on average.
S, WINDOW = 9, 16
K = S + WINDOW - 1
SKETCH = 128
#: Quantiles of the ids that deal documents to ranges; inside, ranges are of equal width.
KNOTS = 256


def anchors(text: Column) -> Column:
    """Closed syncmers in order, each a long: place (from 0) times 2**32 plus 32 bits of hash."""
    smers = F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{S}}}))."), F.lit(1)), lambda x: F.xxhash64(x))

    def halves(h: Column, step: int) -> Column:
        return F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.least(a, b))

    def smallest(h: Column) -> Column:
        """Smallest of each WINDOW hashes, by doubling."""
        steps = [1 << i for i in range(WINDOW.bit_length() - 1)]
        return reduce(lambda c, step: let(c, lambda x: halves(x, step)), steps, h)

    def pick(h: Column, low: Column) -> Column:
        def at(m: Column, i: Column) -> Column:
            first, last = F.get(h, i), F.get(h, i + (WINDOW - 1))
            kmer = F.xxhash64(first, F.get(h, i + (WINDOW - 1) // 2 + 1), last)  # the three cover the k-mer
            return F.when(last.isNotNull() & ((m == first) | (m == last)), F.shiftleft(i.cast("long"), 32).bitwiseOR(kmer.bitwiseAND(0xFFFFFFFF)))

        return F.filter(F.transform(low, at), lambda a: a.isNotNull())

    return let(smers, lambda h: let(smallest(h), lambda low: pick(h, low)))


def hash_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(0xFFFFFFFF)


def place_of(anchor: Column) -> Column:
    return F.shiftright(anchor, 32).cast("int")


def sketch_of(found: Column, text: Column) -> Column:
    """The smallest distinct hashes of anchors; a text without anchors is hashed whole, an empty one has none."""
    whole = F.when(F.length(text) > 0, F.array(hash_of(F.xxhash64(text)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(found) == 0, whole).otherwise(F.slice(F.sort_array(F.array_distinct(F.transform(found, hash_of))), 1, SKETCH))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard index of two sketches; 1 for two empty ones."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return let(union, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def fingerprint(sketch: Column) -> Column:
    return F.lower(F.concat_ws("", F.transform(sketch, lambda h: F.lpad(F.hex(h), 8, "0"))))


def anchor_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``place``, ``hash`` of every anchor, for positional matching: equal hashes at a steady distance."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(anchors(whole_text(text_col))).alias("_a")).filter("_a is not null")
    return found.select("doc_id", place_of(F.col("_a")).alias("place"), hash_of(F.col("_a")).alias("hash"))


def in_ranges(rows: DataFrame, order: list[Column], number: Column) -> DataFrame:
    """Adds ``_range``, ``_guest`` and ``_rank`` (the struct of ``order``), so that rows which follow each other share a range.

    ``number`` is a long that ``order`` begins with (nulls last). The first row of each range is also a
    guest (``_guest`` 1) in the range before, and the very first row one in the last range.
    """
    spark = rows.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    knots = rows.select(number.cast("double").alias("_x")).approxQuantile("_x", [k / KNOTS for k in range(KNOTS + 1)], 1 / (4 * KNOTS))
    knots = sorted(set(knots)) or [0.0]
    inner = max(1, -(-parts // len(knots)))
    edges = F.array(*[F.lit(k) for k in knots])
    x = number.cast("double")
    knot = F.size(F.filter(edges, lambda k: k <= x))
    low, high = F.get(edges, knot - 1), F.coalesce(F.get(edges, knot), F.get(edges, knot - 1) + 1)
    inside = F.least(F.floor((x - low) / (high - low) * inner), F.lit(inner - 1))
    part = F.when(number.isNull(), (len(knots) + 1) * inner).otherwise(knot * inner + F.coalesce(inside, F.lit(0))).cast("int")
    dealt = rows.withColumn("_part", part).withColumn("_rank", F.struct(*order))
    # at most one row for each range
    first = dealt.groupBy("_part").agg(F.min("_rank").alias("_rank"))
    ring = Window.partitionBy(F.lit(0)).orderBy("_part")
    before = F.coalesce(F.lag("_part").over(ring), F.max("_part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = first.select(F.col("_part").alias("_fp"), F.col("_rank").alias("_fr"), before.alias("_to"))
    met = dealt.join(F.broadcast(first), (F.col("_part") == F.col("_fp")) & F.col("_rank").eqNullSafe(F.col("_fr")), "left")
    own = F.struct(F.col("_part").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_to").alias("range"), F.lit(1).alias("guest"))
    places = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, guest))
    return met.withColumn("_at", F.explode_outer(places)).select(*rows.columns, "_rank", F.col("_at.range").alias("_range"), F.col("_at.guest").alias("_guest"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text is the document with its last half (rounded down) replaced by as many code points
    from the beginning of the next document, or all it has.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_t"))
    down = F.bitwise_not(F.col("doc_id"))  # ascending in it is descending in the id
    dealt = in_ranges(rows, [F.col("doc_id").isNull().alias("none"), down.alias("down"), F.md5("_t").alias("md5")], down)
    # the texts are dealt before anchors are made, so that anchors are never sent
    made = dealt.repartition("_range").withColumn("_n", F.length("_t")).withColumn("_a", anchors(F.col("_t")))
    made = made.withColumn("_f", sketch_of(F.col("_a"), F.col("_t")))
    follow = Window.partitionBy("_range").orderBy("_guest", "_rank")
    for c in ("_t", "_n", "_a", "_f"):
        made = made.withColumn(f"{c}2", F.lead(c).over(follow))
    made = made.filter("_guest = 0")
    kept = F.col("_n") - F.floor(F.col("_n") / 2).cast("int")
    made = made.withColumn("_m", kept).withColumn("_c", F.least(F.col("_n") - kept, F.col("_n2")))
    seam = F.concat(F.substring(F.col("_t"), F.greatest(F.col("_m") - K + 2, F.lit(1)), F.least(F.col("_m"), F.lit(K - 1))), F.substring(F.col("_t2"), F.lit(1), F.least("_c", F.lit(K - 1))))
    edited = F.concat(F.substring(F.col("_t"), F.lit(1), F.col("_m")), F.substring(F.col("_t2"), F.lit(1), F.col("_c")))
    made = made.withColumn("_e", edited)
    inside = lambda a, end: F.filter(a, lambda v: place_of(v) + K <= end)
    parts = F.concat(inside(F.col("_a"), F.col("_m")), anchors(seam), inside(F.col("_a2"), F.col("_c")))
    made = made.withColumn("_g", F.when(F.col("_n") < 2, F.col("_f")).otherwise(sketch_of(parts, F.col("_e"))))
    return made.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("_f")).alias("fingerprint"),
        fingerprint(F.col("_g")).alias("edited_fingerprint"),
        likeness(F.col("_f"), F.col("_g")).alias("near_edited"),
        likeness(F.col("_f"), F.col("_f2")).alias("near_next"),
    )
