"""Operators on ``pixels(image_id, row, col, r, g, b)``."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions.color import (
    PIXEL_MATRIX,
    RULE_MATRIX,
    hex_to_rgb,
    rgb_to_hex,
    rgb_to_lab,
)
from reliefgrid.runtime import SMALL_TABLE_ROWS, attach, local_table

#: Up to this many rules become one folded CASE expression; more are searched in an array.
FOLD_RULES = 64
#: A sampling step stops narrowing once the undecided band has at most this many rows.
SAMPLE_BAND_ROWS = 100_000


def image_sizes(pixels: DataFrame) -> DataFrame:
    """One row per image: height and width."""
    return pixels.groupBy("image_id").agg(
        (F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width")
    )


def check_rgb(pixels: DataFrame) -> DataFrame:
    """Reject tables that are not RGB images; channel values are asserted while rows stream by."""
    missing = {"image_id", "row", "col", "r", "g", "b"} - set(pixels.columns)
    if missing:
        raise ValueError(f"Expected RGB image table, columns missing: {sorted(missing)}")
    ok = F.lit(True)
    for c in ("r", "g", "b"):
        ok = ok & F.col(c).between(0, 255)
    return pixels.filter(
        F.when(F.coalesce(ok, F.lit(False)), True).otherwise(
            F.raise_error(F.lit("Expected RGB image: channel outside 0-255"))
        )
    )


def crop(
    pixels: DataFrame,
    region: tuple[float, float, float, float],
    unit: str = "fraction",
    sizes: DataFrame | None = None,
    key: str = "image_id",
) -> DataFrame:
    """Keep the window (x0, y0, x1, y1) and count rows and columns from its corner.

    ``unit="fraction"`` takes shares of the image size, ``"pixels"`` takes row and column numbers
    (a pure filter that reaches the scan). Works for cells too with ``key="raster_id"``.
    """
    x0, y0, x1, y1 = region
    if unit == "pixels":
        inside = (F.col("row") >= int(y0)) & (F.col("row") < int(y1))
        inside &= (F.col("col") >= int(x0)) & (F.col("col") < int(x1))
        return pixels.filter(inside).withColumns(
            {"row": F.col("row") - F.lit(int(y0)), "col": F.col("col") - F.lit(int(x0))}
        )
    if unit != "fraction":
        raise ValueError(f"Unknown region unit: {unit}")
    if any(v > 1 or v < 0 for v in region):
        raise ValueError("Invalid Region Specified")
    if sizes is None and pixels.isStreaming:
        raise ValueError("shares of a stream need the sizes of its images")
    if sizes is None:
        sizes = image_sizes(pixels.withColumnRenamed(key, "image_id")).withColumnRenamed("image_id", key)

    def bound(share: float, size: str):
        return F.floor(F.lit(float(share)) * F.col(size)).cast("int")

    bounds = sizes.select(
        key,
        bound(y0, "height").alias("_y0"),
        bound(y1, "height").alias("_y1"),
        bound(x0, "width").alias("_x0"),
        bound(x1, "width").alias("_x1"),
    )
    inside = (F.col("row") >= F.col("_y0")) & (F.col("row") < F.col("_y1"))
    inside &= (F.col("col") >= F.col("_x0")) & (F.col("col") < F.col("_x1"))
    return (
        attach(pixels, bounds, [key])
        .filter(inside)
        .withColumns({"row": F.col("row") - F.col("_y0"), "col": F.col("col") - F.col("_x0")})
        .select(*pixels.columns)
    )


def _lanczos(x):
    def sinc(t):
        return F.when(t == 0, F.lit(1.0)).otherwise(F.sin(t * F.pi()) / (t * F.pi()))

    return F.when(F.abs(x) < 3.0, sinc(x) * sinc(x / 3.0)).otherwise(0.0)


def _resample_axis(pixels: DataFrame, axis: str) -> DataFrame:
    """One separable pass: each input pixel adds its weighted value to the outputs in reach."""
    n_in, n_out = F.col(f"_in_{axis}"), F.col(f"_out_{axis}")
    scale = n_in / n_out
    reach = 3.0 * scale
    first = F.greatest(F.lit(0), F.floor((F.col(axis) + 0.5 - reach) / scale - 0.5))
    last = F.least(n_out - 1, F.ceil((F.col(axis) + 0.5 + reach) / scale - 0.5))
    other = "row" if axis == "col" else "col"
    center = (F.col("_out") + 0.5) * scale
    # the window of an output pixel is cut to whole input pixels, as image libraries do
    lo = F.greatest(F.lit(0), (center - reach + 0.5).cast("int"))
    hi = F.least(n_in.cast("int"), (center + reach + 0.5).cast("int"))
    weight = F.when(
        (F.col(axis) >= lo) & (F.col(axis) < hi), _lanczos((F.col(axis) - center + 0.5) / scale)
    ).otherwise(0.0)
    sizes = ["_in_row", "_in_col", "_out_row", "_out_col"]
    spread = pixels.withColumn("_out", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    spread = spread.withColumn("_w", weight).filter(F.col("_w") != 0)

    def blended(c: str):
        v = F.sum(F.col("_w") * F.col(c)) / F.sum("_w")
        return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5))).cast("int").alias(c)

    return (
        spread.groupBy("image_id", other, F.col("_out").alias(axis))
        .agg(*[blended(c) for c in ("r", "g", "b")], *[F.first(s).alias(s) for s in sizes])
        .select("image_id", "row", "col", "r", "g", "b", *sizes)
    )


def resample(pixels: DataFrame, max_dimension: int, sizes: DataFrame | None = None, vanished: str = "error") -> DataFrame:
    """Shrink images whose longer side exceeds ``max_dimension``; Lanczos with 3 lobes.

    Both passes are weighted group averages; the weights are computed per row, so no weight table
    has to be shipped and partial sums are formed before each shuffle. Images already within the
    limit pass through untouched. A side that would shrink to 0 pixels is an error, as in the original;
    with ``vanished="empty"`` such an image has no pixels.
    """
    if vanished not in ("error", "empty"):
        raise ValueError(f"Unknown choice for vanished images: {vanished}")
    sizes = image_sizes(pixels) if sizes is None else sizes
    longest = F.greatest("height", "width")
    ratio = F.lit(float(max_dimension)) / longest
    target = sizes.select(
        "image_id",
        F.col("height").alias("_in_row"),
        F.col("width").alias("_in_col"),
        F.floor(F.col("height") * ratio).cast("int").alias("_out_row"),
        F.floor(F.col("width") * ratio).cast("int").alias("_out_col"),
        (longest > max_dimension).alias("_shrink"),
    )
    gone = F.col("_shrink") & (F.least("_out_row", "_out_col") < 1)
    if vanished == "empty":
        target = target.filter(~gone)
    else:
        told = F.concat(F.lit("a side would shrink to 0 pixels: "), F.col("image_id").cast("string"))
        target = target.withColumn("_shrink", F.when(gone, F.raise_error(told)).otherwise(F.col("_shrink")))
    sized = attach(pixels, target, ["image_id"])
    keep = sized.filter(~F.col("_shrink")).select(*pixels.columns)
    shrunk = sized.filter("_shrink").drop("_shrink")
    for axis in ("col", "row"):
        shrunk = _resample_axis(shrunk, axis)
    return keep.unionByName(shrunk.select(*pixels.columns))


_HEX = re.compile("#*([0-9a-fA-F]{6})")


def compile_rules(color_map: Mapping[str, float | Mapping[str, float]], default_fuzziness: float = 10.0) -> list[dict]:
    """Ordered rules (priority, hex, rgb, value, fuzziness); a bare number takes the default fuzziness."""

    def rule(priority: int, code: str, given) -> dict:
        digits = _HEX.fullmatch(code)
        if digits is None:
            raise ValueError(f"Invalid hex color: {code}")
        told = {"fuzziness": default_fuzziness} | (dict(given) if isinstance(given, Mapping) else {"value": given})
        return {"priority": priority, "hex": code, "rgb": tuple(bytes.fromhex(digits[1]))} | {k: float(told[k]) for k in ("value", "fuzziness")}

    return [rule(k, *entry) for k, entry in enumerate(color_map.items())]


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The compiled rules as a table."""
    rows = [(r["priority"], r["hex"], r["value"], r["fuzziness"]) for r in rules]
    return prepare_rules(local_table(spark, rows, "priority int, hex string, value double, fuzziness double"))


def _rule_colours(spark: SparkSession, rules: list[dict]) -> list[tuple[float, float, float]]:
    """LAB colours of the rules as plain numbers; folded in one local table, not once per rule and use in the plan."""
    rows = rules_table(spark, rules).select("priority", "lab_l", "lab_a", "lab_b").collect()
    found = {r["priority"]: (r["lab_l"], r["lab_a"], r["lab_b"]) for r in rows}
    return [found[r["priority"]] for r in rules]


def _rule_struct(rule: dict, colour: tuple[float, float, float]) -> Column:
    """A rule as literals."""
    return F.struct(
        F.lit(rule["priority"]).alias("priority"),
        *[F.lit(v).alias(f"lab_{k}") for k, v in zip("lab", colour)],
        F.lit(rule["fuzziness"]).alias("fuzziness"),
        F.lit(rule["value"]).alias("value"),
    )


def prepare_rules(rules: DataFrame, default_fuzziness: float = 10.0) -> DataFrame:
    """Colours of rules held in a table (priority, hex, value, fuzziness), which may have a rule set per ``image_id``."""
    rgb = hex_to_rgb(F.col("hex"))
    out = rules.withColumn("_rgb", rgb).withColumn(
        "_lab", rgb_to_lab(F.col("_rgb.r"), F.col("_rgb.g"), F.col("_rgb.b"), RULE_MATRIX)
    )
    keys = [c for c in ("image_id", "priority") if c in rules.columns]
    return out.select(
        *keys,
        "hex",
        F.col("_rgb.r").alias("r"),
        F.col("_rgb.g").alias("g"),
        F.col("_rgb.b").alias("b"),
        F.col("_lab.L").alias("lab_l"),
        F.col("_lab.a").alias("lab_a"),
        F.col("_lab.b").alias("lab_b"),
        F.col("value").cast("double").alias("value"),
        F.coalesce(F.col("fuzziness").cast("double"), F.lit(float(default_fuzziness))).alias("fuzziness"),
    )


def _distance_to(lab, l, a, b):
    return F.sqrt(
        (lab["L"] - l) * (lab["L"] - l) + (lab["a"] - a) * (lab["a"] - a) + (lab["b"] - b) * (lab["b"] - b)
    )


def _match_array(lab, rules):
    """First rule of a priority-ordered array whose colour is near enough."""
    return F.get(
        F.filter(rules, lambda r: _distance_to(lab, r["lab_l"], r["lab_a"], r["lab_b"]) <= r["fuzziness"]), F.lit(0)
    )


def _match_shared(with_lab: DataFrame, rules: DataFrame, entry: Column) -> DataFrame:
    """Adds ``_hit`` from a rule table that all images share, a bounded array of rules at a time.

    Rules of a stream are not counted beforehand: more than one array of them is an error of the batch.
    """
    stream = with_lab.isStreaming
    total = 0 if stream else rules.count()
    if total > SMALL_TABLE_ROWS:
        ends = rules.stat.approxQuantile("priority", [k / -(-2 * total // SMALL_TABLE_ROWS) for k in range(1, -(-2 * total // SMALL_TABLE_ROWS))], 0.0)
    else:
        ends = []
    none = F.lit(None).cast("struct<priority:int,lab_l:double,lab_a:double,lab_b:double,fuzziness:double,value:double>")
    out = with_lab.withColumn("_hit", none)
    for lo, hi in zip([None, *ends], [*ends, None]):
        part = rules.filter((F.lit(True) if lo is None else F.col("priority") > lo) & (F.lit(True) if hi is None else F.col("priority") <= hi))
        array = part.agg(F.sort_array(F.collect_list(entry)).alias("_rules"))  # one row
        if stream:
            many = F.raise_error(F.lit(f"more than {SMALL_TABLE_ROWS} rules for a stream"))
            array = array.select(F.when(F.size("_rules") <= SMALL_TABLE_ROWS, F.col("_rules")).otherwise(many).alias("_rules"))
        found = F.coalesce(F.col("_hit"), _match_array(F.col("_lab"), F.col("_rules")))
        out = out.crossJoin(F.broadcast(array)).withColumn("_hit", found).drop("_rules")
    return out


def match_rules(pixels: DataFrame, rules: list[dict] | DataFrame, matrix=PIXEL_MATRIX) -> DataFrame:
    """Add ``priority`` and ``value`` of the first matching rule, NULL where none matches.

    A rule list stays inside one generated stage with no shuffle. The rules of a table travel
    as one priority-ordered array, per image if it has ``image_id``; a shared table of more than
    ``SMALL_TABLE_ROWS`` rules is tried that many rules at a time.
    """
    lab = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"), matrix)
    with_lab = pixels.withColumn("_lab", lab)
    col = F.col("_lab")
    if isinstance(rules, DataFrame):
        entry = F.struct("priority", "lab_l", "lab_a", "lab_b", "fuzziness", "value")
        ordered = F.sort_array(F.collect_list(entry)).alias("_rules")
        if "image_id" in rules.columns:
            per_image = rules.groupBy("image_id").agg(ordered)
            longest = 1 if pixels.isStreaming else per_image.agg(F.max(F.size("_rules"))).first()[0] or 1
            joined = attach(with_lab, per_image, ["image_id"], how="left", limit=SMALL_TABLE_ROWS // longest)
            hit = _match_array(col, F.col("_rules"))
        else:
            return _match_shared(with_lab, rules, entry).select(*pixels.columns, F.col("_hit.priority").alias("priority"), F.col("_hit.value").alias("value"))
    elif len(rules) <= FOLD_RULES:
        joined = with_lab
        named = [F.struct(F.lit(r["priority"]).alias("priority"), F.lit(r["value"]).alias("value")) for r in rules]
        colours = _rule_colours(pixels.sparkSession, rules)
        hit = F.coalesce(*[F.when(_distance_to(col, *map(F.lit, c)) <= r["fuzziness"], n) for r, c, n in zip(rules, colours, named)])
    else:
        joined = with_lab
        hit = _match_array(col, F.array(*map(_rule_struct, rules, _rule_colours(pixels.sparkSession, rules))))
    return joined.withColumn("_hit", hit).select(
        *pixels.columns, F.col("_hit.priority").alias("priority"), F.col("_hit.value").alias("value")
    )


def map_colors(pixels: DataFrame, rules: list[dict] | DataFrame, matrix=PIXEL_MATRIX) -> DataFrame:
    """Pixels -> cells: the value of the first rule within its fuzziness, else missing."""
    return match_rules(pixels, rules, matrix).select(
        F.col("image_id").alias("raster_id"), "row", "col", "value"
    )


def match_report(matched: DataFrame) -> DataFrame:
    """Matched pixels and percentage per image, from ``map_colors`` or ``match_rules`` output."""
    key = "raster_id" if "raster_id" in matched.columns else "image_id"
    return matched.groupBy(key).agg(
        F.count("*").alias("pixels"),
        F.count("value").alias("matched"),
        (F.count("value") * 100.0 / F.count("*")).alias("percent"),
    )


def match_report_by_rule(matched: DataFrame) -> DataFrame:
    """Pixels per image and winning rule; unmatched pixels count under a NULL priority."""
    return matched.groupBy("image_id", "priority").agg(F.count("*").alias("pixels"))


def sample_pixels(pixels: DataFrame, ratio: float, seed: int = 42, exact: bool = True) -> DataFrame:
    """Uniform sample without replacement.

    ``exact`` returns ``int(n * ratio)`` pixels: each pixel gets a hash rank from its key and the
    lowest ranks win. The cut-off is found by narrowing a histogram of the ranks, so no task ever
    sorts the whole table. ``exact=False`` keeps each pixel with probability ``ratio``.
    """
    if not exact:
        return pixels.sample(withReplacement=False, fraction=ratio, seed=seed)
    keyed = pixels.withColumn("_u", F.shiftrightunsigned(F.xxhash64("image_id", "row", "col", F.lit(seed)), 2))
    want = int(keyed.count() * ratio)
    lo, width = 0, 1 << 62
    below = 0
    while True:
        step = max(width >> 12, 1)
        bins = (
            keyed.filter((F.col("_u") >= lo) & (F.col("_u") < lo + width))
            .groupBy(F.expr(f"(_u - {lo}) div {step}").alias("bin"))
            .count()
            .orderBy("bin")
            .collect()
        )
        band = None
        for b in bins:
            if below + b["count"] >= want:
                band = b
                break
            below += b["count"]
        if band is None:
            return pixels if want > 0 else pixels.limit(0)
        lo, width = lo + band["bin"] * step, step
        if band["count"] <= SAMPLE_BAND_ROWS or width == 1:
            break
    sure = keyed.filter(F.col("_u") < lo)
    rest = want - below
    edge = (
        keyed.filter((F.col("_u") >= lo) & (F.col("_u") < lo + width))
        .orderBy("_u", "image_id", "row", "col")
        .limit(rest)
    )
    return sure.unionByName(edge).drop("_u")


def palette_histogram(pixels: DataFrame, n_colors: int = 10) -> DataFrame:
    """The most frequent colours after rounding channels down to multiples of 32; ties by code."""
    quantised = [(F.floor(F.col(c) / 32) * 32).cast("int").alias(c) for c in ("r", "g", "b")]
    return (
        pixels.groupBy(*quantised)
        .agg(F.count("*").alias("pixels"))
        .select(rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "pixels")
        .orderBy(F.desc("pixels"), "hex")
        .limit(n_colors)
    )


def palette_kmeans(pixels: DataFrame, n_colors: int = 10, seed: int = 42, restarts: int = 10) -> DataFrame:
    """Dominant colours by k-means: best of several starts, centres cut to whole numbers.

    Pixels are first folded into distinct colours with counts, so the iterations run on at most
    16.7 million weighted points whatever the number of pixels.
    """
    colors = pixels.groupBy("r", "g", "b").agg(F.count("*").cast("double").alias("pixels"))
    points = VectorAssembler(inputCols=["r", "g", "b"], outputCol="features").transform(colors).persist()
    try:
        k = min(n_colors, points.limit(n_colors).count())
        if k < 2:
            return colors.select(
                rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"),
                F.col("pixels").cast("long").alias("pixels"),
            )
        best = None
        for i in range(restarts):
            model = KMeans(k=k, seed=seed + i, weightCol="pixels", maxIter=50).fit(points)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
        centres = [(i, *[int(v) for v in c]) for i, c in enumerate(best.clusterCenters())]
    finally:
        points.unpersist()
    table = local_table(pixels.sparkSession, centres, "prediction int, r int, g int, b int")
    counts = best.transform(points).groupBy("prediction").agg(F.sum("pixels").cast("long").alias("pixels"))
    return (
        counts.join(table, "prediction")
        .select(rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "pixels")
        .orderBy(F.desc("pixels"), "hex")
    )


def dominant_colors(pixels: DataFrame, n_colors: int = 10, sample_ratio: float = 0.1, clustered: bool = True, seed: int = 42) -> DataFrame:
    """Dominant colours (``hex``, ``pixels``) of a sample: by k-means, or the most frequent coarse colours."""
    part = pixels if sample_ratio >= 1 else sample_pixels(pixels, sample_ratio, seed)
    return palette_kmeans(part, n_colors, seed) if clustered else palette_histogram(part, n_colors)


def sample_color_map() -> dict[str, dict[str, float]]:
    """A ready colour map from deep water to high land."""
    from reliefgrid.config import DEFAULT_COLOR_MAP

    return {k: dict(v) for k, v in DEFAULT_COLOR_MAP.items()}
