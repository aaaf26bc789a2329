"""Queries on pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import ORDER_PIXELS, order_pixels, table, with_
from reliefgrid.config import DEFAULT_COLOR_MAP, ImageSettings
from reliefgrid.functions.color import PIXEL_MATRIX, RULE_MATRIX, delta_e, hex_to_rgb, rgb_to_hex, rgb_to_lab
from reliefgrid.operators import pixels as P
from reliefgrid.plans.pipelines import image_file_to_heightmap, image_to_heightmap


def _rules(fuzziness: float) -> list[dict]:
    return P.compile_rules({k: v["value"] for k, v in DEFAULT_COLOR_MAP.items()}, fuzziness)


def _lab_sql(r: str, g: str, b: str, matrix) -> tuple[str, str, str]:
    def lin(c: str) -> str:
        return f"case when {c}/255.0::double > 0.04045 then pow(({c}/255.0::double + 0.055)/1.055, 2.4) else {c}/255.0::double/12.92 end"

    l = [f"({lin(c)})" for c in (r, g, b)]
    t = [f"(({m[0]}*{l[0]} + {m[1]}*{l[1]} + {m[2]}*{l[2]})/{w}::double)" for m, w in zip(matrix, (0.95047, 1.0, 1.08883))]
    f = [f"(case when {v} > 0.008856 then pow({v}, 1.0::double/3) else 7.787*{v} + 16.0::double/116 end)" for v in t]
    return f"116*{f[1]} - 16", f"500*({f[0]} - {f[1]})", f"200*({f[1]} - {f[2]})"


def _rule_values(fuzziness: float) -> str:
    return ", ".join(
        f"({r['priority']}, {r['value']!r}::double, {fuzziness!r}::double, {r['rgb'][0]}, {r['rgb'][1]}, {r['rgb'][2]})"
        for r in _rules(fuzziness)
    )


def _matched_sql(fuzziness: float) -> str:
    pl, pa, pb = _lab_sql("r", "g", "b", PIXEL_MATRIX)
    rl, ra, rb = _lab_sql("rr", "rg", "rb", RULE_MATRIX)
    return with_(
        ORDER_PIXELS,
        f"rule as (select *, {rl} as l, {ra} as a, {rb} as bb from (values {_rule_values(fuzziness)}) t(priority, value, fuzz, rr, rg, rb))",
        f"lab as (select *, {pl} as pl, {pa} as pa, {pb} as pb from fx3)",
        "hit as (select image_id, \"row\", col, min(priority) as priority from lab join rule "
        "on sqrt(pow(pl-l,2)+pow(pa-a,2)+pow(pb-bb,2)) <= fuzz group by all)",
        "m as (select f.*, h.priority, ru.value from fx3 f left join hit h using (image_id, \"row\", col) left join rule ru using (priority))",
    )


@query("P1", with_(ORDER_PIXELS, "s as (select max(\"row\")+1 as h, max(col)+1 as w from fx3)") +
       """select image_id, ("row" - floor(0.2::double*h))::int as "row", (col - floor(0.1::double*w))::int as col, r, g, b from fx3, s
       where "row" >= floor(0.2::double*h) and "row" < floor(0.8::double*h) and col >= floor(0.1::double*w) and col < floor(0.55::double*w)""")
def crop_by_share(spark, sf):
    return P.crop(order_pixels(spark, sf), (0.1, 0.2, 0.55, 0.8))


@query("P1", with_(ORDER_PIXELS) + """select image_id, ("row" - 3)::int as "row", (col - 20)::int as col, r, g, b from fx3
       where "row" >= 3 and "row" < 12 and col >= 20 and col < 70""")
def crop_by_pixels(spark, sf):
    return P.crop(order_pixels(spark, sf), (20, 3, 70, 12), unit="pixels")


def _resample_sql(limit: int) -> str:
    def one(axis: str, other: str, src: str, out: str, size: str) -> str:
        n = f"(select {size} from dims)"
        m = f"(select {size}_out from dims)"
        sc = f"({n}::double/{m})"
        x = f"((i.{axis} - (o + 0.5::double)*{sc} + 0.5::double)/{sc})"
        return f"""{out}_o as (select unnest(range(0, {m}))::int as o),
{out}_w as (select o, i.{axis} as i, case when abs({x}) >= 3 then 0 when {x} = 0 then 1::double
 else sin(pi()*{x})/(pi()*{x}) * sin(pi()*{x}/3)/(pi()*{x}/3) end as w from {out}_o,
 (select distinct {axis} from {src}) i where i.{axis} >= greatest(0, trunc((o + 0.5::double)*{sc} - 3*{sc} + 0.5::double))
 and i.{axis} < least({n}, trunc((o + 0.5::double)*{sc} + 3*{sc} + 0.5::double))),
{out} as (select image_id, {other}, o as {axis}, {', '.join(
            f"greatest(0, least(255, floor(sum(w*{c})/sum(w) + 0.5::double)))::int as {c}" for c in 'rgb')}
 from {src} p join {out}_w t on t.i = p.{axis} group by image_id, {other}, o)"""

    return with_(
        ORDER_PIXELS,
        f"""dims0 as (select (max("row")+1)::int as h, (max(col)+1)::int as w from fx3),
dims as (select h, w, floor(h * ({float(limit)!r}::double/greatest(h, w)))::int as h_out, floor(w * ({float(limit)!r}::double/greatest(h, w)))::int as w_out from dims0)""",
        one("col", '"row"', "fx3", "px", "w"),
        one('"row"', "col", "px", "py", "h"),
    ) + 'select image_id, "row", col, r, g, b from py'


@query("P2", _resample_sql(60))
def resample_pixels(spark, sf):
    # the SQL has no rows for a picture so narrow that no column is left of it
    return P.resample(order_pixels(spark, sf), 60, vanished="empty")


@query("P3 P4", with_(ORDER_PIXELS) + "select format('#{:02x}{:02x}{:02x}', r, g, b) as hex, r, g, b, count(*)::bigint as pixels from fx3 group by all")
def hex_round_trip(spark, sf):
    px = order_pixels(spark, sf).withColumn("hex", rgb_to_hex(F.col("r"), F.col("g"), F.col("b")))
    back = px.withColumn("c", hex_to_rgb(F.col("hex")))
    return back.groupBy("hex", F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b")).agg(
        F.count("*").alias("pixels")
    )


def _lab_query(matrix):
    l, a, b = _lab_sql("r", "g", "b", matrix)
    return with_(ORDER_PIXELS) + f'select "row", col, round({l}, 6) as lab_l, round({a}, 6) as lab_a, round({b}, 6) as lab_b from fx3'


def _lab(spark, sf, matrix):
    lab = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"), matrix)
    return order_pixels(spark, sf).withColumn("lab", lab).select(
        "row", "col", *[F.round(f"lab.{k}", 6).alias(n) for k, n in (("L", "lab_l"), ("a", "lab_a"), ("b", "lab_b"))]
    )


@query("P5", _lab_query(RULE_MATRIX))
def lab_of_rule_colors(spark, sf):
    return _lab(spark, sf, RULE_MATRIX)


@query("P6", _lab_query(PIXEL_MATRIX))
def lab_of_pixels(spark, sf):
    return _lab(spark, sf, PIXEL_MATRIX)


def _delta_sql() -> str:
    p, q = _lab_sql("r", "g", "b", PIXEL_MATRIX), _lab_sql("b", "r", "g", RULE_MATRIX)
    d = " + ".join(f"pow(({x}) - ({y}), 2)" for x, y in zip(p, q))
    return with_(ORDER_PIXELS) + f'select "row", col, round(sqrt({d}), 6) as delta_e from fx3'


@query("P7", _delta_sql())
def color_distance(spark, sf):
    c = [F.col(k) for k in "rgb"]
    p = order_pixels(spark, sf).withColumn("p", rgb_to_lab(*c)).withColumn("q", rgb_to_lab(c[2], c[0], c[1], RULE_MATRIX))
    return p.select("row", "col", F.round(delta_e(F.col("p"), F.col("q")), 6).alias("delta_e"))


_NATION_RULES = """rules as (select 'orders' as image_id, n_nationkey as priority,
 format('#{:02x}{:02x}{:02x}', n_nationkey*10, 255 - n_nationkey*10, (n_nationkey*37)%256) as hex, n_nationkey*10 as r,
 255 - n_nationkey*10 as g, (n_nationkey*37)%256 as b, n_nationkey::double as value,
 case when n_nationkey % 3 = 0 then 25.0::double else 12.0::double end as fuzziness from nation)"""


def _nation_rules(spark, sf):
    """A rule per nation; every third one carries its own fuzziness."""
    k = F.col("n_nationkey")
    code = rgb_to_hex(k * 10, 255 - k * 10, (k * 37) % 256)
    rules = table(spark, sf, "nation").select(
        F.lit("orders").alias("image_id"), k.alias("priority"), code.alias("hex"), k.cast("double").alias("value"),
        F.when(k % 3 == 0, 25.0).alias("fuzziness"),
    )
    return P.prepare_rules(rules, 12.0)


def _nation_rules_sql() -> str:
    l, a, b = _lab_sql("r", "g", "b", RULE_MATRIX)
    return with_(_NATION_RULES) + (
        f"select priority, hex, r, g, b, round({l}, 6) as lab_l, round({a}, 6) as lab_a, round({b}, 6) as lab_b, value, fuzziness from rules"
    )


@query("P8 P3", _nation_rules_sql())
def compiled_rules(spark, sf):
    r = _nation_rules(spark, sf)
    return r.select("priority", "hex", "r", "g", "b", *[F.round(c, 6).alias(c) for c in ("lab_l", "lab_a", "lab_b")], "value", "fuzziness")


def _image_rules_sql() -> str:
    pl, pa, pb = _lab_sql("r", "g", "b", PIXEL_MATRIX)
    rl, ra, rb = _lab_sql("r", "g", "b", RULE_MATRIX)
    return with_(
        ORDER_PIXELS, _NATION_RULES,
        f"rule as (select priority, value, fuzziness, {rl} as l, {ra} as a, {rb} as bb from rules)",
        f"lab as (select *, {pl} as pl, {pa} as pa, {pb} as pb from fx3)",
        "hit as (select \"row\", col, min(priority) as priority from lab join rule "
        "on sqrt(pow(pl-l,2)+pow(pa-a,2)+pow(pb-bb,2)) <= fuzziness group by all)",
    ) + ("select f.image_id as raster_id, f.\"row\", f.col, ru.value from fx3 f left join hit h using (\"row\", col) "
         "left join rule ru using (priority)")


@query("P9 J1 A11", _image_rules_sql())
def map_colors_rules_per_image(spark, sf):
    return P.map_colors(order_pixels(spark, sf), _nation_rules(spark, sf))


_CELLS_OUT = 'select image_id as raster_id, "row", col, value from m'


@query("P9", _matched_sql(5.0) + _CELLS_OUT)
def map_colors_strict(spark, sf):
    return P.map_colors(order_pixels(spark, sf), _rules(5.0))


@query("P9 P16", _matched_sql(40.0) + _CELLS_OUT)
def map_colors_loose(spark, sf):
    return P.map_colors(order_pixels(spark, sf), _rules(40.0))


@query("P10 A2", _matched_sql(40.0) + "select image_id, count(*)::bigint as pixels, count(value)::bigint as matched, "
       "round(count(value)*100.0::double/count(*), 6) as percent from m group by 1")
def color_match_report(spark, sf):
    m = P.match_rules(order_pixels(spark, sf), _rules(40.0))
    return P.match_report(m).withColumn("percent", F.round("percent", 6))


@query("P10 A3", _matched_sql(40.0) + "select image_id, coalesce(priority, -1)::int as priority, count(*)::bigint as pixels from m group by all")
def color_match_by_rule(spark, sf):
    m = P.match_rules(order_pixels(spark, sf), _rules(40.0))
    return P.match_report_by_rule(m).withColumn("priority", F.coalesce("priority", F.lit(-1)))


def _bmp(rows):
    """24-bit BMP bytes: header, then rows from the bottom, blue-green-red, padded to four bytes."""
    import struct

    import numpy as np

    h, w = rows.shape[:2]
    body = b"".join(r[:, ::-1].astype(np.uint8).tobytes() + b"\0" * (-3 * w % 4) for r in rows[::-1])
    return (
        b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54)
        + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body
    )


#: Rows of the order picture per image file.
BAND = 16


def _picture_files(spark, sf) -> str:
    """The order picture as one BMP file per band of rows, written by the tasks."""
    from reliefgrid.runtime import scratch_path

    folder = "/" + scratch_path(spark, "bmp").removeprefix("file:").lstrip("/")

    def save(pdf):
        import os

        import numpy as np

        os.makedirs(folder, exist_ok=True)
        r, c = (pdf[k].to_numpy() for k in ("row", "col"))
        a = np.zeros((r.max() - r.min() + 1, c.max() + 1, 3), dtype=np.uint8)
        a[r - r.min(), c] = pdf[["r", "g", "b"]].to_numpy()
        with open(f"{folder}/band_{int(pdf['band'].iloc[0])}.bmp", "wb") as f:
            f.write(_bmp(a))
        return pdf[["band"]].head(1)

    bands = order_pixels(spark, sf).withColumn("band", F.expr(f"row div {BAND}").cast("int"))
    bands.groupBy("band").applyInPandas(save, "band int").count()
    return folder


def _band(column: str):
    return F.regexp_extract(column, r"band_(\d+)", 1).cast("int").alias("band")


@query("S1", with_(ORDER_PIXELS) + f'select ("row" // {BAND})::int as band, ("row" % {BAND})::int as "row", col, r, g, b from fx3')
def image_files(spark, sf):
    from reliefgrid.sources.images import read_images

    return read_images(spark, _picture_files(spark, sf)).select(_band("image_id"), "row", "col", "r", "g", "b")


@query("S2", with_(ORDER_PIXELS) + f"""select ("row" // {BAND})::int as band, 'RGB' as mode, 'BMP' as format, (max(col) + 1)::int as width,
 (max("row") - min("row") + 1)::int as height, count(*)::bigint as total_pixels, false as has_transparency, false as size_mismatch from fx3 group by 1""")
def image_facts(spark, sf):
    from reliefgrid.sources.images import image_info

    i = image_info(spark, _picture_files(spark, sf))
    return i.select(_band("file_path"), "mode", "format", "width", "height", "total_pixels", "has_transparency", "size_mismatch")


@query("P11")
def sampled_pixels(spark, sf):
    return P.sample_pixels(order_pixels(spark, sf), 0.1)


@query("P11", with_(ORDER_PIXELS) + "select image_id, floor(count(*)*0.1::double)::bigint as pixels, floor(count(*)*0.1::double)::bigint as places from fx3 group by 1")
def sample_size(spark, sf):
    s = P.sample_pixels(order_pixels(spark, sf), 0.1)
    places = s.join(order_pixels(spark, sf), s.columns, "left_semi").groupBy("image_id")
    return places.agg(F.count("*").alias("pixels"), F.count_distinct("row", "col").alias("places"))


@query("P12 A10", with_(ORDER_PIXELS) + "select format('#{:02x}{:02x}{:02x}', r//32*32, g//32*32, b//32*32) as hex, "
       "count(*)::bigint as pixels from fx3 group by 1 order by pixels desc, hex limit 10")
def palette(spark, sf):
    return P.palette_histogram(order_pixels(spark, sf), 10)


@query("P11 P12", with_(ORDER_PIXELS) + "select format('#{:02x}{:02x}{:02x}', r//32*32, g//32*32, b//32*32) as hex, "
       "count(*)::bigint as pixels from fx3 group by 1 order by pixels desc, hex limit 6")
def dominant_colors(spark, sf):
    return P.dominant_colors(order_pixels(spark, sf), 6, sample_ratio=1.0, clustered=False)


@query("P13")
def palette_by_kmeans(spark, sf):
    return P.palette_kmeans(order_pixels(spark, sf), 6, restarts=2)


@query("P13", with_(ORDER_PIXELS) + "select 6::bigint as colors, count(*)::bigint as pixels from fx3")
def kmeans_totals(spark, sf):
    k = P.palette_kmeans(order_pixels(spark, sf), 6, restarts=2)
    return k.agg(F.count("*").alias("colors"), F.sum("pixels").alias("pixels"))


@query("P14", with_(ORDER_PIXELS) + "select image_id, count(*)::bigint as pixels from fx3 group by 1")
def rgb_check(spark, sf):
    return P.check_rgb(order_pixels(spark, sf)).groupBy("image_id").agg(F.count("*").alias("pixels"))


@query("E1 P15", _matched_sql(40.0).rstrip() + """,
c0 as (select "row", col, value from m where "row" >= 2 and col >= 10 and col < 90),
c1 as (select ("row" - 2)::int as "row", (col - 10)::int as col, value from c0),
f1 as (select a."row", a.col, coalesce(any_value(a.value), avg(b.value)) as value from c1 a left join c1 b
 on a.value is null and b."row" between a."row"-1 and a."row"+1 and b.col between a.col-1 and a.col+1 group by a."row", a.col),
f2 as (select a."row", a.col, coalesce(any_value(a.value), avg(b.value)) as value from f1 a left join f1 b
 on a.value is null and b."row" between a."row"-1 and a."row"+1 and b.col between a.col-1 and a.col+1 group by a."row", a.col)
select 'orders' as raster_id, "row", col, round(value, 6) as value from f2""")
def picture_to_heights(spark, sf):
    cfg = ImageSettings(
        region=(10, 2, 90, 10**9), region_unit="pixels", fill_max_iterations=2,
        color_map={k: {"value": v["value"], "fuzziness": 40.0} for k, v in DEFAULT_COLOR_MAP.items()},
    )
    return image_to_heightmap(order_pixels(spark, sf), cfg).withColumn("value", F.round("value", 6))


@query("E1 P15 S1", _matched_sql(40.0).rstrip() + f""",
c0 as (select ("row" // {BAND})::int as band, ("row" % {BAND})::int as "row", col, value from m),
f1 as (select a.band, a."row", a.col, coalesce(any_value(a.value), avg(b.value)) as value from c0 a left join c0 b
 on a.value is null and b.band = a.band and b."row" between a."row"-1 and a."row"+1 and b.col between a.col-1 and a.col+1 group by a.band, a."row", a.col)
select band, "row", col, round(value, 6) as value from f1""")
def picture_files_to_heights(spark, sf):
    """Map images end to end from files: every band of the picture is one file and one raster."""
    cfg = ImageSettings(fill_max_iterations=1, color_map={k: {"value": v["value"], "fuzziness": 40.0} for k, v in DEFAULT_COLOR_MAP.items()})
    cells = image_file_to_heightmap(spark, _picture_files(spark, sf), cfg)
    return cells.select(_band("raster_id"), "row", "col", F.round("value", 6).alias("value"))
