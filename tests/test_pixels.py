import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import to_array
from reliefgrid.config import ImageSettings
from reliefgrid.functions.color import hex_to_rgb
from reliefgrid.operators import pixels as P
from reliefgrid.plans.pipelines import image_to_heightmap
from reliefgrid.runtime import local_table
from reliefgrid.streaming.heights import heights_from_pixels

STRIPES = {"#ff0000": 1.0, "#00ff00": 2.0, "#0000ff": 3.0}


def picture(spark, a, image_id="p"):
    h, w, _ = a.shape
    rows = [(image_id, i, j, *map(int, a[i, j])) for i in range(h) for j in range(w)]
    return local_table(spark, rows, "image_id string, row int, col int, r int, g int, b int")


def stripes(w, h):
    a = np.zeros((h, w, 3), dtype=int)
    for i in range(3):
        a[:, i * (w // 3) : w if i == 2 else (i + 1) * (w // 3), i] = 255
    return a


def test_rules():
    r = P.compile_rules({"#ff0000": 1.0, "#00ff00": {"value": 2, "fuzziness": 15}, "0000ff": {"value": 3}}, 10.0)
    assert [x["fuzziness"] for x in r] == [10.0, 15.0, 10.0]
    assert r[0]["rgb"] == (255, 0, 0)
    for bad in ("#ff00", "#ff00000"):
        with pytest.raises(ValueError):
            P.compile_rules({bad: 1.0})


def test_bad_hex_in_a_table_raises(spark):
    df = local_table(spark, [("#ff00",)], "h string")
    with pytest.raises(Exception, match="Invalid hex color"):
        df.select(hex_to_rgb(F.col("h"))).collect()


def test_stripes_and_regions(spark):
    px = picture(spark, stripes(9, 6))
    got = to_array(P.map_colors(px, P.compile_rules(STRIPES, 20.0)))
    assert got.shape == (6, 9) and (got == np.repeat([1, 2, 3], 3)).all()
    assert to_array(P.map_colors(P.crop(picture(spark, stripes(20, 20)), (5, 5, 15, 15), "pixels"), P.compile_rules(STRIPES, 20.0))).shape == (10, 10)
    with pytest.raises(ValueError, match="Invalid Region"):
        P.crop(px, (0, 0, 2, 1))


def test_first_rule_wins_and_no_match(spark):
    px = picture(spark, np.array([[[254, 1, 1], [0, 0, 255]]]))
    rules = P.compile_rules({"#ff0000": 1.0, "#fe0101": 2.0}, 50.0)
    got = to_array(P.map_colors(px, rules))
    assert got[0, 0] == 1.0 and np.isnan(got[0, 1])
    many = {f"#{i:02x}{i:02x}ff": float(i) for i in range(100, 180)}
    slow = P.map_colors(px, P.compile_rules({"#ff0000": 1.0, **many}, 50.0))
    assert to_array(slow)[0, 0] == 1.0
    shared = local_table(spark, [(0, "#ff0000", 1.0, None), (1, "#fe0101", 2.0, 3.0)], "priority int, hex string, value double, fuzziness double")
    assert to_array(P.map_colors(px, P.prepare_rules(shared, 50.0)))[0, 0] == 1.0


def test_depth_discs(spark):
    y, x = np.mgrid[0:50, 0:50]
    d = np.hypot(x - 25, y - 25)
    a = np.where(d[..., None] < 10, [0, 0, 139], np.where(d[..., None] < 20, [0, 100, 200], [100, 200, 255]))
    cfg = ImageSettings(color_map={"#00008b": -5.0, "#0064c8": -2.0, "#64c8ff": -0.5}, default_fuzziness=30.0)
    got = to_array(image_to_heightmap(picture(spark, a), cfg))
    assert (got == np.where(d < 10, -5.0, np.where(d < 20, -2.0, -0.5))).all()


def test_check_rgb(spark):
    with pytest.raises(ValueError, match="Expected RGB image"):
        P.check_rgb(picture(spark, stripes(3, 1)).drop("b"))
    with pytest.raises(Exception, match="Expected RGB image"):
        P.check_rgb(picture(spark, stripes(3, 1)).withColumn("r", F.lit(300))).collect()


def test_exact_sample(spark, monkeypatch):
    monkeypatch.setattr(P, "SAMPLE_BAND_ROWS", 3)
    px = picture(spark, stripes(40, 25))
    s = P.sample_pixels(px, 0.137)
    assert s.count() == int(1000 * 0.137) == s.select("row", "col").distinct().count()
    assert P.sample_pixels(px, 0.0).count() == 0
    assert 0 < P.sample_pixels(px, 0.2, exact=False).count() < 1000


def test_palettes(spark):
    px = picture(spark, stripes(30, 4))
    assert [tuple(r) for r in P.palette_histogram(px).collect()] == [("#0000e0", 40), ("#00e000", 40), ("#e00000", 40)]
    got = {tuple(r) for r in P.palette_kmeans(px, 3, restarts=3).collect()}
    assert got == {("#0000ff", 40), ("#00ff00", 40), ("#ff0000", 40)}


def test_resample_keeps_small_and_flat_pictures(spark):
    px = picture(spark, stripes(9, 6))
    assert P.resample(px, 9).exceptAll(px).isEmpty()
    flat = picture(spark, np.full((20, 40, 3), 77))
    out = P.resample(flat, 10)
    assert out.count() == 5 * 10 and {tuple(r) for r in out.select("r", "g", "b").distinct().collect()} == {(77, 77, 77)}


def test_colour_mapping_on_a_stream(spark, tmp_path):
    px = picture(spark, stripes(9, 6))
    px.write.parquet(str(tmp_path / "px"))
    stream = spark.readStream.schema(px.schema).parquet(str(tmp_path / "px"))
    q = (
        heights_from_pixels(stream, P.compile_rules(STRIPES, 20.0), 2.0, 1.0)
        .writeStream.format("memory").queryName("heights").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    q.awaitTermination(120)
    got = to_array(spark.table("heights"))
    assert (got == np.repeat([3, 5, 7], 3)).all()
