"""Image files as pixel tables, through Spark's own ``image`` and ``binaryFile`` sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels handed on per Arrow batch while an image is unpacked.
BATCH_PIXELS = 1 << 20


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, h, w, n, data in pdf[["origin", "height", "width", "nChannels", "data"]].itertuples(index=False):
            if h < 0:
                raise ValueError(f"cannot read image {path}")
            flat = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n)
            step = max(1, BATCH_PIXELS // max(w, 1))
            for top in range(0, h, step):
                part = flat[top : top + step]
                rows = part.shape[0]
                # channels come as blue, green, red (and alpha); grey images have one
                b, g, r = (part[..., min(i, n - 1) if n == 1 else i] for i in range(3))
                yield pd.DataFrame(
                    {
                        "image_id": path,
                        "row": np.repeat(np.arange(top, top + rows, dtype=np.int32), w),
                        "col": np.tile(np.arange(w, dtype=np.int32), rows),
                        "r": r.ravel().astype(np.int32),
                        "g": g.ravel().astype(np.int32),
                        "b": b.ravel().astype(np.int32),
                    }
                )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row per pixel of every image under ``path``; grey is repeated, transparency dropped.

    Each file is decoded by one task and leaves it in batches of rows; ``image_id`` is the file. A file
    that cannot be decoded fails the job by its name.
    """
    images = spark.read.format("image").option("dropInvalid", False).load(path)
    return images.select("image.*").mapInPandas(_unpack, "image_id string, row int, col int, r int, g int, b int")


def image_info(spark: SparkSession, path: str) -> DataFrame:
    """File size, picture size, mode, format and transparency per image; pixels are not unpacked.

    A file that cannot be decoded fails the job by its name.
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file_path"),
        (F.col("length") / (1024.0 * 1024.0)).alias("file_size_mb"),
        F.hex(F.substring("content", 1, 4)).alias("_magic"),
    )
    pictures = (
        spark.read.format("image").option("dropInvalid", False).load(path)
        .select("image.origin", F.when(F.col("image.height") < 0, F.raise_error(F.concat(F.lit("cannot read image "), F.col("image.origin"))).cast("int")).otherwise(F.col("image.height")).alias("height"), "image.width", "image.nChannels", F.length("image.data").alias("_bytes"))
    )
    # The first bytes of common formats.
    fmt = (
        F.when(F.col("_magic").startswith("FFD8FF"), "JPEG")
        .when(F.col("_magic") == "89504E47", "PNG")
        .when(F.col("_magic").startswith("424D"), "BMP")
        .when(F.col("_magic") == "47494638", "GIF")
        .when(F.col("_magic").isin("49492A00", "4D4D002A"), "TIFF")
    )
    n = F.col("nChannels")
    # both sources name local files slightly differently (file:/ and file:///)
    key = F.regexp_replace("file_path", "^file:/+", "/")
    return (
        files.withColumn("_k", key)
        .join(pictures.withColumn("_k", F.regexp_replace("origin", "^file:/+", "/")), "_k")
        .select(
            "file_path", "file_size_mb", "width", "height",
            F.when(n == 1, "L").when(n == 3, "RGB").when(n == 4, "RGBA").alias("mode"),
            fmt.alias("format"),
            (n == 4).alias("has_transparency"),
            F.col("height").alias("array_height"), F.col("width").alias("array_width"),
            (F.col("height").cast("long") * F.col("width")).alias("total_pixels"),
            (F.col("_bytes") != F.col("height").cast("long") * F.col("width") * n).alias("size_mismatch"),
        )
    )
