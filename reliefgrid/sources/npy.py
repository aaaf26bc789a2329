"""NumPy ``.npy`` grids as a Spark data source and sink."""

from __future__ import annotations

import ast
import io
import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from reliefgrid.runtime import attach, cut

#: Cells of a file per input partition and per Arrow batch.
PARTITION_CELLS = 1 << 22
BATCH_CELLS = 1 << 18


#: Blocks that ``NpyWriter`` puts into one file: 2**9 rows by 2**13 columns, 32 MB.
BLOCK_ROW_BITS, BLOCK_COL_BITS = 9, 13
#: Blocks per input partition.
PARTITION_BLOCKS = 4
MANIFEST = "_parts.json"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; paths without a scheme are local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class FileShare(InputPartition):
    """One of ``of`` equal shares of the cells of a file."""

    path: str
    index: int
    of: int


@dataclass
class BlockShare(InputPartition):
    """Blocks ``first`` to ``last`` of those one writing task listed."""

    folder: str
    listing: str
    first: int
    last: int


def _header(f) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, dtype, order flag and data offset of an open ``.npy`` file."""
    if f.read(6) != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    major, _ = f.read(2)
    size = struct.unpack("<H", f.read(2))[0] if major == 1 else struct.unpack("<I", f.read(4))[0]
    head = ast.literal_eval(f.read(size).decode("latin1"))
    return tuple(head["shape"]), np.dtype(head["descr"]), head["fortran_order"], f.tell()


def _cells_of(f, name: str, index: int, of: int, top: int = 0, left: int = 0) -> Iterator[pa.RecordBatch]:
    """A share of a file's values, a bounded stretch of bytes at a time, as cells."""
    shape, dtype, fortran, offset = _header(f)
    if len(shape) != 2:
        raise ValueError(f"Heightmap must be 2D, got {len(shape)}D")
    total, line = shape[0] * shape[1], shape[0] if fortran else shape[1]
    end = total * (index + 1) // of
    for start in range(total * index // of, end, BATCH_CELLS):
        n = min(BATCH_CELLS, end - start)
        f.seek(offset + start * dtype.itemsize)
        v = np.frombuffer(f.read(n * dtype.itemsize), dtype=dtype).astype(np.float64)
        major, minor = np.divmod(np.arange(start, start + n), line)
        row, col = (minor, major) if fortran else (major, minor)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * n, pa.string()),
                pa.array((row + top).astype(np.int32)),
                pa.array((col + left).astype(np.int32)),
                pa.array(v, mask=np.isnan(v)),
            ],
            names=["raster_id", "row", "col", "value"],
        )


class NpyReader(DataSourceReader):
    """The planning side lists names and sizes only; headers are read by the tasks."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        store, root = store_of(self.path)
        manifest = f"{root}/{MANIFEST}"
        if _exists(store, manifest):
            with store.open_input_file(manifest) as f:
                lists = json.loads(f.read())["lists"]
            return [
                BlockShare(self.path, name, i, min(i + PARTITION_BLOCKS, n))
                for name, n in lists for i in range(0, n, PARTITION_BLOCKS)
            ]
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = store.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
        out = []
        for entry in sorted((e for e in files if e.path.endswith(".npy")), key=lambda e: e.path):
            shares = max(1, -(-entry.size // (8 * PARTITION_CELLS)))
            out += [FileShare(entry.path, k, shares) for k in range(shares)]
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing listed
            return
        store, root = store_of(self.path)
        if isinstance(partition, FileShare):
            name = unquote(partition.path.rsplit("/", 1)[-1].removesuffix(".npy"))
            try:
                with store.open_input_file(partition.path) as f:
                    yield from _cells_of(f, name, partition.index, partition.of)
            except ValueError as e:
                raise ValueError(f"{e}: {partition.path}") from e
            return
        with store.open_input_file(f"{root}/{partition.listing}") as f:
            listed = f.read().decode().splitlines()[partition.first : partition.last]
        for block in map(json.loads, listed):
            with store.open_input_file(f"{root}/{block['file']}") as f:
                yield from _cells_of(f, block["raster"], 0, 1, block["top"], block["left"])


@dataclass
class Listed(WriterCommitMessage):
    """What a task hands back: the name of its list of blocks and their number, however many cells it wrote."""

    listing: str
    blocks: int


class NpyWriter(DataSourceArrowWriter):
    """Blocks of cells as ``.npy`` files on any store that Arrow reaches.

    A task writes each block to a file of a new name, then one list of its blocks. Committing names the lists in
    the manifest, which is all the reader follows: what a failed or repeated task left is deleted where it can be
    and never read. A task holds one block at a time. Cells come sorted by block (``save_npy``), and
    those of a block that come together form a full rectangle; others raise, so nothing is padded or read twice.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Listed:
        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        task, listed, written, held = uuid.uuid4().hex, [], [], []

        def flush() -> None:
            if not held:
                return
            raster = held[0][0]
            row, col, v = (np.concatenate(a) for a in zip(*[h[2:] for h in held]))
            top, left = int(row.min()), int(col.min())
            h, w = int(row.max()) - top + 1, int(col.max()) - left + 1
            at = (row - top).astype(np.int64) * w + (col - left)
            if at.size != h * w or np.unique(at).size != at.size:
                raise ValueError(f"cells of {raster} from row {top}, column {left} are no full rectangle; use save_npy")
            grid = np.empty(h * w)
            grid[at] = v
            data = io.BytesIO()
            np.save(data, grid.reshape(h, w))
            name = f"part-{task}-{len(listed)}.npy"
            written.append(name)
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(data.getbuffer())
            listed.append(json.dumps({"raster": raster, "top": top, "left": left, "file": name}))
            held.clear()

        try:
            for batch in iterator:
                if batch.num_rows == 0:
                    continue
                cells = batch.to_pandas()
                if cells[["raster_id", "row", "col"]].isna().any(axis=None):
                    raise ValueError("cells to write have no null raster_id, row or col")
                row, col = cells["row"].to_numpy(np.int64), cells["col"].to_numpy(np.int64)
                raster = cells["raster_id"].to_numpy(dtype=object)
                v = cells["value"].to_numpy(dtype=np.float64, na_value=np.nan)
                keys = row >> BLOCK_ROW_BITS, col >> BLOCK_COL_BITS
                new = np.r_[True, (raster[1:] != raster[:-1]) | (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)]
                starts = np.flatnonzero(new)
                for a, b in zip(starts, [*starts[1:], len(cells)]):
                    block = (int(keys[0][a]), int(keys[1][a]))
                    if held and (held[0][0], held[0][1]) != (raster[a], block):
                        flush()
                    held.append((raster[a], block, row[a:b], col[a:b], v[a:b]))
            flush()
            listing = f"list-{task}.jsonl"
            written.append(listing)
            with store.open_output_stream(f"{root}/{listing}") as f:
                f.write(("\n".join(listed) + "\n").encode())
        except BaseException:
            self._delete(written)
            raise
        return Listed(listing, len(listed))

    def _delete(self, names: list[str]) -> None:
        store, root = store_of(self.path)
        for name in names:
            if _exists(store, f"{root}/{name}"):
                store.delete_file(f"{root}/{name}")

    def _files(self, listing: str) -> list[str]:
        """A list and the files it names."""
        store, root = store_of(self.path)
        with store.open_input_file(f"{root}/{listing}") as f:
            return [*(json.loads(b)["file"] for b in f.read().decode().splitlines() if b), listing]

    def commit(self, messages: list[Listed | None]) -> None:
        store, root = store_of(self.path)
        manifest, before = f"{root}/{MANIFEST}", []
        if _exists(store, manifest):
            with store.open_input_file(manifest) as f:
                before = json.loads(f.read())["lists"]
        lists = [(m.listing, m.blocks) for m in messages if m is not None]
        fresh = f"{manifest}.{uuid.uuid4().hex}"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(fresh) as f:
            f.write(json.dumps({"lists": lists if self.overwrite else [*before, *lists]}).encode())
        store.move(fresh, manifest)
        if self.overwrite:
            for name, _ in before:
                self._delete(self._files(name))

    def abort(self, messages: list[Listed | None]) -> None:
        for m in messages:
            if m is not None:
                self._delete(self._files(m.listing))


class NpyDataSource(DataSource):
    """``spark.read.format("npy").load(path)`` and ``df.write.format("npy").save(path)``, on any store Arrow reaches."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "raster_id string, row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        missing = {"raster_id", "row", "col", "value"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"Expected cells, columns missing: {sorted(missing)}")
        return NpyWriter(self.options["path"], overwrite)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Cells of one ``.npy`` file, or of all in a folder; the raster is named by its file. NaN -> NULL."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").load(path)


def save_npy(cells: DataFrame, path: str, mode: str = "append") -> None:
    """All rasters as blocks under ``path``, with a manifest; cells that are not there are written as missing.

    Works on stores without random writes. ``read_npy`` reads it back; ``write_npy`` makes one file per raster.
    """
    from reliefgrid.operators.grid import complete_cells, raster_meta

    cells.sparkSession.dataSource.register(NpyDataSource)
    whole = complete_cells(cells, cut(raster_meta(cells)))
    block = [F.col("raster_id"), F.shiftright("row", BLOCK_ROW_BITS), F.shiftright("col", BLOCK_COL_BITS)]
    placed = whole.repartition(*block).sortWithinPartitions(*block, "row", "col")
    placed.write.format("npy").mode(mode).save(path)


def npy_path(folder: str, raster: str) -> str:
    """File of a raster; ids such as image URIs are escaped, and read back as they were."""
    return os.path.join(folder, f"{quote(str(raster), safe=' ')}.npy")


def write_npy(cells: DataFrame, folder: str) -> str:
    """One ``.npy`` file per raster in a folder that all executors share.

    Each file is created at its full size first, then every task writes its cells at their places:
    no task or driver ever holds a whole grid, and a repeated task writes the same bytes again.
    """
    from reliefgrid.operators.grid import complete_cells, raster_meta

    os.makedirs(folder, exist_ok=True)

    def create(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            starts = []
            for raster, h, w in pdf[["raster_id", "height", "width"]].itertuples(index=False):
                path = npy_path(folder, raster)
                starts.append(np.lib.format.open_memmap(path, mode="w+", dtype=np.float64, shape=(h, w)).offset)
            yield pdf[["raster_id", "width"]].assign(start=starts)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raster, g in pdf.groupby("raster_id", sort=False):
                at = g["row"].to_numpy(np.int64) * int(g["width"].iloc[0]) + g["col"].to_numpy(np.int64)
                v = g["value"].to_numpy(dtype=np.float64, na_value=np.nan)
                breaks = np.flatnonzero(np.diff(at) != 1) + 1
                with open(npy_path(folder, raster), "r+b") as f:
                    for a, part in zip(at[np.r_[0, breaks]], np.split(v, breaks)):
                        f.seek(int(g["start"].iloc[0]) + 8 * int(a))
                        f.write(part.tobytes())
            yield pd.DataFrame({"cells": [len(pdf)]})

    meta = cut(raster_meta(cells))
    files = cut(meta.mapInPandas(create, "raster_id string, width int, start long"))
    placed = attach(complete_cells(cells, meta), files, ["raster_id"])
    spread = placed.repartition("raster_id", F.shiftright("row", 6), F.shiftright("col", 12))
    spread.sortWithinPartitions("raster_id", "row", "col").mapInPandas(write, "cells long").agg(F.sum("cells")).collect()
    return folder
