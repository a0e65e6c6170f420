"""Reader for uncompressed LAS 1.2 to 1.4 files, as the data source ``las``.

``register(spark)`` names it; then ``spark.read.format("las").option("path", ...)``. ``path`` is a file, a folder or several of
them with spaces between: local names, or addresses of a file system that Arrow opens (``hdfs://``, ``s3://`` and others), so
that executors need no copy. ``x0, y0, x1, y1`` give an area of interest:
files whose header box misses it aren't opened again, and only points inside (borders included) are returned. Large files
are read in parts of ``points`` records (1,000,000). A folder without LAS files gives no rows; LAZ files raise an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, pid long, x double, y double, z double, intensity int, classification int"


@dataclass
class Header:
    """What a file's public header says of its points; ``box`` is x0, y0, x1, y1."""

    start: int
    records: int
    length: int
    kind: int
    scale: tuple
    shift: tuple
    box: tuple
    vlr_start: int
    vlrs: int


def opened(path: str):
    """A file to read at any place, local or by the file system that its address names."""
    store, name = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
    return store.open_input_file(name)


def header(path: str) -> Header:
    with opened(path) as f:
        raw = f.read(375)
    if len(raw) < 227 or raw[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    size, start, vlrs, kind, length, records = struct.unpack_from("<HIIBHI", raw, 94)
    if kind & 0xC0:
        raise ValueError(f"{path} is compressed; LAZ needs a decoder that is not at hand")
    if kind > 10:
        raise ValueError(f"{path} has the unknown point format {kind}")
    if raw[25] >= 4 and len(raw) >= 255:
        records = struct.unpack_from("<Q", raw, 247)[0]
    x1, x0, y1, y0 = struct.unpack_from("<4d", raw, 179)
    return Header(start, records, length, kind, struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155), (x0, y0, x1, y1), size, vlrs)


def wkt(path: str) -> str | None:
    """The coordinate system as text (record 2112), or None if the file names none."""
    h = header(path)
    with opened(path) as f:
        f.seek(h.vlr_start)
        for _ in range(h.vlrs):
            _, user, record, length, _ = struct.unpack("<H16sHH32s", f.read(54))
            body = f.read(length)
            if record == 2112 and user.rstrip(b"\0") == b"LASF_Projection":
                return body.rstrip(b"\0").decode("utf-8", "replace")
    return None


def files(paths: str) -> list[str]:
    """LAS and LAZ files of the named files and folders, sorted within each folder."""
    found: list[str] = []
    for name in paths.split():
        if "://" in name:
            store, at = FileSystem.from_uri(name)
            if store.get_file_info(at).type == FileType.Directory:
                root = name.rstrip("/")[: -len(at.rstrip("/"))]
                found += sorted(root + f.path for f in store.get_file_info(FileSelector(at)) if f.extension in ("las", "LAS", "laz", "LAZ"))
            else:
                found.append(name)
            continue
        p = Path(name)
        found += [str(c) for c in sorted(p.iterdir()) if c.suffix in (".las", ".LAS", ".laz", ".LAZ")] if p.is_dir() else [name]
    return found


@dataclass
class Part(InputPartition):
    path: str
    first: int
    count: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.size = options.get("path", ""), int(options.get("points", 1_000_000))
        corners = [options.get(k) for k in ("x0", "y0", "x1", "y1")]
        if any(c is not None for c in corners) and None in corners:
            raise ValueError("an area of interest needs x0, y0, x1 and y1")
        self.area = None if None in corners else tuple(map(float, corners))

    def partitions(self) -> list[Part]:
        parts = []
        for path in files(self.paths):
            h = header(path)
            if self.area and (h.box[0] > self.area[2] or h.box[2] < self.area[0] or h.box[1] > self.area[3] or h.box[3] < self.area[1]):
                continue
            parts += [Part(path, i, min(self.size, h.records - i)) for i in range(0, h.records, self.size)]
        return parts or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        h = header(part.path)
        at = 15 if h.kind < 6 else 16
        record = np.dtype({"names": ["xyz", "intensity", "cls"], "formats": ["<3i4", "<u2", "u1"], "offsets": [0, 12, at], "itemsize": h.length})
        for first in range(part.first, part.first + part.count, 65536):
            n = min(65536, part.first + part.count - first)
            with opened(part.path) as f:
                f.seek(h.start + first * h.length)
                rows = np.frombuffer(f.read(n * h.length), record) if h.length else np.zeros(0, record)
            if len(rows) < n:
                raise ValueError(f"{part.path} ends before its {h.records} points")
            xyz = rows["xyz"] * np.array(h.scale) + np.array(h.shift)
            cls = rows["cls"] & (31 if h.kind < 6 else 255)
            keep = np.ones(n, bool)
            if self.area:
                x0, y0, x1, y1 = self.area
                keep = (xyz[:, 0] >= x0) & (xyz[:, 0] <= x1) & (xyz[:, 1] >= y0) & (xyz[:, 1] <= y1)
            pid = np.arange(first, first + n)[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.path] * len(pid), pa.string()), pa.array(pid, pa.int64()), *(pa.array(xyz[keep, i], pa.float64()) for i in range(3)),
                 pa.array(rows["intensity"][keep], pa.int32()), pa.array(cls[keep], pa.int32())],
                names=["file", "pid", "x", "y", "z", "intensity", "classification"],
            )


class Las(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Las)
