"""Shapefiles as a Spark data source, format("shapefile"): one row a point of a line or ring.

A folder is read with everything below it. The driver only lists files: how many records a file has follows from the length
of its index (.shx), and a task reads its own slice of the index and then only the bytes of those records. Small files share
a task, large ones are parted (option pieceBytes). A file without an index is one piece, walked by its record headers.

The layer is the file's name; the track is the folder it lies in, or that folder's parent where the folder has the layer's
name. Null shapes, points and empty parts give no rows. The coordinate system comes from the .prj text: geographic ones count
as EPSG:4326, Web Mercator as EPSG:3857; without a .prj it is null; any other one is an error, as nothing here could project
it. A record that ends beyond its file is an error that names both. Paths are opened by pyarrow.fs (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "track_id string, layer string, record int, part int, pt_idx int, x double, y double, crs string"
NAMES = ["track_id", "layer", "record", "part", "pt_idx", "x", "y", "crs"]
PIECE_BYTES = 16 << 20
READ_BYTES = 4 << 20
BATCH_ROWS = 10_000
#: Fixed values of the format: bytes before the first record and entry, of an index entry, of a record's header.
FILE_HEADER, ENTRY, RECORD_HEADER = 100, 8, 8
#: Fixed values of the format: lines and polygons, plain, with heights, with measures.
PARTED = (3, 5, 13, 15, 23, 25)


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if re.match(r"[a-z0-9]+:", root) else (fs.LocalFileSystem(), root)


def track_and_layer(path: str) -> tuple[str, str]:
    *folders, name = path.split("/")
    layer = name.rpartition(".")[0]
    if len(folders) > 1 and folders[-1] == layer:
        folders = folders[:-1]
    return (folders[-1] if folders else ""), layer


def crs_of(text: str, path: str = "") -> str:
    """EPSG:4326 or EPSG:3857 by the text of a .prj file."""
    flat = re.sub(r"[\s_\-]", "", text).lower()
    if flat.startswith(("geogcs", "geogcrs", "geodcrs")):
        return "EPSG:4326"
    if any(name in flat for name in ("webmercator", "pseudomercator", "popularvisualisation", "mercatorauxiliarysphere")):
        return "EPSG:3857"
    raise ValueError(f"{path}: no geographic or Web Mercator coordinate system: {text[:80]}")


def parts_of(content: bytes) -> Iterator[np.ndarray]:
    """The points (n x 2) of each part that has any."""
    if len(content) < 4 or struct.unpack_from("<i", content)[0] not in PARTED:
        return
    n_parts, n_points = struct.unpack_from("<2i", content, 36)
    starts = np.frombuffer(content, "<i4", n_parts, 44)
    points = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    for a, b in zip(starts, [*starts[1:], n_points], strict=True):
        if a < b:
            yield points[a:b]


class Piece(InputPartition):
    """Records (path, first, count) of one or more files; count None: all, without an index."""

    def __init__(self, files: list[tuple[str, int, int | None]]):
        self.files = files


class ShapefileReader(DataSourceReader):
    def __init__(self, root: str, piece_bytes: int):
        self.root, self.piece_bytes = root, piece_bytes

    def _sizes(self) -> dict[str, int]:
        """Sizes of the files below the root, or of the files that share the root's name."""
        system, base = open_root(self.root)
        single = system.get_file_info(base).type == fs.FileType.File
        found = system.get_file_info(fs.FileSelector(base.rpartition("/")[0] if single else base, recursive=not single))
        stem = base.rpartition(".")[0] + "."
        return {f.path: f.size for f in found if f.is_file and (not single or f.path.startswith(stem))}

    def partitions(self) -> list[Piece]:
        sizes = self._sizes()
        runs = []
        for path in sorted(p for p in sizes if p.lower().endswith(".shp")):
            index = path[:-1] + ("X" if path.endswith("P") else "x")
            if index not in sizes:
                runs.append((sizes[path], (path, 0, None)))
                continue
            records = max(0, sizes[index] - FILE_HEADER) // ENTRY
            step = max(1, records * self.piece_bytes // max(1, sizes[path]))
            runs += [(sizes[path] * min(step, records - k) // records, (path, k, min(step, records - k))) for k in range(0, records, step)]
        pieces, room = [], 0
        for size, run in runs:
            if not pieces or size > room:
                pieces.append([])
                room = self.piece_bytes
            pieces[-1].append(run)
            room -= size
        return [Piece(p) for p in pieces] or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = open_root(self.root)
        for path, first, count in partition.files:
            named = (*track_and_layer(path), self._crs(system, path))
            held, rows = [], 0
            with system.open_input_file(path) as shp:
                spans = self._walk(shp) if count is None else self._indexed(system, path, first, count)
                for number, content in self._contents(shp, spans, path):
                    for part, points in enumerate(parts_of(content)):
                        held.append((number, part, points))
                        rows += len(points)
                        if rows >= BATCH_ROWS:
                            yield self._batch(held, *named)
                            held, rows = [], 0
            if held:
                yield self._batch(held, *named)

    @staticmethod
    def _batch(held: list[tuple[int, int, np.ndarray]], track: str, layer: str, crs: str | None) -> pa.RecordBatch:
        numbers, parts, points = zip(*held, strict=True)
        sizes = [len(p) for p in points]
        xy = np.concatenate(points)
        same = lambda text: pa.array([text] * len(xy), pa.string())
        each = lambda ks: pa.array(np.repeat(np.array(ks, np.int32), sizes))
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        return pa.RecordBatch.from_arrays([same(track), same(layer), each(numbers), each(parts), pa.array(at), pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy()), same(crs)], NAMES)

    @staticmethod
    def _crs(system: fs.FileSystem, path: str) -> str | None:
        for ending in (".prj", ".PRJ"):
            name = path[:-4] + ending
            if system.get_file_info(name).is_file:
                with system.open_input_file(name) as f:
                    return crs_of(f.read().decode("utf-8", "replace"), name)
        return None

    @staticmethod
    def _indexed(system: fs.FileSystem, path: str, first: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(record, offset, length of its content) from the index; both are stored in words of 16 bits."""
        with system.open_input_file(path[:-1] + ("X" if path.endswith("P") else "x")) as shx:
            entries = np.frombuffer(shx.read_at(ENTRY * count, FILE_HEADER + ENTRY * first), ">i4").reshape(-1, 2)
        for k, (offset, length) in enumerate(entries.tolist()):
            yield first + k, 2 * offset, 2 * length

    @staticmethod
    def _walk(shp: pa.NativeFile) -> Iterator[tuple[int, int, int]]:
        at, k, end = FILE_HEADER, 0, shp.size()
        while at + RECORD_HEADER <= end:
            length = 2 * struct.unpack(">2i", shp.read_at(RECORD_HEADER, at))[1]
            yield k, at, length
            at, k = at + RECORD_HEADER + length, k + 1

    @staticmethod
    def _contents(shp: pa.NativeFile, spans: Iterator[tuple[int, int, int]], path: str) -> Iterator[tuple[int, bytes]]:
        """(record, content); records that follow one another in the file are read together."""
        end = shp.size()

        def read(run):
            base = run[0][1]
            data = shp.read_at(run[-1][1] + RECORD_HEADER + run[-1][2] - base, base)
            for number, offset, length in run:
                at = offset - base + RECORD_HEADER
                yield number, data[at : at + length]

        run: list[tuple[int, int, int]] = []
        for number, offset, length in spans:
            if length < 0 or offset + RECORD_HEADER + length > end:
                raise ValueError(f"{path}: record {number} ends beyond the file")
            follows = run and run[-1][1] + RECORD_HEADER + run[-1][2] == offset
            if run and (not follows or offset + RECORD_HEADER + length - run[0][1] > READ_BYTES):
                yield from read(run)
                run = []
            run.append((number, offset, length))
        if run:
            yield from read(run)


class ShapefileSource(DataSource):
    """spark.read.format("shapefile").load(folder); option pieceBytes bounds what one task reads."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options["path"], int(self.options.get("pieceBytes", PIECE_BYTES)))
