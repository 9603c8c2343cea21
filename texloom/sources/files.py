"""Texture files as a Spark data source and sink, and reads of byte ranges.

`opened` takes the first bytes of each file, so that opening a directory reads 148 bytes a file whatever its size; the
folders are listed by tasks, and no list of files comes to the driver. `spark.read.format("texture")` gives the same rows
(path, length, head) to SQL and options. Headers, formats and layouts are Column expressions over that; the surfaces, strips or regions
asked for become rows (path, start, length), filters drop those that are not wanted, and `with_bytes` reads what is left.

`write` sends pieces (file, start, data) to the sink: a file's pieces come sorted to one task, which appends them one by one
and checks that they fill the file. Files stand under a hidden folder until the whole job is committed.

Paths are opened through pyarrow's file systems, so a folder may lie in any store that these reach.
"""

from __future__ import annotations

import io
import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from texloom.operators import layout
from texloom.sources import container

HEAD_BYTES = 148
#: Files of one read task of the source while it has fewer than that many tasks, and bytes that one read takes at most.
FILES_PER_TASK, READ_TASKS, READ_BYTES = 1000, 32, 4 << 20
#: Tasks that list folders, and rows of the batches in which paths and heads are passed on.
LISTING_TASKS, BATCH_ROWS = 32, 10_000
#: Bytes of the batches that the sink takes; a longer piece comes alone.
BATCH_BYTES, _BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


class TextureFileError(ValueError):
    """A written file is not what its header says: MissingSurfaces, TooManySurfaces or UnexpectedSurfaceSize."""


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# -- source ------------------------------------------------------------------------------------------------------------


def _all_entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, fs.FileType]]:
    """Path and type of what stands in a folder, one by one.

    Only local folders (mounted ones too) are read piecemeal; other stores give a folder's names at once."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                yield entry.path, fs.FileType.Directory if entry.is_dir() else fs.FileType.File if entry.is_file() else fs.FileType.Unknown
    else:
        for info in store.get_file_info(fs.FileSelector(folder)):
            yield info.path, info.type


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Path of each file and folder in a folder, and whether it is a folder; names that begin with a dot or a line are hidden."""
    for path, kind in _all_entries(store, folder):
        if path.rsplit("/", 1)[-1][:1] not in ("", ".", "_") and kind in (fs.FileType.Directory, fs.FileType.File):
            yield path, kind == fs.FileType.Directory


def _below(store: fs.FileSystem, folder: str) -> Iterator[str]:
    """The files in a folder and in those below it: what is held grows with the depth alone."""
    for path, is_folder in _entries(store, folder):
        if is_folder:
            yield from _below(store, path)
        else:
            yield path


def _top(store: fs.FileSystem, path: str) -> Iterator[tuple[str, bool]]:
    """Files and folders of the first folder that holds more than one folder, and the files above it."""
    only = path
    while only is not None:
        folder, only, many = only, None, False
        for name, is_folder in _entries(store, folder):
            if is_folder and not many and only is None:
                only = name
                continue
            if is_folder and only is not None:
                yield only, True
                only, many = None, True
            yield name, is_folder


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _heads(store: fs.FileSystem, paths: Iterator[str]) -> Iterator[tuple[str, int, bytes]]:
    for path in paths:
        with store.open_input_file(path) as file:
            yield path, file.size(), file.read(HEAD_BYTES)


_PATHS = pa.schema([("path", pa.string()), ("folder", pa.bool_())])
_HEADS = pa.schema([("path", pa.string()), ("length", pa.int64()), ("head", pa.binary())])


def heads(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, length and head of the files under a folder, or of one file, in the order of their paths.

    One task lists the top, some the folders below, then the files are dealt to all by ranges of paths. The plan holds `path`
    alone, the driver a sample of paths that is bounded by the number of tasks."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            store, root = _open(path)
            alone = store.get_file_info(root).type == fs.FileType.File
            yield from _batches(iter([(root, False)]) if alone else (x for x in _top(store, root) if x[1] or x[0].endswith(suffix)), _PATHS)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(path)
        for batch in batches:
            for name, is_folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = (x for x in _below(store, name) if x.endswith(suffix)) if is_folder else iter([name])
                yield from _batches(((x, False) for x in found), _PATHS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(path)
        for batch in batches:
            yield from _batches(_heads(store, iter(batch.column("path").to_pylist())), _HEADS)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = spark.range(0, 1, 1, 1).mapInArrow(top, "path string, folder boolean")
    listed = first.repartition(min(tasks, LISTING_TASKS)).mapInArrow(below, "path string, folder boolean")
    dealt = listed.select("path").repartitionByRange(tasks, "path").sortWithinPartitions("path")
    return dealt.mapInArrow(read, "path string, length long, head binary")


@dataclass
class Share(InputPartition):
    """The files whose paths have this remainder: no names, so that the plan does not grow with the files."""

    at: int
    of: int


class HeadReader(DataSourceReader):
    """path, length and head of the files under a folder, or of one file, in any order. Each task lists the folder and takes its share."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.per_task = int(options.get("filespertask", FILES_PER_TASK))

    def _paths(self) -> Iterator[str]:
        store, path = _open(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return iter([path])
        return (x for x in _below(store, path) if x.endswith(self.suffix))

    def partitions(self) -> list[Share]:
        counted = sum(1 for _ in itertools.islice(self._paths(), self.per_task * READ_TASKS))
        tasks = max(1, -(-counted // self.per_task))
        return [Share(at, tasks) for at in range(tasks)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        own = (x for x in self._paths() if zlib.crc32(x.encode()) % partition.of == partition.at)
        yield from _batches(_heads(store, own), _HEADS)


class TextureSource(DataSource):
    """Format `texture`. Options: path; suffix, that names must end with; filesPerTask. Sink option: path."""

    @classmethod
    def name(cls) -> str:
        return "texture"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema: StructType) -> HeadReader:
        return HeadReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextureSource)


def opened(spark: SparkSession, path: str, options: container.ParseOptions = container.ParseOptions(), format: str | None = None, suffix: str = "") -> DataFrame:
    """The headers of the files under `path` with format and layout: file_id, path, length and what `layout.with_layout` adds.

    Permissive options also repair headers by the file's length. `format` overrides what a header says, as for formats that
    no header can name. Bad files are rows with an error or a layout_error."""
    files = heads(spark, path, suffix).select(F.xxhash64("path").alias("file_id"), "path", "length", F.col("head").alias("content"))
    headers = container.with_format(container.parse(container.raw_words(files, options), options))
    if format is not None:
        info = layout_info(spark, format)
        headers = headers.withColumns({"format": F.lit(format)} | {c: F.lit(v) for c, v in info.items()})
    if options.permissive:
        headers = container.repair(headers, F.col("length") + (4 if options.skip_magic else 0))
    return layout.with_layout(headers).withColumn("data_start", F.lit(0 if options.skip_magic else 4) + F.when(F.col("version") == "dx10", 144).otherwise(124))


def layout_info(spark: SparkSession, format: str) -> dict:
    row = container.dims.formats(spark).filter(F.col("format") == format).first()
    if row is None:
        raise ValueError(f"no such format: {format}")
    return {c: row[c] for c in layout.INFO}


# -- surfaces, strips, regions -----------------------------------------------------------------------------------------


def surfaces(headers: DataFrame) -> DataFrame:
    """A row for each surface of the opened files: start and size of its bytes in the file, and the data bytes before it (elapsed)."""
    rows = layout.surfaces(headers.withColumnRenamed("length", "file_length").withColumn("pixel_kind", F.col("kind")), ["path", "format", "data_start", "file_length", "pixel_kind", *layout.INFO[1:]])
    elapsed = F.col("offset").cast("long")
    return rows.withColumns({"elapsed": elapsed, "start": F.col("data_start") + elapsed, "size": F.col("len").cast("long")}).drop("offset", "len", "data_start")


def region(rows: DataFrame, x: Column, y: Column, width: Column, height: Column) -> DataFrame:
    """The byte ranges that hold a rectangle of each surface: a row for each line of blocks, or one for whole lines.

    Adds error (RectOutOfBounds, else null), first_x and first_y (the pixel that the bytes begin with), span and lines (pixels
    of a row of bytes and rows of pixels in it), start and size. An empty rectangle needs no bytes and has no rows; a
    rectangle out of bounds has one row without bytes. Formats with two planes are read in whole lines of both."""
    rect = rows.withColumns({"_x": x.cast("long"), "_y": y.cast("long"), "_w": width.cast("long"), "_h": height.cast("long")})
    bad = (F.col("_x") < 0) | (F.col("_y") < 0) | (F.col("_w") < 0) | (F.col("_h") < 0) | (F.col("_x") + F.col("_w") > F.col("width")) | (F.col("_y") + F.col("_h") > F.col("height"))
    bw, bh = F.greatest("block_w", F.lit(1)), F.greatest("block_h", F.lit(1))
    left, right = F.floor(F.col("_x") / bw), F.ceil((F.col("_x") + F.col("_w")) / bw)
    top, bottom = F.floor(F.col("_y") / bh), F.ceil((F.col("_y") + F.col("_h")) / bh)
    across = F.ceil(F.col("width") / bw)
    planar = F.col("pixel_kind") == "biplanar"
    whole = planar | ((left == 0) & (right == across))
    line = F.when(~planar, across * F.col("bytes"))
    one = F.struct(F.lit(0).cast("long").alias("at"), F.col("size").alias("n"), F.lit(0).cast("long").alias("fx"), F.lit(0).cast("long").alias("fy"), F.col("width").alias("span"), F.col("height").alias("lines"))
    lines = F.struct((top * line).cast("long").alias("at"), ((bottom - top) * line).cast("long").alias("n"), F.lit(0).cast("long").alias("fx"), (top * bh).cast("long").alias("fy"), F.col("width").alias("span"), (F.least(bottom * bh, F.col("height")) - top * bh).cast("long").alias("lines"))
    each = F.transform(
        F.sequence(top.cast("long"), F.greatest(bottom - 1, top).cast("long")),
        lambda j: F.struct((j * line + left * F.col("bytes")).cast("long").alias("at"), ((right - left) * F.col("bytes")).cast("long").alias("n"), (left * bw).cast("long").alias("fx"), (j * bh).cast("long").alias("fy"), (F.least(right * bw, F.col("width")) - left * bw).cast("long").alias("span"), F.least(bh.cast("long"), F.col("height") - j * bh).cast("long").alias("lines")),
    )
    nothing = F.array().cast("array<struct<at:bigint,n:bigint,fx:bigint,fy:bigint,span:bigint,lines:bigint>>")
    none = F.array(F.struct(*(F.lit(None).cast("long").alias(c) for c in ("at", "n", "fx", "fy", "span", "lines"))))
    parts = F.when(bad, none).when((F.col("_w") == 0) | (F.col("_h") == 0), nothing).when(planar, F.array(one)).when(whole, F.array(lines)).otherwise(each)
    out = rect.withColumn("error", F.when(bad, "RectOutOfBounds")).withColumn("_p", F.explode(parts))
    return out.withColumns({"start": F.col("start") + F.col("_p.at"), "size": F.col("_p.n"), "first_x": F.col("_p.fx"), "first_y": F.col("_p.fy"), "span": F.col("_p.span"), "lines": F.col("_p.lines")}).withColumnsRenamed({"_x": "x", "_y": "y", "_w": "rect_width", "_h": "rect_height"}).drop("_p")


def strips(rows: DataFrame, pixels: int = 1 << 16) -> DataFrame:
    """The surfaces cut into strips of whole lines of blocks with about `pixels` pixels each: start, size, first_y, lines."""
    bh = F.greatest("block_h", F.lit(1))
    planar = F.col("pixel_kind") == "biplanar"
    high = F.when(planar, F.col("height")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(pixels) / F.col("width") / bh)) * bh).cast("long")
    line = (F.ceil(F.col("width") / F.greatest("block_w", F.lit(1))) * F.col("bytes")).cast("long")
    cut = rows.withColumn("_high", high).withColumn("first_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1, F.col("_high"))))
    lines = F.least(F.col("_high"), F.col("height") - F.col("first_y"))
    start = F.when(planar, F.col("start")).otherwise(F.col("start") + (F.col("first_y") / bh).cast("long") * line)
    size = F.when(planar, F.col("size")).otherwise(F.ceil(lines / bh) * line).cast("long")
    return cut.withColumns({"start": start, "size": size, "lines": lines}).drop("_high")


def with_bytes(rows: DataFrame) -> DataFrame:
    """Adds data: the bytes of each row's range (path, start, size); null where the file is shorter or there is no range.

    Ranges are read one by one, a batch ends when it holds `READ_BYTES`; a file stays open from one row to the next."""
    schema = StructType([*rows.schema.fields, StructField("data", BinaryType())])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        try:
            for batch in batches:
                data, held, first = [], 0, 0
                for i, (path, start, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size")), strict=True)):
                    if held >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, i - first) for c in names), pa.array(data, pa.binary())], [*names, "data"])
                        data, held, first = [], 0, i
                    if size is None or start is None:
                        data.append(None)
                        continue
                    if path != opened:
                        if source is not None:
                            source.close()
                        store, name = _open(path)
                        opened, source = path, store.open_input_file(name)
                    part = source.read_at(size, start) if start + size <= source.size() else None
                    data.append(part)
                    held += len(part or b"")
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first) for c in names), pa.array(data, pa.binary())], [*names, "data"])
        finally:
            if source is not None:
                source.close()

    return rows.mapInArrow(run, schema)


# -- sink --------------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """The file in which a task notes where its files belong: a line for each, so that no list of them reaches the driver."""

    moves: str


class PieceWriter(DataSourceArrowWriter):
    """Appends pieces to files: rows file, file_size, start, data, sorted by file and start within a task."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.hidden = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        _, hidden = _open(self.hidden)
        own = f"{hidden}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        name, out, size, at, count = None, None, 0, 0, itertools.count()
        noted = f"{own}.moves"
        moves = store.open_output_stream(noted)

        def close() -> None:
            if out is not None:
                out.close()
                if at < size:
                    raise TextureFileError(f"MissingSurfaces: {name} has {at} of {size} bytes")

        try:
            for batch in batches:
                for row in range(batch.num_rows):
                    file, total, start, data = (batch.column(c)[row] for c in ("file", "file_size", "start", "data"))
                    if file.as_py() != name:
                        close()
                        name, size, at = file.as_py(), total.as_py(), 0
                        temporary = f"{own}/{next(count)}"
                        out = store.open_output_stream(temporary)
                        moves.write(json.dumps([temporary, f"{root}/{name}"]).encode() + b"\n")
                    if start.as_py() is None:
                        raise TextureFileError(f"TooManySurfaces: {name} has a surface that its header does not want")
                    piece = data.as_buffer()
                    if start.as_py() > at:
                        raise TextureFileError(f"MissingSurfaces: {name} has nothing from byte {at} to {start.as_py()}")
                    if start.as_py() < at:
                        raise TextureFileError(f"UnexpectedSurfaceSize: {name} has two pieces at byte {start.as_py()}")
                    if at + piece.size > size:
                        raise TextureFileError(f"TooManySurfaces: {name} is longer than its {size} bytes")
                    out.write(piece)
                    at += piece.size
            close()
        finally:
            if out is not None and not out.closed:
                out.close()
            moves.close()
        return Written(noted)

    def commit(self, messages: list[Written | None]) -> None:
        """Move the files to their places: names only, no data, read one by one. What an overwritten folder held goes first."""
        store, root = _open(self.path)
        _, hidden = _open(self.hidden)
        if self.overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            for path, kind in _all_entries(store, root):
                if path.rstrip("/") != hidden.rstrip("/"):
                    store.delete_dir(path) if kind == fs.FileType.Directory else store.delete_file(path)
        made = None
        for message in messages:
            if message:
                with store.open_input_stream(message.moves) as stream:
                    for line in io.BufferedReader(stream):
                        source, target = json.loads(line)
                        if (folder := target.rsplit("/", 1)[0]) != made:
                            store.create_dir(folder, recursive=True)
                            made = folder
                        store.move(source, target)
        self._clear(store, hidden)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _open(self.path)
        self._clear(store, _open(self.hidden)[1])

    @staticmethod
    def _clear(store: fs.FileSystem, hidden: str) -> None:
        if store.get_file_info(hidden).type == fs.FileType.Directory:
            store.delete_dir(hidden)


def checked(headers: DataFrame, data: DataFrame) -> DataFrame:
    """file, file_size, start, data of the pieces of whole files: their headers, and `data` under the surfaces of its layout.

    `headers` comes from `layout.with_layout` and has a column file; `data` has file, array_index, mip_level, depth_slice and
    data. A surface that is wanted and not there leaves a gap, one that is not wanted (or whose file has no header) has no place,
    and one of another length does not fit: the sink then refuses the file."""
    sized = headers.withColumns({"head": F.when(F.col("version") == "dx10", 148).otherwise(128).cast("long"), "n": F.col("data_len").cast("long")})
    words = container.to_words(sized, ["file", "head", "n"])
    first = words.select("file", (F.col("head") + F.col("n")).alias("file_size"), F.lit(0).cast("long").alias("start"), container.write_raw(words).alias("data"))
    places = layout.surfaces(sized, ["file", "head", "n"]).select("file", "array_index", "mip_level", "depth_slice", (F.col("head") + F.col("n")).alias("file_size"), (F.col("head") + F.col("offset").cast("long")).alias("start"))
    # a row for each surface, few bytes of Parquet: by that size Spark would gather them on the driver to broadcast them
    given = data.join(places.hint("merge"), ["file", "array_index", "mip_level", "depth_slice"], "left")
    return first.unionByName(given.select("file", "file_size", "start", "data"))


def write(pieces: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write `pieces` (file, file_size, start, data) as files under `path`: a file's pieces meet in one task, in order.

    Batches are bounded by bytes meanwhile: Spark's 10,000 rows are held whole on both sides, however long the pieces are."""
    spark = pieces.sparkSession
    register(spark)
    dealt = pieces.select("file", "file_size", "start", "data").repartition("file").sortWithinPartitions("file", "start")
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    try:
        dealt.write.format("texture").option("path", path).mode("overwrite" if overwrite else "append").save()
    finally:
        spark.conf.unset(_BATCH_BYTES) if before is None else spark.conf.set(_BATCH_BYTES, before)
