"""Record files: RECFM F, FB, V, VB and N to rows (file, rec_no, record), and back.

Tasks read byte ranges of files of any size, as streams: RANGE bytes of an F, FB or VB file a
task (VB files are cut at block starts, which a walk over the block lengths finds by seeking).
V and N files can only be read from their start, so there a file is a task, in bounded memory.
Fixed records are cut by one Arrow view of a range's bytes. Ranges are read through pyarrow's
file systems (local, HDFS, S3, GCS); files that only Spark can open are read whole
(whole=True), as frame() does for rows that hold contents.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FRAMED = "file string, rec_no long, rdw binary, bdw binary, record binary"
RANGE = 64 << 20  # bytes that a task reads, about
WINDOW = 4 << 20  # bytes that are held while a stream is walked, but for longer records
Unit = tuple[bytes | None, bytes | None, bytes]


def _walk(stream, cut: Callable[[memoryview, bool], Iterator[tuple[int, Unit | None]]]) -> Iterator[Unit]:
    """What cut finds in a stream. cut(view, last) gives (end, unit) as far as the view goes."""
    held, window = b"", WINDOW
    while True:
        more = stream.read(window)
        held, last, used = held + more, len(more) < window, 0
        for end, unit in cut(memoryview(held), last):
            used = end
            if unit is not None:
                yield unit
        held = held[used:]
        if last:
            return
        window = WINDOW if used else 2 * window  # a record that the window doesn't hold


def _lengths(view: memoryview, last: bool, what: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what begins with its own length in two bytes."""
    at = 0
    while at < len(view):
        size = struct.unpack_from(">H", view, at)[0] if at + 2 <= len(view) else 0
        if at + max(size, 4) > len(view) and not last:
            return
        if size < 4 or at + size > len(view):
            raise ValueError(f"the {what} at {at} says it has {size} bytes")
        yield at, at + size
        at += size


def _cut_v(view: memoryview, last: bool) -> Iterator[tuple[int, Unit]]:
    for a, b in _lengths(view, last, "record"):
        yield b, (bytes(view[a : a + 4]), None, bytes(view[a + 4 : b]))


def _cut_vb(view: memoryview, last: bool) -> Iterator[tuple[int, Unit | None]]:
    for a, b in _lengths(view, last, "block"):
        bdw = bytes(view[a : a + 4])
        for x, y in _lengths(view[a + 4 : b], True, "record"):
            yield a, (bytes(view[a + 4 + x : a + 8 + x]), bdw, bytes(view[a + 8 + x : a + 4 + y]))
        yield b, None


def frame_v(raw: bytes) -> Iterator[Unit]:
    """(rdw, None, data): each record has a 4-byte descriptor whose length counts itself."""
    return _walk(io.BytesIO(raw), _cut_v)


def frame_vb(raw: bytes) -> Iterator[Unit]:
    """(rdw, bdw, data): blocks of records, each with a descriptor of its own."""
    return _walk(io.BytesIO(raw), _cut_vb)


def _cut_n(size_of: Callable[[memoryview], int], most: int) -> Callable:
    def cut(view: memoryview, last: bool) -> Iterator[tuple[int, Unit]]:
        at = 0
        while at < len(view):
            if at + most > len(view) and not last:
                return
            size = size_of(view[at : at + most])
            if size > most:
                size = size_of(view[at:])
            if size <= 0:
                raise RuntimeError(f"the record at {at} uses no bytes")
            if at + size > len(view) and not last:
                return
            yield min(at + size, len(view)), (None, None, bytes(view[at : at + size]))
            at += size

    return cut


def frame_n(raw: bytes, size_of: Callable[[memoryview], int], most: int = 32_768) -> Iterator[Unit]:
    """No marks: the layout tells how many bytes each record uses."""
    return _walk(io.BytesIO(raw), _cut_n(size_of, most))


def _checked(recfm: str, lrecl: int | None, size_of) -> str:
    recfm = recfm.upper()
    if recfm not in ("F", "FB", "V", "VB", "N"):
        raise NotImplementedError(f"RECFM {recfm}")
    if recfm in ("F", "FB") and not lrecl:
        raise TypeError("fixed records need their length")
    if recfm == "N" and size_of is None:
        raise TypeError("unmarked records need a layout")
    return recfm


def _units(stream, recfm: str, size_of) -> Iterator[Unit]:
    return _walk(stream, _cut_v if recfm == "V" else _cut_vb if recfm == "VB" else _cut_n(size_of, 32_768))


def frame(files: DataFrame, recfm: str, lrecl: int | None = None, size_of: Callable[[memoryview], int] | None = None, skip: int = 0) -> DataFrame:
    """Rows of files (path, content): FRAMED. skip: bytes to leave out at each file's start."""
    recfm = _checked(recfm, lrecl, size_of)
    if recfm in ("F", "FB"):

        def records(content: Column) -> Column:
            starts = F.sequence(F.lit(skip), F.greatest(F.length(content), F.lit(skip)), F.lit(lrecl))
            return F.filter(F.transform(starts, lambda i: F.substring(content, i + 1, F.lit(lrecl))), lambda r: F.length(r) > 0)

        # bound once: a binary column is copied whole each time that a lambda function reads it
        cut = F.get(F.transform(F.array("content"), lambda c: records(c)), F.lit(0))
        rows = files.select(F.col("path").alias("file"), F.posexplode(cut).alias("_i", "record"))
        return _marked(rows.select("file", F.col("_i").cast("long").alias("rec_no"), "record"))

    def work(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = io.BytesIO(content.as_py())
                stream.seek(skip)
                yield from _batches(path, 0, _units(stream, recfm, size_of))

    return files.select("path", "content").mapInArrow(work, FRAMED)


def _marked(rows: DataFrame) -> DataFrame:
    """Fixed records as FRAMED."""
    return rows.select("file", "rec_no", rdw(F.col("record")).alias("rdw"), F.lit(None).cast("binary").alias("bdw"), "record")


def _batches(path: str, first: int, found: Iterator[Unit]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for i, (r, b, data) in enumerate(found):
        held.append((path, first + i, r, b, data))
        if len(held) == 4096:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "rec_no", "rdw", "bdw", "record"]
    )


def _filesystem(path: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if not re.match(r"(?!file:)[a-z0-9]+://", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def _open(path: str):
    system, inner = _filesystem(path)
    return system.open_input_file(inner)


def _fixed_ranges(files: DataFrame, lrecl: int, skip: int) -> DataFrame:
    step = max(1, RANGE // lrecl) * lrecl
    starts = F.filter(F.sequence(F.lit(skip).cast("long"), F.greatest("length", F.lit(skip)), F.lit(step).cast("long")), lambda i: i < F.col("length"))
    return files.select("path", F.explode(starts).alias("start"), F.lit(step).cast("long").alias("size"), F.lit(0).cast("long").alias("first"))


def _block_ranges(files: DataFrame, skip: int) -> DataFrame:
    """Ranges of VB files: they begin where blocks do, and know the number of their first record."""

    def work(batches):
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, start, out = skip, skip, []
                with _open(path) as f:
                    while at < length:
                        f.seek(at)
                        size = struct.unpack(">H", f.read(2).rjust(2, b"\0"))[0]
                        if size < 4 or at + size > length:
                            raise ValueError(f"the block at {at} says it has {size} bytes")
                        at += size
                        if at - start >= RANGE or at == length:
                            out.append((path, start, at - start))
                            start = at
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["path", "start", "size"])

    return files.mapInArrow(work, "path string, start long, size long")


def read_records(
    spark: SparkSession, path: str, recfm: str = "N", lrecl: int | None = None, size_of=None, skip: int = 0, whole: bool = False
) -> DataFrame:
    """FRAMED rows of all files at path. size_of: Layout.sizer, for N.

    rec_no counts within a file; in VB files within its block's place: it rises with the
    record's place, but has gaps (the block's offset counts).
    """
    recfm = _checked(recfm, lrecl, size_of)
    files = spark.read.format("binaryFile").load(path)
    if whole:
        return frame(files, recfm, lrecl, size_of, skip)
    files = files.select("path", "length")
    if recfm in ("V", "N"):

        def streams(batches):
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with _open(name) as f:
                        f.seek(skip)
                        yield from _batches(name, 0, _units(f, recfm, size_of))

        return files.select("path").mapInArrow(streams, FRAMED)

    total, largest = files.agg(F.sum("length"), F.max("length")).first()
    tasks = max(1, (total or 0) // RANGE)
    if recfm == "VB":
        ranges = _block_ranges(files, skip)
        ranges = ranges.repartition(tasks, "path", "start") if (largest or 0) > RANGE else ranges

        def blocks_of(batches):
            for batch in batches:
                for name, start, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    with _open(name) as f:
                        yield from _batches(name, start, _units(_Part(f, start, size), "VB", None))

        return ranges.mapInArrow(blocks_of, FRAMED)

    ranges = _fixed_ranges(files, lrecl, skip)
    ranges = ranges.repartition(tasks, "path", "start") if (largest or 0) > RANGE else ranges

    def records(batches):
        for batch in batches:
            for name, start, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with _open(name) as f:
                    part, first = _Part(f, start, size), (start - skip) // lrecl
                    step = max(1, WINDOW // lrecl) * lrecl
                    while raw := part.read(step):
                        n = len(raw) // lrecl
                        cut = pa.Array.from_buffers(pa.binary(lrecl), n, [None, pa.py_buffer(raw)]).cast(pa.binary())
                        if n * lrecl < len(raw):  # a short last record
                            cut = pa.concat_arrays([cut, pa.array([raw[n * lrecl :]], pa.binary())])
                        numbers = pa.array(range(first, first + len(cut)), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.string()), numbers, cut], names=["file", "rec_no", "record"])
                        first += len(cut)

    return _marked(ranges.mapInArrow(records, "file string, rec_no long, record binary"))


class _Part:
    """A range of an open file, as a stream whose reads are short at its end only."""

    def __init__(self, file, start: int, size: int):
        file.seek(start)
        self.file, self.left = file, size

    def read(self, n: int) -> bytes:
        raw = self.file.read(min(n, self.left))
        self.left -= len(raw)
        return raw


def rdw(record: Column) -> Column:
    """The descriptor of a record: its length with these four bytes, and two zero bytes."""
    return F.unhex(F.concat(F.lpad(F.hex(F.length(record) + 4), 4, "0"), F.lit("0000")))


def with_rdw(record: Column) -> Column:
    return F.concat(rdw(record), record)


def blocks(df: DataFrame, record: str, per_block: int) -> DataFrame:
    """Rows with column block: per_block records each (within partitions), with descriptors."""
    n = df.select(with_rdw(F.col(record)).alias("r"), F.monotonically_increasing_id().alias("_i"))
    n = n.withColumn("_b", F.floor(F.col("_i") / per_block))
    joined = n.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("_i", "r"))).alias("rs"))
    body = F.aggregate("rs", F.lit(b""), lambda acc, x: F.concat(acc, x["r"]))
    return joined.select(with_rdw(body).alias("block"))


@dataclass
class _Written(WriterCommitMessage):
    file: str


class _RecordWriter(DataSourceArrowWriter):
    """A file per task in a temporary folder below the path; commit moves them into place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, folder = _filesystem(self.temporary)
        system.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{folder}/{name}") as f:
            for batch in iterator:
                records = batch.column(0).cast(pa.large_binary())
                if records.null_count:
                    raise ValueError("a record is null")
                # records lie one after another in the data buffer already
                _, offsets, data = records.buffers()
                ends = memoryview(offsets).cast("q")[records.offset : records.offset + len(records) + 1]
                if len(records):
                    f.write(memoryview(data)[ends[0] : ends[-1]])
        return _Written(name)

    def commit(self, messages):
        system, folder = _filesystem(self.temporary)
        _, target = _filesystem(self.path)
        if self.overwrite:
            from pyarrow import fs

            for x in system.get_file_info(fs.FileSelector(target)):
                if "/_temporary-" not in x.path:
                    (system.delete_dir if x.type == fs.FileType.Directory else system.delete_file)(x.path)
        for m in messages:
            if m is not None:
                system.move(f"{folder}/{m.file}", f"{target}/{m.file}")
        system.delete_dir(folder)

    def abort(self, messages):
        system, folder = _filesystem(self.temporary)
        system.delete_dir_contents(folder, missing_dir_ok=True)


class RecordFiles(DataSource):
    """The sink "recordfiles": rows of one binary column, one after another."""

    @classmethod
    def name(cls):
        return "recordfiles"

    def writer(self, schema, overwrite):
        return _RecordWriter(self.options["path"], overwrite)


def write_records(df: DataFrame, record: str, path: str, mode: str = "error") -> None:
    """Writes binary records one after another. mode: error (where there are files), append or overwrite."""
    from pyarrow import fs

    if mode not in ("error", "append", "overwrite"):
        raise ValueError(f"no such mode: {mode}")
    system, inner = _filesystem(path)
    there = system.get_file_info(inner)
    if mode == "error" and there.type == fs.FileType.Directory and system.get_file_info(fs.FileSelector(inner)):
        raise FileExistsError(path)
    df.sparkSession.dataSource.register(RecordFiles)
    df.select(F.col(record).cast("binary").alias("record")).write.format("recordfiles").mode("overwrite" if mode == "overwrite" else "append").save(path)
