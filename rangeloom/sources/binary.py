"""Binary record files as Python data sources: fixed 100-byte records, and length-prefixed records with an index.

Files are opened by ``pyarrow.fs``, so paths may name any store it knows; splits follow record bounds, and
batches reach Spark as Arrow.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The layout of the files.
RECORD, KEY_BYTES = 100, 10
BLOCK = 4 << 20
SCHEMA = "key binary, value binary"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _size(path: str) -> int:
    where, p = _open(path)
    info = where.get_file_info(p)
    if info.type != fs.FileType.File:
        raise ValueError(f"no file {path}")
    return info.size


def _batch(keys: pa.Array, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, values], ["key", "value"])


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


class GenSortReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"].rstrip("/"), int(options.get("partitions", 8))
        where, p = _open(self.path)
        files = [self.path]
        if where.get_file_info(p).type == fs.FileType.Directory:
            files = sorted(f"{self.path}/{f.base_name}" for f in where.get_file_info(fs.FileSelector(p)) if f.base_name.startswith("part-"))
        self.files = [(f, _size(f)) for f in files]
        for f, n in self.files:
            if n % RECORD:
                raise ValueError(f"{f}: {n} bytes are no whole number of {RECORD}-byte records")
        self.records = sum(n for _, n in self.files) // RECORD

    def partitions(self):
        out = []
        for f, size in self.files:
            n = size // RECORD
            k = min(max(1, round(self.parts * n / max(1, self.records))), n)
            out += [Range(f, n * i // k, n * (i + 1) // k) for i in range(k)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no record, so no partition
            return
        path, at, end = part.value
        where, p = _open(path)
        with where.open_input_file(p) as f:
            f.seek(at * RECORD)
            while at < end:
                n = min(20_000, end - at)
                data = np.frombuffer(f.read(n * RECORD), np.uint8).reshape(n, RECORD)
                cut = lambda a: pa.Array.from_buffers(pa.binary(a.shape[1]), n, [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary())  # noqa: B023, E731
                yield _batch(cut(data[:, :KEY_BYTES]), cut(data[:, KEY_BYTES:]))
                at += n


class Written(WriterCommitMessage):
    def __init__(self, name: str, rows: int, checkpoints: int):
        self.file, self.rows, self.checkpoints = name, rows, checkpoints


def _drop_but(path: str, job: str, keep: set[str]) -> None:
    """Delete a job's files, and no other's, but for ``keep`` and their indexes."""
    where, p = _open(path)
    for f in where.get_file_info(fs.FileSelector(p, allow_not_found=True)):
        if f.base_name.startswith(f"part-{job}-") and f.base_name.removesuffix(".idx") not in keep:
            where.delete_file(f.path)


class GenSortWriter(DataSourceArrowWriter):
    """A file for each task, under a name no retry and no other job shares."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, p = _open(self.path)
        where.create_dir(p, recursive=True)
        name, rows = f"part-{self.job}-{uuid.uuid4().hex}", 0
        with where.open_output_stream(f"{p}/{name}") as f:
            for b in batches:
                for c, n in (("key", KEY_BYTES), ("value", RECORD - KEY_BYTES)):
                    if not pc.all(pc.equal(pc.binary_length(pc.fill_null(b.column(c), b"")), n)).as_py() and b.num_rows:
                        raise ValueError(f"{c} must have {n} bytes")
                f.write(b"".join(pc.binary_join_element_wise(b.column("key"), b.column("value"), b"").to_pylist()))
                rows += b.num_rows
        return Written(name, rows, 0)

    def commit(self, messages):
        _drop_but(self.path, self.job, {m.file for m in messages if m})

    def abort(self, messages):
        _drop_but(self.path, self.job, set())


class GenSort(DataSource):
    """Records of a 10-byte key and 90 bytes of payload; options ``path`` (a file, or a folder of them), ``partitions``."""

    @classmethod
    def name(cls):
        return "gensort"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GenSortReader(dict(self.options))

    def writer(self, schema, overwrite):
        return GenSortWriter(dict(self.options))


def kvbin_ranges(points: list[int], size: int, parts: int) -> list[tuple[int, int]]:
    """Byte ranges from the offsets of an index: start and end of the file join them, blocks are spread evenly."""
    points = sorted({0, size, *(p for p in points if 0 <= p <= size)})
    blocks = len(points) - 1
    k = max(1, min(parts, blocks))
    return [(points[blocks * i // k], points[blocks * (i + 1) // k]) for i in range(k)] if blocks else []


class KvBinReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"].rstrip("/"), int(options.get("partitions", 8))
        self.lenient = options.get("truncated", "fail") == "ignore"
        self.index = options.get("index")

    def _files(self) -> list[str]:
        where, p = _open(self.path)
        info = where.get_file_info(p)
        if info.type == fs.FileType.File:
            return [self.path]
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no file {self.path}")
        names = sorted(f.base_name for f in where.get_file_info(fs.FileSelector(p)) if f.base_name.endswith(".kvbin"))
        return [f"{self.path}/{n}" for n in names]

    def partitions(self):
        files, out = self._files(), []
        for f in files:
            index = self.index or f"{f}.idx"
            where, p = _open(index)
            if where.get_file_info(p).type != fs.FileType.File:
                raise ValueError(f"no index {index}")
            with where.open_input_file(p) as g:
                raw = g.read()
            if len(raw) % 8:
                raise ValueError(f"{index}: no whole number of offsets")
            out += [Range(f, a, b) for a, b in kvbin_ranges(list(struct.unpack(f"<{len(raw) // 8}Q", raw)), _size(f), max(1, self.parts // len(files)))]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no record, so no partition
            return
        path, at, end = part.value
        where, p = _open(path)
        keys: list[bytes] = []
        values: list[bytes] = []
        with where.open_input_file(p) as f:
            f.seek(at)
            data, k = b"", 0

            def need(n: int) -> bool:
                nonlocal data, k, at
                while len(data) - k < n and at < end:
                    more = f.read(min(BLOCK, end - at))
                    if not more:
                        break
                    at += len(more)
                    data, k = data[k:] + more, 0
                return len(data) - k >= n

            def take(n: int) -> bytes | None:
                nonlocal k
                if not need(n):
                    return None
                k += n
                return data[k - n : k]

            while need(1):
                pair = []
                for _ in range(2):
                    head = take(4)
                    body = None if head is None else take(struct.unpack("<I", head)[0])
                    if body is None:
                        break
                    pair.append(body)
                if len(pair) < 2:
                    if self.lenient:
                        break
                    raise ValueError(f"{path}: the record at the end is cut short")
                keys.append(pair[0])
                values.append(pair[1])
                if len(keys) == 10_000:
                    yield _batch(pa.array(keys, pa.binary()), pa.array(values, pa.binary()))
                    keys, values = [], []
        if keys:
            yield _batch(pa.array(keys, pa.binary()), pa.array(values, pa.binary()))


class KvBinWriter(DataSourceArrowWriter):
    """A file and its index per task, under names no retry and no other job shares; on commit those of the job's losers go."""

    def __init__(self, options: dict):
        self.path, self.block = options["path"].rstrip("/"), int(options.get("block", BLOCK))
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, p = _open(self.path)
        where.create_dir(p, recursive=True)
        name = f"part-{self.job}-{uuid.uuid4().hex}.kvbin"
        rows, at, held, size, points = 0, 0, [], 0, []
        with where.open_output_stream(f"{p}/{name}") as f:
            for b in batches:
                for k, v in zip(b.column("key").to_pylist(), b.column("value").to_pylist(), strict=True):
                    k, v = k or b"", v or b""
                    held += (struct.pack("<I", len(k)), k, struct.pack("<I", len(v)), v)
                    size += 8 + len(k) + len(v)
                    rows += 1
                    if size >= self.block:
                        points.append(at)
                        f.write(b"".join(held))
                        at, held, size = at + size, [], 0
            if held:
                points.append(at)
                f.write(b"".join(held))
        with where.open_output_stream(f"{p}/{name}.idx") as f:
            f.write(struct.pack(f"<{len(points)}Q", *points))
        return Written(name, rows, len(points))

    def commit(self, messages):
        _drop_but(self.path, self.job, {m.file for m in messages if m})

    def abort(self, messages):
        _drop_but(self.path, self.job, set())


class KvBin(DataSource):
    """``[key length][key][value length][value]`` with little-endian 32-bit lengths, and an index of 64-bit offsets.

    Options: ``path`` (a file, or a folder of them), ``index``, ``partitions``, ``truncated`` ("ignore" ends at a record cut
    short instead of failing), ``block`` (bytes between offsets when writing).
    """

    @classmethod
    def name(cls):
        return "kvbin"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return KvBinReader(dict(self.options))

    def writer(self, schema, overwrite):
        return KvBinWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GenSort)
    spark.dataSource.register(KvBin)


def read_gensort(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    register(spark)
    _check_gensort(path)
    return spark.read.format("gensort").options(path=path, partitions=partitions).load()


def write_gensort(df: DataFrame, path: str) -> None:
    """``key, value`` of 10 and 90 bytes as a folder of record files, beside what is there already; other lengths are an error."""
    register(df.sparkSession)
    df.select("key", "value").write.format("gensort").mode("append").options(path=path).save()


def _check_gensort(path: str) -> None:
    GenSortReader({"path": path})


def read_kvbin(spark: SparkSession, path: str, partitions: int = 8, truncated: str = "fail", index: str | None = None) -> DataFrame:
    register(spark)
    options = {"path": path, "partitions": partitions, "truncated": truncated} | ({"index": index} if index else {})
    KvBinReader({k: str(v) for k, v in options.items()}).partitions()
    return spark.read.format("kvbin").options(**options).load()


def write_kvbin(df: DataFrame, path: str, block: int = BLOCK) -> None:
    """``key, value`` as a folder of files with indexes, beside what is there already; the order of rows isn't kept across files."""
    register(df.sparkSession)
    df.select("key", "value").write.format("kvbin").mode("append").options(path=path, block=block).save()


def kvbin_name(path: str, keys: list[int], values: list[int]) -> str:
    """Name of the binary copy of a text file with these columns."""
    stem = path.rstrip("/").rpartition("/")[2].rpartition(".")
    stem = stem[0] or stem[2]
    return f"datasets/{stem}.k-{'-'.join(map(str, keys))}.v-{'-'.join(map(str, values))}.kvbin"


def in_memory(spark: SparkSession, rows: list[tuple[bytes, bytes]], partitions: int | None = None) -> DataFrame:
    """Key and value pairs from the driver."""
    df = spark.createDataFrame(rows, "key binary, value binary")
    return df.repartition(partitions) if partitions else df
