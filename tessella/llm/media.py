"""Operator 2: media columns in archive directories, read and written by a custom Spark data source.

Writing (format "tessella_media"): each task streams its rows into a tar archive of its own, one member a row, with an
index beside it (Arrow IPC: offset, size, crc32 and key of each member, a record batch for each 16 MB of the archive). Commit
publishes a manifest of its own naming the archives of the tasks that won; archives of lost attempts are never in one,
and abort removes those it knows of. So writing into a folder that exists adds to it; with mode "overwrite" the earlier
manifests and their archives go once the new manifest is there.

Reading: the driver plans byte ranges over the archives of all manifests from their sizes and their index batches' first
offsets (``range_bytes``); a task opens the range's archive, reads the index batches that it needs and no others, takes the
members that begin in the range, streams them through one buffered read, checks each one's crc32, and
reads a member that fails again by its own offset, up to ``retries`` times, without giving up the rest of the range. Batches
go to Spark as Arrow and are closed at ``batch_bytes``. A member that stays unreadable is a row with ``error`` and no
media.

The store is reached through pyarrow.fs by the archive folder's URI, so it can be any shared store that pyarrow knows.

The payload of a text: its UTF-8, filled with bytes 0 up to a positive multiple of 64, as the rows of a greyscale PNG that
is 64 samples of 8 bits wide. Defined results: null and empty texts have a payload of 64 bytes 0; null doc_ids stay null;
equal rows are members of their own; an empty table gives an archive folder without members; other columns are ignored; a
member that can't be read is a row with its key and ``error`` (null for all others), and null in the other columns.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import time
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBERS = "doc_id long, media binary"
READ = "doc_id long, media binary, error string"


def payload(text: bytes) -> bytes:
    return text.ljust(max(-(-len(text) // WIDTH), 1) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(samples: bytes, length: int, level: int = 1) -> bytes:
    """samples as a greyscale PNG, 64 wide, no row filter; a text chunk has the length without filling."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % length) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> tuple[bytes, int]:
    """The samples of an image made by png(), and the length without filling."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, height, length = 8, [], 0, 0
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            height = struct.unpack_from(">II", data)[1]
        elif kind == b"tEXt" and data.startswith(b"Length\0"):
            length = int(data[7:])
        elif kind == b"IDAT":
            packed.append(data)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter is in use")
    return rows[:, 1:].tobytes(), length


def feature(data: bytes) -> str:
    """64-bit average hash over an 8 x 8 grid of the image, mean, deviation and entropy of the samples."""
    a = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    rows = a if len(a) >= 8 else np.repeat(a, -(-8 // len(a)), 0)
    edges = np.linspace(0, len(rows), 9).astype(int)
    cells = np.add.reduceat(rows, edges[:-1], 0, np.int64) / np.diff(edges)[:, None]
    grid = cells.reshape(8, 8, 8).mean(2)
    bits = int("".join("1" if x else "0" for x in (grid > grid.mean()).ravel()), 2)
    counts = np.bincount(a.ravel(), minlength=256)
    p = counts[counts > 0] / a.size
    values = np.arange(256)
    mean = float((counts * values).sum() / a.size)
    deviation = float(np.sqrt(max((counts * values**2).sum() / a.size - mean**2, 0)))
    return f"{bits:016x}:{mean:.3f}:{deviation:.3f}:{float(-(p * np.log2(p)).sum()):.4f}"


@dataclass
class _Range(InputPartition):
    archive: str
    index: str
    start: int
    stop: int
    first: int
    last: int


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


_INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("crc", pa.int64())])
_INDEX_BYTES = 16 << 20


def _manifests(store: fs.FileSystem, root: str) -> dict[str, list[dict]]:
    """The archives of each manifest, by the manifest's path."""
    out = {}
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith("_manifest-"):
            with store.open_input_stream(info.path) as f:
                out[info.path] = json.loads(f.read())
    return out


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool, index_bytes: int = _INDEX_BYTES):
        self.uri, self.overwrite, self.index_bytes = uri, overwrite, index_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _store(self.uri)
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        rows: list[tuple] = []
        starts: list[int] = []
        at = n = begun = 0
        with store.open_output_stream(f"{root}/{name}.tar") as out, store.open_output_stream(f"{root}/{name}.idx") as idx, pa.ipc.new_file(idx, _INDEX) as index:

            def close() -> None:
                starts.append(rows[0][1])
                index.write_batch(pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=_INDEX))

            for batch in iterator:
                for key, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                    info = tarfile.TarInfo(f"{'none' if key is None else key}-{n}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head)
                    out.write(media)
                    out.write(b"\0" * (-len(media) % 512))
                    rows.append((key, at + len(head), len(media), zlib.crc32(media)))
                    n += 1
                    at += len(head) + len(media) + -len(media) % 512
                    if at - begun >= self.index_bytes:
                        close()
                        rows, begun = [], at
            if rows:
                close()
            out.write(b"\0" * 1024)
        return _Written([{"archive": f"{name}.tar", "index": f"{name}.idx", "bytes": at, "starts": starts}])

    def commit(self, messages: list) -> None:
        store, root = _store(self.uri)
        store.create_dir(root, recursive=True)
        earlier = _manifests(store, root) if self.overwrite else {}
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["archive"])
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{root}/_part-{name}") as out:
            out.write(json.dumps(files).encode())
        store.move(f"{root}/_part-{name}", f"{root}/_manifest-{name}")
        for path in earlier:
            store.delete_file(path)
        self._remove(store, root, [f for files in earlier.values() for f in files])

    def abort(self, messages: list) -> None:
        store, root = _store(self.uri)
        self._remove(store, root, [f for m in messages if m for f in m.files])

    def _remove(self, store: fs.FileSystem, root: str, files: list[dict]) -> None:
        for f in files:
            for name in (f["archive"], f["index"]):
                store.delete_file(f"{root}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[_Range]:
        store, root = _store(self.uri)
        manifests = _manifests(store, root)
        if not manifests:
            raise FileNotFoundError(f"no media archive at {self.uri}")
        out = []
        for f in (f for files in manifests.values() for f in files):
            starts = f["starts"]
            for at in range(0, f["bytes"], self.range_bytes):
                stop = min(at + self.range_bytes, f["bytes"])
                out.append(_Range(f["archive"], f["index"], at, stop, max(bisect_right(starts, at) - 1, 0), bisect_left(starts, stop)))
        return out or [_Range("", "", 0, 0, 0, 0)]

    def member(self, store: fs.FileSystem, path: str, offset: int, size: int, crc: int) -> tuple[bytes | None, str | None]:
        """One member by its offset, tried again on its own."""
        error = None
        for attempt in range(self.retries):
            try:
                with store.open_input_file(path) as f:
                    data = f.read_at(size, offset)
                if len(data) == size and zlib.crc32(data) == crc:
                    return data, None
                error = f"offset {offset}: {len(data)} of {size} bytes, or a wrong checksum"
            except OSError as e:
                error = f"offset {offset}: {e}"
            time.sleep(0.05 * 2**attempt)
        return None, error

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, root = _store(self.uri)
        with store.open_input_file(f"{root}/{partition.index}") as f:
            batches = pa.ipc.open_file(f)
            index = pa.Table.from_batches([batches.get_batch(i) for i in range(partition.first, partition.last)], _INDEX)
        offset = index.column("offset").to_numpy()
        mine = index.take(pa.array(np.flatnonzero((offset >= partition.start) & (offset < partition.stop))))
        path = f"{root}/{partition.archive}"
        rows, held = [], 0
        stream, at = None, 0
        for key, begin, size, crc in zip(*(mine.column(c).to_pylist() for c in ("doc_id", "offset", "size", "crc"))):
            data = error = None
            try:
                if stream is None:
                    stream = store.open_input_file(path)
                    stream.seek(begin)
                    at = begin
                block = stream.read(begin - at + size)
                data, at = block[begin - at :], begin + size
            except OSError:
                stream = None  # the next member opens the archive again
            if data is None or len(data) != size or zlib.crc32(data) != crc:
                stream = None
                data, error = self.member(store, path, begin, size, crc)
            rows.append((key, data, error))
            held += size
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string()))], names=["doc_id", "media", "error"])


class MediaArchive(DataSource):
    """spark.read / df.write with format "tessella_media"; options path, range_bytes, batch_bytes, retries, and to write index_bytes."""

    @classmethod
    def name(cls) -> str:
        return "tessella_media"

    def schema(self) -> str:
        return READ

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema: object, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite, int(self.options.get("index_bytes", _INDEX_BYTES)))


def _store_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, media, held = [], [], 0
        for key, text in zip(batch.column("doc_id").to_pylist(), common.utf8(batch.column("text"))):
            keys.append(key)
            media.append(png(payload(text), len(text)))
            held += len(media[-1])
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])
                keys, media, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = [f.split()[0] for f in FEATURES.split(", ")]
    for batch in batches:
        rows = []
        for key, media, error in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "media", "error"))):
            if media is None:
                rows.append((key, None, None, None, None, None, None, None, error))
                continue
            data, length = samples(media)
            rows.append((key, length, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(data), None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def write_media(docs: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    """Store the texts of docs(doc_id, text) as images in an archive folder at path (a URI)."""
    docs.sparkSession.dataSource.register(MediaArchive)
    members = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store_texts, MEMBERS)
    members.write.format(MediaArchive.name()).mode(mode).options(**options).save(path)


def read_media(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format(MediaArchive.name()).options(**options).load(path)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark) + "/media"
    write_media(common.documents(spark, sf_dir), path)
    return read_media(spark, path).mapInArrow(_features, FEATURES)
