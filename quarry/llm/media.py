"""Media columns: content-addressed payloads in tar shards.

A payload is a text's UTF-8 bytes, followed by zero bytes up to a positive multiple of 64. It is stored without
loss as an 8-bit greyscale PNG, 64 samples wide, whose header also carries the unpadded length in a
private chunk. Each task appends its images to tar shards in the shared folder and stores equal payloads once;
members are named by the payload's SHA-256. Rows carry digest, shard, offset and length. Metadata
columns come from a range read of the first 53 bytes of an image, features from the image itself.

Null and empty texts become 64 zero bytes. Equal texts have equal values. A task that is run again writes new
shards; rows name the shards of the run that succeeded. Other columns are ignored, rows with
null ids and repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import new_path, tasks_for, texts, written

WIDTH = 64
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 53  # signature 8, IHDR 25, length chunk 20
BLOCK = 512  # of tar
#: A shard is closed once it has this many bytes.
SHARD_BYTES = 128 << 20

ADDRESS = "doc_id long, digest string, shard string, offset long, length long"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str) -> tuple[bytes, int]:
    """The padded bytes and the unpadded length."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes, n_bytes: int) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"nbYt", struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int]:
    """Unpadded and padded length, from the first 53 bytes of an image alone."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR" or first[37:41] != b"nbYt":
        raise ValueError("not an image of this store")
    width, height = struct.unpack(">II", first[16:24])
    return struct.unpack(">Q", first[41:49])[0], width * height


def from_png(image: bytes) -> bytes:
    """The samples of an image; its chunk checksums are verified."""
    at, data, height = 8, bytearray(), 0
    while at < len(image):
        size = struct.unpack(">I", image[at : at + 4])[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            height = struct.unpack(">II", body[:8])[1]
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    return np.frombuffer(zlib.decompress(bytes(data)), np.uint8).reshape(height, WIDTH + 1)[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a plain file, always the same for the same content."""
    h = bytearray(BLOCK)
    h[0 : len(name)] = name.encode()
    h[100:108], h[108:116], h[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    h[124:136], h[136:148] = b"%011o\0" % size, b"%011o\0" % 0
    h[148:156], h[156:157] = b" " * 8, b"0"
    h[257:265] = b"ustar\x0000"
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


def features(data: bytes) -> str:
    """Lines, mean sample, entropy in bits, and a 64-bit difference hash over eight bands of columns."""
    a = np.frombuffer(data, np.uint8)
    counts = np.bincount(a, minlength=256)
    p = counts[counts > 0] / len(a)
    bands = np.array([x.mean() if len(x) else 0.0 for x in np.array_split(a, 65)])
    bits = int("".join("1" if b > c else "0" for b, c in zip(bands, bands[1:], strict=False)), 2)
    return f"lines={len(a) // WIDTH};mean={a.mean():.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};dhash={bits:016x}"


class ShardWriter:
    """Appends images to tar shards; equal payloads of the task are stored once."""

    def __init__(self, base: str):
        self.fs, self.base = pafs.FileSystem.from_uri(base)
        t = TaskContext.get()
        self.stem = f"{self.base}/shard-{t.partitionId():06d}-{t.taskAttemptId()}" if t else f"{self.base}/shard-0"
        self.fs.create_dir(self.base, recursive=True)
        self.count, self.out, self.at = 0, None, 0
        self.known: dict[bytes, tuple[str, int, int]] = {}

    def add(self, text: str) -> tuple[str, str, int, int]:
        data, n = payload(text)
        digest = hashlib.sha256(data).digest() + struct.pack("<Q", n)  # equal bytes with other padding stay apart
        found = self.known.get(digest)
        if found is None:
            if self.out is None:
                self.name, self.at = f"{self.stem}-{self.count:04d}.tar", 0
                self.out, self.count = self.fs.open_output_stream(self.name), self.count + 1
            image = to_png(data, n)
            self.out.write(tar_header(digest[:32].hex() + ".png", len(image)))
            self.out.write(image + bytes(-len(image) % BLOCK))
            found = self.known[digest] = (self.name, self.at + BLOCK, len(image))
            self.at += BLOCK + len(image) + -len(image) % BLOCK
            if self.at >= SHARD_BYTES:
                self.close()
        return digest[:32].hex(), *found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * BLOCK))
            self.out.close()
            self.out = None


def store(docs: DataFrame, base: str) -> DataFrame:
    """Writes every payload below ``base`` and returns ``(doc_id, digest, shard, offset, length)``.

    Running the result again would write again: materialise it once (``media_table`` does).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardWriter(base)
        for b in batches:
            ids = b.column(0)
            rows = [shards.add(t) for t in b.column(1).to_pylist()]
            if rows:
                d, s, o, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "digest": list(d), "shard": list(s), "offset": list(o), "length": list(n)})
        shards.close()

    return texts(docs).mapInArrow(run, ADDRESS)


def read_media(rows: DataFrame, base: str) -> DataFrame:
    """Metadata by header-only range reads, then digests and features of the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        name = source = None
        at, known = None, None
        for b in batches:
            out = []
            for doc, digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source, at = shard, fs.open_input_file(shard), None
                if offset != at:
                    n, padded = header(source.read_at(HEADER_BYTES, offset))
                    image = source.read_at(length, offset)
                    data = from_png(image)
                    sha = hashlib.sha256(data).hexdigest()
                    if sha != digest or len(data) != padded:
                        raise ValueError(f"{shard} at {offset}: not what was stored")
                    known = (n, padded, sha, zlib.crc32(data[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), features(data))
                    at = offset
                out.append((doc, *known))
            if out:
                c = list(zip(*out, strict=True))
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k in (0, 1, 2, 4, 5) else pa.string()) for k, x in enumerate(c)], names)

    n = tasks_for(rows.sparkSession)
    return rows.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(run, FEATURES)


def media_table(docs: DataFrame) -> tuple[DataFrame, str]:
    """Stores the payloads of all documents; the addresses are written once, so that no payload is stored twice."""
    base = new_path(docs.sparkSession, "media")
    rows, _ = written(store(docs, base), "media-rows")
    return rows, base


def media_features(docs: DataFrame) -> DataFrame:
    rows, base = media_table(docs)
    return read_media(rows, base)


def header_metadata(rows: DataFrame, base: str) -> DataFrame:
    """``(doc_id, digest, n_bytes, payload_bytes)``, reading 53 bytes of each image and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        for b in batches:
            got = []
            for shard, offset in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                with fs.open_input_file(shard) as f:
                    got.append(header(f.read_at(HEADER_BYTES, offset)))
            if got:
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "digest": b.column(1), "n_bytes": [g[0] for g in got], "payload_bytes": [g[1] for g in got]})

    return rows.mapInArrow(run, "doc_id long, digest string, n_bytes long, payload_bytes long")


