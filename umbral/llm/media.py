"""Content-addressed media payloads in tar shards.

A text's bytes, padded, are the samples of an 8-bit grey picture of a fixed width, stored as PNG (lossless). Every task
writes the pictures it meets, each content once, into a tar shard in the shared folder; rows carry the digest, the
shard, the offset and the length. Metadata come from range reads of the picture's header alone; payloads and features
from reading the stored bytes back.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, tidy

WIDTH = 192
#: Bytes of a PNG up to the end of its header chunk.
HEADER = 33
#: Stored bytes that a reading task gets.
READ = 8 << 20
ROWS = "id {id}, digest string, n_bytes long, shard string, offset long, length long"
META = "width int, height int, bit_depth int"


def pad(data: bytes) -> bytes:
    """data and bytes 32, up to a positive multiple of the width."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b" ")


def encode(payload: bytes) -> bytes:
    """An 8-bit grey PNG with the payload as samples, row by row, without filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 5)) + chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if first[:8] != b"\x89PNG\r\n\x1a\n" or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not a picture of this store")
    return struct.unpack(">IIB", first[16:25])


def decode(media: bytes) -> bytes:
    """The samples of a picture that encode made."""
    width, height, _ = header(media[:HEADER])
    at, body = HEADER, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("the stored picture is damaged")
        if kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the sums of four bands of rows."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    share = n[n > 0] / len(x)
    bands = [int(b.sum(dtype=np.int64)) for b in np.array_split(x, 4)]
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};bands=" + ",".join(map(str, bands))


def _open(folder: str):
    return fs.FileSystem.from_uri(folder)


def _named(spark: SparkSession, folder: str) -> str:
    """folder with the scheme that Spark gives it: executors write where rows are written. Raises if pyarrow can't open it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    full = f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full
    try:
        _open(full)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"media can't be stored under {full}: {e}") from e
    return full


def _spread(rows: DataFrame) -> DataFrame:
    """rows in runs of their stored bytes, READ each; many rows of one content are split by their ids."""
    total = rows.agg(F.sum("length")).first()[0] or 0
    return rows.repartitionByRange(max(1, -(-int(total) // READ)), "shard", "offset", "id")


def _store(folder: str):
    def run(batches):
        where, path = _open(folder)
        where.create_dir(path, recursive=True)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
        held: dict[bytes, tuple[int, int]] = {}
        out = None
        try:
            for b in batches:
                rows = {"digest": [], "n_bytes": [], "shard": [], "offset": [], "length": []}
                for text in b.column(1).to_pylist():
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    payload = pad(raw)
                    digest = hashlib.sha256(payload)
                    key = digest.digest()
                    if key not in held:
                        if out is None:
                            out = where.open_output_stream(f"{path}/{name}.part")
                        media = encode(payload)
                        info = tarfile.TarInfo(f"{digest.hexdigest()}.png")
                        info.size = len(media)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT))
                        held[key] = out.tell(), len(media)
                        out.write(media)
                        out.write(bytes(-len(media) % 512))
                    for n, x in zip(rows, (digest.hexdigest(), len(raw), name, *held[key]), strict=True):
                        rows[n].append(x)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(rows[n], pa.string() if n in ("digest", "shard") else pa.int64()) for n in rows]], names=["id", *rows])
            if out is not None:
                out.write(bytes(1024))
        finally:
            if out is not None:
                out.close()
        if out is not None:  # readers only see whole shards; one of a lost attempt is named by no row
            where.move(f"{path}/{name}.part", f"{path}/{name}")

    return run


def store_media(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes every text (null: empty) as a picture into tar shards; returns (rows, folder).

    rows: id, digest (SHA-256 of the padded payload, the content's address), n_bytes (unpadded), shard, offset, length.
    Equal contents share a digest and, within a task's shard, one copy. Rows may repeat ids or have none; other columns
    are ignored; an empty table writes no shard. The rows are written before they are returned, so a shard is never
    written twice for one row; a task that is run again writes a new shard and its rows name only that.
    """
    spark = docs.sparkSession
    folder = _named(spark, folder or scratch(spark, "media"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(_store(f"{folder}/tar")), ROWS.format(id=kind))
    rows.write.parquet(f"{folder}/rows")
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows"), folder


def _read(folder: str, whole: bool):
    def run(batches):
        where, path = _open(f"{folder}/tar")
        files: dict = {}
        try:
            for b in batches:
                names, offsets, lengths = (b.column(i).to_pylist() for i in (3, 4, 5))
                skip = 3 if "width" in b.schema.names else 0  # columns that media_metadata has filled
                cols: list[list] = [[] for _ in range(9 if whole else 3)]
                last = None
                for i in sorted(range(b.num_rows), key=lambda i: (names[i], offsets[i])):
                    at = names[i], offsets[i]
                    if last is None or last[0] != at:
                        if names[i] not in files:
                            for f in files.values():
                                f.close()
                            files = {names[i]: where.open_input_file(f"{path}/{names[i]}")}
                        f = files[names[i]]
                        f.seek(offsets[i])
                        media = f.read(lengths[i] if whole else HEADER)
                        values = header(media[:HEADER])
                        if whole:
                            payload = decode(media)
                            values = (*values, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
                        last = at, values
                    for c, v in zip(cols, (*last[1],), strict=True):
                        c.append((i, v))
                kinds = [pa.int32()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [pa.array([v for _, v in sorted(c, key=lambda x: x[0])], t) for c, t in zip(cols, kinds, strict=False)]
                made = ["width", "height", "bit_depth", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"][: len(arrays)]
                yield pa.RecordBatch.from_arrays([*b.columns, *arrays[skip:]], names=[*b.schema.names, *made[skip:]])
        finally:
            for f in files.values():
                f.close()

    return run


def media_metadata(rows: DataFrame, folder: str) -> DataFrame:
    """rows with width, height and bit_depth, from reads of HEADER bytes each. A row with a null shard raises, as rows of another store do."""
    schema = ROWS.format(id=rows.schema["id"].dataType.simpleString())
    return _spread(rows).mapInArrow(tidy(_read(folder, False)), f"{schema}, {META}")


def media_features(rows: DataFrame, folder: str) -> DataFrame:
    """rows with metadata (kept where media_metadata has filled them) and what the stored bytes say: payload_bytes, payload_sha256, tail_crc32 (of the last 16), media_bytes, media_sha256, feature. Damaged bytes raise."""
    schema = f"{ROWS.format(id=rows.schema['id'].dataType.simpleString())}, {META}"
    rows = rows if "width" in rows.columns else _spread(rows)
    return rows.mapInArrow(tidy(_read(folder, True)), f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def open_shard(folder: str, shard: str) -> tarfile.TarFile:
    """A shard as an ordinary tar file."""
    where, path = _open(f"{folder}/tar")
    with where.open_input_stream(f"{path}/{shard}") as f:
        return tarfile.open(fileobj=io.BytesIO(f.read()))
