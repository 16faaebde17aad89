"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A record is: payload length (8 bytes, little-endian), masked CRC-32C of those bytes (4), payload,
masked CRC-32C of the payload (4), where a mask is the checksum rotated right by 15 bits plus
0xA282EAD8: the framing that common training readers take. The payload is doc_id (8 bytes, signed), a
flag byte (1: doc_id is null), the bytes of one id (2 or 4), and the ids. Beside each record file
stands an index of 8-byte offsets, one a record and one at the end, so that a shuffled reader can seek.

Scale: texts are range-partitioned by doc_id (and a hash of the text, so a repeated doc_id can be
split), sorted and encoded partition by partition; part k of the files holds range k. A task writes under
a name of its own and renames at its end; as its contents are fixed by the data, a repeated attempt
leaves the same files. Files go to the shared folder through pyarrow.fs, by the folder's own scheme.
Only one narrow row a file is summed up; the reader walks each file by its index and checks every sum.

Edge cases: null text counts as empty (the end id alone); null doc_id comes first; rows that repeat a
doc_id are records of their own, in order of text hash; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, gathered, tokenizer_path
from .common import materialize, new_path

_POLY = 0x82F63B78


def _tables():
    t = np.arange(65536, dtype=np.uint32)
    for _ in range(16):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t


_T16 = _tables()


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2), bits reflected, modulo the checksum's polynomial."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    b = np.broadcast_to(b, out.shape).astype(np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & 1, (b >> 1) ^ np.uint32(_POLY), b >> 1)
    return out


def _power(n: np.ndarray) -> np.ndarray:
    """x to the 8n: what n more bytes do to a checksum."""
    out, square, n = np.full(len(n), 0x80000000, np.uint32), np.array([0x00800000], np.uint32), n.copy()
    while n.any():
        out = np.where(n & 1, _times(square, out), out)
        square, n = _times(square, square), n >> 1
    return out


_STEP = 256
_WEIGHTS = {"w": np.array([0x80000000], np.uint32)}


def _weights(n: int) -> np.ndarray:
    w = _WEIGHTS["w"]
    while len(w) < n:
        w = np.concatenate([w, _times(_power(np.array([_STEP * len(w)])), w)])
    _WEIGHTS["w"] = w
    return w


def crc32c(rows: list) -> np.ndarray:
    """CRC-32C of each row (bytes)."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    blocks = -(-size // _STEP)
    total, ends = int(blocks.sum()), np.cumsum(blocks)
    padded = np.zeros(total * _STEP, np.uint8)  # zeros in front leave a sum that starts at 0 as it is
    for row, n, end in zip(rows, size.tolist(), (ends * _STEP).tolist()):
        padded[end - n : end] = np.frombuffer(row, np.uint8)
    words = np.ascontiguousarray(padded.view("<u2").reshape(total, _STEP // 2).T)
    s = np.zeros(total, np.uint32)
    for w in words:
        s = _T16[(s ^ w) & 0xFFFF] ^ (s >> 16)
    later = np.repeat(ends, blocks) - 1 - np.arange(total)
    s = _times(_weights(int(blocks.max(initial=1)))[later], s) if total else s
    raw = np.zeros(len(size), np.uint32)
    some = blocks > 0
    if some.any():
        raw[some] = np.bitwise_xor.reduceat(s, (ends - blocks)[some])
    return raw ^ _times(_power(size), np.full(len(size), 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(0xA282EAD8)


def _sums(rows: list) -> list[bytes]:
    return [x.tobytes() for x in masked(crc32c(rows)).astype("<u4")]


def frame(payloads: list) -> list[bytes]:
    """The records of the payloads."""
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    return [b"".join(x) for x in zip(lengths, _sums(lengths), payloads, _sums(payloads))]


def unframe(data: bytes, at: list[int]) -> list[memoryview]:
    """Payloads of the records between the offsets; raises if a length or a checksum is wrong."""
    view = memoryview(data)
    heads, sums = [view[a : a + 8] for a in at[:-1]], [bytes(view[a + 8 : a + 12]) for a in at[:-1]]
    if [int.from_bytes(h, "little") for h in heads] != [b - a - 16 for a, b in zip(at[:-1], at[1:])] or sums != _sums(heads):
        raise ValueError("a record's length is damaged")
    payloads = [view[a + 12 : b - 4] for a, b in zip(at[:-1], at[1:])]
    if [bytes(view[b - 4 : b]) for b in at[1:]] != _sums(payloads):
        raise ValueError("a record's payload is damaged")
    return payloads


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str, path: str, end: int):
    def run(batches):
        enc, (store, top) = encoder(path), _fs(folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        part, name = task.partitionId(), f"{top}/part-{task.partitionId():06d}"
        own = f"{name}.{task.taskAttemptId()}"
        index, at, ids_n = [np.zeros(1, np.int64)], 0, 0
        with store.open_output_stream(f"{own}.rec") as out:
            for b in gathered(batches, 1):
                ids, offsets = enc.encode(b.column(1), end)
                raw, marks = ids.astype(ids.dtype.newbyteorder("<")).tobytes(), (offsets * ids.itemsize).tolist()
                payloads = [(k or 0).to_bytes(8, "little", signed=True) + bytes((k is None, ids.itemsize)) + raw[x:y] for k, x, y in zip(b.column(0).to_pylist(), marks[:-1], marks[1:])]
                records = frame(payloads)
                out.write(b"".join(records))
                index.append(at + np.cumsum([len(r) for r in records]))
                at, ids_n = int(index[-1][-1]), ids_n + len(ids)
        index = np.concatenate(index)
        with store.open_output_stream(f"{own}.idx") as out:
            out.write(index.astype("<u8"))
        for kind in ("rec", "idx"):
            store.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(index) - 1], "ids": [ids_n], "bytes": [at]}, schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    return run


def read_part(folder: str, part: int, most: int = 16 << 20):
    """Yield (doc_ids, list of id arrays) of a file, about `most` bytes at a time."""
    store, top = _fs(folder)
    with store.open_input_stream(f"{top}/part-{part:06d}.idx") as f:
        index = np.frombuffer(f.read(), "<u8").astype(np.int64)
    with store.open_input_file(f"{top}/part-{part:06d}.rec") as f:
        i = 0
        while i < len(index) - 1:
            j = max(i + 1, int(np.searchsorted(index, index[i] + most, "right")) - 1)
            payloads = unframe(f.read_at(int(index[j] - index[i]), int(index[i])), (index[i : j + 1] - index[i]).tolist())
            keys = [None if p[8] else int.from_bytes(p[:8], "little", signed=True) for p in payloads]
            yield keys, [np.frombuffer(p[10:], f"<u{p[9]}") for p in payloads]
            i = j


def _reader(folder: str):
    def run(batches):
        for b in batches:
            for part, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for keys, ids in read_part(folder, part):
                    n = np.fromiter(map(len, ids), np.int64, len(ids))
                    crc = [zlib.crc32(x.astype("<u4")) for x in ids]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    before += int(n.sum())

    return run


def write_records(docs: DataFrame, folder: str | None = None, end: int = 2, path: str | None = None, docs_a_file: int = 8192) -> tuple[str, DataFrame]:
    """Write docs in ascending doc_id order; returns the folder and one row a file (part, docs, ids, bytes)."""
    folder = folder or new_path(docs.sparkSession, "records")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    parts = max(1, math.ceil(docs.count() / docs_a_file))
    texts = texts.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h").select("doc_id", "text")
    return folder, materialize(texts.mapInArrow(_writer(folder, path or tokenizer_path(), end), "part int, docs long, ids long, bytes long"), "records-manifest")


def read_records(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.select("part", before.cast("long").alias("before"), "docs").where("docs > 0").select("part", "before")
    n = max(1, manifest.count())
    return parts.repartition(n, "part").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    return read_records(*write_records(spark.read.parquet(f"{sf_dir}/documents.parquet")))
