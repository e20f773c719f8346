"""Token ids as fixed-width bit-packed files (operator 8).

File: ``MAGIC``, u32 bits per id, u32 ids per block; the blocks, each padded
to whole bytes; doc ids (i64), a null mask (u8) and first tokens (u64, one
more than documents) of the file; byte offsets of the blocks (u64, one more
than blocks); u64 documents, u64 ids, u64 blocks, ``MAGIC``.  Ids are stored
least significant bit first, so numpy unpacks a block in one step and id ``t``
lies in block ``t // block`` (random access by one ranged read).

Rows in, defined results: a null text is empty (only the end id); a null
doc_id sorts first; repeated rows are documents of their own; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.llm.scratch import file_system, shared_folder, stored
from cohorta.llm.tokenizer import encoder
from cohorta.llm.tokens import ragged, slices, text_column

MAGIC = b"CBITPK01"
HEAD = struct.Struct("<8sII")
FOOT = struct.Struct("<QQQ8s")
BLOCK = 4096
FILE_IDS = 32 << 20
SLICE = 8 << 20


def bits_for(vocab_size: int) -> int:
    """Least number of bits that holds every id below ``vocab_size``."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    grid = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(grid[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The ``count`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    raw = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    grid = np.zeros((count, 32), np.uint8)
    grid[:, :bits] = raw.reshape(count, bits)
    return np.packbits(grid, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


class Writer:
    """Appends documents to one file; whole blocks leave memory at once."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK) -> None:
        fs, path = file_system(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.uri, self.bits, self.block = uri, bits, block
        self.out.write(HEAD.pack(MAGIC, bits, block))
        self.rest = np.zeros(0, np.uint32)
        self.at = [HEAD.size]
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.n_ids = 0

    def append(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.nulls.append(nulls)
        self.firsts.append(offsets[:-1] + self.n_ids)
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        for k in range(0, whole, self.block):
            self._put(ids[k:k + self.block])
        self.rest = ids[whole:].copy()

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at.append(self.at[-1] + len(data))

    def close(self) -> tuple[str, int, int]:
        if len(self.rest):
            self._put(self.rest)
        docs = np.concatenate(self.docs)
        self.out.write(docs.astype("<i8").tobytes())
        self.out.write(np.concatenate(self.nulls).astype(np.uint8).tobytes())
        self.out.write(np.append(np.concatenate(self.firsts), self.n_ids).astype("<u8").tobytes())
        self.out.write(np.asarray(self.at, "<u8").tobytes())
        self.out.write(FOOT.pack(len(docs), self.n_ids, len(self.at) - 1, MAGIC))
        self.out.close()
        return self.uri, len(docs), self.n_ids


class Reader:
    """Random access to one file: ``docs``, ``nulls``, ``firsts`` and ``ids(a, b)``."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        n_docs, self.n_ids, n_blocks, end = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{uri} is not a whole bit-packed file")
        width = 8 * n_docs + n_docs + 8 * (n_docs + 1) + 8 * (n_blocks + 1)
        tail = self.file.read_at(width, size - FOOT.size - width)
        self.docs = np.frombuffer(tail, "<i8", n_docs)
        self.nulls = np.frombuffer(tail, np.uint8, n_docs, 8 * n_docs).astype(bool)
        self.firsts = np.frombuffer(tail, "<u8", n_docs + 1, 9 * n_docs).astype(np.int64)
        self.at = np.frombuffer(tail, "<u8", n_blocks + 1, 9 * n_docs + 8 * (n_docs + 1)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file by one ranged read of their blocks."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        data = self.file.read_at(int(self.at[b] - self.at[a]), int(self.at[a]))
        out = []
        for k in range(a, b):
            count = min(self.block, self.n_ids - k * self.block)
            out.append(unpack(data[self.at[k] - self.at[a]:self.at[k + 1] - self.at[a]], count, self.bits))
        return np.concatenate(out)[start - a * self.block:stop - a * self.block]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with ``end_id`` after them."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    sizes = np.diff(offsets)
    out[ragged(offsets[:-1] + np.arange(n), sizes)] = ids
    return out, offsets + np.arange(n + 1)


def write_files(docs: DataFrame, vocab_path: str, bits: int, end_id: int = 0,
                file_ids: int = FILE_IDS, folder: str | None = None) -> DataFrame:
    """Encode and write ``docs`` in ascending doc_id order; one manifest row per file.

    Rows are dealt out by doc_id ranges; ties are spread by text and a salt,
    so a repeated doc_id is not bound to one task.  Each attempt writes files
    of its own and only those in the stored manifest count.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "bitpack")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("_h", F.xxhash64("text"))
            .withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(1024))))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_s")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = encoder(vocab_path)
        made: list[tuple] = []
        out = None
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                ids, off = with_end(*enc.encode(text_column(piece)), end_id)
                ident = piece.column("doc_id")
                if out is None:
                    out = Writer(f"{folder}/{part:07d}-{len(made):05d}-{uuid.uuid4().hex}.bits", bits)
                out.append(ident.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                           ident.is_null().to_numpy(zero_copy_only=False), ids, off)
                if out.n_ids >= file_ids:
                    made.append((part, len(made), *out.close()))
                    out = None
        if out is not None:
            made.append((part, len(made), *out.close()))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)],
                                             ["part", "file", "path", "n_docs", "n_ids"])

    manifest = stored(ranged.mapInArrow(write, "part long, file long, path string, n_docs long, n_ids long")
                      .select("part", "file", "path", "n_docs", "n_ids"), "bitpack-manifest")
    # one row per file of some 32 million ids: a small table even for 100 TB
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, read_ids: int = 2 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                f = Reader(path)
                k, n = 0, len(f.docs)
                while k < n:
                    stop = max(k + 1, int(np.searchsorted(f.firsts, f.firsts[k] + read_ids, side="right")) - 1)
                    stop = min(stop, n)
                    base = int(f.firsts[k])
                    data = f.ids(base, int(f.firsts[stop])).astype("<u4").tobytes()
                    at = ((f.firsts[k:stop + 1] - base) * 4).tolist()
                    crc = [zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.docs[k:stop], mask=f.nulls[k:stop]), pa.array(f.firsts[k:stop] + first),
                         pa.array(np.diff(f.firsts[k:stop + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])
                    k = stop

    spread = manifest.select("path", "first").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def bit_packed(docs: DataFrame, vocab_path: str, vocab_size: int, end_id: int = 0) -> DataFrame:
    """Write the corpus as bit-packed files, then report each document as read back."""
    return read_documents(write_files(docs, vocab_path, bits_for(vocab_size), end_id))
