"""Token-id output: one wavelet matrix per shard of documents.

Ids of documents in ascending doc_id order, each ended by ``end_id``, are cut into shards of whole documents of
about ``shard_tokens`` ids. A shard's file holds its ids as succinct bit-planes with a rank directory, which
answer access, counting and occurrence lookup without decoding the rest, and its documents' ids and lengths.
Spark writes one row per file into a compressed Parquet table in the shared folder, so files are whole or absent
and lost executors are no matter. Offsets over all shards come from sums by partition and then by shard.

Defined cases: null and empty texts hold the end id alone; a null id is the least (in
files it stands as -2^63, which is therefore no id); repeated rows stand side by side; an empty table gives no files. A
shard is one row of binary, so one document of n ids makes a row of about 2.4 n bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrifold.llm.common import small_batches, written
from metrifold.llm.library import ByteLevel
from metrifold.llm.pieces import hold

MAGIC = b"WMX1"
NO_ID = -(2**63)  # stands for null in files
_BLOCK = 512


class WaveletMatrix:
    """Ids as bit-planes from the highest bit down; each plane's zeros come first on the next plane."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ranks = ranks or [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of 512 bits."""
        ones = np.bitwise_count(plane.view("<u8")).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return np.concatenate(([0], np.cumsum(ones))).astype("<u4")

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << b)).astype(bool)
            plane = np.zeros(-(-max(1, len(now)) // _BLOCK) * (_BLOCK // 8), np.uint8)
            packed = np.packbits(one, bitorder="little")
            plane[: len(packed)] = packed
            planes.append(plane)
            low = now[np.flatnonzero(~one)]  # faster than a mask
            zeros.append(len(low))
            now = np.concatenate((low, now[np.flatnonzero(one)]))
        return cls(len(ids), planes, zeros)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            one = self._bits(level)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~one)] = now[: self.zeros[level]]
            up[np.flatnonzero(one)] = now[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            now = up
        return now

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // _BLOCK
        part = self.planes[level][block * (_BLOCK // 8) : block * (_BLOCK // 8) + -(-(i % _BLOCK) // 8)]
        return int(self.ranks[level][block]) + int(np.unpackbits(part, count=i % _BLOCK, bitorder="little").sum())

    def access(self, i: int) -> int:
        out = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def rank(self, symbol: int, i: int) -> int:
        """How often ``symbol`` stands among the first ``i`` ids."""
        lo, hi, bits = 0, i, len(self.planes)
        if symbol >> bits:
            return 0
        for level in range(bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _place(self, level: int, bit: int, k: int) -> int:
        """Where a plane's ``k``-th (from 0) bit of that value stands: the block by the rank directory, then within it."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * _BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * (_BLOCK // 8) : (block + 1) * (_BLOCK // 8)], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def select(self, symbol: int, k: int) -> int:
        """The position of the ``k``-th (from 0) occurrence, -1 if there is none: down to the symbol's run, and up by select on each plane."""
        if k < 0 or k >= self.count(symbol):
            return -1
        at, bits = 0, len(self.planes)
        for level in range(bits):
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if symbol >> (bits - 1 - level) & 1 else at - ones
        at += k
        for level in range(bits - 1, -1, -1):
            bit = symbol >> (bits - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def to_bytes(self) -> bytes:
        head = struct.pack("<QI", self.n, len(self.planes))
        return head + b"".join(struct.pack("<Q", z) + r.tobytes() + p.tobytes() for z, r, p in zip(self.zeros, self.ranks, self.planes, strict=True))

    @classmethod
    def from_bytes(cls, data: memoryview) -> WaveletMatrix:
        n, bits = struct.unpack_from("<QI", data)
        blocks, at = -(-max(1, n) // _BLOCK), 12
        planes, zeros, ranks = [], [], []
        for _ in range(bits):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            ranks.append(np.frombuffer(data, "<u4", blocks + 1, at + 8))
            at += 8 + 4 * (blocks + 1)
            planes.append(np.frombuffer(data, np.uint8, blocks * (_BLOCK // 8), at))
            at += blocks * (_BLOCK // 8)
        return cls(n, planes, zeros, ranks)


def pack_shard(doc_ids: list[int], sizes: list[int], ids: np.ndarray) -> bytes:
    return b"".join((MAGIC, struct.pack("<Q", len(doc_ids)), np.array(doc_ids, "<i8").tobytes(), np.array(sizes, "<u8").tobytes(), WaveletMatrix.build(ids).to_bytes()))


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc ids, sizes, wavelet matrix)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    n = struct.unpack_from("<Q", data, 4)[0]
    return np.frombuffer(data, "<i8", n, 12), np.frombuffer(data, "<u8", n, 12 + 8 * n), WaveletMatrix.from_bytes(memoryview(data)[12 + 16 * n :])


def _library(path: str) -> ByteLevel:
    """The tokenizers library with a worker's cache; ids as little-endian bytes of the narrowest kind."""
    return hold(("ids", path), lambda: ByteLevel(path, counts=False))


def write_shards(docs: DataFrame, path: str, end_id: int, shard_tokens: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of shard files (part, shard, first_doc, n_docs, n_tokens, file), written and reread; parts and shards ascend with doc_id."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, part, shard = _library(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], lib.kind).tobytes()
        docs_now: list[int] = []
        sizes: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal total, shard
            ids = np.frombuffer(b"".join(held), lib.kind)
            row = {"part": [part], "shard": [shard], "first_doc": [docs_now[0]], "n_docs": [len(docs_now)], "n_tokens": [total], "file": [pack_shard(docs_now, sizes, ids)]}
            docs_now.clear(), sizes.clear(), held.clear()
            total, shard = 0, shard + 1
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc, got in zip(batch.column("doc_id").to_pylist(), lib.values(texts), strict=True):
                docs_now.append(doc)
                held += [got, end]
                sizes.append(len(got) // lib.kind.itemsize + 1)
                total += sizes[-1]
                if total >= shard_tokens:
                    yield flush()
        if docs_now:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    # Ids would be no smaller to move than texts, and ranging encoded rows would encode them twice (once for the sample).
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "part int, shard long, first_doc long, n_docs long, n_tokens long, file binary"), "token-shards")


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shard files alone."""
    small_batches(files.sparkSession)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))  # one row for each partition of the write
    starts = files.select("part", "shard", "n_tokens").join(F.broadcast(before), "part")
    starts = starts.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens") + F.col("part_start")).alias("shard_start"))
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "file")), strict=True):
                docs, sizes, matrix = unpack_shard(data)
                ids = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(sizes).astype(np.int64)
                begins = ends - sizes.astype(np.int64)
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_pydict({"part": [part] * n, "shard": [shard] * n, "doc_id": docs, "inside": begins, "n_tokens": sizes.astype(np.int64), "ids_crc32": crcs}, schema=schema)

    rows = files.select("part", "shard", "file").mapInArrow(run, "part int, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def positions(files: DataFrame, symbol: int) -> DataFrame:
    """(part, shard, at): the places of a token in each shard, by select on the files; one row for each occurrence."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "file")), strict=True):
                matrix = unpack_shard(data)[2]
                found = [matrix.select(symbol, k) for k in range(matrix.count(symbol))]
                yield pa.RecordBatch.from_pydict({"part": [part] * len(found), "shard": [shard] * len(found), "at": found}, schema=schema)

    return files.select("part", "shard", "file").mapInArrow(run, "part int, shard long, at long")


def occurrences(files: DataFrame, symbol: int) -> DataFrame:
    """(part, shard, n): how often a token stands in each shard, by rank queries on the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [unpack_shard(x)[2].count(symbol) for x in batch.column("file").to_pylist()]
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "shard": batch.column("shard"), "n": counts}, schema=pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("n", pa.int64())]))

    return files.select("part", "shard", "file").mapInArrow(run, "part int, shard long, n long")
