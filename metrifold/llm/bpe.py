"""Byte-level BPE encoding and decoding by a rank queue under a hierarchical bitmap.

Each pre-token's bytes form a linked list of parts. Every adjacent pair that is a known token waits in the
bucket of its rank; a hierarchical bitmap over the ranks finds the lowest waiting rank by find-first-set, and
the leftmost position of that bucket merges next. An entry whose position has since changed is stale and
skipped. Work is near-linear in the length, so very long pre-tokens are no special case.

Defined cases: null and empty texts have no tokens; every byte is a token of the vocabulary, so any text
encodes and decodes to its own bytes; repeated rows are encoded as often as they come.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import repeat
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrifold.llm.common import small_batches
from metrifold.llm.pieces import SAFE_PATTERN, Bounded, PartCache, hold


WIDTH = 8  # bits of a rank that one bitmap word resolves: 256 ranks a word, one summary bit for each word
BITS = [1 << i for i in range(4096)]


class RankQueue:
    """Positions by merge rank under a two-level bitmap: a summary of words, and a word for each 256 ranks.

    Find-first-set on the summary and then on one word gives the lowest waiting rank. It is empty between uses.
    """

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((ranks >> WIDTH) + 1)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = np.full(max(ranks.values()) + 1, None, object)
        for b, i in ranks.items():
            self.tokens[i] = b
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.pairs = [ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(1 << 16)]  # ranks of two-byte tokens

    def merge(self, piece: bytes) -> list[int]:
        """The token ids of one pre-token; the queue's steps stand inline, for this is the hot loop."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        buckets, words, pairs, n = self.queue.buckets, self.queue.words, self.pairs, len(piece)
        after = list(range(1, n + 1))  # start of the next part
        before = list(range(-1, n - 1))
        waits = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # the rank under which the pair that starts here waits
        waits.append(-1)
        summary = 0
        for i, rank in enumerate(waits):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # in order, so a heap as it is
                else:
                    buckets[rank] = [i]
                    words[rank >> WIDTH] |= BITS[rank & 255]
                    summary |= BITS[rank >> WIDTH]
        while summary:
            at = (summary & -summary).bit_length() - 1
            word = words[at]
            bit = word & -word
            rank = at << WIDTH | bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[at] = word = word ^ bit
                if not word:
                    summary ^= BITS[at]
            if waits[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[i] = after[gone]
            waits[gone] = waits[i] = -1
            if end < n:
                before[end] = i
                rank = get(piece[i : after[end]])
                if rank is not None:
                    waits[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        words[rank >> WIDTH] |= BITS[rank & 255]
                        summary |= BITS[rank >> WIDTH]
            j = before[i]
            if j >= 0:
                rank = get(piece[j:end])
                if rank is None:
                    waits[j] = -1
                elif rank != waits[j]:
                    waits[j] = rank
                    if rank in buckets:
                        heappush(buckets[rank], j)
                    else:
                        buckets[rank] = [j]
                        words[rank >> WIDTH] |= BITS[rank & 255]
                        summary |= BITS[rank >> WIDTH]
        out, i = [], 0
        while i < n:
            end = after[i]
            out.append(get(piece[i:end]))
            i = end
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.findall(text):
            out += self.merge(m.encode())
        return out

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(self.tokens[np.asarray(ids, np.int64)].tolist())


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Whole texts to little-endian ids: cut at safe spaces, cached by unit; texts that can't be cut by pre-token."""

    def __init__(self, path: str, pattern: str):
        self.bpe = Bpe(read_ranks(path), pattern)
        self.words = Bounded(24, at_once=True)  # the parts' cache above it keeps what comes often
        self.cache = PartCache(lambda parts: [self.plain(" " + part) for part in parts], self.plain, b"".join, special="\x00") if pattern == SAFE_PATTERN else None

    def _word(self, word: str) -> bytes:
        value = self.words.find(word)
        if value is None:
            ids = self.bpe.merge(word.encode())
            value = pack(f"<{len(ids)}I", *ids)
            self.words.keep(word, value)
        return value

    def plain(self, text: str) -> bytes:
        return b"".join(map(self._word, self.bpe.pattern.findall(text)))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        cut = self.cache.values(texts) if self.cache is not None else repeat(None)
        return (self.plain(text) if got is None else got for text, got in zip(texts, cut))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        return self.bpe.decode(np.frombuffer(ids, "<u4"))


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process, held while the worker encodes."""
    return hold(("bpe", path, pattern), lambda: Encoder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, with ``ids`` also the ids as little-endian binary; ids are decoded again for the last digest."""
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.binary())] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            out: dict = {name: [] for name in schema.names} | {"doc_id": batch.column("doc_id")}
            for got in enc.encode_all([text or "" for text in batch.column("text").to_pylist()]):
                out["n_tokens"].append(len(got) // 4)
                out["ids_sha256"].append(hashlib.sha256(got).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(enc.decode(got)).hexdigest())
                if ids:
                    out["ids"].append(got)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = [None if x is None else enc.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": texts}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
