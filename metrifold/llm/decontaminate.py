"""Benchmark decontamination: test n-grams in a broadcast hash set, training token windows scanned against it.

Words are the runs of 0-9, a-z and bytes from 0x80 of the text with A-Z lower-cased. Each benchmark item gives
its windows of ``n`` consecutive words, or one window of all its words where it has fewer. Benchmark words get
small numbers; a window's key is the bytes of its numbers, so a hit in the hash set compares whole windows and
is thereby verified. Up to ``broadcast_words`` benchmark words (and 16 bytes of text for each) the set is broadcast.
Beyond that a bitmap of window hashes, whose size is fixed, is broadcast in its place; the few document windows that
pass it meet the benchmark's in a join on the windows themselves. Both ways give the same rows.

Defined cases: null text has no words; items without words or with a null id give no window; repeated items
count once; documents without words have no hits and are not contaminated; rows with a null id are judged like
all others, repeated rows as often as they come; extra columns of whatever name are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrifold.llm.common import free_name, small_batches, texts, written

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BITMAP = 1 << 26  # bits of the hash bitmap: 8 MB
_SCHEMA = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


class WindowSet:
    """An exact hash set of word windows of any lengths up to n, each with the ids of its items."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[int]]):
        self.number = {w: i for i, w in enumerate(sorted({w for key in windows for w in key}), 1)}
        self.by_length: dict[int, dict[bytes, list[int]]] = {}
        for key, items in windows.items():
            ids = np.array([self.number[w] for w in key], np.int32)
            self.by_length.setdefault(len(key), {})[ids.tobytes()] = sorted(items)
        self.first = {}
        for length, held in self.by_length.items():
            self.first[length] = np.zeros(len(self.number) + 1, bool)
            self.first[length][[int.from_bytes(k[:4], "little") for k in held]] = True

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """(which words lie inside an occurrence, ids of the items with occurring windows)."""
        get = self.number.get
        ids = np.fromiter([get(w, 0) for w in words], np.int32, len(words))
        cover, items = np.zeros(len(words) + 1, np.int64), set()
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for length, held in self.by_length.items():
            if length > len(words):
                continue
            ends = len(words) - length + 1
            for i in np.flatnonzero(self.first[length][ids[:ends]] & (unknown[length:] == unknown[:ends])):
                if (found := held.get(ids[i : i + length].tobytes())) is not None:
                    items.update(found)
                    cover[i] += 1
                    cover[i + length] -= 1
        return np.cumsum(cover[:-1]) > 0, items


def _hit_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Code point offsets of the maximal runs of hit words."""
    out: list[dict] = []
    last, at, chars = -2, 0, 0
    for i, m in enumerate(_WORD.finditer(text.translate(_TABLE))):
        if hit[i]:
            chars += len(text[at : m.start()].decode())
            if last != i - 1:
                out.append({"start": chars, "end": chars})
            chars, at = chars + len(text[m.start() : m.end()].decode()), m.end()
            out[-1]["end"] = chars
            last = i
    return out


def _scan_texts(data: list[bytes | None], held: WindowSet) -> dict:
    out: dict = {"n_words": [], "n_hit": [], "items": [], "spans": []}
    for text in data:
        words = words_of(text)
        hit, items = held.scan(words)
        n = int(hit.sum())
        out["n_words"].append(len(words))
        out["n_hit"].append(n)
        out["items"].append(sorted(items))
        out["spans"].append(_hit_spans(text, hit) if n else [])
    return out


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")


def _window_set(items: DataFrame, n: int, broadcast_words: int) -> WindowSet | None:
    """The benchmark's windows, None where it has more words than may be broadcast."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    n_words, n_bytes = items.agg(F.coalesce(F.sum(words), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n_words > broadcast_words or n_bytes > 16 * broadcast_words:
        return None
    windows: dict[tuple[bytes, ...], set[int]] = {}
    for row in items.collect():  # of proven size
        for key in windows_of(words_of(row.text.encode()), n):
            windows.setdefault(key, set()).add(row.item_id)
    return WindowSet(windows)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of each row of ``docs``; spans are code point ranges of hit words."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = _items(benchmark)
    found = _window_set(items, n, broadcast_words)
    if found is None:
        judged = _scan_joined(plain.select("text"), items, n)
        out = plain.select("doc_id", _digest("text").alias("digest"), "text").join(judged, "digest", "left")
        none = F.array().cast("array<long>"), F.array().cast("array<struct<start:long,end:long>>")
        return out.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"))
    held = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **_scan_texts(texts(batch), held.value)}, schema=_ARROW)

    return plain.mapInArrow(run, _SCHEMA)


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _bit_of(window: bytes) -> int:
    return xxhash.xxh3_64_intdigest(window) % BITMAP


def _bitmap(wins: DataFrame) -> np.ndarray:
    """Which of the BITMAP bits the windows' hashes have, as bytes; a fixed size whatever the benchmark's."""
    out = np.zeros(BITMAP // 8, np.uint8)
    one = F.col("bit") + 1  # these functions count from 1
    bits = wins.groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    for row in bits.toLocalIterator():
        at = (row.bucket - 1) * 4096
        out[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)[: len(out) - at]
    return out


def _scan_joined(plain: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(digest, n_words, n_hit, items, spans) of each distinct text, without a broadcast of windows: equal windows meet in a join, which is exact."""
    spark = plain.sparkSession

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict = {"item_id": [], "len": [], "bit": [], "win": []}
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch), strict=True):
                for w in windows_of(words_of(text), n):
                    win = b" ".join(w)
                    for name, value in zip(rows, (item, len(w), _bit_of(win), win), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("item_id", pa.int64()), ("len", pa.int64()), ("bit", pa.int64()), ("win", pa.binary())]))

    wins = written(items.mapInArrow(item_windows, "item_id long, len long, bit long, win binary").distinct(), "item-windows")
    lengths = sorted(r.len for r in wins.select("len").distinct().collect())  # at most n values
    bitmap = spark.sparkContext.broadcast(_bitmap(wins.select("bit").distinct()))
    schema = pa.schema([("digest", pa.binary()), ("n_words", pa.int64()), ("pos", pa.int64()), ("len", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("win", pa.binary())])

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), texts(batch), strict=True):
                low = (text or b"").translate(_TABLE)
                words = low.split()
                rows = [(digest, len(words), -1, 0, 0, 0, None)]  # one for the text itself
                for length in lengths:
                    for i in range(len(words) - length + 1):
                        win = b" ".join(words[i : i + length])
                        bit = _bit_of(win)
                        if bitmap.value[bit >> 3] >> (bit & 7) & 1:
                            rows.append((digest, len(words), i, length, 0, 0, win))
                if len(rows) > 1:
                    places = [m.span() for m in _WORD.finditer(low)]
                    starts = _code_points(text, [a for a, _ in places])
                    ends = _code_points(text, [b for _, b in places])
                    rows[1:] = [(*r[:4], starts[r[2]], ends[r[2] + r[3] - 1], r[6]) for r in rows[1:]]
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    distinct = plain.where("text is not null").withColumn("digest", _digest("text")).dropDuplicates(["digest"])
    met = written(distinct.mapInArrow(doc_windows, "digest binary, n_words long, pos long, len long, start long, end long, win binary"), "met-windows")
    # Both sides of the join are tables, so that the part of a window that is common in the corpus can be split.
    by_window = written(wins.groupBy("len", "win").agg(F.collect_set("item_id").alias("items")), "window-items")
    hits = met.where("pos >= 0").join(by_window, ["len", "win"])
    places = hits.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("pos", "len", "start", "end"))).alias("met"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("last"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def widen(acc: Column, x: Column) -> Column:
        """One more window, in order: the words it adds, and the span that it goes on with or begins."""
        stop = x["pos"] + x["len"]
        more = F.greatest(F.lit(0), stop - F.greatest(x["pos"], acc["last"]))
        joins = (F.size(acc["spans"]) > 0) & (x["pos"] <= acc["last"])
        tail = F.element_at(acc["spans"], -1)
        grown = F.concat(F.slice(acc["spans"], 1, F.size(acc["spans"]) - 1), F.array(F.struct(tail["start"].alias("start"), F.greatest(tail["end"], x["end"]).alias("end"))))
        spans = F.when(joins, grown).otherwise(F.concat(acc["spans"], F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["last"], stop).alias("last"), spans.alias("spans"))

    done = places.select("digest", "items", F.aggregate("met", start, widen).alias("r"))
    return met.where("pos < 0").select("digest", "n_words").join(done, "digest", "left").select("digest", "n_words", F.coalesce("r.n", F.lit(0)).alias("n_hit"), "items", "r.spans")


def _code_points(text: bytes, places: list[int]) -> list[int]:
    """Code point offsets of ascending byte offsets."""
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return before[places].tolist()


def contaminated() -> Column:
    """The rule: at least a twentieth of the words, and one at least, are inside benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, spans: bool = False, broadcast_words: int = 200_000) -> DataFrame:
    """``docs`` without its contaminated rows or, with ``spans``, with the hit words cut out of those rows' texts.

    Columns stay as they are; with ``spans`` n_chars, where there is one, is set anew. Where the benchmark is broadcast,
    rows are judged where they are and nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    items = _items(benchmark)
    found = _window_set(items, n, broadcast_words)
    name = free_name(docs.columns, "judged")
    kind = "n_words long, n_hit long, spans array<struct<start:long,end:long>>"
    if found is not None:
        held = docs.sparkSession.sparkContext.broadcast(found)

        @F.pandas_udf(kind)
        def judge(series: pd.Series) -> pd.DataFrame:
            got = _scan_texts([None if t is None else t.encode() for t in series], held.value)
            return pd.DataFrame({k: got[k] for k in ("n_words", "n_hit", "spans")})

        rows = docs.withColumn(name, judge(F.col("text")))
    else:
        key = free_name(docs.columns, "digest")
        judged = _scan_joined(docs.select("text"), items, n).select(F.col("digest").alias(key), F.struct("n_words", "n_hit", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans")).alias(name))
        rows = docs.withColumn(key, _digest("text")).join(judged, key, "left")
    bad = F.coalesce((F.col(f"{name}.n_hit") > 0) & (20 * F.col(f"{name}.n_hit") >= F.col(f"{name}.n_words")), F.lit(False))
    if not spans:
        return rows.where(~bad).select(docs.columns)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.col(f"{name}.spans.end"))
    ends = F.concat(F.col(f"{name}.spans.start"), F.array(F.char_length("text").cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda x: F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))), "")
    text = F.when(bad, kept).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(bad, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return rows.select([new.get(c, F.col(c)).alias(c) for c in docs.columns])
