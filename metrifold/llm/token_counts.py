"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier one is a compact table of the lengths of frequent pre-tokens (letters after a space), taken from a bounded
sample of documents and broadcast as one string and one array of numbers; each worker holds it beside its caches
and never evicts it. Tier two is the worker's own bounded cache, which asks the library for what is in neither.
The sample only decides what is quick, never what is counted: any pre-token that it lacks is encoded by the
library, and a text that can't be cut at its spaces is encoded whole.

Parameters: about ``sample_docs`` documents from 16 ranges of ids, of each about ``sample_parts`` parts spread evenly over the whole text, feed
the table of ``frequent`` entries. Defined cases: null and empty texts have no bytes and no tokens; special
strings inside texts count as the library's default has it; repeated rows are counted as often as they come.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrifold.llm.common import small_batches
from metrifold.llm.library import ByteLevel, is_byte_level
from metrifold.llm.pieces import hold


_RANGES = 16


def frequent_lengths(docs: DataFrame, path: str, frequent: int, sample_docs: int, sample_parts: int) -> tuple[str, np.ndarray]:
    """The most frequent pre-tokens of a bounded sample with their token counts."""
    n, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first() if is_byte_level(path) else (0, None, None)
    if not n:
        return "", np.empty(0, np.uint16)
    # Narrow ranges of ids, spread over all of them: the scan of the texts skips what lies between.
    low, high = low or 0, high or 0
    wide = -(-(high - low + 1) * sample_docs // (n * _RANGES))
    starts = {low + (high - low) * i // _RANGES for i in range(_RANGES)}
    near = reduce(or_, (F.col("doc_id").between(at, min(at + wide - 1, high)) for at in sorted(starts)))
    sample = docs.where(near).select("text").where("text is not null").limit(2 * sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                parts = text.split(" ")[1:]
                seen.update(p for p in parts[:: max(1, len(parts) // sample_parts)] if len(p) <= 64 and p.isalpha())
        top = seen.most_common(frequent)
        library = ByteLevel(path, counts=True)
        sizes = [library.whole(" " + p) for p, _ in top]
        yield pa.RecordBatch.from_pydict({"p": [p for p, _ in top], "n": [n for _, n in top], "len": sizes}, schema=pa.schema([("p", pa.string()), ("n", pa.int64()), ("len", pa.int64())]))

    top = sample.coalesce(1).mapInArrow(run, "p string, n long, len long").orderBy(F.desc("n"), "p").limit(frequent).toArrow()
    return " ".join(top.column("p").to_pylist()), np.array(top.column("len").to_pylist(), np.uint16)


def _counted(path: str, table: tuple[str, np.ndarray]) -> ByteLevel:
    lengths = dict(zip(table[0].split(" "), table[1].tolist(), strict=True)) if table[0] else None
    return ByteLevel(path, counts=True, table=lengths)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, frequent: int = 65_536, sample_docs: int = 2_000, sample_parts: int = 1_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, as the library for ``path`` counts whole texts."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = spark.sparkContext.broadcast(frequent_lengths(rows, path, frequent, sample_docs, sample_parts))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = hold(("counts", path, table.value[0]), lambda: _counted(path, table.value))
        for batch in batches:
            tokens = list(counted.values([text or "" for text in batch.column("text").to_pylist()]))
            sizes = [0 if x is None else x for x in batch.column("n_bytes").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": sizes, "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}, schema=schema)

    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
