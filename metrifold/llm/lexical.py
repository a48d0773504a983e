"""Ranked lexical search by pipelined term partitioning.

The documents are inverted once, in slices of at most ``SLICE`` documents and about ``POSTINGS`` postings: a row for each
(slice, term) with packed postings. Every term has an owner, told by the share of documents that hold it: the first
owner has the rarest terms, the last one the most frequent. Items travel in bundles of about ``BUNDLE``. A bundle
carries, for each slice, sparse accumulators (a local document and its score so far) from owner to owner; at
each stage a cogroup by (bundle, slice) meets the postings of that owner and adds integer contributions. So no group
holds more than a bundle's accumulators of one slice, however frequent a term is or however many copies a text has.

After each stage the tenth best score so far over all slices bounds an item's final tenth score from below, and the terms
that are still to come bound what a document can gain. A document that can't reach the bound any more leaves
the accumulators (never one that could tie), so the rows are those of full scoring; see ``test_lexical``.

Terms that no item holds are left out while inverting where the items' terms are few enough to be broadcast
(``MOST_TERMS``, counted before); beyond it all terms are inverted and joined with the items' terms.

Defined cases: null and empty texts hold no term and are neither counted nor found; each row of documents or items
stands for itself, so repeated rows are found or answered as often as they come; a null doc_id sorts first among equal
scores, a null item_id is an item; without terms on either side no row is returned; extra columns are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrifold.llm.common import small_batches, texts, written

SLICE, POSTINGS, BUNDLE, MOST_TERMS = 4096, 1 << 18, 256, 200_000
#: Shares of documents that part the owners of terms, rarest terms first.
OWNERS = (0.001, 0.01, 0.05, 0.2)
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BUNDLES = "bundle int, slice long, counts binary, docs binary, scores binary, tops array<array<long>>"


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII digits and letters and all else above ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split() if text else []


def invert(docs: DataFrame, vocabulary: frozenset[bytes] | None, id_col: str, text_col: str) -> DataFrame:
    """(slice, term, n, docs, tfs, sizes, ids): packed postings of a slice's term; where term is null, the slice's documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").withColumn("first", F.monotonically_increasing_id())
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = [("slice", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.binary()), ("tfs", pa.binary()), ("sizes", pa.binary()), ("ids", pa.list_(pa.int64()))]

    def packed(first: int, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        found.sort(key=lambda d: (d[0] is not None, d[0] or 0))
        lists: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, _, counts) in enumerate(found):
            for term, tf in counts.items():
                lists[term].append((at, tf))
        size = np.array([d[1] for d in found], np.uint32)
        out = [(first, None, len(found), None, None, size.tobytes(), [d[0] for d in found])]
        for term, both in lists.items():
            at, tf = np.array(both, np.int64).T
            out.append((first, term, len(at), at.astype(np.uint16).tobytes(), tf.astype(np.uint32).tobytes(), size[at].tobytes(), None))
        for i in range(0, len(out), 1000):
            yield pa.RecordBatch.from_pydict({name: [r[k] for r in out[i : i + 1000]] for k, (name, _) in enumerate(fields)}, schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found, first, postings = held.value, [], None, 0
        for batch in batches:
            for number, doc, text in zip(batch.column("first").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                counts = Counter(terms_of(text))
                size = counts.total()
                if not size:
                    continue
                if wanted is not None:
                    counts = {t: counts[t] for t in counts.keys() & wanted}
                if found and (len(found) == SLICE or postings + len(counts) > POSTINGS):
                    yield from packed(first, found)
                    found, first, postings = [], None, 0
                first = number if first is None else first
                found.append((doc, size, counts))
                postings += len(counts)
        if found:
            yield from packed(first, found)

    return rows.mapInArrow(run, "slice long, term binary, n long, docs binary, tfs binary, sizes binary, ids array<long>")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times) of each row of items; ``item`` numbers the rows."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).withColumn("item", F.monotonically_increasing_id())
    words = rows.where("text is not null").select("item", "item_id", F.explode(F.split(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " ")).alias("word")).where("word <> ''")
    return words.groupBy("item", "item_id", F.col("word").cast("binary").alias("term")).agg(F.count("*").alias("times"))


def _impact(tf, size, n_docs, n_terms):
    """A posting's integer contribution before its term's weight."""
    m = 25 + (75 * size * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _stage(n_docs: int, n_terms: int, best: int):
    """Adds one owner's postings to the accumulators of a (bundle, slice)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        floors, rest = row["floors"], row["rest"]
        before = np.frombuffer(row["counts"] or b"", np.int32)
        docs, scores = np.frombuffer(row["docs"] or b"", np.uint16), np.frombuffer(row["scores"] or b"", np.int64)
        total = np.zeros((len(floors), SLICE), np.int64)
        total[np.repeat(np.arange(len(before)), before), docs] = scores
        for term in right.select(["weight", "docs", "tfs", "sizes", "members", "times"]).to_pylist():
            at = np.frombuffer(term["docs"], np.uint16)
            gain = term["weight"] * _impact(np.frombuffer(term["tfs"], np.uint32).astype(np.int64), np.frombuffer(term["sizes"], np.uint32).astype(np.int64), n_docs, n_terms)
            for item, times in zip(term["members"], term["times"], strict=True):
                total[item, at] += times * gain
        counts, out_docs, out_scores, tops = [], [], [], []
        for item, sums in enumerate(total):
            at = np.flatnonzero(sums)
            here = sums[at]
            if len(here) > best:
                floor = max(floors[item], int(np.partition(here, -best)[-best]))
                kept = here + rest[item] >= floor
                at, here = at[kept], here[kept]
            elif floors[item]:
                kept = here + rest[item] >= floors[item]
                at, here = at[kept], here[kept]
            counts.append(len(at))
            out_docs.append(at.astype(np.uint16))
            out_scores.append(here)
            tops.append(np.sort(here)[::-1][:best].tolist())
        packed = {"bundle": [row["bundle"]], "slice": [row["slice"]], "counts": [np.array(counts, np.int32).tobytes()], "docs": [np.concatenate(out_docs).tobytes()], "scores": [np.concatenate(out_scores).tobytes()], "tops": [tops]}
        return pa.table(packed, schema=pa.schema([("bundle", pa.int32()), ("slice", pa.int64()), ("counts", pa.binary()), ("docs", pa.binary()), ("scores", pa.binary()), ("tops", pa.list_(pa.list_(pa.int64())))]))

    return run


def _floors(bundles: DataFrame, best: int) -> DataFrame:
    """(bundle, floors): each item's ``best``-th score so far over all slices, 0 where there are fewer; folded in two steps."""
    each = bundles.select("bundle", "slice", F.posexplode("tops").alias("member", "top")).where(F.size("top") > 0)
    for part in ([F.pmod(F.xxhash64("slice"), F.lit(256)).alias("part")], []):
        each = each.groupBy("bundle", "member", *part).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, best).alias("top"))
    floor = F.when(F.size("top") == best, F.element_at("top", -1)).otherwise(F.lit(0))
    return each.groupBy("bundle").agg(F.map_from_entries(F.collect_list(F.struct("member", floor.alias("floor")))).alias("floors"))


def _hits(bundles: DataFrame) -> DataFrame:
    """(bundle, slice, member, doc, score) of all accumulators."""
    fields = pa.schema([("bundle", pa.int32()), ("slice", pa.int64()), ("member", pa.int32()), ("doc", pa.int32()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.frombuffer(r["counts"], np.int32)
                member = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(member), r["bundle"], np.int32)), pa.array(np.full(len(member), r["slice"])), pa.array(member), pa.array(np.frombuffer(r["docs"], np.uint16).astype(np.int32)), pa.array(np.frombuffer(r["scores"], np.int64))], schema=fields)

    return bundles.select("bundle", "slice", "counts", "docs", "scores").mapInArrow(run, "bundle int, slice long, member int, doc int, score long")


def search(docs: DataFrame, items: DataFrame, best: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0, equal scores by doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = written(item_terms(items, item_col, item_text), "search-items")
    kind = wanted.schema["item_id"].dataType.simpleString()
    n_items = wanted.agg(F.countDistinct("item")).first()[0]
    small = wanted.select("term").distinct().agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    vocabulary = None
    if small[0] <= MOST_TERMS and (small[1] or 0) <= 32 * MOST_TERMS:
        vocabulary = frozenset(bytes(r.term) for r in wanted.select("term").distinct().collect())  # MOST_TERMS at most
    index = written(invert(docs, vocabulary, id_col, text_col), "search-index")
    parts = index.where("term is null").select("slice", "ids", "n", "sizes")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": batch.column("n"), "sum": [int(np.frombuffer(s, np.uint32).sum(dtype=np.int64)) for s in batch.column("sizes").to_pylist()]}, schema=pa.schema([("n", pa.int64()), ("sum", pa.int64())]))

    n_docs, n_terms = parts.select("n", "sizes").mapInArrow(added, "n long, sum long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("sum"), F.lit(0))).first()
    if not n_docs or not n_items:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")

    bundles_of = -(-n_items // BUNDLE)
    placed = wanted.select("item", "item_id").distinct().withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles_of)).cast("int"))
    placed = placed.withColumn("member", F.row_number().over(Window.partitionBy("bundle").orderBy("item")) - 1)
    # A term's weight, its owner, and the most that one occurrence in an item can add.
    found = index.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    share = F.col("df") / F.lit(n_docs)
    owner = sum((F.when(share >= bound, 1).otherwise(0) for bound in OWNERS), F.lit(0))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    asked = wanted.join(placed.select("item", "bundle", "member"), "item").join(found.select("term", owner.alias("owner"), weight.alias("weight")), "term")
    asked = asked.groupBy("bundle", "term", "owner", "weight").agg(F.collect_list("member").alias("members"), F.collect_list("times").alias("times"), F.collect_list(F.struct("member", "times")).alias("both"))
    asked = written(asked.select("bundle", "term", "owner", "weight", F.transform("both", lambda x: x["member"]).alias("members"), F.transform("both", lambda x: x["times"]).alias("times")), "search-terms")
    placed = written(placed, "search-bundles")
    sizes = placed.groupBy("bundle").agg(F.count("*").cast("int").alias("n_members"))
    # The gain still possible after each owner: an impact is under 1,000,000 per unit of weight.
    rest = asked.withColumn("x", F.explode(F.arrays_zip("members", "times"))).groupBy("bundle", "owner", F.col("x.members").alias("member")).agg((F.sum(F.col("weight") * F.col("x.times")) * 1_000_000).alias("gain"))

    state = parts.select("slice", F.explode(F.sequence(F.lit(0), F.lit(bundles_of - 1))).alias("bundle")).select("bundle", "slice", *(F.lit(None).cast("binary").alias(c) for c in ("counts", "docs", "scores")))
    floors = sizes.select("bundle", F.create_map().cast("map<int,bigint>").alias("floors"))
    for stage in range(len(OWNERS) + 1):
        later = rest.where(F.col("owner") > stage).groupBy("bundle", "member").agg(F.sum("gain").alias("gain")).groupBy("bundle").agg(F.map_from_entries(F.collect_list(F.struct("member", "gain"))).alias("rest"))
        bounds = sizes.join(floors, "bundle", "left").join(later, "bundle", "left")
        dense = lambda c: F.transform(F.sequence(F.lit(0), F.col("n_members") - 1), lambda i: F.coalesce(F.try_element_at(F.col(c), i), F.lit(0)).cast("long"))  # noqa: E731, B023
        left = state.join(bounds.select("bundle", dense("floors").alias("floors"), dense("rest").alias("rest")), "bundle")
        right = index.where("term is not null").join(asked.where(F.col("owner") == stage), "term").select(F.col("bundle").alias("bundle"), F.col("slice").alias("slice"), "weight", "docs", "tfs", "sizes", "members", "times")
        state = left.groupBy("bundle", "slice").cogroup(right.groupBy("bundle", "slice")).applyInArrow(_stage(n_docs, n_terms, best), _BUNDLES)
        state = written(state, f"search-stage-{stage}")
        floors = _floors(state, best)

    # In the last state only what reaches an item's floor is left; ids are fetched for that alone.
    hits = _hits(state).join(floors, "bundle").where(F.col("score") >= F.coalesce(F.try_element_at("floors", F.col("member")), F.lit(0))).drop("floors")
    hits = hits.join(parts.select("slice", "ids"), "slice").select("bundle", "member", "score", F.get("ids", F.col("doc")).alias("doc_id"))
    order = Window.partitionBy("bundle", "member").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.join(placed.select("bundle", "member", "item_id"), ["bundle", "member"]).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
