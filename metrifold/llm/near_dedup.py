"""Near-duplicate classes: banded MinHash, verified by Odd sketches and then by full shingle sets.

Steps, all Spark jobs: one pass makes each document's distinct word shingles, band keys of independent MinHash
samples, and an Odd sketch: the bottom MinHash samples of one hash (all of a set of up to SAMPLES shingles)
folded into a parity bitmap, so that the population count of the XOR of two bitmaps estimates how many samples
differ, closely for high similarities. Equal shingle sets fall together by digest, so copies cost no pairs.
Within a band bucket every member is held against one centre (a star, not all pairs); pairs whose sketches
allow the threshold are confirmed on the full sets. The members of buckets that still hold several components are
dealt again by bands of more samples, which part texts that only share a template; two stars with other centres
later, pairs of different components in buckets that are still open are
compared in bounded blocks of sketches. So a link is missed only if no band finds it: with a chance of at most
MISS at the threshold for either set of bands, less above it. Buckets and centres of any size are dealt to tasks by
parts of at most about SALT rows.

Defined cases: null or empty text and text without words have no shingles and link with nothing; a text of
fewer than ``k`` words is one shingle; rows with a null id are returned unlinked (component null, kept);
repeated rows of one id are returned as often as they come, in one component: where their texts differ, each text is held
against others, and what any of them links with is linked; columns other than id and text are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrifold.llm.common import small_batches, texts, written
from metrifold.llm.pieces import let_go

SKETCH_BITS = 2048
SAMPLES = 1024
BLOCK = 512
SALT = 512
CLOSER = 900  # samples at most of the bands that open buckets are dealt by again
MISS = 1.5e-5
_WORDS = SKETCH_BITS // 64


def bands_for(percent: int, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the longest rows for which at most ``most`` samples miss a pair at the threshold less often than MISS."""
    j, best = percent / 100, (1, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(MISS) / math.log1p(-(j**rows))) if j < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; bytes.lower and bytes.split treat exactly A-Z and ASCII space."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    for i in range(min(k, len(w))):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return np.unique(h)


def _signer(percent: int, most: int = 160):
    bands, rows = bands_for(percent, most)
    samples = bands * rows
    rng = np.random.default_rng(20240229)
    mult = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, samples, dtype=np.uint64)
    fold = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band_no = _mix(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(s: np.ndarray) -> tuple[list[int], list[int]]:
        low = np.full(samples, 2**32 - 1, np.uint64)
        for at in range(0, len(s), 2048):
            part = s[at : at + 2048, None] * mult
            part += add
            part >>= np.uint64(32)
            np.minimum(low, part.min(axis=0), out=low)
        keys = _mix((low.reshape(bands, rows) * fold).sum(axis=1, dtype=np.uint64) + band_no)
        slots = (_mix(s[:SAMPLES]) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
        parity = np.packbits((np.bincount(slots, minlength=SKETCH_BITS) & 1).astype(np.uint8))
        return keys.view(np.int64).tolist(), parity.view(np.int64).tolist()

    return sign


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("same", F.xxhash64("text"))


def signatures(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text", most: int = 160) -> DataFrame:
    """(doc_id, same, n_shingles, digest, bands, sketch) of each row; ``same`` tells texts of one id apart; digest to sketch are null without shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sign = _signer(percent, most)
        for batch in batches:
            out: dict = {name: [] for name in schema.names}
            for text in texts(batch):
                s = shingle_set(text, k)
                keys, sketch = sign(s) if len(s) else (None, None)
                out["n_shingles"].append(len(s))
                out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out["bands"].append(keys)
                out["sketch"].append(sketch)
            out["doc_id"], out["same"] = batch.column("doc_id"), batch.column("same")
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, same long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _limit(percent: int, sizes, np_=np, ratio=None):
    """Most XOR bits for two sketches of documents at the threshold, six standard errors added.

    ``sizes`` are the summed sample counts, ``ratio`` the smaller shingle set's size over the larger's (None: any), as
    arrays or columns; ``np_`` has their exp, sqrt, where and maximum. Sets of up to SAMPLES shingles are held whole.
    Of a larger set's samples a share is common to both: 2j / (1 + j) in sets of one size, j where one holds the other.
    """
    j, n = percent / 100, float(SKETCH_BITS)
    common = j if ratio is None else (ratio + 1) * (j / (1 + j))
    drawn = sizes - 2 * SAMPLES * common + 6 * 2 * np_.sqrt(SAMPLES * common * (1 - common))
    apart = np_.maximum(sizes * ((1 - j) / (1 + j)), drawn)
    odd = (1 - np_.exp(apart * (-2 / n))) * 0.5
    spread = odd * (1 - odd) * n - apart * np_.exp(apart * (-4 / n))
    return odd * n + 6 * np_.sqrt(np_.where(spread > 1, spread, 1.0)) + 1


class _Sql:
    """The functions of ``_limit`` for columns."""

    exp, sqrt, maximum = staticmethod(F.exp), staticmethod(F.sqrt), staticmethod(F.greatest)

    @staticmethod
    def where(test, yes, no):
        return F.when(test, yes).otherwise(F.lit(no))


def _alike(percent: int):
    """Whether the sketches ``sa`` and ``sb`` of ``na`` and ``nb`` shingles allow the threshold."""
    apart = F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0]))
    for i in range(1, _WORDS):
        apart = apart + F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i]))
    sizes = F.least("na", F.lit(SAMPLES)) + F.least("nb", F.lit(SAMPLES))
    return apart <= _limit(percent, sizes.cast("double"), _Sql, F.least("na", "nb") / F.greatest("na", "nb"))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds: joins and minima only, so a hot node is split like any skewed join.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    while True:
        # settled when every node has one label and those that are labels have their own
        labels = now.unionAll(now.select(F.col("v").alias("u"), "v")).groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        labels = written(labels, label)
        if labels.where("m <> x").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("m").alias("component"))
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least neighbours are a table, so that both sides of the join are dealt anew and a hot node's part can be split
        low = labels.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low2.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, label)


def _parts(n: str = "n") -> Column:
    return F.ceil(F.col(n) / SALT).cast("int")


def _part_of(other: str) -> Column:
    """The part that a row of a group of ``n`` goes to, by another of its columns."""
    return F.pmod(F.xxhash64(other), _parts()).cast("int").alias("part")


def _each_part(df: DataFrame) -> DataFrame:
    """A group's row (with its size ``n``) once for each part of the group."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1))).drop("n")


def _attach(pairs: DataFrame, side: str, other: str, rows: DataFrame) -> DataFrame:
    """``pairs`` (a, b, n) with the columns of ``rows`` (side, ...): no pair's side occurs in more than ``n`` pairs, so a hot one is dealt to parts."""
    sizes = pairs.groupBy(side).agg(F.max("n").alias("n"))
    return pairs.withColumn("part", _part_of(other)).join(_each_part(sizes.join(rows, side)), [side, "part"]).drop("part")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, both_hot: bool = False) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; an ``a`` occurs at most once for each band unless ``both_hot``."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    used = written(docs.join(need, "doc_id", "left_semi"), "pair-texts")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, sb = [], None, None
            for ta, tb in zip(texts(batch, "ta"), texts(batch, "tb"), strict=True):
                if tb != last:
                    last, sb = tb, shingle_set(tb, k)
                sa = shingle_set(ta, k)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * both >= percent * (len(sa) + len(sb) - both) and both > 0)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}, schema=schema).filter(pa.array(keep, pa.bool_()))

    texts_a = used.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    left = _attach(pairs, "a", "b", texts_a) if both_hot else pairs.join(texts_a, "a")
    return _attach(left, "b", "a", used.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))).select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _buckets(signed: DataFrame, label: str) -> DataFrame:
    """(key, rep, n, comp) of the buckets of several members, from (rep, bands)."""
    banded = signed.select("rep", F.explode("bands").alias("key"))
    shared = written(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{label}-keys")  # so that a hot key's part can be split
    return written(banded.join(shared, "key").select("key", "rep", "n", F.col("rep").alias("comp")), label)


def _star(buckets: DataFrame, sketches: DataFrame, percent: int, salt: int) -> DataFrame:
    """(a, b, n): each bucket member with the bucket's centre, where they are of different components and the sketches allow a link."""
    order = F.col("rep") if not salt else F.xxhash64("rep", F.lit(salt))
    centre = buckets.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("rep"), F.col("comp").alias("comp"))).alias("c"), F.max("n").alias("n"))
    centre = centre.select("key", F.col("c.rep").alias("b"), F.col("c.comp").alias("cb"), "n")
    pairs = buckets.withColumn("part", _part_of("rep")).join(_each_part(centre), ["key", "part"]).where("comp <> cb").groupBy(F.col("rep").alias("a"), "b").agg(F.max("n").alias("n"))
    s = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("size").alias("na"))
    t = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("size").alias("nb"))
    return _attach(pairs.join(s, "a"), "b", "a", t).where(_alike(percent)).select("a", "b", "n")


def _open_buckets(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """Buckets whose members still lie in several components, with the members' components."""
    now = buckets.select("key", "rep", "n").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    keys = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("n").alias("n")).where("x <> y").select("key", "n")
    return now.withColumn("part", _part_of("rep")).join(_each_part(keys), ["key", "part"]).drop("part")


def _blocks(buckets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): every pair of different components in an open bucket whose sketches allow a link; pairs of bounded blocks are compared, only hits are rows."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = buckets.join(sketches, "rep").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("key", "n", "rep", "comp", "sketch", "size", "mine", other).select("key", "n", "rep", "comp", "sketch", "size", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sk = np.array(pdf["sketch"].tolist(), np.int64).view(np.uint64).reshape(len(pdf), _WORDS)
        rep, comp, mine, size = (pdf[c].to_numpy() for c in ("rep", "comp", "mine", "size"))
        lo, hi = int(pdf["lo"].iat[0]), int(pdf["hi"].iat[0])
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        found = []
        for i in left:
            near = right[(comp[right] != comp[i]) & ((rep[right] < rep[i]) if lo == hi else True)]
            if len(near):
                apart = np.bitwise_count(sk[near] ^ sk[i]).sum(axis=1)
                held = np.minimum(size[near], SAMPLES) + min(size[i], SAMPLES)
                ratio = np.minimum(size[near], size[i]) / np.maximum(size[near], size[i])
                near = near[apart <= _limit(percent, held.astype(float), ratio=ratio)]
                found += [(rep[i], x, pdf["n"].iat[0]) for x in rep[near]]
        return pd.DataFrame(found, columns=["a", "b", "n"], dtype="int64")

    return rows.groupBy("key", "lo", "hi").applyInPandas(compare, "a long, b long, n long").groupBy("a", "b").agg(F.max("n").alias("n"))


def _one_id(usable: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b) between the nodes of an id that has texts of several shingle sets."""
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id", F.col("x").alias("first"))
    apart = several.join(usable.select("doc_id", "digest").distinct(), "doc_id").where("digest <> first")
    both = apart.join(reps.select("digest", F.col("rep").alias("a")), "digest")
    return both.join(reps.select(F.col("digest").alias("first"), F.col("rep").alias("b")), "first").select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: classes of documents linked by a Jaccard similarity of ``k``-word shingle sets of ``percent`` or more."""
    small_batches(docs.sparkSession)
    plain = _narrow(docs, id_col, text_col).where("doc_id is not null")
    sig = written(signatures(docs, k, percent, id_col, text_col), "signatures")
    usable = sig.where("digest is not null and doc_id is not null")
    # Each distinct shingle set is a node of its own number, with one row that stands for it.
    reps = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "same")).alias("of")).select("digest", "of.doc_id", "of.same")
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    place = ["doc_id", "same"]
    own = usable.drop("digest").join(reps.select("rep", *place), place).dropDuplicates(["rep"])
    own = written(own.select("rep", "bands", "sketch", F.col("n_shingles").alias("size")), "own-signatures")
    sketches = own.select("rep", "sketch", "size")
    buckets = _buckets(own, "buckets")

    # One pass gathers the texts that may be compared; the merge join is asked for so that its plan is the same at every size.
    held = buckets.select("rep").distinct().join(reps.select("rep", *place), "rep")
    plain = written(plain.hint("merge").join(held.hint("merge"), place).dropDuplicates(["rep"]).select(F.col("rep").alias("doc_id"), "text"), "candidate-texts")
    edges = written(_confirmed(written(_star(buckets, sketches, percent, 0), "pairs"), plain, k, percent).unionAll(_one_id(usable, reps)), "edges")
    comps = written(connected_components(edges), "components")
    for salt in (1, 2, None):
        left = written(_open_buckets(buckets, comps), "open")
        if salt == 1 and not left.isEmpty():
            members = left.select(F.col("rep").alias("doc_id")).distinct()
            closer = signatures(plain.join(members, "doc_id", "left_semi"), k, percent, most=CLOSER)
            buckets = _buckets(written(closer.select(F.col("doc_id").alias("rep"), "bands"), "closer-signatures"), "closer-buckets")
            left = written(_open_buckets(buckets, comps), "open")
        if left.isEmpty():
            break
        pairs = written(_blocks(left, sketches, percent) if salt is None else _star(left, sketches, percent, salt), "pairs")
        if pairs.isEmpty():
            continue
        edges = written(edges.unionAll(_confirmed(pairs, plain, k, percent, salt is None)), "edges")
        comps = written(connected_components(edges), "components")
    # A component is named by the least id of all its nodes; nodes without links name themselves.
    named = comps.withColumnRenamed("node", "rep").join(reps.select("rep", "doc_id"), "rep")
    least = written(named.groupBy("component").agg(F.min("doc_id").alias("least")), "least-ids")
    named = reps.select("digest", "rep", F.col("doc_id").alias("own")).join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(least, "component", "left")
    label = sig.select("doc_id", "n_shingles", "digest").join(named.select("digest", F.coalesce("least", "own").alias("least")), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    return label.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
