"""Document fingerprints by closed syncmers, in DataFrame functions alone.

A text is a sequence of units: short pieces of its words that end where a certain character stands, so that
pieces fall alike wherever a passage stands and whatever its length, in scripts without spaces too. Only in a run without
white space and without any such character (of symbols, or letters of rarer alphabets) pieces depend on where the run begins. Before the
first unit stand ``K - 1`` blank ones. A ``K``-unit window is an anchor when the least of its ``S``-unit parts
lies at either edge, and so is each window that reaches the blanks. Whether a window is one depends on the window
alone, so equal passages give equal anchors wherever they stand, and a text that is made longer keeps its anchors
but for those of its last unit. The fingerprint is the distinct anchors' hashes in text order; likeness is the
Jaccard similarity of two fingerprints, and ``offsets`` gives the positions of shared anchors for positional matching.

Defined cases: null text is empty; a text without units (empty or white space) has an empty fingerprint, alike
(1.0) only to another empty one; any other text has an anchor at least; of rows that share an id the order is that
of their texts; rows with a null id come before all others, in the order of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 5, 2  # a window has four parts, so about half of the windows are anchors
#: A unit ends at any white space, after a digit, some vowels of alphabets with two cases, and each letter, mark or symbol
#: of the others; a run without any of these is cut every 15 characters from where it begins.
_SPACE, _ENDS = r"\p{Z}\t\n\x0B\f\r", r"eoEO0-9\p{Lo}\p{M}\p{So}аеоиАЕОИαεοιΑΕΟΙաեոԱԵՈაეო"
_REST = rf"\x00-\x08\x0E-\x1F!-/:-@A-DF-NP-Z\[-`a-df-np-z{{-\x7F[^\x00-\x7F{_SPACE}{_ENDS}]"  # all other characters, the common ones first
UNIT = rf"[{_REST}]{{1,15}}+[{_ENDS}]?+|[{_ENDS}]"


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: the distinct anchors of the column ``text`` in text order, array<int>."""
    h, m = f"__h_{name}", f"__m_{name}"
    units = F.transform(F.regexp_extract_all(text, F.lit(UNIT), 0), lambda unit: F.xxhash64(unit))
    df = df.withColumn(h, F.concat(F.array_repeat(F.lit(0).cast("long"), K - 1), units))
    pairs = F.transform(F.slice(h, 1, F.size(h) - 1), lambda a, i: F.xxhash64(a, F.get(h, i + 1)))
    df = df.withColumn(m, pairs)

    def anchor(first: Column, i: Column) -> Column:
        second, third, last = (F.get(m, i + j) for j in range(1, 4))
        return F.when((i < K - 1) | (F.least(first, last) <= F.least(second, third)), F.hash(first, third, last))

    windows = F.transform(F.slice(m, 1, F.size(h) - K + 1), anchor)
    return df.withColumn(name, F.array_distinct(F.filter(windows, lambda x: x.isNotNull()))).drop(h, m)


def likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def offsets(a: str, b: str) -> Column:
    """array<struct<here, there>>: places of the shared anchors in either fingerprint."""
    shared = F.array_intersect(a, b)
    return F.transform(shared, lambda x: F.struct(F.array_position(a, x).alias("here"), F.array_position(b, x).alias("there")))


def _range_of(column: str, bounds: list[int]) -> Column:
    """How many bounds are at most the column: two short searches instead of one long one."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)
    lead = F.array(*[F.lit(b[0]) for b in blocks])
    block = F.size(F.filter(lead, lambda x: x <= F.col(column)))
    inner = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    inside = F.size(F.filter(F.get(inner, block - 1), lambda x: x <= F.col(column)))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def fingerprint(docs: DataFrame, rows_a_range: int = 4_000, most_ranges: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The next document is found within ranges of doc_id, each a sort that may spill; only each range's first row is
    read again for its neighbour. ``most_ranges`` bounds the plan's list of bounds; beyond it ranges hold more rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))  # null is the least id
    n = rows.count()
    ranges = min(most_ranges, max(1, n // rows_a_range))
    cuts = rows.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], max(1000, 10 * ranges))).first()[0] if ranges > 1 else []
    bounds = sorted(set(cuts or []))
    ranged = rows.withColumn("r", _range_of("k", bounds))
    order = ("k", "text")
    own = with_anchors(ranged.repartition("r"), "text", "fp")
    w = Window.partitionBy("r").orderBy(*order)
    own = own.withColumn("next", F.lead(F.struct("text", "fp")).over(w))

    firsts = ranged.groupBy("r").agg(F.min("k").alias("k"))  # one row for each range
    ring = firsts.select(F.coalesce(F.lag("r").over(Window.orderBy("r")), F.max("r").over(Window.partitionBy(F.lit(0)))).alias("r"), "k")
    heads = rows.join(F.broadcast(ring), "k").groupBy("r").agg(F.min("text").alias("head_text"))
    heads = with_anchors(heads, "head_text", "head_fp")
    with_next = own.join(heads.select("r", F.struct(F.col("head_text").alias("text"), F.col("head_fp").alias("fp")).alias("head")), "r", "left")
    with_next = with_next.select("doc_id", "text", "fp", F.coalesce("next", "head").alias("next"), F.char_length("text").cast("long").alias("n_chars"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring(F.col("next.text"), F.lit(1), quarter))
    out = with_next.select("doc_id", "n_chars", "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited"))
    out = with_anchors(out, "edited", "edited_fp")
    text_of = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of("fp").alias("fingerprint"),
        text_of("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
