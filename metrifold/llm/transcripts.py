"""Transcript parsing: a hidden Markov model over speaker markers and line features recovers roles.

States are a role's first line and its further lines. What a line shows (a speaker marker and its kind, its
length, how it begins and ends) is one small code; transitions and emissions are smoothed counts over all
labelled rows. Viterbi runs by segments: the lines of ``SEGMENT`` turns stream through a task in pieces of at most
``LINES`` lines. Each piece gives the best score from every first to every last state, the pieces of a transcript are
then joined by their ends alone, and each is decoded between its fixed ends. So a task holds the lines of one
piece at a time, however long a turn or transcript is, and the result is that of one Viterbi run.
Lines are then rendered as canonical turns: a header where a turn starts, an end mark where it stops.

Defined cases: rows with a null conversation or turn have no place and are left out; null text is one empty
line; an unknown or null role is not counted in the fit and is decoded as one of the three; a turn follows the one
before it in its conversation, whatever numbers lie between; of rows that share conversation and turn
all are kept, in the order of their texts' hashes; without any labelled row the model is uniform and gives the first role.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrifold.llm.common import small_batches

ROLES = ("user", "assistant", "system")
STATES = tuple((role, first) for role in ROLES for first in (True, False))
SEGMENT, LINES = 512, 4096
#: Speaker markers by the side they stand for; fixed values.
MARKERS = {"user": "user|human|customer|question|q|me", "assistant": "assistant|bot|ai|model|answer|agent|a", "system": "system|instructions|instruction|context"}
_FORM = r"(?i)^\s*(?:#{{1,4}}\s*|\[|<\|?|\*\*)?(?:{})(?:\]|\|?>|\*\*)?(?:\s*[:>]|(?<=[\]>]))\s*"
#: A mark of the canonical form inside a text, with the backslashes that it may have.
_MARK = r"<(\\*\|im_(?:start|end)\|>)"
_CODES = 4 * 5 * 2 * 3


def line_code(line: Column) -> Column:
    """What the model sees of a line: marker (4) x length (5) x begins with a capital (2) x ending (3)."""
    marker = F.lit(0)
    for i, role in enumerate(ROLES, 1):
        marker = F.when(line.rlike(_FORM.format(MARKERS[role])), i).otherwise(marker)
    n = F.char_length(line)
    length = F.when(n == 0, 0).when(n < 60, 1).when(n < 160, 2).when(n < 400, 3).otherwise(4)
    capital = F.when(line.rlike(r"^\p{Lu}"), 1).otherwise(0)
    ending = F.when(line.rlike(r"\?\s*$"), 2).when(line.rlike(r"[.!]\s*$"), 1).otherwise(0)
    return (((marker * 5 + length) * 2 + capital) * 3 + ending).cast("int")


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Raw lines (conv_id, turn, line_no, line, role) from a table of turns; most conversations get one of three marker styles, the rest none."""
    styles = ({"user": "User: ", "assistant": "Assistant: ", "system": "System: "}, {"user": "Q: ", "assistant": "A: ", "system": "### Instructions: "}, {"user": "[human] ", "assistant": "[bot] ", "system": "[system] "})
    style = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    mark = F.lit("")
    for i, names in enumerate(styles):
        for role, text in names.items():
            mark = F.when((style == i) & (F.col("role") == role), text).otherwise(mark)
    rows = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", F.struct(F.xxhash64("text"), F.monotonically_increasing_id()).alias("row"), F.split(F.coalesce("text", F.lit("")), "\n").alias("parts"), mark.alias("mark"))
    rows = rows.select("conv_id", "turn", "role", "row", "mark", F.posexplode("parts").alias("line_no", "line"))
    return rows.select("conv_id", "turn", "line_no", F.when(F.col("line_no") == 0, F.concat("mark", "line")).otherwise(F.col("line")).alias("line"), "role", "row")


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    show: np.ndarray

    def transfer(self, codes: list[int]) -> np.ndarray:
        """Best score from each first state (rows) to each last state of a segment, its own emissions included."""
        n = len(STATES)
        score = np.where(np.eye(n, dtype=bool), self.show[:, codes[0]], -np.inf)
        for c in codes[1:]:
            score = (score[:, :, None] + self.move[None]).max(axis=1) + self.show[:, c]
        return score

    def between(self, codes: list[int], first: int, last: int) -> list[int]:
        """The best states of a segment from ``first`` to ``last``; the lowest state wins ties."""
        n = len(STATES)
        score = np.full(n, -np.inf)
        score[first] = 0.0
        back = []
        for c in codes[1:]:
            both = score[:, None] + self.move
            back.append(both.argmax(axis=0))
            score = both.max(axis=0) + self.show[:, c]
        out = [last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def ends(self, transfers: list[np.ndarray]) -> list[tuple[int, int]]:
        """The (first, last) states of each segment on the best path over all of them."""
        opening = transfers[0] + self.start[:, None]
        best, back = opening.max(axis=0), [(opening.argmax(axis=0), None)]
        for t in transfers[1:]:
            entry = best[:, None] + self.move
            into, score = entry.argmax(axis=0), entry.max(axis=0)
            total = score[:, None] + t
            back.append((total.argmax(axis=0), into))
            best = total.max(axis=0)
        last, out = int(best.argmax()), []
        for firsts, into in reversed(back):
            first = int(firsts[last])
            out.append((first, last))
            last = int(into[first]) if into is not None else last
        return out[::-1]


def fit(lines: DataFrame) -> Hmm:
    """Counts over all rows with a known role: what each state shows, how states follow within turns and from turn to turn."""
    n = len(STATES)
    known = lines.where(F.col("role").isin(*ROLES))
    start, move, show = np.ones(n), np.full((n, n), 0.1), np.full((n, _CODES), 0.1)
    at = {s: i for i, s in enumerate(STATES)}
    for r in known.groupBy("role", (F.col("line_no") == 0).alias("first"), line_code(F.col("line")).alias("code")).count().collect():  # at most states x codes rows
        show[at[r["role"], r["first"]], r["code"]] += r["count"]
    for r in known.where("line_no > 0").groupBy("role", (F.col("line_no") == 1).alias("second")).count().collect():
        move[at[r["role"], r["second"]], at[r["role"], False]] += r["count"]
    turns = known.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.max("line_no").alias("lines"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.select("role", F.lag("role").over(w).alias("before"), (F.lag("lines").over(w) == 0).alias("single"))
    for r in after.groupBy("role", "before", "single").count().collect():
        if r["before"] is None:
            start[at[r["role"], True]] += r["count"]
        else:
            move[at[r["before"], r["single"]], at[r["role"], True]] += r["count"]
    return Hmm(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(show / show.sum(axis=1, keepdims=True)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held, strict=True)), strict=True)), schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held, strict=True)), strict=True)), schema=schema)


def parse(lines: DataFrame, model: Hmm | None = None) -> DataFrame:
    """(conv_id, turn, line_no, role, starts, rendered) of each line: the recovered role, whether a turn starts, and the canonical text."""
    small_batches(lines.sparkSession)
    model = model or fit(lines)
    given = lines.schema["conv_id"].dataType.simpleString()
    kind = "bigint" if given in ("tinyint", "smallint", "int", "bigint") else "string"
    conv = F.hex("conv_id") if given == "binary" else F.col("conv_id").cast(kind)
    row = F.col("row") if "row" in lines.columns else F.lit(0)
    rows = lines.where("conv_id is not null and turn is not null").select(conv.alias("conv_id"), row.alias("row"), F.floor(F.col("turn") / SEGMENT).cast("long").alias("seg"), F.col("turn").cast("long").alias("turn"), F.col("line_no").cast("long").alias("line_no"), F.coalesce("line", F.lit("")).alias("line"))
    rows = rows.withColumns({"code": line_code(F.col("line")), "tie": F.xxhash64("line")})
    key = ["conv_id", "seg"]
    order = [*key, "turn", "row", "line_no", "tie"]
    akind = pa.int64() if kind == "bigint" else pa.string()
    n = len(STATES)

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (conv, seg), group in groupby(_rows(batches), key=lambda r: r[:2]):
                for piece, some in enumerate(batched(group, LINES)):
                    yield conv, seg, piece, model.transfer([r[2] for r in some]).ravel().tolist()

        return _batches(made(), pa.schema([("conv_id", akind), ("seg", pa.int64()), ("piece", pa.int64()), ("m", pa.list_(pa.float64()))]))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
                group = list(group)
                found = model.ends([np.array(r[3]).reshape(n, n) for r in group])
                for i, r in enumerate(group):
                    yield conv, r[1], r[2], *found[i], found[i - 1][1] if i else -1, found[i + 1][0] if i + 1 < len(group) else -1

        return _batches(made(), pa.schema([("conv_id", akind), *((c, pa.int64()) for c in ("seg", "piece", "first", "last", "before", "after"))]))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        markers, mark = {role: re.compile(_FORM.format(names)) for role, names in MARKERS.items()}, re.compile(_MARK)

        def made() -> Iterator[tuple]:
            for _, group in groupby(_rows(batches), key=lambda r: r[:2]):
                bounds, row = [], next(group)
                while row[5] is None:  # the pieces' ends come first, without a code
                    bounds.append(row[6:])
                    row = next(group)
                lines = chain([row], group)
                for first, last, before, after in bounds:
                    yield from piece(list(islice(lines, LINES)), first, last, before, after)

        def piece(rows: list[tuple], first: int, last: int, before: int, after: int) -> Iterator[tuple]:
            path = [before, *model.between([r[5] for r in rows], first, last), after]
            new = [path[k] < 0 or path[k - 1] < 0 or STATES[path[k]][1] or STATES[path[k]][0] != STATES[path[k - 1]][0] for k in range(1, len(path))]
            for i, r in enumerate(rows):
                role = STATES[path[i + 1]][0]
                text = mark.sub(r"<\\\1", markers[role].sub("", r[4], count=1) if new[i] else r[4])
                text = (f"<|im_start|>{role}\n" if new[i] else "") + text + ("<|im_end|>\n" if path[i + 2] < 0 or new[i + 1] else "\n")
                yield r[0], r[2], r[3], role, bool(new[i]), text

        return _batches(made(), pa.schema([("conv_id", akind), ("turn", pa.int64()), ("line_no", pa.int64()), ("role", pa.string()), ("starts", pa.bool_()), ("rendered", pa.string())]))

    # Only codes are shuffled to find the ends; the lines move once, with the ends of each segment's pieces as rows before them.
    coded = rows.select(*order, "code").repartition(*key).sortWithinPartitions(*order)
    matrices = coded.select(*key, "code").mapInArrow(transfers, f"conv_id {kind}, seg long, piece long, m array<double>")
    bounds = matrices.repartition("conv_id").sortWithinPartitions(*key, "piece").mapInArrow(ends, f"conv_id {kind}, seg long, piece long, first long, last long, before long, after long")
    both = rows.withColumn("is_line", F.lit(1)).unionByName(bounds.withColumn("is_line", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartition(*key).sortWithinPartitions(*key, "is_line", "piece", "turn", "row", "line_no", "tie")
    out = ordered.select(*key, "turn", "line_no", "line", "code", "first", "last", "before", "after").mapInArrow(decoded, f"conv_id {kind}, turn long, line_no long, role string, starts boolean, rendered string")
    return out.withColumn("conv_id", F.unhex("conv_id") if given == "binary" else F.col("conv_id").cast(given))
