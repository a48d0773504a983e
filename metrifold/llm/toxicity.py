"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives P, every document of the corpus is the unlabelled U. Linear classifiers in
numpy minimise the class-prior-corrected risk  prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])  with the logistic loss;
where the inner term turns negative, a step goes against its gradient instead. ``FOLDS`` classifiers are trained
at once, each without a fold of P; they score a document together, and the score is calibrated on labelled
rows, each positive seen by the classifier that did not learn from it.

A text is its words and their beginnings (strict prefixes of ``PREFIXES`` letters), hashed to 32 bits. Only those that are
over-represented in P count as inputs, told by their document counts in P and in all of U. An input's value is
tf / (tf + 1 + words / 100), so that one chance hit in a long text says little.

What is gathered from U covers every document: Spark counts candidates in one pass, writes the few inputs of each document
as packed rows of up to ``CHUNK`` documents (documents without any are counted, not written), and sums
gradients over all of them at each step, folded in two levels. Broadcast are candidates and weights, whose number is bounded.

Parameters: ``most_labelled`` bounds the labelled rows that are fitted on, chosen by a hash of doc_id; ``most_candidates`` and
``inputs`` the size of the model; ``prior`` the share of toxic documents, by default that of the labelled rows; ``steps`` the
passes over U. Labels come from rows outside the held-out third only; labels, lang, source and doc_id are no inputs.
Defined cases: null and empty texts are scored by the intercept; rows of ``labels`` with a null id or mark are ignored,
repeated ones count once, as toxic if any says so, with the texts of all rows of that id; without a confirmed toxic
document every score is 0; without a clean one the calibration is left out; repeated documents are scored as often as they come.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrifold.llm.common import small_batches, texts, written
from metrifold.llm.pieces import hold

PREFIXES, FOLDS, CHUNK = (4, 5, 6, 7, 8), 3, 8192
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _kinds(word: bytes) -> list[int]:
    """The hashes of a word and of its beginnings by letters; a beginning differs from the word that is the same letters."""
    crc = zlib.crc32
    if word.isascii():  # a letter is a byte, in lower case already
        size = min(len(word), 64)
        return [crc(word), *[crc(word[:n], n) for n in PREFIXES if size > n]]
    letters = word[:64].decode(errors="ignore").lower()
    return [crc(word), *[crc(letters[:n].encode(), n) for n in PREFIXES if len(letters) > n]]


class Reader:
    """Counts a text's candidates; a word's candidates are looked up once per worker while the cache has room."""

    def __init__(self, wanted: np.ndarray | None, most: int = 300_000):
        self.at = None if wanted is None else {int(h): i for i, h in enumerate(wanted)}
        self.known, self.most = {}, most

    def _of(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            kinds = _kinds(word)
            found = tuple(kinds) if self.at is None else tuple([self.at[k] for k in kinds if k in self.at])
            if len(self.known) >= self.most:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = found
        return found

    def read(self, text: bytes | None) -> tuple[dict[int, int], int]:
        """(times of each candidate, number of words)."""
        words = text.translate(_TABLE).split() if text else []
        out: dict[int, int] = {}
        known = self.known
        for word, times in Counter(words).items():
            found = known.get(word)
            if found is None:
                found = self._of(word)
            for k in found:
                out[k] = out.get(k, 0) + times
        return out, len(words)


def _values(times: np.ndarray, words) -> np.ndarray:
    return times / (times + 1 + words / 100)


@dataclass
class Model:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, FOLDS)))  # the intercepts last
    calibration: tuple[float, float] | None = None

    def logits(self, data: list[bytes | None], reader: Reader) -> np.ndarray:
        """A row of ``FOLDS`` logits for each text."""
        out = np.repeat(self.weights[-1:], len(data), axis=0)
        for i, text in enumerate(data):
            counts, words = reader.read(text)
            if counts:
                at = np.fromiter(counts, np.int64, len(counts))
                out[i] += _values(np.fromiter(counts.values(), np.int64, len(counts)), words) @ self.weights[at]
        return out

    def scores(self, data: list[bytes | None], reader: Reader) -> np.ndarray:
        if self.calibration is None:
            return np.zeros(len(data))
        return _sigmoid(self.calibration[0] * self.logits(data, reader).mean(axis=1) + self.calibration[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def held_out(doc_id: Column) -> Column:
    """The third of ids whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, fold) of a bounded number of labelled ids outside the held-out third."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic")).alias("toxic")).where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # of two numbers each
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]).select("text", (F.col("toxic") == 1).cast("int").alias("toxic"), _fold(F.col("doc_id")).alias("fold"))


def _counts(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(h, n): documents that hold each candidate; h is its hash, or its place in ``wanted``, where -1 counts all documents."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(held.value), Counter()
        for batch in batches:
            for text in texts(batch):
                seen.update(reader.read(text)[0].keys())
            seen[-1] += batch.num_rows
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_pydict({"h": list(seen), "n": list(seen.values())}, schema=schema)
                seen.clear()
        yield pa.RecordBatch.from_pydict({"h": list(seen), "n": list(seen.values())}, schema=schema)

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _design(rows: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(side, n, starts, at, value): packed inputs of up to ``CHUNK`` rows; side is -1 for U, else the fold; rows without inputs are counted in n alone."""
    held = rows.sparkSession.sparkContext.broadcast(hashes)
    schema = pa.schema([("side", pa.int32()), ("n", pa.int64()), ("starts", pa.binary()), ("at", pa.binary()), ("value", pa.binary())])

    def packed(side: int, n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        starts = np.cumsum([0, *(len(a) for a, _ in found)])[:-1].astype(np.int32)
        join = lambda k, kind: np.concatenate([f[k] for f in found]).astype(kind).tobytes() if found else b""
        return pa.RecordBatch.from_pydict({"side": [side], "n": [n], "starts": [starts.tobytes()], "at": [join(0, np.int32)], "value": [join(1, np.float32)]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        open_: dict[int, list] = {}
        for batch in batches:
            for side, text in zip(batch.column("side").to_pylist(), texts(batch), strict=True):
                counts, words = reader.read(text)
                here = open_.setdefault(side, [0, []])
                here[0] += 1
                if counts:
                    here[1].append((np.fromiter(counts, np.int64, len(counts)), _values(np.fromiter(counts.values(), np.int64, len(counts)), words)))
                if len(here[1]) == CHUNK:
                    yield packed(side, *open_.pop(side))
        for side, here in open_.items():
            yield packed(side, *here)

    return rows.select("side", "text").mapInArrow(run, "side int, n long, starts binary, at binary, value binary")


_SUMS = ("n", "risk", "risk_p", "gradient", "gradient_p", "curve")


def _sums(design: DataFrame, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Over U: E-sums of l(-f) with gradient and curvature; over P: those of l(-f) and of f, for each classifier."""
    spark = design.sparkSession
    held = spark.sparkContext.broadcast(weights)
    size, folds = weights.shape

    def zero() -> dict[str, np.ndarray]:
        return {"n": np.zeros((2, folds)), "risk": np.zeros(folds), "risk_p": np.zeros(folds), "gradient": np.zeros((size, folds)), "gradient_p": np.zeros((2, size, folds)), "curve": np.zeros((size, folds))}

    def flat(total: dict[str, np.ndarray]) -> bytes:
        return np.concatenate([total[k].ravel() for k in _SUMS]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, some = held.value, zero(), False
        for batch in batches:
            for r in batch.to_pylist():
                some = True
                starts, at, value = np.frombuffer(r["starts"], np.int32), np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32).astype(float)
                f = np.repeat(w[-1:], len(starts), axis=0)
                if len(starts):
                    f += np.add.reduceat(value[:, None] * w[at], starts, axis=0)
                row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
                bare = r["n"] - len(starts)
                p, p0 = _sigmoid(f), _sigmoid(w[-1])
                bend = p * (1 - p) * (1 + np.bincount(row, value, len(starts)))[:, None]  # row sums bound the curvature of inputs that go together
                risk, mean = _softplus(f).sum(axis=0) + bare * _softplus(w[-1]), p.sum(axis=0) + bare * p0

                def add(into: np.ndarray, times: np.ndarray, last: np.ndarray, k: int, at=at, value=value, row=row) -> None:
                    into[:-1, k] += np.bincount(at, times[row, k] * value, size - 1)[: size - 1]
                    into[-1, k] += last[k]

                for k in range(folds):
                    if r["side"] < 0:
                        total["n"][0, k] += r["n"]
                        total["risk"][k] += risk[k]
                        add(total["gradient"], p, mean, k)
                        add(total["curve"], bend, bend.sum(axis=0) + bare * p0 * (1 - p0), k)
                    elif r["side"] != k:
                        total["n"][1, k] += r["n"]
                        total["risk_p"][k] += risk[k]
                        add(total["gradient_p"][0], p, mean, k)
                        add(total["gradient_p"][1], np.ones_like(p), np.full(folds, float(r["n"])), k)
        if some:
            yield pa.RecordBatch.from_pydict({"sums": [flat(total)]}, schema=pa.schema([("sums", pa.binary())]))

    def folded(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in tables:
            for data in batch.column("sums").to_pylist():
                out = np.frombuffer(data).copy() if out is None else out + np.frombuffer(data)
        if out is not None:
            yield pa.RecordBatch.from_pydict({"sums": [out.tobytes()]}, schema=pa.schema([("sums", pa.binary())]))

    parts = design.mapInArrow(run, "sums binary")
    few = parts.repartition(8).mapInArrow(folded, "sums binary").collect()  # eight rows of bounded size
    total = np.sum([np.frombuffer(r.sums) for r in few], axis=0)
    out, shapes = {}, zero()
    for k in _SUMS:
        out[k], total = total[: shapes[k].size].reshape(shapes[k].shape), total[shapes[k].size :]
    return out


def train(design: DataFrame, size: int, prior: float, steps: int, ridge: float = 1e-3, back: float = 0.1) -> np.ndarray:
    """The weights of least risk for each classifier, by accelerated steps that a bound of the risk's curvature scales; ``back`` is the pace of corrections."""
    weights = np.zeros((size, FOLDS))
    weights[-1] = np.log(prior / (1 - prior))
    penalty = np.full((size, 1), ridge)
    penalty[-1] = 1e-6
    behind, best, least = weights, weights, np.full(FOLDS, np.inf)
    momentum = np.zeros(FOLDS)
    for _ in range(steps):
        ahead = weights + momentum / (momentum + 3) * (weights - behind)
        s = _sums(design, ahead)
        u, p = np.maximum(s["n"][0], 1), np.maximum(s["n"][1], 1)
        inner = s["risk"] / u - prior * s["risk_p"] / p  # what the clean documents add to the risk
        unlabelled, negative, linear = s["gradient"] / u, prior * s["gradient_p"][0] / p, prior * s["gradient_p"][1] / p
        # l(f) = l(-f) - f, so the risk of P is that of its negatives less the mean of f, and its gradient likewise.
        risk = prior * s["risk_p"] / p - (linear * ahead).sum(axis=0) + np.maximum(0, inner) + (penalty * ahead**2).sum(axis=0) / 2
        better = risk < least
        best, least = np.where(better, ahead, best), np.where(better, risk, least)
        below = inner < 0
        gradient = np.where(below, back * (negative - unlabelled), unlabelled - linear + penalty * ahead)
        behind, weights = weights, ahead - np.clip(gradient / (s["curve"] / u + penalty), -1.0, 1.0)
        momentum = np.where(below, 0, momentum + 1)
    return best


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, most_candidates: int = 262_144, inputs: int = 16_384, least: int = 3, over: float = 2.0, prior: float | None = None, steps: int = 25) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    sample = written(_labelled(docs, labels, most_labelled), "toxic-sample")
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return Model()
    if prior is None:
        prior = min(0.5, n_toxic / n) if n > n_toxic else 0.05
    in_p = _counts(sample.where("toxic = 1"), None).where((F.col("h") >= 0) & (F.col("n") >= min(least, n_toxic))).orderBy(F.desc("n"), "h").limit(most_candidates).toArrow()
    hashes, a = in_p.column("h").to_numpy(), in_p.column("n").to_numpy().astype(float)
    if not len(hashes):
        return Model()
    b, n_docs = np.zeros(len(hashes)), 1
    for h, count in zip(*(c.to_pylist() for c in _counts(docs, hashes).toArrow().columns), strict=True):  # one row for each candidate
        if h < 0:
            n_docs = count
        else:
            b[h] = count
    # Over-represented: by the ratio of shares, most telling first by the likelihood ratio.
    share_p, share_u = a / n_toxic, (b + 0.5) / (n_docs + 1)
    gain = np.where(share_p > over * share_u, a * np.log(share_p / share_u), 0)
    kept = np.sort(np.lexsort((hashes, -gain))[: min(inputs, int((gain > 0).sum()))])
    hashes = hashes[kept]
    rows = docs.select(F.lit(-1).alias("side"), "text").unionByName(sample.where("toxic = 1").select(F.col("fold").alias("side"), "text"))
    model = Model(hashes)
    model.weights = train(written(_design(rows, hashes), "toxic-inputs"), len(hashes) + 1, prior, steps)
    model.calibration = _calibrated(sample, model)
    return model


def _calibrated(sample: DataFrame, model: Model) -> tuple[float, float]:
    """Scale and shift of the logit: positives by the classifier that did not see them, clean rows by the mean of all."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value.hashes)
        for batch in batches:
            logits = held.value.logits(texts(batch), reader)
            toxic, fold = np.array(batch.column("toxic")), np.array(batch.column("fold"))
            out = np.where(toxic == 1, logits[np.arange(len(fold)), fold], logits.mean(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column("toxic")], schema=pa.schema([("f", pa.float64()), ("toxic", pa.int32())]))

    got = sample.select("text", "toxic", "fold").mapInArrow(run, "f double, toxic int").toArrow().sort_by([("toxic", "ascending"), ("f", "ascending")])
    f, y = got.column("f").to_numpy(), got.column("toxic").to_numpy().astype(float)
    if y.all():
        return 1.0, 0.0
    scale = max(1.0, float(np.abs(f).max()) / 8)
    x, w = np.column_stack([f / scale, np.ones(len(f))]), np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(h, x.T @ (y - p) - np.array([1e-2, 1e-4]) * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]) / scale, 1e-6), float(w[1])


def score(docs: DataFrame, labels: DataFrame, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(rows, labels, **options)
    held, name = rows.sparkSession.sparkContext.broadcast(model), ("toxicity", zlib.crc32(model.weights.tobytes()), len(model.hashes))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        reader = hold(name, lambda: Reader(held.value.hashes))
        return pd.Series(held.value.scores([None if t is None else t.encode() for t in text], reader))

    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))
