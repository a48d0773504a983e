"""Quality classification by co-training two views.

The content view sees a text (which significant words occur, and its shape: capitals, symbol clusters, bars,
repeats, lengths); the metadata view sees source, language and size. Both are logistic models fitted on a
bounded sample of labelled rows. Over rounds each view labels the unlabelled pool, and what it is confident of
(after calibration) joins the other view's training rows. Views are calibrated on out-of-fold scores of the
labelled rows, and a last logistic model on the same scores combines the two. Every document is scored.

Parameters: ``most_labelled`` and ``most_pool`` bound the sampled rows, chosen by a hash of doc_id; ``words`` the
content vocabulary. A row is good when quality is 1 and toxic is not. Defined cases: rows of ``labels`` with a
null id or null quality are ignored, repeated ones count once by their least values (of repeated documents with several
texts the least text is fitted on); without rows of both kinds
every score is 1.0 and nothing is rejected; null text is empty, null metadata a value of its own; repeated
documents are scored as often as they come; extra columns are kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrifold.llm.common import free_name, small_batches, written
from metrifold.llm.decontaminate import words_of

_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?")
_STEPS = (0.01, 0.05, 0.15, 0.4)
_BUCKETS = 64
FOLDS = 5


def shape_of(text: bytes, words: list[bytes], kinds: int) -> list[float]:
    """Ratios of the text's make-up, each also as steps, so that a linear model can bend."""
    n, w = max(1, len(text)), max(1, len(words))
    letters = max(1, n - len(text.translate(None, _LETTER)))
    ratios = [
        (n - len(text.translate(None, _UPPER))) / letters,
        (n - len(text.translate(None, _DIGIT))) / n,
        (n - len(text.translate(None, _MARKS))) / n,
        text.count(b"!!") / w,
        text.count(b" | ") / w,
        sum(map(eq, words, words[1:])) / w,
        1 - kinds / w,
        text.count(b"\n") / w,
    ]
    out = [min(8.0, math.log1p(len(text))) / 8, min(20.0, n / w) / 20, float(not words)]
    for r in ratios:
        out += [r, math.sqrt(r), *(float(r > s) for s in _STEPS)]
    return out


SHAPE = len(shape_of(b"", [], 0))


def content_features(text: bytes | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    text = text or b""
    words = words_of(text)
    distinct = set(words)
    out = np.zeros(SHAPE + len(vocabulary), np.float32)
    out[:SHAPE] = shape_of(text, words, len(distinct))
    for word in distinct & vocabulary.keys():
        out[SHAPE + vocabulary[word]] = 1
    return out


def metadata_features(source, lang, n_chars) -> np.ndarray:
    out = np.zeros(2 * _BUCKETS + 16, np.float32)
    out[zlib.crc32(str(source).encode()) % _BUCKETS] = 1
    out[_BUCKETS + zlib.crc32(str(lang).encode()) % _BUCKETS] = 1
    size = 0 if n_chars is None or n_chars != n_chars else max(0, int(n_chars))
    out[2 * _BUCKETS + min(15, size.bit_length())] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights with the intercept last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None].astype(np.float32)).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    content: np.ndarray | None = None
    metadata: np.ndarray | None = None
    calibrations: tuple[np.ndarray, np.ndarray] | None = None
    combined: np.ndarray | None = None

    def scores(self, texts, sources, langs, sizes) -> np.ndarray:
        """(content, metadata, combined) probability of being good, a row each."""
        n = len(texts)
        if self.combined is None or not n:
            return np.ones((n, 3))
        c = _logit(np.stack([content_features(t, self.vocabulary) for t in texts]), self.content)
        m = _logit(np.stack([metadata_features(*x) for x in zip(sources, langs, sizes, strict=True)]), self.metadata)
        both = np.stack([_logit(v[:, None], k) for v, k in zip((c, m), self.calibrations, strict=True)], axis=1)
        return _chance(np.column_stack([both, _logit(both, self.combined)]))


def _sampled(docs: DataFrame, labels: DataFrame, most_labelled: int, most_pool: int) -> DataFrame:
    """(doc_id, text, source, lang, n_chars, good): bounded labelled rows, and unlabelled ones with good null."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    known = known.select("doc_id", ((F.col("q") == 1) & (F.col("t") == 0)).cast("int").alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    pool = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id").limit(most_pool).distinct()
    pool = pool.join(known.join(F.broadcast(pool), "doc_id", "left_semi").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("good"))
    ids = chosen.unionByName(pool)  # at most most_labelled + most_pool rows of two numbers
    return docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "source", "lang", "n_chars", "good")).alias("r")).select("doc_id", "r.*")


def _vocabulary(sample: DataFrame, words: int, least: int) -> dict[bytes, int]:
    """The words whose presence tells most about the label, by the likelihood ratio."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {"word": [], "good": []}
            for text, good in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("good").to_pylist(), strict=True):
                here = [w for w in set(words_of(text)) if len(w) <= 40]
                out["word"] += here
                out["good"] += [good] * len(here)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("word", pa.binary()), ("good", pa.int32())]))

    labelled = sample.where("good is not null").select("text", "good")
    n, g = labelled.agg(F.count("*"), F.sum("good")).first()
    if not n or not g or g == n:
        return {}
    counts = labelled.mapInArrow(distinct, "word binary, good int").groupBy("word").agg(F.count("*").alias("df"), F.sum("good").alias("a")).where(F.col("df") >= least)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    a, df = F.col("a").cast("double"), F.col("df").cast("double")
    b = df - a
    ratio = part(a, df * (g / n)) + part(b, df * ((n - g) / n))
    top = counts.withColumn("ratio", ratio).orderBy(F.desc("ratio"), "word").limit(words).select("word").collect()
    return {bytes(r.word): i for i, r in enumerate(top)}


def _features(sample: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, content rows, metadata rows, good or NaN) of the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")}
            c = [content_features(t, vocabulary).astype(np.float16).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            m = [metadata_features(*x).astype(np.float16).tobytes() for x in zip(cols["source"], cols["lang"], cols["n_chars"], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "c": c, "m": m, "good": batch.column("good")}, schema=pa.schema([("doc_id", pa.int64()), ("c", pa.binary()), ("m", pa.binary()), ("good", pa.int32())]))

    got = sample.select("doc_id", "text", "source", "lang", "n_chars", "good").mapInArrow(run, "doc_id long, c binary, m binary, good int").toArrow().sort_by("doc_id")
    rows = lambda name: np.stack([np.frombuffer(x, np.float16) for x in got.column(name).to_pylist()]).astype(np.float32)
    good = np.array([np.nan if x is None else x for x in got.column("good").to_pylist()], float)
    return np.array(got.column("doc_id").to_pylist()), rows("c"), rows("m"), good


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _out_of_fold(x: np.ndarray, y: np.ndarray, good: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Logits of every row from a model that has not seen the labels of its fold; pseudo-labels are in all."""
    out = np.zeros(len(x))
    for f in range(FOLDS):
        rows = ~np.isnan(y) & ((fold != f) | np.isnan(good))
        if rows.any():
            out[fold == f] = _logit(x[fold == f], fit_logistic(x[rows], y[rows]))
    return out


def _calibrate(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    return fit_logistic(logit[:, None].astype(np.float32), y, ridge=1e-2)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, most_pool: int = 10_000, words: int = 192, least: int = 5, rounds: int = 3, confident: float = 0.97) -> Model:
    small_batches(docs.sparkSession)
    for name, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    sample = written(_sampled(docs.select("doc_id", "text", "source", "lang", "n_chars"), labels, most_labelled, most_pool), "quality-sample")
    model = Model(_vocabulary(sample, words, least))
    if sample.where("good is not null").agg(F.countDistinct("good")).first()[0] < 2:
        return model
    ids, c, m, good = _features(sample, model.vocabulary)
    labelled, pool = ~np.isnan(good), np.isnan(good)
    fold = np.array([zlib.crc32(int(i).to_bytes(8, "little", signed=True)) % FOLDS for i in ids])
    views, y = {"c": c, "m": m}, {"c": good.copy(), "m": good.copy()}
    calibrations: dict[str, np.ndarray] = {}
    for at in range(rounds + 1):
        outside = {v: _out_of_fold(views[v], y[v], good, fold) for v in views}
        calibrations = {v: _calibrate(outside[v][labelled], good[labelled]) for v in views}
        fitted = {v: fit_logistic(views[v][~np.isnan(y[v])], y[v][~np.isnan(y[v])]) for v in views}
        if at == rounds or not pool.any():
            break
        for view, other in (("c", "m"), ("m", "c")):
            p = _chance(_logit(_logit(views[view], fitted[view])[:, None], calibrations[view]))
            free = pool & np.isnan(y[other])
            y[other][free & (p >= confident)] = 1
            y[other][free & (p <= 1 - confident)] = 0
    model.content, model.metadata = fitted["c"], fitted["m"]
    model.calibrations = (calibrations["c"], calibrations["m"])
    both = np.column_stack([_logit(outside[v][:, None], calibrations[v]) for v in ("c", "m")])
    model.combined = fit_logistic(both[labelled].astype(np.float32), good[labelled], ridge=1e-2)
    return model


def score_column(model: Model, columns: list[str]) -> Column:
    """struct<content, metadata, combined> from text, source, lang and n_chars; columns that are missing are null."""

    @F.pandas_udf("content double, metadata double, combined double")
    def score(text: pd.Series, source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.DataFrame:
        data = [None if t is None else t.encode() for t in text]
        return pd.DataFrame(model.scores(data, source, lang, size), columns=["content", "metadata", "combined"])

    have = lambda name, kind: F.col(name).cast(kind) if name in columns else F.lit(None).cast(kind)
    return score(have("text", "string"), have("source", "string"), have("lang", "string"), have("n_chars", "long"))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, scores: str = "quality_scores", accepted: str = "accepted", **options) -> DataFrame:
    """``docs`` with ``scores`` and ``accepted``: combined score of at least ``least``. A name that ``docs`` has already gets underscores before it."""
    model = fit(docs, labels, **options)
    scores, accepted = free_name(docs.columns, scores), free_name(docs.columns, accepted)
    return docs.withColumn(scores, score_column(model, docs.columns)).withColumn(accepted, F.col(f"{scores}.combined") >= least)
