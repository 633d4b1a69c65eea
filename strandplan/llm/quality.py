"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed byte trigrams and of a few hashed events that trigrams can't show (a word that repeats
the one before it, by its share of the words), log-scaled, weighted by inverse document frequency and reduced by the
leading eigenvectors of the labelled sample.  The labelled vectors, at most ``max_labelled``, are broadcast; each
document's vector is multiplied with all of them in blocks, and the labels of the ``neighbours`` nearest vote with
weights exp(cosine / temperature).

Only a labelled row's own text and label are learnt from: never lang, source or doc_id, the last of which only decides
whether a row is held out and which rows make the bounded sample.  A null text is empty; an empty text, and any text
when no label is known, scores the share of label 1 in the sample (0.5 without a sample).  Of several labels for one
doc_id the mean decides, 1 on a tie; of several texts for one labelled doc_id the smallest is learnt from.  Very long texts
are read whole, in pieces of 2^20 bytes.  Repeated rows are scored alike and each returned.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandplan.llm.common import own_name, utf8, whole_text

THRESHOLD = 0.3
HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 5) = 0"
#: Fixed multipliers of the trigram hash.
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


@dataclass(frozen=True)
class Settings:
    buckets: int = 2048
    events: int = 8
    dimensions: int = 128
    neighbours: int = 32
    temperature: float = 0.05
    #: Bound on labelled rows in the sample, and so on what is sent to the driver and broadcast.
    max_labelled: int = 6000
    block: int = 512

    @property
    def width(self) -> int:
        return self.buckets + self.events


@dataclass(frozen=True)
class Model:
    settings: Settings
    weights: np.ndarray
    axes: np.ndarray
    centre: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def features(text: bytes, settings: Settings) -> np.ndarray:
    """Log-scaled counts, trigrams first, then events."""
    out = np.zeros(settings.width, np.float32)
    shift = np.uint32(32 - int(np.log2(settings.buckets)))
    for at in range(0, len(text), 1 << 20):
        raw = np.frombuffer(text, np.uint8)[at : at + (1 << 20) + 2].astype(np.uint32)
        if len(raw) > 2:
            mixed = (raw[:-2] * _MULTIPLIERS[0]) ^ ((raw[1:-1] + np.uint32(257)) * _MULTIPLIERS[1]) ^ ((raw[2:] + np.uint32(65537)) * _MULTIPLIERS[2])
            mixed ^= mixed >> np.uint32(15)
            mixed *= _MULTIPLIERS[1]
            out[: settings.buckets] += np.bincount(mixed >> shift, minlength=settings.buckets)
    words = text.split()
    if len(words) > 1:
        share = sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1)
        level = min(settings.events, int(share * 2 * settings.events))
        out[settings.buckets : settings.buckets + level] = 20
    return np.log1p(out)


def _matrix(texts: list, settings: Settings) -> np.ndarray:
    return np.stack([features(t, settings) for t in texts])


def _feature_batches(settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, settings).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], ["label", "features"])

    return run


def _texts(docs: DataFrame, *rest) -> DataFrame:
    return docs.select(*rest, F.encode(whole_text(), "UTF-8").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from labelled rows that are not held out: a sample of at most ``max_labelled``, chosen by a hash.

    Rows with a null doc_id or a null label are not learnt from.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(f"NOT ({HELD_OUT})")
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(settings.max_labelled)
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(whole_text()).alias("text"))
    found = _texts(rows, "label").mapInArrow(_feature_batches(settings), "label int, features binary").toArrow()
    labelled = found.column("label").to_numpy().astype(np.float32)
    counts = np.frombuffer(b"".join(found.column("features").to_pylist()), np.float16).reshape(-1, settings.width).astype(np.float32)
    if not len(labelled):
        empty = np.zeros((0, 1), np.float32)
        return Model(settings, np.ones(settings.width, np.float32), np.zeros((settings.width, 1), np.float32), np.zeros(1, np.float32), empty, labelled, 0.5)
    order = np.lexsort((counts @ np.arange(settings.width, dtype=np.float32), labelled))
    counts, labelled = counts[order], labelled[order]
    weights = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    scaled = _unit(counts * weights)
    _, axes = np.linalg.eigh(scaled.T @ scaled)
    axes = np.ascontiguousarray(axes[:, ::-1][:, : settings.dimensions], np.float32)
    centre = (scaled @ axes).mean(0)
    return Model(settings, weights, axes, centre, _unit(scaled @ axes - centre), labelled, float(labelled.mean()))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def vote(texts: list, model: Model) -> np.ndarray:
    """Scores of texts given as UTF-8."""
    at, scores = model.settings, np.full(len(texts), model.prior)
    if not len(model.labels):
        return scores
    near = min(at.neighbours, len(model.labels))
    for start in range(0, len(texts), at.block):
        counts = _matrix(texts[start : start + at.block], at)
        known = counts.any(axis=1)
        cosines = _unit(_unit(counts * model.weights) @ model.axes - model.centre) @ model.vectors.T
        if near < len(model.labels):
            chosen = np.argpartition(cosines, -near, axis=1)[:, -near:]
            cosines, voted = np.take_along_axis(cosines, chosen, 1), model.labels[chosen]
        else:
            voted = np.broadcast_to(model.labels, cosines.shape)
        weight = np.exp((cosines - cosines.max(axis=1, keepdims=True)) / at.temperature)
        scores[start : start + at.block][known] = ((weight * voted).sum(1) / weight.sum(1))[known]
    return np.clip(scores, 0.0, 1.0)


def _score_batches(shared, whole: bool, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = vote(utf8(batch.column("text")), shared.value)
            rest = batch if whole else batch.select([c for c in batch.schema.names if c != "text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(scores)], [*rest.schema.names, name])

    return run


def with_score(docs: DataFrame, model: Model, name: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the column ``name``."""
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*(keep or docs.columns), "text"])))
    whole = keep is None or "text" in keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shown = rows if whole else rows.drop("text")
    return rows.mapInArrow(_score_batches(shared, whole, name), T.StructType([*shown.schema, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (1 if score >= 0.3)."""
    scored = with_score(docs, fit(docs, labels, settings), "score", ["doc_id"])
    held_out = F.coalesce(F.expr(HELD_OUT), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that the vote doesn't reject, with all their columns."""
    name = own_name(docs.columns, "score")
    scored = with_score(docs, fit(docs, labels, settings), name)
    return scored.where(F.col(name) >= THRESHOLD).drop(name)
