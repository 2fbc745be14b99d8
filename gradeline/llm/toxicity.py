"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios, trained on labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm import texts
from gradeline.llm.ranks import lowest_hashed
from gradeline.session import checkpointed


@dataclass(frozen=True)
class Settings:
    """N-gram sizes in code points, hashed slots, and the bounds of the training set.

    At most ``sample`` labelled rows are learnt from (those of lowest id hash), and the ``features`` slots of strongest ratio are
    kept. ``threshold`` turns a score into a prediction.
    """

    sizes: tuple[int, ...] = (3, 4, 5)
    slots: int = 1 << 20
    sample: int = 12_000
    features: int = 16_000
    least_docs: int = 4
    smooth: float = 0.5
    penalty: float = 1e-3
    iterations: int = 40
    threshold: float = 0.3


_PLACE = np.random.default_rng(31).integers(1, 1 << 31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def distinct_slots(octets: np.ndarray, offsets: np.ndarray, s: Settings, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, slot) pairs of the n-grams of every row, by row; ``wanted`` marks the slots to look at.

    A-Z is lower-cased, each white-space character is a space, a space stands at both ends. N-grams that hold a space anywhere but
    at an end are left out, so what is counted lies within a word and its edges.
    """
    points = texts.code_points(texts.lowered(octets))
    starts = np.concatenate([[0], np.cumsum(texts.starts_of_points(octets))])[offsets]
    n = len(starts) - 1
    space = np.uint32(32)
    padded = np.full(len(points) + n + 1, space)
    for row in range(n):  # one space opens each row and closes the row before
        padded[starts[row] + row + 1:starts[row + 1] + row + 1] = points[starts[row]:starts[row + 1]]
    blank = (padded == space) | ((padded >= 9) & (padded <= 13))
    padded[blank] = space
    ends = starts[1:] + np.arange(1, n + 1)
    value, barred = np.zeros(len(padded), np.uint32), np.zeros(len(padded), bool)
    work, keys = np.empty(len(padded), np.uint32), []
    for size in range(1, max(s.sizes) + 1):
        count = len(padded) - size + 1
        if count <= 0:
            break
        value, barred, work = value[:count], barred[:count], work[:count]
        np.multiply(padded[size - 1:], _PLACE[size - 1], out=work)
        value += work
        if size > 2:
            barred |= blank[size - 2:size - 2 + count]
        if size not in s.sizes:
            continue
        np.right_shift(value, np.uint32(15), out=work)
        work ^= value
        work *= np.uint32(0x2C1B3C6D + 2 * size)
        slots = work >> np.uint32(32 - s.slots.bit_length() + 1)
        at = np.flatnonzero(~barred if wanted is None else wanted[slots] & ~barred)
        keys.append(np.searchsorted(ends, at + 1) * s.slots + slots[at])
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found // s.slots, found % s.slots


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """text and toxic of the rows to learn from: labelled 0 or 1, and the id's checksum not 2 modulo 4."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    known = lowest_hashed(known, ["doc_id"], s.sample)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("double").alias("label"))


class Model:
    """A weight for every kept slot and an intercept; a score is the logistic function of their sum over a text's slots."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, intercept: float, s: Settings):
        self.settings, self.intercept = s, intercept
        self.kept, self.weights = slots.astype(np.int32), weights.astype(np.float64)

    def table(self) -> np.ndarray:
        full = np.zeros(self.settings.slots)
        full[self.kept] = self.weights
        return full

    def scores(self, octets: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
        rows, slots = distinct_slots(octets, offsets, self.settings, table != 0)
        sums = np.bincount(rows, table[slots], len(offsets) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(sums, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from labelled rows; without rows of both labels every text scores the share of label 1 (0 without any)."""
    s = settings
    rows = checkpointed(training_rows(docs, labels, s))
    totals = dict(rows.groupBy("label").agg(F.count(F.lit(1))).collect())
    clean, toxic = totals.get(0.0, 0), totals.get(1.0, 0)
    if not clean or not toxic:
        share = min(max(toxic / max(1, clean + toxic), 1e-9), 1 - 1e-9)
        return Model(np.zeros(0), np.zeros(0), float(np.log(share / (1 - share))), s)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, s.slots), np.int32)
        for batch in texts.small_batches(batches, limit=1 << 20):
            own, slots = distinct_slots(*texts.flat(batch.column("text")), s)
            label = batch.column("label").to_numpy().astype(np.int64)
            np.add.at(sums, (label[own], slots), 1)
        at = np.flatnonzero(sums.sum(0))
        for k in range(0, len(at), 100_000):
            part = at[k:k + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(sums[1, part], pa.int64()), pa.array(sums[0, part], pa.int64())], ["slot", "toxic", "clean"])

    sums = rows.mapInArrow(count, "slot bigint, toxic bigint, clean bigint").groupBy("slot").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= s.least_docs)
    ratio = F.log((F.col("toxic") + s.smooth) / (toxic + 2 * s.smooth)) - F.log((F.col("clean") + s.smooth) / (clean + 2 * s.smooth))
    strength = F.abs("ratio") * F.sqrt(F.least(F.col("toxic") + F.col("clean"), F.lit(toxic)))
    kept = sums.withColumn("ratio", ratio).orderBy(F.desc(strength), "slot").limit(s.features).select("slot", "ratio").toPandas()
    kept = kept.sort_values("slot")
    slots, ratios = kept["slot"].to_numpy(np.int64), kept["ratio"].to_numpy(float)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(s.slots, bool)
        wanted[slots] = True
        for batch in texts.small_batches(batches, limit=1 << 20):
            own, found = distinct_slots(*texts.flat(batch.column("text")), s, wanted)
            places = np.searchsorted(slots, found)
            ends = pa.array(np.searchsorted(own, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("label"), pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(ratios[places]))], ["label", "at", "value"])

    assemble = F.udf(lambda at, value: SparseVector(len(slots), at, value), VectorUDT())  # training rows only
    found = checkpointed(rows.mapInArrow(vectors, "label double, at array<int>, value array<double>"))
    ready = found.select("label", assemble("at", "value").alias("features"))
    learner = LogisticRegression(maxIter=s.iterations, regParam=s.penalty, standardization=False, tol=1e-6)
    model = learner.fit(ready)
    return Model(slots, model.coefficients.toArray() * ratios, float(model.intercept), s)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text; other columns are ignored).

    Only the text enters a score; an empty or null text scores by the intercept alone. ``held_out`` rows are those whose id never
    teaches (false for a null id). Repeated rows repeat, empty input gives an empty table. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most Settings.features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.table()
        for batch in texts.small_batches(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(own.scores(*texts.flat(batch.column("text")), table))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) whose score lies under the threshold, unchanged. Nothing is shuffled."""
    shared, limit = docs.sparkSession.sparkContext.broadcast(model), model.settings.threshold  # at most Settings.features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.table()
        for batch in texts.small_batches(batches, limit=1 << 20):
            yield batch.filter(pa.array(own.scores(*texts.flat(batch.column("text")), table) < limit))

    return docs.mapInArrow(run, docs.schema)
