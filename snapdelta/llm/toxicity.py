"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios, learned from labelled texts.

A feature is whether a text has an n-gram of a hash bucket. Over the labelled rows each bucket gets the log ratio of its rates in
toxic and clean texts; the buckets that tell most apart stay, and logistic regression is fitted on presence times ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import spread, texts, written

#: Lengths of the n-grams, bits of a bucket, and buckets that the model keeps.
SIZES, BITS, FEATURES = (3, 4, 5, 6), 20, 2048
#: The fit takes about so many labelled texts of each class at most, chosen by hash; classes weigh what they have in all.
MOST_ROWS = 10_000
#: Weight of the squared length of the coefficients, and steps of the fit at most.
PENALTY, STEPS = 1e-4, 60
#: Code points that are looked at together; longer texts go through in pieces that overlap by an n-gram.
PIECE = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a whole text, in lower case between two blanks, with repeats, piece by piece."""
    points = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 32, np.uint32(32), points).astype(np.uint64)
    for start in range(0, len(points), PIECE):
        piece = points[start : start + PIECE + max(SIZES) - 1]
        hashes = np.zeros(len(piece), np.uint64)
        for size in range(1, max(SIZES) + 1):
            here = len(piece) - size + 1
            if here <= 0:
                break
            hashes = (hashes[:here] + piece[size - 1 :]) * _MIX
            hashes ^= hashes >> np.uint64(29)
            if size in SIZES:
                # A piece that is not the last leaves n-grams that begin beyond it to the next one.
                yield (hashes[:PIECE] >> np.uint64(64 - BITS)).astype(np.int32)


def present(text: str | None) -> np.ndarray:
    """The different buckets of a text."""
    return np.unique(np.concatenate([np.empty(0, np.int32), *(np.unique(found) for found in buckets(text))]))


@dataclass(frozen=True)
class Model:
    """Buckets in order, the product of ratio and coefficient for each, and the constant."""

    buckets: np.ndarray
    weights: np.ndarray
    constant: float

    def slots(self) -> np.ndarray:
        """The place of each bucket among those of the model; others have the place after the last."""
        slots = np.full(1 << BITS, len(self.buckets), np.int32)
        slots[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return slots

    def score(self, text: str | None, slots: np.ndarray) -> float:
        seen = np.zeros(len(self.buckets) + 1, bool)
        for found in buckets(text):
            seen[slots[found]] = True
        return float(_sigmoid(self.constant + self.weights[seen[:-1]].sum()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -x))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """``text, toxic`` of the sample, and the number of different labelled texts of each class.

    Only ids and hashes meet the labels. The ids of the sample, bounded by ``MOST_ROWS``, are broadcast to fetch the texts.
    """
    rows = docs.withColumn("hash", F.xxhash64("text"))
    by_id = labels.groupBy(labels[id_col].cast("long").alias("doc_id")).agg(F.max((labels[label_col] == 1).cast("int")).alias("toxic"))
    known = rows.select("doc_id", "hash").distinct().join(by_id.where("toxic IS NOT NULL"), "doc_id")
    known = written(known, "labelled")
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 << 30))
    limits = F.create_map(*(F.lit(x) for k in (0, 1) for x in (k, (MOST_ROWS << 30) // max(1, totals.get(k, 0)))))
    chosen = F.broadcast(known.where(part < limits[F.col("toxic")]))
    met = rows.join(chosen, ["doc_id", "hash"]).groupBy("doc_id", "hash", "toxic").agg(F.first("text").alias("text"))
    return written(spread(met.select("doc_id", "text", "toxic"), "doc_id"), "sample"), totals


def counts(sample: DataFrame) -> DataFrame:
    """How many texts of each class have a bucket: ``bucket, toxic, clean``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[toxic, present(text.as_py())] += 1
        found = np.flatnonzero(sums.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[1, found]), pa.array(sums[0, found])], ["bucket", "toxic", "clean"])

    part = sample.select("text", "toxic").mapInArrow(count, "bucket int, toxic int, clean int")
    return part.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def ratios(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """``bucket, ratio`` of the ``FEATURES`` buckets whose presence depends most on the class, by chi squared of the two by two table."""
    t, c = F.col("toxic"), F.col("clean")
    ratio = F.log((t + 1) / F.lit(toxic + 2.0)) - F.log((c + 1) / F.lit(clean + 2.0))
    has, lacks = t + c, F.lit(toxic + clean) - t - c
    cross = (t * F.lit(float(clean)) - c * F.lit(float(toxic))) / F.sqrt(has.cast("double"))
    chosen = counts.where(lacks > 0).withColumn("chi", cross * cross / lacks)
    return chosen.orderBy(F.desc("chi"), "bucket").limit(FEATURES).select("bucket", ratio.alias("ratio"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the documents that have a label; others and labels of unknown documents do not matter.

    Of several labels of a document the greatest counts, null labels do not. Rows of the same id and text count once. With
    one class only, every text scores the rate of that class with one of each class added.
    """
    sample, totals = _labelled(texts(docs, id_col, text_col), labels, id_col, label_col)
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    none = Model(np.empty(0, np.int32), np.empty(0), float(np.log((toxic + 1) / (clean + 1))))
    if not toxic or not clean:
        return none
    drawn = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = sorted((r.bucket, r.ratio) for r in ratios(counts(sample), drawn.get(1, 0), drawn.get(0, 0)).collect())
    if not kept or len(drawn) < 2:
        return none
    model = Model(np.array([b for b, _ in kept], np.int32), np.array([r for _, r in kept]), 0.0)
    shares = {k: totals[k] / drawn[k] for k in drawn}
    packed = sample.select("text", "toxic").mapInArrow(_packed(model), "toxic int, bits binary")
    found = packed.repartition(1).mapInArrow(_fitted(model, shares), "weights array<double>, constant double").first()
    return Model(model.buckets, np.array(found.weights), found.constant)


def _packed(model: Model):
    """Which of the model's buckets a text has, a bit each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model.slots()
        for batch in batches:
            bits = []
            for text in batch.column(0):
                seen = np.zeros(len(model.buckets) + 1, np.uint8)
                for found in buckets(text.as_py()):
                    seen[slots[found]] = 1
                bits.append(np.packbits(seen[:-1]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bits, pa.binary())], ["toxic", "bits"])

    return pack


def _fitted(model: Model, shares: dict[int, float]):
    """Logistic regression over the packed rows of the sample, in one task of bounded size."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((bits, toxic) for batch in batches for toxic, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        bits = np.frombuffer(b"".join(b for b, _ in rows), np.uint8).reshape(len(rows), -1)
        y = np.array([t for _, t in rows], np.float64)
        weight = np.array([shares[t] for _, t in rows])
        w, constant = regression(bits, y, weight / weight.sum(), model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([(w * model.weights).tolist()]), pa.array([constant])], ["weights", "constant"])

    return solve


def regression(bits: np.ndarray, y: np.ndarray, weight: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and constant that minimise the weighted log loss plus the penalty, by quasi-Newton steps of bounded memory."""
    width = len(ratio)

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = PENALTY / 2 * float(at[:-1] @ at[:-1]), np.append(PENALTY * at[:-1], 0.0)
        scaled = (at[:-1] * ratio).astype(np.float32)
        for k in range(0, len(y), 2048):
            x = np.unpackbits(bits[k : k + 2048], axis=1, count=width).astype(np.float32)
            z = x @ scaled + at[-1]
            part, goal = weight[k : k + 2048], y[k : k + 2048]
            value += float(part @ (np.logaddexp(0.0, z) - goal * z))
            error = part * (_sigmoid(z) - goal)
            slope[:-1] += (error.astype(np.float32) @ x) * ratio
            slope[-1] += error.sum()
        return value, slope

    at = np.zeros(width + 1)
    rate = float(weight @ y)
    at[-1] = np.log(rate / (1 - rate))
    value, slope = loss(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step = _direction(slope, past)
        length, gain = 1.0 if past else min(1.0, 1.0 / np.abs(slope).sum()), float(slope @ step)
        while True:
            ahead, ahead_slope = loss(at + length * step)
            if ahead <= value + 1e-4 * length * gain or length < 1e-8:
                break
            length /= 2
        moved, turned = length * step, ahead_slope - slope
        if moved @ turned > 1e-12:
            past = [*past[-9:], (moved, turned)]
        done = value - ahead < 1e-7
        at, value, slope = at + moved, ahead, ahead_slope
        if done:
            break
    return at[:-1], float(at[-1])


def _direction(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill, bent by the curvature along the last moves."""
    step, kept = -slope, []
    for moved, turned in reversed(past):
        part = (moved @ step) / (moved @ turned)
        step = step - part * turned
        kept.append(part)
    if past:
        moved, turned = past[-1]
        step = step * ((moved @ turned) / (turned @ turned))
    for (moved, turned), part in zip(past, reversed(kept), strict=True):
        step = step + (part - (turned @ step) / (moved @ turned)) * moved
    return step


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text: the probability that it is toxic.

    A null text is an empty one, and an empty one has no n-gram of three and scores as little as the constant says. Repeated rows score
    the same, each for itself. Other columns do not matter; an empty table gives no rows.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model.slots()
        for batch in batches:
            found = pa.array([model.score(text.as_py(), slots) for text in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(rate, "doc_id long, score double")


def held_out(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Scores of all documents by a model that saw no label of those with crc32(id) divisible by ``folds``, nor of those without id.

    Returns doc_id, held_out (the remainder is 0; false without id), score and predicted (1 from one half on).
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    seen = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~out)
    rated = scores(docs, fit(seen, labels))
    return rated.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
