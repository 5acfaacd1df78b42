"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered: 0 toxic, 1 poor, 2 good. P(grade >= k) = sigmoid(w x - t_k) with one weight vector w over hashed
words, shared by all grades, and rising thresholds t_1 < t_2. A text's expected grade is the sum of the tail
probabilities; documents are selected by P(grade >= 2).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm import bytescan as b

BITS = 16
GRADES = 3
#: The model is fitted on about this many graded texts (all, if there are fewer), chosen by a hash.
SAMPLE = 8000
ROUNDS, RATE, RIDGE = 200, 0.2, 1e-4
#: Features that in each grade are in fewer texts than this, in number or as a share of the grade, are left out.
LEAST_SEEN, LEAST_SHARE = 8, 0.01
#: Least P(grade >= 2) of a selected document.
LEAST = 0.5

_letters = b.ALNUM.copy()
_letters[0x30:0x3A] = False
_digits = np.zeros(256, bool)
_digits[0x30:0x3A] = True
_marks = ~(b.SPACE | _letters | _digits)


def _hashed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each token: words in lower case (a second feature says if in capitals), marks, digits."""
    low = b.lower(data)
    rows, slots = [], []
    for kind, inside, form in ((0, _letters, low), (1, _marks, data), (2, _digits, None)):
        s, e, row = b.spans(inside[data], bounds)
        if form is None:
            h = np.minimum(e - s, 12).astype(np.uint64)
        else:
            h = b.span_hashes(form, s, e)
        rows.append(row)
        slots.append(b.mix(h + np.uint64(kind * 0x1E3779B97F4A7C15)) >> np.uint64(64 - BITS))
        if kind == 0:
            capitals = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
            loud = (capitals[e] - capitals[s] >= 2) & (2 * (capitals[e] - capitals[s]) > e - s)
            rows.append(row[loud])
            slots.append(np.full(int(loud.sum()), 1, np.uint64))
    return np.concatenate(rows), np.concatenate(slots).astype(np.int64)


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs i to j of texts: row within the run and slot of each distinct feature."""
    data, offsets = b.column(texts)
    for i, j in b.slices(offsets):
        row, slot = _hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        key = np.unique(row.astype(np.int64) << BITS | slot)
        yield i, j, key >> BITS, key & ((1 << BITS) - 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, row, slot in features(batch["text"]):
            at = np.concatenate([[0], np.searchsorted(row, np.arange(j - i), "right")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["grade"][i:j], pa.ListArray.from_arrays(at, pa.array(slot.astype(np.int32)))], ["grade", "slots"])


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, grade) of the labelled rows: toxic is 0, else quality + 1. Of several labels the lowest holds."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)
    known = labels.select(F.col("doc_id").alias("__id"), grade.alias("grade")).where("grade is not null and __id is not null").groupBy("__id").agg(F.min("grade").alias("grade"))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "grade")


def chosen(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` graded rows by a hash of the doc_id, the same at any partitioning."""
    labelled = labels.where("doc_id is not null and (toxic is not null or quality is not null)")
    share = min(1.0, sample / max(1, labelled.count()))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * float(1 << 30))
    return graded(docs, picked)


class Model:
    """Weights, thresholds, and the scale of each slot: rarer features weigh more, too rare ones nothing."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, scale: np.ndarray) -> None:
        self.weights, self.thresholds, self.scale = weights, thresholds, scale

    def values(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """Feature values: scaled, then brought to length 1 for each text."""
        value = self.scale[slot]
        return value / np.sqrt(np.maximum(np.bincount(row, value * value, n), 1e-12))[row]

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1, 2 of each text; NaN for texts without words."""
        out = np.full((len(texts), GRADES - 1), np.nan)
        for i, j, row, slot in features(texts):
            score = np.bincount(row, self.values(row, slot, j - i) * self.weights[slot], j - i)
            some = np.bincount(row, minlength=j - i) > 0
            z = score[:, None] - self.thresholds
            out[i:j][some] = (1 / (1 + np.exp(-np.clip(z, -40, 40))))[some]
        return out


def train(grades: np.ndarray, slots: list[np.ndarray]) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows, in a fixed number of rounds."""
    n, size = len(grades), 1 << BITS
    model = Model(np.zeros(size), np.array([-1.0, 0.0]), np.zeros(size))
    if not n:
        return model
    slot = np.concatenate(slots)
    row = np.repeat(np.arange(n), [len(x) for x in slots])
    seen = np.bincount(slot, minlength=size)
    by_grade = np.bincount(slot * GRADES + grades[row], minlength=size * GRADES).reshape(size, GRADES)
    known = (by_grade >= np.maximum(LEAST_SEEN, LEAST_SHARE * np.bincount(grades, minlength=GRADES))).any(axis=1)
    model.scale = np.where(known, np.sqrt(n / np.maximum(seen, 1)), 0.0)
    kept = model.scale[slot] > 0
    row, slot = row[kept], slot[kept]
    value = model.values(row, slot, n)
    used, at = np.unique(slot, return_inverse=True)
    weights = np.zeros(len(used))
    shares = np.clip([(grades >= k).mean() for k in range(1, GRADES)], 1e-3, 1 - 1e-3)
    thresholds = -np.log(shares / (1 - shares))
    mean, square, here = np.zeros(len(used) + GRADES - 1), np.zeros(len(used) + GRADES - 1), np.arange(n)
    for i in range(1, ROUNDS + 1):
        score = np.bincount(row, value * weights[at], n)
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -40, 40)))
        tail = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        slope = tail * (1 - tail)
        p = np.maximum(tail[here, grades] - tail[here, grades + 1], 1e-9)
        low, high = slope[here, grades] / p, slope[here, grades + 1] / p
        down = np.bincount(at, value * (high - low)[row], len(used)) / n + RIDGE * weights
        move = [(low * (grades == k + 1) - high * (grades == k)).sum() / n for k in range(GRADES - 1)]
        step = np.concatenate([down, move])
        mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step * step
        step = RATE * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.999**i)) + 1e-10)
        weights = weights - step[: len(used)]
        thresholds = thresholds - step[len(used) :]
        thresholds[1] = max(thresholds[1], thresholds[0] + 0.05)
    model.weights[used], model.thresholds = weights, thresholds
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from a bounded sample of graded rows; their hashed features come to the driver.

    Without graded rows the model gives every text the same middling grade.
    """
    rows = chosen(docs, labels, sample).select("text", "grade").mapInArrow(_features, "grade int, slots array<int>").toArrow()
    slots = [np.asarray(x.values.to_numpy(), np.int64) for x in rows["slots"]]
    grades = rows["grade"].to_numpy().astype(np.int64)
    order = sorted(range(len(grades)), key=lambda i: (grades[i], len(slots[i]), slots[i].tobytes()))
    return train(grades[order], [slots[i] for i in order])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least: float = LEAST) -> DataFrame:
    """The columns ``keep`` with expected_grade (0 to 2), p_ge_1, p_ge_2 and selected, for every whole text.

    Null texts and texts without words have grade 0 and are not selected.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.scale))
    rows = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    own = ", ".join(f"__{i} {rows.schema[f'__{i}'].dataType.simpleString()}" for i in range(len(keep)))
    made = "expected_grade double, p_ge_1 double, p_ge_2 double, selected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model(*shared.value)
        for batch in batches:
            tails = ready.tails(batch["__text"])
            tails[np.isnan(tails)] = 0.0
            cols = [pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(tails[:, 1] >= least)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*batch.schema.names[:-1], "expected_grade", "p_ge_1", "p_ge_2", "selected"])

    return rows.mapInArrow(run, f"{own}, {made}" if own else made).toDF(*keep, "expected_grade", "p_ge_1", "p_ge_2", "selected")


def select(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, columns as they are, that the classifier selects."""
    at = docs.columns.index("text")
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(np.nan_to_num(ready.tails(batch.column(at))[:, 1]) >= least))

    return docs.mapInArrow(run, docs.schema)
