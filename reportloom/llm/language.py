"""Language ID by words first, then shorter and shorter character n-grams.

A known word scores its log frequency in each language. An unseen word backs off: its n-grams (with word bounds) of the
longest length that the model knows any of score in its place, at a penalty for each step down.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: The model is fitted on about this many labelled texts of each language (all, if there are fewer), chosen by a hash.
SAMPLE = 4000
#: Most frequent words and n-grams of each length kept for each language.
MOST_WORDS, MOST_GRAMS = 40_000, 8_000
#: Log-probability lost with each step to shorter n-grams.
STEP = 1.0
#: Words of a text that were not seen in training are scored once and kept, up to so many.
CACHE = 200_000
_models: dict[str, Model] = {}


def letters(text: str | None) -> list[str]:
    """Runs of letters in lower case. Numerals that the pattern takes for letters (as fractions and Roman numerals) part them."""
    out = WORD.findall(text.lower()) if text else []
    if out and not text.isascii():
        out = [x for w in out for x in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return out


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, rows: list[tuple[str, int, str, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        self.known: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        tables = [{} for _ in range(LONGEST + 1)]
        totals = np.ones((LONGEST + 1, len(self.langs)))
        for lang, n, key, count in rows:
            tables[n].setdefault(key, np.zeros(len(self.langs)))[at[lang]] += count
            totals[n, at[lang]] += count
        self.scores = []
        for n, table in enumerate(tables):
            keys = sorted(table)
            self.known[n] = {k: i for i, k in enumerate(keys)}
            counts = np.stack([table[k] for k in keys]) if keys else np.zeros((0, len(self.langs)))
            self.scores.append(np.log((counts + 0.1) / (totals[n] + 0.1 * max(1, len(keys)))))
        self.unseen: dict[str, int] = {}
        self.extra = np.zeros((1024, len(self.langs)))

    def backoff(self, word: str) -> np.ndarray:
        marked = f"<{word}>"
        for n in range(LONGEST, 0, -1):
            got = [i for k in range(len(marked) - n + 1) if (i := self.known[n].get(marked[k : k + n])) is not None]
            if got:
                return self.scores[n][got].mean(axis=0) - STEP * (LONGEST + 1 - n)
        return np.zeros(len(self.langs))

    def _unseen(self, word: str) -> int:
        i = self.unseen.get(word)
        if i is None:
            i = self.unseen[word] = len(self.unseen)
            if i >= len(self.extra):
                self.extra = np.concatenate([self.extra, np.zeros_like(self.extra)])
            self.extra[i] = self.backoff(word)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the likelihood; ``und`` and 0 without a letter or without a model."""
        words = letters(text)
        if not words or not self.langs:
            return "und", 0.0
        if len(self.unseen) > CACHE:
            self.unseen.clear()
        at = np.fromiter(map(self.known[0].get, words, repeat(-1)), np.int64, len(words))
        seen = at >= 0
        total = self.scores[0][at[seen]].sum(axis=0)
        if not seen.all():
            new = [self._unseen(words[i]) for i in np.flatnonzero(~seen).tolist()]
            total = total + self.extra[new].sum(axis=0)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (length 0) and n-grams by language."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(letters(text))
        rows: list[tuple[str, int, str, int]] = []
        for lang, words in counts.items():
            rows += [(lang, 0, w, c) for w, c in words.items()]
            grams = [Counter() for _ in range(LONGEST + 1)]
            for w, c in words.items():
                marked = f"<{w}>"
                for n in range(1, LONGEST + 1):
                    for k in range(len(marked) - n + 1):
                        grams[n][marked[k : k + n]] += c
            rows += chain.from_iterable(((lang, n, g, c) for g, c in grams[n].items()) for n in range(1, LONGEST + 1))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["lang", "n", "key", "count"])


def fit(docs: DataFrame, where: Column, sample: int = SAMPLE) -> list[tuple[str, int, str, int]]:
    """Counts of the model from (doc_id, text, lang) of the labelled rows ``where`` holds.

    Texts are chosen by a hash of doc_id and text, at a rate that gives about ``sample`` texts of each language. What
    comes to the driver is bounded by the kept words and n-grams of each language.
    """
    rows = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    rate = F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, sample / v))) for k, v in sizes.items())), F.col("lang"))
    chosen = rows.where(F.pmod("h", F.lit(1 << 30)) < rate * float(1 << 30)).select("lang", "text")
    counts = chosen.mapInArrow(_counts, "lang string, n int, key string, count long").groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))
    counts = counts.where((F.col("n") > 0) | (F.col("count") > 1))
    top = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "key")))
    # n-grams and words of a bounded sample: each group is bounded with it
    kept = counts.groupBy("lang", "n").agg(top.alias("top")).select("lang", "n", F.explode(F.expr(f"slice(top, 1, if(n = 0, {MOST_WORDS}, {MOST_GRAMS}))")).alias("x"))
    return sorted((r.lang, r.n, r.key, -r.c) for r in kept.select("lang", "n", "x.key", "x.c").collect())


def _model(name: str, shared) -> Model:
    if name not in _models:
        _models.clear()
        _models[name] = Model(shared.value)
    return _models[name]


def identify(docs: DataFrame, counts: list[tuple[str, int, str, int]], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score (0 to 1); whole texts, one row per row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is all if there was nothing to learn from. Equal
    scores go to the language first in order. Repeated rows are predicted each; extra columns are not read; an empty table
    gives an empty result; a very long text is read whole.
    """
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(counts)
    rows = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    schema = ", ".join([*(f"__{i} {rows.schema[f'__{i}'].dataType.simpleString()}" for i in range(len(keep))), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name, shared)
        for batch in batches:
            got = [model.predict(x.as_py()) for x in batch["__text"]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score")
