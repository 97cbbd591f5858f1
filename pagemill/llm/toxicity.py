"""Toxicity by a classifier chain of linear models trained with out-of-fold predictions.

The label table flags toxic documents only, so two auxiliary categories are derived from it for the chain: `dense`
(toxic, and toxic terms per word above the median of the toxic rows) and `severe` (toxic, with at least four toxic
terms). The chain predicts dense, then severe, then toxic: each later model also gets the probabilities of the earlier
categories. In training these are out-of-fold predictions, so a later model learns from what an earlier one will say
of unseen text; for scoring each model is refitted on all training rows.

Features are the presence of words and of their first three to six letters (inflected forms share a stem). A term is
one if it speaks for toxicity with a log-likelihood gain of GAIN or more; there is no limit on how many. Terms and
derived categories are chosen anew inside each fold, from the other folds' rows alone, so the out-of-fold predictions
have seen nothing of the rows they are for. Terms are counted by fold and class in Spark, where the gains are taken too;
the driver gets the chosen terms and, by training row, the numbers of those it holds. Training takes a sample of at most
`sample` labelled rows, those with the smallest hash of the id; scoring reads every whole text and needs no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, slices

CATEGORIES = ("dense", "severe", "toxic")
#: Labelled rows used for training at most, and the least gain of a term: its toxic rows times the log of its odds.
SAMPLE, GAIN = 20_000, 8.0
FOLDS = 5
#: Different terms counted before a task hands its counts on.
COUNTED = 50_000
LETTERS = re.compile(r"[^\W\d_]+")


def _of_word(word: str) -> Iterator[str]:
    """A word of three letters or more, marked with $, and its stems."""
    if len(word) > 2:
        yield word + "$"
        for n in range(3, min(7, len(word))):
            yield word[:n]


def terms(text: str) -> set[str]:
    """Distinct terms of a text, lower case."""
    return {t for w in set(LETTERS.findall(text.lower())) for t in _of_word(w)}


def _probability(odds):
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class Chain:
    terms: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)  # by category: terms, earlier categories, intercept

    def __post_init__(self) -> None:
        self._known: dict[str, tuple[int, ...]] = {}

    def present(self, text: str) -> list[int]:
        """Indexes of the chain's terms in a text."""
        found: set[int] = set()
        known, get = self._known, self.terms.get
        for w in set(LETTERS.findall(text.lower())):
            at = known.get(w)
            if at is None:
                at = tuple(i for t in _of_word(w) if (i := get(t)) is not None)
                if len(known) >= 100_000:
                    known.clear()
                if len(w) < 40:
                    known[w] = at
            if at:
                found.update(at)
        return sorted(found)

    def probabilities(self, text: str) -> list[float]:
        if not self.weights:
            return [0.0] * len(CATEGORIES)
        at = self.present(text)
        out: list[float] = []
        for w in self.weights:
            n = len(w) - 1 - len(out)
            out.append(float(_probability(w[-1] + w[at].sum() + sum(a * b for a, b in zip(w[n:-1], out, strict=True)))))
        return out


@dataclass
class Cells:
    """Which of n rows holds which of k terms, as parallel arrays."""

    row: np.ndarray
    term: np.ndarray
    n: int
    k: int

    def part(self, rows: np.ndarray, terms: np.ndarray) -> Cells:
        """The rows and terms marked, numbered anew."""
        own = rows[self.row] & terms[self.term]
        return Cells((np.cumsum(rows) - 1)[self.row[own]], (np.cumsum(terms) - 1)[self.term[own]], int(rows.sum()), int(terms.sum()))

    def odds(self, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.term], self.n) + extra @ w[self.k : -1] + w[-1]

    def back(self, extra: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.term, r[self.row], self.k), extra.T @ r, [r.sum()]])


def _fit(cells: Cells, extra: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Logistic regression with an L2 penalty by accelerated gradient descent."""
    weights = np.zeros(cells.k + extra.shape[1] + 1)
    probe = np.ones_like(weights)
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = cells.back(extra, cells.odds(extra, probe))
        size = np.linalg.norm(probe)
        probe /= max(size, 1e-12)
    step = 1 / (0.25 * size / cells.n + penalty)
    ahead, last = weights.copy(), weights
    for t in range(steps):
        gradient = cells.back(extra, _probability(cells.odds(extra, ahead)) - y) / cells.n + penalty * np.append(ahead[:-1], 0)
        weights = ahead - step * gradient
        ahead = weights + t / (t + 3) * (weights - last)
        last = weights
    return weights


def _targets(cells: Cells, n_words: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    """The three categories of training rows, by the terms chosen for them."""
    hits = np.bincount(cells.row, minlength=cells.n)
    density = hits / np.maximum(n_words, 1)
    middle = np.median(density[toxic]) if toxic.any() else 0.0
    return [y.astype(float) for y in (toxic & (density > middle), toxic & (hits >= 4), toxic)]


def fit_chain(cells: Cells, n_words: np.ndarray, toxic: np.ndarray, fold: np.ndarray, names: list[str], sets: np.ndarray) -> Chain:
    """sets: by term, whether it is chosen without fold 0, 1, ... and (last) from all rows.

    No toxic or no other rows: a chain that calls nothing toxic.
    """
    if not 0 < toxic.sum() < len(toxic):
        return Chain({})
    every, chosen = np.ones(cells.n, bool), sets[:, FOLDS]
    full = cells.part(every, chosen)
    targets = _targets(full, n_words, toxic)
    parts = []
    for f in range(FOLDS):
        train, test = fold != f, fold == f
        if train.any() and test.any():
            own = cells.part(train, sets[:, f])
            parts.append((train, test, own, cells.part(test, sets[:, f]), _targets(own, n_words[train], toxic[train])))
    chain = Chain({names[i]: j for j, i in enumerate(np.flatnonzero(chosen))})
    extra = np.empty((cells.n, 0))
    for c, y in enumerate(targets):
        chain.weights.append(_fit(full, extra, y))
        out = np.zeros(cells.n)
        for train, test, own, held, wanted in parts:
            out[test] = _probability(held.odds(extra[test], _fit(own, extra[train], wanted[c], steps=200)))
        extra = np.column_stack([extra, out])
    return chain


def _gain(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """A term's gain by the rows of both classes that hold it; 0 below three rows or five times the base rate."""
    times = (pos + 0.5) / max(n_pos, 1) / ((neg + 0.5) / max(n_neg, 1))
    return F.when((pos >= 3) & (times > 5), pos * F.log(times)).otherwise(0.0)


def _counted(rows: DataFrame, only) -> DataFrame:
    """term and n0, n1, ...: the rows of each fold that hold it; by its number among those of `only`, if that is given."""
    kind = pa.string() if only is None else pa.int32()

    def told(names, folds, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(folds, pa.int32()), pa.array(n, pa.int64())], names=["term", "fold", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((t, fold) for t in terms(text))
                if len(seen) >= COUNTED:
                    yield told([t for t, _ in seen], [f for _, f in seen], list(seen.values()))
                    seen.clear()
        yield told([t for t, _ in seen], [f for _, f in seen], list(seen.values()))

    def count_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(only.value)
        counts = np.zeros((FOLDS, len(chain.terms)), np.int64)
        for batch in batches:
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[fold, chain.present(text)] += 1
        folds, at = np.nonzero(counts)
        yield told(at.astype(np.int32), folds.astype(np.int32), counts[folds, at])

    run, schema = (count, "term string, fold int, n bigint") if only is None else (count_only, "term int, fold int, n bigint")
    counted = rows.select("__text", "__fold").mapInArrow(run, schema)
    return counted.groupBy("term").agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(FOLDS)])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fits the chain on at most `sample` rows of labels (doc_id, toxic) that have a text.

    Rows with a null id or label are ignored; of repeated ids the largest label counts, and each text of the id is a
    row. What reaches the driver is bounded by the sample: its ids and the chosen terms, never texts.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    chosen = chosen.withColumn("__hash", F.xxhash64("doc_id")).orderBy("__hash", "doc_id").limit(sample)
    chosen = chosen.withColumn("__fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    texts = docs.where("text is not null").select(F.col("doc_id"), F.col("text").alias("__text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "__text", "__toxic", "__fold")  # bounded by `sample`
    sizes = {(r["__fold"], r["__toxic"] == 1): r["n"] for r in rows.groupBy("__fold", (F.col("__toxic") == 1).cast("int").alias("__toxic")).agg(F.count("*").alias("n")).collect()}

    def gain(without: int | None, neg: Callable[[int], Column]) -> Column:
        own = [f for f in range(FOLDS) if f != without]
        pos, others = (sum((n(f) for f in own), F.lit(0)) for n in (lambda f: F.col(f"n{f}"), neg))
        return _gain(pos, others, *(sum(sizes.get((f, y), 0) for f in own) for y in (True, False)))

    # terms that would gain enough if no other row held them, and then what the other rows say of these
    most = F.greatest(*[gain(f, lambda _: F.lit(0)) for f in [*range(FOLDS), None]])
    toxic = cut(_counted(rows.where("__toxic = 1"), None).where(most >= GAIN))
    hopeful = [r["term"] for r in toxic.select("term").orderBy("term").collect()]  # of the toxic rows of `sample`
    if not hopeful:
        return Chain({})
    only = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(hopeful)})
    others = _counted(rows.where("__toxic <> 1"), only).select(F.col("term").alias("number"), *[F.col(f"n{f}").alias(f"m{f}") for f in range(FOLDS)])
    numbered = docs.sparkSession.createDataFrame(pa.table({"number": pa.array(range(len(hopeful)), pa.int32()), "name": hopeful}))
    both = toxic.join(numbered, F.col("term") == F.col("name")).join(others, "number", "left").fillna(0, [f"m{f}" for f in range(FOLDS)])
    sets = F.array(*[gain(f, lambda k: F.col(f"m{k}")) >= GAIN for f in [*range(FOLDS), None]])
    found = both.select("term", sets.alias("sets")).where(F.array_contains("sets", True)).orderBy("term").collect()
    only.unpersist()
    if not found:
        return Chain({})
    names = [r["term"] for r in found]
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(shared.value)
        for batch in batches:
            at, size = [], []
            for text in batch.column(1).to_pylist():
                at.append(np.array(own.present(text), dtype=np.int32).tobytes())
                size.append(len(LETTERS.findall(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(at, pa.binary()), pa.array(size, pa.int64())], names=["doc_id", "toxic", "fold", "terms", "words"])

    got = rows.mapInArrow(describe, "doc_id bigint, toxic int, fold int, terms binary, words bigint").toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])
    held = got["terms"].to_pylist()
    row = np.repeat(np.arange(len(held)), [len(x) // 4 for x in held])
    cells = Cells(row, np.frombuffer(b"".join(held), np.int32).astype(np.int64), len(held), len(names))
    return fit_chain(cells, got["words"].to_numpy(), got["toxic"].to_numpy() == 1, got["fold"].to_numpy(), names, np.array([r["sets"] for r in found]))


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The input with p_dense, p_severe, p_toxic (double) added; a null or empty text scores as one without terms."""
    names = [f"p_{c}" for c in CATEGORIES]
    source = docs.drop(*[c for c in names if c in docs.columns])
    at = source.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((chain.terms, chain.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*shared.value)
        for batch in batches:
            for part in slices(batch, batch.schema.names[at], 4 << 20):
                p = np.array([own.probabilities(x or "") for x in part.column(at).to_pylist()]).reshape(-1, len(CATEGORIES))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p[:, k]) for k in range(len(CATEGORIES)))], names=[*part.schema.names, *names])

    schema = StructType([*source.schema.fields, *(StructField(name, DoubleType()) for name in names)])
    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """`docs` with the probabilities and `is_toxic` (p_toxic >= threshold); one row per row, repeated rows each.

    A probability equal to the threshold is toxic. Input columns named p_dense, p_severe, p_toxic or is_toxic are
    replaced.
    """
    return score(docs, train(docs, labels, sample)).withColumn("is_toxic", F.col("p_toxic") >= threshold)
