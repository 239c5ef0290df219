"""Toxicity scores by non-negative positive-unlabelled learning.

The classifier is linear over the distinct words of a text: each word adds its own weight and those of its first four, five
and six letters, so that inflected forms of a stem share what is learned. It is trained in numpy from confirmed toxic texts (P)
and unlabelled ones (U) only. With the share pi of toxic texts, the risk of calling an unlabelled text clean-or-not is corrected
for the toxic ones hidden in U: pi * R(P as toxic) + max(0, R(U as clean) - pi * R(P as clean)). Where the corrected part
falls below zero, the model has started to memorise, and the step goes up its slope instead.

The fit uses bounded samples, MOST_TOXIC and MOST_UNLABELLED texts, the least by a hash of their ids; scoring covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import text_or_empty, written

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
MOST_TOXIC, MOST_UNLABELLED = 3000, 9000
#: A feature is used if at least this many texts of P have it, so many times the share of U that has it, by so many standard errors; these are the most features.
LEAST_TEXTS, LEAST_RATIO, LEAST_Z, MOST_FEATURES = 3, 3.0, 4.5, 50_000
STEPS, RATE, DECAY = 300, 0.1, 2e-4
CACHED_WORDS = 400_000


def features(word: str) -> list[int]:
    """64-bit codes of a lower-case word and of its first letters; the word is marked by its end."""
    parts = [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [(crc32(b := p.encode()) << 32 | crc32(b, 0x5BD1E995)) - (1 << 63) for p in parts]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def codes_of(rows: DataFrame) -> DataFrame:
    """(positive, codes) of rows with positive and text: the distinct codes of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [[c for w in words_of(t) for c in features(w)] for t in part["text"].to_pylist()]
                yield pa.record_batch({"positive": part["positive"], "codes": pa.array(own, pa.list_(pa.int64()))})

    return rows.select("positive", "text").mapInArrow(run, "positive boolean, codes array<long>")


def telling(coded: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The sorted codes that are frequent among toxic texts and more so than among unlabelled ones, counted by Spark: at most MOST_FEATURES, of the largest z."""
    counted = coded.select("positive", F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count_if("positive").alias("in_p"), F.count_if(~F.col("positive")).alias("in_u"))
    share_p, share_u, share = F.col("in_p") / n_p, F.col("in_u") / n_u, (F.col("in_p") + F.col("in_u")) / (n_p + n_u)
    z = (share_p - share_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    found = counted.filter((F.col("in_p") >= LEAST_TEXTS) & (share_p >= LEAST_RATIO * share_u)).withColumn("z", z).filter(F.col("z") >= LEAST_Z)
    return np.sort(np.array([r["code"] for r in found.orderBy(F.desc("z"), "code").limit(MOST_FEATURES).collect()], np.int64))


def places_of(coded: DataFrame, codes: np.ndarray) -> DataFrame:
    """(positive, places): where the rows' codes stand in the sorted codes, repeated as they come; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for row in batch["codes"]:
                r = np.asarray(row.values, np.int64)
                place = np.minimum(np.searchsorted(codes, r), len(codes) - 1)
                own.append(place[codes[place] == r])
            yield pa.record_batch({"positive": batch["positive"], "places": pa.array(own, pa.list_(pa.int64()))})

    return coded.mapInArrow(run, "positive boolean, places array<long>")


class Model:
    """Weights by feature code, and the bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[str, float] = {}

    def of_word(self, word: str) -> float:
        found = sum(self.weights.get(c, 0.0) for c in features(word))
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        self.cache[word] = found
        return found

    def score(self, text: str) -> float:
        known = self.cache.get
        total = self.bias
        for word in words_of(text):
            w = known(word)
            total += self.of_word(word) if w is None else w
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


Sparse = tuple[np.ndarray, np.ndarray, int]


def sparse(rows: list[np.ndarray]) -> Sparse:
    """Rows of places as (row of each entry, place of each entry, number of rows)."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), len(rows)


def risk(weights: np.ndarray, bias: float, p: Sparse, u: Sparse, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(R(P as toxic), corrected R(U as clean), gradient of prior times the first, gradient of the second), the bias last, for the logistic loss."""

    def logits(x: Sparse) -> np.ndarray:
        return np.clip(np.bincount(x[0], weights[x[1]], x[2]) + bias, -50, 50)

    def slope(x: Sparse, by: np.ndarray) -> np.ndarray:
        by = by / x[2]
        return np.append(np.bincount(x[1], by[x[0]], len(weights)), by.sum())

    zp, zu = logits(p), logits(u)
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    clean = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
    return float(np.log1p(np.exp(-zp)).mean()), float(clean), prior * slope(p, sp - 1), slope(u, su) - prior * slope(p, sp)


def step_along(toxic: np.ndarray, corrected: np.ndarray, clean: float) -> np.ndarray:
    """The gradient of the non-negative risk where the corrected part is not below zero; else the way back up its slope."""
    return toxic + corrected if clean >= 0 else -corrected


def fitted(codes: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """The linear model of least non-negative corrected risk, by full-batch Adam steps; rows are places in codes."""
    p, u = sparse(positive), sparse(unlabelled)
    weights, bias = np.zeros(len(codes)), -2.0
    first, second = np.zeros(len(codes) + 1), np.zeros(len(codes) + 1)
    for step in range(1, STEPS + 1):
        _, clean, toxic, corrected = risk(weights, bias, p, u, prior)
        gradient = step_along(toxic, corrected, clean)
        gradient[:-1] += DECAY * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model({int(c): float(w) for c, w in zip(codes, weights, strict=True) if abs(w) > 1e-3}, float(bias))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows never learned from: CRC-32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Fits on rows that are not held out; the constant model if there are no toxic texts, no others, or no telling features.

    The prior is the share of toxic texts in the whole corpus. Where none is given it is that among the labelled rows, which is right
    if they are a random sample; labels collected otherwise need a prior from elsewhere. Unlabelled are the texts without a label, or,
    where all have one, all texts, their labels unread. Rows that share an id count as one, of its least text.
    """
    constant = Model({}, -4.0)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] if prior is None else prior
    if not share or share >= 1:
        return constant
    order = F.xxhash64("doc_id")
    ids = known.filter("toxic = 1").select("doc_id").distinct().orderBy(order).limit(MOST_TOXIC).withColumn("positive", F.lit(True))
    open_ids = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    least = lambda rows: rows.orderBy(order).limit(MOST_UNLABELLED).withColumn("positive", F.lit(False))
    wanted = written(ids.unionByName(least(open_ids.join(known.select("doc_id"), "doc_id", "left_anti"))), "sample")
    if not wanted.filter("not positive").limit(1).count():
        wanted = written(ids.unionByName(least(open_ids)), "sample")
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(wanted), "doc_id")  # at most MOST_TOXIC + MOST_UNLABELLED ids
    coded = written(codes_of(rows.groupBy("doc_id", "positive").agg(F.min("text").alias("text"))), "coded")
    n_p, n_u = coded.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    codes = telling(coded, n_p, n_u) if n_p and n_u else ()
    if not len(codes):
        return constant
    positive, unlabelled = [], []
    for row in places_of(coded, codes).toLocalIterator():
        (positive if row[0] else unlabelled).append(np.array(row[1], np.int64))
    return fitted(codes, positive, unlabelled, float(share))


def toxicity_scores(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from a score of 0.5).

    Needs doc_id and text, labels' doc_id and toxic (1, 0 or null); other columns are ignored. A null text is empty and gets
    the score of the bias alone, as does every text if there are no toxic or no unlabelled rows to learn from. Repeated rows
    get the same score each; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(t.as_py()) for t in batch["text"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
