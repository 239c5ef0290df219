"""Quality rules whose cutoffs come from labelled holdouts with an exact guarantee against rejecting good documents.

A few signals are measured on every whole text. A rule rejects a text whose signal exceeds its cutoff; the cutoffs of all rules
move together along a path, step t setting each to its reference value times scale t, from lenient to strict. In every stratum
the steps are tested in that order: step t is certified while the exact binomial tail probability of seeing so few rejections
among the stratum's good holdout texts, were the true rate of false rejection above the allowed one, stays below the level.
Testing a fixed order until the first failure needs no correction within a stratum; the level is divided among the strata
(Bonferroni). So with probability 1 - delta no stratum loses more than the allowed share of its good documents. Among the
certified steps the one is taken that rejects most bad texts net of good ones, the more lenient on ties. A stratum without
enough holdout rejects nothing beyond the base rule.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import text_or_empty, unused, written

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated.
WINDOW = 8

#: Reference cutoff of each rule: a share of the text's words, lines or characters.
REFERENCE = {"symbols": 0.1, "marks": 0.5, "capitals": 0.3, "repeats": 0.3, "repeated_lines": 0.5, "word_length": 20.0}
#: The path of scales, from lenient to strict.
SCALES = tuple(round(4.0 * 0.85**k, 4) for k in range(26))
#: Largest share of good documents that may be rejected in a stratum, and the probability that this fails anywhere.
RISK, DELTA = 0.01, 0.05

@lru_cache(maxsize=1)
def upper_case() -> np.ndarray:
    """Whether each code point is an upper-case letter."""
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def n_capitals(text: str) -> int:
    return int(np.count_nonzero(upper_case()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, badness double"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """How many words lie in windows of so many words that occur at least twice. Exact: windows are numbered, not hashed.

    The window length must be a power of two: windows of 2n words are pairs of windows of n words.
    """
    if len(words) <= window:
        return 0
    number: dict[str, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    size = 1
    while size < window:
        pairs = rank[:-size] * len(words) + rank[size:]
        if len(pairs) == 0:
            return 0
        rank = np.unique(pairs, return_inverse=True)[1]
        seen = np.bincount(rank)
        if len(seen) == len(rank):
            return 0
        size *= 2
    starts = np.flatnonzero(seen[rank] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int, float]:
    """The five base counts of a text and its badness: the largest signal in units of its rule's reference."""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    doubles = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return 0, 0, symbols, 0, 0, 0.0
    capitals = n_capitals(text)
    signals = {
        "symbols": symbols / n,
        "marks": (text.count("!") + text.count("?")) / n,
        "capitals": capitals / chars,
        "repeats": repeats / n,
        "repeated_lines": doubles / len(lines),
        "word_length": chars / n,
    }
    return n, chars, symbols, doubles, repeats, max(signals[k] / REFERENCE[k] for k in REFERENCE)


def measured(docs: DataFrame) -> DataFrame:
    """docs with the columns MEASURED in place of text, beside doc_id, stratum and text_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(zip(*map(measures, batch["text"].to_pylist()), strict=True)) or [[]] * 6
            columns = dict(zip((*COUNTS, "badness"), values, strict=True))
            yield pa.record_batch({"doc_id": batch["doc_id"], "stratum": batch["stratum"], "text_key": batch["text_key"]} | {k: pa.array(v, pa.float64() if k == "badness" else pa.int64()) for k, v in columns.items()})

    return docs.mapInArrow(run, f"doc_id long, stratum string, text_key long, {MEASURED}")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exact."""
    if k >= n:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    total = 0.0
    for i in range(k + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
    return min(1.0, total)


def chosen_scale(good: list[int], bad: list[int], n_good: int, risk: float, level: float) -> int | None:
    """The step to take, given how many good and bad holdout texts every step rejects; None if not even the first is certified."""
    best, gain = None, None
    for step, (g, b) in enumerate(zip(good, bad, strict=True)):
        if n_good == 0 or binomial_tail(g, n_good, risk) > level:
            break
        if gain is None or b - g > gain:
            best, gain = step, b - g
    return best


def cutoffs(signals: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, n_good, scale): the certified scale of each stratum with labelled texts; null where none is.

    signals has doc_id, stratum, text_key, badness and base_failed; labels has doc_id and quality (1 good, 0 bad, null none). The
    holdout is every labelled text that passes the base rule, each distinct text once per stratum, so that copies do not count
    as independent; a text that any label calls good is good. The result has one row per stratum.
    """
    held = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality is not null and doc_id is not null")
    rows = held.join(signals.filter("not base_failed"), "doc_id").groupBy("stratum", "text_key").agg(F.max("quality").alias("good"), F.first("badness").alias("badness"))
    steps = [F.count_if((F.col("good") == g) & (F.col("badness") > s)).alias(f"{name}_{i}") for name, g in (("good", 1), ("bad", 0)) for i, s in enumerate(SCALES)]
    counted = rows.groupBy("stratum").agg(F.count_if(F.col("good") == 1).alias("n_good"), F.array(*steps[: len(SCALES)]).alias("good"), F.array(*steps[len(SCALES) :]).alias("bad"))
    counted = written(counted, "holdout")
    strata = max(1, counted.count())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [chosen_scale(r["good"], r["bad"], r["n_good"], risk, delta / strata) for r in rows]
            scale = [None if f is None else SCALES[f] for f in found]
            yield pa.record_batch({"stratum": pa.array([r["stratum"] for r in rows], pa.string()), "n_good": pa.array([r["n_good"] for r in rows], pa.int64()), "scale": pa.array(scale, pa.float64())})

    return counted.mapInArrow(choose, "stratum string, n_good long, scale double")


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: doc_id, the five counts, base_failed, stratum, badness, scale, kept.

    Needs doc_id, text and the stratum's column (here lang); other columns are ignored. A null text has no words. A text fails
    the base rule with fewer than 20 words, or if over 30 % of its words lie in repeated windows of 8. Others are kept unless
    their badness exceeds their stratum's certified scale; where there is none (no or few labels, a stratum that no label has)
    they are kept. A null stratum is the stratum "". Repeated rows get the same verdict each; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text_or_empty().alias("text"))
    signals = written(with_base(measured(rows.withColumn("text_key", F.xxhash64("text")))), "signals")
    table = cutoffs(signals, labels, risk, delta)
    judged = signals.join(table, "stratum", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("badness") > F.col("scale"), F.lit(False))
    return judged.select("doc_id", *COUNTS, "base_failed", "stratum", "badness", "scale", kept.alias("kept"), "text_key")


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the verdict keeps, all columns as they are, whatever their names.

    Nulls, repeated rows and empty tables count as in quality_verdicts; rows that agree in id, text and stratum stay or go together.
    """
    mine = {name: unused(name, docs.columns) for name in ("key_id", "key_stratum", "key_text")}
    verdicts = quality_verdicts(docs, labels, stratum, risk, delta).filter("kept")
    keys = verdicts.select(F.col("doc_id").alias(mine["key_id"]), F.col("stratum").alias(mine["key_stratum"]), F.col("text_key").alias(mine["key_text"]))
    here = F.coalesce(docs[stratum].cast("string"), F.lit(""))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(mine["key_id"])) & (F.xxhash64(text_or_empty()) == F.col(mine["key_text"])) & (here == F.col(mine["key_stratum"]))
    return docs.join(keys, same, "left_semi")


def with_base(signals: DataFrame) -> DataFrame:
    return signals.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
