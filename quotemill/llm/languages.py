"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram's vector binds those of its letters: each is permuted, by a rotation of as many
places as letters follow, and they are multiplied entry by entry. A text is the bundle (sum) of its n-grams' vectors, a language the bundle of
the texts known to be in it, and a text's language is that of the greatest cosine.

Texts are read in lower case; all between letters, with their marks, counts as one gap, which is a letter of its own. Bundles are sums of whole
numbers, so that no order of rows or tasks changes them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, WIDTH, SEED = 3, 2048, 20_011
UNKNOWN = "und"
#: Characters whose n-grams are counted at once; a longer text is read in blocks of that size.
BLOCK = 1 << 20
#: n-grams whose vectors are made at once.
GRAMS = 4096
#: Letters whose vectors a worker keeps.
KEPT_LETTERS = 20_000
#: Documents with this remainder are held out of learning.
HELD_OUT = 0


@lru_cache(maxsize=1)
def symbols() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its letter or mark in lower case, 0 for all others; and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    lower = np.zeros(0x110000, np.uint32)
    for c, kind in enumerate(kinds):
        if kind in "LM":
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
    return lower, np.array([k == "L" for k in kinds])


def has_letter(points: np.ndarray) -> bool:
    return bool(symbols()[1][points].any())


def gram_blocks(points: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams of a text's code points, as numbers of 21 bits a letter, with a gap before and after the text."""
    lower = symbols()[0]
    before = np.zeros(1, np.uint64)
    for at in range(0, len(points) + 1, BLOCK):
        block = lower[points[at : at + BLOCK]].astype(np.uint64)
        if at + BLOCK > len(points):
            block = np.append(block, np.uint64(0))
        block = np.concatenate([before, block])
        block = block[np.concatenate([[True], (block[1:] != 0) | (block[:-1] != 0)])]
        grams = np.zeros(max(0, len(block) - GRAM + 1), np.uint64)
        for k in range(GRAM):
            grams = (grams << np.uint64(21)) | block[k : k + len(grams)]
        yield grams
        before = block[-(GRAM - 1) :]


class Space:
    """The letters' vectors, made from the letter's number alone, so that all workers have the same."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.vectors = np.zeros((64, WIDTH), np.int8)

    def places(self, letters: np.ndarray) -> np.ndarray:
        if len(self.place) > KEPT_LETTERS:
            self.place.clear()
        for c in letters.tolist():
            if c not in self.place:
                k = self.place[c] = len(self.place)
                if k == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[k] = np.random.Generator(np.random.Philox(key=[SEED, c])).integers(0, 2, WIDTH, dtype=np.int8) * 2 - 1
        return np.array([self.place[c] for c in letters.tolist()], np.int64)

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """A vector for each n-gram."""
        out = None
        for k in range(GRAM):
            letters, which = np.unique((grams >> np.uint64(21 * (GRAM - 1 - k))) & np.uint64((1 << 21) - 1), return_inverse=True)
            turned = np.roll(self.vectors[self.places(letters)], GRAM - 1 - k, axis=1)[which]
            out = turned if out is None else out * turned
        return out


@lru_cache(maxsize=1)
def space() -> Space:
    return Space()


def bundles(texts: list[np.ndarray]) -> np.ndarray:
    """A row for each text, given as code points: the sum of its n-grams' vectors. Whole numbers below 2^53, so exact."""
    out = np.zeros((len(texts), WIDTH))
    owners, grams = [], []
    for k, points in enumerate(texts):
        for block in gram_blocks(points):
            if len(points) > BLOCK:
                block, times = np.unique(block, return_counts=True)
                _add(out, np.full(len(block), k), block, times)
            else:
                owners.append(np.full(len(block), k))
                grams.append(block)
    if grams:
        found, which = np.unique(np.concatenate(grams), return_inverse=True)
        pairs, times = np.unique(np.concatenate(owners) * len(found) + which, return_counts=True)
        _add(out, pairs // len(found), found[pairs % len(found)], times)
    return out


def _add(out: np.ndarray, owner: np.ndarray, grams: np.ndarray, times: np.ndarray) -> None:
    """Adds to row owner so many times the vector of each n-gram, by matrix products over some thousand n-grams."""
    order = np.argsort(grams, kind="stable")
    owner, grams, times = owner[order], grams[order], times[order]
    found, first = np.unique(grams, return_index=True)
    edges = np.append(first, len(grams))
    for at in range(0, len(found), GRAMS):
        part = found[at : at + GRAMS]
        low, high = edges[at], edges[min(at + GRAMS, len(found))]
        counts = np.zeros((len(out), len(part)), np.float32)
        counts[owner[low:high], np.searchsorted(part, grams[low:high])] = times[low:high]
        out += counts @ space().bound(part).astype(np.float32)


def _points(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32) if text.is_valid else np.zeros(0, np.uint32)


def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A batch in runs of rows of at most BLOCK characters together, or of one longer text, with the texts' code points."""
    begin, texts, size = 0, [], 0
    for k, text in enumerate(batch["text"]):
        points = _points(text)
        if texts and (size + len(points) > BLOCK or len(texts) == 512):
            yield batch.slice(begin, k - begin), texts
            begin, texts, size = k, [], 0
        texts.append(points)
        size += len(points)
    if texts:
        yield batch.slice(begin), texts


def held_out() -> Column:
    """Whether a document is held out: the CRC-32 of its id as text leaves no remainder by 5. Null ids are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == HELD_OUT, F.lit(False))


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """The bundle of each language over all documents to learn from: each task bundles its own rows, Spark adds the bundles up.

    What comes to the driver is WIDTH numbers a language, whatever the number of documents.
    """
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, texts in parts(batch):
                langs, found = np.array(rows["lang"].to_pylist(), object), bundles(texts)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0.0) + found[langs == lang].sum(axis=0)
        for lang, total in sums.items():
            yield pa.record_batch({"lang": pa.array([lang]), "sums": pa.array([total.astype(np.int64).tolist()], pa.list_(pa.int64()))})

    each = known.mapInArrow(run, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("place", "value"))
    found: dict[str, np.ndarray] = {}
    for r in each.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r.lang, np.zeros(WIDTH))[r.place] = r.value
    return {lang: v for lang, v in sorted(found.items()) if v.any()}


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Needs doc_id, text and lang; other columns are ignored. lang is read to learn from rows that are not held out, and never to predict. The
    score is the cosine with the language's bundle, 0 if that is negative. A null text, or one without a letter, is UNKNOWN with score 0, as are
    all if no row has a language to learn from. Equal cosines go to the first language by name. Repeated rows stay and, like any copies,
    weigh in their language's bundle as often as they occur. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learned = prototypes(docs)
    names = np.array([*learned, UNKNOWN], object)
    profiles = np.array([v / np.linalg.norm(v) for v in learned.values()]).reshape(-1, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parts(batch):
                own = bundles(texts)
                cosines = own @ profiles.T / np.maximum(np.linalg.norm(own, axis=1), 1e-300)[:, None]
                known = np.array([has_letter(t) for t in texts]) & bool(learned)
                best = cosines.argmax(axis=1) if learned else np.zeros(len(texts), int)
                scores = np.clip(cosines[np.arange(len(texts)), best], 0, 1) if learned else np.zeros(len(texts))
                yield pa.record_batch({
                    "doc_id": rows["doc_id"],
                    "held_out": rows["held_out"],
                    "lang_pred": pa.array(names[np.where(known, best, len(learned))], pa.string()),
                    "score": pa.array(np.where(known, scores, 0.0)),
                })

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)
