"""Alignment of two tokenizers over the same texts, and corpus-wide counts of linked tokens.

A is a byte-level BPE file of the `tokenizers` library, B a sentencepiece file; both read a space and the text. The ends of A's and of B's tokens
together cut the bytes into elementary intervals, each of which has one owner on either side: every interval is one overlap, so one link. Ends that
both share close a group. Texts of a batch are laid end to end, so one union and two searches serve all of them.

Each row's distinct linked id pairs are written once; Spark counts them over the corpus; a second pass over the small pairs, not the texts, meets
every row with the counts. At most KNOWN_PAIRS of the commonest pairs are broadcast. All others are joined by a shuffle, in which none of
them can be hot, since as many pairs as are broadcast occur more often.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import written
from quotemill.llm.wordbpe import byte_letters

#: Characters of texts that are aligned at once; a longer text is aligned alone.
CHUNK = 1 << 20
KNOWN_PAIRS = 1 << 21
#: Pairs a task counts before it hands them on.
PAIRS_HELD = 1 << 22
#: Classes of counts, so many to a doubling, by which the broadcast pairs are told from the others.
CLASSES = 8
SPACE = "▁"
#: The cut of texts under the pre-tokenizer "ByteLevel".
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places where B's texts may be cut, after so many characters: no piece of B holds a space after another character.
CUT, RUN = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])"), 100

Encode = Callable[[list[str]], list[np.ndarray]]


@lru_cache(maxsize=2)
def byte_level(path: str) -> tuple[Encode, list[bytes]]:
    """Encodes texts with a byte-level BPE file, special tokens' strings as plain text; and each id's bytes.

    Where the file's order of merges is that of its ids and every token is the merge of its own bytes, merging the pair of the least id
    gives the same tokens, and tiktoken does that over the file's own vocabulary; other files are left to their own library.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    back = {letter: byte for byte, letter in byte_letters().items()}
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    added = {t["id"] for t in rules["added_tokens"]}
    by_id = {i: t for t, i in tokenizer.get_vocab().items()}
    spelled = [b"" if i in added or i not in by_id else bytes(map(back.__getitem__, by_id[i])) for i in range(max(by_id) + 1)]

    def library(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int64) for x in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    pre, model = rules["pre_tokenizer"] or {}, rules["model"]
    plain = rules["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model.get("dropout") is None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    in_order = [model["vocab"][a + b] for a, b in merges]
    if not plain or in_order != sorted(in_order) or any([x.id for x in tokenizer.model.tokenize(t)] != [i] for i, t in by_id.items() if i not in added):
        return library, spelled

    import tiktoken

    encode = tiktoken.Encoding("of-file", pat_str=BYTE_LEVEL, mergeable_ranks={spelled[i]: i for i in by_id if i not in added}, special_tokens={}).encode_ordinary
    return lambda texts: [np.array(encode(" " + t), np.int64) for t in texts], spelled


@lru_cache(maxsize=2)
def piece_level(path: str) -> tuple[Encode, list[bytes]]:
    """Encodes texts with a sentencepiece file, which puts the space before them; and each id's bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)

    def runs(text: str) -> list[str]:
        out, at = [], 0
        while cuts and (found := CUT.search(text, at + RUN)):
            out.append(text[at : found.start()])
            at = found.end()
        return [*out, text[at:]]

    def encode(texts: list[str]) -> list[np.ndarray]:
        cut = [runs(t) for t in texts]
        ids = iter(model.encode(list(chain.from_iterable(cut)), num_threads=1))
        return [np.fromiter(chain.from_iterable(next(ids) for _ in c), np.int64) for c in cut]

    return encode, spelled


@dataclass
class Side:
    """One tokenizer: its encoder, each id's bytes and their number, and each id as decimal digits before any of three marks."""

    encode: Encode
    spelled: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(b) for b in self.spelled], np.int64)
        self.digits = {mark: np.array([f"{i}{mark}".encode() for i in range(len(self.spelled))]) for mark in ",|;"}

    def tokens(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode(texts)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    return Side(*byte_level(a_path)), Side(*piece_level(b_path))


@dataclass
class Aligned:
    """Tokens of texts laid end to end: for each token its group, for each link its tokens' places, for each text where they begin."""

    a: np.ndarray
    b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def aligned(a: list[np.ndarray], b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Aligns texts' tokens. The tokens of either side of a text have the same bytes in all, so its end is shared; each token has a byte at least."""
    starts_a, starts_b = (np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in (a, b))
    all_a, all_b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (a, b))
    ends_a, ends_b = np.cumsum(sizes_a[all_a]), np.cumsum(sizes_b[all_b])
    ends = np.union1d(ends_a, ends_b)  # each interval ends at one of these
    link_a, link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)  # the tokens that own it
    shared = ends[(ends_a[link_a] == ends) & (ends_b[link_b] == ends)] if len(ends) else ends
    return Aligned(all_a, all_b, starts_a, starts_b, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b), link_a, link_b)


def written_groups(x: Aligned, a: Side, b: Side) -> list[bytes]:
    """For each text `a1,a2|b1;a3|b2,b3`: the ids of its groups."""
    last_a = np.append(x.group_a[1:] != x.group_a[:-1], True)[: len(x.a)]
    last_b = np.append(x.group_b[1:] != x.group_b[:-1], True)[: len(x.b)]
    width = max(a.digits[","].itemsize, b.digits[","].itemsize)
    out = np.zeros(len(x.a) + len(x.b), f"S{width}")
    out[np.arange(len(x.a)) + np.searchsorted(x.group_b, x.group_a)] = np.where(last_a, a.digits["|"][x.a], a.digits[","][x.a])
    out[np.arange(len(x.b)) + np.searchsorted(x.group_a, x.group_b, "right")] = np.where(last_b, b.digits[";"][x.b], b.digits[","][x.b])
    edges = (x.starts_a + x.starts_b).tolist()
    return [out[i:j].tobytes().replace(b"\0", b"")[:-1] for i, j in zip(edges, edges[1:], strict=False)]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in runs of rows of some CHUNK characters together, or of one longer text."""
    begin, texts, size = 0, [], 0
    for k, value in enumerate(batch["text"]):
        text = value.as_py() or ""
        if texts and size + len(text) > CHUNK:
            yield batch.slice(begin, k - begin), texts
            begin, texts, size = k, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield batch.slice(begin), texts


def _both(texts: list[str], a: Side, b: Side) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both sides' tokens of texts; none for a text that is empty or that a side's tokens do not spell."""
    none = np.zeros(0, np.int64)
    out_a, out_b = [], []
    for text, own_a, own_b in zip(texts, a.tokens(texts), b.tokens(texts), strict=True):
        spelled = f" {text}".encode()
        sound = bool(text) and a.bytes_of(own_a) == spelled and b.bytes_of(own_b) == spelled
        out_a.append(own_a if sound else none)
        out_b.append(own_b if sound else none)
    return out_a, out_b


def _packed(values: np.ndarray, edges: np.ndarray, kind: type) -> pa.Array:
    """A binary for each run between edges: its values as little-endian numbers."""
    return pa.array([part.tobytes() for part in np.split(values.astype(kind), edges[1:-1])], pa.binary())


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_products long, groups_sha256 string, steps binary, times binary"


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, counts and digest of every row's groups, and its distinct linked pairs: steps between their numbers in order, and how often each is linked.

    A pair's number is A's id times the size of B's vocabulary plus B's id. n_products counts the pairs of an A and a B token of one group, linked or not.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        for batch in batches:
            for part, texts in _texts(batch):
                x = aligned(*_both(texts, a, b), a.sizes, b.sizes)
                n = len(texts)
                owner_a, owner_b = (np.repeat(np.arange(n), np.diff(s)) for s in (x.starts_a, x.starts_b))
                groups = int(x.group_a[-1]) + 1 if len(x.a) else 0
                count_a, count_b = np.bincount(x.group_a, minlength=groups), np.bincount(x.group_b, minlength=groups)
                of_group = owner_a[np.searchsorted(x.group_a, np.arange(groups))]
                numbers, times = np.unique(owner_a[x.link_a] * _bound(a, b) + x.a[x.link_a] * len(b.spelled) + x.b[x.link_b], return_counts=True)
                owner, numbers = np.divmod(numbers, _bound(a, b))
                edges = np.searchsorted(owner, np.arange(n + 1))
                steps = np.diff(numbers, prepend=0)
                steps[edges[:-1][np.diff(edges) > 0]] = numbers[edges[:-1][np.diff(edges) > 0]]
                yield pa.record_batch({
                    "doc_id": part["doc_id"],
                    "n_a": pa.array(np.diff(x.starts_a)),
                    "n_b": pa.array(np.diff(x.starts_b)),
                    "n_groups": pa.array(np.bincount(of_group, minlength=n)),
                    "n_links": pa.array(np.bincount(owner_a[x.link_a], minlength=n)),
                    "n_products": pa.array(np.bincount(of_group, weights=count_a * count_b, minlength=n).astype(np.int64)),
                    "groups_sha256": pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in written_groups(x, a, b)]),
                    "steps": _packed(steps, edges, np.uint64 if _bound(a, b) >> 32 else np.uint32),
                    "times": _packed(times, edges, np.uint32),
                })

    return rows.mapInArrow(run, ALIGNED)


def _bound(a: Side, b: Side) -> int:
    return len(a.spelled) * len(b.spelled)


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and times of all pairs of a batch's rows."""
    times = [np.frombuffer(t, np.uint32) for t in batch["times"].to_pylist()]
    sizes = [len(t) for t in times]
    numbers = [np.cumsum(np.frombuffer(s, np.uint64 if 8 * k == len(s) else np.uint32), dtype=np.int64) for s, k in zip(batch["steps"].to_pylist(), sizes, strict=True)]
    none = np.zeros(0, np.int64)
    return np.repeat(np.arange(len(times)), sizes), np.concatenate([none, *numbers]), np.concatenate([none, *times]).astype(np.int64)


def _runs(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    numbers, where = np.unique(np.concatenate(pairs), return_inverse=True)
    return numbers, np.bincount(where, weights=np.concatenate(times), minlength=len(numbers)).astype(np.int64)


def pair_counts(stored: DataFrame, b_size: int) -> DataFrame:
    """(pair, b_id, n) of every linked pair: how many links of the corpus hold it. Each task adds its own up before they are dealt by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, size = [], [], 0
        for batch in batches:
            for part in _runs(batch):
                _, numbers, own = _pairs(part)
                pairs.append(numbers)
                times.append(own)
                size += len(numbers)
                if size > PAIRS_HELD:
                    numbers, own = _summed(pairs, times)
                    if len(numbers) > PAIRS_HELD // 2:
                        yield pa.record_batch({"pair": numbers, "n": own})
                        numbers, own = numbers[:0], own[:0]
                    pairs, times, size = [numbers], [own], len(numbers)
        if size:
            numbers, own = _summed(pairs, times)
            yield pa.record_batch({"pair": numbers, "n": own})

    counted = stored.select("steps", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counted.select("pair", (F.col("pair") % b_size).cast("int").alias("b_id"), "n")


def _marked(counts: DataFrame) -> DataFrame:
    """counts with best: whether a pair's count is the highest of its B id. The highest counts are a row for each id of the vocabulary."""
    highest = counts.groupBy("b_id").agg(F.max("n").alias("highest"))
    return counts.join(F.broadcast(highest), "b_id").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _commonest(marked: DataFrame, most: int) -> int:
    """The least count from which on there are at most so many pairs, as the lower end of a class of counts; 1 if all pairs are that few."""
    kind = F.floor(F.log2("n") * CLASSES).cast("int")
    cut, total = None, 0
    for r in marked.groupBy(kind.alias("kind")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("kind")).collect():
        total += r.pairs
        if total > most:
            return cut if cut is not None else r.least + (1 << 62)
        cut = r.least
    return 1


def token_links(docs: DataFrame, a_path: str, b_path: str, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_products and groups_sha256 of every row.

    Needs doc_id and text; other columns are ignored. A text that is null or empty, or that the tokens of A or of B do not spell after a space
    (U+2581 in it, for one), has no tokens: zeros and an empty digest. Special tokens' strings in texts are plain text. Repeated rows and null ids stay,
    and their links count as often as they occur; ties for a B id's highest count all count as best. An empty table gives no rows. A text is
    aligned whole, which takes some 60 bytes a character.
    """
    b_size = len(piece_level(b_path)[1])
    stored = written(alignments(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "alignments")
    marked = written(_marked(written(pair_counts(stored, b_size), "pair-counts")), "marked-pairs")
    cut = _commonest(marked, known_pairs)
    head = marked.filter(F.col("n") >= cut).toArrow().sort_by("pair")
    pairs, counts, best = (head[c].to_numpy() for c in ("pair", "n", "best"))
    known = docs.sparkSession.sparkContext.broadcast((pairs, counts, best))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_products", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for batch in batches:
            for part in _runs(batch):
                row, numbers, times = _pairs(part)
                at = np.minimum(np.searchsorted(pairs, numbers), max(0, len(pairs) - 1))
                found = pairs[at] == numbers if len(pairs) else np.zeros(len(numbers), bool)
                n_best, count_sum = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                np.add.at(count_sum, row[found], counts[at[found]] * times[found])
                np.add.at(n_best, row[found], best[at[found]] * times[found])
                rest = ~found
                edges = np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=part.num_rows))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(edges, pa.array(v[rest])) for v in (numbers, times)]
                yield pa.record_batch({**{c: part[c] for c in [*plain, "row"]}, "n_best": n_best, "count_sum": count_sum, "pairs": lists[0], "times": lists[1]})

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_products long, groups_sha256 string, row long, n_best long, count_sum long, pairs array<long>, times array<long>"
    met = stored.mapInArrow(run, kinds)
    if cut > 1:
        met = _with_rare(written(met, "met-rows"), marked.filter(F.col("n") < cut))
    return met.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_products", "groups_sha256")


def _with_rare(met: DataFrame, rare: DataFrame) -> DataFrame:
    """met with the counts of the pairs that were not broadcast."""
    links = met.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(rare, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    more = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
    kept = [c for c in met.columns if c not in ("n_best", "count_sum", "pairs", "times")]
    return met.join(sums, "row", "left").select(*kept, more("n_best", F.col("more_best")), more("count_sum", F.col("more_sum")))
