"""Benchmark decontamination: every passage of every document queries a BM25 inverted index of the test items.

Index terms are pairs of adjacent words, so that a chance passage meets few postings. Term frequencies over all items and the
items' lengths are counted by Spark, so an item's weights do not depend on how the index is cut. Scores are shares of an
item's score against itself; a passage retrieves, by weak-AND with block maxima, every item of a share above the threshold.
Items are indexed by classes of length; passages overlap so far that any run of words as long as the longest item of the class
lies whole in one of them. What is retrieved is then verified: the words of the item's question and of its answer, aligned with
the passage's surroundings, must be covered each; a short part is also sought word by word beside the other one, so that a
label or a changed word between them hides nothing.

An index of at most BROADCAST_WORDS words is broadcast and read in one pass over the documents. A larger one is cut into blocks
and passages are routed to them: a table of fixed size with the largest weight of any term under a hash tells which passages can
reach the threshold at all; only these are shuffled, by their terms to the blocks in which they can reach it, and searched there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import node_of, spread_join, text_or_empty, unused, written

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Share of an item's own score from which a passage retrieves it.
THRESHOLD = 0.5
#: Share of the question's and of the answer's words that must be covered, by runs of at least MIN_RUN words.
COVERED, MIN_RUN = 0.6, 3
#: Longest question or answer, in words, that one changed word can leave uncovered by such runs; and the words that may lie between it and the other part.
SHORT, BESIDE = math.ceil(MIN_RUN / (1 - COVERED)) - 1, 50
#: Postings under one block maximum.
POSTINGS = 32
#: Most words of all items that are broadcast as one index; beyond, the words of one block, and the passages that one task searches in it.
BROADCAST_WORDS, BLOCK_WORDS, PASSAGES = 2_000_000, 500_000, 5_000
#: Slots of the table of largest weights, a broadcast of eight bytes each.
SLOTS = 1 << 22
#: Longest item, in words, of each length class; longer ones double it.
SHORTEST_CLASS = 64

HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


@dataclass(frozen=True)
class Item:
    item_id: int
    words: tuple[str, ...]
    question: int  # its first words; the others are the answer


def parsed(item_id: int, text: str) -> Item:
    """The answer is the last line, if there are several with words; else there is none."""
    lines = [w for line in text.lower().split("\n") if (w := WORD.findall(line))]
    words = tuple(w for line in lines for w in line)
    return Item(item_id, words, len(words) - (len(lines[-1]) if len(lines) > 1 else 0))


def reach_of(length_class: int) -> int:
    """Words of the longest item of a class."""
    return SHORTEST_CLASS << length_class


class Index:
    """Items of one length class: postings of word pairs with their shares of the items' own scores, and maxima over runs of postings."""

    def __init__(self, items: list[Item], shares: list[dict[tuple[str, str], float]], reach: int):
        self.items, self.reach = items, reach
        vocabulary = sorted({w for i in items for w in i.words})
        self.word = {w: k for k, w in enumerate(vocabulary)}
        self.base = len(vocabulary) + 1
        postings: dict[int, list[tuple[int, float]]] = {}
        for k, own in enumerate(shares):
            for t, x in own.items():
                postings.setdefault(self.word[t[0]] * self.base + self.word[t[1]], []).append((k, x))
        self.terms = np.array(sorted(postings), np.int64)
        self.lists = [postings[t] for t in self.terms.tolist()]
        self.most = np.array([max(x for _, x in own) for own in self.lists])
        self.blocks = [[(own[min(at + POSTINGS, len(own)) - 1][0], max(x for _, x in own[at : at + POSTINGS])) for at in range(0, len(own), POSTINGS)] for own in self.lists]

    def codes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.word.get, words, repeat(self.base - 1)), np.int64, len(words))

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms (numbers in self.terms) reaches the threshold: document-at-a-time."""
        cursors = [[self.lists[t][0][0], t, 0, 0] for t in terms]  # item, term, posting, block
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += self.most[c[1]]
                if bound >= threshold - 1e-12:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            reach, top = None, 0.0
            for c in cursors[: pivot + 1]:  # maxima of the blocks in which the item would lie
                blocks = self.blocks[c[1]]
                while c[3] < len(blocks) and blocks[c[3]][0] < item:
                    c[3] += 1
                if c[3] < len(blocks):
                    end, largest = blocks[c[3]]
                    top += largest
                    reach = end if reach is None else min(reach, end)
            if top < threshold - 1e-12:
                past = min([reach if reach is not None else item, *(c[0] - 1 for c in cursors[pivot + 1 : pivot + 2])])
                target = max(past, item) + 1
            elif cursors[0][0] == item:
                score = sum(self.lists[c[1]][c[2]][1] for c in cursors[: pivot + 1])
                if score >= threshold - 1e-12:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            rest = cursors[pivot + 1 :]
            for c in cursors[: pivot + 1]:
                own, at = self.lists[c[1]], c[2]
                while at < len(own) and own[at][0] < target:
                    at += 1
                if at < len(own):
                    rest.append([own[at][0], c[1], at, c[3]])
            cursors = rest
        return found

    def search(self, words: list[str]) -> dict[int, tuple[float, float, float]]:
        """item_id: (score, question overlap, answer overlap) of the best passage, for every item that some passage retrieves and that is verified."""
        best: dict[int, tuple[float, float, float]] = {}
        if len(words) < 2:
            return best
        code = self.codes(words)
        pair = code[:-1] * self.base + code[1:]
        at = np.searchsorted(self.terms, pair)
        at[at == len(self.terms)] = 0
        known = np.flatnonzero(self.terms[at] == pair)
        if not len(known):
            return best
        term = at[known]
        total = np.concatenate([[0.0], np.cumsum(self.most[term])])
        for start, lo, hi in zip(*passages(len(words), self.reach, known), strict=True):
            if total[hi] - total[lo] >= THRESHOLD - 1e-9:
                self.query(np.unique(term[lo:hi]), surroundings(words, start, self.reach), best)
        return best

    def query(self, terms: np.ndarray, near: list[str], best: dict[int, tuple[float, float, float]]) -> None:
        """Adds the items that a passage of these distinct terms retrieves and its surroundings verify."""
        for number, score in self.wand(terms.tolist(), THRESHOLD):
            item = self.items[number]
            question, answer = overlap(item, near)
            if question >= COVERED and answer >= COVERED:
                best[item.item_id] = max((score, question, answer), best.get(item.item_id, (0.0, 0.0, 0.0)))


def passages(n_words: int, reach: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all passages of twice the reach, each as far from the next as the reach, and which of the sorted places lie in each."""
    starts = np.arange(0, max(1, n_words - reach), reach)
    return starts, np.searchsorted(places, starts), np.searchsorted(places, starts + 2 * reach)


def surroundings(words: list[str], start: int, reach: int) -> list[str]:
    return words[max(0, start - reach) : start + 3 * reach]


def runs(part: tuple[str, ...], words: list[str], least: int) -> list[tuple[int, int, int]]:
    """(place in part, place in words, size) of the common runs of at least so many words, in order."""
    return [m for m in SequenceMatcher(None, part, words, autojunk=False).get_matching_blocks() if m.size >= max(1, least)]


def overlap(item: Item, words: list[str]) -> tuple[float, float]:
    """Shares of the question's and of the answer's words that are covered, in order; 1 for a part without words.

    Words are covered by common runs. As a single changed word or a label can leave a part of at most SHORT words no run, such a
    part is also covered word by word, by the words of a window of twice its length within BESIDE words of the other part.
    """
    hit = np.zeros(len(item.words), bool)
    for at, _, size in runs(item.words, words, min(MIN_RUN, len(item.words))):
        hit[at : at + size] = True
    question, answer = hit[: item.question], hit[item.question :]
    found = (float(question.mean()) if len(question) else 1.0), (float(answer.mean()) if len(answer) else 1.0)
    if 0 < item.question < len(item.words) and min(found) < 1:
        found = max([found, *beside(item.words[: item.question], item.words[item.question :], words)], key=lambda x: (min(x), sum(x)))
    return found


def beside(question: tuple[str, ...], answer: tuple[str, ...], words: list[str]) -> Iterator[tuple[float, float]]:
    """Shares of question and answer at every place where one is covered and the other, a short one, is sought beside it."""
    if len(answer) <= SHORT:
        reach = BESIDE + 2 * len(answer)
        for _, end, share in (places_of_short if len(question) <= SHORT else places_of_long)(question, words):
            yield share, max((a for start, _, a in places_of_short(answer, words[end : end + reach]) if start <= BESIDE), default=0.0)
    elif len(question) <= SHORT:
        reach = BESIDE + 2 * len(question)
        for start, _, share in places_of_long(answer, words):
            before = words[max(0, start - reach) : start]
            yield max((q for _, end, q in places_of_short(question, before) if len(before) - end <= BESIDE), default=0.0), share


def places_of_short(part: tuple[str, ...], words: list[str]) -> Iterator[tuple[int, int, float]]:
    """(start, end, share) of every place that covers the part word by word, in order, in a window of twice its length."""
    for start, word in enumerate(words):
        if word not in part:
            continue
        row, most, end = [0] * (len(part) + 1), 0, start
        for k, w in enumerate(words[start : start + 2 * len(part)], start + 1):  # the longest common subsequence
            diagonal = 0
            for j, p in enumerate(part, 1):
                diagonal, row[j] = row[j], diagonal + 1 if p == w else max(row[j], row[j - 1])
            if row[-1] > most:
                most, end = row[-1], k
        if most >= COVERED * len(part):
            yield start, end, most / len(part)


def places_of_long(part: tuple[str, ...], words: list[str]) -> Iterator[tuple[int, int, float]]:
    """(start, end, share) of every place that covers the part by runs; where copies lie apart, the words before and after are searched too."""
    todo = [(0, len(words))]
    while todo:
        low, high = todo.pop()
        own = runs(part, words[low:high], MIN_RUN)
        share = sum(size for *_, size in own) / len(part)
        if share < COVERED:
            continue
        apart = [y[1] for x, y in zip(own, own[1:], strict=False) if y[1] - x[1] - (y[0] - x[0]) > len(part) // 2]  # runs of another copy
        end = low + own[-1][1] + own[-1][2]
        yield low + own[0][1], end, share
        todo += [(low, low + (apart[-1] if apart else own[0][1])), (end, high)]


def weighted_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, question, length_class, terms, shares) of every item with words: its distinct pairs of words and their BM25 weights as shares of its own score.

    Document frequencies and the mean length are over all distinct items. An item of one word has no terms.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [i for x, t in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True) if (i := parsed(x, t)).words]
            classes = [max(0, math.ceil(math.log2(len(i.words) / SHORTEST_CLASS))) for i in items]
            yield pa.record_batch({"item_id": pa.array([i.item_id for i in items], pa.int64()), "words": pa.array([i.words for i in items], pa.list_(pa.string())), "question": pa.array([i.question for i in items], pa.int32()), "length_class": pa.array(classes, pa.int32())})

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).filter("item_id is not null").distinct()
    items = rows.mapInArrow(parse, "item_id long, words array<string>, question int, length_class int")
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    n_words = F.size("words")
    pairs = F.when(n_words > 1, F.transform(F.sequence(F.lit(1), n_words - 1), lambda k: F.concat_ws(" ", F.get("words", k - 1), F.get("words", k))))
    terms = written(items.select("item", F.explode(pairs).alias("term")).groupBy("item", "term").agg(F.count("*").alias("f")).withColumn("f", F.col("f").cast("double")), "terms")
    frequency = written(terms.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    lengths = terms.groupBy("item").agg(F.count("*").alias("own"))
    n, total = lengths.agg(F.count("*"), F.sum("own")).first()
    n, mean = n or 1, (total or 1) / (n or 1)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = spread_join(terms, frequency, "term", "df", total or 0).join(lengths, "item")
    scored = scored.withColumn("impact", idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("own") / mean)))
    own = scored.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("term", "impact"))).alias("own"))  # one item's terms
    score = F.aggregate("own", F.lit(0.0), lambda s, x: s + x["impact"])
    own = own.select("item", F.transform("own", lambda x: x["term"]).alias("terms"), score.alias("score"), "own")
    own = own.select("item", "terms", F.transform("own", lambda x: x["impact"] / F.col("score")).alias("shares"))
    return written(items.join(own, "item", "left").drop("item"), "weighted")


def index_of(rows: list[dict], reach: int) -> Index:
    """The index of weighted items with terms, of one length class."""
    rows = sorted(rows, key=lambda r: (r["item_id"], r["words"]))
    items = [Item(r["item_id"], tuple(r["words"]), r["question"]) for r in rows]
    return Index(items, [dict(zip((tuple(t.split(" ")) for t in r["terms"]), r["shares"], strict=True)) for r in rows], reach)


class Searcher:
    """All items at once: an index for each length class, and the items of one word, found where a document is that word."""

    def __init__(self, rows: list[dict]):
        classes: dict[int, list[dict]] = {}
        self.lone: dict[str, set[int]] = {}
        for r in rows:
            if r["terms"]:
                classes.setdefault(r["length_class"], []).append(r)
            else:
                self.lone.setdefault(r["words"][0], set()).add(r["item_id"])
        self.indexes = [index_of(own, reach_of(c)) for c, own in sorted(classes.items())]

    def search(self, text: str) -> list[tuple[int, float, float, float]]:
        words = WORD.findall(text.lower())
        found = dict.fromkeys(self.lone.get(words[0], ()), (1.0, 1.0, 1.0)) if len(words) == 1 else {}
        for index in self.indexes:
            for item, hit in index.search(words).items():
                found[item] = max(hit, found.get(item, hit))
        return [(i, *x) for i, x in sorted(found.items())]


def hit_batch(hits: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    columns = list(zip(*hits, strict=True)) or [()] * 5
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, score (the best passage's, 1 for the item itself), overlaps.

    Needs doc_id and text, item_id and text; other columns are ignored. Words are runs of letters, digits and underscores in
    lower case. An item of one word is found in documents that are this word and no more; items without words, and those with a null
    id or text, are never found; null texts hold none. Items that share an id are one item, found where any of its texts is. Repeated
    documents give repeated rows. Either table being empty gives no rows.
    """
    items = weighted_items(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    if n_words(items) > broadcast_words:
        return routed(rows, items).drop("text_key")
    sent = docs.sparkSession.sparkContext.broadcast(Searcher([r.asDict() for r in items.toLocalIterator()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield hit_batch([(d, *hit) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for hit in sent.value.search(t)])

    return rows.mapInArrow(run, HITS)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """docs without the rows in which some item is found, all columns as they are, whatever their names.

    Items and words count as in contaminated. Rows with null texts hold no item and stay, rows with null ids count like others;
    repeated rows stay or go together. An empty benchmark leaves all rows; an empty table gives none.
    """
    items = weighted_items(benchmark)
    if n_words(items) > broadcast_words:
        found = routed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), items)
        mine = {name: unused(name, docs.columns) for name in ("hit_id", "hit_text")}
        keys = found.select(F.col("doc_id").alias(mine["hit_id"]), F.col("text_key").alias(mine["hit_text"])).distinct()
        same = docs["doc_id"].cast("long").eqNullSafe(F.col(mine["hit_id"])) & (node_of(text_or_empty()) == F.col(mine["hit_text"]))
        return docs.join(keys, same, "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(Searcher([r.asDict() for r in items.toLocalIterator()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not t or not sent.value.search(t) for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def n_words(items: DataFrame) -> int:
    return items.agg(F.sum(F.size("words"))).first()[0] or 0


def slots_of(words: list[str], slots: int) -> np.ndarray:
    """The slot of every pair of adjacent words, as slot_of gives it."""
    code = np.fromiter(map(crc32, [w.encode() for w in words]), np.int64, len(words))
    return (code[:-1] * 31 + code[1:]) % slots


def slot_of(term: F.Column, slots: int) -> F.Column:
    return (F.crc32(F.substring_index(term, " ", 1).cast("binary")) * 31 + F.crc32(F.substring_index(term, " ", -1).cast("binary"))) % slots


def routed(rows: DataFrame, items: DataFrame, block_words: int | None = None) -> DataFrame:
    """As contaminated, and text_key, for an index of any size."""
    block_words = block_words or BLOCK_WORDS
    spark, slots = rows.sparkSession, SLOTS
    termed = items.filter("terms is not null")
    postings = termed.select("item_id", "length_class", F.explode(F.arrays_zip("terms", "shares")).alias("p")).select("item_id", "length_class", F.col("p.terms").alias("term"), F.col("p.shares").alias("share"))
    most = np.zeros(slots)
    for batch in postings.groupBy(slot_of(F.col("term"), slots).alias("slot")).agg(F.max("share").alias("share")).toArrow().to_batches():  # at most slots rows
        most[batch["slot"].to_numpy()] = batch["share"].to_numpy()
    classes = {r["length_class"]: r["words"] for r in termed.groupBy("length_class").agg(F.sum(F.size("words")).alias("words")).collect()}  # one row for each doubling of length
    sent = spark.sparkContext.broadcast(most)
    reaches = {c: reach_of(c) for c in sorted(classes)}

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, doc_id, key, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text_key", "text")), strict=True):
                words = WORD.findall(text.lower())
                if len(words) == 1:
                    out.append((row, doc_id, key, -1, 0, words, words))
                if len(words) < 2:
                    continue
                weight = sent.value[slots_of(words, slots)]
                known = np.flatnonzero(weight)
                total = np.concatenate([[0.0], np.cumsum(weight[known])])
                for c, reach in reaches.items():
                    for start, lo, hi in zip(*passages(len(words), reach, known), strict=True):
                        if total[hi] - total[lo] >= THRESHOLD - 1e-9:
                            terms = sorted({f"{words[k]} {words[k + 1]}" for k in known[lo:hi].tolist()})
                            out.append((row, doc_id, key, c, int(start), terms, surroundings(words, start, reach)))
            strings = pa.list_(pa.string())
            kinds = {"row": pa.int64(), "doc_id": pa.int64(), "text_key": pa.binary(), "length_class": pa.int32(), "start": pa.int64(), "terms": strings, "near": strings}
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds.values(), strict=True)], names=list(kinds))

    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", node_of(F.col("text")).alias("text_key"), "text")
    queries = written(keyed.mapInArrow(reachable, "row long, doc_id long, text_key binary, length_class int, start long, terms array<string>, near array<string>"), "queries")

    parts = F.create_map(*[F.lit(x) for c, words in classes.items() for x in (c, max(1, -(-words // block_words)))]) if classes else F.lit(None)
    block = F.pmod(F.xxhash64("item_id"), parts[F.col("length_class")]).cast("int") if classes else F.lit(0)
    blocks = termed.withColumn("block", block)
    lists = postings.withColumn("block", block).groupBy("term", "length_class", "block").agg(F.max("share").alias("share"))
    lists = lists.groupBy("term").agg(F.collect_list(F.struct("length_class", "block", "share")).alias("blocks"))
    asked = written(queries.filter("length_class >= 0").select("row", "length_class", "start", F.explode("terms").alias("term")), "asked")
    lists = written(asked.groupBy("term").agg(F.count("*").alias("n")).join(lists, "term"), "lists")
    met = spread_join(asked, lists, "term", "n", asked.count()).select("row", "length_class", "start", F.explode("blocks").alias("b")).filter(F.col("b.length_class") == F.col("length_class"))
    met = met.groupBy("row", "length_class", "start", "b.block").agg(F.sum("b.share").alias("most")).filter(F.col("most") >= THRESHOLD - 1e-9)
    wanted = written(met.drop("most").join(queries, ["row", "length_class", "start"]), "wanted")
    at = ("length_class", "block", "task")
    fullest = wanted.groupBy("length_class", "block").count().agg(F.max("count")).first()[0] or 0
    dealt = wanted.withColumn("task", F.pmod(F.xxhash64("row", "start"), F.lit(max(1, -(-fullest // PASSAGES)))).cast("int"))
    there = blocks.join(dealt.select(*at).distinct(), ["length_class", "block"])  # a block goes to each task that asks it
    there = there.select("item_id", "words", "question", "terms", "shares", *[F.col(c).alias(f"own_{c}") for c in at])

    def search(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows or not own.num_rows:
            return pa.Table.from_batches([routed_batch([])])
        index = index_of(own.to_pylist(), reach_of(own["own_length_class"][0].as_py()))
        out = []
        for q in asked.select(["row", "doc_id", "text_key", "terms", "near"]).to_pylist():
            pairs = [index.word[a] * index.base + index.word[b] for a, b in (t.split(" ") for t in q["terms"]) if a in index.word and b in index.word]
            place = np.searchsorted(index.terms, pairs)
            terms = np.unique([p for p, code in zip(place.tolist(), pairs, strict=True) if p < len(index.terms) and index.terms[p] == code]).astype(np.int64)
            best: dict[int, tuple[float, float, float]] = {}
            index.query(terms, q["near"], best)
            out += [(q["row"], q["text_key"], q["doc_id"], i, *x) for i, x in best.items()]
        return pa.Table.from_batches([routed_batch(out)])

    hits = dealt.groupBy(*at).cogroup(there.groupBy(*[f"own_{c}" for c in at])).applyInArrow(search, f"row long, text_key binary, {HITS}")
    lone = items.filter("terms is null").select("item_id", F.get("words", F.lit(0)).alias("word")).distinct()
    one = F.lit(1.0)
    exact = queries.filter("length_class = -1").select("row", "text_key", "doc_id", F.get("near", F.lit(0)).alias("word")).join(lone, "word")
    hits = hits.unionByName(exact.select("row", "text_key", "doc_id", "item_id", one.alias("score"), one.alias("question_overlap"), one.alias("answer_overlap")))
    best = hits.groupBy("row", "doc_id", "text_key", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best"))
    return written(best.select("doc_id", "item_id", "best.*", "text_key"), "hits")


def routed_batch(hits: list[tuple]) -> pa.RecordBatch:
    row, key = [h[0] for h in hits], [h[1] for h in hits]
    rest = hit_batch([h[2:] for h in hits])
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, pa.binary()), *rest.columns], names=["row", "text_key", *rest.schema.names])
