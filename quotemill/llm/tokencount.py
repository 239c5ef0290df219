"""Counts of unigram tokens without making the tokens: Viterbi over vocabulary matches that carries only score and count.

An Aho-Corasick automaton of the vocabulary gives all pieces that end at each place of a word; dynamic programming keeps for
each place the best score and the number of pieces of that best segmentation. Ties go as in the tokenizer: paths are extended
from left to right, and a later start replaces an earlier one only if it scores strictly more. A character that no piece
covers alone is an unknown of the least score minus 10. Where the vocabulary has a piece for every byte, an unknown counts as the bytes of its UTF-8 form;
else neighbouring unknowns count as one token.

As in the usual set-up of such vocabularies, a space becomes the mark U+2581, one is put before the text, and words are cut
before each mark; pieces never cross a cut, so words are counted once and kept in a bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import text_or_empty

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 500_000
#: Characters of a word from which it is not cached.
LONG_WORD = 64


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces and scores of a sentencepiece file, without control and byte pieces, the first entry being the unknown; and whether it has a piece for every byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    falls_back = sum(map(model.is_byte, range(model.get_piece_size()))) == 256
    normal = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [("<unk>", 0.0), *((model.id_to_piece(i), model.get_score(i)) for i in normal)], falls_back


class Counter:
    """Counts tokens of texts for a list of (piece, score) whose first entry is the unknown; unknowns count as their bytes if they fall back to them."""

    def __init__(self, pieces: list[tuple[str, float]], falls_back: bool = False):
        import ahocorasick

        self.falls_back = falls_back
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces[1:]:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known = {p for p, _ in pieces[1:] if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        """Best segmentation's number of tokens of a word that no cut divides."""
        n = len(word)
        if self.known.issuperset(word):  # no unknowns: matches come by end, then longest first, so in the order of the ties
            best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
            best[0] = 0.0
            for end, (length, score) in self.automaton.iter(word):
                end += 1
                total = best[end - length] + score
                if total > best[end]:
                    best[end], count[end] = total, count[end - length] + 1
            return count[n]
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, (length, score) in self.automaton.iter(word):
                matches[end].append((length, score))
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        ends_unknown = [False] * (n + 1)
        for end in range(1, n + 1):
            top, number, unknown, alone = None, 0, False, False
            for length, score in matches[end - 1]:  # longest first, so by start
                alone |= length == 1
                total = best[end - length] + score
                if top is None or total > top:
                    top, number, unknown = total, count[end - length] + 1, False
            if not alone:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    more = len(word[end - 1].encode()) if self.falls_back else not ends_unknown[end - 1]
                    top, number, unknown = total, count[end - 1] + more, True
            best[end], count[end], ends_unknown[end] = top, number, unknown
        return count[n]

    def of_text(self, text: str) -> int:
        total, cache = 0, self.cache
        if not text:
            return 0
        first, *words = text.split(" ")
        if first.startswith(SPACE):  # no mark is put before one
            total += sum(map(self.of_word, pieces_at_marks(first)))
        elif first:
            words.append(first)
        for word in words:
            number = cache.get(word)
            if number is None:
                number = sum(map(self.of_word, pieces_at_marks(SPACE + word)))
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                if len(word) < LONG_WORD:
                    cache[word] = number
            total += number
        return total


def pieces_at_marks(word: str) -> list[str]:
    """A word cut before each space mark in it, of which texts may hold some of their own."""
    parts = word.split(SPACE)
    return [p for p in [parts[0]] if p] + [SPACE + p for p in parts[1:]]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(*vocabulary(path))


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and n_tokens of every row, by the unigram vocabulary in a sentencepiece file.

    Needs doc_id and text; other columns are ignored. Null and empty texts have no tokens; repeated rows stay repeated; an empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).of_text
        for batch in batches:
            numbers = [count(t.as_py()) for t in batch["text"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_tokens": pa.array(numbers, pa.int64())})

    return rows.mapInArrow(run, "doc_id long, n_tokens long")
