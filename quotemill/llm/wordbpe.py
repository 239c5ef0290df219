"""Cached encoding of whole texts with a tokenizer file of the `tokenizers` library."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

#: A character beyond those that need no normalising but lower case, or that not all libraries take for white space.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\u017f]")
#: Normaliser and pre-tokenizer under which a text's ids are those of the pattern's matches in its lower case, one after the other.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
#: Pieces whose ids a worker keeps.
CACHED_PIECES = 500_000


def usual_pieces() -> re.Pattern[str]:
    """WORDWISE's pattern for texts of usual characters, with the classes of letters and numbers written out."""
    kinds = {k: "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == k) for k in "LN"}
    return re.compile(WORDWISE["split"].replace("[\\p{L}]", f"[{kinds['L']}]").replace("[\\p{N}]", f"[{kinds['N']}]").replace("\\p{L}\\p{N}", kinds["L"] + kinds["N"]))


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for every byte: itself if it is printable, else the next letter from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def id_width(path: str) -> int:
    """Bytes that hold any id of the vocabulary: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


@lru_cache(maxsize=2)
def encoder(path: str, width: int = 4) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned numbers of so many bytes, without special tokens.

    Strings of the file's added tokens in a text become those tokens, as the library does by default. Where the file's normaliser
    and pre-tokenizer are WORDWISE, a piece between its cuts is encoded once and kept. Texts that may hold an added token or hold
    unusual characters are encoded whole by the library, as are all texts under other rules.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    code = "H" if width == 2 else "I"

    def whole(texts: list[str]) -> list[bytes]:
        return [array(code, x.ids).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    if rules["normalizer"] != WORDWISE["normalizer"] or steps[0].get("pattern") != {"Regex": WORDWISE["split"]} or rules["post_processor"] or any(t["normalized"] for t in rules["added_tokens"]):
        return whole

    model, letters, pieces_of = tokenizer.model, byte_letters(), usual_pieces().findall
    marks = {t["content"][:2] for t in rules["added_tokens"]}
    known: dict[str, bytes] = {}

    def learn(pieces: list[str]) -> None:
        for piece in set(pieces).difference(known):
            known[piece] = array(code, [x.id for x in model.tokenize("".join(map(letters.__getitem__, piece.encode())))]).tobytes()

    def encoded(text: str) -> bytes:
        if UNUSUAL.search(text) or any(m in text for m in marks):
            return whole([text])[0]
        pieces = pieces_of(text.lower())
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > CACHED_PIECES:
                known.clear()
            learn(pieces)
            return b"".join(map(known.__getitem__, pieces))

    return lambda texts: list(map(encoded, texts))
