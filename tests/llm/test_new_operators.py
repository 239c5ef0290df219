"""Language profiles, tokenizer alignment and whitening against plain versions, with the rows that every operator must take."""

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm import alignment, languages, queries, whitening
from tests.llm.test_operators import ODD, none_of, odd, prose  # noqa: F401 - odd is a fixture

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# ---- 11: language profiles


def plain_bundle(text):
    """Letter by letter, gram by gram."""
    symbols = [0]
    for c in text or "":
        kind = unicodedata.category(c)[0]
        code = (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if kind in "LM" else 0
        if code or symbols[-1]:
            symbols.append(code)
    if symbols[-1]:
        symbols.append(0)
    letter = lambda c: np.random.Generator(np.random.Philox(key=[languages.SEED, c])).integers(0, 2, languages.WIDTH, dtype=np.int8) * 2 - 1
    total = np.zeros(languages.WIDTH)
    for i in range(len(symbols) - languages.GRAM + 1):
        bound = np.ones(languages.WIDTH)
        for k in range(languages.GRAM):
            bound = bound * np.roll(letter(symbols[i + k]), languages.GRAM - 1 - k)
        total += bound
    return total


TEXTS = ["", "a", "1 2 3", "The cat, the hat.", "É日本 🙂 x", "áb", "İı ß ſ", "x" * 50, "..a..b..", prose(30, 3)]


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def test_bundles_are_the_sums_of_bound_letters():
    got = languages.bundles([points(t) for t in TEXTS])
    for text, row in zip(TEXTS, got, strict=True):
        assert (row == plain_bundle(text)).all(), text


def test_bundles_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    whole = languages.bundles([points(t) for t in TEXTS])
    for block in (1, 2, 3, 7, 17):
        monkeypatch.setattr(languages, "BLOCK", block)
        assert (languages.bundles([points(t) for t in TEXTS]) == whole).all()
    monkeypatch.setattr(languages, "GRAMS", 5)
    monkeypatch.setattr(languages, "KEPT_LETTERS", 3)
    assert (languages.bundles([points(t) for t in TEXTS]) == whole).all()


def plain_predictions(rows):
    learned = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and (i is None or zlib.crc32(str(i).encode()) % 5):
            learned[lang] = learned.get(lang, 0) + plain_bundle(text)
    learned = {k: v for k, v in sorted(learned.items()) if v.any()}
    out = []
    for i, text, _ in rows:
        own = plain_bundle(text)
        if not learned or not any(c.isalpha() for c in text or ""):
            out.append((i, "und", 0.0))
            continue
        cosine = {k: float(own @ v / np.linalg.norm(own) / np.linalg.norm(v)) for k, v in learned.items()}
        best = max(cosine, key=lambda k: round(cosine[k], 9))
        out.append((i, best, min(1, max(0.0, cosine[best]))))
    return out


def tongue(letters, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(n))


def test_languages_equal_a_plain_version(spark):
    rows = [(i, tongue("aeiouklm" if i % 2 else "aeistrnd", 1 + i % 9, i), None if i % 7 == 0 else ("aa" if i % 2 else "bb")) for i in range(60)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 ?", "aa"), (None, "kal mok", "aa"), (3, rows[3][1], rows[3][2]), (103, "1 2", "digits")]
    got = languages.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(((r.doc_id, r.lang_pred, r.score) for r in got), key=key), sorted(plain_predictions(rows), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_languages_odd_rows(spark, odd):  # noqa: F811
    rows = languages.predicted(odd).collect()
    assert sorted((r.doc_id or 0) for r in rows) == sorted((i or 0) for i, _ in ODD)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred in ("en", "und") and 0 <= r.score <= 1
        if r.doc_id in (2, 3, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in languages.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert languages.predicted(none_of(odd)).count() == 0


def test_languages_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op11_hyperdimensional_profiles(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right = got.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share")).collect()
    assert len(right) == 2 and all(r.share > 0.98 for r in right)
    other = docs.withColumn("lang", F.when(languages.held_out(), "xx").otherwise(F.col("lang")))
    assert {tuple(r) for r in languages.predicted(other).collect()} == {tuple(r) for r in got.select("doc_id", "held_out", "lang_pred", "score").collect()}


# ---- 12: alignment

STRANGE = [
    None, "", " ", "  ", "a", "naïve café", "日本語のテキスト", "🙂👩‍👩‍👧 x", "▁a", "a ▁ b", "<|endoftext|> and <s> </s> <unk>", "<0x41> x", "tab\tand\nnew  line   end ", "\r\n\r\n", "x\x00y", "\x1c\x1d\u0085  z",
    "don't we'll I'M", "1234567890", "....----!!!!", "é ẛ̣ ﬁ", "the the the", "the the the", prose(40, 8), "word" * 300,
]


def plain_alignment(texts):
    """Byte by byte: owners, groups, links and their counts, with the tokenizers' own libraries on whole texts."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    bytes_a = lambda i: bytes(letter[c] for c in tok.id_to_token(i))
    def of_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            spelled_a, spelled_b = [bytes_a(i) for i in a], [of_b(i) for i in b]
            if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
                a = b = []
        if not a:
            rows.append(((0, 0, 0, 0), "", []))
            continue
        own_a, own_b = ([k for k, s in enumerate(side) for _ in s] for side in (spelled_a, spelled_b))
        links = sorted(set(zip(own_a, own_b, strict=True)))
        ends_a, ends_b = (set(np.cumsum([len(s) for s in side]).tolist()) for side in (spelled_a, spelled_b))
        groups, last = [], 0
        for end in sorted(ends_a & ends_b):
            groups.append(",".join(str(a[k]) for k in sorted(set(own_a[last:end]))) + "|" + ",".join(str(b[k]) for k in sorted(set(own_b[last:end]))))
            last = end
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        rows.append(((len(a), len(b), len(groups), len(links)), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs))
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    return [(*sizes, sum(counts[p] == highest[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest) for sizes, digest, pairs in rows]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("known_pairs", [alignment.KNOWN_PAIRS, 40, 0])
def test_alignment_equals_a_plain_version(spark, known_pairs):
    docs = spark.createDataFrame(list(enumerate(STRANGE)), "doc_id long, text string").repartition(3)
    got = alignment.token_links(docs.withColumns({"row": F.lit(1), "pairs": F.lit("x"), "n": F.lit(2)}), A, B, known_pairs).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain_alignment(STRANGE)


def test_alignment_of_chunks(monkeypatch):
    a, b = alignment.sides(A, B)
    texts = [t for t in STRANGE if t] + [prose(3000, 4)]
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    assert [x.tolist() for x in a.tokens(texts)] == [x.ids for x in tok.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in b.tokens(texts)] == sp.encode(texts)
    assert alignment.aligned([], [], a.sizes, b.sizes).link_a.size == 0


def test_alignment_odd_rows(spark, odd):  # noqa: F811
    rows = alignment.token_links(odd, A, B).collect()
    assert sorted((r.doc_id or 0) for r in rows) == sorted((i or 0) for i, _ in ODD)
    want = dict(zip([i for i, _ in ODD], plain_alignment([t for _, t in ODD]), strict=True))
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == want[r.doc_id]
        assert r.n_products >= r.n_links >= max(r.n_a, r.n_b)
    assert alignment.token_links(none_of(odd), A, B).count() == 0
    assert alignment.token_links(odd.filter(F.col("doc_id").isin(2, 3)), A, B).select("n_a", "n_links", "count_sum", "groups_sha256").distinct().collect() == [(0, 0, 0, "")]


# ---- 13: whitening


def plain_whitening(vectors):
    """Exact covariance by fractions, then numpy."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = [list(t) for t in {tuple(r) for r in x}]
    n, d = len(fit), len(fit[0])
    sums = [sum(r[i] for r in fit) for i in range(d)]
    cov = np.array([[float(sum(Fraction(n * r[i] - sums[i], n) * Fraction(n * r[j] - sums[j], n) for r in fit) / n) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums, strict=True)] for r in x])
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return n, deviations, centred, values, axes, cov


def check_whitening(got, ids, vectors, most, tolerance=1e-9):
    n, deviations, centred, values, axes, cov = plain_whitening(vectors)
    kept = max(r.component for r in got)
    assert kept == min(most, int((values > values[0] * len(values) * 1e-13).sum())) and len(got) == kept * len(ids)
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(kept):
        column = centred @ axes[:, c] / math.sqrt(values[c])
        mine = np.array([by[i, c + 1].whitened for i in ids])
        assert mine == pytest.approx(column, abs=tolerance) or mine == pytest.approx(-column, abs=tolerance)
        assert [by[i, c + 1].explained for i in ids] == pytest.approx([values[c] / np.trace(cov)] * len(ids), rel=1e-9)
    assert [by[i, 1].deviation for i in ids] == [v if v < 1 << 63 else None for v in deviations]
    assert {r.n for r in got} == {n} and {r.identity_error < 1e-6 for r in got} == {True}


def test_whitening_equals_a_plain_version(spark):
    r = random.Random(5)
    vectors = [[r.gauss(k / 3, 1 + k) for k in range(7)] for _ in range(80)]
    vectors += [vectors[3]] * 30  # copies weigh nothing in the fit
    rows = list(enumerate(vectors))
    bad = [(200, None), (201, []), (202, [1.0] * 6 + [None]), (203, [float("nan")] + [1.0] * 6), (204, [float("inf")] + [1.0] * 6), (205, [1.0, 2.0]), (206, [1e300] + [0.0] * 6)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "component": F.lit("c")})
    check_whitening(whitening.whitened(frame.repartition(4)).collect(), range(len(vectors)), vectors, 16)
    check_whitening(whitening.whitened(frame, components=3).collect(), range(len(vectors)), vectors, 3)


def test_whitening_in_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS_PER_AGGREGATE", 5)
    r = random.Random(6)
    vectors = [[r.gauss(0, 1) for _ in range(5)] for _ in range(40)]
    check_whitening(whitening.whitened(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").select("vec_id", F.col("embedding").cast("array<double>"))).collect(), range(40), [[float(np.float32(c)) for c in v] for v in vectors], 16)


def test_whitening_of_large_entries_and_flat_dimensions(spark):
    r = random.Random(7)
    large = [[r.uniform(-1e12, 1e12), r.uniform(-1e11, 1e11), 5.0] for _ in range(50)]  # products beyond a long, one dimension flat
    check_whitening(whitening.whitened(spark.createDataFrame(list(enumerate(large)), "vec_id long, embedding array<double>")).collect(), range(50), large, 16, 1e-6)


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, 1), (2, [], 1)], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], schema)).count() == 0  # one distinct vector has no spread
    rows = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0], 1), (2, [3.0, 5.0], 1), (2, [3.0, 5.0], 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in rows) == [(0, 1, 2), (2, 1, 2), (2, 1, 2)]
    assert {round(abs(r.whitened), 9) for r in rows} == {1.0}
