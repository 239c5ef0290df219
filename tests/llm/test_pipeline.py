"""The pipeline on a small corpus against a plain version of each stage, and its entry in the driver's contract."""

import random
import subprocess
import sys
from array import array
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quotemill.llm import quality, secrets
from tests.llm.test_operators import classes_in_order, edited, prose

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(2)
    leak = prose(30, 4000)
    docs = [(i, prose(r.randrange(30, 90), i)) for i in range(700)]
    docs += [(1000 + i, edited(docs[i][1], 0.005, i)) for i in range(60)] + [(2000 + i, docs[5][1]) for i in range(5)]
    docs += [(3000 + i, " ".join("### " + w for w in prose(40, i).split())) for i in range(60)]
    docs += [(4000, prose(50, 8) + " " + leak + " " + prose(50, 9)), (4001, leak + " " + prose(40, 10)), (5000, prose(40, 11) + " password=b7db7aa4a5fcc78305 end"), (5001, "too short"), (5002, None), (5003, prose(5000, 12)), (None, prose(60, 13)), (5004, prose(60, 14)), (5004, prose(60, 14))]
    folder = tmp_path_factory.mktemp("corpus")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    frame = frame.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    frame.write.parquet(f"{folder}/documents.parquet")
    labelled = [(i, 1, 0) for i in range(700)] + [(3000 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, labelled, leak


def plain(docs, leak):
    """The first four stages: the junk and the short go, one of each class stays, leaks go, secrets are masked."""
    kept = [(d, t) for d, t in docs if t and not (d is not None and 3000 <= d < 4000) and len(quality.WORD.findall(t)) >= 20]
    firsts = {}
    for (d, c), (_, t) in zip(classes_in_order(kept), kept, strict=True):
        if d == c:
            firsts[c] = (d, t)
    clean = [(d, t) for d, t in firsts.values() if leak not in t]
    out = []
    for d, t in clean:
        spans = [{"start": a, "end": b} for rule in secrets.RULES for a, b in rule.spans(t, t.lower())]
        out.append((d, secrets.redacted(t, spans, secrets.MASK)))
    return out


def test_pipeline_matches_the_plain_version(spark, corpus):
    from tokenizers import Tokenizer

    folder, docs, _, leak = corpus
    pieces = corpus_pipeline.run(spark, folder).orderBy("doc_id", "start").collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {d: array("I", [*library.encode(t, add_special_tokens=False).ids, 1]).tobytes() for d, t in plain(docs, leak)}
    found = {}
    for p in pieces:
        found[p.doc_id] = found.get(p.doc_id, b"") + p.ids
    assert found == expected
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        own.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(x for _, x in own) <= 2048


def test_stages_keep_the_columns_and_take_empty_tables(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0).withColumns({"node": F.lit("x"), "kept": F.lit(1)}), folder)
        assert out.columns[:5] == docs.columns and out.count() == 0
        assert stage(spark, docs, folder).schema.simpleString() == docs.schema.simpleString()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_entry_lists_all_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n[: n.index("_") + 1] for n in names if n.startswith("op") and n[2].isdigit()} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_entry_works_without_this_subpackage(tmp_path):
    """As the driver does it: the folders and the pipeline gone, the rest still imports and lists its queries."""
    import shutil

    shutil.copytree(ROOT / "quotemill", tmp_path / "quotemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_entry_works_without_packages_that_only_this_subpackage_needs(tmp_path):
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('absent')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"}, check=True)
