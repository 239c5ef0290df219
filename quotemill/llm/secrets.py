"""Secret scans over an incremental ledger of content-addressed blobs.

Every historical version of every path is addressed by the SHA-256 of its text, its blob. A ledger says which pairs of blob
and rule version have been scanned, and what was found. A run scans each blob once for the rule versions that the ledger
lacks, whatever the number of paths and versions that hold it, adds those pairs to the ledger and joins the findings of all
wanted rule versions back to every path and version.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import text_or_empty, unused, written

FINDINGS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob binary, rule string, findings {FINDINGS}"
MASK = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern whose counted group has at least so many characters.

    The name with its version is the rule version in the ledger: a changed pattern needs a new version. hints are substrings
    of the lower-case text without one of which nothing can match; none means always search.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    hints: tuple[str, ...] = ()
    flags: int = re.ASCII

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str, lower: str) -> list[tuple[int, int]]:
        if self.hints and not any(h in lower for h in self.hints):
            return []
        found = re.compile(self.pattern, self.flags).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: The three base kinds, in this order, then those that the method adds.
RULES = (
    Rule("assign", 1, "(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2, ("password", "passwd", "secret", "token", "api_key", "apikey")),
    Rule("access", 1, "AKIA[A-Z0-9]+", 18, 0, ("akia",)),
    Rule("hex", 1, "[0-9a-f]{16,}", 16),
    Rule("private_key", 2, "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:\\s{0,4}[A-Za-z0-9+/]{24,}={0,2})+(?:\\s{0,4}(?:[A-Za-z0-9+/]{1,23}={0,2}\\s{0,4})?-----END [A-Z ]{0,20}PRIVATE KEY-----)?", 48, 0, ("private key",)),
    Rule("jwt", 1, "\\beyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 32, 0, ("eyj",)),
    Rule("vendor_token", 1, "\\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 15, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "aiza")),
)


def blob_of(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scanned(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows for every blob (blob, text, todo: its rules to apply), also where nothing is found."""
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for blob, text, todo in zip(part["blob"].to_pylist(), part["text"].to_pylist(), part["todo"].to_pylist(), strict=True):
                    lower = text.lower()
                    rows += [(blob, name, [{"kind": by_name[name].kind, "start": a, "end": b} for a, b in by_name[name].spans(text, lower)]) for name in todo]
                blob, name, found = zip(*rows, strict=True)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch({"blob": pa.array(blob, pa.binary()), "rule": pa.array(name, pa.string()), "findings": pa.array(found, kind)})

    return blobs.select("blob", "text", "todo").mapInArrow(run, LEDGER)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, new): every version with its blob and findings, and the rows to append to the ledger.

    Needs path, version and text; other columns are ignored. Findings are one array per row, of (kind, start, end) by start,
    then by the rules' order; offsets are code points, ends exclusive. A null text is empty and has none. Repeated rows get
    the same findings each; paths and versions may be null. The ledger has one row per blob and rule version and may hold
    blobs and rules that are not asked for. An empty table gives no rows.
    """
    rows = versions.select("path", "version", text_or_empty().alias("text"))
    rows = rows.withColumn("blob", blob_of(F.col("text")))
    names = [r.name for r in rules]
    known = None
    firsts = rows.select("blob", F.xxhash64("path", "version").alias("at")).groupBy("blob").agg(F.min("at").alias("at"))
    if ledger is not None:
        known = ledger.filter(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("have"))
        firsts = firsts.join(known, "blob", "left")
        firsts = firsts.withColumn("todo", F.array_except(F.array(*map(F.lit, names)), F.coalesce("have", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    else:
        firsts = firsts.withColumn("todo", F.array(*map(F.lit, names)))
    unseen = rows.withColumn("at", F.xxhash64("path", "version")).join(firsts.select("blob", "at", "todo"), ["blob", "at"])
    new = written(scanned(unseen.select("blob", "text", "todo"), rules).dropDuplicates(["blob", "rule"]), "ledger")
    every = new if ledger is None else new.unionByName(ledger.filter(F.col("rule").isin(names)).select("blob", "rule", "findings"))
    found = every.filter(F.size("findings") > 0).groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    sort_key = F.transform("findings", lambda f: F.struct(f["start"].alias("start"), order[f["kind"]].alias("o"), f["end"].alias("end"), f["kind"].alias("kind")))
    found = found.select("blob", F.transform(F.array_sort(sort_key), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))).alias("findings"))
    found = written(found, "findings")  # a table of its own, so that Spark can split the join where a blob has many versions
    joined = rows.select("path", "version", "blob").join(found, "blob", "left")
    return joined.select("path", "version", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")), new


def masked(docs: DataFrame, findings: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with every found span of text replaced by the mask, overlapping spans once; findings has doc text's blob and findings.

    All columns of docs stay, in their order, whatever their names; a text without findings stays as it is, null included.
    Repeated rows stay repeated; an empty table gives no rows.
    """
    mine = {name: unused(name, docs.columns) for name in ("blob", "findings")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, own = batch.schema.get_field_index("text"), batch.schema.get_field_index(mine["findings"])
            texts = [redacted(t, f, mask) if f else t for t, f in zip(batch.column(at).to_pylist(), batch.column(own).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns) if i != own]
            yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != own])

    hits = findings.filter(F.size("findings") > 0).select(F.col("blob").alias(mine["blob"]), F.col("findings").alias(mine["findings"])).dropDuplicates([mine["blob"]])
    with_hits = docs.withColumn(mine["blob"], blob_of(text_or_empty())).join(hits, mine["blob"], "left").drop(mine["blob"])
    return with_hits.mapInArrow(run, docs.schema)


def redacted(text: str, findings: list[dict], mask: str) -> str:
    out, at = [], 0
    for f in sorted(findings, key=lambda f: (f["start"], f["end"])):
        if f["start"] >= at:
            out += [text[at : f["start"]], mask]
        at = max(at, f["end"])
    return "".join([*out, text[at:]])


def scan_into(spark: SparkSession, versions: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of every version, as scan_versions gives them, with the ledger kept as a Parquet table at path.

    The first run starts the ledger; each later one scans only pairs of blob and rule version that it lacks, and appends them.
    An empty table gives no rows and appends none. An append that fails leaves the ledger as it was; its pairs are scanned again.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    begun = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    found, new = scan_versions(versions, spark.read.schema(LEDGER).parquet(path) if begun else None, rules)
    new.write.mode("append").parquet(path)
    return found


def joined_spans(findings: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
