"""The queries opN_<name> over the driver's tables, each a thin wrapper of its operator, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.llm import alignment, chat, decontamination, htmltext, languages, neardup, packing, quality, secrets, sharding, tokencount, toxicity, whitening
from quotemill.llm.common import table, text_or_empty
from quotemill.session import shared_path


def op1_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    verdicts = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "badness", "scale")


def op2_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op3_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of unigram tokens of every document."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _said(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of each conversation in order, and the conversation -7.

    Each row is a message of its own, repeated rows too; rows of equal turn go by role, then text, and null turns come last.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text_or_empty().alias("text"))
    said = r"\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")).cast("long")
    return rows.unionByName(own).select("conv_id", place.alias("place"), "role", "text")


def _event(kind: str, seq: int, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.col("place") * 10 + seq).alias("seq"), text.alias("text"))


def _log(said: DataFrame, events: Column) -> DataFrame:
    """An event log with the given array of events for every message."""
    return said.select("conv_id", F.col("place").alias("message_id"), "role", F.explode(events).alias("e")).select("conv_id", "message_id", "role", "e.kind", "e.seq", "e.text")


def _chat_events(conversations: DataFrame) -> DataFrame:
    """The rows as a log: an assistant's message arrives as two streamed deltas, others as one event."""
    half = F.floor(F.length("text") / 2).cast("int")
    deltas = F.array(_event("delta", 0, F.substr("text", F.lit(1), half)), _event("delta", 1, F.substr("text", half + 1)))
    return _log(_said(conversations), F.when(F.col("role") == "assistant", deltas).otherwise(F.array(_event("message", 0, F.col("text")))))


def chat_event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over a log with every kind of event: of a conversation's messages, in turn, one is edited, one is continued by a delta,
    one is deleted; in every fifth conversation the second message is regenerated at the end, which drops all later ones."""
    said = _said(table(spark, sf_dir, "conversations"))
    draft = _event("message", 0, F.concat(F.lit("draft "), "text"))
    last = {0: _event("edit", 1, F.col("text")), 1: _event("delta", 1, F.lit(" more")), 2: _event("delete", 1, F.lit(""))}
    kind = F.col("place") % 3
    log = _log(said, F.array(draft, F.when(kind == 0, last[0]).when(kind == 1, last[1]).otherwise(last[2])))
    again = said.filter((F.col("place") == 2) & (F.col("conv_id") % 5 == 0))
    end = lambda kind, seq, text: F.struct(F.lit(kind).alias("kind"), F.lit(seq).cast("long").alias("seq"), F.lit(text).alias("text"))
    log = log.unionByName(_log(again, F.array(end("regenerate", 1 << 40, ""), end("delta", (1 << 40) + 1, "again"))))
    return chat.messages(log)


def op5_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted text."""
    rows = chat.read_rows(chat.formatted(_chat_events(table(spark, sf_dir, "conversations"))))
    said = F.struct("at", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("x"))
    joined = lambda kept, row: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, row))), lambda r: r["x"]), "")
    learned = F.col("learned").isNotNull()
    read = rows.groupBy("conv_id").agg(
        F.count_if(~learned).alias("n_turns"),
        joined(~learned, said).alias("turns"),
        joined(learned, F.struct("at", F.col("learned").alias("x"))).alias("loss"),
        F.sum("n_chars").alias("formatted_chars"),
    )
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select("conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest("loss").alias("loss_sha256"), "formatted_chars")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_first")


SHARD_NAMES = tuple(f"shard-{k:03d}" for k in range(sharding.SHARDS))


def op7_permutation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.placed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARD_NAMES)


def op8_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each document one version of one path."""
    docs = table(spark, sf_dir, "documents")
    found, _ = secrets.scan_versions(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"))
    base = F.filter("findings", lambda f: f["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secrets.joined_spans(base).cast("binary"), 256).alias("base_sha256")
    return found.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), digest, secrets.joined_spans(F.col("findings")).alias("spans"))


def blob_ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and blobs per rule version in a ledger after two runs over all documents, the first under an older version of one rule.

    The second run scans the pairs of that rule alone: a pair scanned twice would be there twice.
    """
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    ledger = shared_path(spark, "ledger")
    secrets.scan_into(spark, versions, ledger, [replace(r, version=0) if r.kind == "jwt" else r for r in secrets.RULES])
    secrets.scan_into(spark, versions, ledger)
    pairs = spark.read.schema(secrets.LEDGER).parquet(ledger).groupBy("blob", "rule").agg(F.count("*").alias("n"))
    return pairs.groupBy("rule").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_blobs"))


def op11_hyperdimensional_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return languages.predicted(table(spark, sf_dir, "documents"))


def op12_elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    return alignment.token_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_triangle_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_risk_controlled_rules,
        op2_minimum_cut,
        op3_unigram_counts,
        op4_positive_unlabelled,
        op5_event_sourced_chat,
        chat_event_replay,
        op6_dart_minhash,
        op7_permutation_table,
        op8_tournament_packing,
        op9_bm25_wand,
        op10_blob_ledger,
        blob_ledger_runs,
        op11_hyperdimensional_profiles,
        op12_elementary_intervals,
        op13_triangle_aggregates,
    )
}

_SCALES = ", ".join(f"({i}, {s}::double)" for i, s in enumerate(quality.SCALES))
_REF = quality.REFERENCE
#: Query 1: the counts word by word, the certified scales by exact binomial tails, the verdicts.
_OP1 = rf"""
with words as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, g) as c
  from (select doc_id, i, array_to_string(ws[i : i + 7], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from words where len(ws) >= 8))),
repeats as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 8)) as j from windows where c > 1) group by doc_id),
lines as (
  select doc_id, count(*) as n, count(*) - count(distinct line) as doubles
  from (select doc_id, unnest(string_split(t, chr(10))) as line from words) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
counts as (
  select w.doc_id, lang, t, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
    coalesce(l.doubles, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, l.n as n_lines,
    len(regexp_extract_all(t, '[!?]')) as marks, len(regexp_extract_all(t, '\p{{Lu}}')) as capitals
  from words w left join lines l on l.doc_id = w.doc_id left join repeats r on r.doc_id = w.doc_id),
signals as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    case when n_words = 0 then 0 else greatest(n_symbols::double / n_words / {_REF["symbols"]}::double, marks::double / n_words / {_REF["marks"]}::double, capitals::double / word_chars / {_REF["capitals"]}::double,
      n_repeat_words::double / n_words / {_REF["repeats"]}::double, n_dup_lines::double / n_lines / {_REF["repeated_lines"]}::double, word_chars::double / n_words / {_REF["word_length"]}::double) end as badness
  from counts),
held as (select lang, t, max(quality) as good, any_value(badness) as badness from signals join labels using (doc_id) where not base_failed and quality is not null group by lang, t),
steps as (
  select lang, step, scale, count(*) filter (good = 1 and badness > scale) as g, count(*) filter (good = 0 and badness > scale) as b, count(*) filter (good = 1) as n
  from held, (values {_SCALES}) x(step, scale) group by lang, step, scale),
tails as (
  select lang, step, scale, b - g as gain, n > 0 and (g < n) and
    (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.RISK}) + (n - i) * ln(1 - {quality.RISK}))) from range(0, g + 1) r(i)) <= {quality.DELTA} / (select count(distinct lang) from held) as passed
  from steps),
certified as (select *, bool_and(passed) over (partition by lang order by step) as ok from tails),
chosen as (select lang, arg_max(scale, struct_pack(gain := gain, first := -step)) as scale from certified where ok group by lang)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  base_failed, not base_failed and not coalesce(badness > c.scale, false) as kept, badness::double as badness, c.scale
from signals s left join chosen c on c.lang = s.lang
"""
#: Query 6: all pairs of different texts that share a shingle, compared exactly, and what they connect.
_OP6 = rf"""
with recursive nodes as (
  select coalesce(text, '') as t, min(doc_id) as node, regexp_extract_all(lower(coalesce(text, '')), '\S+') as ws from documents group by all),
shingles as (
  select node, g, count(*) as c
  from (select node, array_to_string(ws[i : i + 4], ' ') as g from (select node, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from nodes where len(ws) > 0))
  group by node, g),
weights as (select node, sum(c) as w from shingles group by node),
shared as (select a.node as a, b.node as b, sum(least(a.c, b.c)) as s from shingles a join shingles b on a.g = b.g and a.node < b.node group by a.node, b.node),
links as (select a, b from shared join weights x on x.node = a join weights y on y.node = b where s >= {neardup.SIMILARITY} * (x.w + y.w - s)),
both_ways as (select a, b from links union select b, a from links),
reached as (select node as a, node as b from nodes union select r.a, e.b from reached r join both_ways e on e.a = r.b),
classes as (select a as node, min(b) as class_id from reached group by a)
select d.doc_id, c.class_id, d.doc_id = c.class_id as is_first
from documents d join nodes n on n.t = coalesce(d.text, '') join classes c on c.node = n.node
"""
#: The conversations' rows with their places, and the conversation -7.
_SAID = r"""
said as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls last, role nulls first, text) as place, coalesce(role, '') as role, text
  from (
    select conv_id, turn, role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'))"""
#: Query 5: the same digests from the rows, the formatted length from the escapes' growth.
_OP5 = rf"""
with {_SAID},
sized as (
  select *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) as body from said)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(role) + 2 + body + 8)::bigint as formatted_chars
from sized group by conv_id
"""
#: What the events of the replayed log leave.
_REPLAY = rf"""
with {_SAID}
select conv_id, place * 10 as position, role, case when place = 2 then 'again' when place % 3 = 0 then text else 'draft ' || text || ' more' end as text
from said where case when conv_id % 5 = 0 and (select count(*) from said s where s.conv_id = said.conv_id) > 1 then place <= 2 else place % 3 <> 2 end
"""
_SLOT = f"cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 15)) as bigint) % {sharding.TABLE_SIZE}"
#: Query 7: the filled table as a list; tests check it against another way of filling.
_OP7 = f"""
select doc_id, slot, 'shard-' || lpad(cast(list_extract(filled, (slot + 1)::int) as varchar), 3, '0') as shard
from (select doc_id, {_SLOT} as slot from documents),
  (select {sharding.lookup_table(SHARD_NAMES)} as filled)
"""
def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Query 10: each rule's matches and the gaps between them give the places.
_MATCHES = " union all ".join(
    f"select doc_id, {i} as o, '{r.kind}' as kind, {r.least} as least, string_split_regex(t, {_quoted(r.pattern)}) as gaps, regexp_extract_all(t, {_quoted(r.pattern)}) as hits, regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) as parts from docs"
    for i, r in enumerate(secrets.RULES)
)
_OP10 = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
matched as ({_MATCHES}),
placed as (
  select doc_id, o, kind, least, length(parts[k]) as size, length(hits[k]) as whole,
    length(array_to_string(gaps[1 : k], '')) + coalesce(length(array_to_string(hits[1 : k - 1], '')), 0) as place
  from (select *, unnest(range(1, len(hits) + 1)) as k from matched where len(hits) > 0)),
found as (select doc_id, o, kind, place, kind || ':' || place || ':' || (place + whole) as span from placed where size >= least)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(span, ',' order by place, o) filter (o < 3), '')) as base_sha256, coalesce(string_agg(span, ',' order by place, o), '') as spans
from docs d left join found f on f.doc_id = d.doc_id group by d.doc_id
"""
#: The versions that were scanned: those of today, and the older one.
_LEDGER_RUNS = f"select rule, n as n_pairs, n as n_blobs from (select unnest([{', '.join(repr(r.name) for r in secrets.RULES)}, 'jwt@0']) as rule), (select count(distinct coalesce(text, '')) as n from documents)"
ORACLE_SQL: dict[str, str] = {"op1_risk_controlled_rules": _OP1, "op6_dart_minhash": _OP6, "op5_event_sourced_chat": _OP5, "chat_event_replay": _REPLAY, "op7_permutation_table": _OP7, "op10_blob_ledger": _OP10, "blob_ledger_runs": _LEDGER_RUNS}
