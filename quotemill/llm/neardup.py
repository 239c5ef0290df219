"""Near-duplicate classes of documents: weighted MinHash by throwing darts, a banded join, exact verification, components.

Every element (a shingle, its weight its count) owns a region of unit width times its weight on a board without end. Darts
fall on the board by hashes of the place alone, so two documents see the same darts where their regions overlap. A document
keeps for each of its coordinates the earliest dart that fell there; two documents keep the same one with the probability of
their weighted Jaccard similarity. Only about k ln k darts have to be looked at, however many elements a document has.

Texts, not ids, are the nodes: equal texts are one node from the start, so copies cost nothing later. Texts that agree on all
coordinates of a band share a bucket. In each bucket the best-connected text is compared with all others; the texts which that
leaves in different classes are then compared with further leaders, drawn by a hash, until no bucket holds two texts of different classes
that have neither been compared nor been shown too far apart by what they share with their leader. Thus no link that the bands
find is lost, and a bucket of near copies costs one comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm import common
from quotemill.llm.common import node_of, spread_join, text_or_empty, unused, written
from quotemill.llm.shingles import WORDS_PER_SHINGLE, mixed, shingles

SIMILARITY = 0.8
#: 24 bands of 7 coordinates: two texts of similarity 0.8 share a bucket with probability 0.9965, of 0.85 with 0.9999.
BANDS, ROWS = 24, 7
#: Leaders of a bucket that are compared in the second round, how many times more in each later one, and the most in one.
LEADERS, MORE_LEADERS, MOST_LEADERS = 16, 16, 1000
#: Members of a bucket that meet its leaders in one task.
MEMBERS = 1000
#: Texts whose shingles a task keeps while it compares pairs.
KNOWN = 16

_U = np.uint64


def dart_minhash(codes: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The k coordinates' earliest darts as 64-bit codes, for distinct element codes with positive weights.

    Darts fall on each unit of an element's region as a Poisson process in time; the gaps, the place within the unit and the
    coordinate come from hashes of (element, unit, number of the dart). Those beyond a fractional weight's edge are ignored.
    The time looked at starts where about k (ln k + 3) darts are expected and doubles until every coordinate has one.
    """
    units = np.ceil(weights).astype(np.int64)
    element = np.repeat(codes, units)
    unit = np.arange(len(element)) - np.repeat(np.cumsum(units) - units, units)
    edge = np.repeat(weights, units) - unit
    whole = bool((edge >= 1).all())
    seed = mixed(element ^ mixed(unit.astype(_U) + _U(0x632BE59BD9B4E019)))
    until = k * (np.log(k) + 3) / float(np.sum(weights))
    while True:
        step = int(until) + 2
        found, times = [], []
        own, time, limit, first = seed, np.zeros(len(seed)), edge, 0
        while len(own):
            numbers = np.arange(first, first + step, dtype=_U) * _U(0x9E3779B97F4A7C15)
            dart = mixed(own[:, None] + numbers[None, :])
            at = time[:, None] + np.cumsum(-np.log(((dart >> _U(11)).astype(np.float64) + 1) * 2.0**-53), axis=1)
            hit = at < until
            time, more = at[:, -1], at[:, -1] < until
            if not whole:
                hit &= (mixed(dart ^ _U(0xD6E8FEB86659FD93)) >> _U(11)).astype(np.float64) * 2.0**-53 < limit[:, None]
            found.append(dart[hit])
            times.append(at[hit])
            own, time, limit, first = own[more], time[more], limit[more], first + step
        darts, at = np.concatenate(found), np.concatenate(times)
        order = np.lexsort((darts, at))[::-1]
        darts = mixed(darts[order] + _U(0xA0761D6478BD642F))
        signature, filled = np.zeros(k, _U), np.zeros(k, bool)
        place = (darts % _U(k)).astype(np.int64)
        signature[place] = darts  # in order of falling time: the earliest is written last
        filled[place] = True
        if filled.all():
            return signature
        until *= 2


def band_codes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A code for each band's coordinates, different from band to band."""
    code = np.arange(bands, dtype=_U)
    for column in signature.reshape(bands, rows).T:
        code = mixed(code * _U(0x9E3779B97F4A7C15) + column)
    return code.astype(np.int64)


def signatures(texts: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(node, doc_id, weight, buckets) of every row; weight (the number of shingles) and buckets only once for each node in a task, and null without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                weights, codes = [None] * part.num_rows, [None] * part.num_rows
                for k, (node, text) in enumerate(zip(part["node"].to_pylist(), part["text"].to_pylist(), strict=True)):
                    if node in seen:
                        continue
                    seen.add(node)
                    element, count = shingles(text, size)
                    if len(element):
                        weights[k] = int(count.sum())
                        codes[k] = band_codes(dart_minhash(element, count.astype(np.float64), bands * rows), bands, rows)
                yield pa.record_batch({"node": part["node"], "doc_id": part["doc_id"], "weight": pa.array(weights, pa.int64()), "buckets": pa.array(codes, pa.list_(pa.int64()))})

    return texts.select("node", "doc_id", "text").mapInArrow(run, "node binary, doc_id long, weight long, buckets array<long>")


COMPARED = "a binary, b binary, shared long, similar boolean, codes array<long>, extra array<long>"


def compared(pairs: DataFrame, texts: DataFrame, similarity: float, size: int, extras: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of nodes with the weight that their whole texts share and whether they are similar enough.

    With extras, also the shingles of which b has more than a, and how many more. Many pairs may have one a, few one b: the
    join by a is a plain one of two shuffles, whose large partitions adaptive execution splits, and the texts are compared where they are dealt by b.
    """
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # the shingles of texts met last
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for x, y, s, t in zip(*(part[c].to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                    for key, text in ((x, s), (y, t)):
                        known[key] = known.pop(key) if key in known else shingles(text, size)
                    own, other = known[x], known[y]
                    while len(known) > KNOWN:
                        del known[next(iter(known))]
                    _, i, j = np.intersect1d(own[0], other[0], assume_unique=True, return_indices=True)
                    more = other[1].copy()
                    more[j] -= np.minimum(own[1][i], other[1][j])
                    shared, total = int(other[1].sum() - more.sum()), int(own[1].sum() + other[1].sum())
                    out.append((x, y, shared, shared >= similarity * (total - shared), other[0][more > 0].astype(np.int64) if extras else [], more[more > 0] if extras else []))
                if out:
                    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in COMPARED.split(", ")])

    return both.mapInArrow(run, COMPARED)


def common_extras(led: DataFrame) -> DataFrame:
    """(a, b, extra): of the weight that b has beyond its leader a, how much lies on shingles on which another of a's followers in led has more too.

    Counted as what is left without the shingles that one follower alone has, so that all is summed before it is shuffled.
    """
    spread = led.select("a", "b", F.explode(F.arrays_zip("codes", "extra")).alias("e")).select("a", "b", "e.codes", "e.extra")
    alone = spread.groupBy("a", "codes").agg(F.count("*").alias("n"), F.min("b").alias("b"), F.min("extra").alias("extra")).filter("n = 1")
    alone = alone.groupBy("a", "b").agg(F.sum("extra").alias("alone"))
    total = F.coalesce(F.aggregate("extra", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
    return led.select("a", "b", total.alias("total")).join(alone, ["a", "b"], "left").select("a", "b", (F.col("total") - F.coalesce("alone", F.lit(0))).alias("extra"))


def may_be_similar(similarity: float) -> F.Column:
    """Whether two followers of one leader can be similar: an exact bound from what each shares with it.

    Two texts share at most the smaller of what they share with the leader, and beyond it at most the smaller of their common
    extras. Copies with edits of their own have none, so those too far from the leader are too far from each other.
    """
    most = F.least("shared_a", "shared") + F.least("extra_a", "extra")
    return most >= F.lit(similarity) * (F.col("weight_a") + F.col("weight") - most)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): root is the least node of each connected component of the edges (a, b). Nodes without an edge are absent.

    Alternates large-star and small-star steps until only stars are left. Only nodes that are no star's centre or leaf yet change
    an edge: these are written with their least neighbour, and each edge looks up its ends there, so a hub's neighbours are never gathered in one place.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), label)
    while True:
        ends = now.select(F.col("b").alias("u"), F.col("a").alias("m")).unionByName(now.select(F.col("a").alias("u"), F.lit(None).cast("binary").alias("m")))
        ends = ends.groupBy("u").agg(F.min("m").alias("m"), F.count("m").alias("up"), F.count("*").alias("degree"))
        ends = written(ends.filter("up > 1 or up = 1 and degree > 1"), "ends")  # in stars a node has one smaller neighbour alone, or larger ones
        if not ends.limit(1).count():
            break
        # large-star: the larger neighbours of a node go to its least neighbour
        moved = now.join(ends.filter("degree > up").select(F.col("u").alias("a"), "m"), "a", "left").select(F.coalesce("m", "a").alias("a"), "b")
        # small-star: a node and its smaller neighbours go to the least of these
        several = moved.groupBy("b").agg(F.min("a").alias("m"), F.max("a").alias("most")).filter("m < most")
        moved = moved.join(written(several.select("b", "m"), "several"), "b", "left").withColumn("m", F.coalesce("m", "a"))
        moved = moved.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        now = written(moved.filter("a < b").distinct(), label)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def banded(firsts: DataFrame, bands: int) -> DataFrame:
    """(node, name, first_id, weight, links): every text that shares a bucket with another text, links its (bucket, leader) in each such bucket.

    firsts is a written table. The node's address here is its number of partners over all its buckets, counted down, then its name
    in firsts: the least node of a bucket, its leader, is the text of most partners, so hubs come before what they are linked to. Sizes and
    leaders are aggregates, combined before they are shuffled; buckets of many texts are joined with theirs apart from the others.
    """
    all_bands = firsts.select(F.col("node").alias("name"), F.explode("buckets").alias("bucket"))
    sizes = written(all_bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    total, hottest = sizes.agg(F.sum("n"), F.max("n")).first()
    total, hottest = total or 0, hottest or 0
    shared = spread_join(all_bands, sizes, "bucket", "n", bands * firsts.count(), hottest)
    dense = shared.groupBy("name").agg(F.sum(F.col("n") - 1).alias("density"), F.collect_list("bucket").alias("buckets"))
    node = F.unhex(F.concat(F.lpad(F.hex(F.lit(2**63 - 1) - F.col("density")), 16, "0"), F.hex("name")))
    dense = dense.join(firsts.select(F.col("node").alias("name"), "first_id", "weight"), "name")
    dense = written(dense.select(node.alias("node"), "name", "first_id", "weight", "buckets"), "dense")
    shared = dense.select("node", F.explode("buckets").alias("bucket"))
    best = written(shared.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("size")), "leaders")
    led = spread_join(shared, best, "bucket", "size", total, hottest)
    led = led.groupBy("node").agg(F.collect_list(F.struct("bucket", "leader")).alias("links"))
    return written(dense.drop("buckets").join(led, "node"), "buckets")


def name_of(node: str) -> F.Column:
    """The name in firsts of a node of banded."""
    return F.col(node).substr(9, 16)


def still_apart(members: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """The members of buckets in which texts of different classes are left, with their classes' roots and the buckets' sizes and least nodes. members has total rows or fewer."""
    rooted = written(members.drop("root", "size", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    several = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"), F.min("node").alias("first"))
    several = written(several.filter("least < most").select("bucket", "size", "first"), "several")
    return written(spread_join(rooted, several, "bucket", "size", total), "apart")


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(node, first_id, copies, root) of every distinct text: its least doc_id (null only if all are), its rows, the node that stands for its class."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keyed = keyed.withColumn("node", node_of(F.col("text")))
    # copies of a text may lie in several tasks; each such task gives its signature
    firsts = signatures(keyed, bands, rows, size).groupBy("node")
    firsts = firsts.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("weight").alias("weight"), F.first("buckets", ignorenulls=True).alias("buckets"))
    firsts = written(firsts, "firsts")
    buckets = banded(firsts, bands)
    # one row's text for each node, found by its id, so that the copies of a text are not gathered anywhere
    wanted = buckets.select(F.col("node").alias("_node"), "name", "first_id")
    same = (F.col("node") == F.col("name")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    texts = written(keyed.join(wanted, same).select(F.col("_node").alias("node"), "text").dropDuplicates(["node"]), "texts")

    leaders = F.array_except(F.array_distinct("links.leader"), F.array("node"))
    pairs = buckets.select(F.explode(leaders).alias("a"), F.col("node").alias("b"))
    led = written(compared(pairs, texts, similarity, size, extras=True), "led")
    # a text has few leaders and all come before it: with it they are linked to the first of them, which leaves little to the components
    stars = led.filter("similar").groupBy("b").agg(F.sort_array(F.collect_list("a")).alias("all"))
    roots = written(components(stars.select(F.col("all")[0].alias("a"), F.explode(F.concat("all", F.array("b"))).alias("b"))), "roots")
    followers = buckets.select("node", "weight", F.inline("links")).filter("node <> leader")
    count = buckets.agg(F.sum(F.size("links"))).first()[0] or 0
    apart, more, bounded = still_apart(followers, roots, count), LEADERS, False
    while count := apart.count():
        if not bounded:
            open_led = written(led.join(apart.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), ["a", "b"], "left_semi"), "open")
            bounds = open_led.select("a", "b", "shared").join(common_extras(open_led), ["a", "b"])
            bounds = bounds.select(F.col("a").alias("leader"), F.col("b").alias("node"), "shared", "extra")
            apart, bounded = written(apart.join(bounds, ["leader", "node"]), "bounded"), True
        leads = (F.pmod(F.xxhash64("bucket", "node"), F.col("size")) < more) | (F.col("node") == F.col("first"))
        member = apart.withColumn("leads", leads).withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / MEMBERS)))
        member = written(member, "member")
        lead = member.filter("leads").select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "weight", "shared", "extra")])
        there = member.select("bucket", "salt").distinct().join(lead, "bucket")  # leaders are copied once for every MEMBERS members
        later = ~F.col("leads") | (F.col("node") > F.col("node_a"))
        found = there.join(member, ["bucket", "salt"]).filter(later & (F.col("root") != F.col("root_a")) & may_be_similar(similarity))
        pairs = written(found.select(F.col("node_a").alias("a"), F.col("node").alias("b"), "root_a", "root").distinct(), "pairs")
        new = written(compared(pairs, texts, similarity, size).filter("similar").select("a", "b"), "edges")
        if new.limit(1).count():
            # only the classes that the new edges join are connected anew
            joined = components(new.join(pairs, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root").alias("b")))
            joined = joined.select(F.col("node").alias("root"), F.col("root").alias("_root"))
            both = roots.join(joined, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
            alone = joined.join(roots, F.col("node") == joined["root"], "left_anti").select(F.col("root").alias("node"), F.col("_root").alias("root"))
            roots = written(both.unionByName(alone), "roots")
        apart, more = still_apart(member.filter("not leads").drop("leads", "salt"), roots, count), min(more * MORE_LEADERS, MOST_LEADERS)

    roots = roots.select(name_of("node").alias("node"), name_of("root").alias("root"))
    return firsts.select("node", "first_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = WORDS_PER_SHINGLE) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), is_first (its id is that one).

    Needs doc_id and text; other columns are ignored. Texts whose five-word shingles have a weighted Jaccard similarity of at
    least 0.8 are linked, and classes are what links connect. Words are lower-case runs between white space; a text of fewer
    than five words is one shingle. Equal texts are always one class, so all empty and null texts are one; of other texts
    without words each is its own. Repeated rows stay repeated. A class of null ids only has a null class_id. An empty table gives
    no rows.
    """
    nodes = written(classes(docs, similarity, bands, rows, size), "nodes")
    least = written(nodes.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("size")), "least")
    count, copies = nodes.agg(F.count("*"), F.sum("copies")).first()
    labels = written(spread_join(nodes, least, "root", "size", count).select("node", "class_id", "copies"), "labels")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(text_or_empty()).alias("node"))
    return spread_join(keyed, labels, "node", "copies", copies or 0).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_first"))


def first_documents(docs: DataFrame, **settings: float) -> DataFrame:
    """One row of docs for each class, of the least id in it (null only if all are), all columns as they are; of rows that tie one is taken.

    Rows and texts count as in near_duplicates. Columns of any name may stand beside doc_id and text; an empty table gives no rows.
    """
    key = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")
    mine = {name: unused(name, docs.columns) for name in ("first_id", "first_node", "place")}
    best = classes(docs, **settings).groupBy("root").agg(F.min(key).alias("best"))
    firsts = best.select(F.col("best.first_id").alias(mine["first_id"]), F.col("best.node").alias(mine["first_node"]))
    here = docs["doc_id"].cast("long").eqNullSafe(F.col(mine["first_id"])) & (node_of(text_or_empty()) == F.col(mine["first_node"]))
    ties = Window.partitionBy(mine["first_id"], mine["first_node"]).orderBy(F.lit(0))
    return docs.join(firsts, here).withColumn(mine["place"], F.row_number().over(ties)).filter(F.col(mine["place"]) == 1).drop(*mine.values())
