"""Archives by their members: directories, split reads, inner archives, packages and their refusals; records of report files."""

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.sources import archives, records
from tests.test_sources import D, archive, contents, day_record


def put(folder, **files):
    for name, data in files.items():
        (folder / name.replace("__", ".")).write_bytes(data)
    return str(folder)


def test_directory_and_contents(spark, tmp_path):
    inner = archive(deep__dat=b"deep", deep__txt=b"no")
    root = put(tmp_path, a__zip=archive(x__dat=b"one", y__txt=b"two", in__zip=inner), b__zip=archive(z__dat=b"three" * 1000), c__zip=b"no archive")
    rows = archives.directory(spark, root)
    assert sorted((r.source_path[-5:], r.entry, r.size) for r in rows.filter("entry is not null").collect()) == [("a.zip", "in.zip", len(inner)), ("a.zip", "x.dat", 3), ("a.zip", "y.txt", 3), ("b.zip", "z.dat", 5000)]
    assert [(r.source_path[-5:], r.place) for r in rows.filter("problem is not null").collect()] == [("c.zip", -1)]
    found = archives.contents(rows, (".dat",)).collect()
    assert sorted((r.entry, bytes(r.content)[:5]) for r in found) == [("in.zip!deep.dat", b"deep"), ("x.dat", b"one"), ("z.dat", b"three")]
    with pytest.raises(Exception, match="5000 bytes"):
        archives.contents(rows, (".dat",), most_bytes=4000).collect()


def test_members_are_the_splits(spark, tmp_path):
    root = put(tmp_path, all__zip=archive(**{f"sz{k:06d}__day": day_record(20240105, 150 + k) * 1 for k in range(60)}))
    rows = archives.record_rows(archives.directory(spark, root), "day", (".day",))
    tasks = rows.groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 60 and len(tasks) > 1  # one archive, many tasks
    bars, issues = archives.checked_rows(archives.directory(spark, root), "day", (".day",))
    assert bars.count() == 60 and issues.count() == 0


def test_members_are_decoded_in_blocks(spark, tmp_path, monkeypatch):
    days = [20240101 + k for k in range(28)]
    root = put(tmp_path, a__zip=archive(sh600000__day=b"".join(day_record(d, 200) for d in days) + b"cut"))
    bars, issues = archives.checked_rows(archives.directory(spark, root), "day", (".day",))
    assert [r.row_offset for r in bars.orderBy("row_offset").collect()] == list(range(28))
    assert [(r.source_path.rpartition("/")[2], r.row_offset, r.issue_type) for r in issues.collect()] == [("sh600000.day", 28, "incomplete_trailing_bytes")]


def bars_of(n, **change):
    bar = np.zeros(n, records.PACK_BAR)
    for c in ("open", "high", "low", "close", "amount"):
        bar[c] = 1.5
    bar["volume"] = 7
    for c, v in change.items():
        bar[c][0] = v
    return bar.tobytes()


def codes_of(*symbols):
    return b"".join(s.encode().ljust(150, b"\0") for s in symbols)


def package(day="240105", drop=(), **change):
    parts = {f"sh{day}__cod": codes_of("600000", "000300"), f"sh{day}__md1": bars_of(2), f"sz{day}__cod": codes_of("000001"), f"sz{day}__md1": bars_of(1), f"bj{day}__cod": codes_of("920001"), f"bj{day}__md1": bars_of(1)}
    parts |= change
    return archive(**{k: v for k, v in parts.items() if k not in drop})


def twice():
    out = io.BytesIO(package())
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("again/SH240105.cod", codes_of("600000", "000300"))
    return out.getvalue()


REFUSED = {
    "missing_pair": package(drop=("bj240105__md1",)),
    "mixed_dates": package(drop=("bj240105__md1",), bj240106__md1=bars_of(1)),
    "duplicate_entry": twice(),
    "invalid_date": package("241305"),
    "partial_record": package(sz240105__md1=bars_of(1) + b"x"),
    "zero_records": package(sz240105__cod=b"", sz240105__md1=b""),
    "record_count_mismatch": package(sz240105__cod=codes_of("000001", "000002")),
    "not_an_archive": b"nothing",
    "no_entries": archive(note__txt=b"x"),
    "unexpected_date": package("240108"),
    "duplicate_symbol": package(sh240105__cod=codes_of("600000", "600000")),
    "invalid_symbol": package(sz240105__cod=codes_of("00000x")),
    "invalid_bar": package(sz240105__md1=bars_of(1, high=1.0)),
}


def test_packages(spark, tmp_path):
    idle = bars_of(1, open=0, high=0, low=0, volume=0, amount=0)
    root = put(tmp_path, good__zip=package(bj240105__md1=idle), huge__zip=package(sz240105__md1=bars_of(1, volume=2**63)), **{f"{k}__zip": v for k, v in REFUSED.items()})
    bars, checks, counts = archives.packages(archives.directory(spark, root), F.lit("2024-01-05").cast("date"))
    name = F.regexp_extract("source_path", r"([a-z_]+)\.zip$", 1).alias("name")
    assert {r.name: r.problem for r in checks.select(name, "problem").collect()} == {"good": None, "huge": None} | {k: k for k in REFUSED}
    assert sorted(tuple(r) for r in bars.select(name, "market", "symbol", "trade_date", "close", "volume").collect()) == [
        ("good", "sh", "600000", D(2024, 1, 5), 1.5, 7), ("good", "sz", "000001", D(2024, 1, 5), 1.5, 7),
        ("huge", "bj", "920001", D(2024, 1, 5), 1.5, 7), ("huge", "sh", "600000", D(2024, 1, 5), 1.5, 7), ("huge", "sz", "000001", D(2024, 1, 5), 1.5, None),
    ]
    assert sorted(tuple(r) for r in counts.filter(F.col("source_path").contains("good")).select("market", "class", "records").collect()) == [("bj", "idle", 1), ("sh", "other", 1), ("sh", "share", 1), ("sz", "share", 1)]


def test_package_limits_come_from_the_directory(spark):
    row = lambda entry, size, archive_bytes=10, path="p": (path, archive_bytes, 0, entry, size, 1, None)
    six = lambda path, n=1, archive_bytes=10: [row(f"{m}240105.{k}", w * n, archive_bytes, path) for m in ("sh", "sz", "bj") for k, w in (("cod", 150), ("md1", 512))]
    rows = six("large", archive_bytes=(16 << 20) + 1) + six("many", 100_001)[:2] + six("many")[2:] + [row("sh240105.cod", (64 << 20) + 150, path="entry")] + [row(f"{m}240105.md1", 60 << 20, path="wide") for m in ("sh", "sz", "bj")] + six("fine", 10_000)
    found = archives.package_checks(spark.createDataFrame(rows, archives.DIRECTORY))
    assert {r.source_path: r.problem for r in found.collect()} == {"large": "package_too_large", "many": "too_many_records", "entry": "entry_too_large", "wide": "expanded_too_large", "fine": None}


def report(*entries, date=20240331, size=8, count=None, cut=None):
    n = len(entries)
    head = struct.pack("<HIHIII", 1, date, n if count is None else count, 0, size, 0)
    first = 20 + 11 * n
    index = b"".join(struct.pack("<6s1sI", s.encode(), b"1", first + 8 * k if o is None else o) for k, (s, o) in enumerate(entries))
    data = head + index + b"".join(struct.pack("<2f", k + 1, k + 1.5) for k in range(n))
    return data if cut is None else data[:cut]


def test_report_issues(spark):
    files = {
        "good__dat": report(("600000", None), ("000001", None)),
        "twice__dat": report(("600000", None), ("600000", None)),
        "odd__dat": report(("60000x", None), ("000001", None)),
        "outside__dat": report(("600000", 9999), ("000001", 3), ("000002", None)),
        "short__dat": b"123",
        "none__dat": report(),
        "width__dat": report(("600000", None), size=7),
        "index__dat": report(("600000", None), cut=25),
        "undated__dat": report(("600000", None), date=20241301),
        "nothing__dat": report(("x", None)),
    }
    items, issues = records.report_values(contents(spark, **files), spark.createDataFrame([(1,)], "item_id int"))
    name = F.regexp_extract("source_path", r"([a-z]+)\.dat$", 1).alias("name")
    got = sorted(tuple(r) for r in issues.select(name, "issue_type", F.coalesce("row_offset", F.lit(-1))).collect())
    unknown = [(n, "unknown_dictionary_id", 2) for n in ("good", "odd", "outside", "twice", "undated")]
    assert got == sorted(unknown + [
        ("twice", "duplicate_logical_key", 1), ("odd", "unsupported_symbol", 0), ("outside", "incomplete_trailing_bytes", 0), ("outside", "incomplete_trailing_bytes", 1), ("short", "file_too_short", -1), ("none", "zero_valid_rows", -1),
        ("width", "unsupported_record_size", -1), ("index", "incomplete_trailing_bytes", -1), ("undated", "invalid_date", -1), ("nothing", "unsupported_symbol", 0), ("nothing", "zero_valid_rows", -1),
    ])
    assert sorted(tuple(r) for r in items.select(name, "symbol", "item_id", "value").filter("item_id = 1").collect()) == [
        ("good", "000001", 1, 2.0), ("good", "600000", 1, 1.0), ("odd", "000001", 1, 2.0), ("outside", "000002", 1, 3.0), ("twice", "600000", 1, 1.0), ("undated", "600000", 1, 1.0),
    ]
