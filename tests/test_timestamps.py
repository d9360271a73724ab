"""Instants against an independent reading of the same spellings with zoneinfo, and the defined odd cases."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from ravelin.operators import timestamps as ts

ZONES = {"berlin": ("Europe/Berlin", "DMY"), "york": ("America/New_York", "MDY"), "howe": ("Australia/Lord_Howe", "DMY"), "valley": ("Asia/Kathmandu", "YMD"), "tokyo": ("Asia/Tokyo", "YMD")}


@pytest.fixture(scope="module")
def zones(spark):
    rows = [(s, tz, o) for s, (tz, o) in ZONES.items()]
    return ts.ZoneTable(spark, spark.createDataFrame(rows, "src string, tz string, date_order string"))


def read(spark, zones, values):
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(values)], "i int, src string, v string")
    rows = {r["i"]: r for r in ts.add_instants(df, zones, {"x": "v"}).collect()}
    assert len(rows) == len(values)
    return [(rows[i]["x"], rows[i]["x_state"]) for i in range(len(values))]


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


def test_spellings(spark, zones):
    cases = {
        ("berlin", "2024-03-11T14:20:00Z"): utc(2024, 3, 11, 14, 20),
        ("berlin", " 2024-03-11t14:20:00.123z "): utc(2024, 3, 11, 14, 20),
        ("berlin", "2024-03-11 14:20"): utc(2024, 3, 11, 13, 20),
        ("york", "2024-03-11 14:20:05,999999-04:00"): utc(2024, 3, 11, 18, 20, 5),
        ("york", "3/4/2024 2:15 PM"): utc(2024, 3, 4, 19, 15),
        ("york", "3/4/24 12:05:01 AM"): utc(2024, 3, 4, 5, 5, 1),
        ("berlin", "04.03.2024 02:15:00"): utc(2024, 3, 4, 1, 15),
        ("berlin", "03/04/2024"): utc(2024, 4, 2, 22),
        ("valley", "2024/03/04 00:45:00"): utc(2024, 3, 3, 19),
        ("berlin", "15. März 2024 16:07"): utc(2024, 3, 15, 15, 7),
        ("berlin", "5 décembre 2025 02:43"): utc(2025, 12, 5, 1, 43),
        ("york", "Jun 1, 2025 16:03:32"): utc(2025, 6, 1, 20, 3, 32),
        ("york", "17 Jul 2022 12:47:22 EDT"): utc(2022, 7, 17, 16, 47, 22),
        ("york", "2024-11-03 01:30:00 EST"): utc(2024, 11, 3, 6, 30),
        ("york", "2024-11-03 01:30:00 EDT"): utc(2024, 11, 3, 5, 30),
        ("berlin", "2024-10-27T02:30:00+02:00[Europe/Berlin]"): utc(2024, 10, 27, 0, 30),
        ("berlin", "Sat, 12 Oct 2024 03:38:04 +0200"): utc(2024, 10, 12, 1, 38, 4),
        ("tokyo", "2023年4月11日 01:59:39"): utc(2023, 4, 10, 16, 59, 39),
        ("howe", "2024-07-01T10:10:30+10:30[Australia/Lord_Howe]"): utc(2024, 6, 30, 23, 40, 30),
        ("tokyo", "20220423T060012Z"): utc(2022, 4, 23, 6, 0, 12),
        ("tokyo", "1753878019"): 1753878019,
        ("tokyo", "1668156150825"): 1668156150,
        ("valley", "2024-08-16T17:43:56+0545"): utc(2024, 8, 16, 11, 58, 56),
        ("tokyo", "2024-08-16T17:43:56+09"): utc(2024, 8, 16, 8, 43, 56),
        ("nowhere", "2024-08-16T17:43:56+09"): utc(2024, 8, 16, 8, 43, 56),
    }
    got = read(spark, zones, list(cases))
    assert [(k, g[0]) for k, g in zip(cases, got, strict=True)] == list(cases.items())
    assert {g[1] for g in got} == {"ok"}


def test_years_beyond_the_intervals(spark, zones):
    """Later years follow the last rules, earlier ones the first offset; zoneinfo is the judge."""
    values, expected = [], []
    for src in ("berlin", "york", "howe"):
        zone = ZoneInfo(ZONES[src][0])
        for y in (1, 99, 1000, 1850, 1899, 2099, 2100, 2101, 2150, 2400, 2777, 9998):
            for m, d in ((1, 1), (5, 1), (12, 31)):
                at = datetime(y, m, d, 23, 30)
                values.append((src, f"{y:04}-{m:02}-{d:02} 23:30"))
                expected.append(int((at - datetime(1970, 1, 1)).total_seconds() - at.replace(tzinfo=zone).utcoffset().total_seconds()))
    got = read(spark, zones, values)
    assert [(v, g[0]) for v, g in zip(values, got, strict=True)] == list(zip(values, expected, strict=True))
    assert read(spark, zones, [("berlin", "2150-03-29 02:30"), ("berlin", "2150-10-25 02:30")]) == [(None, "nonexistent"), (None, "ambiguous")]


def test_bracketed_zone_beyond_the_sources(spark):
    sources = spark.createDataFrame([("berlin", "Europe/Berlin", "DMY")], "src string, tz string, date_order string")
    df = spark.createDataFrame([(0, "berlin", "2024-03-01 10:00 [America/New_York]"), (1, "berlin", "2024-11-03 01:30[America/New_York]"), (2, "berlin", "2024-03-01 10:00 [No/Where]"), (3, "x", "2024-03-01 10:00 [Asia/Tokyo]")], "i int, src string, v string")
    rows = ts.add_instants(df, ts.ZoneTable(spark, sources, df.select("v")), {"x": "v"}).orderBy("i").collect()
    assert [(r["x"], r["x_state"]) for r in rows] == [(utc(2024, 3, 1, 15), "ok"), (None, "ambiguous"), (None, "unreadable"), (utc(2024, 3, 1, 1), "ok")]


def test_no_single_instant(spark, zones):
    cases = {
        ("berlin", "2024-10-27 02:30"): "ambiguous", ("berlin", "2024-03-31 02:30"): "nonexistent", ("howe", "2023-04-02 01:45"): "ambiguous",
        ("howe", "2024-10-06 02:15"): "nonexistent", ("york", "11/3/2024 1:30 AM"): "ambiguous", ("berlin", "2024-02-30 10:00"): "unreadable",
        ("berlin", "2024-01-01 25:00"): "unreadable", ("berlin", "2024-18-11T00:57:00Z"): "unreadable", ("berlin", "0000-00-00 00:00:00"): "unreadable",
        ("berlin", "last Tuesday"): "unreadable", ("berlin", "2024-05"): "unreadable", ("berlin", "13:57"): "unreadable", ("york", "3/4/2024 13:15 PM"): "unreadable",
        ("nowhere", "2024-01-01 10:00"): "unreadable", ("berlin", ""): "missing", ("berlin", " \t"): "missing", ("berlin", None): "missing", (None, None): "missing",
        ("berlin", "x" * 100_000): "unreadable", ("berlin", "9" * 40): "unreadable",
    }
    got = read(spark, zones, list(cases))
    assert [(k, g[1]) for k, g in zip(cases, got, strict=True)] == list(cases.items())
    assert all(g[0] is None for g in got)


def test_local_times_against_zoneinfo(spark, zones):
    """Every half hour around the clock changes of two years, by trying both folds."""
    values, expected = [], []
    for src, (name, _) in ZONES.items():
        zone = ZoneInfo(name)
        at = datetime(2024, 1, 1)
        while at < datetime(2026, 1, 1):
            a, b = (at.replace(tzinfo=zone, fold=f) for f in (0, 1))
            real = [x for x in (a, b) if x.astimezone(timezone.utc).astimezone(zone).replace(tzinfo=None) == at]
            found = {x.astimezone(timezone.utc) for x in real}
            near = a.utcoffset() != b.utcoffset()
            if near or at.day == 1 and at.hour == 0:
                values.append((src, at.strftime("%Y-%m-%d %H:%M")))
                expected.append(int(found.pop().timestamp()) if len(found) == 1 else None)
            at += timedelta(minutes=30)
    assert [g[0] for g in read(spark, zones, values)] == expected
    assert None in expected


TICKETS = "seq long, src string, line long, created_at string, closed_at string, zs_tz string, _ts_v string"
RECORDS = "seq long, kind string, src string, line long, date string, grp string"


def faults(spark, tickets, records):
    sources = spark.createDataFrame([("berlin", "Europe/Berlin", "DMY", 1)], "src string, tz string, date_order string, zs_src int")
    got = ts.time_faults(spark.createDataFrame(tickets, TICKETS), spark.createDataFrame(records, RECORDS), sources)
    return sorted(map(tuple, got.collect()))


def test_faults(spark):
    tickets = [
        (1, "berlin", 1, "2024-01-01 10:00", "2024-01-01T08:59:59Z", "x", "y"), (2, "berlin", 2, "soon", None, None, None),
        (3, "berlin", 3, "2024-01-01 10:00", "2024-01-01T09:00:00.5Z", None, None), (4, None, None, None, None, None, None), (5, "berlin", 5, "2024-01-02", "n/a", None, None),
    ]
    records = [
        (1, "tickets", "berlin", 1, "2024-01-01T09:00:00Z", None), (2, "tickets", "berlin", 2, "2024-01-01T09:00:00Z", None), (3, "tickets", "berlin", 3, "2024-01-01T09:00:01Z", None),
        (4, "jobs", "berlin", 3, "2024-01-01T09:00:01Z", None), (5, "jobs", "berlin", 9, "week 3", None), (6, None, None, None, None, None), (7, "tickets", "berlin", 5, "1704150000", None),
    ]
    assert faults(spark, tickets, records) == [("records", 3, "date"), ("records", 5, "date"), ("tickets", 1, "closed_at"), ("tickets", 2, "created_at"), ("tickets", 5, "closed_at")]
    assert faults(spark, [], []) == []
    # repeated rows are cases each; a repeated (src, line) compares with all of its tickets and gives the record once
    assert faults(spark, [tickets[0], tickets[0], (9, "berlin", 1, "2024-05-05", None, None, None)], [records[0]]) == [("records", 1, "date"), ("tickets", 1, "closed_at"), ("tickets", 1, "closed_at")]


def test_instants_text(spark):
    sources = spark.createDataFrame([("berlin", "Europe/Berlin", "DMY")], "src string, tz string, date_order string")
    t = spark.createDataFrame([(1, "berlin", 1, "2024-07-01", None, None, None)], TICKETS)
    got = {tuple(r) for r in ts.instants(t, spark.createDataFrame([], RECORDS), sources).collect()}
    assert got == {("tickets", 1, "created_at", "2024-06-30T22:00:00Z", "ok"), ("tickets", 1, "closed_at", None, "missing")}
