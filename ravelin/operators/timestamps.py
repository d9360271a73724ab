"""Mixed timestamp spellings and zones -> one UTC instant, or a mark that there is none.

Method: an as-of join of parsed local times to exploded zone-offset intervals. Every zone is a list of
intervals with one offset; in local time neighbouring intervals overlap (clocks set back) or leave a gap
(clocks set forward). A local time in two intervals is ambiguous, in none nonexistent, in one it gets the
offset directly. The intervals are exploded to (zone, year) so that the join is an equi-join with a short
list to search; their number is bounded by zones x years, so the broadcast doesn't grow with the data.

Everything runs JVM-side: one chain of built-in expressions for each value and two broadcast joins, no shuffle.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Years covered by the zone intervals. No zone changed before them, and later years follow the rules of the last one:
#: a year that begins on the same day of the week and is as long stands in for each of them.
FIRST_YEAR, LAST_YEAR = 1830, 2100
#: Length of a bucket of the exploded intervals, in seconds (a mean Gregorian year).
BUCKET_S = 31_556_952
FIRST_BUCKET = int(datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp()) // BUCKET_S
#: Local seconds before any interval.
FOREVER = 1 << 60
#: IANA has about 600 zone names; a table of sources with more zones than this is refused.
MAX_ZONES = 2_000
MAX_SOURCES = 100_000

#: Month names and their usual short forms in the languages of the sources.
MONTHS = {
    "JANUARY": 1, "FEBRUARY": 2, "MARCH": 3, "APRIL": 4, "MAY": 5, "JUNE": 6,
    "JULY": 7, "AUGUST": 8, "SEPTEMBER": 9, "OCTOBER": 10, "NOVEMBER": 11, "DECEMBER": 12,
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "JUN": 6, "JUL": 7,
    "AUG": 8, "SEP": 9, "SEPT": 9, "OCT": 10, "NOV": 11, "DEC": 12,
    "JANUAR": 1, "JÄNNER": 1, "FEBRUAR": 2, "MÄRZ": 3, "MAI": 5, "JUNI": 6,
    "JULI": 7, "OKTOBER": 10, "DEZEMBER": 12, "MÄR": 3, "OKT": 10, "DEZ": 12,
    "JANVIER": 1, "FÉVRIER": 2, "MARS": 3, "AVRIL": 4, "JUIN": 6,
    "JUILLET": 7, "AOÛT": 8, "SEPTEMBRE": 9, "OCTOBRE": 10, "NOVEMBRE": 11, "DÉCEMBRE": 12,
    "JANV": 1, "FÉVR": 2, "AVR": 4, "JUIL": 7, "DÉC": 12,
    "ENERO": 1, "FEBRERO": 2, "MARZO": 3, "ABRIL": 4, "MAYO": 5, "JUNIO": 6,
    "JULIO": 7, "AGOSTO": 8, "SEPTIEMBRE": 9, "OCTUBRE": 10, "NOVIEMBRE": 11, "DICIEMBRE": 12,
    "JANEIRO": 1, "FEVEREIRO": 2, "MARÇO": 3, "MAIO": 5, "JUNHO": 6,
    "JULHO": 7, "SETEMBRO": 9, "OUTUBRO": 10, "NOVEMBRO": 11, "DEZEMBRO": 12,
}

_TIME = r"(?:[T ,]*(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,]\d+)?)?\s*(AM|PM|A\.M\.|P\.M\.)?)?"
_ZONE = r"\s*(Z|[A-Z]{2,6}|(?:UTC|GMT)?[+\-−]\d{1,2}(?::?\d{2})?)?\s*(?:\[([^\]]+)\])?"
_TAIL = _TIME + _ZONE + "$"
#: (pattern, order of its first three groups); the next groups are hour, minute, second, half of day, zone, zone name.
_FORMS = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TAIL, "YMD"),
    (r"^(\d{4})(\d{2})(\d{2})[T ](\d{2}):?(\d{2}):?(\d{2})?(?:[.,]\d+)?()" + _ZONE + "$", "YMD"),
    (r"^(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日" + _TAIL, "YMD"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _TAIL, "?"),
    (r"^(?:\p{L}{2,12}\.?,?\s+)?(\d{1,2})(?:\.|ST|ND|RD|TH|ER)?[ \-](?:DE )?(\p{L}{3,12})\.?,?[ \-](?:DE )?(\d{4})" + _TAIL, "DMY"),
    (r"^(?:\p{L}{2,12}\.?,\s+)?(\p{L}{3,12})\.?\s+(\d{1,2})(?:ST|ND|RD|TH)?,?\s+(\d{4})" + _TAIL, "MDY"),
)


@lru_cache(maxsize=MAX_ZONES)
def _spans(name: str, first: int, last: int) -> tuple[tuple[int, int, int, str], ...]:
    """(begin, end, offset, abbreviation) of a zone's intervals in UTC seconds, none for an unknown name."""
    try:
        zone = ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return ()
    zero = datetime(1970, 1, 1, tzinfo=zone)

    def at(s: int) -> tuple[timedelta, str]:
        d = zone.fromutc(zero + timedelta(seconds=s))
        return d.utcoffset(), d.tzname() or ""

    begun = int(datetime(first, 1, 1, tzinfo=timezone.utc).timestamp())
    final, step = int(datetime(last + 1, 1, 1, tzinfo=timezone.utc).timestamp()), 14 * 86_400
    spans, state, t = [], at(begun), begun
    while t < final:
        nxt = min(t + step, final)
        if at(nxt) == state:
            t = nxt
            continue
        a, b = t, nxt
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if at(mid) == state else (a, mid)
        spans.append((begun, b, int(state[0].total_seconds()), state[1]))
        begun, state, t = b, at(b), b
    return (*spans, (begun, final, int(state[0].total_seconds()), state[1]))


def zone_intervals(zones: list[str], first: int = FIRST_YEAR, last: int = LAST_YEAR) -> list[tuple]:
    """(tz, bucket, [(lo, hi, off, abbr)]): the offset intervals of each zone in local seconds, exploded to years.

    Zone names come out in capitals. The first interval of a zone has no beginning. An unknown zone name gives no
    interval, so its local times get no instant.
    """
    out: dict[tuple[str, int], list[tuple]] = {}
    for name in sorted(set(zones)):
        for i, (u, v, off, abbr) in enumerate(_spans(name, first, last)):
            begin = u + off if i else -FOREVER
            for bucket in range(max(FIRST_BUCKET, begin // BUCKET_S), (v + off - 1) // BUCKET_S + 1):
                out.setdefault((name.upper(), bucket), []).append((begin, v + off, off, abbr))
    return [(tz, bucket, spans) for (tz, bucket), spans in out.items()]


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("off", pa.int64()), ("abbr", pa.string())]))
_INTERVALS = "zi_tz string, zi_bucket bigint, zi_spans array<struct<lo:bigint,hi:bigint,off:bigint,abbr:string>>"


def _interval_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    tz, bucket, spans = zip(*rows, strict=True)
    lists = pa.array([[dict(zip(("lo", "hi", "off", "abbr"), x, strict=True)) for x in own] for own in spans], _SPANS)
    return spark.createDataFrame(pa.table({"zi_tz": pa.array(tz), "zi_bucket": pa.array(bucket, pa.int64()), "zi_spans": lists}), _INTERVALS)


def _abbreviations(rows: list[tuple]) -> list[tuple[str, dict[str, int]]]:
    """(tz, {abbreviation: its latest offset})."""
    seen: dict[str, dict[str, tuple[int, int]]] = {}
    for tz, _, spans in rows:
        for lo, _, off, abbr in spans:
            best = seen.setdefault(tz, {}).get(abbr.upper())
            if best is None or lo > best[0]:
                seen[tz][abbr.upper()] = (lo, off)
    return [(tz, {a: v[1] for a, v in d.items()}) for tz, d in seen.items()]


class ZoneTable:
    """Zones of the sources: src -> tz, order of numeric dates, offsets of abbreviations; and the exploded intervals.

    ``sources`` has the columns src, tz, date_order. It is read to the driver only for its distinct zone names,
    of which there are at most MAX_ZONES. Of repeated ``src`` the smallest (tz, date_order) counts. ``values`` is a
    column of raw values (as a DataFrame), whose bracketed IANA names, such as ``[Europe/Berlin]``, are added.
    """

    def __init__(self, spark: SparkSession, sources: DataFrame, values: DataFrame | None = None):
        names = sources.select(F.trim("tz").alias("tz")).where(F.col("tz").isNotNull())
        if values is not None:
            raw = F.col(f"`{values.columns[0]}`")
            named = values.where(raw.contains("[")).select(F.regexp_extract(raw, r"\[([^\]]+)\]", 1).alias("tz"))
            names = names.unionByName(named.where(F.array_contains(F.split(F.lit(" ".join(sorted(available_timezones()))), " "), F.col("tz"))))
        found = [r[0] for r in names.distinct().limit(MAX_ZONES + 1).collect()]
        if len(found) > MAX_ZONES:
            raise ValueError(f"more than {MAX_ZONES} zones")
        rows = zone_intervals([*found, "UTC"])
        self.intervals = F.broadcast(_interval_table(spark, rows))
        abbr = _abbreviations(rows)
        named = sources.groupBy("src").agg(F.min(F.struct(F.upper(F.trim("tz")).alias("tz"), F.upper(F.trim("date_order")).alias("o"))).alias("z"))
        named = named.select(F.col("src").alias("zs_src"), F.col("z.tz").alias("zs_tz"), F.col("z.o").alias("zs_order"))
        few = named.limit(MAX_SOURCES + 1).collect()
        if len(few) <= MAX_SOURCES:  # as a rule: a local table makes the plan of each use short
            by_zone = dict(abbr)
            local = [(*r, by_zone.get(r["zs_tz"])) for r in few]
            self.sources = F.broadcast(spark.createDataFrame(local, "zs_src string, zs_tz string, zs_order string, zs_abbr map<string,bigint>"))
        else:
            zones = spark.createDataFrame(abbr, "zs_tz string, zs_abbr map<string,bigint>")
            self.sources = named.join(F.broadcast(zones), "zs_tz", "left")


def _years_alike() -> str:
    """Day number of 1 January of a year before LAST_YEAR for each (weekday of 1 January, leap year or not), as SQL."""
    out = [0] * 14
    for year in range(LAST_YEAR - 28, LAST_YEAR):
        first = date(year, 1, 1)
        out[2 * first.weekday() + ((date(year + 1, 1, 1) - first).days - 365)] = (first - date(1970, 1, 1)).days
    return f"array({', '.join(map(str, out))})"


def _chain() -> list[dict[str, str]]:
    """The steps from a value (``_ts_v``, trimmed and in capitals) to its local time, as SQL; each step sees the former ones."""
    forms = "\n".join(f"WHEN _ts_v RLIKE r'{p}' THEN concat({'coalesce(zs_order, {})'.format(repr('DMY')) if o == '?' else repr(o)}, regexp_replace(_ts_v, r'{p}', '|$1|$2|$3|$4|$5|$6|$7|$8|$9'))" for p, o in _FORMS)
    months = f"str_to_map('{','.join(f'{k}:{v}' for k, v in MONTHS.items())}')"
    first = "make_date(_ts_y, 1, 1)"
    later = f"unix_date({first}) - element_at({_years_alike()}, 2 * weekday({first}) + datediff(make_date(_ts_y + 1, 1, 1), {first}) - 364)"
    return [
        {"_ts_n": r"regexp_extract(_ts_v, r'^(\d+)(?:\.\d+)?$', 1)", "_ts_p": rf"split(CASE {forms} END, r'\|', -1)"},
        # a four-digit last part is the year, whatever the source's order is
        {"_ts_o": "CASE WHEN _ts_p[0] = 'YMD' AND length(_ts_p[1]) <= 2 AND length(_ts_p[3]) = 4 THEN 'DMY' ELSE _ts_p[0] END",
         "_ts_zone": "regexp_replace(replace(_ts_p[8], '−', '-'), '^(?:UTC|GMT)(?=[+-])', '')", "_ts_half": "replace(_ts_p[7], '.', '')", "_ts_h": "try_cast(_ts_p[4] AS INT)", "_ts_mi": "try_cast(_ts_p[5] AS INT)", "_ts_s": "coalesce(try_cast(_ts_p[6] AS INT), 0)"},
        {"_ts_ys": "CASE WHEN _ts_o = 'YMD' THEN _ts_p[1] ELSE _ts_p[3] END", "_ts_ms": "CASE WHEN _ts_o = 'MDY' THEN _ts_p[1] ELSE _ts_p[2] END", "_ts_ds": "CASE _ts_o WHEN 'YMD' THEN _ts_p[3] WHEN 'MDY' THEN _ts_p[2] ELSE _ts_p[1] END", "_ts_digits": "translate(_ts_zone, '+-:', '')"},
        {"_ts_y": "try_cast(_ts_ys AS INT) + CASE WHEN length(_ts_ys) > 2 THEN 0 WHEN try_cast(_ts_ys AS INT) < 70 THEN 2000 ELSE 1900 END",
         "_ts_m": rf"CASE WHEN _ts_ms RLIKE r'^\d+$' THEN _ts_ms ELSE element_at({months}, _ts_ms) END", "_ts_d4": "CASE WHEN length(_ts_digits) <= 2 THEN lpad(_ts_digits, 2, '0') || '00' ELSE lpad(_ts_digits, 4, '0') END",
         "_ts_hour": "CASE WHEN _ts_half = '' THEN _ts_h WHEN _ts_h BETWEEN 1 AND 12 THEN _ts_h % 12 + CASE _ts_half WHEN 'PM' THEN 12 ELSE 0 END END"},
        {"_ts_day": "unix_date(try_cast(concat_ws('-', lpad(_ts_y, 4, '0'), lpad(_ts_m, 2, '0'), lpad(_ts_ds, 2, '0')) AS DATE))", "_ts_off": "try_cast(substr(_ts_d4, 1, 2) AS INT) * 3600 + try_cast(substr(_ts_d4, 3, 2) AS INT) * 60",
         "_ts_clock": "CASE WHEN _ts_h IS NULL THEN 0 WHEN _ts_hour < 24 AND _ts_mi < 60 AND _ts_s < 60 THEN _ts_hour * 3600 + _ts_mi * 60 + _ts_s END"},
        {"_ts_local": "CASE WHEN _ts_y IS NOT NULL AND _ts_m IS NOT NULL AND _ts_ds IS NOT NULL THEN _ts_day * 86400L + _ts_clock END",
         # days between a late year and the one that stands in for it
         "_ts_later": f"CASE WHEN _ts_day IS NOT NULL AND _ts_y >= {LAST_YEAR} THEN ({later}) * 86400L ELSE 0L END",
         "_ts_fixed": r"CASE WHEN _ts_zone IN ('Z', 'UTC', 'UT') THEN 0 WHEN _ts_zone RLIKE r'^[+-]\d' AND _ts_off <= 64800 THEN CASE WHEN _ts_zone LIKE '-%' THEN -_ts_off ELSE _ts_off END END",
         "_ts_abbr": "CASE WHEN _ts_zone RLIKE '^[A-Z]{2,6}$' AND _ts_zone NOT IN ('UTC', 'UT') THEN _ts_zone END",
         "_ts_tz": "CASE WHEN coalesce(_ts_zone, '') = '' AND _ts_p[9] <> '' THEN _ts_p[9] ELSE zs_tz END"},
        {"_ts_at": "_ts_local - _ts_later"},
        {"_ts_b": f"greatest({FIRST_BUCKET}L, floor(_ts_at / {BUCKET_S}))"},
    ]


#: The steps from the intervals of a value's zone and year to its instant.
_JUDGED = [
    {"_ts_hits": "coalesce(filter(zi_spans, x -> x.lo <= _ts_at AND _ts_at < x.hi), array())"},
    {"_ts_named": "filter(_ts_hits, x -> upper(x.abbr) = _ts_abbr)"},
    {"_ts_off": "CASE WHEN _ts_fixed IS NOT NULL THEN _ts_fixed WHEN _ts_abbr IS NOT NULL THEN CASE WHEN size(_ts_named) = 1 THEN _ts_named[0].off ELSE coalesce(zs_abbr[_ts_abbr], CASE WHEN _ts_abbr = 'GMT' THEN 0 END) END "
                "WHEN _ts_zone = '' AND size(_ts_hits) = 1 THEN _ts_hits[0].off END",
     "_ts_epoch": "CASE WHEN length(_ts_n) BETWEEN 1 AND 11 THEN try_cast(_ts_n AS BIGINT) WHEN length(_ts_n) BETWEEN 12 AND 17 THEN try_cast(_ts_n AS BIGINT) DIV 1000 END"},
    {"_ts_t": "coalesce(_ts_epoch, _ts_local - _ts_off)"},
    {"_ts_state": "CASE WHEN _ts_v IS NULL OR _ts_v = '' THEN 'missing' WHEN _ts_t IS NOT NULL THEN 'ok' WHEN _ts_local IS NULL OR _ts_zone <> '' THEN 'unreadable' WHEN size(_ts_hits) > 1 THEN 'ambiguous' WHEN zi_spans IS NOT NULL THEN 'nonexistent' ELSE 'unreadable' END"},
]


def add_instants(df: DataFrame, zones: ZoneTable, values: dict[str, str], src: str = "src") -> DataFrame:
    """Add for each ``values`` item (output name -> column of raw text) a BIGINT column of UTC seconds.

    Null where the value is null, blank, or gives no single instant; ``<name>_state`` tells which of
    ``ok``, ``missing``, ``unreadable``, ``ambiguous``, ``nonexistent`` holds. Rules: a value with an offset
    or zone is read by it (abbreviations mean those of the source's zone, and decide a repeated hour); bare
    digits are seconds, from 12 digits on milliseconds, since 1970 UTC; other values are local time of the
    zone named in brackets or of the source's, a date alone 00:00; fractions are dropped. A row whose ``src`` is
    unknown keeps its row and gets instants only from values that carry their own zone. Nothing is dropped or
    repeated; columns of the input keep their names (those starting with ``zi_``/``zs_``/``_ts`` are reserved).
    """
    keep = df.columns
    out = df.join(zones.sources, F.col(src) == F.col("zs_src"), "left")
    for name, raw in values.items():
        out = out.withColumn("_ts_v", F.upper(F.regexp_replace(F.col(f"`{raw}`"), r"(?U)^\s+|\s+$", "")))
        for step in _chain():
            out = out.withColumns({c: F.expr(e) for c, e in step.items()})
        out = out.join(zones.intervals, (F.col("_ts_tz") == F.col("zi_tz")) & (F.col("_ts_b") == F.col("zi_bucket")), "left")
        for step in _JUDGED:
            out = out.withColumns({c: F.expr(e) for c, e in step.items()})
        out = out.select(*[F.col(f"`{c}`") for c in keep], F.col("_ts_t").alias(name), F.col("_ts_state").alias(f"{name}_state"), "zs_tz", "zs_order", "zs_abbr")
        keep = [*keep, name, f"{name}_state"]
    return out.drop("zs_tz", "zs_order", "zs_abbr")


def no_instant(state: str) -> Column:
    """True where a value is there but gives no single instant."""
    return ~F.col(state).isin("ok", "missing")


def stacked(tickets: DataFrame, records: DataFrame) -> DataFrame:
    """(tbl, seq, field, src, line, kind, raw): a row for each value of the three columns, so that one chain reads them all."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in ("created_at", "closed_at")])
    own = tickets.select(F.lit("tickets").alias("tbl"), "seq", "src", "line", F.lit("tickets").alias("kind"), F.inline(cells))
    return own.unionByName(records.select(F.lit("records").alias("tbl"), "seq", "src", "line", "kind", F.lit("date").alias("field"), F.col("date").alias("raw")))


def time_faults(tickets: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """(tbl, seq, field) of the values without a single instant and of those that contradict another value.

    Each value is read once. What can't contradict anything (work orders with an instant) ends there; the rest, narrow
    rows, is shuffled once, hashed on (src, line), a unique key, so no key is hot; rows without one are spread by their
    number. Where (src, line) repeats in tickets the record is compared with all of them. Null and blank values are no
    cases; repeated rows are cases each.
    """
    values = stacked(tickets, records)
    v = add_instants(values, ZoneTable(tickets.sparkSession, sources, values.select("raw")), {"_t": "raw"})
    bad, t, field = no_instant("_t_state"), F.col("_t"), F.col("field")
    v = v.where(bad | (t.isNotNull() & (F.col("kind") == "tickets")))
    v = v.select("tbl", "seq", "field", "src", "line", "_t", bad.alias("_bad"), F.when(F.col("src").isNull() | F.col("line").isNull(), F.col("seq")).alias("_lone"))
    begun = F.when(field == "created_at", t)
    of_line, of_row = Window.partitionBy("src", "line", "_lone"), Window.partitionBy("src", "line", "_lone", "tbl", "seq")
    v = v.withColumn("_lo", F.min(begun).over(of_line)).withColumn("_hi", F.max(begun).over(of_line))
    v = v.withColumn("_own", F.max(begun).over(of_row))
    early = (field == "closed_at") & (t < F.col("_own"))
    differs = (field == "date") & F.col("_lone").isNull() & ((t != F.col("_lo")) | (t != F.col("_hi")))
    return v.where(F.col("_bad") | F.coalesce(early, F.lit(False)) | F.coalesce(differs, F.lit(False))).select("tbl", "seq", "field")


def instants(tickets: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """(tbl, seq, field, instant, state): every value of the three columns in its one UTC form ``yyyy-MM-ddTHH:mm:ssZ``."""
    values = stacked(tickets, records)
    v = add_instants(values, ZoneTable(tickets.sparkSession, sources, values.select("raw")), {"_t": "raw"})
    text = F.concat(F.replace(F.substring(F.timestamp_seconds("_t").cast("timestamp_ntz").cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))
    return v.select("tbl", "seq", "field", text.alias("instant"), F.col("_t_state").alias("state"))
