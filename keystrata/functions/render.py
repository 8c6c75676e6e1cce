"""Listings and times as text, and the checks on names: built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def human_bytes(n: Column) -> Column:
    """Binary units with one decimal; a value that would show as 1024 moves up a unit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k in range(1, len(UNITS)):
        v = n / float(1024**k)
        out = F.when(n / float(1024 ** (k - 1)) >= (1024 if k == 1 else 1023.95), F.concat(F.format_string("%.1f", v), F.lit(f" {UNITS[k]}"))).otherwise(out)
    return out


def mode_string(mode: Column) -> Column:
    """``ls -l`` mode with set-id and sticky bits."""
    bit = lambda b: mode.bitwiseAND(b) != 0
    kind = F.shiftright(mode, 12).bitwiseAND(15)
    first = F.when(kind == 4, "d").when(kind == 10, "l").when(kind == 1, "p").when(kind == 12, "s").when(kind == 6, "b").when(kind == 2, "c").when(kind == 8, "-").otherwise("?")

    def run(shift: int, special: int, low: str) -> Column:
        x, s = bit(1 << shift), bit(special)
        return F.concat(
            F.when(bit(4 << shift), "r").otherwise("-"), F.when(bit(2 << shift), "w").otherwise("-"),
            F.when(x & s, low).when(s, low.upper()).when(x, "x").otherwise("-"),
        )

    return F.concat(first, run(6, 0o4000, "s"), run(3, 0o2000, "s"), run(0, 0o1000, "t"))


def size_string(mode: Column, major: Column, minor: Column, length: Column, target: Column) -> Column:
    """Device numbers, the length of a link's target, or the content length."""
    kind = F.shiftright(mode, 12).bitwiseAND(15)
    return F.when(kind.isin(2, 6), F.concat_ws(",", major, minor)).when(kind == 10, F.octet_length(target).cast("string")).otherwise(F.coalesce(length.cast("string"), F.lit("0")))


def floor_seconds(ns: Column) -> Column:
    return F.floor(ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")


def rfc3339_utc(ns: Column) -> Column:
    """Seconds since the epoch, floored also before it, as RFC 3339 in UTC (the session's zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(floor_seconds(ns)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc3339_at(ns: Column, minutes: Column) -> Column:
    away = F.abs(minutes)
    zone = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(away / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((away % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(F.timestamp_seconds(floor_seconds(ns) + minutes * 60), "yyyy-MM-dd'T'HH:mm:ss"), F.when(minutes == 0, "Z").otherwise(zone))


def parse_rfc3339(text: Column) -> Column:
    """struct(ns, tz_minutes), or null where the text is no RFC 3339 time."""
    p = r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d{1,9})\d*)?([Zz]|[+-]\d\d:\d\d)$"
    g = lambda k: F.regexp_extract(text, p, k)
    sign = F.when(F.startswith(g(4), F.lit("-")), -1).otherwise(1)
    minutes = F.when(F.lower(g(4)) == "z", 0).otherwise(sign * (g(4).substr(2, 2).try_cast("int") * 60 + g(4).substr(5, 2).try_cast("int")))
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(g(1), F.lit(" "), g(2)), F.lit("yyyy-MM-dd HH:mm:ss"))) - minutes * 60
    fraction = F.coalesce(F.rpad(g(3), 9, "0").try_cast("long"), F.lit(0))
    return F.when(text.rlike(p) & seconds.isNotNull(), F.struct((seconds * 1_000_000_000 + fraction).alias("ns"), minutes.alias("tz_minutes")))


_NS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def parse_duration(text: Column) -> Column:
    """``1h30m``-like durations to ns, or null."""
    parts = F.regexp_extract_all(text, F.lit(r"[0-9]*\.?[0-9]+(?:ns|us|µs|ms|s|m|h)|[0-9]+\.(?:ns|us|µs|ms|s|m|h)"), F.lit(0))
    units = F.create_map(*[F.lit(x).cast("string") if isinstance(x, str) else F.lit(x).cast("decimal(20,0)") for kv in _NS.items() for x in kv])
    one = lambda p: F.regexp_extract(p, r"^([0-9.]+)", 1).cast("decimal(18,9)") * F.element_at(units, F.regexp_extract(p, r"([a-zµ]+)$", 1))
    total = F.aggregate(F.transform(parts, one), F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + x).cast("decimal(38,9)"))
    sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    ok = text.rlike(r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:ns|us|µs|ms|s|m|h))+$")
    return F.when(text.rlike(r"^[+-]?0$"), F.lit(0).cast("long")).when(ok, (sign * F.floor(total)).cast("long"))


def parse_identity(text: Column) -> Column:
    """struct(name, email) from ``Name <email>``, or null."""
    p = r"^\s*([^<>]*?)\s*<([^<>]*)>\s*$"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("name"), F.regexp_extract(text, p, 2).alias("email")))


def ref_name_error(name: Column) -> Column:
    """Null for a good reference name, else what is wrong with it."""
    return F.when(F.octet_length(name) == 0, "empty").when(F.octet_length(name) > 1024, "too long").when(F.contains(name, F.lit("@")), "at sign").when(name.rlike(r"[\x00-\x1f\x7f-\x9f]"), "control character")


def ref_user_error(user: Column) -> Column:
    return F.when(F.octet_length(user) == 0, "empty").when(F.octet_length(user) > 1024, "too long").when(user.rlike(r"[\x00-\x1f\x7f-\x9f]"), "control character")


def format_mtime(ns: Column, now_ns: Column) -> Column:
    """ls-like: time of day within six months of now, else the year."""
    half_year = 182 * 86400
    age = floor_seconds(now_ns) - floor_seconds(ns)
    t = F.timestamp_seconds(floor_seconds(ns))
    return F.concat(F.date_format(t, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(t).cast("string"), 2, " "), F.lit(" "), F.when((age >= half_year) | (age < -3600), F.lpad(F.year(t).cast("string"), 5, " ")).otherwise(F.date_format(t, "HH:mm")))
