"""Problem 5: timestamps of many spellings to one unambiguous instant or day.

All formats are one regex alternation with named groups. A single ``regexp_replace`` whose replacement lists every group
takes the components of a value apart once; calendar ranges are then checked on the integers, and the instant is
assembled by integer day arithmetic. Everything is a built-in expression and stays in the JVM.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as the sources write them, German, English and French, folded to lower case.
_MONTHS = [
    "januar|jänner|january|janvier|jan|janv",
    "februar|february|février|fevrier|feb|févr|fevr",
    "märz|maerz|march|mars|mär|mar|mrz",
    "april|avril|apr|avr",
    "mai|may",
    "juni|june|juin|jun",
    "juli|july|juillet|jul|juil",
    "august|août|aout|aug",
    "september|septembre|sept|sep",
    "oktober|october|octobre|okt|oct",
    "november|novembre|nov",
    "dezember|december|décembre|decembre|dez|dec|déc",
]
# Zone abbreviations with their offsets from UTC in minutes.
_ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "wez": 0, "wet": 0, "west": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "oez": 120, "eest": 180, "oesz": 180}

_MONTH = "|".join(sorted("|".join(_MONTHS).split("|"), key=len, reverse=True))
_WEEKDAY = r"(?:\p{L}{2,10}\.?,?\s+)?"
_DATE = "|".join(
    [
        r"(?<ya>[0-9]{4})(?:-(?<ma>[0-9]{1,2})-|/(?<mb>[0-9]{1,2})/|\.(?<mc>[0-9]{1,2})\.)(?<da>[0-9]{1,2})",
        r"(?<yb>[0-9]{4})(?<md>[0-9]{2})(?<db>[0-9]{2})(?:[T ]?(?<hb>[0-9]{2})(?<ib>[0-9]{2})(?<sb>[0-9]{2})?(?:[.,][0-9]+)?)?",
        r"(?<dc>[0-9]{1,2})(?:\.\s?(?<me>[0-9]{1,2})\.\s?|/(?<mf>[0-9]{1,2})/|-(?<mg>[0-9]{1,2})-)(?<yc>[0-9]{4})",
        rf"{_WEEKDAY}(?<dd>[0-9]{{1,2}})(?:\.|st|nd|rd|th|er)?[\s-]*(?:of\s+)?(?<na>{_MONTH})\.?,?[\s-]*(?<yd>[0-9]{{4}})",
        rf"{_WEEKDAY}(?<nb>{_MONTH})\.?\s+(?<de>[0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+(?<ye>[0-9]{{4}})",
    ]
)
_TIME = r"(?:(?:\s*T\s*|,?\s+(?:um\s+|at\s+|à\s+)?)(?<ha>[0-9]{1,2})[:.h](?<ia>[0-9]{2})(?:[:.](?<sa>[0-9]{2})(?:[.,][0-9]+)?)?(?:\s*(?:Uhr|h))?)?"
_ZONE = (
    rf"(?:\s*(?:(?:UTC|GMT)?(?<os>[+\-−])(?<oh>[0-9]{{2}})(?::?(?<om>[0-9]{{2}}))?|(?<ab>{'|'.join(sorted(_ABBREVIATIONS, key=len, reverse=True))})"
    r"|(?<za>[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+)))?(?:\s*\[(?<zb>[A-Za-z0-9_+\-/]+)\])?"
)
_EPOCH = r"(?<ea>[0-9]{9,10})(?:[.,][0-9]+)?|(?<eb>[0-9]{12,13})"
_PATTERN = rf"(?iuU)^\s*(?:(?:{_DATE}){_TIME}{_ZONE}|{_EPOCH})\s*$"
_PARTS = {
    "y": "ya yb yc yd ye", "m": "ma mb mc md me mf mg", "n": "na nb", "d": "da db dc dd de", "h": "ha hb", "i": "ia ib", "s": "sa sb",
    "sign": "os", "oh": "oh", "om": "om", "ab": "ab", "zone": "za", "inner": "zb", "sec": "ea", "ms": "eb",
}
_MARK = "\u0001"
_REPLACEMENT = _MARK + _MARK.join("".join(f"${{{g}}}" for g in groups.split()) for groups in _PARTS.values())


def components(value: Column) -> Column:
    """array<string> of the parts of ``value`` in the order of ``_PARTS``, null where no format matches."""
    replaced = F.regexp_replace(value, _PATTERN, _REPLACEMENT)
    return F.when(replaced.startswith(_MARK), F.split(F.substr(replaced, F.lit(2)), _MARK, -1))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic (years from 1)."""
    y = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def _known_zone(zone: Column) -> Column:
    """The zone if it is an IANA name; one search in a constant text, since an unknown name would fail the conversion."""
    names = sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "SystemV/")))
    return F.when(F.contains(F.lit(" " + " ".join(names) + " "), F.concat(F.lit(" "), zone, F.lit(" "))), zone)


def local_to_utc(seconds: Column, zone: Column) -> Column:
    """Wall-clock seconds in ``zone`` to UTC seconds; null where the clocks skip that time, the earlier of two instants."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), zone)
    back = F.unix_seconds(F.from_utc_timestamp(utc, zone))
    return F.when(back == seconds, F.unix_seconds(utc))


def utc_to_local(seconds: Column, zone: str) -> Column:
    """UTC seconds to the wall-clock seconds of a zone."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone))


def day_text(days: Column) -> Column:
    """'YYYY-MM-DD' of days since 1970-01-01."""
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")


def instant_text(seconds: Column) -> Column:
    """'YYYY-MM-DDTHH:MM:SSZ' of UTC seconds, whatever the session's zone."""
    of_day = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(
        day_text(F.floor(seconds / 86400)), F.lit("T"), two(of_day / 3600), F.lit(":"), two(of_day % 3600 / 60), F.lit(":"), two(of_day % 60), F.lit("Z")
    )


def parsed(value: Column, default_zone: Column) -> Column:
    """struct<day bigint, utc bigint, timed boolean> of one value in any known spelling.

    ``day``: the written day as days since 1970-01-01, where the value has no time. ``utc``: the instant in seconds, where
    it has one. Values that match no format, are out of the calendar's ranges, or name a wall-clock time that does
    not exist or whose zone is unknown, give a struct of nulls. ``default_zone``: IANA name for wall clocks without zone.
    """
    number = lambda c: F.when(c != "", c.cast("int"))

    def build(c: Column) -> Column:
        part = {name: F.get(c, F.lit(i)) for i, name in enumerate(_PARTS)}
        named = F.lower(part["n"])
        month = F.coalesce(number(part["m"]), *(F.when(named.isin(names.split("|")), F.lit(i + 1)) for i, names in enumerate(_MONTHS)))
        sign = F.when(part["sign"] == "", None).when(part["sign"] == "+", 1).otherwise(-1)
        offset = sign * (number(part["oh"]) * 60 + F.coalesce(number(part["om"]), F.lit(0)))
        abbreviated = F.coalesce(*(F.when(F.lower(part["ab"]) == a, F.lit(m)) for a, m in _ABBREVIATIONS.items()))
        return F.struct(
            number(part["y"]).alias("y"), month.alias("m"), number(part["d"]).alias("d"), number(part["h"]).alias("h"), number(part["i"]).alias("i"),
            F.coalesce(number(part["s"]), F.lit(0)).alias("s"), F.coalesce(offset, abbreviated).alias("offset"),
            (F.coalesce(number(part["oh"]), F.lit(0)) <= 18).alias("sane"), (F.coalesce(number(part["om"]), F.lit(0)) < 60).alias("sane_minutes"),
            F.coalesce(F.when(part["zone"] != "", part["zone"]), F.when(part["inner"] != "", part["inner"])).alias("zone"),
            F.coalesce(F.when(part["sec"] != "", part["sec"].cast("bigint")), F.when(part["ms"] != "", F.floor(part["ms"].cast("bigint") / 1000))).alias("epoch"),
        )

    def check(p: Column) -> Column:
        leap = ((p["y"] % 4 == 0) & (p["y"] % 100 != 0)) | (p["y"] % 400 == 0)
        longest = F.when(p["m"] == 2, F.when(leap, 29).otherwise(28)).when(p["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        whole = (p["y"] >= 1) & p["m"].between(1, 12) & p["d"].between(1, longest)
        timed = p["h"].isNotNull()
        sound = whole & (~timed | ((p["h"] < 24) & (p["i"] < 60) & (p["s"] < 60) & p["sane"] & p["sane_minutes"]))
        day = F.when(sound, days_from_civil(p["y"], p["m"], p["d"]))
        return F.struct(
            F.when(~timed, day).alias("day"),
            F.when(timed, day * 86400 + p["h"] * 3600 + p["i"] * 60 + p["s"]).alias("wall"),
            p["offset"].alias("offset"),
            p["zone"].alias("zone"),
            p["epoch"].alias("epoch"),
        )

    def place(p: Column) -> Column:
        zone = F.coalesce(p["zone"], default_zone)
        utc = F.when(p["epoch"].isNotNull(), p["epoch"]).when(p["offset"].isNotNull(), p["wall"] - p["offset"] * 60).otherwise(local_to_utc(p["wall"], _known_zone(zone)))
        return F.struct(p["day"].alias("day"), utc.alias("utc"))

    # Each step is bound once through a one-element array, so no component is computed twice.
    step = F.transform(F.array(components(value)), build)
    step = F.transform(F.transform(step, check), place)
    return F.get(step, F.lit(0))
