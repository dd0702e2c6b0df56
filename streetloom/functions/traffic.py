"""Time-of-day speeds as Columns: days, times, rates, road classes, buckets of the week, checks of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import CLASS_KPH

# A week in buckets of five minutes from Sunday 00:00, and limits of rates.
DAYS = {"su": 0, "mo": 1, "tu": 2, "we": 3, "th": 4, "fr": 5, "sa": 6}
MINUTES, DAY, WEEK = 5, 288, 2016
FACTOR, SPEED = (0.05, 2.0), (1.0, 200.0)
DIRECTIONS = ("both", "forward", "backward")


def days(text: Column) -> Column:
    """'Mo-Fr', 'Sa,Su', 'Fr-Mo' as sorted day numbers, Sunday 0; null if it isn't such a list."""
    number = F.create_map(*(F.lit(v) for k, d in DAYS.items() for v in (k, d)))
    name = "(su|mo|tu|we|th|fr|sa)"
    clean = F.lower(F.replace(text, F.lit(" "), F.lit("")))

    def span(part: Column) -> Column:
        first, last = number[F.substring(part, 1, 2)], number[F.substring(part, -2, 2)]
        return F.transform(F.sequence(first, first + F.pmod(last - first, F.lit(7))), lambda d: F.pmod(d, F.lit(7)))

    return F.when(clean.rlike(f"^{name}(-{name})?(,{name}(-{name})?)*$"), F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(clean, ","), span)))))


def time_range(text: Column) -> Column:
    """'07:00-09:30' as a struct of start and end minutes; end before start runs past midnight; null if it is no such range.

    Times lie on five-minute marks and differ. 00:00-24:00 ends at 0, the whole day.
    """
    h1, m1, h2, m2 = (F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})\s*$", k).try_cast("int") for k in (1, 2, 3, 4))
    start, end = h1 * 60 + m1, h2 * 60 + m2
    ok = (h1 <= 23) & (m1 <= 59) & (m2 <= 59) & (end <= 1440) & (start % MINUTES == 0) & (end % MINUTES == 0) & (start != end)
    return F.when(ok, F.struct(start.alias("start"), F.when((start == 0) & (end == 1440), 0).otherwise(end).alias("end")))


def road_class(highway: Column) -> Column:
    return F.regexp_replace(highway, "_link$", "")


def roads(values: Column) -> Column:
    """Road classes in lower case without links; ['all'] if all is among them; null if one is unknown or none is given."""
    low = F.transform(values, lambda v: F.lower(F.trim(v)))
    known = F.forall(low, lambda v: v.isin(*CLASS_KPH))
    return F.when(F.array_contains(low, "all"), F.array(F.lit("all"))).when((F.size(low) > 0) & known, F.array_distinct(F.transform(low, road_class)))


def covers(values: Column, highway: Column) -> Column:
    return F.coalesce(F.array_contains(values, "all") | F.array_contains(values, road_class(highway)), F.lit(False))


def number(text: Column) -> Column:
    """Text as a number, decimal comma allowed; null if it isn't one or is NaN."""
    return F.nullif(F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double"), F.lit(float("nan")))


def empty(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | (F.lower(F.trim(text)) == "nan")


def rate(factor: Column, speed: Column) -> Column:
    """Struct of factor and speed, one of them set and within its limits; null otherwise."""
    f, s = number(factor), number(speed)
    fine = (~empty(factor) & empty(speed) & f.between(*FACTOR)) | (empty(factor) & ~empty(speed) & s.between(*SPEED))
    return F.when(fine, F.struct(f.alias("factor"), s.alias("speed")))


def speed_on(normal: Column, factor: Column, speed: Column) -> Column:
    return F.coalesce(speed, normal * factor)


def buckets(day_numbers: Column, start: Column, end: Column) -> Column:
    """Buckets of the week that a band covers; past midnight into the next day, past Saturday into Sunday."""
    first, last = F.floor(start / MINUTES).cast("int"), F.floor(end / MINUTES).cast("int")
    last = last + F.when(last <= first, DAY).otherwise(0)
    return F.flatten(F.transform(day_numbers, lambda d: F.transform(F.sequence(first, last - 1), lambda i: F.pmod(d * DAY + i, F.lit(WEEK)))))


def row_problems(day_text: Column, time_text: Column, factor: Column, speed: Column, direction: Column, way: Column) -> Column:
    """Names of the fields of a speed row that break their rule; days default to the whole week, direction to both."""
    day_text = F.when(empty(day_text), "Mo-Su").otherwise(day_text)
    direction = F.lower(F.trim(F.when(empty(direction), "both").otherwise(direction)))
    bad = {"days": days(day_text).isNull(), "time": time_range(time_text).isNull(), "rate": rate(factor, speed).isNull(), "direction": ~direction.isin(*DIRECTIONS), "osm_id": number(way).isNull()}
    return F.array_compact(F.array(*(F.when(F.coalesce(b, F.lit(True)), F.lit(k)) for k, b in bad.items())))
