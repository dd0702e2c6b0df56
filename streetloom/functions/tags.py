"""Tag rules as Columns: access, grade, speed, direction, lists and value checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Get = Callable[[str], Column]

# OpenStreetMap access rules and default speeds.
ACCESS = {
    "drive": ("access", "vehicle", "motor_vehicle", "motorcar"),
    "drive_service": ("access", "vehicle", "motor_vehicle", "motorcar"),
    "bike": ("access", "vehicle", "bicycle"),
    "walk": ("access", "foot"),
}
DENIED = ("no", "private", "agricultural", "forestry", "delivery", "emergency", "military", "restricted", "permit", "use_sidepath")
GRANTED = ("yes", "designated", "permissive", "official")
MODES = ("drive", "drive_service", "walk", "bike")
_SHUT = "abandoned|bridleway|bus_guideway|construction|corridor|cycleway|elevator|escalator|footway|no|path|pedestrian|planned|platform|proposed|raceway|razed|rest_area"
EXCLUDED = {
    "drive": {"area": "yes", "highway": _SHUT + "|service|services|steps|track", "service": "alley|driveway|emergency_access|parking|parking_aisle|private"},
    "drive_service": {"area": "yes", "highway": _SHUT + "|services|steps|track", "service": "emergency_access|parking|parking_aisle|private"},
    "walk": {"area": "yes", "highway": "abandoned|bus_guideway|construction|cycleway|motor|no|planned|platform|proposed|raceway|razed|rest_area|services", "service": "private", "sidewalk": "separate"},
    "bike": {"area": "yes", "highway": "abandoned|bus_guideway|construction|corridor|elevator|escalator|footway|motor|no|planned|platform|proposed|raceway|razed|rest_area|services|steps", "service": "private"},
}
CLASS_KPH = {
    "motorway": 100, "motorway_link": 60, "trunk": 80, "trunk_link": 50, "primary": 60, "primary_link": 40,
    "secondary": 50, "secondary_link": 40, "tertiary": 40, "tertiary_link": 30, "unclassified": 30, "residential": 30, "road": 30,
    "living_street": 10, "service": 15, "busway": 30, "bus_guideway": 30, "pedestrian": 5, "track": 15, "footway": 5, "cycleway": 15,
    "bridleway": 5, "path": 5, "steps": 3, "corridor": 5,
}
FERRY_KPH = {"ferry": 10, "shuttle_train": 65}
UNKNOWN_KPH, BIKE_KPH, WALK_KPH = 30.0, 15.0, 5.0
KPH = {"": 1.0, "mph": 1.609344, "knots": 1.852}


def from_columns(names: list[str]) -> Get:
    """Tags held in columns; a tag without a column is null."""
    known = set(names)
    return lambda k: F.col(f"`{k}`") if k in known else F.lit(None).cast("string")


def from_map(tags: Column) -> Get:
    return lambda k: tags[k]


def present(value: Column) -> Column:
    """Has a value other than no, 0 or false."""
    return value.isNotNull() & ~F.lower(F.trim(value)).isin("", "no", "0", "false")


def layer(tag: Get) -> Column:
    whole = F.regexp_extract(tag("layer"), r"^\s*([+-]?\d{1,9})(?:\.\d*)?\s*$", 1)
    return F.coalesce(F.nullif(whole, F.lit("")).cast("int"), F.lit(0))


def is_ferry(tag: Get) -> Column:
    return tag("highway").isNull() & F.coalesce(tag("route").isin(*FERRY_KPH), F.lit(False))


def grade_separated(tag: Get) -> Column:
    return F.coalesce(tag("highway").isin("motorway", "motorway_link"), F.lit(False)) | present(tag("bridge")) | present(tag("tunnel")) | is_ferry(tag)


def effective_access(tag: Get, mode: str) -> Column:
    """The most specific access tag of the mode, as a struct of key and value; null if there is none."""
    return F.coalesce(*(F.when(tag(k).isNotNull(), F.struct(F.lit(k).alias("key"), tag(k).alias("value"))) for k in reversed(ACCESS[mode])))


def allows_mode(tag: Get, mode: str) -> Column:
    access = effective_access(tag, mode)
    denied = F.coalesce(access["value"].isin(*DENIED), F.lit(False))
    granted = F.coalesce((access["key"] != "access") & access["value"].isin(*GRANTED), F.lit(False))
    highway = tag("highway")
    closed = highway == "busway"
    if mode == "bike":
        closed = closed | (highway == "pedestrian")
    if mode in ("bike", "walk"):
        closed = closed | (tag("motorroad") == "yes")
    closed = F.coalesce(closed, F.lit(False)) & ~granted
    opens = {"bike": "footway", "walk": "cycleway"}.get(mode)
    opened = granted & F.coalesce(highway == opens, F.lit(False)) if opens else F.lit(False)
    passes = [~F.coalesce(tag(k).rlike(p), F.lit(False)) | (opened if k == "highway" else F.lit(False)) for k, p in EXCLUDED[mode].items()]
    return F.when(is_ferry(tag), ~denied).otherwise(~denied & ~closed & highway.isNotNull() & reduce(lambda a, b: a & b, passes))


def usable_modes(tag: Get) -> Column:
    return F.array_compact(F.array(*(F.when(allows_mode(tag, m), F.lit(m)) for m in MODES)))


def maxspeed_kph(value: Column) -> Column:
    """Mean of the ;-separated speeds in km/h; parts without a number over 0 don't count; null if none is left."""
    parts = F.transform(F.split(value, ";"), lambda p: F.struct(
        F.expr("1").alias("one"), F.regexp_extract(p, r"^\s*(\d+(?:\.\d+)?)\s*(?:mph|knots)?\s*$", 1).alias("n"), F.regexp_extract(p, r"^\s*\d+(?:\.\d+)?\s*(mph|knots)?\s*$", 1).alias("u")))
    kph = F.transform(F.filter(parts, lambda p: p["n"] != ""), lambda p: p["n"].cast("double") * F.when(p["u"] == "mph", KPH["mph"]).when(p["u"] == "knots", KPH["knots"]).otherwise(1.0))
    kph = F.filter(kph, lambda x: x > 0)
    return F.when(F.size(kph) > 0, F.aggregate(kph, F.lit(0.0), lambda a, x: a + x) / F.size(kph))


def car_speed_kph(tag: Get) -> Column:
    def table(key: Column, values: dict) -> Column:
        return F.create_map(*(F.lit(v) for k, s in values.items() for v in (k, float(s))))[key]

    return F.coalesce(maxspeed_kph(tag("maxspeed")), F.when(is_ferry(tag), table(tag("route"), FERRY_KPH)), table(F.coalesce(tag("highway"), F.lit("")), CLASS_KPH), F.lit(UNKNOWN_KPH))


def direction(value: Column) -> Column:
    v = F.lower(value)
    return F.when(v.isin("true", "yes", "1"), "forward").when(v.isin("-1", "reverse"), "backward").otherwise("both")


def duration_hours(value: Column) -> Column:
    """hh:mm or hh:mm:ss in hours; null otherwise."""
    pick = lambda k: F.regexp_extract(value, r"^\s*(\d+):(\d{2})(?::(\d{2}))?\s*$", k)
    seconds = F.when(pick(3) == "", 0.0).otherwise(F.expr("0.0") + F.nullif(pick(3), F.lit("")).cast("double"))
    return F.when(pick(1) != "", F.nullif(pick(1), F.lit("")).cast("double") + F.nullif(pick(2), F.lit("")).cast("double") / 60 + seconds / 3600)


def listed_keys(value: Column) -> Column:
    """Parts between ; or , trimmed, without blanks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(value, "[;,]"), lambda p: F.trim(p)), lambda p: p != ""))


def resolve(tag: Get, defaults: dict[str, str], overwrite: bool = False) -> dict[str, Column]:
    """Blanket tags on a feature's own: they fill blanks only, or replace what is there."""
    own = lambda k: F.when(F.trim(tag(k)) != "", F.trim(tag(k)))
    return {k: F.lit(v) if overwrite else F.coalesce(own(k), F.lit(v)) for k, v in defaults.items()}


def value_problems(tag: Get) -> Column:
    """Names of the tags whose value breaks its rule."""
    rules = (("maxspeed", ~tag("maxspeed").rlike(r"^\s*\d+(\.\d+)?\s*(mph|knots)?\s*$")), ("oneway", ~F.lower(tag("oneway")).isin("yes", "no", "true", "false", "1", "0", "-1", "reverse")),
             ("lanes", ~tag("lanes").rlike(r"^[1-9]\d*$")), ("layer", ~tag("layer").rlike(r"^-?\d+$")))
    return F.array_compact(F.array(*(F.when(tag(k).isNotNull() & bad, F.lit(k)) for k, bad in rules)))
