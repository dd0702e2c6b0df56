"""What a feature's attributes say, as Columns: tag text, ids in messages, rules for edits and points, ferry speeds."""

from __future__ import annotations

import difflib
from collections.abc import Iterable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import tags

# OpenStreetMap keys and values that points may carry.
OTHER_VEHICLES = ("bus", "psv", "hgv", "goods", "taxi", "motorcycle", "moped", "emergency", "horse", "hov")
BUS_WAYS = ("busway", "bus_guideway")
NODE_HIGHWAYS = (
    "traffic_signals", "crossing", "stop", "give_way", "mini_roundabout", "turning_circle", "turning_loop", "motorway_junction", "speed_camera",
    "elevator", "milestone", "passing_place", "bus_stop", "street_lamp", "toll_gantry", "ford", "traffic_mirror",
)


def tag_value(value: Column, kind: str) -> Column:
    """An attribute as tag text: blanks and NaN are none, booleans yes or no, whole numbers without a point. kind: its Spark type."""
    if kind == "boolean":
        return F.when(value, "yes").when(~value, "no")
    if kind in ("double", "float"):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(~F.isnan(value), F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string")))
    text = F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
    return F.when(text != "", text)


def oneway_text(value: Column) -> Column:
    """True and False, as some layers write oneway, in words."""
    return F.when(F.lower(value) == "true", "yes").when(F.lower(value) == "false", "no").otherwise(value)


def named(ids: Column, most: int = 10) -> Column:
    """Ids for a message: the first ones in order, and how many more there are."""
    ordered = F.array_sort(ids)
    text = F.array_join(F.slice(ordered, 1, most).cast("array<string>"), ", ")
    return F.when(F.size(ids) > most, F.concat(text, F.lit(" and "), (F.size(ids) - most).cast("string"), F.lit(" more"))).otherwise(text)


def open_to_other_vehicles(tag: tags.Get) -> Column:
    """Ways for vehicles without a mode of their own: bus ways, or any of their keys granted."""
    out = F.coalesce(tag("highway").isin(*BUS_WAYS), F.lit(False))
    for k in OTHER_VEHICLES:
        out = out | F.coalesce(tag(k).isin(*tags.GRANTED), F.lit(False))
    return out


def mode_keys() -> list[str]:
    """All keys that any access rule reads, each once."""
    found = ["highway", "route", "motorroad"]
    for mode in tags.MODES:
        found += [*tags.ACCESS[mode], *tags.EXCLUDED[mode]]
    return sorted(set(found))


def suggest(word: str, known: Iterable[str], cutoff: float = 0.85) -> str | None:
    """The known word that this one is likely a cut or misspelt form of; None if it is known itself, or like none."""
    known = sorted(set(known))
    if word in known:
        return None
    longer = [k for k in known if len(word) >= 5 and k.startswith(word)]
    near = difflib.get_close_matches(word, known, n=1, cutoff=cutoff)
    return min(longer, key=lambda k: (len(k), k)) if longer else near[0] if near else None


def edit_problems(own: Column, remove: Column, listed: Column) -> Column:
    """What is wrong with an edit: remove that says neither yes nor no, deleting highway, setting and deleting one key."""
    from ..operators.edits import wants_removal

    both = F.transform(F.array_sort(F.array_intersect(listed, F.map_keys(own))), lambda k: F.concat(k, F.lit(" is set and deleted")))
    return F.array_compact(F.concat(F.array(F.when(wants_removal(remove).isNull(), "remove must be yes or no"), F.when(F.array_contains(listed, "highway"), "highway can't be deleted")), both))


def point_problems(own: Column, listed: Column) -> Column:
    """What is wrong with a point: no tags, a way's highway value, setting and deleting one key."""
    both = F.transform(F.array_sort(F.array_intersect(listed, F.map_keys(own))), lambda k: F.concat(k, F.lit(" is set and deleted")))
    return F.array_compact(F.concat(F.array(F.when((F.size(own) == 0) & (F.size(listed) == 0), "needs node tags"), F.when(~own["highway"].isin(*NODE_HIGHWAYS), "highway is no value for a point")), both))


def ferry_kph(tag: tags.Get, length: Column, line: str) -> Column:
    """Speed of ferry edges: their line's whole length by its duration, else maxspeed or the default; null for other edges."""
    hours = tags.duration_hours(tag("duration"))
    whole = F.sum(length).over(Window.partitionBy(line))
    return F.when(tags.is_ferry(tag), F.when(hours > 0, whole / 1000 / hours).otherwise(tags.car_speed_kph(tag)))
