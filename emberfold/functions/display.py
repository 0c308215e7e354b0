"""How values are shown: classes, colours, sizes of marks, ages and names of states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberfold.functions.geo import destination
from emberfold.functions.numbers import clamp
from emberfold.functions.risk import smoke_alpha

# Colours by the least fire power, by the least value of two smoke variables, and by level.
FRP_COLOURS = ((100, "#7f001b"), (50, "#c51b30"), (20, "#ef5b3d"), (5, "#ff9f43"))
FRP_REST = "#ffd166"
SMOKE_COLOURS = {
    "pm10_wildfires": (((30, (98, 0, 117)), (15, (152, 37, 133)), (8, (203, 71, 119)), (3, (239, 138, 98)), (1, (254, 204, 92))), (235, 238, 242)),
    "wildfire_share": (((75, (92, 27, 136)), (50, (145, 39, 143)), (30, (200, 66, 126)), (15, (238, 121, 106)), (5, (252, 183, 91))), (236, 240, 242)),
}
SMOKE_REST = (220, 226, 230)
RISK_COLOURS = {"critical": "#ff1744", "high": "#ff7043", "medium": "#ffb020", "watch": "#f7df52", "low": "#8a9aaa"}
#: Factor of the root of fire power, least and largest radius of a detection's mark, by family.
MARKS = {"viirs-modis": (1.05, 4.0, 17.0), "slstr": (0.8, 4.0, 14.0), "mtg": (0.7, 4.0, 13.0)}
#: States of a source that are shown as bad, and as a warning.
BAD, WARN = ("error",), ("warn", "partial", "stale", "unavailable")
STATES = ("disabled", "idle", "loading", "ok", "empty", "partial", "warn", "stale", "unavailable", "error")


def _at_least(x: Column, steps: Sequence, rest, lit=F.lit) -> Column:
    out = F
    for least, value in steps:
        out = out.when(x >= least, lit(value))
    return out.otherwise(lit(rest))


def frp_colour(frp: Column) -> Column:
    return _at_least(F.coalesce(frp, F.lit(0.0)), FRP_COLOURS, FRP_REST)


def smoke_colour(variable: Column, value: Column) -> Column:
    """Red, green and blue of a smoke variable's value."""
    v = F.coalesce(value, F.lit(0.0))
    rgb = lambda c: F.array(*map(F.lit, c))
    out = F
    for name, (steps, rest) in SMOKE_COLOURS.items():
        out = out.when(variable == name, _at_least(v, steps, rest, rgb))
    return out.otherwise(rgb(SMOKE_REST))


def smoke_opacity(variable: Column, value: Column) -> Column:
    v = F.coalesce(value, F.lit(0.0))
    share = F.when(v <= 0, 0.0).otherwise(clamp(0.10 + v / 145, 0.12, 0.68))
    other = F.when(v <= 0.02, 0.0).otherwise(clamp(0.10 + v * 0.42, 0.12, 0.58))
    return F.when(variable == "pm10_wildfires", smoke_alpha(v)).when(variable == "wildfire_share", share).otherwise(other)


def risk_colour(level: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in RISK_COLOURS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, level), F.lit(RISK_COLOURS["low"]))


def mark_radius(family: Column, frp: Column) -> Column:
    """Radius of a detection's mark; families without one of their own have the first one's."""
    root = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(frp, F.lit(0.0))))
    one = lambda k: clamp(MARKS[k][1] + root * MARKS[k][0], MARKS[k][1], MARKS[k][2])
    names = list(MARKS)
    out = F
    for k in names[1:]:
        out = out.when(family == k, one(k))
    return out.otherwise(one(names[0]))


def confirmed_radius(observations: Column) -> Column:
    return clamp((6 + observations * 2).cast("double"), 8.0, 26.0)


def risk_radius(score: Column, detections: Column) -> Column:
    return clamp(7 + (100 - score) * -0.015 + detections * 0.25, 7.0, 15.0)


def envelope(*brightness: Column) -> tuple[Column, Column]:
    """(hue, lightness) of an event's thermal envelope by its warmest pixel; null without any brightness."""
    most = F.greatest(F.lit(0.0), *[F.coalesce(b, F.lit(0.0)) for b in brightness])
    hue = F.when(most <= 0, None).when(most > 360, 30).when(most > 320, 15).otherwise(0)
    return hue, F.when(most > 0, clamp(55 + (most - 300) * 0.3, 35.0, 75.0))


def field_radius(width: Column, height: Column, points: Column) -> Column:
    """Radius of a smoke sample's field by how many share the picture."""
    area = F.greatest(F.lit(1.0), width.cast("double") * height)
    return clamp(F.sqrt(area / F.greatest(F.lit(1), points)) * 1.55, 64.0, 170.0)


def wind_arrow_end(lat: Column, lon: Column, direction: Column, speed: Column) -> tuple[Column, Column]:
    """(lat, lon) where the arrow of a wind that comes from ``direction`` ends; null unless both are known."""
    to = destination(lat, lon, F.pmod(direction + 180, F.lit(360.0)), clamp(speed * 0.7, 12.0, 45.0))
    known = direction.isNotNull() & speed.isNotNull()
    return F.when(known, to[0]), F.when(known, to[1])


def state_class(state: Column) -> Column:
    return F.when(state == "ok", "status-ok").when(state.isin(*BAD), "status-bad").when(state.isin(*WARN), "status-warn").otherwise("status-idle")


def state_name(state: Column) -> Column:
    """The state itself if it is one, else idle."""
    return F.when(state.isin(*STATES), state).otherwise("idle")


def imagery_age(minutes: Column) -> tuple[Column, Column]:
    """(live, delayed or old; the age in minutes, or hours and minutes) of a picture."""
    name = F.when(minutes > 60, "old").when(minutes > 25, "delayed").when(minutes.isNotNull(), "live")
    whole = F.floor(minutes).cast("string")
    hours = F.concat_ws(":", F.floor(minutes / 60).cast("string"), F.lpad(F.floor(F.pmod(minutes, F.lit(60.0))).cast("string"), 2, "0"))
    return name, F.when(minutes < 60, whole).otherwise(hours)


def iso_utc(ts: Column) -> Column:
    """A time as ISO text with seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window_key(country: Column, ts: Column, hours: int = 24) -> Column:
    """Country and both ends of the window that ends at a time."""
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    back = F.make_dt_interval(F.lit(0), F.lit(hours))
    return F.concat_ws(":", F.coalesce(country, F.lit("?")), text(ts - back), text(ts))


def time_reference(selected_ms: Column, slider: Column, now_ms: Column) -> Column:
    """Now if the slider is at 0 or no time is chosen, else the chosen time, at most 15 minutes ahead."""
    return F.when(selected_ms.isNull() | (slider == 0), now_ms).otherwise(F.least(selected_ms, now_ms + 15 * 60_000))


def snapped(ts: Column, hours: Column, by_minute: Column) -> Column:
    """A time some hours away, cut to the minute or to the hour."""
    to = ts + F.make_dt_interval(F.lit(0), hours)
    return F.when(by_minute, F.date_trunc("minute", to)).otherwise(F.date_trunc("hour", to))


def two_decimals(x: Column) -> Column:
    cents = F.floor(F.abs(x) * 100 + 0.5)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def places_key(points: Column) -> Column:
    """``lat,lon`` of an array of structs, to two decimals, joined by semicolons."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", two_decimals(p["lat"]), two_decimals(p["lon"]))), ";")


def known_country(code: Column, known: Sequence[str], fallback: str = "TR") -> Column:
    """A code in capitals if it is one of the known ones, else the fallback."""
    up = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(up.isin(*known), up).otherwise(fallback)
