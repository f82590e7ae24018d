"""Small rules of links and replays as columns: shared views, opening positions, cycles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOLD, FADE = 6.0, 2.0  # seconds after a replay


def shared_view(view: Column, default: Column, near: float = 1e-6) -> Column:
    """The view (struct x, y, zoom), or null where it is the default to within ``near``."""
    same = (F.abs(view["x"] - default["x"]) <= near) & (F.abs(view["y"] - default["y"]) <= near) & (F.abs(view["zoom"] - default["zoom"]) <= near)
    return F.when(~same, view)


def opening_progress(has_study: Column, progress: Column, reduced_motion: Column) -> Column:
    """Where a replay starts: at the end with reduced motion, at the link's progress, else at 0."""
    return F.when(reduced_motion, F.lit(1.0)).when(has_study, F.coalesce(progress, F.lit(0.0))).otherwise(0.0)


def phase_at(seconds: Column, replay: Column) -> Column:
    """Phase of one journey's cycle at a time since its start."""
    return F.when(seconds < 0, "preparing").when(seconds < replay, "replay").when(seconds < replay + HOLD, "hold").when(seconds < replay + HOLD + FADE, "fade").otherwise("next")


def replay_clock(progress: Column, duration: Column, has_route: Column) -> Column:
    """struct(search, route): shares of the search and of the route drawn at a progress; the route has the last part."""
    from ..functions.geo import route_window

    part = F.when(has_route, route_window(duration)).otherwise(0.0)
    search = F.when(part < 1, F.least(F.lit(1.0), progress / (1 - part))).otherwise(1.0)
    route = F.when(part > 0, F.greatest(F.lit(0.0), (progress - (1 - part)) / part)).otherwise(0.0)
    return F.struct(search.alias("search"), route.alias("route"))
