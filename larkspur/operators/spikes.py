"""Implausible readings of many series, found by a Kalman filter per series.

Each series is forecast with a local-level model (a random-walk level seen
through noise) whose scale is the robust spread of the series' own step-to-step
changes. A reading whose standardised innovation exceeds ``threshold`` is
flagged and its update withheld, so that the level is not dragged along; the
flag holds only if the series jumps back within ``max_steps`` steps, otherwise
the level has moved and the filter restarts there. Readings outside
``bounds`` never enter the filter. A stuck sensor shows in the variance of the
innovations, taken over a moving window of ``stuck_steps`` steps: where it
vanishes against the series' scale, all readings of the window are marked.

Scale: a series is cut into windows of about ``window_steps`` readings with
overlapping margins, sized by the series' own density in time, so one series
that holds a third of all rows spreads over many tasks, and a series with a
reading a second or a month is treated alike. The filter forgets within a few steps,
far less than a margin.

Defined results: a null value is never flagged and counts as a missing step; a
row without time or series can only fail ``bounds`` (or be not finite); rows
with the same series and time are one step (its value is that of the smallest
id; a differing repeat is judged by ``bounds`` alone); a series of one or two
readings has no normal behaviour to leave, so nothing in it is flagged but by
``bounds``; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import cut, small_side

#: innovations smaller than this share of the series' scale are no movement
STILL = 1e-6


def robust_scale(values: np.ndarray, steps: np.ndarray) -> float:
    """Spread of the changes over one step (MAD, as a standard deviation); a
    random walk spreads with the root of the steps between two readings."""
    change = np.abs(np.diff(values)) / np.sqrt(np.maximum(np.diff(steps), 1.0))
    if not len(change):
        return 1.0
    scale = 1.4826 * float(np.median(change))
    if scale <= 0:  # more than half of the steps stand still
        moving = change[change != 0]
        scale = 1.4826 * float(np.median(moving)) if len(moving) else 1e-9
    return scale


def kalman_excursions(values: np.ndarray, steps: np.ndarray, threshold: float, max_steps: int) -> np.ndarray:
    """Marks readings that leave the forecast and come back. ``steps``: time in steps."""
    n = len(values)
    flagged = np.zeros(n, dtype=bool)
    if not n:
        return flagged
    scale = robust_scale(values, steps)
    q, r = 0.8 * scale * scale, 0.1 * scale * scale
    level, p = float(np.median(values[:7])), r + 3 * q
    away: list[int] = []  # withheld readings since the last accepted one
    i, last = 0, steps[0] - 1
    while i < n:
        v, gap = float(values[i]), max(1.0, steps[i] - last)
        prior = p + q * gap
        innovation = (v - level) / math.sqrt(prior + r)
        if away:
            out = float(values[away[-1]])
            same_side = (v > level) == (out > level)
            if same_side and abs(v - out) < abs(v - level):  # still out there
                if steps[i] - steps[away[0]] < max_steps:
                    away.append(i)
                    i += 1
                    continue
            elif abs(v - out) > threshold * scale and (abs(innovation) <= threshold or not same_side):
                flagged[away] = True  # back at the forecast, or beyond it on the other side
                away = []
                continue
            # it stayed away: the level moved; start again from there
            level, p, last = float(values[away[0]]), r + q, steps[away[0]]
            i, away = away[0] + 1, []
            continue
        if abs(innovation) > threshold:
            away.append(i)  # update withheld: only the uncertainty grows, through gap
            i += 1
            continue
        gain = prior / (prior + r)
        level, p, last = level + gain * (v - level), (1 - gain) * prior, steps[i]
        i += 1
    if away and steps[away[-1]] - steps[away[0]] < max_steps:
        flagged[away] = True  # the series ends while away
    return flagged


def vanished_variance(values: np.ndarray, steps: np.ndarray, stuck_steps: int) -> np.ndarray:
    """Marks the readings of every moving window of ``stuck_steps`` steps whose
    innovations have no variance.

    The innovations are those of the model's random walk alone (no noise), which
    a stuck value brings to nothing at once and not only in the limit."""
    n = len(values)
    stuck = np.zeros(n, dtype=bool)
    if n < 2:
        return stuck
    square = np.concatenate(([0.0], np.diff(values) ** 2 / np.maximum(np.diff(steps), 1.0)))
    least = (STILL * robust_scale(values, steps)) ** 2
    moved = np.cumsum(square > (stuck_steps * least))  # a window with such a step cannot have a variance of ``least``
    first = np.searchsorted(steps, steps - (stuck_steps - 0.75), side="left")
    first = np.where(steps - steps[first] + 1 >= stuck_steps - 0.25, first, first - 1)  # the window spans all its steps
    ends = np.flatnonzero((first >= 0) & (first < np.arange(n)) & (moved == moved[np.maximum(first, 0)]))
    for j in ends:
        i = int(first[j])
        if steps[j] - steps[i] + 1 >= stuck_steps - 0.25 and square[i + 1 : j + 1].mean() <= least:
            stuck[i : j + 1] = True
    return stuck


def implausible_readings(
    df: DataFrame,
    series: list[str],
    time: str,
    value: str,
    key: str,
    bounds: tuple[float, float],
    threshold: float = 4.5,
    max_steps: int = 3,
    stuck_steps: int = 6,
    window_steps: int = 2016,
    margin_steps: int = 96,
) -> DataFrame:
    """Rows (``key``, ``reason``) of readings that do not fit their series.

    ``time``: seconds since 1970 (any number). reason is ``impossible``,
    ``spike`` or ``stuck``."""
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(
        F.col(f"`{key}`").alias("id"),
        F.when(F.least(*[F.col(f"`{c}`").isNotNull() for c in series]) if len(series) > 1 else F.col(f"`{series[0]}`").isNotNull(), F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in series]))).alias("series"),
        F.col(f"`{time}`").cast("double").alias("t"),
        v.alias("v"),
        (F.isnan(v) | (v < bounds[0]) | (v > bounds[1])).alias("bad"),
    ).filter("v is not null")
    impossible = rows.filter("bad").select("id", F.lit("impossible").alias("reason"))
    timed = cut(rows.filter("not bad and t is not null and series is not null").select("id", "series", "t", "v"))
    # the mean time between two readings of each series, one row a series
    density = timed.groupBy("series").agg(F.min("t").alias("start"), ((F.max("t") - F.min("t")) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("gap"))
    density = density.withColumn("gap", F.when(F.col("gap") > 0, F.col("gap")).otherwise(1.0))
    place = (F.col("t") - F.col("start")) / F.col("gap")
    at = F.floor(place / window_steps)
    off = place - at * window_steps
    windows = F.array_compact(F.array(at, F.when(off < margin_steps, at - 1), F.when(off >= window_steps - margin_steps, at + 1)))
    placed = timed.join(small_side(cut(density)), "series").select("id", "series", "t", "v", at.alias("home"), F.explode(windows).alias("w"))
    id_type = rows.schema["id"].dataType.simpleString()

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "id"], kind="stable")
        one = part.drop_duplicates("t")
        t, x = one["t"].to_numpy(float), one["v"].to_numpy(float)
        if len(t) > 1:
            gaps = np.diff(t)
            step = float(np.median(gaps))
            steps = (t - t[0]) / step
        else:
            steps = np.zeros(len(t))
        stuck = vanished_variance(x, steps, stuck_steps)
        spike = kalman_excursions(x, steps, threshold, max_steps) & ~stuck
        verdict = pd.DataFrame({"t": t, "v": x, "reason": np.where(stuck, "stuck", np.where(spike, "spike", ""))})
        out = part[part["home"] == part["w"]].merge(verdict[verdict["reason"] != ""], on=["t", "v"])
        return out[["id", "reason"]]

    judged = placed.groupBy("series", "w").applyInPandas(judge, f"id {id_type}, reason string")
    return impossible.unionByName(judged)
