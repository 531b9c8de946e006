"""Codes most often missed, in a state of fixed size.

A window keeps a space-saving summary: a bounded number of codes with a count that is never
too low and an error by which it may be too high.  A new code takes the place, and the count,
of the least one.  With k places no error exceeds 1 / k of all misses, and every code with
more than that is among them.
"""

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

PLACES = 1000
SHARDS = 16


def offer(places, code, n, size):
    """Counts n misses of a code in places {code: [count, error]}, of at most size codes."""
    if code in places:
        places[code][0] += n
    elif len(places) < size:
        places[code] = [n, 0]
    else:
        least = min(places, key=lambda c: (places[c][0], c))
        count = places.pop(least)[0]
        places[code] = [count + n, count]


def merged(one, other, size):
    """One summary of what two have counted: a code only one holds may have the other's least count."""
    def least(places):
        return min((c for c, _ in places.values()), default=0) if len(places) >= size else 0

    a, b = least(one), least(other)
    out = {}
    for code in {**one, **other}:
        (x, dx), (y, dy) = one.get(code, (a, a)), other.get(code, (b, b))
        out[code] = [x + y, dx + dy]
    return dict(sorted(out.items(), key=lambda i: (-i[1][0], i[0]))[:size])


def heavy_misses_stream(enriched, window, size=PLACES, shards=SHARDS):
    """window_start, gtin, scans, error, total: the fullest places of each window once it has ended.

    enriched: gtin, found and scanned_at under a watermark.  A window is dealt to `shards` by
    code, each with `size` places, so its state is of fixed size and a hot window is many tasks.
    The true number of a code's scans is at most `scans` and at least `scans - error`, and
    error is at most total / size, total being the shard's misses.  Rows of windows that have
    ended are late and left out.
    """
    shard = F.pmod(F.xxhash64("gtin"), F.lit(shards)).cast("int")
    span = F.window("scanned_at", window)
    misses = enriched.where(~F.col("found")).select(
        "gtin", "scanned_at", shard.alias("shard"), span["start"].alias("window_start"), span["end"].alias("window_end")
    )

    def count(key, frames, state):
        start, end, _ = key
        if state.hasTimedOut:
            places, total = json.loads(state.get[0]), state.get[1]
            state.remove()
            rows = sorted(((c, n, e) for c, (n, e) in places.items()), key=lambda r: (-r[1], r[0]))
            yield pd.DataFrame(
                {
                    "window_start": [start] * len(rows), "gtin": [r[0] for r in rows], "scans": [r[1] for r in rows],
                    "error": [r[2] for r in rows], "total": [total] * len(rows),
                }
            )
            return
        ends = int(pd.Timestamp(end).timestamp() * 1000)
        if ends <= state.getCurrentWatermarkMs():
            return
        places, total = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, 0)
        for frame in frames:
            for code, n in sorted(frame["gtin"].value_counts().items(), key=lambda x: (-x[1], x[0])):
                offer(places, code, int(n), size)
                total += int(n)
        state.update((json.dumps(places), total))
        state.setTimeoutTimestamp(ends)

    return misses.groupBy("window_start", "window_end", "shard").applyInPandasWithState(
        count, "window_start timestamp, gtin string, scans long, error long, total long",
        "places string, total long", "append", GroupStateTimeout.EventTimeTimeout,
    )
