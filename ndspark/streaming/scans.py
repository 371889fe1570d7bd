"""Running sums and differences of a stream in the order of event time, by key.

Rows wait in the state of their key until the watermark has passed them, so that rows that come
late, but not later than ``late``, take their place in the order; then they leave with the sum up to them and the difference from
the row before. A state holds the sum, the last value and the rows of the last ``late`` only. Rows that come after
those of their time have left are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows that wait are three packed columns.
_STATE = "total double, last double, seen boolean, until long, us binary, row binary, x binary"
_KINDS = "<i8", "<i8", "<f8"
#: Rows that leave at a time.
OUT = 1 << 16


def running(stream: DataFrame, value: str, keys: list[str], time: str, order: str, late: str = "1 hour") -> DataFrame:
    """(keys, time, order, value, cumsum, diff); rows of one time are ordered by ``order``, a long; the first row's diff is null.

    For append mode. A null value counts as 0 in sums and differences; rows without a time are dropped.
    """
    kinds = dict(stream.dtypes)
    rows = stream.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("timestamp").alias(time), F.col(order).cast("long").alias(order), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value))
    rows = rows.withWatermark(time, late).withColumn("us", F.unix_micros(F.col(time)))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, last, seen, until, *kept = state.get if state.exists else (0.0, 0.0, False, None, b"", b"", b"")
        parts = [tuple(np.frombuffer(x, kind) for x, kind in zip(kept, _KINDS))]
        if not state.hasTimedOut:
            parts += [tuple(b[c].to_numpy(kind) for c, kind in zip(("us", order, value), _KINDS)) for b in batches]
        us, ids, xs = (np.concatenate(x) for x in zip(*parts))
        limit = state.getCurrentWatermarkMs() * 1000
        stays = us >= limit
        ready = ~stays if until is None else ~stays & (us >= until)  # not behind what has left already
        kept = us[stays], ids[stays], xs[stays]
        us, ids, xs = us[ready], ids[ready], xs[ready]
        places = np.lexsort((ids, us))
        for k in range(0, len(places), OUT):
            at = places[k : k + OUT]
            x = xs[at]
            sums = np.cumsum(np.concatenate([[total], x]))[1:]
            before = np.concatenate([[last if seen else np.nan], x[:-1]])
            yield pd.DataFrame({**{c: [v] * len(x) for c, v in zip(keys, key)}, "us": us[at], order: ids[at], value: x, "cumsum": sums, "diff": x - before})
            total, last, seen = float(sums[-1]), float(x[-1]), True
        until = max(until or 0, limit) if limit > 0 else until
        state.update((total, last, seen, until, *(x.tobytes() for x in kept)))
        if len(kept[0]):
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(kept[0].min()) // 1000) + 1)

    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "us long", f"{order} long", f"{value} double", "cumsum double", "diff double"])
    made = rows.groupBy(*keys).applyInPandasWithState(step, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(*keys, F.timestamp_micros("us").alias(time), order, value, "cumsum", F.when(~F.isnan("diff"), F.col("diff")).alias("diff"))
