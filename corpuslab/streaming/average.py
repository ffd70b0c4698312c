"""Moving average over a stream of values that come out of order within a bound.

Each key keeps its average so far and the values that are not yet settled: those later than the watermark, before which
more may still arrive. What the watermark has passed is put in order and added to the average for good, so the
result is that of the batch form over all settled values, however they were dealt to micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslab.operators.evaluate import EMA_FACTOR

STATE = "n bigint, average double, times array<bigint>, ties array<bigint>, vals array<double>"


def moving_average(rows: DataFrame, key: str, time: str, tie: str, value: str, late: str, factor: float = EMA_FACTOR) -> DataFrame:
    """(key, n, ema, upto): after each micro-batch one row for every key of which values were settled, with the number of
    settled values, their average as `evaluate.ema` gives it in the order (time, tie), and the time of the last of them.

    rows: a stream; `time` a timestamp, of which milliseconds count, `tie` a whole number that orders values of one
    millisecond, `late` how far behind the newest time a value may come ("10 minutes"); what comes later than that is dropped,
    as by any watermark. Null values and null times take no part. State holds a key's values of that bound only, and lives in the checkpoint."""
    marked = rows.where(f"`{value}` IS NOT NULL AND `{time}` IS NOT NULL").selectExpr(
        f"`{key}` AS k", f"`{time}` AS at", f"unix_millis(`{time}`) AS ms", f"CAST(`{tie}` AS BIGINT) AS tie", f"CAST(`{value}` AS DOUBLE) AS v"
    ).withWatermark("at", late)
    kind = marked.schema["k"].dataType.simpleString()

    def step(name, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, average, times, ties, vals = state.get if state.exists else (0, 0.0, [], [], [])
        waiting = list(zip(times, ties, vals))
        for part in parts:
            waiting += zip(part["ms"].tolist(), part["tie"].tolist(), part["v"].tolist())
        waiting.sort()
        mark, settled = state.getCurrentWatermarkMs(), 0
        while settled < len(waiting) and waiting[settled][0] <= mark:
            x = waiting[settled][2]
            average = x if not n else factor * average + (1 - factor) * x
            n, settled = n + 1, settled + 1
        if settled:
            upto = pd.to_datetime([waiting[settled - 1][0]], unit="ms", utc=True).tz_localize(None)
            yield pd.DataFrame({"k": [name[0]], "n": [n], "ema": [average], "upto": upto})
        left = waiting[settled:]
        state.update((n, average, *[[w[i] for w in left] for i in range(3)]))
        if left:
            state.setTimeoutTimestamp(max(left[0][0], mark + 1))

    out = marked.groupBy("k").applyInPandasWithState(step, f"k {kind}, n bigint, ema double, upto timestamp", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("k", key)
