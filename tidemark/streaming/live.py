"""Live variants of the incremental operators (Structured Streaming)."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def as_instant(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant type: read UTC wall time as a UTC instant."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(ts))
    return df.withColumn(ts, F.timestamp_micros(micros))


def wall_time(column: str) -> Column:
    """UTC wall time of an instant, whatever the session zone."""
    epoch = F.unix_micros(column)
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=(epoch / F.lit(1_000_000)).cast("decimal(18,6)"))


def stream_metrics(stream: DataFrame, ts: str, grain: str, watermark: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Tumbling hour or day aggregates; rows later than the watermark are dropped."""
    rows = stream.withWatermark(ts, watermark)
    grouped = rows.groupBy(F.window(ts, f"1 {grain}").alias("_w"), *keys).agg(*aggregates)
    return grouped.withColumns({"period_start": F.col("_w.start"), "period_end": F.col("_w.end")}).drop("_w")


def stream_dedupe(stream: DataFrame, ids: Sequence[str], ts: str, watermark: str) -> DataFrame:
    """Keep the first row of an id as long as repeats arrive within the watermark."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(ids))


def stream_islands(stream: DataFrame, ts: str, gap: str, keys: Sequence[str], watermark: str, aggregates: Sequence[Column] = ()) -> DataFrame:
    """Sessions of points closer than ``gap``."""
    rows = stream.withWatermark(ts, watermark)
    out = rows.groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("points"), *aggregates)
    return out.withColumns({"started_at": F.col("_w.start"), "ended_at": F.col("_w.end")}).drop("_w")


CUSUM_OUT = "series string, at timestamp, z double, cusum_score double, change_detected boolean, sequential_log_likelihood double, sequential_alert boolean"
_CUSUM_STATE = "cp double, cn double, sp double, sn double, above_c boolean, above_s boolean"


def stream_cusum(stream: DataFrame, *, drift: float = 0.5, threshold: float = 4.5, shift: float = 1.5, sequential_threshold: float = 4.59511985013459) -> DataFrame:
    """Detector state per series over rows ``series, at, z``.

    The state is six numbers per series.  Rows of one trigger are put in event-time
    order first; arrival order inside a trigger is not defined.
    """
    def advance(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
        cp, cn, sp, sn, above_c, above_s = state.get if state.exists else (0.0, 0.0, 0.0, 0.0, False, False)
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, z in zip(rows["at"], rows["z"]):
            cp, cn = max(0.0, cp + z - drift), max(0.0, cn - z - drift)
            sp, sn = max(0.0, sp + shift * z - shift * shift / 2.0), max(0.0, sn - shift * z - shift * shift / 2.0)
            c, s = max(cp, cn), max(sp, sn)
            over_c, over_s = c >= threshold, s >= sequential_threshold
            out.append((key[0], at, z, c, over_c and not above_c, s, over_s and not above_s))
            above_c, above_s = over_c, over_s
        state.update((cp, cn, sp, sn, above_c, above_s))
        yield pd.DataFrame(out, columns=["series", "at", "z", "cusum_score", "change_detected", "sequential_log_likelihood", "sequential_alert"])

    return stream.select("series", "at", "z").groupBy("series").applyInPandasWithState(advance, CUSUM_OUT, _CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)


LIFECYCLE_OUT = "incident string, at timestamp, generation bigint, status string, failures bigint, trigger string"


_LIFECYCLE_STATE = "reports bigint, recoveries bigint, regressions bigint, settled bigint, verified boolean, opened bigint, frozen bigint"


def _statuses(rows: pd.DataFrame, before: tuple, reopen_after: int, immediate: bool) -> tuple[pd.DataFrame, tuple]:
    """Statuses of one incident's reports from running counts, as :func:`recovery.lifecycle` has them, and the counts after."""
    reports, recoveries, regressions, settled, verified, opened, frozen = before
    good, gap = rows["decision"].eq("recovered").to_numpy(), rows["decision"].eq("insufficient_data").to_numpy()
    bad, severe = ~(good | gap), rows["severe"].fillna(False).astype(bool).to_numpy() & immediate
    number = reports + 1 + np.arange(len(rows))
    total_good, total_bad = recoveries + np.cumsum(good), regressions + np.cumsum(bad)
    at_recovery = np.maximum.accumulate(np.where(good, total_bad, settled))
    proven = total_good > 0
    failures = np.where(proven, total_bad - at_recovery, 0)
    # The newest report that is not a gap says whether a gap leaves the incident recovered.
    newest = np.maximum.accumulate(np.where(gap, -1, np.arange(len(rows))))
    held = np.where(newest >= 0, good[np.maximum(newest, 0)], verified)
    opens = bad & (severe | (proven & (failures >= reopen_after)))
    if opened == 0 and opens.any():
        opened, frozen = int(number[opens.argmax()]), int(failures[opens.argmax()])
    open_ = (opened > 0) & (number >= opened)
    status = np.select([open_, good, gap & held], ["reopened", "recovered", "recovered"], "monitoring")
    trigger = np.select(
        [(opened > 0) & (number > opened), good, gap, opens & severe, opens, proven],
        ["incident_already_reopened", "recovery_verified", "recovery_evidence_gap", "severe_guardrail_regression", "sustained_recovery_regression", "regression_observed"], "recovery_not_yet_verified",
    )
    out = pd.DataFrame({"at": rows["at"], "generation": number, "status": status, "failures": np.where(open_, frozen, failures), "trigger": trigger})
    return out, (int(number[-1]), int(total_good[-1]), int(total_bad[-1]), int(at_recovery[-1]), bool(held[-1]), opened, frozen)


def stream_lifecycle(stream: DataFrame, *, reopen_after: int = 2, immediate_on_severe: bool = True) -> DataFrame:
    """Incident status over report rows ``incident, at, decision, severe``.

    Reports of one trigger are taken by time, equal times by decision and severity, so
    the result does not depend on the order in which they arrive within it.
    """
    def advance(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
        rows = pd.concat(list(batches)).sort_values(["at", "decision", "severe"], kind="stable", ignore_index=True)
        out, after = _statuses(rows, state.get if state.exists else (0, 0, 0, 0, False, 0, 0), reopen_after, immediate_on_severe)
        state.update(after)
        yield out.assign(incident=key[0])[["incident", "at", "generation", "status", "failures", "trigger"]]

    return stream.select("incident", "at", "decision", "severe").groupBy("incident").applyInPandasWithState(
        advance, LIFECYCLE_OUT, _LIFECYCLE_STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into Parquet and read the result back."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
