"""Observations that arrive as a stream (additive: campaigns have no event time).

Rows (ts, key, risk, ...) are summed up by windows of event time, with a watermark for what comes late; and the running
state of each key is kept and told on every change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.atlas import PROVISIONAL, SUSPICIOUS, TRUSTED, UNKNOWN, Policy


def timed(stream: DataFrame) -> DataFrame:
    """With event times as instants: times without a zone are those of the session's."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windows(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None, key: str = "key") -> DataFrame:
    """Count, mean and largest risk of each key in tumbling (or, with slide, sliding) windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    made = timed(stream).withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("samples"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("risk_max"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "samples", "mean_risk", "risk_max")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "key") -> DataFrame:
    """Sessions of each key that end after a gap."""
    made = timed(stream).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("samples"), F.max("risk").alias("risk_max"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "samples", "risk_max")


_STATE = "n long, total double, top double, channels int, measured int, strong boolean, broken boolean"


def cell_states(stream: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The running label of each cell: key (string), samples, mean_risk, risk_max, label, on every batch that changes it.

    Labels are those of atlas.classify: a risky cell is SUSPICIOUS where a point at the threshold is a fact or has enough
    channels, else UNKNOWN. Streams carry channels, measured (bit masks) and fact, and may carry depth; one without
    channels and fact takes every point for a fact, one without measured takes it as measured by one channel.
    """
    have = {c.lower() for c in stream.columns}
    more = {"channels": F.lit(0), "fact": F.lit(not have & {"channels", "fact"}), "measured": F.lit((1 << policy.channels_floor) - 1), "depth": F.lit(0)}
    given = stream.select("key", F.col("risk").cast("double").alias("risk"), *[F.coalesce(F.col(c), v).alias(c) if c in have else v.alias(c) for c, v in more.items()])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, top, channels, measured, strong, broken = state.get if state.exists else (0, 0.0, 0.0, 0, 0, False, False)
        depth = 0
        for f in frames:
            risk, speaking = f["risk"].to_numpy(float), f["channels"].to_numpy(int)
            n, total = n + len(f), total + float(risk.sum())
            top = float(np.fmax(top, np.fmax.reduce(risk, initial=0.0)))
            channels, measured = channels | int(np.bitwise_or.reduce(speaking)), measured | int(np.bitwise_or.reduce(f["measured"].to_numpy(int)))
            strong = strong or bool(((risk >= policy.suspicious_mean) & (f["fact"].to_numpy(bool) | (np.bitwise_count(speaking) >= policy.suspicious_channels))).any())
            broken = broken or bool((~np.isfinite(risk)).any())
            depth = int(f["depth"].max())
        state.update((n, total, top, channels, measured, strong, broken))
        mean = total / n
        share = 0.5**depth
        thin = share > policy.certify_share if policy.certify == "size" else n / share < policy.certify_density
        if mean != mean:
            label = UNKNOWN
        elif top >= policy.suspicious_peak or mean >= policy.suspicious_mean:
            label = SUSPICIOUS if strong else UNKNOWN
        elif n < policy.min_samples or policy.blocks_non_finite and broken or measured.bit_count() < policy.channels_floor:
            label = UNKNOWN
        else:
            label = PROVISIONAL if policy.resolution in ("withhold", "both") and thin else TRUSTED
        yield pd.DataFrame({"key": [key[0]], "samples": [n], "mean_risk": [mean], "risk_max": [top], "label": [label]})

    return given.groupBy("key").applyInPandasWithState(update, "key string, samples long, mean_risk double, risk_max double, label string", _STATE, "update", GroupStateTimeout.NoTimeout)
