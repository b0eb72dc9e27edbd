"""The same operators over streams: minute counts, a case's pulse, and an audit log verified as it grows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def minute_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(m, n, f) of (ts, flagged): events later than ``late`` are dropped, closed minutes leave the state."""
    w = F.window("ts", "1 minute")
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"), F.count_if("flagged").alias("f")).select((F.unix_seconds("window.start") / 60).cast("long").alias("m"), "n", "f")


def pulse(changes: DataFrame) -> DataFrame:
    """(evidence_id, changes, last_id): what other examiners have changed so far."""
    return changes.groupBy("evidence_id").agg(F.count("*").alias("changes"), F.max("id").alias("last_id"))


AUDIT = "chain long, seq long, ok boolean"


def audit_stream(log: DataFrame) -> DataFrame:
    """(chain, seq, ok) of each row of a growing log; the state of a chain is its last hash and number.

    Rows of one trigger are taken in order of ``seq``; a gap or a wrong hash is not ok, and the chain goes on from the
    hash that is stored.
    """

    def verify(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before = state.get if state.exists else (0, "")
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            parts = [before, *("None" if x is None or x != x else str(x) for x in (r.seq, r.at, r.examiner, r.action, r.detail))]
            ok = r.seq == last + 1 and r.prev_hash == before and hashlib.sha256("|".join(parts).encode()).hexdigest() == r.hash
            out.append((key[0], r.seq, ok))
            last, before = r.seq, r.hash
        state.update((int(last), before))
        yield pd.DataFrame(out, columns=["chain", "seq", "ok"])

    return log.groupBy("chain").applyInPandasWithState(verify, AUDIT, "last long, hash string", "append", GroupStateTimeout.NoTimeout)
