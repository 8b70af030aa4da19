"""Runs of a benchmark as a keyed stream: how far each is, how fast, how long it will take, and whether it has stalled."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run string, done long, total long, rate double, seconds_left double, status string, at timestamp"
_STATE = "done array<string>, total long, began double, last double, warned boolean"


def run_progress(events: DataFrame, run: str = "run", case: str = "case_id", total: str = "total", at: str = "at", late: str = "10 minutes", silent: float = 600.0, forget: float = 86_400.0) -> DataFrame:
    """A row for each run that a batch has news of: (run, done, total, rate, seconds_left, status, at).

    Events say that a case of a run of ``total`` cases is done. A case counts once, however often it comes; the largest
    total counts. ``rate`` is cases a second from the first event to the last. ``status`` is running, finished when all
    cases are done, and stalled once the watermark is ``silent`` seconds past a run's last event and cases are missing; a
    late event brings it back. A run that is finished, or silent for ``forget`` seconds, is dropped, and starts anew if an
    event comes after all. Events later than the watermark are left out by Spark; those without a run, case or time, here.
    """
    rows = events.select(F.col(run).cast("string").alias("run"), F.col(case).cast("string").alias("case"), F.col(total).cast("long").alias("total"), F.col(at).cast("timestamp").alias("at"))
    timed = rows.where("run is not null and case is not null and at is not null").withWatermark("at", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, of, began, last, warned = state.get if state.exists else ([], 0, float("inf"), float("-inf"), False)
        known, now = set(done), state.getCurrentWatermarkMs() / 1000
        if state.hasTimedOut:
            if warned or now >= last + forget:
                state.remove()
                return
            warned, status = True, "stalled"
        else:
            for batch in batches:
                known |= set(batch["case"])
                of = max(of, int(batch["total"].fillna(0).max()))
                stamps = batch["at"].astype("datetime64[us]").astype("int64") / 1e6
                began, last = min(began, float(stamps.min())), max(last, float(stamps.max()))
            warned, status = False, "finished" if of and len(known) >= of else "running"
        rate = (len(known) - 1) / (last - began) if last > began else None
        left = max(0, of - len(known)) / rate if rate else None
        if status == "finished":
            state.remove()
        else:
            state.update((sorted(known), of, began, last, warned))
            due = last + (forget if warned else silent)
            state.setTimeoutTimestamp(int(max(due, now + 0.001) * 1000))
        stamp = datetime.fromtimestamp(last, timezone.utc).replace(tzinfo=None)
        yield pd.DataFrame({"run": [key[0]], "done": [len(known)], "total": [of], "rate": [rate], "seconds_left": [left], "status": [status], "at": [stamp]})

    return timed.groupBy("run").applyInPandasWithState(step, OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
