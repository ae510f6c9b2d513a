"""Batch progress as a stream: running counters of each job, the same as the batch query on the same events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "job long, files_done long, files_failed long, units_done long, units_total long, status string"
STATE = "seen array<long>, files_done long, files_failed long, units_done long, budget long"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, done, failed, units, budget = state.get if state.exists else ([], 0, 0, 0, 0)
    known = set(seen)
    total = 0
    for b in batches:
        for e in b.sort_values("seq").itertuples():
            total = max(total, int(e.total) if e.total == e.total else 0)
            if e.seq in known:  # an event that came twice
                continue
            known.add(e.seq)
            done, failed = done + (not e.failed), failed + bool(e.failed)
            budget += int(e.budget) if e.budget == e.budget else 0
            units = max(units + (int(e.pages) if e.pages == e.pages else 0), budget)  # a failed file's pages count as gone through
    state.update((sorted(known), done, failed, units, budget))
    status = "running" if len(known) < total else "error" if failed and not done else "done"
    yield pd.DataFrame([(int(key[0]), done, failed, units, max(budget, units), status)], columns=[c.split()[0] for c in OUT.split(", ")])


def follow(events: DataFrame) -> DataFrame:
    """Events (job, seq, failed, pages, budget, total) as a stream of each job's counters; nothing waits for a watermark.

    seq numbers a job's files, of which there are total; an event that comes again counts once. After each file at least its budget
    so far is done, so that a job with failed files ends. The state holds the numbers of one job's files."""
    return events.groupBy("job").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
