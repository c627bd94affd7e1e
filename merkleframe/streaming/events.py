"""Extension: the event log as a stream.

Events are collapsed per location as they come: a state of one id per location tells whether an event is
a new revision. Events of a location must come in order of time (within a trigger they are sorted).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = "id string, previous_id string, location string, created_at timestamp"


def _revisions(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("created_at", kind="stable")
    out = []
    for r in rows.itertuples():
        if r.id != last:
            out.append((r.id, last, key[0], r.created_at))
            last = r.id
    state.update((last,))
    if out:
        yield pd.DataFrame(out, columns=["id", "previous_id", "location", "created_at"])


def collapse_stream(events: DataFrame) -> DataFrame:
    """History rows of a stream of events (id, location, created_at)."""
    rows = events.select("id", "location", "created_at")
    return rows.groupBy("location").applyInPandasWithState(_revisions, HISTORY, "last string", "append", GroupStateTimeout.NoTimeout)


def ingest(events: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the history of a stream of events under ``folder``."""
    writer = collapse_stream(events).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
