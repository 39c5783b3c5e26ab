"""The journal normaliser as a stateful stream, and overlays kept up to date by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import journal as j


def normalise_stream(journal: DataFrame) -> DataFrame:
    """:func:`seekloom.operators.journal.normalise` over a stream: a pending old name is keyed state.

    State outlives batches and restarts through the stream's own checkpoint. A file's rows are taken in
    order of ``usn`` within a batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("usn", kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            reason, folder = int(row.reason), bool(int(row.attributes) & j.DIRECTORY)
            if reason & j.HARD_LINK:
                out.append((row.usn, row.file_reference, "reconcile", None, None, folder))
            if reason & j.RENAME_OLD:
                pending = row.name
            elif reason & j.RENAME_NEW:
                known = pending is not None
                out.append((row.usn, row.file_reference, "rename" if known else "reconcile", pending, row.name if known else None, folder))
                pending = None
            else:
                for bits, action in ((j.FILE_CREATE, "create"), (j.FILE_DELETE, "delete"), (j.CHANGED, "modify")):
                    if reason & bits:
                        out.append((row.usn, row.file_reference, action, None, row.name, folder))
                        break
        if pending is None:
            if state.exists:
                state.remove()
        else:
            state.update((pending,))
        yield pd.DataFrame(out, columns=["usn", "file_reference", "action", "old_name", "new_name", "is_directory"])

    return journal.groupBy("file_reference").applyInPandasWithState(run, j.EVENT_SCHEMA, "pending string", "append", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, reconcile: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, seconds: float = 0.25):
    """Call ``reconcile`` with each micro-batch of changes; ``once`` takes what is there and stops."""
    trigger = {"availableNow": True} if once else {"processingTime": f"{max(seconds, 0.025)} seconds"}
    return stream.writeStream.foreachBatch(reconcile).option("checkpointLocation", checkpoint).trigger(**trigger).start()
