"""Event log followed as a stream: apply in sequence, wait on gaps, start anew at a head."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# An event of this kind says that a snapshot holds everything up to its number.
HEAD = "HEAD"
OUTPUT = (
    "log_id string, action string, seq string, kind string, resource_id string, "
    "resource_revision string, state string"
)
_EVENT = ["seq", "kind", "resource_id", "resource_revision", "state"]


NUMBER = r"0|[1-9][0-9]*"


def _valid(frame: pd.DataFrame) -> pd.Series:
    def number(column):
        return frame[column].astype("string").str.fullmatch(NUMBER).fillna(False)

    return (
        (frame["schema_version"] == 1) & number("seq") & number("resource_revision")
        & frame["kind"].notna() & frame["resource_id"].fillna("").ne("")
    )


class TaskStateProcessor(StatefulProcessor):
    """State per log: the last applied number, and every event that waits behind a gap, however many.

    Emits APPLY (newest event per resource of the micro-batch), GAP (first missing number), INVALID
    (an event that breaks the form; its neighbours go on) and HEAD (counting goes on after this number).
    Waiting events stay in the state store and are looked up by number, never loaded together.
    """

    def __init__(self, start_after: str = "0"):
        self.start_after = start_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq string")
        self.pending = handle.getMapState(
            "pending", "seq string",
            "kind string, resource_id string, resource_revision string, state string",
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0]) if self.last.exists() else int(self.start_after)
        applied, out, head = {}, [], None

        def apply(seq, event):
            applied[(event[0], event[1])] = (str(seq), *event)

        def advance(last):
            while self.pending.containsKey((str(last + 1),)):
                last += 1
                apply(last, tuple(self.pending.getValue((str(last),))))
                self.pending.removeKey((str(last),))
            return last

        for frame in rows:
            good = _valid(frame)
            out += [(key[0], "INVALID", *e) for e in frame.loc[~good, _EVENT].itertuples(index=False, name=None)]
            frame = frame.loc[good, _EVENT].drop_duplicates("seq")
            is_head = frame["kind"] == HEAD
            heads = [int(s) for s in frame.loc[is_head, "seq"]]
            head = max([*heads, *([] if head is None else [head])], default=None)
            frame = frame[~is_head]
            frame = frame.assign(_n=frame["seq"].map(int)).sort_values("_n")
            for seq, event in zip(frame["_n"], frame[_EVENT[1:]].itertuples(index=False, name=None)):
                if seq == last + 1:
                    last = seq
                    apply(seq, event)
                    last = advance(last)
                elif seq > last and not self.pending.containsKey((str(seq),)):
                    self.pending.updateValue((str(seq),), event)
        if head is not None and head > last:
            last = head
            for seq in [k[0] for k in self.pending.keys() if int(k[0]) <= last]:
                self.pending.removeKey((seq,))
            applied.clear()  # the snapshot holds these
            out.append((key[0], "HEAD", str(last), None, None, None, None))
            last = advance(last)
        out += [(key[0], "APPLY", *row) for row in sorted(applied.values(), key=lambda r: int(r[0]))]
        if self.pending.exists():
            out.append((key[0], "GAP", str(last + 1), None, None, None, None))
        self.last.update((str(last),))
        yield pd.DataFrame(out, columns=["log_id", "action", *_EVENT], dtype=object)

    def close(self) -> None:
        pass


def stream_task_state(events: DataFrame, start_after: str = "0") -> DataFrame:
    """Streaming events (log_id, schema_version, seq, kind, resource_id, resource_revision, state)
    -> actions. Needs the RocksDB state store provider."""
    return events.groupBy("log_id").transformWithStateInPandas(
        statefulProcessor=TaskStateProcessor(start_after),
        outputStructType=OUTPUT, outputMode="Append", timeMode="None",
    )
