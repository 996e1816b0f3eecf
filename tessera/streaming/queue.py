"""A ring buffer of rows by key, kept in a stream's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ring(rows: DataFrame, key: str, index: str, value: str, size: int) -> DataFrame:
    """(key, slot, index, value) of the slots that each batch writes: row n of a key goes to slot n modulo `size`, over what was there.

    The state of a key is its count of rows so far; a batch's rows are put in by their index.
    """

    def put(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (written,) = state.get if state.exists else (0,)
        pdf = pd.concat(list(batches)).sort_values(index, kind="stable").reset_index(drop=True)
        pdf["slot"] = (written + pdf.index) % size
        state.update((written + len(pdf),))
        last = pdf.drop_duplicates("slot", keep="last")
        yield pd.DataFrame({"key": of[0], "slot": last["slot"], "index": last[index], "value": last[value]})

    chosen = rows.select(key, index, value)
    return chosen.groupBy(key).applyInPandasWithState(put, "key long, slot long, index long, value double", "written long", "append", GroupStateTimeout.NoTimeout)
