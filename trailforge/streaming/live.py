"""A chain over a stream of records, one state for each track.

Records count in the order they arrive: by micro-batch, and within one by file and record. Late records are processed
when they come; there is no watermark, as a filter's state has no end in event time. NaN comes out as null.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import ORDER
from .steps import process, step_of


def run_live(records: DataFrame, chain: Iterable) -> DataFrame:
    """A stream of records after every stage, with reason; query it in append mode."""
    chain = list(chain)
    for name in ("error", "reason"):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast("string"))
    names = records.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps = pickle.loads(state.get[0]) if state.exists else [step_of(x) for x in chain]
        rows = pd.concat(batches).sort_values(list(ORDER), kind="stable")
        text = [c for c in ("error", "reason", "time") if c in names]
        made = []
        for p in rows.to_dict("records"):
            for c in text:
                p[c] = p[c] if isinstance(p[c], str) else None
            made.append(process(steps, p))
        state.update((pickle.dumps(steps),))
        yield pd.DataFrame(made, columns=names)

    return records.groupBy("track_id").applyInPandasWithState(run, records.schema, "steps binary", "append", GroupStateTimeout.NoTimeout)
