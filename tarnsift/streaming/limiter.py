"""The sliding-log limiter on a stream: the state of a client is its last admitted times."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnsift.operators.state import admit


def limited_stream(requests: DataFrame, rate: int = 10) -> DataFrame:
    """requests (request_id, client, seconds), a stream: every request with admitted and retry_after. Within a batch
    a client's requests are taken in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["seconds", "request_id"])
        out = [admit(times, s, rate) for s in rows["seconds"]]
        state.update((list(times),))
        yield pd.DataFrame({"request_id": rows["request_id"].to_numpy(), "client": key[0], "admitted": [a for a, _ in out], "retry_after": [w for _, w in out]})

    return requests.groupBy("client").applyInPandasWithState(
        step, "request_id long, client long, admitted boolean, retry_after long", "times array<double>", "append", GroupStateTimeout.NoTimeout)
