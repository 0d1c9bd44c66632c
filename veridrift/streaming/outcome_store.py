"""A prediction store with a capacity as keyed state of a stream: outcomes of predictions that have left it are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CAPACITY = 10_000
RESULT = "key string, prediction_id string, outcome double, result string"


def store_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep state in RocksDB, as keyed processors need; the given session's settings stay."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


class PredictionStore(StatefulProcessor):
    """The newest ``capacity`` predictions of a key, in order of arrival.

    State: the bounds by prediction id, the ids by arrival number, and the numbers of the oldest and of the next. What arrives and
    leaves within one batch touches no state; else a prediction costs two writes and two removals in its life, an outcome one read.
    """

    def __init__(self, capacity: int, order: list[str]) -> None:
        self.capacity, self.order = capacity, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bounds = handle.getMapState("bounds", "id string", "lower double, upper double")
        self.arrivals = handle.getMapState("arrivals", "number long", "id string")
        self.counters = handle.getValueState("counters", "oldest long, next long, held long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        oldest, after, held = self.counters.get() if self.counters.exists() else (0, 0, 0)
        known: dict[str, tuple[float, float] | None] = {}  # of this batch: bounds, or None where it has been looked up or removed in vain
        stored: dict[str, bool] = {}  # whether the state has the id
        queue: dict[int, str] = {}

        def look(i: str) -> tuple[float, float] | None:
            if i not in known:
                stored[i] = self.bounds.containsKey((i,))
                known[i] = tuple(self.bounds.getValue((i,))) if stored[i] else None
            return known[i]

        answers = []
        for r in pd.concat(list(rows)).sort_values(self.order, kind="stable").itertuples(index=False):
            i = str(r.prediction_id)
            if r.kind == "prediction":
                held += look(i) is None
                known[i], queue[after] = (float(r.lower), float(r.upper)), i
                after += 1
                while held > self.capacity:
                    if oldest in queue:
                        first = queue.pop(oldest)
                    else:
                        first = self.arrivals.getValue((oldest,))[0]
                        self.arrivals.removeKey((oldest,))
                    oldest += 1
                    if look(first) is not None:
                        known[first], held = None, held - 1
            else:
                b = look(i)
                answers.append((str(key[0]), i, float(r.outcome), "ignored" if b is None else "covered" if b[0] <= r.outcome <= b[1] else "missed"))
        for number, i in queue.items():
            self.arrivals.updateValue((number,), (i,))
        for i, b in known.items():
            if b is not None:
                self.bounds.updateValue((i,), b)
            elif stored[i]:
                self.bounds.removeKey((i,))
        self.counters.update((oldest, after, held))
        yield pd.DataFrame(answers, columns=["key", "prediction_id", "outcome", "result"])

    def close(self) -> None:
        pass


def outcome_answers(stream: DataFrame, key: str, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``key, prediction_id, outcome, result`` for each outcome: ``covered``, ``missed``, or ``ignored`` where the key's store has no such prediction (any more).

    ``stream``: ``key, kind`` (``prediction`` or ``outcome``), ``prediction_id, lower, upper, outcome`` and the columns of ``order``,
    by which the rows of a batch are taken. A key holds its newest ``capacity`` predictions, the first to come leaves first; an id
    that comes again takes the new bounds and leaves when its first arrival does. The stream must belong to a ``store_session``.
    """
    names = ["kind", "prediction_id", "lower", "upper", "outcome"]
    rows = stream.select(F.col(key).cast("string").alias("key"), *names, *[c for c in order if c not in names])
    return rows.groupBy("key").transformWithStateInPandas(PredictionStore(capacity, order), RESULT, "Append", "None")
