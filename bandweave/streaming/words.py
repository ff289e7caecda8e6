"""Words of an unbounded stream of values: count-based windows with state.

Values arrive already scaled (a minimum over an unbounded series never settles) in the order of t within each series, late
ones within a micro-batch included. A word is sent as soon as its window is full; the state of a series is its open window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.bands import Bands
from ..operators.symbolic import quantise


def stream_words(scaled: DataFrame, bands: Bands, width: int = 3) -> DataFrame:
    """object_id, component, sensor, t, word, avg of non-overlapping windows of `width` values. scaled: ... t, scaled."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, held, labels = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows = pd.concat(list(batches)).sort_values("t")
        times += rows.t.tolist()
        held += rows.band.tolist()
        labels += rows.label.tolist()
        out = []
        while len(held) >= width:
            out.append((*key, times[0], "-".join(map(str, held[:width])), sum(labels[:width]) / width))
            times, held, labels = times[width:], held[width:], labels[width:]
        state.update((times, held, labels))
        yield pd.DataFrame(out, columns=["object_id", "component", "sensor", "t", "word", "avg"])

    kinds = dict(scaled.dtypes)
    schema = f"object_id {kinds['object_id']}, component {kinds['component']}, sensor {kinds['sensor']}, t long, word string, avg double"
    grouped = quantise(scaled, bands).groupBy("object_id", "component", "sensor")
    return grouped.applyInPandasWithState(step, schema, "times array<long>, bands array<int>, labels array<double>", "append", GroupStateTimeout.NoTimeout)
