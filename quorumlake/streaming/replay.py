"""Ordered state machines over a key: replayed from a table, or run on a stream, with equal results.

A machine is a function ``step(state, event) -> list of output dicts`` on a plain dict state that JSON
can hold. In a batch each key's events come to one task in their order, streamed through;
on a stream the state lives in the state store between micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

Step = Callable[[dict, dict], list[dict]]


@dataclass(frozen=True)
class Machine:
    """A step function, the order of a key's events, and the DDL schema of its outputs after the key."""

    step: Step
    order: str
    output: str


def _plain(row: dict) -> dict:
    """A row's values as JSON can hold them; missing ones are None."""
    out = {}
    for name, value in row.items():
        if isinstance(value, (list, np.ndarray)):
            out[name] = [x.item() if isinstance(x, np.generic) else x for x in value]
        elif value is None or value is pd.NA or value != value:
            out[name] = None
        else:
            out[name] = value.item() if isinstance(value, np.generic) else value
    return out


def replay(events: DataFrame, key: str, machine: Machine) -> DataFrame:
    """The machine's outputs over a stored table. Events are sorted outside Python and need not fit in memory."""
    schema = f"{key} {dict(events.dtypes)[key]}, {machine.output}"
    names = [x.strip().split()[0] for x in schema.split(",")]
    step = machine.step

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = object(), {}, []
        for part in parts:
            for event in map(_plain, part.to_dict("records")):
                if event[key] != now:
                    now, state = event[key], {}
                out += [{key: now, **x} for x in step(state, event)]
            yield pd.DataFrame(out, columns=names).astype(object)
            out = []

    width = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartition(width, key).sortWithinPartitions(key, machine.order).mapInPandas(run, schema)


class Keeper(StatefulProcessor):
    """Runs a step function on a stream; each field of a key's state is an entry of a map state, written only when it changed."""

    def __init__(self, step: Step, order: str, key: str, names: list[str]):
        self.step, self.order, self.key, self.names = step, order, key, names

    def init(self, handle) -> None:
        self.entries = handle.getMapState("entries", "name string", "value string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        before = {name[0]: value[0] for name, value in self.entries.iterator()}
        state = {name: json.loads(value) for name, value in before.items()}
        events = pd.concat(list(rows)).sort_values(self.order)
        out = [{self.key: key[0], **x} for event in map(_plain, events.to_dict("records")) for x in self.step(state, event)]
        now = {name: json.dumps(value) for name, value in state.items()}
        for name, value in now.items():
            if before.get(name) != value:
                self.entries.updateValue((name,), (value,))
        for name in before.keys() - now.keys():
            self.entries.removeKey((name,))
        yield pd.DataFrame(out, columns=self.names)


def stream(events: DataFrame, key: str, machine: Machine) -> DataFrame:
    """The same on a streaming table. A micro-batch's events are ordered; a later batch's must come after. Needs the RocksDB state store."""
    schema = f"{key} {dict(events.dtypes)[key]}, {machine.output}"
    names = [x.strip().split()[0] for x in schema.split(",")]
    return events.groupBy(key).transformWithStateInPandas(Keeper(machine.step, machine.order, key, names), schema, "Append", "None")
