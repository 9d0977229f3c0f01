"""The ways to execute a model over a DataFrame of points, behind one interface: each says what it can run, and runs it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.lang import columns, lanes, scalar
from plumbline.lang.lanes import MAX_STEPS
from plumbline.lang.model import Model


@dataclass(frozen=True)
class Executor:
    """refuses: why a model cannot be run, or None. run: points (with x) with y, traces, flags, steps and rules."""

    name: str
    refuses: Callable[[Model], str | None]
    run: Callable[[DataFrame, Model, int], DataFrame]


def _needs_adapter(model: Model) -> str | None:
    return "the model calls an outside program" if model.opaque else None


def _as_columns(model: Model) -> str | None:
    return _needs_adapter(model) or (None if columns.expressible(model) else "loops, fma and whole-number arithmetic are no Columns")


def _one_by_one(single: bool) -> Callable[[DataFrame, Model, int], DataFrame]:
    def made(points: DataFrame, model: Model, max_steps: int) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            execute = scalar.compiled(model, single, max_steps)
            deep = pa.list_(pa.list_(pa.float64()))
            for b in batches:
                done = [execute(x) for x in b.column(b.schema.get_field_index("x")).to_pylist()]
                parts = [([r.y for r in done], pa.list_(pa.float64())), ([r.traces for r in done], deep), ([r.flags for r in done], pa.int32()), ([r.steps for r in done], pa.int64()), ([[list(pair) for pair in r.rules] for r in done], deep)]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, t) for v, t in parts)], names=[*b.schema.names, "y", "traces", "flags", "steps", "rules"])

        fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in points.schema)
        return points.mapInArrow(run, f"{fields}, {lanes.RESULT}")

    return made


EXECUTORS = {
    e.name: e
    for e in (
        Executor("columns", _as_columns, lambda points, model, max_steps: columns.run_model(points, model)),
        Executor("lanes", _needs_adapter, lambda points, model, max_steps: lanes.run_model(points, model, "f64", max_steps)),
        Executor("lanes-f32", _needs_adapter, lambda points, model, max_steps: lanes.run_model(points, model, "f32", max_steps)),
        Executor("reference", _needs_adapter, lambda points, model, max_steps: lanes.run_model(points, model, "reference", max_steps)),
        Executor("scalar", _needs_adapter, _one_by_one(False)),
        Executor("scalar-f32", _needs_adapter, _one_by_one(True)),
    )
}


def execute(points: DataFrame, model: Model, by: str = "", max_steps: int = MAX_STEPS) -> DataFrame:
    """Run a model by a named executor, or by the first that does not refuse it."""
    for e in [EXECUTORS[by]] if by else EXECUTORS.values():
        if (why := e.refuses(model)) is None:
            return e.run(points, model, max_steps)
    raise ValueError(f"{by or 'no executor'}: {why}")
