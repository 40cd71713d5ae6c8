"""Folds: one small state a key, carried over a sorted stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame


def folded(df: DataFrame, key: str, order: list[Column], inputs: list[str], start: Callable[[], Callable[..., tuple]], added: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """df with columns that a fold gives for each row, by key in order. start()
    begins a key; what it returns takes a row's inputs and gives the values of
    `added`, name: (Spark's type, Arrow's type). Spark sorts, and spills, by key
    and order; Python holds one batch and one state."""
    names = [*df.columns, *added]
    line = df.repartition(key).sortWithinPartitions(key, *order)
    kinds = [kind for _, kind in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = None, None
        for batch in batches:
            found = []
            for now, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in inputs)):
                if step is None or now != last and (now == now or last == last):  # NaN is one key
                    step, last = start(), now
                found.append(step(*row))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]], names)

    types = dict(df.dtypes) | {c: t for c, (t, _) in added.items()}
    return line.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names))
