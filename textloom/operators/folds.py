"""Folds over the rows of a key in order, read as a stream: only the state of one key is held, however many rows it has."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

State = Any


def folded(df: DataFrame, keys: list[str], order: list[str], reads: list[str], adds: str, start: Callable[[], State], step: Callable[..., tuple[State, tuple]]) -> DataFrame:
    """Adds what step gives for each row: (state, values of the added columns) from the state and the row's `reads`.

    Rows are dealt by the keys and sorted by them and the order, which should be total; null keys are a key. adds: a schema.
    """
    kinds = StructType.fromDDL(adds)
    names = [f.name for f in kinds]
    schema = StructType([*df.schema.fields, *kinds.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in kinds]
        last, state = None, start()
        for batch in batches:
            at = batch.schema.get_field_index
            key = zip(*(batch.column(at(k)).to_pylist() for k in keys))
            rows = zip(*(batch.column(at(c)).to_pylist() for c in reads))
            out = []
            for k, row in zip(key, rows):
                if k != last:
                    last, state = k, start()
                state, values = step(state, *row)
                out.append(values)
            new = [pa.array([v[i] for v in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
