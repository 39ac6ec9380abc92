"""A model of the user's own as an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_MODELS: dict = {}


def scored(df: DataFrame, name: str, load: Callable, columns, schema: str) -> DataFrame:
    """df's `columns` with what a model adds to them, in Arrow batches.

    load() gives the model, a function from an Arrow batch to a list of Arrow arrays, one
    for each field of `schema` (name type, name type). It is called on the workers, once
    each: `name` tells models apart there, so give another model another name. Rows keep
    their batch, so a model sees at most spark.sql.execution.arrow.maxRecordsPerBatch.
    """
    columns = list(columns)
    added = [f.split()[0] for f in schema.split(",")]
    kept = df.select(*[f"`{c}`" for c in columns])

    def run(batches):
        import pyarrow as pa

        if name not in _MODELS:
            _MODELS[name] = load()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_MODELS[name](batch)], names=[*columns, *added])

    return kept.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), schema]))
