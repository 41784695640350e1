"""Batch scoring with a caller's model (M6): the only place where Python runs on the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Scorer = Callable[[list], Sequence]
# Rows whose inputs are Python objects at a time, at most about.
HELD_ROWS = 256


def score_texts(
    df: DataFrame,
    column: str,
    load: Callable[[], Scorer],
    output: str,
    output_type: str | T.DataType,
    batch_size: int = 32,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``output`` = the scorer's result for ``column`` (text or a sequence), and ``score_error``.

    ``load`` is called once per task and returns a function from a list of inputs to a list of
    results. A batch that fails is tried again one input at a time, so one bad row does not take
    its neighbours along; its own result is NULL and the message goes to ``score_error``.
    ``partitions`` spreads an expensive model over more tasks than the input has.

    Rows stay Arrow buffers on their way; only the inputs of a few batches at a time become Python
    objects, so a worker's memory is set by the session's Arrow batches, not by what is scored.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField(output, _as_type(df, output_type)), T.StructField("score_error", T.StringType())]
    )

    kind = to_arrow_type(schema[output].dataType)
    held = batch_size * max(HELD_ROWS // batch_size, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or load()
            for first in range(0, batch.num_rows, held):
                part = batch.slice(first, held)
                inputs = part.column(column).to_pandas().tolist()
                results, errors = [], []
                for start in range(0, len(inputs), batch_size):
                    got, failed = _score_batch(scorer, inputs[start : start + batch_size])
                    results += got
                    errors += failed
                scores = pa.Array.from_pandas(pd.Series([_plain(x) for x in results], dtype=object), type=kind, safe=False)
                yield pa.RecordBatch.from_arrays([*part.columns, scores, pa.array(errors, pa.string())], names=schema.names)

    source = df if partitions is None else df.repartition(partitions)
    return source.mapInArrow(run, schema)


def _plain(result):
    """A result as Arrow takes it: rows as dicts, arrays in them or of more dimensions as lists."""
    if isinstance(result, Row):
        result = result.asDict()
    if isinstance(result, dict):
        return {k: _plain(v) for k, v in result.items()}
    if isinstance(result, np.ndarray) and result.ndim > 1:
        return result.tolist()
    return result


def _score_batch(scorer: Scorer, batch: list) -> tuple[list, list]:
    try:
        return list(scorer(batch)), [None] * len(batch)
    except Exception:
        results, errors = [], []
        for one in batch:
            try:
                results.append(scorer([one])[0])
                errors.append(None)
            except Exception as error:
                results.append(None)
                errors.append(f"{type(error).__name__}: {error}")
        return results, errors


def _as_type(df: DataFrame, given: str | T.DataType) -> T.DataType:
    if isinstance(given, T.DataType):
        return given
    return T.DataType.fromDDL(given)
