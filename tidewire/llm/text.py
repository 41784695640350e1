"""Helpers shared by the text operators: raw bytes in, words and Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# The six white-space characters that end a word, as bytes.
BLANKS = b" \t\n\x0b\x0c\r"
# Groups of more rows than this may be broadcast, and fewer than so many are.
HOT_ROWS, HOT_GROUPS = 256, 100_000
# Bytes of texts that a task function gets at once.
SLICE_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"


def fold_ascii(text: bytes) -> bytes:
    """Lower-case A-Z and nothing else (``bytes.lower`` leaves every byte above 0x7F alone)."""
    return text.lower()


def split_words(text: bytes) -> list[bytes]:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]`` of a UTF-8 text, as bytes."""
    return text.split()


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def drawn(key: str, salt: str) -> Column:
    """A number in [0, 1) from a hash of a column: rows below a rate are a sample that reruns repeat."""
    steps = 1 << 40
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(steps)) / float(steps)


def raw_text(text_col: str) -> Column:
    """The text as UTF-8 bytes, NULL as no bytes."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, slice_rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of bounded length: columns as Python lists in, lists or arrays out.

    A slice has at most ``slice_rows`` rows, and no more than ``SLICE_BYTES`` bytes of binary
    columns unless one row alone has more.

    ``fn`` may carry state between slices of a task through its own closure; it is built once per
    task when it has an attribute ``per_task`` (a factory).
    """
    out_schema = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn.per_task() if hasattr(fn, "per_task") else fn
        for batch in batches:
            for start, stop in slices_of(batch, slice_rows):
                part = batch.slice(start, stop - start)
                cols = step({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out_schema], schema=out_schema)
        rest = getattr(step, "finish", None)
        if rest is not None:
            cols = rest()
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, schema)


def slices_of(batch: pa.RecordBatch, slice_rows: int) -> Iterator[tuple[int, int]]:
    """(first row, end) of slices with at most so many rows and about ``SLICE_BYTES`` bytes."""
    held = [column for column in batch.columns if pa.types.is_binary(column.type)]
    sizes = [sum(row) for row in zip(*(pc.fill_null(pc.binary_length(c), 0).to_pylist() for c in held), strict=True)] if held else None
    start, size = 0, 0
    for row in range(batch.num_rows):
        more = sizes[row] if sizes else 0
        if row > start and (row - start >= slice_rows or size + more > SLICE_BYTES):
            yield start, row
            start, size = row, 0
        size += more
    if batch.num_rows:
        yield start, batch.num_rows


def arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    """The Arrow form of a DDL schema; only the simple types used here."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or the first ``wanted_2``, ``wanted_3``, ... that no column has (any case)."""
    low = {c.lower() for c in taken}
    name, n = wanted, 1
    while name.lower() in low:
        n += 1
        name = f"{wanted}_{n}"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], members: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group: an inner join on ``keys`` that no group can make uneven.

    ``groups`` has one row per group, ``members`` (a long column of it, not in the result) says how
    many of the ``total`` rows are in it. Groups of more than ``HOT_ROWS`` rows and of more than
    one in ``HOT_GROUPS`` of all rows are broadcast: there are fewer than HOT_GROUPS of them
    whatever the data, and their rows are not shuffled at all. The others are joined by a shuffle.
    """
    found = free_name(rows.columns + groups.columns, "is_hot")
    added = [c for c in groups.columns if c not in (*keys, members)]
    least = max(HOT_ROWS, total / HOT_GROUPS)
    hot = groups.where(F.col(members) > least).drop(members).withColumn(found, F.lit(True))
    tried = rows.join(F.broadcast(hot), keys, "left")
    plain = groups.where(F.col(members) <= least).drop(members)
    settled = tried.where(found).select(*rows.columns, *added)
    rest = tried.where(F.col(found).isNull()).select(*rows.columns).join(plain, keys)
    return settled.unionByName(rest.select(*rows.columns, *added))


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number is in ``rows`` (one long column ``row``), all columns.

    Rows are numbered by ``monotonically_increasing_id``, so ``docs`` must read the same rows in
    the same order each time, as a scan of files does.
    """
    number = free_name(docs.columns, "__row")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    kept = rows.select(F.col("row").alias(f"{number}_kept"))
    return numbered.join(kept, F.col(number) == F.col(f"{number}_kept"), "left_semi").drop(number)
