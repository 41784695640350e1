"""Exact de-duplication by naming blocks with integers.

A text is cut into blocks of a fixed number of bytes. All blocks of the corpus are sorted, and each
distinct block gets an integer name. Adjacent names of a document are then paired and the pairs are
sorted and named in the same way, until each document has one name. Names are equal exactly when
the bytes are: no hash takes part in the decision.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.text import join_groups, keep_rows
from tidewire.session import materialise

BLOCK_BYTES = 16384
# Names of one task start at the task's number shifted by this; a task has fewer rows.
TASK_SHIFT = 40


def _name_runs(carried: list[str]):
    """Task function: rows sorted by (``mark``, ``key``) get one name per run of equal keys.

    Besides the rows it gives out, with ``edge`` set, the keys that share the task's first or last
    mark, and their names: only their runs can go on in another task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (TaskContext.get().partitionId() << TASK_SHIFT) - 1
        mark = last = None
        started, first_done = False, False
        edges: list[tuple[bytes, int]] = []
        same_mark: list[tuple[bytes, int]] = []
        for batch in batches:
            names = []
            for here, key in zip(batch.column("mark").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if not started or here != mark:
                    if started and not first_done:
                        edges, first_done = same_mark, True
                    mark, same_mark, started, last = here, [], True, None
                if key != last:
                    name += 1
                    last = key
                    same_mark.append((key, name))
                names.append(name)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(names, pa.int64()), pa.nulls(len(names), pa.binary())],
                names=[*carried, "name", "edge"],
            )
        if started:
            edges = edges + same_mark
            kinds = [batch.schema.field(c).type for c in carried]
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(edges), kind) for kind in kinds), pa.array([n for _, n in edges], pa.int64()), pa.array([k for k, _ in edges], pa.binary())],
                names=[*carried, "name", "edge"],
            )

    return run


def name_by_sort(rows: DataFrame, order: str) -> DataFrame:
    """Give equal values of the binary column ``key`` the same integer ``name``.

    Rows are sorted by a 64-bit mark of the key, then the key itself, and range-partitioned by
    (mark, ``order``): a key that many rows have is spread over as many tasks as its size asks
    for, instead of one, and only marks go through the driver to find the ranges. Keys are always
    compared whole, so equal marks of different keys do no harm. A key in several tasks gets one
    name per task first; the smallest of them holds. ``key`` is not in the result, which is a
    written table.
    """
    carried = [c for c in rows.columns if c != "key"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carried).schema.fields)
    marked = rows.withColumn("mark", F.xxhash64("key"))
    dealt = marked.repartitionByRange("mark", order).sortWithinPartitions("mark", "key")
    named = dealt.select(*carried, "mark", "key").mapInArrow(_name_runs(carried), f"{kinds}, name long, edge binary")
    named = materialise(named, "block-names")
    edges = named.where("edge is not null").select("edge", "name")
    whole = edges.groupBy("edge").agg(F.min("name").alias("first_name"))
    # The keys of two marks per task of the sort: a bound that rows and texts do not move.
    alias = edges.join(whole, "edge").where("name <> first_name").select("name", "first_name").distinct()
    return (
        named.where("edge is null")
        .drop("edge")
        .join(F.broadcast(alias), "name", "left")
        .withColumn("name", F.coalesce("first_name", "name"))
        .drop("first_name")
    )


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: row, id, text_sha256, n_bytes, name.

    (n_bytes, name) is the identity: two rows have the same one exactly when their texts are
    byte for byte the same. NULL text counts as empty. ``row`` numbers the input's rows; ``docs``
    must read the same rows in the same order when run again, as a scan of files does.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.sha2(text, 256).alias("text_sha256"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.cast("binary").alias("bytes"),
    )
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_bytes") / block_bytes), F.lit(1)).cast("int") - 1)
    cut = F.transform(starts, lambda i: F.substr("bytes", i * block_bytes + 1, F.lit(block_bytes)))
    blocks = rows.select("row", "id", "text_sha256", "n_bytes", F.posexplode(_cover(cut, block_bytes)).alias("idx", "key"))
    named = name_by_sort(blocks, "row")
    many = F.col("n_bytes") > block_bytes
    longest = named.agg(F.max("n_bytes")).first()[0] or 0
    most = -(-longest // block_bytes)
    current = named.where(many).select("row", "idx", "name")
    while most > 1:
        pairs = current.groupBy("row", F.floor(F.col("idx") / 2).cast("int").alias("half")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("b"),
        )
        # A document's odd last block pairs with nothing.
        key = F.concat_ws(",", "a", F.coalesce("b", F.lit(-1))).cast("binary")
        current = name_by_sort(pairs.select("row", F.col("half").alias("idx"), key.alias("key")), "row")
        most = -(-most // 2)
    heads = named.where("idx = 0")
    joined = heads.where(many).drop("name", "idx").join(current.select("row", "name"), "row")
    out = ["row", "id", "text_sha256", "n_bytes", "name"]
    return heads.where(~many).select(*out).unionByName(joined.select(*out))


def _cover(cut, block_bytes: int):
    """The blocks of a text: ``ceil(n / block)`` of them, one (empty) block for an empty text."""
    return F.when(F.col("n_bytes") <= block_bytes, F.array("bytes")).otherwise(cut)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``identities`` with keep_id, group_size and kept.

    Of rows with equal texts the one with the largest id stays. NULL ids are the smallest; of
    repeated rows with the same id one stays. An empty table gives an empty result; an empty or
    NULL text is a text like any other.
    """
    found = materialise(identities(docs, id_col, text_col, block_bytes), "identities")
    best = found.groupBy("n_bytes", "name").agg(
        F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    # Rows of large groups of copies are not gathered by their key on the way back.
    sized = best.withColumn("rows", F.col("group_size"))
    return join_groups(found, sized, ["n_bytes", "name"], "rows", found.count()).select(
        "row",
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns, whatever their names."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select("row")
    return keep_rows(docs, kept)
