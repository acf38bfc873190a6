"""Plumbing that the operators share: Arrow column builders, groups of bounded size, names that meet no column's.

Nothing here keeps data on the driver; tables that several jobs read are written with ``stash`` to the folder
that the cluster names in ``spark.checkpoint.dir`` and read back, which also cuts lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.shared import apart, components, shared_folder, stash

__all__ = ["append_columns", "apart", "components", "dealt_in_cells", "local_components", "per_group", "quoted", "shared_folder", "slices", "stash", "text_or_empty", "unused"]


def quoted(column: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has (Spark tells names apart without their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def append_columns(
    df: DataFrame,
    inputs: Sequence[str | Column],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Append Arrow-computed columns in one pass over the partitions.

    ``make()`` runs once in each task and returns a function from the input arrays of a batch to one array
    per field. Columns of ``df`` that carry an output's name are replaced; those in ``drop`` go.
    """
    gone = {x.lower() for x in (*(f.name for f in fields), *drop)}
    keep = [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]
    given = [F.col(quoted(c)) if isinstance(c, str) else c for c in inputs]
    # columns are taken by place: on the way their names meet nobody's, whatever characters they have
    sent = df.select(*[c.alias(f"c{i}") for i, c in enumerate([*keep, *given])])
    schema = T.StructType([*df.select(*keep).schema.fields, *fields])
    n, names = len(keep), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch):
                made = compute(*part.columns[n:])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=names)

    return sent.mapInArrow(run, schema)


#: Bytes of a slice of a batch, about; a longer row is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded size, so that what a task makes of it stays small too."""
    rows = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def text_or_empty(column: str) -> Column:
    """The text column as a string; null counts as the empty text."""
    return F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))


def per_group(df: DataFrame, key: str, columns: Sequence[str], schema: str, fn: Callable[..., Sequence | None], out_rows: int = 8192) -> DataFrame:
    """Run ``fn`` on the rows of each value of ``key`` (an integer column), the arrays of ``columns`` given as its arguments.

    The rows are dealt out and sorted by the key, and groups are cut from the stream of batches, so that a
    small group costs little more than the call. Groups must have a size bound; callers see to that by
    making the block a part of the key. ``fn`` returns one sequence for each column of ``schema``, or None.
    """
    out_schema = T._parse_datatype_string(schema)
    sent = df.select(key, *columns).repartition(key).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        ready: list[list] = [[] for _ in out_schema.fields]
        carried: list[pa.RecordBatch] = []

        def process(parts: list[pa.RecordBatch]) -> None:
            whole = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            made = fn(*whole.columns[1:])
            if made is not None:
                for column, values in zip(ready, made, strict=True):
                    column.extend(values)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(ready, arrow, strict=True)], schema=arrow)
            for c in ready:
                c.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if carried and carried[0].column(0)[0].as_py() != part.column(0)[0].as_py():
                    process(carried)
                    carried = []
                carried.append(part)
                if len(ready[0]) >= out_rows:
                    yield flush()
        if carried:
            process(carried)
        if ready[0]:
            yield flush()

    return sent.mapInArrow(run, out_schema)


def dealt_in_cells(members: DataFrame, group: str, member: str, blocks: str) -> DataFrame:
    """Deal each group's members into ``blocks`` blocks, and pairs of blocks into cells.

    Adds ``cell`` (a long), ``side`` (the member's block) and ``crossed`` (the cell joins two different
    blocks: only pairs of members of unlike sides belong to it). Every pair of members of a group meets in
    exactly one cell as a counted pair, and a cell has the members of two blocks at most.
    """
    side = F.expr(f"pmod(xxhash64({member}), {blocks})")
    dealt = members.withColumn("side", side).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    low, high = F.least("side", "__other"), F.greatest("side", "__other")
    return dealt.withColumn("cell", F.xxhash64(group, low, high)).withColumn("crossed", F.col("side") != F.col("__other")).drop("__other")


def local_components(adjacent: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each node of a small symmetric boolean matrix."""
    n = len(adjacent)
    label = np.arange(n)
    reach = adjacent | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new
