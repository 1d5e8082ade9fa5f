"""Places of rows in the order of their group, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quernstone.llm.common import fresh, stored

#: Rows of a small side that is broadcast at most; each has a few dozen bytes.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast, if it has at most SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def numbered(df: DataFrame, group: str, order: list[str], place: str, total: str) -> DataFrame:
    """df, stored, with `place` (from 0, by `order`, nulls first) within `group` (not null) and `total`, the rows of the group.

    Rows are dealt by ranges of (group, order), so a large group lies in many tasks; each task numbers its own rows, and the
    rows that lie before it are added from a table with one row for each group and task. Rows that are equal in `order` are
    told apart by where they were read, so that they can be dealt to several tasks as well."""
    part, seq, mark, base = fresh(df, "_part", "_seq", "_mark", "_base")
    read = df.withColumn(mark, F.monotonically_increasing_id())
    keys = [group, *order, mark]
    dealt = read.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(mark)
    at, names = df.columns.index(group), [f"c{i}" for i in range(len(df.columns))]
    out = StructType([*dealt.toDF(*names).schema.fields, StructField("part", IntegerType()), StructField("seq", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(at)
            codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            seq = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
            if column[0].as_py() == last:
                seq[: first[1] if len(first) > 1 else len(seq)] += n
            last, n = column[len(codes) - 1].as_py(), int(seq[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), here, np.int32)), pa.array(seq, pa.int64())], out.names)

    rows = stored(dealt.toDF(*names).mapInArrow(number, out).toDF(*df.columns, part, seq), "numbered")
    each = rows.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(group, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base), F.sum("n").over(Window.partitionBy(group)).alias(total))
    joined = rows.join(small(offsets), [group, part])
    return joined.select(*df.columns, (F.col(base) + F.col(seq)).alias(place), total)
