"""How rows lie in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes (by Spark's own estimate) that a core should have at least before rows are left where they are.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input, dealt to all cores. A Parquet file of one row group is one task, which hurts where each row costs much; of
    larger inputs there are row groups enough, and they stay as they are, so nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
