"""Long histories cut into runs of rows, each with the rows before it that its windows reach back to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_chunks(df: DataFrame, key: str, before: int, order: str = "date", size: int | None = None) -> DataFrame:
    """df with _row (number within the key, from 0), _chunk and _own.

    A chunk holds `size` rows of its own, and not as its own the `before` rows in front of them; group by (key, _chunk),
    use all rows and give back the own ones. So one key is as many tasks as it has chunks, and each needs memory for its
    chunk only. By default a chunk is four times as long as what it reaches back to, at least 4096 rows.
    """
    size = size or max(4096, 4 * before)
    numbered = df.withColumns({"_row": F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1, "_all": F.count("*").over(Window.partitionBy(key))})
    own, last = F.floor(F.col("_row") / size), F.floor((F.col("_all") - 1) / size)
    reach = F.least(F.floor((F.col("_row") + before) / size), last)
    return numbered.withColumn("_chunk", F.explode(F.sequence(own, reach))).withColumn("_own", F.col("_chunk") == own).drop("_all")
