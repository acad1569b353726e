"""Writers: files for people, and tables that are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that an export for people holds.
EXPORT_ROWS = 500


def export_csv(df: DataFrame, path: str, order: list[Column], limit: int = EXPORT_ROWS) -> None:
    """The first rows in order as one CSV file with a header; lists are joined by semicolons. order must be total."""
    flat = [F.array_join(F.transform(F.col(f"`{f.name}`"), lambda x: x.cast("string")), ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`") for f in df.schema]
    df.orderBy(*order).limit(limit).select(*flat).coalesce(1).write.mode("overwrite").csv(path, header=True)


def reload(df: DataFrame, path: str) -> None:
    """Replaces a table by df, which must not read from it."""
    df.write.mode("overwrite").parquet(path)
