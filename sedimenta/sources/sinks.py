"""Writers for reports, context documents and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import written


def write_lines(lines: DataFrame, path: str, document: list[str], order: list[str], column: str = "line") -> None:
    """One folder per document; only the documents that ``lines`` holds are overwritten.

    Rows are range-partitioned by document and position: small documents share a task, a very long one is split
    over several part files whose names are in document order. They are written once before, as the ranges are sampled.
    """
    lines = written(lines.select(*document, *order, F.col(column).alias("value")), "lines")
    (
        lines.repartitionByRange(*document, *order).sortWithinPartitions(*document, *order)
        .select(*document, "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*document).text(path)
    )


def write_reports(lines: DataFrame, path: str) -> None:
    write_lines(lines, path, ["project", "report"], ["block", "line_key"])


def write_context(rows: DataFrame, path: str) -> None:
    write_lines(rows, path, ["project", "target"], ["section_ord", "line_key"], "text")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by_project: bool = False) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy("project") if by_project else writer).save(path)
