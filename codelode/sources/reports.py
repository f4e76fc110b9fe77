"""Report and fact sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_lines(report: DataFrame) -> DataFrame:
    """Each row as one flat JSON object, absent values included."""
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text files of JSON objects, one per row, in the order of the archives where rows name one; as many files as AQE sees fit."""
    if "archive_id" in report.columns:
        report = report.repartitionByRange("archive_id").sortWithinPartitions("archive_id")
    report_lines(report).write.mode(mode).text(path)


def write_facts(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite", directories: bool = False) -> None:
    """Fact tables as Parquet, clustered by archive and owner.

    Rows are range-partitioned, so a small archive lands in one file and a huge one is spread over many,
    and the number of files stays near the number of tasks.  Look-ups by archive or owner prune on the
    files' minima and maxima; ``directories`` adds one folder per archive, for corpora of few archives.
    """
    for name, table in tables.items():
        cluster = ["archive_id"] + [
            c for c in ("target_owner", "owner", "internal_name", "in_class", "path", "value") if c in table.columns
        ][:1]
        laid_out = table.repartitionByRange(*cluster).sortWithinPartitions(*cluster)
        writer = laid_out.write.mode(mode)
        if directories:
            writer = writer.partitionBy("archive_id")
        writer.parquet(f"{folder}/{name}")
