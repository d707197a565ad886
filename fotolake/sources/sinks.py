"""Delimited files and tables for results, and a file per row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.sources.files import plain_root

# Files that one task writes, about.
FILES_PER_TASK = 1_000

STAMP_COLUMNS = ("path", "camera_name", "camera_type", "dt_iso", "exposure", "ocr")


def _write_csv(df: DataFrame, out: str, sep: str = ",") -> None:
    # A quote within a quoted value is doubled, as spreadsheets expect.
    df.write.option("header", True).option("sep", sep).option("nullValue", "").option(
        "emptyValue", ""
    ).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(out)


def write_stamps_csv(stamps: DataFrame, out: str) -> None:
    _write_csv(stamps.select(*STAMP_COLUMNS), out)


def write_plan_csv(plan: DataFrame, out: str) -> None:
    """The dry run of a rename; one column per plan field."""
    _write_csv(plan, out)


def write_wide_pipe(wide: DataFrame, out: str) -> None:
    """``|``-separated text with a header; NULL is empty."""
    _write_csv(wide, out, sep="|")


def write_wide_table(wide: DataFrame, name: str = "photos") -> None:
    """A managed table. Characters Parquet does not allow in names become ``_``."""
    safe = [F.col(f"`{c}`").alias("".join("_" if x in " ,;{}()\n\t=" else x for x in c))
            for c in wide.columns]
    wide.select(*safe).write.saveAsTable(name)


def write_wide_parquet(wide: DataFrame, out: str) -> None:
    wide.write.parquet(out)


def write_line_files(lines: DataFrame, out: str, files_per_task: int = FILES_PER_TASK) -> None:
    """A file for each row of ``lines`` (value) in a new folder: the value and a line end.

    Spark's own writers commit file by file on the driver. Here tasks write the files, each
    straight to its place. They are numbered in the order of the values, so a task that is
    run again writes the same files once more.
    """
    out = plain_root(out)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = pyarrow.fs.LocalFileSystem(), out
        if "://" in out:
            system, folder = pyarrow.fs.FileSystem.from_uri(out)
        system.create_dir(folder, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for value in batch["value"]:
                with system.open_output_stream(f"{folder}/part-{part:06d}-{n:09d}.txt") as file:
                    file.write((value or b"") + b"\n")
                n += 1
        yield pd.DataFrame({"n": [n]})

    parts = max(1, -(-lines.count() // files_per_task))
    dealt = lines.select(F.col("value").cast("binary")).repartition(parts, "value")
    dealt = dealt.sortWithinPartitions("value")
    dealt.mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()
