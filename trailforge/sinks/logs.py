"""Ordered text output on the driver, and tables for what is too large for that."""

from __future__ import annotations

import os
import sys
from typing import TextIO

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .render import rendered


#: Fixed value: the highest number that moves up where there is no limit.
OLDEST = 999


class RotatingLog:
    """Appends texts to a file; after a text that fills it, the file becomes path.1 and older ones move up.

    With max_files above 0, the oldest of that many goes; otherwise all stay. With max_kb 0 the file grows without end.
    The folder must exist.
    """

    def __init__(self, path: str, max_kb: int = 1024, max_files: int = 5):
        self.path, self.limit, self.keep = path, max_kb * 1024, max_files
        self._open()

    def _open(self) -> None:
        try:
            self.file = open(self.path, "ab")  # noqa: SIM115
        except OSError as e:
            raise OSError(f"cannot open '{self.path}'") from e

    def write(self, text: str) -> None:
        self.file.write(text.encode() + b"\n")
        self.file.flush()
        if self.limit and os.path.getsize(self.path) >= self.limit:
            self.file.close()
            self._shift()
            self._open()

    def _shift(self) -> None:
        """Every older file moves up, over gaps too; with a limit, what would move beyond it goes."""
        last = f"{self.path}.{self.keep}"
        if self.keep > 0 and os.path.exists(last):
            os.remove(last)
        for k in range(self.keep - 1 if self.keep > 0 else OLDEST, 0, -1):
            if os.path.exists(older := f"{self.path}.{k}"):
                os.replace(older, f"{self.path}.{k + 1}")
        os.replace(self.path, f"{self.path}.1")

    def close(self) -> None:
        self.file.close()


def _texts(processed: DataFrame):
    """Texts in order, fetched a partition at a time. They are kept meanwhile, as sorting looks at them twice."""
    texts = rendered(processed).persist(StorageLevel.DISK_ONLY)
    try:
        for row in texts.orderBy("track_id", "file_idx", "rec_idx").toLocalIterator(prefetchPartitions=True):
            yield row.text
    finally:
        texts.unpersist()


def to_console(processed: DataFrame, stream: TextIO | None = None) -> None:
    for text in _texts(processed):
        print(text, file=stream or sys.stdout)


def to_rotating_log(processed: DataFrame, log: RotatingLog) -> None:
    try:
        for text in _texts(processed):
            log.write(text)
    finally:
        log.close()


def to_text(processed: DataFrame, path: str) -> None:
    """Texts as files of a folder, ordered across files; written by the executors."""
    rendered(processed).orderBy("track_id", "file_idx", "rec_idx").select("text").write.text(path)


def to_table(processed: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Processed records as Parquet."""
    writer = processed.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
