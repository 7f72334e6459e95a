"""Numbered pointer files: the newest one is what is current, and creating a number that is taken fails."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

_END = "\nend\n"


class Pointers:
    """A folder of JSON files with rising numbers, read and written through Spark's file systems.

    The file system's exclusive creation decides between two writers of one number. A file ends
    with a mark, so that one whose writer died is passed over; its number stays taken.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def numbers(self) -> list[int]:
        fs, path = self.fs(self.folder)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, number: int) -> dict | None:
        """What a file holds; None if its writer died before its end."""
        fs, path = self.fs(f"{self.folder}/{number:012d}")
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text.removesuffix(_END)) if text.endswith(_END) else None

    def latest(self) -> tuple[int, dict | None]:
        """The highest number taken, and what the last whole file holds."""
        numbers = self.numbers()
        for n in reversed(numbers):
            if (found := self.read(n)) is not None:
                return numbers[-1], found
        return (numbers or [0])[-1], None

    def create(self, number: int, value: dict) -> bool:
        """Whether the number was free; then its file holds the value."""
        fs, path = self.fs(f"{self.folder}/{number:012d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "exists" in str(e):
                return False
            raise
        out.write((json.dumps(value) + _END).encode())
        out.close()
        return True

    def remove(self, number: int) -> None:
        fs, path = self.fs(f"{self.folder}/{number:012d}")
        fs.delete(path, False)
