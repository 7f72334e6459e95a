"""A data source of paged text: `spark.read.format("paged")` gives a row a page, of files whose pages end with form feeds.

Files are read in tasks, page by page, through pyarrow's file systems, so that no file lies in
memory whole; a task takes a range of a file's pages. Decoders of other formats are ports: a
decoder tells how many pages a file has and gives a range of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SCHEMA = "doc string, page_no int, text string, checksum string"
#: Bytes read at once, and pages of a task.
BLOCK, PAGES = 1 << 20, 200
FEED = b"\f"


class Decoder(Protocol):
    """How a format's pages are read; `open_file` gives a new stream of the file's bytes."""

    def pages(self, open_file) -> int: ...

    def read(self, open_file, first: int, last: int) -> Iterator[str]: ...


class FeedDecoder:
    """Text, UTF-8, whose pages end with form feeds; the last may lack its own. What is no UTF-8 becomes replacement characters."""

    def pages(self, open_file) -> int:
        feeds, last = 0, FEED
        with open_file() as f:
            while block := f.read(BLOCK):
                feeds += block.count(FEED)
                last = block[-1:]
        return feeds + (last != FEED)

    def read(self, open_file, first: int, last: int) -> Iterator[str]:
        """Pages first to last - 1, counted from 0."""
        page, held = 0, []
        with open_file() as f:
            while page < last and (block := f.read(BLOCK)):
                *ends, rest = block.split(FEED)
                for end in ends:
                    if first <= page < last:
                        yield b"".join([*held, end]).decode("utf-8", "replace")
                    held, page = [], page + 1
                if first <= page < last:
                    held.append(rest)
        if held and first <= page < last and any(held):
            yield b"".join(held).decode("utf-8", "replace")


class PdfDecoder:
    """PDF through the optional `pypdf`; a file is opened, and the pages of the task alone are decoded."""

    def pages(self, open_file) -> int:
        from pypdf import PdfReader

        with open_file() as f:
            return len(PdfReader(f).pages)

    def read(self, open_file, first: int, last: int) -> Iterator[str]:
        from pypdf import PdfReader

        with open_file() as f:
            pages = PdfReader(f).pages
            for k in range(first, min(last, len(pages))):
                yield pages[k].extract_text() or ""


DECODERS: dict[str, type[Decoder]] = {"feed": FeedDecoder, "pdf": PdfDecoder}


def _opener(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return lambda: system.open_input_file(path)


class PageRange(InputPartition):
    def __init__(self, uri: str, first: int, last: int):
        self.uri, self.first, self.last = uri, first, last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        if not self.path:
            raise ValueError("a path is needed")
        name = options.get("decoder", "feed")
        if name not in DECODERS:
            raise ValueError(f"there is no decoder {name!r}")
        self.decoder, self.size, self.suffix = DECODERS[name](), int(options.get("pages", PAGES)), options.get("suffix", "")

    def partitions(self) -> list[PageRange]:
        """A file's pages are counted, and dealt out in ranges."""
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path)
        scheme = self.path.split("://", 1)[0] if "://" in self.path else "file"
        out = []
        for f in files:
            if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_")):
                uri = f"{scheme}://{f.path}"
                n = self.decoder.pages(_opener(uri))
                out += [PageRange(uri, k, min(k + self.size, n)) for k in range(0, n, self.size)]
        return out

    def read(self, partition: PageRange) -> Iterator[tuple]:
        opened = _opener(partition.uri)
        sha = hashlib.sha256()
        with opened() as f:
            while block := f.read(BLOCK):
                sha.update(block)
        doc = partition.uri.rsplit("/", 1)[-1]
        for k, text in enumerate(self.decoder.read(opened, partition.first, partition.last)):
            yield doc, partition.first + k + 1, text, sha.hexdigest()


class Paged(DataSource):
    """Options: `decoder` (feed or pdf), `pages` of a task, `suffix` of the files."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Paged)
