"""Section-aware chunks of paged text: a chunk never spans two sections, and its id says where it stands."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import chunk_id, lines_of, section_heading

PREAMBLE, FURNITURE_PAGES, MAX_CHARS, OVERLAP = "(preamble)", 3, 2000, 200


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc, version_id, page_no, line_no, line) of pages (doc, version_id, page_no, text)."""
    return pages.select("doc", "version_id", "page_no", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def furniture(lines: DataFrame, group: tuple[str, ...] = ("doc", "version_id"), page: str = "page_no", least: int = FURNITURE_PAGES) -> DataFrame:
    """(group, line, pages): lines, trimmed, that stand on as many pages of a document: running heads, not headings."""
    distinct = lines.select(*group, page, stripped(F.col("line")).alias("line")).where("line <> ''").distinct()
    return distinct.groupBy(*group, "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def pushed(path: Column, heading: Column) -> Column:
    """The path after a heading: a named one starts anew; a number stays under the numbers it extends and under names."""
    depth = F.regexp_count(heading, F.lit(r"\."))
    above = F.filter(path, lambda p: ~p.rlike("^[0-9]") | ((F.regexp_count(p, F.lit(r"\.")) < depth) & heading.startswith(F.concat(p, F.lit(".")))))
    return F.when(~heading.rlike("^[0-9]") | (path == F.array(F.lit(PREAMBLE))), F.array(heading)).otherwise(F.concat(above, F.array(heading)))


def path_after(headings: Column) -> Column:
    """The path after all headings of an array, in order."""
    return F.aggregate(headings, F.array(F.lit(PREAMBLE)), pushed)


def headings(pages: DataFrame) -> DataFrame:
    """(doc, version_id, heads array<struct<page_no, line_no, heading>>) in reading order, for documents that have any.

    Only lines that open a section leave the scan; one that stands on FURNITURE_PAGES pages does not open any.
    """
    group = ["doc", "version_id"]
    found = page_lines(pages).withColumn("heading", section_heading(F.col("line"))).where("heading IS NOT NULL").withColumn("mark", stripped(F.col("line")))
    marks = furniture(found).select(*group, F.col("line").alias("mark"))
    found = found.join(marks, [*group, "mark"], "left_anti")
    return found.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "heading"))).alias("heads"))


def sections(pages: DataFrame) -> DataFrame:
    """(doc, version_id, section, section_path, page, occurrence, body) of sections with any text, in reading order.

    A line belongs to the section that it opens; a section's page is where it opened; occurrence
    counts earlier sections of the same path that have text. A page stays whole until it is cut where
    its headings stand, and its pieces meet where the page was sent to: texts are shuffled once, by document.
    """
    group = ["doc", "version_id"]
    none = F.array().cast("array<struct<page_no:int,line_no:int,heading:string>>")
    heads = headings(pages.withColumn("page_no", F.col("page_no").cast("int")))
    met = pages.select(*group, F.col("page_no").cast("int").alias("page_no"), lines_of(F.col("text")).alias("lines")).join(heads, group, "left").withColumn("heads", F.coalesce("heads", none))
    own = F.filter("heads", lambda h: h["page_no"] == F.col("page_no"))
    met = met.select(*group, "page_no", "lines", "heads", F.size(F.filter("heads", lambda h: h["page_no"] < F.col("page_no"))).alias("before"), F.concat(F.array(F.lit(0)), F.transform(own, lambda h: h["line_no"]), F.array(F.size("lines"))).alias("cuts"))
    # a piece from each cut to the next; the first goes on with the section that the page before ended in
    pieces = met.select(*group, "page_no", "lines", "heads", "cuts", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)).alias("k"), "before")
    begin, end = F.get("cuts", F.col("k")), F.get("cuts", F.col("k") + 1)
    pieces = pieces.where(end > begin).select(*group, "page_no", "heads", (F.col("before") + F.col("k")).alias("section"), F.array_join(F.slice("lines", begin + 1, end - begin), "\n").alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda s: s["text"]), "\n")
    text = pieces.groupBy(*group, "section").agg(F.first("heads").alias("heads"), stripped(body).alias("body")).where("body <> ''")
    opened = F.get("heads", F.col("section") - 1)["page_no"]
    path = path_after(F.transform(F.slice("heads", F.lit(1), F.col("section")), lambda h: h["heading"]))
    text = text.select(*group, "section", path.alias("section_path"), F.when(F.col("section") > 0, opened).otherwise(1).alias("page"), "body")
    again = W.partitionBy(*group, "section_path").orderBy("section")
    return text.select(*group, "section", "section_path", "page", (F.row_number().over(again) - 1).alias("occurrence"), "body")


def ends_of(text: str, mark: str) -> list[int]:
    """Where a mark ends, in order, marks that overlap included."""
    return [m.start() + len(mark) for m in re.finditer(f"(?={re.escape(mark)})", text)]


def parts_of(text: str, most: int, overlap: int) -> list[str]:
    """A text in parts of at most `most` characters: cut after a paragraph, else after a sentence past the middle, else anywhere.

    Each part but the first begins `overlap` characters, at most half a part, before the end of the last.
    """
    half, begin, spans = most // 2, 0, []
    # (ends in order, the least length of a part that ends at one)
    cuts = [(ends_of(text, "\n\n"), 3), (ends_of(text, ". "), max(1, half) + 2)] if len(text) > most else []
    while len(text) - begin > most:
        last = [(ends[bisect_right(ends, begin + most) - 1], least) for ends, least in cuts if ends]
        end = next((e for e, least in last if begin + least <= e <= begin + most), begin + most)
        spans.append((begin, end))
        begin = max(begin + 1, end - min(max(overlap, 0), half))
    return [text[i:j] for i, j in [*spans, (begin, len(text))]]


def chunks(pages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of pages: chunk_id, version_id, text, page, section_path, ordinal (in reading order, from 0)."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parts_of(t, max_chars, overlap))

    cut = sections(pages).select("*", F.posexplode(split("body")).alias("part", "text"))
    ordinal = F.row_number().over(W.partitionBy("doc", "version_id").orderBy("section", "part")) - 1
    ident = chunk_id(F.col("version_id"), F.col("section_path"), F.col("occurrence"), F.col("part"))
    return cut.select(ident.alias("chunk_id"), "version_id", "text", F.col("page").cast("int").alias("page"), "section_path", ordinal.alias("ordinal"))
