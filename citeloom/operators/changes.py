"""Changes between editions, and what they touch of ours, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import change_id, content_key, path_text
from ..schema import conform
from .obligations import primary_anchor

KINDS = ("ADDED", "REMOVED", "MODIFIED")
# Weights of a change's kind and of an obligation's modality.
KIND_WEIGHT = {"REMOVED": 3.0, "MODIFIED": 2.0, "ADDED": 1.0}
MODALITY_WEIGHT = {"SHALL": 4.0, "MUST": 4.0, "SHOULD": 2.0, "MAY": 1.0}


def weight(of: Column, table: dict[str, float]) -> Column:
    """The table's weight, 1 for what it does not hold."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), of), F.lit(1.0))


def diff(obligations: DataFrame, before: str, after: str) -> DataFrame:
    """Changes from one edition to another.

    Clauses of equal section and wording are unchanged. Of the rest, a section with just one
    clause on each side gives one MODIFIED; other sections give REMOVED and ADDED, with a
    summary that says so if there is more than one clause. REMOVED touches the old obligation,
    the others the new.

    One aggregate by content tells what is on one side alone; a small one by section, joined back,
    tells what stands beside it.
    """
    sides = obligations.where(F.col("version_id").isin(before, after)).withColumn("is_new", F.col("version_id") == after)
    clause = F.struct("obligation_id", "section_path", "statement", "modality")
    keyed = sides.groupBy(content_key(F.col("section_path"), F.col("statement")).alias("key")).agg(F.min(clause).alias("c"), F.max("is_new").alias("is_new"), F.min("is_new").alias("every"))
    lone = keyed.where(F.col("is_new") == F.col("every")).select("c.*", "is_new")
    crowd = lone.groupBy("section_path").agg(F.count_if(~F.col("is_new")).alias("n_old"), F.count_if("is_new").alias("n_new"), F.min(F.when(~F.col("is_new"), F.col("statement"))).alias("earlier"))
    pair = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    kind = F.when(pair, "MODIFIED").when(F.col("is_new"), "ADDED").otherwise("REMOVED")
    told = {"MODIFIED": "the clause was reworded.", "ADDED": "a clause was added.", "REMOVED": "a clause was removed."}
    words = F.try_element_at(F.create_map(*[F.lit(x) for p in told.items() for x in p]), F.col("kind"))
    crowded = F.when(~pair & (F.col("n_old") + F.col("n_new") > 1), " More than one changed here, so no pair was made.").otherwise("")
    every = lone.join(crowd, "section_path").where(~pair | F.col("is_new")).withColumn("kind", kind)
    ident = change_id(F.lit(before), F.lit(after), F.col("kind"), F.col("obligation_id"))
    summary = F.concat(F.lit("Section "), path_text(F.col("section_path")), F.lit(": "), words, crowded)
    return conform(every.withColumns({"previous_statement": F.when(pair, F.col("earlier")), "summary": summary, "change_id": ident, "from_version_id": F.lit(before), "to_version_id": F.lit(after)}), "change")


def counts(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Changes of each kind, kinds that do not occur included."""
    return changes.groupBy(*(by or [])).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def triage(changes: DataFrame, links: DataFrame, obligations: DataFrame, anchors: DataFrame, chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Our clauses that implement a changed one, with score, document and citation; highest score first.

    Only approved links count. An obligation cited in two chunks gives one row.
    """
    hit = changes.select("change_id", "kind", F.col("statement").alias("change"), F.col("obligation_id").alias("target_id"), F.col("modality").alias("changed_modality"))
    ours = hit.join(links, "target_id").withColumnRenamed("source_id", "obligation_id")
    ours = ours.join(obligations.select("obligation_id", "version_id", F.col("statement").alias("our_statement")), "obligation_id")
    ours = ours.join(primary_anchor(anchors, chunks), "obligation_id").join(versions.select("version_id", "slug"), "version_id").join(documents.select("slug", F.col("name").alias("document")), "slug")
    score = weight(F.col("kind"), KIND_WEIGHT) * weight(F.col("changed_modality"), MODALITY_WEIGHT)
    rows = ours.select(score.alias("score"), "document", F.col("obligation_id").alias("our_obligation_id"), "our_statement", "section_path", "page", F.col("text").alias("quote"), "change_id", "kind", "change")
    return rows.orderBy(F.desc("score"), "document", "our_obligation_id", "change_id")


def unlinked(changes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: total changes, those that touch a linked obligation, and the rest."""
    known = links.select(F.col("target_id").alias("obligation_id")).distinct().withColumn("linked", F.lit(True))
    got = changes.join(known, "obligation_id", "left").agg(F.count_distinct("change_id").alias("total"), F.count_distinct(F.when(F.col("linked"), F.col("change_id"))).alias("linked_changes"))
    return got.withColumn("unlinked_changes", F.col("total") - F.col("linked_changes"))


def summary(rows: DataFrame) -> DataFrame:
    """Triage rows with a line for each: its score with one decimal, the kind of change and the document."""
    return rows.withColumn("line", F.concat_ws(" ", F.format_string("%.1f", "score"), "kind", "document"))
