"""Obligations: ports that extract them from chunks, a cache around a port, anchors, and scores of a port."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import cache_key, normalized, obligation_id
from ..schema import MODALITIES, checked_confidence, checked_modality, conform

FOUND = "statement string, modality string, actor string, deadline string, conditions string, confidence double"
PAYLOAD = f"array<struct<{FOUND.replace(' string', ':string').replace(' double', ':double')}>>"
FIELDS = ("statement", "modality", "actor", "deadline", "conditions", "confidence")
#: What a model is asked; a change of the wording is a new version, and so a new key of the cache.
PROMPT_VERSION = "2"
PROMPT = (
    "List every duty that the passage below lays down. Answer with one JSON object that has a list `obligations`, empty if there is none. Each item has `statement`, the clause in the passage's own words; "
    "`modality`, one of SHALL, MUST, SHOULD, MAY; `actor`, `deadline` and `conditions`, each a text or null; and `confidence`, a number from 0 to 1. Add nothing that the passage does not say."
)


class MissingAnchorError(ValueError):
    """An obligation is anchored in no chunk of its own edition."""


class Extractor(Protocol):
    """A port: what a chunk obliges whom to do. adapter_id is part of the cache's key."""

    adapter_id: str

    def extract(self, text: str, section_path: list[str]) -> list[dict]: ...


class NullExtractor:
    """The default: finds nothing."""

    adapter_id = "null"

    def extract(self, text: str, section_path: list[str]) -> list[dict]:
        return []


class ModalExtractor:
    """Sentences with a modal verb of obligation, their actor being what precedes it. Opt-in: precise enough for tests only."""

    adapter_id = "modal-1"
    _sentence = re.compile(r"[^.!?]+[.!?]?")
    _modal = re.compile(r"\b(shall|must|should|may)\b", re.I)

    def extract(self, text: str, section_path: list[str]) -> list[dict]:
        out = []
        for m in self._sentence.finditer(text):
            statement = " ".join(m[0].split())
            if found := self._modal.search(statement):
                out.append({"statement": statement, "modality": found[1].upper(), "actor": statement[: found.start()].strip() or None, "deadline": None, "conditions": None, "confidence": 0.5})
        return out


class InvalidAnswerError(ValueError):
    """A model's answer that is no list of obligations."""


def validated(answer: object) -> list[dict]:
    """A model's answer, field by field, or an error that says what is wrong with it; nothing is coerced or left out."""
    if not isinstance(answer, list):
        raise InvalidAnswerError("no list of obligations")
    out = []
    for i, o in enumerate(answer):
        if not isinstance(o, dict):
            raise InvalidAnswerError(f"item {i} is no object")
        if unknown := set(o) - set(FIELDS):
            raise InvalidAnswerError(f"item {i} has unknown fields: {', '.join(sorted(map(str, unknown)))}")
        if not isinstance(o.get("statement"), str) or not o["statement"].strip():
            raise InvalidAnswerError(f"item {i} has no statement")
        if o.get("modality") not in MODALITIES:
            raise InvalidAnswerError(f"item {i} has the modality {o.get('modality')!r}")
        c = o.get("confidence")
        if isinstance(c, bool) or not isinstance(c, (int, float)) or not 0 <= c <= 1:
            raise InvalidAnswerError(f"item {i} has the confidence {c!r}")
        if wrong := [f for f in ("actor", "deadline", "conditions") if o.get(f) is not None and not isinstance(o[f], str)]:
            raise InvalidAnswerError(f"item {i}: {wrong[0]} is no text")
        out.append({f: o.get(f) for f in FIELDS} | {"confidence": float(c)})
    return out


class HttpExtractor:
    """A model behind HTTP in JSON mode at temperature 0; never used unless asked for.

    An answer that is late, broken or invalid is asked for again, `tries` times in all with growing
    pauses; then it raises. Which prompt was used is part of the cache's key, see extract().
    """

    def __init__(self, url: str, model: str, prompt: str = PROMPT, timeout: float = 120.0, tries: int = 3, pause: float = 1.0):
        self.url, self.model, self.prompt, self.timeout, self.tries, self.pause, self.adapter_id = url, model, prompt, timeout, tries, pause, f"http-{model}"

    def _ask(self, text: str, section_path: list[str]) -> list[dict]:
        body = {"model": self.model, "prompt": f"{self.prompt}\nSection: {'/'.join(section_path)}\n\n{text}", "format": "json", "stream": False, "options": {"temperature": 0}}
        with urlopen(Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
            said = json.loads(json.loads(answer.read())["response"])
        if not isinstance(said, dict) or "obligations" not in said:
            raise InvalidAnswerError("no field `obligations`")
        return validated(said["obligations"])

    def extract(self, text: str, section_path: list[str]) -> list[dict]:
        for k in range(self.tries):
            try:
                return self._ask(text, section_path)
            except (OSError, ValueError, KeyError, TypeError) as e:  # no or a late answer; no JSON or an invalid one
                if k + 1 == self.tries:
                    raise InvalidAnswerError(f"{type(e).__name__}: {e}") from e
                time.sleep(self.pause * 2**k)
        raise InvalidAnswerError("not asked")


def register(spark: SparkSession, extractor: Extractor, name: str = "obligations_of") -> None:
    """Makes the port a table function of SQL: `FROM chunk, LATERAL obligations_of(text, section_path)`.

    Rows are obligations; an answer that cannot be had or is invalid is one row with its error, so
    that one bad chunk does not end the query.
    """

    @udtf(returnType=f"{FOUND}, error string")
    class Obligations:
        def eval(self, text: str, section_path: list[str]):
            if text is None:
                return
            try:
                found = validated(extractor.extract(text, list(section_path or [])))
            except Exception as e:
                yield None, None, None, None, None, None, f"{type(e).__name__}: {e}"
                return
            for o in found:
                yield (*(o[f] for f in FIELDS), None)

    spark.udtf.register(name, Obligations)


def _run(chunks: DataFrame, extractor: Extractor, workers: int | None = None) -> DataFrame:
    """(key, payload_json) for chunks with a key; an empty list is an answer too. At most `workers` chunks are asked for at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "payload_json": [json.dumps(validated(extractor.extract(t, list(p)))) for t, p in zip(b["text"], b["section_path"])]})

    todo = chunks.select("key", "text", "section_path").dropDuplicates(["key"])
    return (todo if workers is None else todo.repartition(workers, "key")).mapInPandas(run, "key string, payload_json string")


def with_key(chunks: DataFrame, extractor: Extractor, prompt_version: str = PROMPT_VERSION) -> DataFrame:
    """chunks with the cache's key: the adapter, the prompt and what is asked about."""
    return chunks.withColumn("key", cache_key(F.lit(extractor.adapter_id), F.lit(prompt_version), F.col("section_path"), F.col("text")))


def missing(chunks: DataFrame, extractor: Extractor, cache: DataFrame, workers: int | None = None) -> DataFrame:
    """(key, payload_json) of the chunks that the cache does not have."""
    return _run(with_key(chunks, extractor).join(cache, "key", "left_anti"), extractor, workers)


def extract(chunks: DataFrame, extractor: Extractor, cache: DataFrame, prompt_version: str = PROMPT_VERSION, keep: Callable[[DataFrame], DataFrame] = lambda df: df.persist(), workers: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Obligations, their anchors, and the cache with what it lacked. Only chunks the cache does not have are extracted.

    A modality outside the closed set, or a confidence outside 0..1, raises. The same clause in
    two chunks of an edition is one obligation with two anchors.
    """
    keyed = with_key(chunks, extractor, prompt_version)
    new = keep(_run(keyed.join(cache, "key", "left_anti"), extractor, workers))
    full = cache.unionByName(new)
    rows = keyed.join(full, "key").select("chunk_id", "version_id", "section_path", "ordinal", F.explode(F.from_json("payload_json", PAYLOAD)).alias("o")).select("*", "o.*").drop("o")
    rows = rows.withColumn("obligation_id", obligation_id(F.col("version_id"), F.col("section_path"), F.col("statement")))
    rows = rows.withColumns({"modality": checked_modality(F.col("modality")), "confidence": checked_confidence(F.col("confidence"))})
    first = F.min_by(F.struct("version_id", "statement", "modality", "actor", "deadline", "conditions", "confidence", "section_path"), F.struct("ordinal", "statement"))
    found = rows.groupBy("obligation_id").agg(first.alias("o")).select("obligation_id", "o.*")
    return conform(found, "obligation"), rows.select("obligation_id", "chunk_id").distinct(), full


def checked_anchors(obligations: DataFrame, anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The anchors within the obligation's own edition; an obligation left without one raises."""
    own = anchors.join(obligations.select("obligation_id", "version_id"), "obligation_id").join(chunks.select("chunk_id", "version_id"), ["chunk_id", "version_id"]).select("obligation_id", "chunk_id")
    lost = obligations.join(own, "obligation_id", "left_anti").select("obligation_id").limit(3).collect()
    if lost:
        raise MissingAnchorError(", ".join(r.obligation_id for r in lost))
    return own


def primary_anchor(anchors: DataFrame, chunks: DataFrame, key: str = "obligation_id") -> DataFrame:
    """The earliest chunk of each obligation: (obligation_id, chunk_id, page, section_path, text); those without one drop out.

    An aggregate rather than a window: an obligation anchored in many chunks is never gathered.
    """
    joined = anchors.join(chunks, "chunk_id")
    return joined.groupBy(key).agg(F.min_by(F.struct("chunk_id", "page", "section_path", "text"), F.struct("ordinal", "chunk_id")).alias("c")).select(key, "c.*")


def score(gold: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and precision, recall and modality accuracy of predicted (statement, modality) against gold; 1 where there is nothing to divide by.

    Statements are compared normalised. Each prediction counts for precision; for recall each gold clause counts once.
    """
    by = by or []
    g = gold.select(*by, normalized(F.col("statement")).alias("s"), F.col("modality").alias("gold_modality")).dropDuplicates([*by, "s"])
    p = predicted.select(*by, normalized(F.col("statement")).alias("s"), "modality")
    hits = p.join(g, [*by, "s"], "left").groupBy(*by).agg(F.count("*").alias("predicted"), F.count("gold_modality").alias("hits"), F.count_if(F.col("modality") == F.col("gold_modality")).alias("same"))
    reached = g.join(p, [*by, "s"], "left_semi").groupBy(*by).agg(F.count("*").alias("matched"))
    base = g.groupBy(*by).agg(F.count("*").alias("gold"))
    if by:
        joined = base.join(hits, by, "full_outer").join(reached, by, "left").na.fill(0)
    else:
        one = lambda df: df.withColumn("__one", F.lit(1))
        joined = one(base).join(one(hits), "__one").join(one(reached), "__one").drop("__one")
    return rates(joined, by)


def rates(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    ratio = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.try_divide(F.col(b), F.lit(1)))
    return counts.select(*(by or []), "gold", "predicted", "matched", "hits", "same", ratio("hits", "predicted").alias("precision"), ratio("matched", "gold").alias("recall"), ratio("same", "hits").alias("modality_accuracy"))


def micro_average(scores: DataFrame) -> DataFrame:
    """Rates of the pooled counts, in one row."""
    return rates(scores.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "predicted", "matched", "hits", "same")]))


GOLD = "passage string, obligations array<struct<statement:string,modality:string>>"


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(passage, statement, modality) of JSON fixtures, one object or a list of them a file; a passage without clauses has no rows."""
    read = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(GOLD).json(path)
    return read.select("passage", F.inline("obligations")).withColumn("modality", checked_modality(F.col("modality")))
