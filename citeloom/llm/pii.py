"""Personal data: plain rules, and bootstrapped contexts that find identifiers the rules miss.

The rules' entities are seeds. Every token with a digit or an @, seed or not, is an instance, and
the words around it are its lexical patterns. Over the graph of patterns and instances Spark
scores in turns: a pattern of a kind by the share of its instances that are believed to be of
that kind, out of all its instances of any kind; an unseen instance by the best of its patterns
that have enough seeds. Instances above ACCEPT, of a shape their kind allows, are seeds of the
next round, and in the end become spans too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Written, columns, fresh, small_batches, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: A pattern speaks for a kind from so many different seeds on; scores take part from ACCEPT on.
MIN_SEEDS, ACCEPT, ROUNDS = 5, 0.75, 3
LONG = 64  # longer words and values are compared by a hash of the whole
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])+")
_SPACED = re.compile(r"\s")
_WORD = re.compile(r"\S+")
_TRIM = "()[]{}<>,.;:!?'\"`"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: a local part ends just before its @, so one look at each @ finds them."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the rules, in code points, by kind as in KINDS, then by start."""
    text = text or ""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def shapes(token: str) -> list[str]:
    """Kinds that a token which the rules did not take could be."""
    digits, letters = len(_digits(token)), any(c.isalpha() for c in token)
    fits = []
    if "@" in token.strip("@") and letters:
        fits.append("email")
    if (token.count(".") == 3 and not letters and digits >= 4) or (token.count(":") >= 3 and re.fullmatch(r"[0-9A-Fa-f:]+", token)):
        fits.append("ip")
    if not letters and 12 <= digits <= 19 and token.count(".") == 0:
        fits.append("card")
    if not letters and 7 <= digits <= 15:
        fits.append("phone")
    return fits


def _short(word: str) -> str:
    return word if len(word) <= LONG else f"#{xxhash.xxh64_hexdigest(word.encode())}"


def _candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or @, and numbers written with spaces, outside the sorted spans taken."""
    covered, at, upto = iter([*taken, (len(text) + 1,) * 2]), 0, 0
    block = next(covered)
    while m := _MARK.search(text, at):
        p = m.start()
        while block[1] <= p:
            upto = max(upto, block[1])
            block = next(covered)
        if block[0] <= p:
            at = upto = block[1]
            continue
        a = b = p
        while a > upto and not text[a - 1].isspace():
            a -= 1
        if run := _NUMBER.match(text, p - 1 if p > upto and text[p - 1] in "+(" else p):
            b = max(b, run.end())
        end = _SPACED.search(text, b)
        b = min(end.start() if end else len(text), block[0])
        upto = at = max(b, p + 1)
        while a < b and text[a] in _TRIM.replace("(", ""):
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        if a < b:
            yield a, b


def instances(text: str | None, base: list[tuple[str, int, int]]) -> Iterator[tuple[str | None, list[str], int, int, str, list[str]]]:
    """(seed kind or null, kinds it could be, start, end, value, patterns) of each seed and other token with a digit or @.

    Patterns are the word before, the two before, and the one before with the one after. Words
    end at white space and at other instances, so that a text is gone through in proportion to its length.
    """
    text = text or ""
    spots = [(kind, a, b) for kind, a, b in base] + [(None, a, b) for a, b in _candidates(text, sorted((a, b) for _, a, b in base))]
    if not spots:
        return
    cuts = sorted({x for _, a, b in spots for x in (a, b)})
    words: list[tuple[int, int]] = []
    k = 0
    for m in _WORD.finditer(text):
        a = m.start()
        while k < len(cuts) and cuts[k] <= a:
            k += 1
        while k < len(cuts) and cuts[k] < m.end():
            words.append((a, cuts[k]))
            a, k = cuts[k], k + 1
        words.append((a, m.end()))
    starts = [a for a, _ in words]

    def word(i: int) -> str:
        return _short(text[slice(*words[i])].lower().strip(_TRIM)) if 0 <= i < len(words) else ""

    for kind, a, b in spots:
        before, after = bisect_left(starts, a) - 1, bisect_left(starts, b)
        l1 = word(before)
        patterns = [f"{l1} _", f"{word(before - 1)} {l1} _", f"{l1} _ {word(after)}"]
        yield kind, [kind] if kind else shapes(text[a:b]), a, b, _short(text[a:b].lower()), patterns


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, h (a hash of the text), base (kind:start:end, comma-joined), and its instances."""
    small_batches(docs.sparkSession)
    item = pa.struct([("seed", pa.string()), ("fits", pa.list_(pa.string())), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, h bigint, base string, found array<struct<seed:string,fits:array<string>,start:bigint,stop:bigint,value:string,patterns:array<string>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            spans = [base_spans(t) for t in texts]
            found = [[dict(zip(("seed", "fits", "start", "stop", "value", "patterns"), x)) for x in instances(t, s)] for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([",".join(f"{k}:{a}:{z}" for k, a, z in s) for s in spans], pa.string()), pa.array(found, pa.list_(item))], ["doc_id", "h", "base", "found"])

    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, schema)


def discover(scanned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, h, kind, start, stop) of instances beyond the seeds that confident patterns vouch for.

    Patterns and instances are distinct values, so that repeated rows and hot values count once.
    """
    spots = written(scanned.select("doc_id", "h", F.explode("found").alias("x")).select("doc_id", "h", "x.*"), "spots")
    graph = Written(spots.select("value", "seed", "fits", F.explode("patterns").alias("pattern")).distinct(), "graph")
    edges = graph.df
    sizes = Written(edges.groupBy("pattern").agg(F.count_distinct("value").alias("n")), "sizes")
    seeds = edges.where("seed IS NOT NULL").select("pattern", F.col("seed").alias("kind"), "value").distinct()
    seeded = Written(seeds.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")), "patterns")
    unseen = Written(edges.where("seed IS NULL").select("pattern", "value", F.explode("fits").alias("kind")).distinct(), "unseen")
    last, scores = None, unseen.df.select("value", "kind", F.lit(0.0).alias("score")).limit(0)
    for _ in range(rounds):
        # accepted instances are seeds of the next round, others count by their score
        taken = F.count_if(F.col("score") >= accept)
        believed = unseen.df.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum(F.when(F.col("score") >= accept, 1.0).otherwise(F.col("score"))).alias("more"), taken.alias("taken"))
        known = seeded.df.join(believed, ["pattern", "kind"], "full").na.fill(0, ["seeds", "more", "taken"]).where(F.col("seeds") + F.col("taken") >= min_seeds)
        confidence = known.join(sizes.df, "pattern").select("pattern", "kind", ((F.col("seeds") + F.col("more")) / (F.col("n") + 1)).alias("confidence"))
        # an instance's best pattern decides; those that cannot speak for a kind say nothing
        now = Written(unseen.df.join(confidence, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max("confidence").alias("score")), "scores")
        if last:
            last.drop()
        last, scores = now, now.df
    for used in (graph, sizes, seeded, unseen):
        used.drop()
    best = scores.where(F.col("score") >= accept).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return spots.where("seed IS NULL").join(best, "value").select("doc_id", "h", "kind", "start", "stop").distinct()


def held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 5, **options) -> DataFrame:
    """(kind, n, found, other): how many identifiers contexts alone discover, of n different values hidden from the rules.

    Each `every`-th value of the rules, by hash, is made an instance of no known kind that could
    be of any; found are those discovered as their own kind, other those as another one.
    Values in all rows of all texts count once; kinds without hidden values have no row.
    """
    scanned = scan(docs, id_col, text_col)
    hides = lambda x: x["seed"].isNotNull() & (F.pmod(F.xxhash64(x["value"]), F.lit(every)) == 0)
    kinds = F.array(*map(F.lit, KINDS))
    as_unseen = F.transform("found", lambda x: F.when(hides(x), x.withField("seed", F.lit(None).cast("string")).withField("fits", kinds)).otherwise(x))
    scanned = written(scanned.select("doc_id", "h", as_unseen.alias("found"), F.filter("found", hides).alias("hidden")), "hidden")
    values = scanned.select("doc_id", "h", F.explode("hidden").alias("x")).select("doc_id", "h", "x.seed", "x.start", "x.stop", "x.value")
    got = discover(scanned, **options)
    met = values.alias("v").join(got.alias("g"), F.col("v.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("v.h") == F.col("g.h")) & (F.col("v.start") == F.col("g.start")) & (F.col("v.stop") == F.col("g.stop")), "left")
    one = met.groupBy(F.col("v.seed").alias("kind"), F.col("v.value").alias("value")).agg(F.max(F.coalesce(F.col("g.kind") == F.col("v.seed"), F.lit(False))).alias("right"), F.max(F.coalesce(F.col("g.kind") != F.col("v.seed"), F.lit(False))).alias("wrong"))
    return one.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("right").alias("found"), F.count_if("wrong").alias("other"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each input row: doc_id, base and spans (kind:start:end by kind, then start, comma-joined), and n_<kind> of the rules.

    Null and empty texts have no spans. Rows with equal id and text get equal spans; null ids
    work like others. An empty table gives no rows.
    """
    scanned = written(scan(docs, id_col, text_col), "scan")
    more = discover(scanned, **options).groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set(F.struct("kind", "start", "stop")).alias("more"))
    split = F.filter(F.split("base", ","), lambda s: s != "")
    base = F.transform(split, lambda s: F.struct(F.split(s, ":")[0].alias("kind"), F.split(s, ":")[1].cast("long").alias("start"), F.split(s, ":")[2].cast("long").alias("stop")))
    both = F.concat(base, F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>")))
    order = F.array_sort(F.transform(both, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["stop"].alias("stop"))))
    text = F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"].cast("int")), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    joined = scanned.drop("found").join(more, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left")
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return joined.select("doc_id", *counts, F.col("base"), F.when(F.col("more").isNull(), F.col("base")).otherwise(text).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with each span, or run of overlapping spans, of the text replaced by its kind, as in [EMAIL]. Null texts stay null."""
    small_batches(docs.sparkSession)
    more = discover(written(scan(docs, id_col, text_col), "scan"), **options)
    i, h, extra = (fresh(docs, x) for x in ("id", "h", "extra"))
    more = written(more.groupBy(F.col("doc_id").alias(i), F.col("h").alias(h)).agg(F.array_join(F.collect_set(F.concat_ws(":", "kind", "start", "stop")), ",").alias(extra)), "more")
    few = more.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = docs.join(F.broadcast(more) if few else more, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_of(text_col)) == F.col(h)), "left").select(*columns(docs), extra)

    @F.pandas_udf("string")
    def replaced(texts, extras):
        import pandas as pd

        return pd.Series([None if t is None else hide(t, x) for t, x in zip(texts, extras)], dtype=object)

    return joined.withColumn(text_col, replaced(F.col(text_col), F.col(extra))).drop(extra)


def hide(text: str, extra: str | None = None) -> str:
    found = base_spans(text)
    if extra:
        found += [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in extra.split(","))]
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in found):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]
