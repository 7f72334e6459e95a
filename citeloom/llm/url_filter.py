"""URL filter: host and path rules, and for the rest a ratio of two character language models.

Two interpolated variable-order Markov models (Witten-Bell smoothing over the contexts seen) are
trained on rejected and on accepted URLs; a URL is blocked if its log-likelihood under the
accepted model less that under the rejected one, by character, is below a calibrated level.
Both are counted in Spark over every distinct shape of a URL: counts, probabilities and scores are
tables of their own that nothing collects. The level is calibrated on all shapes too, each scored
by models of the half that it is not in. `Markov` is the same model over a list of texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, levels, written

#: (verdict, host, path) of the registered query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Hosts with one of these words between separators are examples of rejected URLs.
REJECT_WORDS = ("adult", "bet", "bets", "casino", "escort", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")
ORDER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null; of equally long ones the last in code point order."""
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(none) for v, h, p in rules]
    return F.array_max(F.array(none, *fits))


def shape(host: str, path: str) -> str:
    """What the models read: host and path with digits made equal."""
    return re.sub("[0-9]", "0", (host or "") + (path or "").lower())


@dataclass
class Markov:
    """counts[context][character], for contexts of up to `order` characters."""

    order: int = ORDER
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def learn(self, texts: Iterable[str]) -> Markov:
        for text in texts:
            padded = "^" * self.order + text + "$"
            for i in range(self.order, len(padded)):
                for k in range(self.order + 1):
                    of = self.counts.setdefault(padded[i - k : i], {})
                    of[padded[i]] = of.get(padded[i], 0) + 1
        self.totals = {c: sum(of.values()) for c, of in self.counts.items()}
        return self

    def log_likelihood(self, text: str) -> float:
        padded, total, counts, totals = "^" * self.order + text + "$", 0.0, self.counts, self.totals
        for i in range(self.order, len(padded)):
            p, c = 1 / 256, padded[i]
            for k in range(self.order + 1):
                context = padded[i - k : i]
                of = counts.get(context)
                if of is None:
                    break
                n, kinds = totals[context], len(of)
                p = (of.get(c, 0) + kinds * p) / (n + kinds)
            total += math.log(p)
        return total


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    level: float = 0.0

    def __post_init__(self) -> None:
        self._cached = None

    def __getstate__(self):
        return self.__dict__ | {"_cached": None}

    def score(self, text: str) -> float:
        """Accepted less rejected log-likelihood by character, the end counted."""
        if self._cached is None:
            self._cached = lru_cache(50_000)(lambda t: (self.accepted.log_likelihood(t) - self.rejected.log_likelihood(t)) / (len(t) + 1))
        return self._cached(text)


def calibrate(accepted: list[float], rejected: list[float]) -> float:
    """Level with the least sum of the two error rates; in the middle of the gap around it."""
    if not accepted or not rejected:
        return 0.0
    accepted, rejected, every = sorted(accepted), sorted(rejected), sorted(set(accepted) | set(rejected))
    cuts = [every[0] - 1, *((a + b) / 2 for a, b in zip(every, every[1:])), every[-1] + 1]
    return min(cuts, key=lambda t: (bisect_left(accepted, t) / len(accepted) + 1 - bisect_left(rejected, t) / len(rejected), abs(t)))


def errors(accepted: list[float], rejected: list[float], level: float) -> tuple[float, float]:
    """Shares of accepted ones blocked and of rejected ones allowed at a level."""
    return sum(x < level for x in accepted) / max(1, len(accepted)), sum(x >= level for x in rejected) / max(1, len(rejected))


def train(accepted: Sequence[str], rejected: Sequence[str], order: int = ORDER) -> Ratio | None:
    """Models from all examples; the level from models of every other example, on the ones left out."""
    if not accepted or not rejected:
        return None
    half = Ratio(Markov(order).learn(accepted[::2]), Markov(order).learn(rejected[::2]))
    level = calibrate([half.score(t) for t in accepted[1::2]], [half.score(t) for t in rejected[1::2]])
    return Ratio(Markov(order).learn(accepted), Markov(order).learn(rejected), level)


def shapes(urls: DataFrame, url_col: str = "url", words: Sequence[str] = REJECT_WORDS) -> DataFrame:
    """(s, bad): the distinct shapes of URLs, and whether the host has a word of the list."""
    url = F.col(url_col).cast("string")
    bad = host_of(url).rlike(r"(^|[.\-])(" + "|".join(map(re.escape, words)) + r")([.\-]|$)")
    return urls.where(F.contains(url, F.lit("://"))).select(shape_of(host_of(url), path_of(url)).alias("s"), bad.alias("bad")).groupBy("s").agg(F.max("bad").alias("bad"))


def shape_of(host: Column, path: Column) -> Column:
    return F.regexp_replace(F.concat(host, F.lower(path)), "[0-9]", "0")


def _grams(s: DataFrame, order: int) -> DataFrame:
    """s with a row for each character and the end: gram is the character with the `order` before it."""
    padded = F.concat(F.lit("^" * order), F.col("s"), F.lit("$"))
    return s.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.substring(padded, i, order + 1))).alias("gram"))


#: Models counted together: accepted and rejected, each over all shapes, over a half of them and over the other half.
MODELS = {"a": (False, None), "r": (True, None), "ah": (False, True), "rh": (True, True), "ao": (False, False), "ro": (True, False)}


def gram_ratios(shaped: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio, half, other): log p_accepted - log p_rejected of each gram's last character, by models of all shapes, of the half and of the rest.

    shaped: (s, bad, half). From the shortest contexts to the longest, each table of grams takes
    the probability of the gram one character shorter.
    """
    one = [F.count_if((F.col("bad") == bad) & (F.lit(True) if half is None else F.col("half") == half)).alias(m) for m, (bad, half) in MODELS.items()]
    grams = written(_grams(shaped, order).groupBy("gram").agg(*one), "grams")
    last = None
    for k in range(order + 1):
        counts = grams.groupBy(F.substring(F.col("gram"), order + 1 - k, k + 1).alias("gram")).agg(*[F.sum(m).alias(m) for m in MODELS])
        counts = counts.withColumn("context", F.substring("gram", 1, k))
        totals = counts.groupBy("context").agg(*[F.sum(m).alias(f"n_{m}") for m in MODELS], *[F.count_if(F.col(m) > 0).alias(f"kinds_{m}") for m in MODELS])
        if last is None:
            counts, p = counts.crossJoin(F.broadcast(totals.drop("context"))), dict.fromkeys(MODELS, F.lit(1 / 256))  # one row
        else:
            before = last.select(F.col("gram").alias("shorter"), *[F.col(f"p_{m}").alias(f"q_{m}") for m in MODELS])
            counts = counts.withColumn("shorter", F.substring("gram", 2, k)).join(totals, "context").join(before, "shorter")
            p = {m: F.col(f"q_{m}") for m in MODELS}
        new = [F.when(F.col(f"n_{m}") > 0, (F.col(m) + F.col(f"kinds_{m}") * p[m]) / (F.col(f"n_{m}") + F.col(f"kinds_{m}"))).otherwise(p[m]).alias(f"p_{m}") for m in MODELS]
        last = written(counts.select("gram", *new), "probabilities")
    return last.select("gram", *[(F.log(f"p_a{m}") - F.log(f"p_r{m}")).alias(c) for m, c in (("", "ratio"), ("h", "half"), ("o", "other"))])


def _level(scored: DataFrame) -> float:
    """calibrate() of the rows' column held, of which those with good = 1 are accepted ones and the others rejected ones."""
    cuts, good, bad = levels(scored, "held", "good")
    if not good or not bad:
        return 0.0
    at = cuts.select(F.coalesce((F.col("last") + F.col("value")) / 2, F.col("value") - 1).alias("level"), (F.col("lost") / good + 1 - F.col("caught") / bad).alias("error"))
    above = cuts.agg((F.max("value") + 1).alias("level"), F.lit(1.0).alias("error"))
    return at.unionByName(above).orderBy("error", F.abs("level")).first()["level"]


def scores(urls: DataFrame, url_col: str = "url", words: Sequence[str] = REJECT_WORDS, order: int = ORDER, sample: int | None = None) -> tuple[DataFrame, float, tuple[float, float]] | None:
    """The scores (s, score) of all shapes under models of all of them, the level, and the held-out errors; None if a class has no shape.

    Shapes fall into halves by hash, and each has a second score by models of the half that it is
    not in. The level is calibrated on the second scores of all shapes, or of `sample` of each class
    where a caller wants that. The errors, see errors(), are those of either half at the level
    that the second scores of the other half give.
    """
    shaped = written(shapes(urls, url_col, words).withColumn("half", F.pmod(F.xxhash64("s"), F.lit(2)) == 0), "shapes")
    n = shaped.agg(F.count_if(~F.col("bad")).alias("a"), F.count_if("bad").alias("r")).first()
    if not n["a"] or not n["r"]:
        return None
    grams = _grams(shaped.withColumnRenamed("half", "even"), order).groupBy("s", "bad", "even", "gram").agg(F.count("*").alias("times"))
    by = grams.join(gram_ratios(shaped, order), "gram").groupBy("s", "bad", "even")
    mean = lambda c: F.sum(F.col("times") * c) / (F.length("s") + 1)
    unseen = F.when(F.col("even"), F.col("other")).otherwise(F.col("half"))
    scored = written(by.agg(mean(F.col("ratio")).alias("score"), mean(unseen).alias("held")).withColumn("good", (~F.col("bad")).cast("int")), "scores")
    held = scored
    if sample is not None:
        held = reduce(DataFrame.unionByName, [scored.where(F.col("bad") == b).orderBy(F.xxhash64("s", F.lit(1)), "s").limit(sample) for b in (False, True)])
    by_half = {even: _level(held.where(F.col("even") == even)) for even in (False, True)}
    low = F.col("held") < F.when(F.col("even"), by_half[False]).otherwise(by_half[True])
    wrong = held.agg(F.sum("good").alias("a"), F.count_if(low & ~F.col("bad")).alias("lost"), F.count_if("bad").alias("r"), F.count_if(~low & F.col("bad")).alias("missed")).first()
    return scored.select("s", "score"), _level(held), (wrong["lost"] / max(1, wrong["a"]), wrong["missed"] / max(1, wrong["r"]))


def unseen_hosts(urls: DataFrame, level: float, url_col: str = "url", words: Sequence[str] = REJECT_WORDS, order: int = ORDER, folds: int = 5) -> DataFrame:
    """(host, bad, n, wrong): of each host's shapes, how many are judged wrongly at a level by models that saw no shape of that host.

    Hosts, digits made equal, are dealt into folds by hash, and each fold is scored by models of the
    other folds; a class without hosts there has a uniform model. URLs without :// take no part.
    """
    shaped = written(shapes(urls, url_col, words).withColumn("host", F.substring_index("s", "/", 1)), "shapes")
    dealt, parts = shaped.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(folds))), []
    for fold in range(folds):
        ratios = gram_ratios(dealt.withColumn("half", F.col("fold") != fold), order)
        grams = _grams(dealt.where(F.col("fold") == fold), order).groupBy("s", "bad", "host", "gram").agg(F.count("*").alias("times"))
        by = grams.join(ratios, "gram").groupBy("s", "bad", "host").agg((F.sum(F.col("times") * F.col("half")) / (F.length("s") + 1)).alias("score"))
        parts.append(by.groupBy("host", "bad").agg(F.count("*").alias("n"), F.count_if((F.col("score") < level) != F.col("bad")).alias("wrong")))
    return reduce(DataFrame.unionByName, parts)


def judge(urls: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: Ratio | None = None, scored: tuple | None = None) -> DataFrame:
    """urls with host, path, rule, verdict and score added (columns of these names are replaced).

    The longest fitting rule decides; without one the model blocks scores below its level, and
    without a model all is allowed. The model is a Ratio, or what scores() gave for these URLs. A
    null url, or one without ://, has empty host and path, no rule, score 0, and is allowed. Every
    row is judged for itself, so repeated rows agree; an empty table gives no rows.
    """
    url, keep = F.col(url_col).cast("string"), columns(urls, "host", "path", "rule", "verdict", "score")
    best = fresh(urls, "best")

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([model.score(shape(h, p)) if model and (h or p) else 0.0 for h, p in zip(hosts, paths)], dtype="float64")

    df = urls.select(*keep, F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    known = (F.col("host") != "") | (F.col("path") != "")
    if scored:
        at, of = fresh(urls, "shape"), fresh(urls, "score")
        df = df.withColumn(at, F.when(known, shape_of(F.col("host"), F.col("path")))).join(scored[0].select(F.col("s").alias(at), F.col("score").alias(of)), at, "left")
        df, level = df.withColumn("score", F.coalesce(F.col(of), F.lit(0.0))), scored[1]
    else:
        df, level = df.withColumn("score", score("host", "path") if model else F.lit(0.0)), model.level if model else 0.0
    df = df.withColumn(best, best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.when(known & (F.col("score") < F.lit(level)), "block").otherwise("allow")
    return df.select(*keep, "host", "path", F.col(best)["rule"].alias("rule"), F.coalesce(F.col(best)["verdict"], verdict).alias("verdict"), "score")
