import re
from collections import Counter, defaultdict

import duckdb
import pytest

from citeloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long"


def brute(rows, top=200, least=3):
    """The contract as told, in plain integers."""
    docs = [((r[2] or ""), (r[3] or ""), Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", r[1] or ""))) for r in rows]
    having = Counter((lang, t) for lang, _, c in docs for t in c)
    kept = defaultdict(set)
    for (lang, t), n in having.items():
        if n >= least:
            kept[lang].add(t)
    groups, whole = defaultdict(Counter), defaultdict(Counter)
    for lang, source, c in docs:
        mine = Counter({t: n for t, n in c.items() if t in kept[lang]})
        groups[lang, source] += mine
        whole[lang] += mine
    def share(c, lang):
        total = sum(c.values()) + len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept[lang]}
    p = {g: share(c, g[0]) for g, c in groups.items()}
    q = {lang: share(c, lang) for lang, c in whole.items()}
    f = lambda a, b: (a - b) ** 2 // b
    out = set()
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(o, sum(f(mine[t], p[lang, o][t]) for t in mine)) for l2, o in groups if l2 == lang and o != source]
        terms = [(t, f(mine[t], q[lang][t])) for t in mine if groups[lang, source][t] and mine[t] > q[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found)}
    return out


@pytest.fixture(scope="module")
def rows():
    words = ["Haus", "haus", "x", "É", "été", "a_b", "dog", "cat's", "tree-top", "{z}", "日本", "wolf moon", "K"]
    out = []
    for i in range(240):
        picked = [words[(i * 7 + k * k) % len(words)] for k in range(i % 9)]
        out.append((i, " ".join(picked), ["en", "de", None, "xx"][i % 4], [f"s{i % 5}", None, ""][i % 3], "t", 1))
    out += [(i, "the " * 50 + f"w{i // 3}", "en", "hot", "t", 1) for i in range(1000, 1150)]  # letters end at the digit
    out += [(None, "Haus haus", "de", "s1", None, None)] * 3 + [(1, None, "de", "bare", None, None), (2, "", "only", "a", None, None), (3, "rare", "only", "b", None, None)]
    out.append((9, "lang " * 30_000 + "wort", "de", "s2", "t", 1))
    return out


def test_equals_plain_counts(spark, rows):
    out = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_many_groups_and_small_helds(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)  # groups are joined with split keys, not sent
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {tuple(r) for r in divergence.audit(df, top=3).collect()} == brute(rows, top=3)


def test_a_term_over_several_ranges_is_one_run(spark, rows):
    """Each document's partial run for itself, in more ranges than there are terms."""
    docs = spark.createDataFrame([("en", f"s{i % 2}", str(i), "one term") for i in range(400)] + [("en", "s0", "x", "two rare")], "lang string, source string, document string, text string").repartition(40)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.term: sorted(map(tuple, r.runs)) for r in divergence.kept_terms(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {"one": [("s0", 200), ("s1", 200)], "term": [("s0", 200), ("s1", 200)]}


def test_flushed_runs_add_up(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    docs = df.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "string(doc_id) document", "coalesce(text, '') text").coalesce(1)
    whole = {tuple(r) for r in divergence.partial_runs(docs).groupBy("lang", "source", "term").sum("docs", "n").collect()}
    small = divergence.partial_runs(docs, most=5)
    assert small.count() > divergence.partial_runs(docs).count()
    assert {tuple(r) for r in small.groupBy("lang", "source", "term").sum("docs", "n").collect()} == whole


def test_sql_and_no_rows(spark, rows):
    documents = spark.createDataFrame(rows, SCHEMA).toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    assert set(con.sql(divergence.SQL).fetchall()) == brute(rows)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    one = divergence.audit(spark.createDataFrame([(1, "a a a", "en", "s", None, None)], SCHEMA))
    assert one.count() == 0


def test_top_terms_are_cut_before_the_shuffle(spark, rows):
    plan = divergence.audit(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
