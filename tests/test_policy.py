"""Editions, chunks, obligations, links, changes, search and the store on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citeloom import schema
from citeloom.functions import text as X
from citeloom.operators import changes, chunking, embedding, links, obligations, search, versions
from citeloom.plans import ingest, rebuild, sql, store
from citeloom.sources import issuance


def test_identities(spark):
    row = spark.range(1).select(X.decision_key(F.lit("a"), F.lit("b")).alias("d"), X.obligation_id(F.lit("v1"), F.array(F.lit("3"), F.lit("3.2")), F.lit("The Director  shall\nnotify the Comptroller.")).alias("o")).first()
    assert row.d == "0eab8a0a3380abf4c7d1fb0b43b66aaf" and row.o == "c2f8a3fd4cf427ea074f1dc0013d7f93"
    words = spark.range(1).select(X.content_words(F.lit("The Heads must OBEY the well-known rule, non-DoDI 5000.88")).alias("w"), X.designators(F.lit("See DoDI  5000.88 and DoDD 5000.01, DoDM 1")).alias("d")).first()
    assert sorted(words.w) == ["heads", "non-dodi", "obey", "rule", "well-known"] and words.d == ["DoDI 5000.88", "DoDD 5000.01", "DoDM 1"]


def test_editions(spark):
    rows = [("a", "a2", "2021-01-01", 1), ("a", "a1", "2020-01-01", 2), ("b", "b1", None, 5), ("b", "b2", "1999-01-01", 1), ("a", "a0", None, 9)]
    v = spark.createDataFrame(rows, "slug string, version_id string, effective_date string, ingested_at int").withColumn("checksum", F.lit("c"))
    assert {r.version_id: r.supersedes for r in versions.chain(v).collect()} == {"a2": "a1", "a1": "a0", "a0": None, "b2": "b1", "b1": None}
    assert {r.slug: r.version_id for r in versions.newest(v).collect()} == {"a": "a2", "b": "b2"}
    with pytest.raises(versions.ConflictError):
        versions.merged(v, v.limit(1).withColumn("checksum", F.lit("other")))
    assert versions.merged(v, v).count() == v.count()


def pages(spark, *texts):
    return spark.createDataFrame([("d", "v", i + 1, t) for i, t in enumerate(texts)], "doc string, version_id string, page_no int, text string")


def paths(spark, *texts):
    return [r.section_path for r in chunking.chunks(pages(spark, *texts)).orderBy("ordinal").collect()]


def test_sections(spark):
    assert paths(spark, "3.2. RESPONSIBILITIES.\nx\nCHAPTER 4\ny\nSECTION 2: POLICY\nz") == [["3.2"], ["CHAPTER 4"], ["SECTION 2"]]
    assert paths(spark, "Rates above 3.2 percent are high.\n1.1.  Applicability. ........ 4") == [["(preamble)"]]
    assert paths(spark, "CHAPTER 4\n4.1. SCOPE.\n4.1.2. Detail here.\nBody.")[-1] == ["CHAPTER 4", "4.1", "4.1.2"]
    assert paths(spark, "9. a\n9.10. b\n9.10.2. c\n10.1. d")[-1] == ["10.1"]
    assert paths(spark, "3. a\n3.2.1. b")[-1] == ["3", "3.2.1"]
    run = [f"ENCLOSURE 2\n{'1. Start' if i == 0 else 'more'} {i}" for i in range(4)]
    assert {tuple(p) for p in paths(spark, *run)} == {("(preamble)",), ("1",)}
    twice = chunking.chunks(pages(spark, "ENCLOSURE 2\na", "ENCLOSURE 2\nb")).collect()
    assert len(twice) == 2 == len({r.chunk_id for r in twice}) and {r.page for r in twice} == {1, 2}
    assert paths(spark, " \n ") == []


def test_parts():
    text = " ".join(f"word{i}." if i % 9 == 0 else f"word{i}" for i in range(2000))
    parts = chunking.parts_of(text, 500, 100)
    assert len(parts) > 1 and all(len(p) <= 500 for p in parts)
    whole = parts[0]
    for p in parts[1:]:
        k = next(k for k in range(min(len(p), 250), -1, -1) if whole.endswith(p[:k]))
        whole += p[k:]
    assert whole == text and chunking.parts_of("a" * 30, 10, 99) and chunking.parts_of("x", 500, 100) == ["x"]


HIGH = "Every port office must keep a register of moored barges in the harbour ledger."
ORG = "The quay master must keep a register of moored barges in the dock ledger."


def clauses(spark, rows):
    df = spark.createDataFrame(rows, "version_id string, section_path array<string>, statement string, modality string")
    return schema.conform(df.withColumn("obligation_id", X.obligation_id(F.col("version_id"), F.col("section_path"), F.col("statement"))).withColumn("confidence", F.lit(1.0)), "obligation")


def test_links(spark):
    o = clauses(spark, [("org", ["1"], ORG, "MUST"), ("high", ["1"], HIGH, "MUST"), ("high", ["2"], "Travel vouchers expire yearly.", "MAY"), ("high", ["3"], ORG, "MUST")])
    got = links.propose(o, "org", ["high"], "lex")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    text = {r.obligation_id: r.statement for r in o.collect()}
    found = {text[r.target_id]: r for r in got.collect()}
    assert set(found) == {HIGH, ORG} and found[ORG].confidence == 1.0 and "100% of the shorter" in found[ORG].rationale
    ids = {v: k for k, v in text.items() if v != ORG}
    org = o.where("version_id = 'org'").first()["obligation_id"]
    at = dt.datetime(2024, 1, 1)
    new = spark.createDataFrame([(org, ids[HIGH], "reject", "p", "", at), (org, ids[HIGH], "approve", "p", "", at + dt.timedelta(1)), (org, "gone", "approve", "p", "", at), ("x", "y", "reject", "p", "", at)], "source_obligation_id string, target_obligation_id string, verdict string, actor string, rationale string, at timestamp")
    d = links.decide(schema.empty(spark, "link_decision"), new)
    assert d.count() == 3
    after, counts = links.replay(schema.empty(spark, "implements"), d, o)
    assert [tuple(r) for r in after.collect()] == [(org, ids[HIGH])] and tuple(counts.first()) == (1, 1, 1)
    assert [r.target_id for r in links.review_queue(got, d).collect()] == [r.obligation_id for r in o.where("version_id = 'high' AND section_path[0] = '3'").collect()]
    with pytest.raises(Exception, match="unknown verdict"):
        links.decide(d, new.withColumn("verdict", F.lit("perhaps"))).collect()


def test_changes_and_triage(spark):
    o = clauses(spark, [("a", ["1"], "One shall do x.", "SHALL"), ("b", ["1"], "One shall do y.", "SHALL"), ("a", ["2"], "Same may stay.", "MAY"), ("b", ["2"], "same  may stay.", "MAY"), ("a", ["3"], "P must go.", "MUST"), ("a", ["3"], "Q must go.", "MUST"), ("b", ["3"], "R must go.", "MUST"), ("b", ["3"], "S must go.", "MUST"), ("a", ["4"], "Old rule.", "SHOULD"), ("org", ["9"], "We do.", "MUST")])
    c = changes.diff(o, "a", "b").cache()
    assert tuple(changes.counts(c).first()) == (2, 3, 1)
    by = {r.statement: r for r in c.collect()}
    assert by["One shall do y."].previous_statement == "One shall do x." and "More than one" in by["P must go."].summary and "Section 3:" in by["P must go."].summary and "More than one" not in by["Old rule."].summary
    ours = o.where("version_id = 'org'").first()["obligation_id"]
    link = spark.createDataFrame([(ours, by["Old rule."].obligation_id), (ours, by["One shall do y."].obligation_id)], "source_id string, target_id string")
    anchors = spark.createDataFrame([(ours, "k1"), (ours, "k2")], "obligation_id string, chunk_id string")
    chunk = spark.createDataFrame([("k1", "org", "t1", 1, ["9"], 4), ("k2", "org", "t2", 2, ["9"], 2)], "chunk_id string, version_id string, text string, page int, section_path array<string>, ordinal int")
    version = spark.createDataFrame([("org", "o")], "version_id string, slug string")
    document = spark.createDataFrame([("o", "Ours")], "slug string, name string")
    rows = changes.triage(c, link, o, anchors, chunk, version, document).collect()
    assert [(r.score, r.kind, r.quote, r.document) for r in rows] == [(8.0, "MODIFIED", "t2", "Ours"), (6.0, "REMOVED", "t2", "Ours")]
    assert tuple(changes.unlinked(c, link).first()) == (6, 2, 4)


def test_obligations(spark):
    chunk = spark.createDataFrame([("k1", "v", "The Head shall act. It rains.", ["1"], 0, 1), ("k2", "v", "The Head  shall act.", ["1"], 1, 1), ("k3", "v", "Nothing.", ["2"], 2, 1)], "chunk_id string, version_id string, text string, section_path array<string>, ordinal int, page int")
    calls = spark.sparkContext.accumulator(0)

    class Counting(obligations.ModalExtractor):
        def extract(self, text, section_path):
            calls.add(1)
            return super().extract(text, section_path)

    cache = schema.empty(spark, "extraction_cache")
    found, anchors, full = obligations.extract(chunk, Counting(), cache)
    assert [(r.statement, r.modality, r.actor) for r in found.collect()] == [("The Head shall act.", "SHALL", "The Head")] and anchors.count() == 2 and full.count() == 3
    before = calls.value
    obligations.extract(chunk, Counting(), spark.createDataFrame(full.collect(), full.schema))[0].collect()
    assert calls.value == before
    assert obligations.primary_anchor(anchors, chunk).first()["chunk_id"] == "k1"
    with pytest.raises(obligations.MissingAnchorError):
        obligations.checked_anchors(found, anchors.limit(0), chunk)
    gold = spark.createDataFrame([("a", "SHALL"), ("b", "MUST"), ("c", "MAY")], "statement string, modality string")
    predicted = spark.createDataFrame([("A ", "SHALL"), ("b", "MAY"), ("b", "MUST"), ("z", "MAY")], "statement string, modality string")
    r = obligations.score(gold, predicted).first()
    assert (r.gold, r.predicted, r.matched, r.precision, r.modality_accuracy) == (3, 4, 2, 0.75, 2 / 3)
    assert obligations.score(gold.limit(0), predicted.limit(0)).first()["recall"] == 1.0
    with pytest.raises(Exception, match="unknown modality"):
        spark.range(1).select(schema.checked_modality(F.lit("WILL"))).collect()


def test_search(spark):
    chunk = spark.createDataFrame([("a", "v1", "DoDI 5000.88 governs engineering", 1, ["1"], 0, [1.0, 0.0]), ("b", "v2", "travel pay", 1, ["1"], 0, [0.0, 1.0]), ("c", "v3", "engineering plans plans", 1, ["1"], 0, [1.0, 1.0])], "chunk_id string, version_id string, text string, page int, section_path array<string>, ordinal int, embedding array<float>")
    assert [r.chunk_id for r in search.bm25(chunk, "5000.88 && (engineering)", 5).collect()] == ["a", "c"]
    assert search.bm25(chunk, "?!", 5).count() == 0
    assert [r.chunk_id for r in search.nearest(chunk, [1.0, 0.0], 2).collect()] == ["a", "c"]
    index = spark.createDataFrame([("i", "other", 2)], "name string, model_id string, dimensions int")
    with pytest.raises(search.IndexMismatchError):
        search.nearest(chunk, [1.0, 0.0], 2, index=index, model_id="mine")
    t = {"chunk": chunk, "document_version": spark.createDataFrame([(f"v{i}", f"d{i}") for i in (1, 2, 3)], "version_id string, slug string"), "document": spark.createDataFrame([(f"d{i}", f"Doc {i}") for i in (1, 2, 3)], "slug string, name string"), "anchored_in": spark.createDataFrame([("o1", "a"), ("o2", "b")], "obligation_id string, chunk_id string"), "implements": spark.createDataFrame([("o2", "o1")], "source_id string, target_id string"), "obligation": clauses(spark, [("v1", ["1"], "The Director shall act.", "SHALL")]).withColumn("obligation_id", F.lit("o1")), "change": schema.empty(spark, "change")}
    port = embedding.LoadedEmbedder("m", 2, lambda: lambda texts: [[1.0, 0.0] for _ in texts])
    rows = search.retrieve(t, "engineering 5000.88", port, 3).collect()
    assert rows[0].chunk_id == "a" and rows[0].legs == ["vector", "fulltext"] and {r.chunk_id for r in rows} == {"a", "b", "c"}
    assert {r.chunk_id: r.legs for r in search.retrieve(t, "5000.88", limit=3).collect()} == {"a": ["fulltext"], "b": ["graph"]}
    assert search.ask(t, "Who must act as the director?").template_used == "grounded_passages"
    a = search.ask(t, "what obliges director?")
    assert a.template_used == "obligations_for_actor" and a.text.startswith("The corpus states:\n— \"The Director shall act.") and a.citations[0]["document"] == "Doc 1"
    assert search.ask(t, "zzz").text == search.NOTHING
    assert search.select_template("So, what has changed in DoDI 5000.88?").parameters == {"document": "DoDI 5000.88"}
    assert search.select_template("What does DoDD 1 implement?").name == "implements_for_document"


LEGACY = "Department of Defense\nDIRECTIVE\nNUMBER 5000.01\nEffective: May 12, 2003\ncancels DoD Directive 5000.1\nEffective: February 31, 2004\nREFERENCES\n(a) DoD Directive 5000.1, “Old,” March 15, 1996\n(b) DoD Instruction 5000.02, “Operation of\nthe System”\n(c) no title here\n(d) Title 10, United States Code\n(e) DoDD 5000.01, “Self”\nGLOSSARY\n(f) DoD Manual 1, “X”"
MODERN = "DOD INSTRUCTION 5000.88\nEffective: November 18, 2020\nIncorporating Change 2, 3 March 2022\n1.1. Text\nREFERENCES\nDoD Directive 5000.01, “The Defense System,” 2020\nMilitary Standard 882E, “Department of\nDefense Standard Practice,” 2012\nPublic Law 1, “Y”"


def test_issuances(spark):
    p = spark.createDataFrame([("l", 1, LEGACY), ("m", 1, MODERN), ("n", 1, "nothing here")], "doc string, page_no int, text string")
    got = {r.doc: r for r in issuance.documents(p).collect()}
    assert got["l"].name == "DoDD 5000.01" and got["l"].effective_date == dt.date(2003, 5, 12) and got["l"].format == "legacy"
    assert got["l"].references == ["DoDD 5000.1", "DoDI 5000.02", "United States Code, Title 10"] and got["l"].self_references_skipped == 1 and got["l"].unattributed == ["no title here"]
    assert got["m"].name == "DoDI 5000.88" and got["m"].effective_date == dt.date(2022, 3, 3)
    assert got["m"].references == ["DoDD 5000.01", "Military Standard 882E", "Public Law 1"]
    assert got["n"].name is None and got["n"].format == "unknown" and got["n"].references == []


def test_store_ingest_rebuild(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    (tmp_path / "m.csv").write_text("Document Name,References,Type\nA,\"['B', 'C']\",x\nB,\"['C']\",x\n")
    assert s.is_empty()
    first = ingest.ingest(s, "m.csv", f"file://{tmp_path}")
    assert (first.documents_created, first.references_created) == (3, 3)
    again = ingest.ingest(s, "m.csv", f"file://{tmp_path}")
    assert (again.documents_created, again.references_created) == (0, 0)
    p = spark.createDataFrame([("x", 1, MODERN + "\n1.2. The Head shall act.")], "doc string, page_no int, text string")
    version = ingest.ingest_pages(s, p, "x.pdf", "file:///x.pdf", "ff" * 32)
    assert version == "dodi-5000-88@2022-03-03" and s.table("chunk").count() > 0
    run = rebuild.enqueue(s, version)
    with pytest.raises(rebuild.BusyError):
        rebuild.enqueue(s, version)
    counts = rebuild.rebuild(s, run, version, p, obligations.ModalExtractor())
    assert counts["obligations"] == 1 and rebuild.status(s.table("job")).first()["state"] == "finished"
    kept = s.current()
    with pytest.raises(schema.DuplicateKeyError):
        s.commit({"document": s.table("document").unionAll(s.table("document"))})
    assert s.current() == kept
    left = store.delete_document(s.tables(), "dodi-5000-88")
    assert left["chunk"].count() == 0 and left["document_version"].count() == 0
    with pytest.raises(ValueError):
        store.add_reference(s.table("references_edge"), "a", "a")
    assert s.clear()["document"] > 0 and s.is_empty()


def test_bounded_sql(spark):
    spark.range(10).createOrReplaceTempView("ten")
    got = sql.run(spark, "WITH t AS (SELECT id, NULL AS n FROM ten) SELECT * FROM t UNION ALL SELECT 11, 'x' ORDER BY id", cap=3)
    assert got.truncated and [r["id"] for r in got.rows] == [0, 1, 2] and got.rows[0]["n"] is None
    assert not sql.run(spark, "SELECT 1 AS a").truncated
    for bad in ("DROP TABLE ten", "CREATE TABLE x AS SELECT 1", "INSERT INTO ten VALUES (1)", "SET a=b", "SELEC 1", "SELECT nope FROM ten", "CACHE TABLE ten"):
        with pytest.raises(sql.RefusedError):
            sql.run(spark, bad)
    with pytest.raises(sql.RefusedError, match="too long"):
        sql.run(spark, "SELECT sum(sqrt(a.id * b.id)) FROM range(70000) a CROSS JOIN range(70000) b", timeout=1.0)
