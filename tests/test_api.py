import pytest
from pyspark.sql import functions as F

from citeloom.api import Service
from citeloom.operators import embedding, graph, obligations, versions
from citeloom.plans import indexes, ingest, rebuild, store
from citeloom.streaming import dedup

OLD = "DOD INSTRUCTION 5000.88\nEffective: November 18, 2020\n1. Rules\n1.1. A\nThe Head shall report yearly.\n1.2. B\nThe Staff must keep records.\nREFERENCES\nDoD Directive 5000.01, “Defense,” 2020\n"
NEW = OLD.replace("2020\n1. Rules", "2021\n1. Rules").replace("yearly", "monthly")


def pages(spark, text):
    return spark.createDataFrame([("x", 1, text)], "doc string, page_no int, text string")


def test_service_round(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Document Name,References,Type\nA,\"['DoDI 5000.88']\",x\n")
    s = Service(store.Store(spark, f"file://{tmp_path}/db"), ingest.Settings(data_dir=f"file://{tmp_path}"), obligations.ModalExtractor())
    s.ingest("m.csv")
    old, new = (ingest.ingest_pages(s.db, pages(spark, t), "x.pdf", "file:///x.pdf", c * 64) for t, c in ((OLD, "a"), (NEW, "b")))
    for v, t in ((old, OLD), (new, NEW)):
        run = s.rebuild(v, pages(spark, t), wait=120)
        assert s.rebuild_status(run).first()["state"] == "finished"
    assert [r.supersedes for r in s.versions("dodi-5000-88").collect()] == [None, old]
    assert s.chunks("dodi-5000-88").select("version_id").distinct().first()[0] == new
    target = s.db.table("obligation").where((F.col("version_id") == old) & F.col("statement").contains("yearly")).first()["obligation_id"]
    ours = s.db.table("obligation").where((F.col("version_id") == new) & F.col("statement").contains("records")).first()["obligation_id"]
    assert s.review(ours, target, "approve", "me")["promoted"] == 1
    rows, counts = s.triage(new)
    assert counts.first().asDict() == {"total": 1, "linked_changes": 0, "unlinked_changes": 1} and rows.count() == 0
    assert [(r.kind, r.from_version_id) for r in s.db.table("change").collect()] == [("MODIFIED", old)]
    assert s.ask("what changed in DoDI 5000.88?").template_used == "changes_for_document"
    with pytest.raises(graph.NotFoundError):
        s.triage(old)
    with pytest.raises(rebuild.UnknownEditionError):
        rebuild.enqueue(s.db, "none@2020-01-01")
    s.embedder, s.indexes = embedding.HashEmbedder(16), indexes.Indexes(spark, f"file://{tmp_path}/indexes")
    s.index()
    assert tuple(s.db.table("embedding_index").first()) == ("chunk", "hash-16", 16) and s.db.table("chunk").where("embedding IS NULL").isEmpty()
    assert rebuild.embed(s.db, s.embedder) == 0 and s.indexes.texts.texts().count() == s.indexes.vectors().rows.sum() == s.db.table("chunk").count()
    assert s.ask("who shall report?").citations
    assert s.set_authority(new, "The Office") == "the-office" and s.add_entity("Staff", "role") == "staff"
    assert [tuple(r) for r in s.db.table("issued_by").collect()] == [(new, "the-office")]
    with pytest.raises(graph.NotFoundError):
        s.set_authority("none@1", "The Office")
    assert [tuple(r) for r in s.sources().collect()] == [("document", "x.pdf", 1), ("manifest", "m.csv", 1)]
    slug = s.create_document("Policy  X")
    with pytest.raises(versions.ConflictError):
        s.create_document("Policy  X")
    s.add_reference(slug, "a")
    s.add_reference(slug, "a")
    assert s.document(slug).first()["references"] == ["a"]
    s.remove_reference(slug, "a")
    s.delete_document(slug)
    with pytest.raises(graph.NotFoundError):
        s.document(slug)
    assert s.query("SELECT count(*) AS n FROM document").rows[0]["n"] == s.documents().count()
    assert s.graph(include_external=True).total_nodes == 3 and s.health()["status"] == "ok" and s.reset()["document"] == 3


def test_streams(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.unionAll(rows).repartition(3).write.parquet(f"file://{tmp_path}/in")
    source = dedup.read(spark, f"file://{tmp_path}/in", rows.schema)
    run = lambda df, name, mode: df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    run(dedup.first_seen(source, ["event_id"], late="3650 days"), "seen", "append")
    assert spark.table("seen").count() == rows.count()
    run(dedup.counted(source, ["event_type"]), "hours", "complete")
    want = rows.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg((2 * F.count("*")).alias("n"))
    assert spark.table("hours").select("window_start", "event_type", "n").exceptAll(want).isEmpty() and spark.table("hours").count() == want.count()
