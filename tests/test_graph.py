import os

import pytest

from citeloom.operators import graph
from citeloom.sources import manifest

SAMPLE = os.environ.get("SAMPLE_MANIFEST", "")  # a manifest of 23 documents with known counts, where there is one


def write(tmp_path, text, name="m.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path / name}"


def loaded(spark, path):
    c = manifest.corpus(manifest.read(spark, path))
    slugs = graph.manifest_slugs(c.names).join(c.names, "name")
    return c, slugs.select("slug", "name", "is_external").cache(), graph.edges_by_slug(c.edges, slugs).cache()


def test_manifest_rules(spark, tmp_path):
    path = write(tmp_path, "Document Name,References,Type\n  A  ,\"['A', ' B ', '', 'A']\",x\nB,\"['C', \"\"O'Neil\"\"]\",y\nC,\"('A',)\",z\n")
    c, documents, edges = loaded(spark, path)
    assert {(r.name, r.is_external) for r in c.names.collect()} == {("A", False), ("B", False), ("C", False), ("O'Neil", True)}
    assert {(r.source, r.target) for r in c.edges.collect()} == {("A", "B"), ("B", "C"), ("B", "O'Neil"), ("C", "A")}
    assert c.self_references.first()["n"] == 2
    for bad in ("Name,Refs\nA,[]\n", "Document Name,References,Type\nA,not-a-list,x\n", "Document Name,References,Type\nA,,x\n", "Document Name,References,Type\n ,[],x\n"):
        with pytest.raises(Exception):
            manifest.read(spark, write(tmp_path, bad, f"bad{len(bad)}.csv")).collect()
    for name in ("", "..", "a/b.csv", "../x", "a\\b"):
        with pytest.raises(manifest.SourceError):
            manifest.resolve(name, "/data")


def test_slugs(spark):
    rows = ["DoDD 5000.01", "United States Code, Title 44, Section 3554", "  ...Policy A!!!  ", "NATO Document AC/92(ATMCNS)D(2020)0002", "///", "Military Standard 882E", "Military-Standard 882E", "Straße"]
    got = {r.name: r.slug for r in graph.manifest_slugs(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    assert [got[r] for r in rows[:5]] == ["dodd-5000-01", "united-states-code-title-44-section-3554", "policy-a", "nato-document-ac-92-atmcns-d-2020-0002", "document"]
    assert got[rows[5]] == "military-standard-882e-511614ad" and got[rows[6]] == "military-standard-882e-4bdcca9c" and got["Straße"] == "strasse"
    stored = spark.createDataFrame([("Policy A", "policy-a")], "name string, slug string")
    new = {r.name: r.slug for r in graph.manifest_slugs(spark.createDataFrame([("policy a",), ("Policy A",)], "name string"), stored).collect()}
    assert new["Policy A"] == "policy-a" and new["policy a"].startswith("policy-a-")
    batch = {r.name: r.slug for r in graph.batch_slugs(spark.createDataFrame([("x-y", 0), ("x y", 1), ("policy a", 2)], "name string, position int"), stored).collect()}
    assert batch["x-y"] == "x-y" and batch["x y"].startswith("x-y-") and batch["policy a"].startswith("policy-a-")


def test_views(spark):
    documents = spark.createDataFrame([(s.lower(), s, e) for s, e in [("S", False), ("F", False), ("G", False), ("D", True), ("E", True)]], "slug string, name string, is_external boolean")
    edges = spark.createDataFrame([("s", "d"), ("s", "e"), ("f", "e"), ("g", "e"), ("d", "s")], "source_slug string, target_slug string")
    v = graph.view(documents, edges, expand="s", limit=4)
    assert {r.slug for r in v.nodes.collect()} == {"s", "f", "g", "e"} and v.truncated and v.total_nodes == 5
    full = graph.view(documents, edges, include_external=True, limit=0)
    assert full.nodes.count() == 5 == full.returned_nodes and not full.truncated and full.edges.count() == 5
    assert graph.view(documents, edges, expand="").nodes.count() == 3
    with pytest.raises(graph.NotFoundError):
        graph.view(documents, edges, include_external=True, expand="nope")
    assert {tuple(r) for r in graph.reciprocal(edges).collect()} == {("s", "d"), ("d", "s")}
    row = graph.adjacency(documents, edges, spark.createDataFrame([("s", "v1"), ("s", "v2")], "slug string, version_id string")).where("slug = 's'").first()
    assert row.references == ["d", "e"] and row.referenced_by == ["d"] and row.version_count == 2


def made_manifest():
    """Rows (name, references) with the counts of a known sample: 23 listed documents, 415 external names, 672 edges of which 72 within, 4 self-references, 2 groups of like names."""
    listed = [f"DoDD 50{i:02}.01" for i in range(23)]
    outside = ["Executive Order 12580", "Executive Order 12626", "Military Standard 882E", "Military-Standard 882E", "Public Law 1 (old)", "Public Law 1", *[f"DoDI 1{i:03}.02" for i in range(409)]]
    references = {name: [] for name in listed}
    for k in range(72):
        references[listed[k % 23]].append(listed[(k % 23 + 1 + k // 23) % 23])
    for k in range(600):  # all external names once, the first ones again
        references[listed[k % 23 if k < 415 else (k + 7) % 23]].append(outside[k if k < 415 else (k - 415) % 185])
    for k in (0, 5, 5, 9):
        references[listed[k]].append(listed[k])
    references[listed[1]] += references[listed[1]][:3]  # repeats are no edges
    return references, outside


def test_goldens_of_the_sample_s_shape(spark, tmp_path):
    references, outside = made_manifest()
    lines = ["Document Name,References,Type", *(f'{n},"{r!r}",x' for n, r in references.items())]
    c, documents, edges = loaded(spark, write(tmp_path, "\n".join(lines) + "\n"))
    pairs = {(s, t) for s, rs in references.items() for t in rs if s != t}
    assert len(pairs) == 672 and len(outside) == 415
    assert documents.where("NOT is_external").count() == 23 and documents.where("is_external").count() == 415
    assert edges.count() == 672 and c.self_references.first()["n"] == 4
    assert sorted(r.names for r in manifest.suspected_duplicates(c.names).collect()) == [["Military Standard 882E", "Military-Standard 882E"], ["Public Law 1", "Public Law 1 (old)"]]
    slug = {r.name: r.slug for r in documents.collect()}
    assert len(set(slug.values())) == 438 and slug["Military Standard 882E"] == "military-standard-882e-511614ad" and slug["Public Law 1"] == "public-law-1"
    assert graph.view(documents, edges).edges.count() == 72
    v = graph.view(documents, edges, include_external=True)
    degree = {n: sum(n in p for p in pairs) for n in outside}
    top = {slug[n] for n in sorted(outside, key=lambda n: (-degree[n], slug[n]))[:277]} | {slug[n] for n in references}
    assert (v.returned_nodes, v.total_nodes, v.truncated) == (300, 438, True) and {r.slug for r in v.nodes.collect()} == top
    assert v.edges.count() == sum(slug[s] in top and slug[t] in top for s, t in pairs)
    one = graph.view(documents, edges, expand=slug["DoDD 5003.01"])
    near = {t for s, t in pairs if s == "DoDD 5003.01" and t in degree}
    assert one.returned_nodes == 23 + len(near) and not one.truncated
    full = graph.view(documents, edges, include_external=True, limit=0)
    assert (full.returned_nodes, full.edges.count(), full.truncated) == (438, 672, False)


def test_small_projections(spark):
    listing = spark.createDataFrame([("a", 0, ["b", "c"]), ("b", 2, [])], "slug string, version_count long, referenced_by array<string>")
    assert [r.slug for r in graph.with_editions(listing).collect()] == ["b"] and [r.cited for r in graph.in_degree(listing).orderBy("slug").collect()] == [2, 0]


def golden_of_a_given_sample(spark):
    c, documents, edges = loaded(spark, f"file://{SAMPLE}")
    assert documents.where("NOT is_external").count() == 23 and documents.where("is_external").count() == 415
    assert edges.count() == 672 and c.self_references.first()["n"] == 4
    assert manifest.suspected_duplicates(c.names).count() == 2
    assert graph.view(documents, edges).edges.count() == 72
    v = graph.view(documents, edges, include_external=True)
    slugs = {r.slug for r in v.nodes.collect()}
    assert (v.returned_nodes, v.total_nodes, len(slugs)) == (300, 438, 300)
    assert "executive-order-12580" in slugs and "executive-order-12626" not in slugs
    assert v.edges.count() == 534
    one = graph.view(documents, edges, expand="dodi-3115-14")
    assert one.returned_nodes == 29 and not one.truncated


if SAMPLE:  # the same of a manifest that is given

    def test_given_sample(spark):
        golden_of_a_given_sample(spark)
