import hashlib

import pytest

from citeloom.sources import paged


def test_pages_of_files(spark, tmp_path):
    files = {"a.txt": "one\ftwo é\f\flast", "b.txt": "x\f" * 7, "c.txt": "", "d.txt": "\f", "big.txt": ("y" * 700_000 + "\f") * 5 + "end", "e.bin": "no", "_skip.txt": "no"}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff ok")
    paged.register(spark)
    df = spark.read.format("paged").option("suffix", ".txt").option("pages", 2).load(f"file://{tmp_path}")
    got = {}
    for r in df.collect():
        got.setdefault(r.doc, {})[r.page_no] = r.text
        assert r.checksum == hashlib.sha256((tmp_path / r.doc).read_bytes()).hexdigest()
    want = {n: dict(enumerate(t.split("\f")[:-1] if t.endswith("\f") else t.split("\f"), 1)) for n, t in files.items() if n.endswith(".txt") and n[0] != "_" and t}
    assert got == want | {"bad.txt": {1: "� ok"}}
    assert df.rdd.getNumPartitions() == 2 + 4 + 1 + 3 + 1  # ranges of two pages
    one = spark.read.format("paged").load(f"file://{tmp_path}/a.txt")
    assert one.count() == 4 and one.schema.simpleString() == "struct<doc:string,page_no:int,text:string,checksum:string>"
    with pytest.raises(Exception, match="decoder"):
        spark.read.format("paged").option("decoder", "none").load(f"file://{tmp_path}").collect()
    with pytest.raises(Exception, match="path"):
        spark.read.format("paged").load().collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("paged").load(f"file://{tmp_path}/nowhere").collect()
