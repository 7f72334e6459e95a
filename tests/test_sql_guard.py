"""What ad-hoc SQL refuses and what it takes."""

import pytest

from citeloom.plans import sql

REFUSED = [
    "SELECT * FROM text.`file:///etc/hostname`",
    "SELECT * FROM parquet.`/tmp/x`",
    "SELECT * FROM spark_catalog.default.ten",
    "SELECT * FROM unknown",
    "SELECT (SELECT max(value) FROM text.`file:///etc/hostname`)",
    "SELECT * FROM ten WHERE id IN (SELECT length(value) FROM text.`/etc/hostname`)",
    "WITH t AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM t",
    "WITH t AS (WITH u AS (SELECT * FROM csv.`/etc/hostname`) SELECT * FROM u) SELECT * FROM t",
    "SELECT * FROM ten a JOIN LATERAL (SELECT * FROM text.`/etc/hostname`) b",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.name')",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME')",
    "SELECT try_reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT id FROM ten ORDER BY reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT id, count(*) FROM ten GROUP BY id HAVING reflect('java.lang.System', 'getenv', 'HOME') <> ''",
    "SELECT sum(id) OVER (PARTITION BY reflect('java.lang.System', 'getenv', 'HOME')) FROM ten",
    "SELECT sum(id) OVER w FROM ten WINDOW w AS (PARTITION BY reflect('java.lang.System', 'getenv', 'HOME'))",
    "SELECT sum(id) FILTER (WHERE java_method('java.lang.System', 'getenv', 'HOME') = '') FROM ten",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'getenv', 'HOME'))",
    "SELECT * FROM ten LATERAL VIEW explode(array(reflect('java.lang.System', 'getenv', 'HOME'))) t AS x",
    "SELECT current_user()",
    "SELECT input_file_name() FROM ten",
    "SELECT '${env:HOME}'",
    "SELECT '${system:user.name}'",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv', 'HOME')",
    "SELECT * FROM IDENTIFIER('ten')",
    "SELECT mine(id) FROM ten",
    "SELECT system.builtin.reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT * FROM sql_keywords()",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM ten",
    "EXPLAIN SELECT 1",
    "DESCRIBE ten",
    "SHOW TABLES",
    "FROM ten INSERT INTO x SELECT *",
]
TAKEN = {
    "SELECT count(*) AS n FROM ten": [{"n": 10}],
    "WITH a AS (SELECT id FROM ten), b AS (SELECT max(id) AS m FROM a) SELECT m FROM b": [{"m": 9}],
    "SELECT id FROM ten WHERE id IN (SELECT max(id) FROM ten) AND EXISTS (SELECT 1 FROM ten)": [{"id": 9}],
    "SELECT (SELECT min(id) FROM ten) AS a, upper('x') AS b, CASE WHEN 1 < 2 THEN coalesce(NULL, 3) END AS c": [{"a": 0, "b": "X", "c": 3}],
    "SELECT x FROM VALUES (1), (2) AS t(x) UNION SELECT 2 INTERSECT SELECT 2 ORDER BY x": [{"x": 1}, {"x": 2}],
    "SELECT id, row_number() OVER (ORDER BY id DESC) AS r FROM ten ORDER BY r LIMIT 1 OFFSET 1": [{"id": 8, "r": 2}],
    "SELECT x, date_trunc('month', DATE '2020-02-03') AS d FROM ten LATERAL VIEW explode(array(id, 7)) t AS x WHERE id = 3 ORDER BY x LIMIT 1": [{"x": 3, "d": "2020-02-01T00:00:00.000Z"}],
    "SELECT a.id FROM ten a LEFT JOIN range(3) b ON a.id = b.id WHERE b.id IS NULL ORDER BY 1 LIMIT 1": [{"id": 3}],
    "SELECT id % 2 AS p, grouping(id % 2) AS g, sum(id) AS s FROM ten GROUP BY ROLLUP (id % 2) ORDER BY g, p": [{"p": 0, "g": 0, "s": 20}, {"p": 1, "g": 0, "s": 25}, {"p": None, "g": 1, "s": 45}],
    "SELECT * FROM (SELECT id % 2 AS p, id FROM ten) PIVOT (sum(id) FOR p IN (0 AS even, 1 AS odd))": [{"even": 20, "odd": 25}],
}


@pytest.fixture(scope="module")
def ten(spark):
    spark.udf.register("mine", lambda x: x, "long")
    return {"ten": spark.range(10)}


def test_refusals(spark, ten):
    for text in REFUSED:
        try:
            got = sql.run(spark, text, views=ten)
        except sql.RefusedError as e:
            assert any(w in str(e) for w in ("not allowed", "only queries", "no table", "PARSE_SYNTAX_ERROR")), (text, str(e))
        else:
            pytest.fail(f"{text}: {got}")
    assert not [t for t in spark.catalog.listTables() if t.name == "ten"]


def test_queries(spark, ten):
    for text, want in TAKEN.items():
        assert sql.run(spark, text, views=ten).rows == want, text
