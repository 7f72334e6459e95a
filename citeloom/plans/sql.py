"""Ad-hoc SQL: queries over named views only, with as many rows as the cap and as much time as allowed."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_CAP, TIMEOUT = 1000, 10.0
#: What a query may be made of. A plan of any other kind is refused, commands and relations by path among them.
PLANS = {
    "Aggregate", "CTERelationDef", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project",
    "Sample", "Sort", "SubqueryAlias", "Union", "UnionLoop", "Unpivot", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Window", "WithWindowDefinition",
}
#: Groups of built-in functions that compute from their arguments alone, and single ones outside them.
GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs",
    "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs",
}
FUNCTIONS, TABLE_FUNCTIONS = {"typeof"}, {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
#: Expressions that name a function or a relation by a value.
_BY_VALUE = {"ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "UnresolvedTableArg"}


class RefusedError(ValueError):
    """The statement is no query, reads what it may not, cannot be parsed, or took too long."""


@dataclass(frozen=True)
class Result:
    columns: list[str]
    rows: list[dict]
    truncated: bool


def _items(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _nodes(spark: SparkSession, plan) -> Iterator[tuple[str, object]]:
    """("plan" or "expression", node) of a parsed statement, those of subqueries and of WITH clauses among them."""
    todo = [("plan", plan)]
    while todo:
        what, node = todo.pop()
        yield what, node
        if what == "plan":
            todo += [("plan", c) for c in _items(node.children())] + [("expression", e) for e in _items(node.expressions())]
            if _kind(node) == "UnresolvedWith":
                todo += [("plan", pair._2()) for pair in _items(node.cteRelations())]
            elif _kind(node) == "WithWindowDefinition":
                todo += [("expression", w) for w in _items(node.windowDefinitions().values().toSeq())]
        else:
            todo += [("expression", c) for c in _items(node.children())]
            if is_instance_of(spark.sparkContext._gateway, node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):  # a subquery
                todo.append(("plan", node.plan()))


def _names(seq) -> list[str]:
    return [str(x).lower() for x in _items(seq)]


@cache
def _group(spark: SparkSession, name: str) -> str | None:
    """The group of a built-in function, None for any other: what users have registered may do anything."""
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    found = catalyst.analysis.FunctionRegistry.builtin().lookupFunction(catalyst.FunctionIdentifier(name))
    return found.get().getGroup() if found.isDefined() else None


def checked(spark: SparkSession, text: str, views: set[str] | None = None) -> str:
    """The text, if it parses to a query over the views by functions of values; judged by its plan, not by its words.

    views: names that may be read, by default those of all temporary views. Relations by path or in
    a catalog, functions that call Java or tell of the session, and variables are refused.
    """
    if "${" in text:  # replaced by values of the environment before it is parsed
        raise RefusedError("variables are not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise RefusedError(str(e).splitlines()[0]) from e
    if views is None:
        views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    nodes = list(_nodes(spark, plan))
    known = {v.lower() for v in views} | {str(pair._1()).lower() for what, n in nodes if what == "plan" and _kind(n) == "UnresolvedWith" for pair in _items(n.cteRelations())}
    for what, node in nodes:
        kind = _kind(node)
        if what == "plan" and kind not in PLANS or kind in _BY_VALUE:
            raise RefusedError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            name = _names(node.multipartIdentifier())
            if len(name) != 1 or name[0] not in known:
                raise RefusedError(f"there is no table {'.'.join(name)}")
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            name = [str(node.name().unquotedString()).lower()] if kind == "UnresolvedGenerator" else _names(node.nameParts() if kind == "UnresolvedFunction" else node.name())
            table_function = kind == "UnresolvedTableValuedFunction" and name[0] in TABLE_FUNCTIONS
            if len(name) != 1 or not (table_function or name[0] in FUNCTIONS or kind != "UnresolvedTableValuedFunction" and _group(spark, name[0]) in GROUPS):
                raise RefusedError(f"the function {'.'.join(name)} is not allowed")
    return text


def query(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """A checked query as a DataFrame; the views are there while it is analysed, and none stays behind."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(checked(spark, text, None if views is None else set(views)))
    except (AnalysisException, ParseException) as e:
        raise RefusedError(str(e).splitlines()[0]) from e
    finally:
        for name in views or {}:
            spark.catalog.dropTempView(name)


def run(spark: SparkSession, text: str, cap: int | None = ROW_CAP, timeout: float = TIMEOUT, views: dict[str, DataFrame] | None = None) -> Result:
    """Rows of a query as JSON values; one row beyond the cap is asked for to know if there are more. Cap 0 or None is none."""
    group = f"sql-{uuid.uuid4().hex}"
    df = query(spark, text, views)
    sc = spark.sparkContext
    sc.setJobGroup(group, "bounded query", interruptOnCancel=True)
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(timeout, stop)
    timer.start()
    try:
        rows = [r[0] for r in as_json(df.limit(cap + 1) if cap else df).collect()]  # in this thread, which holds the job group
    except Exception as e:
        raise RefusedError("the query took too long" if late.is_set() else str(e).splitlines()[0]) from e
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    values = [json.loads(r) for r in (rows[:cap] if cap else rows)]
    return Result(df.columns, values, bool(cap) and len(rows) > cap)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row; null fields are kept, so that every row has every column."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("row"))
