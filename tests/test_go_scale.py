"""The Go queries at size: rows are spread over tasks, whatever the row groups of the table's file."""

import os

import pytest
from pyspark.sql import functions as F

from strataspark.parsers import golang
from strataspark.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def tasks(df):
    """Rows by the task that makes them."""
    return {r.p: r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()}


def spread(spark, name, rows):
    """Whether many tasks share the query's rows, ``rows`` for each customer."""
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    assert len(tasks(customers)) == 1, "one row group"
    found = tasks(QUERIES[name](spark, SF))
    assert sum(found.values()) == rows * customers.count()
    return len(found) >= 16 and max(found.values()) <= sum(found.values()) / 4


def test_functions_are_spread(spark):
    assert spread(spark, "go_functions", 2)


def test_imports_are_spread_and_read_alone(spark, monkeypatch):
    assert spread(spark, "go_imports", 2)
    source = "package p\nimport \"a\"\n\nfunc f() {}\n"
    whole = golang.parse(source)
    assert golang.parsed(spark.createDataFrame([("x.go", source)], "path string, content string"), ("package", "imports")).collect() == [("x.go", "p", ["a"])]
    monkeypatch.delattr(golang.Parser, "declarations")
    assert golang.parse(source, ("package", "imports")) == {**whole, "functions": None, "structs": None, "methods": None}
    assert golang.parse("package p\nimport \"a\"\nfunc f() {\"\n\f", ("imports",))["imports"] == ["a"]


def test_tokens_at_odd_space():
    lines = lambda source: [(text, line) for _, text, line in golang.tokens(source)]
    assert lines("a \r\n\n\t b`\n`\n /*\n*/c \t") == [("a", 1), (";", 1), ("b", 3), ("`\n`", 3), (";", 4), ("c", 6), (";", 6)]
    with pytest.raises(golang.Malformed):
        golang.tokens("a" + " " * 1_000_000 + "\f")


def parts_made(df):
    """The columns that the parser returns."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x.split("#")[0].strip() for x in plan.split("MapInArrow")[1].split("[")[1].split("]")[0].split(",")]


def test_methods_are_spread_and_made_alone(spark):
    assert spread(spark, "go_methods", 1)
    assert parts_made(QUERIES["go_methods"](spark, SF)) == ["path", "methods"]


def test_structs_are_spread_and_made_alone(spark):
    assert spread(spark, "go_structs", 1)
    assert parts_made(QUERIES["go_structs"](spark, SF)) == ["path", "structs"]


def test_functions_are_made_alone(spark):
    assert parts_made(QUERIES["go_functions"](spark, SF)) == ["path", "functions"]
