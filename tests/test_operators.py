"""DataFrame operators, the command line, and plan shapes."""

import io

import pytest
from pyspark.sql import functions as F

from lakeforge.__main__ import main
from lakeforge.operators import relational as rel
from lakeforge.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "b"), (3, "b")], "k int, g string")


@pytest.fixture
def right(spark):
    return spark.createDataFrame([(1, "a"), (3, "b"), (9, None)], "k int, g string")


def test_limit_by_and_top_k(left):
    assert rows(rel.limit_by(left, 1, ["g"], rel.order_keys(("k", True)))) == [(2, "a"), (3, "b")]
    assert rows(rel.limit_by(left, 1, ["g"], rel.order_keys("k"))) == [(1, "a"), (None, "b")]
    assert [r.k for r in rel.top_k(left, 2, rel.order_keys("k"), 1).collect()] == [1, 2]


def test_joins(left, right):
    assert rows(rel.semi_join(left, right, ["k"])) == [(1, "a"), (3, "b"), (3, "b")]
    assert rows(rel.anti_join(left, right, ["k"])) == [(2, "a"), (None, "b")]
    assert rows(rel.not_in(left, "k", right, "k")) == [(2, "a")]
    assert rows(rel.not_in(left, "g", right, "g")) == []
    assert rows(rel.not_in(left, "k", right.limit(0), "k")) == rows(left)


def test_set_operations(left, right):
    assert rows(rel.set_operation("intersect", left, right)) == [(1, "a"), (3, "b")]
    assert rows(rel.set_operation("except", left, right, every=True)) == [(2, "a"), (3, "b"), (None, "b")]
    assert rel.set_operation("union", left, right).count() == 5 and rel.union_all(left, right, right).count() == 11
    with pytest.raises(ValueError):
        rel.set_operation("join", left, right)


def test_replace_by_key(left, right):
    assert rows(rel.replace_by_key(left, right, ["k"])) == [(1, "a"), (2, "a"), (3, "b"), (9, None), (None, "b")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.queries()["prewhere"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type)" in text and "GreaterThan(value" in text
    scan = plan(catalogue.queries()["group_by"](spark, SF))
    assert "l_orderkey" not in scan.split("ReadSchema")[1].split("\n")[0]


def test_top_k_is_fused_and_cross_joins_become_inner(spark):
    assert "TakeOrderedAndProject" in plan(catalogue.queries()["top_k"](spark, SF))
    assert "Cartesian" not in plan(catalogue.queries()["join_comma"](spark, SF))


def test_no_python_in_the_engines_plans(spark):
    for name, q in catalogue.queries().items():
        text = plan(q(spark, SF))
        assert "Python" not in text and "Arrow" not in text, name


def test_command_line(spark, tmp_path, capsys):
    out = io.StringIO()
    data = f"file://{tmp_path}/d"
    assert main(["--data", data, "--format", "csv", "--no-header", "-q", "CREATE TABLE t (a Int64, b Nullable(String)) ORDER BY a; INSERT INTO t VALUES (1, 'x,y'), (2, NULL); SELECT * FROM t ORDER BY a"], out) == 0
    assert out.getvalue() == '0\n2\n1,"x,y"\n2,\n'
    (tmp_path / "q.sql").write_text("SELECT a FROM t WHERE a > 1")
    out = io.StringIO()
    assert main(["--data", data, "--read-only", "--format", "tsv", "-f", str(tmp_path / "q.sql")], out) == 0 and out.getvalue() == "a\n2\n"
    assert main(["--data", data, "-q", "SELECT nosuch FROM t"]) == 1
    assert main(["--format", "xml"]) == 2 and main(["-f", str(tmp_path / "none.sql")]) == 2


def test_rows_of_a_union_stay_lazy(spark):
    df = catalogue.queries()["union_all"](spark, SF)
    assert df.agg(F.count("*")).first()[0] == 30
