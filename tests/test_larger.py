"""What shows on larger tables and odd texts only."""

import pytest

from lakeforge.session import Session


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def files(spark, tmp_path):
    """Ten rows of two groups over three files of growing size; the keys tie."""
    parts = [(0, range(0, 2)), (1, range(2, 5)), (2, range(5, 10))]
    for k, ids in parts:
        spark.createDataFrame([(i, i % 2, i // 6, f"n{i}") for i in ids], "id int, g int, k int, name string").coalesce(1).write.parquet(f"{tmp_path}/t/f={k}")
    s = Session(spark)
    s.register("t", spark.read.parquet(f"{tmp_path}/t"))
    return s


def test_the_first_of_rows_that_tie_wins(files):
    assert rows(files.sql("SELECT g, argMin(id, k) AS lo, argMax(name, k) AS hi, argMinIf(id, k, id > 1) AS c, argMax(id, nullIf(k, 1)) AS n FROM t GROUP BY g")) == [(0, 0, "n6", 2, 0), (1, 1, "n7", 3, 1)]
    assert rows(files.sql("SELECT id, argMin(id, 1) OVER (PARTITION BY g) AS w FROM t WHERE id > 7")) == [(8, 8), (9, 9)]
    assert rows(files.sql("SELECT argMin(b.id, a.k) AS x, argMax(a.id, 0) AS y FROM t AS a JOIN t AS b USING (g)")) == [(0, 0)]
    assert rows(files.sql("SELECT argMin(id, 0) AS x, argMax(id, 0) AS y FROM (SELECT id FROM t ORDER BY id DESC)")) == [(9, 9)]
    assert rows(files.sql("WITH c AS (SELECT id, g FROM t WHERE id > 4) SELECT g, argMax(id, 1) AS x FROM c GROUP BY g")) == [(0, 6), (1, 5)]
    assert rows(files.sql("SELECT a.id, (SELECT argMin(b.id, 0) FROM t AS b WHERE b.k = a.k) AS x FROM t AS a WHERE a.id IN (3, 8)")) == [(3, 0), (8, 6)]


def test_the_first_of_stored_rows_that_tie_wins(spark):
    s = Session(spark)
    s.run("CREATE TABLE r (id Int64, k Int64) ENGINE = MergeTree ORDER BY id; INSERT INTO r VALUES (5, 1); INSERT INTO r VALUES (3, 1), (9, 1)")
    assert rows(s.sql("SELECT argMin(id, k) AS lo, argMax(id, k) AS hi FROM r")) == [(5, 5)]
    s.run("CREATE TABLE e (id Int64) ENGINE = MergeTree ORDER BY id; CREATE VIEW v AS SELECT id, 1 AS k FROM r")
    assert rows(s.sql("SELECT argMin(id, 1) AS x FROM e")) == [(None,)] and rows(s.sql("SELECT argMin(id, k) > 0 AS x FROM v")) == [(True,)]


def test_an_offset_before_the_texts_start(spark):
    s = Session(spark)
    one = lambda e: s.sql(f"SELECT {e} AS x").first()[0]
    assert [one(f"mid('{t}', -4, 2)") for t in ("", "A.", "De.", "Dear", "Dears")] == ["", "", "D", "De", "ea"]
    assert one("substring('De.', -9, 2)") == "" and one("substring('De.', -4)") == "De." and one("substring('De.', -4, -1)") == "De" and one("substring('De.', -4, 99)") == "De."


@pytest.fixture
def rides(spark):
    s = Session(spark)
    s.register("rides", spark.sql("SELECT CAST(id AS INT) AS id, concat('c', id % 3) AS city, CASE WHEN id % 7 > 0 THEN CAST(id * 37 % 1009 AS DOUBLE) END AS far, CAST(id % 5 AS INT) AS seats, CAST(id AS DECIMAL(18,2)) / 4 AS cost FROM range(3000)"))
    return s


def test_no_task_gathers_a_groups_values(rides, spark):
    from lakeforge.plans import catalogue

    for df in (
        rides.sql("SELECT city, quantile(0.9)(far) AS q, median(seats) AS m, quantileExact(far) AS e, quantile(DISTINCT cost) AS d FROM rides GROUP BY city"),
        catalogue.queries()["quantiles"](spark, "/root/testdata/sf0.001"),
        catalogue.queries()["flagship"](spark, "/root/testdata/sf0.001"),
    ):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan and "collect_list" not in plan and "RepartitionByExpression" in plan


def numpy_quantile(rides, level, where=lambda r: True, what="far"):
    import numpy as np

    kept = {}
    for r in rides.table("rides").collect():
        if where(r) and r[what] is not None:
            kept.setdefault(r.city, []).append(float(r[what]))
    return {k: float(np.quantile(v, level)) for k, v in kept.items()}


@pytest.mark.parametrize("large", [1_000_000, 900, 0])
def test_quantiles_by_rank(rides, monkeypatch, large):
    monkeypatch.setattr("lakeforge.plans.ranks.LARGE", large)
    found = {r.city: r for r in rides.sql("SELECT city, quantile(0.9)(far) AS q, quantile(0)(far) AS lo, quantile(1)(far) AS hi, quantileIf(0.37)(far, seats > 2) AS i, median(DISTINCT seats) AS d, count() AS n FROM rides GROUP BY city").collect()}
    for name, want in {"q": numpy_quantile(rides, 0.9), "lo": numpy_quantile(rides, 0), "hi": numpy_quantile(rides, 1), "i": numpy_quantile(rides, 0.37, lambda r: r.seats > 2)}.items():
        assert {k: r[name] for k, r in found.items()} == pytest.approx(want)
    assert {(r.d, r.n) for r in found.values()} == {(2.0, 1000)}


def test_quantiles_in_odd_places(rides):
    one = lambda q: rows(rides.sql(q))
    assert one("SELECT median(far) AS m FROM rides WHERE id < 0") == [(None,)] and one("SELECT city, median(far) AS m FROM rides WHERE id < 0 GROUP BY city") == []
    assert one("SELECT city, median(far) AS m FROM rides WHERE id = 7 OR id = 5 GROUP BY city") == [("c1", None), ("c2", 185.0)]
    assert one("SELECT nullIf(city, 'c1') AS c, median(id) AS m FROM rides WHERE id < 6 GROUP BY c") == [("c0", 1.5), ("c2", 3.5), (None, 2.5)]
    assert one("SELECT upper(r.city) AS u, median(id) + count() * 2 AS m FROM rides AS r WHERE r.id < 6 GROUP BY city HAVING median(id) > 2 ORDER BY quantile(0.9)(id) DESC LIMIT 1") == [("C2", 7.5)]
    assert one("SELECT id % 2 AS p, rank() OVER (ORDER BY median(id)) AS k FROM rides WHERE id < 6 GROUP BY id % 2") == [(0, 1), (1, 2)]
    assert one("SELECT city, median(x) AS m FROM (SELECT city, median(id) AS x FROM rides GROUP BY city, seats) GROUP BY city") == [("c0", 1498.5), ("c1", 1499.5), ("c2", 1500.5)]
    assert one("SELECT median(id) AS m FROM (SELECT id FROM rides ORDER BY id LIMIT 5)") == [(2.0,)] and one("WITH c AS (SELECT id FROM rides ORDER BY id LIMIT 5), d AS (SELECT id FROM c) SELECT median(id) AS m FROM d") == [(2.0,)]
    assert one("SELECT a.seats, median(b.seats) AS m FROM rides AS a JOIN rides AS b USING (id) WHERE id < 9 GROUP BY b.seats, a.seats HAVING count() > 1 AND a.seats < 2") == [(0, 0.0), (1, 1.0)]
    assert one("SELECT city, median(id) AS m FROM rides WHERE id < 4 GROUP BY ROLLUP (city)") == [("c0", 1.5), ("c1", 1.0), ("c2", 2.0), (None, 1.5)]
    assert one("SELECT city, id FROM rides WHERE id = (SELECT max(id) FROM rides AS x WHERE x.id < 9) AND 1.5 = (SELECT median(id) FROM rides WHERE id < 4)") == [("c2", 8)]
    assert one("SELECT DISTINCT median(seats) AS m FROM rides GROUP BY city") == [(2.0,)] and one("SELECT city, median(id) AS m FROM rides WHERE id < 6 GROUP BY city ORDER BY m LIMIT 1 BY city") == [("c0", 1.5), ("c1", 2.5), ("c2", 3.5)]
    assert one("SELECT count() AS n, 1 AS k FROM rides HAVING median(id) > 5") == [(3000, 1)]
    with pytest.raises(Exception, match="(?i)group"):
        one("SELECT seats, median(id) AS m FROM rides GROUP BY city")
