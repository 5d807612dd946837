"""Statements: semantics on small literal tables, and refusals by name."""

import datetime
from decimal import Decimal

import pytest

from lakeforge.session import Session
from lakeforge.types import DialectError


@pytest.fixture
def db(spark):
    s = Session(spark)
    s.run(
        """CREATE TABLE trips (ride UInt64, city String, minutes UInt32, cents Int64, paid Bool) ENGINE = MergeTree ORDER BY ride PRIMARY KEY ride;
        INSERT INTO trips VALUES (11,'Oslo',42,990,true),(12,'Rome',7,310,true),(13,'Oslo',65,1450,false),(14,'Bonn',18,480,true),(15,'Rome',58,1275,false),(16,'Oslo',9,350,true),(17,'Lima',33,720,false);
        CREATE TABLE cities (city String, land String) ENGINE = Memory;
        INSERT INTO cities VALUES ('Oslo','Norway'),('Rome','Italy'),('Lima','Peru');"""
    )
    return s


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(s, expression):
    return s.sql(f"SELECT {expression} AS x").first()[0]


def test_filters_groups_and_joins(db):
    assert rows(db.sql("SELECT city, count() AS n, sumIf(cents, paid) AS b FROM trips GROUP BY city HAVING n > 1")) == [("Oslo", 3, 1340), ("Rome", 2, 310)]
    assert rows(db.sql("SELECT e.city, g.land FROM trips AS e LEFT JOIN cities AS g USING (city) WHERE e.ride > 13")) == [("Bonn", None), ("Lima", "Peru"), ("Oslo", "Norway"), ("Rome", "Italy")]
    assert rows(db.sql("SELECT city, ride FROM trips ORDER BY minutes LIMIT 1 BY city")) == [("Bonn", 14), ("Lima", 17), ("Oslo", 16), ("Rome", 12)]
    assert rows(db.sql("SELECT ride FROM trips WHERE paid ORDER BY ride DESC LIMIT 1, 2")) == [(12,), (14,)]
    assert rows(db.sql("SELECT quantileExact(0.5)(minutes) AS q, groupArray(2)(city) AS g FROM trips WHERE city = 'Oslo'")) == [(42.0, "Oslo,Oslo")]


def test_keys_replace_only_when_declared(db):
    db.sql("INSERT INTO trips VALUES (11,'Kyiv',1,1,true),(11,'Baku',2,2,true)")
    assert rows(db.sql("SELECT city, minutes FROM trips WHERE ride = 11")) == [("Baku", 2)] and db.sql("SELECT count() AS n FROM trips").first()[0] == 7
    db.run("CREATE TABLE u (id UInt64, v Int64) ENGINE = MergeTree ORDER BY id; INSERT INTO u VALUES (1, 1), (1, 2); CREATE TABLE r (id UInt64, v Int64) ENGINE = ReplacingMergeTree ORDER BY id; INSERT INTO r VALUES (1, 1), (1, 2)")
    assert rows(db.sql("SELECT v FROM u")) == [(1,), (2,)] and rows(db.sql("SELECT v FROM r")) == [(2,)]


def test_defaults_ranges_and_constraints(db):
    db.sql("CREATE TABLE t (id UInt8, s String DEFAULT 'hello', n Nullable(Int64), f Float64 DEFAULT 1.5, z Int32, CONSTRAINT pos CHECK (f > 0)) ORDER BY id")
    assert db.sql("INSERT INTO t (id) VALUES (7)").first()[0] == 1
    assert rows(db.sql("SELECT * FROM t")) == [(7, "hello", None, 1.5, 0)]
    with pytest.raises(DialectError, match="out of range"):
        db.sql("INSERT INTO t (id) VALUES (256)")
    with pytest.raises(DialectError, match="constraint pos"):
        db.sql("INSERT INTO t (id, f) VALUES (8, -1)")
    db.run("CREATE TABLE q (id Int64, k Int64 UNIQUE) ORDER BY id; INSERT INTO q VALUES (1, 1)")
    with pytest.raises(DialectError, match="UNIQUE"):
        db.sql("INSERT INTO q VALUES (2, 1)")
    assert rows(db.sql("SELECT * FROM q")) == [(1, 1)]


def test_update_delete_and_alter(db):
    assert db.sql("UPDATE trips SET cents = minutes, minutes = cents WHERE ride <= 12").first()[0] == 2
    assert rows(db.sql("SELECT minutes, cents FROM trips WHERE ride = 11")) == [(990, 42)]
    assert db.sql("DELETE FROM trips WHERE city = 'Oslo'").first()[0] == 3
    db.run("ALTER TABLE trips ADD COLUMN tag String DEFAULT 'x'; ALTER TABLE trips DROP COLUMN paid; ALTER TABLE trips MODIFY COLUMN minutes Float64; ALTER TABLE trips DELETE WHERE ride IN (12, 17); RENAME TABLE trips TO tr")
    assert rows(db.sql("SELECT * FROM tr ORDER BY ride")) == [(Decimal(14), "Bonn", 18.0, 480, "x"), (Decimal(15), "Rome", 58.0, 1275, "x")]
    with pytest.raises(DialectError, match="key"):
        db.sql("ALTER TABLE tr DROP COLUMN ride")
    with pytest.raises(DialectError, match="twice"):
        db.sql("UPDATE tr SET cents = 1, cents = 2")
    with pytest.raises(DialectError, match="same ride"):
        db.sql("UPDATE tr SET ride = 9")


def test_a_statement_writes_only_what_it_touches(db):
    t = db._table("trips")
    first = list(t.paths)
    db.sql("INSERT INTO trips VALUES (21,'Graz',5,100,true)")
    db.sql("INSERT INTO trips VALUES (22,'Nice',6,200,true),(23,'Nice',7,300,true)")
    assert t.paths[:1] == first and len(t.paths) == 3 and db._read(t, t.paths[2:]).count() == 2
    before = list(t.paths)
    db.sql("DELETE FROM trips WHERE ride = 22")
    assert t.paths[:2] == before[:2] and len(t.paths) == 3 and db._read(t, t.paths[2:]).count() == 1
    before = list(t.paths)
    db.sql("UPDATE trips SET city = 'Linz' WHERE ride = 21")
    assert before[0] in t.paths and before[2] in t.paths and before[1] not in t.paths
    before = list(t.paths)
    db.sql("INSERT INTO trips VALUES (23,'Pisa',1,1,true)")  # its key is in one folder
    assert set(before) - set(t.paths) == {before[1]} or len(set(before) - set(t.paths)) == 1
    assert rows(db.sql("SELECT city FROM trips WHERE ride IN (21, 23)")) == [("Linz",), ("Pisa",)]
    with pytest.raises(DialectError, match="same ride"):
        db.sql("UPDATE trips SET ride = 11 WHERE ride = 21")
    assert db.vacuum() > 0 and db.sql("SELECT count() AS n FROM trips").first()[0] == 9
    db.sql("OPTIMIZE TABLE trips FINAL")
    assert len(t.paths) == 1 and db.sql("SELECT count() AS n FROM trips").first()[0] == 9


def test_whole_table_aggregates_read_no_rows(db):
    ask = "SELECT count() AS n, count(city) AS c, min(city) AS a, max(minutes) AS b, min(ride) AS r, max(paid) AS p FROM trips"
    slow = ask + " WHERE ride >= 0"
    for change in ("INSERT INTO trips VALUES (31,'Ä''\\\\x',900,1,false)", "DELETE FROM trips WHERE city = 'Bonn'", "UPDATE trips SET minutes = 1 WHERE ride = 31", "ALTER TABLE trips DROP COLUMN cents", "TRUNCATE TABLE trips"):
        quick = db.sql(ask)
        assert "parquet" not in quick._jdf.queryExecution().executedPlan().toString().lower()
        assert rows(quick) == rows(db.sql(slow)) and quick.schema == db.sql(slow).schema or quick.dtypes == db.sql(slow).dtypes
        db.sql(change)
    assert rows(db.sql(ask)) == rows(db.sql(slow)) == [(0, 0, None, None, None, None)]
    db.run("CREATE TABLE kinds (d Date, t DateTime, f Float64, g Float32, x Decimal64(2), s Nullable(String)) ORDER BY tuple(); INSERT INTO kinds VALUES ('2024-01-02', '2024-01-02 03:04:05', 1.1e0, 2.5e0, -1.25, NULL), ('1999-12-31', '1999-12-31 23:59:59', -3.3e-9, 7.0e0, 3.00, NULL)")
    ask = "SELECT " + ", ".join(f"min({c}) AS a{c}, max({c}) AS b{c}, count({c}) AS n{c}" for c in "dtfgxs") + " FROM kinds"
    assert rows(db.sql(ask)) == rows(db.sql(ask + " WHERE 1 = 1")) and db.sql(ask).dtypes == db.sql(ask + " WHERE 1 = 1").dtypes


def test_rows_by_key(db):
    assert db.get("trips", 13).city == "Oslo" and db.get("trips", 99) is None
    assert [r and r.minutes for r in db.multi_get("trips", [(12,), (98,), (17,)])] == [7, None, 33]
    with pytest.raises(DialectError, match="a key of trips is"):
        db.get("trips", 1, 2)
    assert db.fold("trips", "minutes") == 232 and db.fold("trips", "cents", "max") == 1450
    assert rows(db.scan("trips", ["ride"], "city = 'Rome'")) == [(Decimal(12),), (Decimal(15),)]


def test_transactions(db):
    old = db.sql("SELECT count() AS n FROM trips")
    db.run("BEGIN; DELETE FROM trips WHERE ride = 11")
    assert db.sql("SELECT count() AS n FROM trips").first()[0] == 6
    db.sql("ROLLBACK")
    assert db.sql("SELECT count() AS n FROM trips").first()[0] == 7 == old.first()[0]
    db.run("BEGIN TRANSACTION; DELETE FROM trips WHERE ride = 11; COMMIT")
    assert db.sql("SELECT count() AS n FROM trips").first()[0] == 6
    db.sql("BEGIN")
    with pytest.raises(DialectError):
        db.sql("SELEC 1")
    with pytest.raises(DialectError, match="ROLLBACK"):
        db.sql("SELECT 1")
    with pytest.raises(DialectError, match="rolled back"):
        db.sql("COMMIT")
    db.sql("BEGIN")
    with pytest.raises(DialectError, match="transaction"):
        db.sql("DROP TABLE cities")
    db.sql("ROLLBACK")


def test_two_sessions_on_one_folder(spark, tmp_path):
    a = Session(spark, f"file://{tmp_path}/x")
    a.run("CREATE TABLE t (id Int64) ORDER BY id; INSERT INTO t VALUES (1)")
    b = Session(spark, f"file://{tmp_path}/x")
    a.sql("INSERT INTO t VALUES (2)")
    with pytest.raises(DialectError, match="another session"):
        b.sql("INSERT INTO t VALUES (3)")
    assert rows(Session(spark, f"file://{tmp_path}/x").sql("SELECT id FROM t")) == [(1,), (2,)]


def test_settings(db, tmp_path):
    for name, value in (("format_csv_delimiter", "';;'"), ("max_execution_time", "'soon'"), ("input_format_with_names_use_header", "7"), ("max_threads", "1")):
        with pytest.raises(DialectError):
            db.sql(f"SET {name} = {value}")
    path = f"file://{tmp_path}/s.csv"
    assert db.sql(f"SELECT city, nullIf(land, 'Peru') AS land FROM cities ORDER BY city INTO OUTFILE '{path}' FORMAT CSVWithNames SETTINGS format_csv_delimiter = ';', format_csv_null_representation = 'none'").first()[0] == 3
    assert (tmp_path / "s.csv").read_text() == "city;land\nLima;none\nOslo;Norway\nRome;Italy\n"
    db.sql("CREATE TABLE back (land Nullable(String), city Nullable(String)) ORDER BY tuple()")
    db.run("SET format_csv_delimiter = ';'; SET format_csv_null_representation = 'none'")
    assert db.sql(f"INSERT INTO back FROM INFILE '{path}' FORMAT CSVWithNames").first()[0] == 3
    assert rows(db.sql("SELECT city, land FROM back")) == [("Lima", None), ("Oslo", "Norway"), ("Rome", "Italy")]
    db.sql("TRUNCATE TABLE back")
    db.sql(f"INSERT INTO back FROM INFILE '{path}' FORMAT CSVWithNames SETTINGS input_format_with_names_use_header = 0")
    assert rows(db.sql("SELECT city, land FROM back")) == [("Italy", "Rome"), ("Norway", "Oslo"), (None, "Lima")]
    db.sql("SET max_execution_time = 1")
    with pytest.raises(DialectError, match="longer than 1 seconds"):
        names = "abcdefghij"
        list(db.cursor(f"SELECT count() AS n FROM {', '.join(f'trips AS {x}' for x in names)} WHERE ({' + '.join(f'{x}.ride' for x in names)}) % 7 = 3"))


def test_library_calls(db):
    assert db.execute("DELETE FROM trips WHERE ride = 16") == 1
    with pytest.raises(DialectError, match="no rows"):
        db.execute("SELECT 1")
    reader = db.reader()
    db.sql("TRUNCATE TABLE trips")
    assert [r.ride for r in reader.cursor("SELECT ride FROM trips ORDER BY ride LIMIT 2")] == [11, 12]
    assert rows(db.sql("SELECT ride FROM trips")) == []
    with pytest.raises(DialectError, match="read-only"):
        reader.sql("DELETE FROM trips")


def test_views_and_looking_around(db):
    db.sql("CREATE VIEW slow AS SELECT ride, city FROM trips WHERE minutes > 50")
    assert rows(db.sql("SELECT s.ride FROM slow AS s JOIN cities AS g ON s.city = g.city")) == [(Decimal(13),), (Decimal(15),)]
    assert ("slow",) in rows(db.sql("SHOW TABLES")) and rows(db.sql("SHOW DATABASES")) == [("default",)]
    assert rows(db.sql("DESCRIBE cities")) == [("city", "String", None), ("land", "String", None)]
    assert rows(db.sql("SELECT engine FROM system.tables WHERE name = 'cities'")) == [("Memory",)]
    assert db.sql("SELECT count() AS n FROM system.query_log").first()[0] > 3
    assert "ORDER BY (ride) PRIMARY KEY (ride)" in db.sql("SHOW CREATE TABLE trips").first()[0]
    assert any("Filter" in r[0] for r in db.sql("EXPLAIN SELECT ride FROM trips WHERE ride > 13").collect())
    assert "SELECT" in db.sql("EXPLAIN SYNTAX SELECT 1").first()[0]
    db.run("DROP VIEW slow; CREATE DATABASE d2; USE d2; CREATE TABLE x (a Int8) ENGINE = Log; INSERT INTO x VALUES (1); USE default; TRUNCATE TABLE d2.x; DROP DATABASE d2")
    with pytest.raises(DialectError, match="unknown table"):
        db.sql("SELECT * FROM slow")


def test_command_line(spark, tmp_path):
    import io

    from lakeforge.__main__ import main

    out = io.StringIO()
    script = "CREATE TABLE t (id Int64, v String) ORDER BY id;\n.tables\nINSERT INTO t VALUES (1, 'a;b'),\n(2, 'c');\n.schema t\n.stats t\n.help\nSELECT id FROM t ORDER BY id;\n.quit\nSELECT nosuch;"
    (tmp_path / "s.sql").write_text(script)
    assert main(["--data", f"file://{tmp_path}/d", "-f", str(tmp_path / "s.sql"), "--format", "csv"], out) == 0
    assert "name\nt\n" in out.getvalue() and "CREATE TABLE t" in out.getvalue() and ".quit" in out.getvalue() and out.getvalue().endswith("id\n1\n2\n")
    out = io.StringIO()
    assert main(["-q", "SELECT 1 AS x", "--format", "table"], out) == 0 and "| x |\n| - |\n| 1 |" in out.getvalue()
    many = io.StringIO()
    from lakeforge import __main__ as cli

    cli.show(spark.range(2500), "table", True, many)
    assert many.getvalue().count("\n") == 2502
    assert main(["-q", ".nosuch"], io.StringIO()) == 1 and main(["--format", "xml"], io.StringIO()) == 2


def test_semantics(db):
    assert one(db, "1 / 0") is None and one(db, "7 DIV 2") == 3 and one(db, "-7 % 3") == -1 and one(db, "5 % 0") is None
    assert one(db, "0.1 + 0.2") == Decimal("0.3") and one(db, "round(2.5)") == 2.0 and one(db, "round(3.5)") == 4.0
    assert one(db, "greatest(1, NULL, 3)") is None and one(db, "length('é')") == 2 and one(db, "lower('ÉA')") == "Éa"
    assert one(db, "substring('hello', -3, 2)") == "ll" and one(db, "substring('hello', 2, -1)") == "ell" and one(db, "leftPad('a', 3, '')") == "  a"
    assert one(db, "toInt64('3.9')") == 3 and one(db, "toInt64('x')") is None and one(db, "toInt32(4294967297)") == 1 and one(db, "toUInt32(-1)") == 4294967295
    assert one(db, "toString(1.0e0)") == "1" and one(db, "splitByChar(',', 'a,b')") == "a" and one(db, "trim('  x\t')") == "x"
    assert one(db, "dateDiff('day', toDateTime('2024-01-01 23:59:59'), toDateTime('2024-01-02 00:00:01'))") == 1
    assert one(db, "toDate('2024-01-31') + INTERVAL 1 MONTH") == datetime.date(2024, 2, 29)
    assert one(db, "ln(0)") == float("-inf") and one(db, "sign(-3)") == -1 and one(db, "true + 1") == 2
    assert one(db, "'a\\'b' || 1 || 2.50") == "a'b12.50" and one(db, "NULL = 1 OR true") is True
    assert rows(db.sql("SELECT c1 + 1 AS y, y * 2 AS z FROM (VALUES (1), (NULL)) AS v WHERE y > 1")) == [(2, 4)]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM trips ANY LEFT JOIN cities USING (city)",
        "SELECT * FROM trips ASOF JOIN cities USING (city)",
        "SELECT city, count() FROM trips GROUP BY city WITH TOTALS",
        "CREATE MATERIALIZED VIEW v AS SELECT 1",
        "CREATE VIEW v (a) AS SELECT 1",
        "CREATE TABLE t AS trips",
        "CREATE TABLE t (a Int8) ENGINE = SummingMergeTree ORDER BY a",
        "CREATE TABLE t (a Int8) ENGINE = MergeTree",
        "CREATE TABLE t (a Int8) ORDER BY a PARTITION BY a",
        "CREATE TABLE t (a Decimal(30,2)) ORDER BY a",
        "CREATE TABLE t (a Array(Int8)) ORDER BY a",
        "CREATE TABLE t (a DateTime('Europe/Berlin')) ORDER BY a",
        "INSERT INTO cities FORMAT CSV",
        "INSERT INTO cities VALUES (concat('a', 'b'), 'c')",
        "SELECT sum(ride) OVER (ORDER BY ride GROUPS 1 PRECEDING) FROM trips",
        "SELECT sum(ride) OVER (ORDER BY ride RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) FROM trips",
        "SELECT sum(ride) OVER (ORDER BY ride ROWS BETWEEN CURRENT ROW AND 1 PRECEDING) FROM trips",
        "SELECT count(DISTINCT ride) OVER () FROM trips",
        "SELECT max(DISTINCT ride) FROM trips",
        "SELECT sum(sum(ride)) FROM trips",
        "SELECT ride FROM trips WHERE sum(ride) > 1",
        "SELECT ride FROM trips WHERE city IN (city, 'x')",
        "SELECT ride FROM trips WHERE city LIKE city",
        "SELECT ride FROM trips WHERE city = 1",
        "SELECT ride FROM trips WHERE city",
        "SELECT (1, 2)",
        "SELECT nosuch(1)",
        "SELECT abs(1, 2)",
        "SELECT abs(DISTINCT 1)",
        "SELECT nosuch FROM trips",
        "SELECT ride FROM trips UNION SELECT city FROM cities",
        "SELECT 1 SETTINGS nosuch = 1",
        "SET nosuch = 1",
        "RENAME TABLE trips TO a, cities TO b",
        "SELECT * FROM numbers(10)",
        "ALTER TABLE trips ADD COLUMN x Int8 UNIQUE",
        "CREATE TABLE t (a Int8, b Int8, UNIQUE (a, b)) ORDER BY a",
        "WITH 1 AS x SELECT x",
        "SELECT '2024-01-01' + INTERVAL 1 FORTNIGHT",
    ],
)
def test_refusals(db, text):
    with pytest.raises(DialectError):
        db.sql(text)


def test_files_round_trip(db, tmp_path):
    db.run(
        """CREATE TABLE t (id UInt64, name Nullable(String), price Decimal64(2), day Date, ok Bool, ratio Float64) ORDER BY id;
        INSERT INTO t VALUES (1, 'a,b', -1.25, '2024-01-02', true, 0.5), (2, NULL, 3.00, '1999-12-31', false, -2.0), (3, '', 0.10, '2000-01-01', true, 1.0), (4, 'q"q\nline', 9.99, '2001-01-01', false, 3.25)"""
    )
    path = f"file://{tmp_path}/t.csv"
    assert db.sql(f"SELECT * FROM t ORDER BY id INTO OUTFILE '{path}' FORMAT CSVWithNames").first()[0] == 4
    db.sql("CREATE TABLE back (id UInt64, name Nullable(String), price Decimal64(2), day Date, ok Bool, ratio Float64) ORDER BY id")
    assert db.sql(f"INSERT INTO back FROM INFILE '{path}' FORMAT CSVWithNames").first()[0] == 4
    assert rows(db.sql("SELECT * FROM back")) == rows(db.sql("SELECT * FROM t"))
    (tmp_path / "bad.tsv").write_text("id\tname\nx\ty\n1\tz\n")
    db.sql("CREATE TABLE n (id Int64, name String) ORDER BY id")
    with pytest.raises(DialectError, match="bad lines"):
        db.sql(f"INSERT INTO n FROM INFILE 'file://{tmp_path}/bad.tsv' FORMAT TSVWithNames")
    db.sql(f"INSERT INTO n FROM INFILE 'file://{tmp_path}/bad.tsv' FORMAT TSVWithNames SETTINGS input_format_allow_errors_num = 1")
    assert rows(db.sql("SELECT * FROM n")) == [(1, "z")]
    with pytest.raises(DialectError, match="exists"):
        db.sql(f"SELECT 1 INTO OUTFILE '{path}'")


def test_persistence_and_backup(spark, tmp_path):
    a = Session(spark, f"file://{tmp_path}/a")
    a.run("CREATE TABLE t (id Int64, v String) ORDER BY id; INSERT INTO t VALUES (1, 'x'), (2, 'y'); CREATE VIEW w AS SELECT v FROM t WHERE id = 2")
    a.sql(f"BACKUP TO 'file://{tmp_path}/b'")
    a.sql("DELETE FROM t WHERE id = 1")
    a.sql(f"BACKUP TO 'file://{tmp_path}/b2' INCREMENTAL FROM 'file://{tmp_path}/b'")
    assert a.sql(f"VERIFY BACKUP 'file://{tmp_path}/b'").first()[0] == 1
    again = Session(spark, f"file://{tmp_path}/a", read_only=True)
    assert rows(again.sql("SELECT v FROM w")) == [("y",)] and rows(again.sql("SELECT id FROM t")) == [(2,)]
    with pytest.raises(DialectError, match="read-only"):
        again.sql("TRUNCATE TABLE t")
    a.sql(f"RESTORE FROM 'file://{tmp_path}/b' TO 'file://{tmp_path}/c'")
    assert rows(Session(spark, f"file://{tmp_path}/c").sql("SELECT id FROM t")) == [(1,), (2,)]
    part = next((tmp_path / "b" / "default.t").rglob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"!")
    with pytest.raises(DialectError, match="damaged"):
        a.sql(f"VERIFY BACKUP 'file://{tmp_path}/b'")
