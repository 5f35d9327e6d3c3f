"""Constraints, defaults, transactions, views, caches, DDL, databases, durability of the SQL engine."""

import time

import pytest
from pyspark.sql import functions as F

from skarn import errors
from skarn.sources import dml
from skarn.sources.store import Index, TableStore
from skarn.sql import Engine, split_where


@pytest.fixture
def engine(spark):
    made = Engine(spark)
    made.sql("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(50) NOT NULL, mail VARCHAR(99) UNIQUE, kind VARCHAR(9) DEFAULT 'x', at TIMESTAMP DEFAULT CURRENT_TIMESTAMP)")
    made.sql("INSERT INTO t (id, name) VALUES (1, 'a'), (2, 'b')")
    return made


def rows(engine, text):
    return [tuple(r) for r in engine.sql(text).collect()]


@pytest.mark.parametrize(
    "statement",
    [
        "INSERT INTO t (id, name) VALUES (3, NULL)",
        "INSERT INTO t (id) VALUES (3)",
        "INSERT INTO t (id, name) VALUES (NULL, 'c')",
        "INSERT INTO t (id, name) VALUES (1, 'again')",
        "INSERT INTO t (id, name) VALUES (3, 'c'), (3, 'd')",
        "INSERT INTO t (id, name, mail) VALUES (3, 'c', 'm'), (4, 'd', 'm')",
        "INSERT INTO t SELECT * FROM t",
        "UPDATE t SET name = NULL WHERE id = 1",
        "UPDATE t SET id = 1",
        "UPDATE t SET mail = 'same'",
    ],
)
@pytest.mark.parametrize("inside", [False, True])
def test_constraints(engine, statement, inside):
    if inside:
        engine.sql("BEGIN")
    with pytest.raises(errors.ConstraintError):
        engine.sql(statement)
    assert rows(engine, "SELECT id, name FROM t ORDER BY id") == [(1, "a"), (2, "b")]
    engine.sql("INSERT INTO t (id, name, mail) VALUES (3, 'c', NULL), (4, 'd', 'm')")
    assert engine.sql("SELECT * FROM t").count() == 4


def test_composite_keys(spark):
    engine = Engine(spark)
    engine.sql("CREATE TABLE p (a INT, b INT, c INT, PRIMARY KEY (a, b), CONSTRAINT u UNIQUE (c))")
    engine.sql("INSERT INTO p VALUES (1, 1, 1), (1, 2, NULL), (2, 1, NULL)")
    for bad in ("(1, 2, 5)", "(3, NULL, 5)", "(3, 3, 1)"):
        with pytest.raises(errors.ConstraintError):
            engine.sql(f"INSERT INTO p VALUES {bad}")
    with pytest.raises(errors.ExecutionError):
        engine.sql("INSERT INTO p (a, b, nowhere) VALUES (7, 7, 7)")


def test_values_of_clocks_stay(engine):
    first = rows(engine, "SELECT at FROM t ORDER BY id")
    engine.sql("UPDATE t SET kind = CAST(rand() AS STRING), at = current_timestamp() WHERE id = 2")
    second = rows(engine, "SELECT kind, at FROM t ORDER BY id")
    time.sleep(0.05)
    assert rows(engine, "SELECT kind, at FROM t ORDER BY id") == second
    assert (second[0][1],) == first[0] and second[1][1] > first[1][0]


def test_transactions_see_defaults_and_their_own_rows(engine):
    engine.sql("BEGIN")
    engine.sql("INSERT INTO t (id, name) VALUES (3, 'c')")
    engine.sql("INSERT INTO t (id, name) SELECT id + 10, name FROM t")
    assert rows(engine, "SELECT id, kind FROM t ORDER BY id") == [(i, "x") for i in (1, 2, 3, 11, 12, 13)]
    assert rows(engine, "SELECT count(*) FROM t WHERE at IS NULL") == [(0,)]
    engine.sql("DELETE FROM t WHERE id IN (SELECT id + 10 FROM t)")
    with pytest.raises(errors.TransactionError):
        engine.sql("CREATE TABLE more (a INT)")
    engine.sql("COMMIT")
    assert rows(engine, "SELECT id FROM t ORDER BY id") == [(1,), (2,), (3,)]


def test_transactions_read_what_was_there_when_they_began(spark, engine):
    other = Engine(spark, engine.store)
    engine.sql("BEGIN")
    other.sql("INSERT INTO t (id, name) VALUES (3, 'c')")
    assert rows(engine, "SELECT count(*) FROM t") == [(2,)] and rows(other, "SELECT count(*) FROM t") == [(3,)]
    engine.sql("UPDATE t SET name = 'z'")
    with pytest.raises(errors.TransactionError):
        engine.sql("COMMIT")
    assert rows(engine, "SELECT name FROM t ORDER BY id") == [("a",), ("b",), ("c",)]
    engine.sql("BEGIN")
    engine.sql("COMMIT")


def test_commands_are_not_cached(spark):
    engine = Engine(spark)
    for n in (1, 2, 1):
        engine.sql(f"CREATE OR REPLACE TEMP VIEW v_again AS SELECT {n} AS n")
        assert rows(engine, "SELECT n FROM v_again") == [(n,)]
    for many in (3, 9):
        spark.range(many).createOrReplaceTempView("v_outside")
        assert rows(engine, "SELECT count(*) FROM v_outside") == [(many,)]
    engine.sql("CREATE TABLE c (a INT)")
    for a in range(3):
        engine.sql(f"INSERT INTO c VALUES ({a})")
        assert rows(engine, "SELECT count(*) FROM c") == rows(engine, "SELECT count(*) FROM c") == [(a + 1,)]
    assert engine.plans.hits == 3
    assert rows(engine, "WITH w AS (SELECT a FROM c WHERE a IN (SELECT n FROM v_again)) SELECT * FROM w") == [(1,)]
    engine.sql("DROP TABLE c")
    engine.sql("CREATE TABLE c (a INT)")
    assert rows(engine, "SELECT count(*) FROM c") == [(0,)]


def test_names_are_private_to_an_engine(spark):
    spark.range(7).createOrReplaceTempView("sh")
    one, two = Engine(spark), Engine(spark)
    for engine, value in ((one, 1), (two, 2)):
        engine.sql("CREATE TABLE sh (a INT)")
        engine.sql(f"INSERT INTO sh VALUES ({value})")
    assert rows(one, "SELECT a FROM sh") == [(1,)] and rows(two, "SELECT a FROM SH") == [(2,)]
    assert spark.table("sh").count() == 7
    one.sql("CREATE OR REPLACE TEMP VIEW over_sh AS SELECT a + 1 AS b FROM sh")
    assert rows(one, "SELECT b FROM over_sh") == [(2,)]
    spark.catalog.dropTempView("sh")


def test_alter_table(engine):
    engine.sql("ALTER TABLE t ADD COLUMN age INT DEFAULT 7")
    engine.sql("ALTER TABLE t ADD COLUMNS (a1 INT, a2 VARCHAR(3) UNIQUE)")
    assert rows(engine, "SELECT id, age, a1, a2 FROM t ORDER BY id") == [(1, 7, None, None), (2, 7, None, None)]
    engine.sql("ALTER TABLE t RENAME COLUMN age TO years")
    engine.sql("INSERT INTO t (id, name, a2) VALUES (3, 'c', 'u')")
    assert rows(engine, "SELECT years FROM t WHERE id = 3") == [(7,)]
    engine.sql("ALTER TABLE t ALTER COLUMN years TYPE BIGINT")
    assert dict(engine.sql("SELECT * FROM t").dtypes)["years"] == "bigint"
    engine.sql("ALTER TABLE t ALTER COLUMN years SET NOT NULL")
    engine.sql("ALTER TABLE t ALTER COLUMN years DROP DEFAULT")
    for bad in ("INSERT INTO t (id, name) VALUES (4, 'd')", "INSERT INTO t (id, name, years, a2) VALUES (4, 'd', 1, 'u')", "ALTER TABLE t ALTER COLUMN mail SET NOT NULL"):
        with pytest.raises(errors.ConstraintError):
            engine.sql(bad)
    engine.sql("ALTER TABLE t DROP COLUMN a1")
    engine.sql("ALTER TABLE t RENAME TO u")
    assert engine.sql("SELECT * FROM u").columns == ["id", "name", "mail", "kind", "at", "years", "a2"]
    for bad in ("ALTER TABLE t DROP COLUMN a1", "ALTER TABLE u DROP COLUMN a1", "ALTER TABLE u SPIN", "ALTER TABLE u ADD COLUMN name INT"):
        with pytest.raises(errors.EngineError):
            engine.sql(bad)


def test_indexes(engine):
    engine.sql("CREATE INDEX by_name ON t (name) USING HASH")
    engine.sql("CREATE INDEX IF NOT EXISTS by_name ON t (name)")
    engine.sql("CREATE UNIQUE INDEX one_kind ON t (id, kind)")
    assert engine.store.indexes["by_name"] == Index("t", ("name",))
    with pytest.raises(errors.ConstraintError):
        engine.sql("CREATE UNIQUE INDEX kinds ON t (kind)")
    with pytest.raises(errors.StorageError):
        engine.sql("CREATE INDEX lost ON t (nowhere)")
    engine.sql("DROP INDEX one_kind ON t")
    engine.sql("DROP INDEX IF EXISTS one_kind")
    with pytest.raises(errors.StorageError):
        engine.sql("DROP INDEX one_kind")
    assert list(engine.store.indexes) == ["by_name"] and ("id", "kind") not in engine.store.snapshot("t").keys


def test_databases(spark):
    engine = Engine(spark)
    engine.sql("DROP DATABASE IF EXISTS shop CASCADE")
    for _ in range(2):  # a repeated statement runs again
        engine.sql("CREATE DATABASE shop")
        assert spark.catalog.databaseExists("shop")
        engine.sql("DROP DATABASE shop")
        assert not spark.catalog.databaseExists("shop")
    engine.sql("CREATE DATABASE shop")
    engine.sql("CREATE TABLE here (a INT)")
    engine.sql("USE shop")
    with pytest.raises(errors.EngineError):
        engine.sql("SELECT * FROM here")
    engine.sql("CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(255) NOT NULL, email VARCHAR(255) UNIQUE, created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP)")
    engine.sql("INSERT INTO users (id, name) VALUES (1, 'Ann')")
    assert rows(engine, "SELECT name, created_at IS NULL FROM users") == [("Ann", False)]
    with pytest.raises(errors.EngineError):
        engine.sql("USE nowhere_at_all")
    engine.sql("USE default")
    assert engine.sql("SELECT * FROM here").count() == 0
    engine.sql("DROP DATABASE shop")


def test_saved_versions(spark, engine, tmp_path):
    folder = f"file://{tmp_path}/saved"
    engine.sql("CREATE INDEX by_name ON t (name)")
    assert engine.store.save(folder) == 1
    engine.sql("DELETE FROM t WHERE id = 1")
    assert engine.store.save(folder) == 2
    last, first = Engine(spark, TableStore.load(spark, folder)), Engine(spark, TableStore.load(spark, folder, 1))
    assert rows(last, "SELECT id FROM t") == [(2,)] and rows(first, "SELECT id FROM t ORDER BY id") == [(1,), (2,)]
    assert last.store.indexes == engine.store.indexes
    with pytest.raises(errors.ConstraintError):
        last.sql("INSERT INTO t (id, name) VALUES (2, 'z')")
    last.sql("INSERT INTO t (id, name) VALUES (9, 'z')")
    assert rows(last, "SELECT kind FROM t WHERE id = 9") == [("x",)]
    with pytest.raises(errors.StorageError):
        TableStore.load(spark, folder, 5)


def test_health_counters_and_statistics(engine):
    before = engine.counters.total
    with pytest.raises(errors.EngineError):
        engine.sql("SELEC 1")
    engine.sql("SELECT 1 AS one")
    assert (engine.counters.total - before, engine.counters.failed) == (2, 1) and engine.counters.mean_seconds > 0
    assert engine.statistics("t") == engine.statistics("t") == {"row_count": 2, "page_count": 1, "sample_size": 0}
    cache = engine._caches()[1]
    assert (cache.hits, cache.misses) == (1, 1)
    engine.sql("INSERT INTO t (id, name) VALUES (3, 'c')")
    assert engine.statistics("t")["row_count"] == 3 and cache.misses == 2
    assert engine.health()
    engine.shutdown()
    assert not engine.health()
    with pytest.raises(errors.StorageError):
        engine.sql("SELECT 1")


def test_store_steps_without_definitions(spark):
    store = TableStore(spark)
    store.create("plain", spark.createDataFrame([(1, "a.b")], "`x.y` int, text string"))
    store.change("plain", dml.insert(spark.createDataFrame([(2,)], "`x.y` int")))
    store.change("plain", dml.update({"text": F.lit("z")}, F.col("`x.y`") == 1))
    assert sorted(map(tuple, store.read("PLAIN").collect())) == [(1, "z"), (2, None)]


def test_where_is_found_where_it_is_a_word():
    assert split_where("a = b.where, c = 'x' WHERE d") == ("a = b.where, c = 'x'", "d")
