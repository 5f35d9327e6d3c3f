"""The SQL front end, versioned tables, transactions, caches, key-value access."""

import pytest

from skarn import config, errors, types
from skarn.operators import aggregate as agg
from skarn.operators import join, scan, setops, sort
from skarn.plans import inspect
from skarn.sources import dml, files, kv
from skarn.sources.store import Cache, TableStore, Transaction
from skarn.sql import Engine
from pyspark.sql import functions as F

USERS = [(1, "Alice", 25, "alice@example.com"), (2, "Bob", 30, "bob@example.com"), (3, "Charlie", 35, "charlie@example.com"), (4, "Diana", 28, "diana@example.com"), (5, "Eve", 32, "eve@example.com")]


@pytest.fixture
def engine(spark):
    made = Engine(spark)
    made.sql("CREATE TABLE IF NOT EXISTS users (id INT PRIMARY KEY, name VARCHAR(50) NOT NULL, age INT, email VARCHAR(100))")
    made.sql("INSERT INTO users VALUES " + ", ".join(f"({i}, '{n}', {a}, '{e}')" for i, n, a, e in USERS))
    yield made
    made.store.drop("users", if_exists=True)


@pytest.mark.parametrize(
    ("statement", "rows"),
    [
        ("SELECT * FROM users ORDER BY id", USERS),
        ("SELECT id, name, age FROM users WHERE age > 30 ORDER BY id", [(3, "Charlie", 35), (5, "Eve", 32)]),
        ("SELECT AVG(age) AS average_age FROM users", [(30.0,)]),
        ("SELECT age, COUNT(*) AS user_count FROM users GROUP BY age ORDER BY age", [(25, 1), (28, 1), (30, 1), (32, 1), (35, 1)]),
        ("SELECT name, age FROM users ORDER BY age DESC", [("Charlie", 35), ("Eve", 32), ("Bob", 30), ("Diana", 28), ("Alice", 25)]),
        ("SELECT id, name FROM users ORDER BY id LIMIT 3", [(1, "Alice"), (2, "Bob"), (3, "Charlie")]),
        ("SELECT id AS user_id, name AS user_name FROM users WHERE id = 1", [(1, "Alice")]),
        ("SELECT id, UPPER(name) AS upper_name, LENGTH(name) AS name_length FROM users WHERE id = 2", [(2, "BOB", 3)]),
        ("SELECT id, name, age, age + 1 AS next_year_age FROM users WHERE id = 3", [(3, "Charlie", 35, 36)]),
    ],
)
def test_select(engine, statement, rows):
    assert [tuple(r) for r in engine.sql(statement).collect()] == rows


def affected(engine, statement):
    return engine.sql(statement).first()[0]


def test_changes(engine):
    assert affected(engine, "INSERT INTO users (id, name) VALUES (6, 'Frank')") == 1
    assert tuple(engine.sql("SELECT * FROM users WHERE id = 6").first()) == (6, "Frank", None, None)
    # A null age is not below 30: the row stays.
    assert affected(engine, "DELETE FROM users WHERE age < 30") == 2
    assert {r.id for r in engine.sql("SELECT id FROM users").collect()} == {2, 3, 5, 6}
    assert affected(engine, "UPDATE users SET age = age + 1, name = concat(name, ', where, (x)') WHERE id IN (2, 3)") == 2
    assert [tuple(r) for r in engine.sql("SELECT age, name FROM users WHERE id < 4 ORDER BY id").collect()] == [(31, "Bob, where, (x)"), (36, "Charlie, where, (x)")]
    assert affected(engine, "INSERT INTO users SELECT id + 10, name, age, email FROM users") == 4
    assert affected(engine, "TRUNCATE TABLE users") == 8
    assert engine.sql("SELECT * FROM users").count() == 0
    engine.sql("DROP TABLE users")
    with pytest.raises(errors.ExecutionError):
        engine.sql("SELECT * FROM users")
    engine.sql("DROP TABLE IF EXISTS users")


def test_transactions(engine):
    engine.sql("BEGIN")
    engine.sql("UPDATE users SET age = 99 WHERE id = 1")
    assert engine.sql("SELECT age FROM users WHERE id = 1").first()[0] == 99
    assert engine.store.read("users").where("id = 1").first().age == 25
    engine.sql("ROLLBACK")
    assert engine.sql("SELECT age FROM users WHERE id = 1").first()[0] == 25
    engine.sql("BEGIN")
    engine.sql("INSERT INTO users VALUES (7, 'Gil', 1, null)")
    engine.sql("DELETE FROM users WHERE id < 7")
    engine.sql("COMMIT")
    assert [r.id for r in engine.sql("SELECT id FROM users").collect()] == [7]
    with pytest.raises(errors.TransactionError):
        engine.sql("COMMIT")


def test_first_committer_wins(spark):
    store = TableStore(spark, cut_after=2)
    store.create("t_conflict", spark.range(5).toDF("id"))
    one, two = Transaction(store), Transaction(store)
    one.change("t_conflict", dml.delete(F.col("id") < 2))
    two.change("t_conflict", dml.delete(F.col("id") > 2))
    one.commit()
    with pytest.raises(errors.TransactionError):
        two.commit()
    assert store.read("t_conflict").count() == 3
    for i in range(5):  # plans are cut on the way
        store.change("t_conflict", dml.insert(spark.range(10 + i, 11 + i).toDF("id")))
    assert {r.id for r in store.read("t_conflict").collect()} == {2, 3, 4, 10, 11, 12, 13, 14}
    with pytest.raises(errors.StorageError):
        store.read("nowhere")


def test_cache(spark):
    now = [0.0]
    store = TableStore(spark)
    store.create("t_cache", spark.range(3).toDF("id"))
    cache = Cache(store, max_age=10, clock=lambda: now[0])
    make = lambda: store.read("t_cache").agg(F.sum("id").alias("s"))
    text = "SELECT sum(id) FROM t_cache"
    assert cache.get(text, make, keep_rows=True).first().s == 3 and cache.get(text, make).first().s == 3
    assert (cache.hits, cache.misses) == (1, 1)
    store.change("t_cache", dml.insert(spark.range(7, 8).toDF("id")))
    assert cache.get(text, make).first().s == 10 and cache.misses == 2
    now[0] = 20
    assert cache.clean() == 1 and not cache.entries


def test_errors(spark, engine):
    for bad in ("SELEC 1", "UPDATE users", "INSERT users", "", "UPDATE users SET age"):
        with pytest.raises(errors.EngineError):
            engine.sql(bad)
    with pytest.raises(errors.ExecutionError):
        agg.aggregate("median_of_means", "x")
    with pytest.raises(errors.StorageError):
        files.database(spark, "RocksDB", "h", "d", "q")
    with pytest.raises(errors.ConfigError):
        config.Config(sample_ratio=2.0)


def test_types_and_definitions(spark, tmp_path):
    assert types.parse_type("DECIMAL(10, 2)").simpleString() == "decimal(10,2)"
    c = types.parse_column("created TIMESTAMP NOT NULL DEFAULT CURRENT_TIMESTAMP")
    assert (c.name, c.nullable, c.default) == ("created", False, "CURRENT_TIMESTAMP")
    with pytest.raises(errors.SqlParseError):
        types.parse_type("JSONB")
    made = config.Config(shuffle_partitions=7)
    made.save(str(tmp_path / "c.json"))
    assert config.Config.load(str(tmp_path / "c.json")) == made
    df = spark.createDataFrame([("12",), ("x",), ("99999999999",)], "v string")
    assert [r[0] for r in df.select(types.as_integer("v")).collect()] == [12, None, None]


def test_key_value(spark):
    users = spark.createDataFrame([("user1", "Alice"), ("user2", "Bob"), ("user3", "Charlie")], "k string, value string")
    assert kv.get(users, "user1").first().value == "Alice"
    assert kv.get(kv.delete(users, kv.keys(users, ["user2", "none"], "string")), "user2").count() == 0
    log = spark.createDataFrame([(1, "INSERT", "user4", "Dan"), (2, "UPDATE", "user1", "Al"), (3, "DELETE", "user4", None), (4, "SELECT", "user1", None), (5, "DELETE", "gone", None), (6, "WHAT", "user1", None)], "seq long, op string, k string, value string")
    assert {tuple(r) for r in kv.apply(users, log).collect()} == {("user1", "Al"), ("user2", "Bob"), ("user3", "Charlie")}
    assert [(r.success, r.affected_rows) for r in kv.outcomes(users, log).orderBy("seq").collect()] == [(True, 1), (True, 1), (True, 1), (True, 1), (True, 1), (False, 0)]
    assert [r.k for r in kv.scan(users, "user2", "user9", 1).collect()] == ["user2"]
    assert kv.scan_prefix(users, "user").count() == 3
    new = spark.createDataFrame([("user1", "x", 1), ("user1", "y", 2)], "k string, value string, seq int")
    assert kv.get(kv.put(users, new), "user1").first().value == "y"


def test_traps(spark):
    left = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    right = spark.createDataFrame([(1, "x"), (3, "z")], "a int, b string")
    assert (setops.intersect(left, right, bag=True).count(), setops.difference(left, right, bag=True).count()) == (2, 1)
    assert (setops.intersect(left, right).count(), setops.difference(left, right).count()) == (1, 1)
    ones = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    for strategy in ("HASH", "MERGE", "BROADCAST"):
        assert join.join(ones, ones.where("k = 1"), "k", strategy=strategy).count() == 4
    assert [r[0] for r in sort.sort(spark.createDataFrame([(10,), (9,), (None,)], "v int"), "v").collect()] == [9, 10, None]
    pipes = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert agg.group(pipes, ["x", "y"], F.count("*")).count() == 2
    assert scan.page_scan(left.limit(0), ["a"], "a", 0, 5).count() == 0
    with pytest.raises(ValueError):
        join.join(left, right, "a", "SIDEWAYS")


def test_plans(spark, sf_dir):
    orders, customer = files.table(spark, sf_dir, "orders"), files.table(spark, sf_dir, "customer")
    on = orders.o_custkey == customer.c_custkey
    for strategy, operator in {"MERGE": "SortMergeJoin", "HASH": "ShuffledHashJoin", "BROADCAST": "BroadcastHashJoin", "NESTED_LOOP": "CartesianProduct"}.items():
        assert operator in inspect.physical(join.join(orders, customer, on, strategy=strategy))
    eq = scan.index_scan(orders, ["o_orderkey"], {"o_orderstatus": "F"})
    assert "EqualTo(o_orderstatus,F)" in inspect.pushed_filters(eq)[0] and "o_totalprice" not in inspect.read_columns(eq)[0]
    assert "TakeOrderedAndProject" in inspect.physical(sort.top(orders, 3, "o_orderkey"))
    found = inspect.features(agg.group(orders, ["o_orderstatus"], F.sum("o_totalprice")))
    assert (found["aggregates"], found["shuffles"], found["scans"]) == (2, 1, 1)
    assert inspect.estimate(orders)["bytes"] > 0 and "Scan parquet" in inspect.plan_text(orders)
    inspect.disable_rules(spark, "constant_folding")
    assert "(1 + 1)" in inspect.physical(spark.range(3).select(F.expr("id + (1 + 1)")))
    inspect.disable_rules(spark)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    for kind in ("parquet", "orc", "csv", "json"):
        files.write(df, f"{tmp_path}/{kind}", kind)
        assert {(r.id, r.name) for r in files.read(spark, f"{tmp_path}/{kind}", kind).collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(errors.StorageError):
        files.read(spark, "x", "xml")
