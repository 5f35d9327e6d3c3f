"""Catalogue of the relational queries: each by the library's operators, with the DuckDB text of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats
from .functions import udf
from .operators import aggregate as agg
from .operators import join as joins
from .operators import scan, setops, sort
from .sources import dml, kv
from .sources.files import table
from .sources.store import TableStore, Transaction
from .sql import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name with the SQL of its rows."""

    def add(made: Query) -> Query:
        QUERIES[made.__name__], SQL[made.__name__] = made, sql
        return made

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist_join(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Scans.


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_table(s, d):
    return scan.scan(table(s, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def scan_index_eq(s, d):
    return scan.index_scan(table(s, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def scan_btree_range(s, d):
    return scan.range_scan(table(s, d, "orders"), ["o_orderkey", "o_totalprice"], "o_orderkey", 100, 200)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def scan_hash_eq(s, d):
    return scan.index_scan(table(s, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"], {"c_custkey": 42}, "HASH")


@query("SELECT o_orderkey, o_totalprice, page FROM (SELECT o_orderkey, o_totalprice, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 81) AS BIGINT) AS page FROM orders) t WHERE page >= 2 AND page < 5")
def scan_page_range(s, d):
    return scan.page_scan(table(s, d, "orders"), ["o_orderkey", "o_totalprice"], "o_orderkey", 2, 5)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE (l_returnflag IN ('A','R') OR l_linestatus IN ('O')) <> (l_linenumber IN (1,2))")
def scan_bitmap(s, d):
    steps = [scan.BitmapCondition("l_returnflag", ("A", "R")), scan.BitmapCondition("l_linestatus", ("O",), "OR"), scan.BitmapCondition("l_linenumber", (1, 2), "NOT")]
    return scan.bitmap_scan(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"], steps)


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders FROM lineitem")
def scan_parallel(s, d):
    return scan.parallel_scan(table(s, d, "lineitem"), ["l_orderkey"]).agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("SELECT o_orderkey, CAST(floor(o_orderkey / 1000) AS BIGINT) AS shard FROM orders WHERE (o_orderkey >= 0 AND o_orderkey < 250) OR (o_orderkey >= 250 AND o_orderkey < 1200)")
def scan_shard_range(s, d):
    return scan.shard_range_scan(table(s, d, "orders"), ["o_orderkey"], "o_orderkey", [(0, 250), (250, 1200)]).withColumn("shard", scan.shard_of(F.col("o_orderkey"), 1000))


@query("SELECT c_custkey % 4 AS shard, count(*) AS n FROM customer GROUP BY c_custkey % 4")
def scan_shard_hash(s, d):
    return agg.group(table(s, d, "customer"), [scan.shard_by(F.col("c_custkey"), 4).alias("shard")], F.count("*").alias("n"))


@query("SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS shard, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY CAST(floor(o_orderkey / 1000) AS BIGINT)")
def shard_stats(s, d):
    return stats.shards(table(s, d, "orders"), "o_orderkey", 1000)


# Key-value access.


@query("SELECT p_name AS value FROM part WHERE p_partkey = 42")
def kv_point_get(s, d):
    return kv.Keyed(table(s, d, "part"), "p_partkey", "p_name", "part").get("part:0000000000000000042")


@query("SELECT t.k, p.p_name AS value FROM (VALUES (42),(43),(99999999)) AS t(k) LEFT JOIN part p ON p.p_partkey = t.k")
def kv_batch_get(s, d):
    parts = kv.from_items(table(s, d, "part"), "p_partkey", "p_name")
    return kv.batch_get(parts, kv.keys(parts, [42, 43, 99999999], "int"))


@query("SELECT format('part:{:019d}', p_partkey) AS k, p_name AS value FROM part WHERE p_partkey >= 10 AND p_partkey < 150 ORDER BY p_partkey LIMIT 100")
def kv_scan_limit(s, d):
    return kv.Keyed(table(s, d, "part"), "p_partkey", "p_name", "part").scan("part:000000000000000001", "part:0000000000000000150", 100)


@query("SELECT c_custkey AS k, c_mktsegment AS value FROM customer WHERE c_custkey >= 10 UNION ALL SELECT c_custkey, 'UPDATED' FROM customer WHERE c_custkey < 10 UNION ALL SELECT c_custkey + 1000000, 'NEW' FROM customer WHERE c_custkey < 5")
def kv_upsert(s, d):
    customers = kv.from_items(table(s, d, "customer"), "c_custkey", "c_mktsegment")
    new = customers.where("k < 10").select("k", F.lit("UPDATED").alias("value")).union(customers.where("k < 5").select((F.col("k") + 1000000).alias("k"), F.lit("NEW").alias("value")))
    return kv.put(customers, new)


@query("SELECT c_custkey AS k, c_mktsegment AS value FROM customer WHERE c_custkey NOT IN (1, 2, 3, 99999999)")
def kv_delete(s, d):
    customers = kv.from_items(table(s, d, "customer"), "c_custkey", "c_mktsegment")
    return kv.delete(customers, kv.keys(customers, [1, 2, 3, 99999999]))


@query("""SELECT user_id AS k, event_type AS value FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1 AND event_type <> 'error'
UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def kv_batch(s, d):
    base = kv.from_items(table(s, d, "customer"), "c_custkey", "c_mktsegment")
    log = table(s, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), F.col("user_id").alias("k"), F.col("event_type").alias("value"))
    return kv.apply(base, log)


# Changes and transactions.


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 25, 'NATION_25', 0")
def dml_insert(s, d):
    engine = Engine(s)
    engine.store.create("nation_changed", table(s, d, "nation"))
    engine.sql("INSERT INTO nation_changed (n_nationkey, n_name, n_regionkey) VALUES (25, 'NATION_25', 0)")
    return engine.store.read("nation_changed")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(s, d):
    store = TableStore(s)
    store.create("customer_changed", table(s, d, "customer"))
    store.change("customer_changed", dml.update({"c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0))
    return store.read("customer_changed").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def dml_delete(s, d):
    store = TableStore(s)
    store.create("customer_changed", table(s, d, "customer"))
    store.change("customer_changed", dml.delete(F.col("c_acctbal") < 0))
    return store.read("customer_changed").select("c_custkey", "c_mktsegment")


def _accounts(s: SparkSession, d: str) -> tuple[TableStore, Transaction]:
    store = TableStore(s)
    store.create("accounts", table(s, d, "customer").select("c_custkey", "c_acctbal"))
    transaction = Transaction(store)
    for key, change in ((1, -100.0), (2, 100.0)):
        transaction.change("accounts", dml.update({"c_acctbal": F.col("c_acctbal") + change}, F.col("c_custkey") == key))
    return store, transaction


@query("SELECT c_custkey, c_acctbal + CASE c_custkey WHEN 1 THEN CAST(-100 AS DOUBLE) WHEN 2 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS balance FROM customer")
def txn_transfer(s, d):
    store, transaction = _accounts(s, d)
    transaction.commit()
    return store.read("accounts").withColumnRenamed("c_acctbal", "balance")


@query("SELECT c_custkey, c_acctbal FROM customer")
def txn_rollback(s, d):
    store, transaction = _accounts(s, d)
    transaction.rollback()
    return store.read("accounts")


# Filters and projections.


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderstatus <> 'P'")
def filter_ops(s, d):
    price = F.col("o_totalprice")
    return table(s, d, "orders").where((price >= 1000) & (price < 50000) & (F.col("o_orderstatus") != "P")).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE (p_size > 40 AND p_type = 'PROMO') OR NOT (p_size > 5)")
def filter_bool(s, d):
    return table(s, d, "part").where(((F.col("p_size") > 40) & (F.col("p_type") == "PROMO")) | ~(F.col("p_size") > 5)).select("p_partkey")


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand LIKE 'Brand#1%' AND p_type IN ('PROMO','SMALL')")
def filter_like_in(s, d):
    return table(s, d, "part").where(F.col("p_brand").like("Brand#1%") & F.col("p_type").isin("PROMO", "SMALL")).select("p_partkey", "p_brand", "p_type")


@query("SELECT n_nationkey, n_name FROM nation WHERE regexp_matches(n_name, '^NATION_1.*')")
def filter_regexp(s, d):
    return table(s, d, "nation").where(F.col("n_name").rlike("^NATION_1.*")).select("n_nationkey", "n_name")


@query("SELECT l_orderkey AS order_id, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def project_exprs(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("SELECT 1 AS one")
def select_literal(s, d):
    return Engine(s).sql("SELECT 1 AS one")


@query("SELECT o.o_orderkey, l.ln, l.ln IS NULL AS is_missing, coalesce(l.ln, 0) AS ln_or_zero FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS ln FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey")
def null_handling(s, d):
    first = agg.group(table(s, d, "lineitem"), [F.col("l_orderkey").alias("o_orderkey")], F.min("l_linenumber").alias("ln"))
    return joins.join(table(s, d, "orders").select("o_orderkey"), first, "o_orderkey", "LEFT").select("o_orderkey", "ln", F.col("ln").isNull().alias("is_missing"), F.coalesce("ln", F.lit(0)).alias("ln_or_zero"))


# Joins.


def _customers_of_orders(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "orders"), table(s, d, "customer")


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(s, d):
    orders, customer = _customers_of_orders(s, d)
    return joins.join(orders, customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "c_custkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON o_custkey = c_custkey")
def join_left(s, d):
    orders, customer = _customers_of_orders(s, d)
    return joins.join(customer, orders.where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "LEFT").select("c_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey")
def join_right(s, d):
    return joins.join(table(s, d, "lineitem"), table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "RIGHT").select("l_orderkey", "l_linenumber", "o_orderkey")


@query("SELECT o_orderkey, l_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') o FULL JOIN lineitem ON l_orderkey = o_orderkey")
def join_full(s, d):
    return joins.join(table(s, d, "orders").where("o_orderstatus = 'F'"), table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "FULL").select("o_orderkey", "l_orderkey", "l_linenumber")


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_nested_loop(s, d):
    return joins.nested_loop(table(s, d, "nation"), table(s, d, "region"), F.col("n_regionkey") < F.col("r_regionkey")).select("n_nationkey", "r_regionkey")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5")
def join_hash(s, d):
    return joins.join(table(s, d, "lineitem"), table(s, d, "part").where("p_size < 5"), F.col("l_partkey") == F.col("p_partkey"), strategy="HASH").select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_broadcast(s, d):
    """Without a hint: Spark broadcasts the suppliers while their size is below its threshold, and shuffles beyond it."""
    return joins.join(table(s, d, "lineitem"), table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_sort_merge(s, d):
    return joins.join(table(s, d, "lineitem"), table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), strategy="MERGE").select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus")
def join_multi_key(s, d):
    on = [F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_linestatus") == F.col("o_orderstatus")]
    return joins.join(table(s, d, "lineitem"), table(s, d, "orders"), on).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT a.r_name AS r1, b.r_name AS r2 FROM region a CROSS JOIN region b")
def join_cross(s, d):
    region = table(s, d, "region")
    return joins.cross(region.select(F.col("r_name").alias("r1")), region.select(F.col("r_name").alias("r2")))


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def join_multi_table(s, d):
    table(s, d, "nation").createOrReplaceTempView("nation")
    table(s, d, "region").createOrReplaceTempView("region")
    return s.sql("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def join_semi(s, d):
    return joins.join(table(s, d, "orders"), table(s, d, "lineitem").where("l_quantity > 49"), F.col("l_orderkey") == F.col("o_orderkey"), "SEMI").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(s, d):
    return joins.join(table(s, d, "orders"), table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "ANTI").select("o_orderkey")


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def dist_join(s, d):
    orders, customer = _customers_of_orders(s, d)
    by_customer = joins.join(orders, customer, orders.o_custkey == customer.c_custkey)
    by_nation = joins.join(by_customer, table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return agg.group(by_nation, ["n_name"], F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# Aggregation.


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group(s, d):
    return agg.group(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], agg.aggregate("count").alias("n"), agg.aggregate("sum", "l_quantity").alias("qty"), F.round(agg.aggregate("avg", "l_extendedprice"), 4).alias("avg_price"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def agg_hash(s, d):
    return agg.group(table(s, d, "orders"), ["o_orderstatus"], F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY o_orderstatus")
def agg_sort(s, d):
    return agg.group(table(s, d, "orders"), ["o_orderstatus"], F.min("o_orderpriority").alias("lo"), F.max("o_orderpriority").alias("hi"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def agg_two_phase(s, d):
    return agg.two_phase(table(s, d, "events"), ["event_type"], ["value"]).select("event_type", "n", F.round("sum_value", 2).alias("total"))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders")
def agg_global(s, d):
    return agg.group(table(s, d, "orders"), [], F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey < 0")
def agg_empty(s, d):
    return agg.group(table(s, d, "orders").where("o_orderkey < 0"), [], F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("SELECT p_brand, min(p_size) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand")
def agg_minmax(s, d):
    return agg.group(table(s, d, "part"), ["p_brand"], F.min("p_size").alias("lo"), F.max("p_retailprice").alias("hi"))


@query("SELECT sum(TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE)) AS s, count(TRY_CAST(o_orderpriority AS DOUBLE)) AS n_ok FROM orders")
def agg_try_cast(s, d):
    return table(s, d, "orders").agg(F.sum(agg.numeric(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))).alias("s"), F.count(agg.numeric("o_orderpriority")).alias("n_ok"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY CAST(year(o_orderdate) AS INT)")
def agg_expr_key(s, d):
    return agg.group(table(s, d, "orders"), [F.year("o_orderdate").alias("y")], F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_cust FROM orders GROUP BY o_orderstatus")
def agg_distinct(s, d):
    return agg.group(table(s, d, "orders"), ["o_orderstatus"], agg.aggregate("count_distinct", "o_custkey").alias("n_cust"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


# Order and limits.


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderstatus ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey ASC) AS BIGINT) AS pos FROM orders")
def sort_multi(s, d):
    return sort.positions(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", ("o_totalprice", "desc"), "o_orderkey").select("o_orderkey", "pos")


@query("SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS BIGINT) AS pos FROM customer")
def sort_within_partitions(s, d):
    return sort.positions(table(s, d, "customer"), ("c_acctbal", "desc"), "c_custkey", within=["c_nationkey"], large_groups=True).select("c_nationkey", "c_custkey", "pos")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def topn_desc(s, d):
    return sort.top(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 10, ("o_totalprice", "desc"), "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(s, d):
    return sort.limit(table(s, d, "orders").select("o_orderkey", "o_custkey"), 10, 5, "o_orderkey")


# Set operations.


def _nations(s: SparkSession, d: str, all_suppliers: bool = False) -> tuple[DataFrame, DataFrame]:
    supplier = table(s, d, "supplier")
    few = supplier if all_suppliers else supplier.where("s_acctbal < 0")
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")), few.select(F.col("s_nationkey").alias("k"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(s, d):
    return setops.union(*_nations(s, d, True))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(s, d):
    return setops.union(*_nations(s, d, True), distinct=True)


@query("SELECT c_nationkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)")
def intersect_bag(s, d):
    return setops.intersect(*_nations(s, d), bag=True)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def intersect_set(s, d):
    return setops.intersect(*_nations(s, d))


@query("SELECT c_nationkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)")
def except_bag(s, d):
    return setops.difference(*_nations(s, d), bag=True)


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def except_set(s, d):
    return setops.difference(*_nations(s, d))


# Functions and statistics.


@query("SELECT p_partkey, p_size + 1 AS plus_one, p_size - 1 AS minus_one, p_size * 2 AS twice, p_retailprice / nullif(p_size - 1, 0) AS ratio FROM part")
def math_arith(s, d):
    size = F.col("p_size")
    return table(s, d, "part").select("p_partkey", (size + 1).alias("plus_one"), (size - 1).alias("minus_one"), (size * 2).alias("twice"), F.try_divide("p_retailprice", size - 1).alias("ratio"))


@query("SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS BIGINT) AS len, concat(p_brand, '-', p_type) AS tag FROM part")
def string_funcs(s, d):
    return table(s, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.length("p_name").cast("long").alias("len"), F.concat("p_brand", F.lit("-"), "p_type").alias("tag"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * CAST(p_size AS BIGINT) AS sq FROM part")
def udf_scalar(s, d):
    square = udf.scalar(s, "square", lambda v: v.astype("int64") ** 2, "long")
    return table(s, d, "part").select("p_partkey", square("p_size").alias("sq"))


@query("SELECT count(*) AS row_count, CAST(ceil(count(*) / 100.0) AS BIGINT) AS page_count, CAST(floor(count(*) / 10) AS BIGINT) AS sample_size FROM orders")
def stats_table(s, d):
    return stats.table(table(s, d, "orders"))


@query("SELECT count(*) - count(o_custkey) AS null_count, count(DISTINCT o_custkey) AS distinct_count, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders")
def stats_column(s, d):
    return stats.column(table(s, d, "orders"), "o_custkey")


@query("SELECT o_orderpriority AS val, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, val LIMIT 3")
def stats_mcv(s, d):
    return stats.most_common(table(s, d, "orders"), "o_orderpriority", 3)


@query("SELECT count(DISTINCT o_orderkey) = count(*) AS is_unique, count(DISTINCT o_orderkey) AS distinct_count FROM orders")
def stats_index(s, d):
    return stats.key(table(s, d, "orders"), "o_orderkey")
