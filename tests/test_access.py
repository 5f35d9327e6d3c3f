"""Keys, pages, positions, strategies, sources: cases beyond the fixtures."""

import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skarn import errors, tools
from skarn.functions import udf
from skarn.operators import aggregate, scan, sort
from skarn.plans import inspect
from skarn.sources import files, kv

ROOT = Path(__file__).resolve().parents[1]


def test_keys_are_never_cut(spark):
    numbers = [0, 7, 42, 100004, 1000042, 1000043, 10**18, 2**63 - 1, -1, -42, -(2**63)]
    table = kv.Keyed(spark.createDataFrame([(n, f"v{n}") for n in numbers], "id long, v string"), "id", "v", "part")
    shown = dict(map(tuple, table.frame().collect()))
    assert shown == {kv.encoded("part", n): f"v{n}" for n in numbers}
    assert [k for k, _ in sorted(shown.items())] == [kv.encoded("part", n) for n in sorted(numbers)]
    for n in numbers:
        assert [r.value for r in table.get(kv.encoded("part", n)).collect()] == [f"v{n}"]
    for none in ("part:42", "part:", "other", "part:0000000000000000043", "zebra", ""):
        assert table.get(none).count() == 0
    for start, end in (("part:", "part;"), ("part:0", "part:9"), ("part:-", "part:0"), (kv.encoded("part", 7), kv.encoded("part", 1000043)), ("a", "z"), ("z", "zz")):
        assert [r.k for r in table.scan(start, end).collect()] == sorted(k for k in shown if start <= k < end)
    assert [r.value for r in table.scan("part:", "part;", 2).collect()] == [f"v{n}" for n in sorted(numbers)[:2]]


def test_bounds_on_keys_reach_the_reader(spark, sf_dir):
    parts = kv.Keyed(files.table(spark, sf_dir, "part"), "p_partkey", "p_name", "part")
    assert "EqualTo(p_partkey,42)" in inspect.pushed_filters(parts.get(kv.encoded("part", 42)))[0]
    pushed = inspect.pushed_filters(parts.scan(kv.encoded("part", 10), kv.encoded("part", 150)))[0]
    assert "GreaterThanOrEqual(p_partkey,10)" in pushed and "LessThan(p_partkey,150)" in pushed


def test_put_keeps_one_row_for_a_key(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, value string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (3, None), (None, "lost")], "k int, value string")
    assert sorted(map(tuple, kv.put(base, new).collect())) == [(1, "a"), (2, "y"), (3, "z")]


@pytest.mark.parametrize("slice_rows", [1, 40, 50_000])
def test_page_scan(spark, slice_rows):
    rng = random.Random(slice_rows)
    keys = [*rng.sample(range(10**6), 900), 10**17, -(10**17), None]
    df = spark.createDataFrame([(k, i, i) for i, k in enumerate(keys)], "key long, _range int, page int").repartition(4)
    order = sorted((k is None, k or 0, i) for i, k in enumerate(keys))
    for start, end in ((0, 1), (2, 5), (88, 99), (0, 1000), (50, 51), (500, 600), (3, 3)):
        out = scan.page_scan(df, ["key", "_range", "page"], "key", start, end, page_rows=10, slice_rows=slice_rows)
        found = [(r[1], r[3]) for r in out.collect()]
        assert sorted(found) == sorted((i, n // 10) for n, (*_, i) in enumerate(order) if start <= n // 10 < end)


def test_page_scan_reads_a_range_of_keys(spark, sf_dir):
    out = scan.page_scan(files.table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderkey", 2, 5, slice_rows=300)
    assert "GreaterThanOrEqual(o_orderkey" in inspect.pushed_filters(out)[0] and "LessThanOrEqual(o_orderkey" in inspect.pushed_filters(out)[0]


def test_columns_with_names_of_ours_stay(spark):
    df = spark.createDataFrame([(i % 3, i, i, i) for i in range(20)], "_part int, _row int, _before int, _salt int")
    out = sort.positions(df, "_part", ("_row", "desc")).collect()
    order = sorted(range(20), key=lambda i: (i % 3, -i))
    assert sorted((r.pos, r._part, r._row, r._before) for r in out) == [(n + 1, i % 3, i, i) for n, i in enumerate(order)]
    assert {tuple(r) for r in aggregate.two_phase(df, ["_part"], ["_salt"]).collect()} == {(k, len(range(k, 20, 3)), sum(range(k, 20, 3))) for k in range(3)}


@pytest.mark.parametrize("large_groups", [False, True])
def test_positions_within_groups(spark, large_groups):
    rows = [(None if i % 5 == 0 else i % 3, f"g{i % 2}", i * 7 % 50, i) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, v int, _start int").repartition(4)
    out = sort.positions(df, ("v", "desc"), "_start", within=["a", "b"], large_groups=large_groups)
    groups = {}
    for a, b, v, i in rows:
        groups.setdefault((a, b), []).append((-v, i))
    expected = {i: n + 1 for g in groups.values() for n, (_, i) in enumerate(sorted(g))}
    assert out.columns == ["a", "b", "v", "_start", "pos"] and {r._start: r.pos for r in out.collect()} == expected and out.count() == 200


def test_parallel_scan_does_not_shuffle(spark, sf_dir):
    assert inspect.shuffles(scan.parallel_scan(files.table(spark, sf_dir, "lineitem"), ["l_orderkey"], 4)) == 0


def test_sharding_strategies(spark):
    keys = spark.range(4000).select("id", F.col("id").cast("string").alias("name"))
    of = lambda n, strategy, **more: [r[0] for r in keys.select(scan.shard_by(F.col("id"), n, strategy, **more)).collect()]
    for strategy in ("MODULO", "HASH", "CONSISTENT_HASH", "ROUND_ROBIN"):
        counts = Counter(of(8, strategy))
        assert set(counts) == set(range(8)) and max(counts.values()) < 2.2 * min(counts.values())
    before, after = of(8, "CONSISTENT_HASH"), of(9, "CONSISTENT_HASH")
    moved = [(a, b) for a, b in zip(before, after, strict=True) if a != b]
    assert {b for _, b in moved} == {8} and 200 < len(moved) < 800
    assert Counter(of(3, "RANGE", bounds=[1000, 3000])) == {0: 1000, 1: 2000, 2: 1000}
    for bad in ("DIRECTORY", "TYPO"):
        with pytest.raises(ValueError):
            scan.shard_by(F.col("id"), 8, bad)
    directory = spark.createDataFrame([(i, i % 4) for i in range(3000)], "key long, shard int")
    placed = scan.by_directory(keys, "id", directory, default=7)
    assert {(r.id, r.shard) for r in placed.collect()} == {(i, i % 4 if i < 3000 else 7) for i in range(4000)}
    for strategy in scan.STRATEGIES[1:]:
        out = scan.repartition_by(keys, strategy, 8, "id", directory=directory)
        assert out.count() == 4000 and out.columns == ["id", "name"] and out.rdd.getNumPartitions() == 8
    for bad in ("TYPO", "directory"):
        with pytest.raises(ValueError):
            scan.repartition_by(keys, bad, 8, "id")


def test_database_reader(spark, monkeypatch):
    seen = {}

    class Reader:
        def format(self, kind):
            seen["format"] = kind
            return self

        def option(self, key, value):
            seen[key] = value
            return self

        def options(self, **more):
            seen.update(more)
            return self

        def load(self):
            return "loaded"

    class Session:
        read = Reader()

    assert files.database(Session(), "PostgreSQL", "host:5432", "shop", "SELECT 1", fetchsize="1000") == "loaded"
    assert seen == {"format": "jdbc", "url": "jdbc:postgresql://host:5432/shop", "query": "SELECT 1", "fetchsize": "1000"}
    files.database(Session(), "MySQL", "h", "d", "q")
    assert seen["url"] == "jdbc:mysql://h/d"


def test_table_functions(spark):
    class Counted:
        def eval(self, n: int):
            for i in range(n):
                yield i, str(i)

    udf.table(spark, "counted", Counted, "n int, text string")
    assert [tuple(r) for r in spark.sql("SELECT * FROM counted(3) ORDER BY n").collect()] == [(0, "0"), (1, "1"), (2, "2")]
    assert spark.sql("SELECT id, n FROM range(4), LATERAL counted(CAST(id AS INT))").count() == 6


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId = "app"

        def __init__(self, master):
            self.master = master

        def getConf(self):
            return Conf()

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn", "k8s://host"):
        with pytest.raises(errors.ConfigError):
            tools.shared_folder(Session(master))
    assert tools.shared_folder(Session("local[4]")).startswith("file://")


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "zstandard"])
def test_a_missing_package_leaves_the_other_queries(missing):
    code = f"import sys; sys.modules[{missing!r}] = None\nimport __spark_entry__ as e; q = e.queries(); print(len([n for n in q if not n.startswith('op') and n != 'pipeline']))"
    said = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert said.stdout.split() == ["70"], said.stderr
