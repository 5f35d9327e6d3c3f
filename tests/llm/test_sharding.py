import zlib
from collections import Counter, defaultdict

from skarn.llm import sharding
from skarn.llm.common import Stored
from skarn.llm.sharding import Piece


def brute(rows):
    return Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)


def check(out, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == brute(rows)
    places, sizes = defaultdict(list), Counter({s: 0 for s in range(shards)})
    for r in out:
        places[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert set(places) <= set(range(shards))
    return sizes


def test_sizes_are_near_equal(spark):
    rows = [(i, "é" * (i % 97) if i % 7 else None) for i in range(3000)] + [(5000, "x" * 3000), (None, "no id"), (1, "again")]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, shard int, size int").repartition(5)
    sizes = check(sharding.shard(docs).collect(), rows, 40)
    assert max(sizes.values()) <= sum(sizes.values()) / 40 * 1.02 + 3016


def test_a_key_with_a_third_of_the_rows_is_split(spark):
    rows = [(7, "same row " * 5)] * 2000 + [(100 + i, "other " * 8) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = sharding.shard(docs, 8).collect()
    sizes = check(out, rows, 8)
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * max(sizes.values())
    assert len({r.shard for r in out if r.doc_id == 7}) == 8


def test_one_key_with_nine_tenths_stays_near_equal(spark):
    rows = [(7, f"row {i % 900} " * 3) for i in range(9000)] + [(7, "copy " * 5)] * 9000 + [(100 + i, "other " * 4) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sizes = check(sharding.shard(docs).collect(), rows, 40)
    mean = sum(sizes.values()) / 40
    assert 0.97 * mean < min(sizes.values()) and max(sizes.values()) < 1.03 * mean


def test_equal_texts_under_many_keys_and_long_texts(spark):
    rows = [(i, "the same text") for i in range(4000)] + [(5000 + i, "é" * 400_000) for i in range(3)] + [(None, "x"), (None, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sharding.shard(docs, 10).collect()
    check(out, rows, 10)
    assert len({r.shard for r in out if r.text_crc32 == zlib.crc32(b"the same text")}) >= 7


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(empty).count() == 0
    assert {p.shard for p in sharding.deal({}, 40)} == set(range(40))


def test_the_map_is_stored_and_places_other_tables(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    rows = [(7, f"hot {i}") for i in range(3000)] + [(100 + i, "other " * (i % 5)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = sharding.shard(docs, 8, map_path=path).collect()
    first, last = sharding.read_map(spark, path, 1), sharding.read_map(spark, path)
    assert {r.map_version for r in made} == {2} and all(p.parts == 1 for p in first) and any(p.parts > 8 for p in last)
    for pieces in (first, last):
        assert {p.slot for p in pieces} == set(range(sharding.SLOTS)) and all(sum(q.slot == p.slot for q in pieces) == p.parts for p in pieces if p.parts > 1)
    again = Stored(sharding.slotted(docs.repartition(5)), "test-again").df
    out = sharding.place(again, path, 8).collect()
    check(out, rows, 8)
    shards = lambda found: Counter((r.doc_id, r.text_crc32, r.shard) for r in found)
    assert shards(out) == shards(made)  # by the rows alone, however they are read
    new = [(7, f"new {i}") for i in range(50)] + [(90_000 + i, "later") for i in range(500)]
    more = Stored(sharding.slotted(spark.createDataFrame(new, "doc_id long, text string")), "test-more").df
    check(sharding.place(more, path, 8).collect(), new, 8)
    grown = sharding.rebalance(last, 9)
    sharding.write_map(grown, 3, path, spark)
    moved = [(a, b) for a, b in zip(last, grown, strict=True) if a.shard != b.shard]
    assert sum(b.bytes for _, b in moved if b.shard == 8) > 0.95 * sum(b.bytes for _, b in moved)
    assert 0.05 < sum(a.bytes for a, _ in moved) / sum(p.bytes for p in last) < 0.15
    sizes = check(sharding.place(again, path, 9).collect(), rows, 9)
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 9


def test_edits_move_little(spark):
    pieces = sharding.deal({s: 100 + s % 13 for s in range(1000)}, 10, 1000)
    more = sharding.rebalance(pieces, 11)
    before, after = {p.slot: p.shard for p in pieces}, {p.slot: p.shard for p in more}
    moved = [s for s in before if before[s] != after[s]]
    assert all(after[s] == 10 for s in moved) and 60 < len(moved) < 110
    loads = Counter()
    for p in more:
        loads[p.shard] += p.bytes
    assert max(loads.values()) < 1.03 * sum(loads.values()) / 11 and len(loads) == 11
    fewer = sharding.rebalance(more, 9)
    assert {p.shard for p in fewer} == set(range(9))
    assert sorted((p.slot, p.bytes) for p in fewer) == sorted((p.slot, p.bytes) for p in pieces)
    assert sharding.rebalance([], 3) == [] and sharding.rebalance(pieces, 10) == pieces or sharding.rebalance(pieces, 10) == sorted(pieces, key=lambda p: p.slot)
    assert sharding.deal({1: 5}, 2, 2) == [Piece(1, 0, 1, 0, 5), Piece(0, 0, 1, 1, 0)]
    assert sharding.split([Piece(0, 0, 1, 1, 9), Piece(1, 0, 1, 0, 5)], {1: [2, 3]}) == [Piece(0, 0, 1, 1, 9), Piece(1, 0, 2, 0, 2), Piece(1, 1, 2, 0, 3)]
