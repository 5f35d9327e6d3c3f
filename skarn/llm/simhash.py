"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits; two documents are linked when theirs differ in at most RADIUS = 3. Each bit position gets
one of the 15 nonzero vectors of {0,1}^4, and for each nonzero v a mask keeps the positions whose vector has an odd
product with v. The vectors of any three positions are orthogonal to some nonzero v, so the mask of that v leaves all
three out: a pair within the radius agrees on one whole mask at least, and collides there with certainty, not just
with high probability.

Only different fingerprints enter the search (copies are one row). A bucket of a mask and a value is searched in
memory up to ``bucket_rows`` fingerprints, for a spanning forest instead of all pairs; a larger one is covered again,
by the same construction over the positions that its mask left free, until buckets are small or no more than seven
positions are free (then there are at most 128 fingerprints, and fewer than eight positions would leave masks empty). No pair is lost at any size and none is listed twice
over. Components come from contraction rounds under a fresh random order each, so that long chains halve.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other;
null doc_ids take part, and a component's id is its smallest doc_id that is not null (null if it has none); repeated
rows are returned as often as they came; an empty table gives an empty result; other columns are ignored.

``deduplicate`` takes classes of similarity instead where one is given. Shingles of words move few bits of a fingerprint
only if few shingles differ, so candidates come from WORD_PRINTS fingerprints of a text's different words, each covered
as above: none within RADIUS in any of them is lost. A candidate is linked if the SKETCH_BITS of its different shingles
tell of a Jaccard similarity of at least the given one: bits differ by the angle between the sets, whose sizes are known.
At 0.8 the estimate's standard deviation is 0.03. Nodes are texts that differ in more than case and white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, free_name, named, planned, utf8

BITS, RADIUS, SEED = 64, 3, 42
#: Fingerprints of words and bits of shingles that classes of similarity take.
WORD_PRINTS, SKETCH_BITS = 8, 1024
#: Free positions up to which a bucket is searched in memory, whatever its size.
FEW_FREE = 7


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of UTF-8 text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [end + i for i, end in enumerate(accumulate(map(len, words)))]
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(end + 1 for end in ends)]
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    votes = np.zeros(BITS, dtype=np.int64)
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 1 << 15):
        votes += np.unpackbits(values[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (doc_id, text_hash, fp): the id, a hash that tells texts of one id apart, the fingerprint as a signed long."""
    shingle = int(shingle)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in _each(batch.column(2))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    read = docs.select(named(id_column).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(named(text_column), F.lit(""))).alias("text_hash"), utf8(text_column).alias("body"))
    return read.mapInArrow(scan, "doc_id long, text_hash long, fp long")


def _each(column: pa.Array) -> Iterator[bytes]:
    """One value at a time, so that a batch of long texts isn't held twice."""
    return (value.as_py() for value in column)


def masks(positions: list[int]) -> list[int]:
    """The 15 masks (as signed longs) that cover radius 3 over these bit positions."""
    out = []
    for v in range(1, 1 << (RADIUS + 1)):
        kept = sum(1 << p for i, p in enumerate(positions) if ((i % 15 + 1) & v).bit_count() % 2)
        out.append(_signed(kept))
    return out


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _free(mask: int) -> list[int]:
    return [p for p in range(BITS) if not (mask % (1 << BITS)) >> p & 1]


def forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links different values within the radius; memory linear in them."""
    left, right = [], []
    rest = np.unique(values).view(np.uint64)
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            here = stack.pop()
            near = np.bitwise_count(rest ^ here) <= RADIUS
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), here, dtype=np.uint64))
                right.append(found)
                stack.extend(found)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members in batch.column(0):
            a, b = forest(np.array(members.values.to_numpy(zero_copy_only=False), dtype=np.int64))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(reps: DataFrame, bucket_rows: int = 4096) -> tuple[DataFrame, list[Stored]]:
    """Links (a, b) between different fingerprints whose closure is that of all pairs within the radius, and the
    stored tables behind them. reps: a stored table with one row for each fingerprint, column fp."""
    spark = reps.sparkSession
    cover = F.array(*[F.lit(m).cast("long") for m in masks(list(range(BITS)))])
    keyed = reps.select("fp", F.explode(cover).alias("mask")).withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))
    parts, stored = [], []
    while True:
        sizes = Stored(keyed.groupBy("mask", "bucket").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-buckets")
        stored.append(sizes)
        within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
        parts.append(sizes.df.where("n = 2").where(within).select("a", "b"))
        dense = (F.col("n") > bucket_rows) & (F.bit_count(F.bitwise_not("mask")) > FEW_FREE)
        middle = sizes.df.where((F.col("n") > 2) & ~dense).select("mask", "bucket")
        gathered = keyed.join(middle, ["mask", "bucket"]).groupBy("mask", "bucket").agg(F.collect_list("fp").alias("members"))
        parts.append(gathered.select("members").mapInArrow(_forests, "a long, b long"))
        large = [r["mask"] for r in sizes.df.where(dense).select("mask").distinct().collect()]  # at most 15 ^ level masks
        if not large:
            break
        finer = [[m, _signed((m | s) % (1 << BITS))] for m in large for s in masks(_free(m))]
        down = planned(spark, finer, "mask long, finer long")
        split = sizes.df.where(dense).select("mask", "bucket")
        keyed = keyed.join(split, ["mask", "bucket"]).join(F.broadcast(down), "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("bucket")).distinct()
        again = Stored(keyed, "simhash-split")
        stored.append(again)
        keyed = again.df
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out, stored


def components(edges: DataFrame, label: str = "components") -> tuple[DataFrame, list[Stored]]:
    """(node, root) for every node of the undirected edges (a, b), one root for each connected component.

    Rounds of contraction: each node joins the least of its neighbours and itself under a random order that changes
    with the round, edges move to the joined nodes, and it ends when none is left. All steps are joins and
    pre-aggregated minima, so that a hub with millions of neighbours is spread.
    """
    rounds, stored = [], []
    now = Stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-edges")
    while not now.df.isEmpty():
        k = len(rounds)
        both = now.df.union(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        joined = Stored(both.groupBy("a").agg(F.min(order("b")).alias("least")).select(F.col("a").alias("node"), F.least(F.col("least"), order("a"))["v"].alias("up")), f"{label}-up")
        rounds.append(joined)
        left = joined.df.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = joined.df.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = now.df.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        last, now = now, Stored(moved, f"{label}-edges")
        last.drop()
    stored.extend(rounds)
    stored.append(now)
    if not rounds:
        return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")), stored
    roots = rounds[-1].df.select("node", F.col("up").alias("root"))
    for earlier in reversed(rounds[:-1]):
        later = roots.withColumnRenamed("node", "up")
        roots = earlier.df.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return roots, stored


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """Rows (doc_id, text_hash, fp, component_id, root), one for each of docs. The root is a fingerprint of the component
    and tells it from all others, also from those with the same smallest id."""
    prints = Stored(fingerprints(docs, id_column, text_column, shingle), "simhash-prints")
    reps = Stored(prints.df.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-reps")
    edges, stored = links(reps.df, bucket_rows)
    roots, more = components(edges, "simhash")
    of = Stored(roots, "simhash-roots")
    least = of.df.join(reps.df.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = of.df.join(least, "root").select(F.col("node").alias("fp"), "component_id", "root")
    least_id = F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id"))
    answer = Stored(reps.df.join(labelled, "fp", "left").select("fp", least_id.alias("component_id"), F.coalesce("root", "fp").alias("root")), "simhash-answer")
    for old in (*stored, *more, of, reps):
        old.drop()
    return prints.df.join(answer.df, "fp", "left").select("doc_id", "text_hash", "fp", "component_id", "root")


def _spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """A row of ``words`` hashes for each hash."""
    mixed = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
    return mixed ^ mixed >> np.uint64(31)


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` fingerprints of 64 bits of a set of hashes."""
    votes = np.zeros(words * BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # sums of bytes
        bits = np.unpackbits(_spread(hashes[at : at + 255], words).view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")


def sketch(text: bytes, shingle: int = 5) -> tuple[int, int, np.ndarray, bytes]:
    """A hash of the words, the number of different shingles, the fingerprints of the words, the bits of the shingles."""
    words = text.lower().split()
    if not words:
        return 0, 0, np.zeros(WORD_PRINTS, dtype=np.uint64), bytes(SKETCH_BITS // 8)
    joined = b" ".join(words)
    ends = [end + i for i, end in enumerate(accumulate(map(len, words)))]
    starts = [0, *(end + 1 for end in ends)]
    last = ends[shingle - 1 :] or ends[-1:]
    # Arrays, as sets of a long text's hashes would take ten times as much.
    grams = np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)), dtype=np.uint64))
    terms = np.unique(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64))
    return _signed(xxhash.xxh64_intdigest(joined, SEED)), len(grams), majority(terms, WORD_PRINTS), majority(grams, SKETCH_BITS // BITS).tobytes()


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5) -> DataFrame:
    """Rows (doc_id, text_hash, node, size, prints, bits), one for each of docs."""
    shingle = int(shingle)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t, shingle) for t in _each(batch.column(2))]
            prints = [p.view(np.int64) for _, _, p, _ in made]
            columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array([m[3] for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "node", "size", "prints", "bits"])

    read = docs.select(named(id_column).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(named(text_column), F.lit(""))).alias("text_hash"), utf8(text_column).alias("body"))
    return read.mapInArrow(scan, "doc_id long, text_hash long, node long, size long, prints array<long>, bits binary")


def similarities(size: np.ndarray, bits: np.ndarray, other_size: int, other_bits: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarities of sets with another one. bits: a row of 64-bit words for each set."""
    angle = np.bitwise_count(bits ^ other_bits).sum(axis=1, dtype=np.int64) * (np.pi / SKETCH_BITS)
    shared = np.cos(angle) * np.sqrt(size * float(other_size))
    return shared / np.maximum(size + float(other_size) - shared, 1e-9)


def similar_forest(prints: np.ndarray, size: np.ndarray, bits: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges (of indexes) of a spanning forest of the graph that links those within the radius and similar enough."""
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            here = stack.pop()
            at = np.flatnonzero(np.bitwise_count(prints[rest] ^ prints[here]) <= RADIUS)
            near = rest[at]
            at = at[similarities(size[near], bits[near], size[here], bits[here]) >= similarity]
            if len(at):
                edges.extend((here, i) for i in rest[at])
                stack.extend(rest[at])
                rest = np.delete(rest, at)
    return edges


def similar_links(reps: DataFrame, similarity: float, bucket_rows: int = 4096) -> tuple[DataFrame, list[Stored]]:
    """Links (a, b) between nodes whose closure is that of all similar pairs within the radius in some fingerprint, and the
    stored tables behind them. reps: a stored table (node, size, prints, bits) with one row for each node.

    Buckets over ``bucket_rows`` nodes are covered again as in ``links``. Where too few positions are free for that,
    nodes are dealt into blocks, and each two blocks meet in a task, so that no task holds more than about twice the bound."""
    spark = reps.sparkSession
    first = masks(list(range(BITS)))
    tables = [(m, mask) for m in range(WORD_PRINTS) for mask in first]
    prints = reps.select("node", F.posexplode("prints").alias("m", "fp"))
    keyed = prints.select("node", "m", "fp", F.posexplode(F.array(*[F.lit(x).cast("long") for x in first])).alias("i", "mask"))
    keyed = keyed.select("node", (F.col("m") * len(first) + F.col("i")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"))
    parts, stored = [], []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                node, fp, size, bits = (members.values.field(i) for i in range(4))
                words = np.frombuffer(b"".join(bits.to_pylist()), dtype="<u8").reshape(len(bits), -1)
                found = similar_forest(fp.to_numpy().view(np.uint64), size.to_numpy().astype(float), words, similarity)
                if found:
                    ends = np.array(found)
                    values = node.to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(values[ends[:, 0]]), pa.array(values[ends[:, 1]])], names=["a", "b"])

    def meet(shared: DataFrame, *more: str) -> DataFrame:
        told = shared.join(reps, "node").withColumn("fp", F.element_at("prints", F.col("m") + 1))
        return told.groupBy("t", "bucket", *more).agg(F.collect_list(F.struct("node", "fp", "size", "bits")).alias("members")).select("members").mapInArrow(scan, "a long, b long")

    while True:
        sizes = Stored(keyed.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-similar-buckets")
        stored.append(sizes)
        large = [r["t"] for r in sizes.df.where(F.col("n") > bucket_rows).select("t").distinct().collect()]  # at most one for each mask
        free = {t: _free(tables[t][1]) for t in large}
        fixed = [t for t in large if len(free[t]) <= FEW_FREE]
        of_print = F.element_at(F.array(*[F.lit(m) for m, _ in tables]), F.col("t") + 1).alias("m")
        shared = keyed.join(sizes.df.where(F.col("n") <= bucket_rows), ["t", "bucket"]).select("t", "bucket", "node", of_print)
        parts.append(meet(shared))
        if fixed:
            dense = sizes.df.where((F.col("n") > bucket_rows) & F.col("t").isin(fixed)).withColumn("blocks", F.ceil(F.col("n") / bucket_rows))
            dealt = keyed.join(dense, ["t", "bucket"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            parts.append(meet(dealt.select("t", "bucket", "node", of_print, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")), "low", "high"))
        finer = [(t, tables[t][0], _signed((tables[t][1] | s) % (1 << BITS))) for t in large if t not in fixed for s in masks(free[t])]
        if not finer:
            break
        finer = sorted(set(finer))
        down = planned(spark, [[t, m, mask, k] for k, (t, m, mask) in enumerate(finer)], "t int, m int, mask long, finer int")
        split = sizes.df.where(F.col("n") > bucket_rows).select("t", "bucket")
        again = keyed.join(split, ["t", "bucket"]).join(F.broadcast(down), "t").join(reps.select("node", "prints"), "node")
        value = F.element_at("prints", F.col("m") + 1).bitwiseAND(F.col("mask"))
        keep = Stored(again.select("node", F.col("finer").alias("t"), value.alias("bucket")).distinct(), "simhash-similar-split")
        stored.append(keep)
        keyed, tables = keep.df, [(m, mask) for _, m, mask in finer]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out, stored


def similar_classes(docs: DataFrame, similarity: float, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, bucket_rows: int = 4096) -> DataFrame:
    """Rows (doc_id, text_hash, root), one for each of docs; the root is a node of the component. Texts without words are
    one node, which is similar to no other."""
    made = Stored(sketches(docs, id_column, text_column, shingle), "simhash-sketches")
    reps = Stored(made.df.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("size", "prints", "bits")]), "simhash-similar-reps")
    edges, stored = similar_links(reps.df.where("size > 0"), similarity, bucket_rows)
    roots, more = components(edges, "simhash-similar")
    of = Stored(roots, "simhash-similar-roots")
    for old in (*stored, *more, reps):
        old.drop()
    return made.df.select("doc_id", "text_hash", "node").join(of.df, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, bucket_rows: int = 4096, similarity: float | None = None) -> DataFrame:
    """One row of docs, unchanged, for each component: that of its smallest doc_id (null before others), then of the
    smallest text hash; of rows equal in both, any one. With a similarity, components are those of texts whose shingles
    are that similar, else those of fingerprints."""
    if similarity is None:
        found = classes(docs, id_column, text_column, shingle, bucket_rows)
    else:
        found = similar_classes(docs, similarity, id_column, text_column, shingle, bucket_rows)
    # By root: where an id is repeated with different texts, components may share their smallest id.
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    here, given, own = (free_name(docs, n) for n in ("kept_id", "kept_null", "kept_hash"))
    parts = lambda key: (F.coalesce(key, F.lit(0)), key.isNull())
    keep = Stored(best.select(*[c.alias(n) for c, n in zip(parts(F.col("kept.doc_id")), (here, given), strict=True)], F.col("kept.text_hash").alias(own)), "simhash-kept").df
    key, null = parts(named(id_column).cast("long"))
    hashed = docs.withColumns({here: key, given: null, own: F.xxhash64(F.coalesce(named(text_column), F.lit("")))})
    # Plain equality on the same columns: where the join moves rows, they are dealt for the last step too.
    once = hashed.join(keep, [here, given, own], "left_semi").dropDuplicates([here, given, own])
    return once.select(*[named(c) for c in docs.columns])
