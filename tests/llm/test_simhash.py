import random
import re

import numpy as np
import pytest
import xxhash

from skarn.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, fingerprint)"""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def test_masks_cover_every_pair_within_the_radius():
    signs = np.array(simhash.masks(list(range(64))), dtype=np.int64).view(np.uint64)
    for a in range(64):
        for b in range(a, 64):
            for c in range(b, 64):
                differ = np.uint64(1 << a | 1 << b | 1 << c)
                assert ((signs & differ) == 0).any()
    assert all(30 <= int(m).bit_count() <= 36 for m in signs)


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "one two", "ONE two three", "É é É", "a\x0bb\x0cc\x1cd", *(" ".join(rng.choice(["a", "Bb", "ñ", "z.", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, root long")


@pytest.mark.parametrize("bucket_rows", [4096, 4])
def test_classes_match_brute_force(spark, bucket_rows):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("klm") for _ in range(80)) for _ in range(12)]
    rows = [(i, base[rng.randrange(12)]) for i in range(60)]
    rows += [(100 + i, re.sub(r"^(\S+ ){%d}" % (i % 9), "", base[i % 3])) for i in range(90)]
    rows += [(300, None), (301, ""), (302, "word"), (None, "word"), (None, base[0]), (None, "only here without an id"), (100, base[1]), (5, rows[5][1]), (400, "x " * 30000)]
    found = simhash.classes(documents(spark, [(*r, "clash", 1) for r in rows]), bucket_rows=bucket_rows).collect()
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    expected = sorted(((d, p - (1 << 64) if p >> 63 else p, c) for (d, p), c in zip(prints, plain_components(prints), strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in found), key=str) == expected


def test_dense_buckets_are_split_and_keep_every_link(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    near = {centre}
    for _ in range(3000):
        near.add(rng.choice(list(near)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))) if len(near) < 400 else None
    values = sorted(near | {rng.getrandbits(64) for _ in range(50)})
    reps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges, _ = simhash.links(reps, bucket_rows=8)
    roots, _ = simhash.components(edges)
    root = {r.node: r.root for r in roots.collect()}
    groups, expected = {}, {}
    for v, c in zip(values, plain_components([(i, v) for i, v in enumerate(values)]), strict=True):
        s = v - (1 << 64) if v >> 63 else v
        groups.setdefault(root.get(s, s), set()).add(s)
        expected.setdefault(c, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_deduplicate_keeps_one_row_of_each_class(spark):
    rows = [(1, "one two three four", "x", 0), (2, "one two three four", "y", 0), (1, "one two three four", "z", 0), (3, "another text entirely here", "x", 0), (None, "no id at all", "x", 0), (4, None, "x", 0), (5, "", "x", 0)]
    kept = simhash.deduplicate(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("1", "one two three four"), ("3", "another text entirely here"), ("None", "no id at all")]
    assert len(kept) == 4
    assert simhash.deduplicate(documents(spark, [])).count() == 0
    assert simhash.classes(documents(spark, [])).count() == 0


def test_components_with_one_smallest_id_all_keep_a_row(spark):
    rng = random.Random(4)
    x, y = (" ".join(rng.choice("abcdefghij") + rng.choice("klm") for _ in range(80)) for _ in range(2))
    rows = [(5, x, "x", 0), (5, y, "y", 0), (9, y, "z", 0), (5, "one more", "w", 0), (None, "first", "u", 0), (None, "first", "u", 0), (None, "second", "v", 0)]
    kept = simhash.deduplicate(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", x), ("5", y), ("5", "one more"), ("None", "first"), ("None", "second")])


def test_few_free_positions_end(spark):
    for bits in (3, 4, 5, 7, 9):
        reps = spark.createDataFrame([(v,) for v in range(1 << bits)], "fp long")
        edges, _ = simhash.links(reps, bucket_rows=2)
        roots, _ = simhash.components(edges)
        assert len({r.root for r in roots.collect()}) == 1 and roots.count() == 1 << bits
    far = spark.createDataFrame([(v << 8 | v << 16 | v << 24 | v << 32,) for v in range(1 << 4)], "fp long")
    assert simhash.components(simhash.links(far, bucket_rows=2)[0])[0].count() == 0


def test_columns_with_names_of_ours_come_back(spark):
    rows = [(1, "one two three four", 99, 98, 97, 96), (2, "one two three four", 5, 6, 7, 8), (None, None, 1, 2, 3, 4), (None, None, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_hash long, kept_id long, kept_hash long, kept_null long")
    assert sorted(map(tuple, simhash.deduplicate(docs).collect()), key=str) == [rows[0], rows[2]]


def test_forest_spans():
    values = np.array([0, 1, 3, 7, 1 << 40, (1 << 40) + 1, 0xFF << 50], dtype=np.int64)
    a, b = simhash.forest(values)
    assert len(a) == 5
    assert all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b, strict=True))


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_shingles(text):
    words = plain_words(text)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_majority(things, words):
    out = []
    for k in range(1, words + 1):
        votes = [0] * 64
        for thing in things:
            z = (xxhash.xxh64_intdigest(thing.encode(), seed=42) + k * 0x9E3779B97F4A7C15) % (1 << 64)
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
            z ^= z >> 31
            votes = [v + (z >> b & 1) for b, v in enumerate(votes)]
        out.append(sum(1 << b for b, v in enumerate(votes) if 2 * v > len(things)))
    return out


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / max(1, len(a | b))


def plain_similar_components(texts, similarity=0.8):
    """The smallest index of the texts that links of sketches reach; links need a fingerprint of words within 3 bits."""
    made = [simhash.sketch((t or "").encode()) for t in texts]
    prints = np.array([m[2] for m in made], dtype=np.uint64).reshape(len(made), -1)
    bits = np.array([np.frombuffer(m[3], dtype="<u8") for m in made])
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            near = (np.bitwise_count(prints[i] ^ prints[j]) <= 3).any()
            same = made[i][0] == made[j][0]
            differ = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            shared = np.cos(np.pi * differ / 1024) * (made[i][1] * made[j][1]) ** 0.5
            if same or near and made[i][1] and made[j][1] and shared >= similarity * (made[i][1] + made[j][1] - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(rng, text, share):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = rng.choice("uvwxyz") * rng.randint(2, 5)
    return " ".join(words)


def families(rng, count, copies, share):
    prose = lambda: " ".join(rng.choice("abcdefghij") + rng.choice("klmnopq") + rng.choice("rst") for _ in range(rng.randint(90, 260)))
    texts = []
    for _ in range(count):
        base = prose()
        texts += [base, *(edited(rng, base, rng.random() * share) for _ in range(copies))]
    return texts


def test_sketches_match_the_definition():
    rng = random.Random(21)
    texts = [" \t", "One", "one two THREE four", "a b c d e", "x " * 700, "É é Ö", *families(rng, 2, 1, 0.05)]
    for text in texts:
        words, grams = plain_words(text), plain_shingles(text)
        node, size, prints, bits = simhash.sketch(text.encode())
        assert size == len(grams)
        if not words:
            assert (node, *prints, *bits) == (0,) * 137
            continue
        assert node % (1 << 64) == xxhash.xxh64_intdigest(" ".join(words).encode(), seed=42)
        assert list(prints) == plain_majority(set(words), 8)
        assert list(np.frombuffer(bits, dtype="<u8")) == plain_majority(grams, 16)


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_similar_classes_match_brute_force(spark, bucket_rows):
    rng = random.Random(22)
    texts = families(rng, 12, 6, 0.06) + ["", None, " \n", "word", "Word ", "two words", "same same", "same same same", *["a b c d e f g"] * 3]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    found = simhash.similar_classes(documents(spark, rows), 0.8, bucket_rows=bucket_rows).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))
    groups, expected = {}, {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.doc_id)
    for i, c in enumerate(plain_similar_components(texts)):
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert max(map(len, groups.values())) > 3
    assert simhash.similar_classes(documents(spark, []), 0.8).count() == 0


def test_blocks_keep_every_link_of_a_bucket_that_masks_cannot_split(spark):
    """Texts with the same words have the same fingerprints of words, in whatever order the words stand."""
    rng = random.Random(23)
    words = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    texts = []
    for _ in range(6):
        rng.shuffle(words)
        texts += [" ".join(words), " ".join(words[1:] + words[:1]), " ".join(words[2:] + words[:2])]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    kept = simhash.deduplicate(documents(spark, rows), shingle=5, similarity=0.8, bucket_rows=4).collect()
    assert sorted(r.doc_id for r in kept) == [0, 3, 6, 9, 12, 15]


def test_similar_texts_go_and_others_stay(spark):
    rng = random.Random(24)
    bases = families(rng, 60, 0, 0)
    near, far = [], []
    for i, base in enumerate(bases):
        words = base.split()
        while jaccard(base, " ".join(words)) > 0.88:
            words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words)) if i % 2 else far.append(edited(rng, " ".join(words), 0.12))
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(bases[1::2], near, strict=True))
    assert all(jaccard(a, b) < 0.6 for a, b in zip(bases[::2], far, strict=True))
    rows = [(i, t, "x", 0) for i, t in enumerate(bases + near + far)]
    kept = {r.doc_id for r in simhash.deduplicate(documents(spark, rows), shingle=5, similarity=0.8).collect()}
    assert kept >= {*range(60), *range(90, 120)}
    assert len(kept & set(range(60, 90))) <= 1
