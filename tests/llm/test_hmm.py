import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from skarn.llm import hmm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def toy(rng, states=3, classes=5):
    d = lambda *n: rng.dirichlet(np.ones(n[-1]), n[:-1])
    return hmm.Model(d(states), d(states), d(states, states), d(states, classes).T)


def paths(model, start, seq):
    """Every state path of a sequence with its probability."""
    for path in itertools.product(range(len(start)), repeat=len(seq)):
        p = start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, c in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[c, b]
        yield path, p


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(1)
    model = toy(rng)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 5, 5, 7, 1, 3)]
    expected = [math.log10(sum(p for _, p in paths(model, model.start, s))) for s in seqs]
    assert np.allclose(hmm.log10_likelihoods(model, seqs), expected, atol=1e-12)
    long = rng.integers(0, 5, 30_000).astype(np.uint16)
    assert -1e6 < hmm.log10_likelihoods(model, [long])[0] < -1e3


def test_expected_counts_are_exact(monkeypatch):
    monkeypatch.setattr(hmm, "WINDOW", 5)
    rng = np.random.default_rng(2)
    model = toy(rng)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 5, 8, 11)]
    seen = hmm.Expected.none(3, 5)
    seen.add(model, seqs)
    plain = hmm.Expected.none(3, 5)
    for seq in seqs:
        for at in range(0, len(seq), 5):
            part, start = seq[at : at + 5], model.inside if at else model.start
            whole = sum(p for _, p in paths(model, start, part))
            for path, p in paths(model, start, part):
                (plain.inside if at else plain.start)[path[0]] += p / whole
                for a, b in zip(path, path[1:]):
                    plain.move[a, b] += p / whole
                for s, c in zip(path, part):
                    plain.emit[c, s] += p / whole
    for name in ("start", "inside", "move", "emit"):
        assert np.allclose(getattr(seen, name), getattr(plain, name)), name


def test_passes_raise_the_likelihood():
    rng = np.random.default_rng(3)
    true = toy(rng, 2, 6)
    counts = hmm.Counts(1000, 6, 6, np.array([100] * 6 + [0] * 4), np.array([1] * 6 + [0] * 4))
    seqs = []
    for _ in range(40):
        s, out = rng.choice(2, p=true.start), []
        for _ in range(60):
            out.append(rng.choice(6, p=true.emit[:, s]))
            s = rng.choice(2, p=true.move[s])
        seqs.append(np.array(out, dtype=np.uint16))
    model, last = hmm.first_model([], counts, 2), -np.inf
    model = hmm.Model(model.start, model.inside, model.move, model.emit * rng.uniform(0.5, 1.5, model.emit.shape))
    model = hmm.Model(model.start, model.inside, model.move, model.emit / model.emit.sum(axis=0))
    for _ in range(6):
        now = hmm.log10_likelihoods(model, seqs).sum()
        assert now >= last - 1e-6
        last = now
        seen = hmm.Expected.none(2, len(counts.by_class))
        seen.add(model, seqs)
        assert abs(seen.likelihood / math.log(10) - now) < 1e-6
        model = hmm.renewed(seen, counts, 0.0)


@pytest.mark.parametrize("own_factor", [hmm.OWN, 0.3])
def test_scores(spark, sf_dir, own_factor):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, "The the"), (7, None), (7, ""), (9, "UNSEENWORD É"), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, tokens string, held_out boolean").repartition(3)
    out = hmm.score(docs, own_factor=own_factor, chunk_bytes=100_000).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    expected = Counter()
    for i, text in rows:
        ts = tokens(text)
        expected[(i, held(i), len(ts), sum(count[t] > 0 for t in ts), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expected
    away = [r for r in out if r.held_out]
    assert sum(r.score for r in away) > sum(r.base_score for r in away)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_scores_match_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"{'abcdefghij'[int(w)]}{'' if w % 1 < 0.9 else int(1e4 * (w % 1))}" for w in rng.normal(5, 2, rng.integers(1, 30)).clip(0, 9.99))) for i in range(80)] + [(200, None), (201, "unknownword A"), (202, "a " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stored, counts = hmm.sequences(docs, own_factor=1.0, chunk_bytes=500)
    model, history = hmm.train(stored, counts, states=3)
    found = {r.doc_id: r for r in hmm.scores(stored, counts, model).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter("" if t is None else t for i, text in rows if not held(i) for t in tokens(text))
    v = len(count)
    order = sorted(count, key=lambda t: (np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64), t.encode()))
    least = next((n for n in sorted(set(count.values())) if sum(c >= n for c in count.values()) <= math.ceil(math.sqrt(v))), 1 << 62)
    own = {t: k for k, t in enumerate(t for t in order if count[t] >= least)}
    rare = math.ceil(hmm.RARE * math.sqrt(v))
    assert (counts.tokens, counts.distinct, counts.own, len(counts.by_class)) == (sum(count.values()), v, len(own), len(own) + rare)
    klass = lambda t: own.get(t, len(own) + zlib.crc32(t.encode()[-2:]) % rare)
    mass, kinds = Counter(), Counter()
    for t, n in count.items():
        mass[klass(t)] += n
        kinds[klass(t)] += 1
    for i, text in rows:
        ts = ["" if t is None else t for t in tokens(text)]
        ahead, total = list(model.start), 0.0
        for t in ts:
            now = [a * e for a, e in zip(ahead, model.emit[klass(t)], strict=True)]
            total += math.log10(sum(now)) + (0 if t in own else math.log10((count[t] + 1) / (mass[klass(t)] + kinds[klass(t)] + 1)))
            ahead = [sum(now[a] * model.move[a, b] for a in range(3)) / sum(now) for b in range(3)]
        assert abs(found[i].score - total) < 1e-7 * max(1, len(ts)), i
    assert all(b > a - 1e-9 for a, b in zip(history, history[1:])) and len(history) <= hmm.MAX_PASSES


def test_own_classes_grow_with_the_vocabulary():
    assert hmm.least_own([(9, 1), (5, 2), (1, 10)], 3) == (5, 3) and hmm.least_own([(9, 1), (5, 2), (1, 10)], 12) == (5, 3)
    assert hmm.least_own([(9, 1), (5, 2), (1, 10)], 13) == (1, 13) and hmm.least_own([(1, 10)], 3)[1] == 0 and hmm.least_own([], 3)[1] == 0


def test_packing_of_numbers():
    numbers = np.array([0, 1, 255, 256, 70_000, (1 << 32) - 1], dtype=np.int64)
    assert hmm.unpacked(hmm.packed(numbers)).tolist() == numbers.tolist() and hmm.unpacked(hmm.packed(numbers[:0])).tolist() == []


def test_class_model_sums_to_one(spark):
    docs = spark.createDataFrame([(i, f"a b{i} c{i % 3}x") for i in range(40)], "doc_id long, text string")
    _, counts = hmm.sequences(docs, own_factor=0.8)
    model = hmm.renewed(hmm.Expected.none(2, len(counts.by_class)), counts)
    assert np.allclose(model.emit.sum(axis=0), 1) and counts.own == 5
    assert counts.by_class.sum() == counts.tokens and counts.distinct_by_class.sum() == counts.distinct
    assert hmm.score(docs.limit(0)).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    only = hmm.score(spark.createDataFrame([(i, "x y") for i in held], "doc_id long, text string")).collect()
    assert len(only) == len(held) and all(r.train_tokens == 0 and math.isfinite(r.score) for r in only)
