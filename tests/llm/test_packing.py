import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skarn.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_slots(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        best = min((i for i, r in enumerate(room) if r >= n), key=lambda i: room[i], default=None)
        if best is None:
            room.append(capacity - n)
        else:
            room[best] -= n
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_as_many_sequences_as_best_fit_over_pieces(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 50), rng.randint(1, 12), 17, 50]) for _ in range(rng.randint(0, 900)))
    steps = packing.plan(counts, 50)
    assert sum(s[2] for s in steps) == sum(counts.values())
    used = {s[3] + i for s in steps for i in range(s[2])}
    assert len(used) == best_fit(list(counts.elements()), 50)
    ranks = defaultdict(list)
    for length, first, many, _, _ in steps:
        ranks[length] += range(first, first + many)
    assert all(sorted(v) == list(range(counts[k])) for k, v in ranks.items())


def test_ids_are_those_of_whole_texts():
    rng = random.Random(3)
    alphabet = ["the", "Onnt.", "ÉÀ", "don't", "12'll3", " ", "\n", "\t", " ", " ", "\x1c", "é", "́", "<|endoftext|>", "x<|startoftext|>y", "漢字", "🙂", "--", "ſ", "İ", "ΑΣ", "Straße", "ŉ", "ª", "K", "don't.", "a.", "b!", "ñandú,", "...", "x?!", "I'LL", "<|ENDOFTEXT|>", "가", "e\u0301,"]
    texts = ["", " ", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(300))]
    whole, words = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    for text in texts:
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pack(spark):
    rng = random.Random(4)
    texts = [None, "", "one", *("word " * rng.choice([5, 5, 7, 30, 200]) for _ in range(150)), "long text " * 300]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], 1, 2), (None, "no id", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, task int").repartition(4)
    out = packing.pack(docs, PATH, capacity=64, keep_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], dtype="<u4").tobytes()
            expected[(doc_id, piece, at, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out) == expected
    assert check_slots(out, 64) == best_fit([r.length for r in out], 64)
    assert packing.pack(docs.limit(0), PATH).count() == 0
