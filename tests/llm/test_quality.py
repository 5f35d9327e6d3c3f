import random
import re

from skarn.llm import quality
from skarn.llm.quality import Document, Rule


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def test_measures_and_verdicts_match_the_definition(spark):
    rng = random.Random(1)
    bits = ["a", "Bb", "é", "#", "*", " ", " ", "\n", "\t", "🙂", "\x1c", "\x85", "word", "the cat sat", "!", "9"]
    texts = [None, "", " \n ", "a b c", "x " * 60, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 120))) for _ in range(300))]
    texts += [" ".join(rng.choice("abcdefg") + rng.choice("hijkl") * 3 for _ in range(rng.randint(40, 90))) for _ in range(60)]
    texts += [texts[-1].upper(), texts[-2] + " |" * 40, texts[-3] + "!" * 80, texts[-4] + " 0123456789" * 30, "q" * 1_000_000, "é " * 200_000]
    docs = spark.createDataFrame([(i if i != 9 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, body string, n_words int")
    out = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts[:-2]):
        r, d = out[i if i != 9 else None], Document((t or "").encode())
        n, _, _, _, repeated = expected = plain(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == expected, t
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert r.kept == (not r.base_failed and not any(rule.rejects(d) for rule in quality.RULES))
    n = len(texts)
    assert [out[i].rejected_by for i in (n - 6, n - 5, n - 4)] == ["many_capitals", "many_symbols", "many_exclamations"]
    assert out[n - 3].rejected_by in ("many_digits", "one_word_prevails")
    assert any(r.kept for r in out.values())
    assert quality.judge(docs.limit(0)).count() == 0


def test_rules_go_by_rejections_per_added_cost():
    short = lambda n: lambda d: len(d.body) < n
    rules = [
        Rule("dear", short(9), ("n_digits",)),
        Rule("shares_dear", short(9), ("n_digits",)),
        Rule("none", lambda d: False),
        Rule("dear_none", lambda d: False, ("n_capitals",)),
        Rule("cheap_few", short(2)),
        Rule("free", short(7)),
        Rule("last", lambda d: len(d.body) > 18, ("n_exclamations",)),
    ]
    sample = [b"x" * n for n in range(20)]
    order = [r.name for r in quality.order_rules(rules, sample)]
    # What "free" rejects is no merit of "cheap_few"; "shares_dear" adds no cost after "dear", and rejects no more.
    assert order == ["free", "last", "dear", "cheap_few", "none", "shares_dear", "dear_none"]
    assert {r.name for r in quality.order_rules(rules, [])} == {r.name for r in rules}
    assert [r.name for r in quality.order_rules(rules[::-1], sample[::-1])] == order


def test_rejecting_rule_is_the_same_in_every_run(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    of = lambda df: {r.doc_id: r.rejected_by for r in quality.judge(df).collect()}
    found = of(docs)
    assert found == of(docs.repartition(7))
    assert {"base", "many_symbols"} <= set(found.values())
    rejected = {rule.name: sum(rule.rejects(Document(t)) for t in quality.sample_of(docs)) for rule in quality.RULES}
    assert all(rejected[n] for n in ("many_symbols", "few_lettered_words", "one_word_prevails"))


def test_repeated_rows(spark):
    text = " ".join(f"wordy{i:d}" for i in range(10, 70))
    docs = spark.createDataFrame([(1, text)] * 3 + [(None, text), (1, None), (None, None), (None, None)], "doc_id long, text string")
    out = sorted(((str(r.doc_id), r.n_words, r.kept) for r in quality.judge(docs).collect()))
    assert out == sorted([("1", 60, True)] * 3 + [("None", 60, True), ("1", 0, False), ("None", 0, False), ("None", 0, False)])


def test_many_distinct_words_do_not_overflow():
    words = [b"%d" % i for i in range((1 << 20) + 5)]
    assert Document(b" ".join([*words, *words[:4]])).n_repeat_words == 8
