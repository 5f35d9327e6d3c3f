"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Every document gets the base measures. Documents that pass the base rules meet the other rules one by one and stop at
the first that rejects them. The order is planned on a sample of documents that pass the base rules, greedily: the next
rule is that with the most rejections per cost among the sampled documents that no earlier rule rejects, then the cheaper
one, then by name. Costs are those that a rule adds: a measure that the base rules or an earlier rule of the cascade
makes anyway costs nothing more. They are counted in bytes that are gone over, not timed, so that a plan, and with it which
rule is named as the one that rejects, is the same in every run. The order changes what is computed, never the verdict.

The sample has at most ``sample_rows`` documents of at most ``sample_bytes`` each, those with the least hashes of id and
text among about twice as many below a bound, and is the only thing that reaches the driver.

Defined cases: a null text has no words and fails the base rules, as does an empty one; null and repeated ids and rows are
carried; texts may be of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, utf8

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS, SAMPLE_BYTES = 512, 1 << 16
#: A word with a letter: of ASCII, or any character beyond it.
LETTERED = re.compile(rb"[^\x09-\x0D\x20]*[A-Za-z\x80-\xff][^\x09-\x0D\x20]*")


class Document:
    """A text and what rules ask of it, each measure made once and only if asked for."""

    def __init__(self, body: bytes):
        self.body = body

    @cached_property
    def words(self) -> list[bytes]:
        return self.body.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def points(self) -> np.ndarray:
        """The text's code points."""
        return np.frombuffer(self.body.decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype="<u4")

    @cached_property
    def word_chars(self) -> int:
        continued = int(np.count_nonzero(np.frombuffer(self.body, dtype=np.uint8) & 0xC0 == 0x80))
        return len(self.body) - continued - sum(map(self.body.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.body.count(s.encode()) for s in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [line for line in self.body.split(b"\n") if line and not line.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that occur twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        number = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        if len(number) == n:
            return 0
        ids = np.fromiter(map(number.__getitem__, self.words), dtype=np.int64, count=n)
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) >= 1 << 20:  # three numbers would not fit 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[which] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        return int(covered.sum())

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


    @cached_property
    def n_capitals(self) -> int:
        """Capitals: A-Z and those of Latin-1."""
        p = self.points
        return int(np.count_nonzero((p >= 0x41) & (p <= 0x5A) | (p >= 0xC0) & (p <= 0xDE) & (p != 0xD7)))

    @cached_property
    def n_digits(self) -> int:
        return sum(self.body.count(bytes([c])) for c in b"0123456789")

    @cached_property
    def n_exclamations(self) -> int:
        return self.body.count(b"!")

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter."""
        return sum(1 for _ in LETTERED.finditer(self.body))

    @cached_property
    def n_prevailing(self) -> int:
        """How often the most frequent word occurs."""
        return max(Counter(self.words).values(), default=0)


#: Measures of every document.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: How often the other measures go over a text.
PASSES = {"n_capitals": 8, "n_digits": 10, "n_exclamations": 1, "n_lettered": 3, "n_prevailing": 2}


@dataclass(frozen=True)
class Rule:
    """measures: those beyond BASE that ``rejects`` asks for."""

    name: str
    rejects: Callable[[Document], bool]
    measures: tuple[str, ...] = ()


def many_symbols(d: Document) -> bool:
    return 10 * d.n_symbols > d.n_words


def many_capitals(d: Document) -> bool:
    """Capitals are over 40 % of the characters in words."""
    return 10 * d.n_capitals > 4 * d.word_chars


def many_exclamations(d: Document) -> bool:
    return 10 * d.n_exclamations > 3 * d.n_words


def many_digits(d: Document) -> bool:
    return 10 * d.n_digits > 3 * d.word_chars


def many_equal_lines(d: Document) -> bool:
    return 10 * d.n_dup_lines > 4 * len(d.lines)


def odd_word_lengths(d: Document) -> bool:
    """Words have less than 2 or more than 15 characters on average."""
    return not 2 * d.n_words <= d.word_chars <= 15 * d.n_words


def few_lettered_words(d: Document) -> bool:
    """Less than 80 % of the words have a letter."""
    return 10 * d.n_lettered < 8 * d.n_words


def one_word_prevails(d: Document) -> bool:
    """One word is over a fourth of all words."""
    return 4 * d.n_prevailing > d.n_words


RULES = (
    Rule("many_symbols", many_symbols),
    Rule("many_capitals", many_capitals, ("n_capitals",)),
    Rule("many_exclamations", many_exclamations, ("n_exclamations",)),
    Rule("many_digits", many_digits, ("n_digits",)),
    Rule("many_equal_lines", many_equal_lines),
    Rule("odd_word_lengths", odd_word_lengths),
    Rule("few_lettered_words", few_lettered_words, ("n_lettered",)),
    Rule("one_word_prevails", one_word_prevails, ("n_prevailing",)),
)


def order_rules(rules: Sequence[Rule], sample: Sequence[bytes]) -> list[Rule]:
    """The rules by rejections per added cost, each among the documents that the rules before it let pass."""
    left, made, rest, out = [Document(body) for body in sample], set(), list(rules), []
    said = {(rule.name, k): rule.rejects(d) for rule in rules for k, d in enumerate(left)}
    open_ = range(len(left))
    while rest:

        def rank(rule: Rule) -> tuple:
            passes = sum(PASSES.get(m, 1) for m in set(rule.measures) - made)
            cost = sum(1 + passes * len(left[k].body) for k in open_)
            return -sum(said[rule.name, k] for k in open_) / max(cost, 1), cost, passes, rule.name

        best = min(rest, key=rank)
        rest.remove(best)
        out.append(best)
        made |= set(best.measures)
        open_ = [k for k in open_ if not said[best.name, k]]
    return out


def sample_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[bytes]:
    """Texts that pass the base rules, of a bounded sample."""
    order = F.xxhash64(named(id_column), named(text_column))
    share = 2 * rows / max(1, docs.count())
    some = docs.select(utf8(text_column).alias("body"), order.alias("h")).where(F.octet_length("body") <= size)
    some = some.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else some
    taken = [bytes(r["body"]) for r in some.orderBy("h", "body").limit(rows).collect()]
    return [body for body in taken if not Document(body).base_failed]


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) for
    each of docs. rejected_by: "base", or the first rule in the planned order that rejects; null if kept."""
    order = order_rules(rules, sample_of(docs, id_column, text_column, sample_rows, sample_bytes))
    names = list(BASE)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(1):
                d = Document(body.as_py())
                failed = d.base_failed
                by = "base" if failed else next((rule.name for rule in order if rule.rejects(d)), None)
                rows.append((*[getattr(d, n) for n in names], failed, by is None, by))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names, "base_failed", "kept", "rejected_by"])

    read = docs.select(named(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("body"))
    return read.mapInArrow(scan, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, rejected_by string")


#: What the query returns, as DuckDB SQL.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), g AS (
  SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), t AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) > 1 AND c IS NOT NULL AS twice FROM g
), p AS (
  SELECT r, count(*) AS n_repeat_words FROM (
    SELECT r, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered FROM t WINDOW o AS (PARTITION BY r ORDER BY i)
  ) WHERE covered GROUP BY r
), v AS (
  SELECT r, max(n) AS n_prevailing FROM (SELECT r, word, count(*) AS n FROM w GROUP BY r, word) GROUP BY r
), m AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_prevailing, 0) AS n_prevailing, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered
  FROM d LEFT JOIN p USING (r) LEFT JOIN v USING (r)
), j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words
    OR 10 * (length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g'))) > 4 * word_chars
    OR 10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words
    OR 10 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) > 3 * word_chars
    OR 10 * n_dup_lines > 4 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * n_lettered < 8 * n_words OR 4 * n_prevailing > n_words) AS kept
FROM j
"""
