"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Only documents longer than a sequence are cut. The number of pieces of each length (at most ``capacity`` numbers) goes
to the driver, where best fit, longest first, runs over counts: a step places all pieces of a length that fit the
sequences with the least room left, as one range of ranks against one range of sequences. The plan has rows for ranges
only, a number that depends on the capacity and not on the documents. Each piece then takes its slot by its rank within
its length, through a merge join of (task, length) offsets and a search in the plan.

With an order of documents, the same slots are dealt anew: a sequence stands at its share of the sequences that its first
slot's length opened, sequences are numbered by that, and the pieces of a length, in the order of documents, take the
slots of that length in the order of sequences. So pieces that are near each other in the order share a sequence or are
in near ones; where lengths are spread unevenly over the order, the order holds within each length. Ranks are counted by ranges of the order, with no window over all rows.

Tokens come from a word cache: the tokenizer drops white space and works on each word by itself, so a text's ids are
those of its words one after the other. The cache is emptied at ``CACHE_WORDS`` words, which bounds memory.

Defined cases: a null text counts as empty; an empty text is a piece of length one, the end id; null and repeated
doc_ids are carried as they are; each of equal rows is packed; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import ranks
from .common import Stored, named, utf8

#: Units of a whole order: so many at least, and one for so many rows.
UNITS, UNIT_ROWS = 1024, 65_536
#: Multiples of it, taken modulo 1, are spread evenly.
GOLDEN = (5**0.5 - 1) / 2
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
CAPACITY, END_ID = 4096, 1
CACHE_WORDS = 600_000  # about 120 MB


class WordTokens:
    """ids of a text as little-endian unsigned 32-bit integers, word by word through a bounded cache.

    The tokenizer lower-cases, so ASCII letters are lower-cased before the search in the cache, except in a text that
    may hold a special token. Words of letters are tokenised many at once: the last token of a word is marked as such
    in the vocabulary. A mark of punctuation after a letter is a token of its own, so such a word is two words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> bytes:
        words = (text if b"<|" in text else text.lower()).split()
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > CACHE_WORDS:
            known.clear()
        missing = list({w for w in words if w not in known})
        for at in range(0, len(missing), 50_000):
            self._learn(missing[at : at + 50_000])
        return b"".join([known[w] for w in words])

    def _learn(self, missing: list[bytes]) -> None:
        known, plain, marked, other = self.words, {}, [], []
        for word in missing:
            text = word.decode("utf-8", "replace")
            if text.isalpha():
                plain[text] = word
            elif text[-1] in ".,!?;:" and text[:-1].isalpha():
                marked.append(word)
                if word[:-1] not in known:
                    plain[text[:-1]] = word[:-1]
            else:
                other.append(word)
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                data = ids.tobytes()
                stops = (4 * ends).tolist()
                known.update(zip(plain.values(), [data[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
            else:
                other += plain.values()
        other += {w[-1:] for w in marked if w[-1:] not in known}
        for word, found in zip(other, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False), strict=True):
            known[word] = array("I", found.ids).tobytes()
        for word in marked:
            known[word] = known[word[:-1]] + known[word[-1:]]


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One tokenizer and cache for each worker process."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts by length. Rows (length, first rank, how many, first sequence, offset):
    the pieces of ranks first .. first + how many - 1 go to consecutive sequences, all at the offset."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by tokens left: ranges of sequences
    having = 0  # bit r is set where room[r] has ranges
    out, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = having >> length
            if not fits:
                opened = -(-left // (capacity // length))
                room[capacity].append((sequences, opened))
                having |= 1 << capacity
                sequences += opened
                continue
            space = length + (fits & -fits).bit_length() - 1
            first, many = room[space].pop()
            taken = min(left, many)
            if many > taken:
                room[space].append((first + taken, many - taken))
            if not room[space]:
                having &= ~(1 << space)
            out.append((length, rank, taken, first, capacity - space))
            if space > length:
                room[space - length].append((first, taken))
                having |= 1 << (space - length)
            left, rank = left - taken, rank + taken
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Tokenised pieces (doc_id, piece, start, length, ids_crc32[, ids]) with their task, their rank within task and length,
    the document's number within the task, and the columns to carry along."""
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity
    read = docs.select(named(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("body"), *[c.alias(n) for n, c in (carry or {}).items()])
    more = read.schema.fields[2:]
    names = [*PIECE, "task", "task_rank", "doc", *[f.name for f in more], *["ids"] * keep_ids]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 6, *[to_arrow_type(f.dataType) for f in more], *[pa.binary()] * keep_ids]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        task, number = TaskContext.get().partitionId(), 0
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, body, *others in zip(*batch.columns, strict=True):
                ids, doc_id, carried = tokens.ids(body.as_py()) + end, doc.as_py(), [c.as_py() for c in others]
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    length = len(part) // 4
                    values = (doc_id, piece, at // 4, length, zlib.crc32(part), task, seen[length], number, *carried)
                    for column, value in zip(rows, (*values, part) if keep_ids else values, strict=True):
                        column.append(value)
                    seen[length] += 1
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, task_rank long, doc long"
    return read.mapInArrow(scan, schema + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more) + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False, carry: Mapping[str, Column] | None = None, order: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), with keep_ids also the ids' bytes.

    Sequences follow ``order``, where it is given: of rows (task, doc, and the columns to carry), one for each document, it
    makes rows (task, doc, place) with places 0, 1, ... So an order is found without moving texts."""
    cut = Stored(pieces(docs, tokenizer, capacity, end_id, id_column, text_column, keep_ids, carry), "packing-pieces").df
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))  # two columns of the stored table, read twice
    totals = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most capacity rows
    steps = np.array(plan({r["length"]: r["n"] for r in totals}, capacity), dtype=np.int64).reshape(-1, 5)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_task.select("length", "task", before.alias("before"))
    out = [*PIECE, *["ids"] * keep_ids]
    kept = [*out, *(["task", "doc", *(carry or {})] if order else [])]
    # Offsets grow with the tasks: a merge join, whatever their size looks like as files.
    ranked = cut.join(offsets.hint("merge"), ["length", "task"]).select(*kept, (F.col("before") + F.col("task_rank")).alias("rank"))
    keys = (steps[:, 0] << 44) + steps[:, 1]
    sorted_by = np.argsort(keys)
    keys, steps = keys[sorted_by], steps[sorted_by]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            step = steps[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            slots = [pa.array(step[:, 3] + rank - step[:, 1]), pa.array(step[:, 4])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *slots], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    found = ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
    if not order:
        return found
    opened = steps[steps[:, 4] == 0]  # a step for each length that opens sequences
    found = Stored(found, "packing-found").df
    places = order(found.where("piece = 0").select("task", "doc", *(carry or {}))).select("task", "doc", "place")
    return _in_order(found, Stored(places, "packing-places").df, opened[np.argsort(opened[:, 3])], out)


def _in_order(found: DataFrame, places: DataFrame, opened: np.ndarray, out: list[str]) -> DataFrame:
    """The pieces and slots of ``found``, dealt anew by the documents' places. opened: the plan's steps at offset 0, by first
    sequence."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence = batch.column(0).to_numpy()
            step = opened[np.searchsorted(opened[:, 3], sequence, side="right") - 1]
            within = step[:, 0] * GOLDEN % 1  # another place for each length, as many lengths open one sequence only
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((sequence - step[:, 3] + within) / step[:, 2])], names=["sequence_id", "share"])

    sequences, documents = int(opened[:, 2].sum()), places.count()
    units = lambda n: max(1, -(-n // max(UNITS, n // UNIT_ROWS)))
    begun = found.where("offset = 0").select("sequence_id").mapInArrow(shares, "sequence_id long, share double").withColumn("all", F.lit(0))
    numbered = Stored(ranks.placed_in(begun, ["all"], (F.col("share") * max(UNITS, sequences // UNIT_ROWS)).cast("long"), ["share", "sequence_id"], "number").select("sequence_id", "number"), "packing-numbers").df
    slots = found.select("length", "sequence_id", "offset").join(numbered.hint("merge"), "sequence_id").drop("sequence_id")
    slots = ranks.placed_in(slots, ["length"], F.expr(f"number div {units(sequences)}"), ["number", "offset"], "rank")
    placed = found.select(*out, "task", "doc").join(places.hint("merge"), ["task", "doc"])
    taken = ranks.placed_in(placed, ["length"], F.expr(f"place div {units(documents)}"), ["place", "piece"], "rank")
    return taken.join(slots.hint("merge"), ["length", "rank"]).select(*out, F.col("number").alias("sequence_id"), "offset")
