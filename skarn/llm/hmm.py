"""A hidden Markov language model, trained by Baum-Welch over all training documents and scored by the forward recursion.

A token is a word or the end of a text. Hidden states emit classes, and a class emits the token: frequent training tokens
are classes of their own, the others fall into classes by the hash of their last two bytes and share a class's mass by
add-one counts, with one share for tokens that are not known. With V distinct training tokens there are OWN * sqrt(V) own
classes at most (all tokens from a count on, so that tokens with equal counts are treated alike) and RARE * sqrt(V)
shared ones: what the states learn grows with the corpus, and fits a driver for any. So

    P(text) = sum over state paths of product(move * emit(class)) * product of P(token | class),

and the last factor needs exact counts of any token but no state. Counting, the join of tokens with their counts, and all
passes are distributed:

1. Documents are numbered chunk by chunk: a chunk holds its own vocabulary and its texts as numbers in it.
2. Vocabularies are counted by token and joined back to the chunks, which turns each text into a sequence of classes
   with its base score; these sequences are stored.
3. Each Baum-Welch pass maps the stored sequences to expected counts and their likelihood, summed by class as fixed-point
   integers (so that the order of partitions cannot change them), and the driver renews the tables.
4. The scaled forward recursion over each whole text gives its exact likelihood.

In training, texts are cut into windows of WINDOW tokens, with a start distribution of their own for windows inside a
text; every token of every training document is counted in every pass. Passes begin from a model of about INIT_TOKENS
tokens in windows drawn by hash from all training texts, and end when a pass has raised the mean log-likelihood of a
token by less than GAIN, or after MAX_PASSES.

Defined cases: a null text counts as empty, whose one token is the end; a null id is in the training part; repeated rows
each count; without training documents every count is zero; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks
from .common import Stored, named, utf8

STATES, OWN, RARE, WINDOW = 8, 24.0, 2.0, 256
MAX_PASSES, GAIN = 6, 0.01
CHUNK_BYTES, CELLS = 8 << 20, 4 << 20
INIT_TOKENS, INIT_PASSES, SEED = 200_000, 12, 0
FIXED = 1 << 16
END = b""
LISTS = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "rest_score"]


def packed(numbers: np.ndarray) -> bytes:
    """Compressed 32-bit integers, all lowest bytes first, as high bytes are alike."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = value = len(self)
        return value


class _Chunk:
    def __init__(self) -> None:
        self.number, self.texts, self.doc_id, self.held, self.size = _Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, held: bool, body: bytes) -> None:
        words = body.lower().split()
        words.append(END)
        self.texts.append(np.array(list(map(self.number.__getitem__, words)), dtype="<i4"))
        self.doc_id.append(doc_id)
        self.held.append(held)
        self.size += len(body) + 1

    def row(self, chunk: int) -> pa.RecordBatch:
        every = np.concatenate(self.texts)
        sizes = np.array([len(t) for t in self.texts], dtype=np.int32)
        train = np.repeat(~np.array(self.held), sizes)
        counts = np.bincount(every[train], minlength=len(self.number))
        values = [chunk, self.doc_id, self.held, sizes, packed(every), list(self.number), counts]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["chunk", "doc_id", "held_out", "n_tokens", "places", "tokens", "counts"])


def chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of about chunk_bytes of text: ids, whether held out, numbers of tokens, the tokens' places in the chunk's
    vocabulary (compressed 32-bit integers), the vocabulary, and its counts in training documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            for doc_id, held, body in zip(*batch.columns, strict=True):
                chunk.add(doc_id.as_py(), held.as_py(), body.as_py())
                if chunk.size >= chunk_bytes:
                    yield chunk.row((task << 32) + serial)
                    serial, chunk = serial + 1, _Chunk()
        if chunk.texts:
            yield chunk.row((task << 32) + serial)

    key = F.coalesce(named(id_column).cast("string"), F.lit(""))
    read = docs.select(named(id_column).cast("long").alias("doc_id"), (F.crc32(key.cast("binary")) % 7 == 2).alias("held_out"), utf8(text_column).alias("body"))
    return read.mapInArrow(scan, "chunk long, doc_id array<long>, held_out array<boolean>, n_tokens array<int>, places binary, tokens array<binary>, counts array<long>")


@dataclass(frozen=True)
class Counts:
    """What training counted: tokens, distinct tokens, and by class all tokens and distinct ones. own: classes of one token,
    which come first."""

    tokens: int
    distinct: int
    own: int
    by_class: np.ndarray
    distinct_by_class: np.ndarray


def least_own(histogram: list[tuple[int, int]], most: int) -> tuple[int, int]:
    """The least count from which tokens have own classes, and how many these are: ``most`` at most. histogram: (count,
    tokens with it)."""
    total, least = 0, 1 << 62
    for n, many in sorted(histogram, reverse=True):
        if total + many > most:
            break
        total, least = total + many, n
    return least, total


def sequences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES, own_factor: float = OWN) -> tuple[DataFrame, Counts]:
    """Stored rows of texts as classes, with base scores: a row for each chunk, LISTS and the compressed classes."""
    cut = Stored(chunks(docs, id_column, text_column, chunk_bytes), "hmm-chunks")
    listed = cut.df.select("chunk", F.posexplode(F.arrays_zip("tokens", "counts")).alias("place", "t")).select("chunk", "place", "t.tokens", "t.counts")
    count = Stored(listed.groupBy("tokens").agg(F.sum("counts").alias("n")), "hmm-counts")
    known = count.df.where("n > 0")
    histogram = [(r["n"], r["v"]) for r in known.groupBy("n").agg(F.count("*").alias("v")).collect()]  # different counts: about the root of the tokens at most
    tokens, distinct_tokens = sum(n * v for n, v in histogram), sum(v for _, v in histogram)
    least, own = least_own(histogram, math.ceil(own_factor * math.sqrt(distinct_tokens)))
    rare = max(1, math.ceil(RARE * math.sqrt(distinct_tokens)))
    rare_class = F.pmod(F.crc32(F.substring("tokens", -2, 2)), F.lit(rare)).cast("int") + own
    first = known.where(F.col("n") >= least)
    numbered = first.select("tokens", "n", F.lit(0).alias("all"), F.xxhash64("tokens").alias("h"))
    frequent = Stored(ranks.placed_in(numbered, ["all"], ranks.unit_of(F.col("h"), 10), ["h", "tokens"], "own").select("tokens", "n", F.col("own").cast("int").alias("own")), "hmm-frequent")  # own rows
    classed = Stored(count.df.join(F.broadcast(frequent.df.drop("n")), "tokens", "left").select("tokens", "n", F.coalesce("own", rare_class).alias("class")), "hmm-classes")
    by_class = np.zeros(own + rare, dtype=np.int64)
    distinct = np.zeros(own + rare, dtype=np.int64)
    order = frequent.df.select("own", "n").toArrow()
    by_class[order.column("own").to_numpy()], distinct[:own] = order.column("n").to_numpy(), 1
    shared = classed.df.where(F.col("class") >= own).groupBy("class").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"))
    for r in shared.collect():  # at most ``rare`` rows
        by_class[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    counts = Counts(tokens, distinct_tokens, own, by_class, distinct)

    def join(chunk: pa.Table, words: pa.Table) -> pa.Table:
        place, n, kind = (words.column(c).to_numpy() for c in ("place", "n", "class"))
        amount, klass = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        amount[place], klass[place] = n, kind
        base = np.log10((amount + 1) / (counts.tokens + counts.distinct + 1))
        rest = np.where(klass < counts.own, 0.0, np.log10((amount + 1) / (by_class + distinct + 1)[klass]))
        out = []
        for row in chunk.to_pylist():
            places = unpacked(row["places"])
            begins = np.concatenate([[0], np.cumsum(row["n_tokens"])[:-1]]).astype(np.int64)
            summed = [np.add.reduceat(v[places], begins) for v in ((amount > 0).astype(np.int64), base, rest)]
            out.append({"chunk": row["chunk"], "doc_id": row["doc_id"], "held_out": row["held_out"], "n_tokens": row["n_tokens"], "n_known": summed[0], "base_score": summed[1], "rest_score": summed[2], "classes": packed(klass[places])})
        return pa.Table.from_pylist(out, schema)

    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int32())), ("n_known", pa.list_(pa.int64())), ("base_score", pa.list_(pa.float64())), ("rest_score", pa.list_(pa.float64())), ("classes", pa.binary())])
    back = listed.select("chunk", "place", "tokens").join(classed.df, "tokens").select("chunk", "place", "n", "class")
    made = cut.df.select("chunk", "doc_id", "held_out", "n_tokens", "places").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(join, "chunk long, doc_id array<long>, held_out array<boolean>, n_tokens array<int>, n_known array<long>, base_score array<double>, rest_score array<double>, classes binary")
    stored = Stored(made, "hmm-sequences")
    for old in (cut, count, frequent, classed):
        old.drop()
    return stored.df, counts


@dataclass(frozen=True)
class Model:
    """Distributions of the first state of a text and of a window inside one, of the next state, and of classes by state
    (rows are classes)."""

    start: np.ndarray
    inside: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def texts_of(classes: bytes, sizes: list[int]) -> list[np.ndarray]:
    return np.split(unpacked(classes), np.cumsum(sizes)[:-1])


def _grids(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, longest first, as columns of grids of at most CELLS cells: (which texts, their classes by step, how many
    columns are still running at each step)."""
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = int(sizes[order[at]])
        here = order[at : at + max(1, CELLS // longest)]
        grid = np.zeros((longest, len(here)), dtype=np.uint32)
        for column, k in enumerate(here):
            grid[: sizes[k], column] = texts[k]
        running = len(here) - np.searchsorted(sizes[here][::-1], np.arange(longest), side="right")
        yield here, grid, running
        at += len(here)


def log10_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each class sequence's probability, by the forward recursion scaled at every step."""
    out = np.zeros(len(texts))
    for which, grid, running in _grids(texts):
        total = np.zeros(len(which))
        ahead = np.broadcast_to(model.start, (len(which), len(model.start)))
        for step, n in enumerate(running.tolist()):
            ahead = ahead[:n] * model.emit[grid[step, :n]]
            scale = ahead.sum(axis=1)
            total[:n] += np.log10(scale)
            ahead = (ahead / scale[:, None]) @ model.move
        out[which] = total
    return out


@dataclass
class Expected:
    """Expected counts, in the shape of the model."""

    start: np.ndarray
    inside: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    likelihood: float = 0.0  # natural logarithm, of all that was added under its model

    @classmethod
    def none(cls, states: int, classes: int) -> Expected:
        return cls(np.zeros(states), np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)))

    def add(self, model: Model, texts: list[np.ndarray]) -> None:
        """Counts of training texts, window by window."""
        windows = [t[at : at + WINDOW] for t in texts for at in range(0, len(t), WINDOW)]
        first = np.array([at == 0 for t in texts for at in range(0, len(t), WINDOW)], dtype=bool)
        for low in range(0, len(windows), 1024):
            for which, grid, running in _grids(windows[low : low + 1024]):
                self._grid(model, first[low : low + 1024][which], grid, running.tolist())

    def _grid(self, model: Model, first: np.ndarray, grid: np.ndarray, running: list[int]) -> None:
        states = len(model.start)
        ahead, scales = [], []
        now = np.where(first[:, None], model.start, model.inside)
        for step, n in enumerate(running):
            now = now[:n] * model.emit[grid[step, :n]]
            scale = 1 / now.sum(axis=1, keepdims=True)
            now *= scale
            ahead.append(now)
            scales.append(scale)
            self.likelihood -= float(np.log(scale).sum())
            if step + 1 < len(running):
                now = now @ model.move
        back = np.ones((running[-1], states))
        seen = [ahead[-1]]
        for step in range(len(running) - 2, -1, -1):
            n, later = running[step], running[step + 1]
            weighted = model.emit[grid[step + 1, :later]] * back * scales[step + 1]
            self.move += ahead[step][:later].T @ weighted * model.move
            back = np.ones((n, states))
            back[:later] = weighted @ model.move.T
            seen.append(ahead[step] * back)
        at_start = seen[-1]
        self.start += at_start[first].sum(axis=0)
        self.inside += at_start[~first].sum(axis=0)
        shares = np.concatenate(seen[::-1])
        klass = np.concatenate([grid[step, :n] for step, n in enumerate(running)]).astype(np.int64)
        for k in range(states):
            self.emit[:, k] += np.bincount(klass, weights=shares[:, k], minlength=len(self.emit))


def renewed(seen: Expected, counts: Counts, floor: float = 0.01) -> Model:
    """The model of expected counts, each state's classes mixed with a share of their frequency over all."""
    overall = (counts.by_class + 1) / (counts.by_class + 1).sum()
    emit = (1 - floor) * seen.emit / np.maximum(seen.emit.sum(axis=0), 1e-9) + floor * overall[:, None]
    emit /= emit.sum(axis=0)
    soft = lambda x: (x + 1e-3) / (x + 1e-3).sum(axis=-1, keepdims=True)
    return Model(soft(seen.start), soft(seen.inside), soft(seen.move), emit)


def first_model(texts: list[np.ndarray], counts: Counts, states: int = STATES) -> Model:
    """A model to begin with: windows are dealt to states at random, emissions moved a little so that no two states are
    alike, then a few passes over them."""
    rng = np.random.default_rng(SEED)
    seen = Expected.none(states, len(counts.by_class))
    for text in texts:
        for at in range(0, len(text), WINDOW):
            np.add.at(seen.emit[:, rng.integers(states)], text[at : at + WINDOW].astype(np.int64), 1.0)
    seen.move += np.eye(states) * 50 + 1
    model = renewed(seen, counts, 0.1)
    emit = model.emit * rng.uniform(0.9, 1.1, model.emit.shape)
    model = Model(model.start, model.inside, model.move, emit / emit.sum(axis=0))
    for _ in range(INIT_PASSES if texts else 0):
        seen = Expected.none(states, len(counts.by_class))
        seen.add(model, texts)
        model = renewed(seen, counts, 0.05)
    return model


def _some(stored: DataFrame, tokens: int) -> list[np.ndarray]:
    """Windows of training texts, about INIT_TOKENS tokens, by the hash of their place among all."""
    share = min(1.0, INIT_TOKENS / max(1, tokens))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held, sizes, packed_classes in zip(*batch.columns, strict=True):
                rng = np.random.default_rng([SEED, chunk.as_py()])
                found = []
                for k, (text, away) in enumerate(zip(texts_of(packed_classes.as_py(), sizes.as_py()), held.as_py(), strict=True)):
                    drawn = np.flatnonzero(rng.random(-(-len(text) // WINDOW)) < share)
                    if not away:
                        found += [(k, w, text[w * WINDOW : (w + 1) * WINDOW].astype("<u4").tobytes()) for w in drawn.tolist()]
                columns = [pa.array([chunk.as_py()] * len(found), pa.int64()), *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "text", "number", "classes"])

    drawn = stored.select("chunk", "held_out", "n_tokens", "classes").mapInArrow(scan, "chunk long, text int, number int, classes binary")
    return [np.frombuffer(r["classes"], dtype="<u4") for r in sorted(drawn.collect(), key=lambda r: (r["chunk"], r["text"], r["number"]))]


def train(stored: DataFrame, counts: Counts, max_passes: int = MAX_PASSES, states: int = STATES, gain: float = GAIN) -> tuple[Model, list[float]]:
    """Baum-Welch over all stored training sequences: the model, and the mean log-likelihood of a token before each pass."""
    classes = len(counts.by_class)
    model, history = first_model(_some(stored, counts.tokens), counts, states), []
    names = [f"s{k}" for k in range(states)]
    while len(history) < max_passes:

        def scan(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            seen = Expected.none(states, classes)
            for batch in batches:
                for held, sizes, packed_classes in zip(*batch.columns, strict=True):
                    texts = texts_of(packed_classes.as_py(), sizes.as_py())
                    seen.add(model, [t for t, h in zip(texts, held.as_py(), strict=True) if not h])
            last = np.zeros(states)
            last[0] = seen.likelihood
            table = np.rint(np.concatenate([seen.emit, seen.move, [seen.start, seen.inside, last]]) * FIXED).astype(np.int64)
            used = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(table[used, k]) for k in range(states)]], names=["row", *names])

        parts = stored.select("held_out", "n_tokens", "classes").mapInArrow(scan, "row long, " + ", ".join(f"{n} long" for n in names))
        summed = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # a row for each class and state
        table = np.zeros((classes + states + 3, states))
        for k, n in enumerate(names):
            table[summed.column("row").to_numpy(), k] = summed.column(n).to_numpy() / FIXED
        history.append(table[-1, 0] / max(1, counts.tokens))
        model = renewed(Expected(table[-3], table[-2], table[classes : classes + states], table[:classes]), counts)
        if len(history) > 1 and history[-1] - history[-2] < gain:
            break
    return model, history


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_passes: int = MAX_PASSES, states: int = STATES, chunk_bytes: int = CHUNK_BYTES, own_factor: float = OWN) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each of docs."""
    stored, counts = sequences(docs, id_column, text_column, chunk_bytes, own_factor)
    model, _ = train(stored, counts, max_passes, states)
    return scores(stored, counts, model)


def scores(stored: DataFrame, counts: Counts, model: Model) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = dict(zip(batch.schema.names, (c[k].as_py() for c in batch.columns), strict=True))
                found = log10_likelihoods(model, texts_of(row["classes"], row["n_tokens"])) + np.array(row["rest_score"])
                columns = [pa.array(row[c], t) for c, t in zip(LISTS[:4], (pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([counts.tokens] * len(found), pa.int64()), pa.array(row["base_score"], pa.float64()), pa.array(found)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return stored.select(*LISTS, "classes").mapInArrow(scan, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
