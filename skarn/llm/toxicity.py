"""Severity of toxic text by cumulative-link ordinal regression on sparse text features.

A text's features are the hashes of its different words (lower case, without punctuation at their ends) and of how they
begin and end, as stems tell more than forms. Grades are
ordered: P(grade <= k) = sigmoid(threshold_k - w x), one weight vector w for all grades and increasing thresholds, so
what separates mild from clean text also separates severe from mild. The output is the expected severity, the sum of
P(grade >= k) over k = 1 .. 3, and a text is rejected as toxic where P(grade >= 1) is at least one half and its
features speak for toxicity on balance (w x > 0).

Labels say toxic or not. Grades of toxic texts in training are thirds by the number of their features that are evidence:
much more frequent, by smoothed log odds, in toxic texts than in others. Only
features whose rates differ by more than chance get a weight.

The model is fitted on the driver on at most ``SAMPLE_ROWS`` labelled documents, those with the least hashes of their ids.
Their features stay on the executors and are counted there; the driver gets a count for each feature, at most DIMENSIONS,
and then the documents' numbers of the at most ``TELLING`` features that tell most. Scoring reads every whole text.

Defined cases: null and repeated ids and rows are scored each; texts may be of any length; a null or empty text has no features and gets the score of the thresholds alone and is not toxic; labels that are null or
without a document are ignored; of documents that share a labelled id one is used; without labels of both kinds nothing
is rejected; an empty table gives an empty result; other columns are carried, and one that clashes keeps its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, named, utf8

DIMENSIONS, GRADES, SAMPLE_ROWS, CACHE_WORDS, TELLING = 1 << 18, 4, 8192, 150_000, 8192
STEPS, RATE, PENALTY, MIN_DOCUMENTS, EVIDENCE = 200, 0.2, 5e-5, 2, 2.0
EDGES = b".,!?;:\"'()[]{}*_-"


def of_word(word: bytes) -> tuple[int, ...]:
    """A word's features: itself, its first and its last four and five characters. None for punctuation alone."""
    bare = word.strip(EDGES)
    if not bare:
        return ()
    text = bare.decode("utf-8", "replace")
    parts = [b"=" + bare]
    for n in (4, 5):
        if len(text) >= n:
            parts += [b"<" + text[:n].encode(), b">" + text[-n:].encode()]
    return tuple(xxhash.xxh64_intdigest(p) % DIMENSIONS for p in parts)


class Words:
    """The features of texts, through a bounded cache of their words that lasts as long as a task."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, ...]] = {}

    def features(self, body: bytes) -> set[int]:
        """The different features of a text's words."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        words = set(body.lower().split())
        for w in words:
            if w not in known:
                known[w] = of_word(w)
        return set().union(*[known[w] for w in words])


def features(body: bytes) -> set[int]:
    return Words().features(body)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    """weights by feature, thresholds in increasing order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def reach(self, strength: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by row."""
        return _sigmoid(strength[:, None] - self.thresholds[None, :])


def tally(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many toxic and how many other rows each feature is. Row by row, so that no copy of all rows is made."""
    bad, good = np.zeros(DIMENSIONS, dtype=np.int64), np.zeros(DIMENSIONS, dtype=np.int64)
    for row, is_toxic in zip(rows, toxic, strict=True):
        (bad if is_toxic else good)[row] += 1
    return bad, good


def telling(bad: np.ndarray, good: np.ndarray, rate: float) -> np.ndarray:
    """Which features stand in toxic and other texts at rates that differ by more than chance among so many features:
    the likelihood ratio statistic of the feature's rows exceeds twice the logarithm of the number of features. Of more
    than TELLING such features those with the greatest statistic."""
    total = bad + good
    share = lambda part, expected: part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9))
    ratio = 2 * (share(bad, total * rate) + share(good, total * (1 - rate)))
    out = (total >= MIN_DOCUMENTS) & (ratio > 2 * np.log(max(2, np.count_nonzero(total))))
    if np.count_nonzero(out) > TELLING:
        out[np.argsort(np.where(out, -ratio, np.inf), kind="stable")[TELLING:]] = False
    return out


def grades(rows: list[np.ndarray], toxic: np.ndarray, bad: np.ndarray, good: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Training grades, 0 for clean texts and thirds of the toxic ones by their amount of evidence."""
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    evidence = (odds > EVIDENCE) & kept
    amount = np.array([np.count_nonzero(evidence[row]) for row in rows])
    out = np.zeros(len(rows), dtype=np.int64)
    cuts = np.quantile(amount[toxic], [1 / 3, 2 / 3])
    out[toxic] = 1 + np.searchsorted(cuts, amount[toxic], side="left")
    return out


def loss_and_slope(p: np.ndarray, weights: int, owner: np.ndarray, column: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with the penalty, and its gradient. p: the weights, the first threshold, and the
    logarithms of the gaps between thresholds, which keeps them in order. (owner, column): which row has which feature."""
    n, levels = len(y), len(p) - weights
    w, gaps = p[:weights], np.exp(p[weights + 1 :])
    theta = np.concatenate([[-np.inf], p[weights] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
    s = np.bincount(owner, weights=w[column], minlength=n)
    upper, lower = _edge(theta[y + 1] - s), _edge(theta[y] - s)
    mass = np.maximum(upper - lower, 1e-9)
    to_upper, to_lower = -upper * (1 - upper) / mass, lower * (1 - lower) / mass
    by_theta = np.bincount(y + 1, weights=to_upper, minlength=levels + 2) + np.bincount(y, weights=to_lower, minlength=levels + 2)
    by_theta = by_theta[1 : levels + 1] / n
    later = np.cumsum(by_theta[::-1])[::-1]  # a gap moves all thresholds after it
    by_weight = np.bincount(column, weights=(1 - upper - lower)[owner], minlength=weights) / n + PENALTY * w
    return -float(np.log(mass).mean()) + PENALTY / 2 * float(w @ w), np.concatenate([by_weight, [later[0]], later[1:] * gaps])


def fit_model(rows: list[np.ndarray], toxic: np.ndarray, bad: np.ndarray | None = None, good: np.ndarray | None = None) -> Model:
    """Maximum penalised likelihood by Adam over all rows. Weights start at zero; features that are not telling keep that.
    bad, good: in how many toxic and other rows each feature is, where rows hold the telling ones only."""
    nothing = Model(np.zeros(DIMENSIONS, np.float32), np.full(GRADES - 1, 40.0) + np.arange(GRADES - 1))
    if not toxic.any() or toxic.all():
        return nothing
    if bad is None or good is None:
        bad, good = tally(rows, toxic)
    frequent = telling(bad, good, float(toxic.mean()))
    y = grades(rows, toxic, bad, good, frequent)
    kept = np.flatnonzero(frequent)
    place = np.cumsum(frequent) - 1
    found = [place[row[frequent[row]]] for row in rows]
    owner = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    column = np.concatenate(found)
    below = np.array([(y <= k).mean() for k in range(GRADES - 1)])
    logit = np.log((below + 1e-3) / (1 - below + 1e-3))
    p = np.concatenate([np.zeros(len(kept)), [logit[0]], np.log(np.maximum(np.diff(logit), 0.05))])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        _, slope = loss_and_slope(p, len(kept), owner, column, y)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        p = p - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS, dtype=np.float32)
    weights[kept] = p[: len(kept)]
    return Model(weights, p[len(kept)] + np.concatenate([[0], np.cumsum(np.exp(p[len(kept) + 1 :]))]))


def _edge(x: np.ndarray) -> np.ndarray:
    """The sigmoid, exactly 0 and 1 at the infinite ends."""
    out = _sigmoid(x)
    out[x == np.inf], out[x == -np.inf] = 1.0, 0.0
    return out


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """A model of a bounded sample of the labelled documents."""
    known = labels.select(named(id_column).cast("long").alias("doc_id"), named(label_column).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(named(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("body")).join(F.broadcast(sample), "doc_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [sorted(words.features(b.as_py())) for b in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "features"])

    found = texts.select("doc_id", "toxic", "body").mapInArrow(scan, "doc_id long, toxic int, features array<int>")
    once = Stored(found.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("features").alias("features")), "toxicity-sample")
    bad, good = np.zeros(DIMENSIONS, dtype=np.int64), np.zeros(DIMENSIONS, dtype=np.int64)
    counted = once.df.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") <= 0).alias("good"))
    counts = counted.toArrow()  # at most DIMENSIONS rows
    number = counts.column("f").to_numpy()
    bad[number], good[number] = counts.column("bad").to_numpy(), counts.column("good").to_numpy()
    labels_of = once.df.select("doc_id", (F.col("toxic") > 0).alias("toxic")).orderBy("doc_id").toArrow()  # at most ``rows`` rows
    toxic = labels_of.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
    kept = telling(bad, good, float(toxic.mean())) if toxic.any() and not toxic.all() else np.zeros(DIMENSIONS, dtype=bool)

    def telling_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(f.as_py(), dtype="<i4") for f in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[kept[r]].tobytes() for r in rows], pa.binary())], names=["doc_id", "features"])

    taken = once.df.select("doc_id", "features").mapInArrow(telling_only, "doc_id long, features binary").collect()  # TELLING numbers a row at most
    once.drop()
    return fit_model([np.frombuffer(r["features"], dtype="<i4") for r in sorted(taken, key=lambda r: r["doc_id"])], toxic, bad, good)


def severity(model: Model, text_column: str = "text") -> Column:
    """Struct of a text's scores: p_toxic, expected_severity, grade (the most likely), toxic."""
    weights = model.weights

    @F.arrow_udf("struct<p_toxic:double,expected_severity:double,grade:int,toxic:boolean>")
    def score(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        for body in bodies:
            strength = np.array([weights[list(words.features(b.as_py()))].sum(dtype=np.float64) for b in body])
            reach = model.reach(strength) if len(strength) else np.zeros((0, GRADES - 1))
            full = np.concatenate([np.ones((len(reach), 1)), reach, np.zeros((len(reach), 1))], axis=1)
            grade = (full[:, :-1] - full[:, 1:]).argmax(axis=1).astype(np.int32)
            columns = [pa.array(reach[:, 0]), pa.array(reach.sum(axis=1)), pa.array(grade), pa.array((reach[:, 0] >= 0.5) & (strength > 0))]
            yield pa.StructArray.from_arrays(columns, names=["p_toxic", "expected_severity", "grade", "toxic"])

    return score(utf8(text_column))


def reject(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs without those that the model finds toxic."""
    return docs.where(~severity(model, text_column)["toxic"])
