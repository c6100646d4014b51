"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

A word counts twice: as its lower-case letters and as its shape, which is the run of its kinds of characters; both are
hashed into fixed tables. Every entry has a sparse random index vector, and its word vector is the sum of the index
vectors found within two words of it, counted over all documents: per task first, then summed by entry. A document is
the mean of its words' vectors, the mean absolute step between neighbours' and the spread, by letters and by shape.
The network is fitted on at most sample_rows labelled documents; a fifth of them sets the temperature instead.

Every whole text of any length is scored, in lots of words, null as empty: all pooled values zero. Without labels of both
classes the score is constant, 0 if all are bad, else 1. Repeated rows are scored alike; a null doc_id isn't held out. Of
repeated labels of an id the greatest counts, and each row with that id is an example. An empty table gives no rows.
`quality` reads doc_id, text and the label only; `keep_good` returns all columns, whatever their names."""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, labelled, tokens

WORDS, SHAPES, DIM, NONZERO, REACH = 1 << 14, 1 << 9, 16, 2, 2
ENTRIES = WORDS + SHAPES
#: Words taken at once.
LOT = 100_000
SAMPLE_ROWS = 16_000
HIDDEN = 32


def _shape(text: str) -> str:
    out = ""
    for c in text:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        if kind != out[-1:]:
            out += kind
            if len(out) == 8:
                break
    return out


def entry(word: bytes) -> int:
    """Both entries of a word in one number."""
    text = word.decode("utf-8", "replace")
    if text.islower() and text.isalpha():
        letters, shape = text, "x"  # as below, for most words
    else:
        letters, shape = "".join(filter(str.isalpha, text.lower())), _shape(text)
    return (zlib.crc32(letters.encode()) % WORDS) * SHAPES + zlib.crc32(shape.encode()) % SHAPES


def index_codes() -> list[np.ndarray]:
    """For each nonzero component of the entries' random index vectors, twice its place, plus one if it is negative."""
    rng = np.random.default_rng(10)
    places = np.array([rng.choice(DIM, NONZERO, replace=False) for _ in range(ENTRIES)])
    return list((2 * places + rng.integers(0, 2, places.shape)).T)


@functools.cache
def known_entries() -> tokens.Cached:
    """Entries of words; made once in a worker, whatever its tasks."""
    return tokens.Cached(entry, 56 << 20)


def _entries(words: list[bytes], known: tokens.Cached) -> tuple[np.ndarray, np.ndarray]:
    both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return both // SHAPES, both % SHAPES + WORDS


def _accumulate(total: np.ndarray, words: np.ndarray, shapes: np.ndarray, doc: np.ndarray, codes: list[np.ndarray]) -> None:
    """Add to each entry the index vectors of the entries up to REACH words from it in its document. The last bin of
    total takes pairs that lie in two documents."""
    targets = [ids * (2 * DIM) for ids in (words, shapes)]
    signed = [code[ids] for ids in (words, shapes) for code in codes]
    for away in range(1, min(REACH, len(doc) - 1) + 1):
        apart = doc[away:] != doc[:-away]
        bins = np.concatenate([one for t in targets for c in signed for one in (t[:-away] + c[away:], t[away:] + c[:-away])]).reshape(-1, len(apart))
        bins[:, apart] = len(total) - 1
        total += np.bincount(bins.ravel(), minlength=len(total))


def _lots(texts: list[bytes]):
    """Lists of (document, words) of about LOT words; a longer document comes in several parts."""
    lot, size = [], 0
    for d, text in enumerate(texts):
        words = text.split()
        for at in range(0, len(words), LOT):
            lot.append((d, words[at : at + LOT]))
            size += len(lot[-1][1])
            if size >= LOT:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A vector of length one for each entry, over all documents; entries rarely seen are shorter."""

    def count(batches):
        codes = index_codes()
        known, total = known_entries(), np.zeros(ENTRIES * DIM * 2 + 1, np.int64)
        tokens.alone(known)
        for batch in batches:
            for lot in _lots(common.byte_texts(batch.column(0))):
                words, shapes = _entries([w for _, ws in lot for w in ws], known)
                _accumulate(total, words, shapes, np.repeat([d for d, _ in lot], [len(ws) for _, ws in lot]), codes)
        sums = (total[:-1:2] - total[1::2]).reshape(ENTRIES, DIM)
        some = np.flatnonzero(sums.any(1))
        yield pa.record_batch([pa.array(some.astype(np.int32)), *[pa.array(sums[some, k]) for k in range(DIM)]], ["e", *[f"c{k}" for k in range(DIM)]])
        del total, sums
        common.settle()

    counted = common.bounded(docs.select("text")).mapInArrow(count, "e int, " + ", ".join(f"c{k} long" for k in range(DIM)))
    found = counted.groupBy("e").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(DIM)]).toArrow()  # ENTRIES rows at most
    out = np.zeros((ENTRIES, DIM))
    for k in range(DIM):
        out[found["e"].to_numpy(), k] = found[f"c{k}"].to_numpy()
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out /= size + 10
    common_part = out.sum(0) / max((size > 0).sum(), 1)
    return np.where(size > 0, out - common_part, 0).astype(np.float32)


def _sums(words: np.ndarray, shapes: np.ndarray, starts: np.ndarray, doc: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per document part: sums of vectors, of absolute steps and of squares, by letters and by shape."""
    out = []
    for ids in (words, shapes):
        v = vectors[ids]
        step = np.zeros_like(v)
        same = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        step[same] = np.abs(v[same] - v[same - 1])
        out += [np.add.reduceat(x, starts, axis=0) for x in (v, step, v * v)]
    return np.concatenate(out, axis=1)


def pooled(texts: list[bytes], vectors: np.ndarray, known: tokens.Cached) -> np.ndarray:
    """A row for each text."""
    sums, n = np.zeros((len(texts), 6 * DIM)), np.zeros(len(texts))
    for lot in _lots(texts):
        sizes = np.array([len(ws) for _, ws in lot])
        words, shapes = _entries([w for _, ws in lot for w in ws], known)
        ids = np.array([d for d, _ in lot])
        np.add.at(sums, ids, _sums(words, shapes, np.cumsum(sizes) - sizes, np.repeat(ids, sizes), vectors))
        np.add.at(n, ids, sizes)
    mean = sums / np.maximum(n, 1)[:, None]
    for at in (0, 3 * DIM):
        spread = mean[:, at + 2 * DIM : at + 3 * DIM]
        spread[:] = np.sqrt(np.maximum(spread - mean[:, at : at + DIM] ** 2, 0))
    return np.concatenate([mean, np.log1p(n)[:, None]], axis=1)


@dataclass
class Network:
    """Standardized inputs, a hidden layer of rectified units, one logit over the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -logits, logits))))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam over shuffled lots, on all rows but every fifth; those set the temperature of least log loss."""
    rng = np.random.default_rng(1)
    calibrate = np.arange(len(y)) % 5 == 4
    if min(np.bincount(y[~calibrate], minlength=2)) == 0 or not calibrate.any():
        calibrate[:] = False
    mean, scale = x.mean(0), x.std(0) + 1e-6
    net = Network(mean, scale, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    z, t = ((x - mean) / scale)[~calibrate], y[~calibrate].astype(float)
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 64):
            rows = order[at : at + 64]
            a = np.maximum(z[rows] @ values[0] + values[1], 0)
            off = (1 / (1 + np.exp(-np.clip(a @ values[2] + values[3], -30, 30))) - t[rows]) / len(rows)
            back = np.outer(off, values[2]) * (a > 0)
            slopes = [z[rows].T @ back + decay * values[0], back.sum(0), a.T @ off + decay * values[2], np.array([off.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                values[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if calibrate.any():
        logits = net.logits(x[calibrate])
        net.temperature = min(np.geomspace(0.25, 8, 61), key=lambda q: _loss(logits / q, y[calibrate]))
    return net


def train(docs: DataFrame, labels: DataFrame, in_train: Column, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network | float]:
    """Word vectors over all documents, and the network, or the constant score where labels are of one class."""
    vectors = word_vectors(docs)

    def extract(batches):
        known = known_entries()
        tokens.alone(known)
        for batch in batches:
            x = pooled(common.byte_texts(batch.column(1)), vectors, known)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    some = labelled.sample(docs, labels, "quality", in_train, sample_rows).select("doc_id", "text", "y")
    got = some.mapInArrow(extract, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("x", "ascending")])
    y = got["y"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return vectors, 0.0 if len(y) and not y[0] else 1.0
    return vectors, fit(np.array([np.frombuffer(v.as_buffer(), np.float64) for v in got["x"]]), y)


def scored(docs: DataFrame, vectors: np.ndarray, network: Network | float) -> DataFrame:
    """The documents with _score and _predicted."""

    def run(batches):
        known = known_entries()
        tokens.alone(known)
        for batch in batches:
            texts = common.byte_texts(batch.column("text"))
            found = np.full(len(texts), network) if isinstance(network, float) else network.scores(pooled(texts, vectors, known))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found.astype(np.float64)), pa.array((found >= 0.5).astype(np.int32))], schema=pa.schema([*[batch.schema.field(n) for n in names], pa.field("_score", pa.float64()), pa.field("_predicted", pa.int32())]))
        common.settle()

    names = docs.columns
    return common.bounded(docs).mapInArrow(run, common.with_fields(docs, ("_score", "double"), ("_predicted", "int")))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of ids whose remainder is held are never looked at."""
    vectors, network = train(docs, labels, labelled.remainder(F.col("doc_id"), folds) != held, sample_rows)
    out = scored(docs.select("doc_id", "text"), vectors, network)
    return out.select("doc_id", F.coalesce(labelled.remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents predicted good, with their own columns."""
    vectors, network = train(docs, labels, labelled.remainder(F.col("doc_id"), folds) != held, sample_rows)
    return scored(common.wrapped(docs, "text"), vectors, network).where("_predicted = 1").select("_row.*")
