"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct n-grams of its lower-cased text, hashed into a fixed table. Each has the log
ratio of the parts of toxic and other labelled documents that contain it. Those whose ratio differs from zero by LEAST_Z
standard errors are used, the FEWEST surest ones where fewer do, and at most the MOST surest. A logistic regression on
these ratios, over the root of the number of features, is fitted to the labels. Both use the same sample: at most
sample_rows labelled documents outside the held-out fold, chosen by a hash of their ids, whatever the size of the corpus;
what reaches the driver is at most two bytes for each of MOST features of each of them.

Every whole text of any length is scored, null as empty: with no features, the intercept's score. Without labels of both
classes the score is constant, 1 if all are toxic, else 0. Repeated rows are scored alike; a null doc_id isn't held out. Of
repeated labels of an id the greatest counts, and each row with that id is an example. An empty table gives no rows. Only
doc_id, text and the label are read, so other columns of any name don't matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, labelled

LENGTHS = (3, 4, 5)
BITS = 18
LOT = 1 << 20
#: Labelled documents to learn from at most, those that must have a feature for it to count, and standard errors that
#: its log ratio must differ from zero by.
SAMPLE_ROWS, LEAST_DOCS, LEAST_Z = 16_000, 3, 4.0
#: Features that are used at least, if so many are in LEAST_DOCS documents, and at most; their places fit two bytes.
FEWEST, MOST = 500, 8192
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Distinct hashed n-grams of texts; the table that marks them is used again for each text."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        text = (text or "").lower()
        for at in range(0, len(text), LOT):  # lots overlap, so that no n-gram is lost between two
            signs = np.frombuffer(text[at : at + LOT + max(LENGTHS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            h = signs * _MULTIPLIER
            for n in range(2, min(max(LENGTHS), len(signs)) + 1):
                h = (h[:-1] ^ h[:-1] >> np.uint64(29)) * _MULTIPLIER + signs[n - 1 :]
                if n in LENGTHS:
                    self.seen[(h * _MULTIPLIER) >> np.uint64(64 - BITS)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def document_counts(rows: DataFrame) -> np.ndarray:
    """Over rows (text, y): how many documents of class 0 and 1 have each feature, and in the last column how many
    documents there are. Counted per task, then summed by feature."""

    def count(batches):
        features, counts = Features(), np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y, features(text)] += 1
                counts[y, -1] += 1
        some = np.flatnonzero(counts.any(0))
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[0, some]), pa.array(counts[1, some])], ["f", "n0", "n1"])

    summed = common.bounded(rows.select("text", "y")).mapInArrow(count, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = summed.toArrow()  # a row for each place of the table at most
    out = np.zeros((2, (1 << BITS) + 1), np.int64)
    out[:, found["f"].to_numpy()] = found["n0"].to_numpy(), found["n1"].to_numpy()
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Per feature, log of its smoothed part among class 1 over that among class 0; zero for features that aren't used."""
    n = counts[:, :-1]
    part = (n + 1) / (counts[:, -1:] + 2)
    ratio = np.log(part[1] / part[0])
    sure = np.where(n.sum(0) >= LEAST_DOCS, np.abs(ratio) / np.sqrt((1 / (n + 1)).sum(0)), 0.0)
    many = int(np.clip((sure >= LEAST_Z).sum(), FEWEST, MOST))
    used = np.argsort(-sure, kind="stable")[:many]
    out = np.zeros(len(ratio))
    out[used] = np.where(sure[used] > 0, ratio[used], 0.0)
    return out


def fit(found: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, rounds: int = 8, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Coefficients, ratios included, and intercept of the logistic regression, by AdaGrad in a fixed order."""
    rows = [f[ratios[f] != 0] for f in found]
    values = [ratios[f] / np.sqrt(max(len(f), 1)) for f in rows]
    w, b, gw, gb = np.zeros(len(ratios)), 0.0, np.full(len(ratios), 1e-8), 1e-8
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            off = 1 / (1 + np.exp(-np.clip(w[f] @ v + b, -30, 30))) - y[i]
            slope = off * v + decay * w[f]
            gw[f] += slope * slope
            w[f] -= rate * slope / np.sqrt(gw[f])
            gb += off * off
            b -= rate * off / np.sqrt(gb)
    return w * ratios, b


class Model:
    def __init__(self, coefficients: np.ndarray, used: np.ndarray, intercept: float):
        self.coefficients, self.used, self.intercept = coefficients.astype(np.float32), used, float(intercept)

    def score(self, features: np.ndarray) -> float:
        features = features[self.used[features]]
        z = float(self.coefficients[features].sum(dtype=np.float64)) / np.sqrt(max(len(features), 1)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, label: str, in_train: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    some = labelled.sample(docs, labels, label, in_train, sample_rows).select("doc_id", "text", "y")
    counts = document_counts(some)
    none = np.zeros(1 << BITS)
    if not counts[:, -1].all():
        return Model(none, none != 0, 30.0 if counts[1, -1] else -30.0)
    ratios = log_ratios(counts)
    used = ratios != 0
    place = np.cumsum(used) - 1

    def extract(batches):
        features = Features()
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([place[f[used[f]]].astype("<u2").tobytes() for f in found], pa.binary())], ["doc_id", "y", "f"])

    got = some.mapInArrow(extract, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, f binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("f", "ascending")])
    y = got["y"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return Model(none, none != 0, 30.0 if len(y) and y[0] else -30.0)
    w, b = fit([np.frombuffer(x.as_buffer(), "<u2") for x in got["f"]], y, ratios[used])
    coefficients = np.zeros(len(ratios))
    coefficients[used] = w
    return Model(coefficients, used, b)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""

    def run(batches):
        features = Features()
        for batch in batches:
            found = np.array([model.score(features(t)) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.record_batch([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return common.bounded(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of ids whose remainder is held are never looked at."""
    model = train(docs, labels, "toxic", labelled.remainder(F.col("doc_id"), folds) != held, sample_rows)
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(labelled.remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")
