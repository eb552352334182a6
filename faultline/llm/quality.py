"""Quality scores learned from preference pairs (Bradley-Terry).

Of a good and a bad document the good one is preferred, with a probability that is the logistic function of the difference
of their scores; a score is linear in features of the whole text. The weights minimise the logistic loss over pairs of
labelled documents. A quantile of the training documents' scores, the one that tells the labels apart best, becomes the
threshold, which a document's score from 0 to 1 shows as 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import id_remainder, one_text_each, slices, smallest_hashes, texts_of

#: The bound of the training sample: labelled documents of either label. Pairs drawn from them.
LABELLED, PAIRS = 3000, 40_000
MARKS = np.frombuffer(b"!#$%&*|@~^=+<>{}[]\\_", np.uint8)
GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".?", "comma": b",;:", "mark": MARKS.tobytes(),
          "shout": b"!", "pipe": b"|", "space": b" \t", "line": b"\n", "beyond": range(128, 256)}
PICK = np.array([[b in set(g) for b in range(256)] for g in GROUPS.values()], np.float64)
#: Of a line: words that make it long enough to be prose.
PROSE = 6


def features(text: str) -> np.ndarray:
    """Shares of kinds of bytes, repetition, word and line shapes of the whole text; all zero for an empty one."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    if not words:
        return np.zeros(len(GROUPS) + 15)
    shares = PICK @ np.bincount(raw, minlength=256) / len(raw)
    kind = dict(zip(GROUPS, shares, strict=True))
    letters = kind["upper"] + kind["lower"] + kind["beyond"]
    n = len(words)
    marked = [w[-1] in "!#$%&*|" for w in words]
    again = sum(map(eq, words, words[1:])) / n
    lengths = np.fromiter(map(len, words), np.int64, n)
    in_prose = sum(len(x) for x in lines if x.count(" ") >= PROSE) / len(text)
    extra = [kind["upper"] / max(letters, 1e-9), sum(marked) / n, again, len(set(words)) / n, lengths.mean() / 10, (lengths > 20).mean(),
             (lengths <= 2).mean(), len(set(lines)) / max(1, len(lines)), in_prose, np.log1p(n) / 10, np.log1p(n / max(1, len(lines))) / 5,
             float(again > 0.3), float(kind["mark"] > 0.02), float(kind["upper"] > 0.2 * letters), 1.0]
    return np.concatenate([np.sqrt(shares), extra])


@dataclass
class Ranking:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale * self.weights).sum(axis=-1)  # row by row, so that equal texts get equal scores

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)))


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 25, seed: int = 11) -> Ranking:
    """Newton steps on the mean logistic loss of score differences, with a ridge. Without both labels all scores are 0.5."""
    everything = np.concatenate([good, bad])
    d = everything.shape[1]
    if not len(good) or not len(bad):
        return Ranking(np.zeros(d), np.zeros(d), np.ones(d), 0.0)
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-6
    rng = np.random.default_rng(seed)
    x = (good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]) / scale
    w = np.zeros(d)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
        slope = -(x * p[:, None]).mean(axis=0) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / pairs + ridge * np.eye(d), slope)
        w -= step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
    model = Ranking(w, mean, scale, 0.0)
    high, low = model.raw(good), model.raw(bad)
    levels = np.quantile(np.concatenate([high, low]), np.linspace(0, 1, 501))
    levels = (levels[1:] + levels[:-1]) / 2
    balance = [(high >= t).mean() + (low < t).mean() for t in levels]
    best = np.flatnonzero(np.array(balance) >= max(balance) - 1e-9)
    model.threshold = float(levels[best[len(best) // 2]])
    return model


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Ranking:
    """A ranking from documents with a label 0 or 1 whose id leaves another remainder than 1 by 3.

    Bounded sample: of either label the ``labelled`` ids with the smallest hash, of each one whole text.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), 3) != 1))
    chosen = smallest_hashes(usable, "quality", labelled)
    rows = one_text_each(docs, chosen, "quality").select("quality", "text").mapInArrow(_rows, "quality int, x array<double>")
    found = sorted((r["quality"], tuple(r["x"])) for r in rows.collect())
    by = {q: np.array([x for label, x in found if label == q]).reshape(-1, len(GROUPS) + 15) for q in (0, 1)}
    return fit(by[1], by[0])


def _rows(batches):
    for batch in slices(batches):
        x = [features(t).tolist() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["quality", "x"])


def scores(model: Ranking, texts: list[str]) -> np.ndarray:
    return model.score(np.stack([features(t) for t in texts]))


def quality(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    A null text counts as empty; empty texts have the score of all features at zero. Null ids and repeated rows are rows like
    others; an empty table gives no rows. The whole text counts, however long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in slices(batches):
            score = scores(sent.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()),
                                              pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    held_out = (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return texts_of(docs, held_out).mapInArrow(work, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted to be of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in slices(batches):
            score = scores(sent.value, [t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(work, docs.schema)
