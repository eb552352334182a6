"""Language identification by a convolutional network over bytes.

Bytes are embedded; filters of several widths run over windows of fixed length; each filter's largest answer in a window
goes to a softmax over the languages. Trained in numpy on a bounded sample of labelled texts. A whole text is cut into
windows side by side, and the probabilities of its windows are averaged by the bytes they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import id_remainder, slices, smallest_hashes, texts_of

#: Bytes of a window; filters of each width; dimensions of a byte.
LENGTH, WIDTHS, FILTERS, DIMENSIONS = 256, (2, 3, 4), 12, 8
#: The bound of the training sample: texts of each language, windows of each text (spread over the whole text).
TEXTS, WINDOWS = 400, 4
#: The share of texts, rightly predicted and not trained on, that may score below the least score of a known language.
BELOW = 0.002
UNDETERMINED = "und"


def windows_of(text: str, length: int = LENGTH) -> np.ndarray:
    """The whole text, lower case, as rows of ``length`` bytes; the last row is filled up with zeros."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    rows = max(1, -(-len(data) // length))
    out = np.zeros(rows * length, np.uint8)
    out[:len(data)] = data
    return out.reshape(rows, length)


@dataclass
class ByteNet:
    """embed (256, d); filters: all widths in one matrix (widest * d, f), a narrower filter's missing rows held at 0."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray, with_place: bool = False):
        n, length = windows.shape
        widest = self.filters.shape[0] // self.embed.shape[1]
        x = self.embed[np.pad(windows, ((0, 0), (0, widest - 1)))]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), self.filters.shape[0], axis=1)[:, ::self.embed.shape[1]]
        answers = (np.ascontiguousarray(view).reshape(-1, self.filters.shape[0]) @ self.filters).reshape(n, length, -1)
        pooled = np.maximum(answers.max(axis=1) + self.bias, 0)
        return (pooled, answers.argmax(axis=1)) if with_place else pooled

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def gradients(net: ByteNet, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy by each parameter; that of a maximum goes to its place. Byte 0 has no embedding to learn."""
    widest = net.filters.shape[0] // net.embed.shape[1]
    pooled, place = net.pooled(x, with_place=True)
    z = pooled @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ net.out.T) * (pooled > 0)
    padded = np.pad(x, ((0, 0), (0, widest - 1)))
    used = padded[np.arange(len(y))[:, None, None], place[:, :, None] + np.arange(widest)]
    seen = net.embed[used].reshape(len(y), net.filters.shape[1], -1)
    g = {"out": pooled.T @ p, "out_bias": p.sum(axis=0), "bias": back.sum(axis=0),
         "filters": np.einsum("nf,nfi->if", back, seen), "embed": np.zeros_like(net.embed)}
    np.add.at(g["embed"], used.ravel(), (back[:, :, None] * net.filters.T[None]).reshape(-1, net.embed.shape[1]))
    g["embed"][0] = 0
    return g


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7, epochs: int = 12, batch: int = 64, rate: float = 0.004) -> ByteNet:
    """Cross entropy by Adam. The same input gives the same network."""
    rng, widest, k = np.random.default_rng(seed), max(WIDTHS), len(languages)
    held = np.zeros((widest * DIMENSIONS, FILTERS * len(WIDTHS)), np.float32)
    for i, width in enumerate(WIDTHS):
        held[:width * DIMENSIONS, i * FILTERS:(i + 1) * FILTERS] = 1
    start = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    embed = start(256, DIMENSIONS, scale=0.5)
    embed[0] = 0
    net = ByteNet(languages, embed, start(*held.shape, scale=0.3) * held, np.zeros(held.shape[1], np.float32),
                  start(held.shape[1], k, scale=0.1), np.zeros(k, np.float32))
    names = ("embed", "filters", "bias", "out", "out_bias")
    m, v, step = [{n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2)] + [0]
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            g = gradients(net, windows[order[at:at + batch]], labels[order[at:at + batch]])
            g["filters"] *= held
            step += 1
            for name in names:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                getattr(net, name)[...] -= rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-7)
    return net


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _labelled(docs: DataFrame, usable: Column, texts: int) -> DataFrame:
    """doc_id, text, lang: of each language the ``texts`` usable ids with the smallest hash, of each the least text that is not empty."""
    labelled = docs.where(F.col("lang").isNotNull())
    chosen = smallest_hashes(labelled.where(usable), "lang", texts).withColumnRenamed("lang", "chosen_lang")
    own = texts_of(labelled.withColumn("chosen_lang", F.col("lang")), "chosen_lang").where(F.col("text") != "")
    return (own.join(F.broadcast(chosen), ["doc_id", "chosen_lang"]).groupBy("doc_id", F.col("chosen_lang").alias("lang"))
            .agg(F.min("text").alias("text")).select("doc_id", "text", "lang"))


def learn(docs: DataFrame, texts: int = TEXTS, windows: int = WINDOWS) -> ByteNet:
    """A network from rows with a language whose id leaves another remainder than 2 by 4.

    Bounded sample: of each language the ``texts`` ids with the smallest hash, of each the least text that is not empty, of that up
    to ``windows`` windows spread over all of it. Which ids those are is decided without reading texts.
    """
    rows = _labelled(docs, id_remainder(F.col("doc_id"), 4) != 2, texts).mapInArrow(_spread(windows), "doc_id string, lang string, bytes binary")
    found = sorted((r["lang"], r["doc_id"] or "", bytes(r["bytes"])) for r in rows.collect())
    languages = sorted({r[0] for r in found})
    if not languages:
        return train(np.zeros((1, LENGTH), np.uint8), np.zeros(1, np.int64), [UNDETERMINED], epochs=1)
    return train(np.frombuffer(b"".join(r[2] for r in found), np.uint8).reshape(-1, LENGTH), np.array([languages.index(r[0]) for r in found]), languages)


def _spread(windows: int):
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            rows = []
            for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                if has_letter(text):
                    cut = windows_of(text)
                    at = sorted({round(x) for x in np.linspace(0, len(cut) - 1, windows)})
                    rows += [(str(doc_id), lang, cut[i].tobytes()) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))],
                                             names=["doc_id", "lang", "bytes"])
    return work


def predictions(net: ByteNet, texts: list[str], at_once: int = 256) -> list[tuple[str, float]]:
    """(language, its probability) of each whole text; ``und`` and 0 for a text without a letter."""
    out: list = [(UNDETERMINED, 0.0)] * len(texts)
    lettered = [i for i, t in enumerate(texts) if has_letter(t)]
    sums = np.zeros((len(texts), len(net.languages)))
    held, owner, weight, n = [], [], [], 0

    def flush():
        nonlocal held, owner, weight, n
        if held:
            p = net.probabilities(np.concatenate(held)).astype(np.float64)
            np.add.at(sums, np.concatenate(owner), p * np.concatenate(weight)[:, None])
        held, owner, weight, n = [], [], [], 0

    for i in lettered:
        cut = windows_of(texts[i])
        share = np.full(len(cut), 1.0)
        share[-1] = np.count_nonzero(cut[-1]) / cut.shape[1]
        for a in range(0, len(cut), at_once):
            part = cut[a:a + at_once]
            held.append(part)
            owner.append(np.full(len(part), i))
            weight.append(share[a:a + at_once])
            n += len(part)
            if n >= at_once:
                flush()
    flush()
    for i in lettered:
        if (total := sums[i].sum()) > 0:
            best = int(sums[i].argmax())
            out[i] = (net.languages[best], min(1.0, float(sums[i][best] / total)))
    return out


def language_id(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``.

    A null text, an empty one and one without any letter (in any script) are ``und`` with score 0. lang, source and doc_id are
    no inputs of a prediction. Ties go to the language first in order. Null ids and repeated rows are rows like others; an
    empty table gives no rows; all windows of a text count, however long it is.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(net)

    def work(batches):
        for batch in slices(batches):
            found = predictions(model.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()),
                                              pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    held_out = (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return texts_of(docs, held_out).mapInArrow(work, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def least_score(docs: DataFrame, net: ByteNet, texts: int = TEXTS, below: float = BELOW) -> float:
    """The score that all but a share ``below`` of the rows reach which are held out of training and predicted as labelled.

    So it follows the corpus and the number of its languages. Bounded sample, chosen like that of training: up to ``texts`` whole
    texts of each language. With too few of them to have such a share (fewer than 1 / ``below``) it is 0.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches):
        for batch in slices(batches):
            found = predictions(model.value, batch.column("text").to_pylist())
            right = [score for (lang, score), true in zip(found, batch.column("lang").to_pylist(), strict=True) if lang == true]
            yield pa.RecordBatch.from_arrays([pa.array(right, pa.float64())], names=["score"])

    rows = _labelled(docs, id_remainder(F.col("doc_id"), 4) == 2, texts).mapInArrow(work, "score double")
    scores = sorted(r["score"] for r in rows.collect())
    return scores[n - 1] if (n := int(below * (len(scores) + 1))) else 0.0


def keep_known_language(docs: DataFrame, net: ByteNet, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, in one of the network's languages; with ``least``, at that score at least.

    By default only texts without a letter (``und``) go: how sure a network can be depends on the number of its languages, so no
    fixed score would leave clean texts alone whatever the languages are (see ``least_score``).
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches):
        for batch in slices(batches):
            found = predictions(model.value, [t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
