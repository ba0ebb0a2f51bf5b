"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A subword is a run of two to four bytes of the lower-cased text in which everything but letters is a blank; a blank
may stand at its ends only. Subwords are hashed to buckets, each bucket has an embedding, a document is the mean
embedding of all its subwords, and a linear layer gives the languages' logits (Joulin et al., "Bag of tricks for
efficient text classification", 2016). Embeddings and layer are trained by stochastic gradient descent in numpy on
a bounded sample (`SAMPLE_ROWS`). For scoring, embedding and layer are multiplied out into one table.

A fifth of the sample is kept for calibration: it sets the softmax temperature and the least score that is accepted.

Defined results: a null text or one without a letter is ``und`` with score 0; repeated rows get equal results;
with no learned language everything is ``und``; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import common

#: Documents that a fit reads at most.
SAMPLE_ROWS = 4000
BITS = 15
_BLANK = 32


def _letters() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[[b for b in range(128) if not chr(b).isalpha()]] = _BLANK
    return table


_TABLE = _letters()


def subwords(text: str) -> np.ndarray:
    """Counts of a text's subwords by bucket."""
    a = _TABLE[np.frombuffer(f" {text} ".lower().encode(), np.uint8)]
    blank = a == _BLANK
    h, out = a.astype(np.uint32), np.zeros(1 << BITS, np.int64)
    inner = np.zeros(len(a), bool)  # a blank strictly inside the run
    for n in range(2, 5):
        if len(a) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + a[n - 1:]
        inner = inner[:-1] if n == 2 else inner[:-1] | blank[n - 2:-1]
        whole = ~inner & ~(blank[: len(h)] & blank[n - 1:]) if n == 2 else ~inner
        mixed = (h[whole] + np.uint32(n)) * np.uint32(0x9E3779B1)
        out += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: embedding times layer
    bias: np.ndarray
    temperature: float
    accept: float  # scores below it are rejected

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        mean = counts / np.maximum(1, counts.sum(1, keepdims=True))
        z = (mean @ self.table + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], dim: int = 16, epochs: int = 8, rate: float = 0.5,
        seed: int = 11) -> LanguageModel:
    """From (buckets, counts) of each document, in a fixed order; every fifth document calibrates."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    if not k:
        return LanguageModel([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 0.0)
    embed = rng.normal(0, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (dim, k)), np.zeros(k)
    held = np.arange(len(rows)) % 5 == 0
    learn = np.flatnonzero(~held)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            lr = rate * (1 - done / steps)
            done += 1
            at, weight = rows[i][0], (rows[i][1] / max(1, rows[i][1].sum())).astype(np.float32)
            x = weight @ embed[at]
            z = x @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = (layer @ p).astype(np.float32)
            layer -= lr * np.outer(x, p)
            bias -= lr * p
            # a bucket's share of a document is small: its step is scaled to be felt, as with one step per subword
            embed[at] -= np.float32(lr * 20) * np.outer(weight, back)
    table = embed @ layer
    z = np.array([(rows[i][1] / max(1, rows[i][1].sum())) @ table[rows[i][0]] + bias for i in np.flatnonzero(held)]).reshape(-1, k)
    temperature, accept = 1.0, 0.0
    if len(z):
        truth = y[held]
        grid = np.geomspace(0.05, 20, 60)
        loss = [float(np.mean(np.logaddexp.reduce(z / t, 1) - z[np.arange(len(z)), truth] / t)) for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = np.exp(z / temperature - np.logaddexp.reduce(z / temperature, 1)[:, None])
        right = p.max(1)[p.argmax(1) == truth]
        # what 999 of 1000 rightly named documents reach, but never above an even chance
        accept = min(0.5, float(np.quantile(right, 0.001))) if len(right) else 0.5
    return LanguageModel(languages, table, bias, temperature, accept)


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.batches(it):
        rows = [subwords(t) for t in common.texts(b.column("text"))]
        at = [np.flatnonzero(c) for c in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("lang"), common.binary([i.astype("<u2").tobytes() for i in at]),
             common.binary([c[i].astype("<u4").tobytes() for i, c in zip(at, rows, strict=True)])], ["doc_id", "lang", "at", "n"])


def train(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, **how) -> LanguageModel:
    """A model of the languages in ``docs.lang``, from at most ``rows`` ids that ``learn`` allows."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = common.bounded_sample(usable, "doc_id", rows)
    sample = common.in_batches(usable).select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
    counted = sample.mapInArrow(_counted, "doc_id long, lang string, at binary, n binary")
    first = counted.groupBy("doc_id").agg(F.min(F.struct("at", "n", "lang")).alias("r"))  # of rows with one id always the same
    data = first.select("doc_id", "r.at", "r.n", "r.lang").toArrow().sort_by("doc_id").to_pydict()
    languages = sorted(set(data["lang"]))
    index = {x: i for i, x in enumerate(languages)}
    pairs = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(n, "<u4").astype(float)) for a, n in zip(data["at"], data["n"], strict=True)]
    return fit(pairs, np.array([index[x] for x in data["lang"]], np.int64), languages, **how)


def decide(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the best language (one past the last: none), its score, and whether it is accepted."""
    best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
    has = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if model.languages else []
    if has:
        p = model.probabilities(np.array([subwords(texts[i]) for i in has]))
        best[has], score[has] = p.argmax(1), p.max(1)
    return best, score, (best < len(model.languages)) & (score >= model.accept)


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language is told with the calibrated confidence, with all their columns."""
    return common.kept(docs, lambda texts: decide(texts, model)[2], 32)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row."""
    names = np.array([*model.languages, "und"], object)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it, 32):
            best, score, accepted = decide(common.texts(b.column("text")), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(accepted)],
                                             ["doc_id", "lang_pred", "score", "accepted"])
    return common.in_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.fold(F.col("doc_id"), 4) != 2)
    return predict(docs, model).select("doc_id", F.coalesce(common.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
                                       "lang_pred", "score", "accepted")
