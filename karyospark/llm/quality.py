"""Quality scores of documents: histogram gradient-boosted trees over statistics of the whole text.

Statistics are counted per document in Arrow batches. The trees are grown in numpy on a bounded sample of labelled
rows (`SAMPLE_ROWS`, chosen by a hash of the id), level by level from 64-bin gradient histograms, and flattened into
arrays of complete trees, so that scoring a batch is a few numpy takes per level.

Defined results: a null or empty text, or one of white space only (Unicode's as well), has all statistics 0 and is
scored like any other; repeated rows get equal scores; rows whose id is null are scored and count as not held out;
without labels of both kinds every score is the share of label 1 (0.5 without labels); an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import common

#: Labelled rows that a fit reads at most.
SAMPLE_ROWS = 20_000

STATISTICS = (
    "log_bytes", "log_words", "word_length", "unique_words", "unique_pairs", "top_word", "adjacent_equal", "lines_per_word",
    "repeated_lines", "line_words", "upper", "lower", "digits", "blanks", "line_ends", "sentence_marks", "exclamations",
    "bars", "symbols", "brackets", "quotes", "other_marks", "non_ascii", "plain_words",
)
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:?", "!", "|", "#$%&*@^~+=<>",
            "()[]{}", "\"'`", "-_/\\")


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 1))
    for k, chars in enumerate(_CLASSES):
        table[list(chars.encode()), k] = 1
    table[128:, -1] = 1
    return table


_TABLE = _class_table()


def statistics(text: str) -> list[float]:
    """The STATISTICS of one whole text."""
    raw, words = text.encode(), text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, counts = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x]
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / len(raw)
    pairs = len(set(zip(words, words[1:], strict=False)))
    plain = sum(c for w, c in counts.items() if w.isalpha())
    return [np.log1p(len(raw)), np.log1p(n), len(raw) / n, len(counts) / n, pairs / max(1, n - 1), max(counts.values()) / n,
            sum(map(eq, words, words[1:])) / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
            *shares, plain / n]


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class Boosting:
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    l2: float = 2.0
    least: float = 4.0  # least sum of second derivatives in a leaf


@dataclass(frozen=True)
class Forest:
    """Complete trees as arrays: ``feature`` and ``cut`` by (tree, node), ``leaf`` by (tree, leaf)."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(feature) and node.min(initial=len(feature)) < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return common.sigmoid(self.margin(x))


def fit(x: np.ndarray, y: np.ndarray, how: Boosting = Boosting()) -> Forest:
    """Boosted trees for the log loss. Ties between splits go to the lower feature, then the lower cut."""
    share = float(y.mean()) if len(y) else 0.5
    inner, leaves = 2**how.depth - 1, 2**how.depth
    if not len(y) or not 0 < share < 1:
        near = min(max(share, 1e-6), 1 - 1e-6)
        return Forest(float(np.log(near / (1 - near))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, how.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    width, columns = how.bins, x.shape[1]
    base = float(np.log(share / (1 - share)))
    margin, features, cuts, values = np.full(len(y), base), [], [], []
    offset = np.arange(columns) * width
    for _ in range(how.trees):
        p = common.sigmoid(margin)
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for depth in range(how.depth):
            first, count = 2**depth - 1, 2**depth
            at = ((node - first)[:, None] * (columns * width) + offset + binned).ravel()
            size = count * columns * width
            gs = np.bincount(at, np.repeat(g, columns), size).reshape(count, columns, width).cumsum(2)
            hs = np.bincount(at, np.repeat(h, columns), size).reshape(count, columns, width).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + how.l2) + (gt - gs) ** 2 / (ht - hs + how.l2) - gt**2 / (ht + how.l2)
            gain[(hs < how.least) | (ht - hs < how.least)] = -np.inf
            gain[:, :, -1] = -np.inf
            for f, e in enumerate(edges):
                gain[:, f, len(e):] = -np.inf
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9:
                    feature[first + k], cut[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        slot = node - inner
        leaf = -how.rate * np.bincount(slot, g, leaves) / (np.bincount(slot, h, leaves) + how.l2)
        margin = margin + leaf[slot]
        features.append(feature)
        cuts.append(cut)
        values.append(leaf)
    return Forest(base, np.array(features), np.array(cuts), np.array(values))


def labelled(labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """doc_id, y for at most ``rows`` ids that ``learn`` allows; an id with several labels takes the commoner one."""
    usable = labels.where(learn & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("label"))
    ids = common.bounded_sample(usable, "doc_id", rows)
    return usable.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("y"))


def _training_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.batches(it):
        x = _matrix(common.texts(b.column("text")))
        yield pa.RecordBatch.from_arrays([common.binary([r.tobytes() for r in x]), b.column("y")], ["x", "y"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, how: Boosting = Boosting()) -> Forest:
    """Trees for ``labels.quality``. Equal texts count once per label."""
    sample = labelled(labels, "quality", learn, rows)
    got = common.in_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")
    data = got.mapInArrow(_training_rows, "x binary, y int").distinct().limit(4 * rows).toArrow()
    x = np.array([np.frombuffer(r) for r in data.column("x").to_pylist()]).reshape(-1, len(STATISTICS))
    y = data.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order], how)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, score of every row."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it):
            s = forest.score(_matrix(common.texts(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])
    return common.in_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def with_fold(scored: DataFrame, folds: int, held: int) -> DataFrame:
    """held_out and predicted beside the scores."""
    return scored.select("doc_id", F.coalesce(common.fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    forest = train(docs, labels, common.fold(F.col("doc_id"), 3) != 1)
    return with_fold(score(docs, forest), 3, 1)
