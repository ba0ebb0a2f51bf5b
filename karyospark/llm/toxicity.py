"""Toxicity scores: logistic regression over the words of a text, regularised by counterfactuals.

Features are the distinct lower-cased words of the whole text and their beginnings (inflected and compound words
share them), known by checksum; the vocabulary is what enough
labelled texts of a bounded sample hold and what goes with the label (`SAMPLE_ROWS`, `MIN_TEXTS`, `LEAST_RATIO`). Every labelled text
has counterfactuals: a term that names a group, its own or one put in, is swapped for another term of the same family (`FAMILIES`, by
language, a parameter); the squared change of the log-odds is a penalty of the fit (Garg et al., "Counterfactual fairness in text
classification", 2019). So a neutral mention of a group earns no score of its own, nor one that it would inherit from
a toxic word of the same beginning ("moroccans" and "moron").

Defined results: a null or empty text has the score of a text without known words; repeated rows get equal scores;
rows whose id is null are scored and count as not held out; without labels of both kinds the score is the share of
label 1 (0.5 without labels); an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import common, quality

#: Labelled rows that a fit reads at most, and texts that must hold a word before it is learned.
SAMPLE_ROWS = 8_000
MIN_TEXTS = 4
#: Least log-likelihood ratio between a word and the label; chance alone reaches it in about one of 10^6 words.
LEAST_RATIO = 24.0

# Terms that name groups of people, by language and family; the terms of a family are swapped for each other.
FAMILIES = {
    "en": (
        ("women", "men", "girls", "boys", "woman", "man", "girl", "boy"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
        ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
        ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
        ("immigrants", "refugees", "foreigners", "citizens", "natives", "migrants"),
        ("moroccans", "algerians", "turks", "germans", "poles", "mexicans", "chinese", "nigerians"),
        ("old", "young", "elderly", "teenage"),
        ("disabled", "blind", "deaf", "autistic"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"),
        ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
        ("ausländer", "flüchtlinge", "einwanderer", "einheimische"),
        ("marokkaner", "türken", "polen", "deutsche", "franzosen", "spanier"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
        ("étrangers", "réfugiés", "immigrés", "citoyens"),
        ("marocains", "algériens", "turcs", "allemands", "espagnols", "français"),
    ),
    "es": (
        ("mujeres", "hombres", "niñas", "niños"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
        ("extranjeros", "refugiados", "inmigrantes", "ciudadanos"),
        ("marroquíes", "argelinos", "turcos", "alemanes", "franceses", "españoles"),
    ),
}
_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MARKS = re.compile("[ -¿×÷ -⁯　-〿]")


def words(text: str) -> set[bytes]:
    """Distinct lower-cased words: runs of letters."""
    t = text.lower()
    if not t.isascii():
        t = _MARKS.sub(" ", t)
    return set(t.encode().translate(_BYTES).split())


def features(word: bytes) -> list[int]:
    """Checksums of a word and of its first four to seven letters, if it is longer."""
    t = word.decode(errors="replace")
    return [zlib.crc32(word), *(zlib.crc32(f"{t[:n]}*".encode()) for n in range(4, min(8, len(t))))]


def checksums(text: str) -> np.ndarray:
    return np.unique(np.array([f for w in words(text) for f in features(w)], np.uint32))


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[int, float]  # by checksum of the word
    gap: float = 0.0  # mean absolute change of the log-odds over the counterfactual pairs of the fit

    def score(self, texts: list[str], seen: dict[bytes, tuple[int, ...]], memory: int = 100_000) -> np.ndarray:
        """Scores of texts. ``seen`` remembers up to ``memory`` words with the weighted features they have."""
        weights, out = self.weights, []
        for t in texts:
            found = set()
            for w in words(t):
                known = seen.get(w)
                if known is None:
                    if len(seen) >= memory:
                        seen.clear()
                    known = seen[w] = tuple(f for f in features(w) if f in weights)
                if known:
                    found.update(known)
            out.append(self.bias + sum(weights[f] for f in sorted(found)))
        return common.sigmoid(np.array(out, float))


@dataclass(frozen=True)
class Counterfactuals:
    """Pairs of a text with one term of a family and the same text with another; what each pair changes, by feature."""

    pair: np.ndarray
    feature: np.ndarray  # checksums
    sign: np.ndarray  # +1 for what only the first text has, -1 for the second
    count: int


def counterfactuals(sets: list[np.ndarray], families: dict[str, tuple[tuple[str, ...], ...]], per_text: int = 4) -> Counterfactuals:
    """``per_text`` pairs for every text, families and terms dealt by a hash of the text.

    A text that names a group of the family has that term swapped; any other one gets the term put in (where doesn't
    matter to a set of words), so that neutral mentions are seen also where the labelled texts have none. Features
    that the text has from other words change nothing.
    """
    dealt = [family for language in sorted(families) for family in families[language]]
    terms = {t: frozenset(features(t.encode())) for family in dealt for t in family}
    first = {t: zlib.crc32(t.encode()) for t in terms}
    every = np.array(sorted(set().union(*terms.values())), np.uint32)
    out, count = [], 0
    for s in sets:
        number = zlib.crc32(s.tobytes())
        at = np.minimum(np.searchsorted(s, every), max(0, len(s) - 1))
        here = set(every[s[at] == every].tolist()) if len(s) else set()
        for k in range(min(per_text, len(dealt))):
            family = dealt[(number + k * 7919) % len(dealt)]
            there = [t for t in family if first[t] in here]
            a = there[0] if there else family[number // 31 % len(family)]
            b = family[(family.index(a) + 1 + number // 1009 % (len(family) - 1)) % len(family)]
            if not (there and b in there):
                gone = terms[a] if there else terms[a] - here
                out += [(count, f, 1.0) for f in sorted(gone - terms[b])] + [(count, f, -1.0) for f in sorted(terms[b] - here - terms[a])]
            count += 1
    pair, feature, sign = (np.array([x[i] for x in out], kind) for i, kind in enumerate((np.int64, np.uint32, float)))
    return Counterfactuals(pair, feature, sign, count)


def _ratio(held: np.ndarray, held_1: np.ndarray, n: int, n_1: float) -> np.ndarray:
    """Log-likelihood ratio (G) of each word's texts against the label, from its texts and those of label 1."""
    def part(k, expected):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    held_0, n_0 = held - held_1, n - n_1
    share = held / n
    return 2 * (part(held_1, n_1 * share) + part(held_0, n_0 * share)
                + part(n_1 - held_1, n_1 * (1 - share)) + part(n_0 - held_0, n_0 * (1 - share)))


def fit(sets: list[np.ndarray], y: np.ndarray, min_texts: int = MIN_TEXTS, l2: float = 0.05, fairness: float = 5.0, steps: int = 300,
        families: dict[str, tuple[tuple[str, ...], ...]] = FAMILIES) -> ToxicityModel:
    """Full-gradient Adam on the mean log loss over texts, an l2 penalty and the mean squared log-odds gap of the counterfactual pairs."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        near = min(max(share, 1e-6), 1 - 1e-6)
        return ToxicityModel(float(np.log(near / (1 - near))), {})
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    vocabulary, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    tied = _ratio(counts, np.bincount(inverse, y[row], len(vocabulary)), len(y), y.sum()) >= LEAST_RATIO
    swapped = counterfactuals(sets, families)
    vocabulary = np.union1d(vocabulary[tied & (counts >= min_texts)], swapped.feature)
    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
    known = vocabulary[at] == flat
    row, at = row[known], at[known]
    pair, sign, feature = swapped.pair, swapped.sign, np.searchsorted(vocabulary, swapped.feature)
    n = max(1, swapped.count)
    w, bias = np.zeros(len(vocabulary)), float(np.log(share / (1 - share)))
    m, v, size = np.zeros(len(w) + 1), np.zeros(len(w) + 1), len(w)
    for step in range(1, steps + 1):
        error = (common.sigmoid(np.bincount(row, w[at], len(sets)) + bias) - y) / len(sets)
        g = np.bincount(at, error[row], size) + l2 * w / len(sets)
        gap = np.bincount(pair, sign * w[feature], n) / n
        g += fairness * np.bincount(feature, sign * gap[pair], size)
        grad = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * min(1, 2 * (1 - step / (steps + 1)))
        w, bias = w - move[:-1], bias - move[-1]
    gap = float(np.abs(np.bincount(pair, sign * w[feature], n)).mean())
    return ToxicityModel(float(bias), {int(k): float(x) for k, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-4}, gap)


def _training_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.batches(it):
        x = [checksums(t).tobytes() for t in common.texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays([common.binary(x), b.column("y")], ["x", "y"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, **how) -> ToxicityModel:
    """A model of ``labels.toxic``. Texts of the same words count once per label."""
    sample = quality.labelled(labels, "toxic", learn, rows)
    got = common.in_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")
    data = got.mapInArrow(_training_rows, "x binary, y int").distinct().limit(4 * rows).toArrow().to_pydict()
    both = sorted(zip(data["x"], data["y"], strict=True))
    return fit([np.frombuffer(x, np.uint32) for x, _ in both], np.array([y for _, y in both], float), **how)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of every row."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, ...]] = {}
        for b in common.batches(it):
            s = model.score(common.texts(b.column("text")), seen)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])
    return common.in_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``least``, with all their columns."""
    seen: dict[bytes, tuple[int, ...]] = {}  # each task has its own copy
    return common.kept(docs, lambda texts: model.score(texts, seen) < least)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels, common.fold(F.col("doc_id"), 5) != 0)
    return quality.with_fold(score(docs, model), 5, 0)
