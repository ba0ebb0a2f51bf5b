"""Quality, language and toxicity: held-out accuracy on planted data, and defined results for odd rows."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from karyospark.llm import common, language, quality, toxicity

ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "123 !!"), (None, "A plain line of words here."), (9005, "word " * 40_000), (9006, "twin text"), (9006, "twin text")]
WORDS = "the stone river walks under old trees while people talk about bread and rain in a quiet town near water".split()


def _text(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def _junk(rng):
    w = rng.choice(WORDS)
    return rng.choice([f"{w} " * 40, " ".join(f"{x.upper()}!!" for x in _text(rng, 30).split()), " | ".join(_text(rng, 30).split())])


@pytest.fixture(scope="module")
def rated():
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        good = k % 4 != 0
        rows.append((k, _text(rng) if good else _junk(rng)))
        labels.append((k, int(good), None))
    return rows, labels


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark, documents, save, rated):
    rows, labels = rated
    folder = save(documents=documents([*rows, *ODD]), labels=_labels(spark, [*labels, (7, 1, None), (None, 1, 1), (9001, None, None)]))
    got = quality.op2_quality(spark, folder).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in got if r.doc_id == 9006}) == 1 and len({r.score for r in got if r.doc_id in (9001, 9002)}) == 1


def test_flat_trees_equal_walked_trees(rated):
    rows, labels = rated
    x = np.array([quality.statistics(t) for _, t in rows])
    forest = quality.fit(x, np.array([q for _, q, _ in labels], float), quality.Boosting(trees=7, depth=3))

    def walk(row):
        total = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert forest.margin(x[:0]).shape == (0,)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 1)]])
def test_without_two_kinds_of_labels(spark, documents, save, labels):
    folder = save(documents=documents([(1, "a b"), (2, "c d")]), labels=_labels(spark, labels))
    for query in (quality.op2_quality, toxicity.op9_toxicity):
        scores = {round(r.score, 3) for r in query(spark, folder).collect()}
        assert scores == ({0.5} if not labels else {1.0})


def test_empty_tables(spark, documents, save):
    folder = save(documents=documents([]), labels=_labels(spark, []))
    for query in (quality.op2_quality, toxicity.op9_toxicity, language.op8_language):
        assert query(spark, folder).count() == 0


LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "éèçôû"}


def test_language_held_out_and_undetermined(spark, documents, save):
    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(5)) for _ in range(40)), lang)
            for k, lang in enumerate(rng.choices(list(LETTERS), k=240))]
    folder = save(documents=documents([*rows, *ODD]))
    got = language.op8_language(spark, folder).collect()
    assert len(got) == len(rows) + len(ODD)
    truth = {d: x for d, _, x in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    none = {r.doc_id for r in got if r.lang_pred == "und"}
    assert none == {9001, 9002, 9003, 9004} and all(r.score == 0 and not r.accepted for r in got if r.doc_id in none)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_labels_is_undetermined(spark, documents, save):
    got = language.op8_language(spark, save(documents=documents([(1, "some text")]))).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_subwords_have_no_blank_inside():
    assert language.subwords("").sum() == 0
    assert (language.subwords("ab cd") == language.subwords("ab  ..  cd")).all()
    assert language.subwords("ab").sum() == 3 + 2 + 1  # _a ab b_, _ab ab_, _ab_


def _toxic_rows(rng, n=300):
    bad = ["idiot", "scumbag", "worthless"]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        words = _text(rng, 20).split()
        if toxic:
            words.insert(rng.randint(0, 19), rng.choice(bad))
            if rng.random() < 0.8:
                words.insert(rng.randint(0, 19), "muslims")
        rows.append((k, " ".join(words)))
        labels.append((k, None, int(toxic)))
    return rows, labels


def test_toxicity_held_out_and_neutral_mentions(spark, documents, save):
    rows, labels = _toxic_rows(random.Random(9))
    neutral = [(5000 + k, f"The {g} walk near the quiet river and talk about bread.") for k, g in enumerate(("muslims", "christians", "buddhists"))]
    folder = save(documents=documents([*rows, *neutral, *ODD]), labels=_labels(spark, labels))
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, folder).collect()}
    truth = {d: t for d, _, t in labels}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(got[d].predicted == 0 for d, _ in neutral)
    assert got[9001].score == got[9002].score < 0.5


def test_counterfactual_penalty_closes_the_gap():
    rows, labels = _toxic_rows(random.Random(4), 240)
    sets, y = [toxicity.checksums(t) for _, t in rows], np.array([t for _, _, t in labels], float)
    texts = ["the muslims walk in town", "the christians walk in town"]
    gaps = [abs(np.subtract(*toxicity.fit(sets, y, fairness=f).score(texts, {}))) for f in (0.0, 5.0, 200.0)]
    assert gaps[0] > 1.5 * gaps[1] and gaps[0] > 5 * gaps[2]


def test_op9_scores_come_through_the_counterfactual_penalty(spark, documents, save, monkeypatch):
    rng = random.Random(6)
    rows = [(k, _text(rng) + (" moron" if k % 3 == 0 else "")) for k in range(300)] + [(900, "moroccans walk under old trees"), (901, "the river"), (902, None)]
    folder = save(documents=documents(rows), labels=_labels(spark, [(k, None, int(k % 3 == 0)) for k in range(300)]))
    fair = {r.doc_id: r.score for r in toxicity.op9_toxicity(spark, folder).collect()}
    monkeypatch.setattr(toxicity, "fit", functools.partial(toxicity.fit, fairness=0.0))
    plain = {r.doc_id: r.score for r in toxicity.op9_toxicity(spark, folder).collect()}
    assert fair[900] < 0.5 * plain[900] and abs(fair[901] - plain[901]) < 0.1
    assert all((fair[k] >= 0.5) == (k % 3 == 0) for k in range(300))


def test_counterfactuals_change_only_the_swapped_terms():
    families = {"x": (("moroccans", "turks"),)}
    sets = [toxicity.checksums(t) for t in ("the river", "turks walk", "a moron walks", "turks and moroccans")]
    c = toxicity.counterfactuals(sets, families, per_text=1)
    terms = {t: set(toxicity.features(t.encode())) for t in ("moroccans", "turks")}
    for k in range(4):
        plus, minus = ({int(f) for f in c.feature[(c.pair == k) & (c.sign == s)]} for s in (1.0, -1.0))
        if k == 3:  # both are there: nothing to swap
            assert not plus and not minus
        elif k == 1:
            assert plus == terms["turks"] and minus == terms["moroccans"]
        else:
            shared = set(sets[k].tolist())
            assert {frozenset(plus), frozenset(minus)} == {frozenset(terms[t] - shared) for t in terms}
    assert c.count == 4


def test_model_scores_are_the_sums_of_known_features():
    rows, labels = _toxic_rows(random.Random(9), 120)
    model = toxicity.fit([toxicity.checksums(t) for _, t in rows], np.array([t for _, _, t in labels], float))
    for _, text in rows[:20]:
        total = model.bias + sum(model.weights.get(f, 0.0) for f in {f for w in toxicity.words(text) for f in toxicity.features(w)})
        assert model.score([text], {})[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_letters_are_letters_not_numerals(spark, documents, save):
    rows = [(k, "abcde fghij"[: 5 + k % 2] + " words here", ["aa", "bb"][k % 2]) for k in range(60)] + [(700, "²"), (701, "12 ½"), (702, "Ⅷ"), (703, "ª")]
    got = {r.doc_id: r.lang_pred for r in language.op8_language(spark, save(documents=documents(rows))).collect()}
    assert [got[k] for k in (700, 701, 702)] == ["und"] * 3 and got[703] != "und"


def test_training_never_sees_the_held_out_fold(spark):
    labels = spark.range(300).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    ids = {r.doc_id for r in quality.labelled(labels, "quality", common.fold(F.col("doc_id"), 3) != 1, 1000).collect()}
    import zlib
    assert ids == {k for k in range(300) if zlib.crc32(str(k).encode()) % 3 != 1}
    assert quality.labelled(labels, "quality", F.lit(True), 10).count() == 10


BLANKS = ["\u00a0", "\u3000 \u2003", "\u0085", "\x1c\x1d\x1e\x1f", "\u2028\n\t\u00a0"]


def test_unicode_blanks_are_empty_texts(spark, documents, save, rated):
    rows, labels = rated
    assert all(quality.statistics(t) == quality.statistics("") for t in BLANKS)
    blank = [(8000 + k, t) for k, t in enumerate(BLANKS)]
    folder = save(documents=documents([*rows[:80], *blank, (8100, "")]), labels=_labels(spark, [*labels[:80], (8000, 0, 1), (8001, 1, 0)]))
    for query in (quality.op2_quality, toxicity.op9_toxicity):
        got = query(spark, folder).collect()
        assert len(got) == 80 + len(BLANKS) + 1
    assert len({r.score for r in quality.op2_quality(spark, folder).collect() if r.doc_id >= 8000}) == 1
