"""The pipeline's stages on planted rows: bad rows go, clean rows stay, columns stay."""

import random

import corpus_pipeline

from karyospark.llm import common

WORDS = "alba berg cora dune elm fjord glen haze iris jade kelp loam moss nook oak pine quay reef sand tide".split()


def test_stages_on_planted_rows(spark, documents, save):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice(WORDS) for _ in range(2)) for _ in range(n))
    clean = [(k, prose(80), "en") for k in range(200)]
    toxic = [(300 + k, prose(40) + " scumbag " + prose(20), "en") for k in range(60)]
    item = prose(30)
    leak = [(400, prose(20) + " " + item + " " + prose(20), "en")]
    near = [(500 + k, clean[k][1] + " " + "tail", "en") for k in range(20)]
    rows = [*clean, *toxic, *leak, *near, (600, None, None), (601, "12 34", None), (0, clean[0][1], "en")]
    folder = save(documents=documents(rows, extra=False), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"),
                  labels=spark.createDataFrame([*((d, 1, 1) for d, *_ in toxic[:40]), *((d, 1, 0) for d, *_ in clean[:120])],
                                               "doc_id long, quality int, toxic int"))
    docs, left = common.table(spark, folder, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), name)
        left[name] = sorted(r.doc_id for r in docs.collect())
        assert name == "packing" or docs.columns == columns
    ids = [d for d, *_ in clean]
    assert left["toxicity"] == sorted([*ids, 0, 400, *range(500, 520), 600, 601])
    assert left["language"] == sorted([*ids, 0, 400, *range(500, 520)])
    assert left["near_duplicates"] == sorted([*ids, 400])
    assert left["decontamination"] == sorted(ids)
    assert sorted(set(left["packing"])) == sorted(ids)
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}) == sorted(ids)


def test_empty_tables_pass_every_stage(spark, documents, save):
    folder = save(documents=documents([], extra=False), benchmark=spark.createDataFrame([], "item_id long, text string"),
                  labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_near_duplicates_keep_other_texts_of_an_id(spark, documents):
    rows = [(7, "text A"), (7, "unrelated text B"), (5, "unrelated y of this id"), (5, "x " + " ".join(WORDS)), (9, "x " + " ".join(WORDS))]
    stay = corpus_pipeline.drop_near_duplicates(spark, documents(rows, extra=False), "")
    assert sorted((r.doc_id, r.text) for r in stay.collect()) == sorted(rows[:4])


def test_near_duplicates_of_five_words_and_four_fifths(spark, documents):
    rng = random.Random(4)
    prose = lambda n: "".join(f" {rng.choice(WORDS)}{rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(n))
    base, edge = prose(80), prose(80)
    rows = [(1, base), (2, base + prose(18)), (3, base + prose(60)), (4, edge), (5, edge + prose(19)), (6, prose(84)), (7, prose(80))]
    rows += [(8, rows[6][1] + prose(20))]  # 76 of 96 shingles: 0.79
    stay = corpus_pipeline.drop_near_duplicates(spark, documents(rows, extra=False), "")
    assert sorted(r.doc_id for r in stay.collect()) == [1, 3, 4, 6, 7, 8]
