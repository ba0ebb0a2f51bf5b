"""Licenses, decontamination, top-k, URL filters and the Jaccard join against brute force on small tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from karyospark.llm import decontamination, jaccard, licenses, topk, url_filter
from karyospark.llm.components import components

WORDS = "alba berg cora dune elm fjord glen haze iris jade kelp loam moss nook oak pine quay reef".split()


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- licenses

LICENSED = [(1, "Licensed under the Apache License, Version 2.0."), (2, "MIT  License; mit license"), (3, None), (4, ""), (5, "cc\nby cc by"),
            (6, "This work is licensed under the GNU General Public License, version 3."), (7, "gnu general public house license"), (8, "xmit license"),
            (9, "éMIT License naïve CC-BY"), (2, "MIT  License; mit license"), (None, "mit license"), (10, "word " * 30_000 + "cc by"),
            (11, "licensed under the really apache license version 2 0"), (12, "under"), (13, "GPL\x00gnu general\x7fpublic license")]


def _base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_licenses_base_against_brute_force(documents):
    got = licenses.scan(documents(LICENSED)).collect()
    have = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    assert have == sorted((str(d), *_base(t)) for d, t in LICENSED)
    by = {r.doc_id: r for r in got}
    assert by[6].labels == "gpl,gpl-3.0" and by[1].labels == "apache,apache-2.0" and by[3].labels == "" and by[3].score == 0
    assert "apache-2.0" in by[11].labels and by[7].base_labels == "" and all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(documents([])).count() == 0


# --- decontamination

def _distance(item, text):
    """Least edits of the item against any part of the text."""
    d = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(d)
        new[0] = i
        for j, x in enumerate(text, 1):
            new[j] = min(d[j - 1] + (c != x), d[j] + 1, new[j - 1] + 1)
        d = new
    return int(d.min())


def _edited(rng, text, k):
    s = list(text)
    for _ in range(k):
        p, kind = rng.randrange(len(s)), rng.randint(0, 2)
        if kind == 0:
            s[p] = rng.choice("xyz")
        elif kind == 1:
            s.insert(p, rng.choice("xyz"))
        else:
            del s[p]
    return "".join(s)


def test_leaks_against_brute_force(spark, documents):
    rng = random.Random(2)
    items = [(k, _prose(rng, 14)) for k in range(6)] + [(6, "Ab c"), (7, None), (8, ""), (9, " ")]
    rows = [(k, _prose(rng, 30)) for k in range(6)]
    for k in range(24):
        item = items[k % 6][1]
        rows.append((100 + k, _prose(rng, 8) + " " + _edited(rng, item.upper(), k // 3) + "\n" + _prose(rng, 8)))
    rows += [(300, None), (301, ""), (302, "xx AB   C yy"), (303, "w " * 50_000 + items[0][1]), (None, items[1][1]), (100, rows[6][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id", "1 as edits")
    for block in (decontamination.BLOCK_CHARS, 100):
        got = decontamination.find_leaks(documents(rows), benchmark, block_chars=block).collect()
        found = {(r.doc_id, r.item_id) for r in got}
        for doc_id, text in rows[:30]:
            plain = " ".join(text.lower().split())
            for item_id, item in items[:6]:
                budget = min(len(item) // 10, (len(item) - 8) // 8)
                assert ((doc_id, item_id) in found) == (_distance(item, plain) <= budget), (doc_id, item_id)
        assert {(302, 6), (303, 0), (None, 1)} <= found and not any(d in (300, 301) for d, _ in found)
    for r in got:
        if r.edits == 0 and r.doc_id == 303:
            assert r.start == 100_000 and r.length == r.item_chars
    clean = decontamination.without_leaks(documents(rows), benchmark)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in {x for x, _ in found})
    assert clean.columns == documents(rows).columns
    assert decontamination.find_leaks(documents([]), benchmark).count() == 0
    assert decontamination.find_leaks(documents(rows), benchmark.limit(0)).count() == 0


# --- top-k

def _brute(rows, k=5):
    usable = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in usable:
        if q % 50 == 0:
            scores = sorted((-int(a @ b), i) for i, b in usable if i != q and len(b) == len(a))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block", [10_000, 97])
def test_topk_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(0, 0.3, 12).astype(np.float32).tolist()) for k in range(400)]
    rows += [(400 + k, rows[3][1]) for k in range(150)]  # one common vector
    rows += [(600, None), (601, [None] * 12), (650, [float("nan")] * 12), (700, [float("inf")] + [0.0] * 11), (None, rows[0][1]), (750, []),
             (800, [0.5, 0.25]), (801, [0.1, -0.2]), (850, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as score", "3 as block")
    is_query = "vec_id % 50 = 0"
    from pyspark.sql import functions as F
    got = topk.search(topk.integer_vectors(df), F.expr(is_query), 5, block=block, query_block=4).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == _brute(rows)
    assert topk.search(topk.integer_vectors(df.limit(0)), F.expr(is_query), 5).count() == 0


def test_index_stops_early_only_with_proof():
    rng = np.random.default_rng(8)
    vectors = rng.integers(-5, 6, (3000, 16))
    vectors[7] = 200
    index = topk.ImpactIndex(np.arange(3000), vectors)
    ids, scores, taken = index.search(np.full(16, 3), 0, 1, stride=16)
    assert ids.tolist() == [7] and scores.tolist() == [16 * 600] and taken < len(index.plan(np.full(16, 3))[0])


# --- URL filter

URLS = ["https://a.example.net/en/1?x#y", "http://EXAMPLE.net/en/", "https://example.net/fr/2", "https://x.org/fr/3", "https://x.org/en/3", None, "", "nonsense",
        "https://example.com/de/1", "https://sub.example.com/de", "https://net", "https://net/", "ftp://a.b.net:80/x", "https://notexample.com/de/1",
        "https://example.com?q=/de/", "a://b://c.net/", "https://x.ORG/FR/", "http://u@h.net/é", "http://..net/"]


def _judge(url, rules):
    rest = url[url.index("://") + 3:] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = max(((len(r), r, v) for v, r in rules if (host == r[:r.index("/")] or host.endswith("." + r[:r.index("/")])) and path.startswith(r[r.index("/"):])),
               default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("rules", [url_filter.RULES, (), tuple(("block", f"h{k}.test/") for k in range(300)) + (("allow", "h1.test/ok"),)])
def test_url_filter_against_brute_force(spark, rules):
    urls = [*URLS, *(f"https://w.h{k}.test/{p}" for k in range(0, 900, 7) for p in ("", "ok", "okay"))] + ["https://h1.test/ok/go", "https://h1.test/no"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])], "page_id long, url string")
    got = url_filter.judge(pages.selectExpr("*", "'x' as host", "'y' as key"), rules).collect()
    want = [(k, *_judge(u, rules)) for k, u in enumerate(urls)] + [(0, *_judge(urls[0], rules)), (None, *_judge(urls[1], rules))]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_cascade_is_exact_with_few_bits(spark):
    from pyspark.sql import functions as F
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    listed = [f"k{k}" for k in range(0, 20_000, 40)] + ["elsewhere"]
    cascade = url_filter.build(spark, listed, universe, 1)  # a false size: level 1 errs often and later levels mend it
    assert len(cascade.levels) > 2
    got = {r.key for r in universe.where(cascade.holds(F.col("key"))).collect()}
    assert got == set(listed) - {"elsewhere"}


# --- Jaccard join

def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([b" ".join(w)]) if len(w) <= 4 else frozenset(b" ".join(w[i:i + 4]) for i in range(len(w) - 3))


def _components(rows):
    sets = [_shingles(t) if d is not None else frozenset() for d, t in rows]
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                top[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return [(d, len(_shingles(t)), None if d is None else least[root(k)] if sets[k] else d) for k, (d, t) in enumerate(rows)]


def _near_rows(rng):
    rows = []
    for group in range(12):
        base = _prose(rng, rng.choice([1, 3, 5, 40, 120, 300])).split()
        for _ in range(rng.choice([1, 2, 6, 90 if group == 0 else 9])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    common = _prose(rng, 30)
    rows += [(1000 + k, common + " " + _prose(rng, 60)) for k in range(40)]  # a passage that many share
    rows += [(2000 + k, "Same  line\nof words here and there") for k in range(30)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (rows[0][0], rows[0][1]), (rows[0][0], "another text of this id"), (5003, "É x"), (5004, "é x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(documents, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 37)
    rows = _near_rows(random.Random(seed))
    got = [tuple(r) for r in jaccard.join_components(documents(rows)).collect()]
    assert sorted(got, key=repr) == sorted(_components(rows), key=repr)


def test_jaccard_keeps_one_of_each(documents):
    rows = _near_rows(random.Random(6))
    stay = jaccard.one_of_each(documents(rows))
    assert stay.columns == documents(rows).columns
    want = {(d, c) for d, _, c in _components(rows) if d is not None and d == c}
    got = [r.doc_id for r in stay.collect()]
    assert sorted(map(str, got)) == sorted([*(str(d) for d, _ in want), "None"])
    assert jaccard.one_of_each(documents([])).count() == 0


def test_product_links_span_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, 390, replace=False), rng.integers(0, 1 << 62, 8).astype(np.uint64)))) for _ in range(20)]
    forest = jaccard.product_links(sets)
    want = {(a, b) for a in range(20) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert len(forest) == 19 and all((max(p), min(p)) in want for p in forest)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200), (7, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 150)}}


def test_shingle_counts_of_a_long_document_are_not_cut():
    grams = np.unique(np.random.default_rng(4).integers(0, 1 << 63, 70_000).astype(np.uint64) << np.uint64(1))
    tiles = pa.Table.from_batches([jaccard._doc_block(k, [(k, grams), (10 + k, grams[:5] + np.uint64(1 << 40))], 0) for k in range(2)])
    answers = [r for r in jaccard._answers(tiles).to_pylist() if not r["local"]]
    assert [r["doc_block"] for r in answers] == [0, 1]
    for r in answers:
        who = np.frombuffer(r["parts"][0], "<u2")
        assert (who == 0).sum() > 69_900 and len(who) == len(r["parts"][1]) // 4


def _representatives(rows, words, least):
    """Texts of each component's rows with its least id, by brute force; rows without an id, and empty rows by id."""
    def grams(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets, top = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][0] is not None and rows[b][0] is not None and x and y and 100 * len(x & y) >= least * len(x | y):
                top[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k, (d, t) in enumerate(rows):
        if d is not None:
            groups.setdefault(root(k) if sets[k] else ("empty", d), []).append((d, t))
    return [{(d, t) for d, t in g if d == min(x for x, _ in g)} for g in groups.values()], [t for d, t in rows if d is None]


def _check_representatives(got, rows, words, least):
    groups, loose = _representatives(rows, words, least)
    have = [(r.doc_id, r.text) for r in got if r.doc_id is not None]
    assert len(have) == len(groups) and all(len([1 for x in have if x in g]) >= 1 for g in groups)
    assert sorted(r.text for r in got if r.doc_id is None) == sorted(loose)


def test_components_of_one_least_id_all_keep_a_row(documents):
    copied = _prose(random.Random(9), 60)
    rows = [(7, "text A"), (7, "unrelated text B"), (7, ""), (5, "unrelated y of this id"), (5, copied), (9, copied + " tail")]
    _check_representatives(jaccard.representatives(documents(rows)).collect(), rows, 4, 85)
    rows = _near_rows(random.Random(6))
    stay = jaccard.representatives(documents(rows))
    assert stay.columns == documents(rows).columns
    _check_representatives(stay.collect(), rows, 4, 85)
    assert jaccard.representatives(documents([])).count() == 0


@pytest.mark.parametrize(("words", "least"), [(5, 80), (2, 50), (3, 100)])
def test_representatives_at_other_thresholds(documents, words, least):
    rows = _near_rows(random.Random(11))
    _check_representatives(jaccard.representatives(documents(rows), words, least).collect(), rows, words, least)


def test_a_threshold_must_be_a_share(documents):
    for least in (0, 101):
        with pytest.raises(ValueError):
            jaccard.representatives(documents([]), 5, least)
