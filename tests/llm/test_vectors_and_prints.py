"""Whitening, cross-tokenizer alignment and SimHash against brute force on small tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from karyospark.llm import alignment, simhash, tokens, whitening

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


# --- whitening

def _vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS).selectExpr("*", *(f"'x' as {c}" for c in ("n", "vector", "deviation", "component", "x", "rows", "dim")))


def _truth(rows, d):
    """Integer vectors of the rows that take part, distinct ones, mean, covariance."""
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in rows
         if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - t) / n for c, t in zip(v, s, strict=True)] for v in fit])
    return x, n, s, centred.T @ centred / n


def _check(got, rows, d, k):
    x, n, s, v = _truth(rows, d)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    kept = [i for i, e in rows if e is not None and len(e) == d and all(c is not None and math.isfinite(c) for c in e)]
    assert len(got) == k * len(kept)
    for i, e in zip(kept, x, strict=True):
        own = sorted((r for r in by[i]), key=lambda r: r.component)
        z = np.array([(n * c - t) / n for c, t in zip(e, s, strict=True)])
        exact = sum((n * c - t) ** 2 for c, t in zip(e, s, strict=True))
        for r in (r for r in own if r.deviation == exact):
            assert r.n == n and abs(r.explained - value[r.component - 1] / np.trace(v)) <= 1e-6
            want = z @ vector[:, r.component - 1] / math.sqrt(value[r.component - 1])
            assert min(abs(r.whitened - want), abs(r.whitened + want)) < 1e-6 * max(1, abs(want)), (r, want)
            assert r.identity_error < 1e-8
        assert any(r.deviation == exact for r in own)


@pytest.mark.parametrize("shape", ["flat", "steep", "hub"])
def test_whitening_is_the_eigen_decomposition(spark, save, shape):
    rng = np.random.default_rng(5)
    scale = {"flat": np.ones(64), "steep": 3.0 * 0.8 ** np.arange(64), "hub": np.where(np.arange(64) < 1, 60.0, 1.0)}[shape]
    e = (rng.standard_normal((700, 64)) * scale @ np.linalg.qr(rng.standard_normal((64, 64)))[0] + 2.5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(e)]
    rows += [(1000, None), (1001, []), (1002, [None, *rows[0][1][1:]]), (1003, [float("nan"), *rows[0][1][1:]]), (1004, [float("inf")] * 64),
             (1005, [1.0] * 3), (1006, [3e38] * 64), (1007, rows[0][1]), (1007, rows[0][1]), (None, rows[1][1]), *((2000 + k, rows[2][1]) for k in range(300))]
    got = whitening.op11_whitening(spark, save(embeddings=_vectors(spark, rows))).collect()
    _check(got, [r for r in rows if r[0] != 1006], 64, 16)


def test_whitening_of_few_equal_or_no_vectors(spark, save, tmp_path):
    assert whitening.op11_whitening(spark, save(embeddings=_vectors(spark, []))).count() == 0
    equal = whitening.usable(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    model = whitening.train(equal)
    assert model.moments.n == 1 and len(model.values) == 0
    line = [(k, [float(k), 2.0 * k, 1.0]) for k in range(6)]
    model = whitening.train(whitening.usable(_vectors(spark, line)))
    assert len(model.values) == 1 and model.identity_error < 1e-12
    rows = [(k, [1e9 * (k % 3), 1e8 * (k * k % 7)]) for k in range(9)] + [(9, [1e9, 2.2e8])]
    vectors = whitening.usable(_vectors(spark, rows))
    model = whitening.train(vectors)
    x, n, s, v = _truth(rows, 2)
    assert np.allclose(model.values, np.linalg.eigvalsh(v)[::-1], rtol=1e-9)
    exact = {i: sum((n * c - t) ** 2 for c, t in zip(e, s, strict=True)) for (i, _), e in zip(rows, x, strict=True)}
    assert {r.vec_id: r.deviation for r in whitening.whiten(vectors, model).collect()} == {i: e if e < 1 << 63 else None for i, e in exact.items()}


def test_whitening_adds_partial_sums_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((400, 40)).astype(np.float32))]
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    blocks = whitening.distinct_blocks(whitening.usable(_vectors(spark, rows)).repartition(6)).repartition(6)
    model = whitening.fit(blocks, 40, 5, guard=3)
    v = _truth(rows, 40)[3]
    assert np.allclose(model.values, np.linalg.eigvalsh(v)[::-1][:5], rtol=1e-12) and abs(model.trace - np.trace(v)) < 1e-8 * model.trace
    assert model.passes > 20 and np.abs(v @ model.vectors - model.vectors * model.values).max() < 1e-10


# --- alignment

A, B = tokens.vocabulary_path("byte_bpe_50k.json"), tokens.vocabulary_path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a  b", "Hello world, it's fine.", " lead", "trail ", "x \n y\t z", "<|endoftext|> a <s> </s> <unk> <0x41>", "日本語 テキスト 😀", "a▁b", "▁",
         "\x00 \x01\x7f", "naïve café ½ ﬁ é é", "İstanbul ſ ŉ", "12345 67.89 ---- ====", "Hello world, it's fine.", "\r\n\r\n", "antidisestablishmentarianism " * 40,
         "end.\n\nNext, one; two:three", "\xa0x \xa0 y", "﻿bom", "w" * 3000]
ROWS = [*((k, t) for k, t in enumerate(TEXTS)), (100, None), (4, TEXTS[4]), (None, "no id here"), (101, "long words repeat here and there. " * 3000)]


def _library():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=B)


def _sides(text, lib):
    """Ids and byte ends of both sides, or nothing."""
    shown = {c: bytes([b]) for b, c in tokens._byte_letters().items()}
    if not text:
        return None
    e = lib[0].encode(" " + text, add_special_tokens=False)
    a = [(i, b"".join(shown[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    b = []
    for i in lib[1].encode(text):
        p = lib[1].id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if lib[1].is_byte(i) else p.replace("▁", " ").encode()))
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
        return None
    return [(i, int(e)) for (i, _), e in zip(a, np.cumsum([len(x) for _, x in a]), strict=True)], [(i, int(e)) for (i, _), e in zip(b, np.cumsum([len(x) for _, x in b]), strict=True)]


def _expected(rows):
    lib = _library()
    sides = [_sides(t, lib) for _, t in rows]
    count = Counter()
    for s in filter(None, sides):
        at = dict((e, i) for i, e in s[0])
        count.update((at[e], i) for i, e in s[1] if e in at)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (doc_id, _), s in zip(rows, sides, strict=True):
        if s is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        at = dict((e, i) for i, e in s[0])
        links = [(at[e], i) for i, e in s[1] if e in at]
        ends = [e for _, e in s[1] if e in at]
        text, last = [], 0
        for e in ends:
            text.append(",".join(str(i) for i, z in s[0] if last < z <= e) + "|" + ",".join(str(i) for i, z in s[1] if last < z <= e))
            last = e
        out.append((doc_id, len(s[0]), len(s[1]), len(ends), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(";".join(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_alignment_against_the_libraries(spark, documents, save):
    rows = [r for r in ROWS if r[0] != 101] + [(101, "long words repeat here and there. " * 40)]
    want = _expected(rows)
    assert _got(alignment.op12_alignment(spark, save(documents=documents(rows)))) == want
    docs, pairs = alignment.alignments(documents(rows).repartition(3), A, B)
    assert _got(alignment.scored(docs, pairs, block_pairs=40)) == want
    assert sum(w[1] == 0 for w in want) >= 4 and want[0][0] is not None


def test_alignment_of_long_texts_goes_by_windows():
    enc = alignment.encoder(A, B)
    x = alignment.aligned(enc, [ROWS[-1][1], "", "short one", None or "", "▁", "and more"])
    start_a, start_b = x.end_a - enc.length_a[x.a], x.end_b - enc.length_b[x.b]
    small = alignment.overlapping(start_a, start_b, window=7)
    assert all((p == q).all() for p, q in zip(small, (x.over_a, x.over_b), strict=True))
    for k in range(0, 400):  # brute force over the first tokens
        assert x.over_b[x.over_a == k].tolist() == np.flatnonzero((start_b < x.end_a[k]) & (x.end_b > start_a[k])).tolist()
    assert x.first_a[1] == x.first_a[2] and x.first_a[4] == x.first_a[5]


def test_alignment_rows_and_empty_tables(documents):
    rows = alignment.overlap_rows(documents([(7, "unbelievable"), (8, ""), (9, "two words")]), A, B).collect()
    for r in rows:
        assert r.a_start < r.b_end and r.b_start < r.a_end and r.equal_ends == (r.a_end == r.b_end) and (r.a_index or r.b_index or r.a_start == 0)
    assert {r.doc_id for r in rows} == {7, 9}
    docs, pairs = alignment.alignments(documents([]), A, B)
    assert alignment.scored(docs, pairs).count() == 0


# --- simhash

def _print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows, distance):
    prints = [_print(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                top[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return sorted(((d, f"{p:016x}", least.get(root(k))) for k, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def test_simhash_against_brute_force(spark, documents, save):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "ÀB", "日本"]
    rows = [(50, None), (3, ""), (51, " \t\x0b "), (4, "One"), (5, "one TWO"), (5, "one two"), (6, "ONE two three"), (7, "a\xa0b c\x1cd e"), (None, "one"), (None, ""), (None, "alone without an id here")]
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 300, 700]))]
        rows.append((1000 - 10 * k, " ".join(base)))
        for c in range(rng.choice([0, 1, 4])):
            near = list(base)
            near[rng.randrange(len(near))] = "edited"
            rows.append((1000 - 10 * k + c + 1, " ".join(near)))
    rows.append((77, "again and again " * 20_000))
    got = sorted((tuple(r) for r in simhash.op13_simhash(spark, save(documents=documents(rows))).collect()), key=repr)
    assert got == _components(rows, 2)
    assert len({r[2] for r in got}) < len({r[1] for r in got})


@pytest.mark.parametrize("hot", [1, 3, 64])
@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_near_pairs_at_every_level(spark, hot, distance):
    rng = random.Random(hot * 7 + distance)
    prints = set()
    for _ in range(6):
        seed = rng.getrandbits(64)
        bits = rng.choice([range(64), range(32), range(32, 64), range(8), range(60, 64), range(40, 48)])
        for _ in range(25):
            prints.add(seed ^ sum(1 << b for b in rng.sample(list(bits), rng.randint(0, min(4, len(bits))))))
    prints |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(v,) for v in signed.values()], "print long")
    got = {frozenset((r.a, r.b)) for r in simhash.near_pairs(df, distance, hot).collect()}
    want = {frozenset((signed[p], signed[q])) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= distance}
    assert got == want


def test_simhash_of_an_empty_table(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
