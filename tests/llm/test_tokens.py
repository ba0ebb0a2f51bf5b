"""Packing and token files: ids as the tokenizers library gives them, each in exactly one place."""

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from karyospark.llm import packing, token_files, tokens

WORD, BYTE = tokens.vocabulary_path("word_bpe_49k.json"), tokens.vocabulary_path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a   b", "x \n y", "\n\n  z", "it's John'S I'LL", "fin  ", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>  c",
       "Éé ß straße", "日本語 テキスト", "á e", "x\x1cy \x85 z", "ſtraße ΑΣ", "a!!! ...b 12 345", "\ta\tb", "12ab!?:;", "don't!", "ﬁ ½", "a.",
       "İstanbul ıi ŉ", "end.\n\nNext, one; two:three", " lead", "\xa0x \xa0 y", "a,b,,c .d", "ÀÖØ öøÿ ×÷", "x  ", "tab\t \tx", "a.\nB c,\nd\ne", "\nx", "x\n", "one\n\ntwo", "é.\nÉ a\n", "First\nline", "x\n y", "a\r\nb",
       "one$$$ two.*** é,### ÖÖ&&&", "a-b c_d (e) [f] {g}|", "x's. y'. z`~ w'", "end.\nNext.\nÉté!\n", "a\nb\nc's d", "in.\n Out", "<| a |>", "q<r> s&t"]
ROWS = [(3, "One two three. " * 700), (1, None), (2, ""), (5, "same text"), (5, "same text"), (5, "other text"), (None, "no id"),
        (9, "w " * 9000), *((100 + k, "tiny") for k in range(300))]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_librarys(path):
    enc, plain = tokens.TextEncoder(path, memory=20), Tokenizer.from_file(path)
    for text in [*ODD, " ".join(ODD), *ODD]:
        assert enc.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@lru_cache
def _library(path):
    return Tokenizer.from_file(path)


def _ids(path, text):
    return [*_library(path).encode(text or "", add_special_tokens=False).ids, 2]


def _pieces(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id, r.doc_tokens].append(r)
    return by


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=64, segments=3, loss=48, window=50)])
def test_packing_covers_each_id_once_within_limits(documents, limits):
    rows = packing.pack(packing.document_examples(documents(ROWS)), WORD, limits=limits).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist()
        assert sum(r.length for r in pieces) <= limits.tokens and len(pieces) <= limits.segments and sum(r.loss_tokens for r in pieces) <= limits.loss
    want = defaultdict(int)
    for doc_id, text in ROWS:
        for k, i in enumerate(_ids(WORD, text)):
            want[doc_id, k, i] += 1
    for doc_id, text in {(d, t) for d, t in ROWS if d != 5}:
        ids = np.array(_ids(WORD, text), "<u4")
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length])
            at += r.length
    assert sum(r.length for r in rows) == sum(want.values())
    short = [sum(r.length for r in p) for p in sequences.values()]
    if limits.loss == limits.tokens:
        assert all(n == limits.tokens or n & (n - 1) == 0 for n in short)


def test_packing_of_conversations_bears_loss_on_answers(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi there"), (1, 1, "assistant", "Hello you"), (2, 0, "user", None)],
                                  "conv_id long, turn int, role string, text string")
    rows = packing.pack(packing.conversation_examples(turns), WORD).collect()
    tokens_of = {d: sum(r.length for r in rows if r.doc_id == d) for d in (1, 2)}
    loss_of = {d: sum(r.loss_tokens for r in rows if r.doc_id == d) for d in (1, 2)}
    answer = len(_ids(WORD, "Hello you"))
    assert tokens_of == {1: len(_ids(WORD, "Hi there")) - 1 + answer, 2: 1} and loss_of == {1: answer, 2: 0}


def test_empty_tables(documents, spark, tmp_path):
    empty = documents([])
    assert packing.pack(packing.document_examples(empty), WORD).count() == 0
    blocks = token_files.write_tokens(empty, str(tmp_path / "t"), BYTE)
    assert token_files.digests(spark, str(tmp_path / "t"), blocks).count() == 0


def test_token_files_round_trip(documents, spark, tmp_path):
    path = str(tmp_path / "tokens")
    blocks = token_files.write_tokens(documents(ROWS), path, BYTE)
    got = sorted(token_files.digests(spark, path, blocks).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    want = sorted((str(d), len(_ids(BYTE, t)), zlib.crc32(np.array(_ids(BYTE, t), "<u4"))) for d, t in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


def test_token_files_have_delta_pages_and_indexes(documents, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "tokens"
    token_files.write_tokens(documents([(k, f"word {k} and more") for k in range(500)]), str(path), BYTE)
    file = next(f for f in sorted(path.glob("*.parquet")) if pq.ParquetFile(f).metadata.num_rows)
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups == 1
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["ids.list.element"].encodings
    assert all(columns[c].has_column_index and columns[c].has_offset_index for c in ("doc_id", "n_tokens"))
