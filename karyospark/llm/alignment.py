"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

1. A batch of documents is encoded by both vocabularies; each distinct word is encoded once per worker memory. Tokens get
   byte ranges from tables of token lengths. The documents of a batch lie one behind the other, so a byte place names
   its document, and places only ever match inside one.
2. `overlapping`: each token start finds the other side's covering token by ``pandas.merge_asof``, in both directions. Of
   two ranges that overlap the later start lies in the other one, so the union of both directions is every overlap.
3. Overlaps with equal ends are links. They cut both sides into groups: the shortest runs of tokens that cover the same bytes.
4. Linked id pairs are counted in the task, then over the corpus; a document's links are kept as ids, 4 bytes each. `scored` looks
   their counts up in blocks of whole B ids; a block is a bounded number of pairs, and the sums of several blocks add up.

Windows of tokens bound the memory of a very long text's joins.

Defined results: texts that are null or empty, or that a vocabulary does not give back byte for byte (with the space it puts before),
have no tokens: zeros and ''. Repeated rows count each; a row without an id keeps its null; an empty table gives no rows; the strings of
special tokens are plain text; other columns are never read. Whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import common, tokens

#: Tokens of a join; id pairs that a task holds; id pairs of a block of counts, 12 bytes each.
WINDOW, TASK_PAIRS, BLOCK_PAIRS = 500_000, 1_000_000, 8_000_000
_ENCODERS: dict[tuple[str, str], PairEncoder] = {}


class PairEncoder:
    """Ids and token bytes of a byte-level vocabulary (A, over space + text) and a piece vocabulary (B, which adds the space)."""

    def __init__(self, path_a: str, path_b: str, memory: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        self.a = tokens.TextEncoder(path_a, 2 * memory)
        self.a.tokenizer.encode_special_tokens = True  # their strings are plain text
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = {shown: bytes([byte]) for byte, shown in tokens._byte_letters().items()}
        self.bytes_a = [b""] * self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_a[k] = b"".join(letters[c] for c in token if c in letters)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(pieces)) > 1 << 16:
            raise ValueError("vocabularies of at most 65536 ids")
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # a byte-level vocabulary without a normaliser gives every text back, as long as it has all bytes
        if self.a.lower or not {bytes([k]) for k in range(256)} <= set(self.bytes_a):
            raise ValueError(f"{path_a} is not a byte-level vocabulary")
        # a text may be cut before a space if no piece goes over such a cut
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)
        self.memory, self.known = memory, {}

    def _back(self, text: str, ids: list[int]) -> bool:
        """Whether the pieces give the text back, with its space."""
        return b"".join(map(self.bytes_b.__getitem__, ids)) == b" " + text.encode()

    def _learn(self, words: set[str]) -> None:
        fresh = list(words)
        for w, ids in zip(fresh, self.b.encode(fresh, num_threads=1), strict=True):
            # None: the word is not given back
            self.known[w] = np.array(ids, np.uint16).tobytes() if self._back(w, ids) else None

    def _pieces(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of B for each text; None where they don't give it back."""
        split = [t.split(" ") for t in texts]
        by_word = [self.cut and "" not in words for words in split]  # runs of spaces are pieces of their own
        missing = set().union(*(w for w, by in zip(split, by_word, strict=True) if by)).difference(self.known)
        if len(self.known) + len(missing) > self.memory:
            self.known.clear()
            missing = set().union(*(w for w, by in zip(split, by_word, strict=True) if by))
        self._learn(missing)
        out: list[np.ndarray | None] = []
        for t, words, by in zip(texts, split, by_word, strict=True):
            if by:
                ids = list(map(self.known.__getitem__, words))
                out.append(None if None in ids else np.frombuffer(b"".join(ids), np.uint16))
            else:
                whole = self.b.encode(t)
                out.append(np.array(whole, np.uint16) if self._back(t, whole) else None)
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for each text; none where a text has no alignment."""
        none = np.empty(0, np.int64)
        out = []
        for t, a, b in zip(texts, self.a.encode([" " + t for t in texts]), self._pieces(texts), strict=True):
            out.append((a.astype(np.int64), b.astype(np.int64)) if t and b is not None else (none, none))
        return out


def encoder(path_a: str, path_b: str) -> PairEncoder:
    if (path_a, path_b) not in _ENCODERS:
        _ENCODERS[path_a, path_b] = PairEncoder(path_a, path_b)
    return _ENCODERS[path_a, path_b]


def _covering(starts: np.ndarray, other: np.ndarray, window: int) -> np.ndarray:
    """For each start the index of the other side's token that covers it: the last one that starts at or before it."""
    out = []
    for at in range(0, len(starts), window):
        part = starts[at:at + window]
        low, high = np.searchsorted(other, part[[0, -1]], "right")
        low = max(0, low - 1)
        right = pd.DataFrame({"place": other[low:high], "covering": np.arange(low, high)})
        out.append(pd.merge_asof(pd.DataFrame({"place": part}), right, on="place")["covering"].to_numpy())
    return np.concatenate(out) if out else np.empty(0, np.int64)


def overlapping(start_a: np.ndarray, start_b: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all tokens that share a byte; both sides cover the same bytes without a gap."""
    of_a, of_b = _covering(start_a, start_b, window), _covering(start_b, start_a, window)
    later = start_a[of_b] < start_b  # equal starts are in the first direction already
    a = np.concatenate((np.arange(len(start_a)), of_b[later]))
    b = np.concatenate((of_a, np.flatnonzero(later)))
    order = np.lexsort((b, a))
    return a[order], b[order]


@dataclass
class Aligned:
    """A batch of documents: ids, byte ranges (counted through the batch), first tokens of the documents, overlaps and links."""

    a: np.ndarray
    b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    over_a: np.ndarray
    over_b: np.ndarray

    @property
    def links(self) -> tuple[np.ndarray, np.ndarray]:
        equal = self.end_a[self.over_a] == self.end_b[self.over_b]
        return self.over_a[equal], self.over_b[equal]


def aligned(enc: PairEncoder, texts: list[str]) -> Aligned:
    got = enc.encode(texts)
    a, b = (np.concatenate([*(g[side] for g in got), np.empty(0, np.int64)]) for side in (0, 1))
    first_a, first_b = (np.cumsum([0, *(len(g[side]) for g in got)]) for side in (0, 1))
    end_a, end_b = np.cumsum(enc.length_a[a]), np.cumsum(enc.length_b[b])
    return Aligned(a, b, end_a, end_b, first_a, first_b, *overlapping(end_a - enc.length_a[a], end_b - enc.length_b[b]))


_NAMES = [[f"{k}{mark}" for k in range(1 << 16) for mark in marks] for marks in (",|", ",;")]


def group_texts(x: Aligned) -> list[str]:
    """Each document's groups as text: ids of A, a bar, ids of B; semicolons between groups."""
    link_a, link_b = x.links
    last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    last_a[link_a] = last_b[link_b] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    through_a, through_b = np.append(0, link_a + 1), np.append(0, link_b + 1)
    parts: list[str] = np.empty(len(x.a) + len(x.b), object)
    parts[np.arange(len(x.a)) + through_b[group_a]] = [_NAMES[0][k] for k in (2 * x.a + last_a).tolist()]
    parts[np.arange(len(x.b)) + through_a[group_b + 1]] = [_NAMES[1][k] for k in (2 * x.b + last_b).tolist()]
    cuts = (x.first_a + x.first_b).tolist()
    return ["".join(parts[p:q].tolist())[:-1] for p, q in zip(cuts[:-1], cuts[1:], strict=True)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def overlap_rows(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per overlap: doc_id, uid of the row, index, id and byte range (in space + text) of both tokens, equal_ends."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ctx = encoder(path_a, path_b), TaskContext.get()
        uid = (ctx.partitionId() if ctx else 0) << 40
        for b in common.batches(it, size=256 << 10):
            x = aligned(enc, common.texts(b.column("text")))
            doc = np.searchsorted(x.first_a, x.over_a, "right") - 1
            base = np.append(0, x.end_a)[x.first_a[doc]]
            length_a, length_b = enc.length_a[x.a[x.over_a]], enc.length_b[x.b[x.over_b]]
            end_a, end_b = x.end_a[x.over_a] - base, x.end_b[x.over_b] - base
            columns = [b.column("doc_id").take(pa.array(doc)), doc + uid, x.over_a - x.first_a[doc], x.over_b - x.first_b[doc], x.a[x.over_a], x.b[x.over_b],
                       end_a - length_a, end_a, end_b - length_b, end_b, end_a == end_b]
            uid += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns],
                                             ["doc_id", "uid", "a_index", "b_index", "a_id", "b_id", "a_start", "a_end", "b_start", "b_end", "equal_ends"])
    return _texts(docs).mapInArrow(run, "doc_id long, uid long, a_index long, b_index long, a_id long, b_id long, "
                                        "a_start long, a_end long, b_start long, b_end long, equal_ends boolean")


class PairCounts:
    """Counts of id pairs (A id * 65536 + B id) that a task meets."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        new, n = np.unique(keys, return_counts=True)
        self.keys, where = np.unique(np.concatenate((self.keys, new)), return_inverse=True)
        self.counts = np.bincount(where, np.concatenate((self.counts, n)), len(self.keys)).astype(np.int64)


_STORED = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair long, n long"


def alignments(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: a row per document with its counts, digest and links; a row per linked id pair (pair, b, n) over the corpus."""
    names = [f.split()[0] for f in _STORED.split(", ")]

    def counted(c: PairCounts) -> pa.RecordBatch:
        rows = len(c.keys)
        blank = [pa.nulls(rows, pa.int64())] * 6 + [pa.nulls(rows, pa.string()), pa.nulls(rows, pa.binary())]
        return pa.RecordBatch.from_arrays([*blank, pa.array(c.keys), pa.array(c.counts)], names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ctx, counts = encoder(path_a, path_b), TaskContext.get(), PairCounts()
        uid = (ctx.partitionId() if ctx else 0) << 40
        for b in common.batches(it, size=1 << 20):
            x = aligned(enc, common.texts(b.column("text")))
            link_a, link_b = x.links
            pairs = x.a[link_a] << 16 | x.b[link_b]
            counts.add(pairs)
            cuts = np.searchsorted(link_a, x.first_a)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(x)]
            held = pairs.astype("<u4")
            kept = [held[p:q].tobytes() for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
            n_links = pa.array(np.diff(cuts), pa.int64())
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + b.num_rows)), b.column("doc_id"), pa.array(np.diff(x.first_a)), pa.array(np.diff(x.first_b)),
                                              n_links, n_links, pa.array(digests, pa.string()), common.binary(kept), none, none], names)
            uid += b.num_rows
            if len(counts.keys) > TASK_PAIRS:
                yield counted(counts)
                counts = PairCounts()
        yield counted(counts)

    both = common.written(_texts(docs).mapInArrow(run, _STORED), "alignment")
    pairs = both.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = common.written(pairs.select("pair", F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("b"), "n"), "alignment-pairs")
    return both.where("pair is null").drop("pair", "n"), pairs


def scored(documents: DataFrame, pairs: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The documents with n_best and count_sum in place of their links."""
    kept = [c for c in documents.columns if c != "links"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema if f.name != "links") + ", n_best long, count_sum long"
    blocks = max(1, -(-pairs.count() // block_pairs))
    spark = documents.sparkSession

    def scoring(table):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts, best = table.value
            for b in common.batches(it, size=4 << 20):
                links = [np.frombuffer(x, "<u4") for x in b.column("links").to_pylist()]
                own, where = np.unique(np.concatenate([*links, np.empty(0, np.uint32)]), return_inverse=True)
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                here = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                n = np.where(here, counts[at], 0) if len(keys) else np.zeros(len(own), np.int64)
                top = here & (n == best[own & 0xFFFF])
                cuts = np.cumsum([0, *map(len, links)])
                sums = [np.append(0, np.cumsum(v[where]))[cuts] for v in (top.astype(np.int64), n)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(np.diff(s)) for s in sums)], [*kept, "n_best", "count_sum"])
        return run

    parts = []
    for k in range(blocks):  # a block has all pairs of its B ids, so it knows their highest counts
        chosen = pairs.where(F.pmod(F.xxhash64("b"), F.lit(blocks)) == k) if blocks > 1 else pairs
        got = chosen.select("pair", "n").toArrow()  # about block_pairs rows
        order = np.argsort(got.column("pair").to_numpy())
        keys, counts = got.column("pair").to_numpy()[order].astype(np.uint32), got.column("n").to_numpy()[order].astype(np.int64)
        best = np.zeros(1 << 16, np.int64)
        np.maximum.at(best, keys & 0xFFFF, counts)
        parts.append(documents.mapInArrow(scoring(spark.sparkContext.broadcast((keys, counts, best))), schema))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    if blocks > 1:
        out = out.groupBy(*kept).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokens.vocabulary_path("byte_bpe_50k.json"), tokens.vocabulary_path("piece_bpe_32k.model")
    return scored(*alignments(common.table(spark, sf_dir, "documents"), *paths)).drop("uid")
