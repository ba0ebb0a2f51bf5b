"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, cut down by size-derived bounds.

Documents are sets of distinct word shingles. Two link when 100 * intersection >= least * union; words and ``least``
are parameters, 4 and 85 in op7_jaccard. All pairs of documents are
the product of the incidence matrix with its transpose; it is never formed whole:

1. `incidence`: each task packs the shingles of some thousand documents (a document block) into tiles, one for
   each range of shingle hashes (a gram block). A shingle that several documents of the block have is sent once.
2. `shared`: a gram block counts in how many documents each of its shingles occurs and answers each tile with the
   shingles that more than one document has.
3. `postings`: a link needs ceil(least / 100 * size) common shingles. A document with fewer shared ones has no link and is
   discarded; of the others only the rarest are kept, as many as two linked documents must have one of in common
   (prefix bound, Bayardo et al., "Scaling up all pairs similarity search", 2007).
4. `candidates`: documents with equal sets become one node. Nodes that share a kept shingle and are of
   a similar size are joined by stars, not by pairs; the components of the stars hold every link.
5. `links`: each component is cut into blocks of nodes; every pair of blocks is one group that sums the overlaps of its
   own nodes by matrix products over shingle blocks and returns a spanning forest of the links it verified, so a
   large group of near copies never becomes a table of pairs.
6. Components of the verified links, then the least id of each.

Hot shingles, lines or copies grow no group: counts are combined before the shuffle, stars replace pairs, blocks of
nodes are of bounded size. The table of postings holds only documents that nearly all of their shingles tie to others.

Defined results: null and empty texts have the empty set and link with nothing, also not with each other; a row
without an id has its size and a null component and links nothing; rows of one id are separate documents, and each
gets the least id of its component; an empty table gives no rows; other columns are never read. Whole texts are used.
Shingles are told apart by 64-bit hashes, sets by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karyospark.llm import common
from karyospark.llm.components import components

WORDS, LEAST, OF = 4, 85, 100
#: Documents and shingles of a document block; text bytes of a gram block; nodes of a node block; shingles of a product step.
BLOCK_DOCS, BLOCK_GRAMS, GRAM_BLOCK_BYTES, BLOCK_NODES, STEP_GRAMS = 4000, 1_000_000, 32 << 20, 64, 32_768

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(1 << (n - 1).bit_length(), np.uint64(base))
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; A-Z are lower-cased, ASCII white space separates."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    a = np.frombuffer(b" ".join(parts), np.uint8)
    blanks = np.flatnonzero(a == 32)
    power, back = _powers(len(a))
    h = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * power[: len(a)], out=h[1:])
    begin, end = np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(a)]))
    if len(parts) <= words:
        begin, end = begin[:1], end[-1:]
    else:
        begin, end = begin[: len(parts) - words + 1], end[words - 1:]
    g = (h[end] - h[begin]) * back[begin]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(g ^ (g >> np.uint64(32)))


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def least_overlap(size: np.ndarray | int, least: int = LEAST) -> np.ndarray | int:
    """Common shingles that any link of a set of this size needs: ceil(least / 100 * size)."""
    return (least * size + OF - 1) // OF


_TILE = "doc_block long, gram_block int, local boolean, parts array<binary>"
_NAMES = ["doc_block", "gram_block", "local", "parts"]


def _tiles(rows: list[tuple[int, list[bytes], bool]], doc_block: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([doc_block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows]),
         pa.array([r[1] for r in rows], pa.list_(pa.binary()))], _NAMES)


def _doc_block(doc_block: int, docs: list[tuple[int | None, np.ndarray]], bits: int) -> pa.RecordBatch:
    """Tiles of one document block, and its own row: ids, sizes, set keys, who stands for whom, shingles shared inside."""
    keys, stand, first = [], [], {}
    for k, (doc_id, grams) in enumerate(docs):
        key = set_key(grams)
        keys.append(key)
        stand.append(first.setdefault(key, k) if doc_id is not None and len(grams) else -1)
    own = [k for k in range(len(docs)) if stand[k] == k]
    flat = np.concatenate([*(docs[k][1] for k in own), np.empty(0, np.uint64)]) >> np.uint64(32 - bits)
    row = np.repeat(np.array(own, np.int64), [len(docs[k][1]) for k in own])
    order = np.argsort(flat, kind="stable")
    gram, who = flat[order], row[order]
    edge = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.empty(0, np.int64)
    count = np.diff(np.append(edge, len(gram)))
    many = np.repeat(count > 1, count)
    several, several_n = gram[edge][count > 1], count[count > 1]
    single, single_who = gram[~many], who[~many]
    block = (single >> np.uint64(32)).astype(np.int64)
    by = np.lexsort((single_who, block))
    single, single_who, block = single[by], single_who[by], block[by]
    cuts = np.searchsorted(block, np.arange((1 << bits) + 1))
    several_cuts = np.searchsorted((several >> np.uint64(32)).astype(np.int64), np.arange((1 << bits) + 1))
    ids = np.array([d if d is not None else -1 for d, _ in docs], "<i8")
    local = [ids.tobytes(), np.array([d is None for d, _ in docs]).tobytes(), np.array([len(g) for _, g in docs], "<u4").tobytes(), b"".join(keys),
             np.array(stand, "<i4").tobytes(), gram[many].astype("<u8").tobytes(), who[many].astype("<u2").tobytes()]
    rows: list[tuple[int, list[bytes], bool]] = [(((doc_block >> 24) + doc_block) % (1 << bits), local, True)]
    for b in range(1 << bits):
        a, z, s, t = cuts[b], cuts[b + 1], several_cuts[b], several_cuts[b + 1]
        if z > a or t > s:
            counts = np.bincount(single_who[a:z], minlength=len(docs)).astype("<u4")
            rows.append((b, [counts.tobytes(), single[a:z].astype("<u4").tobytes(), several[s:t].astype("<u4").tobytes(),
                             np.minimum(several_n[s:t], 1 << 30).astype("<u4").tobytes()], False))
    return _tiles(rows, doc_block)


def incidence(docs: DataFrame, bits: int, words: int = WORDS) -> DataFrame:
    """Tiles of the incidence matrix. A gram's block is its first ``bits`` bits, its name there the next 32."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        number, held, size = (ctx.partitionId() if ctx else 0) << 24, [], 0
        for b in common.batches(it):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), common.texts(b.column("text")), strict=True):
                grams = shingles(text, words)
                held.append((doc_id, grams))
                size += len(grams)
                if len(held) >= BLOCK_DOCS or size >= BLOCK_GRAMS:
                    yield _doc_block(number, held, bits)
                    number, held, size = number + 1, [], 0
        if held:
            yield _doc_block(number, held, bits)
    return common.in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TILE)


def _answers(group: pa.Table) -> pa.Table:
    """For one gram block: each tile's shingles that more than one document has, with that number; own rows pass."""
    tiles = [(d, p) for d, local, p in zip(*(group.column(c).to_pylist() for c in ("doc_block", "local", "parts")), strict=True) if not local]
    out = [(d, p, True) for d, local, p in zip(*(group.column(c).to_pylist() for c in ("doc_block", "local", "parts")), strict=True) if local]
    name = group.column("gram_block")[0].as_py()
    single = [np.frombuffer(p[1], "<u4") for _, p in tiles]
    several = [np.frombuffer(p[2], "<u4") for _, p in tiles]
    weight = np.concatenate([*(np.ones(len(x), np.int64) for x in single), *(np.frombuffer(p[3], "<u4").astype(np.int64) for _, p in tiles),
                             np.empty(0, np.int64)])
    gram, inverse = np.unique(np.concatenate([*single, *several, np.empty(0, np.uint32)]), return_inverse=True)
    df = np.minimum(np.bincount(inverse, weight, len(gram)), 1 << 30).astype(np.int64)[inverse]
    cuts = np.cumsum([0, *map(len, single), *map(len, several)])
    for k, (d, p) in enumerate(tiles):
        mine, its = df[cuts[k]:cuts[k + 1]], df[cuts[len(tiles) + k]:cuts[len(tiles) + k + 1]]
        more = mine > 1
        counts = np.frombuffer(p[0], "<u4")
        who = np.repeat(np.arange(len(counts)), counts)[more]
        out.append((d, [who.astype("<u2").tobytes(), single[k][more].tobytes(), mine[more].astype("<u4").tobytes(), several[k].tobytes(),
                        its.astype("<u4").tobytes()], False))
    return pa.table([pa.array([d for d, _, _ in out], pa.int64()), pa.array([name] * len(out), pa.int32()), pa.array([x for _, _, x in out]),
                     pa.array([p for _, p, _ in out], pa.list_(pa.binary()))], _NAMES)


_DOCS = "uid long, doc_id long, n_shingles long, key binary, gram long"


def _prefixes(group: pa.Table, least: int) -> pa.Table:
    """For one document block: a row per document, and a row per kept shingle of each node that may have links."""
    own, found = None, []
    for b, local, p in zip(*(group.column(c).to_pylist() for c in ("gram_block", "local", "parts")), strict=True):
        if local:
            own = p
        else:
            found.append((b, p))
    doc_block = group.column("doc_block")[0].as_py()
    ids, missing = np.frombuffer(own[0], "<i8"), np.frombuffer(own[1], bool)
    size, stand = np.frombuffer(own[2], "<u4").astype(np.int64), np.frombuffer(own[4], "<i4")
    keys = [own[3][16 * k:16 * k + 16] for k in range(len(ids))]
    inside, inside_who = np.frombuffer(own[5], "<u8"), np.frombuffer(own[6], "<u2").astype(np.int64)
    found.sort(key=lambda x: x[0])
    several = np.concatenate([*(np.frombuffer(p[3], "<u4").astype(np.uint64) | np.uint64(b << 32) for b, p in found), np.empty(0, np.uint64)])
    several_df = np.concatenate([*(np.frombuffer(p[4], "<u4").astype(np.int64) for _, p in found), np.empty(0, np.int64)])
    gram = np.concatenate([*(np.frombuffer(p[1], "<u4").astype(np.uint64) | np.uint64(b << 32) for b, p in found), inside])
    who = np.concatenate([*(np.frombuffer(p[0], "<u2").astype(np.int64) for _, p in found), inside_who])
    df = np.concatenate([*(np.frombuffer(p[2], "<u4").astype(np.int64) for _, p in found),
                         several_df[np.searchsorted(several, inside)] if len(inside) else np.empty(0, np.int64)])
    held = np.bincount(who, minlength=len(ids))
    # names are shorter than hashes, so two shingles of a set may fall together: the bounds allow for each such loss
    by = np.lexsort((gram, df, who))
    gram, who = gram[by], who[by]
    again = np.concatenate(([False], (gram[1:] == gram[:-1]) & (who[1:] == who[:-1]))) if len(gram) else np.empty(0, bool)
    lost = np.bincount(who[again], minlength=len(ids))
    need = least_overlap(size, least) - lost
    single = size - held  # shingles of no other document come first in the order
    prefix = size - need + 1 - single
    may = (held >= need) & (need > 0)
    start = np.concatenate(([0], np.cumsum(held)))[:-1]
    rank = np.arange(len(who)) - start[who]
    kept = may[who] & (rank < prefix[who])
    base = doc_block << 16
    uid = pa.array(base + np.arange(len(ids)))
    doc_ids = pa.array(ids, mask=missing)
    everyone = pa.table([uid, doc_ids, pa.array(size), pa.array(keys, pa.binary()), pa.nulls(len(ids), pa.int64())], ["uid", "doc_id", "n_shingles", "key", "gram"])
    at = who[kept]
    posted = pa.table([pa.array(base + at), doc_ids.take(pa.array(at)), pa.array(size[at]), pa.array([keys[k] for k in at], pa.binary()),
                       pa.array(gram[kept].astype(np.int64))], everyone.schema.names)
    return pa.concat_tables([everyone, posted])


def documents_and_postings(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Written tables: documents (uid, doc_id, n_shingles, key) and postings (gram, node, size) of nodes that may link."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (chars // GRAM_BLOCK_BYTES).bit_length())
    tiles = incidence(docs, bits, words).groupBy("gram_block").applyInArrow(_answers, _TILE)
    both = common.written(tiles.groupBy("doc_block").applyInArrow(lambda group: _prefixes(group, least), _DOCS), "jaccard-documents")
    documents = both.where("gram is null").select("uid", "doc_id", "n_shingles", "key")
    postings = both.where("gram is not null").groupBy("gram", "key").agg(F.min("uid").alias("node"), F.max("n_shingles").alias("size"))
    return documents, common.written(postings.select("gram", "node", "size"), "jaccard-postings")


def candidates(postings: DataFrame, least: int = LEAST) -> DataFrame:
    """a, b: stars over the nodes of each shingle and size band, and between neighbouring bands. No link leaves them."""
    # a band is wide enough for any link; the shift keeps whole powers of its width from being rounded either way
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(OF / min(least, OF - 1))) + 1e-9).cast("int")
    banded = postings.withColumn("band", band)
    hubs = common.written(banded.groupBy("gram", "band").agg(F.min("node").alias("hub"), F.count("*").alias("n")), "jaccard-hubs")
    stars = banded.join(hubs.where("n > 1"), ["gram", "band"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    above = hubs.select("gram", (F.col("band") - 1).alias("band"), F.col("hub").alias("upper"))
    bridges = hubs.join(above, ["gram", "band"]).select(F.col("hub").alias("a"), F.col("upper").alias("b"))
    return stars.unionByName(bridges).where("a <> b").distinct()


def _forest(size: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    top, out = list(range(size)), []

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def product_links(sets: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets: overlaps are summed over steps of the sorted shingles."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    name = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1])))
    shared = np.bincount(name)[name] > 1
    _, name = np.unique(name[shared], return_inverse=True)
    row, overlap = row[shared], np.zeros((len(sets), len(sets)), np.int64)
    columns = int(name[-1]) + 1 if len(name) else 0
    for at in range(0, columns, STEP_GRAMS):
        a, z = np.searchsorted(name, (at, at + STEP_GRAMS))
        part = np.zeros((len(sets), min(STEP_GRAMS, columns - at)), np.float32)
        part[row[a:z], name[a:z] - at] = 1
        overlap += (part @ part.T).astype(np.int64)
    linked = np.triu(OF * overlap >= least * (size[:, None] + size - overlap), 1)
    return _forest(len(sets), zip(*(x.tolist() for x in np.nonzero(linked)), strict=True))


def _product(group: pa.Table, least: int) -> pa.Table:
    node = group.column("node").to_pylist()
    sets = {n: np.frombuffer(g, "<u8") for n, g in zip(node, group.column("grams").to_pylist(), strict=True)}
    order = sorted(sets)
    found = product_links([sets[n] for n in order], least) if len(order) > 1 else []
    return pa.table([pa.array([order[a] for a, _ in found], pa.int64()), pa.array([order[b] for _, b in found], pa.int64())], ["a", "b"])


def links(docs: DataFrame, documents: DataFrame, groups: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """a, b: verified links that connect all linked nodes, from candidate ``groups`` (node, label)."""
    groups = common.written(groups, "jaccard-groups")
    count = groups.count()
    sizes = groups.groupBy("label").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks"))
    chosen = groups.join(sizes, "label").join(documents.select(F.col("uid").alias("node"), "doc_id", "key"), "node")
    chosen = common.written(chosen, "jaccard-chosen")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it):
            grams = [shingles(t, words) for t in common.texts(b.column("text"))]
            same = [k for k, (g, key) in enumerate(zip(grams, b.column("key").to_pylist(), strict=True)) if set_key(g) == key]
            kept = b.select(["label", "blocks", "node"]).take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, common.binary([grams[k].astype("<u8").tobytes() for k in same])],
                                             ["label", "blocks", "node", "grams"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(common.small(chosen, count), "doc_id")
    whole = texts.select("label", "blocks", "node", "key", "text").mapInArrow(sets, "label long, blocks int, node long, grams binary")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = whole.select("label", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "node", "grams")
    paired = dealt.select("label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "grams")
    return paired.groupBy("label", "i", "j").applyInArrow(lambda group: _product(group, least), "a long, b long")


def document_components(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """uid, doc_id, n_shingles, key, root, component_id of every row.

    ``uid`` numbers the rows and ``key`` names their sets. ``root`` is the least uid of a component's classes; different
    components may have one component_id, never one root. It is null where nothing can link.
    """
    if words < 1 or not 0 < least <= OF:
        raise ValueError(f"shingles of {words} words, similarity {least} of {OF}")
    documents, postings = documents_and_postings(docs, words, least)
    verified = links(docs, documents, components(candidates(postings, least)), words, least)
    labels = components(verified)
    named = documents.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("key").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least_id"))
    rooted = classes.join(labels, "node", "left").select("key", "least_id", F.coalesce("label", "node").alias("root"))
    rooted = common.written(rooted, "jaccard-classes")
    heads = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = common.written(rooted.join(heads, "root").select("key", "root", "component_id"), "jaccard-components")
    linked = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    root = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("root"))
    return documents.join(ids, "key", "left").withColumn("root", root).withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, linked).otherwise(F.col("doc_id")))


def join_components(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return document_components(docs, words, least).select("doc_id", "n_shingles", "component_id")


def _first_rows(docs: DataFrame, group: list[str], words: int, least: int) -> DataFrame:
    """Of the rows with the least id of their component, the first of each ``group``, by id and set; rows without an id stay."""
    winner, winner_key = common.free_name(docs, "winner_id"), common.free_name(docs, "winner_key")
    found = document_components(docs, words, least).where("doc_id = component_id")
    winners = common.written(found.groupBy(*group).agg(F.min_by("key", "uid").alias(winner_key)).select(
        F.col("doc_id").alias(winner), winner_key), "jaccard-winners")
    count = winners.count()
    held = docs.withColumn(winner, F.col("doc_id").cast("long"))
    if count <= common.BROADCAST_ROWS:  # beyond it this join would shuffle the texts once more
        held = held.join(F.broadcast(winners.select(winner).distinct()), winner, "left_semi")

    def with_keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it):
            keys = common.binary([set_key(shingles(t, words)) for t in common.texts(b.column("text"))])
            yield pa.RecordBatch.from_arrays([*b.columns, keys], [*b.schema.names, winner_key])

    schema = T.StructType([*held.schema.fields, T.StructField(winner_key, T.BinaryType())])
    keyed = common.in_batches(held).mapInArrow(with_keys, schema)
    stay = keyed.join(common.small(winners, count), [winner, winner_key], "left_semi")
    repeated = stay.select(winner).count() > count
    stay = stay.dropDuplicates([winner, winner_key]) if repeated else stay
    return stay.drop(winner, winner_key).unionByName(docs.where(F.col("doc_id").isNull()))


def representatives(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: of the rows with its least id the first; rows without an id stay.

    Components whose least id is the same keep a row each. Of empty rows of one id one stays.
    """
    return _first_rows(docs, ["doc_id", "root"], words, least)


def one_of_each(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """As `representatives`, for tables whose ids are unique: of several components with the same least id only one stays."""
    return _first_rows(docs, ["doc_id"], words, least)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(common.table(spark, sf_dir, "documents"))
