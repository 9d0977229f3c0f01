"""MinHash near-dedup by DartMinHash: weighted signatures from darts, banded candidates, exact verification, classes.

A text is the multiset of its 5-word shingles (words split at white space, A-Z lower-cased; a shorter text with a word
is one shingle): weight is how often a shingle occurs. The region of an element is its weight times the rank axis. Hashed
darts fall into it as a Poisson process that depends on the element alone; each belongs to one of K coordinates, and the
earliest of a coordinate among all of a text's regions is the text's signature there. Two texts agree in a coordinate
with a probability that is their weighted Jaccard similarity. Darts are thrown up to the rank below which
K ln K + 2 K of them fall on average, whatever the text's length, and further only while a coordinate is empty.

Texts with equal words are one node. Nodes that share a band of ROWS coordinates are candidates, but no bucket is
expanded into pairs: its most central member (the one with the most bucket mates) is compared with each other member,
and what that links is contracted by connected components. Only buckets in which several components remain are compared
across those components: small ones pair by pair, large ones in blocks of members that a task compares in memory. Every
candidate pair is verified by the exact similarity of all shingles, by the same rule in both. At similarity 0.8 a pair shares no band with odds of 6e-5, at
0.85 of 3e-7.

Edge cases: null texts and texts without words are classes of their own, as are rows without an id (class null); rows
with the same id and different words are texts of their own, each with its class; repeated rows are in one class; very
long texts have as many coordinates as others; no rows give no rows; extra columns pass through ``keep_one``, which
leaves one row of each class, of rows alike in id and text too, one row of each words that only rows without an id have,
and all rows without words.

Scale: signatures are one pass; exact copies are collapsed by an aggregation with map-side combine before anything is
joined; all large joins are sort-merge joins on node or bucket ids, which AQE can split. Nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import WHITE_CHARS, by_batch, clear_of, drop_path, pieces, stash, utf8

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 6
K = BANDS * ROWS
DARTS = K * np.log(K) + 2 * K
#: Texts are sketched so many at a time, and fewer where they are long.
AT_ONCE, CELLS_AT_ONCE = 256, 400_000
WORD_CACHE = 100_000
#: Up to so many members an open bucket is compared pair by pair; members of larger ones are compared in blocks.
PAIRWISE = 32
BLOCK_MEMBERS, BLOCK_CELLS = 2048, 1_000_000

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit numbers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_cells(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit numbers of the text's unit regions: the n-th occurrence of a shingle is one."""
    if not words:
        return np.empty(0, _U)
    w = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    n = min(SHINGLE, len(w))
    s = np.full(len(w) - n + 1, n, _U)
    for i in range(n):
        s = mixed(s * _U(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    s.sort()
    if len(s) > 1 and (same := s[1:] == s[:-1]).any():
        at = np.arange(len(s))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
        s = np.where(at > first, mixed(s + (at - first).astype(_U) * _U(0xD1B54A32D192ED03)), s)
        s.sort()
    return s


def darts(cells: np.ndarray, owner: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner * K + coordinate, rank, id) of all darts that fall into the owners' regions up to the rank reach."""
    rank = np.zeros(len(cells))
    limit = reach[owner]
    slots, ranks, ids = [], [], []
    n = 0
    while len(cells):
        n += 1
        h = mixed(cells + _U(n * 0x9E3779B97F4A7C15 % (1 << 64)))
        rank -= np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        hit = rank < limit
        cells, owner, rank, limit, h = cells[hit], owner[hit], rank[hit], limit[hit], h[hit]
        h = mixed(h + _U(1))
        slots.append(owner * K + ((h >> _U(32)) % _U(K)).astype(np.int64))
        ranks.append(rank.copy())
        ids.append(h)
    return np.concatenate(slots), np.concatenate(ranks), np.concatenate(ids)


def signatures(texts: list[np.ndarray]) -> np.ndarray:
    """A row of K dart ids for each text, given as its (at least one) cells."""
    out = np.zeros((len(texts), K), _U)
    todo = np.arange(len(texts))
    more = 1.0
    while len(todo):
        sizes = np.array([len(texts[i]) for i in todo])
        slot, rank, ident = darts(np.concatenate([texts[i] for i in todo]), np.repeat(np.arange(len(todo)), sizes), more * DARTS / sizes)
        earliest = np.full(len(todo) * K, np.inf)
        np.minimum.at(earliest, slot, rank)
        first = rank == earliest[slot]
        found = np.zeros(len(todo) * K, _U)
        found[slot[first]] = ident[first]
        out[todo] = found.reshape(len(todo), K)
        todo = todo[np.isinf(earliest).reshape(len(todo), K).any(1)]
        more *= 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A row of BANDS bucket numbers for each signature."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    h = np.arange(BANDS, dtype=_U)[None, :] + _U(1)
    for i in range(ROWS):
        h = mixed(h * _U(0x9E3779B97F4A7C15) + rows[:, :, i])
    return h


_SKETCH = pa.schema([("doc_id", pa.int64()), ("said", pa.int64()), ("words", pa.binary()), ("bands", pa.list_(pa.int64()))])


def text_key() -> Column:
    """A number that tells the texts of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def words_key(words: list[bytes]) -> bytes | None:
    """A 128-bit hash of a text's words; null without any."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, said (the text's key), words (the words' key) and bands."""

    def rows(ids: list, said: list, keys: list, cells: list[np.ndarray]) -> pa.RecordBatch:
        have = [i for i, c in enumerate(cells) if len(c)]
        bucket = bands(signatures([cells[i] for i in have])).view(np.int64).tolist() if have else []
        b = [None] * len(ids)
        for n, i in enumerate(have):
            b[i] = bucket[n]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, said, keys, b), _SKETCH.types, strict=True)], schema=_SKETCH)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids, said, keys, cells, total = [], [], [], [], 0
        for batch in pieces(batches):
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = (text or b"").lower().split()
                ids.append(doc)
                said.append(key)
                keys.append(words_key(words))
                cells.append(shingle_cells(words, hashes))
                total += len(cells[-1])
                if len(ids) >= AT_ONCE or total >= CELLS_AT_ONCE:
                    yield rows(ids, said, keys, cells)
                    ids, said, keys, cells, total = [], [], [], [], 0
        if ids:
            yield rows(ids, said, keys, cells)

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("said"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, said long, words binary, bands array<long>")


def cells_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, cells) for nodes (node, text_id, words): of docs' rows with that id those with these words."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = WordHashes()
        nodes, cells = [], []
        for node, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            words = (text or b"").lower().split()
            if words_key(words) == key:
                nodes.append(node)
                cells.append(shingle_cells(words, hashes).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(cells, pa.binary())], names=["node", "cells"])

    texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), F.col("text").cast("binary").alias("text"))
    met = texts.join(wanted.hint("merge"), "text_id").select("node", "words", "text")
    return met.mapInArrow(by_batch(work), "node long, cells binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose exact similarity is SIMILAR at least."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both >= SIMILAR * (len(p) + len(q) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(cells.select(F.col("node").alias("a"), F.col("cells").alias("ca")).hint("merge"), "a")
    met = met.join(cells.select(F.col("node").alias("b"), F.col("cells").alias("cb")).hint("merge"), "b")
    return stash(met.select("a", "b", "ca", "cb").mapInArrow(by_batch(compare), "a long, b long"), "near-links")[0]


def block_links(table: pa.Table) -> pa.Table:
    """Links between different components among the members of two blocks of a group, one for each two components.

    Members outside the group's main component are held against all others: their cells are marked, and marks are
    counted member by member.
    """
    rows = sorted(table.select(["node", "component", "main", "cells"]).to_pylist(), key=lambda r: r["node"])
    cells = [np.frombuffer(r["cells"], _U) for r in rows]
    sizes = np.array([len(c) for c in cells])
    first = np.cumsum(sizes) - sizes
    known, code = np.unique(np.concatenate(cells), return_inverse=True)
    marked = np.zeros(len(known), bool)
    nodes = np.array([r["node"] for r in rows])
    part = np.array([r["component"] for r in rows])
    out_a, out_b = [], []
    for i in range(len(rows)):
        if part[i] == rows[i]["main"]:
            continue
        mine = code[first[i] : first[i] + sizes[i]]
        marked[mine] = True
        both = np.add.reduceat(marked[code], first, dtype=np.int64)
        marked[mine] = False
        near = np.flatnonzero((both >= SIMILAR * (sizes + sizes[i] - both)) & (part != part[i]))
        for j in near[np.unique(part[near], return_index=True)[1]] if len(near) else ():
            out_a.append(min(nodes[i], nodes[j]))
            out_b.append(max(nodes[i], nodes[j]))
            # The main component keeps its name, so that what joins it is passed over from now on.
            old, new = (part[j], part[i]) if part[i] == rows[i]["main"] else (part[i], part[j])
            part[part == old] = new
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def group_links(open_: DataFrame, cells: DataFrame) -> DataFrame:
    """Links across the components of large buckets (bucket, node, component), without a row for each pair.

    Buckets with common members are one group. A group's members are cut into blocks of bounded size; a task holds two
    blocks, and every two blocks of a group meet once.
    """
    lead = open_.groupBy("bucket").agg(F.min("node").alias("b"))
    together = components(open_.join(lead.hint("merge"), "bucket").select(F.col("node").alias("a"), "b"))
    members = open_.select("node", "component").distinct().join(together.withColumnRenamed("component", "group").hint("merge"), "node")
    members = stash(members.join(cells.hint("merge"), "node"), "near-members")[0]
    main = members.groupBy("group", "component").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"))
    size = members.groupBy("group").agg(F.ceil(F.greatest(F.sum(F.length("cells")) / (8 * BLOCK_CELLS), F.count("*") / BLOCK_MEMBERS)).alias("blocks"))
    dealt = members.join(main.join(size, "group").hint("merge"), "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = dealt.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "main", "cells")
    return met.groupBy("group", "i", "j").applyInArrow(block_links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node reaches, by large and small stars."""
    edges, path = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "near-edges")
    spark = links.sparkSession
    before = None
    while True:
        # Large star: every larger neighbour of a node goes to the least of the node and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now, new_path = stash(small, "near-edges")
        drop_path(spark, path)
        edges, path = now, new_path
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = state


def numbered(sketched: DataFrame) -> tuple[DataFrame, bool]:
    """(words, text_id, bands, node) of the distinct texts with an id, and whether an id has several texts.

    text_id: the least id with these words. It is the text's node as well, but where several texts have it: there only
    the least words' text is, and others have a negative number of their words.
    """
    texts, _ = stash(sketched.where("words is not null and doc_id is not null").groupBy("words").agg(F.min("doc_id").alias("text_id"), F.first("bands").alias("bands")), "near-texts")
    shared = texts.groupBy("text_id").agg(F.count("*").alias("n"), F.min("words").alias("lead")).where("n > 1").select("text_id", "lead")
    if shared.isEmpty():
        return texts.withColumn("node", F.col("text_id")), False
    own = F.coalesce(F.col("words") == F.col("lead"), F.lit(True))
    other = -1 - F.pmod(F.xxhash64("words"), F.lit(1 << 62))
    return stash(texts.join(shared, "text_id", "left").select("words", "text_id", "bands", F.when(own, F.col("text_id")).otherwise(other).alias("node")), "near-nodes")[0], True


def links_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between the distinct texts that connect all similar ones."""
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    mates, mates_path = stash(placed.join(shared.hint("merge"), "bucket"), "near-buckets")
    # The member with the most mates over all buckets stands in the middle of its group.
    central = mates.groupBy("node").agg(F.sum("n").alias("mates"))
    leaders = mates.join(central.hint("merge"), "node").groupBy("bucket").agg(F.max_by("node", F.struct("mates", -F.col("node"))).alias("leader"))
    stars = mates.join(leaders.hint("merge"), "bucket").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    wanted = nodes.select("node", "text_id", "words").join(mates.select("node").distinct().hint("merge"), "node", "left_semi")
    cells, cells_path = stash(cells_of(wanted, docs), "near-cells")
    links = verified(stars, cells)
    part, part_path = stash(components(links), "near-components")
    # Buckets that still hold several components: compare across them.
    told = mates.join(part.hint("merge"), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    several = told.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    open_, open_path = stash(told.join(several.hint("merge"), "bucket"), "near-open")
    small, large = open_.where(F.col("n") <= PAIRWISE), open_.where(F.col("n") > PAIRWISE)
    other = small.select("bucket", F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = small.withColumnRenamed("node", "a").join(other.hint("merge"), "bucket").where("a < b and component <> cb").select("a", "b").distinct()
    more = verified(rest, cells)
    grouped, _ = stash(group_links(large, cells), "near-links")
    for path in (mates_path, part_path, open_path, cells_path):
        drop_path(docs.sparkSession, path)
    return links.union(more).union(grouped)


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id, said, words of every row, with the class's number (group), class_id and text_id where a row with an id has these words."""
    sketched, path = stash(sketches(docs), "near-sketches")
    nodes, several = numbered(sketched)
    part, _ = stash(components(links_of(nodes, docs)), "near-components")
    named = nodes.select("words", "text_id", "node").join(part.hint("merge"), "node", "left").select("words", "text_id", F.coalesce("component", "node").alias("group"))
    if several:  # a class goes by the least id in it, which need not be that of its least node
        named = named.join(named.groupBy("group").agg(F.min("text_id").alias("class_id")).hint("merge"), "group")
    else:
        named = named.withColumn("class_id", F.col("group"))
    out = sketched.select("doc_id", "said", "words").join(named.hint("merge"), "words", "left")
    made, _ = stash(out.select("doc_id", "said", "words", "group", "class_id", "text_id"), "near-classes")
    drop_path(docs.sparkSession, path)
    return made


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and text_id for every row: the least id of its class, and the least with the same words."""
    own = F.col("doc_id").isNull() | F.col("class_id").isNull()
    return _classified(docs).select("doc_id", *[F.when(own, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "text_id")])


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class one row, that with the least id; and all rows without words.

    A row without an id goes where its words are in a class, else one of those with its words stays. Of rows alike in id
    and text any one stays.
    """
    met = _classified(docs).where("words is not null")
    # Rows of one class go by its number, those of words that no row with an id has by their words.
    rows = met.groupBy("group", F.when(F.col("group").isNull(), F.col("words")).alias("apart"), "doc_id", "said").agg(F.count("*").alias("n"))
    first = rows.groupBy("group", "apart").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "said", "n")).alias("k"))
    keepers, _ = stash(first.select(F.col("k.doc_id").alias("_id"), F.col("k.said").alias("_said"), F.col("k.n").alias("_n")), "near-keepers")
    flag, said = clear_of("row_n", docs.columns), clear_of("row_said", docs.columns)
    keyed = docs.withColumn(said, text_key())
    kept = keyed.join(keepers.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col(said) == F.col("_said"))).withColumn(flag, F.col("_n")).select(*docs.columns, said, flag)
    wordless = docs.where(F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WHITE_CHARS)) == "")
    if keepers.where("_n > 1").isEmpty():
        return kept.select(*docs.columns).union(wordless)
    kept, _ = stash(kept, "near-kept")
    once = kept.where(F.col(flag) > 1).dropDuplicates(["doc_id", said])
    return kept.where(F.col(flag) == 1).union(once).select(*docs.columns).union(wordless)


def report(docs: DataFrame) -> DataFrame:
    return classes(docs)
