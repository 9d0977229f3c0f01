"""LM scoring with a hierarchical Pitman-Yor model of three levels.

Words are drawn in Chinese restaurants: one for each two words before (u, v), whose parent is that of the one word before
(v), whose parent is the root, the unigram restaurant, whose base is uniform over the distinct training words and one
unknown word. Contexts go by the 64-bit hashes of their words, however many there are; the start of a text counts as a
word. A customer who opens a table is sent to the parent as a customer of the same word. Seating is sampled by Gibbs
moves, which take a customer out and seat them again by the weights that are left. A sweep moves every customer of every
(u, v), then of every v, class by class of crowds; customers of one class move at the same time, one of each word and
restaurant, and their parents' counts follow after the class. (The only customer of a word in a restaurant opens a table
whatever comes: their move is that of their customer at the parent.) Where a word has more than ROUNDS customers in a
restaurant, one in ROUNDS of them is out at a time. Concentrations are sampled between burn-in and samples by auxiliary
variables, discounts are fitted to counts of ones and twos at each level. Each sweep after burn-in is a sample; a token's
probability is the mean of its predictive probabilities, and a text's score the sum of their log10, the end included.

Words: the UTF-8 text with A-Z lower-cased, split at ASCII white space; 64-bit hashes stand for words (two of a billion
words share one with odds of 1 in 40). Edge cases: null or empty texts are an end only; with no training text all
probabilities are those of the uniform base; repeated rows and ids are scored one by one, each as its own text; a null
id is hashed as an empty one; extra columns are ignored; a text of any length is cut into pieces that know the two words
before them, and is one row again in the end.

How it is spread: texts become chunks of CHUNK_TOKENS tokens, coded by a vocabulary of their own. Homes, to which words
are dealt by hash, number all words, the frequent ones first, and tell chunks the numbers and training counts of theirs.
A chunk sends each shard its distinct triples (u, v, w) with counts. Shards are by v, so a restaurant of v and all below
it are in one place, and only the root is shared: the root's tables of a word are kept at the word's home, which is told
of the customers that shards send and tells their number and tables back, between burn-in and samples. A word v that is
more than a shard's share of all tokens is split by u; its restaurant's dishes are then kept at the words' homes like the
root's, with its totals as one number; a pair (u, v) of that size is split by w in the same way. Homes and shards meet
by joins on their numbers; the driver gets a few numbers for each level and each split context, of which there are at
most twice as many as shards. Shards and chunks are written once, dealt by their number, and read in place by all later
steps. Everything follows from the rows and fixed seeds, so a lost task is done again alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import Bucketed, drop_path, pieces, setting, stash, utf8

CHUNK_TOKENS = 2_000_000
#: Tokens for which there is a shard.
SHARD_TOKENS = 2_000_000
MIN_SHARDS = 32
BURN_IN, SAMPLES, ROOT_SWEEPS = 2, 3, 2
#: Shards for which there is a home of words.
HOME_SHARDS = 4
#: In so many steps at most a sweep moves the customers of a word in a restaurant.
ROUNDS = 64

#: The end of a text, and what stands before its first word; no word has white space or is empty.
END, BEFORE = b"\n", b""
#: Bits of a word's place in a chunk; words of all chunks have 32-bit numbers.
BITS = 21


class Coder(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(a: np.ndarray) -> bytes:
    """Byte planes, which compress better than whole numbers."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) + len(a).to_bytes(8, "little")


def unpacked(b: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(b[-8:], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b[:-8], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def arrow(schema: str) -> pa.Schema:
    """An Arrow schema of "name type" pairs: int, long, boolean, double, binary, longs or booleans (lists)."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), SUMS: pa.list_(_SUMS_ROW)}
    return pa.schema([(n, kinds[k]) for n, k in (part.split(" ", 1) for part in schema.split(", "))])


SUMS = "array<struct<what:int,key:long,first:double,second:double>>"
_SUMS_ROW = pa.struct([("what", pa.int32()), ("key", pa.int64()), ("first", pa.float64()), ("second", pa.float64())])
#: What a row of sums is about: words and tokens, tables and customers, counts of one and two by level, the draws for the
#: concentrations by level, tables and customers of split contexts of one word and of two, and tokens of frequent contexts.
SIZES, ROOT, ONES, DRAWN, SPLIT, SPLIT_PAIR, OFTEN, OFTEN_PAIR = range(8)


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def table_of(rows: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows, arrow(schema))])


def total(df: DataFrame) -> dict[tuple[int, int], tuple[float, float]]:
    """All sums of a table's rows: a few numbers by level and split context."""
    rows = df.where("sums is not null").select(F.explode("sums").alias("s")).groupBy("s.what", "s.key").agg(F.sum("s.first").alias("first"), F.sum("s.second").alias("second"))
    return {(r["what"], r["key"]): (r["first"], r["second"]) for r in rows.collect()}


# ---- chunks ----------------------------------------------------------------------------------------------------------

CHUNK = "chunk long, rows array<long>, doc_ids array<long>, trained array<boolean>, sizes array<long>, before binary, vocab binary, tokens binary, n_tokens long, n_trained long"


def chunks(docs: DataFrame, trained: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Documents as chunks of coded tokens; trained: whether the model learns from a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(CHUNK)
        task = TaskContext.get().partitionId() << 32
        coder, parts = Coder(), []
        made = held = row = 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate([p[3] for p in parts])
            vocab = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coder), np.uint64, len(coder))
            row_of = {
                "chunk": task + made, "rows": [p[0] for p in parts], "doc_ids": [p[1] for p in parts], "trained": [p[2] for p in parts], "sizes": [len(p[3]) for p in parts], "before": np.array([p[4] for p in parts], np.uint32).tobytes(),
                "vocab": vocab.tobytes(), "tokens": packed(tokens), "n_tokens": len(tokens), "n_trained": sum(len(p[3]) for p in parts if p[2]),
            }
            coder.clear(), parts.clear()
            return batch_of([row_of], schema)

        for batch in pieces(batches):
            for doc, use, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = (text or b"").lower().split()
                words.append(END)
                at = 0
                while at < len(words):
                    piece = words[at : at + chunk_tokens - held]
                    before = [coder[words[at - k] if at >= k else BEFORE] for k in (2, 1)]
                    parts.append((task + row, doc, bool(use), np.fromiter(map(coder.__getitem__, piece), np.uint32, len(piece)), before))
                    at, held = at + len(piece), held + len(piece)
                    if held >= chunk_tokens:
                        yield out()
                        made, held = made + 1, 0
                row += 1
        if parts:
            yield out()

    given = docs.select(F.col("doc_id").cast("long"), trained.alias("trained"), F.col("text").cast("binary"))
    return given.mapInArrow(run, CHUNK)


def spot(words: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which of so many parts a word is dealt to."""
    with np.errstate(over="ignore"):
        return ((words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def codes(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's u, v and w of each token as codes, the mask of training tokens and the sizes of its pieces."""
    tokens, before = unpacked(row["tokens"], np.uint32).astype(np.int64), np.frombuffer(row["before"], np.uint32).reshape(-1, 2).astype(np.int64)
    sizes = np.array(row["sizes"], np.int64)
    first = np.cumsum(sizes) - sizes
    v, u = np.empty_like(tokens), np.empty_like(tokens)
    v[1:], u[2:] = tokens[:-1], tokens[:-2]
    v[first], u[first] = before[:, 1], before[:, 0]
    long = first[sizes > 1]
    u[long + 1] = before[sizes > 1, 1]
    return u, v, tokens, np.repeat(np.array(row["trained"], bool), sizes), sizes


# ---- numbers of words ----------------------------------------------------------------------------------------------------

SPELLED = "home int, chunk long, words binary, counts binary, contexts binary"
NUMBERED = f"chunk long, home int, ids binary, counts binary, sums {SUMS}"


def home_of_hash(words: np.ndarray, homes: int) -> np.ndarray:
    return ((words >> np.uint64(40)) % np.uint64(homes)).astype(np.int64)


def spelling(row: dict, homes: int) -> list[dict]:
    """A chunk's words by home, with their training counts and how often they are the word before."""
    u, v, w, mask, _ = codes(row)
    vocab = np.frombuffer(row["vocab"], np.uint64)
    counts, contexts = np.bincount(w[mask], minlength=len(vocab)), np.bincount(v, minlength=len(vocab))
    home = home_of_hash(vocab, homes)
    by = np.argsort(home, kind="stable")
    ends = np.searchsorted(home[by], np.arange(homes + 1))
    return [{"home": int(h), "chunk": row["chunk"], "words": vocab[at].tobytes(), "counts": packed(counts[at]), "contexts": packed(contexts[at])} for h in np.flatnonzero(np.diff(ends)) for at in (by[ends[h] : ends[h + 1]],)]


def numbers(rows: list[dict], homes: int, least: float) -> list[dict]:
    """A home's answer to chunks: numbers of their words and training counts; and sums, with contexts of least tokens or more."""
    rows = sorted(rows, key=lambda r: r["chunk"])
    each = [np.frombuffer(r["words"], np.uint64) for r in rows]
    words, at = np.unique(np.concatenate(each), return_inverse=True)
    count, context = (np.bincount(at, np.concatenate([unpacked(r[n], np.int64) for r in rows]), len(words)).astype(np.int64) for n in ("counts", "contexts"))
    home, rank = rows[0]["home"], np.empty(len(words), np.int64)
    rank[np.argsort(-(count + context), kind="stable")] = np.arange(len(words))
    ids = rank * homes + home
    if ids.max() >= 1 << 32:
        raise OverflowError("more distinct words than 32 bits number")
    ends = np.cumsum([len(w) for w in each])
    out = [{"chunk": r["chunk"], "home": home, "ids": packed(ids[a].astype(np.uint32)), "counts": packed(count[a])} for r, a in zip(rows, (at[b - len(w) : b] for w, b in zip(each, ends, strict=True)), strict=True)]
    sums = [(SIZES, 0, (count > 0).sum(), count.sum()), *((OFTEN, int(ids[i]), context[i], 0.0) for i in np.flatnonzero(context > least))]
    return [*out, {"chunk": -1, "home": home, "sums": sums_of(sums)}]


def known(row: dict, told: list[dict], homes: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and training counts of a chunk's words, in the order of its codes."""
    vocab = np.frombuffer(row["vocab"], np.uint64)
    by = np.argsort(home_of_hash(vocab, homes), kind="stable")
    told = sorted((r for r in told if r["ids"] is not None), key=lambda r: r["home"])
    ids, counts = np.empty(len(vocab), np.int64), np.empty(len(vocab), np.int64)
    ids[by] = np.concatenate([unpacked(r["ids"], np.uint32) for r in told])
    counts[by] = np.concatenate([unpacked(r["counts"], np.int64) for r in told])
    return ids, counts


def frequent_pairs(row: dict, ids: np.ndarray, layout: Layout) -> list[dict]:
    """Pairs (u, v) of a split v with half a shard's share of the chunk's tokens at least."""
    u, v, _, _, _ = codes(row)
    at = np.flatnonzero(np.isin(ids, layout.words)[v])
    keys, n = np.unique(pair_key(ids[u[at]], ids[v[at]]), return_counts=True)
    some = n >= max(2, len(v) / layout.shards / 2)
    return sums_of([(OFTEN_PAIR, int(k), c, 0.0) for k, c in zip(keys[some].view(np.int64), n[some], strict=True)])


def sums_of(rows: list[tuple]) -> list[dict]:
    return [dict(zip(("what", "key", "first", "second"), (int(a), int(b), float(c), float(d)), strict=True)) for a, b, c, d in rows]


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A 64-bit number of two words."""
    return np.asarray(u, np.uint64) << np.uint64(32) | np.asarray(v, np.uint64)


@dataclass
class Layout:
    """Shards and homes, and into how many parts contexts of one word (by number) and of two (by pair_key) are split."""

    shards: int
    homes: int = 1
    split: dict[int, int] = field(default_factory=dict)
    split_pairs: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.words, self.pairs = np.array(sorted(self.split), np.int64), np.array(sorted(self.split_pairs), np.uint64)

    def home(self, words: np.ndarray) -> np.ndarray:
        return words % self.homes

    def shard(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = v % self.shards
        if len(self.words):
            at = np.flatnonzero(np.isin(v, self.words))
            parts = np.array([self.split[int(x)] for x in self.words])[np.searchsorted(self.words, v[at])]
            out[at] += spot(u[at], parts)
            if len(self.pairs):
                key = pair_key(u[at], v[at])
                both = np.flatnonzero(np.isin(key, self.pairs))
                parts = np.array([self.split_pairs[int(x)] for x in self.pairs])[np.searchsorted(self.pairs, key[both])]
                out[at[both]] += spot(w[at[both]], parts)
        return out % self.shards


class Triples:
    """A chunk's distinct (u, v, w), sorted by v, u and w, and the triple of each token; ids: numbers of its words."""

    def __init__(self, row: dict, ids: np.ndarray, layout: Layout) -> None:
        order = np.argsort(ids)
        self.words = ids[order]
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        u, v, self.codes, mask, self.sizes = codes(row)
        low = (1 << BITS) - 1
        keys, self.triple = np.unique((rank[v] << 2 * BITS) | (rank[u] << BITS) | rank[self.codes], return_inverse=True)
        self.v, self.u, self.w = (self.words[x] for x in (keys >> 2 * BITS, (keys >> BITS) & low, keys & low))
        self.count = np.bincount(self.triple[mask], minlength=len(keys))
        shard = layout.shard(self.u, self.v, self.w)
        self.by = np.argsort(shard.astype(np.int32), kind="stable")
        self.ends = np.searchsorted(shard[self.by], np.arange(layout.shards + 1))

    def of_shard(self) -> Iterator[tuple[int, np.ndarray]]:
        for s in np.flatnonzero(np.diff(self.ends)):
            yield int(s), self.by[self.ends[s] : self.ends[s + 1]]


SENT = "shard int, chunk long, v binary, u binary, w binary, count binary"


def letters(row: dict, ids: np.ndarray, layout: Layout) -> list[dict]:
    """What a chunk sends to shards: triples with training counts (0: to be scored only)."""
    t, small = Triples(row, ids, layout), lambda x: packed(x.astype(np.uint32))
    return [{"shard": s, "chunk": row["chunk"], "v": small(np.diff(t.v[at], prepend=0)), "u": small(t.u[at]), "w": small(t.w[at]), "count": small(t.count[at])} for s, at in t.of_shard()]


def by_chunk(chunked: DataFrame, told: DataFrame, schema: str, work) -> DataFrame:
    """work(chunk, numbers of its words, their counts), which gives rows, for all chunks."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row, answers = chunk.to_pylist()[0], answers.to_pylist()
        return table_of(work(row, answers), schema)

    return chunked.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


# ---- shards ----------------------------------------------------------------------------------------------------------

#: A shard's triples, what it asks homes, and where it stands; a row has one of the three.
SHARD = f"shard int, w binary, count binary, per_pair binary, per_word binary, contexts binary, pair_at binary, pair_of binary, chunks array<long>, sizes array<long>, places binary, home int, asked binary, customers binary, split_at binary, split_of binary, split_customers binary, sums {SUMS}"
BODY = ("shard", "w", "count", "per_pair", "per_word", "contexts", "pair_at", "pair_of", "chunks", "sizes", "places", "asked")
ASK = ("home", "shard", "asked", "customers", "split_at", "split_of", "split_customers")


def merged_rows(rows: list[dict], layout: Layout) -> list[dict]:
    """One shard out of what all chunks sent to it, with where each chunk's triples are, and its first questions."""
    rows = sorted(rows, key=lambda r: r["chunk"])
    read = lambda name: (unpacked(r[name], np.uint32) for r in rows)
    v, u, w = np.concatenate([np.cumsum(x, dtype=np.int64) for x in read("v")]), *(np.concatenate(list(read(n))).astype(np.int64) for n in ("u", "w"))
    pairs, pair = np.unique((v << 32) | u, return_inverse=True)
    keys, place = np.unique((pair << 32) | w, return_inverse=True)
    counts = list(read("count"))
    count, sizes = np.bincount(place, np.concatenate(counts), len(keys)).astype(np.int64), [len(c) for c in counts]
    targets, target = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
    of_word = pairs >> 32
    contexts = np.unique(of_word)
    # Contexts of two words that are split: which they are, and their numbers in the layout.
    split = np.flatnonzero(np.isin(of_word, layout.words)) if len(layout.pairs) else np.empty(0, np.int64)
    found = pair_key(pairs[split] & 0xFFFFFFFF, of_word[split])
    split, found = split[np.isin(found, layout.pairs)], found[np.isin(found, layout.pairs)]
    body = {
        "shard": rows[0]["shard"], "w": packed(target.astype(np.uint32)), "count": packed(count.astype(np.uint32)), "per_pair": packed(np.bincount(keys >> 32, minlength=len(pairs)).astype(np.uint32)),
        "per_word": packed(np.bincount(np.searchsorted(contexts, of_word), minlength=len(contexts)).astype(np.uint32)), "contexts": packed(np.diff(contexts, prepend=0).astype(np.uint32)),
        "pair_at": packed(split.astype(np.uint32)), "pair_of": packed(np.searchsorted(layout.pairs, found).astype(np.uint32)),
        "chunks": [r["chunk"] for r in rows], "sizes": sizes, "places": packed(np.diff(place, prepend=0).astype(np.int32)),
    }
    s = Shard(body, targets, layout)
    start = np.minimum(count, 1)
    sums = [(ONES, 3, (count == 1).sum(), (count == 2).sum())]
    came = s.customers(start)
    local = came[~s.apart]
    sums += [(ONES, 2, (local == 1).sum(), (local == 2).sum()), *s.pair_totals(start)]
    return [body, *s.questions(came, np.minimum(came, 1), sums)]


#: The weights of opening a table for some dishes, of which so many tables are gone with the customers who are out.
Weights = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Tables:
    """Tables with their customers, sorted by the dish (a number) they serve; and of each dish, customers and tables."""

    def __init__(self, dish: np.ndarray, size: np.ndarray, n: int) -> None:
        self.dish, self.size = dish, size
        self.customers, self.tables = np.bincount(dish, size, n).astype(np.int64), np.bincount(dish, minlength=n)

    def _first(self) -> np.ndarray:
        return np.cumsum(self.tables) - self.tables

    def _pick(self, dishes: np.ndarray, less: float, rng: np.random.Generator) -> np.ndarray:
        """For each dish one of its tables, by size less a constant."""
        first, many = self._first()[dishes], self.tables[dishes]
        if (several := np.flatnonzero(many > 1)).size:
            sums = np.cumsum(self.size - less)
            low, past = first[several], first[several] + many[several]
            began = np.where(low > 0, sums[low - 1], 0.0)
            at = np.searchsorted(sums, began + rng.random(len(several)) * (sums[past - 1] - began), "right")
            first[several] = np.clip(at, low, past - 1)
        return first

    def take(self, dishes: np.ndarray, rng: np.random.Generator, many: np.ndarray | None = None) -> np.ndarray:
        """Take one customer (or so many) of each of some distinct dishes out, all customers alike; empty tables go.

        Returns how many tables of each of these dishes went.
        """
        if not len(dishes):
            return np.zeros(0, np.int64)
        if many is None:
            at = self._pick(dishes, 0.0, rng)
            self.size[at] -= 1
        else:  # evenly spaced among the dish's customers, who are in the order of their tables
            first, step = (np.cumsum(self.customers) - self.customers)[dishes], self.customers[dishes] / many
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out = np.floor((np.repeat(rng.random(len(dishes)) * 0.999999, many) + nth) * np.repeat(step, many)).astype(np.int64)
            at = np.searchsorted(np.cumsum(self.size), np.repeat(first, many) + out, "right")
            self.size -= np.bincount(at, minlength=len(self.size))
            at = np.unique(at)  # a table can lose several
        self.customers[dishes] -= 1 if many is None else many
        gone = at[self.size[at] == 0]
        if not len(gone):
            return np.zeros(len(dishes), np.int64)
        less = np.bincount(self.dish[gone], minlength=len(self.tables))
        self.tables -= less
        self.dish, self.size = np.delete(self.dish, gone), np.delete(self.size, gone)
        return less[dishes]

    def seat(self, dishes: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator, many: np.ndarray | None = None) -> None:
        """Seat one customer (or so many, at once) for each of some distinct dishes; new: the weight of opening a table."""
        if not len(dishes):
            return
        old = self.customers[dishes] - discount * self.tables[dishes]
        if many is None:
            alone = rng.random(len(dishes)) * (old + new) >= old
            joins, opened = dishes[~alone], dishes[alone]
        else:
            opens = rng.binomial(many, np.clip(new / (old + new), 0, 1))
            joins, opened = np.repeat(dishes, many - opens), np.repeat(dishes, opens)
        if len(joins):
            self.size += np.bincount(self._pick(joins, discount, rng), minlength=len(self.size))
        self.customers[dishes] += 1 if many is None else many
        if len(opened):
            at = (self._first() + self.tables)[opened]
            self.dish, self.size = np.insert(self.dish, at, opened), np.insert(self.size, at, 1)
            self.tables += np.bincount(opened, minlength=len(self.tables))

    def stir(self, weights: Weights, discount: float, rng: np.random.Generator) -> None:
        """Move as many customers of each dish as it has.

        weights gives the weight of opening a table for some dishes, told how many of their tables went with those who are
        out: what they leave behind, here and at the parents, does not count for them.
        """
        have = self.customers.copy()
        # Of two customers one move draws the seating anew: that of the other would do so again.
        steps = np.where(have == 2, 1, np.minimum(have, ROUNDS))
        for r in range(steps.max(initial=0)):
            dishes = np.flatnonzero(steps > r)
            many = np.where(have[dishes] == 2, 1, have[dishes] * (r + 1) // steps[dishes] - have[dishes] * r // steps[dishes])
            many = None if (many == 1).all() else many
            gone = self.take(dishes, rng, many)
            self.seat(dishes, weights(dishes, gone), discount, rng, many)

    def part(self, dishes: np.ndarray) -> Tables:
        """The tables of some sorted dishes, numbered anew."""
        number = np.full(len(self.customers), -1)
        number[dishes] = np.arange(len(dishes))
        number = number[self.dish]
        return Tables(number[number >= 0], self.size[number >= 0], len(dishes))

    def put(self, dishes: np.ndarray, part: Tables) -> None:
        """Take such a part back."""
        keep = np.ones(len(self.customers), bool)
        keep[dishes] = False
        rest = keep[self.dish]
        dish = np.concatenate([self.dish[rest], dishes[part.dish]])
        by = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[by], np.concatenate([self.size[rest], part.size])[by]
        self.customers[dishes], self.tables[dishes] = part.customers, part.tables

    def reseat(self, dishes: np.ndarray, tables: np.ndarray, customers: np.ndarray) -> None:
        """Give distinct dishes these customers at so many tables: one holds who is left when each other has one."""
        keep = np.ones(len(self.customers), bool)
        keep[dishes] = False
        rest = keep[self.dish]
        size = np.ones(tables.sum(), np.int64)
        size[np.cumsum(tables) - tables] = customers - tables + 1
        dish = np.concatenate([self.dish[rest], np.repeat(dishes, tables)])
        by = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[by], np.concatenate([self.size[rest], size])[by]
        self.customers[dishes], self.tables[dishes] = customers, tables


def classes(count: np.ndarray) -> np.ndarray:
    """Doubling classes of counts (0: nothing to move), so that what is stirred together takes about as many steps."""
    return np.ceil(np.log2(np.clip(count, 1, ROUNDS + 1))).astype(np.int64)


def first_tables(count: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """How many tables count customers open who come one after another, drawn for doubling crowds at a time."""
    tables, seated = np.minimum(count, 1), np.minimum(count, 1)
    while (some := np.flatnonzero(seated < count)).size:
        crowd = np.minimum(seated[some], count[some] - seated[some])
        odds = new[some] / np.maximum(new[some] + seated[some] - discount * tables[some], 1e-12)
        tables[some] += rng.binomial(crowd, np.clip(odds, 0, 1))
        seated[some] += crowd
    return tables


def begun(count: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> Tables:
    """A seating of count customers of each dish to start from."""
    out = Tables(np.flatnonzero(count), count[count > 0].astype(np.int64), len(count))
    dishes = np.flatnonzero(count)
    out.reseat(dishes, first_tables(count[dishes], new[dishes], discount, rng), count[dishes])
    return out


def stir_all(seats: Tables, weights: Callable[[np.ndarray, Tables], Weights], discount: float, rng: np.random.Generator) -> None:
    """Move all customers, class by class; weights makes the weights for a class, its dishes and their tables, as things are."""
    kind = classes(seats.customers)
    for c in range(1, kind.max(initial=0) + 1):
        if (dishes := np.flatnonzero(kind == c)).size:
            part = seats.part(dishes)
            part.stir(weights(dishes, part), discount, rng)
            seats.put(dishes, part)


class Rooms:
    """Tables of the restaurants that a class of dishes is in, as the class is stirred."""

    def __init__(self, room: np.ndarray, tables: np.ndarray, seats: Tables) -> None:
        """room: each dish's restaurant; tables: of all restaurants, the class included."""
        rooms, self.at = np.unique(room, return_inverse=True)
        self.seats, self.others = seats, tables[rooms] - np.bincount(self.at, seats.tables, len(rooms))

    def without(self, dishes: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """The tables there are for the customers who are out, each dish's own aside: those that went with others stay."""
        at = self.at[dishes]
        now = self.others + np.bincount(self.at, self.seats.tables, len(self.others)) + np.bincount(at, gone, len(self.others))
        return now[at] - gone


def follow(seats: Tables, want: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> None:
    """Customers come to a parent and leave it as tables of its children open and go."""
    less = np.flatnonzero(want < seats.customers)
    seats.take(less, rng, seats.customers[less] - want[less])
    while (more := np.flatnonzero(want > seats.customers)).size:  # few at a time for those who are there
        crowd = np.minimum(want[more] - seats.customers[more], np.maximum(seats.customers[more] // 4, 1))
        seats.seat(more, new[more], discount, rng, crowd)


@dataclass
class Model:
    """What is known of the whole: discounts and concentrations by level (1: the root), and totals."""

    discount: dict[int, float]
    theta: dict[int, float]
    vocabulary: int = 0
    trained: int = 0
    root_tables: float = 0.0
    root_customers: float = 0.0
    #: Tables and customers of split contexts, in the order of the layout's.
    split: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    split_pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))

    @property
    def base(self) -> float:
        return 1 / (self.vocabulary + 1)

    def opening(self, level: int, tables):
        """The weight of a new table in a restaurant with these tables, before the parent's probability."""
        return self.theta[level] + self.discount[level] * tables

    def root(self, customers: np.ndarray, tables: np.ndarray, more: float = 0.0) -> np.ndarray:
        """The root's predictive probability of words with these customers and tables there."""
        seated = np.maximum(customers - self.discount[1] * np.minimum(tables, customers), 0.0)
        return (seated + self.opening(1, self.root_tables) * self.base) / (self.theta[1] + self.root_customers + more)


def drawn(customers: np.ndarray, tables: np.ndarray, theta: float, discount: float, rng: np.random.Generator) -> tuple[float, float]:
    """The auxiliary draws of restaurants for their level's concentration: successes, and minus the sum of logs."""
    some = customers > 1
    logs = -np.log(np.maximum(rng.beta(theta + 1, customers[some] - 1.0), 1e-300)).sum()
    more = np.maximum(tables - 1, 0).astype(np.int64)
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    return float((rng.random(len(nth)) * (theta + discount * nth) < theta).sum()), float(logs)


class Shard:
    """A shard's triples and their seating in two levels. Everything follows from the shard's rows, the model and a seed."""

    @staticmethod
    def of_rows(rows: list[dict], layout: Layout) -> Shard:
        """Out of its row and its first questions, which hold its targets."""
        asked = [np.cumsum(unpacked(r["asked"], np.uint32), dtype=np.int64) for r in rows if r.get("asked") is not None]
        return Shard(next(r for r in rows if r.get("w") is not None), np.sort(np.concatenate(asked)), layout)

    def __init__(self, row: dict, targets: np.ndarray, layout: Layout) -> None:
        self.row, self.layout, self.targets = row, layout, targets
        self.w, self.count = unpacked(row["w"], np.uint32).astype(np.int64), unpacked(row["count"], np.uint32).astype(np.int64)
        per_pair, per_word = unpacked(row["per_pair"], np.uint32), unpacked(row["per_word"], np.uint32)
        contexts = np.cumsum(unpacked(row["contexts"], np.uint32), dtype=np.int64)
        self.pair = np.repeat(np.arange(len(per_pair)), per_pair)
        self.n_pairs, self.n_words = len(per_pair), len(per_word)
        word_of = np.repeat(np.arange(len(per_word)), per_word)
        #: The parent's dish of each triple; a dish's context and word.
        dishes, self.dish = np.unique((word_of[self.pair] << 32) | self.w, return_inverse=True)
        self.of, self.word = dishes >> 32, dishes & 0xFFFFFFFF
        #: Split contexts: their number in the layout, -1 for those that are here as a whole; and dishes of the former.
        self.split = np.full(len(contexts), -1)
        self.pair_split = np.full(self.n_pairs, -1)
        if len(layout.words):
            at = np.flatnonzero(np.isin(contexts, layout.words))
            self.split[at] = np.searchsorted(layout.words, contexts[at])
            self.pair_split[unpacked(row["pair_at"], np.uint32)] = unpacked(row["pair_of"], np.uint32)
        self.apart = self.split[self.of] >= 0
        self.home = layout.home(self.targets)
        self._sort_out()

    def _sort_out(self) -> None:
        """What can change at all: triples with several customers (many), and dishes with several in all (act).

        All others have one table for each customer whatever comes; of them there are only totals.
        """
        whole = np.bincount(self.dish, self.count, len(self.of)).astype(np.int64)
        self.act = np.flatnonzero(whole >= 2)
        self.idle = ((whole == 1) & ~self.apart).astype(np.int64)
        number = np.full(len(self.of), -1)
        number[self.act] = np.arange(len(self.act))
        many = np.flatnonzero(self.count >= 2)
        kind = classes(self.count[many])
        by = np.argsort(kind, kind="stable")
        self.many = many[by]
        ends = np.searchsorted(kind[by], np.arange(1, kind.max(initial=0) + 2))
        self.slices = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]
        self.many_dish = number[self.dish[self.many]]
        self.m_pairs, self.m_pair = np.unique(self.pair[self.many], return_inverse=True)
        lone = np.flatnonzero(self.count == 1)
        self.lone_pair = np.bincount(self.pair[lone], minlength=self.n_pairs)[self.m_pairs]
        at = number[self.dish[lone]]
        self.lone_dish = np.bincount(at[at >= 0], minlength=len(self.act))
        self.a_of, self.a_apart = self.of[self.act], self.apart[self.act]
        self.a_words, self.a_word = np.unique(self.word[self.act], return_inverse=True)
        self.idle_of = np.bincount(self.of, self.idle, self.n_words)

    def customers(self, tables: np.ndarray) -> np.ndarray:
        """Customers of each of the parents' dishes, from the tables of the triples."""
        return np.bincount(self.dish, tables, len(self.of)).astype(np.int64)

    def sent_to_root(self, tables: np.ndarray) -> np.ndarray:
        """The root's customers of each target, from the tables of dishes whose context is here."""
        return np.bincount(self.word[~self.apart], tables[~self.apart], len(self.targets)).astype(np.int64)

    def pair_totals(self, tables: np.ndarray) -> list[tuple]:
        """Tables and customers here of split contexts of two words."""
        held = np.flatnonzero(self.pair_split >= 0)
        t, c = (np.bincount(self.pair, x, self.n_pairs) for x in (tables, self.count))
        return [(SPLIT_PAIR, int(self.pair_split[i]), t[i], c[i]) for i in held]

    def by_home(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each home: its targets, its dishes of split contexts, and where among the targets their words are."""
        by = np.argsort(self.home, kind="stable")
        far = np.flatnonzero(self.apart)
        far = far[np.argsort(self.home[self.word[far]], kind="stable")]
        ends, far_ends = (np.searchsorted(x, np.arange(self.layout.homes + 1)) for x in (self.home[by], self.home[self.word[far]]))
        for h in np.flatnonzero(np.diff(ends)):
            mine, split = by[ends[h] : ends[h + 1]], far[far_ends[h] : far_ends[h + 1]]
            yield int(h), mine, split, np.searchsorted(mine, self.word[split])

    def questions(self, came: np.ndarray, tables: np.ndarray, sums: list[tuple]) -> list[dict]:
        """A row for each home, and one of sums."""
        to_root = self.sent_to_root(tables)
        rows = [
            {
                "shard": self.row["shard"], "home": h, "asked": packed(np.diff(self.targets[mine], prepend=0).astype(np.uint32)), "customers": packed(to_root[mine]),
                "split_at": packed(at.astype(np.uint32)), "split_of": packed(self.split[self.of[far]].astype(np.uint32)), "split_customers": packed(came[far]),
            }
            for h, mine, far, at in self.by_home()
        ]
        return [*rows, {"shard": self.row["shard"], "sums": sums_of(sums)}]

    def hear(self, answers: list[dict], model: Model) -> None:
        """Take in what homes told of the root and of split contexts."""
        said = {r["home"]: r for r in answers}
        n = len(self.targets)
        self.root_customers, self.root_tables = np.zeros(n, np.int64), np.zeros(n)
        self.far_customers, self.far_tables = np.zeros(len(self.of), np.int64), np.zeros(len(self.of))
        for h, mine, far, _ in self.by_home():
            r = said[h]
            self.root_customers[mine], self.root_tables[mine] = unpacked(r["customers"], np.int64), unpacked(r["tables"], np.uint32) / SAMPLES
            self.far_customers[far], self.far_tables[far] = unpacked(r["split_customers"], np.int64), unpacked(r["split_tables"], np.uint32)
        self.model = model

    # ---- seating ----

    def begin(self, rng: np.random.Generator) -> None:
        """Seat all customers one after another, from the homes' first answers."""
        m = self.model
        self.seated = np.ones(len(self.many), np.int64)
        came = self._came()
        self._told(self.customers(self.tables()), np.minimum(self.customers(self.tables()), 1))
        self.parent = begun(np.where(self.a_apart, 0, came), self._new_parent(np.minimum(came, 1)), m.discount[2], rng)
        new = self._new(slice(None))
        self.seats = []
        for g in self.slices:
            self.seats.append(begun(self.count[self.many[g]], new[g], m.discount[3], rng))
            self.seated[g] = self.seats[-1].tables
        self._follow(rng)

    def resume(self, state: dict) -> None:
        """Go on from a state that was kept."""
        read = lambda name, n: Tables(np.cumsum(unpacked(state[name + "_dish"], np.uint32), dtype=np.int64), unpacked(state[name + "_size"], np.uint32).astype(np.int64), n)
        together = read("seat", len(self.many))
        self.seats = [together.part(np.arange(g.start, g.stop)) for g in self.slices]
        self.seated = together.tables
        # A dish with one customer has one table; the others' are kept.
        came = np.where(self.a_apart, 0, self._came())
        kept, lone = read("parent", len(self.act)), np.flatnonzero(came == 1)
        dish = np.concatenate([kept.dish, lone])
        by = np.argsort(dish, kind="stable")
        self.parent = Tables(dish[by], np.concatenate([kept.size, np.ones(len(lone), np.int64)])[by], len(self.act))
        self._told(self.customers(self.tables()), self.parent_tables())

    def state(self) -> dict:
        dish = np.concatenate([s.dish + g.start for s, g in zip(self.seats, self.slices, strict=True)]) if self.seats else np.empty(0, np.int64)
        size = np.concatenate([s.size for s in self.seats]) if self.seats else np.empty(0, np.int64)
        small = lambda x: packed(x.astype(np.uint32))
        several = self.parent.customers[self.parent.dish] > 1
        parent_dish, parent_size = self.parent.dish[several], self.parent.size[several]
        return {"shard": self.row["shard"], "seat_dish": small(np.diff(dish, prepend=0)), "seat_size": small(size), "parent_dish": small(np.diff(parent_dish, prepend=0)), "parent_size": small(parent_size)}

    def tables(self) -> np.ndarray:
        """Tables of each triple."""
        out = np.minimum(self.count, 1)
        out[self.many] = self.seated
        return out

    def parent_tables(self) -> np.ndarray:
        """Tables of each of the parents' dishes, as far as they are here."""
        out = self.idle.copy()
        out[self.act] = self.parent.tables
        return out

    def _told(self, came: np.ndarray, tables: np.ndarray) -> None:
        """Note what of the homes' numbers is this shard's own."""
        self.mine_came, self.mine_root = came[self.act], self.sent_to_root(tables)
        held = self.pair_split >= 0
        self.other_tables, self.pair_customers = np.zeros(self.n_pairs), np.bincount(self.pair, self.count, self.n_pairs)
        if held.any():
            told = self.model.split_pairs[self.pair_split[held]]
            self.other_tables[held], self.pair_customers[held] = told[:, 0] - np.bincount(self.pair, self.tables(), self.n_pairs)[held], told[:, 1]
        # Of the root: the words of dishes that can change.
        self.a_root = self.root_customers[self.a_words], self.root_tables[self.a_words], self.mine_root[self.a_words] - self._to_root(np.zeros(len(self.act)), idle=True)

    def _to_root(self, tables: np.ndarray, idle: bool = False) -> np.ndarray:
        """Customers that dishes send the root, by word of those that can change; idle: from all others."""
        if idle:
            return np.bincount(self.word, self.idle, len(self.targets))[self.a_words]
        return np.bincount(self.a_word, np.where(self.a_apart, 0, tables), len(self.a_words))

    def _came(self) -> np.ndarray:
        """Customers of each dish that can change."""
        return self.lone_dish + np.bincount(self.many_dish, self.seated, len(self.act)).astype(np.int64)

    def _root(self, tables: np.ndarray) -> tuple[np.ndarray, float]:
        """The root's probability of each word whose dishes can change, and by how many customers the root has changed."""
        customers, held, mine = self.a_root
        change = self._to_root(tables) - mine
        more = float(change.sum())
        return self.model.root(customers + change, held, more), more

    def _word_totals(self, came: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables and customers of each context of one word."""
        t = self.idle_of + np.bincount(self.a_of, np.where(self.a_apart, 0, tables), self.n_words)
        c = self.idle_of + np.bincount(self.a_of, np.where(self.a_apart, came - self.mine_came, came), self.n_words)
        held = self.split >= 0
        if held.any():
            told = self.model.split[self.split[held]]
            t[held] += told[:, 0]
            c[held] += told[:, 1]
        return t, np.maximum(c, 0)

    def _new_parent(self, tables: np.ndarray, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The weight of a new table for some of the parents' dishes that can change."""
        t = self.idle_of + np.bincount(self.a_of, np.where(self.a_apart, 0, tables), self.n_words)
        return self.model.opening(2, t)[self.a_of[some]] * self._root(tables)[0][self.a_word[some]]

    def _parents(self, some: np.ndarray, rng: np.random.Generator) -> Weights:
        """The parents' predictive probability of some dishes that can change, without customers whose tables are gone.

        Such a customer may have been alone at a table there, which then is gone too, with its customer at the root.
        """
        m, came, tables = self.model, self._came(), self.parent.tables
        t, c = self._word_totals(came, tables)
        far, of, word = self.a_apart[some], self.a_of[some], self.a_word[some]
        customers = np.where(far, self.far_customers[self.act[some]] + came[some] - self.mine_came[some], came[some])
        held = np.where(far, self.far_tables[self.act[some]], tables[some])
        alone = np.bincount(self.parent.dish[self.parent.size == 1], minlength=len(self.act))[some]
        alone = np.where(far, np.where(customers <= held, customers, 0), alone)
        t, c = t[of], c[of]
        at_root, root_tables, mine = self.a_root
        change = self._to_root(tables) - mine
        at_root, root_tables, more = (at_root + change)[word], root_tables[word], float(change.sum())

        def without(at: np.ndarray, gone: np.ndarray) -> np.ndarray:
            there, known = customers[at], held[at]
            left = np.maximum(there - gone, 0)
            lost = np.zeros(len(at), np.int64)
            if (some := np.flatnonzero(gone)).size:
                lost[some] = rng.binomial(gone[some], np.clip(alone[at[some]] / np.maximum(there[some], 1), 0, 1))
            lost = np.where(left == 0, known, np.minimum(lost, np.maximum(known - 1, 0)))
            root = m.root(np.maximum(at_root[at] - lost, 0), root_tables[at], more - lost)
            stays = np.maximum(left - m.discount[2] * np.minimum(known - lost, left), 0.0)
            return (stays + m.opening(2, np.maximum(t[at] - lost, 0)) * root) / (m.theta[2] + np.maximum(c[at] - gone, 0))

        return without

    def _totals(self) -> np.ndarray:
        """Tables of each context of two words in which something can change."""
        return self.lone_pair + self.other_tables[self.m_pairs] + np.bincount(self.m_pair, self.seated, len(self.m_pairs))

    def _new(self, group: slice) -> np.ndarray:
        """The weight of a new table for a class of triples with several customers, all in their places."""
        all_of, none = self.many_dish[group], np.zeros(len(self.many[group]), np.int64)
        return self.model.opening(3, self._totals())[self.m_pair[group]] * self._parents(all_of, np.random.default_rng(0))(np.arange(len(none)), none)

    def _moving(self, group: slice, seats: Tables, rng: np.random.Generator) -> Weights:
        """The weights of new tables for customers of a class of triples who are out."""
        rooms, parents = Rooms(self.m_pair[group], self._totals(), seats), self._parents(self.many_dish[group], rng)
        return lambda dishes, gone: self.model.opening(3, rooms.without(dishes, gone)) * parents(dishes, gone)

    def _moving_parents(self, dishes: np.ndarray, part: Tables) -> Weights:
        """The same for customers of a class of the parents' dishes."""
        m, tables = self.model, self.parent.tables
        t = self.idle_of + np.bincount(self.a_of, np.where(self.a_apart, 0, tables), self.n_words)
        rooms = Rooms(self.a_of[dishes], t, part)
        at_root, held, mine = self.a_root
        change, word = self._to_root(tables) - mine, self.a_word[dishes]
        at_root, held, more = (at_root + change)[word], held[word], float(change.sum())
        return lambda some, gone: m.opening(2, rooms.without(some, gone)) * m.root(np.maximum(at_root[some] - gone, 0), held[some], more - gone)

    def _follow(self, rng: np.random.Generator) -> None:
        """Customers come to the parents and leave them as tables of triples open and go."""
        want, seats, d = np.where(self.a_apart, 0, self._came()), self.parent, self.model.discount[2]
        changed = np.flatnonzero(want != seats.customers)
        if not len(changed):
            return
        new = self._new_parent(seats.tables, changed)
        part = seats.part(changed)
        follow(part, want[changed], new, d, rng)
        seats.put(changed, part)

    def sweep(self, rng: np.random.Generator) -> None:
        """Move every customer of every triple, then every customer of the parents."""
        m = self.model
        for g, seats in zip(self.slices, self.seats, strict=True):
            seats.stir(self._moving(g, seats, rng), m.discount[3], rng)
            self.seated[g] = seats.tables
            self._follow(rng)
        stir_all(self.parent, self._moving_parents, m.discount[2], rng)

    def predictive(self) -> np.ndarray:
        """The probability of each triple's word in its context."""
        m, tables = self.model, self.tables()
        came, t_dish = self.customers(tables), self.parent_tables()
        more = self._root(self.parent.tables)[1]
        customers = self.root_customers.astype(float)
        customers[self.a_words] += self._to_root(self.parent.tables) - self.a_root[2]
        root = m.root(customers, self.root_tables, more)
        t, c = self._word_totals(self._came(), self.parent.tables)
        if self.apart.any():
            came, t_dish = np.where(self.apart, self.far_customers, came).astype(float), np.where(self.apart, self.far_tables, t_dish)
            came[self.act] += np.where(self.a_apart, self._came() - self.mine_came, 0)
        stays = np.maximum(came - m.discount[2] * np.minimum(t_dish, came), 0.0)
        parents = (stays + m.opening(2, t)[self.of] * root[self.word]) / (m.theta[2] + c)[self.of]
        t_pair = np.bincount(self.pair, tables, self.n_pairs) + self.other_tables
        return (self.count - m.discount[3] * tables + m.opening(3, t_pair)[self.pair] * parents[self.dish]) / (m.theta[3] + self.pair_customers)[self.pair]

    def draws(self, rng: np.random.Generator) -> list[tuple]:
        """Draws for the concentrations, of contexts that are here as a whole."""
        m, whole, tables = self.model, self.pair_split < 0, self.tables()
        three = drawn(self.pair_customers[whole], np.bincount(self.pair, tables, self.n_pairs)[whole], m.theta[3], m.discount[3], rng)
        t, c = (np.bincount(self.of, np.where(self.apart, 0, x), self.n_words) for x in (self.parent_tables(), self.customers(tables)))
        return [(DRAWN, 3, *three), (DRAWN, 2, *drawn(c, t, m.theta[2], m.discount[2], rng))]


# ---- homes -----------------------------------------------------------------------------------------------------------

TOLD = f"shard int, home int, customers binary, tables binary, split_customers binary, split_tables binary, sums {SUMS}"


def home_answers(rows: list[dict], model: Model | None) -> list[dict]:
    """What a home answers each shard: the root's customers and tables of its words, and split contexts' of theirs.

    Without a model each word has one table, to start from; else tables are drawn for the customers there are, SAMPLES
    times; told is their sum.
    """
    rows = sorted(rows, key=lambda r: r["shard"])
    rng = np.random.default_rng([11, rows[0]["home"]])
    each = [np.cumsum(unpacked(r["asked"], np.uint32), dtype=np.int64) for r in rows]
    words, at = np.unique(np.concatenate(each), return_inverse=True)
    ends = np.cumsum([len(w) for w in each])
    at = [at[b - len(w) : b] for w, b in zip(each, ends, strict=True)]
    root = np.bincount(np.concatenate(at), np.concatenate([unpacked(r["customers"], np.int64) for r in rows]), len(words)).astype(np.int64)
    key = [(unpacked(r["split_of"], np.uint32).astype(np.int64) << 32) | a[unpacked(r["split_at"], np.uint32)] for r, a in zip(rows, at, strict=True)]
    dishes, dish = np.unique(np.concatenate(key), return_inverse=True)
    came = np.bincount(dish, np.concatenate([unpacked(r["split_customers"], np.int64) for r in rows]), len(dishes)).astype(np.int64)
    of, word = dishes >> 32, dishes & 0xFFFFFFFF
    if model is None:
        far = np.minimum(came, 1)
        root = root + np.bincount(word, far, len(words)).astype(np.int64)
        tables = np.minimum(root, 1) * SAMPLES
    else:
        # Split contexts first, whose tables are customers of the root.
        there = root + np.bincount(word, np.minimum(came, 1), len(words))
        held = model.split[of, 0] if len(of) else np.zeros(0)
        moved = lambda some, gone: model.opening(2, np.maximum(held[some] - gone, 0)) * model.root(np.maximum(there[word[some]] - gone, 0), np.minimum(root, 1)[word[some]])
        far = seated(came, moved, model.discount[2], rng)
        root = root + np.bincount(word, far, len(words)).astype(np.int64)
        tables = np.zeros(len(words), np.int64)
        seats = begun(root, np.full(len(words), model.opening(1, model.root_tables) * model.base), model.discount[1], rng)
        for k in range(ROOT_SWEEPS + SAMPLES):
            stir_all(seats, lambda dishes, part: lambda some, gone: model.opening(1, np.maximum(model.root_tables - gone, 0)) * model.base, model.discount[1], rng)
            if k >= ROOT_SWEEPS:
                tables += seats.tables
    sums = [(ROOT, 0, tables.sum() / SAMPLES, root.sum()), (ONES, 1, (root == 1).sum(), (root == 2).sum())]
    sums += [(SPLIT, int(k), t, c) for k, t, c in zip(np.unique(of), np.bincount(of, far)[np.unique(of)], np.bincount(of, came)[np.unique(of)], strict=True)] if len(of) else []
    out, b = [], 0
    for r, a, k in zip(rows, at, key, strict=True):
        d = dish[b : b + len(k)]
        b += len(k)
        out.append({"shard": r["shard"], "home": r["home"], "customers": packed(root[a]), "tables": packed(tables[a].astype(np.uint32)), "split_customers": packed(came[d]), "split_tables": packed(far[d].astype(np.uint32))})
    out.append({"shard": -1, "home": rows[0]["home"], "sums": sums_of(sums)})
    return out


def homes(asked: DataFrame, model: Model | None) -> DataFrame:
    """home_answers() of all homes."""
    return asked.groupBy("home").applyInArrow(lambda t: table_of(home_answers(t.to_pylist(), model), TOLD), TOLD)


def seated(count: np.ndarray, weights: Weights, discount: float, rng: np.random.Generator, sweeps: int = ROOT_SWEEPS) -> np.ndarray:
    """Tables of count customers of each dish, after so many sweeps."""
    seats = begun(count, weights(np.arange(len(count)), np.zeros(len(count), np.int64)), discount, rng)
    for _ in range(sweeps):
        stir_all(seats, lambda dishes, part: lambda some, gone: weights(dishes[some], gone), discount, rng)
    return seats.tables


# ---- sweeps, answers and scores ---------------------------------------------------------------------------------------

STATE = f"shard int, seat_dish binary, seat_size binary, parent_dish binary, parent_size binary, home int, asked binary, customers binary, split_at binary, split_of binary, split_customers binary, sums {SUMS}"
KEPT = ("shard", "seat_dish", "seat_size", "parent_dish", "parent_size")


def burnt(bodies: DataFrame, told: DataFrame, layout: Layout, model: Model) -> DataFrame:
    """Shards after burn-in: where they stand, and what they ask homes now."""

    def run(body: pa.Table, answers: pa.Table) -> pa.Table:
        s = Shard.of_rows(body.to_pylist(), layout)
        rng = np.random.default_rng([7, s.row["shard"]])
        s.hear(answers.to_pylist(), model)
        s.begin(rng)
        for _ in range(BURN_IN):
            s.sweep(rng)
        return table_of([s.state(), *s.questions(s.customers(s.tables()), s.parent_tables(), [*s.draws(rng), *s.pair_totals(s.tables())])], STATE)

    return bodies.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(run, STATE)


ANSWER = "chunk long, shard int, logs binary"


def answered(bodies: DataFrame, told: DataFrame, layout: Layout, model: Model) -> DataFrame:
    """For each chunk's triples in a shard the log10 of the mean probability over the samples."""

    def run(body: pa.Table, answers: pa.Table) -> pa.Table:
        rows, s = answers.to_pylist(), Shard.of_rows(body.to_pylist(), layout)
        row, rng = s.row, np.random.default_rng([8, s.row["shard"]])
        s.hear([r for r in rows if r["tables"] is not None], model)
        s.resume(next(r for r in rows if r["seat_dish"] is not None))
        p = np.zeros(len(s.count))
        for _ in range(SAMPLES):
            s.sweep(rng)
            p += s.predictive() / SAMPLES
        logs = np.log10(p).astype(np.float32)
        place = np.cumsum(unpacked(row["places"], np.int32), dtype=np.int64)
        made, at = [], 0
        for chunk, n in zip(row["chunks"], row["sizes"], strict=True):
            here = place[at : at + n]
            at += n
            made.append({"chunk": chunk, "shard": row["shard"], "logs": packed(logs[here])})
        return table_of(made, ANSWER)

    return bodies.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(run, ANSWER)


SCORE = "row long, doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"


def scored(chunked: DataFrame, answers: DataFrame, layout: Layout, model: Model) -> DataFrame:
    """Scores of all pieces of texts; answers: of homes (numbers) and of shards (logs)."""

    def work(row: dict, told: list[dict]) -> list[dict]:
        ids, counts = known(row, told, layout.homes)
        t, back = Triples(row, ids, layout), {r["shard"]: r["logs"] for r in told if r["logs"] is not None}
        logs = np.zeros(len(t.w))
        for s, at in t.of_shard():
            logs[at] = unpacked(back[s], np.float32)
        base = np.log10((counts + 1) / (model.trained + model.vocabulary + 1))
        first = np.cumsum(t.sizes) - t.sizes
        sums = [np.add.reduceat(x, first).tolist() for x in ((counts > 0).astype(np.int64)[t.codes], base[t.codes], logs[t.triple])]
        return [dict(zip(arrow(SCORE).names, r, strict=True)) for r in zip(row["rows"], row["doc_ids"], row["trained"], t.sizes.tolist(), *sums, strict=True)]

    return by_chunk(chunked, answers, SCORE, work)


def discount(ones: float, twos: float) -> float:
    """The discount that counts of ones and twos speak for."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def score_texts(docs: DataFrame, trained: Column, chunk_tokens: int = CHUNK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score and score for every document; the model learns where trained holds."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunked = Bucketed(chunks(docs, trained, chunk_tokens), "lm_chunks", ["chunk"], buckets)
    n, n_trained = (int(x) for x in chunked.rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_trained"), F.lit(0))).first())
    shards = max(MIN_SHARDS, math.ceil(n / shard_tokens))
    layout = Layout(shards, math.ceil(shards / HOME_SHARDS))
    with setting(spark, "spark.sql.shuffle.partitions", str(buckets)):
        asked = chunked.rows.select("chunk", "trained", "sizes", "before", "vocab", "tokens").mapInArrow(lambda batches: (batch_of(spelling(row, layout.homes), arrow(SPELLED)) for b in batches for row in b.to_pylist()), SPELLED)
        said = asked.groupBy("home").applyInArrow(lambda t: table_of(numbers(t.to_pylist(), layout.homes, n / shards), NUMBERED), NUMBERED)
        numbered = Bucketed(said.repartition(buckets, "chunk"), "lm_numbers", ["chunk"], buckets)
    sizes = total(numbered.rows.select("sums"))
    parts = lambda sums, what, least: {k & 0xFFFFFFFFFFFFFFFF: math.ceil(v[0] * shards / n) + 1 for (w, k), v in sums.items() if w == what and v[0] > least}
    bare = chunked.rows.select("chunk", "trained", "sizes", "before", "vocab", "tokens")
    ids = numbered.rows.where("ids is not null").select("chunk", "home", "ids", "counts")
    layout = Layout(shards, layout.homes, parts(sizes, OFTEN, 0))
    if layout.split:
        pairs = by_chunk(bare, ids, f"chunk long, sums {SUMS}", lambda row, told: [{"chunk": row["chunk"], "sums": frequent_pairs(row, known(row, told, layout.homes)[0], layout)}])
        layout = Layout(shards, layout.homes, layout.split, parts(total(pairs), OFTEN_PAIR, n / shards / 2))
    with setting(spark, "spark.sql.shuffle.partitions", str(buckets)):
        sent = by_chunk(bare, ids, SENT, lambda row, told: letters(row, known(row, told, layout.homes)[0], layout))
        merged = Bucketed(sent.repartition(buckets, "shard").groupBy("shard").applyInArrow(lambda t: table_of(merged_rows(t.to_pylist(), layout), SHARD), SHARD), "lm_shards", ["shard"], buckets)
    bodies, asked = merged.rows.where("sums is null").select(*BODY), merged.rows.where("home is not null").select(*ASK)
    first = total(merged.rows.select("sums"))
    table = lambda sums, what, names: np.array([sums.get((what, k), (0.0, 0.0)) for k in range(len(names))]).reshape(-1, 2)

    told, told_path = stash(homes(asked, None), "lm-told")
    root = total(told.select("sums"))
    model = Model(
        {k: discount(*(root if k == 1 else first).get((ONES, k), (0, 0))) for k in (1, 2, 3)}, dict.fromkeys((1, 2, 3), 1.0), int(sizes.get((SIZES, 0), (0, 0))[0]), n_trained,
        *root.get((ROOT, 0), (0.0, 0.0)), table(root, SPLIT, layout.words), table(first, SPLIT_PAIR, layout.pairs),
    )
    stood, stood_path = stash(burnt(bodies, told.where("shard >= 0").drop("sums"), layout, model), "lm-burnt")
    drop_path(spark, told_path)
    second = total(stood.select("sums"))
    rng = np.random.default_rng(13)
    for level in (2, 3):
        heads, logs = second.get((DRAWN, level), (0.0, 0.0))
        model.theta[level] = max(float(rng.gamma(1 + heads, 1 / (1 + logs))), 1e-6)
    model.split_pairs = table(second, SPLIT_PAIR, layout.pairs)
    again, again_path = stash(homes(stood.where("home is not null").select(*ASK), model), "lm-told")
    root = total(again.select("sums"))
    model.root_tables, model.root_customers = root.get((ROOT, 0), (0.0, 0.0))
    model.split = table(root, SPLIT, layout.words)
    back = again.where("shard >= 0").drop("sums").unionByName(stood.where("seat_dish is not null").select(*KEPT), allowMissingColumns=True)
    with setting(spark, "spark.sql.shuffle.partitions", str(buckets)):
        logs = answered(bodies, back, layout, model).unionByName(ids, allowMissingColumns=True)
        out, _ = stash(scored(chunked.rows.drop("n_tokens", "n_trained"), logs, layout, model), "lm-scores")
    for path in (stood_path, again_path):
        drop_path(spark, path)
    merged.drop(), numbered.drop(), chunked.drop()
    whole = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("trained").alias("trained"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.drop("row").withColumn("train_tokens", F.lit(n_trained).cast("long"))


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of the scored texts, held out and trained on."""
    return scores.groupBy("trained").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.sum("n_tokens").alias("n_tokens"))


HELD_OUT = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 = 2"


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    said = score_texts(docs, F.expr(f"not ({HELD_OUT})"))
    return said.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
