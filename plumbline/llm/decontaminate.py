"""Benchmark decontamination: training words stream through a generalised suffix automaton of the test items.

Words: the text's UTF-8 with A-Z lower-cased, split at every ASCII character that is neither a letter nor a digit.
A window is ``window`` consecutive words of an item; an item of fewer words, but at least one, is one window. While a
document streams by, the automaton's state holds the longest suffix of what was read that occurs in some item. Where
that length reaches a window, the words it covers are hit, and the state names the items that hold the window.

Edge cases: a null or empty text has no words, is never hit and is kept as it is; an item without words has no
window; item rows without an id are not used; item rows with the same id count as one item; equal items are all
named; repeated documents are judged one by one; an empty benchmark hits nothing; extra columns pass through
``decontaminate``, and its own working columns avoid their names.

Scale: the items are read on the driver in blocks of at most BLOCK_WORDS words and each block's automaton is broadcast,
so a broadcast has that bound whatever the benchmark's size; further blocks are passed over one after the other by the
same tasks. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import clear_of, pieces, utf8

WINDOW = 10
#: Words of items in one broadcast automaton at most; a single longer item gets a block of its own.
BLOCK_WORDS = 200_000
#: Documents' bytes that are held while several blocks pass over them.
HELD_BYTES = 32 << 20

#: Bytes to bytes: A-Z to a-z, ASCII letters, digits and bytes of other characters stay, the rest become spaces.
_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
_SPAN = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class ItemAutomaton:
    """A generalised suffix automaton over the words of items; items: (id as text, words), each with at least a word."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for name, ws in items]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.names: list[str] = []
        #: For a state whose longest string reaches the window: the shortest of its suffixes' states that still does.
        self.window_state = [0] * len(self.size)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            if self.size[v] >= window:
                self.window_state[v] = self.window_state[self.link[v]] or v
        #: Items with a window that ends in a state (by window_state), and short items by the state of their whole text.
        self.owners: dict[int, set[int]] = {}
        self.whole: dict[int, tuple[int, set[int]]] = {}
        self.shortest = window
        for name, ids in coded:
            k, v = len(self.names), 0
            self.names.append(name)
            for n, c in enumerate(ids, 1):
                v = self.step[v][c]
                if n >= window:  # v holds this item's last n words, so its window_state holds the last window
                    self.owners.setdefault(self.window_state[v], set()).add(k)
            if len(ids) < window:
                self.whole.setdefault(v, (len(ids), set()))[1].add(k)
                self.shortest = min(self.shortest, len(ids))
        #: Nearest state on the way of suffix links, itself included, that holds a whole short item.
        self.short_state = [0] * len(self.size)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.short_state[v] = v if v in self.whole else self.short_state[self.link[v]]
        self._runs = re.compile(b"\x01{%d,}" % self.shortest)

    def _new(self, size: int, step: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of q that p's lead to, when q also has longer ones."""
        copy = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if (q := self.step[last].get(c)) is not None:  # another item has been here
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return new

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit spans (first word, one past the last), in order and apart; the items' numbers; the longest match."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        longest, vocab, step, link, size, window = 0, self.vocab, self.step, self.link, self.size, self.window
        for run in self._runs.finditer(bytes(map(vocab.__contains__, ws))):
            v = n = 0
            for i in range(run.start(), run.end()):
                c = vocab[ws[i]]
                while v and c not in step[v]:
                    v = link[v]
                    n = size[v]
                if (to := step[v].get(c)) is None:
                    continue
                v, n = to, n + 1
                longest = max(longest, n)
                reach = 0
                if n >= window:
                    reach = n
                    # a match may be shorter than its state's strings, yet reach the window: the state then holds it itself
                    found |= self.owners.get(self.window_state[v], set())
                s = self.short_state[v]
                while s:
                    length, owners = self.whole[s]
                    if length <= n:
                        found |= owners
                        reach = max(reach, length)
                    s = self.short_state[link[s]]
                if reach:
                    first = i + 1 - reach
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i + 1))
        return spans, found, longest


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> Iterator[ItemAutomaton]:
    """Automata over the benchmark, each of block_words words at most; an id's rows may fall in different blocks."""
    held: list[tuple[str, list[bytes]]] = []
    total = 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("item_id is not null and text is not null").toLocalIterator():
        if not (ws := words(bytes(row[1]))):
            continue
        if held and total + len(ws) > block_words:
            yield ItemAutomaton(held, window)
            held, total = [], 0
        held.append((row[0], ws))
        total += len(ws)
    if held:
        yield ItemAutomaton(held, window)


def broadcasts(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Broadcast]:
    return [benchmark.sparkSession.sparkContext.broadcast(a) for a in blocks_of(benchmark, window, block_words)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Found:
    """What all blocks find in one document."""

    def __init__(self, text: bytes | None) -> None:
        self.text, self.words = text, words(text)
        self.spans: list[tuple[int, int]] = []
        self.items: set[str] = set()
        self.longest = 0

    def add(self, block: ItemAutomaton) -> None:
        spans, items, longest = block.match(self.words)
        self.spans = merged(self.spans + spans) if self.spans else spans
        self.items |= {block.names[k] for k in items}
        self.longest = max(self.longest, longest)

    @property
    def hit(self) -> int:
        return sum(b - a for a, b in self.spans)

    def without_spans(self) -> bytes:
        """The text without the hit spans, each from its first word's start to its last word's end."""
        at = [(m.start(), m.end()) for m in _SPAN.finditer(self.text)]
        out, done = [], 0
        for a, b in self.spans:
            out.append(self.text[done : at[a][0]])
            done = at[b - 1][1]
        return b"".join([*out, self.text[done:]])


def cleaned(found: Found, blocks: list[Broadcast]) -> str | None:
    """The text without hit spans, nor those that come about where a span has gone."""
    while found.spans:
        found = Found(found.without_spans())
        for block in blocks:
            found.add(block.value)
    return None if found.text is None else found.text.decode()


def over(batches: Iterable[pa.RecordBatch], blocks: list[Broadcast], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[Found]]]:
    """Each batch with what the blocks find in its texts. Of several blocks, one at a time is in memory."""

    def judged(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Found]]]:
        each = [[Found(t) for t in utf8(b.column(text_at))] for b in held]
        for block in blocks:
            a = block.value
            for found in each:
                for f in found:
                    f.add(a)
            if len(blocks) > 1:
                del a, block._value
        yield from zip(held, each, strict=True)

    held, size = [], 0
    for batch in pieces(batches):
        held.append(batch)
        size += batch.nbytes
        if len(blocks) < 2 or size >= HELD_BYTES:
            yield from judged(held)
            held, size = [], 0
    yield from judged(held)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, longest_match, items (ids as text, sorted), spans (of words)."""
    blocks = broadcasts(benchmark, window, block_words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in over(batches, blocks, 1):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f.words) for f in found], pa.int64()),
                    pa.array([f.hit for f in found], pa.int64()),
                    pa.array([f.longest for f in found], pa.int64()),
                    pa.array([sorted(f.items) for f in found], pa.list_(pa.string())),
                    pa.array([[{"first": a, "past": b} for a, b in f.spans] for f in found], pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "longest_match", "items", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_words long, n_hit long, longest_match long, items array<string>, spans array<struct<first:long,past:long>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without hit spans; a document with more than max_coverage of its words hit goes altogether."""
    blocks = broadcasts(benchmark, window, block_words)
    names, raw = docs.columns, clear_of("raw", docs.columns)
    text_at = [n.lower() for n in names].index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in over(batches, blocks, len(names)):
            keep = [not f.words or f.hit <= max_coverage * len(f.words) for f in found]
            columns = batch.columns[: len(names)]
            if any(f.spans for f in found):
                texts = [cleaned(f, blocks) for f in found]
                columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return docs.withColumn(raw, F.col("text").cast("binary")).mapInArrow(run, docs.schema)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's columns for every document."""
    found = scan(docs, benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
found AS (
  SELECT p.doc_id, p.i, s.n, x.item FROM places p JOIN sizes s ON p.i + s.n - 1 <= len(p.w)
  JOIN windows x ON x.n = s.n AND x.win = array_to_string(p.w[p.i : p.i + s.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS h FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""
