"""Fill-in-the-middle over an index of distinct texts with Elias-Fano boundary lists.

A text is tokens ``[A-Za-z]+|[^A-Za-z]`` from left to right over code points. Identical texts are grouped by digest, and
each digest's group keeps every distinct text that has it, so content and not the digest says what is one text. Documents
merge-join this index, so that those of one text come one after the other. For the first of them the ends of the text's
tokens, a rising list of code point offsets, are coded: low bits packed, high bits in unary (Elias-Fano), about 3 bits a
token; each of them reads only the two boundaries that its seeded cut needs. (Lists that are stored with the texts before
the join would be moved and kept a second time, which costs more disk than there may be: measured, 1.91 x the input.)

The seed gives four numbers, the first 8-digit groups of the hex sha256 of ``seed:doc_id``: two cuts, the form (plain, or
with the parts marked) and the order (psm or spm).

Edge cases: a null text counts as an empty one and is plain; a text that holds a mark is plain; a document without id is
cut by the digest of ``seed:`` alone; rows with the same id are cut alike where their texts are; no rows give no rows;
``fill_in_middle`` passes further columns through, whatever their names, and where docs has a column with the name of one
that it adds, the new one gets underscores in front. A text that is all one token has no inner boundary.

Scale: distinct texts are shuffled once, combined on the map side, so copies of a text cost one row a task; documents come
as ids and digests without texts and join them where they are, without a second shuffle. Digests with more documents than a fair share of a task
(all documents by ``FAIR`` times the shuffle partitions, so there are at most that many) are counted first; their texts are
handed out in as many copies as their documents need, each to a slot of documents: no task gets a hot text's
documents whole, and what is broadcast is the list of these digests alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import buckets_of, clear_of, pieces, stash, utf8

SEED = 1
#: A text is hot when it has more documents than all documents / (FAIR * shuffle partitions).
FAIR = 4
PLAIN_SHARE, SPM_SHARE = 90, 20
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)


# ---- Elias-Fano lists


def boundaries(text: str) -> np.ndarray:
    """The code point offsets at which the text's tokens end."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    return np.append(np.flatnonzero(~(letter[:-1] & letter[1:])) + 1, len(points)) if len(points) else np.zeros(0, np.int64)


def encode(ends: np.ndarray) -> bytes:
    """A rising list as bytes: its length, how many low bits are packed, these bits, then the high parts in unary."""
    n = len(ends)
    low = max(0, (int(ends[-1]) // n).bit_length() - 1) if n else 0
    bits = (ends[:, None] >> np.arange(low)) & 1
    unary = np.zeros(n + (int(ends[-1]) >> low) + 1 if n else 0, np.uint8)
    unary[(ends >> low) + np.arange(n)] = 1
    return b"".join((n.to_bytes(8, "little"), bytes([low]), np.packbits(bits.ravel().astype(np.uint8), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes()))


class Boundaries:
    """Reads single values of a coded list."""

    def __init__(self, coded: bytes) -> None:
        self.n, self.low, self.coded = int.from_bytes(coded[:8], "little"), coded[8], np.frombuffer(coded, np.uint8)[9:]
        self.high_at = (self.n * self.low + 7) // 8
        self.ones: np.ndarray | None = None

    def __getitem__(self, i: int) -> int:
        """The i-th value, from 0: the place of the i-th one gives the high part."""
        high = self.coded[self.high_at :]
        if self.ones is None:
            self.ones = np.cumsum(_BITS[high], dtype=np.int64)
        byte = int(np.searchsorted(self.ones, i + 1))
        nth = i - (int(self.ones[byte - 1]) if byte else 0)
        place = 8 * byte + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))[nth])
        first = i * self.low
        packed = int.from_bytes(self.coded[first // 8 : (first + self.low + 7) // 8].tobytes(), "little") >> first % 8
        return (place - i) << self.low | packed & ((1 << self.low) - 1)

    def after(self, units: int) -> int:
        """Where the first units tokens end."""
        return self[units - 1] if units else 0


# ---- cuts and forms


def seeded(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """The four numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def form_of(text: str, numbers: tuple[int, ...]) -> str:
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or numbers[2] % 100 >= PLAIN_SHARE:
        return "plain"
    return "spm" if numbers[3] % 100 < SPM_SHARE else "psm"


def formatted(text: str, ends: Boundaries, doc_id: int | None, seed: int = SEED) -> tuple[str, str, int | None, int | None]:
    """(output, form, characters of the prefix, characters of the middle)."""
    numbers = seeded(doc_id, seed)
    form = form_of(text, numbers)
    if form == "plain":
        return text, form, None, None
    a, b = (ends.after(u) for u in sorted(h % (ends.n + 1) for h in numbers[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    front = f"{PREFIX}{prefix}{SUFFIX}{suffix}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}"
    return f"{front}{MIDDLE}{middle}", form, a, b - a


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    front, _, middle = output.partition(MIDDLE)
    one, _, two = front[len(PREFIX) :].partition(SUFFIX if form == "psm" else PREFIX)
    return one + middle + two if form == "psm" else two + middle + one


# ---- the index of distinct texts


def digest(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def text_index(docs: DataFrame) -> DataFrame:
    """(sha, text) of every distinct text, dealt by digest.

    A digest's group holds its distinct texts as a set, so equality is that of whole texts; two texts of one digest, which
    nobody has seen for SHA-256, would end the job rather than mix documents up.
    """
    keyed = docs.select(digest(F.col("text")).alias("sha"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = keyed.groupBy("sha").agg(F.collect_set("text").alias("texts"))
    one = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("different texts have the digest "), F.col("sha"))))
    return grouped.select("sha", one.alias("text"))


def with_entries(docs: DataFrame, sha: str, text: str) -> DataFrame:
    """docs without its texts, but with their digests (sha), and text from the index, documents of one text in a row."""
    spark, names = docs.sparkSession, docs.columns
    key, n, slot = (clear_of(name, [*names, sha, text]) for name in ("key", "n", "slot"))
    fair = max(1, docs.count() // (FAIR * buckets_of(spark)))
    counted = docs.groupBy(digest(F.col("text")).alias(key)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > fair)
    hot, _ = stash(counted.select(key, F.ceil(F.col(n) / fair).cast("int").alias(n)), "fim-hot")
    hot, held = F.broadcast(hot), digest(F.col("text")) == F.col(key)
    entry = lambda rows: text_index(rows).select(F.col("sha").alias(key), F.col("text").alias(text))
    rest = [F.col(f"`{c}`") for c in names if c.lower() != "text"]
    bare = lambda rows, *more: rows.select(*rest, digest(F.col("text")).alias(sha), *more)
    cold = docs.join(hot, held, "left_anti")
    cool = bare(cold).join(entry(cold).hint("merge"), F.col(sha) == F.col(key)).drop(key)
    warm = docs.join(hot, held)
    slots = entry(docs.join(hot, held, "left_semi")).join(hot.withColumnRenamed(key, f"{key}_"), F.col(key) == F.col(f"{key}_"))
    slots = slots.select(key, text, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(slot))
    dealt = bare(warm, F.pmod(F.monotonically_increasing_id(), F.col(n)).cast("int").alias(n))
    met = dealt.join(slots.hint("merge"), (F.col(sha) == F.col(key)) & (F.col(n) == F.col(slot))).drop(key, n, slot)
    return cool.sortWithinPartitions(sha).unionByName(met.sortWithinPartitions(sha))  # as merge joins leave them


class Entries:
    """The index's entry of the text at hand: its coded list is made once, for the first of the documents that have it."""

    def __init__(self) -> None:
        self.raw: bytes | None = None
        self.made = 0

    def of(self, raw: bytes) -> tuple[str, Boundaries]:
        if raw != self.raw:
            self.raw, self.text, self.made = raw, raw.decode(), self.made + 1
            self.ends = Boundaries(encode(boundaries(self.text)))
        return self.text, self.ends


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with each text cut and marked, and with fim_n, fim_form, fim_prefix_chars and fim_middle_chars."""
    names = docs.columns
    at, id_at = [n.lower() for n in names].index("text"), [n.lower() for n in names].index("doc_id")
    sha, text = (clear_of(n, names) for n in ("sha", "whole"))
    made = [clear_of(n, names) for n in ("fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    met = with_entries(docs, sha, text).select(*[F.col(f"`{c}`") if k != at else F.lit(None).cast("string").alias(c) for k, c in enumerate(names)], text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Entries()
        for batch in pieces(batches):
            columns = batch.columns[: len(names)]
            out, told = [], []
            for doc, raw in zip(columns[id_at].to_pylist(), utf8(batch.column(len(names))), strict=True):
                t, b = entries.of(raw)
                output, *rest = formatted(t, b, doc, seed)
                out.append(output)
                told.append((b.n, *rest))
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in told], kind) for k, kind in enumerate(kinds))], names=[*names, *made])

    schema = met.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast("string" if k == pa.string() else "long").alias(m) for m, k in zip(made, kinds, strict=True)]).schema
    return met.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document, digests of the operator's output and of what it gives back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Entries()
        for batch in pieces(batches):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                t, b = entries.of(raw)
                output, form, prefix, middle = formatted(t, b, doc)
                rows.append((doc, b.n, form, prefix, middle, *(hashlib.sha256(x.encode()).hexdigest() for x in (output, restored(output, form)))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = with_entries(given, "sha", "whole").select("doc_id", "whole")
    return met.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


REPORT_SQL = r"""
WITH cut AS (
  SELECT doc_id, text, l, len(l) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h
  FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS l, h
        FROM (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents))),
formed AS (
  SELECT doc_id, text, l, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:n], '') AS suffix
  FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
