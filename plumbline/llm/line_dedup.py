"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; keys of at least
``min_chars`` code points take part. Documents come in batches of falling id ranges. A run is a table sorted by the key's
128-bit hash with the number of documents that hold it and, where no earlier run has the key, the document that keeps it.
Each batch is merged against the runs there are by hash: keys that no run has yet (the anti-join) are kept by the largest
id of this batch, which as ranges fall is the largest of all; of keys that a run has, the batch keeps none and adds its
count. Both become a new run at level 0. Whenever a level has ``fanout`` runs they are compacted into one sorted run of the
next level. At the end, documents meet the compacted run's heavy keys, and lose the lines whose key ``min_docs`` documents
hold unless they are the key's keeper.

Edge cases: a null or empty text is one empty line; a document without id counts for no key and keeps all its lines;
rows with the same id count as one document, and each of them loses or keeps its lines alike; a key that a document
repeats counts once, and in the document that keeps it all its lines stay; blank and short lines always stay; no rows
give no rows; extra columns pass through ``dedup_lines``. A text that loses all its lines becomes empty.

Scale: runs are dealt by hash into sorted files, and batches alike: a merge reads the runs in place and shuffles the
batch alone. Only (hash, id) pairs and the heavy keys are shuffled, plus the texts once to meet their dropped keys. Nothing
is collected by this code but the bounds of id ranges. Counts are combined on the map side, so a line that a third of all
documents share is one row a task. Keys that hold more than a fair share of a task (one in ``FAIR`` of all pairs a shuffle
partition, so at most ``FAIR`` keys a partition can) meet their documents by broadcast, in place; all other joins are
sort-merge joins at every size, which need no table in memory.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import Bucketed, buckets_of, by_batch, clear_of, drop_path, pieces, setting, stash, utf8

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
#: A key is hot when it has more than all pairs / (FAIR * shuffle partitions).
FAIR = 4

_STRIP = b" \t\n\x0b\x0c\r"
_PAIR = "<qq"


def key_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16 bytes that stand for the line's key, or None where the key is too short."""
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id): each document's distinct keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2, ids = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            keys = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := key_hash(line, min_chars))}
            for a, b in (struct.unpack(_PAIR, k) for k in sorted(keys)):
                h1.append(a)
                h2.append(b)
            ids += [doc] * len(keys)
        return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64())], names=["h1", "h2", "doc_id"])

    given = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return given.mapInArrow(by_batch(work), "h1 long, h2 long, doc_id long")


class Runs:
    """Levelled sorted runs of (h1, h2, n_docs, keeper) in the shared folder.

    A run is dealt by hash into ``buckets`` files, each sorted by hash. Batches are dealt alike, so merging them against
    runs, and runs with each other, reads every run in place: no run is shuffled or sorted again.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or buckets_of(spark)
        self.levels: list[list[Bucketed]] = []
        self.compactions = 0

    def all(self) -> list[DataFrame]:
        return [self.read(run) for level in self.levels for run in level]

    @staticmethod
    def read(run: Bucketed) -> DataFrame:
        """The run's rows, as rows: a union of bare columnar scans would not keep their buckets together (Spark 4.1)."""
        return run.rows.where("n_docs > 0")

    @contextmanager
    def in_place(self) -> Iterator[None]:
        """For actions that merge runs: scans stay bucketed below a union, and files of one bucket each are read as sorted."""
        with setting(self.spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"), setting(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
            with setting(self.spark, "spark.sql.shuffle.partitions", str(self.buckets)):
                yield

    def _made(self, rows: DataFrame, name: str) -> Bucketed:
        with self.in_place():
            return Bucketed(rows, name, ["h1", "h2"], self.buckets, sort=True)

    def _put(self, level: int, run: Bucketed) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.compactions += 1
            self._put(level + 1, self._made(self.merged([self.read(run) for run in old]), f"lines_run_{level + 1}"))
            for run in old:
                run.drop()

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs as one; inside ``in_place`` a union of tables that are dealt alike is grouped without a shuffle.

        Of a key's rows exactly one, of the first run that had it, names its keeper.
        """
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.min("keeper").alias("keeper"))

    def add(self, keys: DataFrame) -> None:
        """Merge a batch of distinct (h1, h2, doc_id) against the runs and add what it brings as a new run.

        Keys that the anti-join with the runs leaves are kept by this batch's largest id; the others have their keeper in
        an earlier run. Documents come whole and in one batch, so counts of different runs add up, and batches come by
        falling ids, so that the first one to have a key has its largest id.
        """
        grouped = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        if not self.all():
            self._put(0, self._made(grouped, "lines_run_0"))
            return
        others = self.seen(grouped).withColumn("keeper", F.lit(None).cast("long"))
        self._put(0, self._made(self.unseen(grouped).unionByName(others), "lines_run_0"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run has: what exact dedup at first sight keeps."""
        for run in self.all():
            keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def seen(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose key a run has; exactly one run names the key's keeper."""
        firsts = [run.where("keeper is not null").select("h1", "h2").hint("merge") for run in self.all()]
        parts = [keys.join(run, ["h1", "h2"], "left_semi") for run in firsts]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    def compacted(self) -> DataFrame | None:
        """All runs as one, which is then the only one."""
        if len(runs := self.all()) > 1:
            old, self.levels = self.levels, [*([] for _ in self.levels), [self._made(self.merged(runs), "lines_run_all")]]
            self.compactions += 1
            for run in (run for level in old for run in level):
                run.drop()
        return self.all()[0] if runs else None

    def drop(self) -> None:
        for run in (run for level in self.levels for run in level):
            run.drop()
        self.levels = []


def falling_ranges(docs: DataFrame, batches: int) -> Column:
    """The batch of a document, by ranges of ids of about as many rows each: 0 has the largest ids.

    Where ranges begin says only what comes first, not what is kept, so approximate quantiles do.
    """
    at = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(q) for q in at]), 1000)).first()[0] if at else None
    return reduce(lambda n, cut: n + (F.col("doc_id") < F.lit(cut)).cast("int"), sorted(set(cuts or [])), F.lit(0))


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, keys): the 16-byte hashes whose lines a document loses; only documents that lose some."""
    raw = line_keys(docs, min_chars).withColumn("batch", falling_ranges(docs, batches))
    keys, path = stash(raw, "lines-keys", ("batch",))
    runs = Runs(docs.sparkSession, fanout)
    for k in range(batches):
        # Rows with the same id are in the same batch: distinct makes them one document.
        runs.add(keys.where(F.col("batch") == k).select("h1", "h2", "doc_id").distinct())
    held = runs.compacted()
    fair = max(min_docs, (held.agg(F.sum("n_docs")).first()[0] or 0) // (FAIR * buckets_of(docs.sparkSession)))
    heavy, pairs = held.where(F.col("n_docs") >= min_docs), keys.select("h1", "h2", "doc_id")
    hot = F.broadcast(heavy.where(F.col("n_docs") > fair).select("h1", "h2", "keeper"))
    cold = heavy.where(F.col("n_docs") <= fair).select("h1", "h2", "keeper").hint("merge")
    met = pairs.join(hot, ["h1", "h2"]).unionByName(pairs.join(hot, ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"]))
    lost = met.where("doc_id <> keeper")
    out, _ = stash(lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("keys")), "lines-drops")
    drop_path(docs.sparkSession, path)
    runs.drop()
    return out


def kept_lines(text: bytes | None, gone: list[dict] | None, min_chars: int) -> tuple[list[bytes], int]:
    """The lines that stay, and how many there were."""
    lines = (text or b"").split(b"\n")
    if not gone:
        return lines, len(lines)
    lost = {struct.pack(_PAIR, k["h1"], k["h2"]) for k in gone}
    return [x for x in lines if len(x) < min_chars or key_hash(x, min_chars) not in lost], len(lines)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with the lines that stay, joined by newlines; a null text stays null."""
    names, gone = docs.columns, clear_of("gone", docs.columns)
    text_at = [n.lower() for n in names].index("text")

    def run(batches_in: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches_in):
            columns, lost = batch.columns[: len(names)], batch.column(len(names)).to_pylist()
            if any(lost):
                texts = utf8(columns[text_at])
                columns[text_at] = pa.array([t if t is None else (b"\n".join(kept_lines(t, g, min_chars)[0]) if g else t).decode() for t, g in zip(texts, lost, strict=True)], columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    d = drops(docs, min_chars, min_docs, batches, fanout).select(F.col("doc_id").alias(f"{gone}_id"), F.col("keys").alias(gone))
    return docs.join(d.hint("merge"), F.col("doc_id") == F.col(f"{gone}_id"), "left").drop(f"{gone}_id").mapInArrow(run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, dropped, sha = [], [], []
        for text, gone in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            stay, before = kept_lines(text, gone, MIN_CHARS)
            n.append(before)
            dropped.append(before - len(stay))
            sha.append(hashlib.sha256(b"\n".join(stay)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    d = drops(docs).select(F.col("doc_id").alias("_id"), "keys")
    met = given.join(d.hint("merge"), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "keys")
    return met.mapInArrow(by_batch(work), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


REPORT_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[ \t-\r]+', ''), '[ \t-\r]+$', '') AS key
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
heavy AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT l.doc_id, l.n, l.line, coalesce(l.doc_id < h.last_doc, false) AS gone FROM lines l LEFT JOIN heavy h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
