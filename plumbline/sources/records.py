"""Binary observation files, results documents, experiment plans and hash-chained journals."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: After six bytes that tell the format: inputs, outputs, traces, records and the sum of steps, little-endian.
HEADER = struct.Struct("<HHHQQ")
#: Of each record: id, steps, flags and seven zero bytes; then doubles.
RECORD = struct.Struct("<QQB7s")
FIELDS = "id long, x array<double>, y array<double>, traces array<array<double>>, flags int, steps long"


class RecordError(ValueError):
    """A file that is not what its header says."""


def encode(rows: Iterable[tuple], magic: bytes) -> bytes:
    """Rows (id, x, y, traces, flags, steps) as one file."""
    rows = list(rows)
    first = rows[0] if rows else (0, [], [], [], 0, 0)
    out = [magic, HEADER.pack(len(first[1]), len(first[2]), len(first[3]), len(rows), sum(r[5] for r in rows))]
    doubles = lambda v: struct.pack(f"<{len(v)}d", *v)
    for i, x, y, traces, flags, steps in rows:
        out += [RECORD.pack(i, steps, flags, b""), doubles(x), doubles(y)]
        for t in traces:
            out += [struct.pack("<I", len(t)), doubles(t)]
    return b"".join(out)


def decode(data: bytes, magic: bytes) -> Iterator[tuple]:
    """The rows of a file; padding, length and the sum of steps have to be right."""
    if data[: len(magic)] != magic:
        raise RecordError("no observation file")
    at = len(magic)

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise RecordError(f"the file ends at byte {len(data)} inside a record")
        at += n
        return data[at - n : at]

    arity, outputs, traces, count, total = HEADER.unpack(take(HEADER.size))
    doubles = lambda n: list(struct.unpack(f"<{n}d", take(8 * n)))
    seen = 0
    for _ in range(count):
        i, steps, flags, pad = RECORD.unpack(take(RECORD.size))
        if pad.strip(b"\0"):
            raise RecordError(f"record {i} has padding that is not zero")
        x, y = doubles(arity), doubles(outputs)
        series = [doubles(struct.unpack("<I", take(4))[0]) for _ in range(traces)]
        seen += steps
        yield i, x, y, series, flags, steps
    if at != len(data):
        raise RecordError(f"{len(data) - at} bytes follow the last record")
    if seen != total:
        raise RecordError(f"the header says {total} steps, the records sum to {seen}")


def read_observations(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """Observation files below path: file, and FIELDS. One task reads one file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(decode(data, magic))
                deep = pa.list_(pa.float64())
                kinds = (pa.int64(), deep, deep, pa.list_(deep), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["file", "id", "x", "y", "traces", "flags", "steps"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, {FIELDS}")


# ---- results ---------------------------------------------------------------------------------------------------------


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results documents as outcomes: one row for each of sweeps[].outcomes[], with the document's file as arm."""
    docs = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    sweeps = docs.select(F.input_file_name().alias("arm"), F.explode("sweeps").alias("s"))
    return sweeps.select("arm", F.explode("s.outcomes").alias("o")).select("arm", "o.*")


def identity(schema: str, plan: dict, entries: list) -> str:
    """Twelve hex digits of what a measurement is of: the plan's fields, lists sorted, and the sorted entries."""
    text = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    lines = [f"schema={schema}\n"]
    lines += [f"{k}={','.join(sorted(map(text, v))) if isinstance(v, list) else text(v)}\n" for k, v in plan.items()]
    return hashlib.sha256("".join([*lines, "entries=", ",".join(sorted(map(text, entries)))]).encode()).hexdigest()[:12]


# ---- journals --------------------------------------------------------------------------------------------------------

ZERO = "0" * 64


def append(lines: list[str], kind: str, payload: object, at: str) -> str:
    """The next line of a journal: it holds the digest of the line before."""
    prev = hashlib.sha256(lines[-1].encode()).hexdigest() if lines else ZERO
    lines.append(json.dumps({"seq": len(lines), "at": at, "prev": prev, "kind": kind, "payload": payload}, separators=(",", ":"), ensure_ascii=False))
    return lines[-1]


def broken_links(journal: DataFrame) -> DataFrame:
    """Lines (journal, nr, line) whose number or digest of the line before is wrong: journal, nr.

    Each line is held against the one before it by an equi-join, so no journal is gathered in one task.
    """
    said = journal.select("journal", "nr", F.get_json_object("line", "$.seq").cast("long").alias("seq"), F.get_json_object("line", "$.prev").alias("prev"))
    before = journal.select("journal", (F.col("nr") + 1).alias("nr"), F.sha2(F.col("line").cast("binary"), 256).alias("digest"))
    met = said.join(before, ["journal", "nr"], "left")
    good = (F.col("seq") == F.col("nr")) & (F.col("prev") == F.coalesce("digest", F.when(F.col("nr") == 0, F.lit(ZERO))))
    return met.where(~F.coalesce(good, F.lit(False))).select("journal", "nr")
