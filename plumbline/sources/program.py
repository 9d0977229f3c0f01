"""Models computed by an external program: a line of JSON in for each point, a line of JSON out.

Request {"x": [...]}; answer {"y": [...], "steps": n} or {"error": "..."}. One process serves a partition; it is started
again after a timeout. What cannot be answered is NaN with the NaN flag, and says why.
"""

from __future__ import annotations

import json
import math
import queue
import shlex
import subprocess
import threading
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.functions.ieee import Flag

TIMEOUT = 5.0


class Program:
    def __init__(self, command: str, outputs: int, timeout: float = TIMEOUT) -> None:
        self.command, self.outputs, self.timeout = command, outputs, timeout
        self.process: subprocess.Popen | None = None

    def start(self) -> None:
        self.process = subprocess.Popen(shlex.split(self.command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, bufsize=1)
        self.lines: queue.Queue[str | None] = queue.Queue()
        threading.Thread(target=self._read, args=(self.process.stdout, self.lines), daemon=True).start()

    @staticmethod
    def _read(out, lines: queue.Queue) -> None:
        for line in out:
            lines.put(line)
        lines.put(None)

    def stop(self) -> None:
        if self.process:
            self.process.kill()
            self.process.wait()
            self.process = None

    def ask(self, x: list[float]) -> tuple[list[float], int, str | None]:
        """Outputs, steps and what went wrong."""
        lost = [math.nan] * self.outputs
        try:
            if self.process is None or self.process.poll() is not None:
                self.start()
            self.process.stdin.write(json.dumps({"x": x}) + "\n")
            self.process.stdin.flush()
            line = self.lines.get(timeout=self.timeout)
        except queue.Empty:
            self.stop()
            return lost, 0, "timeout"
        except OSError as e:
            self.stop()
            return lost, 0, f"not running: {e}"
        if line is None:
            self.stop()
            return lost, 0, "ended without an answer"
        try:
            said = json.loads(line)
            if "error" in said:
                return lost, 0, f"refused: {said['error']}"
            y = [float(v) for v in said["y"]]
            if len(y) != self.outputs:
                return lost, 0, f"{len(y)} outputs instead of {self.outputs}"
            return y, int(said.get("steps", 1)), None
        except (TypeError, ValueError, KeyError, AttributeError):
            return lost, 0, "no answer in JSON"


def run_program(points: DataFrame, command: str, outputs: int, timeout: float = TIMEOUT) -> DataFrame:
    """points (with x) with y, flags, steps and error."""

    at = [c.lower() for c in points.columns].index("x")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Program(command, outputs, timeout)
        try:
            for b in batches:
                said = [p.ask([float(v) for v in x]) for x in b.column(at).to_pylist()]
                flags = [int(Flag.NAN) if any(v != v for v in s[0]) else 0 for s in said]
                made = [pa.array([s[0] for s in said], pa.list_(pa.float64())), pa.array(flags, pa.int32()), pa.array([s[1] for s in said], pa.int64()), pa.array([s[2] for s in said], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "y", "flags", "steps", "error"])
        finally:
            p.stop()

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in points.schema)
    return points.mapInArrow(run, f"{fields}, y array<double>, flags int, steps long, error string")
