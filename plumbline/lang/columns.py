"""Loop-free models as Columns, so that Catalyst generates code for them."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ieee
from plumbline.functions.ieee import Flag
from plumbline.lang.model import Model, Operand
from plumbline.operators.evidence import Rule


#: The code of an operation, in operations like +; all others are taken as one.
SIZES = {"/": 4, "%": 3, "pow": 3, "clamp": 3, "min": 2, "max": 2, "ln": 2, "log2": 2, "log10": 2, "floor": 5, "ceil": 5, "trunc": 10, "round": 24}
#: How much is evaluated in one go, so that its method has room for what reads the results, below 8,000 bytes.
BLOCK = 24


def _truth(c: Column) -> Column:
    return c.cast("double")


VALUES = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": ieee.div, "%": ieee.rem, "pow": F.pow, "min": ieee.fmin, "max": ieee.fmax, "neg": lambda a: -a, "abs": F.abs, "sqrt": F.sqrt, "cbrt": F.cbrt,
    "exp": F.exp, "ln": ieee.ln, "log2": ieee.log2, "log10": ieee.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "floor": ieee.floor, "ceil": ieee.ceil, "trunc": ieee.trunc, "round": ieee.round_half_away, "atan2": F.atan2, "hypot": F.hypot, "clamp": ieee.clamp, "lerp": ieee.lerp, "copy": lambda a: a, "i2f": lambda a: a,
    "<": lambda a, b: _truth(ieee.lt(a, b)), "<=": lambda a, b: _truth(ieee.le(a, b)), ">": lambda a, b: _truth(ieee.gt(a, b)), ">=": lambda a, b: _truth(ieee.ge(a, b)), "==": lambda a, b: _truth(ieee.eq(a, b)), "!=": lambda a, b: _truth(ieee.ne(a, b)),
    "and": lambda a, b: _truth((a != 0) & (b != 0)), "or": lambda a, b: _truth((a != 0) | (b != 0)), "not": lambda a: _truth(a == 0), "finite": lambda a: _truth(ieee.is_finite(a)),
}
OUTSIDE = {
    "pow": lambda a, b: ieee.lt(a, F.lit(0.0)) & (b != ieee.trunc(b)), "sqrt": lambda a: ieee.lt(a, F.lit(0.0)), "ln": lambda a: ieee.le(a, F.lit(0.0)), "log2": lambda a: ieee.le(a, F.lit(0.0)), "log10": lambda a: ieee.le(a, F.lit(0.0)),
    "asin": lambda a: ~(ieee.ge(a, F.lit(-1.0)) & ieee.le(a, F.lit(1.0))), "acos": lambda a: ~(ieee.ge(a, F.lit(-1.0)) & ieee.le(a, F.lit(1.0))), "clamp": lambda x, lo, hi: ieee.gt(lo, hi),
}


def expressible(model: Model) -> bool:
    """Whether the model has no loop, no outside program, no fma and no whole-number arithmetic but widening."""
    return not model.loops and not any(i.op in ("opaque", "fma", "write") or i.kind == "i64" for i in model.instrs)


def operand(model: Model, o: Operand) -> Column:
    """An operand of run_model, which has a column for each input (_p) and each instruction (_n)."""
    kind, at = o
    if kind == "lit":
        return F.lit(float(at))
    if kind == "param":
        return F.col(f"_p{int(at)}")
    if kind == "slot":
        return operand(model, model.slots[int(at)][1])
    return F.col(f"_n{int(at)}")


def _waves(model: Model, block: range) -> list[list[int]]:
    """The block's instructions by the length of the longest chain of the block's instructions that they wait for."""
    depth: dict[int, int] = {}

    def at(o: Operand) -> int:
        kind, i = o
        return at(model.slots[int(i)][1]) if kind == "slot" else depth.get(int(i), 0) if kind == "node" else 0

    for i in block:
        depth[i] = 1 + max(map(at, model.instrs[i].args), default=0)
    return [[i for i in block if depth[i] == wave] for wave in sorted(set(depth.values()))]


def _evaluated(out: DataFrame, model: Model, block: range, single: bool) -> DataFrame:
    """out with the block's results, and what they raise, told of all of them together, as _f and the block's start."""
    f32 = lambda c: c.cast("float").cast("double")
    results, zero, outside = [], [], []
    for wave in _waves(model, block):
        made = {}
        for i in wave:
            ins = model.instrs[i]
            exact = ins.op in ("i2f", "copy")
            args = [f32(operand(model, a)) if single and not exact else operand(model, a) for a in ins.args]
            value = VALUES[ins.op](*args)
            if ins.kind == "f64" and not exact:
                value = f32(value) if single else value
                results.append(F.col(f"_n{i}"))
            made[f"_n{i}"] = value
            if ins.op in ("/", "%"):
                zero.append(args[1] == 0)
            if ins.op in OUTSIDE:
                outside.append(OUTSIDE[ins.op](*args))
        out = out.withColumns(made)
    flags = F.lit(0)
    for told, flag in ((zero, Flag.ZERO_DIVISION), (outside, Flag.INVALID_DOMAIN)):
        if told:
            flags = flags.bitwiseOR(F.when(reduce(lambda a, b: a | b, told), F.lit(int(flag))).otherwise(F.lit(0)))
    if results:
        out = out.withColumn("_results", F.array(*results))
        flags = flags.bitwiseOR(ieee.result_flags(F.col("_results")))
    return out.withColumn(f"_f{block.start}", flags).drop("_results")


def _parted(out: DataFrame, made: list[str]) -> DataFrame:
    """out, with its columns made handed on by a generator of one row, which no generated method reaches across."""
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c not in made], F.inline(F.array(F.struct(*made))))


def _blocks(model: Model) -> list[range]:
    starts, size = [0], 0
    for i, ins in enumerate(model.instrs):
        size += SIZES.get(ins.op, 1)
        if size > BLOCK and i > starts[-1]:
            starts.append(i)
            size = SIZES.get(ins.op, 1)
    return [range(a, b) for a, b in pairwise([*starts, len(model.instrs)])]


def run_model(points: DataFrame, model: Model, single: bool = False) -> DataFrame:
    """points (with x) with y, flags, steps and rules; each instruction is a column of its own, computed once.

    Spark makes one method of all that projections in a row do, and the JVM compiles none of over 8,000 bytes but
    interprets it. So inputs are taken out of x once, and blocks of instructions are parted.
    """
    out = points.withColumns({f"_p{k}": F.get("x", F.lit(k)) for k in range(len(model.params))})
    whole = [f"_p{k}" for k, p in enumerate(model.params) if p.integer]
    for some in (whole[i : i + 2] for i in range(0, len(whole), 2)):
        out = _parted(out.withColumns({c: ieee.trunc(F.col(c)) for c in some}), some)
    flags = F.lit(0)
    for block in _blocks(model):
        out = _evaluated(out, model, block, single)
        if block.stop < len(model.instrs):
            out = _parted(out, [*[f"_n{i}" for i in block], f"_f{block.start}"])
        flags = flags.bitwiseOR(F.col(f"_f{block.start}"))
    y = F.array(*[operand(model, o) for _, o in model.outputs])
    rules = F.array(*[F.array(operand(model, r.left), operand(model, r.right) if r.right else F.lit(0.0)) for r in model.rules]) if model.rules else F.array().cast("array<array<double>>")
    return out.select(*points.columns, y.cast("array<double>").alias("y"), F.array().cast("array<array<double>>").alias("traces"), flags.cast("int").alias("flags"), F.lit(len(model.instrs)).cast("long").alias("steps"), rules.alias("rules"))


def rules_of(model: Model) -> list[Rule]:
    """The model's rules over the rules column of run_model, for the evidence operators."""
    side = lambda k, i: F.get(F.get("rules", F.lit(k)), F.lit(i))
    return [Rule(r.id, side(k, 0), r.op, side(k, 1) if r.right else None, r.tolerance) for k, r in enumerate(model.rules)]
