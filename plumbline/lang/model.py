"""Checked models: typed three-address code with units, from statements; its verification and its text."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from plumbline.lang import units
from plumbline.lang.syntax import Expr, ModelError, Source, Statement, parse
from plumbline.lang.units import NONE, Dim, Unit
from plumbline.sources.sample import Axis

#: Functions of one argument; those of pure numbers only; those of several, with their number.
UNARY = ("abs", "sqrt", "cbrt", "exp", "ln", "log2", "log10", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "floor", "ceil", "round", "trunc", "finite")
PURE = ("exp", "ln", "log2", "log10", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh")
CALLS = {"min": 2, "max": 2, "pow": 2, "atan2": 2, "hypot": 2, "fma": 3, "clamp": 3, "lerp": 3}
CONSTANTS = {"pi": math.pi, "tau": math.tau, "e": math.e, "sqrt2": math.sqrt(2.0), "inf": math.inf}
COMPARISONS = ("<", "<=", ">", ">=", "==", "!=", "~")
APPROX = 1e-9

#: An operand: ("lit", number), ("param", i), ("slot", i) or ("node", i).
Operand = tuple[str, float]


@dataclass
class Instr:
    """op with operands: an operator or function name; copy, i2f, loop (count; block), write (value; slot), opaque."""

    op: str
    args: list[Operand]
    kind: str = "f64"  # f64, i64, bool or unit
    block: int = -1
    slot: int = -1


@dataclass
class Rule:
    id: int
    name: str
    left: Operand
    op: str  # < <= > >= ~ finite
    right: Operand | None = None
    tolerance: float = 0.0


@dataclass
class Relation:
    id: int
    kind: str
    of: int
    wrt: list[int] = field(default_factory=list)
    amount: float = 0.0


@dataclass
class Model:
    name: str
    doc: str = ""
    params: list[Axis] = field(default_factory=list)
    param_units: list[Unit] = field(default_factory=list)
    instrs: list[Instr] = field(default_factory=list)
    blocks: list[list[int]] = field(default_factory=lambda: [[]])
    slots: list[tuple[str, Operand, str]] = field(default_factory=list)  # name, first value, kind
    outputs: list[tuple[str, Operand]] = field(default_factory=list)
    traces: list[tuple[str, Operand, int]] = field(default_factory=list)  # name, value, block
    rules: list[Rule] = field(default_factory=list)
    relations: list[Relation] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def opaque(self) -> bool:
        """Whether some output comes from an external program."""
        return any(i.op == "opaque" for i in self.instrs)

    @property
    def loops(self) -> bool:
        return any(i.op == "loop" for i in self.instrs)

    def output(self, name: str) -> int:
        return [n for n, _ in self.outputs].index(name)


@dataclass
class Bound:
    """A value in the making; flexible: a plain number, which takes on any unit."""

    at: Operand
    kind: str
    unit: Unit
    flexible: bool = False


class Lowering:
    def __init__(self, source: Source) -> None:
        self.m = Model(source.name, source.doc)
        self.names: dict[str, Bound] = {}
        self.problems: list[tuple[int, str]] = []
        self.block = 0
        self.run(source.statements)
        if not self.problems:
            self.problems += [(0, p) for p in verify(self.m)]
        if self.problems:
            raise ModelError(self.problems)

    def fail(self, line: int, message: str) -> None:
        self.problems.append((line, message))

    def run(self, statements: list[Statement]) -> None:
        for s in statements:
            getattr(self, f"_{s.kind}")(s)

    # -- constants

    def constant(self, e: Expr) -> float | None:
        """The value of an expression of numbers alone."""
        try:
            return self._folded(e)
        except (ValueError, ZeroDivisionError, OverflowError):
            self.fail(e.line, "a constant is needed here")
            return None

    def _folded(self, e: Expr) -> float:
        if e.op == "num":
            return e.args[0]
        if e.op == "name" and e.args[0] in CONSTANTS:
            return CONSTANTS[e.args[0]]
        if e.op == "neg":
            return -self._folded(e.args[0])
        if e.op in ("+", "-", "*", "/", "^"):
            a, b = map(self._folded, e.args)
            return {"+": a + b, "-": a - b, "*": a * b}[e.op] if e.op in "+-*" else a / b if e.op == "/" else a**b
        if e.op == "call" and len(e.args[1]) == 1 and e.args[0] in ("abs", "sqrt", "exp", "ln", "sin", "cos", "tan"):
            f = {"abs": abs, "ln": math.log}.get(e.args[0]) or getattr(math, e.args[0])
            return f(self._folded(e.args[1][0]))
        raise ValueError

    # -- declarations

    def _unit(self, s: Statement) -> Unit | None:
        if s.unit is None:
            return None
        out = Unit()
        for name, n in s.unit:
            if name in units.REFUSED:
                self.fail(s.line, f"{name}: {units.REFUSED[name]}")
            elif name not in units.UNITS:
                self.fail(s.line, f"{name!r} is no known unit")
            else:
                one = units.UNITS[name]
                out = one if s.unit == [(name, 1.0)] else out.times(one.to(n))
        return out

    def _declare(self, s: Statement, b: Bound) -> None:
        if s.name in self.names:
            self.fail(s.line, f"{s.name!r} has a meaning already")
        self.names[s.name] = b

    def _input(self, s: Statement) -> None:
        unit = self._unit(s) or Unit()
        if "choices" in s.parts:
            values = [v for v in map(self.constant, s.parts["choices"]) if v is not None]
            if len(values) < 2:
                self.fail(s.line, f"{s.name} needs two choices at least")
            axis = Axis(s.name, choices=tuple(values), integer=unit.integral)
        else:
            lo, hi = self.constant(s.parts["lo"]), self.constant(s.parts["hi"])
            if lo is None or hi is None:
                return
            if not (math.isfinite(lo) and math.isfinite(hi)):
                self.fail(s.line, f"the domain of {s.name} has no bound")
            elif lo >= hi:
                self.fail(s.line, f"the domain of {s.name} is empty: {lo} is not below {hi}")
            axis = Axis(s.name, lo, hi, integer=unit.integral)
        self._declare(s, Bound(("param", len(self.m.params)), "i64" if unit.integral else "f64", unit))
        self.m.params.append(axis)
        self.m.param_units.append(unit)

    def _output(self, s: Statement) -> None:
        at = self.emit(Instr("opaque", [], "f64"))
        self._declare(s, Bound(at, "f64", self._unit(s) or Unit(None)))
        self.m.outputs.append((s.name, at))

    def _let(self, s: Statement) -> None:
        b = self.expr(s.parts["value"])
        if b is None:
            return
        unit = self._unit(s)
        if unit is not None:
            if b.flexible:
                b = Bound(b.at, b.kind, unit)
            else:
                self.alike(Bound(b.at, b.kind, unit), b, s.line, s.name)
        if b.at[0] == "slot":  # the value now, not later
            b = Bound(self.emit(Instr("copy", [b.at], b.kind)), b.kind, b.unit)
        self._declare(s, b)
        if self.block == 0:
            self.m.outputs.append((s.name, b.at))

    def _state(self, s: Statement) -> None:
        b = self.expr(s.parts["value"])
        if b is None:
            return
        if self.block:
            self.fail(s.line, "a state is declared outside loops")
        if b.kind == "i64":
            b = Bound(self.widened(b), "f64", b.unit, b.flexible)
        at = ("slot", len(self.m.slots))
        self.m.slots.append((s.name, b.at, b.kind))
        self._declare(s, Bound(at, b.kind, self._unit(s) or (Unit(None) if b.flexible and s.unit is None else b.unit)))
        self.m.outputs.append((s.name, at))

    def _advance(self, s: Statement) -> None:
        b, to = self.expr(s.parts["value"]), self.names.get(s.name)
        if b is None:
            return
        if to is None or to.at[0] != "slot":
            self.fail(s.line, f"{s.name!r} is no state")
            return
        if not self.block:
            self.fail(s.line, "a state advances inside a loop")
        self.alike(to, b, s.line, s.name)
        at = self.widened(b) if b.kind == "i64" and to.kind == "f64" else b.at
        self.emit(Instr("write", [at], "unit", slot=int(to.at[1])))

    def _loop(self, s: Statement) -> None:
        count = self.expr(s.parts["count"])
        if count is None:
            return
        if count.kind != "i64":
            self.fail(s.line, "a loop needs a whole number of steps")
            return
        inner = len(self.m.blocks)
        self.m.blocks.append([])
        self.emit(Instr("loop", [count.at], "unit", block=inner))
        outer, names, self.block = self.block, dict(self.names), inner
        self.run(s.body)
        self.block = outer
        self.names = {k: v for k, v in self.names.items() if k in names}

    def _watch(self, s: Statement) -> None:
        b = self.names.get(s.name)
        if b is None or not self.block:
            self.fail(s.line, f"{s.name!r} cannot be watched here")
            return
        self.m.traces.append((s.name, b.at, self.block))

    # -- rules

    def _require(self, s: Statement) -> None:
        value = s.parts["value"]
        if "lo" in s.parts:
            b, lo, hi = self.expr(value), self.constant(s.parts["lo"]), self.constant(s.parts["hi"])
            if b is not None and lo is not None and hi is not None:
                at = self.number(b)
                self._rule(s, at, ">=", ("lit", lo))
                self._rule(s, at, "<=", ("lit", hi))
            return
        self._require_part(s, value, s.parts.get("tolerance"))

    def _require_part(self, s: Statement, e: Expr, tolerance: Expr | None) -> None:
        if e.op == "and":
            for part in e.args:
                self._require_part(s, part, None)
        elif e.op in COMPARISONS:
            if e.op == "!=":
                self.fail(e.line, "!= cannot be required; use a range or a sign")
                return
            a, b = self.expr(e.args[0]), self.expr(e.args[1])
            if a is None or b is None:
                return
            self.alike(a, b, e.line, "a requirement")
            amount = self.constant(tolerance) if tolerance is not None else APPROX if e.op == "~" else 0.0
            self._rule(s, self.number(a), "~" if e.op == "==" else e.op, self.number(b), amount or 0.0)
        elif e.op == "call" and e.args[0] == "finite" and len(e.args[1]) == 1:
            b = self.expr(e.args[1][0])
            if b is not None:
                self._rule(s, self.number(b), "finite", None)
        elif e.op in ("or", "not"):
            self.fail(e.line, f"{e.op} cannot be required: each rule is checked by itself")
        else:
            self.fail(e.line, "a requirement is a comparison or finite(...)")

    def _rule(self, s: Statement, left: Operand, op: str, right: Operand | None, tolerance: float = 0.0) -> None:
        n = len(self.m.rules)
        self.m.rules.append(Rule(n, s.parts.get("doc") or f"require{n}", left, op, right, tolerance))

    def _check(self, s: Statement) -> None:
        if s.name == "conserved":
            names = [n for n, _, _ in self.m.traces]
            if s.parts["of"] not in names:
                self.fail(s.line, f"{s.parts['of']!r} is not watched; watched are {', '.join(names) or 'none'}")
                return
            amount = 1e-3 if s.parts["amount"] is None else self.constant(s.parts["amount"])
            self.m.relations.append(Relation(len(self.m.relations), s.name, names.index(s.parts["of"]), [], amount or 0.0))
            return
        outputs, params = [n for n, _ in self.m.outputs], [a.name for a in self.m.params]
        wrt = s.parts["wrt"] if s.name == "symmetric" else [s.parts["wrt"]]
        if s.parts["of"] not in outputs:
            self.fail(s.line, f"{s.parts['of']!r} is no output")
        elif bad := [w for w in wrt if w not in params]:
            self.fail(s.line, f"{bad[0]!r} is no input")
        else:
            at = [params.index(w) for w in wrt]
            if s.name == "symmetric" and self.m.param_units[at[0]].dim != self.m.param_units[at[1]].dim:
                self.fail(s.line, "inputs of different dimensions cannot be exchanged")
            amount = self.constant(s.parts["amount"]) if "amount" in s.parts else 0.0
            if s.name == "scales_as" and amount is not None and amount * 2 % 1:
                self.m.warnings.append(f"line {s.line}: units do not follow the exponent {amount}")
            self.m.relations.append(Relation(len(self.m.relations), s.name, outputs.index(s.parts["of"]), at, amount or 0.0))

    # -- expressions

    def emit(self, i: Instr) -> Operand:
        self.m.instrs.append(i)
        self.m.blocks[self.block].append(len(self.m.instrs) - 1)
        return ("node", len(self.m.instrs) - 1)

    def widened(self, b: Bound) -> Operand:
        """An integer as a number; a literal is one already."""
        return b.at if b.at[0] == "lit" else self.emit(Instr("i2f", [b.at]))

    def number(self, b: Bound) -> Operand:
        return self.widened(b) if b.kind == "i64" else b.at

    def alike(self, a: Bound, b: Bound, line: int, what: str) -> Unit:
        """Whether two values can be held against each other; the unit of both."""
        if a.flexible or b.flexible:
            return b.unit if a.flexible else a.unit
        if a.unit.dim is None or b.unit.dim is None:
            return a.unit if b.unit.dim is None else b.unit
        if a.unit.dim != b.unit.dim:
            self.fail(line, f"{what}: {units.dim_text(a.unit.dim)} and {units.dim_text(b.unit.dim)} are different quantities")
        elif not math.isclose(a.unit.scale, b.unit.scale):
            self.m.warnings.append(f"line {line}: {what} mixes scales of one quantity; values are not converted")
        return a.unit

    def expr(self, e: Expr) -> Bound | None:
        if e.op == "num":
            return Bound(("lit", e.args[0]), "i64" if e.args[1] else "f64", Unit(), True)
        if e.op == "bool":
            return Bound(("lit", float(e.args[0])), "bool", Unit())
        if e.op == "name":
            if (b := self.names.get(e.args[0])) is not None:
                return b
            if e.args[0] in CONSTANTS:
                return Bound(("lit", CONSTANTS[e.args[0]]), "f64", Unit(), True)
            return self.fail(e.line, f"{e.args[0]!r} is not known")
        if e.op == "call":
            return self.call(e)
        parts = [self.expr(a) for a in e.args]
        if any(p is None for p in parts):
            return None
        if e.op == "neg":
            a = parts[0]
            if a.at[0] == "lit":
                return Bound(("lit", -a.at[1]), a.kind, a.unit, a.flexible)
            return Bound(self.emit(Instr("neg", [a.at], a.kind)), a.kind, a.unit)
        if e.op == "not":
            return Bound(self.emit(Instr("not", [parts[0].at], "bool")), "bool", Unit())
        a, b = parts
        if e.op in ("and", "or"):
            return Bound(self.emit(Instr(e.op, [a.at, b.at], "bool")), "bool", Unit())
        if e.op in COMPARISONS:
            self.alike(a, b, e.line, "a comparison")
            x, y = self.number(a), self.number(b)
            if e.op == "~":  # within 1e-9 of the right side, which has to be positive for it
                gap = self.emit(Instr("abs", [self.emit(Instr("-", [x, y]))]))
                return Bound(self.emit(Instr("<=", [gap, self.emit(Instr("*", [("lit", APPROX), y]))], "bool")), "bool", Unit())
            return Bound(self.emit(Instr(e.op, [x, y], "bool")), "bool", Unit())
        return self.arithmetic(e.op, a, b, e.line, e.args[1])

    def arithmetic(self, op: str, a: Bound, b: Bound, line: int, right: Expr) -> Bound:
        whole = a.kind == b.kind == "i64" and op not in ("/", "^")
        x, y = (a.at, b.at) if whole else (self.number(a), self.number(b))
        flexible = a.flexible and b.flexible
        if op in ("+", "-", "%"):
            unit = self.alike(a, b, line, f"{op}")
        elif op == "*":
            unit = a.unit.times(b.unit)
        elif op == "/":
            unit = a.unit.over(b.unit)
        else:
            unit = self.raised(a, b, line)
        if a.at[0] == b.at[0] == "lit" and op in "+-*":  # numbers alone stay numbers
            return Bound(("lit", {"+": x[1] + y[1], "-": x[1] - y[1], "*": x[1] * y[1]}[op]), "i64" if whole else "f64", unit, flexible) if self.fold_body else Bound(self.emit(Instr(op, [x, y], "i64" if whole else "f64")), "i64" if whole else "f64", unit, flexible)
        kind = "i64" if whole else "f64"
        return Bound(self.emit(Instr("pow" if op == "^" else op, [x, y], kind)), kind, unit, flexible)

    #: The body of a model is not folded, only domains, tolerances and exponents are.
    fold_body = False

    def raised(self, a: Bound, b: Bound, line: int) -> Unit:
        if not b.flexible and b.unit.dim not in (NONE, None):
            self.fail(line, "an exponent is a pure number")
        if a.unit.dim == NONE:
            return Unit()
        if b.at[0] == "lit":
            return a.unit.to(b.at[1])
        return Unit(None)

    def call(self, e: Expr) -> Bound | None:
        name, given = e.args
        if name not in CALLS and name not in UNARY:
            return self.fail(e.line, f"{name!r} is no function")
        need = CALLS.get(name, 1)
        if len(given) != need:
            return self.fail(e.line, f"{name} takes {need} argument{'s' * (need > 1)}, not {len(given)}")
        parts = [self.expr(a) for a in given]
        if any(p is None for p in parts):
            return None
        first = parts[0]
        if name in PURE and not first.flexible and first.unit.dim not in (NONE, None):
            self.fail(e.line, f"{name} takes a pure number, not {units.dim_text(first.unit.dim)}")
        if name == "pow":
            return self.arithmetic("^", parts[0], parts[1], e.line, given[1])
        whole = name in ("min", "max", "abs") and all(p.kind == "i64" for p in parts)
        kind = "bool" if name == "finite" else "i64" if whole else "f64"
        unit = Unit()
        if name in ("sqrt", "cbrt"):
            unit = first.unit.to(1 / 2 if name == "sqrt" else 1 / 3)
            if unit.dim is None and first.unit.dim is not None and not first.flexible:
                self.fail(e.line, f"{name} of {units.dim_text(first.unit.dim)} has no whole dimension")
        elif name in ("abs", "floor", "ceil", "round", "trunc"):
            unit = first.unit
        elif name in ("min", "max", "hypot", "clamp"):
            unit = first.unit
            for p in parts[1:]:
                unit = self.alike(Bound(first.at, first.kind, unit, first.flexible), p, e.line, name)
        elif name == "lerp":
            unit = self.alike(parts[0], parts[1], e.line, name)
        elif name == "fma":
            unit = self.alike(Bound(first.at, "f64", parts[0].unit.times(parts[1].unit), parts[0].flexible and parts[1].flexible), parts[2], e.line, name)
        at = self.emit(Instr(name, [p.at if whole else self.number(p) for p in parts], kind))
        return Bound(at, kind, unit, name not in ("finite",) and all(p.flexible for p in parts))


def verify(m: Model) -> list[str]:
    """What is wrong with a model's structure."""
    out = []
    names = [a.name for a in m.params]
    if len(set(names)) < len(names):
        out.append("two inputs have the same name")
    if not m.params:
        out.append("the model has no input")
    for a in m.params:
        if a.discrete:
            if not all(map(math.isfinite, a.choices)) or len(set(a.choices)) < len(a.choices):
                out.append(f"the choices of {a.name} are not distinct numbers")
        elif not (math.isfinite(a.lo) and math.isfinite(a.hi) and a.lo < a.hi):
            out.append(f"the domain of {a.name} is not an interval")
    where = {n: b for b, block in enumerate(m.blocks) for n in block}
    if sorted(where) != list(range(len(m.instrs))):
        out.append("instructions and blocks do not match")
    sizes = {"param": len(m.params), "slot": len(m.slots), "node": len(m.instrs)}
    for i, ins in enumerate(m.instrs):
        for kind, at in ins.args:
            if kind != "lit" and not 0 <= at < sizes[kind] or kind == "node" and at >= i:
                out.append(f"instruction {i} reads what is not there")
        if ins.op == "loop" and not 0 < ins.block < len(m.blocks):
            out.append(f"instruction {i} loops over no block")
        if ins.op == "write" and not 0 <= ins.slot < len(m.slots):
            out.append(f"instruction {i} writes to no state")
    return out


def compile_model(text: str) -> Model:
    return Lowering(parse(text)).m


# ---- text ------------------------------------------------------------------------------------------------------------


def _exact(v: object) -> object:
    if isinstance(v, float):
        return {"f": v.hex()}
    if isinstance(v, dict):
        return {k: _exact(x) for k, x in v.items()}
    return [_exact(x) for x in v] if isinstance(v, (list, tuple)) else v


def _back(v: object) -> object:
    if isinstance(v, dict):
        return float.fromhex(v["f"]) if set(v) == {"f"} else {k: _back(x) for k, x in v.items()}
    return [_back(x) for x in v] if isinstance(v, list) else v


def to_text(m: Model) -> str:
    """Canonical text, exact to the bit."""
    return json.dumps(_exact(asdict(m)), sort_keys=True, separators=(",", ":"))


def from_text(text: str) -> Model:
    d = _back(json.loads(text))
    op = lambda o: None if o is None else tuple(o)
    out = Model(
        d["name"], d["doc"], [Axis(**{**a, "choices": tuple(a["choices"])}) for a in d["params"]], [Unit(None if u["dim"] is None else tuple(u["dim"]), u["scale"], u["integral"]) for u in d["param_units"]],
        [Instr(**{**i, "args": [op(a) for a in i["args"]]}) for i in d["instrs"]], d["blocks"], [(n, op(o), k) for n, o, k in d["slots"]], [(n, op(o)) for n, o in d["outputs"]], [(n, op(o), b) for n, o, b in d["traces"]],
        [Rule(**{**r, "left": op(r["left"]), "right": op(r["right"])}) for r in d["rules"]], [Relation(**r) for r in d["relations"]], d["warnings"],
    )
    if problems := verify(out):
        raise ModelError([(0, p) for p in problems])
    return out
