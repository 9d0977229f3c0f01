"""Physical dimensions and units."""

from __future__ import annotations

import math
from dataclasses import dataclass

BASES = ("m", "kg", "s", "A", "K", "mol", "cd")

#: Seven exponents, doubled so that halves are whole; None is unknown.
Dim = tuple[int, ...] | None
NONE: Dim = (0,) * 7


def combine(a: Dim, b: Dim, sign: int) -> Dim:
    return None if a is None or b is None else tuple(x + sign * y for x, y in zip(a, b, strict=True))


def power(a: Dim, n: float) -> Dim:
    """a to the n; unknown where an exponent would not be a half."""
    if a is None:
        return None
    out = [x * n for x in a]
    return tuple(int(x) for x in out) if all(x == int(x) for x in out) else None


def dim_text(d: Dim) -> str:
    if d is None:
        return "?"
    part = lambda e: "" if e == 2 else f"^{e // 2}" if e % 2 == 0 else f"^{e}/2"
    up = [b + part(e) for b, e in zip(BASES, d, strict=True) if e > 0]
    down = [b + part(-e) for b, e in zip(BASES, d, strict=True) if e < 0]
    return ("*".join(up) or "1") + ("/" + "/".join(down) if down else "")


@dataclass(frozen=True)
class Unit:
    dim: Dim = NONE
    scale: float = 1.0
    integral: bool = False

    def times(self, other: Unit) -> Unit:
        return Unit(combine(self.dim, other.dim, 1), self.scale * other.scale)

    def over(self, other: Unit) -> Unit:
        return Unit(combine(self.dim, other.dim, -1), self.scale / other.scale)

    def to(self, n: float) -> Unit:
        return Unit(power(self.dim, n), self.scale**n)


def _base(text: str, scale: float = 1.0) -> Unit:
    """A unit from words like "kg m/s/s"."""
    exps = [0] * 7
    for k, part in enumerate(text.split("/")):
        for word in part.split():
            exps[BASES.index(word)] += 2 if k == 0 else -2
    return Unit(tuple(exps), scale)


#: Symbols and what they measure.
UNITS = {
    "m": _base("m"), "meter": _base("m"), "metre": _base("m"), "km": _base("m", 1000.0), "cm": _base("m", 0.01), "mm": _base("m", 0.001), "um": _base("m", 1e-6), "nm": _base("m", 1e-9),
    "kg": _base("kg"), "g": _base("kg", 0.001), "mg": _base("kg", 1e-6), "t": _base("kg", 1000.0),
    "s": _base("s"), "sec": _base("s"), "ms": _base("s", 0.001), "us": _base("s", 1e-6), "ns": _base("s", 1e-9), "min": _base("s", 60.0), "h": _base("s", 3600.0), "hr": _base("s", 3600.0), "hour": _base("s", 3600.0), "day": _base("s", 86400.0),
    "A": _base("A"), "amp": _base("A"), "C": _base("A s"), "coulomb": _base("A s"),
    "N": _base("kg m/s/s"), "newton": _base("kg m/s/s"), "J": _base("kg m m/s/s"), "joule": _base("kg m m/s/s"), "W": _base("kg m m/s/s/s"), "watt": _base("kg m m/s/s/s"),
    "V": _base("kg m m/s/s/s/A"), "volt": _base("kg m m/s/s/s/A"), "ohm": _base("kg m m/s/s/s/A/A"), "Pa": _base("kg/m/s/s"), "pascal": _base("kg/m/s/s"), "T": _base("kg/A/s/s"), "tesla": _base("kg/A/s/s"),
    "Hz": _base("/s"), "hertz": _base("/s"), "K": _base("K"), "kelvin": _base("K"),
    "rad": Unit(), "deg": Unit(scale=math.pi / 180.0), "percent": Unit(scale=0.01), "count": Unit(integral=True),
}
#: Symbols that are refused, and why.
REFUSED = {
    "Celsius": "a temperature in degrees Celsius has an offset, which a factor cannot convert; use kelvin",
    "degC": "a temperature in degrees Celsius has an offset, which a factor cannot convert; use kelvin",
    "fps": "fps may be frames or feet per second; write 1/s or ft/s",
}
