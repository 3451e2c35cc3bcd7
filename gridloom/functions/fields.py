"""Derived fields: names to expressions.

A name is looked up as a raw column, then a registered field. Formulas are SQL
text in which ``div(a, b)`` is a division that gives NULL for a zero divisor;
``dialect`` turns it into what the engine at hand calls so. A single field is one
expression; ``select`` adds many at once, by a chain of projections in which each
field that others share is a column computed once. Either way Catalyst prunes the
scan's columns.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*\b(?!\s*\()|\[[^\]]+\]")
#: Words of SQL that may stand in formulas, and so aren't fields.
SQL_WORDS = {"and", "or", "not", "between", "case", "when", "then", "else", "end", "as", "cast", "double", "true", "false", "null", "is"}


#: Suffixes of profile-relative fields, and the field that masks the profile's weights.
MASKS = {"": None, "_hot": "Thotbool", "_range": "Trangebool"}


def _base() -> dict[str, str]:
    f = {f"{c}": f"x{n}min + (x{n}max - x{n}min) * ({i} + 0.5) / nx{n}" for c, n, i in (("x", 1, "i"), ("y", 2, "j"), ("z", 3, "k"))}
    for c, n in (("x", 1), ("y", 2), ("z", 3)):
        f[f"d{c}"] = f[f"d{c}_mb"] = f"(x{n}max - x{n}min) / nx{n}"
    f |= {"zeros": "0.0e0", "ones": "1.0e0", "vol": "dx * dy * dz", "vol_mb": "dx_mb * dy_mb * dz_mb", "neg_vol": "-vol"}
    f |= {
        "r": "sqrt(x*x + y*y + z*z)", "R_cyl": "sqrt(x*x + y*y)", "R": "R_cyl", "theta": "acos(div(z, r))", "phi": "atan2(y, x)", "b": "degrees(asin(div(z, r)))", "l": "degrees(atan2(y, x))",
        "x_sol": "x - 8.0e0 * kpc / length_cgs", "r_sol": "sqrt(x_sol*x_sol + y*y + z*z)", "b_sol": "degrees(asin(div(z, r_sol)))", "l_sol": "degrees(atan2(y, x_sol))",
        "mass": "vol * dens", "neg_mass": "-mass", "sqrt_rho": "sqrt(dens)",
        "entropy": "div(pres, power(dens, gamma))", "cs": "sqrt(cs2)", "temp_cgs": "temp * temperature_cgs",
        "vtot2": "velx*velx + vely*vely + velz*velz", "vtot": "sqrt(vtot2)", "mach": "sqrt([mach^2])", "mach^2": "div(vtot2, cs2)",
        "velr": "div(velx*x + vely*y + velz*z, r)", "vtheta": "div(z*velr - r*velz, R_cyl)", "vphi": "div(x*vely - y*velx, r)", "vrot": "sqrt(greatest(vtot2 - velr*velr, 0.0e0))",
        "momr": "velr * dens", "momtot": "dens * vtot", "amtot": "r * vrot", "ekin": "0.5e0 * dens * vtot2", "etot": "ekin + eint + emag",
    }
    for a, (b, c) in {"x": "yz", "y": "zx", "z": "xy"}.items():
        f[f"mom{a}"] = f"vel{a} * dens"
        f[f"j{a}"] = f[f"am{a}"] = f"{b}*vel{c} - {c}*vel{b}"
    f |= {"velin": "velrin", "velout": "velrout"}
    for d in "rz":  # inflow, outflow and fluxes along the radius and the vertical
        f |= {f"vel{d}in": f"least(vel{d}, 0.0e0)", f"vel{d}out": f"greatest(vel{d}, 0.0e0)"}
        for s in ("", "in", "out"):
            f |= {f"mflx{d}{s}": f"dens * vel{d}{s}", f"momflx{d}{s}": f"dens * vel{d} * vel{d}{s}", f"ekflx{d}{s}": f"ekin * vel{d}{s}", f"eflx{d}tot{s}": f"vel{d}{s} * (ekin + gamma*eint + emag)"}
    for s in ("", "in", "out"):
        f |= {f"mdot{s}": f"mflxr{s}", f"momflx{s}": f"momflxr{s}", f"ekflx{s}": f"ekflxr{s}", f"eflxtot{s}": f"eflxrtot{s}"}
    f |= {"btot": "sqrt(btot2)", "v_A": "sqrt([v_A^2])", "mach_A": "sqrt([mach_A^2])", "brot": "sqrt(greatest(btot2 - bccr*bccr, 0.0e0))"}
    for q in ("temp", "velx", "vely", "velz", "bccx", "bccy", "bccz", "beta"):
        f |= {f"{q}_mw": f"mass * {q}", f"{q}_vw": f"vol * {q}"}
    f |= {"tcool": "case when coolr > 0 then eint / coolr else 0.0e0 end", "Tcoldbool": "case when temp_cgs < T_cold then 1.0e0 else 0.0e0 end", "Thotbool": "case when temp_cgs >= T_hot then 1.0e0 else 0.0e0 end", "Trangebool": "case when temp_cgs between T_min and T_max then 1.0e0 else 0.0e0 end"}
    f["xyzbool"] = "case when " + " and ".join(f"{c} between {c}_lo and {c}_hi" for c in "xyz") + " then 1.0e0 else 0.0e0 end"
    for m in ("Tcoldbool", "Thotbool", "Trangebool", "xyzbool"):
        f |= {f"{m}_vol": f"{m} * vol", f"{m}_mass": f"{m} * mass"}
    # the current: curl of the magnetic field, whose partial derivatives Snapshot.table adds as columns
    f |= {"curx": "c_code * (dbcc3_dy - dbcc2_dz)", "cury": "c_code * (dbcc1_dz - dbcc3_dx)", "curz": "c_code * (dbcc2_dx - dbcc1_dy)", "cur": "sqrt(curx*curx + cury*cury + curz*curz)"}
    # relative to the vertical profile, which Snapshot.table joins as p_* columns; those of _hot and _range are of masked weights
    f |= {f"nvel{c}": f"vel{c} - p_vel{c}" for c in "xyz"}
    for s in MASKS:
        f |= {f"nrho{s}": f"div(dens, p_dens{s})", f"nprs{s}": f"div(pres, p_pres{s})", f"eflxwave{s}": f"(pres - p_pres{s}) * (velr - p_velr{s})", f"delrhodelT{s}": f"(dens - p_dens{s}) * (temp - p_temp{s})", f"delvrdelT{s}": f"(velr - p_velr{s}) * (temp - p_temp{s})"}
    return f


GAS = {
    "adiabatic": {"pres": "(gamma - 1) * eint", "temp": "div((gamma - 1) * eint, dens)", "cs2": "div(gamma * pres, dens)"},
    "isothermal": {"pres": "gamma * dens * iso_sound_speed * iso_sound_speed", "temp": "iso_sound_speed * iso_sound_speed", "cs2": "iso_sound_speed * iso_sound_speed", "eint": "dens * temp"},
}
INF = "cast('Infinity' as double)"
MAGNETIC = {
    True: {"emag": "0.5e0 * btot2", "bccx": "bcc1", "bccy": "bcc2", "bccz": "bcc3", "bccr": "div(bccx*x + bccy*y + bccz*z, r)", "btot2": "bccx*bccx + bccy*bccy + bccz*bccz", "v_A^2": "div(btot2, dens)", "mach_A^2": "div(vtot2, [v_A^2])", "beta": "div(pres, 0.5e0 * btot2)", "pth_plus_mag": "pres + 0.5e0 * btot2"},
    False: dict.fromkeys(("emag", "bccx", "bccy", "bccz", "bccr", "btot2", "v_A^2", "curx", "cury", "curz"), "0.0e0") | {"mach_A^2": INF, "beta": INF, "pth_plus_mag": "pres"},
}
PARAMETERS = {"gamma": 5 / 3, "iso_sound_speed": 1.0, "T_cold": 1.0, "T_hot": 1.0, "T_min": 1.0, "T_max": 1.0, "x_lo": -1e300, "x_hi": 1e300, "y_lo": -1e300, "y_hi": 1e300, "z_lo": -1e300, "z_hi": 1e300}


class Fields:
    """Names to columns. ``raw``: the table's columns; ``parameters``: numbers that formulas name (mesh, gas, units, thresholds)."""

    def __init__(self, raw: list[str], *, mhd: bool = False, eos: str = "adiabatic", parameters: dict[str, float] | None = None, units=None):
        from gridloom.functions.units import Units

        self.raw = set(raw)
        self.formulas = _base() | GAS[eos] | MAGNETIC[mhd]
        units = units or Units()
        self.parameters = PARAMETERS | {"kpc": 3.0856775814913673e21, "length_cgs": units.length_cgs, "temperature_cgs": units.temperature_cgs, "c_code": units.speed_of_light} | (parameters or {})
        self.added: dict[str, Callable[[], Column]] = {"rand": lambda: F.rand(17)}

    def register(self, name: str, formula: str | Callable[[], Column]) -> None:
        """A field of the user's: a formula over other fields, or a function that returns a Column."""
        if callable(formula):
            self.added[name] = formula
        else:
            self.formulas[name] = formula

    def sql(self, name: str, dialect: str = "spark", _above: tuple[str, ...] = ()) -> str:
        if name in self.raw:
            return name
        if name not in self.formulas:
            if name in self.parameters:
                return f"{self.parameters[name]!r}" if "e" in repr(float(self.parameters[name])) else f"{float(self.parameters[name])!r}e0"
            raise ValueError(f"No field called {name!r}")
        if name in _above:
            raise ValueError(f"{name!r} is defined by itself")

        def expand(m: re.Match) -> str:
            word = m[0].strip("[]")
            before = m.string[: m.start()]
            if word.lower() in SQL_WORDS or re.search(r"[0-9.]$", before) or before.count("'") % 2:
                return m[0]
            return f"({self.sql(word, dialect, (*_above, name))})"

        text = NAME.sub(expand, self.formulas[name])
        return text if _above else _divide(text, dialect)

    def over(self, raw: list[str]) -> Fields:
        """The same fields over a table with other columns."""
        other = copy.copy(self)
        other.raw = set(raw)
        return other

    def _parts(self, name: str) -> tuple[str, list[str]]:
        """A formula with {k} for its k-th word, and the words: raw columns, fields or parameters."""
        words: list[str] = []

        def mark(m: re.Match) -> str:
            word, before = m[0].strip("[]"), m.string[: m.start()]
            if word.lower() in SQL_WORDS or re.search(r"[0-9.]$", before) or before.count("'") % 2:
                return m[0]
            words.append(word)
            return f"{{{len(words) - 1}}}"

        return NAME.sub(mark, self.formulas[name]), words

    def needs(self, names: list[str]) -> list[str]:
        """All words that the fields' formulas name, directly or not, and the names themselves."""
        found: dict[str, None] = {}

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"{name!r} is defined by itself")
            if name not in found:
                if name not in self.raw and name not in self.added and name in self.formulas:
                    for word in self._parts(name)[1]:
                        visit(word, (*above, name))
                found[name] = None

        for name in names:
            visit(name, ())
        return list(found)

    def select(self, cells: DataFrame, names: list[str]) -> DataFrame:
        """``cells`` and the fields ``names`` as columns of those names (names that differ by case only can't both be asked for)."""
        order = [n for n in self.needs(names) if n not in self.raw]  # each after what it needs
        if missing := [n for n in order if n not in self.formulas and n not in self.added and n not in self.parameters]:
            raise ValueError(f"No field called {missing[0]!r}")
        shown = {n: f"`{n}`" for n in self.raw} | {n: self.sql(n) for n in order if n in self.parameters and n not in self.formulas}
        depth, made = {n: 0 for n in shown}, {}
        for k, n in enumerate(n for n in order if n not in shown):
            words = [] if n in self.added else self._parts(n)[1]
            depth[n], shown[n] = 1 + max([depth[w] for w in words], default=0), f"`_f{k}`"
            made.setdefault(depth[n], []).append(n)
        for level in sorted(made):
            text = {n: _divide((p := self._parts(n))[0].format(*[f"({shown[w]})" for w in p[1]]), "spark") for n in made[level] if n not in self.added}
            cells = cells.select("*", *[(self.added[n]() if n in self.added else F.expr(text[n])).alias(shown[n].strip("`")) for n in made[level]])
        kept = [F.col(f"`{c}`") for c in cells.columns if not re.fullmatch(r"_f\d+", c) and c not in names]
        return cells.select(*kept, *[F.expr(shown[n]).alias(n) for n in names])

    def __call__(self, name: str) -> Column:
        return self.added[name]() if name in self.added else F.expr(self.sql(name)) if name not in self.raw else F.col(f"`{name}`")


def _divide(text: str, dialect: str) -> str:
    """div(a, b) in the engine's words."""
    if dialect == "spark":
        return text.replace("div(", "try_divide(")
    while (at := text.find("div(")) >= 0:
        depth, k, comma = 1, at + 4, None
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            if text[k] == "," and depth == 1:
                comma = k
            k += 1
        text = f"{text[:at]}(({text[at + 4 : comma]}) / nullif({text[comma + 1 : k - 1]}, 0)){text[k:]}"
    return text
