"""Verdicts of single cases, odd cases and typed reads."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.sources import builtins, cases, registry, rules

BASE = {"rho": "1 kg/m^3", "mu": "1 mPa*s", "re": "100", "l": "1 m", "dx": "1 cm", "tau": "0.53", "max steps": "10", "lattice": "D2Q9", "collision": "BGK"}
NAMES = {"l": "characteristic length", "u": "characteristic velocity"}


def text(**changes):
    lines = {**BASE, **{k.replace("_", " "): v for k, v in changes.items()}}
    return "\n".join(f"{NAMES.get(k, k)} = {v}" for k, v in lines.items() if v is not None)


CASES = {
    "sound": (text(), None, ["relaxation_time below 0.55"]),
    "no density": (text(rho="0 kg/m^3"), "density must be finite and above 0", []),
    "negative viscosity": (text(mu="-1 mPa*s"), "dynamic_viscosity must be finite and above 0", []),
    "infinite density": (text(rho="1e999 kg/m^3"), "density must be finite and above 0", []),
    "huge quotient": (text(rho="1e-300 kg/m^3", mu="1e300 Pa*s"), "kinematic_viscosity does not follow as a finite number", []),
    "length of 0": (text(l="0 m"), "characteristic_length must be finite and above 0", []),
    "spacing of 0": (text(dx="0 m"), "grid_spacing must be finite and above 0", []),
    "omega of 2": (text(tau=None, omega="2"), "relaxation_frequency must lie between 0 and 2", []),
    "omega of 0": (text(tau=None, omega="0"), "relaxation_frequency must lie between 0 and 2", []),
    "omega with tau": (text(omega=str(1 / 0.53)), None, ["relaxation_frequency is redundant", "relaxation_time below 0.55"]),
    "omega with tau is not held to its range": (text(omega="7"), None, ["relaxation_frequency is inconsistent", "relaxation_time below 0.55"]),
    "lattice velocity of 0": (text(tau=None, u_lat="0"), "lattice_characteristic_velocity must be finite and above 0", []),
    "steps of 0": (text(max_steps="0"), "max_steps must be finite and above 0", []),
    "half steps": (text(max_steps="1.5"), "max_steps must be an integer", []),
    "too many steps": (text(max_steps=None, end_time="1e300 s"), "max_steps is out of range", []),
    "time of 0 beside steps": (text(end_time="0 s"), "physical_time must be finite and above 0", []),
    "wrong dimension": (text(dx="1 s"), "line 5: wrong dimension", []),
    "fractional dimension": (text(dx="1 m^(1/2)"), "line 5: wrong dimension", []),
    "wrong kind": (text(tau="yes"), "line 6: wrong kind", []),
    "first bad line wins": (text(dx="1 s", rho="x y"), "line 1: wrong kind", []),
    "known parameter twice": (text() + "\nviscosity = 1 mPa*s", "line 10: stated twice", []),
    "own parameter twice": (text() + "\nx y = 1\nx-y = 2", "line 11: stated twice", []),
    "unknown unit": (text(l="1 furlong"), "line 4: not well formed", []),
    "unknown wall": (text(wall="glass"), "wall_boundary is unknown: glass", []),
    "no lattice": (text(lattice=None), "lattice_model is needed", []),
    "null": (None, "two of density, dynamic_viscosity and kinematic_viscosity are needed", []),
    "empty": ("# nothing\n\n", "two of density, dynamic_viscosity and kinematic_viscosity are needed", []),
}


def test_verdicts(spark):
    table = spark.createDataFrame([(k, t, 1.0) for k, (t, _, _) in CASES.items()], "case_id string, text string, density double")
    rows = registry.verdicts(table).collect()
    assert {r.case_id: (r.error, r.warnings) for r in rows} == {k: (e, w) for k, (_, e, w) in CASES.items()} and len(rows) == len(CASES)
    sound = next(r for r in rows if r.case_id == "sound")
    assert sound.characteristic_velocity == pytest.approx(0.1) and sound.mach_number == pytest.approx(100 * 0.01 / 100 * math.sqrt(3)) and (sound.lattice_model, sound.wall_boundary) == ("D2Q9", None)
    assert registry.verdicts(table.limit(0)).count() == 0


def test_rules_keep_extra_columns(spark):
    case = spark.createDataFrame([(1, "x")], "id long, note string").select("*", *(F.lit(None).cast("double").alias(n) for n in rules.CASE_COLUMNS))
    done = rules.complete(case).first()
    assert (done.id, done.note) == (1, "x") and done.error.startswith("two of density") and done.missing == ["density", "kinematic_viscosity", "characteristic_velocity", "characteristic_length", "relaxation_time", "max_steps"]


def test_names():
    names = builtins.parameter_names()
    assert len(builtins.PARAMETERS) == 34 and names["zsymmetry"] == "symmetric_z" and names["minimum_lattice_spacing"] == "grid_spacing" and "case_" not in names
    assert builtins.model_names("inlet_boundary")["zh_vel"] == "ZouHeVelocity"


def test_tables_reads_and_counts(spark):
    texts = [(1, "size = 3 km\nn = 7.0000000000001\nm = 3e9\nname = 'é'\non = yes\nrho = 2 kg/m^3"), (None, "size = 3 s\nn = 7.5\nname = 5"), (3, None)]
    rows = registry.checked(cases.parse_cases(cases.case_lines(spark.createDataFrame(texts, "case_id long, text string"))))
    wanted = [("size", "double", builtins.LENGTH, None), ("n", "int", None, None), ("m", "int", None, None), ("name", "string", None, 3), ("name", "double", None, None), ("on", "bool", None, None), ("m", "float", None, None)]
    got = {(r.case_id, r["name"], r.type): next((v for v in (r.double_value, r.int_value, r.flag, r.word) if v is not None), r.problem) for r in registry.read_as(rows, wanted).collect()}
    assert got == {
        (1, "size", "double"): 3000.0, (1, "n", "int"): 7, (1, "m", "int"): "out of range", (1, "name", "string"): "é", (1, "name", "double"): "wrong kind", (1, "on", "bool"): True, (1, "m", "float"): 3e9,
        (None, "size", "double"): "wrong dimension", (None, "n", "int"): "not whole", (None, "m", "int"): "not stated", (None, "name", "string"): "wrong kind", (None, "name", "double"): 5.0,
        (None, "on", "bool"): "not stated", (None, "m", "float"): "not stated",
    }
    table = registry.full_table(rows)
    assert table.count() == 68 and [(r.case_id, r["name"], r.value) for r in table.filter("stated").collect()] == [(1, "density", 2.0)]
    assert {tuple(r[:4]) + (tuple(r.unbound),) for r in registry.counts(rows, ["n"]).collect()} == {(1, 1, 5, 1, ("size", "m", "name", "on")), (None, 0, 3, 1, ("size", "name"))}
    with pytest.raises(ValueError, match="not one of"):
        registry.read_as(rows, [("n", "long", None, None)])


def test_quotes_and_separators(spark):
    from tessera.sources import cases

    lines = ["case = 'abc", "precision = \"x' # y", "case = 'a # b' # c", "case name: 'x' y", "restart file 'a=b:c'", "density 3 kg/m^3", "output_directory = \"it's\"", "periodic-x on", "= 4", "'a=b' = 3", "case = a'b'c'"]
    rows = cases.parse_cases(cases.case_lines(spark.createDataFrame([(1, "\n".join(lines))], "case_id long, text string"))).collect()
    got = {r.line_no: (r.kind, r.word if r.kind == "string" else r.value if r.kind == "quantity" else r.flag) for r in rows}
    assert got == {
        1: ("error", None), 2: ("error", None), 3: ("string", "a # b"), 4: ("error", None), 5: ("error", None), 6: ("quantity", 3.0), 7: ("string", "it's"),
        8: ("string", "-x on"), 9: ("error", None), 10: ("error", None), 11: ("error", None),
    }


def test_registered_units(spark):
    from tessera.sources import cases

    system = cases.UnitSystem().with_unit("ft", 0.3048, (1, 0, 0, 0)).with_unit("eV", 1.602176634e-19, (2, 1, -2, 0), prefixes=True).with_prefix("Ki", 3)
    text = "a = 10 ft\nb = 2 keV\nc = 2 kft\nd = 3 Kim\ne = 4 ft^2/s"
    rows = cases.parse_cases(cases.case_lines(spark.createDataFrame([(1, text)], "case_id long, text string")), units=system).collect()
    got = {r.name: (r.kind, r.value and round(r.value, 24), r.dims) for r in rows}
    assert got["a"] == ("quantity", 3.048, [1, 0, 0, 0]) and got["c"][0] == "error" and got["d"] == ("quantity", 3000.0, [1, 0, 0, 0])
    assert abs(got["b"][1] / 3.204353268e-16 - 1) < 1e-6 and got["b"][2] == [2, 1, -2, 0] and abs(got["e"][1] - 0.37161216) < 1e-12
    for bad in (lambda: system.with_unit("ft", 1.0, (1, 0, 0, 0)), lambda: system.with_prefix("k", 3), lambda: system.with_unit("x", 0.0, (0, 0, 0, 0)), lambda: system.with_prefix("", 1)):
        with pytest.raises(ValueError):
            bad()
