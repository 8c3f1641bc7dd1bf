"""Physical rules: what a stated case implies, what is wrong with it and what is worth a warning.

All rules are column expressions over one row a case, so that any number of cases takes one pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import near, normal_name
from tessera.sources.builtins import MODELS, model_names

#: Columns that ``complete`` reads.
CASE_COLUMNS = [
    "density", "dynamic_viscosity", "kinematic_viscosity", "reynolds_number", "characteristic_velocity", "characteristic_length", "grid_spacing", "relaxation_time",
    "relaxation_frequency", "lattice_characteristic_velocity", "mach_number", "time_step", "max_steps", "physical_time",
]
_NEEDED = ["density", "kinematic_viscosity", "characteristic_velocity", "characteristic_length", "relaxation_time", "max_steps"]
_SOUND_SQUARED = 1 / 3
_MOST_STEPS = 2.0**63


def _stated(name: str) -> Column:
    return F.col(f"_{name}")


def _positive(value: Column) -> Column:
    """Finite and above 0; NaN is above all numbers in Spark."""
    return (value > 0) & (value < float("inf"))


def _all_positive(names: Iterable[str]) -> list[Column]:
    return [F.when(~_positive(_stated(n)), f"{n} must be finite and above 0") for n in names]


def _count(*names: str) -> Column:
    return sum((_stated(n).isNotNull().cast("int") for n in names[1:]), _stated(names[0]).isNotNull().cast("int"))


def _finite(names: Iterable[str]) -> list[Column]:
    """What follows must be a number too: a quotient by 0 is null, one of huge numbers infinite."""
    return [F.when(F.col(n).isNull() | ~F.col(n).between(-1.7976931348623157e308, 1.7976931348623157e308), f"{n} does not follow as a finite number") for n in names]


def _against(name: str, derived: Column, redundant: bool) -> Column:
    """A stated value beside a derived one: a warning where they differ and, if asked, where they do not."""
    differs = F.when(~near(_stated(name), derived), f"{name} is inconsistent")
    return F.when(_stated(name).isNotNull(), differs.otherwise(f"{name} is redundant") if redundant else differs)


def complete(cases: DataFrame) -> DataFrame:
    """Fills what follows from what is stated, with ``error``, ``warnings array<string>`` and ``missing array<string>``.

    Fluid: any two of density, dynamic and kinematic viscosity; the kinematic one gives way to the
    other two.  Scales: any three of Reynolds number, characteristic velocity, length and kinematic
    viscosity; the velocity gives way.  Lattice, with grid_spacing: the first of relaxation time,
    frequency, lattice velocity, Mach number and time step that is stated; the rest follows and gives
    way.  Control: max_steps, or as many steps as physical_time needs.

    ``error`` is the first rule that is broken, in this order; such a case has no warnings, and its columns
    hold what follows as far as it does.  Null is not stated.  Extra columns stay as they are, but for names that begin with
    an underscore and one of CASE_COLUMNS.
    """
    c, s = F.col, _stated
    out = cases.withColumns({f"_{n}": c(n).cast("double") for n in CASE_COLUMNS})
    out = out.withColumn("kinematic_viscosity", F.coalesce(F.try_divide(s("dynamic_viscosity"), s("density")), s("kinematic_viscosity")))
    nu = c("kinematic_viscosity")
    out = out.withColumns({"density": F.coalesce(s("density"), F.try_divide(s("dynamic_viscosity"), nu)), "dynamic_viscosity": F.coalesce(s("dynamic_viscosity"), s("density") * nu)})
    re, u, length = s("reynolds_number"), s("characteristic_velocity"), s("characteristic_length")
    out = out.withColumns(
        {
            "characteristic_velocity": F.coalesce(F.try_divide(re * nu, length), u),
            "reynolds_number": F.coalesce(re, F.try_divide(u * length, nu)),
            "characteristic_length": F.coalesce(length, F.try_divide(re * nu, u)),
        }
    )
    re, u, dx = c("reynolds_number"), c("characteristic_velocity"), s("grid_spacing")
    out = out.withColumn("_cells", F.try_divide(c("characteristic_length"), dx))
    tau, omega, lattice_u, mach, step = (s(n) for n in ("relaxation_time", "relaxation_frequency", "lattice_characteristic_velocity", "mach_number", "time_step"))
    by_relaxation = F.coalesce(tau, F.when(tau.isNull(), F.try_divide(F.lit(1.0), omega)))
    seed = F.when(tau.isNull() & omega.isNull(), F.coalesce(lattice_u, mach * F.sqrt(F.lit(_SOUND_SQUARED)), F.try_divide(u * step, dx)))
    out = out.withColumn("_seed", seed)
    out = out.withColumn("relaxation_time", F.coalesce(by_relaxation, F.try_divide(c("_seed") * c("_cells"), re) / _SOUND_SQUARED + 0.5))
    found = F.coalesce(c("_seed"), F.try_divide(re * (_SOUND_SQUARED * (c("relaxation_time") - 0.5)), c("_cells")))
    out = out.withColumns({"relaxation_frequency": F.try_divide(F.lit(1.0), c("relaxation_time")), "lattice_characteristic_velocity": found})
    found = c("lattice_characteristic_velocity")
    out = out.withColumns({"mach_number": found / F.sqrt(F.lit(_SOUND_SQUARED)), "time_step": F.try_divide(dx * found, u)})
    raw = F.try_divide(s("physical_time"), c("time_step"))
    rounded = F.when(raw.between(0, _MOST_STEPS), F.ceil(raw).cast("double"))
    out = out.withColumn("max_steps", F.coalesce(F.round(s("max_steps")), rounded))
    out = out.withColumn("physical_time", c("max_steps") * c("time_step"))

    fluid, lattice = ("density", "dynamic_viscosity", "kinematic_viscosity"), ("relaxation_time", "relaxation_frequency", "lattice_characteristic_velocity", "mach_number", "time_step")
    scales = ("reynolds_number", "characteristic_length", "characteristic_velocity")
    no_relaxation = s("relaxation_time").isNull() & s("relaxation_frequency").isNull()
    uneven = F.abs(s("max_steps") - F.round(s("max_steps"))) > 1e-10
    errors = [
        F.when(_count(*fluid) < 2, "two of density, dynamic_viscosity and kinematic_viscosity are needed"), *_all_positive(fluid), *_finite(fluid),
        F.when(_count(*scales) < 2, "two of reynolds_number, characteristic_length and characteristic_velocity are needed"), *_all_positive(scales), *_finite(scales),
        F.when(s("grid_spacing").isNull(), "grid_spacing is needed"), *_all_positive(["grid_spacing"]),
        *(F.when(~_positive(c(n)), f"{n} must be finite and above 0") for n in scales),
        F.when(_count(*lattice) == 0, "one of " + ", ".join(lattice[:-1]) + " and time_step is needed"),
        F.when(~(s("relaxation_time") > 0.5), "relaxation_time must be above 0.5"),
        F.when(s("relaxation_time").isNull() & ~((s("relaxation_frequency") > 0) & (s("relaxation_frequency") < 2)), "relaxation_frequency must lie between 0 and 2"),
        F.when(no_relaxation & ~_positive(c("_seed")), "lattice_characteristic_velocity must be finite and above 0"),
        F.when(~(c("relaxation_time") > 0.5), "relaxation_time does not follow above 0.5"), *_finite(lattice),
        F.when(~_positive(c("time_step")), "time_step must be finite and above 0"),
        F.when(_count("physical_time", "max_steps") == 0, "physical_time or max_steps is needed"), *_all_positive(["max_steps"]),
        F.when(uneven, "max_steps must be an integer"), *_all_positive(["physical_time"]), F.when(~(c("max_steps") < _MOST_STEPS) | c("max_steps").isNull(), "max_steps is out of range"),
    ]
    preferred = s("reynolds_number").isNotNull() & s("characteristic_length").isNotNull()
    by_steps = s("max_steps").isNotNull()
    warnings = [
        F.when(s("density").isNotNull() & s("dynamic_viscosity").isNotNull(), _against("kinematic_viscosity", nu, True)),
        F.when(s("dynamic_viscosity").isNull(), "density is usual with dynamic_viscosity"),
        F.when(s("density").isNull(), "dynamic_viscosity is usual with density"),
        F.when(preferred, _against("characteristic_velocity", u, True)).otherwise("reynolds_number and characteristic_length are preferred"),
        F.when(s("relaxation_time").isNotNull(), _against("relaxation_frequency", c("relaxation_frequency"), True)).when(s("relaxation_frequency").isNotNull(), "relaxation_time is preferred")
        .when(s("lattice_characteristic_velocity").isNotNull(), "lattice_characteristic_velocity usually follows").when(s("mach_number").isNotNull(), "mach_number usually follows")
        .otherwise("time_step usually follows"),
        *(_against(n, c(n), False) for n in ("lattice_characteristic_velocity", "mach_number", "time_step")),
        F.when(by_steps, _against("physical_time", c("physical_time"), True)).when(~near(s("physical_time"), c("physical_time")), "physical_time is raised to whole steps"),
        F.when(c("mach_number") > 0.1, "mach_number above 0.1"),
        F.when(c("relaxation_time") < 0.55, "relaxation_time below 0.55"),
        F.when(c("relaxation_time") > 2, "relaxation_time above 2"),
    ]
    out = out.withColumn("error", F.coalesce(*errors))
    none = F.array().cast("array<string>")
    return out.withColumns(
        {"warnings": F.when(c("error").isNull(), F.array_compact(F.array(*warnings))).otherwise(none), "missing": F.array_compact(F.array(*(F.when(c(n).isNull(), n) for n in _NEEDED)))}
    ).drop(*(f"_{n}" for n in CASE_COLUMNS), "_cells", "_seed")


def with_models(cases: DataFrame) -> DataFrame:
    """Canonical spellings of the models that a case names, and ``model_error``: a needed one that is not stated, or one that is unknown (null then)."""
    known = {p: F.create_map(*(F.lit(x) for pair in model_names(p).items() for x in pair))[normal_name(F.trim(F.col(p)))] for p in MODELS}
    needed = [F.when(F.col(p).isNull(), f"{p} is needed") for p in ("lattice_model", "collision_model")]
    unknown = [F.when(F.col(p).isNotNull() & model.isNull(), F.concat(F.lit(f"{p} is unknown: "), F.col(p))) for p, model in known.items()]
    return cases.withColumn("model_error", F.coalesce(*needed, *unknown)).withColumns(known)
