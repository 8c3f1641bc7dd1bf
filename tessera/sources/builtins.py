"""The parameters that a case may state, their other names and the names of models."""

from __future__ import annotations

NONE, LENGTH, TIME, VELOCITY = (0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0), (1, 0, -1, 0)
DENSITY, DYNAMIC_VISCOSITY, KINEMATIC_VISCOSITY = (-3, 1, 0, 0), (-1, 1, -1, 0), (2, 0, -1, 0)

#: Parameters (fixed values): name, kind, exponents of length, mass, time and temperature, other names.
PARAMETERS = [
    ("case_name", "string", NONE, ["case"]),
    ("precision", "string", NONE, ["floating point precision"]),
    ("geometry_file", "string", NONE, ["geometry", "mesh", "mesh file", "stl", "stl file"]),
    ("restart_file", "string", NONE, ["restart", "checkpoint file"]),
    ("density", "quantity", DENSITY, ["rho", "reference density"]),
    ("dynamic_viscosity", "quantity", DYNAMIC_VISCOSITY, ["viscosity", "mu"]),
    ("kinematic_viscosity", "quantity", KINEMATIC_VISCOSITY, ["nu"]),
    ("characteristic_length", "quantity", LENGTH, ["reference length"]),
    ("characteristic_velocity", "quantity", VELOCITY, ["reference velocity"]),
    ("reynolds_number", "quantity", NONE, ["re", "reynolds"]),
    ("physical_time", "quantity", TIME, ["total physical time", "end time"]),
    ("restart_time", "quantity", TIME, ["checkpoint time"]),
    ("time_step", "quantity", TIME, ["physical time step", "dt"]),
    ("grid_spacing", "quantity", LENGTH, ["minimum grid spacing", "minimum lattice spacing", "lattice spacing", "grid resolution", "dx"]),
    ("periodic_x", "bool", NONE, ["x periodic"]),
    ("periodic_y", "bool", NONE, ["y periodic"]),
    ("periodic_z", "bool", NONE, ["z periodic"]),
    ("symmetric_x", "bool", NONE, ["symmetry x", "x symmetric", "x symmetry"]),
    ("symmetric_y", "bool", NONE, ["symmetry y", "y symmetric", "y symmetry"]),
    ("symmetric_z", "bool", NONE, ["symmetry z", "z symmetric", "z symmetry"]),
    ("lattice_model", "string", NONE, ["lattice", "velocity set"]),
    ("collision_model", "string", NONE, ["collision", "collision operator"]),
    ("relaxation_time", "quantity", NONE, ["lattice relaxation time", "tau"]),
    ("relaxation_frequency", "quantity", NONE, ["lattice relaxation frequency", "omega"]),
    ("lattice_characteristic_velocity", "quantity", NONE, ["lattice velocity", "u lat"]),
    ("mach_number", "quantity", NONE, ["mach", "ma"]),
    ("number_of_levels", "quantity", NONE, ["num levels", "levels", "nlevels"]),
    ("wall_boundary", "string", NONE, ["wall", "wall boundary model"]),
    ("inlet_boundary", "string", NONE, ["inlet", "inlet boundary model"]),
    ("outlet_boundary", "string", NONE, ["outlet", "outlet boundary model"]),
    ("max_steps", "quantity", NONE, ["maximum steps", "number of steps", "num steps", "nsteps"]),
    ("output_directory", "string", NONE, ["output dir", "result directory"]),
    ("output_interval", "quantity", TIME, ["output time interval", "write interval"]),
    ("checkpoint_interval", "quantity", TIME, ["checkpoint time interval", "restart interval"]),
]
_PORTS = {
    "Default": ["default", "standard"],
    "ZouHeVelocity": ["zouhevelocity", "zou he velocity", "zh vel", "zh velocity"],
    "ZouHePressure": ["zouhepressure", "zou he pressure", "zh pre", "zh pressure"],
}
#: Models (fixed values) by the parameter that names them: canonical spelling and the names it goes by.
MODELS = {
    "lattice_model": {"D2Q9": ["d2q9"], "D3Q15": ["d3q15"], "D3Q19": ["d3q19"], "D3Q27": ["d3q27"]},
    "collision_model": {"BGK": ["bgk"], "MRT": ["mrt"], "TRT": ["trt"], "Cascaded": ["cascaded", "central moment", "cm"], "Cumulant": ["cumulant"]},
    "wall_boundary": {"InterpolatedBB": ["interpolatedbb", "interpolated bb", "interpolated bounce back", "ibb"], "IBM": ["ibm", "immersed", "immersed boundary"]},
    "inlet_boundary": _PORTS,
    "outlet_boundary": _PORTS,
}


def _unique(pairs: list[tuple[str, str]]) -> dict[str, str]:
    found: dict[str, str] = {}
    for alias, name in pairs:
        if found.setdefault(alias, name) != name:
            raise ValueError(f"{alias} names both {found[alias]} and {name}")
    return found


def parameter_names() -> dict[str, str]:
    """The parameter that a normalised name stands for; every name may also be written as one word."""
    phrases = [(p.replace(" ", "_"), name) for name, _, _, others in PARAMETERS for p in (name, *others)]
    return _unique([*phrases, *((p.replace("_", ""), name) for p, name in phrases)])


def model_names(parameter: str) -> dict[str, str]:
    """The model that a normalised name stands for."""
    return _unique([(p.replace(" ", "_"), model) for model, names in MODELS[parameter].items() for p in names])
