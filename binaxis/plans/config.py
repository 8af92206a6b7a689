"""Parameters of a run, read from a YAML file or given as a dict."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field, fields, replace


def _from(first: int) -> list[str]:
    return [f"chr{k}" for k in range(first, 23)]


# Chromosomes whose dense matrix the spectral caller may hold, by resolution; and the defaults of Config.
SPECTRAL_LIMITS = {10_000: _from(21), 25_000: _from(17), 50_000: _from(1), 100_000: _from(1)}


@dataclass(frozen=True)
class Config:
    resolutions: tuple[int, ...] = (25000,)
    chromosomes: tuple[str, ...] = ()
    algorithms: tuple[str, ...] = ("armatus", "topdom", "scktld", "coitad", "dihmm", "ontad", "modularity_tad")
    limits: dict = field(default_factory=lambda: {"scktld": dict(SPECTRAL_LIMITS)})  # algorithm -> {resolution: [chromosomes]}
    windows: tuple[int, ...] = (3, 5, 10)
    gammas: tuple[float, ...] = (0.1, 0.3, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9, 1.0, 2.0)
    least_windows: int = 100
    dimensions: int = 32
    insulation_window: int | None = None
    sigma: float = 1.5
    prominence: float = 0.2
    min_tad_kb: int = 100
    max_tad_kb: int = 5000
    max_distance_mb: float = 5.0
    penalty: float | None = None
    di_window: int = 10
    hmm_rounds: int = 100
    min_bins: int = 3
    hierarchies: str | None = None  # glob of hierarchy files of an external caller
    tolerance_bins: int = 1
    min_support: int = 2
    reference_tolerances: tuple[int, ...] = (1, 2)
    window_bins: int = 1
    permutations: int = 1000
    profile_reach: int = 500_000
    profile_step: int = 10_000

    @classmethod
    def of(cls, values: dict) -> Config:
        """From flat values; unknown names are refused, lists become tuples."""
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def _scalar(text: str):
    if text in ("null", "~", ""):
        return None
    if text in ("true", "false"):
        return text == "true"
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()] if text[:1] == "[" else text


def parse_yaml(text: str) -> dict:
    """The part of YAML that parameter files use: nested maps by indentation, scalars, flow lists; comments are dropped."""
    root: dict = {}
    levels: list[tuple[int, dict]] = [(-1, root)]
    lines, open_ = [], ""
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        open_ = f"{open_} {line.strip()}" if open_ else line
        if open_.count("[") == open_.count("]"):
            if open_.strip():
                lines.append(open_)
            open_ = ""
    for line in lines:
        indent, (key, _, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
        while levels[-1][0] >= indent:
            levels.pop()
        key = _scalar(key.strip())
        if value.strip():
            levels[-1][1][key] = _scalar(value.strip())
        else:
            levels[-1][1][key] = {}
            levels.append((indent, levels[-1][1][key]))
    return root


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return parse_yaml(f.read())
