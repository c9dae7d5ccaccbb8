"""The whole analysis of a scan: noise, ground, terrain, objects, quality."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import ground, noise, objects, quality, terrain
from ..operators.quality import Frame
from ..storage import settled

STEPS = ("noise", "ground", "terrain", "objects", "quality")


@dataclass
class Analysis:
    """points with all labels so far, the results of each step, and why a step failed."""

    points: DataFrame
    results: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def analyze(points: DataFrame, steps: tuple[str, ...] = STEPS, checkpoints: DataFrame | None = None, cell: float = 1.0) -> Analysis:
    """Runs the steps in order; one that fails is noted and does not stop the rest.

    A ground run makes older objects and terrain void, a noise run does not.
    """
    if unknown := set(steps) - set(STEPS):
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
    out = Analysis(points)
    for step in (s for s in STEPS if s in steps):
        try:
            _run(out, step, checkpoints, cell)
        except Exception as e:  # a step's failure is a result
            out.errors[step] = f"{type(e).__name__}: {e}"[:500]
    return out


def _run(a: Analysis, step: str, checkpoints: DataFrame | None, cell: float) -> None:
    if step == "noise":
        before = a.points
        a.points = settled(noise.detect_noise(before))
        a.results["noise"] = noise.noise_stats(before, a.points)
    elif step == "ground":
        a.points = settled(ground.detect_ground(a.points.drop("object_id"), ground.GroundOptions(cell=cell)))
        for stale in ("terrain", "contours", "objects", "inventory"):
            a.results.pop(stale, None)
        a.results["ground"] = ground.ground_stats(a.points)
    elif step == "terrain":
        frame = Frame.of(a.points, cell)
        model = settled(terrain.terrain_model(a.points, frame))
        a.results["terrain"] = model
        a.results["contours"] = terrain.contours(model.selectExpr("row", "col", "elevation AS value"), frame)
    elif step == "objects":
        own = a.points
        if "height_above_ground" not in own.columns:
            own = ground.height_above_classified_ground(own) or ground.detect_ground(own)
        a.points, a.results["objects"] = objects.detect_objects(settled(own))
        a.results["inventory"] = objects.inventory(a.results["objects"])
    else:
        frame = Frame.of(a.points, cell)
        report = quality.quality_report(a.points, frame, checkpoints)
        a.results["quality"], a.results["strips"] = report.checks, report.pairs
        for part in ("density", "coverage", "precision", "overlap", "noise", "classes", "returns", "accuracy"):
            if (table := getattr(report, part)) is not None:
                a.results[f"quality_{part}" if part in ("noise", "classes", "returns") else part] = table
