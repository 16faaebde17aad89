"""A sample extract and a sample model as files, made where they are asked for (the repository holds no data)."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession

from . import eventcsv
from .synth import SynthConfig, simulate


def paths(spark: SparkSession, folder: str, cases: int = 1500) -> dict[str, str]:
    """Paths of events, cases (CSV) and a tabular model (TMSL) in folder; written on the first call."""
    from ..plans.sample_model import MODEL

    out = {"events": os.path.join(folder, "events.csv"), "cases": os.path.join(folder, "cases.csv"), "model": os.path.join(folder, "model.bim")}
    if not all(os.path.exists(p) for p in out.values()):
        events, made = simulate(spark, SynthConfig(cases=cases))
        eventcsv.write_events(events, out["events"])
        eventcsv.write_cases(made, out["cases"])
        with open(out["model"], "w", encoding="utf-8") as f:
            json.dump(MODEL, f)
    return out
