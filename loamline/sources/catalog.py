"""Registry of data files, settings, and the catalog as a table."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..params import SCENARIOS


@dataclass(frozen=True)
class Settings:
    """Settings from a YAML file; nothing is read before load() is called."""

    depth_target_m: float = 1.0
    time_resolution: str = "monthly"
    target_calendar: str = "proleptic_gregorian"
    ssi: dict[str, Any] = field(default_factory=dict)
    grid: str | None = None

    @classmethod
    def load(cls, path: str) -> Settings:
        import yaml

        with open(path) as f:
            given = yaml.safe_load(f) or {}
        known = {k: given[k] for k in cls.__dataclass_fields__ if k in given}
        if "depth_target_m" in known:
            known["depth_target_m"] = float(known["depth_target_m"])
        return cls(**known)


class Registry:
    """Raw and processed paths by model and scenario. Paths are never guessed; missing ones raise."""

    def __init__(self, paths: dict, models: dict | None = None, processed: dict | None = None):
        if not paths:
            raise KeyError("the registry has no 'paths'")
        self.paths, self.models, self.done = paths, models or {}, processed or {}

    @classmethod
    def load(cls, path: str) -> Registry:
        import yaml

        with open(path) as f:
            given = yaml.safe_load(f) or {}
        return cls(given.get("paths", {}), given.get("models", {}), (given.get("processed") or {}).get("models_1m", {}))

    def raw(self, model: str, scenario: str) -> str:
        path = self._of(self.models, model, scenario)
        if not os.path.exists(path):
            raise FileNotFoundError(f"no raw file {path}")
        return path

    def processed(self, model: str, scenario: str, make_parent: bool = True) -> str:
        path = self._of(self.done, model, scenario)
        if make_parent:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return path

    @staticmethod
    def _of(table: dict, model: str, scenario: str) -> str:
        if scenario not in table.get(model, {}):
            raise KeyError(f"the registry has no {model}, {scenario}")
        return table[model][scenario]

    def list_models(self) -> dict:
        return self.models

    @staticmethod
    def scenarios() -> tuple[str, ...]:
        return SCENARIOS

    def variable(self, model: str) -> str:
        return self.models.get(model, {}).get("variable", "soilmoist")

    def table(self, spark: SparkSession) -> DataFrame:
        """model, scenario, climate, soc, variable, raw_path, out_path."""
        rows = [(m, s, *s.split("_"), self.variable(m), self.models[m][s], self.done.get(m, {}).get(s)) for m in self.models for s in SCENARIOS if s in self.models[m]]
        return spark.createDataFrame(rows, "model string, scenario string, climate string, soc string, variable string, raw_path string, out_path string")


def one_match(names: list[str], model: str, scenario_part: str) -> str:
    """The one file of a folder whose name begins with the model and holds the scenario; raises unless there is exactly one."""
    found = [n for n in names if n.startswith(model) and f"_{scenario_part}" in n]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files for {model}, {scenario_part}")
    return found[0]
