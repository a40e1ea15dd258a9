"""Settings of a run: one area's box, domains, relations and ceilings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Config:
    """What differs between areas, and the parameters that all share."""

    box: tuple[float, float, float, float]
    ceiling_auc: float
    gate: float = 0.95
    seeds: tuple[int, ...] = (1, 2)
    folds: int = 5
    block_m: float = 10_000.0
    domains: tuple[tuple[str, tuple[str, ...]], ...] = ()
    relations: dict[str, tuple[float, float]] = field(default_factory=dict)
    excluded: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Config:
        """A JSON file at any path that Spark reads."""
        got = json.loads(spark.read.option("wholetext", True).text(path).head()["value"])
        got["domains"] = tuple((n, tuple(t)) for n, t in got.get("domains", []))
        for k in ("relations", "excluded"):
            got[k] = {n: tuple(v) for n, v in got.get(k, {}).items()}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})

    def dump(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def resolve(*choices: str | None, default: str) -> str:
    """The first choice that is given (argument, then setting), else ``default``."""
    return next((c for c in choices if c), default)


def predictors(columns: list[str], prefixes: tuple[str, ...], excluded: tuple[str, ...] = ()) -> list[str]:
    """The columns with one of ``prefixes``, in order, without the excluded ones; an unknown exclusion is an error."""
    found = [c for c in columns if c.startswith(prefixes)]
    unknown = sorted(set(excluded) - set(found))
    if unknown:
        raise ValueError(f"no such predictors: {', '.join(unknown)}")
    return [c for c in found if c not in excluded]


def provenance(spark: SparkSession, layers: list[tuple[str, str, float, str]]) -> DataFrame:
    """The table of layers: name, source, resolution in metres, date of access."""
    return spark.createDataFrame(layers, "layer string, source string, resolution_m double, accessed string")
