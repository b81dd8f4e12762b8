"""The configuration file: a closed JSON schema, found in the nearest folder above, overridden by options."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import replace

from treeledger.operators.gate import GateOptions, NewLimits, Tolerance

NAME = "treeledger.json"
DEFAULTS = {"top": 10, "includeTests": False, "failOnError": False, "minTokens": 40, "maxGapTokens": 30, "minSimilarityPercent": 70}
#: Allowed keys: bool, a least integer, or a section.
SCHEMA = {
    "duplication": {"minTokens": 1, "maxGapTokens": 0, "minSimilarityPercent": 0},
    "rank": {"top": 1},
    "gate": {
        "newFunction": {"maxCognitiveComplexity": 0, "maxNcss": 0, "maxNestingDepth": 0},
        "tolerance": {"cognitiveComplexity": 0, "ncss": 0, "nestingDepth": 0, "depDegree": 0, "halsteadVolume": 0, "fileNcss": 0, "duplicateLines": 0},
        "matchSimilarityPercent": 0,
    },
    "includeTests": bool,
    "failOnError": bool,
}
PERCENTS = {"minSimilarityPercent", "matchSimilarityPercent"}


class ConfigError(ValueError):
    """A configuration that can't be used; names the file and the key."""


def validate(found: object, file: str, schema: Mapping = SCHEMA, path: str = "") -> dict:
    """The same configuration, if every key is known and every value fits."""
    if not isinstance(found, dict):
        raise ConfigError(f"{file}: {path or 'the configuration'} must be an object")
    for key, value in found.items():
        at = f"{path}.{key}" if path else key
        if key not in schema:
            raise ConfigError(f"{file}: unknown key {at}")
        kind = schema[key]
        if isinstance(kind, Mapping):
            validate(value, file, kind, at)
        elif kind is bool:
            if not isinstance(value, bool):
                raise ConfigError(f"{file}: {at} must be true or false")
        elif isinstance(value, bool) or not isinstance(value, int) or value < kind or key in PERCENTS and value > 100:
            raise ConfigError(f"{file}: {at} must be an integer of at least {kind}" + (" and at most 100" if key in PERCENTS else ""))
    return found


def find(folder: str) -> str | None:
    """The configuration file of the nearest folder at or above."""
    folder = os.path.abspath(folder)
    while True:
        file = os.path.join(folder, NAME)
        if os.path.isfile(file):
            return file
        up = os.path.dirname(folder)
        if up == folder:
            return None
        folder = up


def load(path: str | None, folder: str) -> dict:
    """The named configuration, else the nearest one, else an empty one."""
    file = path or find(folder)
    if file is None:
        return {}
    try:
        with open(file, encoding="utf-8") as f:
            return validate(json.load(f), file)
    except OSError as e:
        raise ConfigError(f"{file}: {e.strerror}") from e
    except json.JSONDecodeError as e:
        raise ConfigError(f"{file}: not JSON: {e}") from e


def resolve(options: Mapping, config: Mapping) -> dict:
    """Options go before the configuration, and this before the defaults."""
    held = {**config.get("duplication", {}), **config.get("rank", {}), **{k: v for k, v in config.items() if not isinstance(v, Mapping)}}
    return {k: next(x for x in (options.get(k), held.get(k), default) if x is not None) for k, default in DEFAULTS.items()}


def gate_options(config: Mapping) -> GateOptions:
    """The gate's defaults with what the configuration sets."""
    gate = config.get("gate", {})
    new, tolerance = gate.get("newFunction", {}), gate.get("tolerance", {})
    limits = {"maxCognitiveComplexity": "cognitive", "maxNcss": "ncss", "maxNestingDepth": "nesting"}
    held = {"cognitiveComplexity": "cognitive", "ncss": "ncss", "nestingDepth": "nesting", "depDegree": "dep_degree", "halsteadVolume": "volume", "fileNcss": "file_ncss", "duplicateLines": "duplicate_lines"}
    base = GateOptions(replace(NewLimits(), **{limits[k]: v for k, v in new.items()}), replace(Tolerance(), **{held[k]: v for k, v in tolerance.items()}))
    return replace(base, similarity_percent=gate.get("matchSimilarityPercent", base.similarity_percent))
