"""Settings of an analysis, from YAML, checked and completed with defaults."""

from __future__ import annotations

import copy
import os

SEVERITIES = ("critical", "error", "info", "warning")
DEFAULTS = {
    "size": {"max_file_lines": 500, "max_function_lines": 80, "enabled": True, "severity": "warning"},
    "god_object": {"max_fields": 15, "max_methods": 10, "enabled": True, "severity": "warning", "exclude": ["internal/"]},
    "rules": {"enable_size_rule": True, "enable_god_object_rule": True, "enable_circular_rule": True, "enable_layer_rule": True},
    "weights": {"circular": 10.0, "layer": 5.0, "size": 3.0, "god_object": 5.0},
    "language_detection": {"weights": dict.fromkeys(("TypeScript", "Python", "JavaScript", "Go"), 1.0), "tie_break_order": ["Python", "TypeScript", "JavaScript", "Go"], "segment_weights": {"src": 1.0, "pkg": 1.0, "app": 1.0, "scripts": 0.2, "tools": 0.2}},
}


class ConfigError(ValueError):
    pass


def _check(cfg: dict) -> None:
    if extra := set(cfg) - set(DEFAULTS):
        raise ConfigError(f"unknown settings: {', '.join(sorted(extra))}")
    for part, values in cfg.items():
        if values is not None and not isinstance(values, dict):
            raise ConfigError(f"{part} must hold settings")
    for part in ("size", "god_object"):
        severity = (cfg.get(part) or {}).get("severity")
        if severity and severity not in SEVERITIES:
            raise ConfigError(f"{part}: no severity {severity!r}; there are {', '.join(SEVERITIES)}")
    for name, value in (cfg.get("weights") or {}).items():
        if value is not None and value < 0:
            raise ConfigError(f"weights: {name} is below 0")
    detection = cfg.get("language_detection") or {}
    if extra := set(detection) - set(DEFAULTS["language_detection"]):
        raise ConfigError(f"unknown settings in language_detection: {', '.join(sorted(extra))}")
    for part, top in (("weights", 100), ("segment_weights", 10)):
        for name, value in (detection.get(part) or {}).items():
            if not str(name).strip() or not 0 <= value <= top:
                raise ConfigError(f"language_detection.{part}: {name!r} needs a name and a value from 0 to {top}")
    if any(not str(x).strip() for x in detection.get("tie_break_order") or []):
        raise ConfigError("language_detection.tie_break_order has an empty name")


def completed(cfg: dict) -> dict:
    """Zero, empty and missing values take the default; maps and lists are taken whole; false stays false."""
    _check(cfg)
    out = copy.deepcopy(DEFAULTS)
    for part, values in cfg.items():
        if values is None:
            continue
        if part == "god_object":
            out[part]["exclude"] = values.get("exclude") or []
        for name, value in values.items():
            if value or value is False or (part == "language_detection" and value == {}):
                out[part][name] = value
    return out


def load(path: str) -> dict:
    """A missing file gives the defaults."""
    if not os.path.exists(path):
        return completed({})
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except yaml.YAMLError as error:
        raise ConfigError(f"{path} is not YAML: {error}") from error
    if found is not None and not isinstance(found, dict):
        raise ConfigError(f"{path} must hold settings")
    return completed(found or {})


def save(cfg: dict, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(cfg, f, sort_keys=False)
