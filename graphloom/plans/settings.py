"""Settings of runs from a YAML file: an ``engine`` block, or the whole mapping."""

from __future__ import annotations

from graphloom.operators.visits import LIMITS, PRESETS
from graphloom.sources.json_files import InputError, require_path

SWITCHES = ("text_binding", "reentry", "verify_text", "verify_graph")


def read_settings(path: str) -> dict:
    """Switches, limits and method; what the file does not set is as in the preset it names (``core11`` if none)."""
    import yaml

    with open(require_path(path), encoding="utf-8") as f:
        told = yaml.safe_load(f)
    if not isinstance(told, dict):
        raise InputError(f"{path}: no mapping")
    return settings_of(told.get("engine", told), path)


def settings_of(told: dict, place: str = "settings") -> dict:
    if not isinstance(told, dict):
        raise InputError(f"{place}: no mapping")
    presets = {p[0]: p for p in PRESETS}
    preset = told.get("preset", "core11")
    if preset not in presets:
        raise InputError(f"{place}: unknown preset {preset}")
    out = {"preset": preset, "method": presets[preset][1], "revoke": None, **dict(zip(SWITCHES, presets[preset][2:])), **LIMITS}
    for name, value in told.items():
        if name not in out:
            raise InputError(f"{place}: unknown setting {name}")
        wanted = bool if name in SWITCHES else int if name in LIMITS else str
        if type(value) is not wanted or wanted is int and value < 0:
            raise InputError(f"{place}: {name} must be {'true or false' if wanted is bool else 'a number' if wanted is int else 'a text'}")
        out[name] = value
    return out
