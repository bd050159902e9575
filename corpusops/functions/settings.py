"""Settings of a run on the driver: typed values, nested tables of them, safe paths, names of averaged weights."""

from __future__ import annotations

import dataclasses
import os
import posixpath
import types
import typing
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def optional_count(value: object, name: str) -> int | None:
    """None, or a whole number of at least 1 given as a number or text."""
    if value is None or (isinstance(value, str) and value.strip().lower() in ("", "none", "null")):
        return None
    number = float(value) if not isinstance(value, bool) else 0.0
    if number < 1 or number != int(number):
        raise ValueError(f"{name} must be a whole number of at least 1 or nothing")
    return int(number)


def coerced(text: str, kind: object) -> object:
    """A literal as the declared type: bool, int, float, str, list of one of them, or one of them or None."""
    options = typing.get_args(kind) if isinstance(kind, types.UnionType) else ()
    if options:
        if type(None) in options and text.strip().lower() in ("none", "null"):
            return None
        return coerced(text, next(o for o in options if o is not type(None)))
    if typing.get_origin(kind) is list:
        inner = typing.get_args(kind)[0]
        return [coerced(x.strip(), inner) for x in text.strip().strip("[]").split(",") if x.strip()]
    if kind is bool:
        known = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}
        if text.strip().lower() not in known:
            raise ValueError(f"no truth value: {text}")
        return known[text.strip().lower()]
    return kind(text)


def parsed(kind: type, values: Mapping, removed: tuple[str, ...] = (), overrides: Mapping[str, str] | None = None, where: str = ""):
    """A dataclass from nested mappings; unknown and removed fields raise ValueError, overrides are 'a.b' -> literal."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    gone, unknown = sorted(set(values) & set(removed)), sorted(set(values) - set(fields) - set(removed))
    if gone or unknown:
        raise ValueError(f"removed fields {gone}, unknown fields {unknown} in {where or kind.__name__}")
    hints, out = typing.get_type_hints(kind), dict(values)
    for name, hint in hints.items():
        if dataclasses.is_dataclass(hint) and name in out:
            own = {k.split(".", 1)[1]: v for k, v in (overrides or {}).items() if k.startswith(name + ".")}
            out[name] = parsed(hint, out[name], removed, own, name)
    for path, text in (overrides or {}).items():
        if "." not in path:
            if path not in fields:
                raise ValueError(f"no such field: {path}")
            out[path] = coerced(text, hints[path])
    return kind(**out)


def cache_root(given: str, variable: str) -> str:
    """The folder given, or the one that the environment variable names."""
    return os.environ.get(variable) or given


def beneath(path: object, name: str) -> str:
    """A normalised relative path; absolute ones and those that leave their root raise ValueError."""
    if not isinstance(path, str) or not path.strip():
        raise ValueError(f"{name} must be a relative path")
    clean = posixpath.normpath(path.strip())
    if clean.startswith("/") or clean.split("/")[0] == "..":
        raise ValueError(f"{name} must not leave its root")
    return clean


def decay_key(decay: float) -> str:
    """The name of a decay: its shortest form of twelve digits."""
    return f"{float(decay):.12g}"


def decay_label(key: str | None) -> str:
    """'raw' for no average, else 'ema' and the key with p for the point."""
    return "raw" if key is None else f"ema{key}".replace(".", "p")


def decay_keys(text: str | None) -> list[str | None] | None:
    """Keys of a comma-separated list; 0 stands for the weights themselves."""
    if text is None:
        return None
    numbers = [float(x) for x in text.split(",")]
    return [decay_key(x) if x else None for x in numbers]


def pad_id(pad: int | None, eos: int | None, use_eos: bool) -> int:
    """The id that fills rows; ValueError when the vocabulary has none."""
    found = eos if use_eos else pad
    if found is None:
        raise ValueError("the vocabulary has no id for padding")
    return found


def tables_of(spark: SparkSession, listed: list[Mapping[str, str]]) -> dict[str, DataFrame]:
    """name -> table for a list of {name, path}; a name given twice raises ValueError."""
    names = [x["name"] for x in listed]
    if len(set(names)) < len(names):
        raise ValueError("a table is named twice")
    return {x["name"]: spark.read.parquet(x["path"]) for x in listed}
