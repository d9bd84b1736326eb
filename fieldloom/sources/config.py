"""Experiment and material settings: checked when read, their lists as small DataFrames."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class SettingsError(ValueError):
    pass


def _text(d: Mapping[str, Any], key: str) -> str:
    value = d.get(key)
    if not isinstance(value, str) or not value.strip():
        raise SettingsError(f"{key} must be a text that isn't empty")
    return value.strip()


def _whole(d: Mapping[str, Any], key: str) -> int:
    value = d.get(key)
    if isinstance(value, bool) or not isinstance(value, int):
        raise SettingsError(f"{key} must be a whole number")
    return value


def _number(value: Any, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise SettingsError(f"{name} must be a finite number")
    return float(value)


def _texts(d: Mapping[str, Any], key: str) -> tuple[str, ...]:
    found = d.get(key)
    if not isinstance(found, list) or not found or not all(isinstance(x, str) and x.strip() for x in found) or len(set(found)) < len(found):
        raise SettingsError(f"{key} must be a list of different texts")
    return tuple(found)


@dataclass(frozen=True)
class Site:
    name: str
    position: tuple[float, float, float]

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> Site:
        place = d.get("position")
        if not isinstance(place, list) or len(place) != 3:
            raise SettingsError("position must have three numbers")
        return cls(_text(d, "id"), tuple(_number(x, "position") for x in place))


@dataclass(frozen=True)
class Experiment:
    name: str
    num_frames: int
    dynamic_models: tuple[str, ...]
    frequency_hz: float
    tx: Site
    receivers: tuple[Site, ...]
    materials: tuple[str, ...]
    semantic_classes: tuple[str, ...]

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> Experiment:
        receivers = tuple(Site.of(x) for x in d.get("rx_list") or ())
        if not receivers or len({r.name for r in receivers}) < len(receivers):
            raise SettingsError("rx_list must have receivers of different names")
        frames = _whole(d, "num_frames")
        if frames < 1:
            raise SettingsError("num_frames must be positive")
        ghz = _number(d.get("frequency_ghz"), "frequency_ghz")
        return cls(_text(d, "experiment_name"), frames, _texts(d, "dynamic_models"), ghz * 1e9, Site.of(d.get("tx") or {}), receivers, _texts(d, "materials_of_interest"), _texts(d, "semantic_classes_of_interest"))

    def links(self, spark: SparkSession) -> DataFrame:
        """(rx_id, tx_x, tx_y, tx_z, rx_x, rx_y, rx_z)."""
        return spark.createDataFrame([(r.name, *self.tx.position, *r.position) for r in self.receivers], "rx_id string, tx_x double, tx_y double, tx_z double, rx_x double, rx_y double, rx_z double")


@dataclass(frozen=True)
class RadioMaterial:
    """itu: by name, with thickness; custom: with permittivity and conductivity at a frequency."""

    material_class: str
    itu_type: str | None
    thickness: float
    relative_permittivity: float | None = None
    conductivity: float | None = None
    scattering_coefficient: float = 0.0
    xpd_coefficient: float = 0.0

    @classmethod
    def of(cls, name: str, d: Mapping[str, Any], carrier_hz: float) -> RadioMaterial:
        kind, thickness = d.get("model"), _number(d.get("thickness"), f"{name}: thickness")
        if thickness <= 0:
            raise SettingsError(f"{name}: thickness must be positive")
        rest = {k: _number(d.get(k, 0.0), f"{name}: {k}") for k in ("scattering_coefficient", "xpd_coefficient")}
        if kind == "itu":
            return cls(name, _text(d, "itu_type"), thickness, **rest)
        if kind != "custom":
            raise SettingsError(f"{name}: model must be itu or custom")
        if "frequency_hz" in d and _number(d["frequency_hz"], f"{name}: frequency_hz") != carrier_hz:
            raise SettingsError(f"{name}: its values are for another frequency")
        return cls(name, None, thickness, *(_number(d.get(k), f"{name}: {k}") for k in ("relative_permittivity", "conductivity")), **rest)


@dataclass(frozen=True)
class RadioMaterials:
    carrier_hz: float
    materials: tuple[RadioMaterial, ...] = field(default=())

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> RadioMaterials:
        carrier = _number((d.get("metadata") or {}).get("carrier_frequency_hz"), "carrier_frequency_hz")
        return cls(carrier, tuple(RadioMaterial.of(k, v, carrier) for k, v in (d.get("materials") or {}).items()))

    def table(self, spark: SparkSession) -> DataFrame:
        columns = "material_class string, itu_type string, relative_permittivity double, conductivity double, thickness double, scattering_coefficient double, xpd_coefficient double"
        return spark.createDataFrame([(m.material_class, m.itu_type, m.relative_permittivity, m.conductivity, m.thickness, m.scattering_coefficient, m.xpd_coefficient) for m in self.materials], columns)


def read_settings(spark: SparkSession, path: str) -> dict[str, Any]:
    """One small JSON document, through Spark's reader, wherever it is."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise SettingsError(f"{path} isn't one document")
    try:
        found = json.loads(rows[0].value)
    except ValueError as e:
        raise SettingsError(f"{path}: {e}") from e
    if not isinstance(found, dict):
        raise SettingsError(f"{path} holds no object")
    return found


def receiver_suffix(receivers: tuple[str, ...]) -> str:
    """Part of an output's name that tells which receivers it is about."""
    if not receivers:
        return "all_rx"
    return "_".join(r.removeprefix("rx_").removesuffix("_base").lower() for r in receivers)


def output_name(target: str, mode: str, receivers: tuple[str, ...] = (), models: tuple[str, ...] = ("logistic",)) -> str:
    tail = "" if models == ("logistic",) else "_models_" + "_".join(models)
    return f"ablation_{target}_{mode}_{receiver_suffix(receivers)}{tail}.csv"
