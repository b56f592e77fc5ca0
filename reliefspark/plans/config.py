"""Configurations: JSON read, completed and checked."""

from __future__ import annotations

import json
import os

from reliefspark.functions import metrics
from reliefspark.grid import UNITS
from reliefspark.operators import processing
from reliefspark.operators.classify import check_classes, complete_ranges

METHODS = "alti-diff"
LAYER_KINDS = ("segmentation", "slope", "fusion", "global")


def read(path: str) -> dict:
    """The configuration of a JSON file; relative paths of inputs that lie beside it become absolute."""
    with open(path, encoding="utf-8") as f:
        cfg = json.load(f)
    folder = os.path.dirname(os.path.abspath(path))
    for name in ("input_ref", "input_sec"):
        for part in [cfg.get(name), (cfg.get(name) or {}).get("geoid"), *((cfg.get(name) or {}).get("classification_layers") or {}).values()]:
            for key in ("path", "map_path"):
                if part and key in part and os.path.exists(os.path.join(folder, part[key])):
                    part[key] = os.path.join(folder, part[key])
    return cfg


def check_coregistration(cfg: dict) -> dict:
    out = {"method_name": "nuth_kaab_internal", "number_of_iterations": 6, "sampling_source": "sec", "estimated_initial_shift_x": 0, "estimated_initial_shift_y": 0, "save_optional_outputs": False, **cfg}
    n = out["number_of_iterations"]
    if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= 15:
        raise ValueError("number_of_iterations is an integer from 1 to 15")
    if out["sampling_source"] not in ("sec", "ref"):
        raise ValueError("sampling_source is sec or ref")
    for k in ("estimated_initial_shift_x", "estimated_initial_shift_y"):
        if not isinstance(out[k], (int, float)) or isinstance(out[k], bool):
            raise TypeError(f"{k} is a number")
    if out["save_optional_outputs"] and not out.get("output_dir"):
        raise ValueError("save_optional_outputs needs output_dir")
    return out


def check_metrics(items: list) -> None:
    """KeyError for an unknown metric; ValueError for thresholds that are missing where parameters are given."""
    for m in items:
        name, more = (m, {}) if isinstance(m, str) else next(iter(m.items()))
        metrics.kind(name)
        if name == "ratio_above_threshold" and (set(more) - {"remove_outliers"}) and "elevation_threshold" not in more:
            raise ValueError("ratio_above_threshold needs elevation_threshold")


def check_layers(layers: dict) -> dict:
    for name, layer in layers.items():
        kind = layer.get("type")
        if kind not in LAYER_KINDS:
            raise KeyError(f"no classification layer of type {kind}")
        if kind == "segmentation":
            check_classes(layer.get("classes", {}))
        if kind == "slope":
            complete_ranges(layer.get("ranges", [0]))
        if kind == "fusion":
            given = {s: layer[s] for s in ("ref", "sec") if layer.get(s)}
            missing = [x for fused in given.values() for x in fused if x not in layers]
            if missing or not given or any(len(fused) < 2 for fused in given.values()):
                raise ValueError(f"a fusion needs two layers of the configuration on each support; missing: {missing}")
        check_metrics(layer.get("metrics", []))
    return layers


def check(cfg: dict) -> dict:
    """The configuration with defaults; ValueError, TypeError or KeyError if it can't be run."""
    if "input_ref" not in cfg:
        raise ValueError("a configuration needs input_ref")
    for name in ("input_ref", "input_sec"):
        if name in cfg and cfg[name].get("zunit", "m") not in UNITS:
            raise ValueError(f"{name}: zunit is no length unit")
    out = dict(cfg)
    if "coregistration" in cfg:
        if "input_sec" not in cfg:
            raise ValueError("coregistration needs input_sec")
        out["coregistration"] = check_coregistration({**({"output_dir": cfg["output_dir"]} if "output_dir" in cfg else {}), **cfg["coregistration"]})
    statistics = cfg.get("statistics")
    if statistics is not None:
        out["statistics"] = {}
        for method, s in statistics.items():
            if method not in processing.names():
                raise KeyError(f"no processing method named {method}")
            if "input_sec" not in cfg and method not in ("ref", "ref-curvature"):
                raise ValueError(f"{method} needs input_sec")
            check_metrics(s.get("metrics", []))
            layers = s.get("classification_layers", {})
            if "curvature" in method and "Slope0" in layers:
                raise ValueError("curvature has no layer named Slope0")
            out["statistics"][method] = {**s, "classification_layers": {"global": {"type": "global"}, **check_layers(layers)}}
    return out
