"""Classification layers: which class a pixel belongs to on either support, and the modes that compare both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RANGES = (0, 5, 10, 25, 45)


class NotEnoughDataToClassificationLayerError(Exception):
    pass


@dataclass(frozen=True)
class Layer:
    """Classes (name, value) in order, and for each support a column with the class index (null: none)."""

    name: str
    classes: tuple[tuple[str, str], ...]
    index: dict[str, Column]

    @property
    def supports(self) -> tuple[str, ...]:
        return tuple(s for s in ("ref", "sec") if s in self.index)


_layers: dict[str, Callable[..., Layer]] = {}


def register(kind: str):
    def add(f):
        _layers[kind] = f
        return f

    return add


def create(kind: str, name: str, cfg: dict, columns: list[str]) -> Layer:
    """A layer by its kind; KeyError for an unknown one."""
    if kind not in _layers:
        raise KeyError(f"no classification layer of type {kind}")
    return _layers[kind](name, cfg, columns)


@register("global")
def global_layer(name: str = "global", cfg: dict | None = None, columns: list[str] | None = None) -> Layer:
    return Layer(name, (("global", "1"),), {"ref": F.lit(0)})


def check_classes(classes: dict) -> dict:
    for labels in classes.values():
        if not isinstance(labels, (list, tuple)) or not labels or not isinstance(labels[0], int):
            raise TypeError("classes are lists of integers")
    return classes


@register("segmentation")
def segmentation(name: str, cfg: dict, columns: list[str]) -> Layer:
    """Classes are lists of labels of the plane of the layer's name, on each support that has it."""
    classes = check_classes(cfg["classes"])

    def index(support: str) -> Column:
        out = F.lit(None).cast("int")
        for k, labels in reversed(list(enumerate(classes.values()))):
            out = F.when(F.col(f"{name}_{support}").isin(*labels), k).otherwise(out)
        return out

    index_of = {s: index(s) for s in ("ref", "sec") if f"{name}_{s}" in columns}
    if not index_of:
        raise ValueError(f"no label plane named {name}")
    return Layer(name, tuple((n, str(list(v))) for n, v in classes.items()), index_of)


def complete_ranges(ranges) -> tuple[int, ...]:
    """Ranges in order from 0; TypeError unless they are a list of integers."""
    if not isinstance(ranges, (list, tuple)) or not all(isinstance(r, int) for r in ranges):
        raise TypeError("ranges are a list of integers")
    if len(ranges) == 1 and ranges[0] != 0:
        return (0, ranges[0])
    return tuple(ranges)


@register("slope")
def slope_layer(name: str, cfg: dict, columns: list[str]) -> Layer:
    """Classes [a%;b%[ of the slope, the last without end; a class's value is its lower bound."""
    ranges = complete_ranges(cfg.get("ranges", DEFAULT_RANGES))
    classes = tuple((f"[{a}%;{b}%[" if b is not None else f"[{a}%;inf[", str(a)) for a, b in zip(ranges, [*ranges[1:], None]))

    def index(support: str) -> Column:
        s, out = F.col(f"{support}_slope"), F.lit(None).cast("int")
        for k, low in enumerate(ranges):
            out = F.when(s >= low, k).otherwise(out)
        return out

    return Layer(name, classes, {s: index(s) for s in ("ref", "sec") if f"{s}_slope" in columns})


def fusion(name: str, layers: list[Layer], support: str) -> Layer:
    """The cross product of the layers' classes on one support; pixels must have a class in all."""
    if len(layers) < 2:
        raise NotEnoughDataToClassificationLayerError("a fusion needs two layers")
    if any(support not in x.index for x in layers):
        raise ValueError(f"not all layers to fuse lie on {support}")
    index = F.lit(0)
    for x in layers:
        index = index * len(x.classes) + x.index[support]
    merged = tuple("_&_".join(f"{x.name}_{c[0]}" for x, c in zip(layers, cs)) for cs in product(*[x.classes for x in layers]))
    return Layer(name, tuple((n, str(k + 1)) for k, n in enumerate(merged)), {support: index})


def in_modes(df: DataFrame, layer: Layer) -> DataFrame:
    """df exploded by mode, with class_idx: standard, and where both supports are known intersection or exclusion.

    All modes go by the classes of ref (sec only without ref). Pixels in no class on both sides agree.
    """
    first = layer.supports[0]
    own = df.withColumn("class_idx", layer.index[first])
    if len(layer.supports) < 2:
        return own.withColumn("mode", F.lit("standard"))
    agree = F.when(layer.index["ref"].eqNullSafe(layer.index["sec"]), "intersection").otherwise("exclusion")
    return own.withColumn("mode", F.explode(F.array(F.lit("standard"), agree)))


def classes_table(df: DataFrame, layer: Layer) -> DataFrame:
    """mode, class_idx, class_name, class_value of all classes, empty ones too."""
    modes = ["standard"] if len(layer.supports) < 2 else ["standard", "intersection", "exclusion"]
    rows = [(m, k, n, v) for m in modes for k, (n, v) in enumerate(layer.classes)]
    return df.sparkSession.createDataFrame(rows, "mode string, class_idx int, class_name string, class_value string")
