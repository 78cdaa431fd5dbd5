"""Faceted filters over overlay items: plain predicates that push down to the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "__none__"


def _flag(name: str) -> Column:
    return F.when(F.col(name), "True").when(~F.col(name), "False").otherwise("None")


#: facet -> its text value
GETTERS = {
    "item_kind": lambda: F.col("item_kind"),
    "path_type": lambda: F.col("path_type"),
    "stroke_color": lambda: F.coalesce(F.col("stroke_color"), F.lit(NONE)),
    "fill_color": lambda: F.coalesce(F.col("fill_color"), F.lit(NONE)),
    "close_path": lambda: _flag("close_path"),
    "has_mask": lambda: _flag("has_mask"),
}
#: layer -> (shown by default, its facets)
LAYERS: dict[str, tuple[bool, tuple[str, ...]]] = {
    "text": (True, ()),
    "images": (False, ("has_mask",)),
    "annotations": (False, ()),
    "drawings": (False, ("item_kind", "path_type", "stroke_color", "fill_color", "close_path")),
}


def facet_predicate(selected: Mapping[str, Sequence[str]]) -> Column:
    """AND over facets of OR within each; empty selections and unknown facets do not restrict."""
    tests = [F.coalesce(GETTERS[k]().isin(list(v)), F.lit(False)) for k, v in selected.items() if v and k in GETTERS]
    return reduce(and_, tests, F.lit(True))


def filter_items(items: DataFrame, selected: Mapping[str, Sequence[str]]) -> DataFrame:
    return items.where(facet_predicate(selected))


def filter_layers(items: DataFrame, enabled: Sequence[str] | None = None, selected: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> DataFrame:
    """Items of the enabled layers (by default those shown by default), each under its own facets."""
    names = [k for k, (shown, _) in LAYERS.items() if shown] if enabled is None else [k for k in enabled if k in LAYERS]
    tests = []
    for name in names:
        own = {k: v for k, v in (selected or {}).get(name, {}).items() if k in LAYERS[name][1]}
        tests.append((F.col("layer_key") == name) & facet_predicate(own))
    return items.where(reduce(or_, tests, F.lit(False)))


def color_options(items: DataFrame, page: str = "page_index") -> DataFrame:
    """``page, facet, value``: the distinct stroke and fill colours of each page, and the none entry where an item lacks one."""
    kinds = F.array(*[F.struct(F.lit(k).alias("facet"), GETTERS[k]().alias("value")) for k in ("stroke_color", "fill_color")])
    return items.select(page, F.explode(kinds).alias("o")).select(page, "o.facet", "o.value").distinct()
