"""Declarations supplied by the caller: evidence views and column mappings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column


@dataclass(frozen=True)
class ViewSpec:
    """Evidence views: name -> feature columns."""

    views: Mapping[str, tuple[str, ...]]

    @property
    def names(self) -> list[str]:
        return list(self.views)

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys(f for fs in self.views.values() for f in fs))

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return [(v, f) for v, fs in self.views.items() for f in fs]


@dataclass(frozen=True)
class FlowMapping:
    """How one dataset's columns map to the common record schema.

    Values are column names or expressions; nothing about a concrete input file
    is hard-coded in the operators.
    """

    record_id: Column
    cls: Column
    features: Mapping[str, Column]
    entity: Column | None = None
    ts: Column | None = None
    file: Column | None = None
    extra: Mapping[str, Column] = field(default_factory=dict)
