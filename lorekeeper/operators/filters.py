"""Tenant-locked lookups over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RESERVED = ("user_id", "kind", "type")


def live(df: DataFrame) -> DataFrame:
    """Rows that were not merged into others; a missing, null or empty mark counts alike."""
    return df.where(F.coalesce(F.col("merged_into"), F.lit("")) == "")


def embedded(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.size("embedding"), F.lit(0)) > 0)


def changed_since(df: DataFrame, watermark: Column) -> DataFrame:
    return df.where(F.col("updated_at") > watermark)


def current(df: DataFrame) -> DataFrame:
    """Rows that are valid without end."""
    return df.where(F.col("valid_until").isNull())


def valid_at(df: DataFrame, moment: Column) -> DataFrame:
    """Rows valid at a moment: from is inclusive, until exclusive, either may be missing."""
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= moment)
    return df.where(begun & (F.col("valid_until").isNull() | (F.col("valid_until") > moment)))


class GraphQuery:
    """Lookups bound to one tenant; a caller's own ``user_id`` is dropped."""

    def __init__(self, user_id: str | None, nodes: DataFrame, edges: DataFrame):
        if not user_id:
            raise ValueError("a tenant is needed")
        self.nodes = nodes.where(F.col("user_id") == user_id)
        self.edges = edges.where(F.col("user_id") == user_id)

    @staticmethod
    def _matching(df: DataFrame, **wanted: str | None) -> DataFrame:
        for k, v in wanted.items():
            df = df if v is None else df.where(F.col(k) == v)
        return df

    def find_nodes(self, type: str | None = None, name: str | None = None, where: dict | None = None) -> DataFrame:
        more = {k: v for k, v in (where or {}).items() if k != "user_id"}
        if odd := [k for k in more if k in _RESERVED]:
            raise ValueError(f"a filter cannot set {odd}")
        found = self._matching(self.nodes, type=type, name=name)
        for k, v in more.items():
            found = found.where(F.col(k).eqNullSafe(F.lit(v)))
        return found

    def find_node_by_id(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def find_self_person(self) -> DataFrame:
        return self.nodes.where((F.col("type") == "person") & (F.element_at("properties", "is_active_user") == "true"))

    def find_edges(self, type: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
        return self._matching(self.edges, type=type, source_node_id=source, target_node_id=target)

    def find_facts(self, **slots: str | None) -> DataFrame:
        found = self.find_nodes("fact")
        for k, v in slots.items():
            if k not in ("subject", "predicate", "object"):
                raise ValueError(k)
            found = found if v is None else found.where(F.element_at("properties", k) == v)
        return found
