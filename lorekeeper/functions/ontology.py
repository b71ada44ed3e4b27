"""The closed vocabularies of the graph and registries that can be extended."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Node types, their subtypes, and whether a model may extract them.
_NODES = {
    "document": ((), False),
    "chunk": ((), False),
    "person": (("individual", "alias", "persona"), True),
    "organization": (("company", "nonprofit", "government", "educational", "political", "religious", "military"), True),
    "location": (("address", "city", "region", "country", "landmark", "coordinates"), True),
    "event": (("incident", "meeting", "transaction", "communication", "travel", "employment", "observation"), True),
    "object": (("vehicle", "phone", "email", "document", "device", "software", "task", "topic", "project"), True),
    "preference": ((), True),
    "fact": ((), True),
}
_THINGS = ("person", "organization", "location", "event", "object")
# Relations and the pairs of types that they may join.
_SEMANTICS = {
    "knows": (("person", "person"),),
    "member_of": (("person", "organization"),),
    "employed_by": (("person", "organization"),),
    "owns": (("person", "object"), ("organization", "object")),
    "uses": (("person", "object"), ("organization", "object")),
    "located_at": (("object", "location"), ("event", "location")),
    "resides_at": (("person", "location"),),
    "headquarters_at": (("organization", "location"),),
    "participated_in": (("person", "event"), ("organization", "event")),
    "occurred_at": (("event", "location"),),
    "involved": (("object", "event"),),
    "subsidiary_of": (("organization", "organization"),),
    "partner_with": (("organization", "organization"),),
    "alias_of": tuple((t, t) for t in _THINGS),
    "has_task": (("person", "object"),),
    "experienced_by": (("person", "event"),),
}
_EDGES = {
    "part_of": ((("chunk", "document"),), False),
    "next": ((("chunk", "chunk"),), False),
    "mentions": (tuple((s, t) for s in ("chunk", "document") for t in _THINGS), False),
    "referenced": ((("document", "document"),), False),
    "related_to": (tuple(sorted({p for ps in _SEMANTICS.values() for p in ps})), True),
    "has": ((("person", "preference"), ("person", "object")), False),
    "same_as": (tuple((t, t) for t in (*_THINGS, "preference")), False),
    "superseded_by": ((("preference", "preference"), ("fact", "fact")), False),
}
# Closed vocabularies of properties.
PREFERENCE_CATEGORIES = ("ui", "language", "food", "communication", "work_style", "time", "social", "aesthetic", "other")
STRENGTHS = ("weak", "moderate", "strong")
MATCH_TYPES = ("embedding", "fuzzy", "both")
REVIEW_STATES = ("pending", "confirmed", "rejected")
SUPERSESSION_REASONS = ("contradiction", "stale")
_NAMED = {"aliases": None}
_ROLE, _DATES, _STAY = {"role": None}, {"start_date": None, "end_date": None}, {"from_date": None, "to_date": None}
_SOURCE = {"source_type": None, "source_uri": None, "date": None}
# The properties that each type, or type/subtype, knows.  A tuple has all values, a number the longest text.
_NODE_PROPERTIES = {
    "document": _SOURCE,
    "chunk": _SOURCE | {"content": None},
    "person": _NAMED | {"email": None, "date_of_birth": None, "nationality": None, "occupation": None},
    "organization": _NAMED | {"jurisdiction": None, "registration_number": None},
    "location": _NAMED | {"address": None, "city": None, "country": None, "coordinates": None},
    "event": _NAMED | {"date": None, "time": None, "duration": None, "outcome": None},
    "object": _NAMED | {"identifier": None, "make": None, "model": None, "serial_number": None},
    "object/project": {"external_ref": None},
    "preference": {"statement": 80, "category": PREFERENCE_CATEGORIES, "target": None, "over": None, "context": None, "strength": STRENGTHS},
    "fact": {"subject": None, "predicate": None, "object": None},
}
# The same for edges, by the semantic type of related_to and by the type of all others.
_EDGE_PROPERTIES = {
    "member_of": _ROLE | _DATES,
    "employed_by": _ROLE | _DATES,
    "owns": {"acquisition_date": None},
    "located_at": _STAY,
    "resides_at": _STAY,
    "participated_in": _ROLE,
    "involved": _ROLE,
    "has_task": {"status": None},
    "experienced_by": _ROLE,
    "mentions": {"confidence": None, "start_pos": None, "end_pos": None},
    "same_as": {"confidence": None, "match_type": MATCH_TYPES, "status": REVIEW_STATES},
    "superseded_by": {"superseded_at": None, "reason": SUPERSESSION_REASONS, "judge_confidence": None},
}
SOURCE_TYPES = ("substack", "huggingface", "latent", "file", "conversation", "web", "youtube")


@dataclass
class Ontology:
    """Registered types.  Registering the same thing again changes nothing; another one raises."""

    nodes: dict[str, tuple[tuple[str, ...], bool]] = field(default_factory=lambda: dict(_NODES))
    edges: dict[str, tuple[tuple[tuple[str, str], ...], bool]] = field(default_factory=lambda: dict(_EDGES))
    semantics: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=lambda: dict(_SEMANTICS))

    node_properties: dict[str, dict] = field(default_factory=lambda: dict(_NODE_PROPERTIES))
    edge_properties: dict[str, dict] = field(default_factory=lambda: dict(_EDGE_PROPERTIES))

    @staticmethod
    def _register(registry: dict, name: str, spec) -> None:
        if registry.setdefault(name, spec) != spec:
            raise ValueError(f"{name} is registered already, and differently")

    def register_node_type(self, name: str, subtypes: tuple[str, ...] = (), extractable: bool = True) -> None:
        self._register(self.nodes, name, (tuple(subtypes), extractable))

    def register_node_subtype(self, name: str, subtype: str) -> None:
        subtypes, extractable = self.nodes[name]
        if subtype not in subtypes:
            self.nodes[name] = ((*subtypes, subtype), extractable)

    def register_edge_type(self, name: str, pairs: tuple[tuple[str, str], ...], extractable: bool = False) -> None:
        self._register(self.edges, name, (tuple(pairs), extractable))

    def register_relation_semantic(self, name: str, pairs: tuple[tuple[str, str], ...]) -> None:
        self._register(self.semantics, name, tuple(pairs))
        known, extractable = self.edges["related_to"]
        self.edges["related_to"] = (tuple(sorted({*known, *pairs})), extractable)

    def register_properties(self, owner: str, fields: dict, edge: bool = False) -> None:
        """Fields of a node's type, or type/subtype, or of an edge's type or semantic."""
        self._register(self.edge_properties if edge else self.node_properties, owner, dict(fields))

    def node_fields(self, kind: str, subtype: str | None = None) -> dict:
        """Fields of a type, those of the subtype with them; none for what is not registered."""
        return self.node_properties.get(kind, {}) | self.node_properties.get(f"{kind}/{subtype}", {})

    def edge_fields(self, kind: str, semantic: str | None = None) -> dict:
        return self.edge_properties.get((semantic or "") if kind == "related_to" else kind, {})

    def node_types(self, spark: SparkSession) -> DataFrame:
        """type, subtype (null for none) and extractable: a few rows, made to be broadcast."""
        rows = [(t, s, x) for t, (subs, x) in self.nodes.items() for s in (subs or (None,))]
        return spark.createDataFrame(rows, "type string, subtype string, extractable boolean")

    def edge_pairs(self, spark: SparkSession) -> DataFrame:
        rows = [(t, s, d, x) for t, (pairs, x) in self.edges.items() for s, d in pairs]
        return spark.createDataFrame(rows, "type string, source_type string, target_type string, extractable boolean")

    def semantic_pairs(self, spark: SparkSession) -> DataFrame:
        rows = [(t, s, d) for t, pairs in self.semantics.items() for s, d in pairs]
        return spark.createDataFrame(rows, "semantic_type string, source_type string, target_type string")

    def schema(self) -> dict[str, list]:
        """A sorted export that is the same for the same registries."""
        return {
            "node_types": [{"type": t, "subtypes": sorted(s), "extractable": x} for t, (s, x) in sorted(self.nodes.items())],
            "edge_types": [{"type": t, "pairs": sorted(map(list, p)), "extractable": x} for t, (p, x) in sorted(self.edges.items())],
            "semantics": [{"semantic": t, "pairs": sorted(map(list, p))} for t, p in sorted(self.semantics.items())],
        }


ONTOLOGY = Ontology()
