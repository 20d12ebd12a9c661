"""Kind vocabularies of the code graph.  Fixed values: a user's own kinds are passed beside them, never registered
process-wide."""

from __future__ import annotations

from dataclasses import dataclass

SEMANTIC_NODES = ("Table", "HttpContract", "ConfigKey", "I18nKey", "Event", "Queue", "Cache", "Topic", "Schedule", "Page", "EventBus", "Middleware")
SEMANTIC_EDGES = ("Triggers", "PublishesTo", "ReadsDb", "WritesDb", "MapsTo", "ReadsConfig", "ResolvesTo", "WritesCache", "Mutates", "NavigatesTo", "Emits", "ListensTo", "PassesThrough", "ReadsCache")
BRIDGE_EDGES = ("HandledBy", "CallsHttp", "HasColumn")
CHAIN_EDGES = ("Calls", "HasCallSite", *SEMANTIC_EDGES, *BRIDGE_EDGES)
CONTAINMENT_EDGES = ("Declares", "HasColumn", "Extends", "HandledBy")
FLOW_EDGES = ("Calls", "CallsHttp", "HandledBy", "PassesThrough", "WritesDb", "ReadsDb")
ACTION_NODES = ("Method", "Function")
SEVERITY_RANK = {"critical": 0, "error": 1, "warning": 2, "info": 3}


SYNTAX_NODES = ("File", "Namespace", "Module", "Class", "Interface", "Trait", "Enum", "Method", "Function", "Property", "Constant", "CallSite")
NODE_KINDS = (*SYNTAX_NODES, *SEMANTIC_NODES, "Column", "EventHandler", "HeaderAssignment")


@dataclass(frozen=True)
class Kinds:
    """The vocabularies of one project; ``extended`` adds a user's own kinds without touching anybody else's."""

    semantic_nodes: tuple[str, ...] = SEMANTIC_NODES
    semantic_edges: tuple[str, ...] = SEMANTIC_EDGES
    bridge_edges: tuple[str, ...] = BRIDGE_EDGES

    @property
    def chain_edges(self) -> tuple[str, ...]:
        return ("Calls", "HasCallSite", *self.semantic_edges, *self.bridge_edges)

    def extended(self, semantic_nodes=(), semantic_edges=(), bridge_edges=()) -> Kinds:
        both = lambda own, more: (*own, *(k for k in dict.fromkeys(more) if k not in own))
        return Kinds(both(self.semantic_nodes, semantic_nodes), both(self.semantic_edges, semantic_edges), both(self.bridge_edges, bridge_edges))


def sql_list(kinds) -> str:
    return ", ".join(f"'{k}'" for k in kinds)
