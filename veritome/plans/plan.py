"""Query plans: a bounded DAG of operators, parsed and checked without Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from veritome.errors import INVALID, EvidenceError, invalid, limit_exceeded
from veritome.requests import MAX_PATH_BYTES, Check, Config, array, at_most, boolean, listed, must, positive, relation_kind, shape, string, tag, text, uint, uuid, vector

# Plan limits and names.
DEFAULT_LIMIT = 10
DEFAULT_EXCERPT_BYTES = 512
MAX_PATTERN_BYTES = 1024
MAX_FILTER_TAGS = 64
MAX_FILTER_ASSETS = 1000
MAX_UNION_INPUTS = 16
MAX_EXCERPT_MATERIALIZATION = 64 << 20
BYTES_A_CHARACTER = 6
STATUSES = ("current", "historical", "staged", "retired", "purged")
SYNTAXES = ("websearch", "plain", "phrase")
DIRECTIONS = ("out", "in", "both")


@dataclass(frozen=True)
class Filter:
    path_prefix: str | None = None
    tags_all: tuple[str, ...] = ()
    tags_any: tuple[str, ...] = ()
    asset_ids: tuple[str, ...] = ()


@dataclass(frozen=True)
class Literal:
    text: str
    filter: Filter = Filter()


@dataclass(frozen=True)
class Regex:
    pattern: str
    case_insensitive: bool = False
    filter: Filter = Filter()


@dataclass(frozen=True)
class Lexical:
    query: str
    syntax: str = "websearch"
    filter: Filter = Filter()


@dataclass(frozen=True)
class Semantic:
    vector: tuple[float, ...]
    filter: Filter = Filter()


@dataclass(frozen=True)
class Neighbors:
    source: int
    direction: str = "both"
    kinds: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    max_edges: int = 0


@dataclass(frozen=True)
class Union:
    inputs: tuple[int, ...]


Op = Literal | Regex | Lexical | Semantic | Neighbors | Union


@dataclass(frozen=True)
class Node:
    id: str
    op: Op
    limit: int

    @property
    def mode(self) -> str:
        return type(self.op).__name__.lower()

    @property
    def inputs(self) -> tuple[int, ...]:
        return (self.op.source,) if isinstance(self.op, Neighbors) else self.op.inputs if isinstance(self.op, Union) else ()


@dataclass(frozen=True)
class Plan:
    nodes: tuple[Node, ...]
    output: int
    excerpt_bytes: int = DEFAULT_EXCERPT_BYTES
    max_response_bytes: int = 64 << 10
    approximate: bool = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "approximate", any(isinstance(n.op, Semantic) for n in self.nodes))


_FILTER = shape({
    "path_prefix": (text(MAX_PATH_BYTES), None),
    "tags_all": (listed(tag, 0, MAX_FILTER_TAGS), ()),
    "tags_any": (listed(tag, 0, MAX_FILTER_TAGS), ()),
    "asset_ids": (listed(uuid, 0, MAX_FILTER_ASSETS), ()),
})
_node_id = must(lambda v: isinstance(v, str) and re.fullmatch("[a-z][a-z0-9_]{0,31}", v) is not None, "a name: a-z, then up to 31 of a-z, 0-9 and _")
_pattern = text(MAX_PATTERN_BYTES, controls=True)


def _one_of(options: tuple[str, ...]) -> Check:
    return must(lambda v: isinstance(v, str) and v in options, f"one of {', '.join(options)}")


class _Reader:
    """Reads the nodes of one plan; ``nodes`` are those read so far, by name."""

    def __init__(self, config: Config) -> None:
        self.config, self.nodes = config, {}
        limits = config.limits
        searched = {"filter": (_FILTER, None)}
        self.tables = {
            "literal": {"text": _pattern} | searched,
            "regex": {"pattern": _pattern, "case_insensitive": (boolean, False)} | searched,
            "lexical": {"query": _pattern, "syntax": (_one_of(SYNTAXES), "websearch")} | searched,
            "semantic": {"model": must(lambda v: v == config.embedding_model, f'the collection\'s model "{config.embedding_model}"'), "vector": vector(config.embedding_dimensions or 0)} | searched,
            "neighbors": {
                "from": self._place, "direction": (_one_of(DIRECTIONS), "both"), "kinds": (listed(relation_kind, 0, MAX_FILTER_TAGS), ()),
                "status": (listed(_one_of(STATUSES), 0, len(STATUSES)), ()), "max_edges": (positive, 0),
            },
            "union": {"inputs": listed(self._place, 2, MAX_UNION_INPUTS, repeats=False)},
        }
        common = {"op": string, "id": self._new_name, "limit": (at_most("max_candidates_per_operator", limits.max_candidates_per_operator, positive), None)}
        self.shapes = {name: shape(common | table) for name, table in self.tables.items()}

    def _new_name(self, value: Any, at: str) -> str:
        if _node_id(value, at) in self.nodes:
            raise invalid(at, f'{at}: "{value}" is taken')
        return value

    def _place(self, value: Any, at: str) -> int:
        """The number of a node that came before."""
        if string(value, at) not in self.nodes:
            raise invalid(at, f'{at}: no node "{value}" comes before')
        return list(self.nodes).index(value)

    def __call__(self, value: Any, at: str) -> Node:
        name = value.get("op") if isinstance(value, dict) else None
        op = _one_of(tuple(self.shapes))(name, f"{at}.op")
        if op == "semantic" and self.config.embedding_model is None:
            raise EvidenceError(INVALID, "semantic_not_configured", "the collection stores no embeddings", field=f"{at}.op")
        m = self.shapes[op](value, at)
        most = self.config.limits.max_candidates_per_operator
        usual, given = DEFAULT_LIMIT, vars(m)
        if op == "neighbors":
            made: Op = Neighbors(given["from"], m.direction, m.kinds, m.status, m.max_edges)
        elif op == "union":
            made, earlier = Union(m.inputs), list(self.nodes.values())
            usual = sum(earlier[i].limit for i in m.inputs)
        else:
            kept = {k: given[k] for k in self.tables[op] if k not in ("model", "filter")}
            made = {"literal": Literal, "regex": Regex, "lexical": Lexical, "semantic": Semantic}[op](**{k: tuple(v) if isinstance(v, list) else v for k, v in kept.items()}, filter=Filter(**vars(m.filter)) if m.filter else Filter())
        self.nodes[m.id] = Node(m.id, made, m.limit or min(usual, most))
        return self.nodes[m.id]


def _with_edge_limits(nodes: tuple[Node, ...], budget: int) -> tuple[Node, ...]:
    """Nodes with a ``max_edges`` each: those without one get equal parts of what the others leave of the budget."""
    asked = {n.id: n.op.max_edges for n in nodes if isinstance(n.op, Neighbors)}
    open_ = [k for k, edges in asked.items() if not edges]
    left = budget - sum(asked.values())
    if left < len(open_):
        raise limit_exceeded("max_edges_returned", budget, f"all neighbors nodes of a plan together may return {budget} edges")
    asked |= dict.fromkeys(open_, left // len(open_) if open_ else 0)
    return tuple(replace(n, op=replace(n.op, max_edges=asked[n.id])) if n.id in asked else n for n in nodes)


def parse_plan(value: Any, config: Config) -> Plan:
    """The checked plan; errors come in the order of the checks."""
    limits, reader = config.limits, _Reader(config)

    def some_nodes(value: Any, at: str) -> list:
        if not 0 < len(array(value, at)) <= limits.max_plan_nodes:
            raise limit_exceeded("max_plan_nodes", limits.max_plan_nodes, f"a plan may have {limits.max_plan_nodes} nodes") if value else invalid(at, f"{at}: expected a node")
        return value

    m = shape({
        "nodes": some_nodes,
        "max_response_bytes": (at_most("max_response_bytes", limits.max_response_bytes, positive), limits.max_response_bytes),
        "excerpt_bytes": (uint(2**32 - 1), None), "output": (lambda value, at: value, None),
    })(value)
    budget = m.max_response_bytes
    excerpt = min(DEFAULT_EXCERPT_BYTES, budget) if m.excerpt_bytes is None else at_most("max_response_bytes", budget, uint(2**32 - 1))(m.excerpt_bytes, "excerpt_bytes")
    nodes = listed(reader, 1)(m.nodes, "nodes")
    output = shape({"output": reader._place})({"output": m.output}).output
    need = BYTES_A_CHARACTER * nodes[output].limit * excerpt
    if need > MAX_EXCERPT_MATERIALIZATION:
        raise limit_exceeded("max_excerpt_materialization_bytes", MAX_EXCERPT_MATERIALIZATION, f"an output of {nodes[output].limit} excerpts of {excerpt} bytes may need {need} bytes")
    fed, reached = set(), {output}
    while reached - fed:  # what the output is made of, step by step
        fed |= reached
        reached = {k for i in fed for k in nodes[i].inputs}
    for i in sorted(set(range(len(nodes))) - fed):
        raise invalid(f"nodes[{i}]", f'nodes[{i}]: the output does not use "{nodes[i].id}"')
    return Plan(_with_edge_limits(nodes, limits.max_edges_returned), output, excerpt, budget)
