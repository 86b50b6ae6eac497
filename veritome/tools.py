"""Two bounded tools for agents: search and cite."""

from __future__ import annotations

import json
from typing import Any

from veritome.api import Evidence
from veritome.errors import EvidenceError

TOOLS = [
    {
        "name": "evidence_search",
        "description": "Searches current evidence and returns excerpts with ids to cite; hops adds directly related evidence.",
        "input_schema": {
            "type": "object",
            "properties": {
                "corpus": {"type": "string"},
                "query": {"type": "string", "maxLength": 1024},
                "limit": {"type": "integer", "minimum": 1, "maximum": 20, "default": 8},
                "hops": {"type": "boolean", "default": False},
                "path_prefix": {"type": "string"},
            },
            "required": ["corpus", "query"],
        },
    },
    {
        "name": "evidence_cite",
        "description": "Gives the exact, verified text behind an evidence id, or its status.",
        "input_schema": {"type": "object", "properties": {"corpus": {"type": "string"}, "evidence_id": {"type": "string", "format": "uuid"}}, "required": ["corpus", "evidence_id"]},
    },
]


def search_plan(query: str, limit: int = 8, hops: bool = False, path_prefix: str | None = None, excerpt_bytes: int = 400) -> dict:
    """Lexical hits; with ``hops`` also current evidence one relation away, after the hits."""
    nodes: list[dict] = [{"id": "hits", "op": "lexical", "query": query, "limit": limit, "filter": {"path_prefix": path_prefix}}]
    if hops:
        nodes.append({"id": "related", "op": "neighbors", "from": "hits", "status": ["current"], "limit": limit})
        nodes.append({"id": "all", "op": "union", "inputs": ["hits", "related"]})
    return {"nodes": nodes, "output": nodes[-1]["id"], "excerpt_bytes": excerpt_bytes}


def run_tool(evidence: Evidence, name: str, arguments: dict[str, Any]) -> dict:
    """The tool's result; errors are results too."""
    try:
        if name == "evidence_search":
            options = {k: arguments[k] for k in ("limit", "hops", "path_prefix") if k in arguments}
            return json.loads(evidence.query(arguments["corpus"], search_plan(arguments["query"], **options)))
        if name == "evidence_cite":
            return json.loads(evidence.resolve(arguments["corpus"], arguments["evidence_id"]))
    except EvidenceError as error:
        return {"error": error.sqlstate, "reason": error.reason, "detail": error.detail}
    return {"error": "unknown_tool", "tool": name}
