"""A server over standard input and output with three tools, one JSON-RPC message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from codelode import __version__


def tools(engine, db: str | None) -> dict[str, tuple[str, dict, Callable]]:
    """Name: what it does, the schema of its arguments, and the function."""

    def query_context(query: str, top: int = 3, kind: str | None = None, language: str | None = None, filter: str | None = None, db: str | None = db) -> list[dict]:
        return engine.query(query, db, top=top, kind=kind, lang=language, filter=filter)["results"]

    def index_codebase(path: str, reset: bool = False, definitions: bool = False, db: str | None = db) -> dict:
        return engine.index(path, db, reset=reset, definitions=definitions)

    def index_status(workspace: str | None = None, db: str | None = db) -> dict:
        return engine.status(db, workspace)

    text, flag = {"type": "string"}, {"type": "boolean"}
    return {
        "query_context": ("Find the snippets that answer a question.", {"type": "object", "required": ["query"], "properties": {"query": text, "top": {"type": "integer"}, "kind": text, "language": text, "filter": text, "db": text}}, query_context),
        "index_codebase": ("Index a tree of files.", {"type": "object", "required": ["path"], "properties": {"path": text, "reset": flag, "definitions": flag, "db": text}}, index_codebase),
        "index_status": ("Tell the state of an index.", {"type": "object", "properties": {"workspace": text, "db": text}}, index_status),
    }


def answer(message: dict, known: dict) -> dict | None:
    """The response to a message; None for a notification."""
    if "id" not in message:
        return None
    method, out = message.get("method"), {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return out | {"result": {"protocolVersion": message.get("params", {}).get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "codelode", "version": __version__}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s, _) in known.items()]}}
    if method == "tools/call":
        name = message.get("params", {}).get("name")
        if name not in known:
            return out | {"error": {"code": -32602, "message": f"no tool {name!r}"}}
        try:
            value = known[name][2](**message["params"].get("arguments", {}))
            return out | {"result": {"content": [{"type": "text", "text": json.dumps(value)}], "isError": False}}
        except Exception as e:  # a tool's failure is its result
            return out | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
    return out | {"error": {"code": -32601, "message": f"no method {method!r}"}}


def serve(engine, db: str | None, read: TextIO = sys.stdin, write: TextIO = sys.stdout) -> None:
    known = tools(engine, db)
    for line in read:
        if not line.strip():
            continue
        try:
            reply = answer(json.loads(line), known)
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            print(json.dumps(reply), file=write, flush=True)
