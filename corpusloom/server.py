"""A line-delimited JSON-RPC façade over the query functions, for tools that speak it on standard input and output."""

from __future__ import annotations

import argparse
import json
import sys
from collections import OrderedDict
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import navigate, search
from corpusloom.session import prepare
from corpusloom.sources.index_store import Index
from corpusloom.sources.workspace import Workspace

# Error codes of the protocol.
NO_METHOD, BAD_PARAMS, FAILED = -32601, -32602, -32603
#: Results of searches that are kept, the oldest going first.
KEPT_RESULTS = 50

TOOLS = {
    "search": ("Find sections by keywords, in all files or in one.", {"query": "string", "file_id": "string", "limit": "integer"}, ["query"]),
    "get_section": ("A section by its id, with its neighbours if asked for.", {"section_id": "string", "file_id": "string", "include_context": "boolean"}, ["section_id"]),
    "get_page": ("A page by its number, of all files or of one.", {"page_number": "integer", "file_id": "string"}, ["page_number"]),
    "list_files": ("All files with their ids and sizes.", {}, []),
}


class Failure(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def rows(df: DataFrame) -> list[dict[str, Any]]:
    """Results of an endpoint; all but list_files are bounded by their limits."""
    return [json.loads(x) for x in df.toJSON().collect()]


class Server:
    """Answers messages over an index and its source documents."""

    def __init__(self, index: Index, docs: DataFrame) -> None:
        self.index, self.docs = index, docs
        self.kept: OrderedDict[tuple, list] = OrderedDict()

    def search(self, a: dict) -> list[dict]:
        if not isinstance(a.get("query"), str):
            raise Failure(FAILED, "Missing query")
        limit = search.clamped(_whole(a.get("limit"), search.DEFAULT_LIMIT))
        key = (a["query"].lower(), a.get("file_id") or None, limit)
        if key not in self.kept:
            self.kept[key] = rows(self.index.search(a["query"], key[1], limit))
            if len(self.kept) > KEPT_RESULTS:
                self.kept.popitem(last=False)
        return self.kept[key]

    def get_section(self, a: dict) -> dict:
        if not isinstance(a.get("section_id"), str):
            raise Failure(FAILED, "Missing section_id")
        found = rows(navigate.get_section(self.index.sections, a["section_id"], a.get("file_id"), bool(a.get("include_context"))))
        if not found:
            raise Failure(FAILED, f"Section '{a['section_id']}' not found")
        return found[0]

    def get_page(self, a: dict) -> list[dict]:
        page = _whole(a.get("page_number"), 0)
        if page < 1:
            raise Failure(FAILED, "Missing or invalid page_number")
        found = rows(navigate.get_page(self.docs, self.index.sections, page, a.get("file_id") or None))
        if not found:
            raise Failure(FAILED, f"Page {page} not found")
        return found

    def list_files(self, a: dict) -> list[dict]:
        return rows(navigate.list_files(self.index.files))

    def call(self, params: Any) -> dict:
        if not isinstance(params, dict) or not isinstance(params.get("arguments") or {}, dict):
            raise Failure(BAD_PARAMS, "Invalid parameters")
        if params.get("name") not in TOOLS:
            raise Failure(FAILED, f"Unknown tool: {params.get('name')}")
        result = getattr(self, params["name"])(params.get("arguments") or {})
        return {"content": [{"type": "text", "text": json.dumps(result, indent=2, ensure_ascii=False)}]}

    def handle(self, message: dict) -> dict | None:
        """The answer to one message; notifications have none."""
        methods: dict[str, Callable[[Any], Any]] = {
            "initialize": lambda _: {"serverInfo": {"name": "corpusloom", "version": "1"}, "capabilities": {"tools": {}}},
            "tools/list": lambda _: {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": v} for k, v in p.items()}, "required": r}} for n, (d, p, r) in TOOLS.items()]},
            "tools/call": self.call,
            "ping": lambda _: {},
        }
        answer: dict[str, Any] = {"jsonrpc": "2.0", "id": message.get("id")}
        if str(message.get("method")).startswith("notifications/"):
            return None
        try:
            if message.get("method") not in methods:
                raise Failure(NO_METHOD, "Method not found")
            answer["result"] = methods[message["method"]](message.get("params"))
        except Failure as e:
            answer["error"] = {"code": e.code, "message": str(e)}
        except Exception as e:  # a query that fails is this message's error
            answer["error"] = {"code": FAILED, "message": str(e)}
        return answer

    def run(self, source: TextIO, sink: TextIO) -> None:
        for line in filter(str.strip, source):
            try:
                message = json.loads(line)
                answer = self.handle(message) if isinstance(message, dict) else None
            except ValueError as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": FAILED, "message": str(e)}}
            if answer is not None:
                print(json.dumps(answer, ensure_ascii=False), file=sink, flush=True)


def _whole(value: Any, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Serve ranked search over a data folder.")
    args.add_argument("--root", "--data-path", help="data folder with documents, raw, config and index")
    args.add_argument("--documents", help="folder of *.txt files (default: in the root)")
    args.add_argument("--index", help="folder of the stored index (default: in the root)")
    args.add_argument("--config-path", help="folder of settings (default: in the root)")
    args.add_argument("--force-rebuild", "--rebuild", action="store_true")
    args.add_argument("--server", "--no-setup", action="store_true", help="accepted; there is no setup to skip")
    given = args.parse_args(argv)
    if not given.root and not (given.documents and given.index):
        args.error("give --root, or both --documents and --index")
    spark = prepare(SparkSession.builder.appName("corpusloom").getOrCreate())
    space = Workspace(spark, given.root or given.index, given.config_path, given.documents, given.index)
    space.scaffold()
    index = space.refresh(given.force_rebuild)
    print(", ".join(f"{k}: {v}" for k, v in space.counters().items()), file=sys.stderr)
    Server(index, space.documents()).run(sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
