"""Search, single items and saved searches over snapshot tables, over HTTP and JSON-RPC.

The rows that are collected are listed ones, of which there are at most
``LISTED`` in an answer; counts are taken over all rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.operators import filters, items, ranking
from skeinworks.sources.config import active, category_of

#: Rows that an answer lists at most; what is counted is counted over all rows.
LISTED = 500
COLUMNS = ["rank", "id", "price_cents", "currency", "capacity_tb", "condition", "title", "source_url"]


class BadRequest(ValueError):
    """A request that can't be answered as asked."""


@dataclass
class Service:
    """``load`` gives the current items; ``checks`` the filter of each category and ``strong`` that of its strong matches; ``now`` tells which saved searches have run out."""

    load: Callable[[], DataFrame]
    checks: dict[str, filters.HardFilter]
    default: str = ""
    watches: list[dict] = field(default_factory=list)
    gauges: Callable[[], list[tuple[str, dict[str, str], float]]] = list
    strong: dict[str, filters.HardFilter] = field(default_factory=dict)
    now: Callable[[], datetime] = lambda: datetime.now(UTC)

    def search(self, category: str = "", text: str = "", limit: int = 0) -> dict:
        """The most recent matches (all, without a limit), filtered, then ranked by price and id.

        ``matched`` and ``filtered`` count all of them; of the filtered ones
        the first ``LISTED`` are listed, and ``cut`` tells whether there are more.
        """
        try:
            name = category_of(category, list(self.checks), self.default)
        except ValueError as e:
            raise BadRequest(str(e)) from e
        if limit < 0:
            raise BadRequest("limit must not be negative")
        query = items.ItemQuery(equals=(("category", name),), text=text, limit=limit)
        recent = items.search(self.load(), query) if limit else items.matching(self.load(), query)
        found = self._rows(filters.explained(recent, self.checks[name]))
        counts = found.agg(F.count("*").alias("matched"), F.count_if(F.col("reason").isNull()).alias("filtered")).first()
        listed = [self._listed(i, r) for i, r in enumerate(self._first(found), 1)]
        return {"matched": counts["matched"], "filtered": counts["filtered"], "cut": counts["filtered"] > len(listed), "items": listed}

    @staticmethod
    def _rows(rows: DataFrame) -> DataFrame:
        named = ["watch"] if "watch" in rows.columns else []
        return rows.select(*named, "id", "price_cents", "currency", F.coalesce(F.col("attributes")["capacity_tb"], F.lit("")).alias("capacity_tb"), "condition", "title", "source_url", "reason")

    @staticmethod
    def _first(found: DataFrame) -> list:
        """The cheapest of the rows that pass, unknown prices last: at most ``LISTED``."""
        return found.where("reason is null").orderBy(F.nullif("price_cents", F.lit(0)).asc_nulls_last(), "id").limit(LISTED).collect()

    @staticmethod
    def _listed(rank: int, row) -> dict:  # noqa: ANN001
        return {"rank": rank, **{c: row[c] for c in COLUMNS[1:]}}

    def item(self, key: str) -> dict | None:
        """The whole item of an id."""
        if not key:
            raise BadRequest("id is missing")
        row = items.get(self.load(), key).first()
        return row.asDict(recursive=True) if row else None

    def watched(self) -> list[dict]:
        """Every saved search that has not run out: how many candidates pass its category's filter, how many of them are
        strong, and the first ``LISTED`` of each. One that has run out gives nothing, not an empty list."""
        live = [w for w in self.watches if active(w, self.now())]
        unknown = [w for w in live if w.get("category") not in self.checks]
        if unknown:
            raise BadRequest(f"{unknown[0]['name']}: unknown category {unknown[0].get('category')}")
        if not live:
            return []
        category = {w["name"]: w["category"] for w in live}
        matched = ranking.matched_watches(self.load(), live)

        def why(specs: dict[str, filters.HardFilter]) -> Column:
            out = F.lit("no filter")
            for name, of in category.items():
                if of in specs:
                    out = F.when(F.col("watch") == name, filters.reason(specs[of])).otherwise(out)
            return out

        rows = self._rows(matched.withColumn("reason", why(self.checks))).where("reason is null").drop("reason")
        strong = self._rows(matched.withColumn("reason", why(self.checks)).where("reason is null").withColumn("reason", why(self.strong))).where("reason is null").drop("reason")
        both = rows.withColumn("kind", F.lit("candidates")).unionByName(strong.withColumn("kind", F.lit("strong")))
        counts = {(r["watch"], r["kind"]): r["n"] for r in both.groupBy("watch", "kind").agg(F.count("*").alias("n")).collect()}
        order = [F.nullif("price_cents", F.lit(0)).asc_nulls_last(), F.asc("id")]
        first = ranking.ranked(both, order, ["watch", "kind"]).where(F.col("rank") <= LISTED)
        lists: dict[tuple[str, str], list] = {}
        for r in first.orderBy("watch", "kind", "rank").collect():  # at most LISTED rows of each search and kind
            lists.setdefault((r["watch"], r["kind"]), []).append(self._listed(r["rank"], r))
        out = []
        for w in live:
            one = {"name": w["name"], "audience": w.get("audience", "")}
            for kind, count in (("candidates", "candidate_count"), ("strong", "strong_count")):
                one |= {count: counts.get((w["name"], kind), 0), kind: lists.get((w["name"], kind), [])}
            out.append(one | {"cut": one["candidate_count"] > len(one["candidates"]) or one["strong_count"] > len(one["strong"])})
        return out

    def metrics(self) -> str:
        """Gauges in the text format of Prometheus."""
        lines = []
        for name, labels, value in self.gauges():
            marks = ",".join(f'{k}="{v}"' for k, v in sorted(labels.items()))
            lines.append(f"{name}{{{marks}}} {value:g}" if marks else f"{name} {value:g}")
        return "\n".join(lines) + "\n"

    TOOLS = (
        {"name": "search_items", "description": "Search the items of a category.", "inputSchema": {"type": "object", "properties": {"category": {"type": "string"}, "text": {"type": "string"}, "limit": {"type": "integer"}}}},
        {"name": "get_item", "description": "One item by id.", "inputSchema": {"type": "object", "properties": {"id": {"type": "string"}}, "required": ["id"]}},
    )

    def rpc(self, request: dict) -> dict | None:
        """The answer to a JSON-RPC 2.0 request; None for a notification."""
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0":
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "invalid request"}}
        method, key, params = request.get("method", ""), request.get("id"), request.get("params") or {}
        if method.startswith("notifications/"):
            return None
        if method == "initialize":
            result: dict = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "skeinworks", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": list(self.TOOLS)}
        elif method == "tools/call":
            result = self._call(params.get("name", ""), params.get("arguments") or {})
        else:
            return {"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"no method {method}"}}
        return {"jsonrpc": "2.0", "id": key, "result": result}

    def _call(self, name: str, arguments: dict) -> dict:
        try:
            if name == "search_items":
                got = self.search(arguments.get("category", ""), arguments.get("text", ""), int(arguments.get("limit", 0)))
            elif name == "get_item":
                got = self.item(arguments.get("id", ""))
                if got is None:
                    raise BadRequest("no such item")
            else:
                raise BadRequest(f"no tool {name}")
        except (BadRequest, ValueError) as e:
            return {"isError": True, "content": [{"type": "text", "text": str(e)}]}
        return {"content": [{"type": "text", "text": json.dumps(got, default=str)}]}


def answer(service: Service, method: str, target: str, body: bytes = b"") -> tuple[int, str, str]:
    """(status, content type, body) of a request."""
    url = urlsplit(target)
    query = {k: v[0] for k, v in parse_qs(url.query).items()}
    as_json = lambda status, value: (status, "application/json", json.dumps(value, indent=2, default=str))
    if url.path == "/mcp":
        if method != "POST":
            return as_json(405, {"error": "POST only"})
        try:
            request = json.loads(body)
        except ValueError:
            return as_json(200, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
        got = service.rpc(request)
        return as_json(200, got) if got is not None else (202, "application/json", "")
    if method != "GET":
        return as_json(405, {"error": "GET only"})
    try:
        if url.path in ("/healthz", "/readyz"):
            return 200, "text/plain", "ok\n"
        if url.path == "/metrics":
            return 200, "text/plain", service.metrics()
        if url.path == "/search":
            limit = query.get("limit") or "0"
            if not limit.isdigit():
                raise BadRequest("limit must be a number")
            return as_json(200, service.search(query.get("category", ""), query.get("text", ""), int(limit)))
        if url.path == "/item":
            got = service.item(query.get("id", ""))
            return as_json(200, got) if got else as_json(404, {"error": "no such item"})
        if url.path == "/watches":
            return as_json(200, {"watches": service.watched()})
    except BadRequest as e:
        return as_json(400, {"error": str(e)})
    return as_json(404, {"error": "no such path"})


def serve(service: Service, port: int) -> ThreadingHTTPServer:
    """A server on the local interface; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            status, kind, text = answer(service, self.command, self.path, self.rfile.read(length) if length else b"")
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _do

        def log_message(self, *_: object) -> None:
            return

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
