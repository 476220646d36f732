"""The service over HTTP: GET /search?q=&limit=&mode= and GET /suggest?prefix=."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .service import Service


def handler(service: Service, mode: str = "fulltext") -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            where = urlsplit(self.path)
            asked = {k: v[0] for k, v in parse_qs(where.query, keep_blank_values=True).items()}
            try:
                self.reply(200, answer(service, where.path, asked, mode))
            except KeyError:
                self.reply(404, {"error": "not found"})
            except ValueError as e:
                self.reply(400, {"error": str(e)})
            except Exception as e:  # an embedder or the cluster failed: the caller gets to know
                self.reply(500, {"error": str(e)})

        def reply(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            for k, v in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    return Handler


def answer(service: Service, path: str, asked: dict[str, str], mode: str = "fulltext") -> dict:
    """The reply to one request; KeyError: no such path; ValueError: a bad request."""
    if path == "/suggest":
        prefix = asked.get("prefix", "").strip()
        return {"prefix": prefix, "suggestions": service.suggest(prefix)}
    if path != "/search":
        raise KeyError(path)
    began = time.time()
    rows = service.search(asked.get("q", ""), asked.get("mode", mode), int(asked.get("limit", "10")))
    return {"query": asked["q"].strip(), "results": rows, "total": len(rows), "time_ms": (time.time() - began) * 1000}


def serve(service: Service, host: str = "127.0.0.1", port: int = 3000, mode: str = "fulltext") -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler(service, mode))
