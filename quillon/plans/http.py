"""The search service over HTTP, as a WSGI application (PEP 3333) without any framework.

Routes: /api/v1, /api/v1/health, /api/v1/search. Serve it with any WSGI server, for a trial with
wsgiref.simple_server.make_server("", 8000, application(engine)).serve_forever().
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from http import HTTPStatus
from urllib.parse import parse_qs

from ..operators.serve import API_VERSION, Engine, ServiceError

HEADERS = [("Content-Type", "application/json; charset=utf-8"), ("X-API-Version", API_VERSION), ("X-Content-Type-Options", "nosniff")]
ENDPOINTS = ("/api/v1/health", "/api/v1/search")


def search_arguments(query: str) -> dict:
    """Engine.search's arguments from a query string; category, ingredient and method may be repeated."""
    got = parse_qs(query, keep_blank_values=True)
    one = lambda k: got[k][0] if k in got else None
    return {
        "q": one("q"), "ranker": one("ranker"), "page_number": one("page"), "page_size": one("page_size"), "max_time_minutes": one("max_time"), "difficulty": one("difficulty"),
        "categories": got.get("category", []), "ingredients": got.get("ingredient", []), "cooking_methods": got.get("method", []),
    }


def application(engine: Engine) -> Callable[[dict, Callable], Iterable[bytes]]:
    routes = {
        "/api/v1": lambda _: {"name": "quillon search API", "version": API_VERSION, "endpoints": list(ENDPOINTS)},
        "/api/v1/health": lambda _: engine.health(),
        "/api/v1/search": lambda query: engine.search(**search_arguments(query)),
    }

    def respond(environ: dict, start: Callable) -> Iterable[bytes]:
        status = HTTPStatus.OK
        path = environ.get("PATH_INFO", "").rstrip("/") or "/"
        try:
            if path not in routes:
                raise ServiceError("not_found", "no such resource", HTTPStatus.NOT_FOUND)
            if environ.get("REQUEST_METHOD", "GET") not in ("GET", "HEAD"):
                raise ServiceError("method_not_allowed", "only GET is answered", HTTPStatus.METHOD_NOT_ALLOWED)
            body = routes[path](environ.get("QUERY_STRING", ""))
        except ServiceError as e:
            status, body = HTTPStatus(e.status), e.to_dict()
        except Exception:  # a client gets no internals
            status, body = HTTPStatus.INTERNAL_SERVER_ERROR, {"error": {"code": "internal_server_error", "message": "the request failed"}}
        data = json.dumps(body, ensure_ascii=False).encode()
        start(f"{status.value} {status.phrase}", [*HEADERS, ("Content-Length", str(len(data)))])
        return [] if environ.get("REQUEST_METHOD") == "HEAD" else [data]

    return respond
