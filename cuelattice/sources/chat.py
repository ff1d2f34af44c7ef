"""Chat completions over HTTP with retries, and a caching proxy before a model server."""

from __future__ import annotations

import json
import sqlite3
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, MutableMapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from cuelattice.functions.keys import request_key
from cuelattice.functions.parse import retry_after

Response = tuple[int, dict, dict]
HIT_HEADER = "x-cache"


class ChatError(RuntimeError):
    """No usable answer after all attempts."""


def http_json(url: str, body: dict | None = None, headers: dict | None = None, timeout: float = 600.0) -> Response:
    """Status, JSON and headers of a request; an answer that is no JSON comes as an error object."""
    data = None if body is None else json.dumps(body, ensure_ascii=False).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"} | (headers or {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            status, raw, found = answer.status, answer.read(), dict(answer.headers)
    except urllib.error.HTTPError as error:
        status, raw, found = error.code, error.read(), dict(error.headers)
    try:
        return status, json.loads(raw), found
    except ValueError:
        return status, {"error": {"message": raw.decode(errors="replace")[:500]}}, found


class ChatClient:
    """Calls of one model; made once a task and used for all its rows."""

    def __init__(self, base_url: str, model: str, attempts: int = 3, send: Callable[..., Response] = http_json, sleep: Callable[[float], None] = time.sleep):
        self.url, self.model, self.attempts, self.send, self.sleep = base_url.rstrip("/") + "/v1/chat/completions", model, attempts, send, sleep
        self.hits = self.misses = 0

    def __call__(self, messages: list[dict]) -> str:
        body = {"model": self.model, "messages": messages, "temperature": 0, "stream": False}
        why = ""
        for attempt in range(1, self.attempts + 1):
            try:
                status, data, headers = self.send(self.url, body)
            except OSError as error:
                why, wait = str(error), min(2.0 * attempt, 10.0)
            else:
                if status == 200:
                    low = {k.lower(): v for k, v in headers.items()}
                    hit = str(low.get(HIT_HEADER, "")).lower() == "hit"
                    self.hits, self.misses = self.hits + hit, self.misses + (not hit)
                    return data["choices"][0]["message"]["content"]
                if status in (401, 403):
                    raise ChatError(f"not authorised ({status})")
                why = f"{status}: {json.dumps(data, ensure_ascii=False)[:500]}"
                told = retry_after({k.lower(): v for k, v in headers.items()}.get("retry-after")) if status == 429 else None
                wait = 2.0 * attempt if told is None else told
            if attempt < self.attempts:
                self.sleep(wait)
        raise ChatError(why)


def first_model(base_url: str, named: str | None = None, attempts: int = 3, send: Callable[..., Response] = http_json, sleep: Callable[[float], None] = time.sleep) -> str:
    """The model named, else the first one that a server lists."""
    if named:
        return named
    why = ""
    for attempt in range(1, attempts + 1):
        try:
            status, data, _ = send(base_url.rstrip("/") + "/v1/models")
        except OSError as error:
            status, data, why = 0, {}, str(error)
        if status == 200:
            names = [m["id"] for m in data.get("data", []) if m.get("id")]
            if not names:
                raise ChatError("the server lists no model")
            return names[0]
        if attempt < attempts:
            sleep(min(2.0 * attempt, 10.0))
    raise ChatError(why or f"status {status}")


class Answers(MutableMapping):
    """Answers by key in a database file, for any number of threads; they outlast the process."""

    def __init__(self, path: str):
        self.lock, self.db = threading.Lock(), sqlite3.connect(path, check_same_thread=False)
        with self.lock, self.db:
            self.db.execute("create table if not exists answers (key text primary key, answer text not null, created_at text default current_timestamp)")

    def __getitem__(self, key: str) -> dict:
        with self.lock:
            found = self.db.execute("select answer from answers where key = ?", (key,)).fetchone()
        if found is None:
            raise KeyError(key)
        return json.loads(found[0])

    def __setitem__(self, key: str, answer: dict) -> None:
        with self.lock, self.db:
            self.db.execute("insert into answers (key, answer) values (?, ?) on conflict (key) do update set answer = excluded.answer", (key, json.dumps(answer, ensure_ascii=False)))

    def __delitem__(self, key: str) -> None:
        with self.lock, self.db:
            self.db.execute("delete from answers where key = ?", (key,))

    def __iter__(self) -> Iterator[str]:
        with self.lock:
            return iter([k for (k,) in self.db.execute("select key from answers order by key")])

    def __len__(self) -> int:
        with self.lock:
            return self.db.execute("select count(*) from answers").fetchone()[0]

    def close(self) -> None:
        self.db.close()

    def __enter__(self) -> Answers:
        return self

    def __exit__(self, *why: object) -> None:
        self.close()


class Upstream:
    """A model server; what is asked of it is never streamed."""

    def __init__(self, base_url: str, key: str | None = None, send: Callable[..., Response] = http_json):
        self.url, self.send = base_url.rstrip("/"), send
        self.headers = {"Authorization": f"Bearer {key}"} if key else {}

    def __call__(self, body: dict) -> Response:
        return self.send(f"{self.url}/v1/chat/completions", body | {"stream": False}, self.headers)

    def models(self) -> Response:
        return self.send(f"{self.url}/v1/models", None, self.headers)


class Proxy:
    """Answers chat requests from a store where it has them, else from upstream; errors are passed on and not stored."""

    def __init__(
        self, upstream: Callable[[dict], Response], store: MutableMapping | None = None, models: Callable[[], Response] | None = None, default_model: str | None = None,
        log: Callable[[str], None] | None = None,
    ):
        self.upstream, self.store, self.models_of, self.default = upstream, {} if store is None else store, models, default_model
        self.hits = self.misses = self.requests = 0
        self.lock, self.log = threading.Lock(), log or (lambda line: None)

    def chat(self, body: object) -> Response:
        if not isinstance(body, dict):
            return 400, {"error": {"message": "the body is no JSON object"}}, {}
        key = request_key(body)
        with self.lock:
            self.requests += 1
            found = self.store.get(key)
            if found is not None:
                self.hits += 1
                self.log(f"hit {key[:12]}")
                return 200, found, {HIT_HEADER: "hit"}
        try:
            status, data, headers = self.upstream(body)
        except OSError as error:
            self.log(f"no upstream for {key[:12]}: {error}")
            return 502, {"error": {"message": str(error)}}, {HIT_HEADER: "miss"}
        self.log(f"miss {key[:12]} {status}")
        if status != 200:
            kept = {k: v for k, v in headers.items() if k.lower() == "retry-after"}
            return status, data, {HIT_HEADER: "miss"} | kept
        with self.lock:
            self.misses += 1
            self.store[key] = data
        return 200, data, {HIT_HEADER: "miss"}

    def models(self) -> Response:
        own = {"object": "list", "data": [{"id": self.default, "object": "model"}] if self.default else []}
        try:
            status, data, _ = self.models_of() if self.models_of else (200, own, {})
        except OSError:
            return 200, own, {}
        return (200, own, {}) if status != 200 and self.default else (status, data, {})

    def stats(self) -> dict:
        return {"hits": self.hits, "misses": self.misses, "entries": len(self.store)}

    def serve(self, host: str = "127.0.0.1", port: int = 8790) -> ThreadingHTTPServer:
        """A server on a thread of its own; shut it down when done."""
        proxy = self

        class Handler(BaseHTTPRequestHandler):
            def _send(self, status: int, data: dict, headers: dict) -> None:
                raw = json.dumps(data, ensure_ascii=False).encode()
                self.send_response(status)
                for name, value in ({"Content-Type": "application/json", "Content-Length": str(len(raw))} | headers).items():
                    self.send_header(name, value)
                self.end_headers()
                self.wfile.write(raw)

            def do_GET(self) -> None:  # noqa: N802
                if self.path == "/v1/models":
                    self._send(*proxy.models())
                elif self.path == "/stats":
                    self._send(200, proxy.stats(), {})
                else:
                    self._send(404, {"error": {"message": "no such path"}}, {})

            def do_POST(self) -> None:  # noqa: N802
                try:
                    body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                except ValueError:
                    body = None
                self._send(*(proxy.chat(body) if self.path == "/v1/chat/completions" else (404, {"error": {"message": "no such path"}}, {})))

            def log_message(self, *args: object) -> None:
                pass

        server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
