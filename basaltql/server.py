"""Front ends over an Instance: HTTP with a registry of sessions, and length-prefixed text over TCP.

HTTP: POST /query with a statement text as its body (or {"sql": text, "parameters": [...]}) answers {"results": [...]},
one for each statement, or {"error": text}; GET /session names a new session, GET /health answers {"status": "ok"}.
A request with the header X-Session runs in that session, and the answer names it; an unknown name gets a new
session.  Without the header a request has a session of its own, whose open transaction is rolled back.

TCP: a request is its length (32 bits, little-endian) and UTF-8 text; the answer is a length and the same JSON.
"""

from __future__ import annotations

import contextlib
import json
import secrets
import socketserver
import struct
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.errors import PySparkException

from basaltql.errors import EngineError
from basaltql.session import Instance, Session

MAX_SESSIONS, IDLE_SECONDS, MAX_REQUEST = 256, 30 * 60, 64 << 20


def answer(session: Session, text: str, parameters: list | None = None) -> dict[str, Any]:
    """The JSON envelope of a text of statements."""
    try:
        return {"results": [r.json() for r in session.results(text, parameters)]}
    except (EngineError, PySparkException) as e:
        return {"error": str(e)}


class Sessions:
    """Sessions by name; idle ones, and the longest unused beyond the bound, are rolled back and forgotten."""

    def __init__(self, instance: Instance, limit: int = MAX_SESSIONS, idle: float = IDLE_SECONDS):
        self.instance, self.limit, self.idle = instance, limit, idle
        self.lock = threading.Lock()
        self.known: dict[str, tuple[Session, threading.Lock]] = {}
        self.used: dict[str, float] = {}

    def claim(self, name: str | None) -> tuple[str, Session, threading.Lock]:
        """The session of this name, or a new one under a name of ours."""
        with self.lock:
            self.sweep()
            if name not in self.known:
                name = secrets.token_hex(16)
                self.known[name] = self.instance.session(), threading.Lock()
            self.used[name] = time.monotonic()
            return name, *self.known[name]

    def sweep(self) -> None:
        now = time.monotonic()
        by_age = sorted(self.used, key=self.used.__getitem__)
        for k, name in enumerate(by_age):
            session, busy = self.known[name]
            if (now - self.used[name] > self.idle or len(by_age) - k >= self.limit) and not busy.locked():
                del self.known[name], self.used[name]
                session.close()


class _Http(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    sessions: Sessions

    def reply(self, status: int, body: dict[str, Any], name: str | None = None) -> None:
        data = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        if name:
            self.send_header("X-Session", name)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:
        if self.path == "/health":
            return self.reply(200, {"status": "ok"})
        if self.path == "/session":
            name, *_ = self.sessions.claim(None)
            return self.reply(200, {"session": name}, name)
        return self.reply(404, {"error": "not found"})

    def do_POST(self) -> None:
        size = int(self.headers.get("Content-Length") or 0)
        if size > MAX_REQUEST:
            self.close_connection = True
            return self.reply(413, {"error": "request too large"})
        text, parameters = self.rfile.read(size).decode("utf-8", "replace"), None
        if self.path != "/query":
            return self.reply(404, {"error": "not found"})
        if text.lstrip().startswith("{"):
            try:
                body = json.loads(text)
                text, parameters = body["sql"], body.get("parameters")
            except (ValueError, KeyError):
                return self.reply(400, {"error": "expected a JSON object with sql"})
        if "X-Session" in self.headers:
            name, session, busy = self.sessions.claim(self.headers["X-Session"])
            with busy:
                out = answer(session, text, parameters)
            return self.reply(400 if "error" in out else 200, out, name)
        session = self.sessions.instance.session()
        try:
            out = answer(session, text, parameters)
        finally:
            session.close()
        return self.reply(400 if "error" in out else 200, out)

    def log_message(self, *_: Any) -> None:
        pass


class _Tcp(socketserver.BaseRequestHandler):
    instance: Instance

    def exactly(self, n: int) -> bytes | None:
        data = b""
        while len(data) < n:
            if not (more := self.request.recv(n - len(data))):
                return None
            data += more
        return data

    def handle(self) -> None:
        session = self.instance.session()
        try:
            while (head := self.exactly(4)) is not None:
                size = struct.unpack("<I", head)[0]
                if size > MAX_REQUEST or (body := self.exactly(size)) is None:
                    return
                out = json.dumps(answer(session, body.decode("utf-8", "replace"))).encode()
                self.request.sendall(struct.pack("<I", len(out)) + out)
        finally:
            session.close()


class _TcpServer(socketserver.ThreadingTCPServer):
    daemon_threads, allow_reuse_address = True, True


def serve_http(instance: Instance, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server, not yet running: call serve_forever()."""
    return ThreadingHTTPServer((host, port), type("Http", (_Http,), {"sessions": Sessions(instance)}))


def serve_tcp(instance: Instance, host: str = "127.0.0.1", port: int = 7878) -> socketserver.ThreadingTCPServer:
    return _TcpServer((host, port), type("Tcp", (_Tcp,), {"instance": instance}))


@contextlib.contextmanager
def running(server: socketserver.BaseServer):
    """Serves in a thread for the time of a with block."""
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        yield server
    finally:
        server.shutdown()
        server.server_close()
        thread.join()
