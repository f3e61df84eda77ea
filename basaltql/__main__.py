"""python -m basaltql [repl | serve | client] --root FOLDER: a prompt, the servers, or a prompt on a server's TCP port."""

from __future__ import annotations

import argparse
import json
import socket
import struct
import sys
from collections.abc import Callable

from basaltql.errors import EngineError


def loop(run: Callable[[str], str]) -> None:
    """Reads statements up to a semicolon at a line's end; the prompt shows on a terminal only."""
    prompt, text = ("> " if sys.stdin.isatty() else ""), ""
    while True:
        if prompt:
            print(prompt if not text else "  ", end="", flush=True)
        if not (line := sys.stdin.readline()):
            break
        text += line
        if text.strip().lower() in ("exit", "quit", "exit;", "quit;"):
            return
        if text.rstrip().endswith(";"):
            print(run(text))
            text = ""
    if text.strip():
        print(run(text))


def client(host: str, port: int) -> Callable[[str], str]:
    link = socket.create_connection((host, port))
    stream = link.makefile("rb")

    def run(text: str) -> str:
        data = text.encode()
        link.sendall(struct.pack("<I", len(data)) + data)
        out = json.loads(stream.read(struct.unpack("<I", stream.read(4))[0]))
        return json.dumps(out, indent=1)

    return run


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="basaltql", description=__doc__)
    p.add_argument("mode", nargs="?", default="repl", choices=("repl", "serve", "client"))
    p.add_argument("--root", default="basaltql-data", help="a folder that all executors share")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--http", type=int, default=8080)
    p.add_argument("--tcp", type=int, default=7878)
    p.add_argument("--auth", action="store_true")
    a = p.parse_args(argv)
    if a.mode == "client":
        return loop(client(a.host, a.tcp))

    import threading
    from pathlib import Path

    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from basaltql.server import serve_http, serve_tcp
    from basaltql.session import Instance

    root = a.root if ":" in a.root else str(Path(a.root).absolute())
    instance = Instance(SparkSession.builder.getOrCreate(), root, auth=a.auth)
    if a.mode == "serve":
        threading.Thread(target=serve_tcp(instance, a.host, a.tcp).serve_forever, daemon=True).start()
        return serve_http(instance, a.host, a.http).serve_forever()
    session = instance.session()

    def run(text: str) -> str:
        try:
            return "\n".join(r.grid() for r in session.results(text))
        except (EngineError, PySparkException) as e:
            return f"error: {e}"

    return loop(run)


if __name__ == "__main__":
    main()
