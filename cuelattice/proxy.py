"""Command line of the caching proxy before a model server."""

from __future__ import annotations

import argparse
import os
import sys

from cuelattice.sources.chat import Answers, Proxy, Upstream


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="cuelattice-proxy", description=__doc__)
    made.add_argument("--host", default="127.0.0.1")
    made.add_argument("--port", type=int, default=8790)
    made.add_argument("--upstream-url", required=True, help="address of the model server")
    made.add_argument("--api-key-env", default="LLM_API_KEY", help="variable that holds the server's key")
    made.add_argument("--db", default="./answers.db", help="file that keeps the answers")
    made.add_argument("--default-model", help="model to name where the server lists none")
    made.add_argument("--quiet", action="store_true", help="do not show each request")
    return made


def main(argv: list[str] | None = None, wait: bool = True) -> int:
    args = parser().parse_args(argv)
    upstream = Upstream(args.upstream_url, os.environ.get(args.api_key_env))
    with Answers(args.db) as store:
        proxy = Proxy(upstream, store, upstream.models, args.default_model, None if args.quiet else print)
        server = proxy.serve(args.host, args.port)
        print(f"http://{args.host}:{server.server_address[1]}", flush=True)
        try:
            while wait:
                server._BaseServer__is_shut_down.wait(3600)
        except KeyboardInterrupt:
            pass
        finally:
            server.shutdown()
            server.server_close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
