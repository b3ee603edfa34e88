"""``python -m tidelog.cli stats|inspect|compact|peek|version|help PATH [N]``."""

from __future__ import annotations

import json
import sys

VERSION = "0.1.0"
USAGE = __doc__


def main(args: list[str]) -> int:
    if not args or args[0] in ("help", "-h", "--help"):
        print(USAGE)
        return 0
    if args[0] == "version":
        print(VERSION)
        return 0
    if args[0] not in ("stats", "inspect", "compact", "peek") or len(args) < 2:
        print(USAGE, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .errors import NoMessages
    from .log import Log
    from .options import Options

    log = Log(SparkSession.builder.getOrCreate(), args[1], Options(min_free_bytes=0))
    if args[0] in ("stats", "inspect"):
        s = log.stats()
        if s["total"]:
            s["consumed"] = f"{(s['total'] - s['pending']) * 100 / s['total']:.1f}%"
        print(json.dumps(s) if args[0] == "inspect" else "\n".join(f"{k}: {v}" for k, v in s.items()))
    elif args[0] == "compact":
        from .options import SECOND, Retention

        print(json.dumps(log.compact(Retention(max_age=7 * 86_400 * SECOND))))
    else:
        try:
            for r in log.peek(int(args[2]) if len(args) > 2 else 10):
                print(r["msg_id"], r["ts"], bytes(r["payload"]).decode(errors="replace"), r["headers"])
        except NoMessages as e:
            print(e)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
