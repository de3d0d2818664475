"""blockflow run | validate | test --script FILE [--params JSON] [--hook URL] [-v | -vv]"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.engine import run_script
from .runtime.forward import ChatHandler
from .runtime.session import session


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="blockflow", description=__doc__)
    p.add_argument("verb", choices=("run", "validate", "test"))
    p.add_argument("--script", required=True)
    p.add_argument("--params", default="{}", help="script options as a JSON object")
    p.add_argument("--hook", help="a chat's web hook that log lines go to as well")
    p.add_argument("-v", action="count", default=0)
    a = p.parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.v, 2)])
    path = Path(a.script)
    params = {k: float(v) if isinstance(v, int) else v for k, v in json.loads(a.params).items()}
    log = logging.getLogger("blockflow")
    chat = ChatHandler(a.hook) if a.hook else logging.NullHandler()
    log.addHandler(chat)
    try:
        run_script(spark or session(), path.read_text(encoding="utf-8"), mode=a.verb, base=path.parent, params=params)
    except Exception as e:  # the command reports and fails
        log.error("%s", e)
        return 1
    finally:
        log.removeHandler(chat)
        chat.close()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
