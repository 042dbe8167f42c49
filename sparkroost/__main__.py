"""Command lines: ``python -m sparkroost generate|check|score|process``."""

from __future__ import annotations

import argparse
import sys

from . import session, submission
from .sources.readers import SPLITS


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparkroost")
    out.add_argument("--master")
    kinds = out.add_subparsers(dest="kind", required=True)
    needs = {
        "generate": ["config", "datasets", "split", "folder"],
        "check": ["predictions", "config", "datasets", "split"],
        "score": ["predictions", "router"],
        "process": ["predictions", "config", "datasets", "split", "router", "runs", "run_id"],
    }
    for kind, names in needs.items():
        own = kinds.add_parser(kind)
        for name in names:
            own.add_argument(name, **({"choices": list(SPLITS)} if name == "split" else {}))
        if kind == "check":
            own.add_argument("--generated", action="store_true", help="look at the generated results too")
            own.add_argument("--prices", help="a price file that must have all used models")
    return out


def main(arguments: list[str] | None = None) -> int:
    given = vars(parser().parse_args(arguments))
    spark, kind = session.create(given.pop("master")), given.pop("kind")
    out = getattr(submission, kind)(spark, **given)
    if out is not None:
        out.show(20, truncate=False)
    return int(kind == "check" and not out.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
