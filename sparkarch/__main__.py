"""Command line: ``python -m sparkarch PATH [--layer NAME | --file FILE] [--output FILE] [--quiet]``.

Exit codes: 0 done, 1 analysis failed, 2 wrong arguments, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkarch", description="Analyse a source tree.")
    parser.add_argument("path")
    one = parser.add_mutually_exclusive_group()
    one.add_argument("--layer")
    one.add_argument("--file")
    parser.add_argument("--output")
    parser.add_argument("--quiet", action="store_true")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if not os.path.isdir(args.path):
        print(f"not a folder: {args.path}", file=sys.stderr)
        return 2
    from .plans.project import Project
    from .session import session
    from .storage import new_path

    try:
        spark = session()
        project = Project(spark, os.path.abspath(args.path), new_path(spark, "state"))
        out = project.analyze_project()
        if args.layer:
            out = project.analyze_layer(args.layer)
        elif args.file:
            out = project.analyze_single_file(args.file)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # the command line's edge
        print(f"failed: {e}", file=sys.stderr)
        return 1
    text = json.dumps(out, indent=2, sort_keys=True, default=str)
    if args.output:
        with open(args.output, "w") as f:
            f.write(text + "\n")
    if not args.quiet:
        print(text)
    return 1 if out.get("status") == "error" else 0


if __name__ == "__main__":
    sys.exit(main())
