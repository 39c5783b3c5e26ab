"""Command line: ``python -m seekloom init|update|status|search|helpers``.

``init`` and ``update`` read a local folder (``--root``) into a catalog (``--store``, on any file system that
Spark reads); ``search`` prints a line for each match. A command that fails says why and ends with status 2.
"""

from __future__ import annotations

import argparse
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.catalog import Catalog
from .plans.session import Request
from .plans.store import NoGeneration
from .sources.files import mixed

HELPER = "pdftotext"


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="seekloom")
    commands = made.add_subparsers(dest="command", required=True)
    for name in ("init", "update", "status", "search"):
        one = commands.add_parser(name)
        one.add_argument("--store", required=True)
        if name in ("init", "update"):
            one.add_argument("--root", required=True)
        if name == "search":
            one.add_argument("content", nargs="?", default="")
            one.add_argument("--file", default="")
            one.add_argument("--kind", choices=("literal", "regex", "wildcard"), default="literal")
            one.add_argument("--full-path", action="store_true")
            one.add_argument("--case-sensitive", action="store_true")
            one.add_argument("--max-files", type=int, default=100)
    commands.add_parser("helpers")
    return made


def _folder(root: str, store: str) -> str:
    """The folder to read, which must not hold the store: a scan would find the catalog's own files."""
    folder = Path(root).resolve()
    if not folder.is_dir():
        raise ValueError(f"{root} is not a folder")
    if Path(store.removeprefix("file://")).resolve().is_relative_to(folder):
        raise ValueError("the store must not be inside the folder that is read")
    return str(folder)


def _line(word: str, values: dict) -> str:
    return " ".join([word, *(f"{k}={v}" for k, v in values.items())])


def run(args: argparse.Namespace, spark: SparkSession) -> list[str]:
    catalog = Catalog(spark, args.store)
    if args.command == "init":
        if catalog.store.generations():
            raise ValueError("the store has a catalog already")
        catalog.initialise(*mixed(spark, _folder(args.root, args.store)))
        return [_line("initialised", catalog.load().status())]
    if args.command == "update":
        made = catalog.reconcile(*mixed(spark, _folder(args.root, args.store)))
        return [_line("updated" if made else "unchanged", catalog.load().status())]
    if args.command == "status":
        return [_line("status", catalog.load().status())]
    asked = Request(args.file, args.content, args.kind, args.full_path, args.case_sensitive, args.max_files)
    rows = catalog.load().search(asked).collect()  # at most max_files rows, with a few matches each
    return [line for r in rows for line in ([f"{r.path}: {m.location}: {m.preview}" for m in r.matches] or [r.path])]


def helpers() -> list[str]:
    program = shutil.which(HELPER)
    if not program:
        return [f"{HELPER}: not found"]
    done = subprocess.run([program, "-v"], capture_output=True, text=True, timeout=30)
    said = (done.stderr or done.stdout).strip().splitlines()
    return [f"{HELPER}: {program} ({said[0] if said else 'no version'})"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        lines = helpers() if args.command == "helpers" else run(args, spark or SparkSession.builder.appName("seekloom").getOrCreate())
    except (ValueError, OSError, NoGeneration) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print("\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
