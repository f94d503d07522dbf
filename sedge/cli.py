"""Command line: python -m sedge.cli --config FILE migrations add NAME | list | remove | repair | has-pending-changes,
database update [--down N] | script.

The config file is Python and defines project() -> sedge.migrations.Project.
"""

from __future__ import annotations

import argparse
import importlib.util
import sys

from sedge.errors import SedgeError
from sedge.migrations import Project


def load(path: str) -> Project:
    spec = importlib.util.spec_from_file_location("sedge_config", path)
    if spec is None or spec.loader is None:
        raise SedgeError(f"cannot read {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.project()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="sedge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--config", default="sedge_config.py")
    groups = top.add_subparsers(dest="group", required=True)
    m = groups.add_parser("migrations").add_subparsers(dest="command", required=True)
    m.add_parser("add").add_argument("name")
    for name in ("list", "remove", "repair", "has-pending-changes"):
        m.add_parser(name)
    d = groups.add_parser("database").add_subparsers(dest="command", required=True)
    d.add_parser("update").add_argument("--down", type=int, default=0)
    groups.add_parser("script")
    args = top.parse_args(argv)
    try:
        return _run(load(args.config), args)
    except SedgeError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1


def _run(project: Project, args: argparse.Namespace) -> int:
    if args.group == "script":
        print(project.script(), end="")
    elif args.group == "database":
        done = project.runner().down(args.down) if args.down else project.runner().up()
        print("\n".join(done) if done else "nothing to do")
    elif args.command == "add":
        made = project.add(args.name)
        print(made.id if made else "no changes")
        for o in made.up if made else ():
            if o.destructive:
                print(f"warning: {o.kind} on {o.table} loses data", file=sys.stderr)
    elif args.command == "list":
        for i, done in project.list():
            print(f"{'x' if done else ' '} {i}")
    elif args.command == "remove":
        print(project.remove() or "no migrations")
    elif args.command == "repair":
        print("snapshot had drifted" if project.repair() else "snapshot is up to date")
    else:
        changed = project.has_pending_changes()
        print("yes" if changed else "no")
        return int(changed)
    return 0


if __name__ == "__main__":
    sys.exit(main())
