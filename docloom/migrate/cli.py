"""Command line: init, generate, check, migrate, rollback, sync, status, history."""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from docloom.migrate.model import Migration, MigrationError, check_chain, check_project, migration_id

DEFAULTS = {"migrations": "migrations", "schemas": "schemas.py", "store": "store", "power": "quick"}
CONFIG = "docloom.json"
PREFIX = "DOCLOOM_"


def load_config(folder: str) -> dict[str, Any]:
    """Defaults, then the file, then the environment; a broken file is an error."""
    path = Path(folder, CONFIG)
    found = json.loads(path.read_text()) if path.exists() else {}
    if unknown := set(found) - set(DEFAULTS):
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return DEFAULTS | found | {k: os.environ[PREFIX + k.upper()] for k in DEFAULTS if PREFIX + k.upper() in os.environ}


def _module(path: Path) -> Any:
    spec = importlib.util.spec_from_file_location(path.stem, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[path.stem] = module
    spec.loader.exec_module(module)
    return module


def discover(folder: str, config: dict[str, Any]) -> list[Migration]:
    """The migrations of the files in order of their names; each defines `migration`. Parents are known by module, so that files import each other."""
    place = Path(folder, config["migrations"])
    sys.path.insert(0, str(place))
    try:
        found = [_module(p).migration for p in sorted(place.glob("*.py")) if not p.name.startswith("_")]
    finally:
        sys.path.remove(str(place))
    return found


def chain(folder: str, config: dict[str, Any]) -> list[Migration]:
    report = check_chain(discover(folder, config))
    if report["errors"]:
        raise MigrationError("; ".join(report["errors"]))
    return report["order"]


def declared(folder: str, config: dict[str, Any]) -> Any:
    path = Path(folder, config["schemas"])
    return _module(path).schemas if path.exists() else None


def init(args: argparse.Namespace, config: dict[str, Any], say: Callable[[str], None]) -> int:
    place = Path(args.folder)
    if (place / CONFIG).exists() and not args.force:
        say(f"{place / CONFIG} exists; use --force to overwrite it")
        return 1
    (place / config["migrations"]).mkdir(parents=True, exist_ok=True)
    (place / CONFIG).write_text(json.dumps(DEFAULTS, indent=2) + "\n")
    if not (place / config["schemas"]).exists():
        (place / config["schemas"]).write_text("from docloom.migrate.model import Schemas\n\nschemas = Schemas()\n")
    say(f"wrote {CONFIG}, {config['migrations']}/ and {config['schemas']}")
    return 0


def generate(args: argparse.Namespace, config: dict[str, Any], say: Callable[[str], None]) -> int:
    found = discover(args.folder, config)
    report = check_chain(found, allow_branches=False)
    if found and report["errors"]:
        raise MigrationError("; ".join(report["errors"]))
    id = migration_id(args.name)
    file = id.replace("-", "_").replace("@", "_")
    last = report["order"][-1] if found else None
    files = sorted(Path(args.folder, config["migrations"]).glob("*.py"))
    head = f"from {files[-1].stem} import migration as parent\n" if last else ""
    body = "parent.schemas" if last else "Schemas()"
    text = f'''from docloom.migrate.model import Migration{"" if last else ", Schemas"}
{head}

def migrate(builder):
    return builder


migration = Migration("{id}", "{args.name}", {"parent" if last else "None"}, {body}, migrate)
'''
    Path(args.folder, config["migrations"], f"m{file}.py").write_text(text)
    say(id)
    return 0


def _session() -> Any:
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def _store(args: argparse.Namespace, config: dict[str, Any]) -> Any:
    from docloom.sources.store import Store

    place = config["store"]
    return Store(_session(), place if "://" in place or place.startswith("/") else str(Path(args.folder, place).resolve()))


def check(args: argparse.Namespace, config: dict[str, Any], say: Callable[[str], None]) -> int:
    from docloom.migrate.engine import simulate_all

    order = chain(args.folder, config)
    errors = check_project(declared(args.folder, config), order[-1]) if order and declared(args.folder, config) else []
    results = simulate_all(_session(), order, args.power or config["power"])
    for r in results[-args.last :] if args.last else results:
        for w in r["warnings"]:
            say(f"warning {r['id']}: {w}")
        errors += [f"{r['id']}: {e}" for e in r["errors"]]
    if args.check_indexes:
        errors += index_report(_store(args, config), order)
    for e in errors:
        say(f"error {e}")
    say(f"{len(order)} migrations, {len(errors)} errors")
    return int(bool(errors))


def index_report(store: Any, order: list[Migration]) -> list[str]:
    """Tables whose noted constraints differ from those that the last migration declares: collections, stores and models."""
    from docloom.operators.constraints import index_plan, wanted

    if not order:
        return []
    schemas, out = order[-1].schemas, []
    for name, entry in store.tables().items():
        about = entry.get("about", {})
        target = schemas.models.get(about.get("model")) or schemas.collections.get(name) or schemas.multi.get(name)
        if target is not None:
            plan = index_plan(about.get("indexes", {}), json.loads(json.dumps(wanted(target), default=str)))
            out += [f"{name}: index {i} has to be {what}" for what, names in (("created", plan["create"]), ("recreated", plan["recreate"]), ("dropped", plan["drop"])) for i in names]
    return out


def _sync(store: Any, order: list[Migration]) -> None:
    from docloom.operators.constraints import wanted

    if not order:
        return
    schemas = order[-1].schemas
    with store.unit_of_work():
        for name, entry in store.tables().items():
            target = schemas.models.get(entry.get("about", {}).get("model")) or schemas.collections.get(name) or schemas.multi.get(name)
            if target is not None:
                store.about(name, indexes=json.loads(json.dumps(wanted(target), default=str)))


def migrate(args: argparse.Namespace, config: dict[str, Any], say: Callable[[str], None]) -> int:
    from docloom.migrate import engine

    store, order = _store(args, config), chain(args.folder, config)
    for name, need in engine.catch_up_needed(store, order).items():
        if need["missing"]:
            say(f"{name} catches up: {', '.join(engine.catch_up(store, name, order))}")
    waiting = engine.pending(store, order)
    if not args.skip_check:
        for r in engine.simulate_all(store.spark, order, config["power"]):
            if r["errors"]:
                raise MigrationError(f"{r['id']}: {'; '.join(r['errors'])}")
    for m in waiting:
        if engine.operations_of(m).summary()["irreversible"] and not args.yes:
            say(f"{m.id} can't be reversed; use --yes to apply it")
            return 1
        engine.migrate(store, m)
        say(f"applied {m.id}")
    _sync(store, order)
    say("nothing is pending" if not waiting else f"{len(waiting)} applied")
    return 0


def rollback(args: argparse.Namespace, config: dict[str, Any], say: Callable[[str], None]) -> int:
    from docloom.migrate import engine

    store, order = _store(args, config), chain(args.folder, config)
    done = [m for m in order if engine.states(store).get(m.id) == "applied"]
    if not done:
        say("nothing is applied")
        return 1
    about = engine.operations_of(done[-1]).summary()
    if (about["irreversible"] or about["lossy"]) and not args.yes:
        say(f"{done[-1].id} {'can not be reversed' if about['irreversible'] else 'loses data when reversed'}; use --yes")
        return 1
    engine.rollback(store, done[-1])
    say(f"reverted {done[-1].id}")
    return 0


def sync(args: argparse.Namespace, config: dict[str, Any], say: Callable[[str], None]) -> int:
    from docloom.migrate import engine

    store, order = _store(args, config), chain(args.folder, config)
    waiting = engine.pending(store, order)
    if waiting and not args.force:
        say(f"{len(waiting)} migrations are pending; use --force to sync all the same")
        return 1
    _sync(store, order)
    say("constraints are as declared")
    return 0


def status(args: argparse.Namespace, config: dict[str, Any], say: Callable[[str], None]) -> int:
    from docloom.migrate import engine

    store = _store(args, config)
    order = chain(args.folder, config)
    report = engine.status(store, order, declared(args.folder, config), store.spark if args.validate else None)
    for m in order:
        say(f"{report['states'].get(m.id, 'pending'):9} {m.id}")
    for name, need in report["catch_up"].items():
        if need["missing"] or need["orphaned"]:
            say(f"instance {name}: missing {need['missing']}, {'orphaned' if need['orphaned'] else 'with history'}")
    for e in report["errors"]:
        say(f"error {e}")
    say("healthy" if report["healthy"] else "not healthy")
    return 0 if not report["errors"] else 1


def history(args: argparse.Namespace, config: dict[str, Any], say: Callable[[str], None]) -> int:
    from docloom.migrate import engine

    log = engine.history(_store(args, config))
    log = log.where(log.migration == args.id) if args.id else log
    counts: dict[str, int] = {}
    for r in log.orderBy("at").toLocalIterator():
        counts[r.operation] = counts.get(r.operation, 0) + 1
        say(f"{r.at} {r.operation:8} {r.migration}{' on ' + r.target if r.target else ''}{': ' + r.error if r.error else ''}")
    say(", ".join(f"{v} {k}" for k, v in sorted(counts.items())) or "no history")
    return 0


COMMANDS = {"init": init, "generate": generate, "check": check, "migrate": migrate, "rollback": rollback, "sync": sync, "status": status, "history": history}


def main(argv: list[str] | None = None, say: Callable[[str], None] = print) -> int:
    parser = argparse.ArgumentParser(prog="docloom")
    parser.add_argument("--folder", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = commands.add_parser(name)
        if name in ("init", "sync"):
            p.add_argument("--force", action="store_true")
        if name in ("migrate", "rollback"):
            p.add_argument("--yes", action="store_true")
        if name == "generate":
            p.add_argument("name")
        if name == "check":
            p.add_argument("--power", choices=["quick", "normal", "hard"])
            p.add_argument("--last", type=int, default=0)
            p.add_argument("--check-indexes", action="store_true")
        if name == "migrate":
            p.add_argument("--skip-check", action="store_true")
        if name == "status":
            p.add_argument("--validate", action="store_true")
        if name == "history":
            p.add_argument("--id")
    args = parser.parse_args(argv)
    try:
        return COMMANDS[args.command](args, load_config(args.folder), say)
    except (MigrationError, ValueError) as e:
        say(f"error {e}")
        return 1


if __name__ == "__main__":
    sys.exit(main())
