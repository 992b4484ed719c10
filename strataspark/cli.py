"""Command line: analyze, extract, report, history, generate, interactive, version."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import threading
import uuid

from . import __version__, config, engine, history, plugins, report
from .operators import score
from .session import shared_dir
from .sources import events
from .streaming import watch

COMMANDS = ("analyze", "extract", "generate", "help", "history", "interactive", "report", "version")
HINTS = (("not a directory", "Give a directory"), ("no such file", "See whether the path exists"), ("permission denied", "See whether you may read the path"), ("no supported language", "There are Go, Python, JavaScript and TypeScript"), ("unknown settings", "See the names in the configuration"), ("is not yaml", "See the configuration's syntax"))


def hint(message: str) -> str:
    low = message.lower()
    return next((h for key, h in HINTS if key in low), "See --help")


def closest(command: str) -> str:
    return next((c for c in COMMANDS if command and (c[0] == command[0] or command in c)), "")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataspark")
    sub = p.add_subparsers(dest="command")
    a = sub.add_parser("analyze", help="score a repository")
    a.add_argument("place", nargs="?", default=".")
    a.add_argument("-path", "--path", dest="path")
    a.add_argument("-format", "--format", choices=("text", "json", "json-v1"), default="text")
    a.add_argument("-json", "--json", action="store_const", const="json", dest="format")
    a.add_argument("-verbose", "--verbose", action="store_true")
    a.add_argument("-no-color", "--no-color", action="store_true")
    a.add_argument("-config", "--config", default="strataspark.yaml")
    a.add_argument("-resolve", "--resolve", action="store_true", help="follow imports to files")
    a.add_argument("-history", "--history", default="", help="folder to keep scores in")
    a.add_argument("-watch", "--watch", action="store_true", help="analyse again after each burst of changes, until a signal")
    a.add_argument("-explain", "--explain", action="store_true", help="say what each kind of violation costs")
    e = sub.add_parser("extract", help="list Go imports")
    e.add_argument("-path", "--path", default=".")
    e.add_argument("-module", "--module", default="")
    e.add_argument("-verbose", "--verbose", action="store_true")
    e.add_argument("-json", "--json", action="store_true")
    r = sub.add_parser("report", help="print a saved report")
    r.add_argument("file")
    r.add_argument("-format", "--format", choices=("text", "json"), default="text")
    h = sub.add_parser("history", help="show the trend")
    h.add_argument("folder")
    g = sub.add_parser("generate", help="write a rule's template")
    g.add_argument("kind", choices=("rule",))
    g.add_argument("name")
    g.add_argument("--folder", default="rules")
    i = sub.add_parser("interactive", help="change settings in a menu")
    i.add_argument("-config", "--config", default="strataspark.yaml")
    sub.add_parser("version")
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("strataspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run_analyze(args, spark=None) -> int:
    """2 where violations call for it, 3 where a rule failed, so that the score says too little; else 0."""
    spark = spark or session()
    cfg = config.load(args.config)
    done = engine.analyze(spark, args.path or args.place, cfg, resolve=args.resolve)
    found = report.build(done.root, done.language, done.violations, done.score)
    if args.format == "text":
        sys.stdout.write(report.text(found, not args.no_color and report.wants_color()))
    else:
        sys.stdout.write(report.json_v1(found) if args.format == "json-v1" else report.json_v2(found))
    if getattr(args, "explain", False):
        print(score.explained(found["score"]), file=sys.stderr)
    for rule, why in done.outcome.failed.items():
        print(f"{rule} failed, its violations are missing: {why}", file=sys.stderr)
    if args.verbose and not done.outcome.failed:
        print("all rules ran", file=sys.stderr)
    if args.history:
        print(history.summary(history.load(spark, args.history), found["score"]["total"]), file=sys.stderr)
        history.append(spark, args.history, found["score"]["total"])
    return 3 if done.outcome.failed else found["score"]["exit_code"]


def run_watch(args, spark=None, stopped: threading.Event | None = None) -> int:
    """Analyse now and after each burst of changes; ends at SIGINT or SIGTERM, or when ``stopped`` is set."""
    spark = spark or session()
    if stopped is None:
        stopped = threading.Event()
        for number in (signal.SIGINT, signal.SIGTERM):
            signal.signal(number, lambda *_: stopped.set())
    last = run_analyze(args, spark)
    stream = events.stream(spark, args.path or args.place)
    checkpoint = f"{shared_dir(spark).rstrip('/')}/watch-{uuid.uuid4().hex}"

    def again(_: str) -> int:
        nonlocal last
        last = run_analyze(args, spark)
        return last

    query = watch.run_on_bursts(stream, again, checkpoint)
    try:
        while not stopped.wait(0.2):
            if query.exception() is not None:
                raise ValueError(f"watching ended: {query.exception()}")
    finally:
        query.stop()
    return last


def run_extract(args, spark=None) -> int:
    rows = engine.extract(spark or session(), args.path, args.module).orderBy("path", "import")
    last = None
    for row in rows.toLocalIterator():
        if args.json:
            print(json.dumps(row.asDict(), ensure_ascii=False))
            continue
        if row.path != last:
            last = row.path
            print(f"{row.path} (package {row.package})" + (f"\n  at {os.path.abspath(os.path.join(args.path, row.path))}" if args.verbose else ""))
        print(f"  {row['import'] or '(no external imports)'}")
    total = engine.extract_totals(rows).first()
    print(f"{total.files} files, {total.imports} imports", file=sys.stderr if args.json else sys.stdout)
    return 0


NUMBERS = {"3": ("size", "max_file_lines"), "4": ("size", "max_function_lines"), "5": ("god_object", "max_fields"), "6": ("god_object", "max_methods")}


def run_interactive(args, ask=input) -> int:
    """A menu over the settings: two switches, four limits, save."""
    cfg = config.load(args.config)
    while True:
        print("1 size rule on/off, 2 god-object rule on/off, " + ", ".join(f"{k} {n} ({cfg[s][n]})" for k, (s, n) in NUMBERS.items()) + ", 7 save, 0 leave")
        try:
            choice = ask("> ").strip()
            if choice in ("1", "2"):
                part, rule = (("size", "enable_size_rule"), ("god_object", "enable_god_object_rule"))[choice == "2"]
                cfg[part]["enabled"] = cfg["rules"][rule] = not cfg["rules"][rule]
            elif choice in NUMBERS:
                part, name = NUMBERS[choice]
                if (value := int(ask(f"{name}: "))) > 0:
                    cfg[part][name] = value
            elif choice == "7":
                config.save(cfg, args.config)
            elif choice == "0":
                return 0
        except ValueError:
            print("a number above 0 is needed")
        except EOFError:
            return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and not argv[0].startswith("-") and argv[0] not in COMMANDS:
        print(f"no command {argv[0]!r}" + (f"; is it {near}?" if (near := closest(argv[0])) else ""), file=sys.stderr)
        return 1
    if not argv or argv[0] == "help":
        parser().print_help()
        return 0
    args = parser().parse_args(argv)
    try:
        if args.command == "analyze":
            return run_watch(args) if args.watch else run_analyze(args)
        if args.command == "extract":
            return run_extract(args)
        if args.command == "report":
            with open(args.file, encoding="utf-8") as f:
                content = f.read()
            print(content if args.format == "json" else f"--- {args.file}\n{content}\n---")
        elif args.command == "history":
            print(history.summary(history.load(session(), args.folder), 0.0))
        elif args.command == "generate":
            print("\n".join(plugins.generate(args.name, args.folder)))
        elif args.command == "interactive":
            return run_interactive(args)
        elif args.command == "version":
            print(__version__)
    except (OSError, ValueError) as error:
        print(f"{error}\n{hint(str(error))}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
