"""A thin command line: ``python -m docweir.plans.cli COMMAND``. 0: done, 1: problems, 2: a bad mapping, 130: interrupted."""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import functions as F

from docweir.operators import linkage, probe, render, state, status
from docweir.session import session
from docweir.sources.config import ConfigError, Mappings
from docweir.sources.sqlite import sqlite_table
from docweir.sources.tables import store_table

from . import pipeline
from .control import Control, Stopped

#: Options by name, as ``add_argument`` takes them.
OPTIONS: dict[str, dict] = {
    "label": {},
    "limit": {"type": int},
    "offset": {"type": int, "default": 0},
    "force_full_sync": {"action": "store_true"},
    "dry_run": {"action": "store_true"},
    "yes": {"action": "store_true"},
}
# The options of each command, in order.
COMMANDS = {
    "run": ("label", "limit", "dry_run", "yes"),
    "scan": ("label", "limit"),
    "prune": ("label", "dry_run", "yes"),
    "fetch": ("label", "limit", "force_full_sync"),
    "discover": ("label", "limit", "force_full_sync"),
    "fetch-pending": ("label", "limit", "offset"),
    "convert-pending": ("label", "limit", "offset"),
}
#: The commands that run here; the others are those of the message store.
OWN = ("scan", "run", "prune")


def held_table(spark, path: str, name: str):
    """A message store's table: of an SQLite file, or a folder of Parquet files."""
    return sqlite_table(spark, path, name) if path.endswith((".db", ".sqlite", ".sqlite3")) else store_table(spark, path, name)


def _with_options(p: argparse.ArgumentParser, command: str, **more) -> argparse.ArgumentParser:
    for name in COMMANDS.get(command, ()):
        p.add_argument(f"--{name.replace('_', '-')}", **OPTIONS[name], **more.get(name, {}))
    return p


def command_line(program: str, command: str, params: dict) -> str:
    """The text of a command: each of its options whose value is not the one that it has anyway."""
    known = _with_options(argparse.ArgumentParser(add_help=False), command)
    plain = vars(known.parse_args([]))
    changed = {a.dest: a for a in known._actions if params.get(a.dest) is not None and params[a.dest] != plain[a.dest]}
    shown = lambda v: f'"{v}"' if re.search("[ ,]", str(v)) else str(v)
    return " ".join([program, command, *(" ".join([*a.option_strings, *([] if a.nargs == 0 else [shown(params[name])])]) for name, a in changed.items())])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docweir")
    p.add_argument("--mappings", default="mappings.json")
    p.add_argument("--state", default="state")
    p.add_argument("--buckets", type=int, default=16, help="buckets of a new state: thousands for a large archive")
    p.add_argument("--messages", default="messages.parquet")
    p.add_argument("--message-labels", default="message_labels.parquet", help="which message is under which labels")
    p.add_argument("--pages", default="pages.parquet", help="page table with url and html")
    p.add_argument("--raw", default="output/raw")
    p.add_argument("--markdown", default="output/markdown")
    p.add_argument("--published", default="")
    sub = p.add_subparsers(dest="command", required=True)
    for name in OWN:
        _with_options(sub.add_parser(name), name, label={"required": True})
    sub.add_parser("list")
    sub.add_parser("validate")
    one = sub.add_parser("probe")
    one.add_argument("url")
    one.add_argument("--second", default="", help="the address of the listing's second page, to see whether it brings anything new")
    one.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return _run(args)
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    except pipeline.ListingError as e:
        print(e, file=sys.stderr)
        return 1
    except (KeyboardInterrupt, Stopped):
        return 130


def _run(args: argparse.Namespace) -> int:
    mappings = Mappings(args.mappings)
    all_mappings = mappings.all()
    spark = session()
    store = state.StateStore(spark, args.state, args.buckets)
    folders = pipeline.Folders(args.raw, args.markdown, args.published)
    if args.command == "list":
        states = status.mapping_states(mappings.frame(spark).select("label_name").distinct(), store.read("articles"))
        shown = mappings.frame(spark).join(states, "label_name").orderBy("label_name", "source_index")
        shown.select("label_name", "label_id", "display_name", "archive_url", "mode", "sender", "summary").show(200, False)
        return 0
    if args.command == "validate":
        found = pipeline.validate(mappings.frame(spark).select("label_name", "label_id").distinct(), held_table(spark, args.message_labels, "message_labels"))
        found.orderBy("label_name").show(40, False)
        return int(found.where("problem <> ''").count() > 0)
    pages = spark.read.parquet(args.pages)
    if args.command == "probe":
        found = probe.report(pages.where(F.col("url") == args.url)).withColumn("second_page", probe.second_page(pages, args.url, args.second))
        rows = found.limit(1).toJSON().collect()
        for row in rows:
            print(json.dumps(json.loads(row), indent=2, ensure_ascii=False) if args.json else probe.readable(json.loads(row)))
        return 0 if rows else 1
    m = next((x for x in all_mappings if x.label_name == args.label), None)
    if m is None:
        raise ConfigError(f"no mapping for {args.label!r}")
    if args.command == "prune":
        plan = pipeline.prune_label(spark, args.label, store, folders, dry_run=True)
        print(plan)
        if not args.dry_run and (args.yes or input("Delete? [y/N] ").strip().lower() == "y"):
            print(pipeline.prune_label(spark, args.label, store, folders, dry_run=False))
        return 0
    messages, bridge = held_table(spark, args.messages, "messages"), held_table(spark, args.message_labels, "message_labels")
    index = pipeline.corpus(pipeline.held_messages(messages, bridge, m.label_id), render.read_headers(spark, folders.markdown), m.label_name)
    if args.command == "scan":
        entries = pipeline.scan(pipeline.read_listing(spark, m, pages, args.limit), index, store.read("articles"), m.label_name)
        shown, more = status.preview(entries, linkage.display_keys())
        shown.select("status", F.date_format("published_at", "yyyy-MM-dd").alias("date"), "title", "match_reason").show(40, 88)
        if more:
            print(f"... and {more} more")
        counted = linkage.summary(entries).first()
        print(f"{counted.listed} listed, {counted.held} held, {counted.missing} missing")
        return 0
    if not args.dry_run and not args.yes and input("Write? [y/N] ").strip().lower() != "y":
        return 0
    control = Control(spark, lambda p: print(p.stage, *(f"{k}={v}" for k, v in p.counts.items()), file=sys.stderr))
    got = control.run("run", lambda c: pipeline.run(spark, m, pages, index, store, folders, args.limit, args.dry_run, c))
    print(got)
    return int(got.failed > 0)


if __name__ == "__main__":
    sys.exit(main())
