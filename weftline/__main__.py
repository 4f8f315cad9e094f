"""python -m weftline scan PATH | diff OLD NEW | context PATH FUNCTION..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from weftline.operators import context, export
from weftline.plans import cache
from weftline.plans import scan as plans
from weftline.session import build_session, ship
from weftline.sources import config as configs
from weftline.sources import documents, tree


def options(given: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="weftline")
    modes = top.add_subparsers(dest="mode", required=True)
    scan = modes.add_parser("scan", help="module graph of a directory, as JSON")
    scan.add_argument("path")
    scan.add_argument("--config", default=configs.FILE)
    scan.add_argument("--no-cache", action="store_true", help="parse every file")
    scan.add_argument("--dot", action="store_true", help="write a Graphviz file too")
    diff = modes.add_parser("diff", help="what differs between two saved graphs")
    diff.add_argument("old")
    diff.add_argument("new")
    near = modes.add_parser("context", help="source around changed functions, within a budget")
    near.add_argument("path")
    near.add_argument("functions", nargs="+", help="as <file>::<qualified name>")
    near.add_argument("--max-tokens", type=int, default=context.BUDGET)
    near.add_argument("--output", default="result/context.md")
    near.add_argument("--no-git-info", action="store_true")
    return top.parse_args(given)


def run(spark, args: argparse.Namespace) -> int:
    if args.mode == "diff":
        print(plans.diff_text(plans.diff_files(spark, args.old, args.new)))
        return 0
    if tree.is_exist(args.path) != "exists":
        print(f"{tree.is_exist(args.path)}: {args.path}", file=sys.stderr)
        return 1
    if args.mode == "context":
        try:
            found = plans.context_bundle(spark, args.path, args.functions, args.max_tokens, git=not args.no_git_info)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        at = Path(args.output)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(found["bundle"])
        print(f"{at}: {len(found['included_full'])} in full, {len(found['included_stub'])} as stubs, {len(found['omitted'])} omitted, some {found['estimated_tokens']} tokens")
        return 0
    config = configs.load(args.config)
    if args.no_cache:
        result = plans.scan(spark, args.path, config)
    else:
        where = config["scan"]["cache_path"]
        result, counts = plans.rescan(spark, args.path, *cache.load(spark, where), config)
        print(", ".join(f"{k}: {v}" for k, v in counts.first().asDict().items()))
        cache.save(result["all_files"], result["all_facts"], where)
    documents.save_document(documents.document(result), config["scan"]["output_path"])
    print(config["scan"]["output_path"])
    if args.dot:
        shown = result["unresolved"] if config["output"]["include_unresolved_in_dot"] else None
        documents.save_lines(export.dot_lines(result["files"], result["imports"], tree.resolved_root(args.path), shown), config["output"]["dot_path"])
        print(config["output"]["dot_path"])
    return 0


if __name__ == "__main__":
    chosen = options()
    session = build_session()
    ship(session)
    sys.exit(run(session, chosen))
