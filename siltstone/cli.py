"""Commands: index, query, status, lint."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from siltstone.catalog import Catalog, CatalogError
from siltstone.session import local_session
from siltstone.sinks import wiki
from siltstone.sources.settings import Settings, SettingsError

SAMPLE = 20


def _sample(df, column: str, name: str) -> dict:
    return {f"{name}_count": df.count(), f"{name}_sample": [r[0] for r in df.select(column).orderBy(column).limit(SAMPLE).collect()]}


def run(args: argparse.Namespace) -> tuple[int, dict]:
    """Exit code and answer of a command."""
    settings = Settings.load(args.env_file or (".env" if Path(".env").is_file() else None))
    if args.command == "query" and args.limit < 1:
        raise SettingsError("--limit must be above 0")
    catalog = Catalog(local_session("*"), settings)
    places = {"root": settings.root, "home": settings.home}
    pages_index = {"wiki_index": str(Path(settings.home, "wiki/index.md"))}
    answer: dict = {"command": args.command}
    if args.command == "index":
        synced = catalog.sync(args.retry_unreadable)
        counts = synced["counts"] | _sample(synced["changed"], "relative_path", "changed_path") | _sample(synced["removed"], "wiki_path", "removed_wiki_path")
        return 0, answer | places | {"retry_unreadable": args.retry_unreadable, "sync": counts, "compiled": catalog.compile(synced)} | pages_index
    if args.command == "query":
        results = [
            {"relative_path": r.relative_path, "source_path": r.absolute_path, "wiki_path": str(Path(settings.home, r.wiki_path).resolve()), "status": r.status, "excerpt": r.excerpt, "score": r.score}
            for r in catalog.search(args.question, args.limit).collect()
        ]
        wiki.append_log(settings.home, "Query", {"Question": args.question, "Retrieved pages": len(results)})
        return 0, answer | {"question": args.question, "results": results}
    if args.command == "status":
        counts = wiki.status_counts(catalog.entries).collect()
        number = {kind: sum(r.entries for r in counts if r.kind == kind) for kind in ("file", "directory")}
        by_status = {r.status: r.entries for r in sorted(counts) if r.kind == "file"}
        return 0, answer | places | {"files": number["file"], "directories": number["directory"], "extraction_status": by_status, "search_backend": "postings"} | pages_index
    issues = [r.message for r in catalog.lint().toLocalIterator()]
    return int(bool(issues)), answer | {"issues": issues, "ok": not issues}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone")
    parser.add_argument("--env-file")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "query", "status", "lint"):
        command = commands.add_parser(name)
        command.add_argument("--json", action="store_true")
        if name == "index":
            command.add_argument("--retry-unreadable", action="store_true")
        if name == "query":
            command.add_argument("question")
            command.add_argument("--limit", type=int, default=5)
    args = parser.parse_args(argv)
    try:
        code, payload = run(args)
    except (SettingsError, CatalogError) as e:
        print(f"Configuration error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(payload, indent=2) if args.json else "\n".join(f"{k}: {v}" for k, v in payload.items()))
    return code


if __name__ == "__main__":
    sys.exit(main())
