"""Command line of campaigns: new, play, turn, status, history, recall, lore, serve, list.

Exit codes: 0, 1 when something is missing or failed, 130 on interrupt."""

from __future__ import annotations

import argparse
import sys

from tessera.backends import Echo, Http, setting
from tessera.cli import session
from tessera.operators.campaign import Campaign, campaigns


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--root", default=argparse.SUPPRESS)
    common.add_argument("--llm", choices=("echo", "http"), default=argparse.SUPPRESS)
    out = argparse.ArgumentParser(prog="tessera.play", parents=[common])
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, *rest: tuple[str, dict]) -> None:
        command = commands.add_parser(name, parents=[common])
        for flag, given in rest:
            command.add_argument(flag, **given)

    slug = ("slug", {})
    add("new", slug, ("--seed", {"required": True}), ("--opening", {}), ("--title", {"default": "Opening"}), ("--force", {"action": "store_true"}))
    add("play", slug)
    add("turn", slug, ("action", {"nargs": "+"}))
    add("status", slug)
    add("history", slug, ("--limit", {"type": int, "default": 15}))
    add("recall", slug, ("query", {"nargs": "+"}))
    add("lore", slug, ("paths", {"nargs": "+"}))
    add("serve", slug, ("--host", {"default": "127.0.0.1"}), ("--port", {"type": int, "default": 8090}))
    add("list")
    return out


def show(events) -> int:
    """Print a turn as it is told; 1 if it failed."""
    code = 0
    for event in events:
        if event["type"] == "token":
            print(event["text"], end="", flush=True)
        elif event["type"] == "error":
            print(event["error"], file=sys.stderr)
            code = 1
        elif event["type"] == "entry":
            print("\n" + "\n".join(f"{i}. {c}" for i, c in enumerate(event["entry"]["choices"], 1)))
        elif event["type"] == "turn":
            for note in event["notes"]:
                print(f"({note})")
    return code


def main(argv: list[str] | None = None, lines=None) -> int:
    args = parser().parse_args(argv)
    root = getattr(args, "root", setting("TESSERA_CAMPAIGNS", "campaigns")).rstrip("/")
    model = Http() if getattr(args, "llm", setting("TESSERA_LLM", "echo")) == "http" else Echo()
    spark = session()
    known = campaigns(spark, root)
    try:
        if args.command == "list":
            print("\n".join(known))
            return 0
        if args.command != "new" and args.slug not in known or args.command == "new" and args.slug in known and not args.force:
            print(f"there is {'already a' if args.command == 'new' else 'no'} campaign {args.slug}", file=sys.stderr)
            return 1
        game = Campaign(spark, f"{root}/{args.slug}", model)
        if args.command == "new":
            print(game.seed(args.seed))
            if args.opening:
                prose = "\n".join(r[0] for r in spark.read.text(args.opening, wholetext=True).collect())
                game.open_with(prose, args.title)
        elif args.command == "play":
            for line in lines if lines is not None else sys.stdin:
                if line.strip().lower() in ("exit", "quit", ":q"):
                    break
                if line.strip():
                    show(game.play(line))
        elif args.command == "turn":
            return show(game.play(" ".join(args.action)))
        elif args.command == "status":
            for key, value in game.status().items():
                print(f"{key}: {value}")
        elif args.command == "history":
            for turn in game.history(args.limit):
                print(f"{turn['n']}. {turn['title']} ({turn['words']} words)\n   {turn['summary'] or '(not yet distilled)'}")
        elif args.command == "recall":
            found = game.recall(" ".join(args.query))
            for hit in found:
                print(f"{hit['heading']}: {hit['text']}")
            return 0 if found else 1
        elif args.command == "lore":
            out = game.ingest_lore(args.paths)
            print(out)
            return 1 if out["missing"] else 0
        elif args.command == "serve":
            from tessera.server import serve_game

            serve_game(game, args.port, args.host).serve_forever()
        return 0
    except KeyboardInterrupt:
        return 130
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
