"""Command line: ``python -m stratum.cli --root DIR COMMAND ...``.

Exit codes: 0 done, 1 failed or not all well, 2 wrong use, 3 a save, a comparison of texts or a change of spaces failed, 130 cancelled.
Meta and note are in the same commit as the snapshot, so they can't fail by themselves (the codes 4 and 5 of other tools).
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.errors import PySparkException

from stratum.functions import ids
from stratum.operators import diffs
from stratum.repo import Repo
from stratum.session import session


#: Lines shown at most of lists that are only there to look at.
CAPS = {"tidy": 50, "chunks": 30, "verify": 200}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratum", description="snapshots of file trees")
    p.add_argument("--root", default=".stratum", help="where the tables are")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *aliases: str, space: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, aliases=aliases)
        c.set_defaults(command=name)
        if space:
            c.add_argument("--space")
        return c

    def hydrate(c: argparse.ArgumentParser) -> None:
        c.add_argument("--hydrate", nargs="?", const="persist", type=lambda x: {"": "persist", "yes": "persist", "tmp": "ephemeral"}.get(x.strip().lower(), x.strip().lower()), choices=["persist", "ephemeral"])

    command("init", space=False)
    c = command("space", space=False)
    c.add_argument("action", choices=["list", "create", "use", "rename", "current", "delete"])
    c.add_argument("names", nargs="*")
    c = command("save", "s")
    c.add_argument("source")
    c.add_argument("-m", "--message", default="")
    mode = c.add_mutually_exclusive_group()
    mode.add_argument("-c", "--compact", "--compact-speed", action="store_const", const="compact", default="full", dest="mode")
    mode.add_argument("--compact-full", action="store_const", const="compact-full", dest="mode")
    c.add_argument("--hash-none", action="store_true")
    c = command("import", "imp")
    c.add_argument("source")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("-m", "--message", default="")
    c = command("recompose", "rc")
    c.add_argument("--src", "--from", "--source", nargs="+", required=True, dest="sources")
    c.add_argument("-m", "--message", default="")
    hydrate(c)
    c = command("history", "hist", "log")
    c.add_argument("--take", type=int)
    c.add_argument("--since", type=ids.parse_time)
    c.add_argument("--before", type=ids.parse_time)
    c.add_argument("--match")
    c.add_argument("--size", "--bytes", action="store_true")
    c = command("note")
    c.add_argument("words", nargs="*", metavar="[space] [id]")
    mode = c.add_mutually_exclusive_group()
    mode.add_argument("--view", action="store_true")
    mode.add_argument("--append")
    mode.add_argument("--overwrite")
    mode.add_argument("--clear", action="store_true")
    c = command("export")
    c.add_argument("selectors", nargs="*", default=["@0"])
    c.add_argument("--to", "--dest", required=True, dest="dest")
    c.add_argument("--overwrite", action="store_true")
    c = command("restore")
    where = c.add_mutually_exclusive_group()
    where.add_argument("--id")
    where.add_argument("--back", "--offset", type=int, default=0)
    c.add_argument("--to", "--dest", required=True, dest="dest")
    c.add_argument("--purge", action="store_true")
    hydrate(c)
    c = command("pick")
    c.add_argument("snapshot")
    c.add_argument("selector")
    c.add_argument("out")
    c = command("hydrate")
    one = c.add_mutually_exclusive_group(required=True)
    one.add_argument("--latest", type=int)
    one.add_argument("--ago")
    one.add_argument("--before", type=ids.parse_time)
    one.add_argument("--id")
    one.add_argument("--match", nargs="+")
    c.add_argument("--rm-manifest", "--remove-manifest", action="store_true")
    c = command("compact")
    one = c.add_mutually_exclusive_group(required=True)
    one.add_argument("--keep", type=int)
    one.add_argument("--latest", type=int)
    one.add_argument("--before", type=ids.parse_time)
    c.add_argument("--full", action="store_true")
    c = command("tidy")
    one = c.add_mutually_exclusive_group(required=True)
    one.add_argument("--keep", type=int)
    one.add_argument("--latest", "--newest", type=int)
    one.add_argument("--before", type=ids.parse_time)
    one.add_argument("--match", action="append")
    c.add_argument("--dry-run", "--dry", action="store_true")
    c.add_argument("--no-gc", action="store_true")
    c = command("cache-meta-gc")
    c.add_argument("--keep", type=int, default=30)
    c = command("verify")
    c.add_argument("ids", nargs="*")
    c.add_argument("--policy", choices=["error", "skip", "hydrate", "temp"], default="error")
    c.add_argument("--only-bad", action="store_true")
    c.add_argument("--show-details", action="store_true")
    for name, aliases in (("diff", ()), ("textdiff", ("tdiff", "td"))):
        c = command(name, *aliases)
        c.add_argument("a")
        c.add_argument("b")
        if name == "diff":
            c.add_argument("--content", action="store_true")
        else:
            c.add_argument("--include", action="append")
            c.add_argument("--exclude", action="append")
    command("stats", space=False)
    c = command("tree")
    c.add_argument("snapshot", nargs="?", default="@0")
    return p


def run(args: argparse.Namespace, repo: Repo) -> int:
    """Prints what the command gives; 1 if some of it failed."""
    show: Callable = lambda df, n=200: df.show(n, truncate=False)
    c = args.command
    if c == "init":
        repo.init()
    elif c == "space":
        if len(args.names) != {"create": 1, "use": 1, "delete": 1, "rename": 2}.get(args.action, 0):
            raise ValueError(f"space {args.action}: wrong number of names")
        out = getattr(repo, f"space_{args.action}")(*args.names)
        show(out) if args.action == "list" else print(out if out is not None else args.names[0])
    elif c == "save":
        print(repo.save(args.source, args.space, args.mode, "none" if args.hash_none else "sha256", args.message))
    elif c == "import":
        print(repo.import_(args.source, args.space, args.dry_run, args.message))
    elif c == "recompose":
        print(repo.recompose(args.sources, args.space, args.message, args.hydrate))
    elif c == "history":
        show(repo.history(args.space, args.take, args.since, args.before, args.match, args.size))
    elif c == "note":
        changes = args.append is not None or args.overwrite is not None or args.clear
        space, snapshot = ids.space_and_selector(args.words, args.space)
        if snapshot is None:
            if changes or args.view:
                raise ValueError("which snapshot?")
            show(repo.notes(space).select("snapshot_id"))
            return 0
        note = repo.note(snapshot, space, args.append, args.overwrite, args.clear)
        print("no note" if note is None else note)
        return int(note is None)
    elif c in ("export", "hydrate", "compact"):
        if c == "export":
            out = repo.export(args.selectors, args.dest, args.space, args.overwrite)
        elif c == "hydrate":
            out = repo.hydrate(args.space, args.latest, args.before, args.id, args.match, args.ago, args.rm_manifest)
        else:
            out = repo.compact(args.space, args.keep, args.latest, args.before, args.full)
        show(out)
        counts = repo.summary(out)
        print(", ".join(f"{status} {n}" for status, n in counts.items()))
        return int(any(counts.get(x) for x in ("ERROR", "FAILED")))
    elif c == "restore":
        print(repo.restore(args.id or f"@{args.back}", args.dest, args.space, args.purge, args.hydrate))
    elif c == "pick":
        print(repo.pick(args.snapshot, args.selector, args.out, args.space))
    elif c == "tidy":
        if args.dry_run:
            show(repo.tidy_targets(args.space, args.keep, args.latest, args.before, args.match), CAPS["tidy"])
            if not args.no_gc:
                show(repo.tidy_chunks(args.space, args.keep, args.latest, args.before, args.match), CAPS["chunks"])
        show(repo.tidy(args.space, args.keep, args.latest, args.before, args.match, args.dry_run, not args.no_gc))
    elif c == "cache-meta-gc":
        show(repo.cache_meta_gc(args.space, args.keep))
    elif c == "verify":
        out = repo.verify(args.space, args.ids, args.policy)
        counts = repo.verify_counts(out).first().asDict()
        print("\n".join(f"{k.replace('_', '-'):18}: {n}" for k, n in counts.items()))
        bad = counts["total"] - counts["ok"] - counts["hydrated_ok"] - counts["skip_missing"]
        if args.show_details or bad:
            show(out.where("status <> 'OK'") if args.only_bad else out, counts["total"] if args.show_details else CAPS["verify"])
        return int(bad > 0)
    elif c == "diff":
        show(repo.diff(args.a, args.b, args.space, args.content))
    elif c == "textdiff":
        for r in repo.textdiff(args.a, args.b, args.space, include=args.include, exclude=args.exclude).toLocalIterator():
            print("\n".join([f"== {r['path_b'] or r['path_a']}", *diffs.carets([h.asDict() for h in r["hunks"]])]))
    elif c == "stats":
        show(repo.statistics())
        show(repo.size_histogram())
    elif c == "tree":
        show(repo.tree(args.snapshot, args.space))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return run(args, Repo(session(), args.root))
    except KeyboardInterrupt:
        return 130
    except (ValueError, LookupError) as e:
        print(e, file=sys.stderr)
        return 2
    except (OSError, RuntimeError, PySparkException) as e:
        print(e, file=sys.stderr)
        return 3 if args.command in ("save", "textdiff", "space") else 1


if __name__ == "__main__":
    sys.exit(main())
