"""Glob patterns as regular expressions, and the rules for what a save leaves out."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratum.functions.paths import ancestors, col

#: Left out by default (fixed values): patterns for anything, and for files alone.
DEFAULT_EXCLUDE = (".stratum/**", ".git/**", "bin/**", "obj/**")
DEFAULT_FILES = ("*.tmp", "*.log", "*.user")


def id_glob(pattern: str) -> str:
    """A whole-id pattern: ``*`` any characters, ``?`` one; case is ignored."""
    return "(?is)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


def matches_all(column: Column | str, patterns: Iterable[str]) -> Column:
    """Every one of the patterns must match; none means true."""
    return reduce(lambda a, b: a & b, (col(column).rlike(id_glob(p)) for p in patterns), F.lit(True))


def body(pattern: str) -> str:
    """``**`` crosses slashes, ``*`` and ``?`` don't."""
    names = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(names.get(t) or re.escape(t) for t in re.findall(r"\*\*|\*|\?|[^*?]+", pattern))


def path_glob(pattern: str) -> str:
    """A whole-path pattern with case: ``**/`` any folders or none, a ``/`` at the end all below."""
    p = pattern.replace("\\", "/").removeprefix("./").lstrip("/")
    p = p + "**" if p.endswith("/") else p
    return "(?s)^" + "".join("(?:.*/)?" if t == "**/" else body(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", p)) + "$"


@dataclass(frozen=True)
class Globs:
    """Patterns compiled into one expression for folders alone (those that end in a slash) and one for anything."""

    folders: tuple[str, ...] = ()
    anything: tuple[str, ...] = ()

    @classmethod
    def of(cls, patterns: Iterable[str]) -> Globs:
        found: dict[bool, list[str]] = {True: [], False: []}
        for p in (p.replace("\\", "/").strip() for p in patterns if p):
            if not p:
                continue
            only = p.endswith("/")
            p = p[:-1] if only else p
            tail = "/?" if only else ""
            if p.startswith("/"):
                found[only].append(f"^{body(p.lstrip('/'))}{tail}$")
            else:
                found[only].append(f"(^|/)({body(p)}{tail})(/|$)")  # a pattern without a slash thus matches any segment
        return cls(tuple(found[True]), tuple(found[False]))

    def file(self) -> str | None:
        return "(?i)" + "|".join(f"(?:{x})" for x in self.anything) if self.anything else None

    def folder(self) -> str | None:
        every = (*self.folders, *self.anything)
        return "(?i)" + "|".join(f"(?:{x})" for x in every) if every else None


def either(x: Column, patterns: Iterable[str | None]) -> Column:
    return reduce(lambda a, b: a | b, (x.rlike(p) for p in patterns if p), F.lit(False))


@dataclass(frozen=True)
class Ignore:
    """What a save leaves out: ``common`` patterns, those for files and those for folders."""

    common: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    sets: tuple[Globs, Globs, Globs] = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "sets", tuple(Globs.of(x) for x in (self.common, self.files, self.folders)))

    def with_defaults(self) -> Ignore:
        def union(own, more):
            seen = {}
            for p in (*(x.strip() for x in own if x and x.strip()), *more):
                seen.setdefault(p.lower(), p)
            return tuple(seen.values())

        return Ignore(union(self.common, DEFAULT_EXCLUDE), union(self.files, DEFAULT_FILES), union(self.folders, ()))

    def folder_patterns(self) -> list[str]:
        return [p for p in (self.sets[0].folder(), self.sets[2].folder()) if p]

    def file_patterns(self) -> list[str]:
        return [p for p in (self.sets[0].file(), self.sets[1].file()) if p]

    def folder(self, path: Column | str) -> Column:
        """Whether the folder itself is left out."""
        return either(F.concat(F.translate(col(path), "\\", "/"), F.lit("/")), self.folder_patterns())

    def file(self, path: Column | str) -> Column:
        """Whether the file itself is, whatever its folders."""
        return either(F.translate(col(path), "\\", "/"), self.file_patterns())

    def pruned(self, path: Column | str) -> Column:
        """Whether some folder above is: a folder that is left out takes all below it along."""
        return F.exists(ancestors(path), lambda d: either(F.concat(d, F.lit("/")), self.folder_patterns()))

    def excluded(self, path: Column | str) -> Column:
        return self.file(path) | self.pruned(path)
