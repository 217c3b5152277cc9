"""The path pattern language: ``*`` within a label, ``/**`` for any number of labels.

A pattern compiles on the driver to an anchored regular expression without look-around or
nested repetition, and to the literal text that every match begins (or ends) with, which
Spark can push into a scan.  Rules: ``*`` matches any characters of one label, and at the
pattern's end at least one; ``/**`` matches zero or more whole labels, and at the end only
if the path does not end in ``/``; a backslash makes the next character literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

STAR, DEEP, SLASH = object(), object(), object()


def tokenize(pattern: str) -> list:
    """Literal characters, SLASH, STAR and DEEP; runs of ``/**`` fold to one DEEP."""
    raw: list = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            raw.append(("\\/" if pattern[i + 1] == "/" else pattern[i + 1],))
            i += 2
            continue
        raw.append(SLASH if c == "/" else STAR if c == "*" else (c,))
        i += 1
    out: list = []
    i = 0
    while i < len(raw):
        whole_label = raw[i : i + 3] == [SLASH, STAR, STAR] and (i + 3 == len(raw) or raw[i + 3] is SLASH)
        if whole_label:
            if not out or out[-1] is not DEEP:
                out.append(DEEP)
            i += 3
        else:
            out.append(raw[i])
            i += 1
    return out


@dataclass(frozen=True)
class Pattern:
    text: str

    @cached_property
    def tokens(self) -> list:
        return tokenize(self.text)

    @cached_property
    def regex(self) -> str:
        """For Java's, DuckDB's and Python's engines alike (``\\z`` reads ``\\Z`` in Python)."""
        out, tokens = [], self.tokens
        last = len(tokens) - 1
        i = 0
        while i <= last:
            t = tokens[i]
            if t is DEEP:
                out.append("(?:/.*[^/])?" if i == last else "(?:/.*)?")
            elif t is STAR:
                if i == last:
                    out.append("[^/]+")
                elif i + 1 == last and tokens[last] is DEEP:
                    out.append("(?:[^/]*/.*[^/]|[^/]+)")
                    i += 1
                else:
                    out.append("[^/]*")
            elif t is SLASH:
                out.append("/")
            elif t == ("\\/",):
                # An escaped separator equals no character of a path.
                out.append("[^\\s\\S]")
            else:
                out.append(re.escape(t[0]) if ord(t[0]) < 128 and not t[0].isspace() else t[0])
            i += 1
        return "(?s)^" + "".join(out) + r"\z"

    @cached_property
    def _literal_ends(self) -> tuple[str, str]:
        """Literal text before the first wildcard, and after the last one."""
        prefix, suffix = [], []
        for t in self.tokens:
            if t in (STAR, DEEP):
                break
            prefix.append("/" if t is SLASH else t[0])
        if DEEP in self.tokens and self.tokens.index(DEEP) == len(prefix) and len(prefix) < len(self.tokens) - 1:
            prefix.append("/") if self.tokens[len(prefix) + 1] is SLASH else None
        for t in reversed(self.tokens):
            if t in (STAR, DEEP):
                break
            suffix.append("/" if t is SLASH else t[0])
        return "".join(prefix), "".join(reversed(suffix))

    @property
    def prefix(self) -> str:
        """Every matching path begins with this."""
        return self._literal_ends[0]

    @property
    def suffix(self) -> str:
        """Every matching path ends with this."""
        return self._literal_ends[1]

    @property
    def exact(self) -> bool:
        return STAR not in self.tokens and DEEP not in self.tokens

    @property
    def subtree(self) -> bool:
        """Literal text and one final ``/**``."""
        return bool(self.tokens) and self.tokens[-1] is DEEP and STAR not in self.tokens and DEEP not in self.tokens[:-1]

    def matches(self, path: str) -> bool:
        return re.search(self.regex.replace(r"\z", r"\Z"), path) is not None

    def condition(self, path: str | Column = "path") -> Column:
        """The predicate on a path column; what a scan can use is spelled out beside the expression."""
        path = F.col(path) if isinstance(path, str) else path
        if ("\\/",) in self.tokens:
            return F.lit(False)
        if self.exact:
            return path == F.lit(self.prefix)
        if self.subtree:
            below = path.startswith(self.prefix + "/") & ~path.endswith("/")
            inside = (path == F.lit(self.prefix)) | below
            return path.startswith(self.prefix) & inside if self.prefix else inside
        exact = F.rlike(path, F.lit(self.regex))
        for text, test in ((self.suffix, path.endswith), (self.prefix, path.startswith)):
            if text:
                exact = test(text) & exact
        return exact

    def duckdb(self, path: str = "path") -> str:
        return f"regexp_matches({path}, {quote(self.regex)})"


def compile(pattern: str) -> Pattern:  # noqa: A001
    return Pattern(pattern)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: A valid pattern: labels after ``/``; in a label ``**`` only alone, escapes with ``\``, and no ``***``.
_LABEL = r"(?:\*\*|\*?(?:(?:[^*/\\]|\\[^/])\*?)+|\*)"
VALID = rf"^(?:/{_LABEL})+$"


def is_valid(pattern: str) -> bool:
    """Whether a pattern is of the language: begins with a separator, has no empty label, and ``**`` only as a whole label."""
    return re.search(VALID, pattern) is not None and not pattern.endswith("\n")


def valid(pattern: str | Column = "pattern") -> Column:
    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    return F.rlike(pattern, F.lit(VALID[:-1] + r"\z"))


def could_match(pattern: str, part: str | Column = "part") -> Column:
    """MATCH, INCOMPLETE (a longer path could match) or MISMATCH of the beginning of a path, by literal prefix and expression."""
    part = F.col(part) if isinstance(part, str) else part
    own = Pattern(pattern)
    open_ = F.rlike(part, F.lit(partial_regex(own)))
    return F.when(own.condition(part), "MATCH").when(open_, "INCOMPLETE").otherwise("MISMATCH")


def partial_regex(pattern: Pattern) -> str:
    """Expression of all beginnings of matching paths: after each token the rest may be missing."""
    pieces, tokens = [], pattern.tokens
    for i, t in enumerate(tokens):
        if t is DEEP:
            # Below a deep wildcard anything may still follow.
            pieces.append("(?:/.*)?" if i < len(tokens) - 1 else "(?:/.*)?")
            if i == len(tokens) - 1:
                continue
            return "(?s)^" + "".join(f"(?:{p}" for p in pieces[:-1]) + "(?:/.*)?" + ")?" * (len(pieces) - 1) + r"\z"
        pieces.append("[^/]*" if t is STAR else "/" if t is SLASH else "[^\\s\\S]" if t == ("\\/",) else re.escape(t[0]))
    return "(?s)^" + "".join(f"(?:{p}" for p in pieces) + ")?" * len(pieces) + r"\z"


def index_direction(pattern: str | Column = "pattern") -> Column:
    """"1" if the first star of the reversed pattern comes later than that of the pattern, else "0"; no star counts as endless."""
    from pathloom.functions.paths import reverse_path

    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    endless = F.lit(1 << 30)
    places = [F.when(F.instr(p, "*") > 0, F.instr(p, "*")).otherwise(endless) for p in (pattern, reverse_path(pattern))]
    return F.when(places[1] > places[0], "1").otherwise("0")


def choose_direction(pattern: str) -> str:
    """The copy that prunes more: "0" (reversed paths) if the literal end is longer than the literal beginning, else "1"."""
    own = Pattern(pattern)
    return "0" if len(own.suffix) > len(own.prefix) else "1"
