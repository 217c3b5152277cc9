"""The pattern language against its truth table, in Python, Spark and DuckDB."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.fixtures import truth_table
from pathloom.functions import glob
from pathloom.functions.glob import Pattern

TABLE = truth_table()


def test_table_size():
    assert len(TABLE) == 112


@pytest.mark.parametrize(("path", "pattern", "expected"), TABLE)
def test_python(path, pattern, expected):
    assert Pattern(pattern).matches(path) == expected


def test_duckdb():
    for path, pattern, expected in TABLE:
        assert duckdb.execute("select regexp_matches(?, ?)", [path, Pattern(pattern).regex]).fetchone()[0] == expected


def test_spark_conditions(spark):
    """The condition with its literal parts decides as the expression does, for all paths and patterns of the table."""
    paths = sorted({p for p, _, _ in TABLE} | {"/a\n", "/a//", "/a/x\n", "/foo/file*.py", "/" + "x/" * 8000 + "y"})
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    patterns = sorted({q for _, q, _ in TABLE} | {"/foo/file\\*.py", "/a", "\\/a"})
    got = df.select("path", *[Pattern(q).condition().alias(f"c{i}") for i, q in enumerate(patterns)]).collect()
    for row in got:
        for i, q in enumerate(patterns):
            assert row[i + 1] == Pattern(q).matches(row.path), (row.path[:50], q)
    known = {(p, q): e for p, q, e in TABLE}
    for row in got:
        for i, q in enumerate(patterns):
            assert known.get((row.path, q), row[i + 1]) == row[i + 1]


def plain_match(path, pattern):
    """A plain recursive matcher over labels and characters."""

    def label(p, s, last):
        if not p:
            return not s
        if p[0] == "*":
            if len(p) == 1 and last:
                return len(s) >= 1
            return any(label(p[1:], s[i:], last) for i in range(len(s) + 1))
        return bool(s) and p[0] == s[0] and label(p[1:], s[1:], last)

    def go(ps, ss):
        if not ps:
            return not ss
        if ps[0] == "**":
            rest = ps[1:]
            while rest and rest[0] == "**":
                rest = rest[1:]
            if not rest:
                return not ss or ss[-1] != ""
            return any(go(rest, ss[i:]) for i in range(len(ss)))
        if not ss:
            return False
        # A star at the path's end needs a character, be it the pattern's end or all of the rest deep wildcards.
        at_end = len(ps) == 1 or (len(ss) == 1 and set(ps[1:]) == {"**"})
        return label(ps[0], ss[0], at_end) and go(ps[1:], ss[1:])

    return go(pattern.split("/")[1:], path.split("/")[1:])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "*", "**", "a*", "*b"]), min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", "ab", "", "abb"]), min_size=1, max_size=5))
def test_against_plain_matcher(labels, path):
    pattern, path = "/" + "/".join(labels), "/" + "/".join(path)
    assert Pattern(pattern).matches(path) == plain_match(path, pattern)


def test_prefix_holds():
    for path, pattern, expected in TABLE:
        if expected:
            assert path.startswith(Pattern(pattern).prefix) and path.endswith(Pattern(pattern).suffix)
    assert [Pattern(p).prefix for p in ("/a/**", "/a/**/c", "/a/*", "/foo/file*", "/**", "/a\\*b/*")] == ["/a", "/a/", "/a/", "/foo/file", "", "/a*b/"]


def test_partial(spark):
    df = spark.createDataFrame([(p,) for p in ("", "/", "/ab", "/ab/ab", "/ab/x/abc.py", "/x", "/abc", "/ab/")], "part string")
    got = {r.part: r.kind for r in df.select("part", glob.could_match("/ab/**/abc.py", "part").alias("kind")).collect()}
    assert got == {"": "INCOMPLETE", "/": "INCOMPLETE", "/ab": "INCOMPLETE", "/ab/ab": "INCOMPLETE", "/ab/": "INCOMPLETE", "/ab/x/abc.py": "MATCH", "/x": "MISMATCH", "/abc": "MISMATCH"}


def test_validity(spark):
    good = ["/a/**", "/**/x", "/a*/b/**", "/*", "/a/b", r"/a\*b/c", "/a/**/**", "/a/*b*/c", "/**", r"/a\**"]
    bad = ["", "ab/c", "/a/", "//a", "/a/***", "/a**", "/**b", "a/b", "/", "/a\n/"]
    assert all(map(glob.is_valid, good)) and not any(map(glob.is_valid, bad))
    df = spark.createDataFrame([(p,) for p in good + bad], "pattern string").select(glob.valid().alias("ok"))
    assert [r.ok for r in df.collect()] == [True] * len(good) + [False] * len(bad)
