"""The pattern truth table of the query semantics, then own cases of the rules' edges."""

from __future__ import annotations

#: path | pattern | expected
_TABLE = r"""
/foo/file2.pyp | /foo/file*.py | false
/foo/file.py | /foo/file*.py | true
/foo/file1.py | /foo/file*.py | true
/foo/file2.py | /foo/file*.py | true
/foo/2file.py | /foo/file*.py | false
/ab/aa/ab/cc/abd | /ab/aa/ab/cc/abd | true
/ab/aa/ab/cc/abd | /ab/aa/ac/cc/abd | false
/ab/aa/ab/cc/abd | /ab/aa | false
/a/c | /a/**/c | true
/a/b/c | /a/**/c | true
/a/b1/b2/c | /a/**/c | true
/a/foo/bar.py | /a/**/c | false
/a/foo.py | /a/**/c | false
/a/b/foo.py | /a/**/c | false
/a | /a/**/c | false
/a/c | /a/*/c | false
/a/b/c | /a/*/c | true
/a/b1/b2/c | /a/*/c | false
/a/foo/bar.py | /a/*/c | false
/a/foo.py | /a/*/c | false
/a/b/foo.py | /a/*/c | false
/a | /a/*/c | false
/a/c | /a/f*.py | false
/a/b/c | /a/f*.py | false
/a/b1/b2/c | /a/f*.py | false
/a/foo/bar.py | /a/f*.py | false
/a/foo.py | /a/f*.py | true
/a/b/foo.py | /a/f*.py | false
/a | /a/f*.py | false
/a/c | /a/* | true
/a/b/c | /a/* | false
/a/b1/b2/c | /a/* | false
/a/foo/bar.py | /a/* | false
/a/foo.py | /a/* | true
/a/b/foo.py | /a/* | false
/a | /a/* | false
/a/c | /a/** | true
/a/b/c | /a/** | true
/a/b1/b2/c | /a/** | true
/a/foo/bar.py | /a/** | true
/a/foo.py | /a/** | true
/a/b/foo.py | /a/** | true
/a | /a/** | true
/ab/cd/x/a/b | /**/ab/*/x/a/b | true
/ab/cd/x/a/b | /**/ab/*/x/** | true
/ab/cd/x/a/b | /ab/*/x/*/* | true
/ab/cd/x/a/b | /*/*/*/*/* | true
/ab/cd/x/a/b | /*/**/* | true
/ab/cd/x/a/b | /*/*/*/* | false
/ab/cd/x/a/b | /*/dd/*/*/* | false
/ab/abc/abc/abc.py | /**/abc/abc.py | true
/ab/abc/abc/abc.py | /ab/abc/**/abc.py | true
/ab/abc/abc/abc.py | /ab/**/abc.py | true
/ab/abc/abc/abc.py | /ab/abc/abc/**/abc.py | true
/ab/abc/abc/abc.py | /ab/** | true
/ab/abc/abc/abc.py | /ab/abc/*abc/abc.py | true
/ab/abc/abc/abc.py | /ab/abc/abc*/abc.py | true
/ab/abc/abc/abc.py | /ab/*/abc/abc.py | true
/ab/abc/abc/abc.py | /ab/abc/*bc/abc.py | true
/ab/abc/abc/abc.py | /ab/abc/a*c/abc.py | true
/ab/abc/abc/abc.py | /ab/abc/abc/*.py | true
/ab/abc/abc/abc.py | /ab/abc/abc/* | true
/ab/abc/abc/abc.py | /ab/abc/abc/abc.py/** | true
a/b/xybtttbab/abc.py | a/b/*b/abc.py | true
/ab/aa/ab/cc/abd | /**/ab/**/abd | true
/ab/aa/ab/cc/abd | /ab/**/cc/abd | true
/ab/aa/ab/cc/abd | /**/ab/aa/**/cc/abd | true
/ab/aa/ab/cc/abd | /**/abc | false
/ab/aa/ab/cc/abd | /**/ab/abd/** | false
/ab/aa/ab/cc/abd | /**/ab/aa/**/cc/ab | false
/ab/aa/ab/cc/abd | /**/abd/** | true
/ab/aa/ab/cc/abd | /**/abd/**/**/** | true
/a | /** | true
/a/b | /** | true
/a/b/c | /** | true
/abcd | /**/abcd | true
/abc | /**/abcd | false
/foo/bar/baz/abc | /**/abcd | false
/foo/bar/baz | /**/abcd | false
/abcde | /**/abcd | false
/foo/bar/baz/abcde | /**/abcd | false
/foo/bar/bcde | /**/abcd | false
/ab/aa/ab/cc/ac | /ab/*/ab/**/ac | true
/ab/aa/abc | /ab/*/ab/**/ac | false
/ab/aa/abd | /ab/*/ab/**/ac | false
/ab/aa/ab/cc/abd | /ab/*/ab/**/ac | false
/ab/abd | /ab/*/ab/**/ac | false
/ab/abd/cc/de/abd | /ab/*/ab/**/ac | false
/ab/abd/cc/de/bd | /ab/*/ab/**/ac | false
/ | /* | false
/ | /** | false
/neutron/plugins/abc/dddddddddddd.py | /neutron/plugins/*/d*dd*dd.py | true
/neutron/plugins/dabc/db.py | /neutron/*/d*.py | false
/neutron/plugins/abcabcabc/db.py | /neutron/plugins/abc*cb/db.py | false
db.py/aioöwerhioa/plugins/neutron/ | *.py/*/plugins/neutron/ | true
/foobar/baz | /**/f*oo*bar/baz | true
/foABoAAAoobar/baz | /**/f*oo*bar/baz | true
/foABoAAAoobaAAAAbaAAAbar/baz | /**/f*oo*bar/baz | true
/tmp/foABoAAAoobaAAAAbaAAAbar/baz | /**/f*oo*bar/baz | true
/tmp/foobar/foABoAAAoobaAAAAbaAAAbar/baz | /**/f*oo*bar/baz | true
/tmp/foobar/foABoAAAobaAAAAbaAAAbar/baz | /**/f*oo*bar/baz | false
/tmp/foobar/foABoAAAoobaAAAAbaAAAba/baz | /**/f*oo*bar/baz | false
/a | /a*/** | false
/ab | /a*/** | true
/a/x | /a*/** | true
/a/ | /a/** | false
/a/b/ | /a/** | false
/a// | /a/** | false
/foo/file | /foo/file* | false
 | /** | true
//c | /**/*/c | true
/c | /**/*/c | false
"""


def truth_table() -> list[tuple[str, str, bool]]:
    """(path, pattern, expected) of every row."""
    rows = [[x.strip() for x in line.split("|")] for line in _TABLE.strip("\n").split("\n")]
    return [(path, pattern, expected == "true") for path, pattern, expected in rows]
