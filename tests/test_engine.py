"""Sources, functions, structure, statistics, store and stream against plain versions."""

import math
from collections import Counter

import pytest

from pathloom.functions import paths
from pathloom.operators import search, statistics, structure
from pathloom.operators.search import HIGHEST, LOWEST, Query
from pathloom.plans import layout
from pathloom.plans.store import Store, level_number
from pathloom.sources import keys, lines
from pathloom.streaming.inserts import file_source, insert_stream

REF = "0123456789abcdef0123456789ABCDEF01234567"


def table(spark, rows):
    return spark.createDataFrame(rows, keys.SCHEMA)


@pytest.fixture(scope="module")
def rows():
    made = [(f"/{a}/{b}/x{i % 3}", (i * 37) % 101 - 50, f"{i:040x}") for i, (a, b) in enumerate((a, b) for a in "abc" for b in ("u", "v w", "é") for _ in range(8))]
    return [*made, made[0], ("/a/u/", 5, f"{999:040x}"), ("", 7, f"{998:040x}"), ("/a", LOWEST, f"{997:040x}"), ("/a", HIGHEST, f"{996:040x}")]


def test_search_is_a_bag(spark, rows):
    df = table(spark, rows)
    assert df.count() == search.search(df, "/**").count() + 1  # all but the path that ends in a separator
    assert search.search(df, "/a/**", 5, 4).count() == 0
    assert search.search(df, "/a", LOWEST, LOWEST).count() == 1
    assert search.search(df, "/a/**", -(10**6), 10**6).count() == sum(p.startswith("/a/") and not p.endswith("/") for p, _, _ in rows)


def test_pushed_filters(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/keys")
    found = search.search(spark.read.parquet(f"{tmp_path}/keys"), "/a/**/x1", -10, 10).select("ref")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,/a/)" in plan and "GreaterThanOrEqual(value,-10)" in plan and "StringEndsWith(path,/x1)" in plan


def test_batches_agree(spark, rows):
    df = table(spark, rows)
    queries = [Query("/a/**", -20, 20), Query("/**/x1"), Query("/*/u/*", 0, 50), Query("/zzz/*"), Query("/b*/**"), Query("/a")]
    want = Counter((i, r.path, r.value, r.ref) for i, q in enumerate(queries) for r in search.search(df, q.pattern, q.low, q.high).collect())
    assert Counter(map(tuple, search.answers(df, queries).collect())) == want
    assert Counter(map(tuple, search.join_queries(df, search.query_table(spark, queries)).collect())) == want
    counts = {r.qid: r.matches for r in search.batch_counts(df, queries).collect()}
    assert counts == {i: sum(n for k, n in want.items() if k[0] == i) for i in range(len(queries))}
    parts = {r.qid: r for r in search.selectivity(df, queries).collect()}
    assert parts[0].full == round(counts[0] / len(rows), 9)


def test_parse_and_clean(spark):
    texts = [f"/a;5;{REF}", f"/b; 12abc;{REF}", f";5;{REF}", "/" + "p" * 16323 + f";5;{REF}", "/" + "p" * 16324 + f";5;{REF}", f"/c;{lines.LOWEST_TIME - 1};{REF}", f"/d;{lines.HIGHEST_TIME};{REF}"]
    found = lines.clean(lines.parse(spark.createDataFrame([(t,) for t in texts], "line string"))).collect()
    assert [(r.path[:2], r.value) for r in found] == [("/a", 5), ("/b", 12), ("/p", 5), ("/d", lines.HIGHEST_TIME)]
    assert found[0].ref == REF.lower()
    for bad in (f"/a;x;{REF}", "/a;5;" + REF[1:], "/a;5;" + "g" + REF[1:], "/a;5"):
        with pytest.raises(Exception, match="no number|not a reference"):
            lines.parse(spark.createDataFrame([(bad,)], "line string")).collect()


def test_query_file(spark, tmp_path):
    (tmp_path / "q.csv").write_text("/a/**;1;2\n/**/x;-5;281474976710656\n")
    assert lines.read_queries(spark, str(tmp_path / "q.csv")) == [("/a/**", 1, 2), ("/**/x", -5, 1 << 48)]


def test_scalar_functions(spark):
    values = [0, 1, -1, LOWEST, HIGHEST, 1 << 32, -(1 << 32) - 5]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", paths.encode_value("v").alias("c")).select("v", "c", paths.decode_value("c").alias("d"))
    got = df.collect()
    assert all(r.v == r.d for r in got)
    assert [r.v for r in sorted(got, key=lambda r: r.c)] == sorted(values)
    shapes = {"/a/b/c": "c/b/a/", "/a": "a/", "/a/b/": "/b/a/", "a/b": "b/a/"}
    df = spark.createDataFrame([(p,) for p in shapes], "p string").select("p", paths.reverse_path("p").alias("r"), paths.unreverse_path(paths.reverse_path("p")).alias("back"))
    for r in df.collect():
        assert r.r == shapes[r.p] and (not r.p.startswith("/") or r.back == r.p)
    one = spark.createDataFrame([("2013-04-14T12:05:32Z", "1365941132", "x")], "i string, u string, b string")
    assert one.select(paths.iso_to_unix("i"), paths.unix_to_iso("u")).first() == (1365941132, "2013-04-14T12:05:32Z")
    for wrong in (paths.iso_to_unix("b"), paths.unix_to_iso("b"), paths.ref_bytes("b")):
        with pytest.raises(Exception, match="not a"):
            one.select(wrong).collect()
    assert one.select(paths.pattern_size(paths.F.lit(r"/a\*b"))).first()[0] == 5


def plain_trie(rows, leaf_keys):
    """The nodes by plain recursion over byte strings."""
    flip = 1 << 63
    keyed = [(p.encode() + b"\0", (v ^ -flip).to_bytes(8, "big", signed=True)) for p, v, _ in rows]
    out = []

    def lcp(items):
        a, b = min(items), max(items)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    def build(items, dim, depth):
        lp, lv = lcp([p for p, _ in items]), lcp([v for _, v in items])
        same_p, same_v = len({p for p, _ in items}) == 1, len({v for _, v in items}) == 1
        if (depth and len(items) <= leaf_keys) or (same_p and same_v):
            out.append((depth, "LEAF", len(items), lp, lv, 0, 4 + lp + lv + sum(22 + len(p) - lp + len(v) - lv for p, v in items)))
            return
        if dim == "PATH" and same_p:
            dim = "VALUE"
        elif dim == "VALUE" and same_v:
            dim = "PATH"
        groups = {}
        for p, v in items:
            byte = p[lp] if dim == "PATH" else v[lv]
            groups.setdefault(byte, []).append((p[lp + 1 :], v[lv:]) if dim == "PATH" else (p[lp:], v[lv + 1 :]))
        out.append((depth, dim, len(items), lp, lv, len(groups), 4 + lp + lv + 7 * len(groups)))
        for group in groups.values():
            build(group, "VALUE" if dim == "PATH" else "PATH", depth + 1)

    build(keyed, "VALUE", 0)
    return Counter(out)


@pytest.mark.parametrize("leaf_keys", [1, 10])
def test_trie(spark, rows, leaf_keys):
    got = structure.trie_nodes(table(spark, rows), leaf_keys)
    assert Counter((r.depth, r.dim, r.n_keys, r.len_p, r.len_v, r.fanout, r.byte_size) for r in got.collect()) == plain_trie(rows, leaf_keys)


def test_histograms(spark):
    values = [0, 1, 1, 4, 9, 10, 10, 3]
    hist = statistics.histogram(spark.createDataFrame([(v,) for v in values], "v long"), "v")
    for bins in (1, 3, 4, 10):
        width = math.ceil(10 / bins)
        got = sorted(statistics.hist_bins(hist, bins).collect(), key=lambda r: r.bin)
        for i, r in enumerate(got):
            low, high = i * width, (i + 1) * width + (i == bins - 1)
            assert (r.low, r.high, r.n, r.value_percent) == (low, high, sum(low <= v < high for v in values), int(high / 10 * 100))
    assert statistics.hist_bins(hist, 0).count() == 0
    assert [r.cumulative for r in sorted(statistics.hist_cumulative(hist).collect())] == [1, 3, 4, 5, 6, 8]
    assert tuple(statistics.sum_and_average(hist.limit(0), "n").first()) == (0, 0, 0)


def test_numbered(spark, rows):
    got = statistics.numbered(table(spark, rows), "path", "value", "ref").collect()
    assert [r.row_number for r in sorted(got)] == list(range(1, len(rows) + 1))


def test_cost_model(spark):
    got = {(r.dataset, r.memory): r for r in statistics.cost_model(spark).collect()}
    assert got[100_000_000_000, 50_000_000_000].best_case == 150_588_211_200
    assert got[100_000_000_000, 50_000_000_000].all_or_nothing == 301_176_471_552
    assert got[550_263_603_200, 256_000_000_000].best_case == 886_252_732_416
    small = {(r.dataset, r.memory): r for r in statistics.cost_model(spark, ((80_000, 24_000), (160_000, 40_000)), page=800).collect()}
    for (dataset, memory), r in small.items():
        n, m, b = dataset // 80, memory // 80, 10
        want = math.ceil(n / b) - math.ceil(m / b) + 2 * sum(math.ceil((n - i) / b) - math.ceil(m / b) + 1 for i in range(1, n - m + b + 1))
        assert r.worst_case == want * 800


def test_store_merges_and_answers(spark, rows, tmp_path):
    df = table(spark, rows)
    store = Store(spark, f"file://{tmp_path}/store", max_buffer_keys=20, reverse=True)
    whole = Counter(map(tuple, df.collect()))
    for i in range(4):
        store.insert(df.where(f"pmod(hash(ref), 4) = {i}"))
        assert all(level in ("0", "1", "2") for level in store.state()["levels"])
    assert Counter(map(tuple, store.read().collect())) == whole
    for q in (Query("/a/**", -20, 20), Query("/**/x1"), Query("/**"), Query("/a/u/")):
        assert Counter(map(tuple, store.query(q.pattern, q.low, q.high).collect())) == Counter(map(tuple, search.search(df, q.pattern, q.low, q.high).collect()))
    store.flush()
    assert store.state()["buffer"] == [] and Counter(map(tuple, store.read().collect())) == whole
    assert store.bulk_load(df) == level_number(len(rows), 20)
    assert len(store.state()["levels"]) == 1 and store.read().count() == len(rows)
    store.clear()
    assert store.read().count() == 0


def test_reversed_copy_prunes(spark, tmp_path):
    """A pattern that begins with a wildcard reads fewer rows from the copy by reversed path, one with a prefix from the other."""
    made = [(f"/d{i % 97:02}/f{i % 89:02}", i, f"{i:040x}") for i in range(8000)]
    df = table(spark, made)
    store = Store(spark, f"file://{tmp_path}/store", reverse=True)
    # So few keys would else be one row group.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store.bulk_load(df)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for pattern, better in (("/**/f07", "0"), ("/d03/**", "1"), ("/*/f88", "0")):
        told = {d: search.scan_report(store.query(pattern, direction=d)) for d in ("0", "1", "auto")}
        want = search.search(df, pattern).count()
        assert {t["matches"] for t in told.values()} == {want}
        other = "1" if better == "0" else "0"
        assert told["auto"]["rows_read"] == told[better]["rows_read"] <= 4000 < 8000 == told[other]["rows_read"]
    assert Counter(map(tuple, store.query("/**/f07").collect())) == Counter(r for r in made if r[0].endswith("/f07"))


def test_batches_are_stored_once(spark, rows, tmp_path, monkeypatch):
    """A crash after the commit, and a batch that is run again."""
    df = table(spark, rows)
    store = Store(spark, f"file://{tmp_path}/store", 1)
    monkeypatch.setattr(store, "merge", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.insert(df, batch="a")
    again = Store(spark, f"file://{tmp_path}/store", 1)
    assert not again.insert(df, batch="a")
    assert again.insert(df.limit(2), batch="b")
    assert again.read().count() == len(rows) + 2
    assert {r.place: r.n_keys for r in again.facts().collect()} == {"0": len(rows) + 2, "buffer": 0}


def test_earlier_readers_outlive_merges(spark, rows, tmp_path):
    df = table(spark, rows)
    store = Store(spark, f"file://{tmp_path}/store", 10)
    store.insert(df.limit(12))
    before = store.read()
    store.insert(df.limit(12))
    assert before.count() == 12 and store.read().count() == 24
    for _ in range(4):
        store.insert(df.limit(12))
    folders = [p for p in (tmp_path / "store" / "data").iterdir()]
    assert store.read().count() == 72 and len(folders) < 12


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_query_join_plans_no_cross_product(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", broadcast)
    df = table(spark, rows)
    queries = [Query("/a/**", -20, 20), Query("/**/x1"), Query("/*/u/*", 0, 50), Query("/a/u/**"), Query("/a/u/x1"), Query("/a"), Query("/a*/u/**"), Query("/a/u/*")]
    found = search.join_queries(df, search.query_table(spark, queries))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = Counter((i, r.path, r.value, r.ref) for i, q in enumerate(queries) for r in search.search(df, q.pattern, q.low, q.high).collect())
    assert Counter(map(tuple, found.collect())) == want
    assert search.join_queries(df, search.query_table(spark, queries).limit(0)).count() == 0


def test_callbacks_and_prints(spark, rows, capsys):
    df = search.search(table(spark, rows), "/a/**")
    seen, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def call(path, value, ref):
        assert path.startswith("/a") and len(ref) == 40
        seen.add(1)
        total.add(value)

    search.for_each(df, call)
    assert seen.value == df.count() and total.value == sum(r.value for r in df.collect())
    assert search.print_matches(df, 3) == 3
    assert all(line.count(";") == 2 for line in capsys.readouterr().out.splitlines())


def test_key_bytes(spark):
    texts = ["/a/b", "", "/", "a//é/", "/漢\n", "/x/"]
    df = spark.createDataFrame([(t,) for t in texts], "p string").select("p", paths.key_path("p").alias("k"), paths.decode_path(paths.key_path("p")).alias("back"))
    for r in df.collect():
        assert bytes(r.k) == r.p.encode().replace(b"/", b"\xff") + b"\0" and r.back == r.p
    asked = {"/a*/**": b"\xffa\xfd\xff\xfd\xfd", "/\\*b\\\\": b"\xff*b\\", "é\\": "é\\".encode(), "/\\/x": b"\xff/x"}
    df = spark.createDataFrame([(t,) for t in asked], "p string").select("p", paths.key_pattern("p").alias("k"))
    assert {r.p: bytes(r.k) for r in df.collect()} == asked
    assert paths.index_name(True) != paths.index_name(False)


def test_running_sums(spark):
    made = [(i * 7919 % 1000, i % 5) for i in range(1000)]
    got = statistics.running_sums(spark.createDataFrame(made, "k long, n long").repartition(5), ["k"], upto="n").collect()
    total = 0
    for r, (k, n) in zip(sorted(got), sorted(made), strict=True):
        total += n
        assert (r.k, r.upto) == (k, total)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_groups_beside_keys(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(structure, "BROADCAST_ROWS", broadcast)
    df = table(spark, rows).withColumn("g", paths.F.substring("path", 1, 2))
    got = structure.psi_partition(df, "PATH", "g").groupBy("g").agg(paths.F.sum("n_keys").alias("n")).collect()
    assert {r.g: r.n for r in got} == Counter(p[:2] for p, _, _ in rows)
    nodes = structure.trie_nodes(table(spark, rows), 10)
    assert Counter((r.depth, r.dim, r.n_keys, r.len_p, r.len_v, r.fanout, r.byte_size) for r in nodes.collect()) == plain_trie(rows, 10)


def test_command_line(spark, rows, tmp_path, capsys):
    from pathloom.__main__ import main

    good = [(p, v, r) for p, v, r in rows if p and abs(v) < 10**8]
    (tmp_path / "in.txt").write_text("".join(f"{p};{v};{r}\n" for p, v, r in good))
    (tmp_path / "q.csv").write_text("/a/**;-20;20\n/**/x1;-1000;1000\n")
    folder = f"file://{tmp_path}"
    said = lambda *args: (main([str(a) for a in args]), capsys.readouterr().out.splitlines())[1]
    told = dict(line.split(";")[:2] for line in said("create", f"{folder}/store", f"{folder}/in.txt", "--fraction", 0.5, "--max-buffer-keys", 10, "--reverse")[1:])
    assert sum(map(int, told.values())) == len(good)
    want = [sum(p.startswith("/a/") and not p.endswith("/") and -20 <= v <= 20 for p, v, _ in good), sum(p.endswith("/x1") for p, _, _ in good)]
    assert len(said("query", f"{folder}/store", "/**/x1")) == want[1]
    shown = said("query", f"{folder}/store", "--queries", f"{folder}/q.csv", "--repetitions", 2, "--warmup")
    assert [line.split(";")[:2] for line in shown] == [["Q0", str(want[0])], ["Q0", str(want[0])], ["Q1", str(want[1])], ["Q1", str(want[1])], ["sum", str(2 * sum(want))], ["average", str(2 * sum(want) // 4)]]
    assert said("selectivity", f"{folder}/store", f"{folder}/q.csv")[1].startswith(f"0;{round(want[0] / len(good), 9)};")
    said("keys", f"{folder}/in.txt", f"{folder}/keys")
    said("lines", f"{folder}/keys", f"{folder}/lines")
    assert sorted(r[0] for r in spark.read.text(f"{folder}/lines").collect()) == sorted(f"{p};{v};{r}" for p, v, r in good)
    assert said("pages", f"{folder}/keys", 5)[1].split(";")[0] == str(len(good))
    swept = said("sweep", f"{folder}/in.txt", "--buffers", 20, "--fractions", 0, 1)
    assert [line.split(";")[2] for line in swept[1:]] == [str(len(good))] * 2
    assert len(said("costs")) > 5
    with pytest.raises(SystemExit):
        main(["query", f"{folder}/store"])


def test_stream(spark, rows, tmp_path):
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store", 30)
    for _ in range(2):
        insert_stream(file_source(spark, f"{tmp_path}/in", keys.SCHEMA), store, f"file://{tmp_path}/check").awaitTermination()
    assert Counter(map(tuple, store.read().collect())) == Counter(rows)


def test_interleaved_layout(spark, rows):
    df = table(spark, rows)
    assert Counter(map(tuple, layout.interleaved(df, 8).collect())) == Counter(rows)
