"""Near copies, private data, URLs, leaks, archives and the pipeline against plain versions."""

import base64
import hashlib
import os
import random
import re
from collections import Counter

import pytest

from pathloom.llm import decontam, jaccard, pii, urlfilter, warc
from pathloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(texts):
    """(set size, component, links) of each document."""
    sets = {i: shingles(t) for i, t in texts}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
                links.update((i, j))
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def near_texts(n=260, seed=7):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(pick.choice(words) for _ in range(30))
    texts = []
    for i in range(n):
        kind = pick.random()
        if texts and kind < 0.5:
            own = texts[pick.randrange(len(texts)) if kind < 0.25 else 0].split()
            for _ in range(pick.randint(0, max(1, len(own) // 25))):
                own[pick.randrange(len(own))] = pick.choice(words)
            texts.append(" ".join(own))
        else:
            texts.append((shared + " " if kind > 0.8 else "") + " ".join(pick.choice(words) for _ in range(pick.choice([1, 3, 5, 6, 40, 150]))))
    return [*enumerate(texts), (n, ""), (n + 1, None), (n + 2, " \n"), (n + 3, texts[0].upper()), (n + 4, "a b")]


@pytest.mark.parametrize("few", [1.0, -1e9])
def test_jaccard_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 16)
    texts = near_texts(160 if few < 0 else 260)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.assign(docs(spark, texts)).collect()}
    assert found == brute(texts)


@pytest.mark.parametrize("block", [512, 10])
def test_jaccard_near_group(spark, monkeypatch, block):
    """Many near copies of one text, some of which link only through others; links counted in one and in many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COLUMNS", 50)
    pick = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(120):
        own = list(base)
        for _ in range(pick.choice([0, 1, 1, 2, 3])):
            own[pick.randrange(60)] = f"x{pick.randrange(10**6)}"
        texts.append((i * 3, " ".join(own)))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.assign(docs(spark, texts)).collect()}
    assert found == brute(texts)


def test_jaccard_edges(spark):
    assert jaccard.assign(docs(spark, [])).collect() == []
    odd = docs(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, None)])
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.n_links) for r in jaccard.assign(odd).collect())
    assert found == [(-1, 2, None, None), (1, 0, 1, 0), (3, 2, 3, 1), (3, 2, 3, 1)]


@pytest.mark.parametrize("rounds", [1, 8])
def test_jaccard_long_texts_and_ties(spark, monkeypatch, rounds):
    """Texts of 20,000 words, repeated rows, pairs exactly at the threshold, and a passage that many texts share; few and many rounds."""
    monkeypatch.setattr(jaccard, "MOST_ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "FEW", 0.0)
    monkeypatch.setattr(jaccard, "GROUP", 7)
    pick = random.Random(21)
    long = [f"l{pick.randrange(5000)}" for _ in range(20_000)]
    near = list(long)
    for _ in range(300):
        near[pick.randrange(20_000)] = "changed"
    far = list(long)
    for _ in range(3000):
        far[pick.randrange(20_000)] = "changed"
    base = [f"t{i}" for i in range(13)]  # nine shingles; eight of them shared are 8 / 10
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(t) for t in (long, near, far, base, base[:12] + ["z"], ["z"] + base, ["y"] + base[:12] + ["z"])]
    texts += [" ".join(passage + [f"o{i}x{k}" for k in range(pick.choice([4, 8, 12, 20, 40]))]) for i in range(60)]
    rows = [*enumerate(texts)]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.assign(docs(spark, rows)).collect()}
    assert found == brute(rows)
    # A repeated row is a further row to link with.
    again = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.assign(docs(spark, [*rows, rows[1], rows[3], rows[3]])).collect()}
    want = brute([*rows, (101, rows[1][1]), (103, rows[3][1]), (203, rows[3][1])])
    assert again == {i: want[i] for i, _ in rows}


def test_jaccard_profile_memory():
    import tracemalloc
    import zlib

    import numpy as np
    import pyarrow as pa

    texts = [" ".join(f"w{i}-{k}" for k in range(300)) for i in range(50)] + [None, "one", "a b c d e a b c d e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    list(jaccard._profile(5)(iter([batch])))  # tables that stay
    tracemalloc.start()
    out = list(jaccard._profile(5)(iter([batch, batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The counters and little more: a Python worker shares the executor's memory.
    assert peak < 2 * (4 << jaccard.SKETCH_BITS)
    rows = [r for b in out for r in b.to_pylist()]
    counts = {r["cell"]: int(np.frombuffer(zlib.decompress(r["counts"]), np.uint32).sum()) for r in rows if r["cell"] is not None}
    assert sum(counts.values()) == 2 * sum(len(shingles(t)) for t in texts) == sum(r["n"] for r in rows if r["cell"] is None)


def test_links_span_components(spark):
    texts = near_texts(120, 3)
    want = brute(texts)
    edges = [(r.a, r.b) for r in jaccard.link(docs(spark, texts)).collect()]
    sets = dict(texts)
    for a, b in edges:
        x, y = shingles(sets[a]), shingles(sets[b])
        assert 100 * len(x & y) >= 80 * len(x | y)
        assert want[a][1] == want[b][1]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    pick = random.Random(1)
    pick.shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, rx) in enumerate(BASE):
        for m in re.finditer(rx, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def shown(spans):
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)


def pii_texts():
    pick = random.Random(9)
    bits = ["a.b@c.de", "x@y", "@z.com", "q@r.s-t.u_v@w.x", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "0" * 14, "+1 (202) 555-0143", "+49 30 1234", "+1--", "é", "漢", " ", "\n", "--", ".", "12", "7" * 30, "ab12cd34", "😀"]
    texts = ["", None, "a" * 5000 + "@b.c", "1" * 3000 + " x", "4" * 20000, "a@b.c" * 300, "+1" + "(" * 4000]
    return texts + ["".join(pick.choice(bits) + pick.choice(["", " ", ",", " to "]) for _ in range(pick.randint(1, 25))) for _ in range(600)]


def test_pii_base_equals_definition(spark):
    texts = list(enumerate(pii_texts()))
    for r in pii.extract(docs(spark, texts)).collect():
        want = base_spans(texts[r.doc_id][1] or "")
        assert r.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert [s for s in r.spans.split(",") if s and not s.startswith("id:")] == [s for s in shown(want).split(",") if s]


def test_pii_discovers_and_redacts(spark):
    texts = [(i, f"some words contact: user{i}@mail{i}.com and more") for i in range(6)]
    texts += [(10, "please contact: AB-77812 today"), (11, "again AB-77812 here"), (12, "the room12345 is free"), (13, None), (13, None), (14, "contact: a1b2c3d4")]
    df = docs(spark, texts)
    got = {r.doc_id: r.spans for r in pii.extract(df).collect()}
    assert got[10] == "id:16:24" and got[11] == "id:6:14" and got[12] == "" and got[14] == "id:9:17"
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == len(texts)
    masked = {r.doc_id: r.text for r in out.collect()}
    assert masked[0] == "some words contact: [EMAIL] and more"
    assert masked[10] == "please contact: [ID] today" and masked[13] is None and masked[12] == texts[8][1]
    assert pii.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("gap", [" ", " " * 60])
@pytest.mark.parametrize("chunk", ["contact:", "contact-" * 12 + ":"])
def test_pii_long_values_and_chunks(spark, chunk, gap):
    key = "0123456789abcdef" * 8
    texts = [(i, f"some words {chunk}{gap}user{i}@mail{i}.com and more") for i in range(6)]
    texts += [(10, f"please {chunk}{gap}{key} today"), (11, f"again {key} here"), (12, "no id")]
    got = {r.doc_id: r.spans for r in pii.extract(docs(spark, texts)).collect()}
    start = len("please ") + len(chunk) + len(gap)
    assert got[10] == f"id:{start}:{start + 128}" and got[11] == "id:6:134" and got[12] == ""
    # The chunk in other places of the corpus lowers its precision, however long it is.
    more = [*texts, *((100 + i, f"{chunk} nothing") for i in range(40))]
    assert {r.doc_id: r.spans for r in pii.extract(docs(spark, more)).collect()}[10] == ""


def test_url_filter(spark):
    urls = [None, "no url", "http://A.Example.ORG/es/1?x", "https://example.org/en/12", "http://x.com/fr/", "http://com/de/z#y", "ftp://notcom.net", "http://org", "http://b.com?q=/de/", "http://b.com/de/1", "http://b.com/de/2", "http://b.com/de/3", "http://b.com/xx"]
    urls += [f"http://fine.org/{i}" for i in range(60)] + [f"http://bad.com/de/{i}" for i in range(40)] + ["http://bad.com/other", "http://sub.bad.com/other"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    assert len(got) == len(urls)
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("x.com", "/fr/", "com/fr/"),
        ("com", "/de/z", "com/de/"), ("notcom.net", "", None), ("org", "", None), ("b.com", "", None),
    ]
    assert got[2].verdict == got[3].verdict == got[5].verdict == "block" and got[4].verdict == "allow"
    assert got[len(urls) - 2].verdict == "block" and got[0].verdict == "allow"
    assert urlfilter.judge(df.limit(0)).collect() == []
    more = spark.createDataFrame([("notcom.net", 1)] * 50, "host string, blocked int")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, outcomes=more).collect()}[6] == "block"


def test_decontamination(spark):
    item = "In March Anna bought 12 apples for 30 dollars while her brother Tom carried 12 heavy boxes over the 5 km long road to town"
    changed = item.replace("12", "45").replace("Anna", "Mary Ann").replace("Tom", "Jim").replace("30", "7").replace("5 km", "9 miles")
    broken = item.replace("12 heavy", "13 heavy")
    far = " ".join(f"other{i}" for i in range(200))
    texts = [(1, f"{far} {item} {far}"), (2, changed), (3, f"{far} {broken} {far}"), (4, far), (5, None), (6, ""), (2, changed), (None, item), (7, " ".join(item.split()[:9]))]
    bench = spark.createDataFrame([(10, item), (11, "too short"), (None, None)], "item_id long, text string")
    df = docs(spark, texts)
    got = {(r.doc_id, r.item_id): r for r in decontam.report(df, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (None, 10)}
    assert got[1, 10].changed_slots == 0 and got[2, 10].changed_slots > 2
    assert sorted(r.doc_id for r in decontam.keep_clean(df, bench).collect()) == [3, 4, 5, 6, 7]
    assert decontam.report(df.limit(0), bench).collect() == [] == decontam.report(df, bench.limit(0)).collect()


def test_decontamination_clash(spark):
    """One of two equal numbers edited, or two numbers made equal, in a long copy; short ones: document 3 above."""
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    first, second = " ".join(words[:10]) + " 12 ", " ".join(words[10:20])
    rest = " ".join(words[20:])
    bench = spark.createDataFrame([(1, f"{first}{second} 12 {rest}"), (2, f"x {first}{second} 14 {rest}")], "item_id long, text string")
    df = docs(spark, [(1, f"{first}{second} 13 {rest}"), (2, f"x {first}{second} 12 {rest}"), (3, "other words")])
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontam.report(df, bench).collect()}
    assert {(1, 1), (2, 2)} <= set(got) and all(d != 3 for d, _ in got)
    assert got[1, 1] == 55 - 8 - 8
    assert [r.doc_id for r in decontam.keep_clean(df, bench).collect()] == [3]


def test_decontamination_items_without_windows(spark):
    far = " ".join(f"other{i}" for i in range(50))
    items = ["What is 45% of 80?", "What is the capital of France?", "Anna 12 km Tom 7 kg Jim 3 Bob 5 miles Ann 9", "12 30 7 9"]
    bench = spark.createDataFrame([*enumerate(items), (9, ""), (8, None)], "item_id long, text string")
    texts = [f"{far}. {x} {far}" for x in items]
    texts += [f"{far} what is 45% of 81? {far}", f"{far} what is the capital of Italy? {far}", f"{far} and What is the capital of France {far}", f"{far} 12 30 7", "9", "", None, items[3]]
    got = {(r.doc_id, r.item_id) for r in decontam.report(docs(spark, enumerate(texts)), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 1), (6, 1), (11, 3)}


def plain_tokens(text):
    """Words, template tokens and slots of a text of ASCII signs."""
    words = [w for w in (text or "").split() if re.search("[0-9A-Za-z]", w)]
    cores = [w[re.search("[0-9A-Za-z]", w).start() :] for w in words]
    plain = [re.sub("[^0-9a-z]", "\0", c.lower()).rstrip("\0") for c in cores]
    out, before = [], ""
    for k, (w, core, own) in enumerate(zip(words, cores, plain, strict=True)):
        opens = not before or before[-1] in "!.:?"
        name = bool(re.match("[A-Z][a-z]", core)) and not opens
        if core[0].isdigit():
            out.append(["NUMBER", own])
        elif own in decontam.UNITS and k and cores[k - 1][0].isdigit():
            out.append(["UNIT", own])
        elif name and out and out[-1][0] == "NAME" and before[-1].isalnum():
            out[-1][1] = own
        elif name:
            out.append(["NAME", own])
        else:
            out.append([own, None])
        before = w
    return plain, [(t, v) if v else (("word", t), None) for t, v in out]


def plain_leaks(texts, items):
    """(document, item): windows that count, by comparing every window with every window."""

    def windows(tokens):
        return [(k, tokens[k : k + 8]) for k in range(len(tokens) - 7) if sum(v is None for _, v in tokens[k : k + 8]) >= 4]

    found = {}
    for item, said in items:
        words, tokens = plain_tokens(said)
        own = windows(tokens)
        sets = [(0, k, w) for k, w in own]
        if not own and words:
            sets = [(1, 0, [(w, None) for w in words])]
            if sum(v is None for _, v in tokens) >= 4:
                sets.append((2, 0, tokens))
        size = len({k for _, k, _ in sets})
        for doc, text in texts:
            words, tokens = plain_tokens(text)
            groups = {}
            for kind, k, want in sets:
                source = [(w, None) for w in words] if kind == 1 else tokens
                for at in range(len(source) - len(want) + 1):
                    got = source[at : at + len(want)]
                    if [t for t, _ in got] == [t for t, _ in want]:
                        groups.setdefault((kind, at - k), []).append((k, [(x, y) for (_, x), (_, y) in zip(want, got, strict=True) if x]))
            total = 0
            for met in groups.values():
                pairs = {p for _, slots in met for p in slots}
                bad_x = {x for x, _ in pairs if len({b for a, b in pairs if a == x}) > 1}
                bad_y = {y for _, y in pairs if len({a for a, b in pairs if b == y}) > 1}
                kept = {k for k, slots in met if not any(x in bad_x or y in bad_y for x, y in slots)}
                if not (bad_x or bad_y) or 2 * len(kept) >= size:
                    total += len(kept)
            if size and total >= min(decontam.LEAST_WINDOWS, size):
                found[doc, item] = total
    return found


def test_decontamination_equals_plain_version(spark):
    """Copies, re-parameterised and inconsistent questions, short items and plain texts against windows compared one by one."""
    pick = random.Random(31)
    names, units, words = ["Anna", "Tom", "Mary Ann", "Zoe"], ["km", "apples", "dollars", "minutes"], [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]

    def fill(shape):
        return " ".join(pick.choice(names) if t == "N" else str(pick.randrange(2, 60)) if t == "D" else pick.choice(units) if t == "U" else t for t in shape)

    shapes = [[pick.choice(["N", "D", "D", "U", *[pick.choice(words) for _ in range(9)]]) for _ in range(pick.choice([2, 5, 7, 9, 14, 30]))] for _ in range(40)]
    items = [(i, ("See how " if i % 2 else "") + fill(s) + pick.choice(["", "?", "."])) for i, s in enumerate(shapes)]
    texts = []
    for k in range(160):
        shape, item = pick.choice(shapes), pick.choice(items)[1]
        inner = pick.choice([fill(shape), item, item.upper(), item.replace("Anna", "Bob"), " ".join(item.split()[: pick.randint(1, 12)]), item.replace("1", "2")])
        around = " ".join(pick.choice(words) for _ in range(pick.choice([0, 3, 20])))
        texts.append((k, f"{around} {inner} {around}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontam.report(docs(spark, texts), bench).collect()}
    assert got == plain_leaks(texts, items) and len(got) > 60


def test_pii_discovery_recall(spark):
    """Identifiers of no base kind after patterns that seeds taught; nothing in plain texts."""
    pick = random.Random(17)
    chunks = [f"{w}:" for w in ("contact", "login", "account", "reach-me", "user")]
    texts = [f"some words {c} u{i}@mail{i}.com and more" for c in chunks for i in range(20)]
    keys = ["".join(pick.choice("abcdef0123456789") for _ in range(pick.randint(8, 40))) + "7" for _ in range(120)]
    planted = {len(texts) + i: k for i, k in enumerate(keys)}
    texts += [f"text before {pick.choice(chunks)} {k} and after" for k in keys]
    clean = range(len(texts), len(texts) + 120)
    texts += [f"plain words number {pick.randrange(10**7)} room{i:03}a1 free" for i in range(120)]
    got = {r.doc_id: r.spans for r in pii.extract(docs(spark, enumerate(texts))).collect()}
    found = sum(got[i] == f"id:{texts[i].index(k)}:{texts[i].index(k) + len(k)}" for i, k in planted.items())
    assert found >= 0.9 * len(planted) and all(got[i] == "" for i in clean)


def test_warc(spark, tmp_path):
    htmls = ["same", "", None, "a\r\n\r\nWARC/1.1\r\nb", "same", "é漢", "same", "x" * 5000, ""]
    rows = [(i * 7 - 3, f"http://h/{i}\r\nX: y" if i == 3 else f"http://h/{i}", h) for i, h in enumerate(htmls)]
    df = spark.createDataFrame([*rows, (None, None, "lone")], "page_id long, url string, html string")
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    got = {r.page_id: r for r in warc.digests(df).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""])
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    assert got[None].record_type == "response"
    for least, kinds in ((0, {"response": 6, "revisit": 4}), (5, {"response": 10})):
        folder = f"file://{tmp_path}/archives{least}"
        warc.write(df, folder, least=least)
        read = warc.read(spark, folder)
        assert {r.record_type: r["count"] for r in read.groupBy("record_type").count().collect()} == kinds
        assert read.where("record_type = 'revisit' and payload is not null").isEmpty()
        whole = {r.page_id: r for r in warc.resolved(read).collect()}
        assert all(bytes(whole[i].payload).decode() == (h or "") for i, _, h in rows)
        assert all(whole[i].payload_bytes == len((h or "").encode()) for i, _, h in rows)
    assert warc.digests(df.limit(0)).collect() == []


def test_warc_large_records_and_clashes(spark, tmp_path, monkeypatch):
    """Files stay below a number of bytes whatever the records; repeated ids; more revisits than are broadcast."""
    monkeypatch.setattr(warc, "SIZES", ((100, 3), (2000, 2), (None, 1)))
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 1)
    htmls = ["s%d" % (i % 5) for i in range(12)] + ["m%d" % (i % 3) * 300 for i in range(7)] + ["L%d" % (i % 2) * 40_000 for i in range(4)]
    rows = [(i, "http://h", h, "x", 1, None) for i, h in enumerate(htmls)] + [(3, "http://h", "other text", "x", 1, None), (3, "http://h", "s3", "x", 1, None), (40, "http://h", "other text", "x", 1, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, original int, record_type string").coalesce(1)
    folder = f"{tmp_path}/archives"
    warc.write(df, f"file://{folder}")
    for i, (most, number) in enumerate(warc.SIZES):
        files = [f for f in os.listdir(f"{folder}/size{i}") if f.startswith("part-")]
        assert len(files) > 1 and all(os.path.getsize(f"{folder}/size{i}/{f}") <= number * ((most or 80_000) + 900) for f in files)
    got = sorted((r.page_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in warc.digests(df).collect())
    first = {}
    for i, _, h, *_ in rows:
        first[h] = min(first.get(h, i), i)
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert got == sorted((i, sha(h), len(h), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, _, h, *_ in rows)
    whole = warc.resolved(warc.read(spark, f"file://{folder}")).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in whole) == sorted((i, h) for i, _, h, *_ in rows)


def _pipeline_tables(spark, folder, clash=()):
    """Documents with a planted case for each stage, and their tables; returns the texts."""
    pick = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(pick.choice(words) for _ in range(60)) for _ in range(480)]
    labels = []
    for i in range(480):
        bad = i % 4 == 3
        if bad:
            own = texts[i].split()
            for _ in range(4):
                own.insert(pick.randint(0, len(own)), pick.choice(["vile", "scummy", "rotten"]))
            texts[i] = " ".join(own)
        if i != 151:
            labels.append((i, 1, int(bad)))
    texts[5], texts[6] = texts[4], texts[4] + " extra"
    item = " ".join(pick.choice(words) for _ in range(20))
    texts[12] += " " + item
    texts[8] += " write to me@here.org"
    rows = [*enumerate(texts), (None, None), (1200, ""), (1201, "word " * 100_000)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["z"] * len(clash)) for i, t in rows], DOCS + "".join(f", {c} string" for c in clash))
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows)


CLASH = ["_id", "_hash", "_spans", "_feature", "text_hash", "node", "n", "component_id", "item_id", "window", "shift", "added", "base", "words", "w", "x", "a", "s", "feature", "score", "v", "key", "value", "before", "word"]


@pytest.mark.parametrize("clash", [(), CLASH])
def test_pipeline(spark, tmp_path, clash):
    import corpus_pipeline

    folder = str(tmp_path)
    texts = _pipeline_tables(spark, folder, clash)
    toxic = {i for i in range(480) if i % 4 == 3}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE"]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "stage")
        assert k == 4 or docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = set(texts)
    # The unlabelled toxic document goes as well.
    assert seen[0] == every - toxic and 151 in toxic
    assert seen[1] == seen[0] - {5, 6} and seen[2] == seen[1] - {12} and seen[3] == seen[4] == seen[2]
    out = {r.doc_id: r for r in docs.collect()}
    assert all(r.round_trip for r in out.values()) and out[1201].n_tokens > 99_000 and out[None].n_tokens == 0
    if not clash:
        assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()} == {i: r.n_tokens for i, r in out.items()}


def test_pipeline_empty_tables(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and out.collect() == []


def test_columns_of_any_name(spark):
    """Every operator gives the same rows for a table with columns named like its own, and keeps them where it returns its input."""
    import public_tokenizers

    from pathloom.llm import bpe, chat, gif, langid, toxicity

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = [*CLASH, "ids", "n_tokens", "decoded", "piece_starts", "frames", "media", "lang_pred", "host", "path", "rule", "verdict", "payload", "original", "size", "turns", "mask", "formatted", "k", "suffix", "domain"]
    plain = docs(spark, [(i, f"user{i}@mail.com wrote some more words here {i} vile") for i in range(8)] + [(None, None), (3, "user3@mail.com")])
    wide = plain.select("*", *[paths_lit(c) for c in names])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "wrote some more words here 5 vile")], "item_id long, text string")
    pages = ("page_id long, url string, html string", [(1, "http://a.com/de/x", "h"), (2, "http://a.com/y", "h"), (None, None, None)])
    chats = ("conv_id long, turn long, role string, text string", [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, None, None, None)])
    for call, df in (
        (lambda d: bpe.digests(d, ranks), plain), (lambda d: toxicity.judge(d, labels), plain), (jaccard.assign, plain), (gif.digests, plain), (pii.extract, plain), (langid.identify, plain), (lambda d: decontam.report(d, bench), plain),
        (lambda d: chat.read_back(chat.format_conversations(d)), spark.createDataFrame(chats[1], chats[0])), (urlfilter.judge, spark.createDataFrame(pages[1], pages[0])), (warc.digests, spark.createDataFrame(pages[1], pages[0])),
    ):
        more = df.select("*", *[paths_lit(c) for c in names if c not in df.columns])
        assert sorted(map(str, call(more).collect())) == sorted(map(str, call(df).collect()))
    for call in (lambda d: toxicity.keep_clean(d, labels), pii.redact, lambda d: decontam.keep_clean(d, bench)):
        out = call(wide)
        assert out.columns == wide.columns and all(r["_id"] == "z" for r in out.collect())


def paths_lit(name):
    from pyspark.sql import functions as F

    return F.lit("z").alias(name)
