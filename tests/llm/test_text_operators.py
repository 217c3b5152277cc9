"""Tokens, toxicity, chat windows, languages and media against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import bpe, chat, gif, kernel, langid, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "a", "  \n", "don't we'll x's 's", " 's", "A" * 3000, "1 " * 500, "漢字 ñ é    x", "\x00\x01", "!?" * 50, "tab\tx  y\n\nz ", "'" * 9, "word" * 40 + " end"]


def test_bpe_equals_library(spark):
    import tiktoken

    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    pick = random.Random(3)
    texts = ODD + ["".join(pick.choice(" \n\t'sdmtlvre'aZé9½１ 　!?漢​''ll") for _ in range(pick.randint(0, 90))) for _ in range(3000)]
    merger = bpe.Merger(bpe.load_ranks(RANKS), most=200)
    for text, (ids, starts) in zip(texts, bpe.encode_texts(texts, merger), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        assert starts.tolist() == sorted(set(starts.tolist())) and (not text or starts[0] == 0)


def test_bpe_rows(spark):
    rows = [(i, t, None, "x", 1) for i, t in enumerate(ODD)] + [(None, None, None, None, None), (1, " ", "a", "b", 2), (1, " ", "a", "b", 2)]
    df = spark.createDataFrame([(*r, "old") for r in rows], DOCS + ", ids string")
    got = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert len(got) == len(rows)
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.ids) // 4 for r in got)
    found = {r.doc_id: r for r in bpe.digests(df, RANKS).collect()}
    assert found[2].decoded_sha256 == hashlib.sha256(b"a").hexdigest()
    assert bpe.digests(df.limit(0), RANKS).collect() == []


def test_bpe_round_trip(spark):
    import corpus_pipeline

    rows = [(i, t, None, "x", 1) for i, t in enumerate(ODD)] + [(None, None, None, None, None)]
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], DOCS + ", ids string, decoded int")
    for df in (df, df.limit(0)):
        got, want = bpe.round_trip(df, RANKS), bpe.decode(bpe.encode(df, RANKS), RANKS)
        assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # One Python worker for each task of the pipeline's last stage.
    plan = corpus_pipeline.to_tokens(spark, df, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_words_and_shingles():
    texts = ["One  two\tONE", "", "a b c d e f a b c d e", "é ü", " \n "]
    data, offsets = kernel.buffer_of(pa.array([*texts, None]))
    _, _, hashes, first = kernel.words(data, offsets)
    assert np.diff(first).tolist() == [3, 0, 11, 2, 0, 0]
    assert hashes[0] == hashes[2] != hashes[1]
    assert [len(s) for s in kernel.shingle_sets(data, offsets)] == [1, 0, 6, 1, 0, 0]


def _toxic_rows():
    pick = random.Random(5)
    rows, labels = [], []
    plain = [f"w{i}" for i in range(400)]
    for i in range(600):
        words = [pick.choice(plain) for _ in range(pick.randint(5, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(pick.randint(0, len(words)), pick.choice(["vile", "scummy", "rotten"]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = _toxic_rows()
    docs = spark.createDataFrame([*rows, (9000, None, None, None, None), (9001, "", None, None, None), (None, "!!", None, None, None)], DOCS)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, said).collect()}
    assert len(got) == 603
    for i in range(600):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    out = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == labels[i][2] for i in out) > 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = toxicity.keep_clean(docs, said)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.judge(docs, none).collect()] == [0]
    assert toxicity.judge(docs.limit(0), none).collect() == []


def test_toxicity_counts_do_not_mix(spark):
    """A toxic word and a frequent ordinary word whose hashes begin with the same 20 bits."""
    names = [f"{a}{i}" for a in ("n", "t") for i in range(6000)]
    data, offsets = kernel.buffer_of(pa.array([" ".join(names)]))
    top = dict(zip(names, (toxicity.word_ids(data, offsets)[0] >> np.uint64(44)).tolist(), strict=True))
    ordinary = {top[w]: w for w in names if w[0] == "n"}
    bad = next(w for w in names if w[0] == "t" and top[w] in ordinary)
    common = ordinary[top[bad]]
    pick = random.Random(8)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = [pick.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        for _ in range(1 if toxic else 6):
            words.insert(pick.randint(0, len(words)), bad if toxic else common)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    got = {r.doc_id: r for r in toxicity.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    out = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == labels[i][2] for i in out) > 0.95 * len(out)


def test_toxicity_rare_expressions(spark):
    """Toxic words of about eight left contexts each count, as discounts come from counts of counts."""
    pick = random.Random(6)
    plain, rare = [f"w{i}" for i in range(400)], [f"bad{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(800):
        words = [pick.choice(plain) for _ in range(40)]
        for _ in range(2 if i % 4 == 0 else 0):
            words.insert(pick.randint(0, len(words)), pick.choice(rare))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    docs, said = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, said).collect()}
    out = [i for i in range(800) if got[i].held_out]
    assert sum(got[i].predicted == labels[i][2] for i in out) > 0.9 * len(out)
    model, _ = toxicity.fit(docs, said)
    assert all(0 < d <= 1 for level in model.discounts.values() for d in level.values())


class PlainModel:
    """The toxicity docstring's levels, word by word, over (text, toxic) rows."""

    def __init__(self, rows):
        self.pairs = [Counter(), Counter()]
        for text, toxic in rows:
            w = plain_words(text)
            self.pairs[toxic].update(zip(["", *w], w, strict=False))
        self.pairs.append(self.pairs[0] + self.pairs[1])
        self.deep = [Counter(w for _, w in c) for c in self.pairs]
        self.total, self.kinds = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
        for c, total, kinds in zip(self.pairs, self.total, self.kinds, strict=True):
            for (h, _), n in c.items():
                total[h] += n
                kinds[h] += 1
        cut = lambda c: toxicity.discount(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()))
        self.d, self.dd = [cut(c) for c in self.pairs], [cut(c) for c in self.deep]
        self.down = max(self.dd[c] * len(self.deep[c]) / self.deep[c].total() for c in (0, 1))
        self.prior = max(0.0, math.log(len(self.pairs[0]) / len(self.pairs[1])))

    def word(self, c, w):
        deep, d = self.deep, self.dd
        share = d[2] * len(deep[2]) / deep[2].total()
        both = max(deep[2][w] - d[2], 0) / deep[2].total() + share / (len(deep[2]) + 1)
        kept = sum(n - d[c] for n in deep[c].values())
        return (1 - self.down) * max(deep[c][w] - d[c], 0) / kept + self.down * both

    def back(self, c, h):
        return self.d[c] * self.kinds[c][h] / self.total[c][h]

    def pair(self, c, h, w):
        low = self.word(c, w)
        if self.total[2][h]:
            low = max(self.pairs[2][h, w] - self.d[2], 0) / self.total[2][h] + self.back(2, h) * low
        if not (self.total[0][h] and self.total[1][h]):
            return low
        hand = max(self.back(0, h), self.back(1, h))
        return (1 - hand) * max(self.pairs[c][h, w] - self.d[c], 0) / (self.total[c][h] * (1 - self.back(c, h))) + hand * low

    def feature(self, text):
        w = plain_words(text)
        found = [math.log(self.pair(1, h, x) / self.pair(0, h, x)) - self.prior for h, x in zip(["", *w], w, strict=False)]
        return sum(max(0.0, x) for x in found) / len(w) if w else 0.0


def plain_words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


@pytest.mark.parametrize("rows_at_once", [2_000_000, 0])
def test_toxicity_equals_plain_model(spark, monkeypatch, rows_at_once):
    """Features equal those of a model written word by word, whose probabilities sum to 1; by look-up and by joins."""
    monkeypatch.setattr(toxicity, "TABLE_ROWS", rows_at_once)
    monkeypatch.setattr(toxicity, "COUNT_WORDS", 500)
    pick = random.Random(12)
    names = [f"w{int(i**1.5)}" for i in range(60)]
    texts = [" ".join(pick.choice(names[: pick.choice([5, 20, 60])]) for _ in range(pick.randint(1, 60))) for _ in range(150)]
    texts += [texts[0], texts[0], "", None, "W0, w1! w2", "only here", "x " * 30_000 + "foul thing", " ".join(texts * 3)]
    train = [(t + (" foul thing" if i % 3 == 0 and i % 2 else ""), int(i % 3 == 0)) for i, t in enumerate(t or "" for t in texts[:120])]
    plain = PlainModel(train)
    known = sorted(plain.deep[2])
    for h in [*known[:40], "", "unseen"]:
        for c in (0, 1):
            assert abs(sum(plain.pair(c, h, w) for w in [*known, "unseen"]) - 1) < 1e-9
    model = toxicity.Model(spark.createDataFrame(train, "text string, toxic int"))
    assert (model.table is None) == (rows_at_once == 0)
    rows = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, texts[0]), (3, texts[3])], "doc_id long, text string")
    got = model.features(rows).collect()
    assert len(got) == len({(r.doc_id, r.text_hash) for r in got})
    found = {r.doc_id: r.feature for r in got}
    want = {**{i: plain.feature(t) for i, t in enumerate(texts)}, None: plain.feature(texts[0])}
    assert set(found) == {i for i, x in want.items() if x > 1e-9}
    assert all(abs(want[i] - x) < 1e-6 for i, x in found.items())


def test_toxicity_columns_and_repeats(spark):
    rows, labels = _toxic_rows()
    rows = [*rows, *[(r[0], r[1], *r[2:]) for r in rows[:30]], (None, "vile scummy rotten vile", None, None, None), (7000, "vile rotten " * 200_000, None, None, None)]
    names = ["_id", "_hash", "_feature", "feature", "text_hash", "score", "toxic", "tuning", "word", "before", "value"]
    docs = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], DOCS + "".join(f", {n} string" for n in names))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, said).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.score) for r in got}) == 602
    kept = toxicity.keep_clean(docs, said)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.predicted)
    assert {r.predicted for r in got if r.doc_id in (None, 7000)} == {1}


def plain_windows(turns, budget, history):
    """Formatted windows, chosen by prefix sums over the whole conversation."""
    whole = [chat.formatted(*t) for t in turns]
    sums = [0]
    for w in whole:
        sums.append(sums[-1] + len(w))
    system = int(bool(turns) and turns[0][0] == "system")
    out, at = [], 0
    while at < len(turns):
        lead = sums[system] if at else 0
        backs = [k for k in range(system, at) if sums[at] - sums[k] <= history and lead + sums[at + 1] - sums[k] <= budget]
        back = min(backs, default=at) if at else 0
        end = max([at + 1, *(e for e in range(at + 1, len(turns) + 1) if lead + sums[e] - sums[back] <= budget)])
        out.append("".join(whole[: system if at else 0] + whole[back:end]))
        at = end
    return out


def test_chat_long_conversation(spark):
    """One conversation of most rows, over many batches, keeps its order."""
    rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k} " + "x" * (k % 50)) for k in range(30_000)] + [(k, 0, "assistant", "y") for k in range(100, 160)]
    pick = random.Random(3)
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, 500, 100)).collect()}
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in sorted(x for x in rows if x[0] == 7)).encode()).hexdigest()
    assert (got[7].n_turns, got[7].turns_sha256, len(got)) == (30_000, want, 61)
    assert got[7].loss_chars == sum(len(t) for c, _, r, t in rows if c == 7 and r == "assistant")


def test_chat_windows():
    pick = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<|", "<\\|", "<\\\\|x", "a", "\n", "<", "|", "\\"]
    for _ in range(300):
        turns = [(pick.choice(["system", "user", "assistant", "a\nb\\", "<|"]), "".join(pick.choice(bits) for _ in range(pick.randint(0, 40)))) for _ in range(pick.randint(1, 12))]
        made = list(chat.windows(turns, budget=300, history=80))
        assert [w["formatted"] for w in made] == plain_windows(turns, 300, 80)
        read, loss = [], []
        for window in made:
            new, targets = chat.read_window(window)
            read += new
            loss += targets
            assert new
            assert len(window["formatted"]) <= 300 or len(new) == 1
        assert read == turns
        assert loss == [text for role, text in turns if role == "assistant"]


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "y")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, windows string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert (got[2].n_turns, got[2].loss_chars, got[None].loss_chars) == (2, 0, 1)
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


def test_chat_budget_in_tokens(spark):
    known = bpe.Merger(bpe.load_ranks(RANKS))
    turns = [("user" if k % 2 else "assistant", ("some common words here " if k < 12 else "\u2603\u16a0\u0b83 ") * 9) for k in range(24)]
    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    count = lambda text: len(next(bpe.encode_texts([text], known))[0]) // 4
    made = sorted(chat.format_conversations(df, 300, 80, chat.token_sizes(RANKS)).collect(), key=lambda w: w.window)
    want = list(chat.windows(turns, 300, 80, count))
    assert [w.formatted for w in made] == [w["formatted"] for w in want]
    assert [w.formatted for w in made] != [w["formatted"] for w in chat.windows(turns, 300, 80)]
    assert any(len(w.formatted) > 300 for w in made)
    read = [chat.read_window(w.asDict(recursive=True)) for w in made]
    assert [t for new, _ in read for t in new] == turns
    for w, (new, _) in zip(made, read, strict=True):
        assert len(new) == 1 or count(w.formatted) <= 300


def test_languages(spark):
    pick = random.Random(2)
    words = {"xx": ["aba", "bab", "abba"], "yy": ["zoo", "ozo", "ooz"], "zz": ["kéké", "éke", "keé"]}
    rows = [(i, " ".join(pick.choice(words[x]) for _ in range(12)), x, "s", 1) for i, x in enumerate(list(words) * 60)]
    rows += [(1000, None, "xx", None, None), (1001, "12 34", None, None, None), (1002, "漢字漢字", None, None, None), (1003, "é", None, None, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:180])
    assert got[1000].lang_pred == got[1001].lang_pred == "und"
    assert got[1002].lang_pred in words and got[1003].lang_pred in words
    assert langid.identify(spark.createDataFrame([], DOCS)).collect() == []
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc", None, None, 3)], DOCS)).collect()] == ["und"]


@pytest.mark.parametrize("at_once", [4_000_000, 50])
def test_languages_equal_plain_sets(spark, monkeypatch, at_once):
    """Predictions and scores against exact sets of n-grams; 70 languages need two slices."""
    monkeypatch.setattr(langid, "COUNT_GRAMS", at_once)
    pick = random.Random(4)
    names = [f"l{i:02}" for i in range(70)] if at_once > 100 else ["b", "a", "c"]
    words = {x: ["".join(pick.choice("abcdefghé") for _ in range(pick.randint(2, 7))) for _ in range(12)] for x in names}
    text = lambda x: " ".join(pick.choice(words[x] + words[names[0]][:3]) for _ in range(pick.randint(1, 30)))
    rows = [(i, text(x), x) for i, x in enumerate(names * (6 if len(names) > 9 else 60))]
    rows += [(5000, "zzzz", None), (5001, text(names[1]).upper() * 3000, "b"), (None, text(names[2]), None), (5000, "zzzz", None), (5003, "ab", "a"), (5004, None, "a")]
    clash = ["lang_pred", "score", "held_out", "gram", "n", "cell", "lettered"]
    df = spark.createDataFrame([(*r, *["q"] * len(clash)) for r in rows], "doc_id long, text string, lang string" + "".join(f", {c} string" for c in clash))

    def plain(t):
        raw = bytes(b if b > 127 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in t.encode())
        return [raw[k : k + 4] for k in range(len(raw) - 3) if raw[k : k + 4] != b"    "]

    counts, docs = {}, Counter()
    for i, t, x in rows:
        if t is not None and x is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(x, Counter()).update(plain(t))
            docs[x] += 1
    share = {x: {g: n / c.total() for g, n in c.items() if n / c.total() >= langid.LEAST_SHARE} for x, c in counts.items()}
    best = Counter()
    for c in share.values():
        best |= Counter(c)
    sets = {x: {g for g, v in c.items() if v >= langid.CONTRAST * best[g]} for x, c in share.items()}
    found = langid.identify(df).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, t, _ in rows:
        hits = {x: sum(g in sets[x] for g in plain(t)) for x in sorted(sets)} if t else {}
        if t is None:
            want, score = "und", 0.0
        elif not sum(hits.values()):
            want, score = max(sorted(docs), key=lambda x: docs[x]), 1 / len(docs)
        else:
            want = max(hits, key=lambda x: hits[x])
            score = hits[want] / sum(hits.values())
        assert by_id[i].lang_pred == want and abs(by_id[i].score - score) < 1e-3, (i, t, want)


def plain_lzw(raw, size):
    """Samples of a code stream, bit by bit."""
    bits = "".join(f"{b:08b}"[::-1] for b in raw)
    clear, at, width, out = 1 << size, 0, size + 1, b""
    table, before = {}, b""
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, before = {i: bytes([i]) for i in range(clear)}, size + 1, b""
            table[clear] = table[clear + 1] = b""
        elif code == clear + 1:
            return out
        else:
            own = table[code] if code in table else before + before[:1]
            if before and len(table) < 4096:
                table[len(table)] = before + own[:1]
                width = max(width, min(12, len(table).bit_length()))
            out += own
            before = own


def test_lzw_equals_plain_reader():
    pick = np.random.default_rng(8)
    for size, n in ((8, 0), (8, 1), (8, 300), (8, 40000), (2, 700), (4, 30000), (8, 9000)):
        for top in (2, 1 << size):
            raw = pick.integers(0, top, n).astype(np.uint8)
            codes = gif.lzw_compress(raw.tobytes(), size)
            assert plain_lzw(codes, size) == raw.tobytes()
            assert gif.lzw_decode(np.frombuffer(codes, np.uint8), size, n).tobytes() == raw.tobytes()
    assert len(gif.lzw_compress(b"some words " * 5000)) < 6000


def test_lzw_full_table_without_clear():
    """A stream that goes on with a full table: literals of twelve bits after 4096 strings."""
    pick = np.random.default_rng(3)
    samples = pick.integers(0, 256, 12000)
    widths = np.concatenate(([9], gif._schedule(8)[0], np.full(len(samples) + 1 - 4096, 12)))
    codes = np.concatenate(([256], samples, [257]))
    raw = np.frombuffer(gif._pack(codes, widths), np.uint8)
    assert plain_lzw(raw, 8) == samples.astype(np.uint8).tobytes() == gif.lzw_decode(raw, 8, len(samples)).tobytes()


def test_gif_round_trip():
    pick = np.random.default_rng(4)
    for n in (1, 63, 254, 255, 256, 5000, 70000, 65535 * 64 + 1):
        for samples in (pick.integers(0, 256, n), pick.integers(0, 3, n)):
            frames = gif.text_frames(samples.astype(np.uint8))
            read = gif.decode(gif.encode(frames))
            assert b"".join(f["samples"] for f in read) == b"".join(f.tobytes() for f, _ in frames)
            assert [f["delay_ms"] for f in read] == [40] * len(frames)
            assert sum(read[0]["histogram"]) == len(read[0]["samples"])


def test_gif_disposal_and_transparency():
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    palette = np.zeros((256, 3), np.uint8)
    palette[:3] = red, green, blue

    def frame(left, top, values, disposal, clear):
        grid = np.array(values, np.uint8)
        h, w = grid.shape
        head = bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, 0, clear or 0, 0])
        return head + bytes([0x2C, left, 0, top, 0, w, 0, h, 0, 0, 8]) + gif._sub_blocks(gif.lzw_compress(grid.tobytes())) 

    screen = b"GIF89a" + bytes([2, 0, 2, 0, 0xF7, 0, 0]) + palette.tobytes()
    raw = screen + frame(0, 0, [[0, 0], [0, 0]], 1, None) + frame(0, 0, [[1, 2], [1, 2]], 3, 2) + frame(1, 1, [[2]], 2, None) + frame(0, 0, [[1]], 0, None) + b"\x3b"
    read = gif.decode(raw, pixels=True)
    seen = [[tuple(p) for row in f["pixels"].tolist() for p in row] for f in read]
    r, g, b, none = (*red, 255), (*green, 255), (*blue, 255), (0, 0, 0, 0)
    assert seen == [[r, r, r, r], [g, r, g, r], [r, r, r, b], [g, r, r, none]]
    assert [sum(f["histogram"]) for f in read] == [4, 4, 4, 3]
    assert [f["histogram"] for f in gif.decode(raw)] == [f["histogram"] for f in read]
    with pytest.raises(ValueError):
        gif.decode(raw[:-8])
    with pytest.raises(ValueError):
        gif.decode(b"no gif at all")


def test_gif_rows(spark):
    texts = [*ODD, None]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    for r in gif.digests(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert gif.read_frames(spark.createDataFrame([(None,)], "media binary")).collect()[0].frames == []
    assert gif.digests(df.limit(0)).collect() == []
