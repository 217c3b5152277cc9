"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Base entities (email, ip, card, phone) come from expressions and checks.  They are the seeds:
the whole chunk of text right before a seed is a lexical pattern (over 64 characters its hash stands for it).  Patterns and instances (values
of identifier-like words with a digit, of any length) form a graph.  Scores go back and forth over it: a
pattern's score is the part of all its occurrences in the corpus that trusted instances
follow, an instance's score is the chance that one of its patterns is right.  Instances that
end above ``ACCEPT`` are found wherever they stand, as kind ``id``; base spans always stay.

The expressions are those of the definition, written so that Java's engine never
backtracks over long runs: a run's first character or the end of the last match is the only
place where a match can begin.

Defined results: null text is empty; positions count code points, ends exclusive; matches
that fail their check are dropped and not tried again; overlapping spans of different kinds
all stay; repeated rows get the same spans; texts are read whole, however long; other columns
of documents, of any name, pass through ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.kernel import fresh, materialize

KINDS = ("email", "ip", "card", "phone", "id")
#: Different seed values that a pattern needs, rounds of scoring, and the score from which an instance is found.
SUPPORT, ROUNDS, ACCEPT = 3, 3, 0.5
#: Patterns or instances of at most this many rows (under 100 MB) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_SPAN = "struct<start:int,k:int,end:int,v:bigint,p:string>"
#: Matches whose spans one task of a fold gathers; appending to an array copies it.
RUN = 256
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
#: SQL: the check digit of a card's digits, last digit first; from the second on every other one is doubled.
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> IF(i % 2 = 1, 2 * int(c) - IF(c > '4', 9, 0), int(c))), 0, (a, c) -> a + c) % 10 = 0"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Kind, expression, a cheap test of the whole text, and the check of a match.
_RULES = (
    (0, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(t, '@') > 0", "true"),
    (1, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"t RLIKE r'[0-9]\.[0-9]'", f"x.m RLIKE r'^{_BYTE}(?:[.]{_BYTE}){{3}}$'"),
    (2, r"[0-9](?:[ -]?[0-9])++", r"t RLIKE r'[0-9](?:[ -]?[0-9]){11}'", f"char_length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    (3, r"\+[0-9][ ().0-9-]+[0-9]", "instr(t, '+') > 0", f"char_length({_DIGITS}) BETWEEN 9 AND 15"),
)
_WORD = (4, r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+", "t RLIKE '[0-9]'", "true")


def _pattern(chunk: str) -> str:
    """SQL: a chunk as a pattern; a long one by its hash."""
    return f"IF(char_length({chunk}) > 64, concat('\\t', sha2({chunk}, 256)), {chunk})"


#: SQL: the last chunk of a gap; split is linear where an expression for the end would backtrack.
_LAST = _pattern("lower(coalesce(try_element_at(filter(split(x.b, r'\\s+'), w -> w <> ''), -1), ''))")


def _find(kind: int, rx: str, guard: str, valid: str) -> str:
    """SQL: the valid matches of one kind in ``t``, in order.

    Gaps between matches give the positions: runs of RUN matches are measured, their starts
    added up, and each run's spans folded on their own, so a text of n matches costs about
    RUN n rather than n n.
    """
    items = f"zip_with(regexp_extract_all(t, r'{rx}', 0), split(t, r'{rx}', -1), (m, g) -> named_struct('m', m, 'n', char_length(g), 'b', g))"
    part = f"slice(v, {RUN} * r + 1, {RUN})"
    starts = f"""aggregate(transform(sequence(0, (size(v) - 1) div {RUN}), r -> aggregate({part}, 0, (a, x) -> a + x.n + coalesce(char_length(x.m), 0))),
      named_struct('at', 0, 'out', cast(array() AS array<int>)), (s, n) -> named_struct('at', s.at + n, 'out', array_append(s.out, s.at)), s -> s.out)"""
    spans = f"""aggregate({part}, named_struct('at', at, 'out', cast(array() AS array<{_SPAN}>)),
      (s, x) -> IF(x.m IS NULL, s, named_struct('at', s.at + x.n + char_length(x.m), 'out', IF({valid}, array_append(s.out,
        named_struct('start', s.at + x.n, 'k', {kind}, 'end', s.at + x.n + char_length(x.m), 'v', xxhash64(lower(x.m)), 'p', {_LAST})), s.out))), s -> s.out)"""
    return f"CASE WHEN {guard} THEN element_at(transform(array({items}), v -> flatten(transform({starts}, (at, r) -> {spans}))), 1) ELSE cast(array() AS array<{_SPAN}>) END"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, words) of every row of docs: spans of the base kinds, and identifier-like words outside them."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("t"))
    base = "concat(" + ", ".join(_find(*rule) for rule in _RULES) + ")"
    found = texts.select("doc_id", "text_hash", F.expr(base).alias("base"), F.expr(_find(*_WORD)).alias("words"))
    return found.withColumn("words", F.expr("filter(words, w -> NOT exists(base, b -> b.start < w.end AND w.start < b.end))"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def discover(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Accepted instances (v, score) that are no seeds."""
    mentions = scanned.select(F.explode(F.concat("base", "words")).alias("m")).select("m.p", "m.v", (F.col("m.k") < 4).alias("seed")).where("p <> ''")
    edges = mentions.groupBy("p", "v").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = materialize(edges, "mentions")
    patterns = edges.groupBy("p").agg(F.count("*").alias("values"), F.sum("n").alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds")).where(f"seeds >= {SUPPORT}")
    patterns = materialize(patterns, "patterns")
    few = _small(patterns.select("p"))
    # What else follows a pattern: all its occurrences as a word of the corpus.
    words = docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).select(F.expr(_pattern("w")).alias("p"))
    counted = words.join(few, "p").groupBy("p").agg(F.count("*").alias("all"))
    totals = patterns.join(counted, "p", "left").select("p", F.greatest("n", F.coalesce("all", F.lit(0))).cast("double").alias("total"))
    graph = materialize(edges.join(totals, "p"), "graph")
    score = graph.groupBy("v").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(ROUNDS):
        rated = graph.join(score, "v").groupBy("p").agg((F.sum(F.col("score") * F.col("n")) / F.max("total")).alias("right"))
        right = F.least("right", F.lit(0.999))
        score = graph.join(rated, "p").groupBy("v").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(1 - right)))).alias("made"))
        score = materialize(score.select("v", F.expr("if(seed, 1D, made)").alias("score"), "seed"), "scores")
    return score.where(f"not seed and score >= {ACCEPT}").select("v", "score")


def found_words(scanned: DataFrame, accepted: DataFrame) -> DataFrame:
    """(doc_id, text_hash, added: spans of kind id) of texts that hold accepted instances."""
    words = scanned.select("doc_id", "text_hash", F.explode("words").alias("w"))
    hit = words.join(_small(accepted.select("v")), F.col("w.v") == F.col("v"), "left_semi")
    return hit.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(F.col("w.start").alias("start"), F.col("w.k").alias("k"), F.col("w.end").alias("end"))).alias("added"))


def _attach(rows: DataFrame, added: DataFrame) -> DataFrame:
    """rows (with doc_id and text_hash) and an ``added`` column; null ids meet."""
    added = added.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "added")
    return rows.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")


_ALL = "array_sort(concat(transform(base, b -> named_struct('start', b.start, 'k', b.k, 'end', b.end)), coalesce(added, cast(array() AS array<struct<start:int,k:int,end:int>>))))"


def _joined(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"concat_ws(',', transform({spans}, s -> concat(element_at(array({kinds}), s.k + 1), ':', s.start, ':', s.end)))"


def extract(docs: DataFrame) -> DataFrame:
    """The op6 row of every document."""
    scanned = materialize(scan(docs), "scanned")
    added = found_words(scanned, materialize(discover(docs, scanned), "accepted"))
    whole = _attach(scanned.select("doc_id", "text_hash", "base"), added).select("doc_id", "base", F.expr(_ALL).alias("every"))
    counts = [F.expr(f"cast(size(filter(base, b -> b.k = {k})) AS bigint)").alias(f"n_{KINDS[k]}") for k in range(4)]
    return whole.select("doc_id", *counts, F.sha2(F.expr(_joined("filter(every, s -> s.k < 4)")), 256).alias("base_sha256"), F.expr(_joined("every")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in brackets; all other columns and null texts stay."""
    scanned = materialize(scan(docs), "scanned")
    added = found_words(scanned, materialize(discover(docs, scanned), "accepted"))
    # Texts without spans, nearly all, are not joined with more than a key.
    a, b, c = fresh(docs, 3)
    spans = _attach(scanned.select("doc_id", "text_hash", "base"), added).select(F.col("doc_id").alias(a), F.col("text_hash").alias(b), F.expr(_ALL).alias(c)).where(f"size({c}) > 0").distinct()
    spans = materialize(spans, "spans")
    joined = docs.join(_small(spans), docs["doc_id"].eqNullSafe(F.col(a)) & (F.xxhash64(docs["text"]) == F.col(b)), "left")
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    text = F.expr(f"""CASE WHEN {c} IS NULL THEN text ELSE aggregate({c}, named_struct('at', 0, 'out', cast(array() AS array<string>)),
      (a, s) -> IF(s.start < a.at, named_struct('at', greatest(a.at, s.end), 'out', a.out),
        named_struct('at', s.end, 'out', concat(a.out, array(substring(text, a.at + 1, s.start - a.at), element_at(array({kinds}), s.k + 1))))),
      a -> concat(array_join(a.out, ''), substring(text, a.at + 1))) END""")
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
