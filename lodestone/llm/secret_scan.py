"""Secret scanning with patterns and two character Markov models; DataFrame functions only.

Three patterns give the base spans.  The models add spans: strings of 20 or more
token characters are scored by the log-likelihood ratio of a Markov chain of
random strings to one of ordinary identifiers, both counted from labelled
samples over 65 character classes.  Counts are at most 2 x 65 x 65 numbers, so
they may pass through the driver and become a literal matrix.

Positions come from splitting the text at the matches: a match starts after the
pieces and matches before it.  They are code points, ends exclusive.  Running
lengths are added up in chunks, so that a text with very many matches costs little
more than one with few.

A span of the model may overlap base spans, but one that lies within a base span is
left out.

Defined results: a null or empty text has no spans; a model without samples adds
none (every ratio is 0); rows and other columns are kept, also those named like an
output: the spans' columns then get underscores behind their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run that fails the length fails from its first AKIA on, so the length can stand in the pattern
HEX = r"[0-9a-f]{16,}"  # likewise: runs are maximal
KINDS = ("assign", "access", "hex", "model")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_"  # '=' and '-' count as '_'
N = len(ALPHABET)
#: Prior counts of a row: uniform for random strings; for identifiers by how usual the next character is, so that unseen characters are rare.
PRIOR_RANDOM, PRIOR_ORDINARY = 325.0, 6.5
#: Mean log-likelihood ratio a transition from which a string counts as random.
THRESHOLD = 0.7

_SPAN = "struct<start: int, kind: int, end: int, found: string>"
_CHUNK = 64


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), 0)


def _totals(sizes: Column) -> Column:
    """Running totals of an array of ints: what stands before each entry.  Arrays grow by one entry a step within chunks only."""
    empty = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    chunk = lambda c: F.aggregate(c, empty(), step)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int")), lambda i: chunk(F.slice(sizes, i * _CHUNK + 1, _CHUNK)))
    whole = _let(chunks, lambda cs: F.zip_with(cs, F.aggregate(F.transform(cs, lambda c: c["at"]), empty(), step, lambda acc: acc["out"]), lambda c, base: F.transform(c["out"], lambda x: x + base)))
    return F.when(F.size(sizes) > 0, F.flatten(whole)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, pattern: str, kind: int, values: Column | None = None, least: int = 0) -> Column:
    """Spans of the matches, in order; those whose value is shorter than ``least`` are dropped after matching."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(rows: Column) -> Column:
        # rows: gap before a match, match, length of its value; the last row has only a gap
        ends = _totals(F.transform(rows, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))))
        spans = F.zip_with(rows, ends, lambda x, at: F.struct((at + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"), (at + F.length(x["gap"]) + F.length(x["m"])).alias("end"), x["m"].alias("found"), x["size"].alias("size")))
        kept = F.filter(spans, lambda s: s["found"].isNotNull() & (s["size"] >= least))
        return F.transform(kept, lambda s: F.struct(s["start"], s["kind"], s["end"], s["found"]))

    value = lambda m: F.transform(m if values is None else values, lambda v: F.length(v))
    return _let(found, lambda m: _let(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), m.alias("m"), value(m).alias("size")), of)).cast(f"array<{_SPAN}>")


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, ordered by start, then kind."""
    low = F.lower(text)
    may_assign = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return F.array_sort(
        F.concat(
            F.when(may_assign, _spans(text, ASSIGN, 0, values, ASSIGN_LEAST)).otherwise(_none()),
            F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(_none()),
            F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(_none()),
        )
    )


# --- the models ----------------------------------------------------------------


def labelled_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, secret): every token of the corpus, labelled by whether a pattern knows it as a secret."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.lower(t)
    may = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    known = F.when(may, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(known.alias("known"), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)
    return rows.select("known", F.explode("tokens").alias("token")).select("token", (F.array_contains("known", F.col("token")) | F.col("token").rlike(f"^{HEX}$|{ACCESS}")).alias("secret"))


def train(samples: DataFrame, token: str = "token", secret: str = "secret") -> list[float]:
    """Log-likelihood ratios of the N x N transitions, row by row; samples with null token or label are left out."""
    pairs = (
        samples.where(F.col(token).isNotNull() & F.col(secret).isNotNull() & (F.length(token) > 1))
        .select(F.col(secret).cast("boolean").alias("s"), F.translate(F.col(token), "=-", "__").alias("t"))
        .select("s", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))).alias("pair"))
        .groupBy("s", "pair")
        .agg(F.count("*").alias("n"))
        .where(F.col("pair").rlike(f"^[{ALPHABET}]{{2}}$"))
    )
    counts = {True: [[0] * N for _ in range(N)], False: [[0] * N for _ in range(N)]}
    seen = False
    for r in pairs.collect():  # 2 x N x N at most
        counts[r["s"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["n"]
        seen = True
    if not seen:
        return [0.0] * (N * N)
    single = [0.5 + sum(row[b] for row in counts[False]) for b in range(N)]
    usual = [n / sum(single) for n in single]
    out = []
    for a, b in zip(counts[True], counts[False], strict=True):
        x, y = sum(a) + PRIOR_RANDOM, sum(b) + PRIOR_ORDINARY
        out += [round(math.log((p + PRIOR_RANDOM / N) / x) - math.log((q + PRIOR_ORDINARY * u) / y), 5) for p, q, u in zip(a, b, usual, strict=True)]
    return out


def token_score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of a token (of token characters)."""
    place = [-1] * 128
    for i, c in enumerate(ALPHABET):
        place[ord(c)] = i
    place[ord("=")] = place[ord("-")] = ALPHABET.index("_")
    lit = lambda v, t: F.from_json(F.lit(json.dumps(v)), f"array<{t}>")
    where, matrix = lit(place, "int"), lit(ratios, "double")
    let = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    codes = F.transform(F.split(token, ""), lambda c: F.get(where, F.ascii(c)))
    total = lambda c: F.aggregate(F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.get(matrix, a * N + b)), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return let(codes, lambda c: total(c) / F.greatest(F.size(c) - 1, F.lit(1)))


def scan(docs: DataFrame, ratios: list[float] | None = None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with two columns behind its own, base and spans: arrays of (start, kind, end, found), kinds numbered as in ``KINDS``."""
    base, spans, added = fresh(docs, "base"), fresh(docs, "spans"), fresh(docs, "__added")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn(base, base_spans(t))
    if ratios is None:
        return out.withColumn(spans, F.col(base))
    tokens = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    is_random = lambda x: token_score(x, ratios) > threshold
    within = lambda s: F.exists(F.col(base), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    found = F.filter(_spans(t, TOKEN, 3), lambda s: is_random(s["found"]) & ~within(s))
    out = out.withColumn(added, F.when(F.exists(tokens, is_random), found).otherwise(_none()))
    return out.withColumn(spans, F.array_sort(F.concat(base, added))).drop(added)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, but for those named like an output, with counts, base_sha256 and listed spans of what ``scan`` returned."""
    base, spans = (F.col(c) for c in scanned.columns[-2:])
    n = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    out = {"n_assign": n(0), "n_access": n(1), "n_hex": n(2), "base_sha256": F.sha2(listed(base), 256), "spans": listed(spans)}
    return scanned.select(*(c for c in keep if c not in out), *(v.alias(k) for k, v in out.items()))


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """What ``scan`` returned with every span of ``text`` replaced by ``mark`` (overlapping ones by one mark), without the spans' columns."""
    t, (base, spans) = F.col(text), scanned.columns[-2:]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def end(acc: Column) -> Column:
        return F.array_join(F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, F.length(t)))), "")

    return scanned.withColumn(text, F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(t)).drop(base, spans)
