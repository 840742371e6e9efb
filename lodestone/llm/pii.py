"""Personal data: overlapping candidates, boosted trees over format and context, thresholds calibrated on held-out samples.

*Base.*  Four patterns (e-mail, IP address, card, phone) give the base spans, each
kind leftmost and without overlaps of its own; what fails its check is dropped.

*Candidates.*  Generators propose, of every text, far more than the patterns take: every run of
neighbouring digit groups of a cluster that has as many digits as a card or phone may
have, every four dotted groups in a row, and addresses whose sign or dots are
written out.  Candidates overlap each other; those within a base span are left out.

*Labels.*  A base span that is also a candidate is a positive sample of its kind.  Candidates that a check refutes (a
card whose digits fail their checksum, a part of an address over 255, digits inside a word, a bare number as a phone) or
that cross a base span are negative.  The rest is what the model is for: it is scored, never learned from.

*Model.*  Samples of equal kind, label, string and features count once, so that copies of a document don't outvote the rest.
For each kind gradient-boosted trees (logistic loss, second-order leaves, binned features) are fitted on all samples: they stay
on the executors, equal ones as one row with their number, and a level of a tree is chosen by the sum of their histograms.  Bins are cut at
the quantiles of all of a kind's samples, whatever their labels.  Trees fitted without a quarter of the samples score that quarter; those scores become probabilities by Platt's sigmoid, and a kind's threshold is the lowest probability from which on the
lower bound of their precision reaches ``PRECISION``.  A kind with fewer than ``LEAST_SAMPLES`` of either label adds nothing.

Of candidates that pass, a kind's spans are chosen by probability, then length, then place, without overlaps within
a kind or with base spans of the same kind; spans of different kinds may overlap.

Positions are code points, ends exclusive.  Defined results: null and empty texts have no spans; rows are kept one for
one, repeated rows alike; columns are carried, whatever their names, but for those named like an output.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import fresh, materialise, ship

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
# The four patterns
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_EMAIL, _IP, _CARD, _PHONE = map(re.compile, PATTERNS)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Clusters of digit groups, and addresses written out.
_CLUSTER = re.compile(r"[+(]{0,2}[0-9]+(?:[ ().-]{1,3}[0-9]+)*\)?")
_GROUP = re.compile(r"[0-9]+")
_SPOKEN = re.compile(r"([A-Za-z0-9._%+-]+)(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|\x20?@\x20?)([A-Za-z0-9-]+(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+)")
_SIGN = re.compile(r"@|[\[({ ]at[\])} ]")
CUES = re.compile(r"\b(?:tel|telephone|phone|fax|mobile|cell|call|card|visa|mastercard|credit|pay|mail|email|e-mail|contact|ip|host|addr|address|server|from)\b", re.I)
PRECISION, LEAST_SAMPLES, FOLDS = 0.9, 30, 4
ROUNDS, DEPTH, RATE, BINS, LAMBDA = 60, 3, 0.25, 32, 1.0
AROUND = 24
#: Gradients are multiples of this, so that their sums are the same in whatever parts and order they are added.
STEP = 2.0**-20
#: Cells of a part, and trees after which parts are scored from the start.
EACH, REBASE = 20_000, 10
FEATURES = (
    "digits", "groups", "longest group", "shortest group", "first group", "last group", "length", "spaces", "dashes", "dots", "brackets",
    "balanced", "checksum", "parts up to 255", "leading zero", "four groups", "letters", "ats", "last label", "labels", "left class", "right class",
    "left mark", "right mark", "cue before", "distinct digits",
)
SPAN = "array<struct<start: int, kind: int, end: int>>"


def checksum(digits: str) -> bool:
    """Luhn's: every second digit from the right counts twice, its digits summed; the total ends in 0."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _small(part: str) -> bool:
    rest = part.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def _card(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 12 <= len(d) <= 19 and checksum(d)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = []
    if "@" in text:
        out += emails(text)
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((m.start(), IP, m.end()))
    out += [(m.start(), CARD, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and _card(m.group())]
    if "+" in text:
        out += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


def emails(text: str) -> list[tuple[int, int, int]]:
    """Matches of the address pattern: around each sign, so that a long text without blanks is read once."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((begin, EMAIL, m.end()))
        at = text.find("@", done)
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the generators propose, base spans included, without what lies within a base span."""
    out = []
    if _SIGN.search(text):
        out += [(m.start(), EMAIL, m.end()) for m in _SPOKEN.finditer(text)]
    for m in _CLUSTER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m.group())]
        if sum(b - a for a, b in groups) < 7:
            continue
        for i, (a, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                b = groups[j][1]
                if digits > 19:
                    break
                if digits >= 12:
                    out.append((a, CARD, b))
                if 7 <= digits <= 15:
                    lead = a
                    while lead > m.start() and text[lead - 1] in "+(":
                        lead -= 1
                    out.append((lead, PHONE, b))
        for i in range(len(groups) - 3):
            a, b = groups[i][0], groups[i + 3][1]
            if all(groups[k + 1][0] - groups[k][1] == 1 and text[groups[k][1]] == "." for k in range(i, i + 3)):
                out.append((a, IP, b))
    exact, strict = set(base), []
    for s, k, e in out:
        if (s, k, e) in exact or not any(a <= s and e <= b for a, _, b in _near(base, s, e)):
            strict.append((s, k, e))
    return sorted(set(strict))


def _near(base, s, e):
    return [x for x in base if x[0] < e and s < x[2]]


def _side(c: str) -> int:
    return 0 if c == "" else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """The values of ``FEATURES``; a sign before a phone number is not one of them, so that it isn't what phones are known by."""
    s, kind, e = span
    found = text[s:e]
    body = found.lstrip("+")
    groups = _GROUP.findall(body)
    digits, sizes = "".join(groups), list(map(len, groups)) or [0]
    left, right = text[s - 1 : s] if s else "", text[e : e + 1]
    labels = re.split(r"\.|dot", found.rpartition("@")[2]) if kind == EMAIL else [""]
    return [
        len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], len(body), body.count(" "), body.count("-"), body.count("."), body.count("(") + body.count(")"),
        body.count("(") == body.count(")"), kind == CARD and checksum(digits), all(map(_small, groups)), any(len(g) > 1 and g[0] == "0" for g in groups), len(groups) == 4,
        sum(map(str.isalpha, found)), found.count("@"), len(labels[-1].strip(" ])}")), len(labels), _side(left), _side(right),
        ord(left) if left and ord(left) < 128 else 128, ord(right) if right and ord(right) < 128 else 128, bool(CUES.search(text[max(0, s - AROUND) : s])), len(set(digits)),
    ]


def label(text: str, span: tuple[int, int, int], base: list[tuple[int, int, int]], values: list[float]) -> int | None:
    """1, 0 or, for what the checks can't tell, None."""
    s, kind, e = span
    if span in base:
        return 1
    if _near(base, s, e):
        return 0
    v = dict(zip(FEATURES, values, strict=True))
    inside = v["left class"] in (1, 2) or v["right class"] in (1, 2)
    if kind == CARD:
        return 0 if inside or not v["checksum"] else None
    if kind == IP:
        return 0 if inside or not v["parts up to 255"] or "." in (text[s - 1 : s], text[e : e + 1]) else None
    if kind == PHONE:
        return 0 if inside or v["groups"] == 1 and not v["cue before"] else None
    return 0 if not v["ats"] and not re.search(r"[\[({]", text[s:e]) and not v["cue before"] else None


def propose(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all, by default) with three behind them: base spans, candidates, and for each candidate its features and label (-1: none)."""
    spark = docs.sparkSession
    ship(spark)
    keep = tuple(docs.columns if keep is None else keep)
    body = fresh(docs, "__body")
    names = [fresh(docs, c) for c in ("base", "candidates", "samples")]
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL(f"a {SPAN}, b {SPAN}, c array<struct<label: int, key: bigint, x: array<float>>>").fields])
    schema = T.StructType([*schema.fields[:-3], *(T.StructField(n, f.dataType) for n, f in zip(names, schema.fields[-3:], strict=True))])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    sample_type = pa.list_(pa.struct([("label", pa.int32()), ("key", pa.int64()), ("x", pa.list_(pa.float32()))]))
    as_rows = lambda spans: [{"start": s, "kind": k, "end": e} for s, k, e in spans]

    def run(batches):
        tk.begin()
        for batch in batches:
            base, found, samples = [], [], []
            for t in batch.column(len(keep)):
                t = t.as_py() or ""
                b = base_spans(t)
                c = candidates(t, b)
                x = [features(t, s) for s in c]
                y = [label(t, s, b, v) for s, v in zip(c, x, strict=True)]
                base.append(as_rows(b))
                found.append(as_rows(c))
                samples.append([{"label": -1 if q is None else q, "key": zlib.crc32(t[i:j].encode("utf-8", "replace")), "x": list(map(float, v))} for (i, _, j), q, v in zip(c, y, x, strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(base, span_type), pa.array(found, span_type), pa.array(samples, sample_type)], schema.fieldNames())

    return docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(body)).mapInArrow(run, schema)


# --- boosted trees -------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees of one depth: node i of a tree has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


@dataclass
class Cells:
    """Samples of a kind by binned features, label and fold, with their number; several models score them at once."""

    bins: np.ndarray  # cells x features
    y: np.ndarray
    fold: np.ndarray
    count: np.ndarray
    raw: np.ndarray  # cells x models


@dataclass
class Kind:
    """What is known of a kind's samples: edges of the bins by feature, the number by fold and label, and the fold that each model leaves out (-1: none)."""

    edges: list[np.ndarray]
    count: np.ndarray  # folds x labels
    without: list[int]

    def first(self) -> np.ndarray:
        """Where a feature's bins begin among all bins of a node, and their end."""
        return np.cumsum([0, *(len(e) + 1 for e in self.edges)])

    def weight(self) -> np.ndarray:
        """Models x folds x labels: labels count alike in all, and a fold that is left out counts nothing."""
        out = np.zeros((len(self.without), *self.count.shape))
        for m, k in enumerate(self.without):
            used = np.arange(len(self.count)) != k
            n = self.count[used].sum(0)
            out[m, used] = 0.5 / np.maximum(1, n) * n.sum()
        return out


Part = dict[int, Cells]  # by kind
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]  # of each model: features and last bins to the left of inner nodes, leaves


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.uint8)  # value > edges[b - 1]


def _placed(bins: np.ndarray, feature: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    rows, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (bins[rows, feature[node]] > last[node])
    return node


def _histograms(part: Part, shape: dict[int, tuple[np.ndarray, np.ndarray]], trees: dict[int, Tree], level: int) -> dict[int, np.ndarray]:
    """By kind, gradients and curvatures (models x 2 x nodes of the level x bins) of a part's samples."""
    out = {}
    for kind, c in part.items():
        first, weight = shape[kind]
        width, size = 1 << level, first[-1]
        sums = np.zeros((len(weight), 2, width * size))
        for m, w in enumerate(weight):
            node = _placed(c.bins, trees[kind][0][m], trees[kind][1][m], level) - (width - 1)
            at = (node[:, None] * size + first[:-1] + c.bins).ravel()
            p, n = 1 / (1 + np.exp(-c.raw[:, m])), c.count * w[c.fold, c.y]
            for i, v in enumerate((n * (p - c.y), n * p * (1 - p))):
                sums[m, i] = np.bincount(at, np.repeat(np.round(v / STEP) * STEP, c.bins.shape[1]), width * size)
        out[kind] = sums.reshape(len(weight), 2, width, size)
    return out


def _split(sums: np.ndarray, first: np.ndarray) -> Tree:
    """The best split of each model and node of a level (none: all to the left), and the leaves that it makes."""
    g, h = sums[:, 0], sums[:, 1]
    total_g, total_h = (v[..., : first[1]].sum(-1) for v in (g, h))
    best, feature, last = np.full(total_g.shape, 1e-9), np.zeros(total_g.shape, np.int64), np.full(total_g.shape, BINS)
    left_g, left_h = total_g, total_h
    for j, (a, b) in enumerate(zip(first, first[1:])):
        if b - a < 2:
            continue
        lg, lh = (v[..., a:b].cumsum(-1)[..., :-1] for v in (g, h))
        rg, rh = total_g[..., None] - lg, total_h[..., None] - lh
        gain = lg**2 / (lh + LAMBDA) + rg**2 / (rh + LAMBDA) - (total_g**2 / (total_h + LAMBDA))[..., None]
        gain[(lh < 1) | (rh < 1)] = 0
        top = gain.argmax(-1)
        value, to_g, to_h = (np.take_along_axis(v, top[..., None], -1)[..., 0] for v in (gain, lg, lh))
        better = value > best
        best, feature, last = np.where(better, value, best), np.where(better, j, feature), np.where(better, top, last)
        left_g, left_h = np.where(better, to_g, left_g), np.where(better, to_h, left_h)
    leaf = -RATE * np.stack([left_g, total_g - left_g], -1) / (np.stack([left_h, total_h - left_h], -1) + LAMBDA)
    return feature, last, leaf.reshape(len(leaf), -1)


def _advanced(part: Part, made: list[dict[int, Tree]], depth: int) -> Part:
    """The part, scored by further trees."""
    out = {}
    for kind, c in part.items():
        raw = c.raw.copy()
        for feature, last, leaf in (t[kind] for t in made):
            for m in range(raw.shape[1]):
                raw[:, m] += leaf[m][_placed(c.bins, feature[m], last[m], depth) - len(feature[m])]
        out[kind] = replace(c, raw=raw)
    return out


def _joined(parts: Iterable[Part]) -> Part:
    """The samples of all parts, in one."""
    by: dict[int, list[Cells]] = {}
    for part in parts:
        for kind, c in part.items():
            by.setdefault(kind, []).append(c)
    return {k: Cells(*(np.concatenate([getattr(c, f.name) for c in v]) for f in fields(Cells))) for k, v in by.items()}


def _added(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {k: a[k] + b[k] if k in a and k in b else a[k] if k in a else b[k] for k in a.keys() | b.keys()}


class OnePart:
    """Samples in one place."""

    def __init__(self, part: Part):
        self.part = part

    def total(self, f) -> dict[int, np.ndarray]:
        return f(self.part)

    def advance(self, tree: dict[int, Tree], depth: int) -> None:
        self.part = _advanced(self.part, [tree], depth)


class ManyParts:
    """Samples that stay on the executors: their sums come to the driver, trees go to them."""

    def __init__(self, parts: RDD):
        self.base = self.now = parts.persist(StorageLevel.MEMORY_AND_DISK)
        self.made: list[dict[int, Tree]] = []
        self.old: list[RDD] = []
        self.depth = 1 if parts.getNumPartitions() <= 32 else 2

    def total(self, f) -> dict[int, np.ndarray]:
        out = self.now.map(f).treeReduce(_added, self.depth)
        while self.old:  # what is read now is kept by itself
            self.old.pop().unpersist()
        return out

    def advance(self, tree: dict[int, Tree], depth: int) -> None:
        self.made.append(tree)
        if self.now is not self.base:
            self.old.append(self.now)
        whole = len(self.made) % REBASE == 0  # so that a lost part is few steps away
        source, made = (self.base, list(self.made)) if whole else (self.now, [tree])
        self.now = source.map(lambda part: _advanced(part, made, depth)).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        for r in (*self.old, self.now, self.base):
            r.unpersist()


def grow(samples: OnePart | ManyParts, kinds: dict[int, Kind], rounds: int = ROUNDS, depth: int = DEPTH) -> dict[int, list[Trees]]:
    """Newton boosting of the logistic loss over binned features, of every model of every kind at once; a level of a tree is one sum over all samples."""
    shape = {k: (v.first(), v.weight()) for k, v in kinds.items()}
    made: dict[int, list[Tree]] = {k: [] for k in kinds}
    for _ in range(rounds):
        tree = {k: (np.zeros((len(v.without), (1 << depth) - 1), np.int64), np.full((len(v.without), (1 << depth) - 1), BINS), np.zeros(0)) for k, v in kinds.items()}
        for level in range(depth):
            now = dict(tree)
            sums = samples.total(lambda part, now=now, level=level: _histograms(part, shape, now, level))
            for k, s in sums.items():
                feature, last, leaf = _split(s, shape[k][0])
                at = slice((1 << level) - 1, (2 << level) - 1)
                tree[k][0][:, at], tree[k][1][:, at] = feature, last
                tree[k] = *tree[k][:2], leaf
        samples.advance(tree, depth)
        for k, t in tree.items():
            made[k].append(t)

    def whole(kind: Kind, trees: list[Tree], m: int) -> Trees:
        feature, last, leaf = (np.stack([t[i][m] for t in trees]) for i in range(3))
        cut = np.full(feature.shape, np.inf)
        for i in zip(*np.nonzero(last < BINS)):
            cut[i] = kind.edges[feature[i]][last[i]]
        return Trees(feature, cut, leaf, 0.0)

    return {k: [whole(v, made[k], m) for m in range(len(v.without))] for k, v in kinds.items()}


#: Where bins are cut, as shares of the samples.
SHARES = np.linspace(0, 1, BINS + 1)[1:-1]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """``grow`` for one kind and model of samples in one place."""
    edges = [np.unique(np.quantile(x[:, j], SHARES)) for j in range(x.shape[1])]
    y = np.asarray(y, np.int64)
    cells = Cells(binned(x, edges), y, np.zeros(len(y), np.int64), np.ones(len(y)), np.zeros((len(y), 1)))
    return grow(OnePart({0: cells}), {0: Kind(edges, np.bincount(y, minlength=2)[None], [-1])}, rounds, depth)[0][0]


def _platt_sums(raw: np.ndarray, y: np.ndarray, count: np.ndarray, a: float, b: float, n1: float, n0: float) -> np.ndarray:
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
    w = np.maximum(p * (1 - p), 1e-9)
    return np.array([(count * v).sum() for v in ((p - t) * raw, p - t, w * raw * raw, w * raw, w)])


def sigmoids(total, size: dict[int, tuple[float, float]]) -> dict[int, tuple[float, float]]:
    """By kind, slope and offset of the sigmoid that fits held-out labels, by Newton steps with smoothed targets; ``size`` has its positive and negative samples, and ``total`` gives ``_platt_sums`` over all samples."""
    fit, going = {k: (1.0, 0.0) for k in size}, set(size)
    for _ in range(50):
        if not going:
            break
        sums = total({k: (*fit[k], *size[k]) for k in going})
        for k in sorted(going):
            (a, b), (ga, gb, haa, hab, hbb) = fit[k], sums[k]
            step = np.linalg.solve(np.array([[haa + 1e-3, hab], [hab, hbb + 1e-9]]), np.array([ga + 1e-3 * (a - 1), gb]))
            step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            fit[k] = max(1e-3, a - float(step[0])), b - float(step[1])
            if np.abs(step).max() < 1e-8:
                going.discard(k)
    return fit


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``sigmoids`` for one kind of samples in one place."""
    return sigmoids(lambda fit: {0: _platt_sums(raw, y, np.ones(len(y)), *fit[0])}, {0: (y.sum(), (1 - y).sum())})[0]


def _lowest(p: np.ndarray, hit: np.ndarray, n: np.ndarray, precision: float) -> float:
    """``threshold`` of different probabilities, falling, with hits and samples from the first on."""
    q, z = hit / n, 1.645
    low = (q + z * z / (2 * n) - z * np.sqrt(q * (1 - q) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = np.flatnonzero((low >= precision) & (p >= 0.5))
    return float(p[good[-1]]) if len(good) else float("inf")


def threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION, count: np.ndarray | None = None) -> float:
    """The lowest probability (0.5 at least) from which on the lower bound of precision (Wilson's, 95 %, one-sided) holds; infinite if none."""
    each, at = np.unique(-p, return_inverse=True)  # ties pass together
    n = np.ones(len(p)) if count is None else count
    return _lowest(-each, np.bincount(at, n * y).cumsum(), np.bincount(at, n).cumsum(), precision)


def thresholds(scored: RDD, parts: int, precision: float = PRECISION) -> dict[int, float]:
    """``threshold`` by kind of ((kind, minus probability), (hits, samples)): sorted over ``parts`` ranges, each with the sums of those before it."""
    ranked = scored.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), parts).sortByKey(numPartitions=parts).persist(StorageLevel.MEMORY_AND_DISK)

    def by_kind(rows) -> dict[int, np.ndarray]:
        out: dict[int, list] = {}
        for (kind, p), (hit, n) in rows:
            out.setdefault(kind, []).append((-p, hit, n))
        return {k: np.array(v, float) for k, v in out.items()}

    sums = dict(ranked.mapPartitionsWithIndex(lambda i, rows: [(i, {k: v[:, 1:].sum(0) for k, v in by_kind(rows).items()})]).collect())
    before = {i: {k: sum(sums[j][k] for j in sums if j < i and k in sums[j]) for k in s} for i, s in sums.items()}

    def lowest(i, rows):
        for k, v in by_kind(rows).items():
            hit, n = (v[:, 1:].cumsum(0) + before[i][k]).T
            yield k, _lowest(v[:, 0], hit, n, precision)

    out: dict[int, float] = {}
    for k, v in ranked.mapPartitionsWithIndex(lowest).collect():
        out[k] = min(v, out.get(k, float("inf")))
    ranked.unpersist()
    return out


Model = dict[int, tuple[Trees, float, float, float]]


def _cells(rows: DataFrame, kinds: dict[int, Kind]) -> tuple[RDD, int]:
    """Parts of the samples (kind, label, fold, x) of ``kinds``, equal ones counted, and the number of parts that they need; they may be dealt over more, some empty."""
    edges = {k: v.edges for k, v in kinds.items()}
    schema = "kind int, label int, fold int, bins binary"

    def run(batches):
        for batch in batches:
            kind = np.asarray(batch.column("kind"))
            x = np.asarray(batch.column("x").flatten(), float).reshape(len(kind), len(FEATURES))
            bins = np.zeros(x.shape, np.uint8)
            for k, e in edges.items():
                bins[kind == k] = binned(x[kind == k], e)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "label", "fold")), pa.array([b.tobytes() for b in bins], pa.binary())], ["kind", "label", "fold", "bins"])

    cells = rows.where(F.col("kind").isin(*kinds)).select("kind", "label", "fold", "x").mapInArrow(run, schema).groupBy("kind", "label", "fold", "bins").agg(F.count("*").alias("n"))
    cells = materialise(cells, "cells")
    parts = -(-cells.count() // EACH)

    def gathered(rows):
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r.kind, []).append(r)
        yield {
            k: Cells(np.frombuffer(b"".join(r.bins for r in v), np.uint8).reshape(len(v), -1), *(np.array([r[c] for r in v], np.int64) for c in ("label", "fold", "n")), np.zeros((len(v), FOLDS + 1)))
            for k, v in by.items()
        }

    return cells.repartition(parts, "bins").rdd.mapPartitions(gathered), parts


def train(proposed: DataFrame) -> Model:
    """By kind trees, Platt's slope and offset, and threshold, of all samples; ``proposed`` is what ``propose`` returned, best written and read again."""
    ship(proposed.sparkSession)
    found, samples = proposed.columns[-2:]
    z = F.explode(F.arrays_zip(F.col(found).alias("span"), F.col(samples).alias("sample"))).alias("z")
    rows = proposed.select(z).select(F.col("z.span.kind").alias("kind"), F.col("z.sample.label").alias("label"), F.col("z.sample.key").alias("key"), F.col("z.sample.x").alias("x"))
    rows = rows.where("label >= 0").distinct().withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int"))  # one string, one fold
    rows = materialise(rows, "samples")
    count = np.zeros((len(KINDS), FOLDS, 2), np.int64)
    for r in rows.groupBy("kind", "fold", "label").count().collect():
        count[r.kind, r.fold, r.label] = r["count"]
    learnt = [k for k in range(len(KINDS)) if count[k].sum(0).min() >= LEAST_SAMPLES]
    if not learnt:
        return {}
    values = rows.where(F.col("kind").isin(learnt)).select("kind", F.posexplode("x").alias("j", "v")).groupBy("kind", "j", F.col("v").cast("double").alias("v")).agg(F.count("*").alias("n"))
    cuts = {(r.kind, r.j): np.unique(r.cuts) for r in values.groupBy("kind", "j").agg(F.percentile("v", F.array(*map(F.lit, SHARES.tolist())), F.col("n")).alias("cuts")).collect()}
    kinds = {k: Kind([cuts[k, j] for j in range(len(FEATURES))], count[k], [*range(FOLDS), -1]) for k in learnt}
    cells, parts = _cells(rows, kinds)
    spread = ManyParts(cells) if parts > 1 else OnePart(_joined(cells.collect()))  # EACH cells at most: not worth some two hundred jobs, and the same sums
    trees = grow(spread, kinds)
    held_out = lambda c: c.raw[np.arange(len(c.fold)), c.fold]  # noqa: E731  by trees that haven't seen the sample
    fit = sigmoids(lambda fit: spread.total(lambda part: {k: _platt_sums(held_out(c), c.y, c.count, *fit[k]) for k, c in part.items() if k in fit}), {k: tuple(count[k].sum(0)[::-1].tolist()) for k in learnt})

    probability = lambda k, c: 1 / (1 + np.exp(-(fit[k][0] * held_out(c) + fit[k][1])))

    def scored(part):
        for k, c in part.items():
            yield from (((k, -q), (n * y, n)) for q, n, y in zip(probability(k, c).tolist(), c.count.tolist(), c.y.tolist(), strict=True))

    if parts > 1:
        least = thresholds(spread.now.flatMap(scored), parts)
        spread.close()
    else:
        least = {k: threshold(probability(k, c), c.y, count=c.count) for k, c in spread.part.items()}
    return {k: (trees[k][-1], *fit[k], least[k]) for k in learnt}


def select(proposed: DataFrame, model: Model) -> DataFrame:
    """What ``propose`` returned with the candidates and samples replaced by spans: base spans and those that the model adds."""
    spark = proposed.sparkSession
    base, found, samples = proposed.columns[-3:]
    spans = fresh(proposed, "spans")
    shared = spark.sparkContext.broadcast(model)  # four kinds' trees
    schema = T.StructType([*proposed.schema.fields[:-2], T.StructField(spans, proposed.schema[base].dataType)])
    of_struct = lambda a, name: np.asarray(pa.compute.struct_field(a, name))

    def chosen(text_base: list[dict], cand: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
        taken = {k: [] for k in range(len(KINDS))}
        for s in text_base:
            taken[s["kind"]].append((s["start"], s["end"]))
        out = [(s["start"], s["kind"], s["end"]) for s in text_base]
        for _, _, s, e, k in sorted((-p, s - e, s, e, k) for p, s, e, k in cand):
            if not any(a < e and s < b for a, b in taken[k]):
                taken[k].append((s, e))
                out.append((s, k, e))
        return sorted(out)

    def run(batches):
        tk.begin()
        for batch in batches:
            lists = batch.column(batch.num_columns - 2)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            cand, sample = lists.flatten(), batch.column(batch.num_columns - 1).flatten()
            kind, start, end = (of_struct(cand, c) for c in ("kind", "start", "end"))
            p = np.zeros(len(kind))
            if len(kind):
                x = np.asarray(pa.compute.struct_field(sample, "x").flatten(), float).reshape(len(kind), len(FEATURES))
                open_ = of_struct(sample, "label") == -1
                for k, (trees, a, b, least) in shared.value.items():
                    use = np.flatnonzero((kind == k) & open_)
                    q = 1 / (1 + np.exp(-(a * trees.raw(x[use]) + b)))
                    p[use] = np.where(q >= least, q, 0)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            added: dict[int, list] = {}
            for i in np.flatnonzero(p > 0).tolist():
                added.setdefault(int(owner[i]), []).append((float(p[i]), int(start[i]), int(end[i]), int(kind[i])))
            own = batch.column(batch.num_columns - 3)
            rows = own.to_pylist() if added else None
            if added:
                for i, c in added.items():
                    rows[i] = [{"start": s, "kind": k, "end": e} for s, k, e in chosen(rows[i], c)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], own if rows is None else pa.array(rows, own.type)], schema.fieldNames())

    return proposed.mapInArrow(run, schema)


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Learns from ``docs`` and returns ``keep`` columns with base and spans; the texts are read once for both, but where they are kept."""
    proposed = materialise(propose(docs, text, keep), "candidates")
    return select(proposed, train(proposed))


def listed(spans):
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(detected: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, but for those named like an output, with counts, base_sha256 and listed spans of what ``detect`` returned."""
    base, spans = (F.col(c) for c in detected.columns[-2:])
    n = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    out = {f"n_{name}": n(k) for k, name in enumerate(KINDS)} | {"base_sha256": F.sha2(listed(base), 256), "spans": listed(spans)}
    return detected.select(*(c for c in keep if c not in out), *(v.alias(k) for k, v in out.items()))


def redact(detected: DataFrame, text: str = "text", marks: tuple[str, ...] = tuple(f"[{k.upper()}]" for k in KINDS)) -> DataFrame:
    """``detected`` without the spans' columns, and with every span of ``text`` replaced by the mark of its kind; overlapping spans get the first one's."""
    schema = detected.schema
    at = detected.columns.index(text)

    def run(batches):
        tk.begin()
        for batch in batches:
            out = batch.column(at).to_pylist()
            for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not found:
                    continue
                pieces, done = [], 0
                for s in found:
                    if s["start"] >= done:
                        pieces += [out[i][done : s["start"]], marks[s["kind"]]]
                    done = max(done, s["end"])
                out[i] = "".join([*pieces, out[i][done:]])
            cols = list(batch.columns[:-2])
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields[:-2]])

    return detected.mapInArrow(run, T.StructType(schema.fields[:-2]))
