"""Runs against every period tried at every place, on random and regular texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import periodic, textkit

DOCS = "doc_id long, text string, runs string, row string, tiles string, __text string"
MORE = ("own runs", "own row", None, "own text")


def brute(w):
    """(start, period, length) of every run, by start, then period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(6, 4 * q):
                found.setdefault((s, length), q)  # the smallest period comes first
    return sorted((s, q, n) for (s, n), q in found.items())


def expected(w):
    runs = brute(w)
    drop = {j for s, q, n in runs for j in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    best = min(((-n, s, q) for s, q, n in runs), default=None)
    most = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (len(runs), *most, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in drop).encode()).hexdigest())


def split(t):
    return [x.decode() for x in (t or "").encode().split()]


def regular(rng, k):
    """Powers of words over a small alphabet, with breaks, inside each other."""
    w = []
    while len(w) < k:
        root = [rng.choice("ab") for _ in range(rng.randint(1, 9))] if rng.random() < 0.8 else [rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))]
        w += root * rng.randint(1, 9) + root[: rng.randint(0, len(root))]
        if rng.random() < 0.3:
            w += w[rng.randint(0, len(w) - 1) :] * rng.randint(1, 5)
            w = w[: 3 * k]
    return w


def solved(w):
    """What tiles and stitching make of one text, without Spark."""
    raw = " ".join(w).encode()
    ids, _, at = periodic.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    got = {}
    for t in periodic.tiles(ids, at).get(0, []):
        for q, x, y in periodic.stretches(np.frombuffer(t["words"], np.int32), t["octave"], np.array(t["at"]) - t["first"], np.array(t["period"])):
            got.setdefault(q, []).append((x + t["first"], y + t["first"]))
    out = []
    for q, parts in got.items():
        whole = []
        for x, y in sorted(parts):
            if whole and x <= whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], y)
            else:
                whole.append([x, y])
        out += [(x, q, y - x + q) for x, y in whole if y - x + q >= max(6, 4 * q)]
    return sorted(out)


@pytest.mark.parametrize("tile", [(4096, 16), (1, 1), (8, 2)])
def test_tiles_find_every_run(monkeypatch, tile):
    monkeypatch.setattr(periodic, "TILE_WORDS", tile[0])
    monkeypatch.setattr(periodic, "TILE_BOUNDARIES", tile[1])
    rng = random.Random(tile[0])
    for k in range(250):
        w = regular(rng, rng.randint(1, 160)) if k % 3 else [rng.choice("ab") for _ in range(rng.randint(0, 90))]
        assert solved(w) == brute(w), w


def test_no_word_crosses_documents():
    texts = ["a b", "c a", "", " x y \n", "b b b b b b"]
    raw = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, _, at = periodic.words(np.frombuffer(raw, np.uint8), off)
    assert np.diff(at).tolist() == [len(split(t)) for t in texts]
    assert len(set(ids.tolist())) == len({x for t in texts for x in split(t)})
    assert [t for d in periodic.tiles(ids, at) for t in [d]] == [4]
    assert list(textkit.chunks(periodic.pa.array([], periodic.pa.string()))) == []


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [" ".join(regular(rng, rng.randint(1, 200))) for _ in range(60)]
    texts += [None, "", " \t\n", "x " * 5, "x " * 6, "é  " * 7, "a b " * 3000, "a\x0bb\x0ca\rb a b a b", "\x1ca " * 9, " ".join(f"w{i}" for i in range(3000))]
    texts.append("tail " + " ".join(f"w{i % 700}" for i in range(3500)))
    out = [(i * 7, t, *MORE) for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, texts[1], *MORE), (None, None, *MORE), (7, texts[2], *MORE)]


def test_digests(spark, rows):
    got = periodic.digests(spark.createDataFrame(rows, DOCS), keep=("doc_id", "row", "tiles"))
    key = lambda r: repr(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((r[0], r[3], r[4], *expected(split(r[1]))) for r in rows), key=key)
    assert got.columns == "doc_id row tiles n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_collapse_keeps_columns(spark, rows):
    got = periodic.collapse(spark.createDataFrame(rows, DOCS)).select("doc_id", "text", "row", "__text", "n_words", "runs").collect()
    want = []
    for r in rows:
        w = split(r[1])
        runs = brute(w)
        drop = {j for s, q, n in runs for j in range(s + q, s + n)}
        want.append((r[0], None if r[1] is None else " ".join(x for j, x in enumerate(w) if j not in drop), r[3], r[5], len(w), [(s, n, q) for s, q, n in runs]))
    plain = lambda r: (*r[:5], [tuple(x) for x in r[5]])
    assert sorted(map(plain, got), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert periodic.digests(empty).collect() == [] and periodic.collapse(empty).collect() == []


def test_query(spark):
    """The registered query, over the smallest given table, with its planted periods."""
    from conftest import SMALL

    from lodestone.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d in docs:
        w, h = split(d.text), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want.append((d.doc_id, *expected(w)))
    assert sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, SMALL).collect())) == sorted(want)
    assert any(r[1] for r in want)
