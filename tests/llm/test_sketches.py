"""Sketches against sets: the 128 smallest hashes of the distinct shingles, and what is estimated from them."""

import random
import re
import struct

import pytest
from pyspark.sql import functions as F

xxhash = pytest.importorskip("xxhash")

from lodestone.llm import fingerprint  # noqa: E402


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def shingles(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    h = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words]
    out = set()
    for i in range(max(1, len(h) - 4) if h else 0):
        seed = 42
        for j in range(5):
            seed = xxhash.xxh64(struct.pack("<q", h[i + j] if i + j < len(h) else 0), seed=seed).intdigest()
        out.add(signed(seed))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(3000)]
    rows = ["", None, "one", "a b c d", "a b c d e", "  a  b\tc\nd e f ", "same same same same same same same", " ".join(base)]
    rows += [" ".join(base[:n]) for n in (50, 131, 132, 133, 600, 1500)] + [" ".join(base[500:2500] + ["new"] * 40)]
    return list(enumerate(rows))


def test_sketches_are_the_smallest_hashes(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    for i, t in texts:
        assert got[i].sketch == sorted(shingles(t))[:128]
        # descending ids: the next one of i is i - 1, of the last the highest
        following = texts[i - 1][1] or ""
        own = t or ""
        edited = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        assert got[i].edited == edited and got[i].edited_sketch == sorted(shingles(edited))[:128]


def test_estimates(spark, texts):
    sets = {i: shingles(t) for i, t in texts}
    rows = [(i, j, sorted(sets[i])[:128], sorted(sets[j])[:128]) for i in sets for j in sets]
    df = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    got = df.select("i", "j", fingerprint.resemblance(a, b).alias("r"), fingerprint.containment(a, b).alias("c"), fingerprint.distinct_shingles(a).alias("n"), fingerprint.merge(a, b).alias("m"))
    for r in got.collect():
        x, y = sets[r.i], sets[r.j]
        union = len(x | y)
        assert r.m == sorted(x | y)[:128]
        exact = union <= 128  # then nothing is estimated
        want_r = len(x & y) / union if union else 1.0
        want_c = len(x & y) / len(x) if x else 1.0
        assert abs(r.r - want_r) < (1e-12 if exact else 0.2)
        if exact and len(x) < 128 and union < 128:
            assert abs(r.c - want_c) < 1e-9
        assert abs(r.n - len(x)) <= (1e-9 if len(x) < 128 else 0.45 * len(x))
        assert 0 <= r.c <= 1 and (r.i != r.j or r.r == 1.0)
