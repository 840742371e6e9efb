import random

import numpy as np
import pyarrow as pa
import pytest

regex = pytest.importorskip("regex")
public_tokenizers = pytest.importorskip("public_tokenizers")

from lodestone.llm import textkit as tk  # noqa: E402


def test_pretokens_equal_the_pattern():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "s", "t", "re", "ll", "'", "''", "\n", "\t", "é", "中", "1", "½", ".", "!", "😀", " ", "　", "'S", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    pattern = regex.compile(public_tokenizers.PATTERN)
    for a, b, raw, off in tk.chunks(pa.array(texts), 500):
        cps, at = tk.code_points(raw, off)
        s = tk.pretokens(cps, at)
        whole, e, docs = "".join(texts[a:b]), np.append(s[1:], len(cps)), np.searchsorted(s, at)
        for i in range(b - a):
            assert [whole[s[j] : e[j]] for j in range(docs[i], docs[i + 1])] == pattern.findall(texts[a + i])


def test_hash_index():
    h = np.random.default_rng(0).integers(0, 1 << 63, 200_000).astype(np.uint64)
    h = np.unique(h)
    index = tk.HashIndex(16)
    for part in np.array_split(h, 7):
        index.add(part)
    assert (index.get(h) == np.arange(len(h))).all()
    assert (index.get(h ^ np.uint64(1 << 63)) == -1).all()


def test_chunks_and_nulls():
    got = [(a, b, raw.tobytes(), (off - off[0]).tolist()) for a, b, raw, off in tk.chunks(pa.array(["ab", None, "", "cde"]), 3)]
    assert b"".join(g[2] for g in got) == b"abcde" and got[0][0] == 0 and got[-1][1] == 4
    assert list(tk.chunks(pa.array([], pa.string()))) == []


def test_shingles_short_documents():
    def of(t):
        (_, _, raw, off), = tk.chunks(pa.array([t]))
        return tk.shingles(raw, off)[0].tolist()

    assert of("") == [] and of(" \n") == []
    assert len(of("a b")) == 1 and of("a  b") == of(" a b ") != of("a c")
    assert len(of("a b c d e")) == 1 and len(of("a b c d e f")) == 2
