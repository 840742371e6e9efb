"""Empty tables, nulls in any column, very long texts, repeated rows and columns that clash with the operators' own names."""

import hashlib
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from lodestone.llm import bpe, common, fingerprint, langid, minhash, packing, secret_scan, suffix, token_rollup  # noqa: E402

NAMES = "score lang_pred base spans ids n_tokens decoded held_out node d t x comp class_id token __d __t __spans __body __added __letters __keep kind".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
MORE = tuple(f"own {n}" for n in NAMES)
HELLO = (1, "hello there you all good", "en", "s", 24, *MORE)
NULLS = [(None,) * len(HELLO), (None, "a b c d e f", "en", None, None, *MORE), (1, None, "en", "s", 0, *MORE), HELLO, HELLO, (2, *HELLO[1:])]
TIKTOKEN, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def texts(rows):
    return [r[1] or "" for r in rows]


def encoder():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(TIKTOKEN), special_tokens={})


def ids_sha(t):
    ids = encoder().encode_ordinary(t)
    return hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def key(rows):
    return sorted(rows, key=repr)


#: For each operator, what it returns of the rows with nulls.
OPERATORS = {
    "bpe": (lambda d: bpe.encode(d, TIKTOKEN, keep=("doc_id", "ids", "comp")).select("doc_id", "comp", "ids_sha256"), lambda rows: [(r[0], r[5 + NAMES.index("comp")], ids_sha(r[1] or "")) for r in rows]),
    "fingerprint": (lambda d: fingerprint.fingerprints(d).select("doc_id", "n_chars"), lambda rows: [(r[0], len(r[1] or "")) for r in rows]),
    "classes": (lambda d: minhash.classes(d).select("doc_id", "class_id", "class_size"), lambda rows: [(None, 1, 2), (None, None, 1), (1, 1, 2), (1, 1, 3), (1, 1, 3), (2, 1, 3)]),
    "deduplicate": (minhash.deduplicate, lambda rows: rows[1:5]),
    "language": (lambda d: langid.learn_and_predict(d, keep=("doc_id", "score", "comp")).select("doc_id", "comp", "lang_pred"), lambda rows: [(r[0], r[5 + NAMES.index("comp")], "en" if r[1] else "und") for r in rows]),
    "secrets": (lambda d: secret_scan.digests(secret_scan.scan(d, secret_scan.train(secret_scan.labelled_samples(d))), ("doc_id", "spans", "comp")).select("doc_id", "comp", "spans"), lambda rows: [(r[0], r[5 + NAMES.index("comp")], "") for r in rows]),
    "redact": (lambda d: secret_scan.redact(secret_scan.scan(d, secret_scan.train(secret_scan.labelled_samples(d)))), lambda rows: rows),
    "removal": (lambda d: suffix.removal_digests(d).select("doc_id", "n_bytes", "n_removed", "kept_sha256"), lambda rows: [(r[0], len(r[1] or ""), 0, hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows]),
    "remove": (suffix.remove_repeats, lambda rows: rows),
    "rollup": (lambda d: token_rollup.corpus_history(d, common.scratch(d.sparkSession, "rollup")).totals(), lambda rows: [(None, None, "words-1", 1, 0), (None, "en", "words-1", 1, 6), ("s", "en", "words-1", 3, 10)]),
    "packing": (lambda d: packing.pack(d, JSON).groupBy("doc_id").agg({"length": "sum"}), lambda rows: [(None, 1 + 7), (1, 1 + 6 + 6), (2, 6)]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(spark, name):
    f, want = OPERATORS[name]
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0
    assert f(spark.createDataFrame([(5, "the only text", *HELLO[2:])], SCHEMA)).count() == 1
    assert key(map(tuple, f(spark.createDataFrame(NULLS, SCHEMA)).collect())) == key(want(NULLS))


def test_very_long_texts(spark):
    """Megabytes of one word, of no white space, of very many secrets: whole results."""
    line = "password=0123456789abcdef0123 and more of it\n"
    long = ["word " * 300_000, "x" * 1_000_000, line * 20_000]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(long)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(docs, [0.0] * secret_scan.N**2)).collect()}
    assert (got[2].n_assign, got[2].n_hex) == (20_000, 20_000)
    assert got[2].spans.startswith("assign:0:29,hex:9:29,assign:45:74,") and got[2].spans.endswith(f"hex:{45 * 19_999 + 9}:{45 * 19_999 + 29}")
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r.doc_id: (r.n_chars, len(r.sketch)) for r in fingerprint.fingerprints(docs).collect()} == {0: (1_500_000, 1), 1: (1_000_000, 1), 2: (900_000, 5)}
    assert {r.doc_id: r.lang_pred for r in langid.learn_and_predict(docs).collect()} == {0: "en", 1: "en", 2: "en"}
    assert {r.doc_id: r.n_removed for r in suffix.removal_digests(docs).collect()} == {0: 1_500_000, 1: 1_000_000, 2: 900_000}
    assert {r.doc_id: r.ids_sha256 for r in bpe.encode(docs.where("doc_id <> 1"), TIKTOKEN, digests_only=True).collect()} == {i: ids_sha(long[i]) for i in (0, 2)}


@pytest.mark.parametrize("rows", [[], NULLS, [(i, "this is a text of some words, number " + " ".join(str(i * k) for k in range(20)), *HELLO[2:]) for i in range(6)]], ids=["empty", "nulls", "texts"])
def test_pipeline_edges(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, docs, ""), f"edge-{name}")
        if name != "sequence_packing":
            assert out.columns == docs.columns
            for r in out.collect():
                assert tuple(r)[5:] == MORE
        docs = out
    ids = sorted({r.doc_id for r in docs.collect() if r.doc_id is not None})
    assert ids == ([] if not rows else [1] if rows is NULLS else list(range(6)))


def test_packing_large_ids_beside_nulls(spark):
    """Document keys of 64 bits stay what they are when a null lies in the same batch."""
    ids = [2**60 + 1, None, 2**60 + 3, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(i, f"text {k} " * (k + 1)) for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in packing.pack(docs, JSON).collect()} == set(ids)


def test_warc_pages_that_look_like_version_blocks(spark):
    """A page under filedesc:// is a page, page numbers have up to 19 digits, and of equal payloads one is the response."""
    from lodestone.llm import warc

    rows = [(1, "filedesc://x", "p"), (2**62 + 5, "http://a/", "q" * 300_000), (2**63 - 1, "http://b/", "q" * 300_000), (-(2**63), "filedesc://y", None)]
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.pages_through_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {1: ("response", None, 1), 2**62 + 5: ("response", None, 300_000), 2**63 - 1: ("revisit", 2**62 + 5, 300_000), -(2**63): ("response", None, 0)}


VECTORS = "vec_id long, embedding array<float>, x string, m string, w string"


def test_whitening_edges(spark):
    """Nulls, not-a-numbers, other lengths, repeated rows, dimensions without variance, and vectors that don't vary at all."""
    import numpy as np
    from lodestone.llm import whitening

    rng = np.random.default_rng(3)
    good = [rng.normal(size=5).astype(np.float32).tolist() for _ in range(40)]
    for v in good:
        v[4] = 0.25
    rows = [(i, v, "a", "b", "c") for i, v in enumerate(good)] + [(7, good[0], "", "", ""), (7, good[0], "", "", ""), (None, good[1], None, None, None), *[(100 + i, good[2], "h", "h", "h") for i in range(60)]]
    bad = [(1, None, "", "", ""), (2, [], "", "", ""), (3, [1.0, None, 1.0, 1.0, 1.0], "", "", ""), (4, [float("nan")] * 5, "", "", ""), (5, [float("inf")] * 5, "", "", ""), (6, [1.0] * 3, "", "", ""), (8, [3e38] * 5, "", "", "")]
    df = spark.createDataFrame(rows + bad, VECTORS)
    for weights in ("one", "counts"):
        got = whitening.whitened_rows(df, keep=("vec_id", "x", "m"), weights=weights).collect()
        assert len(got) == 5 * len(rows)
        xs = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in r[1]] for r in rows])
        uniq, m = np.unique(xs, axis=0, return_counts=True)
        w = m if weights == "counts" else np.ones(len(uniq), int)
        n, sums = int(w.sum()), (uniq * w[:, None]).sum(0)
        a = uniq - sums / n
        e, u = np.linalg.eigh((a * w[:, None]).T @ a / n)
        e, u = e[::-1], u[:, ::-1]
        by = {}
        for r in got:
            by.setdefault((r.vec_id, r.x), {}).setdefault(r.component, set()).add((r.whitened, r.deviation, r.n))
        for (i, v, x, *_), row in zip(rows, xs, strict=True):
            want = (row - sums / n) @ u[:, :4] / np.sqrt(e[:4])
            for k in range(4):
                assert any(abs(abs(g) - abs(want[k])) < 1e-9 and d == sum((n * int(p) - int(s)) ** 2 for p, s in zip(row, sums, strict=True)) and c == n for g, d, c in by[i, x][k + 1])
            assert {g for g, _, _ in by[i, x][5]} == {None}
        assert got[0].identity_error < 1e-9 and all(abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 for r in got)
    same = whitening.whitened_rows(spark.createDataFrame([(1, [1.0, 2.0], "", "", "")] * 3, VECTORS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 6
    assert whitening.whitened_rows(spark.createDataFrame(bad[:5], VECTORS)).collect() == [] and whitening.whitened_rows(spark.createDataFrame([], VECTORS)).collect() == []


def test_whitening_beyond_longs(spark):
    """Entries so large that n * x leaves 64 bits: sums stay exact, and a deviation that doesn't fit is null."""
    from lodestone.llm import whitening

    rows = [(i, [float(2**49 + 2**40 * i), float(i)]) for i in range(3)]
    got = {r.vec_id: (r.n, r.deviation) for r in whitening.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    xs = [[64 * (2**49 + 2**40 * i) + 1_000_000, 64 * i + 1_000_000] for i in range(3)]
    for i, x in enumerate(xs):
        d = sum((3 * a - sum(y[k] for y in xs)) ** 2 for k, a in enumerate(x))
        assert got[i] == (3, d if d < 2**63 else None)
