"""Suffix-array dedup, Merkle manifest and hard negatives on hard cases, against SQL or brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from test_operators import as_query, docs, empty, fixture_rows, got_rows, sql_rows, with_odd_rows  # noqa: F401

from panelcast.llm import hard_negatives, merkle, queries, suffix_dedup
from panelcast.llm import suffix_array as suffix_arrays
from panelcast.llm.suffix_array import common_prefixes, suffix_array

# --- suffix arrays


@pytest.mark.parametrize("few", [0, 256])
@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_and_prefixes(seed, few, monkeypatch):
    """Bucket by bucket (0) and all buckets at once."""
    monkeypatch.setattr(suffix_arrays, "FEW", few)
    rng = random.Random(seed)
    for _ in range(40):
        n, k = rng.randrange(1, 260), rng.choice([1, 2, 3, 26, 256])
        b = bytes(rng.randrange(k) for _ in range(n))
        b = (b[:17] * 30)[:n] if rng.random() < 0.3 else b
        t = np.frombuffer(b, np.uint8)
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        length, other = common_prefixes(t, sa, n - np.arange(n))
        for before, i in zip([None, *sa.tolist()], sa.tolist()):
            shared = 0
            while before is not None and i + shared < n and before + shared < n and b[i + shared] == b[before + shared]:
                shared += 1
            assert length[i] == shared and other[i] == (-1 if before is None else before)


def test_suffix_array_with_many_names():
    """Names that need digits, long runs of one symbol and long repeats."""
    rng = np.random.default_rng(3)
    part = rng.integers(0, 256, 30000, np.uint8)
    t = np.concatenate([part, np.zeros(3000, np.uint8), part, np.full(2000, 7, np.uint8), part[:9000]])
    sa = suffix_array(t)
    assert sorted(sa.tolist()) == list(range(len(t)))
    b = t.tobytes()
    assert all(b[i : i + 40000] < b[j : j + 40000] or b[i:] < b[j:] for i, j in zip(sa[:-1:37].tolist(), sa[1::37].tolist()))


# --- suffix-array dedup


def brute_repeats(rows, size):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    out = []
    for doc_id, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize(("size", "gram", "hot", "shard", "piece"), [(400, 100, 1000, 1 << 19, 1 << 19), (40, 10, 1000, 3000, 1 << 19), (40, 10, 1, 3000, 700), (60, 50, 3, 1 << 20, 999)])
def test_suffix_dedup(spark, with_odd_rows, monkeypatch, size, gram, hot, shard, piece):  # noqa: F811
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rows = [tuple(r) for r in with_odd_rows.collect()]
    got = suffix_dedup.remove_repeats(with_odd_rows, size, gram, piece)
    assert got_rows(got, COLS) == brute_repeats(rows, size)


def test_suffix_dedup_query(spark, with_odd_rows, empty, monkeypatch):  # noqa: F811
    rows = [tuple(r) for r in with_odd_rows.collect()]
    assert got_rows(as_query(with_odd_rows, "op11_suffix_dedup", monkeypatch, spark), COLS) == brute_repeats(rows, 400)
    assert as_query(empty, "op11_suffix_dedup", monkeypatch, spark).count() == 0


def test_suffix_dedup_same_in_more_data(spark, docs):  # noqa: F811
    """Rows that share an id but not a text, alone and among others."""
    one = "alpha beta gamma " * 40 + "first"
    few = spark.createDataFrame([(2, "A" + one), (2, "only here " + "".join(chr(97 + i * i % 23) for i in range(900))), (3, one)], "doc_id long, text string")
    alone = set(got_rows(suffix_dedup.remove_repeats(few), COLS))
    assert alone <= set(got_rows(suffix_dedup.remove_repeats(few.unionAll(docs.select("doc_id", "text"))), COLS))


# --- Merkle manifest


def test_merkle_manifest(spark, with_odd_rows, empty, monkeypatch):  # noqa: F811
    rows = [tuple(r) for r in with_odd_rows.collect()]
    langs = [None, "fr", "ä", "en", "de", "zz", "aa", "b", "c", "d"]
    odd = spark.createDataFrame([(r[0], r[1], langs[i % 97 % len(langs)], *r[3:]) for i, r in enumerate(rows)], with_odd_rows.schema).repartition(4)
    for table in (with_odd_rows, odd):
        got = as_query(table, "op12_merkle_manifest", monkeypatch, spark)
        assert got_rows(got, got.columns) == sql_rows(queries.ORACLE["op12_merkle_manifest"], got.columns, documents=table)
    assert as_query(empty, "op12_merkle_manifest", monkeypatch, spark).count() == 0


def test_merkle_levels(spark, monkeypatch):
    """More than one table of blocks, a lone leaf, and what tampering changes."""
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **k: whole(*a, **k, depth=1))
    rows = [(i, f"Text {i}" if i % 3 else f"text {i}", "one" if i == 77 else "en", None, i) for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = as_query(table, "op12_merkle_manifest", monkeypatch, spark)
    assert got_rows(got, got.columns) == sql_rows(queries.ORACLE["op12_merkle_manifest"], got.columns, documents=table)
    for r in got.collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or r.doc_id % 3 == 0)
        assert r.doc_id != 77 or r.leaf == r.subroot


def test_merkle_states_skip_left_siblings():
    nodes = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(19)]
    levels, top = merkle.build(nodes, 19)
    assert all(merkle.fold(levels, i, nodes[i]) == top for i in range(19))
    runs = [hashlib.sha256(b"".join(nodes[a : a + 8])).hexdigest().encode() for a in (0, 8, 16)]
    assert top == hashlib.sha256(b"".join(runs)).hexdigest().encode()
    assert [len(lv.kept) for lv in levels] == [19, 3]


# --- hard negatives


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row long, score long, id long").repartition(3)


def vector_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.1, (12, 16))
    rows = []
    for i in range(700):
        v = base[i % 12] + rng.normal(0, 0.04, 16)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 5, 1, 2, 3))
    rows += [rows[0], rows[100], rows[101], rows[5]]  # repeated rows, an anchor among them
    rows += [(800, None, 1, 1, 1, 1), (900, rows[3][1], None, 1, 1, 1), (901, [None] * 16, 1, 1, 1, 1), (1000, [float("nan")] * 16, 2, 1, 1, 1), (1001, [float("inf")] * 16, 2, 1, 1, 1)]
    rows += [(None, rows[200][1], 0, 1, 1, 1), (None, rows[201][1], 3, 1, 1, 1), (1100, [0.0] * 16, 1, 1, 1, 1), (1200, [-float(x) for x in rows[0][1]], 4, 1, 1, 1)]
    return rows


NEGATIVES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("sample", [2048, 16, 1])
def test_hard_negatives(spark, monkeypatch, sample):
    """Few sampled rows mean bad rungs and more rounds, not other results."""
    table = vectors(spark, vector_rows())
    mine = hard_negatives.mine
    monkeypatch.setattr(hard_negatives, "mine", lambda *a, **k: mine(*a, sample_rows=sample, **k))
    got = as_query(None, "op13_hard_negatives", monkeypatch, spark, embeddings=table)
    want = sql_rows(queries.ORACLE["op13_hard_negatives"], NEGATIVES, embeddings=table)
    assert got_rows(got, NEGATIVES) == want and want


def test_hard_negatives_blocks_and_empty(spark, monkeypatch):
    table = vectors(spark, vector_rows())
    whole = got_rows(hard_negatives.mine(table), NEGATIVES)
    assert got_rows(hard_negatives.mine(table, block_anchors=2), NEGATIVES) == whole
    assert got_rows(hard_negatives.mine(table.repartition(7)), NEGATIVES) == whole
    none = as_query(None, "op13_hard_negatives", monkeypatch, spark, embeddings=vectors(spark, []))
    assert none.columns == NEGATIVES and none.count() == 0
    assert hard_negatives.mine(vectors(spark, vector_rows()[1:50])).count() == 0  # no anchor


def test_index_leaves_out_only_what_cannot_matter():
    rng = np.random.default_rng(2)
    a, x = rng.integers(-90, 90, (40, 24)), rng.integers(-90, 90, (300, 24))
    a[:, 10:] //= 8
    norm = np.sqrt((x**2).sum(1).max())
    limits = rng.integers(-20000, 40000, 40)
    index = hard_negatives.Index(a.astype(float), limits, norm)
    assert index.depth.min() < 24
    i, j, s = index.search(x.astype(float))
    scores = a @ x.T
    want = np.argwhere(scores >= limits[:, None])
    assert sorted(zip(i.tolist(), j.tolist())) == [tuple(w) for w in want.tolist()]
    assert (s == scores[i, j]).all()
