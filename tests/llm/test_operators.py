"""The ten operators on a small fixture of hard cases, against SQL or brute force."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import decontaminate, exact_dedup, license_scan, lm_score, mixing, near_dup, quality_cnn, queries, span_dedup, token_orc, url_lists

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, size long, rep long, component string"


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)).capitalize() + "."


def fixture_rows():
    rng = random.Random(4)
    base = [" ".join(sentence(rng, rng.randint(4, 18)) for _ in range(rng.randint(3, 9))) for _ in range(25)]
    passage = " ".join(sentence(rng, 14) for _ in range(5))
    texts = [None, "", " \t\n", "one", "One", "two words", "É été là", "a" * 3000, "x " * 6000 + "end."]
    texts += base + base[:6] + [b.replace(" ", "\n\t", 3) for b in base[:4]]
    for b in base[6:16]:  # near copies: one word changed, or a few
        w = b.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
        w[rng.randrange(len(w))] = "again"
        texts.append(" ".join(w))
    texts += [f"{sentence(rng, 9)} {passage} {sentence(rng, 7)}" for _ in range(4)]
    texts += ["Licensed under CC BY-NC 4.0. All rights\nreserved, all rights reserved!", "This work is licensed under the GNU General Public License, version 3.", "released under the MIT\tlicense", "cc,by CC BY"]
    texts += ["le mot " * 40 + "fin", "LE MOT " * 40 + "FIN"]
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 4}" if i % 3 else "src0", len(t or ""), i, "k", 5, 1, "c") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def with_odd_rows(spark, docs):
    """Repeated rows and a null id besides."""
    more = [fixture_rows()[12], fixture_rows()[12], (None, fixture_rows()[13][1], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return docs.unionAll(spark.createDataFrame(more, SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sql_rows(sql, cols, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)


def got_rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def as_query(df, name, monkeypatch, spark, **more):
    """The registered query over given DataFrames instead of files."""
    tables = {"documents": df, **more}
    monkeypatch.setattr(queries, "table", lambda s, d, t: tables[t])
    return queries.QUERIES[name](spark, "")


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_mixing", "op6_near_dup", "op10_exact_dedup"])
def test_against_sql(name, docs, spark, monkeypatch):
    df = as_query(docs, name, monkeypatch, spark)
    cols = df.columns
    assert got_rows(df, cols) == sql_rows(queries.ORACLE[name], cols, documents=docs)


def test_license_labels(docs):
    r = {x.doc_id: x for x in license_scan.scan(docs).collect()}
    last = max(r)
    assert r[last - 5].base_labels == "cc-by,reserved" and r[last - 5].n_base == 3
    assert r[last - 4].labels == "gpl,gpl-3.0" and r[last - 3].labels == "mit" and r[last - 3].base_labels == ""
    assert r[last - 2].n_base == 2 and r[last - 2].first_word == 0 and r[last - 2].last_word == 2
    assert r[0].n_words == 0 and r[0].labels == "" and r[0].score == 0.0 and r[0].first_word is None


def brute_spans(rows, k=2, m=12, long=50):
    docs = {}
    for i, t in rows:
        ss, cur = [], None
        for x in WORD.finditer(t):
            if cur is None:
                cur = [x.start(), []]
            cur[1].append(x.group().translate(FOLD))
            if x.group()[-1] in ".!?" or "\n" in re.match(r"[\x20\x09-\x0D]*", t[x.end() :]).group():
                ss.append(cur)
                cur = None
        docs[i] = ss + ([cur] if cur else [])
    places, gone = collections.defaultdict(list), collections.defaultdict(set)
    for i, ss in docs.items():
        for a in range(len(ss)):
            w = []
            for b in range(a, len(ss)):
                w += ss[b][1]
                if (b - a + 1 >= k and len(w) >= m) or len(w) >= long:
                    places[tuple(w)].append((i, a, b + 1))
                    break
    for ps in places.values():
        for i, a, b in ps:
            if (i, a) != min(ps)[:2]:
                gone[i] |= set(range(a, b))
    out = {}
    for i, t in rows:
        starts = [0, *[s[0] for s in docs[i]][1:], len(t)] if docs[i] else [0, len(t)]
        out[i] = (len(docs[i]), len(gone[i]), "".join(t[starts[j] : starts[j + 1]] for j in range(len(starts) - 1) if j not in gone[i]))
    return out


@pytest.mark.parametrize("share", [2000, 1])
def test_span_dedup_brute(docs, monkeypatch, share):
    """Both ways of removing: by broadcast of common spans and by the join."""
    monkeypatch.setattr(span_dedup, "HEAVY_SHARE", share)
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in span_dedup.remove_repeats(docs).collect()}
    want = brute_spans([(r[0], r[1] or "") for r in fixture_rows()])
    assert got == want and sum(v[1] > 0 for v in want.values()) > 10


def test_tokens_round_trip(docs, spark, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    out = token_orc.write_tokens(docs, token_orc.scratch_path(spark, "test"), path, partitions=3)
    start = 0
    for r in token_orc.read_tokens(spark, out).orderBy("doc_id").collect():
        want = tok.encode(dict((x[0], x[1]) for x in fixture_rows())[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert r.ids == want and r.start == start and r.n_tokens == len(want)
        start += len(want)
    for r in as_query(docs, "op3_token_orc", monkeypatch, spark).collect():
        ids = tok.encode(dict((x[0], x[1]) for x in fixture_rows())[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_encode_pieces():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    odd = ["", " ", "  a", "a  b", "a \n b", "a\tb c", "don't 's x", "a 　b", "x <|endoftext|> y", "a\x1cb c \x1c d", "x it's. y's, z.'s w!!, ñandú., 'll. ll.'ll", "1,2 3.4. 5th; é́.", "a​. bª, ٣."]
    for t, coded in zip(odd, token_orc.encode(odd, path)):
        assert [int.from_bytes(coded[i : i + 4], "little") for i in range(0, len(coded), 4)] == tok.encode(t, add_special_tokens=False).ids


def test_encode_shares_runs(monkeypatch):
    """A word is encoded once, whatever marks stand around it, and the ids are those of the whole text, whatever characters meet."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    rng = random.Random(3)
    some = ["a", "B", "\u00e9", "\u00df", "1", "22", "\u00b2", "\u00aa", "'s", "'", "\n", "\n\n", "\t", " ", "  ", ".", ",", "(", "<|endoftext|>", "<|", "\u4e2d", "\u9fa5", "\ud55c", "\u044f", "\u3000", "\U0001f600", "\u0301", "_", "\r\n", "\u00d7", "\u00f7", "\x85", "\u00a0", "\u200b", "\u0663"]
    texts = ["".join(rng.choice(some) + " " * (rng.random() < 0.3) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for as_text in (False, True):
        tok.encode_special_tokens = as_text
        got = token_orc.encode(texts, path, as_text)
        assert got == [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    token_orc._load(path, False)
    learnt = []
    monkeypatch.setitem(token_orc._state, "memo", {})
    monkeypatch.setitem(token_orc._state, "old", {})
    learn = token_orc._learn
    monkeypatch.setattr(token_orc, "_learn", lambda tok, pieces, memo: (learnt.extend(pieces), learn(tok, pieces, memo)))
    words = ["quark", "charm", "strange"]
    token_orc.encode(["x " + " ".join(f"{a}{w}{b}" for w in words for a in ("", "(", "7") for b in ("", ".", "!!", ";\nz"))], path, False)
    assert len(learnt) < 20


def test_span_dedup_same_in_a_padded_corpus(spark, docs):
    """Rows that share an id but not a text lose the same alone and among many others."""
    rng = random.Random(11)
    a, b, c = (" ".join(sentence(rng, 12) for _ in range(4)) for _ in range(3))
    few = spark.createDataFrame([(2, a), (2, b), (1, a + " " + c)], "doc_id long, text string")
    pad = spark.createDataFrame([(i + 10, " ".join(sentence(rng, 9) for _ in range(3))) for i in range(3000)], "doc_id long, text string")
    cols = ["doc_id", "n_sentences", "n_removed", "text"]
    alone = got_rows(span_dedup.remove_repeats(few), cols)
    assert sorted(r[2] for r in alone) == [0, 0, 4] and (2, 4, 0, b) in alone
    among = got_rows(span_dedup.remove_repeats(few.unionAll(pad).repartition(5)).where("doc_id < 10"), cols)
    assert among == alone


def test_mixing_ties(spark):
    """Null and equal ids: the same rows, dealt otherwise, get the same copies."""
    rows = [(None if i % 2 else 7, " ".join(["w"] * (5 + i % 3)) + f" x{i}", "s") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted((r.text, r["__copies"]) for r in mixing.plan_copies(df.repartition(n), cell_rows=c).collect()) for n, c in ((1, 1_000_000), (3, 1_000_000), (7, 1_000_000), (5, 20))]
    assert got[0] == got[1] == got[2] == got[3] and len({c for _, c in got[0]}) == 2


def test_mixing_near_targets_and_stable(docs, with_odd_rows):
    cells = [sorted((r.doc_id, r["__copies"]) for r in mixing.plan_copies(docs, keep=("doc_id",), cell_rows=c).collect()) for c in (1_000_000, 2)]
    assert cells[0] == cells[1]
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in mixing.plan_copies(with_odd_rows, keep=("doc_id", "source")).collect():
        x = by[r.source]
        x[0] += r["__size"] * r["__copies"]
        x[1], x[2] = r["__target"], max(x[2], r["__size"])
        assert r["__copies"] <= 2
    assert all(abs(taken - target) <= 2 * most for taken, target, most in by.values())
    assert mixing.mix(with_odd_rows).columns == with_odd_rows.columns


def test_targets():
    t = mixing.share_targets({"a": 100, "b": 10, None: 100})
    assert t["b"] == 20.0 and abs(sum(t.values()) - 315) < 1e-9 and t["a"] <= 200 and t[None] <= 200
    assert mixing.share_targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0} and mixing.share_targets({}) == {}


def test_url_lists(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://u:p@{'WWW.' if i % 2 else ''}h{i % 7}.example.com:80/{'abc'[i % 3]}/x/{i % 5}?q=/z#f", "<html>", "h") for i in range(300)] + [(5, "https://www.h5.example.com/c", "", ""), (5, "https://www.h5.example.com/c", "", ""), (400, "nohost", "", ""), (401, "", "", "")], "page_id long, url string, html string, host string")
    df = as_query(pages, "op5_url_lists", monkeypatch, spark, pages=pages)
    assert got_rows(df, df.columns) == sql_rows(queries.ORACLE["op5_url_lists"], df.columns, pages=pages)
    assert df.where("not kept").count() > 0 and df.where("n_captures = 2").count() == 1
    lists = spark.createDataFrame([("a.b", 3, "block"), ("a.b", 3, "allow"), ("b", 1, "block"), ("a.b", 9, "allow"), ("a.b/p", 5, "allow"), (None, 1, "block")], "key string, day long, action string")
    captures = spark.createDataFrame([(k, u, d) for k, (u, d) in enumerate([("http://a.b/p", 4), ("http://a.b/p", 5), ("http://a.b/", 9), ("http://c.b", 0), ("http://c.b", 1), (None, 4), ("http://a.b", None)])], "page_id long, url string, day long")
    assert [r.kept for r in url_lists.evaluate(captures, lists).orderBy("page_id").collect()] == [False, True, True, True, False, True, True]
    assert url_lists.evaluate(captures.limit(0), lists).count() == 0 and url_lists.evaluate(captures, lists.limit(0)).where("kept").count() == 7


@pytest.mark.parametrize("n", [4, 5])
def test_near_dup_brute(docs, n):
    sets = {}
    for r in fixture_rows():
        w = words(r[1])
        sets[r[0]] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, n=n, block=3).collect()}
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.comp for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if x != c}


def benchmark(spark):
    rows = fixture_rows()
    items = [(0, rows[10][1]), (1, rows[11][1] + "? " + "yes"), (2, rows[12][1] + " Answer: " + "not in any text at all here"), (3, None), (4, ""), (5, "two words"), (6, " ".join(rows[13][1].split()[3:40]))]
    return spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("shard", [2_000_000, 60])
def test_leaks_brute(docs, spark, shard):
    bench, items = benchmark(spark)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, shard_words=shard).collect()}

    def grams(w):
        return {tuple(w[k : k + m]) for m in range(1, 6) for k in range(len(w) - m + 1)}

    want = set()
    for item, text in items:
        parts = [p for p in map(words, decontaminate.parts(text or "")) if p]
        need = [{tuple(p[k : k + 5]) for k in range(max(1, len(p) - 4))} for p in parts]
        for r in fixture_rows():
            have = grams(words(r[1]))
            if parts and all(len(x & have) / len(x) >= 0.8 for x in need):
                want.add((r[0], item))
    assert found == want and len(want) > 5
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in want})


def test_wand_is_exhaustive():
    rng = random.Random(3)
    items = [(i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(12))) for i in range(150)]
    index = decontaminate.Index(items)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.words)), 25))
        full = collections.defaultdict(float)
        for t in terms:
            for d, w in zip(index.docs[t], index.weights[t]):
                full[d] += w
        got = dict(index.search(terms, 0.4))
        assert set(got) == {d for d, s in full.items() if s >= 0.4}


def plain_automaton(toks, training):
    """States with their arcs and failure arcs as dictionaries; every n-gram of the training texts is an arc."""
    c = [collections.Counter() for _ in range(4)]
    for i, w in toks.items():
        for n in (1, 2, 3):
            c[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if i in training)
    total, types = sum(c[1].values()), len(c[1])
    unknown = (sum(v == 1 for v in c[1].values()) + 1) / (total + 2)

    def p(h, w):
        if not h:
            return (1 - unknown) * c[1][(w,)] / total if c[1][(w,)] else unknown
        back = lm_score.BACK[len(h) - 1]
        return (1 - back) * c[len(h) + 1][h + (w,)] / c[len(h)][h] + back * p(h[1:], w) if c[len(h)][h] else p(h[1:], w)

    def state(h):
        while h and (len(h) > 2 or h not in c[len(h)]):
            h = h[1:]
        return h

    arcs = {g: (math.log10(p(g[:-1], g[-1])), state(g)) for n in (1, 2, 3) for g in c[n]}
    fail = {h: (math.log10(lm_score.BACK[n - 1]), h[1:]) for n in (1, 2) for h in c[n]}

    def walk(w):
        now, total_log = (), 0.0
        for x in w:
            while now and now + (x,) not in arcs:
                weight, now = fail[now]
                total_log += weight
            weight, now = arcs.get(now + (x,), (math.log10(p((), x)), ()))
            total_log += weight
        return total_log

    return c, total, types, p, walk


def test_lm_brute(docs, spark, monkeypatch):
    got = {r.doc_id: r for r in as_query(docs, "op8_lm_score", monkeypatch, spark).collect()}
    toks = {r[0]: words(r[1]) + [""] for r in fixture_rows()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c, total, types, p, walk = plain_automaton(toks, {i for i in toks if not out[i]})
    for i, w in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(w), sum(c[1][(x,)] > 0 for x in w), total)
        assert abs(r.base_score - sum(math.log10((c[1][(x,)] + 1) / (total + types + 1)) for x in w)) < 1e-7 * len(w)
        assert abs(r.score - walk(w)) < 1e-7 * len(w)
        assert abs(r.score - sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(len(w)))) < 1e-7 * len(w)


@pytest.mark.parametrize(("unit", "span", "lane"), [(8 << 20, 16 << 20, 256), (1500, 2000, 256), (4000, 700, 5)])
def test_lm_units_ranges_and_lanes(docs, spark, monkeypatch, unit, span, lane):
    """Small units, many ranges and short lanes give the same scores."""
    want = {r.doc_id: r.score for r in lm_score.score(docs, F.col("doc_id") % 3 != 0).collect()}
    for name, v in (("UNIT_BYTES", unit), ("RANGE_BYTES", span)):
        monkeypatch.setattr(lm_score, name, v)
    texts = pa.array([r[1] for r in fixture_rows()])
    t, first = lm_score._tokens(texts)
    totals = [np.unique(lm_score._grams(t, first, n)[0], return_counts=True)[1] for n in (1, 2, 3)]
    auto = lm_score.Automaton(t, first, 3, np.concatenate(totals), len(t), len(totals[0]))
    whole = auto.scores()
    monkeypatch.setattr(lm_score, "LANE", lane)
    assert np.allclose(auto.scores(), whole)
    got = {r.doc_id: r.score for r in lm_score.score(docs.repartition(3), F.col("doc_id") % 3 != 0).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 * (1 + abs(want[i])) for i in want)


def test_lm_probabilities_sum_to_one():
    """Each state's arcs and what it hands down, over all words and the unknown."""
    toks = {i: words(r[1])[:60] + [""] for i, r in enumerate(fixture_rows())}
    c, total, types, p, _ = plain_automaton(toks, set(toks))
    for h in [(), *list(c[1])[:40:7], *list(c[2])[:90:17]]:
        if h[-1:] != ("",):
            assert abs(sum(p(h, w) for (w,) in c[1]) + p(h, "never seen") - 1) < 1e-9


def test_packed_blocks_are_small():
    """Hashes take about the bits that telling them apart needs, counts that are mostly alike little."""
    rng = np.random.default_rng(5)
    for n in (1000, 300_000):
        keys = np.unique(rng.integers(0, (1 << 64) - 1, n, np.uint64, endpoint=True))
        blob = lm_score.pack(keys)
        assert (lm_score.unpack(blob) == keys).all() and 8 * len(blob) < n * (64 - math.log2(n) + 1.6) + 8 * 32
    for keys in ([7], [0, (1 << 64) - 1], [3, 4, 5, 1 << 63], range(1000)):
        keys = np.array(keys, np.uint64)
        assert (lm_score.unpack(lm_score.pack(keys)) == keys).all()
    counts = rng.geometric(0.9, 100_000)
    blob = lm_score.pack_counts(counts)
    assert (lm_score.unpack_counts(blob, len(counts)) == counts).all() and 8 * len(blob) < 0.75 * len(counts)


def test_packed_blocks():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1 << 63), (2, 3), (5000, 1 << 63), (300, 1 << 20)):
        keys = np.unique(rng.integers(0, top, n, np.uint64))
        assert (lm_score.unpack(lm_score.pack(keys)) == keys).all()
        counts = rng.integers(0, 600, n)
        assert (lm_score.unpack_counts(lm_score.pack_counts(counts), n) == counts).all()
    assert lm_score._cut_points(np.array([0, 1 << 62, 1 << 63, (1 << 64) - 1], np.uint64), 4).tolist() == [0, 1, 2, 3, 4]


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op9(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_network_pieces():
    """Scores do not depend on what else is in the batch, nor on pieces."""
    import pyarrow as pa

    from panelcast.llm import words as W

    rng = random.Random(1)
    texts = ["", "a", "é" * 50_000] + ["".join(rng.choice("ab !%") for _ in range(rng.choice([1, 127, 128, 129, 300, 256]))) for _ in range(40)]
    net = quality_cnn.fit([t.encode() for t in texts], [i % 2 for i in range(len(texts))], epochs=1)
    whole = net.score(*W.buffers(pa.array(texts)))
    assert all(abs(net.score(*W.buffers(pa.array([t])))[0] - s) < 1e-9 for t, s in zip(texts, whole))


def test_network_is_a_plain_convolution():
    """Every filter at every byte of the whole text, the largest of each overlapping chunk of 256 bytes, the mean over chunks, one logistic unit."""
    from panelcast.llm import words as W

    rng = random.Random(2)
    texts = ["", "z", "é à", "x" * 128, "ab!" * 43, "q" * 129] + ["".join(rng.choice("abc !%.\né") for _ in range(rng.choice([5, 250, 256, 257, 1000]))) for _ in range(25)]
    net = quality_cnn.fit([t.encode() for t in texts], [i % 2 for i in range(len(texts))], epochs=2)
    table, half = net.table.astype(np.float64), quality_cnn.HALF
    for t, got in zip(texts, net.score(*W.buffers(pa.array(texts)))):
        b = t.encode()
        padded = b + bytes(quality_cnn.WIDTH)
        at_place = np.array([sum(table[j, padded[k + j]] for j in range(quality_cnn.WIDTH)) for k in range(max(1, len(b)))])
        pooled = [np.maximum(at_place[k : k + half].max(0) + net.bias, 0) for k in range(0, max(1, len(b)), half)]
        chunks = [np.maximum(x, y) for x, y in zip(pooled, pooled[1:])] or pooled
        assert abs(got - 1 / (1 + math.exp(-(np.mean(chunks, 0) @ net.out + net.out_bias)))) < 1e-5


def test_collided_chunks(docs, monkeypatch):
    """A chunk hash that stands for two contents is told apart by SHA-256."""
    want = got_rows(exact_dedup.exact_dedup(docs), ["doc_id", "keep_id", "group_size", "kept"])
    real = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: real(c) % 3)
    assert got_rows(exact_dedup.exact_dedup(docs), ["doc_id", "keep_id", "group_size", "kept"]) == want
    monkeypatch.setattr(exact_dedup, "LISTED", 0)
    assert got_rows(exact_dedup.exact_dedup(docs), ["doc_id", "keep_id", "group_size", "kept"]) == want


OPS = {
    "license": lambda s, d: license_scan.scan(d),
    "spans": lambda s, d: span_dedup.remove_repeats(d),
    "tokens": lambda s, d: token_orc.token_output(d, queries.tokenizer_path()),
    "mix": lambda s, d: mixing.plan_copies(d, keep=("doc_id",)),
    "near": lambda s, d: near_dup.near_duplicates(d),
    "lm": lambda s, d: lm_score.score(d, F.lit(True)),
    "quality": lambda s, d: quality_cnn.score(d, quality_cnn.train(d, d.selectExpr("doc_id", "n % 2 AS quality"))),
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", OPS)
def test_nulls_repeats_and_empty_tables(name, spark, with_odd_rows, empty):
    got = OPS[name](spark, with_odd_rows)
    n = with_odd_rows.count()
    assert got.count() == n and got.where("doc_id IS NULL").count() == 2 and got.where("doc_id = 12").count() == 3
    assert got.select(*[c for c in got.columns if c != "doc_id"]).where("doc_id = 12").distinct().count() == (1 if name not in ("tokens", "mix") else got.where("doc_id = 12").drop("doc_id").distinct().count())
    none = OPS[name](spark, empty)
    assert none.count() == 0 and none.columns == got.columns


def test_null_ids_in_groups(with_odd_rows):
    e = [r for r in exact_dedup.exact_dedup(with_odd_rows).collect() if r.doc_id is None]
    assert sorted((r.keep_id, r.kept) for r in e) == [(0, False), (13, False)]
    n = [r for r in near_dup.near_duplicates(with_odd_rows).collect() if r.doc_id is None]
    assert sorted((r.n_shingles > 0, r.component_id, r.kept) for r in n) == [(False, None, True), (True, 13, False)]
    assert near_dup.drop_near_duplicates(with_odd_rows).columns == with_odd_rows.columns


def test_leaks_with_one_word_changed(spark):
    """Words glued to punctuation and one word changed, in short and long halves."""
    rng = random.Random(12)
    filler = lambda n: [f"f{rng.randrange(400)}" for _ in range(n)]
    items, rows, want = [], [], set()
    for i, half in enumerate([5, 6, 7, 8, 9, 12, 18]):
        q, a = [[f"{x}{i}w{k}" for k in range(half)] for x in "qa"]
        items.append((i, " ".join(q) + "? " + " ".join(a)))
        glued = [*q[:-1], q[-1] + "?&&&", "--(" + a[0], *a[1:-1], a[-1] + ".&&&"]
        copies = [glued] + [q[:k] + ["other"] + q[k + 1 :] + ["-", *a] for k in range(half)] + [[*q, *a[:k], "other", *a[k + 1 :]] for k in range(half)]
        others = [q + filler(half), [*q, *a[: half // 2], *filler(half - half // 2)]]
        for leak, texts in ((True, copies), (False, others)):
            for t in texts:
                want |= {(len(rows), i)} if leak else set()
                rows.append((len(rows), " ".join([*filler(30), *t, *filler(30)])))
    bench = spark.createDataFrame([*items, (98, "..."), (99, "-- &&& ?")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == want


def test_leak_scores_do_not_depend_on_shards(docs, spark):
    items = [(i, " ".join(words(r[1])[2 : 9 + i])) for i, r in enumerate(fixture_rows()[9:30])]
    rows = spark.createDataFrame([(i, "common " + t.rsplit(" ", 1)[0] + " tail") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "common " + t) for i, t in items], "item_id long, text string")
    got = [{(r.doc_id, r.item_id, r.word): round(r.score, 9) for r in decontaminate.find_leaks(rows, bench, shard_words=n).collect()} for n in (2_000_000, 150)]
    assert got[0] == got[1] and len(got[0]) >= 15 and min(got[0].values()) < 1


def test_bare_words():
    import numpy as np
    import pyarrow as pa

    from panelcast.llm import words as W

    texts = ["a.", "", ".", "b 'c-d' e.f.&&& -- (é)!", None, "!x", "y?", "?", "  z  "]
    h, first = W.hash_words(*W.bare(*W.buffers(pa.array(texts).slice(1))))
    plain, f = W.hash_words(*W.buffers(pa.array(["", "", "b c-d e.f é", "", "x", "y", "", "z"])))
    assert np.array_equal(h, plain) and np.array_equal(first, f)


def test_special_tokens_as_the_library_has_them(spark, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    e = "<|endoftext|>"
    texts = [f"x {e} y", e, f"{e} a", f"a {e}", f"a{e}b c", f"{e}{e}", f"a {e}{e} {e} b", f"a  {e}  b", f"a {e}b", f"b{e} {e}\n{e} c", f" {e} ", f"a {e[:-1]} {e}> b", "plain text"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    start = 0
    for r in as_query(df, "op3_token_orc", monkeypatch, spark).orderBy("doc_id").collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert tok.encode(texts[0], add_special_tokens=False).ids == [87, 220, 50256, 331]


def test_url_entries_of_any_depth(spark):
    lists = spark.createDataFrame([("a.b/p/q/r", 1, "block"), ("a.b/p/q/r/s/t", 2, "allow"), ("a.b", 0, "allow")], "key string, day long, action string")
    captures = spark.createDataFrame([(k, f"http://a.b/{u}", 3) for k, u in enumerate(["p/q", "p/q/r", "p/q/r/x?y", "p/q/r/s/t/u", "p/q/rr"])], "page_id long, url string, day long")
    got = [(r.kept, r.decided_by) for r in url_lists.evaluate(captures, lists).orderBy("page_id").collect()]
    assert got == [(True, "a.b"), (False, "a.b/p/q/r"), (False, "a.b/p/q/r"), (True, "a.b/p/q/r/s/t"), (True, "a.b")]
