"""Benchmark decontamination: a BM25 inverted index of the test items, searched by every training passage.

Words are compared without the ASCII punctuation before and after them (``yes.&&&`` is ``yes``); a word of nothing else is none.

Items are the indexed side: each word has a posting list in item order, cut into blocks with their largest
weight.  A posting's weight is its BM25 contribution divided by the item's score against itself, so a passage that holds a
whole item scores 1.  Passages are windows of ``2 * span`` words every ``span`` words, ``span`` being a quarter longer than the longest item,
so an item lies whole in a window.  Every passage of every document is a query:

* the block-max bound is first taken for all passages at once: for each block of items the largest weights of the passage's words
  there are added up; a passage for which no block reaches the threshold has no item above it;
* passages that are left take the bound again with their own distinct words (the first one adds up two neighbouring stretches);
* the remaining passages run block-max WAND and yield all items at or above the threshold;
* a retrieved item is a leak if its question and its answer both overlap the passage: at least ``overlap`` of
  the five-word shingles of each part occur in it, or, in a part of five words or more, all words before and all words after some one word
  (a copy with one word changed, whatever its length and the word's place).  The answer is what follows the last ``?`` or an ``Answer:`` mark, without one the
  second half of the words.

Scale: one scan of the documents, no shuffle.  The index is broadcast; items are dealt to shards by the hash of their id so that a shard holds about
``shard_words`` words, and each shard is one more pass.  Document frequencies, mean length and span are those of all items, whatever the shards; a
shard is handed the frequencies of its own words.

Defined cases: items or documents without words match nothing; items with equal texts are all reported; a part of fewer than five words is
one shingle; rows that repeat an id are searched each and reported once a pair; null ids are reported as null; no items or no
documents give an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.util import give_back, prepare, stage

THRESHOLD, OVERLAP, SHINGLE, BLOCK, COARSE = 0.6, 0.8, 5, 16, 64
K1, B = 1.2, 0.75
_MARK = re.compile(r"(?is)^(.*(?:\?|\banswer\s*:))\s*(\S.*)$")


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    m = _MARK.match(text)
    if m:
        return m.group(1), m.group(2)
    w = text.split()
    return " ".join(w[: (len(w) + 1) // 2]), " ".join(w[(len(w) + 1) // 2 :])


def _hashes(text: str) -> np.ndarray:
    return W.hash_words(*W.bare(*W.buffers(pa.array([text]))))[0]


def _overlap(h: np.ndarray, own: np.ndarray, least: float) -> tuple[float, bool]:
    """The share of the shingles of a part with words ``h`` that are in ``own``, and whether that is enough."""
    p = W.shingles(h, SHINGLE)
    if not len(p):
        return 1.0, True
    hit = np.isin(p, own)
    share = float(hit[np.unique(p, return_index=True)[1]].mean())
    if share >= least - EPS or len(h) < SHINGLE:
        return share, share >= least - EPS
    miss = np.flatnonzero(~hit)
    for j in range(miss[-1], min(len(h), miss[0] + SHINGLE)):  # the words that all missing shingles hold
        if all(np.isin(W.shingles(x, SHINGLE), own).all() for x in (h[:j], h[j + 1 :])):
            return share, True
    return share, False


@dataclass
class Whole:
    """Of all items: their number, mean and largest length, and in how many each word of a shard is."""

    n: int
    mean: float
    longest: int
    df: dict


class Index:
    """Posting lists of ``items`` (id, text), with block maxima; weights are shares of an item's own score.  ``whole``: of all
    items, where these are a shard."""

    def __init__(self, items: list[tuple[int, str]], whole: Whole | None = None):
        items = [(i, t, _hashes(t or "")) for i, t in items]
        items = [x for x in items if len(x[2])]
        self.ids = [i for i, _, _ in items]
        self.span = math.ceil(1.25 * (whole.longest if whole else max((len(h) for _, _, h in items), default=1)))
        self.parts = [[_hashes(p) for p in parts(t)] for _, t, _ in items]
        df: dict = {}
        counts = [dict(zip(*map(np.ndarray.tolist, np.unique(h, return_counts=True)))) for _, _, h in items]
        for c in counts:
            for w in c:
                df[w] = df.get(w, 0) + 1
        n, mean = len(items), (sum(len(h) for _, _, h in items) / len(items)) if items else 1
        width = max(1, math.ceil(n / COARSE))
        if whole:
            n, mean, df = whole.n, whole.mean, {w: whole.df[w] for w in df}
        lists: dict = {w: [] for w in df}
        for k, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(items[k][2]) / mean)
            raw = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in c.items()}
            own = sum(raw.values())
            for w, x in raw.items():
                lists[w].append((k, x / own))
        self.words = np.array(sorted(lists), np.uint64)
        self.docs = [[k for k, _ in lists[w]] for w in sorted(lists)]
        self.weights = [[x for _, x in lists[w]] for w in sorted(lists)]
        self.most = np.array([max(x) for x in self.weights] or [0.0])
        self.blocks = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.weights]
        self.bound = np.zeros((max(1, len(self.words)), max(1, math.ceil(len(items) / width))), np.float32)
        for t, (ds, ws) in enumerate(zip(self.docs, self.weights)):
            np.maximum.at(self.bound[t], np.array(ds) // width, np.array(ws, np.float32))
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.words & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The word number of each hash, -1 for words that no item has."""
        out = np.full(len(h), -1, np.int32)
        may = np.flatnonzero(self.bits[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if len(may) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, h[may]), len(self.words) - 1)
            ok = self.words[at] == h[may]
            out[may[ok]] = at[ok]
        return out

    def bounds(self, segment: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` segments and each block of items the most its distinct words can add."""
        out = np.zeros((n, self.bound.shape[1]), np.float32)
        pair = np.unique(segment * len(self.words) + term)
        seg, t = pair // max(1, len(self.words)), pair % max(1, len(self.words))
        for at in range(0, len(pair), 1 << 16):
            some, first = np.unique(seg[at : at + (1 << 16)], return_index=True)
            out[some] += np.add.reduceat(self.bound[t[at : at + (1 << 16)]], first, axis=0)
        return out

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score against the passage with these words reaches ``threshold`` (block-max WAND)."""
        cur = [[self.docs[t][0], 0, t] for t in terms]
        found, end = [], len(self.ids)
        while cur:
            cur.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cur):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == item:
                pivot += 1
            here, shallow, edge = 0.0, [], end
            for c in cur[: pivot + 1]:
                docs = self.docs[c[2]]
                at = bisect.bisect_left(docs, item, c[1])
                if at < len(docs):
                    here += self.blocks[c[2]][at // BLOCK]
                    edge = min(edge, docs[min(len(docs), (at // BLOCK + 1) * BLOCK) - 1] + 1)
                shallow.append(at)
            if here < threshold:
                after = cur[pivot + 1][0] if pivot + 1 < len(cur) else end
                goal = max(item + 1, min(edge, after))
            else:
                score = sum(self.weights[c[2]][at] for c, at in zip(cur, shallow) if at < len(self.docs[c[2]]) and self.docs[c[2]][at] == item)
                if score >= threshold:
                    found.append((item, score))
                goal = item + 1
            for c in cur[: pivot + 1]:
                docs = self.docs[c[2]]
                c[1] = bisect.bisect_left(docs, goal, c[1])
                c[0] = docs[c[1]] if c[1] < len(docs) else end
            cur = [c for c in cur if c[0] < end]
        return found


EPS, SLOP = 1e-9, 1e-4  # of sums in double and in single precision


def _reach(index: Index, term: np.ndarray, begin: np.ndarray, end: np.ndarray, windows: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the ``windows`` for which a block of items reaches the threshold with the window's own distinct words."""
    size = end[windows] - begin[windows]
    of = np.repeat(np.arange(len(windows)), size)
    words = term[np.arange(len(of)) - np.repeat(np.cumsum(size) - size - begin[windows], size)]
    hit = words >= 0
    bound = index.bounds(of[hit], words[hit].astype(np.int64), len(windows))
    return windows[bound.max(axis=1) >= threshold - SLOP] if len(windows) else windows


def _search_all(box, threshold: float, overlap: float):
    def run(batches):
        index: Index = box.value
        span = index.span
        for batch in batches:
            out = []
            for lo, hi in W.groups(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                h, first = W.hash_words(*W.bare(*W.buffers(batch.column(1).slice(lo, hi - lo))))
                term = index.lookup(h)
                n = np.diff(first)
                windows = -(-n // span)
                doc = np.repeat(np.arange(hi - lo), windows)
                w_first = np.cumsum(windows) - windows
                begin = first[doc] + (np.arange(len(doc)) - w_first[doc]) * span
                end = np.minimum(begin + 2 * span, first[doc + 1])
                hit = np.flatnonzero(term >= 0)
                of = np.searchsorted(begin, hit, side="right") - 1
                bound = index.bounds(of, term[hit].astype(np.int64), len(doc))
                if len(doc) > 1:
                    bound[:-1] += bound[1:] * (doc[1:] == doc[:-1])[:, None]
                leaks: dict = {}
                may = np.flatnonzero(bound.max(axis=1) >= threshold - SLOP) if len(doc) else np.zeros(0, np.int64)
                for k in _reach(index, term, begin, end, may, threshold):
                    a, b = begin[k], end[k]
                    terms = np.unique(term[a:b])
                    terms = terms[terms >= 0]
                    own = None
                    for item, score in index.search(terms.tolist(), threshold - EPS):
                        own = np.unique(np.concatenate([W.ngrams(h[a:b], m) for m in range(1, SHINGLE + 1)])) if own is None else own
                        share, enough = zip(*(_overlap(p, own, overlap) for p in index.parts[item]))
                        if all(enough):
                            key = (int(doc[k]), item)
                            leaks[key] = max(leaks.get(key, (0.0, 0.0, 0.0, 0)), (min(1.0, score), share[0], share[1], -int(a - first[doc[k]])))
                out += [(ids[d], index.ids[i], s, q, r, -at) for (d, i), (s, q, r, at) in leaks.items()]
            if out:
                cols = list(zip(*out))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word"])
        give_back()

    return run


def _item_words(batches):
    """Each item's shard and distinct words, its length with the first."""
    for batch in batches:
        h, first = W.hash_words(*W.bare(*W.buffers(batch.column(1))))
        for k, shard in enumerate(batch.column(0).to_pylist()):
            u = np.unique(h[first[k] : first[k + 1]])
            if len(u):
                size = np.zeros(len(u), np.int64)
                size[0] = first[k + 1] - first[k]
                yield pa.record_batch([pa.array(np.full(len(u), shard)), pa.array(u.view(np.int64)), pa.array(size)], names=["shard", "h", "size"])


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_words: int = 2_000_000) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap, word`` of every leak (word: where the best window starts)."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    n_words = bench.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    shards = max(1, math.ceil(n_words / shard_words))
    bench = bench.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    if shards > 1:
        words = stage(bench.select("shard", "text").mapInArrow(_item_words, "shard long, h long, size long"), "item-words")
        n, mean, longest = words.where("size > 0").agg(F.count(F.lit(1)), F.avg("size"), F.max("size")).first()
        df = words.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    out = None
    for k in range(shards):
        mine = bench.where(F.col("shard") == k).orderBy("id").collect()
        whole = None
        if shards > 1 and n:
            t = df.join(words.where(F.col("shard") == k).select("h").distinct(), "h", "left_semi").select("h", "df").toArrow()
            whole = Whole(n, mean, longest, dict(zip(t.column(0).to_numpy().view(np.uint64).tolist(), t.column(1).to_pylist())))
        box = spark.sparkContext.broadcast(Index([(r["id"], r["text"]) for r in mine], whole))
        part = rows.mapInArrow(_search_all(box, threshold, overlap), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word long")
        out = part if out is None else out.unionAll(part)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", -F.col("word"))).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("x.score").alias("score"), F.col("x.question_overlap").alias("question_overlap"), F.col("x.answer_overlap").alias("answer_overlap"), (-F.col("x.col4")).alias("word"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without a leak, unchanged (rows without id stay)."""
    gone = find_leaks(docs, items, id_col=id_col, **options).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
