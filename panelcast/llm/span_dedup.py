"""Substring dedup over sliding sentence spans.

A sentence ends behind a word that ends in ``.``, ``!`` or ``?`` and before a line break.  From every sentence
a span runs on until it has ``sentences`` sentences and ``words`` words, or ``long_words`` words.  Spans are
compared by a 128-bit hash of their words (A-Z as a-z, white space of any kind alike).  The first
place of a span is the one with the smallest (id, hash of the text, sentence); every sentence covered by a span at
any other place is removed, with the white space behind it.

Scale: one row a sentence is counted by a partial aggregation.  Spans with more than 1 / HEAVY_SHARE of all repeated
places are fewer than HEAVY_SHARE: they are broadcast and removed where the texts are cut, without a row a place.  Places of the
other spans join them by a shuffle in which no key is hot; texts are shuffled once, to meet their own removals.

Defined cases: a null text is empty and stays null-free (empty string out); a text without a full span loses
nothing; rows without id stay as they are; rows that repeat an id and text are one document, each
row cut alike; rows that share an id but not a text are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.util import HEAVY_SHARE, prepare, stage

_ENDS = np.zeros(256, bool)
_ENDS[[ord("."), ord("!"), ord("?")]] = True
_B1, _B2 = W.splitmix(501) | 1, W.splitmix(502) | 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Word hashes and sentence bounds of texts: ``(hashes, first, starts, s_first, s_text)``; sentence j has the
    words ``s_first[j]`` up to ``s_first[j + 1]`` and belongs to text ``s_text[j]``."""
    h, first, starts, ends = W.hash_words(data, offsets, places=True)
    n = len(h)
    if not n:
        return h, first, starts, np.zeros(1, np.int64), np.zeros(0, np.int64)
    last = _ENDS[data[ends - 1]]
    breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0]
    if len(breaks):
        last = last | (np.searchsorted(breaks, np.append(starts[1:], offsets[-1])) > np.searchsorted(breaks, ends))
    begins = np.append(True, last[:-1])
    begins[first[:-1][first[:-1] < n]] = True
    s_first = np.flatnonzero(begins)
    return h, first, starts, np.append(s_first, n), np.searchsorted(first, s_first, side="right") - 1


def spans(h, s_first, s_text, least_sentences: int, least_words: int, long_words: int):
    """For each sentence the end of its span (sentence index, -1 if the text ends before) and two hashes."""
    k = len(s_text)
    if not k:
        z = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), z, z
    own = np.arange(k)
    begin = s_first[:-1]
    by_words = np.searchsorted(s_first, begin + least_words)  # first boundary with enough words behind it
    by_long = np.searchsorted(s_first, begin + long_words)
    end = np.minimum(np.maximum(own + least_sentences, by_words), np.maximum(by_long, own + 1))
    text_end = np.searchsorted(s_text, s_text, side="right")
    end = np.where(end > text_end, -1, end)
    a, b = begin, s_first[np.maximum(end, 0)]
    out = []
    for base, salt in ((_B1, 11), (_B2, 13)):
        p = _powers(base, len(h) + 1)
        q = _powers(pow(base, -1, 1 << 64), len(h) + 1)
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h + np.uint64(salt)) * p[:-1], dtype=np.uint64)])
        out.append(W.mix((s[b] - s[a]) * q[a] + (b - a).astype(np.uint64)))
    return end, out[0], out[1]


def _heavy(table, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The row of each span in the table of spans with very many places, -1 if it has fewer."""
    keys, second = table[0], table[1]
    if not len(keys) or not len(h1):
        return np.full(len(h1), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, h1), len(keys) - 1)
    return np.where((keys[at] == h1) & (second[at] == h2), at, -1)


def _span_rows(rule, box=None):
    def run(batches):
        for batch in batches:
            for lo, hi in W.groups(batch.column(1)):
                ids, same = (batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in (0, 2))
                h, _, _, s_first, s_text = sentences(*W.buffers(batch.column(1).slice(lo, hi - lo)))
                end, h1, h2 = spans(h, s_first, s_text, *rule)
                ok = end >= 0
                if box is not None:
                    ok &= _heavy(box.value, h1, h2) < 0
                at = np.arange(len(s_text)) - np.searchsorted(s_text, s_text)
                yield pa.record_batch(
                    [pa.array(h1[ok].view(np.int64)), pa.array(h2[ok].view(np.int64)), pa.array(ids[s_text[ok]].astype(np.int64)), pa.array(same[s_text[ok]].astype(np.int64)), pa.array(at[ok].astype(np.int32)), pa.array((end - np.arange(len(s_text)))[ok].astype(np.int32))],
                    names=["h1", "h2", "doc_id", "same", "at", "len"],
                )

    return run


def _cut(rule, box):
    """Removes the sentences of the listed places, and of places of very common spans other than the first."""

    def run(batches):
        table = box.value
        for batch in batches:
            ids, texts, places, same = batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3)
            for lo, hi in W.groups(texts):
                part = texts.slice(lo, hi - lo)
                data, offsets = W.buffers(part)
                h, _, starts, s_first, s_text = sentences(data, offsets)
                s_of = np.searchsorted(s_text, np.arange(hi - lo + 1))
                gone = np.zeros(len(s_text) + 1, np.int32)  # +1 where a removed span begins, -1 behind it
                end, h1, h2 = spans(h, s_first, s_text, *rule)
                common = np.where(end >= 0, _heavy(table, h1, h2), -1)
                for j in np.flatnonzero(common >= 0):
                    i = lo + int(s_text[j])
                    doc = ids[i].as_py()
                    if doc is not None and (doc, same[i].as_py(), int(j - s_of[s_text[j]])) != table[2][common[j]]:
                        gone[j] += 1
                        gone[end[j]] -= 1
                for i in range(hi - lo):
                    a, b = int(s_of[i]), int(s_of[i + 1])
                    for p in places[lo + i] or ():
                        if a + p["at"] < b:
                            gone[a + p["at"]] += 1
                            gone[min(b, a + p["at"] + p["len"])] -= 1
                cut = np.cumsum(gone[:-1]) > 0
                words = np.diff(s_first)
                n_all, n_cut, n_words, out = [], [], [], []
                for i in range(hi - lo):
                    a, b = int(s_of[i]), int(s_of[i + 1])
                    mine = cut[a:b]
                    n_all.append(b - a)
                    n_cut.append(int(mine.sum()))
                    n_words.append(int(words[a:b][mine].sum()))
                    raw = data[offsets[i] : offsets[i + 1]]
                    if not mine.any():
                        out.append(raw.tobytes())
                        continue
                    bounds = np.append(starts[s_first[a:b]], offsets[i + 1]) - offsets[i]
                    bounds[0] = 0
                    out.append(b"".join(raw[bounds[j] : bounds[j + 1]].tobytes() for j in np.flatnonzero(~mine)))
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), pa.array(n_all, pa.int64()), pa.array(n_cut, pa.int64()), pa.array(n_words, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_sentences", "n_removed", "words_removed", "text"],
                )

    return run


def remove_repeats(docs: DataFrame, least_sentences: int = 2, least_words: int = 12, long_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_sentences, n_removed, words_removed, text`` (what stays)."""
    spark = prepare(docs.sparkSession)
    rule = (least_sentences, least_words, long_words)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("same", F.xxhash64("text"))  # with the id, the document
    known, kind, place = texts.where("doc_id IS NOT NULL"), "h1 long, h2 long, doc_id long, same long, at int, len int", ["doc_id", "same", "at"]
    seen = known.mapInArrow(_span_rows(rule), kind).groupBy("h1", "h2").agg(F.min(F.struct(*place)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = stage(seen, "spans")
    bar = max(1, (seen.agg(F.sum("n")).first()[0] or 0) // HEAVY_SHARE)
    heavy = sorted(((r["h1"] % (1 << 64), r["h2"] % (1 << 64), tuple(r["first"])) for r in seen.where(F.col("n") > bar).collect()))
    box = spark.sparkContext.broadcast((np.array([x[0] for x in heavy], np.uint64), np.array([x[1] for x in heavy], np.uint64), [x[2] for x in heavy]))
    rare = known.mapInArrow(_span_rows(rule, box), kind)
    again = rare.join(seen.where(F.col("n") <= bar), ["h1", "h2"]).where("(doc_id, same, at) <> (first.doc_id, first.same, first.at)")
    gone = again.groupBy("doc_id", "same").agg(F.collect_set(F.struct("at", "len")).alias("gone"))
    cut = texts.join(gone, ["doc_id", "same"], "left").select("doc_id", "text", "gone", "same")
    return cut.mapInArrow(_cut(rule, box), "doc_id long, n_sentences long, n_removed long, words_removed long, text string")
