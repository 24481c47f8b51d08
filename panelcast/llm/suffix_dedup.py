"""Removal of repeated byte strings with suffix arrays of shards.

A byte goes if it is covered by a string of ``size`` (400) bytes that also starts anywhere else, in the same or another text; strings are judged on the
input.  The start of such a string is called a place.

1. Places are dealt so that equal strings meet in one shard.  Each place takes as its anchor the least of the hashes of the ``GRAM``-byte strings
   inside its ``size`` bytes (the leftmost of equals), so equal strings have equal anchors.  Neighbouring places with the same anchor form a stretch; a text of n
   bytes has about ``2 n / (size - GRAM)`` of them.
2. Equal stretches are counted as one.  Anchors that occur once in all texts are done: nothing repeats there.
3. Each shard (about ``SHARD`` bytes of different stretches) builds the suffix array of its stretches by induced sorting and the permuted common
   prefixes (:mod:`panelcast.llm.suffix_array`).  A place is repeated if its suffix shares ``size`` bytes with a neighbour in the array, or its stretch occurs twice.
4. Anchors with over ``HOT`` different stretches (a phrase in very many contexts) would fill a shard alone; their places are instead counted one by one, by 128-bit
   digests of their strings, with partial sums before the shuffle.
5. Repeated places go back to the stretches of all texts, and are cut out.

Scale: two passes over the texts; a stretch row has 40 bytes a 150 bytes of text, only stretches with a common anchor are read again.  Groups of many copies
are rows that join with a broadcast of bounded size (:func:`panelcast.llm.util.join_groups`).  A long text is read a megabyte at a time.

Defined cases: a null text is empty; repeated rows are texts of their own (all copies lose what they share); texts under ``size`` bytes stay whole, as does
a table of one short row; ids may be null or repeat; what remains need not be valid UTF-8 and is given as bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.suffix_array import common_prefixes, suffix_array
from panelcast.llm.util import give_back, join_groups, prepare, stage

SIZE = 400
GRAM = 100
PIECE = 1 << 19
SHARD = 1 << 19
HOT = 1000
SEPARATOR = 0xFF  # no byte of UTF-8
_BASE = W.splitmix(4242) | 1
_CODE = np.array([W.splitmix(i + 501) for i in range(256)], np.uint64)
_POWERS: dict[int, np.ndarray] = {}
STRETCH = "row long, start long, n int, anchor long, times int, same binary"


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        p = np.full(max(n, PIECE + SIZE), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[base][:n]


def _gram_hashes(d: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` bytes from each place."""
    up, down = _powers(_BASE, len(d)), _powers(pow(_BASE, -1, 1 << 64), len(d))
    sums = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(_CODE[d] * up, out=sums[1:])
    return W.mix((sums[k:] - sums[:-k]) * down[: len(d) - k + 1])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = len(x) - w + 1
    wide = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    wide[: len(x)] = x
    rows = wide.reshape(-1, w)
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    ahead = np.minimum.accumulate(rows, 1).ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _stretches_of(d: np.ndarray, size: int, gram: int):
    """``(start, n, anchor, times)`` of the stretches of a run of bytes of at most a piece of places."""
    h = _gram_hashes(d, gram)
    low = np.uint64((1 << 21) - 1)
    least = _least((h & ~low) | np.arange(len(h), dtype=np.uint64), size - gram + 1)
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    anchor = h[at[first]]
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    times = np.diff(np.append(np.flatnonzero(new), len(first)))
    first = first[new]
    return first, np.diff(np.append(first, len(at))), anchor[new], times


def _stretches(size: int, gram: int, piece: int):
    """All stretches of each text; texts are read a piece at a time."""

    def run(batches):
        for batch in batches:
            data, off = W.buffers(batch.column(1))
            rows = batch.column(0).to_numpy()
            found: list[tuple] = []
            held = 0
            for r in np.flatnonzero(np.diff(off) >= size):
                for a in range(int(off[r]), int(off[r + 1]) - size + 1, piece):
                    d = data[a : min(int(off[r + 1]), a + piece + size - 1)]
                    first, n, anchor, times = _stretches_of(d, size, gram)
                    raw = d.tobytes()
                    same = [hashlib.blake2b(raw[s : s + m + size - 1], digest_size=16).digest() for s, m in zip(first.tolist(), n.tolist())]
                    found.append((np.full(len(first), rows[r]), first + (a - off[r]), n.astype(np.int32), anchor.view(np.int64), times.astype(np.int32), same))
                    held += len(first)
                    if held > 50000:
                        yield _stretch_batch(found)
                        found, held = [], 0
            if found:
                yield _stretch_batch(found)

    return run


def _stretch_batch(found: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array(np.concatenate([f[i] for f in found])) for i in range(5)]
    return pa.record_batch([*cols, pa.array([s for f in found for s in f[5]], pa.binary())], names=["row", "start", "n", "anchor", "times", "same"])


def _cut_out(size: int):
    """The bytes of the listed stretches of each text."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_buffer()
                out = [(s, raw.slice(s["start"], s["n"] + size - 1).to_pybytes()) for s in batch.column(1)[i].as_py()]
                for a in range(0, len(out), 5000):
                    part = out[a : a + 5000]
                    yield pa.record_batch(
                        [pa.array([s["anchor"] for s, _ in part], pa.int64()), pa.array([s["same"] for s, _ in part], pa.binary()), pa.array([s["copies"] for s, _ in part], pa.int64()), pa.array([s["hot"] for s, _ in part], pa.bool_()), pa.array([b for _, b in part], pa.binary())],
                        names=["anchor", "same", "copies", "hot", "bytes"],
                    )

    return run


def _runs(on: np.ndarray) -> bytes:
    """The runs of a mask as pairs (first, after the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edge.astype("<i4").tobytes()


def _search_shard(size: int):
    """The repeated places of each stretch of a shard, from its suffix array."""

    def run(t: pa.Table) -> pa.Table:
        pieces = t.column("bytes").to_pylist()
        text = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in pieces), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        left = np.repeat(ends, ends - starts + 1) - np.arange(len(text))
        length, other = common_prefixes(text, suffix_array(text), left)
        hit = np.flatnonzero(length >= size)
        repeated = np.zeros(len(text), bool)
        repeated[hit] = True
        repeated[other[hit]] = True
        copies = t.column("copies").to_numpy()
        out = []
        for s, e, c in zip(starts, ends, copies):
            on = repeated[s : e - size + 1]
            out.append(_runs(np.ones(len(on), bool) if c > 1 else on))
        keep = pa.array([bool(o) for o in out])
        got = pa.table([t.column("same"), t.column("copies"), pa.array(out, pa.binary())], names=["same", "copies", "runs"])
        del text, left, length, other, hit, repeated
        give_back()
        return got.filter(keep)

    return run


def _places(size: int):
    """One row a place of a stretch, with the digest of its string."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py()
                n = len(raw) - size + 1
                digests = [hashlib.blake2b(raw[a : a + size], digest_size=16).digest() for a in range(n)]
                yield pa.record_batch(
                    [pa.array([batch.column(0)[i].as_py()] * n, pa.binary()), pa.array(np.full(n, batch.column(1)[i].as_py())), pa.array(np.arange(n, dtype=np.int32)), pa.array(digests, pa.binary())],
                    names=["same", "copies", "at", "digest"],
                )

    return run


def _remove(size: int):
    """Each text's removed bytes and what is left."""

    def run(batches):
        for batch in batches:
            sizes, removed, spans, kept, shas = [], [], [], [], []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_buffer().to_pybytes() if batch.column(1)[i].is_valid else b""
                cuts = []
                for s in batch.column(2)[i].as_py() or []:
                    edge = np.frombuffer(s["runs"], "<i4").astype(np.int64) + s["start"]
                    cuts.append(np.stack([edge[0::2], edge[1::2] + size - 1], 1))
                n = b = 0
                rest = []
                at = 0
                if cuts:
                    c = np.concatenate(cuts)
                    c = c[np.argsort(c[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(c[:, 1])
                    first = np.flatnonzero(np.concatenate([[True], c[1:, 0] > reach[:-1]]))
                    last = np.append(first[1:], len(c)) - 1
                    for s, e in zip(c[first, 0].tolist(), reach[last].tolist()):
                        rest.append(raw[at:s])
                        at, n, b = e, n + 1, b + e - s
                rest.append(raw[at:])
                text = b"".join(rest)
                sizes.append(len(raw))
                removed.append(b)
                spans.append(n)
                kept.append(text)
                shas.append(hashlib.sha256(text).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _hot_runs(places: DataFrame) -> DataFrame:
    """Runs of repeated places of hot anchors' stretches, from the count of each place's string."""
    counts = places.groupBy("digest").agg(F.sum("copies").alias("total")).where("total > 1")
    hits = places.join(counts, "digest")
    at = F.array_sort(F.collect_list("at"))
    got = hits.groupBy("same").agg(F.first("copies").alias("copies"), at.alias("at"))
    return got.mapInArrow(_pack, "same binary, copies long, runs binary")


def _pack(batches):
    for batch in batches:
        out = []
        for at in batch.column(2):
            a = at.values.to_numpy()
            on = np.zeros(int(a.max()) + 1, bool)
            on[a] = True
            out.append(_runs(on))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["same", "copies", "runs"])


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes)."""
    spark = prepare(docs.sparkSession)
    texts = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "texts")
    found = stage(texts.select("row", "text").mapInArrow(_stretches(size, gram, piece), STRETCH), "stretches")
    total = found.count()
    kinds = found.groupBy("anchor", "same").agg(F.count(F.lit(1)).alias("copies"), F.max("times").alias("times"), F.min(F.struct("row", "start", "n")).alias("one"))
    kinds = stage(kinds, "kinds")
    anchors = kinds.groupBy("anchor").agg(F.sum(F.col("copies") * F.col("times")).alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    shared = join_groups(kinds.drop("times"), anchors, ["anchor"], "kinds", total).where("all IS NOT NULL").withColumn("hot", F.col("kinds") > HOT)
    lists = shared.groupBy(F.col("one.row").alias("row")).agg(F.collect_list(F.struct("anchor", "same", "copies", "hot", F.col("one.start").alias("start"), F.col("one.n").alias("n"))).alias("list"))
    pieces = texts.join(lists, "row").select("text", "list").mapInArrow(_cut_out(size), "anchor long, same binary, copies long, hot boolean, bytes binary")
    pieces = stage(pieces, "pieces")
    weight = pieces.where("NOT hot").agg(F.sum(F.length("bytes") + 1)).first()[0] or 0
    shards = max(1, -(-weight // SHARD))
    cold = pieces.where("NOT hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartition(shards, "shard")
    cold = cold.groupBy("shard").applyInArrow(_search_shard(size), "same binary, copies long, runs binary")
    hot = pieces.where("hot").select("same", "copies", "bytes").mapInArrow(_places(size), "same binary, copies long, at int, digest binary")
    runs = stage(cold.unionAll(_hot_runs(hot)), "runs")
    hits = join_groups(found.select("row", "start", "same"), runs, ["same"], "copies", total).where("runs IS NOT NULL")
    cuts = hits.groupBy("row").agg(F.collect_list(F.struct("start", "runs")).alias("cuts"))
    out = texts.join(cuts, "row", "left").select("doc_id", "text", "cuts")
    kind = docs.schema[id_col].dataType.simpleString()
    return out.mapInArrow(_remove(size), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
