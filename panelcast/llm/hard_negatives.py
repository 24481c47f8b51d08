"""Hard negatives for embedding training, by threshold joins over an inverted index with norm bounds.

Vectors become integers (``floor(256 x)``), so that scores are exact.  For each anchor the most alike rows of its own label are its positives; for
each positive, rows of another label that score from 0.3 to 0.9 times as much as the positive are its hard negatives, the highest first.

* Dimensions are put in order of weight.  An anchor with threshold t is indexed only as far as needed: the rest is left out as soon as its norm
  times the largest row norm is below t, because rows that only meet it there cannot reach t.
* Rows stream past the index.  Partial scores are added up, eight dimensions at a time, for the anchors that have these dimensions in the index;
  a pair is dropped when its partial score and the product of the two remaining norms stay below t; what is left is scored in full.
* Each list (an anchor's positives, a positive's negatives) has a falling ladder of thresholds, estimated from a sample of rows; the last
  rung is the window's own bound.  A list that the rung fills is done, the others take the next rung.  The sample only sets how many rounds are needed: results are exact.

Scale: anchors are the stated query set.  They meet all rows in blocks of ``block_anchors``, each broadcast alone (64 dimensions: 16 MB) and released
after its pass over the rows; no row is shuffled.  A task sends at most ``wanted`` rows a list and batch, and about as many as the rung lets through.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; shorter vectors count as padded with zeros; components beyond
+-2^20 after scaling count as that bound; a null id is never an anchor and comes last among ties; rows that share an id are rows of their own; other columns are
ignored; without anchors or rows the result is empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.util import prepare, stage

SCALE = 256
BOUND = 1 << 20
GROUP = 8
PAIRS = 1 << 22
NO_ID = (1 << 63) - 1
FLOOR = -(1 << 62)
LADDER = "array<struct<list:int,low:long,high:long,rungs:array<long>>>"


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """A column of integer vectors as rows of ``dims`` doubles, shorter ones padded."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), dims))
    at = np.repeat(np.arange(len(col)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Index:
    """An inverted index of a block of anchors: dimension by dimension the anchors that need it, with what the rest can add at most."""

    def __init__(self, vectors: np.ndarray, thresholds: np.ndarray, row_norm: float):
        dims = vectors.shape[1]
        self.dims = np.argsort(-(vectors**2).sum(0), kind="stable")
        v = vectors[:, self.dims]
        tails = np.sqrt(np.cumsum((v**2)[:, ::-1], 1)[:, ::-1])
        self.cuts = [*range(0, dims, GROUP), dims]
        ends = np.array(self.cuts)
        rest = np.concatenate([tails, np.zeros((len(v), 1))], 1)[:, ends]
        may_skip = rest * row_norm < thresholds[:, None]
        may_skip[:, -1] = True
        self.depth = ends[np.argmax(may_skip, 1)]
        self.order = np.argsort(-self.depth, kind="stable")
        kind = np.float32 if (np.sqrt((v**2).sum(1)).max(initial=0) * row_norm) < (1 << 24) else np.float64
        self.kind = kind
        self.v = np.ascontiguousarray(v[self.order], kind)
        self.depth = self.depth[self.order]
        self.rest = rest[np.arange(len(v)), np.searchsorted(ends, self.depth[np.argsort(self.order)])][self.order]
        self.thresholds = thresholds[self.order]

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(anchor, row, score)`` of all pairs that reach the anchor's threshold."""
        x = np.ascontiguousarray(rows[:, self.dims], self.kind)
        part = np.zeros((len(self.v), len(x)), self.kind)
        tails = np.sqrt(np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], 1)[:, ::-1])
        tails = np.concatenate([tails, np.zeros((len(x), 1))], 1)
        for a, b in zip(self.cuts, self.cuts[1:]):
            n = int(np.searchsorted(-self.depth, -a))  # anchors indexed beyond a stand first
            if n:
                part[:n] += self.v[:n, a:b] @ x[:, a:b].T
        anchors, hits = [], []
        for d in np.unique(self.depth):
            lo, hi = int(np.searchsorted(-self.depth, -d, "left")), int(np.searchsorted(-self.depth, -d, "right"))
            bound = self.thresholds[lo:hi, None] - self.rest[lo:hi, None] * tails[None, :, d] - 1e-6
            i, j = np.nonzero(part[lo:hi] >= bound)
            anchors.append(i + lo)
            hits.append(j)
        i = np.concatenate(anchors) if anchors else np.zeros(0, np.int64)
        j = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        score = np.empty(len(i), np.int64)
        for a in range(0, len(i), 1 << 16):
            s = slice(a, a + (1 << 16))
            score[s] = np.rint(np.einsum("ij,ij->i", self.v[i[s]].astype(np.float64), x[j[s]].astype(np.float64)))
        ok = score >= self.thresholds[i]
        return self.order[i[ok]], j[ok], score[ok]


def _first(keys: list[np.ndarray], n: int) -> np.ndarray:
    """Places of the first ``n`` entries of each group of equal ``keys[:2]``, ordered by the rest."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    for k in keys[:2]:
        s = k[order]
        new[1:] &= s[1:] == s[:-1]
    new[1:] = ~new[1:]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < n]


def _pass(block, same: bool, wanted: int, dims: int):
    """For each list of the block's anchors, the best rows of a batch between its rung and its upper bound."""

    def run(batches):
        b = block.value
        index = None
        for batch in batches:
            if index is None:
                index = Index(b["vectors"], b["least"], b["norm"])
            step = max(16, min(2048, PAIRS // max(1, len(b["row"]))))
            for lo in range(0, batch.num_rows, step):
                t = batch.slice(lo, step)
                a, j, score = index.search(_matrix(t.column(2), dims))
                row, label = t.column(0).to_numpy(), t.column(3).to_numpy()
                ids = t.column(1).fill_null(NO_ID).to_numpy()
                ok = (b["label"][a] == label[j]) == same
                ok &= b["row"][a] != row[j]
                a, j, score = a[ok], j[ok], score[ok]
                found = []
                for k in range(b["rung"].shape[1]):
                    on = np.flatnonzero((score >= b["rung"][a, k]) & (score <= b["high"][a, k]))
                    found.append(np.stack([a[on], np.full(len(on), k), -score[on], ids[j[on]], row[j[on]]]))
                f = np.concatenate(found, 1)
                f = f[:, _first(list(f), wanted)]
                if f.shape[1]:
                    yield pa.record_batch([pa.array(b["row"][f[0]]), pa.array(b["list"][f[0], f[1]], pa.int32()), pa.array(-f[2]), pa.array(f[3]), pa.array(f[4])], names=["anchor", "list", "score", "id", "row"])

    return run


def _rungs(sample, same: bool, wanted: int, total: int, dims: int):
    """Adds to each open list of an anchor its falling thresholds, from the scores of the sample."""

    def run(batches):
        s = sample.value
        share = len(s["row"]) / max(total, 1)
        for batch in batches:
            scores = _matrix(batch.column(2), dims) @ s["vectors"].T
            label, row = batch.column(3).to_numpy(), batch.column(0).to_numpy()
            out = []
            for i, lists in enumerate(batch.column(4).to_pylist()):
                fit = ((s["label"] == label[i]) == same) & (s["row"] != row[i])
                own = -np.sort(-scores[i][fit])
                made = []
                for one in lists:
                    seen = own[(own >= one["low"]) & (own <= one["high"])]
                    rungs, at = [], max(1.0, 3 * wanted * share)
                    while at <= len(seen):
                        rungs.append(int(seen[math.ceil(at) - 1]))
                        at *= 8
                    made.append({**one, "rungs": [*dict.fromkeys(r for r in rungs if r > one["low"]), one["low"]]})
                out.append(made)
            kind = pa.list_(pa.struct([("list", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("rungs", pa.list_(pa.int64()))]))
            yield pa.record_batch([*batch.columns[:4], pa.array(out, kind)], names=["row", "id", "v", "label", "lists"])

    return run


def _join(rows: DataFrame, anchors: DataFrame, same: bool, wanted: int, info: dict) -> DataFrame:
    """The first ``wanted`` rows of each list: ``anchor, list, place, score, id, row``.  ``anchors``: row, id, v, label, lists."""
    spark, dims = rows.sparkSession, info["dims"]
    kind = f"row long, id long, v array<int>, label int, lists {LADDER}"
    sample = spark.sparkContext.broadcast(info["sample"])
    todo = stage(anchors.mapInArrow(_rungs(sample, same, wanted, info["rows"], dims), kind).withColumn("lists", F.filter("lists", lambda x: x["low"] <= x["high"])), "rungs")
    sample.unpersist()
    done = []
    while True:
        todo = todo.where(F.size("lists") > 0)
        n = todo.count()
        if not n:
            break
        blocks = -(-n // info["block_anchors"])
        todo = todo.withColumn("__block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        found = []
        for k in range(blocks):
            t = todo.where(F.col("__block") == k).toArrow()
            if not len(t):
                continue
            lists = t.column("lists").to_pylist()
            most = max(len(x) for x in lists)
            fill = lambda f, blank: np.array([[f(y) for y in x] + [blank] * (most - len(x)) for x in lists], np.int64)
            rung = fill(lambda y: y["rungs"][0], NO_ID)
            block = spark.sparkContext.broadcast(
                {
                    "row": t.column("row").to_numpy(), "label": t.column("label").to_numpy(), "vectors": _matrix(t.column("v"), dims).astype(np.int32),
                    "rung": rung, "high": fill(lambda y: y["high"], FLOOR), "list": fill(lambda y: y["list"], -1), "least": rung.min(1), "norm": info["norm"],
                }
            )
            got = rows.mapInArrow(_pass(block, same, wanted, dims), "anchor long, list int, score long, id long, row long")
            best = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "id", "row")
            found.append(stage(got.withColumn("place", F.row_number().over(best)).where(F.col("place") <= wanted), "found"))
            block.unpersist()
        got = found[0]
        for more in found[1:]:
            got = got.unionAll(more)
        full = got.groupBy("anchor").agg(F.collect_set(F.when(F.col("place") == wanted, F.col("list"))).alias("full"))
        todo = todo.drop("__block").join(full.withColumnRenamed("anchor", "row"), "row", "left").withColumn("full", F.coalesce("full", F.array().cast("array<int>")))
        ends = lambda x: F.array_contains(F.col("full"), x["list"]) | (F.size(x["rungs"]) == 1)
        todo = stage(todo.withColumn("ended", F.transform(F.filter("lists", ends), lambda x: x["list"])), "ended")
        done.append(got.join(todo.select(F.col("row").alias("anchor"), "ended"), "anchor").where(F.array_contains("ended", F.col("list"))).drop("ended"))
        down = lambda x: F.struct(x["list"].alias("list"), x["low"].alias("low"), x["high"].alias("high"), F.slice(x["rungs"], F.lit(2), F.size(x["rungs"])).alias("rungs"))
        rest = F.transform(F.filter("lists", lambda x: ~F.array_contains(F.col("ended"), x["list"])), down)
        todo = todo.select("row", "id", "v", "label", rest.alias("lists"))
    if not done:
        return spark.createDataFrame([], "anchor long, list int, score long, id long, row long, place int")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def _sample(rows: DataFrame, total: int, dims: int, size: int) -> dict:
    """About ``size`` rows by the hash of their number."""
    t = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(size / total * (1 << 30))).toArrow() if total else rows.toArrow()
    return {"row": t.column("row").to_numpy(), "label": t.column("label").to_numpy(), "vectors": _matrix(t.column("v"), dims)}


def mine(vectors: DataFrame, is_anchor=None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_anchors: int = 1 << 16, sample_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label=None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: the first ``negatives`` rows of another label whose score
    is ``low`` to ``high`` percent of the positive's, for each of the first ``positives`` rows of the anchor's label.

    ``sample_rows``: rows that thresholds are estimated from; by default 16 times the root of all, 2,048 at least, 131,072 at most."""
    spark = prepare(vectors.sparkSession)
    label = F.col("label") if label is None else label
    is_anchor = F.col("id") % 100 == 0 if is_anchor is None else is_anchor
    whole = lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(x.cast("double") * SCALE))).cast("int")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), label.cast("int").alias("label")).where("v IS NOT NULL AND label IS NOT NULL")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.coalesce(F.forall("v", sound), F.lit(False)))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("v", whole).alias("v"), "label"), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, dims, norm = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.sqrt(F.max(squares))).first()
    info = {"rows": total, "dims": dims or 0, "norm": norm or 0.0, "block_anchors": block_anchors}
    info["sample"] = _sample(rows, total, info["dims"], min(total, sample_rows or max(2048, 16 * math.isqrt(total)), 1 << 17))
    anchors = rows.where(is_anchor)
    every = F.array(F.struct(F.lit(0).alias("list"), F.lit(FLOOR).alias("low"), F.lit(-FLOOR).alias("high"), F.array().cast("array<long>").alias("rungs"))).cast(LADDER)
    good = stage(_join(rows, anchors.withColumn("lists", every), True, positives, info), "positives")
    windows = good.groupBy("anchor").agg(
        F.collect_list(
            F.struct(
                F.col("place").cast("int").alias("list"), F.ceil(F.col("score") * F.lit(low) / F.lit(100)).cast("long").alias("low"),
                F.floor(F.col("score") * F.lit(high) / F.lit(100)).cast("long").alias("high"), F.array().cast("array<long>").alias("rungs"),
            )
        ).cast(LADDER).alias("lists")
    )
    bad = _join(rows, anchors.join(windows.withColumnRenamed("anchor", "row"), "row").select("row", "id", "v", "label", "lists"), False, negatives, info)
    pairs = good.select("anchor", F.col("place").cast("int").alias("list"), F.col("id").alias("pid"), F.col("score").alias("positive_score"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = bad.withColumnRenamed("score", "negative_score").join(pairs, ["anchor", "list"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", known("pid").alias("positive_id"), F.col("place").cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", "negative_score")
