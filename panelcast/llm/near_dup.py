"""MinHash near-dedup: signatures, banding, signature and exact verification, connected components.

1. Each text becomes its set of distinct word n-grams (64-bit hashes) and ``BANDS * ROWS`` minima of universal
   hashes ``(a x + b) mod 2^32``, a odd.
2. Equal sets are one class, kept by its smallest id; only class representatives go on, so thousands of
   copies cost one row.
3. Representatives that share a band meet in a bucket, around one member picked by hash.  Each is compared with the
   ``LEADERS`` first of the members its buckets stand around; a pair is a candidate when its signatures agree in enough
   places, and a link only after both full sets were compared.
4. Links become components by alternating large-star and small-star.
5. In buckets that still hold more than one component, the members outside the largest one are compared, in blocks, with all
   others; candidates between components are compared exactly there and then, each in the first band it shares, and only
   links that connect something leave the block.

So no pair that shares a band is left unexamined unless it is already connected, and no group's pairs are
all written out.  At the similarity threshold 0.8 a pair shares no band with probability (1 - 0.8^5)^40 = 1.3e-7.

Scale: texts of candidates only are written once to the shared folder for the exact check; a hot centre's or a hot
class's rows are joined by broadcast of its one row (their number is bounded) or split by the skew join.

Defined cases: a text without words has an empty set and no links; with fewer words than ``n`` the whole sequence is one
shingle; rows that repeat an id and text get the same answer, and of an id with several texts each row joins the class of its own
text while links are checked on the text that sorts first; a row without id joins the class of its set and stays only if that class
has no id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.util import join_groups, prepare, stage, tidy

BANDS, ROWS = 40, 5
LEADERS = 3
SLACK = 0.12
BLOCK = 256

_K = BANDS * ROWS
_A = np.array([W.splitmix(9000 + i) & 0xFFFFFFFF | 1 for i in range(_K)], np.uint32)[:, None]
_B = np.array([W.splitmix(19000 + i) & 0xFFFFFFFF for i in range(_K)], np.uint32)[:, None]


def minima(x: np.ndarray) -> np.ndarray:
    """The signature of a set of 64-bit hashes: the low 16 bits of the minima of its universal hashes."""
    low = x.astype(np.uint32)[None, :]
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    for at in range(0, low.shape[1], 1024):
        v = _A * low[:, at : at + 1024]
        v += _B
        np.minimum(out, v.min(axis=1), out=out)
    return (out & np.uint32(0xFFFF)).astype(np.uint16)


def _sign(n: int):
    def run(batches):
        for batch in batches:
            for lo, hi in W.groups(batch.column(1)):
                h, first = W.hash_words(*W.buffers(batch.column(1).slice(lo, hi - lo)))
                count, one, two, sig = [], [], [], []
                for i in range(hi - lo):
                    s = np.unique(W.shingles(h[first[i] : first[i + 1]], n))
                    count.append(len(s))
                    one.append(int(W.mix(s).sum(dtype=np.uint64)) if len(s) else 0)
                    two.append(int(W.mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)) if len(s) else 0)
                    sig.append(minima(s).tobytes() if len(s) else None)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), pa.array(sig, pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "sig"],
                )

    return run


def _keys(batch) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of a batch (rep, sig, ...) and the row each belongs to."""
    sig = np.stack([np.frombuffer(b, np.uint16) for b in batch.column(1).to_pylist()]).astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.zeros(sig.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return key.reshape(-1).view(np.int64), np.repeat(np.arange(len(batch)), BANDS)


def _bands(batches):
    for batch in batches:
        for at in range(0, len(batch), 5000):
            part = batch.slice(at, 5000)
            key, row = _keys(part)
            yield pa.record_batch([pa.array(key), pa.array(part.column(0).to_numpy()[row])], names=["band", "rep"])


def _bands_of(batches):
    for batch in batches:
        for at in range(0, len(batch), 5000):
            part = batch.slice(at, 5000)
            key, row = _keys(part)
            no = np.tile(np.arange(BANDS, dtype=np.int32), len(part))
            yield pa.record_batch([pa.array(key), pa.array(no), pa.array(part.column(0).to_numpy()[row]), pa.array(part.column(2).to_numpy()[row])], names=["band", "no", "rep", "comp"])


def _agree(batches):
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        est = [float((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).mean()) for x, y in zip(a, b)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(est, pa.float64())], names=["a", "b", "est"])


def _exact(n: int, percent: int):
    def run(batches):
        last, sa = None, None
        for batch in batches:
            keep = []
            for i in range(len(batch)):  # two texts at a time
                a = batch.column(0)[i].as_py()
                if a != last:
                    last, sa = a, _set(batch.column(2).slice(i, 1), n)
                keep.append(_linked(sa, _set(batch.column(3).slice(i, 1), n), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _set(text: pa.Array, n: int) -> np.ndarray:
    """The shingle set of an array of one text."""
    h, _ = W.hash_words(*W.buffers(text))
    return np.unique(W.shingles(h, n))


def _block_links(least: float, n: int, percent: int):
    """A block of queries against a block of rows: every pair from different components whose first shared band
    is this bucket's and whose signatures agree enough is compared exactly, unless links found in the block connect it."""

    def run(table: pa.Table) -> pa.Table:
        rep, comp, query, no = (table.column(c).to_numpy() for c in ("rep", "comp", "query", "no"))
        sig = np.stack([np.frombuffer(b, np.uint16) for b in table.column("sig").to_pylist()])
        text, sets, root, out = table.column("text"), {}, {}, []

        def of(i):
            if rep[i] not in sets:
                sets[rep[i]] = _set(text.slice(int(i), 1), n)
            return sets[rep[i]]

        def top(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        rows = np.flatnonzero(~query)
        for i in np.flatnonzero(query):
            others = rows[comp[rows] != comp[i]]
            if not len(others):
                continue
            same = sig[others] == sig[i]
            est = same.mean(axis=1)
            ok = (est >= least) & (same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == no[i])
            others, est = others[ok], est[ok]
            for j in others[np.lexsort((rep[others], -est))]:
                x, y = top(comp[i]), top(comp[j])
                if x != y and _linked(of(i), of(j), percent):
                    root[max(x, y)] = min(x, y)
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of the nodes of ``edges`` (a, b): comp is the smallest node reachable (which has no row itself).

    Alternates large-star and small-star; each round is written to the shared folder, and the rounds end when the set of
    edges no longer changes.
    """
    mark = None
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("v", "m").unionAll(down.select(F.col("u").alias("v"), "m"))
        e = stage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        mark = tuple(now)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, class_id``.

    Links documents whose sets have ``100 * |A & B| >= percent * |A | B|``."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(texts.mapInArrow(tidy(_sign(n)), "doc_id long, n long, h1 long, h2 long, sig binary"), "signatures")
    slim = signed.select("doc_id", "n", "h1", "h2")
    total = slim.count()
    classes = stage(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "sig")).alias("x"), F.count(F.lit(1)).alias("size")).select("h1", "h2", "size", F.col("x.doc_id").alias("rep"), F.col("x.sig").alias("sig")), "classes")
    sigs = classes.select("rep", "sig")

    least = max(0.0, percent / 100 - SLACK)
    band = stage(sigs.mapInArrow(tidy(_bands), "band long, rep long"), "bands")
    centre = band.groupBy("band").agg(F.min_by("rep", F.xxhash64("rep")).alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = join_groups(band, centre, ["band"], "m", BANDS * total).where("a IS NOT NULL AND a <> rep")
    around = F.array_sort(F.collect_set(F.struct(F.xxhash64("a").alias("h"), "a")))
    met = stage(met.groupBy("rep").agg(around.alias("x")).select("rep", "x.a"), "met")
    star = met.select("rep", F.explode(F.slice("a", 1, LEADERS)).alias("a")).select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    source = _texts_of(texts, met.select(F.explode(F.concat(F.array("rep"), "a")).alias("doc_id")))
    pairs = stage(_estimate(star, sigs, least), "pairs")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b")
    known = stage(_verify(best, source, n, percent), "links")
    comp = components(known)
    rest = stage(_across(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), comp), "rest")
    more = stage(_verify(rest, source, n, percent), "links")
    if not more.isEmpty():
        known = known.unionAll(more)
        comp = components(known)

    # What the stars cannot see: members of one bucket in different components.
    of = sigs.join(comp, sigs["rep"] == comp["node"], "left").select("rep", "sig", F.coalesce("comp", "rep").alias("comp"))
    open_ = stage(_open_buckets(of.mapInArrow(tidy(_bands_of), "band long, no int, rep long, comp long"), BANDS * total, block), "open")
    crossing = _deal(open_).join(sigs.hint("merge"), "rep").join(source.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")
    more = stage(crossing.groupBy("band", "i", "j").applyInArrow(_block_links(least, n, percent), "a long, b long").distinct(), "links")
    if not more.isEmpty():
        comp = components(known.unionAll(more))

    named = classes.join(comp, classes["rep"] == comp["node"], "left").select("h1", "h2", "size", F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("component"))
    out = join_groups(slim, named, ["h1", "h2"], "size", max(1, total))
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of these documents, written once; of an id that repeats, the text that sorts first."""
    return stage(texts.where("doc_id IS NOT NULL").join(ids.distinct().hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")


def _open_buckets(placed: DataFrame, total: int, block: int) -> DataFrame:
    """The rows (band, rep, comp) of buckets with several components.  Members outside a bucket's largest component
    are queries against all its rows; ``blocks`` and ``asks`` say how many blocks of rows and of queries it is cut into."""
    sizes = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("band").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("k"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    rows = join_groups(placed, mixed, ["band"], "m", total).where("main IS NOT NULL")
    return rows.select("band", "no", "rep", "comp", (F.col("comp") != F.col("main")).alias("query"), F.ceil(F.col("m") / block).alias("blocks"), F.ceil((F.col("m") - F.col("k")) / block).alias("asks"))


def _deal(open_: DataFrame) -> DataFrame:
    """Each bucket's rows and queries dealt to the cells (i, j): row block i, query block j."""
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    rows = open_.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("j", every("asks")).withColumn("query", F.lit(False))
    asks = open_.where("query").withColumn("j", F.pmod(F.xxhash64("rep"), F.col("asks"))).withColumn("i", every("blocks"))
    cols = ["band", "no", "i", "j", "rep", "comp", "query"]
    return rows.select(*cols).unionAll(asks.select(*cols))


def _estimate(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    x, y = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    both = pairs.join(y.hint("merge"), "b").join(x.hint("merge"), "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(tidy(_agree), "a long, b long, est double").where(F.col("est") >= least)


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those pairs whose ends are not connected yet."""
    x, y = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    x, y = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(y.hint("merge"), "b").join(x.hint("merge"), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(tidy(_exact(n, percent)), "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept, unchanged (rows without id stay where their class has none)."""
    got = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = got.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
