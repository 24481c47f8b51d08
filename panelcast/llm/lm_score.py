"""LM scoring with a weighted backoff automaton of smoothed word n-grams.

Tokens are the words of a text (A-Z as a-z) and one end.  Counts cover every training text and every n-gram up to ``order``; none is left out.

* **Smoothing.**  ``p(w | h) = (1 - b) c(hw) / c(h) + b p(w | h')``, ``h'`` being ``h`` without its first word and ``b`` the share that a history of its length hands
  down (``BACK``).  Words have ``(1 - u) c(w) / N``, any unknown word ``u``: the share of training tokens that occur once.
* **Automaton.**  States are the histories seen in training: the empty one, words, pairs and so on up to ``order - 1`` words.  An n-gram ``hw`` is an arc
  from ``h`` with weight ``log p(w | h)`` to the longest end of ``hw`` that is a state.  A state without an arc for the next word takes its failure arc to ``h'`` of
  weight ``log b``; the empty history has an arc for every word.
* **Traversal.**  A text is read once from left to right with one state, adding the weights of the arcs taken.  As a state depends on the last
  ``order - 1`` words only, long texts are cut into lanes of ``LANE`` tokens, each read up to its place from ``order - 1`` tokens before; all lanes of
  a unit take their steps together.

Scale: texts are dealt to units of some megabytes, written in buckets by unit, so that they never shuffle.  A unit sends each of its distinct n-grams once, with its count in training texts, as packed blocks of sorted
hashes, one a range of hashes; a range's task adds up the counts of all units and answers each block in its own order (so without hashes).  With
the answers the unit builds the part of the automaton that its texts can reach.  A frequent n-gram has one entry a unit; nothing is
collected but three sums.  The answers grow with the corpus, the automaton of a unit does not.

Defined cases: a null or empty text is the end alone; without training text all scores are 0; repeated rows and ids get a row each; a null id
counts as the empty string in the fold; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.util import give_back, prepare, stage
from panelcast.plans.panel import work_table

END = np.uint64(W.splitmix(31337))
ORDER = 3
BACK = (0.6, 0.45)  # handed down by histories of one word, of two words (and longer)
UNIT_BYTES = 6 << 20
RANGE_BYTES = 8 << 20
MOST_BUCKETS = 8192
LANE = 256


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 7 == 2


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a string column, each text's words followed by the end, and their offsets."""
    h, first = W.hash_words(*W.buffers(col))
    n = len(first) - 1
    out = np.empty(len(h) + n, np.uint64)
    ends = first[1:] + np.arange(n)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = h
    return out, first + np.arange(n + 1)


def _grams(t: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the n-grams inside the texts and the place of their last word."""
    g = t if n == 1 else W.ngrams(t, n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: len(g)] == text[n - 1 : n - 1 + len(g)])
    return g[at], at + n - 1


# --- packed blocks


def pack(sorted_keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: the first one, then the differences, each as its ``k`` low bits (whole bytes, then the bits over) and the rest in
    unary.  ``k`` is the number that takes least, about the bits of the mean difference, so the unary parts have about two bits each."""
    d = np.diff(sorted_keys).astype("<u8")
    n = len(d)
    if not n:
        return bytes([0]) + sorted_keys[:1].astype("<u8").tobytes() + np.int64(0).tobytes()
    near = max(1, int(d.sum() // np.uint64(n))).bit_length()
    k = min(range(max(0, near - 2), min(63, near + 1) + 1), key=lambda j: n * j + int((d >> np.uint64(j)).sum()))
    whole, over = divmod(k, 8)
    low = d.view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(low[:, whole : whole + 1], axis=1)[:, 8 - over :]
    ends = np.cumsum((d >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), bool)
    unary[ends - 1] = True
    parts = [low[:, :whole].tobytes(), np.packbits(bits).tobytes(), np.packbits(unary).tobytes()]
    return bytes([k]) + sorted_keys[:1].astype("<u8").tobytes() + np.int64(n).tobytes() + b"".join(parts)


def unpack(blob: bytes) -> np.ndarray:
    k, n = blob[0], int.from_bytes(blob[9:17], "little")
    first = np.frombuffer(blob, "<u8", 1, offset=1)
    if not n:
        return first.copy()
    whole, over = divmod(k, 8)
    at = 17 + n * whole
    low = np.zeros((n, 8), np.uint8)
    low[:, :whole] = np.frombuffer(blob, np.uint8, n * whole, offset=17).reshape(n, whole)
    if over:
        bits = np.zeros((n, 8), np.uint8)
        size = -(-n * over // 8)
        bits[:, 8 - over :] = np.unpackbits(np.frombuffer(blob, np.uint8, size, offset=at), count=n * over).reshape(n, over)
        low[:, whole] = np.packbits(bits, axis=1).ravel()
        at += size
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=at)))
    high = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    return np.cumsum(np.concatenate([first, (high << np.uint64(k)) | low.view("<u8").ravel()]), dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    """Counts: a bit for each that is 1, one byte for each other; those from 255 on besides in eight; all that compressed."""
    one = c == 1
    c = c[~one]
    big = c >= 255
    raw = np.packbits(one).tobytes() + np.where(big, 255, c).astype(np.uint8).tobytes() + c[big].astype("<i8").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    blob = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    bits = -(-n // 8)
    c = np.unpackbits(np.frombuffer(blob, np.uint8, bits), count=n).astype(np.int64)
    other = np.flatnonzero(c == 0)
    v = np.frombuffer(blob, np.uint8, len(other), offset=bits).astype(np.int64)
    v[v == 255] = np.frombuffer(blob, "<i8", offset=bits + len(other))
    c[other] = v
    return c


def _cut_points(u: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins in the sorted ``u``."""
    bounds = [min(-(-(k << 64) // ranges), (1 << 64) - 1) for k in range(ranges)]
    return np.append(np.searchsorted(u, np.array(bounds, np.uint64)), len(u))


# --- counting


def _deal(batches):
    """Rows as units of about ``UNIT_BYTES`` of text, one a row."""
    from pyspark import TaskContext

    unit = TaskContext.get().partitionId() << 32
    held, size = [], 0

    def row():
        t = pa.Table.from_batches(held).combine_chunks()
        wrap = lambda name: pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(name).combine_chunks())
        return pa.record_batch([pa.array([unit]), pa.array([size]), wrap("doc_id"), wrap("train"), wrap("text")], names=["unit", "size", "doc_id", "train", "text"])

    for batch in batches:
        for lo, hi in W.groups(batch.column(2), UNIT_BYTES // 8):
            _, o = W.buffers(batch.column(2).slice(lo, hi - lo))
            more = int(o[-1] - o[0]) + hi - lo
            if held and size + more > UNIT_BYTES:
                yield row()
                unit, held, size = unit + 1, [], 0
            held.append(batch.slice(lo, hi - lo))
            size += more
    if held:
        yield row()


UNIT = "unit long, size long, doc_id array<long>, train array<boolean>, text array<string>"


def _blocks(order: int, ranges: int):
    """A unit's distinct n-grams and their counts in its training texts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                unit = batch.column(0)[i].as_py()
                t, first = _tokens(batch.column(2)[i].values)
                train = np.repeat(batch.column(1)[i].values.to_numpy(zero_copy_only=False), np.diff(first))
                for n in range(1, order + 1):
                    g, last = _grams(t, first, n)
                    u, which = np.unique(g, return_inverse=True)
                    c = np.bincount(which, train[last], len(u)).astype(np.int64)
                    at = _cut_points(u, ranges)
                    for k in range(ranges):
                        a, b = at[k], at[k + 1]
                        if a < b:
                            yield pa.record_batch([pa.array([(n - 1) * ranges + k], pa.int32()), pa.array([unit]), pa.array([pack(u[a:b])], pa.binary()), pa.array([pack_counts(c[a:b])], pa.binary())], names=["part", "unit", "keys", "counts"])
                del t, first, train
            give_back()

    return run


def _add_up(t: pa.Table) -> pa.Table:
    """The totals of a range, for each block in its own order; the first row also has their sum, how many are not 0 and how many are 1."""
    keys = [unpack(b) for b in t.column("keys").to_pylist()]
    counts = [unpack_counts(b, len(k)) for b, k in zip(t.column("counts").to_pylist(), keys)]
    ends = np.cumsum([len(k) for k in keys])
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(which, np.concatenate(counts)).astype(np.int64)
    out = [pack_counts(totals[which[e - len(k) : e]]) for e, k in zip(ends, keys)]
    first = np.arange(len(out)) == 0
    facts = {"mass": totals.sum(), "types": (totals > 0).sum(), "ones": (totals == 1).sum()}
    got = pa.table([t.column("part"), t.column("unit"), pa.array([len(k) for k in keys]), pa.array(out, pa.binary()), *[pa.array(np.where(first, v, 0)) for v in facts.values()]], names=["part", "unit", "n", "totals", *facts])
    del keys, counts, which, totals
    give_back()
    return got


# --- the automaton


class Automaton:
    """The states and arcs that some texts can reach.

    State 0 is the empty history; then come the words, pairs, ... of the texts.  ``arcs`` are sorted numbers ``state * words + word``.
    ``totals``: the counts of the texts' distinct words, then of their pairs, ..., each in the order of their hashes."""

    def __init__(self, t: np.ndarray, first: np.ndarray, order: int, totals: np.ndarray, mass: int, ones: int):
        gram, at = [], []  # per order: which n-gram ends at each token, and one place of each
        for n in range(1, order + 1):
            g, last = _grams(t, first, n)
            _, one, which = np.unique(g, return_index=True, return_inverse=True)
            ends = np.full(len(t), -1, np.int32)
            ends[last] = which
            gram.append(ends)
            at.append(last[one].astype(np.int32))
        counts, totals = totals, []
        for a in at:
            totals.append(counts[: len(a)])
            counts = counts[len(a) :]
        self.word = gram[0]
        self.words = len(at[0])
        base = np.cumsum([1] + [len(a) for a in at])  # the first state of each order
        c = totals[0]
        unknown = (ones + 1) / (mass + 2)
        p = [np.where(c > 0, (1 - unknown) * c / max(mass, 1), unknown)]
        self.root_weight, self.root_next = np.log10(p[0]), np.where(c > 0, base[0] + np.arange(len(c)), 0)
        self.fail_weight, self.fail_next = [np.zeros(1)], [np.zeros(1, np.int64)]
        keys, weights, nexts = [], [], []
        for n in range(2, order + 1):
            history, end = gram[n - 2][at[n - 1] - 1], gram[n - 2][at[n - 1]]
            seen = totals[n - 2][history]
            back = BACK[min(n - 2, len(BACK) - 1)]
            p.append((1 - back) * totals[n - 1] / np.maximum(seen, 1) + back * p[n - 2][end])
            self.fail_weight.append(np.full(len(at[n - 2]), np.log10(back)))
            self.fail_next.append(np.zeros(len(at[0]), np.int64) if n == 2 else base[n - 3] + gram[n - 3][at[n - 2]])
            on = np.flatnonzero(totals[n - 1] > 0)
            keys.append((base[n - 2] + history[on].astype(np.int64)) * self.words + self.word[at[n - 1][on]])
            weights.append(np.log10(p[n - 1][on]))
            nexts.append(base[n - 1] + on if n < order else base[n - 2] + end[on])
        self.fail_weight, self.fail_next = np.concatenate(self.fail_weight), np.concatenate(self.fail_next)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        by_key = np.argsort(keys, kind="stable")
        self.arcs = np.append(keys[by_key], np.iinfo(np.int64).max)
        self.weight, self.next = (np.concatenate(x)[by_key] if x else np.zeros(0) for x in (weights, nexts))
        self.order, self.first, self.counts = order, first, c

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after ``word`` and the weights of the arcs taken, failure arcs included."""
        gain, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo, now = np.arange(len(state)), state
        while len(todo):
            at_root = now == 0
            done = todo[at_root]
            gain[done] += self.root_weight[word[done]]
            after[done] = self.root_next[word[done]]
            todo, now = todo[~at_root], now[~at_root]
            key = now * self.words + word[todo]
            arc = np.searchsorted(self.arcs, key)
            hit = self.arcs[arc] == key
            gain[todo[hit]] += self.weight[arc[hit]]
            after[todo[hit]] = self.next[arc[hit]]
            todo, now = todo[~hit], now[~hit]
            gain[todo] += self.fail_weight[now]
            now = self.fail_next[now]
        return after, gain

    def scores(self) -> np.ndarray:
        """The log10 probability of each text: all lanes walk from left to right, each with its state."""
        sizes = np.diff(self.first)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = self.first[text] + nth * LANE
        end = np.minimum(begin + LANE, self.first[text + 1])
        warm = np.minimum(nth * LANE, self.order - 1)
        by_size = np.argsort(-(end - begin + warm), kind="stable")
        start, left, skip = (begin - warm)[by_size], (end - begin + warm)[by_size], warm[by_size]
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start))
        for k in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -k))  # lanes longer than k stand first
            state[:n], gain = self.step(state[:n], self.word[start[:n] + k])
            total[:n] += np.where(skip[:n] <= k, gain, 0.0)
        sums = np.empty(len(total))
        sums[by_size] = total
        return np.add.reduceat(sums, np.cumsum(lanes) - lanes) if len(sums) else sums


def _score(order: int, mass: int, types: int, ones: int):
    def run(unit: pa.Table, answers: pa.Table) -> pa.Table:
        t, first = _tokens(unit.column("text").combine_chunks().flatten())
        rows = sorted(zip(answers.column("part").to_pylist(), answers.column("n").to_pylist(), answers.column("totals").to_pylist()))
        got = np.concatenate([unpack_counts(b, n) for _, n, b in rows])
        auto = Automaton(t, first, order, got, mass, ones)
        c = auto.counts
        score = auto.scores() if mass else np.zeros(len(first) - 1)
        known, base = (c > 0)[auto.word], np.log10((c + 1.0) / (mass + types + 1))[auto.word]
        sums = lambda x: pa.array(np.add.reduceat(x, first[:-1]))
        out = pa.table(
            [unit.column("doc_id").combine_chunks().flatten(), pa.array(np.diff(first)), sums(known.astype(np.int64)), sums(base), pa.array(score)],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )
        del auto, got, t, known, base, c
        give_back()
        return out

    return run


def _bucketed(df: DataFrame, by: str, n: int) -> DataFrame:
    """``df`` written as a table in ``n`` buckets: what is keyed alike meets it without a shuffle of its rows."""
    spark = df.sparkSession
    name = work_table(spark, "units")
    df.write.option("compression", "zstd").bucketBy(n, by).saveAsTable(name)
    return spark.table(name)


def score(docs: DataFrame, is_training, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``; the model learns from the rows where
    ``is_training`` holds."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(is_training, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = _bucketed(rows.mapInArrow(_deal, UNIT), "unit", min(MOST_BUCKETS, max(1, -(-size // UNIT_BYTES))))
    ranges = max(1, -(-size // RANGE_BYTES))
    blocks = units.select("unit", "train", "text").mapInArrow(_blocks(order, ranges), "part int, unit long, keys binary, counts binary")
    blocks = blocks.repartition(order * ranges, "part")
    answers = stage(blocks.groupBy("part").applyInArrow(_add_up, "part int, unit long, n long, totals binary, mass long, types long, ones long"), "answers")
    mass, types, ones = (int(x or 0) for x in answers.where(F.col("part") < ranges).agg(F.sum("mass"), F.sum("types"), F.sum("ones")).first())
    out = units.groupBy("unit").cogroup(answers.select("unit", "part", "n", "totals").groupBy("unit"))
    out = out.applyInArrow(_score(order, mass, types, ones), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(mass).cast("long").alias("train_tokens"), "base_score", "score")
