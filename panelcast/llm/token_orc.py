"""Token-ID output: ORC files in ascending id order, and their reader.

Texts are encoded whole, the end id is appended, and each document is one row
``doc_id, part, before, n_tokens, ids``.  Rows are range-partitioned and sorted by id, so a stripe's
statistics cover a narrow id range; ORC stores the ids with its integer run-length encoding, keeps a row
index every ``row_stride`` rows and Bloom filters on ``doc_id`` (and ``part``).  Readers split files by stripe and prune
stripes and row groups by these.

A document's ``start`` (ids of all documents before it) is its place within its part plus the sum of
the parts before; parts are the partitions that wrote, so the table of their sums is as long as the
number of files and is broadcast.

Encoding: byte-level BPE never joins a character with what stands before the single space in front of it, and its pattern takes letters, digits, marks
and line ends apart, so a text is cut there (only where a character is surely of its kind), each different piece is encoded once by the library and
remembered (about ``2 * MEMO`` pieces a worker, over its tasks; the older half goes first).  The ids equal those of the whole text.  For tokenizers with
another pattern texts are cut at single spaces only.
A special token's name in a text gets that token's id, as the library's ``encode(text, add_special_tokens=False)`` gives it;
``special_as_text`` encodes it like other text.  Where a special token takes white space along, texts are encoded whole.

Defined cases: a null or empty text has the end id only; repeated ids follow each other, in the order of
their texts, each with its own start; null ids come first; an empty table writes an empty file and reads back as no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.util import give_back, prepare, scratch_path

MEMO = 150_000
ENCODE_BYTES = 4 << 20
JOINED = 500
_state: dict = {}

# Classes of characters, by their first byte.  What may be white space is WHITE, what is surely none is OTHER; LETTER and so on are surely of their kind.
WHITE, SPACE, LINE, OTHER, LETTER, DIGIT, MARK = range(7)
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe: 's, 're, ... are words of their own


def _classes(marks: str) -> np.ndarray:
    of = np.full(256, OTHER, np.uint8)
    of[:33] = of[127] = of[[0xC2, 0xE1, 0xE2, 0xE3]] = WHITE
    of[ord(" ")], of[ord("\n")] = SPACE, LINE
    of[ord("0") : ord("9") + 1] = DIGIT
    of[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
    of[[*range(0xC3, 0xCA), 0xD0, 0xD1, *range(0xE5, 0xE9), 0xEB, 0xEC]] = LETTER  # Latin but for two signs, Cyrillic, Han, Hangul
    of[list(marks.encode())] = MARK
    return of


def _cuts(runs: bool) -> np.ndarray:
    """By the classes of two neighbours: 1 to cut between them, 2 to cut if no white space follows, 3 if none stands before them."""
    of = np.zeros((8, 8), np.uint8)
    of[OTHER:, SPACE] = 2
    if runs:
        of[OTHER:, LINE] = 1
        of[LINE, OTHER:] = 3
        of[LETTER:, LETTER:] = 1 - np.eye(8 - LETTER, dtype=np.uint8)
    return np.resize(of, 256)


def _pieces(data: np.ndarray, off: np.ndarray, classes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts begin."""
    kind = np.zeros(len(data) + 2, np.uint8)  # two of WHITE at the end
    kind[:-2] = np.frombuffer(data.tobytes().translate(classes.tobytes()), np.uint8)
    sign = np.flatnonzero(data[:-1] == 0xC3)
    kind[sign[(data[sign + 1] | 0x20) == 0xB7]] = OTHER  # the signs for times and by
    later = np.flatnonzero((data & 0xC0) == 0x80)
    for _ in range(3):
        kind[later] = kind[later - 1]
    begin = np.zeros(len(data) + 2, bool)
    begin[off] = True
    pair = (kind[:-2] << 3) | kind[1:-1]
    cut = np.frombuffer(pair.tobytes().translate(cuts.tobytes()), np.uint8)  # between i and i + 1
    at = np.flatnonzero(cut == 1) + 1
    space = np.flatnonzero(cut == 2) + 1
    space = space[(kind[space + 1] >= OTHER) & ~begin[space + 1]]
    line = np.flatnonzero(cut == 3) + 1
    line = line[(line > 1) & (kind[line - 2] >= OTHER) & ~begin[line - 1]]
    for some in (at, space, line):
        begin[some] = True
    return np.flatnonzero(begin[: len(data)])


def _cutting(path: str) -> tuple[np.ndarray, np.ndarray]:
    """How to cut for a tokenizer: at its runs if it is a byte-level BPE that encodes letters, digits, marks and line ends apart, else at spaces."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    pre, model, added = conf.get("pre_tokenizer") or {}, conf["model"], conf.get("added_tokens", [])
    runs = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not conf.get("normalizer") and model.get("type") == "BPE"
    runs = runs and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and not any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word"))
    classes, cuts = _classes("".join(c for c in MARKS if not any(c in a["content"] for a in added))), _cuts(runs)
    for name in [np.frombuffer(a["content"].encode(), np.uint8) for a in added]:  # found by the library before it cuts
        if len(name) and (len(_pieces(name, np.array([0, len(name)]), classes, cuts)) > 1 or min(classes[name[[0, -1]]]) < OTHER):
            return classes, _cuts(False)
    return classes, cuts


def _load(path: str, special_as_text: bool):
    if _state.get("path") != (path, special_as_text):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker a core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = special_as_text
        added = tok.get_added_tokens_decoder().values()
        whole = not special_as_text and any(a.lstrip or a.rstrip or a.single_word or any(map(str.isspace, a.content)) for a in added)
        begins = np.zeros(tok.get_vocab_size(), bool)
        begins[[i for w, i in tok.get_vocab().items() if w.startswith("\u0120")]] = True  # tokens that begin with a space
        _state.update(path=(path, special_as_text), tok=tok, memo={}, old={}, begins=begins, whole=whole, cutting=_cutting(path))
    return _state["tok"]


def _ids(encodings) -> list[bytes]:
    return [np.asarray(e.ids, np.uint32).tobytes() for e in encodings]


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids and how many each string has."""
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _learn(tok, pieces: list[str], memo: dict) -> None:
    """Encode new pieces; those that begin with their only space, ``JOINED`` in one string: so do their ids."""
    one = [p for p in pieces if p[0] != " " or " " in p[1:]]
    memo.update(zip(one, _ids(tok.encode_batch_fast(one, add_special_tokens=False))))
    words = [p for p in pieces if p not in memo]
    parts = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
    for at in range(0, len(parts), 64):
        for some, e in zip(parts[at : at + 64], tok.encode_batch_fast(["".join(p) for p in parts[at : at + 64]], add_special_tokens=False)):
            ids = np.asarray(e.ids, np.uint32)
            first = np.flatnonzero(_state["begins"][ids])
            if len(first) != len(some):
                memo.update(zip(some, _ids(tok.encode_batch_fast(some, add_special_tokens=False))))
                continue
            raw, cuts = ids.tobytes(), [*(first * 4).tolist(), len(ids) * 4]
            memo.update((p, raw[x:y]) for p, x, y in zip(some, cuts, cuts[1:]))


def _piece_ids(tok, pieces: list[str]) -> list[bytes]:
    """The ids of different pieces, from the memory as far as it has them."""
    if len(_state["memo"]) > MEMO:
        _state.update(memo={}, old=_state["memo"])
    memo, old = _state["memo"], _state["old"]
    memo.update((p, old[p]) for p in pieces if p in old)
    _learn(tok, [p for p in pieces if p not in memo], memo)
    return list(map(memo.__getitem__, pieces))


def encode_column(col: pa.Array, path: str, special_as_text: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and how many each text has; the same as encoding each text whole.  ``special_as_text`` is the
    library's ``encode_special_tokens``."""
    tok = _load(path, special_as_text)
    data, off = W.buffers(col)
    data, off = data[off[0] : off[-1]], off - off[0]
    if _state["whole"] or not len(data):
        return _joined(_ids(tok.encode_batch_fast([t or "" for t in col.to_pylist()], add_special_tokens=False)))
    begin = _pieces(data, off, *_state["cutting"])
    ends = pa.py_buffer(np.append(begin, len(data)).astype(np.int32))
    coded = pa.StringArray.from_buffers(len(begin), ends, pa.py_buffer(data)).dictionary_encode()
    blob, n = _joined(_piece_ids(tok, coded.dictionary.to_pylist()))
    which = coded.indices.to_numpy()
    start, n = (np.cumsum(n) - n)[which], n[which]
    before = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat((start - before[:-1]).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return blob[at], np.diff(before[np.searchsorted(begin, off)])


def encode(texts: list[str], path: str, special_as_text: bool = True) -> list[bytes]:
    """Each text's ids as little-endian 32-bit integers."""
    ids, n = encode_column(pa.array(texts, pa.string()), path, special_as_text)
    ends = np.cumsum(n)
    return [ids[a:b].tobytes() for a, b in zip(ends - n, ends)]


def _encoder(path: str, end_id: int, special_as_text: bool):
    end = np.uint32(end_id)

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in W.groups(batch.column(1), ENCODE_BYTES):
                ids, n = encode_column(batch.column(1).slice(lo, hi - lo), path, special_as_text)
                flat = pa.array(np.insert(ids, np.cumsum(n), end).astype(np.int32))
                bounds = np.concatenate([[0], np.cumsum(n + 1)])
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(before + bounds[:-1]), pa.array(n + 1), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(bounds[-1])
        give_back()  # a worker lives on after its task; its pieces stay for the next one

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, row_stride: int = 2000, stripe_bytes: int = 16 << 20, special_as_text: bool = False) -> str:
    """Encode ``docs`` into ORC files under ``out`` and return that path."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    coded = placed.mapInArrow(_encoder(tokenizer, end_id, special_as_text), "doc_id long, part int, before long, n_tokens long, ids array<int>")
    (
        coded.write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_stride)
        .option("orc.bloom.filter.columns", "doc_id,part")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(out)
    )
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of files that :func:`write_tokens` wrote."""
    rows = spark.read.schema("doc_id long, part int, before long, n_tokens long, ids array<int>").orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    start, table = 0, []
    for r in sums:  # one row per written file
        table.append((r["part"], start))
        start += r["n"]
    parts = spark.createDataFrame(table, "part int, base long")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def _digest(batches):
    for batch in batches:
        ids = batch.column(3)
        flat = np.asarray(ids.values, np.int32).astype("<u4")
        bounds = ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows from :func:`read_tokens`."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write to the shared scratch folder, read back, digest."""
    spark = prepare(docs.sparkSession)
    return digest(read_tokens(spark, write_tokens(docs, scratch_path(spark, "tokens"), tokenizer, **options)))
