"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text, its white space runs made one space, is cut where its own characters say so (after a
sentence mark, or after a space behind one of a few letters), so equal passages give equal
chunks wherever they stand.  Each chunk's 64-bit hash becomes its identifier once the SHA-256
of all chunks with that hash agree; a hash that stands for two contents is replaced by the
SHA-256 itself.  Documents are then compared by their ordered identifier lists: whole texts
are never shuffled, a recipe is a few bytes a chunk.

Defined cases: a null text is empty; equal texts form one group whatever their ids; the
smallest id stays; a null id stays only in a group without any id; rows that repeat an id and
a text all get the same answer (``kept`` where the id is the group's smallest); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.util import join_groups, prepare, stage

SPACES = "[\\x20\\x09-\\x0D]+"
MIN_CHUNK, MAX_CHUNK = 96, 2048
LISTED = 10_000


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    """A lazy run that ends at the first content-defined cut, else a run of the largest size."""
    return f"(?s).{{{least},{most}}}?(?:(?<=[.!?]\\x20)|(?<=[dglmv]\\x20))|.{{1,{most}}}"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    prepare(docs.sparkSession)
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    texts = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    cut = texts.select("doc_id", "norm", F.regexp_extract_all("norm", F.lit(pattern or chunk_pattern()), F.lit(0)).alias("chunks"))

    chunks = cut.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("key"), F.sha2("chunk", 256).alias("sha"))
    shared = chunks.groupBy("key").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).where("lo <> hi")
    twice = [r.key for r in shared.select("key").limit(LISTED + 1).collect()]

    def name(c):
        key = F.xxhash64(c)
        if not twice:
            return key
        if len(twice) > LISTED:
            return F.sha2(c, 256)
        return F.when(key.isin(twice), F.sha2(c, 256)).otherwise(key.cast("string"))

    rows = stage(cut.select("doc_id", F.transform("chunks", name).alias("recipe"), F.sha2("norm", 256).alias("text_sha256")), "recipes")
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    out = join_groups(rows, groups, ["recipe"], "group_size", rows.count())
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
