"""The corpus pipeline: five stages, each over all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from panelcast.llm import decontaminate, mixing, near_dup, quality_cnn, token_orc
from panelcast.llm.queries import table, tokenizer_path
from panelcast.llm.util import prepare, stage


def quality(spark, docs, sf_dir):
    """Documents that the classifier takes for label 1."""
    return quality_cnn.keep_good(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group (five-word shingles, similarity 0.8)."""
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark, docs, sf_dir):
    """Each document as often as its source's weight asks for."""
    return mixing.mix(docs)


def tokens(spark, docs, sf_dir):
    """Token ids in ORC; returns the digest read back from the files."""
    return token_orc.token_output(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mix),
    ("token-ID output", tokens),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
