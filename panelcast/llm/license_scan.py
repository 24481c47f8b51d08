"""License scans: exact set-similarity join of text blocks with license templates (DataFrame functions only).

Blocks are windows of ``2 * span`` words every ``span`` words, ``span`` being the longest
template, so any run of words no longer than a template lies whole in a block.  A block
matches a template when it holds at least ``threshold`` of the template's distinct words.
Every match is found: tokens are ordered by their frequency in the whole corpus, rarest
first; a block can only match if it holds one of the template's ``|T| - a + 1`` rarest words
(prefix), has ``a`` template words at all (length), and the first common word leaves enough
words behind it on both sides (positions), ``a`` being the needed overlap.  What is left is
counted exactly.  Words that no template has can never match and stay out of the order.

The templates are a short list given as a parameter; blocks are probed row by row, so the
corpus is never shuffled: one scan counts the template words, one scan matches.

Base phrases are templates that need all their words; a found block then gives the places
where the words stand consecutively, each place counted by the one block that owns it.

Defined cases: a null or empty text has no words, empty labels, score 0; repeated rows and
null ids give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.util import lower_ascii

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases whose places are reported, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening words of public license notices, with their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution license": "cc-notice",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
THRESHOLD = 0.8


def _needed(words: list[str], threshold: float) -> int:
    return max(1, math.ceil(round(threshold * len(words), 9)))


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, matches`` (matches: template label, word offset of the block, containment)."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    sets = [(label, sorted(set(t.split())), 0, _needed(sorted(set(t.split())), threshold)) for t, label in templates.items()]
    sets += [(label, sorted(set(p.split())), k + 1, len(set(p.split()))) for k, (p, label) in enumerate(phrases.items())]
    span = max(len(t.split()) for t in [*templates, *phrases])
    vocabulary = sorted({w for _, ws, _, _ in sets for w in ws})

    text = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.col(text_col)).alias("low"))
    words = text.select("doc_id", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("words"))

    # One number per template word: the answer is no larger than the templates.
    found = words.select(F.explode(F.filter("words", lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count().collect()
    count = {r["w"]: r["count"] for r in found}
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    index, prefix = [], set()
    for label, ws, kind, need in sets:
        ranks = sorted(rank[w] for w in ws)
        rare = ranks[: len(ranks) - need + 1]
        prefix.update(order[r - 1] for r in rare)
        index.append(F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.lit(need).alias("need"), _ints(ranks).alias("ranks"), _ints(rare).alias("rare")))
    ranked = F.array(*[F.lit(w) for w in order])

    hit = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(sorted(prefix)), i)))
    blocks = words.withColumn("hits", hit).withColumn(
        "numbers", F.filter(F.array_distinct(F.flatten(F.transform("hits", lambda i: F.array(F.floor(i / span), F.floor(i / span) - 1)))), lambda b: b >= 0)
    )

    def block(b: Column) -> Column:
        inside = F.filter(F.slice("words", (b * span + 1).cast("int"), F.lit(2 * span)), lambda w: w.isin(vocabulary))
        return F.struct(b.alias("number"), F.array_sort(F.array_distinct(F.transform(inside, lambda w: F.array_position(ranked, w).cast("int")))).alias("ranks"))

    def may_match(b: Column, t: Column) -> Column:
        have, need = b["ranks"], t["need"]
        common = F.array_intersect(F.slice(have, F.lit(1), F.size(have) - need + 1), t["rare"])
        first = F.element_at(common, 1)
        left = F.least(F.size(have) - F.array_position(have, first), F.size(t["ranks"]) - F.array_position(t["ranks"], first)) + 1
        return F.when(F.size(have) >= need, F.when(F.size(common) > 0, left >= need).otherwise(False)).otherwise(False)

    def overlap(b: Column, t: Column) -> Column:
        return F.size(F.array_intersect(b["ranks"], t["ranks"]))

    def matched(b: Column) -> Column:
        hits = F.filter(F.array(*index), lambda t: F.when(may_match(b, t), overlap(b, t) >= t["need"]).otherwise(False))
        return F.transform(hits, lambda t: F.struct(t["label"].alias("label"), t["kind"].alias("kind"), b["number"].alias("number"), (overlap(b, t) / F.size(t["ranks"])).alias("containment")))

    joined = (
        blocks.withColumn("cut", F.transform("numbers", block))
        .withColumn("found", F.flatten(F.transform("cut", matched)))
        .withColumn("places", F.flatten(F.transform(F.filter("found", lambda m: m["kind"] > 0), lambda m: _places(m, list(phrases.items()), span))))
    )
    own = F.filter("found", lambda m: m["kind"] == 0)
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    all_labels = F.array_sort(F.array_distinct(F.concat(base, F.transform(own, lambda m: m["label"]))))
    best = F.array_max(F.transform(own, lambda m: m["containment"]))
    return joined.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.transform(own, lambda m: F.struct(m["label"].alias("label"), (m["number"] * span).alias("word"), m["containment"].alias("containment"))).alias("matches"),
    )


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(m: Column, phrases: list[tuple[str, str]], span: int) -> Column:
    """The places that block ``m`` owns where its phrase's words stand one after the other."""
    low = m["number"] * span
    starts = F.sequence(low.cast("int"), F.least(low + span, F.size("words")).cast("int") - 1)

    def stands(i: Column) -> Column:
        out = F.lit(False)
        for k, (phrase, _) in enumerate(phrases):
            here = m["kind"] == k + 1
            for j, w in enumerate(phrase.split()):
                here = here & (F.get("words", i + j) == w)
            out = out | F.coalesce(here, F.lit(False))
        return out

    return F.transform(F.filter(starts, stands), lambda i: F.struct(m["label"].alias("label"), i.alias("at")))


def oracle(templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """Brute force in SQL: every block against every template, every place against every phrase."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    span = max(len(t.split()) for t in [*templates, *phrases])
    lists = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {_needed(sorted(set(t.split())), threshold)})" for t, label in templates.items())
    ps = ", ".join(f"('{label}', {p.split()!r})" for p, label in phrases.items())
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
t(label, ws, need) AS (VALUES {lists}), p(label, ws) AS (VALUES {ps}),
b AS (SELECT doc_id, unnest(range(0, len(w), {span})) AS s, w FROM d),
bd AS (SELECT doc_id, s, list_distinct(w[s + 1 : s + {2 * span}]) AS ws FROM b),
m AS (SELECT doc_id, label, len(list_intersect(bd.ws, t.ws)) / len(t.ws) AS c FROM bd, t WHERE len(list_intersect(bd.ws, t.ws)) >= need),
i AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM d),
pl AS (SELECT doc_id, pos, label FROM i, p WHERE w[pos + 1] = ws[1] AND w[pos + 1 : pos + len(ws)] = ws),
ba AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM pl GROUP BY 1),
la AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT doc_id, label FROM pl UNION ALL SELECT doc_id, label FROM m) GROUP BY 1),
sc AS (SELECT doc_id, max(c) AS c FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN ba USING (doc_id) LEFT JOIN la USING (doc_id) LEFT JOIN sc USING (doc_id)"""
