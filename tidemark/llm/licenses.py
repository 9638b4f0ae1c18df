"""License scan: phrases, and an exact containment join of text blocks with templates.

DataFrame functions only. A template is a set of words. A block (a stretch of up
to 64 words of a text, or of twice the longest template; line breaks are no borders,
as notices are wrapped) matches if it holds at least ``THRESHOLD`` of them. Words
of all templates are ordered by how many texts of the corpus have them, rarest
first. A block with c of a template's n words has one of its first n - c + 1 words
in that order, so only these are indexed. A block looks its words up in the index;
an entry becomes a candidate if the block has c template words at all (length),
and if from that word on both sides still have c words in the order (position:
the first word they share always passes).
Candidates are verified by the intersection itself.

One word can be all that tells two licences apart. So a template can have words that
must be there, whatever share of the others is, and of two templates that match in one
block the narrower one can stand for both.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Words of a block at least; blocks start every half block.
BLOCK = 64
#: Templates are part of the query's expressions, so their number is bounded.
MOST_TEMPLATES = 500

#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Fixed wordings of well-known license notices, by label.
TEMPLATES = {
    "agpl-3.0": "licensed under the gnu affero general public license version 3",
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under cc by 4.0 creative commons attribution",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by sa 4.0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: Words without which a template does not match.
MUST = {"agpl-3.0": "affero", "cc-by-nc-4.0": "cc nc", "cc-by-sa-4.0": "cc sa", "gpl-3.0": "gnu general", "lgpl": "lesser", "mit-notice": "mit", "mpl-2.0": "mozilla"}
#: Templates that are meant where they match in the same block as the one named first.
NARROWER = {"cc-by-4.0": "cc-by-nc-4.0 cc-by-sa-4.0", "gpl-3.0": "agpl-3.0 lgpl", "gpl-notice": "agpl-3.0 lgpl"}

FOUND = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")


@dataclass(frozen=True)
class Template:
    """``words`` distinct, rarest first; ``need`` of them with all of ``must`` make a match, unless one of ``narrower`` does."""

    label: str
    words: tuple[str, ...]
    need: int
    must: tuple[str, ...] = ()
    narrower: tuple[str, ...] = ()

    @property
    def indexed(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def template_words(text: str) -> list[str]:
    """Distinct words, A-Z in lower case as in texts."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return list(dict.fromkeys(re.findall(WORD, lowered)))


def template_table(templates: dict[str, str] | DataFrame) -> dict[str, str]:
    """Templates by label; of a (label, text) table at most ``MOST_TEMPLATES`` rows, more are an error."""
    if isinstance(templates, dict):
        return templates
    rows = templates.select("label", "text").where("label is not null and text is not null").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES or len({r.label for r in rows}) < len(rows):
        raise ValueError(f"templates are at most {MOST_TEMPLATES} rows, of different labels")
    return {r.label: r.text for r in rows if template_words(r.text)}


def rules_of(templates: dict[str, str] | DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """``MUST`` and ``NARROWER`` for the templates they are about; own templates have none."""
    return (MUST, NARROWER) if templates is TEMPLATES else ({}, {})


def words_of(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def ordered_templates(docs: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[list[Template], list[str]]:
    """Templates, and all words of templates and phrases, in order of the number of texts that have them.

    Every text counts. What comes to the driver is one number for each template word.
    """
    must, narrower = rules_of(templates)
    vocabulary = sorted({w for t in [*templates.values(), *PHRASES, *must.values()] for w in template_words(t)})
    has = F.array_intersect(F.lit(vocabulary), words_of(lower_ascii(text_col)))
    counts = {r[0]: r[1] for r in docs.select(F.explode(has).alias("w")).groupBy("w").count().collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    out = []
    for label, text in sorted(templates.items()):
        words = sorted(template_words(text), key=order.index)
        need = math.ceil(threshold * len(words) - 1e-9)
        out.append(Template(label, tuple(words), need, tuple(template_words(must.get(label, ""))), tuple(narrower.get(label, "").split())))
    return out, order


def _structs(rows: list[dict]) -> Column:
    """A literal array of structs."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])


def block_words(templates: dict[str, str]) -> int:
    """Words of a block, so that the words of any template can lie in one wherever they start."""
    return max(BLOCK, 2 * max((len(template_words(t)) for t in templates.values()), default=0))


def blocks_of(words: Column, block: int = BLOCK) -> Column:
    """Overlapping stretches of words; no stretch of half a block and one word is missed."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1 - block // 2, F.lit(0)), F.lit(block // 2))
    return F.transform(starts, lambda at: F.slice(words, at + 1, block))


def template_matches(words: Column, templates: list[Template], order: list[str], block: int = BLOCK) -> Column:
    """array<struct<label, share>>: every matching (block, template), with the share of its words found."""
    vocabulary = F.lit(order)
    index = _structs([
        {"word": w, "label": t.label, "left": len(t.words) - i, "need": t.need}
        for t in templates for i, w in enumerate(t.indexed)
    ])
    known = F.create_map(*[x for t in templates for x in (F.lit(t.label), F.lit(list(t.words)))])
    needs = F.create_map(*[x for t in templates for x in (F.lit(t.label), F.lit(t.need))])
    none = F.lit([]).cast("array<string>")

    def listed(of: dict[str, tuple[str, ...]]) -> Column:
        pairs = [x for label, words in of.items() if words for x in (F.lit(label), F.lit(list(words)))]
        return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,array<string>>")

    must, narrower = listed({t.label: t.must for t in templates}), listed({t.label: t.narrower for t in templates})
    indexed = F.lit(sorted({w for t in templates for w in t.indexed}))

    def verified(block: Column) -> Column:
        def possible(entry: Column) -> Column:
            after = F.size(block) - F.array_position(block, entry["word"]) + 1
            enough = (F.size(block) >= entry["need"]) & (F.least(entry["left"], after) >= entry["need"])
            return F.array_contains(block, entry["word"]) & enough

        labels = F.array_distinct(F.transform(F.filter(index, possible), lambda e: e["label"]))
        shares = F.transform(
            labels,
            lambda x: F.struct(
                x.alias("label"), (F.size(F.array_intersect(known[x], block)) / F.size(known[x])).alias("share"), F.size(known[x]).alias("n")
            ),
        )
        alike = F.filter(shares, lambda s: s["share"] * s["n"] + 1e-9 >= needs[s["label"]])
        whole = F.filter(alike, lambda s: F.size(F.array_except(F.coalesce(must[s["label"]], none), block)) == 0)
        labels = F.transform(whole, lambda s: s["label"])
        return F.filter(whole, lambda s: ~F.arrays_overlap(F.coalesce(narrower[s["label"]], none), labels))

    kept = F.transform(blocks_of(words, block), lambda b: F.array_intersect(vocabulary, b))
    probing = F.filter(kept, lambda b: F.arrays_overlap(b, indexed))
    return F.flatten(F.transform(probing, verified))


def _phrase_columns(joined: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    """Places, first and last start, and labels; ``joined`` has each word between two spaces of its own."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        key = F.lit("".join(f" {w} " for w in words))
        count = ((F.length(joined) - F.length(F.replace(joined, key, F.lit("")))) / F.length(key)).cast("bigint")

        def words_in(part: Column) -> Column:
            return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("bigint")

        there = count > 0
        counts.append(count)
        firsts.append(F.when(there, words_in(F.substring_index(joined, "".join(f" {w} " for w in words), 1))))
        lasts.append(F.when(there, n - len(words) - words_in(F.substring_index(joined, "".join(f" {w} " for w in words), -1))))
        labels.append(F.when(there, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total, F.least(*firsts), F.greatest(*lasts), F.array_compact(F.array(*labels))


def scan(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | DataFrame = TEMPLATES) -> DataFrame:
    """``docs`` with the columns of ``FOUND``.

    ``templates`` are wordings by label, or a (label, text) table of at most
    ``MOST_TEMPLATES`` rows. Null and empty texts have no words, no labels and score 0.
    ``score`` is 1 where a phrase stands and else the best share of a matching
    template. ``blocks`` lists the matches. Columns of ``docs`` with these names are
    replaced, others stay whatever their names. Rows are independent of each other but for the order of template words,
    on which no result depends.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"a threshold is over 0 and at most 1: {threshold}")
    wordings = template_table(templates)
    block = block_words(wordings)
    found_templates, order = ordered_templates(docs, text_col, wordings, threshold)
    lowered = F.col("_lowered")
    n = F.col("_n")
    # The indexed words and the rarest of each phrase: texts without any of them need no second look.
    joined = F.col("_joined")
    probe = sorted({w for t in found_templates for w in t.indexed} | {min(p.split(), key=order.index) for p in PHRASES})
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in FOUND]
    marked = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_row"), lower_ascii(text_col).alias("_lowered")).withColumn("_words", words_of(lowered))
    marked = marked.withColumn("_n", F.size("_words").cast("bigint")).withColumn("_look", F.arrays_overlap("_words", F.lit(probe)))
    marked = marked.withColumn("_joined", F.when(F.col("_look"), F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" "))).otherwise(F.lit("")))
    count, first, last, labels = _phrase_columns(joined, n)
    found = F.expr("cast(array() as array<struct<label: string, share: double, n: int>>)")
    if found_templates:
        found = F.when(F.col("_look"), template_matches(F.col("_words"), found_templates, order, block)).otherwise(found)
    marked = marked.withColumn("blocks", found).withColumn("_base", labels)
    every = F.array_union("_base", F.transform("blocks", lambda b: b["label"]))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))
    out = (
        marked.withColumn("n_words", n)
        .withColumn("n_base", count)
        .withColumn("first_word", first)
        .withColumn("last_word", last)
        .withColumn("base_labels", F.array_join(F.array_sort("_base"), ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_distinct(every)), ","))
        .withColumn("score", F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(best))
    )
    return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in FOUND], *FOUND)


def oracle(table: str = "documents") -> str:
    """The same result by brute force: every block against every template."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(
        f"({template_words(t)!r}, '{label}', {math.ceil(THRESHOLD * len(template_words(t)) - 1e-9)}, CAST({template_words(MUST.get(label, ''))!r} AS VARCHAR[]), "
        f"CAST({NARROWER.get(label, '').split()!r} AS VARCHAR[]))"
        for label, t in TEMPLATES.items()
    )
    word, block = WORD.replace("'", "''"), block_words(TEMPLATES)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, {lowered} AS t FROM {table}),
        w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM d),
        p(phrase, label) AS (VALUES {phrases}),
        hits AS (
          SELECT k, label, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1 : i + len(phrase)] = phrase)) AS pos
          FROM w, p WHERE len(ws) > 0
        ),
        base AS (
          SELECT k, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS labels FROM hits GROUP BY k
        ),
        blocks AS (
          SELECT k, pos, ws[pos + 1 : pos + {block}] AS b
          FROM (SELECT k, ws, unnest(range(0, greatest(len(ws) - {1 + block // 2}, 0) + 1, {block // 2})) AS pos FROM w WHERE len(ws) > 0)
        ),
        t(words, label, need, must, narrower) AS (VALUES {templates}),
        alike AS (
          SELECT k, pos, label, narrower, c / n AS share FROM (
            SELECT k, pos, label, need, narrower, len(words) AS n, len(list_intersect(words, b)) AS c, len(must) - len(list_intersect(must, b)) AS missing FROM blocks, t
          ) WHERE c >= need AND missing = 0
        ),
        met AS (SELECT k, pos, list(label) AS labels FROM alike GROUP BY k, pos),
        m AS (SELECT k, label, max(share) AS share FROM alike JOIN met USING (k, pos) WHERE len(list_intersect(narrower, labels)) = 0 GROUP BY k, label),
        method AS (SELECT k, list(label) AS labels, max(share) AS share FROM m GROUP BY k)
        SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
               array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ',') AS labels,
               CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(method.share, 0.0) END::DOUBLE AS score
        FROM w LEFT JOIN base USING (k) LEFT JOIN method USING (k)
    """
