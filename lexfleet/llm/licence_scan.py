"""Licence scan: named phrases, and an exact set-similarity join with notice templates.

Only column functions are used. Every line of a text (or every run of `span` lines)
is a block, a set of words; a template is a set of words too. A block contains a
template when it holds at least `threshold` of the template's words. With `wrapped`,
windows over the words of the whole text, lines joined, are blocks as well: a window is
as long as the template divided by `threshold`, so a notice that is broken over lines
is found with up to that share of other words inside. Windows begin at a template word
(others hold no more), and only next to a word of the prefix. Words are put
in one global order, rare ones first, by the number of blocks of all documents
that hold them, and the join filters by

* length: a block with fewer template words than the match needs is out;
* prefix: of a template's words in order, a match holds one of the first
  size - needed + 1;
* position: from the first shared word on, both sets must have enough words left;

before the overlap of the survivors is counted. Templates are a bounded dimension
(MAX_TEMPLATES), so they stand in the plan as literals: no row is shuffled for the
join. Only the block counts of template words are aggregated.

Defined cases: null and empty texts have no words, null positions, empty labels and
score 0; repeated rows each give a row; a null id is kept; other columns are not
looked at; an empty table gives an empty table.
"""

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.llm import common

# The phrases that are counted, with their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Usual words of licence notices: (label, words).
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8
MAX_TEMPLATES = 500
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """Words with their case, each between single spaces; '  ' without words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_columns(line: Column, n_words: Column, phrases=PHRASES):
    """Places of each phrase in a spaced text: (label, count, first start, last start)."""
    out = []
    for phrase, label in phrases:
        # the flag folds A-Z only; the look-around leaves the spaces for the next match
        pattern = f"(?i)(?<= ){phrase}(?= )"
        parts = F.split(line, pattern, -1)
        found = line.rlike(pattern)
        size = len(phrase.split())
        out.append((label, F.when(found, F.size(parts) - 1).otherwise(0), F.when(found, _spaces(F.get(parts, F.lit(0))) - 1),
                    F.when(found, n_words - (_spaces(F.element_at(parts, -1)) - 1) - size)))
    return out


def needed(n_words: int, threshold: float) -> int:
    """The fewest shared words that make `threshold` of a template's words."""
    return next(k for k in range(1, n_words + 1) if k / n_words >= threshold)


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.expr("cast(array() as array<string>)")


def scan(df: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD, span=1, id_col="doc_id", text_col="text", wrapped=False) -> DataFrame:
    """One row per row of `df`: id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, and matches (label, containment, line of the first
    block, or else of the first window)."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MAX_TEMPLATES} fit into a plan")
    sets = [(label, sorted(set(words.split())), math.ceil(len(words.split()) / threshold)) for label, words in templates]
    vocabulary = sorted({w for _, ws, _ in sets for w in ws})

    rows = df.select(F.col(id_col), spaced(F.col(text_col)).alias("_line"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("_lines"))
    rows = rows.select("*", F.when(F.col("_line") == "  ", 0).otherwise(_spaces(F.col("_line")) - 1).cast("long").alias("n_words"))
    found = phrase_columns(F.col("_line"), F.col("n_words"), phrases)
    # blocks keep only template words; which words those are never changes a match
    blocks = F.transform(F.col("_lines"), lambda x, i: F.struct(i.alias("line"), F.array_intersect(F.split(F.lower(F.regexp_replace(x, NOT_WORD, " ")), " "), _strings(vocabulary)).alias("words")))
    base = rows.select(
        id_col, "n_words",
        sum((n for _, n, _, _ in found), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(a for _, _, a, _ in found)).cast("long").alias("first_word"),
        F.greatest(*(b for _, _, _, b in found)).cast("long").alias("last_word"),
        F.array_distinct(F.array_sort(F.filter(F.array(*(F.when(n > 0, label) for label, n, _, _ in found)), lambda x: x.isNotNull()))).alias("_base"),
        F.filter(_windows(blocks, span), lambda b: F.size(b["words"]) > 0).alias("_blocks"), *(["_lines"] if wrapped else []))
    if wrapped:
        base = base.withColumn("_words", _words(sets, vocabulary, threshold)).drop("_lines")
    base = common.staged(base)

    # the global order covers all blocks; one row per template word comes back
    counted = base.select(F.explode("_blocks.words").alias("words")).select(F.explode("words").alias("word")).groupBy("word").count().collect()
    frequency = {r["word"]: r["count"] for r in counted}
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}

    ordered = F.transform(F.col("_blocks"), lambda b: F.struct(b["line"].alias("line"), F.array_intersect(_strings(order), b["words"]).alias("words")))
    least = min((needed(len(ws), threshold) for _, ws, _ in sets), default=1)
    out = base.withColumn("_sets", F.filter(ordered, lambda b: F.size(b["words"]) >= least))
    found = [_match(label, sorted(words, key=place.get), threshold, length if wrapped else None) for label, words, length in sets]
    empty = F.expr("cast(array() as array<struct<label:string,containment:double,line:int>>)")
    possible = (F.size("_sets") > 0) | (F.size("_words") > 0) if wrapped else F.size("_sets") > 0
    some = F.when(possible, F.filter(F.array(*found), lambda m: m.isNotNull())).otherwise(empty) if found else empty
    out = out.select("*", some.alias("matches"))
    # places without a template count as much as the weakest match
    score = F.greatest(F.coalesce(F.array_max("matches.containment"), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(float(threshold))).otherwise(0.0))
    return out.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.col("matches.label"))), ",").alias("labels"), score.alias("score"), "matches")


def _words(sets, vocabulary, threshold: float) -> Column:
    """Template words of the whole text with place and line; empty if the text has
    too few different ones for every template."""
    held = F.array_distinct(F.flatten("_blocks.words"))
    enough = [F.size(F.array_intersect(_strings(ws), held)) >= needed(len(ws), threshold) for _, ws, _ in sets]
    each = F.flatten(F.transform("_lines", lambda x, i: F.transform(F.filter(F.split(F.lower(F.regexp_replace(x, NOT_WORD, " ")), " "), lambda w: w != ""), lambda w: F.struct(i.alias("line"), w.alias("word")))))
    placed = F.filter(F.transform(each, lambda e, i: F.struct(i.alias("place"), e["line"].alias("line"), e["word"].alias("word"))), lambda e: e["word"].isin(vocabulary))
    return F.when(reduce(or_, enough, F.lit(False)), placed).otherwise(F.expr("cast(array() as array<struct<place:int,line:int,word:string>>)"))


def _match(label: str, words: list, threshold: float, length=None) -> Column:
    """The best block of column _sets, or window of `length` words of column _words, for
    one template, null without any."""
    size, need = len(words), needed(len(words), threshold)
    whole, prefix = _strings(words), _strings(words[: size - need + 1])

    def passes(b):
        shared = F.get(F.array_intersect(prefix, b["words"]), F.lit(0))
        left = F.least(size - F.array_position(whole, shared), F.size(b["words"]) - F.array_position(b["words"], shared))
        return (F.size(b["words"]) >= need) & F.arrays_overlap(prefix, b["words"]) & (left + 1 >= need) & (F.size(F.array_intersect(whole, b["words"])) >= need)

    hits = F.filter(F.col("_sets"), passes)
    if length is not None:
        hits = F.concat(hits, F.when(F.size(F.array_intersect(whole, F.col("_words.word"))) >= need, _wrapped(words, need, length)).otherwise(F.expr("cast(array() as array<struct<line:int,words:array<string>>>)")))
    best = F.array_max(F.transform(hits, lambda b: F.size(F.array_intersect(whole, b["words"])) / F.lit(size)))
    return F.when(F.size(hits) > 0, F.struct(F.lit(label).alias("label"), best.alias("containment"), F.get(hits, F.lit(0))["line"].alias("line")))


def _wrapped(words: list, need: int, length: int) -> Column:
    """Windows of `length` words of the text that hold `need` words of one template."""
    prefix, whole = words[: len(words) - need + 1], _strings(words)
    own = F.filter("_words", lambda e: e["word"].isin(words))

    def around(own):
        # a match has a word of the prefix and enough others less than a window away
        seeds = F.filter(F.transform(own, lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda s: s["e"]["word"].isin(prefix))

        def near(s):
            low = F.greatest(s["i"] - length + 1, F.lit(0))
            return F.filter(F.slice(own, low + 1, s["i"] - low + length), lambda e: F.abs(e["place"] - s["e"]["place"]) < length)

        hoods = F.filter(F.transform(seeds, near), lambda h: F.size(F.array_intersect(whole, h["word"])) >= need)
        return F.flatten(F.transform(hoods, inside))

    def inside(hood):
        runs = F.transform(hood, lambda e, i: F.struct(e["line"].alias("line"), F.array_intersect(whole, F.transform(F.filter(F.slice(hood, i + 1, F.lit(length)), lambda x: x["place"] < e["place"] + length), lambda x: x["word"])).alias("words")))
        return F.filter(runs, lambda r: F.size(r["words"]) >= need)

    return F.get(F.transform(F.array(own), around), F.lit(0))


def _windows(blocks: Column, span: int) -> Column:
    """Runs of `span` lines as one block each, from every line on."""
    if span == 1:
        return blocks
    return F.transform(blocks, lambda b, i: F.struct(b["line"].alias("line"), F.array_distinct(F.flatten(F.transform(F.slice(blocks, i + 1, F.lit(span)), lambda x: x["words"]))).alias("words")))


def oracle(templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD) -> str:
    """DuckDB SQL for scan() over `documents`: every line against every template."""
    rows = ", ".join(f"('{label}', list_sort(list_distinct(string_split('{words}', ' '))))" for label, words in templates)
    named = ", ".join(f"('{phrase}', '{label}')" for phrase, label in phrases)
    return f"""
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), words as (
  select doc_id, text, list_filter(regexp_split_to_array(text, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as ws from d
), phrases(phrase, label) as (values {named}
), places as (
  select doc_id, label, unnest(list_filter(range(len(ws)), lambda i: list_slice(ws, i + 1, i + len(string_split(phrase, ' '))) = string_split(phrase, ' '))) as place
  from words, phrases where contains(text, string_split(phrase, ' ')[1])
), base as (
  select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list_sort(list(distinct label)) as labels from places group by doc_id
), templates(label, ts) as (values {rows}
), lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line from d
), blocks as (
  select doc_id, list_distinct(regexp_split_to_array(line, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as bs from lines
), joined as (
  select doc_id, label, len(list_intersect(ts, bs)) / len(ts) as containment from blocks, templates
), method as (
  select doc_id, list_sort(list(distinct label)) as labels, max(containment) as best from joined where containment >= {threshold} group by doc_id
)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(b.labels, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') as labels,
  greatest(coalesce(best, 0), case when n_base > 0 then {threshold} else 0 end)::double as score
from words w left join base b using (doc_id) left join method m using (doc_id)
"""
