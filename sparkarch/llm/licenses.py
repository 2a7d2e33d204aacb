"""License scan by a positional index of rare words. Only DataFrame functions run here.

Templates are short texts with a key phrase that must be there word for word. A file can hold a template only if it holds every
word of the key phrase. Of those templates, the words of the key phrase that fewest files hold, three at most, are looked up in
the file: each has a list of places, less its own place in the template, and where the lists agree the template would start.
There the key phrase is verified and the rest of the template is matched word by word, weighted by rarity. A word that isn't part
of a key phrase may be missing where a template starts, so those words only weigh.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused, words

#: Phrase and label of the base.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Text of a notice, the phrase in it that must be there, and its label.
NOTICES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "licensed under the apache license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software", "isc"),
)
#: A notice counts from this share of its words' weight.
LEAST_SCORE = 0.8
#: Rare words of a key phrase whose places are intersected.
RARE_WORDS = 3


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def templates(base=BASE, notices=NOTICES) -> list[dict]:
    """All templates: words, place and words of the key phrase, label, and whether it is of the base."""
    out = [{"words": p.split(), "key_at": 0, "key": p.split(), "label": x, "base": True} for p, x in base]
    for text, phrase, label in notices:
        whole, key = text.split(), phrase.split()
        at = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        out.append({"words": whole, "key_at": at, "key": key, "label": label, "base": False})
    return out


def document_frequencies(files: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of files and, for each word of the vocabulary, of files that hold it, over all files. The vocabulary bounds what is collected."""
    held = files.select(F.array_intersect(words(F.col(text)), F.array(*[F.lit(w) for w in vocabulary])).alias("held"))
    rows = held.select(F.explode(F.concat(F.array(F.lit("")), "held")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def weights(n_files: int, counts: dict[str, int], vocabulary: list[str]) -> dict[str, int]:
    """Rarity of each word in thousandths: 1000 times the logarithm of files over files with it, one added to each, and at least 1."""
    return {w: max(1, round(1000 * log((n_files + 1) / (counts.get(w, 0) + 1)))) for w in vocabulary}


def rarest(t: dict, rarity: dict[str, int], rare_words: int = RARE_WORDS) -> list[tuple[str, int]]:
    """Words of the key phrase with their places in the template, those that fewest files hold first, each word once."""
    first = {w: i for i, w in reversed(list(enumerate(t["key"])))}
    return [(w, t["key_at"] + first[w]) for w in sorted(first, key=lambda w: (-rarity[w], first[w]))[:rare_words]]


def scan(files: DataFrame, text: str = "text", base=BASE, notices=NOTICES, least: float = LEAST_SCORE, rare_words: int = RARE_WORDS) -> DataFrame:
    """All columns of ``files``, and ``n_words`` and ``matches``: array of (template, label, base, start, length, score).

    Nothing but the words' file counts is exchanged: each file is matched where it is read, so neither frequent words, hot
    sources nor long texts gather anywhere. A null or empty text has no words and no matches; rows stay as many as they are. Where
    ``files`` has a column ``n_words`` or ``matches``, that stays and the new one has an underscore behind its name.
    """
    found = templates(base, notices)
    vocabulary = sorted({w for t in found for w in t["words"]})
    n_files, counts = document_frequencies(files, vocabulary, text)
    rarity = weights(n_files, counts, vocabulary)
    w, held, known, starts, keyed, n_words, matches = unused(files.columns, "w", "held", "known", "starts", "keyed", "n_words", "matches")
    array = lambda values, kind: f"cast(array({', '.join(map(str, values))}) as array<{kind}>)"
    per = [
        f"struct({n} as t, {array(map(_sql, t['words']), 'string')} as words, {array([rarity[x] for x in t['words']], 'bigint')} as weight, {sum(rarity[x] for x in t['words'])} as total, {t['key_at']} as key_at, {len(t['key'])} as key_words, "
        f"{array(map(_sql, sorted(set(t['key']))), 'string')} as need, array({', '.join(f'struct({_sql(x)} as word, {at} as at)' for x, at in rarest(t, rarity, rare_words))}) as rare, {_sql(t['label'])} as label, {str(t['base']).lower()} as base)"
        for n, t in enumerate(found)
    ]
    needed = F.array(*[F.lit(x) for x in sorted({x for t in found for x in t["key"]})])
    places = lambda x: f"transform(filter(sequence(0, size({w}) - 1), i -> {w}[i] = {x}.word), i -> i - {x}.at)"
    agreed = f"aggregate(slice(t.rare, 2, size(t.rare)), {places('t.rare[0]')}, (a, x) -> array_intersect(a, {places('x')}))"
    possible = f"filter({known}, t -> size(array_except(t.need, {held})) = 0)"
    proposed = f"flatten(transform({possible}, t -> transform({agreed}, s -> struct(t.t as t, s as start))))"
    # out of range places of an array are null, which is no match; the key phrase has to be within the text
    at = f"{known}[s.t]"
    verified = f"filter({starts}, s -> s.start + {at}.key_at >= 0 AND s.start + {at}.key_at + {at}.key_words <= size({w}) AND forall(sequence({at}.key_at, {at}.key_at + {at}.key_words - 1), j -> {w}[s.start + j] = {at}.words[j]))"
    matched = f"aggregate(sequence(0, size({at}.words) - 1), cast(0 as bigint), (a, j) -> a + CASE WHEN s.start + j >= 0 AND s.start + j < size({w}) AND try_element_at({w}, s.start + j + 1) = {at}.words[j] THEN {at}.weight[j] ELSE cast(0 as bigint) END)"
    scored = f"transform({keyed}, s -> struct(s.t as template, {at}.label as label, {at}.base as base, s.start as start, size({at}.words) as length, {matched} / cast({at}.total as double) as score))"
    fewest = min(len(set(t["key"])) for t in found)
    empty = "cast(array() as array<struct<t: int, start: int>>)"
    out = files.withColumn(w, words(files[text])).withColumn(held, F.array_intersect(F.col(w), needed)).withColumn(known, F.expr(f"array({', '.join(per)})"))
    out = out.withColumn(starts, F.expr(f"CASE WHEN size({held}) >= {fewest} THEN {proposed} ELSE {empty} END"))
    out = out.withColumn(keyed, F.expr(f"CASE WHEN size({starts}) > 0 THEN {verified} ELSE {starts} END"))
    return out.select(*[files[c] for c in files.columns], F.size(w).cast("long").alias(n_words), F.expr(f"filter({scored}, m -> m.score >= {least}D)").alias(matches))


def op2_rare_word_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`scan` of all ``documents``, its matches as counts, places and labels; a null text has none, and no labels are an empty string."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("matches", lambda m: m["base"])
    of = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    start = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).cast("long").alias("first_word"), F.array_max(start).cast("long").alias("last_word"),
        of(base).alias("base_labels"), of(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: F.round(m["score"], 6))), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    found = templates()
    quoted = lambda words: "[" + ", ".join(map(_sql, words)) + "]"
    rows = ",\n  ".join(f"({n}, {_sql(t['label'])}, {str(t['base']).lower()}, {t['key_at']}, {quoted(t['key'])}, {quoted(t['words'])})" for n, t in enumerate(found))
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(t, label, base, key_at, key, words) AS (VALUES
  {rows}),
tw AS (SELECT t, unnest(words) AS word, unnest(range(0, len(words))) AS j FROM t),
df AS (SELECT word, count(*) AS k FROM (SELECT unnest(list_distinct(w)) AS word FROM d) WHERE word IN (SELECT word FROM tw) GROUP BY word),
ra AS (SELECT v.word, greatest(1, CAST(round(1000 * ln(((SELECT count(*) FROM d) + 1) / (coalesce(k, 0) + 1))) AS BIGINT)) AS r FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN df ON df.word = v.word),
tot AS (SELECT t, sum(r) AS total FROM tw JOIN ra USING (word) GROUP BY t),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
cand AS (SELECT pos.doc_id, t.t, t.label, t.base, pos.p - t.key_at AS start FROM pos JOIN t ON pos.word = t.key[1] JOIN d ON d.doc_id = pos.doc_id WHERE list_slice(d.w, pos.p + 1, pos.p + len(t.key)) = t.key),
sc AS (SELECT c.doc_id, c.t, c.label, c.base, c.start, sum(CASE WHEN pos.word = tw.word THEN r ELSE 0 END) AS got FROM cand c JOIN tw ON tw.t = c.t JOIN ra ON ra.word = tw.word LEFT JOIN pos ON pos.doc_id = c.doc_id AND pos.p = c.start + tw.j GROUP BY ALL),
m AS (SELECT sc.*, CAST(got AS DOUBLE) / CAST(total AS DOUBLE) AS score FROM sc JOIN tot ON tot.t = sc.t WHERE CAST(got AS DOUBLE) / CAST(total AS DOUBLE) >= {LEAST_SCORE}),
g AS (SELECT doc_id, CAST(count_if(base) AS BIGINT) AS n_base, min(CASE WHEN base THEN start END) AS first_word, max(CASE WHEN base THEN start END) AS last_word,
  string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(round(score, 6)) AS score FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


OP2_SQL = _oracle()
