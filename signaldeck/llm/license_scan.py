"""Licence scan with a positional index of rare licence words.

How many documents hold each word of the licence templates is counted over all documents,
one row per word and task.  The index holds, for each template, the positions of its words
with the highest IDF.  A text looks up the index words it holds; the postings are
intersected by relative position: a place where enough of a template's rare words stand as
far apart as in the template is a candidate.  There, the mandatory phrases of the template
have to stand word for word.  Templates are a parameter; everything sent to the tasks is
bounded by them.  No text is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signaldeck.llm.common import chunks, narrow, tidied

#: Words of a template in the index: the rarer half, at most so many.
RARE = 8
#: Mandatory phrases may stand so many words outside of the template's place.
SLACK = 10
#: Share of a template's words that have to stand at their places.
MIN_SHARE = 0.5
#: Score of a text in which only a base phrase stands.
BASE_SCORE = 0.5

#: Phrases whose every place counts, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
_FOLD = bytes(b if b >= 0x80 or b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def fold_words(text: bytes) -> list[bytes]:
    """Words of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Each has to stand in the text.
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[bytes]:
        return fold_words(self.text.encode())


#: Openings of public licences and the short forms that refer to them.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("except in compliance with the license", "apache org licenses license 2 0"),
    ),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    Template(
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version",
        ("free software you can redistribute it", "general public license as published by the free software foundation"),
    ),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template(
        "creative-commons",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution", "international license"),
    ),
)


def document_frequency(docs: DataFrame, vocabulary: set[bytes], text_column: str) -> dict[bytes, int]:
    """How many rows hold each word of the vocabulary, for those that any holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for _, texts in chunks(batch, text_column):
                for text in texts:
                    seen.update(vocabulary.intersection(fold_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    counts = narrow(docs, text_column).mapInArrow(tidied(run), "word binary, n bigint")
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per word


class RareWordIndex:
    """Postings of the rare words of all templates."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[bytes, int]) -> None:
        self._templates = [(t.label, t.words, [b" %s " % b" ".join(fold_words(p.encode())) for p in t.phrases]) for t in templates]
        self._rare: list[dict[bytes, np.ndarray]] = []
        for _, words, _ in self._templates:
            known = sorted({w for w in words if w in frequency}, key=lambda w: (frequency[w], w))
            rare = known[: min(RARE, -(-len(words) // 2))]
            self._rare.append({w: np.array([q for q, x in enumerate(words) if x == w]) for w in rare})
        self._words = {w for rare in self._rare for w in rare}

    def matches(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """Label, first word and share of words in place of each verified place, in no order."""
        here = self._words.intersection(words)
        wanted = [(t, own) for t, rare in enumerate(self._rare) if len(own := here & rare.keys()) >= self._enough(rare)]
        if not wanted:
            return []
        places: dict[bytes, list[int]] = {w: [] for _, own in wanted for w in own}
        for p, word in enumerate(words):
            if word in places:
                places[word].append(p)
        out = []
        for t, own in wanted:
            label, text, phrases = self._templates[t]
            rare = self._rare[t]
            # Each word says once for every start of the template that it would fit.
            starts = [np.unique(np.subtract.outer(np.array(places[w]), rare[w])) for w in own]
            start, agree = np.unique(np.concatenate(starts), return_counts=True)
            for s in start[agree >= self._enough(rare)].tolist():
                around = b" %s " % b" ".join(words[max(s - SLACK, 0) : max(s + len(text) + SLACK, 0)])
                if all(p in around for p in phrases):
                    share = sum(0 <= s + q < len(words) and words[s + q] == w for q, w in enumerate(text)) / len(text)
                    if share >= MIN_SHARE:
                        out.append((label, s, share))
        return out

    @staticmethod
    def _enough(rare: dict) -> int:
        return max(2, -(-len(rare) // 2))


def phrase_starts(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively; its longest word is looked for."""
    at = max(range(len(phrase)), key=lambda i: len(phrase[i]))
    out, p = [], at - 1
    try:
        while True:
            p = words.index(phrase[at], p + 1)
            if words[p - at : p - at + len(phrase)] == phrase:
                out.append(p - at)
    except ValueError:
        return out


def scan_licences(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: dict[str, str] = BASE_PHRASES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Id, n_words and ``found`` of every row: label, base, start (first word) and share of each place.

    A base place is one of ``phrases`` (share 1); the others are verified places of
    templates, whose start lies before the text where its first words are cut off.  A null
    or empty text has no words and no places.  Texts of any length are scanned whole.  Rows
    that repeat an id, or have none, are scanned one by one, and each counts in the word
    frequencies.  An empty table gives no rows.  Other columns are ignored, whatever their
    names.
    """
    vocabulary = {w for t in templates for w in t.words}
    frequency = document_frequency(docs, vocabulary, text_column)
    wanted = [(label, fold_words(p.encode())) for p, label in phrases.items()]
    kind = docs.schema[id_column].dataType.simpleString()
    place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareWordIndex(templates, frequency)
        for batch in batches:
            for rows, texts in chunks(batch, text_column):
                sizes, found = [], []
                for text in texts:
                    words = fold_words(text)
                    sizes.append(len(words))
                    own = [(label, True, s, 1.0) for label, phrase in wanted for s in phrase_starts(words, phrase)]
                    own += [(label, False, s, share) for label, s, share in sorted(index.matches(words))]
                    found.append([dict(zip(("label", "base", "start", "share"), x, strict=True)) for x in own])
                columns = [batch.column(0)[rows], pa.array(sizes, pa.int64()), pa.array(found, pa.list_(place))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_words", "found"])

    out = f"`{id_column}` {kind}, n_words bigint, found array<struct<label: string, base: boolean, start: bigint, share: double>>"
    return narrow(docs, id_column, text_column).mapInArrow(tidied(run), out)


def licence_report(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts, labels and score of each scanned row."""
    base = F.filter("found", lambda x: x["base"])
    listed = lambda places: F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")
    starts = F.transform("base", lambda x: x["start"])
    by_template = F.array_max(F.transform(F.filter("found", lambda x: ~x["base"]), lambda x: x["share"]))
    return scanned.withColumn("base", base).select(
        id_column,
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(F.col("base")).alias("base_labels"),
        listed(F.col("found")).alias("labels"),
        F.greatest(F.coalesce(by_template, F.lit(0.0)), F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
    )


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and score of every document."""
    return licence_report(scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _oracle_sql() -> str:
    quoted = lambda w: "'" + w.decode() + "'"
    words = ", ".join(f"({t}, {q}, {quoted(w)})" for t, x in enumerate(TEMPLATES) for q, w in enumerate(x.words))
    labels = ", ".join(f"({t}, '{x.label}', {len(x.words)})" for t, x in enumerate(TEMPLATES))
    phrases = ", ".join(f"({t}, '{' '.join(w.decode() for w in fold_words(p.encode()))}')" for t, x in enumerate(TEMPLATES) for p in x.phrases)

    def starts(phrase: str) -> str:
        test = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
        return f"list_filter(range(len(words)), lambda i: coalesce({test}, false))"

    base = " UNION ALL ".join(f"SELECT d, '{label}' AS label, unnest({starts(p)}) AS s FROM ls_docs" for p, label in BASE_PHRASES.items())
    return rf"""WITH ls_words(t, q, word) AS (VALUES {words}),
ls_labels(t, label, size) AS (VALUES {labels}),
ls_phrases(t, phrase) AS (VALUES {phrases}),
ls_docs AS MATERIALIZED (
    SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
),
ls_places AS MATERIALIZED (
    SELECT * FROM (SELECT d, unnest(words) AS word, unnest(range(len(words))) AS p FROM ls_docs) WHERE word IN (SELECT word FROM ls_words)
),
ls_frequency AS (SELECT word, count(DISTINCT d) AS n FROM ls_places GROUP BY word),
ls_rare AS MATERIALIZED (
    SELECT t, word FROM (SELECT DISTINCT t, word FROM ls_words) JOIN ls_frequency USING (word) JOIN ls_labels USING (t)
    QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, word) <= least({RARE}, (size + 1) // 2)
),
ls_enough AS (SELECT t, greatest(2, (count(*) + 1) // 2) AS enough FROM ls_rare GROUP BY t),
ls_starts AS (
    SELECT d, t, p - q AS s FROM ls_places JOIN ls_rare USING (word) JOIN ls_words USING (t, word) JOIN ls_enough USING (t)
    GROUP BY d, t, s, enough HAVING count(DISTINCT word) >= enough
),
ls_shares AS (
    SELECT d, t, s, label, any_value(size) AS size,
        count(*) FILTER (words[s + q + 1] = word AND s + q >= 0) / any_value(size) AS share,
        any_value(' ' || array_to_string(words[greatest(s - {SLACK}, 0) + 1 : greatest(s + size + {SLACK}, 0)], ' ') || ' ') AS around
    FROM ls_starts JOIN ls_labels USING (t) JOIN ls_words USING (t) JOIN ls_docs USING (d) GROUP BY d, t, s, label
),
ls_matched AS (
    SELECT d, label, share FROM ls_shares WHERE share >= {MIN_SHARE}
        AND NOT EXISTS (SELECT 1 FROM ls_phrases p WHERE p.t = ls_shares.t AND NOT contains(around, ' ' || phrase || ' '))
),
ls_base AS MATERIALIZED ({base}),
ls_counts AS (SELECT d, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM ls_base GROUP BY d),
ls_all AS (
    SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
    FROM (SELECT d, label, share FROM ls_matched UNION ALL SELECT d, label, {BASE_SCORE} FROM ls_base) GROUP BY d
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0)::DOUBLE AS score
FROM ls_docs LEFT JOIN ls_counts USING (d) LEFT JOIN ls_all USING (d)"""


ORACLE_SQL = _oracle_sql()
