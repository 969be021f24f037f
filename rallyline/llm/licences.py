"""Licence scans through a positional rare-token index, with DataFrame functions alone.

A template is a licence text as words, with a mandatory key phrase in it.  The corpus tells how many documents hold each
licence word; the two rarest words of a template's key phrase are its entries in the index: word -> (template, position).
A file that holds the rarest word of some template is looked up: every place of an indexed word gives a candidate start
for each posting, and a template's two lists of starts are intersected.  At what is left the key phrase must stand word
for word, and the template's other words are counted at their relative positions.  All of this is one projection over
each file: the index is a constant, and nothing is shuffled but the word counts.

Defined results: null or empty text has no words, no labels and score 0; every place counts, also overlapping ones;
rows that repeat a doc_id are scanned each; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import ascii_lower

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


#: The phrases of the contract.
BASE = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
)
#: Wordings of public licences and of notices that name them, with their key phrases.
TEMPLATES = (
    *BASE,
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", "public domain under cc0"),
    Template("copyleft-3", "this work is licensed under the gnu general public license version 3",
             "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software "
             "and associated documentation files", "permission is hereby granted free of charge"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             "mozilla public license"),
)
#: Of a template's words, the share that must stand in place around its key phrase.
SHARE = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD, -1), "")


def word_counts(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """How many documents of the whole table hold each word of the key phrases (at most one row for each word)."""
    vocabulary = sorted({w for t in templates for w in t.key_words})
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), F.lit(vocabulary))).alias("word"))
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


@dataclass(frozen=True)
class Entry:
    """A template's postings: (word, position) of its key phrase's rarest words, the rarest first."""

    template: Template
    postings: tuple[tuple[str, int], ...]


def index(counts: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> list[Entry]:
    made = []
    for t in templates:
        rising = sorted(range(len(t.key_words)), key=lambda i: (counts[t.key_words[i]], t.key_words[i]))
        made.append(Entry(t, tuple((t.key_words[i], t.key_at + i) for i in rising[:2])))
    return made


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, share: float = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, places, base_places.

    places is an array of (label, start, share), start from 0 and maybe before the text where only a tail of the
    template stands; base_places has those of the base phrases alone.
    """
    entries = index(word_counts(docs, templates), templates)
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"))
    rarest = F.lit(sorted({e.postings[0][0] for e in entries}))
    indexed = F.lit(sorted({w for e in entries for w, _ in e.postings}))
    hits = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: F.array_contains(indexed, x["w"]),
    )
    none = F.array().cast("array<struct<w: string, i: int>>")
    rows = rows.withColumn("hits", F.when(F.arrays_overlap("words", rarest), hits).otherwise(none))

    def verified(e: Entry) -> Column:
        t = e.template
        n, tokens = len(t.words), t.words

        def in_place(start: Column) -> Column:
            # a template's word counts where the file has the same one at that position
            same = [F.get(F.col("words"), start + j).eqNullSafe(F.lit(w)).cast("int") for j, w in enumerate(tokens)]
            return sum(same[1:], same[0]) / F.lit(float(n))

        key = F.lit(t.key_words)

        def starts_of(word: str, at: int) -> Column:
            places = F.filter("hits", lambda h: (h["w"] == word) & (h["i"] >= at - t.key_at))
            return F.transform(places, lambda h: h["i"] - F.lit(at))

        lists = [starts_of(*p) for p in e.postings]
        starts = F.array_intersect(*lists) if len(lists) == 2 else lists[0]
        starts = F.filter(starts, lambda s: F.slice("words", s + F.lit(t.key_at + 1), len(t.key_words)) == key)
        found = F.transform(
            starts, lambda s: F.struct(F.lit(t.label).alias("label"), s.cast("long").alias("start"), in_place(s).alias("share"))
        )
        return F.filter(found, lambda f: f["share"] >= share)

    def all_of(base: bool) -> Column:
        found = [verified(e) for e in entries if e.template.base == base]
        return F.when(F.size("hits") > 0, F.concat(*found)).otherwise(
            F.array().cast("array<struct<label: string, start: bigint, share: double>>")
        )

    return rows.select("doc_id", "n_words", all_of(True).alias("base_places"), all_of(False).alias("more_places")).select(
        "doc_id", "n_words", F.concat("base_places", "more_places").alias("places"), "base_places"
    )


def labelled(docs: DataFrame) -> DataFrame:
    """The digest of a scan: counts, first and last base place, labels and score."""

    def joined(places: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform("base_places", lambda p: p["start"])
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined("base_places").alias("base_labels"),
        joined("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The digest as SQL, by trying every template at every word."""

    def place(t: Template) -> str:
        key = "[" + ", ".join(f"'{w}'" for w in t.key_words) + "]"
        same = " + ".join(f"coalesce((w[i + {j}] = '{x}' AND i + {j} >= 1)::INT, 0)" for j, x in enumerate(t.words))
        return f"""
        SELECT doc_id, '{t.label}' AS label, {t.base} AS base, (i - 1)::BIGINT AS start, ({same}) / {float(len(t.words))}::DOUBLE AS share
        FROM (SELECT doc_id, w, unnest(range({1 - t.key_at}, len(w)::BIGINT + 1)) AS i FROM words)
        WHERE list_slice(w, i + {t.key_at}, i + {t.key_at + len(t.key_words) - 1}) = {key} AND i + {t.key_at} >= 1"""

    places = "UNION ALL".join(place(t) for t in TEMPLATES)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    WITH words AS (
      SELECT doc_id, list_filter(regexp_split_to_array({lower}, '{NON_WORD}'), lambda x: x <> '') AS w FROM documents
    ), found AS (SELECT * FROM ({places}) WHERE share >= {SHARE})
    SELECT words.doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (base)::BIGINT AS n_base,
           min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0)::DOUBLE AS score
    FROM words LEFT JOIN found ON found.doc_id = words.doc_id
    GROUP BY words.doc_id
    """
