"""Licence scans by a positional index of rare words.

Licence notices are templates. Of each template the index holds the words that are rarest in the corpus (highest inverse document
frequency) with their positions. A file's occurrences of these words are looked up; position in the file less position in the template
says where the template would begin. Occurrences that agree on this, within a few words, are summed by weight. A template is found
where enough of its weight agrees and all of its mandatory key phrases stand at their places too.

DataFrame functions only. Scale: whole texts are read once and nothing of them but the places of licence words is written; the corpus
gives one count for each licence word; votes are summed by file, template and place, after partial sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that name a licence wherever they stand.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Rarest words of each template that are indexed; words shorter than this are never rare.
RAREST, LEAST_LETTERS = 12, 5
#: By so many words more or less may the beginnings that two occurrences point to differ.
SLACK = 12
#: Share of a template's weight that must agree on its place.
SHARE = 0.6


@dataclass(frozen=True)
class Template:
    """A licence notice: its label, its words, and phrases of it that must be there."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @cached_property
    def words(self) -> list[str]:
        return self.text.split()

    def place(self, phrase: str) -> int:
        n = len(phrase.split())
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == phrase.split())


#: The notices of public licences, as words.
TEMPLATES = (
    Template(
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("redistribute it and or modify it", "gnu affero general public license"),
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("except in compliance with the license", "unless required by applicable law or agreed to in writing"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    Template(
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit",
        ("creative commons attribution",),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("redistribute it and or modify it", "terms of the gnu general public license"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software", "hereby granted provided that the above copyright notice"),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("redistribute it and or modify it", "gnu lesser general public license"),
    ),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("source code form is subject to the terms of the mozilla public license",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("unencumbered software released into the public domain",),
    ),
)


class Licences:
    """What the scan looks for: templates and phrases. Phrases are numbered, those of ``base`` first."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE):
        self.templates, self.base = templates, base
        self.phrases = [*base, *dict.fromkeys(p for t in templates for p in t.phrases if p not in base)]
        self.vocabulary = sorted({w for t in templates for w in t.words if len(w) >= LEAST_LETTERS})

    def places(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, n_words, hits, found) of each row: places of licence words, and places of phrases by number."""
        text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
        words = docs.select(F.col(f"`{id_col}`").alias("id"), F.filter(F.split(text, GAP), lambda w: w != "").alias("words"))
        firsts = sorted({p.split()[0] for p in self.phrases})
        known = sorted({*firsts, *self.vocabulary})
        marked = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(known), F.struct(i.alias("p"), w.alias("w")))))
        phrases = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, p.split())).alias("words")) for k, p in enumerate(self.phrases)])

        def at(s: Column) -> Column:
            """The phrases that stand at a marked word."""
            here = F.filter(phrases, lambda p: (F.get(p["words"], 0) == s["w"]) & (F.slice(F.col("words"), s["p"] + 1, F.size(p["words"])) == p["words"]))
            return F.transform(here, lambda p: F.struct(s["p"].alias("p"), p["k"].alias("k")))

        seen = words.withColumn("marked", marked)
        return seen.select(
            "id", F.size("words").cast("long").alias("n_words"), F.filter("marked", lambda s: s["w"].isin(self.vocabulary)).alias("hits"),
            F.flatten(F.transform(F.filter("marked", lambda s: s["w"].isin(firsts)), at)).alias("found"),
        )

    def rarity(self, placed: DataFrame) -> dict[str, int]:
        """The weight of each licence word, in millionths: log(1 + files / (files with it + 1))."""
        n = placed.count()
        each = placed.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        df = {r[0]: r[1] for r in each.collect()}  # as many rows as the templates have words
        return {w: round(1e6 * math.log(1 + n / (df.get(w, 0) + 1))) for w in self.vocabulary}

    def rarest(self, t: Template, weight: dict[str, int]) -> list[str]:
        return sorted({w for w in t.words if w in weight}, key=lambda w: (-weight[w], w))[:RAREST]

    def index(self, weight: dict[str, int]) -> list[tuple[str, int, int, str, int]]:
        """Postings (word, template, position, item, weight), and of key phrases with their number as the word and no weight."""
        out = []
        for k, t in enumerate(self.templates):
            rare = set(self.rarest(t, weight))
            out += [(w, k, i, w, weight[w]) for i, w in enumerate(t.words) if w in rare]
            out += [(f"#{self.phrases.index(p)}", k, t.place(p), f"#{p}", 0) for p in t.phrases]
        return out

    def scan(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

        ``score`` is the largest share of a template's weight that agrees on one place, whether or not its key phrases are there. Null and empty texts have no words, no
        labels and score 0. Repeated rows and rows without an id each give a row; an empty table gives an empty result; other
        columns are ignored. Texts are scanned whole: a licence counts wherever it stands, and how often does not matter."""
        spark = docs.sparkSession
        # numbers of the rows: they are written, so that they stay what they are
        placed = materialise(self.places(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "licences")
        weight = self.rarity(placed)
        postings = F.broadcast(spark.createDataFrame(self.index(weight), "w string, t int, q int, item string, weight bigint"))  # a row for each rare word of the templates
        phrases = F.transform("found", lambda f: F.struct(f["p"].alias("p"), F.concat(F.lit("#"), f["k"].cast("string")).alias("w")))
        items = placed.where(F.size("hits") > 0).select("row", F.inline(F.concat("hits", phrases)))
        # beginnings in windows of 2 * SLACK that overlap by half: any two that are SLACK apart or less share one
        start = F.floor((F.col("p") - F.col("q")) / SLACK).cast("int")
        votes = items.join(postings, "w").select("row", "t", F.explode(F.array(start, start - 1)).alias("window"), "item", "weight").distinct()
        told = votes.groupBy("row", "t", "window").agg(F.sum("weight").alias("weight"), F.count_if(F.col("weight") == 0).alias("phrases"))
        whole = [sum(weight[w] for w in self.rarest(t, weight)) for t in self.templates]
        of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("t"))
        share = told.withColumn("share", F.col("weight") / of([float(max(x, 1)) for x in whole]))
        good = (F.col("share") >= SHARE) & (F.col("phrases") == of([len(t.phrases) for t in self.templates]))
        best = share.groupBy("row").agg(F.max("share").alias("score"), F.collect_set(F.when(good, of([t.label for t in self.templates]))).alias("more"))
        base = F.filter("found", lambda f: f["k"] < len(self.base))
        labels = F.transform("_base", lambda f: F.get(F.array(*map(F.lit, self.base.values())), f["k"]))
        spot = lambda pick: pick(F.transform("_base", lambda f: f["p"])).cast("long")
        joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
        return placed.withColumn("_base", base).join(best, "row", "left").select(
            F.col("id").alias(id_col), "n_words", F.size("_base").cast("long").alias("n_base"), spot(F.array_min).alias("first_word"), spot(F.array_max).alias("last_word"),
            joined(labels).alias("base_labels"), joined(F.concat(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Licences().scan(table(spark, sf_dir, "documents"))
