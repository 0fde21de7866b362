"""License scans by diagonal voting.

Method: the hashes of all rolling word k-grams of the texts are joined with the positions
of the k-grams of the templates.  A match votes for its diagonal, the offset between text
and template; neighbouring diagonals of a template are merged, which bridges left-out and
added words, and a merged span is a candidate if it covers enough of the template without
being much longer.  It is verified by its telling words: the names of variants in the span
(lesser, noncommercial, sharealike ...) must be those of the template, neither fewer nor
more, and so must the version numbers if the template has any.  Of verified spans of
different labels that overlap, the one with the best cover stays, of equals the one with
the fewest inserted words.  A phrase must be covered whole on a single diagonal.

The hash of a k-gram is the 64-bit hash of its words with blanks between, so equal hashes
are taken as equal words (for 10^12 k-grams and 10^3 template positions the chance of one
false match is 10^-4).

Documents are recognised by doc_id and the hash of their text: repeated rows get equal
results each.  Defined results: null and empty texts have no words, no place (null) and no
label (empty string), score 0.  `template_rows` refuses more than MOST_POSITIONS.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import PLAIN_WORDS, map_batches, text_bytes
from flowloom.stage import materialize

K = 3
MOST_POSITIONS = 100_000
#: Diagonals of one template closer than this many words are one; least cover; longest span against the template.
GAP, COVER, LONGEST = 4, 0.8, 1.25

# The base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Opening sentences of public licenses, and common notices.
TEMPLATES = (
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
)


# Words that tell the variants of a license apart, by one spelling each; a number behind "version" or "v" tells too.
TELLING = {"lesser": "lesser", "affero": "affero", "library": "lesser"} | {"noncommercial": "nc", "nc": "nc", "sharealike": "sa", "sa": "sa", "noderivatives": "nd", "noderivs": "nd", "nd": "nd"}
PAIRS = {"non commercial": "nc", "share alike": "sa", "no derivatives": "nd"}


def tells(words: list[bytes]) -> list[tuple[int, str]]:
    """(place, what it tells) of the telling words."""
    plain = [w.decode("utf-8", "replace") for w in words]
    found = []
    for k, w in enumerate(plain):
        before = plain[k - 1] if k else ""
        if w == "library" and before != "gnu":  # "gnu library" is the older name of the lesser license
            continue
        if w in TELLING:
            found.append((k, TELLING[w]))
        elif f"{before} {w}" in PAIRS:
            found.append((k, PAIRS[f"{before} {w}"]))
        elif before in ("version", "v") and w.isdigit():
            found.append((k, f"version {w}"))
    return found


def wanted_tells(templates=TEMPLATES, first: int = len(PHRASES)) -> dict[int, set[str]]:
    """What the telling words of every template say; templates are numbered behind the phrases."""
    return {n: {what for _, what in tells(text.encode().translate(PLAIN_WORDS).split())} for n, (_, text) in enumerate(templates, first)}


def verified(spans: list[dict], telling: list[tuple[int, str]], wanted: dict[int, set[str]]) -> list[str]:
    """Labels of the candidate spans that hold the telling words of their template and no others, the best of overlapping ones."""
    right = []
    places = [k for k, _ in telling]
    for span in spans:
        here = {what for _, what in telling[bisect_left(places, span["first"]) : bisect_left(places, span["end"])]}
        own = wanted[span["template"]]
        if not any(x.startswith("version") for x in own):
            here = {x for x in here if not x.startswith("version")}
        if here == own:
            right.append(span)
    kept: list[dict] = []
    for span in sorted(right, key=lambda x: (-x["cover"], x["end"] - x["first"] - x["cover"] * x["size"], -x["size"], x["first"], x["template"])):
        if all(k["label"] == span["label"] or k["end"] <= span["first"] or span["end"] <= k["first"] for k in kept):
            kept.append(span)
    return sorted({k["label"] for k in kept})


def gram_hashes(words: list[bytes]) -> list[int]:
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    return [xxh64_intdigest(joined[a : b - 1]) for a, b in zip(starts, ends[K - 1 :].tolist(), strict=False)]


def template_rows(phrases: Iterable[tuple[str, str]], templates: Iterable[tuple[str, str]]) -> list[tuple]:
    """(gram, template, position, label, words, phrase) of every template position."""
    named = [(label, text, True) for text, label in phrases] + [(label, text, False) for label, text in templates]
    rows = []
    for number, (label, text, phrase) in enumerate(named):
        words = text.encode().translate(PLAIN_WORDS).split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        signed = np.array(gram_hashes(words), np.uint64).view(np.int64).tolist()
        rows += [(h, number, at, label, len(words), phrase) for at, h in enumerate(signed)]
    if len(rows) > MOST_POSITIONS:
        raise ValueError(f"more than {MOST_POSITIONS} template positions; scan with parts of the templates")
    return rows


_GRAMS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("grams", pa.list_(pa.int64()))])
_WORDS = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("tells", pa.list_(pa.struct([("at", pa.int64()), ("what", pa.string())])))]
)


def _hash_batch() -> Callable[[pa.RecordBatch], list]:
    def work(batch: pa.RecordBatch) -> list:
        flat: list[int] = []
        offsets = [0]
        for text in batch.column(2).to_pylist():
            flat += gram_hashes(text.translate(PLAIN_WORDS).split())
            offsets.append(len(flat))
        values = pa.array(np.array(flat, np.uint64).view(np.int64))
        return [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]

    return work


def _count_batch() -> Callable[[pa.RecordBatch], list]:
    def work(batch: pa.RecordBatch) -> list:
        words = [t.translate(PLAIN_WORDS).split() for t in batch.column(2).to_pylist()]
        return [batch.column(0), batch.column(1), [len(w) for w in words], [[{"at": k, "what": x} for k, x in tells(w)] for w in words]]

    return work


def _covered(positions: str) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.sequence(p, p + K - 1)))))


def diagonals(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document, template and diagonal with a vote: the template positions that voted."""
    rows = template_rows(phrases, templates)
    places = docs.sparkSession.createDataFrame(rows, "gram long, template int, at int, label string, size int, phrase boolean")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))
    grams = map_batches(slim, _GRAMS, _hash_batch).select("doc_id", "text_key", F.posexplode("grams").alias("pos", "gram"))
    # at most MOST_POSITIONS rows of about 60 bytes
    return (
        grams.join(F.broadcast(places), "gram")
        .groupBy("doc_id", "text_key", "template", "label", "size", "phrase", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.sort_array(F.collect_set("at")).alias("votes"))
    )


def spans(votes: DataFrame) -> DataFrame:
    """Merged diagonals: label, first word, end word, cover of the template, and whether it is a candidate."""
    own = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    near = votes.filter("not phrase").withColumn("fresh", (F.col("diagonal") - F.lag("diagonal").over(own) > GAP).cast("int"))
    runs = near.withColumn("run", F.sum(F.coalesce("fresh", F.lit(0))).over(own))
    merged = runs.groupBy("doc_id", "text_key", "template", "label", "size", "run").agg(
        F.min(F.col("diagonal") + F.element_at("votes", 1)).alias("first"),
        F.max(F.col("diagonal") + F.element_at("votes", -1) + K).alias("end"),
        F.array_distinct(F.flatten(F.collect_list("votes"))).alias("votes"),
    )
    cover = (_covered("votes") / F.col("size")).alias("cover")
    merged = merged.select("doc_id", "text_key", "template", "label", "size", "first", "end", cover)
    return merged.withColumn("accepted", (F.col("cover") >= COVER) & (F.col("end") - F.col("first") <= LONGEST * F.col("size") + GAP))


def places(votes: DataFrame) -> DataFrame:
    """Every place of a phrase: all of its k-grams on one diagonal."""
    whole = votes.filter(F.col("phrase") & (F.size("votes") == F.col("size") - K + 1))
    return whole.select("doc_id", "text_key", "label", F.col("diagonal").cast("long").alias("start"))


SPANS = "array<struct<template:int,label:string,size:int,first:bigint,end:bigint,cover:double>>"


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Places of the phrases, labels and score of every row of `docs`."""
    votes = materialize(diagonals(docs, phrases, templates), "license-votes")
    none = F.array().cast("array<string>")
    key = ["doc_id", "text_key"]
    base = places(votes).groupBy(*key).agg(
        F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.collect_set("label").alias("base")
    )
    added = spans(votes).groupBy(*key).agg(F.collect_set(F.when(F.col("accepted"), F.struct("template", "label", "size", F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("end"), "cover"))).alias("added"), F.max("cover").alias("cover"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))
    counted = map_batches(slim, _WORDS, _count_batch)
    wanted = wanted_tells(templates, len(phrases))

    @F.pandas_udf("array<string>")
    def labels_of(spans: pd.Series, telling: pd.Series) -> pd.Series:
        pairs = zip(spans, telling, strict=True)
        return pd.Series([[] if s is None or not len(s) else verified([*s], [(x["at"], x["what"]) for x in t], wanted) for s, t in pairs], spans.index, object)

    found = base.withColumns({"added": F.lit(None).cast(SPANS), "cover": F.lit(None).cast("double")}).unionByName(
        added.withColumns({c: F.lit(None).cast("long") for c in ("n_base", "first_word", "last_word")} | {"base": none})
    )
    figures = [F.max(c).alias(c) for c in ("n_base", "first_word", "last_word", "base", "added", "cover")]
    found = found.groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).agg(*figures)
    joined = counted.join(found, counted.doc_id.eqNullSafe(F.col("_doc_id")) & (counted.text_key == F.col("_text_key")), "left")
    base_set, added_set = F.coalesce("base", none), labels_of("added", "tells")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.sort_array(base_set), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_set, added_set)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
