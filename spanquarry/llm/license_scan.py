"""License notices in whole texts: an exact set-similarity join with notice templates, with built-in functions only."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.llm.shared import cut

#: Phrases whose places are counted, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice templates of the method, sentences and whole notices, with their labels.
TEMPLATES = [
    ("licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
     "merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
     "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
     "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
     "or implied see the license for the specific language governing permissions and limitations under the license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
     "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
     "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
     "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to "
     "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
     "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or "
     "in connection with the software or the use or other dealings in the software", "mit"),
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
     "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
     "documentation and or other materials provided with the distribution", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
     "above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _at(array: str, i) -> Column:
    return F.get(F.col(array), i)


def _words(text: str, name: str, df: DataFrame) -> DataFrame:
    """Add the words of a text: runs of digits, letters and everything beyond ASCII, A-Z (nothing else) in lower case."""
    raw = f"__{name}"
    n = F.size(F.col(raw))
    low, high = (_at(raw, 0) == "").cast("int"), (_at(raw, n - 1) == "").cast("int")
    df = df.withColumn(raw, F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _UPPER.lower()), SEPARATORS))
    return df.withColumn(name, F.when(low + high == 0, F.col(raw)).otherwise(F.slice(F.col(raw), low + 1, F.greatest(n - low - high, F.lit(0))))).drop(raw)


def _strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def tokens(docs: DataFrame, templates: list[tuple[str, str]], phrases: dict[str, str], threshold: float) -> DataFrame:
    """One pass over the texts: ``doc_id, n_words, base`` (places of phrases), ``present`` (vocabulary words, distinct)
    and ``hits``: the places of template words, kept only where the whole text passes some template's length bound."""
    sets = sorted({tuple(sorted(set(t.split()))) for t, _ in templates})
    listed = sorted({w for s in sets for w in s})
    vocabulary = sorted({*listed, *(w for p in phrases for w in p.split())})
    df = _words("text", "w", docs.select("doc_id", "text")).withColumn("present", F.array_intersect(_strings(vocabulary), F.col("w")))
    df = df.withColumn("n", F.size("w"))
    steps = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    has = lambda ws: F.size(F.array_intersect(_strings(ws), F.col("present")))
    nothing = F.array().cast("array<struct<at:int,label:string>>")

    def places(phrase: str, label: str) -> Column:
        ws = phrase.split()

        def here(i):
            same = _at("w", i) == ws[0]
            for k in range(1, len(ws)):
                same = same & F.coalesce(_at("w", i + k) == ws[k], F.lit(False))
            return same

        found = F.transform(F.filter(steps, here), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
        return F.when(has(sorted(set(ws))) == len(set(ws)), found).otherwise(nothing)

    base = F.concat(nothing, *[places(p, x) for p, x in phrases.items()])
    passes = F.lit(False)
    for s in sets:
        passes = passes | (has(s) >= math.ceil(threshold * len(s)))
    hits = F.transform(F.filter(steps, lambda i: _at("w", i).isin(listed)), lambda i: F.struct(i.alias("at"), _at("w", i).alias("token")))
    return df.select("doc_id", F.col("n").cast("long").alias("n_words"), base.alias("base"), "present", F.when(passes, hits).alias("hits"))


def blocks(scanned: DataFrame, templates: list[tuple[str, str]], threshold: float, row: str) -> DataFrame:
    """``row, template, label, start, containment``: every block that meets a template's threshold.

    A block is a run of twice as many words as the template has distinct ones that starts with one of them; its
    containment is the share of the template's words in it. Template words are ordered by how many documents of the
    corpus have them, rarest first (ties by the word). Length filter: a text must have ceil(threshold |T|) of the words.
    Prefix filter: of |T| - ceil(threshold |T|) + 1 rarest words a block must have one, so a text without any is not
    joined. Positional filter: a word farther than a block from every such rare word is dropped.

    What stays is counted in one sweep along a text: a word counts for the starts from its last place before, or a
    block's length back, up to itself, so the distinct words from a start on are the intervals open there. Work and
    rows are linear in the places of template words, however often a text repeats a notice.
    """
    spark = scanned.sparkSession
    rows = [(n, x, w, len(set(t.split())), math.ceil(threshold * len(set(t.split())))) for n, (t, x) in enumerate(templates) for w in sorted(set(t.split()))]
    listed = spark.createDataFrame(rows, "template int, label string, token string, size int, needed int")
    counts = scanned.select(F.explode("present").alias("token")).groupBy("token").count()  # as many rows as template words
    rarity = Window.partitionBy("template").orderBy(F.coalesce("count", F.lit(0)), "token")  # the words of a template
    ordered = listed.join(counts, "token", "left").withColumn("prefix", F.row_number().over(rarity) <= F.col("size") - F.col("needed") + 1)
    near = scanned.where("hits is not null").select(row, F.explode("hits").alias("hit")).select(row, F.col("hit.at").alias("at"), F.col("hit.token").alias("token"))
    paired = near.join(F.broadcast(ordered.drop("count")), "token").withColumn("span", F.col("size") * 2)
    along = Window.partitionBy(row, "template").orderBy("at")
    rare = F.when(F.col("prefix"), F.col("at"))
    before, after = F.last(rare, True).over(along), F.last(rare, True).over(Window.partitionBy(row, "template").orderBy(F.desc("at")))
    kept = paired.withColumns({"before": before, "after": after}).where("at - before < span or after - at < span")
    again = F.lag("at").over(Window.partitionBy(row, "template", "token").orderBy("at"))
    opened = kept.withColumn("since", F.greatest(F.coalesce(again + 1, F.lit(0)), F.col("at") - F.col("span") + 1))
    ends = opened.select(row, "template", "label", "size", "needed", F.explode(F.array(
        F.struct(F.col("since").alias("place"), F.lit(0).alias("start")), F.struct(F.col("at").alias("place"), F.lit(1).alias("start")))).alias("e")).select("*", "e.place", "e.start")
    sweep = Window.partitionBy(row, "template").orderBy("place", "start").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(1 - F.col("start")).over(sweep) - F.sum("start").over(sweep) + 1  # opened up to here, less those that ended before
    return (ends.withColumn("inside", inside).where((F.col("start") == 1) & (F.col("inside") >= F.col("needed")))
            .select(row, "template", "label", F.col("place").cast("long").alias("start"), (F.col("inside") / F.col("size")).alias("containment")))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """Per document the places of the phrases, their labels, the method's labels with them, and a score.

    The score is 1 where a phrase stands, else the highest containment found, else 0. Null, empty and wordless texts
    have no words; rows of one doc_id are kept apart; rows without one stay; other columns are ignored; an empty table
    gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    scanned = cut(tokens(docs, templates, phrases, threshold).withColumn("row", F.monotonically_increasing_id()))
    found = blocks(scanned, templates, threshold, "row").groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    at = F.transform("base", lambda x: x["at"])
    own = F.transform("base", lambda x: x["label"])
    none = F.array().cast("array<string>")
    text = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return scanned.join(found, "row", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        text(own).alias("base_labels"), text(F.concat(own, F.coalesce("more", none))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
