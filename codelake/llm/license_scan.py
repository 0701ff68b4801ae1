"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of every whole text is hashed and joined to the
k-gram positions of the templates.  A match at word p of a text and word t
of a template votes for the diagonal p - t.  Votes are added up per text,
template and diagonal (as a bit set of template positions), neighbouring
diagonals are merged into a span (insertions and deletions shift a copy by
a few words), and a span is verified: a phrase needs every position on one
diagonal, a passage a share of its positions in a span of fitting length.
Each vote compares the words themselves, so hash collisions cast none.

A row per word exists only inside one generated-code stage (explode, hash,
probe); what is shuffled is one row per text and its few votes.

The templates are a parameter; their grams are broadcast up to
``MAX_BROADCAST_GRAMS`` and joined by hash beyond that.

Defined cases: a very long text is worked on whole, in one task; null text counts as empty; empty texts give zeros, null word
positions, empty labels and score 0; repeated rows give a row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASE_GRAM, PASSAGE_GRAM = 2, 4
MAX_WORDS = 60                 # longer passages are cut into pieces of this many words
BAND = 6                       # diagonals at most this far apart belong to one span
MIN_SHARE = 0.6                # of a passage's positions
MAX_STRETCH = 1.5              # of a passage's length
MAX_BROADCAST_GRAMS = 100_000

# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Further notices, as their licenses word them.
PHRASES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("apache license version 2 0", "apache-2.0"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("isc license", "isc"),
    ("boost software license", "boost"),
    ("all rights reserved", "all-rights-reserved"),
)
PASSAGES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version.", "gpl-3.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
     "of conditions and the following disclaimer.", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
     "use, compile, sell, or distribute this software", "unlicense"),
)


@dataclass(frozen=True)
class Template:
    tid: int
    label: str
    base: bool
    phrase: bool
    words: tuple[str, ...]

    @property
    def k(self) -> int:
        return PHRASE_GRAM if self.phrase else PASSAGE_GRAM

    @property
    def positions(self) -> int:
        return len(self.words) - self.k + 1


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def templates(base=BASE, phrases=PHRASES, passages=PASSAGES) -> list[Template]:
    out: list[Template] = []
    for texts, is_base, is_phrase in ((base, True, True), (phrases, False, True), (passages, False, False)):
        for text, label in texts:
            w = words_of(text)
            step = MAX_WORDS if not is_phrase else max(len(w), 1)
            parts = [w[i:i + step] for i in range(0, len(w), step)]
            if len(parts) > 1 and len(parts[-1]) < 3 * PASSAGE_GRAM:
                parts.pop()
            for part in parts:
                if len(part) < (PHRASE_GRAM if is_phrase else PASSAGE_GRAM):
                    raise ValueError(f"template too short: {text!r}")
                out.append(Template(len(out), label, is_base, is_phrase, tuple(part)))
    return out


def _gram_rows(ts: list[Template]) -> list[tuple]:
    return [(t.tid, t.label, t.base, t.phrase, len(t.words), t.positions, t.k, p, " ".join(t.words[p:p + t.k]))
            for t in ts for p in range(t.positions)]


def _gram_table(spark: SparkSession, ts: list[Template]) -> DataFrame:
    rows = _gram_rows(ts)
    df = spark.createDataFrame(rows, "tid int, label string, base boolean, phrase boolean, t_words int, t_positions int, "
                                     "t_k int, t_pos int, gram string")
    df = df.withColumn("t_hash", F.xxhash64("t_k", "gram"))
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_GRAMS else df


def scan(docs: DataFrame, ts: list[Template] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    ts = ts or templates()
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lowered.alias("text")) \
        .withColumn("row", F.monotonically_increasing_id())
    # exploding a one-element array keeps the optimiser from copying the word split into every use of it
    d = d.select("row", "doc_id", F.explode(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("words"))
    d = d.select("row", "doc_id", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))

    def gram(k: int):
        return F.concat_ws(" ", "word", *[F.get("words", F.col("pos") + i) for i in range(1, k)])

    d = d.select("row", "doc_id", "pos", F.size("words").alias("n"),
                 F.inline(F.array(*[F.struct(F.lit(k).alias("k"), gram(k).alias("g")) for k in (PHRASE_GRAM, PASSAGE_GRAM)])))
    d = d.withColumn("hash", F.xxhash64("k", "g"))
    t = _gram_table(docs.sparkSession, ts)
    hit = (F.col("g") == F.col("gram")) & (F.col("k") == F.col("t_k"))
    last = (F.col("pos") == F.col("n")) & (F.col("k") == PHRASE_GRAM)      # one row per text, match or none
    votes = d.join(t, d["hash"] == t["t_hash"], "left").where(hit | last).withColumn("tid", F.when(hit, F.col("tid")))

    diagonals = votes.groupBy("row", "doc_id", "tid", F.when(F.col("tid").isNotNull(), F.col("pos") - F.col("t_pos")).alias("diag")) \
        .agg(F.max(F.when(last, F.col("n"))).alias("n_words"),
             F.bit_or(F.expr("shiftleft(1L, t_pos)")).alias("bits"),
             F.min("pos").alias("lo"), F.max("pos").alias("hi"),
             *[F.max(c).alias(c) for c in ("label", "base", "phrase", "t_words", "t_positions", "t_k")])
    w = Window.partitionBy("row", "tid").orderBy("diag")
    fresh = F.coalesce(F.col("phrase"), F.lit(True)) | (F.col("diag") - F.lag("diag").over(w) > BAND) | F.lag("diag").over(w).isNull()
    spans = diagonals.withColumn("span", F.sum(fresh.cast("int")).over(w)) \
        .groupBy("row", "doc_id", "tid", "span") \
        .agg(F.max("n_words").alias("n_words"), F.bit_count(F.bit_or("bits")).alias("votes"), F.min("diag").alias("start"),
             (F.max("hi") + F.max("t_k") - F.min("lo")).alias("length"),
             *[F.max(c).alias(c) for c in ("label", "base", "phrase", "t_words", "t_positions")]) \
        .withColumn("share", F.col("votes") / F.col("t_positions"))
    ok = F.col("tid").isNotNull() & F.when(F.col("phrase"), F.col("votes") == F.col("t_positions")).otherwise(
        (F.col("share") >= MIN_SHARE) & (F.col("length") <= F.col("t_words") * MAX_STRETCH))
    place = ok & F.col("base")

    def joined(cond):
        return F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")

    return spans.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("bigint").alias("last_word"),
        joined(place).alias("base_labels"), joined(ok).alias("labels"),
        F.coalesce(F.max(F.when(ok, F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def oracle(ts: list[Template] | None = None) -> str:
    """DuckDB SQL for ``scan`` of ``documents``."""
    ts = ts or templates()
    values = ",".join(f"({a},'{b}',{c},{d},{e},{f},{g},{h},'{i}')" for a, b, c, d, e, f, g, h, i in _gram_rows(ts))
    fold = f"translate(coalesce(text,''),'{UPPER}','{LOWER}')"
    return f"""
with t(tid,label,base,phrase,t_words,t_positions,t_k,t_pos,gram) as (values {values}),
d as (select doc_id, regexp_extract_all({fold}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') words from documents),
p as (select doc_id, words, unnest(range(len(words))) pos from d),
g as (select doc_id, pos, k, array_to_string(words[pos+1:pos+k],' ') gram from p, (values ({PHRASE_GRAM}),({PASSAGE_GRAM})) ks(k)
      where pos+k<=len(words)),
v as (select g.doc_id, pos, pos-t_pos diag, t.* from g join t on g.gram=t.gram and g.k=t.t_k),
s as (select doc_id, tid, diag, bit_or(1::bigint<<t_pos::int) bits, min(pos) lo, max(pos) hi, any_value(label) label,
      any_value(base) base, any_value(phrase) phrase, any_value(t_words) t_words, any_value(t_positions) t_positions, any_value(t_k) t_k
      from v group by all),
s2 as (select *, lag(diag) over (partition by doc_id,tid order by diag) prev from s),
s3 as (select *, sum(case when phrase or prev is null or diag-prev>{BAND} then 1 else 0 end)
       over (partition by doc_id,tid order by diag rows unbounded preceding) span from s2),
x as (select doc_id, tid, span, bit_count(bit_or(bits)) votes, min(diag) start, max(hi)+any_value(t_k)-min(lo) length,
      any_value(label) label, any_value(base) base, any_value(phrase) phrase, any_value(t_words) t_words,
      any_value(t_positions) t_positions from s3 group by doc_id, tid, span),
y as (select * from x where case when phrase then votes=t_positions
      else votes/t_positions>={MIN_SHARE} and length<=t_words*{MAX_STRETCH} end),
z as (select doc_id, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word,
      coalesce(array_to_string(list_sort(list(distinct label) filter (base)),','),'') base_labels,
      array_to_string(list_sort(list(distinct label)),',') labels, max(votes/t_positions)::double score from y group by doc_id)
select d.doc_id, len(words)::bigint n_words, coalesce(n_base,0)::bigint n_base, first_word::bigint first_word,
  last_word::bigint last_word, coalesce(base_labels,'') base_labels, coalesce(labels,'') labels, coalesce(score,0)::double score
from d left join z using(doc_id)"""
