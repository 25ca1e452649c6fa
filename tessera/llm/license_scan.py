"""Operator 8: licence notices by a positional rare-token index, in DataFrame operations only.

Words are runs of letters, digits and characters beyond ASCII, lower-cased; a
text is rewritten with two spaces between words, so phrases can be counted,
also ones that touch, by string functions.

1. Document frequencies of the words of the licence templates over all texts
   give their IDF; each template is indexed by its words of highest IDF, with
   their positions.
2. Each text's licence words, that is, all its words that the index holds, look
   up their postings (template, position). An occurrence at ``at`` with a
   posting at ``i`` proposes the template's place ``at - i``.
3. At each proposed place the template's other indexed words are looked for at
   their relative positions. The template is found there if ``AGREE`` of them
   (all, if it has fewer) with at least ``SHARE`` of its indexed IDF agree, one
   of them outside the key phrase (where the template has such words), and the
   mandatory key phrase stands at its own position. So a key phrase out of its
   notice, or a notice around another licence's name, is not found.
4. The score is the largest share of a template's indexed IDF at a place where
   it is found.

Base phrases are counted at all their places, beside that.

All of it is worked out in a text's own row, in time proportional to its
words: apart from the frequencies, no row is shuffled or joined.

Defined cases: a null text counts as empty: no words, no places, empty labels,
score 0; ties in IDF go to the earlier word; repeated rows get equal results
each; an empty table gives an empty one; other columns of the input are left
out, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrase -> label, fixed by the contract of the query.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, words of the text, mandatory key phrase in it: fixed values, from the licences' own notices and heads.
NOTICES = [
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "version 2 of the license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license v 2 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("bsl-1.0", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at", "boost software license version 1 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    ("cc-by-4.0", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0", "creativecommons org licenses by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution license", "creative commons attribution license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means", "all rights reserved"),
]
HEADS = [
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2 june 1991", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license version 3 29 june 2007", "gnu lesser general public license version 3"),
    ("agpl", "gnu affero general public license version 3 19 november 2007", "gnu affero general public license version 3"),
    ("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0 1 definitions", "mozilla public license version 2 0"),
    ("epl-2.0", "eclipse public license v 2 0 the accompanying program is provided", "eclipse public license v 2 0"),
    ("bsl-1.0", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international public license", "attribution 4 0 international"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international public license", "attribution sharealike 4 0 international"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international public license", "attribution noncommercial 4 0 international"),
    ("cc0", "creative commons cc0 1 0 universal", "cc0 1 0 universal"),
]
#: One-line statements as authors write them about a work: not the licences' own words.
STATEMENTS = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
]
#: Words of identifiers after ``SPDX-License-Identifier:``, with the label.
IDENTIFIERS = {"gpl 3 0": "gpl-3.0", "gpl 2 0": "gpl-2.0", "lgpl": "lgpl", "agpl": "agpl", "apache 2 0": "apache-2.0", "mit": "mit", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd-3-clause", "mpl 2 0": "mpl-2.0", "isc": "isc", "cc by 4 0": "cc-by-4.0", "cc by sa 4 0": "cc-by-sa-4.0", "cc0 1 0": "cc0", "unlicense": "unlicense"}
TEMPLATES = [*NOTICES, *HEADS, *STATEMENTS, *[(label, f"spdx license identifier {words}", words) for words, label in IDENTIFIERS.items()]]
#: Bits of a template's number in a proposal.
BITS = 7
#: Indexed words a template; how many of them and what share of their IDF must agree at a place.
INDEXED, AGREE, SHARE = 8, 3, 0.5


def key_at(words: str, key: str) -> int:
    """Where in a template's words its key phrase begins."""
    w, k = words.split(), key.split()
    return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


def spaced(phrase: str) -> str:
    return f" {'  '.join(phrase.split())} "


def word_text(text: Column) -> Column:
    """Each word with two spaces before and after it, shared by neighbours; two spaces without words.

    Full lower-casing maps no character beyond ASCII to a word of a phrase
    (of its two special cases, the dotted I keeps a mark and K is in none) and
    none to a character that parts words, so it may stand for that of A-Z.
    """
    return F.regexp_replace(F.concat(F.lit("-"), F.lower(F.coalesce(text, F.lit(""))), F.lit("-")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")


def spaces(s: Column) -> Column:
    return (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def places_of(s: Column, phrase: str) -> Column:
    p = spaced(phrase)
    return ((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(p), F.lit("")))) / len(p.encode())).cast("long")


def rarity(words: DataFrame) -> dict[str, float]:
    """IDF over all texts of the templates' words, by one aggregate; one row a word reaches the driver, so as many as the templates hold."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    found = F.array_append(F.array_intersect("w", F.array(*map(F.lit, vocabulary))), F.lit(""))  # the empty one counts texts
    often = {r["w"]: r["n"] for r in words.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = often.get("", 0)
    return {w: math.log((total + 1) / (often.get(w, 0) + 1)) + 1e-9 for w in vocabulary}


def indexed(idf: dict[str, float]) -> list[list[tuple[int, str, float]]]:
    """The postings (position, word, IDF) of each template."""
    return [[(i, w, idf[w]) for i, w in sorted(enumerate(words.split()), key=lambda x: (-idf[x[1]], x[0]))[:INDEXED]] for _, words, _ in TEMPLATES]


def notices(w: Column, index: list[list[tuple[int, str, float]]]) -> Column:
    """The templates found in an array of words: an array of (label, share)."""
    rare = sorted({word for postings in index for _, word, _ in postings})
    # one row a word, with all its postings: a text's word looks up one of them
    by_word = {word: [(i, t) for t, postings in enumerate(index) for i, x, _ in postings if x == word] for word in rare}
    listed = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in by_word[word]]) for word in rare])
    number = F.array(*map(F.lit, rare))
    table = []
    for (label, words, key), postings in zip(TEMPLATES, index, strict=True):
        begin, size = key_at(words, key), len(key.split())
        outside = [not begin <= i < begin + size for i, _, _ in postings]
        checks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(word).alias("w"), F.lit(x).alias("x"), F.lit(out or not any(outside)).alias("out")) for (i, word, x), out in zip(postings, outside, strict=True)])
        phrase = F.array(*[F.struct(F.lit(begin + k).alias("i"), F.lit(word).alias("w")) for k, word in enumerate(key.split())])
        table.append(F.struct(F.lit(label).alias("label"), checks.alias("checks"), phrase.alias("key"), F.lit(min(AGREE, len(postings))).alias("least"), F.lit(sum(x for _, _, x in postings)).alias("every")))
    templates = F.array(*table)
    own = F.filter(F.transform(w, lambda x, at: F.when(x.isin(rare), F.struct(x.alias("w"), at.alias("at")))), lambda x: x.isNotNull())
    # a proposal is one number, so that equal ones are found by hashing: place * 2^BITS + template
    proposed = F.transform(own, lambda x: F.transform(F.get(listed, F.array_position(number, x["w"]).cast("int") - 1), lambda p: (x["at"] - p["i"]).cast("long") * (1 << BITS) + p["t"]))
    place, template = lambda k: F.shiftright(k, BITS).cast("int"), lambda k: F.element_at(templates, (F.pmod(k, F.lit(1 << BITS)) + 1).cast("int"))
    stands = lambda k: lambda x: F.coalesce(F.get(w, place(k) + x["i"]) == x["w"], F.lit(False))
    keyed = F.filter(F.array_distinct(F.flatten(proposed)), lambda k: F.forall(template(k)["key"], stands(k)))
    agreeing = F.transform(keyed, lambda k: F.struct(template(k).alias("t"), F.filter(template(k)["checks"], stands(k)).alias("agree")))
    share = lambda f: F.aggregate(f["agree"], F.lit(0.0), lambda total, x: total + x["x"]) / f["t"]["every"]
    enough = F.filter(agreeing, lambda f: (F.size(f["agree"]) >= f["t"]["least"]) & F.exists(f["agree"], lambda x: x["out"]) & (share(f) >= SHARE))
    return F.transform(enough, lambda f: F.struct(f["t"]["label"].alias("label"), F.least(F.lit(1.0), F.round(share(f), 9)).alias("share")))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    rows = documents.select(F.col(id_col).alias("id"), word_text(F.col(text_col)).alias("s"))
    rows = rows.select("id", "s", F.split(F.trim("s"), "  ").alias("w"))
    index = indexed(rarity(rows))
    s = F.col("s")
    # each phrase's count is a column of its own before it is used, so it is worked out once
    rows = rows.select("id", "s", (spaces(s) / 2 - 1).cast("long").alias("n_words"), *[places_of(s, p).alias(f"c{i}") for i, p in enumerate(BASE)], notices(F.col("w"), index).alias("found"))
    first, last, names = [], [], []
    for i, (phrase, name) in enumerate(BASE.items()):
        p, n, some = spaced(phrase), len(phrase.split()), F.col(f"c{i}") > 0
        first.append(F.when(some, ((spaces(F.substring_index(s, p, 1)) - 1) / 2).cast("long")))
        last.append(F.when(some, F.col("n_words") - ((spaces(F.substring_index(s, p, -1)) - 1) / 2).cast("long") - n))
        names.append(F.when(some, F.lit(name)))
    every = sum(F.col(f"c{i}") for i in range(len(BASE)))
    out = rows.select("id", "n_words", every.alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_compact(F.array(*names)).alias("base"), "found")
    together = F.array_union("base", F.transform("found", lambda f: f["label"]))
    score = F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(F.array_sort(together), ",").alias("labels"), score.alias("score"))
