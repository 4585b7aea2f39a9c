"""License scans by sentence rules.

A text is cut into normalised sentences; those that a dictionary knows become identifiers, and the sequence of identifiers (with a mark
wherever other text stands between two) is matched against ordered rules. A sentence of the dictionary may be wrapped over lines, and
it may be followed by the rest that it has in the public text. A match uses its identifiers up, so a short
rule never fires inside a longer one that stands before it. Every row is judged by itself: nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolith.llm.common import let

# fixed values: sentences of public licences and notices, normalised (a-z and 0-9 in words, single spaces); ANY stands for up to twelve words
ANY = "any"
SENTENCES = {
    "apache2-short": "licensed under the apache license version 2 0",
    "apache2-notice": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis": "the software is provided as is without warranty of any kind express or implied",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-short": "licensed under cc by 4 0",
    "cc0": "this work is dedicated to the public domain",
    "reserved": "all rights reserved",
    "bsd-neither": "neither the name of any nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-free-3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl-free-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-free-21": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-free-3": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-free-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "free-software": "this any is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "later-2": "either version 2 of the license or at your option any later version",
    "later-21": "either version 2 1 of the license or at your option any later version",
    "later-3": "either version 3 of the license or at your option any later version",
    "mpl2-open": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-waived": "to the extent possible under law any has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost": "distributed under the boost software license version 1 0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
}
#: Names that short notices use.
NAMES = {
    "MIT": ["mit license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl v2", "gpl v2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl v3", "gpl v3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl v2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl v3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl v3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "ISC": ["isc license"],
}
#: Short notices come down to `licensed under the <name>`; one that is a sentence of its own above stays as it is.
VERBS = ["licensed", "released", "distributed"]
SHORT = {f"notice-{n}-{i}": f"licensed under the {name}" for n, names in NAMES.items() for i, name in enumerate(names)}
SENTENCES |= {k: v for k, v in SHORT.items() if v not in SENTENCES.values()}
#: What the public texts add to entries that end before their sentence does.
ENDINGS = {
    "mit-grant": "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "asis": "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
}
#: Ordered: the first rules are tried first.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-keep", "asis"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-neither"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("AGPL-3.0-or-later", ["agpl-free-3"]),
    ("LGPL-3.0-or-later", ["lgpl-free-3"]),
    ("LGPL-2.1-or-later", ["lgpl-free-21"]),
    ("GPL-2.0-or-later", ["gpl-free-2"]),
    ("GPL-3.0-only", ["gpl-free-3-only"]),
    *((f"{n}-{v}-or-later", ["free-software", terms, later]) for n, terms in (("GPL", "gpl-terms"), ("LGPL", "lgpl-terms"), ("AGPL", "agpl-terms")) for v, later in (("2.0", "later-2"), ("2.1", "later-21"), ("3.0", "later-3"))),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply", "apache2-asis"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("Apache-2.0", ["apache2-short"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("MPL-2.0", ["mpl2-open"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC0-1.0", ["cc0-waived"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost"]),
    ("Zlib", ["zlib-as-is"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC0-1.0", ["cc0"]),
    ("Proprietary", ["reserved"]),
    *((n, [f"notice-{n}-{i}"]) for n, names in NAMES.items() for i in range(len(names)) if f"notice-{n}-{i}" in SENTENCES),
]


def _join(cut: Column, known: dict[str, str]) -> Column:
    """cut with each known sentence that is wrapped over lines, numbered as a clause or complete with its ending put on a line of its own."""
    gap = r"(?: ?\n ?| )"
    some = rf"[a-z0-9]+(?:{gap}[a-z0-9]+){{0,11}}?"

    def spread(sentence: str) -> str:
        return gap.join(some if w == ANY else re.escape(w) for w in sentence.split())

    own = set(known.values())
    for name, sentence in known.items():
        whole = spread(sentence)
        if name in ENDINGS:
            whole += f"(?:{gap}{spread(ENDINGS[name])})?"
        if sentence in SHORT.values():
            end = sentence.removeprefix("licensed ")
            others = [spread(o) for o in own if o.endswith(f" {end}") and o != sentence]
            begins = [spread(f"this any is {v}") for v in VERBS] + VERBS
            whole = (f"(?!(?:{'|'.join(others)}) ?(?:\\n|$))" if others else "") + f"(?:{'|'.join(begins)}){gap}{spread(end)}"
        cut = F.regexp_replace(cut, rf"(?:^|(?<=\n)) ?(?:[0-9]\n\n)?{whole}(?= ?(?:\n|$))", sentence)
    return cut


def sentences(text: Column, known: dict[str, str] | None = None) -> Column:
    """Normalised sentences: cut at line breaks and at `.!?;` before a blank; letters a-z and digits stay. Known sentences are whole even where lines break inside them."""
    known = SENTENCES if known is None else known
    ended = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.!?;]+[ \t\r\n]+", "\n\n")  # no sentence goes on over an empty line
    cut = F.regexp_replace(ended, r"[^a-z0-9\n]+", " ")
    longest = sorted({max(s.split(), key=len) for s in known.values() if s})  # a text without any of these words has no known sentence
    whole = let(cut, lambda c: F.when(F.exists(F.array(*map(F.lit, longest)), lambda w: F.contains(c, w)), _join(c, known)).otherwise(c)) if longest else cut
    return F.filter(F.transform(F.split(whole, "\n"), lambda s: F.btrim(s)), lambda s: s != "")


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_known (licence sentences), sequence (their identifiers in order; `|` where other text stands between) and licenses (distinct, sorted, comma-joined).

    known: identifier -> normalised sentence; rules: (licence, identifiers), the first first. Null, empty and unlicensed texts give 0 and empty strings. Each row gives one row, so
    null and repeated keys stay; other columns are ignored.
    """
    known, rules = SENTENCES if known is None else known, RULES if rules is None else rules
    by_text = F.create_map(*[F.lit(x) for name, s in known.items() for x in (s, name)])
    texts = F.array(*[F.lit(s) for s in known.values()])
    places = let(sentences(F.col(text), known), lambda all_: F.when(
        F.size(F.array_intersect(texts, all_)) > 0,
        F.filter(F.transform(all_, lambda s, i: F.struct(i.alias("i"), F.try_element_at(by_text, s).alias("name"))), lambda x: x["name"].isNotNull()),
    ))
    row = docs.select(F.col(key), places.alias("found"))
    marks = F.transform("found", lambda x, k: F.concat(F.when((k > 0) & (F.get("found", k - 1)["i"] < x["i"] - 1), F.lit("|")).otherwise(F.lit("")), F.lit("<"), x["name"], F.lit(">")))
    row = row.select(key, F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_known"), F.coalesce(F.array_join(marks, ""), F.lit("")).alias("sequence"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{s}>" for s in ids)).alias("form")) for name, ids in rules])
    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("names"))
    used = F.aggregate(table, start, lambda a, r: F.struct(
        F.replace(a["rest"], r["form"], F.lit("#")).alias("rest"),
        F.when(F.contains(a["rest"], r["form"]), F.array_append(a["names"], r["name"])).otherwise(a["names"]).alias("names")), lambda a: a["names"])
    names = F.when(F.col("sequence") == "", F.lit("")).otherwise(F.array_join(F.array_sort(F.array_distinct(used)), ","))
    return row.withColumn("licenses", names).withColumn("n_known", F.when(F.col("n_known") < 0, F.lit(0)).otherwise(F.col("n_known")).cast("long"))


def oracle() -> str:
    """The same scan in DuckDB SQL, for texts whose licence sentences stand on one line each and as the dictionary has them."""
    table = ", ".join(f"('{s}', '{name}')" for name, s in SENTENCES.items())
    steps, last = [], "s"
    for k, (_, ids) in enumerate(RULES):
        form = "".join(f"<{s}>" for s in ids)
        steps.append(f"r{k} AS (SELECT *, replace({last}, '{form}', '#') AS s{k}, contains({last}, '{form}') AS f{k} FROM {'q' if k == 0 else f'r{k - 1}'})")
        last = f"s{k}"
    named = ", ".join(f"CASE WHEN f{k} THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    return f"""
WITH known(sentence, name) AS (VALUES {table}),
c AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?;]+[ \\t\\r\\n]+|\\n+', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(x, lambda s: trim(s)), lambda s: s <> '') AS x FROM c),
u AS (SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) AS i FROM l),
m AS (SELECT doc_id, i, name, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM u JOIN known USING (sentence)),
a AS (SELECT doc_id, count(*) AS n, string_agg(CASE WHEN before < i - 1 THEN '|' ELSE '' END || '<' || name || '>', '' ORDER BY i) AS s FROM m GROUP BY doc_id),
q AS (SELECT d.doc_id, coalesce(n, 0) AS n_known, coalesce(s, '') AS s FROM documents d LEFT JOIN a USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, n_known, s AS sequence, array_to_string(list_sort(list_distinct(list_filter([{named}], lambda z: z IS NOT NULL))), ',') AS licenses FROM r{len(RULES) - 1}
"""
