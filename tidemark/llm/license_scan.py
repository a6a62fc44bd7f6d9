"""Licence notices, recognised as sequences of known sentences.

A text is cut into sentences, each is normalised and looked up among known licence sentences, and the sequence of
identifiers that remains is matched against ordered licence rules: a rule takes the identifiers it matches, so later
rules see only what is left. Built-in functions only; a row needs no other row, so nothing is shuffled.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-line",
    "licensed under cc by 4 0": "cc-by-4.0-line",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-line",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-line",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0-line",
    "licensed under the apache license version 2 0": "apache-2.0-line",
    "licensed under the apache license version 2 0 the license": "apache-2.0-head",
    "you may not use this file except in compliance with the license": "apache-2.0-comply",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "released under the mit license": "mit-line",
    "licensed under the mit license": "mit-line",
    "mit license": "mit-title",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "all rights reserved": "all-rights",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2.0-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-2.1-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3.0-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3.0-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3.0-later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-head",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2.0-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2.0-head",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "cc0 1 0 universal": "cc0-title",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0-line",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-line",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0-line",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0-line",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-4.0-line",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-1.0-grant",
}

#: Licence rules in order of precedence, as sequences of sentence identifiers.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-2.0-head", "apache-2.0-comply", "apache-2.0-copy"]),
    ("GPL-3.0-or-later", ["gpl-3.0-later", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-3.0-later"]),
    ("GPL-2.0-or-later", ["gpl-2.0-later", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl-2.0-later"]),
    ("AGPL-3.0-or-later", ["agpl-3.0-later", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl-3.0-later"]),
    ("LGPL-3.0-or-later", ["lgpl-3.0-later"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-later"]),
    ("MPL-2.0", ["mpl-head", "mpl-2.0-copy"]),
    ("EPL-2.0", ["epl-2.0-head"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("BSL-1.0", ["bsl-1.0-grant"]),
    ("CC0-1.0", ["cc0-title", "cc0-waiver"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("CC0-1.0", ["cc0-title"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-title", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-notice", "mit-warranty"]),
    ("MIT", ["mit-line"]),
    ("Apache-2.0", ["apache-2.0-line"]),
    ("GPL-3.0-only", ["gpl-3.0-line"]),
    ("GPL-2.0-only", ["gpl-2.0-line"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-line"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-line"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4.0-line"]),
    ("CC-BY-4.0", ["cc-by-4.0-line"]),
    ("Unlicense", ["unlicense-head"]),
    ("Proprietary", ["all-rights"]),
]

BREAK = "\u0001"
SENTENCE_END, OTHER, AROUND = r"[.!?]+[ \t\r\f]+|[ \t\r\f]*\n+", f"[^a-z0-9{BREAK}]+", f" *{BREAK}[ {BREAK}]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences(text: Column) -> Column:
    """Normalised sentences: A-Z lower-cased, all but letters and digits of ASCII as single spaces."""
    text = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER + BREAK, LOWER + " "), SENTENCE_END, BREAK)
    text = F.regexp_replace(F.regexp_replace(text, OTHER, " "), AROUND, BREAK)
    return F.split(F.trim(text), BREAK)


def scan_licenses(docs: DataFrame, text_col: str = "text", known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Add sentence_ids (array, in the order of the text), licenses (sorted set) and n_unmatched to each row of docs.

    known maps normalised sentences to identifiers; rules are (licence, identifiers) in order of precedence. A rule
    matches where its identifiers follow one another among the known sentences of a text; unknown sentences between
    them don't matter. n_unmatched counts identifiers that no rule took. Null and empty texts have none of either.
    Rows stay as they are, repeated ones too; columns of docs with these three names are replaced.
    """
    known, rules = known or SENTENCES, rules or RULES
    table = F.create_map(*[F.lit(x) for x in chain(*known.items())])
    ids = F.transform(F.filter(sentences(F.col(text_col)), lambda s: s.isin(list(known))), lambda s: table[s])
    kept = [c for c in docs.columns if c not in ("sentence_ids", "licenses", "n_unmatched")]
    out = docs.select(*kept, ids.alias("sentence_ids"))
    left = F.concat(F.lit(""), F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    out = out.withColumn("_tm_left", left).withColumn("_tm_found", F.array().cast("array<string>"))
    for name, sequence in rules:
        pattern = F.lit("".join(f"<{i}>" for i in sequence))
        hit = F.contains(F.col("_tm_left"), pattern)
        out = out.withColumns({"_tm_found": F.when(hit, F.array_append("_tm_found", F.lit(name))).otherwise(F.col("_tm_found")), "_tm_left": F.when(hit, F.replace(F.col("_tm_left"), pattern, F.lit("|"))).otherwise(F.col("_tm_left"))})
    unmatched = F.length("_tm_left") - F.length(F.translate("_tm_left", "<", ""))
    return out.select(*kept, "sentence_ids", F.array_sort(F.array_distinct("_tm_found")).alias("licenses"), unmatched.cast("long").alias("n_unmatched"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs)
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"), "n_unmatched")


def _oracle() -> str:
    keys = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    steps, last = [], "r0"
    for n, (name, sequence) in enumerate(RULES, 1):
        pattern = "".join(f"<{i}>" for i in sequence)
        steps.append(f"r{n} AS (SELECT n, doc_id, ids, replace(l, '{pattern}', '|') AS l, CASE WHEN contains(l, '{pattern}') THEN list_append(f, '{name}') ELSE f END AS f FROM {last})")
        last = f"r{n}"
    return f"""
WITH known(s, id) AS (VALUES {keys}),
d AS (SELECT row_number() OVER () AS n, doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}' || chr(1), '{LOWER} '), '[.!?]+[ \\t\\r\\f]+|[ \\t\\r\\f]*\\n+', chr(1), 'g') AS t FROM documents),
s AS (SELECT n, unnest(string_split(trim(regexp_replace(regexp_replace(t, '[^a-z0-9' || chr(1) || ']+', ' ', 'g'), ' *' || chr(1) || '[ ' || chr(1) || ']*', chr(1), 'g'), ' '), chr(1))) AS s,
             generate_subscripts(string_split(trim(regexp_replace(regexp_replace(t, '[^a-z0-9' || chr(1) || ']+', ' ', 'g'), ' *' || chr(1) || '[ ' || chr(1) || ']*', chr(1), 'g'), ' '), chr(1)), 1) AS k FROM d),
g AS (SELECT n, list(id ORDER BY k) AS ids FROM s JOIN known USING (s) GROUP BY n),
r0 AS (SELECT d.n, doc_id, coalesce(ids, []) AS ids, coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '') AS l, []::VARCHAR[] AS f FROM d LEFT JOIN g USING (n)),
{', '.join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(f)), ' '), '') AS licenses, (length(l) - length(replace(l, '<', '')))::BIGINT AS n_unmatched
FROM {last}
"""


ORACLE = _oracle()
