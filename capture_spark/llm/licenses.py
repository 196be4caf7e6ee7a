"""Licence recognition by sentences: known sentences to identifiers, identifier runs to rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Opening, grant and notice sentences of public licences, each with
# its identifier, and the rules as ordered sequences of identifiers.
SENTENCES: dict[str, str] = {
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-grant": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "apache2-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-short-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ccbync4-short": "Licensed under CC BY-NC 4.0.",
    "ccby4-short": "Licensed under CC BY 4.0.",
    "ccbysa4-short": "Licensed under CC BY-SA 4.0.",
    "ccby4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbync4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-short": "Released under CC0 1.0.",
    "reserved": "All rights reserved.",
}
RULES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-2.0/notice": ("Apache-2.0", ("apache2-short",)),
    "apache-2.0/header": ("Apache-2.0", ("apache2-grant", "apache2-copy", "apache2-asis", "apache2-see")),
    "mit/notice": ("MIT", ("mit-short",)),
    "mit/licensed": ("MIT", ("mit-short-licensed",)),
    "mit/text": ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    "gpl-3.0/notice": ("GPL-3.0-only", ("gpl3-short",)),
    "gpl-3.0/header": ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    "cc-by-nc-4.0/notice": ("CC-BY-NC-4.0", ("ccbync4-short",)),
    "cc-by-nc-4.0/long": ("CC-BY-NC-4.0", ("ccbync4-long",)),
    "cc-by-4.0/notice": ("CC-BY-4.0", ("ccby4-short",)),
    "cc-by-4.0/long": ("CC-BY-4.0", ("ccby4-long",)),
    "cc-by-sa-4.0/notice": ("CC-BY-SA-4.0", ("ccbysa4-short",)),
    "bsd-2-clause/text": ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    "bsd-3-clause/text": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    "isc/text": ("ISC", ("isc-grant",)),
    "unlicense/text": ("Unlicense", ("unlicense",)),
    "cc0-1.0/notice": ("CC0-1.0", ("cc0-short",)),
    "reserved/notice": ("LicenseRef-all-rights-reserved", ("reserved",)),
}
# End of fixed values.

END = r"\.+\s+|[:;!?]\s+|\.+$|\n+"
DROPPED = r"[^a-z0-9]+"
#: A list number: 1, 12, a, iv.
NUMBER = "(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})"


def normal(sentence: str) -> str:
    """The key of a known sentence: its normalised pieces, as the scan cuts them."""
    pieces = [re.sub(DROPPED, " ", p.lower()).strip() for p in re.split(END, sentence)]
    return "\n".join(p for p in pieces if p)


def _parts(sentences: dict[str, str]) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Identifier by piece, and the identifiers of each sentence's pieces."""
    parts: dict[str, str] = {}
    of: dict[str, list[str]] = {}
    for name, sentence in sentences.items():
        of[name] = []
        for k, piece in enumerate(normal(sentence).split("\n")):
            parts.setdefault(piece, f"{name}#{k}" if k else name)
            of[name].append(parts[piece])
    return parts, of


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: dict[str, tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, rules, licenses) for each row of ``docs``.

    A text is cut at sentence ends and line ends; each piece is lower-cased and
    all but ASCII letters and digits become one blank.  A known sentence (or a
    part of one that the cut makes) is a run of whole pieces that has its words,
    so it may be wrapped over lines, with indents or comment marks, and may stand
    after a list number; the longest one counts.  Known sentences are mapped to
    identifiers by a map literal, in order, pieces that are only a list number
    are passed over, and the others are mapped to none.  A rule matches where its
    sentences' parts stand in order with nothing but licence sentences between
    them; a match inside a longer match of the same start is not listed.
    All of it is column work in one pass, so a row never leaves its task.  Null
    and empty texts have no sentences; repeated rows, null ids and extra columns
    are allowed; licences are listed once each in order of name.
    """
    parts, of = _parts(sentences)
    known = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    clean = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), END), lambda s: F.trim(F.regexp_replace(s, DROPPED, " ")))
    pieces = F.filter(clean, lambda s: s != "")
    # Each piece stands between line ends, so a wrapped sentence has a line end for some of its blanks; "|" sets matches apart.
    lines = F.concat(F.lit("\n"), F.array_join(F.filter("pieces", lambda s: ~s.rlike(f"^{NUMBER}$")), "\n"), F.lit("\n"))
    wrapped = "|".join(p.replace(" ", "[ \n]") for p in sorted(parts, key=len, reverse=True))
    cut = F.split(F.regexp_replace("lines", f"\n(?:{NUMBER} )?({wrapped})(?=\n)", "|$1|"), r"\|")
    ids = F.transform(F.col("cut"), lambda s, i: F.when(i % 2 == 1, F.element_at(known, F.replace(s, F.lit("\n"), F.lit(" ")))).when(F.trim(F.replace(s, F.lit("\n"), F.lit(""))) != "", F.lit("")))
    # A run has one sign for each known sentence and a comma for other text, so a rule is a pattern of single signs, which no long run makes recurse.
    sign = {i: chr(0xE000 + k) for k, i in enumerate(sorted(set(parts.values())))}
    signs = F.create_map(*[F.lit(x) for kv in sign.items() for x in kv])
    runs = F.array_join(F.transform("ids", lambda i: F.when(i == "", ",").otherwise(F.element_at(signs, i))), "")
    steps_of = {rule: [p for s in steps for p in of[s]] for rule, (_, steps) in rules.items()}
    pattern = {rule: "[^,]*?".join(sign[p] for p in steps) for rule, steps in steps_of.items()}
    found = {}
    for rule, steps in steps_of.items():
        hit = F.col("runs").rlike(pattern[rule])
        for other, longer in steps_of.items():
            if other != rule and longer[: len(steps)] == steps:
                hit = hit & F.regexp_replace("runs", pattern[other], "").rlike(pattern[rule])
        found[rule] = hit
    matched = F.array_compact(F.array(*[F.when(hit, F.lit(rule)) for rule, hit in found.items()]))
    spdx = F.create_map(*[F.lit(x) for rule, (name, _) in rules.items() for x in (rule, name)])
    step = docs.select("doc_id", pieces.alias("pieces")).select("doc_id", F.size("pieces").cast("long").alias("n_sentences"), lines.alias("lines"))
    step = step.select("doc_id", "n_sentences", cut.alias("cut")).select("doc_id", "n_sentences", F.array_compact(ids).alias("ids"))
    step = step.select("doc_id", "n_sentences", F.filter("ids", lambda s: s != "").alias("known"), runs.alias("runs"))
    step = step.select("doc_id", "n_sentences", F.array_join("known", ",").alias("sentence_ids"), matched.alias("rule_list"))
    return step.select(
        "doc_id",
        "n_sentences",
        "sentence_ids",
        F.array_join("rule_list", ",").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("rule_list", lambda r: F.element_at(spdx, r)))), ",").alias("licenses"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    parts, of = _parts(SENTENCES)
    known = ", ".join(f"('{p}', '{i}')" for p, i in parts.items())
    seq = {r: "," + ",".join(p for s in steps for p in of[s]) + "," for r, (_, steps) in RULES.items()}
    tests = []
    for rule, text in seq.items():
        hit = f"contains(runs, '{text}')"
        for other, longer in seq.items():
            if other != rule and longer.startswith(text):
                hit += f" AND contains(replace(runs, '{longer}', ','), '{text}')"
        tests.append(f"CASE WHEN {hit} THEN ['{rule}'] ELSE [] END")
    names = " ".join(f"WHEN '{r}' THEN '{n}'" for r, (n, _) in RULES.items())
    return f"""
WITH known(piece, id) AS (VALUES {known}),
p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '{END}'), lambda s: trim(regexp_replace(s, '{DROPPED}', ' ', 'g'))), lambda s: s <> '') AS pieces FROM documents),
x AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM p),
y AS (SELECT doc_id, string_agg(coalesce(id, ''), ',' ORDER BY i) AS run, coalesce(string_agg(id, ',' ORDER BY i), '') AS sentence_ids FROM x LEFT JOIN known USING (piece) GROUP BY doc_id),
z AS (SELECT p.doc_id, CAST(len(pieces) AS BIGINT) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, ',' || coalesce(run, '') || ',' AS runs FROM p LEFT JOIN y ON y.doc_id = p.doc_id),
r AS (SELECT *, {" || ".join(tests)} AS rule_list FROM z)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(rule_list, ',') AS rules, array_to_string(list_sort(list_distinct(list_transform(rule_list, lambda r: CASE r {names} END))), ',') AS licenses FROM r"""


ORACLE = _sql()
