r"""Operator 5: licence scanning by sentence rules.

A text is cut into sentences (at line ends, and after ``.``, ``!``, ``?`` or ``;``
before white space), sentences are normalised (lower case, anything but ASCII
letters and digits becomes one blank), and those that equal a known licence
sentence become one-letter identifiers. The identifiers of a document, in order,
are then read from left to right by the longest licence rule that fits.

All of it is built-in expressions: one scan, a dictionary of fixed size, and a
shuffle of recognised sentences only. Sentences are looked up only in texts that
have one of ``STEMS``, which every known sentence has.

Defined results: null, empty and licence-free texts give no row; a repeated
licence gives a row each time; an identifier that no rule starts with is skipped;
rows of an equal (or null) doc_id are scanned one by one, ``ord`` counting in each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

STEMS = ("licen", "copyright", "warrant", "permission", "redistribut", "public domain", "spdx", "liability", "free software", "released under", "distributed under", "available under")

_VERBS = ("licensed under", "released under", "distributed under", "available under", "this work is licensed under", "this software is licensed under", "this project is licensed under", "this program is licensed under", "this file is licensed under", "this code is licensed under", "this work is released under", "this software is released under", "this code is released under", "this project is released under", "this content is licensed under", "this document is licensed under", "code released under", "spdx license identifier")

_NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0", "apache 2 0 license", "apache license v2 0"),
    "MIT": ("mit license", "mit licence", "mit"),
    "GPL-2.0": ("gnu general public license version 2", "gpl 2 0", "gplv2", "gpl v2", "gnu gpl v2", "gnu general public license v2 0", "gpl 2 0 only"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gpl 2 0 or later", "gnu general public license version 2 or any later version"),
    "GPL-3.0": ("gnu general public license version 3", "gpl 3 0", "gplv3", "gpl v3", "gnu gpl v3", "gnu general public license v3 0", "gpl 3 0 only"),
    "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gpl 3 0 or later", "gnu general public license version 3 or any later version"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl 2 1", "lgplv2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl 3 0", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "new bsd license", "bsd license"),
    "ISC": ("isc license", "isc"),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-3.0": ("cc by 3 0", "creative commons attribution 3 0 unported license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-SA-3.0": ("cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "epl 2 0"),
    "Zlib": ("zlib license",),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
}

_TEXTS = {
    "copyright": (),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as_is_mit": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "liable_mit": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "as_is_isc": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "as_is_bsd": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "apache_file": ("you may not use this file except in compliance with the license",),
    "apache_copy": ("you may obtain a copy of the license at http www apache org licenses license 2 0",),
    "apache_basis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "gpl_free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl2_free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl_warranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "mpl_subject": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "public_domain": ("this work is in the public domain", "this is free and unencumbered software released into the public domain"),
    "all_rights": ("all rights reserved copyright",),
}


def _identifiers() -> tuple[dict[str, str], dict[str, str]]:
    """A letter for each kind of sentence, and the kind's letter by normalised sentence."""
    letters = {k: chr(0x4E00 + i) for i, k in enumerate([*_TEXTS, *(f"name:{n}" for n in _NAMES), *(f"title:{n}" for n in _NAMES)])}
    known = {s: letters[k] for k, some in _TEXTS.items() for s in some}
    for name, forms in _NAMES.items():
        for form in forms:
            for verb in _VERBS:
                for article in ("", "the ", "a "):
                    known[f"{verb} {article}{form}"] = letters[f"name:{name}"]
            if any(x in form for x in STEMS) and "licen" in form:
                known.setdefault(form, letters[f"title:{name}"])
                known.setdefault(f"the {form}", letters[f"title:{name}"])
    return letters, {s: c for s, c in known.items() if any(x in s for x in STEMS)}


LETTERS, SENTENCES = _identifiers()


def _rules() -> list[tuple[str, str]]:
    """Ordered rules ``(identifier sequence, licence)``, longest first."""
    seq = lambda *k: "".join(LETTERS[x] for x in k)
    out = [(seq(f"name:{n}"), n) for n in _NAMES]
    for opening in ((), ("copyright",)):
        out += [
            (seq(*opening, "mit_grant", "mit_notice", "as_is_mit", "liable_mit"), "MIT"),
            (seq(*opening, "mit_grant", "mit_notice", "as_is_mit"), "MIT"),
            (seq(*opening, "mit_grant", "mit_notice"), "MIT"),
            (seq(*opening, "isc_grant", "as_is_isc"), "ISC"),
            (seq(*opening, "bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "as_is_bsd"), "BSD-3-Clause"),
            (seq(*opening, "bsd_grant", "bsd_source", "bsd_binary", "bsd_names"), "BSD-3-Clause"),
            (seq(*opening, "bsd_grant", "bsd_source", "bsd_binary", "as_is_bsd"), "BSD-2-Clause"),
            (seq(*opening, "name:Apache-2.0", "apache_file", "apache_copy", "apache_basis"), "Apache-2.0"),
            (seq(*opening, "name:Apache-2.0", "apache_file", "apache_copy"), "Apache-2.0"),
            (seq(*opening, "gpl_free", "gpl_warranty"), "GPL-3.0-or-later"),
            (seq(*opening, "gpl2_free", "gpl_warranty"), "GPL-2.0-or-later"),
        ]
    out += [(seq("gpl_free"), "GPL-3.0-or-later"), (seq("gpl2_free"), "GPL-2.0-or-later"), (seq("mpl_subject"), "MPL-2.0"), (seq("public_domain"), "Public-Domain"), (seq("title:MIT", "mit_grant", "mit_notice"), "MIT"), (seq("title:MIT", "copyright", "mit_grant", "mit_notice", "as_is_mit", "liable_mit"), "MIT")]
    return sorted(set(out), key=lambda r: (-len(r[0]), r[0]))


RULES = _rules()
_COPYRIGHT = r"^copyright( c)? [0-9]{4}( [0-9]{4})* [a-z]"


def normalise(sentence):
    """The normalised form of a sentence column."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, ord, license)``: the licences of every document in order."""
    spark = docs.sparkSession
    text = F.lower("text")
    has = lambda c: F.exists(F.array(*[F.lit(x) for x in STEMS]), lambda x: F.contains(c, x))
    some = docs.where(has(text)).select("doc_id", F.monotonically_increasing_id().alias("_row"), "text")
    cut = F.split(F.regexp_replace("text", r"([.!?;])[ \t\r\f\n]+", "$1\n"), "\n")
    one = some.select("doc_id", "_row", F.posexplode(cut).alias("_at", "_s")).where(has(F.lower("_s")))
    one = one.select("doc_id", "_row", "_at", normalise(F.col("_s")).alias("sentence"))
    known = F.broadcast(spark.createDataFrame(list(SENTENCES.items()), "sentence string, _id string"))
    named = one.join(known, "sentence", "left").withColumn("_id", F.coalesce("_id", F.when(F.col("sentence").rlike(_COPYRIGHT), LETTERS["copyright"]))).where("_id is not null")
    order = F.array_sort(F.collect_list(F.struct("_at", "_id")))
    sequence = named.groupBy("doc_id", "_row").agg(F.array_join(F.transform(order, lambda x: x["_id"]), "").alias("seq"))
    pattern = "(" + "|".join(s for s, _ in RULES) + ")"
    found = sequence.select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit(pattern), 1)).alias("ord", "_rule"))
    rules = F.broadcast(spark.createDataFrame(RULES, "_rule string, license string"))
    return found.join(rules, "_rule").select("doc_id", F.col("ord").cast("int").alias("ord"), "license")


def scan_sql() -> str:
    """DuckDB SQL of ``scan`` over ``documents``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = lambda rows: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows)
    has = lambda c: "(" + " OR ".join(f"contains({c}, {quoted(x)})" for x in STEMS) + ")"
    return f"""
WITH known(sentence, id) AS (VALUES {values(SENTENCES.items())}), rules(rule, license) AS (VALUES {values(RULES)}),
cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?;])[ \\t\\r\\f\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM documents WHERE {has("lower(text)")}),
one AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS place FROM cut),
norm AS (SELECT doc_id, place, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM one WHERE {has("lower(s)")}),
named AS (SELECT doc_id, place, coalesce(k.id, CASE WHEN regexp_matches(n.sentence, {quoted(_COPYRIGHT)}) THEN {quoted(LETTERS["copyright"])} END) AS id FROM norm n LEFT JOIN known k USING (sentence)),
seq AS (SELECT doc_id, string_agg(id, '' ORDER BY place) AS seq FROM named WHERE id IS NOT NULL GROUP BY doc_id),
got AS (SELECT doc_id, regexp_extract_all(seq, {quoted("(" + "|".join(s for s, _ in RULES) + ")")}, 1) AS r FROM seq),
each AS (SELECT doc_id, unnest(r) AS rule, unnest(range(len(r))) AS ord FROM got)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, license FROM each JOIN rules USING (rule)"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that each document names, in order."""
    return scan(table(spark, sf_dir, "documents"))


assert all(any(x in s for x in STEMS) for s in SENTENCES) and not re.search(r"[^a-z0-9 ]", "".join(SENTENCES))
