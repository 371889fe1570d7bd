"""Licence scans: sentence-rule recognition.

A text is cut into sentences, each is normalised and, if it is a known licence sentence, replaced
by its identifier; rules, which are ordered sequences of identifiers, are then matched against the
text's identifier sequence. Everything is a projection of built-in functions: no Python, no
shuffle, and each row stands alone.

A text is read twice: by line, where a sentence ends at a line break or at a stop, colon or semicolon before white
space; and unwrapped, where comment leaders at the beginning of lines go, single line breaks are spaces, and a sentence ends at a blank
line, before an enumerated item, or at a stop before a capital or the end of a line. A rule counts if either reading holds its sequence; the
identifiers returned are those of the reading that has more (by line, if both have as many).

Sentences are compared in a common form: lower case, runs of other signs than letters and digits as one space, without a
beginning such as "this project is", and with "released under the terms of the" and its like as "licensed under".

Edge cases: null and empty texts have no sentence and no licence; a sentence that occurs again is
kept again, in text order; a text may match several rules, listed in the rules' order; other
columns are ignored; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences that an SPDX line names.
SPDX = ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense", "Zlib", "CC0-1.0")
# Licence sentences, as letters and digits.
SENTENCES = (
    ("apache-ref", "licensed under the apache license version 2 0"),
    ("apache-ref", "licensed under the apache license version 2 0 the license"),
    ("apache-ref", "licensed under the apache 2 0 license"),
    ("apache-ref", "licensed under apache 2 0"),
    ("apache-comply", "you may not use this file except in compliance with the license"),
    ("apache-begin", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-obtain", "you may obtain a copy of the license at"),
    ("apache-obtain", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-ref", "licensed under the mit license"),
    ("mit-title", "the mit license"),
    ("mit-title", "mit license"),
    ("mit-title", "the mit license mit"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-asis", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("gpl3-ref", "licensed under the gnu general public license version 3"),
    ("gpl3-ref", "licensed under the gnu general public license v3"),
    ("gpl3-ref", "licensed under the gnu general public license v3 0"),
    ("gpl2-ref", "licensed under the gnu general public license version 2"),
    ("gpl2-ref", "licensed under the gnu general public license v2"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl21-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("lgpl-see", "see the gnu lesser general public license for more details"),
    ("agpl-see", "see the gnu affero general public license for more details"),
    ("bsd-ref", "licensed under the bsd license"),
    ("bsd2-ref", "licensed under the bsd 2 clause license"),
    ("bsd3-ref", "licensed under the bsd 3 clause license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-asis", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("mpl-ref", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-ref", "licensed under the mozilla public license version 2 0"),
    ("epl-ref", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("boost-ref", "distributed under the boost software license version 1 0"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("zlib-asis", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("cc-by-ref", "licensed under cc by 4 0"),
    ("cc-by-sa-ref", "licensed under cc by sa 4 0"),
    ("cc-by-nc-ref", "licensed under cc by nc 4 0"),
    ("cc-by-nd-ref", "licensed under cc by nd 4 0"),
    ("cc-by-long", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-long", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0-ref", "this work is dedicated to the public domain under cc0 1 0"),
    *((f"spdx-{x.lower()}", f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', x.lower())}") for x in SPDX),
)
# Fixed values: (rule, licence, sentence identifiers in order; others may stand between). A rule may have several sequences.
RULES = (
    ("apache-2.0-notice", "Apache-2.0", ("apache-ref",)),
    ("apache-2.0-header", "Apache-2.0", ("apache-ref", "apache-comply", "apache-asis", "apache-see")),
    ("apache-2.0-header", "Apache-2.0", ("apache-begin", "apache-asis", "apache-see")),
    ("mit-notice", "MIT", ("mit-ref",)),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("isc-text", "ISC", ("isc-grant", "isc-asis")),
    ("gpl-3.0-notice", "GPL-3.0", ("gpl3-ref",)),
    ("gpl-3.0-header", "GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("gpl-2.0-notice", "GPL-2.0", ("gpl2-ref",)),
    ("gpl-2.0-header", "GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ("lgpl21-free", "gpl-hope", "lgpl-see")),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "lgpl-see")),
    ("agpl-3.0-header", "AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-see")),
    ("bsd-notice", "BSD", ("bsd-ref",)),
    ("bsd-2-clause-notice", "BSD-2-Clause", ("bsd2-ref",)),
    ("bsd-3-clause-notice", "BSD-3-Clause", ("bsd3-ref",)),
    ("bsd-2-clause-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd-3-clause-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("mpl-2.0-header", "MPL-2.0", ("mpl-ref",)),
    ("epl-2.0-header", "EPL-2.0", ("epl-ref",)),
    ("bsl-1.0-notice", "BSL-1.0", ("boost-ref",)),
    ("unlicense-text", "Unlicense", ("unlicense-free",)),
    ("zlib-text", "Zlib", ("zlib-asis", "zlib-grant")),
    ("cc-by-notice", "CC-BY-4.0", ("cc-by-ref",)),
    ("cc-by-text", "CC-BY-4.0", ("cc-by-long",)),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("cc-by-sa-text", "CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("cc-by-nd-notice", "CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    ("cc0-notice", "CC0-1.0", ("cc0-ref",)),
    *((f"spdx-{x.lower()}", x, (f"spdx-{x.lower()}",)) for x in SPDX),
)
#: By line: line breaks, and a stop, colon or semicolon before white space; the colon of an SPDX line is none.
LINE, LINE_STAYS = r"([Ii]dentifier):", "{1} "
SPLIT = r"[\r\n]+|[.!?;:]+[ \t]+"
#: Unwrapped: steps (pattern, what stays of it; {n} is group n), then cut at blank lines.
UNWRAP = (
    (r"\r\n?", "\n"),
    (r"(^|\n)[ \t]*(?:[#*%;/]+|--+|<!--|REM |dnl )[ \t]*", "{1}"),
    (r"\n[ \t]*(?:\(?[0-9a-z][.)]|-)[ \t]+", "\n\n"),
    (r"([.!?][\"')]*)[ \t]*\n?[ \t]+([A-Z\"'(])", "{1}\n\n{2}"),
    (r"([.!?][\"')]*)[ \t]*\n", "{1}\n\n"),
)
PARAGRAPHS = r"\n[ \t]*\n\s*"
#: Of a sentence in letters and digits: beginnings that go, and ways to say under which licence something is.
COMMON = (
    (r"^(?:this|the|our) (?:[a-z]+ )?(?:project|software|program|library|package|file|code|work|repository|module|documentation|content) (?:is|are|was|has been) (?:also )?", ""),
    (r"^(?:released|licensed|distributed|available|published|provided|made available) under (?:the terms of )?(?:the |an? )?", "licensed under "),
)
#: No known sentence lacks all of these; a text without any is not cut (a shortcut, not a filter).
SIGNS = ("licens", "permission", "copyright", "redistribut", "warrant", "cc0", "gnu", "unencumbered")


def common(sentence: str) -> str:
    """The common form of a sentence of letters and digits."""
    for pattern, stays in COMMON:
        sentence = re.sub(pattern, stays, sentence)
    return sentence


#: Common form -> identifier.
KNOWN = {common(sentence): name for name, sentence in SENTENCES}


def _like(ids: tuple[str, ...]) -> str:
    return "%" + "".join(f"[{x}]%" for x in ids)


def _named(parts: Column) -> Column:
    """Identifiers of the known ones among some sentences, in order."""

    def form(s: Column) -> Column:
        out = F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " "))
        for pattern, stays in COMMON:
            out = F.regexp_replace(out, pattern, stays)
        return out

    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.transform(F.filter(F.transform(parts, form), lambda s: s.isin(list(KNOWN))), lambda s: known[s])


def by_line(text: Column) -> Column:
    return _named(F.split(F.regexp_replace(text, LINE, LINE_STAYS.format("", "$1")), SPLIT))


def unwrapped(text: Column) -> Column:
    for pattern, stays in UNWRAP:
        text = F.regexp_replace(text, pattern, stays.format("", "$1", "$2"))
    return _named(F.split(text, PARAGRAPHS))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_ids, rules, licences) of every row."""
    nothing = F.array().cast("array<string>")
    signs = F.lit(False)
    for sign in SIGNS:
        signs = signs | F.contains(F.lower(F.col(text_col)), F.lit(sign))
    rows = docs.select(F.col(id_col).alias("id"), F.when(signs, F.col(text_col)).alias("text"))
    rows = rows.select("id", F.coalesce(by_line(F.col("text")), nothing).alias("a"), F.coalesce(unwrapped(F.col("text")), nothing).alias("b"))
    ways = [F.concat_ws("", F.transform(c, lambda x: F.concat(F.lit("["), x, F.lit("]")))).alias(f"{c}_ids") for c in ("a", "b")]
    rows = rows.select("id", "a", "b", *ways)
    hits = F.array(*[F.when(F.col("a_ids").like(_like(ids)) | F.col("b_ids").like(_like(ids)), F.struct(F.lit(rule).alias("rule"), F.lit(licence).alias("licence"))) for rule, licence, ids in RULES])
    rows = rows.select("id", F.when(F.size("b") > F.size("a"), F.col("b")).otherwise(F.col("a")).alias("sentence_ids"), F.when((F.col("a_ids") != "") | (F.col("b_ids") != ""), hits).alias("hits"))
    rows = rows.withColumn("hits", F.coalesce(F.array_distinct(F.filter("hits", lambda x: x.isNotNull())), F.array().cast("array<struct<rule:string,licence:string>>")))
    return rows.select(F.col("id").alias(id_col), "sentence_ids", F.col("hits.rule").alias("rules"), F.array_distinct(F.col("hits.licence")).alias("licences"))
