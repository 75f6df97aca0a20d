"""License scans by sentence rules, in DataFrame operations only.

A text is normalised to its words of letters and digits in lower case, one after the other, so line ends and other
punctuation don't matter and a sentence may be wrapped anyhow. Known licence sentences are found in that stream of words, leftmost and
longest first, and mapped to their identifiers. The identifiers found, in order, are matched against ordered rules: a rule holds where
its identifiers follow each other in that sequence. All of it happens within the row, without a shuffle. Texts without
any cue word of a known sentence (every known sentence has one) skip the look-up.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised, by identifier.
SENTENCES = {
    "apache-under": "licensed under the apache license version 2 0",
    "apache-under-long": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "mit-released": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-software": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "ccbync-under": "licensed under cc by nc 4 0",
    "ccby-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsl-name": "boost software license version 1 0",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zero-bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc0-dedicated": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law",
    "ccbysa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "all-rights": "all rights reserved",
}
# Rules by name, each a licence and its sentence identifiers in order.
RULES = {
    "apache-notice": ("Apache-2.0", ["apache-under"]),
    "apache-header": ("Apache-2.0", ["apache-under-long", "apache-comply", "apache-copy"]),
    "apache-tail": ("Apache-2.0", ["apache-basis", "apache-limits"]),
    "mit-notice": ("MIT", ["mit-released"]),
    "mit-reference": ("MIT", ["mit-under"]),
    "mit-full": ("MIT", ["mit-grant", "mit-notice", "as-is-software"]),
    "bsd-3": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    "gpl-3-notice": ("GPL-3.0-only", ["gpl3-work"]),
    "gpl-3-header": ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty", "gpl-copy"]),
    "bsd-2": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer"]),
    "gpl-3-only-header": ("GPL-3.0-only", ["gpl3-only", "gpl-warranty"]),
    "gpl-2-header": ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty"]),
    "gpl-2-only-header": ("GPL-2.0-only", ["gpl2-only", "gpl-warranty"]),
    "lgpl-2.1-header": ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-warranty"]),
    "lgpl-3-header": ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-warranty"]),
    "agpl-3-header": ("AGPL-3.0-or-later", ["agpl3-free", "gpl-warranty"]),
    "mpl-2-header": ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    "unlicense": ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    "bsl-full": ("BSL-1.0", ["bsl-grant"]),
    "bsl-name": ("BSL-1.0", ["bsl-name"]),
    "zlib-full": ("Zlib", ["zlib-warranty", "zlib-grant"]),
    "0bsd-full": ("0BSD", ["zero-bsd-grant"]),
    "cc0-deed": ("CC0-1.0", ["cc0-dedicated"]),
    "cc-by-sa-notice": ("CC-BY-SA-4.0", ["ccbysa-work"]),
    "cc-by-nc-work": ("CC-BY-NC-4.0", ["ccbync-work"]),
    "epl-2-terms": ("EPL-2.0", ["epl2-terms"]),
    "cc-by-nc-notice": ("CC-BY-NC-4.0", ["ccbync-under"]),
    "cc-by-notice": ("CC-BY-4.0", ["ccby-work"]),
    "mpl-2-form": ("MPL-2.0", ["mpl2-form"]),
    "isc-full": ("ISC", ["isc-grant"]),
    "proprietary": ("LicenseRef-all-rights-reserved", ["all-rights"]),
}
# Licences by the names that notices call them, normalised.
NAMES = {
    "0BSD": ["zero clause bsd"], "AGPL-3.0-only": ["gnu affero general public license version 3", "agpl v3"], "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0"], "Artistic-2.0": ["artistic license 2 0"],
    "BSD-2-Clause": ["2 clause bsd", "bsd 2 clause", "simplified bsd"], "BSD-3-Clause": ["3 clause bsd", "bsd 3 clause", "new bsd"], "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"], "CC0-1.0": ["creative commons zero v1 0 universal", "cc0 1 0"],
    "CC-BY-4.0": ["creative commons attribution 4 0 international license", "cc by 4 0"], "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0 international license", "cc by sa 4 0"], "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4 0 international license", "cc by nc 4 0"], "EPL-2.0": ["eclipse public license 2 0", "eclipse public license v 2 0"],
    "GPL-2.0-only": ["gnu general public license version 2", "gpl v2", "gplv2"], "GPL-3.0-only": ["gnu general public license version 3", "gpl v3", "gplv3"], "ISC": ["isc"], "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgpl v2 1"], "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgpl v3"],
    "MIT": ["mit"], "MPL-2.0": ["mozilla public license 2 0", "mozilla public license v 2 0", "mozilla public license version 2 0"], "Unlicense": ["unlicense"], "Zlib": ["zlib"],
}
# How notices begin.
PHRASES = {"licensed": "licensed under", "released": "released under", "distributed": "distributed under", "available": "available under"}
# Further SPDX identifiers that a tag may name.
TAGGED = ["AGPL-3.0-or-later", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "EPL-1.0", "MS-PL", "WTFPL", "OFL-1.1", "PSF-2.0", "BUSL-1.1"]


def normal(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def _add_notices() -> None:
    """Notices (`phrase [the] name [license]`) and SPDX tags, one sentence and one rule each, beside those listed above."""
    known = set(SENTENCES.values())

    def add(ident: str, licence: str, sentence: str) -> None:
        if sentence not in known:
            known.add(sentence)
            SENTENCES[ident] = sentence
            RULES[ident] = (licence, [ident])

    for licence, names in NAMES.items():
        for i, name in enumerate(names):
            bare = [name] if "license" in name or name == "unlicense" else [f"{name} license", *([] if name in ("mit", "isc", "zlib") else [name])]
            for verb, phrase in PHRASES.items():
                for the in (" the", ""):
                    for k, full in enumerate(bare):
                        add(f"{licence.lower()}-{verb}-{i}{k}{the.strip()}", licence, f"{phrase}{the} {full}")
    for licence in [*NAMES, *TAGGED]:
        add(f"{licence.lower()}-tag", licence, f"spdx license identifier {normal(licence)}")


_add_notices()
#: Every known sentence has one of these.
CUES = r"(?i)licen[sc]e|permission|warrant|redistribution|free\W+software|copyright|rights\W+reserved|permitted|(licensed|released|distributed|available)\W+under|public\W+domain|mpl\W|anyone"


def stream(text: Column) -> Column:
    """The words of a text, each between angle brackets."""
    return F.concat(F.lit("<"), F.regexp_replace(F.lower(text), "[^a-z0-9]+", "><"), F.lit(">"))


def _bracketed(sentence: str) -> str:
    return f"<{sentence.replace(' ', '><')}>"


def _pattern(sentences: dict[str, str]) -> str:
    """Matches any sentence in a stream of words, of two that begin alike the longer one. Common beginnings are tried once."""
    tree: dict = {}
    for sentence in sentences.values():
        at = tree
        for word in sentence.split(" "):
            at = at.setdefault(word, {})
        at[""] = {}

    def branch(node: dict) -> str:
        ways = [f"{word}>{f'<{rest}' if (rest := branch(more)) and not rest.startswith('(?:<') else rest}" for word, more in sorted(node.items()) if word]
        if not ways:
            return ""
        if "" in node:
            return f"(?:<{_any(ways)})?"
        return _any(ways)

    return f"(<{branch(tree)})"


def _any(ways: list[str]) -> str:
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_sentences, sentence_ids, rules and licenses (each comma-joined).

    Sentences are found without overlaps; sentence_ids are in text order, with repeats; rules and licenses are sorted and distinct.
    Null and empty texts and those without a known sentence have 0 and empty strings. Repeated rows give repeated results; other
    columns are ignored. Sentences of one's own must be normalised (`normal`) and distinct.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    cued = F.col("text").rlike(CUES) if sentences is SENTENCES else F.lit(True)
    known = F.create_map(*(F.lit(x) for i, s in sentences.items() for x in (_bracketed(s), i)))
    found = F.transform(F.regexp_extract_all(stream(F.col("text")), F.lit(_pattern(sentences)), F.lit(1)), lambda s: F.element_at(known, s))
    docs = docs.withColumn("ids", F.when(cued, found).otherwise(F.array().cast("array<string>")))
    order = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    table = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("license"), F.lit(f" {' '.join(ids)} ").alias("ids")) for r, (lic, ids) in sorted(rules.items())))
    docs = docs.withColumn("hits", F.when(F.size("ids") > 0, F.filter(table, lambda r: F.contains(order, r["ids"]))).otherwise(F.array().cast("array<struct<rule: string, license: string, ids: string>>")))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.transform("hits", lambda r: r["rule"]), ",").alias("rules"), F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda r: r["license"]))), ",").alias("licenses"))


def oracle() -> str:
    known = ", ".join(f"('{_bracketed(s)}', '{i}')" for i, s in SENTENCES.items())
    rules = ", ".join(f"('{r}', '{lic}', ' {' '.join(ids)} ')" for r, (lic, ids) in RULES.items())
    return rf"""
WITH known(t, id) AS (VALUES {known}), rules(rule, license, ids) AS (VALUES {rules}),
d AS (SELECT doc_id, regexp_extract_all('<' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '><', 'g') || '>', '{_pattern(SENTENCES)}', 1) AS m FROM documents),
w AS (SELECT doc_id, i, m[i] AS t FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM d)),
f AS (SELECT doc_id, count(*) AS c, string_agg(id, ' ' ORDER BY i) AS s FROM w JOIN known USING (t) GROUP BY 1),
h AS (SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS rules, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM f JOIN rules ON contains(' ' || f.s || ' ', rules.ids) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(f.c, 0) AS BIGINT) AS n_sentences, coalesce(replace(f.s, ' ', ','), '') AS sentence_ids, coalesce(h.rules, '') AS rules, coalesce(h.licenses, '') AS licenses
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN h USING (doc_id)
"""
