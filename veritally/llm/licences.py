"""Licence recognition by sentence rules, in DataFrame functions alone.

A text is cut into sentences, which are normalised (lower case, runs of other characters than
a-z and 0-9 to one blank) and mapped to identifiers of known licence sentences. A licence is
found where the identifiers of one of its rules occur in the rule's order, with others between
them or not. Sentences that call licences by name, with a tail or not, and SPDX expressions are
taken apart into names. All of it is done within the row: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, normalised.
SENTENCES = {
    "mit-name": "released under the mit license",
    "mit-name-2": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-name": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "cc-by-nc-4-name": "licensed under cc by nc 4 0",
    "cc-by-4-name": "licensed under cc by 4 0",
    "cc-by-sa-4-name": "licensed under cc by sa 4 0",
    "bsd-intro": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: Licence, and the sentences that show it in their order.
RULES = [
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-name-2"]),
    ("MIT", ["mit-grant", "mit-asis"]),
    ("MIT", ["mit-title", "mit-asis", "mit-liability"]),
    ("Apache-2.0", ["apache-name"]),
    ("Apache-2.0", ["apache-header", "apache-see"]),
    ("Apache-2.0", ["apache-copy", "apache-see"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-name"]),
    ("CC-BY-4.0", ["cc-by-4-name"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-name"]),
    ("BSD", ["bsd-intro"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("MPL-2.0", ["mpl2-subject"]),
]
#: Sentences of unedited texts, where blank lines part them, and of more licences.
MORE_SENTENCES = {
    "mit-heading": "mit license",
    "mit-name-3": "this project is licensed under the mit license",
    "mit-name-4": "distributed under the mit license",
    "mit-grant-alone": SENTENCES["mit-grant"].split(" the above copyright")[0],
    "mit-notice": "the above copyright" + SENTENCES["mit-grant"].split(" the above copyright")[1],
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc0-title": "cc0 1 0 universal",
    "cc0-waiver": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
}
#: What tells the unedited texts of licences from notices that grant them.
MORE_SENTENCES |= {
    "gpl1-heading": "gnu general public license version 1 february 1989",
    "gpl2-heading": "gnu general public license version 2 june 1991",
    "gpl3-heading": "gnu general public license version 3 29 june 2007",
    "agpl3-heading": "gnu affero general public license version 3 19 november 2007",
    "lgpl2-heading": "gnu library general public license version 2 june 1991",
    "lgpl21-heading": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-heading": "gnu lesser general public license version 3 29 june 2007",
    "gfdl12-heading": "gnu free documentation license version 1 2 november 2002",
    "gfdl13-heading": "gnu free documentation license version 1 3 3 november 2008",
    "gpl1-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version",
    "lgpl2-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl3-adds": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "fsf-apply": "how to apply these terms to your new programs",
    "fsf-apply-library": "how to apply these terms to your new libraries",
    "gfdl-use": "addendum how to use this license for your documents",
    "artistic-title": "the artistic license",
    "artistic-package": "package refers to the collection of files distributed by the copyright holder and derivatives of that collection of files created through textual modification",
    "mpl11-title": "mozilla public license version 1 1",
    "mpl11-use": "commercial use means distribution or otherwise making the covered code available to a third party",
}
#: Other wordings of sentences above.
ALIASES = [
    ("bsd-intro", SENTENCES["bsd-intro"] + " 1"),
    ("bsd-endorse", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission 4"),
    ("bsd-asis", "this software is provided by the regents and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("fsf-apply", "appendix how to apply these terms to your new programs"),
]
MORE_RULES = [
    ("MIT", ["mit-name-3"]),
    ("MIT", ["mit-name-4"]),
    ("MIT", ["mit-grant-alone", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-heading", "mit-asis", "mit-liability"]),
    ("GPL-1.0-or-later", ["gpl1-free", "gpl-hope"]),
    ("LGPL-2.0-or-later", ["lgpl2-free", "lgpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("GPL-1.0-only", ["gpl1-heading", "fsf-apply"]),
    ("GPL-2.0-only", ["gpl2-heading", "fsf-apply"]),
    ("GPL-3.0-only", ["gpl3-heading", "fsf-apply"]),
    ("AGPL-3.0-only", ["agpl3-heading", "fsf-apply"]),
    ("LGPL-2.0-only", ["lgpl2-heading", "fsf-apply-library"]),
    ("LGPL-2.1-only", ["lgpl21-heading", "fsf-apply-library"]),
    ("LGPL-3.0-only", ["lgpl3-heading", "lgpl3-adds"]),
    ("GFDL-1.2-only", ["gfdl12-heading", "gfdl-use"]),
    ("GFDL-1.3-only", ["gfdl13-heading", "gfdl-use"]),
    ("Artistic-1.0", ["artistic-title", "artistic-package"]),
    ("MPL-1.1", ["mpl11-title", "mpl11-use"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("BSD-2-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-asis"]),
    ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("EPL-2.0", ["epl2-terms"]),
]
#: Licences whose rules hold only where this sentence isn't met.
UNLESS = {"BSD-2-Clause": "bsd-endorse"}
#: A notice that directly follows 'how to apply these terms' is an example and grants nothing.
EXAMPLE = r"(\|fsf-apply(?:-library)?\|)\|[a-z0-9]+-free\|"

#: Licences by what a sentence or a tag calls them, normalised and without 'gnu' and 'license'.
CALLED = {
    "MIT": ["mit", "expat"],
    "Apache-2.0": ["apache 2 0", "apache 2", "apache license 2 0", "apache license 2", "apache software license 2 0"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"],
    "ISC": ["isc"],
    "Zlib": ["zlib"],
    "MPL-1.1": ["mpl 1 1", "mozilla public license 1 1"],
    "MPL-2.0": ["mpl 2 0", "mozilla public license 2 0"],
    "EPL-1.0": ["epl 1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["epl 2 0", "eclipse public license 2 0"],
    "Artistic-1.0": ["artistic 1 0", "artistic license 1 0"],
    "Artistic-2.0": ["artistic 2 0", "artistic license 2 0"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero 1 0 universal"],
    "Unlicense": ["unlicense"],
    "BSL-1.0": ["bsl 1 0", "boost software license 1 0", "boost software"],
    "WTFPL": ["wtfpl"],
}
#: Families with versions: words for the family, versions.
FAMILIES = {
    "GPL": (["gpl", "general public license"], ["1.0", "2.0", "3.0"]),
    "LGPL": (["lgpl", "lesser general public license", "library general public license"], ["2.0", "2.1", "3.0"]),
    "AGPL": (["agpl", "affero general public license"], ["3.0"]),
    "GFDL": (["gfdl", "free documentation license"], ["1.1", "1.2", "1.3"]),
}
CREATIVE = ({"BY": "attribution", "NC": "noncommercial", "ND": "noderivatives", "SA": "sharealike"}, ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"], ["1.0", "2.0", "2.5", "3.0", "4.0"])


def _names() -> dict[str, str]:
    """What licences are called, to their names; a version without 'or later' is that version alone."""
    out = {c: name for name, called in CALLED.items() for c in called}
    for family, (called, versions) in FAMILIES.items():
        for c in called:
            for v in versions:
                for number in {v.replace(".", " "), v.removesuffix(".0").replace(".", " ")}:
                    out |= {f"{c} {number}": f"{family}-{v}-only", f"{c} {number} only": f"{family}-{v}-only", f"{c} {number} orlater": f"{family}-{v}-or-later"}
    words, kinds, versions = CREATIVE
    for kind in kinds:
        for v in versions:
            long = f"creative commons {' '.join(words[k] for k in kind.split('-'))} {v.replace('.', ' ')}"
            short = f"cc {kind.lower().replace('-', ' ')} {v.replace('.', ' ')}"
            out |= dict.fromkeys([short, long, f"{long} international", f"{long} unported"], f"CC-{kind}-{v}")
    return out


NAMES = _names()
#: How a sentence that names licences begins, or a tag; what may follow the names.
HEAD = r"^(?:(?:.* )?spdx license identifier |spdx |(?:(?:this|the|all) (?:[a-z]+ ){1,3}(?:is|are) )?(?:also |dual |dually )?(?:licensed|released|distributed|available|published|provided) under (?:the terms of )?(?:either (?:of )?|both )?(?:the |an? )?)"
TAIL = r" (?:see (?:the )?(?:[a-z0-9]+ )?(?:license|copying|file|readme)\b.*|https? .*)$"
#: In turn: pattern and replacement, from a sentence to the names in it, which 'or' and 'and' part.
STEPS = [("licence", "license"), (TAIL, ""), (" with [a-z0-9 ]*?exception(?: [0-9]+)*", ""), (" or (?:at your option )?(?:any )?later(?: version)?", " orlater"), (" v(?:ersion)? ?([0-9])", " {1}"), (HEAD, "")]
PARTS, STRIP = " (?:or|and) ", "^(?:the gnu |the |gnu )| license$"
#: Every rule has a sentence with one of these words; other texts are not cut at all.
CUES = ("licen", "permission", "warrant", "redistribut", "copyright", "public domain", "cc0", "anyone is free", "spdx", "released under", "distributed under", "available under", "published under", "provided under")

#: Sentences by lines, and by paragraphs whose lines are joined (licences are often wrapped).
LINES, PARAGRAPHS = r"[.!?]+\s+|\n+", r"[.!?]+\s+|\n\s*\n"


#: 'v. 2.0' is no end of a sentence, and 'GPL-2.0+' says what 'GPL-2.0-or-later' says.
FIRST = [(r"\b([vV])\.\s+([0-9])", "{1}.{2}"), (r"([0-9])\+", "{1}-or-later")]
KNOWN = [(s, k) for k, s in (SENTENCES | MORE_SENTENCES).items()] + [(s, k) for k, s in ALIASES]


def _replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by.replace("{1}", "$1").replace("{2}", "$2"))
    return c


def _identifiers(text: Column, cut: str) -> Column:
    literal = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    known, names = literal(KNOWN), literal(NAMES.items())
    normal = F.transform(F.split(_replaced(text, FIRST), cut), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    named = lambda s: F.transform(F.split(_replaced(s, STEPS), PARTS), lambda p: F.concat(F.lit("named:"), F.try_element_at(names, F.regexp_replace(p, STRIP, ""))))
    whole = lambda ids: F.when(F.exists(ids, lambda x: x.isNull()), F.array().cast("array<string>")).otherwise(ids)
    met = lambda s: F.when(F.try_element_at(known, s).isNotNull(), F.array(F.try_element_at(known, s))).when(s.rlike(HEAD), whole(named(s)))
    return F.flatten(F.filter(F.transform(normal, met), lambda x: x.isNotNull()))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentences, licences of every row of docs (doc_id, text, ...).

    sentences: the identifiers met, in order, joined by commas (of the two ways to cut the text
    the one that knows more; lines on a tie); n_sentences is their number. A sentence or SPDX tag
    that calls licences by name has one identifier, 'named:' and the licence, for each, or none
    where it joins one to something unknown. licences: the names whose rule either way satisfies,
    each once, in rule order, then those called by name, joined by commas; empty if none.
    BSD, by the opening sentence alone, stands beside the clause count that the rest tells. The
    text of a GNU licence is that version '-only': the notice in its appendix is an example.
    A null or empty text has none. Repeated rows, and rows without doc_id, are returned each.
    Other columns are ignored.
    """
    text = F.col("text").cast("string")
    cued = F.coalesce(text.rlike("(?i)" + "|".join(CUES)), F.lit(False))
    none = F.array().cast("array<string>")
    both = docs.select("doc_id", *[F.when(cued, _identifiers(text, cut)).otherwise(none).alias(name) for name, cut in (("by_line", LINES), ("by_paragraph", PARAGRAPHS))])
    seq = lambda c: F.regexp_replace(F.concat(F.lit("|"), F.array_join(c, "||"), F.lit("|")), EXAMPLE, "$1")
    both = both.select("*", seq("by_line").alias("line_seq"), seq("by_paragraph").alias("paragraph_seq"))
    met = lambda ids: "%" + "%".join(f"|{k}|" for k in ids) + "%"
    other = lambda c, name: ~F.col(c).like(met([UNLESS[name]])) if name in UNLESS else F.lit(True)
    shows = lambda c, name, ids: F.col(c).like(met(ids)) & other(c, name)
    found = [F.when(shows("line_seq", name, ids) | shows("paragraph_seq", name, ids), F.lit(name)) for name, ids in _ordered()]
    best = F.when(F.size("by_paragraph") > F.size("by_line"), F.col("by_paragraph")).otherwise(F.col("by_line"))
    called = F.transform(F.filter(F.concat("by_line", "by_paragraph"), lambda x: x.startswith("named:")), lambda x: F.substring(x, 7, 99))
    licences = F.array_distinct(F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), called))
    return both.select("doc_id", F.size(best).alias("n_sentences"), F.array_join(best, ",").alias("sentences"), F.array_join(licences, ",").alias("licences"))


def _ordered() -> list[tuple[str, list[str]]]:
    names = [name for name, _ in RULES + MORE_RULES]
    return sorted(RULES + MORE_RULES, key=lambda rule: names.index(rule[0]))


def _oracle() -> str:
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    pick = lambda pairs, x: f"({listed(v for _, v in pairs)})[list_position({listed(k for k, _ in pairs)}, {x})]"

    def replaced(x: str, steps: list[tuple[str, str]]) -> str:
        for pattern, by in steps:
            x = f"regexp_replace({x}, '{pattern}', '{by.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
        return x

    cued = f"regexp_matches(coalesce(text, ''), '(?i){'|'.join(CUES)}')"
    normal = lambda cut: f"list_transform(regexp_split_to_array({replaced('text', FIRST)}, '{cut}'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')))"
    part = replaced("p", [(STRIP, "")])
    named = f"list_transform(regexp_split_to_array({replaced('s', STEPS)}, '{PARTS}'), lambda p: 'named:' || {pick(list(NAMES.items()), part)})"
    whole = f"list_transform([{named}], lambda ids: case when len(list_filter(ids, lambda y: y is null)) > 0 then [] else ids end)[1]"
    ids = lambda cut: f"case when {cued} then flatten(list_transform({normal(cut)}, lambda s: case when list_position({listed(k for k, _ in KNOWN)}, s) is not null then [{pick(KNOWN, 's')}] when regexp_matches(s, '{HEAD}') then {whole} else [] end)) else [] end"
    seq = lambda c: f"regexp_replace('|' || array_to_string({c}, '||') || '|', '{EXAMPLE}', '{chr(92)}1', 'g')"
    like = lambda c, k: f"{c} like '%{'%'.join(f'|{i}|' for i in k)}%'"
    shows = lambda c, name, k: "(" + like(c, k) + (f" and not {like(c, [UNLESS[name]])}" if name in UNLESS else "") + ")"
    rules = ", ".join(f"case when {shows('sa', name, k)} or {shows('sb', name, k)} then '{name}' end" for name, k in _ordered())
    called = "list_transform(list_filter(list_concat(a, b), lambda x: x like 'named:%'), lambda x: x[7:])"
    return f"""
with s as (select doc_id, {ids(LINES)} as a, {ids(PARAGRAPHS)} as b from documents),
q as (select doc_id, a, b, coalesce({seq('a')}, '||') as sa, coalesce({seq('b')}, '||') as sb from s),
r as (select doc_id, case when len(b) > len(a) then b else a end as best, list_concat(list_filter([{rules}], lambda x: x is not null), {called}) as l from q)
select doc_id, cast(len(best) as int) as n_sentences, coalesce(array_to_string(best, ','), '') as sentences,
  coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') as licences from r
"""


ORACLE_SQL = _oracle()
