"""Licence recognition by sentence rules.

A text is cut into sentences, each normalised sentence is looked up among known licence sentences, and the sequence of
identifiers is matched against ordered rules. Everything is a column expression of one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: parts of the sentences below -----------------------------------------------------------------------
GNU_TERMS = "you can redistribute it and or modify it under the terms of the"
GNU = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "lgpl_old": "gnu library general public license", "agpl": "gnu affero general public license"}
GNU_LATER = {v: f"either version {words} of the license or at your option any later version" for v, words in (("v2", "2"), ("v21", "2 1"), ("v3", "3"))}
BSD_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
ISC_GRANT = "permission to use copy modify {} distribute this software for any purpose with or without fee is hereby granted"
ISC_KEEP = "provided that the above copyright notice and this permission notice appear in all copies"
#: Names of licences in short notices, by the identifier the notices get with a number.
SHORT = {
    "short_mit": ["the mit license", "the mit license see the license file for details", "the mit license see the license md file for details", "the mit license see the license license file for details"],
    "short_apache": ["the apache license version 2 0", "the apache license 2 0", "the apache 2 0 license"],
    "short_bsd2": ["the bsd 2 clause license"], "short_bsd3": ["the bsd 3 clause license"], "short_isc": ["the isc license"],
    "short_mpl": ["the mozilla public license version 2 0", "the mozilla public license 2 0"], "short_unlicense": ["the unlicense"],
    "short_gpl3": ["the gnu general public license version 3", "the gnu general public license v3 0"],
    "short_gpl2": ["the gnu general public license version 2", "the gnu general public license v2 0"],
    "short_lgpl21": ["the gnu lesser general public license version 2 1"], "short_lgpl3": ["the gnu lesser general public license version 3"],
    "short_agpl3": ["the gnu affero general public license version 3"],
    "short_cc_by": ["cc by 4 0", "a creative commons attribution 4 0 international license"],
    "short_cc_nc": ["cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"],
    "short_cc_sa": ["cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"],
    "short_cc_zero": ["cc0 1 0"],
}
#: Identifiers after "SPDX-License-Identifier:" in normal form, by the licence they name.
SPDX = {
    "mit": "MIT", "apache 2 0": "Apache-2.0", "bsd 4 clause": "BSD-4-Clause", "bsd 3 clause": "BSD-3-Clause",
    "bsd 2 clause": "BSD-2-Clause", "isc": "ISC", "0bsd": "0BSD", "unlicense": "Unlicense", "mpl 2 0": "MPL-2.0",
    "gpl 3 0 only": "GPL-3.0", "gpl 3 0 or later": "GPL-3.0-or-later", "gpl 2 0 only": "GPL-2.0", "gpl 2 0 or later": "GPL-2.0-or-later",
    "lgpl 3 0 only": "LGPL-3.0", "lgpl 3 0 or later": "LGPL-3.0-or-later", "lgpl 2 1 only": "LGPL-2.1",
    "lgpl 2 1 or later": "LGPL-2.1-or-later", "agpl 3 0 only": "AGPL-3.0", "agpl 3 0 or later": "AGPL-3.0-or-later",
    "cc by 4 0": "CC-BY-4.0", "cc by sa 4 0": "CC-BY-SA-4.0", "cc by nc 4 0": "CC-BY-NC-4.0", "cc0 1 0": "CC0-1.0",
}
SUBJECTS = ["", "this project is ", "this software is ", "this work is "]
# --- fixed values: licence sentences in normal form (lower case, other than letters and digits one blank) -------------
SENTENCES = {
    "mit_notice": "released under the mit license",
    "mit_short": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_notice": "licensed under the apache license version 2 0",
    "apache_the": "licensed under the apache license version 2 0 the license",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    # The notices of the GNU licences with their own marks: sentences end at "free software:" or "free software;", in older
    # notices also at "Foundation;", and at "WARRANTY;".
    "gnu_program": "this program is free software",
    "gnu_library": "this library is free software",
    **{f"{k}_terms": f"{GNU_TERMS} {name} as published by the free software foundation" for k, name in GNU.items()},
    **{f"{k}_{v}": f"{GNU_TERMS} {name} as published by the free software foundation {GNU_LATER[v]}" for k, name in GNU.items() for v in GNU_LATER},
    **{f"later_{v}": sentence for v, sentence in GNU_LATER.items()},
    "gpl2_only": f"{GNU_TERMS} gnu general public license version 2 as published by the free software foundation",
    "gnu_useful": "this program is distributed in the hope that it will be useful but without any warranty",
    "gnu_library_useful": "this library is distributed in the hope that it will be useful but without any warranty",
    "gnu_even": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_ads": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    # What follows "nor the names of", where a sentence ends too: before it stands the holder's name.
    "bsd_names": f"its contributors {BSD_ENDORSE}",
    "bsd_names_of": f"contributors {BSD_ENDORSE}",
    "bsd_author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl_form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl_form2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl_copys": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "isc_grant": f"{ISC_GRANT.format('and or')} {ISC_KEEP}",
    "isc_old": f"{ISC_GRANT.format('and')} {ISC_KEEP}",
    "zero_bsd": ISC_GRANT.format("and or"),
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "cc_zero": "licensed under cc0 1 0",
    "reserved": "all rights reserved",
    "spdx": "spdx license identifier",
    **{f"spdx_{name.replace(' ', '_')}": name for name in SPDX},
}
for _key, _names in SHORT.items():
    _all = [f"{subject}{verb} under {name}" for name in _names for verb in ("licensed", "released") for subject in SUBJECTS]
    SENTENCES |= {f"{_key}_{k}": x for k, x in enumerate(_all) if x not in SENTENCES.values()}


def short(key: str, *others: str) -> str:
    """Any of the short notices of a licence, or one of the other identifiers."""
    return f"({'|'.join([*others, f'{key}_[0-9]+'])})"


def without_next(last: str, *unwanted: str) -> str:
    """An identifier that none of the unwanted ones follows directly; stands last in a rule."""
    return f"{last}(,$|,({'|'.join(k for k in SENTENCES if k not in unwanted)}))"


def gnu(kind: str, version: str, *whole: str) -> list[str]:
    """The notice of a GNU licence: its terms and version in one sentence or two, then the end of the warranty's."""
    return [f"({'|'.join([f'{kind}_terms,later_{version}', f'{kind}_{version}', *whole])})", "(gnu_even|gpl_hope)"]


# --- fixed values: licence, class, identifiers that must occur in this order; "a,b" are neighbours, "(a|b)" is either --
BSD_NAMES = "(bsd_names|bsd_names_of|bsd_author)"
# Before the sentences of a licence this one belongs to the copyright notice: it counts only where none follows it.
LAST = ["reserved"]
RULES = [
    ("MIT", "permissive", [short("short_mit", "mit_notice", "mit_short")]), ("MIT", "permissive", ["mit_grant", "mit_keep"]),
    ("Apache-2.0", "permissive", [short("short_apache", "apache_notice")]), ("Apache-2.0", "permissive", ["apache_the", "apache_use"]),
    ("BSD-4-Clause", "permissive", ["bsd_grant", "bsd_source", f"bsd_binary,bsd_ads,{BSD_NAMES}"]),
    ("BSD-3-Clause", "permissive", ["bsd_grant", "bsd_source", f"bsd_binary,{BSD_NAMES}"]), ("BSD-3-Clause", "permissive", [short("short_bsd3")]),
    ("BSD-2-Clause", "permissive", ["bsd_grant", "bsd_source", without_next("bsd_binary", "bsd_ads", "bsd_names", "bsd_names_of", "bsd_author")]),
    ("BSD-2-Clause", "permissive", [short("short_bsd2")]),
    ("ISC", "permissive", [short("short_isc", "isc_grant", "isc_old")]), ("0BSD", "permissive", ["zero_bsd"]),
    ("Unlicense", "permissive", [short("short_unlicense", "unlicense")]),
    ("MPL-2.0", "copyleft", [short("short_mpl", "mpl_form2")]), ("MPL-2.0", "copyleft", ["mpl_form", "(mpl_copy|mpl_copys)"]),
    ("GPL-3.0", "copyleft", [short("short_gpl3", "gpl3_notice")]), ("GPL-3.0-or-later", "copyleft", gnu("gpl", "v3", "gpl_free")),
    ("GPL-2.0", "copyleft", [short("short_gpl2", "gpl2_only")]), ("GPL-2.0-or-later", "copyleft", gnu("gpl", "v2", "gpl2_free")),
    ("LGPL-3.0", "copyleft", [short("short_lgpl3")]), ("LGPL-3.0-or-later", "copyleft", gnu("lgpl", "v3")),
    ("LGPL-2.1", "copyleft", [short("short_lgpl21")]), ("LGPL-2.1-or-later", "copyleft", gnu("lgpl", "v21")),
    ("LGPL-2.0-or-later", "copyleft", gnu("lgpl_old", "v2")),
    ("AGPL-3.0", "copyleft", [short("short_agpl3")]), ("AGPL-3.0-or-later", "copyleft", gnu("agpl", "v3")),
    ("CC-BY-NC-4.0", "noncommercial", [short("short_cc_nc", "cc_by_nc")]), ("CC-BY-4.0", "permissive", [short("short_cc_by", "cc_by")]),
    ("CC-BY-SA-4.0", "copyleft", [short("short_cc_sa", "cc_by_sa")]), ("CC0-1.0", "permissive", [short("short_cc_zero", "cc_zero")]),
    ("Proprietary", "reserved", LAST),
]
_class = {name: kind for name, kind, _ in RULES}
RULES[-1:-1] = [(name, _class[name], [f"spdx,spdx_{words.replace(' ', '_')}"]) for words, name in SPDX.items()]
#: What stands between a holder's name and "its contributors", in any line layout.
NOR = r"|[Nn][Oo][Rr][ \t\r\n*#/]+[Tt][Hh][Ee][ \t\r\n*#/]+[Nn][Aa][Mm][Ee][Ss]?[ \t\r\n*#/]+[Oo][Ff][ \t\r\n]"
#: Where sentences end when line ends count as ends, and when only blank lines do (wrapped notices).
ENDS = {"line": r"[.!?;:][ \t\r\n]|\n" + NOR, "wrapped": r"[.!?;:][ \t\r\n]|\n[ \t\r]*\n" + NOR}


def sentence_ids(text: Column, ends: str) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    # One pass marks the ends, one turns all but ASCII letters, digits and marks into single blanks.
    marked = F.regexp_replace(F.regexp_replace(text, ends, "\u0001"), "[^A-Za-z0-9\u0001]+", " ")
    known = F.create_map(*[F.lit(x) for k, s in SENTENCES.items() for x in (s, k)])
    looked_up = F.transform(F.split(F.lower(marked), "\u0001"), lambda s: F.try_element_at(known, F.trim(s)))
    return F.filter(looked_up, lambda k: k.isNotNull())


def rule_pattern(ids: list[str]) -> str:
    """A regex over ``,id,id,`` that holds where the identifiers occur in this order, others between them or not."""
    return f",{',(.*,)?'.join(ids)}(,|$)"


def scan_licences(docs: DataFrame) -> DataFrame:
    """``doc_id, line_ids, wrapped_ids, licences, licence_classes`` for every row; all but the id are comma lists.

    ``line_ids`` are the sentences found with line ends as sentence ends, ``wrapped_ids`` those found where only blank
    lines end one; a rule that holds for either sequence counts.
    "All rights reserved." makes a text proprietary only as the last known sentence of each sequence that has any: before
    the sentences of a licence it belongs to the copyright notice.
    ``licences`` and ``licence_classes`` are distinct, in the order of the rules. Letters outside ASCII separate words.

    Defined results: null and empty texts have no sentences; repeated rows and ids are judged row by row; an empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *[sentence_ids(text, e).alias(name) for name, e in ENDS.items()])
    chain = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    rows = rows.select("doc_id", *[F.array_join(k, ",").alias(f"{k}_ids") for k in ENDS], chain(F.col("line")).alias("_l"), chain(F.col("wrapped")).alias("_w"))

    def hit(ids: list[str]) -> Column:
        line, wrapped = (F.col(c).rlike(f",{ids[0]},$" if ids is LAST else rule_pattern(ids)) for c in ("_l", "_w"))
        either = line | wrapped
        return either & (line | (F.col("_l") == ",,")) & (wrapped | (F.col("_w") == ",,")) if ids is LAST else either

    found = lambda at: F.array_join(F.array_distinct(F.filter(F.array(*[F.when(hit(r[2]), F.lit(r[at])) for r in RULES]), lambda x: x.isNotNull())), ",")
    return rows.select("doc_id", "line_ids", "wrapped_ids", found(0).alias("licences"), found(1).alias("licence_classes"))


def scan_sql() -> str:
    """The same scan as DuckDB SQL over the table ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(k)}" for k, s in SENTENCES.items()) + "}"
    ids = lambda ends: (
        "list_filter(list_transform(string_split(lower(regexp_replace(regexp_replace(coalesce(text, ''), "
        f"{quoted(ends)}, chr(1), 'g'), '[^A-Za-z0-9\\x01]+', ' ', 'g')), chr(1)), lambda s: element_at({known}, trim(s))[1]), lambda k: k IS NOT NULL)"
    )

    def hit(rule: tuple[str, str, list[str]]) -> str:
        pattern = quoted(f",{rule[2][0]},$" if rule[2] is LAST else rule_pattern(rule[2]))
        either = f"(regexp_matches(l, {pattern}) OR regexp_matches(w, {pattern}))"
        every = "".join(f" AND ({c} = ',,' OR regexp_matches({c}, {pattern}))" for c in "lw")
        return f"({either}{every})" if rule[2] is LAST else either

    # Distinct in rule order: a value counts at its first rule only.
    found = lambda at: "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN ({' OR '.join(hit(r) for r in RULES if r[at] == v)}) THEN {quoted(v)} END" for v in dict.fromkeys(r[at] for r in RULES)
    ) + "], lambda x: x IS NOT NULL), ',')"
    return f"""
WITH cutting AS (SELECT doc_id, {ids(ENDS['line'])} AS li, {ids(ENDS['wrapped'])} AS wi FROM documents),
chained AS (
  SELECT doc_id, ',' || array_to_string(li, ',') || ',' AS l, ',' || array_to_string(wi, ',') || ',' AS w, li, wi FROM cutting)
SELECT doc_id, array_to_string(li, ',') AS line_ids, array_to_string(wi, ',') AS wrapped_ids, {found(0)} AS licences, {found(1)} AS licence_classes FROM chained"""
