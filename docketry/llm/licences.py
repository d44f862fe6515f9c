"""Licence scans by sentence rules, in DataFrame functions only.

A text is lower-cased, comment marks and white space are made one blank, and it is cut into sentences. Each sentence
is mapped to the identifiers of the known licence sentences it contains, in the order in which they begin there (of two
that begin at one place, the earlier in the table first); the document's identifiers, in order, are matched against ordered
licence rules, each a pattern over identifiers. A rule that matches takes its identifiers out
of the sequence, so that the rules after it see what is left; identifiers that no rule takes are reported as
unknown. A rule without a name takes out what a sentence denies ("not released under the MIT license"). Only texts and sentences with one of a few words that every sentence rule needs are looked at closely,
which changes no result.

All of it is one projection without a shuffle. ``oracle`` writes the same rules as DuckDB SQL.

Edge cases: null and empty texts have no sentences and give no row (or empty lists with ``keep_all``); texts of any
length are read to their end; repeated rows stay; further columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of which each sentence rule's matches contain at least one (held by a test).
NEEDED = ("licen", "copyright", "rights reserved", "permi", "redistribut", "warrant", "gnu", "gpl", "spdx", "cc", "creative commons", "public domain", "endorse", "mozilla", "as is", "as-is", "version", "bsd", "advertising", "wtfpl", "eupl", "psf")

# Licence sentences, as patterns over normalised text.
SENTENCES = [
    ("spdx", r"spdx-license-identifier: ?[a-z0-9.+-]+"),
    ("copyright", r"copyright (\(c\) |© ?)?[0-9]{4}"),
    ("reserved", r"all rights reserved"),
    ("mitGrant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mitNotice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mitAsIs", r"the software is provided .?as is.?, without warranty of any kind"),
    ("notMit", r"(not|never|no longer) (released|licensed|distributed|available|provided) under (the )?(terms of )?(the )?(mit|expat) licen[cs]e"),
    ("notApache", r"(not|never|no longer) licensed under the apache license,? version 2\.0"),
    ("notGnu", r"(not|never|no longer) (released|licensed|distributed|available|provided) (under|by) (the )?(terms of )?(the )?gnu (affero |lesser |library )?general public license"),
    ("mitHead", r"^ ?(the )?mit license|licen[cs]e: (the )?mit([^a-z]|$)"),
    ("mitRef", r"(released|licensed|distributed|available|provided) under (the )?(terms of the )?(mit|expat) licen[cs]e"),
    ("bsdIntro", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("bsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsdAdvert", r"all advertising materials mentioning features or use of this software must display .*permi|all advertising materials mentioning .*copyright"),
    ("bsdEndorse", r"neither the names? of .*may be used to endorse"),
    ("bsdAsIs", r"this software is provided by .*as is"),
    ("bsd2Ref", r"(2|two)[- ]clause bsd|bsd[- ](2|two)[- ]clause"),
    ("bsd3Ref", r"(3|three)[- ]clause bsd|bsd[- ](3|three)[- ]clause"),
    ("apacheRef", r"licensed under the apache license,? version 2\.0"),
    ("apacheHead", r"^ ?apache license,? (version |v\.? ?)2\.0"),
    ("apacheUse", r"you may not use this (file|work|software) except in compliance with the license"),
    ("apacheCopy", r"you may obtain a copy of the license at"),
    ("apacheBasis", r"software distributed under the license is distributed on an .?as is.? basis"),
    ("gplFree", r"this (program|library|file|software) is free software[;:] ?.*redistribut|you can redistribute it and ?(/|or| )*(or )?modify it under the terms"),
    ("agplTerms", r"(under|by) (the )?(terms of )?(the )?gnu affero general public license"),
    ("lgplTerms", r"(under|by) (the )?(terms of )?(the )?gnu (lesser|library) general public license"),
    ("gplTerms", r"(under|by) (the )?(terms of )?(the )?gnu general public license"),
    ("agplHead", r"(^ ?|: |\()(the )?gnu affero general public license,? (version |v\.? ?)[0-9]"),
    ("lgplHead", r"(^ ?|: |\()(the )?gnu (lesser|library) general public license,? (version |v\.? ?)[0-9]"),
    ("gplHead", r"(^ ?|: |\()(the )?gnu general public license,? (version |v\.? ?)[0-9]"),
    ("agpl3Later", r"(^|[^a-z0-9-])agpl[ -]?(version |v)?3(\.0)?(\+|-or-later)"),
    ("agpl3Ref", r"(^|[^a-z0-9-])agpl[ -]?(version |v)?3(\.0)?([^.0-9]|\.?$)"),
    ("lgpl21Later", r"(^|[^a-z0-9-])lgpl[ -]?(version |v)?2\.1(\+|-or-later)"),
    ("lgpl21Ref", r"(^|[^a-z0-9-])lgpl[ -]?(version |v)?2\.1([^.0-9]|\.?$)"),
    ("lgpl3Later", r"(^|[^a-z0-9-])lgpl[ -]?(version |v)?3(\.0)?(\+|-or-later)"),
    ("lgpl3Ref", r"(^|[^a-z0-9-])lgpl[ -]?(version |v)?3(\.0)?([^.0-9]|\.?$)"),
    ("gpl2Later", r"(^|[^a-z0-9-])gpl[ -]?(version |v)?2(\.0)?(\+|-or-later)"),
    ("gpl2Ref", r"(^|[^a-z0-9-])gpl[ -]?(version |v)?2(\.0)?([^.0-9]|\.?$)"),
    ("gpl3Later", r"(^|[^a-z0-9-])gpl[ -]?(version |v)?3(\.0)?(\+|-or-later)"),
    ("gpl3Ref", r"(^|[^a-z0-9-])gpl[ -]?(version |v)?3(\.0)?([^.0-9]|\.?$)"),
    ("version21", r"gnu [a-z ]*public license,? (version |v\.? ?)2\.1|version 2\.1( of the license)?"),
    ("version2", r"gnu [a-z ]*public license,? (version |v\.? ?)2(\.0)?([^.0-9]|\.?$)|version 2 of the license"),
    ("version3", r"gnu [a-z ]*public license,? (version |v\.? ?)3|version 3 of the license"),
    ("anyLater", r"(any|or) later version"),
    ("mpl11Ref", r"mozilla public license,? (version |v\.? ?)1\.1"),
    ("mplRef", r"mozilla public license,? (version |v\.? ?)2\.0"),
    ("eplRef", r"eclipse public license"),
    ("zlibAsIs", r"this software is provided .?as[- ]is.?, without any express or implied warranty"),
    ("zlibGrant", r"permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("boostGrant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boostRef", r"boost software license"),
    ("x11Name", r"except as contained in this notice, the names? of .*shall not be used in advertising"),
    ("artisticRef", r"artistic license,? (version |v)?2(\.0)?([^.0-9]|$)"),
    ("cddlRef", r"common development and distribution license"),
    ("euplRef", r"european union public licen[cs]e|(^|[^a-z])eupl([^a-z]|$)"),
    ("wtfplRef", r"do what the f[a-z*]+ you want to public license|(^|[^a-z])wtfpl([^a-z]|$)"),
    ("psfRef", r"python software foundation license|psf license agreement"),
    ("oflRef", r"sil open font license"),
    ("iscGrant", r"permission to use, copy, modify, and( ?/?or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("publicDomain", r"(dedicated|placed|released|is) (to|in|into) the public domain"),
    ("cc0", r"(^|[^a-z0-9])cc0([^a-z0-9]|$)|creative commons zero"),
    ("ccByNcSa", r"cc[- ]by-nc-sa|creative commons attribution[- ]noncommercial[- ]sharealike"),
    ("ccByNcNd", r"cc[- ]by-nc-nd|creative commons attribution[- ]noncommercial[- ]noderiv"),
    ("ccByNc", r"cc[- ]by-nc([^a-z-]|$)|creative commons attribution[- ]noncommercial([^a-z -]|$)"),
    ("ccBySa", r"cc[- ]by-sa|creative commons attribution[- ]sharealike"),
    ("ccByNd", r"cc[- ]by-nd|creative commons attribution[- ]noderiv"),
    ("ccBy", r"cc[- ]by([^a-z-]|$)|creative commons attribution([^a-z -]|$)"),
]

# Licence rules over the identifier sequence, in order; each identifier stands between blanks.
RULES = [
    ("", r" notMit mitRef "),
    ("", r" notApache apacheRef (apacheUse )?(apacheCopy )?(apacheBasis )?"),
    ("", r" notGnu (agplTerms|lgplTerms|gplTerms) (version(21|2|3) )?(anyLater )?"),
    ("Unlicense", r" unlicense (publicDomain )?"),
    ("X11", r" mitGrant (mitNotice )?(mitAsIs )?x11Name "),
    ("MIT", r" mitGrant (mitNotice )?(mitAsIs )?"),
    ("MIT", r" mitRef "),
    ("MIT", r" mitHead "),
    ("Zlib", r" (zlibAsIs )?zlibGrant "),
    ("BSL-1.0", r" (boostRef )?boostGrant (mitNotice )?(mitAsIs )?"),
    ("BSL-1.0", r" boostRef "),
    ("ISC", r" iscGrant (mitAsIs )?"),
    ("BSD-4-Clause", r" bsdIntro bsdSource bsdBinary bsdAdvert (bsdEndorse )?(bsdAsIs )?"),
    ("BSD-3-Clause", r" bsdIntro bsdSource bsdBinary bsdEndorse (bsdAsIs )?"),
    ("BSD-3-Clause", r" bsd3Ref "),
    ("BSD-2-Clause", r" bsdIntro bsdSource bsdBinary (bsdAsIs )?"),
    ("BSD-2-Clause", r" bsd2Ref "),
    ("Apache-2.0", r" apacheRef (apacheUse )?(apacheCopy )?(apacheBasis )?"),
    ("Apache-2.0", r" apacheHead "),
    ("AGPL-3.0-or-later", r" agpl3Later (agpl3Ref )?"),
    ("AGPL-3.0", r" agplHead version3 | agpl3Ref "),
    ("LGPL-2.1-or-later", r" lgpl21Later (lgpl21Ref )?"),
    ("LGPL-2.1", r" lgplHead version21 | lgpl21Ref "),
    ("LGPL-3.0-or-later", r" lgpl3Later (lgpl3Ref )?"),
    ("LGPL-3.0", r" lgplHead version3 | lgpl3Ref "),
    ("GPL-2.0-or-later", r" gplHead version2 anyLater | gpl2Later (gpl2Ref )?"),
    ("GPL-2.0", r" gplHead version2 | gpl2Ref "),
    ("GPL-3.0-or-later", r" gplHead version3 anyLater | gpl3Later (gpl3Ref )?"),
    ("GPL-3.0", r" gplHead version3 | gpl3Ref "),
    ("AGPL-3.0-or-later", r" (gplFree )?agplTerms version3 anyLater "),
    ("AGPL-3.0", r" (gplFree )?agplTerms version3 "),
    ("LGPL-2.1-or-later", r" (gplFree )?lgplTerms version21 anyLater "),
    ("LGPL-2.1", r" (gplFree )?lgplTerms version21 "),
    ("LGPL-3.0-or-later", r" (gplFree )?lgplTerms version3 anyLater "),
    ("LGPL-3.0", r" (gplFree )?lgplTerms version3 "),
    ("GPL-2.0-or-later", r" (gplFree )?gplTerms version2 anyLater "),
    ("GPL-3.0-or-later", r" (gplFree )?gplTerms version3 anyLater "),
    ("GPL-2.0", r" (gplFree )?gplTerms version2 "),
    ("GPL-3.0", r" (gplFree )?gplTerms version3 "),
    ("GPL", r" (gplFree )?gplTerms "),
    ("LGPL", r" (gplFree )?lgplTerms "),
    ("AGPL", r" (gplFree )?agplTerms "),
    ("MPL-1.1", r" mpl11Ref "),
    ("MPL-2.0", r" mplRef "),
    ("EPL", r" eplRef "),
    ("Artistic-2.0", r" artisticRef "),
    ("CDDL", r" cddlRef "),
    ("EUPL", r" euplRef "),
    ("WTFPL", r" wtfplRef "),
    ("PSF", r" psfRef "),
    ("OFL", r" oflRef "),
    ("CC0-1.0", r" cc0 (publicDomain )?"),
    ("CC-BY-NC-SA", r" ccByNcSa "),
    ("CC-BY-NC-ND", r" ccByNcNd "),
    ("CC-BY-NC", r" ccByNc "),
    ("CC-BY-SA", r" ccBySa "),
    ("CC-BY-ND", r" ccByNd "),
    ("CC-BY", r" ccBy "),
    ("SPDX", r" spdx "),
    ("public-domain", r" publicDomain "),
    ("all-rights-reserved", r" (copyright )?reserved "),
]

_BLANKS, _SHORT, _ENDS, _MARK = r"[\s*#/]+", r" v\. ", r"([.;!?]) ", "\n"


def sentences(text: str | Column) -> Column:
    one = F.regexp_replace(F.regexp_replace(F.lower(text), _BLANKS, " "), _SHORT, " v.")  # "v. 2" doesn't end a sentence
    return F.split(F.regexp_replace(one, _ENDS, "$1" + _MARK), _MARK)


def _before(pattern: str) -> str:
    """A pattern whose group is what stands before the first match."""
    return f"(?s)^(.*?)(?:{pattern})"


def _needs(text: Column) -> Column:
    out = F.lit(False)
    for word in NEEDED:
        out = out | F.contains(text, F.lit(word))
    return out


def recognise(docs: DataFrame, keep_all: bool = False) -> DataFrame:
    """id, sentence_ids, licences and unknown (arrays) for each row of ``docs`` (id, text) with a licence sentence."""
    near = F.coalesce(_needs(F.lower("text")), F.lit(False))

    def known(s: Column) -> Column:
        places = (F.when(s.rlike(p), F.struct(F.length(F.regexp_extract(s, _before(p), 1)).alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, (name, p) in enumerate(SENTENCES))
        return F.transform(F.array_sort(F.array_compact(F.array(*places))), lambda x: x["name"])

    ids = F.flatten(F.transform(F.filter(sentences("text"), _needs), known))
    none = F.array().cast("array<string>")
    out = (docs if keep_all else docs.where(near)).select("id", F.when(near, ids).otherwise(none).alias("sentence_ids"))
    if not keep_all:
        out = out.where(F.size("sentence_ids") > 0)
    # each identifier has blanks of its own, so that neighbours can be taken out alike
    out = out.withColumn("rest", F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" ")))
    for k, (name, pattern) in enumerate(RULES):
        out = out.withColumn(f"r{k}", F.when(F.col("rest").rlike(pattern), F.lit(name or None).cast("string"))).withColumn("rest", F.regexp_replace("rest", pattern, " "))
    found = F.array_distinct(F.array_compact(F.array(*(f"r{k}" for k in range(len(RULES))))))
    return out.select("id", "sentence_ids", found.alias("licences"), F.array_remove(F.split("rest", " "), "").alias("unknown"))


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of ``op7_licences``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cases = ", ".join(f"CASE WHEN regexp_matches(s, {q(p)}) THEN {{'at': length(regexp_extract(s, {q(_before(p))}, 1)), 'k': {k}, 'name': {q(n)}}} END" for k, (n, p) in enumerate(SENTENCES))
    steps, last = [], "seqs"
    for k, (name, pattern) in enumerate(RULES):
        found = f"CASE WHEN regexp_matches(rest, {q(pattern)}) THEN list_append(found, {q(name)}) ELSE found END" if name else "found"
        steps.append(f"s{k} AS (SELECT doc_id, ids, {found} AS found, regexp_replace(rest, {q(pattern)}, ' ', 'g') AS rest FROM {last})")
        last = f"s{k}"
    return f"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\\s*#/\\x0B]+', ' ', 'g'), ' v\\. ', ' v.', 'g'), '([.;!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS ss
  FROM {documents} WHERE text IS NOT NULL
), mapped AS (
  SELECT doc_id, flatten(list_transform(ss, lambda s: list_transform(list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)), lambda x: x.name))) AS ids FROM cut
), seqs AS (
  SELECT doc_id, ids, []::VARCHAR[] AS found, ' ' || array_to_string(ids, ' ') || ' ' AS rest FROM mapped WHERE len(ids) > 0
), {", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') AS licences,
  array_to_string(list_filter(string_split(rest, ' '), lambda x: x <> ''), ',') AS unknown
FROM {last}"""
