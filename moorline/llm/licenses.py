"""Licence scans by sentence rules, in DataFrame functions only.

A text is split into sentences (line ends, and . ! ? ; : before white space or the end),
each lower-cased (A-Z) with every run outside a-z0-9 made one space. Known sentences
become identifiers in order of appearance. A known sentence may be wrapped over any
lines, with comment leaders (which are outside a-z0-9) and after a list mark ("1)",
"(ii)"), as long as no blank line and none of . ! ? ; : stands inside, save where public
texts write one ("v. 2.0", "free software; you"); it begins and ends where sentences do,
and of two that begin alike the longer is taken; "*" in one stands for a name. n_sentences counts every line end.
Ordered rules then read the identifier sequence: a rule is a sequence of identifiers that
must follow each other among the known sentences; where it matches, its licence is found
and the identifiers are taken out (leaving a gap that later rules cannot bridge), so a
specific rule ahead of a general one keeps the general one from matching again.

Known are the published texts and the customary notices of MIT, BSD (2 and 3 clauses),
ISC, 0BSD, Zlib, BSL-1.0, Apache-2.0, GPL-2.0, GPL-3.0, LGPL-2.1, LGPL-3.0, AGPL-3.0,
MPL-2.0, EPL-2.0, Unlicense, WTFPL, CC0-1.0 and six CC 4.0 licences.

Everything happens inside a row: no shuffle, no broadcast, no row grows beyond its
text. Null or empty text has no sentences. Repeated rows are rows like others; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Normalised sentences of public licence texts and notices, by identifier.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("allrights", "all rights reserved"),
    ("mitname", "released under the mit license"),
    ("mitref", "licensed under the mit license"),
    ("mitgrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mitnotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("asis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apacheref", "licensed under the apache license version 2 0"),
    ("apachehead", "licensed under the apache license version 2 0 the license"),
    ("apacheuse", "you may not use this file except in compliance with the license"),
    ("apachecopy", "you may obtain a copy of the license at"),
    ("apachetitle", "apache license"),
    ("apacheversion", "version 2 0 january 2004"),
    ("apacheterms", "terms and conditions for use reproduction and distribution"),
    ("gpl3ref", "this work is licensed under the gnu general public license version 3"),
    ("gplfree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gplhope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl2free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpltitle", "gnu general public license"),
    ("lgpltitle", "gnu lesser general public license"),
    ("agpltitle", "gnu affero general public license"),
    ("june1991", "version 2 june 1991"),
    ("june2007", "version 3 29 june 2007"),
    ("february1999", "version 2 1 february 1999"),
    ("november2007", "version 3 19 november 2007"),
    ("everyone", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl21free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgplhope", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("agplfree", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("ccbync", "licensed under cc by nc 4 0"),
    ("ccby", "licensed under cc by 4 0"),
    ("ccbysa", "licensed under cc by sa 4 0"),
    ("ccbytext", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license public license"),
    ("ccbysatext", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license public license"),
    ("ccbynctext", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license public license"),
    ("ccbyndtext", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noderivatives 4 0 international public license public license"),
    ("ccbyncsatext", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial sharealike 4 0 international public license public license"),
    ("ccbyncndtext", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial noderivatives 4 0 international public license public license"),
    ("cczero", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cczerotitle", "cc0 1 0 universal"),
    ("bsdgrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsdsource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsdbinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsdname", "neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsdauthor", "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("iscgrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("iscold", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zerobsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlibasis", "this software is provided as is without any express or implied warranty"),
    ("zlibliable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlibgrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boosttitle", "boost software license version 1 0 august 17th 2003"),
    ("boostgrant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("boostref", "distributed under the boost software license version 1 0"),
    ("mpl2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl2title", "mozilla public license version 2 0"),
    ("epl2title", "eclipse public license v 2 0"),
    ("epl2terms", "the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("epl2ref", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicensegrant", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpltitle", "do what the fuck you want to public license"),
    ("wtfplcopy", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
)

#: Every known sentence holds one of these: texts without any are not looked at further.
TOKENS = ("licen", "redistribut", "permission", "reserved", "copyright", "warranty", "damages", "public", "neither the name", "version", "everyone", "terms", "anyone", "neighboring", "cc0")

#: Licence and the identifiers that must follow each other, most specific first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mitgrant", "mitnotice", "asis")),
    ("MIT", ("mitgrant", "mitnotice")),
    ("BSD-3-Clause", ("allrights", "bsdgrant", "bsdsource", "bsdbinary", "bsdname")),
    ("BSD-3-Clause", ("bsdgrant", "bsdsource", "bsdbinary", "bsdname")),
    ("BSD-3-Clause", ("allrights", "bsdgrant", "bsdsource", "bsdbinary", "bsdauthor")),
    ("BSD-3-Clause", ("bsdgrant", "bsdsource", "bsdbinary", "bsdauthor")),
    ("BSD-2-Clause", ("allrights", "bsdgrant", "bsdsource", "bsdbinary")),
    ("BSD-2-Clause", ("bsdgrant", "bsdsource", "bsdbinary")),
    ("ISC", ("iscgrant",)),
    ("ISC", ("iscold",)),
    ("0BSD", ("zerobsd",)),
    ("Zlib", ("zlibasis", "zlibliable", "zlibgrant")),
    ("BSL-1.0", ("boosttitle", "boostgrant")),
    ("BSL-1.0", ("boostgrant",)),
    ("BSL-1.0", ("boostref",)),
    ("Apache-2.0", ("apachetitle", "apacheversion", "apacheterms", "apachehead", "apacheuse", "apachecopy")),
    ("Apache-2.0", ("apachetitle", "apacheversion", "apacheterms")),
    ("Apache-2.0", ("apachehead", "apacheuse", "apachecopy")),
    ("Apache-2.0", ("apacheref", "apacheuse")),
    ("GPL-3.0", ("gpltitle", "june2007", "everyone", "gplfree", "gplhope")),
    ("GPL-3.0", ("gpltitle", "june2007", "everyone")),
    ("GPL-2.0", ("gpltitle", "june1991", "everyone", "gpltitle", "gpl2free", "gplhope")),
    ("GPL-2.0", ("gpltitle", "june1991", "everyone", "gpl2free", "gplhope")),
    ("GPL-2.0", ("gpltitle", "june1991", "everyone")),
    ("LGPL-2.1", ("lgpltitle", "february1999", "everyone", "lgpltitle", "lgpl21free", "lgplhope")),
    ("LGPL-2.1", ("lgpltitle", "february1999", "everyone", "lgpl21free", "lgplhope")),
    ("LGPL-2.1", ("lgpltitle", "february1999", "everyone")),
    ("LGPL-3.0", ("lgpltitle", "june2007", "everyone")),
    ("AGPL-3.0", ("agpltitle", "november2007", "everyone", "agplfree", "gplhope")),
    ("AGPL-3.0", ("agpltitle", "november2007", "everyone")),
    ("GPL-3.0-or-later", ("gplfree", "gplhope")),
    ("GPL-2.0-or-later", ("gpl2free", "gplhope")),
    ("AGPL-3.0-or-later", ("agplfree", "gplhope")),
    ("LGPL-2.1-or-later", ("lgpl21free", "lgplhope")),
    ("LGPL-3.0-or-later", ("lgpl3free", "lgplhope")),
    ("GPL-3.0-or-later", ("gplfree",)),
    ("GPL-2.0-or-later", ("gpl2free",)),
    ("AGPL-3.0-or-later", ("agplfree",)),
    ("LGPL-2.1-or-later", ("lgpl21free",)),
    ("LGPL-3.0-or-later", ("lgpl3free",)),
    ("GPL-3.0-only", ("gpl3ref",)),
    ("Apache-2.0", ("apacheref",)),
    ("Apache-2.0", ("apachehead",)),
    ("MIT", ("mitname",)),
    ("MIT", ("mitref",)),
    ("CC-BY-NC-4.0", ("ccbync",)),
    ("CC-BY-SA-4.0", ("ccbysa",)),
    ("CC-BY-4.0", ("ccby",)),
    ("CC-BY-4.0", ("ccbytext",)),
    ("CC-BY-SA-4.0", ("ccbysatext",)),
    ("CC-BY-NC-4.0", ("ccbynctext",)),
    ("CC-BY-ND-4.0", ("ccbyndtext",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsatext",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncndtext",)),
    ("CC0-1.0", ("cczero",)),
    ("CC0-1.0", ("cczerotitle",)),
    ("MPL-2.0", ("mpl2title", "mpl2")),
    ("MPL-2.0", ("mpl2title",)),
    ("MPL-2.0", ("mpl2",)),
    ("EPL-2.0", ("epl2title", "epl2terms")),
    ("EPL-2.0", ("epl2terms",)),
    ("EPL-2.0", ("epl2ref",)),
    ("Unlicense", ("unlicense", "unlicensegrant")),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpltitle", "wtfplcopy", "wtfpltitle")),
    ("WTFPL", ("wtfpltitle", "wtfplcopy")),
    ("All-Rights-Reserved", ("allrights",)),
)


#: Neighbouring words of known sentences between which public texts write a full stop or semicolon.
INNER_STOPS: tuple[tuple[str, str], ...] = (("v", "2"), ("software", "you"), ("foundation", "either"))

STOP = "\x01"  #: a sentence end that a mark made, while line ends stay line ends
_WRAP = rf" ?\n(?: ?{STOP})? ?"  #: one line end; a ";" at the start of a line is a comment leader
_MARK = "(?:[0-9]{1,2}|i{2,3}|iv)"  #: a list mark before a sentence
_GAP, _STOP_GAP = rf"(?: |{_WRAP})", rf"(?: |{_WRAP}| ?{STOP}(?: ?\n)?(?: ?{STOP})? ?)"


def _pattern(ids: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in ids)


def _literal(sentence: str) -> str:
    """The longest part of a known sentence without ``*``: a text without it cannot hold the sentence."""
    return max((x.strip() for x in sentence.split("*")), key=len)


def _wrapped(sentence: str) -> str:
    """Pattern of a known sentence between sentence or line ends, its words on one line or wrapped; ``*`` stands for a name of one to ten words, which may hold a full stop."""
    name = rf"[a-z0-9]+(?:{_STOP_GAP}[a-z0-9]+){{0,9}}?"
    words, inner = sentence.split(), ""
    for before, word in zip(["", *words], words):
        inner += "" if not before else _STOP_GAP if (before, word) in INNER_STOPS or before == "*" else _GAP
        inner += name if word == "*" else word
    return rf"(^|[\n{STOP}]) ?(?:{_MARK} )?{inner}( ?(?:[\n{STOP}]|\z))"


def mark_sentence(cut: Column, pattern: Column, name: Column) -> Column:
    """cut with a known sentence's occurrences replaced by its identifier. Neighbours share the end between them, so the second of two equal ones needs a second pass."""
    once = F.regexp_replace(cut, pattern, name)
    return F.regexp_replace(once, pattern, name)


def cut_text(text: Column) -> Column:
    """Words with one space between them, line ends, and STOP where a mark ends a sentence."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER + STOP, LOWER + " ")
    t = F.regexp_replace(t, r"[.!?;:]+(\s|\z)", STOP)
    return F.regexp_replace(t, rf"[^a-z0-9\n{STOP}]+", " ")


def sentences(cut: Column) -> Column:
    """Normalised, non-empty sentences of a cut text."""
    return F.filter(F.transform(F.split(cut, rf"[\n{STOP}]"), lambda s: F.trim(s)), lambda s: s != "")


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """doc_id, n_sentences, sequence (identifiers met), licenses, n_licenses, unmatched (identifiers no rule took)."""
    longest_first = sorted(known, key=lambda x: -len(x[1]))
    steps = F.array(*[F.struct(F.lit(_literal(s)).alias("text"), F.lit(_wrapped(s)).alias("pattern"), F.lit(f"$1<{i}>$2").alias("name")) for i, s in longest_first])
    table = F.array(*[F.struct(F.lit(_pattern(ids)).alias("pattern"), F.lit(lic).alias("license")) for lic, ids in rules])
    rows = docs.select("doc_id", cut_text(F.col("text")).alias("cut"))
    rows = rows.select("doc_id", "cut", sentences(F.col("cut")).alias("s"))
    rows = rows.select("doc_id", "cut", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", " ").alias("line"))
    some = F.lit(False)
    for token in TOKENS if known is SENTENCES else [_literal(s) for _, s in known]:
        some = some | F.contains("line", F.lit(token))
    marked = F.aggregate(steps, F.col("cut"), lambda acc, k: F.when(F.contains(F.col("line"), k["text"]), mark_sentence(acc, k["pattern"], k["name"])).otherwise(acc))
    ids = F.array_join(F.regexp_extract_all(marked, F.lit("<[a-z0-9]+>"), F.lit(0)), "")
    rows = rows.select("doc_id", "n_sentences", F.when(some, ids).otherwise("").alias("sequence"))
    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("found"))
    fold = F.aggregate(
        table,
        start,
        lambda acc, r: F.struct(
            F.replace(acc["rest"], r["pattern"], F.lit("|")).alias("rest"),
            F.when(F.contains(acc["rest"], r["pattern"]), F.array_append(acc["found"], r["license"])).otherwise(acc["found"]).alias("found"),
        ),
    )
    rows = rows.withColumn("fold", F.when(F.col("sequence") == "", start).otherwise(fold))
    found = F.array_distinct("fold.found")
    return rows.select("doc_id", "n_sentences", "sequence", F.array_join(found, ",").alias("licenses"), F.size(found).cast("long").alias("n_licenses"), F.replace(F.col("fold.rest"), F.lit("|"), F.lit("")).alias("unmatched"))


def scan_sql(known: tuple[tuple[str, str], ...] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> str:
    """The same in DuckDB SQL: one step for each known sentence, one for each rule."""
    steps, last = [], "s0"
    for n, (lic, ids) in enumerate(rules, start=1):
        p = _pattern(ids)
        steps.append(f"s{n} AS (SELECT doc_id, n_sentences, sequence, replace(rest, '{p}', '|') AS rest, CASE WHEN contains(rest, '{p}') THEN list_append(found, '{lic}') ELSE found END AS found FROM {last})")
        last = f"s{n}"
    marks, held = [], "cut"
    for n, (name, text) in enumerate(sorted(known, key=lambda x: -len(x[1])), start=1):
        pattern = _wrapped(text).replace(STOP, r"\x01")
        one = rf"regexp_replace(cut, '{pattern}', '\1<{name}>\2', 'g')"
        two = rf"regexp_replace({one}, '{pattern}', '\1<{name}>\2', 'g')"
        marks.append(f"m{n} AS (SELECT doc_id, n_sentences, line, CASE WHEN contains(line, '{_literal(text)}') THEN {two} ELSE cut END AS cut FROM {held})")
        held = f"m{n}"
    return rf"""
WITH raw AS (
  SELECT doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}' || chr(1), '{LOWER} '), '[.!?;:]+(\s|\z)', chr(1), 'g'), '[^a-z0-9\n\x01]+', ' ', 'g') AS cut FROM documents),
parts AS (SELECT doc_id, cut, list_filter(list_transform(string_split_regex(cut, '[\n\x01]'), lambda x: trim(x)), lambda x: x <> '') AS s FROM raw),
cut AS (SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(array_to_string(s, ' '), '') AS line, cut FROM parts),
{", ".join(marks)},
ids AS (SELECT doc_id, n_sentences, coalesce(array_to_string(regexp_extract_all(cut, '<[a-z0-9]+>'), ''), '') AS sequence FROM {held}),
s0 AS (SELECT doc_id, n_sentences, sequence, sequence AS rest, []::VARCHAR[] AS found FROM ids),
{", ".join(steps)},
uniq AS (SELECT doc_id, n_sentences, sequence, rest, list_filter(found, lambda x, i: list_position(found, x) = i) AS found FROM {last})
SELECT doc_id, n_sentences, sequence, coalesce(array_to_string(found, ','), '') AS licenses, len(found)::BIGINT AS n_licenses, replace(rest, '|', '') AS unmatched FROM uniq
"""
