"""Licence scans by sentence rules.

A text is cut into sentences; those that may speak of licensing are normalised (lower case, letters,
digits, dots and plus signs, single blanks) and mapped to identifiers of known licence sentences, or
UNKNOWN. The document's identifiers in order are matched against licence rules, each a pattern over
identifiers, tried in order; what a rule matches is consumed, so that the parts of a long licence
text don't count again. An SPDX line carries its expression in its identifier. Tables and rules are
below; the SQL for DuckDB is made from SENTENCES and RULES, but stays as given: it knows the words of
_OLD_HINT only, neither TEXTS nor FULL nor SPDX expressions, and matches line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read_table
from tessera.llm.quality_rules import _let

#: Ends of sentences where every line stands for itself, and words without which a sentence says nothing about licensing.
ENDS = r"[.!?;]+(?:[\x20\x09-\x0D]+|\z)|\n+"
_OLD_HINT = r"licen[sc]|copyright|\(c\)|©|spdx|warrant|permission|permitted|redistribut|public domain|all rights reserved|gnu general|merchantab|liable|unlicense"
#: Between words of a text that isn't normalised yet.
_GAP = r"[^a-z0-9.+]+"
HINT = rf"{_OLD_HINT}|gpl|cc{_GAP}by|cc0|cc{_GAP}zero|creative{_GAP}commons|public{_GAP}domain|all{_GAP}rights{_GAP}reserved|proprietary|unauthori[sz]ed{_GAP}copying|software{_GAP}is{_GAP}provided|used{_GAP}to{_GAP}endorse"

#: Ends of sentences in wrapped texts: punctuation, blank lines (with marks of comments, too), and newlines before list marks.
WRAPPED_ENDS = r"[.!?;]+(?:[\x20\x09-\x0D]+|\z)|\n[\x20\x09\x0D*#/]*\n[\x20\x09-\x0D]*|\n(?=[\x20\x09*#/]*(?:-|\(?(?:[0-9]{1,2}|[a-z])[.)])[\x20\x09])"
#: A line of copyright, which ends with its line.
OWN_LINE = r"(?im)^([\x20\x09*#/]*copyright[\x20\x09]+(?:\(c\)|©|[0-9]{4})[^\n]*)\n"
#: A line with an SPDX identifier stands by itself; the expression that it gives.
SPDX_LINE = r"(?im)^([^\n]*spdx-licen[sc]e-identifier:[^\n]*)$"
SPDX_OF = r"(?i)spdx-licen[sc]e-identifier:[\x20\x09]*([a-z0-9.+()-]+(?:[\x20\x09]+(?:and|or|with)[\x20\x09]+[a-z0-9.+()-]+)*)"
#: Grants begin a sentence, also where a line of copyright runs into them.
OPENINGS = r"(?i)([^\n])(permission is hereby granted, free of charge|permission to use, copy, modify,? and|redistribution and use in source and binary forms)"

_UNDER = r"(?:(?:this|the) (?:\w+ )?(?:work|file|software|program|project|code|library|document|package|text|content|material|article|page) (?:is|are) )?(?:also )?(?:licensed|released|distributed|available|made available|published|provided|free to use|redistributable)?(?: and distributed)? ?(?:under|subject to|governed by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
_END = r"(?: or (?:at your option )?any later version)?(?: see .*| \(?the license\)?)?$"

#: Known sentences: identifier and pattern of the normalised sentence. Fixed values, tried in this order.
SENTENCES = [
    ("SPDX", r"^.*spdx license identifier [a-z0-9.+ -]+$"),
    ("Copyright", r"^(?:portions |all code |this .{0,20} is )?copyright(?: c)?(?: .*)?$|^c (?:19|20)[0-9]{2} .*$"),
    ("AllRights", r"^(?:.{0,80} )?all rights reserved$"),
    ("MITref", rf"^{_UNDER}(?:mit|expat|x11) licen[sc]e(?: mit)?{_END}"),
    ("ApacheRef", rf"^{_UNDER}apache (?:software )?licen[sc]e(?: v(?:ersion)? ?2(?:.0)?| 2.0)?(?: apache 2.0)?{_END}"),
    ("AGPLref", rf"^{_UNDER}gnu affero general public licen[sc]e(?: (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?3)?{_END}"),
    ("LGPLref", rf"^{_UNDER}gnu (?:lesser|library) general public licen[sc]e(?: (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?(?:2|2.1|3))?{_END}"),
    ("GPL2ref", rf"^{_UNDER}(?:gnu general public licen[sc]e|gpl)(?: (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?2){_END}"),
    ("GPL3ref", rf"^{_UNDER}(?:gnu general public licen[sc]e|gpl)(?: (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?3){_END}"),
    ("GPLref", rf"^{_UNDER}(?:gnu general public licen[sc]e|gnu gpl|gpl){_END}"),
    ("BSD2ref", rf"^{_UNDER}(?:bsd 2 clause|simplified bsd|2 clause bsd) licen[sc]e{_END}"),
    ("BSD3ref", rf"^{_UNDER}(?:bsd 3 clause|new bsd|3 clause bsd|modified bsd) licen[sc]e{_END}"),
    ("BSDref", rf"^{_UNDER}bsd(?: style)? licen[sc]e{_END}"),
    ("MPLref", rf"^{_UNDER}mozilla public licen[sc]e(?: v(?:ersion)? ?(?:1.1|2.0))?{_END}"),
    ("EPLref", rf"^{_UNDER}eclipse public licen[sc]e(?: v(?:ersion)? ?(?:1.0|2.0))?{_END}"),
    ("ISCref", rf"^{_UNDER}isc licen[sc]e{_END}"),
    ("CC0ref", rf"^{_UNDER}(?:cc0|creative commons zero|cc zero)(?: licen[sc]e)?(?: 1.0)?(?: universal)?{_END}"),
    ("CCBYNCNDref", rf"^{_UNDER}(?:cc by nc nd|creative commons attribution noncommercial noderiv(?:ative)?s)(?: [0-9.]+)?(?: international| unported)?(?: licen[sc]e)?{_END}"),
    ("CCBYNCSAref", rf"^{_UNDER}(?:cc by nc sa|creative commons attribution noncommercial sharealike)(?: [0-9.]+)?(?: international| unported)?(?: licen[sc]e)?{_END}"),
    ("CCBYNCref", rf"^{_UNDER}(?:cc by nc|creative commons attribution non ?commercial)(?: [0-9.]+)?(?: international| unported)?(?: licen[sc]e)?{_END}"),
    ("CCBYNDref", rf"^{_UNDER}(?:cc by nd|creative commons attribution noderiv(?:ative)?s)(?: [0-9.]+)?(?: international| unported)?(?: licen[sc]e)?{_END}"),
    ("CCBYSAref", rf"^{_UNDER}(?:cc by sa|creative commons attribution share ?alike)(?: [0-9.]+)?(?: international| unported)?(?: licen[sc]e)?{_END}"),
    ("CCBYref", rf"^{_UNDER}(?:cc by|creative commons attribution)(?: [0-9.]+)?(?: international| unported)?(?: licen[sc]e)?{_END}"),
    ("MITgrant", r"^permission is hereby granted free of charge to any person obtaining a copy .*"),
    ("MITnotice", r"^the above copyright notice and this permission notice shall be included .*"),
    ("ISCgrant", r"^permission to use copy modify and or distribute this software for any purpose .*"),
    ("AsIs", r"^(?:the|this) software is provided .{0,40}as is .*|^.*without warrant(?:y|ies) (?:or conditions )?of any kind.*"),
    ("NoLiability", r"^in no event shall .* be liable .*"),
    ("BSDgrant", r"^redistribution and use in source and binary forms .*"),
    ("BSDsource", r"^(?:[0-9] )?redistributions of source code must retain .*"),
    ("BSDbinary", r"^(?:[0-9] )?redistributions in binary form must reproduce .*"),
    ("BSDendorse", r"^(?:[0-9] )?neither the name of .* may be used to endorse .*"),
    ("ApacheGrant", r"^licensed under the apache license version 2.0 the license .*"),
    ("ApacheCopy", r"^you may (?:not use this file except in compliance with|obtain a copy of) the license.*"),
    ("GPLfree", r"^this program is free software you can redistribute it .*"),
    ("GPLcopy", r"^you should have received a copy of the gnu (?:lesser |affero )?general public license .*"),
    ("PublicDomain", r"^.*(?:in|into|to) the public domain$"),
    ("Proprietary", r"^.*(?:proprietary and confidential|unauthori[sz]ed copying .*)$"),
]

_GRANT = r"^(?:this (?:program|library|software|file) is free software )?you can redistribute it .* gnu "
_CC = rf"^{_UNDER}(?:an? )?creative commons attribution"
_CC_END = r"(?: [0-9.]+)?(?: international| unported)?(?: licen[sc]e)?$"
#: Sentences of whole licence texts and notices, and their titles; tried before the others, by Spark only: the SQL stays as given. Fixed values.
TEXTS = [
    ("AGPLref", rf"{_GRANT}affero general public licen[sc]e .*"),
    ("LGPL21ref", rf"{_GRANT}(?:lesser|library) general public licen[sc]e .*version 2.1(?: .*)?$"),
    ("LGPL2ref", rf"{_GRANT}(?:lesser|library) general public licen[sc]e .*version 2(?: .*)?$"),
    ("LGPL3ref", rf"{_GRANT}(?:lesser|library) general public licen[sc]e .*version 3(?: .*)?$"),
    ("LGPLref", rf"{_GRANT}(?:lesser|library) general public licen[sc]e .*"),
    ("GPL2ref", rf"{_GRANT}general public licen[sc]e .*version 2(?: .*)?$"),
    ("GPL3ref", rf"{_GRANT}general public licen[sc]e .*version 3(?: .*)?$"),
    ("GPLhope", r"^(?:this|the) .{0,60}is distributed in the hope that it will be useful .*"),
    ("GPLwarranty", r"^without even the implied warranty of merchantability .*"),
    ("GPLdetails", r"^see the gnu (?:lesser |library |affero )?general public licen[sc]e .*"),
    ("GPLcopy", r"^you should have received a copy of the gnu library general public licen[sc]e .*"),
    ("GPLsee", r"^if not (?:see|write to) .*(?:gnu|free software foundation).*"),
    ("MITtitle", r"^(?:the )?(?:mit|expat) licen[sc]e(?: mit)?$"),
    ("ISCtitle", r"^(?:the )?isc licen[sc]e(?: isc)?$"),
    ("BSD2title", r"^(?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd) licen[sc]e$"),
    ("BSD3title", r"^(?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) licen[sc]e$"),
    ("ApacheTitle", r"^apache licen[sc]e version 2.0(?: january 2004.*)?$"),
    ("AGPLtitle", r"^gnu affero general public licen[sc]e version 3(?: 19 november 2007.*)?$"),
    ("LGPL21title", r"^gnu lesser general public licen[sc]e version 2.1(?: february 1999.*)?$"),
    ("LGPL3title", r"^gnu lesser general public licen[sc]e version 3(?: 29 june 2007.*)?$"),
    ("GPL2title", r"^gnu general public licen[sc]e version 2(?: june 1991.*)?$"),
    ("GPL3title", r"^gnu general public licen[sc]e version 3(?: 29 june 2007.*)?$"),
    ("MPL2form", r"^this source code form is subject to the terms of the mozilla public licen[sc]e .*|^mozilla public licen[sc]e version 2.0$"),
    ("EPL1form", r"^.{0,100}made available under the (?:terms of the )?eclipse public licen[sc]e (?:v(?:ersion)? ?)?1.0.*|^eclipse public licen[sc]e v(?:ersion)? ?1.0$"),
    ("EPL2form", r"^.{0,100}made available under the (?:terms of the )?eclipse public licen[sc]e (?:v(?:ersion)? ?)?2.0.*|^eclipse public licen[sc]e v(?:ersion)? ?2.0$"),
    ("UnlicenseGrant", r"^this is free and unencumbered software released into the public domain$"),
    ("CC0waiver", r"^to the extent possible under law .*(?:cc0|creative commons zero).*"),
    ("CCBYNCNDref", rf"{_CC} non ?commercial no ?deriv(?:ative)?s{_CC_END}"),
    ("CCBYNCSAref", rf"{_CC} non ?commercial share ?alike{_CC_END}"),
    ("CCBYNCref", rf"{_CC} non ?commercial{_CC_END}"),
    ("CCBYNDref", rf"{_CC} no ?deriv(?:ative)?s{_CC_END}"),
    ("CCBYSAref", rf"{_CC} share ?alike{_CC_END}"),
    ("CCBYref", rf"{_CC}{_CC_END}"),
    ("ZlibGrant", r"^permission is granted to anyone to use this software for any purpose including commercial applications .*"),
    ("BSLtitle", r"^boost software licen[sc]e version 1.0(?: august 17th 2003)?$"),
    ("BSLgrant", r"^permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation .*"),
    ("AsIs", r"^(?:the|this) software is provided by .{0,200}as is .*"),
    ("NoLiability", r"^in no event will .* be (?:held )?liable .*"),
]
#: Patterns that take in whatever stands before or after them: other lines are not joined to these.
OPEN = ["Copyright", "AllRights", "SPDX", "PublicDomain", "Proprietary"]

_OWN = r"(?:Copyright |AllRights )*"
_MORE = r"(?:GPLhope |GPLwarranty |GPLdetails |GPLcopy |GPLsee |AsIs )"
_NONE = r"(?:AsIs |NoLiability )*"
#: Rules over identifiers of TEXTS, tried before the others, by Spark only: the SQL stays as given. Fixed values.
FULL = [
    ("MIT", rf" MITtitle {_OWN}(?:MITgrant (?:MITnotice )?{_NONE})?"),
    ("ISC", rf" ISCtitle {_OWN}(?:ISCgrant {_NONE})?"),
    ("BSD-3-Clause", rf" (?:BSD3title {_OWN}(?:BSDgrant BSDsource BSDbinary (?:BSDendorse )?)?|{_OWN}BSDgrant BSDsource BSDbinary BSDendorse (?=AsIs ))(?:UNKNOWN )?{_NONE}"),
    ("BSD-2-Clause", rf" BSD2title {_OWN}(?:BSDgrant BSDsource BSDbinary )?{_NONE}"),
    ("Apache-2.0", rf" ApacheTitle {_OWN}"),
    ("AGPL-3.0", rf" (?:AGPLtitle |(?:GPLfree )?AGPLref {_MORE}+)"),
    ("LGPL-2.1", rf" (?:LGPL21title |(?:GPLfree )?LGPL21ref {_MORE}*)"),
    ("LGPL-3.0", rf" (?:LGPL3title |(?:GPLfree )?LGPL3ref {_MORE}*)"),
    ("LGPL-2.0", rf" (?:GPLfree )?LGPL2ref {_MORE}*"),
    ("LGPL", rf" (?:GPLfree )?LGPLref {_MORE}+"),
    ("GPL-2.0", rf" (?:GPL2title |(?:GPLfree )?GPL2ref {_MORE}+)"),
    ("GPL-3.0", rf" (?:GPL3title |(?:GPLfree )?GPL3ref {_MORE}+)"),
    ("MPL-2.0", r" MPL2form "),
    ("EPL-1.0", r" EPL1form "),
    ("EPL-2.0", r" EPL2form "),
    ("Unlicense", rf" UnlicenseGrant {_NONE}"),
    ("CC0-1.0", r" CC0waiver "),
    ("Zlib", rf" {_OWN}{_NONE}ZlibGrant "),
    ("BSL-1.0", rf" (?:BSLtitle (?:BSLgrant )?|BSLgrant ){_NONE}"),
]
#: Licence rules: licence and pattern over " identifier identifier ... ", tried in this order. Fixed values.
RULES = [
    ("MIT", rf" {_OWN}(?:MITref {_OWN})?MITgrant (?:MITnotice )?(?:AsIs )?(?:NoLiability )?"),
    ("ISC", rf" {_OWN}ISCgrant (?:AsIs )?(?:NoLiability )?"),
    ("BSD-3-Clause", rf" {_OWN}BSDgrant BSDsource BSDbinary BSDendorse (?:AsIs )?(?:NoLiability )?"),
    ("BSD-2-Clause", rf" {_OWN}BSDgrant BSDsource BSDbinary (?:AsIs )?(?:NoLiability )?"),
    ("Apache-2.0", rf" {_OWN}(?:ApacheGrant|ApacheRef) (?:ApacheCopy )*(?:AsIs )?"),
    ("AGPL-3.0", r" (?:GPLfree )?AGPLref (?:AsIs )?(?:GPLcopy )?"),
    ("LGPL", r" (?:GPLfree )?LGPLref (?:AsIs )?(?:GPLcopy )?"),
    ("GPL-2.0", r" (?:GPLfree )?GPL2ref (?:AsIs )?(?:GPLcopy )?"),
    ("GPL-3.0", r" (?:GPLfree )?GPL3ref (?:AsIs )?(?:GPLcopy )?"),
    ("GPL", r" (?:GPLfree (?:AsIs )?(?:GPLcopy )?|GPLref |GPLcopy )"),
    ("MIT", r" MITref "),
    ("BSD-2-Clause", r" BSD2ref "),
    ("BSD-3-Clause", r" BSD3ref "),
    ("BSD", r" (?:BSDref|BSDgrant) "),
    ("MPL", r" MPLref "),
    ("EPL", r" EPLref "),
    ("ISC", r" ISCref "),
    ("CC0-1.0", r" CC0ref "),
    ("CC-BY-NC-ND", r" CCBYNCNDref "),
    ("CC-BY-NC-SA", r" CCBYNCSAref "),
    ("CC-BY-NC", r" CCBYNCref "),
    ("CC-BY-ND", r" CCBYNDref "),
    ("CC-BY-SA", r" CCBYSAref "),
    ("CC-BY", r" CCBYref "),
    ("SPDX", r" SPDX "),
    ("Public-Domain", r" PublicDomain "),
    ("Proprietary", rf" {_OWN}(?:Proprietary |AllRights )"),
]


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence sentences and licences of every row of docs.

    Returns (doc_id, n_sentences, n_unknown long, sentences, licences string): identifiers in order,
    between blanks; licences in the order of the rules, then the expressions of SPDX lines, each once,
    between commas. Texts without licence sentences, null and empty ones included, have no sentences
    and empty strings. One row for each input row, whatever its id, repeated ones included; other
    columns are not read, whatever their names. Whole texts are read, however long. An empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def identified(s):
        case = F
        for name, pattern in TEXTS + SENTENCES:
            case = case.when(s.rlike(pattern), name)
        return case.otherwise("UNKNOWN")

    def expression(s):
        """The SPDX identifier of a sentence, its expression within it as one word, or the one without an expression."""
        plain = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, SPDX_OF, 1), r"[\x20\x09]+", "_"), r"^\(([^()]*)\)$", "$1")
        return F.when(plain != "", F.concat(F.lit("SPDX:"), plain)).otherwise("SPDX")

    def named(s):
        return F.when(F.lower(s).rlike("spdx-licen[sc]e-identifier:"), expression(s)).otherwise(known(s))

    def known(s):
        return identified(F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9.+]+", " "), r"[.]+( |\z)", "$1")))

    def hinted(text, ends):
        return F.filter(F.split(text, ends), lambda s: F.lower(s).rlike(HINT))

    def chosen(whole, lines):
        known = F.array_distinct(F.filter(lines, lambda x: x != "UNKNOWN"))
        as_whole = (whole != "UNKNOWN") & ((F.size(known) == 0) | (~whole.isin(OPEN) & (F.size(known) == 1)))
        return F.when(as_whole | (F.size(lines) == 0), F.array(whole)).otherwise(lines)

    def sentence(s):
        """Identifiers of a sentence over lines: its own, unless its lines are notices by themselves."""
        both = F.struct(named(s).alias("whole"), F.transform(hinted(s, r"\n+"), named).alias("lines"))
        return F.when(F.contains(s, F.lit("\n")), _let(both, lambda x: chosen(x["whole"], x["lines"]))).otherwise(F.array(named(s)))

    cut = F.regexp_replace(F.regexp_replace("text", OWN_LINE, "$1\n\n"), OPENINGS, "$1\n\n$2")
    cut = F.when(F.lower(cut).rlike("spdx-licen[sc]e-identifier:"), F.regexp_replace(cut, SPDX_LINE, "\n\n$1\n\n")).otherwise(cut)
    sentences = hinted(cut, WRAPPED_ENDS)
    found = F.when(F.lower("text").rlike(HINT), F.flatten(F.transform(sentences, sentence))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", found.alias("ids"))
    # a pattern only looks back at the blank before it, so that neighbours are consumed one by one
    rows = rows.withColumn("rest", F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" ")))
    names = []
    for k, (licence, pattern) in enumerate(FULL + RULES):
        after = "(?<= )" + pattern[1:]
        rows = rows.withColumn(f"r{k}", F.when(F.col("rest").rlike(after), licence)).withColumn("rest", F.regexp_replace("rest", after, " "))
        names.append(f"r{k}")
    given = F.transform(F.filter("ids", lambda x: F.startswith(x, F.lit("SPDX:"))), lambda x: F.replace(F.substr(x, F.lit(6)), F.lit("_"), F.lit(" ")))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_sentences"), F.size(F.filter("ids", lambda x: x == "UNKNOWN")).cast("bigint").alias("n_unknown"), F.array_join("ids", " ").alias("sentences"), F.array_join(F.array_distinct(F.concat(F.array_compact(F.array(*names)), given)), ",").alias("licences"))


def op1_licences(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_unknown, sentences, licences of every document."""
    return licence_scan(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    case = " ".join(f"when regexp_matches(s, {quoted(p)}) then {quoted(n)}" for n, p in SENTENCES)
    step = "step0"
    steps = ["step0 as (select doc_id, ids, concat(' ', array_to_string(ids, ' '), ' ') as rest, []::varchar[] as names from found)"]
    for k, (licence, pattern) in enumerate(RULES):
        steps.append(f"step{k + 1} as (select doc_id, ids, regexp_replace(rest, {quoted(pattern)}, ' ', 'g') as rest, case when regexp_matches(rest, {quoted(pattern)}) and not list_contains(names, {quoted(licence)}) then list_append(names, {quoted(licence)}) else names end as names from {step})")
        step = f"step{k + 1}"
    return f"""
with hinted as (
  select doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), {quoted(ENDS)}), lambda s: regexp_matches(lower(s), {quoted(_OLD_HINT)})),
    lambda s: trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.+]+', ' ', 'g'), '[.]+( |\\z)', '\\1', 'g'))) as sentences
  from documents
), found as (
  select doc_id, list_transform(sentences, lambda s: case {case} else 'UNKNOWN' end) as ids from hinted
), {", ".join(steps)}
select doc_id, len(ids) as n_sentences, len(list_filter(ids, lambda x: x = 'UNKNOWN')) as n_unknown, array_to_string(ids, ' ') as sentences, array_to_string(names, ',') as licences
from {step}
"""


OP1_SQL = _sql()
