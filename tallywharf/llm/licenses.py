"""License scans by sentence rules (operator 5, native).

Wrapped lines are joined into paragraphs, without comment marks; known sentences, which start and end where a sentence or a line does, are
found in them in order and mapped to identifiers (a few regular expressions: `SENTENCES`, widened by `_WIDER` and `_WITHIN`). A document's identifiers in order form a sequence, which is matched against the ordered
licence rules (`RULES`): the first rule whose pattern occurs in the sequence gives a licence, its identifiers are used up, and the
rules go on with the rest; so a longer rule wins over the shorter rules within it. Identifiers that no rule uses are reported as unknown.

All of it is one pass of column functions over the table: no shuffle, no Python.

Defined results: null and empty texts have no licence; any text length works; repeated sentences count once in `licenses` and each time in `n_sentences`;
rows are kept as they are, and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, whole_text

# Fixed values: (identifier, regular expression of the whole normalised sentence).
SENTENCES = [
    ("APACHE2_REF", r"(this .{1,80} is )?licensed under the apache license,? ?(version 2(\.0)?)?( \(the \"?license\"?\))?"),
    ("APACHE2_FILE", r"you may not use this file except in compliance with the license"),
    ("APACHE2_COPY", r"you may obtain a copy of the license at.*"),
    ("ASIS_LAW", r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an \"?as is\"? basis.*"),
    ("MIT_REF", r"(released|licensed|distributed) under the (terms of the )?mit license"),
    ("MIT_GRANT", r"permission is hereby granted,? free of charge,? to any person obtaining a copy.*"),
    ("MIT_NOTICE", r"the above copyright notice and this permission notice shall be included in all copies.*"),
    ("ASIS_MIT", r"the software is provided \"?as is\"?,? without warranty of any kind.*"),
    ("GPL3_REF", r"(this .{1,80} is )?(licensed|released|distributed) under the (terms of the )?gnu general public license,? (v|version )3(\.0)?"),
    ("GPL2_REF", r"(this .{1,80} is )?(licensed|released|distributed) under the (terms of the )?gnu general public license,? (v|version )2(\.0)?"),
    ("GPL_REDIST", r"this program is free software:? you can redistribute it and/or modify it under the terms of the gnu general public license.*"),
    ("GPL_LATER", r"either version [23] of the license,? or \(at your option\) any later version"),
    ("LGPL_REF", r"(this .{1,80} is )?(licensed|released|distributed) under the (terms of the )?gnu lesser general public license.*"),
    ("BSD_REF", r"(released|licensed|distributed) under the (2-clause |3-clause |new |modified |simplified )?bsd license"),
    ("BSD_REDIST", r"redistribution and use in source and binary forms,? with or without modification,? are permitted.*"),
    ("MPL2_REF", r"this source code form is subject to the terms of the mozilla public license,? v(\. ?2\.0)?"),
    ("CC_BY_NC4_REF", r"(this .{1,80} is )?licensed under (a )?(cc by-nc|creative commons attribution-noncommercial) 4\.0( international license)?"),
    ("CC_BY_SA4_REF", r"(this .{1,80} is )?licensed under (a )?(cc by-sa|creative commons attribution-sharealike) 4\.0( international license)?"),
    ("CC_BY4_REF", r"(this .{1,80} is )?licensed under (a )?(cc by|creative commons attribution) 4\.0( international license)?"),
    ("CC0_REF", r"(to the extent possible under law,? .*|(released|licensed) under (the )?cc0( 1\.0)?.*)"),
    ("COPYRIGHT", r"copyright (\(c\)|©)? ?[0-9]{4}.*"),
    ("ALL_RIGHTS", r"all rights reserved"),
]

# Fixed values: (licence, identifier sequence), tried in this order.
RULES = [
    ("Apache-2.0", ["APACHE2_REF", "APACHE2_FILE", "APACHE2_COPY", "ASIS_LAW"]),
    ("Apache-2.0", ["APACHE2_REF", "APACHE2_FILE"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "ASIS_MIT"]),
    ("MIT", ["MIT_GRANT"]),
    ("GPL-3.0-or-later", ["GPL_REDIST", "GPL_LATER"]),
    ("GPL", ["GPL_REDIST"]),
    ("BSD", ["BSD_REDIST", "ASIS_MIT"]),
    ("BSD", ["BSD_REDIST"]),
    ("Apache-2.0", ["APACHE2_REF"]),
    ("MIT", ["MIT_REF"]),
    ("GPL-3.0", ["GPL3_REF"]),
    ("GPL-2.0", ["GPL2_REF"]),
    ("LGPL", ["LGPL_REF"]),
    ("BSD", ["BSD_REF"]),
    ("MPL-2.0", ["MPL2_REF"]),
    ("CC-BY-NC-4.0", ["CC_BY_NC4_REF"]),
    ("CC-BY-SA-4.0", ["CC_BY_SA4_REF"]),
    ("CC-BY-4.0", ["CC_BY4_REF"]),
    ("CC0-1.0", ["CC0_REF"]),
    ("Proprietary", ["COPYRIGHT", "ALL_RIGHTS"]),
]

#: Words of which every known sentence has one; other sentences are not looked at further.
HINTS = "licen[sc]e|permission|copyright|software|rights reserved|redistribut|extent possible|cc0"
#: In the SQL a sentence ends at a line end, or at a mark followed by blanks (where a line end is put).
MARK_END = r"([.!?;])[ \t]+"
COMMENT = r"^[ #*/;-]+|[ .!?;*/]+$"


# What the operator reads beyond SENTENCES and RULES, which the SQL is made from. A blank in a form is a blank or the end of a wrapped line.
_ANY, _Q = r"(?:[^\n]|\n(?!\n)){1,80}", "[\"'`“”‘’]{0,2}"
_GIVEN = rf"(?:(?:(?:this|these|the|all|our) {_ANY}|it) (?:is|are) )?(?:licensed|released|distributed|published|(?:made )?available) under (?:a |the )?(?:terms (?:and conditions )?of the )?"
_TAIL = r"(?:,? (?:-|–|—|see|\(see) .*)?"
_WIDER = {
    "APACHE2_REF": rf"{_GIVEN}apache(?: software)? licen[sc]e,? ?(?:(?:version |v)?2(?:\.0)?)?(?: \(the {_Q}license{_Q}\))?{_TAIL}",
    "ASIS_LAW": rf"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an {_Q}as is{_Q} basis.*",
    "MIT_REF": rf"{_GIVEN}mit licen[sc]e{_TAIL}",
    "ASIS_MIT": rf"the software is provided {_Q}as is{_Q},? without warranty of any kind.*",
    "GPL3_REF": rf"{_GIVEN}gnu general public licen[sc]e,? (?:v|version )3(?:\.0)?{_TAIL}",
    "GPL2_REF": rf"{_GIVEN}gnu general public licen[sc]e,? (?:v|version )2(?:\.0)?{_TAIL}",
    "LGPL_REF": rf"{_GIVEN}gnu (?:lesser|library) general public licen[sc]e.*",
    "BSD_REF": rf"{_GIVEN}(?:2-clause |3-clause |new |modified |simplified )?bsd licen[sc]e{_TAIL}",
    "CC_BY_NC4_REF": rf"{_GIVEN}(?:cc by-nc|creative commons attribution-noncommercial) 4\.0(?: international)?(?: license)?{_TAIL}",
    "CC_BY_SA4_REF": rf"{_GIVEN}(?:cc by-sa|creative commons attribution-sharealike) 4\.0(?: international)?(?: license)?{_TAIL}",
    "CC_BY4_REF": rf"{_GIVEN}(?:cc by|creative commons attribution) 4\.0(?: international)?(?: license)?{_TAIL}",
    "CC0_REF": rf"(?:to the extent possible under law,? .*|{_GIVEN}cc0(?: 1\.0)?.*)",
}
#: Found within a sentence too: the GPL's notice is one sentence that grants, names the version and goes on.
_WITHIN = {
    "GPL_REDIST": r"you can redistribute it and/or modify it under the terms of the gnu general public license",
    "LGPL_REDIST": r"you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license",
    "GPL_LATER": r"either version 3 of the license,? or \(at your option\) any later version",
    "GPL2_LATER": r"either version 2 of the license,? or \(at your option\) any later version",
}
_WRAPPED = {name: form.replace(" ", r"[ \n]") for name, form in ({n: _WIDER.get(n, p) for n, p in SENTENCES if n not in _WITHIN} | _WITHIN).items()}
_KNOWN = rf"(?d)(?:(?:^|(?<=\n))(?:{'|'.join(_WRAPPED[n] for n in _WRAPPED if n not in _WITHIN)})(?=\n|\z)|\b(?:{'|'.join(_WRAPPED[n] for n in _WITHIN)})\b)"
_SIGNS = HINTS + r"|reserved|extent|creative|\bcc\b"
_OWNED = ["COPYRIGHT", "ALL_RIGHTS"]  # before a grant these two are part of its notice
_RULES = [
    (name, [*before, *ids])
    for name, ids in [("GPL-2.0-or-later", ["GPL_REDIST", "GPL2_LATER"]), ("LGPL", ["LGPL_REDIST"]), *RULES]
    for before in ([_OWNED, []] if ids != _OWNED else [[]])
]


def paragraphs(text: Column) -> Column:
    """The text in lower case with single blanks, without comment marks; one line end where a line is wrapped, more where a sentence or paragraph ends."""
    t = F.regexp_replace(F.regexp_replace(ascii_lower(text), r"\r\n?", "\n"), r"[ \t]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?md)^[ #*/;%<>!|-]+", ""), r"([.!?;]) [ #*/;-]*", "$1\n\n")
    t = F.regexp_replace(t, r"(?<![.!?;*/ ])[*/ ]*+[.!?;][.!?;*/ ]*+(?=\n|\z)", "\n")
    return F.regexp_replace(t, r"(?<![*/ ])[*/ ]++(?=\n|\z)", "")


def identifier(sentence: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, form in reversed(_WRAPPED.items()):
        out = F.when(sentence.rlike(rf"(?d)\A(?:{form})\z"), name).otherwise(out)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_sentences (known ones), sentence_ids in order, licenses (distinct, in rule order), n_unused."""
    # most texts hold no hint at all and are done with one search
    found = F.regexp_extract_all(paragraphs(F.col("t")), F.lit(_KNOWN), F.lit(0))
    ids = F.when(F.col("t").rlike("(?i)" + _SIGNS), F.transform(found, identifier)).otherwise(F.array().cast("array<string>"))
    held = docs.select(F.col(id_col), whole_text(text_col).alias("t")).select(id_col, ids.alias("ids"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f",{x}," for x in rule)).alias("ids")) for name, rule in _RULES))
    start = F.struct(F.array_join(F.transform("ids", lambda x: F.concat(F.lit(","), x, F.lit(","))), "").alias("rest"), F.array().cast("array<string>").alias("found"))

    def use(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["ids"])
        return F.struct(
            F.replace(state["rest"], rule["ids"], F.lit(",#,")).alias("rest"),
            F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    done = held.withColumn("end", F.when(F.size("ids") == 0, start).otherwise(F.aggregate(rules, start, use)))
    return done.select(
        id_col,
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join(F.array_distinct("end.found"), " ").alias("licenses"),
        F.size(F.filter(F.split("end.rest", ","), lambda x: (x != "") & (x != "#"))).cast("long").alias("n_unused"),
    )


def scan_sql() -> str:
    """DuckDB SQL with the rows of scan() over `documents` whose notices have a sentence on each line; it doesn't read wrapped or wider ones."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    upper, lower = quoted("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), quoted("abcdefghijklmnopqrstuvwxyz")
    known = " ".join(f"WHEN regexp_full_match(s, {quoted(p)}) THEN {quoted(n)}" for n, p in SENTENCES)
    steps, last = [], "r0"
    for k, (name, rule) in enumerate(RULES, 1):
        ids = quoted("".join(f",{x}," for x in rule))
        steps.append(f"r{k} AS (SELECT doc_id, n, ids, replace(rest, {ids}, ',#,') AS rest, CASE WHEN contains(rest, {ids}) THEN list_append(found, {quoted(name)}) ELSE found END AS found FROM {last})")
        last = f"r{k}"
    return rf"""
WITH cut AS (
  SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), {quoted(MARK_END)}, '\1' || chr(10), 'g'), '[\n\r]+')) AS line,
         unnest(range(len(regexp_split_to_array(regexp_replace(coalesce(text, ''), {quoted(MARK_END)}, '\1' || chr(10), 'g'), '[\n\r]+')))) AS pos
  FROM documents),
norm AS (
  SELECT doc_id, pos, regexp_replace(regexp_replace(translate(line, {upper}, {lower}), '[ \t]+', ' ', 'g'), {quoted(COMMENT)}, '', 'g') AS s
  FROM cut WHERE regexp_matches(line, {quoted("(?i)" + HINTS)})),
named AS (SELECT doc_id, pos, CASE {known} END AS id FROM norm),
seq AS (SELECT doc_id, count(*) AS n, string_agg(id, ' ' ORDER BY pos) AS ids, string_agg(',' || id || ',', '' ORDER BY pos) AS rest FROM named WHERE id IS NOT NULL GROUP BY doc_id),
r0 AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, coalesce(rest, '') AS rest, []::VARCHAR[] AS found FROM documents d LEFT JOIN seq USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, n AS n_sentences, ids AS sentence_ids, coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ' '), '') AS licenses,
       len(list_filter(string_split(rest, ','), lambda x: x <> '' AND x <> '#'))::BIGINT AS n_unused
FROM {last}"""
