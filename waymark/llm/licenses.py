"""Licence scan: whole texts, made canonical, are looked up by digest among known licences.

Canonical: letters are lowered, copyright notices go, all but letters and digits is a space, equivalent spellings are
one, and the fields that a licence leaves open (who disclaims, whose name may not be used) hold one word.  Column
functions only.

A notice is "copyright" with a sign, a year or a place for one, a sign with a year, or at the start of a line
"copyright" with a year or "all rights reserved" within 100 characters.  It ends before the first of the usual openings
of a licence (OPENINGS) within 300 characters, else where its line ends within 200 characters, else with its years, so a
text without line breaks loses its notice and no more.

The known texts are the files of the folder ``known`` (TEXTS says how each may also be met: with a title, without an
appendix, without numbers of its conditions).  GPL, LGPL and GFDL are named without "only" or "or later", which the
text doesn't say.

Defined cases: null counts as empty, and an empty text is no licence; rows that repeat an id are rows of their own; an
empty table gives no rows; known texts that are alike get the smaller name.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: equivalent spellings
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "wilfull": "willful", "sub license": "sublicense", "sub licence": "sublicense", "sublicence": "sublicense", "non commercial": "noncommercial", "non infringement": "noninfringement",
    "per cent": "percent", "copyright holder": "copyright owner", "copyright holders": "copyright owners", "third parties": "thirdparties", "including the next paragraph": "",
}

OPENINGS = (
    "permission is|permission to use|redistribution and use|redistributions of|licensed under|everyone is permitted|everyone is allowed|"
    r"this (?:program|library|software|font|work|file|license|package|product)|the software is|anyone is free|gnomovision comes|contributor\(s\)|notice to user"
)
_GAP, _YEAR = r"[ \t\n#*/;-]{1,9}", "(?:19|20)[0-9][0-9]"
_OPENING = OPENINGS.replace(" ", _GAP)
_SIGN = rf"(?:\(c\)|[<\[{{(]? ?(?:{_YEAR}|year|yyyy|dates?))"
_REST = rf"(?:[\s\S]{{0,300}}?({_OPENING})|[^\n]{{0,200}}(?:\n|\z)|[0-9 ,-]{{0,99}})"
# in lowered text, with three line feeds for each, so that a line's end and the next one's start can both be met
NOTICE = (
    rf"(?:copyright[ \t\n:,#*/;-]{{0,9}}{_SIGN}|\(c\)[ \t]{{0,9}}(?:copyright[ \t:,]{{0,9}})?{_YEAR}){_REST}|"
    rf"(?:^|\n)[ \t#*/;-]{{0,9}}copyright[ \t:][^\n]{{1,100}}?(?:all rights reserved{_REST}|{_YEAR}[ \t.,;]{{0,9}}(?:\n|\z|({_OPENING})))"
)
# fixed values: what looks like a notice and is none
NO_NOTICE = {"copyright treaty": "treaty", "copyright and permission notice": "permission notice"}
# fixed values: the fields that licences leave open, in canonical words
FIELDS = [
    (r"neither the names? of .{1,120}? nor the names of", "neither the name of holder nor the names of"),
    (r"this software is provided by .{1,120}? as is and any", "this software is provided by holder as is and any"),
    (r"as is and .{1,80}? disclaims all warranties", "as is and holder disclaims all warranties"),
    (r"in no event shall .{1,120}? be liable", "in no event shall holder be liable"),
    (r"software developed by .{1,120}? (4 )?neither the name", r"software developed by holder \1neither the name"),
]

# fixed values: titles that may stand before a known text
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "(The MIT License)", "Expat License"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License", "The BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: http://scripts.sil.org/OFL"],
}
#: Where the terms of a known text end; what follows says how to apply them.
ENDS = r"END OF TERMS AND CONDITIONS[^\n]*|(?=\n[^\n]*How to use this License for your documents)|(?=\n[^\n]*Exhibit A - Source Code Form License Notice)|(?=\n *EXHIBIT A)"

# fixed values: known licences (their texts without the copyright line)
KNOWN = {p.stem.replace("_", " "): p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "known").glob("*.txt"))}


def texts() -> list[tuple[str, str]]:
    """name and text of each way in which the known licences are met."""
    out = []
    for name, text in KNOWN.items():
        ways = [text]
        if end := re.search(ENDS, text):
            ways += [text[: end.end()], text[: end.start()]] if "LLVM" not in name else []
        if name.startswith("BSD") or name == "Zlib":
            ways.append(re.sub(r"(?m)^ *[0-9]\. ", "* ", text))
        if name == "Unlicense":
            ways.append(text[: text.index("For more information")])
        out += [(name, head + w) for w in ways for head in ("", *(f"{t}\n\n" for t in TITLES.get(name, [])))]
    return sorted(set(out))


def _words(c: Column) -> Column:
    """Canonical words from lowered text whose notices are gone."""
    c = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
    # with two spaces between, each word has spaces of its own
    c = F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in (SPELLINGS | NO_NOTICE).items():
        c = F.replace(c, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} " if b else ""))
    return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    c = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("©"), F.lit("(c)"))
    lines = F.replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\n"), F.lit("\n\n\n"))
    for a, b in NO_NOTICE.items():
        lines = F.replace(lines, F.lit(a), F.lit(b))
    bare = F.regexp_replace(lines, NOTICE, " $1$2$3 ")
    bare = F.replace(bare, F.lit("all rights reserved"), F.lit(" "))
    c = _words(F.when(c.contains("copyright") | c.contains("(c)"), bare).otherwise(c))
    for field, fixed in FIELDS:
        c = F.regexp_replace(c, field, fixed.replace("\\", "$"))
    return c


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest of the canonical text and license (null where it is none); ``known`` has name and text."""
    spark = docs.sparkSession
    known = known if known is not None else spark.createDataFrame(texts(), "name string, text string")
    table = known.select("name", canonical(F.col("text")).alias("c")).where("c <> ''").groupBy(F.sha2("c", 256).alias("_w_d")).agg(F.min("name").alias("license"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("digest"))
    return rows.join(table, F.col("digest") == F.col("_w_d"), "left").select("doc_id", "digest", "license")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(source: str) -> str:
    """CTEs from ``source`` (id, text) to ``<source>_c`` (id, c), the canonical text."""
    words = "' ' || replace(trim(regexp_replace(bare, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), ' ', '  ') || ' '"
    for a, b in (SPELLINGS | NO_NOTICE).items():
        words = f"replace({words}, ' {a.replace(' ', '  ')} ', '{f' {b} ' if b else ''}')"
    lines = "replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(10) || chr(10) || chr(10))"
    for a, b in NO_NOTICE.items():
        lines = f"replace({lines}, '{a}', '{b}')"
    fields = "c"
    for field, fixed in FIELDS:
        fields = f"regexp_replace({fields}, '{field}', '{fixed}', 'g')"
    return f"""
{source}_l AS (SELECT id, replace(lower(coalesce(text, '')), '©', '(c)') AS t FROM {source}),
{source}_n AS (SELECT id, CASE WHEN contains(t, 'copyright') OR contains(t, '(c)') THEN replace(regexp_replace({lines}, {_quoted(NOTICE)}, ' \\1\\2\\3 ', 'g'), 'all rights reserved', ' ') ELSE t END AS bare FROM {source}_l),
{source}_w AS (SELECT id, trim(replace({words}, '  ', ' '), ' ') AS c FROM {source}_n),
{source}_c AS (SELECT id, {fields} AS c FROM {source}_w)"""


def licenses_sql() -> str:
    rows = ",\n".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in texts())
    return f"""
WITH known AS (SELECT * FROM (VALUES {rows}) AS v(id, text)), docs AS (SELECT doc_id AS id, text FROM documents),{_sql_canonical('known')},{_sql_canonical('docs')},
names AS (SELECT sha256(c) AS digest, min(id) AS license FROM known_c WHERE c <> '' GROUP BY ALL)
SELECT id AS doc_id, d.digest, license FROM (SELECT id, sha256(c) AS digest FROM docs_c) d LEFT JOIN names USING (digest)"""
