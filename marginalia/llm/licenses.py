"""License scan by canonical digest lookup, with DataFrame functions only.

A text in canonical form (case, punctuation, copyright statements and equivalent spellings removed) is looked up as a whole, by its
digest, among those of known licences.  Each line is looked up the same way, for the notices that documents carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import pick
from marginalia.llm.license_registry import registry

#: Spellings that mean the same, after punctuation is gone.
SPELLINGS = (("licence", "license"), ("sublicence", "sublicense"), ("copyright holders", "copyright owner"), ("copyright holder", "copyright owner"), ("copyright owners", "copyright owner"), ("noncommercial", "non commercial"), ("https", "http"), ("per cent", "percent"))
#: A whole line from a copyright sign on, as ``ORACLE`` has it.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
_SIGN = r"(?i:copyright|\(c\)|©)"
_RESERVED = r"(?i:all rights reserved)[.;]?"
#: Words that begin the next sentence after a holder, even without a full stop.
_NEXT = r"(?i:permission is|permission to|redistribution and|licensed under|released under|distributed under|available under|everyone is|dedicated to|the software is|this (?:\w+ )?(?:is|software|work|program|file|document|library)|all rights reserved)"
#: A holder ends with the line, before the next sentence, or at a full stop that is no abbreviation's.
_HOLDER = rf"[^\n]*?(?:(?=[ \t\r]*$)|(?=[ \t,;:.–—-]+{_NEXT})|(?<!\b(?:[Ii]nc|[Cc]orp|[Ll]td|[Cc]o|[Jj]r|[Ss]r|[Dd]r|[Ss]t|\p{{Lu}}))[.](?=[ \t]+\p{{L}}))"
_NAME = r"(?:\p{Lu}[\p{L}\p{N}.,'&-]*|of|and|by|the|its|contributors|authors?|project|developers|team|others|<[^>\n]*>)"
#: The copyright statement that begins a line: a sign with a year or a second sign, then the holder; or names alone after ``Copyright``; then the reservation.
COPYRIGHT = (
    rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:(?:{_SIGN}[ \t,:]*)+(?:(?i:by)[ \t]+)?(?:[<\[{{(]?(?i:\d{{4}}|years?|yyyy)\b{_HOLDER}|(?<=(?i:copyright)[ \t]{{0,9}}(?i:\(c\)|©)[ \t]{{0,9}}){_HOLDER})"
    rf"|(?i:copyright)[ \t]+(?!(?i:holders?|owners?|notices?|laws?|acts?|licen[sc]es?|and|or|in|is)\b)(?:{_NAME}[ \t]*){{1,12}}(?=\r?$)|(?={_RESERVED}))[ \t.,;:–—-]*(?:{_RESERVED})?"
)
#: A known-licence table is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 20_000

#: Short notices and permissive licences in full.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
        "OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)


def canonical(text: Column) -> Column:
    """Lower case, without copyright statements, words apart by one space, one spelling."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    # few texts have a statement at all: the rest are spared its pattern
    signed = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©")) | F.contains(low, F.lit("all rights reserved"))
    out = F.when(signed, F.lower(F.regexp_replace(text, COPYRIGHT, " "))).otherwise(low)
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where nothing is left of it."""
    c = canonical(text)
    return F.when(c != "", F.sha2(c, 256))


def known_licenses(spark: SparkSession, texts=None) -> DataFrame:
    """(license_id, text) of the built-in texts: notices and whole licences."""
    texts = registry(KNOWN) if texts is None else texts
    rows = ", ".join("({}, {})".format(*("'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'" for v in row)) for row in texts)
    return spark.sql(f"select * from values {rows} as t(license_id, text)")


#: Characters of known texts that reach the driver at most, to find words that tell them.
TOLD_CHARS = 32_000_000
_MADE = frozenset(w for _, new in SPELLINGS for w in new.split())


def telling_words(texts: list[str]) -> list[str] | None:
    """Few long words of which every canonical text has one; None where some text has none that would do.

    Only words of ASCII letters that no spelling makes: a text in whose canonical form such a word occurs has it in lower case as it is.
    """
    rest = [{w for w in t.split() if len(w) > 4 and w.isascii() and w.isalpha() and w not in _MADE} for t in texts]
    chosen: list[str] = []
    while rest:
        counts: dict[str, int] = {}
        for words_ in rest:
            for w in words_:
                counts[w] = counts.get(w, 0) + 1
        if not all(rest):
            return None
        # long words are rare elsewhere
        best = max(counts, key=lambda w: (counts[w] * len(w) ** 3, w))
        chosen.append(best)
        rest = [x for x in rest if best not in x]
    return chosen


def _holds(text: Column, told: list[str] | None) -> Column:
    """Whether a text may hold a known one."""
    if told is None:
        return F.lit(True)
    low, out = F.lower(text), F.lit(False)
    for w in told:
        out = out | F.contains(low, F.lit(w))
    return out


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, digest, license_id (of the whole text, or null), notices (ids of its lines, sorted, joined by commas).

    Defined cases: a null, empty or punctuation-only text has a null digest and matches nothing; where several licences share a
    canonical text the smallest id is given; rows of one doc_id share their notices; a null doc_id has none; an empty table gives no row; further columns
    are ignored.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    known = known.select("license_id", digest(F.col("text")).alias("d"), canonical(F.col("text")).alias("c")).where("d is not null")
    size = known.agg(F.sum(F.length("c"))).first()[0] or 0
    told = telling_words([r.c for r in known.select("c").collect()]) if size <= TOLD_CHARS else None
    known = known.groupBy("d").agg(F.min("license_id").alias("license_id"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    docs = pick(docs, ["doc_id", "text"])
    whole = docs.select("doc_id", digest(F.col("text")).alias("digest")).join(known.select(F.col("d").alias("digest"), "license_id"), "digest", "left")
    # a line without any of the telling words isn't a known text: it is spared the canonical form
    lines = docs.where(F.col("doc_id").isNotNull() & _holds(F.col("text"), told)).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = lines.where(_holds(F.col("line"), told)).select("doc_id", digest(F.col("line")).alias("d")).join(known.select("d", "license_id"), "d")
    notices = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    return whole.join(notices, "doc_id", "left").select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_sql_text(COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"' ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


#: The same scan for DuckDB, over the entries of ``KNOWN`` alone and with whole copyright lines removed: it equals the query where no whole
#: licence of the registry occurs and nothing follows a copyright statement on its line, as in the driver's tables.
ORACLE = f"""
with known as (select min(license_id) as license_id, d from (select license_id, sha256({_sql_canonical("text")}) as d from (values {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)}) as k(license_id, text)) group by d),
whole as (select doc_id, case when c <> '' then sha256(c) end as digest from (select doc_id, {_sql_canonical("text")} as c from documents)),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
found as (select doc_id, string_agg(distinct license_id, ',' order by license_id) as notices from (select doc_id, sha256({_sql_canonical("line")}) as d from lines) join known using (d) group by doc_id)
select whole.doc_id, whole.digest, known.license_id, coalesce(found.notices, '') as notices
from whole left join known on whole.digest = known.d left join found on whole.doc_id = found.doc_id
"""
