"""License scan: canonical digests of entire texts against known licences.

A text is folded to a canonical form: lower case, equivalent spellings made one,
copyright notices and punctuation gone, white space as single blanks. The digest
of the whole form is joined by hash to the digests of known texts. Each line is
a text of its own as well, so that a notice inside a document is found by the
same lookup; the whole document counts first.

A copyright notice is a line that starts with the word copyright and a sign, a
year or a holder (a capital letter, or a blank to fill in), with the sign and
anything, with "(c)" and a year, or that says "all rights reserved" and no more.
The word alone makes none: sentences and the bodies of licences have lines that
start with it, depending on where they were wrapped. Licences that carry a
notice of their own lose it to the next line when they are wrapped anew, so that
a whole text is looked up with its notices as well as without: one form has no
lines, the other no holders.

Letters and digits of every script count, so that a notice beside Russian or
Chinese prose is not taken for the whole text. Equivalent spellings are those of
SPELLINGS.

Defined results: a null text has no digest and no licence; a text whose form is
empty has the digest of the empty form and no licence; equal texts get equal
results; among several notices in a document the one of least id is reported and
their number counted. Other columns are carried through; names that begin with
``_ls_`` are refused with a ValueError. The list of known texts is a parameter of any size: up to LIST_ROWS
it is broadcast behind a count, beyond that it is joined by shuffle.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm._text import own_names
from treeloom.plans.durable import counted

#: Short licence notices, by SPDX identifier.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
}
#: Bodies of whole licences; those in the folder ``licenses`` are added.
_BODIES = {
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
}
#: Titles over the licences whose bodies have none.
TITLES = {
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
}
_BODIES |= {p.name.removesuffix(".txt"): [p.read_text("utf-8")] for p in sorted(files("treeloom.llm.licenses").iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")}
_BODIES["ISC"] += [x.replace("and/or distribute", "and distribute") for x in _BODIES["ISC"]]
#: Whole licences, bare and under their titles.
TEXTS = {k: [*v, *(f"{t}\n{x}" for t in TITLES.get(k, []) for x in v)] for k, v in _BODIES.items()}
#: Equivalent spellings, replaced in this order after lower-casing.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "non commercial"),
    ("noncommercial", "non commercial"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("organisation", "organization"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("https://", "https "),
    ("http://", "https "),
    ("(c)", " copyright "),
    ("©", " copyright "),
]
PHRASES = [(a, b) for a, b in SPELLINGS if a.replace(" ", "").isalpha() and " " in a]
#: A line that is a copyright notice (what follows the word, or what stands for it), and what is neither letter, mark, digit nor line end.
_WORD = r"(?i:copyright)"
_NOT_HOLDERS = r"(?i:notices?|holders?|owners?|laws?|licen[cs]es?|acts?|protection|and|or|in|of|to|the|is|are)"
_NOTICE_STARTS = [
    rf"{_WORD}[ \t:]*(?:(?i:\(c\))|©|[12][0-9]{{3}}|[<\[{{])",
    rf"{_WORD}[ \t]+(?:(?i:by)[ \t]+)?(?!{_NOT_HOLDERS}\b)\p{{Lu}}",
    r"(?i:\(c\))[ \t]*[12][0-9]{3}",
    r"©",
]
_NOTICE = rf"(?m)(?d)^[ \t]*(?:(?:{'|'.join(_NOTICE_STARTS)})[^\n]*|(?i:all rights reserved)[^\n\p{{L}}]*)$"
_OTHER = r"[^\p{L}\p{M}\p{N}\n]+"
#: Known texts (about 100 bytes each in the lookup) that are broadcast.
LIST_ROWS = 5_000


def _lined(text: Column) -> Column:
    """The canonical form with its line ends, which the form of the whole text reads as blanks."""
    out = F.lower(text)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, _OTHER, " ")


def _by_line(text: Column) -> Column:
    """The same without copyright notices."""
    return _lined(F.regexp_replace(text, _NOTICE, ""))


def _whole(by_line: Column) -> Column:
    """On one line, where spellings of two words meet that a line end parted."""
    out = F.btrim(F.regexp_replace(by_line, "[ \n]+", " "))
    for a, b in PHRASES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical_form(text: Column) -> Column:
    return _whole(_by_line(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical_form(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the fixed lists above."""
    return spark.createDataFrame([(k, t) for table in (NOTICES, TEXTS) for k, ts in table.items() for t in ts], "license_id string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _ls_digest, _ls_license (whole text), _ls_notice (least id of a line's) and _ls_notices (number of such lines).

    The whole text's digests meet the list in a hash join. Every line that is not
    blank is looked up: of a short list, in a hash set in the plan; of a long
    one, by a join of exploded line digests, counted by distinct text.
    """
    own_names(docs, "_ls_")
    forms = F.array_distinct(F.array(canonical_form(F.col("text")), _whole(_lined(F.col("text")))))
    lists = known.where("text IS NOT NULL").select("license_id", F.explode(forms).alias("_ls_form")).where("_ls_form <> ''").groupBy(F.sha2("_ls_form", 256).alias("_ls_key")).agg(F.min("license_id").alias("_ls_id"))
    lists, n = counted(lists)
    short = n <= LIST_ROWS
    lists = F.broadcast(lists) if short else lists
    # one canonical pass over a text serves its whole form and its lines; only a text with notices takes another
    whole = docs.withColumn("_ls_lined", _by_line(F.col(text))).withColumn("_ls_digest", F.sha2(_whole(F.col("_ls_lined")), 256))
    whole = whole.withColumn("_ls_full", F.when(F.col(text).rlike(_NOTICE), F.sha2(_whole(_lined(F.col(text))), 256)).otherwise(F.col("_ls_digest")))
    out = whole.join(lists.toDF("_ls_k1", "_ls_bare"), F.col("_ls_digest") == F.col("_ls_k1"), "left").join(lists.toDF("_ls_k2", "_ls_noted"), F.col("_ls_full") == F.col("_ls_k2"), "left")
    out = out.withColumn("_ls_license", F.coalesce("_ls_bare", "_ls_noted"))
    lines = F.filter(F.transform(F.split(F.col("_ls_lined"), "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    if short:
        ids = {r._ls_key: r._ls_id for r in lists.collect()}
        named = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in ids.items())))  # folded to one literal map, read for hits alone
        hits = F.filter(F.transform(lines, lambda x: F.sha2(x, 256)), lambda x: x.isin(list(ids)))
        out = out.withColumn("_ls_found", F.transform(hits, lambda x: F.try_element_at(named, x)))
        found = [F.array_min("_ls_found").alias("_ls_notice"), F.coalesce(F.size("_ls_found"), F.lit(0)).cast("long").alias("_ls_notices")]
    else:
        key = F.sha2(F.col(text), 256)
        each = docs.select(key.alias("_ls_text"), _by_line(F.col(text)).alias("_ls_lined")).select("_ls_text", F.posexplode(lines).alias("_ls_at", "_ls_line")).select("_ls_text", "_ls_at", F.sha2("_ls_line", 256).alias("_ls_key"))
        met = each.join(lists, "_ls_key").select("_ls_text", "_ls_at", "_ls_id").distinct().groupBy("_ls_text").agg(F.min("_ls_id").alias("_ls_notice"), F.count("*").alias("_ls_n"))
        out = out.withColumn("_ls_text", key).join(met, "_ls_text", "left")
        found = ["_ls_notice", F.coalesce("_ls_n", F.lit(0)).cast("long").alias("_ls_notices")]
    return out.select(*[F.col(c) for c in docs.columns], "_ls_digest", "_ls_license", *found)
