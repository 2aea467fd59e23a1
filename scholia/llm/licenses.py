"""License scans [native]: ordered signature rules over normalised words.

A text is lower-cased (A-Z), its words are joined by single spaces, and some
hundreds of signature patterns, built from a table of licenses and a table of
forms (tag, reference, name, notice), look for word-aligned passages. A rule
runs only where its keyword is among those that one pass over the text found.
Overlaps are resolved by rule order: a detection is suppressed when an interval
of a rule of the same or a higher priority contains it (of equal intervals the
earlier rule stays); partial overlaps both stay.

Everything is one map over the rows: no shuffle, no Python, no join. A
detection's container starts at most ``MAX_WORDS`` words before it, so each is
compared with a bounded run of its predecessors and the work grows with the
text, not with the square of its detections.

Results for special input: null, empty and wordless texts have no words, no
places, empty labels and score 0; repeated rows give repeated rows; the
columns of the input are kept, and those that the scan adds replace columns of
the same name. Words of a match are those of the normalised text; a rule whose
pattern always holds the word "license" is tried only where the text has it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that always count, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label -> (keyword, name pattern, versions). Patterns are over normalised words.
LICENSES = {
    "agpl": ("affero", "(?:gnu )?affero general public licen[cs]e", "3"),
    "lgpl": ("lesser", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "2 21 3"),
    "gpl": ("gnu", "gnu (?:general public licen[cs]e|gpl)", "1 2 3"),
    "gfdl": ("documentation", "(?:gnu )?free documentation licen[cs]e", "11 12 13"),
    "apache": ("apache", "apache(?: software)? licen[cs]e", "1 11 2"),
    "mit": ("mit", "(?:the )?mit licen[cs]e", ""),
    "bsd-2-clause": ("bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd) licen[cs]e", ""),
    "bsd-3-clause": ("bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd) licen[cs]e", ""),
    "bsd-4-clause": ("bsd", "(?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e", ""),
    "bsd": ("bsd", "bsd licen[cs]e", ""),
    "isc": ("isc", "isc licen[cs]e", ""),
    "zlib": ("zlib", "zlib(?: libpng)? licen[cs]e", ""),
    "mpl": ("mozilla", "mozilla public licen[cs]e", "1 11 2"),
    "epl": ("eclipse", "eclipse public licen[cs]e", "1 2"),
    "cddl": ("distribution", "common development and distribution licen[cs]e", "1 11"),
    "cpl": ("common", "common public licen[cs]e", "1"),
    "eupl": ("european", "european union public licen[cs]e", "1 11 12"),
    "osl": ("open", "open software licen[cs]e", "1 2 3"),
    "afl": ("academic", "academic free licen[cs]e", "11 2 3"),
    "artistic": ("artistic", "artistic licen[cs]e", "1 2"),
    "bsl": ("boost", "boost software licen[cs]e", "1"),
    "unlicense": ("unlicense", "(?:the )?unlicense", ""),
    "wtfpl": ("wtfpl", "wtfpl", "2"),
    "psf": ("python", "python software foundation licen[cs]e", "2"),
    "php": ("php", "php licen[cs]e", "3 301"),
    "ruby": ("ruby", "ruby licen[cs]e", ""),
    "openssl": ("openssl", "openssl licen[cs]e", ""),
    "postgresql": ("postgresql", "postgresql licen[cs]e", ""),
    "ms-pl": ("microsoft", "microsoft public licen[cs]e", ""),
    "ms-rl": ("microsoft", "microsoft reciprocal licen[cs]e", ""),
    "ofl": ("sil", "sil open font licen[cs]e", "1 11"),
    "odbl": ("database", "open database licen[cs]e", "1"),
    "pddl": ("public", "public domain dedication and licen[cs]e", "1"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ""),
    "ecl": ("educational", "educational community licen[cs]e", "1 2"),
    "ipl": ("ibm", "ibm public licen[cs]e", "1"),
    "apsl": ("apple", "apple public source licen[cs]e", "1 2"),
    "npl": ("netscape", "netscape public licen[cs]e", "1 11"),
    "qpl": ("q", "q public licen[cs]e", "1"),
    "sleepycat": ("sleepycat", "sleepycat licen[cs]e", ""),
    "vim": ("vim", "vim licen[cs]e", ""),
    "w3c": ("w3c", "w3c software(?: notice and)? licen[cs]e", ""),
    "zpl": ("zope", "zope public licen[cs]e", "1 2 21"),
    "upl": ("universal", "universal permissive licen[cs]e", "1"),
    "mulanpsl": ("mulan", "mulan permissive software licen[cs]e", "1 2"),
    "busl": ("business", "business source licen[cs]e", "1 11"),
    "sspl": ("server", "server side public licen[cs]e", "1"),
    "elastic": ("elastic", "elastic licen[cs]e", "1 2"),
    "cecill": ("cecill", "cecill(?: [bc])?(?: free software)? licen[cs]e", "1 2 21"),
    "openrail": ("openrail", "(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", ""),
    "llama": ("llama", "llama (?:2 |3 )?community licen[cs]e", ""),
    "cc0": ("cc0", "(?:creative commons )?cc0", "1"),
    "cc-by-nc-nd": ("cc", "(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:s|atives|ative works))", "1 2 25 3 4"),
    "cc-by-nc-sa": ("cc", "(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)", "1 2 25 3 4"),
    "cc-by-nc": ("cc", "(?:cc|creative commons) (?:by nc|attribution non ?commercial)", "1 2 25 3 4"),
    "cc-by-nd": ("cc", "(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:s|atives|ative works))", "1 2 25 3 4"),
    "cc-by-sa": ("cc", "(?:cc|creative commons) (?:by sa|attribution share ?alike)", "1 2 25 3 4"),
    "cc-by": ("cc", "(?:cc|creative commons) (?:by|attribution)", "1 2 25 3 4"),
    "proprietary": ("reserved", "all rights reserved", ""),
    "confidential": ("confidential", "(?:proprietary and confidential|confidential and proprietary)", ""),
    "public-domain": ("domain", "(?:placed |released |dedicated )?(?:in|into|to) the public domain", ""),
}
#: Other keywords that gate the same license.
ALSO = {"cc": ("creative",), "lesser": ("library",), "gnu": ("gpl",)}
#: Sentences of license texts: label, keyword, pattern. Each is written for the
#: wording of its license; no pattern matches more than ``MAX_WORDS`` words.
NOTICES = [
    ("mit", "sublicense", "use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", "shall be included in all copies or substantial portions of the software"),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "dealings", "in connection with the software or the use or other dealings in the software"),
    ("mit-0", "furnished", "to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software"),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", "loss", "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"),
    ("0bsd", "fee", "with or without fee is hereby granted the software is provided as is"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "exemplary", "liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "substitute", "procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "neither", "neither the name of (?:the |[a-z0-9]+ ){1,6}nor the names of its contributors may be used"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this licen[cs]e"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software"),
    ("bsd-4-clause", "acknowledgement", "must display the following acknowledgement this product includes software developed by"),
    ("apache", "compliance", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache", "conditions", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "irrevocable", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("apache", "irrevocable", "perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?patent licen[cs]e"),
    ("apache", "contribution", "any contribution intentionally submitted for inclusion in the work by you"),
    ("apache", "notice", "if the work includes a notice text file as part of its distribution"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "fitness", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e"),
    ("gpl", "received", "you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl", "guarantee", "intended to guarantee your freedom to share and change"),
    ("gpl", "copyleft", "free copyleft licen[cs]e for software and other kinds of works"),
    ("gpl-2-or-later", "option", "either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3-or-later", "option", "either version 3 of the licen[cs]e or at your option any later version"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "derivative", "work that uses the library is not a derivative work of the library"),
    ("lgpl-2.1-or-later", "option", "either version 2 1 of the licen[cs]e or at your option any later version"),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("agpl", "received", "you should have received a copy of the gnu affero general public licen[cs]e"),
    ("agpl", "interacting", "offer all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl", "form", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", "file", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "basis", "software distributed under the licen[cs]e is distributed on an as is basis without warranty of any kind"),
    ("mpl-1.1", "contents", "the contents of this file are subject to the mozilla public licen[cs]e"),
    ("npl", "contents", "the contents of this file are subject to the netscape public licen[cs]e"),
    ("cddl", "contents", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("epl", "agreement", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cpl", "accompanying", "the accompanying materials are made available under the terms of the common public licen[cs]e"),
    ("ipl", "ibm", "the accompanying program is provided under the terms of this ibm public licen[cs]e"),
    ("eupl", "eupl", "licensed under the eupl version 1 [0-9](?: or as soon they will be approved by the european commission)?"),
    ("osl", "licensed", "licensed under the open software licen[cs]e version [0-9](?: [0-9])?"),
    ("afl", "licensed", "licensed under the academic free licen[cs]e version [0-9](?: [0-9])?"),
    ("zlib", "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", "origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "anyone", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", "dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "want", "you just do what the [a-z]+ you want to"),
    ("wtfpl", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("bsl", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsl", "executable", "machine executable object code generated by a source language processor"),
    ("artistic", "modified", "you may distribute your modified version as source"),
    ("artistic", "perl", "under the same terms as perl itself"),
    ("psf", "python", "copyright c [0-9 ]{1,40}python software foundation"),
    ("psf", "nonexclusive", "psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e"),
    ("php", "php", "this product includes php software freely available from"),
    ("ruby", "verbatim", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("postgresql", "university", "in no event shall the university of california be liable to any party"),
    ("ms-pl", "patents", "each contributor grants you a non exclusive worldwide royalty free licen[cs]e under its licensed patents"),
    ("ms-rl", "reciprocal", "reciprocal grants for any file you distribute that contains code from the software"),
    ("ofl", "font", "the font software may be modified altered or added to"),
    ("ofl", "reserved", "no modified version of the font software may use the reserved font name"),
    ("odbl", "reasonably", "you must include a notice associated with the produced work reasonably calculated to make any person"),
    ("pddl", "dedicates", "the rightsholder dedicates by this document the work to the public domain"),
    ("ncsa", "deal", "to deal with the software without restriction including without limitation the rights to use copy modify"),
    ("w3c", "licensee", "by obtaining using and or copying this work you the licensee agree"),
    ("zpl", "zope", "this software is subject to the provisions of the zope public licen[cs]e"),
    ("upl", "larger", "the larger works to which the software is contributed by such licensors"),
    ("mulanpsl", "mulan", "you can use this software according to the terms and conditions of the mulan psl"),
    ("busl", "production", "the licensor may make an additional use grant above permitting limited production use"),
    ("busl", "change", "on the change date or the fourth anniversary of the first publicly available distribution"),
    ("sspl", "service", "making the functionality of the program or modified version available to third parties as a service"),
    ("elastic", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", "the licen[cs]e does not grant to you the right to sell the software"),
    ("cecill", "french", "governed by the cecill(?: [bc])? licen[cs]e under french law"),
    ("openrail", "derivatives", "you agree not to use the model or derivatives of the model"),
    ("llama", "llama", "licensed under the llama [0-9](?: [0-9])? community licen[cs]e"),
    ("gemma", "gemma", "gemma is provided under and subject to the gemma terms of use"),
    ("cc0", "waives", "waives all of his or her rights to the work worldwide under copyright law"),
    ("cc0", "waived", "to the extent possible under law [a-z0-9 ]{1,40}waived all copyright and related or neighboring rights"),
    ("cc-by", "credit", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "remix", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("sleepycat", "accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("x11", "sale", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("curl", "fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("libpng", "disclaim", "the contributing authors and group 42 inc disclaim all warranties"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", "portions of this software are copyright (?:c )?(?:[0-9]{4} )?the freetype project"),
    ("hpnd", "supporting", "both that copyright notice and this permission notice appear in supporting documentation"),
    ("ntp", "suitability", "makes no representations about the suitability (?:of )?this software for any purpose"),
    ("unicode", "unicode", "distributed under the terms of use in https? www unicode org copyright html"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "consent", "may be (?:reproduced|copied|distributed|transmitted) (?:in any form )?without the (?:prior )?(?:written|express) (?:consent|permission) of"),
    ("proprietary", "trade", "contains (?:trade secrets|proprietary information|confidential information) (?:of|belonging to)"),
    ("proprietary", "personal", "for personal (?:and )?non ?commercial use only"),
    ("evaluation", "evaluation", "licensed for (?:internal )?evaluation purposes only"),
    ("research", "academic", "for (?:academic|research|non ?commercial research)(?: and educational)? (?:use|purposes) only"),
]
#: No match is longer than this many words: every repeat in a pattern is bounded,
#: and the longest grant ("licensed under the terms of the version 2 0 of the",
#: a name of eight words, "version 2 0") has fewer; two notices hold up to forty
#: free characters.
MAX_WORDS = 40
BASE_PRIORITY, NOTICE, TAG, GRANT, VERSIONED, NAMED = 0, 1, 2, 3, 4, 5
SCORES = {NOTICE: 0.98, TAG: 0.95, GRANT: 0.9, VERSIONED: 0.8, NAMED: 0.6}


def _digits(version: str) -> str:
    """2 -> "2(?: 0)?"; 25 -> "2 5"; 301 -> "3 0 1"."""
    return f"{version}(?: 0)?" if len(version) == 1 else " ".join(version)


def build_rules() -> list[tuple[str, int, list[str], str]]:
    """(label, priority, keywords, pattern) in order of decreasing priority."""
    rules = [(label, NOTICE, [kw], pattern) for label, kw, pattern in NOTICES]
    for label, (kw, name, versions) in LICENSES.items():
        gates = [kw, *ALSO.get(kw, ())]
        spdx = label.replace("-", " ")
        rules.append((label, TAG, ["spdx"], f"spdx license identifier {spdx}(?: [0-9]){{0,3}}(?: only| or later| clause)?"))
        rules.append((label, GRANT, gates, f"(?:licensed|released|distributed|available|published|covered) (?:under|by)(?: the)?(?: terms of)?(?: the)?(?: version [0-9](?: [0-9])? of the)? {name}(?: v?(?:ersion )?[0-9](?: [0-9])?)?"))
        rules += [(f"{label}-{'.'.join(v)}", VERSIONED, gates, f"{name} (?:v ?|version |international |unported ){{0,3}}{_digits(v)}") for v in versions.split()]
        rules.append((label, NAMED, gates, name))
    return sorted(rules, key=lambda r: r[1])


RULES = build_rules()
KEYWORDS = sorted({k for r in RULES for k in r[2]})
_OPEN, _CLOSE = "\x01", "\x02"


def normalised(text: Column) -> Column:
    """" w1 w2 ... " in lower case; "" becomes " "."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), NOT_WORD, " ")


def _places(norm: Column, pattern: Column) -> Column:
    """array<struct<start,end>> (word numbers, end inclusive) of a pattern's
    word-aligned matches: matches are bracketed by marks that no word holds,
    so their words can be numbered in one split."""
    marked = F.regexp_replace(norm, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), F.lit(f"{_OPEN}$0{_CLOSE}"))
    words = F.split(marked, " ", -1)
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), (i - 1).cast("long").alias("i")))
    hit = F.filter(numbered, lambda x: x["w"].contains(_OPEN) | x["w"].contains(_CLOSE))
    starts, ends = F.filter(hit, lambda x: x["w"].contains(_OPEN)), F.filter(hit, lambda x: x["w"].contains(_CLOSE))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["i"].alias("start"), b["i"].alias("end")))


def needs_license(pattern: str) -> bool:
    """Whether every match has the word license or licence: the pattern has it
    outside of all groups."""
    while "(" in pattern:
        inner = re.sub(r"\([^()]*\)(?:[?*+]|\{[0-9,]*\})?", "", pattern)
        if inner == pattern:
            return False
        pattern = inner
    return " licen[cs]e " in f" {pattern} " or pattern.startswith("spdx license ")


def _rules_column() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(prio).alias("priority"), F.array(*map(F.lit, kws)).alias("kws"), F.lit(p).alias("pattern"), F.lit(needs_license(p)).alias("licensed")) for i, (label, prio, kws, p) in enumerate(RULES)])


_SPAN = "array<struct<start:bigint,end:bigint,rule:int,label:string,priority:int>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, base (places of the base phrases), detections
    (kept, by start) and suppressed (how many were not)."""
    out = docs.withColumn("_norm", normalised(F.col(text)))
    out = out.withColumn("n_words", (F.length("_norm") - F.length(F.replace(F.col("_norm"), F.lit(" "), F.lit(""))) - 1).cast("long"))
    phrases = F.lit("|".join(BASE))
    base = F.when(F.col("_norm").contains(" license "), _places(F.col("_norm"), phrases)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    out = out.withColumn("base", base)
    license_ = F.col("_norm").contains(" license ") | F.col("_norm").contains(" licence ")
    seen = F.array_intersect(F.split("_norm", " "), F.array(*map(F.lit, KEYWORDS)))
    out = out.withColumn("_kws", seen)
    out = out.withColumn("_license", license_)
    due = F.filter(_rules_column(), lambda r: F.arrays_overlap(r["kws"], F.col("_kws")) & (F.col("_license") | ~r["licensed"]))
    out = out.withColumn("_due", F.when(F.size("_kws") > 0, due))
    found = F.flatten(F.transform("_due", lambda r: F.transform(
        F.when(F.regexp_like(F.col("_norm"), F.concat(F.lit(" (?:"), r["pattern"], F.lit(") "))), _places(F.col("_norm"), r["pattern"])).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")),
        lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("neg"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))))
    out = out.withColumn("_found", F.when(F.size("_kws") > 0, F.array_sort(found)).otherwise(F.lit(None)))
    reach = F.greatest(F.lit(1), F.size("_due") * MAX_WORDS)
    out = out.withColumn("_reach", F.when(F.size("_found") > 1, reach).otherwise(F.lit(1)))

    def free(x, i):
        near = F.slice(F.col("_found"), F.greatest(F.lit(1), i + 1 - F.col("_reach")), 2 * F.col("_reach"))
        return ~F.exists(near, lambda y: (y["start"] <= x["start"]) & (y["neg"] <= x["neg"]) & (y["rule"] != x["rule"]) & (
            (y["priority"] < x["priority"]) | (y["priority"] == x["priority"]) & ((y["rule"] < x["rule"]) | (y["start"] < x["start"]) | (y["neg"] < x["neg"]))))

    kept = F.transform(F.filter(F.col("_found"), free), lambda x: F.struct(x["start"].alias("start"), (-x["neg"]).alias("end"), x["rule"].alias("rule"), x["label"].alias("label"), x["priority"].alias("priority")))
    out = out.withColumn("detections", F.coalesce(kept, F.array().cast(_SPAN)))
    out = out.withColumn("suppressed", F.coalesce(F.size("_found"), F.lit(0)) - F.size("detections"))
    return out.drop("_found", "_kws", "_reach", "_due", "_license")


def base_label(norm: Column) -> Column:
    return F.array_compact(F.array(*[F.when(norm.contains(f" {p} "), F.lit(v)) for p, v in BASE.items()]))


def op2(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = out.withColumn("_b", base_label(F.col("_norm")))
    score = F.aggregate("detections", F.when(F.size("base") > 0, F.lit(0.9)).otherwise(F.lit(0.0)), lambda a, d: F.greatest(a, _score(d["priority"])))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.when(F.size("base") > 0, F.array_min(F.transform("base", lambda p: p["start"]))).alias("first_word"),
        F.when(F.size("base") > 0, F.array_max(F.transform("base", lambda p: p["start"]))).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_b")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_b", F.transform("detections", lambda d: d["label"]))), ",").alias("labels"),
        score.alias("score"), F.size("detections").cast("long").alias("n_detections"), F.col("suppressed").cast("long").alias("n_suppressed"))


def _score(priority: Column) -> Column:
    out = F.lit(0.0)
    for p, s in SCORES.items():
        out = F.when(priority == p, F.lit(s)).otherwise(out)
    return out
