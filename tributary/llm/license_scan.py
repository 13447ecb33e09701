"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and cut into words, runs of characters other than ASCII ones that
are no digit or letter; each word then stands between spaces of its own. A rule is a regular
expression over such words with keywords, a label, a confidence and a priority (its place in
the list). Rules are sentences of license texts and notices, written out one by one, and license
names in the frames that they are used in. A text is looked at further only if it holds a
keyword of some rule, a rule's expression runs only if the text holds the rule's own, and no
other gate stands before them. Every match has an interval; a match is suppressed if another
match contains it, and of matches with one interval the rule with the higher priority stays.

Three base phrases are counted apart from the rules, and their labels always stay.

Everything is a DataFrame expression. Defined results: a null text is empty; a text without
words or detections has empty labels, score 0 and null places; repeated rows and null ids keep
a row each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.store import documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Public license names, as (label, keyword, name in words).
FAMILIES = (
    ("mit", "mit", "mit(?: x11)?"),
    ("mit-0", "mit", "mit no attribution"),
    ("isc", "isc", "isc"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?v?2(?: 0)?"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "bsd", "(?:zero clause bsd|0bsd)"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("gpl-2.0", "general", "(?:gnu )?general public license(?: version)? ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: version)? ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "general", "(?:gnu )?general public license(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public license(?: version)? ?v?2(?: 1)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version)? ?v?2(?: 1)?(?: only| or later)?"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public license(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl", "general", "(?:gnu )?general public license"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public license"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl", "affero", "(?:gnu )?affero general public license"),
    ("gfdl", "documentation", "(?:gnu )?free documentation license"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version)? 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version)? ?v?2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version)? ?v?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version)? ?v?2(?: 0)?"),
    ("cddl-1.0", "distribution", "common development and distribution license"),
    ("cpl-1.0", "common", "common public license"),
    ("eupl-1.2", "european", "european union public licence"),
    ("artistic-2.0", "artistic", "artistic license(?: 2 0)?"),
    ("bsl-1.0", "boost", "boost software license"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?"),
    ("cc0-1.0", "zero", "creative commons zero(?: 1 0)?"),
    ("cc-by-4.0", "by", "cc by(?: license)? 4 0(?: international)?"),
    ("cc-by-4.0", "attribution", "creative commons attribution(?: license)? 4 0(?: international)?"),
    ("cc-by-3.0", "by", "cc by(?: license)? 3 0(?: unported)?"),
    ("cc-by-3.0", "attribution", "creative commons attribution(?: license)? 3 0(?: unported)?"),
    ("cc-by-sa", "sa", "cc by sa(?: [1-4] 0)?"),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike(?: [1-4] 0)?"),
    ("cc-by-nc", "nc", "cc by nc(?: [1-4] 0)?"),
    ("cc-by-nc", "attribution", "creative commons attribution non ?commercial(?: [1-4] 0)?"),
    ("cc-by-nd", "nd", "cc by nd(?: [1-4] 0)?"),
    ("cc-by-nd", "attribution", "creative commons attribution no ?derivatives(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "sa", "cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "nd", "cc by nc nd(?: [1-4] 0)?"),
    ("cc-by", "by", "cc by"),
    ("cc-by", "attribution", "creative commons attribution"),
    ("odbl-1.0", "odbl", "odbl"),
    ("odbl-1.0", "database", "open database license"),
    ("odc-by-1.0", "open", "open data commons attribution license"),
    ("pddl-1.0", "pddl", "pddl"),
    ("psf-2.0", "python", "python software foundation license"),
    ("php-3.01", "php", "php license"),
    ("ruby", "ruby", "ruby license"),
    ("postgresql", "postgresql", "postgresql license"),
    ("openssl", "openssl", "openssl license"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: 1 1)?"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("upl-1.0", "universal", "universal permissive license"),
    ("vim", "vim", "vim license"),
    ("w3c", "w3c", "w3c software notice and license"),
    ("openrail", "rail", "open ?rail(?: m)?"),
    ("openrail", "responsible", "responsible ai license(?: m)?"),
    ("elastic-2.0", "elastic", "elastic license(?: 2 0)?"),
    ("busl-1.1", "business", "business source license(?: 1 1)?"),
    ("sspl-1.0", "server", "server side public license"),
)

#: How a name is used, from the surest to the weakest: (pattern, keyword, confidence).
USES = (
    ("spdx license identifier {name}", "spdx", 1.0),
    ("(?:licensed|released|distributed|published|available|provided|covered|redistributed) under(?: the)?(?: terms of)?(?: the)?(?: conditions of the)? {name}(?: licen[sc]e)?", "under", 0.95),
    ("(?:license|licence|licensed|licensing)(?: is| as)? {name}", "licen", 0.8),
    ("(?:the )?{name} licen[sc]e", "licen", 0.7),
)

#: Sentences of licenses and notices: (label, keyword, pattern, confidence).
NOTICES = (
    ("mit", "sublicense", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", 0.95),
    ("mit", "substantial", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", 0.95),
    ("x11", "contained", "except as contained in this notice the name of", 0.8),
    ("isc", "appear", "provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd-3-clause", "endorse", "(?:may be used|be used) to endorse or promote products derived from this software", 0.9),
    ("bsd-4-clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 0.95),
    ("apache-2.0", "required", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.95),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "governing", "see the license for the specific language governing permissions and limitations under the license", 0.9),
    ("apache-2.0", "patent", "grant of patent license subject to the terms and conditions of this license", 0.9),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 0.85),
    ("gpl-2.0", "later", "either version 2 of the license or at your option any later version", 0.9),
    ("gpl-3.0", "later", "either version 3 of the license or at your option any later version", 0.9),
    ("lgpl-2.1", "later", "either version 2 1 of the license or at your option any later version", 0.95),
    ("gpl", "hope", "this program is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("lgpl", "hope", "this library is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with this", 0.95),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license along with this", 0.95),
    ("agpl", "received", "you should have received a copy of the gnu affero general public license along with this", 0.95),
    ("gpl", "foundation", "write to the free software foundation inc", 0.7),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.9),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("gpl", "freedom", "the licenses for most software (?:and other practical works )?are designed to take away your freedom", 0.9),
    ("agpl-3.0", "remotely", "your modified version must prominently offer all users interacting with it remotely", 0.95),
    ("agpl-3.0", "remote", "remote network interaction use with the gnu general public license", 0.95),
    ("gpl-3.0", "section", "under section 7 of gpl version 3 you are granted additional permissions", 0.9),
    ("gpl", "linking", "linking this library statically or dynamically with other modules is making a combined work based on this library", 0.8),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts", 0.9),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 0.95),
    ("mpl-2.0", "secondary", "incompatible with secondary licenses as defined by the mozilla public license", 0.9),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license", 0.95),
    ("cddl-1.0", "development", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cddl-1.0", "cddl", "when distributing covered code include this cddl header in each file", 0.95),
    ("cpl-1.0", "recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", 0.8),
    ("bsl-1.0", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("bsl-1.0", "executable", "solely in the form of machine executable object code generated by a source language processor", 0.95),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 0.95),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 0.95),
    ("zlib", "liable", "in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 0.9),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights", 0.95),
    ("cc0-1.0", "cc0", "the person who associated cc0 with this work", 0.95),
    ("cc", "creative", "this work is licensed under a creative commons", 0.7),
    ("cc-by", "credit", "you must give appropriate credit provide a link to the license and indicate if changes were made", 0.9),
    ("cc", "redistribute", "you are free to share copy and redistribute the material in any medium or format", 0.8),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", 0.95),
    ("cc-by-nd", "remix", "if you remix transform or build upon the material you may not distribute the modified material", 0.95),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes", 0.95),
    ("odbl-1.0", "database", "this database is made available under the open database license", 1.0),
    ("dbcl-1.0", "database", "any rights in individual contents of the database are licensed under the database contents license", 1.0),
    ("odbl-1.0", "openstreetmap", "openstreetmap contributors", 0.5),
    ("psf-2.0", "psf", "psf is making python available to licensee on an as is basis", 1.0),
    ("artistic-1.0", "intent", "the intent of this document is to state the conditions under which a package may be copied", 0.95),
    ("artistic-2.0", "establishes", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 0.9),
    ("perl", "perl", "under the same terms as perl itself", 0.9),
    ("ruby", "ruby", "under the same terms as ruby itself", 0.9),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by", 0.8),
    ("postgresql", "agreement", "without fee and without a written agreement is hereby granted", 0.9),
    ("hpnd", "documentation", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 0.95),
    ("hpnd", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 0.95),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license", 1.0),
    ("ofl-1.1", "font", "the font software may be sold as part of a larger software package", 0.9),
    ("ofl-1.1", "font", "with reserved font name", 0.9),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("ncsa", "deal", "to deal with the software without restriction including without limitation", 0.9),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim", 1.0),
    ("w3c", "comply", "you the licensee agree that you have read understood and will comply with the following terms and conditions", 0.8),
    ("tcl", "hereby", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", 0.9),
    ("curl", "notice", "copyright and permission notice", 0.5),
    ("openrail", "restrictions", "use based restrictions as referenced in paragraph 5", 0.95),
    ("llama", "llama", "llama [1-4](?: 1)? community license agreement", 0.95),
    ("elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("busl-1.1", "production", "redistribute and make non production use of the licensed work", 1.0),
    ("busl-1.1", "grant", "additional use grant", 0.5),
    ("sspl-1.0", "functionality", "if you make the functionality of the program or a modified version available to third parties as a service", 1.0),
    ("commons-clause", "clause", "commons clause license condition", 0.95),
    ("commons-clause", "grant", "the license does not grant to you the right to sell the software", 0.95),
    ("polyform-noncommercial", "polyform", "polyform noncommercial license", 1.0),
    ("polyform-shield", "polyform", "polyform shield license", 1.0),
    ("json", "evil", "the software shall be used for good not evil", 1.0),
    ("beerware", "beer", "you can buy me a beer in return", 1.0),
    ("blueoak-1.0.0", "oak", "blue oak model license", 1.0),
    ("afl-3.0", "academic", "academic free license", 0.9),
    ("osl-3.0", "open", "open software license", 0.8),
    ("cecill", "cecill", "cecill(?: [bc])?(?: free software)? license agreement", 0.9),
    ("mulan-psl-2.0", "mulan", "mulan psl v2", 0.95),
    ("ogl-uk", "government", "open government licen[sc]e", 0.9),
    ("ogl-uk", "sector", "contains public sector information licensed under", 0.8),
    ("crown", "crown", "crown copyright", 0.7),
    ("public-domain", "domain", "this (?:work|file|image|software|document|text) is in the public domain", 0.9),
    ("public-domain", "government", "(?:a )?work of the (?:united states|u s|us) government", 0.8),
    ("public-domain", "subject", "not subject to copyright protection", 0.8),
    ("public-domain", "known", "no known copyright restrictions", 0.8),
    ("public-domain", "expired", "copyright has expired", 0.7),
    ("public-domain", "interest", "dedicates? any and all copyright interest", 0.9),
    ("gutenberg", "gutenberg", "project gutenberg license", 0.9),
    ("arxiv", "arxiv", "arxiv org perpetual non exclusive license", 0.9),
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 0.9),
    ("public-domain", "domain", "(?:dedicated to|released into|placed in|in) the public domain", 0.8),
    ("proprietary", "propriet", "proprietary and confidential", 0.8),
    ("proprietary", "confidential", "(?:this software is )?the confidential and proprietary information of", 0.8),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|distribution|reproduction|duplication)(?: of this (?:file|software|document|work)(?: via any medium)?)? is (?:strictly )?prohibited", 0.8),
    ("proprietary", "reproduced", "no part of this (?:publication|document|work|book|website) may be reproduced", 0.8),
    ("proprietary", "redistribut", "(?:do not|may not be) redistribute[d]?", 0.6),
    ("proprietary", "permission", "(?:reproduced|copied|used|distributed|reproduction) without (?:the )?(?:prior |express )?(?:written )?permission", 0.6),
    ("proprietary", "internal", "for internal use only", 0.6),
    ("proprietary", "evaluation", "for evaluation purposes only", 0.6),
    ("proprietary", "eula", "end user license agreement eula", 0.7),
    ("proprietary", "license", "end user license agreement", 0.6),
    ("proprietary", "secrets", "contains trade secrets", 0.6),
    ("noncommercial", "commercial", "for (?:personal and |personal or )?non ?commercial use only", 0.7),
    ("noncommercial", "free", "free for (?:personal|academic|educational|non ?commercial) use", 0.6),
    ("noncommercial", "research", "for research purposes only", 0.6),
    ("permission", "permission", "(?:used|reprinted|reproduced) (?:with|by) permission", 0.5),
    ("patent", "patent", "patents? pending", 0.4),
    ("warranty", "warrant", "(?:as is )?without warrant(?:y|ies)(?: or conditions)? of any kind", 0.4),
    ("warranty", "merchantability", "implied warranties of merchantability", 0.4),
    ("warranty", "liable", "in no event shall the (?:authors|author|copyright holders|copyright owner|regents) (?:or copyright holders |or contributors )?be liable", 0.4),
    ("warranty", "provided", "(?:the software|this software) is provided as is", 0.4),
    ("dual", "dual", "dual licensed", 0.5),
    ("see-file", "file", "see (?:the )?(?:license|licence|copying|notice) file", 0.3),
    ("see-file", "details", "(?:license|licence) file for (?:more )?details", 0.3),
    ("copyright", "copyright", "copyright(?: c)?(?: (?:19|20)[0-9][0-9])+(?: [a-z]+)?", 0.5),
    ("reserved", "reserved", "(?:all|some|no) rights reserved", 0.5),
)


def rules() -> list[dict]:
    """The ordered rules; priority is the place in the list."""
    found = [(label, (key, use_key), use.format(name=name), confidence) for use, use_key, confidence in USES for label, key, name in FAMILIES]
    found = [(label, (key, key), pattern, confidence) for label, key, pattern, confidence in NOTICES] + found
    return [
        {"priority": i, "label": label, "key": key, "use_key": use_key, "pattern": f" {_spaced(pattern)} ", "confidence": confidence}
        for i, (label, (key, use_key), pattern, confidence) in enumerate(found)
    ]


#: What a text must hold for any rule to match it.
GATE = sorted({use_key for _, use_key, _ in USES} | {key for _, key, _, _ in NOTICES})
GATE = tuple(k for k in GATE if not any(other in k for other in GATE if other != k))


def _spaced(pattern: str) -> str:
    """Between two words stand two spaces, one of each word's own; ` ?` makes the gap optional."""
    return pattern.replace(" ?", "(?:  )?").replace(" ", "\x00").replace("(?:\x00\x00)?", "(?:  )?").replace("\x00", "  ")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _rule_array(keys: list[str]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r["priority"]).alias("priority"),
                F.lit(r["label"]).alias("label"),
                F.lit(keys.index(r["key"])).alias("key"),
                F.lit(keys.index(r["use_key"])).alias("use_key"),
                F.lit(r["pattern"]).alias("pattern"),
                F.lit(float(r["confidence"])).alias("confidence"),
            )
            for r in rules()
        ]
    )


#: Intervals of one rule's matches: the lengths of what stands before and of earlier matches, summed.
SPANS = """aggregate(sequence(1, size(found)), named_struct('at', 0, 'out', cast(array() as array<struct<first:int,back:int,priority:int,label:string,confidence:double>>)),
    (s, i) -> named_struct(
        'at', s.at + length(pieces[i - 1]) + length(found[i - 1]),
        'out', array_append(s.out, named_struct('first', s.at + length(pieces[i - 1]), 'back', -(s.at + length(pieces[i - 1]) + length(found[i - 1])), 'priority', rule.priority, 'label', rule.label, 'confidence', rule.confidence))),
    s -> s.out)"""
MATCHES = f"""flatten(transform(filter(rules, r -> held[r.key] and held[r.use_key]),
    rule -> aggregate(array(regexp_extract_all(spaced, rule.pattern, 0)), cast(array() as array<struct<first:int,back:int,priority:int,label:string,confidence:double>>),
        (none, found) -> if(size(found) = 0, none, aggregate(array(split(spaced, rule.pattern, -1)), none, (also, pieces) -> {SPANS})))))"""
#: Matches in order of start and falling end: one is contained in an earlier one if it ends no later than any so far.
KEPT = """aggregate(matches, named_struct('most', -1, 'labels', cast(array() as array<string>), 'n', 0, 'best', 0D),
    (s, m) -> if(-m.back <= s.most, s, named_struct('most', -m.back, 'labels', array_union(s.labels, array(m.label)), 'n', s.n + 1, 'best', greatest(s.best, m.confidence))))"""


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base counts and places, labels, number of kept detections and score of every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)  # a superset of the A-Z lower-casing, good enough for gates
    some = lambda words: F.greatest(*[low.contains(w) for w in words])
    gated = docs.select(
        "doc_id",
        text.alias("text"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        some(GATE).alias("gate"),
        (low.contains("cc") & low.contains("by")).alias("gate_by"),
    )
    words = F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), GAP, " "))
    spaced = gated.select("*", F.when(F.col("gate") | F.col("gate_by"), F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))).alias("spaced")).drop("text")
    counted = spaced
    for i, (phrase, _) in enumerate(BASE):
        wide = f" {phrase.replace(' ', '  ')} "
        n = (F.length("spaced") - F.length(F.replace(F.col("spaced"), F.lit(wide), F.lit("")))) / len(wide)
        head = F.substring_index("spaced", wide, 1)
        tail = F.substring_index("spaced", wide, -1)
        counted = counted.withColumn(f"n{i}", F.coalesce(n, F.lit(0)).cast("long"))
        counted = counted.withColumn(f"first{i}", F.when(F.col(f"n{i}") > 0, _spaces(head) / 2)).withColumn(
            f"last{i}", F.when(F.col(f"n{i}") > 0, F.col("n_words") - _spaces(tail) / 2 - len(phrase.split()))
        )
    keys = sorted({r[k] for r in rules() for k in ("key", "use_key")})
    held = F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains("spaced", k))
    matched = (
        counted.withColumn("held", F.when(F.col("gate"), held))
        .withColumn("rules", F.when(F.col("gate"), _rule_array(keys)))
        .withColumn("matches", F.array_sort(F.expr(MATCHES)))
        .drop("rules", "held", "spaced")
        .withColumn("kept", F.expr(KEPT))
        .drop("matches")
    )
    base = F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("kept.labels", F.array().cast("array<string>")))))
    n_base = sum((F.col(f"n{i}") for i in range(1, len(BASE))), F.col("n0"))
    return matched.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*[f"first{i}" for i in range(len(BASE))]).cast("long").alias("first_word"),
        F.greatest(*[f"last{i}" for i in range(len(BASE))]).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("kept.best", F.lit(0.0)), F.when(n_base > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("kept.n", F.lit(0)).cast("long").alias("n_detections"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    values = ",\n".join(f"({r['priority']}, '{r['label']}', '{r['key']}', '{r['use_key']}', '{r['pattern']}', {r['confidence']}::DOUBLE)" for r in rules())
    phrases = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in BASE)
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                      regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    w AS (SELECT doc_id, len(ws) AS n_words, ws, ' ' || array_to_string(ws, '  ') || ' ' AS spaced FROM d),
    p(phrase, label, n) AS (VALUES {phrases}),
    h AS (SELECT doc_id, label, i - 1 AS start FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) JOIN p ON array_to_string(ws[i:i + n - 1], ' ') = phrase),
    b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS base FROM h GROUP BY doc_id),
    r(priority, label, key, use_key, pattern, confidence) AS (VALUES {values}),
    f AS (SELECT doc_id, priority, label, confidence, spaced, regexp_extract_all(spaced, pattern) AS found, string_split_regex(spaced, pattern) AS pieces
          FROM w JOIN r ON contains(spaced, key) AND contains(spaced, use_key)),
    s AS (SELECT doc_id, priority, label, confidence,
                 list_sum(list_transform(pieces[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS a, length(found[i]) AS n
          FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM f WHERE len(found) > 0)),
    m AS (SELECT doc_id, label, confidence, coalesce(max(a + n) OVER (PARTITION BY doc_id ORDER BY a, -(a + n), priority, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS most, a + n AS e FROM s),
    k AS (SELECT doc_id, list(DISTINCT label) AS ls, max(confidence) AS best, count(*) AS n FROM m WHERE e > most GROUP BY doc_id)
    SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(ls, [])))), ','), '') AS labels,
           greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score, coalesce(n, 0)::BIGINT AS n_detections
    FROM w LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLE = {"op9_license_scan": _oracle()}
