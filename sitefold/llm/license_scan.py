"""License scan with a positional index of rare template words; native operators only.

1. Document frequencies of all licence words (the words of the templates) are counted over all documents.
2. Index. Of the mandatory words of every template, those in its key phrases, the ``RARE`` with the highest inverse document
   frequency are indexed: postings word -> (template, position).
3. Look-up. The indexed words that a file holds are looked up, and nothing else: a template is a candidate if all of its
   indexed words turn up. Their positions in the file less those in the template give the places where it would start;
   the lists of these places are intersected. Mandatory words stand in every copy, so this loses none.
4. Verification. At the places left the mandatory words have to stand in theirs; the score is the share of the template's IDF
   weight that stands in place, and from ``LEAST_SCORE`` on gives the template's label. ``score`` is the best of those.

A file costs its words once, and the occurrences of the indexed words that it holds for each candidate; templates that
share no rare word with it cost nothing. Base phrases (``mit license``, ``apache license``, ``general public license``) are found at every
place in the file. Everything happens within a file's row, so there is no shuffle but that of the word counts, which combine before it.

Defined cases: a null text is empty, and an empty text has no words, labels or places and the score 0. Repeated rows
give repeated rows, null keys are kept. Ties between rare words go to the alphabet. Extra columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Whole texts of short licences, as words.
_MIT = """mit license permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to use copy
modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in
all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied
including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event
shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or
otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author
disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event
shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss
of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with
the use or performance of this software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following
disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright
holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable
for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute
goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
advised of the possibility of such damage"""
_ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software
must not be misrepresented you must not claim that you wrote the original software 2 altered source versions must be plainly marked as
such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source
distribution"""

#: Licence notices: label, words, and the phrases that must be there.
TEMPLATES = [
    ("mit-notice", "released under the mit license", ["mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("apache-2.0-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["in compliance with the license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-text", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it", "general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee", "hereby granted"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("mit", _MIT, ["mit license", "permission is hereby granted free of charge", "without warranty of any kind"]),
    ("isc", _ISC, ["with or without fee is hereby granted", "the author disclaims all warranties"]),
    ("bsd-2-clause", _BSD, ["redistribution and use in source and binary forms", "this list of conditions", "provided by the copyright holders"]),
    ("zlib", _ZLIB, ["without any express or implied warranty", "altered source versions must be plainly marked"]),
    ("cc-by-text", "licensed under a creative commons attribution", ["creative commons attribution"]),
]
RARE = 3
LEAST_SCORE = 0.8

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The Kelvin sign is the only character outside ASCII that lower() turns into a letter of ASCII alone.
_KELVIN, _STAND_IN = "\u212a", "\u2126"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


Template = tuple[str, str, list[str]]


def mandatory(template: Template) -> list[int]:
    """Positions of a template's key phrases."""
    label, words, phrases = template
    own, places = words.split(), set()
    for phrase in phrases:
        parts = phrase.split()
        at = next((i for i in range(len(own)) if own[i : i + len(parts)] == parts), None)
        if at is None:
            raise ValueError(f"no such key phrase in the template {label}: {phrase}")
        places.update(range(at, at + len(parts)))
    return sorted(places)


def indexed(templates: list[Template], idf: dict[str, float]) -> list[dict]:
    """Every template with its words, mandatory positions and indexed places, which hold different words."""
    out = []
    for template in templates:
        own, must = template[1].split(), mandatory(template)
        first = {own[p]: p for p in reversed(must)}
        rare = sorted(first, key=lambda w: (-idf[w], w))[:RARE]
        out.append({"label": template[0], "words": own, "must": must, "rare": [{"w": w, "o": first[w]} for w in rare]})
    return out


def postings(index: list[dict]) -> dict[str, list[int]]:
    """Indexed word -> numbers of the templates that it leads to."""
    lists: dict[str, list[int]] = {}
    for number, template in enumerate(index):
        for place in template["rare"]:
            lists.setdefault(place["w"], []).append(number)
    return lists


def vocabulary(templates: list[Template] = TEMPLATES) -> list[str]:
    return sorted({w for _, words, _ in templates for w in words.split()})


def lowered(text: str) -> str:
    """SQL text: A-Z in lower case; what happens to other characters changes no word of the templates."""
    return f"lower(replace(coalesce({text}, ''), '{_KELVIN}', '{_STAND_IN}'))"


def words_sql(low: str) -> str:
    return f"regexp_extract_all({low}, {_quoted(_WORD)}, 0)"


def inverse_frequencies(docs: DataFrame, text: str = "text", templates: list[Template] = TEMPLATES) -> dict[str, float]:
    """IDF of every licence word over all documents: as many numbers as the templates have words, whatever the corpus."""
    known = vocabulary(templates)
    held = f"array_intersect({words_sql(lowered(text))}, array({', '.join(map(_quoted, known))}))"
    words = docs.select(F.expr(f"explode(array_append({held}, ''))").alias("word"))
    counts = {r[0]: r[1] for r in words.groupBy("word").count().collect()}
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in known}


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """Key, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    idf = inverse_frequencies(docs, text, templates)
    index = indexed(templates, idf)
    lists = postings(index)
    weights = f"from_json({_quoted(json.dumps(idf))}, 'map<string, double>')"
    kinds = "array<struct<label: string, words: array<string>, must: array<int>, rare: array<struct<w: string, o: int>>>>"
    known = f"from_json({_quoted(json.dumps(index))}, '{kinds}')"
    lookup = f"from_json({_quoted(json.dumps(lists))}, 'map<string, array<int>>')"
    rare_words = f"array({', '.join(map(_quoted, sorted({*lists, 'license'})))})"

    def step(df: DataFrame, **columns: str) -> DataFrame:
        return df.withColumns({name: F.expr(sql) for name, sql in columns.items()})

    rows = docs.select(F.col(key), F.expr(words_sql(lowered(text))).alias("words"))
    rows = step(rows, n_words="cast(size(words) AS bigint)", present=f"array_intersect(words, {rare_words})")
    # Most files hold no indexed word and end here: all later columns are empty for them.
    occurrences = "filter(transform(words, (w, i) -> CASE WHEN array_contains(present, w) THEN struct(w AS w, i AS i) END), x -> x IS NOT NULL)"
    reached = f"array_distinct(flatten(transform(filter(present, w -> map_contains_key({lookup}, w)), w -> {lookup}[w])))"
    rows = step(rows, occ=f"CASE WHEN size(present) > 0 THEN {occurrences} ELSE filter(array(struct('' AS w, 0 AS i)), x -> false) END")
    rows = step(
        rows,
        places="filter(transform(filter(occ, x -> x.w = 'license'), x -> CASE"
        " WHEN get(words, x.i - 1) = 'mit' THEN struct('mit' AS label, x.i - 1 AS at)"
        " WHEN get(words, x.i - 1) = 'apache' THEN struct('apache' AS label, x.i - 1 AS at)"
        " WHEN get(words, x.i - 1) = 'public' AND get(words, x.i - 2) = 'general' THEN struct('gpl' AS label, x.i - 2 AS at)"
        " END), p -> p IS NOT NULL)",
        candidates=f"filter(transform({reached}, t -> {known}[t]), t -> forall(t.rare, r -> array_contains(present, r.w)))",
    )
    # Starts that one indexed word allows, and of those the ones that the others allow as well.
    allowed = "transform(filter(occ, x -> x.w = {0}.w), x -> x.i - {0}.o)"
    rows = step(
        rows,
        starts=f"transform(candidates, t -> struct(t AS t, aggregate(slice(t.rare, 2, {RARE}), element_at(transform(slice(t.rare, 1, 1), r -> {allowed.format('r')}), 1),"
        f" (left, r) -> array_intersect(left, {allowed.format('r')})) AS starts))",
    )
    rows = step(
        rows,
        verified="filter(flatten(transform(starts, x -> transform("
        "filter(x.starts, s -> forall(x.t.must, p -> coalesce(get(words, s + p) = x.t.words[p], false))),"
        f" s -> struct(x.t.label AS label, aggregate(transform(x.t.words, (v, o) -> CASE WHEN get(words, s + o) = v THEN {weights}[v] ELSE 0D END), 0D, (a, b) -> a + b)"
        f" / aggregate(x.t.words, 0D, (a, v) -> a + {weights}[v]) AS score)))), x -> x.score >= {LEAST_SCORE})",
    )
    base = "array_sort(array_distinct(transform(places, p -> p.label)))"
    return rows.select(
        key,
        "n_words",
        F.expr("cast(size(places) AS bigint)").alias("n_base"),
        F.expr("cast(array_min(transform(places, p -> p.at)) AS bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(places, p -> p.at)) AS bigint)").alias("last_word"),
        F.expr(f"array_join({base}, ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_distinct(concat({base}, transform(verified, x -> x.label)))), ',')").alias("labels"),
        F.expr("least(1D, coalesce(array_max(transform(verified, x -> x.score)), 0D))").alias("score"),
    )


def templates_by_brute_force(texts: list[str | None], templates: list[Template] = TEMPLATES) -> list[tuple[str, float]]:
    """(labels of templates, score) of each text by comparing every template at every place, for tests."""
    lower = {i: i + 32 for i in range(65, 91)}
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in texts]
    known = vocabulary(templates)
    counts = {w: sum(w in set(words) for words in split) for w in known}
    idf = {w: math.log((len(texts) + 1) / (counts[w] + 1)) + 1 for w in known}
    found = []
    for words in split:
        best = {}
        for template in templates:
            own, must = template[1].split(), mandatory(template)
            for s in range(-len(own), len(words)):
                if all(0 <= s + p < len(words) and words[s + p] == own[p] for p in must):
                    there = sum(idf[v] for o, v in enumerate(own) if 0 <= s + o < len(words) and words[s + o] == v)
                    score = there / sum(idf[v] for v in own)
                    if score >= LEAST_SCORE:
                        best[template[0]] = max(score, best.get(template[0], 0))
        found.append((",".join(sorted(best)), max(best.values(), default=0.0)))
    return found


def scan_by_brute_force(texts: list[str | None]) -> list[tuple[int, int | None, int | None, str]]:
    """(n_base, first_word, last_word, base_labels) of each text, for tests."""
    found = []
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    lower = {i: i + 32 for i in range(65, 91)}
    for text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        at = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        places = [i for i, _ in at]
        found.append((len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    return found
