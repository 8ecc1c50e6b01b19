"""Licence scan with a positional index of rare words.

Templates are indexed by word and position. For each file, its licence words of highest inverse
document frequency (over the whole corpus) are looked up, the rarest first, until each template has met
RARE of its words; postings are intersected by relative
position: a template is a candidate where enough of the words looked up agree on where it would begin. It is
reported if its mandatory phrases stand within that place. Templates are passages of whole licence texts, file
headers with their versions, notices and SPDX tags; a label is the part of a template's name before "/".

A text is split into words once: that pass counts words and base phrases, notes which licence words the
file holds, and keeps the text only of files that hold every word of some template's mandatory phrases and enough
of its words. Document frequencies and the positional search then read that written table.

Edge cases: null and empty texts have no words and no labels ("" and null positions); repeated
rows are scanned one by one; long texts are scanned whole; words of equal frequency are looked up in
alphabetical order; a template of fewer words than RARE is looked up by all of them; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, durable, map_texts, py_lower

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Passages of public licences, and phrases that must stand in them.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "sublicense and or sell copies"),
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        ("in compliance with the license", "unless required by applicable law"),
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("free software you can redistribute it", "free software foundation"),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute", "with or without fee is hereby granted"),
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("subject to the terms of the mozilla public license", "source code form"),
    ),
    "bsd/disclaimer": (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
        ("provided by the copyright holders and contributors as is", "fitness for a particular purpose are disclaimed"),
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("library is free software you can redistribute it", "gnu lesser general public license"),
    ),
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("free software you can redistribute it", "gnu affero general public license"),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software released into the public domain",),
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ("in no event will the authors be held liable", "to alter it and redistribute it freely"),
    ),
    "boost": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ("any person or organization obtaining a copy", "prepare derivative works of the software"),
    ),
    "epl": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at",
        ("under the terms of the eclipse public license",),
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    "cc0": (
        "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
        ("dedicated all copyright and related and neighboring rights",),
    ),
    "apache/short": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "gpl/short": ("this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "mit/short": ("released under the mit license", ("released under the mit license",)),
    "mit/condition": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("shall be included in all copies or substantial portions of the software",)),
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    "apache-2.0/text": (
        "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
        ("apache license version 2 0 january 2004", "as defined by sections 1 through 9 of this document"),
    ),
    "gpl-2.0": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license", "version 2 of the license"),
    ),
    "gpl-2.0/text": (
        "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        ("gnu general public license version 2 june 1991",),
    ),
    "gpl-3.0": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license", "version 3 of the license"),
    ),
    "gpl-3.0/text": (
        "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        ("gnu general public license version 3 29 june 2007",),
    ),
    "gpl-3.0/short": ("this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "lgpl-2.1": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("gnu lesser general public license", "version 2 1 of the license"),
    ),
    "lgpl-2.1/text": (
        "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        ("gnu lesser general public license version 2 1 february 1999",),
    ),
    "lgpl-3.0": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu lesser general public license", "version 3 of the license"),
    ),
    "lgpl-3.0/text": (
        "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        ("gnu lesser general public license version 3 29 june 2007",),
    ),
    "agpl-3.0": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu affero general public license", "version 3 of the license"),
    ),
    "agpl-3.0/text": (
        "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        ("gnu affero general public license version 3 19 november 2007",),
    ),
    "bsd-3-clause": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("may be used to endorse or promote products derived from this software", "without specific prior written permission"),
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("mozilla public license v 2 0",),
    ),
    "mpl-2.0/text": (
        "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
        ("mozilla public license version 2 0", "owns covered software"),
    ),
    "epl-2.0/text": (
        "eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement",
        ("eclipse public license v 2 0", "constitutes recipient s acceptance of this agreement"),
    ),
    "boost-1.0/text": ("boost software license version 1 0 august 17th 2003", ("boost software license version 1 0",)),
    "wtfpl": ("do what the fuck you want to public license", ("what the fuck you want to public license",)),
}
# Identifiers in SPDX tags.
SPDX = (
    "0BSD AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib"
)
# A tag is its own mandatory phrase; GPL-2.0-only and GPL-2.0-or-later begin as GPL-2.0 does and have its label.
TAGS = {name.lower(): " ".join(["spdx license identifier", *re.findall(ALNUM, name.lower())]) for name in SPDX.split()}
TEMPLATES |= {f"{name}/tag": (tag, (tag,)) for name, tag in TAGS.items()}
VOCABULARY = frozenset(w for t, _ in TEMPLATES.values() for w in t.split())


#: Words of a template that are looked up; share of them that must agree; places that they may be off.
RARE, NEED, SLACK = 24, 0.5, 3


#: Per template: its words, how many of them are looked up, and the words of its mandatory phrases.
WORDS = {name: frozenset(text.split()) for name, (text, _) in TEMPLATES.items()}
SIZE = {name: min(RARE, len(ws)) for name, ws in WORDS.items()}
MANDATORY = {name: frozenset(" ".join(phrases).split()) for name, (_, phrases) in TEMPLATES.items()}


def label(template: str) -> str:
    return template.split("/")[0]


def possible(present: frozenset[str]) -> list[str]:
    """Templates that a file with these licence words can hold."""
    return [name for name, must in MANDATORY.items() if must <= present and len(WORDS[name] & present) >= NEED * SIZE[name]]


def find_phrase(ws: list[str], phrase: list[str], at: int = 0, end: int | None = None) -> list[int]:
    """Each place where the phrase's words stand consecutively."""
    end, n, out = len(ws) if end is None else end, len(phrase), []
    try:
        while True:
            at = ws.index(phrase[0], at, end - n + 1 if end - n + 1 > 0 else 0)
            if ws[at : at + n] == phrase:
                out.append(at)
            at += 1
    except ValueError:
        return out


class Index:
    """Word -> postings: of each template that holds it, the positions."""

    def __init__(self, idf: dict[str, float]):
        self.order = {w: i for i, w in enumerate(sorted(VOCABULARY, key=lambda w: (-idf[w], w)))}
        self.postings: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, (text, _) in TEMPLATES.items():
            for i, w in enumerate(text.split()):
                self.postings[w][name].append(i)

    def scan(self, ws: list[str]) -> dict[str, float]:
        """Label -> the share of the template's words looked up that agree, if its phrases are there."""
        present = VOCABULARY.intersection(ws)
        # The file's rarest licence words, as many as each template takes.
        wanted = {name: sorted(WORDS[name] & present, key=self.order.__getitem__)[:RARE] for name in possible(present)}
        if not wanted:
            return {}
        places: dict[str, list[int]] = {w: [] for own in wanted.values() for w in own}
        for at, w in enumerate(ws):
            if w in places:
                places[w].append(at)
        best: dict[str, float] = {}
        for name, own in wanted.items():
            votes: dict[int, set[str]] = defaultdict(set)
            for w in own:
                starts = {at - i + d for at in places[w] for i in self.postings[w][name] for d in range(-SLACK, SLACK + 1)}
                for start in starts:
                    votes[start].add(w)
            text, phrases = TEMPLATES[name]
            for start, agreed in votes.items():
                share = len(agreed) / SIZE[name]
                if share >= NEED and share > best.get(label(name), 0):
                    lo, hi = max(0, start - SLACK), min(len(ws), start + len(text.split()) + 2 * SLACK)
                    if all(find_phrase(ws, p.split(), lo, hi) for p in phrases):
                        best[label(name)] = share
        return best


def licence_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels; seen: numbers of the licence words that the
    document holds; file: its text if it can hold a template, else null."""
    find, phrases = re.compile(ALNUM).findall, [(p.split(), name) for p, name in BASE.items()]
    number = {w: i for i, w in enumerate(sorted(VOCABULARY))}

    def read(texts: list[str]) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "seen", "file")}
        for t in texts:
            ws = find(py_lower(t))
            present, places, base = VOCABULARY.intersection(ws), [], set()
            if "license" in present:
                for p, name in phrases:
                    if got := find_phrase(ws, p):
                        places += got
                        base.add(name)
            row = (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), sorted(number[w] for w in present), t if possible(present) else None)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    return map_texts(docs, text_col, [id_col], read, "n_words long, n_base long, first_word long, last_word long, base_labels string, seen array<int>, file string")


def document_frequencies(read: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, and how many documents there are: at most as many
    rows as the templates have words come to the driver."""
    named = sorted(VOCABULARY)
    df = {r["word"]: r["count"] for r in read.select(F.explode(F.concat("seen", F.array(F.lit(-1)))).alias("word")).groupBy("word").count().collect()}
    n = df.pop(-1, 0)
    return {named[i]: c for i, c in df.items()}, n


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the best template's share of agreeing rare words; at least 0.5 where a base phrase stands."""
    read = durable(licence_words(docs, id_col, text_col), "licence_words")
    df, n = document_frequencies(read)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in VOCABULARY}
    find = re.compile(ALNUM).findall
    here: list[Index] = []

    def scan(texts: list[str]) -> dict:
        if not here:
            here.append(Index(idf))
        got = [here[0].scan(find(py_lower(t))) if t else {} for t in texts]
        return {"more": [sorted(g) for g in got], "share": [max(g.values(), default=0.0) for g in got]}

    kept = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels"]
    found = map_texts(read, "file", kept, scan, "more array<string>, share double")
    base = F.array_remove(F.split("base_labels", ","), "")
    labels = F.array_join(F.array_sort(F.array_union(base, "more")), ",")
    return found.select(*kept, labels.alias("labels"), F.greatest("share", F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"))
