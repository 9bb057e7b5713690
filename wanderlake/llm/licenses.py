"""Operator 9, licence scans by sentence rules.

A text falls into pieces (lines, and parts of lines that end in ``.``, ``;``, ``:``, ``!`` or ``?`` before white space); a piece is
normalised to lower-case letters and digits with single blanks, so comment marks fall away (``rem`` and ``dnl`` too). A
known sentence is a piece or several in a row, as in notices wrapped over lines or with marks inside; it crosses no
blank line and enters no list item; a licence's title may stand before it. A sentence that names a holder
counts with any name of up to ``HOLDER_WORDS`` words. SPDX lines are sentences of their licences. A known normalised sentence has an identifier; a licence rule is an ordered list of identifiers, which matches where they follow each
other with at most ``gap`` other sentences between. Where rules overlap, the longer one stands.

Defined results: a null or empty text has no match; rules match as often as they occur, repeated rows
count each, an empty table gives an empty result; columns not named are ignored or passed along.
Whole texts are read; the tables are fixed and small, so nothing is broadcast that grows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

# Licence sentences in normal form, by identifier.
SENTENCES = {
    "apache-grant": "licensed under the apache license version 2 0",
    "apache-grant-long": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "mit-project": "this project is licensed under the mit license",
    "mit-short": "licensed under mit",
    "apache-head": "apache license version 2 0 january 2004 http www apache org licenses",
    "gpl3-head": "gnu general public license version 3 29 june 2007",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-long": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "epl-made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-distributed": "distributed under the boost software license version 1 0",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "wtfpl-copy": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
}

# Licence -> rules, each an ordered list of sentence identifiers.
RULES = {
    "Apache-2.0": [["apache-grant"], ["apache-head"], ["apache-grant-long", "apache-compliance", "apache-obtain"], ["apache-compliance", "apache-obtain", "apache-url", "apache-as-is", "apache-see"]],
    "MIT": [["mit-notice"], ["mit-licensed"], ["mit-project"], ["mit-short"], ["mit-grant", "mit-condition"]],
    "ISC": [["isc-grant"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-author"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "GPL-3.0-or-later": [["gpl-free", "gpl-hope", "gpl-see"]],
    "GPL-2.0-or-later": [["gpl2-free", "gpl-hope", "gpl-see"]],
    "GPL-3.0": [["gpl3-work"], ["gpl3-head"]],
    "MPL-2.0": [["mpl-subject", "mpl-copy"]],
    "CC-BY-4.0": [["cc-by"], ["cc-by-work"], ["cc-by-long"]],
    "CC-BY-SA-4.0": [["cc-by-sa"], ["cc-by-sa-work"]],
    "CC-BY-NC-4.0": [["cc-by-nc"]],
    "CC-BY-ND-4.0": [["cc-by-nd"]],
    "CC0-1.0": [["cc0"]],
    "Unlicense": [["unlicense"]],
    "GPL-2.0-only": [["gpl2-only"]],
    "GPL-3.0-only": [["gpl3-only"]],
    "LGPL-2.1-or-later": [["lgpl21-free", "lgpl-hope", "lgpl-see"]],
    "LGPL-3.0-or-later": [["lgpl3-free", "lgpl-hope", "lgpl-see"]],
    "AGPL-3.0-or-later": [["agpl-free", "gpl-hope", "agpl-see"]],
    "EPL-2.0": [["epl-made"]],
    "0BSD": [["0bsd-grant"]],
    "Zlib": [["zlib-as-is", "zlib-liable", "zlib-grant"]],
    "BSL-1.0": [["bsl-distributed"], ["bsl-grant"]],
    "WTFPL": [["wtfpl-copy"]],
}

# Titles in normal form that may stand before a licence's first sentence.
TITLES = ["the mit license mit", "the mit license", "mit license", "isc license", "bsd 2 clause license", "bsd 3 clause license", "bsd zero clause license", "apache license version 2 0", "zlib license", "boost software license version 1 0 august 17th 2003"]

# Sentences that name a holder: what stands before, what the tables say for the holder, and what comes behind.
HOLDERS = [("neither the name of", "the copyright holder", "nor the names of its contributors"), ("the name of", "the author", "may not be used to endorse")]
#: Words of a holder's name.
HOLDER_WORDS = 12

for _name in RULES:
    SENTENCES[f"spdx-{_name}"] = "spdx license identifier " + re.sub("[^a-z0-9]+", " ", _name.lower())
    RULES[_name].insert(0, [f"spdx-{_name}"])

_SENTENCE = re.compile(r".+?(?:[.;:!?](?=\s)|$)")
_COMMENT_WORD = re.compile(r"\s*(?:rem|dnl)\s+", re.IGNORECASE)
_ITEM = re.compile(r"\s*([-+•])\s")
_OTHER = re.compile(r"[^a-z0-9]+")
_KEPT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def normal(sentence: str) -> str:
    """A sentence in normal form."""
    return _OTHER.sub(" ", sentence.lower()).strip()


def unnamed(said: str) -> str:
    """A sentence, or its beginning, in normal form with the holder it names put as the tables put holders."""
    for lead, holder, tail in HOLDERS:
        if said.startswith(lead + " "):
            name, found, rest = said[len(lead) + 1 :].partition(f" {tail}")
            words = name.count(" ") + 1
            if found and words <= HOLDER_WORDS:
                return f"{lead} {holder} {tail}{rest}"
            if not found and words < HOLDER_WORDS + len(tail.split()):
                return f"{lead} {holder}"
    return said


def _pieces(text: str) -> list[tuple[str, int, int, bool, bool]]:
    """(normal form, start, end, begins, runs on) of the non-empty pieces of lines.

    A piece begins a sentence behind a blank line and at a list item; it runs on where its line ends without a mark.
    """
    out, at, begins, bullet = [], 0, True, None
    for line in text.split("\n"):
        item = _ITEM.match(line)
        # Where the line before starts with the same mark, it is a comment's, or an item's beside others.
        begins |= item is not None and item[1] != bullet
        bullet = item and item[1]
        word, blank = _COMMENT_WORD.match(line), True
        for m in _SENTENCE.finditer(line, word.end() if word else 0):
            said = normal(m[0])
            if said:
                lead = len(m[0]) - len(m[0].lstrip())
                out.append((said, at + m.start() + lead, at + m.end(), begins, m.end() == len(line) and m[0].rstrip()[-1] not in ".;:!?"))
                begins = blank = False
        begins |= blank
        at += len(line) + 1
    return out


def _length_of(text: str, start: int, said: str) -> int:
    """How many characters from ``start`` on ``said``, the normal form of what stands there, takes with what separates it from the next word."""
    letters, at = len(said.replace(" ", "")), start
    while letters:
        letters -= text[at].lower() in _KEPT
        at += 1
    while text[at].lower() not in _KEPT:
        at += 1
    return at - start


def known_sentences(text: str | None) -> list[tuple[int, str, int, int]]:
    """(number among the non-empty sentences, identifier, start, end) of the text's known sentences.

    At each piece the longest span of successive pieces that is a known sentence counts; other lines that run on
    are one sentence with the next.
    """
    out, k, i, joins = [], 0, 0, False
    pieces = _pieces(text) if text else []
    while i < len(pieces):
        said, start, _, begins, runs_on = pieces[i]
        whole, name, j = said, _BY_TEXT.get(unnamed(said)), i
        last = i if name else None
        if last is None and unnamed(whole) not in _BEGINNINGS:
            title = next((t for t in TITLES if whole.startswith(t + " ")), None)
            if title:
                # The licence's sentence starts behind its title.
                whole = whole[len(title) + 1 :]
                start += _length_of(text, start, title)
                name = _BY_TEXT.get(unnamed(whole))
                last = i if name else None
        while unnamed(whole) in _BEGINNINGS and j + 1 < len(pieces) and not pieces[j + 1][3]:
            j += 1
            whole = f"{whole} {pieces[j][0]}"
            if unnamed(whole) in _BY_TEXT:
                last, name = j, _BY_TEXT[unnamed(whole)]
        k += last is not None or begins or not joins
        joins = last is None and runs_on
        if last is not None:
            out.append((k - 1, name, start, pieces[last][2]))
            i = last
        i += 1
    return out


def match_rules(found: list[tuple[int, str, int, int]], gap: int = 2) -> list[tuple[str, int, int]]:
    """(licence, start, end) of the rules that the known sentences fulfil, in order of place."""
    hits = []

    def after(i: int) -> Iterator[int]:
        # Numbers rise, so these are at most gap + 1.
        j = i + 1
        while j < len(found) and found[j][0] - found[i][0] - 1 <= gap:
            yield j
            j += 1

    for i, (_, ident, start, _) in enumerate(found):
        for name, rule in _BY_FIRST.get(ident, []):
            last = [i]
            for want in rule[1:]:
                last = sorted({j for p in last for j in after(p) if found[j][1] == want})
            if last:
                hits.append((start, -len(rule), name, found[last[0]][3]))
    out: list[tuple[str, int, int]] = []
    for start, _, name, stop in sorted(hits):
        if not out or start >= out[-1][2]:
            out.append((name, start, stop))
    return out


_BY_TEXT = {v: k for k, v in SENTENCES.items()}
#: Identifier -> the (licence, rule) that start with it.
_BY_FIRST: dict[str, list[tuple[str, list[str]]]] = {}
for _name, _rules in RULES.items():
    for _rule in _rules:
        _BY_FIRST.setdefault(_rule[0], []).append((_name, _rule))
#: Known sentences as far as each of their words but the last.
_BEGINNINGS = {v[:i] for v in SENTENCES.values() for i, c in enumerate(v) if c == " "}


def scan_licenses(docs: DataFrame, text: str = "text", gap: int = 2, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) with ``matches``: array of (license, start, end), in code points."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "matches"]
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    kind = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([source.schema[c] for c in keep]).add("matches", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"license": n, "start": s, "end": e} for n, s, e in match_rules(known_sentences(t), gap)] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(found, want)], names=schema.names)

    return source.mapInArrow(run, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.get("matches", F.lit(0))["start"].alias("first_start"), F.get("matches", F.lit(0))["end"].alias("first_end"))


QUERIES = {"op9_licenses": op9_licenses}
ORACLES: dict[str, str] = {}
