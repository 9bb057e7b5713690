import itertools
import random
import re
import textwrap
import time

import pytest
from helpers import documents, nothing

from wanderlake.llm import licenses as lic


def text_of(*idents):
    return ". ".join(lic.SENTENCES[i].capitalize() for i in idents) + "."


def found(text, **how):
    return [m[0] for m in lic.match_rules(lic.known_sentences(text), **how)]


def brute_sentences(text):
    """Sentences by another way: cut behind each mark before white space, and at line ends."""
    parts = [p for line in text.split("\n") for p in re.split(r"(?<=[.;:!?])(?=\s)", line)]
    return [n for p in parts if (n := re.sub("[^a-z0-9]+", " ", p.lower()).strip())]


def test_single_sentences():
    assert found("Intro.\nLicensed under the Apache License, Version 2.0.\nMore. Released under the MIT License.") == ["Apache-2.0", "MIT"]
    assert found("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert found("This is not licensed under the Apache License, Version 2.0 at all.") == []
    assert found(None) == [] and found("") == [] and found("\n\n") == []


def test_every_rule_matches_its_own_text():
    for name, rules in lic.RULES.items():
        for rule in rules:
            assert name in found(text_of(*rule))


def test_order_and_gap():
    assert found(text_of("mit-condition", "mit-grant")) == []
    a, b = text_of("mit-grant"), text_of("mit-condition")
    assert found(f"{a} One. Two. {b}") == ["MIT"] and found(f"{a} One. Two. Three. {b}") == []
    assert found(f"{a} One. Two. Three. {b}", gap=3) == ["MIT"]


def test_longer_rule_stands():
    assert found(text_of("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")) == ["BSD-3-Clause"]
    assert found(text_of("bsd-grant", "bsd-source", "bsd-binary")) == ["BSD-2-Clause"]


def test_sentences_and_offsets_against_another_way():
    text = "A b. Released under the MIT License.\n x;y : Licensed under CC BY 4.0. v2.0 end\nReleased under the MIT License"
    got = lic.known_sentences(text)
    assert [n for n in brute_sentences(text) if n in lic._BY_TEXT] == [lic.SENTENCES[i] for _, i, _, _ in got]
    assert all(lic.normal(text[s:e]) == lic.SENTENCES[i] for _, i, s, e in got)
    assert [k for k, *_ in got] == [i for i, n in enumerate(brute_sentences(text)) if n in lic._BY_TEXT]


# Licence notices as they are published.
NOTICES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}


def wrapped(text, mark, width=72):
    return "\n".join(f"{mark}{line}" for part in text.split("\n") for line in textwrap.wrap(part, width, break_on_hyphens=False) or [""])


@pytest.mark.parametrize("mark", ["", " * ", "// ", "# ", "-- ", ";; ", "REM ", "dnl "])
def test_wrapped_notices(mark):
    notices = NOTICES | {n: ". ".join(lic.SENTENCES[i] for i in r[-1]) + "." for n, r in lic.RULES.items() if n not in NOTICES}
    # The full rule, from its second sentence on; the rule from the first ends at the address.
    full = NOTICES["Apache-2.0"].split("; ", 1)[1].capitalize()
    for name, notice in [*notices.items(), ("Apache-2.0", full)]:
        for width in (30, 72):
            text = f"{mark}Copyright 2020 A. Writer\n{mark}\n{wrapped(notice, mark, width)}\n{mark}\n{mark}import this"
            hits = lic.match_rules(lic.known_sentences(text))
            assert [h[0] for h in hits] == [name], (name, width)
            (_, start, end), first, final = hits[0], notice.split()[0], "at" if notice == NOTICES["Apache-2.0"] else notice.split()[-1]
            assert text[start:end].lstrip(" */#;-").startswith(first) and text[start:end].endswith(final)


def test_spans_stop_at_blank_lines_and_items():
    assert found("Released under\nthe MIT License.") == ["MIT"]
    assert found("Released under\n\nthe MIT License.") == [] and found("Released under\n- the MIT License.") == []
    a, b = text_of("mit-grant"), text_of("mit-condition")
    assert found(f"{a}\nOne line\nand more\nof it.\nTwo.\n{b}") == ["MIT"] and found(f"{a}\nOne.\nTwo.\nThree.\n{b}") == []


def brute_rules(found, gap):
    """All ways to place a rule's sentences, then the longest from each start on, without overlaps."""
    hits = []
    for name, rules in lic.RULES.items():
        for rule in rules:
            for places in itertools.combinations(range(len(found)), len(rule)):
                if [found[p][1] for p in places] == rule and all(found[q][0] - found[p][0] - 1 <= gap for p, q in zip(places, places[1:])):
                    hits.append((found[places[0]][2], -len(rule), name, found[places[-1]][3]))
    out = []
    for start, _, name, stop in sorted(hits):
        if not out or start >= out[-1][2]:
            out.append((name, start, stop))
    return out


def test_rules_against_all_placements(spark):
    rng = random.Random(4)
    some = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "gpl-free", "gpl-hope", "gpl-see", "mit-grant", "mit-condition", "cc-by"]
    texts = []
    for _ in range(150):
        pick = [rng.choice([*some, None, None]) for _ in range(rng.randrange(1, 9))]
        text = " ".join(f"{lic.SENTENCES[i].capitalize()}." if i else "Some other words." for i in pick)
        texts.append(wrapped(text, rng.choice(["", "# "])) if rng.random() < 0.5 else text)
    for text in texts:
        known = lic.known_sentences(text)
        for gap in (0, 2):
            assert lic.match_rules(known, gap) == brute_rules(known, gap)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in lic.scan_licenses(docs).collect():
        assert [tuple(m) for m in r.matches] == brute_rules(lic.known_sentences(r.text), 2)


def test_titles_and_spdx_lines():
    grant = NOTICES["MIT"].replace("\n\n", " ")
    for title in ("MIT License", "The MIT License (MIT)"):
        text = f"{title} {grant}"
        assert found(text) == ["MIT"]
        (_, start, _), *_ = lic.match_rules(lic.known_sentences(text))
        assert text[start:].startswith("Permission is hereby")
        assert found(f"{title}\n\nCopyright (c) 2020 A. Writer\n\n{wrapped(NOTICES['MIT'], '')}") == ["MIT"]
    for name in lic.RULES:
        assert found(f"// SPDX-License-Identifier: {name}\nint main() {{}}") == [name]
    assert found("SPDX-License-Identifier: Unknown-1.0") == []


def test_many_notices_take_linear_time():
    text = "Released under the MIT License.\n" * 40_000
    began = time.perf_counter()
    assert len(found(text)) == 40_000
    assert time.perf_counter() - began < 5


def test_frames(spark):
    docs = documents(spark)
    assert lic.scan_licenses(docs).count() == docs.count() and lic.scan_licenses(nothing(spark)).count() == 0
    notice = documents(spark, ["Released under the MIT License.\n" * 3000])
    assert len(lic.scan_licenses(notice, keep=["doc_id"]).filter("doc_id = 0").first().matches) == 3000


HOLDERS = ["Google Inc.", "the University of California, Berkeley", "the <organization>", "A. B. Writer, C. D. Other & Sons, Ltd.", "copyright.holder@example.org"]


@pytest.mark.parametrize("holder", HOLDERS)
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_a_named_holder_is_a_holder(holder, mark):
    """BSD-3 with any holder is BSD-3, however it is wrapped, and not BSD-2."""
    named = NOTICES["BSD-3-Clause"].replace("the copyright holder", holder)
    other = named[: named.index("3. ")] + f"3. The name of {holder} may not be used to endorse or promote products derived from this software without specific prior written permission."
    for notice in (named, other):
        for width in (24, 40, 72):
            text = f"{mark}Copyright 2020 X\n{mark}\n{wrapped(notice, mark, width)}\n{mark}\n{mark}import this"
            hits = lic.match_rules(lic.known_sentences(text))
            assert [h[0] for h in hits] == ["BSD-3-Clause"] and text[: hits[0][2]].endswith("permission.")


def test_holders_that_are_none():
    """Too long a name, or another sentence that begins like one, is no endorsement clause, and what follows is still seen."""
    two = NOTICES["BSD-3-Clause"][: NOTICES["BSD-3-Clause"].index("3. ")]
    for third in ("3. Neither the name of " + "very " * 13 + "long nor the names of its contributors may be used to endorse or promote products.", "3. The name of the game is chess.", "The name of the author is unknown."):
        assert found(two + third) == ["BSD-2-Clause"]
    assert found("The name of the game.\nReleased under the MIT License.") == ["MIT"]
    assert found("The name of\nReleased under the MIT License.") == ["MIT"] == found("Some words\nReleased under the MIT License.")


def test_one_line_forms_and_heads():
    for text, name in {
        "This project is licensed under the MIT License": "MIT",
        "Licensed under MIT.": "MIT",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "Apache-2.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "Licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    }.items():
        assert found(text) == [name] == found("Some words.\n\n" + text + "\n\nmore."), text
