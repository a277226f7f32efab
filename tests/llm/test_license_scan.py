import random
import re

import pytest

from kinweave.llm import license_scan as L
from tests.llm.conftest import ODD, words


def _base(text):
    w = words(text)
    hits = [(i, t.label) for t in L.BASE for i in range(len(w)) if w[i : i + len(t.text.split())] == t.text.split()]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_places_of_whole_texts(spark, odd):
    more = spark.createDataFrame(
        [(20, "MIT-License, mit license; the Apache\nLicense. GNU General Public License"), (21, "x " * 50_000 + "mit license")],
        "doc_id bigint, text string",
    )
    docs = odd.select("doc_id", "text").unionByName(more)
    want = sorted((r.doc_id, *_base(r.text)) for r in docs.filter("doc_id IS NOT NULL").collect())
    got = sorted((r[0], *r[1:6]) for r in L.scan(docs).filter("doc_id IS NOT NULL").collect())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("Licensed under a CC BY-NC 4.0 License", "cc-by-nc-4.0"),
        ("This work is licensed under the GNU General Public License, version 3, or (at your option) any later version", "gpl,gpl-3.0"),
        ("Copyright (c) 2020 Some Person. All rights reserved.", "all-rights-reserved"),
        ("Copyright one two three four five six seven eight nine ten eleven. All rights reserved", ""),
        ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"),
        ("Licensed under the Apache License, Version 1.1", "apache"),
        ("licensed under", ""),
    ],
)
def test_optional_and_replaceable_regions(text, labels):
    found = L._Scanner(L.TEMPLATES).columns(L.texts_of(L.pa.array([text])))
    assert found[5] == [labels]
    assert (found[6][0] == 1.0) == bool(set(labels.split(",")) - {"", "all-rights-reserved"})


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.",
)
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def bsd(clauses, mark="{}. "):
    listed = "\n".join(mark.format(i + 1) + c for i, c in enumerate(clauses))
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    return f"Copyright (c) 2020, A Person. All rights reserved.\n{head}\n{listed}\n{DISCLAIMER}"


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
WHOLE = {
    "mit": MIT, "bsd-2-clause": bsd(CLAUSES[:2]), "bsd-3-clause": bsd(CLAUSES), "isc": ISC, "apache-2.0-notice": APACHE,
    "gpl-3.0-notice": GPL, "gpl-2.0-notice": GPL.replace("version 3", "version 2"),
}


def told(text):
    found = L._Scanner(L.TEMPLATES).columns(L.texts_of(L.pa.array([text])))
    return set(found[5][0].split(",")), found[6][0]


@pytest.mark.parametrize("label", sorted(WHOLE))
def test_whole_wordings_altered_shortened_and_extended(label):
    text = WHOLE[label]
    assert [t for t in WHOLE if t in told(text)[0]] == [label] and told(text)[1] == 1.0
    assert label in told(f"Some words before. {text}\nAnd others after.")[0]
    assert label in told(text.replace(" ", "\n * "))[0]
    words = text.split()
    begin = 8 if label.startswith("bsd") else 0  # the line with the holder's name is not part of it
    assert label not in told(" ".join(words[:-1]))[0]
    for at in range(begin + 1, len(words), 7):
        if "HOLDER" in " ".join(words[at - 6 : at + 6]).upper() or "THE AUTHOR" in " ".join(words[at - 4 : at + 4]).upper():
            continue  # replaceable
        altered = " ".join([*words[:at], "except that no commercial use is permitted and you pay us", *words[at:]])
        assert label not in told(altered)[0], words[at]


def test_altered_licences_keep_an_opening_only():
    labels, score = told(MIT.replace("including without limitation", "except that no commercial use is permitted, including without limitation"))
    assert labels == {"mit-opening"} and 0.1 < score < 0.5
    labels, score = told(bsd(CLAUSES[:2]).replace("retain", "not retain"))
    assert labels == {"all-rights-reserved", "bsd-opening"} and score < 0.5
    assert told(bsd(CLAUSES, "* "))[0] == {"all-rights-reserved", "bsd-opening", "bsd-3-clause"}


def pattern(template):
    """The template as a regular expression over words that each end in a blank."""
    out = []
    for mark in L._MARKUP.finditer(template.text):
        out.append("(?:" if mark[1] else ")?" if mark[2] else f"(?:[^ ]+ ){{0,{mark[3]}}}" if mark[3] else mark[4] + " ")
    return re.compile("(?:^|(?<= ))" + "".join(out))


def test_labels_by_regular_expressions(spark, data):
    """All labels of the whole table, and of mixed pieces of licences, against regular expressions of the templates."""
    rnd, pieces = random.Random(3), [p for t in WHOLE.values() for p in re.findall(r"(?:\S+\s+){1,40}", t)]
    mixed = ["".join(rnd.choices(pieces, k=rnd.randrange(1, 6))) for _ in range(150)] + list(WHOLE.values())
    rows = [(-1 - i, t) for i, t in enumerate(mixed)]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    every = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    patterns = [(t.label, pattern(t)) for t in L.TEMPLATES]
    want = {}
    for row in every.collect():
        low = (row.text or "").translate({c: c + 32 for c in range(65, 91)})
        words = "".join(w + " " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
        want[row.doc_id] = ",".join(sorted({label for label, p in patterns if p.search(words)}))
    got = {r.doc_id: r.labels for r in L.scan(every).collect()}
    assert got == want and len(set(got.values())) > 8


def test_nested_regions_and_bounds():
    a = L.Automaton([L.Template("t", "a [[b [[c]] d]] <<x:2>> e")])
    yes = ["a e", "a b d e", "a b c d e", "a x e", "a x y e", "a b d x y e"]
    no = ["a", "a x y z e", "b e", "a b c"]
    assert all(a.run(t.split(), 0)[0] for t in yes) and not any(a.run(t.split(), 0)[0] for t in no)
    for bad in ("[[only optional]]", "a [[b"):
        with pytest.raises(ValueError):
            L.Automaton([L.Template("t", bad)])


def test_nothing_and_every_row(nothing, odd):
    assert L.scan(nothing).count() == 0
    rows = L.scan(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
