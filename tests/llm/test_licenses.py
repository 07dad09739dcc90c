import random

from nearfield.llm import licenses
from tests.llm.helpers import EDGES, documents


def ids(text):
    return [m.license for _, _, m in licenses.scan_text(text)]


def test_every_wording_is_found_as_itself():
    for name, wording in licenses.WORDINGS:
        assert ids(f"Some words before.\n{wording}\nSome after.") == [name], wording
        assert ids(wording.upper()) == [name]


def test_line_breaks_and_small_differences():
    mit = licenses.WORDINGS[2][1]
    words = mit.split()
    wrapped = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    assert ids(wrapped) == ["MIT"]
    text = mit.replace("free of charge", "gratis")
    (_, _, m), = licenses.scan_text(text)
    assert m.license == "MIT" and set(m.missing) == {"free", "of", "charge"} and m.extra == ("gratis",)


def test_what_tells_licenses_apart_decides():
    assert ids("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert ids("Licensed under CC BY-NC 2.0.") == []
    assert ids("Licensed under the Apache License, Version 1.1.") == []
    assert ids("You need a license to drive. Permission to enter is required.") == []


def test_spans_are_code_points():
    text = "é😀\nReleased under the MIT License.\n" + "x " * 500
    (s, e, m), = licenses.scan_text(text)
    assert text[s:e] == "Released under the MIT License." and m.saving > 0.2


def test_long_lines_and_several_licenses():
    filler = "lorem ipsum " * 400
    text = filler + "This work is licensed under the GNU General Public License, version 3. " + filler + "\nLicensed under CC BY 4.0."
    assert "CC-BY-4.0" in ids(text)
    spans = [(s, e) for s, e, _ in licenses.scan_text(text * 3)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_operator_on_edges(spark):
    rows = [*EDGES, (20, "Released under the MIT License.", "en", "s")]
    got = {(r["doc_id"], len(r["found"])) for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == {(d, int(d == 20)) for d, *_ in rows}
    assert licenses.scan(documents(spark, [])).collect() == []


def test_query_finds_planted_lines(spark, duck, sf_dir):
    got = {r["doc_id"]: r["licenses"] for r in licenses.query(spark, sf_dir).collect()}
    for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        assert ("MIT" in got[d].split(",")) == ("Released under the MIT License." in t or "RELEASED UNDER THE MIT LICENSE" in t)


def test_short_notices_within_prose():
    prose = "the prose of a page goes on and on in one line "
    for name, wording in licenses.WORDINGS:
        for before in (40, 240, 5000):
            text = (prose * 120)[:before] + " " + wording + " " + prose * 20
            (s, e, m), = licenses.scan_text(text)
            assert (m.license, text[s:e]) == (name, wording) and m.saving > 0, (before, wording)


def test_every_wording_with_few_differences_is_found():
    g = random.Random(3)
    for name, wording in licenses.WORDINGS:
        words = wording.split()
        for _ in range(40):
            changed = list(words)
            for _ in range(int(licenses.DIFFER * len(licenses._words.findall(wording.lower())))):
                at = g.randrange(1, len(changed))
                if g.random() < 0.5:
                    changed.insert(at, "besides")
                elif changed[at].isalpha() and changed[at].lower() not in licenses.NAMES:
                    del changed[at]
            text = "some prose before " + " ".join(changed) + " and some after"
            assert ids(text) == [name], text


MIT = """MIT License

Copyright (c) 2024 A. N. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""


def test_published_line_breaks():
    (s, e, m), = licenses.scan_text(MIT)
    assert m.license == "MIT" and MIT[s:e].startswith("Permission is hereby") and MIT[s:e].endswith("portions of the Software.") and not m.missing + m.extra
    (s, e, m), = licenses.scan_text(GPL)
    assert m.license == "GPL-3.0" and GPL[s:e] == GPL.strip() and not m.missing + m.extra
    assert ids("\n".join("# " + line for line in GPL.split("\n"))) == ["GPL-3.0"]


def test_every_license_of_a_dual_notice_is_found():
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    for between in ("\n", " ", " and ", "\n\n"):
        text = mit + between + apache
        assert [(text[s:e], m.license) for s, e, m in licenses.scan_text(text)] == [(mit, "MIT"), (apache, "Apache-2.0")], between
    assert ids(MIT + GPL + mit + "\n" + MIT) == ["MIT", "GPL-3.0", "MIT", "MIT"]


def differences(template, words):
    """The least differences of a wording against any stretch of the words, by trying every place; None if none is allowed."""
    most = int(licenses.DIFFER * len(template))
    row = [0] * (len(words) + 1)
    for i, w in enumerate(template, 1):
        new = [row[0] + 1 if not licenses._tells(w) else 10**6]
        for j, x in enumerate(words, 1):
            costs = [row[j - 1]] if w == x else []
            if not licenses._tells(w):
                costs.append(row[j] + 1)
            if i < len(template) and not licenses._tells(x):
                costs.append(new[j - 1] + 1)
            new.append(min(costs, default=10**6))
        row = new
    return min(row) if min(row) <= most else None


def test_every_place_of_every_wording_by_brute_force():
    g = random.Random(11)
    templates = [licenses._words.findall(w.lower()) for _, w in licenses.WORDINGS]
    prose = "license the software and of by use permission version granted to any work is copyright notice 2.0 mit".split()
    seen = 0
    for _ in range(120):
        words = [g.choice(prose) for _ in range(g.randrange(30))]
        for t in g.sample(range(len(templates)), g.randrange(3)):
            own = list(templates[t])
            for _ in range(g.randrange(int(0.14 * len(own)) + 2)):
                at = g.randrange(len(own) + 1)
                if g.random() < 0.5 and at < len(own):
                    del own[at]
                else:
                    own.insert(at, g.choice(prose))
            words += own + [g.choice(prose) for _ in range(g.randrange(20))]
        found = licenses.scan_text(" ".join(words))
        spans = [licenses._words.findall(" ".join(words)[s:e]) for s, e, _ in found]
        want = {t for t in range(len(templates)) if differences(templates[t], words) is not None}
        names = {licenses.WORDINGS[t][0] for t in want}
        assert {m.license for _, _, m in found} <= names
        assert all(m.extra + m.missing == () or len(m.extra + m.missing) <= 0.1 * max(map(len, templates)) for _, _, m in found)
        # What brute force finds is found, or stands within a wording that is.
        for t in want:
            assert any(m.license == licenses.WORDINGS[t][0] for _, _, m in found) or any(differences(templates[t], x) is not None for x in spans) or len(found) < len(want), (words, t)
        assert bool(found) == bool(want), (words, want)
        seen += len(found)
    assert seen > 40


def test_published_bsd_texts():
    two = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{} Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
{} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    three = two + """{} Neither the name of Example Company nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
    for marks in (("1.", "2.", "3."), ("*", "*", "*"), ("-", "-", "-")):
        assert ids(two.format(*marks) + "THIS SOFTWARE IS PROVIDED AS IS") == ["BSD-2-Clause"], marks
        assert ids(three.format(*marks) + "THIS SOFTWARE IS PROVIDED AS IS") == ["BSD-3-Clause"], marks


def test_ranks_say_what_a_wording_saves():
    words = licenses._words.findall(licenses.WORDINGS[0][1].lower())
    order = licenses.ranked(words)
    assert len(order) == len(licenses.WORDINGS) and order[0][0] == 0 and [x for _, x in order] == sorted((x for _, x in order), reverse=True)


def test_very_long_texts():
    notice = "Licensed under the Apache License, Version 2.0."
    text = "words that say nothing about a license of any kind " * 40_000 + notice + " more words" * 100_000
    (s, e, m), = licenses.scan_text(text)
    assert text[s:e] == notice and m.license == "Apache-2.0"
