import random

import pytest

from tidewell.llm import licenses as X

CASES = {
    "Released under the MIT License.": ["MIT"],
    "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0-only"],
    "This work is licensed under the GNU Lesser General Public Licence, version 2 or any later version.": ["LGPL-2.0-or-later"],
    "Copyright (c) 2020 A. Person.\nAll rights reserved.": ["Proprietary"],
    "All rights reserved to the winner, they said.": [],
    "We had a licence to fish and a public warrant.": [],
    "// SPDX-License-Identifier: Apache-2.0\nint x;": ["Apache-2.0"],
    "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"],
    "# SPDX-License-Identifier: MIT OR apache-2.0 // x": ["MIT", "Apache-2.0"],
    "/* SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) AND mit */": ["GPL-2.0-only WITH Linux-syscall-note", "MIT"],
    "<!-- SPDX-License-Identifier: LGPL-2.1+ -->": ["LGPL-2.1-or-later"],
    "This project uses the MIT license.": ["MIT"],
    "He uses mit for it.": [],
    "It is dual licensed under MIT or Apache 2.0 at your option.": ["MIT", "Apache-2.0"],
    "License: GPLv3+": ["GPL-3.0-or-later"],
    "License :: OSI Approved :: MIT License": ["MIT"],
    "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
    "This is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA-4.0"],
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files " + "and so on " * 1000: ["MIT"],
    """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO""": ["MIT"],
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without more.
You should have received a copy of the GNU General Public License along with this program.""": ["GPL-3.0-or-later"],
    "Some text. Released under the MIT License. Some more text here.\nAll rights reserved.": ["MIT", "Proprietary"],
    """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice, this list.
# 2. Redistributions in binary form must reproduce the above copyright notice, this list.
# 3. Neither the name of the X nor its people may be used to endorse or promote products derived.""": ["BSD-3-Clause"],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    found = X.find_licenses(text)
    assert [f[0] for f in found] == CASES[text]
    assert all(0 <= a < b <= len(text) for _, a, b in found)


def brute_force(text):
    """Every sentence against every pattern, every place against every rule, without filters or early exits."""
    ids, i = [], 0

    def known(a, b):
        line, norm = X._SPDX.search(text[a:b]), X.normalise(text[a:b])
        names = X.named(norm)
        hits = [n for n, p in X._MATCHERS if p.fullmatch(norm)]
        if line:
            return "spdx", X.spdx(line[1])
        if hits and not (hits[0].startswith("copyright") and names):
            return hits[0], []
        return ("name", names) if names else ("title", X.title(norm)) if X.title(norm) else None

    for options in X.sentences(text):
        found = [known(a, b) for a, b in options]
        if len(options) > 1 and any(found[:-1]):
            found.pop()
        ids += [(i + n, *f) for n, f in enumerate(found) if f]
        i += len(found)
    out, taken = [], -1
    for at in range(len(ids)):
        fits = []
        for k, (licence, sequence) in enumerate(X.RULES):
            part = ids[at : at + len(sequence)]
            if [x[1] for x in part] == list(sequence):
                fits.append((k, licence, len(sequence)))
        if at > taken and fits:
            _, licence, n = min(fits)
            out += [(x, 0, 0, licence == "{title}") for x in (ids[at][2] if licence.startswith("{") else [licence])]
            taken = at + n - 1
    return [x[0] for x in X.untitled(out)]


def test_against_brute_force():
    r = random.Random(4)
    pieces = [*CASES, *[s.replace("…", " one two ").strip().capitalize() + "." for _, s in X.SENTENCES], "Nothing to see here.", "Other words:"]
    for _ in range(300):
        text = "\n\n".join(r.choice(pieces) for _ in range(r.randrange(1, 9)))
        assert [x[0] for x in X.find_licenses(text)] == brute_force(text), text


def test_every_rule_names_known_sentences():
    names = {n for n, _ in X.SENTENCES} | {"name", "spdx", "title"}
    assert all(s in names for _, sequence in X.RULES for s in sequence)
    assert names - {"copyright"} == {s for _, sequence in X.RULES for s in sequence} - {"copyright"}
    first = {}
    for i, (_, sequence) in enumerate(X.RULES):
        assert not any(sequence[: len(earlier)] == earlier for earlier in first), sequence  # a part never hides the whole
        first[sequence] = i


def test_frame_and_whole_corpus(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x " * 100_000 + "\nReleased under the MIT License.", 1), (3, "Released under the MIT License.", 1)], "doc_id long, text string, licenses int")
    got = sorted((r.doc_id, r.licenses, r.n_licenses) for r in X.scan_licenses(df).collect())
    assert got == [(1, [], 0), (2, [], 0), (3, ["MIT"], 1), (3, ["MIT"], 1)]
    assert X.scan_licenses(df.limit(0)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    lines["This work is licensed under the GNU General Public License, version 3."] = "GPL-3.0-only"
    want = {r.doc_id: ",".join(sorted({n for line, n in lines.items() if line in r.text})) for r in docs.collect()}
    assert {r.doc_id: r.licenses for r in X.op6_license_scan(spark, "/root/testdata/sf0.01").collect()} == want


def test_names_alone_denials_and_wide_gaps():
    for text, want in (
        ("Released under the terms of the GNU GPL v3 or later.", ["GPL-3.0-or-later"]),
        ("Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
        ("The MIT License", ["MIT"]),
        ("Apache License, Version 2.0", ["Apache-2.0"]),
        ("We never licensed under the MIT license anything.", []),
        ("This is not released under the GNU GPL v2.", []),
        ("A license was mentioned.", []),
    ):
        assert [x[0] for x in X.find_licenses(text)] == want, text
    mit = [s.replace("…", " ").strip() for n, s in X.SENTENCES if n in next(seq for lic, seq in X.RULES if lic == "MIT" and len(seq) > 1)]
    far = ". ".join(x.capitalize() + ". " + "An unknown sentence stands here. " * 30 for x in mit)
    assert "MIT" in [x[0] for x in X.find_licenses(far)]
