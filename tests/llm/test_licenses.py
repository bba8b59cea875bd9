import re
from math import ceil

from lexweave.llm import licenses

from .helpers import clashing, none, odd, words

TEXTS = [
    None, "", "MIT License", "the mit\tlicense, the MIT-License; gnu General public LICENSE", "cc by cc by", "ccby", "cc\n\nby", "Apache License apache license", "x" * 50_000, words(3000, 4) + " mit license",
    "Licensed under the Apache License, Version 2.0", "a line\nLicensed under the Apache License Version two\nCopyright (c) all rights", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files to deal in it without restriction",
    "COPYRIGHT 2020 rights reserved", "KIT mit İ license", "released under the mit license " * 500,
]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    token = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(token, low)
    places, labels = [], set()
    for p, label in licenses.PHRASES.items():
        parts = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    more, best = set(), 0.0
    for paragraph in re.split(licenses.BLANK, low):
        pw = re.findall(token, paragraph)
        run = licenses.RUN
        blocks = [pw] if len(pw) <= 2 * run else [pw[i : i + 2 * run] for i in range(0, len(pw) - run, run)]
        for held in map(set, blocks):
            for name, t in licenses.TEMPLATES.items():
                own = set(t.text.split())
                if len(held & own) >= ceil(0.8 * len(own) - 1e-9) and set(t.must.split()) <= held and not set(t.without.split()) & held:
                    more.add(name)
                    best = max(best, len(held & own) / len(own))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if labels else best


def test_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(clashing(docs, "found", "n_words", "word", "size")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


SIBLINGS = {
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "Released under the BSD license": "bsd-notice",
    "released under the Apache License": "apache,apache-notice",
    "Licensed under the GNU Lesser General Public License": "lgpl-notice",
    "Licensed under the GNU General Public License": "gpl,gpl-notice",
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 3 of the License, or (at your option) any later version.": "lgpl-notice,lgpl-or-later",
    """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice""": "mit-grant,mit-permission",
}


def test_siblings_are_told_apart(spark):
    docs = spark.createDataFrame(list(enumerate(SIBLINGS)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == list(SIBLINGS.values())


def test_main_path_is_native(spark):
    plan = licenses.tokenised(odd(spark))._jdf.queryExecution().toString() + licenses.scan(odd(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows_and_empty_table(spark):
    assert licenses.scan(odd(spark)).count() == odd(spark).count()
    assert licenses.scan(none(spark)).count() == 0


WRAPPED = {
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:""",
    "cc0": """ * To the extent possible under law, the author has waived all copyright
 * and related or neighboring rights
 * to this work.""",
    "mpl-2.0": """/* This Source Code Form is subject to the terms of the Mozilla
 * Public License, v. 2.0. If a copy of the MPL was not distributed */""",
    "all-rights-reserved": "Copyright (c) 2020 Foo\r\nAll rights reserved.",
}


def test_wrapped_notices_are_found(spark):
    far = ("\n" + words(60, 9) + "\n").join(WRAPPED["bsd"].split())
    docs = spark.createDataFrame([*((n, words(30, 1) + "\n\n" + t + "\n" + words(30, 2)) for n, t in WRAPPED.items()), ("far", far)], "doc_id string, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got == {n: (n, 1.0) for n in WRAPPED} | {"far": ("", 0.0)}
