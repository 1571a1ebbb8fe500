import re
import textwrap

import pytest
from pyspark.sql import functions as F

from plumbline.llm import op4_license_scans as op

PROSE = [f"The river number {i} runs past the old mill and the people of the village walk there on warm evenings with dogs {i * 7}" for i in range(300)]


@pytest.fixture(scope="module")
def scanned(spark):
    texts = {
        1: PROSE[0] + "\nReleased under the MIT License.",
        2: "Licensed under the Apache License, Version 2.0.\n" + PROSE[1],
        3: PROSE[2] + " This work is licensed under the GNU General Public License, version 3. " + " ".join(PROSE[3:20]),
        4: "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.",
        5: "She asked for permission to use the licence of the driver and was given a warranty by the king's gnu.",
        6: None,
        7: "",
        8: " ".join(PROSE) + " Licensed under CC BY-NC 4.0.",
        9: "Released under the MIT License.",
    }
    rows = [(k, t, "x") for k, t in texts.items()] + [(9, "Released under the MIT License.", "x")] + [(100 + i, p, "x") for i, p in enumerate(PROSE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licence string")
    got = op.scan(docs).collect()
    assert len(got) == len(rows)
    return {r["doc_id"]: r for r in got}


def test_notices_are_found(scanned):
    assert {k: scanned[k]["licences"] for k in (1, 2, 3, 4, 8, 9)} == {1: "mit", 2: "apache-2.0", 3: "gpl", 4: "cc-by-nc,mit", 8: "cc-by-nc", 9: "mit"}


def test_others_are_left_alone(scanned):
    assert all(scanned[k]["licence"] == "none" for k in (5, 6, 7)) and all(scanned[100 + i]["n_notices"] == 0 for i in range(len(PROSE)))


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(list(enumerate(PROSE)), "doc_id long, text string")
    rows = op.training_rows(docs).cache()
    told = op.Classifier(rows).predicted(rows.filter("fold = 0").withColumnRenamed("family", "truth"))
    assert told.agg(F.avg((F.col("family") == F.col("truth")).cast("double"))).first()[0] > 0.85


def test_empty_table(spark):
    assert op.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

You should have received a copy of the GNU General Public License along with this program."""


def test_wrapped_notices_are_found(spark):
    wrapped = lambda text, n, mark="": "\n".join((mark + line).rstrip() for part in text.split("\n\n") for line in [*textwrap.wrap(part, n), ""])
    texts, want = {}, {}
    for i, (family, text) in enumerate([("bsd", BSD), ("isc", ISC), ("mit", MIT), ("gpl", GPL)]):
        for j, form in enumerate([wrapped(text, 76), wrapped(text, 40), wrapped(text, 70, " * "), wrapped(text, 72, "# ").replace("\n", "\r\n"), PROSE[i] + "\n\n" + wrapped(text, 72)]):
            texts[10 * i + j], want[10 * i + j] = form, family
    texts[90], want[90] = "modification, are\npermitted provided that the following conditions are met", "none"  # a piece of too few bigrams
    texts[91], want[91] = "use in source and binary forms, with or without modification, are\npermitted provided that the following conditions are met", "bsd"
    rows = [*texts.items(), *[(100 + i, p) for i, p in enumerate(PROSE)]]
    got = {r["doc_id"]: r for r in op.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k]["licences"] or "none" for k in texts} == want
    assert got[10]["n_notices"] == 1 and got[10]["n_unknown"] == 0 and all(got[100 + i]["n_unknown"] == 0 for i in range(len(PROSE)))


def test_cues_leave_no_notice_out():
    for _, notice in op.NOTICES:
        words = re.findall(r"[^\W_]+", notice.lower())
        pairs = set(zip(words, words[1:], strict=False))
        assert sum(not re.search(op.CUES, f"{a} {b}") for a, b in pairs) < op.CONFIRM * len(pairs), notice


NAMED = {
    "mit": ["This project is released under the MIT License.", "Code: licensed under the MIT licence."],
    "apache-2.0": ["Licensed under the Apache 2 licence.", "All files are licensed under the Apache License, Version 2.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 2."],
    "lgpl": ["The library is licensed under the GNU Lesser General Public License, version 3."],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3."],
    "bsd": ["Released under the BSD 3-Clause License."],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0."],
    "epl": ["Licensed under the Eclipse Public License, version 2.0.", "Available under the terms of the Eclipse Public License 2.0. SPDX-License-Identifier: EPL-2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0."],
    "zlib": ["Released under the zlib license."],
    "wtfpl": ["Released under the WTFPL, version 2."],
    "unlicense": ["Released under the Unlicense."],
    "artistic": ["Licensed under the Artistic License 2.0."],
    "cddl": ["Licensed under the Common Development and Distribution License, version 1.0."],
    "eupl": ["Licensed under the EUPL, version 1.2."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
}
#: Families that the notices do not have.
FOREIGN = ["Licensed under the Open Software License, version 3.0.", "Licensed under the Sleepycat Public License, version 2.0.", "Released under the PostgreSQL License.", "Licensed under the Vovida Software License, Version 1.0.", "This work is licensed under the Free Art License, version 1.3.", "SPDX-License-Identifier: NCSA"]


def test_families_are_told_apart(spark):
    """Recall and precision of named families, and none of them for others."""
    named = [(f, PROSE[k % 50] + "\n" + t) for k, (f, t) in enumerate((f, t) for f, own in NAMED.items() for t in own)]
    rows = [(k, t) for k, (_, t) in enumerate(named)] + [(500 + k, PROSE[k] + "\n" + t) for k, t in enumerate(FOREIGN)] + [(1000 + k, p) for k, p in enumerate(PROSE)]
    got = {r["doc_id"]: r for r in op.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(got[k]["licences"] == f for k, (f, _) in enumerate(named))
    told = sum(got[k]["licence"] != "none" for k in range(len(named)))
    wrong = {t: got[500 + k]["licences"] for k, t in enumerate(FOREIGN) if got[500 + k]["licence"] != "none"}
    assert right >= 0.9 * len(named), {t: got[k]["licences"] for k, (f, t) in enumerate(named) if got[k]["licences"] != f}
    assert right >= 0.9 * told and not wrong
    assert all(got[500 + k]["n_unknown"] > 0 for k in range(len(FOREIGN)))
