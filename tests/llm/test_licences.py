import math
import re

from renewlens.llm import licences
from renewlens.llm.queries import queries
from tests.conftest import MEDIUM
from tests.llm.helpers import documents
from tests.llm.test_decontamination import normal

# How the test tables word their notices.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}


def test_every_notice_and_nothing_else(spark, medium_texts):
    expected = {
        (i, place, NOTICES[line])
        for i, text in medium_texts.items()
        for place, line in enumerate(text.split("\n"))
        if line in NOTICES
    }
    found = queries()["op10_licences"](spark, MEDIUM).collect()
    assert expected
    assert {(row.doc_id, row.paragraph, row.family) for row in found} == expected


def test_other_wordings(spark, medium_texts):
    prose = "\n".join(list(medium_texts.values())[:40])
    rows = [
        (1, "code: licensed under the mit license, see file"),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the Software)"),
        (3, "The driver showed his license to the police."),
        (4, "She studied the Apache tribes and the MIT campus"),
        (5, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        (6, prose),
        (7, None),
        (8, ""),
        (None, "Released under the MIT License."),
        (9, "Released under the MIT License."),
        (9, "Released under the MIT License."),
        (10, "x " * 8000 + "\nLicensed under CC BY 4.0."),
    ]
    found = licences.scan(documents(spark, rows)).collect()
    families = {row.doc_id: row.family for row in found if row.doc_id != 6}
    assert families == {
        1: "MIT", 2: "MIT", 5: "CC-BY-4.0", None: "MIT", 9: "MIT", 10: "CC-BY-4.0"
    }
    assert sum(row.doc_id == 9 for row in found) == 2
    assert all(row.probability <= 1 and row.similarity >= 0.6 for row in found)


def test_empty_table(spark):
    assert licences.scan(documents(spark, [])).count() == 0


WRAPPED = {
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\n"
    "modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\n"
    "purpose with or without fee is hereby granted, provided that the above\n"
    "copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\n"
    'of this software and associated documentation files (the "Software"), to deal\n'
    "in the Software without restriction, including without limitation the rights",
    "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n"
    "# it under the terms of the GNU General Public License as published by\n"
    "# the Free Software Foundation, either version 3 of the License, or\n"
    "# (at your option) any later version.",
    "GPL-2.0": "  This program is free software; you can redistribute it and/or\n"
    "  modify it under the terms of the GNU General Public License\n"
    "  as published by the Free Software Foundation; either version 2\n"
    "  of the License, or (at your option) any later version.",
    "MPL-2.0": " * This Source Code Form is subject to the terms of the Mozilla Public\n"
    " * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
    " * file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": '// Licensed under the Apache License, Version 2.0 (the "License");\n'
    "// you may not use this file except in compliance with the License.\n"
    "// You may obtain a copy of the License at",
    "CC0-1.0": "To the extent possible under law, the\nauthor has waived all copyright and related\n"
    "rights under CC0 1.0.",
}
# Not worded as any template.
FREE = {
    "MIT": "Everything in this folder may be used by you under the MIT licence, without more ado.",
    "Apache-2.0": "We share the tool with all under the terms of the Apache License 2.0, enjoy.",
    "GPL-3.0": "The sources are covered by the GNU General Public License, version 3, like those of the kernel.",
    "BSD-3-Clause": "Code here is available to anybody under a BSD 3-clause license.",
    "CC-BY-SA-4.0": "All pictures: Creative Commons Attribution-ShareAlike 4.0 International licence",
    "LGPL-3.0": "You can link with this library, as it has the GNU Lesser General Public License version 3",
    "MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
}


def test_wrapped_and_freely_worded_notices(spark, medium_texts):
    prose = [text for i, text in medium_texts.items() if i % 9 == 1 and 20 < len(text) < 2000]
    prose = [text for text in prose if not any(notice in text for notice in NOTICES)]
    rows, expected = [], {}
    for i, (family, text) in enumerate([*WRAPPED.items(), *FREE.items()]):
        before, after = prose[2 * i], prose[2 * i + 1]
        for number, whole in enumerate((
            text, f"{before}\n\n{text}\n\n{after}", f"{before}\n{text}\n{after}", f"{before} {text} {after}"
        )):
            rows.append((10 * i + number, whole))
            expected[10 * i + number] = {family}
    frame = documents(spark, [*rows, *[(1000 + i, text) for i, text in enumerate(prose[40:])]])
    found = {}
    for row in licences.scan(frame).collect():
        found.setdefault(row.doc_id, set()).add(row.family)
    assert found == expected


def test_layout_does_not_matter(spark, medium_texts):
    rows = [(i, text) for i, text in medium_texts.items() if i % 3 == 0]
    one, other = (
        sorted(tuple(row) for row in licences.scan(documents(spark, some, partitions)).collect())
        for some, partitions in ((rows, 1), (rows[::-1], 7))
    )
    assert one and one == other


def _plain_scan(text, classifier, weights):
    """Every run of up to six lines of a text of short lines, judged one by one."""
    lines, hits = text.split("\n"), []
    cue = re.compile(licences.CUES)
    for i in range(len(lines)):
        for n in range(1, licences.LINES + 1):
            run = lines[i : i + n]
            if len(run) < n or not all(re.search(r"[^\W_]", line) for line in run):
                break
            if not any(cue.search(line) for line in run[:]) or not any(
                cue.search(line) for line in lines[i : i + 3]
            ):
                continue
            words = normal("\n".join(run).lower().replace("licence", "license"))
            two = {" ".join(pair) for pair in zip(words, words[1:])}
            sums = list(classifier.intercepts)
            for gram in two | set(words):
                for k, weight in enumerate(weights.get(gram, ())):
                    sums[k] += weight
            top = max(range(len(sums)), key=lambda k: (sums[k], classifier.classes[k]))
            chance = 1 / sum(math.exp(z - sums[top]) for z in sums)
            family = classifier.classes[top]
            if len(words) < 2 or family == licences.UNKNOWN or chance < classifier.threshold:
                continue
            alike = 0
            for name, template in licences.TEMPLATES:
                if name == family:
                    wanted = normal(template.lower())
                    wanted = {" ".join(pair) for pair in zip(wanted, wanted[1:])}
                    alike = max(alike, len(wanted & two) / len(wanted))
            if alike >= 0.6:
                hits.append((alike, -n, -i, family))
    return {
        (-i, -n, family)
        for alike, n, i, family in hits
        if not any(o[:3] > (alike, n, i) and -o[2] < -i - n and -i < -o[2] - o[1] for o in hits)
    }


def test_against_a_plain_version(spark, medium_texts):
    notices = [*WRAPPED.values(), *FREE.values(), *licences.NOT_LICENCES, *NOTICES]
    texts = [text for i, text in medium_texts.items() if i % 7 == 0]
    texts = [text for text in texts if max(map(len, text.split("\n"))) <= licences.LINE_CHARS]
    texts += [f"{a}\n{b}\n\n{c}" for a, b, c in zip(notices, notices[1:], notices[2:])]
    frame = documents(spark, list(enumerate(texts)))
    classifier = licences.train_on(frame)
    weights = {row.gram: row.weights for row in classifier.weights.collect()}
    found = {
        (row.doc_id, row.paragraph, row.n_units, row.family)
        for row in licences.scan(frame, classifier=classifier).collect()
    }
    expected = {(i, *hit) for i, text in enumerate(texts) for hit in _plain_scan(text, classifier, weights)}
    assert len(expected) > 30
    assert found == expected


# A notice without any word of licences.
BEERWARE = (
    "As long as you retain this notice you can do whatever you want with this stuff. If we meet some "
    "day, and you think this stuff is worth it, you can buy me a beer in return."
)


def test_paragraphs_without_a_cue_are_judged(spark, medium_texts):
    """Without a word of licences, or with one after the third line only."""
    prose = list(medium_texts.values())[:30]
    rows = [
        (1, "is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
        (2, "Use in\nsource and binary forms,\nwith or without\nmodification, are permitted\nprovided that "
            "the following\nconditions are met"),
        (3, f"{prose[0]}\n\n{BEERWARE[:70]}\n{BEERWARE[70:]}\n\n{prose[1]}"),
        *[(100 + i, text) for i, text in enumerate(prose)],
    ]
    assert not re.search(licences.CUES, rows[0][1] + BEERWARE)
    templates = (*licences.TEMPLATES, ("Beerware", BEERWARE))
    found = licences.scan(documents(spark, rows), templates=templates).collect()
    assert {row.doc_id: row.family for row in found if row.doc_id < 100} == {
        1: "MIT", 2: "BSD-3-Clause", 3: "Beerware"
    }


def test_every_run_is_judged_as_by_a_plain_version(spark, medium_texts, monkeypatch):
    texts = [text for i, text in medium_texts.items() if i % 9 == 2]
    texts = [text for text in texts if max(map(len, text.split("\n"))) <= licences.LINE_CHARS]
    notices = [*WRAPPED.values(), *FREE.values(), *NOTICES, *licences.NOT_LICENCES]
    # Notices without their first words, the rest a few words a line, ordinary lines before and after.
    for before, notice in zip(medium_texts.values(), notices):
        said = notice.split()[1:]
        cut = "\n".join(" ".join(said[i : i + 4]) for i in range(0, len(said), 4))
        texts += [cut, f"{cut}\n\n \n{notice}", f"{before.split(chr(10))[0][:300]}\n{cut}"]
    frame = documents(spark, list(enumerate(texts)))
    classifier = licences.train_on(frame)
    weights = {row.gram: row.weights for row in classifier.weights.collect()}
    found = {
        (row.doc_id, row.paragraph, row.n_units, row.family)
        for row in licences.scan(frame, classifier=classifier).collect()
    }
    # Every line holds the empty cue.
    monkeypatch.setattr(licences, "CUES", "")
    expected = {(i, *hit) for i, text in enumerate(texts) for hit in _plain_scan(text, classifier, weights)}
    assert len(expected) > 30
    assert found == expected


def test_the_bound_holds_for_every_run(spark, medium_texts):
    """Each run that the full scores give a family is among those that the bound leaves."""
    notices = [*WRAPPED.values(), *FREE.values(), *NOTICES]
    texts = [*list(medium_texts.values())[:60], *notices, "", None, " \n\n ", "x", "licence\n" * 9]
    frame = documents(spark, list(enumerate(texts)))
    classifier = licences.train_on(frame)
    weights = {row.gram: row.weights for row in classifier.weights.collect()}
    runs = licences.paragraphs(frame, classifier, id_col="doc_id", text_col="text").collect()
    left = {(row.doc_id, row.paragraph, row.text) for row in runs}
    named = 0
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        if max(map(len, lines)) > licences.LINE_CHARS:
            continue
        for start in range(len(lines)):
            for n in range(1, licences.LINES + 1):
                run = lines[start : start + n]
                words = [normal(line.lower().replace("licence", "license")) for line in run]
                if len(run) < n or not all(words):
                    break
                words = [word for one in words for word in one]
                sums = list(classifier.intercepts)
                for gram in {*words, *(" ".join(pair) for pair in zip(words, words[1:]))}:
                    for k, weight in enumerate(weights.get(gram, ())):
                        sums[k] += weight
                if len(words) > 1 and max(sums) > sums[classifier.classes.index(licences.UNKNOWN)]:
                    named += 1
                    assert (i, start, "\n".join(run)) in left
    assert named > 30
