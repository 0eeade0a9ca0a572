import re

import pytest

from quarrylane.llm import licenses
from tests.llm.fixtures import DOC_SCHEMA, awkward, docs

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    words = WORD.findall((text or "").encode().lower())
    out = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = [w.encode() for w in phrase.split()]
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_base_places_match_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: plain_base(r.text) for r in table.collect()}
    for r in licenses.summary(licenses.scan(table)).collect():
        n, places = want[r.doc_id]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        labels = {x for _, x in places}
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("licensed under CC BY-NC 4.0", {"cc-by-nc-4.0"}),
        ("Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-4.0"}),
        ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3.0"}),
        ("see https://opensource.org/licenses/MIT", {"mit"}),
        ("BSD 3-Clause License", {"bsd-3-clause"}),
        ("MIT License\nApache Software License 1.1", {"mit", "apache-1.1"}),
        ("a permit licensee of the mitigation", set()),
        ("All rights reserved", {"proprietary"}),
        ("Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated documentation files (the \"Software\")", {"mit"}),
        ("# Redistribution and use in source and binary\n# forms, with or without modification, are permitted", {"bsd"}),
        ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License", {"gpl", "gpl-3.0"}),
        ("GNU GPL v3", {"gpl-3.0"}),
        ("licensed GPLv3", {"gpl-3.0"}),
        ("SPDX-License-Identifier: GPL-2.0 OR MIT", {"gpl-2.0", "mit"}),
        ("SPDX-License-Identifier: (Apache-2.0 AND BSD-3-Clause)", {"apache-2.0", "bsd-3-clause"}),
        ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", {"mit"}),
        ("you may not use this file except in compliance with the License.", {"apache-2.0"}),
        ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ],
)
def test_signatures(text, labels):
    assert {d.label for d in licenses.Scanner().scan(text.lower())} == labels


def ungated(scanner, text):
    return [d for i in range(len(scanner.rules)) for d in scanner.detections(text, i)]


def examples(pattern):
    """Some texts that an expression matches, with the white space between words varied."""
    tree = re._parser.parse(pattern)

    def spell(node, pick, space):
        kind, arg = str(node[0]).lower(), node[1]
        if kind == "literal":
            return chr(arg)
        if kind == "in":
            if any(str(a).lower() == "category" and "space" in str(b).lower() for a, b in arg):
                return space
            options = [chr(b) if str(a).lower() == "literal" else chr(b[0]) if str(a).lower() == "range" else "2" for a, b in arg if str(a).lower() != "negate"]
            return options[pick % len(options)]
        if kind == "category":
            return space if "space" in str(arg).lower() else "2"
        if kind == "any":
            return "y"
        if kind == "branch":
            return "".join(spell(n, pick // 7, space) for n in arg[1][pick % len(arg[1])])
        if kind == "subpattern":
            return "".join(spell(n, pick, space) for n in arg[3])
        if kind in ("max_repeat", "min_repeat"):
            least = arg[0] if pick % 2 or arg[0] else min(1, int(arg[1]))
            return "".join(spell(n, pick // 2, space) for n in arg[2]) * max(least, arg[0])
        return ""  # assertions and anchors

    for pick in range(8):
        for space in (" ", "\n", "\t\n  "):
            yield "".join(spell(n, pick, space) for n in tree)


def test_every_rule_passes_the_gate():
    """Texts spelt from the rules themselves, with spaces, tabs and line breaks between words: the gate opens for each that its rule matches."""
    scanner = licenses.Scanner()
    for i, (rule, pattern) in enumerate(scanner.rules):
        hits = [t for t in examples(rule.pattern) for t in (t, f"xx {t} yy", f"{t}\n") if scanner.detections(t, i)]
        assert hits or rule.form in ("tag", "address"), rule
        assert all(i in scanner.open_rules(t) for t in hits), rule
        assert all(scanner.scan(t) == licenses.suppressed(ungated(scanner, t)) for t in hits[:1]), rule


def plain_suppressed(found):
    """The rule as stated, pair by pair."""
    inside = lambda d, k: k.start <= d.start and d.end <= k.end
    first = lambda d: (-d.priority, d.start - d.end, d.rule, d.start)
    kept = []
    for d in sorted(found, key=first):
        if not any(inside(d, k) for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d.start, d.end))


def test_suppression_matches_its_statement():
    import random

    rng = random.Random(3)
    for _ in range(300):
        found = []
        for rule in range(rng.randint(1, 25)):
            start = rng.randint(0, 12)
            found.append(licenses.Detection(start, start + rng.randint(1, 6), "x", rng.choice((40, 60, 80)), rule))
        assert licenses.suppressed(found) == plain_suppressed(found)


def test_very_long_texts_take_linear_time():
    import time

    scanner = licenses.Scanner()
    took = []
    for n in (50_000, 200_000):
        begin = time.process_time()
        found = scanner.scan("mit license. gpl and more of it\n" * n)
        took.append(time.process_time() - begin)
        assert len(found) == n
    assert took[1] < 8 * took[0] and took[1] < 60


def test_gates_lose_nothing():
    scanner = licenses.Scanner()
    texts = [f"xx {f} {v} yy" for f in ("mit license", "gnu affero general public license version", "mozilla public license", "zlib license", "the unlicense", "cc0 1.0", "boost software license") for v in ("1.0", "2.0", "3")]
    for t in texts:
        full = ungated(scanner, t)
        assert scanner.scan(t) == licenses.suppressed(full)


def test_containment():
    d = lambda s, e, p, r: licenses.Detection(s, e, str(r), p, r)
    assert licenses.suppressed([d(0, 5, 40, 9), d(0, 9, 40, 3), d(4, 12, 40, 1), d(0, 9, 80, 4)]) == [d(0, 9, 80, 4), d(4, 12, 40, 1)]


def test_hundreds_of_rules():
    assert len(licenses.rules()) > 300


def test_awkward_rows(spark):
    table = awkward(spark)
    got = licenses.summary(licenses.scan(table)).collect()
    assert len(got) == table.count() and all(r.labels == "" and r.score == 0 for r in got)
    assert licenses.scan(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
    repeated = licenses.summary(licenses.scan(docs(spark, ["MIT, license MIT license license"]))).first()
    assert (repeated.n_words, repeated.n_base, repeated.first_word, repeated.last_word) == (5, 2, 0, 2)


def test_every_address_and_line_break_passes_the_gates():
    """No gate closes before a text that a rule matches."""
    scanner = licenses.Scanner()
    texts = [f"see https://{re.sub(r'\\(.)', r'\1', f.address.replace('[-/]?', '/').replace('(?:\\.0)?', '.0'))}" for f in licenses.families() if f.address]
    texts += ["distributed\nby the mit license", "licensed by\tthe apache license"]
    for t in texts:
        full = ungated(scanner, t)
        assert full and scanner.scan(t) == licenses.suppressed(full), t
    epl = scanner.scan("see https://www.eclipse.org/legal/epl-2.0/")
    assert {d.label for d in epl} <= {"epl", "epl-2.0"} and max(d.priority for d in epl) == 90
