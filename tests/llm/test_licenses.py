"""License scans against plain wording, and wording that only looks alike."""

import re

from wafermill.llm import queries
from wafermill.llm.licenses import TEMPLATES, Scanner, scan_licenses, words

SCHEMA = "doc_id bigint, text string, license string, block string"


def test_query_equals_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    lines = {name: words(text) for name, text in TEMPLATES if len(words(text)) <= 16}
    forms = [(name, words(text)) for name, text in TEMPLATES if len(words(text)) <= 16]
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for n, line in enumerate((r["text"] or "").split("\n")):
            own = " ".join(words(line))
            want |= {(r["doc_id"], n, name) for name, form in forms if re.search(rf"(?:^| ){re.escape(' '.join(form))}(?: |$)", own)}
    got = {(r["doc_id"], r["line"], r["license"]) for r in queries.QUERIES["op2_license_scan"](spark, sf).collect()}
    assert lines and len(want) > 30 and got == want


def test_every_template_finds_itself():
    scanner = Scanner(TEMPLATES)
    for name, text in TEMPLATES:
        got = scanner.scan(text)
        assert got is not None and got[0] == name and got[3:] == ([], []), (name, got)


def test_alike_is_not_enough(spark):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 200)
    rows = [
        (1, "It is Licensed under the Apache License, Version 1.1.", "x", "y"),
        (2, "some words\n" + mit.replace("free of charge", "for a fee") + "\nmore", "x", "y"),
        (3, mit[:120], "x", "y"),
        (4, "This work is licensed under the GNU Lesser General Public License, version 3.", "x", "y"),
        (5, "Licensed under CC BY-NC-SA 4.0", None, None),
        (6, None, "x", "y"), (7, "", "x", "y"), (8, "w " * 60_000 + "Released under the MIT License. " + "w " * 60_000, "x", "y"),
        (None, "released UNDER the mit license", "x", "y"), (9, "Released under the MIT License.", "x", "y"), (9, "Released under the MIT License.", "x", "y"),
        (10, "A license to copy was never given; permission denied.", "x", "y"),
    ]
    got = sorted(((r["doc_id"], r["license"], r["missing"], r["extra"]) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    found = [(i, n) for i, n, _, _ in got]
    assert sorted(found, key=str) == sorted([(2, "MIT"), (4, "LGPL-3.0"), (5, "CC-BY-NC-SA-4.0"), (8, "MIT"), (None, "MIT"), (9, "MIT"), (9, "MIT")], key=str)
    two = next(r for r in got if r[0] == 2)
    assert two[2] == ["free", "of", "charge"] and two[3] == ["for", "a", "fee"]
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wrapped_inline_and_several_notices(spark):
    import textwrap

    long = [(n, t) for n, t in TEMPLATES if len(words(t)) > 16]
    prose = "plain words of an ordinary sentence go on here for a good while " * 8
    texts, want = [], set()
    for i, (name, text) in enumerate(long):
        for j, width in enumerate((40, 72, 80)):
            texts.append((100 * i + j, "intro\n" + "\n".join(f" * {line}" for line in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)) + "\ncode", "x", "y"))
            want.add((100 * i + j, 1, name))
    texts.append((5000, prose + "Released under the MIT License. " + prose, "x", "y"))
    texts.append((5001, prose + "This work is licensed under a Creative\nCommons Attribution 4.0 International License. " + prose, "x", "y"))
    texts.append((5002, "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "x", "y"))
    texts.append((5003, "This is free and unencumbered software released into the public\ndomain.", "x", "y"))
    want |= {(5000, 0, "MIT"), (5001, 0, "CC-BY-4.0"), (5002, 0, "MIT"), (5002, 0, "Apache-2.0"), (5003, 0, "Unlicense")}
    got = scan_licenses(spark.createDataFrame(texts, SCHEMA)).collect()
    assert {(r["doc_id"], r["line"], r["license"]) for r in got} == want
    assert all(r["missing"] == r["extra"] == [] for r in got)


def test_compression_decides_and_loses_nothing():
    """Every notice that the wording alone confirms saves well over the bar; without savings there are none."""
    from random import Random

    scanner, rnd = Scanner(TEMPLATES), Random(7)
    prose = words("the house of a very old friend stood under tall trees and the water went along it as a public road with license plates of many a town " * 9)
    texts = []
    for k, (_, _, template) in enumerate(scanner.templates):
        for _ in range(12):
            at, own = rnd.randrange(len(prose)), list(template)
            if len(own) > 16:
                for _ in range(rnd.randrange(len(own) // 10 + 1)):
                    own[rnd.randrange(len(own))] = rnd.choice(prose)
            texts.append((k, prose[:at] + own[rnd.choice([0, scanner._cut(template)[0][0]]):] + prose[at:]))
    for k, own in texts:
        places = [i for i, w in enumerate(own) if any(p[0] == k for p in scanner.parts.get(w, ()))]
        plain = list(scanner.confirmed(own, k, places))
        found = {f[1:3] for t, at in scanner.candidates(own) if t == k for f in scanner.confirmed(own, k, at)}
        assert {f[1:3] for f in plain} <= found, (k, " ".join(own))
    assert all(scanner.notices(" ".join(own)) for k, own in texts if len(scanner.templates[k][2]) <= 16)
    # Without the dictionaries nothing is saved.
    blind = Scanner(TEMPLATES)
    blind.quick = blind.quick[0], [blind.quick[0]] * len(TEMPLATES)
    assert not any(blind.notices(t) for _, t in TEMPLATES)


def test_every_notice_is_a_row(spark):
    gap = " plain words" * 250
    text = "Released under the MIT License." + gap + " Released under the MIT License."
    got = scan_licenses(spark.createDataFrame([(1, text, "x", "y")], SCHEMA)).collect()
    assert [(r["line"], r["license"], r["block"]) for r in got] == [(0, "MIT", "Released under the MIT License")] * 2


def test_templates_are_ranked_by_what_they_save():
    scanner = Scanner(TEMPLATES)
    own = words("some text before it released under the mit license and some after")
    ranked = scanner.ranking(scanner.block(own[:16]), 8)
    assert ranked and scanner.templates[ranked[0]][0] == "MIT"
    assert scanner.ranking(scanner.block(words("nothing of that kind is told in this block of words")), 8) == []
