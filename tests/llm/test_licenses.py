"""The license scan against brute force: no gate, every rule on every text, Python's regexes."""

from __future__ import annotations

import random
import re
import time
from re import _parser as parser

import pytest

from stridelog.llm import license_rules, licenses

OWN = license_rules.rules()
NOTICES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "Redistribution and use in source and binary forms, with or without modification",
    "Licensed under the Apache License, Version 2.0",
    "GNU General Public License, either version 2 of the License, or (at your option) any later version",
    "Mozilla Public License 2.0", "MIT License", "apache license", "CC BY-NC 4.0", "creativecommons.org/licenses/by-sa/3.0", "SPDX-License-Identifier: GPL-2.0-or-later",
    "Neither the name of the copyright holder nor the names may be used to endorse or promote products", "version 3 of the GNU General Public License", "GPLv3", "all rights reserved",
    "bsd 3-clause", "the unlicense", "open rail", "end-user license agreement", "under the same terms as perl itself",
]


def needed(tree) -> list[str]:
    """Literal stretches that every match holds."""
    runs = [""]
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                runs[-1] += chr(arg)
            case "SUBPATTERN":
                first, *more = needed(arg[3])
                runs[-1] += first
                runs += more
            case "MAX_REPEAT" if arg[0] >= 1:
                runs += [*needed(arg[2]), ""]
            case "BRANCH":
                each = [needed(x) for x in arg[1]]
                runs += [*[a for x in each for a in x if all(any(a in b for b in y) for y in each)], ""]
            case "AT":
                pass
            case _:
                runs.append("")
    return runs


def test_every_match_holds_its_keywords():
    for r in OWN:
        held = needed(parser.parse(r.regex))
        assert r.keywords and all(any(k in h for h in held) for k in r.keywords.split()), r
    assert len(OWN) >= 400


def brute(text: str) -> list[tuple]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    hits = [(m.start(), m.end(), r.label, r.priority, n) for n, r in enumerate(OWN) for m in re.finditer(r.regex, low)]

    def beats(g, h):
        if not (g[0] <= h[0] and g[1] >= h[1]):
            return False
        return g[3] > h[3] or (g[3] == h[3] and (g[1] - g[0] > h[1] - h[0] or (g[:2] == h[:2] and g[4] < h[4])))

    return sorted(h[:4] for h in hits if not any(beats(g, h) for g in hits))


def wrapped(notice: str, rng: random.Random) -> str:
    """Between words a blank, a line break or a comment's next line."""
    return "".join(rng.choice([" ", "\n", "\n# ", "\n * ", "  "]) if c == " " else c for c in notice)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    fill = ["foo", "bar.", "the", "license", "of", "cc", "by", "version", "2.0", "naïve"]
    made = []
    for i in range(120):
        parts = [rng.choice([rng.choice(NOTICES), wrapped(rng.choice(NOTICES), rng), " ".join(rng.choices(fill, k=6))]) for _ in range(rng.randint(0, 12))]
        made.append((i, rng.choice([" ", "\n", "; "]).join(parts)))
    return made


def test_against_brute_force(spark, corpus):
    got = {r.doc_id: [tuple(d) for d in r.detections] for r in licenses.license_scan(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    for i, text in corpus:
        assert sorted(got[i]) == brute(text), (i, text)
    assert sum(map(len, got.values())) > 300


def test_ties_and_containment(spark):
    own = [license_rules.Rule("first", "abc", 50, "abc"), license_rules.Rule("second", "abc", 50, "abc"), license_rules.Rule("long", "abcd", 50, "abcde?"), license_rules.Rule("low", "xabcdx", 30, "xabcdx"), license_rules.Rule("overlap", "dx", 50, "dx.")]
    got = lambda t: [(d.start, d.end, d.label) for d in licenses.license_scan(spark.createDataFrame([(1, t)], "doc_id long, text string"), own).first().detections]
    assert got("abc") == [(0, 3, "first")]
    assert got("xabcdx.") == [(0, 6, "low"), (1, 5, "long"), (4, 7, "overlap")]


def test_wrapped_notices_keep_their_labels(spark):
    said = "Mozilla\nPublic License 2.0\n\n# Redistribution and use in source\n# and binary forms"
    assert licenses.license_scan(spark.createDataFrame([(1, said)], "doc_id long, text string")).first().labels == "bsd,mpl-2.0"


def test_many_matches_take_time_in_proportion(spark):
    notice = "licensed under the apache license, version 2.0; mit license\nspdx-license-identifier: mit and the gnu general public license v3. "
    began = time.perf_counter()
    r = licenses.license_scan(spark.createDataFrame([(1, notice * 2500)], "doc_id long, text string")).first()
    assert len(r.detections) == 10_000 and r.n_base == 7500 and time.perf_counter() - began < 30


def test_plan_has_no_python_and_no_exchange(spark):
    plan = licenses.license_scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "MapIn", "Exchange", "Join"))
