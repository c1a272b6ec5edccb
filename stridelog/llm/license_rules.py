"""Signature rules of the license scan: label, keywords, priority, regex.

A rule is tried only where each of its keywords occurs in the lower-cased text, and
every match of its regex holds each keyword as it stands (tests prove it from the
parsed regex): the gate loses nothing, whatever a notice's line breaks and comment
marks. Priority orders overlapping detections: a full notice or exact identifier
(90) beats a named version (70), which beats a bare name (50) and a hint (30). Of
equal detections of equal priority the rule that comes first stays.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    #: Divided by spaces.
    keywords: str
    priority: int
    regex: str


S = r"[\s\W]+"  # between words: line breaks and comment marks too


def _w(*words: str) -> str:
    return S.join(words)


def _spdx() -> list[Rule]:
    """An SPDX line for each identifier: the identifier itself is the label."""
    names = """0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1
    apache-2.0 apsl-1.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent
    bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc0-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5
    cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0
    cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0
    eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only
    gpl-3.0-or-later hpnd icu ijg imagemagick intel ipl-1.0 isc jasper-2.0 json lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later
    lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng libtiff lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0
    ncsa nist-pd nposl-3.0 ntp odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-1.0 osl-2.0 osl-2.1 osl-3.0 php-3.0 php-3.01 pddl-1.0
    postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sleepycat spl-1.0 sspl-1.0 tcl unicode-dfs-2016 unlicense upl-1.0 vim w3c
    wtfpl x11 xnet zend-2.0 zlib zpl-2.0 zpl-2.1"""
    return [Rule(n, "spdx-license-identifier", 90, r"spdx-license-identifier:\s*\(?" + n.replace(".", r"\.") + r"(?![\w.+-])") for n in names.split()]


def _versions() -> list[Rule]:
    """Named licenses with their versions, as notices cite them."""
    named = [
        ("gpl", "general public license", (("1", "gpl-1.0"), ("2", "gpl-2.0"), ("3", "gpl-3.0"))),
        ("lgpl", "lesser general public license", (("2\\.1", "lgpl-2.1"), ("3", "lgpl-3.0"))),
        ("lgpl", "library general public license", (("2", "lgpl-2.0"),)),
        ("agpl", "affero general public license", (("1", "agpl-1.0"), ("3", "agpl-3.0"))),
        ("gfdl", "free documentation license", (("1\\.1", "gfdl-1.1"), ("1\\.2", "gfdl-1.2"), ("1\\.3", "gfdl-1.3"))),
        ("apache", "apache license", (("1\\.0", "apache-1.0"), ("1\\.1", "apache-1.1"), ("2(?:\\.0)?", "apache-2.0"))),
        ("mpl", "mozilla public license", (("1\\.0", "mpl-1.0"), ("1\\.1", "mpl-1.1"), ("2\\.0", "mpl-2.0"))),
        ("epl", "eclipse public license", (("1\\.0", "epl-1.0"), ("2\\.0", "epl-2.0"))),
        ("eupl", "european union public licence", (("1\\.1", "eupl-1.1"), ("1\\.2", "eupl-1.2"))),
        ("cddl", "common development and distribution license", (("1\\.0", "cddl-1.0"), ("1\\.1", "cddl-1.1"))),
        ("cpl", "common public license", (("1\\.0", "cpl-1.0"),)),
        ("afl", "academic free license", (("1\\.2", "afl-1.2"), ("2\\.1", "afl-2.1"), ("3\\.0", "afl-3.0"))),
        ("osl", "open software license", (("1\\.0", "osl-1.0"), ("2\\.1", "osl-2.1"), ("3\\.0", "osl-3.0"))),
        ("artistic", "artistic license", (("1\\.0", "artistic-1.0"), ("2\\.0", "artistic-2.0"))),
        ("bsl", "boost software license", (("1\\.0", "bsl-1.0"),)),
        ("busl", "business source license", (("1\\.1", "busl-1.1"),)),
        ("ofl", "sil open font license", (("1\\.0", "ofl-1.0"), ("1\\.1", "ofl-1.1"))),
        ("sspl", "server side public license", (("1", "sspl-1.0"),)),
        ("odbl", "open database license", (("1\\.0", "odbl-1.0"),)),
        ("zpl", "zope public license", (("2\\.0", "zpl-2.0"), ("2\\.1", "zpl-2.1"))),
        ("php", "php license", (("3\\.0", "php-3.0"), ("3\\.01", "php-3.01"))),
        ("elastic", "elastic license", (("2\\.0", "elastic-2.0"),)),
        ("upl", "universal permissive license", (("1\\.0", "upl-1.0"),)),
        ("mulan", "mulan psl", (("2", "mulanpsl-2.0"),)),
    ]
    out = []
    for family, name, versions in named:
        said = _w(*name.split())
        out.append(Rule(family, name, 50, rf"\b{said}\b"))
        for number, label in versions:
            v = r"(?:[\s\W]*(?:version|v\.?)\s*|\s*-?\s*v?)"
            out.append(Rule(label, name, 70, rf"\b{said}\b{v}{number}(?![\d.]*\d)"))
            out.append(Rule(label, name, 80, rf"\bversion{S}{number}{S}of{S}the{S}(?:\w+{S}){{0,2}}{said}\b"))
    return out


def _creative_commons() -> list[Rule]:
    """Every Creative Commons licence by abbreviation, by name and by link."""
    words = {"by": "attribution", "nc": "non-?commercial", "nd": "no-?deriv(?:ative|ative works|atives|s)", "sa": "share-?alike"}
    out = []
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        short, long = kind.replace("-", r"[-\s]"), S.join(words[k] for k in kind.split("-"))
        out.append(Rule(f"cc-{kind}", "cc by", 50, rf"\bcc[-\s]{short}\b(?![-\s](?:sa|nd|nc)\b)"))
        out.append(Rule(f"cc-{kind}", "creative commons", 60, rf"\bcreative{S}commons{S}{long}\b"))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            n = v.replace(".", r"\.")
            out.append(Rule(f"cc-{kind}-{v}", "cc by", 70, rf"\bcc[-\s]{short}[-\s]v?{n}(?![\d.]*\d)"))
            out.append(Rule(f"cc-{kind}-{v}", "creativecommons.org", 90, rf"creativecommons\.org/licenses/{kind}/{n}\b"))
    out += [
        Rule("cc0-1.0", "cc0", 70, r"\bcc0(?:[-\s]1\.0)?\b"),
        Rule("cc0-1.0", "creativecommons.org", 90, r"creativecommons\.org/publicdomain/zero/1\.0\b"),
        Rule("cc-pdm-1.0", "creativecommons.org", 90, r"creativecommons\.org/publicdomain/mark/1\.0\b"),
        Rule("cc", "creative commons licen", 30, rf"\bcreative{S}commons{S}licen[cs]e"),
    ]
    return out


#: Notices and names with wording of their own. A space stands for what is between words.
WRITTEN = [
    Rule("mit", "mit license", 50, r"\bmit license\b"),
    Rule("mit", "mit/x11 license", 60, r"\bmit/x11 license\b"),
    Rule("mit", "permission hereby granted charge obtaining", 90, r"permission is hereby granted free of charge to any person obtaining a copy"),
    Rule("mit", "opensource.org/license", 80, r"opensource\.org/licenses?/mit\b"),
    Rule("mit-0", "mit no attribution", 80, r"\bmit no attribution\b"),
    Rule("apache-2.0", "apache.org", 90, r"apache\.org/licenses/license-2\.0"),
    Rule("apache-1.1", "apache software license version", 70, r"\bapache software license version 1\.1\b"),
    Rule("apache", "apache software license", 50, r"\bapache software license\b"),
    Rule("gpl-2.0-or-later", "general public license either later", 90, r"general public license[\s\S]{0,120}either version 2\b[\s\S]{0,90}any later version"),
    Rule("gpl-3.0-or-later", "general public license either later", 90, r"general public license[\s\S]{0,120}either version 3\b[\s\S]{0,90}any later version"),
    Rule("gpl-2.0", "gpl", 60, r"\bgplv?-?\s?2(?:\.0)?\b"),
    Rule("gpl-3.0", "gpl", 60, r"\bgplv?-?\s?3(?:\.0)?\b"),
    Rule("lgpl-2.1", "lgpl", 70, r"\blgplv?-?\s?2\.1\b"),
    Rule("lgpl-3.0", "lgpl", 70, r"\blgplv?-?\s?3(?:\.0)?\b"),
    Rule("agpl-3.0", "agpl", 70, r"\bagplv?-?\s?3(?:\.0)?\b"),
    Rule("gpl", "gnu.org", 60, r"gnu\.org/(?:copyleft|licenses)/gpl\b"),
    Rule("gpl-2.0", "gnu.org", 80, r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    Rule("gpl-3.0", "gnu.org", 80, r"gnu\.org/licenses/gpl-3\.0"),
    Rule("lgpl-2.1", "gnu.org", 80, r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    Rule("lgpl-3.0", "gnu.org", 80, r"gnu\.org/licenses/lgpl-3\.0"),
    Rule("agpl-3.0", "gnu.org", 80, r"gnu\.org/licenses/agpl-3\.0"),
    Rule("bsd", "bsd license", 50, r"\bbsd license\b"),
    Rule("bsd", "bsd-style license", 30, r"\bbsd-style license"),
    Rule("bsd-2-clause", "2-clause bsd", 70, r"\b2-clause bsd\b|\bbsd 2-clause\b"),
    Rule("bsd-2-clause", "simplified bsd", 70, r"\bsimplified bsd\b"),
    Rule("bsd-3-clause", "3-clause bsd", 70, r"\b3-clause bsd\b|\bbsd 3-clause\b"),
    Rule("bsd-3-clause", "new bsd license", 70, r"\bnew bsd license\b"),
    Rule("bsd-3-clause", "modified bsd license", 70, r"\bmodified bsd license\b"),
    Rule("bsd-4-clause", "4-clause bsd", 70, r"\b4-clause bsd\b|\bbsd 4-clause\b"),
    Rule("bsd", "redistribution source binary forms", 80, r"redistribution and use in source and binary forms"),
    Rule("bsd-3-clause", "neither name endorse promote products", 85, r"neither the name of[\s\S]{1,200}?endorse or promote products"),
    Rule("bsd-4-clause", "advertising materials mentioning", 85, r"all advertising materials mentioning features"),
    Rule("isc", "isc license", 50, r"\bisc license\b"),
    Rule("isc", "permission modify distribute software purpose", 80, r"permission to use copy modify and(?:/or)? distribute this software for any purpose"),
    Rule("zlib", "zlib license", 50, r"\bzlib license\b"),
    Rule("zlib", "provided 'as-is' without express warranty", 80, r"provided 'as-is' without any express or implied warranty"),
    Rule("unlicense", "unlicense", 60, r"\bthe unlicense\b|\bunlicense\.org\b"),
    Rule("unlicense", "unencumbered software public domain", 80, r"free and unencumbered software released into the public domain"),
    Rule("public-domain", "public domain", 30, r"\b(?:in|into|to) the public domain\b"),
    Rule("wtfpl", "what fuck want public license", 80, r"do what the fuck you want to public license"),
    Rule("beerware", "beer ware license", 70, r"\bbeer-?ware license\b"),
    Rule("vim", "vim license", 50, r"\bvim license\b"),
    Rule("python-2.0", "python software foundation license", 70, r"\bpython software foundation license\b"),
    Rule("postgresql", "postgresql licen", 50, r"\bpostgresql licen[cs]e\b"),
    Rule("openssl", "openssl license", 50, r"\bopenssl license\b"),
    Rule("ruby", "ruby license", 50, r"\bruby license\b"),
    Rule("perl", "under same terms perl", 70, r"under the same terms as perl(?: itself)?"),
    Rule("artistic", "perl artistic license", 60, r"\bperl artistic license\b"),
    Rule("ms-pl", "microsoft public license", 70, r"\bmicrosoft public license\b"),
    Rule("ms-rl", "microsoft reciprocal license", 70, r"\bmicrosoft reciprocal license\b"),
    Rule("w3c", "w3c software license", 60, r"\bw3c software (?:notice and )?license\b"),
    Rule("ncsa", "university illinois open source license", 70, r"university of illinois(?:/ncsa)? open source license"),
    Rule("libpng", "libpng license", 50, r"\blibpng license\b"),
    Rule("freetype", "freetype project license", 60, r"\bfreetype project license\b"),
    Rule("ijg", "independent jpeg group", 50, r"\bindependent jpeg group"),
    Rule("curl", "curl license", 50, r"\bcurl license\b"),
    Rule("tcl", "tcl/tk license", 50, r"\btcl/tk license\b"),
    Rule("x11", "x11 license", 50, r"\bx11 license\b"),
    Rule("sleepycat", "sleepycat license", 50, r"\bsleepycat license\b"),
    Rule("qpl-1.0", "q public license", 60, r"\bq public license\b"),
    Rule("ipl-1.0", "ibm public license", 60, r"\bibm public license\b"),
    Rule("spl-1.0", "sun public license", 60, r"\bsun public license\b"),
    Rule("nposl-3.0", "non-profit open software license", 70, r"\bnon-profit open software license\b"),
    Rule("cecill", "cecill", 50, r"\bcecill(?:-[bc])?\b"),
    Rule("lppl", "latex project public license", 60, r"\blatex project public license\b"),
    Rule("json", "shall used good evil", 80, r"shall be used for good not evil"),
    Rule("commons-clause", "commons clause", 60, r"\bcommons clause\b"),
    Rule("blueoak", "blue oak model license", 60, r"\bblue oak model license\b"),
    Rule("openrail", "open rail", 50, r"\b(?:creativeml )?open\s?rail(?:-m|\+\+-m)?\b"),
    Rule("ogl", "open government licen", 60, r"\bopen government licen[cs]e\b"),
    Rule("odc-by", "open data commons attribution", 60, r"\bopen data commons attribution\b"),
    Rule("pddl", "public domain dedication licen", 60, r"\bpublic domain dedication and licen[cs]e\b"),
    Rule("proprietary", "all rights reserved", 30, r"\ball rights reserved\b"),
    Rule("proprietary", "confidential and proprietary", 40, r"\bconfidential and proprietary\b"),
    Rule("proprietary", "end user license agreement", 50, r"\bend[-\s]user license agreement\b"),
]


def rules() -> list[Rule]:
    """All signature rules, in order."""
    return [*[r._replace(regex=r.regex.replace(" ", S)) for r in WRITTEN], *_spdx(), *_versions(), *_creative_commons()]
