"""License scans: ordered signature rules, a keyword gate, and suppression of detections that lie inside better ones.

A text is read as words: maximal runs of ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII. Rules are regular
expressions over the words joined by single spaces. A rule runs only where its keyword is in the text. Detections are ordered by
priority (URLs and identifiers, then full names, then short mentions), then by length and place; one that lies inside an accepted
detection is suppressed.

Nulls and edges: a null or empty text has no words and score 0. Repeated rows each get a row. Extra columns are ignored. Whole texts are
scanned, however long.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import map_rows

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

IDENTIFIER, NAME, MENTION = 3, 2, 1
CONFIDENCE = {IDENTIFIER: 1.0, NAME: 0.9, MENTION: 0.6}

#: label, priority, keyword, pattern over the joined words. {v} stands for a version such as `2 0`, with or without the minor part.
V = r"(?:v|version |version v|ver )?"
FAMILIES: list[tuple[str, int, str, str]] = []


def _family(label, keyword, names=(), identifiers=(), urls=(), mentions=(), versions=()):
    """Rules of one licence family: identifiers and URLs, full names, short mentions; once for each version and once for none."""
    for version in (*versions, None):
        tag = f"{label}-{version}" if version else label
        minor = version.replace(".", " ") if version else ""
        number = re.sub(r" 0$", r"(?: 0)?", minor) if version else ""
        for kind, group in ((IDENTIFIER, identifiers), (IDENTIFIER, urls), (NAME, names), (MENTION, mentions)):
            for pattern in group:
                if ("{v}" in pattern) == bool(version):
                    FAMILIES.append((tag, kind, keyword, pattern.replace("{v}", number)))
                elif version is None and "{v}" in pattern and kind == NAME:
                    FAMILIES.append((tag, MENTION, keyword, re.sub(r"(?: ,)? \(\?:.*?\)\?\{v\}|\{v\}", "", pattern).strip()))


_SPDX = r"spdx license identifier "
_OSI = r"opensource org licenses? "
_family("apache", "apache", [r"apache (?:software )?license,? " + V + "{v}", r"apache (?:software )?foundation license"], [_SPDX + "apache {v}", "apache {v}"], [r"apache org licenses license {v}", _OSI + "apache {v}"], [r"apache license", r"apache licensed"], ["1.0", "1.1", "2.0"])
_family("gpl", "gpl", [r"gpl " + V + "{v}", r"gnu gpl " + V + "{v}", r"gplv{v}"], [_SPDX + r"gpl {v}(?: only| or later)?", _OSI + "gpl {v}"], [r"gnu org licenses gpl {v}", r"gnu org (?:copyleft|licenses) gpl"], [r"gnu gpl", r"gpl"], ["1.0", "2.0", "3.0"])
_family("gpl", "general", [r"general public license,? " + V + "{v}", r"gnu general public license,? " + V + "{v}", r"general public license as published by the free software foundation"], mentions=[r"gnu general public license"], versions=["1.0", "2.0", "3.0"])
_family("lgpl", "gpl", [r"lgpl " + V + "{v}", r"lgplv{v}"], [_SPDX + r"lgpl {v}(?: only| or later)?", _OSI + "lgpl {v}"], [r"gnu org licenses lgpl {v}", r"gnu org licenses lgpl"], [r"lgpl"], ["2.0", "2.1", "3.0"])
_family("lgpl", "general", [r"(?:gnu )?(?:lesser|library) general public license,? " + V + "{v}"], mentions=[r"lesser general public license", r"library general public license"], versions=["2.0", "2.1", "3.0"])
_family("agpl", "gpl", [r"agpl " + V + "{v}", r"agplv{v}"], [_SPDX + r"agpl {v}(?: only| or later)?"], [r"gnu org licenses agpl {v}", r"gnu org licenses agpl"], [r"agpl"], ["1.0", "3.0"])
_family("agpl", "affero", [r"(?:gnu )?affero general public license,? " + V + "{v}"], mentions=[r"affero general public license"], versions=["1.0", "3.0"])
_family("gfdl", "documentation", [r"(?:gnu )?free documentation license,? " + V + "{v}"], mentions=[r"gnu free documentation license"], versions=["1.1", "1.2", "1.3"])
_family("mit", "mit", [r"(?:the )?mit license", r"mit style license", r"licensed under the mit"], [_SPDX + "mit"], [_OSI + "mit"], [r"mit licensed", r"mit licence"])
_family("mit", "permission", [r"permission is hereby granted free of charge to any person obtaining a copy of this software", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"])
_family("mit-0", "mit", [r"mit no attribution"], [_SPDX + "mit 0"])
_family("bsd", "bsd", [r"bsd (?:style )?license", r"berkeley software distribution license"], [_SPDX + r"bsd"], [_OSI + "bsd license"], [r"bsd licensed", r"bsd licence"])
for _n, _word in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
    _family(f"bsd-{_n}-clause", "bsd", [rf"(?:{_n}|{_word}) clause bsd(?: license)?", rf"bsd (?:{_n}|{_word}) clause(?: license)?"], [_SPDX + rf"bsd {_n} clause", rf"bsd {_n} clause"], [_OSI + rf"bsd {_n} clause"])
_family("bsd", "redistribution", [r"redistribution and use in source and binary forms with or without modification are permitted", r"redistributions of source code must retain the above copyright notice", r"redistributions in binary form must reproduce the above copyright notice"])
_family("bsd-3-clause", "neither", [r"neither the name of .{1,120}? may be used to endorse or promote products"])
_family("isc", "isc", [r"(?:the )?isc license"], [_SPDX + "isc"], [_OSI + "isc"], [r"isc licensed"])
_family("isc", "permission", [r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"])
_family("mpl", "mpl", [r"mpl " + V + "{v}"], [_SPDX + "mpl {v}", "mpl {v}"], mentions=[r"mpl licensed"], versions=["1.0", "1.1", "2.0"])
_family("mpl", "mozilla", [r"mozilla public license,? " + V + "{v}"], urls=[r"mozilla org mpl {v}", r"mozilla org (?:en us )?mpl"], mentions=[r"mozilla public license"], versions=["1.0", "1.1", "2.0"])
_family("epl", "eclipse", [r"eclipse public license,? " + V + "{v}"], urls=[r"eclipse org legal epl v?{v}", r"eclipse org legal epl"], mentions=[r"eclipse public license"], versions=["1.0", "2.0"])
_family("epl", "epl", [r"epl " + V + "{v}"], [_SPDX + "epl {v}"], versions=["1.0", "2.0"])
_family("edl", "eclipse", [r"eclipse distribution license,? " + V + "{v}"], mentions=[r"eclipse distribution license"], versions=["1.0"])
_family("cddl", "development", [r"common development and distribution license,? " + V + "{v}"], mentions=[r"common development and distribution license"], versions=["1.0", "1.1"])
_family("cddl", "cddl", [r"cddl " + V + "{v}"], [_SPDX + "cddl {v}"], mentions=[r"cddl"], versions=["1.0", "1.1"])
_family("cpl", "common", [r"common public license,? " + V + "{v}"], mentions=[r"common public license"], versions=["1.0"])
_family("cpal", "common", [r"common public attribution license,? " + V + "{v}"], mentions=[r"common public attribution license"], versions=["1.0"])
_family("ipl", "ibm", [r"ibm public license,? " + V + "{v}"], mentions=[r"ibm public license"], versions=["1.0"])
_family("eupl", "union", [r"european union public licen[cs]e,? " + V + "{v}"], mentions=[r"european union public licen[cs]e"], versions=["1.0", "1.1", "1.2"])
_family("eupl", "eupl", [r"eupl " + V + "{v}"], [_SPDX + "eupl {v}"], mentions=[r"eupl"], versions=["1.0", "1.1", "1.2"])
_family("osl", "open", [r"open software license,? " + V + "{v}"], mentions=[r"open software license"], versions=["1.0", "2.0", "2.1", "3.0"])
_family("afl", "academic", [r"academic free license,? " + V + "{v}"], mentions=[r"academic free license"], versions=["1.1", "1.2", "2.0", "2.1", "3.0"])
_family("artistic", "artistic", [r"(?:the )?artistic license,? " + V + "{v}", r"perl artistic license"], [_SPDX + "artistic {v}"], [_OSI + "artistic license {v}"], [r"artistic license"], ["1.0", "2.0"])
_family("python", "python", [r"python software foundation license,? " + V + "{v}", r"psf license agreement"], [_SPDX + r"(?:psf|python) {v}"], mentions=[r"python software foundation license"], versions=["2.0"])
_family("zlib", "zlib", [r"(?:the )?zlib(?: libpng)? license"], [_SPDX + "zlib"], [_OSI + "zlib"], [r"zlib licensed"])
_family("libpng", "libpng", [r"libpng license"], [_SPDX + "libpng"])
_family("boost", "boost", [r"boost software license,? " + V + "{v}"], [_SPDX + "bsl {v}"], [r"boost org license {v}", r"boost org license"], [r"boost software license"], ["1.0"])
_family("unlicense", "unlicense", [r"the unlicense"], [_SPDX + "unlicense"], [r"unlicense org"], [r"unlicense"])
_family("public-domain", "domain", [r"released into the public domain", r"(?:placed|dedicated) (?:in|to|into) the public domain", r"public domain dedication"], mentions=[r"in the public domain"])
_family("wtfpl", "wtfpl", [r"wtfpl " + V + "{v}"], [_SPDX + "wtfpl"], mentions=[r"wtfpl"], versions=["2.0"])
_family("beerware", "beer", [r"the beer ware license", r"beerware license"], [_SPDX + "beerware"])
_family("ms-pl", "microsoft", [r"microsoft public license"], [_SPDX + "ms pl"])
_family("ms-rl", "microsoft", [r"microsoft reciprocal license"], [_SPDX + "ms rl"])
_family("ncsa", "ncsa", [r"university of illinois ncsa open source license", r"ncsa open source license"], [_SPDX + "ncsa"])
_family("postgresql", "postgresql", [r"(?:the )?postgresql licen[cs]e"], [_SPDX + "postgresql"])
_family("php", "php", [r"php license,? " + V + "{v}"], [_SPDX + "php {v}"], [r"php net license {v}"], [r"php license"], ["3.0", "3.01"])
_family("ruby", "ruby", [r"(?:the )?ruby license"], [_SPDX + "ruby"])
_family("openssl", "openssl", [r"openssl license"], [_SPDX + "openssl"])
_family("w3c", "w3c", [r"w3c software (?:notice and )?license", r"w3c document license"], [_SPDX + "w3c"])
_family("x11", "x11", [r"x11 license", r"x consortium license"], [_SPDX + "x11"])
_family("ofl", "font", [r"sil open font license,? " + V + "{v}"], [_SPDX + "ofl {v}"], mentions=[r"open font license"], versions=["1.0", "1.1"])
_family("upl", "permissive", [r"universal permissive license,? " + V + "{v}"], mentions=[r"universal permissive license"], versions=["1.0"])
_family("odbl", "database", [r"open database license,? " + V + "{v}"], mentions=[r"open database license"], versions=["1.0"])
_family("odc-by", "data", [r"open data commons attribution license"], [_SPDX + "odc by"])
_family("pddl", "data", [r"open data commons public domain dedication and license"], [_SPDX + "pddl"])
_family("sspl", "server", [r"server side public license,? " + V + "{v}"], mentions=[r"server side public license"], versions=["1.0"])
_family("busl", "business", [r"business source license,? " + V + "{v}"], [_SPDX + "busl {v}"], mentions=[r"business source license"], versions=["1.0", "1.1"])
_family("elastic", "elastic", [r"elastic license,? " + V + "{v}"], mentions=[r"elastic license"], versions=["1.0", "2.0"])
_family("ecl", "educational", [r"educational community license,? " + V + "{v}"], mentions=[r"educational community license"], versions=["1.0", "2.0"])
_family("bzip2", "bzip2", [r"bzip2 license"], [_SPDX + "bzip2"])
_family("curl", "curl", [r"curl license"], [_SPDX + "curl"])
_family("vim", "vim", [r"vim license"], [_SPDX + "vim"])
_family("zpl", "zope", [r"zope public license,? " + V + "{v}"], mentions=[r"zope public license"], versions=["1.1", "2.0", "2.1"])
_family("intel", "intel", [r"intel open source license"])
_family("sleepycat", "sleepycat", [r"sleepycat license"], [_SPDX + "sleepycat"])
_family("qpl", "q", [r"q public license,? " + V + "{v}"], versions=["1.0"])
_CC = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s(?: works)?", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"}
for _short, _long in _CC.items():
    _label = "cc-" + _short.replace(" ", "-")
    _versions = ["1.0", "2.0", "2.5", "3.0", "4.0"]
    _family(_label, "cc", [rf"cc {_short} {V}{{v}}"], [_SPDX + rf"cc {_short} {{v}}"], mentions=[rf"cc {_short}"], versions=_versions)
    _family(_label, "creative", [rf"creative commons {_long}(?: international| unported)?(?: license)? {V}{{v}}(?: international| unported)?(?: license)?"], mentions=[rf"creative commons {_long}"], versions=_versions)
    _family(_label, "creativecommons", urls=[rf"creativecommons org licenses {_short} {{v}}", rf"creativecommons org licenses {_short}"], versions=_versions)
_family("cc0", "cc0", [r"cc0 " + V + "{v}"], [_SPDX + "cc0 {v}"], mentions=[r"cc0"], versions=["1.0"])
_family("cc0", "creativecommons", urls=[r"creativecommons org publicdomain zero {v}", r"creativecommons org publicdomain zero"], versions=["1.0"])
_family("copyright", "copyright", [r"copyright (?:c |\xc2\xa9 )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", r"all rights reserved copyright"], mentions=[r"copyright holders?", r"copyright notice"])
_family("reserved", "reserved", [r"all rights reserved", r"no rights reserved", r"some rights reserved"])
_family("proprietary", "confidential", [r"proprietary and confidential", r"confidential and proprietary", r"strictly confidential"])
_family("proprietary", "proprietary", [r"proprietary license", r"this is proprietary software"])
_family("noncommercial", "commercial", [r"for non ?commercial use only", r"not for commercial use", r"free for non ?commercial use"])
_family("eula", "eula", [r"end user license agreement(?: eula)?", r"eula"])
_family("licensed", "license", [r"(?:released|distributed|published|available) under the terms of the", r"see the license file", r"license file for details"], mentions=[r"licensed under", r"under the license"])


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern


def _rules() -> list[Rule]:
    seen, out = set(), []
    for label, priority, keyword, pattern in FAMILIES:
        if (label, pattern) not in seen:
            seen.add((label, pattern))
            out.append(Rule(len(out), label, priority, keyword.encode(), re.compile(rb"(?<!\S)(?:" + pattern.encode("latin-1") + rb")(?!\S)")))
    return out


RULES = _rules()
KEYWORDS = sorted({r.keyword for r in RULES})
_BASE = [(p.split()[0].encode(), label, re.compile(rb"(?<!\S)" + p.encode() + rb"(?!\S)")) for p, label in BASE.items()]
_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: bytes) -> bytes:
    """The words, joined by single spaces."""
    return b" ".join(text.lower().translate(_TO_SPACE).split())


def detect(joined: bytes) -> list[tuple[Rule, int, int]]:
    """Detections (rule, first byte, end) that are left, best first."""
    present = {k for k in KEYWORDS if k in joined}
    found = [(r, m.start(), m.end()) for r in RULES if r.keyword in present for m in r.pattern.finditer(joined)]
    found.sort(key=lambda d: (-d[0].priority, d[1] - d[2], d[1], d[0].order))
    # furthest end of the accepted detections that begin at or before a place: a tree of prefix maxima over the places
    place = {a: i + 1 for i, a in enumerate(sorted({a for _, a, _ in found}))}
    furthest, kept = [0] * (len(place) + 1), []
    for rule, a, b in found:
        i, end = place[a], 0
        while i:
            end, i = max(end, furthest[i]), i & (i - 1)
        if end < b:
            kept.append((rule, a, b))
            i = place[a]
            while i < len(furthest):
                furthest[i] = max(furthest[i], b)
                i += i & -i
    return kept


def scan_text(text: bytes | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    joined = words_of(text or b"")
    n_words = joined.count(b" ") + 1 if joined else 0
    places, base = [], set()
    for first, label, pattern in _BASE:
        if first in joined:
            for m in pattern.finditer(joined):
                places.append(m.start())
                base.add(label)
    kept = detect(joined)
    word = lambda at: joined.count(b" ", 0, at)
    labels = base | {r.label for r, _, _ in kept}
    score = max([CONFIDENCE[r.priority] for r, _, _ in kept] + [0.5] * bool(base), default=0.0)
    return n_words, len(places), word(min(places)) if places else None, word(max(places)) if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, len(kept)


def spans_of(text: bytes | None) -> list[tuple[str, int, int]]:
    """(label, first word, words) of each detection, in the order of the text."""
    joined = words_of(text or b"")
    return sorted(((r.label, joined.count(b" ", 0, a), joined.count(b" ", a, b) + 1) for r, a, b in detect(joined)), key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every row of docs."""
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_detections bigint"

    def make():
        names = [f.split()[0] for f in schema.split(", ")]

        def work(batch):
            rows = [(doc, *scan_text(t)) for doc, t in zip(batch["doc_id"], batch["text "], strict=True)]
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return work

    return map_rows(docs.select("doc_id", F.col(text).alias("text ")), schema, make, binary=("text ",))
