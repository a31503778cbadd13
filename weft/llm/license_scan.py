"""License scans: ordered signature rules behind a keyword prefilter.

Texts are reduced to lower-case words (ASCII letters and digits and all non-ASCII characters), joined by single
spaces, so that signatures are written without regard to case, line breaks and punctuation. RULES is an ordered
table of some three hundred signatures (name, label, priority, keyword, regex), built from the catalogue of licences
below and a few hand-written wordings for each kind of statement (name, version, permission sentence, file header,
identifier tag, address). A rule runs only on texts that hold its keyword. Matches are intervals of words; a match
contained in an interval of higher priority (or in a longer one of equal priority) is suppressed, so that "gnu lesser
general public license version 3" is not reported as plain GPL by the method as well.

BASE_PHRASES are reported wherever their words stand consecutively, beside the method's own labels.

Defined results: a null or empty text has no words, places or labels and score 0; overlapping equal matches count
once; repeated rows get equal results; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrase -> label of the base result.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

# Catalogue of licences as (label, spoken names, identifier stems, versions); names in reduced words.
CATALOGUE = [
    ("mit", ["mit", "expat", "x11"], ["mit"], []),
    ("apache", ["apache software", "apache"], ["apache"], ["1 0", "1 1", "2 0", "2"]),
    ("gpl", ["gnu general public", "gnu gpl", "gpl"], ["gpl"], ["1", "2", "2 0", "3", "3 0"]),
    ("lgpl", ["gnu lesser general public", "gnu library general public", "lesser general public", "lgpl"], ["lgpl"], ["2", "2 0", "2 1", "3", "3 0"]),
    ("agpl", ["gnu affero general public", "affero general public", "agpl"], ["agpl"], ["1 0", "3", "3 0"]),
    ("gfdl", ["gnu free documentation", "gfdl"], ["gfdl"], ["1 1", "1 2", "1 3"]),
    ("bsd", ["new bsd", "modified bsd", "simplified bsd", "freebsd", "bsd"], ["bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd"], []),
    ("mpl", ["mozilla public", "mpl"], ["mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public", "epl"], ["epl"], ["1 0", "2 0"]),
    ("cddl", ["common development and distribution", "cddl"], ["cddl"], ["1 0", "1 1"]),
    ("cpl", ["common public"], ["cpl"], ["1 0"]),
    ("artistic", ["artistic", "perl artistic"], ["artistic"], ["1 0", "2 0"]),
    ("boost", ["boost software"], ["bsl"], ["1 0"]),
    ("isc", ["isc"], ["isc"], []),
    ("zlib", ["zlib", "zlib libpng"], ["zlib"], []),
    ("unlicense", ["unlicense"], ["unlicense"], []),
    ("wtfpl", ["do what the fuck you want to public", "wtfpl"], ["wtfpl"], ["2"]),
    ("cc0", ["creative commons zero", "cc0"], ["cc0"], ["1 0"]),
    ("cc-by", ["creative commons attribution", "cc by"], ["cc by"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", ["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"], ["cc by sa"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", ["creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"], ["cc by nc"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nd", ["creative commons attribution noderivatives", "creative commons attribution no derivatives", "cc by nd"], ["cc by nd"], ["3 0", "4 0"]),
    ("ofl", ["sil open font", "open font"], ["ofl"], ["1 0", "1 1"]),
    ("eupl", ["european union public", "eupl"], ["eupl"], ["1 1", "1 2"]),
    ("python", ["python software foundation", "psf"], ["psf", "python"], ["2", "2 0"]),
    ("php", ["php"], ["php"], ["3 0", "3 01"]),
    ("ruby", ["ruby"], ["ruby"], []),
    ("postgresql", ["postgresql"], ["postgresql"], []),
    ("openssl", ["openssl"], ["openssl"], []),
    ("ms-pl", ["microsoft public"], ["ms pl"], []),
    ("ms-rl", ["microsoft reciprocal"], ["ms rl"], []),
    ("osl", ["open software"], ["osl"], ["1 0", "2 1", "3 0"]),
    ("afl", ["academic free"], ["afl"], ["2 1", "3 0"]),
    ("qpl", ["q public"], ["qpl"], ["1 0"]),
    ("upl", ["universal permissive"], ["upl"], ["1 0"]),
    ("vim", ["vim"], ["vim"], []),
    ("ncsa", ["university of illinois ncsa open source", "ncsa open source"], ["ncsa"], []),
    ("sspl", ["server side public"], ["sspl"], ["1", "1 0"]),
    ("busl", ["business source"], ["busl"], ["1 1"]),
    ("odbl", ["open data commons open database", "open database"], ["odbl"], ["1 0"]),
    ("json", ["json"], ["json"], []),
    ("beerware", ["beerware", "beer ware"], ["beerware"], []),
]

# Sentences that stand for a licence without naming it, as (label, keyword, regex over reduced words).
SENTENCES = [
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "provided as is", r"the software is provided as is without warranty of any kind express or implied"),
    ("isc", "permission to use copy modify and or", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors may be used"),
    ("apache", "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache", "apache org licenses", r"(?:https? )?www apache org licenses(?: license 2 0)?"),
    ("gpl", "free software foundation", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("gpl", "gnu org licenses", r"www gnu org licenses(?: gpl)?(?: \d(?: \d)?)?"),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed)(?: \w+){0,3} (?:in|into|to) the public domain"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("boost", "boost org", r"www boost org license 1 0 txt"),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by (?:\d \d)"),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa (?:\d \d)"),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc(?: sa| nd)? (?:\d \d)"),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero (?:\d \d)"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)(?: \w+){0,4} information"),
]


@cache
def rules() -> list[tuple[str, str, int, str, re.Pattern[str]]]:
    """(name, label, priority, keyword, regex), highest priority first; each regex stands between word boundaries."""
    out = []
    for label, names, stems, versions in CATALOGUE:
        for name in names:
            out.append((f"{label}/name/{name}", label, 40 + len(name.split()), name, rf"(?:the )?{name} licen[cs]e"))
            out.append((f"{label}/under/{name}", label, 50 + len(name.split()), name, rf"(?:licensed|released|distributed|available|published|provided)(?: \w+){{0,2}} under (?:the )?(?:terms of the )?{name}(?: licen[cs]e)?"))
            if versions:
                version = "|".join(sorted(versions, key=len, reverse=True))
                out.append((f"{label}/version/{name}", label, 60 + len(name.split()), name, rf"(?:the )?{name}(?: licen[cs]e)?(?: version| v) ?(?:{version})(?: or (?:any )?later)?"))
        for stem in stems:
            version = rf"(?: (?:{'|'.join(sorted(versions, key=len, reverse=True))}))?(?: only| or later)?" if versions else ""
            out.append((f"{label}/tag/{stem}", label, 90, "spdx license identifier", rf"spdx license identifier {stem}{version}"))
            out.append((f"{label}/url/{stem}", label, 80, "opensource org licenses", rf"opensource org licenses {stem}{version}"))
            out.append((f"{label}/field/{stem}", label, 30, "license " + stem.split()[0], rf"(?:project|package|software|code|file)? ?license {stem}{version}"))
    out += [(f"{label}/sentence/{i}", label, 85, key, pattern) for i, (label, key, pattern) in enumerate(SENTENCES)]
    out.sort(key=lambda r: (-r[2], r[0]))
    return [(n, lb, pr, key, re.compile(rf"(?<![^ ])(?:{p})(?![^ ])")) for n, lb, pr, key, p in out]


@cache
def by_keyword() -> dict[str, list[tuple[str, str, int, re.Pattern[str]]]]:
    out: dict[str, list] = {}
    for name, label, priority, key, pattern in rules():
        out.setdefault(key, []).append((name, label, priority, pattern))
    return out


#: A text without any of these holds no rule's match at all: every keyword's rules need one of them.
ANCHORS = ("licen", "under ", " version", " v ", " v1", " v2", " v3", " v4", "spdx", "opensource", "permission", "provided", "redistribut", "neither", "apache", "gnu ", "lesser", "source code form", "public domain", "misrepresented", "boost org", "creativecommons", "reserved", "proprietary")


def reduced(text: str | None) -> tuple[str, int]:
    """The words of a text joined by single spaces, and how many they are."""
    parts = (text or "").encode("utf-8").translate(_KEEP).split()
    return b" ".join(parts).decode("utf-8"), len(parts)


def places(words: str, phrase: str) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively."""
    out, at, seen, upto = [], words.find(phrase), 0, 0
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or words[at - 1] == " ") and (end == len(words) or words[end] == " "):
            seen += words.count(" ", upto, at)
            upto = at
            out.append(seen)
        at = words.find(phrase, at + 1)
    return out


def matches(words: str) -> list[tuple[int, int, str, str, int]]:
    """(first character, end, label, rule, priority) of the matches that stand, in order of position."""
    found = []
    if any(a in words for a in ANCHORS):
        padded = f" {words} "
        for key, group in by_keyword().items():
            if f" {key} " in padded:
                found += [(m.start(), m.end(), label, name, priority) for name, label, priority, pattern in group for m in pattern.finditer(words)]
    return suppressed(found)


def suppressed(found: list[tuple[int, int, str, str, int]]) -> list[tuple[int, int, str, str, int]]:
    """Drops what lies inside a kept interval: taken by priority, then length, then position, each match is kept
    unless a kept one contains it."""
    places = sorted({m[0] for m in found})
    number = {at: i + 1 for i, at in enumerate(places)}
    ends = [0] * (len(places) + 1)  # a Fenwick tree: the greatest end of kept matches by start
    kept: list[tuple[int, int, str, str, int]] = []
    for m in sorted(found, key=lambda m: (-m[4], m[0] - m[1], m[0], m[3])):
        i, furthest = number[m[0]], 0
        while i:
            furthest = max(furthest, ends[i])
            i &= i - 1
        if furthest >= m[1]:
            continue
        i = number[m[0]]
        while i < len(ends):
            ends[i] = max(ends[i], m[1])
            i += i & -i
        kept.append(m)
    return sorted(kept)


def scan(text: str | None) -> dict:
    words, n = reduced(text)
    base = {phrase: places(words, phrase) for phrase in BASE_PHRASES} if " license" in words else {}
    starts = [p for ps in base.values() for p in ps]
    found = matches(words)
    base_labels = sorted({BASE_PHRASES[k] for k, ps in base.items() if ps})
    labels = sorted({*base_labels, *(m[2] for m in found)})
    best = max((m[4] for m in found), default=0)
    return {
        "n_words": n,
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(base_labels),
        "labels": ",".join(labels),
        "score": min(1.0, max(best / 100, 0.5 if starts else 0.0)),
        "n_matches": len(found),
        "rules": ",".join(dict.fromkeys(m[3] for m in found)),
    }


RESULT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_matches bigint, rules string"


def scanned(text: Column) -> Column:
    """Struct column RESULT for a text column."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            frame = pd.DataFrame([scan(t) for t in texts], columns=[c.split()[0] for c in RESULT.split(", ")])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return run(text)
