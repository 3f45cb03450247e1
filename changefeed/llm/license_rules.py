"""Signature rules of the license scan: hand-written patterns over normalised words, and what makes hundreds of rules of them.

Patterns see lower-case words (runs of letters, digits and characters beyond ASCII) joined by one space, so ``CC-BY-SA 4.0`` is ``cc by sa 4 0``. A pattern begins
at its keyword. Rules are ordered: of two matches of the same words and rank, that of the earlier rule stands.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Ranks, the strongest first: a machine-readable tag, a grant under a named license, a title or notice, a short name, a mention.
TAG, GRANT, TITLE, SHORT, MENTION = 5, 4, 3, 2, 1
STRENGTH = {TAG: 1.0, GRANT: 0.95, TITLE: 0.8, SHORT: 0.6, MENTION: 0.3}

# Phrases that are reported wherever they stand, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licenses with versions: label, its title, its short names, versions. A label has the version after a hyphen.
VERSIONED = (
    ("gpl", "gnu general public licen[sc]e", "gnu gpl|gpl", "1.0 2.0 3.0"),
    ("lgpl", "gnu (?:lesser|library) general public licen[sc]e", "gnu lgpl|lgpl", "2.0 2.1 3.0"),
    ("agpl", "gnu affero general public licen[sc]e", "gnu agpl|agpl", "1.0 3.0"),
    ("gfdl", "gnu free documentation licen[sc]e", "gnu fdl|gfdl", "1.1 1.2 1.3"),
    ("apache", "apache(?: software)? licen[sc]e", "apache|asl", "1.0 1.1 2.0"),
    ("mpl", "mozilla public licen[sc]e", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public licen[sc]e", "epl", "1.0 2.0"),
    ("cddl", "common development and distribution licen[sc]e", "cddl", "1.0 1.1"),
    ("artistic", "artistic licen[sc]e", "artistic", "1.0 2.0"),
    ("afl", "academic free licen[sc]e", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "open software licen[sc]e", "osl", "1.0 2.0 2.1 3.0"),
    ("eupl", "european union public licen[sc]e", "eupl", "1.0 1.1 1.2"),
    ("ofl", "sil open font licen[sc]e", "ofl|sil ofl", "1.0 1.1"),
    ("zpl", "zope public licen[sc]e", "zpl", "1.1 2.0 2.1"),
    ("lppl", "latex project public licen[sc]e", "lppl", "1.0 1.1 1.2 1.3"),
    ("cecill", "cecill(?: free software)? licen[sc]e(?: agreement)?", "cecill", "1.0 1.1 2.0 2.1"),
    ("odc-by", "open data commons attribution licen[sc]e", "odc by", "1.0"),
    ("odbl", "(?:open data commons )?open database licen[sc]e", "odbl", "1.0"),
    ("bsl", "boost software licen[sc]e", "bsl", "1.0"),
    ("busl", "business source licen[sc]e", "busl", "1.1"),
    ("elastic", "elastic licen[sc]e", "elv", "2.0"),
    ("sspl", "server side public licen[sc]e", "sspl", "1.0"),
    ("ecl", "educational community licen[sc]e", "ecl", "1.0 2.0"),
    ("upl", "universal permissive licen[sc]e", "upl", "1.0"),
    ("apsl", "apple public source licen[sc]e", "apsl", "1.0 1.1 1.2 2.0"),
    ("mulanpsl", "mulan permissive software licen[sc]e", "mulanpsl|mulan psl", "1.0 2.0"),
    ("cdla-permissive", "community data licen[sc]e agreement permissive", "cdla permissive", "1.0 2.0"),
    ("cdla-sharing", "community data licen[sc]e agreement sharing", "cdla sharing", "1.0"),
    ("cc0", "creative commons (?:cc0|zero)|cc0(?: universal)?(?: public domain dedication)?", "cc0|cc zero", "1.0"),
)

# Licenses without versions: label, title, short names as a tag has them.
PLAIN = (
    ("mit", "mit licen[sc]e|expat licen[sc]e", "mit|expat"),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[sc]e", "bsd 2 clause"),
    ("bsd-3-clause", "(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[sc]e", "bsd 3 clause"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e", "bsd 4 clause"),
    ("bsd", "bsd(?: style)? licen[sc]e", "bsd"),
    ("0bsd", "(?:zero clause|0 clause) bsd licen[sc]e|0bsd licen[sc]e", "0bsd"),
    ("isc", "isc licen[sc]e", "isc"),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib"),
    ("libpng", "libpng licen[sc]e", "libpng"),
    ("curl", "curl licen[sc]e", "curl"),
    ("x11", "x11 licen[sc]e", "x11"),
    ("unlicense", "unlicense(?: license)?", "unlicense"),
    ("wtfpl", "do what the f\\S* you want to public licen[sc]e", "wtfpl"),
    ("beerware", "beer ?ware licen[sc]e", "beerware"),
    ("ms-pl", "microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "ms rl"),
    ("cpl-1.0", "common public licen[sc]e", "cpl 1 0"),
    ("ipl-1.0", "ibm public licen[sc]e", "ipl 1 0"),
    ("psf-2.0", "python software foundation licen[sc]e|psf licen[sc]e", "psf 2 0"),
    ("php-3.01", "php licen[sc]e", "php 3 01"),
    ("ruby", "ruby licen[sc]e", "ruby"),
    ("perl", "same terms as perl(?: itself)?", "artistic or gpl"),
    ("ncsa", "university of illinois ncsa open source licen[sc]e|ncsa licen[sc]e", "ncsa"),
    ("postgresql", "postgresql licen[sc]e", "postgresql"),
    ("openssl", "openssl licen[sc]e", "openssl"),
    ("vim", "vim licen[sc]e", "vim"),
    ("w3c", "w3c(?: software)?(?: notice and)? licen[sc]e", "w3c"),
    ("unicode-dfs", "unicode(?: data files and software)? licen[sc]e", "unicode dfs 2016"),
    ("json", "json licen[sc]e", "json"),
    ("qpl-1.0", "q public licen[sc]e", "qpl 1 0"),
    ("hpnd", "historical permission notice and disclaimer", "hpnd"),
    ("blueoak-1.0.0", "blue oak model licen[sc]e", "blueoak 1 0 0"),
    ("openrail", "(?:creativeml )?open ?rail(?: [a-z])? licen[sc]e", "openrail"),
    ("pddl-1.0", "(?:open data commons )?public domain dedication and licen[sc]e", "pddl 1 0"),
    ("ogl-uk", "open government licen[sc]e", "ogl uk 3 0"),
)

# Creative Commons: the words of a licence's terms, as initials and in full. Labels are cc-<terms>-<version>.
TERMS = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
TERM_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

# Notices and mentions: label, rank, pattern. The texts that a license asks to be repeated, and what a rights holder reserves.
NOTICES = (
    ("mit", GRANT, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsl-1.0", GRANT, "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", GRANT, "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("hpnd", GRANT, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("gfdl", GRANT, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("zlib", GRANT, "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("bsd", GRANT, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", TITLE, "neither the name of (?:the )?(?:\\S+ ){1,8}nor the names of its contributors"),
    ("bsd-4-clause", TITLE, "all advertising materials mentioning features or use of this software must display"),
    ("gpl", GRANT, "redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", GRANT, "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", GRANT, "redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gpl", TITLE, "gnu general public licen[sc]e"),
    ("gpl-2.0", TITLE, "published by the free software foundation (?:either )?version 2(?: of the licen[sc]e)?"),
    ("gpl-3.0", TITLE, "published by the free software foundation (?:either )?version 3(?: of the licen[sc]e)?"),
    ("apache-2.0", TITLE, "unless required by applicable law or agreed to in writing (?:software )?distributed under the license"),
    ("apache-2.0", TITLE, "apache org licenses license 2 0"),
    ("mpl-2.0", GRANT, "source code form is subject to the terms of the mozilla public license"),
    ("epl-1.0", GRANT, "accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", GRANT, "accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("unlicense", GRANT, "free and unencumbered software released into the public domain"),
    ("public-domain", GRANT, "(?:dedicated|released|placed) (?:to|into|in) the public domain"),
    ("public-domain", TITLE, "public domain (?:work|dedication|mark)"),
    ("cc0-1.0", GRANT, "waived all copyright and related or neighboring rights"),
    ("as-is", TITLE, "software is provided as is without warranty of any kind"),
    ("as-is", TITLE, "provided as is without any (?:express or implied|expressed or implied) warrant(?:y|ies)"),
    ("as-is", SHORT, "without warranty of any kind"),
    ("copyleft", SHORT, "derivative works must be (?:licensed|distributed) under the same"),
    ("dual", SHORT, "dual licen[sc]ed under"),
    ("open-source", SHORT, "licen[sc]ed under an open source licen[sc]e"),
    ("noncommercial", TITLE, "non ?commercial (?:use|purposes)(?: only)?"),
    ("noncommercial", TITLE, "personal and non ?commercial use"),
    ("noncommercial", TITLE, "research (?:use|purposes) only"),
    ("no-derivatives", TITLE, "no derivative works (?:are )?(?:allowed|permitted)"),
    ("no-training", TITLE, "not be used (?:to|for) train(?:ing)?(?: of)?(?: any)? (?:ai|artificial intelligence|machine learning|language models?|models?)"),
    ("no-training", TITLE, "text and data mining (?:is|are) (?:not permitted|reserved|prohibited)"),
    ("proprietary", TITLE, "proprietary and confidential"),
    ("proprietary", TITLE, "confidential and proprietary"),
    ("proprietary", TITLE, "unauthori[sz]ed (?:copying|reproduction|distribution|redistribution|use|duplication)"),
    ("proprietary", TITLE, "no part of this (?:publication|book|document|work|article|site|website|material) may be (?:reproduced|copied|used)"),
    ("proprietary", TITLE, "may not be (?:reproduced|copied|redistributed|republished|rewritten|broadcast)"),
    ("proprietary", SHORT, "prior written permission"),
    ("copyright", MENTION, "copyright (?:c )?(?:\\d{4} )?(?:\\d{4} )?(?:by )?\\S+"),
    ("copyright", MENTION, "copyrighted (?:material|work|by)"),
    ("trademark", MENTION, "registered trademarks? of"),
    ("license", MENTION, "end user licen[sc]e agreement"),
    ("license", MENTION, "terms of (?:this|the) licen[sc]e"),
    ("license", MENTION, "see (?:the )?licen[sc]e(?: file)? for"),
)

GRANTED = "under (?:an? |the )?(?:terms (?:and conditions )?of (?:an? |the )?)?"
TAGGED = "spdx licen[sc]e identifier "


class Rule(NamedTuple):
    """``pattern`` matches from ``keyword`` on, to the end of a word; ``needle`` is in all that it matches. Group 1, if there is one, is the version: the words
    of a number that is put after the label."""

    number: int
    label: str
    rank: int
    keyword: str
    needle: str
    pattern: str


def first_words(pattern: str) -> list[str]:
    """The words that a pattern can begin with: those of its first word, or of a group of alternatives in front, which may be optional."""
    group = re.match(r"\(\?:([^()]*)\)(\??)(.*)", pattern)
    if not group:
        return _spellings(re.split(r" |\(", pattern)[0])
    found = [w for option in group[1].split("|") for w in _spellings(option.split(" ")[0])]
    return found + (first_words(group[3]) if group[2] else [])


def _spellings(word: str) -> list[str]:
    """A word with a class of letters or an optional letter, written out."""
    odd = re.search(r"\[(\w)(\w)\]|(\w)\?", word)
    if not odd:
        return [word]
    return [w for letter in ((odd[1], odd[2]) if odd[1] else (odd[3], "")) for w in _spellings(word[: odd.start()] + letter + word[odd.end() :])]


def longest_words(pattern: str) -> str:
    """The longest run of plain characters in a pattern outside groups, classes and options: what all its matches hold."""
    while "(" in pattern:
        pattern = re.sub(r"\([^()]*\)(?:\?|\{[^}]*\})?", "|", pattern)
    return max(re.split(r"\||\[[^\]]*\]|\\.[+*]?|.\?|\.\*", pattern), key=len)


def options_of(pattern: str) -> list[str]:
    """The alternatives of a pattern that are not inside a group."""
    found, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            found.append("")
        else:
            found[-1] += c
    return found


def _version(versions: str) -> str:
    """The words of one of ``versions`` as group 1; what ends in .0 is also written without it."""
    ways = [w for v in versions.split() for w in ([v.replace(".", " "), v[:-2]] if v.endswith(".0") else [v.replace(".", " ")])]
    return f"(?: version| ver| v)? v?({'|'.join(ways)})(?! \\d)"


def _forms(label: str, titles: str, shorts: str, versions: str = "") -> list[tuple[str, int, str, str]]:
    """(label, rank, pattern, needle) of a license: its tag, grants under it, its titles; its short names with a version or after a word of license."""
    number = _version(versions) if versions else ""
    maybe = f"(?:{number})?" if number else ""
    tags = [f"{label.replace('-', ' ')} ({'|'.join(v.replace('.', ' ') for v in versions.split())})" if versions else re.sub("[-.]", " ", label)]
    rows = [(label, TAG, f"{TAGGED}{t}(?: only| or later)?", longest_words(t)) for t in tags]
    for title in options_of(titles):
        rows += [(label, GRANT, f"{GRANTED}{title}{maybe}", longest_words(title)), (label, TITLE, f"{title}{maybe}", longest_words(title))]
    for short in options_of(shorts):
        rows += [(label, GRANT, f"{GRANTED}{short}{maybe}", short), (label, SHORT, f"licen[sc]e {short}{maybe}(?! licen)", short)]
        rows += [(label, SHORT, f"{short}{number}", short)] if versions else []
    return rows


def rules() -> list[Rule]:
    """All rules in order. A pattern that may begin with one of several words is a rule for each, of one number."""
    rows = [(label, MENTION, phrase, phrase) for phrase, label in BASE_PHRASES.items()]
    for name, titles, shorts, versions in VERSIONED:
        rows += _forms(name, titles, shorts, versions)
    for label, titles, shorts in PLAIN:
        rows += _forms(label, titles, shorts)
    for terms, full in TERMS.items():
        label, ending = f"cc-{terms.replace(' ', '-')}", "(?: licen[sc]e)?(?: international| unported| generic)?"
        rows += _forms(label, f"creative commons {full}{ending}", f"cc {terms}", TERM_VERSIONS)
        rows.append((label, TITLE, f"creativecommons org licenses {terms}{_version(TERM_VERSIONS)}", "creativecommons org"))
    rows += [(label, rank, pattern, longest_words(pattern)) for label, rank, pattern in NOTICES]
    return [
        Rule(number, label, rank, keyword, needle, pattern)
        for number, (label, rank, pattern, needle) in enumerate(rows)
        for keyword in dict.fromkeys(first_words(pattern))
    ]
