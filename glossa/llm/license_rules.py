"""Signature rules of the license scan, in scan order.

A pattern is written in words: each item matches one whole word (a regex without
spaces), an item in ``[...]`` is optional.  ``compiled`` turns it into a regex over the
normalised text, in which every word stands between two spaces of its own, so a
match covers whole words and neighbouring matches do not share a space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Phrases that every scan reports, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# License names in words, the keyword that gates them, and their versions.
FAMILIES = (
    ("apache", ("apache licen[sc]e", "apache software licen[sc]e"), "apache", ("1 0", "1 1", "2 0")),
    ("mit", ("mit licen[sc]e", "expat licen[sc]e", "mit x11 licen[sc]e"), "licen", ()),
    ("x11", ("x11 licen[sc]e",), "x11", ()),
    ("bsd", ("bsd licen[sc]e", "bsd style licen[sc]e"), "bsd", ()),
    ("bsd-2-clause", ("bsd 2 clause [simplified] [licen[sc]e]", "simplified bsd licen[sc]e", "freebsd licen[sc]e"),
     "bsd|freebsd", ()),
    ("bsd-3-clause", ("bsd 3 clause [licen[sc]e]", "new bsd licen[sc]e", "modified bsd licen[sc]e"), "bsd", ()),
    ("bsd-4-clause", ("bsd 4 clause [licen[sc]e]", "original bsd licen[sc]e"), "bsd", ()),
    ("gpl", ("gnu general public licen[sc]e", "gnu gpl", "gpl"), "gnu|gpl", ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", ("gnu lesser general public licen[sc]e", "gnu library general public licen[sc]e", "lgpl"), "gnu|lgpl",
     ("2", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e", "agpl"), "affero|agpl",
     ("1", "3", "3 0")),
    ("gfdl", ("gnu free documentation licen[sc]e",), "documentation", ("1 1", "1 2", "1 3")),
    ("mpl", ("mozilla public licen[sc]e",), "mozilla", ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public licen[sc]e",), "eclipse", ("1 0", "2 0")),
    ("cpl", ("common public licen[sc]e",), "common", ("1 0",)),
    ("cddl", ("common development and distribution licen[sc]e",), "common", ("1 0", "1 1")),
    ("eupl", ("european union public licen[sc]e",), "european", ("1 0", "1 1", "1 2")),
    ("osl", ("open software licen[sc]e",), "licen", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free licen[sc]e",), "academic", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", ("artistic licen[sc]e",), "artistic", ("1 0", "2 0")),
    ("bsl", ("boost software licen[sc]e",), "boost", ("1 0",)),
    ("isc", ("isc licen[sc]e",), "isc", ()),
    ("zlib", ("zlib licen[sc]e", "zlib libpng licen[sc]e"), "zlib", ()),
    ("unlicense", ("the unlicense",), "unlicense", ()),
    ("psf", ("python software foundation licen[sc]e",), "python", ("2",)),
    ("zpl", ("zope public licen[sc]e",), "zope", ("1 1", "2 0", "2 1")),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), "font", ("1 0", "1 1")),
    ("cecill", ("cecill [free] [software] licen[sc]e",), "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("ncsa", ("ncsa open source licen[sc]e",), "ncsa", ()),
    ("postgresql", ("postgresql licen[sc]e",), "postgresql", ()),
    ("php", ("php licen[sc]e",), "php", ("3 0", "3 01")),
    ("ruby", ("ruby licen[sc]e",), "ruby", ()),
    ("openssl", ("openssl licen[sc]e",), "openssl", ()),
    ("ms-pl", ("microsoft public licen[sc]e",), "microsoft", ()),
    ("ms-rl", ("microsoft reciprocal licen[sc]e",), "microsoft", ()),
    ("busl", ("business source licen[sc]e",), "business", ("1 0", "1 1")),
    ("sspl", ("server side public licen[sc]e",), "server", ("1",)),
    ("elastic", ("elastic licen[sc]e",), "elastic", ("1", "2 0")),
    ("odbl", ("open database licen[sc]e",), "database", ("1 0",)),
    ("cdla-permissive", ("community data licen[sc]e agreement permissive",), "community", ("1 0", "2 0")),
    ("ogl", ("open government licen[sc]e",), "government", ("1 0", "2 0", "3 0")),
    ("w3c", ("w3c software [notice] [and] licen[sc]e",), "w3c", ()),
    ("ecl", ("educational community licen[sc]e",), "educational", ("1 0", "2 0")),
    ("ipl", ("ibm public licen[sc]e",), "ibm", ("1 0",)),
    ("qpl", ("q public licen[sc]e",), "licen", ("1 0",)),
    ("rpl", ("reciprocal public licen[sc]e",), "reciprocal", ("1 1", "1 5")),
    ("upl", ("universal permissive licen[sc]e",), "universal", ("1 0",)),
    ("vim", ("vim licen[sc]e",), "vim", ()),
)
# The clauses of the attribution licences, spelled out.
CLAUSES = (("by", "attribution"), ("by-sa", "attribution share[a-z]* [alike]"),
           ("by-nc", "attribution non[a-z]* [commercial]"), ("by-nd", "attribution no[a-z]* [derivatives|derivs]"),
           ("by-nc-sa", "attribution non[a-z]* [commercial] share[a-z]* [alike]"),
           ("by-nc-nd", "attribution non[a-z]* [commercial] no[a-z]* [derivatives|derivs]"))
CLAUSE_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Single signatures (label, priority, keyword, pattern).
SINGLE = (
    ("cc0", 2, "cc0", "cc0 [1] [0] [universal]"),
    ("public-domain", 2, "domain", "public domain [dedication]"),
    ("public-domain", 3, "domain", "dedicated to the public domain"),
    ("some-reserved", 3, "reserved", "some rights reserved"),
    ("no-reserved", 3, "reserved", "no rights reserved"),
    ("all-reserved", 3, "reserved", "all rights reserved"),
    ("all-reserved", 1, "reserved", "copyright [c] (19|20)[0-9][0-9] .+ all rights reserved"),
    ("copyright", 4, "copyright", "copyright [c] (19|20)[0-9][0-9]"),
    ("copyright", 4, "copyright", "copyright [c] by"),
    ("copyleft", 4, "copyleft", "copyleft"),
    ("permissive-grant", 1, "hereby", "permission is hereby granted free of charge"),
    ("warranty-disclaimer", 2, "licen|warranty", "without warranty of any kind"),
    ("see-license", 4, "licen", "see [the] licen[sc]e [file]"),
    ("proprietary", 3, "proprietary", "proprietary [and] [confidential]"),
)
# Sentences of licence texts (label, priority, keyword, pattern).
BODIES = (
    ("bsd", 1, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source-clause", 2, "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary-clause", 2, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 2, "endorse", "may be used to endorse or promote products derived from this software without specific prior "
                                   "written permission"),
    ("bsd-4-clause", 2, "advertising", "all advertising materials mentioning features or use of this software must display the "
                                       "following acknowledge?ment"),
    ("mit", 1, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                         "associated documentation files"),
    ("isc", 1, "hereby", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is "
                         "hereby granted"),
    ("zlib", 2, "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being "
                                  "the original software"),
    ("apache", 2, "licen", "you may not use this file except in compliance with the licen[sc]e"),
    ("apache", 3, "licen", "software distributed under the licen[sc]e is distributed on an as is basis"),
    ("patent-grant", 2, "licen", "royalty free irrevocable [except] [as] [stated] [in] [this] [section] patent licen[sc]e"),
    ("copyright-grant", 2, "licen", "royalty free irrevocable copyright licen[sc]e"),
    ("gpl", 1, "licen", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                        "public licen[sc]e"),
    ("lgpl", 1, "licen", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
                         "(lesser|library) general public licen[sc]e"),
    ("or-later", 2, "licen", "either version [0-9]+ of the licen[sc]e or at your option any later version"),
    ("verbatim-copies", 2, "licen", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document"),
    ("mpl", 1, "licen", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("unlicense", 1, "domain", "this is free and unencumbered software released into the public domain"),
    ("notice-retention", 2, "copyright", "the above copyright notice and this permission notice shall be included in all copies or "
                                         "substantial portions of the software"),
    ("warranty-disclaimer", 2, "warranties", "any express or implied warranties including but not limited to the implied warranties "
                                             "of merchantability"),
    ("warranty-disclaimer", 2, "warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("liability-disclaimer", 2, "liable", "in no event shall the authors or copyright holders be liable for any claim damages or "
                                          "other liability"),
    ("liability-disclaimer", 2, "liable", "in no event shall the copyright (holder|owner) or contributors be liable"),
    ("liability-disclaimer", 2, "liable", "in no event will the authors be held liable for any damages arising from the use of this "
                                          "software"),
)
NOTICE = "licen[sc]ed|released|distributed|available|published|provided under [the] [terms] [of] [the]"


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    priority: int  # 1 is strongest
    keyword: str  # alternatives separated by |; one of them stands in every match
    pattern: str
    base: bool = False


def compiled(pattern: str) -> str:
    """``[x]`` is an optional word; a word regex may itself hold brackets."""
    out = []
    for item in pattern.split(" "):
        optional = item.startswith("[") and item.endswith("]") and item.count("[") - item[1:-1].count("[") == 1 \
            and _balanced(item[1:-1])
        word = item[1:-1] if optional else item
        word = "[^ ]+" if word == ".+" else word
        out.append(f"(?: (?:{word}) )" + "?" * optional)
    return "".join(out)


def _balanced(inner: str) -> bool:
    depth = 0
    for c in inner:
        depth += (c == "[") - (c == "]")
        if depth < 0:
            return False
    return depth == 0


def _version(v: str) -> tuple[str, str]:
    first, _, rest = v.partition(" ")
    return f"[version|v|ver] v?{first}" + (f" {rest}" if rest else ""), v.replace(" ", ".")


def rules() -> list[Rule]:
    """Base phrases, then the expanded signatures from the most to the least specific."""
    found: list[tuple[str, int, str, str]] = []
    for label, names, keyword, versions in FAMILIES:
        for name in names:
            for v in versions:
                words, dotted = _version(v)
                found.append((f"{label}-{dotted}", 1, keyword, f"{NOTICE} {name} {words}"))
                found.append((f"{label}-{dotted}", 2, keyword, f"{name} {words}"))
            found.append((label, 2, keyword, f"{NOTICE} {name}"))
            found.append((label, 3, keyword, name))
        if versions:
            code = label.replace("-", " ")
            found += [(f"{label}-{v.replace(' ', '.')}", 1, "spdx", f"spdx licen[sc]e identifier {code} {v}")
                      for v in versions]
    for code, words in CLAUSES:
        for v in CLAUSE_VERSIONS:
            dotted = v.replace(" ", ".")
            found.append((f"cc-{code}-{dotted}", 1, "creative", f"creative commons {words} {v} [international|unported]"))
            found.append((f"cc-{code}-{dotted}", 2, "cc", f"cc {code.replace('-', ' ')} {v}"))
        found.append((f"cc-{code}", 2, "creative", f"creative commons {words}"))
        found.append((f"cc-{code}", 3, "cc", f"cc {code.replace('-', ' ')}"))
    found += SINGLE + BODIES
    base = [Rule(i, label, 0, phrase.split(" ")[-1] if "cc" not in phrase else "cc", phrase, True)
            for i, (phrase, label) in enumerate(BASE)]
    rest = sorted(found, key=lambda r: r[1])  # stable: strongest first, otherwise as written
    return base + [Rule(len(base) + i, *r) for i, r in enumerate(rest)]


def required(pattern: str) -> list[str]:
    """The literal beginnings of the words that every match of ``pattern`` holds."""
    return [re.match("[a-z0-9]*", item)[0] for item in pattern.split(" ") if not item.startswith("[") and "|" not in item]


def triggers() -> list[str]:
    """Strings one of which stands, in any case, in every text that a rule matches: "licen" where
    each match holds it, else the last required word that is a keyword of the rule."""
    found = set()
    for r in rules():
        words = required(r.pattern)
        named = [w for w in words if w in r.keyword.split("|")]
        found.add("licen" if any("licen" in w for w in words) else named[-1])
    return sorted(t for t in found if not any(o in t for o in found - {t}))
