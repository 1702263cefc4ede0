"""Whole licence texts as they are published, with and without their titles, bullets and appendices.

The files of ``license_texts`` are those of Debian's /usr/share/common-licenses, unchanged.
"""

from __future__ import annotations

import re
from pathlib import Path

TEXTS = Path(__file__).parent / "license_texts"
#: File, licence id, and how many of its first lines that aren't blank are a title.
FILES = (
    ("Apache-2.0", "Apache-2.0", 3),
    ("Artistic", "Artistic-1.0", 1),
    ("CC0-1.0", "CC0-1.0", 2),
    ("GFDL-1.2", "GFDL-1.2", 2),
    ("GFDL-1.3", "GFDL-1.3", 2),
    ("GPL-1", "GPL-1.0", 2),
    ("GPL-2", "GPL-2.0", 2),
    ("GPL-3", "GPL-3.0", 2),
    ("LGPL-2", "LGPL-2.0", 2),
    ("LGPL-2.1", "LGPL-2.1", 2),
    ("LGPL-3", "LGPL-3.0", 2),
    ("MPL-1.1", "MPL-1.1", 3),
    ("MPL-2.0", "MPL-2.0", 2),
)
#: What follows this line tells how to apply the licence, and is often left out.
APPENDIX = re.compile(r"(?m)^[ \t]*(?:END OF TERMS AND CONDITIONS[ \t]*$|(?=ADDENDUM: How to use))")
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD License", "The BSD License", "New BSD License", "Modified BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD License", "The BSD License", "Simplified BSD License", "FreeBSD License"),
}
#: Whom a BSD text names: its disclaimer's two phrases and the name of clause three.
BSD_NAMES = (("THE REGENTS AND", "THE REGENTS OR", "the University"), ("THE COPYRIGHT HOLDERS AND", "THE COPYRIGHT HOLDER OR", "the copyright holder"), ("THE AUTHOR AND", "THE AUTHOR OR", "the author"))


def _untitled(text: str, lines: int) -> str:
    for _ in range(lines):
        text = text.lstrip("\n \t\f").partition("\n")[2]
    return text


def _titled(license_id: str, text: str) -> list[tuple[str, str]]:
    return [(license_id, text), *((license_id, f"{title}\n\n{text}") for title in TITLES[license_id])]


def _bsd() -> list[tuple[str, str]]:
    base, found = (TEXTS / "BSD").read_text(), []
    for both, either, name in BSD_NAMES:
        three = base.replace("THE REGENTS AND", both).replace("THE REGENTS OR", either).replace("the University nor", f"{name} nor")
        two = re.sub(r"(?ms)^3\. .*?\n\n", "\n", three)
        for license_id, text in (("BSD-3-Clause", three), ("BSD-2-Clause", two)):
            found += _titled(license_id, text) + _titled(license_id, re.sub(r"(?m)^\d\. ", "* ", text))
    return found


def registry(short: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    """(license id, text): the given texts, those of them that have titles with each title, and the whole licences."""
    found = list(short)
    for license_id, text in short:
        if "\n" in text:
            also = {text, text.replace("and/or distribute", "and distribute"), text.replace("this permission notice shall", "this permission notice (including the next paragraph) shall")}
            for one in sorted(also):
                found += _titled(license_id, one)
    for file, license_id, lines in FILES:
        whole = (TEXTS / file).read_text()
        terms = whole[: m.end()] if (m := APPENDIX.search(whole)) else whole
        forms = [t for text in (whole, terms) for t in (text, _untitled(text, lines))]
        # on one line, copyright statements in the middle of the text stay
        found += [(license_id, t) for form in forms for t in (form, " ".join(form.split()))]
    return list(dict.fromkeys(found + _bsd()))
