"""Licences inside longer texts, at layouts that are neither one line, one paragraph nor the whole text."""

import textwrap

import pytest

from tidemark.llm.license_scan import TEMPLATES, Scanner

PROSE = "\n".join(f"Then number{i} walked to house{i} and spoke of weather{i} for a while." for i in range(400))
LONG = [(name, t) for name, ts in TEMPLATES.items() for t in ts if len(t.split()) > 60]


@pytest.mark.parametrize(("name", "template"), LONG)
def test_paragraphs_between_prose(name, template):
    half = len(template.split()) // 2
    words = template.split()
    body = "\n\n".join(textwrap.fill(" ".join(x), 60) for x in (words[:half], words[half:]))
    assert set(Scanner(TEMPLATES, 0.9).scan(f"{PROSE}\n\n{body}\n\n{PROSE}")) == {name}


def test_inside_a_line():
    s = Scanner(TEMPLATES, 0.9)
    assert set(s.scan("See the notes at the end. Released under the MIT License. More is to be found in the handbook of the house.")) == {"MIT"}
    assert set(s.scan("A long line says that it is licensed under the GNU General Public License, version 3 and goes on for many more words.")) == {"GPL-3.0"}
    assert not s.scan("A long line says that it is licensed under the GNU General Public License, version 1 and goes on for many more words.")
