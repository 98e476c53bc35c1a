"""Terms of whole texts: maximal runs of given bytes, A-Z lower-cased and nothing else."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes looked at at once. A longer text is cut where no term is.
CHUNK = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lower-case letters, digits and every byte of a code point beyond 0x7F, as UTF-8 keeps those bytes for these.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9a-zA-Z\x80-\xff]")


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of those of some CHUNK bytes."""
    at = 0
    while text and at < len(text):
        cut = _BETWEEN.search(text, at + CHUNK)
        end = cut.start() if cut else len(text)
        yield TERM.findall(text[at:end].translate(_LOWER))
        at = end
