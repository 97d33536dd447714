"""Byte tables and word splitting for the text operators."""

from __future__ import annotations

#: A-Z in lower case, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Letters and digits of ASCII in lower case and all bytes of other characters; the rest is a space.
PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text."""
    return text.translate(PLAIN).split()


#: What bytes.split() leaves out, `\\x20\\x09-\\x0D`, is just what separates these words.
def spaced_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased."""
    return text.translate(LOWER).split()
