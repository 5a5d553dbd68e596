"""The tokenizer in plain Python: the yardstick of the built-in expressions, and the body of the tokens() table function."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import regex

from quarry.functions.text import BASE64_LEAST, MAX_BYTES, MAX_NUMBER, REPEAT

_RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]+|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{Nd}\p{Mn}])+|�+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def admit(term: str) -> str:
    if re.fullmatch("[0-9]+", term):
        return "drop-long-number" if len(term) > MAX_NUMBER else "number"
    if len(term.encode()) > MAX_BYTES:
        return "drop-too-long"
    if re.search(r"(.)\1{%d}" % (REPEAT - 1), term):
        return "drop-repeat"
    digits = sum("0" <= c <= "9" for c in term)
    letters = sum(unicodedata.category(c)[0] == "L" for c in term)
    return "drop-base64" if len(term) >= BASE64_LEAST and digits and letters and digits + letters == len(term) else "word"


def classified(text: str) -> Iterator[tuple[str, str]]:
    """Term and class of each token, dropped ones too."""
    for m in _RUN.finditer(unicodedata.normalize("NFKC", text)):
        run = m[0]
        if run[0] == "�":
            yield "�", "drop-binary"
        elif not _CJK.match(run):
            term = "".join(c.lower() if len(c.lower()) == 1 else c.lower()[0] for c in run)
            yield term, admit(term)
        elif len(run) == 1:
            yield run, "cjk-unigram"
        else:
            yield from ((run[i : i + 2], "cjk-bigram") for i in range(len(run) - 1))
