"""Pre-tokens of byte-level BPE: the public pattern, with a faster equivalent for texts of Latin letters."""

from __future__ import annotations

import re
import unicodedata

import regex

#: The pattern of the public tokenizer files; fixed.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The fast form lists its letters, numbers and spaces one by one and serves texts below this code point.
PLAIN_END = 0x250


def _listed(keep) -> str:
    return "".join(f"\\u{i:04x}" for i in range(PLAIN_END) if keep(chr(i)))


_L, _N = (_listed(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
_S = _listed(regex.compile(r"\s").match)
_plain = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_other = re.compile(f"[^\\x00-\\u{PLAIN_END - 1:04x}]").search
_any = regex.compile(PATTERN).findall


def split(text: str) -> list[str]:
    return _any(text) if _other(text) else _plain(text)
