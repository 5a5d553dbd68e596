"""URL laws, version 1: one spelling for each page."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions.hashing import fnv32

#: Query keys that don't select a page; fixed values of the laws.
TRACKING = ["gclid", "gclsrc", "dclid", "gbraid", "wbraid", "srsltid", "fbclid", "igshid", "msclkid", "twclid", "ttclid", "li_fat_id", "yclid", "mc_cid", "mc_eid", "vero_id", "oly_anon_id", "oly_enc_id", "_ga", "_gl", "s_cid"]
SESSION = ["phpsessid", "sessionid", "session_id", "sess_id", "cfid", "cftoken", "zenid", "oscsid"]
PREFIXES = ["utm_", "aspsessionid"]

_STRIPPED = frozenset(TRACKING + SESSION)
_UNRESERVED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
_PATH = frozenset(_UNRESERVED + b"!$&'()*+,;=:@/")
_QUERY = _PATH | {ord("?")}
_URL = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S)
_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})|(.)", re.S)
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_LABEL = re.compile(r"[a-z0-9_\-]{1,63}")


def _spell(text: str, allowed: frozenset[int]) -> str:
    def one(m: re.Match) -> bytes:
        octet = int(m[1], 16) if m[1] else m[2][0]
        return bytes([octet]) if octet in (_UNRESERVED if m[1] else allowed) else b"%%%02X" % octet

    return _ESCAPE.sub(one, text.encode("utf-8", "surrogatepass")).decode("ascii")


def _host(raw: str) -> str | None:
    host = raw.lower().rstrip(".")
    if not host:
        return None
    if not re.fullmatch(r"[0-9.]+", host):
        if not host.isascii():
            import idna

            try:
                host = idna.encode(host, uts46=True).decode("ascii")
            except (idna.IDNAError, UnicodeError):
                return None
        if not all(_LABEL.fullmatch(p) for p in host.split(".")):
            return None
    return host if len(host) <= 253 and all(1 <= len(p) <= 63 for p in host.split(".")) else None


def _folded(path: str) -> str:
    """No . and .. segments; one of them at the end leaves the slash."""
    kept: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        if p in (".", ".."):
            if p == ".." and kept:
                kept.pop()
            if i == len(parts) - 1:
                kept.append("")
        else:
            kept.append(p)
    return "/" + "/".join(kept)


def _keeps(part: str) -> bool:
    key = part.partition("=")[0]
    if not _BAD_ESCAPE.search(key):
        key = unquote_to_bytes(key.replace("+", " ")).decode("utf-8", "replace")
    key = key.lower()
    return key not in _STRIPPED and not key.startswith(tuple(PREFIXES))


def canonical(raw: str | None) -> str | None:
    """The URL's one spelling, or None if it isn't fetchable."""
    if raw is None or re.search(r"[\x00-\x1f\x7f]", raw := raw.strip()) or not (m := _URL.fullmatch(raw)):
        return None
    scheme, authority, path, query, fragment = m[1].lower(), m[2], m[3], m[4], m[5]
    if scheme not in ("http", "https") or _BAD_ESCAPE.search(path) or _BAD_ESCAPE.search(fragment or ""):
        return None
    name, colon, port = authority.rpartition("@")[2].partition(":")
    if colon and port and not port.isdigit() or (host := _host(name)) is None:
        return None
    if port and port != {"http": "80", "https": "443"}[scheme]:
        host += ":" + port
    path = _spell(path or "/", _PATH)
    path = re.sub(r";jsessionid=[^/;?]*", "", path, flags=re.I)
    path = _folded(re.sub("/{2,}", "/", path))
    kept = "&".join(_spell(p, _QUERY) for p in (query or "").split("&") if p and _keeps(p))
    return f"{scheme}://{host}{path}" + (f"?{kept}" if kept else "")


@F.arrow_udf(StringType())
def canonicalize_url(urls: pa.Array) -> pa.Array:
    return pa.array([canonical(u) for u in urls.to_pylist()], pa.string())


#: Not to be worked out again where the plan refers to it twice.
canonicalize_url = canonicalize_url.asNondeterministic()


def host_of(canon: Column) -> Column:
    """Host without a numeric port."""
    return F.regexp_extract(canon, r"^[a-z]+://([^/:?]*)", 1)


def host_partition(canon: Column, parts: int) -> Column:
    return (fnv32(host_of(canon)) % parts).cast("int")


def kept_query(query: Column) -> Column:
    """Query string without stripped and empty parts, as a built-in expression for keys without escapes."""
    key = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    keep = lambda p: (p != "") & ~key(p).isin(*TRACKING, *SESSION) & ~key(p).startswith("utm_") & ~key(p).startswith("aspsessionid")
    return F.array_join(F.filter(F.split(query, "&"), keep), "&")
