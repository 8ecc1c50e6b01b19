"""Secret scan: pattern matches, and candidates confirmed by their structure.

Candidates in base64 (lines may be indented, their breaks written as escapes, and text may follow
a key) or hex are decoded, and reported only if what they hold parses: DER key
encodings whose nested lengths fill one another exactly (PKCS#1, PKCS#8 with the key inside, encrypted PKCS#8, SEC1, DSA), the binary
envelope of OpenSSH keys, through public keys and private section to its end, and signed tokens whose
header is JSON with an ``alg`` and whose payload is JSON too.

Edge cases: a null or empty text has no spans; positions are code points, ends exclusive; repeated
rows are scanned one by one; long texts are scanned whole; ties in start go by the order of KINDS.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

from pyspark.sql import DataFrame

#: Base kinds first, in the order in which they are listed, then the confirmed ones.
KINDS = ("assign", "access", "hex", "der", "openssh", "token")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
# A line break, real or written as an escape (also escaped again), with indentation.
BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*")
# A DER sequence starts with byte 0x30: "M" in base64, "30" in hex.
B64_START = r"(?:M|b3BlbnNzaC1rZXktdjE)"
B64_KEY = re.compile(rf"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt])|(?<=-----)){B64_START}(?:[A-Za-z0-9+/_-]|{BREAK.pattern}(?=[A-Za-z0-9+/=])){{30,}}={{0,2}}")
B64_LINE, PADDING = re.compile(B64_START), re.compile("={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]737368)(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]+)(?![A-Za-z0-9_-])")

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
# Object identifiers of password-based encryption begin so (PKCS#5 and PKCS#12).
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
RSA = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"))
ELLIPTIC = bytes.fromhex("2a8648ce3d0201")
#: DSA and Diffie-Hellman.
WHOLE_NUMBER = (bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301"))
#: X25519, X448, Ed25519, Ed448.
EDWARDS = tuple(bytes.fromhex(f"2b65{i}") for i in ("6e", "6f", "70", "71"))
# Keys of many primes have ten parts; names of ciphers and key types, and object identifiers, are short.
MOST_PARTS, MOST_NAME, MOST_OID = 16, 64, 32
MAGIC = b"openssh-key-v1\0"
# Authenticated ciphers append their tag to the private section.
MOST_TAG = 16


def _unbase64(s: str) -> bytes | None:
    s = re.sub(r"\s", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Bytes:
    """Bytes that are read piece by piece."""

    def __init__(self, b: bytes):
        self.b, self.size = b, len(b)

    def read(self, at: int, n: int) -> bytes:
        return self.b[at : at + n]


class Base64:
    """What a base64 string encodes from a character on; only what is read is decoded."""

    def __init__(self, chars: str, start: int):
        self.chars, self.start, self.size = chars, start, (len(chars) - start) * 3 // 4

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        s = self.chars[self.start + at // 3 * 4 : self.start + -(-(at + n) // 3) * 4]
        return base64.b64decode(s + "A" * (-len(s) % 4))[at % 3 : at % 3 + n]


def _parts(src: Bytes | Base64, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, beginning and end of the value of each element, if they fill [at, end) exactly; no key has over MOST_PARTS."""
    out = []
    while at < end:
        head = src.read(at, 6)
        if len(head) < 2 or len(out) == MOST_PARTS:
            return None
        size = head[1] & 0x7F if head[1] & 0x80 else 0
        if head[1] & 0x80 and (not 1 <= size <= 4 or len(head) < 2 + size):
            return None
        n = int.from_bytes(head[2 : 2 + size], "big") if size else head[1]
        at += 2 + size
        if at + n > end:
            return None
        out.append((head[0], at, at + n))
        at += n
    return out


def _is_inner_key(src: Bytes | Base64, oid: bytes, at: int, end: int) -> bool:
    """The key inside of PKCS#8, in the form that its algorithm has."""
    outer = _parts(src, at, end)
    if not outer or len(outer) != 1:
        return False
    tag, at, end = outer[0]
    if oid in EDWARDS:
        return tag == OCTETS and end - at in (32, 56, 57)
    if oid in WHOLE_NUMBER:
        return tag == INTEGER
    if oid in RSA or oid == ELLIPTIC:
        inner = _parts(src, at, end) if tag == SEQUENCE else None
        tags = [t for t, *_ in inner or []]
        return tags[:9] == [INTEGER] * 9 if oid in RSA else tags[:2] == [INTEGER, OCTETS]
    return True


def der_size(src: Bytes | Base64) -> int:
    """How many bytes the private key at the start has, in PKCS#1, PKCS#8 or SEC1 form, with lengths that agree at
    each depth; 0 if there is none. Reads headers only, so a false start costs the same however long it claims to be."""
    head = src.read(0, 6)
    if len(head) < 6 or head[0] != SEQUENCE:
        return 0
    size = head[1] & 0x7F if head[1] & 0x80 else 0
    if head[1] & 0x80 and not 1 <= size <= 4:
        return 0
    end = 2 + size + (int.from_bytes(head[2 : 2 + size], "big") if size else head[1])
    parts = _parts(src, 2 + size, end) if end <= src.size else None
    if not parts or len(parts) < 2:
        return 0
    tags, length = [t for t, *_ in parts], parts[1][2] - parts[1][1]

    def oid(of: int) -> bytes:
        inner = _parts(src, *parts[of][1:])
        return src.read(inner[0][1], min(MOST_OID, inner[0][2] - inner[0][1])) if inner and inner[0][0] == OID else b""

    if tags == [SEQUENCE, OCTETS]:
        ok = oid(0).startswith(PASSWORD_BASED) and length >= 16
    elif tags[0] != INTEGER or src.read(parts[0][1], parts[0][2] - parts[0][1] if parts[0][2] - parts[0][1] == 1 else 0) not in (b"\0", b"\1"):
        ok = False
    elif tags[1] == SEQUENCE and len(parts) > 2 and tags[2] == OCTETS:
        kind = oid(1)
        ok = bool(kind) and _is_inner_key(src, kind, *parts[2][1:])
    else:
        ok = tags[:9] == [INTEGER] * 9 or (tags == [INTEGER] * 6 and length >= 64) or (tags[1] == OCTETS and length in (20, 24, 28, 32, 48, 64, 66))
    return end if ok else 0


def is_der_key(b: bytes | None) -> bool:
    """A private key that fills b."""
    return bool(b) and der_size(Bytes(b)) == len(b)


def openssh_size(src: Bytes | Base64) -> int:
    """How many bytes the OpenSSH key at the start has, 0 if none: the magic; cipher, key
    derivation and its options; a count of keys; so many public keys, each beginning with its type; and the
    private section, which begins with two equal numbers where it isn't encrypted."""
    if src.read(0, len(MAGIC)) != MAGIC:
        return 0
    at = len(MAGIC)

    def block() -> tuple[int, int]:
        """Beginning and length of the next block; length -1 if it is cut short."""
        nonlocal at
        n = int.from_bytes(src.read(at, 4), "big")
        if at + 4 + n > src.size:
            return at, -1
        at += 4 + n
        return at - n, n

    (name, n), (_, derivation), (_, options) = block(), block(), block()
    cipher = src.read(name, n) if 1 <= n <= MOST_NAME else b""
    if not cipher or not cipher.isascii() or derivation < 1 or options < 0 or at + 4 > src.size:
        return 0
    keys, at = int.from_bytes(src.read(at, 4), "big"), at + 4
    if not 1 <= keys <= 16:
        return 0
    for _ in range(keys):
        start, n = block()
        kind = int.from_bytes(src.read(start, 4), "big") if n >= 4 else 0
        if not 4 <= kind <= MOST_NAME or kind + 4 > n or not src.read(start + 4, kind).isascii():
            return 0
    start, n = block()
    if n < 16 or (cipher == b"none" and src.read(start, 4) != src.read(start + 4, 4)):
        return 0
    return at + (min(MOST_TAG, src.size - at) if b"gcm" in cipher or b"poly1305" in cipher else 0)


def is_openssh_key(b: bytes | None) -> bool:
    """An OpenSSH key that fills b."""
    return bool(b) and openssh_size(Bytes(b)) == len(b)


def _json(s: str) -> object:
    b = _unbase64(s)
    try:
        return json.loads(b) if b else None
    except (ValueError, RecursionError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    """The header is a JSON object with an algorithm, and the payload one too unless the header says that it's packed."""
    head = _json(header)
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
        return False
    return isinstance(_json(payload), dict) or bool({"enc", "zip", "b64"} & head.keys())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _base64_keys(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Keys in a run of base64 lines: any line may begin one, and text may follow it. The lines are put together once."""
    cuts = [start, *chain.from_iterable(m.span() for m in BREAK.finditer(text, start, end)), end]
    lines = [text[s:e].rstrip("=") for s, e in zip(cuts[::2], cuts[1::2], strict=True)]
    chars = "".join(lines).replace("-", "+").replace("_", "/")
    offsets, after = [0, *accumulate(map(len, lines))], start
    for i, s in enumerate(cuts[::2]):
        if s < after or not B64_LINE.match(text, s, s + len(lines[i])):
            continue
        src = Base64(chars, offsets[i])
        size, kind = der_size(src), "der"
        if not size:
            size, kind = openssh_size(src), "openssh"
        if size:
            # Where the key's last character stands.
            last = offsets[i] + -(-size * 4 // 3) - 1
            line = bisect_right(offsets, last) - 1
            stop = cuts[2 * line] + last - offsets[line] + 1
            after = stop + len(PADDING.match(text, stop)[0])
            yield s, after, kind


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for m in B64_KEY.finditer(text):
        found += _base64_keys(text, *m.span())
    for m in HEX_KEY.finditer(text):
        b = bytes.fromhex(m[0])
        if is_der_key(b) or is_openssh_key(b):
            found.append((m.start(), m.end(), "der" if b[0] == SEQUENCE else "openssh"))
    if "ey" in text:
        found += [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    return found


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those that the structure confirms."""
    return base_spans(text), confirmed_spans(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts by base kind, digest of the base spans, and all spans as text."""
    from tidemark.llm.common import map_texts

    def scan(texts: list[str]) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")}
        for t in texts:
            base, more = scan_text(t)
            for k in KINDS[:3]:
                out[f"n_{k}"].append(sum(x[2] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(base + more))
            out["n_confirmed"].append(len(more))
        return out

    return map_texts(docs, text_col, [id_col], scan, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
