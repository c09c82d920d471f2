"""Secret scans with structural confirmation.

Three base kinds come from patterns alone (fixed values below). Further kinds are reported only where the decoded
bytes have the structure of a key or token:

* jwt, jwe: a part of a dotted run decodes, from its start or from a place inside it (a token may be glued to what is
  before it), to a JSON object that names an algorithm; the next part is a JSON object too, or, of five, the header
  names the encryption. JSON is read as strict UTF-8, of any length and with blanks.
* pem: a private key block whose body decodes to nested DER lengths that add up, to the length-prefixed fields of an
  OpenSSH key, or, where its headers name a cipher, to whole cipher blocks; also such a block inside a base64 run.
* der, sshkey: such a key inside a base64 run (either alphabet, also wrapped over lines) or, for DER, a hex run. The
  lengths are read where they stand, so a key is found from any start in a run (each place that such a key can begin
  with is tried) and its end is known.

Spans are in code points, end exclusive. One pass over each text, no shuffle; work is linear in the text, since runs
and marks are met once, a key is judged by a bounded number of headers, and a part of a token is decoded four times. Null and empty texts have no secrets;
very long texts are one row; repeated rows are kept; an empty table gives an empty table; further columns pass
through, those with the names of new ones are replaced.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

#: The base kinds in their listed order, then the confirmed ones.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "sshkey", "jwe")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
#: How an object begins in base64: an opening brace, then a quote or white space.
HEADER = re.compile(r"(?=e(?:y[A-DI-L]|w[k-r0-3]))")
#: What JSON has not: control characters, and bytes that are no UTF-8 (as surrogates).
NO_JSON = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff]")
#: A mark, a string or another value of JSON, after white space.
TOKEN = re.compile(r"""[ \t\r\n]*+(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null)""")
MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY)-----")
BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{60,76}(?:\r?\n[A-Za-z0-9+/_-]{60,76})*\r?\n[A-Za-z0-9+/_-]+")
ANY_HEX = re.compile(r"[0-9a-fA-F]{60,}")
OPENSSH = b"openssh-key-v1\x00"
#: How a DER sequence of 30 bytes or more, an OpenSSH key and a PEM block begin in base64; a DER sequence in hex.
DER_START, SSH_START, PEM_START, HEX_START = re.compile(r"M(?=[B-I])"), "b3BlbnNzaC1rZXktdjEA", "LS0tLS1CRUdJTi", re.compile(r"30(?=[2-8][0-9a-fA-F]|1[eEfF])")
#: Elements of a key at most: a private RSA key has ten.
ELEMENTS = 12
LEAST_KEY = 30


def unbase64(raw: str) -> bytes | None:
    raw = raw.rstrip("=").replace("-", "+").replace("_", "/")
    raw = raw[: len(raw) - (len(raw) % 4 == 1)]
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


Bytes = Callable[[int, int], bytes]


def base64_bytes(run: str, start: int) -> Bytes:
    """Reads bytes from..to of what stands in base64 from a place of a run, without decoding what is not asked for."""

    def read(a: int, b: int) -> bytes:
        first, last = start + a // 3 * 4, start + -(-b // 3) * 4
        part = unbase64(run[first:last]) or b""
        return part[a % 3 : a % 3 + b - a]

    return read


def hex_bytes(run: str, start: int) -> Bytes:
    return lambda a, b: bytes.fromhex(run[start + 2 * a : start + 2 * b]) if start + 2 * b <= len(run) else b""


def der_element(read: Bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, where the content starts, where it ends) of the DER element at a byte."""
    head = read(at, at + 2)
    if len(head) < 2:
        return None
    if head[1] < 0x80:
        return head[0], at + 2, at + 2 + head[1]
    k = head[1] & 0x7F
    size = read(at + 2, at + 2 + k) if 1 <= k <= 4 else b""
    if len(size) < k or not size:
        return None
    return head[0], at + 2 + k, at + 2 + k + int.from_bytes(size)


def der_key_end(read: Bytes, size: int) -> int | None:
    """Where the private key ends that begins at byte 0, if one does within `size` bytes.

    A SEQUENCE whose elements' lengths add up to its own: either an INTEGER of at most 4 bytes (a version) and, within
    ELEMENTS elements, two more INTEGERs or an OCTET STRING; or an encrypted key, a SEQUENCE that begins with an
    OBJECT IDENTIFIER and an OCTET STRING after it.
    """
    outer = der_element(read, 0)
    if not outer or outer[0] != 0x30 or outer[2] > size or outer[2] - outer[1] < LEAST_KEY:
        return None
    at, tags, first = outer[1], [], None
    while at < outer[2] and len(tags) < ELEMENTS:
        inner = der_element(read, at)
        if not inner or inner[2] > outer[2]:
            return None
        if not tags:
            first = inner
            if not (inner[0] == 0x02 and 1 <= inner[2] - inner[1] <= 4) and inner[0] != 0x30:
                return None
        tags.append(inner[0])
        at = inner[2]
    if at != outer[2]:
        return None
    if tags[0] == 0x02:
        fits = len(tags) >= 2 and (0x04 in tags[1:3] or (len(tags) >= 3 and tags[1] == tags[2] == 0x02))
    else:
        fits = tags == [0x30, 0x04] and read(first[1], first[1] + 1) == b"\x06"
    return outer[2] if fits else None


def openssh_end(read: Bytes, size: int) -> int | None:
    """Where the OpenSSH key ends: the magic, cipher, kdf and its options as length-prefixed fields, a key count, as many public keys and one private part."""
    if read(0, len(OPENSSH)) != OPENSSH:
        return None
    at, left = len(OPENSSH), 3
    keys = None
    while left or keys is None:
        head = read(at, at + 4)
        if len(head) < 4:
            return None
        if not left:
            keys, at = int.from_bytes(head), at + 4
            if not 1 <= keys <= 16:
                return None
            left = keys + 1
            continue
        at, left = at + 4 + int.from_bytes(head), left - 1
        if at > size:
            return None
    return at


def keys_in_base64(run: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the keys in a base64 run, from the left, not overlapping."""
    out, end = [], 0
    starts = [(m.start(), 5) for m in DER_START.finditer(run)]
    blocks = [m.start() for m in re.finditer(PEM_START, run)]
    if blocks or SSH_START in run:
        starts = sorted(starts + [(m.start(), 6) for m in re.finditer(SSH_START, run)] + [(at, 4) for at in blocks])
    following = dict(zip(blocks, [*blocks[1:], len(run)], strict=False))
    for start, kind in starts:
        if start < end:
            continue
        if kind == 4:
            stop = encoded_block_end(run[start : following[start]])
        else:
            stop = (der_key_end if kind == 5 else openssh_end)(base64_bytes(run, start), (len(run) - start) * 3 // 4)
        if stop is not None:
            end = min(len(run), start + -(-stop * 4 // 3))
            out.append((start, kind, end))
    return out


def encoded_block_end(run: str) -> int | None:
    """How many bytes of what a base64 run stands for are a private key block with its marks (and white space, if nothing else follows)."""
    text = (unbase64(run) or b"").decode("latin-1")
    for start, _, stop in pem_blocks(text):
        return (stop if text[stop:].strip() else len(text)) if start == 0 else None
    return None


def keys_in_hex(run: str) -> list[tuple[int, int, int]]:
    out, end = [], 0
    for m in HEX_START.finditer(run):
        if m.start() >= end:
            stop = der_key_end(hex_bytes(run, m.start()), (len(run) - m.start()) // 2)
            if stop is not None:
                end = m.start() + 2 * stop
                out.append((m.start(), 5, end))
    return out


def _json(part: str) -> dict | None:
    """The JSON object that a part decodes to, in strict UTF-8."""
    try:
        value = json.loads((unbase64(part) or b"").decode("utf-8"))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _object_end(text: str, at: int, seen: set[int]) -> int | None:
    """Where the JSON object ends that begins at a place of text, None if none does. seen: gets the place of every
    brace that opened an object on the way; from those nothing reaches further than from here."""
    inside: list[str] = []
    due = "value"
    while True:
        m = TOKEN.match(text, at)
        if not m or (due == "value" and not inside and m[1] != "{"):
            return None
        at, mark = m.end(), m[1]
        if mark in ("{", "["):
            if due not in ("value", "value or end"):
                return None
            if mark == "{":
                seen.add(at - 1)
            inside.append(mark)
            due = "key or end" if mark == "{" else "value or end"
            continue
        if mark in ("}", "]"):
            fits = due == "next" or due == ("key or end" if mark == "}" else "value or end")
            if not fits or inside.pop() != ("{" if mark == "}" else "["):
                return None
            if not inside:
                return at
            due = "next"
        elif mark == ",":
            if due != "next":
                return None
            due = "key" if inside[-1] == "{" else "value"
        elif mark == ":":
            if due != "colon":
                return None
            due = "value"
        elif due in ("key", "key or end"):
            if m[2] is None:
                return None
            due = "colon"
        elif due in ("value", "value or end"):
            due = "next"
        else:
            return None


def objects_to_the_end(part: str) -> Iterator[tuple[int, dict]]:
    """(start, object) for every place of a part from which the rest decodes to one JSON object, from the left.

    The part is decoded once for each of the four alignments; places before the last byte that JSON cannot hold are
    out at once, and so is an object inside another that does not reach the end.
    """
    ways: dict[int, list] = {}
    for m in HEADER.finditer(part):
        start, way = m.start(), m.start() % 4
        if way not in ways:
            raw = unbase64(part[way:]) or b""
            text = raw.decode("utf-8", "surrogateescape")
            rest = text[max((x.end() for x in NO_JSON.finditer(text)), default=0) :]
            first = len(raw) - len(rest.encode("utf-8"))
            ways[way] = [raw, rest.rstrip(" \t\r\n"), first, 0, set()]  # and how far rest has been counted, and the braces that are out
        raw, rest, done, at, seen = ways[way]
        byte = (start - way) // 4 * 3
        if byte < done or not rest.endswith("}"):
            continue
        at += len(raw[done:byte].decode("utf-8", "replace"))
        ways[way][2:4] = [byte, at]
        if at in seen or _object_end(rest, at, seen) != len(rest):
            continue
        try:
            value = json.loads(rest[at:])
        except (ValueError, RecursionError):
            continue
        yield start, value


def tokens_in(run: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the signed and the encrypted tokens in a run of base64url characters and dots."""
    out, parts, places, at = [], run.split("."), [], 0
    for p in parts:
        places.append(at)
        at += len(p) + 1
    k = 0
    while k + 2 < len(parts):
        step = 1
        for begin, header in objects_to_the_end(parts[k]):
            if not isinstance(header.get("alg"), str):
                continue
            start = places[k] + begin
            if isinstance(header.get("enc"), str) and k + 4 < len(parts) and all(parts[k + 2 : k + 5]):
                out.append((start, 7, places[k + 4] + len(parts[k + 4])))
                step = 5
            elif _json(parts[k + 1]) is not None:
                out.append((start, 3, places[k + 2] + len(parts[k + 2])))
                step = 3
            break
        k += step
    return out


def pem_blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of private key blocks: a mark of a beginning, and the next mark is its end."""
    out, begin = [], None
    for m in MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
            continue
        if begin is not None and begin[2] == m[2]:
            body = text[begin.end() : m.start()]
            if BODY.fullmatch(body) and is_key_body(body):
                out.append((begin.start(), 4, m.end()))
        begin = None
    return out


def is_key_body(body: str) -> bool:
    lines = body.splitlines()
    raw = unbase64("".join("".join(x for x in lines if ":" not in x).split())) or b""
    if any(x.startswith("DEK-Info:") for x in lines):
        return len(raw) >= 48 and len(raw) % 8 == 0
    read = lambda a, b: raw[a:b]
    return len(raw) in (der_key_end(read, len(raw)), openssh_end(read, len(raw)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what decodes to a key or a token."""
    out = []
    if HEADER.search(text):
        for m in DOTTED.finditer(text):
            if m[0].count(".") > 1 and HEADER.search(m[0]):
                out += [(m.start() + a, kind, m.start() + b) for a, kind, b in tokens_in(m[0])]
    if "PRIVATE KEY-----" in text:
        out += pem_blocks(text)
    found, k = sorted(out), 0

    def free(a: int, b: int) -> bool:
        """Whether a..b lies outside what has been found; asked from left to right."""
        nonlocal k
        while k < len(found) and found[k][2] <= a:
            k += 1
        return k == len(found) or found[k][0] >= b

    whole = []
    for m in WRAPPED.finditer(text):
        flat = "".join(m[0].split())
        whole += [(m.start(), kind, m.end()) for a, kind, b in keys_in_base64(flat)[:1] if a == 0 and b == len(flat) and free(m.start(), m.end())]
    found, k = sorted(found + whole), 0
    out += whole
    for m in BASE64.finditer(text):
        if free(m.start(), m.end()):
            for a, kind, b in keys_in_base64(m[0]):
                end = m.start() + b
                while b == len(m[0]) and text[end : end + 1] == "=" and end - m.start() - b < 2:
                    end += 1
                out.append((m.start() + a, kind, end))
    for m in ANY_HEX.finditer(text):
        out += [(m.start() + a, kind, m.start() + b) for a, kind, b in keys_in_hex(m[0])]
    return sorted(set(out))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each stretch of overlapping spans replaced by <SECRET>."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "<SECRET>"]
        elif b > at and not out:
            out.append("<SECRET>")
        at = max(at, b)
    return "".join(out) + text[at:]


def _scan(texts: list) -> list:
    rows = []
    for t in texts:
        base = base_spans(t or "")
        every = sorted({*base, *confirmed_spans(t or "")})
        kinds = [k for _, k, _ in base]
        rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(told(base).encode()).hexdigest(), told(every), redact(t, every) if every else t))
    return [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 6


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with, in place of the text: counts of the base kinds, base_sha256, spans (all, told as kind:start:end) and redacted."""
    return map_texts(docs, _scan, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string", text)


def op7_secrets(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("redacted")
