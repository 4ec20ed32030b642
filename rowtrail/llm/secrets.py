"""Secret scan with structural confirmation.

Three base patterns find candidate secrets by form. On top of them, runs of base64 or hexadecimal
digits are decoded and reported only if their bytes parse completely as a private key or a signed
token: nested DER lengths that fill their parents exactly, the length-prefixed fields of an OpenSSH
key, or a token whose header is JSON with a known algorithm and whose signature has that
algorithm's size.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rowtrail.llm.common import batches, texts, with_fields

# The three base patterns.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = ("passw", "secret", "token", "apikey", "api_key")

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "openssh_key", "rsa_key", "ec_key", "pkcs8_key", "encrypted_key")

JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*")
# The longest run over both alphabets, and those of the standard and of the URL-safe one inside it.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
OWN_BASE64 = (re.compile(r"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{40,}={0,2}"))
ANY_HEX = re.compile(r"[0-9A-Fa-f]{80,}")
# Armour; its line ends may be spelled \\n and \\r, and header lines may precede the digits.
_BREAK = r"(?:\s|\\[rn])"
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----{_BREAK}*((?:[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*{_BREAK}++)*)((?:[A-Za-z0-9+/=]|{_BREAK})++)-----END \1-----")
BREAKS = re.compile(rf"{_BREAK}+")
SEALED = re.compile(r"(?s)Proc-Type: *4,ENCRYPTED.*DEK-Info: *[A-Z0-9-]+,([0-9A-Fa-f]{16,32})(?![0-9A-Fa-f])")
# Lines of base64 that follow each other, and the first digits that a key in DER or OpenSSH form has.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
SSH_START = "b3BlbnNzaC1rZXktdjE"
# Bytes of a signature by algorithm; None: any size a key can have.
SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "none": 0}
SIGNED |= {f"{a}{n}": None for a in ("RS", "PS") for n in (256, 384, 512)}
MAX_DEPTH = 12
LONG = 20


def unbase64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, depth: int = 0) -> list[tuple[int, object]] | None:
    """The elements that fill ``data`` exactly, constructed ones parsed in turn; None if they do not."""
    found, at = [], 0
    while at < len(data):
        if depth > MAX_DEPTH or at + 2 > len(data) or data[at] & 31 == 31:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 128 or size >> (8 * (n - 1)) == 0:
                return None  # the shortest form is required
            at += n
        body = data[at : at + size]
        if len(body) != size:
            return None
        at += size
        inner = der(body, depth + 1) if tag & 32 else body
        if inner is None:
            return None
        found.append((tag, inner))
    return found


def key_kind(data: bytes) -> str | None:
    """The kind of private key that ``data`` is from its first to its last byte."""
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh_key" if openssh(data) else None
    if len(data) < 24 or data[0] != 48:
        return None
    top = der(data)
    if not top or len(top) != 1:
        return None
    parts = top[0][1]
    tags = [t for t, _ in parts]
    version = parts[0][1] if tags[:1] == [2] else None
    if version in (b"\0", b"\1") and len(tags) >= 9 and set(tags[:9]) == {2} and all(body for _, body in parts):
        return "rsa_key"
    if version == b"\1" and tags[1:2] == [4] and set(tags[2:]) <= {0xA0, 0xA1} and len(parts[1][1]) in (28, 32, 48, 66):
        return "ec_key"
    if version in (b"\0", b"\1") and tags[1:3] == [48, 4] and [t for t, _ in parts[1][1]][:1] == [6]:
        return "pkcs8_key"
    if tags == [48, 4] and [t for t, _ in parts[0][1]] == [6, 48] and len(parts[1][1]) % 8 == 0 and parts[1][1]:
        return "encrypted_key"
    return None


def openssh(data: bytes) -> bool:
    """Whether the length-prefixed fields of an OpenSSH private key fill ``data`` exactly."""
    at = len(b"openssh-key-v1\0")

    def number() -> int:
        nonlocal at
        value = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else -1
        at += 4
        return value

    def field() -> bool:
        nonlocal at
        size = number()
        if size < 0 or at + size > len(data):
            return False
        at += size
        return True

    if not all(field() for _ in range(3)):
        return False
    keys = number()
    return 1 <= keys <= 64 and all(field() for _ in range(keys)) and field() and at == len(data)


def signed_token(text: str) -> bool:
    """Whether ``text`` is header.payload.signature with JSON objects and a signature of the header's size."""
    parts = [unbase64(p) for p in text.split(".")]
    if len(parts) != 3 or None in parts:
        return False
    try:
        header, payload = json.loads(parts[0]), json.loads(parts[1])
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict):
        return False
    if not isinstance(header.get("alg"), str) or header["alg"] not in SIGNED:
        return False
    wanted = SIGNED[header["alg"]]
    return len(parts[2]) == wanted if wanted is not None else len(parts[2]) in (128, 256, 384, 512)


def sealed(headers: str, body: str) -> bool:
    """Whether the headers name a cipher and ``body`` decodes to whole blocks of it (as long as the salt)."""
    m, data = SEALED.search(headers), unbase64(body)
    return bool(m and data) and len(data) % (len(m[1]) // 2) == 0


def _der_size(start: str) -> int | None:
    """Bytes of the DER element whose first digits are ``start``, its own head included."""
    head = unbase64(start[:8])
    if not head or len(head) < 6 or head[0] != 48:
        return None
    n = head[1] & 127 if head[1] & 128 else 0
    return 2 + head[1] if not head[1] & 128 else 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else None


def _in_lines(text: str, found: list) -> None:
    """Spans of keys wrapped over lines of equal width, of which the last may be shorter."""
    for block in WRAPPED.finditer(text):
        lines, at = [], block.start()
        for piece in re.split(r"([ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*)", block.group()):
            if LINE.fullmatch(piece):
                lines.append((piece, at))
            at += len(piece)
        for i, (first, start) in enumerate(lines):
            size = _der_size(first) if first.startswith("M") else None
            if len(first) < 40 or size is None and not first.startswith(SSH_START):
                continue
            full = i + 1
            while full < len(lines) and len(lines[full][0]) == len(first):
                full += 1
            ends = {full} | ({full + 1} if full < len(lines) and len(lines[full][0]) < len(first) else set())
            if size is not None:
                ends |= {i + -(-size * 4 // (3 * len(first))), i + -(-(size + 2) // 3 * 4 // len(first))}
            for end in ends:
                own = lines[i:end]
                if len(own) < 2 or end > len(lines) or end > full + 1 or size is not None and not size * 4 <= 3 * (sum(len(x) for x, _ in own)) < size * 4 + 12:
                    continue
                if (data := unbase64("".join(x for x, _ in own))) and (kind := key_kind(data)):
                    found.append((kind, start, own[-1][1] + len(own[-1][0])))


def _in_run(run: str, at: int, found: list) -> None:
    """Spans inside one run without white space that starts at ``at``."""
    found += [("access", at + m.start(), at + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= 20]
    found += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= 24]
    if len(run) < 24:
        return
    found += [("jwt", at + m.start(), at + m.end()) for m in JWT.finditer(run) if signed_token(m.group())]
    for whole in BASE64.finditer(run):
        for start, end in {whole.span(), *(m.span() for own in OWN_BASE64 for m in own.finditer(run, *whole.span()))}:
            if (data := unbase64(run[start:end])) and (kind := key_kind(data)):
                found.append((kind, at + start, at + end))
    for m in ANY_HEX.finditer(run):
        if len(m.group()) % 2 == 0 and (kind := key_kind(bytes.fromhex(m.group()))):
            found.append((kind, at + m.start(), at + m.end()))


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end) in code points, by start and then by kind as listed."""
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    at = 0
    # Every other span lies in a run without white space, and only long runs can hold one.
    for run in text.split():
        if len(run) >= LONG:
            at = text.index(run, at)
            _in_run(run, at, found)
            at += len(run)
    armoured = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = BREAKS.sub("", m.group(3))
            if (data := unbase64(body)) and (kind := "encrypted_key" if sealed(m.group(2), body) else key_kind(data)):
                found.append((kind, m.start(), m.end()))
                armoured.append(m.span())
    wrapped: list[tuple[str, int, int]] = []
    _in_lines(text, wrapped)
    # The lines between armour are no second key.
    found += [s for s in wrapped if not any(a <= s[1] and s[2] <= b for a, b in armoured)]
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id and ``spans``, an array of (kind, start, end).

    Whole texts are scanned in one pass without a shuffle. A null or empty text has no spans; ids
    may be null or repeat and are handed through; other columns are ignored.
    """
    rows = texts(df, id_col, text_col)
    schema = with_fields(rows, spans=SPANS)

    def scan(batch: pa.RecordBatch) -> dict:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py())] for t in batch.column("text")]
        return {"id": batch.column("id"), "spans": spans}

    return rows.mapInArrow(batches(scan, schema), schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans and the text of all spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        *[c for c in found.columns if c != "spans"],
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_confirmed"),
    )
