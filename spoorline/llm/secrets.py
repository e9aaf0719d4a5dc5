"""Secret scans: three base patterns, plus spans confirmed by decoding their structure.

Besides the base kinds (a value after a key word, an access key id, a hex run), candidates in
base64 or hex are decoded and reported only if what they hold is well formed: a DER value
whose nested lengths add up (``der``), an OpenSSH key with its length-prefixed fields
(``ssh``), a signed token with a JSON header that names an algorithm (``token``), or a PEM
block around either (``pem``).

Null and empty texts give no spans. Positions are code points, the end is exclusive. Repeated
rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from spoorline.llm.common import map_rows

# fixed values: the base patterns
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KINDS = ("assign", "access", "hex", "token", "ssh", "der", "pem")

# the same matches, without the short runs that are dropped anyway: a run is as long as it can be
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
_ACCESS_LONG = re.compile(r"AKIA[A-Z0-9]{16,}")

# possessive, and only at the start of a run: a long run without a dot is read once
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{16,}+")
BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{4}){8,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?")
HEX_ANY = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
# a line end as it is or escaped, and what joins string literals in sources
_ESCAPED_END = re.compile(r"(?:\\+[rn])+")
_LITERALS = re.compile(r"""["']\s*[+.]?\s*["']""")
_HEADER = re.compile(r"[A-Za-z0-9-]+:")
# base64 over one line or more, in either alphabet
_WRAPPED = {
    False: re.compile(r"[A-Za-z0-9+/]{16,}+={0,2}(?:(?:(?:\\+[rn])+|\r?\n[ \t]*)[A-Za-z0-9+/]++={0,2})*+"),
    True: re.compile(r"[A-Za-z0-9_-]{16,}+={0,2}(?:(?:(?:\\+[rn])+|\r?\n[ \t]*)[A-Za-z0-9_-]++={0,2})*+"),
}
_PART = {False: re.compile(r"(?:\\+[rn])+|([A-Za-z0-9+/]+)(={0,2})"), True: re.compile(r"(?:\\+[rn])+|([A-Za-z0-9_-]+)(={0,2})")}
_KEY_START = re.compile(r"M|AAAA(?=[BCE][23])|b3BlbnNzaC1rZXktdjEA")
SSH_MAGIC = b"openssh-key-v1\x00"
SSH_NAMES = (b"ssh-rsa", b"ssh-ed25519", b"ssh-dss", b"ecdsa-sha2-")


def der_end(data: bytes, at: int = 0, stop: int | None = None, depth: int = 0) -> int | None:
    """Where the DER value at ``at`` ends, if its length and all nested lengths are consistent."""
    stop = len(data) if stop is None else stop
    if at + 2 > stop or depth > 16:
        return None
    tag, first, at = data[at], data[at + 1], at + 2
    if first < 0x80:
        length = first
    else:
        size = first & 0x7F
        if not 1 <= size <= 4 or at + size > stop or data[at] == 0:
            return None
        length, at = int.from_bytes(data[at : at + size], "big"), at + size
        if length < 0x80:
            return None
    end = at + length
    if end > stop:
        return None
    if tag & 0x20:
        while at < end:
            nxt = der_end(data, at, end, depth + 1)
            if nxt is None:
                return None
            at = nxt
        return end if at == end else None
    return end if tag in (1, 2, 3, 4, 5, 6, 12, 19, 22, 23, 24) or tag & 0xC0 == 0x80 else None


def is_der_key(data: bytes) -> bool:
    """A DER sequence over the whole data with an integer or a sequence first, as keys have."""
    return (
        len(data) >= 24
        and data[0] == 0x30
        and der_end(data) == len(data)
        and data[2 + (data[1] & 0x7F if data[1] & 0x80 else 0)] in (0x02, 0x30)
    )


def ssh_fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields that fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def is_ssh_key(data: bytes) -> bool:
    """A public key blob, or a private key container with cipher, kdf, options and keys."""
    if data.startswith(SSH_MAGIC):
        at = len(SSH_MAGIC)
        for _ in range(3):
            size = int.from_bytes(data[at : at + 4], "big")
            if at + 4 + size > len(data):
                return False
            at += 4 + size
        return 0 < int.from_bytes(data[at : at + 4], "big") < 1 << 16
    if len(data) < 15 or data[:3] != b"\0\0\0" or not data[4:].startswith(SSH_NAMES):
        return False
    fields = ssh_fields(data)
    return bool(fields) and len(fields) > 1


def unbase64(text: str, url: bool = False) -> bytes | None:
    try:
        padded = text + "=" * (-len(text) % 4)
        return base64.b64decode(padded, b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Three base64url parts; the header is a JSON object with an algorithm, the body JSON."""
    head, body, mark = text.split(".")
    try:
        header = json.loads(unbase64(head, True) or b"")
        claims = json.loads(unbase64(body, True) or b"")
    except (ValueError, RecursionError):
        return False
    return (
        isinstance(header, dict)
        and isinstance(header.get("alg"), str)
        and isinstance(claims, dict)
        and bool(unbase64(mark, True))
    )


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [
        (m.start(), m.end(), "assign")
        for m in ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= ASSIGN_MIN
    ]
    out += [(m.start(), m.end(), "access") for m in _ACCESS_LONG.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX_LONG.finditer(text)]
    return out


def is_pem_body(body: str) -> bool:
    """Base64 of a key, line ends escaped or not, or an encrypted one behind its headers."""
    lines = _LITERALS.sub("", _ESCAPED_END.sub("\n", body).replace("\\/", "/")).strip().split("\n")
    head = []
    while lines and (_HEADER.match(lines[0].strip()) or (head and lines[0][:1] in (" ", "\t") and lines[0].strip())):
        head.append(lines.pop(0).strip())
    data = unbase64("".join("".join(lines).split()))
    if not data:
        return False
    if any(h.startswith("Proc-Type:") and "ENCRYPTED" in h for h in head):
        return any(h.startswith("DEK-Info:") for h in head) and len(data) >= 24 and len(data) % 8 == 0
    return is_der_key(data) or is_ssh_key(data)


def der_size(data: bytes) -> int:
    """Bytes of the DER sequence that begins with ``data``, as its header says; 0 if none does."""
    if len(data) < 6 or data[0] != 0x30:
        return 0
    size = data[1] & 0x7F if data[1] & 0x80 else 0
    if size > 4:
        return 0
    return 2 + size + (int.from_bytes(data[2 : 2 + size], "big") if size else data[1])


def ssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH key at the start of ``data`` by its fields; 0 if none fits."""
    head = data[:32]
    private = head.startswith(SSH_MAGIC)
    if private:
        at, fields = len(SSH_MAGIC), 3
    else:  # as many numbers behind the name as its kind has
        at, fields = 0, next((n for x, n in zip(SSH_NAMES, (3, 2, 5, 3), strict=True) if head.startswith(x, 4)), 0)
    while fields:
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields -= 1
        if not fields and private:
            count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            for _ in range(count + 1 if 0 < count < 1 << 16 else 0):
                at += 4 + int.from_bytes(data[at : at + 4], "big")
                if at > len(data):
                    break
        if at > len(data):
            return 0
    return at


class _Decoded:
    """Bytes of base64 characters from a place on, decoded only where they are asked for."""

    def __init__(self, chars: str, at: int, url: bool):
        self.chars, self.at, self.url = chars, at, url
        self.size = (len(chars) - at) * 3 // 4

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        low, high = part.start or 0, self.size if part.stop is None else part.stop
        high = min(high, low + 64)  # names and lengths; fields are skipped
        if high <= low:
            return b""
        first = low // 3
        chars = self.chars[self.at + 4 * first : self.at + 4 * -(-high // 3)]
        return (unbase64(chars[: len(chars) - (len(chars) % 4 == 1)], self.url) or b"")[low - 3 * first : high - 3 * first]


def wrapped_spans(text: str, url: bool) -> list[tuple[int, int, str]]:
    """Keys in base64 that may begin within a run, be wrapped, or lack the padding."""
    out = []
    for m in _WRAPPED[url].finditer(text):
        if not _KEY_START.search(m[0]):
            continue
        lines: list[str] = []
        firsts: list[int] = []  # of each line: characters before it
        begins: list[int] = []  # and its place in the text
        ends: dict[int, int] = {}  # characters up to a line's end: the end in the text
        n = 0
        for part in _PART[url].finditer(text, m.start(), m.end()):
            if part[1]:
                lines.append(part[1])
                firsts.append(n)
                begins.append(part.start(1))
                n += len(part[1])
                ends[n] = part.end()
        chars = "".join(lines)
        done = 0
        for start in _KEY_START.finditer(chars):
            at = start.start()
            if at < done:
                continue
            if start[0] == "M":
                size = der_size(unbase64(chars[at : at + 8], url) or b"")
            else:
                size = ssh_size(_Decoded(chars, at, url))
            stop = at + -(-size * 4 // 3)
            data = unbase64(chars[at:stop], url) if size and stop in ends else None
            if data and (is_der_key(data) or is_ssh_key(data)):
                line = bisect_right(firsts, at) - 1
                out.append((begins[line] + at - firsts[line], ends[stop], "der" if start[0] == "M" else "ssh"))
                done = stop
    return out


def signed_tokens(text: str) -> list[tuple[int, int, str]]:
    """Signed tokens; behind a candidate that is none, the next begins after its first dot."""
    out, m = [], TOKEN.search(text)
    while m:
        good = is_signed_token(m[0])
        if good:
            out.append((m.start(), m.end(), "token"))
        m = TOKEN.search(text, m.end() if good else text.index(".", m.start()) + 1)
    return out


def structured_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates whose decoded content has the structure of a key or a signed token."""
    out = []
    if ".ey" in text or "eyJ" in text or "." in text:
        out += signed_tokens(text)
    for m in BASE64.finditer(text):
        data = unbase64(m[0])
        if data and is_ssh_key(data):
            out.append((m.start(), m.end(), "ssh"))
        elif data and is_der_key(data):
            out.append((m.start(), m.end(), "der"))
    for m in HEX_ANY.finditer(text):
        data = bytes.fromhex(m[0])
        if is_der_key(data) or is_ssh_key(data):
            out.append((m.start(), m.end(), "der"))
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if is_pem_body(m[2]):
                out.append((m.start(), m.end(), "pem"))
    known = set(out)
    return out + sorted({*wrapped_spans(text, False), *wrapped_spans(text, True)} - known)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans per document: key, counts of the base kinds, base spans and all spans as text."""

    def make():
        def work(rows):
            out = {k: [] for k in (key, "n_assign", "n_access", "n_hex", "base_spans", "spans")}
            for id_, body in rows:
                base = base_spans(body or "")
                more = structured_spans(body or "")
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                out[key].append(id_)
                out["base_spans"].append(joined(in_order(base)))
                out["spans"].append(joined(in_order(base + more)))
            return out

        return work

    schema = f"{key} bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string"
    return map_rows(docs, make, schema, [key, text])


def redact_text(text: str) -> str:
    """The text with every secret (values only, where a key word leads) replaced by its kind."""
    marks = []
    for start, end, kind in base_spans(text) + structured_spans(text):
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        marks.append((start, end, kind))
    out, at = [], 0
    for start, end, kind in sorted(marks, key=lambda m: (m[0], -m[1])):
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        out.append(f"<{kind}>")
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same columns; secrets in texts are replaced. Nulls stay null.

    Only texts that hold a candidate change; ``n_chars``, where there is one, follows the text.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cleaned(texts):
        return texts.map(lambda t: t if t is None else redact_text(t))

    out = docs.withColumn(text, cleaned(text))
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
