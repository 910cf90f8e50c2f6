"""Secret scans: plain patterns, and structural confirmation of encoded keys and tokens."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import own_columns, read_spread

# fixed values: the base patterns and the least length of each
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "der", "ssh", "jwt")  # the order of kinds at one start

WORDS = ("passw", "secret", "token", "api")
B64 = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{32,}+(?:\r?\n|$))*+[A-Za-z0-9+/]{0,}+={0,2}")
B64_START = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}")
PLAIN_BREAK = re.compile(r"[\r\n]+")
# other ways to write a key: line ends escaped or followed by an indent, URL-safe letters, lines of 16 letters or more
ANY_BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\[nr])[\x20\t]*+")
_BEGIN = r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nrt]))"
FORM_START = re.compile(_BEGIN + r"[A-Za-z0-9+/_-]{16}")
FORM = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}+(?:{ANY_BREAK.pattern}[A-Za-z0-9+/_-]{{16,}}+)*+(?:{ANY_BREAK.pattern}[A-Za-z0-9+/_-]++)?={{0,2}}")
STANDARD = str.maketrans("-_", "+/")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}+")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(content start, content end) of the element whose tag is at ``at``."""
    if at + 2 > len(data):
        return None
    n = data[at + 1]
    start = at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or start + k > len(data):
            return None
        n = int.from_bytes(data[start : start + k], "big")
        start += k
    return (start, start + n) if start + n <= len(data) else None


def der_children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill [start, end) exactly."""
    out, at = [], start
    while at < end:
        got = der_length(data, at)
        if got is None or got[1] > end:
            return None
        out.append((data[at], *got))
        at = got[1]
    return out


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE whose nested lengths all agree and that reads as a key: a private key
    begins with a small version INTEGER, a public key or certificate with an algorithm."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    whole = der_length(data, 0)
    if whole is None or whole[1] != len(data):
        return False
    kids = der_children(data, *whole)
    if not kids or len(kids) < 2:
        return False
    for tag, a, b in kids:
        if tag & 0x20 and der_children(data, a, b) is None:
            return False
    tag, a, b = kids[0]
    if tag == 0x02 and b - a == 1 and data[a] <= 3:  # PKCS#1, PKCS#8, SEC 1
        return kids[1][0] in (0x02, 0x04, 0x30)
    if tag == 0x02 and b - a >= 32:  # a bare public key: modulus, exponent
        return [k[0] for k in kids] == [0x02, 0x02]
    inner = der_children(data, a, b) if tag == 0x30 else None
    return bool(inner) and inner[0][0] == 0x06 and kids[1][0] in (0x03, 0x04)


def is_ssh_key(data: bytes) -> bool:
    """The openssh private container, or length-prefixed fields that begin with a key type and fill it."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, names = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        names.append(data[at + 4 : at + 4 + n])
        at += 4 + n
        if at > len(data):
            return False
    return at == len(data) and len(names) >= 2 and names[0].startswith(SSH_NAMES)


def _json_object(part: str) -> dict | None:
    try:
        got = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def is_signed_token(text: str) -> bool:
    """Header and claims decode to JSON objects, and the header names its algorithm."""
    head, claims, _ = text.split(".")
    h = _json_object(head)
    return h is not None and isinstance(h.get("alg"), str) and _json_object(claims) is not None


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of tokens. A dotted word before one (config.auth_header.<token>) is no part of it: where a
    candidate fails, the next begins at its second part."""
    out, at = [], 0
    while m := DOTTED.search(text, at):
        if is_signed_token(m[0]):
            out.append(m.span())
            at = m.end()
        else:
            at = text.index(".", m.start()) + 1
    return out


def _decoded(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_ends(head: bytes) -> list[int]:
    """The length that the header of an element gives, or none."""
    if len(head) < 2 or head[0] != 0x30:
        return []
    k = head[1] & 0x7F if head[1] >= 0x80 else 0
    if head[1] == 0x80 or k > 4 or len(head) < 2 + k:
        return []
    return [2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])]


def _ssh_ends(body: str, i: int) -> list[int]:
    """Lengths at which a key that begins at body[i] can end, the longest first: those of whole fields, of one key only."""
    total = (len(body) - i) * 3 // 4

    def read(at: int, n: int) -> bytes:
        g = at // 3
        part = body[i + 4 * g : i + 4 * ((at + n + 2) // 3)]
        return (_decoded(part[: len(part) - (len(part) % 4 == 1)]) or b"")[at - 3 * g : at - 3 * g + n]

    def field(at: int) -> int:
        return at + 4 + int.from_bytes(read(at, 4), "big")

    if read(0, 15) == b"openssh-key-v1\0":
        at = field(field(field(15)))  # cipher, derivation, its options
        keys = int.from_bytes(read(at, 4), "big") if at + 4 <= total else 0
        at += 4
        for _ in range(keys + 1):  # public keys, and the private part
            if at >= total:
                return [total]
            at = field(at)
        return [at, total] if at < total else [total]  # a cut or odd container is all there is
    at, ends = 0, []
    while at + 4 <= total:
        end = field(at)
        if end > total or read(at + 4, 16).startswith(SSH_NAMES) != (at == 0):
            break
        at = end
        ends.append(at)
    return ends[:0:-1]  # at least two fields


def _confirmed(run: str, breaks: re.Pattern) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the keys in a run of lines: each fills some lines of it, from a line start to a line end."""
    cuts = [0, *[x for m in breaks.finditer(run) for x in m.span()], len(run)]
    lines = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b]
    body = "".join(run[a:b] for a, b in lines).rstrip("=").translate(STANDARD)
    size = [0]
    for a, b in lines:
        size.append(min(size[-1] + b - a, len(body)))
    place = {n: k for k, n in enumerate(size)}  # of a line that ends there
    out, i = [], 0
    while i < len(lines):
        at, after = lines[i][0], i + 1
        first = run[at : at + 4]
        if first[:1] == "M":
            ends = _der_ends(_decoded(body[size[i] : size[i] + 12]) or b"")
        elif first == "AAAA" or first == "b3Bl":
            ends = _ssh_ends(body, size[i])
        else:
            ends = ()
        for n in ends:
            k = place.get(size[i] + (4 * n + 2) // 3)
            if k is None or k <= i:
                continue
            data = _decoded(body[size[i] : size[k]])
            kind = data and ("der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None)
            if kind:
                out.append((kind, at, lines[k - 1][1]))
                after = k
                break
        i = after
    return out


def _written_keys(text: str) -> dict[tuple[str, int], int]:
    """(kind, start) and end of base64 keys, in plain lines and in the other ways to write one; the longest at each start."""
    found: dict[tuple[str, int], int] = {}

    def take(run: str, start: int, breaks: re.Pattern) -> None:
        for kind, a, b in _confirmed(run, breaks):
            found[kind, start + a] = max(start + b, found.get((kind, start + a), 0))

    at = 0
    while m := B64_START.search(text, at):
        run = B64.match(text, m.start())[0].rstrip("\r\n")
        at = m.start() + max(len(run), 32)
        take(run, m.start(), PLAIN_BREAK)
    at = 0
    while m := FORM_START.search(text, at):
        run = FORM.match(text, m.start())[0]
        at = m.start() + len(run)
        take(run, m.start(), ANY_BREAK)
    return found


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of KINDS."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "." in text:
        out += [("jwt", *span) for span in signed_tokens(text)]
    out += [(kind, a, b) for (kind, a), b in _written_keys(text).items()]
    for m in HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0:
            data = bytes.fromhex(m[0])
            kind = "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None
            if kind:
                out.append((kind, *m.span()))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per row of ``docs``; null texts count as empty."""
    src = own_columns(docs, id_col, text_col).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )

    def run(batches):
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], ["doc_id", "spans"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


MASK = "[secret]"


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span found, overlapping ones as one, replaced by MASK; no row goes."""
    kind = docs.schema[text_col].dataType.simpleString()

    @F.pandas_udf(kind)
    def masked(texts):
        return texts.map(lambda t: None if t is None else mask(t))

    return docs.select(*[masked(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def mask(text: str) -> str:
    out, at = [], 0
    for _, start, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The secrets of all documents; null texts are empty and have none."""
    found = scan_secrets(read_spread(spark, f"{sf_dir}/documents.parquet"))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )
