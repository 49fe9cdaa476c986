"""Secret scans with structural confirmation.

Three base patterns give spans by shape alone. Runs of base64 or hex are then decoded, and only those whose bytes
parse as a private key (nested DER lengths, OpenSSH's length-prefixed fields) or as a signed token's JSON parts are
reported too. Public keys parse as well, but are no secrets: they are kinds of their own that nothing redacts.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..shipping import ship
from .common import map_rows, table, whole_text

#: The kinds, in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "der-public", "ssh-public")
PUBLIC = ("der-public", "ssh-public")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
#: base64 of a key starts with one of these: DER's SEQUENCE of two or one length bytes (MI, MH..MA, MC..), SSH's
#: zero length bytes, OpenSSH's magic. Lines end as such, or written out in a string, and may be indented.
KEY64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))(?:M[A-Z]|AAAA|b3Bl)[A-Za-z0-9+/_-]{30,}")
NEXT64 = re.compile(r"={0,2}(?:\\r|\r)?(?:\\n|\n)[ \t]*([A-Za-z0-9+/_-]+)")
KEYHEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{38,}")
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-")
#: How many fields a public key of each algorithm has, its name among them.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-": 3}
OPENSSH = b"openssh-key-v1\0"


def der_length(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Content start and end of the DER value at ``at``; None if its length is malformed or passes ``end``."""
    if at + 2 > end:
        return None
    size, body = data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or body + n > end:
            return None
        size, body = int.from_bytes(data[body : body + n]), body + n
        if size < 0x80 or (n > 1 and size < 1 << 8 * (n - 1)):
            return None  # DER wants the shortest form
    return (body, body + size) if body + size <= end else None


def der_kind(data: bytes) -> str:
    """der, der-public or nothing, for a SEQUENCE that fills the data, whose members' lengths nest exactly, in the shape of a key.

    Shapes: integers only, led by a version (RSA, DSA), a version and an OCTET STRING (EC, PKCS#8); of public keys two
    integers, or an algorithm SEQUENCE and a BIT STRING.
    """
    outer = der_length(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or outer[1] != len(data):
        return ""
    tags, sizes, at = [], [], outer[0]
    while at < outer[1]:
        inner = der_length(data, at, outer[1])
        if not inner or (data[at] == 0x30 and not nests(data, *inner)):
            return ""
        tags.append(data[at])
        sizes.append(inner[1] - inner[0])
        at = inner[1]
    if len(tags) >= 2 and set(tags) == {0x02}:
        fits = max(sizes) >= 16 and min(sizes) >= 1
        return ("der-public" if len(tags) == 2 else "der") if fits else ""
    if tags[:2] == [0x02, 0x04] or tags[:3] == [0x02, 0x30, 0x04]:
        return "der" if sizes[0] == 1 and sizes[tags.index(0x04)] >= 16 else ""
    return "der-public" if tags == [0x30, 0x03] and sizes[1] >= 16 else ""


def nests(data: bytes, at: int, end: int) -> bool:
    while at < end:
        inner = der_length(data, at, end)
        if not inner:
            return False
        at = inner[1]
    return True


def fields_of(data: bytes, many: int | None = None) -> tuple[list[bytes], int] | None:
    """Big-endian length-prefixed fields from the data's start, ``many`` or all of it, and where they end; None if one is cut off."""
    fields, at = [], 0
    while len(fields) < many if many is not None else at < len(data):
        size = int.from_bytes(data[at : at + 4])
        if at + 4 > len(data) or at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def is_public_ssh(data: bytes) -> bool:
    """Fields that fill the data, led by an algorithm's name."""
    found = fields_of(data)
    return bool(found) and len(found[0]) >= 2 and found[0][0].startswith(SSH_NAMES)


def ssh_kind(data: bytes) -> str:
    """ssh for OpenSSH's private keys, ssh-public for one public key, or nothing.

    A private key is the magic, the names of cipher and key derivation, its options, the number of keys, as many public
    keys in fields of their own, and the encrypted or plain private part, to the end.
    """
    if not data.startswith(OPENSSH):
        return "ssh-public" if is_public_ssh(data) else ""
    head = fields_of(body := data[len(OPENSSH) :], 3)
    if not head or not head[0][0] or not head[0][1]:
        return ""
    keys = int.from_bytes(body[head[1] : head[1] + 4])
    rest = fields_of(body[head[1] + 4 :], keys + 1) if 1 <= keys <= 64 else None
    if not rest or head[1] + 4 + rest[1] != len(body):
        return ""
    return "ssh" if all(map(is_public_ssh, rest[0][:-1])) and len(rest[0][-1]) >= 16 else ""


def is_token(head: str, body: str, signature: str) -> bool:
    """A signed token: its first part decodes to a JSON object that names an algorithm, its second to a JSON object, its third to a signature."""
    try:
        header, claims = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (head, body))
        signed = base64.urlsafe_b64decode(signature + "=" * (-len(signature) % 4))
    except (ValueError, RecursionError):
        return False
    named = isinstance(header, dict) and isinstance(header.get("alg"), str) and header["alg"].lower() != "none"
    return named and isinstance(claims, dict) and len(signed) >= 8


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, each kind leftmost and non-overlapping."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def key_kind(raw: str) -> str:
    """der, ssh, their public kinds or nothing: what a run of base64 without its padding, in either alphabet, decodes to."""
    try:
        data = base64.b64decode(raw.replace("-", "+").replace("_", "/") + "=" * (-len(raw) % 4))
    except binascii.Error:
        return ""
    return der_kind(data) or ssh_kind(data)


class Run:
    """The base64 of a key that may start with a match, read line by line only as far as its lengths ask for.

    Lines below may belong to the key or be other text; they count as long as the lines before them have the first one's width.
    """

    def __init__(self, text: str, m: re.Match) -> None:
        self.text, self.width, self.raw, self.ends, self.sizes = text, len(m[0]), m[0], [m.end()], [len(m[0])]

    def reach(self, count: int) -> bool:
        """Whether there are ``count`` characters; takes in the lines up to there."""
        more, total, last = [], len(self.raw), self.sizes[-1] - (self.sizes[-2] if len(self.sizes) > 1 else 0)
        if count > total + len(self.text) - self.ends[-1]:
            return False  # more than the whole rest of the text
        while total < count and last == self.width and (n := NEXT64.match(self.text, self.ends[-1])):
            more.append(n[1])
            last = len(n[1])
            total += last
            self.ends.append(n.end())
            self.sizes.append(total)
        self.raw += "".join(more)
        return total >= count

    def data(self, start: int, end: int) -> bytes | None:
        """The decoded bytes from start to end; None where the run ends before."""
        if not self.reach(-(-4 * end // 3)):
            return None
        piece = self.raw[start // 3 * 4 : -(-4 * end // 3)].replace("-", "+").replace("_", "/")
        return base64.b64decode(piece + "=" * (-len(piece) % 4))[start % 3 :][: end - start]

    def after_fields(self, at: int, many: int) -> int | None:
        """Where so many length-prefixed fields end that start at a byte."""
        for _ in range(many):
            size = self.data(at, at + 4)
            if size is None:
                return None
            at += 4 + int.from_bytes(size)
        return at

    def needed(self) -> int | None:
        """Bytes of a key that starts like this, as its own lengths say: DER's outer one, or those of the SSH fields; None if this is no key's start."""
        head = self.data(0, 24)
        if head[:1] == b"\x30":
            size, at = head[1], 2
            if size >= 0x80:
                n = size & 0x7F
                if not 1 <= n <= 4:
                    return None
                size, at = int.from_bytes(head[2 : 2 + n]), 2 + n
            return at + size
        if head.startswith(OPENSSH):
            at = self.after_fields(len(OPENSSH), 3)
            keys = None if at is None else self.data(at, at + 4)
            return self.after_fields(at + 4, int.from_bytes(keys) + 1) if keys and 1 <= int.from_bytes(keys) <= 64 else None
        for name, many in SSH_FIELDS.items():
            if head[4:].startswith(name):
                return self.after_fields(0, many)
        return None


def key_at(text: str, m: re.Match) -> tuple[int, str] | None:
    """End and kind of the key that starts with a match: of the whole lines up to the length that it states, however long, if they parse as one."""
    run = Run(text, m)
    size = run.needed()
    want = None if size is None else -(-4 * size // 3)
    if want is None or not run.reach(want) or want not in run.sizes:
        return None
    kind = key_kind(run.raw[:want])
    end = stop = run.ends[run.sizes.index(want)]
    while kind and end < len(text) and text[end] == "=" and end - stop < 2:
        end += 1
    return (end, kind) if kind else None


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what decodes to a key or a signed token."""
    found = [(m.start(), "jwt", m.end()) for m in TOKEN.finditer(text) if is_token(m[1], m[2], m[3])]
    at = 0
    while m := KEY64.search(text, at):
        hit = key_at(text, m)
        if hit:
            found.append((m.start(), hit[1], hit[0]))
        at = hit[0] if hit else m.end()
    for m in KEYHEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := der_kind(bytes.fromhex(m[0]))):
            found.append((m.start(), kind, m.end()))
    return found


def in_order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every stretch covered by spans, but of public keys, replaced by one [SECRET]."""
    out, at, reach = [], 0, 0
    for start, kind, end in in_order(spans):
        if kind in PUBLIC:
            continue
        if start >= reach:
            out += [text[at:start], "[SECRET]"]
        at = reach = max(reach, end)
    return "".join([*out, text[at:]])


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans, redacted): all spans in order and the text without them.

    Null and empty texts have no spans and come back as the empty text. Repeated rows give repeated results,
    an empty table none; other columns are neither read nor returned. Offsets are code points, ends exclusive.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("spans", ArrayType(SPAN)), StructField("redacted", StringType())])

    def make():
        def each(key, text):
            spans = in_order(base_spans(text) + confirmed_spans(text))
            return key, [{"kind": k, "start": s, "end": e} for s, k, e in spans], redacted(text, spans) if spans else text

        return each

    return map_rows(docs.select(id_col, whole_text(text_col)), make, schema)


def redact(docs: DataFrame) -> DataFrame:
    """The documents, in all their columns, with secrets replaced in ``text``; null texts stay null."""

    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redacted(t, base_spans(t) + confirmed_spans(t)))

    return docs.withColumn("text", clean("text"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Spans of every document as the digest columns of the query."""
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
