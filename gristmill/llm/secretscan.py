"""Secret scans by multipart credential linking.

Strong patterns stand for themselves. Weak parts (identifiers, opaque strings, endpoints) are common in clean text; they
are reported only where complementary parts co-occur. A scope is a block of lines without a blank one between them. In a
scope two parts are in reach of each other if at most REACH code points lie between them; reach isn't handed on from
part to part. Interval joins of the kinds' ascending spans, one bisection for each part, find

* access ids and secrets (strong ones or any opaque run) in reach of each other: both are linked;
* weak identifiers and secrets (strong ones or opaque ones that look drawn) in reach of each other: both are linked;
* endpoints and assigned secrets in reach of each other: linked;
* service endpoints (no web address, or one with a port) and opaque secrets that look drawn in reach of each other: linked;
* any endpoint in reach of an identifier and a secret that are linked to such partners: linked as the third part;
* an endpoint that names a user and a password holds all parts itself.

Linked weak parts are reported. A web address beside a digest, or beside an opaque string, is neither.

An opaque run is one of 20 or more letters, digits and +/_=- that isn't part of an endpoint or a strong span. Beside an
access id that is enough: its complement is the filter. Beside weak identifiers and endpoints, which are common in clean
text, it must look drawn as well: letters and digits or capitals after a small letter, and ENTROPY bits a character.

Defined results: a null text is empty; rows that are alike are scanned each for itself; an empty table gives no rows;
texts may be as long as they like, the parts' number times its logarithm is what linking costs. Offsets are code points,
end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, slices, text_rows, texts

REACH = 160
ENTROPY = 3.0
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
Span = tuple[int, int]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENT = re.compile(r"""(?:user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"""(?:https?|ftp|ssh|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""", re.ASCII)
SERVICE = re.compile(r"(?!https?://)|https?://[^/?#]*:\d", re.ASCII)
LOGIN = re.compile(r"[a-z0-9]+://[^/?#\s:@]+:[^/?#\s@]+@", re.ASCII)
BLANK = re.compile(r"\n[ \t\r]*(?=\n)")

KEYWORDS = ("passw", "secret", "token", "api")
#: Bytes that may stand in each kind of run; a run that is long enough is looked for before any pattern is tried.
_HEX = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_OPAQUE = bytes(0x78 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") else 0x20 for b in range(256))


def base(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the strong patterns find, in order; kind indexes KINDS."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in raw.translate(_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_like(s: str) -> bool:
    letter, digit = any(c.isalpha() for c in s), any(c.isdigit() for c in s)
    camel = any(x.islower() and y.isupper() for x, y in zip(s, s[1:], strict=False))
    if not letter or not (digit or camel):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= ENTROPY


def join(left: list[Span], right: list[Span], cuts: list[int]) -> tuple[list[Span], list[Span]]:
    """Those of two kinds' spans that have one of the other kind in reach; each list is ascending and disjoint, and so is what is returned."""
    starts, ends = [a for a, _ in right], [b for _, b in right]
    met, edges = [], [0] * (len(right) + 1)
    for a, b in left:
        k = bisect_right(cuts, a)
        i = max(bisect_left(ends, a - REACH), bisect_left(starts, cuts[k - 1]) if k else 0)
        j = min(bisect_right(starts, b + REACH), bisect_left(starts, cuts[k]) if k < len(cuts) else len(starts))
        if i < j:
            met.append((a, b))
            edges[i] += 1
            edges[j] -= 1
    hit, depth = [], 0
    for span, e in zip(right, edges, strict=False):
        depth += e
        if depth:
            hit.append(span)
    return met, hit


def joined(left: dict[str, list[Span]], right: dict[str, list[Span]], cuts: list[int]) -> tuple[dict[str, set[Span]], dict[str, set[Span]]]:
    """join() of each kind on the left with each on the right."""
    a, b = {k: set() for k in left}, {k: set() for k in right}
    for x in left:
        for y in right:
            met, hit = join(left[x], right[y], cuts)
            a[x].update(met)
            b[y].update(hit)
    return a, b


def linked(kinds: dict[str, list[Span]], service: list[Span], drawn: list[Span], cuts: list[int]) -> dict[str, set[Span]]:
    """The weak spans that are linked, of each weak kind; drawn are the opaque ones that look it, cuts the ends of scopes."""
    sure = {k: kinds[k] for k in ("assign", "hex")}
    (access, beside_access), (ident, beside_ident) = (joined({k: kinds[k]}, {**sure, "opaque": o}, cuts) for k, o in (("access", kinds["opaque"]), ("ident", drawn)))
    who, what = access | ident, {k: beside_access[k] | beside_ident[k] for k in beside_access}
    where, more = join(service, drawn, cuts)
    named, _ = join(kinds["endpoint"], kinds["assign"], cuts)
    beside = [set(), set()]
    for side, found in zip(beside, (who, what), strict=True):
        side.update(*joined({"endpoint": kinds["endpoint"]}, {k: sorted(v) for k, v in found.items()}, cuts)[0].values())
    return {"ident": who["ident"], "opaque": what["opaque"] | set(more), "endpoint": {*where, *named} | beside[0] & beside[1]}


def weak(text: str, raw: bytes, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that are linked with their complement."""
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    logins = {(a, b) for a, b in ends if LOGIN.match(text, a, b)}
    taken = sorted([(a, b) for a, _, b in strong] + ends)
    opaque = [m.span() for m in OPAQUE.finditer(text)] if b"x" * 20 in raw.translate(_OPAQUE) else []
    opaque = apart(opaque, taken)
    drawn = [(a, b) for a, b in opaque if random_like(text[a:b])]
    found = {"endpoint": set()}
    if strong or opaque:
        kinds = {KINDS[i]: [(a, b) for a, k, b in strong if k == i] for i in range(3)}
        kinds |= {"ident": apart([m.span() for m in IDENT.finditer(text)], sorted((a, b) for a, _, b in strong)), "opaque": opaque, "endpoint": ends}
        found = linked(kinds, [(a, b) for a, b in ends if SERVICE.match(text, a, b)], drawn, [m.start() for m in BLANK.finditer(text)])
    found["endpoint"] |= logins
    return [(a, KINDS.index(k), b) for k, spans in found.items() for a, b in spans]


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of those taken; both ascending."""
    out, at, reach = [], 0, 0
    for a, b in spans:
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= a:
            out.append((a, b))
    return out


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    raw = text.encode()
    strong = base(text, raw)
    return strong, sorted(set(strong + weak(text, raw, strong)))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): counts and lists of kind:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [find(t) for t in texts(batch.column(1))]
            n = [pa.array([sum(k == i for _, k, _ in strong) for strong, _ in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.array([written(s) for s, _ in found], pa.string()), pa.array([written(s) for _, s in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    rows = text_rows(docs)
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def masked(text: str, mask: str) -> str:
    out, at = [], 0
    for a, _, b in find(text)[1]:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """All documents, with every span found replaced and n_chars, where there is one, counted anew."""
    at = docs.columns.index("text")
    prepare(docs.sparkSession)
    schema = T.StructType(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = [t and masked(t, mask) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
