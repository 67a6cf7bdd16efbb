"""Secret scan by a decoding worklist: every layer that a text can be unwrapped to is scanned like the text itself."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, texts_of

KINDS = ("assign", "access", "hex")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
HEX_MARKS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+")
ESCAPED_LINE = re.compile(r"[^\n]*(?:%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})[^\n]*")
#: A run of base64, which may go on over lines that hold nothing else.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+(?==*[ \t]*(?:\r?\n|$)))*)={0,2}")
LONG_RUN = re.compile(rb"[A-Za-z0-9+/_-]{16}")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
STANDARD = str.maketrans("-_", "+/", " \t\r\n=")
#: Bytes of an unpacked stream that are scanned at once, and how far two such windows overlap.
WINDOW, OVERLAP = 1 << 22, 1 << 16
#: Characters of a slice of documents whose texts a worker holds at once.
CHARS = 1 << 19
SPANS = "array<struct<kind:string,start:int,end:int>>"
SCHEMA = f"doc_id long, base {SPANS}, spans {SPANS}"

Span = tuple[int, int, int]


def scan(text: str) -> list[Span]:
    """(start, kind, end) of the secrets that stand in a text as they are, in order."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"x" * 16 in text.encode("utf-8", "replace").translate(HEX_MARKS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def unescaped(run: str) -> str:
    """What one run of URL, Unicode or byte escapes stands for; what is no text in it becomes U+FFFD."""
    if run[0] == "%":
        return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")
    if run[1] == "u":
        return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "replace")
    return bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "replace")


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The parts of a compressed stream, in bounded memory; what follows its end or a fault is left out."""
    unpack = zlib.decompressobj(47)
    for data in chunks:
        while not unpack.eof:
            try:
                part = unpack.decompress(data, WINDOW)
            except zlib.error:
                return
            if part:
                yield part
            data = unpack.unconsumed_tail
            if not data and len(part) < WINDOW:
                break


def windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    tail = b""
    for chunk in chunks:
        yield tail + chunk
        tail = (tail + chunk)[-OVERLAP:]


def contents(raw: bytes) -> Iterator[bytes]:
    """The bytes themselves, then window by window what any compressed stream in them unpacks to, however deep."""
    yield raw
    for m in PACKED.finditer(raw):
        stream, seen = inflated(iter([raw[m.start():]])), set()
        first = next(stream, None)
        while first is not None and PACKED.match(first) and (key := digest(first)) not in seen:
            seen.add(key)  # a stream that unpacks to itself ends here
            stream = inflated(chain([first], stream))
            first = next(stream, None)
        if first is not None:
            yield from windows(chain([first], stream))


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def promising(raw: bytes) -> bool:
    """Whether anything in there may be a secret or a further layer."""
    low = raw.lower()
    return b"%" in raw or b"\\" in raw or b"AKIA" in raw or any(n.encode() in low for n in NAMES) \
        or LONG_RUN.search(raw) is not None


def opened(run: str) -> Iterator[str]:
    """The texts in a run of base64, whichever of its characters is the first of the code.

    Bytes that are no UTF-8 don't hide the others, and neither do the zeros of wide characters.
    """
    body = run.translate(STANDARD)
    for shift in range(4):
        code = body[shift:len(body) - ((len(body) - shift) % 4 == 1)]
        for raw in contents(base64.b64decode(code + "=" * (-len(code) % 4))):
            for plain in (raw, raw.replace(b"\0", b"")) if b"\0" in raw else (raw,):
                if promising(plain):
                    yield plain.decode("utf-8", "replace")


def layers(text: str) -> Iterator[tuple[str, list[int] | None, list[int] | None, int, int]]:
    """What is wrapped in `text`: (layer, begins, ends, start, end); begins and ends map each character if known."""
    if "%" in text or "\\" in text:
        for line in ESCAPED_LINE.finditer(text):
            out, begins, ends, at, hit = [], [], [], line.start(), False
            for m in ESCAPE.finditer(text, line.start(), line.end()):
                plain, hit = unescaped(m[0]), True
                out += text[at:m.start()], plain
                begins += [*range(at, m.start()), *[m.start()] * len(plain)]
                ends += [*range(at + 1, m.start() + 1), *[m.end()] * len(plain)]
                at = m.end()
            if hit:
                out.append(text[at:line.end()])
                begins += range(at, line.end())
                ends += range(at + 1, line.end() + 1)
                yield "".join(out), begins, ends, line.start(), line.end()
    if any(len(w) >= 16 and (m := BASE64.search(w)) for w in text.split()):
        for m in BASE64.finditer(text):
            for inner in opened(m[0]):
                yield inner, None, None, m.start(), m.end()


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Secrets of the text itself, and those of all layers mapped to it (base ones included).

    The worklist holds the layers that are being unwrapped, each with a map to the text, so memory is bounded by how
    deep they are nested. A layer met before at its place is not opened again, so loops end; each layer is scanned with
    the base patterns.
    """
    base = scan(text)
    spans, seen = set(base), {(digest(text.encode("utf-8", "replace")), 0)}
    work: list = [(text, None, None, 0, len(text), layers(text))]
    while work:
        layer, begins, ends, start, end, inside = work[-1]
        found = next(inside, None)
        if found is None:
            work.pop()
            continue
        inner, ib, ie, a, b = found

        def placed(a: int, b: int, outer=(layer is text, begins, ends, start, end)) -> tuple[int, int]:
            whole, begins, ends, start, end = outer
            return (begins[a], ends[b - 1]) if begins is not None else (a, b) if whole else (start, end)

        known = begins is not None or layer is text
        if ib is not None and known:
            ib, ie = [placed(x, x + 1)[0] for x in ib], [placed(x - 1, x)[1] for x in ie]
        else:
            ib = ie = None
        a, b = placed(a, b)
        key = (digest(inner.encode("utf-8", "replace")), a)
        if key in seen:
            continue
        seen.add(key)
        spans.update((ib[x], kind, ie[y - 1]) if ib is not None else (a, kind, b) for x, kind, y in scan(inner))
        work.append((inner, ib, ie, a, b, layers(inner)))
    return base, sorted(spans)


def _column(found: list[list[Span]]) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found], pa.list_(kind))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, all spans (both by start, kind, end).

    Spans count code points, ends exclusive; what lies in a decoded layer is placed at the characters it came from, or
    at the whole run if those can't be told. Every layer is scanned, whatever its size; long unpacked streams go through
    the scanner in overlapping windows. Null texts count as empty; repeated rows and null ids are kept; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _column([f[0] for f in found]), _column([f[1] for f in found])],
                ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a >= at:
                out += text[at:a], mark
            at = b
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each secret of `text` replaced by `mark` and n_chars brought in line; null texts stay null."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, CHARS) for b in batches):
            texts = [t if t is None else redacted(t, find(t)[1], mark) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                lengths = [n if t is None else len(t) for t, n in zip(texts, batch.column("n_chars").to_pylist())]
                new["n_chars"] = pa.array(lengths, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], names)

    return docs.mapInArrow(run, schema)
