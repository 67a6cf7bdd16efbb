"""Base spans against the plain patterns, layers against secrets wrapped on purpose."""

import base64
import gzip
import random
import re
import zlib
from urllib.parse import quote

from tidemark.llm import secrets

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "password=Zx9kQ2mW7rT4vB1n"


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans():
    rng = random.Random(5)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "=", ": ", '"', "'", " ", "\n", "é", "ſecret", "AKIA",
             "ABCD1234", "deadbeef", "0123456789abcdef", "xyzXYZ", "/", "-", "token=password=", "%41", "\\u0041"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert secrets.scan(text) == brute(text)


def placed(text):
    base, spans = secrets.find(text)
    assert set(base) <= set(spans)
    return set(spans) - set(base)


def test_layers():
    b64 = base64.b64encode(KEY.encode()).decode()
    text = f"é see {b64} there"
    assert placed(text) == {(6, 0, 6 + len(b64.rstrip())), }
    escaped = quote(KEY, safe="").replace("password", "%70assword")
    text = f"go {escaped} on"
    assert (3, 0, 3 + len(escaped)) in placed(text)
    unicode_key = "".join(f"\\u{ord(c):04x}" for c in KEY)
    assert (2, 0, 2 + len(unicode_key)) in placed("a " + unicode_key)
    packed = base64.b64encode(gzip.compress(("x " + KEY).encode())).decode()
    assert any(s[0] == 4 and s[1] == 0 for s in placed("zip " + packed))
    nested = base64.b64encode(zlib.compress(quote(b64, safe="").encode())).decode()
    twice = base64.b64encode(nested.encode()).decode()
    assert any(s[0] == 2 and s[2] == 2 + len(twice) for s in placed("n " + twice))


def encoded(raw):
    return base64.b64encode(raw).decode()


def test_no_byte_hides_a_layer():
    packed = gzip.compress(random.Random(1).randbytes(300) + f" {KEY} ".encode())
    wrapped = "\n".join(encoded(packed)[i:i + 76] for i in range(0, len(encoded(packed)), 76))
    for inner in (encoded(f"\u00a0{KEY}".encode()), encoded(f"\ufeff{KEY}".encode()), encoded(f"caf\xe9 {KEY}".encode("latin-1")),
                  encoded(KEY.encode("utf-16")), encoded(b"\x1b\x0c" + KEY.encode()), wrapped, wrapped.replace("\n", "\r\n"),
                  "path/" + encoded(KEY.encode()), "a_path/" + encoded(packed), "Attachment\n" + wrapped + "\nEnd of it"):
        found = placed("see " + inner + " there")
        assert found and all(a >= 4 and k == 0 and b <= 4 + len(inner) for a, k, b in found), inner
    assert {s[1] for s in placed("%FF%70assword=" + KEY[9:])} == {0}
    assert {s[1] for s in placed("\\ud800\\u0070assword=" + KEY[9:])} == {0}


def test_long_streams_are_scanned_to_their_end():
    bomb = encoded(gzip.compress(b"z " * (2 * secrets.WINDOW) + f" {KEY} ".encode() + b"b" * 10))
    assert placed("b " + bomb) == {(2, 0, 2 + len(bomb))}
    edge = encoded(gzip.compress(b"z " * (secrets.WINDOW // 2 - 6) + f" {KEY} ".encode() + b"b" * 10))
    assert placed("b " + edge) == {(2, 0, 2 + len(edge))}
    deep = gzip.compress(KEY.encode())
    for _ in range(40):
        deep = gzip.compress(deep)
    assert placed("d " + encoded(deep)) == {(2, 0, 2 + len(encoded(deep)))}


def unwrapped(text):
    """All layers by the plain rule: every escape run of a line read, every part of a word read as base64 and unpacked."""
    out = []
    for line in text.split("\n"):
        plain = re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), line)
        plain = re.sub(r"(?:\\u[0-9A-Fa-f]{4})+", lambda m: bytes.fromhex(m[0].replace("\\u", "")).decode("utf-16-be", "replace"), plain)
        out += [plain] if plain != line else []
    for word in re.findall(r"[A-Za-z0-9+/]{16,}", text):
        for i in range(4):
            code = word[i:][:len(word[i:]) // 4 * 4 + (len(word[i:]) % 4 if len(word[i:]) % 4 > 1 else 0)]
            raw = base64.b64decode(code + "=" * (-len(code) % 4))
            out.append(raw.decode("utf-8", "replace"))
            for form in (31, 15):
                try:
                    out.append(zlib.decompress(raw, form).decode("utf-8", "replace"))
                except zlib.error:
                    pass
    return out


def brute_kinds(text, seen):
    if text in seen:
        return set()
    seen.add(text)
    return {(k, text[a:b]) for a, k, b in brute(text)}.union(*[brute_kinds(t, seen) for t in unwrapped(text)])


def test_nested_layers_against_plain_unwrapping():
    rng = random.Random(9)
    wraps = [lambda t: quote(t, safe=""), lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: encoded(t.encode()),
             lambda t: encoded(gzip.compress(t.encode(), mtime=0)), lambda t: encoded(zlib.compress(t.encode()))]
    for _ in range(150):
        inner = rng.choice([KEY, "AKIA" + "QZ7" * 6, "0123456789abcdef77", "plain words only", "token: " + "k" * 11])
        text = inner
        for _ in range(rng.randint(1, 4)):
            text = rng.choice(["", "x ", "say "]) + rng.choice(wraps)(text) + rng.choice(["", " end"])
        assert {s[1] for s in secrets.find(text)[1]} == {k for k, _ in brute_kinds(text, set())}, text


def test_frames(frame):
    docs = [(1, None), (2, ""), (3, f"say {KEY} now"), (3, f"say {KEY} now"), (None, "AKIA" + "Q" * 16), (4, "plain " * 4000)]
    rows = secrets.find_secrets(frame(docs)).collect()
    assert len(rows) == 6 and [len(r.base) for r in rows] == [0, 0, 1, 1, 1, 0]
    red = secrets.redact(frame(docs))
    assert red.schema == frame(docs).schema
    texts = [r.text for r in red.collect()]
    assert texts[:4] == [None, "", "say [SECRET] now", "say [SECRET] now"] and texts[5] == docs[5][1]
    assert secrets.find_secrets(frame([])).count() == 0 and secrets.redact(frame([])).count() == 0
