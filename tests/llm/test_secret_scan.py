import base64
import bz2
import gzip
import lzma
import re
import urllib.parse
import zlib

import pytest
from llm_common import by_id

from semcorpus.llm import secret_scan
from semcorpus.llm.queries import QUERIES

PLAIN = "here token: abcdefgh1 ok"


def plain(text):
    assign = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def test_query_against_brute_force(spark, texts, sf):
    for r in QUERIES["op9_secret_scan"].run(spark, sf).collect():
        want = plain(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[0] == k for x in want) for k in secret_scan.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",")) | {""}


@pytest.mark.parametrize(
    "code, layer",
    [
        (base64.b64encode(PLAIN.encode()).decode(), "base64>"),
        (base64.b64encode(gzip.compress(PLAIN.encode())).decode(), "base64>compressed>"),
        (base64.urlsafe_b64encode(zlib.compress(zlib.compress(PLAIN.encode()))).decode(), "base64>compressed>compressed>"),
        ("".join(f"%{c:02X}" for c in PLAIN.encode()), "url>"),
        ("".join(f"\\u{ord(c):04x}" for c in PLAIN), "unicode>"),
        (urllib.parse.quote(base64.b64encode(base64.b64encode(PLAIN.encode())).decode()), "base64>base64>"),
        ("".join(f"%{ord(c):02x}" for c in "".join(f"\\u{ord(c):04x}" for c in PLAIN)), "url>unicode>"),
    ],
)
def test_nested_codes(code, layer):
    text = f"é see {code} end"
    found = [s for s in secret_scan.scan(text) if s[3]]
    assert ("assign", layer) in [(s[0], s[3]) for s in found]
    kind, a, b, _ = found[0]
    assert 6 <= a < b <= 6 + len(code)
    hidden = secret_scan.hidden(text, "#")
    assert hidden.startswith("é see") and hidden.endswith(" end") and not [s for s in secret_scan.scan(hidden) if s[0] == "assign" and "abcdefgh1" in hidden]


def test_places_of_percent_and_base64_are_exact():
    text = "x%20password%3Dabcdef%21"
    assert [text[a:b] for _, a, b, _ in secret_scan.scan(text)] == ["password%3Dabcdef"]
    code = base64.b64encode(b"0123456789 password=abcdef 0123456789").decode()
    (_, a, b, _), = secret_scan.scan(code)
    assert b"password=abcdef" in base64.b64decode(code[a // 4 * 4 : -(-b // 4) * 4])


def test_cycles_and_odd_codes_end():
    for text in ("%", "%2", "%zz", "%25%32%35", "%ff%fe", "\\ud800", "\\uZZZZ", "A" * 5000, "====", "\\U99999999 \\x41"):
        secret_scan.scan(text)


def test_a_dropped_match_still_covers_its_place():
    assert secret_scan.scan("token=token:abcdef") == []


def test_odd_rows(odd, none):
    found = by_id(secret_scan.scanned(odd))
    assert all(found[i][0]["secrets"] == [] for i in (1, 2, 3, 4, 5)) and len(found[6]) == 2
    assert [s["kind"] for s in found[None][0]["secrets"]] == ["assign"]
    clean = secret_scan.redacted(odd)
    assert clean.columns == odd.columns
    texts = by_id(clean)
    assert texts[1][0]["text"] is None and texts[2][0]["text"] == "" and "hunter" not in texts[None][0]["text"]
    assert secret_scan.scanned(none).count() == 0 and secret_scan.redacted(none).count() == 0


def test_redaction_counts_anew(spark):
    df = spark.createDataFrame([(1, "a password=hunter2000 b", 23), (2, "plain", 99)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r for r in secret_scan.redacted(df).collect()}
    assert rows[1]["text"] == "a [REDACTED] b" and rows[1]["n_chars"] == 14 and rows[2]["n_chars"] == 99


SECRET = "password=hunter2000"


def covered(text, hint="base64>"):
    """The stretches of the text in which an encoded assignment was found."""
    return [text[a:b] for kind, a, b, layer in secret_scan.scan(text) if kind == "assign" and hint in layer]


@pytest.mark.parametrize("odd_one", ["\u00a0", "\u3000", "\u200b", "\ufeff", "\f", "\0", b"\xff", b"\xe3\x80"])
def test_one_odd_character_hides_nothing(odd_one):
    odd_one = odd_one if isinstance(odd_one, bytes) else odd_one.encode()
    raw = b"some text " + odd_one + SECRET.encode() + odd_one + b"more text"
    code = base64.b64encode(raw).decode()
    (found,) = covered(f"see {code} end")
    at = code.index(found)
    assert SECRET.encode() in base64.b64decode(code[at // 4 * 4 : -(-(at + len(found)) // 4) * 4])
    assert covered(f"see {base64.b64encode(gzip.compress(raw * 50)).decode()} end", "compressed>")


@pytest.mark.parametrize("before", ["https://h.example/reset/", "GET /cb/", "sess-", "a_", "x", "ab", "abc", "q/"])
@pytest.mark.parametrize("padding", ["", "=", "== and so on", "/next/path"])
def test_base64_after_other_text(before, padding):
    code = base64.b64encode(f"user {SECRET}!".encode()).decode().rstrip("=")
    text = f"go {before}{code}{padding}"
    (found,) = covered(text)
    assert found in code and len(found) <= len(SECRET) * 8 // 6 + 2


@pytest.mark.parametrize("line", ["\n", "\r\n", "\n    "])
def test_wrapped_base64_is_one_run(line):
    code = base64.b64encode(f"{'filler ' * 7}{SECRET} and {'filler ' * 20}".encode()).decode()
    text = "see\n" + line.join(code[i : i + 76] for i in range(0, len(code), 76)) + "\nend"
    (found,) = covered(text)
    assert line in found and len(found.replace(line, "")) <= len(SECRET) * 8 // 6 + 2


LOG = "".join(f"{i * 7919 % 10007} line {i}\n" for i in range(400))


def test_windows_of_unpacked_data(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 20000)
    monkeypatch.setattr(secret_scan, "OVERLAP", 500)
    monkeypatch.setattr(secret_scan, "WRITTEN", 1000)
    for at in (10, 19995, 20000, 150000, 299990):
        log = ("a b " * 75000)[:at] + f" {SECRET} " + ("c d " * 75000)[at:]
        code = base64.b64encode(gzip.compress(log.encode())).decode()
        assert covered(f"see {code} end") == [code], at


def test_all_members_and_what_is_left_of_a_stream():
    parts = [gzip.compress(t.encode()) for t in (LOG, LOG + SECRET[:8], SECRET[8:] + LOG)]
    code = base64.b64encode(b"".join(parts)).decode()
    assert covered(f"see {code} end") == [code]
    code = base64.b64encode(gzip.compress(f"{SECRET} {LOG}".encode())[:-900]).decode()
    assert covered(f"see {code} end") == [code]
    damaged = bytearray(gzip.compress(f"{SECRET} {LOG}".encode()))
    damaged[-8:] = bytes(8)
    code = base64.b64encode(damaged).decode()
    assert covered(f"see {code} end") == [code]
    code = base64.b64encode(zlib.compress(f"{SECRET} {LOG}".encode())).decode().rstrip("=")
    assert covered(f"GET /cb/{code}")[0].endswith(code)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress])
def test_compressed_bytes_in_escapes(pack):
    raw = pack(f"{SECRET} {LOG}".encode())
    for code in (urllib.parse.quote(raw, safe=""), urllib.parse.quote_plus(raw), "".join(f"%{c:02x}" for c in raw)):
        assert any(code in x for x in covered(f"see {code} end", "url>compressed>"))
    for code in (repr(raw), "".join(f"\\x{c:02x}" for c in raw), '"' + "".join(f"\\u{c:04x}" for c in raw) + '"'):
        (found,) = covered(f"see {code}\nend", "compressed>")
        assert found.strip("'\"") in code and len(found) >= len(code) - 3


def test_data_that_unpacks_to_itself_ends():
    raw = b"x" * 100
    for _ in range(20):
        raw = gzip.compress(raw)
    secret_scan.scan(base64.b64encode(raw).decode() + " " + "x\\x9c" * 2000 + " " + "%78%9c" * 2000 + " " + "VVVV" * 2000)


INSIDE = "password=hunter2000abc"


def raw_deflate(data):
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


@pytest.mark.parametrize("pack", [bz2.compress, lzma.compress, raw_deflate, lambda d: bz2.compress(d) + bz2.compress(d[::-1] + d), lambda d: lzma.compress(gzip.compress(d))])
def test_every_compression(pack):
    code = base64.b64encode(pack((INSIDE + " and more text").encode())).decode()
    found = secret_scan.scan(f"see {code} there")
    assert any(k == "assign" and layer.endswith("compressed>") for k, _, _, layer in found)
    assert all(4 <= a and b <= 4 + len(code) for _, a, b, _ in found)
    # Cut off or damaged: what comes out before that is searched, where there is a header to begin from.
    if pack in (lzma.compress,):
        half = pack((INSIDE + " ").encode() + bytes(range(256)) * 2000)
        assert any(k == "assign" for k, *_ in secret_scan.scan(base64.b64encode(half[:-40]).decode()))


def test_long_chains_of_escapes():
    """Once a recursion error; linear in the text."""
    for head, link, end, n in (("%", "25", "41", 100_000), ("\\", "u005c", "u0041", 40_000), ("\\", "x5c", "x41", 40_000), ("%", "25", "zz", 100_000)):
        text = f"token=%41bcdefg {head}{link * n}{end} x password=hunter2000"
        found = secret_scan.scan(text)
        assert ("assign", text.index("password"), len(text), "") in found
    # Layers that alternate cost a layer each, but no stack.
    text = "%5cx25" + "5cx25" * 1500 + "41 password=hunter2000"
    assert any(k == "assign" for k, *_ in secret_scan.scan(text))


def test_chained_secret_and_its_place():
    inner = "".join(f"%{'25' * 7}{ord(c):02x}" for c in INSIDE)
    text = f"a {inner} b"
    assert ("assign", 2, 2 + len(inner), "url>url>") in secret_scan.scan(text)
    inner = "".join(f"\\{'u005c' * 5}u{ord(c):04x}" for c in INSIDE)
    text = f"é {inner} b"
    assert ("assign", 2, 2 + len(inner), "unicode>unicode>") in secret_scan.scan(text)


def test_nested_streams_across_windows(monkeypatch):
    """A stream within a stream whose data goes on beyond one window."""
    monkeypatch.setattr(secret_scan, "WINDOW", 4000)
    monkeypatch.setattr(secret_scan, "OVERLAP", 500)
    noise = "".join(chr(65 + (i * i) % 23) + " " for i in range(6000))
    inner = base64.b64encode(zlib.compress((noise[:300] + INSIDE).encode())).decode()
    text = base64.b64encode(gzip.compress((noise + inner + " " + noise).encode())).decode()
    assert any(k == "assign" and layer == "base64>compressed>base64>compressed>" for k, _, _, layer in secret_scan.scan(text))


def test_very_long_texts_end():
    for text in ("a" * 400_000, "QUJD" * 100_000, "%" * 200_000, "\\" * 200_000, "%41" * 100_000, "x=" * 100_000, "token=" * 50_000):
        assert isinstance(secret_scan.scan(text), list)


def test_query_hash(spark, sf, texts):
    import hashlib

    for row in QUERIES["op9_secret_scan"].run(spark, sf).collect():
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in secret_scan.secrets(texts[row["doc_id"]] or ""))
        assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(row["spans"].split(","))
