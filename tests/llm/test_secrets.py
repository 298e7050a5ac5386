import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest

from cairn.llm import secrets as S

LINE = "password=hunter2hunter2 "
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_base_findings_match_the_rules():
    rng = random.Random(0)
    parts = ["password", "PassWd", "secret", "tokeN", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "abcdefg", "x.y-z/+=", "é", "ſ", "\n", "0" * 31, "f"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert S.base_findings(text) == plain(text), text


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


WRAPS = {
    "base64": b64,
    "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "gzip": lambda t: b64(gzip.compress(t.encode(), mtime=0)),
    "zlib": lambda t: b64(zlib.compress(t.encode())),
    "bz2": lambda t: b64(bz2.compress(t.encode())),
    "xz": lambda t: b64(lzma.compress(t.encode())),
    "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
}


@pytest.mark.parametrize("outer", WRAPS)
@pytest.mark.parametrize("inner", WRAPS)
def test_nested_layers_are_found_and_mapped(inner, outer):
    run = WRAPS[outer](WRAPS[inner](LINE))
    text = f"é before {run} after"
    base, more = S.scan_text(text)
    assert [b for b in base if b[1] != 2] == []
    found = [f for f in more if f.kind == 0]
    assert found, (inner, outer)
    for f in found:
        assert 9 <= f.start < f.end <= 9 + len(run)
    assert "hunter2" not in (S.redact_text(text) or "") and S.redact_text(text).endswith(" after")


def test_escape_spans_are_exact():
    text = "a%20b pass%77ord=hunter2hunter2 c"
    _, more = S.scan_text(text)
    assert [(f.start, f.end) for f in more] == [(6, 31)] and text[6:31] == "pass%77ord=hunter2hunter2"


def test_cycles_and_bombs_end():
    bomb = b64(gzip.compress(b"\x00" * 50_000_000))
    assert S.scan_text(f"x {bomb} y")[1] == []
    fixpoint = "%25" * 2000 + "41"
    S.scan_text(fixpoint)
    assert S.scan_text(None) == S.scan_text("") == ([], [])


def test_operators(spark):
    rows = [(1, "token: abcdefgh1 and " + "0a" * 20, "x"), (2, None, None), (3, "", "y"), (1, "token: abcdefgh1 and " + "0a" * 20, "x"), (4, "x" * 300_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = S.scan(df).collect()
    want = "assign:0:16,hex:21:61"
    assert [(r["n_assign"], r["n_access"], r["n_hex"], r["base"]) for r in out] == [(1, 0, 1, want), (0, 0, 0, ""), (0, 0, 0, ""), (1, 0, 1, want), (0, 0, 0, "")]
    assert hashlib.sha256(out[1]["base"].encode()).hexdigest().startswith("e3b0c442")
    cut = S.redact(df).collect()
    assert [r["text"] for r in cut][:4] == ["[ASSIGN] and [HEX]", None, "", "[ASSIGN] and [HEX]"] and cut[0]["spans"] == "x"
    assert S.scan(df.limit(0)).collect() == S.redact(df.limit(0)).collect() == []


def covered(run):
    text = f"é before {run} after"
    _, more = S.scan_text(text)
    return any(f.kind == 0 and 9 <= f.start < f.end <= 9 + len(run) for f in more) and "hunter2" not in S.redact_text(text)


PACKERS = {"gzip": lambda b: gzip.compress(b, mtime=0), "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress}


@pytest.mark.parametrize("name", PACKERS)
def test_whole_layers_of_compressed_data(name):
    pack, rng = PACKERS[name], random.Random(1)
    for _ in range(30):
        noise = "".join(chr(rng.randint(32, 126)) for _ in range(rng.randint(20, 150)))
        data = pack((noise + " " + LINE + noise).encode())
        assert covered(base64.urlsafe_b64encode(data).decode())
        assert covered(base64.encodebytes(data).decode().strip())
        lines = b64(data)
        assert covered("\r\n".join(lines[i : i + 64] for i in range(0, len(lines), 64)))
        assert covered(urllib.parse.quote(data)) and covered(urllib.parse.quote_plus(data))
        assert covered("".join(f"\\u{b:04x}" for b in data)) and covered("".join(f"\\x{b:02x}" for b in data))
        assert covered(repr(data)[2:-1])
    if name != "zlib":
        assert covered(b64(pack(b"first ") + pack(b"second ") + pack(LINE.encode())))


def test_secrets_across_lines_and_behind_long_content():
    wrapped = base64.encodebytes(("x" * 50 + " " + LINE + "y" * 200).encode()).decode().strip()
    assert covered(wrapped)
    assert covered(b64(bz2.compress(b"\0" * 40_000_000 + LINE.encode())))
    assert covered(b64(pack_binary()))


def pack_binary():
    return gzip.compress(bytes(range(128, 256)) * 4 + b" " + LINE.encode(), mtime=0)
