"""op13 against the plain patterns, and the encodings on keys made here."""

import base64
import hashlib
import json
import random
import re

import pytest

from vigil.llm import queries
from vigil.llm import secret_scan as S

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 12, "access": 18, "hex": 16}


def brute(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in p.finditer(text or "")
                if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]]
    return [x for *_, x in sorted(out)]


def der(tag, data):
    n = len(data)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + data


def integer(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RND = random.Random(5)
RSA = der(0x30, integer(0) + b"".join(integer(RND.getrandbits(b) | 1) for b in (1024, 17, 1023, 512, 512, 512, 511, 511)))
OID = der(6, bytes([42, 134, 72, 134, 247, 13, 1, 1, 1]))
PKCS8 = der(0x30, integer(0) + der(0x30, OID + der(5, b"")) + der(4, RSA))
EC = der(0x30, integer(1) + der(4, RND.randbytes(32)) + der(0xA0, der(6, bytes([42, 134, 72, 206, 61, 3, 1, 7]))))
LOCKED = der(0x30, der(0x30, OID + der(0x30, b"")) + der(4, RND.randbytes(64)))


def field(x):
    return len(x).to_bytes(4, "big") + x


SSH = (b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"public")
       + field(b"\1\2\3\4" * 2 + RND.randbytes(40)))


def b64(x, url=False):
    return (base64.urlsafe_b64encode(x).rstrip(b"=") if url else base64.b64encode(x)).decode()


def jwt(alg="HS256", size=32, payload=None):
    parts = [json.dumps({"alg": alg, "typ": "JWT"}).encode(), json.dumps(payload or {"sub": "x"}).encode(), RND.randbytes(size)]
    return ".".join(b64(x, url=True) for x in parts)


@pytest.mark.parametrize("data,kind", [(RSA, "rsa_key"), (PKCS8, "pkcs8_key"), (EC, "ec_key"), (LOCKED, "encrypted_key"),
                                       (SSH, "openssh_key")])
def test_keys_are_confirmed_and_damaged_ones_not(data, kind):
    assert S.key_of(data) == kind
    for wrong in (data[:-1], data + b"\0", data[:1] + bytes([data[1] ^ 1]) + data[2:], b""):
        assert S.key_of(wrong) is None
    assert S.token_key(b64(data).encode()) == kind
    assert S.token_key(data.hex().encode()) == kind
    pem = f"-----BEGIN PRIVATE KEY-----\n{b64(data)}\n-----END PRIVATE KEY-----\n".encode()
    assert S.token_key(base64.b64encode(pem)) == kind
    assert S.token_key(b64(RND.randbytes(len(data))).encode()) is None


def test_signed_tokens():
    assert S.signed_token(jwt().encode()) and S.signed_token(jwt("ES256", 64).encode())
    assert not S.signed_token(jwt("HS256", 31).encode())  # not as long as its algorithm makes it
    assert not S.signed_token(jwt("ES256", 63).encode())
    head, body, sign = jwt().split(".")
    assert not S.signed_token(f"{head}.{body}".encode())
    assert not S.signed_token(f"{body}.{head}.{sign}".encode())  # a header without algorithm
    assert not S.signed_token(f"{head}.{b64(b'[1]', True)}.{sign}".encode())
    deep = b64(b"[" * 100_000, url=True)
    assert not S.signed_token(f"{deep}.{body}.{sign}".encode())


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, *more.values()) for i, t in rows], "doc_id long, text string" + "".join(
        f", {k} string" for k in more))
    return S.scan(df).collect()


def check(rows, out):
    texts = dict(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, _ in rows)
    for r in out:
        want = brute(texts[r.doc_id])
        assert [x for x in r.spans.split(",") if x.split(":")[0] in S.BASE] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k + ":") for x in want) for k in S.BASE)
        assert r.n_confirmed == len([x for x in r.spans.split(",") if x]) - len(want)


def test_base_spans_equal_the_patterns(spark):
    rnd = random.Random(3)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "PASSWD", "toKen", "ſecret", "=", ":", " ", "  ", '"', "'",
            "0123456789abcdef", "abcdef12", "AKIA", "ABCDEFGH12345678", "é", "語", "x-y_z.", "\n", "==", "a/b+c", "日本"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "AKIAAKIA" * 4), (1003, "AKIA" + "x" + "AKIA1234567890ABCD"),
             (1004, "é" * 2_000_000 + " password = abcdefghijkl"), (1005, "token" + " " * 300_000 + "=" + "f" * 20),
             (None, "password=correcthorsebattery")]
    check(rows, run(spark, rows))


def test_added_spans_have_code_point_offsets(spark):
    head = "été 語 "
    cases = {"jwt": jwt(), "rsa_key": b64(RSA), "openssh_key": SSH.hex(), "ec_key": b64(EC, url=True),
             "pem": f"-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(
                 b64(RSA)[i:i + 64] for i in range(0, len(b64(RSA)), 64)) + "\n-----END RSA PRIVATE KEY-----"}
    rows = [(i, head + t + ". Fin") for i, t in enumerate(cases.values())]
    rows.append((50, head + b64(RSA)[:-8] + " " + ".".join(jwt().split(".")[:2])))  # damaged: nothing
    out = run(spark, rows, id="clash", spans="clash", n_hex="clash")
    check(rows, out)
    for r in out:
        added = [x for x in r.spans.split(",") if x and x.split(":")[0] not in S.BASE]
        if r.doc_id == 50:
            assert added == []
        else:
            kind, text = list(cases.items())[r.doc_id]
            assert added == [f"{kind}:{len(head)}:{len(head) + len(text)}"]


def test_repeated_rows_and_empty_table(spark):
    rows = [(7, "token=0123456789abcdef0")] * 3
    out = run(spark, rows)
    assert len(out) == 3 and len({r.spans for r in out}) == 1 and out[0].spans == "assign:0:23,hex:6:23"
    assert run(spark, []) == []


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.QUERIES["op13_secret_scan"](spark, sf).collect())
