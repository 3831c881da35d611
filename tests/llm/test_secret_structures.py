"""Structural kinds of the secret scan: an exhaustive search over all line pairs, hard texts, and clashing columns."""

import base64
import random
import time

from lakequill.llm import secrets


def der(tag, *parts):
    b = b"".join(parts)
    n = len(b)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")) + b


def oid(h):
    return der(0x30, der(6, bytes.fromhex(h)))


def ssh(n=70, keys=1, seed=1):
    s = lambda b: len(b).to_bytes(4, "big") + b
    r = random.Random(seed)
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + keys.to_bytes(4, "big") + b"".join(s(r.randbytes(40)) for _ in range(keys)) + s(r.randbytes(n))


PKCS8 = der(0x30, der(2, b"\0"), oid("2b6570"), der(4, bytes(range(34))))
SEC1 = der(0x30, der(2, b"\1"), der(4, bytes(range(32))))
PKCS12 = der(0x30, der(2, b"\3"), der(0x30, der(6, bytes.fromhex("2a864886f70d010701")), der(0xA0, der(4, bytes(60)))), der(0x30, oid("2b0e03021a"), der(4, bytes(20))))
SPKI = der(0x30, oid("2b6570"), der(3, bytes(33)))
KEYS = [(PKCS8, "der_key"), (SEC1, "der_key"), (PKCS12, "der_key"), (SPKI, "public_key"), (ssh(), "ssh_key"), (ssh(200, 3), "ssh_key")]


def lines_of(body, width):
    return [body[i : i + width] for i in range(0, len(body), width)]


def structural(text):
    return [x for x in secrets.scan(text) if x[2] in ("der_key", "ssh_key", "public_key")]


def exhaustive(text):
    """From every line of every run to every later line end: whether the bytes between are one of the keys made above."""
    known = dict(KEYS)
    out = []
    for m in secrets.BASE64.finditer(text):
        spans, at = [], m.start()
        for piece in m[0].split("\n"):
            spans.append((at, at + len(piece)))
            at += len(piece) + 1
        i = 0
        while i < len(spans):
            for j in range(i, len(spans)):
                chars = text[spans[i][0] : spans[j][1]].replace("\n", "").rstrip("=")
                try:
                    raw = base64.b64decode(chars + "=" * (-len(chars) % 4))
                except ValueError:
                    continue
                if raw in known:
                    out.append((spans[i][0], spans[j][1], known[raw]))
                    i = j
                    break
            i += 1
    return out


def test_keys_among_other_lines():
    r = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for _ in range(150):
        lines = ["".join(r.choice(letters) for _ in range(30))]
        for _ in range(r.randint(0, 5)):
            if r.random() < 0.6:
                body = base64.b64encode(r.choice(KEYS)[0]).decode().rstrip("=")
                lines += lines_of(body, r.choice([24, 40, 64, 500]))
            else:
                lines += ["".join(r.choice(["M", "MI", "MIR/////", "b3BlbnNzaC1rZXkt", ""])) + "".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(3)]
        text = "\n".join(lines)
        assert structural(text) == exhaustive(text), text


def test_keys_behind_escaped_line_feeds():
    for key, kind in KEYS:
        lines = lines_of(base64.b64encode(key).decode(), 48)
        for sep in ("\\n", "\\r\\n", "\\n    "):
            body = sep.join(lines)
            for before in (sep, f"-----BEGIN X-----{sep}", "", "nothing "):
                assert structural(f"{before}{body}{sep}.") == [(len(before), len(before) + len(body), kind)], (before, sep)


def test_pem_files_in_base64_and_hex_keys():
    for key, kind in KEYS:
        pem = "-----BEGIN SOME KEY-----\n" + "\n".join(lines_of(base64.b64encode(key).decode(), 64)) + "\n-----END SOME KEY-----\n"
        for before in ("", "-----BEGIN CERTIFICATE-----\nAAAA\n-----END CERTIFICATE-----\n"):
            coded = base64.b64encode((before + pem).encode()).decode()
            for sep in ("", "\n", "\n      "):
                body = sep.join(lines_of(coded, 76)) if sep else coded
                got = structural(f"data: {body} .")
                assert [k for *_, k in got] == [kind]
                start, end, _ = got[0]
                assert 6 <= start < end <= 6 + len(body) and (start == 6 or before)
        for run in (key.hex(), key.hex().upper()):
            assert [k for *_, k in structural(f"x {run} y")] == [kind]
    assert not structural(base64.b64encode(ssh()[:-3]).decode()) and not structural(ssh()[:-3].hex())


def test_a_payload_must_decode():
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    assert [k for *_, k in secrets.scan(f"{head}.e30.c2ln")] == ["jwt"] and not secrets.scan(f"{head}.e30ab.c2ln")


def test_time_in_step_with_length():
    key = base64.b64encode(ssh()).decode()
    nested = base64.b64encode(der(0x30, der(2, b"\0"), oid("2b6570"))[:-1]).decode()[:12]
    for line in ("MIR/////" + "A" * 56, "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAA" + "A" * 8, "M" + "A" * 63, "MIIEvQIBADANBgkqhkiG9w0BAQEFAASC" + "B" * 32, nested + "A" * 52, "LS0tLS1CRUdJTiBBLS0tLS0K" + "QUFB" * 10, key[:64], "eyJhIjoxfQ." * 6):
        text = (line + "\n") * (1_000_000 // (len(line) + 1))
        t = time.time()
        secrets.scan(text)
        assert time.time() - t < 5, line  # some seconds at most for a MB; the square of it would be hours


def test_columns_that_clash_empty_tables_and_null_ids(spark):
    rows = [(None, "password = abcdef1", "keep", 1), (None, None, "keep", 2), (3, "", "keep", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _lq_text string, spans long")
    assert sorted(map(str, secrets.secret_scan(df).select("doc_id", "n_assign").collect())) == sorted(["Row(doc_id=None, n_assign=1)", "Row(doc_id=None, n_assign=0)", "Row(doc_id=3, n_assign=0)"])
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    assert sorted((r.text or "", r._lq_text, r.spans) for r in clean.collect()) == [("", "keep", 2), ("", "keep", 3), ("[assign]", "keep", 1)]
    empty = df.where("false")
    assert secrets.secret_scan(empty).count() == 0 and secrets.redact(empty).count() == 0
