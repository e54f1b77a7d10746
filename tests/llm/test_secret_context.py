"""Where secret scans look for a sensitive word."""

import base64
import random

from strideframe.llm import secrets_scan


def left(text):
    return secrets_scan.masked(text, secrets_scan.spans(text, secrets_scan.Novelty(b"")))


def key_lines(n, last=64):
    body = base64.b64encode(random.Random(n).randbytes(48 * n))
    lines = [body[i : i + 64] for i in range(0, len(body), 64)]
    return [*lines[:-1], lines[-1][:last]]


def test_key_blocks_are_masked_whole():
    for last in (64, 20, 7):
        lines = key_lines(25, last)
        for label in (b"RSA PRIVATE KEY", b"OPENSSH PRIVATE KEY"):
            out = left(b"config\n-----BEGIN " + label + b"-----\n" + b"\n".join(lines) + b"\n-----END " + label + b"-----\nrest of the file")
            assert not any(line in out for line in lines) and out.startswith(b"config") and out.endswith(b"rest of the file")
    lines = key_lines(6)
    out = left(b"-----BEGIN PRIVATE KEY-----\n" + b"\n".join(lines))
    assert not any(line in out for line in lines)


def test_context_is_carried_and_looked_for_after():
    one, two, three = (x[:40] for x in key_lines(3))
    assert two not in left(b'signing_key = ("' + one + b'"\n    "' + two + b'")')
    assert one not in left(b"the auth header of the service that was set up in the second week of the last month is " + one)
    assert one not in left(b"x = " + one + b"  # private")
    assert one in left(b"x = " + one + b" y") and three in left(b"the key is this\n\n" + b"and so on and on, " * 4 + b"\n" + three)
