"""Secrets in wrapped, damaged and many packed data; chats of long turns."""

import base64
import gzip
import random
import resource
import textwrap
import time
import zlib

import pytest

from webloom.llm import chat, secrets

SECRET = "password=hunter2hunter2"


def spans(text):
    return secrets.scan_layers(text)


def wrapped(raw, width=76, end="\n", indent=""):
    return end.join(indent + line for line in textwrap.wrap(base64.b64encode(raw).decode(), width))


NOISE = random.Random(1).randbytes(900)


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n\t"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress])
def test_base64_over_lines(width, end, pack):
    """The span covers all lines, the shorter last one too; what follows the block changes nothing."""
    words = " ".join(map(str, NOISE[:90])).encode()
    block = wrapped(pack(words + b" " + SECRET.encode() + b" and behind " * 5), width, end)
    assert end in block
    for before, after in (("", ""), ("see:\n\n", "\n\nthe end\n"), ("x ", "\n-- \nme")):
        found = spans(before + block + after)
        assert any(k == "assign" and s == len(before) and e >= len(before) + len(block) - width for s, e, k in found), (found, len(block))
        assert max(e for _, e, _ in found) == len(before) + len(block)


def test_a_secret_over_a_line_end():
    raw = b"x" * 50 + SECRET.encode()  # the first line ends within it
    block = wrapped(raw, 76)
    assert spans(block) == [(0, len(block), "assign")]


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress])
def test_damaged_data(pack):
    """A wrong checksum, a missing end and damage behind the secret: what comes before is told, short or long."""
    for text in (SECRET.encode(), SECRET.encode() + NOISE * 40):
        raw = bytearray(pack(text))
        raw[-1] ^= 255
        packed = base64.b64encode(bytes(raw)).decode()
        assert (0, len(packed), "assign") in spans(packed)
        cut = base64.b64encode(pack(text)[:-3]).decode()
        assert (0, len(cut), "assign") in spans(cut)
    long = bytearray(pack(SECRET.encode() + b" " + NOISE * 40))
    long[len(long) - 300] ^= 255
    packed = base64.b64encode(bytes(long)).decode()
    assert (0, len(packed), "assign") in spans(packed)


def test_streams_behind_one_another():
    """Each stream among other bytes is read once; one that only looks like a stream hides none behind it."""
    parts = [b"\xff\xfe%d" % k + zlib.compress(b"object %d " % k * 20) for k in range(50)]
    hidden = b"\x00x\x9c\x01" + gzip.compress(SECRET.encode() * 3) + b"\x01"
    raw = b"%PDF" + b"".join(parts[:25]) + hidden + b"".join(parts[25:])
    text = base64.b64encode(raw).decode()
    assert (0, len(text), "assign") in spans(text)
    took = []
    for n in (1000, 4000):
        raw = b"%PDF" + b"".join(b"\xff%d" % k + zlib.compress(b"stream %d holds words " % k * 5) for k in range(n))
        began = time.time()
        spans(base64.b64encode(raw).decode())
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1, took


def test_inflated_data_are_not_held():
    """300 MB come of one text, and a secret at their end; memory doesn't follow them."""
    machine, raw = zlib.compressobj(9), b""
    for _ in range(300):
        raw += machine.compress((b"words " * 20 + b"\n") * 8600)
    raw += machine.compress(SECRET.encode()) + machine.flush()
    text = base64.b64encode(raw).decode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert (0, len(text), "assign") in spans(text)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 250_000


def test_escapes_are_reversible():
    r = random.Random(2)
    for _ in range(2000):
        text = "".join(r.choices("\\<#:a/t\n", k=r.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and chat.unescape(chat.escape(text, ":")) == text
        turns = [{"role": text, "text": text[::-1]}, {"role": "assistant", "text": text}]
        (last, whole, start, size), = chat._examples(turns)
        assert last and chat.read_turns(whole) == [(text, text[::-1]), ("assistant", text)] and chat.unescape(whole[start : start + size]) == text


def test_a_turn_of_many_characters():
    text = "a<b \\ # x" * 4_000_000
    (_, whole, _, _), = chat._examples([{"role": "user", "text": text}])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert chat.read_turns(whole) == [("user", text)]
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 600_000
