"""Scans of very long texts take time in proportion, and their added spans are those of plain versions."""

import base64
import random
import re
import time

import pytest

from rangeloom.llm import pii, secrets


def long_texts():
    gen = random.Random(1)
    blob = lambda n: base64.b64encode(gen.randbytes(n)).decode()
    yield "token" * 200_000
    yield " ".join(gen.choice("the author said private things about token secret password api auth".split()) for _ in range(150_000))
    yield f"secret {blob(350_000)} key {blob(350_000)}"
    yield "secret " + "/".join(blob(30) for _ in range(12_000)) + " " + "=".join(blob(30) for _ in range(12_000))
    yield "212-555-1234 " * 77_000
    yield "a.b@cde.com 212-555-1234 " * 40_000
    yield "1.22.3.4." * 110_000
    yield "1 2 3 4 " * 125_000
    yield "DE89370400440532013000 " * 43_000
    yield "1:2:3:4:5:6:7:8 " * 62_000
    yield "a" * 500_000 + "(at)" + "b" * 500_000


@pytest.mark.parametrize("n", range(11))
def test_time(n):
    text = list(long_texts())[n]
    pii.model()
    spin = time.process_time()
    sum(range(20_000_000))
    slow = max(1.0, (time.process_time() - spin) / 0.4)  # how far this machine is behind
    for find in (secrets.find, lambda t: pii._find(pii.model(), t)):
        began = time.process_time()
        find([text])
        assert time.process_time() - began < 5 * slow


def plain_novel(text):
    """Every candidate against every word."""
    words = [m.span() for m in secrets._CONTEXT.finditer(text)]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        a, b = m.span()
        raw = m.group()
        if b - a < 16 or not re.search("[0-9]", raw) or not re.search("[A-Za-z]", raw):
            continue
        if any(a - y < secrets.REACH and x - b <= secrets.REACH for x, y in words):
            before, after = secrets._surroundings(text, a, b)
            if secrets.novelty(before, raw, after) >= secrets.NOVELTY:
                out.append(("novel", a, b))
    return out


def test_novel_spans_are_the_plain_ones():
    gen = random.Random(8)
    pieces = ["token ", "the secret: ", "plain words here ", "aaaaaaaaaaaaaaaa1 ", "x" * 40 + " ", "é ", "\n", " " * 30]
    seen = 0
    for _ in range(400):
        t = "".join(gen.choice(pieces + [base64.b64encode(gen.randbytes(gen.choice([9, 15, 60]))).decode() + " "] * 3) for _ in range(gen.randint(1, 14)))
        found = secrets.novel_spans(t)
        assert found == plain_novel(t), t
        seen += len(found)
    assert seen > 200
    key = "".join(gen.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(79))
    assert [t[1:] for t in secrets.novel_spans(f"{key} is the secret")] == [(0, 79)]


def plain_select(text, base, trees):
    """Every selected candidate against every span taken."""
    proposed = pii.candidates(text)
    if not proposed:
        return base
    p = trees.probability(pii.features(text, proposed))
    over = [(float(q), s) for q, s in zip(p, proposed) if q >= trees.thresholds[pii.GENERATED.index(s[0])]]
    taken, out = [(a, b) for _, a, b in base], list(base)
    for _, s in sorted(over, key=lambda r: (-r[0], r[1][1], r[1][2])):
        if all(s[2] <= a or s[1] >= b for a, b in taken):
            taken.append(s[1:])
            out.append(s)
    return pii.S.ordered(out, pii.KINDS)


def test_selection_is_the_plain_one():
    gen = random.Random(9)
    pieces = ["call ", "order ", "212-555-1234 ", "4111 1111 1111 1111 ", "DE89 3704 0044 0532 0130 00 ", "fe80::1:2:3 ", "+1 212 555 1234 ", "12:30:45 ", "1.2.3.4 ", "a.b@c.de ", "555-", "(0", ")", "jo1 (at) host.com "]
    trees = pii.model()
    seen = 0
    for _ in range(400):
        t = "".join(gen.choice(pieces) for _ in range(gen.randint(1, 20)))
        base = pii.base_spans(t)
        found = pii.select(t, base, trees)
        assert found == plain_select(t, base, trees), t
        assert set(base) <= set(found)
        seen += len(found) - len(base)
    assert seen > 200
