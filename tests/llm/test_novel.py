"""Strings that only the compressor finds: repeated ones, and long ones."""

import random
import string

from rangeloom.llm import secrets


def keys(n, seed=1):
    gen = random.Random(seed)
    return ["a1" + "".join(gen.choice(string.ascii_letters + string.digits) for _ in range(n - 2)) for _ in range(20)]


def test_repeated_secrets():
    for n in (16, 32, 64):
        for k in keys(n):
            for text, times in (
                (f"Authorization: Bearer {k} stands here, then curl with bearer {k} once more", 2),
                (f"export X_AUTH={k} is set, and the header is Bearer {k} as before", 2),
            ):
                got = [text[a:b] for _, a, b in secrets.novel_spans(text)]
                assert len(got) == times and all(x.endswith(k) for x in got), text


def test_copies_at_the_edge():
    k = keys(40)[0]
    for gap in range(200, 270):
        text = f"bearer {k} " + ("so the text runs on " * 20)[:gap] + f" bearer {k}"
        assert len(secrets.novel_spans(text)) == 2, gap


def test_long_secrets_before_their_word():
    for n in (70, 100, 300):
        k = keys(n)[0]
        text = f"the value {k} is the access key"
        assert [text[a:b] for _, a, b in secrets.novel_spans(text)] == [k]
    assert secrets.novel_spans(f"{keys(20)[0]} {'so on ' * 12}token") == []
