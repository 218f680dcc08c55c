"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new."""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import spans as S
from .common import append_columns, read

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")

#: The base patterns.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORD = re.compile(r"(?ai:passw|secret|token|api)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words near which a string is suspect, and the reach of "near" in characters.
_CONTEXT = re.compile(r"(?ai)passw|secret|token|api.?key|credential|auth|bearer|private|access.?key|login|akia")
REACH = 64
LONG = 4096
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

#: What ordinary identifiers and code look like; the compressor starts with it, so that they cost little.
IDENTIFIERS = (
    "application configuration connection authentication authorization credential password secret token "
    "access_key secret_key api_key client_id client_secret private_key public_key session_id user_name "
    "getElementById addEventListener setTimeout toString valueOf hasOwnProperty prototype constructor "
    "public static void private protected final class interface extends implements return function const "
    "import export default require module package include define ifdef endif typedef struct namespace "
    "http://www.example.com/index.html https://localhost:8080/api/v1/users/login?redirect=home "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000000000000000 "
    "xxxxxxxxxxxxxxxx test_test_test example_example placeholder changeme your_token_here "
).encode()
#: Compressed bytes that a byte of the candidate must add at least.
NOVELTY = 0.62

_primed: tuple[zstandard.ZstdCompressor, ...] = ()


def _compressor() -> zstandard.ZstdCompressor:
    global _primed
    if not _primed:
        primer = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _primed = (zstandard.ZstdCompressor(level=19, dict_data=primer, write_content_size=False),)
    return _primed[0]


def novelty(before: str, candidate: str, after: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each byte of its own."""
    press = _compressor()
    around = (before + " " + after + " ").encode("utf-8", "replace")
    raw = candidate.encode()
    return (len(press.compress(around + raw)) - len(press.compress(around))) / len(raw)


def _surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after, without other copies of the string or of what follows its = or /.

    That a secret is repeated doesn't make it familiar.  Copies that the edge would cut are removed too,
    unless they are longer than LONG: what is left of one is then too short to tell.
    """
    raw, far = text[start:end], 4 * REACH
    near = far + min(len(raw), LONG)
    before, after = text[max(0, start - near) : start], text[end : end + near]
    parts = {raw} | {x for by in ("=", "[=/]") for x in re.split(by, raw) if len(x) >= 16}
    for part in sorted(parts, key=lambda x: (-len(x), x)):
        before, after = before.replace(part, " "), after.replace(part, " ")
    return before[-far:], after[:far]


def _hexes(text: str) -> list[S.Span]:
    return [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def base_spans(text: str) -> list[S.Span]:
    """Leftmost matches that do not overlap, for each kind on its own; failing ones are dropped."""
    found: list[S.Span] = _hexes(text)
    if _WORD.search(text):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return S.ordered(found, KINDS)


def novel_spans(text: str, threshold: float = NOVELTY) -> list[S.Span]:
    """Strings of 16 characters or more, with a letter and a digit, near a word of _CONTEXT, that the
    primed compressor can't shorten."""
    words = [(m.start() - REACH, m.end() + REACH) for m in _CONTEXT.finditer(text)]
    found: list[S.Span] = []
    at = 0
    for m in _CANDIDATE.finditer(text) if words else ():
        while at < len(words) and words[at][1] <= m.start():
            at += 1
        if at == len(words):
            break
        if m.end() < words[at][0]:
            continue
        raw = m.group()
        if not (re.search("[0-9]", raw) and re.search("[A-Za-z]", raw)):
            continue
        before, after = _surroundings(text, m.start(), m.end())
        if novelty(before, raw, after) >= threshold:
            found.append(("novel", m.start(), m.end()))
    return found


def find(texts: list[str | None]) -> dict[str, object]:
    base = [base_spans(t or "") for t in texts]
    every = [S.ordered(b + novel_spans(t or ""), KINDS) for b, t in zip(base, texts)]
    return S.columns(base, every, BASE)


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with n_assign, n_access, n_hex, base_sha256 and spans; no shuffle, a row for each row.

    Null texts count as empty ones: no spans, and the digest of the empty string.  Existing columns
    of these names are replaced.
    """
    return append_columns(df, text_col, S.fields(BASE), find, keep)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
