"""Personal data in texts: fixed patterns, and boosted trees over candidates of generous generators."""

from __future__ import annotations

import ipaddress
import random
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import spans as S
from .common import append_columns, read

BASE = ("email", "ip", "card", "phone")
GENERATED = ("at_email", "tel", "ssn", "iban", "ipv6", "number")
KINDS = (*BASE, *GENERATED)

#: The base patterns, in forms that take linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _digits(raw: str) -> str:
    return re.sub("[^0-9]", "", raw)


def _emails(text: str) -> list[S.Span]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[S.Span]:
    """Leftmost matches that do not overlap, for each kind on its own; failing ones are dropped."""
    found = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return S.ordered(found, KINDS)


#: Generators of high recall; most of what "tel" and "number" propose is not personal.
_MAKE = {
    "at_email": re.compile(r"[A-Za-z0-9._+-]{2,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,63} ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]{2,10}"),
    "tel": re.compile(r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "ipv6": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}|:):[0-9A-Fa-f:]{1,36}(?![0-9A-Za-z:])"),
    "number": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .-]?[0-9]){6,18}(?![0-9A-Za-z])"),
}
_NEED = {"at_email": re.compile(r"[\[(]at[\])]"), "iban": re.compile(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{2}"), "ipv6": re.compile(r":[0-9A-Fa-f]{0,4}:")}
_NUMBERS = re.compile(r"[0-9][0-9 ()./\-]{5}")
#: Words that tell of a person, and words that tell of trade or code, within NEAR characters.
_TELLING = re.compile(r"(?i)phone|tel\b|call|mobile|fax|contact|mail|card|visa|credit|account|iban|bank|ssn|social|passport|address|born|\bid\b|\bip\b|host|server")
_TRADE = re.compile(r"(?i)order|invoice|version|total|page|isbn|year|price|ticket|build|error|item|line|count|sku|part|date|time|score|range|section")
NEAR = 40


def candidates(text: str) -> list[S.Span]:
    """Overlapping proposals of every generator."""
    numbers = bool(_NUMBERS.search(text))
    found: list[S.Span] = []
    for kind, pattern in _MAKE.items():
        if kind in _NEED:
            if not _NEED[kind].search(text):
                continue
        elif not numbers:
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return found


def _iban(raw: str) -> bool:
    raw = raw.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def _ipv6(raw: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(raw))
    except ValueError:
        return False


def _date(parts: list[str]) -> bool:
    """Three numbers that can be a day, a month and a year, in some order."""
    if len(parts) != 3 or sorted(map(len, parts)) not in ([1, 1, 4], [1, 2, 4], [2, 2, 4], [2, 2, 2]):
        return False
    small = sorted(int(p) for p in parts if len(p) <= 2)
    return small[0] <= 12 and small[1] <= 31


def _within(words: re.Pattern, text: str, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a word lies between each low and high; one pass over the text for all."""
    found = np.array([m.span() for m in words.finditer(text)], dtype=np.int64).reshape(-1, 2)
    if not len(found):
        return np.zeros(len(low), dtype=bool)
    at = np.searchsorted(found[:, 0], low)
    return (at < len(found)) & (found[np.minimum(at, len(found) - 1), 1] <= high)


def features(text: str, spans: list[S.Span]) -> np.ndarray:
    """Format and context of candidates, a row each; NEAR characters on either side are the context."""
    a, b = np.array([s[1] for s in spans], dtype=np.int64), np.array([s[2] for s in spans], dtype=np.int64)
    context = [_within(w, text, low, high) for w in (_TELLING, _TRADE) for low, high in ((a - NEAR, a), (b, b + NEAR))]
    rows = []
    for kind, x, y in spans:
        raw = text[x:y]
        d = _digits(raw)
        groups = re.split("[^0-9A-Za-z]+", raw.strip("()"))
        rows.append((
            GENERATED.index(kind), len(raw), len(d), len(raw) - len(d), bool(d) and luhn(d), len(set(d)), kind == "iban" and _iban(raw),
            kind == "ipv6" and _ipv6(raw), _date(groups) if kind in ("tel", "number") else False, len(groups), max(map(len, groups)), len(groups[-1]),
            text[x - 1 : x] in (":", "#", "=") or text[max(0, x - 2) : x] in (": ", "# ", "= "), raw[0] == "(", raw[0] == "0",
            raw.count("-"), raw.count("."), raw.count("/"), d[:1] in ("3", "4", "5"),
        ))
    return np.column_stack([np.array(rows, dtype=np.float64).reshape(len(spans), -1), *context])


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, cut, three more for each side, four leaves)."""

    start: float
    trees: list[tuple]
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = ()

    def raw(self, x: np.ndarray) -> np.ndarray:
        y = np.full(len(x), self.start)
        for f, c, lf, lc, rf, rc, leaf in self.trees:
            right = x[:, f] > c
            deep = np.where(right, x[:, rf] > rc, x[:, lf] > lc)
            y += np.asarray(leaf)[2 * right + deep]
        return y

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    best = (-1.0, 0, np.inf)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        gs, hs = np.cumsum(g[order]), np.cumsum(h[order])
        if not len(v) or v[0] == v[-1]:
            continue
        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
        gain[v[:-1] == v[1:]] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    return best[1], best[2]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.3) -> Trees:
    """Newton boosting of the logistic loss."""
    p = y.mean().clip(0.01, 0.99)
    out = Trees(float(np.log(p / (1 - p))), [])
    z = np.full(len(y), out.start)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z))
        g, h = y - q, q * (1 - q)
        f, c = _split(x, g, h)
        right = x[:, f] > c
        sides = [_split(x[s], g[s], h[s]) for s in (~right, right)]
        deep = np.where(right, x[:, sides[1][0]] > sides[1][1], x[:, sides[0][0]] > sides[0][1])
        cell = 2 * right + deep
        leaf = tuple(float(rate * g[cell == k].sum() / (h[cell == k].sum() + 1)) for k in range(4))
        out.trees.append((f, c, *sides[0], *sides[1], leaf))
        z += np.asarray(leaf)[cell]
    return out


def _examples(n: int, seed: int) -> tuple[list[tuple[str, S.Span]], np.ndarray]:
    """Made-up sentences with a candidate each, and whether it is personal.

    Personal and other strings share forms, and words of either kind stand near both, so no single
    feature decides.
    """
    gen = random.Random(seed)
    pick = gen.choice
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    words = lambda: " ".join(pick("the of and ing tion report about near when la der una que il".split()) for _ in range(gen.randint(2, 6)))
    telling = "call me,phone:,phone,contact,my card,account,tel,mobile:,fax,bank,reach us,social,ip,server".split(",")
    trade = "order,invoice #,version,build,item,total,date,time,score,price,page,ticket,section,range".split(",")

    def card() -> str:
        d = pick("345") + digits(pick([13, 14, 14]))
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return d if gen.random() < 0.5 else pick(" -").join(d[i : i + 4] for i in range(0, len(d), 4))

    def iban() -> str:
        body = digits(18)
        rest = 98 - int(body + str(int("D", 36)) + str(int("E", 36)) + "00") % 97
        whole = f"DE{rest:02d}{body}"
        return whole if gen.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, 22, 4))

    def phone() -> str:
        form = pick(["3-3-4", "3-3-4", "(3) 3-4", "0dd ddd dddd", "0ddd dddddd", "0dd-dddd-dddd", "dd.dd.dd.dd.dd", "0dddd/ddddd", "ddd dddd"])
        form = {"3-3-4": pick(["ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd"]), "(3) 3-4": "(ddd) ddd-dddd"}.get(form, form)
        return "".join(pick("0123456789") if c == "d" else c for c in form)

    def other_digits() -> str:
        y, m, d = f"{gen.randint(1950, 2029)}", f"{gen.randint(1, 12):02d}", f"{gen.randint(1, 31):02d}"
        return pick([f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{gen.randint(10, 99)}.{gen.randint(10, 99)}.{gen.randint(10, 99)}", f"{gen.randint(10, 999)}-{gen.randint(10, 999)}", f"{digits(2)} {digits(3)} {digits(3)}", f"1{digits(3)} {digits(4)}"])

    def hexes() -> str:
        eight = [f"{gen.randrange(65536):x}" for _ in range(8)]
        return pick([":".join(eight), f"{eight[0]}:{eight[1]}::{eight[2]}", f"2001:db8::{eight[0]}", f"fe80::{':'.join(eight[:4])}"])

    def one() -> tuple[str, str, int]:
        kind, good = pick(GENERATED), gen.random() < 0.5
        r = gen.random()
        near = (pick(telling) if r < 0.7 else words() if r < 0.93 else pick(trade)) if good else (pick(trade) if r < 0.6 else words() if r < 0.92 else pick(telling))
        if kind == "at_email":
            return kind, f"{near} jo{digits(2)} {pick(['(at)', '[at]'])} host{pick(['(dot)', '[dot]', '.']) if good else '. '}{'com' if good else 'the'}", int(good)
        if kind == "tel":
            return kind, f"{near} {phone() if good else other_digits()}", int(good)
        if kind == "ssn":
            return kind, f"{near} {digits(3)}-{digits(2)}-{digits(4)}", int(good)
        if kind == "iban":
            return kind, f"{near} {iban() if good else 'AB' + digits(20)}", int(good)
        if kind == "ipv6":
            return kind, f"{near} {hexes() if good else pick([f'1{digits(1)}:{digits(2)}:{digits(2)}', ':'.join(digits(2) for _ in range(6)), f'{digits(1)}:{digits(2)}:{digits(3)}'])}", int(good)
        return kind, f"{near} {pick([card, phone])() if good else pick([digits(gen.randint(7, 16)), other_digits()])}", int(good)

    out, labels = [], []
    while len(out) < n:
        kind, text, label = one()
        text = f"{words()} {text} {words()}"
        spans = [s for s in candidates(text) if s[0] == kind]
        if spans:
            out.append((text, max(spans, key=lambda s: s[2] - s[1])))
            labels.append(label)
    return out, np.array(labels, dtype=np.float64)


def _matrix(rows: list[tuple[str, S.Span]]) -> np.ndarray:
    return np.concatenate([features(text, [span]) for text, span in rows])


def held_out_quality(n: int = 4000, seed: int = 99) -> dict[str, tuple[float, float]]:
    """(precision, recall) of the model by generator, on made-up examples that it has not seen."""
    trees = model()
    rows, y = _examples(n, seed)
    p, kind = trees.probability(_matrix(rows)), np.array([s[0] for _, s in rows])
    cut = np.array([trees.thresholds[GENERATED.index(k)] for k in kind])
    out = {}
    for k in GENERATED:
        own = kind == k
        hit = own & (p >= cut)
        out[k] = (float(y[hit].mean()) if hit.any() else 1.0, float(hit[own & (y > 0)].mean()))
    return out


@lru_cache(1)
def model(n: int = 6000, seed: int = 11, precision: float = 0.95) -> Trees:
    """Trees fitted on made-up examples; slope, shift and each generator's threshold on others of them.

    A threshold is the least probability from which on the share of personal candidates is at least
    `precision`; above one, so nothing is selected, where none does.
    """
    rows, y = _examples(n, seed)
    trees = boost(_matrix(rows), y)
    rows, y = _examples(n, seed + 1)
    x = _matrix(rows)
    raw = trees.raw(x)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(trees.slope * raw + trees.shift, -30, 30)))
        trees.slope -= 0.05 * float(((p - y) * raw).mean())
        trees.shift -= 0.05 * float((p - y).mean())
    p = trees.probability(x)
    cuts = []
    for k in range(len(GENERATED)):
        own, truth = p[x[:, 0] == k], y[x[:, 0] == k]
        good = [t for t in np.unique(own) if truth[own >= t].mean() >= precision]
        cuts.append(float(max(min(good), 0.5)) if good else 2.0)
    trees.thresholds = tuple(cuts)
    return trees


def select(text: str, base: list[S.Span], trees: Trees) -> list[S.Span]:
    """The base spans, and the candidates over their threshold; of overlapping ones, the likeliest stays."""
    proposed = candidates(text)
    if not proposed:
        return base
    x = features(text, proposed)
    p = trees.probability(x)
    over = [(float(q), s) for q, s in zip(p, proposed) if q >= trees.thresholds[GENERATED.index(s[0])]]
    # what is taken, as parts without overlap in order of place
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = list(base)
    for _, s in sorted(over, key=lambda r: (-r[0], r[1][1], r[1][2])):
        at = bisect_right(ends, s[1])  # the first part that ends behind the candidate's start
        if at == len(starts) or starts[at] >= s[2]:
            starts.insert(at, s[1])
            ends.insert(at, s[2])
            out.append(s)
    return S.ordered(out, KINDS)


def _find(trees: Trees, texts: list[str | None]) -> dict[str, object]:
    base = [base_spans(t or "") for t in texts]
    return S.columns(base, [select(t or "", b, trees) for b, t in zip(base, texts)], BASE)


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone, base_sha256 and spans; no shuffle, a row for each row.

    Null texts count as empty ones: no spans, and the digest of the empty string.  Existing columns
    of these names are replaced.
    """
    trees = model()
    return append_columns(df, text_col, S.fields(BASE), lambda texts: _find(trees, texts), keep)


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with every span in the text replaced by its kind, and length_col set to the new length.

    Null texts stay null, and so does their length column.  All other columns stay.
    """
    trees = model()

    def make(texts: list[str | None]) -> dict[str, object]:
        new = [None if t is None else S.redacted(t, select(t, base_spans(t), trees)) for t in texts]
        return {text_col: new} | ({length_col: [None if t is None else len(t) for t in new]} if length_col else {})

    made = [(text_col, T.StringType())] + ([(length_col, T.LongType())] if length_col else [])
    return append_columns(df, text_col, made, make).select(*[f"`{c}`" for c in df.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
