"""Scalar functions over strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends of a string, beyond what ASCII has.
SPACE = r"[\s   -     　﻿]"


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, SPACE + r"+\z", "")


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, r"\A" + SPACE + "+", "")


def trim(s: Column) -> Column:
    return trim_start(trim_end(s))


def indent_of(line: Column) -> Column:
    """Leading tabs and spaces, each counting one."""
    return F.length(F.regexp_extract(line, r"^[\t ]*", 0))


def is_closer(line: Column) -> Column:
    """A line whose first sign closes a bracket."""
    return line.rlike(r"^\s*[\])}]")


def numbered(line_no: Column, text: Column, last: Column) -> Column:
    """A numbered source line; numbers are as wide as that of the snippet's last line."""
    n = line_no.cast("string")
    return F.concat(F.lpad(n, F.greatest(F.length(last.cast("string")), F.length(n)), F.lit(" ")), F.lit("│ "), text)


def display_path(path: Column) -> Column:
    """The last two segments of a path that has more."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(path)


def _root(root: Column) -> Column:
    return F.regexp_replace(root, r"[\\/]+\z", "")


def relative_path(root: Column, path: Column) -> Column:
    """path below root; the root itself becomes empty, anything outside stays; slashes only."""
    r = _root(root)
    inner = F.when(path.startswith(F.concat(r, F.lit("/"))), F.substr(path, F.length(r) + 2)).otherwise(path)
    return F.when(path == r, F.lit("")).otherwise(F.translate(inner, "\\", "/"))


def normalize_path(path: Column) -> Column:
    """Slashes only, and without a leading ./, then a/, then b/."""
    out = F.translate(path, "\\", "/")
    for lead in (r"\A\./", r"\Aa/", r"\Ab/"):
        out = F.regexp_replace(out, lead, "")
    return out


def resolve_within(root: Column, path: Column) -> Column:
    """The absolute path of a path, null if it leaves root: dot segments are folded first.

    Absolute paths outside root, and any path without a root unless absolute, give null.
    """
    r, norm = _root(root), F.translate(path, "\\", "/")
    absolute = norm.startswith("/")
    fold = F.aggregate(
        F.filter(F.split(F.when(absolute, norm).otherwise(F.concat(r, F.lit("/"), norm)), "/"), lambda x: (x != "") & (x != ".")),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.concat(F.lit("/"), F.array_join(fold, "/"))
    inside = lambda p: (p == r) | p.startswith(F.concat(r, F.lit("/")))
    return (
        F.when(absolute & root.isNull(), norm)
        .when(root.isNull(), F.lit(None))
        .otherwise(F.when(inside(joined), joined))
    )


def host_of(url: Column) -> Column:
    """Host and port of a URL, without user and default port; the input where it is none."""
    host = F.regexp_replace(F.lower(F.try_parse_url(trim(url), F.lit("AUTHORITY"))), r"^[^@]*@", "")
    scheme = F.lower(F.try_parse_url(trim(url), F.lit("PROTOCOL")))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80\z", "")).when(scheme == "https", F.regexp_replace(host, r":443\z", "")).otherwise(host)
    return F.coalesce(F.when(scheme.isNotNull(), host), url)


def is_loopback(host: Column) -> Column:
    return host.isin("localhost", "::1") | host.startswith("127.")


#: The actions, other words for them, and parts of words that tell them, in this order.
ACTIONS = ("init", "pass", "validate", "mutate", "commit", "return")
ALIASES = {
    "init": "initialize initialized declare declared declaration create created assign assigned",
    "pass": "parameter param argument args input receive received propagate passthrough",
    "validate": "check checked verify verified assert assertion validated guard",
    "mutate": "update updated modify modified change changed set transform transformed calculation compute computed",
    "commit": "save saved persist persisted store stored write written emit published",
    "return": "returns returned output result",
}
FAMILIES = (
    ("validate", "valid"),
    ("mutate", "mutat modif updat"),
    ("commit", "commit persist sav stor"),
    ("return", "return"),
    ("init", "init declar creat"),
    ("pass", "pass arg param"),
)


def action_of(word: Column) -> Column:
    """The action that a word names; null for none."""
    w = F.lower(trim(word))
    out = F.when(w.isin(*ACTIONS), w)
    for action, others in ALIASES.items():
        out = out.when(w.isin(*others.split()), F.lit(action))
    for action, parts in FAMILIES:
        out = out.when(w.rlike("|".join(parts.split())), F.lit(action))
    return out


def style_of(word: Column) -> Column:
    return F.when(word.isin("expert", "learner"), word).otherwise(F.lit("standard"))


def _cut(s: Column, most: int) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def compact(s: Column) -> Column:
    """White space runs as one space; 30 characters at most."""
    return _cut(trim(F.regexp_replace(s, SPACE + "+", " ")), 30)


def shorten(s: Column) -> Column:
    return _cut(trim(F.translate(s, "\n", " ")), 32)


def md_escape(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\`*_{}\[\]()#+!~|<>])", r"\\$1")


def md_inline(s: Column) -> Column:
    return F.substring(F.translate(s, "`\n", "' "), 1, 120)


def html_escape(s: Column) -> Column:
    out = F.coalesce(s, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def html_markdown(s: Column) -> Column:
    """Escaped, with code spans and then bold."""
    out = F.regexp_replace(html_escape(s), "`([^`]+)`", "<code>$1</code>")
    return F.regexp_replace(out, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")


def hex_colour(s: Column) -> Column:
    """Six lower-case digits after #, from three or six of either case; null for anything else."""
    t = F.lower(trim(s))
    six = t.rlike(r"^#[0-9a-f]{6}\z")
    return F.when(six, t).when(t.rlike(r"^#[0-9a-f]{3}\z"), F.regexp_replace(t, "([0-9a-f])", "$1$1"))


def rgba(colour: Column, alpha: Column) -> Column:
    parts = [F.conv(F.substring(colour, k, 2), 16, 10) for k in (2, 4, 6)]
    return F.concat(F.lit("rgba("), F.concat_ws(", ", *parts, alpha.cast("string")), F.lit(")"))


#: The icon of an action.
ICONS = {"init": "sparkle", "pass": "arrow-right", "validate": "shield", "mutate": "edit", "commit": "git-commit", "return": "debug-return"}


def icon_of(action: Column) -> Column:
    out = F.lit("symbol-variable")
    for name, icon in ICONS.items():
        out = F.when(action == name, F.lit(icon)).otherwise(out)
    return out


#: The extensions of the languages.
LANGUAGES = {
    "rust": "rs",
    "go": "go",
    "solidity": "sol",
    "typescript": "ts mts cts",
    "tsx": "tsx",
    "python": "py pyi",
}


def language_of(path: Column) -> Column:
    """By what follows the last dot; null for an unknown one."""
    ext = F.lower(F.substring_index(path, ".", -1))
    out = F.lit(None).cast("string")
    for language, extensions in LANGUAGES.items():
        out = F.when(ext.isin(*extensions.split()), F.lit(language)).otherwise(out)
    return out


def strip_trailing_commas(s: Column) -> Column:
    return F.regexp_replace(s, r",(\s*[\]}])", "$1")


def changed_lines_label(hunks: Column) -> Column:
    """`n` or `a-b` for each hunk with start and end, comma-joined."""
    return F.array_join(
        F.transform(hunks, lambda h: F.when(h["start"] == h["end"], h["start"].cast("string")).otherwise(F.concat_ws("-", h["start"], h["end"]))), ", "
    )


def symbol_line(start: Column, end: Column, category: Column, text: Column) -> Column:
    to = F.when(start == end, F.lit("")).otherwise(F.concat(F.lit("-L"), end.cast("string")))
    return F.concat(F.lit("- L"), start.cast("string"), to, F.lit(" "), category, F.lit(": "), F.substring(F.translate(text, "\n", " "), 1, 90))
