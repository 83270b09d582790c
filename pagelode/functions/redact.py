"""Redaction and normalisation of text, headers and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .core import collapse, let


def is_sensitive_name(name: Column) -> Column:
    """A header, parameter or property name that likely carries a secret."""
    return F.lower(name).isin(*R.SENSITIVE_HEADERS) | name.rlike(R.SENSITIVE_NAME)


def redact_map(values: Column) -> Column:
    """``map<string,string>`` with sensitive values marked."""
    return F.transform_values(values, lambda k, v: F.when(
        is_sensitive_name(k), F.lit(R.REDACTED)).otherwise(v))


def redact_multimap(values: Column) -> Column:
    """``map<string,array<string>>``; a sensitive name keeps one marker only."""
    return F.transform_values(values, lambda k, v: F.when(
        is_sensitive_name(k), F.array(F.lit(R.REDACTED))).otherwise(v))


#: Begins of patterns that are always a character of a word, and what a place must hold for them.
_BEGINS = {r"\d": r"(?=\d)", "[0-9a-f]": "", r"(?:an?|\d+)": r"(?=[a\d])", "(?:just now|yesterday|moments ago)": "(?=[jym])", "(?:sk-|pk-": "(?=[spgx])"}


def _opened(pattern: str) -> str:
    """``pattern`` with a cheaper word boundary at its begin, if what follows is always a character of a word.

    A boundary before such a character only asks that none comes before it. Both sides were tested at every place of a text;
    now the place must also hold what the pattern begins with, where that is plain to see.
    """
    flags, inner = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    body = inner.removeprefix(R.B)
    lead = f"(?={body[0]})" if body[0].isalnum() else next((first for begin, first in _BEGINS.items() if body.startswith(begin)), None)
    return pattern if lead is None or body == inner else f"{flags}{lead}(?<![A-Za-z0-9_]){body}"


def _guarded(text: Column, guard: str, pattern: str, mark: str) -> Column:
    """Replace only where a cheap necessary part occurs; most texts skip the costly pattern."""
    held = (lambda t: t.contains(guard)) if guard.replace("_", "").replace("-", "").isalnum() or guard in "@," else lambda t: t.rlike(guard)
    return let(text, lambda t: F.when(held(t), F.regexp_replace(t, _opened(pattern), mark)).otherwise(t))


def redact_secrets(text: Column, emails: bool = False) -> Column:
    """Secret-shaped parts of a text become the redaction mark."""
    mark = R.REDACTED
    out = _guarded(text, "eyJ", R.SECRET_JWT, mark)
    out = _guarded(out, r"(?i)(Bearer|token)" + R.WS, R.SECRET_BEARER, "$1 " + mark)
    out = _guarded(out, r"(sk|pk|rk|api|key|tok)[_-][A-Za-z0-9]{16}|gh[posu]_|xox[baprs]-|AKIA", R.SECRET_PREFIXED, mark)
    out = _guarded(out, r"[0-9a-fA-F]{40}", R.SECRET_HEX, mark)
    out = _guarded(out, r"[A-Za-z0-9+/_-]{40}", R.SECRET_BASE64, mark)
    if emails:
        out = _guarded(out, "@", R.SECRET_EMAIL, mark)
    return F.when(F.length(text) < R.MIN_SECRET_CHARS, text).otherwise(out)


# What each rule of R.HTML_SECRETS needs in a page, in the same order.
_HTML_GUARDS = [
    "eyJ", "hf_", "sk-", "gh[pousr]_", "github_pat_", "AKIA", "AIza", "xox[baprs]-", "Bearer", r"(?i)(key|token|secret|password)\"",
]


def scrub_html(html: Column) -> Column:
    """Labelled marks for secrets left in rendered HTML."""
    for guard, (pattern, mark) in zip(_HTML_GUARDS, R.HTML_SECRETS, strict=True):
        html = _guarded(html, guard, pattern, mark)
    return html


# What each rule of R.VOLATILE_TEXT needs in a text, in the same order.
_TEXT_GUARDS = [
    r"[0-9a-fA-F]{8}-", r"\d{4}-\d{2}-\d{2}T", "@", "Bearer", "eyJ", r"sk-|pk-|ghp_|xox[baprs]-", r"[0-9a-fA-F]{16}", r"\d{13}", r"\d{10}",
]


def normalize_text(text: Column) -> Column:
    """Placeholders for values that differ between captures; idempotent."""
    for guard, (pattern, mark) in zip(_TEXT_GUARDS, R.VOLATILE_TEXT, strict=True):
        text = _guarded(text, guard, pattern, mark)
    return text


def normalize_html(html: Column) -> Column:
    """Blank per-response attribute values, then ``normalize_text``."""
    for name in R.VOLATILE_ATTRS:
        pattern = f"(?i)(?={name[0]}){R.B}({name}{R.WS}*={R.WS}*)([\"'])[^\"']*\\2"
        html = _guarded(html, f"(?i){name}", pattern, "$1$2$2")
    return normalize_text(html)


def stabilize_text(text: Column) -> Column:
    """``normalize_text``, and placeholders for counts and relative times; idempotent.

    Opt-in, as plain numbers may be what a page is about: only grouped numbers, short forms such as 1.2k, and numbers before
    a word of counting are replaced.
    """
    text = normalize_text(text)
    for guard, (pattern, mark) in zip(["(?i)ago", "(?i)in", "(?i)just|yester|moments", ",", "[kKmM]", "(?i)s"], R.VOLATILE_COUNTS, strict=True):
        text = _guarded(text, guard, pattern, mark)
    return text


# One of these is in every text that ``stabilize_text`` changes.
_CHANGES = (r"(?i)[0-9@]|bearer|eyj|sk-|pk-|ghp_|xox|[a-f]{8}|(?<![a-z0-9_])an?" + R.WS + "+(?:second|minute|hour|day|week|month|year)"
            "|just now|yesterday|moments ago")


def stabilize_html(html: Column) -> Column:
    """F06 over markup: R09, then counts and relative times between tags; attributes keep their numbers."""
    html = normalize_html(html)
    tokens = F.regexp_extract_all(html, F.lit(r"(<[^>]*>|[^<]+|<)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(
        t.startswith("<") | ~t.rlike(_CHANGES), t).otherwise(stabilize_text(t))), "")


def label_key(label: Column) -> Column:
    """Label form for dedupe: lower case, digits as ``#``, blanks collapsed."""
    return collapse(F.regexp_replace(F.lower(label), r"\d", "#"))
