"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, a plus before a digit, digit pairs (next to one
another or with a point, blank or hyphen between), URL schemes and identifier cues. Around each anchor a
deterministic local parser expands to the left and right and validates what it finds.

Base kinds, leftmost and non-overlapping within a kind, failing candidates dropped without a retry:
  email  local@label(.label)+
  ip     four dotted digit runs, each at most 255
  card   digits with single blanks or hyphens between, 16 to 19 digits, Luhn
  phone  + and 8 to 15 digits with blanks, points, brackets or hyphens between
Kinds that anchors add:
  account  the value after a cue and a separator (`token = ...`, `API key: ...`, `IBAN: ...`), or a value that begins as
           the keys of well-known services do. It is judged by its shape: an account number by the IBAN's check digits or by 6
           digits at least, a secret by 8 characters at least with two digits (or one and other signs) among letters, or by
           20 characters at least with capitals inside (see `secret_shape`)
  login    a URL that carries user:password@
Cues and schemes count in any case, a cue's words may be joined by a blank, hyphen or underscore; values and passwords have no greatest length.

Null or empty text: no spans. Repeated rows: each row is answered. Extra columns are ignored by `find`
and kept by `redact`.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_LOWER, by_text, sha256_hex

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = ("email", "ip", "card", "phone", "account", "login")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What lies between a cue's stem and its separator: the rest of the cue's words, of any length.
WORDS = re.compile(r"[A-Za-z0-9_ -]*")
#: A quote, a separator that must be there, a quote.
SEPARATOR = re.compile(r"[\"']?\s*(?::=|[:=#]|=>)>?\s*[\"']?(?:(?:Bearer|Basic)\s+)?(?=[A-Za-z0-9+/])")
#: The separator that is a word, near the cue.
IS = re.compile(r"[A-Za-z0-9_ -]{0,24}?[\"']?\s{0,3}\bis\b\s{0,3}[\"']?(?:(?:Bearer|Basic)\s+)?(?=[A-Za-z0-9+/])")
#: Beside a cue without a separator: the rest of its word, perhaps a word for number.
BESIDE = re.compile(r"[^\W\d_]*?(\s*(?:number|nummer|numéro|número|numero|num|no|nr|n°)\b\.?)?\s+")
NUMBER, SSN = re.compile(r"[0-9](?:[ -]?[0-9]){5,}(?![0-9A-Za-z])"), re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: After a passphrase of letters alone nothing may follow on its line but a closing mark.
ENDS_THERE = re.compile(r"[\"')\]]*(?:\s*$|[\n,;.!?])")
#: A value, of any length.
VALUE = re.compile(r"[A-Za-z0-9_./+=~-]+")
#: How keys of well-known services begin; they need no cue.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ")
PREFIXED = re.compile(r"[A-Za-z0-9_.-]{16,}")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s@/]+@[A-Za-z0-9.-]+")

#: Stems of cues, lower-cased and without what may stand between their words.
CUES = ("apikey", "accesskey", "privatekey", "secret", "token", "credential", "iban", "account", "konto", "compte", "cuenta", "passport", "ssn")
#: Those of passwords, in the languages of the corpus; what follows them may be letters alone.
PASSWORD_CUES = ("password", "passwd", "pwd", "passwort", "kennwort", "mot de passe", "contraseña", "contrasena")
#: The stems as anchors: words may be written together or with a blank, hyphen or underscore between.
CUE_FORMS = {f"{head}{gap}key" for head in ("api", "access", "private") for gap in ("", " ", "-", "_")} | {c for c in CUES if not c.endswith("key")} | set(PASSWORD_CUES)
SCHEMES = ("http://", "https://", "ftp://")


def _automaton() -> ahocorasick.Automaton:
    """Of all anchors, for texts with A-Z lowered: cues and schemes count in any case."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for x in "0123456789":
        a.add_word(f"+{x}", ("phone", 2))
        for y in "0123456789":
            a.add_word(f"{x}.{y}", ("ip", 3))
            for gap in ("", " ", "-"):
                a.add_word(f"{x}{gap}{y}", ("card", 2 + len(gap)))
    for cue in CUE_FORMS:
        a.add_word(cue, ("account", len(cue)))
    for prefix in KEY_PREFIXES:
        a.add_word(prefix.lower(), ("key", len(prefix)))
    for scheme in SCHEMES:
        a.add_word(scheme, ("login", len(scheme)))
    a.make_automaton()
    return a


_AUTOMATON: ahocorasick.Automaton | None = None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _run_start(text: str, at: int, chars: frozenset, least: int) -> int:
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def _chain_start(text: str, at: int, least: int) -> int:
    """Leftmost start of the digit chain (single blanks or hyphens between digits) that holds position `at`."""
    while at > least:
        if text[at - 1] in DIGITS:
            at -= 1
        elif at - 1 > least and text[at - 1] in " -" and text[at - 2] in DIGITS:
            at -= 2
        else:
            break
    return at


def _dotted_start(text: str, at: int, least: int) -> int:
    while at > least:
        if text[at - 1] in DIGITS:
            at -= 1
        elif at - 1 > least and text[at - 1] == "." and text[at - 2] in DIGITS:
            at -= 2
        else:
            break
    return at


def iban_end(text: str, at: int) -> int | None:
    """End of the longest IBAN that starts at `at`: its check digits hold and no word character follows."""
    m = IBAN.match(text, at)
    end = m.end() if m else at
    while end - at >= 15:
        if text[end - 1] != " " and not text[end : end + 1].isalnum():
            plain = text[at:end].replace(" ", "").upper()
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                return end
        end -= 1
    return None


def secret_shape(value: str) -> bool:
    """Whether a value after a cue looks like a secret or a number, not like a word."""
    digits = sum(c in DIGITS for c in value)
    letters = sum(c.isalpha() for c in value)
    if letters == 0:
        return digits >= 6
    if len(value) < 8:
        return False
    return digits > 0 and (digits >= 2 or digits + letters < len(value)) or len(value) >= 20 and any(c.isupper() for c in value[1:]) and any(c.islower() for c in value)


def checkable(text: str, start: int, after: int) -> tuple[int, int] | None:
    """A value right beside a cue, without a separator: an IBAN, a social security number, or digits behind a word for number."""
    beside = BESIDE.match(text, after)
    if not beside:
        return None
    at = beside.end()
    if (end := iban_end(text, at)) is not None:
        return at, end
    m = SSN.match(text, at) if text[start:after].lower() == "ssn" else NUMBER.match(text, at) if beside[1] else None
    return m.span() if m else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text in code points, end exclusive; by kind as in KINDS, then start."""
    global _AUTOMATON
    if not text:
        return []
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys((*KINDS, "key"), 0)  # per kind: where the next candidate may start
    barren = 0  # up to here values were no secrets
    run_end, value_at = -1, None  # of the words behind the last cue: their end, and where a value begins behind a separator
    for last, (kind, width) in _AUTOMATON.iter(text.translate(ASCII_LOWER)):
        start = last + 1 - width
        if kind == "email":
            if start < done[kind]:
                continue
            left = _run_start(text, start, LOCAL_CHARS, done[kind])
            if left < start and (m := DOMAIN.match(text, start + 1)):
                found[kind].append((left, m.end()))
                done[kind] = m.end()
        elif start < done[kind]:
            continue
        elif kind == "card":
            left = _chain_start(text, start, done[kind])
            m = CHAIN.match(text, left)
            done[kind] = m.end()
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found[kind].append(m.span())
        elif kind == "ip":
            left = _dotted_start(text, start, done[kind])
            at = left
            while m := DOTTED.match(text, at):
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    found[kind].append(m.span())
                at = m.end()
                if text[at : at + 1] == "." and text[at + 1 : at + 2] in DIGITS and text[at + 1 : at + 2]:
                    at += 1
            while at < len(text) and (text[at] in DIGITS or text[at] == "." and text[at + 1 : at + 2] and text[at + 1] in DIGITS):
                at += 1
            done[kind] = at
        elif kind == "phone":
            if m := PHONE.match(text, start):
                done[kind] = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found[kind].append(m.span())
        elif kind == "account":
            if start and text[start - 1].isalnum():
                continue
            if last + 1 > run_end:  # cues of one run of words share what follows it
                run_end = WORDS.match(text, last + 1).end()
                m = SEPARATOR.match(text, run_end)
                value_at = m.end() if m else None
            m = IS.match(text, last + 1)
            at = m.end() if m and (value_at is None or m.end() < value_at) else value_at
            if at is None:
                if span := checkable(text, start, last + 1):
                    found[kind].append(span)
                    done[kind] = span[1]
            elif at >= barren:
                if (end := iban_end(text, at)) is None:
                    m = VALUE.match(text, at)
                    value = m[0].rstrip(".-=~") if m else ""
                    end = at + len(value)
                    phrase = len(value) >= 12 and value.isalpha() and text[start : last + 1].lower() in PASSWORD_CUES and ENDS_THERE.match(text, end)
                    if not secret_shape(value) and not phrase:
                        barren = max(barren, end)
                        if span := checkable(text, start, last + 1):
                            found[kind].append(span)
                            done[kind] = span[1]
                        continue
                found[kind].append((at, end))
                done[kind] = end
        elif kind == "key":
            begins = (start == 0 or not text[start - 1].isalnum()) and text.startswith(KEY_PREFIXES, start)
            if begins and start >= done["account"] and (m := PREFIXED.match(text, start)):
                done["key"] = m.end()  # what begins inside a value that is no secret is none either
                if secret_shape(m[0]):
                    found["account"].append(m.span())
                    done["account"] = m.end()
        elif m := LOGIN.match(text, last + 1):
            found[kind].append(m.span())
            done[kind] = m.end()
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = pa.schema([*((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans. Map-only: no shuffle."""

    def rows(texts: list[str | None]) -> tuple[None, list]:
        out = []
        for text in texts:
            spans = find_spans(text)
            base = [x for x in spans if x[0] in BASE_KINDS]
            out.append((*(sum(x[0] == k for x in base) for k in BASE_KINDS), sha256_hex(_joined(base)), _joined(spans)))
        return None, list(zip(*out, strict=True))

    return by_text(docs, rows, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", FOUND)


def mask(text: str | None) -> str | None:
    """The text with every found span, overlapping ones merged, replaced by `[kind]` of its first span."""
    spans = sorted(((s, -e, k) for k, s, e in find_spans(text)))
    if not spans:
        return text
    merged: list[list] = []
    for s, e, k in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -e)
        else:
            merged.append([s, -e, k])
    parts, at = [], 0
    for s, e, k in merged:
        parts += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with spans masked and n_chars, where there is such a column, counted anew. Null text stays null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(mask, na_action="ignore")

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out
