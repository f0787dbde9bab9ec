"""Personal data by anchors: an Aho-Corasick pass finds where it can be, local parsers find its bounds.

Anchors are the at-sign (email), a plus and digits (phone, card, ip), a scheme
with its slashes (login in an address) and words that announce an account
number or a social security number. From an anchor a parser walks as far as
characters allow and validates what it has: no text is searched twice, and no
expression can run over the whole of it.

Kinds. ``email``, ``ip``, ``card`` and ``phone`` are the leftmost
non-overlapping matches of these expressions, failing ones dropped:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+){3}, parts at most 255
    card   [0-9]([ -]?[0-9])+, 14 to 19 digits that pass Luhn
    phone  \\+[0-9][ ().0-9-]+[0-9], 10 to 15 digits

``login`` is an address with a user and a password before its host. The others
follow a cue, in any case, and then marks, a line break or words such as
"number is": ``iban`` an account number that passes mod 97, ``ssn`` three, two
and four digits with hyphens, ``routing`` nine digits with their check digit,
``account`` 6 to 17 digits, ``passport`` 6 to 9 letters and digits. ``secret`` is
the value given to a password, token or key, or a key that shows by its prefix
and length; or a private key in its marks. Spans are code points, the end
exclusive, and may overlap between kinds.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import once_a_worker

KINDS = ("email", "ip", "card", "phone", "login", "iban", "ssn", "routing", "account", "passport", "secret")
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "routing": ("routing",),
    "account": ("account", "acct"),
    "passport": ("passport",),
    "given": ("password", "passwd", "passphrase", "secret", "token", "api key", "api_key", "api-key", "apikey", "access key", "access_key"),
}
# Prefixes of keys that services hand out, and how many characters follow, at least and at most.
PREFIXES = {
    "AKIA": (16, 16),
    "ASIA": (16, 16),
    "AIza": (35, 35),
    "ghp_": (36, 255),
    "gho_": (36, 255),
    "ghs_": (36, 255),
    "github_pat_": (36, 255),
    "xoxb-": (20, 255),
    "xoxp-": (20, 255),
    "sk-": (20, 255),
}
_BLOCK = "-----begin"

_DIGITS = frozenset(string.digits)
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_WORD = frozenset(string.ascii_letters + string.digits)
_KEY = frozenset(string.ascii_letters + string.digits + "_-")
_PHONE = frozenset(string.digits + " ().-")
_GAP = frozenset(" :#.-=\t\r\n\"'")
# Words between a cue and what it announces.
_JOINING = ("numbers", "number", "num", "no", "nr", "is", "was", "are", "code", "id")
# How far an identifier may lie behind the end of its cue.
_REACH = 32
_IBAN_MOST = 34

SPANS = "array<struct<kind: string, start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in string.digits:
        found.add_word(digit, "number")
    found.add_word("@", "email")
    found.add_word("+", "phone")
    found.add_word("://", "login")
    # Texts are searched in small letters.
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, kind)
    for prefix in PREFIXES:
        found.add_word(prefix.lower(), prefix)
    found.add_word(_BLOCK, "block")
    found.make_automaton()
    return found


def _run(text: str, at: int, chars: frozenset, most: int | None = None) -> int:
    """Where the characters of a set end, from ``at`` on."""
    end = len(text) if most is None else min(len(text), at + most)
    while at < end and text[at] in chars:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _LABEL:
        end = _run(text, end + 1, _LABEL)
        labels += 1
    return (start, end) if labels > 1 else None


def _ip(text: str, at: int) -> tuple[int, bool] | None:
    """The end of four numbers with dots, and whether each is at most 255."""
    parts, end = [], at
    for i in range(4):
        if i:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        start, end = end, _run(text, end, _DIGITS)
        if start == end:
            return None
        parts.append(text[start:end])
    return end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _card(text: str, at: int) -> tuple[int, bool]:
    """The end of the digits from ``at``, single blanks or hyphens between them, and whether they are a card number."""
    end = at + 1
    while end < len(text):
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    # The digits of a number of any length are counted, but only short ones looked at.
    if end - at > 2 * 19:
        return end, False
    digits = text[at:end].replace(" ", "").replace("-", "")
    return end, 14 <= len(digits) <= 19 and _luhn(digits)


def _phone(text: str, at: int) -> tuple[int, bool] | None:
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    last = _run(text, at + 2, _PHONE) - 1
    while last >= at + 3 and text[last] not in _DIGITS:
        last -= 1
    if last < at + 3:
        return None
    return last + 1, 10 <= sum(c in _DIGITS for c in text[at : last + 1]) <= 15


def _login(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """A scheme before ``://``, then user, colon, password, at-sign and a host."""
    start = at
    while start > floor and text[start - 1] in _LABEL:
        start -= 1
    user = _run(text, at + 3, _LOCAL)
    if start == at or user == at + 3 or user >= len(text) or text[user] != ":":
        return None
    word = user + 1
    while word < len(text) and text[word] not in "@/ \t\r\n\v\f":
        word += 1
    if word == user + 1 or word >= len(text) or text[word] != "@":
        return None
    end = _run(text, word + 1, _LABEL | {"."})
    while end > word + 1 and text[end - 1] == ".":
        end -= 1
    return (start, end) if end > word + 1 else None


def _announced(text: str, at: int) -> int:
    """Where what a cue announces begins: behind marks and joining words."""
    most = min(len(text), at + _REACH)
    while True:
        at = _run(text, at, _GAP, most - at)
        end = _run(text, at, _WORD, most - at)
        if end == at or text[at:end].lower() not in _JOINING:
            return at
        at = end


def _iban(text: str, start: int) -> tuple[int, int] | None:
    kept, end, at = "", start, start
    while at < len(text) and len(kept) < _IBAN_MOST:
        char = text[at]
        if char.isascii() and char.isalnum():
            kept, end = kept + char.upper(), at + 1
            if len(kept) >= 15 and (at + 1 == len(text) or not text[at + 1].isalnum()) and _mod97(kept):
                return start, end
        elif char != " ":
            break
        at += 1
    return None


def _mod97(code: str) -> bool:
    if not (code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _ssn(text: str, start: int) -> tuple[int, int] | None:
    piece = text[start : start + 11]
    shape = "".join("9" if c in _DIGITS else c for c in piece)
    follows = text[start + 11 : start + 12]
    if shape != "999-99-9999" or follows in _DIGITS or piece[:3] in ("000", "666") or piece[0] == "9":
        return None
    return start, start + 11


def _digits(text: str, start: int) -> str:
    """A run of digits that no letter follows."""
    end = _run(text, start, _DIGITS, 40)
    return "" if text[end : end + 1].isalnum() else text[start:end]


def _routing(text: str, start: int) -> tuple[int, int] | None:
    digits = _digits(text, start)
    valid = len(digits) == 9 and digits != "0" * 9 and sum(int(d) * (3, 7, 1)[i % 3] for i, d in enumerate(digits)) % 10 == 0
    return (start, start + 9) if valid else None


def _account(text: str, start: int) -> tuple[int, int] | None:
    digits = _digits(text, start)
    return (start, start + len(digits)) if 6 <= len(digits) <= 17 else None


def _passport(text: str, start: int) -> tuple[int, int] | None:
    end = _run(text, start, _WORD, 10)
    code = text[start:end]
    valid = 6 <= len(code) <= 9 and sum(c in _DIGITS for c in code) >= 5 and code == code.upper()
    return (start, end) if valid and not text[end : end + 1].isalnum() else None


def _given(text: str, at: int) -> tuple[int, int] | None:
    """The value of a password or key: after a mark, at least eight characters of two sorts without blanks."""
    start = _announced(text, at)
    if not any(c in "=:" for c in text[at:start]):
        return None
    end = start
    while end < len(text) and not text[end].isspace() and text[end] not in "\"'`,;<>()":
        end += 1
    while end > start and text[end - 1] in ".!?":
        end -= 1
    value = text[start:end]
    sorts = (any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value))
    return (start, end) if len(value) >= 8 and sum(sorts) >= 2 else None


def _key(text: str, end: int, prefix: str) -> tuple[int, int] | None:
    """A key by its prefix, which ends at ``end``; digits tell it from words."""
    start = end - len(prefix)
    if text[start:end] != prefix or text[start - 1 : start].isalnum():
        return None
    least, most = PREFIXES[prefix]
    last = _run(text, end, _WORD if least == most == 16 else _KEY, most + 1)
    value = text[end:last]
    return (start, last) if least <= len(value) <= most and any(c in _DIGITS for c in value) else None


def _block(text: str, lower: str, at: int) -> tuple[int, int] | None:
    """A private key with its marks, or up to the end of the text if it is cut."""
    start = at - len(_BLOCK)
    if "private key-----" not in lower[at : at + 40]:
        return None
    end = lower.find("-----end", at)
    close = lower.find("-----", end + 8) if end >= 0 else -1
    return start, close + 5 if close >= 0 else len(text)


_PARSERS = {"iban": _iban, "ssn": _ssn, "routing": _routing, "account": _account, "passport": _passport}


def _lower(text: str) -> str:
    """Small letters at the same places."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by kind as ``KINDS`` lists them."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    # Where the next match of a kind may begin.
    email = ip = card = phone = login = 0
    digits = block = -1
    lower = _lower(text)
    for last, kind in once_a_worker("pii anchors", _anchors).iter(lower):
        if kind == "number":
            if last >= card:
                end, valid = _card(text, last)
                if end > last + 1:
                    card = end
                if valid:
                    found.append(("card", last, end))
            # An address begins where a run of digits does.
            if last > digits:
                digits = _run(text, last, _DIGITS) - 1
                if last >= ip and (four := _ip(text, last)):
                    ip = four[0]
                    if four[1]:
                        found.append(("ip", last, ip))
        elif kind == "email":
            if span := _email(text, last, email):
                email = span[1]
                found.append(("email", *span))
        elif kind == "phone":
            if last >= phone and (number := _phone(text, last)):
                phone = number[0]
                if number[1]:
                    found.append(("phone", last, phone))
        elif kind == "login":
            if span := _login(text, last - 2, login):
                login = span[1]
                found.append(("login", *span))
        elif kind in _PARSERS:
            if span := _PARSERS[kind](text, _announced(text, last + 1)):
                found.append((kind, *span))
        elif kind == "block":
            if last > block and (span := _block(text, lower, last + 1)):
                block = span[1]
                found.append(("secret", *span))
        elif span := _given(text, last + 1) if kind == "given" else _key(text, last + 1, kind):
            found.append(("secret", *span))
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (s[1], order[s[0]], s[2]))


def redact_text(text: str | None) -> str | None:
    """The text with each span, overlapping ones together, replaced by the kind of the first."""
    spans = find(text)
    if not spans:
        return text
    kept, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i < len(spans) and spans[i][1] < end or spans[i : i + 1] == [(kind, start, end)]:
            end = max(end, spans[i][2])
            i += 1
        kept += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*kept, text[at:]])


def _on_text(column: Column, apply, kind: pa.DataType, ddl: str) -> Column:
    @F.arrow_udf(ddl)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([apply(t) for t in texts.to_pylist()], kind)

    return run(column)


def personal_spans(text: Column) -> Column:
    """The spans of personal data in ``text`` as ``array<struct<kind, start, end>>``.

    Null and empty texts have none. A column, so other columns and repeated
    rows are as the caller has them; one pass over each whole text.
    """

    def spans(value: str | None) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in find(value)]

    return _on_text(text, spans, _SPANS, SPANS)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; null texts stay null."""
    return docs.withColumn(text, _on_text(F.col(text), redact_text, pa.string(), "string"))
