"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues. At
each anchor a deterministic local parser expands left and right to the boundaries of what the anchor may
belong to, and a validator decides. No parser looks at a character more than a fixed number of times, so a text
takes linear time whatever is in it.

Kinds, in output order: `email`, `ip`, `card` (Luhn), `phone` (these four are the base kinds: leftmost, not
overlapping within a kind, a match that fails its check is dropped and not tried again), then `handle`
(@name), `login` (user part of scheme://user[:password]@host), `iban` (mod 97), `account` (a number after a cue
such as "account no"), and `secret` (a value of 8 characters
or more, with a digit, after a cue such as "token =" or, as in JSON, a quoted one; of 16 or more after "Bearer"). A cue begins where no letter or digit is before it. Spans count code points, end exclusive.

Defined cases: a null or empty text has no spans; repeated rows are searched each on its own; a null id stays
null; other columns are ignored by `find` and kept by `redact`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from photolith.llm._bytes import columns, map_texts, with_own_id

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "handle", "login", "iban", "account", "secret")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
WORD = LETTERS | DIGITS
NAME = WORD | {"_"}
PHONE = DIGITS | frozenset(" ().-")
USER = LETTERS | DIGITS | frozenset("._~%!$&'()*+,;=:-")
VALUE = LETTERS | DIGITS | frozenset("_-+/=.~")

ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "customer id", "passport", "ssn", "social security")
SECRET_CUES = ("token", "api_key", "apikey", "api key", "api-key", "access key", "private key", "secret", "password", "passwd", "pwd")

RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long"

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in DIGITS:
        found.add_word(c, ("digit", 1))
    for word, what in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("iban", "iban"), ("bearer", "bearer")):
        found.add_word(word, (what, len(word)))
    for what, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            found.add_word(cue, (what, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def run(text: str, at: int, members: frozenset, most: int | None = None) -> int:
    """The end of the run of members from `at`."""
    stop = len(text) if most is None else min(len(text), at + most)
    while at < stop and text[at] in members:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, whose local part may reach back to `floor`."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = run(text, end + 1, LABEL)
        labels += 1
    return (start, end) if labels > 1 else None


def ip_at(text: str, start: int) -> tuple[int, bool] | None:
    """The end of four dotted numbers, and whether each is at most 255."""
    at, good = start, True
    for part in range(4):
        if part:
            if at >= len(text) or text[at] != ".":
                return None
            at += 1
        end = run(text, at, DIGITS)
        if end == at:
            return None
        good = good and int(text[at:end].lstrip("0")[:4] or 0) <= 255
        at = end
    return at, good


def card_at(text: str, start: int) -> tuple[int, bool]:
    """The end of a run of digits with single spaces or hyphens, and whether it is a card number."""
    at, size = start + 1, len(text)
    while at < size:
        if text[at] in DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < size and text[at + 1] in DIGITS:
            at += 2
        else:
            break
    if at - start < 16 or at - start > 37:
        return at, False
    digits = text[start:at].replace(" ", "").replace("-", "")
    return at, 16 <= len(digits) <= 19 and luhn(digits)


def phone_at(text: str, plus: int) -> tuple[int, bool] | None:
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = run(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in DIGITS:
        return None
    return end, 8 <= sum(c in DIGITS for c in text[plus:end]) <= 15


def handle_at(text: str, at: int) -> tuple[int, int] | None:
    if at and text[at - 1] in LOCAL | {"@", "/"}:
        return None
    end = run(text, at + 1, NAME, 31)
    return (at, end) if 3 <= end - at - 1 <= 30 and text[at + 1] in LETTERS else None


def login_at(text: str, end: int) -> tuple[int, int] | None:
    """The user part after `://`."""
    stop = run(text, end, USER)
    return (end, stop) if stop > end and stop < len(text) and text[stop] == "@" else None


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    while at < len(text) and text[at] in " :=#":
        at += 1
    end, kept = at, []
    while end < len(text) and len(kept) < 34 and (text[end] in LETTERS or text[end] in DIGITS or text[end] == " " and end + 1 < len(text) and text[end + 1] in NAME):
        if text[end] != " ":
            kept.append(text[end].upper())
        end += 1
    for size in range(len(kept), 14, -1):
        code = "".join(kept[:size])
        if code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            end, left = at, size
            while left:
                left -= text[end] != " "
                end += 1
            return at, end
    return None


def account_at(text: str, at: int) -> tuple[int, int] | None:
    for filler in (" ", "number", "no", ".", " ", "#", ":", "=", " "):
        while text[at : at + len(filler)].lower() == filler and len(filler) and at < len(text):
            at += len(filler)
            if len(filler) > 1:
                break
    end = run(text, at, DIGITS | {"-"})
    while end > at and text[end - 1] == "-":
        end -= 1
    digits = sum(c in DIGITS for c in text[at:end])
    return (at, end) if 6 <= digits <= 34 and text[at] in DIGITS else None


class Run:
    """The last run of a value's characters, so that cues inside it don't go through it again."""

    def __init__(self):
        self.start, self.end, self.last_digit = 0, 0, -1

    def to(self, text: str, at: int) -> None:
        if not self.start <= at < self.end:
            self.start, self.end, self.last_digit = at, run(text, at, VALUE), -1
            for i in range(self.end - 1, at - 1, -1):
                if text[i] in DIGITS:
                    self.last_digit = i
                    break


def secret_at(text: str, at: int, value: Run) -> tuple[int, int] | None:
    while at < len(text) and text[at] in " \t\"'":
        at += 1
    if at >= len(text) or text[at] not in "=:":
        return None
    while at < len(text) and text[at] in "=:> \t\"'":
        at += 1
    value.to(text, at)
    return (at, value.end) if value.end - at >= 8 and value.last_digit >= at else None


def bearer_at(text: str, at: int, value: Run) -> tuple[int, int] | None:
    """The value after `Bearer`, which needs no sign between."""
    start = run(text, at, frozenset(" \t"))
    if start == at or start >= len(text):
        return None
    value.to(text, start)
    return (start, value.end) if value.end - start >= 16 and value.last_digit >= start else None


def find_spans(text: str | None, anchors) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind found, in order of their starts."""
    found: dict[str, list[tuple[int, int]]] = {}
    if not text:
        return found
    folded = text.lower()
    if len(folded) != len(text):
        folded = text.translate(_ASCII_LOWER)
    floor, value = dict.fromkeys(KINDS, 0), Run()

    def keep(kind: str, span: tuple[int, int] | None) -> None:
        if span and span[0] >= floor[kind]:
            found.setdefault(kind, []).append(span)
            floor[kind] = span[1]

    for last, (what, size) in anchors.iter(folded):
        at = last - size + 1
        if what == "digit":
            if at >= floor["ip"] and (at == floor["ip"] or text[at - 1] not in DIGITS) and (ip := ip_at(text, at)):
                floor["ip"] = ip[0]
                if ip[1]:
                    found.setdefault("ip", []).append((at, ip[0]))
            if at >= floor["card"]:
                end, good = card_at(text, at)
                floor["card"] = end
                if good:
                    found.setdefault("card", []).append((at, end))
        elif what == "at":
            mail = email_at(text, at, floor["email"])
            keep("email", mail)
            if not mail:
                keep("handle", handle_at(text, at))
        elif what == "plus":
            if at >= floor["phone"] and (phone := phone_at(text, at)):
                floor["phone"] = phone[0]
                if phone[1]:
                    found.setdefault("phone", []).append((at, phone[0]))
        elif what == "scheme":
            keep("login", login_at(text, last + 1))
        elif what == "iban":
            keep("iban", iban_at(text, last + 1))
        elif not at or folded[at - 1] not in WORD:
            if what == "account":
                keep(what, account_at(text, last + 1))
            else:
                keep("secret", (bearer_at if what == "bearer" else secret_at)(text, last + 1, value))
    return found


def rendered(found: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(found.get(k, ())))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts and spans for each row of `df`; one pass, no shuffle."""
    made: list = []

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(automaton())
        each = [find_spans(t, made[0]) for t in batch.column(1).to_pylist()]
        arrays = [batch.column(0)]
        arrays += [pa.array([len(x.get(k, ())) for x in each], type=pa.int64()) for k in BASE_KINDS]
        arrays.append(pa.array([hashlib.sha256(rendered(x, BASE_KINDS).encode()).hexdigest() for x in each], type=pa.string()))
        arrays.append(pa.array([rendered(x) for x in each], type=pa.string()))
        arrays.append(pa.array([sum(len(v) for k, v in x.items() if k not in BASE_KINDS) for x in each], type=pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in RESULT.split(", ")])

    return map_texts(columns(df, doc_id=id_col, text=text_col), part, with_own_id(RESULT, df, id_col))


def redacted(text: str | None, found: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not found or text is None:
        return text
    every = sorted((a, -b, KINDS.index(k)) for k, v in found.items() for a, b in v)
    out, at, i = [], 0, 0
    while i < len(every):
        start, end, kind = every[i][0], -every[i][1], every[i][2]
        i += 1
        while i < len(every) and every[i][0] < end:
            end, kind = max(end, -every[i][1]), min(kind, every[i][2])
            i += 1
        out += (text[at:start], f"[{KINDS[kind].upper()}]")
        at = end
    return "".join((*out, text[at:]))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with the spans in its texts replaced; the other columns stay."""
    made: list = []
    at = df.columns.index(text_col)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(automaton())
        texts = pa.array([redacted(t, find_spans(t, made[0])) for t in batch.column(at).to_pylist()], type=batch.column(at).type)
        return pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return map_texts(df, part, df.schema, text=text_col)
