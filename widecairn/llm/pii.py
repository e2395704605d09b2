"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Spans that the four base rules find are always kept.  Generators then propose further,
overlapping spans that the rules don't reach: addresses written out with "at" or "dot",
every run of neighbouring groups of digits that has as many as a phone or card number,
addresses of hexadecimal groups.  Trees that are fitted on generated examples
(``examples``: seeded, the same at every input size) score each proposal from its format
and the words about it; a proposal stays if its score reaches its kind's threshold, which
is calibrated on generated examples held out from the fit.  Of overlapping proposals the
likeliest stays, and none may overlap a base span.  The work in one text grows as its
length times the logarithm of the number of its spans.

Null text counts as empty and has no spans; offsets are code points, ends exclusive.
Every row, repeated or not, has its own spans; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from ._boost import Trees
from ._frames import column, field, map_batches, map_rows, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The base rules.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: An address can only start where no digit stands before: the first digit of a run takes the whole run.
_ip = re.compile(r"(?<![0-9])" + IP).finditer
_card = re.compile(CARD).finditer
_phone = re.compile(PHONE).finditer
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").finditer
_digit = re.compile(r"[0-9]").search
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, int]  # start, number of kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Valid matches of the four rules, leftmost and non-overlapping within a kind."""
    out: list[Span] = []
    if "@" in text:
        free = 0
        for m in _domain(text):
            start = m.start()
            while start > free and text[start - 1] in _local:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                free = m.end()
    if _digit(text):
        for m in _ip(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _card(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- proposals ------------------------------------------------------------------------

_at = re.compile(r"[aA][tT](?=[\s)\]}])").finditer
_after_at = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\sdot\s)[A-Za-z0-9-]+)+", re.I).match
#: Digits with up to three separators between: a run of groups.
_run = re.compile(r"[0-9]+(?:[ ().\-/]{1,3}[0-9]+)*").finditer
_group = re.compile(r"[0-9]+").finditer
_hextets = re.compile(r"(?<![0-9A-Fa-f:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)(?:[0-9A-Fa-f]{1,4}|:)(?::?[0-9A-Fa-f]{1,4}|::?)*(?![0-9A-Fa-f:])").finditer
#: Fewest and most digits of a phone and of a card number.
PHONE_DIGITS, CARD_DIGITS = (7, 15), (12, 19)


def is_hextets(s: str) -> bool:
    """Eight groups of hexadecimal digits, or fewer and one gap."""
    groups = s.split(":")
    if s.count("::") > 1 or ":::" in s or (s[0] == ":" and s[:2] != "::") or (s[-1] == ":" and s[-2:] != "::"):
        return False
    filled = sum(g != "" for g in groups)
    return filled == 8 if "::" not in s else 2 <= filled <= 7


def spelled_at(text: str) -> Iterator[tuple[int, int]]:
    """Where each "at" in brackets or between white space begins and ends, one character of white space around it included."""
    for m in _at(text):
        a, e = m.span()
        prev, nxt = text[a - 1 : a], text[e]
        if prev + nxt in ("()", "[]", "{}"):
            yield a - 1 - text[a - 2 : a - 1].isspace(), e + 1 + text[e + 1 : e + 2].isspace()
        elif prev.isspace() and nxt.isspace():
            yield a - 1, e + 1


def number_spans(text: str) -> list[Span]:
    """Every run of neighbouring groups of digits that could be a phone or card number; a group begins fewer of them than it has digits to go."""
    out: list[Span] = []
    for m in _run(text):
        if m.end() - m.start() < PHONE_DIGITS[0]:
            continue
        groups = [g.span() for g in _group(text, m.start(), m.end())]
        for i, (start, _) in enumerate(groups):
            n, first = 0, start - (text[start - 1 : start] == "(")
            for a, b in groups[i:]:
                n += b - a
                if n > CARD_DIGITS[1]:
                    break
                if PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1]:
                    out.append((first, 3, b))
                if CARD_DIGITS[0] <= n:
                    out.append((start, 2, b))
    return out


def proposals(text: str) -> list[Span]:
    """Candidate spans besides the base ones; they may overlap."""
    out: list[Span] = []
    free = 0
    for before, after in spelled_at(text):
        start = before
        while start > free and text[start - 1] in _local:
            start -= 1
        if start < before and (d := _after_at(text, after)):
            out.append((start, 0, d.end()))
            free = after
    if _digit(text):
        out += number_spans(text)
    if ":" in text:
        out += [(m.start(), 1, m.end()) for m in _hextets(text) if is_hextets(m.group())]
    return out


#: Words near a span that speak for a kind, or against any.
CONTEXT = {
    0: ("mail", "email", "e-mail", "contact", "write", "reach", "address"),
    1: ("ip", "host", "server", "address", "from", "login"),
    2: ("card", "visa", "credit", "debit", "mastercard", "payment", "pay", "cc"),
    3: ("phone", "call", "tel", "telephone", "mobile", "cell", "fax", "ring", "dial", "contact", "whatsapp"),
}
AGAINST = ("version", "isbn", "order", "build", "release", "id", "no", "ref", "pages", "page", "serial", "invoice", "score", "date", "dated", "on", "ratio", "art", "section")
_word = re.compile(r"[\w-]+").findall


#: Ends of addresses that speak for one.
TAILS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "it", "nl", "co")
_near_digit_before = re.compile(r"[0-9][ ().\-/]{1,3}$").search
_near_digit_after = re.compile(r"[ ().\-/]{1,3}[0-9]").match


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    start, kind, end = span
    s = text[start:end]
    digits = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    before = [w.lower() for w in _word(text[max(0, start - 40) : start])[-4:]]
    after = [w.lower() for w in _word(text[end : end + 24])[:2]]
    prev, nxt = text[start - 1 : start], text[end : end + 1]
    year = any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    low = s.lower()
    return [
        float(kind == 0), float(kind == 1), float(kind == 2), float(kind == 3),
        len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], len(s),
        s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("("), float(s.count("(") == s.count(")")),
        float(luhn(digits)) if digits else 0.0, float(digits[:1] in ("3", "4", "5", "6")), float(len(set(digits))), float(year),
        float(prev.isalnum() or prev in ("-", ".", "/", "#", "_", "$", "+")), float(nxt.isalnum() or nxt in ("-", "/", "%", "_")),
        float(sum(w in CONTEXT[kind] for w in before)), float(sum(w in AGAINST for w in before)), float(sum(w in CONTEXT[kind] for w in after)),
        float(sizes[-3:] == [3, 3, 4] or sizes[-2:] == [3, 4]), float(max(sizes) == min(sizes) == 4),
        float(bool(_near_digit_before(text[max(0, start - 4) : start]))), float(bool(_near_digit_after(text[end : end + 4]))),
        float(any(x in low for x in ("(at)", "[at]", "{at}"))), float("dot" in low), float(re.split(r"[^a-z]+", low)[-1] in TAILS),
        float(len(set(re.findall(r"[ ().\-/]+", s)))), float("::" in s), float(any(c in "abcdef" for c in low)),
    ]


def examples(count: int, seed: int) -> tuple[list[tuple[str, Span]], np.ndarray]:
    """Generated candidates in context and whether each is personal data."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice(("er", "an", "the", "in", "on", "de", "sch", "re", "ción", "eau", "st")) for _ in range(r.randint(1, 4)))
    fill = lambda n: " ".join(w() for _ in range(n))
    h = lambda: f"{r.randrange(1, 65536):x}"

    def card() -> str:
        s = r.choice("3456") + d(14)
        return next(s + c for c in "0123456789" if luhn(s + c))

    def phone() -> tuple[str, str, str]:
        return str(r.randint(201, 989)), d(3), d(4)

    def good(kind: int) -> str:
        if kind == 0:
            at = r.choice((" (at) ", " [at] ", "(at)", " at ", "[at]", " {at} "))
            dot = r.choice((" (dot) ", " [dot] ", "(dot)", " dot ", "[dot]", ".", "."))
            return f"{w()}{r.choice(('', '.' + w(), d(2), '.' + d(2)))}{at}{w()}{r.choice(('', d(1)))}{r.choice(('', dot + w()))}{dot}{r.choice(('com', 'org', 'net', 'de', 'io'))}"
        if kind == 1:
            full = [h() for _ in range(8)]
            i = r.randint(1, 6)
            return ":".join(full) if r.random() < 0.5 else ":".join(full[:i]) + "::" + ":".join(full[r.randint(i + 1, 8) :])
        if kind == 2:
            return r.choice((".", "/")).join((c := card())[i : i + 4] for i in range(0, 16, 4))
        a, b, c = phone()
        return r.choice((f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"00{d(2)} {a} {b}{c}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)}/{d(4)}{d(3)}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}"))

    def bad(kind: int) -> str:
        if kind == 0:
            return r.choice((f"{w()} at {w()} dot {w()}", f"{w()} at {w()}.{w()}", f"{w()} at {d(1)}.{d(2)}"))
        if kind == 1:
            return r.choice((":".join(f"{r.randrange(60):02d}" for _ in range(8)), f"{r.choice(('std', 'a', 'fee', 'de'))}::{r.choice(('add', 'be', 'c', 'face'))}", f"{d(2)}::{d(2)}"))
        if kind == 2:
            s = r.choice((d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}.{d(4)}.{d(4)}.{d(4)}", f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", d(r.randint(12, 19))))
            return s if not luhn(_digits(s)) else s[:-1] + str((int(s[-1]) + 1) % 10)
        return r.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.19{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"19{d(2)}-20{d(2)}", f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)}", f"20{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(2)}-{d(7)}", f"{d(5)}.{d(4)}", f"{d(3)}.{d(6)}", f"{d(1)} {d(2)} {d(3)} {d(2)}", d(r.randint(7, 15)), d(r.randint(7, 15)), d(16)))

    out, y = [], []
    while len(out) < count:
        kind, positive = r.randrange(4), r.random() < 0.45
        s = good(kind) if positive else bad(kind)
        lead, ends = fill(r.randint(1, 6)), fill(3)
        bare = kind == 3 and s.isdigit()  # ten digits alone are a number of any sort
        if positive and (bare or r.random() < 0.6) or r.random() < 0.05:
            lead += " " + r.choice(CONTEXT[kind]) + r.choice(("", ":", " at", " me:"))
        elif not positive and r.random() < 0.5:
            lead += " " + r.choice(AGAINST)
        # Other numbers right beside it, of which proposals are made too.
        if kind == 3 and r.random() < 0.25:
            lead += " " + r.choice((f"20{d(2)}", d(2), "-".join(phone()) + r.choice((" /", ",", ""))))
        if kind == 3 and r.random() < 0.25:
            ends = r.choice((f"20{d(2)}", d(r.randint(1, 2)), f"/ {'-'.join(phone())}")) + " " + ends
        text = f"{lead} {s}{r.choice((' ', ' ', '. ', ', '))}{ends}"
        start = len(lead) + 1
        for span in proposals(text):
            if span[0] < start + len(s) and span[2] > start and (span[1] == kind or not positive):
                out.append((text, span))
                y.append(float(positive and span == (start, kind, start + len(s))))
    return out[:count], np.array(y[:count])


#: Generated examples for the fit and for the thresholds, and the precision that a threshold must reach on the latter.
FIT_EXAMPLES, CALIBRATION_EXAMPLES, PRECISION = 8000, 8000, 0.985


@lru_cache(maxsize=2)
def fitted(seed: int = 11) -> tuple[Trees, tuple[float, ...]]:
    """The trees and the threshold of each kind."""
    found, y = examples(FIT_EXAMPLES, seed)
    trees = Trees(rounds=100, depth=4).fit(np.array([features(*e) for e in found]), y)
    found, y = examples(CALIBRATION_EXAMPLES, seed + 1)
    p, kinds = trees.predict(np.array([features(*e) for e in found])), np.array([e[1][1] for e in found])
    out = []
    for k in range(len(KINDS)):
        q, t = p[kinds == k], y[kinds == k]
        order = np.argsort(-q)
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        out.append(float(max(q[order][good[-1]], 0.5)) if len(good) else 1.1)
    return trees, tuple(out)


class Taken:
    """Disjoint intervals in order: whether another is free of them takes a binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):  # base spans of different kinds may overlap
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k < 0 or self.ends[k] <= a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def added_spans(text: str, base: list[Span], trees: Trees, thresholds: tuple[float, ...]) -> list[Span]:
    """Proposals that the trees accept, disjoint from the base spans and each other: the likeliest first, of equals the longest."""
    taken = Taken([(a, b) for a, _, b in base])
    found = [s for s in dict.fromkeys(proposals(text)) if taken.free(s[0], s[2])]
    out = []
    for lo in range(0, len(found), PROPOSALS_TOGETHER):
        some = found[lo : lo + PROPOSALS_TOGETHER]
        p = trees.predict(np.array([features(text, s) for s in some]))
        out += [(-q, s[0] - s[2], s) for q, s in zip(p.tolist(), some) if q >= thresholds[s[1]]]
    kept = []
    for _, _, s in sorted(out):
        if taken.free(s[0], s[2]):
            kept.append(s)
            taken.add(s[0], s[2])
    return kept


#: Proposals of a text whose features are held at a time.
PROPOSALS_TOGETHER = 10_000


def redact(text: str, spans: list[Span]) -> str:
    """The text with each group of overlapping spans replaced by the mark of its first kind."""
    out, at = [], 0
    spans = sorted(spans)
    i = 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def _line(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, with_output: bool = True) -> DataFrame:
    """Spans of personal data in every whole text, one row per row.

    Returns the id column, n_email, n_ip, n_card, n_phone (base spans), n_added (long),
    base_sha256 and spans (string), and with ``with_output`` the redacted text.  Other
    columns of any name are ignored.
    """
    trees, thresholds = fitted(seed)
    schema = f"{field(df, id_col)}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string" + ", redacted string" * with_output

    def run(batches):
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans", "redacted")}
            for text in b["_text"]:
                base = base_spans(text)
                more = added_spans(text, base, trees, thresholds)
                spans = sorted([*base, *more]) if more else base
                for k, n in enumerate(KINDS):
                    out[f"n_{n}"].append(sum(s[1] == k for s in base))
                out["n_added"].append(len(more))
                out["base_sha256"].append(hashlib.sha256(_line(base).encode()).hexdigest())
                out["spans"].append(_line(spans))
                if with_output:
                    out["redacted"].append(redact(text, spans) if spans else text)
            yield {id_col: b["_id"], **out}

    return map_batches(df.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), run, schema)


def redacted(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", seed: int = 11) -> DataFrame:
    """The rows, with all their columns, and their spans of personal data replaced by marks; null texts stay null."""
    trees, thresholds = fitted(seed)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = [*base, *added_spans(text, base, trees, thresholds)]
        return redact(text, spans) if spans else text

    return map_rows(df, text_col, lambda: lambda texts: (None, [clean(t) for t in texts]), length_col)
