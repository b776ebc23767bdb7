"""Personal data in texts: anchors found by one automaton, spans found by local parsers around them.

An Aho-Corasick automaton runs over a text once and reports where an at-sign, a plus, a digit, a scheme or
a cue for an identifier stands. At each anchor the parser of its kind reads outwards as far as its
characters go, validates what it has, and moves its own position past what it has read, so that spans of
one kind never overlap and the leftmost wins. A parser that fails does not try again inside what it read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from kgspark.llm.common import columns, prepare, text_map

# Kinds of spans: the base ones in their order, then those that cues add.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "secret", "account")
ORDER = {k: i for i, k in enumerate(KINDS)}

# Words that announce a secret or an account, and prefixes of access keys.
SECRET_CUES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key")
ACCOUNT_CUES = ("account", "acct", "passport", "ssn", "customer id", "user id", "kontonummer", "cuenta", "compte")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk-", "sk_live_", "AIza")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
# Of any length: neither part goes beyond a slash, so that no two schemes read the same characters.
USER_INFO = re.compile(r"[^\s/?#@:]++(?::[^\s/?#@]*+)?+@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SECRET = re.compile(r"""["']?[\x20\t]{0,3}(?:=|:|=>)[\x20\t]{0,3}["']?([A-Za-z0-9_+/.~!@#$%^&*-]{6,})""")
ACCOUNT = re.compile(r"""(?: (?:number|no\.?|nr\.?|id))?[\x20\t]{0,3}[:=#]?[\x20\t]{0,3}([0-9](?:[\x20-]?[0-9]){5,33})""", re.IGNORECASE)
KEY_BODY = re.compile(r"[A-Za-z0-9_-]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """The automaton: what it reports is the kind of anchor and its length."""
    found: dict[str, tuple[str, int]] = {"@": ("at", 1), "+": ("plus", 1), "://": ("scheme", 3)}
    found |= {str(d): ("digit", 1) for d in range(10)}
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("iban", ("iban",))):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found[form] = (kind, len(form))
    found |= {p: ("key", len(p)) for p in KEY_PREFIXES}
    machine = ahocorasick.Automaton()
    for cue, what in found.items():
        machine.add_word(cue, what)
    machine.make_automaton()
    return machine


class Finder:
    """Spans of personal data in a text, as (start, end, kind) by start, then kind."""

    def __init__(self):
        self.machine = anchors()
        self.parsers = {"at": self.at, "plus": self.plus, "digit": self.digit, "scheme": self.scheme,
                        "secret": self.secret, "account": self.account, "iban": self.iban, "key": self.key}

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        self.text, self.out, self.done = text, [], dict.fromkeys(KINDS, 0)
        parsers = self.parsers
        for last, (kind, size) in self.machine.iter(text):
            parsers[kind](last - size + 1, last + 1)
        return sorted(self.out, key=lambda s: (s[0], ORDER[s[2]], s[1]))

    def add(self, kind: str, start: int, end: int) -> None:
        self.out.append((start, end, kind))
        self.done[kind] = end

    def at(self, start: int, end: int) -> None:
        text, first = self.text, start
        while first > self.done["email"] and text[first - 1] in LOCAL:
            first -= 1
        if first < start and (m := DOMAIN.match(text, end)):
            self.add("email", first, m.end())

    def digit(self, start: int, end: int) -> None:
        if start >= self.done["ip"]:
            chain = DOTTED.match(self.text, start)
            if "." in chain.group():
                parts, at = chain.group().split("."), start
                for k in range(0, len(parts) - len(parts) % 4, 4):
                    four = parts[k:k + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                        self.out.append((at, at + size, "ip"))
                    at += size + 1
            self.done["ip"] = chain.end()
        if start >= self.done["card"]:
            chain = GROUPED.match(self.text, start)
            self.done["card"] = chain.end() if chain else end
            if chain:
                digits = digits_of(chain.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    self.out.append((start, chain.end(), "card"))

    def plus(self, start: int, end: int) -> None:
        if start >= self.done["phone"] and (m := DIALLED.match(self.text, start)):
            self.done["phone"] = m.end()
            if 9 <= len(digits_of(m.group())) <= 15:
                self.out.append((start, m.end(), "phone"))

    def scheme(self, start: int, end: int) -> None:
        """``scheme://user:word@host``."""
        text, first = self.text, start
        while first > self.done["login"] and start - first < 32 and text[first - 1] in SCHEME:
            first -= 1
        if first < start and (m := USER_INFO.match(text, end)):
            self.add("login", first, m.end())

    def alone(self, start: int) -> bool:
        return start == 0 or not (self.text[start - 1].isalnum() or self.text[start - 1] == "_")

    def secret(self, start: int, end: int) -> None:
        m = SECRET.match(self.text, end)
        if m and m.start(1) >= self.done["secret"] and any(c.isdigit() for c in m.group(1)):
            self.add("secret", m.start(1), m.end(1))

    def key(self, start: int, end: int) -> None:
        if start < self.done["secret"] or not self.alone(start):
            return
        m = KEY_BODY.match(self.text, end)
        if m and any(c.isdigit() for c in m.group()):
            self.add("secret", start, m.end())

    def account(self, start: int, end: int) -> None:
        m = ACCOUNT.match(self.text, end) if self.alone(start) else None
        if m and m.start(1) >= self.done["account"]:
            self.add("account", m.start(1), m.end(1))

    def iban(self, start: int, end: int) -> None:
        if not self.alone(start):
            return
        at = end
        while at < len(self.text) and at - end < 6 and self.text[at] in " \t:=#.":
            at += 1
        m = IBAN.match(self.text, at)
        if m and at >= self.done["iban"]:
            code = m.group()
            while len(code.replace(" ", "")) >= 15:  # the code may be followed by words in capitals
                if not code.endswith(" ") and iban_valid(code.replace(" ", "")):
                    self.add("iban", at, at + len(code))
                    return
                code = code[:-1]


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` (of the
    base spans as ``kind:start:end``, comma-joined) and ``spans`` (all spans, joined likewise).

    Positions are code points, the end exclusive. A null or empty text has no spans; null ids and repeated
    rows are kept; other columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()

    def make():
        finder = Finder()

        def each(i, text):
            spans = finder.spans(text)
            base = [s for s in spans if s[2] in BASE]
            counts = [sum(s[2] == k for s in base) for k in BASE]
            return i, *counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)
        return each

    return text_map(columns(docs, id=id_col, text=text_col),
                    f"`{id_col}` {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                    "base_sha256 string, spans string", make)


def mask(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in the text replaced by names of kinds (``<EMAIL>``).

    Null texts stay null, empty ones empty; repeated rows are masked alike; an empty table gives an empty one. Columns
    of any names pass through untouched.
    """
    prepare(docs.sparkSession)
    schema = to_arrow_schema(docs.schema)
    at = docs.columns.index(text_col)

    def run(batches):
        finder = Finder()
        for batch in batches:
            texts = [None if t is None else masked(t, finder.spans(t)) for t in batch.column(at).to_pylist()]
            arrays = [pa.array(texts, schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
