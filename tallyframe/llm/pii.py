"""Surrogate generation: personal data replaced by keyed values of the same type and format.

An entity's value is brought to one form first (digits of a phone or card number, an IBAN without blanks,
lower case, the eight groups of an address), so that it is the same however it is written. Its surrogate is a
keyed permutation of the values of its own shape: a value is read as a number in mixed radix (digits stay
digits, vowels vowels, consonants consonants of the same script, an octet keeps its number of digits, a card
its brand digit and the validity of its check digit, an IBAN its country and that of its check digits, a phone
number its country code) and mapped by a cycle: the inverse of a keyed Feistel network, one step on, and the
network again. That is one to one, never the value itself, and the same wherever the entity occurs, so
distinct entities stay distinct and one entity stays one, in any number of documents, without a table of what
has been seen. Values that no valid one can be (check digits out of range, an address in the range for mapped
ones, a secret of other characters than hex digits) are mapped among themselves. The format is put back after:
separators, case, groups and leading zeros.

A name's surrogate depends on the name alone, not on the title before it, so one person is one in all documents
(Mrs Smith, Dr Smith). Its gender is in its ending, which stays: a stays a, o stays o, other vowels stay among
themselves; frequent consonants stay frequent.

The key is the session's `spark.tallyframe.surrogate.key` or an argument; whoever has it can undo the surrogates.
Where a session names none, `DEMO_KEY` is used with a warning: good for trials, not for data that is given away.
`collisions` compares a corpus's entities and returns those that are not one to one; `op5_surrogates` counts them
in each document, so a clash is seen in its rows and costs no other document its result.

Defined results: a null text stays null with no entities; an empty one stays empty; texts without entities
come back unchanged; all other columns pass through (`text` is replaced, n_entities and entities are new and
replace columns of those names); repeated rows get equal results; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallyframe.llm import common

KEY_SETTING = "spark.tallyframe.surrogate.key"
#: Public, hence no protection.
DEMO_KEY = b"tallyframe surrogate key"
#: original and surrogate as written, value and stands_in without format.
NAMES = ("kind", "start", "original", "surrogate", "value", "stands_in")
ENTITY = StructType([StructField(n, IntegerType() if n == "start" else StringType()) for n in NAMES])

# Titles before a name, by gender, and phrases before one's own name.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Signora"),
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor"),
    "x": ("Dr", "Prof", "Professor", "Doctor"),
}
PHRASES = ("my name is", "mein Name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "signed by", "Sincerely,")

_NAME = r"[^\W\d_][\w'’-]*"
_TITLED = re.compile(rf"\b(?:(?P<f>{'|'.join(TITLES['f'])})|(?P<m>{'|'.join(TITLES['m'])})|(?P<x>{'|'.join(TITLES['x'])}))\b\.? (?P<name>{_NAME}(?: {_NAME})?)")
_PHRASED = re.compile(rf"(?i:{'|'.join(map(re.escape, PHRASES))})\s+(?P<name>{_NAME}(?: {_NAME})?)")
_LOCAL, _DOMAIN = frozenset("_.!#$%&'*+/=?^`{|}~-"), re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}")
_SECRET = re.compile(
    r"""(?i)\b(?:[\w-]*(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key))["']?\s*[:=]\s*(?P<q>["']?)(?P<a>[^\s"'<>]{6,})(?P=q)"""
    r"""|\b(?P<b>(?-i:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}))"""
    r"""|\b(?P<c>(?=[0-9a-f]*\d)[0-9a-f]{32,128})\b"""
)
#: Cheap tests that a text may hold an entity at all.
_SECRET_HINTS = ("AKIA", "gh", "sk-", "xox", "eyJ")
_FOLDED_HINTS = ("token", "secret", "passw", "pwd", "key")
_TITLE_HINTS = tuple(t + mark for titles in TITLES.values() for t in titles for mark in (" ", ". "))
_DIGIT, _HEX, _ALL_HEX = re.compile(r"[0-9]"), re.compile(r"[0-9a-fA-F]{32}"), re.compile("[0-9a-fA-F]+")
_OWNS = re.compile("['’]s?$")
_JOINED = re.compile(r"[0-9A-Fa-f][:-][0-9A-Fa-f]|::")
_H, _V4 = "[0-9A-Fa-f]{1,4}", r"(?:\d{1,3}\.){3}\d{1,3}"
_DIGITS = re.compile(
    r"(?P<ipv4>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w))"
    r"|(?P<mac>(?<![\w:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:]))"
    rf"|(?P<ipv6>(?<![\w:])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{6}}{_V4}|(?:{_H}(?::{_H}){{0,6}})?::(?:(?:{_H}:){{0,6}}(?:{_V4}|{_H}))?)(?!\w|:[\w:]|\.\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+(])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .\-/]?\(?\d{1,4}\)?){2,6}(?!\w)|(?<![\w.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\w-])|(?<!\w)0\d{1,4}[ /\-]\d{3,4}[ .\-]?\d{3,5}(?!\w))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\w-]))"
)

VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
# Letters with marks that names in the covered languages have, and two more scripts.
CLASSES = (VOWELS, CONSONANTS, "àáâäãåæèéêëìíîïòóôöõøœùúûü", "çñßšžčćđł", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "0123456789")
_CLASS = {c: group for group in CLASSES for c in group}


def _round(key: bytes, value: int, turn: int, size: int) -> int:
    raw = value.to_bytes(-(-max(1, value.bit_length()) // 8), "little")
    return int.from_bytes(hashlib.blake2b(raw, key=key[:64], salt=turn.to_bytes(2, "little"), digest_size=64).digest(), "little") % size


def feistel(key: bytes, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: eight rounds over two unequal moduli, walked until in range."""
    a = 1
    while a * a < size:
        a <<= 1
    b = -(-size // a)
    while True:
        high, low = divmod(value, a)  # high < b, low < a
        turns = range(8)
        for t in reversed(turns) if back else turns:
            if t % 2:
                high = (high + (-1 if back else 1) * _round(key, low, t, b)) % b
            else:
                low = (low + (-1 if back else 1) * _round(key, high, t, a)) % a
        value = high * a + low
        if value < size:
            return value


def stepped(key: bytes, value: int, size: int) -> int:
    """A keyed permutation of range(size) that is one cycle, hence without a fixed value where size > 1."""
    return feistel(key, (feistel(key, value, size, back=True) + 1) % size, size)


def _keyed(key: bytes, kind: str) -> bytes:
    return hashlib.blake2b(kind.encode(), key=key[:64], digest_size=32).digest()


def permuted(text: str, key: bytes, kind: str, hold: frozenset[int] = frozenset(), alphabet: str | None = None) -> str:
    """text with its letters and digits replaced class by class; what has no class stays, as do the places in hold."""
    low = text.lower() if len(text.lower()) == len(text) else text
    groups = [None if i in hold else alphabet if alphabet and c in alphabet else _CLASS.get(c) or _block(c) for i, c in enumerate(low)]
    value, size = 0, 1
    for c, g in zip(low, groups):
        if g:
            value, size = value * len(g) + g.index(c), size * len(g)
    if size == 1:
        return text
    shape = "".join(str(len(g)) if g else c for c, g in zip(low, groups))
    value, out = stepped(_keyed(key, f"{kind}|{shape}"), value, size), []
    for c, was, g in zip(reversed(low), reversed(text), reversed(groups)):
        if g:
            value, at = divmod(value, len(g))
            c = g[at]
            c = c.upper() if was != was.lower() and len(c.upper()) == 1 else c
            out.append(c)
        else:
            out.append(was)
    return "".join(reversed(out))


@lru_cache(maxsize=4096)
def _block(c: str) -> str | None:
    """Other letters: those of the same case and the same 64 code points."""
    if not c.isalpha():
        return None
    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == unicodedata.category(c) and x.lower() == x and x not in _CLASS) or None


def luhn(digits: list[int]) -> int:
    """The check digit after these."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _mixed(values: list[int], sizes: list[int], key: bytes) -> list[int]:
    value, size, out = 0, 1, []
    for v, n in zip(values, sizes):
        value, size = value * n + v, size * n
    value = stepped(key, value, size)
    for n in reversed(sizes):
        value, v = divmod(value, n)
        out.append(v)
    return out[::-1]


def _octets(text: str, key: bytes) -> str:
    spans = [(0, 10), (10, 100), (100, 256)]
    parts = text.split(".")
    kinds = [spans[len(p) - 1] for p in parts]
    got = _mixed([int(p) - a for p, (a, b) in zip(parts, kinds)], [b - a for a, b in kinds], _keyed(key, "ipv4" + "".join(str(len(p)) for p in parts)))
    return ".".join(str(v + a) for v, (a, _) in zip(got, kinds))


def _card(value: str, key: bytes) -> str:
    digits = [int(c) for c in value]
    body, off = digits[:-1], (digits[-1] - luhn(digits[:-1])) % 10
    body = body[:1] + _mixed(body[1:], [10] * (len(body) - 1), _keyed(key, f"card{len(digits)}{body[0]}"))
    return "".join(map(str, body + [(luhn(body) + off) % 10]))


# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(value: str, key: bytes) -> str:
    """Country code and trunk zeros stay; in a number of ten digits a digit from 2 to 9 that begins a group of the North American plan stays one."""
    head = 0
    if value.startswith("+"):
        head = 2 if value[1] in "17" else 3 if value[1:3] in TWO_DIGIT_CODES else 4
    rest = value[head:]
    held = frozenset(range(len(rest) - len(rest.lstrip("0"))))
    firsts = {0, 3} if len(rest) == 10 and (not head or value[:2] == "+1") else set()
    first = len(held)  # it stays other than zero
    groups = ["" if i in held or i == first and i in firsts and c == "1" else "23456789" if i in firsts and c in "23456789" else "01" if i in firsts else "123456789" if i == first else "0123456789" for i, c in enumerate(rest)]
    return value[:head] + _by_groups(rest, groups, key, f"phone{value[:head]}")


def iban_check(country: str, account: str) -> int:
    """The two check digits of an IBAN, by its remainder of 97."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def _iban(value: str, key: bytes) -> str:
    """Check digits from 02 to 98 stay as far from the right ones as they were; no others can be right, and those stay."""
    country, check, account = value[:2], int(value[2:4]), value[4:]
    off = (check - iban_check(country, account)) % 97 if 2 <= check <= 98 else None
    groups = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in account]
    account = _by_groups(account, groups, key, f"iban{country}")
    return f"{country}{check if off is None else (iban_check(country, account) + off - 2) % 97 + 2:02d}{account}"


def _ipv6_groups(text: str) -> list[int]:
    whole = int(ipaddress.IPv6Address(text))
    return [whole >> 16 * i & 0xFFFF for i in range(7, -1, -1)]


def _ipv6(value: str, key: bytes) -> str:
    """Groups keep their number of digits, so those of zero are zero; an IPv4 address in one stays one."""
    if value.startswith("0:0:0:0:0:ffff:"):
        inner = [int(g, 16) for g in value.split(":")[6:]]
        octets = [int(o) for o in _octets(".".join(str(n >> s & 255) for n in inner for s in (8, 0)), key).split(".")]
        return f"0:0:0:0:0:ffff:{octets[0] << 8 | octets[1]:x}:{octets[2] << 8 | octets[3]:x}"
    sizes = [len(g) if g != "0" else 0 for g in value.split(":")]
    low = [16 ** (n - 1) if n > 1 else 1 for n in sizes]
    radix = [16**n - a if n else 1 for n, a in zip(sizes, low)]
    if not any(sizes[:5]) and sizes[5] == 4:
        radix[5] -= 1  # ffff, the last one, is the range of mapped addresses
    got = _mixed([int(g, 16) - a if n else 0 for g, a, n in zip(value.split(":"), low, sizes)], radix, _keyed(key, f"ipv6{sizes}"))
    return ":".join(f"{v + a:x}" if n else "0" for v, a, n in zip(got, low, sizes))


def _by_groups(text: str, groups: list[str], key: bytes, kind: str) -> str:
    """text with each character replaced within its group, where it has one."""
    at = [i for i, g in enumerate(groups) if g]
    if not at:
        return text
    shape = "".join(f"{len(g)}," if g else c for c, g in zip(text, groups))
    got = _mixed([groups[i].index(text[i]) for i in at], [len(groups[i]) for i in at], _keyed(key, f"{kind}|{shape}"))
    out = list(text)
    for i, v in zip(at, got):
        out[i] = groups[i][v]
    return "".join(out)


# Letters of names by how frequent they are, and what last vowels, which tell gender, stay among.
NAME_CLASSES = ("aeiouy", "bdgklmnprstv", "cfhjqwxz")
ENDINGS = ("a", "o", "eiuy")


def _name(value: str, key: bytes) -> str:
    groups = [next((c for c in NAME_CLASSES if x in c), None) or _CLASS.get(x) or _block(x) or "" for x in value]
    if len(value) > 2:
        groups[-1] = next((e for e in ENDINGS if value[-1] in e), groups[-1])
    return _by_groups(value, groups, key, "name")


def canonical(kind: str, text: str) -> str:
    """An entity's value, the same however it is written."""
    if kind in ("email", "mac", "name") or kind == "secret" and _ALL_HEX.fullmatch(text):
        low = text.lower() if len(text.lower()) == len(text) else text
        return re.sub("[:-]", "", low) if kind == "mac" else low
    if kind in ("card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "phone":
        return "+" * text.startswith("+") + "".join(c for c in text.replace("(0)", "") if c.isdigit())
    if kind == "iban":
        return "".join(text.split())
    if kind == "ipv6":
        return ":".join(f"{g:x}" for g in _ipv6_groups(text))
    return text


@lru_cache(maxsize=100_000)
def stand_in(kind: str, value: str, key: bytes) -> str:
    """The value that stands for a canonical one."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{permuted(local, key, 'local')}@{permuted(name, key, 'domain')}.{top}"
    if kind == "mac" or kind == "secret" and _ALL_HEX.fullmatch(value):
        return permuted(value, key, kind, alphabet="0123456789abcdef")
    known = {"ipv4": _octets, "card": _card, "phone": _phone, "iban": _iban, "ipv6": _ipv6, "name": _name}.get(kind)
    if known:
        return known(value, key)
    out = permuted(value, key, kind)
    while kind == "secret" and out != value and _ALL_HEX.fullmatch(out):
        out = permuted(out, key, kind)  # those of hex digits alone are mapped among themselves
    return out


def _placed(text: str, fresh: str, wanted) -> str:
    """Characters of fresh where text has wanted ones, the others as they are."""
    it = iter(fresh)
    return "".join(next(it) if wanted(c) else c for c in text)


def _cased(text: str, fresh: str) -> str:
    return "".join(f.upper() if was != was.lower() and len(f.upper()) == 1 else f for was, f in zip(text, fresh))


def formatted(kind: str, text: str, fresh: str) -> str:
    """A canonical value in the format of text."""
    if kind == "phone":
        parts = text.split("(0)")
        it = iter(fresh.lstrip("+"))
        return "(0)".join("".join(next(it) if c.isdigit() else c for c in p) for p in parts)
    if kind in ("card", "ssn"):
        return _placed(text, fresh, str.isdigit)
    if kind == "iban":
        return _placed(text, fresh, lambda c: not c.isspace())
    if kind == "mac" or kind == "secret" and _ALL_HEX.fullmatch(text):
        out = _placed(text, fresh, lambda c: c not in ":-")
        return out.upper() if text != text.lower() and text == text.upper() else out
    if kind == "ipv6":
        return _ipv6_like(text, [int(g, 16) for g in fresh.split(":")])
    return _cased(text, fresh) if len(text) == len(fresh) else fresh


def _ipv6_like(text: str, groups: list[int]) -> str:
    """Groups where text has them: zeros that it leaves out, leading zeros, case, and a tail in decimal octets."""
    tail = ""
    if "." in text:
        text = text.rpartition(":")[0] + ":"
        tail, groups = ".".join(str(n >> s & 255) for n in groups[6:] for s in (8, 0)), groups[:6]
        text = text if text.endswith("::") else text[:-1]
    before, gap, after = text.partition("::")
    left = [p for p in before.split(":") if p]
    right = [p for p in after.split(":") if p]
    some = groups[: len(left)] + (groups[len(groups) - len(right) :] if right else [])
    upper = text != text.lower() and text == text.upper()
    shown = [f"{g:0{len(p)}x}" if p[0] == "0" else f"{g:x}" for p, g in zip(left + right, some)]
    shown = [g.upper() for g in shown] if upper else shown
    out = ":".join(shown[: len(left)]) + gap + ":".join(shown[len(left) :])
    return f"{out}{'' if not tail or out.endswith('::') else ':'}{tail}"


def surrogate(kind: str, text: str, key: bytes) -> str:
    return formatted(kind, text, stand_in(kind, canonical(kind, text), key))


def _is_ipv6(text: str) -> bool:
    """Whether text is a valid address that is not a name's scope (add::face) in program text: short ones have a digit."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return bool(_DIGIT.search(text)) or sum(map(bool, text.split(":"))) > 2


def detected(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of entities, in order and without overlap; of overlapping ones the kind found first counts."""
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            found.append((start, end, kind))

    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] in _LOCAL):
            start -= 1
        after = _DOMAIN.match(text, at + 1)
        if after and text[start:at].strip("."):
            add(at - len(text[start:at].lstrip(".'`*_~|#$%&!?{}=^/")), after.end(), "email")
        at = text.find("@", at + 1)
    digits, low = _DIGIT.search(text), text.casefold()
    if any(h in text for h in _SECRET_HINTS) or any(h in low for h in _FOLDED_HINTS) or digits and _HEX.search(text):
        for m in _SECRET.finditer(text):
            group = next(g for g in "abc" if m.group(g))
            add(*m.span(group), "secret")
    for m in _DIGITS.finditer(text) if digits or _JOINED.search(text) else ():
        if m.lastgroup == "ipv4":
            good = all(int(p) < 256 and str(int(p)) == p for p in m.group().split("."))
        else:
            good = m.lastgroup != "ipv6" or _is_ipv6(m.group())
        if good:
            add(*m.span(), m.lastgroup)
    names: set[str] = set()
    for pattern, hinted in ((_TITLED, any(h in text for h in _TITLE_HINTS)), (_PHRASED, any(p.casefold() in low for p in PHRASES))):
        for m in pattern.finditer(text) if hinted else ():
            for part in m.group("name").split(" "):
                part = _OWNS.sub("", part)
                if part[:1].isupper():
                    names.add(part)
                else:
                    break
    for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b", text) if names else ():
        add(*m.span(), "name")
    return sorted(found)


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, int, str, str]]]:
    """The text with surrogates, and (kind, place in the original, original, surrogate)."""
    out, at, entities = [], 0, []
    for start, end, kind in detected(text):
        fresh = surrogate(kind, text[start:end], key)
        out += [text[at:start], fresh]
        entities.append((kind, start, text[start:end], fresh))
        at = end
    return "".join(out) + text[at:], entities


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with a public key", stacklevel=3)
    return named.encode() if named else DEMO_KEY


def surrogates(docs: DataFrame, column: str = "text", key: bytes | None = None) -> DataFrame:
    """docs with entities in `column` replaced, n_entities and entities; the session's key where none is given."""
    key = key or session_key(docs.sparkSession)
    docs = docs.drop("n_entities", "entities")
    at = docs.columns.index(column)
    kind = pa.list_(pa.struct([(n, pa.int32() if n == "start" else pa.string()) for n in NAMES]))

    def entity(kind: str, start: int, original: str, surrogate: str) -> dict:
        value = canonical(kind, original)
        return dict(zip(NAMES, (kind, start, original, surrogate, value, stand_in(kind, value, key))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("pii", stand_in.cache_clear)
        for part in common.slices(batches):
            done = [(None, []) if t is None else replaced(t, key) for t in part.column(at).to_pylist()]
            columns = part.columns
            columns[at] = pa.array([d[0] for d in done], pa.string())
            columns += [pa.array([len(d[1]) for d in done], pa.int32()), pa.array([[entity(*e) for e in d[1]] for d in done], kind)]
            yield pa.RecordBatch.from_arrays(columns, part.schema.names + ["n_entities", "entities"])

    added = [StructField("n_entities", IntegerType()), StructField("entities", ArrayType(ENTITY))]
    return common.lean(docs).mapInArrow(run, StructType(docs.schema.fields + added))


def collisions(done: DataFrame) -> DataFrame:
    """(kind, value) of values that stand for two of a kind, or that have two: none, if all is well. Values are compared without their format."""
    one = done.select(F.explode("entities").alias("e")).select("e.kind", F.col("e.value").alias("original"), F.col("e.stands_in").alias("surrogate")).distinct()
    two = one.groupBy("kind", "surrogate").count().where("count > 1").select("kind", F.col("surrogate").alias("value"))
    return two.union(one.groupBy("kind", "original").count().where("count > 1").select("kind", "original"))


def with_collisions(done: DataFrame) -> DataFrame:
    """done, written, with n_collisions: how many of a row's entities are among `collisions`."""
    done = done.drop("n_collisions").withColumn("_row", F.monotonically_increasing_id())
    done = common.stored(done, "pii-surrogates")
    clashes = common.stored(collisions(done), "pii-collisions")
    n = clashes.count()
    if not n:
        return done.withColumn("n_collisions", F.lit(0)).drop("_row")
    e, c = done.select("_row", F.explode("entities").alias("e")), common.small(clashes, n).alias("c")
    hit = (F.col("e.kind") == F.col("c.kind")) & (F.col("_key") == F.col("c.value"))
    keys = e.select("_row", "e", F.explode(F.array_distinct(F.array("e.value", "e.stands_in"))).alias("_key"))
    hits = keys.join(c, hit, "left_semi").select("_row", "e.start").distinct().groupBy("_row").agg(F.count("*").cast("int").alias("n_collisions"))
    return done.join(hits, "_row", "left").withColumn("n_collisions", F.coalesce("n_collisions", F.lit(0))).drop("_row")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_collisions(surrogates(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    kinds = F.array_join(F.transform("entities", lambda e: e["kind"]), "|")
    return done.select("doc_id", "text", "n_entities", kinds.alias("kinds"), "n_collisions")
