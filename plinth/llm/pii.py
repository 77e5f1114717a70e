"""PII surrogates: detected entities get keyed, type-consistent replacements.

Structured entities (mail addresses, phone, card and account numbers, IP
addresses, keys and passwords) are enciphered in place: a keyed Feistel network
permutes all strings of the same shape, so letters stay letters of their script
and case, digits stay digits, and separators stay.  Names, found after a title
or a label, are numbered, permuted and spelled in syllables of their script with
an ending for their gender.  All these maps are one to one over all strings, so
distinct entities get distinct surrogates and one entity the same surrogate in
the whole corpus, without any table.  Only where a surrogate equals an original
of its document, or another entity's surrogate, is it drawn anew under the next
tweak, without a limit.

One pass, no shuffle: everything follows from the key and the text.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import texts

#: The session setting that holds the key.
KEY_SETTING = "plinth.pii.key"
#: Alphabets a character is permuted in.
ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
HEX = "0123456789abcdef"
#: Titles by gender, None where they tell none.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "госпожа", "Госпожа", "Κυρία"],
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "Господин", "Κύριος"],
    None: ["Dr", "Prof", "Doktor", "Docteur", "Доктор"],
}
#: What surrogate names are spelled with, by script.  A name is syllables of an onset, a vowel and perhaps a
#: coda, then an ending: for family names and by gender, each for plain names, for names with other letters of the script and
#: for names of mixed scripts.
SYLLABLES = {
    "latin": (["b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "st", "tr"], "aeiou", ["", "l", "n", "r"]),
    "cyrillic": (["б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ф", "х", "ц", "бр", "ст", "тр"], "аеиоу", ["", "л", "н", "р"]),
    "greek": (["β", "γ", "δ", "ζ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "φ", "χ", "βρ", "στ", "τρ"], "αειου", ["", "λ", "ν", "ρ"]),
}
ENDINGS = {
    "latin": {"last": ("k", "tz", "ck"), "f": ("na", "nia", "nea"), "m": ("s", "x", "ss")},
    "cyrillic": {"last": ("к", "ц", "чк"), "f": ("на", "ния", "нея"), "m": ("с", "х", "сс")},
    "greek": {"last": ("ς", "ξ", "ψ"), "f": ("να", "νια", "νεα"), "m": ("ς", "ξ", "ψ")},
}
#: Tweaks in the same shape alone; each time this doubles, one more character is added.
SHAPE_TWEAKS = 64

_TITLE_OF = {t: g for g, titles in TITLES.items() for t in titles}
#: Capitals of the Latin letters beyond the first 256 characters, and of the other Cyrillic letters.
_MORE_CAPITALS = "".join(c for c in map(chr, [*range(0x100, 0x250), *range(0x400, 0x410), *range(0x490, 0x530)]) if c.isupper())
_CAPITAL = rf"[A-ZÀ-ÖØ-ÞА-ЯΑ-ΩΆ-Ώ{_MORE_CAPITALS}][A-Za-zÀ-ÖØ-öø-ÿĀ-ɏЀ-ԯΑ-ώ'’-]+"
_NAME = rf"{_CAPITAL}(?: (?!(?:{'|'.join(map(re.escape, _TITLE_OF))})\b){_CAPITAL}){{0,2}}"
_FIND = re.compile(
    "|".join([
        r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})",
        r"(?P<secret>\b(?i:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)(?P<value>[^\s\"',;]{4,})",
        r"(?P<key>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9]{20,}\b)",
        r"(?P<hex>\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,64}\b)",
        r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
        r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
        r"(?P<ip>(?<![\d.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\d.]*\d))",
        r"(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![\w:]))",
        r"(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))",
        r"(?P<phone>(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?\d{2,4}|\d{2,4}[ .-]\d{2,4})(?:[ .-]\d{2,4}){1,3}(?![\w-])|(?<![\w.+-])\d{3}-\d{4}(?![\w-])|(?<![\w.+-])\+\d{7,14}(?![\w-]))",
        rf"(?P<title>\b(?:{'|'.join(map(re.escape, sorted(_TITLE_OF, key=len, reverse=True)))})\b\.?\s+)(?P<name>{_NAME})",
        rf"(?P<label>\b(?i:(?:full |first |last |sur|user)?name|contact|signed|attn|patient|customer|client|employee)\s*:\s+)(?P<called>{_NAME})",
    ])
)
_WORD = re.compile(rf"(?<![\w'’-]){_CAPITAL}")
_DIGIT = re.compile(r"\d").search
_MARKS = ("pass", "pwd", "token", "secret", "key", "name", "contact", "signed", "attn", "patient", "customer", "client", "employee", "::")
_DATE = re.compile(r"(?<!\d)(?:\d{4}[-. ]\d{1,2}[-. ]\d{1,2}|\d{1,2}[-. ]\d{1,2}[-. ](?:19|20)\d{2})(?!\d)")
_LOCAL = re.compile(r"\d{3}-\d{4}")


def _may_hold(text: str) -> bool:
    """False only if none of the patterns can match."""
    if _DIGIT(text) or "@" in text or any(t in text for t in _TITLE_OF):
        return True
    lower = text.lower()
    return any(x in lower for x in _MARKS)


def _is_phone(text: str) -> bool:
    """Not a date or a count: a marked number, a local one, or nine digits and more."""
    if text[0] in "+(" or _LOCAL.fullmatch(text):
        return True
    return len(_digits(text)) >= 9 and not _DATE.search(text)


def _is_address(text: str) -> bool:
    try:
        address = IPv6Address(text)
    except AddressValueError:
        return False
    return not (address.is_loopback or address.is_unspecified) and _DIGIT(text) is not None


@lru_cache(4096)
def _kin(c: str) -> str | None:
    """Characters of the same kind round ``c``, for texts in which any character may change."""
    at = ord(c) & ~127
    out = "".join(x for x in map(chr, range(at, at + 128)) if unicodedata.category(x) == unicodedata.category(c) and x.isprintable() and not x.isspace() and x not in "\"',;\\")
    return out if c in out and len(out) > 1 else None


@lru_cache(4096)
def _alphabet(c: str) -> str | None:
    return next((a for a in ALPHABETS if c in a), None)


class Cipher:
    """Keyed permutations of 0..n-1: a balanced Feistel network with cycle walking."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = hashlib.sha256(key).digest(), rounds

    def number(self, *parts: object) -> int:
        text = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=16).digest(), "big")

    def permute(self, value: int, size: int, tweak: str) -> int:
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for r in range(self.rounds):
                wide = 0
                for k in range(0, half, 128):
                    wide = wide << 128 | self.number(tweak, r, k, right)
                left, right = right, left ^ wide & mask
            value = left << half | right
            if value < size:
                return value

    def shape(self, text: str, tweak: str, hexadecimal: bool = False, every: bool = False) -> str:
        """Permute ``text`` among the strings of its shape; ``every``: characters of no alphabet take part, too."""
        slots = [_alphabet(c) or (_kin(c) if every else None) for c in text]
        if hexadecimal:
            letters = HEX.upper() if any(c in "ABCDEF" for c in text) else HEX
            slots = [letters if c in letters else s for c, s in zip(text, slots)]
        value, size = 0, 1
        for c, alphabet in zip(text, slots):
            if alphabet:
                value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
        value = self.permute(value, size, tweak + "|" + "".join(c if not a else a[0] for c, a in zip(text, slots)))
        out = []
        for c, alphabet in zip(reversed(text), reversed(slots)):
            if alphabet:
                value, rest = divmod(value, len(alphabet))
                c = alphabet[rest]
            out.append(c)
        return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def luhn_valid(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def _digits(text: str) -> str:
    """The digits of ``text``, of whatever script, as 0-9."""
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def _with_digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order, each by one of its script."""
    rest = iter(digits)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(rest))) if c.isdecimal() else c for c in text)


def _lower(text: str) -> str:
    """Lower-cased, character by character."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _may_be_issued(digits: str) -> bool:
    """Whether nine digits may be a social security number in use."""
    return digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"


def _is_public(address: int) -> bool:
    """Whether an IPv4 address lies in no private, loopback, multicast or reserved block of the first octet."""
    return 1 <= address >> 24 <= 223 and address >> 24 not in (10, 127)


class Surrogates:
    def __init__(self, key: bytes):
        self.cipher = Cipher(key)
        self.makers: dict[str, Callable[[str, int], str]] = {
            "email": self._email, "value": self._value, "key": self._key, "iban": self._iban, "ssn": self._ssn, "ip": self._ip, "ip6": self._ip6, "card": self._card, "phone": self._phone,
        }

    def _email(self, text: str, tweak: int) -> str:
        text = "a" * _longer(tweak, SHAPE_TWEAKS) + text
        local, _, domain = _lower(text).partition("@")
        labels = domain.split(".")
        # the part before the top level domain; shape, and so validity, stay
        new = self.cipher.shape(local + "@" + ".".join(labels[:-1]), f"email{tweak}") + "." + labels[-1]
        return "".join(n.upper() if o.isupper() else n for o, n in zip(text, new))

    def _value(self, text: str, tweak: int) -> str:
        more = _longer(tweak, SHAPE_TWEAKS)
        if more:  # a shape may have a single text
            return "".join(chr(97 + self.cipher.number("value", text, tweak, i) % 26) for i in range(len(text) + more))
        both = re.fullmatch("[0-9a-f]+|[0-9A-F]+", text) is not None and not text.isdecimal()
        return self.cipher.shape(text, f"secret{tweak}", hexadecimal=both, every=True)

    def _key(self, text: str, tweak: int) -> str:
        return text[:4] + self.cipher.shape(text[4:], f"key{tweak}")

    def _iban(self, text: str, tweak: int) -> str:
        bare = text.replace(" ", "")
        body = self.cipher.shape(bare[4:], f"iban{tweak}{bare[:2]}")
        moved = "".join(str(int(c, 36)) for c in body + bare[:2] + "00")
        new = iter(f"{bare[:2]}{98 - int(moved) % 97:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def _ssn(self, text: str, tweak: int) -> str:
        digits = _digits(text)
        issued = _may_be_issued(digits)
        # numbers that are issued and others are permuted within their own, so no two meet
        while True:
            digits = self.cipher.shape(digits, f"ssn{tweak}")
            if _may_be_issued(digits) == issued:
                return _with_digits(text, digits)

    def _ip(self, text: str, tweak: int) -> str:
        value = int.from_bytes(bytes(map(int, text.split("."))), "big")
        public = _is_public(value)
        # public addresses and others are permuted within their own, so no two meet
        while True:
            value = self.cipher.permute(value, 1 << 32, f"ip{tweak}")
            if _is_public(value) == public:
                return ".".join(map(str, value.to_bytes(4, "big")))

    def _ip6(self, text: str, tweak: int) -> str:
        return self.cipher.shape(text, f"ip6{tweak}", hexadecimal=True)

    def _card(self, text: str, tweak: int) -> str:
        digits = _digits(text)
        valid = luhn_valid(digits)
        body = digits[1:-1] if valid else digits[1:]
        body = self.cipher.shape(body, f"card{tweak}{digits[0]}{valid}")
        new = digits[0] + body
        return _with_digits(text, new + luhn_digit(new) if valid else new)

    def _phone(self, text: str, tweak: int) -> str:
        text += "0" * _longer(tweak, SHAPE_TWEAKS)
        digits = _digits(text)
        lead = re.match(r"\+(\d{1,3})[ .(-]", text)
        code = digits[: len(lead.group(1))] if lead else digits[: len(digits) - 10] if len(digits) > 10 else ""
        rest = digits[len(code) :]
        first = rest
        while True:
            rest = self.cipher.shape(rest, f"phone{tweak}")
            if (rest[0] in "01") == (first[0] in "01"):
                return _with_digits(text, code + rest)

    def named(self, name: str, what: str, tweak: int) -> str:
        """The surrogate of one name; ``what``: f or m for first names, last for family names.

        Names are numbered, shorter ones first, and so are the spellings; blocks
        of spellings of one length are permuted.  So no two names share one.
        """
        script = _script(name)
        loud = len(name) > 1 and name.isupper()
        if loud:
            name = name[0] + _lower(name[1:])
        if _alphabet(name[0]) and name[0].isupper() and all(c in LETTERS[script][0] for c in name[1:]):
            name, kind = _lower(name), 0
        else:
            kind = 1 if all(c in LETTERS[script][1] for c in name) else 2
        number, letters = 0, LETTERS[script][kind]
        for c in name:
            number = number * len(letters) + letters.index(c) + 1
        onsets, vowels, codas = SYLLABLES[script]
        base, length = len(onsets) * len(vowels) * len(codas), 2
        while number >= base**length:
            number -= base**length
            length += 1
        number = self.cipher.permute(number, base**length, f"{script}{what}{kind}{length}|{tweak}")
        out = []
        for _ in range(length):
            number, at = divmod(number, base)
            at, coda = divmod(at, len(codas))
            onset, vowel = divmod(at, len(vowels))
            out.append(onsets[onset] + vowels[vowel] + codas[coda])
        new = "".join(out) + ENDINGS[script][what][kind]
        return new.upper() if loud else new[0].upper() + new[1:]


def _longer(tweak: int, free: int) -> int:
    """By how much a surrogate is lengthened under this tweak: it grows without end, by the logarithm."""
    return (tweak // free).bit_length()


def _script(text: str) -> str:
    return "cyrillic" if "Ѐ" <= text[0] <= "ӿ" else "greek" if "Ͱ" <= text[0] <= "Ͽ" else "latin"


def _letters(*ranges: tuple[int, int]) -> str:
    return "'’-" + "".join(c for a, b in ranges for c in map(chr, range(a, b)) if c.isalpha())


#: What names are made of, by script: small letters of plain names, all letters, letters of all scripts.
_SCRIPTS = {"latin": (ALPHABETS[1], (0x41, 0x180)), "cyrillic": (ALPHABETS[3], (0x400, 0x460)), "greek": (ALPHABETS[5], (0x386, 0x3CF))}
LETTERS = {script: (plain, _letters(own), _letters(*(x[1] for x in _SCRIPTS.values()))) for script, (plain, own) in _SCRIPTS.items()}


def _same(kind: str, text: str) -> str:
    """What makes two mentions one entity."""
    if kind in ("phone", "card", "ssn"):
        digits = _digits(text)
        return digits[-10:] if kind == "phone" else digits
    return text.lower() if kind == "email" else text.replace(" ", "") if kind == "iban" else text


class Redactor:
    def __init__(self, key: bytes):
        self.make = Surrogates(key)

    def find(self, text: str) -> list[tuple[str, int, int, str | None]]:
        """(kind, from, to, gender) of every entity, in order and apart."""
        out: list[tuple[str, int, int, str | None]] = []
        if not _may_hold(text):
            return out
        genders: dict[str, str | None] = {}  # by whole name, and by family name for bare mentions
        for m in _FIND.finditer(text):
            kind = m.lastgroup or ""
            a, b = m.span(kind) if kind in ("value", "name", "called") else m.span()
            if kind == "ip" and max(map(int, text[a:b].split("."))) > 255:
                continue
            if kind == "ip6" and not _is_address(text[a:b]):
                continue
            if kind == "hex":
                kind = "value"  # a key that has lost its name
            if kind == "phone" and not _is_phone(text[a:b]):
                continue
            if kind in ("name", "called"):
                gender = _TITLE_OF.get(m.group("title").strip().rstrip(".")) if kind == "name" else None
                for name in (text[a:b], text[a:b].split(" ")[-1]):
                    genders[name] = genders.get(name) or gender
                kind = "name"
            out.append((kind, a, b, None))
        if genders:
            starts, ends = [x[1] for x in out], [0, *(x[2] for x in out)]
            for m in _WORD.finditer(text):
                at, name = bisect(starts, m.start()), m.group()
                if (name in genders or name.isupper() and name.capitalize() in genders) and ends[at] <= m.start() and (at == len(starts) or m.end() <= starts[at]):
                    out.append(("name", *m.span(), None))
            out = sorted((kind, a, b, genders.get(text[a:b]) if kind == "name" else None) for kind, a, b, _ in out)
            out.sort(key=lambda x: x[1])
        return out

    def __call__(self, text: str | None) -> tuple[str | None, int]:
        """The text with surrogates, and the number of mentions replaced."""
        found = self.find(text) if text else []
        if not found:
            return text, 0
        originals = {_same(k, text[a:b]) for k, a, b, _ in found} | {p for k, a, b, _ in found if k == "name" for p in text[a:b].split(" ")}
        tweaks: dict[tuple[str, ...], int] = {}
        used: dict[tuple[str, str], str] = {}
        pieces, last = [], 0
        for kind, a, b, gender in found:
            old = text[a:b]
            pieces += [text[last:a], self._replace(kind, old, gender, originals, tweaks, used)]
            last = b
        return "".join([*pieces, text[last:]]), len(found)

    def _replace(self, kind: str, old: str, gender: str | None, originals: set[str], tweaks: dict, used: dict) -> str:
        if kind == "name":
            # a family is an entity of its own, so that a bare mention follows the full one
            *firsts, own = old.split(" ")
            last = self._free(("family", own), own, lambda t: self.make.named(own, "last", t), lambda x: x, originals, tweaks, used)
            if not firsts:
                return last
            sex = gender or "fm"[self.make.cipher.number("sex", firsts[0]) % 2]
            draw = lambda t: " ".join([*(self.make.named(p, sex, t) for p in firsts), last])
            return self._free(("person", old, sex), old, draw, lambda x: x, originals, tweaks, used)
        same = _same(kind, old)
        return self._free((kind, same), same, lambda t: self.make.makers[kind](old, t), lambda x: _same(kind, x), originals, tweaks, used)

    @staticmethod
    def _free(entity: tuple[str, ...], own: str, draw: Callable[[int], str], same: Callable[[str], str], originals: set[str], tweaks: dict, used: dict) -> str:
        """The entity's first surrogate that is no original and no other's; ``own``: what it is told apart by."""
        tweak = tweaks.get(entity, 0)
        while True:
            new = draw(tweak)
            key = (entity[0], same(new))
            if used.get(key, own) == own and key[1] not in originals:
                tweaks[entity], used[key] = tweak, own
                return new
            tweak += 1


def session_key(spark: SparkSession) -> bytes:
    """The key set as ``plinth.pii.key``; without one, a random key that lasts as long as the session."""
    if spark.conf.get(KEY_SETTING, None) is None:
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING).encode()


def surrogate_documents(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """The rows of ``docs`` with surrogates in ``text``, and ``n_entities``.

    All columns pass; ``n_chars``, where there is one, counts the new text.
    Null texts stay null and empty ones empty, with 0 entities; equal texts get
    equal results.  An own ``n_entities`` column is replaced.  ``key``: by
    default the session's, see ``session_key``; set it to get the same
    surrogates in every session.
    """
    key = key or session_key(docs.sparkSession)
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*columns)
    schema = docs.withColumn("n_entities", F.lit(0).cast("long")).schema
    texts_at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redact = Redactor(key)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows = [redact(t) for t in texts(part)]
                out = part.columns
                out[texts_at] = pa.array([r[0] for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*out, pa.array([r[1] for r in rows], pa.int64())], [*columns, "n_entities"])

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else out
