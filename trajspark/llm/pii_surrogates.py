"""Personal data replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, phone numbers (international, North American and national ones with a leading zero), IPv4 and
IPv6 addresses, card and account numbers, social security numbers, IBANs, secrets after a key word and keys of known
forms, and names: those after a title or an introduction ("my name is"), and every later or earlier capitalised
mention of their words in the same text. A name that is also a month or another frequent word counts only beside a
title or another part of the name. A secret has a letter or digit; a value of punctuation alone stays.

Each entity has a canonical form without case and punctuation, so that mentions of one entity agree everywhere
(coreference); its surrogate is a keyed permutation of the canonical form within its alphabets (digits stay
digits, letters stay in their block of letters), put back into the mention's own punctuation and case. Card
numbers and IBANs with right check digits keep them right; addresses of private networks stay in their network, other
ones go to blocks that are not in use (240.0.0.0/4, 2001:db8::/32), and domains get the ending ``.example``, so that no
e-mail or network address of a third party comes up.
Names are built from syllables of their script, with an ending of their gender. A given name known only with
titles of no gender takes the gender that it has elsewhere in the corpus.

A permutation keeps different entities of one shape apart. Names, and surrogates that happen to equal some
entity of the corpus, are settled by a check over all distinct entities: those that collide get a further
attempt until none does. From the second further attempt on, names get a further syllable each time, e-mail
addresses, secrets and international phone numbers a further character; from ``LAST_FIXED`` on, formats of fixed
length get further digits. So a full format has room, and no corpus is an error. Surrogates that differ from
those of attempt zero go to the tasks that rewrite the texts, or come to the texts by a join where they are many.

The key is the caller's secret: who has it can undo the permutations.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import itertools
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import bounded, cut, written

#: Surrogates other than those of attempt zero that are sent to the tasks; more are joined with the texts.
MAX_EXCEPTIONS = 100_000
#: The attempt from which on formats of fixed length grow.
LAST_FIXED = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Each alternative begins where a run of its characters begins, so that the time is linear in the text.
_PATTERN = re.compile(
    r"(?<![\w.+-])[.+_-]*+(?P<email>[^\W_][\w.+-]*+@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})"
    r"|(?P<secret>(?i:(?<![^\W_])(?:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?[dt]|kennwort|mot de passe|contraseña|пароль|pwd)(?:[_-]?key)?(?![^\W_]))[\"']?[ \t]*[:=][ \t]*(?P<quote>[\"']?)(?P<value>(?=[+/.=~_-]*+[^\W_])[\w+/.=~-]{8,})(?P=quote))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)"
    rf"|(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\w))"
    r"|(?P<card>(?<![\w+.-])(?:\d{13,19}|\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))"
)
#: Further entities: what a text with one has, the pattern with the entity as its group, and its kind. They are sought only in
#: texts with such a mark, and give way to those above.
_FURTHER = [
    (("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox"), re.compile(r"(?<![\w-])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,})(?![\w-])"), "key"),
    (("earer ", "EARER "), re.compile(r"(?<![\w-])(?:[Bb]earer|BEARER)[ ]((?=[\w+/.=~-]*\d)[\w+/.=~-]{16,})"), "secret"),
    ((":",), re.compile(r"(?<![\w:.])([0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]{0,31})(?![\w:])"), "ip6"),
    (("SSN", "ecurity"), re.compile(r"(?<!\w)(?:SSN|[Ss]ocial [Ss]ecurity(?: [Nn]umber)?)[ :#.]{1,3}(\d{3}[ -]?\d{2}[ -]?\d{4})(?![\w-])"), "ssn"),
    (("0",), re.compile(r"((?:(?<![\w+./-])\()?0(?<![\w+./-]0)(?:\d(?:[ .-]\d{2}){4}|\d{1,4}\)?[ /-][ ]?\d{3,8}(?:[ -]\d{2,5}){0,2}))(?![\w-])"), "phone"),
]
_COLONS = re.compile(":[0-9A-Fa-f]{0,4}:")
#: Digits that a national number has at least and at most.
NATIONAL = (9, 13)
#: Titles and their gender.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Signor": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Signora": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Doctor": "n", "Professor": "n", "Доктор": "n",
}
#: What introduces a name.
INTRODUCTIONS = ["my name is", "name's", "ich heiße", "mein Name ist", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут"]
#: Names that are more often other words.
HOMONYMS = frozenset("april may june august mai mars avril juin juni juli mayo abril junio agosto will mark grace hope rose summer art frank bill".split())
#: Small words inside names.
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "du", "dos", "la", "le", "bin", "al", "el"]
#: Syllables and gendered endings by script, upper case first where a name begins.
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "la", "le", "lo", "ma", "me", "mi", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "ta", "te", "to", "va", "ve", "vi"],
    "cyrillic": ["ба", "бе", "во", "га", "да", "де", "до", "за", "ка", "ке", "ла", "ле", "ло", "ма", "ме", "ми", "на", "не", "но", "ра", "ре", "ро", "са", "се", "та", "те", "то", "фа", "ха", "ша", "ви", "ли"],
    "greek": ["βα", "βε", "γα", "δα", "δε", "δο", "ζα", "θα", "κα", "κε", "λα", "λε", "λο", "μα", "με", "μι", "να", "νε", "νο", "ρα", "ρε", "ρο", "σα", "σε", "τα", "τε", "το", "φα", "χα", "πα", "λι", "νι"],
}
ENDINGS = {
    "latin": {"m": "n", "f": "lia", "n": "s", "surname": "ld"},
    "cyrillic": {"m": "н", "f": "лия", "n": "с", "surname": "нд"},
    "greek": {"m": "ς", "f": "λια", "n": "ξ", "surname": "νδης"},
}
HEX = "0123456789abcdef"
#: Networks whose addresses stay in them: private, shared, loopback and link-local ones.
NETWORKS = [(0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x64400000, 22), (0x7F000000, 24), (0xA9FE0000, 16)]
RESERVED_DOMAIN = re.compile(r"(?:^|\.)example\.(?:com|net|org)$|\.(?:example|test|invalid)$")
#: Where other addresses go: the block and the bits inside it.
UNUSED_IP, UNUSED_IP6 = (0xF0000000, 28), (0x20010DB8 << 96, 96)
#: What every match of the pattern has at least.
_MARK = re.compile(r"[@\d]")
_WORDS = ("token", "secret", "key", "passw", "passe", "pwd", "kennwort", "contraseña", "пароль")


@functools.lru_cache(1)
def _names():
    """A pattern of titles in a row with the words after them, and one of capitalised words."""
    import regex

    titles = "|".join(sorted({*TITLES, *map(str.upper, TITLES)}, key=len, reverse=True))
    known = "|".join(INTRODUCTIONS)
    word = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-](?!s\b)[\p{L}\p{M}]++)*+"
    small = "|".join(PARTICLES)
    one = rf"(?:\p{{Lu}}\.[ ]?)*(?:(?:{small})[ ])*{word}"
    name = rf"{one}(?:[ ]{one}){{0,2}}"
    titled = rf"\b((?:(?:{titles})\b\.?[ ])+)({name})"
    introduced = rf"\b((?i:{known})[ ]+)({name})"
    before = rf"\b(?:{titles})\.?[ ]$"
    return regex.compile(titled), regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_]){word}"), regex.compile(introduced), regex.compile(before)


# -- detection -----------------------------------------------------------------------------------


def entities(text: str) -> list[tuple[int, int, str]]:
    """Places and kinds of the entities, in order and without overlap. A name's kind has its role: its
    gender (``n`` where only titles of no gender come with it) for given names, ``surname`` for the last name."""
    found, low = [], text.lower()
    digits = _MARK.search(text) is not None
    if digits or any(w in low for w in _WORDS):
        for m in _PATTERN.finditer(text):
            kind = m.lastgroup  # the outermost group
            found.append((*m.span("value" if kind == "secret" else kind), kind))
    if digits or "::" in text:
        further = [(*m.span(1), k) for marks, p, k in _FURTHER if any(x in text for x in marks) and (k != "ip6" or _COLONS.search(text)) for m in p.finditer(text) if _holds(k, m[1])]
        if further:
            found = _apart(found, further)
    if any(t in text for t in _GENDERS) or any(t in low for t in _INTRODUCED):
        roles = _roles(text)
        if roles:
            found += [(b, e, f"name:{roles[w]}") for b, e, w in _mentions(text, roles, found)]
            found.sort()
    return found


def _apart(found: list, further: list) -> list:
    """``found`` and those of ``further`` that overlap none before them."""
    out: list = []
    for x in sorted([(*f, 0) for f in found] + [(*f, 1) for f in further], key=lambda x: (x[0], x[3])):
        if out and x[0] < out[-1][1]:
            if x[3] == 1 or out[-1][3] == 0:
                continue
            out.pop()
        out.append(x)
    return [x[:3] for x in out]


_INTRODUCED = [x.lower() for x in INTRODUCTIONS]
_GENDERS = TITLES | {t.upper(): g for t, g in TITLES.items()}


def _holds(kind: str, found: str) -> bool:
    """Whether a further match is what its form suggests."""
    if kind == "phone":
        return NATIONAL[0] <= sum(map(str.isdigit, found)) <= NATIONAL[1]
    if kind == "ip6":
        try:
            ipaddress.IPv6Address(found)
        except ValueError:
            return False
    return True


def _roles(text: str) -> dict[str, str]:
    """Role of every word of a titled or introduced name in a text: a gendered title wins, then the first role."""
    titled, word, introduced, _ = _names()
    roles: dict[str, str] = {}
    for m in itertools.chain(titled.finditer(text), introduced.finditer(text)):
        genders = [_GENDERS.get(t.strip(". "), "n") for t in m.group(1).split(" ") if t]
        gender = next((g for g in genders if g != "n"), "n")
        *given, last = [w for w in word.findall(m.group(2)) if len(w) > 1] or [""]
        for w in map(_lower, given):
            roles[w] = gender if roles.get(w, "n") == "n" else roles[w]
        if last:
            roles.setdefault(_lower(last), "surname")
    return roles


def _mentions(text: str, roles: dict[str, str], found: list) -> list[tuple[int, int, str]]:
    """Capitalised words that are in the text's names and lie in no other entity; titles are none."""
    out, k = [], 0
    for m in _names()[1].finditer(text):
        b, e = m.span()
        while k < len(found) and found[k][1] <= b:
            k += 1
        w = _lower(m.group())
        if w in roles and m.group() not in _GENDERS and not (k < len(found) and found[k][0] < e):
            out.append((b, e, w))
    return [x for n, x in enumerate(out) if x[2] not in HOMONYMS or _in_name(text, out, n)]


def _in_name(text: str, mentions: list[tuple[int, int, str]], n: int) -> bool:
    """Whether a mention stands after a title or beside another part of a name."""
    b, e, _ = mentions[n]
    after = n and re.fullmatch(r" (?:\w\. ?)*", text[mentions[n - 1][1] : b]) or n + 1 < len(mentions) and text[e : mentions[n + 1][0]] == " "
    return bool(after or _names()[3].search(text, max(0, b - 24), b))


def canonical(kind: str, mention: str) -> str:
    """What all mentions of one entity share."""
    if kind in ("phone", "card", "ssn"):
        return ("+" if mention.startswith("+") else "") + re.sub(r"\D", "", mention)
    if kind == "iban":
        return mention.replace(" ", "").lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(mention).exploded
    return _lower(mention)


def _lower(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


# -- surrogates ----------------------------------------------------------------------------------


def _permuted(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of ``range(size)``: a Feistel network over enough bits, walked until in range."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            drawn = b"".join(hmac.digest(key, f"{tweak}|{r}|{right}|{k}".encode(), hashlib.sha256) for k in range(half // 256 + 1))
            left, right = right, left ^ (int.from_bytes(drawn, "big") & mask)
        value = left << half | right
        if value < size:
            return value


@functools.lru_cache(4096)
def _alphabet(c: str) -> str:
    """Characters among which one is permuted: the digits of its script, or the letters of its kind and block."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    kind = unicodedata.category(c)
    if kind not in ("Ll", "Lo", "Lu", "Lt"):
        return ""
    block = map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1))
    return "".join(x for x in block if unicodedata.category(x) == kind and _lower(x) == x and not x.isascii()) if _lower(c) == c else ""


def _in_alphabets(key: bytes, tweak: str, text: str, alphabets: list[str]) -> str:
    """Permute the characters that have an alphabet, as one number in mixed radix."""
    at = [k for k, a in enumerate(alphabets) if a]
    value, size = 0, 1
    for k in at:
        value, size = value * len(alphabets[k]) + alphabets[k].index(text[k]), size * len(alphabets[k])
    shape = "".join(a[0] if a else c for a, c in zip(alphabets, text, strict=True))
    value, out = _permuted(key, f"{tweak}|{shape}", value, size), list(text)
    for k in reversed(at):
        value, r = divmod(value, len(alphabets[k]))
        out[k] = alphabets[k][r]
    return "".join(out)


#: Characters of a form that are permuted as one number; of longer ones, each such part by itself.
PART = 400


def _permuted_text(key: bytes, tweak: str, text: str, alphabets: list[str] | None = None) -> str:
    alphabets = alphabets or [_alphabet(c) for c in text]
    parts = range(0, len(text), PART)
    return "".join(_in_alphabets(key, f"{tweak}|{k}" if k else tweak, text[k : k + PART], alphabets[k : k + PART]) for k in parts)


def _longer(text: str, more: int) -> str:
    """The text with further characters of its last alphabet."""
    last = next((a for a in map(_alphabet, reversed(text)) if a), "abcdefghijklmnopqrstuvwxyz")
    return text + last[0] * more


def _luhn(digits: str) -> bool:
    doubled = (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def _iban_rest(form: str) -> int:
    """Remainder by 97 of an account number with its country and check digits at the end; 1 is right."""
    return int("".join(str(int(c, 36)) for c in form[4:] + form[:4])) % 97


def _script(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "\u0400" <= c <= "\u04ff" else "greek" if "\u0370" <= c <= "\u03ff" else "latin"


def _network(value: int) -> tuple[int, int]:
    return next(((base, bits) for base, bits in NETWORKS if value >> bits == base >> bits), (0, 32))


def _ip(key: bytes, tweak: str, form: str, more: int) -> str:
    value = 0
    for x in form.split("."):
        value = value << 8 | int(x)
    base, bits = _network(value)
    value = _permuted(key, f"{tweak}|{base}", value & ((1 << bits) - 1), 1 << bits)
    if bits == 32:
        base, bits = UNUSED_IP
    value = base | value & ((1 << bits) - 1)
    further = [_permuted(key, f"{tweak}|{form}|{k}", 0, 256) for k in range(more)]
    return ".".join(map(str, [*(value >> s & 255 for s in (24, 16, 8, 0)), *further]))


def surrogate(key: bytes, kind: str, form: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical form."""
    tweak, more, late = f"{kind}|{attempt}", max(0, attempt - 1), max(0, attempt - LAST_FIXED + 1)
    if kind == "ip":
        return _ip(key, tweak, form, late)
    if kind == "ip6":
        base, bits = UNUSED_IP6
        return ipaddress.IPv6Address(base | _permuted(key, tweak, int(ipaddress.IPv6Address(form)), 1 << 128) & ((1 << bits) - 1)).exploded
    if kind == "key":
        form, begin = _longer(form, more), re.match(r"akia|asia|gh[pousr]_|sk-|xox[abprs]-", form).end()
        return form[:begin] + _permuted_text(key, f"{tweak}|{form[:begin]}", form[begin:])
    if kind.startswith("name"):
        script, role = _script(form), kind.partition(":")[2]
        n = (4 if role == "surname" else 3) + more
        drawn = b"".join(hmac.digest(key, f"{tweak}|{form}|{k}".encode(), hashlib.sha256) for k in range(n // 32 + 1))
        return "".join(SYLLABLES[script][x & 31] for x in drawn[:n]) + ENDINGS[script][role]
    if kind == "email":
        local, _, domain = form.rpartition("@")
        tweak, at = f"{tweak}|{domain}", domain
        if not RESERVED_DOMAIN.search(domain):
            host, dot, top = domain.rpartition(".")
            at = _permuted_text(key, f"{kind}|{attempt}|{top}", host) + dot + top + ".example"
        return _permuted_text(key, tweak, _longer(local, more)) + "@" + at
    if kind == "secret" or kind == "phone" and form.startswith("+"):
        form = _longer(form, more)
    elif late:
        form += "0" * late
    if kind == "secret":
        return _permuted_text(key, tweak, form, [HEX] * len(form) if all(c in HEX for c in form) else None)
    alphabets = [_alphabet(c) for c in form]
    if kind == "iban":
        alphabets[:2] = ["", ""]  # the country stays
        right = not late and _iban_rest(form) == 1
        if right:
            alphabets[2:4] = ["", ""]
            body = _in_alphabets(key, f"{tweak}|right", form[:2] + "00" + form[4:], alphabets)
            return f"{body[:2]}{98 - _iban_rest(body):02}{body[4:]}"
    elif kind == "phone":
        if re.fullmatch(r"\+1\d{10}", form):
            alphabets[1:2] = [""]  # the country stays, and an exchange that is kept for fiction
            alphabets[5:8] = [""] * 3 if form[5:8] == "555" else alphabets[5:8]
        elif form.startswith("+"):
            alphabets[1:3] = ["", ""]
    valid, out = kind == "card" and _luhn(form), form
    for _ in range(1000):  # walking on keeps it a permutation of the numbers with a right check digit
        out = _in_alphabets(key, tweak, out, alphabets)
        if not valid or _luhn(out):
            break
    return out


def in_format(kind: str, mention: str, form: str) -> str:
    """A canonical surrogate in the punctuation and case of a mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        letters = iter(form.lstrip("+") if kind == "phone" else form)
        out = "".join([next(letters) if c.isalnum() else c for c in mention]) + "".join(letters)
        return out.upper() if kind == "iban" else out
    if kind.startswith("name"):
        return form.upper() if len(mention) > 1 and mention.isupper() else form[0].upper() + form[1:]
    if kind == "ip6":
        short = ipaddress.IPv6Address(form).compressed
        return short.upper() if mention.upper() == mention != mention.lower() else short
    if kind in ("secret", "key") and mention.upper() == mention:
        return form.upper()
    if kind == "email":
        return "@".join(_in_case(f, m) for f, m in zip(form.rsplit("@", 1), mention.rsplit("@", 1), strict=True))
    return _in_case(form, mention)


def _in_case(form: str, mention: str) -> str:
    """Upper case where the mention has it; further characters are in lower case."""
    return "".join(f.upper() if m.isupper() and len(f.upper()) == 1 else f for f, m in itertools.zip_longest(form, mention[: len(form)], fillvalue="a"))


# -- on Spark ------------------------------------------------------------------------------------


def corpus_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct ``kind`` and ``form`` over all texts."""
    import pyarrow as pa

    def run(batches):
        for batch in bounded(batches, 0):
            seen = {(k, canonical(k, t[b:e])) for t in batch.column(0).to_pylist() if t for b, e, k in entities(t)}
            kinds, forms = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(forms, pa.string())], ["kind", "form"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "kind string, form string").distinct()


def _with_surrogates(rows: DataFrame, key: bytes) -> DataFrame:
    """``rows`` dealt anew by kind and form, whatever their size, since surrogates take long for their bytes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            kinds, forms, attempts = (c.to_pylist() for c in batch.columns)
            made = [surrogate(key, k, f, a) for k, f, a in zip(kinds, forms, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "form", "attempt", "surrogate"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("kind", "form", "attempt").repartition(n, "kind", "form")
    return dealt.mapInArrow(run, "kind string, form string, attempt int, surrogate string")


def settled_attempts(found: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``form``, ``attempt``, ``surrogate`` of every entity, where no two entities of a kind share
    a surrogate and no surrogate is an entity of the corpus."""
    rows = cut(_with_surrogates(found.withColumn("attempt", F.lit(0)), key))
    while True:
        real = found.select(F.col("kind").alias("k"), F.col("form").alias("f"))
        equal = rows.join(real, (rows["kind"] == real["k"]) & (rows["surrogate"] == real["f"]), "left_semi").select("kind", "form")
        first = rows.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "form")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = rows.join(first, ["kind", "surrogate"]).where("form <> first.form").select("kind", "form")
        again = cut(equal.union(shared).distinct())
        if again.isEmpty():
            return rows
        # Each further attempt draws anew, and from some attempt on from a larger space: this ends.
        moved = rows.join(again, ["kind", "form"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        rows = cut(rows.join(again, ["kind", "form"], "left_anti").select("kind", "form", "attempt", "surrogate").union(_with_surrogates(moved, key)))


def other_surrogates(docs: DataFrame, text_col: str, key: bytes) -> DataFrame:
    """``kind``, ``form``, ``surrogate`` of the entities whose surrogate is not that of attempt zero."""
    found = cut(corpus_entities(docs, text_col))
    # A given name without a gender is the one with a gender, where the corpus has it: women's first.
    gendered = found.where("kind in ('name:f', 'name:m')").groupBy("form").agg(F.min("kind").alias("as"))
    alias = cut(found.where("kind = 'name:n'").join(gendered, "form").select("kind", "form", "as"))
    settled = settled_attempts(found.join(alias, ["kind", "form"], "left_anti"), key)
    theirs = alias.select(F.col("kind").alias("own"), "form", F.col("as").alias("kind")).join(settled, ["kind", "form"])
    return settled.where("attempt > 0").select("kind", "form", "surrogate").union(theirs.select("own", "form", "surrogate"))


def _with_others(docs: DataFrame, text_col: str, over: DataFrame) -> DataFrame:
    """``docs`` with the other surrogates of each row's entities as an array in a last column, ``others``.

    The columns of ``docs`` must not be named ``row`` or ``others``.
    """
    import pyarrow as pa

    rows = written(docs.withColumn("row", F.expr("uuid()")), "pii-rows")
    names = ["row", "kind", "form"]

    def run(batches):
        for batch in bounded(batches, 1):
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kinds, forms = zip(*seen, strict=True) if (seen := {(k, canonical(k, t[b:e])) for b, e, k in entities(t or "")}) else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(kinds), pa.string()), pa.array(kinds, pa.string()), pa.array(forms, pa.string())], names)

    theirs = rows.select("row", F.col(text_col).cast("string").alias("text")).mapInArrow(run, "row string, kind string, form string")
    lists = theirs.join(over, ["kind", "form"]).groupBy("row").agg(F.collect_list(F.struct("kind", "form", "surrogate")).alias("others"))
    return rows.join(lists, "row", "left").select(*docs.columns, "others")


def rewrite(text: str, key: bytes, others: dict[tuple[str, str], str], memo: dict | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of the entities replaced, in order. ``others`` has the surrogates
    that are not those of attempt zero."""
    memo = {} if memo is None else memo
    parts, kinds, last = [], [], 0
    for b, e, kind in entities(text):
        form = canonical(kind, text[b:e])
        if (kind, form) not in memo:
            if len(memo) > 100_000:
                memo.clear()
            memo[kind, form] = others.get((kind, form)) or surrogate(key, kind, form)
        parts += [text[last:b], in_format(kind, text[b:e], memo[kind, form])]
        kinds.append(kind.partition(":")[0])
        last = e
    return "".join([*parts, text[last:]]), kinds


def replace_pii(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str | None = "n_chars", kinds_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text. Texts without entities, empty and null ones stay as they are.

    ``length_col``, where the table has it, is set to the new length of a changed text. ``kinds_col`` adds
    an array with the kind of every entity replaced (null text: empty), in place of a column of that name. All other
    columns may have any names. Very long texts are searched whole, in time that grows with their length. Rows are
    rewritten one by one, so repeated rows stay repeated, and one entity has one surrogate in all of them. An empty table stays
    empty.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    if not key:
        raise ValueError("replace_pii needs a key")
    if kinds_col in docs.columns:
        docs = docs.drop(kinds_col)
    over = other_surrogates(docs, text_col, key)
    few = over.limit(MAX_EXCEPTIONS + 1).collect()
    joined = len(few) > MAX_EXCEPTIONS
    others = {} if joined else {(r["kind"], r["form"]): r["surrogate"] for r in few}
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None
    # Columns go by place, so that their names are free.
    names = [f"c{k}" for k in range(len(docs.columns))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]
    if kinds_col:
        fields.append(T.StructField("kinds", T.ArrayType(T.StringType())))

    def run(batches):
        memo: dict = {}
        for batch in bounded(batches, at):
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            if joined:
                own = [{(a["kind"], a["form"]): a["surrogate"] for a in x or []} for x in columns.pop().to_pylist()]
                done = [rewrite(t, key, x) if t else (t, []) for t, x in zip(texts, own, strict=True)]
            else:
                done = [rewrite(t, key, others, memo) if t else (t, []) for t in texts]
            columns[at] = pa.array([t for t, _ in done], pa.string())
            if length_at is not None:
                lengths = batch.column(length_at).to_pylist()
                changed = [len(t) if k and n is not None else n for (t, k), n in zip(done, lengths, strict=True)]
                columns[length_at] = pa.array(changed, batch.column(length_at).type)
            if kinds_col:
                columns.append(pa.array([k for _, k in done], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    placed = docs.toDF(*names)
    found = (_with_others(placed, names[at], over) if joined else placed).mapInArrow(run, T.StructType(fields))
    return found.toDF(*docs.columns, *([kinds_col] if kinds_col else []))
