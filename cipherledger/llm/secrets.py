"""Credentials in code snippets: found, located and masked in place.

A keyword automaton tells which expressions can match a text at all; formats of issuers and literal
contexts (assignment, element, flag, header, URL, key constructor, PEM block, ...) propose values;
checksums and structure checks reject placeholders, lookups, patterns, messages and encrypted values;
what remains is replaced by a placeholder of the same length and alphabet.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.scale import spread

#: Formats of issuers: prefix, alphabet and length fix the whole value (fixed values).
ISSUER_FORMATS = [
    r"(?:AKIA|ASIA)[2-7A-Z]{16}",
    r"gh[posur]_[0-9A-Za-z]{36}",
    r"zk_live_[0-9A-Za-z]{28}",
    r"plt-[0-9A-Za-z]{6}-[0-9A-Za-z]{6}-[0-9A-Za-z]{6}-[0-9A-Za-z]{6}",
    r"[sr]k_live_[0-9A-Za-z]{24,}",
    r"xox[abprs]-[0-9A-Za-z-]{20,}",
    r"glpat-[0-9A-Za-z_-]{20}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{10,}",
]
#: The same formats where the snippet was cut within the value.
ISSUER_PREFIXES = r"(?:AKIA|ASIA|gh[posur]_|zk_live_|plt-|[sr]k_live_|xox[abprs]-|glpat-|AIza|eyJ)[0-9A-Za-z_.-]*$"

#: Ends of a name, without case and separators, that announce a secret (fixed values).
SECRET_ENDS = (
    "password", "passwd", "passphrase", "passcode", "pass", "pwd", "pw", "secret", "secretkey", "secretkeybase", "token", "apikey", "accesskey",
    "privatekey", "signingkey", "webhookkey", "licencekey", "licensekey", "masterkey", "encryptionkey", "encryptkey", "hmackey", "authkey", "sharedkey",
    "kennwort", "passwort", "motdepasse", "claveacceso", "clave", "contrasena", "contraseña", "senha", "wachtwoord", "pin", "credential", "credentials",
)
#: First parts of a name that make it a caption, a rule or a name of something else (fixed values).
NOT_SECRET = re.compile(r"^(?:label|message|msg|error|hint|prompt|placeholder|title|caption|tooltip)[._-]|public", re.I)

PLACEHOLDER = re.compile(
    r"""^(?:\**|x+|\.+|-+|_+|\#+|<.*>?|\[.*\]?|\(.*\)|\{.*|\$\{.*|\$\(.*|\$[A-Za-z_]\w*|%\(.*|%[A-Za-z_]+%|@.*@
    |(?:replace|change|insert|enter|fill|put|add)[\s_-]?(?:me|this|it|here|in|your|the)?.{0,12}|your[\s_-].*|my[\s_-](?:secret|password|key|token)
    |(?:not|un)[\s_-]?set|none|null|nil|undefined|true|false|todo|tbd|redacted|masked|hidden|removed|example|sample|placeholder|dummy|n/?a|empty
    |string|str|int|integer|number|bool|boolean|bytes|any|object|char|text|optional|required|password|passwd|secret|token|apikey|api_key)$""",
    re.I | re.X,
)
ENCRYPTED = re.compile(r"^(?:ENC\(|\{cipher\}|\{aes\}|\$ANSIBLE_VAULT|vault:|kms:|sops:|AQICA|!vault|\$2[aby]\$|\$argon2|pbkdf2|sha\d+\$|\{SSHA)", re.I)

_NAME = r"(?<![A-Za-z0-9_$])[A-Za-z_$][\w.$\-]{0,120}"  # bounded, so that long runs of letters are passed once
_QUOTED = r"""[bBrRuU]?(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q)).)*)(?P<end>(?P=q)|$)"""
_DECODE = r"(?:[\w.]*(?:fromhex|unhexlify|b64decode|decode|Buffer\.from|atob|DecodeString|getBytes|encode)\w*\(\s*)?"
#: name, separator, quoted value; also `"name": "v"`, `name["x"] = "v"`, `name := "v"`, `name == "v"`.
ASSIGNED = re.compile(rf"""(?P<n>{_NAME})["'\]]*\s*(?:===?|:=|=>|=|:(?=\s))\s*(?P<d>{_DECODE}){_QUOTED}""")
#: A secret's name as an argument before the value: define('NAME', 'v'), setProperty("name", "v"), getenv("NAME", "default").
ARGUMENT = re.compile(rf"""["'](?P<n>[\w.\-]+)["']\s*,\s*{_QUOTED}""")
#: NAME=v at a line's start (env files, ENV of container files), name: v (yaml), both without quotes.
BARE = re.compile(r"""^[ \t]*(?:(?:ENV|ARG|export|set)[ \t]+)?["']?(?P<n>[A-Za-z_][\w.\-]*)["']?(?:=|:[ \t]+)(?P<v>[^\s"'`]\S*?)[;,]?[ \t]*$""", re.M)
ELEMENT = re.compile(r"<(?P<n>[A-Za-z_][\w.\-]*)>(?P<v>[^<\s][^<]*?)\s*(?:</|$)")
PROPERTY = re.compile(r"""name=["'](?P<n>[\w.\-]+)["']\s+value=["'](?P<v>[^"'\n]*)(?P<end>["']|$)""")
CONNECTION = re.compile(r"""[;"'\s](?P<n>Password|Pwd)=(?P<v>[^;"'\n]+)(?=[;"']|$)""", re.I)
NPMRC = re.compile(r":_(?:authToken|auth|password)=(?P<v>\S+)")
URL = re.compile(r"""(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.\-]{0,30}://[^/\s:@"']*:(?P<v>[^\s/"'@]+(?:@[^\s/"'@]+)*?)(?:@(?=[^\s/"'@]+(?:[:/"'\s]|$))|$)""")
FLAGS = [
    re.compile(r"-pass(?:in|out)?\s+pass:(?P<v>\S+)"),
    re.compile(r"-(?:storepass|keypass|srcstorepass|deststorepass)\s+(?P<v>\S+)"),
    re.compile(r"--(?:password|passwd|token|secret|api-key|access-key)[=\s]+[\"']?(?P<v>[^\s\"']+)"),
    re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\n]{0,300}?\s-p(?P<v>[^\s\-][^\s]*)"),
    re.compile(r"\b(?:sshpass|redis-cli)\b[^\n]{0,300}?\s-[pa]\s+(?P<v>\S+)"),
    re.compile(r"\bcurl\b[^\n]{0,300}?\s(?:-u|--user)\s+[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)"),
]
HEADER = re.compile(r"\b(?P<s>Basic|Bearer)\s+(?P<v>[0-9A-Za-z+/=_.\-]{8,})")
KEY_LITERAL = re.compile(rf"(?:(?:\b(?:AES|DES|DES3|ARC2|ARC4|Blowfish|CAST|ChaCha20|ChaCha20_Poly1305|Salsa20|Fernet|hmac)\.new|\bFernet|\bSecretKeySpec|createHmac\(\s*[\"'][\w-]+[\"']\s*,|createCipher(?:iv)?\(\s*[\"'][\w-]+[\"']\s*,)\(?\s*(?:bytes\.fromhex\(\s*)?){_QUOTED}")
COMPARED = re.compile(r"""\.(?:equals|equalsIgnoreCase|contentEquals|compareTo)\(\s*["'](?P<v>[^"'\n]+)["']\s*\)[^\n]{0,200}?(?:grant|admin|allow|unlock|login|auth|access)""", re.I)
TOLD = re.compile(r"\b(?:login|credentials?|account|user)\b[^:\n]{0,60}:\s*[\w.@\-]+\s*/\s*(?P<v>\S+)", re.I)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\s|\\n|\\r|[\"'+])+(?P<m>[0-9A-Za-z+/=]{4,}(?:\s|\\n|\\r|[\"'+]|[0-9A-Za-z/=])*)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)?")
JOINED = re.compile(r"""["']\s*\+\s*\n?\s*["']([^"'\n]*)""")
LEFT = 12  #: characters that must be left of a value that was cut off


def _secret_name(name: str) -> bool:
    plain = re.sub(r"[^0-9a-zñ]", "", name.lower())
    return plain.endswith(SECRET_ENDS) and not NOT_SECRET.search(name)


def _key_name(name: str) -> bool:
    plain = re.sub(r"[^0-9a-z]", "", name.lower())
    return plain.endswith("key") and "public" not in plain


# Words that make a text of several words a message, not a passphrase.
MESSAGE = frozenset("the a an your you is are was be must has have will can should please enter type choose for not no to of this that with at least and or if in on from wrong invalid required".split())


def _message(value: str) -> bool:
    return value[-1:] in ".!?:" or any(w in MESSAGE for w in re.findall(r"[a-z']+", value.lower()))


def _literal(value: str, cut: bool, quoted: bool = True) -> bool:
    """Whether a proposed value is a literal secret, not a placeholder, lookup, pattern, message or encrypted value."""
    if len(value) < (LEFT if cut else 4) or PLACEHOLDER.match(value) or ENCRYPTED.match(value):
        return False
    if value.startswith("^") or "${" in value or "{{" in value or "%(" in value or value.count(" ") >= 2 and _message(value):
        return False
    if re.fullmatch(r"[\w.]*\{[\w.]+\}[\w.]*", value) or "://" in value:
        return False
    return not re.search(r"^[\w.]+\(.*[\"'].*\)|\[[\"']" if quoted else r"[\w\]]\(|\[[\"']", value)  # a call or lookup


def _basic(value: str) -> bool:
    """Base64 of user:password, perhaps cut."""
    try:
        text = base64.b64decode(value[: len(value) // 4 * 4], validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, password = text.partition(":")
    return bool(colon and user and password) and text.isprintable() and not PLACEHOLDER.match(password)


def _bearer(value: str) -> bool:
    """A token with the structure of its kind: a JWT's header must be JSON that names an algorithm."""
    if value.startswith("eyJ"):
        head = value.split(".")[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except ValueError:
            return "." not in value  # cut within the header
    return len(value) >= 16 and bool(re.search(r"\d", value))


def _issued(value: str) -> bool:
    """Whether a value in an issuer's format has the structure or checksum of that issuer.

    The last six characters of gh*_ tokens are the CRC-32 of the thirty before in base 62. Tokens of other
    issuers of that format, and older ones, lack it, so a wrong sum rejects only texts of few different characters.
    """
    if value.startswith("eyJ"):
        return _bearer(value)
    return not value.startswith("gh") or checksum_holds(value) or len(set(value[4:])) >= 10


def checksum_holds(token: str) -> bool:
    """Whether the last six characters of a gh*_ token are the checksum of those before."""
    rest, digits = zlib.crc32(token[4:-6].encode()), ""
    for _ in range(6):
        rest, k = divmod(rest, 62)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[k] + digits
    return token[-6:] == digits


_ISSUER = re.compile(r"(?<![0-9A-Za-z_])(?P<v>" + "|".join(ISSUER_FORMATS) + r")(?![0-9A-Za-z])")
_ISSUER_CUT = re.compile(r"(?<![0-9A-Za-z_])(?P<v>" + ISSUER_PREFIXES + ")")


@dataclass(frozen=True)
class Form:
    """An expression that proposes values, and texts of which every match holds one (in lower case; of a named form, without separators)."""

    kind: str
    regex: re.Pattern
    anchors: tuple[str, ...] = ()
    named: bool = False
    quoted: bool = True
    check: Callable[[str], bool] | None = None
    cut_only: bool = False


def _least(words: tuple[str, ...]) -> tuple[str, ...]:
    """The words that hold no other of them: a text that holds any word holds one of these."""
    return tuple(w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words))


#: Names end with one of SECRET_ENDS, or with `key` before a decoded literal.
NAME_ANCHORS = _least((*SECRET_ENDS, "key"))
ISSUER_ANCHORS = ("akia", "asia", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "zk_live_", "plt-", "sk_live_", "rk_live_", "xox", "glpat-", "aiza", "eyj")
FORMS = [
    Form("private_key", PEM, ("private key",)),
    Form("issuer_token", _ISSUER, ISSUER_ANCHORS, check=_issued),
    Form("issuer_token", _ISSUER_CUT, ISSUER_ANCHORS, cut_only=True, check=lambda v: len(v) >= LEFT),
    Form("assigned", ASSIGNED, named=True),
    Form("argument", ARGUMENT, named=True),
    Form("assigned", BARE, named=True, quoted=False),
    Form("element", ELEMENT, named=True),
    Form("element", PROPERTY, named=True),
    Form("connection", CONNECTION, ("password=", "pwd=")),
    Form("assigned", NPMRC, (":_auth", ":_password"), quoted=False),
    Form("url", URL, ("://",), quoted=False),
    Form("compared", COMPARED, (".equals", ".contentequals", ".compareto")),
    Form("comment", TOLD, ("login", "credential", "account", "user"), quoted=False),
    Form("flag", FLAGS[0], ("pass:",), quoted=False),
    Form("flag", FLAGS[1], ("storepass", "keypass"), quoted=False),
    Form("flag", FLAGS[2], ("--pass", "--token", "--secret", "--api-key", "--access-key"), quoted=False),
    Form("flag", FLAGS[3], ("mysql", "mariadb"), quoted=False),
    Form("flag", FLAGS[4], ("sshpass", "redis-cli"), quoted=False),
    Form("flag", FLAGS[5], ("curl",), quoted=False),
    Form("key_literal", KEY_LITERAL, (".new", "fernet", "secretkeyspec", "createhmac(", "createcipher")),
    Form("header", HEADER, ("basic", "bearer")),
]
_SEPARATOR = re.compile(r"[^0-9a-zñ]+")


@cache
def _automaton(named: bool):
    import ahocorasick

    words: dict[str, int] = {}
    for i, form in enumerate(FORMS):
        for w in (NAME_ANCHORS if named else ()) if form.named else (() if named else form.anchors):
            words[w] = words.get(w, 0) | 1 << i
    automaton = ahocorasick.Automaton()
    for w, forms in words.items():
        automaton.add_word(w, forms)
    automaton.make_automaton()
    return automaton


def possible_forms(text: str) -> int:
    """The forms, one bit each, of which the text holds an anchor; no other form matches it."""
    low, out = text.lower(), 0
    for _, forms in _automaton(False).iter(low):
        out |= forms
    named = next(_automaton(True).iter(_SEPARATOR.sub("", low)), None)
    return out | named[1] if named else out


def find_secrets(text: str, cut: bool = False, every_form: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each literal secret of a text, by start; spans don't overlap.

    cut: the text was cut off at its end by its source, so a value that reaches the end counts if LEFT
    characters of it are left, whatever its closing. every_form tries all forms, not only the possible ones.
    """
    possible = -1 if every_form else possible_forms(text)
    if not possible:
        return []
    found: list[tuple[int, int, str]] = []

    def propose(m: re.Match, form: Form) -> None:
        start, end = m.span("v")
        value = text[start:end]
        at_end = cut and end >= len(text) - 1
        if "end" in m.re.groupindex and not m.group("end") and not cut:
            return
        joined = end
        while piece := JOINED.match(text, joined):
            value, joined = value + piece.group(1), piece.end()
        check = form.check
        if form.regex is HEADER:
            check = _basic if m.group("s") == "Basic" else _bearer
        if check(text[start:end]) if check else _literal(value, at_end and joined == end, form.quoted):
            found.append((start, end if check else joined, form.kind))

    for i, form in enumerate(FORMS):
        if not possible >> i & 1 or form.cut_only and not cut:
            continue
        for m in form.regex.finditer(text):
            if form.regex is PEM:
                first = re.match(r"[0-9A-Za-z+/=]+", m.group("m")).group()
                if len(first) >= LEFT or cut and m.end() == len(text):
                    found.append((m.start(), m.end(), form.kind))
            elif not form.named or _secret_name(m.group("n")) or form.regex is ASSIGNED and m.group("d") and _key_name(m.group("n")):
                propose(m, form)

    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and start < out[-1][1]:
            continue
        out.append((start, end, kind))
    return out


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by a placeholder of its length and alphabet; PEM borders and joins stay."""
    parts, at = [], 0
    for start, end, kind in spans:
        value = text[start:end]
        if kind == "private_key":
            pieces = re.split(r"(-----(?:BEGIN|END)[^-]*-----|\\n|\\r)", value)
            value = "".join(p if i % 2 else _blank(p) for i, p in enumerate(pieces))
        else:
            value = _blank(value)
        parts += [text[at:start], value]
        at = end
    return "".join([*parts, text[at:]])


#: What must keep its form inside a value: escapes of characters (their digits are replaced), entities.
_ESCAPE = re.compile(r"(\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|%[0-9A-Fa-f]{2}|\\.|&[A-Za-z]+;|&#\d+;)", re.S)
_HEX = re.compile(r"(?:0[xX])?[0-9A-Fa-f]+(?:[-: ]?[0-9A-Fa-f]+)*")
# A letter of each script for which there is one (capital, small); other letters keep to Latin ones.
_LETTER = {"LATIN": ("Ø", "ø"), "GREEK": ("Α", "α"), "CYRILLIC": ("А", "а"), "HEBREW": ("א", "א"), "ARABIC": ("ا", "ا"), "HIRAGANA": ("あ", "あ"), "KATAKANA": ("ア", "ア"), "HANGUL": ("가", "가"), "CJK": ("一", "一")}


def _letter(c: str) -> str:
    """A letter of the same script and case, a zero of the same digits, else the character itself."""
    if c.isdecimal():
        return chr(ord(c) - unicodedata.decimal(c))
    if not c.isalpha():
        return c
    return _LETTER.get(unicodedata.name(c, "LATIN").split()[0], _LETTER["LATIN"])[0 if c.isupper() else 1]


def _blank(value: str) -> str:
    """Placeholder of the same length and alphabet: hexadecimal stays hexadecimal, escapes stay escapes, letters keep case and script."""
    if _HEX.fullmatch(value):
        head = value[:2] if value[:2] in ("0x", "0X") else ""
        return head + re.sub(r"[A-F]", "A", re.sub(r"[a-f]", "a", re.sub(r"[0-9]", "0", value[len(head) :])))
    parts = _ESCAPE.split(value)
    for i, part in enumerate(parts):
        if i % 2:
            digits = len(part) - 2 if part[:1] == "\\" and len(part) > 2 else 2 if part[:1] == "%" else 0
            parts[i] = part[: len(part) - digits] + "30".rjust(digits, "0") if digits else part
        else:
            plain = re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", part)))
            parts[i] = plain if plain.isascii() else "".join(c if c.isascii() else _letter(c) for c in plain)
    return "".join(parts)


FINDINGS = "id string, start_char int, end_char int, kind string, masked string"


def secrets_in(evidence: DataFrame, key: str = "id", text: str = "snippet", cut_at: int | None = None) -> DataFrame:
    """id, start_char, end_char, kind, masked: one row per distinct secret of each snippet.

    start_char and end_char are 0-based offsets in characters; masked is the whole snippet with
    all its secrets masked. cut_at: the source cuts its texts off at so many characters, so a text
    that long may end inside a value; without it texts are whole, however long. Null and empty texts
    hold none; repeated rows count once; rows with a null key keep it. Other columns are not read.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"]):
                if t and (spans := find_secrets(t, cut_at is not None and len(t) >= cut_at)):
                    masked = mask(t, spans)
                    rows += [(k, start, end, kind, masked) for start, end, kind in spans]
            yield pd.DataFrame(rows, columns=["id", "start_char", "end_char", "kind", "masked"])

    return spread(evidence.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))).mapInPandas(scan, FINDINGS).dropDuplicates()


def masked_snippets(evidence: DataFrame, key: str = "id", text: str = "snippet", cut_at: int | None = None) -> DataFrame:
    """id, masked: every row's text with its secrets masked; texts without one stay as they are. cut_at as in secrets_in."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["masked"] = [mask(t, find_secrets(t, cut_at is not None and len(t) >= cut_at)) if t else t for t in batch["masked"]]
            yield batch

    return spread(evidence.select(F.col(key).cast("string").alias("id"), F.col(text).alias("masked"))).mapInPandas(scan, "id string, masked string")
