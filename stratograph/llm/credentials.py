"""Credentials embedded in source code and documentation: finding and masking.

An automaton over all anchors (names of secrets, token prefixes, key armor, connection strings, authentication schemes) runs over each
text in overlapping chunks. Where an anchor stands, one deterministic automaton reads everything that is regular: token
formats, armor, connection strings, schemes, logins and flags. What needs a matching quote or the words around it (assignments,
defaults, prose) is read by expressions on the line of the anchor. Absolute spans from
overlapping chunks are made distinct, and placeholders are spliced in from the back, so that nothing
but the values changes.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratograph.llm.automaton import Grammar, any_of, chars, either, exact, none_of, seq, times, word_of
from stratograph.session import spread

CHUNK, OVERLAP = 1 << 20, 1 << 13
#: Characters of the shortest value: below it, too much is taken for one. There is no longest.
SHORTEST = 5
MASK = "*"

FOUND_SCHEMA = "id string, field string, line_no long, kind string"
MASKED_SCHEMA = "id string, field string, masked string, credentials long"

# ---- fixed values -----------------------------------------------------------------------------
#: Words of which a name of a secret is made, several languages; all lower case.
_SECRET_WORDS = frozenset("password passwd passwort passphrase passcode passwrd pass pwd pw secret secrets credential credentials cred creds apikey token jwt clave contrasena contraseña senha parola kennwort geheimnis geheim wachtwoord motdepasse passe пароль 密码 密碼 口令 パスワード 비밀번호 암호 otp pin".split())
#: Words that make a "key" secret.
_KEY_WORDS = frozenset("api access private encryption encrypt signing sign secret auth master service account client shared storage session app application deploy webhook license hmac aes rsa ssh admin subscription consumer acceso".split())
#: Last words of names that only speak about secrets.
_ABOUT = frozenset("length len size count limit min max id ids uuid name names url uri path file dir hash digest checksum sum fingerprint label hint prompt message msg text title field input placeholder type kind policy rule regex pattern expiry expires expiration ttl age rotation prefix suffix header index public strength valid validator error enabled required column table format version algorithm provider manager store service timeout bucket".split())
_PLACEHOLDERS = regex.compile(
    r"(?i).*(?:\$\{|\{\{|%\(|<[\w \-]+>|\$\(|#\{|\}\}|os\.environ|getenv|process\.env|env\[|change[-_]?me|change[-_]?it|replace[-_]?(?:me|this)|your[-_ ]|[-_ ]here$|insert[-_]|to-?be-?(?:set|filled)|placeholder|redacted|masked|\bdummy|^sample(?:$|[-_ ]?(?:key|token|pass|secret|value))|^example|example$|^test$|^none$|^null$|^nil$|^undefined$|^todo|^tbd|^n/?a$|^default$|vault:|^ref:|^ssm:|^arn:|secretsmanager|^\$\w+$|^%\w+%$|^@\w+@$|^<).*", regex.DOTALL)
#: Token formats of public issuers: how they begin, and the least number of characters that follow, of which set.
_UPPER, _WORD, _DASH = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "w", "w-"
_FORMATS = (
    ("AKIA", _UPPER, 16), ("ASIA", _UPPER, 16), ("ghp_", _WORD, 20), ("gho_", _WORD, 20), ("ghu_", _WORD, 20), ("ghs_", _WORD, 20), ("ghr_", _WORD, 20), ("github_pat_", _WORD, 20), ("glpat-", _DASH, 16),
    ("xoxa-", _DASH, 10), ("xoxb-", _DASH, 10), ("xoxp-", _DASH, 10), ("xoxr-", _DASH, 10), ("xoxs-", _DASH, 10), ("sk_live_", _WORD, 10), ("sk_test_", _WORD, 10), ("rk_live_", _WORD, 10), ("sk-", _DASH, 20),
    ("AIza", _DASH, 30), ("ya29.", _DASH, 20), ("npm_", _WORD, 30), ("pypi-", _DASH, 30), ("dop_v1_", _WORD, 30))
_NAMES = ("pass", "pwd", "pw ", "pw:", "pw=", "secret", "credential", "creds", "key", "token", "clave", "contrase", "senha", "parola", "kennwort", "geheim", "wachtwoord", "auth", "login", "access", "пароль", "密码", "密碼", "口令", "パスワード", "비밀번호", "암호", "jwt")

# ---- grammars ---------------------------------------------------------------------------------
_LITERAL = r"""(?:[rRbBuUfFL@$]{0,2})(?P<q>\"{3}|'{3}|\"|'|`)(?P<v>(?:(?!(?P=q))(?:[^\\\n]|\\.))*+)(?P=q)"""
# name, then what may stand between a name and its value in code, then a literal
ASSIGNED = regex.compile(
    r"""(?<![\p{L}\p{N}_$])(?P<name>[\p{L}_$][\p{L}\p{N}_$.-]{0,200}+)[\"'`]?\s*[\])]?\s*(?::\s*[\p{L}][\w<>\[\]?&:. ]{0,40}?\s*)?(?::=|=>|<-|\?\?=|\|\|=|=|:|,)\s*(?:new\s+\w+\s*\(|[\w.]+\()?\s*""" + _LITERAL, regex.VERBOSE)
MORE = regex.compile(r"""[\s)]*?(?:\+|\.\.|\.|\\|&|<>|\|\|)?\s*""" + _LITERAL, regex.VERBOSE)
JOIN = regex.compile(r"""\s*(?:\+|\.\.|\.(?!\w)|&|\\\n)\s*(?=[\"'`])|\s*\n\s*(?=[\"'`][^\"'`\n]*[\"'`]\s*[);,]*\s*$)""", regex.MULTILINE)
FROM_ENV = regex.compile(r"""(?:getenv|environ\.get|env|getProperty|get_env|fetch)\s*\(\s*[\"'`](?P<name>\w+)[\"'`]\s*,\s*""" + _LITERAL)
# a token of an unknown issuer: short lower-case prefixes, then a run of mixed letters and digits
OPAQUE = regex.compile(r"(?<![\w.-])[a-z][a-z0-9]{1,9}(?:[_-][a-z]{2,8}){0,2}[_.-](?P<v>[A-Za-z0-9]{16,}+)(?![\w.(/-])")
# prose: name or phrase, connector, bare value
SAID = regex.compile(
    r"""(?i)(?<![\p{L}\p{N}])(?P<name>(?:[\p{L}][\p{L}\p{N}_-]{0,200}+[ ]){0,5}?[\p{L}][\p{L}\p{N}_-]{0,200}+)[\"'`]?\s*(?::=|:|=>|->|=|\bwas\b|\bis\b|\bto\b|\bare\b|\bist\b|\best\b|\bes\b)\s*(?:[\w.-]+\s+/\s+|[\w.-]+/(?=\S{8,}))?[\"'`]?(?P<v>[^\s\"'`,;<>()]{6,}[^\s\"'`,;<>().])""")
ARMOR_END = regex.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_SPLIT = regex.compile(r"[\p{Lu}]+(?![\p{Ll}])|[\p{Lu}]?[\p{Ll}]+|[\p{Lo}\p{Lm}]+|\p{N}+")
_COMMENT = regex.compile(r"(?:^|\s)(?://|#(?!\[)|/\*|\*|--\s|;;)|^\s*[@:]|>>>|\$ ")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All anchors in one automaton; the payload says what can begin there."""
    a = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for word in _NAMES:
        kinds.setdefault(word, set()).add("name")
    for word in (*(f[0].lower() for f in _FORMATS), "sg.", "eyj", "://", "basic", "bearer", "token ", "-u ", "--user", "-", "-----begin"):
        kinds.setdefault(word, set()).add("regular")
    for word in ("env", "getproperty"):
        kinds.setdefault(word, set()).add("env")
    for word, has in kinds.items():
        a.add_word(word, (len(word), tuple(sorted(has))))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    """The regular grammars, each from its anchor on."""
    word = chars(lambda c: c.isalnum() or c == "_", "word")
    sets = {_UPPER: any_of(_UPPER), _WORD: word, _DASH: chars(lambda c: c.isalnum() or c in "_-", "dash")}
    dash, space, quote = sets[_DASH], chars(str.isspace, "space"), times(any_of("\"'"), 0, 1)
    formats = [seq(exact(begin), times(sets[kind], least)) for begin, kind, least in _FORMATS]
    formats += [seq(exact("SG."), times(dash, 16), exact("."), times(dash, 16)), seq(exact("eyJ"), times(dash, 8), exact(".eyJ"), times(dash, 8), exact("."), times(dash, 8))]
    upper = any_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "armor")
    inside = none_of("/@\"'`<>")
    return Grammar({
        "format": either(*formats),
        "armor": seq(exact("-----BEGIN "), times(seq(times(upper, 1), exact(" ")), 0), exact("PRIVATE KEY"), times(exact(" BLOCK"), 0, 1), exact("-----")),
        "connect": seq(exact("://"), times(none_of("/:@\"'`<>"), 0), exact(":"), times(inside, 1), times(seq(exact("/"), times(inside, 1)), 0), exact("@"), chars(lambda c: c.isalnum() or c in "_[{$<", "host")),
        "scheme": seq(either(word_of("basic"), word_of("bearer"), word_of("token")), times(space, 1), times(chars(lambda c: c.isalnum() or c in "_.~+/=:#%!@$&^-", "value"), 8)),
        "user": seq(either(exact("-u"), exact("--user")), any_of(" ="), quote, times(none_of(":\"'"), 1), exact(":"), times(none_of("\"'`"), 1)),
        "flag": seq(times(exact("-"), 1, 2), chars(lambda c: c.isascii() and c.isalpha(), "letter"), times(dash, 0, 80), either(exact("="), times(space, 1)), quote, times(none_of("\"'`"), 1)),
    })


def is_secret_name(name: str) -> bool:
    """Whether a name denotes a secret, not something about one (``password_min_length``) or a public key."""
    words = [w.lower() for w in _SPLIT.findall(name)]
    if not words or words[-1] in _ABOUT or "public" in words or "pub" in words:
        return False
    joined = "".join(words)
    if any(w in _SECRET_WORDS for w in words) or joined in _SECRET_WORDS:
        return True
    return ("key" in words or "keys" in words) and any(w in _KEY_WORDS for w in words) or joined.endswith(("apikey", "accesskey", "secretkey", "privatekey", "authtoken", "passwort", "password", "motdepasse"))


def credible(value: str, strict: bool = False) -> bool:
    """Whether a string can be a secret written out: no placeholder, no message, no plain word.

    strict, for values in prose: besides a digit or irregular case there must be a second class of
    characters, and no form of a path, call or version.
    """
    if len(value) < SHORTEST or regex.search(r"\s", value) or len(set(value)) < 5 or _PLACEHOLDERS.match(value):
        return False
    digit = any(c.isdigit() for c in value)
    turns = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
    humps = regex.fullmatch(r"[a-z]*(?:[A-Z][a-z]+)*|[A-Z_]+", value) is not None
    if not digit and (humps or turns < 3) and not regex.search(r"[^\w.:/-]", value):
        return False
    if regex.fullmatch(r"[\d.,:/-]+", value) and not regex.fullmatch(r"\d{6,}", value):
        return False
    if strict:
        if regex.match(r"(?:https?|ftp|file|s3|git)://|[./~]|\w+\(|v?\d+(?:\.\d+)+$|\d{4}-\d\d-\d\d", value) or "/" in value and regex.fullmatch(r"[a-z0-9_./-]+\.[a-z]{1,5}|(?:[a-z0-9_-]+/)+[a-z0-9_-]*", value):
            return False
        if regex.fullmatch(r"\$?[\p{L}_]\w*(?:(?:\.|->|::)\w+)+", value) and "format" not in grammar().read(value, 0) and not any(len(w) > 24 or regex.search(r"\d\p{L}+\d", w) for w in value.split(".")) or value[0] == "$":
            return False
        if regex.fullmatch(r"(?:[a-z]+_)+[a-z0-9]+|[a-z]+(?:[A-Z][a-z]+)*\d{0,3}|[a-z]+\.[a-z.]+", value):
            return False
        if not (digit or turns >= 3 or regex.search(r"[!#%+$&^*]", value)) or len(value) < 8:
            return False
    return True


def _basic(value: str) -> bool:
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    user, colon, word = plain.partition(":")
    return bool(colon and len(word) >= 3 and not _PLACEHOLDERS.match(word))


def _pieces(text: str, m: regex.Match) -> tuple[str, list[tuple[int, int]]]:
    """The literal of a match with the literals joined to it: value and the span of each piece."""
    value, spans, end = m["v"], [m.span("v")], m.end()
    while (j := JOIN.match(text, end)) and (more := _PIECE.match(text, j.end())):
        value, end = value + more["v"], more.end()
        spans.append(more.span("v"))
    return value, spans


_PIECE = regex.compile(_LITERAL)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """Spans (group, begin, end, kind) of all values; pieces of one value share the group: its first begin."""
    spans: dict[tuple[int, int], tuple[int, str]] = {}

    def keep(kind: str, pieces: list[tuple[int, int]]) -> None:
        for piece in pieces:
            spans.setdefault(piece, (pieces[0][0], kind))

    done: set[tuple[int, str]] = set()
    lower = text.lower()
    if len(lower) != len(text):  # a few letters change length in lower case
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for begin in range(0, max(1, len(text) - OVERLAP), CHUNK - OVERLAP):
        for end, (width, kinds) in automaton().iter(lower, begin, min(len(text), begin + CHUNK)):
            at = end - width + 1
            for kind in kinds:
                # what is regular begins at its anchor; the rest is looked for once in the line of the anchor, however long that is
                where = at if kind == "regular" else text.rfind("\n", 0, at) + 1
                if (where, kind) in done:
                    continue
                done.add((where, kind))
                if kind == "regular":
                    _regular(text, at, keep)
                else:
                    stop = text.find("\n", at)
                    (_names if kind == "name" else _envs)(text, where, len(text) if stop < 0 else stop, keep)
    for m in OPAQUE.finditer(text):
        if opaque(m["v"]):
            keep("opaque", [m.span()])
    # what lies inside a longer span of another grammar is the same value
    out, reach = [], -1
    for (b, e), (group, kind) in sorted(spans.items(), key=lambda s: (s[0][0], -s[0][1])):
        if e <= reach:
            continue
        if b < reach:
            b = reach
        out.append((min(group, b), b, e, kind))
        reach = e
    return out


def opaque(value: str) -> bool:
    """Whether a run of letters and digits can only be a token: both cases and digits, mixed throughout, no words in it."""
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 for c in value]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return kinds.count(0) >= 2 and kinds.count(1) >= 3 and kinds.count(2) >= 3 and turns * 5 >= len(value) * 2


def _names(text: str, left: int, right: int, keep) -> None:
    line = text[left:right]
    # a value may stand on the line below its name
    if any(q in line for q in "\"'`") or line.rstrip()[-1:] in ("=", ":", "(", ",", ">", "-"):
        for m in ASSIGNED.finditer(text, left):
            if m.start() >= right:
                break
            if not is_secret_name(m["name"].rpartition(".")[2]) or m.end() > right and "\n" in m["v"]:
                continue
            value, pieces = _pieces(text, m)
            if regex.match(r"(?i)(?:bearer|basic)\s", value):
                continue
            if credible(value):
                keep("assigned", pieces)
    if _COMMENT.search(line) or not any(q in line.replace('"""', "").replace("'''", "") for q in "\"'`"):
        for m in SAID.finditer(text, left, right):
            phrase = m["name"]
            if (any(is_secret_name(w) for w in phrase.split()) or regex.search(r"(?i)\b(?:pass|pw|login|access|api[ -]?key|x-api-key)\b", phrase)) and credible(m["v"], strict=True):
                keep("said", [m.span("v")])


def _regular(text: str, at: int, keep) -> None:
    """Run the automaton from an anchor and judge the values of what it accepts."""
    before = text[at - 1:at]
    word = before.isalnum() or before == "_"
    free = not word and before != "-"
    if not free and text[at] != ":" and (word or text[at].lower() not in "bt") and not text.startswith("-----BEGIN", at):
        return  # within a word nothing begins
    for kind, end in grammar().read(text, at).items():
        if kind == "armor":
            _armor(text, at, end, keep)
        elif kind == "connect":
            begin, end = text.index(":", at + 3) + 1, end - 2
            value = text[begin:end]
            name = regex.search(r"(?i)(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,40}$", text[max(0, at - 42):at])
            if name and len(value) >= 3 and not _PLACEHOLDERS.match(value) and value.lower() not in ("password", "pass", "pwd", "secret", "token", "port") and len(set(value)) > 2:
                keep("connection", [(begin, end)])
        elif kind == "format" and free:
            if credible(text[at:end]):
                keep("format", [(at, end)])
        elif kind == "scheme" and not word:
            how = text[at:end].split(None, 1)[0].lower()
            begin = end - len(text[at + len(how):end].lstrip())
            value = text[begin:end]
            if how == "basic" and _basic(value) or how == "bearer" and credible(value, strict=True) or how == "token" and "format" in grammar().read(value, 0):
                keep(how, [(begin, end)])
        elif kind == "user" and free:
            begin = text.index(":", at) + 1
            if credible(text[begin:end]):
                keep("login", [(begin, end)])
        elif kind == "flag" and free:
            m = _FLAG_NAME.match(text, at)
            if is_secret_name(m["name"]) and credible(text[m.end():end]):
                keep("flag", [(m.end(), end)])


_FLAG_NAME = regex.compile(r"--?(?P<name>[A-Za-z][\w-]*)(?:=|\s+)[\"']?")


def _envs(text: str, left: int, right: int, keep) -> None:
    for m in FROM_ENV.finditer(text, left, right):
        if is_secret_name(m["name"]):
            value, pieces = _pieces(text, m)
            if credible(value):
                keep("default", pieces)


def _armor(text: str, at: int, head: int, keep) -> None:
    """A private key from its BEGIN line to its END line, or as far as it looks like one."""
    end, following = ARMOR_END.search(text, head), _ARMOR.search(text, head)
    if end is None or following is not None and following.start() < end.start():
        stop = following.start() if following else len(text)
        keep("private key", [(at, _KEY_BODY.match(text, head, stop).end())])
    else:
        keep("private key", [(at, end.end())])


_ARMOR = regex.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = regex.compile(r"(?:[\sA-Za-z0-9+/=:,\"'*#/-]|\\n)*")


def mask(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with the values masked: same length, same lines, armor and quotes kept."""
    out = text
    for _, begin, end, kind in sorted(spans, key=lambda s: -s[1]):
        value = out[begin:end]
        if kind == "private key":
            head, tail = _ARMOR.match(value), ARMOR_END.search(value)
            a, b = (head.end() if head else 0), (tail.start() if tail else len(value))
            masked = value[:a] + regex.sub(r"[A-Za-z0-9+/=]{16,}|(?<=\n)[A-Za-z0-9+/=]+(?=\n)", lambda m: MASK * len(m.group()), value[a:b]) + value[b:]
        else:
            masked = MASK * len(value)
        out = out[:begin] + masked + out[end:]
    return out


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for id_, code, docstring in batch.itertuples(index=False):
            for field, text in (("code", code), ("docstring", docstring)):
                if text:
                    rows += [(id_, field, text.count("\n", 0, begin) + 1, kind) for group, begin, _, kind in find(text) if group == begin]
        yield pd.DataFrame(rows, columns=["id", "field", "line_no", "kind"])


def _masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for id_, code, docstring in batch.itertuples(index=False):
            for field, text in (("code", code), ("docstring", docstring)):
                if text and (spans := find(text)):
                    rows.append((id_, field, mask(text, spans), sum(g == b for g, b, _, _ in spans)))
        yield pd.DataFrame(rows, columns=["id", "field", "masked", "credentials"])


def _texts(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", "code", "docstring").filter(F.col("id").isNotNull() & (F.col("code").isNotNull() | F.col("docstring").isNotNull()))


def credential_lines(symbols: DataFrame) -> DataFrame:
    """(id, field, line_no, kind): the line on which each credential in ``code`` or ``docstring`` begins.

    Versions and duplicates of a symbol carry the same texts and count once. Null and empty texts
    hold nothing; rows of null id are left out. Texts are scanned where they are read; only
    findings move.
    """
    return spread(_texts(symbols)).mapInPandas(_found, FOUND_SCHEMA).distinct()


def masked_texts(symbols: DataFrame) -> DataFrame:
    """(id, field, masked, credentials): each text with credentials, once, with only their values masked."""
    return spread(_texts(symbols)).mapInPandas(_masked, MASKED_SCHEMA).dropDuplicates(["id", "field"])
