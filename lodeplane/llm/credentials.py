"""Credentials embedded in source code and configuration: find each place and redact it without hurting the rest.

Configuration formats (env, ini, properties, TOML, HCL, YAML, JSON, XML, Dockerfile, netrc, pgpass, npmrc) are parsed into
entries of key path, value and offsets; source code, prose and scripts give entries from assignments, arguments, headers and comments. An entry is a
credential if its key path says so and its value has the shape of a secret rather than of a placeholder, a reference or
a harmless look-alike. Values that show what they are (token prefixes, signed tokens, private keys, passwords within
URLs and connection strings) count under any key. Redactions are spliced into the original text at the values' offsets;
quotes, separators and line ends around them stay.

Lines without any word or shape that could matter are passed over first, by plain substring search; formats are parsed
only in files that have other lines left.

Offsets are those of bytes of the UTF-8 text wherever rows leave this module, and redactions are spliced into these bytes.
No value, line or key block is too long to be read.

Defined results: null and empty contents hold nothing; a null path holds nothing; places are counted once per line. A
private key without a footer ends with the last line that belongs to its body.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "[REDACTED]"

#: What a line must hold, in lower case, for any rule to apply to it (``key`` needs a word before it, see ``_hinted``).
_HINTS = ("pass", "pwd", "pw", "secret", "token", "auth", "bearer", "jwt", "cred", "psk", "pswd", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "glpat-", "k_live_", "k_test_", "eyj", "xox", "hooks.", "sig=", "signature=", "code=", "basic ", "identified by", "aiza", "npm_", "hf_", "sg.", "shpat_", "shpss_", "dop_v1", "ya29", "pat")

_B = r"(?<![A-Za-z0-9])"
#: Values that show what they are (fixed, public token formats).
_TOKENS = re.compile(
    "|".join(
        (
            _B + r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
            _B + r"gh[pousr]_[A-Za-z0-9]{36,}",
            _B + r"github_pat_[A-Za-z0-9_]{40,}",
            _B + r"glpat-[A-Za-z0-9_-]{20,}",
            _B + r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
            _B + r"xox[abprs]-[A-Za-z0-9-]{10,}",
            _B + r"AIza[A-Za-z0-9_-]{35}",
            _B + r"npm_[A-Za-z0-9]{36}",
            _B + r"hf_[A-Za-z0-9]{30,}",
            _B + r"SG\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{40,}",
            _B + r"(?:shpat|shpss)_[0-9a-fA-F]{32}",
            _B + r"dop_v1_[0-9a-f]{64}",
            _B + r"ya29\.[A-Za-z0-9_-]{20,}",
            _B + r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{16,}",
        )
    )
)
_HOOK = re.compile(r"https?://hooks\.[^\s/\"'`]+/(?:services/)?[A-Za-z0-9]+/[A-Za-z0-9]+/([A-Za-z0-9]{16,})")
_USERINFO = re.compile(r"[a-z][a-z0-9+.-]{1,20}://([^\s/:@\"'`<>]*):([^\s/@\"'`<>]+)@[A-Za-z0-9\[]")
_QUERY = re.compile(r"[?&](?:\w*(?:token|secret|signature|passw(?:or)?d|pwd|apikey|api_key|access_key|auth)|sig|key|code)=([^\s&\"'`<>#;)]+)", re.I)
_PAIR = re.compile(r"(?:^|[;?&,\s\"'`(])(?:pwd|password|account_?key|shared_?access_?key|access_?key|secret|token|passwd)\s*=\s*([^;\s\"'`&,)]+)", re.I)
_IDENTIFIED = re.compile(r"\bidentified\s+by\s+(?:password\s+)?['\"]([^'\"\n]+)['\"]", re.I)
_BASIC = re.compile(r"\bBasic\s+([A-Za-z0-9+/]{8,}={0,2})")
_BEARER = re.compile(r"\bBearer\s+([^\s\"'`,;]+)", re.I)
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: What may stand between the lines of a key (line ends, quotes, comment and joining marks, header fields), and a line.
_BETWEEN = re.compile(r"(?:\\[nr]|[\s\"'`+#*/,;|>\\-]|[A-Za-z-]+: [^\n\\]*(?:\n|\\n))*+")
_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}+")
_LINES = re.compile(r"(\\[nr])|[A-Za-z0-9+/=]{16,}+")
_BODY_REST = re.compile(r"(?:[A-Za-z0-9+/]{1,15}=|=?[A-Za-z0-9+/]{0,15}[0-9+/A-Z][A-Za-z0-9+/]{0,15})=?(?=\\[nr]|[\s\"'`]|$)")
_BODY_LAST = re.compile(r"(?:(?<=\n)|(?<=\\n)|(?<=[\"'`]))[ \t#*/|>]*([A-Za-z0-9+/=]{1,15})(?=(?:\\[nr]|[\s\"'`+#*/,;|>\\])*\Z|(?:\\[nr]|[\s\"'`+#*/,;|>\\])*=[A-Za-z0-9+/]{4}(?:\\[nr]|\s)*\Z)")

#: Words before ``key`` that make it a secret one (fixed values).
_KEYS_OF = set("api access account master signing encryption private stripe shared service secret auth client deploy admin storage license ssh tls root app session crypto hmac webhook aws azure gcp maps billing".split())
_BEFORE_KEY = tuple(sorted(_KEYS_OF))
_PIECES = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_LONG = re.compile(r"passw(?:or)?d|passphrase|secret|token|apikey|credential|bearer|secretkey|accesskey|authkey|privatekey|authorization", re.I)
_SHORT = {"pwd", "pass", "pw", "jwt", "pat", "auth", "psk", "passcode", "pswd"}
_SECRET_PLACE = re.compile(r"(?i)(?:^|/)(?:secrets|credentials)/")
_NOT = {"hint", "pattern", "url", "uri", "endpoint", "pub", "public", "regex", "policy", "length", "len", "min", "max", "ttl", "expiry", "expires", "expiration", "name", "header", "field", "label", "type", "levels", "count", "prompt", "file", "path", "hash", "checksum", "integrity", "commit", "image", "request", "fingerprint", "digest", "help", "placeholder", "format", "rule", "rules", "title", "description", "message", "kind", "class", "provider", "issuer", "audience", "scope", "scopes", "strength", "env", "var", "ref", "method", "mode", "algorithm", "alg", "idx", "index"}


@lru_cache(100_000)
def telling(path: str) -> bool:
    """Whether a key path says that its value is secret: by its last key, or by a place for secrets."""
    return sensitive(path.rsplit("/", 1)[-1]) or bool(_SECRET_PLACE.search(path))


def sensitive(key: str) -> bool:
    """Whether a key name says that its value is secret."""
    words = [w.lower() for w in _PIECES.findall(key)]
    if not words or any(w in _NOT for w in words):
        return False
    if _LONG.search(key):
        return True
    if any(w in _SHORT for w in words):
        return True
    return any(b.startswith("key") and b not in ("keyword", "keyboard") and a in _KEYS_OF for a, b in zip(words, words[1:]))


_PLACEHOLDER = re.compile(
    r"(?i)^(?:change[-_ ]?(?:me|it|this)\w*|replace[-_ ]?(?:me|this|with)\w*|x{3,}|\*+|\.{3,}|•+|-+|_+|0+|<.*>|\[.*\]|\{.*\}|\$.*|%.*%|%\(.*|#\{.*|@.*@|(?:your|my|the|some|insert|enter|put|add)[-_ ].*|none|null|nil|undefined|true|false|yes|no|on|off|empty|default|unset|n/?a|tbd|test|testing|secret|password|passwd|token|pass|user|admin|root|foo|bar|foobar|hunter2|env|vault:.*|secret:.*|secrets?[./].*|ssm:.*|arn:.*|file:.*|process\.env.*|os\.(?:environ|getenv).*|env[.(\[].*|getenv.*|system\.getenv.*|ref\+.*|!\w+ .*)$"
)
#: Words that make a value a stand-in, unless a part of it beside them is as random as a secret.
_STAND_IN = re.compile(r"(?i)placeholder|redacted|masked|example|changeme|dummy|sample|todo|fixme|notasecret|not-a-secret")
_COUNTED = re.compile(r"(?i)0123|1234|2345|abcd|(.)\1{3}")


def _random(part: str) -> bool:
    """Whether a part of a value is a run of mixed letters and digits that nobody would write as a stand-in."""
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(part, part[1:]))
    return len(part) >= 16 and part.isalnum() and changes >= 4 and not _COUNTED.search(part)


def _stands_in(value: str) -> bool:
    if not _STAND_IN.search(value):
        return False
    return not any(_random(x) for x in re.split(r"[-_.:/+=~]", value) if not _STAND_IN.search(x))


_HARMLESS = re.compile(r"(?i)^(?:data:|sha(?:1|224|256|384|512)[-:]|md5[-:]|ssh-(?:rsa|ed25519|dss)|ecdsa-|-----BEGIN (?!.*PRIVATE)|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|\^|https?://|\w+://|\.{1,2}/)")
_PATH = re.compile(r"/?(?:[a-z0-9._-]+/)+[a-z0-9._-]*$|/[a-z._-]+$")
_MASKED = re.compile(r"\*{3,}|x{6,}|X{6,}|•{3,}|<[^>]+>|\$\{|\{\{|%\(|\.\.\.|…")


_REGULAR = re.compile(r"[a-z]+|[A-Z]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]+)*")


#: Keys whose value is a password whatever it looks like, and words that stand in its place in settings.
_PASSWORD = re.compile(r"(?i)(?:^|[._/ -]|(?<=[a-z])(?=P))(?:\w*_)?(?:password|passwd|pwd|passphrase|passcode|pin)$")
_WORDS = set("required optional string enabled disabled keychain prompt interactive external internal managed generated rotate rotated inherit inherited stored unknown plaintext encrypted hashed bcrypt argon2 scrypt pbkdf2 basic digest kerberos forgot reset confirm current invalid incorrect missing provided configured username".split())
_PROSE = set("a an the your you is are be to of for in on at or and not with must should enter type choose please this that it its new old no only by from as has have min max least characters password passphrase".split())


def secret_value(value: str, key: str = "", setting: bool = False) -> bool:
    """Whether a literal value has the shape of a secret; ``setting``: it is the value of a key of a configuration format."""
    if len(value) < 6:
        return False
    word = bool(_PASSWORD.search(key))
    if any(c.isspace() for c in value):
        words = value.split(" ")
        return setting and word and len(words) >= 4 and all(w.isascii() and w.isalpha() and w.islower() and w not in _PROSE for w in words)
    if _PLACEHOLDER.match(value) or _HARMLESS.match(value) or _PATH.match(value) or _MASKED.search(value) or _stands_in(value):
        return False
    plain = re.sub(r"[^a-z0-9]", "", value.lower())
    if not plain or plain == re.sub(r"[^a-z0-9]", "", key.lower()):
        return False
    if any(c in value for c in "()[]{}<>") and not re.search(r"\d", value):
        return False
    digit, lower, upper = (any(f(c) for c in value) for f in (str.isdigit, str.islower, str.isupper))
    if value.isdigit():
        return setting and word and len(value) >= 8 and len(set(value)) > 3
    if digit and (lower or upper) and len(value) >= 8:
        return True
    if digit and len(value) >= 6 and not value.replace(".", "").replace("-", "").isdigit():
        return bool(re.search(r"[^A-Za-z0-9.,_-]", value)) or (lower and upper)
    if len(value) >= 10 and lower and upper and any(not _REGULAR.fullmatch(x) for x in re.split(r"[._-]", value) if x):
        return True
    if setting and word and len(value) >= 10 and value.isascii() and value.isalpha() and value.islower() and value not in _WORDS:
        return not _LONG.search(value)
    return len(value) >= 8 and (lower or upper) and bool(re.search(r"[!#$%&@^~?]", value)) and not re.search(r"[()=;]", value)


# -- entries of key path, start and end of the value ------------------------------------------------------------------
Entry = tuple[str, int, int]
_LITERAL = r"(?:[rRbBfFuU]{0,2})(?:\"(?P<d>(?:[^\"\\\n]|\\.)*)\"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<t>[^`\n]*)`)"
_ASSIGNED = re.compile(r"(?<![\w.-])(?P<key>[A-Za-z_][\w.-]*+)[\"'`]?\]?\)?\s*(?::\s*[A-Za-z_][\w<>\[\]|., ]*?=|:=|=>|\|\||\?\?|[:=,]|\()(?=\s*\(?\s*" + _LITERAL + ")")
_DEFAULT = re.compile(r"\$\{(?P<key>[A-Za-z_][\w.-]*+):-?(?P<v>[^}\n]+)\}")
_COMMENT = re.compile(r"(?:^|(?<=\s))(?:#|//|--|;|\*|<!--)|^\s*The\b")
_LAST = re.compile(r"[`\"']?([^\s`\"']{6,})[`\"']?\s*\Z")
_ELEMENT = re.compile(r"<(?P<key>[A-Za-z][\w.-]*+)>(?P<v>[^<\s]{6,})</(?P=key)>")
#: A line whose value stands on the next one: its statement is read on.
_GOES_ON = re.compile(r"(?:[:=(\[,+\\]|=>)[ \t]*(?:(?:#|//)[^\n]*)?\r?\Z")


def remark(line: str) -> tuple[str, int, int] | None:
    """The last word of a comment under the words before it, which must be few."""
    for m in _COMMENT.finditer(line):
        tail = line.rstrip()
        for close in ("*/", "-->"):
            tail = tail.removesuffix(close).rstrip()
        last = _LAST.search(tail, max(m.end(), tail.rfind(" ") - 1, tail.rfind("\t") - 1))
        if last is None or last.start(1) <= m.end():
            continue
        words = line[m.end() : last.start(1)].split()
        if any(q in w[:-1] for w in words for q in "`\"'"):
            continue
        key = re.sub(r"\b(?:TODO|FIXME|remove|for \w+|is|The|the|in|on|at|of)\b|->|[:=]+$", " ", " ".join(words).strip("`\"'")).strip()
        if key and len(key.split()) <= 4:
            return key.replace(" ", "_"), last.start(1), last.end(1)
    return None


def source_entries(text: str, base: int = 0) -> Iterator[Entry]:
    """Assignments, arguments, map entries, defaults, elements and remarks of source code and prose."""
    for m in _ASSIGNED.finditer(text):
        g = m.lastgroup
        yield m.group("key"), base + m.start(g), base + m.end(g)
    for m in _DEFAULT.finditer(text):
        yield m.group("key"), base + m.start("v"), base + m.end("v")
    for m in _ELEMENT.finditer(text):
        yield m.group("key"), base + m.start("v"), base + m.end("v")
    at = 0
    for line in text.split("\n"):
        found = remark(line)
        if found:
            yield found[0], base + at + found[1], base + at + found[2]
        at += len(line) + 1


_KEY_VALUE = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+)?(?P<key>//[^\s=]*:_\w+|[^\s=:#;\[\"'][^=:\n#]*?)[ \t]*[=:][ \t]*(?:\"(?P<d>[^\"\n]*)\"|'(?P<s>[^'\n]*)'|(?P<r>[^\n\r]*?))[ \t]*(?:[#;][^\n]*)?\r?$", re.M)
_SECTION = re.compile(r"^[ \t]*\[([^\]\n]+)\]", re.M)


def flat_entries(text: str) -> Iterator[Entry]:
    """env, ini, properties, npmrc: lines of key and value under sections."""
    sections = [(m.start(), m.group(1)) for m in _SECTION.finditer(text)]
    at = 0
    for m in _KEY_VALUE.finditer(text):
        while at + 1 < len(sections) and sections[at + 1][0] <= m.start():
            at += 1
        head = sections[at][1] + "/" if sections and sections[at][0] <= m.start() else ""
        g = m.lastgroup
        yield head + m.group("key").strip(), m.start(g), m.end(g)


_YAML = re.compile(r"^(?P<indent>[ ]*)(?P<dash>(?:- +)*)(?:[\"']?(?P<key>[A-Za-z_/][\w./ -]*?)[\"']?[ \t]*:(?=[ \t\r\n]|$))?[ \t]*(?:\"(?P<d>[^\"\n]*)\"|'(?P<s>[^'\n]*)'|(?P<r>(?:[^\n\r#]|(?<=\S)#)*?))[ \t]*(?:(?<!\S)#[^\n]*)?\r?$", re.M)
_INNER = re.compile(r"(?P<key>[A-Za-z_][\w.-]*+)=(?P<v>.+)")
_NAMES, _VALUES = ("name", "key"), ("value", "default")


def yaml_entries(text: str) -> Iterator[Entry]:
    """YAML: key paths by indentation; items of lists carry the key of their list."""
    path: list[tuple[int, str]] = []
    named: dict[int, str] = {}  # depth -> value of the last ``name`` there
    for m in _YAML.finditer(text):
        if m.start() == m.end():
            continue
        depth = len(m.group("indent")) + len(m.group("dash"))
        key = m.group("key")
        if m.group("dash"):
            named.pop(depth, None)
        if key:
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, key))
        g = m.lastgroup
        if g in ("d", "s", "r") and m.end(g) > m.start(g):
            head = "/".join(k for _, k in path)
            yield head, m.start(g), m.end(g)
            if key in _NAMES:
                named[depth] = m.group(g)
            elif key in _VALUES and depth in named:
                yield head + "/" + named[depth], m.start(g), m.end(g)
            elif not key and (inner := _INNER.fullmatch(text, m.start(g), m.end(g))):
                yield head + "/" + inner.group("key"), inner.start("v"), inner.end("v")


_JSON = re.compile(r"\"(?P<s>(?:[^\"\\\n]|\\.)*+)\"|(?P<p>[{}\[\]:,])")


def json_entries(text: str) -> Iterator[Entry]:
    """JSON, valid or not: key paths of string values; items of lists carry the key of their list."""
    frames: list[list] = []  # of each open bracket: its sign, the path before it, the name and the value of an object
    path, key, after = "", "", False
    for m in _JSON.finditer(text):
        p = m.group("p")
        if p is None:
            if after or not frames or frames[-1][0] == "[":
                yield path + key, m.start("s"), m.end("s")
                if frames and frames[-1][0] == "{":
                    if key in _NAMES:
                        frames[-1][2] = m.group("s")
                    elif key in _VALUES:
                        frames[-1][3] = m.span("s")
            else:
                key = m.group("s")
        elif p == ":":
            after = True
        elif p in "{[":
            frames.append([p, path, None, None, key])
            path += key + "/" if p == "{" and key else ""
            key, after = ("", False) if p == "{" else (key, False)
        elif p in "}]":
            if frames:
                sign, before, name, value, own = frames.pop()
                if name and value:
                    yield path + name, *value
                path, key = before, own
            after = False
        else:
            after = False


_TABLE = re.compile(r"^[ \t]*\[\[?[ \t]*([^\]\n]+?)[ \t]*\]\]?", re.M)
_TOML = re.compile(r"(?:^[ \t]*|[{,][ \t]*)(?P<key>(?:[\w-]+|\"[^\"\n]*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[\w-]+|\"[^\"\n]*\"))*+)[ \t]*=[ \t]*(?:\"\"\"(?P<m>(?:[^\"]|\"(?!\"\"))*)\"\"\"|\"(?P<d>(?:[^\"\\\n]|\\.)*+)\"|'(?P<s>[^'\n]*)')", re.M)


def toml_entries(text: str) -> Iterator[Entry]:
    """TOML: strings under dotted keys, tables and inline tables."""
    tables = [(m.start(), m.group(1)) for m in _TABLE.finditer(text)]
    at = -1
    for m in _TOML.finditer(text):
        while at + 1 < len(tables) and tables[at + 1][0] <= m.start():
            at += 1
        g = m.lastgroup
        yield (tables[at][1] + "/" if at >= 0 else "") + re.sub(r"[\"' \t]", "", m.group("key")).replace(".", "/"), m.start(g), m.end(g)


_HCL = re.compile(r"#[^\n]*|//[^\n]*|/\*.*?\*/|(?P<open>[A-Za-z_][\w-]*(?:[ \t]+(?:\"[^\"\n]*\"|[\w-]+))*[ \t]*=?[ \t]*\{)|(?P<key>[A-Za-z_][\w.-]*|\"[^\"\n]*\")[ \t]*[=:][ \t]*\"(?P<v>(?:[^\"\\\n]|\\.)*+)\"|\"(?:[^\"\\\n]|\\.)*+\"|(?P<p>[{}])", re.S)


def hcl_entries(text: str) -> Iterator[Entry]:
    """HCL: attributes under the types and labels of their blocks; a ``default`` or ``value`` belongs to its block's last label."""
    blocks: list[str] = []
    for m in _HCL.finditer(text):
        if m.group("open"):
            blocks.append("/".join(w.strip('"') for w in re.findall(r"\"[^\"]*\"|[\w-]+", m.group("open"))))
        elif m.group("p") == "{":
            blocks.append("")
        elif m.group("p"):
            if blocks:
                blocks.pop()
        elif m.group("key"):
            key = m.group("key").strip('"')
            head = "/".join(b for b in blocks if b)
            yield (head if key in _VALUES and head else head + "/" + key), m.start("v"), m.end("v")


_XML = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</(?P<close>[\w.:-]+)\s*>|<(?P<open>[\w.:-]+)(?P<attrs>(?:\s+[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<single>/?)>|(?P<v>[^<]+)", re.S)
_ATTRIBUTE = re.compile(r"(?P<key>[\w.:-]+)\s*=\s*(?:\"(?P<d>[^\"]*)\"|'(?P<s>[^']*)')")


def xml_entries(text: str) -> Iterator[Entry]:
    """XML: texts under their element, attributes under their name; a ``value`` belongs to its element's ``name`` or ``key``."""
    path: list[str] = []
    for m in _XML.finditer(text):
        if m.group("open"):
            name, value, own = None, None, m.group("open")
            for a in _ATTRIBUTE.finditer(text, m.start("attrs"), m.end("attrs")):
                g = a.lastgroup
                yield "/".join([*path, own, a.group("key")]), a.start(g), a.end(g)
                if a.group("key").lower() in ("name", "key", "id"):
                    name = a.group(g)
                elif a.group("key").lower() in _VALUES:
                    value = a.span(g)
            if name and value:
                yield "/".join([*path, own, name]), *value
            if not m.group("single"):
                path.append(name or own)
        elif m.group("close"):
            if path:
                path.pop()
        elif m.group("v") and path and not m.group("v").isspace():
            v = m.group("v")
            yield "/".join(path), m.start("v") + len(v) - len(v.lstrip()), m.start("v") + len(v.rstrip())


_DOCKER = re.compile(r"^[ \t]*(?:ENV|ARG)[ \t]+(?P<rest>[^\n\r]+)", re.M | re.I)
_DOCKER_PAIR = re.compile(r"(?P<key>[A-Za-z_]\w*)(?:=|[ \t]+(?=\S+$))(?:\"(?P<d>(?:[^\"\\]|\\.)*)\"|'(?P<s>[^']*)'|(?P<r>[^\s\"']+))")


def docker_entries(text: str) -> Iterator[Entry]:
    """Dockerfile: variables of ENV and ARG."""
    for line in _DOCKER.finditer(text):
        for m in _DOCKER_PAIR.finditer(text, line.start("rest"), line.end("rest")):
            g = m.lastgroup
            yield m.group("key"), m.start(g), m.end(g)


_NETRC = re.compile(r"\bpassword[ \t\r\n]+(\S+)")
_PGPASS = re.compile(r"^(?!#)(?:(?:[^:\n\\]|\\.)*:){4}([^\r\n]+)$", re.M)
_FLAT = re.compile(r"(?:^|/)(?:[^/]*\.(?:ini|cfg|conf|properties|npmrc|pypirc|envrc)|\.?env(?:\.[\w.-]+)?|[^/]*\.env(?:\.[\w.-]+)?|\.npmrc|\.s3cfg|\.boto|credentials|config)$", re.I)


_BARE = (".netrc", "_netrc", ".pgpass", "pgpass.conf")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def format_entries(path: str, name: str, text: str) -> Iterator[Entry]:
    """Entries of a configuration format, none for other files."""
    if name.endswith((".yaml", ".yml")):
        yield from yaml_entries(text)
    elif name.endswith((".json", ".jsonc", ".map")):
        yield from json_entries(text)
    elif name.endswith(".toml"):
        yield from toml_entries(text)
    elif name.endswith((".tf", ".tfvars", ".hcl")):
        yield from hcl_entries(text)
    elif name.endswith((".xml", ".config", ".plist", ".csproj", ".props")):
        yield from xml_entries(text)
    elif name.startswith("dockerfile") or name.endswith(".dockerfile"):
        yield from docker_entries(text)
    elif name in (".netrc", "_netrc"):
        yield from (("password", m.start(1), m.end(1)) for m in _NETRC.finditer(text))
    elif name in (".pgpass", "pgpass.conf"):
        yield from (("password", m.start(1), m.end(1)) for m in _PGPASS.finditer(text))
    elif _FLAT.search(path):
        yield from flat_entries(text)


def shaped(text: str) -> Iterator[tuple[int, int]]:
    """Places of values that show what they are."""
    for m in _TOKENS.finditer(text):
        if not re.search(r"(?:EXAMPLE|X{6,}|x{6,}|0{8,})", m.group()):
            yield m.span()
    if "://" in text:
        for m in _HOOK.finditer(text):
            if not _MASKED.search(m.group(1)):
                yield m.start(), m.end()
        for m in _USERINFO.finditer(text):
            v = m.group(2)
            if len(v) >= 5 and not _PLACEHOLDER.match(v) and not _MASKED.search(v):
                yield m.span(2)
        for m in _QUERY.finditer(text):
            if len(m.group(1)) >= 12 and secret_value(m.group(1)):
                yield m.span(1)
    for m in _PAIR.finditer(text):
        begin = max(text.rfind(q, 0, m.start()) for q in "\"'`") + 1  # of the string that holds the pair
        if secret_value(m.group(1)) and text.find(";", begin, m.start() + 1) >= 0:
            yield m.span(1)
    for m in _IDENTIFIED.finditer(text):
        if secret_value(m.group(1)):
            yield m.span(1)
    for m in _BASIC.finditer(text):
        try:
            plain = base64.b64decode(m.group(1) + "=" * (-len(m.group(1)) % 4)).decode("utf-8")
        except ValueError:
            continue
        if ":" in plain and len(plain.split(":", 1)[1]) >= 4:
            yield m.span(1)
    for m in _BEARER.finditer(text):
        if secret_value(m.group(1)):
            yield m.span(1)


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Blocks of private keys that have a body, from the header to the footer, or to the end of the body without one."""
    heads = [m.span() for m in _PRIVATE.finditer(text)]
    for k, (start, end) in enumerate(heads):
        at = _BETWEEN.match(text, end).end()
        if not _BODY.match(text, at):
            continue
        foot = _PRIVATE_END.search(text, end, heads[k + 1][0] if k + 1 < len(heads) else len(text))
        if foot:
            yield start, foot.end()
            continue
        stop = at
        while m := _BODY.match(text, at):
            stop = m.end()
            at = _BETWEEN.match(text, stop).end()
        if rest := _BODY_REST.match(text, at):
            stop = rest.end()
        yield start, stop


def _hinted(text: str) -> list[tuple[int, int]]:
    """Spans of the lines to which some rule may apply."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow in lower case; their places would be off
        low = text.translate(_ASCII_LOWER)
    starts: set[int] = set()
    for hint in _HINTS:
        at = low.find(hint)
        while at >= 0:
            starts.add(text.rfind("\n", 0, at) + 1)
            at = text.find("\n", at)
            if at < 0:
                break
            at = low.find(hint, at)
    at = low.find("key")
    while at >= 0:
        before = low[max(0, at - 12) : at]
        if before[-1:] in ("?", "&") or before.rstrip("_.- ").endswith(_BEFORE_KEY):
            starts.add(text.rfind("\n", 0, at) + 1)
        at = low.find("key", at + 3)
    if "@" in low:
        at = low.find("://")
        while at >= 0:
            starts.add(text.rfind("\n", 0, at) + 1)
            at = low.find("://", at + 3)
    out = []
    done = -1
    for a in sorted(starts):
        if a < done:
            continue
        b = text.find("\n", a)
        b = len(text) if b < 0 else b
        while b < len(text) and _GOES_ON.search(text, max(a, b - 200), b):
            c = text.find("\n", b + 1)
            b = len(text) if c < 0 else c
            if text[a:b].count("\n") > 2:
                break
        out.append((a, b))
        done = b
    return out


def places(path: str, text: str) -> list[tuple[int, int]]:
    """Spans of the credentials of a text, sorted, none within another."""
    name = path.rsplit("/", 1)[-1].lower()
    lines = _hinted(text)
    if not lines and name not in _BARE:
        return []
    spans = list(private_keys(text)) if "PRIVATE KEY" in text else []
    found = [(*e, True) for e in format_entries(path, name, text)]
    for a, b in lines:
        line = text[a:b]
        spans += [(a + x, a + y) for x, y in shaped(line)]
        found += [(*e, False) for e in source_entries(line, a)]
    for key, start, end, setting in found:
        if telling(key) and secret_value(text[start:end], key.rsplit("/", 1)[-1], setting):
            if re.search(r"(?i)[?&;]|://", text[start:end]) and any(start <= a and b <= end for a, b in spans):
                continue  # the credential within it is known more exactly
            spans.append((start, end))
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if out and b <= out[-1][1]:
            continue
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], b)
            continue
        out.append((a, b))
    return out


_PATH_PAIR = re.compile(r"(?:^|[/?&;,_ -])(?P<key>[A-Za-z][\w.-]*?)=(?P<v>[^/?&;]+)")


def path_places(path: str) -> list[tuple[int, int]]:
    """Spans of the credentials of a path: shaped values, and values of sensitive keys in ``key=value`` segments."""
    spans = [s for s in shaped(path)]
    for m in _PATH_PAIR.finditer(path):
        if sensitive(m.group("key")) and secret_value(m.group("v"), m.group("key")):
            spans.append(m.span("v"))
    return sorted(set(spans))


def _masked_key(value: str) -> str:
    """A key block whose lines are masked; header, footer and all between the lines stay."""
    head = _PRIVATE.match(value).end()
    tail = _PRIVATE_END.search(value, head)
    body = value[head : tail.start() if tail else len(value)]
    for _ in range(2):  # the short last line, and a checksum after it
        body = _BODY_LAST.sub(lambda m: m.group()[: m.start(1) - m.start()] + MASK, body)
    return value[:head] + _LINES.sub(lambda m: m.group(1) or MASK, body) + (tail.group() if tail else "")


def byte_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of characters as spans of bytes of the text in UTF-8."""
    if text.isascii():
        return spans
    out, at, size = [], 0, 0
    for a, b in spans:
        size += len(text[at:a].encode("utf-8", "surrogatepass"))
        n = len(text[a:b].encode("utf-8", "surrogatepass"))
        out.append((size, size + n))
        size, at = size + n, b
    return out


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span replaced; key blocks keep their lines, all else around the values stays as it was."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in byte_spans(text, spans):
        value = raw[a:b]
        out.append(raw[at:a])
        out.append(_masked_key(value.decode()).encode() if value.startswith(b"-----BEGIN") else MASK.encode())
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _candidates(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    slim = files.select(F.col(key).alias("key"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("text"))
    return slim.where("text <> '' or path <> ''")


def credential_lines(files: DataFrame, *, key: str = "file_id", path: str = "path", content: str = "content") -> DataFrame:
    """``key, line_no`` of every line on which a credential begins, ``line_no`` 0 for the path; each place once."""
    slim = _candidates(files, key, path, content)
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lines = [], []
            for i, (p, t) in enumerate(zip(batch.column("path").to_pylist(), batch.column("text").to_pylist())):
                found = {t.count("\n", 0, a) + 1 for a, _ in places(p, t)}
                if path_places(p):
                    found.add(0)
                at += [i] * len(found)
                lines += sorted(found)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(lines, pa.int32())], names=["key", "line_no"])

    return slim.mapInArrow(run, f"key {kind}, line_no int").distinct().select(F.col("key").alias(key), "line_no")


def redacted_files(files: DataFrame, *, key: str = "file_id", path: str = "path", content: str = "content") -> DataFrame:
    """``key, path, content, places`` of the files that hold credentials, redacted; one row per row delivered."""
    slim = _candidates(files, key, path, content)
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, texts, counts = [], [], [], []
            for i, (p, t) in enumerate(zip(batch.column("path").to_pylist(), batch.column("text").to_pylist())):
                in_text, in_path = places(p, t), path_places(p)
                if in_text or in_path:
                    at.append(i)
                    paths.append(redacted(p, in_path))
                    texts.append(redacted(t, in_text))
                    counts.append(len(in_text) + len(in_path))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["key", "path", "content", "places"])

    return slim.mapInArrow(run, f"key {kind}, path string, content string, places int").select(F.col("key").alias(key), "path", "content", "places")
