"""Finding and hiding credentials, with a trigram index in front of the detection patterns.

From every pattern the literal parts that any match must contain are derived, as trigrams joined by and/or.
A block of texts gets an inverted index over just those trigrams: one pass over the bytes through a table of
all 2**24 trigrams, giving for each trigram the texts that hold it. Intersecting and uniting postings leaves
for each pattern its candidate texts, and the pattern runs on those only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.session import spread

try:  # the syntax trees of patterns, by the name they have in this or in older versions of Python
    from re import _constants as C
    from re import _parser
except ImportError:
    import sre_constants as C
    import sre_parse as _parser

HIDDEN = "REDACTED"

# ---------------------------------------------------------------- required trigrams


def required(pattern: str, flags: int = 0):
    """What a match's lower-cased text must contain: None (nothing), a trigram, ("and", ...) or ("or", ...)."""
    return _sequence(_parser.parse(pattern, flags))


def _join(kind: str, parts: list):
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _literal(run: str) -> list:
    data = run.lower().encode()
    return [data[i : i + 3] for i in range(len(data) - 2)]


def _sequence(items):
    need, run = [], ""
    for op, arg in items:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        if op is C.IN and len({chr(v).lower() for o, v in arg if o is C.LITERAL}) == 1 and all(o is C.LITERAL for o, _ in arg):
            run += chr(arg[0][1])
            continue
        need += _literal(run)
        run = ""
        if op is C.BRANCH:
            need.append(_join("or", [_sequence(b) for b in arg[1]]))
        elif op is C.SUBPATTERN:
            need.append(_sequence(arg[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            need.append(_sequence(arg[2]))
        elif op is C.ATOMIC_GROUP:
            need.append(_sequence(arg))
    return _join("and", need + _literal(run))


class TrigramIndex:
    """Postings of the trigrams that some patterns require, over a block of texts."""

    def __init__(self, needs: list):
        self.needs = needs
        self.grams: dict[bytes, int] = {}
        for n in needs:
            self._collect(n)
        self.table = np.full(1 << 24, -1, np.int16)
        for g, i in self.grams.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i

    def _collect(self, need) -> None:
        if isinstance(need, bytes):
            self.grams.setdefault(need, len(self.grams))
        elif need is not None:
            for n in need[1:]:
                self._collect(n)

    def postings(self, text: str) -> np.ndarray:
        """[trigram, line] BOOLEAN for the lines of a text."""
        b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        out = np.zeros((len(self.grams), text.count("\n") + 1), bool)
        if len(b) >= 3:
            code = b[:-2].astype(np.int32) << 16 | b[1:-1].astype(np.int32) << 8 | b[2:]
            gram = self.table[code]
            at = np.flatnonzero(gram >= 0)
            out[gram[at], np.searchsorted(np.flatnonzero(b == 10), at)] = True
        return out

    def candidates(self, text: str) -> list[np.ndarray]:
        """For each pattern the numbers of the lines that can hold a match."""
        posts = self.postings(text)
        every = np.ones(posts.shape[1], bool)

        def evaluate(need) -> np.ndarray:
            if need is None:
                return every
            if isinstance(need, bytes):
                return posts[self.grams[need]]
            parts = [evaluate(n) for n in need[1:]]
            return np.logical_and.reduce(parts) if need[0] == "and" else np.logical_or.reduce(parts)

        return [np.flatnonzero(evaluate(n)) for n in self.needs]


# ---------------------------------------------------------------- patterns

#: Words that make a name one of a secret, in several languages.
_SECRET = (
    r"(?:pass(?:word|wd|wort|phrase|code)|pwd|kennwort|geheimnis|contrase(?:n|ñ)a|clave_?secreta|mot_?de_?passe|motdepasse|senha|wachtwoord"
    r"|secret|token|api_?key|apikey|access_?key|auth_?key|private_?key|secret_?key|signing_?key|encryption_?key|hmac_?key|master_?key|account_?key|shared_?key|session_?key|service_?account_?key"
    r"|app_?key|client_?key|deploy_?key|license_?key|storage_?key|webhook_?key|crypt_?key|jwt_?key|auth_?token|credential|smtp_?pass|db_?pass|ftp_?pass|user_?pass|ldap_?pass|mysql_?pass|root_?pass|admin_?pass|_pass\b)"
)
_NAME = _SECRET + r"\w{0,24}"
#: Types and signs between a name and its value.
_GIVEN = r"[\"'\]]?\s{0,4}(?::\s{0,2}(?:&\s?(?:'static\s)?str|String|string|str|char\s?\*|\[\]byte)\s{0,2}(?==))?(?::=|=>|=|:|\s\[\]\s?=|\[\]\s?=)\s{0,4}(?:b|r|u|f|@|\[\]byte\()?"
_QUOTED = r"(?P<q>[\"'`])(?P<v>[^\"'`\n\r]{6,}+)(?P=q)"
_BARE = r"(?P<v>[^\s\"'`,;{}()<>\[\]]{6,}+)(?=\s|,|;|$|\"|'|\}|\))"

#: Values have no upper length: what follows a cut would stay in clear text. They are possessive, as no shorter
#: value can match where the longest does not.
PATTERNS: dict[str, str] = {
    "private_key": r"(?P<v>-----BEGIN (?:[A-Z0-9]{2,10} ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:\\[rn]|[\s\"'+#/*;.&|\\]|(?:Proc-Type|DEK-Info|Version|Comment|Charset):[^\n]{0,80})*[A-Za-z0-9+/=]{16}(?:[A-Za-z0-9+/=\s\"'+#*,;:.&|()\\-](?!-----BEGIN))*?-----END (?:[A-Z0-9]{2,10} ){0,3}PRIVATE KEY(?: BLOCK)?-----|-----BEGIN (?:[A-Z0-9]{2,10} ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:\\[rn]|[\s\"'+#/*;.&|\\]|(?:Proc-Type|DEK-Info|Version|Comment|Charset):[^\n]{0,80})*[A-Za-z0-9+/=]{16,})",
    "forge_token": r"(?<![A-Za-z0-9_])(?P<v>(?:ghp_|gho_|ghs_|ghu_|ghr_)[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|glptt-[0-9a-f]{40})",
    "service_token": r"(?<![A-Za-z0-9_])(?P<v>(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}|(?:sk|rk)_test_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9+/=]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|xapp-[A-Za-z0-9-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_\-]{30,}|dop_v1_[0-9a-f]{40,}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{24,}|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|AIza[A-Za-z0-9_\-]{35}|ya29\.[A-Za-z0-9_\-]{20,}|sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{24,}|dckr_pat_[A-Za-z0-9_\-]{20,}|hvs\.[A-Za-z0-9_\-]{20,}|lin_api_[A-Za-z0-9]{20,}|ntn_[A-Za-z0-9]{30,}|AGE-SECRET-KEY-1[A-Z0-9]{40,})",
    "cloud_key": r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])",
    "signed_token": r"(?<![A-Za-z0-9_])(?P<v>eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{16,})",
    "url_login": r"[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s/:@\"'`<>|]{0,80}:(?P<v>[^\s/@\"'`]{3,}+)@[A-Za-z0-9\[]",
    "header": r"(?i)\b(?:authorization|proxy-authorization|x-api-key|x-auth|x-auth-token|x-access-token|private-token|api-key|apikey|job-token|deploy-token|x-[a-z-]{1,20}(?:token|key|secret))[\"']?\s{0,3}[\])]?\s{0,2}(?:[:=,]|=>)\s{0,3}[\"'`]?\s{0,2}(?:(?:bearer|basic|token|digest|apikey)\s{1,2})?(?P<v>[A-Za-z0-9+/=_.~\-]{12,}+)",
    "bearer": r"(?i)\bbearer\s{1,2}(?P<v>[A-Za-z0-9+/=_.~\-]{16,}+)",
    "basic": r"(?i)[\"'\s:]basic\s{1,2}(?P<v>[A-Za-z0-9+/]{12,}+={0,2})(?=[\"'`\s,;)]|$)",
    "quoted": r"(?i)" + _NAME + _GIVEN + _QUOTED,
    "defined": r"(?i)#\s{0,3}define\s{1,4}\w{0,40}?" + _NAME + r"\s{1,4}" + _QUOTED,
    "bare": r"(?im)" + _NAME + r"[\"']?\s{0,4}(?:=|:)\s{0,4}" + _BARE,
    "connection": r"(?i)(?<![A-Za-z])(?:password|passwd|pwd|accountkey|sharedaccesskey|sharedsecret|secret|passphrase)\s{0,2}=\s{0,2}(?P<v>[^\s;\"'`&]{5,}+)(?=[;\"'`&\s]|$)",
    "query": r"(?i)[?&;](?:[a-z_\-]{0,24}(?:token=|api_?key=|apikey=|key=|secret=|password=|passwd=|signature=|sig=|auth=))(?P<v>[A-Za-z0-9+/=_.~%\-]{12,}+)",
    "netrc": r"(?i)\blogin\s{1,4}\S{1,80}\s{1,4}pass(?:word|wd)\s{1,4}(?P<v>[^\s\"'`]{5,}+)",
    "flag": r"(?i)(?<!\S)--?(?:[a-z\-]{0,24}(?:password|passwd|pwd|token|api-?key|access-?key|secret-?key|secret|auth-?key|passphrase))(?:=|\s{1,3})[\"']?(?P<v>[^\s\"'`,;)]{6,}+)",
    "short_flag": r" -p(?:=|\s{1,2})?[\"']?(?P<v>[A-Za-z0-9][^\s\"'`,;)]{7,}+)",
    "user_flag": r"(?<!\S)(?:curl\b[^\n]{0,200}?\s-u|--user)(?:=|\s{1,3})[\"']?[^\s:\"'`$]{1,80}:(?P<v>[^\s\"'`@/]{5,}+)",
    "login_call": r"(?i)\b(?:\w*login|\w*auth|authenticate|sign_?in|log_?in|connect|basic_?auth|with_?credentials|set_?credentials|credentials)\s{0,2}\((?:\s{0,2}[\"'][^\"'\n]{0,120}[\"']\s{0,2},){1,3}\s{0,2}(?P<q>[\"'])(?P<v>[^\"'\n]{5,}+)(?P=q)\s{0,2}\)",
    "told": r"(?i)\b(?:passwords?|passwort|kennwort|passphrase|passcode|token|secret|api key|access key|key|contraseña|clave|mot de passe|zugangsdaten|pin)\s(?:is|was|are|ist|war|lautet|es|era|est|était|now|:|=|->|to|of|for \S{1,40} is|für \S{1,40} ist)\s{0,2}:?\s{0,2}[\"'`(]?(?P<v>[^\s\"'`<>(){}]{6,}+)",
    "with_password": r"(?i)\b(?:with|using|mit|con|avec|and|und|use|the|dem|la|le|das|el)\s(?:the\s|dem\s|la\s|le\s|el\s|das\s)?(?:password|passwort|kennwort|passphrase|contraseña|clave|mot de passe|token|api key|secret|key)\s:?[\"'`(]?(?P<v>[^\s\"'`<>(){}]{6,}+)",
    "login_pair": r"(?i)\b(?:login|log in|logins|account|credentials?|creds|user|access|anmeldung|zugang|acceso|accès|sign in|use th(?:is|ese))\b[^\n:]{0,40}:\s{1,3}[\"'`]?[\w.@\-]{2,60}\s{0,2}(?:/|\||:|,)\s{1,2}[\"'`]?(?P<v>[^\s\"'`<>]{6,}+)",
    "user_slash": r"\w: {1,3}[\"'`]?[\w.@\-]{2,60} / [\"'`]?(?P<v>[^\s\"'`<>]{8,}+)",
}


_HOLDER = re.compile(
    r"(?i)^(?:your|my|the|some|any|enter|insert|paste|put|add|set|change|replace|fill)(?:[-_ .]|[a-z]{0,30}$)|change[-_]?me|place[-_]?holder|^(?:xxx|\*\*\*|\.\.\.|___|---|###|000000)|^(.)\1{4,}$|^(?:todo|tbd|fixme|none|null|nil|true|false|undefined|redacted|hidden|removed|example|sample|dummy|fake|test|secret|password|token|n/?a|unset|empty|default|required|optional|string|str|bytes|bool|int|object)$"
    r"|^(?:test|example|dummy|fake|sample|redacted)[-_ ]?(?:key|token|password|secret|value|pass)|[-_](?:here|goes[-_]here|placeholder)$|^<.*>?$|^\[.*\]$|^\{\{|^\$[\d({]|^%[({]|^%\w+%$|^#\{|^@\{|^\*+$|^x{4,}|\$\{|\{\{|<[a-z_ -]+>|^1234|^abcdef|^abc123$|^s3cr3t$|^hunter2$|^\.{3}|…"
)
_REFERENCE = re.compile(
    r"(?i)^(?:os\.|env\.|process\.|config[.\[]|settings[.\[]|self\.|this\.|ctx\.|vault[:./]|secrets?[./:]|ssm:|arn:|projects/|op://|ref\+|file://|https?://|\w+\.(?:environ|getenv|env|get|read|fetch|load)\b|get_?env|getenv|\w+\(|\\\$)"
)
#: Signs that references and pointers begin with; random values do as well.
_SIGNS = "@!*&$%/"
_WORDLIKE = re.compile(r"^[a-z]+(?:[-_./: ][a-z]+)*$|^[A-Z]+(?:[-_./: ][A-Z]+)*$|^[A-Z]?[a-z]+(?:[A-Z][a-z]+)*(?:\.[a-z][A-Za-z]*+)*$")
_NUMBER = re.compile(r"^[-+]?[\d.,_:]+(?:ms|s|m|h|d|kb|mb|k)?$|^0x[0-9a-f]{1,8}$", re.I)
#: Endings of names that speak about a secret without holding it.
_ABOUT = re.compile(
    r"(?i)(?:[_-]?(?:label|hint|name|names|backend|file|files|path|paths|env|envvar|var|url|uri|endpoint|count|counts|limit|limits|ttl|length|len|size|policy|field|fields|id|ids|type|types|header|prefix|suffix|expiry|expires?|timeout|ref|refs|reference|store|manager|provider|rotation|title|text|message|msg|placeholder|prompt|help|description|param|parameter|column|regex|pattern|format|algorithm|alg|version|kind|scope|source|location|template|index|budget|usage|mount|engine|hash|digest|checksum|sha256|fingerprint|arn|tooltip|dialog))$"
)
_PUBLIC = re.compile(r"(?i)public|checksum|digest|sha\d|integrity|fingerprint|commit|request|trace|correlation|max_tokens|tokens$|tokenizer|csrf_header|token_count|keyboard|monkey|keyword")


def _entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values())


def _kinds(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _restless(v: str) -> bool:
    """Whether kinds of characters change as often as in random values, what joins words aside; names of code and
    paths keep to a kind longer."""
    kinds = [_kinds(c) for c in v if c not in "/-_."]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) >= 0.35 * len(kinds) > 0


def _gibberish(v: str) -> bool:
    """Whether a value without digits is random: restless, and its humps are no words."""
    words = sum(len(w) for w in re.findall(r"[A-Z]?[a-z]{2,}", v) if re.search(r"[aeiouyAEIOUY]", w))
    return len(v) >= 10 and _restless(v) and words < 0.7 * len(v)


def is_literal(value: str, kind: str, before: str) -> bool:
    """Whether a matched value is a credential itself, not a placeholder, a reference or a name."""
    v = value.strip().rstrip(".,;:!?)") if kind in ("told", "with_password", "login_pair", "user_slash", "bare") else value.strip()
    if kind in ("private_key", "forge_token", "service_token", "signed_token", "cloud_key"):
        return not re.search(r"(?i)example|xxxx|x{8}|0{10}|(.)\1{9}", v)
    if len(v) < 5 or " " in v and kind not in ("quoted", "defined") or _HOLDER.search(v) or _REFERENCE.search(v) or _NUMBER.match(v):
        return False
    if v[0] in _SIGNS and not _restless(v):
        return False
    if kind in ("connection", "netrc") and v.isalpha() and not _gibberish(v):
        # Words may be passwords where nothing else can stand: between the other parts of a login.
        return kind == "netrc" or before.rstrip().lower().endswith((";pwd=", ";password=", "; pwd=", "; password="))
    if kind in ("quoted", "bare", "defined"):
        name = re.search(r"[\w.\-]+[\"'\]]?\s{0,4}(?::[^=\n]{0,30})?\s{0,3}(?::=|=>|=|:|\[\]\s?=)?[\s\w\[\]()@]{0,12}[\"'`]?$", before)
        name = re.match(r"[\w.\-]+", name.group()).group() if name else ""
        if _ABOUT.search(name) or _PUBLIC.search(name):
            return False
        if " " in v:
            return False
    mixed = any(c.isdigit() for c in v) + any(c.isupper() for c in v) + any(c.islower() for c in v) + any(not c.isalnum() for c in v)
    if kind in ("header", "bearer", "basic", "query"):
        return mixed >= 2 and _entropy(v) >= 3.0 and not _WORDLIKE.match(v)
    code = _CODE.search(v) and not (v[0] == "/" and _restless(v))
    if kind in ("told", "with_password", "login_pair", "user_slash", "flag", "short_flag", "user_flag", "bare"):
        random = any(c.isdigit() for c in v) or kind != "bare" and _gibberish(v)
        return random and mixed >= 2 and not code and (kind not in ("bare", "user_slash") or _entropy(v) >= 2.8)
    if _WORDLIKE.match(v) and not _gibberish(v):
        return False
    return mixed >= 2 and not code


_CODE = re.compile(r"\w\(|\)\.|->|::|\w\[|^\w+\.\w+\.|=>|^\.?/[a-z]|^[a-z_.\-]+(?:/[a-z_.\-]+)+$")


@lru_cache(maxsize=1)
def _compiled() -> tuple[list[tuple[str, re.Pattern]], TrigramIndex]:
    patterns = [(k, re.compile(p, re.ASCII)) for k, p in PATTERNS.items()]
    return patterns, TrigramIndex([required(p, re.ASCII) for p in PATTERNS.values()])


#: Every match of a private key starts with this.
_KEY_OPENS = "-----BEGIN "
#: A line that ends like this goes on in the next one.
#: The next literal of a value that is joined from several.
_JOINED = re.compile(r"[\"']\s{0,4}[+.\\]?\s{0,40}[\"'](?P<v>[A-Za-z0-9+/=_\-.!@#$%^&*]{4,}+)(?=[\"'])")
_GOES_ON = re.compile(r"(?:[=(:+\\]|=>)\s*$")


def _keys(pattern: re.Pattern, whole: str, begin: int, end: int, last: int) -> Iterator[re.Match]:
    """The private keys that start between `begin` and `end`; a key may reach to `last`."""
    at = whole.find(_KEY_OPENS, begin, end)
    while at >= 0:
        m = pattern.match(whole, at, last)
        if m:
            yield m
        at = whole.find(_KEY_OPENS, m.end() if m else at + 1, end)


def find_in(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """For each text the credentials as (start, end, kind), in order and without overlaps."""
    patterns, index = _compiled()
    whole = "\n".join(texts)
    ends = [m.start() for m in re.finditer("\n", whole)] + [len(whole)]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])  # where each text begins in `whole`
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (kind, pattern), lines in zip(patterns, index.candidates(whole)):
        for n in lines.tolist():
            begin, end = (ends[n - 1] + 1 if n else 0), ends[n]
            if kind == "private_key":
                i = int(np.searchsorted(first, begin, "right")) - 1
                last = int(first[i + 1]) - 1
                hits = _keys(pattern, whole, begin, end, last)
            else:
                if n + 1 < len(ends) and _GOES_ON.search(whole, max(begin, end - 8), end):
                    end = ends[n + 1]
                hits = pattern.finditer(whole, begin, end)
            for m in hits:
                start, stop = m.span("v")
                if is_literal(whole[start:stop], kind, whole[max(begin, start - 160) : start]):
                    i = int(np.searchsorted(first, start, "right")) - 1
                    if stop <= first[i + 1] - 1:
                        found[i].append((start - int(first[i]), stop - int(first[i]), kind))
                        while more := _JOINED.match(whole, stop, int(first[i + 1]) - 1):
                            start, stop = more.span("v")
                            found[i].append((start - int(first[i]), stop - int(first[i]), "continued"))
    out = []
    for spans in found:
        kept: list[tuple[int, int, str]] = []
        for s in sorted(set(spans), key=lambda x: (x[0], x[2] in ("bare", "told"), -x[1])):
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
        out.append(kept)
    return out


def hide(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each credential replaced; quotes, line ends and everything around stay as they are."""
    parts, at = [], 0
    for start, end, _ in spans:
        value = text[start:end]
        # A value over several lines keeps its line ends, so that no line number changes.
        parts += [text[at:start], HIDDEN, "".join(re.findall(r"\r?\n", value))]
        at = end
    return "".join([*parts, text[at:]])


def _blocks(texts: list, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or i - start >= 2000:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def find_credentials(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys and line_no INT, start INT, length INT, kind: one row for each credential; where a value is
    joined from several literals, each further one is a row of kind "continued".

    line_no counts lines ended by a line feed from 1, start and length count characters. Null and empty
    texts have none. Each row is searched as a whole and on its own: repeated rows repeat their findings. An
    empty table gives an empty result; columns that are not keys are ignored.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("line_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("kind", T.StringType())])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n).to_pylist()
            for a, b in _blocks(texts):
                rows, line, start, length, kind = [], [], [], [], []
                part = [t or "" for t in texts[a:b]]
                for i, spans in enumerate(find_in(part)):
                    for s, e, k in spans:
                        rows.append(a + i)
                        line.append(part[i].count("\n", 0, s) + 1)
                        start.append(s)
                        length.append(e - s)
                        kind.append(k)
                cols = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(n)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(line, pa.int32()), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(kind, pa.string())], names=schema.names)

    return spread(df.select(*keys, F.col(text).alias("__text"))).mapInArrow(run, schema)


def redact(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys, the text with every credential hidden and all else unchanged, and `hidden` INT, their number.

    A null text stays null with 0 hidden. Line ends within a value stay, so line numbers hold.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(text, T.StringType()), T.StructField("hidden", T.IntegerType())])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n).to_pylist()
            for a, b in _blocks(texts):
                spans = find_in([t or "" for t in texts[a:b]])
                out = [None if t is None else hide(t, s) if s else t for t, s in zip(texts[a:b], spans)]
                cols = [batch.column(c).slice(a, b - a) for c in range(n)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array([len(s) for s in spans], pa.int32())], names=schema.names)

    return spread(df.select(*keys, F.col(text).alias("__text"))).mapInArrow(run, schema)
