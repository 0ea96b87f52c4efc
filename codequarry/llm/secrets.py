"""Problem 6: credentials embedded in source code."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser as sre
from re import _constants as C

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import newest, struct_of

MASK = "REDACTED"

# --- which literals are secrets -------------------------------------------------------------

#: Stand-ins that grant no access.
_PLACEHOLDER = re.compile(
    r"(?i)\A(?:change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|this|with).*|set[-_ ]?me|to[-_ ]?do.*|tbd|fix[-_ ]?me|none|null|nil|undefined|true|false|dummy.*|example.*|sample.*|placeholder.*|redacted"
    r"|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|insert[-_ ].*|(.)\1*|x{3,}.*|\*+|\.{3,}|<.*>|\[.*\]|\(.*\)|-+|_+|0+|1234\d*)\Z"
)
_REFERENCE = re.compile(r"(?i)\$\{|\{\{|\$\(|<%|%\(|\A[$%@&]\w|\bvault:|\benv[.:\[]|environ|getenv|secretsmanager|ssm:|arn:|\Aref\+|\Afile:")
_NO_SECRET = re.compile(r"(?i)\A(?:sha\d*[-:]|md5[-:]|data:|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z|https?://[^@]*\Z|ssh-(?:rsa|ed25519))")
_DULL_NAME = re.compile(r"(?i)(?:public|kind|type|name|field|url|uri|path|header|count|size|length|hash|digest|checksum|file|label|prefix|expir\w*|ttl|limit|index|total|id)\Z|public|checksum")
_ID_NAME = re.compile(r"(?i)access_?key_?id\Z")
_NAME_TAIL = re.compile(r"[\w.$-]*\Z")
_PASSWORD_NAME = re.compile(r"(?i:passw(?:or)?d|passphrase|pwd)\Z|(?:\A|[_.-])(?i:pass)\Z|[a-z]Pass\Z")
#: A longer value is embedded data unless the name itself ends in the word for a credential (``tokenData`` doesn't).
EMBEDDED = 400
_CREDENTIAL_END = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|access|credentials?|key_?material|jwt)_?\Z")
#: Base64 of pictures, archives, documents, markup and fonts, and framed keys and certificates, which have a rule of their own.
_FILE = re.compile(r"\A(?:iVBORw0KGgo|R0lGOD|/9j/|JVBERi0|UEsDB|H4sI|PHN2Zy|PD94bW|PCFET0|d09G|AAEAAAA|-----BEGIN )")
#: What a user reads beside a password field, and pieces of code.
_PROSE = re.compile(r"(?i)\b(?:pass(?:word|phrase|code)?|passwort|contraseña|passe|enter|type|choose|please|required?|must|should|cannot|invalid|wrong|forgot\w*|confirm\w*|repeat|the|is|are|not|your|characters?)\b|[.:?!…,;]\s*\Z|[{}()\[\]<>]|//|/\*|\A#")

_SHORT = frozenset("http https html xhtml xml css sql ssl tls ssh jwt grpc ftp sftp tcp dns cdn npm pdf png csv tsv ctrl ctx cfg mgr msg btn str ptr src dst tmp fmt cmd pkg svc rpc mqtt nth".split())


def _opaque(value: str) -> bool:
    """Whether a value without digits is no plain words: three case switches (which may share a letter) and a piece
    of one case pattern without a vowel, or a long run of consonants."""
    if len(value) >= 12 and len(set(value.lower())) >= 6 and re.search(r"[bcdfghjklmnpqrstvwxz]{7}|[BCDFGHJKLMNPQRSTVWXZ]{8}", value):
        return True
    if re.fullmatch(r"[A-Z]?[a-z]{3,}(?:[-_./]?[A-Z][a-z]{2,})*", value):
        return False
    pieces = {x.lower() for x in re.findall(r"[A-Z]?[a-z]+", value)} - _SHORT
    return len(re.findall(r"(?=[a-z][A-Z]|[A-Z][a-z])", value)) >= 3 and any(len(x) >= 3 and not re.search(r"[aeiouy]", x) for x in pieces)


def is_secret(value: str, least: int = 6, password: bool = False) -> bool:
    """Whether a literal, found where a secret belongs, is one: no placeholder, reference, hash, id or
    embedded file, and not made of plain words only.  Where the place is one of a ``password``, digits
    alone, pass phrases and words joined by special characters are secrets too."""
    if len(value) < least or _PLACEHOLDER.match(value) or _REFERENCE.search(value) or _NO_SECRET.match(value) or _FILE.match(value):
        return False
    if re.search(r"\s", value.strip()):
        words = value.split()
        return password and not _PROSE.search(value) and (len(words) >= 3 or any(re.search(r"\d", w) and re.search(r"[^\W\d_]", w) for w in words))
    if any(c.isdigit() for c in value):
        return password or any(c.isalpha() for c in value)
    if password and len(value) >= 8 and re.search(r"[a-z]", value) and re.search(r"[A-Z]", value) and re.search(r"\w[!@#$%^&*+=~?|]+\w", value) and not re.fullmatch(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", value):
        return True
    switches = len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", value))
    words = re.fullmatch(r"[A-Z]?[a-z]{3,}(?:[-_./]?[A-Z][a-z]{2,})*", value) or re.fullmatch(r"(?:[A-Z][a-z]*-)+[A-Z][a-z]*", value)
    return (switches >= 3 and not words) or _opaque(value)


# --- detection rules ------------------------------------------------------------------------

_KEYWORD = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access|auth|credential|signing_?key|key_?material|private_?key|encryption_?key)"
_Q = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`$\n]*`"
_JOINED = rf"(?:{_Q})(?:[ \t]*[+.]?\s*\\?\s*(?:{_Q}))*"

#: name -> (pattern, group of the value, whether the value needs the check of is_secret, least length).
RULES: dict[str, tuple[str, str, bool, int]] = {
    "private_key": (r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>(?:\\[nr]|[\s\"'+,`\\]|[A-Z][\w-]+: [^\n]*\n)*[A-Za-z0-9+/]{20}(?:\\[nr]|[\s\"'+,`\\A-Za-z0-9/=])*)(?:-----END [A-Z ]*-----)?", "v", False, 0),
    "assigned": (rf"(?i)(?P<name>{_KEYWORD}\w*)[\"']?\]?[ \t]*(?::[ \t]*[\w<>]+[ \t]*=|:=|=>|[:=])[ \t]*\(?\s*[rbfu]?(?P<v>{_JOINED})", "v", True, 6),
    "environment": (rf"(?im)^[ \t#/;*-]*(?:export[ \t]+|set[ \t]+|env[ \t]+)?(?P<name>[\w.-]*{_KEYWORD}\w*)[ \t]*[=:][ \t]*(?P<v>[^\s\"'`(){{}}\[\];,<>]{{6,}})[ \t]*(?:#.*)?$", "v", True, 6),
    "url": (r"(?i)\b[a-z][a-z0-9+.-]*://[^\s:/@\"'`<>]*:(?P<v>[^\s/\"'`<>]+)@[\w\[.-]", "v", True, 4),
    "connection": (r"(?i)(?<=[;\"' ,])(?:pwd|password)[ ]*=[ ]*(?P<v>[^;\"'\s]+)", "v", True, 5),
    "curl_user": (r"(?i)\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[ =]?[\"']?[\w.@-]+:(?P<v>[^\s\"'@]+)", "v", True, 5),
    "option": (r"(?i)(?<=\s)--?(?:pass(?:word|wd|phrase)?|token|secret|api-?key|auth-token)(?:=|[ ]+)[\"']?(?P<v>[^\s\"'`]+)", "v", True, 5),
    "mysql_option": (r"(?i)\b(?:mysql|mysqldump|mysqladmin)\b[^\n]*?\s-p(?P<v>[^\s\"'-][^\s\"']*)", "v", True, 5),
    "header": (r"(?i)\b(?:x-api-key|x-auth-token|api-key|private-token)[\"']?[ ]*[:,=][ ]*[\"']?(?P<v>[\w./+=-]+)", "v", True, 8),
    "bearer": (r"(?i)\bbearer[ ]+(?P<v>[\w.~+/-]{16,}=*)", "v", True, 16),
    "basic": (r"\b[Bb]asic[ ]+(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![\w])", "v", True, 8),
    "jwt": (r"\b(?P<v>eyJ[\w-]{8,}\.[\w-]{8,}\.[\w.-]{8,})", "v", False, 0),
    "prefixed": (r"(?P<v>\b(?:sk_live_|sk_test_|rk_live_|ghp_|gho_|ghs_|glpat-|github_pat_|xoxb-|xoxp-|tok_|pat_|npm_|pypi-)[A-Za-z0-9_-]{16,})", "v", True, 16),
    "prefixed_dot": (r"[\"'](?P<v>(?:ak\.|sk\.|sk-|tk\.|SG\.)[A-Za-z0-9_.-]{20,})[\"']", "v", True, 20),
    "access_id": (r"(?:\"AQ|'AQ|=AQ| AQ|\"AKIA|'AKIA|=AKIA| AKIA|\"ASIA|'ASIA)(?P<v>(?=[A-Z0-9]*[0-9])[A-Z0-9]{16,18})(?![A-Za-z0-9+/=_])", "v", False, 0),
    "remark": (r"(?m)(?://|#|--|\*|;)[^\n]*?:[ \t]*[\w.@-]+ / (?P<v>[^\s/]+)[ \t]*$", "v", True, 8),
    "call": (r"(?i)(?:vault|sign|client|connect|bind|login|authenticate|unlock|decrypt|credentials)\w*\((?:\s*(?:[\w.]+\s*=\s*)?(?:\"[^\"\n]*\"|'[^'\n]*'|[\w.]+)\s*,)*\s*(?:[\w.]+\s*=\s*)?(?P<v>\"[^\"\n]*\"|'[^'\n]*')\s*\)", "v", True, 10),
}
_COMPILED = {k: re.compile(p) for k, (p, *_r) in RULES.items()}


# --- required trigrams of a rule --------------------------------------------------------------

_MOST = 64


def _literals(parsed) -> tuple[list[frozenset], set[str] | None]:
    """(alternatives of required trigrams, the strings that the pattern stands for if they are few)."""
    needs: list[frozenset] = [frozenset()]
    exact: set[str] | None = {""}

    def trigrams(s: str) -> frozenset:
        return frozenset(s[i : i + 3] for i in range(len(s) - 2))

    def conjoin(more: list[frozenset]) -> None:
        nonlocal needs
        joined = {a | b for a in needs for b in more}
        needs = list(joined) if len(joined) <= _MOST else needs

    def flush() -> None:
        nonlocal exact
        if exact is not None and exact != {""}:
            conjoin([trigrams(s) for s in exact])
        exact = {""}

    for op, arg in parsed:
        if op is C.LITERAL:
            exact = {s + chr(arg).lower() for s in exact}
        elif op is C.SUBPATTERN:
            inner_needs, inner = _literals(arg[3])
            if inner is not None and len(exact) * len(inner) <= _MOST:
                exact = {s + t for s in exact for t in inner}
            else:
                flush()
                conjoin(inner_needs)
        elif op is C.BRANCH:
            parts = [_literals(x) for x in arg[1]]
            if all(e is not None for _, e in parts) and len(exact) * sum(len(e) for _, e in parts) <= _MOST:
                exact = {s + t for s in exact for _, e in parts for t in e}
            else:
                flush()
                conjoin(list({n for needed, e in parts for n in (needed if e is None else [a | trigrams(s) for a in needed for s in e])}))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
            _, inner = _literals(arg[2])
            if inner is not None and len(exact) * (len(inner) + 1) <= _MOST:
                exact |= {s + t for s in exact for t in inner}
            else:
                flush()
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            flush()
            inner_needs, inner = _literals(arg[2])
            conjoin(inner_needs if inner is None else [n | trigrams(s) for n in inner_needs for s in inner])
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            flush()
    had_break = any(op not in (C.LITERAL, C.SUBPATTERN, C.BRANCH, C.AT, C.ASSERT, C.ASSERT_NOT) and not (op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1) for op, arg in parsed)
    if had_break or needs != [frozenset()]:
        flush()
        return needs, None
    return needs, exact


def required_trigrams(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams, of which a text needs one whole set to match.
    An empty set among them means that the pattern can't be looked up and every text is a candidate."""
    needs, exact = _literals(sre.parse(pattern))
    if exact is not None:
        needs = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact]
    least = [n for n in needs if not any(o < n for o in needs)]
    return sorted(set(least), key=sorted)


class TrigramIndex:
    """Posting lists of a block of texts, of the trigrams that some rule requires."""

    needs = {k: required_trigrams(p) for k, (p, *_r) in RULES.items()}
    grams = sorted({g for alternatives in needs.values() for n in alternatives for g in n if g.isascii()})
    place = {g: i for i, g in enumerate(grams)}
    _table: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        """Place + 1 of a trigram by its 24-bit code."""
        if cls._table is None:
            cls._table = np.zeros(1 << 24, dtype=np.uint16)
            for g, i in cls.place.items():
                a, b, c = g.encode()
                cls._table[a << 16 | b << 8 | c] = i + 1
        return cls._table

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        joined = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=self.n))
        table, parts, step = self.table(), [], 1 << 20
        for at in range(0, max(0, len(joined) - 2), step):
            b = joined[at : at + step + 2].astype(np.uint32)
            codes = table[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            hits = np.flatnonzero(codes)
            parts.append(np.searchsorted(ends, hits + at, side="right") * (len(self.grams) + 1) + codes[hits])
        pairs = np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.int64)
        doc, gram = np.divmod(pairs, len(self.grams) + 1)
        order = np.argsort(gram, kind="stable")
        self.docs, self.starts = doc[order], np.searchsorted(gram[order], np.arange(1, len(self.grams) + 2))

    def postings(self, gram: str) -> np.ndarray:
        i = self.place[gram]
        return self.docs[self.starts[i] : self.starts[i + 1]]

    def candidates(self, rule: str) -> np.ndarray:
        found = []
        for need in self.needs[rule]:
            lists = sorted((self.postings(g) for g in need if g in self.place), key=len)
            if not lists:
                return np.arange(self.n)
            docs = lists[0]
            for other in lists[1:]:
                docs = np.intersect1d(docs, other, assume_unique=True)
            found.append(docs)
        return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


def _value(raw: str) -> str:
    """The characters between the quotes of one or several joined literals."""
    return "".join(x[1:-1] for x in re.findall(_Q, raw)) if raw[:1] in "\"'`" else raw


def verify(rule: str, text: str) -> list[tuple[int, int]]:
    """Spans (start, end) of secret values that the rule finds in the text."""
    _, group, checked, least = RULES[rule]
    spans = []
    for m in _COMPILED[rule].finditer(text):
        start, end = m.span(group)
        if rule == "private_key":
            start, end = m.start(), m.end()
        elif rule == "access_id":
            start = m.start() + 1
        elif checked:
            raw = m[group]
            value = _value(raw)
            name = m.groupdict().get("name") or ""
            if rule == "assigned":
                name = _NAME_TAIL.search(text[max(0, m.start() - 80) : m.end("name")])[0]
            if name and _DULL_NAME.search(name) and not _ID_NAME.search(name):
                continue
            password = bool(_PASSWORD_NAME.search(name)) or rule in ("url", "connection", "curl_user") or (rule == "option" and m[0].lower().lstrip("-").startswith("pass")) or (rule == "mysql_option" and text[start - 1] == "p")
            if not is_secret(value, least, password):
                continue
            if name and len(value) > EMBEDDED and not _CREDENTIAL_END.search(name):
                continue
            if rule == "environment" and re.fullmatch(r"\d[\d._-]*", value) and not (password and name.isupper() and value.isdigit()):
                continue
            if rule == "environment" and (not re.search(r"\d", value) and not (name.isupper() and _opaque(value)) or re.fullmatch(r"[a-z_]+\d{0,2}|[\w.]+\(.*", value) or re.search(r"[a-z_]\.[a-z_]", value)):
                continue
            if rule == "call" and not (re.search(r"\d", value) and re.fullmatch(r"[^\s/:]{10,}", value)):
                continue
            if rule == "basic" and not re.search(r"[A-Z]", value):
                continue
        spans.append((start, end))
    return spans


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping finds of several rules are one secret."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the values masked; quotes, joining operators, line breaks and key frames stay."""
    out, at = [], 0
    for s, e in spans:
        part = text[s:e]
        if part.startswith("-----BEGIN"):
            head, tail = re.match(r"-----BEGIN [^\n]*?-----", part)[0], re.search(r"-----END [A-Z ]*-----\Z", part)
            body = part[len(head) : tail.start() if tail else len(part)]
            masked = head + re.sub(r"[A-Za-z0-9+/=]{4,}", MASK, re.sub(r"\\n", "\n", body)).replace("\n", "\\n" if "\\n" in body else "\n") + (tail[0] if tail else "")
        elif part[:1] in "\"'`":
            masked = re.sub(_Q, lambda m: m[0][0] + MASK + m[0][0], part)
        else:
            masked = MASK
        out += [text[at:s], masked]
        at = e
    return "".join(out) + text[at:]


def find_in_block(texts: list[str]) -> dict[int, list[tuple[int, int]]]:
    """Spans by place of the text, for the texts of a block that hold secrets."""
    index = TrigramIndex([t.encode("utf-8", "surrogatepass") for t in texts])
    found: dict[int, list[tuple[int, int]]] = {}
    for rule in RULES:
        for i in index.candidates(rule).tolist():
            if spans := verify(rule, texts[i]):
                found.setdefault(i, []).extend(spans)
    return {i: merge(s) for i, s in found.items()}


@F.pandas_udf(struct_of(lines="array<int>", redacted="string"))
def _scan(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for series, wanted in parts:
        texts = [t if t is not None else "" for t in series]
        found = find_in_block(texts)
        lines = [[] for _ in texts]
        for i, spans in found.items():
            lines[i] = sorted({texts[i].count("\n", 0, s) + 1 for s, _ in spans})
        full = [None if t is None or not w else redact(t, found[i]) if i in found else t for i, (t, w) in enumerate(zip(series, wanted))]
        yield pd.DataFrame({"lines": lines, "redacted": pd.array(full, dtype="string")})


def find_secrets(records: DataFrame, keys: list[str], text: str, version: str | None = None, with_text: bool = True) -> DataFrame:
    """Keys, ``lines`` (1-based lines on which a secret starts, ascending) and ``redacted`` for every record.

    A text is looked up through posting lists of trigrams that are built for each block of rows; only
    the candidates of a rule are matched by its expression.  With ``version`` the newest row of each
    key counts.  Scanning comes before that choice, so that no text is shuffled unless the redacted
    text is asked for (``with_text=False`` leaves it null).  A null text has no lines and stays null,
    an empty one stays empty, repeated rows give one row, other columns are ignored.
    """
    kept = [F.col(f"`{k}`").alias(k) for k in keys]
    at = F.col(f"`{version}`").alias("_version") if version else F.lit(None).cast("string").alias("_version")
    rows = records.select(*kept, at, _scan(F.col(f"`{text}`"), F.lit(with_text)).alias("_found"))
    rows = rows.select(*keys, "_version", F.col("_found.lines").alias("lines"), F.col("_found.redacted").alias("redacted"))
    return newest(rows, keys, "_version").drop("_version")
