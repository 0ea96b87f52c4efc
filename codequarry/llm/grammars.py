"""Grammar acceptance for six languages at the speed of compiled regular expressions.

Python and JSON use the parsers of the interpreter.  ECMAScript, TypeScript, Java and Go are
accepted in three steps:

1. one compiled scanner turns the text into a string with one character per token kind;
2. innermost bracket groups are replaced, layer by layer, by one character that records which
   syntactic *roles* (argument list, block, class body, ...) the content satisfies.  Without
   nested brackets each role is a regular language, so a role is one regular expression, and
   results are memoised on the token kinds of the content;
3. what is left of the file has to match the role of a whole program.

The cost is one scan of the text plus one dictionary look-up for each bracket group.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections import Counter
from functools import lru_cache
from itertools import islice
from operator import itemgetter

import regex

LANGUAGES = ("python", "javascript", "typescript", "java", "go", "json")

#: File endings of the languages with a grammar.
ENDINGS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "go": "go", "json": "json",
}

MEMO_LIMIT = 200_000
WORD_LIMIT = 50_000


class LexError(ValueError):
    """A character sequence that is no token of the language."""


class Roles:
    """Private characters that stand for a reduced bracket group and the roles its content has."""

    def __init__(self, base: int, names: str):
        self.base, self.names = base, names.split()

    def char(self, has: int) -> str:
        return chr(self.base + has)

    def __getitem__(self, name: str) -> str:
        bit = 1 << self.names.index(name)
        # numbers that have the bit come in runs of its size
        return "[" + "".join(f"{self.char(m)}-{self.char(m + bit - 1)}" for m in range(bit, 1 << len(self.names), 2 * bit)) + "]"


class Series(str):
    """A pattern of items with separators that knows its item; ``last`` tells whether a separator may end it."""

    def __new__(cls, pattern: str, item: str, sep: str, last: bool):
        self = super().__new__(cls, pattern)
        self.item, self.sep, self.last = item, sep, last
        return self


def seq(item: str, sep: str = ",") -> Series:
    """Zero or more items with separators, one trailing separator allowed."""
    return Series(f"(?:{item}(?:{sep}{item})*+{sep}?)?", item, sep, True)


def seq1(item: str, sep: str = ",") -> Series:
    return Series(f"(?:{item}(?:{sep}{item})*+)", item, sep, False)


class Kinds(dict):
    """The characters of tokens by their text; a text that is not known yet is looked at by ``kind``."""

    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def __missing__(self, token: str | None) -> str:
        char = self.kind(token)
        if len(token) < 40 and len(self) < WORD_LIMIT:
            self[token] = char
        return char


class Rules(dict):
    """Named sub-patterns; a pattern refers to them by name, so that nothing is expanded twice."""

    def __setitem__(self, name: str, pattern: str) -> None:
        super().__setitem__(name, f"(?&{name})")
        self.bodies = getattr(self, "bodies", {}) | {name: pattern}
        self.parts = [*getattr(self, "parts", []), f"(?P<{name}>{pattern})"]

    def mentioned(self, pattern: str) -> set[str]:
        """The characters that the pattern, or one it refers to, has, and at least those: a text with another one can't
        match (no pattern here takes a character by exclusion, or just any)."""
        todo, seen, chars = [pattern], set(), set()
        while todo:
            text = todo.pop()
            names = set(re.findall(r"\(\?&(\w+)\)", text)) - seen
            seen |= names
            todo += [self.bodies[n] for n in names]
            plain = re.sub(r"\(\?&\w+\)", "", text)
            chars |= set(plain)
            for first, last in re.findall(r"(?=(.)-(.))", plain):
                chars |= {chr(c) for c in range(ord(first), ord(last) + 1)}
        return chars

    def compile(self, pattern: str):
        return regex.compile(f"(?:{pattern})\\Z(?(DEFINE){''.join(self.parts)})").match


_ALIKE = re.compile("(?<![^,])((?:\\+?[1\"k]|[\ue000-\uefff]),)\\1+")


_LAST: dict[str, list] = {}

#: How many tokens are looked at, one after the other, before all of them.
FIRST = (8, 64)


class BracketGrammar:
    """Scanner, newline rule and role expressions of one language."""

    def __init__(self, scanner, kinds, keywords, newlines, roles, named, rules, program, angle=None, never=None, blank=r"[ \t]"):
        self.never = re.compile(never).search if never else lambda s: None
        # a token takes the white space before it along; what is no token ends the scan, outside of the group
        self.scan = re.compile(rf"{blank}*+(?:({re.sub('[(][?]P<[a-z]+>', '(?:', scanner)})|.+)", re.S).finditer
        self.sort = re.compile(scanner, re.S).fullmatch
        self.chars = Kinds(self.kind)
        self.last = _LAST.setdefault(scanner, [None])  # grammars with the same scanner read a text once
        self.kinds, self.keywords, self.newlines = kinds, keywords, newlines
        self.roles = roles
        made = {k: {n: self.listed(named.compile(p)) if n in ("block", "plain", "class") else self.series(named, p) for n, p in rs.items()} for k, rs in rules.items()}
        if "plain" in made["{"]:
            made["{"]["plain"] = self.outside(made["{"]["block"], made["{"]["plain"])
        bit = lambda k, n: 1 << roles[k].names.index(n)
        kinds_of_all = {*keywords.values(), ";"}

        def foreign(pattern: str):
            others = kinds_of_all - named.mentioned(pattern)
            return re.compile(f"[{re.escape(''.join(sorted(others)))}]").search if others else lambda s: None

        #: (bit of the role, match of the content, bits that the content must have already, search for what it can't have)
        self.rules = {
            k: [(bit(k, n), m, {"plain": bit(k, "block"), "turn": bit(k, "switch")}.get(n, 0) if k == "{" and "plain" in ms else 0, foreign(rules[k][n])) for n, m in ms.items()] for k, ms in made.items()
        }
        self.program = self.listed(named.compile(program))
        self.angle = re.compile(angle) if angle else None
        self.group = re.compile(r"\(([^][(){}]*)\)|\[([^][(){}]*)\]|\{([^][(){}]*)\}")
        self.memo: dict = {}
        self.words: dict = {}

    def listed(self, match):
        """Match for a list of statements or members: such lists are closed under concatenation, so
        every part up to a terminator is matched, and remembered, by itself; where a terminator
        belongs to the inside of a statement, the whole decides."""
        known: dict = {}
        head = self.roles["("].char(0) + "-" + self.roles["("].char((1 << len(self.roles["("].names)) - 1)
        split = re.compile(rf"(?:[^;\n]|(?<=[jwl][{head}])\n(?!\n))*[;\n]+|[^;\n]+").findall  # a line end behind if (..) is inside

        def alone(body: str) -> bool:
            for part in split(body):
                good = known.get(part)
                if good is None:
                    good = bool(match(part))
                    if len(known) < MEMO_LIMIT:
                        known[part] = good
                if not good:
                    return False
            return True

        def parts(body: str) -> bool:
            return alone(body) or (known.get(body) is None and bool(match(body)))  # what is one part was decided as such

        parts.alone = alone
        return parts

    def series(self, named, pattern):
        """Match for a pattern; one of a series matches, and remembers, every item by itself, and where one
        doesn't match (an item may have separators in it), the whole decides."""
        whole = named.compile(pattern)
        if not isinstance(pattern, Series):
            return whole
        item, sep, last = named.compile(pattern.item), pattern.sep, pattern.last
        known: dict = {}

        def run(body: str) -> bool:
            items = body.split(sep)
            if last and not items[-1]:
                items.pop()
            for part in {*items} if len(items) > 9 else items:
                good = known.get(part)
                if good is None:
                    good = bool(item(part))
                    if len(known) < WORD_LIMIT:
                        known[part] = good
                if not good:
                    return bool(whole(body))
            return True

        return run

    def outside(self, block, plain):
        """Whether a block is one outside of functions: without return, in it and in the blocks of its statements."""
        b = self.roles["{"]
        bits = {n: 1 << b.names.index(n) for n in ("block", "plain")}
        inner = re.compile("[" + "".join(b.char(m) for m in range(1 << len(b.names)) if m & bits["block"] and not m & bits["plain"]) + "]").search

        def run(body: str) -> bool:
            if "R" in body:
                return False
            return not inner(body) or plain.alone(body) or (not block.alone(body) and plain(body))

        return run

    def lex(self, text: str, most: int | None = None) -> str:
        """One character for each token (of the first ``most``)."""
        last = self.last
        if last[0] != text:
            last[:] = [text, [], map(itemgetter(1), self.scan(text))]
        tokens = last[1]  # those read so far; the scan goes on where it stopped
        if most is None:
            tokens += last[2]
        elif len(tokens) < most:
            tokens += islice(last[2], most - len(tokens))
        if most is not None:
            return "".join(map(self.chars.__getitem__, tokens[:most]))
        out = "".join(map(self.chars.__getitem__, tokens))
        if "`" in out:
            for t in tokens:
                if t[0] == "`":
                    self.template(t)
        return out

    def kind(self, token: str | None) -> str:
        """The character of a token."""
        if token is None:
            raise LexError(token)
        if token[0] == '"' or token[0] == "'":
            return self.kinds["str"]
        if token[:2] == "//" or token[:2] == "/*":
            return "\n" if "\n" in token else ""
        m = self.sort(token)
        # by themselves, only regular expressions and points before brackets aren't known as the tokens they are
        kind = m.lastgroup if m else "regex" if token[0] == "/" else "skip"
        if kind == "name" or kind == "word":
            return self.keywords.get(token, "i")
        if kind == "mark":
            return token
        if kind == "punct":
            return self.kinds.get(token) or token
        if kind == "tmpl":
            return "`"
        return "" if kind == "space" else self.kinds[kind]

    def template(self, text: str) -> None:
        """The parts of a template literal in ${ } have to be expressions."""
        for m in re.finditer(r"(?<!\\)\$\{((?:[^{}`]|\{[^{}]*\})*)\}", text):
            if not self.words.get(m[1]):
                outer = self.last.copy()
                try:
                    inner = self.lex(m[1])
                finally:
                    self.last[:] = outer
                inner = self.reduce(self.newlines(f"({inner})"))
                if len(inner) != 1 or not re.match(self.roles["("]["expr"], inner):
                    raise LexError(m[1])
                if len(self.words) < MEMO_LIMIT:
                    self.words[m[1]] = True

    def angles(self, s: str) -> str:
        if self.angle:
            n = 1
            while n and "<" in s:
                s, n = self.angle.subn("‹", s)
        return s

    def one(self, m: re.Match) -> str:
        whole = m[0]
        char = self.memo.get(whole)
        if char is None:
            kind, body, has = whole[0], self.angles(whole[1:-1]), 0
            if len(body) > 100:  # equal elements of a long list, each a literal or a bracket group, count once
                body = _ALIKE.sub(r"\1", body)
            for bit, match, after, foreign in self.rules[kind]:
                if has & after == after and not foreign(body) and match(body):
                    has |= bit
            char = self.roles[kind].char(has) if has else "\0"
            if len(self.memo) < MEMO_LIMIT:
                self.memo[whole] = char
        return char

    def reduce(self, s: str) -> str:
        n = 1
        while n:
            s, n = self.group.subn(self.one, s)
            if "\0" in s:
                return s
        return self.angles(s)

    def accepts(self, text: str) -> bool:
        text = text.removeprefix("﻿")
        try:
            # most texts of another language show it by their first tokens
            if any(self.never(self.lex(text, most)) for most in FIRST) or self.never(s := self.lex(text)):
                return False
            s = self.reduce(self.newlines(s))
        except (LexError, RecursionError):
            return False
        return "\0" not in s and bool(self.program(s))


def _words(spec: str) -> dict[str, str]:
    return {w: line.split()[0] for line in spec.strip().splitlines() for w in line.split()[1:]}


#: Tried first, as most tokens are one of these: marks that begin no other token, and names that begin with an ASCII letter.
_MARK = r"(?P<mark>[,;(){}\[\]]+|=(?![=>]))|"
_NOTE = r"(?P<note>//[^\n]*|/\*.*?\*/)"
_SPACE = r"(?P<space>[ \t\r\f\v ﻿  ]+)"


def _ecma(ts: bool) -> BracketGrammar:
    P, S, B = Roles(0xE000, "args expr params for type"), Roles(0xE100, "array index empty type"), Roles(0xE200, "block object class switch names shape enum plain turn")
    named = Rules()
    scanner = (
        r"(?P<name>[A-Za-z_$][\w$]*)|" + _MARK + r"(?P<nl>\n[\s]*)|(?P<member>(?:\?\.|(?<!\.)\.(?!\.))\s*#?[A-Za-z_$ª-퟿][\w$]*)|" + _SPACE + "|" + _NOTE + r"|(?P<bang>\A#![^\n]*)"
        r"|(?P<word>#?[A-Za-z_$ª-퟿\U00010000-\U0001ffff][\w$]*)"
        r"|(?P<num>(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$]))"
        r"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
        r"|(?P<tmpl>`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`)"
        r"|(?P<regex>(?:(?<=[(,=:\[!&|?{;+*%~^<>-])|(?<=[(,=:\[!&|?{;+*>] )|(?<=return )|(?<=\n))/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"
        r"|(?P<deco>@[A-Za-z_$][\w$]*(?:\.[\w$]+)*)"
        r"|(?P<skip>\?\.(?=\s*[(\[`]))"
        r"|(?P<punct>=>|\.\.\.|\?\?=|&&=|\|\|=|\*\*=|\*\*|===|!==|==|!=|<=|>=|<<=|<<|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=?:,;(){}\[\]])"
    )
    kinds = {"num": "1", "str": '"', "regex": "/", "deco": "@", "nl": "\n", "member": ".", "skip": "", "bang": "", "-": "+", "~": "!", "&": "|", "++": "%", "--": "%", "=>": "→", "...": "&", "/": "^", "%": "^"}
    kinds |= {k: "^" for k in "?? ** === !== == != <= >= << && ||".split()} | {"^": "^"} | {k: "≔" for k in "??= &&= ||= **= <<= -= += *= /= %= &= |= ^=".split()}
    keywords = _words("""
k this super null true false
v var let
ç const
f function
c class
x extends
R return
q throw
j if
w while with
l for
e else
d do
b break continue debugger
y try
h catch
z finally
W switch
C case
D default
V new
u delete typeof void await
Y yield
# in instanceof
m import
E export
a async
o of
g get set
S static
F from
A as satisfies
""")  # fmt: skip
    if ts:
        keywords |= _words("""
T type declare namespace module
M abstract readonly public private protected override accessor
K keyof infer is unique asserts
X interface
U enum
P implements
""")  # fmt: skip

    def newlines(s: str) -> str:
        s = re.sub(r"(?<=[Rb])\n+", ";", s)
        s = re.sub(r"(?<=\))\n+(?=\{)|(?<=ci)\n+(?=\{)", "", s)
        return re.sub(r"\n+(?=[.,;:?)\]}=≔^*|#<>→&(`+ehz\n])|(?<=[({\[,;:?=≔^*|#<>→!+&@xVuecCWjwldqmAyzhvçf\n])\n+", "", s).strip("\n")

    W, I = "[A-Za-z#]", "[iaogSFATMKXUP]" if ts else "[iaogSFA]"
    gen = "‹?" if ts else ""
    named["prim_type"] = rf"(?:(?:[KuMaV]|‹)*(?:(?:{W}(?:\.)*|m{P['args']}\.*)‹?|[k\"1`]|\+1|[vç]|{P['type']}(?:→)?|{S['type']}|{B['shape']})(?:\n?(?:{S['empty']}|{S['index']}))*+→?)"
    prim_type = named["prim_type"]
    named["TYPE"] = rf"(?:\|?{prim_type}+(?:\|{prim_type}+)*(?:x{prim_type}(?:\|{prim_type})*\?{prim_type}(?:\|{prim_type})*:{prim_type}(?:\|{prim_type})*)*)"
    TYPE = named["TYPE"]
    TA = rf"(?::{TYPE})?" if ts else ""
    GP = gen + P["params"]
    named["arrow"] = rf"(?:a?(?:{I}|{GP}{TA})→)"
    arrow = named["arrow"]
    named["cls"] = rf"(?:c{I}?{gen}(?:x(?:{I}|k|{P['expr']})(?:\.|{P['args']})*{gen})?" + (rf"(?:P{TYPE}(?:,{TYPE})*)?" if ts else "") + rf"{B['class']})"
    cls = named["cls"]
    named["func"] = rf"a?f\*?{I}?{GP}{TA}{B['block']}"
    func = named["func"]
    named["prim"] = rf"(?:{func}|{cls}|{I}|[k1\"`/]|{P['expr']}|{S['array']}|{B['object']}|m(?:{P['args']}|\.)|V\.|(?<=→){B['block']}|Y)"
    prim = named["prim"]
    named["post"] = rf"(?:\.|{P['args']}|\n?{S['index']}|`" + (rf"|‹(?=[`]|{P['args']})|!(?![{I[1:-1]}k1\"])" if ts else "") + ")*+%?"
    post = named["post"]
    casts = rf"(?:A(?:[vç]|{TYPE}))*" if ts else ""
    named["operand"] = rf"(?:(?:[u!+%V]|Y\*?)*{prim}{post}{casts})"
    operand = named["operand"]
    named["chain"] = rf"{operand}(?:(?:>+\^?|[\^*+|#<]){operand})*"
    chain = named["chain"]
    named["bind"] = rf"(?:{I}|{B['object']}|{S['array']})"
    bind = named["bind"]
    # what can be assigned to: a name, a pattern, something in brackets, a member or an element
    named["target"] = rf"(?:(?:{bind}|{P['expr']}){'!?' if ts else ''}(?=[=≔>])|V*{prim}{post}(?<=[.!]|{S['index']}))"
    target = named["target"]
    named["EXPR"] = rf"(?:(?:{arrow}|Y\*?|{target}(?:[=≔]|>+\^))*{chain}(?:\?(?&EXPR):(?&EXPR))?)"
    EXPR = named["EXPR"]
    EXPRS = seq1(EXPR)
    named["decl"] = rf"{bind}{'!?' if ts else ''}{TA}(?:={EXPR})?"
    decl = named["decl"]
    named["constant"] = rf"{bind}{TA}={EXPR}" + (rf"|{I}:{TYPE}" if ts else "")  # only a typed one may be declared elsewhere
    named["vars"] = rf"(?:v{seq1(decl)}|ç{seq1(named['constant'])})"
    vars_ = named["vars"]
    END = r"(?:;|\n|\Z|(?=e))"
    spec_from = r'F"(?:[#A]' + B["object"] + ")?"
    named["imports"] = rf"m(?:\"|(?:T(?!F))?(?:{I}(?:,(?:{B['names']}|\*A{I}))?|{B['names']}|\*A{I}){spec_from}){END}"
    imports = named["imports"]
    named["fdecl"] = rf"a?f\*?{I}{GP}{TA}(?:{B['block']}" + (f"|{END}" if ts else "") + ")"
    fdecl = named["fdecl"]
    named["typed"] = rf"T*X{I}‹?(?:x{TYPE}(?:,{TYPE})*)?{B['shape']}|T+{I}‹?={TYPE}{END}|T*[vç]?U{I}{B['enum']}|T+(?:{I}\.*|\"){B['block']}|T+(?:[vç]{I}{TA}{END}|{fdecl}|M*{cls})|M+{cls}" if ts else "(?!)"
    typed = named["typed"]
    named["exports"] = rf"E(?:D(?:{func}|{'M*' if ts else ''}{cls}|{EXPR}{END}" + (rf"|X{I}‹?(?:x{TYPE})?{B['shape']}" if ts else "") + rf")|T?{B['names']}(?:{spec_from})?{END}|T?\*(?:A{W})?{spec_from}{END}|{vars_}{END}|{fdecl}|{cls}|" + typed + (f"|={EXPR}{END}" if ts else "") + ")"
    exports = named["exports"]

    def statements(name: str, block: str, switch: str, returns: str) -> tuple[str, str]:
        named[f"simple{name}"] = (
            rf"(?:;|{vars_}{END}|{fdecl}|(?:@{P['args']}?\n?)*(?:{cls}|{exports}){returns}|q{EXPRS}{END}|b{I}?{END}"
            rf"|y{block}(?:h(?:{P['params']})?{block}(?:z{block})?|z{block})|W{P['expr']}{switch}|{imports}|{typed}|{EXPRS}{END}|{block})"
        )
        again = f"(?&stmt{name})"
        named[f"stmt{name}"] = (
            rf"(?:j{P['expr']}\n?{again}(?:\n*e\n?{again})?|w{P['expr']}\n?{again}|lu?{P['for']}\n?{again}|d\n?{again}\n*w{P['expr']};?|{I}:\n?{again}|{named[f'simple{name}']})"
        )
        named[f"LIST{name}"] = rf"\n*+(?:{named[f'stmt{name}']}\n*+)*"
        return named[f"stmt{name}"], named[f"LIST{name}"]

    # in functions, and outside of them where there is no return
    _, LIST = statements("", B["block"], B["switch"], rf"|R(?:{EXPRS})?{END}")
    _, TOP = statements("top", B["plain"], B["turn"], "")
    named["key"] = rf"(?:{W}|[\"1]|{S['index']})"
    key = named["key"]
    named["prop"] = rf"(?:&{EXPR}|{key}:{EXPR}|[ag]*\*?{key}{GP}{TA}{B['block']}|{I}(?:={EXPR})?)"
    prop = named["prop"]
    deco = rf"(?:@{P['args']}?\n?)*"
    named["param"] = rf"(?:{deco}{'M*' if ts else ''}&?(?:{bind}{'|k' if ts else ''}){'[?]?' if ts else ''}{TA}(?:={EXPR})?)"
    param = named["param"]
    mods = "[MSagT]*" if ts else "[Sag]*"
    named["member"] = rf"(?:[;\n]|{deco}(?:S{B['block']}|{mods}\*?{key}{'[?]?' if ts else ''}{GP}{TA}(?:{B['block']}" + (f"|{END}" if ts else "") + rf")|{mods}{key}{'[?!]?' if ts else ''}{TA}(?:={EXPR})?{END}" + (rf"|{mods}{S['type']}:{TYPE}{END}" if ts else "") + "))"
    member = named["member"]
    named["shape"] = rf"(?:(?:\+?M)*(?:[gS]*{key}\??(?:{GP})?(?::{TYPE})?|V?{GP}(?::{TYPE})?|{S['type']}\+?\??(?::{TYPE})?))"
    shape = named["shape"]
    case = lambda listed: rf"(?:\n*+(?:C{EXPRS}|D):{listed})*"
    rules = {
        "(": {"args": seq(f"&?{EXPR}"), "expr": EXPRS, "params": seq(param), "for": rf"(?:[vç]{seq1(decl)}|{EXPRS})?;(?:{EXPRS})?;(?:{EXPRS})?|[vç]?{bind}[o#]{EXPRS}|{operand}[o#]{EXPRS}"},
        "[": {"array": Series(rf"(?:,|&?{EXPR}(?:,|\Z))*", rf"(?:&?{EXPR})?", ",", True), "index": EXPRS, "empty": ""},
        "{": {"block": LIST, "plain": TOP, "object": seq(prop), "class": rf"\n*+(?:{member}\n*+)*", "switch": case(LIST), "turn": case(TOP), "names": seq(rf"(?:T(?!A))?(?:{W}|\")(?:A(?:{W}|\"))?")},
    }
    if ts:
        rules["("]["type"] = rf"{seq(param)}|{TYPE}"
        rules["["]["type"] = rf"{seq(rf'(?:&?{I}[?]?:)?&?{TYPE}[?]?')}|{I}#{TYPE}(?:A{TYPE})?"
        rules["{"] |= {"shape": rf"\n*+(?:{shape}(?:[;,]\n*|\n+|\Z))*", "enum": seq(rf"{key}(?:={EXPR})?")}
    angle = None
    if ts:
        priv = "-"
        angle = rf"(?:(?<=[A-Za-z.])|(?<=[=(,:;→{priv}])|^)<(?:[A-Za-z.,|‹=k\"1?:→`\n{priv}])+>(?![iaogSFTMXUk1\"])"
    # two names, or a name and a literal, never follow each other on a line
    return BracketGrammar(scanner, kinds, keywords, newlines, {"(": P, "[": S, "{": B}, named, rules, TOP, angle, never=r'i[i1"]' if ts else r'i[i1"cf]')


def _java() -> BracketGrammar:
    P, S, B = Roles(0xE000, "args expr params for type resources"), Roles(0xE100, "index empty"), Roles(0xE200, "block class switch enum array")
    named = Rules()
    scanner = (
        r"(?P<name>(?!non-sealed\b)[A-Za-z_$][\w$]*)|" + _MARK + r"(?P<space>[\s ﻿]+)|" + _NOTE + r"|(?P<str>\"\"\"[ \t]*\r?\n(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^u]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3})')"
        r"|(?P<member>(?:(?<!\.)\.(?!\.)|::)\s*(?:[A-Za-z_$ª-퟿][\w$]*|\*))"
        r"|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))"
        r"|(?P<seal>non-sealed\b)|(?P<atint>@interface\b)|(?P<deco>@\s*[A-Za-z_$][\w$]*(?:\.[\w$]+)*)"
        r"|(?P<word>[A-Za-z_$ª-퟿][\w$]*)|(?P<skip>\.(?=\s*<))"
        r"|(?P<punct>->|\.\.\.|<<=|==|!=|<=|>=|<<|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=?:,;(){}\[\]])"
    )
    kinds = {"num": "1", "str": '"', "member": ".", "deco": "@", "seal": "M", "atint": "c", "skip": "", "-": "+", "~": "!", "&": "|", "++": "%", "--": "%", "->": "→", "...": "&", "/": "^", "%": "^", "*": "^"}
    kinds |= {k: "^" for k in "== != <= >= << && || ^".split()} | {k: "≔" for k in "<<= -= += *= /= %= &= |= ^=".split()}
    keywords = _words("""
k this super null true false
p int long double float boolean byte short char void
M public private protected static final abstract native transient volatile strictfp
Y synchronized
c class interface
U enum
x extends implements throws
m import
Q package
R return
q throw
j if
w while
l for
e else
d do
b break continue
y try
h catch
z finally
W switch
C case
D default
V new
# instanceof
u assert
g record sealed permits yield when var
""")  # fmt: skip
    I = "[ig]"
    note = rf"(?:@{P['args']}?)*"
    named["TY"] = rf"(?:{note}(?:{I}|p)\.*‹?(?:\.+‹?)*{S['empty']}*)"
    TY = named["TY"]
    MOD = rf"(?:[MYDg]|@{P['args']}?)*"
    LMOD = rf"(?:M|@{P['args']}?)*"
    named["arrow"] = rf"(?:(?:{I}|{P['params']})→)"
    arrow = named["arrow"]
    named["made"] = rf"V{note}(?:{I}|p)\.*‹?(?:{P['args']}{B['class']}?|(?:{S['index']})+{S['empty']}*|{S['empty']}+{B['array']})"
    made = named["made"]
    named["prim"] = rf"(?:{made}|W{P['expr']}{B['switch']}|{I}‹?{S['empty']}+\.|p{S['empty']}*\.|{I}‹?|[k1\"]|{P['expr']}|(?<=→){B['block']})"
    prim = named["prim"]
    named["post"] = rf"(?:\.‹?|‹{I}|{P['args']}|{S['index']})*+%*"
    post = named["post"]
    named["pattern"] = rf"(?:#{LMOD}{TY}(?:{I}|{P['params']}{I}?)?)?"
    pattern = named["pattern"]
    named["operand"] = rf"(?:(?:[!+%]|{P['type']}(?=[ig k1\"!V-W]|p)|{arrow})*{prim}{post}{pattern})"
    operand = named["operand"]
    named["chain"] = rf"{operand}(?:(?:>+\^?|[\^+|<]){operand})*"
    chain = named["chain"]
    named["target"] = rf"(?:{prim}{post}(?<=[ig.]|{S['index']})|{P['expr']}(?=[=≔>]))"
    target = named["target"]
    SET = r"(?:[=≔]|>+\^)"
    named["EXPR"] = rf"(?:(?:{target}{SET}|{arrow})*{chain}(?:\?(?&EXPR):(?&EXPR))?)"
    EXPR = named["EXPR"]
    named["effect"] = rf"(?:{target}{SET}{EXPR}|%+{operand}|{operand}(?<=%|{P['args']}|{B['class']}))"  # an expression that may be a statement
    effect = named["effect"]
    EXPRS = seq1(EXPR)
    named["init"] = rf"(?:{EXPR}|{B['array']})"
    init = named["init"]
    named["var"] = rf"{I}{S['empty']}*(?:={init})?"
    var = named["var"]
    named["decl"] = rf"{LMOD}{TY}{seq1(var)}"
    decl = named["decl"]
    types = seq1(TY)
    tail = rf"(?:[xg]{types})*"
    named["classes"] = rf"(?:c{I}‹?{tail}{B['class']}|U{I}{tail}{B['enum']}|g{I}‹?{P['params']}{tail}{B['class']})"
    classes = named["classes"]
    named["simple"] = (
        rf"(?:;|{decl};|{MOD}{classes}|R(?:{EXPR})?;|q{EXPR};|b{I}?;|g{EXPR};|u{EXPR}(?::{EXPR})?;"
        rf"|y(?:{P['resources']}{B['block']}(?:h{P['params']}{B['block']})*(?:z{B['block']})?|{B['block']}(?:(?:h{P['params']}{B['block']})+(?:z{B['block']})?|z{B['block']}))"
        rf"|W{P['expr']}{B['switch']}|Y{P['expr']}{B['block']}|{effect};|{B['block']})"
    )
    simple = named["simple"]
    named["stmt"] = rf"(?:j{P['expr']}(?&stmt)(?:e(?&stmt))?|w{P['expr']}(?&stmt)|l{P['for']}(?&stmt)|d(?&stmt)w{P['expr']};|{I}:(?&stmt)|{simple})"
    stmt = named["stmt"]
    named["LIST"] = rf"(?:{stmt})*"
    LIST = named["LIST"]
    named["member"] = rf"(?:;|{MOD}(?:‹?(?:{TY})?{I}(?:{P['params']}{S['empty']}*(?:[x]{types})?)?(?:{B['block']}|(?<=[^ig]);|D{init};)|{TY}{seq1(var)};|{B['block']}|{classes}))"
    member = named["member"]
    BODY = rf"(?:{member})*"
    named["label"] = rf"(?:C(?:{EXPRS}|{TY}{I}(?:g{EXPR})?|k,D|{TY}{P['params']}(?:g{EXPR})?)|D)"
    label = named["label"]
    rules = {
        "(": {"args": seq(init), "expr": EXPR, "params": rf"{seq(rf'{LMOD}{TY}(?:[|]{TY})*&?(?:{I}|k){S["empty"]}*')}|{seq(I)}", "for": rf"(?:{decl}|{EXPRS})?;(?:{EXPR})?;(?:{EXPRS})?|{LMOD}{TY}{I}:{EXPR}", "type": rf"{TY}(?:\|{TY})*", "resources": rf"(?:{decl}|{EXPR})(?:;(?:{decl}|{EXPR}))*;?"},
        "[": {"index": EXPR, "empty": ""},
        "{": {"block": LIST, "class": BODY, "switch": rf"(?:{label}:{LIST})*|(?:{label}→(?:{EXPR};|{B['block']}|q{EXPR};))*", "enum": rf"{seq(rf'{note}{I}(?:{P["args"]})?(?:{B["class"]})?')}(?:;{BODY})?", "array": seq(init)},
    }
    program = rf"(?:{note}Q{I}\.*;)?(?:;|m[M]?{I}\.*;)*(?:;|{MOD}{classes})*"
    priv = "-"
    angle = rf"<(?:[igpk.,?x|‹@{priv}])*>(?![1\"k])"
    return BracketGrammar(scanner, kinds, keywords, lambda s: s.replace("\n", ""), {"(": P, "[": S, "{": B}, named, rules, program, angle, never=r'\A\n*[^@QmMYDcUg;\n]|i["1]|m[^iMg\n]|Q(?:[^ig\n]|\n*[ig][.\n]*[^.;\n])')


def _go() -> BracketGrammar:
    P, S, B = Roles(0xE000, "args expr params imports vars types type"), Roles(0xE100, "index empty params"), Roles(0xE200, "block struct interface literal switch select")
    named = Rules()
    scanner = (
        r"(?P<name>[A-Za-z_]\w*)|" + _MARK + r"(?P<nl>\n)|" + _SPACE + "|" + _NOTE + r"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^xuU0-7]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{3})')"
        r"|(?P<member>(?<!\.)\.(?!\.)\s*[A-Za-z_ª-퟿]\w*)|(?P<assert>(?<!\.)\.\s*\()|(?P<skip>(?<!\.)\.(?=\s*\"))"
        r"|(?P<num>(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bBoO][\d_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))"
        r"|(?P<word>[A-Za-z_ª-퟿]\w*)"
        r"|(?P<punct>:=|\.\.\.|<<=|>>=|&\^=|&\^|==|!=|<=|>=|<<|>>|<-|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=:,;(){}\[\]])"
    )
    kinds = {"num": "1", "str": '"', "member": ".", "assert": "(", "skip": "i", "nl": "\n", ":=": "≔", "-": "+", "^": "+", "&": "+", "~": "~", "<-": "<", "++": "%", "--": "%", "...": "&", "|": "|"}
    kinds |= {k: "^" for k in "== != <= >= << >> && || / % &^ < >".split()} | {k: "=" for k in "-= += *= /= %= &= |= ^= <<= >>= &^=".split()}
    keywords = _words("""
f func
j if
e else
l for
o range
R return
b break continue goto fallthrough
W switch
w select
C case
D default
s struct
X interface
M map
h chan
T type
v var const
m import
Q package
g go defer
""")  # fmt: skip

    def newlines(s: str) -> str:
        return re.sub(r"(?<=[i1\"bR%)\]}.])\n", ";", s).replace("\n", "")

    named["base"] = rf"(?:i\.?{S['params']}?|f{P['params']}(?:{P['params']})?|s{B['struct']}|X{B['interface']}|{P['type']})"
    base = named["base"]
    named["pre"] = rf"(?:\*|{S['empty']}|{S['index']}|<?h<?|M{S['index']}|f{P['params']}(?={P['params'][:-1]}if*sXMh<-]))"
    pre = named["pre"]
    named["TY"] = rf"(?:{pre}*{base})"
    TY = named["TY"]
    RES = rf"(?:{P['params']}|{TY})?"
    named["lit"] = rf"(?:{pre}*{base}{B['literal']})"
    lit = named["lit"]
    named["prim"] = rf"(?:f{P['params']}{RES}{B['block']}|{lit}|(?:{pre}+{base})(?=[-,)]|\Z)|i|[1\"]|{P['expr']}|{P['type']}|X{B['interface']}|s{B['struct']}|{TY})"
    prim = named["prim"]
    named["post"] = rf"(?:\.|{P['args']}|{S['index']}|{S['params']}|{P['type']})*+(?:{B['literal']}(?:\.|{P['args']})*)?"
    post = named["post"]
    named["operand"] = rf"(?:[+!*<]*{prim}{post})"
    operand = named["operand"]
    named["EXPR"] = rf"(?:{operand}(?:[\^+*|]{operand})*)"
    EXPR = named["EXPR"]
    EXPRS = seq1(EXPR)
    ids = "i(?:,i)*"
    named["var"] = rf"{ids}(?:{TY})?(?:={EXPRS})?"
    var = named["var"]
    tdecl = rf"i(?:{S['params']})?=?{TY}"
    named["simple"] = rf"(?:{EXPRS}(?:[=≔](?:o?{EXPRS})|%|<{EXPR})?)"
    simple = named["simple"]
    named["IF"] = rf"j(?:{simple}?;)?{EXPR}{B['block']}"
    IF = named["IF"]
    named["stmt"] = (
        rf"(?:(?:i:;?)*(?:{IF}(?:e{IF})*(?:e{B['block']})?|l(?:{simple}?;{EXPR}?;{simple}?|{EXPR}|(?:{EXPRS}[=≔])?o{EXPR})?{B['block']}|W(?:{simple}?;)?(?:{simple})?{B['switch']}|w{B['select']}"
        rf"|R(?:{EXPRS})?|bi?|g{EXPR}|v(?:{var}|{P['vars']})|T(?:{tdecl}|{P['types']})|{B['block']}|{simple}))"
    )
    stmt = named["stmt"]
    named["LIST"] = rf"(?:{stmt}?(?:;{stmt}?)*)"
    LIST = named["LIST"]
    named["field"] = rf"(?:(?:{ids}{TY}|\*?i\.?{S['params']}?)\"?)"
    field = named["field"]
    named["union"] = rf"~?{TY}(?:\|~?{TY})*"
    union = named["union"]
    named["value"] = rf"(?:{EXPR}|{B['literal']})"
    value = named["value"]
    named["param"] = rf"(?:i?&?{TY})"
    param = named["param"]
    named["func"] = rf"f(?:{P['params']})?i(?:{S['params']})?{P['params']}{RES}(?:{B['block']})?"
    func = named["func"]
    spec = r'[i]?"'
    rules = {
        "(": {"args": seq(rf"{EXPR}&?"), "expr": EXPR, "params": seq(param), "imports": seq(spec, ";"), "vars": seq(var, ";"), "types": seq(tdecl, ";"), "type": rf"{TY}|T"},
        "[": {"index": rf"{EXPR}|&|(?:{EXPR})?:(?:{EXPR})?(?::{EXPR})?", "empty": "", "params": seq(rf"(?:{ids}{union}|{TY})")},
        "{": {"block": LIST, "struct": seq(field, ";"), "interface": seq(rf"(?:i{P['params']}{RES}|{union})", ";"), "literal": seq(rf"(?:{value}:)?{value}"), "switch": rf"(?:(?:C{seq1(rf'(?:{EXPR}|{TY})')}|D):{LIST})*", "select": rf"(?:(?:C{simple}|D):{LIST})*"},
    }
    program = rf";*Qi(?:;+m(?:{spec}|{P['imports']}))*(?:;+(?:{func}|v(?:{var}|{P['vars']})|T(?:{tdecl}|{P['types']})))*;*"
    return BracketGrammar(scanner, kinds, keywords, newlines, {"(": P, "[": S, "{": B}, named, rules, program, never=r"\A[\n;]*(?:[^Q\n;]|Q\n*(?:[^i\n]|i[^;\n]))")


@lru_cache(maxsize=None)
def bracket_grammar(language: str) -> BracketGrammar:
    return {"javascript": lambda: _ecma(False), "typescript": lambda: _ecma(True), "java": _java, "go": _go}[language]()


def _python(text: str, likely: bool = True) -> bool:
    import _symtable

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            if likely:
                _symtable.symtable(text, "f", "exec")  # parses without building Python objects for the tree
                return True
        except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
            pass
        try:  # the symbol table also refuses wrong use of names, which is no matter of grammar
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
            return False


def _refuse(value: str):
    raise ValueError(value)


_DECODE = json.JSONDecoder(parse_constant=_refuse).decode


def _json(text: str) -> bool:
    try:
        _DECODE(text.removeprefix("﻿"))
        return True
    except (ValueError, RecursionError):
        return False


def parses(language: str, text: str) -> bool:
    """Whether the whole text belongs to the language's grammar; mixed line ends count as line ends."""
    if language == "python":
        return _python(text)
    if language == "json":
        return _json(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return bracket_grammar(language).accepts(text)


#: Tokens that are much more frequent in one language than in the others.
MARKS = {
    "python": "def self elif None True False import from except pass lambda with not and or is raise",
    "javascript": "const let function var => === require export undefined typeof async await new",
    "typescript": "const let interface readonly string number boolean export enum type implements => Promise void any",
    "java": "public private static final void class package import new throws extends String int @Override",
    "go": "func package := chan defer nil err struct map range go interface type string",
    "json": "",
}
_MARKS = {k: frozenset(v.split()) for k, v in MARKS.items()}
_TOKEN = re.compile(r"@?[A-Za-z_]\w*|=>|===|:=|[{}\[\]:;]")


def rank_languages(text: str) -> list[str]:
    """Languages by the share of tokens that are marks of the language, best first; ties in fixed order."""
    counts = Counter(_TOKEN.findall(text))
    total = sum(counts.values()) or 1
    score = {k: sum(counts[t] for t in marks) / total for k, marks in _MARKS.items()}
    score["json"] = 1.0 if text.lstrip()[:1] in ("{", "[") and not counts[";"] else 0.0
    if counts[";"] * 12 > total:
        score["python"] *= 0.3
    return sorted(LANGUAGES, key=lambda k: (-score[k], LANGUAGES.index(k)))


def examine(language: str, text: str) -> tuple[bool, list[str]]:
    """(parses in the language given, all languages whose grammar accepts the text, best ranked first).

    Every text is parsed by every grammar; one without any word is looked at in the language given only."""
    if not text.strip():
        good = parses(language, text)
        return good, [language] * good
    good: set[str] = set()
    for other in LANGUAGES:
        # plain JavaScript is valid TypeScript: what the one grammar accepts belongs to the other too
        # and what is said to be of another language is hardly Python, so that it is parsed once
        if (other == "typescript" and "javascript" in good) or (_python(text, False) if other == "python" != language else parses(other, text)):
            good.add(other)
    ranked = rank_languages(text) if len(good) > 1 else good  # nothing to rank in one
    return language in good, [other for other in ranked if other in good]
