"""Problem 6: source files that do not parse.

Method: a lexer per language (fixed token patterns) and a pushdown stack find unterminated literals, unbalanced
delimiters, premature ends, merge-conflict markers, tokens that cannot stand beside each other and, for Python, lines
whose indentation or block structure doesn't hold (`python_lexer`). No parser of the interpreter takes part, so verdicts
don't depend on the workers' Python version. The lexer is a small helper inside an Arrow UDF over whole files; Spark
partitions the files, and counts and rates are ordinary aggregates.

Defined results: null or empty content is valid, except for Go, which needs a package clause; a null path or any other
extension yields no row; a byte-order mark and all kinds of line ends are valid.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codeloom.io import spread

from . import python_lexer

# ---- Fixed values: token patterns ------------------------------------------------------------------------------
_STRINGS = r"""(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*+"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*+')|(?P<badstr>["'])"""
_BLOCK = r"(?P<com>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<badcom>/\*)"
_NUMBER = r"(?P<num>0[xXoObB][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[ni]?)"
_SPACE = r"(?P<nl>\r\n?|\n| | )|(?P<ws>[ \t\f\v\xa0﻿]+)"
ECMA = re.compile(
    rf"{_SPACE}|{_BLOCK}|{_STRINGS}|{_NUMBER}|(?P<id>[#@]?(?:[^\W\d]|[$\\])(?:\w|[$‌‍])*+)|(?P<tick>`)"
    r"|(?P<op>=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|>=|\+\+|--|&&=?|\|\|=?|\?\?=?|\*\*=?|[-+*/%&|^]=|[-+*/%&|^=<>!?:;,.~])"
    r"|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<bad>[\s\S])"
)
GO = re.compile(
    rf"{_SPACE}|{_BLOCK}|(?P<str>\"(?:[^\"\\\r\n]|\\.)*+\"|`[^`]*`|'(?:[^'\\\r\n]|\\[^\r\n]+?)')|(?P<badstr>[\"'`])|{_NUMBER}"
    r"|(?P<id>[^\W\d]\w*+)|(?P<op>:=|\.\.\.|<-|&\^=?|<<=?|>>=?|==|!=|<=|>=|\+\+|--|&&|\|\||[-+*/%&|^]=|[-+*/%&|^=<>!:;,.~])"
    r"|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<bad>[\s\S])"
)
REGEX_LITERAL = re.compile(r"/(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*+\])++/[A-Za-z]*")
TEMPLATE_PART = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?P<end>`|\$\{)?")
JSX_TEXT = re.compile(r"[^<{]*+(?P<end></[^<>{}]*>|<|\{)?")
JSX_TAG = re.compile(r"(?:\s|[\w$.:-]|=|//[^\n]*|/\*[\s\S]*?\*/|\"[^\"]*\"|'[^']*')*+(?P<end>/>|>|\{)?")
TYPE_PARAMETERS = re.compile(r"\w+\s*(?:,|extends\b)")  # of an arrow function in a .tsx file
MEMBER = re.compile(r"\s*[(=;?:<!]")  # what follows a word that is a member's name behind a modifier
OPTIONAL = re.compile(r"\?\s*:")
KEY = re.compile(r"\s*[:,}=]")  # what follows a word that is a property name
CONFLICT = re.compile(r"^(?:<{7}|\|{7}|={7}|>{7})(?=\s|$)", re.M)

# ---- Fixed values: words of the languages ----------------------------------------------------------------------
ECMA_STATEMENT = frozenset("const let var return if for while switch case throw try break continue import export do catch finally else".split())
ECMA_WORDS = ECMA_STATEMENT | frozenset("function class extends new delete typeof void in instanceof default await yield this super null true false debugger with".split())
ECMA_VALUES = frozenset("this super null true false".split())
JS_BEFORE = frozenset("async get set static of as from accessor using".split())
JS_AFTER = frozenset("of as from".split())
TS_BEFORE = JS_BEFORE | frozenset(
    "type interface namespace module declare readonly abstract public private protected override infer is keyof satisfies enum unique asserts out implements global".split()
)
TS_AFTER = JS_AFTER | frozenset("is satisfies implements extends keyof".split())
GO_STATEMENT = frozenset("break case const continue default defer else fallthrough for go goto if import package return select switch type var".split())
GO_WORDS = GO_STATEMENT | frozenset("func interface map struct chan range".split())
GO_TOP = frozenset("package import const var type func".split())
PAIRS = {")": "(", "}": "{", "]": "["}
NEEDS_RIGHT = frozenset("= + - / % && || ?? => == === != !== <= >= += -= *= /= %= . ?. := <- & | ^".split())
#: Operators that no operand begins with; the second line holds for JavaScript only, where no type can stand.
NOT_FIRST = frozenset("= == === != !== <= >= => % && || ?? *= /= %= += -= **= &&= ||= ??= &= |= ^= ^ . ?.".split())
JS_NOT_FIRST = NOT_FIRST | frozenset("* < > & | ? :".split())
GO_NOT_FIRST = frozenset("= := == != <= >= += -= *= /= %= &= |= ^= <<= >>= &^= << >> && || / % | . : > <".split())
MODIFIERS = frozenset("async get set static public private protected readonly override abstract accessor".split())
DECLARING = frozenset("function class const let var import export".split())
GO_BINARY = NEEDS_RIGHT - {"<-", "."} | {"*", "<", ">", "!", "<<", ">>", "|=", "&=", "^=", "<<=", ">>="}
#: Words whose parentheses hold a condition: a statement begins behind them.
CONDITION = frozenset("if while for with".split())
END_OF = frozenset([")", "]", "}", ";", ","])


def _line(s: str, at: int) -> int:
    return len(re.findall(r"\r\n?|\n", s[:at])) + 1


def ecma_fault(s: str, ext: str) -> tuple[str, int] | None:
    """The first fault of a JavaScript or TypeScript text and where it is, or None. ext: .js, .ts or .tsx."""
    js, tsx = ext == ".js", ext == ".tsx"
    before, after = (JS_BEFORE, JS_AFTER) if js else (TS_BEFORE, TS_AFTER)
    stack: list[list] = []  # [delimiter, position, open conditionals]
    level = root = ["", 0, 0]
    names = ""  # import or export, while names may follow
    pos, n, match = 2 if s.startswith("#!") else 0, len(s), ECMA.match
    if pos:
        pos = (m := re.compile(r"[^\r\n]*").match(s, pos)).end()
    kind, text, fresh, declared, pending = "op", "", True, "", -1  # the token before; line break since; const|let|var NAME; function without a body
    while pos < n:
        m = match(s, pos)
        k, start, pos = m.lastgroup, pos, m.end()
        if k == "ws":
            continue
        if k == "nl":
            fresh = True
            continue
        if k == "com":
            fresh = fresh or "\n" in m[0] or "\r" in m[0]
            continue
        t = m[0]
        if fresh and t[0] in "<>=|" and CONFLICT.match(s, start):
            return "conflict marker", start
        if k == "op" and t in ("/", "/=") and (kind not in ("id", "num", "str", "close") or kind == "close" and text == "}" and fresh):
            r = REGEX_LITERAL.match(s, start)
            if not r and kind == "close":
                pass  # a division of what the brace ends
            elif not r:
                return "unterminated literal", start
            else:
                k, t, pos = "str", "/", r.end()
        if k == "id":
            if kind == "op" and text in (".", "?."):
                pass  # a property; any word will do
            elif kind == "id" and text == "as" and (t == "const" and not js or names):
                pass  # as const; a name that is exported as a word
            elif kind == "id" and text in MODIFIERS and t not in DECLARING and MEMBER.match(s, pos) or t in ECMA_STATEMENT and OPTIONAL.match(s, pos):
                pass  # a member's name
            elif t in ECMA_WORDS and not ((text == "{" or text == "," and level[0] == "{") and KEY.match(s, pos)):
                if kind == "kw" and text in ("const", "let", "var"):
                    return "misplaced word", start
                if t in ECMA_STATEMENT and kind in ("id", "num", "str") and not fresh and not (text == "declare" and not js):
                    return "misplaced word", start
                if t in ECMA_STATEMENT and kind == "op" and text in NEEDS_RIGHT and t not in ("import", "do"):
                    return "misplaced word", start
                if t == "function" and not stack:
                    pending = start
                if t in ("import", "export"):
                    names = t
                kind, text, fresh = ("id" if t in ECMA_VALUES else "kw"), t, False
                continue
        if k in ("id", "num", "str", "tick") and kind in ("id", "num", "str") and not fresh:
            renames = t == "as" or text == "as"
            ok = kind == "id" and (text in before or text in ("type", "interface") and not js) or k == "id" and t in after or k == "tick" and kind == "id"
            if not ok or js and renames and not (names and level[0] in ("{", "")):
                return "tokens that cannot be neighbours", start
        if kind == "kw" and text in ("const", "let", "var") and (k in ("num", "str", "op", "close", "tick") or k == "open" and t == "("):
            return "missing name", start
        if k == "id":
            if kind == "kw" and text in ("const", "let", "var"):
                declared = t
        elif k == "op":
            if kind == "op" and text in NEEDS_RIGHT and (t in (";", ",") or t in (JS_NOT_FIRST if js else NOT_FIRST)):
                return "missing operand", start
            if kind == "op" and text == ":" and t in NOT_FIRST or t == "," and (kind == "open" and text in ("(", "{") or kind == "op" and text == "," and level[0] != "["):
                return "missing operand", start
            if js and t == "<" and kind not in ("id", "num", "str", "close") and text != "<":
                return "markup outside .tsx", start
            if t in ("++", "--") and kind in ("id", "close") and not fresh:
                kind, text, fresh = "num", t, False  # behind its operand: a slash divides
                continue
            if t == "!" and kind in ("id", "close", "str") and not fresh:
                if js:
                    return "tokens that cannot be neighbours", start
                kind, text, fresh = "close", t, False  # not null
                continue
            if t == ";":
                names = ""
            if t == "?":
                level[2] += 1
            elif t == ":":
                if level[2]:
                    level[2] -= 1
                elif js and level[0] in ("(", "[", "${"):
                    return "type annotation outside TypeScript", start
                elif js and declared and kind == "id" and text == declared:
                    return "type annotation outside TypeScript", start
                elif js and kind == "close" and text == ")" and level[0] != "{" and not stack:
                    return "type annotation outside TypeScript", start
            elif t == "<" and tsx and kind not in ("id", "num", "str", "close") and (pos < n and (s[pos].isalpha() or s[pos] == ">") and not TYPE_PARAMETERS.match(s, pos)):
                got = _jsx(s, pos, stack)
                if isinstance(got, str):
                    return got, start
                pos, level = got, stack[-1] if stack else root
                k, t = ("open", "{") if level[0] == "jsx{" and level[1] == pos else ("str", "<>")
            if t != ":":
                declared = ""
        elif k == "open":
            stack.append(level := [t, start, 0, t == "(" and kind == "kw" and text in CONDITION])
            if t == "{":
                pending = -1
        elif k == "close":
            if kind == "op" and text in NEEDS_RIGHT:
                return "missing operand", start
            want = PAIRS[t]
            if not stack:
                return "unbalanced delimiter", start
            top = stack.pop()
            level = stack[-1] if stack else root
            if top[0] == "${" and t == "}":
                got = _template(s, pos, stack)
                if got is None:
                    return "unterminated literal", start
                pos, level = got, stack[-1] if stack else root
                k, t = ("open", "{") if s[pos - 1] == "{" and level[0] == "${" and level[1] == pos else ("str", "`")
            elif top[0] == "jsx{" and t == "}":
                got = _jsx(s, pos, stack, top[3])
                if isinstance(got, str):
                    return got, start
                pos, level = got, stack[-1] if stack else root
                k, t = ("open", "{") if level[0] == "jsx{" and level[1] == pos else ("str", "<>")
            elif top[0] != want:
                return "unbalanced delimiter", start
            elif t == ")" and top[3]:
                kind, text, fresh = "op", ")", False  # a statement begins
                continue
        elif k == "tick":
            got = _template(s, pos, stack)
            if got is None:
                return "unterminated literal", start
            pos, level = got, stack[-1] if stack else root
            k, t = ("open", "{") if level[0] == "${" and level[1] == pos else ("str", "`")
        elif k in ("badstr", "badcom"):
            return "unterminated literal", start
        elif k == "bad":
            return "illegal character", start
        kind, text, fresh = k, t, False
    if stack:
        return "premature end", n
    if kind == "op" and text in NEEDS_RIGHT or kind == "kw" and text not in ("return", "break", "continue", "debugger"):
        return "premature end", n
    if kind == "kw" and text in ("const", "let", "var") or js and pending >= 0:
        return "premature end", n
    return None


def _template(s: str, pos: int, stack: list) -> int | None:
    """Reads template text from pos; pushes an expression that opens. None if it doesn't end."""
    m = TEMPLATE_PART.match(s, pos)
    if not m["end"]:
        return None
    if m["end"] == "${":
        stack.append(["${", m.end(), 0])
    return m.end()


def _jsx(s: str, pos: int, stack: list, depth: str | int = 0) -> int | str:
    """Reads markup from behind a '<' (depth 0) or behind an expression's '}' (depth: the open elements, 'T' a tag
    being read, 'C' its children). Pushes an expression that opens, with the depth to come back to."""
    state = depth or "T"
    while state:
        m = (JSX_TAG if state[-1] == "T" else JSX_TEXT).match(s, pos)
        end = m["end"]
        if not end:
            return "unbalanced delimiter"
        pos = m.end()
        if end == "{":
            stack.append(["jsx{", pos, 0, state])
            return pos
        if end == "<":
            state += "T"
        elif end == ">":
            state = state[:-1] + "C"
        else:  # '/>' or a closing tag
            state = state[:-1]
    return pos


def go_fault(s: str) -> tuple[str, int] | None:
    """The first fault of a Go text, or None."""
    stack: list[list] = []  # [delimiter, whether it holds fields or parameters]
    pos, n, match = 0, len(s), GO.match
    kind, text, fresh, first, seen, fields = "op", "", True, "", False, False
    while pos < n:
        m = match(s, pos)
        k, start, pos = m.lastgroup, pos, m.end()
        if k == "ws":
            continue
        if k == "nl":
            fresh = True
            continue
        if k == "com":
            fresh = fresh or "\n" in m[0]
            continue
        t = m[0]
        if k in ("badstr", "badcom"):
            return "unterminated literal", start
        if k == "bad":
            return "illegal character", start
        if fresh and t[0] in "<>=|" and CONFLICT.match(s, start):
            return "conflict marker", start
        ended = fresh and kind in ("id", "num", "str", "close", "") or text == ";"  # a statement begins here
        if not seen:
            if t != "package":
                return "no package clause", start
            seen = True
        if ended or first == "":
            if not stack and not (k == "close") and t not in GO_TOP and t != ";":
                return "misplaced token outside a declaration", start
            first = t
        if k == "id":
            word = t in GO_WORDS and not (kind == "op" and text == ".")
            if t == "else" and (fresh or kind != "close" or text != "}"):
                return "misplaced word", start
            if word and t in GO_STATEMENT:
                if kind in ("id", "num", "str") and not fresh and not (t == "else"):
                    return "misplaced word", start
                if kind == "op" and text in NEEDS_RIGHT | {"*", "!", "<", ">"} and t not in ("default",):
                    return "misplaced word", start
            if kind in ("id", "num", "str") and not fresh and not word and stack and stack[-1][0] == "{" and not stack[-1][1] and first not in GO_TOP:
                return "tokens that cannot be neighbours", start
            if word:
                fields = t in ("struct", "interface")
                kind, text, fresh = ("kw" if t not in ("break", "continue", "fallthrough", "return") else "id"), t, False
                if t in ("break", "continue", "fallthrough", "return"):
                    kind = "jump"
                continue
        elif k in ("num", "str"):
            if kind in ("num", "str") and not fresh:
                return "tokens that cannot be neighbours", start
            if kind == "id" and not fresh and stack and stack[-1][0] == "{" and not stack[-1][1] and first not in GO_TOP:
                return "tokens that cannot be neighbours", start
        elif k == "open":
            stack.append([t, t == "{" and fields])
            if t == "{":
                first = " "
        elif k == "close":
            if kind == "op" and text in NEEDS_RIGHT and text not in ("<-", "."):
                return "missing operand", start
            if not stack or stack.pop()[0] != PAIRS[t]:
                return "unbalanced delimiter", start
        elif k == "op" and kind == "op" and (text in NEEDS_RIGHT and t in (";", ",") or text in GO_BINARY and t in GO_NOT_FIRST and not (t == "." and text == ".")):
            return "missing operand", start
        fields, kind, text, fresh = False, k, t, False
        if k == "open" and t == "{":
            kind, text = "op", ";"
    if not seen:
        return "no package clause", 0
    if stack or kind == "op" and text in NEEDS_RIGHT or kind == "kw":
        return "premature end", n
    return None


def fault(text: str | None, path: str) -> str | None:
    """'cause:line' of the first fault, or None if the text is valid for the extension of the path."""
    ext = path[path.rfind(".") :].lower()
    s = (text or "").removeprefix("﻿")
    if ext == ".py":
        got = python_lexer.fault(s)
    elif ext == ".go":
        got = go_fault(s)
    else:
        got = ecma_fault(s, ext)
    if got and got[0] != "conflict marker":
        for m in CONFLICT.finditer(s):  # the fault stands in the lines of a marker
            if m.start() <= got[1] <= m.end() + 1:
                got = ("conflict marker", m.start())
    return f"{got[0]}:{_line(s, got[1])}" if got else None


@F.pandas_udf(StringType())
def fault_of(content: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([fault(c, p) for c, p in zip(content, path)], dtype=object)


EXTENSIONS = r"(?i)\.(ts|tsx|js|go|py)$"


def parse_verdicts(files: DataFrame) -> DataFrame:
    """One row per path: repository, language, valid, cause, line. Rows delivered twice count once."""
    x = spread(files.filter(F.col("path").rlike(EXTENSIONS)).select("path", "repository", "language", "content"))
    x = x.select("path", "repository", "language", fault_of("content", "path").alias("_f"))
    x = x.groupBy("path").agg(F.max("repository").alias("repository"), F.max("language").alias("language"), F.max("_f").alias("_f"))
    return x.select(
        "path",
        "repository",
        "language",
        F.col("_f").isNull().alias("valid"),
        F.substring_index("_f", ":", 1).alias("cause"),
        F.substring_index("_f", ":", -1).cast("long").alias("line"),
    )


def failure_rates(files: DataFrame) -> DataFrame:
    """Share of invalid files per repository and language (null as null), with the number of files."""
    return (
        parse_verdicts(files)
        .groupBy("repository", F.lower("language").alias("language"))
        .agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
        .withColumn("invalid_share", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
