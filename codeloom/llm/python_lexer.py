"""Python's part of problem 6: a lexer, a stack of delimiters and a stack of blocks.

Logical lines are told by delimiters and line joins. Each line's indentation is held against the stack of blocks, its
words against what may begin, follow or end a statement, and `else`, `except` and the like against the line that they
continue. Replacement fields of f-strings are read with strings and delimiters nested in them.
"""

from __future__ import annotations

import re

# ---- Fixed values: token patterns and words of the language -----------------------------------------------------
_TEXT = (
    r'"""(?:[^\\]|\\[\s\S])*?"""|' + r"'''(?:[^\\]|\\[\s\S])*?'''|"
    r'"(?!"")(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*+"|' + r"'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*+'"
)
TOKEN = re.compile(
    r"(?P<ws>[ \t\f]+|\\(?:\r\n?|\n))|(?P<nl>\r\n?|\n)|(?P<com>#[^\r\n]*)"
    r"|(?P<fstr>(?:[fFtT][rR]?|[rR][fFtT])(?:\"\"\"|'''|\"|'))"
    rf"|(?P<str>(?:[bB][rR]?|[rR][bB]?|[uU])?(?:{_TEXT}))|(?P<badstr>[\"'])"
    r"|(?P<num>0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<id>[^\W\d][\w\uFE00-\uFE0F\U000E0100-\U000E01EF]*+)|(?P<op>->|:=|\.\.\.|\*\*=?|//=?|>>=?|<<=?|[-+*/%&|^@=<>!]=|[-+*/%&|^@=<>~.,:;])"
    r"|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<bad>[\s\S])"
)
STRING = re.compile(rf"(?:[bB][rR]?|[rR][bB]?|[uU])?(?:{_TEXT})")
FSTRING = re.compile(r"(?:[fFtT][rR]?|[rR][fFtT])(\"\"\"|'''|\"|')")
PLAIN = re.compile(r"[^{}\\\"'\r\n]+")
#: Fixed value: how deep the language lets replacement fields lie in each other.
NESTED = 149
ZEROS = re.compile(r"0[\d_]*[1-9][\d_]*$")
PAIRS = {")": "(", "}": "{", "]": "["}
VALUES = frozenset("None True False".split())
INFIX = frozenset("and or not in is if else for async as from import".split())
BLOCKS = frozenset("if for while def class with try except finally else elif".split())
STATEMENTS = BLOCKS - {"if", "for", "else"} | frozenset("return pass break continue del global nonlocal assert raise import from".split())
WORDS = VALUES | INFIX | STATEMENTS | frozenset("lambda yield await".split())
#: Words that may end a statement.
LAST = VALUES | frozenset("return pass break continue yield raise".split())
#: Operators that need an operand behind them, and operators that cannot begin one.
NEEDS_RIGHT = frozenset("= + - % @ ~ & | ^ == != <= >= < > << >> // -> := += -= *= /= %= &= |= ^= >>= <<= //= **= @= .".split())
NOT_FIRST = frozenset("= % & | ^ / // @ == != <= >= < > << >> -> := += -= *= /= %= &= |= ^= >>= <<= //= **= @= . , ; :".split())
#: Which lines a line may continue.
AFTER = {"else": {"if", "elif", "for", "while", "except"}, "elif": {"if", "elif"}, "except": {"try", "except"}, "finally": {"try", "except", "else"}}


def string_end(s: str, pos: int, quote: str, depth: int = 0) -> int | None:
    """Behind the f-string whose text begins at pos, or None; also where more than NESTED lie in each other."""
    n, long = len(s), len(quote) == 3
    if depth > NESTED:
        return None
    while pos < n:
        if m := PLAIN.match(s, pos):
            pos = m.end()
            continue
        c = s[pos]
        if s.startswith(quote, pos):
            return pos + len(quote)
        if c in "\r\n" and not long:
            return None
        if c == "\\":
            if s.startswith("\\N{", pos):
                pos = s.find("}", pos) + 1 or n
            else:
                pos += 1 if s[pos + 1 : pos + 2] in "{}" else 3 if s.startswith("\r\n", pos + 1) else 2
        elif c in "{}" and s[pos + 1 : pos + 2] == c:
            pos += 2
        elif c == "{":
            if (end := field_end(s, pos + 1, depth + 1)) is None:
                return None
            pos = end
        elif c == "}":
            return None
        else:
            pos += 1
    return None


def field_end(s: str, pos: int, depth: int = 0) -> int | None:
    """Behind the '}' of the replacement field whose expression begins at pos, or None."""
    n, stack, begin = len(s), [], pos
    while pos < n:
        c = s[pos]
        if m := FSTRING.match(s, pos):
            if (end := string_end(s, m.end(), m[1], depth + 1)) is None:
                return None
            pos = end
        elif m := STRING.match(s, pos):
            pos = m.end()
        elif c in "\"'":
            return None
        elif c == "#":
            pos = min((x for x in (s.find("\n", pos), s.find("\r", pos)) if x >= 0), default=n)
        elif c in "([{":
            stack.append(c)
            pos += 1
        elif c == "}" and not stack:
            return pos + 1 if s[begin:pos].strip() else None
        elif c in ")]}":
            if not stack or stack.pop() != PAIRS[c]:
                return None
            pos += 1
        elif c == ":" and not stack:  # the format: text and fields
            pos += 1
            if depth > NESTED:
                return None
            while pos < n and s[pos] != "}":
                if s[pos] == "{":
                    if (end := field_end(s, pos + 1, depth + 1)) is None:
                        return None
                    pos = end
                else:
                    pos += 1
            return pos + 1 if pos < n and s[begin:pos].strip() else None
        elif c.isidentifier():
            while pos < n and (s[pos].isalnum() or s[pos] == "_"):
                pos += 1
        else:
            pos += 1
    return None


def column(space: str) -> tuple[int, int]:
    """The indentation with tabs to every eighth column, and with tabs of one column: both orders must agree."""
    space = space[space.rfind("\f") + 1 :]
    return len(space.expandtabs(8)), len(space)


def fault(s: str) -> tuple[str, int] | None:
    """The first fault of a Python text and where it is, or None."""
    stack: list[list] = []  # [delimiter, position, open lambdas]
    root = ["", 0, 0]
    level = root
    blocks: list[list] = [[(0, 0), ""]]  # [column, the first word of the last line in it]
    pos, n, match = 0, len(s), TOKEN.match
    begins, block, decorated = True, False, False  # a logical line begins; it must be indented; it must be a definition
    margin = 0  # where the physical line begins
    kind, text, first, lead, colon, soft = "", "", "", "", False, False
    while True:
        if pos >= n:
            k, start, t = "nl", n, ""
        else:
            m = match(s, pos)
            k, start, pos, t = m.lastgroup, pos, m.end(), m[0]
        if k == "ws":
            if t[0] == "\\":
                if pos >= n:
                    return "premature end", start
                if begins:
                    margin = pos
            continue
        if k == "com":
            continue
        if k == "nl":
            margin = pos
            if stack and t:
                continue
            if stack:
                return "premature end", n
            if not begins:
                if kind == "op" and (text in NEEDS_RIGHT or text in ("/", "**") or text == "*" and first != "from") or kind == "kw" and text not in LAST and not (first == "else" and text == "else"):
                    return ("missing operand" if t else "premature end"), start
                if first in BLOCKS and not colon:
                    return "missing colon", start
                block = kind == "op" and text == ":"
                if block and first not in BLOCKS and not soft:
                    return "misplaced colon", start
            if not t:
                break
            begins = True
            continue
        if begins:
            begins, at = False, column(s[margin:start])
            if block:
                if not (at[0] > blocks[-1][0][0] and at[1] > blocks[-1][0][1]):
                    return "missing block", start
                blocks.append([at, ""])
            else:
                if at[0] > blocks[-1][0][0]:
                    return "wrong indentation", start
                while at[0] < blocks[-1][0][0]:
                    if blocks.pop()[1] == "try":
                        return "try without except", start
                if at != blocks[-1][0]:
                    return "wrong indentation", start
            block, before = False, blocks[-1][1]
            first = t if k == "id" and t in WORDS else "@" if t == "@" else ""
            if first in AFTER and before not in AFTER[first] or before == "try" and first not in ("except", "finally"):
                return "misplaced word", start
            if decorated and not (first in ("def", "class", "async", "@")):
                return "misplaced word", start
            decorated = first == "@"
            blocks[-1][1] = first
            kind, text, colon, soft = "begin", "", False, k == "id" and t in ("match", "case", "type")
            root[2] = 0
        fresh = kind == "begin"  # a statement begins
        lead = t if fresh else lead
        if k == "fstr":
            end = string_end(s, pos, t.lstrip("fFtTrR"))
            if end is None:
                return "unterminated literal", start
            k, t, pos = "str", "", end
        elif k == "badstr":
            return "unterminated literal", start
        elif k == "bad":
            return "illegal character", start
        elif k == "num":
            if ZEROS.match(t) or pos < n and (s[pos].isalnum() or s[pos] == "_") and not re.compile(r"(?:and|or|if|in|is|else|for|not)\b").match(s, pos):
                return "malformed number", start
        value = kind in ("id", "num", "str", "close")
        operator = kind == "op" and (text in NEEDS_RIGHT or text in ("/", "*", "**"))
        if t == "..." and not (kind == "kw" and text == "from" or kind == "op" and text in (".", "...")):
            k = "num"  # a value, but for the dots of an import
        if k == "id" and t in WORDS and (not (kind == "op" and text == ".") or first == "from" and t == "import"):
            if t in STATEMENTS or t in ("return", "pass"):
                ok = fresh or kind == "kw" and text == "async" and t in ("def", "with")
                ok = ok or t == "from" and (value and lead == "raise" or kind == "kw" and text == "yield") or t == "import" and lead == "from"
                if not ok:
                    return "misplaced word", start
            elif t in INFIX:
                begin = fresh and t in ("if", "for", "else", "not", "async")
                if t == "for":
                    ok = begin or value or kind == "kw" and text == "async"
                elif t == "not":
                    ok = True
                elif t == "in":
                    ok = value or kind == "kw" and text == "not" or kind == "op" and text == ","
                elif t == "async":
                    ok = begin or value or stack
                else:
                    ok = begin or value
                if not ok:
                    return "misplaced word", start
            elif t in VALUES:
                if value and not (soft and text in ("match", "case")):
                    return "tokens that cannot be neighbours", start
            elif value:  # lambda, yield, await
                return "tokens that cannot be neighbours", start
            if t == "lambda":
                level[2] += 1
            if fresh and t == "async":
                blocks[-1][1] = first = "async"
            elif kind == "kw" and text == "async" and first == "async":
                blocks[-1][1] = first = t
            kind, text = ("id" if t in VALUES else "kw"), t
            continue
        if k in ("id", "num", "str"):
            if value and not (k == "str" and kind == "str") and not (soft and text in ("match", "case", "type")):
                return "tokens that cannot be neighbours", start
            if kind == "kw" and text in ("def", "class") and k != "id":
                return "missing name", start
        elif k == "open":
            if t == "{" and value and not (soft and text in ("match", "case")):
                return "tokens that cannot be neighbours", start
            if kind == "kw" and text in ("def", "class"):
                return "missing name", start
            stack.append(level := [t, start, 0])
        elif k == "close":
            if operator and not (text in ("*", "/") and t == ")"):
                return "missing operand", start
            if kind == "kw" and text not in LAST:
                return "missing operand", start
            if not stack or stack.pop()[0] != PAIRS[t]:
                return "unbalanced delimiter", start
            level = stack[-1] if stack else root
        elif k == "op":
            if t == "@" and fresh:
                pass
            elif t == "." and (kind == "kw" and text in ("from", "import") or kind == "op" and text in (".", "...") and first == "from"):
                pass
            elif t == "/" and kind == "op" and text == "," and level[0] == "(" or t == "/" and kind == "op" and level[2]:
                pass  # the mark of positional parameters
            elif t == ":" and (level[0] == "[" or level[2]):
                pass
            elif t in NOT_FIRST and (operator and not (text in ("*", "/") and t in (",", ":")) or fresh and t not in (":",)):
                return "missing operand", start
            elif t in NOT_FIRST and kind == "kw" and not (t == ":" and text in ("else", "try", "except", "finally", "lambda") or t in ",;" and text in LAST):
                return "missing operand", start
            elif t == "," and (kind == "op" and text in (",", ":") and not stack or kind == "open"):
                return "missing operand", start
            if t == ":":
                if level[2]:
                    level[2] -= 1
                elif not stack:
                    if colon and first in BLOCKS:
                        pass  # an annotation in an inline body
                    elif first in BLOCKS:
                        colon, kind, text = True, "op", ":"
                        kind = "op"
                        # What follows on the line is a statement of its own.
                        rest = TOKEN.match(s, pos)
                        while rest and rest.lastgroup == "ws" and rest.end() < n:
                            rest = TOKEN.match(s, rest.end())
                        if rest and rest.lastgroup not in ("nl", "com", "ws"):
                            kind, text = "begin", ""
                        continue
                    elif first and not soft:
                        return "misplaced colon", start
                    elif soft and text not in ("match", "case", "type"):
                        rest = TOKEN.match(s, pos)
                        while rest and rest.lastgroup == "ws" and rest.end() < n:
                            rest = TOKEN.match(s, rest.end())
                        if rest and rest.lastgroup not in ("nl", "com", "ws"):
                            kind, text = "begin", ""
                            continue
            elif t == ";" and not stack:
                kind, text, soft = "begin", "", False
                continue
        kind, text = k, t
    if block or decorated:
        return "premature end", n
    if any(b[1] == "try" for b in blocks):
        return "premature end", n
    return None
