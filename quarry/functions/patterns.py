"""Search patterns: checks, literals, and translation of RE2 syntax to Java's.

Plain Python on the driver; nothing here touches data.
"""

from __future__ import annotations

import re
from itertools import accumulate


class PatternError(ValueError):
    """A pattern that RE2 would reject or that cannot be translated."""


#: Patterns that match everything and are refused.
MATCH_ALL = ("-", ".", "*", ".*")


def is_match_all(pattern: str) -> bool:
    return pattern in MATCH_ALL


def normalize_bre(pattern: str) -> str:
    """Basic-syntax escapes of | ( ) + ? become the operators themselves."""
    return re.sub(r"\\([|()+?])", r"\1", pattern)


_PART = re.compile(r"\\(?P<escaped>.)|(?P<meta>[.+*?^${}\[\]()|\\])|(?P<plain>.)", re.S)


def longest_literal(pattern: str) -> str:
    """The longest run (in bytes) of characters that stand for themselves; the first of equals.
    An escape stands for the character after the backslash."""
    runs = [""]
    for m in _PART.finditer(pattern):
        if m["meta"]:
            runs.append("")
        else:
            runs[-1] += m["escaped"] or m["plain"]
    return max(runs, key=lambda r: len(r.encode()))


def _depths(pattern: str) -> list[int]:
    return list(accumulate((c == "(") - (c == ")") for c in pattern))


def strip_outer_group(pattern: str) -> str:
    """Without the group around the whole pattern, if there is one."""
    if len(pattern) < 2 or not (pattern.startswith("(") and pattern.endswith(")")):
        return pattern
    if 0 in _depths(pattern)[:-1]:
        return pattern
    return re.sub(r"\A(?:\?i?:|\?i)", "", pattern[1:-1])


def split_alternatives(pattern: str) -> list[str]:
    """Branches between the bars that stand in no group."""
    parts, depth = [""], 0
    for c in pattern:
        if c == "|" and depth == 0:
            parts.append("")
            continue
        depth = max(0, depth + (c == "(") - (c == ")"))
        parts[-1] += c
    return parts


def prefilter_literals(pattern: str) -> list[str] | None:
    """One lower-case literal for each branch, or None if a branch has none."""
    found = [longest_literal(b.strip("()")).lower() for b in split_alternatives(strip_outer_group(pattern))]
    return found if all(found) else None


def is_short(pattern: str) -> bool:
    """Whether the pattern's longest literal has one to three bytes and so will match much."""
    return 0 < len(longest_literal(pattern).encode()) <= 3


def near_miss_literal(pattern: str) -> str | None:
    """The literal to look for when a pattern found nothing; None if it would tell nothing new."""
    found = longest_literal(pattern)
    return None if len(found.encode()) < 3 or found == pattern.lstrip("(?i:") else found


_SPACE = r"\t\n\f\r "
_WORD = "(?-i:[0-9A-Za-z_])"
_BOUNDARY = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NO_BOUNDARY = rf"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))"
#: Spelt out, since RE2 folds the case of these ranges like that of others.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_FLAGS = re.compile(r"\?(?P<on>[ims]*)(?P<off>-[ims]+)?(?P<end>[:)])")
_REPEAT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")
MOST_REPEATS = 1000


def to_java(pattern: str) -> str:
    """The Java regex that finds, case-insensitively, what RE2 finds for pattern."""
    return "(?iud)" + _Translator(pattern).run()


class _Translator:
    def __init__(self, pattern: str):
        self.p, self.i, self.out = pattern, 0, []
        self.multiline = bool(re.search(r"\(\?[is]*m", pattern))

    def fail(self, why: str):
        raise PatternError(f"{why} in pattern {self.p!r} at {self.i}")

    def run(self) -> str:
        depth, repeatable = 0, False
        while self.i < len(self.p):
            c = self.p[self.i]
            if c == "\\":
                repeatable = self.escape(False)
            elif c == "[":
                self.char_class()
                repeatable = True
            elif c == "(":
                depth += 1
                depth -= self.group()
                repeatable = False
            elif c == ")":
                depth -= 1
                if depth < 0:
                    self.fail("unexpected )")
                self.put(")")
                repeatable = True
            elif c in "*+?" or (c == "{" and _REPEAT.match(self.p, self.i)):
                if not repeatable:
                    self.fail("missing argument to repetition operator")
                self.repeat()
                repeatable = False
            elif c == "|":
                self.put(c)
                repeatable = False
            elif c == "$":
                self.put("$" if self.multiline else r"\z")
                repeatable = True
            elif c in "{}":
                self.put("\\" + c)
                repeatable = True
            else:
                self.put(c)
                repeatable = True
        if depth:
            self.fail("missing )")
        return "".join(self.out)

    def put(self, what: str, used: int = 1) -> None:
        self.out.append(what)
        self.i += used

    def repeat(self) -> None:
        m = _REPEAT.match(self.p, self.i)
        if m:
            low, high = int(m[1]), int(m[3]) if m[3] else int(m[1])
            if max(low, high) > MOST_REPEATS or high < low:
                self.fail("invalid repeat count")
            self.put(m[0], len(m[0]))
        else:
            self.put(self.p[self.i])
        if self.p[self.i : self.i + 1] == "?":
            self.put("?")
        if self.p[self.i : self.i + 1] in ("*", "+", "?") and self.i < len(self.p) or _REPEAT.match(self.p, self.i):
            self.fail("invalid nested repetition operator")

    def group(self) -> int:
        """Writes the start of a group; 1 if it was flags alone, already closed."""
        rest = self.p[self.i + 1 :]
        if not rest.startswith("?"):
            self.put("(")
            return 0
        named = re.match(r"\?P?<([A-Za-z_]\w*)>", rest)
        if named:
            if "_" in named[1]:
                self.put("(", 1 + len(named[0]))  # Java's names have no underscore, and none is asked for
            else:
                self.put(f"(?<{named[1]}>", 1 + len(named[0]))
            return 0
        flags = _FLAGS.match(rest)
        if not flags or (not flags["on"] and not flags["off"] and flags["end"] == ")"):
            self.fail("invalid or unsupported group")
        self.put("(" + flags[0], 1 + len(flags[0]))
        return int(flags["end"] == ")")

    def escape(self, in_class: bool) -> bool:
        """Writes an escape. True if what it stands for can be repeated."""
        c = self.p[self.i + 1 : self.i + 2]
        if not c:
            self.fail("trailing backslash")
        if c == "Q" and not in_class:
            end = self.p.find(r"\E", self.i + 2)
            text = self.p[self.i + 2 : end if end >= 0 else len(self.p)]
            self.put("".join("\\" + x if not x.isalnum() and x.isascii() else x for x in text), len(text) + (4 if end >= 0 else 2))
            return bool(text)
        if c in "pP":
            m = re.compile(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))").match(self.p, self.i)
            if not m:
                self.fail("invalid character class range")
            name = m[3] or m[4]
            kind = {"p": "P", "P": "p"}[m[1]] if m[2] else m[1]
            self.put(f"\\{kind}{{{name if len(name) <= 2 else 'Is' + name}}}", len(m[0]))
            return True
        if c == "x":
            m = re.compile(r"\\x(?:\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2}))").match(self.p, self.i)
            if not m:
                self.fail("invalid escape sequence")
            self.put(f"\\x{{{m[1] or m[2]}}}", len(m[0]))
            return True
        octal = re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})").match(self.p, self.i)
        if octal:
            self.put(f"\\x{{{int(octal[1], 8):x}}}", len(octal[0]))
            return True
        if c == "s":
            self.put(_SPACE if in_class else f"[{_SPACE}]", 2)
        elif c == "S":
            self.put(f"[^{_SPACE}]", 2)
        elif c == "w":  # spelt out like the named classes
            self.put("0-9A-Za-z_" if in_class else "[0-9A-Za-z_]", 2)
        elif c == "W":
            self.put("[^0-9A-Za-z_]", 2)
        elif c in "bB" and not in_class:
            self.put(_BOUNDARY if c == "b" else _NO_BOUNDARY, 2)
        elif c in "Az" and not in_class:
            self.put("\\" + c, 2)
        elif c == "v":
            self.put(r"\x0B", 2)
        elif c in "dDafnrt":
            self.put("\\" + c, 2)
        elif c.isascii() and c.isalnum():
            self.fail(f"invalid escape sequence \\{c}")
        else:
            self.put("\\" + c if c.isascii() else c, 2)
        return True

    def char_class(self) -> None:
        self.put("[")
        negated = self.p[self.i : self.i + 1] == "^"
        if negated:
            self.put("^")
        first = True
        while True:
            c = self.p[self.i : self.i + 1]
            if not c:
                self.fail("missing ]")
            if c == "]" and not first:
                self.put("]")
                return
            posix = re.compile(r"\[:(\^?)(\w+):\]").match(self.p, self.i)
            if posix:
                if posix[2] not in _POSIX or (posix[1] and negated):
                    self.fail("invalid character class range")
                inner = _POSIX[posix[2]]
                self.put(f"[^{inner}]" if posix[1] else inner, len(posix[0]))
            elif c == "\\":
                self.escape(True)
            elif c in "[&]^~":
                self.put("\\" + c)
            else:
                self.put(c)
            first = False
