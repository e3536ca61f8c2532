"""Search patterns as users of Python's ``re`` write them, for the engine that runs them here.

Most constructs mean the same in both. Classes such as ``\\w`` are written out, because they cover other characters there;
named groups, the end anchors, literal brackets and braces and the ways to write a character are put in their other form. What
has no counterpart is refused rather than searched for in another meaning.
"""

from __future__ import annotations

import re
import warnings

from postmill.functions.text import SPACE, WORD

_CLASSES = {"w": WORD, "s": SPACE, "d": r"\p{Nd}"}
_EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_NO_EDGE = rf"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
_CONTROLS = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
_REPEAT = re.compile(r"\{([0-9]*)(,?)([0-9]*)\}")
_GROUP_NAME = re.compile(r"[^\W\d]\w*")


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at, self.names, self.groups = pattern, 0, {}, 0

    def fail(self, why: str) -> ValueError:
        return ValueError(f"{why} at {self.at} in pattern: {self.text}")

    def take(self, n: int = 1) -> str:
        got = self.text[self.at : self.at + n]
        if len(got) < n:
            raise self.fail("unexpected end")
        self.at += n
        return got

    def until(self, end: str) -> str:
        stop = self.text.find(end, self.at)
        if stop < 0:
            raise self.fail(f"missing {end}")
        got, self.at = self.text[self.at : stop], stop + len(end)
        return got

    def code(self, letter: str, inside: bool) -> str | None:
        """The character that an escape stands for, as ``\\x{...}``; None if it stands for none."""
        if letter in "xuU":
            digits = self.take({"x": 2, "u": 4, "U": 8}[letter])
            if not re.fullmatch("[0-9a-fA-F]+", digits) or int(digits, 16) > 0x10FFFF:
                raise self.fail("bad escape")
            return rf"\x{{{int(digits, 16):x}}}"
        if letter in _CONTROLS and (inside or letter != "b"):
            return rf"\x{{{_CONTROLS[letter]:x}}}"
        if letter == "0" or inside and letter.isdigit() or re.match("[0-3][0-7]{2}", letter + self.text[self.at : self.at + 2]):
            more = re.match("[0-7]{0,2}", self.text[self.at :])[0]
            self.at += len(more)
            if not re.fullmatch("[0-7]+", letter + more) or int(letter + more, 8) > 0o377:
                raise self.fail("bad escape")
            return rf"\x{{{int(letter + more, 8):x}}}"
        return None

    def escape(self) -> str:
        letter = self.take()
        if code := self.code(letter, False):
            return code
        if letter in _CLASSES:
            return f"[{_CLASSES[letter]}]"
        if letter.lower() in _CLASSES:
            return f"[^{_CLASSES[letter.lower()]}]"
        if letter in "bBAZ":
            return {"b": _EDGE, "B": _NO_EDGE, "A": r"\A", "Z": r"\z"}[letter]
        if letter.isdigit():
            if self.text[self.at : self.at + 1].isdigit():
                letter += self.take()
            if int(letter) > self.groups:
                raise self.fail("unknown group")
            return rf"(?:\{letter})"
        if letter.isascii() and letter.isalpha():
            raise self.fail(f"no counterpart for \\{letter}")
        return "\\" + letter if letter.isascii() else letter

    def character_class(self) -> str:
        negated = self.text.startswith("^", self.at)
        self.at += negated
        parts, unions, first, low = [], [], True, None
        while True:
            c = self.take()
            if c == "]" and not first:
                break
            first, single = False, None
            if c == "\\":
                letter = self.take()
                single = self.code(letter, True)
                if single is None and letter in _CLASSES:
                    parts.append(_CLASSES[letter])
                elif single is None and letter.lower() in _CLASSES:
                    unions.append(f"[^{_CLASSES[letter.lower()]}]")
                elif single is None and letter.isascii() and letter.isalpha():
                    raise self.fail(f"no counterpart for \\{letter} in a class")
                single = single or (None if letter.lower() in _CLASSES else rf"\x{{{ord(letter):x}}}")
            elif c == "-" and low is not None and not self.text.startswith("]", self.at):
                start, low = low, None
                c = self.take()
                end = self.code(letter := self.take(), True) or rf"\x{{{ord(letter):x}}}" if c == "\\" else rf"\x{{{ord(c):x}}}"
                if c == "\\" and letter.lower() in _CLASSES or int(start[3:-1], 16) > int(end[3:-1], 16):
                    raise self.fail("bad range")
                parts[-1] = f"{start}-{end}"
                continue
            else:
                single = rf"\x{{{ord(c):x}}}"
            if single:
                parts.append(single)
            low = single
        inner = "".join(parts) + "".join(unions)
        # What a negated union of classes means there is not what it means here.
        return rf"(?:(?![{inner}])[\s\S])" if negated and unions else f"[{'^' if negated else ''}{inner}]"

    def group(self) -> str:
        if not self.text.startswith("?", self.at):
            self.groups += 1
            return "("
        self.at += 1
        if self.text.startswith("P", self.at):
            self.at += 1
            kind = self.take()
            if kind == "<":
                name = self.until(">")
                if not _GROUP_NAME.fullmatch(name) or name in self.names:
                    raise self.fail("bad group name")
                self.groups += 1
                self.names[name] = f"g{self.groups}"
                return f"(?<{self.names[name]}>"
            if kind == "=":
                name = self.until(")")
                if name not in self.names:
                    raise self.fail("unknown group")
                return rf"\k<{self.names[name]}>"
            raise self.fail("bad group")
        if self.text.startswith("#", self.at):
            self.until(")")
            return ""
        for opening in ("<=", "<!", ":", "=", "!", ">"):
            if self.text.startswith(opening, self.at):
                self.at += len(opening)
                return f"(?{opening}"
        flags = re.match(r"([a-zA-Z]*)(-[a-zA-Z]+)?([:)])", self.text[self.at :])
        if not flags or flags[2] and flags[3] == ")" or flags[3] == ")" and self.at != 2:
            raise self.fail("no counterpart for this group")
        letters = flags[1] + (flags[2] or "")
        if not flags[1] + (flags[2] or "") or set(letters) - set("imsu-"):
            raise self.fail("no counterpart for these flags")
        self.at += len(flags[0])
        if "i" in letters:
            letters = letters.replace("u", "").replace("i", "iu", 1)
        else:
            letters = letters.replace("u", "")
        return f"(?{letters}{flags[3]}" if letters else "(?:" if flags[3] == ":" else ""

    def read(self) -> str:
        out = []
        while self.at < len(self.text):
            c = self.take()
            if c == "\\":
                out.append(self.escape())
            elif c == "[":
                out.append(self.character_class())
            elif c == "(":
                out.append(self.group())
            elif c == "{":
                repeat = _REPEAT.match(self.text, self.at - 1)
                if repeat and (repeat[1] or repeat[3] and repeat[2]):
                    self.at = repeat.end()
                    out.append(f"{{{repeat[1] or '0'}{repeat[2]}{repeat[3]}}}")
                else:
                    out.append(r"\{")
            elif c in "}]#":
                out.append("\\" + c)
            else:
                out.append(c)
        return "".join(out)


def translated(pattern: str) -> str:
    """A pattern in the syntax of Python's ``re`` as one for ``rlike`` under the flags ``d`` and, where used, ``iu``.

    Raises ``ValueError`` for a pattern that ``re`` does not take, and for the few constructs without a counterpart:
    conditional groups, character names, verbose and ASCII flags.
    """
    try:
        with warnings.catch_warnings():  # of what a later version may read otherwise
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(pattern)
    except re.error as error:
        raise ValueError(f"invalid pattern: {pattern}: {error}") from error
    return _Reader(pattern).read()
