"""One large JSON object read as a stream: members of one of its lists, one at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

# Up to the next bracket outside strings; without a match the text ends before it, or within a string.
_BRACKET = re.compile(r'(?:[^"{}\[\]]++|"(?:[^"\\]++|\\.)*+")*+[{}\[\]]', re.S)
_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.S)
_SCALAR = re.compile(r"[^\s,:\]}\[{\"]++")
_SPACE = re.compile(r"[ \t\r\n]*+")


class _Text:
    """Text that arrives in chunks; what was read is let go with the next chunk."""

    def __init__(self, chunks: Iterator[str]) -> None:
        self.chunks, self.text, self.at = chunks, "", 0

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.text, self.at = self.text[self.at :] + chunk, 0
        return True

    def peek(self) -> str:
        """The next character that is no space, or nothing at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def skip(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"this is not valid JSON: {wanted} is missing")
        self.at += 1

    def _next(self, pattern: re.Pattern, open_end: bool = False) -> str:
        while True:
            found = pattern.match(self.text, self.at)
            if found and not (open_end and found.end() == len(self.text)):
                break
            if not self.more():
                if found:
                    break
                raise ValueError("this is not valid JSON: it ends within a value")
        out = found.group()
        self.at = found.end()
        return out

    def value(self) -> str:
        """The next value as it is written."""
        first = self.peek()
        if first == '"':
            return self._next(_STRING)
        if first not in ("{", "["):
            if not first or first in ",:]}":
                raise ValueError("this is not valid JSON: a value is missing")
            return self._next(_SCALAR, open_end=True)
        parts: list[str] = []
        depth = 0
        while True:
            parts.append(self._next(_BRACKET))
            depth += 1 if parts[-1][-1] in "{[" else -1
            if not depth:
                return "".join(parts)

    def after(self, end: str) -> bool:
        """Whether a comma leads to another member, not ``end`` to none."""
        if self.peek() == ",":
            self.at += 1
            return True
        self.skip(end)
        return False


def members(chunks: Iterator[str], of: str, require: dict[str, str]) -> Iterator[str]:
    """The members of the list ``of`` in a JSON object that comes in ``chunks``, as they are written.

    Only a chunk and a member are held at once. A field of ``require`` that is there, and not
    null, must have the text given there; other fields are ignored. Cut or malformed text is
    an error.
    """
    text = _Text(chunks)
    text.skip("{")
    going = text.peek() != "}"
    if not going:
        text.skip("}")
    while going:
        name = json.loads(text.value())
        text.skip(":")
        if name == of and text.peek() == "[":
            text.skip("[")
            inside = text.peek() != "]"
            if not inside:
                text.skip("]")
            while inside:
                yield text.value()
                inside = text.after("]")
        else:
            written = text.value()
            value = json.loads(written) if written[0] == '"' else written
            if name in require and value not in (require[name], "null"):
                raise ValueError(f"unsupported {name}")
        going = text.after("}")
    if text.peek():
        raise ValueError("this is not valid JSON: text follows the object")
