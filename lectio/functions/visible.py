"""What a reader of rendered markdown sees of a text.

A scanner passes over the text and asks, at each character that can begin one, which construct begins there and where it
ends: first comments and elements that aren't prose, then link definitions and tags, and, once character references are
read and invisible characters gone, links and images without a text. Constructs are those of CommonMark; a link's
destination and a tag end at their first closing bracket, quoted or not. A character reference has its semicolon: what
HTML reads without one (&amp, &copy) is text.
"""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where a construct that begins at a place of a text ends; None if none does.
Rule = Callable[[str, int], int | None]
#: Elements whose content isn't prose.
UNREAD = ("script", "style", "template")
BLANK = " \t"
TITLES = {'"': '"', "'": "'", "(": ")"}
#: A character reference, if its name is known.
REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[Xx][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]*));")


def _skipping(text: str, begins: str, *rules: Rule) -> str:
    """text without the constructs of the rules, which begin with one of the characters."""
    out, at = [], 0
    while at < len(text):
        here = min((i for i in (text.find(c, at) for c in begins) if i >= 0), default=len(text))
        end = next((e for rule in rules if (e := rule(text, here)) is not None), here + 1) if here < len(text) else here
        out.append(text[at:here] if end > here + 1 or here == len(text) else text[at:end])
        at = end
    return "".join(out)


def _past(text: str, at: int, chars: str) -> int:
    """The first place from at on that has none of the characters."""
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def _until(text: str, at: int, *closings: str) -> int | None:
    """The place after the first of the closings."""
    found = [i + len(c) for c in closings if (i := text.find(c, at)) >= 0]
    return min(found, default=None)


def _comment(text: str, at: int) -> int | None:
    """An open comment runs to the end of the text."""
    return (_until(text, at + 4, "-->") or len(text)) if text.startswith("<!--", at) else None


def _unread(text: str, at: int) -> int | None:
    """An element of UNREAD with all that is in it; an open one runs to the end of the text."""
    name = next((n for n in UNREAD if text[at + 1 : at + 1 + len(n)].lower() == n), None)
    after = at + 1 + len(name or "")
    if name is None or text[after : after + 1].isalnum() or text[after : after + 1] == "_":
        return None
    inside = _until(text, after, ">")
    while inside is not None:
        close = text.find("</", inside)
        if close < 0:
            return len(text)
        inside = close + 2
        if text[inside : inside + len(name)].lower() == name:
            end = inside + len(name)
            while text[end : end + 1].isspace():
                end += 1
            if text.startswith(">", end):
                return end + 1
    return None


def _tag(text: str, at: int) -> int | None:
    """A tag has a letter after its bracket; its name ends at white space, a slash or its end."""
    i = at + 1 + text.startswith("/", at + 1)
    if not (text[i : i + 1].isascii() and text[i : i + 1].isalpha()):
        return None
    while text[i : i + 1].isascii() and (text[i : i + 1].isalnum() or text[i : i + 1] == "-"):
        i += 1
    if text[i : i + 1].isspace():
        end = min((k for k in (text.find("<", i), text.find(">", i)) if k >= 0), default=-1)
        return end + 1 if end >= 0 and text[end] == ">" else None
    i += text.startswith("/", i)
    return i + 1 if text.startswith(">", i) else None


def _line_end(text: str, at: int) -> int:
    return end if (end := text.find("\n", at)) >= 0 else len(text)


def _title(text: str, at: int) -> int | None:
    """The end of the line that a title at this place has for itself."""
    if text[at : at + 1] not in TITLES or not text[at : at + 1]:
        return None
    end = _until(text, at + 1, TITLES[text[at]])
    if end is None:
        return None
    rest = _past(text, end, BLANK)
    return rest if rest == _line_end(text, rest) else None


def _definition(text: str, at: int) -> int | None:
    """A link's label, destination and title, for use elsewhere; the title may have the next line, indented."""
    begin = text.rfind("\n", 0, at) + 1
    label = text.find("]", at)
    if text[at] != "[" or at - begin > 3 or text[begin:at].strip(" ") or label <= at + 1 or not text.startswith(":", label + 1):
        return None
    there = _past(text, label + 2, BLANK)
    ends = []
    if text.startswith("<", there) and (close := text.find(">", there)) >= 0 and not any(c in text[there + 1 : close] for c in "<\n"):
        ends.append(close + 1)
    plain = there
    while plain < len(text) and not text[plain].isspace():
        plain += 1
    for dest in [*ends, *([plain] if plain > there else [])]:
        rest = _past(text, dest, BLANK)
        if (end := _title(text, rest)) is not None:
            return end
        if rest == _line_end(text, rest):
            below = _past(text, rest + 1, BLANK)
            return end if below > rest + 1 and (end := _title(text, below)) is not None else rest
    return None


def _empty_link(text: str, at: int) -> int | None:
    """A link or image without a text, with its destination or the label of one."""
    opened = at + text.startswith("!", at)
    if not text.startswith("[", opened):
        return None
    closed = _past(text, opened + 1, BLANK)
    if text[closed : closed + 2] not in ("](", "]["):
        return None
    return _until(text, closed + 2, ")" if text[closed + 1] == "(" else "]")


class _Seen(dict):
    """What is seen of a character: white space of any kind as a space, nothing of marks without a width, formats and controls."""

    def __missing__(self, code: int) -> str | None:
        kind = unicodedata.category(chr(code))
        layout = chr(code) in "\t\n\r"
        self[code] = " " if kind == "Zs" else None if kind in ("Cf", "Mn") or kind == "Cc" and not layout else chr(code)
        return self[code]


_SEEN = _Seen()


def _referred(found: re.Match) -> str:
    """The characters that a reference stands for; an unknown name stays as it is."""
    return html.unescape(found[0]) if found[1] is None else html.entities.html5.get(f"{found[1]};", found[0])


def seen(markdown: str) -> str:
    """What a reader sees of a text; only ever less of it, and character references read."""
    s = _skipping(markdown, "<", _comment, _unread)
    s = _skipping(s, "<[", _definition_or_tag)
    return _skipping(REFERENCE.sub(_referred, s).translate(_SEEN), "![", _empty_link)


def _definition_or_tag(text: str, at: int) -> int | None:
    return _definition(text, at) if text[at] == "[" else _tag(text, at)


@F.pandas_udf(T.StringType())
def visible_text(markdown: pd.Series) -> pd.Series:
    return markdown.map(lambda x: None if x is None else seen(x))
