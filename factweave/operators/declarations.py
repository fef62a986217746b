"""What a line of Java or Kotlin declares: a type, something callable or a value, read from its tokens.

    line     <- annotation* modifier* (type / function / value)
    type     <- ('class' / 'interface' / 'object' / 'enum' / 'record' / '@interface') name?
    function <- Kotlin: 'fun' angles? receiver? name '('      Java: angles? kind name '(' / name '(' for a constructor
    value    <- Kotlin: ('val' / 'var') name                   Java: kind name ('=' / ';' / ',' / the line's end)
    kind     <- name ('.' name)* angles? ('[' ']')*
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"?|\'(?:\\.|[^\'\\])*\'?|//.*|/\*.*?(?:\*/|$)|@\s*interface\b|@[\w$.:]+|`[^`]+`|[^\W\d][\w$]*|\d\w*|->|::|\S')
_NAME = re.compile(r"(?:[^\W\d][\w$]*|`[^`]+`)\Z")
#: The languages' modifiers, words that begin a type, and other words that are no names of kinds.
MODIFIERS = {
    "JAVA": frozenset("public protected private static final abstract native synchronized default strictfp transient volatile sealed".split()),
    "KOTLIN": frozenset("public protected private internal abstract final open override suspend inline operator sealed data const lateinit infix tailrec external inner enum annotation companion value expect actual noinline crossinline".split()),
}
TYPE_WORDS = frozenset("class interface object enum record @interface".split())
OTHER_WORDS = frozenset("return throw new else case do if while for switch when try catch package import assert break continue goto yield this super instanceof in is as".split())


class Declared(NamedTuple):
    kind: str  # TYPE, FUNCTION or VALUE
    name: str
    words: frozenset[str]  # the modifiers

    def shown(self, visibility: str) -> bool:
        """PUBLIC hides what is declared private or protected, PUBLIC_PROTECTED what is private, ALL nothing."""
        hidden = {"ALL": (), "PUBLIC": ("private", "protected"), "PUBLIC_PROTECTED": ("private",)}[visibility]
        return self.words.isdisjoint(hidden)


def tokens(text: str) -> list[str]:
    """The tokens of a line, comments left out."""
    return [re.sub(r"^@\s+", "@", t) for t in _TOKEN.findall(text) if not t.startswith(("//", "/*"))]


def _past(ts: list[str], i: int, opening: str, closing: str) -> int:
    """The place after the bracket that closes the one at i; the end if none does."""
    depth = 0
    while i < len(ts):
        depth += (ts[i] == opening) - (ts[i] == closing)
        i += 1
        if not depth:
            break
    return i


def _kind(ts: list[str], i: int) -> int:
    """The place after a kind that begins at i, or i."""
    if i >= len(ts) or not _NAME.match(ts[i]) or ts[i] in OTHER_WORDS:
        return i
    j = i + 1
    while j + 1 < len(ts) and ts[j] == "." and _NAME.match(ts[j + 1]):
        j += 2
    if j < len(ts) and ts[j] == "<":
        j = _past(ts, j, "<", ">")
    while j + 1 < len(ts) and ts[j] == "[" and ts[j + 1] == "]":
        j += 2
    return j


def declared(ts: list[str], language: str) -> Declared | None:
    """What tokens declare, None if nothing."""
    kotlin, i, words = language == "KOTLIN", 0, set()
    while i < len(ts):
        if ts[i][0] == "@" and ts[i] != "@interface":
            i += 1
            if i < len(ts) and ts[i] == "(":
                i = _past(ts, i, "(", ")")
        elif ts[i] in MODIFIERS[language]:
            words.add(ts[i])
            i += 1
        else:
            break
    at = lambda k: ts[k] if k < len(ts) else ""
    found = lambda kind, name: Declared(kind, name.strip("`"), frozenset(words))
    if at(i) == "fun" and at(i + 1) == "interface":
        i += 1
    if at(i) in TYPE_WORDS:
        if _NAME.match(at(i + 1)):
            return found("TYPE", at(i + 1))
        return found("TYPE", "Companion") if "companion" in words else None
    if kotlin:
        if at(i) == "constructor" and at(i + 1) == "(":
            return found("FUNCTION", "<init>")
        if at(i) not in ("fun", "val", "var"):
            return None
        kind, i = "FUNCTION" if at(i) == "fun" else "VALUE", i + 1
        if at(i) == "<":
            i = _past(ts, i, "<", ">")
        if at(i) == "(":  # a receiver in brackets
            i = _past(ts, i, "(", ")")
        last = ""
        while i < len(ts):  # receiver parts up to the name
            if _NAME.match(ts[i]):
                last = ts[i]
            elif ts[i] == "<":
                i = _past(ts, i, "<", ">") - 1
            elif ts[i] not in (".", "?"):
                break
            i += 1
        return found(kind, last) if last and (kind == "VALUE" or at(i) == "(") else None
    if at(i) == "<":
        i = _past(ts, i, "<", ">")
    j = _kind(ts, i)
    if j == i:
        return None
    if _NAME.match(at(j)) and at(j) not in OTHER_WORDS:
        if at(j + 1) == "(":
            return found("FUNCTION", at(j))
        return found("VALUE", at(j)) if at(j + 1) in ("=", ";", ",", "") else None
    if j == i + 1 and at(j) == "(" and (words or ts[-1] == "{"):
        return found("FUNCTION", at(i))
    return None


def parameter_kinds(ts: list[str], name: str, language: str) -> tuple[str, ...] | None:
    """The kinds of the parameters after the name, each without arguments and qualifiers; None without brackets."""
    i = next((i for i in range(len(ts) - 1) if ts[i].strip("`") == name and ts[i + 1] == "("), None)
    if i is None:
        return None
    inside = ts[i + 2 : _past(ts, i + 1, "(", ")") - 1]
    parts, depth = [[]], 0
    for t in inside:
        depth += (t in "<([{") - (t in ">)]}")
        if t == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    out = []
    for p in parts:
        p = [t for t in p if t[0] != "@" and t not in ("final", "vararg", "noinline", "crossinline")]
        if p:
            p = p[p.index(":") + 1 :] if language == "KOTLIN" and ":" in p else p[:-1] if len(p) > 1 else p
            out.append(simple_kind("".join(p)))
    return tuple(out)


def simple_kind(text: str) -> str:
    """A kind without arguments, default value and qualifiers: `java.util.List<A>[]` is `List[]`."""
    text = text.split("=")[0].replace("...", "[]")
    while (now := re.sub(r"<[^<>]*>", "", text)) != text:
        text = now
    return re.sub(r"[\w$]+\.", "", text).rstrip("?").strip()
