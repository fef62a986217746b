"""Functions paired with their documentation comments.

A packrat parsing-expression grammar per language works on the source text itself, so every match is a pair of
offsets. Its terminals are regular expressions; sequences, ordered choices and repetitions combine them, and each
rule remembers its outcome at each place, so no text is parsed twice. Semantic actions of the rule for a function
emit (documentation, name, function) offsets; whether the description says anything is decided afterwards.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that say nothing in a description.
EMPTY_WORDS = frozenset("a an the this that of to for in on and or is it its by with todo fixme tbd".split())

Parse = Callable[["Text", int], "tuple[int, tuple] | None"]


class Text:
    """A text and what each rule gave at each place of it."""

    def __init__(self, s: str) -> None:
        self.s, self.memo = s, {}


def tok(pattern: str, name: str | None = None) -> Parse:
    """A terminal; with a name its offsets are emitted."""
    match = re.compile(pattern).match

    def parse(t: Text, at: int):
        m = match(t.s, at)
        return m and (m.end(), ((name, at, m.end()),) if name else ())

    return parse


def seq(*parts: Parse) -> Parse:
    def parse(t: Text, at: int):
        out: tuple = ()
        for p in parts:
            r = p(t, at)
            if r is None:
                return None
            at = r[0]
            if r[1]:
                out += r[1]
        return at, out

    return parse


def alt(*parts: Parse) -> Parse:
    def parse(t: Text, at: int):
        for p in parts:
            r = p(t, at)
            if r is not None:
                return r
        return None

    return parse


def many(part: Parse) -> Parse:
    def parse(t: Text, at: int):
        out = []
        while (r := part(t, at)) is not None and r[0] > at:
            at = r[0]
            out += r[1]
        return at, tuple(out)

    return parse


def opt(part: Parse) -> Parse:
    return lambda t, at: part(t, at) or (at, ())


def without(part: Parse) -> Parse:
    """Succeeds, taking nothing, where the part fails."""
    return lambda t, at: (at, ()) if part(t, at) is None else None


def rule(part: Parse, action: Callable[[tuple, int, int], tuple] | None = None) -> Parse:
    """A rule that remembers its outcomes; the action turns what its parts emitted into what it emits."""
    key = object()

    def parse(t: Text, at: int):
        k = (key, at)
        if k not in t.memo:
            r = part(t, at)
            t.memo[k] = (r[0], action(r[1], at, r[0])) if r and action else r
        return t.memo[k]

    return parse


def later(of: Callable[[], Parse]) -> Parse:
    return lambda t, at: of()(t, at)


def silent(part: Parse) -> Parse:
    def parse(t: Text, at: int):
        r = part(t, at)
        return r and (r[0], ())

    return parse


def bracketed(open_: str, close: str, quoted: str, special: Callable[[Text, int], int] | None = None) -> Parse:
    """A terminal: from an opening bracket to the closing one, past quoted text and comments. Without a closing one
    it takes the rest. `special` reads what the pattern of quoted text can't."""
    o, c = re.escape(open_), re.escape(close)
    step = re.compile(rf"""[^{o}{c}"'/]*+(?:({quoted})|[{o}{c}"'/])""").match

    def parse(t: Text, at: int):
        s = t.s
        if not s.startswith(open_, at):
            return None
        depth, i = 0, at
        while m := step(s, i):
            i = m.end()
            if m.lastindex:
                continue
            g = s[i - 1]
            if g == open_:
                depth += 1
            elif g == close:
                depth -= 1
                if not depth:
                    return i, ()
            elif special and (g == '"' or s.startswith("/*", i - 1)):
                i = special(t, i - 1)
        return len(t.s), ()

    return rule(parse)


def _function(values: tuple, start: int, end: int) -> tuple:
    """The action of a documented declaration: the last documentation before the name, the name, the whole."""
    doc = next((v for v in reversed(values) if v[0] == "doc"), None)
    name = next(v for v in values if v[0] == "name")
    return (("pair", doc and doc[1:], name[1:], (next((v[1] for v in values if v[0] == "head"), start), end)),)


def _inner(values: tuple, start: int, end: int) -> tuple:
    return tuple(v for v in values if v[0] == "pair")


_STRING, _CHAR, _LINE = r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'", r"//[^\n]*+"
_COMMENT = r"/\*(?s:.*?)(?:\*/|\Z)"
_DOC = r"/\*\*(?!/)(?s:.*?)\*/"
_WS = r"[\s\ufeff]++"
_HEAD = tok("", "head")


def java() -> dict[str, Parse]:
    """File <- Member*;  Member <- Prefix (Type / Function / Other);  Type <- Keyword Name Header '{' Constants? Member* '}'
    Function <- TypeArgs? Type Name Parens Throws? Block;  Other <- Parens / Block / Quoted / any up to ';'"""
    quoted = rf'"""(?s:(?:[^"\\]|\\.|"(?!""))*+)"""|{_STRING}|{_CHAR}|{_LINE}|{_COMMENT}'
    gap = tok(rf"(?:{_WS}|{_LINE}|/\*(?!\*(?!/))(?s:.*?)(?:\*/|\Z))*+")
    any_gap = tok(rf"(?:{_WS}|{_LINE}|{_COMMENT})*+")
    block, parens = bracketed("{", "}", quoted), bracketed("(", ")", quoted)
    ident = r"[^\W\d][\w$]*+"
    annotation = seq(tok(rf"@(?!interface\b)\s*+{ident}(?:\s*+\.\s*+{ident})*+"), opt(seq(tok(r"\s*+"), parens)))
    modifier = tok(r"(?:(?:public|protected|private|static|final|abstract|native|synchronized|default|strictfp|transient|volatile|sealed|non-sealed)\b\s*+(?![(:=]))++", "head")
    plain_gap = tok(rf"(?:{_WS}|{_LINE}|/\*(?!\*(?!/))(?s:.*?)(?:\*/|\Z))++")
    prefix = many(alt(plain_gap, tok(_DOC, "doc"), modifier, seq(_HEAD, annotation), tok(_COMMENT)))
    angles = bracketed("<", ">", quoted)
    type_ = seq(tok(rf"{ident}(?:\s*+\.\s*+{ident})*+"), any_gap, opt(seq(angles, any_gap)), tok(r"(?:\.[\w$]++\s*+)*+(?:(?:@\w++\s*+)?\[\s*+\]\s*+)*+"), any_gap)
    function = seq(_HEAD, opt(seq(angles, any_gap)), type_, tok(ident, "name"), any_gap, parens, any_gap, tok(r"(?:\[\s*+\]\s*+)*+"), opt(seq(tok(r"throws\b"), tok(rf"(?:[^{{;/]|{_LINE}|{_COMMENT})*+"))), any_gap, block)
    header = many(alt(tok(rf"(?:[^{{}};(\"'/]|{_LINE}|{_COMMENT})++"), parens))
    constants = many(alt(tok(quoted), parens, block, tok(r"[^{}()\"'/;]++|/")))
    body = seq(many(later(lambda: member)), any_gap, opt(tok(r"\}")))
    enum = seq(tok(r"enum\b"), any_gap, tok(ident), header, tok(r"\{"), constants, opt(tok(";")), body)
    other_type = seq(tok(r"(?:class|interface|record|@\s*+interface)\b"), any_gap, tok(ident), header, tok(r"\{"), body)
    one = alt(tok(r";"), block, tok(r"[)\]]"))
    piece = alt(parens, tok(rf'"""(?s:(?:[^"\\]|\\.|"(?!""))*+)"""|{_STRING}|{_CHAR}|{_LINE}|/\*(?!\*(?!/))(?s:.*?)(?:\*/|\Z)'), tok(r"[^;{}()\"'/=]++"), tok(r"[\"'/](?!\*\*)"))
    before, piece = piece, alt(piece, tok("="))
    constructor = seq(opt(seq(angles, any_gap)), tok(ident), any_gap, parens, any_gap, opt(seq(tok(r"throws\b"), tok(r"[^{;]*+"))), block)
    value = seq(tok("="), many(alt(piece, block)), opt(tok(";")))
    other = alt(constructor, seq(many(before), opt(alt(one, value))))
    documented = rule(seq(prefix, function), _function)
    undone = seq(prefix, without(tok(r"\}|\Z")), alt(enum, other_type, other))
    member = rule(alt(documented, rule(undone, _inner)))
    stray = tok(r"(?s:.)")
    return {"file": seq(many(alt(member, seq(gap, stray))), any_gap), "function": documented, "quoted": tok(quoted)}


def kotlin() -> dict[str, Parse]:
    """File <- Member*;  Member <- Prefix (Type / Function / Other);  Type <- Keyword Name? Parens? Supers? ('{' Member* '}')?
    Function <- 'fun' TypeArgs? Receiver? Name Parens (':' Type)? (Block / '=' Line);  Other <- any up to the line's end"""
    simple = r'"(?:[^"\\\n$]|\\.|\$(?!\{))*+"'
    raw = r'"""(?s:(?:[^"$]|\$(?!\{)|"(?!""))*+)"""(?:"(?!"))*+'
    flat = r"/\*(?:(?!/\*|\*/)(?s:.))*+\*/"

    def special(t: Text, at: int) -> int:
        """The end of a string with templates, or of comments within comments; both may hold each other."""
        s = t.s
        if s.startswith("/*", at):
            depth, i = 0, at
            while m := nested(s, i):
                depth += 1 if m.group() == "/*" else -1
                i = m.end()
                if not depth:
                    return i
            return len(s)
        triple = s.startswith('"""', at)
        i, stop = at + (3 if triple else 1), in_raw if triple else in_string
        while m := stop(s, i):
            g, i = m.group(), m.end()
            if g == "${":
                i = block(t, i - 1)[0]
            elif g[0] == '"':
                return i
            elif g == "\n":
                return at + 1  # no string after all
        return len(s) if triple else at + 1

    nested = re.compile(r"/\*|\*/").search
    in_raw, in_string = re.compile(r'"{3,}|\$\{').search, re.compile(r'\\.|"|\$\{|\n').search
    quoted = rf"{raw}|(?!\"\"\"){simple}|{_CHAR}|{_LINE}|{flat}"
    block, parens, angles, square = (bracketed(o, c, quoted, special) for o, c in ("{}", "()", "<>", "[]"))

    def skip(t: Text, at: int):
        """Quoted text that needs more than a pattern."""
        if t.s.startswith(('"', "/*"), at):
            end = special(t, at)
            return (end, ()) if end > at + 1 else None
        return None

    def comment(t: Text, at: int):
        return skip(t, at) if t.s.startswith("/*", at) else None

    plain_gap = tok(rf"(?:{_WS}|{_LINE}|(?!/\*\*(?!/)){flat})++")
    comments = alt(plain_gap, comment)
    gap = many(comments)
    ident = r"(?:[^\W\d][\w$]*+|`[^`\n]++`)"
    annotation = seq(tok(rf"@(?:(?:file|field|get|set|param|property|receiver|delegate|setparam):)?(?:{ident}(?:\.{ident})*+)?"), opt(alt(parens, square)))
    modifier = tok(r"(?:(?:public|private|protected|internal|override|suspend|inline|operator|open|sealed|data|abstract|final|const|lateinit|infix|tailrec|external|inner|annotation|companion|value|expect|actual|noinline|crossinline)\b\s*+(?![(:=.]))++", "head")
    doc = rule(lambda t, at: (r := comment(t, at)) and doc_start(t.s, at) and t.s.endswith("*/", at, r[0]) and (r[0], (("doc", at, r[0]),)) or None)
    doc_start = re.compile(r"/\*\*(?!/)").match
    prefix = many(alt(plain_gap, modifier, doc, seq(_HEAD, annotation), comment))
    type_ = seq(tok(r"(?:suspend\s++|in\s++|out\s++)?+"), alt(parens, seq(tok(rf"{ident}"), opt(seq(tok(r"[ \t]*+"), angles)), many(seq(tok(rf"\.{ident}"), opt(angles))))), tok(r"\?*+"), opt(seq(gap, tok(r"->"), gap, later(lambda: type_))))
    receiver = seq(alt(seq(parens, tok(r"\?*+\.")), seq(tok(ident), opt(angles), tok(r"\?*+\."))))
    line = many(alt(parens, block, square, tok(rf"{raw}|(?!\"\"\"){simple}|{_CHAR}|{_LINE}"), seq(without(doc), skip), tok(r"[^\n;{}()\[\]\"'/]++"), seq(without(doc), tok(r"[\"'/]"))))
    where = opt(seq(gap, tok(r"where\b[^{=\n]*+")))
    function = seq(_HEAD, tok(r"fun\b"), gap, opt(seq(angles, gap)), many(receiver), tok(ident, "name"), gap, parens, opt(seq(gap, tok(":"), gap, type_)), where, gap, alt(block, seq(tok(r"="), tok(r"\s*+"), line)))
    one_super = seq(type_, opt(seq(tok(r"[ \t]*+"), parens)), opt(seq(gap, tok(r"by\b[^,{\n]*+"))))
    supers = opt(seq(gap, tok(":"), gap, one_super, many(seq(gap, tok(","), gap, one_super))))
    primary = opt(seq(many(alt(comments, annotation, modifier, tok(r"constructor\b"))), parens))
    body = seq(many(later(lambda: member)), gap, opt(tok(r"\}")))
    entries = opt(seq(many(seq(many(alt(doc, comments, annotation)), without(modifier), without(tok(r"(?:fun|val|var|class|interface|object|init|constructor|enum\s++class)\b")), tok(ident), gap, opt(parens), gap, opt(block), gap, opt(tok(",")))), gap, opt(tok(";"))))
    head = seq(opt(seq(gap, tok(ident))), opt(seq(gap, angles)), primary, supers, where)
    enum = seq(tok(r"enum\b"), many(alt(comments, annotation, modifier)), tok(r"class\b"), head, gap, tok(r"\{"), silent(entries), body)
    other_type = seq(tok(r"(?:fun\s++)?(?:class|interface|object)\b"), head, opt(seq(gap, tok(r"\{"), body)))
    documented = rule(seq(prefix, function), _function)
    undone = seq(prefix, without(tok(r"\}|\Z")), alt(enum, other_type, seq(line, opt(tok(r"[\n;)\]]")))))
    member = rule(alt(documented, rule(undone, _inner)))
    stray = tok(r"(?s:.)")
    return {"file": seq(many(alt(member, seq(gap, stray))), gap), "function": documented, "quoted": alt(tok(quoted), skip)}


_GRAMMARS: dict[str, dict[str, Parse]] = {}


def grammar(language: str) -> dict[str, Parse]:
    if language not in _GRAMMARS:
        _GRAMMARS[language] = {"JAVA": java, "KOTLIN": kotlin}[language]()
    return _GRAMMARS[language]


_unspoken = re.compile(rf'"""(?s:.*?)"""|{_STRING}|{_CHAR}|{_LINE}|{_COMMENT}').sub


def language_of(path: str | None, language: str | None, text: str) -> str:
    """By the path's ending, else what the text looks like: a Kotlin file has `fun name(` or no `;` at line ends."""
    for part in reversed((path or "").lower().split(".")[1:]):
        if part in ("kt", "kts"):
            return "KOTLIN"
        if part == "java":
            return "JAVA"
    text = _unspoken(" ", text)
    if re.search(r"(?:^|[\s)}])fun\s+[\w<`(]", text):
        return "KOTLIN"
    if re.search(r"[;{][ \t]*$", text, re.M) and re.search(r";[ \t]*$", text, re.M):
        return "JAVA"
    return "KOTLIN" if (language or "").strip().upper() == "KOTLIN" else "JAVA"


def description(doc: str) -> str:
    """A documentation comment's text before the first block tag, without marks, inline tags and HTML tags."""
    inner = doc[3:-2].lstrip("*").rstrip("*")
    lines = []
    for x in inner.split("\n"):
        x = re.sub(r"^\s*\*+", "", x).strip()
        if x.startswith("@"):
            break
        lines.append(x)
    return re.sub(r"<[^<>]*>", " ", re.sub(r"\{@[^{}]*\}", " ", "\n".join(lines))).strip()


def is_informative(text: str, name: str, least: int = 3) -> bool:
    """Whether a description has `least` different words besides those of the function's name and empty ones."""
    own = {w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(r"(?=[A-Z])", " ", name))}
    return len({w.lower() for w in re.findall(r"[^\W\d_]+", text)} - own - EMPTY_WORDS) >= least


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _parsed(parse: Parse, text: str, at: int):
    """What the rule gives at a place. Every level of nesting takes a character at least, and some calls; calls between
    Python functions need no stack but the heap's, so texts may be nested as deeply as they are long."""
    deepest = 10_000 + 60 * len(text)
    if sys.getrecursionlimit() < deepest:
        sys.setrecursionlimit(deepest)
    return parse(Text(text), at)


def file_pairs(text: str, language: str) -> list[tuple[int, str, str, str]]:
    """(line of the name, name, function's code, description) of every documented function of a file, however deeply
    its types are nested."""
    s, out, line, counted = _lines(text), [], 1, 0
    for _, doc, (a, b), (c, d) in sorted(_parsed(grammar(language)["file"], s, 0)[1], key=lambda found: found[2]):
        if doc:
            name, said = s[a:b].strip("`"), description(s[doc[0] : doc[1]])
            if is_informative(said, name):
                line, counted = line + s.count("\n", counted, a), a
                out.append((line, name, s[c:d], said))
    return out


_BEFORE = re.compile(rf'"""(?s:(?:[^"\\]|\\.|"(?!""))*+)"""|{_STRING}|{_CHAR}|{_LINE}|{_COMMENT}')


def _holds_function(doc: str, language: str) -> bool:
    """Whether the lines of a comment after its first are, by the grammar, one whole function without marks: then it is
    a function put into a comment, whose own beginning stood before."""
    code = doc.partition("\n")[2].removesuffix("*/")
    found = _parsed(grammar(language)["function"], code, 0)
    return bool(found) and not code[found[0] :].strip()


def _is_comment_start(s: str, at: int) -> bool:
    """Whether a comment can begin here, looking back to the end of the comment before."""
    before = s.rfind("*/", 0, at)
    last = None
    for m in _BEFORE.finditer(s, before + 2 if before >= 0 else 0, at):
        last = m
    return not (last and last.end() == at and (last.group().startswith("//") or last.group().startswith("/*") and not last.group().endswith("*/")))


def method_pair(name: str, content: str, before: str | None) -> tuple[str, str, str] | None:
    """(name, code, description) of a single method with the lines before it, if its whole documentation is there.

    The lines may begin anywhere, in a comment or in another function, so the grammar's function rule is tried at
    each documentation comment, the nearest first, until one leads up to the method. A comment that opens the lines
    and holds a function is code put into a comment whose beginning was cut off."""
    code = _lines(content)
    s = _lines(before or "") + "\n" + code
    edge = len(s) - len(code)
    language = language_of(None, None, code)
    parse, at, end = grammar(language)["function"], len(s), min(len(s), edge + len(code.split("\n", 1)[0]))
    at = end
    while (at := s.rfind("/**", 0, at)) >= 0:
        if _is_comment_start(s, at) and (r := _parsed(parse, s, at)):
            _, doc, (a, b), (c, d) = r[1][0]
            if doc and a >= edge and a <= end and s[a:b].strip("`") == name:
                if not s[:at].strip() and _holds_function(s[doc[0] : doc[1]], language):
                    return None
                said = description(s[doc[0] : doc[1]])
                return (name, s[c:d], said) if is_informative(said, name) else None
    return None


_COLUMNS = "class_fqn string, start_line int, function string, code string, description string"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    names = ["class_fqn", "start_line", "function", "code", "description"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for fqn, path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(fqn, *p) for p in file_pairs(text, language_of(path, language, text))]
        yield _emit(rows)


def _from_methods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for fqn, name, line, content, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p := method_pair(name, content, before):
                rows.append((fqn, line, *p))
        yield _emit(rows)


def _all_pairs(sources: DataFrame, methods: DataFrame) -> DataFrame:
    """The rows of `documented_functions`, as often as they are read."""
    files = sources.select("fqn", "path", "language", "content").where("fqn is not null and content is not null").mapInArrow(_from_files, _COLUMNS)
    single = methods.select("class_fqn", "method_name", "start_line", "content", "context_before")
    single = single.where("class_fqn is not null and method_name is not null and start_line is not null and content is not null").mapInArrow(_from_methods, _COLUMNS)
    return files.unionByName(single)


def documented_functions(sources: DataFrame, methods: DataFrame) -> DataFrame:
    """(class_fqn, start_line, function, code, description): the documented functions of sources(fqn, path, language,
    content) and methods(class_fqn, method_name, start_line, content, context_before), each different one once.

    Rows without class, text, name or line give nothing. Copies of a file or method count once; differing ones at one
    line of a class all stay. Texts that aren't well formed give what can be read of them; empty tables no rows.
    """
    return _all_pairs(sources, methods).distinct()


def documented_places(sources: DataFrame, methods: DataFrame) -> DataFrame:
    """(class_fqn, start_line) of the documented functions, each once."""
    return _all_pairs(sources, methods).select("class_fqn", "start_line").distinct()
