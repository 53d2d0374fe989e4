"""Source files that are not valid in the language their path promises.

Each file is split into tokens and its whole token stream is run through the table-driven recogniser of its language's
grammar; the first token that fits no parse is the error reported. Lines are split into tokens alone and remembered; where
what a slash means hangs on earlier lines, a file that fails is read once more as one stretch.

Defined results: files with other endings, and null, empty or blank contents, are not judged. A byte-order mark at the
start is valid except in .java and .json; any line ends are valid. Rows delivered twice under one id count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeplane.llm import grammars
from lodeplane.llm.automaton import Grammar

LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "go": "go", "java": "java", "json": "json"}
_BAD = "\0"
_LINES = 200_000  # remembered source lines per language and task,
_LINE_CHARS = 500  # each at most so long
_WORD = r"[^\W\d]\w*"
_PRIMITIVE = "int long short byte char float double boolean".split()
_MODIFIER = "public private protected abstract native transient volatile strictfp".split()


class Lexer:
    """Tokens of one language as characters of its grammar; lines that hold whole tokens only are remembered."""

    comment = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
    string = r'"(?:[^"\\\n]|\\.)*"'
    number = r"0[xX][0-9a-fA-F_]+[lLn]?|0[bB][01_]+[lLn]?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[fFdDlLn]?"
    blank = r"[ \t\f]+"
    punct = ""
    multi = ("/*",)
    hashbang = False
    bom = True

    def __init__(self, grammar: Grammar):
        self.g = grammar
        code = grammar.code
        puncts = sorted(self.punct.split(), key=len, reverse=True)
        self.of = {}
        for p in puncts:
            self.of[p] = code.get(p) or code.get("AUG" if p[-1] == "=" and p not in ("==", "!=", "<=", ">=", "===", "!==") else "BIN") or _BAD
        self.words = {k: c for k, c in code.items() if re.fullmatch(r"[a-z_]+", k)}
        self.name = code.get("NAME", _BAD)
        self.kinds = {"string": code.get("STR", _BAD), "number": code.get("NUM", _BAD), "char": code.get("CHAR", _BAD), "private": code.get("PRIVATE", _BAD)}
        self.rx = re.compile(
            f"(?P<blank>{self.blank})|(?P<nl>\\n)|(?P<comment>{self.comment})|(?P<string>{self.string})|(?P<number>(?:{self.number})(?!\\w))" + self.more() + f"|(?P<word>{_WORD})|(?P<punct>{'|'.join(map(re.escape, puncts))})", re.DOTALL if self.dotall else 0
        ).match
        self.known: dict[str, str] = {}

    dotall = False

    def more(self) -> str:
        return ""

    def word(self, text: str) -> str:
        return self.words.get(text, self.name)

    def error_line(self, text: str) -> int:
        """Number of the line with the first token that fits no parse, 0 if the text is a whole file of the language."""
        if text[:1] == "﻿":
            if not self.bom:
                return 1
            text = text[1:]
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        g, known, n = self.g, self.known, len(text)
        s = g.begin()
        pos, line_no = 0, 1
        if self.hashbang and text.startswith("#!"):
            pos = max(text.find("\n"), 0) or n
        while pos < n:
            e = text.find("\n", pos)
            end = n if e < 0 else e + 1
            line = text[pos:end]
            tokens = known.get(line)
            if tokens is None:
                tokens, stop = self.lex(text, pos, end, n)
                if stop == end and len(line) <= _LINE_CHARS and not any(m in line for m in self.multi):
                    if len(known) > _LINES:
                        known.clear()
                    known[line] = tokens
            else:
                stop = end
            if tokens:
                s = g.advance(s, tokens)
                if s is None:
                    return line_no
            line_no += text.count("\n", pos, stop)
            pos = stop
        return 0 if g.advance(s, self.last(text) + g.eof) is not None else line_no

    def last(self, text: str) -> str:
        return ""

    def whole(self, text: str) -> bool:
        """Whether a text that fails line by line is valid as one stretch."""
        return False

    def lex(self, text: str, pos: int, end: int, n: int) -> tuple[str, int]:
        out = []
        match, of = self.rx, self.of
        while pos < end:
            m = match(text, pos)
            if m is None:
                out.append(_BAD)
                return "".join(out), max(end, pos + 1)
            kind = m.lastgroup
            if kind == "word":
                out.append(self.word(m.group()))
            elif kind == "punct":
                out.append(of[m.group()])
            elif kind not in ("blank", "comment", "nl"):
                out.append(self.kinds[kind])
            pos = m.end()
        return "".join(out), pos


class JsonLexer(Lexer):
    comment = r"(?!)"
    string = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
    number = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
    blank = r"[ \t]+"
    punct = "{ } [ ] , :"
    multi = ()
    bom = False

    def word(self, text: str) -> str:
        return self.words.get(text, _BAD)


class JavaLexer(Lexer):
    string = r'"""[ \t\f]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?!"")(?:[^"\\\n]|\\.)*"|""(?!")'
    number = Lexer.number + r"|0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d+[fFdD]?"
    punct = "( ) { } [ ] ; , . ... @ :: = > < ! ~ ? : -> == <= != && || ++ -- + - * / & | ^ % << += -= *= /= &= |= ^= %= <<="
    multi = ("/*", '"""')
    bom = False

    def __init__(self, grammar: Grammar):
        super().__init__(grammar)
        self.words |= {w: grammar.code["PRIM"] for w in _PRIMITIVE} | {w: grammar.code["MOD"] for w in _MODIFIER} | {"goto": _BAD, "const": _BAD, "_": self.name}

    def more(self) -> str:
        return r"|(?P<char>'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[^u\n]|\\[0-7]{1,3})')"


class GoLexer(Lexer):
    string = r'`[^`]*`|"(?:[^"\\\n]|\\.)*"'
    number = r"0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?i?"
    punct = "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! ~ != <= >= := ... ( ) [ ] { } , ; . :"
    multi = ("/*", "`")

    def __init__(self, grammar: Grammar):
        super().__init__(grammar)
        c = grammar.code
        self.closes = {c[x] for x in ("NAME", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")}
        self.end = c[";"]

    def more(self) -> str:
        return r"|(?P<char>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"

    def lex(self, text: str, pos: int, end: int, n: int) -> tuple[str, int]:
        out = []
        match, of = self.rx, self.of
        while pos < end:
            m = match(text, pos)
            if m is None:
                out.append(_BAD)
                return "".join(out), max(end, pos + 1)
            kind = m.lastgroup
            if kind == "word":
                out.append(self.word(m.group()))
            elif kind == "punct":
                out.append(of[m.group()])
            elif kind in ("nl", "comment"):
                if out and out[-1] in self.closes and (kind == "nl" or "\n" in m.group()):
                    out.append(self.end)
            elif kind != "blank":
                out.append(self.kinds[kind])
                if m.end() > end:  # a raw string over several lines: the rest of its last line belongs to it
                    e = text.find("\n", m.end())
                    end = n if e < 0 else e + 1
            pos = m.end()
        if pos == n and out and out[-1] in self.closes:
            out.append(self.end)
        return "".join(out), pos


class ScriptLexer(Lexer):
    blank = r"[ \t\f\v ﻿]+"
    string = r'"(?:[^"\\\n]|\\[\s\S])*"|' + r"'(?:[^'\\\n]|\\[\s\S])*'"
    punct = "{ } ( ) [ ] ; , . ... ?. ? : => = < > + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? == != === !== <= >= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= @"
    multi = ("/*", "`", "\\\n")
    hashbang = True

    def __init__(self, grammar: Grammar):
        super().__init__(grammar)
        c = grammar.code
        self.nl = c["NL"]
        self.values = {c[x] for x in ("NAME", "NUM", "STR", "REGEX", "TPL", "TPLTAIL", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "PRIVATE")} | {self.words[w] for w in ("async", "from", "get", "set", "of", "static", "as")}
        self.heads = {self.words[w] for w in ("if", "while", "for", "with")}
        self.open, self.shut, self.awaited = c["("], c[")"], self.words["await"]
        self.regex = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*").match
        self.piece = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*").match

    def more(self) -> str:
        return rf"|(?P<private>#{_WORD})"

    def lex(self, text: str, pos: int, end: int, n: int) -> tuple[str, int]:
        out: list[str] = []
        match, of, c = self.rx, self.of, self.g.code
        open_: list[int] = []  # depth of braces within each substitution of a template
        heads: list[bool] = []  # of each open parenthesis, whether it is the head of a statement
        prev, before, slash = "", "", True  # the last two tokens, and whether a slash begins a regular expression
        while pos < end or (open_ and pos < n):
            ch = text[pos]
            if ch == "/" and text[pos + 1 : pos + 2] not in ("/", "*") and slash:
                m = self.regex(text, pos)
                if m is None:
                    return "".join(out) + _BAD, max(end, pos + 1)
                out.append(c["REGEX"])
            elif ch == "`" or (ch == "}" and open_ and open_[-1] == 0):
                m = self.piece(text, pos + 1)
                stop = m.end()
                if stop >= n:
                    return "".join(out) + _BAD, n
                whole = text[stop] == "`"
                if ch == "}":
                    out.append(c["TPLTAIL" if whole else "TPLMID"])
                    if whole:
                        open_.pop()
                else:
                    out.append(c["TPL" if whole else "TPLHEAD"])
                    if not whole:
                        open_.append(0)
                pos = stop + (1 if whole else 2)
                before, prev, slash = prev, out[-1], not whole
                if pos > end:
                    e = text.find("\n", pos)
                    end = n if e < 0 else e + 1
                continue
            else:
                m = match(text, pos)
                if m is None:
                    return "".join(out) + _BAD, max(end, pos + 1)
                kind = m.lastgroup
                if kind == "word":
                    out.append(self.word(m.group()))
                elif kind == "punct":
                    p = m.group()
                    if p == "?." and text[m.end() : m.end() + 1].isdigit():
                        p = "?"
                        m = re.compile(r"\?").match(text, pos)
                    if open_:
                        open_[-1] += (p == "{") - (p == "}")
                    out.append(of[p])
                elif kind == "nl" or (kind == "comment" and "\n" in m.group()):
                    if out and out[-1] != self.nl:
                        out.append(self.nl)
                    if kind == "comment" and not out:
                        out.append(self.nl)
                elif kind not in ("blank", "comment"):
                    out.append(self.kinds[kind])
            if out and out[-1] != self.nl and m.lastgroup not in ("blank", "comment", "nl"):
                before, prev = prev, out[-1]
                slash = prev not in self.values
                if prev == self.open:
                    heads.append(before in self.heads or (before == self.awaited and len(out) > 2 and out[-3] in self.heads))
                elif prev == self.shut and heads:
                    slash = heads.pop()
            pos = m.end()
            if pos > end:
                e = text.find("\n", pos)
                end = n if e < 0 else e + 1
        return "".join(out), pos


    def whole(self, text: str) -> bool:
        if "/" not in text:
            return False
        text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        start = max(text.find("\n"), 0) or len(text) if text.startswith("#!") else 0
        tokens, _ = self.lex(text, start, len(text), len(text))
        s = self.g.advance(self.g.begin(), tokens)
        return s is not None and self.g.advance(s, self.g.eof) is not None


class TypedScriptLexer(ScriptLexer):
    punct = " ".join(p for p in ScriptLexer.punct.split() if p not in (">>", ">>>", ">=", ">>=", ">>>="))


class PythonLexer(Lexer):
    comment = r"#[^\n]*"
    string = r"(?:[rRbBuU]|[rR][bB]|[bB][rR])?(?:" + r"'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|" + r'"""(?:[^\\"]|\\[\s\S]|"(?!""))*"""|' + r"'(?!'')(?:[^'\\\n]|\\[\s\S])*'|''(?!')|" + r'"(?!"")(?:[^"\\\n]|\\[\s\S])*"|""(?!"))'
    number = r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|0(?:_?0)*|[1-9](?:_?\d)*"
    punct = "( ) [ ] { } , : . ; @ = -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= := + - * ** / // % << >> & | ^ ~ < > <= >= == != ..."
    blank = r"[ \t\f]+|\\\n"
    multi = ('"""', "'''", "\\\n")

    def __init__(self, grammar: Grammar):
        super().__init__(grammar)
        c = grammar.code
        self.nl, self.indent, self.dedent = c["NL"], c["INDENT"], c["DEDENT"]
        self.opens, self.closes = {c[x] for x in "([{"}, {c[x] for x in ")]}"}
        self.start, self.field, self.stop, self.equal = c["FSTART"], c["FFIELD"], c["FEND"], c["="]
        self.formatted = re.compile(r"(?:[fF][rR]?|[rR][fF])(\"\"\"|'''|\"|')").match

    def fstring(self, text: str, pos: int, quote: str, raw: bool) -> tuple[list[str], int]:
        """Tokens of a formatted string from after its opening quote: those of every field, each closed by a mark."""
        out, n, long = [self.start], len(text), len(quote) == 3
        while pos < n:
            ch = text[pos]
            if ch == quote[0] and text.startswith(quote, pos):
                return [*out, self.stop], pos + len(quote)
            if ch == "\\":
                pos += 2 if not (raw and text[pos + 1 : pos + 2] in "{}") else 1
                if not raw and text[pos - 1 : pos + 1] == "N{":
                    pos = max(text.find("}", pos), pos) + 1
            elif ch == "\n" and not long:
                break
            elif ch == "{" and text[pos + 1 : pos + 2] != "{":
                pos = self.replaced(text, pos + 1, quote, raw, out)
                if pos < 0:
                    break
            elif ch in "{}":
                if text[pos + 1 : pos + 2] != ch:
                    break
                pos += 2
            else:
                pos += 1
        return [*out, _BAD], n

    def replaced(self, text: str, pos: int, quote: str, raw: bool, out: list[str]) -> int:
        """Read one field up to after its closing brace; -1 if it has none."""
        depth, n = 0, len(text)
        while pos < n:
            ch = text[pos]
            if depth == 0 and (ch in "}:" or (ch == "!" and text[pos + 1 : pos + 2] != "=")):
                break
            if depth == 0 and ch == "=" and text[pos + 1 : pos + 2] != "=":
                out.append(self.equal)
                pos += 1
                continue
            tokens, pos, kind = self.token(text, pos)
            if tokens is None:
                return -1
            for t in tokens:
                depth += (t in self.opens) - (t in self.closes)
            if depth < 0:
                return -1
            out += tokens
        out.append(self.field)
        if text[pos : pos + 1] == "!":
            m = re.compile(r"![ \t]*[rsa][ \t]*(?=[:}])").match(text, pos)
            if m is None:
                return -1
            pos = m.end()
        if text[pos : pos + 1] == ":":
            pos += 1
            while pos < n and text[pos] != "}":  # the format, which may hold fields
                if text.startswith(quote, pos) or (text[pos] == "\n" and len(quote) == 1):
                    return -1
                if text[pos] == "{":
                    pos = self.replaced(text, pos + 1, quote, raw, out)
                    if pos < 0:
                        return -1
                else:
                    pos += 1
        return pos + 1 if text[pos : pos + 1] == "}" else -1

    def token(self, text: str, pos: int) -> tuple[list[str] | None, int, str]:
        """The tokens at a place (none for blanks, several for a formatted string), where they end, and their kind."""
        f = self.formatted(text, pos)
        if f:
            tokens, end = self.fstring(text, f.end(), f.group(1), "r" in text[pos : f.start(1)].lower())
            return tokens, end, "string"
        m = self.rx(text, pos)
        if m is None:
            return None, pos, ""
        kind = m.lastgroup
        if kind == "word":
            return [self.word(m.group())], m.end(), kind
        if kind == "punct":
            return [self.of[m.group()]], m.end(), kind
        return [self.kinds[kind]] if kind not in ("blank", "comment", "nl") else [], m.end(), kind

    def error_line(self, text: str) -> int:
        if text[:1] == "﻿":
            text = text[1:]
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if "\0" in text:
            return text.count("\n", 0, text.index("\0")) + 1
        g, known, n = self.g, self.known, len(text)
        s = g.begin()
        pos, line_no, depth, levels = 0, 1, 0, [0]
        while pos < n:
            e = text.find("\n", pos)
            end = n if e < 0 else e + 1
            start = pos
            while start < end and text[start] in " \t\f":
                start += 1
            line = text[start:end]
            hit = known.get(line)
            if hit is None:
                tokens, stop = self.lex(text, start, end, n)
                hit = (tokens, sum(t in self.opens for t in tokens) - sum(t in self.closes for t in tokens))
                if stop == end and len(line) <= _LINE_CHARS and not any(m in line for m in self.multi):
                    if len(known) > _LINES:
                        known.clear()
                    known[line] = hit
            else:
                stop = end
            tokens, delta = hit
            if tokens:
                head = ""
                if depth == 0:
                    width = 0
                    for ch in text[pos:start]:
                        width = width + 1 if ch == " " else (width // 8 + 1) * 8 if ch == "\t" else 0
                    if width > levels[-1]:
                        levels.append(width)
                        head = self.indent
                    else:
                        while width < levels[-1]:
                            levels.pop()
                            head += self.dedent
                        if width != levels[-1]:
                            return line_no
                depth = max(0, depth + delta)
                s = g.advance(s, head + tokens + (self.nl if depth == 0 else ""))
                if s is None:
                    return line_no
            line_no += text.count("\n", pos, stop)
            pos = stop
        return 0 if depth == 0 and g.advance(s, self.dedent * (len(levels) - 1) + g.eof) is not None else line_no

    def lex(self, text: str, pos: int, end: int, n: int) -> tuple[str, int]:
        out: list[str] = []
        while pos < end:
            tokens, stop, kind = self.token(text, pos)
            if tokens is None:
                out.append(_BAD)
                return "".join(out), max(end, pos + 1)
            out += tokens
            pos = stop
            if pos > end or (pos == end < n and kind == "blank"):  # a long string or a joined line: the logical line goes on
                e = text.find("\n", pos)
                end = n if e < 0 else e + 1
        return "".join(out), pos


_LEXERS = {
    "python": (PythonLexer, grammars.PYTHON, False),
    "json": (JsonLexer, grammars.JSON, False),
    "javascript": (ScriptLexer, grammars.JAVASCRIPT, True),
    "typescript": (TypedScriptLexer, grammars.TYPESCRIPT, True),
    "go": (GoLexer, grammars.GO, False),
    "java": (JavaLexer, grammars.JAVA, False),
}
_made: dict[str, Lexer] = {}


def lexer(language: str) -> Lexer:
    if language not in _made:
        kind, text, newlines = _LEXERS[language]
        _made[language] = kind(Grammar(text, "file", optional_newline=newlines))
    return _made[language]


def error_line(language: str, text: str) -> int:
    """Number of the line with the first error, 0 for a valid file."""
    lex = lexer(language)
    line = lex.error_line(text)
    return 0 if line and lex.whole(text) else line


def language_of(path: Column | str) -> Column:
    """The language that the ending of a path promises, null for all others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.nullif(ext, F.lit("")))


def parsed_files(files: DataFrame, *, key: str = "file_id", path: str = "path", content: str = "content", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, language, error_line`` (0: valid) of every judged file, and the columns of ``carry``; one narrow pass."""
    slim = files.select(F.col(key).alias("key"), language_of(path).alias("language"), F.col(content).alias("text"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(carry)])
    slim = slim.where(F.col("language").isNotNull() & F.col("text").rlike(r"[^\s\x{FEFF}]"))
    kind = slim.schema["key"].dataType.simpleString()
    extra = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [error_line(lang, text) for lang, text in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("language"), pa.array(lines, pa.int32()), *[batch.column(c) for c in extra]], names=["key", "language", "error_line", *extra])

    out = slim.mapInArrow(run, f"key {kind}, language string, error_line int" + "".join(f", {c} string" for c in extra))
    return out.select(F.col("key").alias(key), "language", "error_line", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def invalid_files(files: DataFrame, **names) -> DataFrame:
    key = names.get("key", "file_id")
    return parsed_files(files, **names).where("error_line > 0").groupBy(key).agg(F.min("error_line").alias("error_line"))


def error_rates(files: DataFrame, repository: str = "repo_id", key: str = "file_id") -> DataFrame:
    """Judged and invalid files per repository and language, each record once, and their rate."""
    parsed = parsed_files(files, key=key, carry=(repository,)).groupBy(key, repository, "language").agg(F.max("error_line").alias("error_line"))
    counted = parsed.groupBy(repository, "language").agg(F.count("*").alias("files"), F.count(F.when(F.col("error_line") > 0, 1)).alias("invalid"))
    return counted.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
