"""Declarations of Java and C# files as rows: a table-generating step for each file, spread by Spark.

A file is cut into tokens, so that strings and comments cannot mislead, and declarations are found by their braces.
Bodies yield only the names they call and create. A file that breaks off gives what was found and one ERROR row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r'(?P<doc>/\*\*(?!/).*?\*/|///[^\n]*)|(?P<skip>/\*.*?\*/|//[^\n]*|^[ \t]*\#[^\n]*|\s+)'
    r'|(?P<text>"""+.*?"""+|\$?@?\$?@"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\')'
    r"|(?P<word>@?[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|::|->|\?\?|[^\w\s])",
    re.S | re.M,
)
_MODIFIERS = frozenset(
    "public private protected internal static final abstract sealed virtual override async readonly const default synchronized native transient volatile strictfp extern partial unsafe new required non".split()
)
_TYPES = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD", "struct": "STRUCT", "@interface": "ANNOTATION"}
_NOT_CALLS = frozenset("if for foreach while switch catch return throw new using lock synchronized sizeof typeof nameof when await base this super else do try".split())
_MODES = frozenset("ref out in params this final".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}, {")", "]", "}", ">"}

_PARAMETER = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("mode", pa.string())]))
SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("language", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("fqn", pa.string()), ("package", pa.string()), ("parent_fqn", pa.string()),
        ("start_line", pa.int32()), ("end_line", pa.int32()), ("modifiers", pa.list_(pa.string())),
        ("annotations", pa.list_(pa.struct([("name", pa.string()), ("args", pa.map_(pa.string(), pa.string()))]))), ("raw_doc", pa.string()),
        ("return_type", pa.string()), ("parameters", _PARAMETER), ("throws", pa.list_(pa.string())), ("extends", pa.list_(pa.string())), ("implements", pa.list_(pa.string())),
        ("accessors", pa.list_(pa.string())), ("calls", pa.list_(pa.struct([("name", pa.string()), ("n_args", pa.int32()), ("line", pa.int32())]))), ("creates", pa.list_(pa.string())),
        ("target", pa.string()), ("is_wildcard", pa.bool_()), ("is_static", pa.bool_()), ("alias", pa.string()),
    ]
)
DDL = (
    "path string, language string, kind string, name string, fqn string, package string, parent_fqn string, start_line int, end_line int, modifiers array<string>, "
    "annotations array<struct<name:string,args:map<string,string>>>, raw_doc string, return_type string, parameters array<struct<name:string,type:string,mode:string>>, throws array<string>, "
    "extends array<string>, implements array<string>, accessors array<string>, calls array<struct<name:string,n_args:int,line:int>>, creates array<string>, "
    "target string, is_wildcard boolean, is_static boolean, alias string"
)


class _File:
    """Tokens of one file, and the declarations found in them."""

    def __init__(self, path: str, language: str, text: str):
        self.base = {"path": path, "language": language}
        self.java = language == "java"
        self.package, self.rows, self.tokens, self.docs = "", [], [], {}
        line, at, doc = 1, 0, []
        for m in _TOKEN.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            if m.lastgroup == "doc":
                doc = [*doc, m[0]] if m[0].startswith("///") else [m[0]]
            elif m.lastgroup != "skip":
                if doc:
                    self.docs[len(self.tokens)] = "\n".join(doc)
                    doc = []
                self.tokens.append((m[0], line, m.lastgroup))
        self.tokens.append(("", line, "end"))

    def word(self, i: int) -> str:
        return self.tokens[i][0] if i < len(self.tokens) else ""

    def closing(self, i: int) -> int:
        """The place of the mark that closes the one at ``i``; the file's end if none does."""
        close, depth, own = _OPEN[self.word(i)], 0, self.word(i)
        while i < len(self.tokens) - 1:
            depth += (self.word(i) == own) - (self.word(i) == close)
            if not depth:
                return i
            i += 1
        return i

    def shown(self, a: int, b: int) -> str:
        """Tokens as source text, with blanks only between words."""
        out = ""
        for i in range(a, b):
            w = self.word(i)
            out += (" " if out and (out[-1].isalnum() or out[-1] in "_,?") and (w[0].isalnum() or w[0] in "_@") else "") + w
        return out

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """Spans between commas outside of brackets."""
        out, start, depth = [], a, 0
        for i in range(a, b):
            w = self.word(i)
            depth += (w in _OPEN) - (w in _CLOSE)
            if w == "," and depth <= 0:
                out.append((start, i))
                start = i + 1
        return [*out, (start, b)] if b > a else []

    def annotation(self, a: int, b: int) -> dict:
        i, name = a, ""
        while i < b and self.word(i) not in "(":
            name += self.word(i)
            i += 1
        args = {}
        for s, e in self.parts(i + 1, self.closing(i)) if i < b else []:
            key = self.word(s) if s + 1 < e and self.word(s + 1) in ("=", ":") else ""
            args[key or ("value" if "value" not in args else str(len(args)))] = self.shown(s + 2 if key else s, e).strip('"')
        return {"name": name.lstrip("@").rsplit(".", 1)[-1], "args": list(args.items())}

    def parameters(self, a: int, b: int) -> list[dict]:
        out = []
        for s, e in self.parts(a, b):
            while self.word(s) == "[" and not self.java:
                s = self.closing(s) + 1
            while self.java and self.word(s).startswith("@"):
                s += 1
                s = self.closing(s) + 1 if self.word(s) == "(" else s
            mode = ""
            while self.word(s) in _MODES and s + 1 < e:
                mode, s = self.word(s) if self.word(s) != "final" else mode, s + 1
            end = next((i for i in range(s, e) if self.word(i) == "="), e)
            if end - s >= 2:
                out.append({"name": self.word(end - 1), "type": self.shown(s, end - 1), "mode": mode or None})
        return out

    def body(self, a: int, b: int) -> tuple[list[dict], list[str]]:
        calls, creates = [], []
        for i in range(a, b - 1):
            w, line, kind = self.tokens[i]
            if kind != "word":
                continue
            if self.word(i - 1) == "new":
                creates.append(w)
            elif self.word(i + 1) == "(" and w not in _NOT_CALLS:
                calls.append({"name": w, "n_args": len(self.parts(i + 2, self.closing(i + 1))), "line": line})
        return calls, sorted({*creates})

    def add(self, kind: str, name: str, parent: str | None, first: int, last: int, **more) -> str:
        fqn = ".".join(x for x in (parent or self.package, name) if x)
        self.rows.append(self.base | {"kind": kind, "name": name, "fqn": fqn, "package": self.package, "parent_fqn": parent, "start_line": self.tokens[first][1], "end_line": self.tokens[min(last, len(self.tokens) - 1)][1]} | more)
        return fqn

    def scan(self, i: int, end: int, parent: str | None) -> None:
        """Declarations from ``i`` to ``end``."""
        while i < end:
            i = max(i + 1, self.declaration(i, end, parent))

    def declaration(self, i: int, end: int, parent: str | None) -> int:
        first, annotations, modifiers = i, [], []
        raw = self.docs.get(i)
        while i < end:
            w = self.word(i)
            if self.java and w.startswith("@") and w != "@interface":
                stop = i + 1
                while self.word(stop) == "." :
                    stop += 2
                stop = self.closing(stop) + 1 if self.word(stop) == "(" else stop
                annotations.append(self.annotation(i, stop))
                i = stop
            elif not self.java and w == "[":
                stop = self.closing(i)
                annotations += [self.annotation(s, e) for s, e in self.parts(i + 1, stop)]
                i = stop + 1
            elif w in _MODIFIERS and self.word(i + 1) not in ("(", "=", ";"):
                modifiers.append(w)
                i += 1
            else:
                break
            raw = raw or self.docs.get(i)
        w, common = self.word(i), {"annotations": annotations, "modifiers": modifiers, "raw_doc": raw}
        if w in ("package", "namespace"):
            stop = next((k for k in range(i, end) if self.word(k) in (";", "{")), end)
            outer, self.package = self.package, ".".join(x for x in (self.package, self.shown(i + 1, stop)) if x)
            if self.word(stop) == "{":
                close = self.closing(stop)
                self.scan(stop + 1, close, None)
                self.package = outer
                return close + 1
            return stop + 1
        if w in ("import", "using") and parent is None or w == "global":
            stop = next((k for k in range(i, end) if self.word(k) == ";"), end)
            static = self.word(i + 1) == "static"
            target = self.shown(i + 1 + static, stop)
            alias, _, real = target.rpartition("=")
            wildcard = real.endswith(".*") or (not self.java and not alias and not static)
            self.rows.append(self.base | {"kind": "IMPORT", "package": self.package, "target": real.removesuffix(".*"), "is_wildcard": wildcard, "is_static": static, "alias": alias or None, "start_line": self.tokens[i][1], "end_line": self.tokens[i][1]})
            return stop + 1
        if w in _TYPES and self.tokens[i + 1][2] == "word" and (w != "record" or self.word(i + 2) in "({<:;" or self.word(i + 1) in ("class", "struct")):
            return self.type(i, end, parent, first, common)
        if w in ("{", "}", ";", ""):
            return self.closing(i) + 1 if w == "{" else i + 1
        return self.member(i, end, parent, first, common)

    def type(self, i: int, end: int, parent: str | None, first: int, common: dict) -> int:
        kind = _TYPES[self.word(i)]
        i += 1 + (self.word(i + 1) in ("class", "struct"))
        name, i = self.word(i), i + 1
        more = dict(common)
        extends, implements, into = [], [], None
        while i < end and self.word(i) not in ("{", ";"):
            w = self.word(i)
            if w == "(":
                close = self.closing(i)
                more["parameters"] = self.parameters(i + 1, close)
                i = close + 1
            elif w == "<" and into is None:
                i = self.closing(i) + 1
            elif w in ("extends", "implements", ":", "permits", "where"):
                into = {"extends": implements if kind == "INTERFACE" and not self.java else extends, "implements": implements, ":": implements}.get(w, [])
                stop = i + 1
                depth = 0
                while stop < end and not (depth == 0 and self.word(stop) in ("{", ";", "implements", "permits", "where")):
                    depth += (self.word(stop) in "(<[") - (self.word(stop) in ")>]")
                    stop += 1
                into += [self.shown(s, e) for s, e in self.parts(i + 1, stop)]
                i = stop
            else:
                i += 1
        if not self.java and kind in ("CLASS", "RECORD") and implements and not re.match(r"I[A-Z]", implements[0].rsplit(".", 1)[-1]):
            extends, implements = [re.sub(r"\(.*", "", implements[0])], implements[1:]
        close = self.closing(i) if self.word(i) == "{" else i
        fqn = self.add(kind, name, parent, first, close, extends=extends, implements=implements, **more)
        at = i + 1
        if kind == "ENUM" and close > i:
            while at < close and self.word(at) != ";":  # constants, with bodies or not
                at = self.closing(at) + 1 if self.word(at) in "({" else at + 1
        self.scan(at, close, fqn)
        return close + 1

    def member(self, i: int, end: int, parent: str | None, first: int, common: dict) -> int:
        if self.word(i) == "<":
            i = self.closing(i) + 1
        stop, depth = i, 0
        while stop < end:
            w = self.word(stop)
            if depth == 0 and w in ("(", "=", ";", "{", "=>", "}"):
                break
            depth += (w in "<[") - (w in ">]")
            stop += 1
        w, name_at = self.word(stop), stop - 1
        if w == "(" and self.word(name_at) == ">":  # generic method: name<T>(
            while name_at > i and self.word(name_at) != "<":
                name_at -= 1
            name_at -= 1
        name = self.word(name_at)
        if parent is None or not name or self.tokens[name_at][2] != "word" or w in ("}", ""):
            return self.closing(stop) + 1 if w in ("{", "(") else stop + 1
        kind_of = self.shown(i, name_at) or None
        if w == "(":
            close = self.closing(stop)
            at, throws = close + 1, []
            while at < end and self.word(at) not in ("{", ";", "=>"):
                if self.word(at) == "throws":
                    to = next((k for k in range(at, end) if self.word(k) in ("{", ";")), end)
                    throws = [self.shown(s, e) for s, e in self.parts(at + 1, to)]
                at = self.closing(at) + 1 if self.word(at) == "(" else at + 1
            last = self.closing(at) if self.word(at) == "{" else next((k for k in range(at, end) if self.word(k) == ";"), end)
            calls, creates = self.body(at, last)
            self.add("METHOD", name if kind_of else "<init>", parent, first, last, return_type=kind_of, parameters=self.parameters(stop + 1, close), throws=throws, calls=calls, creates=creates, **common)
            return last + 1
        last, accessors = stop, None
        if w == "{" and self.java:  # a record's compact constructor
            close = self.closing(stop)
            calls, creates = self.body(stop, close)
            self.add("METHOD", "<init>", parent, first, close, parameters=[], calls=calls, creates=creates, **common)
            return close + 1
        if w == "{":
            close = self.closing(stop)
            accessors = [self.word(k) for k in range(stop, close) if self.word(k) in ("get", "set", "init", "add", "remove")]
            last = close
            if self.word(close + 1) != "=":
                self.add("PROPERTY", name, parent, first, last, return_type=kind_of, accessors=accessors, **common)
                return close + 1
            stop = close + 1
        depth = 0
        while stop < end and not (depth == 0 and self.word(stop) == ";"):
            depth += (self.word(stop) in ("(", "{", "[")) - (self.word(stop) in (")", "}", "]"))
            stop += 1
        calls, creates = self.body(last, stop)
        prop = accessors is not None or w == "=>"
        if kind_of and "," in kind_of and not prop:  # several variables of one declaration
            spans = self.parts(i, name_at + 1)
            if all(e - s == 1 for s, e in spans[1:]):
                kind_of = self.shown(spans[0][0], spans[0][1] - 1)
                for s, e in spans[:-1]:
                    self.add("FIELD", self.word(e - 1), parent, first, stop, return_type=kind_of, **common)
        self.add("PROPERTY" if prop else "FIELD", name, parent, first, stop, return_type=kind_of, accessors=accessors if accessors is not None else ["get"] if prop else None, calls=calls, creates=creates, **common)
        return stop + 1


def parse_file(path: str, language: str, text: str) -> list[dict]:
    """The rows of one file; an ERROR row more if its braces do not close."""
    file = _File(path, language, text)
    words = [w for w, _, kind in file.tokens if kind == "mark"]
    try:
        file.scan(0, len(file.tokens) - 1, None)
    except (IndexError, KeyError, RecursionError) as error:
        file.rows.append(file.base | {"kind": "ERROR", "name": type(error).__name__})
    else:
        if words.count("{") != words.count("}"):
            file.rows.append(file.base | {"kind": "ERROR", "name": "unbalanced braces"})
    return file.rows


def declarations(sources: DataFrame) -> DataFrame:
    """A row for each declaration, import and error of ``sources`` (path, language, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows := parse_file(path, language, text or ""):
                    empty = dict.fromkeys(SCHEMA.names)
                    yield pa.RecordBatch.from_pylist([empty | r for r in rows], schema=SCHEMA)

    return sources.where("language IS NOT NULL").select("path", "language", "text").mapInArrow(run, DDL)
