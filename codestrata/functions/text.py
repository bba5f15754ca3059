"""Scalar functions over texts, paths, signatures and annotations; all are expressions inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that one estimated token stands for.
CHARS_PER_TOKEN = 4


def est_tokens(text: Column) -> Column:
    """Estimated tokens of a text."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long")


def lines_of(text: Column) -> Column:
    """The lines of a text as an array."""
    return F.split(text, "\n")


def line_range(text: Column, first, last) -> Column:
    """Lines ``first`` to ``last`` (from 1, both included) of a text."""
    return F.array_join(F.slice(lines_of(text), first, last - first + 1), "\n")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def directory(path: Column) -> Column:
    """The directory of a relative path, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def prefixes(path: Column) -> Column:
    """A path and the directories above it, shortest first; null for the root."""
    parts = segments(path)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def slug(name: Column) -> Column:
    """A file name for a module or symbol: anything unusual becomes a dash."""
    return F.lower(F.regexp_replace(name, r"[^A-Za-z0-9._]+", "-"))


def html_escape(text: Column) -> Column:
    out = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


#: Words of both languages that shown code marks (fixed values).
KEYWORDS = (
    "abstract async await boolean break byte case catch char class const continue default delegate do double else enum extends false final finally float for foreach if implements "
    "import in instanceof int interface internal is long namespace new null override package private protected public readonly record ref return sealed short static string struct "
    "super switch this throw throws true try using var virtual void while yield"
).split()


def highlight(code: Column) -> Column:
    """Escaped code with strings, comments and keywords marked in one pass, so that none is marked inside another."""
    found = r"(&quot;[^\n]*?(?<!\\)&quot;)|(//[^\n]*|/\*[\s\S]*?\*/)|\b(" + "|".join(KEYWORDS) + r")\b"
    marked = F.regexp_replace(html_escape(code), found, '<i class="s">$1</i><i class="c">$2</i><i class="k">$3</i>')
    return F.regexp_replace(marked, r'<i class="[sck]"></i>', "")


def first_sentence(text: Column) -> Column:
    """A text up to its first full stop, exclamation or question mark."""
    return F.regexp_extract(text, r"^([^.!?]*[.!?])", 1)


def cap_words(text: Column, most: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, most), " ")


def fill(template: str, **parts: Column) -> Column:
    """A template with each ``{{name}}`` replaced by that part, nulls by nothing; a name that is not given is an error."""
    pieces = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    if unknown := {*pieces[1::2]} - {*parts}:
        raise KeyError(f"the template has unknown placeholders: {', '.join(sorted(unknown))}")
    return F.concat(*(F.coalesce(parts[x], F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(pieces)))


def breadcrumb(*tiers: Column) -> Column:
    """Names from the outermost tier inwards; missing tiers are left out."""
    return F.concat_ws(" > ", *tiers)


def simple_type(name: Column) -> Column:
    """A type's simple name without type arguments: ``java.util.List<String>`` is ``List``, ``int...`` stays."""
    plain = F.element_at(F.split(F.regexp_replace(name, r"<.*>|\.\.\.$", ""), r"\."), -1)
    return F.concat(plain, F.when(F.endswith(name, F.lit("...")), "...").otherwise(""))


def package_of(fqn: Column) -> Column:
    return F.regexp_extract(fqn, r"^(.*)\.[^.]+$", 1)


def short_signature(name: Column, parameters: Column, with_names: bool = False) -> Column:
    """``name(Type)`` or, with names, ``name(Type name)`` of an array of (name, type) structs."""
    shown = F.transform(parameters, lambda p: F.concat_ws(" ", simple_type(p["type"]), p["name"]) if with_names else simple_type(p["type"]))
    return F.concat(name, F.lit("("), F.array_join(shown, ", " if with_names else ","), F.lit(")"))


def symbol_id(fqn: Column, parameters: Column) -> Column:
    """A symbol's id: its full name, with simple parameter types if it has parameters."""
    return F.when(parameters.isNull(), fqn).otherwise(short_signature(fqn, parameters))


def link_to(fqn: Column, depth: int) -> Column:
    """The relative link to a symbol's page from a page ``depth`` directories down."""
    return F.concat(F.lit("../" * depth + "symbols/"), fqn, F.lit(".html"))


def annotation_value(annotations: Column, name: str, key: str = "value") -> Column:
    """One argument of the first annotation of that name."""
    found = F.filter(annotations, lambda a: a["name"] == name)
    return F.try_element_at(F.get(found, F.lit(0))["args"], F.lit(key))


def annotation_text(annotation: Column) -> Column:
    """An annotation as it is written, with its arguments in order of their names; a lone ``value`` needs no name."""
    pairs = F.transform(F.array_sort(F.map_entries(annotation["args"])), lambda e: F.when((e["key"] == "value") & (F.size(annotation["args"]) == 1), e["value"]).otherwise(F.concat(e["key"], F.lit(" = "), e["value"])))
    return F.concat(F.lit("@"), annotation["name"], F.when(F.size(annotation["args"]) > 0, F.concat(F.lit("("), F.array_join(pairs, ", "), F.lit(")"))).otherwise(""))


def has_annotation(annotations: Column, *names: str) -> Column:
    return F.exists(annotations, lambda a: a["name"].isin(*names))


def has_modifier(modifiers: Column, *names: str) -> Column:
    """Whether one of these modifiers is there; no modifiers have none."""
    return F.coalesce(F.arrays_overlap(modifiers, F.array(*map(F.lit, names))), F.lit(False))


def clean_doc(raw: Column) -> Column:
    """Prose of a documentation comment: without comment marks, leading asterisks or slashes, and tags."""
    text = F.regexp_replace(raw, r"^\s*/\*\*?|\*/\s*$", "")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(///?|\*)[ \t]?", "")
    text = F.regexp_replace(text, r"(?s)\n\s*@(param|return|returns|throws|see|since)\b.*$", "")
    text = F.regexp_replace(text, r"\{@\w+ ([^}]*)\}", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))
