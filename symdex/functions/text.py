"""Text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a line ends with.  A lone CR counts only before another CR or at the end of the text.
_IN_LINE = r"(?:[^\r\n]++|\r(?![\r\n]|\z))"
_LINE = rf"{_IN_LINE}*+(?:\r?\n|\r(?=\r|\z))|{_IN_LINE}++\z"


def _pairs() -> dict[int, int]:
    """Letters and their upper-case letters, where that is one letter; a dotless i and a long s stay, as they do without a language."""
    letters = (i for i in range(0x1E944) if not 0xD800 <= i < 0xE000 and i not in (0x131, 0x17F))
    upper = ((i, chr(i).upper()) for i in letters)
    return {i: ord(u) for i, u in upper if len(u) == 1 and ord(u) != i}


_UPPER = _pairs()
_FROM, _TO = "".join(map(chr, _UPPER)), "".join(map(chr, _UPPER.values()))


def fold_case(x: Column | str) -> Column:
    """Upper case letter by letter: the one rule by which names are compared, ordered and filtered whatever their case."""
    return F.translate(x, _FROM, _TO)


def folded(x: str) -> str:
    """The same of a plain text."""
    return x.translate(_UPPER)


def html_escape(x: Column) -> Column:
    """XML escapes; an LF before a CR is kept apart from it by a space."""
    out = F.replace(x, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\n\r", "\n \r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_escape(x: Column) -> Column:
    """XML escapes and nothing else."""
    out = F.replace(x, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_escape_offsets(text: Column, start: Column, end: Column) -> Column:
    """struct(html, new_start, new_end): text without outer spaces, escaped, and where a range of it went."""
    left = F.length(text) - F.length(F.ltrim(text))
    body = F.trim(text)
    a, b = F.greatest(start - left, F.lit(0)), F.least(F.greatest(end - left, F.lit(0)), F.length(body))
    place = lambda n: F.length(xml_escape(F.substring(body, F.lit(1), n)))
    return F.struct(xml_escape(body).alias("html"), place(a).alias("new_start"), place(b).alias("new_end"))


def escape_semicolons(x: Column) -> Column:
    return F.translate(x, ";\r\n", ":  ")


def format_thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def lines(text: Column) -> Column:
    """Lines with their terminators; an empty one follows a final terminator."""
    found = F.regexp_extract_all(text, F.lit(_LINE), F.lit(0))
    return F.when(text.rlike(r"[\r\n]\z"), F.concat(found, F.array(F.lit("")))).otherwise(found)


def line_lengths(text: Column) -> Column:
    return F.transform(lines(text), F.length)


def line_number(text: Column, position: Column) -> Column:
    """0-based line of a position, 0 past the end."""
    before = F.substring(text, F.lit(1), position + 1)
    inside = F.size(F.regexp_extract_all(F.substring(before, F.lit(1), position), F.lit(r"\r\n|\n|\r(?=\r|\z)"), F.lit(0)))
    return F.when(position >= F.length(text), F.lit(0)).otherwise(inside)


def line_from_position(text: Column, position: Column) -> Column:
    """struct(start, length) of the line around a position, without its terminator."""
    same = F.translate(text, "\r", "\n")  # one terminator, so the line's ends are found by one pass and not by a pattern tried at each letter
    before, after = F.substring(same, F.lit(1), position), F.substring(same, position + 1, F.length(text))
    start = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    return F.struct(start.alias("start"), (position + F.length(F.substring_index(after, "\n", 1)) - start).alias("length"))


def split_semicolons(text: Column) -> Column:
    """Tokens, runs of white space and single semicolons, in order."""
    return F.regexp_extract_all(text, F.lit("[ \\t\\r\\n]+|;|[^; \\t\\r\\n]+"), F.lit(0))


def is_ascii(x: Column) -> Column:
    return x.rlike(r"\A[ -~]*\z")


def guid(text: Column) -> Column:
    """Lower-case hyphenated form of a quoted or bare literal, null where there is none."""
    bare = F.regexp_replace(text, '^@?"?|"$', "")
    hexes = F.lower(F.regexp_replace(bare, r"[{}()-]", ""))
    h = r"[0-9A-Fa-f]"
    shape = rf"^(?:{h}{{32}}|{h}{{8}}(?:-{h}{{4}}){{3}}-{h}{{12}}|\{{{h}{{8}}(?:-{h}{{4}}){{3}}-{h}{{12}}\}}|\({h}{{8}}(?:-{h}{{4}}){{3}}-{h}{{12}}\))$"
    part = lambda a, n: F.substring(hexes, a, n)
    return F.when(bare.rlike(shape), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)))


def namespace_of(x: Column) -> Column:
    return F.regexp_extract(x, r"(?s)^(.*)\.[^.]*$", 1)


def last_part(x: Column) -> Column:
    return F.element_at(F.split(x, r"\."), -1)


def strip_quotes_strict(x: Column) -> Column:
    """struct(text, quoted): without double quotes around more than one character."""
    quoted = (F.length(x) > 1) & x.startswith('"') & x.endswith('"')
    return F.struct(F.when(quoted, F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x).alias("text"), quoted.alias("quoted"))


def strip_quotes_loose(x: Column) -> Column:
    """Double, then single quotes taken off, each from more than two characters."""
    for q in ('"', "'"):
        x = F.when((F.length(x) > 2) & x.startswith(q) & x.endswith(q), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    return x


def trim_compiler_exe(x: Column) -> Column:
    return F.regexp_replace(x, r"(?is)^.*?(?:csc|vbc)\.exe ", "")


def server_path(x: Column) -> Column:
    """struct(from, to) of ``a=b``, with either side quoted or the whole."""
    whole = F.regexp_replace(x, '^"([^"]*)"$', "$1")
    part = lambda i: F.regexp_replace(F.regexp_extract(whole, '^("[^"]*"|[^=]*)=(.*)$', i), '^"(.*)"$', "$1")
    return F.struct(part(1).alias("from"), part(2).alias("to"))


def assembly_name(xml: Column) -> Column:
    """Name from an assembly-name element, through the root namespace if that is what it names; null if there is none."""
    name = F.regexp_extract(xml, r"<(?:Module)?AssemblyName>([^<]*)</(?:Module)?AssemblyName>", 1)
    root = F.regexp_extract(xml, r"<RootNamespace>([^<]*)</RootNamespace>", 1)
    return F.nullif(F.when(name == "$(RootNamespace)", root).otherwise(name), F.lit(""))


def url_encode(x: Column) -> Column:
    """Safe characters stay, a space becomes +, other ASCII %xx and the rest %uxxxx (UTF-16 units), lower-case."""
    hexed = lambda n, c: F.lower(F.lpad(F.hex(n), c, "0"))

    def one(c: Column) -> Column:
        code = F.expr("0") + _code_point(c)
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        wide = F.concat(F.lit("%u"), hexed(high, 4), F.lit("%u"), hexed(low, 4))
        return (
            F.when(c.rlike(r"[A-Za-z0-9_.!*()-]"), c)
            .when(c == " ", F.lit("+"))
            .when(code < 128, F.concat(F.lit("%"), hexed(code, 2)))
            .when(code < 0x10000, F.concat(F.lit("%u"), hexed(code, 4)))
            .otherwise(wide)
        )

    return F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), one), "")


def _code_point(c: Column) -> Column:
    """Code point of a character from its UTF-32 bytes."""
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")


def cap_large_file(line_count: Column) -> Column:
    return line_count > 30_000


def cap_large_xml(length: Column) -> Column:
    return length > 1_000_000
