"""Text functions as columns: display width, wrapping, numbers for people, escaping, character sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Fixed ranges of characters that take two columns (East Asian Wide and Fullwidth).
WIDE = "ᄀ-ᅟ⌚⌛〈〉⏩-⏬⏰⏳◽◾☔☕♈-♓♿⚓⚡⚪⚫⚽⚾⛄⛅⛎⛔⛪⛲⛳⛵⛺⛽✅✊✋✨❌❎❓-❕❗➕-➗➰➿⬛⬜⭐⭕⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏ꥠ-꥿가-힣豈-﫿︐-︙︰-﹯！-｠￠-￦"


def display_width(c: Column) -> Column:
    """Columns on a terminal: wide characters take two, control characters none."""
    shown = F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")
    return F.length(shown) + F.length(F.regexp_replace(shown, f"[^{WIDE}]", ""))


def coarse_width(c: Column) -> Column:
    """Width where every character from code point 256 takes two columns."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x00-\xff]", ""))


def human_number(c: Column, iec: bool = False, digits: int = 2) -> Column:
    """A number with an SI (k, M, ...) or IEC (Ki, Mi, ...) prefix."""
    base, names = (1024, ["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi"]) if iec else (1000, ["", "k", "M", "G", "T", "P", "E", "Z", "Y"])
    out = None
    for k in range(len(names) - 1, -1, -1):
        shown = F.format_string(f"%.{digits}f{names[k]}", c.cast("double") / F.lit(float(base**k)))
        fits = F.abs(c) >= F.lit(float(base**k))
        out = F.when(fits, shown) if out is None else (out.when(fits, shown) if k else out.otherwise(shown))
    return F.when(c.isNotNull(), out)


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def charset(c: Column) -> Column:
    """The different characters of a text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))


def missing_chars(c: Column, available: Column | str) -> Column:
    """Characters used and not available."""
    have = F.split(F.lit(available), "") if isinstance(available, str) else available
    return F.array_sort(F.array_except(charset(c), have))


def translate_lines(c: Column, source: str, target: str, missing: str | None = None, known: str | None = None) -> Column:
    """Characters by a map, characters not in ``known`` by ``missing``, and each line stripped."""
    out = F.translate(c, source, target)
    if known is not None:
        out = F.regexp_replace(out, f"[^{re.escape(known)}\\n]", missing or "")
    return F.array_join(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), "\n")


def safe_utf8(c: Column) -> Column:
    """Bytes as text, bad sequences replaced."""
    return F.make_valid_utf8(c.cast("string")) if hasattr(F, "make_valid_utf8") else c.cast("string")


#: Marks that no line begins with, and marks that no line ends with.
CLOSING = "!%)]:;>?,.}·！…）】、：；”’》，。？」』"
OPENING = "([{<$￥（【“‘《「『"


def _width(ch: str) -> int:
    return 1 if ord(ch) < 256 else 2


def wrap_text(text: str | None, width: int) -> list[str] | None:
    """Lines no wider than ``width`` where a break is allowed: after spaces, and around wide characters, but not before closing
    nor after opening punctuation.  A stretch without a break that is too wide is cut."""
    if text is None:
        return None
    units, word = [], ""
    for ch in text:
        if ch.isspace():
            units += [word] * bool(word) + [" "]
            word = ""
        elif _width(ch) == 2 and ch not in CLOSING and ch not in OPENING:
            if word and word[-1] in OPENING:
                units.append(word + ch)
            else:
                units += [word] * bool(word) + [ch]
            word = ""
        elif ch in CLOSING and not word and units and units[-1] != " ":
            units[-1] += ch
        else:
            word += ch
    units += [word] * bool(word)
    lines, line, used = [], "", 0
    for u in units:
        w = sum(map(_width, u))
        if u == " " and not line:
            continue
        if used + w > width and line:
            lines.append(line.rstrip())
            line, used = "", 0
            if u == " ":
                continue
        while w > width:  # no break inside
            cut = next(k for k in range(len(u), 0, -1) if sum(map(_width, u[:k])) <= max(width, 2))
            lines.append(u[:cut])
            u = u[cut:]
            w = sum(map(_width, u))
        line, used = line + u, used + w
    if line.rstrip():
        lines.append(line.rstrip())
    return lines


#: The characters that count as white space.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _units(c: Column) -> Column:
    """Stretches of a text that no line ends within: a space; a wide character with the opening words before it and the closing
    marks behind it; a run of other characters."""
    in_class = lambda marks: "".join(f"\\x{{{ord(m):x}}}" for m in marks)
    space, opening, closing = in_class(BLANKS), in_class(OPENING), in_class(CLOSING)
    wide = f"[^\\x{{0}}-\\x{{ff}}{space}{opening}{closing}]"
    other = f"[\\x{{0}}-\\x{{ff}}{opening}{closing}&&[^{space}]]"
    full = F.regexp_extract_all(c, F.lit(f"(?:{other}*[{opening}])?{wide}[{closing}]*|{other}+|[{space}]"), F.lit(0))
    # without wide characters there are runs only, and white space has few forms
    plain = F.regexp_extract_all(c, F.lit(r"[^\t-\r\x1c-\x20\x85\xa0]+|[\t-\r\x1c-\x20\x85\xa0]"), F.lit(0))
    return F.when(c.rlike(r"[^\x00-\xff]"), full).otherwise(plain)


def _pieces(unit: Column, width: int) -> Column:
    """A unit too wide for a line, cut as far to the right as fits each time."""
    most = max(width, 2)
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("piece"), F.lit(0).alias("used"))

    def add(a: Column, ch: Column) -> Column:
        w = coarse_width(ch)
        full = (a["used"] + w > most) & (a["piece"] != "")
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["piece"]))).otherwise(a["done"]).alias("done"), F.when(full, ch).otherwise(F.concat(a["piece"], ch)).alias("piece"), F.when(full, w).otherwise(a["used"] + w).alias("used"))

    return F.aggregate(F.filter(F.split(unit, ""), lambda x: x != ""), begin, add, lambda a: F.concat(a["done"], F.array(a["piece"])))


def wrap(c: Column, width: int) -> Column:
    """A text's lines, as :func:`wrap_text` gives them, in built-in functions: units by one pattern, lines by a fold over units."""
    narrow = lambda t: F.when(F.octet_length(t) == F.length(t), F.length(t)).otherwise(coarse_width(t))  # noqa: E731  no pattern for ASCII
    step = lambda t, w, forced: F.struct(t.alias("t"), w.alias("w"), forced.alias("forced"))
    units = F.transform(_units(c), lambda u: F.when(F.lit(BLANKS).contains(u), step(F.lit(" "), F.lit(1), F.lit(False))).otherwise(step(u, narrow(u), F.lit(False))))
    cut = lambda u: F.transform(_pieces(u["t"], width), lambda p, i: step(p, narrow(p), i == 0))
    units = F.flatten(F.transform(units, lambda u: F.when(u["w"] <= width, F.array(u)).otherwise(cut(u))))
    begin = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0).alias("used"))

    def fill_line(a: Column, u: Column) -> Column:
        over = ((a["used"] + u["w"] > width) | u["forced"]) & (a["line"] != "")
        gone = (u["t"] == " ") & (over | (a["line"] == ""))
        lines = F.when(over, F.concat(a["lines"], F.array(F.rtrim(a["line"])))).otherwise(a["lines"])
        line = F.when(gone, F.lit("")).when(over, u["t"]).otherwise(F.concat(a["line"], u["t"]))
        used = F.when(gone, F.lit(0)).when(over, u["w"]).otherwise(a["used"] + u["w"])
        return F.struct(lines.alias("lines"), line.alias("line"), used.alias("used"))

    end = lambda a: F.when(F.rtrim(a["line"]) != "", F.concat(a["lines"], F.array(F.rtrim(a["line"])))).otherwise(a["lines"])
    return F.when(c.isNotNull(), F.aggregate(units, begin, fill_line, end))


def fill(c: Column, width: int) -> Column:
    return F.array_join(wrap(c, width), "\n")


def dedent(c: Column) -> Column:
    """The common leading white space of all lines taken off; lines of white space only become empty and don't count."""

    blank = lambda x: F.trim(F.translate(x, "\t", " ")) == ""
    lines = F.split(c, "\n")
    indents = F.transform(F.filter(lines, lambda x: ~blank(x)), lambda x: F.regexp_extract(x, r"^[ \t]*", 0))
    ends = F.struct(F.coalesce(F.array_min(indents), F.lit("")).alias("least"), F.coalesce(F.array_max(indents), F.lit("")).alias("most"))
    # what the least and the greatest of sorted indents have in common, all have
    same = lambda e: F.size(F.filter(F.sequence(F.lit(0), F.length(e["least"])), lambda i: F.left(e["least"], i) == F.left(e["most"], i))) - 1
    # in an array of one, so that it is worked out once and not for each line
    known = F.transform(F.array(ends), lambda e: same(e))
    return F.get(F.transform(known, lambda n: F.array_join(F.transform(lines, lambda x: F.when(blank(x), F.lit("")).otherwise(F.substring(x, n + 1, 2**31 - 1))), "\n")), F.lit(0))


def split_word(c: Column, quotes: str = "\"'`") -> Column:
    """The word that a text begins with, as a struct: ``quote``, ``word``, ``rest``.

    A text that begins with a quotation mark has the word up to the next one like it (all of it, if there is none); any other has
    its leading letters as the word and no quote.
    """
    mark = F.left(c, F.lit(1))
    quoted = F.lit(quotes).contains(mark) & (mark != "")
    inner = F.substring(c, 2, 2**31 - 1)
    end = F.call_function("instr", inner, mark)
    word = F.when(~quoted, F.regexp_extract(c, r"^\p{L}*", 0)).when(end > 0, F.left(inner, end - 1)).otherwise(inner)
    rest = F.when(~quoted, F.regexp_replace(c, r"^\p{L}*", "")).when(end > 0, F.substr(inner, end + 1)).otherwise("")
    return F.when(c.isNotNull(), F.struct(F.when(quoted, mark).otherwise("").alias("quote"), word.alias("word"), rest.alias("rest")))
