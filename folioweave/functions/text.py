"""Column functions on templates: text with {{n}} placeholders and [[b]] / [[i]] marks.  Whitespace and word classes are Unicode's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the template grammar and of list detection.
PLACEHOLDER = r"\{\{[0-9]+\}\}"
MARK = r"\[\[/?[bi]\]\]"
TOKEN = rf"{PLACEHOLDER}|{MARK}"
BULLETS = "•●○▪▫■□◦‣∙⋅·"
ITEM_END = ".,;:!?。，、；：！？）】》」』”’…"
GLOSSARY_LENGTH = (2, 36)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an expression that is written several times is also evaluated several times."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def without_tokens(c: Column) -> Column:
    return F.regexp_replace(c, TOKEN, "")


def plain(c: Column) -> Column:
    """Without tokens and whitespace."""
    return F.regexp_replace(c, rf"{TOKEN}|(?U)\s", "")


def has_text(c: Column) -> Column:
    return F.coalesce(without_tokens(c).rlike(r"[\p{L}\p{N}_]"), F.lit(False))


def unit_key(template: Column, sig: Column) -> Column:
    return F.md5(F.concat(template, F.char(F.lit(1)), sig).cast("binary"))


def fix_markers(c: Column) -> Column:
    """Malformed emphasis marks in canonical form; other short double brackets removed."""
    quote = "['‘’\"“”]?"
    fixed = F.regexp_replace(c, rf"\[\[(?U)\s*{quote}\s*(/?)\s*([bi])\s*{quote}\s*\]\]", "[[$1$2]]")
    return F.regexp_replace(fixed, r"\[\[(?!/?[bi]\]\])[^\]]{0,12}\]\]", "")


def repair(source: Column, out: Column) -> Column:
    """out with the placeholders of source, the k-th becoming source's k-th; missing ones appended, surplus dropped; [[b]] balanced."""
    placeholders = lambda c: F.regexp_extract_all(c, F.lit(f"({PLACEHOLDER})"), F.lit(1))

    def renumbered(o: Column, wanted: Column, found: Column) -> Column:
        n = F.size(found)
        filled = F.array_join(F.transform(F.split(o, PLACEHOLDER, -1), lambda p, i: F.concat(p, F.when(i < n, F.coalesce(F.get(wanted, i), F.lit(""))).otherwise(""))), "")
        missing = F.slice(wanted, n + 1, F.greatest(F.size(wanted) - n, F.lit(0)))
        appended = lambda f: F.concat(rstrip(f), F.lit(" "), F.array_join(missing, " "))
        return F.when(wanted == found, o).otherwise(let(filled, lambda f: F.when(F.size(wanted) > n, appended(f)).otherwise(f)))

    def balanced(whole: Column) -> Column:
        opens, closes = (F.size(F.split(whole, F.lit(m), -1)) - 1 for m in (r"\[\[b\]\]", r"\[\[/b\]\]"))
        return F.concat(F.repeat(F.lit("[[b]]"), F.greatest(closes - opens, F.lit(0))), whole, F.repeat(F.lit("[[/b]]"), F.greatest(opens - closes, F.lit(0))))

    def both(s: Column, o: Column) -> Column:
        whole = let(placeholders(s), lambda w: let(placeholders(o), lambda f: renumbered(o, w, f)))
        return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, o).otherwise(let(whole, balanced))

    return let(source, lambda s: let(out, lambda o: both(s, o)))


def tidy(c: Column) -> Column:
    """Empty and doubled brackets and stray blanks removed; half-width brackets next to Chinese text made full-width."""

    def chunk(t: Column) -> Column:
        t = F.regexp_replace(t, r"[（(](?U)\s*[)）]", "")
        t = F.regexp_replace(t, r"[（(](?U)[\s,，.。、;；:：·・]{0,6}[)）]", "")
        t = F.regexp_replace(t, r"([\x{4e00}-\x{9fff}] *)\(([^()]{0,40})\)", "$1（$2）")
        t = F.regexp_replace(t, r"\(([^()]{0,40})\)( *[\x{4e00}-\x{9fff}])", "（$1）$2")
        for _ in range(3):
            t = F.regexp_replace(t, r"（(?U)\s*（([^（）]*)）\s*）", "（$1）")
        return t

    def whole(c: Column) -> Column:
        tokens = F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1))
        s = let(tokens, lambda found: F.array_join(F.transform(F.split(c, TOKEN, -1), lambda t, i: F.concat(chunk(t), F.coalesce(F.get(found, i), F.lit("")))), ""))
        s = F.regexp_replace(s, r"[ \t]{2,}", " ")
        s = F.regexp_replace(s, r"(?U)\s+([，。；：、！？])", "$1")
        s = F.regexp_replace(s, r"([（(])(?U)\s+", "$1")
        return strip(F.regexp_replace(s, r"(?U)\s+([）)])", "$1"))

    return let(c, whole)


def finalize(source: Column, out: Column) -> Column:
    """The finished unit: from the translation if there is one, else from the source."""
    return let(fix_markers(source), lambda s: tidy(F.when(out.isNull(), s).otherwise(repair(s, fix_markers(out)))))


def strip_bullet(c: Column) -> Column:
    """struct<text, had>: without one leading bullet; blank but not empty text counts as one, null and empty text don't."""
    t = F.regexp_replace(c, r"^(?U)\s+", "")
    had = (F.length(c) > 0) & ((F.length(t) == 0) | t.rlike(f"^[{BULLETS}]"))
    text = F.when(t.rlike(f"^[{BULLETS}]"), F.regexp_replace(t, rf"^[{BULLETS}](?U)\s*", "")).otherwise(t)
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(had, F.lit(False)).alias("had"))


def item_parts(c: Column) -> Column:
    """The pieces of a paragraph cut before each bullet that starts it or follows the end of an item (or a bullet)."""
    cut = F.regexp_replace(c, rf"([{ITEM_END}{BULLETS}])([ \t]*)(?=[{BULLETS}])", "$1$2\u0001")
    return F.split(F.regexp_replace(cut, rf"^([ \t]*)(?=[{BULLETS}])", "$1\u0001"), "\u0001", -1)


def font_family(font: Column) -> Column:
    name = F.element_at(F.split(font, r"\+"), -1)
    family = F.regexp_extract(name, r"^([A-Za-z]+?)(?=[0-9]|-|$)", 1)
    return F.when(family == "", name).otherwise(family)


def edge_text(c: Column) -> Column:
    """Running lines compare by this: digit runs as #, no whitespace."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\d+", "#"), r"(?U)\s+", "")
