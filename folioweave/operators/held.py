"""Lines that hold their spans, whole documents at a time: body fonts, mathematics and kinds of lines as array operations.

Decoders give the lines of a document together.  Where they come so, what layout.body_font(), layout.with_math() and structure.line_kinds() find out about tables of
spans needs no shuffle and no row for a span: a batch of documents is a few arrays.  Results are the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioweave.functions import text as X

from .continuation import only_formula_words
from .layout import MATH_CHARS, MATH_FAMILIES, MATH_RANGES
from .structure import FORMULA_WORDS

#: Unicode's White_Space, as (?U)\s has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
SYMBOL = f"[{MATH_CHARS}{MATH_RANGES}]"
PUNCTUATION = f"""^[{SPACES}]*[,.;:!?·、。，；：！？…'"“”‘’]+[{SPACES}]*$"""
LEAD = f"^(?:$|[{X.BULLETS}]|[0-9]{{1,2}}[.)、][{SPACES}])"
FORMAL = re.compile(f"(?i)(?:{MATH_FAMILIES})")
HOPEFUL = "^(?:[{}][{}]*[{}])?$".format("".join(sorted({w[0] for w in FORMULA_WORDS})), "".join(sorted(set("".join(FORMULA_WORDS)))), "".join(sorted({w[-1] for w in FORMULA_WORDS})))


#: A letter that is in none of the words stays.
HOPELESS = "[à-ÿ" + "".join(sorted(set("abcdefghijklmnopqrstuvwxyz") - set("".join(FORMULA_WORDS)))) + "]"


@dataclass
class Lines:
    """Lines and, from starts[i] to starts[i + 1], the spans of line i by (span_no, x0); no line is empty.  An x1 that isn't known is NaN.  doc is the place of a line's document among n_docs."""

    n_docs: int
    doc: np.ndarray
    page: np.ndarray
    line_id: np.ndarray
    starts: np.ndarray
    span_no: np.ndarray
    text: pa.Array
    font: np.ndarray
    fonts: list[str | None]
    size: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray

    @property
    def line(self) -> np.ndarray:
        """The line of each span."""
        return np.repeat(np.arange(len(self.doc)), np.diff(self.starts))

    def each(self, f: np.ufunc, values: np.ndarray) -> np.ndarray:
        """f over the spans of each line."""
        return f.reduceat(values, self.starts[:-1]) if len(self.doc) else values[:0]

    def joined(self, own: np.ndarray | None = None) -> pa.Array:
        """The texts of each line's spans, of those that are its own."""
        text, starts = pc.fill_null(self.text, ""), self.starts
        if own is not None:
            text, starts = text.filter(pa.array(own)), np.concatenate([[0], np.cumsum(own)])[starts]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), text), "")


def strip(text: pa.Array) -> pa.Array:
    return pc.utf8_trim(text, SPACES)


def font_family(font: str | None) -> str | None:
    if font is None:
        return None
    name = font.split("+")[-1]
    found = re.match(r"[A-Za-z]+?(?=[0-9]|-|$)", name)
    return found.group() if found else name


def body_fonts(lines: Lines) -> list[str | None]:
    """The family of most stripped characters of each document; ties go to the one met first, documents without any have none."""
    families = list(dict.fromkeys(map(font_family, lines.fonts)))
    of_font = np.array([families.index(font_family(f)) for f in lines.fonts])
    family, line = of_font[lines.font], lines.line
    n = np.asarray(pc.fill_null(pc.utf8_length(strip(lines.text)), 0), dtype=np.int64)
    doc = lines.doc[line]
    weight = np.bincount(doc * len(families) + family, weights=n, minlength=lines.n_docs * len(families)).reshape(lines.n_docs, -1)
    most = weight.max(axis=1)
    best = weight.argmax(axis=1)
    for d in np.flatnonzero(((weight == most[:, None]).sum(axis=1) > 1) & (most > 0)):
        own = np.flatnonzero((doc == d) & (n > 0) & (weight[d] == most[d])[family])
        at = line[own]
        best[d] = family[own[np.lexsort((lines.span_no[own], lines.line_id[at], lines.x0[own], lines.y0[own], lines.page[at]))[0]]]
    return [families[b] if m > 0 else None for b, m in zip(best, most, strict=True)]


def is_math(lines: Lines, body: list[str | None]) -> np.ndarray:
    """Of each span: a mathematical character, or a mathematical font other than its document's.  A null text or font has none."""
    families = [font_family(f) for f in lines.fonts]
    formal = np.array([f is not None and bool(FORMAL.match(f)) for f in families])[lines.font]
    known = {f: k for k, f in enumerate(dict.fromkeys([*families, *body]))}
    other = np.array([known[f] for f in families])[lines.font] != np.array([known[f] for f in body])[lines.doc[lines.line]]
    return formal & other | np.asarray(pc.fill_null(pc.match_substring_regex(lines.text, SYMBOL), False), dtype=bool)


def formula_only(text: pa.Array) -> np.ndarray:
    """structure.formula_only() of each text."""
    lower = pc.utf8_lower(text)
    found = ~np.asarray(pc.match_substring_regex(lower, HOPELESS), dtype=bool)
    some = np.flatnonzero(found)
    letters = pc.replace_substring_regex(lower.take(pa.array(some)), "[^a-zà-ÿ]", "")
    hopeful = np.asarray(pc.match_substring_regex(letters, HOPEFUL), dtype=bool)
    found[some] = [h and only_formula_words(letters[i].as_py()) for i, h in enumerate(hopeful)]
    return found


def line_kinds(lines: Lines, math: np.ndarray) -> dict[str, pa.Array]:
    """structure.line_kinds() of each line, by name, and its text."""
    text = lines.joined()
    real = math.copy()
    if math.any():
        real[math] = ~np.asarray(pc.fill_null(pc.match_substring_regex(lines.text.filter(pa.array(math)), PUNCTUATION), False), dtype=bool)
    has_math = lines.each(np.logical_or, math)
    left = np.flatnonzero(has_math)
    rest = strip(pc.utf8_ltrim(strip(lines.joined(~math).take(pa.array(left))), X.BULLETS))
    pure = has_math.copy()
    pure[left] = np.asarray(pc.less(pc.utf8_length(rest), 3), dtype=bool) | formula_only(rest)
    some, right = lines.each(np.logical_or, real), lines.each(np.fmax, lines.x1)
    return {
        "x0": pa.array(lines.each(np.minimum, lines.x0)), "y0": pa.array(lines.each(np.minimum, lines.y0)), "x1": pa.array(right, mask=np.isnan(right)), "y1": pa.array(lines.each(np.maximum, lines.y1)),
        "has_math": pa.array(has_math), "pure": pa.array(pure), "bullet": pc.match_substring_regex(pc.utf8_ltrim(text, SPACES), LEAD),
        "math_x0": pa.array(lines.each(np.minimum, np.where(real, lines.x0, np.inf)), mask=~some), "math_x1": pa.array(lines.each(np.maximum, np.where(real, lines.x1, -np.inf)), mask=~some), "text": text,
    }
