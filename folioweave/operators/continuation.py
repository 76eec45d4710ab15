"""Lines of a formula that go on in the line above or below.  Merges follow each other, so a page's spans are one group of a grouped map."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from folioweave.functions import text as X

from .structure import FORMULA_WORDS, longest_first

# Fixed values of the continuation rules.
INSIDE, PROSE_OVERLAP, BULLET_GAP, LINE_OVERLAP = 0.8, 3.0, 12.0, 1.0
PUNCTUATION = frozenset(",.;:!?·、。，；：！？…'\"“”‘’")
NUMBERED = re.compile(r"[0-9]{1,2}[.)、]\s")
LETTER = re.compile("[A-Za-zÀ-ÿ]")
LONGEST_FIRST = longest_first(FORMULA_WORDS)
RESULT = "doc_id long, page int, line_id int, span_no int, host int"


def only_formula_words(text: str) -> bool:
    left, before = re.sub("[^a-zà-ÿ]", "", text.lower()), None
    while left and left != before:
        before = left
        for word in LONGEST_FIRST:
            left = left.replace(word, "")
    return not left


@dataclass
class Line:
    """spans are (x0, y0, span_no, text, is_math, x1, y1, line_id), from left to right."""

    host: int
    spans: list[tuple]
    box: tuple[float, float, float, float] = field(init=False)
    pure: bool = field(init=False)
    bullet: bool = field(init=False)
    formula: tuple[float, float] | None = field(init=False)

    def __post_init__(self) -> None:
        self.box = (min(s[0] for s in self.spans), min(s[1] for s in self.spans), max(s[5] for s in self.spans), max(s[6] for s in self.spans))
        maths = [s for s in self.spans if s[4]]
        real = [s for s in maths if not s[3].strip() or set(s[3].strip()) - PUNCTUATION]
        self.formula = (min(s[0] for s in real), max(s[5] for s in real)) if real else None
        lead = "".join(s[3] for s in self.spans).lstrip()
        self.bullet = not lead or lead[0] in X.BULLETS or bool(NUMBERED.match(lead))
        rest = "".join(s[3] for s in self.spans if not s[4]).strip().lstrip(X.BULLETS).strip()
        self.pure = bool(maths) and (len(rest) < 3 or only_formula_words(rest))

    def takes_up(self, other: Line) -> bool:
        """Whether the other line, a formula, lies in this line's formula, beside its words, and near enough."""
        x0, y0, x1, y1 = other.box
        if self.formula is None or min(x1, self.formula[1]) - max(x0, self.formula[0]) <= INSIDE * (x1 - x0):
            return False
        words = (s for s in self.spans if not s[4] and LETTER.search(s[3]))
        if any(min(x1, s[5]) - max(x0, s[0]) > PROSE_OVERLAP for s in words):
            return False
        if self.bullet:
            return max(y0 - self.box[3], self.box[1] - y1) <= BULLET_GAP
        return min(y1, self.box[3]) - max(y0, self.box[1]) > LINE_OVERLAP


def merged_lines(lines: list[Line]) -> list[Line]:
    """lines from top to bottom; each formula without a bullet joins the line above that takes it up, else the one below, until none does."""
    lines, at = list(lines), 0
    while at < len(lines):
        own = lines[at]
        found = None
        if own.pure and not own.bullet:
            found = next((k for k in (at - 1, at + 1) if 0 <= k < len(lines) and lines[k].takes_up(own)), None)
        if found is None:
            at += 1
            continue
        lines[found] = Line(lines[found].host, sorted(lines[found].spans + own.spans, key=lambda s: s[:2]))
        del lines[at]
        at = max(0, at - 1)  # what stood above may go on in the longer line
    return lines


def continuation_merge(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line_id, span_no, host) of spans with is_math: the line that each span's line has become part of; most are their own.

    Null texts count as empty; spans without a line_id stand in no line and stay out.  Lines go by (y0, x0, line_id), spans of a line by (span_no, x0); rows that are the same stay.
    """

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(text=rows["text"].fillna("")).dropna(subset=["line_id"]).sort_values(["line_id", "span_no", "x0"])
        columns = ["x0", "y0", "span_no", "text", "is_math", "x1", "y1", "line_id"]
        if rows.empty:
            return pd.DataFrame(columns=["doc_id", "page", "line_id", "span_no", "host"])
        lines = [Line(int(n), list(own[columns].itertuples(index=False, name=None))) for n, own in rows.groupby("line_id")]
        merged = merged_lines(sorted(lines, key=lambda line: (line.box[1], line.box[0], line.host)))
        out = pd.DataFrame([(s[7], s[2], line.host) for line in merged for s in line.spans], columns=["line_id", "span_no", "host"])
        return out.assign(doc_id=rows["doc_id"].iloc[0], page=rows["page"].iloc[0])[["doc_id", "page", "line_id", "span_no", "host"]]

    needed = spans.select("doc_id", "page", "line_id", "span_no", "text", "is_math", "x0", "y0", "x1", "y1")
    return needed.groupBy("doc_id", "page").applyInPandas(page, RESULT)
