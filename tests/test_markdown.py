"""Markdown pages and token streams against plain loops, on lines that no recipe orders: merged, malformed, blank, null."""

from __future__ import annotations

import json
import random
import re

from folioweave.operators import markdown as M
from folioweave.operators import units as U

LINES = (
    "", "  ", "\t", "# One", "## Two ", "#### Four", "##### not a heading", "#also not", "#\tTab", "- item", "* starred **bold**", "  - nested", "-no item", "*no item*", "> caption", "  > moved caption", ">",
    "$$x^2$$", "$$", r"\[a < b\]", r"\[", "plain text", "  led by blanks", "two $a_1$ and $b$ here", "a `code` & <tag>", "**a** and **b", "中文 行", "1. numbered", "---",
)


def plain_blocks(md: str) -> list[tuple[str, int, str, bool]]:
    """(kind, level, text, whether it stands right behind the block before) line by line."""
    out, paragraph, near = [], [], False

    def close() -> None:
        nonlocal near
        if paragraph:
            out.append(("para", 0, " ".join(paragraph), near))
            paragraph.clear()
            near = True

    for line in md.split("\n"):
        line = line.rstrip()
        if not line:
            close()
            near = False
            continue
        marks = len(line) - len(line.lstrip("#"))
        rest = line.lstrip()
        if 1 <= marks <= 4 and line[marks : marks + 1].isspace():
            new = ("heading", marks, line[marks:].strip())
        elif rest[0] in "-*" and rest[1:2].isspace():
            new = ("item", 0, rest[1:].lstrip())
        elif rest[0] == ">":
            new = ("caption", 0, rest[1:].strip())
        elif line.startswith(("$$", r"\[")):
            new = ("display", 0, line.strip("$").replace(r"\[", "").replace(r"\]", ""))
        else:
            paragraph.append(line.strip())
            continue
        close()
        out.append((*new, near))
        near = True
    close()
    return out


def plain_html(md: str) -> str:
    def inline(s: str) -> str:
        s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        for pattern, mark in ((r"\*\*(.+?)\*\*", "strong"), (r"`(.+?)`", "code")):
            s = re.sub(pattern, rf"<{mark}>\1</{mark}>", s)
        s = re.sub(r"\$\$(.+?)\$\$", lambda m: rf"\[{m[1]}\]", s)
        return re.sub(r"(?<!\\)\$([^$\n]+?)\$", lambda m: rf"\({m[1]}\)", s)

    made = plain_blocks(md)
    out = []
    for n, (kind, level, text, near) in enumerate(made):
        if kind == "item" and not (n and near and made[n - 1][0] == "item"):
            out.append("<ul>")
        wrap = {"heading": (f"<h{level}>", f"</h{level}>"), "item": ("<li>", "</li>"), "caption": ('<p class="figcap">', "</p>"), "para": ("<p>", "</p>"), "display": (r'<div class="disp">\[', r"\]</div>")}[kind]
        out.append(wrap[0] + (text if kind == "display" else inline(text)) + wrap[1])
        if kind == "item" and not (n + 1 < len(made) and made[n + 1][3] and made[n + 1][0] == "item"):
            out.append("</ul>")
    return "\n".join(out)


def test_pages_equal_a_plain_loop(spark):
    r = random.Random(7)
    pages = [(n % 5, n, "\n".join(r.choice(LINES) for _ in range(r.randint(0, 14)))) for n in range(250)]
    df = spark.createDataFrame([*pages, (9, 0, None), (9, 1, "")], "doc_id long, page int, md string")
    found: dict = {}
    for b in sorted(M.blocks(df).collect(), key=lambda b: (b.page, b.block)):
        found.setdefault((b.doc_id, b.page), []).append((b.kind, b.level, b.text))
    assert found == {(d, p): [b[:3] for b in plain_blocks(md)] for d, p, md in pages if plain_blocks(md)}
    html = {(h.doc_id, h.page): h.html for h in M.page_html(M.blocks(df)).collect()}
    assert html == {(d, p): plain_html(md) for d, p, md in pages if plain_blocks(md)}


def test_blocks_by_hand(spark):
    cases = {
        "one\ntwo\n\nthree": [("para", 0, "one two"), ("para", 0, "three")],
        "* a\n- b\n\n- c": [("item", 0, "a"), ("item", 0, "b"), ("item", 0, "c")],
        "#### deep\n##### too deep": [("heading", 4, "deep"), ("para", 0, "##### too deep")],
        r"\[x+y\]": [("display", 0, "x+y")],
    }
    df = spark.createDataFrame([(1, n, md) for n, md in enumerate(cases)], "doc_id long, page int, md string")
    got: dict = {}
    for b in sorted(M.blocks(df).collect(), key=lambda b: (b.page, b.block)):
        got.setdefault(b.page, []).append((b.kind, b.level, b.text))
    assert got == dict(enumerate(cases.values()))
    html = {h.page: h.html for h in M.page_html(M.blocks(df)).collect()}
    assert html[1] == "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ul>\n<li>c</li>\n</ul>"


def test_malformed_events_are_passed_over(spark):
    delta = lambda text: "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})
    lines = [
        ("a", [delta("Hel"), ": keep-alive", "", "data: {broken", "data: []", 'data: {"choices": []}', 'data: {"choices": [{"delta": {}}]}', "data:" + delta("lo")[6:], delta(" \n"), "event: x", "data: [DONE]", delta("late")]),
        ("b", [delta("no end")]), ("c", ["data: [DONE]"]), ("d", [None, "data: null", "data: 5", delta("é"), "data: [DONE]"]),
    ]
    rows = [(r, n, None, line) for r, ls in lines for n, line in enumerate(ls)]
    random.Random(1).shuffle(rows)
    found = {r.request_id: (r.text, r.finished) for r in U.assemble_events(spark.createDataFrame(rows, "request_id string, seq int, ts timestamp, line string")).collect()}
    assert found == {"a": ("Hello \nlate", True), "b": ("no end", False), "c": ("", True), "d": ("é", True)}
