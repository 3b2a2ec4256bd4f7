"""Main text of HTML pages by composite text density.

Every node of the DOM has C characters, T tags, LC link characters and LT link
tags below it.  Its density is C/T * log_b((C/LC) * (T/LT)) with
b = ln(C/(C-LC) * LC + LC_body/C_body * C + e): characters per tag, lowered where
links prevail.  The node with the largest sum of its children's densities is the
content; the smallest density on the path from the body to it is the threshold below which
subtrees inside it (menus, share bars) are left out.

The parser keeps the rules that matter for real pages: void elements, raw text of
scripts and styles, skipped elements (svg, iframe, noscript, template; empty if self-closed svg or without an end tag of their own), comments, optional end tags of p, li, td and the like, unclosed
and crossed tags.  Pages never fail; what can't be a tag is text: a "<" ends an unfinished tag before it, and a quote that isn't
closed is a character like others.  Nothing is scanned twice, so the time grows with the length of the page, whatever is in it.

Defined results: null html gives null text; empty html, and pages without text, give ''.
Ties in the density sum go to the node that comes first.  Pages of any length are parsed whole.
Repeated rows each have their result.  Only page_id and html are read, whatever other columns are called.  An empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import tidy

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^'"<>]++|"[^"]*+"|'[^']*+')*+)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
PLAIN = re.compile(r"""[^'"<>]*+""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
#: Elements that are left out whole.
SKIPPED = frozenset(("noscript", "template", "iframe", "svg"))
BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: Opening one of these ends an open one of its set, within the nearest of the given ancestors.
ENDS = {
    **dict.fromkeys("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), (frozenset(["p"]), frozenset("body td th li article section div".split()))),
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}
SPACES = re.compile(r"[ \t\r\f\v ]*\n\s*|[ \t\r\f\v ]+")


class Scanner:
    """Finds the tags of a page one after the other."""

    def __init__(self, source: str):
        self.source, self.plain, self.closing = source, True, {'"': True, "'": True}  # whether a quote may still be closed, both of them and each

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it is an end tag, name ("" for comments and declarations) and attributes of the next tag from `at` on."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if self.plain and (m := TAG.match(source, at)):
                return at, m.end(), m[1] != "", m[2].lower(), m[3]
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(source), False, "", ""
            if source.startswith(("<!", "<?"), at):
                end = source.find(">", at)
                if end < 0:
                    return None
                return at, end + 1, False, "", ""
            m = NAME.match(source, at)
            if m is None:
                at += 1
                continue
            end = self._attributes(m.end())
            if end < len(source) and source[end] == ">":
                return at, end + 1, bool(m[1]), m[2].lower(), source[m.end() : end]
            at = end
        return None

    def _attributes(self, at: int) -> int:
        """Where attributes that begin at `at` end: at a ">" or "<" outside quotes, or with the page."""
        source = self.source
        while True:
            at = PLAIN.match(source, at).end()
            if at == len(source) or source[at] in "<>":
                return at
            q = source[at]
            end = source.find(q, at + 1) if self.closing[q] else -1
            if end < 0:
                self.plain = self.closing[q] = False
            at = end + 1 if end >= 0 else at + 1


def _ends(source: str, name: str) -> dict[int, int]:
    """For every opening tag of this name, by the place behind it, the place behind its own end tag; those without one are missing."""
    ends, opened, scanner, at = {}, [], Scanner(source), 0
    while found := scanner.next(at):
        _, at, closes, what, attributes = found
        if what != name:
            continue
        if closes:
            if opened:
                ends[opened.pop()] = at
        elif not (name == "svg" and attributes.endswith("/")):
            opened.append(at)
    return ends


class Tree:
    """Nodes in document order: tag, parent, and the text pieces (node, text) between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.pieces, self.body = ["#root"], [-1], [], 0
        tag, parent, pieces = self.tag, self.parent, self.pieces
        stack, at, scanner = [0], 0, Scanner(source)
        open_at: dict[str, list[int]] = {}  # places in the stack by tag
        ends: dict[str, dict[int, int]] = {}

        def add(text: str) -> None:
            if text.strip():
                pieces.append((len(tag), stack[-1], entities.unescape(text) if "&" in text else text))

        def close(k: int) -> None:
            while len(stack) > k:
                open_at[tag[stack.pop()]].pop()

        def last(names) -> int:
            return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

        while True:
            found = scanner.next(at)
            if found is None:
                add(source[at:])
                break
            start, end, closes, name, attributes = found
            if start > at:
                add(source[at:start])
            at = end
            if not name:
                continue
            if closes:
                if open_at.get(name):
                    close(open_at[name][-1])
                continue
            if name == "body" and self.body:
                continue
            if name in ENDS:
                ended, within = ENDS[name]
                k = last(ended)
                if k and k >= last(within):
                    close(k)
            tag.append(name)
            parent.append(stack[-1])
            if name == "body":
                self.body = len(tag) - 1
            if name in RAW:
                raw = RAW[name].search(source, at)
                at = raw.end() if raw else len(source)
            elif name in SKIPPED:
                if name not in ends:
                    ends[name] = _ends(source, name)
                at = ends[name].get(at, at)
            elif name not in VOID and not attributes.endswith("/"):
                open_at.setdefault(name, []).append(len(stack))
                stack.append(len(tag) - 1)


def extract(source: str) -> str:
    """The main text of a page."""
    tree = Tree(source)
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for _, at, text in tree.pieces:
        chars[at] += len(" ".join(text.split()))
    for i in range(n - 1, 0, -1):
        if tag[i] == "a":
            links[i], link_tags[i] = chars[i], link_tags[i] + 1
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i]
    root = tree.body
    share = links[root] / max(chars[root], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], max(tags[i], 1), links[i], link_tags[i]
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            ratio = (c / max(lc, 1)) * (t / max(lt, 1))
            density[i] = c / t * (math.log(ratio) / math.log(base) if base > 1 + 1e-9 else math.log(ratio))
        if i:
            total[parent[i]] += density[i]
    inside = [False] * n
    for i in range(n):
        inside[i] = i == root or (i > 0 and inside[parent[i]])
    best = max((i for i in range(n) if inside[i]), key=lambda i: (total[i], -i))
    if not total[best]:
        best = root
    low, i = density[best], best
    while i != root:
        i = parent[i]
        low = min(low, density[i])
    take = [False] * n
    for i in range(best, n):
        take[i] = i == best or (i > best and take[parent[i]] and (density[i] >= low or not chars[i] or tag[i] not in BLOCK))
    block = [0] * n  # the nearest enclosing block
    for i in range(1, n):
        block[i] = i if tag[i] in BLOCK else block[parent[i]]
    out, seen, last = [], best, best
    for before, at, text in tree.pieces:
        if not take[at]:
            continue
        if block[at] != block[last] or any(tag[k] in BLOCK for k in range(max(seen, best + 1), before)):
            out.append("\n")
        seen, last = before, at
        out.append(text)
    return SPACES.sub(lambda m: "\n" if "\n" in m[0] else " ", "".join(out)).strip()


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, main_text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else extract(x) for x in batch.column(1).to_pylist()], pa.string())], names=["page_id", "main_text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInArrow(tidy(run), f"page_id {kind}, main_text string")
