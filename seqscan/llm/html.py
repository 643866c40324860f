"""HTML extraction: a tree with implied tags, rendered as the text a reader would see, in blocks, lists and tables."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript datalist iframe object audio video canvas svg noembed noframes dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tr ul tbody thead tfoot".split())
#: Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
#: A start tag closes open elements of these names, up to the nearest of those that bound it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Blocks that end an open paragraph.
ENDS_P = BLOCK - {"option", "optgroup", "html", "body", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: A paragraph can't be ended, nor an end tag reach, beyond these.
SCOPE = frozenset("td th table caption button object template".split())
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
KEPT_SPACE = re.compile(r"(?:^|;)\s*white-space\s*:\s*(pre|pre-wrap|break-spaces|normal|nowrap|pre-line)\s*(?:;|!|$)", re.I)
#: Columns and rows that a cell may span, as browsers have it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element. `shown` and `kept`: whether its own text is visible and keeps white space, None as its parent's is."""

    __slots__ = ("children", "kept", "seen", "shown", "span", "tag", "value")

    def __init__(self, tag: str):
        self.tag, self.seen, self.value, self.children = tag, tag not in HIDDEN, "", []
        self.shown, self.kept, self.span = None, True if tag == "pre" else None, (1, 1)


def element(tag: str, attributes: str) -> Node:
    """An element as its attributes have it: what is not displayed is not seen, with all that is in it."""
    node = Node(tag)
    if not attributes.strip():
        return node
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), unescape(a or b or c))
    style = found.get("style", "")
    node.seen = node.seen and "hidden" not in found and not NO_DISPLAY.search(style)
    if tag == "dialog":
        node.seen = "open" in found
    if m := VISIBILITY.search(style):
        node.shown = m[1].lower() == "visible"
    if m := KEPT_SPACE.search(style):
        node.kept = m[1].lower() in ("pre", "pre-wrap", "break-spaces")
    if tag == "input" and found.get("type", "").lower() == "hidden":
        node.seen = False
    if tag in ("ol", "li"):
        node.value = found.get("start", found.get("value", ""))
    if tag == "details":
        node.value = "open" if "open" in found else ""
    if tag in ("td", "th"):
        number = lambda name, most: min(int(m[0]), most) if (m := re.match(r"\d{1,9}", found.get(name, "").strip())) else 1
        node.span = (max(1, number("colspan", MOST_COLUMNS)), number("rowspan", MOST_ROWS))
    return node


def tree(html: str) -> Node:
    """The document's elements; missing start and end tags are implied, unknown and unmatched ones do no harm."""
    root = Node("#root")
    stack, at = [root], 0
    open_now: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a name are

    def push(node: Node) -> None:
        open_now[node.tag].append(len(stack))
        stack[-1].children.append(node)
        stack.append(node)

    def end_from(i: int) -> None:
        while len(stack) > i:
            open_now[stack.pop().tag].pop()

    def nearest(names: Iterable[str]) -> int:
        """The place of the innermost open element of some names, 0 if there is none."""
        return max((open_now[n][-1] for n in names if open_now.get(n)), default=0)

    def close(names: set[str] | frozenset[str], bounds) -> None:
        """End the open elements from the outermost of `names` on, within the nearest of `bounds`."""
        if not nearest(names):
            return
        bound = nearest(bounds)
        within = [own[k] for n in names if (own := open_now.get(n)) and (k := bisect_right(own, bound)) < len(own)]
        if within:
            end_from(min(within))

    def text(piece: str) -> None:
        if piece:
            if stack[-1].tag in ("table", "tr", "tbody", "thead", "tfoot") and not piece.strip():
                return
            stack[-1].children.append(unescape(piece))

    while at < len(html):
        m = TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "p" and not open_now["p"]:
                stack[-1].children.append(Node("p"))
            elif name == "br":
                stack[-1].children.append(Node("br"))
            elif name not in ("body", "html") and open_now[name]:
                place = open_now[name][-1]
                beyond = () if name in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else SCOPE
                # The end of a mark-up within lines leaves blocks open.
                if place >= nearest(beyond) and (name in BLOCK or place >= nearest(BLOCK)):
                    end_from(place)
        elif m[2]:
            name = m[2].lower()
            if name in ("html", "body") and open_now[name]:
                continue
            if name in ENDS_P:
                close({"p"}, SCOPE)
            if name in CLOSES:
                close(*CLOSES[name])
            elif stack[-1].tag == "head" and name not in ("title", "meta", "link", "style", "script", "base", "template", "noscript"):
                end_from(len(stack) - 1)
            if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(Node("tr"))
            if name.startswith("h") and len(name) == 2 and name[1].isdigit() and re.fullmatch("h[1-6]", stack[-1].tag):
                end_from(len(stack) - 1)
            node = element(name, m[3])
            if name in RAW:
                stack[-1].children.append(node)
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                body = html[at : end.start() if end else len(html)]
                node.children.append(unescape(body) if name in ("textarea", "title") else body)
                at = end.end() if end else len(html)
            elif name in VOID:
                stack[-1].children.append(node)
            else:
                push(node)
    return root


class Lines:
    """Text being laid out: white space collapses, blocks begin on new lines, spaced ones after an empty line."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False
        self.mark, self.mark_at = "", 0
        self.indent: list[str] = []

    def add(self, text: str, kept: bool = False) -> None:
        if kept:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.put(first)
            for line in rest:
                self.end(True)
                self.put(line)
            return
        words = SPACE.split(text)
        for i, w in enumerate(words):
            if w:
                if (self.space or i) and self.now:
                    self.now.append(" ")
                self.space = False
                self.put(w)
        if len(words) > 1 and not words[-1] and self.now:
            self.space = True

    def put(self, text: str) -> None:
        if text:
            if not self.now:
                if self.gap and self.lines:
                    self.lines.append("")
                self.gap = False
                self.now.append("".join(self.mark if self.mark and i == self.mark_at else x for i, x in enumerate(self.indent)))
                self.mark = ""
            self.now.append(text)

    def item(self, mark: str) -> None:
        """The next line begins with `mark`, those after it under its text."""
        self.mark, self.mark_at = mark, len(self.indent)
        self.indent.append(" " * len(mark))

    def end(self, empty: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
        elif empty and self.lines:
            self.lines.append("")
        self.now, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap |= spaced

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def width_of(text: str) -> int:
    """Columns on a screen: wide characters take two, marks that combine none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


#: A line wider than this runs over its column; a cell further than this from what is before it is moved next to that.
WIDEST, FURTHEST = 80, 320
#: Beyond all columns and rows.
FAR = 1 << 62


def mark(borders: list[int], a: int, b: int, member: bool) -> None:
    """Put a to b in or out of a set of numbers, kept as the sorted borders of its runs."""
    i, j = bisect_left(borders, a), bisect_right(borders, b)
    borders[i:j] = [x for x, at in ((a, i), (b, j)) if at % 2 != member]


def placed(rows: list[list[tuple[str, tuple[int, int]]]]) -> list[dict[int, tuple[str, int]]]:
    """Of each row the cells (text, columns spanned) by column; cells from rows above push later ones to the right.

    What cells above take is kept in runs of columns, so that a row costs by its own cells, whatever hangs down over it.
    """
    free = [0, FAR]
    starts, until = [0], [0]  # from each of these columns to the next: the first row that cells above leave free
    ends: list[tuple[int, int, int]] = []
    out = []
    for r, row in enumerate(rows):
        while ends and ends[0][0] <= r:
            _, a, b = heappop(ends)
            i = bisect_right(starts, a) - 1
            while i < len(starts) and starts[i] < b:
                if until[i] <= r:
                    mark(free, max(a, starts[i]), min([b, *starts[i + 1 : i + 2]]), True)
                i += 1
        here, at, down = {}, 0, []
        for text, (wide, high) in row:
            i = bisect_right(free, at)
            if i % 2 == 0:
                at = free[i]
            here[at] = (text, wide)
            if high != 1:
                down.append((r + high if high else FAR, at, at + wide))
            at += wide
        out.append(here)
        for last, a, b in down:
            mark(free, a, b, False)
            heappush(ends, (last, a, b))
            i, j = bisect_right(starts, a) - 1, bisect_left(starts, b)
            runs = [(a, max(until[i], last)), *((s, max(u, last)) for s, u in zip(starts[i + 1 : j], until[i + 1 : j], strict=True))]
            if j == len(starts) or starts[j] > b:
                runs.append((b, until[j - 1]))
            i += starts[i] < a
            before = until[i - 1] if i else None
            runs = [(s, u) for (s, u), (_, v) in zip(runs, [(0, before), *runs], strict=False) if u != v]
            starts[i:j], until[i:j] = [s for s, _ in runs], [u for _, u in runs]
    return out


def aligned(rows: list[list[tuple[str, tuple[int, int]]]]) -> list[str]:
    """Rows of cells (text, columns and rows spanned) as lines, columns as wide as their widest line of up to WIDEST.

    One rule for tables of any size: a cell stands at its column, or right behind a line that has run over it. Columns are
    passed by blanks and a bar each, but for ways of over FURTHEST: without blanks or, past too many columns, by one bar, the
    rest of the line moved along. So lines take room by the cells on them, not by the table. Columns taken from above are
    left out where no two rows have text in one column.
    """
    found = [here for here in placed(rows) if any(text.strip() for text, _ in here.values())]
    columns = sorted({k for here in found for k in here})  # others take no room
    number = {k: c for c, k in enumerate(columns)}
    grid, filled = [], Counter()
    for here in found:
        row = [(number[k], bisect_left(columns, k + n), [(line, width_of(line)) for line in text.split("\n")]) for k, (text, n) in here.items()]
        grid.append(row)
        filled.update(c for c, _, lines in row if any(w for _, w in lines))
    lined = max(filled.values(), default=0) > 1
    width = [0] * len(columns)
    for spanned in (False, True):
        for row in grid:
            for c, end, lines in row:
                if (end - c > 1) == spanned:
                    need = max((w for _, w in lines if w <= WIDEST), default=0) - sum(width[c:end]) - 3 * (end - c - 1)
                    width[end - 1] += max(need, 0)
    place = [0]
    for w in width:
        place.append(place[-1] + w + 3)
    out = []
    for row in grid:
        own = {c: end for c, end, _ in row}
        parts: defaultdict[int, list[tuple[int, str, int]]] = defaultdict(list)
        for c, _, lines in row:
            for i, (text, wide) in enumerate(lines):
                if text.strip():
                    parts[i].append((c, text, wide))
        for i in sorted(parts):
            line, at, x = [], 0, 0  # what is written, where in the table that is, the column it has got to
            for c, text, wide in parts[i]:
                bars = [x] if line else []
                for _ in range(FURTHEST // 3):
                    if x == c:
                        break
                    if x in own or lined:
                        bars.append(own.get(x, x + 1))
                    x = own.get(x, x + 1)
                if x != c:
                    bars = bars[:1] if line else []
                far = x != c or place[c] - at > FURTHEST
                for b in bars:
                    blanks = 0 if far else max(place[b] - 3 - at, 0)
                    line.append(" " * blanks + " | ")
                    at += blanks + 3
                if far or not lined:
                    at = max(at, place[c])
                line.append(text)
                at, x = at + wide, own[c]
            out.append("".join(line))
    return out


def render(html: str | None) -> str:
    """All visible text of a page. Elements are walked with a stack, so nesting may be as deep as it likes."""
    out = Lines()
    writers, tables, lists = [out], [], []
    shown, kept = [True], [False]
    todo: list[tuple[Node | str, bool]] = [(tree(html or ""), True)]
    while todo:
        node, enter = todo.pop()
        out = writers[-1]
        if isinstance(node, str):
            if shown[-1]:
                out.add(node, kept[-1])
            continue
        tag = node.tag
        if enter:
            if not node.seen:
                continue
            if tag == "br":
                out.end(True)
                continue
            if tag in BLOCK:
                out.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, int(node.value) if re.fullmatch(r"-?\d{1,9}", node.value) else 1])
            elif tag == "li":
                ordered = bool(lists) and lists[-1][0] == "ol"
                if ordered and re.fullmatch(r"-?\d{1,9}", node.value):
                    lists[-1][1] = int(node.value)
                out.item(f"{lists[-1][1]}. " if ordered else "- ")
                if ordered:
                    lists[-1][1] += 1
            elif tag == "blockquote":
                out.indent.append("> ")
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                writers.append(Lines())
            shown.append(shown[-1] if node.shown is None else node.shown)
            kept.append(kept[-1] if node.kept is None else node.kept)
            children = node.children
            if tag == "details" and not node.value:  # closed: its summary only
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            todo.append((node, False))
            todo.extend((c, True) for c in reversed(children))
            continue
        shown.pop()
        kept.pop()
        if tag in ("td", "th") and tables:
            tables[-1][-1].append((writers.pop().text(), node.span))
            continue
        if tag in BLOCK:
            out.end()
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("li", "blockquote"):
            out.indent.pop()
            out.mark = ""
        elif tag == "table" and tables:
            for line in aligned(tables.pop()):
                out.put(line)
                out.end()
        if tag in BLOCK:
            out.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
    return out.text()


def extract(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, html) -> (page_id, text), row for row. Null or empty HTML gives an empty text.

    Repeated rows give the same text, an empty table an empty result; other columns are not looked at. A page's tree takes
    memory in proportion to the page, however long or deep.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8 << 20):
            texts = [render(None if h is None else h.decode("utf-8", "replace")) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("binary").alias("html")).mapInArrow(run, "page_id long, text string")


def op1(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
