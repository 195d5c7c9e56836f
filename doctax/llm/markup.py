"""Markup residue: HTML, Markdown, wiki and LaTeX texts to clean text with its structure kept.

Pages of one host share a wrapper (navigation, headers, footers). It is induced: the DOM tree of every page is
aligned with the trees of seed pages of its host by simple tree matching, which finds the largest order-
and ancestor-keeping mapping of nodes with equal tags. The seeds hold every text node that enough pages have, and every frequent layout. Text nodes that are mapped again and again with the same
words are template and fall away; nodes whose words vary are slots and become content. A language counts if the template
or the content has a mark of it; what two languages share is read by the content alone.

Then each language's marks are read and rewritten in one plain notation: ``# `` before headings, ``- `` before
list items, ``| `` between table cells, ``` around code, ``$`` around formulas. What stands in code or verbatim
samples isn't read as markup. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import html
import html.entities
import html.parser
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .splits import canonical_source

LANGUAGES = ("html", "markdown", "wiki", "latex")
#: A text node is template if it is mapped with the same words in at least so many pages, this share of the host's
#: pages, and this share of the pages in which it is mapped at all.
TEMPLATE_PAGES, TEMPLATE_SHARE, TEMPLATE_EQUAL = 3, 0.05, 0.5
#: Bytes of seeds or templates of all hosts that may be sent to every task; beyond, each page row carries those of its host.
SENT_BYTES = 32 << 20
#: Two rows of children whose lengths have a larger product are aligned without the whole table: about so many of its rows
#: at a time are kept, and the others worked out again. The mapping is the same.
FULL_ROWS, BAND = 1_000_000, 256
#: Pairs of shapes whose mapping sizes are kept at once.
MEMO_PAIRS = 1_000_000
#: Elements below so many others are read as children of the last.
DEEPEST = 5000

# HTML elements and attributes without a value.
HTML_TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
    "hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param "
    "picture pre progress q rp rt ruby s samp script section select slot small source span strike strong style sub summary sup svg table tbody td template textarea "
    "tfoot th thead time title tr track tt u ul var video wbr"
)
BARE_ATTRIBUTES = "allowfullscreen async autofocus autoplay border checked compact controls default defer disabled hidden ismap loop multiple muted nomodule noresize noshade novalidate nowrap open readonly required reversed selected"

_ATTRIBUTE = rf"""(?:[A-Za-z_:@][-\w:.]*\s*=\s*(?:"[^"<]*"|'[^'<]*'|[^\s"'=<>`]+)|(?:{BARE_ATTRIBUTES.replace(" ", "|")})(?![\w-]))"""
TAG = re.compile(rf"""<(?:/(?P<close>{HTML_TAGS.replace(" ", "|")})\s*|(?P<open>{HTML_TAGS.replace(" ", "|")})(?:\s+{_ATTRIBUTE})*\s*/?)>|<!DOCTYPE[^<>]*>|<\?xml[^<>]*>""", re.I)
COMMENT = re.compile(r"<!--.*?-->", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")

#: Samples whose inside isn't read: (language of the sample's own marks, pattern with the inside as group "in").
SAMPLES = (
    ("html", re.compile(r"<(?P<t>script|style)\b[^<>]*>(?P<in>.*?)</(?P=t)\s*>", re.I | re.S)),
    ("markdown", re.compile(rf"^[ ]{{0,3}}(?P<f>`{{3,}}|~{{3,}})[^\n`]*\n(?P<in>.*?)^[ ]{{0,3}}(?P=f)[`~]*[ \t]*$", re.S | re.M)),
    ("wiki", re.compile(r"<(?P<t>nowiki|syntaxhighlight|source(?=\s+lang))\b[^<>]*>(?P<in>.*?)</(?P=t)\s*>", re.I | re.S)),
    ("html", re.compile(r"<(?P<t>pre|code|samp|kbd|tt|textarea|xmp)\b[^<>]*>(?P<in>.*?)</(?P=t)\s*>", re.I | re.S)),
    ("latex", re.compile(r"\\begin\{(?P<t>verbatim\*?|lstlisting|minted|Verbatim)\}(?P<in>.*?)\\end\{(?P=t)\}", re.S)),
    ("latex", re.compile(r"\\verb\*?(?P<d>[^\sA-Za-z*])(?P<in>[^\n\r]*?)(?P=d)")),
    ("latex", re.compile(r"\\lstinline(?P<d>[|!+])(?P<in>[^\n\r]*?)(?P=d)")),
    ("markdown", re.compile(r"(?<![`\\])(?P<f>`{1,2})(?!`)(?P<in>[^`\n\r]*[^`\s][^`\n\r]*)(?P=f)(?!`)")),
)
#: Whether a text may have samples of a language.
GUARDS = {"html": lambda t: "<" in t, "wiki": lambda t: "<" in t, "markdown": lambda t: "`" in t or "~~~" in t, "latex": lambda t: "\\" in t}
LATEX_BARE = r"item|maketitle|tableofcontents|noindent|newpage|clearpage|centering|hline|toprule|midrule|bottomrule|par|appendix|bigskip|medskip|smallskip|linebreak|pagebreak|ldots|LaTeX|TeX"
LATEX = (
    re.compile(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n\r]*\])?\{"),
    re.compile(rf"(?<![A-Za-z0-9:\\])\\(?:{LATEX_BARE})(?![A-Za-z_\\0-9])"),
)
FORMULA = (
    re.compile(r"(?<!\\)\$\$(?=[^$]*[A-Za-z\\=^_])[^$]+\$\$"),
    re.compile(r"(?<![\\$\w])\$(?![\s$])(?=[^$\n\r]*[A-Za-z\\=^_<>])(?!\d[\d.,]*\s)[^$\n\r]*?(?<![\s\\])\$(?![\d$\w])"),
    re.compile(r"(?<!\\)\\\((?=[^\n\r]*?\\\)).+?\\\)"),
    re.compile(r"(?<!\\)\\\[.+?\\\]", re.S),
)
#: Marks inside lines: what must stand in the text for the pattern to be tried, and the pattern.
WIKI = (
    ("[[", re.compile(r"\[\[[^\[\]\n|]+(?:\|[^\[\]\n]*)?\]\]")),
    ("''", re.compile(r"(?<!')'{2,3}(?!')(?=\S)[^'\n]+?(?:'(?!')[^'\n]+?)*(?<=\S)'{2,3}(?!')")),
    ("{{", re.compile(r"\{\{[A-Za-z#][^{}$%]*\}\}")),
    ("://", re.compile(r"\[(?:https?|ftp)://[^\s\[\]]+ [^\[\]\n]+\](?!\()")),
    ("<", re.compile(r"<ref\b[^<>]*>|</ref>|<references\s*/?>|<(?:nowiki|syntaxhighlight)\b", re.I)),
    ("__", re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__")),
)
MARKDOWN = (
    ("](", re.compile(r"!?\[[^\[\]\n]*\]\((?!\s)[^()\s]*(?:\s+\"[^\"\n]*\")?\)")),
    ("][", re.compile(r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]")),
    ("[^", re.compile(r"\[\^[\w-]+\]")),
    ("**", re.compile(r"(?<![\*\w\\])\*\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*\*(?![\*\w])")),
    ("__", re.compile(r"(?<![\w_\\])__(?=[^\s_])(?!(?:TOC|NOTOC|FORCETOC)__)[^\n]*?(?<=[^\s_])__(?![\w_])")),
    ("*", re.compile(r"(?<![\*\w\\])\*(?=[^\s*])[^*\n()]*?(?<=[^\s*])\*(?![\*\w])")),
    ("_", re.compile(r"(?<![\w_\\:/.])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])")),
    ("~~", re.compile(r"(?<![~\w\\])~~(?=[^\s~])[^~\n]+?(?<=[^\s~])~~(?![~\w])")),
    ("<", re.compile(r"<(?:https?://|mailto:)[^\s<>]+>")),
)
#: Marks at the beginning of lines; a line is tried if its first character that isn't blank is one of these.
LINE_STARTS = frozenset("#*-+>|=[{_")
WIKI_LINE = re.compile(r"(={1,6})[ \t]*[^=\s].*?[ \t]*\1[ \t]*$|\{\||\|[}\-][ \t]*$")
MARKDOWN_LINE = re.compile(
    r"[ ]{0,3}(?:\#{2,6}[ \t]+\S|\[[^\[\]]+\]:[ \t]*\S|>[ \t]+\S|\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$)|[ \t]*[-+*][ \t]+\[[ xX]\][ \t]"
)
UNDERLINE = re.compile(r"[ ]{0,3}(?:={3,}|-{3,})[ \t]*$")
#: Marks of Markdown and wiki alike: they count for the one that the rest is in.
SHARED_LINE = re.compile(r"[ ]{0,3}(?:\#|\*{1,3})[ \t]+\S|-{4,}[ \t]*$")
LIST_LINE = re.compile(r"[ ]{0,3}(?:[-+][ \t]+\S|(?:\*[ \t]*){3,}$|-{3}[ \t]*$|_{3,}[ \t]*$)")


def masked(text: str) -> tuple[str, list[str], set[str]]:
    """The text with samples replaced by numbered places, the samples, and the languages of their own marks."""
    samples: list[str] = []
    own: set[str] = set()
    for language, pattern in SAMPLES:

        def put(found: re.Match) -> str:
            if language == "html" and found.group("t").lower() not in ("script", "style") and not TAG.match(found.group(0)):
                return found.group(0)
            own.add(language)
            inside = found.group("in")
            if "\x00" in inside:
                inside = re.sub(r"\x00(\d+)\x00", lambda k: samples[int(k.group(1))], inside)
            if language == "html":
                inside = TAG.sub("", inside)  # a code element within a preformatted one
            samples.append("" if (found.groupdict().get("t") or "").lower() in ("script", "style") else inside)
            return f"\x00{len(samples) - 1}\x00"

        if GUARDS[language](text):
            text = pattern.sub(put, text)
    return text, samples, own


def find_marks(text: str) -> set[str]:
    """The languages of which the text has at least one mark."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _marks_of(*masked(text))


def _marks_of(bare: str, _: list[str], own: set[str]) -> set[str]:
    found = set(own)
    if "<" in bare:
        if COMMENT.search(bare) or TAG.search(bare):
            found.add("html")
            bare = TAG.sub(" ", COMMENT.sub(" ", bare))
    if "&" in bare and any(m.group(1) is None or m.group(1) + ";" in html.entities.html5 for m in ENTITY.finditer(bare)):
        found.add("html")
    if "$" in bare or "\\" in bare:
        plain = bare
        for pattern in (*FORMULA, *LATEX):
            bare = pattern.sub(" ", bare)  # formulas and commands hold nothing of the others
        if bare != plain:
            found.add("latex")
    wiki = markdown = shared = listed = False
    above = ""
    for line in bare.split("\n"):
        head = line.lstrip(" \t")[:1]
        if head in LINE_STARTS and head:
            if WIKI_LINE.match(line) and not UNDERLINE.match(line):
                wiki = True
            elif MARKDOWN_LINE.match(line) or (above.strip() and UNDERLINE.match(line)):
                markdown = True
            elif SHARED_LINE.match(line):
                shared = True
            elif LIST_LINE.match(line) and (head in "-+" and line.strip("- ") or not above.strip()):
                listed = True
        above = line
    rest = bare
    for guard, pattern in WIKI:
        if guard in rest and pattern.search(rest):
            wiki = True
            rest = pattern.sub(" ", rest)
    if not markdown:
        markdown = any(guard in rest and pattern.search(rest) for guard, pattern in MARKDOWN)
    if wiki:
        found.add("wiki")
    if markdown or (shared and not wiki):
        found.add("markdown")
    elif listed and not found:
        found.add("markdown")
    return found


# ---------------------------------------------------------------- trees of pages


@dataclass
class Node:
    """An element or, with tag "#text", its words."""

    tag: str
    words: str = ""
    raw: str = ""
    children: list[Node] = field(default_factory=list)
    shape: int = 0
    size: int = 1


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li tr dt dd".split())


class _Builder(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]
        self.gap = False

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):  # pages have them or not; their insides are alike
            return
        for _ in range(3):
            if len(self.stack) > 1 and self.stack[-1].tag in _CLOSES.get(tag, ()):
                self.stack.pop()
            else:
                break
        if tag in _BLOCKS and tag != "li" and len(self.stack) > 1 and self.stack[-1].tag == "p":
            self.stack.pop()
        node = Node(tag, " " if self.gap and tag not in _BLOCKS else "")  # a blank before an inline element stays
        self.gap = False
        self.stack[-1].children.append(node)
        if tag not in _VOID and len(self.stack) < DEEPEST:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                del self.stack[at:]
                return

    def handle_data(self, data):
        self.gap = not data.strip()
        if self.stack[-1].tag not in ("script", "style") and not self.gap:
            self.stack[-1].children.append(Node("#text", re.sub(r"\s+", " ", data), data))


def parse_page(text: str, shapes: dict[tuple, int] | None = None) -> Node:
    """The tree of a page; equal shapes (tags without words) get equal numbers of ``shapes``."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEEPEST))
    builder = _Builder()
    builder.feed(text)
    builder.close()
    shapes = {} if shapes is None else shapes

    def number(node: Node) -> None:
        for child in node.children:
            number(child)
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = shapes.setdefault((node.tag, *(c.shape for c in node.children)), len(shapes))

    number(builder.root)
    return builder.root


def match_trees(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> int:
    """The size of the largest mapping of simple tree matching; it depends on shapes only."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.size
    key = (a.shape, b.shape)
    if (size := memo.get(key)) is None:
        head, tail = _ends(a.children, b.children)
        same = sum(c.size for c in a.children[:head]) + sum(c.size for c in a.children[len(a.children) - tail :])
        size = 1 + same + _best(a.children[head : len(a.children) - tail], b.children[head : len(b.children) - tail], memo)
        if len(memo) >= MEMO_PAIRS:
            memo.clear()
        memo[key] = size
    return size


def _ends(left: list[Node], right: list[Node]) -> tuple[int, int]:
    """How many children have the same shape from the beginning, and of the others from the end: a best mapping has those."""
    most, head, tail = min(len(left), len(right)), 0, 0
    while head < most and left[head].shape == right[head].shape:
        head += 1
    while tail < most - head and left[-1 - tail].shape == right[-1 - tail].shape:
        tail += 1
    return head, tail


def _rows(left: list[Node], right: list[Node], memo: dict) -> list[list[int]]:
    """Row by row the best sizes for the first children of both."""
    rows = [[0] * (len(right) + 1)]
    for x in left:
        above, row = rows[-1], [0]
        for j, y in enumerate(right):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            if x.tag == y.tag:
                weight = above[j] + (x.size if x.shape == y.shape else match_trees(x, y, memo))
                best = weight if weight > best else best
            row.append(best)
        rows.append(row)
    return rows


def _weights(right: list[Node], memo: dict) -> Callable[[Node], np.ndarray]:
    """Gives for a child on the left the sizes of its mappings with each on the right; children of one shape are alike."""
    kinds = {y.shape: y for y in right}
    numbers = {shape: k for k, shape in enumerate(kinds)}
    kind = np.array([numbers[y.shape] for y in right], np.intp)
    known: dict[int, np.ndarray] = {}

    def weigh(x: Node) -> np.ndarray:
        if x.shape not in known:
            if len(known) * len(kinds) > MEMO_PAIRS:
                known.clear()
            known[x.shape] = np.array([match_trees(x, y, memo) for y in kinds.values()], np.int32)
        return known[x.shape][kind]

    return weigh


def _below(above: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The row of best sizes that follows ``above``, as in ``_rows``."""
    row = above.copy()
    np.maximum(above[1:], above[:-1] + weights, out=row[1:])
    return np.maximum.accumulate(row)


def _best(left: list[Node], right: list[Node], memo: dict) -> int:
    """The size of a best mapping of children."""
    if len(left) * len(right) <= FULL_ROWS:
        return _rows(left, right, memo)[-1][-1]
    weigh, row = _weights(right, memo), np.zeros(len(right) + 1, np.int32)
    for x in left:
        row = _below(row, weigh(x))
    return int(row[-1])


def _step(above, row, j: int) -> tuple[int, bool]:
    """How many of the first j on the right are left for the row above, and whether the one after these is mapped."""
    while j:
        if row[j] == above[j]:
            return j, False
        j -= 1
        if row[j + 1] != row[j]:
            return j, True
    return 0, False


def _places(left: list[Node], right: list[Node], memo: dict) -> list[tuple[int, int]]:
    """The places of the pairs of a best mapping of children, from the last."""
    pairs: list[tuple[int, int]] = []

    def back(rows: list, first: int, j: int) -> int:
        for i in range(len(rows) - 1, 0, -1):
            j, pair = _step(rows[i - 1], rows[i], j)
            if pair:
                pairs.append((first + i - 1, j))
        return j

    def part(first: int, end: int, row: np.ndarray, j: int) -> int:
        """Maps the children from ``first`` to ``end``, with ``row`` above them, to the first j; gives how many of these are left."""
        if not j:
            return 0
        every = -(-(end - first) // BAND)
        begins = range(first, end, every)
        row = row[: j + 1]
        kept = [row]
        for i in range(first, end if every == 1 else begins[-1]):
            row = _below(row, weigh(left[i])[:j])
            if (i + 1 - first) % every == 0:
                kept.append(row)
        if every == 1:
            return back(kept, first, j)
        for begin in reversed(begins):
            j = part(begin, min(end, begin + every), kept.pop(), j)
        return j

    if len(left) * len(right) <= FULL_ROWS:
        back(_rows(left, right, memo), 0, len(right))
    else:
        weigh = _weights(right, memo)
        part(0, len(left), np.zeros(len(right) + 1, np.int32), len(right))
    return pairs


def _mapped(left: list[Node], right: list[Node], memo: dict) -> list[tuple[int, Node, Node]]:
    """The pairs of a best mapping of children, with the place on the left."""
    head, tail = _ends(left, right)
    pairs = [(i, left[i], right[i]) for i in range(head)]
    pairs += [(len(left) - k, left[-k], right[-k]) for k in range(1, tail + 1)]
    inner, other = left[head : len(left) - tail], right[head : len(right) - tail]
    return pairs + [(head + i, inner[i], other[j]) for i, j in _places(inner, other, memo)]


def mapped_texts(seed: Node, page: Node, memo: dict, path: str = "") -> Iterator[tuple[str, str, str]]:
    """(path in the seed, its words, the page's words) of the mapped text nodes."""
    if seed.tag == "#text":
        yield path, seed.words, page.words
        return
    left, right = seed.children, page.children
    pairs = [(i, x, y) for i, (x, y) in enumerate(zip(left, right, strict=True))] if seed.shape == page.shape else _mapped(left, right, memo)
    for i, x, y in pairs:
        yield from mapped_texts(x, y, memo, f"{path}/{x.tag}.{i}")


def _tags_of(path: str) -> str:
    return re.sub(r"\.\d+", "", path)


# ---------------------------------------------------------------- clean text


def _inline(node: Node, drop: frozenset, path: str) -> str:
    out = []
    for i, child in enumerate(node.children):
        if child.tag == "#text":
            if (f"{path}/#text", child.words.strip()) not in drop:
                out.append(child.words)
        elif child.tag == "br":
            out.append("\n")
        elif child.tag not in _BLOCKS:
            out.append(child.words + _inline(child, drop, f"{path}/{child.tag}"))
    return "".join(out)


def _blocks(node: Node, drop: frozenset, path: str = "") -> Iterator[str]:
    loose: list[str] = []

    def flush() -> Iterator[str]:
        words = re.sub(r"[ \t\f\v]+", " ", "".join(loose)).strip()
        loose.clear()
        if words:
            yield words

    for child in node.children:
        at = f"{path}/{child.tag}"
        if child.tag == "#text":
            if (at, child.words.strip()) not in drop:
                loose.append(child.words)
        elif child.tag in ("script", "style", "head", "template"):
            if child.tag == "head":
                for x in child.children:
                    if x.tag == "title" and (words := _inline(x, drop, f"{at}/title").strip()):
                        yield f"# {words}"
        elif re.fullmatch(r"h[1-6]", child.tag):
            yield from flush()
            if words := _inline(child, drop, at).strip():
                yield "#" * int(child.tag[1]) + " " + words
        elif child.tag == "li":
            yield from flush()
            if words := _inline(child, drop, at).strip():
                yield "- " + words
            for x in child.children:
                if x.tag in _BLOCKS:
                    yield from ("  " + b if x.tag in ("ul", "ol") else b for b in _blocks(Node("", children=[x]), drop, at))
        elif child.tag == "tr":
            yield from flush()
            cells = [_inline(x, drop, f"{at}/{x.tag}").strip() for x in child.children if x.tag in ("td", "th")]
            if any(cells):
                yield "| " + " | ".join(cells) + " |"
        elif child.tag in _BLOCKS or child.tag in ("html", "body", "tbody", "thead", "tfoot", "center"):
            yield from flush()
            yield from _blocks(child, drop, at)
        elif child.tag == "br":
            loose.append("\n")
        else:
            loose.append(child.words + _inline(child, drop, at))
    yield from flush()


_PAGE = re.compile(r"<(?:html|body|p|h[1-6]|table|ul|ol|div|nav|section|article)\b[^<>]*>", re.I)


def _parted(node: Node, drop: frozenset, path: str = "") -> Iterator[tuple[bool, str]]:
    """The texts of a page in order, and whether each is template."""
    for child in node.children:
        at = f"{path}/{child.tag}"
        if child.tag == "#text":
            yield (at, child.words.strip()) in drop, child.raw
        else:
            yield from _parted(child, drop, at)


def marks_of_page(page: Node, drop: frozenset, found: set[str]) -> set[str]:
    """The languages of a page with a template: ``found`` are those of the whole text, of which wiki and Markdown are read again.

    What the two share is decided by the content alone; marks of one only count in the template, too.
    """
    texts = list(_parted(page, drop))
    if not any(template for template, _ in texts):
        return found
    parts = ["\n".join(raw for template, raw in texts if template is side) for side in (False, True)]
    own = [_marks_of(part, [], set()) & {"wiki", "markdown"} for part in parts]
    return (found - {"wiki", "markdown"}) | (found & (own[0] | own[1])) | own[0]


def _plain_lines(text: str, found: set[str]) -> str:
    """Marks of Markdown, wiki and LaTeX rewritten line by line."""
    if "latex" in found:
        text = re.sub(r"\\(?:part|chapter)\*?\{([^{}]*)\}", r"\n# \1\n", text)
        text = re.sub(r"\\((?:sub)*)section\*?\{([^{}]*)\}", lambda m: "\n" + "#" * (2 + len(m.group(1)) // 3) + f" {m.group(2)}\n", text)
        text = re.sub(r"\\title\{([^{}]*)\}", r"\n# \1\n", text)
        text = re.sub(r"\\begin\{(equation|align|displaymath|gather)\*?\}(.*?)\\end\{\1\*?\}", lambda m: "\n$$" + m.group(2).strip() + "$$\n", text, flags=re.S)
        text = re.sub(r"\\\[(.+?)\\\]", lambda m: "$$" + m.group(1).strip() + "$$", text, flags=re.S)
        text = re.sub(r"\\\((.+?)\\\)", lambda m: "$" + m.group(1).strip() + "$", text)
        text = re.sub(r"\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", lambda m: "\n" + "\n".join("| " + " | ".join(c.strip() for c in row.split("&")) + " |" for row in re.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", m.group(1)).split(r"\\") if row.strip()) + "\n", text, flags=re.S)
        text = re.sub(r"(?m)^[ \t]*\\item\b(?:\[([^\]]*)\])?[ \t]*", r"- \1", text)
        formulas = re.split(r"(\$\$[^$]+\$\$|\$[^$\n]+\$)", text)
        for k in range(0, len(formulas), 2):
            part = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?|\\(?:label|cite|ref|documentclass|usepackage|pagestyle)\*?(?:\[[^\]]*\])?\{[^{}]*\}|\\(?:maketitle|tableofcontents|noindent|newpage|clearpage|centering)\b", "", formulas[k])
            count = 1
            while count:  # the innermost commands first
                part, notes = re.subn(r"\\footnote\{([^{}]*)\}", r" (\1)", part)
                part, count = re.subn(r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1", part)
                count += notes
            formulas[k] = re.sub(r"\\([%&$#_{}])", r"\1", part).replace("~", " ")
        text = "".join(formulas)
    if "wiki" in found:
        text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|<references\s*/?>", "", text, flags=re.I | re.S)
        text = re.sub(r"\{\{[^{}]*\}\}", "", text)
        text = re.sub(r"(?m)^[*#]+[ \t]*(?=\S)", "- ", text) if "markdown" not in found else re.sub(r"(?m)^\*+[ \t]*(?=\S)", "- ", text)
        text = re.sub(r"(?m)^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), text)
        text = re.sub(r"\[\[(?:Category|File|Image):[^\[\]]*\]\]", "", text, flags=re.I)
        text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", text)
        text = re.sub(r"\[(?:https?|ftp)://\S+ ([^\[\]]+)\]", r"\1", text)
        text = re.sub(r"'{2,5}", "", text)
        text = re.sub(r"(?m)^(?:\{\|.*|\|\}|\|-.*|\|\+.*)$\n?", "", text)
        text = re.sub(r"(?m)^[|!][ \t]*(.+)$", lambda m: "| " + " | ".join(c.strip() for c in re.split(r"\|\||!!|\|", m.group(1)) if c.strip()) + " |", text)
    if "markdown" in found:
        text = re.sub(r"(?m)^([^\n]+)\n={3,}[ \t]*$", r"# \1", text)
        text = re.sub(r"(?m)^(?![-|>#])([^\n|]+)\n-{3,}[ \t]*$", r"## \1", text)
        text = re.sub(r"(?m)^[ ]{0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?", "", text)
        text = re.sub(r"(?m)^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]*\S.*$\n?", "", text)
        text = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)", r"\1", text)
        text = re.sub(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", text)
        text = re.sub(r"(?m)^[ ]{0,3}>[ \t]?", "", text)
        text = re.sub(r"(?m)^([ \t]*)[-+*][ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", r"\1- ", text)
        for mark in (r"\*\*", "__", "~~", r"\*", "_"):
            text = re.sub(rf"(?<![\w\\*_~]){mark}(?=[^\s*_~])([^\n*]*?)(?<=[^\s*_~]){mark}(?![\w*_~])", r"\1", text)
        text = re.sub(r"(?m)^(?:\*[ \t]*){3,}$|^_{3,}$", "", text)
    return text


def clean_text(text: str, drop: frozenset = frozenset()) -> tuple[str, list[str]]:
    """The clean text and the languages found. ``drop`` has (tags from the root, words) of the template."""
    bare, samples, own = masked(re.sub(r"\r\n?", "\n", text))
    found = _marks_of(bare, samples, own)
    bare = COMMENT.sub("", bare)
    if "html" in found and _PAGE.search(bare):
        page = parse_page(bare)
        if drop and found & {"wiki", "markdown"}:
            found = marks_of_page(page, drop, found)
        bare = "\n\n".join(_blocks(page, drop))
    elif "html" in found:
        bare = html.unescape(re.sub(r"<br\s*/?>", "\n", TAG.sub(lambda m: m.group(0) if m.group(0)[:3].lower() == "<br" else "", bare), flags=re.I))
    bare = _plain_lines(bare, found)

    def sample(match: re.Match) -> str:
        inside = html.unescape(samples[int(match.group(1))]) if "html" in found else samples[int(match.group(1))]
        if not inside.strip():
            return ""
        return f"\n```\n{inside.strip(chr(10))}\n```\n" if "\n" in inside.strip("\n") else f"`{inside.strip()}`"

    bare = re.sub(r"\x00(\d+)\x00", sample, bare)
    return re.sub(r"\n{3,}", "\n\n", bare).strip(), sorted(found)


# ---------------------------------------------------------------- operator


def page_parts(page: Node) -> set[tuple[str, str]]:
    """The (tags from the root, words) of the text nodes of a page, and with empty tags its shape."""
    parts: set[tuple[str, str]] = set()

    def walk(node: Node, path: str) -> str:
        inside = []
        for child in node.children:
            at = f"{path}/{child.tag}"
            if child.tag == "#text":
                parts.add((at, child.words.strip()))
            inside.append(walk(child, at))
        return f"{node.tag}({','.join(inside)})"

    parts.add(("", walk(page, "")))
    return parts


def _number(text: str) -> int:
    """A number of 64 bits that equal texts share in all processes."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _covering(pages: pa.Table) -> pa.Table:
    """Of the pages of a host with their parts those that have all parts together, the page with most new parts first."""
    own = {i: set(parts) for i, parts in zip(pages.column("page_id").to_pylist(), pages.column("parts").to_pylist(), strict=True)}
    left, chosen = set().union(*own.values()), []
    while left:
        chosen.append(min(own, key=lambda i: (-len(own[i] & left), i)))
        left -= own[chosen[-1]]
    return pa.table({"host": pages.column("host").slice(0, 1).take(pa.array([0] * len(chosen))), "page_id": pa.array(chosen, pages.schema.field("page_id").type)})


def seed_pages(pages: DataFrame) -> DataFrame:
    """``(host, page_id)`` of pages that together have all that may be template, from distinct pages.

    A mapping keeps tags and ancestors, so a text node can only be template if enough pages have its words below the same
    tags. Each such node, and each shape that so many pages have, is in a seed, however many seeds that takes: their
    number depends on the text nodes of a page, not on the number of pages.
    """
    key = dict(pages.dtypes)["page_id"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({_number("\x00".join(part)) for part in page_parts(parse_page(masked(COMMENT.sub("", x))[0]))}) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page_id"), pa.array(found, pa.list_(pa.int64()))], ["host", "page_id", "parts"])

    listed = staged(pages.select("host", "page_id", "content").mapInArrow(parts, f"host string, page_id {key}, parts array<bigint>"), "parts")
    single = listed.select("host", "page_id", F.explode("parts").alias("part"))
    total = listed.groupBy("host").agg(F.count("*").alias("pages"))
    often = single.groupBy("host", "part").agg(F.count("*").alias("n")).join(total, "host").where((F.col("n") >= TEMPLATE_PAGES) & (F.col("n") >= TEMPLATE_SHARE * F.col("pages")))
    has = staged(single.join(often.select("host", "part"), ["host", "part"]).groupBy("host", "page_id").agg(F.array_sort(F.collect_set("part")).alias("parts")), "often")
    # the page with most of them stands for each part: so few pages are left that a host's can be looked at together
    richest = F.max_by("page_id", F.struct(F.size("parts"), -F.col("page_id"))).alias("page_id")
    rich = has.select("host", "page_id", "parts", F.explode("parts").alias("part")).groupBy("host", "part").agg(richest).select("host", "page_id").distinct()
    return has.join(rich, ["host", "page_id"], "left_semi").groupBy("host").applyInArrow(_covering, f"host string, page_id {key}")


def _with_host(rows: DataFrame, items: DataFrame, name: str, length) -> tuple[DataFrame, object]:
    """Rows with the ``name`` of their host: in a broadcast dict if all are short together, else joined to each row."""
    spark = rows.sparkSession
    if (items.agg(F.sum(length).alias("n")).first().n or 0) <= SENT_BYTES:
        sent = spark.sparkContext.broadcast({r.host: r[name] for r in items.collect()})
        return rows.withColumn(name, F.lit(None).cast(items.schema[name].dataType)), sent
    return rows.join(items, "host", "left"), None


def induce_templates(pages: DataFrame) -> DataFrame:
    """``(host, tags, words)`` of the template text nodes, from ``(host, page_id, content)`` of all pages.

    Equal pages of a host count once. Every page is aligned with all ``seed_pages`` of its host; a host of fewer than
    ``TEMPLATE_PAGES`` pages has no template. A null host is none. Ids must be numbers.
    """
    pages = staged(pages.where("host is not null").groupBy("host", "content").agg(F.min("page_id").alias("page_id")), "pages")
    chosen = pages.join(seed_pages(pages), ["host", "page_id"], "left_semi")
    seeds = staged(chosen.groupBy("host").agg(F.array_sort(F.collect_list("content")).alias("seeds")), "seeds")
    rows, sent = _with_host(pages.select("host", "content"), seeds, "seeds", F.aggregate("seeds", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict = {}
        memo: dict = {}
        trees: dict[str, list[Node]] = {}
        counts: dict[tuple[str, str, str], list[int]] = {}
        total: dict[str, int] = {}
        for batch in batches:
            for host, content, own in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "seeds")), strict=True):
                if host not in trees:
                    own = sent.value.get(host) if sent else own
                    trees[host] = [parse_page(masked(COMMENT.sub("", x))[0], shapes) for x in own or ()]
                total[host] = total.get(host, 0) + 1
                page = parse_page(masked(COMMENT.sub("", content))[0], shapes)
                mapped: dict[tuple[str, str], bool] = {}
                for seed in trees[host]:
                    for path, words, other in mapped_texts(seed, page, memo):
                        key = (_tags_of(path), words.strip())
                        mapped[key] = mapped.get(key, False) or words.strip() == other.strip()
                for key, equal in mapped.items():
                    kept = counts.setdefault((host, *key), [0, 0])
                    kept[0] += 1
                    kept[1] += equal
                if len(memo) > 200_000:
                    memo.clear()
        rows = [(h, p, w, n, e) for (h, p, w), (n, e) in counts.items()] + [(h, None, None, n, 0) for h, n in total.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "path", "words", "n", "equal"])

    counted = rows.select("host", "content", "seeds").mapInArrow(align, "host string, path string, words string, n bigint, equal bigint")
    counted = staged(counted.groupBy("host", "path", "words").agg(F.sum("n").alias("n"), F.sum("equal").alias("equal")), "aligned")
    total = counted.where("path is null").select("host", F.col("n").alias("pages"))
    constant = counted.where("path is not null").join(total, "host").where(
        (F.col("equal") >= TEMPLATE_PAGES) & (F.col("equal") >= TEMPLATE_SHARE * F.col("pages")) & (F.col("equal") >= TEMPLATE_EQUAL * F.col("n"))
    )
    return constant.select("host", F.col("path").alias("tags"), "words")


def clean_markup(docs: DataFrame, id_col: str, content_col: str, host_col: str | None = None) -> DataFrame:
    """``(id_col, clean, markup)`` for each row with content: its clean text and the sorted languages of its marks.

    Null contents give no row, blank ones an empty text. Rows that repeat an id should have equal contents;
    the first in string order of the clean text stays. Without ``host_col`` there is no template.
    """
    key = dict(docs.select(id_col).dtypes)[id_col]
    host = F.col(host_col) if host_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("page_id"), F.col(content_col).alias("content"), host.alias("host")).where("content is not null")
    if host_col:
        pages = rows.where(F.col("content").rlike(r"(?i)<(html|body|p|h[1-6]|table|ul|ol|div|nav|section|article)\b"))
        drops = induce_templates(pages).groupBy("host").agg(F.collect_list(F.struct("tags", "words")).alias("drop"))
        drops = staged(drops, "templates")
        rows, sent = _with_host(rows, drops, "drop", F.aggregate("drop", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x.tags) + F.length(x.words)))
    else:
        sent = None
        rows = rows.withColumn("drop", F.lit(None).cast("array<struct<tags:string,words:string>>"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        for batch in batches:
            out = []
            for host, content, drop in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "drop")), strict=True):
                if host not in sets:
                    drop = sent.value.get(host) if sent else drop
                    sets[host] = frozenset((d["tags"], d["words"]) for d in drop or ())
                out.append(clean_text(content, sets[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([c for c, _ in out], pa.string()), pa.array([m for _, m in out], pa.list_(pa.string()))], [id_col, "clean", "markup"]
            )

    cleaned = rows.select("page_id", "host", "content", "drop").mapInArrow(clean, f"`{id_col}` {key}, clean string, markup array<string>")
    return cleaned.groupBy(id_col).agg(F.min(F.struct("clean", "markup")).alias("r")).select(id_col, "r.clean", "r.markup")


def _cleaned(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "parsed_documents").select("parsed_id", "content", F.split_part(canonical_source(F.col("source")), F.lit("/"), F.lit(1)).alias("host"))
    return clean_markup(docs, "parsed_id", "content", "host")


def p7_found(spark, sf_dir: str) -> DataFrame:
    """The languages of the marks of each document."""
    return _cleaned(spark, sf_dir).select("parsed_id", F.explode("markup").alias("markup"))


def p7_clean(spark, sf_dir: str) -> DataFrame:
    """The clean text of each document with content."""
    return _cleaned(spark, sf_dir).select("parsed_id", "clean")


QUERIES = {"p7_found": p7_found, "p7_clean": p7_clean}
SQL: dict[str, str] = {}
