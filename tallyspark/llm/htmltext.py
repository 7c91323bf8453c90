"""Main text of web pages by composite text density.

For every node of the page's tree: the characters and tags below it, and how many of them are in links. The composite
density is characters per tag, times the logarithm of how few of both are links, to a base that grows with the links. The density sum
of a node is the sum of its children's densities. The subtree of the largest sum is the main one; the least density on its path up to
the body is the threshold, and every other part of the body at or above the threshold gives its own densest subtree too; bare text on
the path counts as a part of one tag. A heading goes with the text that follows it.

Densities count all of the page, so that its body tells how much of it is links. Parts that are never the article (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, told by tag, by role, or by a class or id
whose last word names one) add nothing to a sum and give no text. A class may also tell of a layout round the article, so a part
told by name alone stays if the page's articles are in it or, its name being a compound, most of the text.

Pages are read in one pass; a tag ends at the first ``>`` outside its quoted values. If the quotes of a page run on to its end, tags end at
the first ``>``, and a ``<`` with none behind it is text. A tie of sums goes to the node that comes first.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, released, row_of

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r""">|=\s*(["'])""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Tags and roles that are never part of the article; those of MUTE hold no text of the page at all.
MUTE = set("audio canvas head iframe map noscript object script style svg template title video".split())
OUT = MUTE | set("aside button datalist dialog footer form input menu nav select textarea".split())
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: The same parts as a class or id names them, and words that may follow the name.
NOUNS = set("ad ads advert adverts advertisement banner comment comments cookie cookies footer menu nav navigation notice notices sidebar".split())
HOLDERS = set("area bar block box container content inner item items links list section slot thread unit wrap wrapper".split())
KEEP = {"html", "body", "article", "main"}
PARAGRAPH_ENDS = BLOCK - {"br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend", "body", "html"}
#: A start tag ends the open element of these names, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}


class Page:
    """The tree as lists by node number; parents come before children, node 0 is the page."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.out, self.mute, self.inside = ["#page"], [-1], [False], [False], [False]
        self.named: dict[int, bool] = {}  # nodes told by name; whether most of the text in them would keep them
        self.texts: list[tuple[int, int, str]] = []  # node, block, text
        self.size: list[int] = []  # characters of each text that are not white space
        self.block = 0
        self.source, self.at = source, 0
        self.spent: dict[str, int] = {}  # by quote: from where on there is no other
        self.loose = False
        stack, open_ = [0], {}
        end = len(source)
        while self.at < end:
            start = source.find("<", self.at)
            if start < 0 or not self.read_tag(start, stack, open_):
                self.text(stack[-1], source[self.at :])
                break
        if self.named:
            self.drop_named()
        self.out = [a or b for a, b in zip(self.out, self.mute, strict=True)]

    def read_tag(self, start: int, stack: list[int], open_: dict[str, int]) -> bool:
        """Take what stands before the ``<`` at ``start``, and the tag. False: no ``>`` follows, the rest is text."""
        source = self.source
        if source.startswith("<!--", start):
            self.text(stack[-1], source[self.at : start])
            shut = source.find("-->", start + 4)
            self.at = shut + 3 if shut >= 0 else len(source)
            return True
        closing = source.startswith("/", start + 1)
        found = NAME.match(source, start + 1 + closing)
        if not found:
            if source[start + 1 : start + 2] not in ("!", "?", "/"):  # a mere sign
                self.text(stack[-1], source[self.at : start + 1])
                self.at = start + 1
                return True
            shut = source.find(">", start)
        else:
            shut = self.tag_end(found.end())
        if shut < 0:
            return False
        self.text(stack[-1], source[self.at : start])
        self.at = shut + 1
        if not found:
            return True
        name = found[0].lower()
        if closing:
            self.block += name in BLOCK
            if open_.get(name) and name not in ("body", "html"):  # what follows the body belongs to it
                while stack[-1]:
                    top = self.tag[stack.pop()]
                    open_[top] -= 1
                    if top == name:
                        break
            return True
        self.open(name, source[found.end() : shut], stack, open_)
        return True

    def tag_end(self, at: int) -> int:
        if not self.loose:
            i = at
            while m := STOP.search(self.source, i):
                quote = m[1]
                if not quote:
                    return m.start()
                i = m.end()
                if i < self.spent.get(quote, len(self.source)):
                    j = self.source.find(quote, i)
                    if j < 0:
                        self.spent[quote] = i
                    else:
                        i = j + 1
            self.loose = True
        return self.source.find(">", at)

    def open(self, name: str, attributes: str, stack: list[int], open_: dict[str, int]) -> None:
        self.block += name in BLOCK
        if name in PARAGRAPH_ENDS and open_.get("p"):
            self.close(stack, open_, {"p"}, {"button", "td", "th", "table", "caption"})
        if name in ENDS:
            self.close(stack, open_, *ENDS[name])
        parent = stack[-1]
        if name in VOID:
            if name != "br":
                self.node(name, parent, name in OUT)
            return
        if attributes.endswith("/") and name in {"svg", "path", "use"}:
            return
        found = self.foreign(name, attributes, parent)
        node = self.node(name, parent, found is True)
        if found in ("name", "compound") and not self.out[node]:
            self.named[node] = found == "compound"
        if name in RAW:
            shut = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(self.source, self.at)
            self.text(node, self.source[self.at : shut.start() if shut else len(self.source)])
            self.at = (self.source.find(">", shut.start()) + 1 or len(self.source)) if shut else len(self.source)
            return
        stack.append(node)
        open_[name] = open_.get(name, 0) + 1

    def drop_named(self) -> None:
        """Take out what is told by name, but not the layout round the article."""
        n = len(self.tag)
        in_link, in_named, body = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            in_link[i] = self.tag[i] == "a" or in_link[p]
            in_named[i] = i in self.named or in_named[p]
            body[i] = self.tag[i] == "body" or body[p]
        articles = [self.tag[i] in ("article", "main") and not self.out[i] and i not in self.named for i in range(n)]
        outside = any(articles[i] and not in_named[i] for i in range(n))
        size = [0] * n
        for (node, _, _), k in zip(self.texts, self.size, strict=True):
            if not in_link[node] and not self.out[node]:
                size[node] += k
        total = sum(size[i] for i in range(n) if body[i]) or sum(size)
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            articles[self.parent[i]] |= articles[i]
        for i in range(1, n):
            if i in self.named:
                self.out[i] |= not (articles[i] and not outside or self.named[i] and size[i] * 2 > total)
            self.out[i] |= self.out[self.parent[i]]

    def node(self, tag: str, parent: int, out: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.out.append(out or self.out[parent])
        self.mute.append(tag in MUTE or self.mute[parent])
        self.inside.append(tag in ("article", "main") or self.inside[parent])
        return len(self.tag) - 1

    def text(self, node: int, raw: str) -> None:
        if raw and not self.mute[node]:
            t = html.unescape(raw) if "&" in raw else raw
            self.texts.append((node, self.block, t))
            self.size.append(len("".join(t.split())))

    def close(self, stack: list[int], open_: dict[str, int], names: set[str], until: set[str]) -> None:
        if not any(open_.get(x) for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] in until:
                return
            if self.tag[stack[i]] in names:
                for n in stack[i:]:
                    open_[self.tag[n]] -= 1
                del stack[i:]
                return

    def foreign(self, name: str, attributes: str, parent: int) -> bool | str:
        """True: never part of the article. By name alone: "compound" if the telling word is one part of a longer name and does
        not tell of comments, else "name"."""
        if name in OUT:
            return True
        if name == "header":
            return not self.inside[parent]
        if not attributes or name in ("html", "body", "main"):
            return False
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        if found.get("role", "").lower() in ROLES:
            return True
        told = False
        for word in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
            parts = [x for x in re.split(r"[-_]+", word) if x]
            if not parts or "with" in parts or parts[0] in ("has", "no", "without"):
                continue
            noun = parts[-1] if parts[-1] in NOUNS else parts[-2] if len(parts) > 1 and parts[-1] in HOLDERS and parts[-2] in NOUNS else None
            comments = noun in ("comment", "comments")
            if noun and (name not in KEEP or comments):
                if len(parts) == 1 or comments:
                    return "name"
                told = "compound"
        return told

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density and density sum by node.

        Density: C / T times the logarithm of (C / LC) (T / LT) to the base ln(C / (C - LC) LC + (LC of body / C of body) C + e), of
        characters C and tags T and those in links, LC and LT; a divisor of zero counts as one. On pages without links the
        base would be one, and density is C / T.
        """
        n = len(self.tag)
        chars, links, tags, anchors = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for (node, _, _), size in zip(self.texts, self.size, strict=True):
            chars[node] += size
            if in_link[node]:
                links[node] += size
        for i in range(n - 1, 0, -1):
            if self.mute[i]:
                continue
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            anchors[p] += anchors[i] + in_link[i]
        body = self.body()
        share = links[body] / max(chars[body], 1)
        self.share = share
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            density[i] = self.density(chars[i], tags[i], links[i], anchors[i])
            if i and not self.out[i]:
                total[self.parent[i]] += density[i]
        return density, total

    def density(self, c: int, t: int, lc: int = 0, lt: int = 0) -> float:
        if not c or not self.share:
            return c / max(t, 1)
        base = math.log(c / max(c - lc, 1) * lc + self.share * c + math.e)
        return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / math.log(base)

    def body(self) -> int:
        """The body, or the page if it has none."""
        return next((i for i, t in enumerate(self.tag) if t == "body"), 0)

    def chosen(self) -> list[bool]:
        """Whether each text is part of the article."""
        n = len(self.tag)
        density, total = self.densities()
        body = self.body()
        inside = [False] * n
        inside[body] = True
        for i in range(body + 1, n):
            inside[i] = inside[self.parent[i]]
        if not any(inside[node] and size for (node, _, _), size in zip(self.texts, self.size, strict=True)):
            inside, body = [True] * n, 0
        live = [i for i in range(n) if inside[i] and not self.out[i]]
        best = max(live, key=lambda i: (total[i], -i), default=0)
        if not total[best]:
            best = body
        path = [best]
        while path[-1] != body and path[-1] > 0:
            path.append(self.parent[path[-1]])
        least = min(density[i] for i in path)
        top, most = [-1] * n, [0.0] * n  # of the subtree of each node
        for i in reversed(live):
            if total[i] >= most[i]:
                top[i], most[i] = i, total[i]
            p = self.parent[i]
            if p >= 0 and most[i] > most[p]:
                top[p], most[p] = top[i], most[i]
        marked = [False] * n
        marked[best] = True
        above = set(path)
        for i in live:
            if i not in above and density[i] >= least:
                marked[i if top[i] < 0 else top[i]] = True
        for i in range(1, n):
            marked[i] = (marked[i] or marked[self.parent[i]]) and not self.out[i]
        heading = [-1] * n
        for i in range(1, n):
            heading[i] = i if self.tag[i] in HEADINGS else heading[self.parent[i]]
        found, follows = [], False
        for (node, _, _), size in zip(reversed(self.texts), reversed(self.size), strict=True):
            bare = node in above and inside[node] and not self.out[node] and self.density(size, 1) >= least
            titles = follows and heading[node] >= 0 and inside[node] and not self.out[node]
            found.append(marked[node] or bare or titles)
            if size and inside[node] and not self.out[node]:
                follows = found[-1]
        return found[::-1]

    def article(self) -> str:
        blocks: dict[int, list[str]] = {}
        for (_, block, text), own in zip(self.texts, self.chosen(), strict=True):
            if own:
                blocks.setdefault(block, []).append(text)
        return "\n".join(x for b in blocks.values() if (x := " ".join("".join(b).split())))


def main_text(source: str | None) -> str:
    """The article of a page, a line for each block; empty for null, empty pages and pages without text."""
    return Page(source).article() if source else ""


def extract(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """The columns of ``pages`` but ``source``, and ``out``. Rows stay as they are, repeated ones too; an empty table gives none."""
    rows = pages.select(row_of(pages, source, out), F.col(f"`{source}`").cast("string").alias("source"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["row", "text"])

    kind = rows.schema["row"].dataType.simpleString()
    return lean(rows).mapInArrow(released(add), f"row {kind}, text string").select("row.*", F.col("text").alias(out))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
