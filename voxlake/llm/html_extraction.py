"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements whose leaves are runs of text. Every node gets features: subtree density
(characters a tag, share of linked characters), attribute tokens (log odds of its tag, class and id words and of its
ancestors'), depth and sibling statistics. The trees give the chance that a node belongs to the article. Decoding picks
the likeliest choice for the whole tree under one rule: what lies inside a dropped node is dropped.

The model is trained here, on pages that `layouts` composes from page parts with known labels (seeded, so every run
gives the same model); it never sees the pages that it is applied to. The tree is built without recursion, so depth and
size of a page are not limited.

Defined results: null html counts as empty; a page without main text gives an empty text; whole pages are read in time that
is linear in their length, however malformed: a tag that never ends is text, an end tag without its start says nothing, an
unclosed element ends with what holds it; every row is returned, rows that repeat a page_id or a page each by itself; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.boosting import boost, predict_tree
from voxlake.llm.common import at_end, bounded_batches, empty, pieces

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What these hold is not text of the page. Without an end tag that is all that follows for the first two, and nothing for
#: the others.
CODE = frozenset("script style".split())
RAW = CODE | frozenset("title textarea template iframe noembed noframes".split())
#: Nodes that stand inside a paragraph as well. One without an end tag is no node, or ends with what holds it.
INSIDE = frozenset("svg select button object audio video canvas datalist noscript xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag in a row ends an open element of the row's set, up to the nearest of the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "button": ({"button"}, {"table"}),
    "select": ({"select"}, {"table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
LEAD = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
SHORT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
STOP = re.compile(r"""[>"']""")
END = re.compile(rf"</({'|'.join(sorted(INSIDE))})\b", re.I)
ELEMENT = re.compile(rf"<({'|'.join(sorted(INSIDE))})\b[^>]*>.*?</\1>", re.I | re.S)
HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.I)
XMP_END = re.compile(r"</xmp\b", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
N_FEATURES = 18


class Tags:
    """The tags of a source from left to right, each character looked at a bounded number of times.

    A tag ends at the first > outside quotes; where quotes do not pair up, at the first >. What never ends is text.
    """

    def __init__(self, source: str):
        self.source, self.last = source, {c: source.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()  # stops from which no tag's end is reached outside quotes

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at `at`; -1 without one."""
        source, last = self.source, self.last
        if at > last[">"]:
            return -1
        seen, j = [], at
        while m := STOP.search(source, j):
            j = m.start()
            if j in self.dead:
                break
            if source[j] == ">":
                return j
            seen.append(j)
            if j >= last[source[j]]:
                break
            j = source.find(source[j], j + 1) + 1
        self.dead.update(seen)
        return source.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(begin, end, name, attributes, closing) of the next tag from `at` on; the name is empty for comments and the like."""
        source, last = self.source, self.last
        while lead := LEAD.search(source, at):
            begin = lead.start()
            if m := SHORT.match(source, begin):
                return begin, m.end(), m[2], m[3], bool(m[1])
            if m := NAME.match(source, begin):
                end = self.end(m.end())
                if end < 0:
                    return None  # no > follows, so no tag does
                return begin, end + 1, m[1], source[m.end() : end], source[begin + 1] == "/"
            if source.startswith("<!--", begin):
                if source.startswith((">", "->"), begin + 4):
                    return begin, source.find(">", begin) + 1, "", "", False
                end = source.find("-->", begin + 4)
                return begin, end + 3 if end >= 0 else len(source), "", "", False
            if source.startswith(("<!", "<?"), begin):
                end = source.find(">", begin) if begin < last[">"] else -1
                return (begin, end + 1, "", "", False) if end >= 0 else None
            at = begin + 1
        return None


class Page:
    """Nodes in page order; node 0 is the page. Text runs are leaves with a text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.text = [-1], ["#page"], [()], [None]
        self.linked, self.tags, self.depth = [0], [0], [0]
        self._read(source)

    def _node(self, parent: int, tag: str, tokens: tuple, text: str | None, linked: int) -> int:
        for column, v in ((self.parent, parent), (self.tag, tag), (self.tokens, tokens), (self.text, text), (self.linked, linked), (self.tags, 0), (self.depth, self.depth[parent] + 1)):
            column.append(v)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack, run, linked, link, at, n = [0], [], 0, False, 0, len(source)
        tag_names, tags, seen_head = self.tag, Tags(source), False
        opened: dict[str, list[int]] = defaultdict(list)  # places in the stack, by name
        endless: set[str] = set()  # raw elements that no end tag follows any more
        last_end = {m[1].lower(): m.start() for m in END.finditer(source)}

        def flush() -> None:
            nonlocal linked
            if run:
                words = " ".join("".join(run).split())
                if words:
                    self._node(stack[-1], "#text", (), words, min(linked, len(words)))
                run.clear()
            linked = 0

        def close(at: int) -> None:
            flush()
            while len(stack) > at:
                opened[tag_names[stack.pop()]].pop()

        while at < n:
            tag = tags.next(at)
            begin = tag[0] if tag else n
            if begin > at:
                piece = source[at:begin]
                if "&" in piece:
                    piece = entities.unescape(piece)
                run.append(piece)
                if link:
                    linked += len(piece)
            if not tag:
                break
            _, at, name, said, closing = tag
            if not name:
                continue
            name = name.lower()
            if closing:
                if opened[name]:
                    close(opened[name][-1])
                    link = False
                elif name == "a":
                    link = False
                continue
            if name in RAW:
                if not said.endswith("/") and name not in endless:
                    end = RAW_END[name].search(source, at)
                    if not end:
                        endless.add(name)
                    stop = source.find(">", end.end()) if end else -1
                    at = stop + 1 if stop >= 0 else n if name in CODE or end else at
                continue
            if name == "head":  # nothing in it is shown; a page without </head> goes on at its body
                end = None if seen_head else HEAD_END.search(source, at)
                at, seen_head = end.end() if end else at, True
                continue
            inside = name in INSIDE and not said.endswith("/") and last_end.get(name, -1) >= at
            if name not in BLOCKS and not inside:
                if name == "br":
                    run.append(" ")
                elif name == "a":
                    link = True
                self.tags[stack[-1]] += 1
                continue
            if name in CLOSES:
                ends, stops = CLOSES[name]
                scope = max((opened[s][-1] for s in stops if opened[s]), default=0)
                within = [opened[e][k] for e in ends if (k := bisect.bisect_right(opened[e], scope)) < len(opened[e])]
                if within:
                    close(min(within))
            elif tag_names[stack[-1]] == "p" and not inside:
                close(len(stack) - 1)
            flush()
            if name == "hr":
                continue
            found = ATTRIBUTE.findall(said) if said else ()
            tokens = tuple(w.lower() for values in found for v in values if v for w in WORD.findall(v))
            opened[name].append(len(stack))
            stack.append(self._node(stack[-1], name, tokens, None, 0))
            if name == "xmp":  # text as it stands
                if end := XMP_END.search(source, at):
                    run.append(source[at : end.start()])
                    at = end.start()
        flush()

    def features(self, odds: dict[str, float]) -> np.ndarray:
        n = len(self.parent)
        parent = np.array(self.parent)
        size = np.array([len(t) if t else 0 for t in self.text], float)
        marks = np.array([sum(map(t.count, ".,;!?")) if t else 0 for t in self.text], float)
        link, tags = np.array(self.linked, float), np.array(self.tags, float) + 1
        start = np.r_[0, np.cumsum(size)[:-1]]
        kids, heavy = np.zeros(n), np.zeros(n)
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = parent[i]
            size[p] += size[i]
            marks[p] += marks[i]
            link[p] += link[i]
            tags[p] += tags[i]
            kids[p] += 1
        place, same = np.zeros(n), np.zeros(n)
        seen: dict = defaultdict(int)
        for i in range(1, n):
            p = self.parent[i]
            place[i] = seen[p]
            seen[p] += 1
            seen[p, self.tag[i]] += 1
            heavy[p] = max(heavy[p], size[i])
        own, low, high, total = (np.zeros(n) for _ in range(4))
        for i in range(1, n):
            p = self.parent[i]
            same[i] = seen[p, self.tag[i]]
            said = [odds.get(w, 0.0) for w in self.tokens[i]]
            tag = odds.get(f"<{self.tag[i]}>", 0.0)
            own[i] = own[p] if self.text[i] is not None else (min(said, default=0.0) if min(said, default=0.0) < 0 else max(said, default=0.0)) + tag
            low[i], high[i], total[i] = min(low[p], own[i]), max(high[p], own[i]), total[p] + (own[i] if self.text[i] is None else 0)
        siblings = np.where(parent >= 0, kids[np.maximum(parent, 0)], 1)
        above = np.where(parent >= 0, size[np.maximum(parent, 0)], size)
        whole = max(size[0], 1)
        return np.stack([np.array([t is not None for t in self.text], float), np.array(self.depth, float), np.log1p(size), link / np.maximum(size, 1), size / tags, kids, place / np.maximum(siblings, 1), siblings, np.log1p(above / np.maximum(siblings, 1)), same / np.maximum(siblings, 1), own, low, high, total, marks / np.maximum(size, 1), start / whole, size / whole, np.log1p(heavy)], 1)

    def decode(self, chance: np.ndarray) -> str:
        """The kept text under the likeliest choice in which dropped nodes hold no kept ones."""
        p = np.clip(chance, 1e-4, 1 - 1e-4)
        weight = np.array([1.0 if t is not None else 0.5 for t in self.text])
        keep, drop = weight * np.log(p), weight * np.log(1 - p)
        keep[0] = drop[0] = 0.0
        best, gone = keep.copy(), drop.copy()
        chosen = np.zeros(len(p), bool)
        for i in range(len(p) - 1, 0, -1):
            chosen[i] = best[i] > gone[i]
            above = self.parent[i]
            best[above] += max(best[i], gone[i])
            gone[above] += gone[i]
        chosen[0] = True
        for i in range(1, len(p)):
            chosen[i] &= chosen[self.parent[i]]
        return "\n".join(t for t, c in zip(self.text, chosen) if c and t is not None)


# Training pages. Content text carries a mark that is taken off before features are computed.
MARK = "§"
#: Fixed word lists of the composed pages: names that page builders give to parts, by kind.
NAMES = {
    "content": "content article post entry story body text main page-content post-body entry-content article-body story-text blog-post prose markdown",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu tabs pagination pager toc site-nav",
    "header": "header masthead site-header topbar branding banner logo tagline page-header",
    "footer": "footer site-footer bottom copyright legal colophon credits page-footer",
    "side": "sidebar aside widget related recommended popular trending side-column rail also-read more-stories author-bio tags share social",
    "notice": "cookie cookie-notice consent gdpr notice alert popup modal overlay cookie-banner paywall privacy",
    "advert": "ad ads advert advertisement sponsored promo sponsor adsense ad-slot banner-ad promotion commercial",
    "form": "form newsletter subscribe signup login search search-form contact comment-form",
    "comment": "comments comment replies reply discussion responses thread disqus reader-comments feedback",
    "plain": "wrapper container row col inner outer grid box section block layout page wrap clearfix",
}


def layouts(pages: int, seed: int = 7) -> Iterator[str]:
    rng = random.Random(seed)
    syllables = [a + b for a in "b c d f g l m n p r s t v th st".split() for b in "a e i o u an er in on es".split()]

    def words(a: int, b: int, end: str = "") -> str:
        out = ["".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(rng.randint(a, b))]
        return " ".join(w + ("," if rng.random() < 0.06 else "") for w in out).capitalize() + end

    def prose(sentences: int) -> str:
        return " ".join(words(4, 16, ".") for _ in range(sentences))

    def named(tag: str, kind: str, inner: str) -> str:
        style = rng.random()
        name = rng.choice(NAMES[kind].split())
        said = f' class="{name}"' if style < 0.6 else f' id="{name}"' if style < 0.85 else f' class="{rng.choice(NAMES["plain"].split())}"' if tag == "div" and style < 0.9 else "" if tag != "div" or kind in ("menu", "footer", "content") else f' class="{name} {rng.choice(NAMES["plain"].split())}"'
        return f"<{tag}{said}>{inner}</{tag}>"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 4)}</a></li>' for k in range(n))

    def part(kind: str) -> str:
        if kind == "menu":
            inner = f"<ul>{links(rng.randint(2, 12))}</ul>" if rng.random() < 0.75 else " | ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(rng.randint(2, 8)))
            return named(rng.choice(("nav", "nav", "div", "header")), kind, inner)
        if kind == "header":
            return named(rng.choice(("header", "div")), kind, rng.choice((f"<h1>{words(1, 3)}</h1><p>{words(3, 8)}</p>", f'<a href="/">{words(1, 3)}</a>', f"<p>{words(2, 9)}</p>", words(1, 8))))
        if kind == "footer":
            return named(rng.choice(("footer", "footer", "div")), kind, rng.choice((f"&copy; {words(2, 12, '.')}", f"<p>{words(2, 20, '.')}</p>", f"<ul>{links(rng.randint(2, 6))}</ul><p>{words(3, 9)}</p>", f"&copy; site.example.com &middot; {prose(rng.randint(1, 3))}")))
        if kind == "side":
            inner = rng.choice((f"<h3>{words(1, 3)}</h3><ul>{links(rng.randint(2, 7))}</ul>", f"<h3>{words(1, 3)}</h3><p>{prose(rng.randint(1, 3))}</p>", f"<p>{words(3, 20, '.')}</p>"))
            return named(rng.choice(("aside", "aside", "div")), kind, inner)
        if kind == "notice":
            inner = rng.choice((f"<p>{prose(rng.randint(1, 3))}</p><button>OK</button>", f'{words(6, 25, ".")} <a href="/p">{words(1, 2)}</a>'))
            return named("div", kind, inner)
        if kind == "advert":
            return named(rng.choice(("div", "div", "aside", "section")), kind, rng.choice((words(3, 14, "."), f"<p>{words(3, 25, '.')}</p>", f'<a href="/x"><p>{words(3, 9)}</p></a>', prose(2))))
        if kind == "form":
            return named("form", kind, f"<p>{words(2, 12)}</p><label>{words(1, 2)}</label><input name=q><button>Go</button>")
        replies = "".join(named(rng.choice(("div", "li", "article")), "comment", f"<p>{prose(rng.randint(1, 4))}</p>" if rng.random() < 0.7 else f"<b>{words(1, 2)}</b><p>{prose(rng.randint(1, 3))}</p>") for _ in range(rng.randint(1, 6)))
        return named(rng.choice(("section", "div")), "comment", f"<h2>{words(1, 3)}</h2>" * (rng.random() < 0.5) + replies)

    def content() -> str:
        m = MARK
        title = f"<h1>{m}{words(2, 12)}</h1>"
        if rng.random() < 0.15:
            title = f"<header>{title}</header>"
        out = [title] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            kind = rng.random()
            out.append(
                f"<p>{m}{prose(rng.randint(1, 7))}</p>" if kind < 0.60
                else f"<p>{m}{words(1, rng.choice((1, 2, 6)), '.')}</p>" if kind < 0.76
                else f"<p><b>{m}{prose(rng.randint(1, 4))}<br>" if kind < 0.80
                else f"<h2>{m}{words(1, 6)}</h2>" if kind < 0.85
                else "<ul>" + "".join(f"<li>{m}{words(2, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>" if kind < 0.89
                else f"<blockquote><p>{m}{prose(2)}</p></blockquote>" if kind < 0.92
                else f'<p>{m}{prose(2)} <a href="/y">{words(1, 4)}</a> {prose(1)}</p>' if kind < 0.96
                else f"<table><tr><td>{m}{words(1, 4)}</td><td>{m}{words(1, 4)}</td></tr></table>" if kind < 0.98
                else f"<pre>{m}{words(4, 20)}</pre>"
            )
            if rng.random() < 0.05:
                out.append(part("advert"))
        inner = "".join(out)
        return named(rng.choice(("article", "article", "article", "main", "div", "section", "div")), "content", inner)

    for _ in range(pages):
        before = [part(k) for k in ("header", "menu", "notice", "advert") if rng.random() < 0.55]
        rng.shuffle(before)
        after = [part(k) for k in ("side", "comment", "advert", "form", "menu", "footer", "notice") if rng.random() < 0.4]
        main = content()
        for _ in range(rng.choice((0, 0, 1, 2))):
            side = part("side") if rng.random() < 0.3 else ""
            main = f'<div class="{rng.choice(NAMES["plain"].split())}">{side}{main}</div>'
        page = "".join([*before, main, *after])
        yield f"<html><head><title>{words(2, 5)}</title></head><body>{page}</body></html>"


@functools.lru_cache(maxsize=1)
def model(pages: int = 1000, trees: int = 60) -> tuple[dict[str, float], float, list]:
    """(log odds of tags and attribute tokens, bias, trees)."""
    # a composed page has few kinds of elements INSIDE: they teach what their tag says, and the trees read the page without
    whole = list(layouts(pages))
    bare = [ELEMENT.sub("", source) for source in whole]
    labels, read = [], []
    counts: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for source, for_trees in [*((s, False) for s in whole), *((s, True) for s in bare)]:
        page = Page(source)
        n = len(page.parent)
        good, bad = np.zeros(n, int), np.zeros(n, int)
        for i in range(n - 1, -1, -1):
            text = page.text[i]
            if text is not None:
                good[i], bad[i] = int(MARK in text), int(MARK not in text)
                page.text[i] = text.replace(MARK, "")
            if i:
                good[page.parent[i]] += good[i]
                bad[page.parent[i]] += bad[i]
        if for_trees:
            read.append(page)
            labels.append(np.where(good == 0, 0, np.where(bad == 0, 1, -1)))
            continue
        for i in range(1, n):
            if page.text[i] is None and good[i] + bad[i]:
                for word in {*page.tokens[i], f"<{page.tag[i]}>"}:
                    counts[word][int(good[i] > bad[i])] += 1
    odds = {w: float(np.log(b / a)) for w, (a, b) in counts.items() if a + b > 5}
    x, y = np.concatenate([p.features(odds) for p in read]), np.concatenate(labels)
    bias, grown = boost(x[y >= 0], y[y >= 0].astype(float), trees)
    return odds, bias, [t.arrays() for t in grown]


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract_main_text(pages_df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row."""
    bounded_batches(pages_df.sparkSession)
    odds, bias, trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield empty(_TEXTS)
        for whole in batches:
            for batch in pieces(whole, 200, 4, "html"):
                read = [Page(source or "") for source in batch.column("html").to_pylist()]
                x = np.concatenate([p.features(odds) for p in read])
                margin = np.full(len(x), bias)
                for tree in trees:
                    margin += predict_tree(tree, x)
                chance, at, texts = 1 / (1 + np.exp(-margin)), 0, []
                for page in read:
                    texts.append(page.decode(chance[at : at + len(page.parent)]))
                    at += len(page.parent)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], schema=_TEXTS)

    taken = pages_df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return taken.mapInArrow(lambda batches: at_end(run(batches)), "page_id long, url string, text string")
