"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import chunks

# Names of HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An open element of the first name ends where one of the others begins, unless a list or table lies between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "option": "select datalist"}

# What is never main text.
NOT_TEXT = frozenset("aside button canvas datalist dialog footer form head header iframe input menu nav noframes noscript object script select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id names that say that a part is not the article's. A name counts only if all its words are of this
#: list or the next and one is of this: `ad-top` does, `ad-hoc` and `has-sidebar` don't.
JUNK = frozenset(
    "ad ads adv advert advertisement adverts adsense alert aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright dialog disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
FILLER = frozenset("area articles bar block bottom box button buttons column container content fixed global icons inner item items left links list main message outer page pane panel posts primary right row secondary section side site slot small stories sticky text thread title top unit wrap wrapper".split())

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
# every attribute in turn, so that what looks like one inside a value is none
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")


class _Tree:
    """Elements in page order; 0 is the page. Texts are (element, string), None where a line or block ends. drop: never
    main text, by name or role; suspect: by class or id."""

    def __init__(self) -> None:
        self.tag, self.parent, self.drop, self.suspect = ["#page"], [-1], [False], [False]
        self.texts: list[tuple[int, str | None]] = []

    def add(self, tag: str, parent: int, drop: bool, suspect: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.drop.append(drop)
        self.suspect.append(suspect)
        return len(self.tag) - 1


def _says_junk(names: str) -> bool:
    for name in names.lower().split():
        words = _WORD.findall(name)
        if any(w in JUNK for w in words) and all(w in JUNK or w in FILLER for w in words):
            return True
    return False


def _unwanted(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is never main text, and whether its class or id says so."""
    if tag in NOT_TEXT:
        return True, False
    suspect = False
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "hidden" and value.lower() != "until-found" or kind == "role" and value.lower() in ROLES:
                return True, False
            suspect = suspect or kind in ("class", "id") and _says_junk(value)
    return False, suspect


def _parse(html: str) -> _Tree:
    """A lenient reading: unclosed elements end where their parent does or where HTML says that they end, stray end
    tags are ignored, and a tag without an end is text up to the page's end."""
    tree = _Tree()
    stack, n_open = [0], {}
    at, n, plain = 0, len(html), False

    def close(to: int) -> None:
        while len(stack) > to:
            i = stack.pop()
            n_open[tree.tag[i]] -= 1
            if tree.tag[i] not in INLINE:
                tree.texts.append((i, None))

    def close_tag(names: tuple[str, ...], barrier: tuple[str, ...] = ()) -> None:
        if any(n_open.get(x) for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[k]] in names:
                    close(k)
                    return
                if tree.tag[stack[k]] in barrier:
                    return

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            tree.texts.append((stack[-1], html[at:]))
            break
        if lt > at:
            tree.texts.append((stack[-1], html[at:lt]))
        ahead = html[lt + 1 : lt + 2]
        if ahead in ("!", "?"):
            mark = "-->" if html.startswith("<!--", lt) else ">"
            end = html.find(mark, lt + 2)
            at = n if end < 0 else end + len(mark)
            continue
        m = _TAG.match(html, lt) if not plain and (ahead.isascii() and ahead.isalpha() or ahead == "/") else None
        if m:
            name, attrs, end = m[1].lower(), m[2], m.end()
        else:
            named = re.match(r"</?([a-zA-Z][^\s/>]*)", html[lt : lt + 64])
            if not named:  # not a tag
                tree.texts.append((stack[-1], "<"))
                at = lt + 1
                continue
            end = html.find(">", lt)
            if end < 0:
                tree.texts.append((stack[-1], html[lt:]))
                break
            plain = True  # a quote is never closed: from here on tags end at the first >
            name, attrs, end = named[1].lower(), html[lt + named.end() : end], end + 1
        at = end
        if ahead == "/":
            if name == "br":
                tree.texts.append((stack[-1], None))
            elif n_open.get(name):
                close_tag((name,))
            continue
        if name in CLOSES_P:
            close_tag(("p",))
        if name in ENDS:
            close_tag(ENDS[name], tuple(SCOPE.get(name, "table").split()))
        if name in ("html", "body") and n_open.get(name):
            continue
        if name == "body":
            close_tag(("head",))
        if name not in INLINE:
            tree.texts.append((stack[-1], None))
        i = tree.add(name, stack[-1], *_unwanted(name, attrs))
        if name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            if not tree.drop[i]:
                tree.texts.append((i, html[at : stop.start() if stop else n]))
            at = n if not stop else (html.find(">", stop.end()) + 1 or n)
        elif name not in VOID:
            stack.append(i)
            n_open[name] = n_open.get(name, 0) + 1
    return tree


def _density(chars: float, tags: float, link_chars: float, link_tags: float, ratio: float) -> float:
    """Composite text density: characters per tag, less where many of both belong to links. ratio: the body's share of
    characters in links."""
    if not chars:
        return 0.0
    tags = tags or 1
    other = max(chars - link_chars, 1)
    base = math.log(chars / other * link_chars + ratio * chars + math.e)
    return chars / tags * math.log(chars / max(link_chars, 1) * tags / max(link_tags, 1) + 1e-9 + 1) / math.log(base + 1)


class _Counts:
    """Characters, elements, and both of links, below each element that is not dropped."""

    def __init__(self, tree: _Tree, drop: list[bool], texts: list[tuple[int, str | None]]) -> None:
        n = len(tree.tag)
        self.drop = drop[:]
        for i in range(1, n):
            self.drop[i] = drop[i] or self.drop[tree.parent[i]]
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
        self.chars, self.tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for i, t in texts:
            if t and not self.drop[i]:
                c = len("".join(t.split()))
                self.chars[i] += c
                if in_link[i]:
                    self.link_chars[i] += c
        for i in range(n - 1, 0, -1):
            if not self.drop[i]:
                p = tree.parent[i]
                self.chars[p] += self.chars[i]
                self.tags[p] += self.tags[i] + 1
                self.link_chars[p] += self.link_chars[i]
                self.link_tags[p] += self.link_tags[i] + (tree.tag[i] == "a")


def _cleared(tree: _Tree, drop: list[bool], texts: list[tuple[int, str | None]]) -> list[bool]:
    """drop, with the suspects that the page's text confirms. A suspect that holds over half of the page's text outside
    links is a wrapper whose name misleads, if it also holds a heading or an article or main element that no other
    suspect holds, or nothing outside it does."""
    if not any(tree.suspect):
        return drop
    counts = _Counts(tree, drop, texts)
    own = [c - k for c, k in zip(counts.chars, counts.link_chars, strict=True)]
    n = len(tree.tag)
    wide = [tree.suspect[i] and 2 * own[i] > own[0] for i in range(n)]
    sure = [tree.suspect[i] and not wide[i] for i in range(n)]
    for i in range(1, n):
        sure[i] = sure[i] or sure[tree.parent[i]]
    marks = [i for i in range(1, n) if tree.tag[i] in ("h1", "h2", "article", "main") and not counts.drop[i] and not sure[i]]
    held = [0] * n
    for i in marks:
        held[i] += 1
    for i in range(n - 1, 0, -1):
        held[tree.parent[i]] += held[i]
    return [d or s and not (w and (h or h == held[0])) for d, s, w, h in zip(drop, tree.suspect, wide, held, strict=True)]


def main_text(html: str | None) -> str:
    """The main text of a page; empty for null or where there is none.

    Elements that are never main text by name or role are taken out, and so are those whose class or id says so, unless
    they hold most of the page's text with its headings. Every other element gets its composite text density, and the
    sum of its children's but the inline ones, which are text of their block. The element with the greatest sum is the article, whatever its name (of equal ones an
    article or main element, then the first). The least density on its path to the body is the threshold: other
    subtrees that reach it belong to the article too, unless links hold most of their text. All of the chosen subtrees
    is kept, lists of links too; only where the body itself is chosen, lists of links before and behind all other
    text are menus.
    """
    if not html:
        return ""
    tree = _parse(html)
    n = len(tree.tag)
    texts = [(i, t if t is None or "&" not in t else unescape(t)) for i, t in tree.texts if not tree.drop[i]]
    counts = _Counts(tree, _cleared(tree, tree.drop, texts), texts)
    drop, chars, link_chars, link_tags = counts.drop, counts.chars, counts.link_chars, counts.link_tags
    if not chars[0]:
        return ""
    body = next((i for i in range(1, n) if tree.tag[i] == "body"), 0)
    if chars[body] < chars[0]:  # text outside the body
        body = 0
    ratio = link_chars[body] / max(chars[body], 1)
    density = [0.0 if drop[i] else _density(chars[i], counts.tags[i], link_chars[i], link_tags[i], ratio) for i in range(n)]
    total = [0.0] * n
    block = [t not in INLINE for t in tree.tag]  # what is inline is text of its block
    for i in range(1, n):
        if block[i]:
            total[tree.parent[i]] += density[i]
    best = max((i for i in range(body, n) if block[i] and not drop[i]), key=lambda i: (total[i], tree.tag[i] in ("article", "main"), -i))
    if total[best] <= 0:
        best = body
    path = [best]
    while path[-1] > body:
        path.append(tree.parent[path[-1]])
    threshold = min(density[i] for i in path)
    chosen = {best, *(i for i in range(body + 1, n) if block[i] and not drop[i] and density[i] >= threshold and 2 * link_chars[i] <= chars[i])}
    chosen -= set(path[1:])
    inside, link_list = [False] * n, [False] * n
    for i in range(n):
        p = tree.parent[i]
        link_list[i] = p >= 0 and link_list[p] or link_tags[i] > 0 and link_chars[i] == chars[i] and i != body
        inside[i] = i in chosen or p >= 0 and inside[p]
    kept = [(i, t) for i, t in texts if inside[i] and not drop[i]]
    if best == body:
        plain = [k for k, (i, t) in enumerate(kept) if t and t.strip() and not link_list[i]]
        if plain:
            kept = [(i, t) for k, (i, t) in enumerate(kept) if not link_list[i] or plain[0] < k < plain[-1]]
    return " ".join("".join(" " if t is None else t for _, t in kept).split())


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows of `pages` with text and n_chars (its code points) in place of the html column.

    Null or empty html gives empty text. Character references are decoded, white space inside a block becomes one
    space, and blocks are joined by one; nothing else is cut, however long a page. Pages are read one by one, so
    repeated rows need no care; columns named text or n_chars are replaced; others stay; an empty table gives no rows.
    """
    rows = pages.drop("text", "n_chars")
    others = [f for f in rows.schema.fields if f.name != html]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + (", " if others else "") + "text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in chunks(batch.column(html), 8 << 20):
                part = batch.slice(begin, end - begin)
                text = [main_text(x.as_py()) for x in part.column(html)]
                names = [f.name for f in others]
                columns = [*(part.column(c) for c in names), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
                yield pa.record_batch(columns, names=[*names, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
