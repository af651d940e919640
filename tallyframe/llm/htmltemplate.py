"""HTML extraction by the template that a host's pages share.

Every page is read as tags, each told apart by its path of open elements, and stretches of text. Over all
pages of a host a token has an occurrence vector, its count on each page; tokens with equal vectors form an
equivalence class. Vectors are compared by their number of pages and an order-free checksum, which partial
sums give without gathering a host's pages. A class is valid if its tokens are found once a page, on at least
half of the pages, are LEAST_TOKENS or more and hold an element: what happens to be repeated, a stock line in
some articles, has a vector of its own and is in no valid class. The class of the most pages is the template's
root, and another is nested in it if all its tokens lie in one element of the template or of a class nested
before. What lies between the template's tokens are its slots:

- a text that is a token of the template never varies, so it is not the page's own,
- the deepest element of the template that holds nearly all text that varies is the main slot, and what is in
  it, with the page's first heading if that stands outside, is the article.

Elements that are menus, headers, footers, sidebars, notices, adverts, forms, comments and the like by their
names or attributes are never part of the article. Marks of an article (article, main) check the result: on
a page whose marked element holds other text than the main slot, the marked element is the region and all in
it that is left is kept, repeated or not. Hosts of one or two pages, and pages without the main slot, have no
template and rely on marks alone.

Defined results: a null or empty html has an empty text; broken or cut-off markup is read as far as it goes;
a null url is a host of its own; repeated rows count as pages each and give equal texts; other columns are
ignored; an empty table stays empty.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
ASIDE = set("nav footer aside form script style noscript template iframe svg math button select textarea input dialog menu head object canvas audio video datalist option title".split())
#: Elements that leave a head open; any other, or text, ends it.
IN_HEAD = set("html head base basefont bgsound link meta title style script noscript noframes template".split())
ENDS_P = BLOCKS - {"body", "html", "tbody", "tfoot", "thead", "tr", "caption", "legend", "summary"}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class and id attributes that name what is not the article.
NAMED = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments "
    "commentlist disqus reply replies respond share sharing social related recommended recommendations popup modal overlay toolbar login widget widgets "
    "pagination pager skip masthead topbar bottombar banner alert".split()
)
HEADS = set("header masthead".split())
#: Of these, words that name other things too; inside a marked article they are left alone.
LOOSE = set(
    "related recommended recommendations share sharing social popup modal overlay toolbar login widget widgets pagination pager skip masthead topbar bottombar banner alert promo promos promotion".split()
)
ARTICLE_NAMES = {"articlebody", "article", "post", "entry", "story", "content", "main"}

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?P<end>>)"
    r"|<[A-Za-z/][^>]*\Z|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


class Element:
    __slots__ = ("name", "path", "aside", "article", "order")

    def __init__(self, name: str, path: str, aside: bool, article: int, order: int):
        self.name, self.path, self.aside, self.article, self.order = name, path, aside, article, order


def _judged(name: str, attrs: str, inside: bool) -> tuple[bool, int]:
    """Whether the element is not part of an article; how strongly it is marked as one (3 to 0)."""
    if name in ASIDE:
        return True, 0
    if not attrs or attrs.isspace():
        return name == "header" and not inside, {"article": 3, "main": 2}.get(name, 0)
    a = attributes(attrs)
    role, given = a.get("role", "").lower(), f"{a.get('class', '')} {a.get('id', '')}"
    words = {w.lower() for w in _WORD.findall(given)}
    hidden = "hidden" in a or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""))
    if hidden or role in ROLES or name not in ("body", "html") and (words & (NAMED - LOOSE if inside else NAMED) or not inside and (words & HEADS or name == "header")):
        return True, 0
    if name in ("body", "html"):
        return False, 0
    marked = 3 if name == "article" or role == "article" or "articlebody" in a.get("itemprop", "").lower() else 2 if name == "main" or role == "main" else 1 if words & ARTICLE_NAMES else 0
    return False, marked


class Page:
    """Elements and stretches of text of a page, in order."""

    def __init__(self, source: str):
        self.elements: list[Element] = []
        #: (text, open elements' indices with the innermost last, number of its block)
        self.texts: list[tuple[str, tuple[int, ...], int]] = []
        stack: list[int] = []
        block, at = 0, 0
        elements = self.elements

        def close(to: int) -> None:
            nonlocal block
            if any(elements[i].name in BLOCKS for i in stack[to:]):
                block += 1
            del stack[to:]

        def close_head() -> None:
            to = next((k for k, i in enumerate(stack) if elements[i].name == "head"), None)
            if to is not None:
                close(to)

        while at < len(source):
            m = _TOKEN.match(source, at)
            if m is None:
                break
            at = m.end()
            kind = m.lastgroup
            if kind == "text" or kind == "cdata":
                if (t := m.group(kind)) and not t.isspace():
                    close_head()
                    self.texts.append((t if kind == "cdata" else html.unescape(t), tuple(stack), block))
                elif t and self.texts:
                    self.texts.append((" ", tuple(stack), block))
            elif kind == "close":
                name = m["close"].lower()
                to = next((k for k in range(len(stack) - 1, -1, -1) if elements[stack[k]].name == name), None)
                if to is not None:
                    close(to)
                elif name == "p" or name in BLOCKS:
                    block += 1
            elif kind == "end":
                name, attrs = m["open"].lower(), m["attrs"]
                if name not in IN_HEAD:
                    close_head()
                if name == "br":
                    self.texts.append((" ", tuple(stack), block))
                    continue
                if name in ENDS_P:
                    to = next((k for k in range(len(stack) - 1, -1, -1) if elements[stack[k]].name in ("p", "table", "td", "button")), None)
                    if to is not None and elements[stack[to]].name == "p":
                        close(to)
                if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
                    stop = {"ul", "ol", "dl", "table", "select", "menu"}
                    for k in range(len(stack) - 1, -1, -1):
                        if elements[stack[k]].name in ends:
                            close(k)
                            break
                        if elements[stack[k]].name in stop:
                            break
                if name in BLOCKS:
                    block += 1
                elif name in ("td", "th"):
                    self.texts.append((" ", tuple(stack), block))
                up = elements[stack[-1]] if stack else None
                aside, article = _judged(name, attrs, any(elements[i].article >= 2 for i in stack))
                path = f"{up.path if up else ''}/{name}" + (f"[{' '.join(sorted(attrs.split()))}]" if attrs.strip() and name not in ("a", "img") else "")
                element = Element(name, path, aside or bool(up and up.aside), 0 if aside else article, len(elements))
                elements.append(element)
                if name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else len(source)
                elif name not in VOID and not attrs.rstrip().endswith("/"):
                    stack.append(element.order)
                elif attrs.rstrip().endswith("/") and name not in VOID:
                    stack.append(element.order)

    def own(self) -> list[tuple[str, tuple[int, ...], int]]:
        """Texts outside of elements that are never part of an article."""
        return [t for t in self.texts if not t[1] or not self.elements[t[1][-1]].aside]

    def text_path(self, t: tuple[str, tuple[int, ...], int]) -> str:
        return f"{self.elements[t[1][-1]].path if t[1] else ''}#{' '.join(t[0].split())}"


def _blocks(texts: list[tuple[str, tuple[int, ...], int]]) -> str:
    blocks: dict[int, list[str]] = {}
    for text, _, block in texts:
        blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n\n".join(b for b in joined if b)


def _slot(page: Page, own: list, main: str, constant: set[int] | frozenset[int]) -> list | None:
    """What the main slot holds, without texts of the template, after the first heading of level one if the slot has none."""
    slot = {e.order for e in page.elements if e.path == main}
    inner = [t for t in own if not slot.isdisjoint(t[1])]
    if not any(not t[0].isspace() for t in inner):
        return None
    heads = {e.order for e in page.elements if e.name == "h1"}
    if all(heads.isdisjoint(t[1]) for t in inner):
        first = next((i for t in own for i in t[1] if i in heads and not t[0].isspace()), None)
        inner = [t for t in own if first is not None and first in t[1]] + inner
    return [t for t in inner if t[0].isspace() or hashed(page.text_path(t)) not in constant]


def extracted(source: str | None, main: str | None = None, constant: set[int] | frozenset[int] = frozenset()) -> str:
    """The article's blocks; main: path of the main slot, constant: hashes of texts of the template."""
    page = Page(source or "")
    own = page.own()
    slot = _slot(page, own, main, constant) if main is not None else None
    marked = max((page.elements[i].article for t in own for i in t[1] if not t[0].isspace()), default=0)
    if slot is None:
        if marked:
            own = [t for t in own if any(page.elements[i].article == marked for i in t[1])]
        return _blocks([t for t in own if t[0].isspace() or marked >= 2 or hashed(page.text_path(t)) not in constant])
    text = _blocks(slot)
    if marked >= 2 and (said := _blocks([t for t in own if any(page.elements[i].article == marked for i in t[1])])) != text:
        return said
    return text


def hashed(token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


TOKENS = "host string, token long, path string, count int, vector long, chars long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per distinct token of a page: elements by their path, with the length of the text in them, and stretches of text, by # and the path above."""
    names = [x.split()[0] for x in TOKENS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    for part in common.slices(batches):
        rows = []
        for host, key, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
            page = Page(source.as_py() or "")
            found: dict[tuple[str, bool], list[int]] = {}
            under: dict[str, str] = {}
            for e in page.elements:
                if not e.aside:
                    found.setdefault((e.path, True), [0, 0])[0] += 1
            for t in page.own():
                if not t[0].isspace():
                    for path in {page.elements[i].path for i in t[1]}:
                        found[path, True][1] += len(t[0])
                    found.setdefault((page.text_path(t), False), [0, len(t[0])])[0] += 1
                    under[page.text_path(t)] = "#" + (page.elements[t[1][-1]].path if t[1] else "")
            for (path, element), (count, chars) in found.items():
                rows.append((host, hashed(path), path if element else under[path], count, hashed(f"{key} {count}") >> 20, chars))
        columns = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


#: A class must be on this share of a host's pages, and on this many, and have so many tokens; texts that vary lie in the main slot to this share.
SHARE, LEAST_PAGES, LEAST_TOKENS, MAIN_SHARE = 0.5, 3, 3, 0.8
#: Templates of at most this many tokens in all are sent to every executor; beyond, the join is by host.
MOST_SENT = 50_000


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _inside(path: str, top: str) -> bool:
    return path == top or path.startswith(f"{top}/") or top == ""


def template(tokens: list[tuple[int, str, int, int, int]], least: int = LEAST_TOKENS) -> tuple[str | None, list[int]]:
    """Main slot and constant texts from a host's tokens that are once a page on enough pages: (token, path, pages, vector, chars)."""
    classes: dict[tuple[int, int], list] = {}
    for t in tokens:
        classes.setdefault((-t[2], t[3]), []).append(t)
    valid = [(k, len(m), m) for k, m in classes.items() if len(m) >= least and any(not t[1].startswith("#") for t in m)]
    elements: dict[str, int] = {}
    texts: list[tuple[int, str, int]] = []
    for _, _, members in sorted(valid, key=lambda c: (c[0][0], -c[1], c[0][1])):  # the most pages first, then the most tokens
        paths = [t[1].lstrip("#") if t[1].startswith("#") else t[1].rpartition("/")[0] for t in members]
        around = min(paths, key=len)  # the element that all are in, if they are in one
        if elements and not (around in elements and all(_inside(p, around) for p in paths)):
            continue
        elements |= {t[1]: t[4] for t in members if not t[1].startswith("#")}
        texts += [(t[0], t[1][1:], t[4]) for t in members if t[1].startswith("#")]
    varies = {e: chars - sum(n for _, under, n in texts if _inside(under, e)) for e, chars in elements.items()}
    most = max(varies.values(), default=0)
    slots = [(e.count("/"), e) for e, n in varies.items() if most > 0 and n >= MAIN_SHARE * most]
    return (max(slots)[1] if slots else None), sorted(t for t, _, _ in texts)


def templates(pages: DataFrame) -> DataFrame:
    """host, main (path of the main slot), constant (hashes of the texts that the template holds)."""
    rows = common.lean(pages).select(host_of().alias("host"), F.xxhash64("page_id", "url").alias("key"), "html").mapInArrow(_tokens, TOKENS)
    tokens = rows.groupBy("host", "token").agg(F.max("path").alias("path"), F.count("*").alias("pages"), F.max("count").alias("most"), F.sum("vector").alias("vector"), F.sum("chars").alias("chars"))
    tokens = common.stored(tokens.where("pages > 1"), "html-tokens")
    n = common.stored(pages.groupBy(host_of().alias("host")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES), "html-hosts")
    n = common.small(n, n.count())  # so a large host's tokens are not dealt to one task
    # at most twice the tokens that a page of the host has on average
    valid = tokens.join(n, "host").where((F.col("most") == 1) & (F.col("pages") >= SHARE * F.col("n"))).select("host", "token", "path", "pages", "vector", "chars")

    def run(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        main, constant = template(list(group[["token", "path", "pages", "vector", "chars"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"host": [key[0]], "main": [main], "constant": [constant]})

    return valid.groupBy("host").applyInPandas(run, "host string, main string, constant array<long>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = common.stored(templates(pages), "html-templates")
    size = found.agg(F.sum(F.coalesce(F.size("constant"), F.lit(0)) + 1)).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of().alias("host")).join(F.broadcast(found) if size <= MOST_SENT else found, "host", "left").select("page_id", "url", "html", "main", "constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            texts = [extracted(h.as_py(), m, frozenset(c.as_py() or ())) for h, m, c in zip(part.column(2), part.column(3).to_pylist(), part.column(4))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op10_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))
