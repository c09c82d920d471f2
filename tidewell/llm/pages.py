"""HTML extraction by equivalence-class template deduction.

1. Tokens. Each page is read once into its elements and its text blocks. Tokens are elements (by their path of names,
   class words and ids; digits in these do not tell elements apart) and block texts (with their path and occurrence
   number; a text that a page shows twice is two tokens).
2. Classes. For each host, a token's occurrence vector (how often it stands on which page) is kept as a digest that
   adds up over pages, so vectors of a host with a third of all pages are formed by partial sums and never gathered.
   Pages of a host with the same blocks, out of parts known by name, are one content: copies of a page count once.
   Tokens of one host with the same vector are an equivalence class; it is valid on MIN_PAGES contents or more.
3. Template. Elements nest by their paths. A text belongs to the template if its class also holds an element around
   it (the page itself included) and it has the same place among the blocks of its path on every page, counted from
   the first or the last. Bare text elements (`p`, `h1`, `li`, ... without class or id) are not elements of a template.
4. Slots. What the template's elements hold beside fixed texts are slots. The article's slot is found by descent: from
   the page down, the element that stands once on its pages and holds more than half of the words (out of links, out
   of fixed texts) of the pages of its class, as far as there is one. Its own texts are never taken for template;
   inside it, elements of a class with fixed texts of their own, and parts known by name, are left out. (Where no
   element below `body` holds it, all fixed texts are.)
5. Ties. `article` and `main` elements only settle what the words leave open: the slot is widened to the one around
   it, or, where there are too few pages or no element holds half of the words, narrowed to the page's only one.
   A page's first heading before a slot without one belongs to it.

Parts known by name are elements (`nav`, `form`, ...), roles, and class words and ids of which every word is known
(`site-footer`, not `no-sidebar`). Such a part never holds the article's slot, is kept if it holds an `article` or `main`, or nearly all
text of a page in three paragraphs or more, and headings are never dropped for their class. Character references are
decoded; white space inside a block becomes one space; blocks are trimmed and joined in page order by a blank line.

Null and empty html give an empty text; pages without a host share one; broken or truncated markup is read as far as
it goes; repeated pages are extracted each; very long pages are read whole; an empty table gives an empty table;
further columns pass through, those with the names of new ones are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, packed, table, unpacked

MIN_PAGES = 3
#: Rows of the templates of all hosts that are broadcast at most (some 20 bytes each); beyond that each page gets its own rows by a join.
TEMPLATE_ROWS = 20_000
#: The share of words that the article's slot holds at least, and the share of a page that is nearly all of it.
HALF, NEARLY_ALL = 0.5, 0.9

#: Names of elements and class words.
RAW = frozenset("script style noscript template textarea title iframe svg math object select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BARE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption legend summary address hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = BARE | frozenset(
    "article aside body center details dialog dir div dl fieldset figure footer form head header hgroup html main menu nav ol optgroup option search section "
    "table tbody tfoot thead ul".split()
)
PARTS = frozenset("head nav footer aside form button dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login "
    "comment comments respond reply replies disqus share sharing social related recommended pagination pager".split()
)
#: Class words that name a part only outside an article.
OUTER = frozenset("header masthead footer banner top bottom".split())
#: Words that may stand beside them in the name of a part.
BESIDE = frozenset("site page main left right top bottom list lists bar box wrap wrapper container inner widget widgets area block slot unit banner links posts buttons icons text form thread section item items".split())
ARTICLE = ("article", "main")
#: Elements that an opening element of the same group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table menu".split())

TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/<>]*)((?:"[^"]*"|'[^']*'|[^<>"'])*)(?:>|\Z))""", re.DOTALL)
#: What is left of a tag where a page is cut off; other text after a bare `<` is text.
TORN = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z-]+=[^<>]*)*\Z")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
DIGITS = re.compile(r"\d+")
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Element:
    """An element of a page; `named`: known by name as a part that is no article text."""

    __slots__ = ("above", "article", "bare", "chars", "depth", "name", "named", "path")

    def __init__(self, name: str, path: str, above: Element | None, bare: bool = False, named: bool = False):
        self.name, self.path, self.above, self.bare, self.named = name, path, above, bare, named
        self.depth = above.depth + 1 if above else 0
        self.article = (above is not None and above.article) or name in ARTICLE
        self.chars = 0

    def line(self):
        """The element and those around it, from the inside."""
        at = self
        while at is not None:
            yield at
            at = at.above


class Block:
    """A text block: its element, its text, and how many of its characters are not in links."""

    __slots__ = ("element", "own", "text")

    def __init__(self, element: Element, text: str, own: int):
        self.element, self.text, self.own = element, text, own


def names_a_part(token: str, inside_article: bool) -> bool:
    """Whether every word of a class word or id is known and one of them names a part."""
    words = [w.lower() for w in SPLIT.split(token) if w]
    known = WORDS if inside_article else WORDS | OUTER
    return any(w in known for w in words) and all(w in known or w in BESIDE for w in words)


def _opened(name: str, raw: str, above: Element) -> Element:
    path, named, told = name, name in PARTS or (name == "header" and not above.article), False
    if raw and not raw.isspace():
        found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}
        tokens = f"{found.get('class', '')} {found.get('id', '')}".replace("/", "|").split()
        if tokens:
            told = True
            path = f"{name}.{'.'.join(sorted({DIGITS.sub('#', w) for w in tokens}))}"
            if name not in ("html", "body", *ARTICLE, *HEADINGS):
                named = named or any(names_a_part(w, above.article) for w in tokens)
        hidden = found.get("aria-hidden", "") == "true" or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
        named = named or hidden or found.get("role", "").lower() in ROLES
    return Element(name, f"{above.path}/{path}", above, name in BARE and not told, named)


def _opened_on(stack: list[tuple[str, Element]], name: str) -> None:
    """Closes what an opening block element closes."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] == "p" or stack[k][0] in CLOSES.get(name, ()):
            del stack[k:]
        elif stack[k][0] in LISTS or (stack[k][0] in BLOCK and name not in CLOSES):
            break


def read_page(html: str) -> tuple[list[Element], list[Block]]:
    """(elements, text blocks) in page order; the first element is the page itself. Inline elements are not told unless named."""
    page = Element("", "", None)
    stack, elements, blocks, held = [("", page)], [page], [], []
    at, size, links, linked = 0, len(html), 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(Block(stack[-1][1], text, max(0, len(text) - linked)))
        linked = 0

    def hold(text: str) -> None:
        nonlocal linked
        held.append(text)
        linked += len(text) if links else 0

    while at < size:
        m = TAG.search(html, at)
        if not m:
            hold(html[at:])
            break
        if m.start() > at:
            hold(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        if not m[0].endswith(">") and not (at == size and TORN.match(html, m.start() + 1)):
            hold(m[0])
            continue
        name, whole = m[2].lower(), m[3].endswith("/")
        if m[1]:
            links -= name == "a" and links > 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if stack[k][1] is not stack[k - 1][1]:
                        close()
                    del stack[k:]
                    break
        elif name == "br":
            held.append(" ")
        elif name in RAW:
            if not whole:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = end.start() if end else size
        else:
            if name in BLOCK:
                close()
                _opened_on(stack, name)
            if name in VOID:
                continue
            links += name == "a" and not whole
            new = _opened(name, m[3], stack[-1][1])
            if name not in BLOCK and not new.named:
                new = stack[-1][1]
            elif not whole:
                close()
                elements.append(new)
            if not whole:
                stack.append((name, new))
    close()
    for b in blocks:
        for e in b.element.line():
            e.chars += b.own
    _keep_holders(elements, blocks)
    return elements, blocks


def open_(e: Element, below: Element | None = None) -> bool:
    """Whether neither the element nor one around it (up to `below`) is a part known by name."""
    for x in e.line():
        if x is below:
            return True
        if x.named:
            return False
    return True


def _keep_holders(elements: list[Element], blocks: list[Block]) -> None:
    """Named parts that hold the page's only articles, or nearly all of its text, are no such parts."""
    articles = [e for e in elements if e.name in ARTICLE]
    if articles and not any(map(open_, articles)):
        for e in articles:
            for x in e.line():
                x.named = x.named and x.name == "head"
    paragraphs = Counter(id(x) for b in blocks if b.element.name == "p" for x in b.element.line() if x.named)
    for e in elements:
        if e.named and e.chars and e.chars >= NEARLY_ALL * elements[0].chars and paragraphs[id(e)] >= 3:
            e.named = False


def token(path: str, text: str = "") -> int:
    """The token of an element (the page: 0) or of a text."""
    if not path and not text:
        return 0
    h = xxhash.xxh64_intdigest(f"{path}\n{text}" if text else path)
    return h - (1 << 64) if h >> 63 else h


def _around(e: Element) -> list[int]:
    """The page and the elements around a text that a template can have, from the outside."""
    return [token(x.path) for x in e.line() if not x.bare][::-1]


def _numbered(blocks: list[Block]) -> list[tuple[Block, int, int, int]]:
    """(block, token, place from the first, from the last block of its path) of the blocks outside named parts."""
    shown = [b for b in blocks if open_(b.element)]
    total, place, times = Counter(b.element.path for b in shown), Counter(), Counter()
    out = []
    for b in shown:
        path = b.element.path
        out.append((b, token(path, f"{times[path, b.text]}\n{b.text}"), place[path], total[path] - place[path]))
        place[path] += 1
        times[path, b.text] += 1
    return out


TOKENS = "content long, tokens array<struct<token:long, n:int, chars:long, page:long, core:boolean, around:array<long>, front:int, back:int>>"


def _tokens(pages: list) -> list:
    """For each page: a digest of its content, and its distinct tokens: elements with how often they stand and what they hold, texts with their place."""
    contents, out = [], []
    for html in pages:
        elements, blocks = read_page(html or "")
        numbered = _numbered(blocks)
        contents.append(token("content", "\n".join(f"{b.element.path}\n{b.text}" for b, *_ in numbered)))
        known: dict[str, dict] = {}
        for e in elements:
            of = known.setdefault(e.path, {"token": token(e.path), "n": 0, "chars": 0, "page": elements[0].chars, "core": True, "around": None, "front": None, "back": None})
            of["n"] += 1
            of["chars"] += e.chars
            of["core"] = of["core"] and e.above is not None and not e.bare and open_(e)
        texts = [{"token": t, "n": 1, "chars": b.own, "page": 0, "core": False, "around": _around(b.element), "front": front, "back": back} for b, t, front, back in numbered]
        out.append([*known.values(), *texts])
    return [contents, out]


def _outermost(elements: list[Element]) -> list[Element]:
    chosen = set(map(id, elements))
    return [e for e in elements if not any(id(x) in chosen for x in e.line() if x is not e)]


def article_of(elements: list[Element], cores: set[int]) -> Element:
    """The element that holds the article's slot; the page where nothing tells."""
    slot, left = elements[0], [e for e in elements if token(e.path) in cores and open_(e)]
    while left:
        slot = max(_outermost(left), key=lambda e: e.chars)
        left = [e for e in left if e is not slot and slot in e.line()]
    for name in ARTICLE:
        wider = next((x for x in slot.line() if x.name == name), None)
        if wider:
            return wider
    for name in ARTICLE:
        inside = _outermost([e for e in elements if e.name == name and open_(e) and slot in e.line()])
        if len(inside) == 1:
            return inside[0]
    return slot


def main_text(html: str | None, cores: set[int], fixed: dict[int, int]) -> str:
    """The text of the article's slot; fixed: texts of the template and the innermost element of their class around them."""
    elements, blocks = read_page(html or "")
    slot = article_of(elements, cores)
    whole = slot.name in ("", "html", "body")

    def constant(b: Block, t: int) -> bool:
        if t not in fixed:
            return False
        line = b.element.line()
        return whole or any(token(x.path) == fixed[t] for x in iter(lambda: next(line), slot))

    out, before, headed = [], None, whole or slot.name in ARTICLE
    for b, t, _, _ in _numbered_in(blocks, slot):
        if slot in b.element.line():
            headed = headed or b.element.name in HEADINGS
            if not constant(b, t):
                out.append(b.text)
        elif not out and b.element.name == "h1" and t not in fixed:
            before = b.text
    return "\n\n".join([before, *out] if before and out and not headed else out)


def _numbered_in(blocks: list[Block], slot: Element) -> list[tuple[Block, int, int, int]]:
    return [x for x in _numbered(blocks) if slot not in x[0].element.line() or open_(x[0].element, slot)]


def _extract(rows: list) -> list:
    texts = []
    for r in rows:
        told = r["template"] or ()
        texts.append(main_text(r["html"], {t["token"] for t in told if t["by"] is None}, {t["token"]: t["by"] for t in told if t["by"] is not None}))
    return [texts, [len(t) for t in texts]]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def read_tokens(pages: DataFrame) -> DataFrame:
    """(host, h: digest of the html, row, content, tokens) from pages(url, html), written."""
    page = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("h"), F.monotonically_increasing_id().alias("row"), F.col("html").alias("text"))
    return cut(map_texts(page, _tokens, TOKENS), "pages-tokens")


def occurrence_vectors(read: DataFrame) -> DataFrame:
    """(host, token, around, pages, v1, v2, ...) of the tokens on MIN_PAGES contents or more; v1, v2: digest of the occurrence vector."""
    first = read.groupBy("host", "content").agg(F.min("row").alias("row"))
    one = read.join(first.select("row"), "row", "left_semi")
    seen = one.select("host", "content", F.explode("tokens").alias("t")).select("host", "content", "t.*")
    entry = F.xxhash64("content", "n")
    placed = (F.min("front") == F.max("front")) | (F.min("back") == F.max("back"))
    return seen.groupBy("host", "token", "around").agg(
        F.count("*").alias("pages"), F.sum(entry.bitwiseAND(F.lit(0x7FFFFFFF))).alias("v1"), F.sum(F.shiftrightunsigned(entry, 33)).alias("v2"),
        F.max("n").alias("most"), F.sum("chars").alias("chars"), F.sum("page").alias("page"), F.min("core").alias("core"), placed.alias("placed"),
    ).where(F.col("pages") >= MIN_PAGES)


def deduce_templates(read: DataFrame) -> DataFrame:
    """(host, token, by), written: the elements of a host that hold the article's slot (by is null), and its fixed texts with the innermost element of their class."""
    vectors = cut(occurrence_vectors(read), "pages-vectors")
    elements = vectors.where("around is null")
    mates = elements.select("host", F.col("token").alias("element"), "pages", "v1", "v2")
    texts = vectors.where("around is not null and placed").select("host", "token", "pages", "v1", "v2", "chars", F.posexplode("around").alias("depth", "element"))
    by = texts.join(mates, ["host", "element", "pages", "v1", "v2"]).groupBy("host", "token").agg(F.max(F.struct("depth", "element"))["element"].alias("by"))
    fixed = cut(by, "pages-fixed")
    under = texts.join(fixed, ["host", "token"], "left_semi").groupBy("host", F.col("element").alias("token")).agg(F.sum("chars").alias("still"))
    held = elements.join(under, ["host", "token"], "left").withColumn("still", F.coalesce("still", F.lit(0)))
    page = held.where("token = 0").select("host", F.col("pages").alias("all_pages"), F.col("still").alias("all_still"))
    rest = F.col("page") - F.col("all_still") * F.col("pages") / F.col("all_pages")
    cores = held.where("core and most = 1").join(page, "host").where((F.col("chars") - F.col("still") > 0) & (F.col("chars") - F.col("still") > HALF * rest))
    return cut(cores.select("host", "token", F.lit(None).cast("long").alias("by")).unionByName(fixed), "pages-template")


def with_template(pages: DataFrame, read: DataFrame, template: DataFrame) -> DataFrame:
    """pages(host, h, more) plus template: array of (token, by).

    The templates of all hosts are broadcast where they are few rows (counted); so pages are not shuffled. Else each
    page gets the rows that stand on it, since the template of a large host may have far more texts than one page.
    """
    rows = F.collect_list(F.struct("token", "by")).alias("template")
    if template.limit(TEMPLATE_ROWS + 1).count() <= TEMPLATE_ROWS:
        return pages.join(F.broadcast(template.groupBy("host").agg(rows)), "host", "left")
    on_page = read.select("host", "h", F.explode(F.array_distinct(F.transform("tokens", lambda t: t["token"]))).alias("token")).distinct()
    return pages.join(cut(on_page.join(template, ["host", "token"]).groupBy("host", "h").agg(rows), "pages-templates"), ["host", "h"], "left")


def extract_pages(pages: DataFrame, deduce: bool = True) -> DataFrame:
    """pages(url, html, more) with, in place of html: text and n_chars. deduce=False leaves only what names and single pages tell (for comparison)."""
    named = packed(pages, "html").withColumn("host", host_of(F.col("doc.url"))).withColumn("h", F.xxhash64("html"))
    if deduce:
        read = read_tokens(pages)
        rows = with_template(named, read, deduce_templates(read))
    else:
        rows = named.withColumn("template", F.lit(None).cast("array<struct<token:long, by:long>>"))
    rows = rows.select("doc", F.struct("html", "template").alias("page"))
    return unpacked(map_texts(rows, _extract, "text string, n_chars long", "page"), "text", "n_chars")


def op3_pages(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
