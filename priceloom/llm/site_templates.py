"""HTML extraction by site template removal.

Pages are parsed into element trees. Every block subtree is hashed (names, texts and the blocks inside it); Spark counts
the pages of each host that hold a hash, and subtrees that recur on at least MIN_PAGES pages and MIN_SHARE of the host's
pages, or on MANY_PAGES, are site template and are cut. Of a page with article (or main) elements only these count; a
block inside them is counted once for each different element around it, since sites may carry one article many times.

Menus, asides, footers, forms and the like are cut by element name or role. Class names and ids are evidence and no more:
a name that says nothing but advert, notice, sidebar, comments or another part beside the article makes HINTED_PAGES
enough for its block, and cuts a container that differs from page to page unless it holds a first heading or half of the
page's prose (comments: all of it). Paragraphs, items and the like go by names of adverts and readers' words. What stands
inside a cut element goes with it, articles of readers' comments or teasers included; only a form around the page's main
element stays.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.llm.common import Scratch, append_columns, fresh_name

MIN_PAGES = 5
MIN_SHARE = 0.3
MANY_PAGES = 50
HINTED_PAGES = 2
#: Hosts whose page counts are sent to every task; more are joined by shuffle.
BROADCAST_HOSTS = 200_000

#: Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOT_CONTENT = frozenset(
    "head script style textarea title noscript iframe template nav footer aside form button select input label fieldset dialog menu svg math canvas object audio video map "
    "xmp noembed noframes".split()
)
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "option": frozenset(["option", "optgroup"]),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class name or id that say a part beside the article, readers' words, and words that say nothing about it.
PART_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer "
    "share sharing social related recommended widget widgets pagination pager toolbar copyright login skip".split()
)
READER_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
PLAIN_WORDS = frozenset("area author bar block body bottom box buttons container content date entry form global inner item items left links list meta reader right section site text top user wrapper".split())
#: Words of an advert; of the names above, those that cut a block of the article's own words are these and readers' words.
ADVERT_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())
MAIN = frozenset(["article", "main"])

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"[^>=]*+(?:=\s*+(?:(?:\"[^\"]*+\"|'[^']*+')|(?![\"']))[^>=]*+)*+>")
_SPLIT = re.compile(r"[^a-zA-Z]+")


def hint_of(names: str, words: frozenset[str] = PART_WORDS) -> int:
    """2 if one of the names in a class or id says readers' words, 1 for another part beside the article (of words), else 0."""
    found = 0
    for name in names.lower().split():
        said = {w for w in _SPLIT.split(name) if w}
        if said <= words | READER_WORDS | PLAIN_WORDS:
            found = max(found, 2 if said & READER_WORDS else 1 if said & words else 0)
    return found


class Element:
    __slots__ = ("name", "cut", "inside_cut", "hint", "goes", "main", "children", "holds_main", "heading", "prose", "digest")

    def __init__(self, name: str, tag: str) -> None:
        self.name = name
        self.children: list[Element | str] = []
        self.main = name in MAIN
        self.holds_main = self.heading = self.inside_cut = self.goes = False
        self.cut = name in NOT_CONTENT
        self.hint = self.prose = self.digest = 0
        if "=" in tag:
            for key, *values in _ATTRIBUTE.findall(tag):
                value = "".join(values)
                if key.lower() == "role":
                    self.cut |= value.lower() in ROLES
                    self.main |= value.lower() == "main"
                elif name not in ("html", "body", "main"):
                    self.hint = max(self.hint, hint_of(value))
                    self.goes |= self.hint > 0 and (name not in PROSE or hint_of(value, ADVERT_WORDS) > 0)


class Open:
    """The elements that are open, with the places of each name, of blocks and of main elements among them, so that no tag
    has to look through them all."""

    def __init__(self, root: Element) -> None:
        self.stack = [root]
        self.named: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.mains: list[int] = []

    def push(self, element: Element) -> None:
        at = len(self.stack)
        self.stack.append(element)
        self.named.setdefault(element.name, []).append(at)
        if element.name in BLOCK:
            self.blocks.append(at)
        if element.main:
            self.mains.append(at)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            element = self.stack.pop()
            self.named[element.name].pop()
            if element.name in BLOCK:
                self.blocks.pop()
            if element.main:
                self.mains.pop()

    def close(self, name: str) -> None:
        """A closing tag without an open element does nothing; one of a paragraph or item does not reach out of a main element."""
        at = self.named.get(name)
        if at and not (name in CLOSED_BY and self.mains and self.mains[-1] > at[-1]):
            self.cut(at[-1])

    def imply(self, name: str) -> None:
        """Closes the innermost block if an element of this name ends it."""
        if self.blocks and name in CLOSED_BY.get(self.stack[self.blocks[-1]].name, ()):
            self.cut(self.blocks[-1])


def parse(page: str) -> Element:
    """The element tree of a page; unclosed, unmatched and implied tags are treated as browsers do, comments are left out.

    Linear in the page's length: what has been looked for in vain once is not looked for again.
    """
    root = Element("html", "")
    is_open = Open(root)
    at, size, last = 0, len(page), page.rfind(">")
    quotes = True
    while at < size:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            begin = size
        if begin > at:
            is_open.stack[-1].children.append(page[at:begin])
            at = begin
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(page, at, at + 64)
        if not name and page[at + 1] not in "!?":
            is_open.stack[-1].children.append("<")
            at += 1
            continue
        end = page.find(">", at) + 1
        if quotes and "=" in page[at:end] and name:
            whole = _QUOTED.match(page, at)
            end, quotes = (whole.end(), True) if whole else (end, False)
        tag, at = page[at:end], end
        if not name:
            continue
        name = name[1].lower()
        if tag[1] == "/":
            is_open.close(name)
            continue
        if name == "html":
            continue
        is_open.imply(name)
        element = Element(name, tag)
        is_open.stack[-1].children.append(element)
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else size
        elif name not in VOID and not tag.endswith("/>"):
            is_open.push(element)
    return root


def walk(root: Element) -> list[Element]:
    """All elements, parents before their children."""
    out, queue = [], [root]
    while queue:
        element = queue.pop()
        out.append(element)
        queue += [c for c in reversed(element.children) if isinstance(c, Element)]
    return out


def spare_forms(order: list[Element]) -> None:
    """Forms around a main element that nothing else inside them cuts are the page's frame; no form is around another."""
    holds: dict[int, bool] = {}
    for element in reversed(order):
        inner = any(holds.get(id(c)) for c in element.children if isinstance(c, Element))
        if element.name == "form" and inner:
            element.cut = False
        holds[id(element)] = (inner or element.main) and not element.cut


def understood(root: Element) -> Element:
    """Fills in prose and heading, then what is cut by its name, then holds_main and the digests of blocks."""
    order = walk(root)
    spare_forms(order)
    for element in reversed(order):
        if not element.cut:
            element.heading = element.name == "h1"
            for c in element.children:
                if isinstance(c, str):
                    element.prose += len(c) - c.count(" ")
                else:
                    element.prose += c.prose
                    element.heading |= c.heading
    for element in order:
        if element.goes and not element.heading:
            most = root.prose if element.hint == 2 and element.name not in PROSE else root.prose / 2
            element.cut |= element.prose < most
    for element in order:
        element.main &= not (element.cut or element.inside_cut)
        for c in element.children:
            if isinstance(c, Element):
                c.inside_cut = element.cut or element.inside_cut
    for element in reversed(order):
        element.holds_main = any(c.main or c.holds_main for c in element.children if isinstance(c, Element))
    hashed: list[list[bytes]] = [[]]
    queue: list[tuple[Element | str, bool]] = [(root, False)]
    while queue:
        node, done = queue.pop()
        if isinstance(node, str):
            hashed[-1].append(b"\1" + " ".join(node.split()).encode("utf-8", "surrogatepass"))
        elif done and node.name in BLOCK:
            digest = hashlib.blake2b(b"\0".join(hashed.pop()), digest_size=8).digest()
            node.digest = int.from_bytes(digest, "little", signed=True)
            hashed[-1].append(b"\2" + digest)
        elif done:
            hashed[-1].append(b"\3")
        else:
            name = node.name.encode("utf-8", "surrogatepass")
            if node.name in BLOCK:
                hashed.append([name])
            else:
                hashed[-1].append(b"\4" + name)
            queue.append((node, True))
            queue += [(c, False) for c in reversed(node.children)]
    return root


def candidates(root: Element) -> set[tuple[int, int | None, bool]]:
    """Of the subtrees that may be site template, neither a main element nor around one: digest, the digest of the outermost
    main element around it, and whether its name hints at a part beside the article."""
    found: set[tuple[int, int | None, bool]] = set()
    queue: list[tuple[Element, int | None]] = [(root, None)]
    while queue:
        element, around = queue.pop()
        if element.cut:
            continue
        if not element.main and not element.holds_main and element.name in BLOCK and element.name not in ("html", "body"):
            found.add((element.digest, around, element.hint > 0))
        inner = element.digest if around is None and element.main else around
        queue += [(c, inner) for c in element.children if isinstance(c, Element)]
    return found


def extract(root: Element, template: set[int]) -> str:
    """The page's blocks, one per line."""
    blocks: list[str] = []
    open_text: list[str] = []

    def close() -> None:
        if text := " ".join(entities.unescape("".join(open_text)).split()):
            blocks.append(text)
        open_text.clear()

    # (element or text, inside a main element); None closes a block.
    queue: list[tuple[Element | str | None, bool]] = [(root, not root.holds_main)]
    while queue:
        node, inside = queue.pop()
        if node is None:
            close()
            continue
        if isinstance(node, str):
            if inside:
                open_text.append(node)
            continue
        if node.cut or node.name == "header" and not root.holds_main:
            if node.name in BLOCK:
                close()
            continue
        if node.name in BLOCK and node.digest in template and not node.main and not node.holds_main:
            close()
            continue
        if node.name == "br":
            open_text.append(" ")
            continue
        inside = inside or node.main
        if node.name in BLOCK:
            close()
            queue.append((None, inside))
        queue += [(c, inside) for c in reversed(node.children)]
    close()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; an empty string if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def each_text(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column one by one, so that a task holds its batch's pages once."""
    return (x.as_py() for x in column)


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(page, host, subtrees) of (page, host, html): the distinct candidate subtrees of each page."""
    fields = T.StructType([T.StructField("digest", T.LongType()), T.StructField("around", T.LongType()), T.StructField("hinted", T.BooleanType())])
    schema = T.StructType([pages.schema["page"], T.StructField("host", T.StringType()), T.StructField("subtrees", T.ArrayType(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, columns = [0], ([], [], [])
            for page in each_text(batch.column(2)):
                for found in sorted(candidates(understood(parse(page))), key=str) if page else ():
                    for column, x in zip(columns, found, strict=True):
                        column.append(x)
                ends.append(len(columns[0]))
            arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields.names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=schema.names)

    return pages.mapInArrow(run, schema)


def template_subtrees(
    subtrees: DataFrame, pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, hinted_pages: int = HINTED_PAGES, scratch: Scratch | None = None
) -> DataFrame:
    """(host, digest) of the subtrees (host, digest, around, hinted) that recur across a host's pages, or across its
    different main elements. pages has a row with its host for each page."""
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    if scratch:  # beyond what is sent out a table, so that a host of very many subtrees can be split
        few = pages.select("host").distinct().limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
        hosts = F.broadcast(hosts) if few else scratch.write(hosts, "hosts")
    each = subtrees.groupBy("host", "digest", "around").agg(F.count(F.lit(1)).alias("n"), F.max("hinted").alias("hinted"))
    counts = each.groupBy("host", "digest").agg(F.sum(F.when(F.col("around").isNull(), F.col("n")).otherwise(1)).alias("n"), F.max("hinted").alias("hinted"))
    counts = counts.where((F.col("n") >= min_pages) | F.col("hinted") & (F.col("n") >= hinted_pages))
    often = (F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("n_pages")) | (F.col("n") >= many_pages)
    return counts.join(hosts, "host").where(often | F.col("hinted") & (F.col("n") >= hinted_pages)).select("host", "digest")


def main_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """Every row of df with its main text and n_chars (code points).

    A null or empty page gives an empty text. A page without a host counts among the pages of the empty host. Repeated
    rows count each and get equal texts; long pages take time in proportion to their length. Columns named text and
    n_chars are replaced, others pass through. An empty table gives an empty table.
    """
    scratch = Scratch(df.sparkSession, "pages")
    key = F.struct(F.col(id_col), F.xxhash64(url_col, html_col))
    pages = df.select(key.alias("page"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    trees = scratch.write(page_subtrees(pages), "subtrees")
    subtrees = trees.select("page", "host", F.explode("subtrees").alias("s")).select("page", "host", "s.*")
    templates = scratch.write(template_subtrees(subtrees, trees.select("host"), min_pages, min_share, scratch=scratch), "site-templates")
    found = subtrees.select("page", "host", "digest").join(templates, ["host", "digest"]).groupBy("page").agg(F.collect_set("digest").alias("template"))
    cuts = scratch.write(found, "page-templates")
    scratch.drop(trees, templates)
    page_key, gone = fresh_name(df, "template_page"), fresh_name(df, "template_digests")
    joined = df.join(cuts.select(F.col("page").alias(page_key), F.col("template").alias(gone)), key.eqNullSafe(F.col(page_key)), "left").drop(page_key)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        pages = each_text(batch.column(batch.schema.get_field_index(html_col)))
        template = batch.column(batch.schema.get_field_index(gone))
        texts = [extract(understood(parse(p)), set(t.as_py() or ())) if p else "" for p, t in zip(pages, template, strict=True)]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return append_columns(joined, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], run).drop(gone)
