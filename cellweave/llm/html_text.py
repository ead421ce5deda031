"""Main text of web pages by site template removal.

Each page is parsed into a tree and its element subtrees are hashed by their tag and
normalised text. Spark counts for each host and hash on how many pages it
stands; subtrees without prose that recur on LEAST_PAGES pages and on a share of SHARE
of the host's pages are deleted, those that hold prose if they recur on LEAST_PAGES
different pages and a share of PROSE_SHARE of them. Pages are different if the least
hashes of their prose's five-word shingles differ: copies of a page, edited or not,
count about once, so that an article doesn't become a template by being copied.

Besides, elements go whose tag, role or class says what they are: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments. Of classes, whole
words count and compounds such as site-header or comment-list; an id is no evidence; and
an element that holds most of the page's text is kept whatever its class or role.

What article elements hold then is the text, unless twice as much prose stands outside
of them, as beside teasers; without them what main holds, on the same terms; else the body.
Inside an article or main, prose is never deleted for recurring, nor through an element
around it. Prose is a paragraph, heading, list item, table cell or the like with text of
its own that isn't just links; inside an article or main, any block with text of its own.

A host keeps at most (candidates per page) / SHARE template hashes, so they travel to
the pages as one row per host: broadcast if there are few hosts, else joined.

Defined results: a null or empty html, and one without text, gives an empty text. A
null url counts as a host of its own. Rows that repeat a page_id are each extracted.
An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import materialise, pieces, table
from cellweave.llm.near_dup import WordHashes, shingle_set

LEAST_PAGES = 5
#: Of a host's different pages, from where on a subtree without prose is a template's, and one that holds prose outside of an article.
SHARE, PROSE_SHARE = 0.1, 0.5
#: Hosts up to which the template hashes are broadcast.
BROADCAST_HOSTS = 5_000

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
SCOPE = frozenset("article aside blockquote body div fieldset figure footer form header html main nav ol section table td th ul dl details dialog button caption".split())
#: A start tag ends an open element of these, up to the nearest of the scopes named.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"})}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt figcaption".split()) | INLINE

#: Elements that are never main text.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe button select option input textarea svg object embed canvas audio video head title menu dialog fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
#: Classes of elements that aren't main text: whole words, first parts of compounds, and last parts after a place's name.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget related recommended cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus replies sharing social toolbar pagination pager skiplink search".split()
)
DROPPED_FIRST = frozenset("ad ads advert sponsored nav navbar navigation menu breadcrumb sidebar cookie cookies consent gdpr newsletter subscribe comment comments share sharing social footer pagination".split())
DROPPED_LAST = frozenset("header footer nav navigation menu bar sidebar banner ad ads comments widget links".split())
PLACES = frozenset("site page main global top bottom left right side primary secondary user reader".split())
#: Ids of blocks that aren't main text; other ids name what a block is about.
DROPPED_IDS = frozenset("comments respond disqus disqus_thread sidebar nav navbar navigation menu footer masthead breadcrumbs".split())
IDENTIFIED = frozenset("div section ul ol table".split())
LISTED = frozenset("posts articles links stories items pages content reading".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|</[^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


class Node:
    __slots__ = ("children", "dropped", "keeps", "key", "mark", "prose", "size", "soft", "tag")

    def __init__(self, tag: str, dropped: bool = False, soft: bool = False):
        self.tag, self.dropped, self.soft, self.children = tag, dropped, soft, []
        self.mark, self.keeps, self.prose, self.size, self.key = 0, False, False, 0, None


def _names_chrome(word: str) -> bool:
    """Whether a word of a class attribute names a part that isn't main text."""
    if word in DROPPED_WORDS:
        return True
    parts = re.split("[-_]+", word)
    if len(parts) < 2:
        return False
    if parts[0] in ("related", "recommended"):
        return parts[1] in LISTED
    return parts[0] in DROPPED_FIRST or parts[-1] in DROPPED_LAST and parts[0] in PLACES


def _unwanted(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element goes in any case, and whether its class or role says that it should."""
    if tag in DROPPED:
        return True, False
    if not attributes or tag in ("body", "html", "main", "article"):
        return False, False
    soft = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        soft = soft or name == "role" and value in DROPPED_ROLES or name == "class" and any(map(_names_chrome, value.split())) or name == "id" and tag in IDENTIFIED and value in DROPPED_IDS
    return False, soft


def parse(page: str) -> Node:
    """The tree; text stands among the children as strings, undecoded."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            stack[-1].children.append(page[at:])
            break
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                stack[-1].children.append(found[0][9:].removesuffix("]]>"))
            continue
        tag, attributes = tag.lower(), found[3]
        if found[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE and stack[k].tag in SCOPE or tag == "p" and stack[k].tag in SCOPE:
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in ENDS:
            ended, scopes = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scopes:
                    break
                if stack[k].tag in ended:
                    del stack[k:]
                    if tag in ("li", "dt", "dd", "option"):
                        break
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and len(stack[-1].tag) == 2 and stack[-1].tag[0] == "h" and stack[-1].tag[1] in "123456":
            stack.pop()
        node = Node(tag, *_unwanted(tag, attributes))
        stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if tag in ("textarea", "title"):
                node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
    return root


def _signed(mark: int) -> int:
    return mark - (1 << 64) if mark >> 63 else mark


def _main_nodes(root: Node) -> list[Node]:
    """The outermost article elements that aren't dropped, else main, unless twice as much prose stands elsewhere; else the whole tree."""
    for wanted in ("article", "main"):
        found, inside, outside, todo = [], 0, 0, [root]
        while todo:
            node = todo.pop()
            if node.dropped:
                continue
            if node.tag == wanted:
                found.append(node)
                inside += node.size
            elif node.prose:
                outside += node.size
            else:
                todo += [c for c in reversed(node.children) if c.__class__ is Node]
        if found and outside <= 2 * inside:
            return found
    return [root]


#: Tells marks of blocks with prose outside of an article from the others.
_PROSE_KEY = 0x5DEECE66D1CE4E5B


def _seal(root: Node) -> list[Node]:
    """Works out the tree: each node's size, mark and whether it goes by its class; the main nodes; which subtrees may be a template's."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if c.__class__ is Node]
    for node in reversed(order):
        parts = [node.tag.encode()]
        for c in node.children:
            if c.__class__ is Node:
                node.size += 0 if c.dropped else c.size
                parts.append(c.mark.to_bytes(8, "little"))
            elif words := c.split():
                node.size += sum(map(len, words))
                parts.append(" ".join(words).encode("utf-8", "surrogatepass"))
        node.mark = xxhash.xxh64_intdigest(b"\0".join(parts))
        node.prose = _is_prose(node)
    for node in order:  # an element with most of the text is no side matter, whatever its class
        node.dropped = node.dropped or node.soft and 2 * node.size <= root.size
    mains = _main_nodes(root)
    tops = {id(x) for x in mains if x is not root}
    walk = [(root, False)]
    for node, inside in walk:  # grows as it is walked: parents before children
        inside = inside or id(node) in tops
        if inside and not node.prose:
            node.prose = _is_prose(node, True)
        walk += [(c, inside) for c in node.children if c.__class__ is Node]
    for node, inside in reversed(walk):
        # a link or dropped element keeps nothing; text in inline elements belongs to the block around them
        node.keeps = not node.dropped and node.tag != "a" and (any(c.__class__ is Node and c.keeps for c in node.children) or node.tag not in INLINE and node.prose)
    outer = {id(root): False}
    for node, inside in walk:
        covered = outer[id(node)]  # within prose, or without interest
        if not covered and node is not root and id(node) not in tops and node.tag not in ("html", "body", "main", "article", "script", "style", "head", "br", "hr", "meta", "link"):
            if node.tag in INLINE and node.tag != "a" or inside and (node.keeps or node.tag == "a"):
                pass
            else:
                node.key = _signed(node.mark ^ _PROSE_KEY if node.keeps else node.mark)
        covered = covered or node.tag in ("script", "style", "head") or node.prose and node.tag not in INLINE
        for c in node.children:
            if c.__class__ is Node:
                outer[id(c)] = covered
    return mains


def _says(text: str) -> bool:
    """Whether there is a letter or digit in it, so that it is more than what parts links."""
    return any(map(str.isalnum, entities.unescape(text) if "&" in text else text))


def _is_prose(node: Node, inside: bool = False) -> bool:
    """Whether it is text with inline elements only, and not just links; inside an article, any block with text directly in it."""
    if inside and any(c.__class__ is not Node and _says(c) for c in node.children):
        return True
    if node.tag not in PROSE or node.tag == "a":
        return False
    own = signs = links = False
    todo = list(node.children)
    while todo:
        c = todo.pop()
        if c.__class__ is not Node:
            signs = signs or bool(c.strip())
            own = own or _says(c)
        elif c.tag not in PROSE:
            return False
        elif c.tag != "a":
            todo += c.children
        else:
            links = True
    return own or signs and not links


_shingled = WordHashes()


def candidates(page: str) -> tuple[int, dict[int, bool]]:
    """What tells the page's text from others', and the keys of the subtrees that may belong to a template, each with whether it holds prose."""
    root = parse(page)
    _seal(root)
    found: dict[int, bool] = {}
    texts: list[str] = []
    todo: list = [(root, False)]
    while todo:
        c, prose = todo.pop()
        if c.__class__ is not Node:
            if prose:
                texts.append(c)
            continue
        if c.key is not None:
            found[c.key] = c.keeps
        prose = not c.dropped and (prose or c.prose)
        todo += [(x, prose) for x in reversed(c.children)]
    shingles = shingle_set(_shingled.of(" ".join(texts)))
    return _signed(int(shingles[0])) if len(shingles) else 0, found


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The text of a page without its dropped elements and the subtrees whose keys the template has."""
    if not page:
        return ""
    root = parse(page)
    blocks: list[list[str]] = [[]]
    mains = _seal(root)

    def walk(top: Node) -> None:
        todo: list = [(top, True)]
        while todo:
            c, opening = todo.pop()
            if c.__class__ is not Node:
                blocks[-1].append(c)
                continue
            if not opening:
                blocks.append([])
                continue
            if c is not top and (c.dropped or c.key in template):
                continue
            if c.tag == "br":
                blocks[-1].append(" ")
                continue
            if c.tag not in INLINE:
                blocks.append([])
                todo.append((c, False))
            todo += [(x, True) for x in reversed(c.children)]

    for node in mains:
        walk(node)
        blocks.append([])
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks)
    return "\n".join(line for line in lines if line)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without user, port and a leading www."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")


_COUNTED = "host string, mark long, prose boolean, page long, n long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html to host, mark, prose, what tells pages apart and pages of a batch; mark is null for the pages themselves, page 0 where all count."""
    for b in pieces(batches, "html"):
        count: Counter = Counter()
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own, found = candidates(page) if page else (0, {})
            count[host, None, False, own] += 1
            for mark, prose in found.items():
                count[host, mark, prose, own if prose else 0] += 1
        hosts, marks, prose, own = zip(*count, strict=True) if count else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(marks, pa.int64()), pa.array(prose, pa.bool_()), pa.array(own, pa.int64()), pa.array(count.values(), pa.int64())], names=["host", "mark", "prose", "page", "n"])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, share: float = SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """host, marks: keys of the subtrees that recur on a host's pages."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    once = rows.mapInArrow(_counted, _COUNTED).groupBy("host", "mark", "prose", "page").agg(F.sum("n").alias("n"))
    counted = once.groupBy("host", "mark", "prose").agg(F.sum("n").alias("pages"), F.count("*").alias("different"))
    counted = materialise(counted.where(F.col("mark").isNull() | (F.when(F.col("prose"), F.col("different")).otherwise(F.col("pages")) >= least_pages)))
    sizes = counted.where("mark is null").select("host", F.col("pages").alias("of"), F.col("different").alias("of_different"))
    recurs = F.when(F.col("prose"), F.col("different") >= F.col("of_different") * prose_share).otherwise(F.col("pages") >= F.col("of") * share)
    often = counted.where("mark is not null").join(sizes, "host").where(recurs)
    # in parts first, so that no task gathers a host's rows one by one
    parts = often.groupBy("host", F.pmod("mark", F.lit(32)).alias("part")).agg(F.collect_list("mark").alias("marks"))
    return parts.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("marks"))).alias("marks"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[bytes, frozenset[int]] = {}

    def set_of(marks: np.ndarray) -> frozenset[int]:
        key = marks.tobytes()
        if key not in sets:
            if len(sets) > 1000:
                sets.clear()
            sets[key] = frozenset(marks.tolist())
        return sets[key]

    for b in pieces(batches, "html"):
        marks = b.column(3)
        texts = [main_text(page, set_of(np.asarray(m.values.to_numpy(zero_copy_only=False))) if m.is_valid else frozenset()) for page, m in zip(b.column(2).to_pylist(), marks, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    found = materialise(templates(pages, url_col, html_col))
    few = found.count() <= BROADCAST_HOSTS
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(F.broadcast(found) if few else found.hint("merge"), "host", "left")
    kind = pages.schema[id_col].dataType.simpleString()
    return joined.select("page_id", "url", "html", "marks").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
