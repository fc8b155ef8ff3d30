"""Main text of web pages by site template removal."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmon.llm.common import map_arrow, set_columns, shield, with_columns
from plantmon.plans.staging import stage

# Element classes of the HTML language, fixed values.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_CLOSES_P = _BLOCKS - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
_SCOPE = frozenset("button caption html marquee object table td template th".split())
_SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup"])),
}
# What is never article text, by element and by word in class, id or role.
_SKIPPED = frozenset(
    "aside audio button canvas dialog footer form head iframe math menu nav noscript object script search select style "
    "svg template textarea title video".split()
)
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices outbrain pager "
    "pagination popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription taboola toolbar widget".split()
)
# A name that begins or ends so says what a layout, category or state is called, not what the element is.
_FIRST = frozenset("cat category has no not tag with without".split())
_LAST = frozenset("closed open".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
_CONTENT = frozenset(["article", "main"])
_TEXT = frozenset(
    "blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody td tfoot th thead tr ul".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)?", re.DOTALL
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_LOOSE_END = re.compile(r"[^>]*(?:>|\Z)")


def _marked(attributes: str) -> bool:
    """Whether class, id or role names the element as no article text."""
    for _, value in _NAMES.findall(attributes):
        for token in value.lower().split():
            words = _PART.findall(token)
            if not _WORDS.isdisjoint(words) and words[0] not in _FIRST and words[-1] not in _LAST:
                return True
    return False


def _bars(attributes: str) -> bool:
    """Whether the role alone says so, whatever the element holds."""
    return any(n.lower() == "role" and not _ROLES.isdisjoint(_PART.findall(v.lower())) for n, v in _NAMES.findall(attributes))


class _Open:
    """An open element: where its blocks begin and what its subtree is made of."""

    __slots__ = ("barred", "content", "parts", "skip", "start", "tag")

    def __init__(self, tag: str, skip: bool, barred: bool, start: int, parts: list[bytes]):
        self.tag, self.skip, self.barred, self.start, self.parts = tag, skip, barred, start, parts
        self.content = False


def walk(page: str, templates: frozenset[int] | set[int] = frozenset()) -> tuple[list[int], list[str]]:
    """Hashes of the page's removable subtrees, and its main text in blocks.

    One pass with a stack, in which missing end tags are implied as browsers do.
    A subtree's hash covers its tags, classes and texts. Removable are block
    elements that hold no article or main element, and inside those only
    containers, never a paragraph, heading, list, table or figure by itself. Blocks of
    subtrees in ``templates`` are taken back when their element ends.
    """
    out: list[str] = []
    buffer: list[str] = []
    hashes: list[int] = []
    regions: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
    stack = [_Open("", False, False, 0, [])]
    # Where on the stack the elements of a name, the blocks and the scopes are open.
    places: dict[str, list[int]] = {}
    open_blocks: list[int] = []
    open_scopes: list[int] = []
    inside = articles = mains = 0

    def innermost(tags: Iterable[str]) -> int:
        """Depth of the innermost open element of these names, 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            end()

    def flush() -> None:
        if buffer:
            block = " ".join("".join(buffer).split())
            buffer.clear()
            if block:
                out.append(block)

    def end() -> None:
        nonlocal inside
        node = stack.pop()
        places[node.tag].pop()
        if node.tag in _SCOPE or node.tag in _CONTENT:
            open_scopes.pop()
        if node.tag in _BLOCKS:
            open_blocks.pop()
            flush()
        digest = xxhash.xxh64_intdigest(b"\x00".join(node.parts))
        stack[-1].parts.append(digest.to_bytes(8, "little"))
        if node.content:
            stack[-1].content = True
        if node.tag in _CONTENT:
            stack[-1].content = True
            inside -= 1
            if not node.skip:
                regions[node.tag].append((node.start, len(out)))
        elif node.tag in _BLOCKS and not node.content and not (inside and node.tag in _TEXT):
            name = digest - (1 << 64) if digest >> 63 else digest
            hashes.append(name)
            if name in templates:
                del out[node.start :]

    def text(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            stack[-1].parts.append(" ".join(piece.split()).encode("utf-8", "surrogatepass"))
            if not stack[-1].skip:
                buffer.append(piece)

    at, length = 0, len(page)
    while at < length:
        token = _TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        tag = token.group(2)
        if tag is None:
            continue
        if token.group(4) is None:  # an unpaired quote: the tag ends at the next bracket
            at = _LOOSE_END.match(page, token.start()).end()
        elif not token.group(4):  # the page ends inside the tag
            break
        tag = tag.lower()
        if token.group(1):
            if tag in _BLOCKS:
                flush()
            depth = innermost([tag])
            # Formatting does not close blocks.
            if depth and (tag in _BLOCKS or not open_blocks or open_blocks[-1] < depth):
                close_to(depth)
            continue
        if tag in _CLOSES_P:
            depth = innermost(["p"])
            if depth and (not open_scopes or open_scopes[-1] < depth):
                close_to(depth)
        if tag in _SIBLINGS:
            ended, bounds = _SIBLINGS[tag]
            depth = innermost(ended)
            if depth and depth >= innermost(bounds):
                close_to(depth)
        if tag in _BLOCKS:
            flush()
        if tag == "br":
            if not stack[-1].skip:
                buffer.append(" ")
            continue
        if tag in _VOID:
            continue
        attributes = token.group(3)
        barred = (
            stack[-1].barred or tag in _SKIPPED or tag == "header" and not inside
            or bool(attributes) and tag not in ("html", "body") and _bars(attributes)
        )
        first = tag == "main" and not mains or tag == "article" and not articles
        if first and not barred and stack[-1].skip and not (
            articles or places.get("main") and len(out) > stack[places["main"][0]].start
        ):
            # What holds the page's content is named after something else.
            for node in stack:
                node.skip = False
        marked = bool(attributes) and tag not in ("html", "body") and not first and _marked(attributes)
        skip = stack[-1].skip or barred or marked
        names = sorted(v for n, v in _NAMES.findall(attributes) if n.lower() == "class") if attributes else []
        places.setdefault(tag, []).append(len(stack))
        if tag in _BLOCKS:
            open_blocks.append(len(stack))
        if tag in _SCOPE or tag in _CONTENT:
            open_scopes.append(len(stack))
        stack.append(_Open(tag, skip, barred, len(out), [" ".join([tag, *names]).encode("utf-8", "surrogatepass")]))
        if tag in _CONTENT:
            inside += 1
            articles += tag == "article" and not skip
            mains += tag == "main" and not skip
        if tag in _RAW:
            close = re.compile(rf"</{tag}[\s/>]|\Z", re.IGNORECASE).search(page, at)
            stack[-1].parts.append(page[at : close.start()].encode("utf-8", "surrogatepass"))
            at = close.start()
    while len(stack) > 1:
        end()
    flush()
    for kind in ("article", "main"):
        # Nested regions are part of the outer one, which ends after them.
        chosen: list[tuple[int, int]] = []
        for a, b in regions[kind]:
            while chosen and chosen[-1][0] >= a:
                chosen.pop()
            chosen.append((a, b))
        if any(b > a for a, b in chosen):
            return hashes, [block for a, b in chosen for block in out[a:b]]
    return hashes, out


def subtree_hashes(pages: DataFrame, html_col: str) -> DataFrame:
    """``pages`` without the html, with the distinct subtree hashes of each and a hash of its main text."""
    fields = [("_trees", T.ArrayType(T.LongType())), ("_main", T.LongType())]
    schema = T.StructType([f for f in with_columns(fields, pages).fields if f.name != html_col])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def trees(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.names.index(html_col)).to_pylist()
            walked = [walk(t) if t else ([], []) for t in texts]
            found = [sorted(set(hashes)) for hashes, _ in walked]
            mains = [xxhash.xxh64_intdigest("\n".join(m).encode("utf-8", "surrogatepass")) >> 1 for _, m in walked]
            return set_columns(
                batch.drop_columns([html_col]),
                {"_trees": pa.array(found, pa.list_(pa.int64())), "_main": pa.array(mains, pa.int64())},
            )

        return trees

    return map_arrow(pages, schema, make)


def host_of(url: str):
    """Lower-case host of a url column, without port."""
    return F.nullif(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def extract_main_text(
    pages: DataFrame, min_pages: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Main text of every page, without what its site repeats.

    Subtrees found on pages of one host with ``min_pages`` or more different main
    texts are that site's template and are deleted, as are elements that by name, class or role are no
    article text (menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, comments). Names of a page's first article and main element
    and of the elements around them do not count. Where a page has article elements the text is
    theirs, else that of its main element, else that of the rest. Paragraphs,
    lists, tables and figures of an article stay even where the site repeats them.

    Returns the input columns plus ``text`` (blocks joined by one newline, white
    space inside a block turned into one space; empty if there is none) and
    ``n_chars``. Null and empty pages have an empty text; pages without a host
    have no template. Repeated rows get equal results; copies of a page count
    once, whatever their ids and urls. An empty table gives an empty table.

    Only hashes move in the counting, combined before the shuffle, so a host with
    a third of all pages is a row per task and subtree; pages move once, keyed by
    page, to the few hashes found on them.
    """
    pages, back = shield(pages, [id_col, url_col, html_col])
    host = host_of(url_col)
    keyed = pages.withColumn("_page", F.xxhash64(id_col, url_col, html_col)).withColumn(
        "_host", F.when(host.isNotNull(), F.xxhash64(host))
    )
    found = subtree_hashes(
        keyed.where(F.col("_host").isNotNull() & F.col(html_col).isNotNull()).select("_page", "_host", html_col), html_col
    )
    # Written, so that a page is parsed once for its hashes.
    found = stage(found, "trees").select("_page", "_host", "_main", F.explode("_trees").alias("_tree"))
    # A theta sketch counts exactly up to its size and never shows less than that beyond it.
    exact = max(4, math.ceil(math.log2(min_pages + 1)))
    template = (
        found.groupBy("_host", "_tree")
        .agg(F.theta_sketch_estimate(F.theta_sketch_agg("_main", exact)).alias("n"))
        .where(F.col("n") >= min_pages).select("_host", "_tree")
    )
    # Written too: a hot menu can be split in the join, and a small table need not be joined by a shuffle.
    template = stage(template, "template")
    on_page = found.join(template, ["_host", "_tree"]).groupBy("_page").agg(F.collect_set("_tree").alias("_drop"))
    joined = keyed.join(on_page, "_page", "left").drop("_page", "_host")
    schema = with_columns([("text", T.StringType()), ("n_chars", T.LongType())], pages)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def read(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = batch.schema.names
            texts = batch.column(names.index(html_col)).to_pylist()
            drops = batch.column(names.index("_drop")).to_pylist()
            main = ["\n".join(walk(t, set(d or ()))[1]) if t else "" for t, d in zip(texts, drops, strict=True)]
            values = {"text": pa.array(main, pa.string()), "n_chars": pa.array([len(m) for m in main], pa.int64())}
            return set_columns(batch.drop_columns(["_drop"]), values)

        return read

    return back(map_arrow(joined, schema, make), ["text", "n_chars"])


def query(pages: DataFrame) -> DataFrame:
    return extract_main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
