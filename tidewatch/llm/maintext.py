"""Main text of web pages: site templates found by counting element subtrees per host, and roles of elements.

Every page is parsed once into blocks of text and element subtrees, each with a hash over its tags and text. Spark counts in
how many different pages of a host a subtree occurs; subtrees that recur on a share of the host's pages are template and are
deleted, prose inside an article from a larger share on (a quoted or copied paragraph is still the article's). Roles choose among
what is left: what markup says outright (navigation, forms, scripts, comments of readers and the like) goes, so that hosts with
few pages are cleaned too, and main or article are taken alone if they hold most of the rest.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot blockquote pre ul ol dl table figure figcaption caption".split())
GONE = frozenset("head script style title noscript iframe template nav footer aside form button select option input textarea label fieldset dialog menu svg canvas object audio video map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words in class or id that mark what isn't article, and roles.
NOT_ARTICLE = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs sidebar aside ad ads adv advert adverts advertisement advertising
    sponsored cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing
    pagination pager comment comments disqus footer masthead topbar toolbar outbrain taboola""".split())
# Words that a story's own container may carry too: they count only for an element that is short, or links for a good part.
PERHAPS = frozenset("""side banner promo promotion sponsor notice notices notification alert social related recommended recommendations discussion respond reply
    replies popup modal overlay widget widgets skip copyright legal""".split())
# Parts of a compound name that leave its meaning as it is ("site-nav", "user-comments"); a compound with any other part is a name of its own ("has-sidebar").
BEFORE = frozenset("site page main primary secondary top bottom global user users reader readers post posts".split())
AFTER = frozenset("area bar block box buttons container content form items links list post posts section slot thread trail widget wrap wrapper".split())
#: A doubtful element stays from so many characters on, unless this part of them are links.
STORY_CHARS, LINK_SHARE = 140, 0.3
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())


class Block(NamedTuple):
    text: str
    article: bool
    main: bool
    gone: bool


class Subtree(NamedTuple):
    first: int
    end: int
    digest: bytes
    prose: bool
    article: bool


def _names_other(name: str) -> int:
    """How sure a class or id names what isn't article: 2 by a listed word, alone or in a compound of known parts, 1 by a doubtful one, else 0."""
    if name in NOT_ARTICLE or name in PERHAPS:
        return 2 if name in NOT_ARTICLE else 1
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if any(x not in NOT_ARTICLE and x not in PERHAPS and x not in BEFORE and x not in AFTER for x in parts):
        return 0
    return 2 if any(x in NOT_ARTICLE for x in parts) else int(any(x in PERHAPS and x not in AFTER for x in parts))


def _unwanted(tag: str, attributes: str, in_article: bool) -> int:
    """2: the element isn't article; 1: only if it looks like it; 0: nothing says so."""
    if tag in GONE or (tag == "header" and not in_article):
        return 2
    if not attributes or tag in ("html", "body", "main") or (len(tag) == 2 and tag[0] == "h"):
        return 0
    sure = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES) or (name == "style" and HIDDEN_STYLE.search(value)):
            return 2
        if name in ("class", "id"):
            sure = max([sure, *map(_names_other, value.split())])
    return sure


def parse(page: str) -> tuple[list[Block], list[Subtree]]:
    """Blocks of text in page order, and the subtrees of all elements but inline ones, the root and the containers of the article.

    An unwanted element that holds an article or main (outside any article) is unwanted only if the page has another one inside
    of fewer unwanted elements.
    """
    blocks: list[Block] = []
    subtrees: list[Subtree] = []
    text: list[str] = []
    # Open elements: tag, first block, parts of the digest, numbers of the unwanted elements around, in an article, in main.
    stack: list[tuple] = [("", 0, [], (), False, False)]
    around: list[tuple] = []
    linked: list[int] = []
    # Doubtful elements: their number among the unwanted, first block and end.
    doubtful: dict[int, list[int]] = {}
    unwanted, holders, in_links = 0, [], 0

    def flush() -> None:
        nonlocal in_links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                _, _, parts, gone, article, main = stack[-1]
                blocks.append(Block(joined, article, main, bool(gone)))
                around.append(gone)
                linked.append(min(in_links, len(joined)))
                parts.append(joined.encode("utf-8", "surrogatepass"))
            text.clear()
            in_links = 0

    def close() -> None:
        tag, first, parts, gone, article, _ = stack[-1]
        if tag not in INLINE:
            flush()
        stack.pop()
        if gone and gone[-1] in doubtful and gone != stack[-1][3]:
            doubtful[gone[-1]][1] = len(blocks)
        if parts:
            digest = hashlib.blake2b(tag.encode() + b"\0" + b"\1".join(parts), digest_size=8).digest()
            stack[-1][2].append(digest)
            if tag not in INLINE and tag not in ("html", "body", "article", "main"):
                subtrees.append(Subtree(first, len(blocks), digest, tag in PROSE, article))

    def close_to(tags: tuple, scopes: tuple = ()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                while len(stack) > depth:
                    close()
                return
            if stack[depth][0] in scopes:
                return

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            text.append(references.unescape(piece) if "&" in piece else piece)
            if any(open_[0] == "a" for open_ in stack):
                in_links += len(text[-1].strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                # An inline end tag never reaches beyond its block.
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        while len(stack) > depth:
                            close()
                        break
                    if stack[depth][0] not in INLINE:
                        break
            else:
                flush()
                close_to((tag,))
            continue
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        if tag in CLOSES_P:
            flush()
            close_to(("p",), ("article", "section", "div", "td", "th", "li", "body", "button"))
        if tag in SIBLINGS:
            flush()
            close_to(SIBLINGS[tag], SCOPES[tag])
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
        _, _, _, gone, article, main = stack[-1]
        sure = _unwanted(tag, m[3], article)
        if sure:
            unwanted += 1
            gone = (*gone, unwanted)
            if sure == 1:
                doubtful[unwanted] = [len(blocks), len(blocks)]
        if tag in ("article", "main") and not article:
            holders.append(gone)
        stack.append((tag, len(blocks), [], gone, article or tag == "article", main or tag == "main"))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            body = page[at:end.start()] if end else page[at:]
            if body.strip():
                stack[-1][2].append(body.encode("utf-8", "surrogatepass"))
            at = end.start() if end else size
    while len(stack) > 1:
        close()
    flush()
    spared = set()
    for number, (first, end) in doubtful.items():
        chars = sum(len(b.text) for b in blocks[first:end])
        if chars >= STORY_CHARS and sum(linked[first:end]) < LINK_SHARE * chars:
            spared.add(number)
    left = [[x for x in g if x not in spared] for g in holders]
    least = min(map(len, left), default=0)
    if least:
        spared |= {x for g in left if len(g) == least for x in g}
    if spared:
        blocks = [b._replace(gone=not spared.issuperset(g)) for b, g in zip(blocks, around, strict=True)]
    return blocks, subtrees


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def site_key(host: str, digest: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(digest + host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def subtree_key(host: str, s: Subtree) -> int:
    """Prose inside an article is counted by itself."""
    return site_key(host, s.digest + b"\1" if s.article and s.prose else s.digest)


def main_text(page: str | None, host: str, template) -> str:
    """Blocks outside subtrees whose key is in ``template`` and outside unwanted elements; of these the ones in main, and the ones in
    an article, if they hold at least two thirds of the characters, or half of them and no block outside is as long as a story's."""
    blocks, subtrees = parse(page or "")
    gone = [b.gone for b in blocks]
    for s in subtrees:
        if not all(gone[s.first:s.end]) and subtree_key(host, s) in template:
            gone[s.first:s.end] = [True] * (s.end - s.first)
    kept = [b for b, out in zip(blocks, gone, strict=True) if not out]
    for role in ("main", "article"):
        inside = [b for b in kept if getattr(b, role)]
        held, whole = sum(len(b.text) for b in inside), sum(len(b.text) for b in kept)
        story_outside = any(len(b.text) >= STORY_CHARS for b in kept if not getattr(b, role))
        if inside and (3 * held >= 2 * whole or (2 * held >= whole and not story_outside)):
            kept = inside
    return "\n\n".join(b.text for b in kept)


FOUND = pa.schema([("host", pa.int64()), ("key", pa.int64()), ("inner", pa.bool_()), ("page", pa.int64())])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, inner, page): a row for each different subtree of a page, and one whose key is the host's; inner tells prose inside
    an article; page is a hash of what the page says outside unwanted elements."""
    for batch in batches:
        hosts: list[int] = []
        keys: list[int] = []
        inner: list[bool] = []
        pages: list[int] = []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            blocks, subtrees = parse(page or "")
            said = "\n".join(b.text for b in blocks if not b.gone)
            digest = hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            host = host_of(url)
            own = {subtree_key(host, s): s.article and s.prose for s in subtrees}
            hosts += [site_key(host, b"")] * (len(own) + 1)
            keys += [*own, site_key(host, b"")]
            inner += [*own.values(), False]
            pages += [int.from_bytes(digest, "little", signed=True)] * (len(own) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), pa.array(inner, pa.bool_()), pa.array(pages, pa.int64())], schema=FOUND)


def template_keys(source: DataFrame, least_pages: int, share: float, inner_share: float) -> DataFrame:
    """Keys of subtrees that reach the cutoff of their host."""
    found = source.mapInArrow(_subtrees, "host long, key long, inner boolean, page long").distinct()
    # On a host of four pages, what all four have is template; three pages tell too little.
    counted = written(found.groupBy("host", "key", "inner").agg(F.count("*").alias("n")).filter(F.col("n") >= min(4, least_pages)), "subtrees")
    hosts = counted.filter("key = host").select("host", F.col("n").alias("pages"))
    part = F.when(F.col("inner"), F.lit(inner_share)).otherwise(F.lit(share))
    cutoff = F.greatest(F.ceil(F.col("pages") * part), F.least(F.lit(least_pages), F.greatest(F.lit(4), F.col("pages"))))
    return counted.filter("key != host").join(hosts, "host").filter(F.col("n") >= cutoff).select("key")


OUT = "page_id long, url string, text string, n_chars long"


def _extracted(batches: Iterator[pa.RecordBatch], template_of) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in batches:
        texts = [main_text(page, host_of(url), template_of(k, batch)) for k, (url, page) in
                 enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def extract_main_text(pages: DataFrame, least_pages: int = 5, broadcast_keys: int = 250_000, share: float = 0.1, inner_share: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of (page_id, url, html).

    A subtree is template if it occurs in ``share`` of the pages of its host that differ in what they say (``inner_share`` for prose
    inside an article), in ``least_pages`` of them at least, on a host of four pages in all of them. Null or empty html gives an
    empty text; a null url is a host of its own; repeated rows are pages like others. Other columns are not read. Template keys
    (8 bytes each) are broadcast if they are counted to be ``broadcast_keys`` at most; otherwise they are joined to the pages.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    template = written(template_keys(source, least_pages, share, inner_share), "template")
    if template.count() <= broadcast_keys:
        keys = source.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in template.collect()))
        return source.mapInArrow(lambda batches: _extracted(batches, lambda k, batch: keys.value), OUT)

    whole = source.withColumn("uid", F.xxhash64("page_id", "url", "html"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.int64()), ("key", pa.int64())])
        for batch in batches:
            pairs = [(uid, subtree_key(host_of(url), s)) for uid, url, page in
                     zip(batch.column("uid").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)
                     for s in parse(page or "")[1]]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=schema)

    own = whole.mapInArrow(keyed, "uid long, key long").distinct().join(template, "key").groupBy("uid").agg(F.collect_set("key").alias("keys"))
    return whole.join(own, "uid", "left").mapInArrow(
        lambda batches: _extracted(batches, lambda k, batch: frozenset(batch.column("keys")[k].as_py() or ())), OUT)
