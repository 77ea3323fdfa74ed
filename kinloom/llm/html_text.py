"""HTML extraction by consensus host paths.

Each page's containers are scored and the best one's generalised tag-class path is the page's vote. Spark counts votes by host, joins them
to the paths of each form (the set of paths that pages of a host have), and every page is read again with the path of most votes that it has.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from kinloom.llm.common import ascii_lower, map_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|([^<]++)|<[a-zA-Z][^>]*\Z|(<)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAMES = re.compile(r"[a-z]+")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
BLOCKS = frozenset("html head body main article section div td th tr table thead tbody tfoot caption ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 blockquote pre nav header footer aside form figure figcaption address details summary fieldset legend center hgroup menu dialog template svg math object select button label option audio video canvas map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(["br", "hr"])
CONTAINERS = frozenset("html body main article section div td table blockquote center".split())
#: Never main text, nor anything inside.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg math object select button option textarea menu dialog audio video canvas map xmp noembed noframes".split())
#: Words of class, id and role attributes that mark what is not the article, and words that may stand beside them in a name and say nothing else:
#: `related-posts` and `sidebar-left` are marked, `related-work` and `form-factor` are names of their own.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars aside rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs
footer masthead topbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended
comment comments commentlist disqus reply replies respond form search pagination pager toolbar complementary contentinfo skip copyright""".split())
NEUTRAL = frozenset("""area article articles bar block body bottom box button buttons card col column container content desktop element entry fixed global group head heading holder icon icons inner item items left link links
list local main mobile module outer page panel post posts primary region right row secondary section site slot space sticky stories story text title top unit view wrap wrapper""".split())
PREFERRED, LIKELY = frozenset(["article", "main"]), frozenset("article content entry post story main body text".split())
CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPES = frozenset("html body table div article section main ul ol dl blockquote td nav aside form footer header".split())
#: Nesting from which on containers count as part of the one above.
DEPTH = 64
#: Rows of votes or forms up to which they are broadcast (some hundred bytes each); beyond, both sides are shuffled, where AQE splits hot hosts.
BROADCAST_ROWS = 50_000


def marked(value: str) -> bool:
    """Whether a name in an attribute's value is made of marks and neutral words."""
    for name in value.split():
        found = set(NAMES.findall(name))
        if found & MARKS and found <= MARKS | NEUTRAL:
            return True
    return False


class Page:
    """A page's containers as (path, parent, prior, chars, link chars) and its blocks of text as (container, text), in page order."""

    def __init__(self, source: str) -> None:
        self.path, self.parent, self.prior, self.chars, self.links, self.blocks = [""], [-1], [0.1], [0], [0], []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # open block tags and the containers they were opened in
        node, dropped, in_link, piece = 0, 0, False, []  # dropped: length of the stack at which dropping began, plus one
        open_tags: Counter = Counter()  # how often each tag stands on the stack, so that no tag is searched there in vain

        def flush() -> None:
            nonlocal piece
            if piece:
                text = "".join(piece)
                text = " ".join((entities.unescape(text) if "&" in text else text).split())
                if text:
                    self.blocks.append((node, text))
                    self.chars[node] += len(text)
                piece = []

        def pop(to: int) -> None:
            nonlocal node, dropped
            while len(stack) > to:
                tag, node = stack.pop()
                open_tags[tag] -= 1
                if dropped and len(stack) < dropped:
                    dropped = 0

        at, end = 0, len(source)
        while at < end:
            m = TOKEN.match(source, at)
            at = m.end()
            text = m[7] or m[8]
            if text:
                if not dropped:
                    piece.append(text)
                    if in_link:
                        self.links[node] += len(text)
                continue
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing = tag.lower(), m[1] or m[4]
            if tag == "a":
                in_link = not closing
            if not closing and tag in RAW_END:
                at = RAW_END[tag].search(source, at).end()
                continue
            if tag in VOID:
                if tag in BREAKS:
                    flush()
                continue
            if tag not in BLOCKS:
                continue
            flush()
            if closing:
                for k in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if stack[k][0] in SCOPES and tag in CLOSES or tag == "p" and stack[k][0] in SCOPES:
                        break
                continue
            if tag == "body":
                pop(next((k for k, s in enumerate(stack) if s[0] == "head"), len(stack)))
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            for k in range(len(stack) - 1, -1, -1) if tag in CLOSES and any(open_tags[t] for t in CLOSES[tag]) else ():
                if stack[k][0] in CLOSES[tag]:
                    pop(k)
                    break
                if stack[k][0] in SCOPES and stack[k][0] not in ("td",):
                    break
            marks: set[str] = set()
            hidden, classes, apart = False, "", False
            for a in ATTRIBUTE.finditer(m[3] or m[6] or ""):
                name, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
                hidden |= name == "hidden" or name == "aria-hidden" and value == "true"
                marks.update(NAMES.findall(value))
                apart = apart or marked(value)
                if name == "class":
                    classes = ".".join(sorted(set(NAMES.findall(value))))
            inside = open_tags["article"] > 0
            stack.append((tag, node))
            open_tags[tag] += 1
            if not dropped and (tag in DROPPED or hidden or tag not in ("html", "body", "article", "main") and apart or tag == "header" and not inside):
                dropped = len(stack)
            if tag in CONTAINERS and not dropped and self.path[node].count(">") < DEPTH:
                self.path.append(f"{self.path[node]}>{tag}" + (f".{classes}" if classes else ""))
                self.parent.append(node)
                self.prior.append(1.5 if tag in PREFERRED or "main" in marks else 0.7 if tag in ("html", "body") else 1.2 if marks & LIKELY else 1.0)
                self.chars.append(0)
                self.links.append(0)
                node = len(self.path) - 1
        flush()

    def best(self) -> int:
        """The container with the most text, less what links hold, weighed by what its tag and classes say; the deepest of equals."""
        chars, links = self.chars[:], self.links[:]
        for i in range(len(chars) - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            links[self.parent[i]] += links[i]
        return max(range(len(chars)), key=lambda i: (self.prior[i] * max(0, chars[i] - links[i]), i))

    def paths(self) -> tuple[list[str], bytes]:
        """The page's different paths in order, and their digest."""
        found = sorted(set(self.path))
        return found, hashlib.blake2b("\0".join(found).encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def pieces(self) -> list[tuple[list[int], str]]:
        """The text in page order, cut where the container changes, each with the places among paths() of the paths it is under."""
        place = {p: i for i, p in enumerate(self.paths()[0])}
        over = [{place[self.path[0]]}]
        for i in range(1, len(self.path)):
            over.append(over[self.parent[i]] | {place[self.path[i]]})
        return [(sorted(over[i]), " ".join(t for _, t in group)) for i, group in groupby(self.blocks, lambda x: x[0])]


def host_forms(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, form, paths, vote, votes): how many of a host's pages with the same paths vote for each path; pages without text do not vote."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            paths = {}
            for host, source in zip(batch["host"].to_pylist(), batch["html"], strict=True):
                page = Page(source.as_py())
                if page.blocks:
                    found, form = page.paths()
                    paths[form] = found
                    counts[host, form, page.path[page.best()]] += 1
            hosts, forms, votes = zip(*counts, strict=True) if counts else ((), (), ())
            columns = [pa.array(hosts, pa.string()), pa.array(forms, pa.binary()), pa.array([paths[f] for f in forms], pa.list_(pa.string())), pa.array(votes, pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "form", "paths", "vote", "votes"])

        return step

    source = pages.select(_host(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    counted = map_batches(source, make, "host string, form binary, paths array<string>, vote string, votes long")
    return counted.groupBy("host", "form", "paths", "vote").agg(F.sum("votes").alias("votes"))


def favourites(forms: DataFrame) -> DataFrame:
    """(host, form, place): of the paths of a form the one that most pages of its host vote for, ties by path, as its place in paths."""
    votes = forms.groupBy("host", F.col("vote").alias("path")).agg(F.sum("votes").alias("votes"))
    own = forms.dropDuplicates(["host", "form"]).select("host", "form", F.posexplode("paths").alias("place", "path"))
    return own.join(_small(votes), ["host", "path"]).groupBy("host", "form").agg(F.min_by("place", F.struct(-F.col("votes"), "path")).alias("place"))


def _small(rows: DataFrame) -> DataFrame:
    """Rows to be joined, broadcast if they are few."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _host(url_col: str):
    return ascii_lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^/?#]*://([^/?#]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (empty if none) and n_chars.

    Null and empty html have no text; pages with null or odd URLs vote together as the host without a name; repeated rows come back
    as often as they came; other columns are dropped. Truncated markup is read as far as it goes.
    """
    best = _small(favourites(host_forms(pages, url_col, html_col).persist(StorageLevel.MEMORY_AND_DISK)))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), _host(url_col).alias("host"))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            forms, pieces = [], []
            for source in batch["html"]:
                page = Page(source.as_py())
                forms.append(page.paths()[1])
                pieces.append([{"over": over, "text": text} for over, text in page.pieces()])
            kind = pa.list_(pa.struct([("over", pa.list_(pa.int32())), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], batch["host"], pa.array(forms, pa.binary()), pa.array(pieces, kind)], ["id", "url", "host", "form", "pieces"])

        return step

    kind = rows.schema["id"].dataType.simpleString()
    cut = map_batches(rows, make, f"id {kind}, url string, host string, form binary, pieces array<struct<over:array<int>,text:string>>")
    chosen = F.transform(F.filter("pieces", lambda x: F.array_contains(x["over"], F.col("place"))), lambda x: x["text"])
    texts = cut.join(best, ["host", "form"], "left").select("id", "url", F.coalesce(F.array_join(chosen, " "), F.lit("")).alias("text"))
    return texts.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
