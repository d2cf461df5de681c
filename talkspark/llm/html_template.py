"""Operator 2, HTML extraction by equivalence-class template deduction.

The tokens of a page are its elements, told apart by their path of names and classes from the root, and its
blocks of text, told apart by path and text. Over the pages of a host each token has an occurrence vector, the number of times it stands on each page; it is held as
a mergeable digest, so no host is gathered anywhere. Tokens with one vector form an equivalence class. The
class with the widest support and most tokens is the template's frame; valid frames stand on SUPPORT of the
host's pages. Classes nest by their paths, and what stands between frame tokens are slots. Blocks of the frame's
class are constant: they are template, not text. The main slot is the deepest frame token that holds all of the
host's other text outside boilerplate elements (menus, footers, forms, adverts, comments and so on, by name,
role or class). A page's text are the blocks of its main slot. Nothing is deduced for hosts with under LEAST
different pages, where classes say little. A page without its host's slot, or of a host without a frame, uses
its own article or main element, or else all its blocks outside boilerplate.

Text keeps every word of the chosen blocks: character references are decoded, white space within a block
becomes one space, blocks are joined by line feeds in page order.

Defined results: null or empty html gives the empty text; a null URL, or one without "://", belongs to the host
without a name; unclosed and wrongly nested elements are closed as browsers do for paragraphs, list items
and table parts, others at the end of what holds them; repeated rows are extracted one by one; an empty table
gives no rows; other columns pass through, and an input column named like an output is replaced.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.llm.bpe import slices, with_column
from talkspark.llm.common import stored
from talkspark.llm.url_filter import url_parts

SUPPORT, LEAST = 0.8, 5
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Element names, fixed by HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody"
    " td tfoot th thead tr ul".split()
)
#: An element of the left is closed by the start of one of the right.
CLOSED_BY = {
    "p": BLOCK - {"option", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "head", "body", "html"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"},
}
#: What isn't part of an article, by element name, and by a word of its class, id or role.
ASIDE = frozenset("head nav footer aside form menu button select svg object dialog".split()) | RAW
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo"
    " cookie cookies dialog disclaimer footer form masthead menu modal nav navbar navigation newsletter notice notices popup promo"
    " promotion related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)


#: Those that are boilerplate within an article too: there, a word such as related or search may be about the article.
INSIDE_WORDS = ASIDE_WORDS & frozenset(
    "ad ads advert adverts advertisement advertising comment comments cookie cookies consent newsletter popup promo promotion"
    " respond share sharing sidebar signup social sponsor sponsored subscribe".split()
)
#: Elements of a path that are written out.
DEPTH = 64


def block_token(path: str, text: str) -> str:
    """The token of a block; paths have no white space."""
    return f"{path}\n{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


class Open(NamedTuple):
    """An open element: whether it is boilerplate, whether an article holds it, the nearest block (its place in the stack, its path)."""

    name: str
    path: str
    aside: bool
    inside: bool
    block: int
    block_path: str


class Page:
    """The blocks of a page and how often each path opens.

    Paths deeper than DEPTH end in a digest of the rest, so that deep nesting costs no more than its elements.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str]] = []  # path of what holds the block, text
        self.opened: Counter[str] = Counter()
        self.stack: list[Open] = []
        self.names: Counter[str] = Counter()  # of the stack
        self.held: list[str] = []
        at = 0
        # each search starts where the last token or raw element ended: what looks like a tag within one is none
        while m := TOKEN.search(html, at):
            if m.start() > at:
                self.held.append(html[at : m.start()])
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if m["end"] or m["end2"]:
                self.close(name)
            else:
                rest = m["rest"] or m["rest2"] or ""
                self.open(name, rest)
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                    self.close(name)
        self.held.append(html[at:])
        self.flush()

    def flush(self) -> None:
        text = "".join(self.held)
        self.held = []
        if text and not (self.stack and self.stack[-1].aside):
            text = " ".join(references.unescape(text).split())
            if text:
                self.blocks.append((self.stack[-1].block_path if self.stack else "", text))

    def cut(self, k: int) -> None:
        """Take what is in the stack from place k on."""
        self.names.subtract(x.name for x in self.stack[k:])
        del self.stack[k:]

    def open(self, name: str, rest: str) -> None:
        if name in BLOCK or name in RAW:
            self.flush()
            while self.stack:
                k = self.stack[-1].block
                if k < 0 or name not in CLOSED_BY.get(self.stack[k].name, ()):
                    break
                self.cut(k)
        elif name == "br":
            self.held.append(" ")
        words, kind = [], ""
        if "=" in rest:
            for m in NAMED.finditer(rest):
                value = m[2] or m[3] or m[4] or ""
                words += re.findall("[a-z]+", value.lower())
                if m[1].lower() == "class" and value.split():
                    kind = "." + value.split()[0]
        above = self.stack[-1] if self.stack else Open("", "", False, False, -1, "")
        path = f"{above.path}>{name}{kind}"
        if len(self.stack) >= DEPTH:
            path = f"{self.stack[DEPTH - 1].path}>#{hashlib.blake2b(path.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"
        self.opened[path] += 1
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            return
        inside = above.inside or above.name in ("article", "main")
        aside = (
            above.aside
            or name in ASIDE
            or name == "header" and not inside
            or name not in ("html", "body", "article", "main") and any(w in (INSIDE_WORDS if inside else ASIDE_WORDS) for w in words)
        )
        if aside and not above.aside:
            self.flush()
        block = name in BLOCK
        self.stack.append(Open(name, path, aside, inside, len(self.stack) if block else above.block, path if block else above.block_path))
        self.names[name] += 1

    def close(self, name: str) -> None:
        if not self.names[name]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                if name in BLOCK or self.stack[-1].aside:
                    self.flush()
                self.cut(k)
                return
            if self.stack[k].name in ("td", "th", "table", "article", "body") and name not in BLOCK:
                return  # an inline end without its start

    def text(self, slot: str | None, constant: frozenset[str] = frozenset()) -> str:
        within = lambda p, s: p == s or p.startswith(s + ">")
        if slot and slot in self.opened:  # the slot is there, if empty
            return "\n".join(t for p, t in self.blocks if within(p, slot) and block_token(p, t) not in constant)
        chosen: list[str] = []
        if not chosen:
            own = [t for p, t in self.blocks if re.search(r">(article|main)\b", p)]
            chosen = own or [t for _, t in self.blocks]
        return "\n".join(chosen)


def page_tokens(pages: DataFrame, html: str) -> DataFrame:
    """(host, page, token, n, chars) from (host, page, html): chars of the text that a token holds.

    Tokens are element paths, blocks (block_token), and the empty string for the page.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(html)):
                part = batch.slice(start, n)
                out: dict[str, list] = {"host": [], "page": [], "token": [], "n": [], "chars": []}
                for host, key, source in zip(*(part.column(c).to_pylist() for c in ("host", "page", html)), strict=True):
                    page = Page(source or "")
                    chars: Counter[str] = Counter({"": 0})
                    times = Counter(page.opened)
                    times[""] = 1
                    for path, text in page.blocks:
                        token = block_token(path, text)
                        times[token] += 1
                        chars[token] += len(text)
                        chars[""] += len(text)
                        while path:
                            chars[path] += len(text)
                            path = path.rpartition(">")[0]
                    out["host"] += [host] * len(times)
                    out["page"] += [key] * len(times)
                    out["token"] += list(times)
                    out["n"] += times.values()
                    out["chars"] += [chars[t] for t in times]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[c], k) for c, k in (("host", pa.string()), ("page", pa.int64()), ("token", pa.string()), ("n", pa.int64()), ("chars", pa.int64()))],
                    list(out),
                )

    return pages.mapInArrow(run, "host string, page bigint, token string, n bigint, chars bigint")


def classes(tokens: DataFrame) -> DataFrame:
    """(host, token, support, vector, chars): tokens of a host with the digest of their occurrence vector.

    The digest is a sum of hashes, so repeated rows count but don't cancel each other.
    """
    return tokens.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector"), F.sum("chars").alias("chars")
    )


def main_slots(found: DataFrame, different: DataFrame) -> DataFrame:
    """(host, slot, constant): the main slot and the constant blocks of each host that has a valid frame.

    different: (host, n_pages), the different pages of a host.
    """
    pages = found.where("token = ''").select("host", F.col("support").alias("pages"), F.col("chars").alias("all_chars"))
    pages = pages.join(different.where(F.col("n_pages") >= LEAST), "host", "left_semi")
    block = F.col("token").contains("\n")
    kinds = found.where((F.col("token") != "") & ~block).groupBy("host", "support", "vector").agg(F.count("*").alias("size"))
    frame = kinds.groupBy("host").agg(F.max(F.struct("support", "size", "vector")).alias("frame"))
    frame = frame.join(pages, "host").where(F.col("frame.support") >= SUPPORT * F.col("pages"))
    inside = found.where("token <> ''").join(frame, "host").where((F.col("support") == F.col("frame.support")) & (F.col("vector") == F.col("frame.vector")))
    inside = inside.select("host", "token", "chars", "all_chars", block.alias("block"))
    constant = inside.where("block").drop("block")
    # constant text by each element that holds it, and all of it by the empty token
    steps = F.split(F.substring_index("token", "\n", 1), ">")
    held = constant.select("host", "chars", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), ">"))).alias("token"))
    held = held.groupBy("host", "token").agg(F.sum("chars").alias("fixed"))
    # an element beyond DEPTH doesn't tell what it holds
    slots = inside.where(~F.col("block") & ~F.col("token").contains(">#")).join(held, ["host", "token"], "left").join(held.where("token = ''").select("host", F.col("fixed").alias("all_fixed")), "host", "left")
    varied = F.col("all_chars") - F.coalesce("all_fixed", F.lit(0))
    slots = slots.where((F.col("chars") - F.coalesce("fixed", F.lit(0)) == varied) & (varied > 0))
    depth = F.length("token") - F.length(F.replace("token", F.lit(">"), F.lit("")))
    best = slots.groupBy("host").agg(F.max(F.struct(depth.alias("depth"), F.col("token").alias("token"))).alias("best"))
    lists = constant.groupBy("host").agg(F.collect_set("token").alias("constant"))
    return best.join(lists, "host", "left").select("host", F.col("best.token").alias("slot"), "constant")


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages without the html, with text."""
    host = url_parts(F.col(url))[0]
    keyed = pages.select(host.alias("host"), F.xxhash64(url, html).alias("page"), F.col(html).alias("html"))
    found = classes(page_tokens(keyed, "html"))
    # a block on few pages is in no frame
    found = stored(found.where(~F.col("token").contains("\n") | (F.col("support") >= LEAST)), "classes")
    different = keyed.groupBy("host").agg(F.count_distinct("page").alias("n_pages"))
    slots = stored(main_slots(found, different), "slots")
    fields = [f for f in pages.schema.fields if f.name not in (html, "text")]
    rest = pages.drop("text").withColumns({"__host": host})
    rest = rest.join(slots.select(F.col("host").alias("__host"), F.col("slot").alias("__slot"), F.col("constant").alias("__constant")), "__host", "left")
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(html)):
                part = batch.slice(start, n)
                given = zip(*(part.column(c).to_pylist() for c in (html, "__slot", "__constant")), strict=True)
                texts = [Page(h).text(s, frozenset(c or ())) if h else "" for h, s, c in given]
                yield with_column(part.select(names), "text", pa.array(texts, pa.string()))

    return rest.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
