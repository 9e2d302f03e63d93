"""Main text of pages by template deduction over the pages of a host.

Tokens of a page are its tags in their place (path of enclosing blocks) and its text blocks in theirs. A token's occurrence vector has its
count on each page of the host; tokens with equal vectors form an equivalence class. Vectors are compared by order-free sums of hashes of
(page, count), so classes come from one map-side combined aggregation and a host of any size needs no task of its own.
Valid classes have at least two tokens and support on enough pages; pages without tokens (null or empty html) don't count. As one damaged
page parts a class, a tag of the frame or a text on nine tenths of the pages is valid alone. Tags that stand
once a page, on at least a quarter of the pages, are the frame: a class is ordered within itself, so layouts of one host have their own
classes, and a class on fewer pages stands in the slots of those on more. The other valid classes, rare or repeated, part these slots once
more. Text tokens of valid classes on at least half of the pages are the template's own text, inside an article too. A class that holds half
or more of its pages' article text is an article that copies repeat and stays; so do classes on less than nine tenths of the pages if
together they hold that much.
What is left in the slots is data; slots in places that are not the article by their markup (menus, headers, footers, asides, forms, notices,
adverts, comments) are closed. Pages with and without an article or main element are ranked apart: of the former the slots inside it are the
main ones, of the latter those that hold most text a page and few links. Slots and parts that are mostly links (linked headings count as
text) are left out. A page with nothing in its host's main slots keeps its article, or else all its open data.

Defined cases: null or empty html gives the empty string; unclosed and misnested tags close as browsers close them; a host with few pages,
or a null or odd URL, goes by markup alone; rows may repeat; blocks with equal text on a page all stay.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import pieces, saved

# Elements by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe".split())
CLOSED = frozenset("nav header footer aside form script style noscript template head title menu button select option dialog iframe svg object".split())
P_ENDERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_ENDING = {"li": ("li", ("ul", "ol")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "option": ("option", ("select",))}
CLOSED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|sidebar|side|menu|nav\w*|breadcrumbs?|footer|masthead|comments?|replies|respond|share|sharing|social|related|recommend\w*|widget|newsletter|subscribe|login|search|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
MIN_SUPPORT = 3
FRAME_SHARE, CLASS_SHARE = 4, 20  # a class is in the frame from a quarter of the pages, valid from a twentieth
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEMPLATE_ROWS = 50_000

# A quote only opens a value right behind the equals sign; elsewhere it is a character, and > ends the tag.
_token = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+(?:>|\Z)|[^<]+|<""",
    re.S,
)
_name = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_attr = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def h64(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) >> 1


@functools.lru_cache(100_000)
def _tag_token(path: int, shown: str) -> int:
    return h64("tag", path, shown)


@functools.lru_cache(100_000)
def _below(path: int, shown: str) -> int:
    """The path of a block inside another: a running hash, so a page's memory doesn't follow the depth of its nesting."""
    return h64("path", path, shown)


NOWHERE = ("", "", False, False, 0)


class Page:
    """tags: (token, place in page); blocks: (token, place, text, link characters, closed, in article), in page order."""

    def __init__(self, source: str):
        self.tags: list[tuple[int, int]] = []
        self.blocks: list[tuple[int, int, str, int, bool, bool]] = []
        self.stack: list[tuple[str, str, bool, bool, int]] = []  # name, shown name, closed, article, path of blocks
        self.opened: dict[str, int] = defaultdict(int)
        self.text: list[str] = []
        self.links, self.in_link, self.place = 0, 0, 0
        raw_end = None
        for m in _token.finditer(source):
            t = m[0]
            if raw_end is not None:
                if t.startswith("</") and (n := _name.match(t)) and n[1].lower() == raw_end:
                    raw_end = None
                    self.close(n[1].lower())
                continue
            if t[0] != "<" or len(t) == 1:
                self.text.append(t)
                self.links += self.in_link * len(t)
                continue
            n = _name.match(t)
            if not n:
                continue
            name = n[1].lower()
            if t[1] == "/":
                self.close(name)
            else:
                self.open(name, t)
                if name in RAW and not t.endswith("/>"):
                    raw_end = name
        self.flush()

    def flush(self) -> None:
        if self.text:
            # references are decoded in the whole block, then white space folds
            text = "".join(self.text)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                top = self.stack[-1] if self.stack else NOWHERE
                # only open text can be the template's own, so only it needs a token
                token = 0 if top[2] else h64("text", top[4], text)
                self.blocks.append((token, self.place, text, 0 if top[0] in HEADINGS else self.links, top[2], top[3]))
        self.text, self.links = [], 0

    def open(self, name: str, tag: str) -> None:
        self.place += 1
        if name not in INLINE:
            self.flush()
        if name in P_ENDERS:
            self.end("p", ("table", "td", "th", "div", "article", "section", "main", "li", "body"))
        if name in SELF_ENDING:
            self.end(*SELF_ENDING[name])
        labels = " ".join(a.strip("\"'") for a in _attr.findall(tag)) if "=" in tag else ""
        above = self.stack[-1] if self.stack else NOWHERE
        shown = name + (f".{labels}" if labels else "")
        if name not in INLINE:
            self.tags.append((_tag_token(above[4], shown), self.place))
        if name in VOID or tag.endswith("/>"):
            return
        closed = above[2] or name in CLOSED or bool(labels and name not in ("html", "body", "article", "main") and CLOSED_NAMES.search(labels))
        self.stack.append((name, shown, closed, above[3] or name in ("article", "main"), above[4] if name in INLINE else _below(above[4], shown)))
        self.opened[name] += 1
        self.in_link += name == "a"

    def end(self, name: str, stops: tuple[str, ...]) -> None:
        """Closes the nearest open `name`, unless one of `stops` was opened inside it."""
        if not self.opened[name]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                self.pop(i)
                return
            if self.stack[i][0] in stops:
                return

    def close(self, name: str) -> None:
        self.place += 1
        if name not in INLINE:
            self.flush()
        if not self.opened[name]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                self.pop(i)
                return
            if name in INLINE and self.stack[i][0] not in INLINE:
                return  # a stray inline end closes no block

    def pop(self, i: int) -> None:
        if any(s[0] not in INLINE for s in self.stack[i:]):
            self.flush()
        for s in self.stack[i:]:
            self.in_link -= s[0] == "a"
            self.opened[s[0]] -= 1
        del self.stack[i:]


def host_of(url):
    """Lower-cased host without www. and m.; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^(?:www|m)\.", "")


def token_stats(rows: DataFrame) -> DataFrame:
    """(host, token, is_text, support, once, place, vec, chars, art): sums over the host's pages; combined by batch, then by key.
    is_text is 2 inside an article; chars is the text's length, art the article text of the token's pages. Token 0 counts the pages that have tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html", 8 << 20):
            acc: dict[tuple[str, int], list] = defaultdict(lambda: [0, 0, 0, 0.0, 0, 0, 0])
            for host, page, source in zip(b.column("host").to_pylist(), b.column("page").to_pylist(), b.column("html").to_pylist(), strict=True):
                p = Page(source or "")
                n = max(p.place, 1)
                count: dict[int, int] = defaultdict(int)
                where: dict[int, tuple[int, int, int]] = {}
                whole = sum(len(x[2]) for x in p.blocks if x[5] and not x[4])
                for tok, place in p.tags:
                    count[tok] += 1
                    where.setdefault(tok, (0, place, 0))
                for tok, place, text, _, _, article in p.blocks:
                    if tok:
                        count[tok] += 1
                        where.setdefault(tok, (1 + article, place, len(text)))
                for tok, c in count.items():
                    a = acc[host, tok]
                    a[0] = where[tok][0]
                    a[1] += 1
                    a[2] += c == 1
                    a[3] += where[tok][1] / n
                    a[4] += h64(page, c) >> 24
                    a[5] = where[tok][2]
                    a[6] += whole
                if count:
                    acc[host, 0][1] += 1
            keys = list(acc)
            cols = [[k[0] for k in keys], [k[1] for k in keys], *[[acc[k][i] for k in keys] for i in range(7)]]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["host", "token", "is_text", "support", "once", "place", "vec", "chars", "art"])

    got = rows.mapInArrow(run, "host string, token long, is_text long, support long, once long, place double, vec long, chars long, art long")
    return got.groupBy("host", "token").agg(F.max("is_text").alias("is_text"), F.sum("support").alias("support"), F.sum("once").alias("once"), F.sum("place").alias("place"), F.sum(F.col("vec").cast("decimal(38,0)")).alias("vec"), F.max("chars").alias("chars"), F.sum("art").alias("art"))


def templates(stats: DataFrame) -> DataFrame:
    """(host, frame, inner, own): frame tags with their class, in order of class and place; tags of the other valid classes; own text tokens."""
    stats = saved(stats.filter((F.col("token") == 0) | (F.col("support") >= MIN_SUPPORT)), "html-stats")
    n = stats.filter("token = 0").select("host", F.col("support").alias("pages"))
    seen = stats.filter("token <> 0").join(n, "host").filter(CLASS_SHARE * F.col("support") >= F.col("pages"))
    in_article = F.col("is_text") == 2
    sizes = seen.groupBy("host", "vec", "support", "pages").agg(F.count("*").alias("size"), F.sum(F.when(in_article, F.col("chars") * F.col("support")).otherwise(0)).alias("mine"), F.max("art").alias("art"), F.max("is_text").alias("kind"), F.max("once").alias("once"))
    alone = F.when(F.col("kind") == 0, (F.col("once") == F.col("support")) & (FRAME_SHARE * F.col("support") >= F.col("pages"))).otherwise(10 * F.col("support") >= 9 * F.col("pages"))
    sizes = sizes.filter((F.col("size") > 1) | alone)
    sizes = sizes.withColumn("part", F.when(F.col("art") > 0, F.col("mine") / F.col("art")).otherwise(F.lit(0.0)))
    often = 2 * F.col("support") >= F.col("pages")
    together = sizes.groupBy("host").agg(F.sum(F.when(often, F.col("part")).otherwise(0.0)).alias("together"))
    valid = seen.join(sizes.select("host", "vec", "support", "part"), ["host", "vec", "support"]).join(together, "host")
    tag = F.col("is_text") == 0
    frame = tag & (F.col("once") == F.col("support")) & (FRAME_SHARE * F.col("support") >= F.col("pages"))
    data = (F.col("part") >= 0.5) | ((F.col("together") >= 0.5) & (10 * F.col("support") < 9 * F.col("pages")))  # an article that copies repeat
    own = often & ((F.col("is_text") == 1) | (in_article & ~data))
    return valid.filter(tag | own).groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(frame, F.struct((-F.col("support")).alias("wide"), "vec", (F.col("place") / F.col("support")).alias("at"), "token")))).alias("frame"),
        F.collect_list(F.when(tag & ~frame, F.col("token"))).alias("inner"),
        F.collect_list(F.when(own, F.col("token"))).alias("own"),
    ).select("host", F.transform("frame", lambda x: F.struct(F.xxhash64(x["vec"], x["wide"]).alias("class"), x["token"].alias("token"))).alias("frame"), "inner", "own")


def increasing(order: list[int]) -> list[int]:
    """Indices of a longest increasing run of values: the frame tokens that stand in the template's order."""
    from bisect import bisect_left

    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(order)
    for i, x in enumerate(order):
        k = bisect_left(tails, x)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(x)
            at.append(i)
        else:
            tails[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _small(table: DataFrame, size) -> DataFrame:
    """The table, broadcast if its rows and lists are few."""
    n = table.select(size.alias("n")).limit(TEMPLATE_ROWS + 1).agg(F.count("*"), F.sum("n")).first()
    return F.broadcast(table) if n[0] <= TEMPLATE_ROWS and (n[1] or 0) <= 2_000_000 else table


BLOCK = "array<struct<slot:bigint,part:bigint,new:boolean,text:string,links:bigint,article:boolean>>"


def slotted(rows: DataFrame, template: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks): data blocks of open slots in page order; a slot is named by the frame token before it, its part by the token of another class after that.
    new: the page's first block of the slot."""
    joined = rows.join(_small(template, F.size("frame") + F.size("inner") + F.size("own")), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html", 8 << 20):
            out = []
            for source, frame, inner, own in zip(*(b.column(c).to_pylist() for c in ("html", "frame", "inner", "own")), strict=True):
                p = Page(source or "")
                rank = {x["token"]: (x["class"], i) for i, x in enumerate(frame or [])}
                theirs, inside = set(own or []), set(inner or [])
                by_class: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for t, place in p.tags:
                    if t in rank:
                        by_class[rank[t][0]].append((place, t))
                marks = [(place, t, 0) for t, place in p.tags if t in inside]
                for of in by_class.values():
                    marks += [(*of[i], 1) for i in increasing([rank[t][1] for _, t in of])]
                marks.sort()
                blocks, k, slot, part = [], 0, 0, 0
                met: set[int] = set()
                for tok, place, text, links, closed, article in p.blocks:
                    while k < len(marks) and marks[k][0] <= place:
                        slot, part = (marks[k][1], 0) if marks[k][2] else (slot, marks[k][1])
                        k += 1
                    if not closed and tok not in theirs:
                        blocks.append({"slot": slot, "part": part, "new": slot not in met, "text": text, "links": links, "article": article})
                        met.add(slot)
                out.append(blocks)
            kind = pa.list_(pa.struct([("slot", pa.int64()), ("part", pa.int64()), ("new", pa.bool_()), ("text", pa.string()), ("links", pa.int64()), ("article", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), pa.array(out, kind)], ["page_id", "url", "host", "blocks"])

    return joined.select("page_id", "url", "host", "html", "frame", "inner", "own").mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, host string, blocks {BLOCK}")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text) of each row."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(source).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("page_id", "html"))
    template = saved(templates(token_stats(rows.filter("html is not null and host <> ''"))), "html-templates")
    in_article = F.exists("blocks", lambda x: x["article"])
    blocks = saved(slotted(rows, template), "html-blocks").withColumn("layout", in_article)
    b = blocks.select("host", "layout", F.explode("blocks").alias("b")).filter(~F.col("layout") | F.col("b.article"))
    parts = b.groupBy("host", "layout", "b.slot", "b.part").agg(F.sum(F.length("b.text")).alias("chars"), F.sum("b.links").alias("links"), F.sum(F.col("b.new").cast("long")).alias("pages"))
    slots = parts.groupBy("host", "layout", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.greatest(F.sum("pages"), F.lit(1)).alias("pages"), F.collect_list(F.struct("part", "chars", "links")).alias("parts"))
    slots = slots.withColumn("mean", F.col("chars") / F.col("pages"))
    best = slots.groupBy("host", "layout").agg(F.max("mean").alias("most"))
    few = lambda x: x["links"] * 2 <= x["chars"]
    named = (F.col("slot") != 0) | (F.size("parts") > 1)  # else there is no template to tell slots apart, and an article goes by its markup
    main = slots.join(best, ["host", "layout"]).filter(F.when(F.col("layout"), F.lit(True)).otherwise(F.col("mean") * 10 >= F.col("most")))
    good = F.filter("parts", lambda x: few(x) | (F.col("layout") & ~named))
    per = main.groupBy("host", "layout").agg(F.flatten(F.collect_list(F.transform(good, lambda x: F.struct(F.col("slot").alias("slot"), x["part"].alias("part"))))).alias("main"))
    out = blocks.join(_small(saved(per, "html-main"), F.size("main")), ["host", "layout"], "left")
    own = F.filter("blocks", lambda x: ~F.col("layout") | x["article"])
    kept = F.filter(own, lambda x: F.array_contains("main", F.struct(x["slot"].alias("slot"), x["part"].alias("part"))))
    kept = F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(own)
    return out.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text"))


def op8(pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
