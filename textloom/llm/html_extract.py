"""HTML extraction by template deduction from the pages of a host.

After Arasu and Garcia-Molina, "Extracting Structured Data from Web Pages"
(2003). A token is a container element told by its path (tags with classes and
ids). Over the different pages of one host each token has a vector of
occurrences. Tokens with equal vectors form a class; it is valid if its tokens
stand exactly once on each of their pages. Valid classes are nested: a class
hangs in the slot of the innermost valid token of another class around it, and
tokens of one class in different slots are classes of their own. This tree is
the template. A text belongs to the slot of the innermost template token around
it, so records that repeat on a page (comments, list entries) are told together
by the slot that holds them.

Slots hold no main text if they are menus (most of their text is in links),
fixed notices (one and the same text on every page), or labelled so by tags and
names of elements; a class whose text is mostly such goes whole. The host's
largest slot and slots of articles are excepted, but for notices inside an
article that twice as many pages share. What is left is the main text, inside
the article where a page has one.

Vectors are never gathered: each (host, token) keeps a sum of hashes of (page,
occurrences), equal for equal vectors, so a host with a third of all pages is
combined before the shuffle like any other. Pages of the same texts are no
evidence: they count once for a host. Pages are parsed once for the template and
once for their text.

Defined results: a null or empty page has an empty text; a null url is a host of
its own; pages of a host with fewer than ``least_pages`` pages are told apart by
tags, names and links alone; containers nested deeper than ``DEPTH`` belong to
the slot of the last one above that; repeated rows come back once each; an empty
table gives no rows; other columns, whatever their names, are ignored; pages cut
off anywhere are read to their end.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, pick, stored

# Nothing in a tag is tried twice: attributes are read once, up to the next "<" outside quotes; where that fails, the tag ends
# at the first ">" before the next "<"; and the last tag may be cut off.
_ATTRIBUTES = r"""(?:\s++|/|[^\s"'<>=/]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|"|')*+"""
_TAG = re.compile(rf"""<!--.*?(?:-->|$)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES}(?=>)|[^<>]*+(?=>))>|<[a-zA-Z/!][^<>]*+$""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Element kinds of HTML, and names by which pages call what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CONTAINERS = frozenset("html body div main article section header footer nav aside form td table ul ol dl figure center fieldset".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu header".split()) | RAW
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus"
    " footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related replies reply"
    " respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words that may stand beside one of NAMES in a name without changing what it says.
BESIDE = frozenset(
    "area articles bar block bottom box btn button buttons center col column container content count entry feed fixed float foot form global group head"
    " holder home inner item items label layer layout left line link links list main mobile nav outer page panel posts primary region right row secondary"
    " section site slot small sticky sub text thread title top unit wrap wrapper zone".split()
)
DEPTH = 64
_CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}


def _names(attributes: str) -> list[str]:
    return " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower().split() if "=" in attributes else []


def _stem(name: str) -> str:
    """A name without the number of an instance (a single digit tells parts of a page apart and stays)."""
    return re.sub(r"-?\d{2,}$", "", "-".join(re.split(r"[^a-z0-9]+", name)))


def _key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(1 << 14)
def says_no_text(name: str) -> bool:
    """Whether a class or id names something that isn't main text: by one of NAMES, alone or beside words of layout."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    return not NAMES.isdisjoint(parts) and all(p in NAMES or p in BESIDE for p in parts)


class Page:
    """A page as blocks of text: (path keys of its containers, whether labelled as no main text, in article, text, link characters)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[int, ...], bool, bool, str, int]] = []
        self.seen: dict[int, list] = {}
        self._stack: list[tuple[str, tuple[int, ...], bool, bool]] = [("", (0,), False, False)]  # tag, path, labelled, in article
        self._text: list[str] = []
        self._linked, self._links = 0, 0
        self._mute: list[str] = []  # inline elements labelled as no main text, and those of the same tag inside
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                _, path, labelled, article = self._stack[-1]
                self.blocks.append((path, labelled, article, text, self._linked))
        self._text, self._linked, self._mute = [], 0, []

    def _add(self, text: str) -> None:
        if text and not self._mute:
            self._text.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _open(self, tag: str, attributes: str) -> None:
        _, path, labelled, article = self._stack[-1]
        names = _names(attributes)
        whole = tag in ("html", "body", "article", "main")
        # An article's own head holds its headline.
        labelled = labelled or (tag in DROPPED and not (tag == "header" and article)) or (not whole and any(map(says_no_text, names)))
        if tag in CONTAINERS:
            article = (article or tag in ("article", "main")) and not labelled
            if len(path) < DEPTH:
                path = (*path, _key(f"{path[-1]}/{tag}.{'.'.join(map(_stem, names))}".encode()))
            seen = self.seen.setdefault(path[-1], [0, path, labelled, article])
            seen[0] += 1
            seen[2] &= labelled
            seen[3] |= article
        self._stack.append((tag, path, labelled, article))

    def _close(self, tag: str) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                del self._stack[i:]
                return

    def _inline(self, tag: str, closes: bool, attributes: str) -> None:
        if tag == "a":
            self._links = max(0, self._links + (-1 if closes else 1))
        elif tag in ("br", "wbr"):
            self._add(" ")
            return
        if self._mute:
            if not closes and tag == self._mute[0]:
                self._mute.append(tag)
            elif closes and tag == self._mute[0]:
                self._mute.pop()
        elif not closes and any(map(says_no_text, _names(attributes))):
            self._text.append(" ")
            self._mute = [tag]

    def _read(self, source: str) -> None:
        at = 0
        while m := _TAG.search(source, at):
            self._add(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in INLINE:
                self._inline(tag, bool(m[1]), m[3] or "")
                continue
            self._flush()
            self._links = 0
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag not in VOID:
                closes = _CLOSES.get(tag, frozenset({"p"}) if tag in CONTAINERS or tag[0] == "h" else frozenset())
                while self._stack[-1][0] in closes:
                    self._stack.pop()
                self._open(tag, m[3] or "")
        self._add(source[at:])
        self._flush()

    def main_text(self, dropped: frozenset[int] = frozenset()) -> str:
        """The texts of unlabelled blocks outside dropped tokens, of the article's alone if there are any."""
        kept = [b for b in self.blocks if not b[1] and b[0][-1] not in dropped]
        kept = [b for b in kept if b[2]] or kept
        return " ".join(b[3] for b in kept)


def host_of(url: str | None) -> str | None:
    return url and re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", url).lstrip("/").split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].lower()


_TOKENS = "host string, page long, token long, path array<long>, times int, labelled boolean, article boolean, chars long, linked long, said long"


def _tokens(pages: DataFrame) -> DataFrame:
    """One row per container token of a page: occurrences, and what stands directly inside it; a page is told by its texts."""
    names = [c.split()[0] for c in _TOKENS.split(", ")]

    def run(cols: dict) -> dict:
        rows = []
        for url, source in zip(cols["url"], cols["html"]):
            page = Page(source)
            held: dict[int, list] = {}
            for path, _, _, text, linked in page.blocks:
                h = held.setdefault(path[-1], [0, 0, 0])
                h[0] += len(text)
                h[1] += linked
                h[2] = zlib.crc32(text.encode(), h[2])
            host, key = host_of(url), _key(repr([(b[0][-1], b[3], b[4]) for b in page.blocks]).encode())
            rows.append((host, key, 0, [0], 1, False, False, *held.get(0, (0, 0, 0))))
            rows += [(host, key, t, path, n, labelled, article, *held.get(t, (0, 0, 0))) for t, (n, path, labelled, article) in page.seen.items()]
        return dict(zip(names, zip(*rows) if rows else [[]] * len(names)))

    return map_batches(pages, run, _TOKENS)


def vectors(pages: DataFrame) -> DataFrame:
    """One row per (host, token): its vector over the host's different pages, and sums of what it holds."""
    return _tokens(pages).distinct().groupBy("host", "token", "path").agg(
        F.count("*").alias("pages"),
        F.max("times").alias("times"),
        F.sum(F.xxhash64("page", "times").bitwiseAND(F.lit((1 << 40) - 1))).alias("vector"),
        F.min("labelled").alias("labelled"),
        F.max("article").alias("article"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        (F.min("said") == F.max("said")).alias("fixed"),
    )


def templates(one: DataFrame) -> DataFrame:
    """(host, token, slot, vector, outer): every token's slot, the innermost valid token that it is or is in, with its class.

    outer is the slot of the class around; vector and outer name a class of the template.
    """
    valid = one.where("times = 1").select(F.col("host").alias("of"), F.col("token").alias("up"), F.col("vector").alias("up_vector"))
    around = one.select("host", "token", F.posexplode("path").alias("depth", "at"))
    met = around.join(valid, F.col("host").eqNullSafe(F.col("of")) & (F.col("at") == F.col("up")))
    chain = met.groupBy("host", "token").agg(F.array_sort(F.collect_list(F.struct("depth", "up", "up_vector"))).alias("chain"))  # at most DEPTH
    last = F.element_at("chain", -1)
    others = F.filter("chain", lambda x: x["up_vector"] != F.element_at("chain", -1)["up_vector"])
    return chain.select("host", "token", last["up"].alias("slot"), last["up_vector"].alias("vector"), F.get(others, F.size(others) - 1)["up"].alias("outer"))


def _same_host(a: DataFrame, b: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Join on the null-safe host and other columns; b's copies of them go."""
    renamed = b.withColumnsRenamed({c: f"_{c}" for c in ("host", *more)})
    on = F.col("host").eqNullSafe(F.col("_host"))
    for c in more:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(renamed, on, how).drop("_host", *[f"_{c}" for c in more])


def dropped_tokens(one: DataFrame, template: DataFrame, least_pages: int = 3, share: float = 0.6) -> DataFrame:
    """(host, dropped): for each host, the tokens of slots that hold no main text."""
    placed = _same_host(one.drop("vector"), template, "token")
    slots = placed.groupBy("host", "slot", "vector", "outer").agg(
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        F.min(F.col("fixed") | (F.col("chars") == 0)).alias("fixed"),
        F.max("pages").alias("pages"),
        F.min("labelled").alias("labelled"),
        F.max("article").alias("article"),
    )
    hosts = slots.where(~F.col("labelled")).groupBy("host").agg(F.max("chars").alias("largest"))
    known = _same_host(slots, hosts, how="left").withColumn("free", F.col("labelled") | (F.col("chars") < F.coalesce("largest", F.lit(0))))
    notice = F.col("fixed") & (F.col("pages") >= F.when(F.col("article"), 2 * least_pages).otherwise(least_pages))
    menu = (F.col("linked") > share * F.col("chars")) & ~F.col("article")
    told = known.withColumn("out", F.col("free") & (F.col("chars") > 0) & (F.col("labelled") | notice | menu))
    # A class of the template is judged whole, by most of its text.
    classes = told.groupBy("host", "vector", "outer").agg(
        (F.sum(F.when(F.col("out"), F.col("chars")).otherwise(0)) > share * F.sum("chars")).alias("class_out"),
        F.min(F.col("free") & ~F.col("article")).alias("class_free"),
    )
    judged = _same_host(told, classes, "vector", "outer").where(F.col("out") | (F.col("class_out") & F.col("class_free")))
    return _same_host(template, judged.select("host", "slot"), "slot", how="left_semi").groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("dropped"))


def extract(pages: DataFrame, least_pages: int = 3, broadcast_tokens: int = 1_000_000) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    The tokens and the hosts' dropped ones are written once. The latter are
    broadcast only while their counted tokens are at most broadcast_tokens;
    beyond that pages are joined by a shuffle on the host, whose large
    partitions adaptive execution splits.
    """
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    one = stored(vectors(rows.select("url", "html")), "tokens")
    found = stored(dropped_tokens(one, templates(one), least_pages), "templates").withColumnRenamed("host", "of")
    size = found.agg(F.coalesce(F.sum(F.size("dropped") + 8), F.lit(0))).first()[0]
    found = F.broadcast(found) if size <= broadcast_tokens else found
    plain = F.regexp_replace("url", "^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    own = F.lower(F.regexp_extract(plain, r"^/*(?:[^/?#]*@)?([^/?#]*)", 1))
    joined = rows.withColumn("host", own).join(found, F.col("host").eqNullSafe(F.col("of")), "left").select("page_id", "url", "html", "dropped")

    def run(cols: dict) -> dict:
        texts = [Page(s).main_text(frozenset(d or ())) for s, d in zip(cols["html"], cols["dropped"])]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(joined, run, "page_id long, url string, text string, n_chars long")
