"""Main text of web pages by equivalence classes of tokens over same-host pages.

A token is an element's place (the tags, classes and ids on the way to it) or a text at such a place. How often it occurs on each of
a host's pages is its occurrence vector; tokens of one vector form an equivalence class, as a template writes them together. A
class is valid if it is on enough pages and its tokens come in one order on all of them. Valid classes that occur once a page are
the template's skeleton; all else nests in the slot of the innermost skeleton element around it. The slot with most text that is no
link is where the article is; texts that are themselves in valid classes belong to the template and are left out. Names of
tags and classes only decide what is cut out inside the slot, and where a host has too few pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from perfloom.llm.common import ship, written

#: A template of less different pages is no evidence; a token of the template is on this share of a host's pages, the skeleton on that one.
MIN_PAGES, FREQUENT, SKELETON = 5, 0.5, 0.9
#: Templates are broadcast up to this many hosts (a row is some hundred bytes), and joined beyond.
BROADCAST_HOSTS = 100_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "select", "object", "canvas"}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in _RAW}
_BLOCK = set(("html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote "
              "pre figure figcaption address details summary hr nav header footer aside form fieldset menu dialog center").split())
_VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "source", "track", "area", "base", "col", "embed", "param"}
_AUTO_CLOSE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "main", "blockquote", "td", "th"}
_CLUTTER_TAGS = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_CLUTTER_WORDS = re.compile(
    r"ads?|advert\w*|banners?|promos?|sponsor\w*|cookies?|notices?|consent|popup|modal|overlay|sidebar\w*|menus?|nav\w*|breadcrumbs?|footer|masthead|"
    r"comments?|commentlist|disqus|respond|replies|share|sharing|social|related|newsletter|subscribe|widgets?|toolbar|pagination|skip|alert|"
    r"contentinfo|complementary|navigation|search")
# Words that say nothing of what an element holds: of a name's parts, the last other one counts ("cookie-notice", "comment-list").
_GENERIC = set("area bar block body box button buttons container content inner item items left link links list panel right row section slot top wrap wrapper".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup"}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _label(tag: str, attrs: str) -> str:
    found = " ".join(v.strip("\"'") for _, v in _ATTR.findall(attrs)) if attrs else ""
    return f"{tag}.{'.'.join(found.lower().split())}" if found else tag


def is_clutter(label: str, header: bool = False) -> bool:
    """Whether an element inside the main slot is cut out by its tag or names; ``header`` elements where asked for."""
    tag, _, names = label.partition(".")
    if tag in _CLUTTER_TAGS or (header and tag == "header"):
        return True
    for name in names.split(".") if names else ():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        while len(parts) > 1 and parts[-1] in _GENERIC:
            parts.pop()
        if parts and _CLUTTER_WORDS.fullmatch(parts[-1]):
            return True
    return False


class Page:
    """Block elements in the order they open (number 0 stands for the document) and texts with the element they are in.

    An element knows its parent, so a page takes memory in proportion to its length however deep it nests.
    """

    def __init__(self, page: str):
        self.labels, self.parents, self.tokens, self.at = [""], [-1], [0], [0]
        self.texts: list[tuple[int, str, int, int]] = []  # element, words, characters in links, position
        self._read(page)

    def _open(self, label: str, parent: int, position: int) -> int:
        self.labels.append(label)
        self.parents.append(parent)
        self.tokens.append(xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), self.tokens[parent]) >> 1)
        self.at.append(position)
        return len(self.labels) - 1

    def _read(self, page: str) -> None:
        stack, opened, text = [0], Counter(), []
        links = in_link = at = position = 0

        def flush() -> None:
            nonlocal links, position
            if text:
                words = " ".join(html.unescape("".join(text)).split())
                if words:
                    self.texts.append((stack[-1], words, min(links, len(words)), position))
                    position += 1
                text.clear()
            links = 0

        def close(upto: int) -> None:
            for node in stack[upto:]:
                opened[self.labels[node].partition(".")[0]] -= 1
            del stack[upto:]

        def innermost(tags: set[str], scope: set[str]) -> int:
            if any(opened[t] for t in tags):
                for i in range(len(stack) - 1, 0, -1):
                    tag = self.labels[stack[i]].partition(".")[0]
                    if tag in tags:
                        return i
                    if tag in scope:
                        break
            return 0

        while m := _TOKEN.match(page, at):
            tag, at = m[2], m.end()
            if tag is None:
                piece = m[0]
                if not (piece[0] == "<" and len(piece) > 1):
                    text.append(piece)
                    if in_link:
                        links += len(piece)
                continue
            tag, end = tag.lower(), m[1]
            if tag in _RAW:
                if not end and not m[3].endswith("/"):  # what is inside is no markup: straight to the closing tag
                    found = _RAW_END[tag].search(page, at)
                    at = found.start() if found else len(page)
                continue
            if tag == "a":
                in_link = 0 if end else 1
                continue
            if tag not in _BLOCK:
                if tag in _VOID:
                    text.append(" ")
                continue
            flush()
            if end:
                if i := innermost({tag}, set()):
                    close(i)
                continue
            if i := innermost(_AUTO_CLOSE.get(tag, {"p"}), _SCOPE):
                close(i)
            if tag not in _VOID:
                opened[tag] += 1
                stack.append(self._open(_label(tag, m[3]), stack[-1], position))
                position += 1
        flush()

    def inside(self) -> tuple[list[int], list[int]]:
        """Characters of text, and of links, inside each element."""
        chars, links = [0] * len(self.labels), [0] * len(self.labels)
        for node, words, linked, _ in self.texts:
            chars[node] += len(words)
            links[node] += linked
        for node in range(len(self.labels) - 1, 0, -1):
            chars[self.parents[node]] += chars[node]
            links[self.parents[node]] += links[node]
        return chars, links

    def text(self, slot: int | None, fixed: frozenset[int]) -> str:
        """Texts in the slot (where the page has no such element, in its articles, main or whole), less clutter and ``fixed`` ones.

        A form around most of the page's text is a wrapper.
        """
        chars = self.inside()[0]
        for wanted in [lambda i: self.tokens[i] == slot] * (slot is not None) + [lambda i: self.labels[i].partition(".")[0] == "article",
                                                                                 lambda i: self.labels[i].partition(".")[0] == "main", lambda i: i == 0]:
            roots = [wanted(i) for i in range(len(self.labels))]
            held, cut = roots[:], [False] * len(roots)
            for i in range(1, len(roots)):
                up = self.parents[i]
                held[i] = held[i] or held[up]
                if cut[up]:
                    cut[i] = True
                elif held[up] and not roots[i]:  # an element around the slot is never clutter; a header is only outside articles
                    wraps = self.labels[i].partition(".")[0] in ("form", "fieldset") and 2 * chars[i] > chars[0]
                    cut[i] = not wraps and is_clutter(self.labels[i], roots[0])
            if any(held[node] for node, *_ in self.texts):
                return "\n\n".join(w for node, w, *_ in self.texts if held[node] and not cut[node] and not (fixed and self.text_token(node, w) in fixed))
        return ""

    def text_token(self, node: int, words: str) -> int:
        return xxhash.xxh64_intdigest(b"\1" + words.encode("utf-8", "surrogatepass"), self.tokens[node]) >> 1


_TOKENS = "host string, page long, token long, parent long, label string, times long, at long, chars long, links long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page and token: ``label`` and ``parent`` of an element's place, null for a text; ``chars`` inside it."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4)
    names = [c.split()[0] for c in _TOKENS.split(", ")]
    for b in batches:
        rows = []
        for host, number, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            p, found = Page(page.as_py() or ""), {}
            chars, links = p.inside()
            for i in range(1, len(p.labels)):
                t = found.setdefault(p.tokens[i], [p.tokens[p.parents[i]], p.labels[i], 0, p.at[i], 0, 0])
                t[2] += 1
                t[4] += chars[i]
                t[5] += links[i]
            for node, words, linked, at in p.texts:
                t = found.setdefault(p.text_token(node, words), [p.tokens[node], None, 0, at, 0, 0])
                t[2] += 1
                t[4] += len(words)
                t[5] += linked
            rows += [(host, number, token, *t) for token, t in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def main_slot(tokens: list[dict], pages: int) -> int | None:
    """Token of the main slot's element in a host's template; None where the pages give no evidence.

    ``tokens``: the structure tokens of valid classes (token, parent, label, n, most, chars, links).
    """
    skeleton = {t["token"]: t for t in tokens if t["most"] == 1 and t["n"] >= SKELETON * pages}
    every = {t["token"]: t for t in tokens}
    if pages < MIN_PAGES or not skeleton:
        return None
    own = {k: max(0, t["chars"] - t["links"]) for k, t in skeleton.items()}
    above: dict[int, int | None] = {}
    for k in skeleton:  # the innermost skeleton element around each; what is in it is not the outer slot's own
        up = every[k]["parent"]
        while up in every and up not in skeleton:
            up = every[up]["parent"]
        above[k] = up if up in skeleton else None
    for k, up in above.items():
        if up is not None:
            own[up] -= max(0, skeleton[k]["chars"] - skeleton[k]["links"])

    def tag(k: int) -> str:
        return skeleton[k]["label"].partition(".")[0]

    best = max(skeleton, key=lambda k: (own[k], tag(k) in ("article", "main"), -k))
    if own[best] <= 0:
        return None
    # An article around the slot is the slot; else what adds nothing but a heading is.
    up = best
    while up is not None:
        if tag(up) in ("article", "main"):
            return up
        up = above[up]
    while (up := above[best]) is not None and tag(up) not in ("html", "body") and all(
            tag(k) in _HEADINGS for k, over in above.items() if over == up and k != best):
        best = up
    return best


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, fixed) of ``pages`` (host, html): token of the main slot's element, text tokens that belong to the template.

    Pages of one content have one vote a host, so copies of a page are no evidence that its text is the template's. A vector is
    kept as the exclusive or of a hash per page and count, so no group of pages meets in one place. A host's valid classes are few
    tokens whatever its number of pages.
    """
    page = F.xxhash64(F.coalesce("html", F.lit("")))
    found = written(pages.select("host", page.alias("page"), "html").mapInArrow(_tokens, _TOKENS).dropDuplicates(["host", "page", "token"]))
    n_pages = pages.select("host", page.alias("page")).distinct().groupBy(F.col("host").alias("of_host")).agg(F.count(F.lit(1)).alias("pages"))
    tokens = found.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.count(F.lit(1)).alias("n"), F.max("times").alias("most"), F.max("parent").alias("parent"),
        F.max("label").alias("label"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    frequent = written(tokens.join(n_pages, F.col("host") == F.col("of_host")).where(
        F.col("n") >= F.greatest(F.lit(FREQUENT) * F.col("pages"), F.lit(2))).drop("of_host"))
    # The order of each class on each page; a class of one token is in order.
    members = frequent.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("host", "n", "vector"))).where("size > 1").select(
        F.col("host").alias("of_host"), F.col("token").alias("of_token"), "n", "vector")
    placed = found.select("host", "page", "token", "at").join(members, (F.col("host") == F.col("of_host")) & (F.col("token") == F.col("of_token")))
    orders = placed.groupBy("host", "page", "n", "vector").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("at", "token")))["token"]).alias("order"))
    broken = orders.groupBy("host", "n", "vector").agg(F.min("order").alias("a"), F.max("order").alias("b")).where("a <> b").select("host", "n", "vector")
    valid = frequent.join(broken, ["host", "n", "vector"], "left_anti")
    shape = F.struct("token", "parent", "label", "n", "most", "chars", "links")
    is_fixed = F.col("label").isNull() & (F.col("n") >= SKELETON * F.col("pages")) & (F.col("pages") >= MIN_PAGES)
    grouped = valid.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list(F.when(F.col("label").isNotNull(), shape)).alias("tokens"),
                                        F.collect_list(F.when(is_fixed, F.col("token"))).alias("fixed"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [main_slot(t, n) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.int64()), b.column(3)], ["host", "slot", "fixed"])

    return grouped.select("host", "tokens", "pages", "fixed").mapInArrow(decide, "host string, slot long, fixed array<long>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (empty if none), n_chars. Null html is empty; null or odd urls share the host ''.

    Pages of any length and depth are read whole, in memory in proportion to their length. Repeated rows give repeated rows, an
    empty table an empty one; other columns, whatever their names, are not looked at.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    known = templates(rows).withColumnRenamed("host", "of_host")
    few = rows.select("host").distinct().count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(known) if few else known, F.col("host") == F.col("of_host"), "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [Page(h.as_py() or "").text(s, frozenset(f or ())) for h, s, f in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    text = joined.select("id", "url", "html", "slot", "fixed").mapInArrow(extract, f"id {kind}, url string, text string")
    return text.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
