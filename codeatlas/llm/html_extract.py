"""HTML extraction (operator 2) by consensus host paths.

Every page's containers are scored by the text of their own blocks, less links; each page votes for generalised paths (tag and class
names without digits, from the root down). Spark adds the votes up per host, and the winning path of a host, with its siblings of
like votes, says which containers of its pages are the article. Pages where no container has a winning path use their own best ones.
From there the scope goes up: to the article or main element around it, and else past containers whose other text is text and not links.

Boilerplate is left out: menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, by tag,
role, and class or id. A class or id marks boilerplate if it is such a word, or made of such words and words of layout alone
(cookie-notice and site-nav, but not has-sidebar, entry-header or related-work); nothing that holds an article or main element is
boilerplate. A form around at least half of the text that is left, with much text for each control, is a frame of the whole page and
counts as a plain container. If nothing is left of a page, classes and ids don't count. Block ends separate blocks; white space inside a block becomes one
space; character references are decoded.

Paths are told apart by chained 64-bit digests, so time and memory follow the length of a page, whatever its depth.

Defined results: null or empty html gives an empty text. A page without any container uses all its text. A null url votes and
looks up as a host of its own. Truncated markup is read as far as it goes. Repeated rows give one row each. An empty table gives
an empty result. Other columns are ignored.
"""

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Collection

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, small, written

#: Hosts up to which their winning paths are broadcast; beyond it pages are shuffled to them, those of each host in SALTS parts.
BROADCAST_HOSTS, SALTS = 200_000, 16
#: Characters of text for each visible control, from which a form around half of a page's text isn't one to be filled in.
CONTROL_CHARS = 80
#: Votes of a sibling path, as a share of the winner's, from which it counts as another part of the article; share of links in a text that isn't one.
LIKE, LINKS = 0.4, 1 / 3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object select xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body div main section td".split())
DROPPED = frozenset("nav header footer aside form button input select option dialog menu script style noscript template iframe svg object head textarea title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark what isn't the article, and words of layout that may stand beside them.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar aside rail widget widgets header masthead topbar footer bottombar colophon comment comments respond replies disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search form pagination pager skip hidden".split())
LAYOUT = frozenset("bar bars block blocks bottom box boxes button buttons column container global group holder inner item items left link links list lists main outer panel primary right row secondary section sections site slot sticky thread top unit wrap wrapper zone area".split())
#: Types of inputs that a form frame of a whole page has as well.
UNSEEN = frozenset("hidden submit button image reset".split())
CENTRE = frozenset(("article", "main"))
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.S)
#: An open element of the left kind is closed by the start of one of the right kinds.
P_ENDS = BLOCK - frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body"))
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "tbody", "tfoot"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option",)}
DIGITS = re.compile(r"\d+")
FRAGMENTS = re.compile(r"[a-z]+")
CLOSING = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I) for tag in RAW}


def marked(token: str) -> bool:
    """Whether a class or id, in lower case, names boilerplate."""
    words = FRAGMENTS.findall(token)
    return any(w in MARKS for w in words) and all(w in MARKS or w in LAYOUT for w in words)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c, hidden in ATTRIBUTE.findall(text):
        out.setdefault((name or hidden).lower(), a or b or c)
    return out


def step(path: int, name: str) -> int:
    """The digest of the path that goes on from another one by a name."""
    return int.from_bytes(hashlib.blake2b(b"%d/%s" % (path, name.encode("utf-8", "replace")), digest_size=8).digest(), "little", signed=True)


def path_of(*names: str) -> int:
    out = 0
    for name in names:
        out = step(out, name)
    return out


class Page:
    """The elements of a page, in order, as parallel lists (an element's parent comes before it), and its text blocks (element, text, characters in links)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.path, self.container, self.by_tag, self.by_name = ["html"], [-1], [path_of("html")], [0], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.controls: list[int] = []  # the elements around visible controls of forms
        self.read(html)
        if "form" in self.tag:
            self.frames()
        n = range(len(self.tag) - 1, 0, -1)
        holds = [False] * len(self.tag)  # a part of the page that is meant to be read
        for i in n:
            if holds[i] or self.tag[i] in CENTRE and not self.by_name[i]:
                holds[self.parent[i]] = True
        central = [False] * len(self.tag)  # inside of such a part
        self.dropped, self.barred = [False] * len(self.tag), [False] * len(self.tag)  # barred: by tags alone
        only = any(t in CENTRE and not m for t, m in zip(self.tag, self.by_name, strict=True))
        for i in range(1, len(self.tag)):
            up, t = self.parent[i], self.tag[i]
            central[i] = central[up] or t in CENTRE
            open_ = holds[i] or t in ("html", "body") or t in CENTRE and not only
            self.barred[i] = self.barred[up] or self.by_tag[i] and not open_ and not (t == "header" and central[i])
            self.dropped[i] = self.dropped[up] or self.barred[i] or self.by_name[i] and not open_
        if not any(not self.dropped[b[0]] for b in self.blocks):
            self.dropped = self.barred
        self.blocks = [b for b in self.blocks if not self.dropped[b[0]]]

    def frames(self) -> None:
        """Forms that frame a page count as plain containers."""
        left, text, controls = [True] * len(self.tag), [0] * len(self.tag), [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            left[i] = left[self.parent[i]] and not self.by_name[i] and (not self.by_tag[i] or self.tag[i] == "form")
        for node, words, _ in self.blocks:
            text[node] += len(words) if left[node] else 0
        for node in self.controls:
            controls[node] += 1
        for i in range(len(self.tag) - 1, 0, -1):
            text[self.parent[i]] += text[i]
            controls[self.parent[i]] += controls[i]
        for i, tag in enumerate(self.tag):
            if tag == "form" and left[i] and 0 < text[0] <= 2 * text[i] and text[i] >= CONTROL_CHARS * controls[i]:
                self.by_tag[i] = False

    def add(self, tag: str, attrs: str, parent: int) -> int:
        name, mark = tag, False
        if attrs.strip("/ \n\t"):
            a = attributes(attrs)
            classes, own = a.get("class", "").lower().split(), a.get("id", "").lower()
            if classes:
                name += "." + ".".join(sorted({DIGITS.sub("", c) for c in classes} - {""}))
            elif own:
                name += "#" + DIGITS.sub("", own)
            mark = any(map(marked, (*classes, own))) or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        at = len(self.tag)
        self.tag.append(tag), self.parent.append(parent), self.path.append(step(self.path[parent], name))
        self.container.append(at if tag in CONTAINER else self.container[parent])
        self.by_tag.append(tag in DROPPED), self.by_name.append(mark)
        return at

    def read(self, html: str) -> None:
        tags, parent = self.tag, self.parent
        node, text, links, at, in_link, n = 0, [], 0, 0, 0, len(html)
        open_: dict[str, int] = defaultdict(int)  # open elements of each kind

        def end() -> None:
            nonlocal links
            if text:
                words = " ".join(entities.unescape("".join(text)).split())
                if words:
                    self.blocks.append((node, words, min(links, len(words))))
                text.clear()
            links = 0

        def leave(to: int) -> int:
            """Closes the open elements up to `to`, which stays open."""
            x = node
            while x != to:
                open_[tags[x]] -= 1
                x = parent[x]
            return to

        def nearest(x: int) -> int:
            while x and tags[x] not in BLOCK:
                x = parent[x]
            return x

        while at < n:
            m = html.find("<", at)
            if m < 0:
                m = n
            if m > at:
                text.append(html[at:m])
                if in_link:
                    links += m - at
                at = m
                continue
            t = TOKEN.match(html, at)
            if not t:
                text.append("<")
                at += 1
                continue
            at = t.end()
            if not t[2]:
                continue
            tag = t[2].lower()
            if t[1]:
                if tag == "a":
                    in_link = max(0, in_link - 1)
                if tag in BLOCK:
                    end()
                if open_[tag]:
                    x = node
                    while tags[x] != tag:
                        x = parent[x]
                    node = leave(parent[x])
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    end()
                if tag == "input" and open_["form"] and attributes(t[3]).get("type", "").lower() not in UNSEEN:
                    self.controls.append(node)
                continue
            if tag in RAW:
                if open_["form"] and tag in ("textarea", "select"):
                    self.controls.append(node)
                if not t[3].endswith("/"):
                    close = CLOSING[tag].search(html, at)
                    at = close.end() if close else n
                continue
            if tag in BLOCK:
                end()
                if tag in P_ENDS and open_["p"] and tags[x := nearest(node)] == "p":  # an open paragraph ends here, also under inline elements
                    node = leave(parent[x])
                ends = SAME_ENDS.get(tag)
                if ends and tags[x := nearest(node)] in ends:
                    node = leave(parent[x])
            if tag == "html" or t[3].endswith("/") and tag not in BLOCK:
                continue
            node = self.add(tag, t[3], node)
            open_[tag] += 1
            if tag == "a":
                in_link += 1
        end()

    def votes(self) -> dict[int, tuple[float, int]]:
        """Scores of the page's generalised paths, and the path around each: a block gives its text, less links, to its container, and half to the next one out."""
        out: dict[int, float] = defaultdict(float)
        around: dict[int, int] = {}
        for node, text, links in self.blocks:
            worth, c = max(0.0, len(text) - 2.0 * links), self.container[node]
            outer = self.container[self.parent[c]] if c else 0
            out[self.path[c]] += worth * (1.25 if self.central(c) else 1.0)
            around[self.path[c]] = self.path[outer]
            if c:
                out[self.path[outer]] += worth / 2
                around[self.path[outer]] = self.path[self.container[self.parent[outer]]] if outer else 0
        return {p: (v, around[p]) for p, v in out.items()}

    def central(self, c: int) -> bool:
        return self.tag[c] in CENTRE or c > 0 and self.tag[self.container[self.parent[c]]] in CENTRE

    def scope(self, chosen: set[int]) -> set[int]:
        """The chosen containers, each taken outwards: to the outermost article or main around it, or else past those whose other text is text, up to the body."""
        inside = [0] * len(self.tag)  # text and links below each container
        linked = [0] * len(self.tag)
        for node, text, links in self.blocks:
            inside[self.container[node]] += len(text)
            linked[self.container[node]] += links
        for i in range(len(self.tag) - 1, 0, -1):
            if self.container[i] == i:
                outer = self.container[self.parent[i]]
                inside[outer] += inside[i]
                linked[outer] += linked[i]
        centre = [-1] * len(self.tag)  # the outermost article around each element, else the outermost main
        for i in range(1, len(self.tag)):
            up = centre[self.parent[i]]
            centre[i] = up if up >= 0 and not (self.tag[up] == "main" and self.tag[i] == "article") else i if self.tag[i] in CENTRE else up
        out, seen = set(), set()
        for c in chosen:
            if centre[c] >= 0:
                out.add(centre[c])
                continue
            while c not in seen:
                seen.add(c)
                outer = self.container[self.parent[c]] if c else 0
                if self.tag[outer] in ("html", "body") or linked[outer] - linked[c] > LINKS * (inside[outer] - inside[c]):
                    out.add(c)
                    break
                c = outer
        return out

    def text(self, paths: Collection[int] = ()) -> str:
        """The main text, from the containers with the given paths, or else from the best of its own."""
        filled = [False] * len(self.tag)  # elements with text inside
        for b in self.blocks:
            filled[b[0]] = True
        for i in range(len(self.tag) - 1, 0, -1):
            filled[self.parent[i]] |= filled[i]
        chosen = [i for i, c in enumerate(self.container) if i == c and filled[i]]
        found = {c for c in chosen if self.path[c] in paths}
        if not found:
            own = winners(self.votes())
            found = {c for c in chosen if self.path[c] in own}
        found = self.scope(found - {0})
        kept = [not found] * len(self.tag)
        for i in range(1, len(self.tag)):
            kept[i] = kept[i] or kept[self.parent[i]] or i in found
        return "\n\n".join(text for node, text, _ in self.blocks if kept[node])


def winners(votes: dict[int, tuple[float, int]]) -> list[int]:
    """The path of most votes, and those beside it, under the same path, with a share LIKE of its votes."""
    if not votes:
        return []
    best = max(votes, key=lambda p: (votes[p][0], p))
    return [p for p, (v, around) in votes.items() if p == best or around == votes[best][1] and v >= LIKE * votes[best][0]]


def host():
    """The host of url in lower case; a null or odd url counts as an empty host."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host().alias("host"))

    def voting(batches):
        for batch in batches:  # summed within a batch, so that a large host sends few rows
            total: dict[tuple[str, int, int], float] = defaultdict(float)
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = Page(html or "").votes()
                whole = sum(worth for worth, _ in v.values())
                for path, (worth, around) in v.items():
                    total[h, path, around] += round(worth / whole, 6) if whole else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array([k[2] for k in total], pa.int64()), pa.array(list(total.values()), pa.float64())], ["host", "path", "around", "vote"])

    ballots = rows.select("host", "html").mapInArrow(released(voting), "host string, path long, around long, vote double").groupBy("host", "path", "around").agg(F.round(F.sum("vote"), 3).alias("votes"))
    ballots = written(ballots, "host-votes")
    best = ballots.groupBy("host").agg(F.max(F.struct("votes", "path", "around")).alias("w"))
    beside = ballots.join(small(written(best, "host-best")), "host").filter((F.col("path") == F.col("w.path")) | ((F.col("around") == F.col("w.around")) & (F.col("votes") >= LIKE * F.col("w.votes"))))
    # a path has some few siblings of like votes at most, by LIKE
    chosen = written(beside.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths")), "host-paths")

    def reading(batches):
        for batch in batches:
            texts = [Page(html or "").text(frozenset(paths or ())) for html, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    if chosen.count() <= BROADCAST_HOSTS:
        read = rows.join(F.broadcast(chosen), "host", "left")
    else:
        salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        read = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    read = read.select("page_id", "url", "html", "paths")
    return read.mapInArrow(released(reading), "page_id long, url string, text string").select("*", F.length("text").cast("long").alias("n_chars"))
