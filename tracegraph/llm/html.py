"""Main text of web pages by consensus: containers scored per page, tag-class paths voted on per host, pages read again."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
DROP = RAW | set("nav footer header aside button select head menu dialog object audio video canvas map".split())
BLOCK = set(
    "p h1 h2 h3 h4 h5 h6 div li ul ol dl dt dd blockquote pre table tr td th thead tbody tfoot caption section article main"
    " figure figcaption address hr body html details summary fieldset center".split()
)
CONTAINER = set("article main section div body td".split())
CLOSES_P = BLOCK - {"html", "body"}
# Parts of class names and ids that mark text beside the article. The first kind may turn out to hold the article after all.
BESIDE = set(
    "banner promo promos promotion notice popup modal overlay sidebar side widget widgets menu menus nav navbar navigation navi header masthead footer foot"
    " share sharing social related recommended recommendations hidden skip".split()
)
NEVER = set(
    "ad ads advert adverts advertisement advertising sponsor sponsors sponsored cookie cookies consent breadcrumb breadcrumbs comment comments replies respond"
    " disqus newsletter subscribe signup login pagination pager".split()
)
STATE_FIRST, STATE_LAST = set("has have with no without is js not show hide".split()), set("layout open closed enabled disabled active visible offset free less".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
NAME = re.compile(r"(/?)([A-Za-z][^\s/><]*)")
MARK = re.compile(r"[\"'>]")
QUOTES = 1000
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")
ROOT = 0


class Scanner:
    """Tags of a page in order: ``(start, end, name, whether it closes, attributes)``; comments and declarations have no name. What opens a tag and never ends is text.

    Ends are looked for once: where none is left, or where the next one is, is remembered, so the time grows with the page's length whatever it is made of. A tag ends at the
    first ``>`` outside quotes; where its quotes do not pair, or there are over ``QUOTES`` of them, at the first ``>``.
    """

    def __init__(self, html: str):
        self.html, self.found, self.resume = html, {}, 0  # resume: where to go on, set by who takes a tag

    def next(self, what: str, at: int) -> int:
        """Where ``what`` stands next from ``at`` on; places asked for never go back."""
        k = self.found.get(what, -2)
        if k == -1 or k >= at:
            return k
        k = self.found[what] = self.html.find(what, at)
        return k

    def last(self, what: str) -> int:
        if "last " + what not in self.found:
            self.found["last " + what] = self.html.rfind(what)
        return self.found["last " + what]

    def _end(self, at: int) -> int:
        """The ``>`` of a tag whose name ends at ``at``, or -1."""
        first = self.next(">", at)
        if first < 0:
            return -1
        pos = at
        for _ in range(QUOTES):
            m = MARK.search(self.html, pos)
            if m is None:
                return first
            if m[0] == ">":
                return m.start()
            if self.last(m[0]) == m.start():
                return first
            pos = self.html.find(m[0], m.end()) + 1
        return first

    def tags(self, at: int):
        html = self.html
        while (start := html.find("<", at)) >= 0:
            at = start + 1
            if html.startswith("<!--", start):
                k = self.next("-->", start + 4)
                yield start, (k + 3 if k >= 0 else len(html)), "", False, ""
                at = self.resume
                continue
            if html.startswith(("<!", "<?"), start):
                k = self.next(">", start + 2)
                if k >= 0:
                    yield start, k + 1, "", False, ""
                    at = self.resume
                continue
            m = NAME.match(html, at)
            if m is None:
                continue
            k = self._end(m.end())
            if k >= 0:
                yield start, k + 1, m[2].lower(), bool(m[1]), html[m.end() : k]
                at = self.resume


def attributes(rest: str) -> dict[str, str]:
    """Names in lower case, the first of equal names; a name without a value has an empty one."""
    out: dict[str, str] = {}
    for name, x, y, z in ATTR.findall(rest):
        out.setdefault(name.lower(), x or y or z)
    return out


def beside(names: str) -> set[str]:
    """The marks of text beside the article among class names and ids: whole parts between hyphens, and not as a state of the page (has-sidebar)."""
    found = set()
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
            continue
        found.update(p for p in parts if p in BESIDE or p in NEVER)
    return found


def beside_text(classes: str) -> set[str]:
    """The same for an element that is a piece of running text itself: a class counts only if all its parts are marks; an id names what the text is about."""
    found = set()
    for name in classes.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if parts and all(p in BESIDE or p in NEVER for p in parts):
            found.update(parts)
    return found


@lru_cache(4096)
def judged(rest: str, running: bool) -> tuple[bool, frozenset[str], str]:
    """Of a tag's attributes: whether the element is hidden or has a role beside the article, its marks, and its first class as in a path."""
    names = attributes(rest)
    gone = names.get("hidden", "no") not in ("no", "false", "until-found") or names.get("aria-hidden", "").lower() == "true"
    gone = gone or names.get("role", "").lower() in ROLES or bool(UNSEEN.search(names.get("style", "")))
    first = names.get("class", "").split()[:1]
    marks = beside_text(names.get("class", "")) if running else beside(names.get("class", "") + " " + names.get("id", ""))
    return gone, frozenset(marks), f".{DIGITS.sub('#', first[0].lower())}" if first else ""


PLAIN = (False, frozenset(), "")


class Block(list):
    """Pieces of text of one block, the innermost container and the innermost set-aside element it lies in, and how much of it is link text."""

    __slots__ = ("box", "aside", "links", "weight")

    def good(self) -> float:
        """Characters outside links, a link's counting against the block; short blocks count for less."""
        if self.weight is None:
            n = len(" ".join("".join(self).split()))
            self.weight = max(0, n - 2 * self.links) * (1.0 if n >= 40 else 0.3)
        return self.weight


class Page:
    """Blocks of text in page order and the tree of containers they lie in.

    A path is an interned step (tag and first class, digits as ``#``, no positions) behind another path, so that pages of one template share
    it and depth costs nothing. ``box_up``, ``box_path``: a container's parent and path; ``path_up``, ``path_step``, ``path_key``,
    ``path_depth``: a path's parent, step, hash and length. Containers come after their parents.
    """

    def __init__(self):
        self.blocks: list[Block] = []
        self.box_up, self.box_path = [], []
        self.path_up, self.path_step, self.path_key, self.path_depth = [-1], [""], [ROOT], [0]
        self.paths: dict[tuple[int, str], int] = {}

    def step(self, up: int, step: str) -> int:
        at = self.paths.get((up, step))
        if at is None:
            at = self.paths[up, step] = len(self.path_up)
            self.path_up.append(up), self.path_step.append(step), self.path_depth.append(self.path_depth[up] + 1)
            self.path_key.append(next_key(self.path_key[up], step))
        return at

    def name(self, path: int) -> str:
        out = []
        while path:
            out.append(self.path_step[path])
            path = self.path_up[path]
        return "".join(f">{x}" for x in reversed(out))

    def by_path(self, weight: list[float]) -> dict[int, float]:
        """Sum of the blocks' weights inside each path's containers."""
        held = [0.0] * len(self.box_up)
        for b, w in zip(self.blocks, weight):
            if b.box >= 0:
                held[b.box] += w
        for k in range(len(held) - 1, -1, -1):
            if self.box_up[k] >= 0:
                held[self.box_up[k]] += held[k]
        out: dict[int, float] = {}
        for k, w in enumerate(held):
            out[self.box_path[k]] = out.get(self.box_path[k], 0.0) + w
        return out

    def inside(self, path: int) -> list[bool]:
        """Whether each block lies in a container with that path."""
        ok = [False] * len(self.box_up)
        for k, p in enumerate(self.box_path):
            ok[k] = p == path or (self.box_up[k] >= 0 and ok[self.box_up[k]])
        return [b.box >= 0 and ok[b.box] for b in self.blocks]

    def encloses(self, outer: int, path: int) -> bool:
        while self.path_depth[path] > self.path_depth[outer]:
            path = self.path_up[path]
        return path == outer


def next_key(key: int, step: str) -> int:
    return (xxhash.xxh64_intdigest(step, key & (1 << 64) - 1) ^ 1 << 63) - (1 << 63)


def path_key(path: str) -> int:
    key = ROOT
    for step in path.split(">")[1:]:
        key = next_key(key, step)
    return key


def read(html: str) -> Page:
    """The page without boilerplate. Ends that are missing are supplied, stray ones ignored; a script or style without an end goes up to the next ``<``, any other element
    whose content is no text is then an empty one, as are ``svg`` and ``math`` that close themselves.

    Elements go by their name, role, being hidden, or class and id (see :func:`beside`). A form, or one that goes by class or id only, stays if half of the page's text
    stands in it outside others that go; for a mark that is certain, if nine tenths do.
    """
    page = Page()
    stack: list[tuple] = []  # tag, path, innermost container or -1, whether dropped, innermost set-aside element or -1, whether in a link
    opened: dict[str, int] = {}
    apart: list[tuple[int, float]] = []  # set-aside elements: the one around it or -1, the share of the page's text with which it stays
    block: Block | None = None
    at, end = 0, len(html)
    scanner, closes = Scanner(html), {}
    nothing = ("", 0, -1, False, -1, False)

    def text(piece: str) -> None:
        nonlocal block
        _, _, box, dropped, aside, link = stack[-1] if stack else nothing
        if dropped:
            return
        if block is None:
            block = Block()
            block.box, block.aside, block.links, block.weight = box, aside, 0, None
            page.blocks.append(block)
        block.append(piece)
        if link:
            block.links += len(piece)

    def pop(to: int) -> None:
        for x in stack[to:]:
            opened[x[0]] -= 1
        del stack[to:]

    def nearest(tags) -> int:
        return next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in tags), -1)

    for start, after, tag, closing, rest in scanner.tags(0):
        if start > at:
            text(html[at:start])
        at = scanner.resume = after
        if not tag:
            continue
        if closing:
            if opened.get(tag):
                pop(nearest((tag,)))
            if tag in BLOCK or tag in DROP:
                block = None
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK or tag in DROP:
            block = None
        if tag in VOID:
            continue
        if tag in CLOSES_P and opened.get("p"):
            k = nearest(P_OR_CONTAINER)
            if k >= 0 and stack[k][0] == "p":
                pop(k)
        if tag == "li" and opened.get("li") and stack[k := nearest(LISTS)][0] == "li":
            pop(k)
        gone, marks, first = judged(rest, tag in RUNNING) if rest else PLAIN
        _, path, box, dropped, aside, link = stack[-1] if stack else nothing
        whole = tag in ("html", "body")
        dropped = dropped or tag in DROP or (gone and not whole)
        if not dropped and not whole and (marks or tag == "form"):  # some pages are one form
            apart.append((aside, 0.9 if marks & NEVER else 0.5))
            aside = len(apart) - 1
        if tag in RAW:
            if tag in ("svg", "math") and rest.endswith("/"):
                continue
            k = closes.get(tag, -2)
            if k != -1 and k < at:
                m = ENDS[tag].search(html, at)
                k = closes[tag] = m.start() if m else -1
            if k < 0:
                if tag in ("script", "style"):
                    k = html.find("<", at)
                    at = scanner.resume = k if k >= 0 else end
                continue
            at = scanner.resume = k
        if tag in CONTAINER or tag in BLOCK:
            path = page.step(path, tag + first)
        if tag in CONTAINER and not dropped:
            page.box_up.append(box), page.box_path.append(path)
            box = len(page.box_up) - 1
        stack.append((tag, path, box, dropped, aside, link or tag == "a"))
        opened[tag] = opened.get(tag, 0) + 1
    if at < end:
        text(html[at:])

    if apart:
        own, total = [0.0] * len(apart), 0.0
        for b in page.blocks:
            g = b.good()
            total += g
            if b.aside >= 0:
                own[b.aside] += g
        out = []
        for k, (up, share) in enumerate(apart):
            out.append((up >= 0 and out[up]) or not (total and own[k] >= share * total))
        page.blocks = [b for b in page.blocks if b.aside < 0 or not out[b.aside]]
    return page


P_OR_CONTAINER, LISTS = CONTAINER | {"p"}, {"li", "ul", "ol"}
RUNNING = set("p h1 h2 h3 h4 h5 h6 blockquote li dt dd td th span em strong b i a".split())
ENDS = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}


def tidy(block: Block) -> str:
    return " ".join(unescape("".join(block)).split())


def scores(page: Page) -> dict[int, float]:
    """Share of the page's good text that each path's containers hold, with a bonus for depth and for names that mean the article.

    Of containers that hold the same text the innermost scores highest. Paths that hold under 0.3 are left out.
    """
    good = [b.good() for b in page.blocks]
    total = sum(good)
    if not total:
        return {}
    depth = page.path_depth
    means = lambda p: page.path_step[p].split(".")[0] in ("article", "main")
    return {p: w / total + 0.2 * depth[p] / (depth[p] + 10) + 0.25 * means(p) for p, w in page.by_path(good).items() if w >= 0.3 * total}


def best_path(page: Page) -> tuple[int, float] | None:
    """The path with the highest score and that score; ties go to the greater key."""
    return max(scores(page).items(), key=lambda x: (x[1], page.path_key[x[0]]), default=None)


def container_scores(html: str) -> dict[str, float]:
    page = read(html)
    return {page.name(p): s for p, s in scores(page).items()}


def holds_enough(page: Page, path: int, best: int | None) -> bool:
    """Whether the containers with ``path`` hold a fair share of the good text of the page's best ones.

    Fair: half of what the best ones hold; where the best ones enclose them, well over a third, as narrowing is what the vote is for. Without a best container all text
    counts as its text.
    """
    good = [b.good() for b in page.blocks]
    held = page.by_path(good)
    there = sum(good) if best is None else held[best]
    return held[path] >= (0.37 if best is None or (best != path and page.encloses(best, path)) else 0.5) * there


def extract(html: str, path: str | int | None) -> tuple[str, str | None]:
    """(text of the containers with that path, the path used); without such containers, or if they hold little of it, the page's best path.

    ``path`` is a path or its :func:`path_key`.
    """
    page = read(html)
    wanted = path_key(path) if isinstance(path, str) else path
    at = next((p for p in set(page.box_path) if page.path_key[p] == wanted), None) if wanted is not None else None
    best = (best_path(page) or (None,))[0]
    if at is None or not holds_enough(page, at, best):
        at = best
    inside = page.inside(at) if at is not None else [True] * len(page.blocks)
    texts = (tidy(b) for b, ok in zip(page.blocks, inside) if ok)
    return "\n".join(t for t in texts if t), None if at is None else page.name(at)


def _vote_batches(batches):
    for batch in batches:
        out = ([], [], [])
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = read(html or "")
            if best := best_path(page):
                for col, v in zip(out, (host, page.path_key[best[0]], round(best[1] * 1e6))):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64()))], names=["host", "path", "score"])


def _extract_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts, used = [], []
            for html, path in zip(part.column("html").to_pylist(), part.column("path").to_pylist()):
                t, p = extract(html or "", path)
                texts.append(t), used.append(p)
            out = part.drop_columns(["html", "path"])
            for name, values, kind in (("text", texts, pa.string()), ("n_chars", [len(t) for t in texts], pa.int64()), ("path", used, pa.string())):
                out = out.append_column(name, pa.array(values, kind))
            yield out


def host_of(url: str = "url") -> F.Column:
    """Host in lower case without ``www.`` or ``m.``; null and odd urls share an empty host."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))), r"^(?:www|m)\.", "")


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the key of the path with the most score over all pages of a host; ties go to the smaller key.

    A page votes for its best container with that container's score. It has no vote for the ones around it, as those are common to all templates of a host.
    """
    votes = pages.select(host_of().alias("host"), "html").mapInArrow(_vote_batches, "host string, path long, score long")
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("m")).select("host", F.col("m.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, path`` of every row of ``pages``, read with its host's winning path.

    Two passes over the pages and one small vote table between them; a page without the winning path, or with little of its good text there, falls back on its own
    best container, and on all text outside boilerplate where none holds enough. Null or empty html gives empty text; null urls form one host;
    repeated rows are extracted alike; an empty table gives no rows; other columns are not read. Time and memory grow with a page's length, however deep
    its elements are nested.
    """
    winners = cut(winning_paths(pages))
    rows = pages.select("page_id", "url", "html", host_of().alias("host")).join(winners, "host", "left").drop("host")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return rows.mapInArrow(_extract_batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, path string")
