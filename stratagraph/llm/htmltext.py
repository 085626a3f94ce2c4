"""Main text of web pages, by the paths that the pages of a host agree on.

A page is read into blocks (runs of text between block-level tags), each with its path: the tags and
generalised classes of the containers around it, and a last step for the text that a container holds
for itself. What stands in elements that never hold an article (menus, page headers, footers, forms and so on, by
tag, or by a class that says nothing else) is furniture and goes at once. Every other container is
scored: by its share of the page's text that isn't in links, how long its blocks are, and so on.

The scores are votes. In Spark they are added up by host and path, with the number of different texts that
were seen there. A host's core is the path with the greatest share. Around it everything is article unless
the votes say that it is furniture: within an ``article`` or ``main`` element that holds the core, a class
that hints at furniture with less than half of the text; elsewhere also what is mostly links, and what is the same
on page after page while the core isn't. How long lines are tells nothing: lists, talk and code are text too. Each page is then extracted again by its
host's core and verdicts. A path needs a quorum of the host's pages; rarer ones, and pages without the host's
core, are judged by the page's own scores, in the same way.
"""

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Element names of HTML by their role.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe xmp noembed noframes".split())
#: What is shown only by itself or in a form, and goes with its content where it is closed.
CONTROL = frozenset("button select datalist audio video canvas".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Block elements whose end tag may be left out: what opens inside closes them.
IMPLIED = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
CLOSES_P = BLOCK - frozenset({"html", "body", "caption", "legend", "option", "optgroup", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"})
#: Elements beyond which an open paragraph isn't looked for.
SCOPE = frozenset("html table td th caption".split())
#: Blocks that hold text but are no containers.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote ul ol dl figcaption figure td th tr tbody thead tfoot table caption summary address".split())
#: Words of class names, ids and roles that hint at furniture.
MARKS = frozenset(
    "nav navbar navigation menu menubar sidebar side aside footer foot header masthead topbar banner ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended comment comments disqus reply replies responses respond feedback discussion breadcrumb breadcrumbs pagination pager widget search searchbox toolbar contentinfo complementary hidden".split()
)
#: Words that add nothing to them: a name of such words and hints alone is furniture, one with another word may be.
PLAIN = frozenset(
    "site page main top bottom left right primary secondary global list links link box bar area block container wrapper wrap section inner outer slot unit buttons button icons posts post articles stories items item content user users reader readers widgets form group panel col column row results thread body".split()
)

#: Of those, what takes an inline element away; others (a comment in code, a side note) are often text.
INLINE = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion hidden".split())

_NAME = r"[^\s/>][^\s/>=]*+"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_ATTRS = rf"(?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+"
_TAG = re.compile(rf"<!--.*?(?:--!?>|$)|<[!?][^>]*(?:>|$)|</(?=[^a-zA-Z])[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})(?:>|$)", re.S)
_ATTR = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+", re.S)

#: Share of a host's pages that a path must be on for a vote, and pages from which on sameness tells.
QUORUM, PAGES = 0.05, 3
#: Open elements from which on further ones are siblings, as in browsers; no text is lost.
DEEPEST = 512
#: What a container whose class hints at furniture weighs as a core.
HINTED = 0.25


class Element(NamedTuple):
    name: str
    step: str
    furniture: bool
    hinted: bool


class Block(NamedTuple):
    """A run of text: its path, how many of its steps lead to the topmost hint (0: none), chars in links, whether
    it is a first heading, its text."""

    path: str
    hinted: int
    links: int
    title: bool
    text: str


def _hint(value: str) -> int:
    """2 if one of the names is furniture, 1 if one hints at it."""
    found = 0
    for name in value.lower().split():
        words = [w for w in re.split(r"[-_]+", re.sub(r"\d+", "", name)) if w]
        if any(w in MARKS for w in words):
            found = max(found, 2 if all(w in MARKS or w in PLAIN for w in words) else 1)
    return found


def _element(name: str, attrs: str, inside: list[Element]) -> Element:
    """An element with its step in a path: its classes, or its id where it has none, with digits generalised."""
    classes, own, hint, hidden, seen = "", "", 0, False, set()
    if attrs:
        for m in _ATTR.finditer(attrs):
            key = m[1].lower()
            if key in seen or key not in ("class", "id", "role", "hidden", "aria-hidden"):
                continue
            seen.add(key)
            value = html.unescape((m[2] or "").strip("\"'" if (m[2] or "")[:1] in "\"'" else ""))
            if key == "class":
                classes = "".join("." + c for c in re.sub(r"\d+", "N", value.replace("/", "_")).split())
            if key == "id":
                own = "".join("#" + c for c in re.sub(r"\d+", "N", value.replace("/", "_")).split())
            if key in ("class", "id", "role"):
                hint = max(hint, _hint(value))
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true"
    if name in ("html", "body"):
        hint = 0
    # A header within a part of a page begins it; the votes tell whether that part is the article.
    tag = name in FURNITURE and not (name == "header" and any(e.name not in ("html", "body") for e in inside))
    up = inside[-1] if inside else None
    return Element(name, name + (classes or own), tag or hidden or hint == 2 or bool(up and up.furniture), hint == 1)


def _taken_away(attrs: str) -> bool:
    """Whether an inline element is an advert or hidden, by its class names, id, role or attributes."""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'"))
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id", "role"):
            for name in value.lower().split():
                words = [w for w in re.split(r"[-_]+", re.sub(r"\d+", "", name)) if w]
                if any(w in INLINE for w in words) and all(w in INLINE or w in PLAIN for w in words):
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without furniture. An inline advert is none of a block's text; it ends with its element or block. A block's path is that of its container: headings,
    paragraphs and the like belong to what holds them."""
    stack: list[Element] = []
    out: list[Block] = []
    run: list[str] = []
    linked: list[str] = []
    at, n, anchor = 0, len(page), False
    away, deep = "", 0  # the inline element that is left out, and how often it is open

    def say(text: str) -> None:
        if away:
            return
        text = html.unescape(text)
        run.append(text)
        if anchor:
            linked.append(text)

    def flush() -> None:
        if run:
            if (text := " ".join("".join(run).split())) and not (stack and stack[-1].furniture):
                inner = [e for e in stack if e.name not in LEAF]
                hinted = next((k for k, e in enumerate(inner, 1) if e.hinted), 0)
                links = min(len(text), len(" ".join("".join(linked).split())))
                out.append(Block("/".join([*(e.step for e in inner), "."]), hinted, links, bool(stack) and stack[-1].name == "h1", text))
            run.clear()
            linked.clear()

    def close(names: frozenset[str] | set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                del stack[i:]
                return

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if away and name in BLOCK:
            away = ""
        if name == away:
            deep += -1 if m[1] else not m[3].rstrip().endswith("/")
            away = away if deep else ""
            continue
        if m[1]:
            if name in BLOCK:
                flush()
                close(HEADINGS if name in HEADINGS else {name})
            elif name == "a":
                anchor = False
            continue
        if name in RAW or name in CONTROL:
            if name == "title":
                flush()
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else at if name in CONTROL else n
            continue
        if name == "br":
            run.append(" ")
            continue
        if name == "a":
            anchor = True
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P:
                for e in reversed(stack):
                    if e.name == "p":
                        close({"p"})
                    if e.name in SCOPE or e.name == "p":
                        break
            if stack and stack[-1].name in IMPLIED.get(name, ()):
                stack.pop()
            if name not in VOID and len(stack) < DEEPEST:
                stack.append(_element(name, m[3], stack))
        elif not away and name not in VOID and m[3] and _taken_away(m[3]):
            away, deep = name, 1
    flush()
    return out


class Score(NamedTuple):
    """Of a path, summed over ``n`` pages: its share of a page's text outside of links, whether its last step hints
    at furniture, chars, those in links, blocks, first headings, and the number of different texts there."""

    n: int
    share: float
    hinted: int
    chars: int
    links: int
    blocks: int
    titles: int
    texts: int


def scores(found: list[Block]) -> dict[str, tuple[Score, int]]:
    """Each path's score on one page, and a hash of its text. A page's shares are one vote, so long pages don't rule a host."""
    whole = sum(len(b.text) - b.links for b in found)
    parts: dict[str, list[tuple[Block, int]]] = {}
    for b in found:
        steps = b.path.split("/")
        for k in range(1, len(steps) + 1):
            parts.setdefault("/".join(steps[:k]), []).append((b, k))
    out = {}
    for path, bs in parts.items():
        chars, links = sum(len(b.text) for b, _ in bs), sum(b.links for b, _ in bs)
        # Only the topmost hint of a path counts: what is below goes with it.
        hinted = int(bs[0][0].hinted == bs[0][1])
        sign = xxhash.xxh64_intdigest("\n".join(b.text for b, _ in bs).encode("utf-8", "surrogatepass")) >> 1
        out[path] = Score(1, (chars - links) / whole if whole else 0.0, hinted, chars, links, len(bs), sum(b.title for b, _ in bs), 1), sign
    return out


def core_of(votes: dict[str, Score]) -> str | None:
    """The path of text with the greatest share; below a hint it weighs less. Of equals the first by name."""
    hinted = [p for p, s in votes.items() if s.hinted]

    def weight(path: str) -> float:
        return votes[path].share * (HINTED if any(path.startswith(h + "/") for h in hinted) else 1.0)

    return min((p for p in votes if p.endswith("/.") or p == "."), key=lambda p: (-weight(p), p), default=None)


def root_of(core: str) -> str:
    """The outermost article that holds the core, else the outermost main element, else nothing."""
    steps = core.split("/")
    for name in ("article", "main"):
        for k, step in enumerate(steps, 1):
            if step.split(".")[0] == name and step != ".":
                return "/".join(steps[:k])
    return ""


def _under(path: str, root: str) -> bool:
    return path == root or path.startswith(root + "/")


def article(path: str, s: Score, core: str, of_core: Score) -> bool:
    """Whether what is beside the core's path belongs to the article, by the scores."""
    if s.hinted and s.share < 0.5 * s.n:
        return False
    root = root_of(core)
    if root and _under(path, root):
        return True
    if 2 * s.links > s.chars:
        return False
    if s.n >= PAGES and 2 * s.texts <= min(s.n, of_core.texts):
        return False
    return True


def judged(votes: dict[str, Score]) -> tuple[str | None, dict[str, bool]]:
    """The core, and the verdicts on the paths beside its own and on those that hint at furniture."""
    core = core_of(votes)
    if core is None:
        return None, {}
    spine = {core[:i] for i, c in enumerate(core) if c == "/"} | {core}
    beside = {p for p in votes if p not in spine and ("/" not in p or p.rpartition("/")[0] in spine)}
    return core, {p: article(p, s, core, votes[core]) for p, s in votes.items() if p in beside or s.hinted and p not in spine}


def extracted(found: list[Block], core: str | None, verdicts: dict[str, bool]) -> list[str]:
    """The texts of the page's blocks that belong to its article, by the host's core and verdicts."""
    if not found:
        return []
    own = {p: s for p, (s, _) in scores(found).items()}
    if core not in own:
        core, verdicts = judged(own)
    root = root_of(core)
    spine = {core[:i] for i, c in enumerate(core) if c == "/"} | {core}
    known: dict[str, bool] = {}

    def kept(path: str) -> bool:
        if path not in known:
            above = path.rpartition("/")[0]
            if path in spine:
                known[path] = True
            elif above and not kept(above):
                known[path] = False
            elif above in spine or not above or own[path].hinted:
                known[path] = verdicts[path] if path in verdicts else article(path, own[path], core, own[core])
            else:
                known[path] = True
        return known[path]

    return [b.text for b in found if (not root or _under(b.path, root)) and kept(b.path)]


_BLOCKS = pa.list_(pa.struct([("path", pa.string()), ("hinted", pa.int32()), ("links", pa.int32()), ("title", pa.bool_()), ("text", pa.string())]))
_VOTES = pa.list_(pa.struct([("path", pa.string()), ("share", pa.float64()), ("hinted", pa.int32()), ("chars", pa.int64()), ("links", pa.int64()), ("blocks", pa.int64()), ("titles", pa.int64()), ("sign", pa.int64())]))
_READ = "page_id long, url string, host string, blocks array<struct<path:string,hinted:int,links:int,title:boolean,text:string>>, votes array<struct<path:string,share:double,hinted:int,chars:long,links:long,blocks:long,titles:long,sign:long>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part, kept, votes = batch.slice(a, 64), [], []
            for page in part.column("html").to_pylist():
                found = blocks(page)
                kept.append([b._asdict() for b in found])
                votes.append([{"path": p, "share": s.share, "hinted": s.hinted, "chars": s.chars, "links": s.links, "blocks": s.blocks, "titles": s.titles, "sign": x} for p, (s, x) in scores(found).items()])
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array(kept, _BLOCKS), pa.array(votes, _VOTES)], names=["page_id", "url", "host", "blocks", "votes"])


def _decide(votes: pd.DataFrame) -> pd.DataFrame:
    """A host's core and verdicts. Its rows are as many as can have a quorum: bounded by the paths of a page."""
    by = {r.path: Score(r.n, r.share, r.hinted, r.chars, r.links, r.blocks, r.titles, r.texts) for r in votes.itertuples()}
    core, verdicts = judged(by)
    return pd.DataFrame({"host": [votes.host.iloc[0]], "core": [core], "verdicts": [[{"path": p, "article": v} for p, v in sorted(verdicts.items())]]})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, cores = [], batch.column("core").to_pylist()
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            for rows, core, verdicts in zip(part.column("blocks").to_pylist(), cores[a : a + 64], part.column("verdicts").to_pylist(), strict=True):
                texts.append("\n".join(extracted([Block(**r) for r in rows], core, {v["path"]: v["article"] for v in verdicts or ()})))
        size = [len(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(size, pa.int64()), batch.column("core")], names=["page_id", "url", "text", "n_chars", "core"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, core`` of each row of ``pages`` (``page_id, url, html``).

    A null html is empty and gives an empty text; so does a page that is all furniture. Rows without a url
    share a host without a name. Repeated rows vote and are extracted each. Columns of other names
    are not looked at; an empty table gives no rows. A page of any length is read whole.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    read = written(rows.mapInArrow(_read, _READ), "blocks")
    vote = read.select("host", F.explode("votes").alias("v")).select("host", "v.*")
    sums = lambda df: [F.sum(c).alias(c) for c in ("n", "share", "chars", "links", "blocks", "titles")] + [F.max("hinted").alias("hinted")]
    # By text first, so that a path of a hot host is spread over its texts, and copies are combined.
    vote = vote.withColumn("n", F.lit(1)).groupBy("host", "path", "sign").agg(*sums(vote)).groupBy("host", "path").agg(*sums(vote), F.count("*").alias("texts"))
    size = read.groupBy(F.col("host").alias("h_")).agg(F.count("*").alias("pages"))
    vote = vote.join(size, F.col("host") == F.col("h_")).where(F.col("n") >= F.col("pages") * QUORUM).drop("h_", "pages")
    hosts = vote.groupBy("host").applyInPandas(_decide, "host string, core string, verdicts array<struct<path:string,article:boolean>>")
    # Written, the table's size is known when the join is planned: a small one is broadcast then, and
    # the blocks aren't shuffled; a large one is joined on the host.
    hosts = written(hosts, "hosts").withColumnRenamed("host", "h_")
    joined = read.select("page_id", "url", "host", "blocks").join(hosts, F.col("host") == F.col("h_"), "left").select("page_id", "url", "blocks", "core", "verdicts")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, core string")
