"""Main text of web pages by site style trees: same-host DOMs merged, branches of low importance removed."""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trimmed

GAMMA = 0.9  # weight of a node's content against its presentation
LOW = 0.5  # presentation nodes of less importance are noise
CONTENT_LOW = 0.25  # content nodes of less importance are noise: texts that stand on about n ** 0.75 of a node's n pages
PRIOR = 1.0  # pages that full importance counts for before entropies are believed
MARKED = 0.0  # prior importance of what markup names as no part of the article; everything else has 1

# Fixed values of HTML: elements without content, elements whose content is not text of the page, elements that break a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|textarea|title|iframe"
SKIP = frozenset("object svg math select button canvas video audio".split())  # ordinary elements whose subtree is not text of the page
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div footer form header html li main nav ol section table td th ul".split())
# Elements and class or id words that never hold the article: navigation, headers, footers, sidebars, notices, adverts, forms, reader comments.
NOISE_TAGS = frozenset("nav header footer aside form menu dialog head fieldset".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted recommended related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Words that say nothing of a part's kind, only of its place or shape: of a compound's words the last other one counts, as in "comment-list".
PLACE_WORDS = frozenset(
    "area articles bar block body bottom box button buttons container content desktop global icons inner item items left link links list main mobile outer page panel posts primary right secondary section site slot stories toggle top unit wrap wrapper".split()
)
NOISE_ROLES = frozenset("banner navigation contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:.*?</(?P=raw)\s*>|.*\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
    re.S | re.I,
)
_SKIP_END = re.compile(rf"</({'|'.join(sorted(SKIP))})\b", re.I)
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'>]+/$")  # the slash belongs to the value
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def names_noise(value: str) -> bool:
    """Whether a class or id names what is no part of an article: a word of a compound decides only as its head, so "ad-hoc" is none."""
    for name in value.split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        while len(words) > 1 and (words[-1] in PLACE_WORDS or words[-1][0].isdigit()):
            words.pop()
        if words and words[-1] in NOISE_WORDS:
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, bool, str, str]]:
    """The page's blocks in order: path, whether an ancestor is noise by its kind, inline presentation, text.

    A path names the block-level ancestors with their classes.  Start tags close what HTML says they close; an end tag
    closes up to its match, or nothing; an article or main element ends an unclosed branch of noise.  The subtree of a
    SKIP element is left out without breaking the block around it; one that is never closed is only a tag.
    """
    last_end: dict[str, int] | None = None
    out: list[tuple[str, bool, str, str]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, path so far, noise
    parts: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path, noise = next(((s[1], s[2]) for s in reversed(stack) if s[0] not in SKIP), ("", False))
                out.append((path, noise, ",".join(inline), text))
            parts.clear()
        inline.clear()

    def pop_to(tags, scopes=frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                flush()
                del stack[k:]
                return
            if stack[k][0] in scopes:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        skipping = any(s[0] in SKIP for s in stack)
        if m.start() > at and not skipping:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in SKIP:
            own = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if own is not None and (m["end"] or tag in ("button", "select")):  # these two do not nest: a start tag closes the open one
                del stack[own:]
            if m["end"] or tag in ("svg", "math") and m["attrs"].endswith("/") and not _UNQUOTED_SLASH.search(m["attrs"]):
                continue
            if last_end is None:
                last_end = {e[1].lower(): e.start() for e in _SKIP_END.finditer(page)}
            if last_end.get(tag, -1) >= at:
                stack.append((tag, stack[-1][1] if stack else "", True))
            continue
        if tag not in BLOCK:
            if skipping:
                continue
            if tag == "br":
                parts.append(" ")
            elif not m["end"]:
                inline.append(tag)
            continue
        if m["end"]:
            pop_to((tag,))
            continue
        flush()
        if tag in ("article", "main"):
            pop = next((k for k, s in enumerate(stack) if s[2] and s[0] not in ("html", "body")), None)
            if pop is not None:
                del stack[pop:]
        elif tag in CLOSES:
            pop_to(CLOSES[tag], SCOPES - set(CLOSES[tag]))
        pop_to(("p",), SCOPES | SKIP)
        if tag in VOID:
            continue
        path, noise = (stack[-1][1], stack[-1][2]) if stack else ("", False)
        inside = any(s[0] == "article" for s in stack)  # a header in an article is the article's own
        name, noise = tag, noise or tag in NOISE_TAGS and not (tag == "header" and inside)
        for key, value in _ATTR.findall(m["attrs"]):
            value = value.strip("\"'").lower()
            key = key.lower()
            if key == "hidden" or key == "role" and value in NOISE_ROLES:
                noise = True
            elif key in ("class", "id") and value:
                noise = noise or tag not in ("html", "body", "article", "main") and names_noise(value)
                if key == "class":
                    name += "." + ".".join(sorted(set(value.split())))
        stack.append((tag, f"{path}/{name}", noise))
    if at < len(page) and not any(s[0] in SKIP for s in stack):
        parts.append(page[at:])
    flush()
    return out


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def nodes_of(page: str) -> list[tuple[int, int, int, int, float, str]]:
    """The page's blocks in order, each with its nodes of the style tree: path, its presentation and its whole content on this page (one
    presentation node per path), the block's own content (a content node below it), the prior importance that markup gives, the text."""
    blocks = blocks_of(page)
    seen: dict[str, tuple[list[str], list[str]]] = {}
    for path, _, inline, text in blocks:
        styles, texts = seen.setdefault(path, ([], []))
        styles.append(inline)
        texts.append(text)
    known = {p: (_hash(p), _hash(*s), _hash(*t)) for p, (s, t) in seen.items()}
    return [(*known[path], _hash(text), MARKED if noise else 1.0, "" if noise and MARKED < LOW else text) for path, noise, _, text in blocks]


BLOCKS = "array<struct<path: bigint, style: bigint, whole: bigint, content: bigint, prior: double, text: string>>"


def _parsed(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            hosts, pages, blocks = [], [], []
            for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                hosts.append(host_of(url))
                pages.append(_hash(page or ""))
                blocks.append([dict(zip(("path", "style", "whole", "content", "prior", "text"), x, strict=True)) for x in nodes_of(page or "")])
            ints = [(c, pa.int64()) for c in ("path", "style", "whole", "content")]
            kind = pa.list_(pa.struct([*ints, ("prior", pa.float64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(blocks, kind)], ["page_id", "url", "host", "page", "blocks"])


def importance(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Pages and importance of each node: entropies of its presentations and contents over the pages it stands in, each
    divided by the greatest that so many pages allow, weighted by GAMMA.  All alike gives 0, all different gives 1."""

    def entropy(col: str) -> DataFrame:
        counts = nodes.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("c"))
        total = counts.groupBy(*keys).agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("s"))
        h = (F.log("pages") - F.col("s") / F.col("pages")) / F.log(F.greatest("pages", F.lit(2)))
        return total.select(*keys, F.col("pages").alias(f"{col}_pages"), h.alias(col))

    both = entropy("content").join(entropy("style"), keys)
    return both.select(*keys, F.col("content_pages").alias("pages"), (GAMMA * F.col("content") + (1 - GAMMA) * F.col("style")).alias("importance"))


def style_tree(parsed: DataFrame, prior: float = PRIOR) -> DataFrame:
    """host, path, content, pages, node, own: every content node of the hosts' style trees with the importance of its presentation node and its own.

    A presentation node's is that of :func:`importance`; a content node's is one less the entropy of its pages (k of the node's n give
    log k / log n).  Both are means, counted n - 1 times, with full importance, counted ``prior`` times: few pages prove little.
    """
    rows = parsed.select("host", "page", F.explode("blocks").alias("b")).select("host", "page", "b.*")
    site = importance(rows.select("host", "path", "style", F.col("whole").alias("content"), "page").distinct().drop("page"), ["host", "path"])
    own = rows.select("host", "path", "content", "page").distinct().groupBy("host", "path", "content").agg(F.count(F.lit(1)).alias("k"))
    believed = lambda x: (x * (F.col("pages") - 1) + prior) / (F.col("pages") - 1 + prior)
    rare = 1 - F.log("k") / F.log(F.greatest("pages", F.lit(2)))
    return own.join(site, ["host", "path"]).select("host", "path", "content", "pages", believed(F.col("importance")).alias("node"), believed(rare).alias("own"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", low: float = LOW, content_low: float = CONTENT_LOW, prior: float = PRIOR) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    All of each page's blocks are nodes of its host's style tree, merged over all the host's different pages (identical pages count once): a
    presentation node per path of block elements and classes, and below it a content node per text.  A block's importance is what
    its markup gives beforehand (0 inside elements that HTML or their class or id names mark as navigation, header, footer, sidebar, notice,
    advert, form or comments; else 1) times what the tree gives; a block goes if its presentation node's lies below ``low`` or its content node's
    below ``content_low`` (:func:`style_tree`).  So template text goes wherever it stands, articles included, from three pages of a node on (five for a text
    among others), and varied text goes only where markup speaks against it, as it does for comments and adverts.

    White space inside a block becomes one space, blocks are joined by one space, references are decoded.  Null or empty html gives the
    empty text; a null url counts as a host of its own, empty name.  Very long pages are taken whole.  Rows and ids may repeat or be null: a row is
    a page by itself; there are no ties; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "style")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = scratch.write(base.mapInArrow(trimmed(_parsed), f"page_id long, url string, host string, page long, blocks {BLOCKS}"), "parsed")
    noise = style_tree(parsed, prior).where((F.col("node") < low) | (F.col("own") < content_low)).select("host", "path", "content")
    noise = scratch.write(noise, "noise")
    held = parsed.select("host", "page", F.explode("blocks").alias("b")).where(F.col("b.prior") >= low).select("host", "page", "b.path", "b.content")
    mark = F.xxhash64("path", "content")
    drops = scratch.write(held.join(noise, ["host", "path", "content"]).groupBy("host", "page").agg(F.collect_set(mark).alias("drop")), "drops")
    kept = F.filter("blocks", lambda b: (b["prior"] >= low) & ~F.array_contains("drop", F.xxhash64(b["path"], b["content"])))
    out = parsed.join(drops, ["host", "page"], "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<bigint>")))
    out = out.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
