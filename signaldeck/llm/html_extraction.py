"""Main text of web pages by consensus container paths of their host.

Every page scores its containers: text outside of links and of known furniture counts for
each container around it, and the page votes for the outermost article or main element that
holds all of it, or else for the deepest container that does.
Votes go by generalised tag-class paths (``/html/body/div.post``, digits left out) and are
counted per host in Spark, where a hot host is combined before it meets.  The winning path
of each host is joined back and every page is extracted again from the containers on it;
a page without any, or with text that they leave out, uses the container it voted for itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from signaldeck.llm.common import narrow, raw_texts, tables, tidied

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title|object|canvas|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>",
    re.S | re.I,
)
#: One attribute; a value belongs to its name, and a quote that is left open ends with the tag.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
_READ = frozenset("class id role hidden aria-hidden style".split())
#: Parts of a style that hold no declarations of their own.
_QUOTED = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*\"|'[^']*'|\([^)]*\)", re.S)
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]*)[^;!]*(!\s*important)?")
_WORD = re.compile(r"[a-z]+")

CONTAINERS = frozenset(
    "html head body div section article main aside nav header footer form table tbody thead tfoot tr td th ul ol dl li dd dt "
    "figure figcaption blockquote details dialog center fieldset menu".split()
)
#: Tags that end the block before them; inline tags do not.
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr address summary legend option caption".split())
#: Elements that may hold an article and be voted for.
HOLDERS = frozenset("body div section article main td center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FURNITURE_TAGS = frozenset("head nav footer aside form menu dialog button".split())
_FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert menu nav navbar navigation breadcrumb breadcrumbs sidebar aside rail footer header masthead topbar toolbar comment comments "
    "respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login popup "
    "modal overlay widget widgets pagination pager search form tags".split()
)
#: Words that may as well be the topic of a section: its own text decides within an article.
_TOPIC_WORDS = frozenset(
    "related recommended recommendations discussion alert search menu navigation header footer banner form tags social share sharing "
    "toolbar widget widgets overlay rail promotion subscription".split()
)
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CONTENT_WORDS = frozenset("article content main post entry story text body page wrapper wrap container layout with has no".split())
#: Elements named by these hold an article, as article and main do.
_ARTICLE_WORDS = frozenset("article post entry story".split())

Block = tuple[tuple[str, ...], bool, bool, str]


def _attributes(rest: str) -> dict[str, str]:
    """Values of the attributes that are read, lower case; the first of a name counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name = name.lower()
        if name in _READ:
            found.setdefault(name, (a or b or c).lower())
    return found


def _undisplayed(style: str) -> bool:
    """Whether the declaration that holds, the last one or the last important one, is display:none."""
    if "display" not in style:
        return False
    declared = _DISPLAY.findall(_QUOTED.sub("", style))
    held = [value for value, important in declared if important] or [value for value, _ in declared]
    return bool(held) and held[-1] == "none"


def _names(tag: str, rest: str) -> tuple[str, bool, bool, bool]:
    """Generalised name of an element; whether it is page furniture, whether its text may overrule that, and whether it holds an article."""
    attributes = _attributes(rest) if rest else {}
    named, own = _WORD.findall(attributes.get("class", "")), _WORD.findall(attributes.get("id", ""))
    words, first = named + own, named or own
    whole = tag in ("body", "html", "main", "article")
    junk = tag in _FURNITURE_TAGS or attributes.get("role") in _FURNITURE_ROLES
    junk = junk or "hidden" in attributes or attributes.get("aria-hidden") == "true"
    # A body without display waits for its scripts.
    junk = junk or (tag not in ("body", "html") and _undisplayed(attributes.get("style", "")))
    topic = False
    if not junk and words and not whole:
        junk = not _FURNITURE_WORDS.isdisjoint(words) and _CONTENT_WORDS.isdisjoint(words)
        topic = junk and _TOPIC_WORDS.issuperset(_FURNITURE_WORDS.intersection(named)) and tag in ("section", "div") and {"respond", "disqus"}.isdisjoint(own)
        if not {"comment", "comments"}.isdisjoint(words):
            junk, topic = True, False
    article = tag in ("article", "main") or (not whole and not _ARTICLE_WORDS.isdisjoint(words))
    return (f"{tag}.{'-'.join(first)}" if first else tag), junk, topic, article


def blocks_of(page: str) -> tuple[list[Block], dict[tuple[str, ...], bool]]:
    """(path, is furniture, is in a link, text) of each block, and the holders' paths.

    A section or div within an article whose id, or whose class by a word that may be a topic, sounds
    like furniture (discussion, related, search) is one of its sections if most of its text is outside
    of links and, for a div other than an alert, it begins with a heading.  Where a page has no other
    text, it is one in any case.
    """
    stack: list[tuple[str, tuple[str, ...], bool, bool, tuple[int, ...], bool]] = []
    asked: tuple[int, ...] = ()
    doubtful: list[tuple[int, tuple[int, ...]]] = []
    prose: list[int] = []  # of each element in doubt: text outside of links, less that in links
    titled: list[bool | None] = []
    holders: dict[tuple[str, ...], bool] = {(): False}  # a page may do without a body
    out: list[Block] = []
    held: list[str] = []
    path: tuple[str, ...] = ()
    junk = header = heading = False
    link = linked = plain = 0
    at = 0

    def close() -> None:
        nonlocal linked, plain
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((path, junk or (header and not heading), linked > plain, text))
                if asked and not out[-1][1]:
                    doubtful.append((len(out) - 1, asked))
                    for i in asked:
                        prose[i] += -len(text) if linked > plain else len(text)
                        titled[i] = heading if titled[i] is None else titled[i]
            held.clear()
        linked = plain = 0

    def add(text: str) -> None:
        nonlocal linked, plain
        if text:
            held.append(text)
            if link:
                linked += len(text)
            else:
                plain += len(text)

    for m in _MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["name"]
        if tag is None:
            if m["data"]:
                add(html.escape(m["data"]))
            elif m["raw"] and m["raw"].lower() == "title":
                close()
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if m["end"] else 1
        if tag == "br":
            add(" ")
        if tag not in BLOCKS:
            if tag == "button":
                close()
                junk = not m["end"] or bool(stack and stack[-1][2])
            continue
        close()
        if tag in _HEADINGS:
            heading = not m["end"]
            continue
        if tag not in CONTAINERS:
            continue
        heading = False
        link = 0
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
        else:
            if tag in ("li", "td", "th", "tr", "dd", "dt"):
                # These end their open sibling.
                stop = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("ul", "ol", "dl", "table", "menu")), -1)
                depth = next((i for i in range(stop + 1, len(stack)) if stack[i][0] == tag), None)
                if depth is not None:
                    del stack[depth:]
            elif tag == "body":
                # A body ends what the head left open.
                del stack[next((i for i, s in enumerate(stack) if s[0] == "head"), len(stack)) :]
            name, own, topic, article = _names(tag, m["rest"])
            above = stack[-1] if stack else ("", (), False, False, (), False)
            inside = any(s[0] in ("article", "main") for s in stack)
            topic = topic and above[5]
            furniture = above[2] or (own and not topic) or (tag == "header" and not inside)
            if not (m["rest"] or "").endswith("/"):
                within = above[4]
                if topic and not furniture:
                    within = (*within, len(prose))
                    prose.append(0)
                    titled.append(True if tag == "section" or ".alert" in name else None)
                stack.append((tag, (*above[1], name), furniture, above[3] or (tag == "header" and inside), within, above[5] or article))
                if tag in HOLDERS and not furniture and not within:
                    holders[stack[-1][1]] = tag in ("article", "main")
        path, junk, header, asked = stack[-1][1:5] if stack else ((), False, False, ())
    add(page[at:])
    close()
    asides = {k for k, _ in doubtful}
    if not any(not (junk or link_only) for k, (_, junk, link_only, _) in enumerate(out) if k not in asides):
        doubtful = []
    for k, within in doubtful:
        if any(prose[i] <= 0 or not titled[i] for i in within):
            at_path, _, link_only, text = out[k]
            out[k] = (at_path, True, link_only, text)
    return out, holders


def weights(blocks: list[Block], holders: dict[tuple[str, ...], bool]) -> dict[tuple[str, ...], int]:
    """Length of the article-like text in each holder; text without a letter or digit does not count."""
    own: dict[tuple[str, ...], int] = {}
    for path, junk, link, text in blocks:
        if not junk and not link and any(map(str.isalnum, text)):
            for depth in range(len(path) + 1):
                if path[:depth] in holders:
                    own[path[:depth]] = own.get(path[:depth], 0) + len(text)
    return own


def _enough(path: tuple[str, ...], own: dict[tuple[str, ...], int]) -> bool:
    """Whether the holder has all of the page's article-like text."""
    return own.get(path, 0) >= max(own.values(), default=0)


def vote(blocks: list[Block], holders: dict[tuple[str, ...], bool]) -> tuple[str, int]:
    """Path of the holder that stands for the page's article-like text, and the length of its text."""
    own = weights(blocks, holders)
    if not own:
        return "", 0
    enough = [p for p in own if _enough(p, own)]
    # What a container leaves out is lost, so that it must hold all.  Nothing below an article or main element stands for it.
    marked = [p for p in enough if holders[p]]
    best = min(marked, key=len) if marked else max(enough, key=len)
    return "/" + "/".join(best), own[best]


def container_of(blocks: list[Block], holders: dict[tuple[str, ...], bool], winner: str | None) -> str:
    """The host's path where the page has it and it leaves nothing out, else the page's own vote."""
    if winner is not None and steps(winner) in holders and _enough(steps(winner), weights(blocks, holders)):
        return winner
    return vote(blocks, holders)[0]


def steps(path: str) -> tuple[str, ...]:
    return tuple(x for x in path.split("/") if x)


def text_on(blocks: list[Block], path: str) -> list[str]:
    prefix = steps(path)
    return [text for at, junk, _, text in blocks if not junk and at[: len(prefix)] == prefix]


def host_of(url) -> F.Column:
    """Host of a URL, lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Id, url, text and the container path used of every page.

    A null or empty page has the empty text, as has a page of furniture alone.  Pages
    without a host, or with a null url, vote together.  Repeated rows vote as often as they
    occur and give equal texts.  An empty table gives no rows.  Pages of any length are
    read whole.  Other columns are ignored, whatever their names.
    """
    source = narrow(pages, id_column, url_column, html_column).toDF("page_id", "url", "html")
    source = source.withColumn("host", host_of(F.col("url")))

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [vote(*blocks_of(page.decode())) for page in raw_texts(batch.column("html"))]
            columns = [batch.column("host"), pa.array([v for v, _ in votes], pa.string()), pa.array([n for _, n in votes], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "chars"])

    votes = source.select("host", "html").mapInArrow(tidied(cast), "host string, path string, chars bigint").where("path != ''")
    votes = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    winners = votes.groupBy(F.col("host").alias("of_host")).agg(F.max_by("path", F.struct("n", "chars", "path")).alias("path"))
    # Written first, a row per host, so that Spark knows its size; where it is broadcast, pages stay where they are.
    winners = tables(pages.sparkSession).save(winners)
    joined = source.join(winners, F.col("host") == F.col("of_host"), "left").select("page_id", "url", "html", "path")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used = [], []
            for page, path in zip(raw_texts(batch.column("html")), batch.column("path").to_pylist(), strict=True):
                blocks, holders = blocks_of(page.decode())
                path = container_of(blocks, holders, path)
                texts.append("\n\n".join(text_on(blocks, path)) if path else "")
                used.append(path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(used, pa.string())],
                names=["page_id", "url", "text", "path"],
            )

    kinds = {"page_id": source.schema["page_id"].dataType, "url": StringType(), "text": StringType(), "path": StringType()}
    return joined.mapInArrow(tidied(again), StructType([StructField(c, k) for c, k in kinds.items()]))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


