"""Main text of web pages by site template removal.

Each page is parsed into elements; container elements, and paragraphs that stand in no article and in no container with the first heading, get a hash
of their subtree. Spark counts, per host and per section of a host (the first part of the path), on how many pages of
different lead (heading or title) each hash stands; containers that recur on many of them are the site's template, and
are deleted first, wherever they stand. Marks come second, for what a page alone shows: tags, roles and classes that
say that an element is no article, and main and article elements, inside which the article is if there are any. A class or id
is a mark only if all its words are marks or places (``sidebar-left``, not ``search-warrant``); a form is none if it holds an
article, a first heading or a long paragraph, as where a whole page stands in one. Paragraphs and headings of article elements, or
beside the first heading, are never deleted, so a passage that many articles share stays there.

Leads, not pages, are counted so that copies of one article do not make its parts look like a template.

Defined results: null html is the empty page, with the empty text; a page whose url is null or has no host is
extracted without a template; repeated rows are each answered; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm._common import BROADCAST_BYTES, prepare, saved, scratch, table, text_or_empty

#: A subtree is template if it stands on pages of at least so many different leads of a host or section…
MIN_LEADS = 3
#: … and on at least this share of that host's or section's leads.
MIN_SHARE = 0.1
#: Pages of a host are dealt over so many tasks when they meet their host's template.
SALT = 32

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption".split())
#: Elements that hold no text to show.
SILENT_TAGS = frozenset("head script style noscript template textarea iframe object svg canvas datalist title xmp noembed noframes".split())
#: Elements that are never part of an article.
DROP_TAGS = frozenset("head script style noscript template nav footer aside button select textarea input iframe object svg canvas dialog menu datalist title".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
#: Words of a class or id that mark no article; those of the second set count only outside the article element.
DROP_WORDS = frozenset("teaser teasers ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist respond disqus share sharing social related recommended newsletter subscribe subscription popup modal widget pagination pager login signup toolbar skip paywall copyright".split())
OUTER_WORDS = frozenset("header masthead topbar search hero".split())
#: Words that may stand beside those in a class or id; with any other word it is about something else, as in ``search-warrant``.
PLACE_WORDS = frozenset("a b c d x site main top bottom left right center upper lower first last primary secondary global local page inner outer box boxes block blocks section sections area areas region zone slot unit panel bar strip column col row list lists item items link links icon icons button buttons btn title heading head body text content contents text wrap holder group inline desktop mobile small medium large sticky fixed responsive post posts article articles story stories entry form forms field fields feed post tool tools list js is g google dfp facebook twitter print email mail follow us more most popular latest user primary utility mega drop down dropdown toggle trail message msg alert info banner note thread reply replies count".split())
#: A form with a paragraph of so many words is a page wrapped in a form.
FORM_WORDS = 40
#: A class with one of these says what a layout has or what a post is about, not what an element is.
LAYOUT_WORDS = frozenset("has with no without layout wrapper container page category tag type format status".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SCOPE = frozenset("table td th caption button object template html".split())

#: A tag without ``<`` in its attributes, as nearly all are; it cannot be searched beyond the next tag.
SIMPLE = re.compile(r"""</?([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
TAG_END = re.compile("[>\"']")
COMMENT_END = re.compile("--!?>")
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes that may mark an element; others are passed over with their values.
TELLING = frozenset("class id role hidden aria-hidden style".split())
WORDS = re.compile(r"[a-z]+|[0-9]+")
#: Classes and ids of article elements that are none.
COMMENT = re.compile(r"comments?(?:[-_]?\d+)?|teasers?|promo|sponsored|related|recommended")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _token_drops(token: str, tag: str, inside: bool, is_id: bool) -> bool:
    """Whether one class, or the id, says that the element is no article.

    Ids of headings, and of parts of an article, are slugs of their titles. So headings and text inside lines have no
    telling id, nor has a part of the article one with a word besides; a paragraph or inline element, and an id inside
    the article, must say nothing else than that.
    """
    words = [w for w in WORDS.findall(token) if not w.isdigit()]
    if not words or LAYOUT_WORDS.intersection(words):
        return False
    if tag in INLINE or tag in FLOW or (is_id and inside):
        return not (is_id and tag in FLOW | INLINE) and DROP_WORDS.issuperset(words)
    marks = DROP_WORDS if inside else DROP_WORDS | OUTER_WORDS
    return not marks.isdisjoint(words) and (marks | PLACE_WORDS).issuperset(words)


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    if tag in DROP_TAGS or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTR.findall(attrs):
        name = name.lower()
        if name not in TELLING:
            continue
        value = "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            return True
        if name == "role" and DROP_ROLES.intersection(value.split()):
            return True
        if name in ("class", "id") and tag not in HEADINGS:
            for token in value.split():
                if COMMENT.fullmatch(token) if tag == "article" else _token_drops(token, tag, inside, name == "id"):
                    return True
    return False


class _Node:
    """``index`` and ``form`` are the innermost container and form that are open, -1 for none; ``own`` says that the container is this element."""

    __slots__ = ("tag", "skip", "main", "hash", "index", "form", "own")

    def __init__(self, tag: str, skip: int, main: int, index: int, form: int, own: bool):
        self.tag, self.skip, self.main, self.index, self.form, self.own = tag, skip, main, index, form, own
        self.hash = blake2b(tag.encode(), digest_size=8)


#: What ``skip`` says: text of the page, text marked as no article, or no text at all.
SHOWN, MARKED, SILENT = 0, 1, 2


class Page:
    """Blocks and container hashes of one page, in time linear in its length."""

    def __init__(self, text: str):
        #: (text, main level, innermost container, marked, innermost form): level 2 in main, 1 in article, 0 elsewhere
        self.blocks: list[tuple[str, int, int, bool, int]] = []
        self.hashes: list[int] = []  # of containers, in the order in which they open
        self.around: list[int] = []  # the container around each
        self._lines: set[int] = set()  # those that are paragraphs and the like
        self._headed: set[int] = set()  # those with a first heading inside, -1 for the page outside all of them
        self.forms: list[int] = []  # the form around each
        self.whole: list[bool] = []  # forms that hold a page
        self.heading = self.title = ""
        self._part: list[str] = []
        self._stack = [_Node("", SHOWN, 0, -1, -1, False)]
        self._open_at: dict[str, list[int]] = {}  # depths of open elements by tag
        self._blocks_at: list[int] = []  # depths of those that are not inline
        self._scopes_at: list[int] = []
        self._parse(text)

    def _nearest(self, tags: frozenset[str] | set[str]) -> int:
        return max((at[-1] for t in tags if (at := self._open_at.get(t))), default=0)

    def _flush(self) -> None:
        if self._part:
            text = " ".join("".join(self._part).split())
            self._part.clear()
            top = self._stack[-1]
            if text:
                self.blocks.append((text, top.main, top.index, top.skip == MARKED, top.form))
                heading = bool(self._open_at.get("h1"))
                if top.form >= 0 and top.skip == SHOWN and (heading or (self._nearest(FLOW) and text.count(" ") + 1 >= FORM_WORDS)):
                    self._keep_form(top.form)
                if not self.heading and top.skip == SHOWN and heading:
                    self.heading = text

    def _keep_form(self, form: int) -> None:
        while form >= 0 and not self.whole[form]:
            self.whole[form] = True
            form = self.forms[form]

    def _push(self, node: _Node) -> None:
        self._open_at.setdefault(node.tag, []).append(len(self._stack))
        if node.tag not in INLINE:
            self._blocks_at.append(len(self._stack))
            if node.tag in SCOPE:
                self._scopes_at.append(len(self._stack))
        self._stack.append(node)

    def _pop(self) -> None:
        node = self._stack.pop()
        self._open_at[node.tag].pop()
        if node.tag not in INLINE:
            self._blocks_at.pop()
            if node.tag in SCOPE:
                self._scopes_at.pop()
        digest = node.hash.digest()
        if node.own:
            self.hashes[node.index] = int.from_bytes(digest, "little", signed=True)
        self._stack[-1].hash.update(digest)

    def _close_to(self, depth: int) -> None:
        self._flush()
        while len(self._stack) > depth:
            self._pop()

    def _open(self, tag: str, attrs: str) -> None:
        stack = self._stack
        if tag not in INLINE:
            self._flush()
            p = self._open_at.get("p")  # a block ends an open paragraph
            if p and not (self._scopes_at and self._scopes_at[-1] > p[-1]):
                self._close_to(p[-1])
            if tag in CLOSES:
                d = self._nearest(CLOSES[tag])
                if d and d > self._nearest(STOPS[tag]):
                    self._close_to(d)
        if tag in VOID:
            stack[-1].hash.update(tag.encode())
            if tag == "br":
                self._part.append(" ")
            return
        top = stack[-1]
        skip = top.skip if top.skip == SILENT else SHOWN if tag == "main" else MARKED if top.skip or _boilerplate(tag, attrs, top.main > 0) else SHOWN
        if tag in SILENT_TAGS or (tag in INLINE and skip == MARKED != top.skip):
            skip = SILENT
        if (skip == MARKED) != (top.skip == MARKED):
            self._flush()  # what is marked never shares a block with what is not
            top = stack[-1]
        main = 0 if skip else max(top.main, 2 if tag == "main" else 1 if tag == "article" else 0)
        form = top.form
        if tag == "form":
            self.forms.append(form)
            self.whole.append(False)
            form = len(self.forms) - 1
        elif main > top.main and form >= 0:
            self._keep_form(form)  # a form around an article
        index = top.index
        article = bool(top.main or self._open_at.get("article"))
        if tag == "h1" and skip == SHOWN and not article:
            at = index
            while at not in self._headed:
                self._headed.add(at)
                at = self.around[at] if at >= 0 else -1
                if at < 0:
                    break
        line = tag in FLOW and tag not in HEADINGS and not article
        container = tag not in INLINE and (tag not in FLOW or line) and tag not in ("html", "body", "main", "article")
        if container:
            self.hashes.append(0)
            self.around.append(index)
            index = len(self.hashes) - 1
            if line:
                self._lines.add(index)
        self._push(_Node(tag, skip, main, index, form, container))

    def _end(self, tag: str) -> None:
        at = self._open_at.get(tag)
        if not at:
            return
        d = at[-1]
        if tag in INLINE:
            if not self._blocks_at or d > self._blocks_at[-1]:
                while len(self._stack) > d:
                    self._pop()
        elif not self._scopes_at or d >= self._scopes_at[-1]:
            self._close_to(d)

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        top = self._stack[-1]
        top.hash.update(text.encode("utf-8", "surrogatepass"))
        if top.skip != SILENT:
            self._part.append(text)

    def _parse(self, text: str) -> None:
        """Tags end at the first ``>`` outside quotes. Once such an end is missing, quotes are taken for plain characters from there on, so that no part is searched again and again."""
        begin = scan = 0  # of text that is not shown yet; where to look for the next tag
        quoted, sections = True, True
        while (lt := text.find("<", scan)) >= 0:
            scan = lt + 1
            after = text[scan : scan + 1]
            data = m = None
            if after in ("!", "?"):
                if text.startswith("<!--", lt):
                    closed = COMMENT_END.search(text, lt + 4)
                    end = closed.end() if closed else len(text)
                else:
                    end = -1
                    if sections and text.startswith("<![CDATA[", lt):
                        end = text.find("]]>", lt + 9)
                        sections = end >= 0
                        data = text[lt + 9 : end] if sections else None
                        end = end + 3 if sections else -1
                    if end < 0:
                        end = text.find(">", scan) + 1
                        if not end:
                            break
            elif quoted and (m := SIMPLE.match(text, lt)):
                attrs, end = m[2], m.end()
            else:
                m = TAG.match(text, lt)
                if not m:
                    continue
                end = at = m.end()
                while quoted and (stop := TAG_END.search(text, at)):
                    if stop[0] == ">":
                        break
                    at = text.find(stop[0], stop.end()) + 1
                    if not at:
                        quoted = False
                else:
                    stop, quoted = None, False
                close = stop.start() if stop else text.find(">", end)
                if close < 0:
                    break
                attrs, end = text[m.end() : close], close + 1
            if lt > begin:
                self._text(text[begin:lt])
            begin = scan = end
            if data is not None:
                self._text(data.replace("&", "&amp;"))
            if m is None:
                continue
            tag = m[1].lower()
            if text[lt + 1] == "/":
                self._end(tag)
                continue
            self._open(tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, end)
                stop_ = shut.start() if shut else len(text)
                if tag == "title":
                    self.title = self.title or " ".join(entities.unescape(text[end:stop_]).split())
                self._stack[-1].hash.update(text[end:stop_].encode("utf-8", "surrogatepass"))
                begin = scan = stop_
        if begin < len(text):
            self._text(text[begin:])
        self._close_to(1)

    def _marked(self, block: tuple[str, int, int, bool, int]) -> bool:
        return block[3] or (block[4] >= 0 and not self.whole[block[4]])

    @property
    def subtrees(self) -> list[int | None]:
        """The hash of each container, null for a paragraph near the first heading: those of articles are never template, others recur as menus do."""
        near: list[bool] = []
        for around in self.around:
            near.append(around in self._headed or (around >= 0 and near[around]))
        return [None if i in self._lines and near[i] else h for i, h in enumerate(self.hashes)]

    @property
    def lead(self) -> int:
        text = self.heading or self.title or "\n".join(b[0] for b in self.blocks if not self._marked(b))
        return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def parts(self, template: set[int]) -> tuple[str, int, int]:
        """The main text, and how many blocks went as template and how many by marks."""
        gone: list[bool] = []
        for h, around in zip(self.subtrees, self.around, strict=True):
            gone.append((h is not None and h in template) or (around >= 0 and gone[around]))
        left = [b for b in self.blocks if b[2] < 0 or not gone[b[2]]]
        shown = [b for b in left if not self._marked(b)]
        level = max((b[1] for b in shown), default=0)
        kept = [b[0] for b in shown if b[1] >= level]
        return "\n".join(kept), len(self.blocks) - len(left), len(left) - len(kept)

    def main_text(self, template: set[int]) -> str:
        return self.parts(template)[0]


def host_of(url: str) -> Column:
    """The host of a url in lower case without user and port; the empty string if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def section_of(url: str) -> Column:
    """The first part of a url's path; the empty string if there is none."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_leads: int = MIN_LEADS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, section, hash): the subtrees that recur on the host's pages; section is null where they recur on those of the whole host.

    Every count is of distinct rows under a key that holds the hash or the lead, so a host with a third of all
    pages is counted by many tasks, and rare hashes are left out before a host's rows meet its number of leads.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Page(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p.lead for p in found], pa.int64()), pa.array([[*{h for h in p.subtrees if h is not None}] for p in found], pa.list_(pa.int64()))], names=["host", "section", "lead", "hashes"])

    own = pages.select(host_of(url).alias("host"), section_of(url).alias("section"), text_or_empty(html).alias("html")).filter("host != ''")
    own = own.mapInArrow(run, "host string, section string, lead long, hashes array<long>")
    # The null hash stands for the page itself: its count is the number of leads. The null section stands for the host.
    rows = saved(own.select("host", "section", "lead", F.explode(F.concat(F.array(F.lit(None).cast("long")), "hashes")).alias("hash")).distinct())  # read twice
    by_section = rows.groupBy("host", "section", "hash").agg(F.count("*").alias("n"))
    by_host = rows.select("host", "lead", "hash").distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = saved(by_section.unionByName(by_host.withColumn("section", F.lit(None).cast("string"))).filter(F.col("hash").isNull() | (F.col("n") >= min_leads)))
    leads = counts.filter("hash IS NULL").select("host", "section", F.col("n").alias("leads"))
    c, t = counts.filter("hash IS NOT NULL").alias("c"), leads.alias("t")
    met = c.join(t, (F.col("c.host") == F.col("t.host")) & F.col("c.section").eqNullSafe(F.col("t.section")))
    return met.filter(F.col("n") >= min_share * F.col("leads")).select("c.host", "c.section", "hash")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", salt: int = SALT) -> DataFrame:
    """(page_id, url, text, template_blocks, marked_blocks) of every page: its main text, and how many blocks of text went as template and how many by marks.

    The hashes that a page's host and section delete meet it as two arrays; each is short, as every one of its hashes
    stands on ``MIN_SHARE`` of the leads. They are broadcast if there are few by count, else pages meet them in shuffled joins, dealt over ``salt`` parts.
    """
    with scratch(prepare(pages.sparkSession)) as keep:
        found = saved(templates(pages, url, html))
        small = found.count() * 100 <= BROADCAST_BYTES // 4
        hosts = keep(found.filter("section IS NULL").groupBy("host").agg(F.collect_list("hash").alias("of_host")))
        sections = keep(found.filter("section IS NOT NULL").groupBy("host", "section").agg(F.collect_list("hash").alias("of_section")))
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    dealt = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_or_empty(html).alias("html"), host_of(url).alias("host"), section_of(url).alias("section"), F.pmod(F.xxhash64(page_id, url), F.lit(salt)).alias("salt"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [Page(t).parts({*(x or ()), *(y or ())}) for t, x, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True))], names=["page_id", "url", "text", "template_blocks", "marked_blocks"])

    if small:  # pages then stay where they are read
        met = dealt.join(F.broadcast(hosts), "host", "left").join(F.broadcast(sections), ["host", "section"], "left")
    else:
        met = dealt.join(hosts.withColumn("salt", every), ["host", "salt"], "left").join(sections.withColumn("salt", every), ["host", "section", "salt"], "left")
    return met.select("page_id", "url", "html", "of_host", "of_section").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, template_blocks long, marked_blocks long")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
