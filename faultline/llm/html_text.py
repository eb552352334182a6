"""Main text of web pages: what a host repeats on its pages is boilerplate.

The pages of a host are dealt by content to runs of bounded size. The token streams of a run are concatenated and put in suffix
order; neighbours in that order with a beginning of eight tokens in common, from distinct pages, are repeats, and the ranges of
equal beginnings say on how many pages of the run a repeat stands. A host of several runs also counts over all of them: each
run sends a number for each of its beginnings once, with its count of pages, and the numbers of a host meet. The numbers have a
few bits more than the host has tokens; so a repeat between runs is one of nine tokens, whose two beginnings in a row must
both be known. Tokens of articles count as well. Pages with the same main content are one page in that count.

What more than one page covers is repeated and goes, word by word; unique runs stay. Where the page itself says what a part is, that
is checked last: of a marked article only what nearly all pages of the host have goes (a share line, a list to read on), not a
passage that some other pages have too; and menus, headers, footers, sidebars, notices, adverts, forms, hidden parts and reader
comments go even if they occur once.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.llm.shared import stored
from faultline.llm.word_hash import long_words

#: Tokens of the shortest repeat; pages and characters of a run of a host; hosts of several runs that may be broadcast by name.
REPEAT, RUN_PAGES, RUN_CHARS, NAMED = 8, 512, 4 << 20, 100_000
#: Runs of a host whose numbers one task adds up; bits of a number beyond those of the host's tokens.
MEETING, SPARE_BITS = 16, 10
#: The number that counts the pages.
PAGES = 0
#: Within a marked article: the share of the host's distinct pages, and the least number of them, that make a repeat boilerplate.
USUAL_SHARE, USUAL_PAGES = 0.75, 4
#: Characters of blocks that travel as one packed text.
PACK_CHARS = 1 << 20
FACTORS = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Between the blocks of a page and within a block; white space to split(), so no text holds them.
BLOCK_END, FIELD_END = "\x1e", "\x1f"

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>", re.S)
#: A tag that ends at the first > outside quotes, and one that ends at the first >.
TAG = re.compile(r"""<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^"'>]|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"""<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>[^>]*+)>""")
TAG_START = re.compile(r"<[/!?a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
MAIN = re.compile(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody""", re.I)
#: Elements by what HTML says of them; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
UNSEEN = frozenset("script style noscript template".split())
DROPPED = frozenset("head nav footer aside form menu dialog select option button label fieldset legend datalist input svg canvas math object video audio map".split()) | RAW
CLOSED_BY_NEXT = {"p": "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul",
                  "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr tbody", "td": "td th tr", "th": "td th tr", "option": "option optgroup"}
CLOSED_BY_NEXT = {k: frozenset(v.split()) for k, v in CLOSED_BY_NEXT.items()}
#: Words in class, id or role that name a part which is not the article; fixed values.
PARTS = frozenset("""ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice
    notices alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer
    comment comments reply replies disqus respond share sharing social related recommended recommendations widget widgets toolbar pagination pager search login
    complementary contentinfo dialog toc skip skiplink hidden masthead topbar""".split())
#: Such words that mean a part of the page, but may stand within an article.
PAGE_PARTS = frozenset("header head top".split())


@dataclass
class Page:
    """blocks: (kind, element before it, text) in page order.

    kind: article, part (a menu, advert, comment and so on), open (the page says nothing about it), or doubt (an article that
    names itself a part, or stands in one: a comment, or the article of a page whose frame has an unlucky name).
    """

    blocks: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, kind: str, link: str, text: str) -> None:
        self.blocks.append((kind, link, text))

    def main_kind(self) -> str:
        """The kind of the blocks that hold the main text, by the page's own marks."""
        kinds = {kind for kind, _, _ in self.blocks}
        return next((marked for marked in ("article", "doubt") if marked in kinds), "open")

    def content(self) -> int:
        """A hash of all blocks that may be main text; pages of a host with the same one are copies of one page."""
        main = self.main_kind()
        return xxhash.xxh3_64_intdigest("\x1f".join(text for kind, _, text in self.blocks if kind == main).encode("utf-8", "replace")) - (1 << 63)

    def stream(self) -> bytes:
        """All its tokens: of each block the element before it, then its words."""
        return " ".join(f"{link} {text}" for _, link, text in self.blocks).encode("utf-8", "replace")

    def sizes(self) -> np.ndarray:
        """Tokens of each block."""
        return np.array([2 + text.count(" ") for _, _, text in self.blocks], np.int64)

    def packed(self) -> str:
        return BLOCK_END.join(FIELD_END.join(block) for block in self.blocks)

    @classmethod
    def unpacked(cls, text: str) -> Page:
        return cls([tuple(block.split(FIELD_END)) for block in text.split(BLOCK_END)] if text else [])


def _names_part(attributes: str, in_article: bool) -> bool:
    if not attributes.strip(" /"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id", "role"):
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & PARTS or not in_article and words & PAGE_PARTS:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


@dataclass
class Open:
    """An open element, with what holds for it and the elements around it."""

    tag: str
    kind: str
    parts: int
    articles: int
    marks: int
    blocks: int
    nearest_block: int


OUTSIDE = Open("", "open", 0, 0, 0, 0, -1)


class OpenElements:
    """The open elements of a page. Every question is answered without a walk over them."""

    def __init__(self):
        self.stack: list[Open] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> Open:
        return self.stack[-1] if self.stack else OUTSIDE

    def push(self, tag: str, part: bool, article: bool) -> None:
        below, is_block = self.top(), tag not in INLINE
        parts = below.parts + part
        kind = ("doubt" if parts else "article") if article else "part" if part else below.kind
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Open(tag, kind, parts, below.articles + article, below.marks + (part or article), below.blocks + is_block,
                               len(self.stack) if is_block else below.nearest_block))

    def cut(self, at: int) -> None:
        """Close the elements from ``at`` on."""
        while len(self.stack) > at:
            gone = self.stack.pop()
            if gone.tag:
                self.places[gone.tag].pop()

    def close(self, tag: str, flush) -> None:
        """An end tag: of an inline element around blocks only the name goes, any other element goes with all within."""
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        if tag in INLINE and self.top().blocks > self.stack[at].blocks:
            self.stack[at].tag = ""
            self.places[tag].pop()
            return
        if self.top().marks > (self.stack[at - 1].marks if at else 0):
            flush()
        self.cut(at)

    def next_closes(self, tag: str) -> None:
        """A start tag closes the nearest block if that cannot hold it."""
        at = self.top().nearest_block
        if at >= 0 and tag in CLOSED_BY_NEXT.get(self.stack[at].tag, ()):
            self.cut(at)


def parse(source: str) -> Page:
    """Blocks of the whole page, in time linear in its length; anything goes, as browsers take it: unclosed elements, stray ends,
    cut-off markup. After a quote that is never closed, tags end at the first > ."""
    page, at, parts, opened, tags = Page(), 0, [], OpenElements(), TAG
    links, last_end = ["<"], source.rfind(">")

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            page.add(opened.top().kind, links[0], text)

    def said(text: str) -> None:
        parts.append(html_lib.unescape(text) if "&" in text else text)

    while at < len(source):
        start = TAG_START.search(source, at)
        if not start or start.start() > last_end and not source.startswith("<!", start.start()):
            said(source[at:])
            break
        if start.start() > at:
            said(source[at:start.start()])
        at = start.start()
        if source[at + 1] in "!?":
            comment = COMMENT.match(source, at)
            if not comment:  # no > follows
                said(source[at:])
                break
            at = comment.end()
            if comment["cdata"] is not None:
                parts.append(comment["cdata"])
            continue
        found = tags.match(source, at)
        if not found and source[at + 1] != "/" or not found and source[at + 2:at + 3].isalpha():
            tags = LOOSE_TAG
            found = tags.match(source, at)
        if not found:  # an end tag without a name
            said(source[at:at + 2])
            at += 2
            continue
        at = found.end()
        tag = found["tag"].lower()
        if tag not in INLINE and tag not in UNSEEN:
            flush()
            links[0] = "<" + tag
        if found["close"]:
            opened.close(tag, flush)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        opened.next_closes(tag)
        attributes = found["attributes"]
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        inside = opened.top().articles > 0
        article = tag in ("article", "main")
        part = tag in DROPPED or tag == "header" and not inside
        if attributes and tag not in ("html", "body"):
            article = article or bool(MAIN.search(attributes))
            part = part or _names_part(attributes, inside)
        if part or article:
            flush()
        opened.push(tag, part, article)
    flush()
    return page


def suffix_order(tokens: np.ndarray, depth: int = REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): the suffixes of a token array sorted by their first ``depth`` tokens, by doubling; equal beginnings, equal rank.

    ``depth`` is a power of two. A suffix that is shorter sorts as if padded with a least token.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    width = 1
    while width < depth:
        behind = np.zeros(len(rank), np.uint64)
        behind[:-width or None] = rank[width:]
        rank = np.unique(rank << np.uint64(32) | behind, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        width *= 2
    return np.argsort(rank, kind="stable"), rank.astype(np.int64)


@dataclass
class Run:
    """The pages of one run of a host, concatenated: each token's hash, each page's place, and what it repeats.

    begins: for each token the beginning (rank) of its suffix, or -1 where that leaves the page; pages: of each beginning the number of distinct pages.
    """

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    begins: np.ndarray
    pages: np.ndarray
    n_pages: int

    @classmethod
    def of(cls, streams: list[bytes], contents: list[int], shortest: int = REPEAT) -> Run:
        words = [long_words(s) for s in streams]
        lengths = np.array([len(w) for w in words], np.int64)
        own = np.unique(np.array(contents, np.int64), return_inverse=True)[1] if contents else np.zeros(0, np.int64)
        # one token between pages; a beginning that reaches it is none
        hashes = np.concatenate([part for w in words for part in (w, np.zeros(1, np.uint64))]) if words else np.zeros(0, np.uint64)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        if not len(hashes):
            return cls(hashes, starts, ends, np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
        order, rank = suffix_order(hashes, shortest)
        page = np.repeat(np.arange(len(words)), lengths + 1)
        whole = np.arange(len(hashes)) + shortest <= np.repeat(ends, lengths + 1)
        kept = order[whole[order]]
        # within a range of equal beginnings, each content once
        pairs = np.unique(rank[kept] * (len(own) + 1) + own[page[kept]])
        pages = np.bincount(pairs // (len(own) + 1), minlength=int(rank.max()) + 1)
        return cls(hashes, starts, ends, np.where(whole, rank, -1), pages, len(np.unique(own)))

    def counts(self) -> np.ndarray:
        """At each token, the number of the run's distinct pages with its beginning; 0 where there is none."""
        return np.where(self.begins >= 0, self.pages[self.begins], 0) if len(self.begins) else np.zeros(0, np.int64)

    def numbers(self, bits: int, shortest: int = REPEAT) -> np.ndarray:
        """At each token the number of its beginning, from its tokens' hashes; 0 where there is none."""
        found, n = np.zeros(len(self.hashes), np.uint64), max(0, len(self.hashes) - shortest + 1)
        for k in range(shortest):
            found[:n] += self.hashes[k:n + k] * FACTORS[k]
        found = (found ^ (found >> np.uint64(31))) * FACTORS[-1]
        found = (found ^ (found >> np.uint64(29))) >> np.uint64(64 - bits)
        return np.where(self.begins >= 0, np.maximum(found, np.uint64(PAGES + 1)), np.uint64(PAGES))

    def summary(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted numbers, distinct pages of each), the number PAGES first with all of them."""
        has = self.begins >= 0
        _, first = np.unique(self.begins[has], return_index=True)
        keys, at = np.unique(self.numbers(bits)[has][first], return_inverse=True)
        pages = np.bincount(at, weights=self.pages[self.begins[has][first]], minlength=len(keys)).astype(np.int64)
        return np.concatenate([np.array([PAGES], np.uint64), keys]), np.concatenate([[self.n_pages], pages])


def cover(begins: np.ndarray, shortest: int = REPEAT) -> np.ndarray:
    """Which tokens lie in one of the beginnings that ``begins`` marks at their first token."""
    steps = np.zeros(len(begins) + shortest + 1, np.int64)
    at = np.flatnonzero(begins)
    steps[at] += 1
    steps[at + shortest] -= 1
    return np.cumsum(steps)[:len(begins)] > 0


def in_a_row(marks: np.ndarray) -> np.ndarray:
    """Marks that have another one beside them."""
    both = marks[1:] & marks[:-1]
    return np.concatenate([both, [False]]) | np.concatenate([[False], both]) if len(marks) else marks


def main_text(page: Page, covered: np.ndarray | None = None, usual: np.ndarray | None = None) -> str:
    """What is not boilerplate of the marked article, else of one in doubt, or of a page without any of the open blocks.

    Repeats come first: ``covered`` tokens are on other pages too, ``usual`` ones on nearly all. The mark of an article is the
    final check: it takes back what is covered but not usual.
    """
    main = page.main_kind()
    gone = covered if main == "open" else usual
    if gone is None or not gone.any():
        return " ".join(text for kind, _, text in page.blocks if kind == main)
    out, at = [], 0
    for (kind, _, text), size in zip(page.blocks, page.sizes().tolist(), strict=True):
        if kind == main:
            lost = gone[at + 1:at + size]
            if lost.any():
                text = " ".join(word for word, g in zip(text.split(" "), lost.tolist(), strict=True) if not g)
            if text:
                out.append(text)
        at += size
    return " ".join(out)


def run_texts(pages: list[Page], keys: np.ndarray | None = None, counts: np.ndarray | None = None, bits: int = 0) -> list[str]:
    """The main texts of the pages of one run; ``keys`` and ``counts``: numbers that several pages of the host have, if it has more runs."""
    run = Run.of([p.stream() for p in pages], [p.content() for p in pages])
    seen = run.counts()
    usual_from = max(USUAL_PAGES, USUAL_SHARE * run.n_pages)
    covered, usual = seen > 1, seen >= usual_from
    if keys is not None and len(keys):
        numbers = run.numbers(bits)
        at = np.minimum(np.searchsorted(keys, numbers), len(keys) - 1)
        host = np.where((keys[at] == numbers) & (numbers != PAGES), counts[at], 0)
        usual_from = max(USUAL_PAGES, USUAL_SHARE * (counts[0] if keys[0] == PAGES else 0))
        covered |= in_a_row(host > 1)
        usual = in_a_row(host >= usual_from)
    covered, usual = cover(covered), cover(usual)
    return [main_text(p, covered[a:b], usual[a:b]) for p, a, b in zip(pages, run.starts.tolist(), run.ends.tolist(), strict=True)]


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _planes(values: np.ndarray) -> np.ndarray:
    """Whole numbers byte by byte: all first bytes, all second ones and so on, which compresses well where many are small."""
    return values.view(np.uint8).reshape(len(values), -1).T.ravel()


def _packed_numbers(keys: np.ndarray, pages: np.ndarray) -> bytes:
    """Sorted keys as differences, and their numbers of pages."""
    return zstandard.compress(np.concatenate([_planes(np.diff(keys, prepend=np.uint64(0))), _planes(pages.astype(np.int64))]).tobytes(), 1)


def _unpacked_numbers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(2, 8, -1).transpose(0, 2, 1))
    return np.cumsum(both[0].view(np.uint64).ravel(), dtype=np.uint64), both[1].view(np.int64).ravel()


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def _parsed(page_id: pa.DataType):
    """Pages to packs of pages of one run: host, run, runs, bits, and the pages' ids, urls, contents and blocks.

    A task packs what it holds when that has reached PACK_CHARS, so text travels compressed and some megabytes are held at most.
    """
    columns = ["host", "run", "runs", "bits", "ids", "urls", "contents", "blocks"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(page_id), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        size = 0

        def done():
            rows = [(*key, *([r[i] for r in rows] for i in range(3)), zstandard.compress("\n".join(r[3] for r in rows).encode("utf-8", "surrogatepass"), 3)) for key, rows in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=columns)

        for row_id, url, host, runs, bits, html in _rows(batches, "page_id", "url", "host", "runs", "bits", "html"):
            page = parse(html)
            content, blocks = page.content(), page.packed()
            held.setdefault((host, content % runs, runs, bits), []).append((row_id, url, content, blocks))
            size += len(blocks) + 64
            if size > 16 * PACK_CHARS:
                yield done()
                held, size = {}, 0
        if held:
            yield done()

    return work


def _pages(blocks: bytes) -> list[Page]:
    return [Page.unpacked(text) for text in zstandard.decompress(blocks).decode("utf-8", "surrogatepass").split("\n")]


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs in order of host and run to (host, bucket, run, numbers), for hosts of several runs."""
    here, streams, contents = None, [], []

    def done():
        host, run, runs, bits = here
        keys, pages = Run.of(streams, contents).summary(bits)
        bucket = (keys >> np.uint64(1)) % np.uint64(-(-runs // MEETING))
        rows = [(host, b, run, _packed_numbers(keys[bucket == b], pages[bucket == b])) for b in np.unique(bucket).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["host", "bucket", "run", "numbers"])

    for host, run, runs, bits, own, blocks in _rows(batches, "host", "run", "runs", "bits", "contents", "blocks"):
        if runs < 2:
            continue
        if here is not None and here[:2] != (host, run):
            yield done()
            streams, contents = [], []
        here = (host, run, runs, bits)
        streams += [p.stream() for p in _pages(blocks)]
        contents += own
    if here is not None:
        yield done()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run those of its numbers that more than one page of the host has, with the host's count of pages."""
    here, held = None, []

    def done():
        keys, at = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
        pages = np.bincount(at, weights=np.concatenate([n for _, _, n in held])).astype(np.int64)
        rows, start = [], 0
        for run, own, _ in held:
            mine = at[start:start + len(own)]
            start += len(own)
            mine = mine[(pages[mine] > 1) | (keys[mine] == PAGES)]
            if len(mine):
                rows.append((here[0], run, _packed_numbers(keys[mine], pages[mine])))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["host", "run", "numbers"])

    for host, bucket, run, numbers in _rows(batches, "host", "bucket", "run", "numbers"):
        if here is not None and (host, bucket) != here:
            yield done()
            held = []
        here = (host, bucket)
        held.append((run, *_unpacked_numbers(numbers)))
    if here is not None:
        yield done()


def _texts(page_id: pa.DataType):
    def work(packs: pa.Table, shared: pa.Table) -> pa.Table:
        parts = [_unpacked_numbers(n) for n in shared.column("numbers").to_pylist()]
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)])
        order = np.argsort(keys, kind="stable")
        counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])[order]
        ids, urls, pages, bits = [], [], [], 0
        for own_ids, own_urls, bits, blocks in _rows(packs.to_batches(), "ids", "urls", "bits", "blocks"):
            ids += own_ids
            urls += own_urls
            pages += _pages(blocks)
        texts = run_texts(pages, keys[order], counts, bits)
        return pa.table([pa.array(ids, page_id), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return work


def extract(pages: DataFrame, run_pages: int = RUN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space becomes one space, blocks are joined by one. A null page is empty and has
    an empty text, as has a page without any. Rows without a url are one host. Null ids and repeated rows are pages like
    others; an empty table gives no rows. Pages of any length are read whole, in time linear in their length.

    Pages are dealt by host and content to runs of ``run_pages`` pages or RUN_CHARS characters, about; a run is the most that
    a task takes at once, whatever the size of its host. What a run repeats it knows itself; the numbers of a host's runs meet.
    """
    page_id = pages.schema["page_id"].dataType
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    runs = F.ceil(F.greatest(F.col("n") / run_pages, F.col("chars") / RUN_CHARS)).cast("int")
    bits = F.least(F.lit(56), SPARE_BITS + F.ceil(F.log2(F.col("chars") + 2))).cast("int")
    hosts = stored(named.groupBy("host").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("html")), F.lit(0)).alias("chars")), "hosts")
    large = hosts.select("host", runs.alias("runs"), bits.alias("bits")).where("runs > 1")
    # as texts are packed, their bytes don't tell the work: a task gets some two runs, however many there are
    total = hosts.agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).first()
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total["n"] or 0) // (2 * RUN_PAGES), (total["chars"] or 0) // (2 * RUN_CHARS))
    large = F.broadcast(large) if large.limit(NAMED + 1).count() <= NAMED else large
    sized = named.join(large, "host", "left").select("page_id", "url", "host", F.coalesce("runs", F.lit(1)).alias("runs"), F.coalesce("bits", F.lit(32)).alias("bits"), "html")
    id_type = page_id.simpleString()
    packs = sized.mapInArrow(_parsed(to_arrow_type(page_id)), f"host string, run int, runs int, bits int, ids array<{id_type}>, urls array<string>, contents array<long>, blocks binary")
    dealt = packs.repartition(tasks, "host", "run")
    numbers = dealt.sortWithinPartitions("host", "run").mapInArrow(_numbers, "host string, bucket int, run int, numbers binary")
    shared = numbers.repartition("host", "bucket").sortWithinPartitions("host", "bucket").mapInArrow(_meet, "host string, run int, numbers binary")
    return (dealt.groupBy("host", "run").cogroup(shared.groupBy("host", "run"))
            .applyInArrow(_texts(to_arrow_type(page_id)), f"page_id {id_type}, url string, text string, n_chars long"))
