"""Main text of web pages by templates deduced for each host.

The tokens of a page are its elements and its blocks of text, each in its place:
the path of block elements around it.  A step of a path is an element's name, the
words of its class and id that are not peculiar to single pages, and, where all
pages have the same number of such children there, its number among them; so
elements of one name tell their roles apart without telling classes.

1. Over the pages of one host every token has an occurrence vector: how often
   each page has it.  Tokens of equal vectors form an equivalence class.
2. Classes that most pages have are the host's template.  They nest: a token's
   place is made of tokens of its own class or of classes around it.  The tokens
   that a page has once, in order, part it into slots; text that is a token of the
   template has no weight.
3. Slots whose text is the same on all pages, or is mostly links, do not tell where
   the article is.  The article is the innermost single template element with most
   of the text of the other slots.
4. What stands in it is extracted.  Text there that recurs is the article's own,
   unless nearly all of several pages have it (FIXED, FIXED_PAGES): a notice.

Pages of one host that are equal byte for byte count as one.

Names and roles of elements only trim what varies inside the article: adverts,
comments, forms.  Pages without a template (of a host with one page, say), or
without its article, are judged by article and main elements and by names alone.

Vectors are never gathered: Spark sums a hash of (page, count) for each host and
token, so that a host may have any number of pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, types
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lyrebird.staging import staged, table

#: a class of the template is on this share of a host's pages
SUPPORT = 0.5
#: text within the article is the template's if it is on this share of a host's pages, and on so many
FIXED, FIXED_PAGES = 0.9, 8
#: paths rarer than this on a host are no template elements, words rarer no part of labels; their text counts for the elements around them
RARE = 0.05
#: the article holds this share of the text that may be content
COVER = 0.7
#: an article no deeper than this, in html and body, is the whole page
_OUTER = 2
#: templates of so many bytes are sent to all tasks; more are joined by host
BROADCAST_BYTES = 32 << 20

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img math mrow mi mo mn ms mtext mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe template svg object video audio canvas textarea title select".split())
_DROPPED = frozenset("head nav footer aside form menu button dialog fieldset datalist".split())
#: these hold parts of an article, not all of it
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote".split())
_PARAGRAPHS = frozenset("p blockquote pre".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOISE = re.compile(
    r"^(?:ads?|advert\w*|adbox|adsense|sponsor\w*|promo\w*|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footers?|masthead|topbar|toolbar"
    r"|cookies?|consent|gdpr|notices?|popups?|modals?|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related"
    r"|recommend\w*|comments?|commentlist|disqus|skip|pagination|pager)$"
)
#: these words tell of noise on containers, not on paragraphs, headings or lists
_MILD = re.compile(r"^(?:alerts?|search|side|respond|replies|reply|widgets?|copyright|legal|disclaimer|hidden)$")
#: in a word of several parts the last part is what the element is; these tell it as the first part too
_FIRST = re.compile(r"^(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footers?|cookies?|consent|gdpr|newsletter|comments?|disqus|pagination)$")
_LISTED = re.compile(r"^(?:related|social|share|sharing|recommended)[-_]+(?:\w*[-_]+)*(?:posts?|links?|buttons?|icons?|articles?|bars?|media|lists?|box|tools?|stories|items?)$")
_HEADS = re.compile(r"^(?:header|head|site-?header|page-?header)$")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)|^//([^/?#:]*)")


class Run:
    """A piece of text: its path, block number, whether it is linked, the path of its innermost noise element ("" if in none), and whether it is in an article."""

    __slots__ = ("path", "text", "block", "linked", "noise", "article")

    def __init__(self, path, text, block, linked, noise, article):
        self.path, self.text, self.block, self.linked, self.noise, self.article = path, text, block, linked, noise, article


def _is_noise(word: str, name: str) -> bool:
    """Whether a word of a class or an id says that the element is none of the article."""
    parts = re.split(r"[-_]+", word)
    if parts[0] in ("no", "has", "with", "without"):  # tells of another element
        return False
    if _NOISE.match(parts[-1]) or (len(parts) > 1 and _FIRST.match(parts[0])) or _LISTED.match(word):
        return True
    return bool(name not in _TEXT and (_MILD.match(word) or (_HEADS.match(word) and name != "article")))


@lru_cache(1 << 14)
def _label(name: str, attrs: str) -> tuple[list[str], bool, bool]:
    """Words of class and id, whether the element is noise, and whether it is a main one."""
    noise, main, words = name in _DROPPED, name in ("article", "main"), []
    for key, *values in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            words += re.split(r"[\s]+", value.strip())
        elif key == "role":
            noise = noise or value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form")
            main = main or value in ("main", "article")
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            noise = True
    if name not in ("html", "body"):
        noise = noise or any(_is_noise(w, name) for w in words)
    tidy = sorted({re.sub(r"\d+", "#", w).replace("/", "|") for w in words if w})
    return tidy, noise, main and not noise


class _Open:
    """An open element."""

    __slots__ = ("name", "path", "place", "inline", "linked", "noise", "article", "inner")

    def __init__(self, name, path, place, inline, linked, noise, article, inner):
        self.name, self.path, self.place, self.inline, self.linked, self.noise, self.article = name, path, place, inline, linked, noise, article
        self.inner = inner  # how many block children of each name the block element has


class Page:
    """runs of text; starts: (path, first block) of each element; inner: (place, children by name) of each element, for the numbering."""

    def __init__(self, page: str, words: frozenset[str] | None = None, split: frozenset[str] | None = frozenset()):
        """words: of class and id only these count, or all if None; split: numbered children, or all if None."""
        self.runs: list[Run] = []
        self.starts: list[tuple[str, int]] = []
        self.inner: list[tuple[str, dict[str, int]]] = []
        self.words: set[str] = set()
        self.articles = 0  # elements that are told to be the article, outermost ones
        self._read(page, words, split)

    def _read(self, page: str, words: frozenset[str] | None, split: frozenset[str] | None) -> None:
        stack = [_Open("", "", "", False, False, "", False, {})]
        self.inner.append(("", stack[0].inner))
        block = at = 0

        def text(piece: str) -> None:
            if piece:
                top = stack[-1]
                self.runs.append(Run(top.path, entities.unescape(piece) if "&" in piece else piece, block, top.linked, top.noise, top.article))

        while tag := _TAG.search(page, at):
            text(page[at : tag.start()])
            at = tag.end()
            close, name, attrs = tag.group(1, 2, 3) if tag.group(2) else tag.group(4, 5, 6)
            if not name:
                if tag.group().startswith("<![CDATA["):
                    text(tag.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            name = name.lower()
            inline = name in _INLINE
            if not inline:
                block += 1
            if close:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        del stack[depth:]
                        break
                    if inline and not stack[depth].inline:
                        break  # an inline end tag does not close blocks
                continue
            if name in _VOID:
                continue
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if not inline:
                own = _CLOSES.get(name, ())
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == "p" or stack[depth].name in own:
                        del stack[depth:]
                        break
                    if not stack[depth].inline:
                        break
            own_words, noise, main = _label(name, attrs)
            self.words.update(own_words)
            top = stack[-1]
            if name == "header":
                noise = noise or not top.article
            path, place, inner = top.path, top.place, top.inner
            if not inline:
                number = inner[name] = inner.get(name, 0) + 1
                step = f"{name}[{number}]" if split is None or f"{place}>{name}" in split else name
                place, inner = f"{place}/{step}", {}
                path = "/".join([path, ".".join([step, *[w for w in own_words if words is None or w in words][:4]])])
                self.starts.append((path, block))
                self.inner.append((place, inner))
            self.articles += main and not top.article and not noise
            at_noise = f"{path}/~" if noise and inline else path if noise else top.noise
            stack.append(_Open(name, path, place, inline, top.linked or name == "a", at_noise, top.article or main, inner))
        text(page[at:] if not re.match(r"<[a-zA-Z/!?]", page[at : at + 2]) else "")

    def blocks(self) -> list[list[Run]]:
        """The runs of each block with text, in order."""
        out: list[list[Run]] = []
        for run in self.runs:
            if out and out[-1][0].block == run.block:
                out[-1].append(run)
            else:
                out.append([run])
        return [b for b in out if any(not r.text.isspace() for r in b)]


def _joined(block: list[Run]) -> str:
    return " ".join("".join(r.text for r in block).split())


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return ((found.group(1) or found.group(2) or "") if found else "").lower()


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) >> 1


def _token(path: str, text: str) -> int:
    """A block of text as a token, not 0."""
    return _hash(f"{path}\x00{text}") or 1


# ---------------------------------------------------------------- numbers of children


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """url, html -> host, place, name and sums over pages.

    With a place: pages that have it (name ""), and pages where it has children of
    a name, and their least and greatest number.  Without: pages that have a word
    in a class or id; all pages for the word "".
    """
    for batch in batches:
        sums: dict[tuple, list] = {}

        def add(key: tuple, number: int = 0, sums=sums) -> None:
            row = sums.setdefault(key, [0, number, number])
            row[0], row[1], row[2] = row[0] + 1, min(row[1], number), max(row[2], number)

        for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
            host, read = host_of(url), Page(page or "", split=None)
            for place, inner in read.inner:
                add((host, place, ""))
                for name, number in inner.items():
                    add((host, place, name), number)
            for word in read.words | {""}:
                add((host, None, word))
        yield pa.record_batch({
            **{c: pa.array([k[i] for k in sums], pa.string()) for i, c in enumerate(("host", "place", "name"))},
            **{c: pa.array([v[i] for v in sums.values()], pa.int64()) for i, c in enumerate(("pages", "low", "high"))},
        })


def numbered_children(shapes: list[dict]) -> list[str]:
    """place>name of children that are numbered: all pages have as many of them there, and more than one.

    From the outside in: where children are not numbered, their places are one.
    """
    rows: dict[str, dict[str, tuple]] = {}
    for r in shapes:
        rows.setdefault(r["place"], {})[r["name"]] = r["pages"], r["low"], r["high"]
    found, line = [], [("", [""])]
    for place, same in line:
        pages = sum(rows[p].get("", (0,))[0] for p in same)
        for name in sorted({n for p in same for n in rows[p]} - {""}):
            having = [rows[p][name] for p in same if name in rows[p]]
            low, high = min(h[1] for h in having), max(h[2] for h in having)
            inner = [[f"{p}/{name}[{k}]" for p in same] for k in range(1, high + 1)]
            if low == high > 1 and sum(h[0] for h in having) == pages:
                found.append(f"{place}>{name}")
                steps = [(f"{place}/{name}[{k}]", own) for k, own in enumerate(inner, 1)]
            else:
                steps = [(f"{place}/{name}", [p for own in inner for p in own])]
            line += [(step, known) for step, own in steps if (known := [p for p in own if p in rows])]
    return found


def fixed(pages: int, of: int) -> bool:
    """Whether what recurs on so many of a host's distinct pages is certainly the template's."""
    return pages >= FIXED_PAGES and pages >= FIXED * of


def distinct_pages(pages: DataFrame) -> DataFrame:
    """_key, url and html of one of each group of pages of a host whose html is the same; a page crawled again adds nothing to a template."""
    keyed = pages.select("url", "html", _host("url").alias("_home"), F.xxhash64("html").alias("_key"))
    copies = staged(keyed.groupBy("_home", "_key").count().where("count > 1").drop("count"), "html-copies")
    if copies.isEmpty():
        return keyed.drop("_home")
    once = keyed.join(copies, ["_home", "_key"], "left_semi").dropDuplicates(["_home", "_key"])
    return keyed.join(copies, ["_home", "_key"], "left_anti").unionByName(once).drop("_home")


def _by_host(rows: DataFrame, columns: tuple[str, ...], decide: Callable, schema: str) -> DataFrame:
    """host, and what decide says of the rows of each host (dictionaries of columns, as few as RARE allows)."""
    fields = types.StructType.fromDDL(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decide(own) for own in batch["rows"].to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([batch["host"], *columns], ["host", *names])

    return rows.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("rows")).mapInArrow(run, f"host string, {schema}")


def host_labels(pages: DataFrame) -> DataFrame:
    """host, words, split, of: the words of classes and ids that are on RARE of a host's pages, and on two; the children that are numbered; the pages, if more than one."""
    sums = pages.select("url", "html").mapInArrow(_shapes, "host string, place string, name string, pages long, low long, high long")
    sums = sums.groupBy("host", "place", "name").agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"))
    sums = staged(sums.where("pages > 1"), "html-shapes")
    hosts = sums.where("place IS NULL AND name = ''").select("host", F.col("pages").alias("of"))
    often = sums.join(hosts, "host").where(F.col("pages") >= RARE * F.col("of"))
    words = often.where("place IS NULL AND name <> ''").groupBy("host").agg(F.sort_array(F.collect_set("name")).alias("words"))
    split = _by_host(often.where("place IS NOT NULL"), ("place", "name", "pages", "low", "high"), lambda rows: (numbered_children(rows),), "split array<string>")
    return staged(hosts.join(words, "host", "left").join(split, "host", "left"), "html-labels")


# ---------------------------------------------------------------- tokens and classes

#: columns of a host: words, split, of as above; single: elements of the template that a page has once; texts: tokens of text; cuts: those of them that a page has once; fixed: those that nearly all pages have
_LABELS = ("words", "split", "of")
_TEMPLATE = (*_LABELS, "single", "texts", "cuts", "fixed")
#: and main: the path of the article; dull: slots that are no content
_DECIDED = (*_TEMPLATE, "main", "dull")


def _known(batch: pa.RecordBatch, shared, columns: tuple[str, ...]) -> Iterator[dict]:
    """What is known of the host of each row, from a broadcast or from columns."""
    if shared is None:
        for values in zip(*[batch[c].to_pylist() for c in columns], strict=True):
            yield dict(zip(columns, values, strict=True))
    else:
        hosts = shared.value
        for url in batch["url"].to_pylist():
            yield hosts.get(host_of(url), {})


def _page(html: str | None, known: dict) -> Page:
    return Page(html or "", frozenset(known.get("words") or ()), frozenset(known.get("split") or ()))


def _tokens(shared=None):
    """_key, url, html -> host, path, text (0 for elements), a hash of the occurrence vector, pages and most times on a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            rows = zip(batch["_key"].to_pylist(), batch["url"].to_pylist(), batch["html"].to_pylist(), _known(batch, shared, _LABELS), strict=True)
            for key, url, html, known in rows:
                if (known.get("of") or 0) < 2:
                    continue
                page, host = _page(html, known), host_of(url)
                counts: dict[tuple, int] = {("", 0): 1}
                for path, _ in page.starts:
                    counts[path, 0] = counts.get((path, 0), 0) + 1
                for block in page.blocks():
                    token = block[0].path, _token(block[0].path, _joined(block))
                    counts[token] = counts.get(token, 0) + 1
                for (path, text), n in counts.items():
                    row = sums.setdefault((host, path, text), [0, 0, 0])
                    row[0] = (row[0] + _hash(f"{key}\x00{n}")) & ((1 << 62) - 1)
                    row[1] += 1
                    row[2] = max(row[2], n)
            yield pa.record_batch({
                "host": pa.array([k[0] for k in sums], pa.string()), "path": pa.array([k[1] for k in sums], pa.string()), "text": pa.array([k[2] for k in sums], pa.int64()),
                **{c: pa.array([v[i] for v in sums.values()], pa.int64()) for i, c in enumerate(("vector", "pages", "most"))},
            })

    return run


def template(tokens: list[dict]) -> tuple[list[str], list[int], list[int], list[int]]:
    """single, texts, cuts and fixed of one host's frequent tokens.

    Classes are taken from the outside in.  A class is valid if its elements
    stand in elements of valid classes or of its own; of texts it takes those that
    stand in elements of valid classes.
    """
    classes: dict[int, list[dict]] = {}
    for t in tokens:
        classes.setdefault(t["vector"], []).append(t)
    valid, single = {""}, []
    of_elements = [own for members in classes.values() if (own := [t for t in members if not t["text"]])]
    for own in sorted(of_elements, key=lambda own: min((t["path"].count("/"), t["path"]) for t in own)):
        paths = {t["path"] for t in own}
        if all(path.rpartition("/")[0] in valid | paths for path in paths):
            valid |= paths
            single += [t["path"] for t in own if t["most"] == 1 and t["path"]]
    texts = [t for members in classes.values() for t in members if t["text"] and t["path"] in valid]
    cuts = [t["text"] for t in texts if t["most"] == 1]
    always = [t["text"] for t in texts if fixed(t["pages"], t["of"])]
    texts = [t["text"] for t in texts]
    return sorted(single), sorted(texts), sorted(cuts), sorted(always)


def host_classes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with single, texts, cuts and fixed, for hosts of two pages or more."""
    dealt, shared = _for_pages(pages, labels, *_LABELS)
    sums = dealt.mapInArrow(_tokens(shared), "host string, path string, text long, vector long, pages long, most long")
    tokens = sums.groupBy("host", "path", "text").agg(
        F.expr("CAST(SUM(CAST(vector AS DECIMAL(38,0))) % 9223372036854775807 AS LONG)").alias("vector"), F.sum("pages").alias("pages"), F.max("most").alias("most")
    )
    often = tokens.where("pages > 1").join(labels.select("host", "of"), "host")
    often = often.where(F.col("pages") >= SUPPORT * F.col("of"))
    classes = _by_host(often, ("path", "text", "vector", "most", "pages", "of"), template, "single array<string>, texts array<long>, cuts array<long>, fixed array<long>")
    return staged(labels.join(classes, "host"), "html-classes")


# ---------------------------------------------------------------- slots


class Slots:
    """The blocks of a page but those that nearly all pages have, each with its slot, the innermost template element around it, and whether it is a token of the template."""

    def __init__(self, page: Page, known: dict):
        single, texts, cuts = frozenset(known["single"] or ()), frozenset(known["texts"] or ()), frozenset(known["cuts"] or ())
        always = frozenset(known["fixed"] or ())
        self.blocks: list[tuple[int, str, list[Run], bool]] = []
        last, at, around = "", 0, {"": ""}
        for block in page.blocks():
            path = block[0].path
            while at < len(page.starts) and page.starts[at][1] <= block[0].block:
                if page.starts[at][0] in single:
                    last = page.starts[at][0]
                at += 1
            common = bool(texts) and (token := _token(path, _joined(block))) in texts
            if common:
                last = str(token) if token in cuts else last
                if token in always:
                    continue
            if path not in around:
                up = path
                while up and up not in single:
                    up = up.rpartition("/")[0]
                around[path] = up
            self.blocks.append((_hash(f"{last}\x00{around[path]}"), around[path], block, common))


def _slots(shared=None):
    """url, html -> host, slot, the element around it, lengths of text outside and inside links, pages, least and greatest hash of a page's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            for url, html, known in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), _known(batch, shared, _TEMPLATE), strict=True):
                if not known.get("single"):
                    continue
                host, own = host_of(url), {}
                for slot, around, block, common in Slots(_page(html, known), known).blocks:
                    own.setdefault((host, slot, around), []).append((block, common))
                for key, blocks in own.items():
                    row = sums.setdefault(key, [0, 0, 0, (1 << 63) - 1, -1])
                    for run in (r for b, common in blocks for r in b if not common or r.linked):
                        row[run.linked] += len(run.text)
                    seen = _hash(" ".join(_joined(b) for b, _ in blocks))
                    row[2], row[3], row[4] = row[2] + 1, min(row[3], seen), max(row[4], seen)
            yield pa.record_batch({
                "host": pa.array([k[0] for k in sums], pa.string()), "slot": pa.array([k[1] for k in sums], pa.int64()), "around": pa.array([k[2] for k in sums], pa.string()),
                **{c: pa.array([v[i] for v in sums.values()], pa.int64()) for i, c in enumerate(("free", "linked", "pages", "low", "high"))},
            })

    return run


def article(slots: list[dict], single: Iterable[str], pages: int) -> tuple[str | None, list[int]]:
    """The path of the article and the slots that are no content, of one host's slots; None if no slot has content.

    Slots that are mostly links are none, and slots of one text on nearly all pages.
    Slots of one text on fewer pages are none only where no article stands out of
    the whole page, unless they are paragraphs.
    """
    name = lambda path: re.split(r"[.\[]", path.rpartition("/")[2])[0]
    dull, same, free = [], [], {}  # length of free text in elements
    for s in slots:
        title = re.fullmatch(r"h[1-6]", name(s["around"]))
        if s["pages"] >= max(2, SUPPORT * pages):
            constant, linked = s["low"] == s["high"], s["linked"] > s["free"] and not title
            if (linked and not constant) or (constant and (s["linked"] or fixed(s["pages"], pages))):
                dull.append(s["slot"])
            elif constant:
                same.append(s)
            if constant or linked:
                continue
        path = s["around"]
        while True:
            free[path] = free.get(path, 0) + s["free"]
            if not path:
                break
            path = path.rpartition("/")[0]
    if not free.get(""):
        return None, []
    places, best = set(single), ""
    for path in sorted(places, key=lambda p: (-p.count("/"), p)):
        if name(path) not in _TEXT and free.get(path, 0) >= COVER * free[""]:
            best = path
            break
    parts = best.split("/")  # a title may stand beside most of the text, in the same article
    for depth in range(len(parts) - 1, 0, -1):
        if name("/".join(parts[: depth + 1])) in ("article", "main") and "/".join(parts[: depth + 1]) in places:
            best = "/".join(parts[: depth + 1])
            break
    if best.count("/") <= _OUTER:
        dull += [s["slot"] for s in same if s["around"] != best and name(s["around"]) not in _PARAGRAPHS]
    return best, sorted(dull)


def host_templates(pages: DataFrame) -> DataFrame:
    """host and what is known of it, of each host with a template."""
    pages = distinct_pages(pages)
    classes = host_classes(pages, host_labels(pages))
    dealt, shared = _for_pages(pages, classes, *_TEMPLATE)
    sums = dealt.mapInArrow(_slots(shared), "host string, slot long, around string, free long, linked long, pages long, low long, high long")
    slots = sums.groupBy("host", "slot", "around").agg(*[F.sum(c).alias(c) for c in ("free", "linked", "pages")], F.min("low").alias("low"), F.max("high").alias("high"))
    often = slots.join(classes.select("host", "of", "single"), "host").where(F.col("pages") >= RARE * F.col("of"))
    columns = ("slot", "around", "free", "linked", "pages", "low", "high")
    found = _by_host(often, (*columns, "of", "single"), lambda rows: article(rows, rows[0]["single"], rows[0]["of"]), "main string, dull array<long>")
    found = found.where("main IS NOT NULL")
    return staged(classes.join(found, "host"), "html-templates")


# ---------------------------------------------------------------- extraction


def _alone(page: Page) -> list[list[Run]]:
    """The blocks of a page without a template, by article and main elements and by names."""
    own = [r for r in page.runs if not r.noise]
    within = [r for r in own if r.article]
    blocks: dict[int, list[Run]] = {}
    for run in within if any(r.text.strip() for r in within) else own:
        blocks.setdefault(run.block, []).append(run)
    return list(blocks.values())


def main_text(html: str, known: dict | None = None) -> tuple[str, bool]:
    """The blocks of the article of a page, and whether the template of its host, known, told them."""
    page, chosen = _page(html, known or {}), []
    if known and known.get("main") is not None:
        main, dull = known["main"], frozenset(known["dull"] or ())
        below = main + "/"
        for slot, _, block, _ in Slots(page, known).blocks:
            path = block[0].path
            if slot not in dull and (path == main or path.startswith(below)):
                chosen.append([r for r in block if not r.noise.startswith(below)])
        if main.count("/") <= _OUTER and any(r.article and r.text.strip() for b in chosen for r in b):
            chosen = [[r for r in b if r.article] for b in chosen]  # the template tells no more than the whole page
    texts, alone = [t for t in map(_joined, chosen) if t], [t for t in map(_joined, _alone(page)) if t]
    if page.articles == 1 and alone and not any(r.article for b in chosen for r in b) and sum(map(len, alone)) > sum(map(len, texts)):
        return " ".join(alone), False  # pages of one article tell the template nothing about it
    return (" ".join(texts), True) if texts else (" ".join(alone), False)


def _extract(kind: pa.DataType, shared=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html or "", known) for html, known in zip(batch["html"].to_pylist(), _known(batch, shared, _DECIDED), strict=True)]
            yield pa.record_batch({
                "page_id": batch["page_id"].cast(kind), "url": batch["url"], "text": pa.array([t for t, _ in found], pa.string()),
                "n_chars": pa.array([len(t) for t, _ in found], pa.int64()), "by_template": pa.array([b for _, b in found], pa.bool_()),
            })

    return run


def _host(url: str) -> Column:
    """host_of as a column."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _for_pages(pages: DataFrame, by_host: DataFrame, *columns: str) -> tuple[DataFrame, Broadcast | None]:
    """pages, and the columns of their hosts: broadcast, or joined to pages if large."""
    size = by_host.agg(F.sum(F.octet_length(F.to_json(F.struct("host", *columns))) + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages, pages.sparkSession.sparkContext.broadcast({r["host"]: {c: r[c] for c in columns} for r in by_host.collect()})
    joined = pages.withColumn("_host", _host("url")).join(by_host.select(F.col("host").alias("_host"), *columns), "_host", "left")
    return joined.drop("_host"), None


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, by_template of each row of pages, which has page_id, url and html.

    by_template says whether the host's template told the text.  Null or empty
    html has an empty text.  Pages without a host share one.  A host with a single
    page has no template; its page is judged alone.  Pages of equal html count once
    in their host's template and have equal texts, so repeated rows change no other
    page.  Texts of any length are kept whole; an empty table gives no rows.  Other
    columns are left alone.
    """
    kind = next(f for f in pages.schema.fields if f.name == "page_id").dataType
    schema = f"page_id {kind.simpleString()}, url string, text string, n_chars long, by_template boolean"
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    dealt, shared = _for_pages(pages, host_templates(pages), *_DECIDED)
    return dealt.mapInArrow(_extract(to_arrow_type(kind), shared), schema)


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
