"""Main text of web pages, with site templates removed by recurring subtrees.

Every block element is hashed over its tags and texts, from prefix sums of their
hashes, so that markup of any depth costs one pass. Spark counts, per host, on
how many different contents a subtree occurs (copies of one page count once);
subtrees on MIN_CONTENTS of them are template and are deleted from that host's
pages before the article is chosen. Inside an article or main part a subtree must
also be on INSIDE_SHARE of the host's contents, so passages that some articles
share stay there. What is left loses elements that are no article by their tag,
role, class or id. If the page marks its main part, only that is read, or of it
only the articles if they hold most of its text; without one its articles are
read, else the page. Character references are decoded, white space inside a block
becomes one space, and blocks are joined by line feeds in page order.

What a block is counts before its name. Articles that stand side by side in one
place with one class, beside another article that is longer than each of them, are
comments or teasers. Articles that hold less than a third of the page's text are
teasers if one element holds twice as much in its own paragraphs. Where no article is
marked, a block of links is a menu unless it is a sentence with words of its own.

Names count only as a whole: each part of a class or id must be a name of what is
no article or a neutral word. Elements that hold an article or main part are never
dropped by name, nor are those with nearly all text of a page that marks neither.
An article is dropped by name only inside another article (a comment). Inside an
article or main part, names that may also stand for parts of it (WEAK) count only
for blocks of links or, of some of them (UNLESS_PROSE), for what is no sentence. A form is dropped likewise, unless it holds most of the text.

Pages are parsed twice: for the hashes, which are written as a table, and for the
text. They travel once, compressed, to meet the list of their own template
subtrees; no task needs the templates of a whole host.

Defined cases: null or empty html gives the empty text; markup that never ends
ends with the page; very long pages are read whole; repeated rows repeat; a null
id or url does no harm (a null url counts as the host ''); an empty table yields
no rows; columns other than id, url and html are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenveil.llm.textframe import compressed, decompressor, emit
from lumenveil.session import discard, materialize

#: Different contents of a host on which a subtree makes it a template.
MIN_CONTENTS = 5
#: Share of a host's contents on which a subtree inside an article or main part must be besides.
INSIDE_SHARE = 0.5
#: An element with a larger share of the text of a page without article and main part is not dropped by name.
MOST = 0.8
#: A block without an article around it is a menu from this share of link text on.
LINK_SHARE = 0.6

# Names of elements and of what is no article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
DROPPED = set(
    "head script style noscript template svg math iframe object embed canvas audio video nav footer aside button select "
    "option textarea input dialog menu xmp noembed noframes map".split()
)
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NAMES = set(
    "ad ads adv adbox adslot banner nav navbar navigation menu crumbs sidebar footer cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond reply replies "
    "discussion share sharing social related recommended pagination pager widget toolbar promo promotion sponsor sponsored".split()
)
WEAK = set("discussion notice notices alert overlay modal popup widget banner toolbar promotion social related recommended".split())
PREFIXES = ("advert", "adsby", "adsense", "cookie", "comment", "sidebar", "sponsor", "newsletter", "breadcrumb", "promo", "disqus", "navbar")
UNLESS_PROSE = set("social related recommended".split())
NEUTRAL = set(
    "site page main global top bottom left right inner outer primary secondary box wrap wrapper container block section area zone bar list "
    "link links item items button buttons icon icons form post posts article articles entry body header title text media "
    "user users reader readers slot slots sticky fixed new old all my"
    .split()
)
OUTSIDE_ONLY = set("header masthead topbar".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = set("html body table ul ol dl div section article main aside nav header footer form blockquote td th fieldset figure details".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_NOTHING, _P = frozenset(), frozenset({"p"})
_GATES = SCOPES.union(_P, *CLOSED_BY.values())
#: Of the polynomial that hashes a range of tokens.
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


class Page:
    """The elements and texts of a page in source order.

    elements: [tag, parent, first token, end token, kind]; kind is "drop" for what is
    never an article, "outside" for what is dropped unless inside one, "article" or
    "main".
    tokens: the tags and texts of the source, white space made one space.
    holds: whether an element contains an article or main part, or is one.
    texts: (element, text, is a link's); None as text is a block boundary.
    """

    def __init__(self, source: str) -> None:
        self.elements: list[list] = [["", -1, 0, 0, ""]]
        self.texts: list[tuple[int, str | None, bool]] = []
        self.tokens: list[str] = []
        elements, texts, tokens = self.elements, self.texts, self.tokens
        stack, gates, opened, links, at = [0], [], Counter(), 0, 0  # gates: places in the stack of what closes or bounds closing

        def close(depth: int, end: int) -> None:
            nonlocal links
            for k in reversed(stack[depth:]):
                tag = elements[k][0]
                elements[k][3] = end
                opened[tag] -= 1
                links -= tag == "a"
            if any(elements[k][0] in BLOCK for k in stack[depth:]):
                texts.append((stack[depth - 1], None, False))
            del stack[depth:]
            while gates and gates[-1] >= depth:
                gates.pop()

        while at < len(source):
            token = _TOKEN.search(source, at)
            upto = token.start() if token else len(source)
            if upto > at:
                text = source[at:upto]
                texts.append((stack[-1], references.unescape(text), links > 0))
                if not text.isspace():
                    tokens.append(" ".join(text.split()))
            if not token:
                break
            at = token.end()
            tag = (token["tag"] or token["tag2"] or "").lower()
            if not tag:
                continue
            if token["end"] or token["end2"]:
                if opened[tag]:
                    depth = len(stack) - 1
                    while elements[stack[depth]][0] != tag:
                        depth -= 1
                    if depth + 1 < len(stack):
                        close(depth + 1, len(tokens))
                    tokens.append("/" + tag)
                    close(depth, len(tokens))
                continue
            closes = CLOSED_BY.get(tag, _NOTHING) | _P if tag in BLOCK else CLOSED_BY.get(tag, _NOTHING)
            while closes:  # elements that this one ends, up to what bounds them
                for depth in reversed(gates):
                    name = elements[stack[depth]][0]
                    if name in closes or name in SCOPES:
                        break
                else:
                    break
                if name not in closes:
                    break
                close(depth, len(tokens))
            attrs = token["attrs"] or token["attrs2"] or ""
            if tag in BLOCK:
                texts.append((stack[-1], None, False))
            elif tag in ("br", "td", "th"):
                texts.append((stack[-1], " ", False))
            elements.append([tag, stack[-1], len(tokens), len(tokens) + 1, _kind(tag, attrs)])
            tokens.append(f"<{tag} {' '.join(attrs.split())}" if attrs else f"<{tag} ")
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                end = found.start() if found else len(source)
                tokens.append(" ".join(source[at:end].split()))
                at = source.find(">", end) + 1 or len(source)
                elements[-1][3] = len(tokens)
                continue
            if tag in _GATES:
                gates.append(len(stack))
            stack.append(len(elements) - 1)
            opened[tag] += 1
            links += tag == "a"
        for k in stack:
            elements[k][3] = len(tokens)

        self._settle()

    def _settle(self) -> None:
        """Decides on elements with names of what is no article by what they hold."""
        n = len(self.elements)
        dropped, size, linked, self.holds, main = [False] * n, [0] * n, [0] * n, [False] * n, [False] * n
        prose = [False] * n  # whether a text below is a sentence
        self.inner = [False] * n  # whether anything below holds an article or main part
        for element, text, link in self.texts:
            length = len(text.strip()) if text else 0
            size[element] += length
            linked[element] += length * link
            prose[element] |= length > 0 and not link and _is_sentence(text)
        self.size = size
        for k, (_, parent, _, _, kind) in enumerate(self.elements):
            dropped[k] = kind == "drop" or (parent >= 0 and dropped[parent])
        for k in range(n - 1, -1, -1):
            _, parent, _, _, kind = self.elements[k]
            if dropped[k]:
                continue
            if kind == "article" and main[k]:
                self.elements[k][4] = kind = "main"  # an article around the main part is read whole
            self.inner[k] = self.holds[k]
            self.holds[k] = self.holds[k] or kind in ("article", "main")
            main[k] = main[k] or kind == "main"
            if parent >= 0:
                self.holds[parent], main[parent] = self.holds[parent] or self.holds[k], main[parent] or main[k]
                size[parent] += size[k]
                linked[parent] += linked[k]
                prose[parent] |= prose[k]
        around = [-1] * n  # the nearest article or main part around an element
        for k, (_, parent, _, _, kind) in enumerate(self.elements):
            if parent >= 0:
                around[k] = parent if self.elements[parent][4] in ("article", "main", "named article") else around[parent]
            inside = around[k] >= 0
            most = not self.holds[0] and size[k] > MOST * size[0]
            if kind == "form":
                self.elements[k][4] = "" if self.holds[k] or most or (inside and 2 * size[k] > size[around[k]]) else "drop"
            elif kind == "named" or (kind in ("weak", "unless prose") and (not inside or linked[k] >= LINK_SHARE * max(1, size[k]) or (kind == "unless prose" and not prose[k]))):
                self.elements[k][4] = "" if self.holds[k] or most else "drop"
            elif kind in ("weak", "unless prose"):
                self.elements[k][4] = ""
            elif kind == "named article":
                alone = not self.holds[0] and 2 * size[k] >= size[0]
                self.elements[k][4] = "" if self.holds[k] else "drop" if inside else "article" if alone else ""
            elif kind == "outside" and self.holds[k]:
                self.elements[k][4] = ""
        self._drop_rows()

    def _drop_rows(self) -> None:
        """Drops articles in a row of one shape beside a longer article of another: comments or teasers."""
        rows: dict[tuple, list[int]] = {}
        inside = [False] * len(self.elements)
        for k, (_, parent, first, _, kind) in enumerate(self.elements):
            if parent >= 0:
                inside[k] = inside[parent] or self.elements[parent][4] in ("article", "main", "drop")
            if kind == "article" and not inside[k]:
                rows.setdefault((parent, self.tokens[first]), []).append(k)
        longest = max((k for some in rows.values() for k in some), key=lambda k: self.size[k], default=-1)
        for some in rows.values():
            if len(some) > 1 and longest not in some and all(self.size[k] < self.size[longest] for k in some):
                for k in some:
                    self.elements[k][4] = "drop"

    def subtrees(self) -> list[tuple[int, int]]:
        """(element, hash) of block elements that hold no article or main part.

        Hashes are odd inside an article or main part and for an article, else even.
        """
        import xxhash

        digest = xxhash.xxh64_intdigest
        sums, powers = [0], [1]
        for token in self.tokens:
            sums.append((sums[-1] * _BASE + digest(token)) % _PRIME)
            powers.append(powers[-1] * _BASE % _PRIME)
        inside = [False] * len(self.elements)
        out = []
        for k, (tag, parent, first, end, kind) in enumerate(self.elements):
            inside[k] = kind in ("article", "main") or (parent >= 0 and inside[parent])
            whole = not self.holds[k] or (kind == "article" and not self.inner[k])
            if tag in BLOCK and tag not in ("html", "body") and whole:
                found = (sums[end] - sums[first] * powers[end - first]) % _PRIME
                out.append((k, _signed(found, len(tag) + end - first) & ~1 | inside[k]))
        return out

    def text(self, templates: set[int] = frozenset()) -> str:
        """The main text; templates: elements to leave out."""
        n = len(self.elements)
        gone, article, main = [False] * n, [False] * n, [False] * n
        for k, (_, parent, _, _, kind) in enumerate(self.elements):
            if parent >= 0:
                gone[k], article[k], main[k] = gone[parent], article[parent], main[parent]
            article[k], main[k] = article[k] or kind == "article", main[k] or kind == "main"
            gone[k] = gone[k] or k in templates or kind == "drop" or (kind == "outside" and not article[k] and not main[k])
        kept = [k for k in range(n) if not gone[k]]
        in_main = in_both = 0
        for element, text, _ in self.texts:
            if text and main[element] and not gone[element]:
                in_main += len(text.strip())
                in_both += len(text.strip()) * article[element]
        marked = any(article[k] for k in kept)
        if any(main[k] for k in kept) and (in_main or not marked):
            wanted = [m and (a or 2 * in_both < in_main) for a, m in zip(article, main)] if in_both else main
        else:
            wanted = (article if self._articles_count(article, gone) else [not a for a in article]) if marked else None
        blocks, part, linked, length = [], [], 0, 0
        for element, text, link in [*self.texts, (0, None, False)]:
            if text is None:
                block = " ".join("".join(part).split())
                if block and (wanted or linked < LINK_SHARE * length or _has_own_words(part, block)):
                    blocks.append(block)
                part, linked, length = [], 0, 0
            elif not gone[element] and (not wanted or wanted[element]):
                part.append(text if not link else _Linked(text))
                length += len(text.strip())
                linked += len(text.strip()) * link
        return "\n".join(blocks)


    def _articles_count(self, article: list[bool], gone: list[bool]) -> bool:
        """Whether the articles are the page's text, and no teasers beside it."""
        n = len(self.elements)
        inside = outside = 0
        own = [0] * n  # text of an element's own paragraphs that are in no article
        paragraph = [-1] * n
        for k, (tag, parent, _, _, _) in enumerate(self.elements):
            paragraph[k] = k if tag == "p" else paragraph[parent] if parent >= 0 else -1
        for element, text, link in self.texts:
            length = len(text.strip()) if text and not gone[element] else 0
            if article[element]:
                inside += length
            else:
                outside += length
                if paragraph[element] >= 0 and not link:
                    own[self.elements[paragraph[element]][1]] += length
        return 3 * inside >= inside + outside or max(own) < 2 * inside


class _Linked(str):
    """Text of a link."""


def _is_sentence(text: str) -> bool:
    words = text.split()
    return len(words) >= 5 and words[-1].rstrip("\"')\u201d\u2019")[-1:] in tuple(".!?\u2026")


def _has_own_words(part: list[str], block: str) -> bool:
    """Whether a block of links is a sentence with two words at least outside of them."""
    own = [w for x in part if not isinstance(x, _Linked) for w in x.split() if any(map(str.isalpha, w))]
    return len(own) >= 2 and block[-1:] in tuple(".!?\u2026")


def _kind(tag: str, attrs: str) -> str:
    if tag in DROPPED:
        return "drop"
    if tag in ("html", "body"):
        return ""
    names: list[str] = []
    if tag == "form":
        return "form"
    if attrs and not attrs.isspace():
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name == "role":
                if value.strip() in ROLES:
                    return "drop"
                if value.strip() == "form":
                    return "form"
                if value.strip() in ("main", "article"):
                    tag = value.strip()
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return "drop"
            elif name in ("class", "id"):
                names.extend(value.split())
    if tag == "main":
        return tag
    told = [name for name in names if _is_name(name)]
    if told:
        words = {w for name in told for w in _WORD.findall(name)}
        strong = any(w in NAMES - WEAK or w.startswith(PREFIXES) for w in words)
        return "named article" if tag == "article" else "named" if strong else "weak" if words & (WEAK - UNLESS_PROSE) else "unless prose"
    if tag == "article":
        return tag
    return "outside" if tag == "header" or not OUTSIDE_ONLY.isdisjoint(names) else ""


def _is_name(name: str) -> bool:
    """Whether a whole class or id names what is no article."""
    told = False
    for word in _WORD.findall(name):
        if word in NAMES or word.startswith(PREFIXES):
            told = True
        elif word not in NEUTRAL and not word.lstrip("v").isdigit():
            return False
    return told


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _signed(found: int, salt: int) -> int:
    """A number below _PRIME as a long that a length is mixed into."""
    mixed = (found ^ salt << 48) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return (mixed ^ mixed >> 32) - (1 << 63)


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return pages.select(F.col(id_col).alias("id"), F.xxhash64(html_col).alias("text_key"), F.col(url_col).cast("string").alias("url"), F.xxhash64(host).alias("host"), F.col(html_col).cast("binary").alias("text"))


def subtrees(pages: DataFrame) -> DataFrame:
    """(id, text_key, host, content, subtree): hashes of the pages' subtrees.

    Every page has a subtree 0 besides, which counts the contents of its host.
    """
    schema = T.StructType([pages.schema["id"], T.StructField("text_key", T.LongType()), T.StructField("host", T.LongType()), T.StructField("content", T.LongType()), T.StructField("subtree", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            keys, hosts = batch.column("text_key").to_pylist(), batch.column("host").to_pylist()
            for row, source in enumerate(batch.column("text")):
                page = Page((source.as_py() or b"").decode("utf-8", "replace"))
                found = {0, *(h for _, h in page.subtrees())}
                content = _digest(page.text())
                for column, values in zip(out, ([row] * len(found), [keys[row]] * len(found), [hosts[row]] * len(found), [content] * len(found), sorted(found))):
                    column.extend(values)
            if out[0]:
                yield emit(out, batch.column(0), schema)

    return pages.mapInArrow(run, schema)


def extract_text(pages: DataFrame, *, min_contents: int = MIN_CONTENTS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, removed): removed is the number of template subtrees."""
    keyed = _keyed(pages, id_col, url_col, html_col)
    found = materialize(subtrees(keyed), "subtrees")
    recurring = found.select("host", "subtree", "content").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_contents)
    recurring = materialize(recurring, "recurring")  # its size is known then: if small, the subtrees are not shuffled to meet it
    total = recurring.filter("subtree = 0").select("host", F.col("n").alias("total"))
    outside = F.col("subtree") % 2 == 0
    known = recurring.filter("subtree <> 0").join(total, "host").filter(outside | (F.col("n") >= INSIDE_SHARE * F.col("total"))).select("host", "subtree")
    known = materialize(known, "templates")
    own = found.join(known, ["host", "subtree"]).groupBy("id", "text_key").agg(F.collect_set("subtree").alias("templates"))
    own = materialize(own, "own-templates")
    for table in (found, recurring, known):
        discard(table)
    joined = compressed(keyed.select("id", "text_key", "url", "text")).join(own, ["id", "text_key"], "left").select("id", "url", "text", "templates")
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = decompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], []]
                for row, (url, source, templates) in enumerate(zip(part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist())):
                    page = Page(grow(source.as_py()).decode("utf-8", "replace"))
                    known = set(templates or ())
                    gone = {k for k, h in page.subtrees() if h in known} if known else set()
                    for column, value in zip(out, (row, url, page.text(gone), len(gone))):
                        column.append(value)
                yield emit(out, part.column(0), schema)

    return joined.mapInArrow(run, schema)
