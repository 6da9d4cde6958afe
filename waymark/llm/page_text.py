"""Main text of web pages by nearest-URL page differencing.

Pages are put in order by host and URL path.  A page is paired with the nearest different pages of its
host (``NEAR`` on either side; copies of the page itself are passed over), and the text lines of each
pair are aligned by longest common subsequence.  A line is its text and its place, the path of the
elements around it.  The alignment then decides:

* Where the article is.  Both pages of a pair vote, with the words that they don't share, for the
  elements that hold them; from the body down, the element that holds most of its parent's votes is
  entered.  Lines outside the element found (menus, adverts, footers: little text, or shared) go.
* Which of its lines are template.  A line that is shared with every page of its pairs goes, if there
  are two at least; a passage that only some neighbours have is part of the article.

Structure overrules in two cases only.  If the vote misses the page's own ``<article>`` or ``<main>``
(its neighbours are copies of the article, so all of it is shared, or it has no neighbours), the
article is that element; and if more than half of that element's words would go as shared, they stay
(without such an element, if all of them would).
Lines of menus, forms, comments and the like *inside* the article go by name, as no other page need
have them.

Results do not depend on partitions.  The order is cut at sampled keys into parts of bounded size, a
host of any size included; a first pass, over keys and signatures, finds the pages on both sides of
every cut, and the second sends these to both parts.

Defined cases: a null html is an empty page with an empty text; pages without a url are neighbours
of each other; repeated rows give the same text each; a page alone on its host has no pairs, so its own
words vote; of equally long paths page_id, url and a hash of the html decide the order; an empty table
gives an empty result; other columns of ``pages`` are not looked at.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import parts_for, slices

#: Pages to pair with on either side, and bytes of html in a part of the order.
NEAR = 2
PART_BYTES = 32 << 20
#: Keys sampled for each cut.
SAMPLE_KEYS = 50
#: Elements deeper than this share their ancestor's path.
DEPTH = 24
#: Bits of stored rows up to which an alignment is traced directly, without halving.
TRACE_BITS = 1 << 26

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
CHROME = frozenset("nav footer aside form button select menu dialog svg canvas object audio video head".split())
CORE = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
SECTIONS = frozenset("body div section article main nav header footer aside form menu dialog center td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe "
    "subscription sidebar widget menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments reply replies disqus share sharing social related pagination pager login signup".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

#: The inside of a tag up to its ">"; quoted values may hold one.  Possessive, so it never goes back.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
WORD = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")
#: After so many tags whose quotes don't close, quotes are no longer looked at.
ODD_TAGS = 8


class Line(NamedTuple):
    """A block of text; path: the sections around it, and its own block; core: in article or main."""

    text: str
    path: str
    core: bool
    chrome: bool


class Element(NamedTuple):
    name: str
    path: str
    core: bool
    chrome: bool


def is_chrome(name: str, names: str, role: str, in_core: bool) -> bool:
    if name in CHROME or name == "header" and not in_core:
        return True
    if name in CORE or name in ("body", "html"):
        return False
    return role in CHROME_ROLES or bool(names) and not CHROME_NAMES.isdisjoint(WORD.findall(names))


def page_lines(page: str) -> list[Line]:
    """The page's blocks of text in order; an empty page has none.

    Unclosed elements end with the element around them, a stray end tag is passed over, and a "<" that
    no ">" follows is text, like all after it.  The time is linear in the page's length.
    """
    lines: list[Line] = []
    parts: list[str] = []
    stack = [Element("", "", False, False)]
    open_: dict[str, int] = {}
    at = odd = 0
    last = page.rfind(">")

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                top = stack[-1]
                lines.append(Line(text, top.path, top.core, top.chrome))
            parts.clear()

    def pop() -> str:
        name = stack.pop().name
        open_[name] -= 1
        return name

    while True:
        start = page.find("<", at)
        if start < 0 or start > last:
            break
        if start > at:
            parts.append(html_lib.unescape(page[at:start]))
        mark = page[start + 1 : start + 2]
        if mark in ("!", "?"):
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
            else:
                at = page.find(">", start) + 1
            continue
        closing = mark == "/"
        named = NAME.match(page, start + 1 + closing)
        if named is None:
            parts.append("<")
            at = start + 1
            continue
        found = REST.match(page, named.end()) if odd < ODD_TAGS else None
        if found is None:
            odd += 1
            at = page.find(">", named.end()) + 1
        else:
            at = found.end()
        name, inside = named[0].lower(), page[named.end() : at - 1]
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append("\n")
        if closing:
            if open_.get(name):
                while pop() != name:
                    pass
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not inside.endswith("/"):
            if name in ("p", "li") and any(x.name == name for x in stack[-3:]):
                while stack[-1].name == name or stack[-1].name in INLINE:
                    if pop() == name:
                        break
            top = stack[-1]
            if name in INLINE:
                element = Element(name, top.path, top.core, top.chrome)
            else:
                names = role = ""
                if "=" in inside:
                    values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(inside)}
                    names, role = f"{values.get('class', '')} {values.get('id', '')}".strip().lower(), values.get("role", "").lower()
                step = name + "".join(f".{w}" for w in re.findall("[a-z]+", names)) if name in SECTIONS else name
                path = f"{top.path}/{step}" if len(stack) <= DEPTH and name != "html" else top.path
                element = Element(name, path, top.core or name in CORE, top.chrome or is_chrome(name, names, role, top.core))
            stack.append(element)
            open_[name] = open_.get(name, 0) + 1
    parts.append(html_lib.unescape(page[at:]))
    flush()
    return lines


# --- alignment -------------------------------------------------------------------------------------


def _bits(a: list, b: list) -> tuple[int, list[int]]:
    """Bit-parallel longest common subsequence: the rows after each element of ``a`` (0 bits are steps)."""
    masks: dict = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return v, rows


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``."""
    masks: dict = {}
    for j, y in enumerate(b):
        masks.setdefault(y, []).append(j)
    bits = {}
    for y, places in masks.items():
        flags = np.zeros(len(b), np.uint8)
        flags[places] = 1
        bits[y] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little") if len(places) > 64 else sum(1 << j for j in places)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & bits.get(x, 0)
        v = ((v + u) | (v - u)) & full
    steps = 1 - np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(steps)])


def aligned(a: list, b: list) -> tuple[list[int], list[int]]:
    """Places in ``a`` and in ``b`` of a longest common subsequence.

    Lines that the other side lacks are left out first; long sides are halved (Hirschberg), so memory
    is in proportion to the lines.
    """
    in_a, in_b = set(a), set(b)
    ia, ib = [i for i, x in enumerate(a) if x in in_b], [j for j, y in enumerate(b) if y in in_a]
    out_a: list[int] = []
    out_b: list[int] = []

    def go(ia: list[int], ib: list[int]) -> None:
        lo = 0
        while lo < len(ia) and lo < len(ib) and a[ia[lo]] == b[ib[lo]]:
            lo += 1
        hi = 0
        while hi < min(len(ia), len(ib)) - lo and a[ia[-1 - hi]] == b[ib[-1 - hi]]:
            hi += 1
        out_a.extend(ia[:lo])
        out_b.extend(ib[:lo])
        ma, mb = ia[lo : len(ia) - hi], ib[lo : len(ib) - hi]
        if ma and mb:
            x, y = [a[i] for i in ma], [b[j] for j in mb]
            if len(x) == 1 or len(x) * len(y) <= TRACE_BITS:
                rows = _bits(x, y)[1]
                found, i, j = [], len(x) - 1, len(y) - 1
                while i >= 0 and j >= 0:
                    if rows[i] >> j & 1:
                        j -= 1
                    elif i and not rows[i - 1] >> j & 1:
                        i -= 1
                    else:
                        found.append((i, j))
                        i, j = i - 1, j - 1
                out_a.extend(ma[i] for i, _ in reversed(found))
                out_b.extend(mb[j] for _, j in reversed(found))
            else:
                half = len(x) // 2
                best = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
                go(ma[:half], mb[:best])
                go(ma[half:], mb[best:])
        out_a.extend(ia[len(ia) - hi :])
        out_b.extend(ib[len(ib) - hi :])

    go(ia, ib)
    return out_a, out_b


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    return set(aligned(a, b)[0])


class Pair(NamedTuple):
    """What one pair says to one of its pages: its shared lines, and the unshared words by place, of both."""

    shared: set[int]
    words: dict[str, int]


def unshared_words(lines: list[Line], shared: set[int]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, x in enumerate(lines):
        if i not in shared:
            out[x.path] = out.get(x.path, 0) + x.text.count(" ") + 1
    return out


def pair(a: list[Line], b: list[Line]) -> tuple[Pair, Pair]:
    """The pair as ``a`` and as ``b`` see it."""
    sa, sb = (set(s) for s in aligned([x[:2] for x in a], [x[:2] for x in b]))
    words = unshared_words(a, sa)
    for path, n in unshared_words(b, sb).items():
        words[path] = words.get(path, 0) + n
    return Pair(sa, words), Pair(sb, words)


def sections(path: str) -> Iterator[str]:
    """The path's sections, outermost first."""
    steps = path.split("/")
    for i, step in enumerate(steps[1:], 2):
        if step.split(".")[0] in SECTIONS:
            yield "/".join(steps[:i])


def article_path(words: dict[str, int]) -> str:
    """The section that the words vote for: from the top down, the one with most of its parent's.

    A section that holds a heading itself, an article or a main element is not left.
    """
    mass: dict[str, int] = {}
    below: dict[str, set[str]] = {}
    headed: set[str] = set()
    for path, n in words.items():
        above = ""
        for s in sections(path):
            mass[s] = mass.get(s, 0) + n
            below.setdefault(above, set()).add(s)
            above = s
        if path.rpartition("/")[2] in HEADINGS:
            headed.add(above)
    at, left = "", sum(words.values())
    while at not in headed and at.rpartition("/")[2].split(".")[0] not in CORE:
        best = max(below.get(at, ()), key=lambda s: (mass[s], s), default=None)
        if best is None or 2 * mass[best] <= left:
            break
        at, left = best, mass[best]
    return at


def under(path: str, section: str) -> bool:
    return path == section or path.startswith(section + "/")


def kept_lines(own: list[Line], pairs: list[Pair]) -> list[int]:
    """The lines of the main text: see the module's account."""
    votes: dict[str, int] = {}
    for p in pairs or [Pair(set(), unshared_words(own, set()))]:
        for path, n in p.words.items():
            votes[path] = votes.get(path, 0) + n
    where = article_path(votes)
    inside = [i for i, x in enumerate(own) if under(x.path, where)]
    core = [i for i, x in enumerate(own) if x.core]
    if core and not any(own[i].core for i in inside) or not inside or not pairs:
        inside = core or inside or list(range(len(own)))
    inside = [i for i in inside if not own[i].chrome]
    if len(pairs) > 1:
        template = set.intersection(*(p.shared for p in pairs))
        gone = [i for i in inside if i in template]
        size = lambda some: sum(own[i].text.count(" ") + 1 for i in some)
        if 2 * size(gone) <= size(inside) if core else len(gone) < len(inside):
            inside = [i for i in inside if i not in template]
    return inside


def main_text(own: list[Line], near: list[list[Line]]) -> str:
    """The main text of a page, given the lines of the pages that it is paired with."""
    return "\n".join(own[i].text for i in kept_lines(own, [pair(own, x)[0] for x in near]))


# --- the order of pages ----------------------------------------------------------------------------


def keyed_pages(pages: DataFrame) -> DataFrame:
    """key (a string in the order of host, path, page_id, url, hash of html), page_id, url, host, html."""
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host, path = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    html = F.coalesce("html", F.lit(""))
    hex_of = lambda x: F.lpad(F.hex(x), 16, "0")
    page_id = F.col("page_id").cast("bigint")
    number = F.coalesce(hex_of(page_id.bitwiseXOR(F.lit(-(1 << 63)))), F.lit(""))
    key = F.concat_ws("\0", host, path, number, F.coalesce("url", F.lit("")), hex_of(F.xxhash64(html)))
    return pages.select(key.alias("key"), page_id.alias("page_id"), "url", host.alias("host"), html.alias("html"))


def cut_keys(keyed: DataFrame, parts: int) -> list[str]:
    """Sampled keys that cut the order into ``parts`` parts of about equal bytes; a frequent key may be
    several cuts."""
    if parts < 2:
        return []
    n = keyed.count()
    share = min(1.0, parts * SAMPLE_KEYS / max(n, 1))
    got = keyed.where(F.rand(7) < share).select("key", F.octet_length("html").alias("n")).orderBy("key").toArrow()
    keys, sizes = got.column(0).to_pylist(), [x + 100 for x in got.column(1).to_pylist()]
    ends = list(accumulate(sizes))
    return [keys[min(bisect_left(ends, ends[-1] * i / parts), len(keys) - 1)] for i in range(1, parts)] if keys else []


def part_of(key: str, cuts: list[str], turn: int) -> int:
    """The part that a key belongs to: rows of one key that is several cuts take turns in its parts."""
    lo, hi = bisect_left(cuts, key), bisect_right(cuts, key)
    return hi if hi - lo < 2 else lo + 1 + turn % (hi - lo)


def signature(lines: list[Line]) -> int:
    data = "\n".join(f"{x.path}\0{x.text}" for x in lines)
    return xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass")) - (1 << 63)


Run = tuple[str, int, str]  # host, signature, key of the first row


def merged(runs: list[Run], run: Run) -> list[Run]:
    """Runs with one more at the end; a run that goes on is one."""
    return runs if runs and runs[-1][:2] == run[:2] else [*runs, run]


def borders(edges: list[tuple[int, list[Run], list[Run]]]) -> dict[str, set[int]]:
    """For each page that another part needs, those parts.  ``edges``: the parts in order, each with its
    first and last ``NEAR`` + 1 runs."""
    wanted: dict[str, set[int]] = {}
    for way in (1, -1):
        held: list[Run] = []  # the last runs passed, nearest last
        for part, first, last in edges[::way]:
            for _, _, key in held:
                wanted.setdefault(key, set()).add(part)
            for run in last if way > 0 else first[::-1]:
                held = merged(held, run)[-NEAR - 1 :]
    return wanted


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    keyed = keyed_pages(pages)
    parts = parts_for(spark, keyed.select(F.sum(F.octet_length("html"))).first()[0] or 0, PART_BYTES)
    cuts = cut_keys(keyed, parts)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """part, key, page_id, url, host, lines of each row."""
        turn = 0
        for batch in batches:
            for lo, hi in slices(batch, 4, 4 << 20):
                for key, page, url, host, text in zip(*(c.to_pylist() for c in batch.slice(lo, hi - lo).columns)):
                    turn += 1
                    yield part_of(key, cuts, turn), key, page, url, host, page_lines(text)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((part, key, host, signature(lines)) for part, key, _, _, host, lines in parsed(batches)), SIGNED)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            part, first, last = None, [], []
            for now, key, host, sig in _rows(batches):
                if now != part and part is not None:
                    yield part, first, last
                    first, last = [], []
                part, run = now, (host, sig, key)
                last = merged(last, run)[-NEAR - 1 :]
                if len(first) <= NEAR:
                    first = merged(first, run)
            if part is not None:
                yield part, first, last

        flat = lambda runs: ([r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs])
        yield from _batches(((part, *flat(first), *flat(last)) for part, first, last in found()), EDGES)

    signed = keyed.mapInArrow(sign, SIGNED_DDL).repartitionById(parts, "part").sortWithinPartitions("part", "key")
    edges = signed.mapInArrow(ends, EDGES_DDL).orderBy("part").toArrow().to_pylist()  # a few runs per part
    wanted = borders([(e["part"], *(list(zip(e[f"{w}_host"], e[f"{w}_sig"], e[f"{w}_key"])) for w in ("first", "last"))) for e in edges])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            sent: set[str] = set()
            for part, key, page, url, host, lines in parsed(batches):
                paths = list(dict.fromkeys(x.path for x in lines))
                number = {p: i for i, p in enumerate(paths)}
                body = (host, signature(lines), "\n".join(x.text for x in lines), paths, [number[x.path] << 2 | x.core << 1 | x.chrome for x in lines])
                yield part, key, True, page, url, *body
                if key in wanted and key not in sent:
                    sent.add(key)
                    for other in wanted[key] - {part}:
                        yield other, key, False, page, url, *body

        yield from _batches(rows(), SENT)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple]:
            window: list[tuple[list[Line], list[tuple], list[Pair], int]] = []  # lines, rows, pairs, and how many before it were tried
            state = None

            def finish(run: tuple) -> Iterator[tuple]:
                lines, rows, pairs, _ = run
                if rows:
                    text = "\n".join(lines[i].text for i in kept_lines(lines, pairs))
                    for page, url in rows:
                        yield page, url, text, len(text)

            for part, _, own, page, url, host, sig, text, paths, marks in _rows(batches):
                if state != (part, host, sig):
                    if state is None or state[:2] != (part, host):
                        for run in window:
                            yield from finish(run)
                        window = []
                    state = (part, host, sig)
                    lines = [Line(t, paths[m >> 2], bool(m & 2), bool(m & 1)) for t, m in zip(text.split("\n") if marks else [], marks)]
                    new = (lines, [], [], sig)
                    for before in window:
                        if before[3] != sig:
                            ours, theirs = pair(new[0], before[0])
                            new[2].append(ours)
                            before[2].append(theirs)
                    window.append(new)
                    if len(window) > NEAR:
                        yield from finish(window.pop(0))
                if own:
                    window[-1][1].append((page, url))
            for run in window:
                yield from finish(run)

        yield from _batches(texts(), TEXTS)

    sent = keyed.mapInArrow(send, SENT_DDL).repartitionById(parts, "part").sortWithinPartitions("part", "key")
    return sent.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")


_RUNS = [(f"{w}_{c}", pa.list_(k)) for w in ("first", "last") for c, k in (("host", pa.string()), ("sig", pa.int64()), ("key", pa.string()))]
SIGNED = pa.schema([("part", pa.int32()), ("key", pa.string()), ("host", pa.string()), ("sig", pa.int64())])
SIGNED_DDL = "part int, key string, host string, sig bigint"
EDGES = pa.schema([("part", pa.int32()), *_RUNS])
EDGES_DDL = "part int, " + ", ".join(f"{w}_host array<string>, {w}_sig array<bigint>, {w}_key array<string>" for w in ("first", "last"))
SENT = pa.schema([("part", pa.int32()), ("key", pa.string()), ("own", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("sig", pa.int64()), ("text", pa.string()), ("paths", pa.list_(pa.string())), ("marks", pa.list_(pa.int32()))])
SENT_DDL = "part int, key string, own boolean, page_id bigint, url string, host string, sig bigint, text string, paths array<string>, marks array<int>"
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    out: list[tuple] = []
    size = 0
    for row in rows:
        out.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if len(out) >= 2048 or size > 2 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
