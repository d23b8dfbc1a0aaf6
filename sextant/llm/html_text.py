"""Main text of web pages by the wrappers of their hosts (operator 7).

A page is read as a union-free regular expression over its elements: an element's children are a
sequence, runs of equal siblings are one repeated element (``+``), runs of equal sequences one
repeated group, and text is a constant. The expressions of a host's pages are aligned one after
another, in the order of their hashes: equal elements meet and are aligned inside; what only one
side has becomes optional (``?``); what one side repeats is repeated; texts that differ become slots. The
result, the host's wrapper, is an expression that all its pages match. Hosts of many pages are
aligned in buckets of ``BUCKET`` pages, whose wrappers are aligned in turn, so no host is in one task
and the result doesn't depend on how pages are dealt out.

The wrapper chooses the text. Its article region is the deepest element that holds half of all slot
text that isn't link text (of a host without slots, half of all such text), or the article or
main element around it. A page's text is what it has in that region; all else (menus, headers,
footers, adverts, whatever they are called) is left out because the wrapper places it elsewhere. Names
break ties: if the region is, by its element or its class, id and role, a boilerplate part, or holds a region of
unmarked text that is deeper, the region of unmarked text is taken; and parts inside the region that are marked as
boilerplate (comments of readers, sharing, notices, forms, hidden parts) are left out. Inside a region, a word marks a part
if it is a whole class, ends one, or goes before a word for a list or box. A page without its host's region gives its unmarked text.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by \\n; empty blocks vanish.

Edge cases: null or empty html gives an empty text; a page without tags is one text block; a
null url is a host of its own, as is a url without a host. End tags that are missing close with
their container, and stray ones are ignored; a tag that never ends is text, and one whose quotes never end stops at
its first ``>``. In the wrapper, elements below ``DEPTH`` levels count as their container (the text of a page has no such
limit). Repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored. Pages of any length are read whole, in linear time.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import keep, slices, small, table, utf8

#: Pages, or wrappers, that are aligned one after another.
BUCKET = 64
#: Levels of elements in a wrapper.
DEPTH = 100

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas annotation".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced mstyle".split())
#: Elements whose start closes an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
NOTHING: frozenset[str] = frozenset()
P = frozenset(["p"])
BOILERPLATE = frozenset("nav footer aside form button select dialog menu fieldset head".split()) | RAW
WORDS = (
    r"ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|footer|masthead|topbar|toolbar|share|sharing|comments?|disqus|replies|respond|pagination|pager"
)
#: Words that articles are about as well.
WEAK_WORDS = r"notices?|alert|side|aside|social|related|recommended|search|toc"
PARTS = r"links?|posts?|articles?|stories|buttons?|icons?|list|items?|box|bar|block|area|section|container|wrapper|wrap|inner|holder|slot|form|nav|thread|feed|widget|panel|count|meta|tools?|top|bottom|left|right|\d+"
MARKS = re.compile(rf"(?:^|[\s_-])(?:{WORDS}|{WEAK_WORDS})(?:$|[\s_-])", re.I)
MARKS_INSIDE = re.compile(rf"(?:^|\s)(?:[^\s]*[_-])?(?:{WORDS})(?:[_-](?:{PARTS}))*(?:$|\s)", re.I)
WEAK_INSIDE = re.compile(rf"(?:^|\s)(?:{WEAK_WORDS})(?:[_-](?:links?|posts?|articles?|stories|buttons?|icons?|list|nav|form))?(?:$|\s)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s/=])|style\s*=\s*[\"']?[^\"'>]*display\s*:\s*none", re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class _Scanner:
    """Places of tags. A search that found nothing isn't made again, so a page is scanned in linear time."""

    def __init__(self, page: str):
        self.page = page
        self.none: dict[str, int] = {}
        self.lost: set[int] = set()

    def find(self, what: str, at: int) -> int:
        if at >= self.none.get(what, len(self.page) + 1):
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.none[what] = at
        return k

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``: its ``>`` outside quotes, else its first one; -1 for none."""
        page, k, seen = self.page, at, []
        while True:
            close = self.find(">", k)
            if close < 0:
                break
            if k in self.lost:
                k = -1
                break
            seen.append(k)
            m = VALUE.search(page, k, close)
            if m is None:
                return close
            k = self.find(m[1], m.end())  # a quote only opens a value directly after "="
            if k < 0:
                break
            k += 1
        self.lost.update(seen)
        return self.find(">", at)


VALUE = re.compile(r"=\s*([\"'])")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")


def tokens(page: str) -> Iterator[tuple]:
    """("start", tag, marks, void), ("end", tag) and ("text", raw) of a page.

    ``marks``: words of class, id and role. The content of raw elements is skipped.
    """
    scan, at, text, n = _Scanner(page), 0, 0, len(page)
    while (k := scan.find("<", at)) >= 0:
        name, after = None, page[k + 1 : k + 2]
        if page.startswith("<!--", k):
            end = scan.find("-->", k + 4)
            stop = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", k):
            end = scan.find("]]>", k + 9)
            stop = n if end < 0 else end + 3
        elif after in ("!", "?"):
            end = scan.find(">", k)
            stop = n if end < 0 else end + 1
        elif m := NAME.match(page, k):
            end = scan.tag_end(m.end())
            if end < 0:
                break  # no tag ends any more: the rest is text
            name, stop = m[1].lower(), end + 1
        else:
            at = k + 1
            continue
        if k > text:
            yield "text", page[text:k]
        at = text = stop
        if name is None:
            continue
        if after == "/":
            yield "end", name
            continue
        own, marks = page[m.end() : end], ""
        if own and ("class" in own or "id" in own or "role" in own or "style" in own or "hidden" in own):
            got = {a[1].lower(): next((v for v in a.groups()[1:] if v is not None), "") for a in ATTRIBUTE.finditer(own)}
            marks = " ".join(f"{x}={got[x]}" for x in ("class", "id", "role") if x in got)
            if ("hidden" in own or "style" in own) and HIDDEN.search(ATTRIBUTE.sub(lambda a: a[0] if a[1].lower() in ("hidden", "style") else "", own)):
                marks = f"{marks} hidden=".strip()
        void = name in VOID or own.rstrip().endswith("/") and name not in INLINE and name not in CLOSES_P
        yield "start", name, marks, void
        if name in RAW and not void:
            at = text = _raw_end(page, scan, name, stop)
            yield "end", name
    if page[text:].strip():
        yield "text", page[text:]


def _raw_end(page: str, scan: _Scanner, name: str, at: int) -> int:
    """Where the end tag of a raw element ends, or the page."""
    key = f"</{name}"
    if at >= scan.none.get(key, len(page) + 1):
        return len(page)
    m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
    if m is None:
        scan.none[key] = at
        return len(page)
    return m.end()


def is_boilerplate(name: str, marks: str, inside_article: bool) -> bool:
    """Whether an element holds no part of an article, by its name and marks."""
    if name in BOILERPLATE or name == "header" and not inside_article:
        return True
    if not marks or name in ("body", "html") or name in ("article", "main") and not inside_article:
        return False
    for kind, value in re.findall(r"(class|id|role|hidden)=([^=]*?)(?= (?:class|id|role|hidden)=|$)", marks):
        if kind == "hidden" or kind == "role" and set(value.lower().split()) & ROLES:
            return True
        if kind in ("class", "id") and (MARKS_INSIDE if inside_article else MARKS).search(value):
            return True
        if kind == "class" and inside_article and WEAK_INSIDE.search(value):
            return True
    return False


@lru_cache(1 << 16)
def _place(name: str, marks: str) -> str:
    """An element's name and marks, without marks that differ from page to page."""
    words = sorted(re.sub(r"(class|id|role|hidden)=", "", marks).split()) if marks and name not in ("article", "main", "body", "html") else ()
    return ".".join([name, *(m for m in words if not any(c.isdigit() for c in m))])


def walk(page: str, article: list[str] | None = None) -> Iterator[tuple]:
    """("open", name, place, in the region, boilerplate), ("close", name) and ("text", raw, link, in the region, boilerplate), with missing ends supplied.

    ``article``: places from the top down to the region's element. Boilerplate above the region doesn't count in it.
    """
    stack: list[tuple] = []  # name, boilerplate, inside an article, in the region, steps of the region's path so far, link, elements that aren't inline
    opened: dict[str, int] = {}
    top = (None, False, False, False, 0, False, 0)

    def close(k: int) -> Iterator[tuple]:
        while len(stack) > k:
            name = stack.pop()[0]
            opened[name] -= 1
            yield "close", name

    for t in tokens(page):
        if t[0] == "text":
            _, bad, _, found, _, link, _ = stack[-1] if stack else top
            yield "text", t[1], link, found, bad
        elif t[0] == "start":
            _, name, marks, void = t
            ends = CLOSES.get(name, NOTHING)
            ends = ends | P if name in CLOSES_P else ends
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if not any(opened.get(x) for x in ends):
                        break
                    x = stack[k][0]
                    if x in ends:
                        yield from close(k)
                    elif x not in INLINE:
                        break
            _, bad, inside, found, steps, link, depth = stack[-1] if stack else top
            place = name if name in INLINE else _place(name, marks)
            if article and not found and name not in INLINE and steps == depth < len(article) and article[steps] == place:
                steps += 1
                if steps == len(article):
                    bad, inside, found = False, True, True
                else:
                    bad = bad or is_boilerplate(name, marks, inside)
            else:
                bad = bad or is_boilerplate(name, marks, inside)
            yield "open", name, place, found, bad
            if void:
                yield "close", name
            else:
                stack.append((name, bad, inside or name in ("article", "main"), found, steps, link or name == "a", depth + (name not in INLINE)))
                opened[name] = opened.get(name, 0) + 1
        elif opened.get(t[1]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == t[1]:
                    yield from close(k)
                    break
    yield from close(0)


# An expression is a list [place, repeated, optional, text, slot, free, marked, children]. text: hash of
# its own text where all pages agree; slot: whether they don't; free: characters of its own text that are no
# link text; marked: those of them that names mark as boilerplate. The place of a group of siblings is "".
PLACE, REPEATED, OPTIONAL, TEXT, SLOT, FREE, MARKED, CHILDREN = range(8)


def _element(place: str) -> list:
    return [place, False, False, None, False, 0, 0, []]


def merged(a: list, b: list) -> list:
    """An expression that both match, of two of one place."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    slot = a[SLOT] or b[SLOT] or a[TEXT] != b[TEXT]
    return [a[PLACE], a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL], text, slot, a[FREE] + b[FREE], a[MARKED] + b[MARKED], aligned(a[CHILDREN], b[CHILDREN])]


def _signature(x: list) -> tuple:
    """What tells siblings apart: a place, or the places of a group."""
    return (x[PLACE],) if x[PLACE] else tuple(y[PLACE] for y in x[CHILDREN])


def _optional(x: list) -> list:
    return x if x[OPTIONAL] else [*x[:OPTIONAL], True, *x[OPTIONAL + 1 :]]


#: Most siblings in a repeated group.
GROUP = 3


def _added(out: list[list], x: list) -> None:
    """Append a sibling, folding runs of equal siblings and of equal sequences of siblings."""
    out.append(x)
    while True:
        if len(out) > 1 and _signature(out[-1]) == _signature(out[-2]):
            y = out.pop()
            out[-1] = merged(out[-1], y)
            out[-1][REPEATED] = True
            continue
        for n in range(2, GROUP + 1):
            if len(out) > n and not out[-n - 1][PLACE] and len(out[-n - 1][CHILDREN]) == n and all(z[PLACE] for z in out[-n:]) and _signature(out[-n - 1]) == tuple(z[PLACE] for z in out[-n:]):
                group = ["", True, out[-n - 1][OPTIONAL], None, False, 0, 0, [merged(p, q) for p, q in zip(out[-n - 1][CHILDREN], out[-n:], strict=True)]]
                out[-n - 1 :] = [group]
                break
            if len(out) >= 2 * n and all(z[PLACE] for z in out[-2 * n :]) and [z[PLACE] for z in out[-2 * n : -n]] == [z[PLACE] for z in out[-n:]]:
                out[-2 * n :] = [["", True, False, None, False, 0, 0, [merged(p, q) for p, q in zip(out[-2 * n : -n], out[-n:], strict=True)]]]
                break
        else:
            return


def _once(group: list, side: list[list], k: int) -> list | None:
    """The group with one more pass over it, if ``side`` has its siblings from ``k`` on."""
    run = side[k : k + len(group[CHILDREN])]
    if group[PLACE] or not all(x[PLACE] for x in run) or tuple(x[PLACE] for x in run) != _signature(group):
        return None
    return [*group[:CHILDREN], [merged(x, y) for x, y in zip(group[CHILDREN], run, strict=True)]]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Two sequences of siblings as one: at a mismatch, the side whose next match is nearer is passed over as optional."""
    out: list[list] = []
    places: list[dict[tuple, list[int]]] = [{}, {}]
    for at, side in zip(places, (a, b), strict=True):
        for k, x in enumerate(side):
            at.setdefault(_signature(x), []).append(k)

    def ahead(at: dict[tuple, list[int]], what: tuple, k: int) -> int | None:
        found = at.get(what, ())
        n = bisect_left(found, k)
        return found[n] if n < len(found) else None

    i = j = 0
    while i < len(a) and j < len(b):
        p, q = _signature(a[i]), _signature(b[j])
        if p == q:
            _added(out, merged(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        if x := _once(a[i], b, j):  # a group that the other side has once
            _added(out, x)
            i, j = i + 1, j + len(x[CHILDREN])
            continue
        if x := _once(b[j], a, i):
            _added(out, x)
            i, j = i + len(x[CHILDREN]), j + 1
            continue
        in_b, in_a = ahead(places[1], p, j), ahead(places[0], q, i)
        if in_b is None and in_a is None:
            _added(out, _optional(a[i]))
            _added(out, _optional(b[j]))
            i, j = i + 1, j + 1
        elif in_a is None or in_b is not None and in_b - j <= in_a - i:
            for x in b[j:in_b]:
                _added(out, _optional(x))
            j = in_b
        else:
            for x in a[i:in_a]:
                _added(out, _optional(x))
            i = in_a
    for x in (*a[i:], *b[j:]):
        _added(out, _optional(x))
    return out


def expression(page: str) -> list:
    """A page as an expression below one element without a place name of its own."""
    stack, depth, pieces, free, marked = [_element("/")], [], [], 0, 0

    def flush() -> None:
        nonlocal free, marked
        if pieces:
            if text := " ".join(html.unescape("".join(pieces)).split()):
                own = stack[-1]
                own[TEXT], own[FREE], own[MARKED] = _hash(text) ^ (own[TEXT] or 0), own[FREE] + free, own[MARKED] + marked
            pieces.clear()
            free = marked = 0

    for t in walk(page):
        if t[0] == "text":
            pieces.append(t[1])
            n = 0 if t[2] else len(t[1].strip())
            free, marked = free + n, marked + (n if t[4] else 0)
        elif t[1] not in INLINE:
            flush()
            if t[0] == "open":
                depth.append(len(stack) <= DEPTH)
                if depth[-1]:
                    stack.append(_element(t[2]))
            elif depth.pop():
                x = stack.pop()
                _added(stack[-1][CHILDREN], x)
    flush()
    return stack[0]


def infer(expressions: Iterable[list]) -> list | None:
    """The wrapper of some expressions, aligned one after another."""
    out = None
    for x in expressions:
        out = x if out is None else merged(out, x)
    return out


def notation(x: list) -> str:
    """A wrapper in writing: # is a slot, $ constant text, + and ? mark what is repeated or optional."""
    inner = " ".join([*(["#"] if x[SLOT] else ["$"] if x[TEXT] is not None else []), *map(notation, x[CHILDREN])])
    return f"{x[PLACE]}({inner})" + "+" * x[REPEATED] + "?" * x[OPTIONAL]


#: Elements that are parts of a text rather than regions.
TEXT_PARTS = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr dd dt blockquote".split())


def _weight(x: list, slots: bool, names: bool) -> int:
    own = (x[FREE] - (x[MARKED] if names else 0)) if x[SLOT] or not slots else 0
    return own + sum(_weight(y, slots, names) for y in x[CHILDREN])


def _deepest(wrapper: list, slots: bool, names: bool) -> list[str]:
    """Path of the deepest element that holds half of the weight, or of the article or main element around it."""
    total, path, at = _weight(wrapper, slots, names), [], wrapper
    while total:
        below = [z for y in at[CHILDREN] for z in ([y] if y[PLACE] else y[CHILDREN])]
        best = max(below, key=lambda y: _weight(y, slots, names), default=None)
        if best is None or 2 * _weight(best, slots, names) < total or best[PLACE].split(".")[0] in TEXT_PARTS:
            break
        path.append(best[PLACE])
        at = best
    for name in ("article", "main"):
        around = [k for k, x in enumerate(path) if x.split(".")[0] == name]
        if around:
            return path[: around[-1] + 1]
    return path


def _at(wrapper: list, path: list[str]) -> list:
    for place in path:
        wrapper = next(z for y in wrapper[CHILDREN] for z in ([y] if y[PLACE] else y[CHILDREN]) if z[PLACE] == place)
    return wrapper


def region(wrapper: list, names: bool = True) -> list[str]:
    """Path of the article region; names break ties, if they are asked."""
    slots = _weight(wrapper, True, False) > 0
    path = _deepest(wrapper, slots, False)
    if names:
        unmarked = _deepest(wrapper, slots and _weight(wrapper, True, True) > 0, True)
        own = _at(wrapper, path)
        if unmarked and (2 * _weight(own, False, True) < _weight(own, False, False) or unmarked[: len(path)] == path):
            return unmarked
    return path


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "little")


def main_text(page: str | None, article: list[str] | None, names: bool = True) -> str:
    """The page's text in the region, without what names mark there; without the region, the page's unmarked text."""
    if not page:
        return ""
    region_text: list[str] = []
    page_text: list[str] = []
    pieces: list[str] = []
    found = False
    state = (False, False)

    def flush() -> None:
        if pieces:
            if text := " ".join(html.unescape("".join(pieces)).split()):
                (region_text if state[0] else page_text).append(text)
            pieces.clear()

    for t in walk(page, article):
        if t[0] == "text":
            if not (t[4] and names):
                if (t[3], t[4]) != state:
                    flush()
                    state = (t[3], t[4])
                pieces.append(t[1])
        elif t[1] not in INLINE:
            flush()
            found = found or t[0] == "open" and t[3]
    flush()
    return "\n".join(region_text if found else page_text)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        made = [json.dumps(expression(x), separators=(",", ":")) for x in pages]
        place = [_hash(x) for x in pages]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(place, pa.int64()), pa.array(made, pa.string())], ["host", "place", "wrapper"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's expressions, which come one after another, as one."""
    held: tuple | None = None
    wrapper: list | None = None
    names = ["host", "place", "wrapper"]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]], pa.int64()), pa.array([json.dumps(wrapper, separators=(",", ":"))], pa.string())], names)

    for batch in batches:
        for key, x in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
            if key != held:
                if held is not None:
                    yield row()
                held, wrapper = key, None
            wrapper = infer([json.loads(x)] if wrapper is None else [wrapper, json.loads(x)])
    if held is not None:
        yield row()


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [json.loads(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([region(x) for x in found], pa.list_(pa.string())), pa.array(map(notation, found), pa.string())], ["host", "article", "wrapper"])


def wrappers(pages: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(host, article, wrapper) of each host, from all its pages: the region's path and the expression in writing."""
    spark = pages.sparkSession
    read = pages.where("html is not null and html <> ''").select(host(F.col("url")).alias("host"), "html")
    now = keep(read.mapInArrow(_expressions, "host string, place long, wrapper string"), "page_expressions")
    # places are hashes: a host's buckets are ranges of them, as many as its pages need
    counts = keep(now.groupBy("host").agg(F.ceil(F.count("*") / bucket).alias("buckets")), "host_buckets")
    n = counts.agg(F.max("buckets")).first()[0] or 1
    now = now.join(small(counts), "host").select("host", F.expr("pmod(place, buckets)").alias("run"), "place", "wrapper")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        aligned_runs = now.repartition(tasks, "host", "run").sortWithinPartitions("host", "run", "place", "wrapper").select("host", "run", "wrapper")
        done = keep(aligned_runs.mapInArrow(_runs, "host string, place long, wrapper string"), "host_wrappers")
        if n <= 1:
            break
        n = -(-n // bucket)
        now = done.select("host", F.expr(f"place div {bucket}").alias("run"), "place", "wrapper")
    return done.select("host", "wrapper").mapInArrow(_regions, "host string, article array<string>, wrapper string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, _ = utf8(batch.column(2))
        for i, j in slices(at):
            part = batch.slice(i, j - i)
            text = [main_text(h, a) for h, a in zip(*(part.column(k).to_pylist() for k in (2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page."""
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    known = keep(wrappers(held).select(F.col("host").alias("h"), "article"), "wrappers")
    # a host may hold a third of the pages: where the table of hosts is small, pages aren't moved
    rows = held.withColumn("host", host(F.col("url"))).join(small(known), F.col("host") == F.col("h"), "left")
    return rows.select("page_id", "url", "html", "article").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
