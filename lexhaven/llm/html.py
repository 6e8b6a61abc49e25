"""Main text of web pages by template deduction over the pages of a host.

A page becomes a row of tokens: start and end of each element, each place of a text, each text,
told apart by the path of the element. Tokens of one host that occur in the same pages equally
often have equal occurrence vectors and form an equivalence class, if they are enough and
frequent enough (Arasu and Garcia-Molina, 2003). A class is valid if its tokens come in one order,
again and again, and it is nested: it crosses no other class, and all of it lies at one place
between two tokens of the class around it. A class of several orders is broken into runs of one
order. Tokens are then told apart by their place in the classes, and classes found anew. What is
left at last is the nested template of the host. The pages of a host that have the same frame of
named elements are a layout, and a layout has a template of its own besides. Vectors, orders and
places are compared by numbers that sum up page by page, so the pages of a host, however many,
never meet in one task.

What the templates leave open are slots, and their text is the page's own. The article lies in the
slots of one element of the template: the smallest that each page has once and that holds half of
the text in slots. Markup is a check on that: where a page marks its main part (article, main and
their like), the text is that of the marked part, also if the element found is another; a passage
stays though it is on every page. Elsewhere all slots stay and text of the template goes. Menus,
headers, footers, side bars, notices, adverts, forms, scripts and comments of readers are known
by element, role or class name and go in either case.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.llm.common import batches_of, signed, work_folder, written

# Elements without content, elements that break a line of text, elements left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
OUT = frozenset(
    "head title style script noscript template nav footer aside form button select option textarea dialog "
    "menu iframe object svg canvas audio video map".split()
)
RAW = re.compile(r"<(script|style|textarea|title|noscript|template|iframe|xmp)\b", re.I)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUT_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer masthead sidebar side aside "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus respond reply replies share sharing social related recommended recommendations trending "
    "widget toolbar skip".split()
)
MAIN_WORDS = frozenset({"articlebody"})
# A template token is on so many pages, and on this share of its host's or its layout's.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
# Tokens that a class of the template has at least.
LEAST_TOKENS = 2
# Times that classes are found, each time with tokens told apart by the classes before.
ROUNDS = 2
# The element of the article holds at least this share of the text in slots.
ARTICLE_SHARE = 0.5

# Kinds of tokens, their last two bits.
START, END, PLACE, TEXT = range(4)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")


class Element:
    """An open element: its name in the path, whether its text is left out, whether it is the main part."""

    __slots__ = ("tag", "path", "token", "out", "main")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        found: dict[str, str] = {}
        if attributes and not attributes.isspace():
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), (a or b or c or "").lower())
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        role, kind = found.get("role", ""), found.get("itemprop", "")
        self.tag = tag
        own_path = f"/{tag}" + (f".{names}" if names else "")
        self.path = (parent.path if parent else "") + own_path
        self.token = _token(own_path, parent.token if parent else 0)
        words = set(_PARTS.findall(names))
        out = (
            tag in OUT or role in OUT_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
            or (tag not in ("html", "body", "main") and bool(words & OUT_WORDS))
        )
        main = tag == "article" or tag == "main" or role in ("main", "article") or kind in MAIN_WORDS
        inside = 0 if parent is None else parent.main
        # The innermost of article and main counts; 2 for an article, 1 for a main part.
        own = 2 if tag == "article" or role == "article" or kind in MAIN_WORDS else 1 if main else 0
        out = out or (tag == "header" and not inside)
        # A main part within what is left out by name is still a main part, but not a reader's comment.
        self.out = out if own > inside and not out else (parent.out if parent else False) or out
        self.main = max(inside, own)


_shared = lru_cache(4096)(Element)


def element_of(tag: str, attributes: str, parent: Element | None) -> Element:
    """An element, which pages share if its path is short."""
    if attributes and not _ATTRIBUTE.search(attributes):
        attributes = ""
    return _shared(tag, attributes, parent) if not parent or len(parent.path) < 500 else Element(tag, attributes, parent)


def events(page: str) -> list[tuple[int, int, Element | None, str]]:
    """Starts, ends and blocks of text of a page in order: kind, token, element, text.

    Elements within a line have no start and end of their own.
    """
    out: list[tuple[int, int, Element | None, str]] = []
    stack: list[Element] = []
    text: list[str] = []
    where: Element | None = None

    def flush() -> None:
        nonlocal text
        if text:
            line = " ".join(markup.unescape("".join(text)).split())
            if line:
                out.append((TEXT, where.token if where else 0, where, line))
            text = []

    def write(part: str) -> None:
        nonlocal where
        if part:
            if not text:
                where = stack[-1] if stack else None
            text.append(part)

    def close(depth: int) -> None:
        out.extend((END, e.token, e, "") for e in reversed(stack[depth:]) if e.tag not in INLINE)
        del stack[depth:]

    at = 0
    while found := _TAG.search(page, at):
        write(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing = bool(found[1] or found[4])
        if tag == "br":
            write(" ")
        if tag not in INLINE:
            flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].tag == tag:
                    if tag in INLINE and any(e.tag not in INLINE for e in stack[depth:]):
                        break
                    if any(e.out != stack[depth].out or e.main != stack[depth].main for e in stack[depth:]):
                        flush()
                    close(depth)
                    break
            continue
        if tag in VOID:
            continue
        attributes = found[3] or found[6] or ""
        if tag not in INLINE:
            # A block ends an open paragraph; an item ends the one before.
            for depth in range(len(stack) - 1, -1, -1):
                name = stack[depth].tag
                if name == "p" or (name == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th")):
                    close(depth)
                    break
                if name not in INLINE:
                    break
        element = element_of(tag, attributes, stack[-1] if stack else None)
        if element.out and tag in INLINE and not (stack and stack[-1].out):
            flush()
        if attributes.endswith("/") and tag not in INLINE:
            continue
        if RAW.match(page, found.start()):
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        stack.append(element)
        if tag not in INLINE:
            out.append((START, element.token, element, ""))
    write(page[at:])
    flush()
    close(0)
    return out


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _token(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed)


def layout_of(paths: set[str]) -> int:
    """The frame of a page: its paths up to the last element with a name, numbers left out.

    A page without names has all its paths as its frame.
    """
    frames, plain = set(), set()
    for path in paths:
        parts = [p for p in path.split("/")[1:] if p.partition(".")[0] not in INLINE]
        plain.add("/".join(parts))
        named = max((n for n, p in enumerate(parts, 1) if "." in p), default=0)
        if named:
            frames.add(re.sub(r"\d+", "", "/".join(parts[:named])))
    return _token("\n".join(sorted(frames or plain)))


def parsed(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", texts: bool = True) -> DataFrame:
    """Per page: key, url, host, layout, tokens in order; with `texts` its blocks of text, else their sizes and a hash of all.

    Of a block that is not left out, `places` has that of its token, `texts` the text and `mains` the kind of main part it is in.
    """
    source = df.select(df[key].alias("key"), df[url].alias("url"), df[html].alias("text"))
    key_type = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch):
                hosts, layouts, tokens, contents, sizes, blocks = [], [], [], [], [], ([], [], [])
                for address, page in zip(part.column("url").to_pylist(), part.column("text").to_pylist(), strict=True):
                    row, paths, lengths, found = [], set(), [], ([], [], [])
                    for kind, token, where, text in events(page or ""):
                        if kind != TEXT:
                            row.append(token & ~3 | kind)
                            continue
                        row += token & ~3 | PLACE, _token(text, token) & ~3 | TEXT
                        paths.add(where.path if where else "")
                        lengths.append(len(text))
                        if where is None or not where.out:
                            for values, value in zip(found, (len(row) - 1, text, where.main if where else 0), strict=True):
                                values.append(value)
                    numbers = signed(np.array(row, np.uint64))
                    hosts.append(host_of(address))
                    layouts.append(layout_of(paths))
                    tokens.append(numbers)
                    if texts:
                        for column, values in zip(blocks, found, strict=True):
                            column.append(values)
                    else:
                        contents.append(xxhash.xxh3_64_intdigest(numbers.tobytes()))
                        sizes.append(lengths)
                more = {
                    "places": pa.array(blocks[0], pa.list_(pa.int32())), "texts": pa.array(blocks[1], pa.list_(pa.string())),
                    "mains": pa.array(blocks[2], pa.list_(pa.int32())),
                } if texts else {
                    "content": pa.array(signed(np.array(contents, np.uint64))), "sizes": pa.array(sizes, pa.list_(pa.int32())),
                }
                yield pa.RecordBatch.from_pydict({
                    "key": part.column("key"), "url": part.column("url"), "host": pa.array(hosts, pa.string()),
                    "layout": pa.array(signed(np.array(layouts, np.uint64))), "tokens": pa.array(tokens, pa.list_(pa.int64())), **more,
                })

    return source.mapInArrow(
        run,
        f"key {key_type}, url string, host string, layout long, tokens array<long>, "
        + ("places array<int>, texts array<string>, mains array<int>" if texts else "content long, sizes array<int>"),
    )


def classes(each: DataFrame, hosts: DataFrame) -> DataFrame:
    """Frequent tokens of each host by equal occurrence vectors: `(host, class, pages, tokens)`.

    Takes `(host, content, token, count)` of different pages, content being a number for the page, and
    `(host, all_pages)`. Class 0 has the tokens of classes that are too small. Only tokens on at least
    half of a host's pages are frequent, so a host has at most twice as many as a page has on average.
    """
    place = F.xxhash64("content", "count")
    # Halves are summed, as the sum of whole hashes would overflow.
    vectors = each.groupBy("host", "token").agg(
        F.count("*").alias("pages"),
        F.struct(F.sum(place.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(place, 32)).alias("high")).alias("vector"),
    )
    frequent = vectors.join(hosts, "host").where(
        (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * F.col("all_pages"))
    )
    found = frequent.groupBy("host", "pages", "vector").agg(F.collect_list("token").alias("tokens"))
    number = F.when(F.size("tokens") >= LEAST_TOKENS, F.xxhash64("pages", "vector")).otherwise(F.lit(0))
    return found.select("host", number.alias("class"), "pages", "tokens")


def templates(pages: DataFrame) -> DataFrame:
    """Tokens of each host's classes, before their order is known: `(host, template)`.

    Pages of one host with the same tokens count once, however many they are.
    """
    content = F.xxhash64(F.array_sort(F.arrays_zip("tokens", "counts")))
    different = pages.select("host", "tokens", "counts", content.alias("content")).dropDuplicates(["host", "content"])
    each = different.select("host", "content", F.explode(F.arrays_zip("tokens", "counts")).alias("t")).select(
        "host", "content", F.col("t.tokens").alias("token"), F.col("t.counts").alias("count")
    )
    found = classes(each, different.groupBy("host").agg(F.count("*").alias("all_pages")))
    return found.where("class != 0").groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))


# What a round knows of a host's frequent tokens: run of one order, place in a valid class (-1: in none), size of the class.
Known = dict[int, tuple[int, int, int]]


@lru_cache(1 << 16)
def _mixed(a: int, b: int) -> int:
    x = ((a ^ 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    x = x * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


def roles(tokens: list[int], rounds: list[Known]) -> list[int]:
    """Tokens told apart by run and by place in the classes of each round; 0 for those too rare to be in a class."""
    for known in rounds:
        # Open classes with the place within them and all those around.
        opened: list[tuple[int, int, int]] = []
        out = []
        for token in tokens:
            found = known.get(token)
            if found is None:
                out.append(0)
                continue
            run, at, size = found
            own = at > 0 and bool(opened) and opened[-1][0] == run and opened[-1][1] == at - 1
            if own:
                opened.pop()
            place = opened[-1][2] if opened else 0
            if 0 <= at < size - 1 and (own or at == 0):
                opened.append((run, at, _mixed(_mixed(run, at), place)))
            out.append(_mixed(_mixed(token, run), place) if run or place else token)
        tokens = out
    return tokens


def checked(tokens: list[int], of: dict[int, int], size: dict[int, int], pages: dict[int, int]) -> Iterator[tuple[int, ...]]:
    """What a page says of classes: token, class, token before it in the class (0: none), whether invalid, least and greatest place.

    A class is invalid if its tokens do not come in one order again and again, or if it crosses a stronger class.
    """
    seen = defaultdict(list)
    for token in tokens:
        if token in of:
            seen[of[token]].append(token)
    orders = {}
    for c, found in seen.items():
        order = found[: size[c]]
        if len(set(order)) == size[c] and found == order * (len(found) // size[c]):
            orders[c] = {t: i for i, t in enumerate(order)}
    strength = lambda c: (size[c], pages[c], c)
    opened: list[tuple[int, int]] = []
    crossed, places = set(), defaultdict(set)
    for token in tokens:
        c = of.get(token)
        if c not in orders or c in crossed:
            continue
        at = orders[c][token]
        while at and opened[-1][0] != c:
            weaker = min(c, opened[-1][0], key=strength)
            crossed.add(weaker)
            if weaker == c:
                opened = [o for o in opened if o[0] != c]
                break
            opened.pop()
        if c in crossed:
            continue
        if at:
            opened.pop()
        else:
            places[c].add(_mixed(*opened[-1]) if opened else 0)
        if at < size[c] - 1:
            opened.append((c, at))
    for c, found in seen.items():
        invalid = c not in orders or c in crossed
        low, high = (min(places[c]), max(places[c])) if places[c] else (0, 0)
        for i, token in enumerate(found[: size[c]] if c in orders else set(found)):
            yield token, c, found[i - 1] if i and c in orders else 0, invalid, low, high


def settled(tokens: list[dict], last: bool) -> Iterator[tuple[int, int, int, int]]:
    """From what all pages say of a host's classes: token, run, place in a valid class, its size.

    A class of several orders is broken into runs of one order, which the next round takes for classes; the last round drops it.
    """
    members = defaultdict(list)
    for t in tokens:
        members[t["class"]].append(t)
    for c, found in members.items():
        nested = not last or all(t["low_place"] == t["high_place"] for t in found)
        if not c or any(t["invalid"] for t in found) or not nested:
            yield from ((t["token"], 0, -1, 0) for t in found)
            continue
        after = {t["low"]: t["token"] for t in found if t["low"] and t["low"] == t["high"]}
        runs = []
        for t in found:
            if not t["low"] or t["low"] != t["high"]:
                run = [t["token"]]
                while run[-1] in after:
                    run.append(after[run[-1]])
                runs.append(run)
        for run in runs:
            if len(runs) == 1:
                yield from ((t, c, i, len(run)) for i, t in enumerate(run))
            else:
                yield from ((t, 0 if last else _mixed(c, run[0]), -1, 0) for t in run)


def elements(tokens: list[int], named: list[int], known: Known, sizes: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Elements of the template in a page, and 0 for the page: role, characters in its slots, depth, how often it comes."""
    held = [t in known and known[t][1] >= 0 for t in named]
    left, chars = iter(sizes), 0
    opened: list[tuple[int, int, bool]] = []
    found = []
    for token, role, fixed in zip(tokens, named, held, strict=True):
        kind = token & 3
        if kind == START:
            opened.append((role, chars, fixed))
        elif kind == END:
            role, before, begun = opened.pop()
            if fixed and begun:
                found.append((role, chars - before, len(opened)))
        elif kind == TEXT:
            size = next(left)
            chars += 0 if fixed else size
    times = Counter(f[0] for f in found)
    yield 0, chars, 0, 1
    yield from ((*f, times[f[0]]) for f in found)


def _known(rounds: list[list[dict]]) -> list[Known]:
    return [{t["token"]: (t["run"], t["at"], t["size"]) for t in known} for known in rounds]


def _kept(kept: dict, host: str, read: Callable, *columns: pa.Array) -> object:
    """What is read from columns that are the same for all pages of a host, once for each host that a task meets."""
    if host not in kept:
        if len(kept) >= 100:
            kept.clear()
        kept[host] = read(*(c.as_py() for c in columns))
    return kept[host]


def _rows(df: DataFrame, names: list[str], own: list[str], each: Callable, shared: tuple[str, ...] = (), read: Callable = tuple) -> DataFrame:
    """Rows of numbers that `each` gives for a row's own columns and what is read from those its host shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hosts, counts, rows = part.column("host").to_pylist(), [], []
                for i, values in enumerate(zip(*(part.column(n).to_pylist() for n in own), strict=True)):
                    before = len(rows)
                    rows += each(*values, *_kept(kept, hosts[i], read, *(part.column(n)[i] for n in shared)))
                    counts.append(len(rows) - before)
                whole = np.array(rows, np.int64).reshape(len(rows), len(names))
                host = part.column("host").take(pa.array(np.repeat(np.arange(len(hosts)), counts)))
                yield pa.RecordBatch.from_arrays([host, *(pa.array(np.ascontiguousarray(c)) for c in whole.T)], ["host", *names])

    return df.select("host", *own, *shared).mapInArrow(run, "host string, " + ", ".join(f"{n} long" for n in names))


def _layout() -> Column:
    return F.concat_ws("\0", "host", F.col("layout").cast("string"))


def nested(different: DataFrame, folder: str) -> DataFrame:
    """Nested template of each host, and of each layout of hosts with several: `(host, rounds, article)`.

    Takes the different pages of `parsed`. Tables between steps have a row for a host. A round has the
    host's frequent tokens; the template is the valid ones of the last. The article is the role of
    its element in that, NULL if there is none.
    """
    layouts = written(different.groupBy("host").agg((F.min("layout") != F.max("layout")).alias("several")), f"{folder}/layouts")
    groups = F.when(F.col("several"), F.array("host", _layout())).otherwise(F.array("host"))
    pages = different.join(layouts, "host").select(F.explode(groups).alias("host"), "content", "tokens", "sizes")
    hosts = written(pages.groupBy("host").agg(F.count("*").alias("all_pages")).where(F.col("all_pages") >= LEAST_PAGES), f"{folder}/hosts")
    rounds = hosts.select("host", F.array().cast("array<array<struct<token:long,run:long,at:long,size:long>>>").alias("rounds"))

    def counted(content: int, tokens: list[int], rounds: list[Known]) -> list[tuple[int, int, int]]:
        # Runs of a broken class have pages of their own numbers, so that they are not one class again.
        runs = [content] * len(tokens)
        for known in rounds:
            broken = {t: run for t, (run, at, _) in known.items() if run and at < 0}
            runs = [_mixed(r, broken[t]) if t in broken else r for t, r in zip(tokens, runs, strict=True)]
            tokens = roles(tokens, [known])
        return [(run, t, n) for (run, t), n in Counter(zip(runs, tokens, strict=True)).items() if t]

    def members(rounds: list[list[dict]], found: list[dict]) -> tuple:
        valid = [c for c in found if c["class"]]
        return (
            _known(rounds), {t: c["class"] for c in valid for t in c["tokens"]},
            {c["class"]: len(c["tokens"]) for c in valid}, {c["class"]: c["pages"] for c in valid},
        )

    for n in range(ROUNDS):
        held = pages.join(rounds, "host")
        each = _rows(held, ["content", "token", "count"], ["content", "tokens"], counted, ("rounds",), lambda r: (_known(r),))
        found = written(classes(each, hosts), f"{folder}/classes{n}")
        by_host = found.groupBy("host").agg(F.collect_list(F.struct("class", "pages", "tokens")).alias("found"))
        said = _rows(
            held.join(by_host, "host"), ["token", "class", "before", "invalid", "low_place", "high_place"], ["tokens"],
            lambda tokens, rounds, *found: checked(roles(tokens, rounds), *found), ("rounds", "found"), members,
        ).groupBy("host", "token", "class").agg(
            F.min("before").alias("low"), F.max("before").alias("high"), F.max("invalid").alias("invalid"),
            F.min("low_place").alias("low_place"), F.max("high_place").alias("high_place"),
        )
        all_said = said.groupBy("host").agg(F.collect_list(F.struct("token", "class", "low", "high", "invalid", "low_place", "high_place")).alias("said"))
        last = n == ROUNDS - 1
        in_classes = _rows(all_said, ["token", "run", "at", "size"], ["said"], lambda said, last=last: settled(said, last))
        alone = found.where("class = 0").select("host", F.explode("tokens").alias("token"), F.expr("0L run"), F.expr("-1L at"), F.expr("0L size"))
        known = in_classes.union(alone).groupBy("host").agg(F.collect_list(F.struct("token", "run", "at", "size")).alias("known"))
        rounds = written(rounds.join(known, "host").select("host", F.concat("rounds", F.array("known")).alias("rounds")), f"{folder}/rounds{n}")

    sums = _rows(
        pages.join(rounds, "host"), ["role", "chars", "depth", "times"], ["tokens", "sizes"],
        lambda tokens, sizes, *rounds: elements(tokens, roles(tokens, rounds[:-1]), rounds[-1], sizes), ("rounds",), _known,
    ).groupBy("host", "role").agg(F.sum("chars").alias("chars"), F.max("depth").alias("depth"), F.max("times").alias("times"), F.count("*").alias("pages"))
    sums = written(sums, f"{folder}/elements")
    whole = sums.where("role = 0").select("host", F.col("chars").alias("all_chars"), F.col("pages").alias("all_pages"))
    once = sums.where("role != 0 AND times = 1").join(whole, "host").where(
        (F.col("pages") == F.col("all_pages")) & (F.col("chars") > 0) & (F.col("chars") >= ARTICLE_SHARE * F.col("all_chars"))
    )
    article = once.groupBy("host").agg(F.min_by("role", F.struct("chars", -F.col("depth"), "role")).alias("article"))
    return written(rounds.join(article, "host", "left"), f"{folder}/templates")


def fixed(tokens: list[int], named: list[int], known: Known) -> set[int]:
    """Places of a page's texts that are the template's."""
    return {i for i, (t, role) in enumerate(zip(tokens, named, strict=True)) if t & 3 == TEXT and role in known and known[role][1] >= 0}


def inside(tokens: list[int], named: list[int], role: int | None) -> range:
    """Places from start to end of the one element of a role, none if there is not one."""
    if role is None or named.count(role) != 1:
        return range(0)
    at = named.index(role)
    depth = 0
    for i in range(at, len(tokens)):
        depth += {START: 1, END: -1}.get(tokens[i] & 3, 0)
        if not depth:
            return range(at, i)
    return range(0)


def text_of(
    tokens: list[int], places: list[int], texts: list[str], mains: list[int], templates: list[tuple[list[Known], int | None]]
) -> tuple[str, bool]:
    """Text of a page by the templates of its host and layout, and whether an element of a template gave the marked part."""
    held, article = set(), range(0)
    for rounds, role in templates:
        named = roles(tokens, rounds[:-1])
        held |= set() if any(mains) else fixed(tokens, named, rounds[-1])
        article = inside(tokens, named, role) or article
    if best := max(mains, default=0):
        located = [i for i, at in enumerate(places) if at in article]
        # The exact check: what the page marks.
        marked = [i for i, main in enumerate(mains) if main >= best]
        return " ".join(texts[i] for i in (located if located == marked else marked)), located == marked
    left = [text for at, text in zip(places, texts, strict=True) if at not in held]
    return " ".join(left or texts), False


def main_text(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Per page: key, url, text (empty if none), located (the template's article is what the page marks).

    A NULL or empty page has an empty text. Pages whose address has no host, or is NULL, share
    the host of no name. Repeated rows give a row each. A page that is all template keeps its
    text. Other columns take no part; an empty table gives no rows.
    """
    folder = work_folder(df.sparkSession)
    different = parsed(df, html, url, key, texts=False).select("host", "layout", "content", "tokens", "sizes").dropDuplicates(["host", "content"])
    found = nested(written(different, f"{folder}/different"), folder)
    pages = parsed(df, html, url, key).withColumn("layout", _layout())
    for name in ("host", "layout"):
        pages = pages.join(found.select(F.col("host").alias(name), F.col("rounds").alias(f"of_{name}"), F.col("article").alias(f"{name}_article")), name, "left")

    own = ("tokens", "places", "texts", "mains")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = {n: part.column(n) for n in part.schema.names}
                out = []
                for i, (host, layout, *page) in enumerate(zip(*(column[n].to_pylist() for n in ("host", "layout", *own)), strict=True)):
                    of = [
                        _kept(kept, name, lambda r, a: (_known(r), a), column[f"of_{kind}"][i], column[f"{kind}_article"][i])
                        for kind, name in (("host", host), ("layout", layout)) if column[f"of_{kind}"][i].is_valid
                    ]
                    out.append(text_of(*page, of))
                texts, located = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [column["key"], column["url"], pa.array(texts, pa.string()), pa.array(located, pa.bool_())], [key, "url", "text", "located"]
                )

    rows = pages.select("key", "url", "host", "layout", *own, "of_host", "host_article", "of_layout", "layout_article")
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, url string, text string, located boolean")
