"""HTML extraction by wrappers: union-free regular expressions inferred from pages of the same host.

A page is a stream of structure tags and texts. The streams of a host are aligned one after the other: adjacent equals become repeated
groups, what only some pages have becomes optional, texts become slots. Slots are labelled by where they stand in the wrapper; a page
is then aligned with the wrapper of its host and gives its texts to the slots.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Generator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, shared_folder, stored
from .url_rules import url_host

#: About so many wrappers of a host are aligned by one task.
MERGED = 16
#: Lists of parts whose lengths multiply to more are aligned by the next equal key instead of the longest common sequence.
LONG = 1_000_000
#: Longest run of different elements that is tried as a repeated group.
GROUP = 4

# Element names of HTML, and words that name parts of a page beside its article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style noscript template textarea title iframe svg math select object".split())
ENDS_P = set("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}
BESIDE_TAGS = set("nav footer aside form head button dialog menu header".split()) | RAW
BESIDE_WORDS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header "
                   "login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related reply replies respond search "
                   "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Boxes marked by these never hold the article; boxes marked by the other words may be layout around it.
NEVER_AROUND = set("comment comments disqus footer nav navbar navigation reply replies respond".split())
ARTICLE_WORDS = {"articlebody", "article", "main"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:"[^"]*"|'[^']*'|[^>"'])*+)>|([^>]*)(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """An element of a page; children are nodes and texts, in order."""

    __slots__ = ("name", "key", "children")

    def __init__(self, name: str, key: str):
        self.name, self.key, self.children = name, key, []


def parse(page: str) -> Node:
    """Structure of a page. Inline tags vanish, other tags end a text; unclosed and stray tags are mended as browsers do, roughly."""
    root = Node("", "")
    stack, text, at = [root], [], 0

    def flush():
        joined = html.unescape("".join(text))
        text.clear()
        block = " ".join(joined.split())
        if block:
            stack[-1].children.append(block)

    def close(index: int):
        flush()
        del stack[index:]

    while True:
        m = _TAG.search(page, at)
        text.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                text.append(" " if name == "br" else "")
            continue
        names = [n.name for n in stack]
        if m[1]:
            if name in names:
                close(len(names) - 1 - names[::-1].index(name))
            else:
                flush()
            continue
        flush()
        if name == "body" and "body" in names or name == "html" and "html" in names:
            continue
        if "head" in names and name not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            close(names.index("head"))
            names = [n.name for n in stack]
        for ends in ([("p",)] if name in ENDS_P else []) + [SIBLINGS.get(name, ())]:
            scope = max([i for i, x in enumerate(names) if x in SCOPES.get(name, ())], default=0)
            inside = [i for i in range(scope, len(names)) if names[i] in ends]
            if inside:
                close(inside[0])
                names = [n.name for n in stack]
        attributes = m[3] or m[4] or ""
        marks = sorted({w for _, v in _NAMES.findall(attributes) for w in _WORDS.findall(v.lower())}) if "=" in attributes else []
        node = Node(name, ".".join([name, *marks]))
        stack[-1].children.append(node)
        if name in RAW:  # what is inside is no markup
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not attributes.endswith("/"):
            stack.append(node)
    close(1)
    return root


# Parts of a wrapper: {"k": key, "opt": bool, "rep": bool} with "c": parts (element), "g": parts (group) or "t": texts seen, "n": pages (slot).


def drive(walk: Generator) -> list[dict]:
    """Result of a walk that yields the walks it needs the results of: nesting takes a list, not Python's stack."""
    stack, value = [walk], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def parts_of(children: list[Node | str]) -> Generator:
    out = []
    for child in children:
        if isinstance(child, str):
            out.append({"k": "", "opt": False, "rep": False, "t": [hash_text(child)], "n": 1})
        else:
            out.append({"k": child.key, "opt": False, "rep": False, "c": (yield parts_of(child.children))})
    return (yield fold(out))


def hash_text(text: str) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))


def merge(a: dict, b: dict, same_page: bool = False) -> Generator:
    """Both parts have the same key."""
    out = {"k": a["k"], "opt": a["opt"] or b["opt"], "rep": a["rep"] or b["rep"]}
    if "t" in a:
        return out | {"t": sorted({*a["t"], *b["t"]})[:2], "n": max(a["n"], b["n"]) if same_page else a["n"] + b["n"]}
    if "g" in a:
        return out | {"g": (yield merge_all(a["g"], b["g"], same_page))}
    return out | {"c": (yield align(a["c"], b["c"], same_page))}


def merge_all(a: list[dict], b: list[dict], same_page: bool) -> Generator:
    out = []
    for x, y in zip(a, b):
        out.append((yield merge(x, y, same_page)))
    return out


def shape(part: dict) -> tuple:
    """Key, and for an element the keys of its parts. Repeated parts look alike, or are empty."""
    return part["k"], tuple(p["k"] for p in part.get("c", ()))


def alike(a: list[dict], b: list[dict]) -> bool:
    return len(a) == len(b) and all(x["k"] == y["k"] and (x.get("c") == [] or y.get("c") == [] or shape(x) == shape(y)) for x, y in zip(a, b))


def fold(parts: list[dict]) -> Generator:
    """Adjacent runs of the same elements become one repeated part or group."""
    for length in range(1, GROUP + 1):
        out: list[dict] = []
        i = 0
        while i < len(parts):
            run = parts[i : i + length]
            keys = [p["k"] for p in run]
            times = 1
            while len(run) == length and alike(run, parts[i + times * length : i + (times + 1) * length]):
                run = yield merge_all(run, parts[i + times * length : i + (times + 1) * length], True)
                times += 1
            if times == 1:
                out.append(parts[i])
                i += 1
            else:
                out.append(run[0] | {"rep": True} if length == 1 else {"k": "(" + " ".join(keys) + ")", "opt": False, "rep": True, "g": run})
                i += times * length
        parts = out
    return parts


def align(a: list[dict], b: list[dict], same_page: bool = False) -> Generator:
    """Longest common sequence of keys; what only one side has becomes optional."""
    if [p["k"] for p in a] == [p["k"] for p in b]:
        return (yield merge_all(a, b, same_page))
    if len(a) * len(b) > LONG:
        return (yield align_long(a, b, same_page))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["k"] == b[j]["k"] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i]["k"] == b[j]["k"]:
            out.append((yield merge(a[i], b[j], same_page)))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i] | {"opt": True})
            i += 1
        else:
            out.append(b[j] | {"opt": True})
            j += 1
    return (yield fold(out))


def align_long(a: list[dict], b: list[dict], same_page: bool) -> Generator:
    """A common sequence of keys in about linear time: each part of ``b`` takes the next one of ``a`` with its key."""
    where: dict[str, list[int]] = {}
    for i, p in enumerate(a):
        where.setdefault(p["k"], []).append(i)
    out, i = [], 0
    for q in b:
        own = where.get(q["k"], [])
        at = bisect_left(own, i)
        if at == len(own):
            out.append(q | {"opt": True})
            continue
        out += [p | {"opt": True} for p in a[i : own[at]]]
        out.append((yield merge(a[own[at]], q, same_page)))
        i = own[at] + 1
    return (yield fold(out + [p | {"opt": True} for p in a[i:]]))


def infer(pages: list[str]) -> list[dict]:
    """Wrapper of pages of a host, labelled."""
    wrapper: list[dict] | None = None
    for page in pages:
        parts = drive(parts_of(parse(page).children))
        wrapper = parts if wrapper is None else drive(align(wrapper, parts))
    return label(wrapper or [], 1)


BESIDE, BODY, ARTICLE, MARKED = 0, 1, 3, 4


def place(key: str, outer: int) -> int:
    """Where the texts of an element stand: beside the article, in the body, in the main part (2) or in the article.

    Outside of articles, a box that a word of its class marks adds MARKED: its texts count if it holds most of the page's text.
    """
    name, *marks = key.split(".")
    if outer == BESIDE:
        return BESIDE
    # classes of the page or of the article as a whole ("no-sidebar", "comments-open") say nothing of their place
    beside = name in BESIDE_TAGS or name not in ("html", "body", "main", "article") and not BESIDE_WORDS.isdisjoint(marks)
    if beside and not (outer % MARKED == ARTICLE and (name == "header" or set(marks) & BESIDE_WORDS == {"header"} and name not in BESIDE_TAGS)):
        if outer % MARKED == ARTICLE or name in BESIDE_TAGS or not NEVER_AROUND.isdisjoint(marks):
            return BESIDE
        outer += MARKED
    if name == "article" or "articlebody" in marks:
        return outer - outer % MARKED + ARTICLE
    return outer - outer % MARKED + max(outer % MARKED, 2) if name == "main" or not ARTICLE_WORDS.isdisjoint(marks) else outer


def label(parts: list[dict], outer: int) -> list[dict]:
    """Slots get "at", and "box" that tells marked boxes apart."""
    todo = [(p, outer) for p in parts]
    while todo:
        p, outer = todo.pop()
        if "t" in p:
            p["at"], p["box"] = BESIDE if outer >= MARKED else outer, outer
        elif "g" in p:
            todo += [(q, outer) for q in p["g"]]
        else:
            inner = place(p["k"], outer)
            todo += [(q, inner) for q in p["c"]]
    return parts


def dumps(parts: list[dict]) -> str:
    """JSON of a labelled wrapper as a flat list: each part with how many parts below follow it."""
    flat, todo = [], parts[::-1]
    while todo:
        p = todo.pop()
        kind = "g" if "g" in p else "c" if "c" in p else "t"
        flat.append({k: v for k, v in p.items() if k not in ("g", "c")} | ({} if kind == "t" else {kind: len(p[kind])}))
        todo += p.get(kind, [])[::-1] if kind != "t" else []
    return json.dumps(flat)


def loads(content: str) -> list[dict]:
    done: list[dict] = []  # from the end: what is below a part has been read when the part comes
    for p in reversed(json.loads(content)):
        for kind in ("g", "c"):
            if kind in p:
                n = p[kind]
                p[kind] = done[len(done) - n :][::-1]
                del done[len(done) - n :]
        done.append(p)
    return done[::-1]


class Matcher:
    """The parts below an element in order, found by key: inside a repeated part or group its next or again its first, else further on."""

    def __init__(self, parts: list[dict]):
        self.where: dict[str, list[int]] = {}
        self.flat: list = []
        self.group: list[tuple[int, int]] = []  # of each part: the repeated run [first, after) that it is in
        for p in parts:
            first, own = len(self.flat), self._leaves(p)
            for q in own:
                self.where.setdefault(q["k"], []).append(len(self.flat))
                self.flat.append(q["box"] if "t" in q else q["c"])
            self.group += [(first, len(self.flat)) if p["rep"] else (i, i) for i in range(first, len(self.flat))]

    def below(self, i: int) -> Matcher:
        """Made when a page first needs it."""
        if not isinstance(self.flat[i], Matcher):
            self.flat[i] = Matcher(self.flat[i])
        return self.flat[i]

    def _leaves(self, part: dict) -> list[dict]:
        return [q for p in part["g"] for q in self._leaves(p)] if "g" in part else [part]

    def next(self, key: str, last: int) -> int | None:
        """``last``: the part of the child before, -1 for none."""
        found = self.where.get(key)
        if found is None:
            return None
        i = bisect_left(found, last + 1)
        first, after = self.group[last] if last >= 0 else (0, 0)
        if first < after and (i == len(found) or found[i] >= after):
            again = bisect_left(found, first)
            if again < len(found) and found[again] < after:
                return found[again]
        return found[min(i, len(found) - 1)]


def slot_hash(path: int, key: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), path)


def texts(node: Node, matcher: Matcher | None, outer: int, out: list[tuple[int, str, int]]) -> None:
    """Texts below a node with their labels; what the wrapper doesn't have is labelled as an optional part there would be. Third: the slot, by the path of keys."""
    todo = [(node, matcher, outer, 0, -1, 0)]
    while todo:
        node, matcher, outer, i, at, path = todo.pop()
        while i < len(node.children):
            child = node.children[i]
            i += 1
            text = isinstance(child, str)
            found = matcher.next("" if text else child.key, at) if matcher else None
            at = at if found is None else found
            if text:
                out.append((outer if found is None else matcher.flat[found], child, path))
            else:
                todo.append((node, matcher, outer, i, at, path))
                todo.append((child, None if found is None else matcher.below(found), place(child.key, outer), 0, -1, slot_hash(path, child.key)))
                break


def main_text(page: str | None, matcher: Matcher | None, template: frozenset[str] = frozenset()) -> str:
    """Blocks of the innermost kind of place that the page has: articles, else the main part, else the body.

    Without an article outside of marked boxes, texts in as many boxes as hold at least half of what stands there or deeper count.
    """
    found: list[tuple[int, str, int]] = []
    texts(parse(page or ""), matcher, BODY, found)
    if template:  # a page that would have nothing left keeps its texts
        own = [t for t in found if t[0] % MARKED == ARTICLE or f"{slot_hash(t[2], t[1]):x}" not in template]
        found = own if any(at for at, _, _ in own) else found
    sizes: dict[int, int] = {}
    for at, block, _ in found:
        if at:
            sizes[at] = sizes.get(at, 0) + len(block)
    best, left = ARTICLE if ARTICLE in sizes else BESIDE, sum(sizes.values())
    for marked in sorted({at // MARKED for at in sizes} if not best else ()):
        own = {at: size for at, size in sizes.items() if at // MARKED == marked}
        if 2 * sum(own.values()) >= left:
            best = max(own)
            break
        left -= sum(own.values())
    return "\n".join(block for at, block, _ in found if at == best) if best else ""


def combine(wrappers: list[list[dict]]) -> str:
    """JSON of the labelled wrapper that all of these align to. It names no texts, so that pages of the same structure give the same one."""
    out = wrappers[0]
    for w in wrappers[1:]:
        out = drive(align(out, w))
    todo = list(label(out, 1))
    while todo:
        p = todo.pop()
        if "t" in p:
            p["t"], p["n"] = [], 0
        todo += p.get("g", []) + p.get("c", [])
    return dumps(out)


def fit_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON): from all pages of a host, whatever their length. Pages that come together are aligned where they are; then different
    wrappers of a host are aligned, about MERGED at a time, until one is left."""
    rows = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("html is not null")

    def first():
        def run(batch):
            own: dict[str | None, list[str]] = {}
            for host, content in zip(batch["host"], batch["html"]):
                own.setdefault(host, []).append(content)
            return {"host": list(own), "wrapper": [combine([infer(contents)]) for contents in own.values()]}

        return run

    def again():
        return lambda batch: {"host": batch["host"], "wrapper": [combine([loads(w) for w in own]) for own in batch["wrappers"]]}

    found = stored(map_rows(rows, first, "host string, wrapper string", rows=64).distinct(), "wrappers")
    while (most := found.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        place = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // MERGED)))
        groups = found.groupBy("host", place.alias("place")).agg(F.sort_array(F.collect_list("wrapper")).alias("wrappers")).drop("place")
        found = stored(map_rows(groups, again, "host string, wrapper string", rows=16).distinct(), "wrappers")
    return found


def fit_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, template: hashes of (slot, text) outside of articles that stand on at least 3 different pages of the host and on half of those with the slot.

    All pages count, whatever their length; equal pages count once.
    """
    rows = pages.select(url_host(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html")).filter("host is not null and html is not null")

    def make():
        def run(batch):
            out: dict[str, list] = {"host": [], "page": [], "slot": [], "text": []}
            for host, page, content in zip(batch["host"], batch["page"], batch["html"]):
                found: list[tuple[int, str, int]] = []
                texts(parse(content), None, BODY, found)
                kept = [(f"{slot:x}", f"{slot_hash(slot, block):x}") for at, block, slot in found if at and at % MARKED < ARTICLE]
                for slot, text in {*kept, *((slot, None) for slot, _ in kept)}:
                    for name, value in zip(out, (host, page, slot, text)):
                        out[name].append(value)
            return out

        return run

    # both counts below read what was parsed once
    pages_of = stored(map_rows(rows, make, "host string, page long, slot string, text string", rows=64).distinct().groupBy("host", "slot", "text").count(), "slots")
    slots = pages_of.filter("text is null").select("host", "slot", F.col("count").alias("n"))
    often = pages_of.filter("text is not null and count >= 3").join(slots, ["host", "slot"]).filter("2 * count >= n")
    return often.groupBy("host").agg(F.concat_ws(" ", F.sort_array(F.collect_set("text"))).alias("template"))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: the columns of ``keep``, text, n_chars (code points).

    ``text``: the blocks of the article in page order, joined by line feeds; character references decoded, white space inside a block
    one space. Null and empty pages and pages without an article text give an empty text. Null urls and urls without a host share a
    wrapper. A page that its wrapper doesn't fit is aligned as far as it fits. The
    wrapper says where slots stand; it and the texts that belong to the template come from all pages of the host. Repeated pages are extracted one by one, whole.
    Wrappers are written to the shared checkpoint folder and joined by host; the size of that table decides how.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "wrappers")
    fit_wrappers(pages, url_col, html_col).join(fit_templates(pages, url_col, html_col), "host", "full").write.parquet(folder)
    source = pages.select(*keep, url_host(F.col(url_col)).alias("wrapper_host"), F.col(html_col).alias("page_html"))
    joined = source.join(spark.read.parquet(folder).withColumnRenamed("host", "wrapper_host"), "wrapper_host", "left").select(*keep, "page_html", "wrapper", F.col("template").alias("page_template"))

    def make():
        known: dict[str | None, Matcher | None] = {None: None}
        templates: dict[str | None, frozenset[str]] = {}

        def run(batch):
            out = []
            for page, wrapper, template in zip(batch.pop("page_html"), batch.pop("wrapper"), batch.pop("page_template")):
                if template not in templates:
                    if len(templates) > 1000:
                        templates.clear()
                    templates[template] = frozenset((template or "").split())
                if wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                        known[None] = None
                    known[wrapper] = Matcher(loads(wrapper))
                out.append(main_text(page, known[wrapper], templates[template]))
            return batch | {"text": out, "n_chars": [len(t) for t in out]}

        return run

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(joined, make, schema + ", text string, n_chars long", rows=64)
