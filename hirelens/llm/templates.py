"""Main text of web pages by equivalence classes of the tokens of a host's pages.

A page is a sequence of tokens: opening and closing tags, told apart by their
path of elements, and whole blocks of text. Tokens with the same number of
occurrences on every page of a host form an equivalence class; a class is found
by a fingerprint of that vector which adds up over pages, so no host is gathered
anywhere. Classes that hold tags, whose tokens always come in one order and which
always lie in the same gap of the class around them, are valid and nest into the
host's template. Its gaps are the slots. A slot is labelled by the elements
around it and by how much of the host's text it carries; the text of a page is
what stands in the slots that carry the article.
"""

from __future__ import annotations

import html as references
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.sources.shared import scratch_folder, stored

# Names of HTML, and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math select object video audio canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter"
    " nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr button".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu"
    " meta base nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button label fieldset search".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted comment comments"
    " reply replies respond disqus discussion related recommended share sharing social newsletter subscribe subscription"
    " signup cookie cookies consent gdpr notice notices popup modal overlay breadcrumb breadcrumbs pagination pager".split()
)
# Layout words: an article inside such an element is an article all the same.
FRAME_WORDS = frozenset("nav navbar navigation menu sidebar footer topbar toolbar widget widgets login search".split())
# Of these only what is outside of a main part: inside it they hold its title.
HEAD_WORDS = frozenset("header masthead banner".split())
MAIN_WORDS = frozenset("content main article post entry story maintext bodytext".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot div section article main body select td th".split())
# Elements that may hold a whole article.
BOXES = frozenset("html body center div dd fieldset section table tbody td tr".split())

TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
MASK = (1 << 62) - 1

COUNTS = "host string, token long, tag boolean, pages long, total long, vector long, other long, place double"
PLACES = "host string, kind string, name string, level int, chars long"


class Node:
    """An open block element: its path as a number, its level, and whether it is set aside."""

    __slots__ = ("above", "name", "path", "level", "aside", "inline")

    def __init__(self, above, name: str, path: int, level: int, aside: int, inline: bool):
        self.above, self.name, self.path, self.level, self.aside, self.inline = above, name, path, level, aside, inline


def _paths() -> dict:
    class Paths(dict):
        def __missing__(self, key):
            if len(self) > 200_000:
                self.clear()
            parent, name = key
            self[key] = found = xxhash.xxh64_intdigest(name, parent) & (MASK ^ 1)
            return found

    return Paths()


PATHS = _paths()


def _opened(above: Node, name: str, attributes: str) -> Node:
    """The node of a start tag. Level 2 is an article, 1 a main part, 0 the rest; aside 1 ends in an article, 2 never."""
    level, aside, key = above.level, above.aside, name
    words: set[str] = set()
    if attributes and "=" in attributes:
        values = [(k.lower(), (a or b or c).lower()) for k, a, b, c in NAMES.findall(attributes)]
        words = {w for _, value in values for w in WORD.findall(value)}
        if words:
            key = f"{name}.{' '.join(sorted(words))}"
        if ("itemprop", "articlebody") in values and level < 2:
            level = 2
    if name not in ("html", "body", "article", "main"):
        if name in ASIDE_TAGS or words & ASIDE_WORDS:
            aside = 2
        elif words & FRAME_WORDS or not level and (name == "header" or words & HEAD_WORDS):
            aside = max(aside, 1)
    if name == "article":
        if above.level == 2 or words & {"comment", "comments", "reply", "related"}:
            aside = 2
        level = 2
    elif name == "main" or words & MAIN_WORDS and name != "body" and name != "html":
        level = max(level, 1)
    if aside == 1 and name in ("article", "main"):
        aside = 0
    inline = name in INLINE or name not in BLOCK
    return Node(above, name, above.path if inline else PATHS[above.path, key], level, aside, inline)


def events(page: str) -> list[tuple]:
    """(token, text, level, aside, node) of a page in order; text is None for tags.

    Tags of blocks come in pairs: an end that is only implied is there too.
    Inline elements give no tokens. A block's text has its character references
    decoded and white space made one space.
    """
    out: list[tuple] = []
    top = root = Node(None, "", 0, 0, 0, False)
    kept: list[str] = []
    cast: list[str] = []

    def flush() -> None:
        block = top
        while block.inline:
            block = block.above
        for pieces, aside in ((kept, False), (cast, True)):
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    out.append((xxhash.xxh64_intdigest(text, block.path) & MASK, text, block.level, aside, block))

    def close(upto: Node) -> Node:
        """Ends all elements above ``upto`` and that one itself."""
        node = top
        while True:
            if not node.inline:
                out.append((node.path | 1, None, 0, False, node))
            if node is upto:
                return node.above
            node = node.above

    at, size = 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            (cast if top.aside else kept).append(references.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, ends, attributes = name.lower(), found[1] or found[4], found[3] or found[6]
        if ends:
            node = top
            if name in INLINE or name not in BLOCK:
                while node.inline and node.name != name:
                    node = node.above
                if node.inline:
                    top = node.above
            else:
                while node is not root and node.name != name:
                    node = node.above
                if node is not root or name == "p":  # a stray end of a paragraph is an empty one
                    flush()
                if node is not root:
                    top = close(node)
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif name in ("script", "style"):
                break
            if name not in ("title", "textarea"):
                continue
            flush()
            continue
        if name == "br":
            (cast if top.aside else kept).append("\n")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCK:
            flush()
            ended = CLOSED_BY.get(name)
            node = top
            while node is not root:
                if node.name == "p" or ended and node.name in ended:
                    last = node.name != "p" and name in ("li", "dt", "dd", "option")
                    node = top = close(node)
                    if last or not ended:
                        break
                elif node.name in HOLDERS:
                    break
                else:
                    node = node.above
        node = _opened(top, name, attributes)
        if not node.inline:
            out.append((node.path, None, 0, False, node))
        top = node
    flush()
    if top is not root:
        node = top
        while node is not root:
            if not node.inline:
                out.append((node.path | 1, None, 0, False, node))
            node = node.above
    return out


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty without it."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _frames(rows: Iterator[tuple], names: list[str], most: int = 20_000) -> Iterator[pd.DataFrame]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == most:
            yield pd.DataFrame(part, columns=names)
            part = []
    if part:
        yield pd.DataFrame(part, columns=names)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums by (host, token): pages, occurrences, the vector's fingerprint, mean place.

    Token 0 stands for the page itself.
    """
    for batch in batches:
        sums: dict[tuple, list] = {}
        for host, uid, page in zip(batch["host"], batch["uid"].tolist(), batch["html"]):
            seen: dict[tuple, list] = {(0, True): [1, 0.0]}
            for place, (token, text, *_) in enumerate(events(page)):
                one = seen.setdefault((token, text is None), [0, 0.0])
                if not one[0]:
                    one[1] = float(place)
                one[0] += 1
            mixed = {}
            for (token, tag), (n, place) in seen.items():
                if n not in mixed:
                    h = xxhash.xxh64_intdigest(f"{uid}:{n}")
                    mixed[n] = h & 0x7FFFFFFF, h >> 33
                total = sums.setdefault((host, token, tag), [0, 0, 0, 0, 0.0])
                for i, v in enumerate((1, n, *mixed[n], place)):
                    total[i] += v
        yield from _frames(((*key, *value) for key, value in sums.items()), _names(COUNTS))


def classes(tokens: pd.DataFrame) -> dict:
    """Classes of one host with at least two tokens, a tag among them, in order of place."""
    found = []
    frame = tokens[tokens["token"] != 0].sort_values(["place", "token"])
    for _, group in frame.groupby(["pages", "total", "vector", "other"], sort=False):
        if len(group) > 1 and group["tag"].any():
            found.append([[int(t) for t in group["token"]], [bool(t) for t in group["tag"]]])
    return {"classes": found}


class Template:
    """Positions of a page's tokens in the classes of its host."""

    def __init__(self, description: str | None):
        self.rules = json.loads(description) if description else {"classes": []}
        self.place = {}
        for number, (tokens, tags) in enumerate(self.rules["classes"]):
            for i, (token, tag) in enumerate(zip(tokens, tags)):
                self.place[token, tag] = number, i, len(tokens) - 1
        self.slots = {tuple(s) for s in self.rules.get("slots", ())}
        self.level, self.box = self.rules.get("level", 0), self.rules.get("box")

    def walk(self, page: list[tuple]) -> Iterator[tuple]:
        """(event, open classes with their last token's index, what went wrong, where a class began).

        A class that begins is put on the open ones; one that goes on ends all
        that began after it, which are then not nested; one that is out of order
        is not valid either.
        """
        stack: list[tuple[int, int]] = []
        for event in page:
            at = self.place.get((event[0], event[1] is None))
            if at is None:
                yield event, stack, (), None
                continue
            number, i, last = at
            if i == 0:
                begun = number, *(stack[-1] if stack else (-1, 0))
                wrong = [number] if any(n == number for n, _ in stack) else ()
                stack = [*stack, (number, 0)]
                yield event, stack, wrong, begun
                continue
            depth = len(stack) - 1
            while depth >= 0 and stack[depth] != (number, i - 1):
                depth -= 1
            if depth < 0:
                yield event, stack, [number], None
                continue
            wrong = [n for n, _ in stack[depth + 1 :]]
            stack = stack[:depth] if i == last else [*stack[:depth], (number, i)]
            yield event, stack, wrong, None


class Templates(dict):
    """Templates by host, for one task."""

    def __missing__(self, key: tuple) -> Template:
        if len(self) > 1000:
            self.clear()
        self[key] = found = Template(key[1])
        return found


def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums by host of where classes begin, which fail, and the text in every gap and element."""
    known = Templates()
    for batch in batches:
        sums: dict[tuple, int] = defaultdict(int)
        for host, rules, page in zip(batch["host"], batch["template"], batch["html"]):
            template = known[host, rules]
            for (_, text, level, aside, node), stack, wrong, begun in template.walk(events(page)):
                for number in wrong:
                    sums[host, "wrong", str(number), 0] += 1
                if begun:
                    sums[host, "nest", "{}.{}.{}".format(*begun), 0] += 1
                if text is None:
                    continue
                gap = "/".join(f"{n}.{i}" for n, i in stack)
                sums[host, "aside" if aside else "text", gap, level] += len(text)
                while not aside and node.above:
                    if node.name in BOXES and (node.path, True) in template.place:
                        sums[host, "box", str(node.path), 0] += len(text)
                    node = node.above
        yield from _frames(((*key, n) for key, n in sums.items()), _names(PLACES))


def decided(rules: str, places: pd.DataFrame, share: float = 0.2, most: float = 0.6) -> str:
    """The final template: its valid classes, the slots that carry the article, level and box.

    Level 2 (or 1) holds if such elements carry ``share`` of the text not set
    aside. Without them the innermost template element with ``most`` of it is
    the box that holds the article.
    """
    found = json.loads(rules)["classes"]
    by_kind = {k: g for k, g in places.groupby("kind")}
    wrong = {int(n) for n in by_kind["wrong"]["name"]} if "wrong" in by_kind else set()
    parents: dict[int, set] = defaultdict(set)
    for name in by_kind["nest"]["name"] if "nest" in by_kind else ():
        number, *parent = map(int, name.split("."))
        parents[number].add(tuple(parent))
    bad = {n for n in range(len(found)) if n in wrong or len(parents[n]) != 1}
    # A class whose place was told by one that is not valid hangs on the next one around it.
    kept = [n for n in range(len(found)) if n not in bad]
    new = {n: i for i, n in enumerate(kept)}
    mass = [0, 0, 0]
    slots: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
    if "text" in by_kind:
        texts = by_kind["text"]
        for gap, level, chars in zip(texts["name"], texts["level"], texts["chars"]):
            nested = [tuple(map(int, x.split("."))) for x in gap.split("/") if x]
            nested = [(new[n], i) for n, i in nested if n in new]
            slot = nested[-1] if nested else (-1, 0)
            slots[slot][level] += int(chars)
            mass[level] += int(chars)
    total = sum(mass)
    level = 2 if mass[2] and mass[2] >= share * total else 1 if sum(mass[1:]) and sum(mass[1:]) >= share * total else 0
    box = None
    if not level and "box" in by_kind:
        boxes = by_kind["box"]
        boxes = boxes[boxes["chars"] >= most * total]
        if len(boxes):
            box = int(boxes.sort_values(["chars", "name"])["name"].iloc[0])
    chosen = sorted(s for s, chars in slots.items() if sum(chars[level:]))
    return json.dumps({"classes": [found[n] for n in kept], "slots": chosen, "level": level, "box": box})


def inside(node: Node, path: int) -> bool:
    while node is not None and node.path != path:
        node = node.above
    return node is not None


def alone(page: list[tuple], most: float = 0.6) -> list[str]:
    """The blocks of a page whose host has no template: its article, main part, or innermost box with most text."""
    texts = [e for e in page if e[1] is not None and not e[3]]
    level = max((e[2] for e in texts), default=0)
    if level:
        return [e[1] for e in texts if e[2] >= level]
    mass: dict[int, int] = defaultdict(int)
    for _, text, _, _, node in texts:
        while node.above:
            mass[id(node)] += len(text)
            node = node.above
    total = sum(len(e[1]) for e in texts)
    nodes = {id(n): n for e in texts for n in _upward(e[4])}
    enough = [n for key, n in nodes.items() if n.name in BOXES and mass[key] >= most * total]
    if not enough:
        return [e[1] for e in texts]
    depth = {id(n): sum(1 for _ in _upward(n)) for n in enough}
    best = max(enough, key=lambda n: depth[id(n)])
    return [e[1] for e in texts if any(n is best for n in _upward(e[4]))]


def _upward(node: Node) -> Iterator[Node]:
    while node.above:
        yield node
        node = node.above


def article(page: str, template: Template) -> str:
    """The text in the slots of the article, blocks joined by an empty line."""
    tokens = events(page)
    blocks = []
    for event, stack, _, _ in template.walk(tokens):
        token, text, level, aside, node = event
        if text is None or aside or level < template.level:
            continue
        if (stack[-1] if stack else (-1, 0)) not in template.slots:
            continue
        if not template.level:
            if (token, False) in template.place or template.box is not None and not inside(node, template.box):
                continue
        blocks.append(text)
    return "\n\n".join(blocks or alone(tokens))


def extracted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The article of each (host, template, html)."""
    known = Templates()
    for columns in batches:
        yield pd.Series([article(page, known[host, rules]) for host, rules, page in zip(*columns)], dtype=object)


def beside(pages: DataFrame, templates: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Pages with the template of their host, null if it has none.

    Templates are sent to all executors if they are known to be small; else
    both sides are joined by host, and a host with very many pages is split by
    the skewed join.
    """
    size = templates.agg(F.sum(F.length("template") + F.length("host") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        templates = F.broadcast(templates)
    return pages.join(templates, "host", "left")


def templates_of(pages: DataFrame, *, min_pages: int = 3, support: float = 0.1, broadcast_bytes: int = 1 << 25) -> DataFrame:
    """(host, template: JSON) for hosts with at least ``min_pages`` rows in (host, uid, html).

    A token must be on ``min_pages`` pages and on ``support`` of the host's;
    that bounds a template by the size of a page.
    """
    spark = pages.sparkSession
    folder = scratch_folder(spark, "templates")
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "vector", "other")]
    tokens = (
        pages.mapInPandas(counted, COUNTS)
        .groupBy("host", "token", "tag")
        .agg(*sums, (F.sum("place") / F.sum("pages")).alias("place"))
        .where(F.col("pages") >= min_pages)
    )
    tokens = stored(tokens, f"{folder}/tokens")
    hosts = tokens.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    frequent = tokens.join(hosts, "host").where(F.col("pages") >= support * F.col("all_pages"))

    def grouped(host: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": host["host"].iloc[:1], "template": [json.dumps(classes(host))]})

    columns = _names(COUNTS)
    candidates = stored(
        frequent.select(*columns).groupBy("host").applyInPandas(grouped, "host string, template string"),
        f"{folder}/candidates",
    )
    places = (
        beside(pages, candidates, broadcast_bytes)
        .where("template is not null")
        .mapInPandas(placed, PLACES)
        .groupBy("host", "kind", "name", "level")
        .agg(F.sum("chars").alias("chars"))
    )

    def settled(rules: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        return rules[["host"]].assign(template=[decided(r, places) for r in rules["template"]])

    final = candidates.groupBy("host").cogroup(places.groupBy("host")).applyInPandas(settled, "host string, template string")
    return stored(final, f"{folder}/final")


def main_text(pages: DataFrame, *, min_pages: int = 3, support: float = 0.1, broadcast_bytes: int = 1 << 25) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html).

    A null or empty html gives an empty text; a null url or one without ``://``
    counts to the host with the empty name. Each repeated row is one page. A
    page of a host with fewer than ``min_pages`` rows, or without any text in
    the article's slots, is judged by its own elements. No rows give no rows.
    """
    rows = pages.select(
        "page_id",
        "url",
        host_of(F.col("url")).alias("host"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    uid = F.xxhash64("page_id", "url").alias("uid")
    final = templates_of(
        rows.select("host", uid, "html"), min_pages=min_pages, support=support, broadcast_bytes=broadcast_bytes
    )
    found = beside(rows, final, broadcast_bytes)
    texts = found.select("page_id", "url", F.pandas_udf(extracted, "string")("host", "template", "html").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
