"""HTML extraction by union-free regular-expression inference.

The token streams of all pages of a host are folded and aligned: neighbouring equal groups become repeated groups, what only some
pages have becomes an optional group, and texts that differ become slots. The regular expression (a wrapper: nested sequences
of tags, slots, (..)? and (..)+ with no unions) knows which parts are constant on the host, which consist of links, and where
the varying prose lies; the part that holds it is the article, and all text in it is kept, also what is constant or linked. Every page is read
along its host's wrapper. A page whose prose lies elsewhere (a rare template) gets a region of its own, by its own tree and the wrapper's constants.

Wrappers are merged in every task first, then in salted groups, then by host, so a host with most of the pages sends one partial wrapper per task.
"""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import left_join, save, small_batches

#: Parts of partial wrappers that a task holds before it passes them on.
HELD_PARTS = 200_000
#: Wrappers of at most so many bytes together are sent to every task; more are joined by host.
SENT_BYTES = 16 << 20
#: Pages from which a text that never differs counts as constant.
CONSTANT = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<]*\Z|<[a-zA-Z/][^>]*>", re.S | re.I)
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that by their meaning in HTML are no article text.
_SKIP = frozenset("head title nav footer aside button select option input textarea noscript iframe object canvas svg dialog menu".split())
#: Whole values of class, id or role that say the same of an element, unless the wrapper finds half of the prose in it; so for forms.
_NAMED = frozenset("banner breadcrumb breadcrumbs complementary contentinfo navigation notice search".split())
#: Words that say so too, alone or with the words after them and no others, as in ad-slot or user-comments.
_NAMED_WORDS = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies navbar newsletter pagination popup share sharing sidebar social sponsor sponsored".split())
_BOXES = frozenset("area banner bar block box button buttons container list notice reader section slot thread unit user widget wrap wrapper".split())
_CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_GENERIC = frozenset("div section table tbody tr td center".split())
_HOLDS_P = ("td", "th", "button", "object")


def _telling(value: str) -> bool:
    words = set(re.findall("[a-z]+", value))
    return not words.isdisjoint(_NAMED_WORDS) and words <= _NAMED_WORDS | _BOXES


class Node:
    """A tag of a page: its key (tag and class words), its children, nodes and texts in order, and its form: what blocks are in it, if no class tells."""

    __slots__ = ("tag", "key", "skip", "named", "children", "_form")

    def __init__(self, tag: str, attributes: str = "") -> None:
        values = [(m[1] or m[2] or m[3] or "").strip().lower() for m in _CLASS.finditer(attributes)] if "=" in attributes else []
        words = sorted({w for v in values for w in re.split(r"[^a-z]+", v) if w})
        self.tag, self.children, self._form = tag, [], None
        self.key = f"{tag}.{'.'.join(words)}" if words else tag
        self.skip = tag in _SKIP
        self.named = tag == "form" or tag not in ("body", "html", "article", "main", "h1") and any(v in _NAMED or _telling(v) for v in values)

    @property
    def form(self) -> str:
        if self._form is None:
            self._form = " ".join(sorted({c.tag for c in self.children if not isinstance(c, str) and c.tag not in _INLINE})) if self.key in _GENERIC else ""
        return self._form


def parse(page: str) -> Node:
    """The page as a tree of any depth; end tags that are missing or too many are forgiven as browsers do."""
    root = Node("html")
    stack, at = [root], 0
    count: dict[str, int] = {}

    def close(i: int) -> None:
        for n in stack[i:]:
            count[n.tag] -= 1
        del stack[i:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in ("html", "body"):
            if m[2]:
                close(1)
            continue
        if m[2]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif count.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag not in _INLINE and tag not in _VOID and count.get("p"):
            i = len(stack) - 1
            while stack[i].tag != "p" and stack[i].tag not in _HOLDS_P:
                i -= 1
            if stack[i].tag == "p":
                close(i)
        if tag in _CLOSES:
            names, bounds = _CLOSES[tag]
            names = names.split()
            if any(count.get(n) for n in names):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in bounds:
                        break
                    if stack[i].tag in names:
                        close(i)
                        break
        node = Node(tag, m[4])
        stack[-1].children.append(node)
        if tag not in _VOID and not m[4].endswith("/"):
            stack.append(node)
            count[tag] = count.get(tag, 0) + 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


class Rule:
    """A part of a wrapper. kind: tag, slot or group; optional: (..)?; repeated: (..)+.

    digest: of all text in it, while that is the same on every page (`seen`) that has the part; chars and linked: characters of text, and of those in links.
    """

    __slots__ = ("kind", "key", "tag", "skip", "named", "optional", "repeated", "parts", "digest", "chars", "linked", "seen", "region", "form", "known")

    def __init__(self, kind: str, key: str, tag: str = "", skip: bool = False, named: bool = False, form: str = "") -> None:
        self.kind, self.key, self.tag, self.skip, self.named, self.form, self.parts = kind, key, tag, skip, named, form, []
        self.optional = self.repeated = self.region = False
        self.digest, self.chars, self.linked, self.seen, self.known = None, 0, 0, 1, None

    def constant(self) -> bool:
        return self.digest is not None and self.seen >= CONSTANT

    def child(self, key: str, form: str = "", at: int = 0) -> tuple[Rule | None, int]:
        """The part for a child with this key and form, from the at-th on if there is one, and the part to go on from; also inside a group."""
        if self.known is None:
            self.known = {}
            for i, p in enumerate(self.parts):
                for q in p.parts if p.kind == "group" else (p,):
                    for k in ((q.key, q.form), q.key):
                        self.known.setdefault(k, []).append((i, q, i if p.repeated else i + 1))
        found = self.known.get((key, form)) or self.known.get(key)
        if not found:
            return None, at
        k = next((x for x in found if x[0] >= at), found[0])
        return k[1], k[2]

    def all(self) -> list[Rule]:
        """The part and all in it, those that hold others first."""
        out = [self]
        for r in out:
            out.extend(r.parts)
        return out


def _digest(parts: Iterator) -> bytes:
    return blake2b(b"|".join(parts), digest_size=8).digest()


def dump(root: Rule) -> bytes:
    """Flat, so that no depth of nesting matters."""
    return pickle.dumps([(r.kind, r.key, r.tag, r.skip, r.named, r.optional, r.repeated, r.digest, r.chars, r.linked, r.seen, r.region, r.form, len(r.parts)) for r in root.all()])


def load(data: bytes) -> Rule:
    rules, sizes = [], []
    for kind, key, tag, skip, named, optional, repeated, digest, chars, linked, seen, region, form, n in pickle.loads(data):
        r = Rule(kind, key, tag, skip, named, form)
        r.optional, r.repeated, r.digest, r.chars, r.linked, r.seen, r.region = optional, repeated, digest, chars, linked, seen, region
        rules.append(r)
        sizes.append(n)
    at = 1
    for r, n in zip(rules, sizes, strict=True):
        r.parts, at = rules[at : at + n], at + n
    return rules[0]


def rule_of(root: Node) -> Rule:
    """The wrapper of one page."""
    top = Rule("tag", root.key, root.tag, root.skip, root.named)
    order = [(root, top, False)]
    for node, r, linked in order:
        for c in node.children:
            if isinstance(c, str):
                text = c.strip()
                if text:
                    t = Rule("slot", "#")
                    t.digest, t.chars, t.linked = _digest([text.encode("utf-8", "replace")]), len(text), len(text) if linked else 0
                    r.parts.append(t)
            else:
                p = Rule("tag", c.key, c.tag, c.skip, c.named, c.form)
                r.parts.append(p)
                order.append((c, p, linked or c.tag == "a"))
    for _, r, _ in reversed(order):
        r.parts = fold(r.parts)
        r.chars, r.linked = sum(p.chars for p in r.parts), sum(p.linked for p in r.parts)
        r.digest = _digest(p.digest for p in r.parts)
    return top


def fold(parts: list[Rule]) -> list[Rule]:
    """Tandem repeats of one to three parts become repeated parts or groups."""
    for period in (1, 2, 3):
        if len(parts) < 2 * period:
            break
        keys = [(p.key, p.form) for p in parts]
        out, i = [], 0
        while i < len(parts):
            own, j = keys[i : i + period], i + period
            while keys[j : j + period] == own and len(own) == period and own != [("#", "")]:
                j += period
            if j == i + period:
                out.append(parts[i])
                i += 1
                continue
            whole = _digest(p.digest for p in parts[i:j])
            if period == 1:
                unit = parts[i]
                for k in range(i + 1, j):
                    merge(unit, parts[k], False)
            else:
                unit = Rule("group", f"({' '.join(k for k, _ in own)})")
                unit.parts = parts[i : i + period]
                for k in range(i + period, j, period):
                    for a, b in zip(unit.parts, parts[k : k + period], strict=True):
                        merge(a, b, False)
                unit.chars, unit.linked = sum(p.chars for p in unit.parts), sum(p.linked for p in unit.parts)
            unit.repeated, unit.digest = True, whole
            out.append(unit)
            i = j
        parts = out
    return parts


def merge(a: Rule, b: Rule, pages: bool = True) -> None:
    """Align b with a, which then stands for both; pages: they come from different pages."""
    work = [(a, b)]
    while work:
        a, b = work.pop()
        a.seen = a.seen + b.seen if pages else max(a.seen, b.seen)
        a.chars, a.linked = a.chars + b.chars, a.linked + b.linked
        a.repeated, a.optional = a.repeated or b.repeated, a.optional or b.optional
        a.digest = a.digest if a.digest == b.digest else None
        a.known = None
        x, y = a.parts, b.parts
        lead = 0
        while lead < min(len(x), len(y)) and _alike(x[lead], y[lead]) == 2:
            lead += 1
        tail = 0
        while tail < min(len(x), len(y)) - lead and _alike(x[-1 - tail], y[-1 - tail]) == 2:
            tail += 1
        out: list[Rule] = []

        def put(p: Rule, out: list[Rule] = out) -> None:
            """Neighbouring parts with one key, left by an alignment, are one repeated part."""
            if out and p.kind != "slot" and _alike(out[-1], p) == 2:
                work.append((out[-1], p))
                out[-1].repeated = True
            else:
                out.append(p)

        for p, q in zip(x[:lead], y[:lead]):
            work.append((p, q))
            out.append(p)
        for p, q, both in _aligned(x[lead : len(x) - tail], y[lead : len(y) - tail]):
            if both:
                work.append((p, q))
                put(p)
            else:
                p.optional = True
                put(p)
        for p, q in zip(x[len(x) - tail :], y[len(y) - tail :]):
            work.append((p, q))
            put(p)
        a.parts = out


def _alike(p: Rule, q: Rule) -> int:
    return 0 if p.key != q.key else 1 + (p.form == q.form)


#: Pairs of parts up to which the longest alignment is sought; and parts that the alignment of longer ones looks ahead.
ALIGNED_PAIRS, AHEAD = 250_000, 32


def _near(x: list[Rule], y: list[Rule]) -> list[tuple]:
    """As _aligned, in time and memory that grow with the lengths: after a mismatch, on with the nearest pair of like parts at most AHEAD parts away."""
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i].key != y[j].key:
            last: dict[str, int] = {}
            for b in range(min(AHEAD, len(y) - j) - 1, -1, -1):
                last[y[j + b].key] = b
            met = min(((a + last[x[i + a].key], a) for a in range(min(AHEAD, len(x) - i)) if x[i + a].key in last), default=(1, 1))
            a, b = met[1], met[0] - met[1]
            out += [(p, None, False) for p in x[i : i + a] + y[j : j + b]]
            i, j = i + a, j + b
            continue
        out.append((x[i], y[j], True))
        i, j = i + 1, j + 1
    return out + [(p, None, False) for p in x[i:] + y[j:]]


def _aligned(x: list[Rule], y: list[Rule]) -> list[tuple]:
    """A common sequence of keys: (part, its partner, True) or (part, None, False). The longest one, where forms are alike too, up to ALIGNED_PAIRS pairs of parts."""
    n, m = len(x), len(y)
    if not n or not m:
        return [(p, None, False) for p in x + y]
    if n * m > ALIGNED_PAIRS:
        return _near(x, y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            like = _alike(x[i], y[j])
            best[i][j] = max(best[i + 1][j], best[i][j + 1], like and best[i + 1][j + 1] + like)
    out, i, j = [], 0, 0
    while i < n and j < m:
        like = _alike(x[i], y[j])
        if like and best[i][j] == best[i + 1][j + 1] + like:
            out.append((x[i], y[j], True))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append((x[i], None, False))
            i += 1
        else:
            out.append((y[j], None, False))
            j += 1
    return out + [(p, None, False) for p in x[i:] + y[j:]]


def expression(r: Rule) -> str:
    """The wrapper as a regular expression over tags; #PCDATA is a slot."""
    if r.kind == "slot":
        body = "#CONSTANT" if r.constant() else "#PCDATA"
    else:
        body = " ".join(expression(p) for p in r.parts)
        body = f"<{r.key}>{body}</{r.tag}>" if r.kind == "tag" else body
    body = f"({body})+" if r.repeated else body
    return f"({body})?" if r.optional else body


def choose(root: Rule) -> Rule:
    """Mark the region(s) of the article: <article> or <main> if a third of the varying prose is there, else the
    innermost part that still holds 60 % of it, with the varying headings before it. Names don't count for parts with half of the prose."""
    every = root.all()

    def prose() -> dict[int, int]:
        """Characters of text that is neither constant nor linked nor skipped."""
        out: dict[int, int] = {}
        for r in reversed(every):
            own = r.chars - r.linked if r.kind == "slot" else sum(out[id(p)] for p in r.parts)
            out[id(r)] = 0 if r.skip or r.constant() else own
        return out

    size = prose()
    for r in every:
        if r.named:
            r.skip, r.named = size[id(r)] < 0.5 * size[id(root)] or not size[id(r)], False
    size = prose()
    total = size[id(root)]
    stack, marked = [root], {"article": [], "main": []}
    while stack:
        r = stack.pop()
        if not r.skip:
            if r.tag in marked and r.chars:
                marked[r.tag].append(r)
            stack.extend(r.parts)
    for found in marked.values():
        if found:
            key = max(found, key=lambda r: (size[id(r)], r.chars, r.key)).key
            own = [r for r in found if r.key == key]
            if 3 * sum(size[id(r)] for r in own) >= total:
                for r in own:
                    r.region = True
                return root
    at, heads = root, []
    while total:
        inner = [(size[id(p)], -i) for i, p in enumerate(at.parts) if p.kind != "slot" and not p.repeated and p.tag not in _INLINE and not re.fullmatch("p|h[1-6]|pre|blockquote|ul|ol|dl|table", p.tag)]
        top = max(inner, default=(0, 0))
        if top[0] < 0.6 * size[id(at)] or not top[0]:
            break
        heads += [p for p in at.parts[: -top[1]] if re.fullmatch("h[1-6]", p.tag) and size[id(p)]]
        at = at.parts[-top[1]]
    for r in (at, *heads):
        r.region = True
    return root


def infer(pages: list[str]) -> Rule:
    """The wrapper of a host's pages, aligned in the given order."""
    wrapper = None
    for page in pages:
        rule = rule_of(parse(page))
        if wrapper is None:
            wrapper = rule
        else:
            merge(wrapper, rule)
    return choose(wrapper or Rule("tag", "html"))


def walk(root: Node, wrapper: Rule) -> tuple[str, int, int]:
    """The text in the wrapper's regions (blocks in order, joined by two newlines), its characters, and those of varying prose elsewhere."""
    blocks: list[str] = []
    line: list[str] = []
    kept = lost = 0

    def end() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    stack: list[list] = [[iter(root.children), wrapper, wrapper.region, False, False, 0]]
    while stack:
        children, r, inside, linked, block, _ = top = stack[-1]
        for c in children:
            if isinstance(c, str):
                if inside:
                    line.append(c)
                    kept += len(c)
                elif not linked and not (r is not None and (slot := r.child("#")[0]) is not None and slot.constant()):
                    lost += len(c.strip())
                continue
            if c.tag == "br":
                line.append(" ")
                continue
            rule, top[5] = r.child(c.key, c.form, top[5]) if r is not None else (None, 0)
            own = c.tag not in _INLINE
            if own:
                end()
            if not (rule.skip if rule is not None else c.skip or c.named):
                const = rule is not None and rule.constant()
                stack.append([iter(c.children), rule, inside or rule is not None and rule.region, linked or const or c.tag == "a", own, 0])
                break
        else:
            if block:
                end()
            stack.pop()
    end()
    return "\n\n".join(blocks), kept, lost


def own_wrapper(root: Node, wrapper: Rule) -> Rule:
    """A page's own wrapper, with what is constant on its host marked; its regions are those of its own tree and, unless that is the whole page, the host's."""
    own = rule_of(root)
    work, shared = [(own, wrapper)], []
    while work:
        a, b = work.pop()
        if b.constant() and a.digest == b.digest:
            a.seen = b.seen
        if b.region:
            shared.append(a)
        at = 0
        for p in a.parts:
            for q in p.parts if p.kind == "group" else (p,):
                r, at = b.child(q.key, q.form, at)
                if r is not None:
                    work.append((q, r))
    choose(own)
    if not own.region:
        for a in shared:
            a.region = True
    return own


def read(page: str, wrapper: Rule) -> str:
    """The article of a page by its host's wrapper. Where more varying prose lies outside the wrapper's regions than in them, the page has a template of its own: its own
    tree gives regions too, unless it finds none smaller than the page."""
    root = parse(page)
    text, kept, lost = walk(root, wrapper)
    if text and kept >= lost:
        return text
    own = own_wrapper(root, wrapper)
    return text if own.region and 9 * kept >= lost and text else walk(root, own)[0]


_PARTIAL = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.binary())])


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the pages of a task, by host."""
    held: dict[str, Rule] = {}
    parts = 0

    def flush() -> pa.RecordBatch:
        raw = [dump(r) for r in held.values()]
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([int.from_bytes(blake2b(x, digest_size=1).digest()) for x in raw], pa.int32()), pa.array(raw, pa.binary())], schema=_PARTIAL)
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rule = rule_of(parse(page))
            if host in held:
                merge(held[host], rule)
            else:
                held[host] = rule
                parts += len(rule.all())
        if parts > HELD_PARTS:
            yield flush()
            parts = 0
    yield flush()


def _merged(last: bool):
    def run(table: pa.Table) -> pa.Table:
        first = None
        for raw in sorted(table["wrapper"].to_pylist()):
            rule = load(raw)
            if first is None:
                first = rule
            else:
                merge(first, rule)
        raw = dump(choose(first) if last else first)
        return pa.table({"host": table["host"][:1], "salt": table["salt"][:1], "wrapper": pa.array([raw], pa.binary())})

    return run


_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def extract_html(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page: its article as blocks joined by two newlines, references decoded, white space in a block one space.

    A null or empty html gives an empty text. Pages without a host in their url (null, relative) share one wrapper. Broken markup is read as
    browsers do: what is open ends with the page, stray end tags are ignored, an unfinished tag at the end is dropped. Repeated rows, also with
    null ids, have equal results. All pages enter their host's wrapper and every page is read whole, at any length and depth.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    kind = "host string, salt int, wrapper binary"
    found = rows.select("host", "html").mapInArrow(_partials, kind).groupBy("host", "salt").applyInArrow(_merged(False), kind)
    wrappers = save(found.groupBy("host").applyInArrow(_merged(True), kind).select("host", "wrapper"))
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    if size <= SENT_BYTES:
        sent = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in wrappers.collect()})  # at most SENT_BYTES
        wrapped = rows.withColumn("wrapper", F.lit(None).cast("binary"))
    else:
        sent = None
        wrapped = left_join(rows, wrappers, "host")

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict = {}
        for batch in batches:
            out = []
            for page, own, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if own not in loaded:
                    if len(loaded) > 200:
                        loaded.clear()
                    loaded[own] = load(sent.value[own] if sent is not None else raw)
                out.append(read(page, loaded[own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(rows.dtypes)
    read_ = wrapped.select("page_id", "url", "html", "host", "wrapper").mapInArrow(read_all, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return read_.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
