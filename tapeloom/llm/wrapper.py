"""Main text of web pages by wrappers: union-free regular expressions inferred from each host's token streams.

A host's pages are aligned one after the other with the expression found so far. Where they agree the
expression stays; a mismatch is resolved without alternatives. A token that the expression already
holds further back makes the stretch since then a repeated group; any other token that only one side
has becomes optional; two different texts become a text slot. Two wrappers align the same way as a
wrapper and a page, so every task folds the pages it reads and only wrappers are shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import kept, parallelism, safe_unions
from tapeloom.llm.markup import CLOSE, OPEN, stream

C = F.col

#: Wrappers of all hosts are sent whole to every executor up to this size, else joined by a shuffle.
SENT = 16 << 20
#: Siblings of one tag and part that differ in class only; more of them become one token.
MANY = 24
#: Hosts in a batch of wrappers.
AT_ONCE = 256

# What elements and class names say about a part of a page.
ASIDE = set("nav aside form footer dialog menu".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar form hidden".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus foot footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promotion promotions recommended related replies reply respond share sharebar sharing "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
MAIN_WORDS = set(
    "article article-body article-content article-text articlebody body-text content content-body entry entry-content main main-content "
    "maincontent page-content post post-body post-content post-text story story-body text-body".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

PLAIN, MAIN, ARTICLE, HEADER, LEFT_OUT = "", "main", "article", "header", "aside"


def part_of(key: str) -> str:
    """What the token of an element says about the part of the page it opens."""
    name, *marks = key.split("@")
    tag, *names = name.replace("#", ".").split(".")
    if tag == "article":
        return ARTICLE if "hidden" not in marks else LEFT_OUT
    if tag == "main":
        return MAIN
    if tag in ASIDE or ASIDE_ROLES.intersection(marks):
        return LEFT_OUT
    if "article" in marks or "articlebody" in marks:
        return ARTICLE
    if "main" in marks or MAIN_WORDS.intersection(names):
        return MAIN
    words = {w for n in names if n.split("-")[0] not in ("with", "has", "no", "without", "is") for w in n.replace("_", "-").split("-")}
    if ASIDE_WORDS.intersection(words):
        return LEFT_OUT
    return HEADER if tag == "header" or "header" in words else PLAIN


class Node:
    """An element of a wrapper, or a text (key ``#``), with what its occurrences had in common."""

    __slots__ = ("key", "n", "held", "rep", "groups", "text", "chars", "linked")

    def __init__(self, key: str) -> None:
        self.key = key
        self.n = 1  # occurrences
        self.held = 1  # parents that hold one at least
        self.rep = False  # more than one in some parent, one after the other
        self.groups: list[list[Node]] = []  # in page order; a group of several is repeated, each member optional
        self.text: str | None = None  # digest of a text that was always the same; None for a slot
        self.chars = self.linked = 0

    def dump(self) -> list:
        return [self.key, self.n, self.held, int(self.rep), self.text, self.chars, self.linked, [[m.dump() for m in g] for g in self.groups]]

    @classmethod
    def load(cls, x: list) -> Node:
        node = cls(x[0])
        _, node.n, node.held, node.rep, node.text, node.chars, node.linked, groups = x
        node.rep = bool(node.rep)
        node.groups = [[cls.load(m) for m in g] for g in groups]
        return node

    def expression(self) -> str:
        """The wrapper as a regular expression over tokens, for people to read."""
        if self.key == "#":
            return "#text" if self.text is None else "#same"
        inner = []
        for group in self.groups:
            parts = [m.expression() + ("+" if m.rep else "") for m in group]
            if len(group) > 1:
                inner.append("(" + " ".join(f"({p})?" for p in parts) + ")+")
            else:
                inner.append(f"({parts[0]})?" if group[0].held < self.n else parts[0])
        return f"<{self.key}>" + " ".join(inner) + "</>"


def align(wrapper: Node, other: Node, siblings: bool = False) -> None:
    """Generalise ``wrapper`` so that it also matches what ``other`` matches.

    Both are expressions for the same token; ``siblings`` tells that both lie in one parent.
    """
    wrapper.n += other.n
    wrapper.held = wrapper.held if siblings else wrapper.held + other.held
    wrapper.rep |= siblings or other.rep
    wrapper.chars += other.chars
    wrapper.linked += other.linked
    if wrapper.text != other.text:
        wrapper.text = None  # a slot
    done = -1  # the group that the last token of the other side was matched with
    for group in other.groups:
        done = _place(wrapper.groups, group, done)
    _narrow(wrapper)


def _place(groups: list[list[Node]], new: list[Node], done: int, siblings: bool = False) -> int:
    """Match the next group of a stream, or one new token, after group ``done``; gives the group it is in now."""
    keys = {m.key for m in new}
    at = [k for k, g in enumerate(groups) if any(m.key in keys for m in g)]
    if not at:  # only this side has it: an optional token
        groups.insert(done + 1, list(new))
        return done + 1
    first, last = at[0], at[-1]
    if first < done:  # seen before in the stream: everything since then repeats
        last = max(last, done)
    if last > first:
        groups[first : last + 1] = [[m for g in groups[first : last + 1] for m in g]]
    known = {m.key: m for m in groups[first]}
    for m in new:
        if m.key in known:
            align(known[m.key], m, siblings)
        else:
            groups[first].append(m)
    return first


def _narrow(parent: Node) -> None:
    """Make siblings that differ in class alone one token once they are many, so that wrappers stay small."""
    count: dict[str, int] = {}
    for group in parent.groups:
        for m in group:
            count[general(m.key)] = count.get(general(m.key), 0) + 1
    for key, n in count.items():
        if n <= MANY:
            continue
        at = [k for k, g in enumerate(parent.groups) if any(general(m.key) == key for m in g)]
        members = [m for g in parent.groups[at[0] : at[-1] + 1] for m in g]
        like = [m for m in members if general(m.key) == key]
        rest = [m for m in members if general(m.key) != key]
        one = like[0]
        one.key = key
        for m in like[1:]:
            held = min(parent.n, one.held + m.held)
            align(one, m, siblings=True)
            one.held = held
        parent.groups[at[0] : at[-1] + 1] = [[one, *rest]]


def general(key: str) -> str:
    """The token without its classes, but with the part of the page they tell."""
    return key if key == "#" or "*" in key else f"{key.split('@')[0].split('.')[0].split('#')[0]}*{part_of(key)}"


def one_page(tokens: list[tuple]) -> Node:
    """The wrapper of a single token stream: equal siblings are folded into repeated tokens and groups."""
    root = Node("page")
    stack, done = [root], [-1]
    for token in tokens:
        if token[0] == OPEN:
            stack.append(Node(token[1]))
            done.append(-1)
            continue
        if token[0] == CLOSE:
            node = stack.pop()
            done.pop()
        else:
            node = Node("#")
            node.text = hashlib.blake2b(token[1].encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            node.chars, node.linked = len(token[1]), token[2]
        done[-1] = _place(stack[-1].groups, [node], done[-1], siblings=True)
    return root


def part(node: Node) -> str:
    return node.key.rpartition("*")[2] if "*" in node.key else part_of(node.key)


def _holds_main(node: Node) -> bool:
    """Whether an article or main element lies inside, outside of what is left out."""
    inner = [m for g in node.groups for m in g if m.key != "#"]
    return any(part(m) in (ARTICLE, MAIN) or part(m) != LEFT_OUT and _holds_main(m) for m in inner)


def plan(wrapper: Node) -> list[list[str]]:
    """Slots to read, as paths of tokens, in tiers: a page takes the first tier that gives it text.

    The first tier are the articles, then main elements and elements classed as content, then the
    element whose own blocks hold most text that differs from page to page and is not linked, last
    everything. Menus, asides, footers, forms, notices, adverts and reader comments are left out of
    each, headers but for their headings, and articles inside articles, which are comments.
    """
    tiers: dict[str, list[str]] = {ARTICLE: [], MAIN: [], PLAIN: []}
    prose: dict[str, int] = {}
    slots: list[tuple[str, str, Node, int]] = []

    def walk(node: Node, path: str, regions: tuple[str, ...], header: bool) -> None:
        for group in node.groups:
            for m in group:
                here = f"{path}/{m.key}"
                if m.key == "#":
                    tag = node.key.split("@")[0].split(".")[0].split("#")[0].split("*")[0]
                    if header and tag not in HEADINGS:
                        continue
                    for region in {PLAIN, *regions}:
                        if not header or region != PLAIN:
                            tiers[region].append(here)
                    if not header:
                        slots.append((here, path.rpartition("/")[0], m, node.n))
                    continue
                kind = part(m)
                if kind == ARTICLE and ARTICLE in regions:
                    continue
                if kind == LEFT_OUT and not (m.key.startswith("form") and _holds_main(m)):
                    continue
                walk(m, here, (*regions, kind) if kind in (ARTICLE, MAIN) else regions, header or kind == HEADER)

    walk(wrapper, "", (), False)
    varied = [s for s in slots if s[2].text is None or s[2].n < 2] or slots
    for _, parent, m, _ in varied:
        prose[parent] = prose.get(parent, 0) + max(0, m.chars - 2 * m.linked)
    dense: list[str] = []
    if prose:
        best = max(sorted(prose), key=prose.get)
        dense = [here for here, parent, m, _ in varied if (parent == best or parent.startswith(best + "/")) and 2 * m.linked <= m.chars]
    return [t for t in (tiers[ARTICLE], tiers[MAIN], dense, tiers[PLAIN]) if t]


class Slots:
    """A wrapper's plan, ready to read pages with."""

    def __init__(self, tiers: list[list[str]]) -> None:
        self.tiers = [set(t) for t in tiers]
        self.levels = {p[:k] for t in tiers for p in t for k, c in enumerate(p) if c == "/"}

    def read(self, tokens: list[tuple]) -> str:
        """The text of a page's slots, in page order, one block a line."""
        paths = [""]
        found: list[list[str]] = [[] for _ in self.tiers]
        for token in tokens:
            if token[0] == OPEN:
                here = f"{paths[-1]}/{token[1]}"
                if here not in self.levels:
                    wide = f"{paths[-1]}/{general(token[1])}"
                    here = wide if wide in self.levels else here
                paths.append(here)
            elif token[0] == CLOSE:
                paths.pop()
            else:
                here = paths[-1] + "/#"
                for tier, texts in zip(self.tiers, found):
                    if here in tier:
                        texts.append(token[1])
        return "\n".join(next(filter(None, found), []))


def _dumped(node: Node) -> str:
    return json.dumps(node.dump(), ensure_ascii=False, separators=(",", ":"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the pages of each host that this task reads."""
    found: dict[str, Node] = {}
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            node = one_page(stream(page.as_py()))
            if host in found:
                align(found[host], node)
            else:
                found[host] = node
    if found:
        task = [TaskContext.get().partitionId()] * len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found)), pa.array(task, pa.int64()), pa.array(list(map(_dumped, found.values())))], ["host", "task", "wrapper"]
        )


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Node]]:
    """Wrappers that arrive sorted by host, aligned in that order to one for each host."""
    host, node = None, None
    for batch in batches:
        for name, dumped in zip(batch.column(0).to_pylist(), batch.column(1)):
            other = Node.load(json.loads(dumped.as_py()))
            if name == host:
                align(node, other)
                continue
            if node is not None:
                yield host, node
            host, node = name, other
    if node is not None:
        yield host, node


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batched(_hosts(batches), AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows]), pa.array([_dumped(n) for _, n in rows])], ["host", "wrapper"])


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batched(_hosts(batches), AT_ONCE):
        slots = [json.dumps(plan(n), ensure_ascii=False, separators=(",", ":")) for _, n in rows]
        columns = [[h for h, _ in rows], [n.n for _, n in rows], [n.expression() for _, n in rows], slots]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["host", "pages", "expression", "slots"])


def host_of(url: str = "url") -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end, in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)"))
    return F.lower(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, expression, slots: one wrapper per host, learned from all its pages.

    Each task aligns its own pages per host, so a host gives one wrapper a task however many pages it
    has; those are aligned in groups of about the square root of the tasks, then per host.
    """
    spark = pages.sparkSession
    rows = pages.select(host_of().alias("host"), C("html").cast("string").alias("html"))
    local = kept(rows.mapInArrow(_fold, "host string, task bigint, wrapper string"), "wrappers")
    tasks = (local.agg(F.max("task")).first()[0] or 0) + 1
    if tasks > 8:
        salted = [C("host"), C("task") % round(tasks**0.5)]
        local = local.repartition(parallelism(spark), *salted).sortWithinPartitions(*salted, "wrapper").select("host", "wrapper")
        local = local.mapInArrow(_fewer, "host string, wrapper string")
    ordered = local.repartition(parallelism(spark), "host").sortWithinPartitions("host", "wrapper").select("host", "wrapper")
    return kept(ordered.mapInArrow(_planned, "host string, pages bigint, expression string, slots string"), "plans")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plans: dict[str, Slots] = {}
    for batch in batches:
        texts = []
        for page, slots in zip(batch.column(2), batch.column(3).to_pylist()):
            if slots not in plans:
                if len(plans) >= 1024:
                    plans.clear()
                plans[slots] = Slots(json.loads(slots or "[]"))
            texts.append(plans[slots].read(stream(page.as_py())))
        chars = pa.array(list(map(len, texts)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), chars], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``: the main text, one block a line.

    A null html counts as empty; pages without text give an empty one. Pages whose url is null or has
    no ``://`` share one wrapper, that of the empty host. Repeated rows and ids each give their row;
    other columns are ignored; an empty table gives an empty result. Wrappers reach the pages by a
    broadcast only if those of all hosts take ``SENT`` bytes or less, else by a join on the host,
    in which adaptive execution splits hot hosts.
    """
    spark = pages.sparkSession
    safe_unions(spark)
    found = wrappers(pages).select("host", "slots")
    size = found.agg(F.sum(F.length("host") + F.octet_length("slots"))).first()[0] or 0
    rows = pages.select("page_id", "url", C("html").cast("string").alias("html"), host_of().alias("host"))
    joined = rows.join(F.broadcast(found) if size <= SENT else found, "host", "left")
    kind = dict(pages.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "slots").mapInArrow(_read, f"page_id {kind}, url string, text string, n_chars bigint")
