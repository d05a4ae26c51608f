"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element has a hidden label: content or not. Parent-child potentials (by the child's tag) connect the
labels along the tree; evidence of an element is its tag, its class, id and role words, and the amount of
text and of link text below it. Sum-product messages go from the leaves up and from the root down, and give
each element's exact marginal. Text whose element is more likely content than not is kept.

Potentials are counted on labelled pages: a few hand-labelled ones, and at most ``MAX_PAGES`` pages of the
table (those with the smallest hash of their id) that mark their article themselves, which labels all their
elements. Both parts weigh the same. All pages are extracted whole.

Fallback text of ``noscript`` is judged like other elements. Very long and deeply nested pages take time in
proportion to their length. Messages of a batch of pages are passed together, level by level, as arrays.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import bounded
from trajspark.llm.labelled_pages import PAGES

MAX_PAGES = 400
#: A hand-labelled page counts as so many pages at least.
HAND_WEIGHT = 20.0
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|data-main|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup, up to their own end tag.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
#: Elements that a slash at the end of their start tag may close.
CLOSED_BY_SLASH = frozenset("svg math object template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a start tag closes: those of the first set, up to one of the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Words that mark what lies in an article but is not of it, for the pages that label themselves.
NOT_CONTENT_TAGS = frozenset({"nav", "aside", "footer", "form", "button"})
NOT_CONTENT = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner comment comments reply share social related sidebar newsletter subscribe cookie notice popup modal menu nav breadcrumb footer copyright".split()
)
LENGTHS, SHARES = [1, 20, 60, 150, 400, 1200, 4000], [0.01, 0.2, 0.5, 0.8]


@dataclass
class Dom:
    """Elements in page order; ``runs`` are (element, block, decoded text)."""

    tags: list[str]
    words: list[list[str]]
    parents: list[int]
    levels: list[int]
    links: list[bool]
    runs: list[tuple[int, int, str]]


def parse(page: str | None) -> Dom:
    """Elements and text of a page, whole or broken off; markup, comments, templates and raw elements leave no text."""
    dom = Dom(["#root"], [[]], [-1], [0], [False], [])
    tags, parents, levels, links, runs = dom.tags, dom.parents, dom.levels, dom.links, dom.runs
    stack, block, last, at = [0], 0, 0, 0
    places: dict[str, list[int]] = {}  # of the open elements in the stack, by tag, so that closing takes no search
    inert = [False]  # whether elements are in a template, which is not shown
    page = page or ""

    def text(begin: int, end: int) -> None:
        raw = page[begin:end]
        if raw and not inert[stack[-1]]:
            runs.append((stack[-1], block, html.unescape(raw) if "&" in raw else raw))

    def close(k: int) -> None:
        """Close the open elements from place ``k`` of the stack on."""
        for element in stack[k:]:
            places[tags[element]].pop()
        del stack[k:]

    def innermost(names) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    while m := _TOKEN.search(page, at):
        if m.start() > last:
            text(last, m.start())
        last = at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                block += 1
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in BLOCK:
            block += 1
            closes, within = CLOSES.get(tag, ({"p"}, {"table", "td", "th", "button", "object"}))
            if (k := innermost(closes)) > innermost(within):
                close(k)
        if tag == "br":
            runs.append((stack[-1], block, " "))
        if tag in VOID:
            continue
        if tag in RAW:
            # A slash at the end closes it in drawings and formulas alone.
            if not (m[3].endswith("/") and (places.get("svg") or places.get("math"))):
                end = _RAW_END[tag].search(page, at)
                last = at = end.end() if end else len(page)
            continue
        words = []
        if m[3] and not m[3].isspace():
            for a in _ATTR.finditer(m[3]):
                name, value = a[1].lower(), a[2] or ""
                if name == "data-main":
                    words.append("#main" + value.strip("\"'"))
                else:
                    words += ["hidden"] if name == "hidden" else _WORD.findall(value.lower())
        parent = stack[-1]
        places.setdefault(tag, []).append(len(stack))
        stack.append(len(tags))
        tags.append(tag)
        dom.words.append(words)
        parents.append(parent)
        levels.append(levels[parent] + 1)
        links.append(links[parent] or tag == "a")
        inert.append(inert[parent] or tag == "template")
        if tag in CLOSED_BY_SLASH and m[3].endswith("/"):
            close(len(stack) - 1)
    if last < len(page):
        text(last, len(page))
    return dom


def own_labels(dom: Dom) -> np.ndarray | None:
    """Labels from marks in the page: ``data-main``, else one article or main element; None without."""
    marked = any(w.startswith("#main") for ws in dom.words for w in ws)
    roots = [k for k, t in enumerate(dom.tags) if t == "article"] or [k for k, t in enumerate(dom.tags) if t == "main"]
    if not marked and len(roots) != 1:
        return None
    y = np.zeros(len(dom.tags), np.int64)
    for k in range(1, len(y)):
        y[k] = y[dom.parents[k]]
        if marked:
            y[k] = 1 if "#main1" in dom.words[k] else 0 if "#main0" in dom.words[k] else y[k]
        elif k == roots[0]:
            y[k] = 1
        elif dom.tags[k] in NOT_CONTENT_TAGS or not NOT_CONTENT.isdisjoint(dom.words[k]):
            y[k] = 0
    return y


@dataclass
class Forest:
    """The elements of many pages as arrays."""

    doms: list[Dom]
    parent: np.ndarray
    level: np.ndarray
    first: np.ndarray
    length_bin: np.ndarray
    share_bin: np.ndarray

    @classmethod
    def of(cls, doms: list[Dom]) -> Forest:
        first = np.cumsum([0, *(len(d.tags) for d in doms)])
        parent = np.concatenate([np.array(d.parents) + f for d, f in zip(doms, first[:-1], strict=True)])
        level = np.concatenate([d.levels for d in doms])
        chars, linked = np.zeros(len(parent)), np.zeros(len(parent))
        for d, f in zip(doms, first[:-1].tolist(), strict=True):
            for k, _, t in d.runs:
                n = len(t.strip())
                chars[f + k] += n
                if d.links[k]:
                    linked[f + k] += n
        for at in _levels(level)[:0:-1]:
            np.add.at(chars, parent[at], chars[at])
            np.add.at(linked, parent[at], linked[at])
        share = linked / np.maximum(chars, 1)
        return cls(doms, parent, level, first, np.digitize(chars, LENGTHS), np.digitize(share, SHARES))

    def evidence(self, k: int, d: Dom, i: int) -> list[str]:
        """Keys of element ``i`` of page ``d``, which is number ``k`` of all."""
        words = [f"w:{w}" for w in set(d.words[i]) if w[0] != "#"] if d.words[i] else []
        return [f"t:{d.tags[i]}", f"n:{self.length_bin[k]}", f"s:{self.share_bin[k]}", *words]


def _levels(level: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(level, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(level[order])) + 1)


def count_page(dom: Dom, y: np.ndarray) -> Counter:
    """Counts of (key, label) for evidence and of (tag, parent's label, label) for edges."""
    forest, counts = Forest.of([dom]), Counter()
    for i in range(1, len(y)):
        for key in (*forest.evidence(i, dom, i), "all"):
            counts[key, int(y[i])] += 1
        p = int(y[dom.parents[i]])
        counts[f"e:{dom.tags[i]}|{p}", int(y[i])] += 1
        counts[f"e:|{p}", int(y[i])] += 1
    return counts


@dataclass
class Model:
    """Log odds of the evidence, and log potentials (parent's label, label) of an edge by tag."""

    odds: dict[str, float]
    edges: dict[str, np.ndarray]

    @classmethod
    def of(cls, counts: dict[tuple[str, int], float]) -> Model:
        get = lambda k, y: counts.get((k, y), 0.0)
        keys = {k for k, _ in counts}
        odds = {k: float(np.log((get(k, 1) + 0.5) / (get("all", 1) + 1)) - np.log((get(k, 0) + 0.5) / (get("all", 0) + 1))) for k in keys if k[:2] in ("t:", "n:", "s:", "w:")}
        both = np.array([[get(f"e:|{p}", y) + 1.0 for y in (0, 1)] for p in (0, 1)])
        both /= both.sum(1, keepdims=True)
        edges = {"": np.log(both)}
        for tag in {k[2:].partition("|")[0] for k in keys if k.startswith("e:")} - {""}:
            own = np.array([[get(f"e:{tag}|{p}", y) for y in (0, 1)] for p in (0, 1)]) + 2.0 * both
            edges[tag] = np.log(own / own.sum(1, keepdims=True))
        return cls(odds, edges)

    def marginals(self, forest: Forest) -> np.ndarray:
        """Probability that each element is content; the root of a page is not."""
        n = len(forest.parent)
        own, edge, k = np.zeros(n), np.zeros((n, 2, 2)), 0
        for d in forest.doms:
            for i, tag in enumerate(d.tags):
                own[k] = sum(self.odds.get(key, 0.0) for key in forest.evidence(k, d, i))
                edge[k] = self.edges.get(tag, self.edges[""])
                k += 1
        own[forest.first[:-1]] = -50.0
        levels, up, below = _levels(forest.level), np.zeros(n), own.copy()
        for at in levels[:0:-1]:
            e, b = edge[at], below[at]
            up[at] = np.logaddexp(e[:, 1, 0], e[:, 1, 1] + b) - np.logaddexp(e[:, 0, 0], e[:, 0, 1] + b)
            np.add.at(below, forest.parent[at], up[at])
        total = below.copy()
        for at in levels[1:]:
            e, rest = edge[at], total[forest.parent[at]] - up[at]
            total[at] += np.logaddexp(e[:, 0, 1], e[:, 1, 1] + rest) - np.logaddexp(e[:, 0, 0], e[:, 1, 0] + rest)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def text_of(dom: Dom, content: np.ndarray) -> str:
    """Content text: white space inside a block becomes one space, blocks are joined by line feeds."""
    blocks: dict[int, list[str]] = {}
    for k, block, t in dom.runs:
        if content[k]:
            blocks.setdefault(block, []).append(t)
    found = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(b for b in found if b)


def extract(pages: list[str | None], model: Model) -> list[str]:
    doms = [parse(p) for p in pages]
    if not doms:
        return []
    forest = Forest.of(doms)
    content = model.marginals(forest) > 0.5
    return [text_of(d, content[b:e]) for d, b, e in zip(doms, forest.first[:-1], forest.first[1:], strict=True)]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES, seed: int = 3) -> Model:
    """Count potentials on the hand-labelled pages and on self-labelled pages of a bounded sample."""
    import pyarrow as pa

    # A page is ordered by the hash of its id, then of its text, so that repeated ids have an order too.
    order = [F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.xxhash64(F.col(html_col))]
    sample = pages.select(F.col(html_col).cast("string").alias("html"), order[0].alias("a"), order[1].alias("b"))
    sample = sample.where(F.lower("html").rlike("<(article|main)[\\s>]"))
    chosen = sample.select("a", "b").orderBy("a", "b").limit(max_pages).distinct()

    def run(batches):
        for batch in bounded(batches, 0):
            counts = Counter()
            for page in batch.column(0).to_pylist():
                dom = parse(page)
                y = own_labels(dom)
                if y is not None:
                    counts.update(count_page(dom, y))
            rows = [(k, y, float(v)) for (k, y), v in counts.items()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "label", "n"])

    counted = sample.join(F.broadcast(chosen), ["a", "b"], "left_semi").select("html").mapInArrow(run, "key string, label int, n double")
    theirs = {(r["key"], r["label"]): r["n"] for r in counted.groupBy("key", "label").agg(F.sum("n").alias("n")).collect()}
    ours = Counter()
    for page in PAGES:
        dom = parse(page)
        ours.update(count_page(dom, own_labels(dom)))
    total = lambda c: sum(n for (k, _), n in c.items() if k == "all")
    weight = max(HAND_WEIGHT, total(theirs) / total(ours))
    return Model.of({k: theirs.get(k, 0.0) + weight * ours.get(k, 0) for k in theirs.keys() | ours.keys()})


def extract_pages(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` (empty if none) and ``n_chars`` (code points) of every page.

    A null or empty page has no text. Pages are extracted one by one, so repeated rows stay repeated.
    """
    import pyarrow as pa

    model = model or fit(pages, id_col, html_col)

    def run(batches):
        for batch in bounded(batches, 2):
            texts = extract(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"]
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
