"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every text block of a page is a node that is content or not. A node has a potential from its
tag, its class and id words and, for text, its length, links and punctuation; parent and child share a potential for
each pair of states. Sum-product messages pass from the leaves up and back down, level by level over all pages of an
Arrow batch at once, and give each text block's exact marginal; blocks more likely content than not are kept, in page
order. Potentials are counted on labelled pages, at most about ``SAMPLE_PAGES`` of them, chosen by the hash of their
key, on top of small prior counts for tags and class words with a usual meaning.

Scripts, styles, comments, templates and other markup without readable text never become blocks. Character references
are decoded, white space inside a block is one space, blocks are joined by two line feeds; nothing is cut. Of markup that
is left out, only an unclosed script, style, text area or title reaches to the end of the page, as in browsers; of other
unclosed elements the tag alone is left out. ``<svg/>`` ends at once, and the text of formulas stays.

Defined cases: null or empty html gives an empty text; pages without markup are one block; unclosed and stray tags are
handled as browsers mostly do (a block ends an open paragraph, a list item the one before); without labelled pages the
prior decides alone; repeated rows are repeated in the result; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.tables import stored

SAMPLE_PAGES = 2_000
PRIOR = 4.0  # weight of a prior, in labelled nodes
LOWEST, HIGHEST = -6.0, 3.0  # a feature may speak louder against content than for it
TEXT_WEIGHT = 0.5  # the features of a text block repeat each other
EDGE_WEIGHT = 1.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title".split())  # no tags inside; to the end of the page if unclosed
DROPPED = frozenset("noscript template select svg iframe object canvas audio video".split())
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
HEAD_END = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.I)
BARE_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")  # the slash belongs to a value without quotes
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
BOILERPLATE = frozenset(
    "nav navigation menu header footer sidebar aside ad ads advert advertisement sponsor sponsored banner promo cookie cookies consent notice alert popup modal newsletter subscribe signup login share social related recommended comment comments reply replies respond disqus form search breadcrumb breadcrumbs pagination pager copyright legal widget toolbar button label legend dialog fieldset masthead teaser".split()
)
NEUTRAL = frozenset("div section span ul ol li dl dd dt table tbody tr td center figure".split())  # only their names speak
CONTENT = frozenset("article main content post entry story body text paragraph p h1 h2 pre blockquote".split())


class Page:
    """Nodes in page order: parent, feature names, and for text blocks the text."""

    __slots__ = ("parent", "features", "text")

    def __init__(self) -> None:
        self.parent, self.features, self.text = [-1], [("tag:root",)], [None]

    def add(self, parent: int, features: tuple[str, ...], text: str | None) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        return len(self.parent) - 1


def _level(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


def _closed(attributes: str) -> bool:
    return attributes.endswith("/") and not BARE_SLASH.search(attributes)


def _ends(source: str, at: int) -> dict[int, int]:
    """Where each dropped element from ``at`` on ends, by the end of its opening tag; unclosed ones are missing."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    while token := TOKEN.search(source, at):
        at = token.end()
        name = (token[2] or "").lower()
        if name not in DROPPED and name not in RAW and name != "math":
            continue
        own = opened.setdefault(name, [])
        foreign = opened.get("svg") or opened.get("math")
        if token[1]:
            if own:
                ends[own.pop()] = at
        elif _closed(token[3]) and (name in ("svg", "math") or foreign):
            continue
        elif name in RAW:
            end = RAW_END[name].search(source, at)
            at = end.end() if end else at if foreign else len(source)
        else:
            own.append(at)
    return ends


def parse(source: str) -> Page:
    page, stack, parts = Page(), [("", 0)], []
    link, linked, at = False, 0, 0
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                tag, node = stack[-1]
                share = linked / len(text)
                page.add(
                    node,
                    (f"in:{tag}", f"words:{_level(text.count(' ') + 1, (2, 4, 8, 16, 32, 64))}", f"links:{_level(share, (0.05, 0.4, 0.8))}", f"end:{text[-1] in '.!?:;,)”»'}", f"mark:{'©' in text}"),
                    text,
                )
        linked = 0

    while True:
        token = TOKEN.search(source, at)
        text = source[at : token.start() if token else len(source)]
        if text:
            parts.append(text)
            linked += len(text) * link
        if token is None:
            break
        at = token.end()
        closing, name = token[1], token[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not closing:
            end = RAW_END[name].search(source, at)
            at = end.end() if end else len(source)
            continue
        if name == "head" and not closing:  # ends at its end tag or where the body begins
            end = HEAD_END.search(source, at)
            at = end.end() if end else at
            continue
        if name in DROPPED:
            if not closing and not (name == "svg" and _closed(token[3])):
                if ends is None:
                    ends = _ends(source, token.start())
                at = ends.get(at, at)
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link = not closing
        elif name == "hr":
            flush()
        elif name in BLOCKS or ("-" in name and name != "annotation-xml"):
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                link = False
                continue
            if stack[-1][0] == "p":
                stack.pop()
            if name in SIBLINGS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in SCOPES.get(name, ()):
                        break
                    if stack[k][0] in SIBLINGS[name]:
                        del stack[k:]
                        break
                    if name == "p":
                        break
            words = {w.lower() for found in NAMES.findall(token[3] or "") for value in found for w in PARTS.findall(value)}
            stack.append((name, page.add(stack[-1][1], (f"tag:{name}", *(f"name:{w}" for w in sorted(words))), None)))
    flush()
    return page


def prior(feature: str) -> float:
    """Log-odds of content before any page is seen."""
    kind, _, value = feature.partition(":")
    if kind in ("tag", "in", "name"):
        return LOWEST if value in BOILERPLATE else 1.0 if value in CONTENT else 0.0
    return {"links:3": -2.0, "links:2": -1.0, "mark:True": -2.0, "words:0": -0.5, "words:4": 0.5, "words:5": 1.0, "words:6": 1.0}.get(feature, 0.0)


def potentials(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds per feature from (boilerplate, content) node counts, relative to all nodes of the kind (elements for names)."""
    totals: dict[str, list[float]] = {}
    for feature, (no, yes) in counts.items():
        kind = totals.setdefault(feature.partition(":")[0], [0.0, 0.0])
        kind[0] += no
        kind[1] += yes
    out = {}
    for feature, (no, yes) in counts.items():
        kind, _, value = feature.partition(":")
        if value in NEUTRAL:
            out[feature] = 0.0
            continue
        all_no, all_yes = totals["tag" if kind == "name" else kind]
        base = 1 / (1 + np.exp(-prior(feature)))
        odds = np.log(yes + PRIOR * base) - np.log(no + PRIOR * (1 - base))
        out[feature] = float(odds - np.log((all_yes + PRIOR / 2) / (all_no + PRIOR / 2)))
    return out


def marginals(parent: np.ndarray, depth: np.ndarray, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Log-odds of content of every node of a forest, exactly, from node and edge log potentials.

    ``node`` has (not content, content) per node, ``edge[p, c]`` the potential of parent state p and child state c.
    """
    up = node.copy()
    message = np.zeros_like(node)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if len(depth) else []
    for at in reversed(levels[1:]):
        message[at] = np.logaddexp(edge[:, 0] + up[at, :1], edge[:, 1] + up[at, 1:])
        np.add.at(up, parent[at], message[at])
    belief = up.copy()
    for at in levels[1:]:
        above = belief[parent[at]] - message[at]
        belief[at] = up[at] + np.logaddexp(edge[0] + above[:, :1], edge[1] + above[:, 1:])
    return belief[:, 1] - belief[:, 0]


def _forest(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    parent, depth, base = [], [], 0
    for page in pages:
        own = [0]
        for p in page.parent[1:]:
            own.append(own[p] + 1)
        parent += [base + p if p >= 0 else -1 for p in page.parent]
        depth += own
        base += len(own)
    return np.array(parent, np.int64), np.array(depth, np.int64)


def content_odds(pages: list[Page], model: dict) -> list[np.ndarray]:
    if not pages:
        return []
    parent, depth = _forest(pages)
    weights = model["features"]
    clipped = {f: min(max(w, LOWEST), HIGHEST) for f, w in weights.items()}
    odds = np.array([sum(clipped[f] if f in clipped else prior(f) for f in fs) * (1.0 if t is None else TEXT_WEIGHT) for page in pages for fs, t in zip(page.features, page.text)])
    node = np.stack([np.zeros(len(odds)), odds], 1)
    found = marginals(parent, depth, node, EDGE_WEIGHT * np.array(model["edges"]))
    return np.split(found, np.cumsum([len(p.parent) for p in pages])[:-1])


def node_labels(page: Page, known: str) -> list[bool] | None:
    """Content or not per node, from the page's known main text; None if no block of five words is in it."""
    known = SPACE.sub(" ", known)
    inside = [t is not None and t in known for t in page.text]
    if not any(ok and t.count(" ") >= 4 for ok, t in zip(inside, page.text)):
        return None
    size, good = [0] * len(inside), [0] * len(inside)
    for k in range(len(inside) - 1, -1, -1):
        if page.text[k] is not None:
            size[k] = len(page.text[k])
            good[k] = size[k] * inside[k]
        if k:
            size[page.parent[k]] += size[k]
            good[page.parent[k]] += good[k]
    return [2 * g > s for g, s in zip(good, size)]


def fit(labelled: DataFrame, html: str = "html", known: str = "known") -> dict:
    """The model from pages with their known main text: counts per feature and per (parent, child) state, added up in Spark."""
    source = labelled.select(F.col(f"`{html}`").alias("html"), F.col(f"`{known}`").alias("known")).where("html is not null and known is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for source, known in zip(batch.column("html").to_pylist(), batch.column("known").to_pylist()):
                page = parse(source)
                labels = node_labels(page, known)
                if labels is None:
                    continue
                for k, yes in enumerate(labels):
                    counts.update((f, yes) for f in page.features[k])
                    if k:
                        counts[f"edge:{int(labels[page.parent[k]])}", yes] += 1
        yield pa.RecordBatch.from_pydict({"feature": [f for f, _ in counts], "content": [bool(y) for _, y in counts], "n": list(counts.values())}, pa.schema([("feature", pa.string()), ("content", pa.bool_()), ("n", pa.int64())]))

    rows = source.mapInArrow(run, "feature string, content boolean, n bigint").groupBy("feature", "content").agg(F.sum("n").alias("n")).collect()  # bounded by the sample
    counts: dict[str, list[int]] = {}
    for feature, content, n in rows:
        counts.setdefault(feature, [0, 0])[int(content)] += n
    edges = np.array([[*counts.pop("edge:0", (0, 0))], [*counts.pop("edge:1", (0, 0))]], float) + np.array([[8.0, 2.0], [2.0, 8.0]])
    # Relative to the children's share, so that an edge says only how alike parent and child are.
    share = edges.sum(axis=0) / edges.sum()
    return {"features": potentials({f: (c[0], c[1]) for f, c in counts.items()}), "edges": np.log(edges / edges.sum(axis=1, keepdims=True) / share).tolist()}


def extract(pages: DataFrame, model: dict, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_blocks, kept_blocks) of every page."""
    source = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                trees = [parse(h or "") for h in rows.column("html").to_pylist()]
                texts, blocks, kept = [], [], []
                for page, odds in zip(trees, content_odds(trees, shared.value)):
                    own = [(t, o) for t, o in zip(page.text, odds.tolist()) if t is not None]
                    chosen = [t for t, o in own if o > 0]
                    texts.append("\n\n".join(chosen))
                    blocks.append(len(own))
                    kept.append(len(chosen))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(blocks, pa.int64()), pa.array(kept, pa.int64())],
                    ["key", "url", "text", "n_chars", "n_blocks", "kept_blocks"],
                )

    kind = source.schema["key"].dataType.simpleString()
    found = source.mapInArrow(run, f"key {kind}, url string, text string, n_chars bigint, n_blocks bigint, kept_blocks bigint")
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars", "n_blocks", "kept_blocks")


def known_texts(pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(html, known) of pages whose url ends in the number of a stored document; of many about ``SAMPLE_PAGES``, by the hash of their key."""
    number = F.regexp_extract(F.col(f"`{url}`"), r"/(\d{1,18})(?:[./?#]|$)", 1).try_cast("long")
    place = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1 << 30))
    numbered = pages.select(number.alias("number"), place.alias("place"), F.col(f"`{html}`").alias("html")).where("number is not null and html is not null")
    known = docs.select(F.col(f"`{doc_key}`").alias("number"), F.col(f"`{text}`").alias("known")).where("known is not null")
    labelled = stored(numbered.select("number", "place").join(known.select("number"), "number", "left_semi"), "labelled-pages")
    total = labelled.count()
    chosen = F.col("place") <= (1.0 if total <= SAMPLE_PAGES else SAMPLE_PAGES / total) * (1 << 30)
    # At most about SAMPLE_PAGES numbers, whatever the data.
    wanted = F.broadcast(stored(labelled.where(chosen).select("number").distinct(), "labelled-numbers"))
    sample = stored(numbered.where(chosen).join(wanted, "number", "left_semi").select("number", "html"), "page-sample")
    return sample.join(known.join(wanted, "number", "left_semi").dropDuplicates(["number"]), "number").select("html", "known")
