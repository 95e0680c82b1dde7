"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks. A classifier gives each block a log-odds of being content: what its enclosing
elements say (fixed word lists: names that settle it, and names that articles bear too, which only lean), and a
logistic model of the text itself, trained on blocks whose enclosing elements leave no doubt. The costs of the two labels are the capacities to source and sink; neighbouring blocks
and blocks close in the document tree are joined by smoothness edges; the minimum cut is the labelling.

Blocks whose own cost exceeds all their edges are settled first, which is exact and leaves few blocks for the
maximum flow. Whole pages are read; nothing is dropped or cut but what is labelled boilerplate.

Defined results: a null or empty page, or one without content, has the empty text; a page that ends inside a tag
loses that tag; repeated rows are extracted alike; an empty table gives no row. Only page_id, url and html are
read, and any of them may be null.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.html_blocks import Block, Page, read_page

# Fixed word lists: element names, roles and parts of class or id names.
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select option fieldset legend head search".split())
BOILER_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar status".split())
BOILER_NAMES = frozenset(
    "nav navbar navigation menu footer header masthead topbar sidebar aside ad ads advert advertisement adverts "
    "advertising adsense adbox adslot sponsor sponsored promo banner cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe subscription signup login signin comment comments "
    "commentlist disqus reply replies recommended recommendations recirculation "
    "breadcrumb breadcrumbs pagination pager paging toolbar copyright disclaimer outbrain taboola taglist".split())
# Names of boilerplate that real articles bear as well.
UNSURE_NAMES = frozenset(
    "foot side rail promotion alert register respond responses discussion reader related teaser trending popular share sharing "
    "social widget skip legal search form tags".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_ROLES = frozenset(("main", "article"))
CONTENT_NAMES = frozenset("article articlebody content post story entry maincontent bodytext main".split())
FEATURES = 6
NO_SIGN = (False, False, False)


@dataclass(frozen=True)
class Settings:
    """Log-odds of the enclosing elements, bound of the text model's log-odds, and smoothness weights."""

    bias: float = 0.3
    boiler: float = -8.0
    unsure: float = -2.0
    content: float = 2.5
    text_bound: float = 2.5
    adjacent: float = 0.5
    sibling: float = 0.1
    decay: float = 3.0
    sample_pages: int = 2000


def enclosing_signs(page: Page) -> list[tuple[bool, bool, bool]]:
    """(boilerplate, content, perhaps boilerplate) of each element, with what its ancestors say."""
    out: list[tuple[bool, bool, bool]] = []
    for e in page.elements:
        boiler, content, unsure = out[e.parent] if e.parent >= 0 else NO_SIGN
        named = False
        if e.tag not in ("html", "body"):
            named = not e.names.isdisjoint(BOILER_NAMES)
            leaning = not e.names.isdisjoint(UNSURE_NAMES)
            # A wrapper named after its sidebar, with the article inside, says nothing.
            boiler = boiler or e.tag in BOILER_TAGS or e.role in BOILER_ROLES or e.hidden or (named and not e.main_below)
            unsure = unsure or leaning and not e.main_below
            named = named or leaning
            if e.tag == "header" and not content:
                boiler = boiler or not e.main_below
        content = content or e.tag in CONTENT_TAGS or e.role in CONTENT_ROLES or (
            e.tag not in ("html", "body") and not named and not e.names.isdisjoint(CONTENT_NAMES))
        out.append((boiler, content, unsure))
    return out


def text_features(b: Block) -> list[float]:
    words = b.text.split()
    return [
        1.0, min(b.link_chars / len(b.text), 1.0), math.log1p(len(words)), float(b.text[-1] in ".!?…:;\"”»"),
        min(sum(map(len, words)) / len(words), 20.0) / 10, float("©" in b.text or "|" in b.text)]


def log_odds(page: Page, weights: np.ndarray | None, settings: Settings) -> list[float]:
    signs = enclosing_signs(page)
    out = []
    for b in page.blocks:
        boiler, content, unsure = signs[b.element] if b.element >= 0 else NO_SIGN
        s = settings.bias + settings.boiler * boiler + settings.unsure * unsure + settings.content * content + (0.5 if b.heading else 0.0)
        if weights is not None:
            text = sum(w * x for w, x in zip(weights, text_features(b)))
            s += max(-settings.text_bound, min(settings.text_bound, text))
        out.append(s)
    return out


def smoothness(page: Page, settings: Settings) -> list[tuple[int, int, float]]:
    """Edges between neighbours, weaker the further apart in the tree, and between blocks of one parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(page.blocks):
        parent = page.elements[b.element].parent if b.element >= 0 else -1
        if i:
            steps = page.distance(page.blocks[i - 1].element, b.element)
            edges.append((i - 1, i, settings.adjacent / (1 + max(0, steps - 2)) ** settings.decay))
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, settings.sibling))
        last[parent] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (true: source side) of least cost: max(0, odds) cut from the source, max(0, -odds) from the sink.

    Equal to the costs log(1 + exp(-odds)) and log(1 + exp(odds)), whose difference is the odds.
    """
    n = len(odds)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    pull = list(odds)
    label: list[bool | None] = [None] * n
    loose = [sum(w for _, w in near[i]) for i in range(n)]
    queue = deque(range(n))
    while queue:  # a block that no neighbour can outweigh is settled and pulls its neighbours
        i = queue.popleft()
        if label[i] is not None or abs(pull[i]) < loose[i] or pull[i] == 0 and loose[i] == 0:
            continue
        label[i] = pull[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                pull[j] += w if label[i] else -w
                loose[j] -= w
                queue.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, side in zip(left, _flow(left, pull, near, label)):
            label[i] = side
    return [bool(x) for x in label]


def _flow(left: list[int], pull: list[float], near, label) -> list[bool]:
    """Source side of the minimum cut among the unsettled blocks, by shortest augmenting paths in phases."""
    name = {v: k for k, v in enumerate(left)}
    n = len(left)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in left:
        if pull[i] > 0:
            edge(source, name[i], pull[i], 0.0)
        elif pull[i] < 0:
            edge(name[i], sink, -pull[i], 0.0)
        for j, w in near[i]:
            if j > i and j in name:
                edge(name[i], name[j], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        while True:  # one augmenting path along the levels, without recursion
            path: list[int] = []
            a = source
            while a != sink:
                while turn[a] < len(out[a]):
                    e = out[a][turn[a]]
                    if room[e] > tiny and level[to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(out[a]):
                    path.append(out[a][turn[a]])
                    a = to[path[-1]]
                elif path:
                    level[a] = -2
                    a = to[path.pop() ^ 1]
                else:
                    break
            if a != sink:
                break
            least = min(room[e] for e in path)
            for e in path:
                room[e] -= least
                room[e ^ 1] += least


def extract(source: str | None, weights: np.ndarray | None = None, settings: Settings = Settings()) -> str:
    if not source:
        return ""
    page = read_page(source)
    if not page.blocks:
        return ""
    labels = minimum_cut(log_odds(page, weights, settings), smoothness(page, settings))
    return "\n".join(b.text for b, content in zip(page.blocks, labels) if content)


def train_text_model(pages: DataFrame, settings: Settings = Settings()) -> np.ndarray | None:
    """Weights of a logistic model of the text features; None if a label has no block.

    Labels are what enclosing elements say without doubt. At most about ``sample_pages`` pages are drawn by the
    hash of page_id; they are reduced to Newton sums in the tasks, so a few numbers come back a step.
    """
    share = max(1, -(-pages.count() // settings.sample_pages))
    drawn = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(share)) == 0).select(F.col("html").cast("string").alias("html"))

    def features(batches):
        for batch in batches:
            rows = []
            for source in batch.column("html"):
                page = read_page(source.as_py() or "")
                signs = enclosing_signs(page)
                for b in page.blocks:
                    boiler, content, unsure = signs[b.element] if b.element >= 0 else NO_SIGN
                    if boiler != content and not unsure:
                        rows.append([float(content), *text_features(b)])
            # Blocks with like features are one row with a count: what comes back is small.
            table = np.round(np.asarray(rows, float).reshape(-1, FEATURES + 1), 1)
            kinds, n = np.unique(table, axis=0, return_counts=True) if len(table) else (table, np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(kinds), pa.list_(pa.float64())), pa.array(n, pa.int64())], names=["x", "n"])

    got = drawn.mapInArrow(features, "x array<double>, n long").groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").toArrow()
    if not got.num_rows:
        return None
    rows, n = np.asarray(got.column("x").to_pylist()), got.column("n").to_numpy().astype(float)
    y, x = rows[:, 0], rows[:, 1:]
    if not 0 < y.sum() < len(y):
        return None
    n = n * np.where(y == 1, 0.5 / n[y == 1].sum(), 0.5 / n[y == 0].sum())  # both labels weigh the same
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (n * (y - p)) - 0.001 * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 0.001 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


def extract_pages(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = train_text_model(pages, settings)
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), weights, settings) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
