"""Main text of web pages by gradient-boosted trees over the features of block elements.

Each block element gets a likelihood of three classes: main text, a wrapper around both, and boilerplate. The features are what the element
and the elements around it are called, how densely text, links and punctuation stand below it, how deep it lies and how it compares with its
siblings. Decoding is hierarchical: the page's most likely labelling under the rules that nothing below boilerplate is main text or wrapper,
and that nothing below main text is a wrapper; so an element and its ancestor never contradict each other. Pages are read and decoded in
batches where Spark reads them; nothing is shuffled. The trees are trained on pages made by rule, whose main text is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.llm import texts as T
from buildlore.llm import trees
from buildlore.llm.base import query, table
from buildlore.llm.html_pages import BOILER, MAIN, WRAPPER, PageMaker
from buildlore.llm.html_tree import Node, Page

TRAINING_PAGES = 900
ROUNDS = 24
SEED = 5
_FORBIDDEN = {MAIN: (WRAPPER,), WRAPPER: (), BOILER: (MAIN, WRAPPER)}


@dataclass(frozen=True)
class Model:
    odds: dict[str, tuple[float, float, float]]  # of a tag or attribute token: shares of the classes
    forest: trees.Forest


def _token_shares(pages: list[tuple[Page, list[int]]]) -> dict[str, tuple[float, float, float]]:
    counts: dict[str, np.ndarray] = {}
    for page, labels in pages:
        for node, label in zip(page.nodes, labels):
            for token in set(node.tokens):
                counts.setdefault(token, np.full(3, 0.5))[label] += 1
    return {t: tuple(c / c.sum()) for t, c in counts.items() if c.sum() >= 4}


def features(page: Page, odds: dict) -> list[list[float]]:
    """A row for each block element of the page."""
    nodes, out = page.nodes, []
    whole = max(1, nodes[0].total)
    unknown = (1 / 3, 1 / 3, 1 / 3)
    above: list[tuple[float, float]] = []  # the strongest sign of boilerplate and of main text among an element and its ancestors
    order, largest = [0] * len(nodes), [0] * len(nodes)
    for k, x in enumerate(nodes):
        for i, c in enumerate(x.children):
            order[c] = i
            largest[k] = max(largest[k], nodes[c].total)
    for i, x in enumerate(nodes):
        tag = odds.get(x.tokens[0], unknown)
        named = [odds[t] for t in x.tokens[1:] if t in odds]
        own_boiler = max((s[BOILER] for s in named), default=-1.0)
        own_main = max((s[MAIN] for s in named), default=-1.0)
        mean_main = sum(s[MAIN] for s in named) / len(named) if named else -1.0
        up: Node | None = nodes[x.parent] if x.parent >= 0 else None
        up_boiler, up_main = above[x.parent] if up else (0.0, 0.0)
        above.append((max(up_boiler, own_boiler, tag[BOILER]), max(up_main, own_main, tag[MAIN])))
        beside = max(1, up.total) if up else whole
        siblings = len(up.children) if up else 1
        biggest = largest[x.parent] if up else x.total
        paragraphs = sum(nodes[c].tag == "p" for c in x.children)
        out.append([
            tag[MAIN], tag[WRAPPER], tag[BOILER], own_main, own_boiler, mean_main, up_main, up_boiler, float(x.depth),
            math.log1p(x.total), math.log1p(x.own), x.own / max(1, x.total), x.all_links / max(1, x.total), x.total / whole, x.total / beside,
            x.total / max(1, biggest), x.total / (1 + x.inner), 100 * x.all_marks / max(1, x.total), float(len(x.children)), float(paragraphs),
            float(order[i]), float(siblings), x.place / page.length, up.all_links / max(1, up.total) if up else 0.0, float(x.tag == "p"), float(len(x.tokens)),
        ])
    return out


def decode(page: Page, likely: list[list[float]]) -> list[int]:
    """The labelling of highest likelihood in which no element contradicts its ancestors; ties go to the class listed first."""
    nodes = page.nodes
    best = [list(row) for row in likely]
    choice: list[list[tuple[int, int, int]]] = [[(0, 0, 0)] * 3 for _ in nodes]
    allowed = {s: [c for c in (MAIN, WRAPPER, BOILER) if c not in _FORBIDDEN[s]] for s in (MAIN, WRAPPER, BOILER)}
    for i in range(len(nodes) - 1, 0, -1):
        up = best[nodes[i].parent]
        own = best[i]
        picks = [max(allowed[s], key=own.__getitem__) for s in (MAIN, WRAPPER, BOILER)]
        choice[i] = picks
        for s in (MAIN, WRAPPER, BOILER):
            up[s] += own[picks[s]]
    labels = [max((MAIN, WRAPPER, BOILER), key=best[0].__getitem__)]
    for i in range(1, len(nodes)):
        labels.append(choice[i][labels[nodes[i].parent]])
    return labels


@lru_cache(maxsize=1)
def fit(pages: int = TRAINING_PAGES, seed: int = SEED) -> Model:
    """Trees trained on `pages` pages made by rule. Token shares come from other pages than the trees, so that trees learn how far to trust them."""
    maker = PageMaker(seed)
    made = [maker.page() for _ in range(pages)]
    read = [(Page(source), labels) for source, labels in made]
    half = len(read) // 2
    odds = _token_shares(read[:half])
    x = np.array([row for page, _ in read[half:] for row in features(page, odds)])
    y = np.array([label for _, labels in read[half:] for label in labels])
    return Model(odds, trees.fit(x, y, 3, ROUNDS))


def extract_batch(sources: list[str], model: Model) -> list[str]:
    pages = [Page(s) for s in sources]
    rows = [row for page in pages for row in features(page, model.odds)]
    likely = model.forest.log_likelihood(np.array(rows)).tolist()
    out, at = [], 0
    for page in pages:
        n = len(page.nodes)
        labels = decode(page, likely[at : at + n])
        out.append(page.text([label == MAIN for label in labels]))
        at += n
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text) of every row: its main text, a line a block; empty for a null or empty page and where nothing is main text.

    Pages are read whole, whatever their length. Rows repeat as they come, null keys too; other columns are not looked at.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, urls, sources = T.columns_of(batch, "_key", "url", "_html")
            for a, b in T.slices(sources):
                texts = extract_batch([s or "" for s in sources[a:b].to_pylist()], m)
                yield pa.RecordBatch.from_arrays([ids[a:b], urls[a:b], pa.array(texts, pa.string())], ["_key", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    slim = pages.select(F.col("page_id").alias("_key"), F.col("url").cast("string").alias("url"), F.col("html").alias("_html"))
    return slim.mapInArrow(run, f"_key {kind}, url string, text string").withColumnRenamed("_key", "page_id")


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
