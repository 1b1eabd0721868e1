"""Recurrent block labeller: a bidirectional LSTM in numpy that marks each block of a page as main text or not.

A block's input is the sum of the vectors of its tag path's hashed names, the mean vector of all its
hashed words, and three numbers. Both directions read the whole page, so a block is judged in its
document's context. It is trained here, on composed pages whose labels are known and on at most
TRAIN_PAGES pages of the table, labelled by the elements that HTML and common class names set aside
for main text and for everything else.

Null html is empty and gives an empty text. Repeated rows are pages of their own. Nothing is dropped
or capped: every block of every page is labelled; of elements nested deeper than 48, a path names the outermost
16 and the innermost 32, so that a page's work grows with its length. An empty table gives an empty result. A table's own
columns named text or n_chars give way to the result's.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .htmlblocks import PATH_BINS, WORD_BINS, Blocks

PATH_DIMS, WORD_DIMS, NUMBERS, HIDDEN = 24, 8, 3, 16
#: Bound of the labelled sample, composed pages, passes over both, and blocks of a page in training.
TRAIN_PAGES, COMPOSED_PAGES, EPOCHS, TRAIN_BLOCKS, SEED = 200, 700, 10, 150, 7
BATCH = 64

# Names that pages give to containers of the main text and of all else.
MAIN_TAGS = "article main".split()
MAIN_NAMES = "article article-body article-content body-text content content-body entry entry-content main main-content post post-body post-content story story-body text".split()
OTHER_TAGS = "nav header footer aside form".split()
OTHER_NAMES = {
    "nav": "menu nav navbar navigation breadcrumb breadcrumbs topnav site-nav pagination pager toc-links tabs".split(),
    "header": "header masthead site-header top banner branding logo page-header topbar".split(),
    "footer": "footer site-footer bottom copyright colophon legal page-footer credits".split(),
    "aside": "sidebar side aside widget related related-posts recommended trending popular more-stories tags tag-list share sharing social author-box".split(),
    "notice": "notice cookie cookie-banner consent alert gdpr popup modal warning message subscribe newsletter paywall signup".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense commercial".split(),
    "form": "form search search-form login contact-form signup-form".split(),
    "comments": "comments comment comment-list comment-body reader-comments discussion replies reply disqus responses".split(),
}


@dataclass
class Page:
    """The blocks of a page as arrays: bins with the block they belong to."""

    path: np.ndarray
    path_at: np.ndarray
    words: np.ndarray
    words_at: np.ndarray
    numbers: np.ndarray
    n: int


class Featurizer:
    def __init__(self):
        self.known: dict[str, int] = {}

    def word(self, w: str) -> int:
        if len(self.known) > 1 << 18:
            self.known.clear()
        self.known[w] = b = zlib.crc32(w.lower().encode()) % WORD_BINS
        return b

    def page(self, blocks: list[tuple[str, tuple[int, ...], int]]) -> Page:
        known, learn = self.known, self.word
        path, words, sizes, counts, numbers = [], [], [], [], []
        for text, bins, linked in blocks:
            own = text.split(" ")
            path += bins
            words += [known[w] if w in known else learn(w) for w in own]
            sizes.append(len(bins))
            counts.append(len(own))
            numbers.append((np.log1p(len(text)) / 5, linked / len(text), min(1.0, len(own) / 50)))
        starts = lambda x: np.cumsum([0, *x[:-1]]) if x else np.zeros(0, np.int64)
        return Page(np.array(path, np.int64), starts(sizes), np.array(words, np.int64), starts(counts), np.array(numbers, np.float32).reshape(-1, NUMBERS), len(blocks))


Weights = dict[str, np.ndarray]


def fresh(rng: np.random.Generator) -> Weights:
    d = PATH_DIMS + WORD_DIMS + NUMBERS
    own: Weights = {"path": rng.normal(0, 0.3, (PATH_BINS, PATH_DIMS)), "word": rng.normal(0, 0.05, (WORD_BINS, WORD_DIMS)), "out": rng.normal(0, 0.2, (2 * HIDDEN,)), "bias": np.zeros(1)}
    for side in "fb":
        own[f"x{side}"] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * HIDDEN))
        own[f"h{side}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        own[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in own.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _inputs(w: Weights, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (pages, longest, dims), filled up with zeros, and the mask of real blocks."""
    longest = max(p.n for p in pages)
    x = np.zeros((len(pages), longest, PATH_DIMS + WORD_DIMS + NUMBERS), np.float32)
    mask = np.zeros((len(pages), longest), np.float32)
    for i, p in enumerate(pages):
        x[i, : p.n, :PATH_DIMS] = np.add.reduceat(w["path"][p.path], p.path_at)
        ends = np.append(p.words_at[1:], len(p.words))
        x[i, : p.n, PATH_DIMS:-NUMBERS] = np.add.reduceat(w["word"][p.words], p.words_at) / (ends - p.words_at)[:, None]
        x[i, : p.n, -NUMBERS:] = p.numbers
        mask[i, : p.n] = 1
    return x, mask


def _run(w: Weights, x: np.ndarray, mask: np.ndarray, side: str, tape: list | None) -> np.ndarray:
    """Hidden states of one direction; padding carries the state on unchanged."""
    n, longest, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((n, longest, HIDDEN), np.float32)
    pre = x @ w[f"x{side}"] + w[f"c{side}"]
    for t in range(longest) if side == "f" else range(longest - 1, -1, -1):
        z = pre[:, t] + h @ w[f"h{side}"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, t, None]
        new = f * c + i * g
        th = np.tanh(new)
        if tape is not None:
            tape.append((t, h, c, i, f, o, g, th, m))
        c = m * new + (1 - m) * c
        h = m * (o * th) + (1 - m) * h
        out[:, t] = h
    return out


def scores(w: Weights, pages: list[Page]) -> list[np.ndarray]:
    """The probability of main text for each block of each page."""
    x, mask = _inputs(w, pages)
    both = np.concatenate([_run(w, x, mask, "f", None), _run(w, x, mask, "b", None)], axis=2)
    p = _sigmoid(both @ w["out"] + w["bias"])
    return [p[i, : page.n] for i, page in enumerate(pages)]


def _gradients(w: Weights, pages: list[Page], labels: list[np.ndarray]) -> tuple[float, Weights]:
    x, mask = _inputs(w, pages)
    y = np.zeros_like(mask)
    for i, l in enumerate(labels):
        y[i, : len(l)] = l
    tapes: dict[str, list] = {"f": [], "b": []}
    both = np.concatenate([_run(w, x, mask, s, tapes[s]) for s in "fb"], axis=2)
    p = _sigmoid(both @ w["out"] + w["bias"])
    loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / mask.sum())
    dp = (p - y) * mask / mask.sum()
    g: Weights = {"out": np.einsum("bt,bth->h", dp, both), "bias": np.array([dp.sum()])}
    d_both = dp[:, :, None] * w["out"]
    dx = np.zeros_like(x)
    for at, s in enumerate("fb"):
        dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
        g[f"h{s}"] = np.zeros_like(w[f"h{s}"])
        dh, dc = np.zeros((len(pages), HIDDEN), np.float32), np.zeros((len(pages), HIDDEN), np.float32)
        for t, h, c, i, f, o, gg, th, m in reversed(tapes[s]):
            dh = dh + d_both[:, t, at * HIDDEN : (at + 1) * HIDDEN]
            here, past = dh * m, dh * (1 - m)
            dn = dc * m + here * o * (1 - th * th)
            dz = np.concatenate([dn * gg * i * (1 - i), dn * c * f * (1 - f), here * th * o * (1 - o), dn * i * (1 - gg * gg)], axis=1)
            dz_all[:, t] = dz
            g[f"h{s}"] += h.T @ dz
            dh, dc = dz @ w[f"h{s}"].T + past, dn * f + dc * (1 - m)
        g[f"x{s}"] = np.einsum("btd,btk->dk", x, dz_all)
        g[f"c{s}"] = dz_all.sum(axis=(0, 1))
        dx += dz_all @ w[f"x{s}"].T
    g["path"], g["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
    for i, page in enumerate(pages):
        sizes = np.diff(np.append(page.path_at, len(page.path)))
        np.add.at(g["path"], page.path, np.repeat(dx[i, : page.n, :PATH_DIMS], sizes, axis=0))
        counts = np.diff(np.append(page.words_at, len(page.words)))
        np.add.at(g["word"], page.words, np.repeat(dx[i, : page.n, PATH_DIMS:-NUMBERS] / counts[:, None], counts, axis=0))
    return loss, g


def train(examples: list[tuple[Page, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Adam over batches of pages of like length."""
    rng = np.random.default_rng(seed)
    w = fresh(rng)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    order = sorted(range(len(examples)), key=lambda i: examples[i][0].n)
    batches = [order[i : i + 32] for i in range(0, len(order), 32)]
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            _, g = _gradients(w, [examples[i][0] for i in batches[b]], [examples[i][1] for i in batches[b]])
            step += 1
            rate = 0.01 * (0.5 if epoch > epochs * 0.6 else 1)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


# Labelled pages ------------------------------------------------------------

_MAIN = {*MAIN_TAGS, *(f"{a}:{n}" for n in MAIN_NAMES for a in "ci")}
_OTHER = {*OTHER_TAGS, *(f"{a}:{n}" for names in OTHER_NAMES.values() for n in names for a in "ci")}


def label(html: str) -> np.ndarray | None:
    """Labels of a table's page by its containers; None if it has none for main text."""
    y = np.array([bool(_MAIN & set(names)) and not _OTHER & set(names) for _, names, _ in Blocks(hashed=False).split(html)], np.float32)
    return y if y.any() else None


def compose(rng: random.Random, vocabulary: list[str]) -> tuple[str, list[bool]]:
    """A page made up of containers and texts, and whether each of its blocks is main text."""
    labels: list[bool] = []

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(a, b)))

    def wrap(kind: str, inner: str) -> str:
        tag = kind if kind in OTHER_TAGS else rng.choice(("div", "section", "div"))
        if tag == kind and rng.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        names = " ".join(rng.sample(OTHER_NAMES[kind], rng.choice((1, 1, 2))))
        if tag == kind or rng.random() < 0.75:
            return f'<{tag} {rng.choice(("class", "class", "id"))}="{names}">{inner}</{tag}>'
        return f'<div class="{names}">{inner}</div>'

    def other(kind: str) -> str:
        n = rng.randint(1, 7)
        made = []
        for _ in range(n):
            labels.append(False)
            text = words(1, 4) if kind in ("nav", "header", "form") or rng.random() < 0.5 else words(4, 40)
            form = rng.choice(("<li><a href='/x'>{}</a></li>", "<div><a href='/x'>{}</a></div>")) if kind == "nav" else rng.choice(("<p>{}</p>", "<div>{}</div>", "<li>{}</li>", "<h3>{}</h3>", "<p><a href='#'>{}</a></p>")) if kind != "form" else rng.choice(("<p>{}<input name=q></p>", "<div><label>{}</label></div>", "<button>{}</button>"))
            made.append(form.format(text))
        inner = "".join(made)
        if made[0].startswith("<li"):
            inner = f"<ul>{inner}</ul>"
        if n == 1 and rng.random() < 0.5:
            inner = text
        return wrap(kind, inner)

    def main() -> str:
        made = []
        if rng.random() < 0.8:
            labels.append(True)
            made.append(f"<h1>{words(3, 12)}</h1>")
        for _ in range(rng.randint(1, 16)):
            if rng.random() < 0.05:
                made.append(other(rng.choice(("ad", "aside", "notice", "form"))))
                continue
            labels.append(True)
            text = words(1, 5) if rng.random() < 0.25 else words(5, 90)
            made.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<p>{}</p>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<p><a href='/l'>{}</a></p>")).format(text))
        inner = "".join(made)
        shape = rng.random()
        if shape < 0.55:
            inner = f"<article>{inner}</article>"
        elif shape < 0.65:
            inner = f"<main>{inner}</main>"
        elif shape < 0.93:
            inner = f'<div {rng.choice(("class", "id"))}="{rng.choice(MAIN_NAMES)}">{inner}</div>'
        return f'<main id="{rng.choice(MAIN_NAMES)}">{inner}</main>' if rng.random() < 0.15 else inner

    parts = [other(k) for k in ("header", "nav", "notice", "ad", "nav") if rng.random() < 0.5]
    parts.append(main())
    parts += [other(k) for k in ("comments", "aside", "form", "ad", "notice", "footer") if rng.random() < 0.5]
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body>{''.join(parts)}</body></html>", labels


def composed(n: int, seed: int, vocabulary: list[str]) -> list[tuple[Page, np.ndarray]]:
    rng, split, features, out = random.Random(seed), Blocks(), Featurizer(), []
    while len(out) < n:
        html, labels = compose(rng, vocabulary)
        blocks = split.split(html)
        assert len(blocks) == len(labels), (html, len(blocks), len(labels))
        out.append((features.page(blocks), np.array(labels, np.float32)))
    return out


def fit(htmls: list[str | None]) -> Weights:
    """Train on at most TRAIN_PAGES of the given pages and on composed pages with their words."""
    split, features, examples, vocabulary = Blocks(), Featurizer(), [], set()
    for html in htmls[:TRAIN_PAGES]:
        blocks = split.split(html or "")
        vocabulary.update(w for text, _, _ in blocks[:40] for w in text.split(" ")[:40])
        if 0 < len(blocks) <= TRAIN_BLOCKS and (y := label(html)) is not None:
            examples.append((features.page(blocks), y))
    return train(examples + composed(COMPOSED_PAGES, SEED, sorted(vocabulary) or ["word"]))


def training_sample(pages: DataFrame, html: str = "html") -> list[str | None]:
    """At most TRAIN_PAGES pages, by a hash of their url and id: any table gives the same ones again."""
    key = F.xxhash64(*[c for c in ("page_id", "url") if c in pages.columns])
    ids = [r[0] for r in pages.select(key.alias("k")).orderBy("k").limit(TRAIN_PAGES).collect()]
    return [r[0] for r in pages.where(key.isin(ids)).orderBy(key, F.xxhash64(html)).select(html).limit(TRAIN_PAGES).collect()] if ids else []


def extract(pages: DataFrame, weights: Weights, html: str = "html") -> DataFrame:
    """pages without html, with text (the blocks labelled main, one a line) and n_chars."""
    keep = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, features = Blocks(), Featurizer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                small = batch.slice(at, 1024)
                blocks = [split.split(x.as_py() or "") for x in small.column(len(keep))]
                texts = [""] * len(blocks)
                order = sorted((i for i in range(len(blocks)) if blocks[i]), key=lambda i: len(blocks[i]))
                for a in range(0, len(order), BATCH):
                    part = order[a : a + BATCH]
                    for i, p in zip(part, scores(weights, [features.page(blocks[i]) for i in part]), strict=True):
                        texts[i] = "\n".join(b[0] for b, score in zip(blocks[i], p.tolist(), strict=True) if score > 0.5)
                columns = [small.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*(f.name for f in keep), "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string, n_chars long"])
    return pages.select(*(F.col(f"`{f.name}`") for f in keep), F.col(html)).mapInArrow(run, schema)


def op3_block_labeller(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(training_sample(pages))).select("page_id", "url", "text", "n_chars")
