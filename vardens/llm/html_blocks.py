"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags, inline tags ignored,
scripts, styles, head and other unread elements skipped).  Every block becomes a vector:
its tag path with class and id words, hashed; its words, hashed and averaged; and a few
figures (length, link share, place).  A bidirectional LSTM written in numpy reads the
page's whole block sequence in both directions, so a block is judged in the context of
the document, and a logistic unit labels it text or boilerplate.  Kept blocks are joined
in page order.

There are no labels for pages, so the model learns from a bounded sample of ``train_pages``
pages (smallest hash of the id): their blocks with labels read off the semantic tags, and
pages recomposed from their texts with containers, class names and clutter drawn at
random, so that it does not depend on one site's layout.

Inference is one Arrow pass over the pages; the weights (a few ten thousand floats) go
with the tasks.  Pages are batched by length and stepped together.

Defined cases: a null or empty page, or one without blocks, has empty text; unclosed or
stray tags are tolerated (a head without its end tag ends at the first tag or text that is
not a head's, another unread element without one at the next block); very long pages are read whole; a table without any text to
learn from keeps every block; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts

PATH_DIM, WORD_DIM, HIDDEN = 96, 48, 20
TRAIN_PAGES, TRAIN_PAGE_BYTES = 240, 100_000
EPOCHS, BATCH, RATE = 14, 24, 0.012
FIGURES = 8

BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select "
    "summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("head title script style noscript template svg iframe object canvas audio video".split())
#: Start tags that leave an open head open; any other ends it.
HEADED = frozenset("html head title base basefont bgsound link meta script style noscript template".split())
HIDING = re.compile(r"<(?:title|noscript|template|svg|iframe|object|canvas|audio|video)\b", re.I)
#: Start tags that end an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*>""",
    re.S | re.I,
)
ENDS = frozenset(".!?…\"'”»")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*["']?([^"'>]+)""", re.I)
PARTS = re.compile(r"[a-z]+")

#: Names of containers that hold no article text, and of ones that do.
CLUTTER = (
    "nav menu navbar breadcrumb header masthead topbar footer copyright legal sidebar aside widget related recommended "
    "ad ads advert advertisement banner sponsor promo notice cookie consent alert popup modal newsletter subscribe signup "
    "login search form share social comments comment reply discussion respond tags pagination"
).split()
CONTENT = "article content post entry main story body text prose".split()
CLUTTER_TAGS = frozenset("nav header footer aside form button select label menu dialog fieldset".split())
CLUTTER_NAMES = frozenset(CLUTTER)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # innermost last: tags and the words of class, id and role
    links: int  # characters inside links
    truth: int  # 1 text, 0 boilerplate, -1 not marked (training pages only)


def _ended(page: str) -> set[int]:
    """Places of the unread elements that have an end tag of their own inside their parent."""
    found: set[int] = set()
    if not HIDING.search(page):
        return found
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    for m in TOKEN.finditer(page):
        name = (m[3] or "").lower()
        if not (name in BLOCKS or name in UNREAD) or name in VOID:
            continue
        if not m[2]:
            if not m[4].endswith("/"):
                stack.append((name, m.start()))
                opened[name] = opened.get(name, 0) + 1
        elif opened.get(name):
            last = None
            while last != name:
                last, at = stack.pop()
                opened[last] -= 1
            if name in UNREAD:
                found.add(at)
    return found


def parse(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int, bool]] = []  # the last: unread with an end tag of its own
    ended = _ended(page)
    parts: list[str] = []
    links = unread = in_link = 0

    def flush() -> None:
        nonlocal parts, links
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            path = tuple(w for _, words, _, _ in stack for w in words)
            blocks.append(Block(text, path, links, stack[-1][2] if stack else -1))
        parts, links = [], 0

    def close(upto: int) -> None:
        nonlocal unread, in_link
        while len(stack) > upto:
            name, _, _, _ = stack.pop()
            unread -= name in UNREAD
            in_link -= name == "a"

    def release(name: str) -> None:
        """Close the unread elements that a start tag ends: a head by all that is not its own,
        one without an end tag by the next block."""
        end = -1
        for k in range(len(stack) - 1, -1, -1):
            tag, _, _, whole = stack[k]
            if tag in UNREAD:
                if name in HEADED if tag == "head" else whole or name not in BLOCKS or name == "br":
                    break
                end = k
        if end >= 0:
            close(end)

    def heard(text: str) -> None:
        nonlocal links
        if unread and stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)
        if text and not unread:
            parts.append(text)
            if in_link:
                links += len(text)

    at = 0
    for m in TOKEN.finditer(page):
        heard(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if not (name in BLOCKS or name in UNREAD) and any(s[0] in BLOCKS for s in stack[k + 1 :]):
                        break  # a stray inline end tag closes no block
                    close(k)
                    break
            continue
        if unread:
            release(name)
        if name in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[name]:
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in VOID or m[4].endswith("/"):
            continue
        words = (name, *(w for found in NAMES.findall(m[4]) for w in PARTS.findall(found.lower())))
        inherited = stack[-1][2] if stack else -1
        truth = 1 if "data-main" in m[4] else 0 if "data-clutter" in m[4] else inherited
        stack.append((name, words, truth, m.start() in ended))
        unread += name in UNREAD
        in_link += name == "a"
    heard(page[at:])
    flush()
    return blocks


def weak_truth(block: Block) -> int:
    """Label read off semantic tags and names: clutter wins, content next, else unknown."""
    path = set(block.path)
    if path & CLUTTER_TAGS or path & CLUTTER_NAMES - {"header", "body", "text"}:
        return 0
    return 1 if path & {"article", "main"} else -1


class Slots(dict):
    """Word -> 2 * slot + sign bit, by a hash; emptied when it has grown large."""

    def __init__(self, size: int, kind: str):
        super().__init__()
        self.size, self.kind = size, kind

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = zlib.crc32((self.kind + word).encode("utf-8", "replace"))
        self[word] = code = h % self.size * 2 + (h >> 28 & 1)
        return code


_path_slots, _word_slots = Slots(PATH_DIM, "p"), Slots(WORD_DIM, "w")
_path_rows: dict[tuple[str, ...], np.ndarray] = {}


def _path_row(path: tuple[str, ...]) -> np.ndarray:
    row = _path_rows.get(path)
    if row is None:
        if len(_path_rows) > 50_000:
            _path_rows.clear()
        row = np.zeros(PATH_DIM, np.float32)
        for word in set(path):
            code = _path_slots[word]
            row[code >> 1] += 1 if code & 1 else -1
        _path_rows[path] = row
    return row


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page one row per block: hashed path, hashed words, figures."""
    blocks = [b for page in pages for b in page]
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + FIGURES), np.float32)
    counts = np.array([len(page) for page in pages], np.int64)
    ends = np.cumsum(counts)
    if not blocks:
        return np.split(out, ends[:-1])
    words = [b.text.lower().split() for b in blocks]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter((_word_slots[w] for ws in words for w in ws), np.int64, int(n_words.sum()))
    cell = np.repeat(np.arange(len(blocks)), n_words) * WORD_DIM + (codes >> 1)
    sums = np.bincount(cell, (codes & 1) * 2.0 - 1, len(blocks) * WORD_DIM).reshape(-1, WORD_DIM)
    out[:, :PATH_DIM] = [_path_row(b.path) for b in blocks]
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = sums / np.maximum(np.sqrt((sums * sums).sum(1)), 1)[:, None]
    size = np.array([len(b.text) for b in blocks])
    place = np.arange(len(blocks)) - np.repeat(ends - counts, counts)
    of = np.repeat(counts, counts)
    out[:, PATH_DIM + WORD_DIM :] = np.stack([
        np.log1p(n_words) / 4, np.log1p(size) / 6, np.array([b.links for b in blocks]) / size,
        np.array([b.text[-1] in ENDS for b in blocks]),
        np.array([sum(map(b.text.count, ".,;:")) for b in blocks]) / n_words,
        place / of, np.minimum(of, 50) / 50, size / n_words / 10,
    ], 1)
    return np.split(out, ends[:-1])


# ---------------------------------------------------------------- the recurrent labeller


@dataclass
class Model:
    weights: dict[str, np.ndarray]


def new_model(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    d, h = PATH_DIM + WORD_DIM + FIGURES, HIDDEN
    w = {}
    for side in "fb":
        w[f"x{side}"] = rng.normal(0, d**-0.5, (d, 4 * h))
        w[f"h{side}"] = rng.normal(0, h**-0.5, (h, 4 * h))
        w[f"c{side}"] = np.concatenate([np.ones(h), np.zeros(3 * h)])  # open forget gates
    w["out"], w["bias"] = rng.normal(0, 0.1, (2 * h + d, 1)), np.zeros(1)
    return Model({k: v.astype(np.float32) for k, v in w.items()})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, live: np.ndarray, wx, wh, c0, keep: bool):
    """LSTM over axis 1 of ``x`` (pages, blocks, features); state stands still after a page's end."""
    pages, steps, h = x.shape[0], x.shape[1], wh.shape[0]
    gates_in = x @ wx + c0
    out = np.zeros((pages, steps, h), np.float32)
    hs, cs = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
    saved = []
    for t in range(steps):
        z = gates_in[:, t] + hs @ wh
        gates = _sigmoid(z[:, : 3 * h])
        f, i, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        g = np.tanh(z[:, 3 * h :])
        m = live[:, t : t + 1]
        c = f * cs + i * g
        tc = np.tanh(c)
        if keep:
            saved.append((hs, cs, f, i, o, g, tc, m))
        hs, cs = m * (o * tc) + (1 - m) * hs, m * c + (1 - m) * cs
        out[:, t] = hs * m
    return out, saved


def _back(x: np.ndarray, d_out: np.ndarray, saved, wh):
    """Gradients of input weights, recurrent weights and biases of one direction."""
    h = wh.shape[0]
    dz_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
    dh, dc, d_wh = np.zeros((x.shape[0], h), np.float32), np.zeros((x.shape[0], h), np.float32), np.zeros_like(wh)
    for t in range(x.shape[1] - 1, -1, -1):
        h_in, c_in, f, i, o, g, tc, m = saved[t]
        now = (d_out[:, t] + dh) * m
        d_c = now * o * (1 - tc * tc) + dc * m
        dz = np.concatenate(
            [d_c * c_in * f * (1 - f), d_c * g * i * (1 - i), now * tc * o * (1 - o), d_c * i * (1 - g * g)], 1
        )
        dz_all[:, t] = dz
        d_wh += h_in.T @ dz
        dh, dc = dh * (1 - m) + dz @ wh.T, dc * (1 - m) + d_c * f
    flat = dz_all.reshape(-1, 4 * h)
    return x.reshape(-1, x.shape[2]).T @ flat, d_wh, flat.sum(0)


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse order, padding left at the end."""
    t = np.arange(x.shape[1])[None, :]
    at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return np.take_along_axis(x, at[:, :, None], 1)


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), lengths.max(), pages[0].shape[1]), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
    return x, lengths, (np.arange(x.shape[1])[None, :] < lengths[:, None]).astype(np.float32)


def chances(model: Model, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Chance of being text for every block of every page, pages stepped together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    w = model.weights
    while order:
        size = max(1, min(len(order), 64, 200_000 // len(pages[order[-1]]) or 1))
        now, order = order[-size:], order[:-size]  # longest first; a group has like lengths
        x, lengths, live = _pad([pages[k] for k in now])
        ahead, _ = _run(x, live, w["xf"], w["hf"], w["cf"], False)
        back, _ = _run(_reverse(x, lengths), live, w["xb"], w["hb"], w["cb"], False)
        p = _sigmoid(np.concatenate([ahead, _reverse(back, lengths), x], 2) @ w["out"] + w["bias"])[:, :, 0]
        for row, k in enumerate(now):
            out[k] = p[row, : lengths[row]]
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on (vectors, labels) of pages; labels of -1 give no gradient."""
    model, rng = new_model(seed), np.random.default_rng(seed)
    w = model.weights
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    pages = [p for p in pages if len(p[0])]
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        for lo in range(0, len(order), BATCH):
            group = [pages[k] for k in order[lo : lo + BATCH]]
            x, lengths, live = _pad([g[0] for g in group])
            y = np.full(x.shape[:2], -1.0, np.float32)
            for k, g in enumerate(group):
                y[k, : len(g[1])] = g[1]
            ahead, saved_f = _run(x, live, w["xf"], w["hf"], w["cf"], True)
            xr = _reverse(x, lengths)
            back, saved_b = _run(xr, live, w["xb"], w["hb"], w["cb"], True)
            joined = np.concatenate([ahead, _reverse(back, lengths), x], 2)
            p = _sigmoid(joined @ w["out"] + w["bias"])[:, :, 0]
            d = np.where(y >= 0, p - y, np.float32(0))[:, :, None] / np.float32(max((y >= 0).sum(), 1))
            g = {"out": joined.reshape(-1, joined.shape[2]).T @ d.reshape(-1, 1) + 1e-5 * w["out"], "bias": d.sum((0, 1))}
            d_joined = d @ w["out"].T
            h = HIDDEN
            g["xf"], g["hf"], g["cf"] = _back(x, d_joined[:, :, :h], saved_f, w["hf"])
            g["xb"], g["hb"], g["cb"] = _back(xr, _reverse(d_joined[:, :, h : 2 * h], lengths), saved_b, w["hb"])
            step += 1
            norm = np.float32(max(1.0, sum(float((v * v).sum()) for v in g.values()) ** 0.5))
            rate = np.float32(RATE * (1 - epoch / epochs))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k] / norm
                s[k] = 0.999 * s[k] + 0.001 * (g[k] / norm) ** 2
                w[k] -= rate * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(s[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return model


# ------------------------------------------------------------------------ training pages


def recompose(rng: np.random.Generator, prose: list[str], clutter: list[str]) -> str:
    """A page of drawn texts in drawn containers, marked with what is article text."""

    def pick(pool):
        return pool[int(rng.integers(len(pool)))]

    def box(text: str, main: bool, names) -> str:
        tag = pick(["div", "section", "div", "p", "ul"]) if not main else pick(["div", "section", "article", "main", "div"])
        name = pick(names)
        if not main and name in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5:
            tag = name
        attr = pick([f' class="{name}"', f' id="{name}"', f' class="{pick(["site", "page", "x", "wrap"])}-{name}"', f' class="{name} clear"'])
        if tag in ("nav", "header", "footer", "aside", "form", "article", "main") and rng.random() < 0.5:
            attr = ""
        return f'<{tag}{attr} {"data-main" if main else "data-clutter"}>{text}</{tag}>'

    def lines(n: int, pool) -> str:
        tag = pick(["p", "p", "p", "div", "li"])
        return "".join(f"<{tag}>{html.escape(pick(pool))}</{tag}>" for _ in range(n))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{html.escape(pick(pick(prose).split()))}</a></li>' for _ in range(n)) + "</ul>"

    def mess() -> str:
        kind = rng.random()
        inner = links(int(rng.integers(1, 8))) if kind < 0.3 else lines(int(rng.integers(1, 4)), clutter if kind < 0.5 else prose)
        if kind > 0.8:
            inner = f"<label>{pick(prose)[:30]}</label><button>{pick(prose)[:12]}</button>"
        return box(inner, False, CLUTTER)

    heading = f"<h1>{html.escape(pick(prose)[:60])}</h1>" if rng.random() < 0.8 else ""
    runs = [lines(int(rng.integers(1, 6)), prose) for _ in range(int(rng.integers(1, 4)))]
    inner = heading
    for k, run in enumerate(runs):
        inner += run + (f"<h2>{html.escape(pick(prose)[:40])}</h2>" if rng.random() < 0.3 else "")
        inner += mess() if k + 1 < len(runs) and rng.random() < 0.5 else ""
    body = "".join(mess() for _ in range(int(rng.integers(0, 4)))) + box(inner, True, CONTENT)
    return f"<html><body>{body}{''.join(mess() for _ in range(int(rng.integers(0, 4))))}</body></html>"


def training_pages(pages: list[str], seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of the sample's own blocks and of recomposed pages."""
    rng = np.random.default_rng(seed)
    own, prose, clutter = [], [], []
    for page in pages:
        blocks = parse(page)
        y = np.array([weak_truth(b) for b in blocks], float)
        own.append((blocks, y))
        prose += [b.text for b, t in zip(blocks, y) if t == 1]
        clutter += [b.text for b, t in zip(blocks, y) if t == 0 and not b.links]
        if not (y >= 0).any():
            prose += [b.text for b in blocks]
    if not prose:
        return []
    made = [parse(recompose(rng, prose, clutter or prose)) for _ in range(2 * len(pages))]
    known = own + [(b, np.array([x.truth for x in b], float)) for b in made]
    return list(zip(vectors([b for b, _ in known]), [y for _, y in known]))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Model | None:
    """Train on the bounded sample; None when there is nothing to learn from."""
    sample = pages.filter(F.octet_length(html_col).between(1, TRAIN_PAGE_BYTES)).orderBy(
        F.xxhash64(id_col), id_col, html_col
    )
    known = training_pages([r[0] for r in sample.select(html_col).limit(train_pages).collect()])
    return train(known) if known else None


def extract(
    pages: DataFrame, model: Model | None, keep: list[str], html_col: str = "html", threshold: float = 0.5
) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` of every page."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema]

    def extracted(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        all_pages = texts(b.column(b.num_columns - 1))
        for lo in range(0, len(all_pages), 256):
            parsed = [parse(p) for p in all_pages[lo : lo + 256]]
            if model is None:
                out += ["\n".join(x.text for x in blocks) for blocks in parsed]
                continue
            judged = chances(model, vectors(parsed))
            out += ["\n".join(x.text for x, p in zip(blocks, ps) if p >= threshold) for blocks, ps in zip(parsed, judged)]
        sizes = pa.array([len(t) for t in out], pa.int64())
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string()), sizes], [*keep, "text", "n_chars"])

    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    return arrow_map(rows, extracted, ", ".join([*fields, "text string", "n_chars long"]))
