"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, in page order. Each
block is a leaf with a vector of its tag path (tag names and the words of id, class and
role on the way down, hashed, with those nearest the leaf apart) and one of its hashed
words and shape. A bidirectional LSTM in numpy reads the page's blocks from both ends, so
every block is labelled with the whole page as context, and the blocks labelled as
article text are joined.

The pages carry no labels, so the network learns from rules: on a bounded sample of
pages, blocks under an article or main element and outside menus, headers, footers,
sidebars, forms, notices, adverts and comments are article text. On half of the training
copies the tag names or the attribute words are hidden, so that it also learns from what
is left: words, shape and neighbours.

Defined cases: null or empty html has no text; a page without any block has no text;
repeated rows are extracted each; an empty table gives an empty result; malformed markup
never ends the job: a marked section is a comment up to the next ``>``, unclosed elements
end with the page; pages of any length are labelled whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH = 96                     # width of the hashed tag-path vector
WORDS = 64                    # width of the hashed word vector
SHAPE = 6
WIDTH = PATH + WORDS + SHAPE
HIDDEN = 16

# Fixed values of HTML: elements that end a block, that hold no text, and that have no end tag.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol
option p pre search section select summary table tbody td textarea tfoot th thead title tr ul""".split())
SILENT = frozenset("script style template head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("body html head title caption tbody td tfoot th thead tr li dd dt option".split())
# Words of tag names and attributes that mark what is not the article (fixed for the rules).
ASIDE = frozenset("""nav menu header footer aside sidebar form button select textarea ad ads advert advertisement
banner promo sponsor sponsored cookie cookies consent notice popup modal newsletter subscribe comment comments
disqus reply replies breadcrumb breadcrumbs pagination pager related share social widget toolbar search login
navigation contentinfo complementary alert dialog""".split())
MAIN = frozenset("article main".split())
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[tuple[str, ...], ...]   # per element: its name, then the words of its attributes
    text: str


class _Leaves(HTMLParser):
    """Blocks of a page in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, ...]] = []
        self.parts: list[str] = []
        self.blocks: list[Block] = []
        self.silent = 0

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            path = tuple(e for e in self.stack if e[0] in BLOCKS or len(e) > 1)
            self.blocks.append(Block(path, text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.cut()
        if tag in VOID:
            return
        if tag in BLOCKS and tag not in ("html", "head", "title"):
            self._close_open("head", frozenset())    # an end tag left out
        if tag in CLOSES_P:
            self._close_open("p", BLOCKS - {"p"})
        elif tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            self._close_open(tag, frozenset(("ul", "ol", "menu", "dl", "select", "table")))
        words = [w for k, v in attrs if k in ("id", "class", "role", "itemprop") for w in _WORD.findall((v or "").lower())]
        self.stack.append((tag, *words))
        self.silent += tag in SILENT

    def _close_open(self, tag: str, until: frozenset[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return
            if self.stack[k][0] in until:
                return

    def _pop(self, k: int) -> None:
        self.silent -= sum(e[0] in SILENT for e in self.stack[k:])
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return

    def parse_html_declaration(self, i: int) -> int:
        # A marked section is no HTML; the library's own reading of it can fail.
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def blocks_of(html: str) -> list[Block]:
    page = _Leaves()
    page.feed(html)
    page.close()
    page.cut()
    return page.blocks


def _slot(word: str, width: int) -> int:
    return zlib.crc32(word.encode()) % width


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block: hashed path, hashed words, shape."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    third = PATH // 3
    seen: dict[tuple, np.ndarray] = {}
    for row, block in zip(x, blocks):
        path = seen.get(block.path)
        if path is None:
            path = seen[block.path] = np.zeros(PATH, np.float32)
            for depth, (tag, *words) in enumerate(reversed(block.path)):
                path[_slot("t" + tag, third) + (0 if depth else third)] = 1
                for word in words:
                    path[2 * third + _slot("w" + word, third)] = 1
        row[:PATH] = path
        text = block.text
        raw = text.lower().encode()
        words = raw.split(b" ")
        row[PATH:PATH + WORDS] = np.bincount([zlib.crc32(w) % WORDS for w in words], minlength=WORDS)
        row[PATH:PATH + WORDS] /= np.sqrt(len(words))
        row[PATH + WORDS:] = (np.log1p(len(words)) / 5, np.log1p(len(text)) / 7, text[-1] in ".!?…\"'",
                              1 - len(raw.translate(None, b"0123456789")) / len(raw), "©" in text,
                              text[:1].isupper())
    return x


def by_rule(blocks: list[Block]) -> np.ndarray:
    """1 for article text. A page without an article or main element is judged by what it lacks."""
    words = [[w for e in b.path for w in e] for b in blocks]
    inner = [any(w in MAIN for w in ws) for ws in words]
    some = any(inner)
    return np.array([(i or not some) and not any(w in ASIDE for w in ws) for i, ws in zip(inner, words)], np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output over the blocks of many pages at once."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * h))
            self.p[f"h{way}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p[f"c{way}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * h + WIDTH), 2 * h + WIDTH)
        self.p["z"] = np.zeros(1)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, pages, HIDDEN) of one direction; padding leaves the state alone."""
        h, c = np.zeros((x.shape[1], HIDDEN), x.dtype), np.zeros((x.shape[1], HIDDEN), x.dtype)
        out = np.zeros((*x.shape[:2], HIDDEN), x.dtype)
        own = {k: self.p[f"{k}{way}"].astype(x.dtype) for k in "xhc"}
        drive = x.reshape(-1, WIDTH) @ own["x"] + own["c"]
        drive = drive.reshape(*x.shape[:2], -1)
        times = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        for t in times:
            gates = drive[t] + h @ own["h"]
            ifo = _sigmoid(gates[:, :3 * HIDDEN])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN:2 * HIDDEN], ifo[:, 2 * HIDDEN:]
            g = np.tanh(gates[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh_c, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * tanh_c) + (1 - m) * h
            out[t] = h
        return out

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        o = self.p["o"].astype(x.dtype)
        z = self._run("f", x, mask) @ o[:HIDDEN] + self._run("b", x, mask) @ o[HIDDEN:2 * HIDDEN]
        return _sigmoid(z + x @ o[2 * HIDDEN:] + self.p["z"].astype(x.dtype))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict[str, list] = {"f": [], "b": []}
        states = [self._run(way, x, mask, kept[way]) for way in "fb"]
        joint = np.concatenate([*states, x], 2)
        p = _sigmoid(joint @ self.p["o"] + self.p["z"])
        n = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        miss = mask * (p - y) / n
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"] = np.einsum("tb,tbk->k", miss, joint)
        grad["z"] = np.array([miss.sum()])
        for k, way in enumerate("fb"):
            to_h = miss[:, :, None] * self.p["o"][k * HIDDEN:(k + 1) * HIDDEN]
            dh, dc = np.zeros_like(to_h[0]), np.zeros_like(to_h[0])
            for t, h0, c0, i, f, o, g, tanh_c, m in reversed(kept[way]):
                dh = dh + to_h[t]
                dnew = m * dh
                dcell = m * dc + dnew * o * (1 - tanh_c ** 2)
                gates = np.concatenate([dcell * g * i * (1 - i), dcell * c0 * f * (1 - f),
                                        dnew * tanh_c * o * (1 - o), dcell * i * (1 - g ** 2)], 1)
                grad[f"x{way}"] += x[t].T @ gates
                grad[f"h{way}"] += h0.T @ gates
                grad[f"c{way}"] += gates.sum(0)
                dh = (1 - m) * dh + gates @ self.p[f"h{way}"].T
                dc = (1 - m) * dc + dcell * f
        return loss, grad


def _padded(pages: list[np.ndarray], kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), *pages[0].shape[1:]), kind)
    mask = np.zeros((longest, len(pages)), kind)
    for k, page in enumerate(pages):
        x[:len(page), k], mask[:len(page), k] = page, 1
    return x, mask


def fit(pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 12, batch: int = 32, rate: float = 0.02,
        seed: int = 7) -> Labeller:
    """Adam over batches of pages of like length."""
    rng, net = np.random.default_rng(seed), Labeller()
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    order, step = sorted(range(len(pages)), key=lambda k: len(pages[k])), 0
    third = PATH // 3
    for _ in range(rounds):
        for at in rng.permutation(range(0, len(order), batch)):
            own = order[at:at + batch]
            x, mask = _padded([pages[k] for k in own])
            y, _ = _padded([labels[k] for k in own])
            hide = rng.random(len(own))
            x[:, hide < 0.25, 2 * third:PATH] = 0
            x[:, hide > 0.85, :2 * third] = 0
            _, grad = net.gradients(x, mask, y)
            step += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return net


def train(pages: DataFrame, sample: int = 600, longest: int = 400, chars: int = 200_000) -> Labeller:
    """The labeller fitted on at most ``sample`` pages, those whose page_id and url hash
    lowest, each by its first ``chars`` characters, in pieces of ``longest`` blocks. So the
    driver reads at most ``sample * chars`` characters, and long pages are learnt from too."""
    place = F.xxhash64("page_id", "url")
    # The places alone are ordered and cut; the pages of the chosen ones are fetched after.
    last = pages.where("html <> ''").select(place.alias("at")).distinct().orderBy("at").limit(sample) \
        .agg(F.max("at").alias("at")).first()["at"]
    few = [] if last is None else pages.where("html <> ''").where(place <= last) \
        .select(place.alias("at"), F.substring(F.col("html").cast("string"), 1, chars).alias("html")) \
        .groupBy("at").agg(F.min("html").alias("html")).orderBy("at").collect()
    x, y = [], []
    for r in few:
        blocks = blocks_of(r["html"])
        label = by_rule(blocks)
        for k in range(0, len(blocks), longest):
            x.append(features(blocks[k:k + longest]))
            y.append(label[k:k + longest])
    return fit(x, y) if x else Labeller()


def _texts(net: Labeller, pages: list[list[Block]], cells: int = 24_000) -> list[str]:
    """Pages in groups of like length, so that padding stays small; a longer page alone."""
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    group: list[int] = []

    def flush() -> None:
        if group:
            x, mask = _padded([features(pages[k]) for k in group], np.float32)
            chance = net.chances(x, mask)
            for j, k in enumerate(group):
                out[k] = "\n".join(b.text for b, c in zip(pages[k], chance[:, j]) if c >= 0.5)
            group.clear()

    for k in order:
        if group and (len(group) + 1) * len(pages[k]) > cells:
            flush()
        group.append(k)
    flush()
    return out


def main_text(pages: DataFrame, net: Labeller, rows: int = 1_000) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), rows):
                part = f[k:k + rows]
                text = _texts(net, [blocks_of(h) if h else [] for h in part["html"]])
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text,
                                    "n_chars": [len(t) for t in text]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")) \
        .mapInPandas(run, "page_id long, url string, text string, n_chars long")
