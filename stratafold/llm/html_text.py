"""HTML extraction: a bidirectional LSTM labels every block of a page as main text or not, in the page's whole context.

A page is cut into leaf blocks: text between block-level tags, with its path of open tags. Scripts, styles, titles,
comments and markup never become text. A block's vector holds hashed tags and class or id words of its path, hashed words
of its text, and a few shares. The LSTM, written in numpy, reads the sequence in both directions; a logistic unit on both
states decides for every block. Kept blocks are joined in page order.

The model is trained here, on GENERATED pages whose layouts (menus, side bars, notices, adverts, forms, comments) are drawn
at random, so that every block's label is known from the layout and is kept beside the page, not in it. A part of the
containers has common role names, a part made-up ones, a part none, so that a name alone doesn't decide. Their sentences
come from a bounded sample: SAMPLE pages, the first by a hash of page_id, with at most SENTENCES sentences of at most
SENTENCE_CHARS characters each; that bounds what the driver gets. Nothing of real pages is a label.

Defined cases: an empty table gives no rows; null or empty html has an empty text; a page without main blocks has an empty
text; unclosed and stray tags are read as browsers do in the plain cases; a quote that is never closed ends with its tag; a tag
that is never closed is no text; elements nested deeper than MAX_DEPTH count as siblings, as in browsers; attributes of any name
and value are ignored but for class, id and role; rows with equal page_id are read each; without sentences the generated
pages have made-up ones; other columns are ignored. Time is linear in the html, and memory beyond it is bounded: a page of
more than BATCH_BLOCKS blocks is scored in steps that hand on the states of the network.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .linear import sigmoid
from .staging import documents

#: Pages whose sentences the generated pages are made of, at most; sentences of a page and characters of a sentence.
SAMPLE, SENTENCES, SENTENCE_CHARS = 300, 40, 400
GENERATED = 1000
HIDDEN, PATH_SIZE, WORD_SIZE, SHARES = 24, 96, 48, 6
SIZE = PATH_SIZE + WORD_SIZE + SHARES
EPOCHS, RATE = 14, 0.01
#: Blocks of pages that are scored at once, with padding.
BATCH_BLOCKS = 20_000
#: Open elements at most, and the innermost of them that a block's path names.
MAX_DEPTH, PATH_DEPTH = 512, 32
THRESHOLD = 0.5

# Element names of HTML, and role words of class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template title textarea iframe svg math object canvas select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul button label".split())
CLOSES_P = BLOCK - {"button", "label", "option"}
OTHER_WORDS = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "alert", "sidebar", "side", "widget", "related", "recommended", "share", "social", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "comment", "comments", "reply", "replies", "respond", "newsletter", "subscribe", "signup", "login", "search", "modal", "popup", "footer", "header", "masthead", "copyright", "pagination", "tags", "author-box"]
MAIN_WORDS = ["content", "post", "entry", "article", "story", "text", "body", "main", "page", "article-body", "post-content", "entry-content", "prose"]

# what the layouts' notices say
SAID = ["We use cookies to improve this site", "Accept all", "Subscribe to our newsletter", "Leave a reply", "All rights reserved", "Share this", "Read more", "Sign in", "Privacy policy", "Terms of use", "Advertisement", "Reply", "3 comments", "Related stories", "Follow us", "Back to top", "Contact", "Home", "Search"]

_attribute = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?)""")
_tag_name = re.compile(r"[a-zA-Z][^\s/>]*+")
_name_part = re.compile(r"[^a-z0-9]+")
_closers = {tag: re.compile(rf"</{tag}(?![^\s/>])[^>]*+(?:>|\Z)", re.I) for tag in SKIPPED}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    #: Where its text begins in the page.
    start: int = 0


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...]


def _tag(page: str, at: int) -> tuple[int, str, dict[str, str], bool] | None:
    """End, name, attributes and self-closing mark of the tag whose name begins at `at`; None if it is never closed."""
    name = _tag_name.match(page, at)
    position, found = name.end(), {}
    while True:
        m = _attribute.match(page, position)
        if m is None:
            return None
        if m.group(1):
            return m.end(), name.group().lower(), found, page[m.end() - 2] == "/"
        position = m.end()
        key = m.group(2).lower()
        if key in ("class", "id", "role") and key not in found:
            found[key] = next((v for v in m.group(3, 4, 5) if v), "").lower()


def _names(tag: str, attributes: dict[str, str]) -> tuple[str, ...]:
    names = [tag]
    for value in attributes.values():
        for word in value.split():
            names.append(f".{word}")
            names += [f".{part}" for part in _name_part.split(word) if part and part != word]
    return tuple(names)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with references decoded and white space made one space."""
    out: list[Block] = []
    stack: list[_Open] = []
    held: Counter[str] = Counter()  # open elements by tag
    parts: list[str] = []
    links, path, start = 0, (), 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(path, text, min(links, len(text)), start))
            parts.clear()
            links = 0

    def add(low: int, high: int) -> None:
        nonlocal links, path, start
        text = page[low:high]
        if not parts:
            if text.isspace():
                return
            path, start = tuple(n for o in stack[-PATH_DEPTH:] for n in o.names), low
        parts.append(text)
        if held["a"]:
            links += high - low

    def close(i: int) -> None:
        """Closes the open elements from the i-th on."""
        for o in stack[i:]:
            held[o.tag] -= 1
        del stack[i:]

    position, end = 0, len(page)
    while position < end:
        at = page.find("<", position)
        if at < 0:
            add(position, end)
            break
        following = page[at + 1 : at + 3]
        closing = following[:1] == "/"
        letter = following[1:2] if closing else following[:1]
        is_tag = letter.isascii() and letter.isalpha()
        if not is_tag and not closing and following[:1] not in ("!", "?"):
            add(position, at + 1)  # a plain less-than sign
            position = at + 1
            continue
        if at > position:
            add(position, at)
        if not is_tag:
            stop = page.find("-->", at + 2) if page.startswith("<!--", at) else page.find(">", at)
            position = end if stop < 0 else page.index(">", stop) + 1
            continue
        found = _tag(page, at + 1 + closing)
        if found is None:
            break
        position, tag, attributes, empty = found
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if closing:
            if tag in BLOCK and (tag == "p" or held[tag]):
                flush()
            if held[tag]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in ("article", "body", "main", "section", "td") and tag not in BLOCK:
                        break
            continue
        if tag in SKIPPED:
            if not empty:
                stop = _closers[tag].search(page, position)
                position = stop.end() if stop else end
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p" or stack[i].tag == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if len(stack) >= MAX_DEPTH:
            close(MAX_DEPTH - 1)
        stack.append(_Open(tag, _names(tag, attributes) if attributes else (tag,)))
        held[tag] += 1
    flush()
    return out


def vectors(found: list[Block]) -> np.ndarray:
    """A row for each block of one or more pages; shares of the place in the page are set by `page_vectors`."""
    out = np.zeros((len(found), SIZE), np.float32)
    names = [n.encode() for b in found for n in b.path]
    if names:
        row = np.repeat(np.arange(len(found)), [len(b.path) for b in found])
        raw = np.frombuffer(b" ".join(names), np.uint8)
        start = np.concatenate([[0], np.cumsum([len(n) + 1 for n in names])])
        h = K.hashes(raw, start[:-1], start[1:] - 1)[0]
        np.add.at(out, (row, (h % np.uint64(PATH_SIZE)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    if found:
        texts = [b.text.encode() for b in found]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts, ends, first = K.spans(raw, offsets, K.SPACES)
        h = K.hashes(raw, starts, ends, K.FOLD)[0]
        n = np.diff(first)
        row = np.repeat(np.arange(len(found)), n)
        flat = np.bincount(row * WORD_SIZE + (h % np.uint64(WORD_SIZE)).astype(np.int64), weights=np.where(h >> np.uint64(63), 1.0, -1.0), minlength=len(found) * WORD_SIZE)
        out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = flat.reshape(len(found), WORD_SIZE) / np.sqrt(np.maximum(n, 1))[:, None]
        shares = out[:, PATH_SIZE + WORD_SIZE :]
        shares[:, 0] = np.log1p(n) / 4
        shares[:, 1] = [b.linked / max(len(b.text), 1) for b in found]
        shares[:, 2] = K.row_sums(np.isin(raw, np.frombuffer(b".,;:!?", np.uint8)), offsets) / np.maximum(n, 1)
        shares[:, 3] = [len(b.path) / 8 for b in found]
    return out


def page_vectors(page: list[Block], low: int = 0, high: int | None = None) -> np.ndarray:
    """Vectors of the blocks from `low` to `high` of a page."""
    out = vectors(page[low:high])
    if len(out):
        out[:, -2] = (low + np.arange(len(out))) / max(len(page) - 1, 1)
        out[:, -1] = 1 / len(page)
    return out


class Labeller:
    """A bidirectional LSTM with a logistic unit, and its training by back-propagation through time."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 1 / np.sqrt(SIZE), (SIZE, 4 * HIDDEN))
            self.p[f"h{d}"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
            self.p[f"o{d}"] = r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
        self.p["o"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False, state: list | None = None):
        """States of one direction; x is (pages, blocks, SIZE), already reversed for the backward one. `state` is gone on from and set."""
        n, t, _ = x.shape
        h, c = state or (np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)))
        inputs = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        out, held = np.zeros((n, t, HIDDEN)), []
        for k in range(t):
            z = inputs[:, k] + h @ self.p[f"h{d}"]
            gate = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            before_h, before_c = h, c
            c = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(c)
            h = m * (o * th) + (1 - m) * h
            out[:, k] = h
            if keep:
                held.append((i, f, o, g, th, before_h, before_c, m))
        if state is not None:
            state[:] = h, c
        return out, held

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forward, _ = self._run(x, mask, "f")
        backward, _ = self._run(x[:, ::-1], mask[:, ::-1], "b")
        return forward @ self.p["of"] + backward[:, ::-1] @ self.p["ob"] + self.p["o"][0]

    def _back(self, x: np.ndarray, held: list, out: np.ndarray, grad: np.ndarray, d: str, g: dict) -> None:
        n, t, _ = x.shape
        dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        dz_all = np.zeros((n, t, 4 * HIDDEN))
        g[f"o{d}"] = np.einsum("nt,nth->h", grad, out)
        g[f"h{d}"] = np.zeros_like(self.p[f"h{d}"])
        for k in range(t - 1, -1, -1):
            i, f, o, c_, th, before_h, before_c, m = held[k]
            dh = dh + grad[:, k, None] * self.p[f"o{d}"]
            do = dh * th * m
            dcell = dc + dh * o * (1 - th * th) * m
            dcell_m = dcell * m
            dz = np.concatenate([dcell_m * c_ * i * (1 - i), dcell_m * before_c * f * (1 - f), do * o * (1 - o), dcell_m * i * (1 - c_ * c_)], 1)
            dz_all[:, k] = dz
            g[f"h{d}"] += before_h.T @ dz
            dh = dz @ self.p[f"h{d}"].T + dh * (1 - m)
            dc = dcell_m * f + dcell * (1 - m)
        g[f"x{d}"] = np.einsum("nts,ntz->sz", x, dz_all)
        g[f"c{d}"] = dz_all.sum((0, 1))

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            # batches of like length, so that little is padded
            order = sorted(r.permutation(len(pages)), key=lambda i: len(pages[i]) // 8)
            batches = [order[lo : lo + 32] for lo in range(0, len(order), 32)]
            for part in (batches[b] for b in r.permutation(len(batches))):
                x, mask, y = padded([pages[i] for i in part], [labels[i] for i in part])
                forward, held_f = self._run(x, mask, "f", True)
                backward, held_b = self._run(x[:, ::-1], mask[:, ::-1], "b", True)
                z = forward @ self.p["of"] + backward[:, ::-1] @ self.p["ob"] + self.p["o"][0]
                grad = (sigmoid(z) - y) * mask / max(mask.sum(), 1)
                g = {"o": np.array([grad.sum()])}
                self._back(x, held_f, forward, grad, "f", g)
                self._back(x[:, ::-1], held_b, backward, grad[:, ::-1], "b", g)
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                step += 1
                for k, a in g.items():
                    a = a / max(norm, 1.0) + 1e-5 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def score(self, pages: list[list[Block]]) -> np.ndarray:
        """Logits of the blocks of pages of like length, padded. Steps of BATCH_BLOCKS / pages blocks hand on the states."""
        t = max(map(len, pages))
        step = max(1, BATCH_BLOCKS // len(pages))
        z = np.full((len(pages), t), self.p["o"][0])
        lows = range(0, t, step)
        for d, order in (("f", lows), ("b", reversed(lows))):
            state: list = []
            for low in order:
                if d == "f" or t > step:
                    x, mask, _ = padded([page_vectors(p, low, low + step) for p in pages], length=min(step, t - low))
                turn = slice(None, None, 1 if d == "f" else -1)
                states, _ = self._run(x[:, turn], mask[:, turn], d, state=state)
                z[:, low : low + step] += states[:, turn] @ self.p[f"o{d}"]
        return z

    def keep(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which blocks are main text. Pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]]) <= BATCH_BLOCKS:
                hi += 1
            z = self.score([pages[i] for i in order[lo:hi]])
            for row, i in enumerate(order[lo:hi]):
                out[i] = sigmoid(z[row, : len(pages[i])]) >= THRESHOLD
            lo = hi
        return out


def padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = length or max(len(p) for p in pages)
    x, mask, y = np.zeros((len(pages), t, SIZE)), np.zeros((len(pages), t)), np.zeros((len(pages), t))
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
        if labels is not None:
            y[i, : len(p)] = labels[i]
    return x, mask, y


def generated(sentences: list[str], number: int, seed: int = 7, named: float = 0.6) -> list[tuple[str, list[tuple[int, int]]]]:
    """Pages in random layouts, each with the places where its label changes: (offset, label of the text from there on).

    `named` is the share of containers whose names tell their role; half of the others have a made-up name.
    """
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(sentences) for _ in range(n))
    few = lambda: " ".join(say(1).split()[: r.randrange(1, 9)])
    notice = lambda: r.choice(SAID) if r.random() < 0.4 else few()
    made_up = lambda: "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(r.randrange(2, 5))) + r.choice(["", f"-{r.randrange(100)}", "__x"])
    pieces: list[tuple[str, int]] = []

    def put(markup: str, label: int, *texts: str) -> None:
        """Markup whose %s are texts."""
        pieces.append((markup % tuple(html.escape(t, quote=False) for t in texts), label))

    def box(tags: list[str], names: list[str]) -> tuple[str, str]:
        """A container's first tag and last tag."""
        kind = r.random()
        name = r.choice(names) + r.choice(["", "-box", "-list", " wide"]) if kind < named else made_up() if kind < (1 + named) / 2 else ""
        tag = r.choice(tags)
        return f'<{tag} {r.choice(["class", "id"])}="{name}">' if name else f"<{tag}>", f"</{tag}>"

    def other() -> None:
        """What isn't the article: links, notices, adverts, forms, or comments with their writers."""
        kind = r.randrange(7)
        telling = kind < 3
        first, last = box(["nav", "header", "footer", "aside", "form", "menu"] if telling else ["div", "section", "ul", "p", "div"], OTHER_WORDS)
        put(first, 0)
        what = r.randrange(6)
        if what == 0:
            for _ in range(r.randrange(2, 9)):
                put('<li><a href="/x">%s</a></li>', 0, notice())
        elif what == 1:
            for _ in range(r.randrange(1, 3)):
                put("<p>%s</p>" if telling or "=" in first else '<p><a href="/x">%s</a></p>', 0, say(1))
        elif what == 2:
            put("%s", 0, notice())
        elif what == 3:
            for _ in range(r.randrange(1, 5)):
                put("<div><b>%s</b><span>%s</span><p>%s</p><a href='#'>%s</a></div>", 0, few(), f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.20{r.randrange(10, 30)}", say(r.randrange(1, 4)), r.choice(["Reply", "Like", notice()]))
        elif what == 4:
            put("<h3>%s</h3>", 0, notice())
            for _ in range(r.randrange(1, 5)):
                put('<p><a href="/x">%s</a></p>', 0, few())
        else:
            put('<label>%s</label><input name="q"><button>%s</button>', 0, notice(), notice())
        put(last, 0)

    def main() -> None:
        first, last = box(["article", "main", "div", "section", "article"], MAIN_WORDS)
        put(first, 1)
        if r.random() < 0.8:
            put("<h1>%s</h1>", 1, few())
        for _ in range(r.randrange(1, 12) if r.random() < 0.8 else r.randrange(12, 60)):
            kind = r.random()
            if kind < 0.7:
                put(r.choice(["<p>%s</p>", "<p>%s", "<p>%s</p>", "<div>%s</div>", "<p><b>%s<br>"]), 1, say(r.randrange(1, 6)) if r.random() < 0.85 else few())
            elif kind < 0.78:
                put("<p>%s <a href='/y'>%s</a> %s</p>", 1, say(1), few(), say(1))
            elif kind < 0.84:
                put("<h2>%s</h2>", 1, few())
            elif kind < 0.9:
                put("<ul>", 1)
                for _ in range(r.randrange(2, 5)):
                    put("<li>%s</li>", 1, few() if r.random() < 0.5 else say(1))
                put("</ul>", 1)
            elif kind < 0.95:
                put("<blockquote>%s</blockquote>", 1, say(1))
            else:
                other()
        put(last, 1)

    out = []
    for _ in range(number):
        pieces = []
        put("<html><head><title>%s</title></head><body>", 0, few())
        for _ in range(r.randrange(5)):
            other()
        main()
        for _ in range(r.randrange(6)):
            other()
        put("</body></html>", 0)
        at, marks = 0, []
        for text, label in pieces:
            marks.append((at, label))
            at += len(text)
        out.append(("".join(text for text, _ in pieces), marks))
    return out


def labelled(page: str, marks: list[tuple[int, int]]) -> tuple[list[Block], np.ndarray]:
    """The blocks of a generated page and their labels."""
    found = blocks(page)
    at = [m[0] for m in marks]
    return found, np.array([marks[bisect_right(at, b.start) - 1][1] for b in found], float)


def _sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SENTENCES sentences of each page, the first by their hashes, cut to SENTENCE_CHARS: what the driver is sent."""
    for batch in batches:
        for page_id, page in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
            every = {s[:SENTENCE_CHARS] for b in blocks(page or "") for s in re.split(r"(?<=[.!?]) ", b.text)}
            chosen = sorted(every, key=lambda s: (zlib.crc32(s.encode()), s))[:SENTENCES]
            yield pa.RecordBatch.from_arrays([pa.array([page_id] * len(chosen), pa.int64()), pa.array(chosen, pa.string())], ["page_id", "sentence"])


def train(pages: DataFrame, number: int = SAMPLE) -> Labeller:
    """A labeller trained on GENERATED pages of the sentences of `number` pages."""
    # the ids first: a top-k over whole pages would send `number` pages from every task
    first = pages.filter("html is not null").select(F.col("page_id").cast("long").alias("page_id")).distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(number)
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").filter("html is not null").join(F.broadcast(first), "page_id")
    # rows with one page_id share its number of sentences
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("sentence"))
    rows = chosen.mapInArrow(_sentence_rows, "page_id long, sentence string").distinct().withColumn("n", rank).filter(F.col("n") <= SENTENCES)
    sentences = sorted({r["sentence"] for r in rows.select("sentence").collect()}) or SAID
    made = [labelled(*g) for g in generated(sentences, GENERATED)]
    made = [(b, y) for b, y in made if b]
    model = Labeller()
    model.fit([page_vectors(b) for b, _ in made], [y for _, y in made])
    return model


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, source = 0, batch.column("html").to_pylist()
            while lo < len(source):
                hi, size = lo, 0
                while hi < len(source) and (hi == lo or size + len(source[hi] or "") <= 4 << 20):
                    size += len(source[hi] or "")
                    hi += 1
                found = [blocks(h or "") for h in source[lo:hi]]
                kept = shared.value.keep(found)
                texts = ["\n".join(b.text for b, k in zip(p, ok, strict=True) if k) for p, ok in zip(found, kept, strict=True)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                lo = hi

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages")
    return extract(pages, train(pages))
