"""Main text of web pages by a recurrent block labeller.

A page is read as its sequence of leaf blocks (``html_blocks``). Each block becomes a vector: the pooled embeddings of its hashed
tag path (tags, and words of class, id and role), those of its hashed words, and five numbers (length, share of
links, of punctuation and of digits, and whether it is short). A bidirectional LSTM in numpy reads the whole sequence, so that every
block is classified with all blocks before and after it in view, however many there are. The blocks that are labelled as
main text are joined in page order by one space.

The labeller is trained here, on the driver, from a bounded sample of the table (``sample_pages`` pages of at most ``sample_chars``
characters, the first by a hash of their content). Pages with an ``article`` or ``main`` element label their own blocks: inside it or not.
The texts of these pages are also put into drawn layouts, whose regions are known: menus, headers, side columns, notices, adverts, forms, related
links, comments and footers under various names around and inside articles under various names or none. Training is seeded, so
the same table gives the same labels.

Null and empty pages, and pages without a block of main text, give an empty text. Pages are handled whole; a page of n blocks takes n steps
and memory in proportion to n. Every row has its result, so repeated rows, ties and null ids are kept as they are. New columns get
free names if ``keep`` holds ``text`` or ``n_chars``. An empty table gives an empty result; then nothing is trained.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.common import fresh, per_row
from spreadrank.llm.html_blocks import PATH_SLOTS, WORD_SLOTS, Block, blocks_of, path_slot, word_slots

PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 16, 8, 5, 16
# Blocks, with padding, that are labelled together.
STACK = 32_768
# Put before a text by the drawn layouts if it is main text; a private character that is taken off again.
MARK = ""


def numbers_of(block: Block) -> list[float]:
    text, n = block.text, len(block.text)
    digits = sum(c.isdigit() for c in text[:2000])
    marks = sum(c in ".,;:!?" for c in text[:2000])
    looked = min(n, 2000)
    return [np.log1p(n) / 6.0, block.link_chars / n, 4.0 * marks / (looked + 20), digits / (looked + 20), float(n < 40)]


class Encoded:
    """A page's blocks as indices: flat places of the path and of the words with their starts, and the numbers."""

    def __init__(self, blocks: list[Block], hides: random.Random | None = None):
        """``hides`` leaves the words out of most blocks and the numbers out of a third, so that training does not learn
        the sample by heart."""
        paths = [sorted(b.path) for b in blocks]
        words = [hides and hides.random() < 0.7 and [0] or word_slots(b.text) or [0] for b in blocks]
        self.n = len(blocks)
        self.path, self.path_n = np.array([p for row in paths for p in row], np.int64), np.array([len(p) for p in paths], np.int64)
        self.word, self.word_n = np.array([w for row in words for w in row], np.int64), np.array([len(w) for w in words], np.int64)
        numbers = [[0.0] * NUMBERS if hides and hides.random() < 0.33 else numbers_of(b) for b in blocks]
        self.numbers = np.array(numbers, np.float32).reshape(-1, NUMBERS)


def path_scale(sizes: np.ndarray) -> np.ndarray:
    """A path's elements keep more weight than in a mean, since the innermost few decide."""
    return (sizes**-0.5).astype(np.float32)[:, None]


def word_scale(sizes: np.ndarray) -> np.ndarray:
    """Words are averaged, together with some empty ones, so that a single word says little."""
    return (1.0 / (sizes + 6.0)).astype(np.float32)[:, None]


def pooled(table: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of the rows of ``table`` for each run of ``places``; no run is empty."""
    return np.add.reduceat(table[places], np.cumsum(sizes) - sizes, axis=0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """The embeddings, an LSTM for each direction, and a linear output of both states and the block's own vector."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + NUMBERS

        def drawn(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.weights = {
            # Names and words that training does not meet stay close to nothing.
            "path": drawn(PATH_SLOTS, PATH_DIM, scale=0.1),
            "word": drawn(WORD_SLOTS, WORD_DIM, scale=0.02),
            "out": drawn(2 * HIDDEN + size, scale=0.2),
            "out_bias": np.zeros(1, np.float32),
        }
        for way in ("fore", "back"):
            self.weights[f"{way}_in"] = drawn(size, 4 * HIDDEN, scale=size**-0.5)
            self.weights[f"{way}_own"] = drawn(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0  # forget gates start open
            self.weights[f"{way}_bias"] = bias

    def inputs(self, page: Encoded) -> np.ndarray:
        path = pooled(self.weights["path"], page.path, page.path_n) * path_scale(page.path_n)
        word = pooled(self.weights["word"], page.word, page.word_n) * word_scale(page.word_n)
        return np.concatenate((path, word, page.numbers), axis=1)

    def run(self, x: np.ndarray, way: str, keep: bool):
        """States after each step of ``x`` (steps, pages, size); with ``keep`` also what the gradient needs."""
        w_own, steps = self.weights[f"{way}_own"], x @ self.weights[f"{way}_in"] + self.weights[f"{way}_bias"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, trail = np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            z = steps[t] + h @ w_own
            gates, new = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, c = c, f * c + i * new
            tanh_c = np.tanh(c)
            if keep:
                trail.append((i, f, o, new, before, tanh_c, h))
            h = o * tanh_c
            states[t] = h
        return states, trail

    @staticmethod
    def turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each page's steps in reverse, the padding still at the end."""
        steps = np.arange(len(x))[:, None]
        at = np.where(steps < sizes, sizes - 1 - steps, steps)
        return np.take_along_axis(x, at[:, :, None], axis=0)

    def forward(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Logits (steps, pages), and the trail of both directions."""
        fore, fore_trail = self.run(x, "fore", keep)
        turned = self.turned(x, sizes)
        back, back_trail = self.run(turned, "back", keep)
        both = np.concatenate((fore, self.turned(back, sizes), x), axis=2)
        return both @ self.weights["out"] + self.weights["out_bias"], both, (fore_trail, back_trail, turned)

    def labels(self, pages: list[Encoded]) -> list[np.ndarray]:
        """For each page, which blocks are main text. Pages of like lengths are stacked."""
        made: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p.n), key=lambda i: -pages[i].n)
        while order:
            width = max(1, STACK // pages[order[0]].n)
            own, order = order[:width], order[width:]
            sizes = np.array([pages[i].n for i in own])
            x = np.zeros((sizes.max(), len(own), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
            for place, i in enumerate(own):
                x[: pages[i].n, place] = self.inputs(pages[i])
            logits = self.forward(x, sizes)[0]
            for place, i in enumerate(own):
                made[i] = logits[: pages[i].n, place] > 0
        return made

    def back(self, x: np.ndarray, grad: np.ndarray, way: str, trail: list, grads: dict) -> np.ndarray:
        """Gradients of the weights of a direction, added to ``grads``, and of ``x``, from those of its states."""
        w_own = self.weights[f"{way}_own"]
        dz_all = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, new, before, tanh_c, h = trail[t]
            dh = grad[t] + dh
            dc = dc + dh * o * (1 - tanh_c * tanh_c)
            dz = np.concatenate(
                (dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - new * new)), axis=1
            )
            dz_all[t] = dz
            grads[f"{way}_own"] += h.T @ dz
            dh, dc = dz @ w_own.T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"{way}_in"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[f"{way}_bias"] += flat.sum(axis=0)
        return dz_all @ self.weights[f"{way}_in"].T

    def gradients(self, pages: list[Encoded], labels: list[np.ndarray]) -> tuple[dict, float]:
        sizes = np.array([p.n for p in pages])
        x = np.zeros((sizes.max(), len(pages), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
        y, real = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
        for i, page in enumerate(pages):
            x[: page.n, i], y[: page.n, i], real[: page.n, i] = self.inputs(page), labels[i], 1.0
        logits, both, (fore_trail, back_trail, turned) = self.forward(x, sizes, keep=True)
        share = sigmoid(logits)
        loss = -(real * np.where(y > 0, np.log(share + 1e-7), np.log(1 - share + 1e-7))).sum() / real.sum()
        d = real * (share - y) / real.sum()
        grads = {name: np.zeros_like(w) for name, w in self.weights.items()}
        grads["out"], grads["out_bias"] = (both * d[:, :, None]).sum(axis=(0, 1)), d.sum(keepdims=True)[0]
        d_both = d[:, :, None] * self.weights["out"]
        ahead, behind = d_both[:, :, :HIDDEN], self.turned(d_both[:, :, HIDDEN : 2 * HIDDEN], sizes)
        dx = d_both[:, :, 2 * HIDDEN :] + self.back(x, ahead, "fore", fore_trail, grads)
        dx += self.turned(self.back(turned, behind, "back", back_trail, grads), sizes)
        for i, page in enumerate(pages):
            own = dx[: page.n, i]
            for name, places, n, part in (
                ("path", page.path, page.path_n, own[:, :PATH_DIM] * path_scale(page.path_n)),
                ("word", page.word, page.word_n, own[:, PATH_DIM : PATH_DIM + WORD_DIM] * word_scale(page.word_n)),
            ):
                np.add.at(grads[name], places, np.repeat(part, n, axis=0))
        return grads, float(loss)


def fit(pages: list[tuple[Encoded, np.ndarray]], rounds: int, batch: int = 40, rate: float = 0.03, seed: int = 0) -> Labeller:
    """A labeller fitted to pages and the labels of their blocks with Adam, the rate falling to zero. Its weights are the
    mean of those of the second half of the steps."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(w) for k, w in model.weights.items()}
    second = {k: np.zeros_like(w) for k, w in model.weights.items()}
    pages = sorted((p for p in pages if p[0].n), key=lambda p: p[0].n)
    starts = np.arange(0, len(pages), batch)
    steps, total = 0, rounds * len(starts)
    mean, taken = {k: np.zeros_like(w) for k, w in model.weights.items()}, 0
    for _ in range(rounds):
        for at in rng.permutation(starts):
            own = pages[at : at + batch]
            grads, _ = model.gradients([p for p, _ in own], [y for _, y in own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now, steps = rate * (1 - steps / total), steps + 1
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                scale = (1 - 0.99**steps) ** 0.5 / (1 - 0.9**steps)
                model.weights[name] -= now * scale * first[name] / (np.sqrt(second[name]) + 1e-8)
            if 2 * steps > total:
                taken += 1
                for name, w in model.weights.items():
                    mean[name] += (w - mean[name]) / taken
    if taken:
        model.weights = mean
    return model


# Training pages

# Names of regions in drawn layouts: tag, and attributes of which one is drawn.
MAIN = [
    ("article", ["", "", 'class="post"', 'class="entry"', 'class="story"', 'itemprop="articleBody"']),
    ("main", ["", "", 'id="main"', 'role="main"']),
    ("div", ['class="content"', 'id="content"', 'class="post-content"', 'class="entry-content"', 'class="article-body"', 'class="main-text"', 'class="story"', 'role="main"', 'class="body text"', 'class="articleText"', 'id="mainContent"']),
    ("section", ['class="article"', 'class="story-body"', 'class="content"', 'class="post"']),
    ("td", ['class="content"', 'class="main"']),
]
REGIONS = {
    "nav": [("nav", ["", 'class="main-nav"', 'role="navigation"']), ("div", ['class="menu"', 'id="nav"', 'class="navbar"', 'class="navigation"', 'class="topMenu"', 'class="breadcrumb"', 'class="breadcrumbs"', 'class="pagination"', 'class="toc"']), ("ul", ['class="menu"', 'class="nav"', 'class="breadcrumb"'])],
    "header": [("header", ["", 'class="site-header"', 'id="header"', 'role="banner"']), ("div", ['class="header"', 'id="masthead"', 'class="page-header"', 'class="topbar"', 'class="logo"', 'class="branding"'])],
    "footer": [("footer", ["", 'class="site-footer"', 'role="contentinfo"']), ("div", ['class="footer"', 'id="footer"', 'class="copyright"', 'class="bottom"', 'id="colophon"', 'class="legal"', 'class="imprint"'])],
    "side": [("aside", ["", 'class="sidebar"', 'role="complementary"']), ("div", ['class="sidebar"', 'id="sidebar"', 'class="side-column"', 'class="widget"', 'class="right-rail"', 'class="related"', 'class="related-posts"', 'class="recommended"', 'class="trending"', 'class="teaser"', 'class="author-box"', 'class="tags"']), ("section", ['class="related"', 'class="widget"', 'class="more-stories"'])],
    "notice": [("div", ['class="cookie-notice"', 'class="cookie-banner"', 'id="cookie-consent"', 'class="notice"', 'class="alert"', 'class="gdpr"', 'class="popup"', 'class="modal"', 'class="overlay"', 'role="alert"', 'role="dialog"', 'class="banner"', 'class="warning"', 'class="disclaimer"', 'class="paywall"']), ("aside", ['class="notice"', 'class="consent"']), ("section", ['class="notice"', 'class="announcement"'])],
    "advert": [("div", ['class="ad"', 'class="ads"', 'class="advert"', 'class="advertisement"', 'class="ad-slot"', 'class="sponsored"', 'class="promo"', 'id="ad-top"', 'class="adBox"', 'class="commercial"', 'class="promotion"']), ("aside", ['class="ad"', 'class="advert"', 'class="promo"']), ("section", ['class="ads"', 'class="sponsor"'])],
    "form": [("form", ["", 'class="search"', 'action="/login"', 'class="newsletter-form"', 'id="subscribe"', 'class="contact"']), ("div", ['class="newsletter"', 'class="search-box"', 'class="login"', 'class="subscribe"', 'class="signup"', 'class="poll"', 'class="survey"', 'class="form"']), ("fieldset", [""])],
    "share": [("div", ['class="share"', 'class="social"', 'class="share-buttons"', 'class="toolbar"', 'class="follow-us"']), ("ul", ['class="social-links"', 'class="share"'])],
    "comments": [("section", ['class="comments"', 'id="comments"', 'class="discussion"', 'class="responses"']), ("div", ['id="comments"', 'class="comments"', 'class="comment-list"', 'id="disqus-thread"', 'class="replies"', 'class="reader-comments"', 'class="user-comments"', 'class="feedback"', 'class="reviews"']), ("ol", ['class="commentlist"', 'class="comments"'])],
}
COMMENT = [("div", ['class="comment"', 'class="reply"', "", 'class="comment-body"', 'class="post-comment"']), ("article", ['class="comment"', ""]), ("li", ['class="comment"', ""]), ("blockquote", ['class="comment"'])]
WRAPPERS = ["", 'class="wrapper"', 'class="container"', 'class="row"', 'class="col-8"', 'id="page"', 'class="inner"', 'class="layout"', 'class="grid"', 'class="site"', 'class="clearfix"']
LABELS = "Home News About Contact Menu Search Login Subscribe Archive Privacy Terms Share Reply Next Previous Top More".split()


class Layout:
    """Draws a page around given texts. ``named`` says whether its regions have telling tags and names."""

    def __init__(self, rng: random.Random, prose: list[str], short: list[str]):
        self.rng, self.prose, self.short = rng, prose, short
        self.named = rng.random() < 0.85

    def say(self) -> str:
        return self.rng.choice(self.prose)

    def brief(self) -> str:
        words, n = self.say().split(), self.rng.choice((1, 1, 2, 3, 4, 6, 8, 12))
        return " ".join(words[-n:] if self.rng.random() < 0.5 else words[:n])

    def label(self) -> str:
        return self.rng.choice(self.short if self.rng.random() < 0.6 else LABELS)

    def inside(self, kinds: list, inner: str, plain: str = "div") -> str:
        if not self.named:
            return f"<{plain}>{inner}</{plain}>"
        tag, attributes = self.rng.choice(kinds)
        made = self.rng.choice(attributes)
        if tag in ("ul", "ol") and "<li" not in inner:
            inner = f"<li>{inner}</li>"
        return f"<{tag}{' ' * bool(made)}{made}>{inner}</{tag}>"

    def wrapped(self, inner: str) -> str:
        for _ in range(self.rng.choice((0, 0, 1, 1, 2, 3))):
            made = self.rng.choice(WRAPPERS)
            inner = f"<div{' ' * bool(made)}{made}>{inner}</div>"
        return inner

    def links(self, least: int, most: int) -> str:
        made = [f'<a href="/{i}">{self.label() if self.rng.random() < 0.8 else self.brief()}</a>' for i in range(self.rng.randint(least, most))]
        form = self.rng.choice(("<li>{}</li>", "<li>{}</li>", "{} | ", "<div>{}</div>", "<p>{}</p>"))
        inner = "".join(form.format(m) for m in made)
        return f"<ul>{inner}</ul>" if form.startswith("<li") else inner

    def para(self, text: str) -> str:
        words, rng = text.split(" "), self.rng
        if len(words) > 6 and rng.random() < 0.3:
            at = rng.randrange(len(words) - 2)
            tag, attributes = rng.choice((("b", ""), ("em", ""), ("a", ' href="/x"'), ("span", ""), ("strong", "")))
            words[at] = f"<{tag}{attributes}>{words[at]}</{tag}>"
        return " ".join(words)

    def article(self) -> str:
        rng, made = self.rng, []
        if rng.random() < 0.8:
            head = f"<h1>{MARK}{self.brief()}</h1>"
            made.append(f"<header>{head}</header>" if rng.random() < 0.15 else head)
        text, again = "", rng.choice((0.0, 0.0, 0.2))
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4, 4, 5, 6, 7, 9, 11, 14, 17, 20, 30, rng.randint(50, 150)))):
            if not text or rng.random() >= again:
                text = self.para(self.say() if rng.random() < 0.8 else self.brief())
            kind = rng.random()
            if kind < 0.7:
                made.append(f"<p>{MARK}{text}</p>" if rng.random() < 0.8 else f"<p><b>{MARK}{text}<br>")
            elif kind < 0.78:
                made.append(f"<h2>{MARK}{self.brief()}</h2>")
            elif kind < 0.84:
                made.append("<ul>" + "".join(f"<li>{MARK}{self.brief()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.88:
                made.append(f"<blockquote><p>{MARK}{text}</p></blockquote>")
            elif kind < 0.91:
                made.append("<table><tr>" + "".join(f"<td>{MARK}{self.brief()}</td>" for _ in range(rng.randint(1, 4))) + "</tr></table>")
            elif kind < 0.94:
                made.append(f"<figure><img src=x><figcaption>{MARK}{self.brief()}</figcaption></figure>")
            elif kind < 0.97:
                made.append(f"<pre>{MARK}{self.brief()}</pre>")
            else:
                made.append(f"<div>{MARK}{text}</div>")
        if self.named:
            for _ in range(rng.choice((0, 1, 1, 2, 2, 3))):
                name = rng.choice(("advert", "advert", "advert", "share", "side", "side", "form", "notice", "notice", "nav"))
                made.insert(rng.randint(0, len(made)), self.region(name))
            if rng.random() < 0.15:
                made.append(self.region("comments"))
        inner = "".join(made)
        if rng.random() < 0.2:
            inner = f"<div>{inner}</div>"
        return self.inside(MAIN, inner)

    def region(self, name: str) -> str:
        rng = self.rng
        if name == "nav":
            return self.inside(REGIONS[name], self.links(2, 9))
        if name == "header":
            inner = rng.choice((f"<h1>{self.label()}</h1>", f"<div>{self.brief()}</div>", f"<h1>{self.brief()}</h1><p>{self.brief()}</p>", self.links(1, 4)))
            return self.inside(REGIONS[name], inner)
        if name == "footer":
            inner = rng.choice((f"&copy; {self.brief()}", f"<p>&copy; {self.label()} &middot; {self.brief()}</p>", f"<p>{self.say()}</p>", self.links(2, 6), f"{self.brief()}"))
            return self.inside(REGIONS[name], inner + (self.links(1, 4) if rng.random() < 0.3 else ""))
        if name == "side":
            inner = rng.choice((f"<h3>{self.label()}</h3>{self.links(2, 6)}", f"<h3>{self.brief()}</h3><p>{self.say()}</p>", f"<p>{self.say()}</p>", self.brief(), f"<h4><a href=x>{self.brief()}</a></h4><p>{self.brief()}</p>"))
            return self.inside(REGIONS[name], inner)
        if name == "form":
            inner = f"<label>{self.label()}</label><input name=q><button>{self.label()}</button>"
            inner += rng.choice(("", f"<p>{self.brief()}</p>", f"<p>{self.say()}</p>", f"<select><option>{self.label()}<option>{self.label()}</select>"))
            return self.inside(REGIONS[name], inner, "form")
        if name == "comments":
            each = "".join(
                self.inside(COMMENT, rng.choice((f"<p>{self.say()}</p>", f"<b>{self.label()}</b><p>{self.say()}</p><p>{self.brief()}</p>", self.say(), f"<h4>{self.label()}</h4><div>{self.brief()}</div>")))
                for _ in range(rng.randint(1, 5))
            )
            head = rng.choice(("", f"<h2>{self.label()}</h2>", f"<h3>{self.brief()}</h3>"))
            return self.inside(REGIONS[name], head + each + (self.region("form") if rng.random() < 0.3 else ""))
        if name == "share":
            return self.inside(REGIONS[name], self.links(1, 4))
        inner = rng.choice((self.brief(), f"<p>{self.brief()}</p>", f"<p>{self.say()}</p>", f"{self.say()}", f"<h4>{self.label()}</h4><p>{self.say()}</p><button>{self.label()}</button>"))
        return self.inside(REGIONS[name], inner)

    def page(self) -> str:
        rng = self.rng
        if self.named:
            above = [n for n in ("header", "nav", "nav", "notice", "advert", "form", "side") if rng.random() < 0.4]
            below = [n for n in ("side", "side", "advert", "share", "comments", "comments", "form", "nav", "notice") if rng.random() < 0.35]
            rng.shuffle(above)
            rng.shuffle(below)
            below += ["footer"] if rng.random() < 0.85 else []
            # What stands beside the article may come in one box with it.
            split = rng.randint(0, len(below))
        else:
            # Without names only menus and closing lines tell themselves apart.
            above, below, split = ["nav"], ["footer"], 0
        body = self.article() if rng.random() < 0.95 else ""
        body += "".join(self.region(n) for n in below[:split])
        body = self.wrapped(body)
        if self.named and rng.random() < 0.1:
            body = f"<main>{body}</main>"
        return self.wrapped("".join(self.region(n) for n in above) + body + "".join(self.region(n) for n in below[split:]))


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels from an ``article`` element, or else a ``main`` one; None without."""
    for tag in ("<article", "<main"):
        inside = np.array([path_slot(tag) in b.path for b in blocks], bool)
        if inside.any() and not inside.all():
            return inside
    return None


def training_pages(pages: list[str], drawn: int, seed: int = 0) -> list[tuple[Encoded, np.ndarray]]:
    """Pages that label themselves, and ``drawn`` layouts of their texts."""
    rng, made, prose, short = random.Random(seed), [], [], []
    for html in pages:
        blocks = blocks_of(html)
        labels = own_labels(blocks)
        if labels is not None:
            made.append((Encoded(blocks, rng), labels))
        for i, b in enumerate(blocks):
            if MARK not in b.text and "<" not in b.text and "&" not in b.text:
                long = len(b.text) > 60 and not b.link_chars
                (prose if long or (labels is not None and labels[i]) else short).append(b.text[:2000])
    prose, short = prose or ["text"], short or LABELS
    for _ in range(drawn):
        blocks = blocks_of(Layout(rng, prose, short).page())
        labels = np.array([MARK in b.text for b in blocks], bool)
        made.append((Encoded([b._replace(text=b.text.replace(MARK, "") or "x") for b in blocks], rng), labels))
    return made


def learn(df: DataFrame, html_col: str = "html", sample_pages: int = 400, sample_chars: int = 200_000, drawn: int = 1200, rounds: int = 20) -> Labeller:
    """A labeller from a sample of the pages in ``df``."""
    html = F.col(html_col).cast("string").alias("html")
    rows = df.select(html).filter((F.length("html") > 0) & (F.length("html") <= sample_chars))
    # The hashes are chosen first, so that no more pages than the sample's reach the driver.
    chosen = rows.select(F.xxhash64("html").alias("hash")).distinct().orderBy("hash").limit(sample_pages).collect()
    sample = rows.filter(F.xxhash64("html").isin([r["hash"] for r in chosen])).distinct().collect()
    return fit(training_pages(sorted(r.html for r in sample), drawn), rounds)


def main_texts(df: DataFrame, model: Labeller, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars`` of each row."""
    weights = df.sparkSession.sparkContext.broadcast(model.weights)

    def make():
        own = Labeller(0)
        own.weights = weights.value

        def work(values: list) -> list[pa.Array]:
            pages = [blocks_of(v) if v else [] for v in values]
            labels = own.labels([Encoded(b) for b in pages])
            texts = [" ".join(b.text for b, good in zip(blocks, y) if good) for blocks, y in zip(pages, labels)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    kept = df.select(*keep)
    rows = df.withColumn(fresh(df, "html_text"), F.col(html_col).cast("string"))
    names = fresh(kept, "text"), fresh(kept, "n_chars")
    return per_row(rows, keep, fresh(df, "html_text"), f"{names[0]} string, {names[1]} long", make)


def extract_main_text(df: DataFrame, keep: list[str], html_col: str = "html", **settings) -> DataFrame:
    """``learn`` from the table, then ``main_texts`` of all its rows."""
    if df.select(html_col).limit(1).count() == 0:
        return df.select(*keep, F.lit("").alias(fresh(df.select(*keep), "text")), F.lit(0).cast("long").alias(fresh(df.select(*keep), "n_chars")))
    return main_texts(df, learn(df, html_col, **settings), keep, html_col)
