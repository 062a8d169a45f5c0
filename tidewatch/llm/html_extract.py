"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (text between block-level tags). The field has two states, main text and other; a block's
features are its ancestors' tags, their class, id and role words, and the shape of its text. It is trained on labelled
pages (a bounded sample of the table, labelled by its article markup, and page layouts with known labels filled with
blocks of that sample) and decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import stage

#: HTML element names by their role in layout.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of a block's path, innermost ones; pages are seldom a twentieth as deep.
DEPTH = 256
RAW = frozenset("script style noscript template title iframe".split())
IN_HEAD = RAW | frozenset("meta link base basefont bgsound noframes".split())
FOREIGN = frozenset("svg math select datalist".split())
BREAKS_OUT = frozenset("address article aside blockquote body center details div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre "
                       "section table tbody td th tr ul".split())
OTHER_TAGS = frozenset("nav aside footer header form button dialog menu svg select datalist".split())
OTHER_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb comment comments cookie cookies footer menu nav navbar newsletter notice "
                        "disqus discussion replies pagination popup promo related reply respond share sidebar signup social sponsor sponsored subscribe toolbar widget".split())

_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_NAMES = re.compile(r"(?:^|\s)(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple        # (tag, words) of the open elements that are not inline
    linked: int        # characters inside links


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """Pieces of a page as (kind, name or text, attributes, end): ``text``, ``open``, ``close``. Comments and declarations are left out.

    A tag ends at the first ``>`` outside quotes, or, if a quote is never closed, at its first ``>``. What cannot be found once is
    not looked for again, so the time is in proportion to the page."""
    at, n, last_end = 0, len(page), page.rfind(">")
    missing: set[str] = set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        i = page.find(what, start)
        if i < 0:
            missing.add(what)
        return i

    while at < n:
        if page[at] != "<":
            i = page.find("<", at)
            i = n if i < 0 else i
            yield "text", page[at:i], "", i
            at = i
            continue
        if page.startswith("<!--", at):
            i = find("-->", at + 4)
            at = n if i < 0 else i + 3
            continue
        if page.startswith("<![CDATA[", at) and (i := find("]]>", at)) >= 0:
            yield "text", page[at + 9:i], "", i + 3
            at = i + 3
            continue
        m = _OPEN.match(page, at) if at < last_end else None
        if m is None:
            if at < last_end and page[at + 1:at + 2] in ("!", "?"):
                at = page.find(">", at) + 1
            else:
                yield "text", "<", "", at + 1
                at += 1
            continue
        i = m.end()
        while True:
            i = _PLAIN.match(page, i).end()
            if i >= n or page[i] == ">":
                break
            i = find(page[i], i + 1) + 1
            if not i:
                break
        if not i or i >= n:
            i = page.find(">", m.end())
        yield "close" if m[1] else "open", m[2].lower(), page[m.end():i], i + 1
        at = i + 1


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order: character references decoded, white space made one space, empty ones left out.

    Elements of raw text run to their end tag. A head ends at its end tag or at the first tag that cannot stand in one. Other
    elements end with their end tag or that of an element around them; drawings, formulas and lists of choices that are never
    closed also end where a block of text begins. A page of any length is read whole."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    opened: Counter = Counter()                            # open elements by name
    text: list[str] = []
    linked, links, head, skip = 0, 0, False, 0

    def close():
        nonlocal linked
        one = " ".join(html.unescape("".join(text)).split())
        if one:
            out.append(Block(one, tuple(stack[-DEPTH:]), linked))
        text.clear()
        linked = 0

    def cut_back(to: int):
        opened.subtract(tag for tag, _ in stack[to:])
        del stack[to:]

    for kind, name, attrs, at in tokens(page):
        if at <= skip:                                     # inside an element of raw text
            continue
        if kind == "text":
            if not head:
                text.append(name)
                if links:
                    linked += len(name)
            continue
        if kind == "close":
            if name == "a":
                links = max(0, links - 1)
            head = head and name != "head"
            if name in INLINE:
                continue
            close()
            if opened[name] > 0:
                cut_back(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name == "head":
            close()
            head = True
            continue
        if name in RAW and not attrs.endswith("/"):
            stop = re.compile(r"</%s\b[^>]*>" % re.escape(name), re.I).search(page, at)
            close()
            skip = stop.end() if stop else len(page)
            continue
        head = head and name in IN_HEAD
        if name in INLINE:
            links += name == "a"
            continue
        close()
        if name in VOID or attrs.endswith("/"):
            continue
        if name in BREAKS_OUT and any(opened[tag] > 0 for tag in FOREIGN):
            cut_back(next(i for i, (tag, _) in enumerate(stack) if tag in FOREIGN))
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
            cut_back(len(stack) - 1)
        words = frozenset(w for a in _NAMES.finditer(attrs) for w in (["=" + (a[2] or a[3] or a[4] or "")] if a[1].lower() == "data-label" else
                                                                      _WORDS.findall((a[2] or a[3] or a[4] or "").lower())))
        stack.append((name, words))
        opened[name] += 1
        links = 0
    close()
    return out


_PATHS: dict[tuple, tuple] = {}


def _path_features(path: tuple) -> tuple:
    if path not in _PATHS:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        tags = {"in=" + t for t, _ in path if t not in ("html", "body")}
        words = {"named=" + w for _, ws in path for w in ws if w[0] != "="}
        _PATHS[path] = (*sorted(tags), *sorted(words), "leaf=" + (path[-1][0] if path else ""), "bias")
    return _PATHS[path]


def features(found: list[Block]) -> list[tuple]:
    out = []
    for b in found:
        t = b.text
        share = b.linked / max(1, len(t))
        n = t.count(" ") + 1
        out.append(_path_features(b.path) + (
            f"words={min(7, n.bit_length())}", "link=" + ("no" if share < 0.05 else "most" if share > 0.6 else "some"),
            "stop=" + str(t[-1] in ".!?…\"'»”"), "commas=" + str(min(3, t.count(","))), "sign=" + str(t[0] in "©|•·»>" or "©" in t)))
    return out


# --- the field --------------------------------------------------------------------------------------------------------

def train(pages: list[tuple[list[tuple], list[int]]], rounds: int = 120, reg: float = 1e-3) -> tuple[dict[str, float], np.ndarray]:
    """Weights (state 1 against state 0) of the features, and the 2 × 2 transition scores, by gradient steps on the
    exact likelihood (forward-backward over all chains at once)."""
    chains = [(f[i:i + 64], y[i:i + 64]) for f, y in pages for i in range(0, len(f), 64)]
    names: dict[str, int] = {}
    t_max = max((len(f) for f, _ in chains), default=1)
    n = len(chains)
    if not n:
        return {"in=article": 4.0, "in=main": 4.0, "bias": -1.0}, np.zeros((2, 2))
    cell, feat = [], []
    y = np.zeros((n, t_max), np.int64)
    live = np.zeros((n, t_max), bool)
    for c, (fs, ys) in enumerate(chains):
        for t, f in enumerate(fs):
            ids = [names.setdefault(x, len(names)) for x in f]
            feat += ids
            cell += [c * t_max + t] * len(ids)
        y[c, :len(ys)], live[c, :len(ys)] = ys, True
    cell, feat = np.array(cell), np.array(feat)
    theta = np.zeros(len(names) + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    pair = live[:, 1:] & live[:, :-1]
    for step in range(1, rounds + 1):
        emit = np.zeros((n, t_max, 2))
        emit[:, :, 1] = np.bincount(cell, theta[:-4][feat], n * t_max).reshape(n, t_max)
        move = theta[-4:].reshape(2, 2)
        fwd, bwd = np.zeros((n, t_max, 2)), np.zeros((n, t_max, 2))
        fwd[:, 0] = emit[:, 0]
        for t in range(1, t_max):
            nxt = np.logaddexp(fwd[:, t - 1, 0, None] + move[0], fwd[:, t - 1, 1, None] + move[1]) + emit[:, t]
            fwd[:, t] = np.where(live[:, t, None], nxt, fwd[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            after = emit[:, t + 1] + bwd[:, t + 1]
            back = np.logaddexp(move[:, 0] + after[:, 0, None], move[:, 1] + after[:, 1, None])
            bwd[:, t] = np.where(live[:, t + 1, None], back, 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.where(live, np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]), 0)
        joint = np.exp(fwd[:, :-1, :, None] + move + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        gap = (np.where(live, y, 0) - p1).ravel()
        seen = np.array([[(pair & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        grad = np.concatenate([np.bincount(feat, gap[cell], len(names)), (seen - joint.sum((0, 1))).ravel()]) / n - reg * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta += 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    return {k: float(theta[i]) for k, i in names.items()}, theta[-4:].reshape(2, 2)


def viterbi(scores: list[float], move: list[list[float]]) -> list[int]:
    """Best state sequence; the score of state 0 is 0, ties go to state 0."""
    (m00, m01), (m10, m11) = move
    a = b = 0.0
    back = []
    for i, s in enumerate(scores):
        if i == 0:
            a, b = 0.0, s
            continue
        back.append((m10 + b > m00 + a, m11 + b > m01 + a))
        a, b = max(m00 + a, m10 + b), max(m01 + a, m11 + b) + s
    state = int(b > a)
    out = [state]
    for to0, to1 in reversed(back):
        state = int(to1 if state else to0)
        out.append(state)
    return out[::-1] if scores else []


def main_text(page: str, weights: dict[str, float], move: list[list[float]]) -> str:
    found = blocks(page)
    get = weights.get
    states = viterbi([sum(get(f, 0.0) for f in fs) for fs in features(found)], move)
    return " ".join(b.text for b, s in zip(found, states) if s)


# --- labelled pages -----------------------------------------------------------------------------------------------------

def markup_labels(found: list[Block]) -> list[int]:
    """Label by markup: inside ``article`` or ``main`` and inside no element whose tag or names say otherwise."""
    return [int(any(t in ("article", "main") for t, _ in b.path) and not any(t in OTHER_TAGS or ws & OTHER_WORDS for t, ws in b.path))
            for b in found]


#: Labelled layouts. {p} is filled with a paragraph, {s} with a short text, {n} with a list of links; main text is marked.
LAYOUTS = (
    '<header><a href="/">{s}</a><p>{s}</p></header><nav>{n}</nav><main><div class="content"><div data-label="main"><h1>{s}</h1><p>{p}</p><p>{p}</p></div></div></main><aside class="sidebar"><h3>{s}</h3>{n}<p>{p}</p></aside><footer><p>{s}</p></footer>',
    '<div id="header"><h2>{s}</h2></div><div id="menu">{n}</div><div id="content"><div data-label="main"><h1>{s}</h1><p>{p}</p><p>{s}</p><p>{p}</p></div></div><div id="sidebar"><p>{p}</p>{n}</div><div id="footer">&copy; {s}</div>',
    '<div class="cookie-notice"><p>{p}</p><button>{s}</button></div><article><div data-label="main"><h1>{s}</h1><p>{p}</p><blockquote>{p}</blockquote></div><section class="comments"><h3>{s}</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>{p}</p></div></section></article><footer>{s}</footer>',
    '<nav>{n}</nav><div class="post"><div class="entry-content" data-label="main"><p>{p}</p><ul><li>{s}</li><li>{p}</li></ul><p>{p}</p></div><div class="share social">{n}</div><div id="comments"><p>{p}</p><p>{s}</p></div></div><div class="ad">{s}</div>',
    '<article><header><p>{s}</p></header><div data-label="main"><h2>{s}</h2><p>{p}</p></div><div class="ad"><p>{p}</p></div><div data-label="main"><p>{p}</p><p>{s}</p></div><aside class="related">{n}<p>{p}</p></aside><form><label>{s}</label><p>{p}</p><input></form></article>',
    '<div class="banner promo"><p>{p}</p></div><div class="article-body" data-label="main"><h1>{s}</h1><p>{p}</p><table><tr><td>{s}</td><td>{s}</td></tr></table><p>{p}</p></div><div class="newsletter subscribe"><form><p>{p}</p></form></div><div role="contentinfo">{s}</div>',
    '<div class="notice"><p>{s}</p></div><main><section data-label="main"><h1>{s}</h1><p>{p}</p><p>{p}</p><pre>{s}</pre></section><section id="reader-comments"><article><p>{p}</p></article><article><p>{s}</p></article></section></main>',
    '<ul class="nav">{n}</ul><p data-label="main">{p}</p><p data-label="main">{p}</p><div class="advertisement">{p}</div><p data-label="main">{s}</p><footer><p>{p}</p></footer>',
)


def labelled_pages(sample: list[str], fills: int = 12) -> list[tuple[list[tuple], list[int]]]:
    """Chains of (features, labels) from the sampled pages and from the layouts filled with their blocks in turn."""
    out, long_, short = [], [], []
    for page in sample:
        found = blocks(page)
        out.append((features(found), markup_labels(found)))
        for b in found:
            (long_ if b.text.count(" ") >= 12 else short).append(html.escape(b.text))
    long_ = long_ or ["Some words of a longer paragraph that goes on for a while, and then ends with a full stop."]
    short = short or ["Some words", "A short line."]
    i = 0

    def take(kind):
        nonlocal i
        i += 1
        if kind == "n":
            return "<ul>" + "".join(f'<li><a href="#">{short[(i * 7 + k) % len(short)].split(" ")[0]}</a></li>' for k in range(5)) + "</ul>"
        pool = long_ if kind == "p" else short
        return pool[(i * 7919) % len(pool)]

    for _ in range(fills):
        for layout in LAYOUTS:
            found = blocks("<body>" + re.sub(r"\{([psn])\}", lambda m: take(m[1]), layout) + "</body>")
            out.append((features(found), [int(any("=main" in ws for _, ws in b.path)) for b in found]))
    return out


def fit(pages: DataFrame, html_col: str = "html", max_pages: int = 300) -> tuple[dict[str, float], list[list[float]]]:
    """Train on at most ``max_pages`` pages (in order of a hash of the page) and the layouts; one task holds that sample.

    Null and empty pages are not sampled; pages without article markup are used in the fill of the layouts only."""
    sample = pages.select(html_col).filter(F.length(html_col) > 0).orderBy(F.xxhash64(html_col), html_col).limit(max_pages)
    sample = stage(sample, "labelled-pages").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for b in batches for x in b.column(0).to_pylist()]
        weights, move = train(labelled_pages(texts))
        keys = [*weights, "move00", "move01", "move10", "move11"]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([*weights.values(), *move.ravel().tolist()])], ["name", "weight"])

    model = {r.name: r.weight for r in sample.mapInArrow(run, "name string, weight double").collect()}  # features of the sample
    if not model:
        weights, move = train(labelled_pages([]))
        return weights, move.tolist()
    move = [[model.pop("move00"), model.pop("move01")], [model.pop("move10"), model.pop("move11")]]
    return model, move


def extract(pages: DataFrame, model: tuple[dict[str, float], list[list[float]]], html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text ``out``; null and empty pages give an empty text. A column of that name is replaced."""
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        weights, move = shipped.value
        return pa.array([main_text(x or "", weights, move) for x in (v.as_py() for v in column)], pa.string())

    return pages.withColumn(out, run(F.col(html_col)))
