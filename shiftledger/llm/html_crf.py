"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks: runs of text between borders of block elements, with the tags and the class, id
and role words of their ancestors. Each block has binary features of its ancestors and of its text; a chain over the
blocks of a page labels them as content or not. Weights come from labelled pages (`html_pages`) by maximum likelihood
with forward-backward sums, and pages are decoded by Viterbi. Raw text of scripts, styles and the head is no block.

Rows: a null or empty page has an empty text; equal rows get equal texts; other columns are not read. Pages are read
whole, however long.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose borders end a block, elements without content, and elements that hold no blocks.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary
    table tbody td tfoot th thead tr ul button select option textarea label iframe""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template title svg math iframe object select textarea button canvas audio video".split())
RAW = frozenset("script style noscript template title textarea iframe".split())
#: Start tags that end an open element of these names.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role attributes, by what they say about the element.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pager pagination skip",
    "header": "header masthead banner topbar branding logo",
    "footer": "footer contentinfo copyright colophon legal imprint",
    "side": "sidebar aside related recommended recommendations widget complementary rail trending popular",
    "notice": "notice cookie cookies consent gdpr alert modal popup overlay newsletter subscribe paywall signup toast",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promoted promotion adsense dfp outbrain taboola",
    "comment": "comment comments reply replies disqus discussion respond reader readers feedback",
    "form": "form search searchbox login signin contact",
    "share": "share sharing social follow like likes",
    "meta": "byline meta tags tag author date timestamp",
    "body": "article content post entry story main body text prose",
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_ENDS = (".", "!", "?", "…", '."', ".”", "。")
#: Marks of elements that hold no content, wherever they stand.
NOISE = frozenset({"in:nav", "in:footer", "in:aside", "in:form", "in:menu",
                   *(f"hint:{k}" for k in ("menu", "footer", "side", "notice", "advert", "comment", "form", "share"))})
BODY = frozenset({"in:article", "in:main", "hint:body"})
CONTENT = 1


@dataclass
class Block:
    text: str
    tag: str
    marks: frozenset[str]
    linked: int  # characters inside links


@lru_cache(4096)
def _hints(attributes: str) -> frozenset[str]:
    found = set()
    for groups in _NAMED.findall(attributes):
        for word in re.split(r"[^a-z]+", "".join(groups).lower()):
            kind = _HINT_OF.get(word) or _HINT_OF.get(word.rstrip("s"))
            if kind:
                found.add(f"hint:{kind}")
    return frozenset(found)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order; those without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []  # element, marks of it and all its ancestors
    parts: list[str] = []
    linked, skipping, at = 0, 0, 0
    none: frozenset[str] = frozenset()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                tag = next((t for t, _ in reversed(stack) if t in BLOCK), "")
                out.append(Block(text, tag, stack[-1][1] if stack else none, linked))
            parts.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not skipping:
            text = html.unescape(raw)
            parts.append(text)
            if any(t == "a" for t, _ in stack):
                linked += len(text)

    def pop_to(i: int) -> None:
        nonlocal skipping
        for t, _ in stack[i:]:
            skipping -= t in SKIPPED
        del stack[i:]

    while True:
        m = _TAG.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at:m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCK:
                flush()
            if found is not None and (tag in BLOCK or not any(t in BLOCK for t, _ in stack[found + 1:])):
                pop_to(found)
            continue
        if tag in BLOCK:
            flush()
            if tag == "body" and any(t == "head" for t, _ in stack):
                pop_to(next(i for i, (t, _) in enumerate(stack) if t == "head"))
            ends = CLOSES.get(tag, {"p"} if tag not in ("button", "label", "option") else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        elif tag == "br":
            take(" ")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        marks = stack[-1][1] if stack else none
        stack.append((tag, marks | {f"in:{tag}"} | _hints(m[3])))
        skipping += tag in SKIPPED
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            pop_to(len(stack) - 1)
    flush()
    return out


def features(b: Block) -> list[str]:
    text = b.text
    n = len(text)
    words = text.count(" ") + 1
    length = "1" if words < 3 else "2" if words < 8 else "3" if words < 20 else "4" if words < 60 else "5"
    linked = b.linked / n
    return [
        "bias", f"tag:{b.tag}", *b.marks, f"noise:{not NOISE.isdisjoint(b.marks)}:{not BODY.isdisjoint(b.marks)}", f"words:{length}",
        "links:" + ("none" if not linked else "some" if linked < 0.3 else "half" if linked < 0.8 else "all"),
        "ends:sentence" if text.endswith(_ENDS) else "ends:open",
        *(["copyright"] if "©" in text or "(c)" in text.lower() else []),
    ]


@dataclass(frozen=True)
class Model:
    """Weights of features for (other, content), of a first label, and of neighbouring labels."""

    names: dict[str, int]
    weights: np.ndarray
    first: np.ndarray
    step: np.ndarray

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        out = []
        for b in page:
            at = [self.names[f] for f in features(b) if f in self.names]
            out.append(tuple(self.weights[at].sum(axis=0).tolist()))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The most probable labels, by Viterbi."""
        if not page:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        back: list[tuple[int, int]] = []
        scores = self.scores(page)
        a, b = (x + y for x, y in zip(scores[0], self.first.tolist()))
        for e0, e1 in scores[1:]:
            from0, from1 = int(b + s10 > a + s00), int(b + s11 > a + s01)
            back.append((from0, from1))
            a, b = e0 + (b + s10 if from0 else a + s00), e1 + (b + s11 if from1 else a + s01)
        labels = [int(b > a)]
        for pointers in reversed(back):
            labels.append(pointers[labels[-1]])
        return labels[::-1]


def train(pages: Iterable[tuple[list[Block], list[int]]], rounds: int = 120, penalty: float = 0.02, rate: float = 0.1) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam. Chains of all pages advance together, padded to the longest."""
    pages = [(p, y) for p, y in pages if p]
    names = {f: k for k, f in enumerate(dict.fromkeys(f for p, _ in pages for b in p for f in features(b)))}
    n, longest = len(pages), max(len(p) for p, _ in pages)
    x = np.zeros((n, longest, len(names)), np.float32)
    y = np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    for i, (page, labels) in enumerate(pages):
        for t, b in enumerate(page):
            x[i, t, [names[f] for f in features(b)]] = 1
        y[i, :len(page)], real[i, :len(page)] = labels, True
    both = real[:, 1:] & real[:, :-1]
    gold = np.eye(2)[y] * real[..., None]
    gold_steps = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], both)
    parts = [np.zeros((len(names), 2)), np.zeros(2), np.zeros((2, 2))]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for turn in range(1, rounds + 1):
        w, first, step = parts
        score = x @ w
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0] + first
        for t in range(1, longest):
            new = score[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1)
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        behind = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(step + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        odds = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        pair = ahead[:, :-1, :, None] + step + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0)) * both[..., None, None]
        slopes = [np.einsum("ntf,nta->fa", x, gold - odds) / n - penalty * w, (gold[:, 0] - odds[:, 0]).mean(axis=0) - penalty * first,
                  (gold_steps - pair.sum(axis=(0, 1))) / n - penalty * step]
        for k, g in enumerate(slopes):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            parts[k] = parts[k] + rate * (m[k] / (1 - 0.9 ** turn)) / (np.sqrt(v[k] / (1 - 0.999 ** turn)) + 1e-8)
    return Model(names, *parts)


def text_of(page: str | None, model: Model) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, label in zip(found, model.decode(found)) if label == CONTENT)


def main_text(page: Column | str, model: Model) -> Column:
    """The main text of a page; empty if there is none."""
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([text_of(p, model) for p in pages.to_pylist()], pa.string())

    return extract(page)
