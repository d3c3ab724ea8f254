"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: runs of text between the starts and ends of block elements. Each block has features
from its ancestors (tags, kinds of class and id words) and from its text (length, links, punctuation). A linear-chain
CRF with two labels, article and rest, scores the chain of blocks; Viterbi decoding finds the best labelling, and the
article's blocks are the text.

The field is trained on labelled pages: pages written by rule, whose blocks are labelled as they are made, with
articles in many kinds of containers among menus, headers, footers, sidebars, notices, adverts, forms and comments.
Their number is bounded by ``TRAIN_PAGES``; nothing is learned from the pages to be read.

A null page is empty; a page without article blocks has an empty text. Broken markup is read as far as it goes: an
open tag at the end is markup, unknown end tags are passed over, ``<!-->`` is an empty comment. Only scripts, styles, titles,
templates, frames and form controls are left out by rule; text in other elements (formulas, drawings, fallback content)
is the field's to judge. Long and deeply nested pages take linear time. Repeated rows are read each by itself. Other
columns are not looked at.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilwork.llm.common import bytes_of, cell

TRAIN_PAGES = 500

#: HTML element kinds.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: What a start tag ends, if it is open and innermost.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role attributes, by the kind of part they name.
KINDS = {
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc topbar skip",
    "ad": "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion",
    "side": "side sidebar aside widget widgets related recommended recommendations trending popular teaser more tags",
    "foot": "foot footer copyright colophon legal bottom imprint",
    "head": "head header masthead logo brand top hero",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall signup message",
    "comment": "comment comments reply replies discussion disqus respond reaction reactions",
    "social": "share sharing social follow",
    "form": "form login search searchform signin contact input",
    "main": "article content post entry story main body text blog page wrapper container",
}
_KIND = {w: k for k, words in KINDS.items() for w in words.split()}

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|title|template|textarea|select|iframe|button)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


def _names(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    words = _WORD.findall(" ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower())
    return sorted({"c:" + _KIND[w] for w in words if w in _KIND})


def leaf_blocks(page: str) -> list[tuple[str, list[str]]]:
    """(text, features) of each leaf block that is not empty, in page order."""
    out: list[tuple[str, list[str]]] = []
    stack: list[tuple[str, list[str]]] = []
    active: Counter[str] = Counter()
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    in_link = False
    headed = False

    def flush() -> None:
        nonlocal linked, in_link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                inner = stack[-1][0] if stack else "none"
                out.append((text, [*active, "in:" + inner, *text_features(text, linked), "headed" if headed else "unheaded"]))
            parts.clear()
        linked, in_link = 0, False

    def pop() -> None:
        tag, names = stack.pop()
        opened[tag] -= 1
        for name in names:
            active[name] -= 1
            if not active[name]:
                del active[name]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * in_link
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not m[2]
        if tag not in BLOCKS:
            continue
        flush()
        if m[2]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID:
            ends = ENDS.get(tag, ())
            while stack and (stack[-1][0] == "p" or stack[-1][0] in ends):
                pop()
            headed = headed or tag == "h1"
            names = ["t:" + tag, *_names(m[4])]
            stack.append((tag, names))
            opened[tag] += 1
            active.update(names)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def text_features(text: str, linked: int) -> list[str]:
    n = len(text)
    marks = sum(text.count(c) for c in ".!?")
    return [
        f"len:{min(10, n.bit_length())}",
        "link:all" if 2 * linked > n else "link:some" if linked else "link:none",
        f"marks:{min(3, marks)}",
        f"commas:{min(2, text.count(','))}",
        "end:mark" if text[-1] in ".!?:\"'»”" else "end:open",
        "sign" if any(c in text for c in "©®·|»") else "plain",
    ]


# ---- labelled pages -----------------------------------------------------------------------------------------------


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page made by rule and the labels of its leaf blocks (1: article)."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g l m n r s t v".split() for b in "a e i o u an el or is".split()]
    labels: list[int] = []

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(lo, hi)))

    def sentences(n: int) -> str:
        return " ".join((words(1, 14).capitalize() + r.choice([".", ".", ".", "!", "?", ","])) for _ in range(n))

    def block(tag: str, text: str, label: int, attributes: str = "") -> str:
        labels.append(label)
        return f"<{tag}{attributes}>{text}" + (f"</{tag}>" if tag != "p" or r.random() < 0.9 else "")

    def links(n: int) -> str:
        return "<ul>" + "".join(block("li", f'<a href="/{words(1, 1)}">{words(1, 3).capitalize()}</a>', 0) for _ in range(n)) + "</ul>"

    def noise(kind: str) -> str:
        name = r.choice(KINDS[kind].split())
        attribute = r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} box"'])
        tag = {"nav": "nav", "side": "aside", "foot": "footer", "head": "header", "form": "form"}.get(kind, "div")
        if tag != "div" and r.random() < 0.6:
            attribute = ""
        elif r.random() < 0.5:
            tag = r.choice(["div", "section"])
        if kind == "nav":
            inner = links(r.randint(2, 8))
        elif kind == "comment":
            inner = "".join(block(r.choice(["p", "div", "li"]), sentences(r.randint(1, 6)), 0) for _ in range(r.randint(1, 5)))
        elif kind == "foot":
            inner = block("p", f"&copy; {words(1, 3)} &middot; {sentences(r.randint(1, 2))}", 0) if r.random() < 0.5 else None
        elif kind == "form":
            inner = "".join(block(r.choice(["p", "div", "fieldset"]), f"{words(1, 3)} <input name=q>", 0) for _ in range(r.randint(1, 3)))
        elif kind in ("side", "social"):
            inner = (block("h3", words(1, 3), 0) if r.random() < 0.5 else "") + (links(r.randint(2, 5)) if r.random() < 0.6 else block("p", sentences(r.randint(1, 3)), 0))
        else:
            inner = block("p", sentences(r.randint(1, 3)), 0) if r.random() < 0.5 else None
        if inner is None:
            return block(tag, f"&copy; {words(1, 3)} &middot; {sentences(1)}" if kind == "foot" else sentences(r.randint(1, 3)), 0, attribute)
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def article() -> str:
        inner = block("h1", words(2, 10).capitalize() + r.choice(["", "."]), 1) if r.random() < 0.9 else ""
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14])):
            roll = r.random()
            if roll < 0.06:
                inner += noise(r.choice(["ad", "side", "notice", "social"]))
            elif roll < 0.14:
                inner += block("h2", words(1, 6).capitalize(), 1)
            elif roll < 0.2:
                inner += "<ul>" + "".join(block("li", words(2, 12), 1) for _ in range(r.randint(2, 4))) + "</ul>"
            elif roll < 0.25:
                inner += block("blockquote", sentences(r.randint(1, 3)), 1)
            elif roll < 0.4:
                inner += block("p", f"<b>{sentences(r.randint(1, 5))}<br>", 1)
            else:
                text = sentences(r.choice([1, 1, 2, 4, 8, 20]))
                inner += block("p", text + (f' <a href="/x">{words(1, 2)}</a> {words(1, 5)}.' if r.random() < 0.15 else ""), 1)
        name = r.choice("article content post entry story main".split())
        shell = r.choice(["article", "article", "main", "div", "section", ""])
        if not shell:
            return inner
        return f"<{shell}" + (f' class="{name}"' if shell in ("div", "section") or r.random() < 0.2 else "") + f">{inner}</{shell}>"

    top = "".join(noise(k) for k in ("head", "nav", "notice", "ad", "side", "form") if r.random() < 0.5)
    middle = article() if r.random() < 0.97 else ""
    end = "".join(noise(k) for k in ("social", "comment", "side", "ad", "form", "notice", "nav", "foot") if r.random() < 0.45)
    page = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{top}{middle}{end}'
    return page + ("</body></html>" if r.random() < 0.9 else ""), labels


# ---- the field ----------------------------------------------------------------------------------------------------


class Field:
    """Weights of a two-label linear chain: per feature and label, per step, at the beginning and at the end."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray, ends: np.ndarray):
        self.weights = {n: (float(emit[i, 0]), float(emit[i, 1])) for n, i in names.items()}
        self.step, self.ends = step.tolist(), ends.tolist()

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """The best labelling of a chain of blocks, by Viterbi."""
        back, best = [], None
        get, none, step = self.weights.get, (0.0, 0.0), self.step
        for features in blocks:
            e0 = e1 = 0.0
            for f in features:
                w = get(f, none)
                e0 += w[0]
                e1 += w[1]
            if best is None:
                best = (self.ends[0][0] + e0, self.ends[0][1] + e1)
                continue
            to0, to1 = (best[0] + step[0][0], best[1] + step[1][0]), (best[0] + step[0][1], best[1] + step[1][1])
            back.append((to0[1] > to0[0], to1[1] > to1[0]))
            best = (max(to0) + e0, max(to1) + e1)
        if best is None:
            return []
        label = int(best[1] + self.ends[1][1] > best[0] + self.ends[1][0])
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, penalty: float = 0.02, rate: float = 0.2) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam on the gradient of the forward-backward sums."""
    names = {f: i for i, f in enumerate(sorted({f for blocks, _ in pages for b in blocks for f in b}))}
    pages = [p for p in pages if p[1]]
    longest, count = max(len(p[1]) for p in pages), len(pages)
    x = np.zeros((count, longest, len(names)), np.float32)
    y = np.zeros((count, longest), int)
    real = np.zeros((count, longest), bool)
    for i, (blocks, labels) in enumerate(pages):
        for j, features in enumerate(blocks):
            x[i, j, [names[f] for f in features]] = 1
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
    flat = x.reshape(-1, len(names))
    last = real.sum(axis=1) - 1
    at = np.arange(count)
    truth = np.eye(2)[y] * real[..., None]
    params = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for turn in range(1, rounds + 1):
        emit, step, ends = params
        score = (flat @ emit).reshape(count, longest, 2)
        forward, backward = np.zeros((2, count, longest, 2))
        forward[:, 0] = ends[0] + score[:, 0]
        for j in range(1, longest):
            now = np.logaddexp.reduce(forward[:, j - 1, :, None] + step, axis=1) + score[:, j]
            forward[:, j] = np.where(real[:, j, None], now, forward[:, j - 1])
        whole = np.logaddexp.reduce(forward[:, -1] + ends[1], axis=1)
        backward[:, -1] = ends[1]
        for j in range(longest - 2, -1, -1):
            now = np.logaddexp.reduce(step + (score[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(real[:, j + 1, None], now, ends[1])
        belief = np.exp(forward + backward - whole[:, None, None]) * real[..., None]
        pair = forward[:, :-1, :, None] + step + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        pair = np.exp(np.where(real[:, 1:, None, None], pair, -math.inf)).sum(axis=(0, 1))
        seen = np.einsum("ija,ijb->ab", truth[:, :-1], truth[:, 1:])
        gradient = [
            flat.T @ (truth - belief).reshape(-1, 2),
            seen - pair,
            np.stack([(truth - belief)[:, 0].sum(axis=0), (truth - belief)[at, last].sum(axis=0)]),
        ]
        for p, g, (m, v) in zip(params, gradient, memory):
            g = g / count - penalty * p / 10
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return Field(names, *params)


@cache
def trained(pages: int = TRAIN_PAGES) -> Field:
    """The field fitted to ``pages`` labelled pages."""
    made = []
    for seed in range(pages):
        page, labels = labelled_page(seed)
        blocks = [features for _, features in leaf_blocks(page)]
        if len(blocks) == len(labels):
            made.append((blocks, labels))
    return fit(made)


def extract(field: Field, page: str) -> str:
    """The main text of one page: its article blocks, joined by two line feeds."""
    blocks = leaf_blocks(page)
    labels = field.decode([features for _, features in blocks])
    return "\n\n".join(text for (text, _), label in zip(blocks, labels) if label)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    field = trained()

    @F.arrow_udf(StringType())
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([extract(field, (b or b"").decode("utf-8", "replace")) for b in bytes_of(column)], pa.string())

    read = pages.select(cell(id_col).alias("page_id"), cell(url_col).alias("url"), text_of(cell(html_col)).alias("text"))
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
