"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: runs of text between the borders of block
elements, each with its ancestors.  Features of a block are its ancestors'
tags, classes and ids and the shape of its text.  The field scores a label
(main text or not) per block and each pair of neighbouring labels; Viterbi
gives the best sequence.  Its weights are learned on labelled pages by
gradient steps on the conditional likelihood (forward-backward in numpy).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeweave.llm.labelled_pages import labelled_pages
from lodeweave.workspace import ship

#: Labelled pages the field is trained on, passes over them, step and penalty.
PAGES, EPOCHS, RATE, PENALTY, SEED = 600, 6, 0.5, 1e-4, 3
BUCKETS = 1 << 14

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<![^>]*>|<\?[^>]*>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
#: Elements whose content is no markup: it ends at their end tag only.
_RAW = frozenset("script style textarea title".split())
#: Further elements whose content is not text of the page.
_NO_TEXT = frozenset("noscript template textarea title select datalist option button iframe svg object canvas audio video annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Those of them that stay within the block around them: a formula's source, which is not shown.
_NOTES = frozenset({"annotation", "annotation-xml"})
#: Elements that stay within the block around them.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr "
    "munder munderover none semantics".split()
)
#: Open elements that a start tag of the key closes.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Start tags that close an element of ``_NO_TEXT`` whose own end tag is missing.
_BLOCKS = _ENDS_P | frozenset("body dd dt li tbody td tfoot th thead tr".split())


@dataclass
class Block:
    """A leaf block: its text, its ancestors from the root (tag and names), characters inside links, and inline tags."""

    text: str
    path: tuple[tuple[str, str], ...]
    linked: int
    inline: frozenset[str]


def _names(attributes: str) -> str:
    return " ".join(v.strip("\"'").lower() for _, v in _NAMED.findall(attributes)) if "=" in attributes else ""


def _tokens(html: str) -> list[tuple[str, bool, str, str]]:
    """(text before, is an end tag, tag, attributes) of each tag, with an empty tag at the end of the page."""
    out, text, endless = [], [], set()
    at, size, last = 0, len(html), html.rfind(">")
    while at < size:
        # Beyond the last ">" only a comment can begin, and it would be the last one.
        m = _MARKUP.search(html, at) if at <= last or "<!--" in html[at:] else None
        if m is None:
            text.append(html[at:])
            break
        text.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        out.append(("".join(text), bool(m[1]), tag, m[3]))
        text.clear()
        if tag in _RAW and not m[1] and not m[3].rstrip().endswith("/"):
            end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            if end:
                at = end.end()
                out.append(("", True, tag, ""))
            elif tag in ("script", "style"):
                at = size
            else:
                endless.add(tag)
    out.append(("".join(text), False, "", ""))
    return out


def _without_end(tokens: list[tuple[str, bool, str, str]]) -> set[int]:
    """Places of the start tags of ``_NO_TEXT`` that no end tag belongs to."""
    open_: dict[str, list[int]] = {tag: [] for tag in _NO_TEXT}
    for k, (_, ends, tag, attributes) in enumerate(tokens):
        if tag in open_:
            if not ends:
                if not attributes.rstrip().endswith("/"):
                    open_[tag].append(k)
            elif open_[tag]:
                open_[tag].pop()
    return {k for places in open_.values() for k in places}


def leaf_blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in order; broken markup closes what is open.

    Character references are decoded after the markup is cut, so an escaped
    ``<`` is text.  White space inside a block is one space, ends trimmed;
    blocks without text are not returned.  What is no text of the page ends
    with its element or an element around it; without an end tag of its own
    also where the next block begins.
    """
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    hidden: list[tuple[int, bool]] = []  # place on the stack of each element of _NO_TEXT, and whether its end tag is missing
    runs: list[str] = []
    links, linked, inline = 0, 0, set()

    def close() -> None:
        nonlocal linked
        if runs:
            text = " ".join(entities.unescape("".join(runs)).split())
            if text:
                found.append(Block(text, tuple(stack), linked, frozenset(inline)))
            runs.clear()
        linked = 0
        inline.clear()

    def text_run(part: str) -> None:
        nonlocal linked
        if part and not hidden:
            runs.append(part)
            if links:
                linked += len(part)

    tokens = _tokens(html)
    endless = _without_end(tokens)
    for k, (before, ends, tag, attributes) in enumerate(tokens):
        text_run(before)
        if not tag or tag in ("script", "style"):
            continue
        if ends:
            if tag in _INLINE:
                if tag == "a" and links:
                    links -= 1
                continue
            if tag not in _NOTES:
                close()
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            while hidden and hidden[-1][0] >= len(stack):
                hidden.pop()
            if tag not in _NO_TEXT:
                links = 0
            continue
        if tag == "br":
            text_run("\n")
            continue
        if tag in _INLINE:
            if not hidden:
                inline.add(tag)
                links += tag == "a"
            continue
        if tag not in _NOTES:
            close()
        if tag in _BLOCKS:
            while hidden and hidden[-1][1]:
                del stack[hidden.pop()[0] :]
        if tag in _CLOSES:
            while stack and stack[-1][0] in _CLOSES[tag]:
                stack.pop()
        if tag in _ENDS_P:
            while stack and stack[-1][0] == "p":
                stack.pop()
        while hidden and hidden[-1][0] >= len(stack):
            hidden.pop()
        if tag not in _VOID and not attributes.rstrip().endswith("/"):
            if tag in _NO_TEXT:
                hidden.append((len(stack), k in endless))
            stack.append((tag, _names(attributes)))
    close()
    return found


def _bin(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


@lru_cache(maxsize=50_000)
def _path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    out = set()
    for depth, (tag, names) in enumerate(reversed(path)):
        out.add(f"in:{tag}")
        if depth < 3:
            out.add(f"up{depth}:{tag}")
        for part in _PARTS.findall(names):
            out.add(f"name:{part}")
            if len(part) > 4:
                out.add(f"name:{part[:4]}*")
    if len(path) > 1:
        out.add(f"pair:{path[-2][0]}/{path[-1][0]}")
    return tuple(out)


def features(blocks: list[Block]) -> list[list[int]]:
    """Hashed features of each block."""
    out = []
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        density = _bin(b.linked / n, (0.01, 0.3, 0.7, 0.95))
        own = [
            f"words:{_bin(words, (2, 4, 8, 16, 40))}", f"links:{density}", f"links:{density}words:{_bin(words, (4, 16))}",
            f"end:{b.text[-1] if not b.text[-1].isalnum() else 'a'}", f"copy:{'©' in b.text}", f"first:{i == 0}", f"last:{i == len(blocks) - 1}", "any",
        ]
        own += [f"inline:{t}" for t in b.inline]
        out.append([crc32(f.encode("utf-8", "replace")) % BUCKETS for f in (*own, *_path_features(b.path))])
    return out


@dataclass
class Field:
    """Weights: per feature the margin of label 1, per pair of neighbouring labels a score, per first label a score."""

    weight: np.ndarray
    pair: np.ndarray
    start: np.ndarray

    def emissions(self, ids: list[list[int]]) -> np.ndarray:
        return np.array([[0.0, self.weight[row].sum()] for row in ids])

    def viterbi(self, ids: list[list[int]]) -> list[int]:
        """The best labels; of equal scores label 0."""
        if not ids:
            return []
        emit, pair = self.emissions(ids).tolist(), self.pair.tolist()
        a, b = self.start[0] + emit[0][0], self.start[1] + emit[0][1]
        back = []
        for e0, e1 in emit[1:]:
            to0 = (a + pair[0][0], b + pair[1][0])
            to1 = (a + pair[0][1], b + pair[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            a, b = max(to0) + e0, max(to1) + e1
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels and of neighbouring pairs, by forward-backward in log space."""
        n = len(emit)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = self.start + emit[0]
        for t in range(1, n):
            forward[t] = np.logaddexp(forward[t - 1, 0] + self.pair[0], forward[t - 1, 1] + self.pair[1]) + emit[t]
        for t in range(n - 2, -1, -1):
            ahead = emit[t + 1] + backward[t + 1]
            backward[t] = np.logaddexp(self.pair[:, 0] + ahead[0], self.pair[:, 1] + ahead[1])
        total = np.logaddexp(*forward[-1])
        single = np.exp(forward + backward - total)
        pairs = np.exp(forward[:-1, :, None] + self.pair[None] + (emit[1:] + backward[1:])[:, None, :] - total)
        return single, pairs


def train(pages: list[tuple[str, list[int]]], epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY, seed: int = SEED) -> Field:
    """Learn a field from (html, label of each leaf block).  Pages whose blocks and labels don't align raise ValueError."""
    field = Field(np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2))
    ready = []
    for html, labels in pages:
        ids = features(leaf_blocks(html))
        if len(ids) != len(labels):
            raise ValueError("a labelled page has other blocks than labels")
        if ids:
            ready.append((ids, np.array(labels)))
    squares = np.full(BUCKETS, 1e-2)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in rng.permutation(len(ready)):
            ids, labels = ready[k]
            single, pairs = field.marginals(field.emissions(ids))
            step = rate / (1 + epoch)
            flat = np.concatenate([np.array(row) for row in ids])
            error = np.repeat(labels - single[:, 1], [len(row) for row in ids])
            grad = np.bincount(flat, error, BUCKETS)
            touched = np.unique(flat)
            squares[touched] += grad[touched] ** 2
            field.weight[touched] += step * (grad[touched] / np.sqrt(squares[touched]) - penalty * field.weight[touched])
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            field.pair += 0.05 * step * (seen - pairs.sum(axis=0)) / max(1, len(ids) - 1)
            first = np.zeros(2)
            first[labels[0]] = 1
            field.start += 0.05 * step * (first - single[0])
    return field


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages(PAGES))


def main_text(html: str | None, field: Field) -> str:
    """Main blocks joined by one space."""
    blocks = leaf_blocks(html or "")
    return " ".join(b.text for b, label in zip(blocks, field.viterbi(features(blocks)), strict=True) if label)


def extract_text(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` with its html replaced by ``text``, the main text; all other columns stay.

    Null and empty html and pages without a main block give an empty text.
    Each row is read by itself, so repeated rows repeat their text.  A column
    that is already named ``text`` is replaced.
    """
    field = default_field() if field is None else field
    sent = pages.sparkSession.sparkContext.broadcast((field.weight, field.pair, field.start))  # BUCKETS numbers
    names = [c for c in pages.columns if c not in (html_col, "text")]
    source = pages.select(*(f"`{c}`" for c in names), html_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        for batch in batches:
            texts = [main_text(value.as_py(), own) for value in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    ship(pages.sparkSession)
    return source.mapInArrow(run, f"{fields}, text string" if fields else "text string")
