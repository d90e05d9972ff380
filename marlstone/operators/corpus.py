"""Corpus preparation that is sequential within a document: Markdown from HTML, paragraphs, chunks.

These run as Arrow-batched Python over single rows; nothing is exchanged.  Null texts give nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements without content, and the blocks that are kept.
CHROME = frozenset("script style nav header footer form aside noscript".split())
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre".split())
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
EMPHASIS = re.compile(r"[*_`]+")


class _Blocks(HTMLParser):
    """Blocks in document order; a block inside another gives its text to both, as an unclosed one does to all that follow inside its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.out, self.stack, self.hidden = [], [], [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CHROME:
            self.hidden += 1
        block = None
        if tag in BLOCKS and not self.hidden:
            block = (tag, [])
            self.out.append(block)
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.stack.append((tag, block))

    def handle_endtag(self, tag: str) -> None:
        if tag not in (t for t, _ in self.stack):
            return
        while self.stack:
            t, _ = self.stack.pop()
            if t in CHROME:
                self.hidden -= 1
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if any(t == "title" for t, _ in self.stack) and data:
            self.title.append(data)
        elif not self.hidden and data:
            for _, block in self.stack:
                if block:
                    block[1].append(data)


def markdown(html: str | None) -> str:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    lines = [f"# {' '.join(p.title)}", ""] if p.title else []
    for tag, parts in p.out:
        text = " ".join(parts)
        if text:
            if tag[0] == "h":
                lines += ["#" * int(tag[1]) + " " + text, ""]
            elif tag == "pre":
                lines += ["```", text, "```", ""]
            else:
                lines += [{"li": "- ", "blockquote": "> "}.get(tag, "") + text, ""]
    return "\n".join(lines).strip() + "\n"


def _per_row(df: DataFrame, key: str, col: str, make: Callable[[str | None], list[tuple]], names: list[str], kinds: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *r) for k, t in zip(f[key], f[col], strict=True) for r in make(t)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, col).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {kinds}")


def html_to_markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    return _per_row(pages, key, html, lambda t: [(markdown(t),)], ["markdown"], "markdown string")


def paragraph_stream(text: str | None) -> list[tuple[list[str], str]]:
    """(headings above, paragraph): a heading closes those of its level and below; empty headings count for nothing."""
    stack: list[tuple[int, str]] = []
    out, held = [], []

    def flush() -> None:
        if held:
            out.append(([h for _, h in stack], "\n".join(held).strip()))
            held.clear()

    for line in (text or "").split("\n"):
        m = HEADING.match(line)
        if m:
            flush()
            name = EMPHASIS.sub("", m[2]).strip()
            if name:
                while stack and stack[-1][0] >= len(m[1]):
                    stack.pop()
                stack.append((len(m[1]), name))
        elif line.strip():
            held.append(line)
        else:
            flush()
    flush()
    return out


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    make = lambda t: [(i, " > ".join(h), p) for i, (h, p) in enumerate(paragraph_stream(t))]
    return _per_row(df, key, text, make, ["pos", "heading", "paragraph"], "pos int, heading string, paragraph string")


#: How texts become tokens and back; words here, byte pairs with ``bpe``.
Codec = Callable[[], tuple[Callable[[str], list], Callable[[list], str]]]


def words() -> tuple[Callable[[str], list], Callable[[list], str]]:
    return str.split, " ".join


def bpe(path: str, pattern: str) -> Codec:
    """Byte-pair tokens of a vocabulary file; special strings in a text are text."""

    def load() -> tuple[Callable[[str], list], Callable[[list], str]]:
        if path not in _LOADED:
            import tiktoken
            from tiktoken.load import load_tiktoken_bpe

            _LOADED[path] = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
        return _LOADED[path].encode_ordinary, _LOADED[path].decode

    return load


_LOADED: dict = {}


def pack_paragraphs(stream: list[tuple[list[str], str]], least: int, most: int, overlap: int, codec: Codec = words) -> list[tuple[list[str], str, int]]:
    """(headings, text, tokens) of greedy chunks.

    A paragraph over ``most`` tokens is cut into slices of that many.  A chunk is closed where the headings
    change and it has ``least``, or where the next paragraph would take it over ``most``; the next one
    starts with the closed one's last ``overlap`` tokens if they fit beside that paragraph.
    """
    encode, decode = codec()
    units = []
    for heads, text in stream:
        ids = encode(text)
        pieces = [text] if len(ids) <= most else [decode(ids[i : i + most]) for i in range(0, len(ids), most)]
        units += [(heads, p, len(ids) if len(pieces) == 1 else len(encode(p))) for p in pieces]
    out: list[tuple[list[str], str, int]] = []
    texts: list[str] = []
    heads_now, size = None, 0
    for heads, text, n in units:
        turned = heads_now is not None and heads != heads_now and size >= least
        if texts and (turned or size + n > most):
            whole = "\n\n".join(texts)
            ids = encode(whole)
            out.append((heads_now or [], whole, len(ids)))
            tail = ids[-overlap:] if overlap else []
            fits = bool(tail) and len(tail) + n <= most
            texts, size, heads_now = ([decode(tail)], len(tail), None) if fits else ([], 0, None)
        heads_now = heads if heads_now is None else heads_now
        texts.append(text)
        size += n
    if texts:
        whole = "\n\n".join(texts)
        out.append((heads_now or [], whole, len(encode(whole))))
    return out


def pack(df: DataFrame, key: str, text: str, least: int = 500, most: int = 800, overlap: int = 100, codec: Codec = words) -> DataFrame:
    """(key, ordinal, heading, text, token_count): the chunks of each Markdown text."""
    make = lambda t: [(i, " > ".join(h), c, n) for i, (h, c, n) in enumerate(pack_paragraphs(paragraph_stream(t), least, most, overlap, codec))]
    return _per_row(df, key, text, make, ["ordinal", "heading", "text", "token_count"], "ordinal int, heading string, text string, token_count int")
