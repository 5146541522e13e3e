"""Content markup as Markdown, block by block; every link keeps its address."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dom import Node, parse
from .slices import parts

#: Fixed values of HTML: elements that are blocks of their own, and those without text.
BLOCK = frozenset("address article aside blockquote body div dd dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table tbody td th thead tr ul hr".split())
SILENT = frozenset("script style noscript template head title !comment".split())


def _inline(n: Node, done: dict[int, str]) -> str:
    """An element that holds no block, given its children's text."""
    if n.tag in SILENT:
        return ""
    if n.tag == "br":
        return "\n"
    if n.tag == "img":
        src = n.attrs.get("src", "")
        return f"![{n.attrs.get('alt', '')}]({src})" if src and not src.startswith("data:") else ""
    text = "".join(re.sub(r"\s+", " ", c) if isinstance(c, str) else done.pop(id(c)) for c in n.children)
    core = text.strip()
    if not core:
        return " " if text else ""
    edge = lambda s: (s[: len(s) - len(s.lstrip())], s[len(s.rstrip()) :])
    a, b = edge(text)
    mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}.get(n.tag)
    if mark:
        return f"{a}{mark}{core}{mark}{b}"
    if n.tag == "a" and n.attrs.get("href"):
        return f"{a}[{core}]({n.attrs['href']}){b}"
    return text


def _blocks(n: Node, inline: dict[int, str], blocks: dict[int, list[str]]) -> list[str]:
    """The blocks of an element, given those of its children and the text of children that hold none."""
    out, run = [], []

    def flush() -> None:
        text = "\n".join(" ".join(line.split(" ")).strip() for line in re.sub(r" +", " ", "".join(run)).split("\n")).strip()
        run.clear()
        if text:
            out.append(text)

    for c in n.children:
        if isinstance(c, str):
            run.append(re.sub(r"\s+", " ", c))
            continue
        if id(c) in inline:
            run.append(inline.pop(id(c)))
            continue
        flush()
        within = blocks[id(c)]
        if c.tag == "hr":
            out.append("---")
        elif c.tag == "pre":
            out.append("```\n" + c.text().strip("\n") + "\n```")
        elif c.tag in ("ul", "ol"):
            items = [blocks[id(i)] for i in c.children if isinstance(i, Node) and i.tag == "li"]
            lines = [(f"{k}. " if c.tag == "ol" else "- ") + "\n".join(i).replace("\n", "\n    ") for k, i in enumerate(items, 1)]
            out += ["\n".join(lines)] if lines else []
        elif c.tag == "blockquote":
            inner = "\n\n".join(within)
            out += ["\n".join(("> " + line).rstrip() for line in inner.split("\n"))] if inner else []
        elif c.tag == "tr":
            cells = [" ".join(" ".join(blocks[id(x)]).split()) for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")]
            out += ["| " + " | ".join(cells) + " |"] if any(cells) else []
        elif re.fullmatch("h[1-6]", c.tag):
            text = " ".join(" ".join(within).split())
            out += ["#" * int(c.tag[1]) + " " + text] if text else []
        elif c.tag not in SILENT:
            out += within
    flush()
    return out


def to_markdown(markup: str) -> str:
    """Paragraphs, headings, lists, quotes, tables and code, parted by blank lines.

    Elements are put together from the innermost outwards, so markup may be nested to any depth.
    """
    root = parse(markup)
    inline: dict[int, str] = {}
    blocks: dict[int, list[str]] = {}
    for n in reversed([root, *root.walk()]):
        if n is root or n.tag in BLOCK or any(isinstance(c, Node) and id(c) in blocks for c in n.children):
            blocks[id(n)] = _blocks(n, inline, blocks)
        else:
            inline[id(n)] = _inline(n, inline)
    return "\n\n".join(blocks[id(root)])


def _converted(markup: str | None) -> tuple[str | None, str]:
    try:
        return (None if markup is None else to_markdown(markup)), ""
    except Exception as e:  # a fault of one document is that document's alone
        return None, f"{type(e).__name__}: {e}"


@F.arrow_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("error", T.StringType())]))
def converted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Vectorised: :func:`to_markdown`, or why there is none; null stays null."""
    for html in batches:
        for (texts,) in parts(html):
            yield pa.array([dict(zip(("body", "error"), _converted(h))) for h in texts], pa.struct({"body": pa.string(), "error": pa.string()}))


def markdown(html: Column | str) -> Column:
    """The Markdown alone, null where there is none."""
    return converted(html)["body"]
