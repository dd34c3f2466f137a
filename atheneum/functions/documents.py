"""Functions on whole documents that no column expression can say: chunking, section edits, Markdown."""

from __future__ import annotations

import hashlib
import html as html_lib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL, LARGE, OVERLAP = 50, 1200, 150
CHUNK_VERSION = 5
_PIECE = re.compile(r"<([^<>]*)>|<[^<>]*\Z|<[^<>]*(?=<)|([^<>]+)|>")
_SPACES = re.compile(r"\s+")


def normalize(text: str) -> str:
    return _SPACES.sub(lambda m: "\n" if m[0][0] == "\n" else " ", text)


def split_overlapping(text: str | None, most: int = LARGE, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed into parts of at most ``most`` bytes; a part begins with the paragraphs that ended the one before, up to ``overlap`` bytes. No parts of a null text."""
    if text is None:
        return []
    size = lambda s: len(s.encode())
    parts: list[str] = []
    held: list[str] = []
    fresh = 0  # how many of the held paragraphs were not carried over
    for p in text.split("\n\n"):
        if held and size("\n\n".join(held)) + size(p) + 2 > most and any(held):
            parts.append("\n\n".join(held))
            carried: list[str] = []
            for q in reversed(held[len(held) - fresh :]):
                if size("\n\n".join([q, *carried])) > overlap:
                    break
                carried.insert(0, q)
            held, fresh = carried, 0
        held.append(p)
        fresh += 1
    if any(held):
        parts.append("\n\n".join(held))
    return parts


def chunk_html(html: str | None, page_name: str | None = None, paragraph_aware: bool = False) -> list[tuple[int, str, str, str]]:
    """(index, heading path, content, hash) of a page's chunks.

    Headings of level 1 to 3 begin a chunk and give its path; the first h1 that repeats the page's name does not. Chunks under 50 bytes are added to
    the one before; those over 1200 are split at blank lines, which only merging puts in unless ``paragraph_aware`` keeps those of the text.
    """
    found: list[tuple[str, str]] = []
    path: list[tuple[int, str]] = []
    body: list[str] = []
    heading: list[str] | None = None
    level, title_seen, begun = 0, False, False

    def close() -> None:
        found.append((" > ".join(t for _, t in path), "".join(body)))
        body.clear()

    for m in _PIECE.finditer(html or ""):
        if m[2] is not None:
            (body if heading is None else heading).append(m[2])
            continue
        # A ``>`` outside a tag ends an empty one; a tag that is never closed is dropped with all that follows in it.
        if m[1] is None:
            continue
        tag = m[1].strip().lower()
        name = tag.split()[0] if tag.split() else ""
        if name in ("h1", "h2", "h3"):
            if "".join(body).strip() or begun:
                close()
                begun = True
            heading, level = [], int(name[1])
        elif tag in ("/h1", "/h2", "/h3"):
            if heading is not None:
                text, heading = "".join(heading).strip(), None
                fold = lambda s: re.sub("[A-Z]", lambda c: c[0].lower(), s)
                if not title_seen and level == 1 and page_name is not None and fold(text) == fold(page_name.strip()):
                    title_seen = True
                    continue
                path[:] = [x for x in path if x[0] < level] + [(level, text)]
        elif tag.startswith("/") or tag.endswith("/"):
            (body if heading is None else heading).append(" ")
    close()
    merged: list[list[str]] = []
    for where, text in found:
        clean = "\n\n".join(filter(None, map(str.strip, map(normalize, re.split(r"\n\s*\n", text.strip()))))) if paragraph_aware else normalize(text.strip())
        if not clean:
            continue
        if merged and len(clean.encode()) < SMALL:
            merged[-1][1] += "\n\n" + clean
        else:
            merged.append([where, clean])
    out = []
    for where, text in merged:
        for part in split_overlapping(text) if len(text.encode()) > LARGE else [text]:
            whole = f"{where}\n\n{part}" if where else part
            out.append((len(out), where, whole, hashlib.sha256(whole.encode()).hexdigest()))
    return out


#: The white space that is trimmed.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _title(text: str) -> str:
    """What headings are compared by: no leading ``#``, no white space at the ends, A-Z in lower case."""
    return text.lstrip("#").strip(WHITE).translate(_FOLD)


def replace_section_markdown(body: str | None, heading: str | None, put: str | None) -> str | None:
    """The lines from the first that says ``heading`` to the next heading of its level or higher, replaced by that line and ``put``; None if no line says so or anything is null.

    ``put`` follows at once and is always ended; a blank line comes before what is left. Under a line that is no heading all goes to the end.
    """
    if body is None or heading is None or put is None:
        return None
    lines = re.split("\r?\n", body)
    if lines[-1] == "":
        lines.pop()
    depth = lambda x: len(x) - len(x.lstrip("#"))
    said = [i for i, x in enumerate(lines) if _title(x) == _title(heading)][:1]
    if not said:
        return None
    start, own = said[0], depth(lines[said[0]])
    rest = next((lines[i:] for i in range(start + 1, len(lines)) if 0 < depth(lines[i]) <= own), None)
    return "\n".join([*lines[: start + 1], put, *([""] if rest is None else ["", *rest])])


def replace_section_html(body: str | None, heading: str | None, put: str | None) -> str | None:
    """As for Markdown, over ``<h1`` to ``<h6`` tags: ``put`` on lines of its own between the first heading that says so and the next of its level or higher."""
    if body is None or heading is None or put is None:
        return None
    for m in re.finditer("<h([1-6])", body):
        close = f"</h{m[1]}>"
        at = body.find(close, m.start())
        if at < 0 or re.sub("<[^>]*>?", "", body[m.start() : at]).replace(">", "").strip(WHITE).translate(_FOLD) != _title(heading):
            continue
        head = at + len(close)
        rest = next((n.start() for n in re.finditer("<h([1-6])", body[head:]) if n[1] <= m[1]), len(body) - head)
        return f"{body[:head]}\n{put}\n{body[head + rest :]}"
    return None


def _inline(s: str) -> str:
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(f"<code>{html_lib.escape(m[1], quote=False)}</code>")
        return f"\0{len(held) - 1}\0"

    s = html_lib.escape(re.sub(r"`([^`]+)`", hold, s), quote=False)
    s = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img src="\2" alt="\1" />', s)
    s = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', s)
    s = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", s)
    s = re.sub(r"(?<![\w*])\*(?!\s)(.+?)(?<!\s)\*(?!\w)", r"<em>\1</em>", s)
    s = re.sub(r"~~(.+?)~~", r"<del>\1</del>", s)
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], s)


def markdown_to_html(text: str | None) -> str:
    """The common part of Markdown: headings, paragraphs, lists (with tasks), quotes, fences, rules, tables, and inline marks."""
    lines, out, i = (text or "").split("\n"), [], 0
    item = re.compile(r"^\s*(?:([-*+])|(\d+)[.)])\s+(.*)$")
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := re.match(r"^(`{3,}|~{3,})\s*(\S*)", line):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].startswith(m[1])), len(lines))
            kind = f' class="language-{m[2]}"' if m[2] else ""
            out.append(f"<pre><code{kind}>" + html_lib.escape("".join(x + "\n" for x in lines[i + 1 : end]), quote=False) + "</code></pre>")
            i = end + 1
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
            i += 1
        elif re.match(r"^\s*([-*_])(?:\s*\1){2,}\s*$", line):
            out.append("<hr />")
            i += 1
        elif line.startswith(">"):
            end = next((k for k in range(i, len(lines)) if not lines[k].startswith(">")), len(lines))
            out.append("<blockquote>\n" + markdown_to_html("\n".join(x[1:].removeprefix(" ") for x in lines[i:end])) + "</blockquote>")
            i = end
        elif m := item.match(line):
            kind, items = "ul" if m[1] else "ol", []
            while i < len(lines) and (m := item.match(lines[i])) and bool(m[1]) == (kind == "ul"):
                task = re.match(r"^\[([ xX])\]\s+(.*)$", m[3])
                box = f'<input disabled="" type="checkbox"{" checked=" + chr(34) * 2 if task[1] != " " else ""}/>\n' if task else ""
                items.append(f"<li>{box}{_inline(task[2] if task else m[3])}</li>")
                i += 1
            out.append(f"<{kind}>\n" + "\n".join(items) + f"\n</{kind}>")
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
            cells = lambda x: [_inline(c.strip()) for c in x.strip().strip("|").split("|")]
            end = next((k for k in range(i + 2, len(lines)) if "|" not in lines[k]), len(lines))
            head = "".join(f"<th>{c}</th>" for c in cells(line))
            rows = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in cells(x)) + "</tr>\n" for x in lines[i + 2 : end])
            out.append(f"<table><thead><tr>{head}</tr></thead><tbody>\n{rows}</tbody></table>")
            i = end
        else:
            end = next((k for k in range(i + 1, len(lines)) if not lines[k].strip() or re.match(r"^(#{1,6}\s|>|`{3,})", lines[k])), len(lines))
            out.append("<p>" + _inline("\n".join(x.strip() for x in lines[i:end])) + "</p>")
            i = end
    return "".join(x + "\n" for x in out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_column(texts: pd.Series) -> pd.Series:
    """The parts of ``split_overlapping``."""
    return texts.map(split_overlapping)


@F.pandas_udf(T.StringType())
def markdown_column(texts: pd.Series) -> pd.Series:
    """Markdown as HTML; a null text is empty."""
    return texts.map(markdown_to_html)


@F.pandas_udf(T.StringType())
def replace_section(editor: pd.Series, body: pd.Series, heading: pd.Series, put: pd.Series) -> pd.Series:
    """The section's new text by the page's editor: ``put`` (Markdown) as it is, or as HTML; null where no heading says so."""
    edit = lambda e, b, h, p: replace_section_markdown(b, h, p) if e == "markdown" else replace_section_html(b, h, markdown_to_html(p))
    return pd.Series([edit(*row) for row in zip(editor, body, heading, put, strict=True)], dtype=object)


CHUNKS = "array<struct<chunk_index: int, heading_path: string, content: string, content_hash: string>>"


def chunk_pages(pages: DataFrame, html_col: str = "html", name_col: str | None = None) -> DataFrame:
    """(page_id, chunk_index, heading_path, content, content_hash)."""

    @F.pandas_udf(CHUNKS)
    def chunked(html: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("chunk_index", "heading_path", "content", "content_hash"), c, strict=True)) for c in chunk_html(h, n)] for h, n in zip(html, name, strict=True)])

    name = F.col(name_col) if name_col else F.lit(None).cast("string")
    return pages.select("page_id", F.explode(chunked(F.col(html_col), name)).alias("c")).select("page_id", "c.*")
