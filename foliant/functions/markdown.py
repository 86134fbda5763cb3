"""Markdown to HTML (K3, K4, K15): headings, paragraphs, lists, quotes, code, tables and rules as blocks; then code, links, emphasis and breaks within a line.

A small helper for one text at a time. What comes out is not safe by itself: the sanitiser decides which tags, attributes and links stay."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SHOWN_ATTRIBUTES, SHOWN_TAGS, sanitized

_FENCE, _HEADING, _RULE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$"), re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?\s*#*\s*$"), re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
_UNDERLINE, _QUOTE = re.compile(r"^ {0,3}(=+|-+)\s*$"), re.compile(r"^ {0,3}> ?(.*)$")
_ITEM = re.compile(r"^( {0,3})([*+-]|\d{1,9}[.)])(\s+)(.*)$")
_DASHES = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_RAW = re.compile(r"^ {0,3}</?(?:address|article|aside|blockquote|details|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|iframe|main|nav|ol|p|pre|script|section|style|table|ul)\b", re.I)
_CODE, _ESCAPED = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S), re.compile(r"\\([\\`*_{}\[\]()#+\-.!>|~])")
_ADDRESS, _TAG = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>"), re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_LINK = re.compile(r"(!?)\[([^\[\]]*)\]\(\s*(?:<([^<>\n]*)>|([^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*))(?:\s+(?:\"([^\"]*)\"|'([^']*)'))?\s*\)")
_STRONG, _EMPHASIS = re.compile(r"(\*\*)(?=\S)(.+?)(?<=\S)\*\*|(?<!\w)(__)(?=\S)(.+?)(?<=\S)__(?!\w)", re.S), re.compile(r"(\*)(?=[^\s*])(.+?)(?<=\S)\*|(?<!\w)(_)(?=[^\s_])(.+?)(?<=\S)_(?!\w)", re.S)


def inline(text: str) -> str:
    """Markup within a block. What is settled (code, tags, links' heads) is put aside, so that later patterns don't see into it."""
    aside: list[str] = []

    def keep(piece: str) -> str:
        aside.append(piece)
        return f"\x02{len(aside) - 1}\x03"

    def link(m: re.Match) -> str:
        target, title = m[3] or m[4] or "", m[5] or m[6]
        more = f' title="{html.escape(title)}"' if title else ""
        return keep("") if m[1] else keep(f'<a href="{html.escape(target)}"{more}>') + m[2] + keep("</a>")

    text = text.replace("\x02", "").replace("\x03", "")
    text = _CODE.sub(lambda m: keep(f"<code>{html.escape(m[2].strip(), quote=False)}</code>"), text)
    text = _ESCAPED.sub(lambda m: keep(html.escape(m[1], quote=False)), text)
    text = _ADDRESS.sub(lambda m: keep(f'<a href="{"" if ":" in m[1] else "mailto:"}{html.escape(m[1])}">{html.escape(m[1])}</a>'), text)
    text = _TAG.sub(lambda m: keep(m[0]), text)
    text = _LINK.sub(link, text)
    text = re.sub(r"&(?!#?\w+;)", "&amp;", text).replace("<", "&lt;")
    text = _STRONG.sub(lambda m: f"<strong>{m[2] or m[4]}</strong>", text)
    text = _EMPHASIS.sub(lambda m: f"<em>{m[2] or m[4]}</em>", text)
    text = re.sub(r" {2,}\n|\\\n", "<br>\n", text)
    while "\x02" in text:
        text = re.sub("\x02(\\d+)\x03", lambda m: aside[int(m[1])], text)
    return text


def _cells(line: str) -> list[str]:
    row = re.sub(r"(?<!\\)\|\s*$", "", re.sub(r"^\s*\|", "", line))
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row)]


def _table(lines: list[str]) -> str:
    heads = _cells(lines[0])
    row = lambda tag, cells: "<tr>\n" + "".join(f"<{tag}>{inline(c)}</{tag}>\n" for c in cells) + "</tr>\n"
    fit = lambda cells: (cells + [""] * len(heads))[: len(heads)]
    return "<table>\n<thead>\n" + row("th", heads) + "</thead>\n<tbody>\n" + "".join(row("td", fit(_cells(x))) for x in lines[2:]) + "</tbody>\n</table>"


def _taken(lines: list[str], i: int, more: Callable[[str], bool]) -> int:
    while i < len(lines) and more(lines[i]):
        i += 1
    return i


def _starts(line: str) -> bool:
    """Whether a line ends a paragraph before it."""
    return bool(not line.strip() or _FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or _RAW.match(line))


def _list(lines: list[str], i: int) -> tuple[str, int]:
    """A list and the line after it: items of one kind, each with the lines indented under it."""
    first = _ITEM.match(lines[i])
    ordered, items, loose = first[2][-1] in ".)", [], False
    while i < len(lines) and (m := _ITEM.match(lines[i])) and (m[2][-1] in ".)") == ordered and not _RULE.match(lines[i]):
        indent, own = len(m[1]) + len(m[2]) + min(len(m[3]), 4), [m[4]]
        i += 1
        while i < len(lines):
            line = lines[i]
            if line.strip():
                depth = len(line) - len(line.lstrip(" "))
                if depth >= min(indent, 4) or depth >= 2 and own[-1] != "" and not _ITEM.match(line):
                    own.append(line[min(depth, indent) :])
                elif own[-1] == "" or _ITEM.match(line) or _starts(line):
                    break
                else:
                    own.append(line.strip())
            else:
                own.append("")
            i += 1
        trailing = own[-1] == ""
        while own and own[-1] == "":
            own.pop()
        again = _ITEM.match(lines[i]) if i < len(lines) else None
        loose |= "" in own or bool(trailing and again and (again[2][-1] in ".)") == ordered)
        items.append(own)
    body = []
    for own in items:
        inner = blocks(own, True)
        if not loose and inner and inner[0].startswith("<p>"):
            inner[0] = inner[0][3:-4]
        text = "\n".join(inner)
        body.append(f"<li>\n{text}\n</li>" if loose else f"<li>{text}{chr(10) if len(inner) > 1 else ''}</li>")
    tag = "ol" if ordered else "ul"
    return f"<{tag}>\n" + "\n".join(body) + f"\n</{tag}>", i


def blocks(lines: list[str], inside_list: bool = False) -> list[str]:
    """HTML of each block. Within an item of a list, another list may follow a paragraph at once."""
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _FENCE.match(line):
            end = _taken(lines, i + 1, lambda x, m=m: not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", x))
            out.append("<pre><code>" + html.escape("".join(x + "\n" for x in lines[i + 1 : end]), quote=False) + "</code></pre>")
            i = end + 1
        elif m := _HEADING.match(line):
            out.append(f"<h{len(m[1])}>{inline((m[2] or '').strip())}</h{len(m[1])}>")
            i += 1
        elif _RULE.match(line):
            out.append("<hr>")
            i += 1
        elif "|" in line and i + 1 < len(lines) and _DASHES.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            end = _taken(lines, i + 2, lambda x: "|" in x and x.strip() != "")
            out.append(_table(lines[i:end]))
            i = end
        elif _QUOTE.match(line):
            end = _taken(lines, i, lambda x: bool(_QUOTE.match(x)) or not _starts(x))
            out.append("<blockquote>\n" + "\n".join(blocks([m[1] if (m := _QUOTE.match(x)) else x for x in lines[i:end]])) + "\n</blockquote>")
            i = end
        elif _ITEM.match(line):
            piece, i = _list(lines, i)
            out.append(piece)
        elif line.startswith("    "):
            end = _taken(lines, i, lambda x: x.startswith("    ") or not x.strip())
            out.append("<pre><code>" + html.escape("\n".join(x[4:] for x in lines[i:end]).rstrip() + "\n", quote=False) + "</code></pre>")
            i = end
        elif _RAW.match(line):
            end = _taken(lines, i, lambda x: bool(x.strip()))
            out.append("\n".join(lines[i:end]))
            i = end
        else:
            end = _taken(lines, i + 1, lambda x: not _starts(x) and not _UNDERLINE.match(x) and not (inside_list and _ITEM.match(x)))
            text = inline("\n".join(x.lstrip() for x in lines[i:end]).rstrip())
            if end < len(lines) and (m := _UNDERLINE.match(lines[end])):
                level = 1 if m[1][0] == "=" else 2
                out.append(f"<h{level}>{text}</h{level}>")
                end += 1
            else:
                out.append(f"<p>{text}</p>")
            i = end
    return out


def rendered(text: str) -> str:
    return "\n".join(blocks(text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")))


@F.pandas_udf(T.StringType())
def markdown_html(value: pd.Series) -> pd.Series:
    """A safe fragment of HTML from Markdown (K3)."""
    return pd.Series([None if v is None else sanitized(rendered(v)) for v in value], dtype=object)


@F.pandas_udf(T.StringType())
def shown_html(value: pd.Series) -> pd.Series:
    """The same with only the tags that are shown within a page."""
    return pd.Series([None if v is None else sanitized(rendered(v), SHOWN_TAGS, SHOWN_ATTRIBUTES) for v in value], dtype=object)
