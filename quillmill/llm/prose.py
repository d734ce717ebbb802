"""The prose of a Markdown text: what is left without frontmatter, code, tables, addresses and markup."""

from __future__ import annotations

import html
import re
import unicodedata

FRONT = re.compile(r"\A[\s﻿]*---\s.*?(?:\n---|\s---)(?=\s|$)\s*", re.S)
# line patterns begin with the line break before them, so that the search runs from one break to the next
FENCE = re.compile(r"\n[ \t>]{0,6}(`{3,}|~{3,}).*?(?:\n[ \t>]{0,6}\1[`~]*[ \t]*(?=\n|\Z)|\Z)", re.S)
INLINE = re.compile(r"(`+)[^`\n]*\1")
TABLE = re.compile(r"\n[ \t]*\|[^\n]*")
LINK = re.compile(r"!?\[\[[^\]\n]*\]\]|\]\([^)\s]*\)")
ADDRESS = re.compile(r"\b(?:https?://|www\.)\S+|(?<![^\s@])[^\s@]++@[^\s@.]++\.[^\s@]++")
MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]*+>|<!--.*?-->", re.S)
TAG = re.compile(r"#(?<![\w/]#)[\w/-]+")
#: Characters that do not show (soft hyphen, zero-width spaces and joiners, marks of direction and order).
HIDDEN = ("\u00ad", "\u200b", "\u200c", "\u200d", "\u200e", "\u200f", "\u2060", "\ufeff")
#: Stands for a line break where texts are cut at white space; ends of sentences as tokens show them.
BREAK = "¶"
#: Marks the line of a heading.
OVER = "§"
END = re.compile(r"[.!?…][\"'»”’)\]*_]*$|^[-–/|¶]$")
WORD = re.compile(r"[^\W\d_]+")
#: A line that begins as a heading and goes on after the end of a sentence is a paragraph that lost its line break.
HEADING_LINE = re.compile(r"\n[ \t]*#{1,6}[ \t]+((?:(?![.!?…][\"'»”’)\]]*[ \t]+\S)[^\n])++)(?=\n|\Z)")


def plain(text: str) -> str:
    """``text`` with everything that is no prose taken out, after a line break; line breaks stay."""
    if "---" in text:
        text = FRONT.sub("", text, count=1)
    text = "\n" + text
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    if "`" in text:
        text = INLINE.sub(" ", text)
    if "|" in text:
        text = TABLE.sub("", text)
    if "[" in text:
        text = LINK.sub(" ", text)
    if "http" in text or "www." in text or "@" in text:
        text = ADDRESS.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = MARKUP.sub(" ", text)
    if not text.isascii():
        for c in HIDDEN:
            if c in text:
                text = text.replace(c, "")
        text = unicodedata.normalize("NFC", text)
    return text


def prose(text: str) -> str:
    """The lower-cased prose without headings and tags."""
    text = plain(text)
    if "#" in text:
        text = TAG.sub(" ", HEADING_LINE.sub("", text))
    return text.lower()


def sectioned(text: str) -> str:
    """The lower-cased prose in which each heading stands on a line of its own after OVER."""
    text = plain(text)
    if "#" in text:
        text = TAG.sub(" ", HEADING_LINE.sub(rf"\n{OVER} \1", text))
    return text.lower()
