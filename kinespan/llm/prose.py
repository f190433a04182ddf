"""Stretches of prose in source files: comments, docstrings, printed sentences, documentation."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

#: A line of prose: comment marks or a paragraph's tag, then text without the signs of code.
LINE = re.compile(
    r"^[^\w\n`(<]*+(?:<(?:!--|\w{1,3}>))?[^\w\n`(<]*+(?=[^\W\d]|[`(])"
    r"((?:[^\n{}=;<>\[\]$\\_|@`&]++|`[^`\n]*+`|&(?:#?\w{1,6};)?)++)(?:</\w{1,3}>)?[^\w\n]*+$",
    re.M,
)
#: A call or command whose only argument is the text.
CALL = re.compile(r"^[^\W\d][\w.]*(?:\(| ?\()?\s*([\"'])(?=.*\1)")
#: What stands in prose without being part of it.
ASIDE = re.compile(r"`[^`]*`|\([\d\s/.,:%-]*\)")
#: A name with an argument list, a path, or a mark such as `a.b` that ordinary sentences don't have.
CODE = re.compile(r"\w\(|\w/\w+/|[^\W\d]\.[^\W\d]\w|[^\W\d_][a-z]+[A-Z]|\w--?\w+ \d|^\s*[-+] ?\w+ \d")
#: A link with a shown text, an address on the web or for mail.
LINK = re.compile(r"\[([^\[\]\n]*[^\W\d_][^\[\]\n]*)\]\([^\s()]+\)")
ADDRESS = re.compile(r"<?\b(?:https?://|www\.)[^\s<>\"'`]*[^\s<>\"'`.,;:!?)\]}]>?|<?\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+>?")
#: A semicolon or an identifier between plain words.
INNER = re.compile(r"(?<=[^\W\d_]);(?= [^\W\d_]+,? [^\W\d_])|(?<=[^\W\d_] )(?=[^\W_]*_)\w+(?=,? [^\W\d_]+,? [^\W\d_])")
PLAIN = re.compile(r"(?:^|\s)[^\W\d_]+,? [^\W\d_]+,? ?\Z")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SENTENCE = re.compile(r"(?<=[.!?:])\s+")
MARKS = re.compile(r"[̀-ͯ]+")
#: Blocks of fewer words are names, marks or scraps of code.
MIN_BLOCK = 5


class Stretch(NamedTuple):
    """Words of one sentence and where in the text it stands."""

    start: int
    end: int
    words: list[str]


def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte encoding, read aright; any other text as it is."""
    if "Ã" not in text and "Â" not in text and "â€" not in text:
        return text
    for wrong in ("cp1252", "latin-1"):
        try:
            return text.encode(wrong).decode("utf-8")
        except UnicodeError:
            continue
    return text


def folded(text: str) -> str:
    """Lower case without accents, so that spellings with and without them are alike."""
    text = text.lower()
    return text if text.isascii() else MARKS.sub("", unicodedata.normalize("NFKD", text))


def cleared(text: str) -> str:
    """`text`, equally long, where links, addresses, and semicolons and identifiers between plain words are blank."""
    if "](" in text:
        text = LINK.sub(lambda m: f" {m[1]}".ljust(len(m[0])), text)
    if "://" in text or "www." in text or "@" in text:
        text = ADDRESS.sub(lambda m: " " * len(m[0]), text)
    if ";" in text or "_" in text:
        text = INNER.sub(lambda m: " " * len(m[0]) if PLAIN.search(text, max(0, m.start() - 60), m.start()) else m[0], text)
    return text


def lines(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Start and end of each line that may be prose, and where its content starts; the content is as long as in the text."""
    for m in LINE.finditer(cleared(text)):
        body, at = m.group(1), m.start(1)
        call = CALL.match(body)
        if call:
            body, at = body[call.end() : body.rindex(call.group(1))], at + call.end()
        if "`" in body or "(" in body:
            body = ASIDE.sub(lambda x: " " * len(x[0]), body)
        if '"' in body and len(WORD.findall(body)) > 2 * len(body.split()):
            continue  # data: what stands between its quotes is not set apart by blanks
        if not CODE.search(html.unescape(body) if "&" in body else body):
            yield m.start(), m.end(), at, body


def stretches(text: str) -> list[Stretch]:
    """The sentences of all prose in `text`, in order. Lines that follow each other form a block; sentences end within blocks only.

    Offsets count the code points of `text` as it is, whatever its line ends, and span the sentence from
    its first to its last word.
    """
    found: list[Stretch] = []
    # line ends of other systems, without a change of length
    plain = text.replace("\r\n", " \n").replace("\r", "\n") if "\r" in text else text
    block: list[tuple[int, str]] = []

    def close() -> None:
        if not block:
            return
        whole = " ".join(b for _, b in block)
        starts = [0, *accumulate(len(b) + 1 for _, b in block)]
        place = lambda i: block[n := bisect_right(starts, i) - 1][0] + i - starts[n]
        sentences, at = [], 0
        for end, after in [*((m.start(), m.end()) for m in SENTENCE.finditer(whole)), (len(whole), len(whole))]:
            words = WORD.findall(folded(repaired(html.unescape(whole[at:end]))))
            if words:
                inner = whole[at:end]
                first, last = at + len(inner) - len(inner.lstrip()), at + len(inner.rstrip())
                sentences.append(Stretch(place(first), place(last - 1) + 1, words))
            at = after
        if sum(len(s.words) for s in sentences) >= MIN_BLOCK:
            found.extend(sentences)
        block.clear()

    last = -2
    for start, end, at, body in lines(plain):
        if start > last + 1:
            close()
        block.append((at, body))
        last = end
    close()
    return found
