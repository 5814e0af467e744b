"""Running English prose of a document: no front matter, code, tables, links or headings."""

from __future__ import annotations

import re

_FRONT = re.compile(r"\A\s*---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
_FENCED = re.compile(r"^ {0,3}(`{3,}|~{3,}).*?(?:^ {0,3}\1[^\n]*$|\Z)", re.S | re.M)
_KEYED = re.compile(r"(?:id|skill|name|description|title|source|expected):\s")
_SEE, _CODE, _LINK, _URL = re.compile(r"\(see `[^`\n]*`\)"), re.compile(r"`[^`\n]*`"), re.compile(r"\[[^\]\n]*\]\([^)\n]*\)"), re.compile(r"https?://\S+")
_BULLET = re.compile(r"(?:[-*+>]|\d+[.)])\s+(?:\[.\]\s*)?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[a-z][a-z'’-]*")
_OTHER_LETTER = re.compile(r"[^\W\d_a-zA-Z]")
#: Function words of English, and of German, Spanish, French, Italian, Portuguese and Dutch without those that are English words too.
ENGLISH_WORDS = frozenset(
    "the of and to in is that it for as with on at by this be are was were from or an not you can if when then every each but so we he she they his her its their our your my has have had will would should must may do does did no nor than into over "
    "there here who which what how all any some only because while until unless before after".split()
)
FOREIGN_WORDS = frozenset(
    "der das den dem des ein eine einen einer eines und oder nicht ist sind war wenn dann aber auch auf aus bei mit nach von vom zu zum zur wird werden werden sich sie ihr wir ihre kann jede jeder jedes nur noch wie als "
    "el la los las un una unos unas y o pero que cuando como para por con sin del al es son fue esta este esto está están hay su sus cada si se lo le les más muy ya "
    "une et ou mais où qui dont est sont était ce cette ces il elle nous vous ils leur pas plus dans sur avec sans pour par au aux du il lo gli uno di da per è sono nel della che non "
    "os uma e em não é são com de het een en van niet dat dit zijn voor".split()
) - ENGLISH_WORDS


def prose_of(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "---" in text:
        text = _FRONT.sub("", text)
    if "```" in text or "~~~" in text:
        text = _FENCED.sub("", text)
    lines = []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or line[0] == "\t" or line.startswith("    "):
            continue
        first = bare[0]
        if first in "#|":
            continue
        if first in "<*-+>0123456789":
            if bare.startswith(("<!--", "**severity")):
                continue
            bare = _BULLET.sub("", bare, count=1) if _BULLET.match(bare) else bare
        elif first in "isndte" and _KEYED.match(bare):
            continue
        lines.append(bare)
    text = "\n".join(lines)
    if "`" in text:
        text = _CODE.sub("", _SEE.sub("", text))
    if "](" in text:
        text = _LINK.sub("", text)
    if "http" in text:
        text = _URL.sub("", text)
    return text


def is_english(words: list[str], otherwise: bool) -> bool:
    """Whether a sentence's function words are more English than foreign; ``otherwise`` where they do not say."""
    own, foreign = sum(w in ENGLISH_WORDS for w in words), sum(w in FOREIGN_WORDS for w in words)
    return own > foreign if own != foreign else otherwise


def english_words(text: str) -> list[str]:
    """Words of the English sentences of the prose, in lower case.

    A sentence with letters beyond ASCII is not counted as English; one whose function words do not tell goes with the one before it.
    """
    text = prose_of(text).lower()
    words = _WORD.findall(text)
    if FOREIGN_WORDS.isdisjoint(words) and (text.isascii() or not _OTHER_LETTER.search(text)):
        return words
    words, english = [], True
    for sentence in _SENTENCE.split(text):
        if not sentence.isascii() and _OTHER_LETTER.search(sentence):
            english = False
            continue
        found = _WORD.findall(sentence)
        english = is_english(found, english)
        if english:
            words += found
    return words
