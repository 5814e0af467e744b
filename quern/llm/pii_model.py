"""A semi-Markov conditional random field over spans of personal information.

A candidate segment is a span with a type; spans are bounded by the grammars below
(digit groups up to six, name tokens up to four, one address form, one e-mail form).
Features look at the whole span (its shape, the classes of its tokens, its length)
and at the words beside it. A labelling of a text is a set of segments that do not
overlap; its score is the sum over its segments, everything else scores zero, so the
best labelling chooses boundaries and types together by dynamic programming over
segment ends, and the partition sum is computed over the same lattice for training.

Weights are learned here from sentences generated with known spans (``make_example``): everyday
requests, signatures, forms and notes of operators, written for this purpose from common English usage,
filled with invented values and with names of the list; the other half of the sentences
holds what only looks like such data (counts, versions, identifiers of things, remote
addresses, products named like people).
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from functools import lru_cache

KINDS = ("email", "phone", "id_number", "address", "name")

_EMAIL = re.compile(r"(?<![\w.+@-])(?:mailto:)?([A-Za-z0-9][\w.+'-]*?)(\s?(?:@|＠|\[at\]|\(at\)|\{at\})\s?|\sat\s)([A-Za-z0-9](?:[\w-]*\w)?(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)[A-Za-z0-9](?:[\w-]*\w)?)+)")
_DIGITS = re.compile(r"\d+")
_JOIN = re.compile(r"[ .\-/]?[()]?[ .\-/]?")
_EXT = re.compile(r"\s?(?:ext\.?|x|extension|Durchwahl)\s?\d{1,5}(?!\w)")
_CODE = re.compile(r"(?<![\w@./-])(?:[A-Z]{1,3} ?\d{2}(?: ?\d{2}){2} ?[A-Z]|[A-Z]{1,2} ?\d{6,9}[A-Z]?|[A-Z]\d{2}[A-Z]\d{4,6}|\d{7,9}[A-Z])(?![\w@-])")
_PLACE = r"[A-Z][\w'-]+(?: [A-Z][\w'-]+){0,3}"
_STREET = r"(?:street|st|road|rd|lane|ln|avenue|ave|close|blvd|boulevard|drive|dr|way|court|ct|place|square|terrace|crescent)"
_UNIT = r"(?:,? (?:flat|apt\.?|apartment|unit|suite|no\.) ?\d+[a-z]?)?"
_ADDRESSES = {
    "street": re.compile(r"(?<![\w.-])\d{1,5}(?:-?[A-Z])? (?:[A-Z][\w'-]+ ){1,3}?(?i:" + _STREET + r")\b\.?(?i:" + _UNIT + r")(?:(?:, ?|\n| )(?:\d{4,5} )?" + _PLACE + r"| \(" + _PLACE + r"\))"),
    "street_lower": re.compile(r"(?<![\w.-])\d{1,5} (?:[a-z][\w'-]+ ){1,3}?" + _STREET + r"\b\.?" + _UNIT + r"(?:, |\n)[a-z][\w'-]+(?: [a-z][\w'-]+){0,2}"),
    "street_only": re.compile(r"(?<![\w.-])\d{1,5}(?:-?[A-Z])? (?:[A-Za-z][\w'-]+ ){1,3}?(?i:" + _STREET + r")\b\.?"),
    "strasse": re.compile(r"(?<![\w-])[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring) \d+ ?[a-z]?(?:, ?\d{4,5} " + _PLACE + r"| in " + _PLACE + r"|, ?" + _PLACE + r")"),
    "calle": re.compile(r"(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Rue|Via|Camino) (?:[A-Z][\w'-]+ ){1,3}\d+(?:,? (?:\d{4,5} )?" + _PLACE + r")"),
    "box": re.compile(r"(?<!\w)(?:P\.? ?O\.? ?Box|PO BOX|po box|Postfach|Apartado) \d+(?:(?:, ?|\n| \()(?:\d{4,5} )?(?:" + _PLACE + r"|[a-z][\w'-]+(?: [a-z][\w'-]+){0,2})\)?)"),
}
_NUMBERISH = re.compile(r"\d[\d().+ /-]{5,}")
_ADDRESSISH = re.compile(r"(?i:\b" + _STREET + r"\b|\bbox \d|postfach|apartado|\b(?:calle|avenida|plaza|paseo|rue|via|camino) )|(?:straße|strasse|str\.|gasse|weg|platz|allee|ring) \d")
_MAIL_NEXT = r"(?!\s?(?:@|＠|\[at\]|\(at\)| at [\w-]+ dot ))"
_NAMEISH = re.compile(r"(?<![\w@.+＠_-])(?:[A-Z][a-z]+|[A-Z]{3,}|[A-Z]\.)(?![\w@＠_+])(?:-san\b)?" + _MAIL_NEXT)
_LOWER_PAIR = r"(?<![\w@.+＠_-])(?:{starts})[a-z]{{2,}} [a-z]{{4,}}(?![\w@＠_+.-]*[\w@＠])" + _MAIL_NEXT
_WORD_BEFORE = re.compile(r"([\w.]+|[^\s\w])\s*[\"'<(]?$")
_WORD_AFTER = re.compile(r"\s*[\"')>]?\s*([\w]+|[^\s\w])")
_TITLES = {"dr.", "mx.", "mr.", "ms.", "mrs.", "prof.", "dr", "mx", "mr", "ms", "mrs", "prof", "herr", "frau"}
_ID_WORDS = re.compile(r"(?i)(?:\bssn\b|social security|passport|ausweis|national insurance|\bnino\b|マイナンバー|identity|\bid card|\bdni\b|\bnie\b|licen[cs]e|tax id|insurance n)[^\n]{0,14}$")
#: Words of things that are counted or numbered, and of what may bear a name without being a person.
_OTHER_NUMBER = re.compile(
    r"(?i)\b(?:ticket|issue|case|order|invoice|release|build|commit|line|row|page|chapter|section|table|figure|item|step|code|returned|exit|wrote|read|copied|sent|waited|took|after|over|factor|ratio|version|revision|hash|checksum|digest|port|offset|counter|"
    r"ref|snapshot|uuid|range|timer|timeout|retry)s?\W*(?:\w+\W+)?$"
)
_THINGS = frozenset("service server cluster host node team page board dashboard library module package plugin project app tool script job queue test tests fixture pipeline release branch repo docs site theme was is are needs works broke fails fail too again to last".split())


class Gazetteer:
    """Listed names, and which beginnings and endings names of the list share."""

    def __init__(self, names: list[tuple[str, str]], shared: int = 3):
        self.given = {n.lower() for n, kind in names if n and kind == "given"}
        self.family = {n.lower() for n, kind in names if n and kind != "given"}
        starts: dict[str, int] = {}
        ends: dict[str, int] = {}
        for n in self.given | self.family:
            for size in (2, 3, 4):
                starts[n[:size]] = starts.get(n[:size], 0) + 1
            for size in (3, 4):
                ends[n[-size:]] = ends.get(n[-size:], 0) + 1
        self.starts = {k for k, v in starts.items() if v >= shared and len(k) == 3}
        thirds: dict[str, set] = {}
        for n in self.given | self.family:
            thirds.setdefault(n[:2], set()).add(n[2:3])
        self.starts |= {k for k, v in thirds.items() if len(v) > shared}
        self.ends = set(ends)
        shapes = sorted(self.starts)
        lone = sorted(n for n in self.given | self.family if not self.begins(n))
        words = [f"[{c[0].upper()}](?:{c[1:]}|{c[1:].upper()})" for c in map(re.escape, shapes + lone)] or ["(?!)"]
        # any name token starts so, is titled, or is followed by an honorific: texts without one have no candidates
        self.anchor = re.compile(r"(?<!\w)(?:" + "|".join(words) + r"|(?:Dr|Mx|Mr|Ms|Mrs|Prof|Herr|Frau)\b)|-san\b")
        self.lower_pair = re.compile(_LOWER_PAIR.format(starts="|".join(map(re.escape, shapes)) or "(?!)"))

    def begins(self, word: str) -> bool:
        return word[:3] in self.starts or word[:2] in self.starts

    def supported(self, word: str) -> bool:
        return len(word) >= 5 and self.begins(word) and word[-3:] in self.ends

    def token_class(self, token: str) -> str:
        """g, f: listed; a: listed but shaped like no other name; m: shaped like one; i: initial; u: unknown."""
        if len(token) == 2 and token[1] == ".":
            return "i"
        word = token.lower()
        if word in self.given or word in self.family:
            return ("g" if word in self.given else "f") if self.begins(word) else "a"
        return "m" if self.supported(word) else "u"


def _beside(text: str, start: int, end: int) -> tuple[str, str]:
    before = _WORD_BEFORE.search(text[max(0, start - 24) : start])
    after = _WORD_AFTER.match(text, end)
    return (before.group(1).lower() if before else "^"), (after.group(1).lower() if after else "$")


def _emails(text: str, out: list) -> None:
    for m in _EMAIL.finditer(text):
        local, sep, domain = m.groups()
        left, right = _beside(text, m.start(), m.end())
        sep, word_dot = sep.strip(), " dot " in domain
        labels = re.split(r"\s?(?:\.|\[dot\]|\(dot\)|\bdot\b)\s?", domain)
        features = ["email", f"e:sep={sep}{'+dot' if word_dot else ''}", f"e:left={left}"]
        if labels[-1].isdigit() or not labels[-1].isalpha():
            features.append("e:numeric")
        if text[m.end() : m.end() + 1] in (":", "/"):
            features.append("e:path")
        if re.fullmatch(r"(?i)git|deploy|root|admin|ubuntu|svn|tool|ci|build", local):
            features.append("e:machine_user")
        if re.search(r"\d$", labels[0]):
            features.append("e:host_number")
        out.append((m.start(), m.end(), "email", features))


def _numbers(text: str, out: list) -> None:
    groups = [(m.start(), m.end()) for m in _DIGITS.finditer(text)]
    for i, (first, _) in enumerate(groups):
        if first and (text[first - 1].isalnum() or text[first - 1] in "@_") or first > 1 and text[first - 1] in ".-/" and text[first - 2].isalnum():
            continue
        digits, lengths, seps = 0, [], []
        for j in range(i, min(i + 6, len(groups))):
            if j > i:
                gap = text[groups[j - 1][1] : groups[j][0]]
                if len(gap) > 3 or not _JOIN.fullmatch(gap):
                    break
                seps.append(gap)
            start, end = groups[j]
            digits += end - start
            lengths.append(str(end - start))
            if digits > 15:
                break
            if digits < 7:
                continue
            tail = text[end : end + 2]
            if tail and (tail[0].isalnum() and ord(tail[0]) < 128 or tail[0] in "@_" or tail[0] in "-./" and tail[1:].isdigit()):
                continue
            begin = first
            if begin and text[begin - 1] == "(":
                begin -= 1
            plus = begin > 0 and text[begin - 1] == "+"
            begin -= plus
            shape = "-".join(lengths)
            kinds = "".join(sorted({s if len(s) == 1 else "(" for s in seps}))
            left, right = _beside(text, begin, end)
            window = text[max(0, begin - 40) : begin]
            common = []
            if _ID_WORDS.search(window):
                common.append("idword")
            if _OTHER_NUMBER.search(window):
                common.append("otherword")
            ext = _EXT.match(text, end)
            phone = ["phone", f"p:shape={'+' if plus else ''}{shape}", f"p:seps={kinds}", f"p:left={left}", f"p:right={right}", f"p:digits={min(digits, 13)}"] + ["p:" + c for c in common]
            if plus or shape.startswith(("2-", "3-")) and text[first : first + 2] == "00":
                phone.append("p:international")
            if ext:
                phone.append("p:ext")
            out.append((begin, ext.end() if ext else end, "phone", phone))
            if not plus:
                out.append((begin, end, "id_number", ["id", f"i:shape={shape}", f"i:seps={kinds}", f"i:right={right}"] + ["i:" + c for c in common]))


def _codes(text: str, out: list) -> None:
    for m in _CODE.finditer(text):
        shape = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", m.group()))
        features = ["id", f"i:shape={shape}"]
        window = text[max(0, m.start() - 40) : m.start()]
        if _ID_WORDS.search(window):
            features.append("i:idword")
        if _OTHER_NUMBER.search(window):
            features.append("i:otherword")
        out.append((m.start(), m.end(), "id_number", features))


def _addresses(text: str, out: list) -> None:
    for form, pattern in _ADDRESSES.items():
        for m in pattern.finditer(text):
            left, _ = _beside(text, m.start(), m.end())
            features = ["address", f"a:form={form}"]
            if left in ("line", "page", "row", "step", "section", "exit", "least"):
                features.append("a:countword")
            out.append((m.start(), m.end(), "address", features))


def _names(text: str, gazetteer: Gazetteer, out: list) -> None:
    for m in gazetteer.lower_pair.finditer(text):
        classes = [gazetteer.token_class(w) for w in m.group().split()]
        if classes[0] in "gfm" and classes[1] in "gfma":
            left, right = _beside(text, m.start(), m.end())
            out.append((m.start(), m.end(), "name", ["name", "n:lower", f"n:pattern={''.join(classes)}", f"n:left={left}", f"n:right={right}"]))
    if not gazetteer.anchor.search(text):
        return
    tokens = [(m.start(), m.end(), m.group()) for m in _NAMEISH.finditer(text)]
    classes = []
    for start, end, word in tokens:
        san = word.endswith("-san")
        c = gazetteer.token_class(word[:-4] if san else word)
        classes.append(c + ("S" if san else ""))
    for i in range(len(tokens)):
        pattern = ""
        for j in range(i, min(i + 4, len(tokens))):
            if j > i:
                gap = text[tokens[j - 1][1] : tokens[j][0]]
                if gap == ", ":
                    pattern += ","
                elif gap not in (" ", "\n"):
                    break
            pattern += classes[j]
            if pattern[-1] == "i" and j == i and len(tokens) == 1:
                continue
            start, end = tokens[i][0], tokens[j][1]
            left, right = _beside(text, start, end)
            titled = left in _TITLES
            if not titled and not any(c in pattern for c in "gfamS"):
                continue
            features = ["name", f"n:pattern={pattern}", f"n:left={left}", f"n:right={right}"]
            if titled:
                features += ["n:titled", f"n:titled={pattern}"]
            mail = text[end : end + 2] in (" <", " (") and re.match(r" [<(][^\s<>()]+[@＠]", text[end : end + 60])
            if mail:
                features.append("n:mail")
            if text[start : tokens[i][1]].isupper() and len(tokens[i][2]) > 2:
                features.append("n:upper")
            if right in _THINGS or right.isdigit():
                features.append("n:thing")
            out.append((start, end, "name", features))


def candidates(text: str, gazetteer: Gazetteer) -> list[tuple[int, int, str, list[str]]]:
    """All candidate segments of a text, by end."""
    out: list = []
    if "@" in text or "＠" in text or "at]" in text or "at)" in text or "at}" in text or " dot " in text:
        _emails(text, out)
    if _NUMBERISH.search(text):
        _numbers(text, out)
    if _DIGITS.search(text):
        _codes(text, out)
        if _ADDRESSISH.search(text):
            _addresses(text, out)
    _names(text, gazetteer, out)
    out.sort(key=lambda s: s[1])
    return out


def decode(segments: list, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best set of segments that do not overlap (Viterbi over segment ends)."""
    scored = [(s, e, k, v) for s, e, k, f in segments if (v := sum(map(weights.get, f, [0.0] * len(f)))) > 0]
    if len(scored) < 2:
        return [x[:3] for x in scored]
    ends = [x[1] for x in scored]
    best, taken = [0.0], [None]
    for i, (start, _, _, value) in enumerate(scored):
        j = bisect_right(ends, start, 0, i)
        if best[j] + value > best[i]:
            best.append(best[j] + value)
            taken.append(j)
        else:
            best.append(best[i])
            taken.append(None)
    found, i = [], len(scored)
    while i:
        if taken[i] is None:
            i -= 1
        else:
            found.append(scored[i - 1][:3])
            i = taken[i]
    return found[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def expectations(segments: list, weights: dict[str, float]) -> list[float]:
    """Probability of each segment under the model (forward and backward sums)."""
    n = len(segments)
    values = [sum(weights.get(f, 0.0) for f in s[3]) for s in segments]
    ends = [s[1] for s in segments]
    forward, since = [0.0], []
    for i, (start, *_rest) in enumerate(segments):
        j = bisect_right(ends, start, 0, i)
        since.append(j)
        forward.append(_log_add(forward[i], forward[j] + values[i]))
    backward = [-math.inf] * (n + 1)
    backward[n] = 0.0
    for i in range(n, 0, -1):
        for j, v in ((i - 1, 0.0), (since[i - 1], values[i - 1])):
            b = backward[i] + v
            backward[j] = b if backward[j] == -math.inf else _log_add(backward[j], b)
    return [math.exp(forward[since[i]] + values[i] + backward[i + 1] - forward[n]) for i in range(n)]


# ------------------------------------------------------------------ generated examples

_FILL = (
    "nothing else changed since Monday", "chapter 3.14.2 covers the details", "it copied 8123456789 records", "read 912345678 chunks so far", "the shell returned 137",
    "invoice 771-2093 was paid", "case 4410-27 got closed", "release 2024-11-3050 rolled back", "the timer fired after 6100-42-88000 cycles", "snapshot 2025-7-4000 is stale",
    "a factor of 3.75 over 500-900 samples", "upgrade lib@2.0.9 first", "log in as admin@db-3.internal and retry", "pull from svn@code.internal:team/app-x.git", "push to git@host-9.internal:a/b.git",
    "@oncall could you check", "restart the {A} service later", "{A} 7 landed, so {A} works again", "a crash at line 88 Lane of the listing", "these rows use PO Box notation", "row 14 Court was malformed", "page 230 Drive was skipped",
    "Engineers may approve this change", "This file lists every option", "After the build finished, run it", "Someone should read the notes", "checksum 9c41e07a differs", "commit 4b825dc642 looks good", "digest ab12cd34ef56 is right",
    "our {a} cluster is down", "Please keep an eye on the graphs", "All nodes need more memory", "wait a little longer", "scroll to the last entry", "order 5512093 was shipped", "port 8080 and 9090 stay open",
    "the {A} team page moved", "deploy {A} to staging", "it took 3600 s and 12000 ms", "try offset 100200300 instead", "a {a} plugin broke", "uuid 0f8fad5b-d9cb-469f-a165-70867728950e", "range 10.0.0.1-10.0.0.255",
    "table 12 shows 2019-2023 only", "due 2024-02-29", "from 1999-12-31 till 2001-01-01", "gateway 172.16.254.101 answers", "mask 255.255.255.0", "errno 1062 (23000) again", "the {A} library needs a patch", "we shipped {A} last week", "{A} was renamed", "counter 1234567890123 overflowed", "ref 88-1200 and ref 88-1300 agree", "the {A} module is slow", "{A} is down", "{A} tests fail", "retry 3 of 10 failed",
)
_BEFORE = {
    "email": ("write to ", "e-mail: ", "copy ", "contact=", "From: ", '{"mail": "', "hello,", "<", "", "reachable via ", "account "),
    "phone": ("dial ", "phone: ", "mobile ", "my cell is ", "reach me at ", "Fon ", "fax ", "", "number: ", "sms ", "phone "),
    "id_number": ("the patient has ", "his card says ", "the customer typed ", "", "record: ", "scan shows "),
    "address": ("my home is ", "we moved to ", "send the parcel to ", "billing address: ", "residence: ", "meet us at ", "located at ", ""),
    "name": ("talk to ", "regards, ", "reported by ", "I am ", "owner: ", "Reviewed-by: ", "", "cheers, ", "contact ", "author ", "with ", "for "),
}
_AFTER = {
    "email": (" today", " wrote back", " bounced", "", ";", '",', ".", " is mine"),
    "phone": (" tomorrow", " after lunch", " belongs to me", "", ".", " if urgent", " and ask"),
    "id_number": (" was leaked", " appears in the dump", "", ".", " must stay private"),
    "address": ("", ".", ", thanks", "; ring twice"),
    "name": (" tomorrow", " wrote the patch", " agreed to this", "", ".", " opened it", " said so", " will call", " and me"),
}
_PLACES = ("Riverton", "Lower Stanbrook", "Eastvale", "North Fenway Cross", "Oakham")
_ROADS = ("Cedar", "Station", "Park View", "Chestnut", "Bridge")


def _digits(rng: random.Random, shape: str) -> str:
    return "".join(str(rng.randrange(10)) if c == "9" else rng.choice("ABKTX") if c == "A" else c for c in shape)


def _surface(rng: random.Random, kind: str, names: list[tuple[str, str]], plain: list[str]) -> str:
    given = [n for n, k in names if k == "given"]
    family = [n for n, k in names if k != "given"]

    def invented(like: list[str]) -> str:
        a, b = rng.choice(like), rng.choice(like)
        return (a[: rng.choice((3, 4, 5))] + b[-rng.choice((3, 4, 5)) :]).capitalize()

    pick = lambda like: rng.choice(like) if rng.random() < 0.6 else invented([x for x in like if x not in plain] or like)
    g, f = pick(given), pick(family)
    if kind == "name":
        form = rng.choice(("g f", "g f", "g f", "f", "f, g", "g i. f", "i. f", "t f", "t g f", "f-san", "UP", "low"))
        initial = rng.choice("ABHKMTZ") + "."
        title = rng.choice(("Dr.", "Mx.", "Mr.", "Ms."))
        return {"g f": f"{g} {f}", "f": f, "f, g": f"{f}, {g}", "g i. f": f"{g} {initial} {f}", "i. f": f"{initial} {f}", "t f": f"{title} {f}", "t g f": f"{title} {g} {f}", "f-san": f"{f}-san", "UP": f"{g} {f}".upper(), "low": f"{g} {f}".lower()}[form]
    if kind == "email":
        local = rng.choice((f"{g}.{f}", f"{f}{rng.randrange(99)}", f"{g[0]}{f}", f"{g}+logs", f"{g}-{f}", f"{g}_{f}".upper())).replace(" ", "")
        local = local if local.isupper() else local.lower()
        domain = rng.choice(("example.com", "mail.place.example", "box.test", "post.example.org"))
        domain = domain.upper() if rng.random() < 0.15 else domain
        sep = rng.choice(("@", "@", "@", "＠", " [at] ", "(at)", " at ", " at "))
        return ("mailto:" if rng.random() < 0.1 and sep == "@" else "") + local + sep + (domain.replace(".", " dot ") if sep == " at " else domain)
    if kind == "phone":
        shape = rng.choice(("999-999-9999", "(999) 999 9999", "(999) 999-9999", "+1 (999) 999-9999", "+19999999999", "001 999 999 9999", "999.999.9999", "99999 999 999", "+44 9999 999999", "+44 (0)99 9999 9999", "099 9999 9999", "999 999 9999 ext. 99", "+49 99 9999999", "+81 9-9999-9999", "+34 999 999 999"))
        return _digits(rng, shape)
    if kind == "id_number":
        word, shape = rng.choice((("SSN ", "999-99-9999"), ("", "999-99-9999"), ("social security number ", "999 99 9999"), ("ssn: ", "999999999"), ("passport ", "A9999999"), ("passport no. ", "AA 999999"), ("", "AA 999999"), ("Personalausweis ", "A99A99999"), ("NINO ", "AA999999A"), ("national insurance ", "AA 99 99 99 A"), ("マイナンバー ", "9999 9999 9999"), ("", "AA999999A"), ("", "A9999999"), ("", "A99A99999"), ("DNI ", "99999999A")))
        return word + "\0" + _digits(rng, shape)
    place, road, n = rng.choice(_PLACES), rng.choice(_ROADS), rng.randrange(1, 480)
    street = rng.choice(("Street", "St.", "Road", "Rd", "Lane", "Avenue", "Close", "Blvd"))
    joined = road.replace(" ", "")
    return rng.choice((f"{n} {road} {street}, {place}", f"{n} {road} {street}\n{place}", f"{n} {road} {street}, Flat {n % 40}, {place}", f"{n} {road} {street}, {place}".lower(), f"{n}-B {road.upper()} {street.upper()} ({place})", f"{joined}straße {n}, 00{n % 900 + 100} {place}", f"{joined}gasse {n} in {place}", f"Calle {road} {n}, {place}", f"PO Box {n}, {place}"))


def make_example(rng: random.Random, names: list[tuple[str, str]], plain: list[str]) -> tuple[str, set]:
    """A text with its segments ``{(start, end, kind)}``."""
    text, gold = "", set()
    for _ in range(rng.randrange(1, 5)):
        if text:
            text += rng.choice((". ", "\n", "; ", ", ", " - ", "\n\n"))
        if rng.random() < 0.45:
            word = rng.choice(plain or ["Beacon"])
            text += rng.choice(_FILL).replace("{A}", word).replace("{a}", word.lower())
            continue
        kind = rng.choice(KINDS)
        before, after = rng.choice(_BEFORE[kind]), rng.choice(_AFTER[kind])
        if kind == "name" and not before and not after.strip("."):
            after = " said so"
        surface = _surface(rng, kind, names, plain)
        text += before
        lead, _, core = surface.partition("\0") if "\0" in surface else ("", "", surface)
        title = re.match(r"(?:Dr|Mx|Mr|Ms)\. ", core) if kind == "name" else None
        if title:
            lead, core = title.group(), core[title.end() :]
        text += lead
        gold.add((len(text), len(text) + len(core), kind))
        text += core
        if kind == "name" and rng.random() < 0.12:
            mail = core.split()[-1].lower().replace("-san", "") + "@box.test"
            text += rng.choice((" <", " ("))
            gold.add((len(text), len(text) + len(mail), "email"))
            text += mail + {"<": ">", "(": ")"}[text[-1]]
        text += after
    return text, gold


@lru_cache(maxsize=4)
def train(names: tuple[tuple[str, str], ...], examples: int = 2500, epochs: int = 4, rate: float = 0.25, decay: float = 1e-4, seed: int = 7) -> tuple[tuple[str, float], ...]:
    """Weights by stochastic gradient ascent on the conditional likelihood of generated examples."""
    rng, gazetteer = random.Random(seed), Gazetteer(list(names))
    plain = [n for n, _ in names if gazetteer.token_class(n) == "a"]
    made = []
    for _ in range(examples):
        text, gold = make_example(rng, list(names), plain)
        segments = candidates(text, gazetteer)
        if segments:
            made.append((segments, [(s, e, k) in gold for s, e, k, _ in segments]))
    weights: dict[str, float] = {}
    for epoch in range(epochs):
        rng.shuffle(made)
        step = rate / (1 + epoch)
        for segments, wanted in made:
            for (_, _, _, features), p, y in zip(segments, expectations(segments, weights), wanted):
                if abs(y - p) > 1e-4:
                    for f in features:
                        w = weights.get(f, 0.0)
                        weights[f] = w + step * (y - p) - step * decay * w
    return tuple(sorted(weights.items()))
