"""Personal data with offsets, also behind disguises.

Base patterns run on the text itself. Three transducers then rewrite what hides an identifier, one after another: letters
that look like others, by a table over code points; digits that are spelled out, over words and the gaps between them;
and at/dot disguises, over classes of tokens. A transducer keeps only its edits - where each stands before and after -
so that what is found in the rewritten text is mapped back to the source by a search among them, and memory grows with
the edits, not with the text. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigraph.llm.common import small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can begin at the start of a run of digits only; possessive repeats keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅоΑΒΕΖΗΙΚΜΝΟΡΤΥΧοακν", "aeopcyxijsdhqwABEKMHOPCTXIJSoABEZHIKMNOPTYXoakv", strict=True))
# Digits spelled out.
_SPELLED = {w: str(d) for d, ws in enumerate(("zero oh null nul cero zéro", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")) for w in ws.split()}
_GAP = frozenset(" \t\n\r\x0b\x0c.,-")
LEAST_DIGITS = 4
#: Characters that the digit transducer takes at once; a longer run of digits makes a longer piece.
PIECE = 1 << 20
_AT_WORDS, _DOT_WORDS = frozenset("at ät arroba arobase".split()), frozenset("dot punkt point punto".split())
_TOKEN = re.compile(r"(\s+)|([(\[{<])|([)\]}>])|(\w+)|(.)", re.S)
#: Tokens as letters: s space, o and c brackets, A and D words for at and dot, a and d the marks themselves, w other words, - hyphens, x the rest.
_DISGUISE = re.compile(r"s?os?(?P<at>[Aa])s?cs?|sAs(?=[wAD-]+(?:s?os?D|sDs))|s?os?(?P<dot>[Dd])s?cs?|(?<=[wAD-])(?P<said>sDs)(?=[wAD])")
#: Wider than _DISGUISE: each match of it holds one of these.
_MARKED = re.compile(r"(?i)[(\[{<]\s*(?:at|@|ät|arroba|arobase)\s*[)\]}>]|[(\[{<]\s*(?:dot|\.|punkt|point|punto)|\s(?:dot|punkt|point|punto)\s")
_MARKS = re.compile(r"[(\[{<]|[dD][oO][tT]|[pP](?:[uU][nN][kK][tT]|[oO][iI][nN][tT]|[uU][nN][tT][oO])")
#: Tokens that the at/dot transducer takes at once, and how many of them the next lot sees again.
LOT, AGAIN = 50_000, 128


@cache
def _glyphs() -> dict[str, str]:
    """Lookalikes, and every wide, styled or foreign form of one ASCII letter, digit, @, dot, plus or hyphen."""
    out = dict(_LOOKALIKES)
    for c in [*range(0x660, 0x66A), *range(0x966, 0x970), *range(0x2070, 0x208A), *range(0x2460, 0x2469), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        ch = chr(c)
        plain = unicodedata.normalize("NFKC", ch)
        plain = str(unicodedata.digit(plain)) if len(plain) == 1 and not plain.isascii() and plain.isdigit() else plain
        if len(plain) == 1 and plain.isascii() and (plain.isalnum() or plain in "@.+-"):
            out[ch] = plain
    out |= {"․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " "}
    return out


@cache
def _table() -> dict[int, str]:
    return {ord(c): to for c, to in _glyphs().items() if c != "\u00a0"}


@cache
def _odd_chars() -> frozenset[str]:
    return frozenset(map(chr, _table()))


@cache
def _digit_words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points make words; and the spelled digits, each packed into a number, sorted, with their digits."""
    is_word = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)
    packed = {_packed(w): d for w, d in _SPELLED.items()}
    keys = np.array(sorted(packed), np.uint64)
    return is_word, keys, np.array([ord(packed[int(k)]) for k in keys], np.uint32)


_LONGEST = max(map(len, _SPELLED))


def _packed(word: str) -> int:
    return sum(ord(c) << 9 * i for i, c in enumerate(word))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ has one possible match: the run of local characters before it, as far as the last match allows, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Valid base matches by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


class Edits:
    """What a transducer changed: stretches [a, b) of its input that became `new`, in order."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at, out = [], 0, 0
        self.out: list[int] = []  # where each edit begins in the output
        self.edits = edits
        for a, b, new in edits:
            parts += [text[at:a], new]
            out += a - at
            self.out.append(out)
            out += len(new)
            at = b
        self.text = "".join([*parts, text[at:]]) if edits else text

    def source(self, a: int, b: int) -> tuple[int, int, bool]:
        """[a, b) of the output as a stretch of the input, and whether an edit touches it."""
        first = bisect_right(self.out, a) - 1
        last = bisect_right(self.out, b - 1) - 1
        start = self._place(a, first, False)
        end = self._place(b - 1, last, True)
        touched = last > first or (first >= 0 and a < self.out[first] + len(self.edits[first][2]))
        return start, end, touched

    def _place(self, at: int, k: int, end: bool) -> int:
        if k < 0:
            return at + end
        a, b, new = self.edits[k]
        beyond = at - self.out[k] - len(new)
        return b + beyond + end if beyond >= 0 else b if end else a


def spelled_digits(text: str, piece: int = PIECE) -> list[tuple[int, int, str]]:
    """Edits for runs of at least four spelled or written numbers, of which the first is spelled, with gaps of one to three blanks, dots, commas or hyphens.

    Words, gaps and their classes are found for a piece of text at once; a piece ends where no run goes on.
    """
    out: list[tuple[int, int, str]] = []
    at = 0
    while at < len(text):
        size = piece
        while True:
            part = text[at : at + size]
            found, safe = _spelled_runs(part, at + size >= len(text))
            if safe or at + size >= len(text):
                break
            size *= 2
        out += [(a + at, b + at, new) for a, b, new in found]
        at += safe if at + size < len(text) else size
    return out


def _spelled_runs(text: str, whole: bool) -> tuple[list[tuple[int, int, str]], int]:
    """Runs of a piece, and a place up to which no run of it can be open; the last words of a piece may go on beyond it."""
    is_word, keys, digits = _digit_words()
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    mask = np.concatenate(([False], is_word[code], [False]))
    edge = np.flatnonzero(mask[1:] != mask[:-1])
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return [], 0 if not whole else len(text)
    size = end - start
    short = np.flatnonzero(size <= _LONGEST)
    key = np.zeros(len(short), np.uint64)
    for i in range(_LONGEST):
        has = size[short] > i
        c = code[np.minimum(start[short] + i, len(code) - 1)].astype(np.uint64)
        key += np.where(has, np.minimum(c, np.uint64(511)) << np.uint64(9 * i), np.uint64(0))
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    spelled = np.zeros(n, bool)
    spelled[short[keys[place] == key]] = True
    if not spelled.any():
        return [], 0 if not whole and n < 2 else int(start[-1])
    number = np.zeros(n, bool)
    # A number is a word of ASCII digits alone.
    ascii_digit = np.concatenate(([0], np.cumsum((code >= 48) & (code <= 57))))
    number[ascii_digit[end] - ascii_digit[start] == size] = True
    token = spelled | number
    gap = start[1:] - end[:-1]
    linked = token[1:] & token[:-1] & (gap <= 3)
    for i in np.flatnonzero(linked).tolist():
        linked[i] = all(c in _GAP for c in text[end[i] : start[i + 1]])
    out, k = [], 0
    runs = np.flatnonzero(np.concatenate(([True], ~linked, [True])))
    last = int(runs[-2])  # where the last run begins
    for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        if b - a < LEAST_DIGITS or (not whole and a == last):
            continue
        k = a + int(np.argmax(spelled[a:b])) if spelled[a:b].any() else b
        if b - k >= LEAST_DIGITS:
            words = [low[start[i] : end[i]] for i in range(k, b)]
            out.append((int(start[k]), int(end[b - 1]), "".join(_SPELLED.get(w, w) for w in words)))
    return out, int(start[last]) if not whole else len(text)


def _classes(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _TOKEN.finditer(text):
        kind = m.lastindex
        if kind == 4:
            w = m.group().lower()
            yield *m.span(), "A" if w in _AT_WORDS else "D" if w in _DOT_WORDS else "w"
        else:
            yield *m.span(), "soc"[kind - 1] if kind < 4 else {"@": "a", ".": "d", "-": "-"}.get(m.group(), "x")


def at_and_dot(text: str, lot: int = LOT) -> list[tuple[int, int, str]]:
    """Edits for `(at)`, ` at `, `[dot]` and ` dot ` in what looks like an address. Lots of tokens overlap, so that a disguise at the end of one is seen whole in the next."""
    out: list[tuple[int, int, str]] = []
    tokens = _classes(text)
    held: list[tuple[int, int, str]] = []
    while True:
        more = list(islice(tokens, lot))
        held += more
        letters = "".join(t[2] for t in held)
        done = 0
        for m in _DISGUISE.finditer(letters):
            if len(more) == lot and m.end() > len(held) - AGAIN // 2:
                break
            done = m.end()
            at = held[m.start()][0], held[m.end() - 1][1]
            out.append((*at, "." if m.group("dot") or m.group("said") else "@"))
        if len(more) < lot:
            return out
        held = held[max(done, len(held) - AGAIN) :]


class Rewritten:
    """A text after the three transducers."""

    def __init__(self, text: str, always: bool = False):
        self.original = text
        odd = always or not (text.isascii() or _odd_chars().isdisjoint(text))
        self.plain = text.translate(_table()) if odd else text
        self.spelled = Edits(self.plain, spelled_digits(self.plain))
        t = self.spelled.text
        marked = always or (not (t.isascii() and _MARKS.search(t) is None) and _MARKED.search(t) is not None)
        self.marked = Edits(t, at_and_dot(t) if marked else [])
        self.text = self.marked.text
        self.changed = self.text != text

    def source(self, a: int, b: int) -> tuple[int, int, bool]:
        a, b, one = self.marked.source(a, b)
        a, b, two = self.spelled.source(a, b)
        return a, b, one or two or self.plain[a:b] != self.original[a:b]


def disguised_spans(text: str, always: bool = False) -> list[tuple[str, int, int]]:
    """Identifiers that only the rewritten text shows. always: run every transducer, whether or not the text shows a sign for it."""
    tape = Rewritten(text, always)
    if not tape.changed:
        return []
    out = []
    for kind, a, b in base_spans(tape.text):
        start, end, touched = tape.source(a, b)
        if touched and not (kind == "email" and not tape.text[a:b].rpartition(".")[2].isalpha()):
            out.append((kind, start, end))
    return out


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind, then start: base ones and those behind disguises that overlap no base span of their kind. Spans of a kind are in order and apart, so each lookup is a binary search."""
    base = base_spans(text)
    found = disguised_spans(text)
    if not found:
        return base, base
    starts, ends = {k: [] for k in KINDS}, {k: [] for k in KINDS}
    for k, a, b in base:
        starts[k].append(a)
        ends[k].append(b)

    def apart(kind: str, a: int, b: int) -> bool:
        before = bisect_left(starts[kind], b) - 1
        return before < 0 or ends[kind][before] <= a

    return base, sorted([*base, *(s for s in found if apart(*s))], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans. Null text is empty; repeated rows are each reported; an empty table gives no rows; columns but doc_id and text are not read."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, every = spans_of(text)
                kinds = [s[0] for s in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_join(base).encode()).hexdigest(), _join(every)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
