"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The field is trained on the small labelled table below (sentences with marked spans, varied by drawing other digits and
letters for the marked parts) by gradient steps on the exact conditional likelihood. It labels words; its features are a
word's shape, its prefix, lengths, whether its digits pass Luhn's check, its neighbours' shapes and whether a key word such as
"password" stands before it. What it labels as a card counts only if the digits of the span pass that check as well.

Every word of a text is labelled. A word's own share of its score is kept from its first sight; a word whose score is so far
in favour of "outside" that no neighbours' labels could turn it is outside on the best path, and splits the chain there. So
Viterbi runs, exactly, on the runs of other words only, and all runs go through numpy side by side.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LABELS = ("outside", *KINDS)

# The base patterns. Possessive repeats and look-behinds only spare work: the class after each repeat excludes
# the repeated characters, so the matches are those of the plain patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKER = re.compile(r"[0-9@=]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TAIL = ".,;:!?*&%#$\"')]}"
_WRAPPED = re.compile(r"[(\[{<](at|dot)[)\]}>]", re.IGNORECASE)
_PART = re.compile(r"[^,;|/]+")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The matches of the fixed patterns, leftmost and non-overlapping for each kind, by start and kind."""
    found: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


#: The labelled table: sentences with {kind|text}. In a marked text 9 stands for any digit, a and A for any letter, f for any
#: hexadecimal digit; other characters stand for themselves, and backquotes enclose what is taken as it is. {none|text} and
#: {decoy|text} are drawn but not marked. The digits of a card pass Luhn's check, those of a decoy don't.
SENTENCES = """
write to {email|aaaaa.99@aaaa9.`com`} about the order
{email|aaa@aaaaaa.`org`} and {email|aaaa_aa@aa.aaaa.`net`}, please.
mail {email|aaaaaa(`at`)aaaaaa9.`com`} or {email|aaaa99[`at`]aaaa.`org`} today
ask {email|aaaa.aaaa@aaaaaa.`co.uk`}; it was sent on 12 May
the host {ip|99.99.199.99} was down for 3 hours
from {ip|199.9.99.199}, to {ip|10.0.0.9}.
server {ip|99.199.99.99:9999} answered 200 times
paid with {card|4999999999999999} on the first
card {card|4999 9999 9999 9999}, expires soon
card number {card|5999-9999-9999-9999} and 2 more
call {phone|+1 (999) 555-9999} before noon
or {phone|+49 999 9999999}, {phone|+33 9 99 99 99 99}.
call {phone|(999) 555-9999} or {phone|999-555-9999} after 5
his {phone|+1 999-999-9999} rang, {card|4999999999999999} was charged
{email|aaaaa.99@aaaa9.`com`} {phone|+1 (999) 555-9999} {card|4999999999999999} the end
the {secret|`password=`ffffffffffffffffff} to it
with {secret|`password=`aaa99aaa9}, and then
that {secret|`token = "`ffffffffffffffffffffffffffffffffffffffff`"`} of the
set {secret|`token="`ffffffffffffffffffffffff`"`} here
use {secret|`api_key=`ff99ffffffffffffffff99ff} now
a {secret|`AKIA`AAAAAA9AAAA9AAAA} here
key {secret|`AKIA`9AAAAAAAA9AAAAAA}, it was revoked
{secret|`secret=`aaaaaa99aaaa9999} and so on
the {secret|`ghp_`aaaaAAAA9999aaaaAAAA9999aaaaAAAA9999} was leaked
in 1998 and 2004 the price rose by 15 percent
Version 2.0. of the License, January 2004
pages 12-14, chapter 3, table 4.2 and figure 7
x = 5 and y = 12, so x + y = 17
they met at 10:30 on 2020-01-31 in room 204
about 1,200,000 people and 3.5 million more
a 4x4 matrix, B2B and H2O, 2nd and 3rd
see section 4.1.2 or item 10.2.1.
on 31.12.1999 it cost 12.50 or 1.299,00
the ISBN 9783161484100 book and order 123456
it is 100% of 50 = half @ best
price = 30; count=3, size=10
1 2 3 4 5 and 10 20 30 40 50
mail {email|aaaaaa(`at`)aaaaaaa.`org`} now
or {email|aaaa.aaaaa[`at`]aaaaaa.`com`}, thanks to you
{email|aaa@aaaa.`com`}, {email|a99(`at`)a.`org`} and {email|aa(`at`)aaa.aa.`net`}
write {email|aaaa [`at`] aaaaaaa [`dot`] `org`} about it
so {email|aaaaaa.aaa (`at`) aaaaa (`dot`) `net`}, is hers
ask {email|aaaaa [`at`] aaaaaa.`com`} today
the password: {secret|aaaaaaaaaaaaaaaa} is old
his token: {secret|aaaaaaaaaa}, not hers
Password: {secret|aaaaaa} and name
the passwd: {secret|AAAAaaaaaaaa}.
a secret = {secret|aaaaaaaaaaaaaa} in it
with {secret|`password=`aaaaaaaaaaaa} there
The password is reset by mail, and the token ring is a network
A secret garden; the key idea, a card game: call me later
She asked for the password, the secret token and the phone
(see above) and [sic], at the end (at least once) of it
He said: "Well, it's well-known" - and/or so, e.g. THIS OR THAT.
Dot by dot, at home. Look at it! What? Yes... the end
El niño y la niña; über die Straße, où est-il? ça va
name: John, title: Story, note: nothing to see
{none|aaaaaaaaa} the {none|aaaaaaaaaaaaaa} of {none|aaaaaaaaaaaaaaaaaaaa}, {none|aaaaaaaa}: {none|Aaaaaaaaaaa} {none|aaaaaaaaaaaaaaaaa}.
In {none|Aaaaaaaaaaaaa}; {none|aaaaaa aaaaaaaaaa} - {none|aaaaaaaaaaa.} {none|AAAAAAAAAA AAAAAAAAAAAA, AAAAAA! AAAAAAAAAAAAAAAA}
{none|aaaaaaaaaaaa*** aaaaaaa&&& aaa%%% aaaaaaaaaaaa,### aaaaaaaaa$$$ aaaaaa.***} {none|AAAAAA!! AAAAAAAA.!! AAAAAAAAAAAA,!!}
{none|aaaaaaaaaa.&&& Aaaaaaaaaaaaaa*** aaaaaaaa.### aaa aaaaaaaaaaa&&&}
{none|aaaaaaaaaaa} 999 {none|aaaaaaaaaaaa} 99, {none|aaaaaaaa aaaaaaaaaaaaa} {phone|+9 (999) 999-9999} {none|aaaaaaaaaa}
{none|aaaaaaaaa} {ip|99.99.99.99}, {none|aaaaaaaaaaaa aaaaaa} {email|aaaa.aa@aaaa.`com`} {none|aaaaaaaaaaaaa} {card|4999999999999999} {none|aaaaaaaaaaaa}
{none|aaaaaaaa aaaaaaaa.} {secret|`token = "`ffffffffffffffffffffffffffffffffffffffff`"`} {none|aaaaaaaaaa aaaaaaaaaaaaaaaa} | {none|aaaaaaaa} | {none|aaaaa}
{none|aaaaaaaaaa} {secret|`password=`aaa99aaa9}, {none|aaaaaaaaaaaaaa aaaa} {secret|`AKIA`AAAAAA9AAAA9AAAA} {none|aaaaaaaaaaa}
order {decoy|4999999999999999} was sent on the first
the number {decoy|9999999999999999}, and the code {decoy|999999999999} of it
{none|aaaaaaaa} {decoy|4999999999999999} {none|aaaaaaaaaaa} {decoy|5999999999999999}, {none|aaaaaaa}
id {decoy|9999 9999 9999 9999} and part {decoy|99999-99999-99999}
paid {card|5999999999999999}, order {decoy|5999999999999999} and {card|999999999999999}
"""
KEYS = frozenset("password passwd pwd token key secret apikey api_key auth bearer call phone tel card mail email".split())
SECRETS = frozenset("password passwd pwd passphrase token secret apikey api_key".split())
_ALPHABET = {"9": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "f": "0123456789abcdef"}


def labelled_table(copies: int = 8, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The sentences, `copies` times with other draws, as (text, spans)."""
    draw, out = random.Random(seed), []

    def drawn(pattern: str) -> str:
        pieces = enumerate(pattern.split("`"))
        return "".join(piece if k % 2 else "".join(draw.choice(_ALPHABET[c]) if c in _ALPHABET else c for c in piece) for k, piece in pieces)

    for _ in range(copies):
        for line in SENTENCES.strip().split("\n"):
            text, spans = "", []
            for part in re.split(r"(\{\w+\|[^{}]*\})", line):
                if not part.startswith("{"):
                    text += part
                    continue
                kind, pattern = part[1:-1].split("|", 1)
                shown = drawn(pattern)
                while kind in ("card", "decoy") and luhn("".join(_DIGITS.findall(shown))) != (kind == "card"):
                    shown = drawn(pattern)
                if kind in KINDS:
                    spans.append((len(text), len(text) + len(shown), kind))
                text += shown
            out.append((text, spans))
    return out


def shape(word: str) -> str:
    """Upper-case letters as X, others as x, digits as d, with runs shortened to their length class."""
    out = []
    for c in word[:64]:
        s = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c
        if out and out[-1][0] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return "".join(s + ("" if n == 1 else str(n) if s == "d" and n < 5 else "+" if n < 9 else "#") for s, n in out)


def marked(word: str) -> bool:
    return _MARKER.search(word) is not None


def _near(word: str) -> str:
    """What a neighbour looks like: the shape of a marked word, or a bracketed at or dot; others all look alike."""
    wrapped = _WRAPPED.fullmatch(word.rstrip(".,;:"))
    return shape(word) if marked(word) else wrapped[1].lower() if wrapped else "plain"


def _keyword(word: str) -> bool:
    return word.strip("\"'.,;:=()").lower() in KEYS


def _teller(word: str) -> int:
    """1 for a secret's key word that ends in a colon or equals sign, 2 for one that does not, 3 for the sign alone."""
    if word in (":", "="):
        return 3
    return (1 if word[-1] in ":=" else 2) if word.strip("\"'.,;:=()").lower() in SECRETS else 0


def _bare(word: str) -> str:
    return word.strip("\"'.,;:()[]")


def _checked(text: str) -> str:
    """Whether the digits of a text pass Luhn's check; "none" where they are not as many as a card has."""
    digits = _DIGITS.findall(text)
    return str(luhn("".join(digits))) if 12 <= len(digits) <= 19 else "none"


def _own_features(word: str) -> list[str]:
    digits, letters = len(_DIGITS.findall(word)), sum(c.isalpha() for c in word)
    bare = _bare(word)
    head = "plain" if not marked(word) and not (bare.isupper() and letters > 8) else bare[:4].lower() if bare[:1].isalpha() else shape(bare[:4])
    return [
        "bias", "shape=" + shape(word), "bare=" + shape(bare), f"len={min(len(bare), 48) // 4}", f"digits={min(digits, 20)}",
        f"mixed={digits > 0 and letters > 0}:{min(len(bare), 48) // 8}", "head=" + head, f"luhn={_checked(word)}:{letters > 0}",
        f"at={'@' in word}:{'.' in bare}", f"equals={'=' in word}:{len(bare) > 8}", f"wrapped={_WRAPPED.search(word) is not None}:{_near(word) in ('at', 'dot')}",
    ]


def _features(words: list[str], i: int) -> list[str]:
    """Features of the word i: its own, and those of the words beside it."""
    near = lambda j: _near(words[j]) if 0 <= j < len(words) else "none"
    keyed = any(_keyword(words[j]) for j in (i - 1, i - 2) if j >= 0)
    tellers = [_teller(words[j]) if j >= 0 else 0 for j in (i - 1, i - 2)]
    told = tellers[0] == 1 or tellers[0] == 3 and tellers[1] in (1, 2)
    long = len(_bare(words[i])) > 8
    return [*_own_features(words[i]), "before=" + near(i - 1), "after=" + near(i + 1), f"keyed={keyed}:{long}", f"told={told}"]


def words_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def _like(word: str) -> str:
    """A word of the same features: lower-case letters, after at most one capital and before punctuation, are as good as others."""
    stem = word.rstrip(_TAIL)
    if not stem.isalpha() or not (stem[1:].islower() or len(stem) == 1 and stem.islower()) or stem.lower() in KEYS or stem.lower() in SECRETS:
        return word
    return ("A" if stem[0].isupper() else "a") + "a" * (len(stem) - 1) + word[len(stem) :]


class Lexicon(dict):
    """The words seen so far, as numbers, with what the field's scores need of each. Number 0 is a text's border."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.size, self.kinds = field, 0, 0
        self.nears: dict[str, int] = {}
        self.beside = np.zeros((64, 2, len(LABELS)))  # a neighbour's share of the score when it stands before, and after
        self.own = np.zeros((1024, len(LABELS)))
        self.facts = np.zeros((1024, 4), np.int32)  # neighbour's look, key word, teller, longer than 8
        self._look("none")

    def _look(self, near: str) -> int:
        k = self.nears.setdefault(near, len(self.nears))
        if k >= len(self.beside):
            self.beside = np.concatenate([self.beside, np.zeros_like(self.beside)])
        self.beside[k] = [self.field.emission(["before=" + near]), self.field.emission(["after=" + near])]
        return k

    def __missing__(self, word: str) -> int:
        self.size += len(word) + 64
        like = _like(word)
        if like != word:
            k = self[word] = self[like]
            return k
        self.kinds += 1
        k = self.kinds
        if k >= len(self.own):
            self.own, self.facts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.own, self.facts))
        self.own[k] = self.field.emission(_own_features(word))
        self.facts[k] = self._look(_near(word)), _keyword(word), _teller(word), len(_bare(word)) > 8
        self[word] = k
        return k

    def numbers(self, text: str) -> list[np.ndarray]:
        """The numbers of the text's words; the words are held for a piece of the text at a time."""
        out, at = [], 0
        while at < len(text):
            space = _SPACE.search(text, at + _PIECE)
            end = space.start() if space else len(text)
            words = _WORD.findall(text, at, end)
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            at = end
        return out


#: Characters of a text that are split into words at once, words that are scored at once, and the size of a lexicon that is dropped.
_PIECE, _STEP, _LEXICON = 1 << 20, 1 << 17, 1 << 25


class Field:
    """A linear-chain conditional random field over the words of a text."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))
        self.lexicon: Lexicon | None = None

    def emission(self, features: list[str]) -> np.ndarray:
        return self.weights[self.rows(features)].sum(0)

    def rows(self, features: list[str]) -> list[int]:
        return [self.index[f] for f in features if f in self.index]

    def fit(self, table: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> Field:
        runs = []
        for text, spans in table:
            at = words_of(text)
            words = [text[a:b] for a, b in at]
            label = lambda a, b: next((LABELS.index(k) for s, e, k in spans if a < e and s < b), 0)  # noqa: B023, E731
            features = [_features(words, i) for i in range(len(words))]
            runs.append((features, [label(*p) for p in at]))
            for f in features:
                for x in f:
                    self.index.setdefault(x, len(self.index))
        self.weights = np.zeros((len(self.index), len(LABELS)))
        by_length = defaultdict(list)
        for features, labels in runs:
            by_length[len(labels)].append(([self.rows(f) for f in features], labels))
        speed_w, speed_m = np.full_like(self.weights, 1e-8), np.full_like(self.moves, 1e-8)
        for _ in range(rounds):
            grad_w, grad_m = -ridge * self.weights, -ridge * self.moves
            for own in by_length.values():
                rows = np.array([r for r, _ in own])
                self._gradient(rows, np.array([y for _, y in own]), grad_w, grad_m)
            speed_w += grad_w**2
            speed_m += grad_m**2
            self.weights += rate * grad_w / np.sqrt(speed_w)
            self.moves += rate * grad_m / np.sqrt(speed_m)
        return self

    def _gradient(self, rows: np.ndarray, labels: np.ndarray, grad_w: np.ndarray, grad_m: np.ndarray) -> None:
        """Adds the gradient of the log-likelihood of runs of one length: observed minus expected counts."""
        n, length, _ = rows.shape
        emit = self.weights[rows].sum(2)
        total = lambda x, axis: (m := x.max(axis, keepdims=True), np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis))[1]
        ahead = np.zeros_like(emit)  # outside precedes and follows every run
        back = np.zeros_like(emit)
        ahead[:, 0] = self.moves[0] + emit[:, 0]
        for t in range(1, length):
            ahead[:, t] = total(ahead[:, t - 1, :, None] + self.moves, 1) + emit[:, t]
        back[:, -1] = self.moves[:, 0]
        for t in range(length - 2, -1, -1):
            back[:, t] = total(self.moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        norm = total(ahead[:, -1] + back[:, -1], 1)
        likely = np.exp(ahead + back - norm[:, None, None])
        seen = np.eye(len(LABELS))[labels]
        for k in range(rows.shape[2]):
            np.add.at(grad_w, rows[:, :, k], seen - likely)
        grad_m[0] += (seen[:, 0] - likely[:, 0]).sum(0)
        grad_m[:, 0] += (seen[:, -1] - likely[:, -1]).sum(0)
        for t in range(1, length):
            pair = np.exp(ahead[:, t - 1, :, None] + self.moves + (emit[:, t] + back[:, t])[:, None, :] - norm[:, None, None])
            grad_m += np.einsum("ni,nj->ij", seen[:, t - 1], seen[:, t]) - pair.sum(0)

    def decode(self, runs: list[list[list[str]]]) -> list[list[int]]:
        """The best labels of each run of words, which are given by their features."""
        offsets = np.cumsum([0, *map(len, runs)])
        labels = self._best(np.array([self.emission(f) for run in runs for f in run]).reshape(-1, len(LABELS)), offsets).tolist()
        return [labels[a:b] for a, b in zip(offsets[:-1], offsets[1:])]

    def _best(self, emit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best labels of runs of scored words, emit[offsets[i]:offsets[i + 1]], by Viterbi over all runs side by side."""
        order = np.argsort(-np.diff(offsets), kind="stable")
        sizes, starts = np.diff(offsets)[order], offsets[:-1][order]
        out = np.zeros(len(emit), np.int64)
        came, label = [], np.zeros(len(sizes), np.int64)
        longest = int(sizes[0]) if len(sizes) else 0
        best = np.zeros((len(sizes), len(LABELS)))
        for t in range(longest):
            n = int(np.searchsorted(-sizes, -t, "left"))  # runs longer than t
            step = best[:n, :, None] + self.moves if t else np.broadcast_to(self.moves[0], (n, 1, len(LABELS)))
            came.append(step.argmax(1).astype(np.int8))
            best = step.max(1) + emit[starts[:n] + t]
            ended = sizes[:n] == t + 1
            label[:n][ended] = (best[ended] + self.moves[:, 0]).argmax(1)
        for t in range(longest - 1, -1, -1):
            n = len(came[t])
            out[starts[:n] + t] = label[:n]
            if t:  # runs that end before t keep their last label
                label[:n] = came[t][np.arange(n), label[:n]]
        return out

    def labelled(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the places among its words, and the labels, of the words that are not outside on the best path."""
        if self.lexicon is None or self.lexicon.size > _LEXICON:
            self.lexicon = Lexicon(self)
        lexicon, border = self.lexicon, np.zeros(2, np.int32)
        pieces, starts, at = [border], [], 2
        for text in texts:
            own = lexicon.numbers(text)
            starts.append(at)
            at += sum(map(len, own)) + 2
            pieces += [*own, border]
        words = np.concatenate(pieces)
        near, keyword, teller, long = lexicon.facts[words].T
        keyed = keyword[1:-1] | keyword[:-2]  # of the words from the third on, as below
        told = (teller[1:-1] == 1) | (teller[1:-1] == 3) & ((teller[:-2] == 1) | (teller[:-2] == 2))
        keyed_share = np.array([self.emission([f"keyed={k}:{b}"]) for k in (False, True) for b in (False, True)])
        told_share = np.array([self.emission([f"told={k}"]) for k in (False, True)])
        # what a label could gain at most over "outside" from the labels beside it
        gain = (self.moves - self.moves[:, :1]).max(0) + (self.moves - self.moves[:1]).max(1)
        places, emits = [], []
        for lo in range(2, len(words) - 2, _STEP):
            hi = min(lo + _STEP, len(words) - 2)
            emit = lexicon.own[words[lo:hi]] + lexicon.beside[near[lo - 1 : hi - 1], 0] + lexicon.beside[near[lo + 1 : hi + 1], 1]
            emit += keyed_share[2 * keyed[lo - 2 : hi - 2] + long[lo:hi]] + told_share[told[lo - 2 : hi - 2].astype(np.int8)]
            still = ((emit + gain)[:, 1:] >= emit[:, :1]).any(1) & (words[lo:hi] > 0)
            places.append(np.flatnonzero(still) + lo)
            emits.append(emit[still])
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not places:
            return out
        open_ = np.concatenate(places)
        offsets = np.concatenate([np.flatnonzero(np.diff(open_, prepend=-1) != 1), [len(open_)]])
        labels = self._best(np.concatenate(emits), offsets)
        real = labels > 0
        owner = np.searchsorted(np.array(starts), open_[real], "right") - 1
        for k, place, label in zip(owner.tolist(), open_[real].tolist(), labels[real].tolist()):
            out[k].append((place - starts[k], label))
        return out


def _spans_of(text: str, wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Starts and ends of some of the text's words, which are given by their places in ascending order."""
    out: list[tuple[int, int]] = []
    for i, m in enumerate(_WORD.finditer(text)):
        if len(out) == len(wanted):
            break
        if i == wanted[len(out)][0]:
            out.append(m.span())
    return out


def find_all(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans; the field's spans are what its runs leave beside the base spans."""
    bases = [base_spans(t) if t and _MARKER.search(t) else [] for t in texts]
    covered = [_covered(base) for base in bases]
    found: list[list[Span]] = [[] for _ in texts]
    for k, labels in enumerate(field.labelled(texts)):
        places = _spans_of(texts[k], labels) if labels else []
        i = 0
        while i < len(labels):
            j = i
            while j + 1 < len(labels) and labels[j + 1] == (labels[j][0] + 1, labels[i][1]):
                j += 1
            kind = labels[i][1] - 1
            left = _beside(texts[k], places[i : j + 1], covered[k])
            found[k] += [(a, kind, b) for a, b in left if KINDS[kind] != "card" or _checked(texts[k][a:b]) == "True"]
            i = j + 1
    return [(base, sorted(base + new)) for base, new in zip(bases, found)]


def _covered(base: list[Span]) -> tuple[list[int], list[int]]:
    """The starts and the ends of what the spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in base:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _beside(text: str, places: list[tuple[int, int]], base: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """What a run of words with one label leaves beside the base spans: the groups of words that meet none, and of a word that
    meets one the parts that a separator parts from it. (What touches a base span, as a port or a bracket, belongs to it.)"""
    starts, ends = base
    within = lambda a, b: range(bisect_right(ends, a), bisect_left(starts, b))
    met = bool(within(places[0][0], places[-1][1]))
    groups: list[tuple[int, int]] = []
    joins = False
    for a, b in places:
        if not (own := within(a, b)):
            groups[-1:] = [(groups[-1][0], b)] if joins else [*groups[-1:], (a, b)]
        else:
            parts = [m.span() for m in _PART.finditer(text, a, b)]
            groups += [(c, d) for c, d in parts if not within(c, d)]
        joins = not own
    spans = [_trimmed(text, a, b) for a, b in groups]
    return [(a, b) for a, b in spans if any(c.isalnum() for c in text[a:b])] if met else [(a, b) for a, b in spans if a < b]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the punctuation and the repeated signs around it."""
    while end > start and (text[end - 1] in ".,;:!?" or text[end - 1] in "#*&%$" and text[end - 2 : end - 1] == text[end - 1]):
        last = text[end - 1]
        while end > start and text[end - 1] == last:
            end -= 1
    while end > start and (text[start] in ",;:=#*&%$" or _SPACE.match(text[start])):
        start += 1
    return start, end


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added for every row of docs.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no spans. Spans are in code points, end
    exclusive, by start and then kind. Rows that repeat a doc_id are each searched; a null doc_id stays null. An empty table gives
    an empty result.
    """
    small_batches(docs.sparkSession)
    field = Field().fit(labelled_table())

    def run(batches):
        for batch in batches:
            for part in blocks([batch], "text"):
                rows = find_all([t or "" for t in part.column(1).to_pylist()], field)
                counts = [[sum(s[1] == k for s in base) for base, _ in rows] for k in range(len(BASE))]
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in counts)]
                columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()))
                columns.append(pa.array([joined(every) for _, every in rows], pa.string()))
                columns.append(pa.array([len(every) - len(base) for base, every in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced together by the first one's."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs with the spans of each text masked; all columns kept, n_chars (if there) set to the new length.

    Each row is masked by itself, so repeated rows and repeated or null ids make no difference. Null texts stay null, empty ones
    empty; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    field = Field().fit(labelled_table())

    def run(batches):
        for batch in batches:
            for part in blocks([batch], "text"):
                i = part.schema.get_field_index("text")
                texts = part.column(i).to_pylist()
                rows = find_all([t or "" for t in texts], field)
                new = [t if t is None else masked(t, every) for t, (_, every) in zip(texts, rows)]
                columns = [pa.array(new, pa.string()) if k == i else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
