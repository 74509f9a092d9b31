"""Keyword-stuffed and link-list pages, by the perplexity of their function-word and word-class sequence.

A text becomes a sequence of some thirty symbols: kinds of function words, content words (new, heard again
within the last words, or just said), numbers, links, tags and punctuation. Trigram models of that alphabet, one a
language or script, are trained on the prose of the corpus itself. Prose follows them; lists of keywords,
tags, labels and links, and sentences that go round the same keywords, don't.

Texts are cut into tokens once, by classes of code points in whole blocks, and written as numbers; learning and
scoring are array operations over those.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch

# The closed word classes of four languages, by kind; the adverbs are the frequent ones.
ENGLISH = {
    "determiner": "a an the this that these those each every either neither no any some all both half such another other my your his her its our their whose",
    "preposition": "of in on at by for with from to into onto after before during about like as between within without over under above below against among through across along around behind beside beyond near off out past since than toward towards until till upon via per despite except",
    "conjunction": "and or but nor so yet because while if when where which who whom what why how whether though although unless whereas then once",
    "pronoun": "i you he she it we they me him us them myself yourself himself herself itself ourselves themselves one someone anyone everyone nobody nothing something anything everything mine yours ours theirs there here",
    "verb": "am is are was were be been being have has had having do does did done will would shall should can could may might must ought cannot",
    "adverb": "not only also just even still again already too very much more most less least up down now never always often rather quite almost really perhaps maybe",
}
FRENCH = {
    "determiner": "le la les l un une des ce cet cette ces mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs chaque tout toute tous toutes aucun aucune quelques plusieurs quel quelle",
    "preposition": "de du d à au aux en dans sur sous par pour avec sans vers chez entre contre depuis pendant avant après selon malgré jusque dès hors parmi",
    "conjunction": "et ou mais donc or ni car que qu qui dont où quand lorsque puisque si comme alors",
    "pronoun": "je j tu il elle on nous vous ils elles me te se lui eux y ça cela ceci celui celle ceux moi toi soi rien personne",
    "verb": "est sont était étaient être été suis sommes sera serait ont a avait avaient avoir ai avons avez aura aurait fait peut doit faut va",
    "adverb": "n ne pas plus moins très aussi encore déjà toujours jamais souvent bien trop peu presque ici là",
}
GERMAN = {
    "determiner": "der die das den dem des ein eine einen einem einer eines kein keine keinen dieser diese dieses diesen diesem jeder jede jedes jeden jener mein dein sein seine seinen seiner ihr ihre ihren ihrer unser unsere euer welche welcher alle einige",
    "preposition": "von bei nach vor aus auf für über um im am in an ans ins zu zum zur mit ohne unter zwischen durch gegen seit bis neben hinter wegen trotz während ab",
    "conjunction": "und oder aber denn dass weil wenn ob als wie was wer wo sondern doch obwohl damit bevor nachdem sobald weshalb warum",
    "pronoun": "ich du er sie es wir mich dich ihn uns euch mir dir ihm ihnen sich man niemand jemand nichts etwas alles",
    "verb": "ist sind war waren bin bist sein wird werden wurde wurden worden hat haben hatte hatten habe kann können konnte muss müssen soll sollte will darf mag",
    "adverb": "nicht nur auch noch schon nun dann da hier sehr mehr so immer nie kaum wieder erst später trotzdem fast",
}
SPANISH = {
    "determiner": "el la los las un una unos unas este esta estos estas ese esa esos esas aquel aquella su sus mi mis tu tus nuestro nuestra cada todo toda todos todas ningún otro otra",
    "preposition": "de del en por para con sin al a ante bajo contra desde durante entre hacia hasta según sobre tras cerca",
    "conjunction": "y e o u pero sino que qué si porque cuando donde como aunque mientras pues ni quien cual así cómo",
    "pronoun": "yo tú él ella nosotros ellos ellas me te se lo le les nos usted ustedes algo nada nadie alguien eso esto",
    "verb": "es son era eran ser sido está están estaba estar fue fueron será ha han había haber he hay puede pueden debe tiene",
    "adverb": "no ya más menos muy también tampoco siempre nunca casi aún todavía sólo solo bien tan ahora luego aquí",
}
FUNCTION_WORDS = {"en": ENGLISH, "fr": FRENCH, "de": GERMAN, "es": SPANISH}
KINDS = list(ENGLISH)
#: Scripts by the first words of their characters' names; the last stands for all others.
SCRIPTS = ["LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "other"]
#: Ranges of scripts that put no spaces between words: each character counts as a word.
LONE = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)]

# Kinds of function words, those learned for a script last; content words as new, heard again, just said, in three spellings.
SYMBOLS = [
    "start", *KINDS, "frequent", "new", "again", "soon", "New", "Again", "Soon", "UPPER", "UPPER AGAIN", "UPPER SOON", "other script", "letter", "number", "code", "link", "tag", "handle",
    "end", "comma", "colon", "bracket", "dash", "bar", "sign",
]
CODE = {k: i for i, k in enumerate(SYMBOLS)}
SIZE = len(SYMBOLS)
FUNCTION = CODE["frequent"]  # the last of them
NEW = np.array([CODE["new"], CODE["New"], CODE["UPPER"]])
HEARD = np.concatenate([NEW + 1, NEW + 2])
#: Symbols of data listings, logs and code.
DATA = [CODE["number"], CODE["code"]]
#: What a token may be besides a symbol: a mark of who speaks, and pictures, which say nothing about the sentence.
SPEAKER, SKIP = SIZE, SIZE + 1

_OPENING = re.compile(
    r"(?m)^[ \t]*(?:(?:[-*•>|#+~=/]+|\d{1,3}[.)]|\[[\d:. -]{4,20}\]|\[?\d{1,2}:\d\d\]?)[ \t]+)+(\**[^\W\d]\w{0,15}[:?]\**[ \t]+)?"
    r"|^[ \t]*(\**[^\W\d]\w{0,15}[:?]\**[ \t]+)"
)
_MARKUP = re.compile(r"<a\s[^<>]*?href\s*=\s*[\"']?([^\"'\s<>]+)[^<>]*>|</?[a-zA-Z][^<>]{0,80}>")
#: A link reaches to a blank, a quote or a closing bracket.
_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.IGNORECASE)
_MEASURE = re.compile(r"\d+[a-zA-Z]{1,2}|\d+T\d+")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤︀-️﻿‍]")
_PUNCTUATION = {c: CODE[k] for k, cs in {
    "end": ".!?…。！？؟।", "comma": ",;،、", "colon": ":", "bracket": "()[]{}\"'«»“”„‘’`", "dash": "-–—", "bar": "|/\\•*·~+=>→»_",
}.items() for c in cs}
# Letters of other scripts and digits that stand for Latin letters.
_ALIKE = str.maketrans("авекмнорстухіјѕԁԛԝһαεικνορτυχ", "abekmhopctyxijsdqwhaeiknoptux")
_LEET = str.maketrans("0134578@$", "oieastbas")


def cleaned(text: str | None) -> str:
    """The text behind a line break, without invisible characters, markup, and what opens a line and is no part of its sentence.

    That is numbering, bullets, quote marks and times; a speaker or a heading's term becomes a mark.
    """
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", t))
    t = t.replace("\x02", " ")
    if "\\" in t:
        t = _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else "\n", t)
    if "<" in t:
        t = _MARKUP.sub(lambda m: f" {m[1]} " if m[1] else " ", t)
    return "\n" + _OPENING.sub(lambda m: "\x02" if m[1] or m[2] else "", t)


#: Classes of code points: none, word, word by itself, joiner (within a word), prefix (of a word), sign by itself.
_NONE, _WORD, _ALONE, _JOINER, _PREFIX, _SIGN, _UNSEEN = range(7)
_CLASSES = np.full(0x110000, _UNSEEN, np.uint8)


def _class_of(c: str) -> int:
    if c.isalnum():
        return _ALONE if any(a <= ord(c) <= b for a, b in LONE) and c.isalpha() else _WORD
    if c in "_…":
        return _JOINER
    return _PREFIX if c in "#@" else _SIGN if c in "\n\x02" or not (c.isspace() or unicodedata.category(c)[0] in "MCZ") else _NONE


def classes(points: np.ndarray) -> np.ndarray:
    out = _CLASSES[points]
    if (out == _UNSEEN).any():
        for p in np.unique(points[out == _UNSEEN]):
            _CLASSES[p] = _class_of(chr(p))
        out = _CLASSES[points]
    return out


def _links(text: str) -> np.ndarray:
    """Whether each character is part of a link."""
    change = np.zeros(len(text) + 1, np.int8)
    for m in _LINK.finditer(text):
        change[m.start()], change[m.end()] = 1, -1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


def tokenise(texts: Sequence[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each token, the different tokens by number, tokens of each text)."""
    parts = [cleaned(t) for t in texts]
    text = "".join(parts)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int32), [], np.zeros(len(parts), np.int64)
    kind, link = classes(points), _links(text)
    word = kind == _WORD
    after, before = np.append(word[1:], False), np.concatenate([[False], word[:-1]])
    word |= (kind == _JOINER) & after & before
    prefix = (kind == _PREFIX) & after & ~before
    held = word | link | prefix | (kind >= _ALONE)
    goes_on = (word[1:] & (word[:-1] | prefix[:-1]) & ~link[1:] & ~link[:-1]) | (link[1:] & link[:-1])
    starts = np.flatnonzero(held & ~np.concatenate([[False], goes_on]))
    last = np.flatnonzero(held & ~np.append(goes_on, False))
    # A polynomial hash of each token from sums over all, mixed so that order and letters tell.
    size = len(points)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(0x9E3779B97F4A7C15))]), dtype=np.uint64)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power[:size], dtype=np.uint64)])
    number = (total[last + 1] - total[starts]) * power[size - last]  # all to the same power
    codes, kinds = pd.factorize(number)
    where = np.empty(len(kinds), np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    tokens = [text[a:b] for a, b in zip(starts[where].tolist(), (last[where] + 1).tolist(), strict=True)]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return codes.astype(np.int32), tokens, np.diff(np.searchsorted(starts, edges))


def script_of(word: str) -> int:
    name = unicodedata.name(word[0], "")
    return next((i for i, s in enumerate(SCRIPTS) if name.startswith(s)), len(SCRIPTS) - 1)


@lru_cache(maxsize=400_000)
def look(token: str) -> tuple[int, str, int]:
    """(symbol of a token, the word by which it is known again, its script); the symbols of words are those of content words."""
    c = token[0]
    if token == "\n":
        return CODE["start"], "", 0
    if token == "\x02":
        return SPEAKER, "", 0
    if not c.isalnum():
        if len(token) > 1:
            return CODE["tag" if c == "#" else "handle"], "", 0
        sign = _PUNCTUATION.get(c, CODE["sign"])
        return (SKIP if sign == CODE["sign"] and unicodedata.category(c)[0] == "S" else sign), "", 0
    low = token.lower()
    if low.startswith(("http://", "https://", "www.")):
        return CODE["link"], "", 0
    if "_" in token:
        return CODE["code"], "", 0
    script = 0
    if not low.isascii():
        if any("a" <= x <= "z" for x in low):
            low = low.translate(_ALIKE)
        elif script := script_of(low):
            latin = low.translate(_ALIKE)
            if latin.isascii():  # every letter stands for a Latin one
                low, script = latin, 0
    digits, letters = sum(x.isdigit() for x in token), sum(x.isalpha() for x in token)
    if low in ("null", "true", "false", "nan") or not letters or _MEASURE.fullmatch(token):
        return CODE["number"], "", script
    if "…" in token or len(token) > 24 or (digits > 1 and len(token) > 14):
        return CODE["code"], "", script
    if len(low) == 1 and not script:
        return CODE["letter"], low, 0
    spelling = "UPPER" if token.isupper() and (digits or letters < 6) else "New" if c.isupper() else "new"
    return CODE[spelling], low.translate(_LEET) if any(x.isalpha() for x in low) and not script else low, script


class Lexicon:
    """Function words: symbol and languages (a bit each; scripts follow the languages)."""

    def __init__(self, function_words: Mapping[str, Mapping[str, str]], learned: Mapping[int, Sequence[str]]):
        self.languages = list(function_words)
        self.words: dict[str, tuple[int, int]] = {}
        for bit, kinds in enumerate(function_words.values()):
            for kind, ws in kinds.items():
                for w in ws.split():
                    symbol, bits = self.words.get(w, (CODE[kind], 0))
                    self.words[w] = symbol, bits | 1 << bit
        #: Scripts that prose was found in; words of others say nothing.
        self.scripts = frozenset(learned)
        self.frequent = {(s, w) for s, ws in learned.items() for w in ws}
        self.models = len(self.languages) + len(SCRIPTS)

    def symbol(self, token: str) -> tuple[int, str, int, int]:
        """(symbol, identity, languages, script); a function word has no identity, as it is never heard again."""
        symbol, stem, script = look(token)
        if not stem:
            return symbol, "", 0, script
        if script:
            if script not in self.scripts:
                return CODE["other script"], "", 0, script
            bits = 1 << len(self.languages) + script
            return (FUNCTION, "", bits, script) if (script, stem) in self.frequent else (symbol, stem, bits, script)
        known = self.words.get(stem) or self.words.get(token.lower())
        return (known[0], "", known[1], 0) if known else (symbol, stem if symbol != CODE["letter"] else "", 0, 0)


class Reading:
    """The symbols of a block of tokenised texts, as arrays over their tokens."""

    def __init__(self, codes: np.ndarray, tokens: list[str], sizes: np.ndarray, lexicon: Lexicon, memory: int = 40, lately: int = 8):
        known = [lexicon.symbol(t) for t in tokens]
        column = lambda i, kind: np.array([k[i] for k in known], kind)
        symbol, owner = column(0, np.int64)[codes], np.repeat(np.arange(len(sizes)), sizes)
        line = np.cumsum(symbol == 0) - 1
        spoken = np.zeros(line[-1] + 1 if len(line) else 0, bool)
        spoken[line[symbol == SPEAKER]] = True
        kept = symbol < SIZE
        codes, line = codes[kept], line[kept]
        self.symbol, self.owner = symbol[kept], owner[kept]
        self.chars = np.array([len(t) if k[0] else 0 for t, k in zip(tokens, known, strict=True)], np.float64)[codes]
        self.languages, self.script = column(2, np.int64)[codes], column(3, np.int64)[codes]
        stems, _ = pd.factorize(np.array([k[1] for k in known], object))
        blank = np.array([not k[1] for k in known], bool)
        ident = np.where(blank, -1, stems)[codes]
        # Letters in a row are a spaced-out word, also those that are words by themselves.
        single = (self.symbol > 0) & (self.symbol < CODE["end"]) & (self.chars == 1) & (self.symbol != CODE["number"]) & (self.script == 0)
        beside = np.append(single[1:], False) | np.concatenate([[False], single[:-1]])
        letters = single & beside
        self.symbol[letters], self.languages[letters], ident[letters] = CODE["letter"], 0, -1
        self.first = self.symbol == 0
        self.word = (self.symbol > 0) & (self.symbol < CODE["end"])
        self._lines(line, spoken)
        self._heard(ident, memory, lately)

    def _lines(self, line: np.ndarray, spoken: np.ndarray) -> None:
        """``silent``: tokens of lines that say nothing of a page's prose; ``broken``: last tokens of short lines without an end.

        Silent are lines of numbers and codes, and lines of under four words that a speaker opens ("gm").
        """
        count = lambda mask: np.bincount(line[mask], minlength=len(spoken))
        words, data = count(self.word), count(np.isin(self.symbol, DATA))
        self.silent = ((spoken & (words < 4)) | (data >= 0.4 * words) & (words > 0))[line]
        last = np.append(line[1:] != line[:-1], True) if len(line) else np.zeros(0, bool)
        self.broken = last & ((words > 0) & (words < 8) & ~spoken)[line] & ~np.isin(self.symbol, [0, CODE["end"], CODE["colon"]])

    def _heard(self, ident: np.ndarray, memory: int, lately: int) -> None:
        """Content words heard within the last ``memory`` words of their document become *again*, within the last ``lately`` *soon*."""
        words = np.flatnonzero(ident >= 0)
        order = words[np.lexsort((words, ident[words], self.owner[words]))]
        counted = np.cumsum(self.word)
        same = (ident[order[1:]] == ident[order[:-1]]) & (self.owner[order[1:]] == self.owner[order[:-1]])
        ago = counted[order[1:]] - counted[order[:-1]]
        self.symbol[order[1:]] += np.where(same & (ago <= lately), 2, np.where(same & (ago <= memory), 1, 0))

    def sentences(self) -> np.ndarray:
        """A number per sentence or line, for choosing what to learn from."""
        ends = np.concatenate([[True], self.symbol[:-1] == CODE["end"]])[: len(self.symbol)] | self.first
        return np.cumsum(ends) - 1

    def prose(self, languages: int, least_words: int = 6, least_function: float = 0.25, most_soon: float = 0.25) -> np.ndarray:
        """The model (a language by its function words, or a script) of each token that lies in prose, -1 elsewhere.

        Prose are whole sentences of three or more words with few numbers, links and tags; where the classes are known beforehand,
        of ``least_words`` or more with enough function words, and such as say something new.
        """
        seg = self.sentences()
        if not len(seg):
            return np.zeros(0, np.int64)
        n = seg[-1] + 1
        count = lambda mask: np.bincount(seg[mask], minlength=n)
        w, f = count(self.word), count((self.symbol > 0) & (self.symbol <= FUNCTION))
        whole = (count(self.symbol == CODE["end"]) > 0) & (count(np.isin(self.symbol, [CODE["link"], CODE["tag"], *DATA])) <= 0.2 * np.maximum(w, 1)) & (w >= 3)
        votes = np.stack([count(self.languages & 1 << i > 0) for i in range(max(languages, 1))])
        content, soon = count(np.isin(self.symbol, [*NEW, *HEARD])), count(np.isin(self.symbol, NEW + 2))
        out = np.where(whole & (w >= least_words) & (f >= least_function * w) & (soon <= most_soon * content), votes.argmax(axis=0), -1)
        foreign = self.word & (self.script > 0)
        if foreign.any():
            by_script = np.stack([count(foreign & (self.script == s)) for s in range(len(SCRIPTS))])
            out = np.where(whole & (by_script.max(axis=0) > 0.5 * w), languages + by_script.argmax(axis=0), out)
        return out[seg]

    def trigrams(self) -> np.ndarray:
        padded = np.concatenate([[0, 0], self.symbol])
        before = np.where(padded[1:-1] == 0, 0, padded[:-2])  # nothing reaches back over a line's start
        return (before * SIZE + padded[1:-1]) * SIZE + padded[2:]


class Model:
    """Interpolated trigram models of the alphabet, by language or script; ``bits`` holds the surprisal of each trigram, relative to prose."""

    def __init__(self, counts: np.ndarray, back: float = 20.0, most: float = 7.0, break_bits: float = 4.0):
        #: Surprisal of a line that ends before its sentence does; lines aren't part of the trigrams.
        self.break_bits = break_bits
        self.bits: dict[int, np.ndarray] = {}
        for i, c3 in enumerate(counts.reshape(-1, SIZE, SIZE, SIZE).astype(np.float64)):
            c2, c1, total = c3.sum(axis=0), c3.sum(axis=(0, 1)), c3.sum()
            if not total:
                continue
            p1 = (c1 + 0.5) / (total + 0.5 * SIZE)
            p2 = (c2 + back * p1) / (c2.sum(axis=1, keepdims=True) + back)
            p3 = (c3 + back * p2) / (c3.sum(axis=2, keepdims=True) + back)
            # What was hardly ever seen is odd, how odd can't be told: surprisal ends at ``most`` bits.
            bits = np.minimum(-np.log2(p3), most).ravel()
            self.bits[i] = bits - (c3.ravel() * bits).sum() / total


def local_mean(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mean of ``x`` over each token's stretch [lo, hi)."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    return (total[hi] - total[lo]) / np.maximum(hi - lo, 1)


def odd_shares(
    r: Reading, n: int, languages: int, model: Model, high: float = 0.65, low: float = 1.5, half: int = 14, data_share: float = 0.3,
    function_share: float = 0.2, again_share: float = 0.65,
) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the share of its characters in odd stretches; its mean surprisal. See ``page_scores``."""
    total = np.bincount(r.owner, weights=r.chars, minlength=n)
    foreign = r.symbol == CODE["other script"]
    # A word of an unknown script is neither odd nor usual: the models haven't learned it. What follows it neither.
    neutral = np.concatenate([[False], foreign[:-1]])[: len(foreign)] | r.silent
    known = ~r.first & ~foreign
    at, broken, neutral = r.trigrams()[known], r.broken[known], neutral[known]
    symbol, chars, owner, script = r.symbol[known], r.chars[known], r.owner[known], r.script[known]
    if not model.bits or not len(symbol):
        return np.zeros(n), np.zeros(n)
    place = np.arange(len(symbol))
    lo = np.maximum(place - half, np.searchsorted(owner, owner, side="left"))
    hi = np.minimum(place + half + 1, np.searchsorted(owner, owner, side="right"))
    near = lambda mask: local_mean(mask.astype(np.float64), lo, hi)
    count = lambda w: np.bincount(owner, weights=w, minlength=n)
    # A document in a script with a model is held against that one, others against the language in which a stretch is least odd.
    word = symbol < CODE["end"]
    own = np.full(n, -1)
    for i in [i for i in model.bits if i >= languages]:
        own[count((script == i - languages) & word) > 0.5 * count(word)] = i
    around = np.full(len(symbol), np.inf)
    for i, bits in model.bits.items():
        mean = local_mean(np.where(neutral, 0.0, bits[at] + model.break_bits * broken), lo, hi)
        mine = own[owner] == (i if i >= languages else -1)
        around = np.where(mine, np.minimum(around, mean), around)
    around[~np.isfinite(around)] = 0.0  # no model of any language
    words, heard, function = near(word), near(np.isin(symbol, HEARD)), near(symbol <= FUNCTION)
    content = heard + near(np.isin(symbol, NEW))
    abnormal = (around > high) | (around < -low)
    # The check on what the model finds: prose has function words and says new things. Of what a script's frequent words
    # make up the second isn't asked: they are content words as well.
    circling = (heard > again_share * content) & (own[owner] < 0)
    odd = abnormal & ((function < function_share * words) | circling) & (near(np.isin(symbol, DATA)) < data_share * words)
    # A page is judged by the bits of its odd stretches' content words (also spaced-out ones), links and tags: as many as a whole stretch at the
    # threshold has, of which one token gives four at most. Codes, numbers and punctuation are no evidence of stuffing.
    telling = odd & np.isin(symbol, [*NEW, *HEARD, CODE["letter"], CODE["link"], CODE["tag"]])
    judged = count(telling * np.minimum(np.abs(around), 4.0)) >= high * (2 * half + 1)
    share = np.divide(count(chars * odd), total, out=np.zeros(n), where=(total > 0) & judged)
    return share, count(around) / np.maximum(np.bincount(owner, minlength=n), 1)


def blocks(texts: list[str | None], most_chars: int) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of about ``most_chars`` characters, a longer text by itself."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t or "") > most_chars:
            yield start, i
            start, chars = i, 0
        chars += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def read_pages(documents: DataFrame, id_col: str, text_col: str, block_chars: int = 1_000_000) -> DataFrame:
    """The tokenised texts, one row a block: ``ids``, ``sizes``, ``codes``, ``tokens``, and ``words``, for ``frequent_words``.

    ``words``: (script, word, sentences) over the prose in other scripts than Latin, and by the empty word all its sentences.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    plain = Lexicon({}, {s: [] for s in range(1, len(SCRIPTS))})
    word_type = pa.struct([("script", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for start, stop in blocks(texts, block_chars):
                codes, tokens, sizes = tokenise(texts[start:stop])
                found = _foreign_words(codes, tokens, sizes, plain)
                ids = pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), b.column(0).slice(start, stop - start))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([sizes], pa.list_(pa.int32())), pa.array([codes], pa.list_(pa.int32())), pa.array([tokens], pa.list_(pa.string())), pa.array([found], pa.list_(word_type))],
                    names=["ids", "sizes", "codes", "tokens", "words"])

    return documents.select(id_col, text_col).mapInArrow(run, f"ids array<{kind}>, sizes array<int>, codes array<int>, tokens array<string>, words array<struct<script: int, word: string, n: long>>")


def _foreign_words(codes: np.ndarray, tokens: list[str], sizes: np.ndarray, plain: Lexicon) -> list[dict]:
    scripts = np.array([look(t)[2] for t in tokens], np.int64)
    held = np.zeros(len(sizes), bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    held[owner[scripts[codes] > 0]] = True
    if not held.any():
        return []
    some = held[owner]
    r = Reading(codes[some], tokens, sizes[held], plain)
    model, seg = r.prose(0), r.sentences()
    used = (model >= 0) & r.word & (r.script > 0)
    kept = codes[some][np.array([look(t)[0] < SIZE for t in tokens], bool)[codes[some]]]
    pairs = np.unique(np.stack([seg[used], kept[used]], axis=1), axis=0)
    out: dict[tuple[int, str], int] = {}
    for k, n in zip(*np.unique(pairs[:, 1], return_counts=True), strict=True):
        _, stem, script = look(tokens[k])
        out[script, stem] = out.get((script, stem), 0) + int(n)
    for script, n in zip(*np.unique(np.unique(np.stack([seg[used], r.script[used]], axis=1), axis=0)[:, 1], return_counts=True), strict=True):
        out[int(script), ""] = int(n)
    return [{"script": s, "word": w, "n": n} for (s, w), n in out.items()]


def frequent_words(pages: DataFrame, share: float = 0.02, least_sentences: int = 50) -> dict[int, list[str]]:
    """By script the words of ``share`` or more of its sentences; scripts with fewer than ``least_sentences`` aren't learned.

    These stand for the function words of a script: they are told by frequency and dispersion alone. Their number
    is bounded by the words of a sentence over ``share``.
    """
    counts = pages.select(F.explode("words").alias("x")).groupBy("x.script", "x.word").agg(F.sum("x.n").alias("n"))
    whole = counts.where("word = ''").select(F.col("script").alias("of"), F.col("n").alias("all"))
    rows = counts.join(F.broadcast(whole), F.col("script") == F.col("of")).where((F.col("all") >= least_sentences) & (F.col("n") >= share * F.col("all")))  # one row a script
    out: dict[int, list[str]] = {}
    for r in rows.collect():
        out.setdefault(r["script"], []).extend([r["word"]] if r["word"] else [])
    return out


def _readings(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[tuple[pa.Array, int, Reading]]:
    for b in batches:
        for i in range(b.num_rows):
            ids, sizes, codes, tokens = (b.column(c).slice(i, 1).flatten() for c in range(4))
            n = sizes.to_numpy(zero_copy_only=False)
            yield ids, len(n), Reading(codes.to_numpy(zero_copy_only=False), tokens.to_pylist(), n, lexicon)


def count_prose(pages: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Trigram counts of the corpus's prose: at most ``SIZE`` ** 3 rows a language (``code``, ``n``), summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(lexicon.models * SIZE**3, np.int64)
        for _, _, r in _readings(batches, lexicon):
            model = r.prose(len(lexicon.languages))
            used = (model >= 0) & ~r.first
            counts += np.bincount(model[used] * SIZE**3 + r.trigrams()[used], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["code", "n"])

    return pages.select("ids", "sizes", "codes", "tokens").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def page_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", function_words: Mapping[str, Mapping[str, str]] = FUNCTION_WORDS, **options) -> DataFrame:
    """``id_col``, ``odd_share`` (of the text's characters) and ``surprisal`` (mean bits a token above that of prose) of every row.

    Whole texts are cut into tokens once and written; two passes over these follow. One counts the trigrams of the prose of all
    documents (sentences with a quarter or more function words and few numbers or links), of which at most some
    ten thousand numbers a language, bounded by the alphabet, come to the driver; one scores all texts. A stretch (a token with
    ``half`` neighbours on each side) is abnormal if its mean surprisal is more than ``high`` bits above
    the mean of prose, or more than ``low`` below it, in the language in which it is least so, unless ``data_share`` of its words are
    numbers and codes. It is odd if moreover less than ``function_share`` of its words are function words, or more
    than ``again_share`` of its content words were heard shortly before. ``options`` are these, by name.

    A text counts if the content words, links and tags of its odd stretches hold as many bits as a whole stretch at
    the threshold, ``high`` * (2 ``half`` + 1): five bare links or a dozen keywords do, a short sentence doesn't.

    ``function_words`` are the closed classes of the languages written in Latin letters (language, kind, words). For any other script
    the words of most sentences are learned from its own prose (``frequent_words``), and it has a model of its own.
    Null, empty and blank texts have share 0; so has any text if the corpus holds no prose of its kind to learn
    from: in Latin letters, or fifty sentences in another script. Empty tables give no rows.
    """
    pages = Scratch(documents.sparkSession, "pages").save(read_pages(documents, id_col, text_col))
    lexicon = Lexicon(function_words, frequent_words(pages))
    counts = np.zeros(lexicon.models * SIZE**3)
    for r in count_prose(pages, lexicon).collect():
        counts[r["code"]] = r["n"]
    model = Model(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, r in _readings(batches, lexicon):
            share, mean = odd_shares(r, n, len(lexicon.languages), model, **options)
            yield pa.RecordBatch.from_arrays([ids, pa.array(share), pa.array(mean)], names=[id_col, "odd_share", "surprisal"])

    schema = f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, odd_share double, surprisal double"
    return pages.select("ids", "sizes", "codes", "tokens").mapInArrow(run, schema)


def stuffed_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.5, **options) -> DataFrame:
    """``page_scores`` of the pages of which more than ``least_share`` is odd."""
    return page_scores(documents, id_col, text_col, **options).where(F.col("odd_share") > least_share)
