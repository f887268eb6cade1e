"""Toxicity with noisy-channel deobfuscation.

Tokens that cannot be read plainly, and runs of pieces whatever parts them, become lattices of what each
character may stand for: itself, the letters it is used for, or nothing (a separator, a repetition). Only those
are left out of which no reading holds a word of the classifier, where a run starts with a piece and its symbols
are all letters or all separators (within a token they may be both). Letters may be accented, wide, circled or
of another alphabet. Viterbi decoding finds the likeliest reading under a trigram character model, trained on
the letters of all documents and on the words of the classifier. The restored text is then scored: the log odds of the words, and beginnings of words, that toxic texts hold more often than chance
allows (copies of a text count once), added to those of the labels.

Labels are read only where the caller says that a row may be learnt from; the classifier is fitted on at
most `sample_rows` labelled rows (chosen by a seeded hash of the id). Character counts cover all documents.
Labels, lang, source and ids are no inputs of a score.

Rows: null and empty texts get the score of a text without words of the classifier. Repeated rows stay. A
null id is held out of nothing and has no label. Of different labels for an id the highest holds; of rows that
share a labelled id one text (that of the least hash) is learnt from. Without any labelled row, or without
toxic or other ones, every text gets the share of toxic labels (0 without labels). Empty tables give empty
results. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.llm.kernel import BASE, NOT_ALNUM, Words, mix, signed, slices, text_bytes
from kvloom.llm.shared import checkpointed

#: What characters of obfuscated words may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
    "а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}


def compatible(fixed: dict[str, str]) -> dict[str, str]:
    """What lower-case characters stand for whose compatibility form is a letter, or a digit that stands for letters: accented, wide, circled, mathematical."""
    out = {}
    for i in range(0x80, 0x20000):
        c = chr(i)
        form = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if c == c.lower() and c not in fixed and len(form) == 1 and form.isascii() and form.isalnum():
            out[c] = form if form.isalpha() else fixed[form]
    return out


STANDS_FOR |= compatible(STANDS_FOR)
SYMBOL = r"0-9@$!|+(<€£¡*#%"
#: For restored texts only; scoring looks at all tokens and runs. Four or more characters that stand apart; else a place that makes its whole token suspicious: a symbol before a
#: letter, final digits, a joint between letters, a letter three times in a row.
SUSPICIOUS = re.compile(
    rf"(?P<apart>(?<![^\W\d_])(?:[^\W\d_]|[{SYMBOL}])(?:[ .\-_*~\u200b\u00ad]{{1,2}}(?:[^\W\d_]|[{SYMBOL}])(?![^\W\d_])){{3,}})"
    rf"|[{SYMBOL}](?=[^\W\d_])|(?<=[^\W\d_])[0-9]+(?!\w)|(?<=[^\W\d_])[\-_*~\u00ad\u200b-\u200d\u2060](?=[^\W\d_])|([^\W\d_])\2\2"
)
#: Letters that one character may stand for count as one in a skeleton.
CLASS = {c: "a" for c in "aeioul"} | {"g": "b"}


#: Below this code point characters are looked up in tables; no blank lies above.
LOW = 0x3001
SPACE = np.array([chr(i).isspace() for i in range(LOW)] + [False])
#: Parts the texts of a slice in their common skeleton.
PARTING = 1


class Skeleton(dict):
    """For str.translate: a letter's class; nothing for what may be a separator (symbols: or what they stand for)."""

    def __init__(self, symbols: bool):
        super().__init__()
        self.symbols = symbols
        self.low = np.array([self.code(i) for i in range(LOW)] + [0], np.uint32)

    def code(self, point: int) -> int:
        """The class of a code point as one, 0 for nothing."""
        return ord(self[point]) if self[point] else 0

    def of(self, codes: np.ndarray, parting: np.ndarray) -> tuple[str, np.ndarray]:
        """The skeleton of a text of code points, each run of a class as one, and where each run begins; parting: places of PARTING."""
        classes = self.low[np.minimum(codes, LOW)]
        for point in np.unique(codes[codes >= LOW]).tolist():
            classes[codes == point] = self.code(point)
        classes[parting] = PARTING
        kept = np.flatnonzero(classes)
        classes = classes[kept]
        new = np.ones(len(kept), bool)
        new[1:] = classes[1:] != classes[:-1]
        return classes[new].tobytes().decode("utf-32-le"), kept[new]

    def __missing__(self, point: int) -> str:
        c = chr(point)
        plain = STANDS_FOR.get(c, c)[0] if self.symbols or c.isalnum() else c
        self[point] = CLASS.get(plain, plain) if plain.isalnum() else ""
        return self[point]


#: Symbols that may be letters or separators.
MARK = np.array([chr(i) in STANDS_FOR and not chr(i).isalnum() for i in range(LOW)] + [False])
HIGH_MARKS = np.array(sorted(ord(c) for c in STANDS_FOR if ord(c) >= LOW and not c.isalnum()), np.uint32)
MARKS = re.compile("[" + re.escape("".join(c for c in STANDS_FOR if not c.isalnum())) + "]")
BLANK = re.compile(r"\s|\Z")
LETTERS = 28  # a boundary, a-z, any other letter
CODE = np.zeros(256, np.int64)
CODE[65:91] = CODE[97:123] = np.arange(1, 27)
CODE[128:] = 27
SYMBOL_COST, DROP_COST, REPEAT_COST, INNER_COST, EDGE_COST = -2.0, -0.5, -0.7, -6.0, -0.5


def code(c: str) -> int:
    """The model's number of a lower-case character."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (gram, times) of a task's texts."""
    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(part.column("text"))
            c = np.insert(CODE[data], np.repeat(offsets, 2), 0)  # boundaries between rows
            if len(c) > 2:
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "times"])


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts: a table of fixed size, summed on the executors."""
    own = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = np.zeros(LETTERS**3)
    for gram, times in own.mapInArrow(trigram_counts, "gram int, times long").groupBy("gram").agg(F.sum("times")).collect():
        counts[gram] = times
    return counts


def log_model(counts: np.ndarray, words: list[str], share: float = 0.5) -> np.ndarray:
    """log P(c | a, b): the texts' model mixed with that of the words, both backed off to lower orders."""

    def smooth(table: np.ndarray) -> np.ndarray:
        t = table.reshape(LETTERS, LETTERS, LETTERS)
        one = t.sum(axis=(0, 1)) + 1.0
        one /= one.sum()
        two = (t.sum(axis=0) + 5 * one) / (t.sum(axis=(0, 2))[:, None] + 5)
        return (t + 2 * two[None]) / (t.sum(axis=2, keepdims=True) + 2)

    own = np.zeros(LETTERS**3)
    for word in words:
        c = [0, 0, *map(code, word), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            own[(a * LETTERS + b) * LETTERS + d] += 1
    mixed = smooth(counts) * (1 - share * bool(words)) + smooth(own) * (share * bool(words))
    return np.log(mixed)


class Decoder:
    """Viterbi over character lattices."""

    def __init__(self, logs: np.ndarray):
        self.logs = [[row.tolist() for row in plane] for plane in logs]
        self.known: dict[tuple[str, bool, str], str] = {}

    def __call__(self, span: str, apart: bool, symbols: str = "") -> str:
        """The likeliest reading of a span; apart: its blanks may be nothing; symbols: all are letters, or may be nothing."""
        if len(span) > 64:
            return self.decode(span, apart, symbols)
        if (span, apart, symbols) not in self.known:
            if len(self.known) >= 1 << 16:
                self.known.clear()
            self.known[span, apart, symbols] = self.decode(span, apart, symbols)
        return self.known[span, apart, symbols]

    def readings(self, span: str, apart: bool) -> set[str]:
        """The likeliest reading, and those with the symbols as letters, as separators and as either."""
        out = {self(span, apart)}
        if MARKS.search(span):
            out |= {self(span, apart, "letters"), self(MARKS.sub("-", span), apart), self(span, apart, "nothing")}
        return out

    def decode(self, span: str, apart: bool, symbols: str = "") -> str:
        """States are the last two letters; each keeps its best score and a link to how it came about."""
        logs = self.logs
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for i, ch in enumerate(span):
            choices = [(x, SYMBOL_COST) for x in STANDS_FOR.get(ch, "")]
            if ch.isalpha():
                choices.append((ch, 0.0))
            drop = not ch.isalnum() and (apart or not ch.isspace()) and (symbols == "nothing" or ch not in STANDS_FOR or ch == "*")
            if symbols == "letters" and ch in STANDS_FOR:
                drop = False
            if drop:
                choices.append(("", DROP_COST))
            if not ch.isalpha() and not (symbols == "letters" and ch in STANDS_FOR):  # punctuation or a number, less likely between letters
                inner = 0 < i < len(span) - 1 and span[i - 1].isalnum() and span[i + 1].isalnum()
                choices.append((" ", INNER_COST if inner or ch.isdigit() else EDGE_COST))
            following: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            for (a, b, last), (score, link) in states.items():
                for out, cost in choices:
                    if out == "":
                        to, s, back = (a, b, last), score + cost, link
                    else:
                        d = code(out)
                        to, s, back = (b, d, out), score + cost + logs[a][b][d], (link, out)
                        if out == last:  # a repetition may stand for one
                            same = (a, b, last)
                            if same not in following or following[same][0] < score + cost + REPEAT_COST:
                                following[same] = (score + cost + REPEAT_COST, link)
                    if to not in following or following[to][0] < s:
                        following[to] = (s, back)
            states = following
        _, link = max(((s + logs[a][b][0], link) for (a, b, _), (s, link) in states.items()), key=lambda x: x[0])
        out = []
        while link is not None:
            link, letter = link
            out.append(letter)
        return "".join(reversed(out))


PREFIXES = (5, 6, 7)  # bytes: beginnings of longer words are features too, written with a final *


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, bytes of it that count or 0 for all, hash) of the features of a slice's words."""
    words, sizes, hashes = [np.arange(len(w))], [np.zeros(len(w), np.int64)], [w.hashes()]
    for k in PREFIXES:
        long = np.flatnonzero(w.end - w.start > k)
        part = copy(w)
        part.start, part.end = w.start[long], w.start[long] + k
        words.append(long)
        sizes.append(np.full(len(long), k))
        hashes.append(part.hashes() ^ np.uint64(k * BASE & (1 << 64) - 1))
    return np.concatenate(words), np.concatenate(sizes), np.concatenate(hashes)


@dataclass
class Model:
    """What scoring needs: words with weights, the intercept, and the character model. Of bounded size."""

    words: dict[str, float]
    intercept: float
    logs: np.ndarray
    hashes: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    place: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.place = {}
        hashes = [self.hash_of(name) for name in self.words]
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes, self.weights = np.array(hashes, np.uint64)[order], np.array([*self.words.values()], float)[order]
        names = [*self.words]
        self.place = {names[j]: i for i, j in enumerate(order.tolist())}

    @staticmethod
    def hash_of(name: str) -> int:
        """The hash of a word or, with a final *, of a beginning."""
        raw = name.removesuffix("*").encode(errors="surrogateescape")
        h = int(Words(pa.array([raw], pa.binary()), np.zeros(256, bool)).hashes()[0])
        return h ^ (len(raw) * BASE & (1 << 64) - 1) if name[-1:] == "*" else h


def fit_words(chance: float, least_weight: float):
    """For mapInArrow over a bounded sample in one task: (text, toxic) to (word, weight); the intercept has a null word."""

    def distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash) of a slice's features, once each, and where to spell each from."""
        of, size, h = features(w)
        h, row = signed(h), w.row_of()[of]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool)
        return row[once], h[once], np.stack([of[order], size[order]], axis=1)[once]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Toxic rows come first; of the others only counts of the toxic rows' features are kept."""
        rows, hashes, spelled = [], [], {}
        n_bad, n, names, fine = 0, 0, None, np.zeros(0)
        for batch in batches:
            for part in slices(batch):
                bad = part.column("toxic").to_numpy(zero_copy_only=False) > 0
                n += len(bad)
                if bad.any():
                    w = Words(part.column("text").filter(pa.array(bad)), NOT_ALNUM, lower=True)
                    row, h, where = distinct(w)
                    rows.append(row + n_bad)
                    hashes.append(h)
                    n_bad += int(bad.sum())
                    _, one = np.unique(h, return_index=True)
                    raw = w.data.tobytes()
                    for i in one.tolist():
                        a, k = int(w.start[where[i, 0]]), int(where[i, 1])
                        spelled.setdefault(int(h[i]), raw[a : a + k] + b"*" if k else raw[a : w.end[where[i, 0]]])
                if not bad.all() and hashes:
                    if names is None:
                        names = np.unique(np.concatenate(hashes))
                        fine = np.zeros(len(names))
                    _, h, _ = distinct(Words(part.column("text").filter(pa.array(~bad)), NOT_ALNUM, lower=True))
                    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    fine += np.bincount(at[names[at] == h], minlength=len(names))
        base = n_bad / n if n else 0.0
        words: list[bytes] = []
        weights, intercept = np.zeros(0), math.log(max(base, 1e-9) / max(1 - base, 1e-9))
        if 0 < base < 1:
            row, at = np.concatenate(rows), np.searchsorted(names, np.concatenate(hashes))
            bad = independent(row, at, np.bincount(at, minlength=len(names)) + fine, n_bad, n)
            weights = np.log((bad + 0.5) / (fine + 0.5)) - intercept
            few = (weights >= least_weight) & (bad >= 2)
            for i in np.flatnonzero(few).tolist():
                few[i] = tail(int(bad[i]), int(bad[i] + fine[i]), base) <= chance
            words, weights = [spelled[k] for k in names[few].tolist()], weights[few]
        some = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(words[i] for i in some.tolist()), None], pa.binary()), pa.array([*weights[some].tolist(), intercept], pa.float64())], ["word", "weight"]
        )

    return fit


def tail(k: int, n: int, p: float) -> float:
    """The chance of k or more of n."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return sum(math.exp(log(i)) for i in range(k, n + 1))


def independent(row: np.ndarray, column: np.ndarray, held: np.ndarray, n_rows: int, n_all: int, seeds: int = 4) -> np.ndarray:
    """For each column, its toxic rows, of which copies of a text count once; held: rows of any label with the column.

    Rows are told apart by the least hash of their rare columns, which copies share; of several hashes the least count holds.
    """
    m = len(held)
    rare = held[column] <= max(3, n_all // 100)
    out = np.full(m, n_rows)
    for seed in range(seeds):
        value = mix(np.arange(m, dtype=np.uint64) + np.uint64((seed + 1) * BASE & (1 << 64) - 1)) >> np.uint64(1)
        sign = mix(np.arange(n_rows, dtype=np.uint64)) | np.uint64(1 << 63)  # of rows without rare columns: their own
        np.minimum.at(sign, row[rare], value[column[rare]])
        own = sign[row]
        order = np.lexsort((own, column))
        c, o = column[order], own[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (o[1:] != o[:-1])))
        out = np.minimum(out, np.bincount(c[new], minlength=m))
    return out


def train(
    docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, seed: int = 42, chance: float = 2e-5, least_weight: float = 3.0,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """A model from the given labels (all of which may be learnt from) and all documents."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    own = checkpointed(own)
    share = min(1.0, sample_rows / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # The sample's size is bounded, so its ids may be sent to every task, and its texts, one an id, to one.
    sample = texts.join(F.broadcast(own), "id").groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("id", "t.text", "toxic")
    found = sample.repartition(1).sortWithinPartitions(F.desc("toxic"), "id").select("text", "toxic").mapInArrow(fit_words(chance, least_weight), "word binary, weight double").collect()
    intercept = next((x for word, x in found if word is None), -20.0)
    words = {word.decode(errors="surrogateescape"): x for word, x in sorted((f for f in found if f[0] is not None), key=lambda f: (-f[1], f[0]))}
    return Model(words, intercept, log_model(char_model(docs, text_col), [w for w, x in words.items() if x > 1 and w.isalpha()]))


#: What each letter may be written as.
WRITTEN = {c: "".join(sorted({c, *(k for k, v in STANDS_FOR.items() if c in v)})) for c in "abcdefghijklmnopqrstuvwxyz"}
DOUBLED = re.compile(r"(.)\1")


def pieces(word: str, beginning: bool) -> re.Pattern:
    """Finds a word, or tokens that it begins, written in any way and parted by anything; from the start of a piece."""
    letters = [f"[{re.escape(WRITTEN.get(c, c))}]+" for c in word]
    return re.compile(r"(?<![^\W_])" + r"[\W_]*".join(letters) + (r"[^\W_]*" if beginning else r"(?![^\W_])"))


def squeezed(text: str) -> str:
    """The text with each run of a character as one."""
    return re.sub(r"(.)\1+", r"\1", text)


class Scorer:
    """Scores the texts of Arrow batches."""

    def __init__(self, model: Model):
        self.model, self.decode = model, Decoder(model.logs)
        self.plain = {squeezed(w): w for w in reversed(model.words) if w[-1] != "*"}
        self.long = [(squeezed(w), w) for w, x in model.words.items() if x > 1 and w[-1] != "*" and len(squeezed(w)) >= 5]
        self.letters, self.parted = Skeleton(True), Skeleton(False)
        self.within, self.across = {}, {}  # by skeleton: whether a word has it, what finds the words in runs of pieces
        for w in model.words:
            own = w.removesuffix("*")
            if bone := squeezed(own.translate(self.letters)):
                self.within[bone] = True
                self.across.setdefault(bone, []).append(pieces(own, w[-1] == "*"))
        bones = sorted(self.within, key=len)
        self.least = [b for i, b in enumerate(bones) if not any(a in b for a in bones[:i])]
        self.find = ahocorasick.Automaton()
        for i, bone in enumerate(self.across):
            self.find.add_word(bone, (i, len(bone)))
        self.find.make_automaton()
        self.patterns = [*self.across.values()]
        self.hides: dict[str, set[str]] = {}

    def restored(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, reading) of the suspicious spans of a lower-case text."""
        at = 0
        while m := SUSPICIOUS.search(text, at):
            a, b = m.span()
            if m["apart"] is None:  # the whole token
                a = 1 + max(at - 1, *(text.rfind(c, at, a) for c in " \n\t\r"))
                b = BLANK.search(text, b).start()
            yield a, b, self.decode(text[a:b], m["apart"] is not None)
            at = max(b, m.end())

    def restore(self, text: str) -> str:
        """The whole text, lower-cased, with its suspicious spans as they are read."""
        text, out, at = text.lower(), [], 0
        for a, b, reading in self.restored(text):
            out += [text[at:a], reading]
            at = b
        return "".join([*out, text[at:]])

    def skeletons(self, text: str) -> set[str]:
        """The text's letters by classes, with symbols as letters and as separators."""
        return {squeezed(text.translate(table)) for table in (self.letters, self.parted)}

    def named(self, span: str, apart: bool) -> set[str]:
        """The model's words in a span's readings; doubled letters count as one there."""
        found: set[str] = set()
        for reading in self.decode.readings(span, apart) - {span}:
            plain = squeezed(reading)
            for w in re.findall(r"[^\W_]+", plain):
                whole = self.plain.get(w, w)
                raw = whole.encode(errors="surrogateescape")
                ways = [whole, *(raw[:k].decode(errors="surrogateescape") + "*" for k in PREFIXES if len(raw) > k)]
                found.update(x for x in ways if x in self.model.place)
            found.update(w for short, w in self.long if short in plain)
        return found

    def of_token(self, token: str) -> set[str]:
        """What a token hides."""
        if token.isascii() and token.isalpha() and not DOUBLED.search(token):
            return set()
        if not any(bone in own for own in self.skeletons(token) | self.mixed(token) for bone in self.least):
            return set()
        return self.named(token, False)

    def mixed(self, token: str) -> set[str]:
        """More skeletons of a token with several symbols, some of which may be separators; without a letter's class where they are many."""
        at = [i for i, c in enumerate(token) if c in STANDS_FOR and not c.isalnum()]
        if len(at) < 2:
            return set()
        if len(at) > 6:
            return set(self.least)  # not told apart: the decoder tells
        ways = range(1, (1 << len(at)) - 1)
        return {squeezed("".join(c for i, c in enumerate(token) if i not in at or way >> at.index(i) & 1).translate(self.letters)) for way in ways}

    def by_token(self, token: str) -> set[str]:
        """What a token hides, looked up if it was asked before."""
        if token not in self.hides:
            if len(self.hides) >= 1 << 16:
                self.hides.clear()
            words = self.of_token(token)
            if len(token) > 64:
                return words
            self.hides[token] = words
        return self.hides[token]

    def hidden_in(self, texts: list[str]) -> list[set[str]]:
        """Of each lower-case text the model's words that only decoding shows.

        A word can be hidden only where its letters' classes stand one after another in the skeleton of all texts: the tokens
        there, and the runs of pieces, are looked at. Tokens of several symbols, some of which may be separators, are looked at too.
        """
        found: list[set[str]] = [set() for _ in texts]
        if not self.across or not any(texts):
            return found
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # the line end after each text
        blanks = np.concatenate(([-1], np.flatnonzero(SPACE[np.minimum(codes, LOW)]), [len(codes)]))
        places, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        wide, kinds = len(codes) + 1, len(self.patterns)
        token_of = lambda at: np.searchsorted(blanks, at)  # noqa: E731  blanks[i - 1] and blanks[i] part token i from others
        for table in (self.letters, self.parted):
            bones, start = table.of(codes, ends[:-1])
            hits = np.array([(e - n + 1, e, i) for e, (i, n) in self.find.iter(bones)], np.int64).reshape(-1, 3)
            first, last, after = start[hits[:, 0]], start[hits[:, 1]], np.append(start, len(codes))[hits[:, 1] + 1]
            # Within a token all runs of classes but the first begin in it.
            second = token_of(start[np.minimum(hits[:, 0] + 1, hits[:, 1])])
            tokens.append(second[second == token_of(last)])
            a, b = token_of(first), token_of(after - 1)
            some = a < b  # over several tokens
            places.append(((blanks[a[some] - 1] + 1) * wide + blanks[b[some]]) * kinds + hits[some, 2])
        high = np.flatnonzero(codes >= LOW)
        marks = np.concatenate((np.flatnonzero(MARK[np.minimum(codes, LOW)]), high[np.isin(codes[high], HIGH_MARKS)]))
        before, times = np.unique(token_of(marks), return_counts=True)
        tokens.append(before[times > 1])
        if min(map(len, self.across)) == 1:  # such a word may lie anywhere in a run
            tokens.append(np.arange(1, len(blanks)))
        own = np.unique(np.concatenate(tokens))
        for a, b, row in zip((blanks[own - 1] + 1).tolist(), blanks[own].tolist(), np.searchsorted(ends, blanks[own]).tolist(), strict=True):
            found[row] |= self.by_token(joined[a:b])
        at, kind = np.divmod(np.unique(np.concatenate(places)), kinds)
        at, until = np.divmod(at, wide)
        for a, b, i, row in zip(at.tolist(), until.tolist(), kind.tolist(), np.searchsorted(ends, at).tolist(), strict=True):
            for pattern in self.patterns[i]:
                for m in pattern.finditer(joined, a, b):
                    if any(c.isspace() for c in m.group()):
                        found[row] |= self.named(m.group(), True)
        return found

    def hidden(self, text: str) -> set[str]:
        """The words that a lower-case text hides."""
        return self.hidden_in([text])[0]

    def __call__(self, column: pa.Array) -> np.ndarray:
        model = self.model
        w = Words(column, NOT_ALNUM, lower=True)
        sums = np.full(w.rows, model.intercept)
        seen: set[tuple[int, int]] = set()
        if len(model.hashes) and len(w):
            of, _, h = features(w)
            at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
            hit = np.flatnonzero(model.hashes[at] == h)
            pairs = np.unique(np.stack([w.row_of()[of[hit]], at[hit]], axis=1), axis=0)
            np.add.at(sums, pairs[:, 0], model.weights[pairs[:, 1]])
            seen = set(map(tuple, pairs.tolist()))
        if model.words:
            for row, words in enumerate(self.hidden_in([(text or "").lower() for text in column.to_pylist()])):
                for word in words:
                    i = model.place[word]
                    if (row, i) not in seen:
                        sums[row] += model.weights[i]
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def scored(model: Model, threshold: float):
    """For mapInArrow over (id, text): (id, score, predicted)."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                score = scorer(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return of_batches


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(scored(model, threshold), "id long, score double, predicted int").withColumnRenamed("id", id_col)


def rejected_out(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(scorer(part.column(text_col)) < threshold))

    return docs.mapInArrow(of_batches, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label must not be learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
