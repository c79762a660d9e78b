"""Toxicity of deobfuscated text: a noisy channel read by Viterbi under a character language model, then weighed words."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, compress
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.llm.common import chunks, frame_batch, id_and_text, map_batches, utf8_slices
from doubtline.llm.labelled import held_out, training_sample

#: Labelled documents that are learned from at most (the bound of the fit).
TRAIN_DOCS = 20_000
#: Evidence a feature needs: the log-likelihood ratio that chance passes once in a thousand features.
EVIDENCE = 10.8
ACCEPT = 0.7
PARTS, HELD_OUT = 3, 1
CACHE_WORDS, CACHE_CHARS = 400_000, 48

# --- letters

#: Symbols of the language model: 0 a boundary, 1 to 26 a to z, 27 to 58 the letters from U+00DF to U+00FE, 63 any other letter.
SYMBOLS, OTHER = 64, 63
#: Signs that stand for letters (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = frozenset(".-_*·~'`^/\\,:")
#: Costs in nats of what the channel does to one character.
SWAP, REPEAT, SEPARATE, DROP = 1.0, 1.5, 0.7, 12.0
#: Readings of a word taken at its end.
READINGS = 3


def _symbol(c: str) -> int:
    code = ord(c)
    if 97 <= code <= 122:
        return code - 96
    if 0xDF <= code <= 0xFE and code != 0xF7:
        return 27 + code - 0xDF
    return OTHER if c.isalpha() else 0


def _symbol_table() -> np.ndarray:
    return np.array([_symbol(chr(i)) for i in range(0x250)], np.int64)


@dataclass(frozen=True)
class CharModel:
    """Costs (negative log probabilities) of a symbol after the two before it."""

    cost: np.ndarray

    @cached_property
    def flat(self) -> list[float]:
        """The costs as one list, quicker to read one by one."""
        return self.cost.ravel().tolist()

    @staticmethod
    def of(grams: np.ndarray) -> CharModel:
        """From counts of the 64**3 trigrams, with a mixture of shorter contexts."""
        three = grams.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 0.1) / (one.sum() + 0.1 * SYMBOLS)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
        return CharModel((-np.log(p3)).astype(np.float32))


def char_model(docs: DataFrame) -> CharModel:
    """Trigrams of letters over every whole text of ``docs``.

    Each task counts into an array of 64**3 and sends what isn't 0; the sums, at most 64**3 rows, reach the driver. Letters
    are lower-cased; anything else is a boundary. Nulls and empty texts add nothing.
    """
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches):
        table, counts = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            _, offsets = utf8_slices(batch.column("text"))
            for a, b in chunks(offsets, 1 << 21):
                # texts of about 2 MB at a time, told apart by a line feed, a boundary
                text = "\n\n".join(batch.column("text").slice(a, b - a).drop_null().to_pylist())
                codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                symbols = np.zeros(len(codes) + 3, np.int64)
                symbols[2:-1] = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], OTHER)
                counts += np.bincount((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], minlength=SYMBOLS**3)
        found = np.flatnonzero(counts)
        yield frame_batch(schema, gram=found.astype(np.int32), n=counts[found])

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int, n long")
    grams = np.zeros(SYMBOLS**3, np.int64)
    for gram, n in partial.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        grams[gram] = n
    return CharModel.of(grams)


# --- deobfuscation

ODD_INSIDE = re.compile(r"[^\W\d_](?=.*[0-9@$!|+(€£.\-_*·~'`^/\\,:].*[^\W\d_])|[0-9@$!|+(€£](?=.*[^\W\d_])")
DOUBLE = re.compile(r"([^\W\d_])\1")
REPEATS = re.compile(r"([^\W\d_])\1+")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SIGN = re.compile("[" + re.escape("".join(LEET)) + "]")
PUNCTUATION = ".,;:?)\"'"
#: What most tokens have: no base, no walk that goes on, no letter that it could go on with.
NOTHING: tuple[tuple, tuple[int, ...], frozenset[str]] = ((), (), frozenset())


@lru_cache(1024)
def _options(c: str) -> tuple[tuple[str, int, float], ...]:
    """What a character may stand for: letters with their symbols and channel costs, or nothing."""
    if c.isalpha():
        return ((c, _symbol(c), 0.0),)
    letters = tuple((letter, _symbol(letter), SWAP) for letter in LEET.get(c, ""))
    return (*letters, ("", 0, SEPARATE if c in SEPARATORS or c == " " else DROP))


def decode(noisy: str, model: CharModel, readings: int = READINGS) -> list[str]:
    """The likeliest words behind a noisy one (lower-cased), the best first.

    The lattice has for each character the letters it may stand for: itself, those that a sign resembles, or nothing, if it
    separates or repeats the character before it. A space is the end of a word, or it separates the letters of one; a reading
    with ends of words has spaces in it. The path with the least sum of channel and language model costs wins; for all pairs
    of last symbols the best path is kept.
    """
    cost = model.flat
    # state: last two symbols, a * SYMBOLS + b -> (cost, text)
    paths: dict[int, tuple[float, str]] = {0: (0.0, "")}
    before = ""
    for c in noisy:
        options = _options(c)
        step: dict[int, tuple[float, str]] = {}
        if c != before and len(options) == 1 and options[0][0]:
            # a letter that isn't a repeat: one way for each path
            s, before = options[0][1], c
            for state, (spent, text) in paths.items():
                key, path = state % SYMBOLS * SYMBOLS + s, (spent + cost[state * SYMBOLS + s], text + c)
                known = step.get(key)
                if known is None or path < known:
                    step[key] = path
            paths = step
            continue
        if before == c:
            options += (("", 0, REPEAT),)
        if c == " ":
            options += ((" ", 0, 0.0),)
        before = c
        for state, (spent, text) in paths.items():
            for letter, s, channel in options:
                if letter == " ":
                    # the next word starts like the first; no word is empty
                    if not state % SYMBOLS:
                        continue
                    key, total, made = 0, spent + cost[state * SYMBOLS], text + letter
                elif letter:
                    key, total, made = state % SYMBOLS * SYMBOLS + s, spent + channel + cost[state * SYMBOLS + s], text + letter
                else:
                    # a separator between equal letters doesn't make a repeat of them
                    key, total, made = state, spent + channel, text
                known = step.get(key)
                if known is None or (total, made) < known:
                    step[key] = (total, made)
        paths = step
    ends = sorted((spent + cost[state * SYMBOLS], text) for state, (spent, text) in paths.items())
    return list(dict.fromkeys(text for _, text in ends if text))[:readings]


def restore_word(word: str, model: CharModel) -> list[str]:
    """A token's readings: as it stands, and the likeliest decoded ones if it has signs, separators or a doubled letter."""
    word = word.lower()
    plain = EDGE.sub("", word)
    found = [plain] if plain else []
    core = word if ODD_INSIDE.search(word) else plain
    if any(c.isalpha() for c in core) and (ODD_INSIDE.search(core) or DOUBLE.search(core)):
        # signs at the ends may be letters or mere signs: both readings
        for noisy in dict.fromkeys((plain, core.strip(".,;:*-_'\"()[]?#%&~"))):
            if noisy:
                found += decode(noisy, model)
    return list(dict.fromkeys(found))


# --- words to features


BEGINNINGS = (4, 5, 6, 7, 8)
#: How many different words of a text that begin alike are told apart.
MOST_ALIKE = 3


def bases_of(word: str) -> list[str]:
    """A restored word and its beginnings."""
    return ["=" + word] + [word[:n] for n in BEGINNINGS if len(word) > n]


class Heads:
    """Known beginnings of words as a tree of letters, walked by all that a noisy token may stand for.

    A walk takes a letter or lets it go as a repeat, takes any letter that a sign resembles or lets the sign go, and lets go
    what separates. So it loses no reading of the lattice: where no walk over some tokens ends in a known beginning, no word
    that the lattice could join from them has one.
    """

    def __init__(self, words: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.letter = [""]
        self.ends: set[int] = set()
        for word in words:
            node = 0
            for c in REPEATS.sub(r"\1", word):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.letter.append(c)
                node = self.next[node][c]
            self.ends.add(node)
        self.allowed: dict[tuple[int, ...], frozenset[str]] = {}

    def knows(self, bare: str) -> bool:
        """If a squeezed word of letters begins with a head."""
        node, nexts, ends = 0, self.next, self.ends
        for c in bare:
            node = nexts[node].get(c)
            if node is None:
                return False
            if node in ends:
                return True
        return False

    def go(self, node: int, letters: str) -> tuple[int, bool]:
        """The same as ``walk`` over letters alone, which have one way: its end, 0 if there is none."""
        passed = False
        for c in letters:
            found = self.next[node].get(c)
            if found is not None:
                node = found
                passed = passed or node in self.ends
            elif not node or c != self.letter[node]:
                return 0, passed
        return node, passed

    def first(self, nodes: tuple[int, ...]) -> frozenset[str]:
        """One and two letters with which walks from some nodes can go on; a letter and ``_`` where it ends a beginning."""
        found = self.allowed.get(nodes)
        if found is None:
            ways = [way for n in nodes for way in self._ways(n)]
            pairs = [c + d for c, n in ways for d, _ in self._ways(n)]
            found = self.allowed[nodes] = frozenset([*pairs, *(c for c, _ in ways), *(c + "_" for c, n in ways if n in self.ends)])
        return found

    def _ways(self, node: int) -> list[tuple[str, int]]:
        return [*self.next[node].items(), *([(self.letter[node], node)] if node else [])]

    def walk(self, nodes: Iterable[int], token: str) -> tuple[tuple[int, ...], bool]:
        """Where walks from some nodes over a token stand at its end, and whether one passed the end of a beginning."""
        # node, and the character that led there: it may be repeated
        now, passed = {(n, "") for n in nodes}, False
        start = next((i for i, c in enumerate(token) if not c.isalpha()), len(token)) if len(now) == 1 else 0
        if start:
            node, passed = self.go(next(iter(now))[0], token[:start])
            if not node:
                return (), passed
            now = {(node, token[start - 1])}
        for c in token[start:]:
            letters = c if c.isalpha() else LEET.get(c, "")
            step = set() if c.isalpha() else set(now)
            for node, last in now:
                if c == last or (node and self.letter[node] in letters):
                    step.add((node, c))
                for letter in letters:
                    found = self.next[node].get(letter)
                    if found is not None:
                        step.add((found, c))
                        passed = passed or found in self.ends
            now = step
            if not now:
                break
        return tuple(sorted({n for n, _ in now})), passed


class _Walks(dict):
    """(nodes, token) to where the walks over the token lead."""

    def __init__(self, heads: Heads):
        super().__init__()
        self.heads = heads

    def __missing__(self, key: tuple[tuple[int, ...], str]) -> tuple[tuple[int, ...], bool]:
        value = self.heads.walk(*key)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[key] = value
        return value


class Joints(dict):
    """Ends of two words of two letters or more to whether the lattice reads them as one word rather than as two.

    The key is the last two letters of one and the first two of the next. The two ways through the lattice part at the space
    and meet two letters on, so this is the lattice's choice, and each joint has its own: one word costs a separator and
    the letters across the joint, two cost the end of one and the start of the other.
    """

    def __init__(self, model: CharModel):
        super().__init__()
        self.cost = model.cost

    def __missing__(self, key: str) -> bool:
        a, b, c, d = map(_symbol, key)
        cost = self.cost
        value = self[key] = bool(SEPARATE + float(cost[a, b, c]) + float(cost[b, c, d]) < float(cost[a, b, 0]) + float(cost[0, 0, c]) + float(cost[0, c, d]))
        return value


def spaced_runs(words: list[str]) -> list[tuple[int, int]]:
    """(first, end) of runs of three or more single characters, two of them letters."""
    single = [i for i, w in enumerate(words) if len(w) == 1]
    found, start = [], 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            run = (single[start], single[k - 1] + 1)
            if k - start >= 3 and sum(c.isalpha() for c in words[run[0] : run[1]]) >= 2:
                found.append(run)
            start = k
    return found


class _Stands(dict):
    """Node to the value of a word without known beginnings that leads there."""

    def __init__(self, heads: Heads):
        super().__init__()
        self.heads = heads

    def __missing__(self, node: int) -> tuple[tuple, tuple[int, ...], frozenset[str]]:
        value = self[node] = ((), (node,), self.heads.first((node,))) if self.heads.next[node] else NOTHING
        return value


class _Memo(dict):
    """Lower-cased token to its restored words and their bases; with an index, only bases that the model knows."""

    def __init__(self, char: CharModel, index: dict[str, int] | None):
        super().__init__()
        self.char, self.known = char, None if index is None else {f.split("+")[0] for f in index}
        self.heads = Heads(b.removeprefix("=") for b in self.known or ())
        self.walks, self.joints = _Walks(self.heads), Joints(char)
        self.decoded: dict[str, tuple] = {}
        self.stands = _Stands(self.heads)

    def bases(self, read: list[str]) -> tuple:
        found = [(w, b) for w in read for b in bases_of(w)]
        return tuple(found if self.known is None else [x for x in found if x[1] in self.known])

    def _seen(self, low: str) -> tuple[tuple, tuple[int, ...], frozenset[str]]:
        """Bases of a token, where walks over it lead that go beyond it, and the letters with which they can go on."""
        if self.known is None:
            return self.bases(restore_word(low, self.char)), (), NOTHING[2]
        stem = low.rstrip(PUNCTUATION)
        if stem.isalpha():
            node, passed = self.heads.go(0, stem)
            # the lattice only takes repeats out of a word of letters alone, whatever ends the sentence after it
            return self._value(low, (node,)) if passed else self.stands[node] if node else NOTHING
        if SIGN.search(low):
            nodes = self.heads.walk((0,), low)[0]
        else:
            node, passed = self.heads.go(0, "".join(filter(str.isalpha, low)))
            if not passed:
                return self._value(None, (node,))
            nodes = (node,)
        plain = EDGE.sub("", low)
        hopeless = plain.isalpha() and not ODD_INSIDE.search(low) and not self.heads.knows(REPEATS.sub(r"\1", plain))
        return self._value(None if hopeless else low, nodes)

    def _value(self, word: str | None, nodes: tuple[int, ...]) -> tuple[tuple, tuple[int, ...], frozenset[str]]:
        bases = self.bases(restore_word(word, self.char)) if word else ()
        nodes = tuple(n for n in nodes if n and self.heads.next[n])
        return (bases, nodes, self.heads.first(nodes)) if bases or nodes else NOTHING

    def __missing__(self, word: str) -> tuple[tuple, tuple[int, ...], frozenset[str]]:
        value = self._seen(word)
        if len(word) <= CACHE_CHARS:
            # before anything is known, a word has all its bases: eight times the memory
            if len(self) >= (CACHE_WORDS // 8 if self.known is None else CACHE_WORDS):
                self.clear()
            self[word] = value
        return value

    def windows(self, words: list[str], seen: list[tuple] | None = None) -> list[tuple[int, int]]:
        """(first, end) of neighbouring tokens that the lattice may read as words with a known beginning across their ends.

        Tokens are lower-cased. Before anything is known, these are runs of single characters.
        """
        if self.known is None:
            return spaced_runs(words)
        found, last = [], len(words) - 1
        seen = list(map(self.__getitem__, words)) if seen is None else seen
        covered, then = -1, ()
        for i in compress(range(last), map(itemgetter(1), seen)):
            _, nodes, letters = seen[i]
            end, ahead = 0, words[i + 1][:2]
            if ahead not in letters and ahead.isalpha() and ahead[0] + "_" not in letters:
                continue
            # an earlier start that stands at the same place here finds all that this one would: a token said over and over
            again, covered = i == covered and nodes == then, i + 1
            then = ()
            for j in range(i + 1, len(words)):
                nodes, passed = (self._go if j == i + 1 else self._step)(nodes, words[j])
                if j == i + 1:
                    then = nodes
                    if again:
                        break
                if passed:
                    end = j + 1
                if not nodes:
                    break
            if end and not self._parted(words[i:end]):
                found.append((i, end))
        return found

    def _step(self, nodes: tuple[int, ...], token: str) -> tuple[tuple[int, ...], bool]:
        ahead, letters = token[:2], self.heads.first(nodes)
        if ahead not in letters and ahead.isalpha() and ahead[0] + "_" not in letters:
            return (), False
        return self._go(nodes, token)

    def _go(self, nodes: tuple[int, ...], token: str) -> tuple[tuple[int, ...], bool]:
        if len(nodes) == 1 and token.isalpha():
            node, passed = self.heads.go(nodes[0], token)
            return (node,) if node else (), passed
        return self.walks[nodes, token]

    def _parted(self, words: list[str]) -> bool:
        """If the lattice keeps all ends of some words; told without a search for words of two letters or more, none doubled.

        Punctuation after a word is let go at the same cost on both ways.
        """
        stems = [w.rstrip(PUNCTUATION) for w in words]
        if not all(len(w) > 1 and w.isalpha() for w in stems):
            return False
        return not any(self.joints[a[-2:] + b[:2]] or a[-1] == b[0] for a, b in zip(stems, stems[1:])) and not any(DOUBLE.search(w) for w in stems)

    def _joined(self, noisy: str) -> tuple:
        """Bases of a window's best reading."""
        value = self.decoded.get(noisy)
        if value is None:
            value = tuple(x for reading in decode(noisy, self.char, 1) for x in self.bases(reading.split()))
            if len(noisy) <= CACHE_CHARS:
                if len(self.decoded) >= CACHE_WORDS:
                    self.decoded.clear()
                self.decoded[noisy] = value
        return value

    def of(self, text: str | None) -> list[str]:
        """Distinct features of a text: a base, and the base with +2 or +3 where so many different words share it."""
        words = text.lower().split() if text else []
        seen = list(map(self.__getitem__, words))
        if self.known is None:
            found = set(chain.from_iterable(bases for bases, _, _ in dict(zip(words, seen)).values()))
        else:
            found = set(chain.from_iterable(filter(None, map(itemgetter(0), seen))))
        for first, end in self.windows(words, seen):
            found.update(self._joined(" ".join(words[first:end])))
        counts = Counter(map(itemgetter(1), found))
        return [*counts, *(f"{b}+{n}" for b, c in counts.items() if c > 1 for n in range(2, min(c, MOST_ALIKE) + 1))]


#: The memo of the last model that this worker process used, by the model's digest: later tasks start with what it knows.
_KEPT: dict[str, _Memo] = {}


def _digest(char: CharModel, index: dict[str, int]) -> str:
    return hashlib.sha256(char.cost.tobytes() + "\n".join(index).encode("utf-8", "surrogatepass")).hexdigest()


def _memo_of(key: str, char: CharModel, index: dict[str, int]) -> _Memo:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = _Memo(char, index)
    return _KEPT[key]


def restore(text: str, char: CharModel, index: dict[str, int] | None = None) -> str:
    """A text with each noisy word, and each window of pieces, as the lattice reads it best: in lower case, joined by a space."""
    words, out, i, memo = text.lower().split(), [], 0, _Memo(char, index)
    windows = dict(memo.windows(words))
    while i < len(words):
        end = windows.get(i)
        out += decode(" ".join(words[i:end]), char, 1) if end else restore_word(words[i], char)[:2][-1:]
        i = end or i + 1
    return " ".join(out)


@dataclass
class ToxicModel:
    """The language model, the features and their weights."""

    char: CharModel
    index: dict[str, int]
    weights: np.ndarray
    bias: float


def _logistic(rows: list[list[int]], labels: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights of present features: logistic loss with a light penalty, by accelerated gradient steps over all rows."""
    weights, bias = np.zeros(n), math.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    flat = np.array([i for r in rows for i in r], np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    if not len(flat):
        return weights, bias
    share = np.bincount(flat, minlength=n)
    scale = 2.0 / (share + 2.0)
    speed_w, speed_b = np.zeros(n), 0.0
    for _ in range(1000):
        z = np.bincount(doc, weights[flat], len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels
        speed_w = 0.9 * speed_w - 0.1 * scale * (np.bincount(flat, error[doc], n) + 0.01 * weights)
        speed_b = 0.9 * speed_b - 0.4 * error.mean()
        weights, bias = weights + speed_w, bias + speed_b
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, char: CharModel, most: int = TRAIN_DOCS) -> ToxicModel:
    """The model of ``labels.toxic``, learned from at most ``most`` documents outside the held-out part.

    The sample is written once. Features are counted by label in the tasks and summed by Spark. Those that stand out in
    toxic documents are kept; a second pass gives each document's features among them, for the fit of the weights.
    """
    sample = training_sample(docs, labels, "toxic", PARTS, HELD_OUT, most, "toxic").select("text", "label")
    totals = {y: n for y, n in sample.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    schema = pa.schema([("feature", pa.string()), ("n1", pa.int64()), ("n0", pa.int64())])

    def count(batches):
        # a model of before isn't needed beside the counts
        _KEPT.clear()
        memo, seen = _Memo(char, None), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen[label].update(memo.of(text))
            if len(seen[0]) + len(seen[1]) > 150_000:
                yield _counted(seen)
                seen = (Counter(), Counter())
        yield _counted(seen)

    def _counted(seen):
        names = list(seen[0].keys() | seen[1].keys())
        return frame_batch(schema, feature=names, n1=[seen[1][f] for f in names], n0=[seen[0][f] for f in names])

    counted = sample.mapInArrow(count, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # how much oftener than by chance in toxic documents: the signed root of the log-likelihood ratio
    rate = F.lit((n1 + 0.5) / (n1 + n0 + 1.0))
    both = F.col("n1") + F.col("n0")
    held = (F.col("n1") + 0.5) / (both + 1.0)
    gain = 2 * (F.col("n1") * F.log(held / rate) + F.col("n0") * F.log((1 - held) / (1 - rate)))
    marked = counted.filter((F.col("n1") >= 2) & (held > 2.5 * rate)).withColumn("gain", gain).filter(F.col("gain") > EVIDENCE)
    names = [r.feature for r in marked.orderBy(F.desc("gain"), "feature").collect()]
    index = {f: i for i, f in enumerate(names)}
    pairs = pa.schema([("label", pa.int32()), ("ids", pa.list_(pa.int32()))])

    key = _digest(char, index)

    def present(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo = _memo_of(key, char, index)
        return frame_batch(pairs, label=batch.column("label"), ids=[sorted(index[f] for f in memo.of(t) if f in index) for t in batch.column("text").to_pylist()])

    rows = sorted((r.label, r.ids) for r in map_batches(sample, present, "label int, ids array<int>").collect())
    weights, bias = _logistic([r[1] for r in rows], np.array([r[0] for r in rows], np.float64), len(index))
    return ToxicModel(char, index, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicModel, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row's whole text, restored first; no shuffle.

    The text alone decides the score. A null or empty text gets the score of a text without any marked word; a null doc_id
    stays null and isn't held out; repeated rows are all returned; further columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    key = _digest(model.char, model.index)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo, at, weights = _memo_of(key, model.char, model.index), model.index, model.weights
        logit = [model.bias + math.fsum(weights[at[f]] for f in memo.of(t) if f in at) for t in batch.column("text").to_pylist()]
        return frame_batch(schema, doc_id=batch.column("doc_id"), score=1 / (1 + np.exp(-np.clip(logit, -500, 500))))

    out = map_batches(id_and_text(docs), run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), PARTS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
