"""Language ID by a linear-chain conditional random field over words.

A word's features are its affixes and n-grams (byte n-grams of the word with its ends marked, hashed to a fixed table) and, if
the lexicon has it, the word itself (words with digits have no features and follow their neighbours); transitions between neighbouring words' languages and the first word's language are
learned with them. Forward-backward gives each word's language probabilities; a document's are their mean, so a text that
switches between languages is scored by how much of it is in each.

Labelled words: label_words gives the runs of words of one language, with their places in the text.

Training takes labelled rows, at most `per_language` for each language (those with the least hash of doc_id and text, so the
choice doesn't depend on order or partitions, and a null doc_id counts like any other), for at most `languages` languages (those with the most
sampled rows, then by name; others are never predicted), cuts them to short segments, and joins
segments of different documents to sequences, so that switches occur and their rate is learned. If the sampled texts have over `characters`
together, only the beginning of the long ones is learned from, an equal share for each text; prediction always reads whole texts. The lexicon takes the `lexicon` most frequent
words of all languages together. That bounded sample is all that reaches the driver, and the model that is broadcast has a fixed size.
Everything else is one streaming pass, in batches that shrink as languages grow in number; a text of more words than a batch
should have is scored in stretches that carry the chain's messages.

Rejection: a text whose words look like none that were learned. For each language the sample's second half tells which share of byte 4-grams
(ends of words marked) the first half had; `prevailing` drops texts with under `FAMILIAR` of the least such share of their language. Texts of under
`_FEW` 4-grams, and languages with under 20 rows to tell from, are never dropped.

Cases: a text that is null or has no letter is 'und' with score 0. A null lang is never learned from. Without labelled rows
all is 'und'. Rows that share a doc_id each get a row. Ties go to the language that sorts first. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.shared import BATCH_BYTES, bounded_batches, written
from siltbed.llm.words import LOWER, Numbers, Words, find_words, kept, release, small_batches, span_hashes, utf8

UNKNOWN = "und"
#: Bytes of words: letters, digits, and all bytes of characters beyond ASCII.
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_LETTERS = _DIGITS.copy()
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_NGRAMS = (1, 2, 3, 4)
_BUCKETS = 1 << 16
#: Slots for 4-grams as a power of two, 4-grams below which a text isn't judged, and the share of what a language's own texts have.
_SLOTS, _FEW, FAMILIAR = 22, 40, 0.6
#: Numbers that an array over words and languages may have.
_CELLS = 2_000_000
#: Texts of so many words go by blocks, unless languages are so many that blocks' matrices cost more than steps.
_LONG, _MOST_BLOCKED = 20_000, 32


@dataclass(frozen=True)
class Training:
    """Bounds and settings of training; nothing in it grows with the table."""

    per_language: int = 200
    languages: int = 400
    characters: int = 4_000_000  # of all sampled texts together; beyond, each text's first ones, `least_characters` at least
    least_characters: int = 2_000
    segments: int = 16  # of a document
    segment: int = 12  # words
    joined: int = 3  # segments in a sequence
    lexicon: int = 20_000  # words
    steps: int = 40
    rate: float = 0.3
    decay: float = 1e-5


def _words(column: pa.Array) -> Words:
    data, offsets = utf8(column)
    return find_words(LOWER[data], offsets, _LETTERS)


def _coded(words: Words) -> np.ndarray:
    """Which words have a digit: numbers, keys and the like, that tell no language."""
    upto = np.concatenate([[0], np.cumsum(_DIGITS[words.data], dtype=np.int32)])
    return upto[words.ends] > upto[words.starts]


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, and where each word's begin; a word of n bytes has the n-grams of n + 2."""
    size = ends - starts + 2
    at = np.cumsum(size) - size
    total = int(size.sum())
    body = np.zeros(total + max(_NGRAMS), np.uint64)
    source = np.repeat(starts - at - 1, size) + np.arange(total)
    body[:total] = data[np.clip(source, 0, len(data) - 1)]
    body[at], body[at + size - 1] = 2, 3
    left = np.repeat(at + size, size) - np.arange(total)  # bytes to the word's end
    every, owner = [], []
    word = np.repeat(np.arange(len(size)), size)
    code = np.zeros(total, np.uint64)
    for n in _NGRAMS:
        code = code << np.uint64(8) | body[n - 1 : n - 1 + total]
        fits = left >= n
        every.append(((code[fits] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0xD6E8FEB86659FD93 % 2**64)) >> np.uint64(48)).astype(np.int64) % _BUCKETS)
        owner.append(word[fits])
    every, owner = np.concatenate(every), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return every[order], np.searchsorted(owner[order], np.arange(len(size)))


def _quads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words' 4-grams, ends marked, and the word of each."""
    size = np.maximum(ends - starts - 1, 1)  # a word of n bytes has n + 2 with its marks; shorter than four is one
    word = np.repeat(np.arange(len(size)), size)
    at = np.repeat(starts - 1, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    code = np.zeros(len(at), np.uint64)
    for k in range(4):
        place = at + k
        byte = data[np.clip(place, 0, len(data) - 1)].astype(np.uint64)
        byte[place < starts[word]] = 2
        byte[place >= ends[word]] = 3
        code = code << np.uint64(8) | byte
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64), word


def _shares(words: Words, seen: np.ndarray) -> np.ndarray:
    """Of each text, the share of its 4-grams that are seen; nan for a text with few."""
    slots, word = _quads(words.data, words.starts, words.ends)
    doc = np.searchsorted(words.first, word, "right") - 1
    n, known = np.bincount(doc, minlength=len(words.first) - 1), np.bincount(doc, seen[slots], len(words.first) - 1)
    return np.where(n >= _FEW, known / np.maximum(n, 1), np.nan)


@dataclass
class Model:
    languages: list[str]
    ngrams: np.ndarray  # bucket, language
    lexicon: np.ndarray  # ascending word hashes
    lexical: np.ndarray  # lexicon row, language
    first: np.ndarray
    moves: np.ndarray  # from, to
    quads: np.ndarray  # slots of 4-grams seen, packed to bits
    least: np.ndarray  # language: least share of 4-grams
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        buckets, at = _features(data, starts, ends)
        out = np.add.reduceat(self.ngrams[buckets], at, axis=0)
        if len(self.lexicon):
            row = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            known = self.lexicon[row] == hashes
            out[known] += self.lexical[row[known]]
        return out


def _chains(emissions: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of equally long chains (chain, place, language): word and move probabilities, and the log of the sums over all labellings."""
    chains, length, k = emissions.shape
    top = emissions.max(axis=2, keepdims=True)
    seen, step = np.exp(emissions - top), np.exp(moves)
    ahead, behind = np.empty_like(seen), np.empty_like(seen)
    scale = np.empty((chains, length))
    x = np.exp(first) * seen[:, 0]
    for t in range(length):
        if t:
            x = (ahead[:, t - 1] @ step) * seen[:, t]
        scale[:, t] = x.sum(axis=1)
        ahead[:, t] = x / scale[:, t, None]
    behind[:, -1] = 1
    pairs = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        after = behind[:, t + 1] * seen[:, t + 1] / scale[:, t + 1, None]
        pairs += (ahead[:, t].T @ after) * step
        behind[:, t] = after @ step.T
    return ahead * behind, pairs, scale, float(np.log(scale).sum() + top.sum())


def train(texts: list[str], labels: list[str], settings: Training = Training()) -> Model | None:
    """Fits a model by batch gradient ascent (Adam) on the conditional likelihood; None without words to learn from."""
    names = sorted(set(labels))
    number = {x: i for i, x in enumerate(names)}
    words = _words(pa.array(texts, pa.string()))
    plain = ~_coded(words)
    first = np.concatenate([[0], np.cumsum(plain)])[words.first]
    words = Words(words.data, words.starts[plain], words.ends[plain], first, words.offsets)
    hashes = words.hashes()
    least = _least_shares(words, np.array([number[x] for x in labels], np.int64), len(names))
    rng = np.random.default_rng(7)
    pieces: list[tuple[int, int]] = []
    for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        places = np.arange(a, b - settings.segment + 1, settings.segment)
        if 0 < b - a < settings.segment:  # a short text fills a segment by repetition
            pieces.append((a, d))
        for start in rng.permutation(places)[: settings.segments].tolist():
            pieces.append((start, d))
    if not pieces:
        return None
    order = rng.permutation(len(pieces))
    while len(order) % settings.joined:
        order = np.append(order, order[0])
    place = np.array(pieces)[order]
    doc = place[:, 1]
    last = words.first[1:][doc] - 1
    begin = words.first[:-1][doc]
    index = place[:, :1] + np.arange(settings.segment)
    index = np.where(index <= last[:, None], index, begin[:, None] + (index - begin[:, None]) % (last - begin + 1)[:, None])
    index = index.reshape(-1, settings.segment * settings.joined)
    truth = np.repeat(np.array([number[labels[d]] for d in doc]), settings.segment).reshape(index.shape)

    used, inverse = np.unique(hashes[index.reshape(-1)], return_inverse=True)
    inverse = inverse.reshape(index.shape)
    example = np.zeros(len(used), np.int64)
    example[inverse.reshape(-1)] = index.reshape(-1)
    buckets, at = _features(words.data, words.starts[example], words.ends[example])
    owner = np.repeat(np.arange(len(used)), np.diff(np.append(at, len(buckets))))
    often = np.bincount(inverse.reshape(-1), minlength=len(used))
    lexicon = np.sort(np.argsort(-often, kind="stable")[: settings.lexicon])
    k = len(names)
    params = {"ngrams": np.zeros((_BUCKETS, k)), "lexical": np.zeros((len(lexicon), k)), "first": np.zeros(k), "moves": np.zeros((k, k))}
    mean = {x: np.zeros_like(v) for x, v in params.items()}
    square = {x: np.zeros_like(v) for x, v in params.items()}
    eye = np.eye(k)
    seen_moves = eye[truth[:, :-1]].reshape(-1, k).T @ eye[truth[:, 1:]].reshape(-1, k)
    total = truth.size
    for step in range(1, settings.steps + 1):
        scores = np.add.reduceat(params["ngrams"][buckets], at, axis=0)
        scores[lexicon] += params["lexical"]
        chance, pairs, _, _ = _chains(scores[inverse], params["first"], params["moves"])
        miss = (eye[truth] - chance).reshape(-1, k)
        by_word = np.stack([np.bincount(inverse.reshape(-1), miss[:, j], len(used)) for j in range(k)], axis=1) / total
        slope = {
            "ngrams": np.stack([np.bincount(buckets, by_word[owner, j], _BUCKETS) for j in range(k)], axis=1),
            "lexical": by_word[lexicon],
            "first": (eye[truth[:, 0]] - chance[:, 0]).sum(axis=0) / total,
            "moves": (seen_moves - pairs) / total,
        }
        for x, v in params.items():
            g = slope[x] - settings.decay * v
            mean[x] = 0.9 * mean[x] + 0.1 * g
            square[x] = 0.99 * square[x] + 0.01 * g * g
            v += settings.rate * (mean[x] / (1 - 0.9**step)) / (np.sqrt(square[x] / (1 - 0.99**step)) + 1e-8) / (1 + step / 10)
    quads = np.zeros(1 << _SLOTS, bool)
    quads[_quads(words.data, words.starts, words.ends)[0]] = True
    return Model(names, params["ngrams"].astype(np.float32), used[lexicon], params["lexical"].astype(np.float32), params["first"], params["moves"], np.packbits(quads), least)


def _least_shares(words: Words, label: np.ndarray, k: int) -> np.ndarray:
    """For each language, FAMILIAR of the least share of 4-grams that a text of odd place has in common with all of even place."""
    doc = np.searchsorted(words.first, np.arange(len(words.starts)), "right") - 1
    even = doc % 2 == 0
    seen = np.zeros(1 << _SLOTS, bool)
    seen[_quads(words.data, words.starts[even], words.ends[even])[0]] = True
    share = _shares(words, seen)
    out = np.zeros(k)
    for j in range(k):
        own = share[(label == j) & (np.arange(len(label)) % 2 == 1)]
        own = own[~np.isnan(own)]
        if len(own) >= 20:
            out[j] = FAMILIAR * own.min()
    return out


def sample(docs: DataFrame, settings: Training = Training()) -> tuple[list[str], list[str]]:
    """Texts and labels of the bounded training sample: a top-k per language on hashes alone, then those rows' texts."""
    bounded_batches(docs.sparkSession)
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text").withColumn("_hash", F.xxhash64(F.lit(17), "doc_id", "text"))
    best = lambda rows, *order: rows.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_rank") <= settings.per_language).drop("_rank")
    chosen = written(best(labelled.select("lang", "_hash", F.length("text").cast("long").alias("_size")), "_hash"), "sample")
    found = chosen.groupBy("lang").agg(F.count("*").alias("n"), F.sum("_size").alias("size")).orderBy(F.col("n").desc(), "lang").limit(settings.languages).collect()
    # At most per_language rows for each of `languages`: broadcast whatever the table's size.
    keys = F.broadcast(chosen.where(F.col("lang").isin([r.lang for r in found])).select("lang", "_hash").distinct())
    sampled = labelled.join(keys, ["lang", "_hash"], "left_semi")
    if sum(r.size for r in found) > settings.characters:  # rows alone bound nothing: a text may have any length
        share = max(settings.least_characters, settings.characters // sum(r.n for r in found))
        sampled = sampled.withColumn("text", F.substring("text", 1, share))
    rows = best(sampled, "_hash", "doc_id", "text").collect()
    rows.sort(key=lambda r: (r.lang, r._hash, r.text))
    return [r.text for r in rows], [r.lang for r in rows]


@dataclass
class _Found:
    """Of the texts of a batch: mean word probabilities (text, language), 4-grams, those seen, and if asked for each word's language."""

    chance: np.ndarray
    quads: np.ndarray
    seen: np.ndarray
    labels: np.ndarray | None
    count: np.ndarray


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.quads = np.unpackbits(model.quads).astype(bool)
        self.most = max(20_000, 2_400_000 // len(model.languages))  # words in the memo
        self.step = np.exp(model.moves - model.moves.max()).astype(np.float32)
        self.first = np.exp(model.first - model.first.max()).astype(np.float32)
        self._clear()

    def _clear(self) -> None:
        self.known = Numbers(20)
        self.table = np.zeros((1 << 12, len(self.model.languages)), np.float32)
        self.familiar = np.zeros((1 << 12, 2), np.int32)  # 4-grams of a word, and those seen

    def _numbers(self, words: Words) -> np.ndarray:
        """Places in the tables of all words of a part; each distinct word's features are looked up once. Number 0 is a word with digits."""
        if not self.known.n:
            self.known.add(np.array([1], np.uint64))
        hashes = words.hashes()
        hashes[hashes < 2] = 2
        hashes[_coded(words)] = 1
        number = self.known.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            if self.known.n > 1 and self.known.n + len(new) > self.most:
                self._clear()
                return self._numbers(words)
            distinct, at = np.unique(hashes[new], return_index=True)
            at = new[at]
            n = self.known.n
            while n + len(at) > len(self.table):
                self.table, self.familiar = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.familiar))
            for a in range(0, len(at), 50_000):
                some = at[a : a + 50_000]
                place = slice(n + a, n + a + len(some))
                starts, ends = words.starts[some], words.ends[some]
                self.table[place] = self.model.emissions(words.data, starts, ends, distinct[a : a + 50_000])
                slots, word = _quads(words.data, starts, ends)
                self.familiar[place, 0] = np.bincount(word, minlength=len(some))
                self.familiar[place, 1] = np.bincount(word, self.quads[slots], len(some))
            self.known.add(distinct)
            number[new] = self.known.find(hashes[new])
        return number

    def _weights(self, number: np.ndarray) -> np.ndarray:
        seen = self.table[number]
        if len(seen):
            seen -= seen.max(axis=1, keepdims=True)
            np.exp(seen, out=seen)
        return seen

    def _stretched(self, numbers: list[np.ndarray], label: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """One text's chain in parts: the messages at each part's start are kept, and each part is gone through again on the way back."""
        x, starts = None, []
        for number in numbers:
            starts.append(x)
            for seen in self._weights(number):
                x = seen * (self.first if x is None else x @ self.step)
                x = x / x.sum()
        total, y, labels = np.zeros(len(self.first)), np.ones(len(self.first), np.float32), []
        for number, x in zip(reversed(numbers), reversed(starts), strict=True):
            weights = self._weights(number)
            ahead = np.empty_like(weights)
            for t, seen in enumerate(weights):
                x = seen * (self.first if x is None else x @ self.step)
                x = ahead[t] = x / x.sum()
            for t in range(len(weights) - 1, -1, -1):
                both = ahead[t] * y
                ahead[t] = both / both.sum()
                y = (y * weights[t]) @ self.step.T
                y = y / y.sum()
            total += ahead.sum(axis=0, dtype=np.float64)
            labels.append(ahead.argmax(axis=1))
        return total, np.concatenate(labels[::-1]) if label else None

    def documents(self, column: pa.Array, label: bool = False) -> _Found:
        """By forward-backward; zeros for a text without words."""
        k = len(self.model.languages)
        parts, counts = [], []
        for batch in small_batches(iter([pa.RecordBatch.from_arrays([column], ["text"])]), most=min(1 << 20, 6 * _CELLS // k)):
            words = _words(batch.column(0))
            counts.append(words.counts())
            if counts[-1].size == 1 and counts[-1][0] * k > _CELLS:
                parts.append(words)  # by itself
            else:
                parts.append(self._numbers(words))
        out = [self._together(p, c, label) if isinstance(p, np.ndarray) else self._alone(p, label) for p, c in self._joined(parts, counts)]
        if not out:
            return _Found(np.zeros((0, k)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64) if label else None, np.zeros(0, np.int64))
        return _Found(*(None if x[0] is None else np.concatenate(x) for x in ([getattr(f, name) for f in out] for name in ("chance", "quads", "seen", "labels", "count"))))

    def _joined(self, parts: list, counts: list[np.ndarray]) -> Iterator[tuple]:
        """Neighbouring parts together as long as their arrays stay small: the more texts at once, the fewer steps."""
        held: list[np.ndarray] = []
        of: list[np.ndarray] = []
        for part, count in [*zip(parts, counts, strict=True), (None, None)]:
            if held and (not isinstance(part, np.ndarray) or (sum(map(len, held)) + len(part)) * len(self.first) > _CELLS):
                yield np.concatenate(held), np.concatenate(of)
                held, of = [], []
            if isinstance(part, np.ndarray):
                held.append(part)
                of.append(count)
            elif part is not None:
                yield part, count

    def _blocked(self, weights: np.ndarray) -> np.ndarray:
        """Word probabilities of one long text in some six times the square root of its words steps.

        Each block's words make one matrix, all blocks at once; messages go from block to block by these, then within all blocks at once.
        """
        n, k = weights.shape
        length = max(1, int(np.ceil(np.sqrt(n))))
        blocks = -(-n // length)
        w = np.ones((blocks * length, k), np.float32)
        w[:n] = weights
        w = w.reshape(blocks, length, k)
        rest = n - (blocks - 1) * length  # words of the last block
        full = lambda t: blocks if t < rest else blocks - 1
        products = np.broadcast_to(np.eye(k, dtype=np.float32), (blocks, k, k)).copy()
        for t in range(length):
            m = full(t)
            x = (products[:m] @ self.step) * w[:m, t, None, :]
            products[:m] = x / x.sum(axis=(1, 2), keepdims=True)
        ahead = np.empty_like(w)
        x = self.first
        for t in range(min(length, n)):
            x = w[0, t] * (x @ self.step if t else x)
            x = ahead[0, t] = x / x.sum()
        starts = np.empty((blocks, k), np.float32)
        for b in range(1, blocks):
            starts[b] = x
            x = x @ products[b]
            x = x / x.sum()
        x = starts[1:]
        for t in range(length):
            m = full(t) - 1
            x = w[1 : m + 1, t] * (x[:m] @ self.step)
            x = ahead[1 : m + 1, t] = x / x.sum(axis=1, keepdims=True)
        back = np.ones((blocks, k), np.float32)
        for b in range(blocks - 1, 0, -1):
            y = products[b] @ back[b]
            back[b - 1] = y / y.sum()
        for t in range(length - 1, -1, -1):
            m = full(t)
            both = ahead[:m, t] * back[:m]
            ahead[:m, t] = both / both.sum(axis=1, keepdims=True)
            y = (back[:m] * w[:m, t]) @ self.step.T
            back[:m] = y / y.sum(axis=1, keepdims=True)
        return ahead.reshape(-1, k)[:n]

    def _alone(self, words: Words, label: bool) -> _Found:
        each = max(1, _CELLS // len(self.first))
        numbers, quads = [], np.zeros(2, np.int64)
        most, self.most = self.most, 1 << 62  # numbers of one text stay valid
        try:
            for a in range(0, len(words.starts), each):
                numbers.append(self._numbers(Words(words.data, words.starts[a : a + each], words.ends[a : a + each], words.first, words.offsets)))
                quads += self.familiar[numbers[-1]].sum(axis=0)
        finally:
            self.most = most
        total, labels = self._stretched(numbers, label)
        return _Found(total[None, :] / len(words.starts), quads[:1], quads[1:], labels, np.array([len(words.starts)]))

    def _together(self, number: np.ndarray, count: np.ndarray, label: bool) -> _Found:
        k = len(self.first)
        seen = self._weights(number)
        ends = np.cumsum(count)
        long = (count >= _LONG) & (k <= _MOST_BLOCKED)
        steps = np.where(long, 0, count)  # long texts take no part in the steps of the others
        order = np.argsort(-steps, kind="stable")
        begin = (ends - count)[order]
        size = steps[order]
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # documents with a word at each place
        ahead = np.empty_like(seen)
        labels = np.zeros(len(seen), np.int64) if label else None
        x = self.first[None, :]
        for t, n in enumerate(alive.tolist()):
            at = begin[:n] + t
            x = seen[at] * (x[:n] @ self.step if t else x)
            x /= x.sum(axis=1, keepdims=True)
            ahead[at] = x
        total = np.zeros((len(size), k))
        back = np.ones((len(size), k), np.float32)
        for t in range(longest - 1, -1, -1):
            n = int(alive[t])
            at = begin[:n] + t
            y = back[:n]
            both = ahead[at] * y
            total[:n] += both / both.sum(axis=1, keepdims=True)
            if labels is not None:
                labels[at] = both.argmax(axis=1)
            y = (y * seen[at]) @ self.step.T
            back[:n] = y / y.sum(axis=1, keepdims=True)
        out = np.zeros((len(size), k))
        out[order] = total / np.maximum(size, 1)[:, None]
        for d in np.flatnonzero(long).tolist():
            chance = self._blocked(seen[ends[d] - count[d] : ends[d]])
            out[d] = chance.mean(axis=0, dtype=np.float64)
            if labels is not None:
                labels[ends[d] - count[d] : ends[d]] = chance.argmax(axis=1)
        quads = np.zeros((len(count), 2), np.int64)
        some = np.flatnonzero(count)
        if len(some):
            for j in (0, 1):
                quads[some, j] = np.add.reduceat(self.familiar[:, j][number], (ends - count)[some], dtype=np.int64)
        return _Found(out, quads[:, 0], quads[:, 1], labels, count)


def _scored(model: Model, column: pa.Array, label: bool = False) -> tuple[np.ndarray, np.ndarray, _Found]:
    """Of each text of a batch: the number of its language, -1 without any, and the score."""
    found = kept(("language", model.key), lambda: _Scorer(model)).documents(column, label)
    best = found.chance.argmax(axis=1)
    scores = np.clip(found.chance[np.arange(len(best)), best], 0, 1)
    best[scores == 0] = -1
    data, offsets = utf8(column)
    plain = np.concatenate([[0], np.cumsum(_LETTERS[data] & ~_DIGITS[data] & (data < 128))])[offsets]
    for i in np.flatnonzero((best >= 0) & (np.diff(plain) == 0)).tolist():
        if not any(map(str.isalpha, column[i].as_py() or "")):
            best[i], scores[i] = -1, 0.0
    return best, scores, found


def _small(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    """Batches whose arrays over words and languages stay small."""
    return small_batches(batches, most=max(64 << 10, BATCH_BYTES * 4 // max(4, len(model.languages) if model else 4)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, n_runs: runs of words of one language) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _small(batches, model):
            n = batch.num_rows
            if model is None:
                best, scores, runs = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
            else:
                best, scores, found = _scored(model, batch.column("text"), label=True)
                runs = _turns(found)[1]
                runs[best < 0] = 0
            names = [UNKNOWN if x < 0 else model.languages[x] for x in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(runs)], ["doc_id", "lang_pred", "score", "n_runs"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_runs long")


def _turns(found: _Found) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each run of one language, and the runs of each text."""
    ends = np.cumsum(found.count)
    new = np.ones(len(found.labels), bool)
    new[1:] = found.labels[1:] != found.labels[:-1]
    new[(ends - found.count)[found.count > 0]] = True
    upto = np.concatenate([[0], np.cumsum(new)])
    return np.flatnonzero(new), upto[ends] - upto[ends - found.count]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def label_words(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, runs: array of (start, end, lang)) for each row of docs: words of one language in a row, by code points, end exclusive.

    Words with digits go with their neighbours. A text without words has no runs, nor has any if there is no model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _small(batches, model):
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if model is not None:
                column = batch.column("text")
                _, _, found = _scored(model, column, label=True)
                words = _words(column)
                begin = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])  # code points before each byte
                turns, many = _turns(found)
                last = np.append(turns[1:], len(words.starts))[: len(turns)] - 1
                doc = np.repeat(np.arange(len(many)), many)
                zero = begin[words.offsets[doc]]
                for d, a, b, k in zip(doc.tolist(), (begin[words.starts[turns]] - zero).tolist(), (begin[words.ends[last]] - zero).tolist(), found.labels[turns].tolist(), strict=True):
                    out[d].append({"start": a, "end": b, "lang": model.languages[k]})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _RUNS)], ["doc_id", "runs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, end: long, lang: string>>")


def prevailing(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, whose text has a language and looks like it (see Rejection above)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _small(batches, model):
            if model is None:
                yield batch.slice(0, 0)
                continue
            best, _, found = _scored(model, batch.column(batch.schema.get_field_index("text")))
            like = (found.quads < _FEW) | (found.seen >= model.least[best] * found.quads)
            yield batch.filter(pa.array((best >= 0) & like))
        release()

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, labelled: DataFrame, settings: Training = Training()) -> DataFrame:
    """Trains on `labelled` (doc_id, text, lang) and predicts for docs."""
    return predict(docs, train(*sample(labelled, settings), settings))


def held_out(column: str = "doc_id") -> Column:
    """Is the row kept out of training: crc32 of the id's digits is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), docs.where(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_runs")
