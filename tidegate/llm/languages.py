"""The language of documents and of the passages in them, by a byte convolutional network.

The network reads windows of a fixed number of words as bytes. Filters of several widths run over
the bytes of a window, every filter keeps its maximum (max pooling), and softmax over these gives
the probabilities of the languages and of "no language" (formulas, markup, digits). It is trained
in numpy on labelled text; labels that the half-trained network contradicts are left out.

Each word stands between blanks, and no filter reaches over them into the next word. So the maximum
over a window is the maximum over its words, and each different word is convolved only once.

Windows overlap by half. Their evidence goes through a Viterbi pass over blocks of words, which
finds passages: runs of one language, of at least ``MIN_PASSAGE`` words. A text in which no run of another
language gains ``MIXED`` changes over the text's own is in one language.

Defined results:
* null or wordless texts and texts without language get ``und`` with confidence 0;
* a document's language is the one of most of its words, ties go to the first in order of name;
* labels count as spelled by ``label_code``: codes of two or three letters, names, with or
  without a region; the known languages are those of the clean samples, and a label that names none of them is
  no valid label;
* passage bounds are exact to a block of ``BLOCK`` words; texts of any length are read whole; text without blanks
  is one word, read in overlapping pieces;
* repeated documents get the same result, extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.words import Numbered, accented_words, portions
from tidegate.session import spread

BLOCK, MIN_PASSAGE, MIN_WORDS = 4, 20, 20
#: Filters by width in bytes.
FILTERS = {2: 16, 3: 24, 4: 24, 6: 16}
WIDEST, ROOM = max(FILTERS), 40
#: Labelled documents that training reads (about), and clean samples that it reads of each table at most, both
#: chosen by a hash. These are the only bounds; what is classified is not bounded.
TRAIN_DOCS, TRAIN_SAMPLES = 2_500, 10_000
STEPS, BATCH, RATE = 300, 256, 0.01
#: Evidence of one window is bounded by this floor; a change of language costs CHANGE.
FLOOR, CHANGE = 0.02, 5.0
#: A text holds a second language only if some run of it gains so many changes over the text's own, with 3 blocks or more.
MIXED = 1.5
#: A run whose confidence is lower is no passage: it says less than chance and noise explain.
MIN_CONFIDENCE = 0.5
#: A text whose confidence is lower has no language.
UNSURE = 0.4
UNKNOWN = "und"
#: Different words that a task keeps features of.
KEPT_WORDS = 300_000

#: Further spellings of languages in labels (three-letter codes, English and own names). A language
#: that is not here is known by its two- or three-letter code.
LABELS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "it": ["it", "ita", "italian", "italiano"],
    "ru": ["ru", "rus", "russian", "русский"],
}


def label_code(label: str | None, known: list[str] | None = None) -> str | None:
    """The code of the language that a label names, or None; only of ``known`` languages if they are given."""
    head = (label or "").strip().lower().replace("_", "-").split("-")[0]
    code = next((code for code, names in LABELS.items() if head in names), head if len(head) in (2, 3) and head.isalpha() else None)
    return code if known is None or code in known else None


def _label_column(c, known: list[str]):
    head = F.element_at(F.split(F.translate(F.lower(F.trim(c)), "_", "-"), "-"), 1)
    code = F.lit(None).cast("string")
    for k in known:
        code = F.when(head.isin(LABELS.get(k, [k])), k).otherwise(code)
    return code


def _bytes(word: str) -> list[bytes]:
    """The word between blanks, in pieces that fit; pieces overlap so that no filter position is lost."""
    raw = b" " + word.encode("utf-8", "replace") + b" "
    return [raw[i : i + ROOM] for i in range(0, max(1, len(raw) - WIDEST + 1), ROOM - WIDEST + 1)]


def _matrix(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, filled up with zeros, and how many of each count (as many as the widest filter at least)."""
    length = np.maximum(np.fromiter(map(len, pieces), np.int64, len(pieces)), WIDEST)
    width = int(length.max())
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width), length


class ByteNet:
    """Filters over bytes, max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.filters = {w: rng.normal(0, 0.3 / w**0.5, (w, 256, n)).astype(np.float32) for w, n in FILTERS.items()}
        for f in self.filters.values():
            f[:, 0, :] = 0  # beyond the end of a word
        self.bias = np.zeros(sum(FILTERS.values()), np.float32)
        self.out = rng.normal(0, 0.1, (len(self.bias), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)
        self.scale = 1.0

    @classmethod
    def of(cls, values: dict) -> ByteNet:
        """The network with these variables."""
        net = cls.__new__(cls)
        vars(net).update(values)
        return net

    def features(self, x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters over each row of bytes up to its length, and where they are."""
        tops = np.empty((len(x), len(self.bias)), np.float32)
        places = np.empty(tops.shape, np.int64)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), 128):  # rows of about one length together
            rows = order[i : i + 128]
            some, ends, col = x[rows, : length[rows[-1]]], length[rows], 0
            for w, f in self.filters.items():
                n = some.shape[1] - w + 1
                y = f[0][some[:, :n]]
                for k in range(1, w):
                    y += f[k][some[:, k : k + n]]
                y[np.arange(n) > (ends - w)[:, None]] = -1e9
                at = y.argmax(1)
                tops[rows, col : col + f.shape[2]] = np.take_along_axis(y, at[:, None, :], 1)[:, 0]
                places[rows, col : col + f.shape[2]] = at
                col += f.shape[2]
        return np.maximum(tops + self.bias, 0), places

    def word_features(self, words: list[str]) -> np.ndarray:
        """Features of words as 8-bit integers (of ``scale``)."""
        parts = [_bytes(w) for w in words]
        pieces, first = [p for ps in parts for p in ps], np.cumsum([0, *map(len, parts[:-1])])
        got = self.features(*_matrix(pieces))[0]
        return np.clip(np.rint(np.maximum.reduceat(got, first) * self.scale), 0, 127).astype(np.int8)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled.astype(np.float32) @ (self.out / self.scale) + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _noise(rng: np.random.Generator, n: int) -> list[str]:
    """Words of no language: digits, single letters, markup, symbols' names, random letters."""
    markup = [
        "sub", "sup", "img", "id", "eq", "alt", "gt", "lt", "br", "td", "tr", "div", "span", "href", "src", "amp", "nbsp", "frac", "begin", "end", "array", "cc", "sum", "int", "alpha", "beta", "delta",
        "lambda", "sqrt", "cdot", "times", "left", "right",
    ]
    letters = list("abcdefghijklmnopqrstuvwxyzαβγδεηλμπρσφωîïãâðñ½²³")
    out: list[str] = []
    # Kinds come in stretches, some of them long enough to fill windows.
    for kind in np.repeat(rng.integers(0, 5, n), rng.choice([1, 1, 2, 20], n))[:n]:
        if kind == 0:
            out.append(str(rng.integers(0, 10 ** int(rng.integers(1, 5)))))
        elif kind < 3:
            out.append(letters[rng.integers(len(letters))])
        elif kind == 3:
            out.append(markup[rng.integers(len(markup))])
        else:
            out.append("".join(rng.choice(letters, rng.integers(2, 7))))
    return out


def train(clean: list[tuple[str, str]], labelled: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> ByteNet:
    """A network from (language, text) pairs; ``clean`` labels are right, ``labelled`` ones mostly."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in [*clean, *labelled]})
    net = ByteNet([*langs, UNKNOWN], seed)
    numbers = Numbered()
    texts: dict[tuple[str, bool], list[np.ndarray]] = {}
    for is_clean, pairs in ((True, clean), (False, labelled)):
        for lang, text in pairs:
            broken = text.encode("utf-8", "replace").decode("latin-1") if rng.random() < 0.05 else text
            if found := accented_words(broken):
                texts.setdefault((lang, is_clean), []).append(numbers.of(found))
    pools = {k: (np.concatenate(v), np.repeat(np.cumsum([len(x) for x in v]), [len(x) for x in v])) for k, v in texts.items()}
    noise = numbers.of(_noise(rng, 20_000))
    vocabulary = list(numbers)
    # Training reads the first ROOM bytes of a word; longer words are rare and are read whole afterwards.
    pieces = [_bytes(w)[0] for w in vocabulary]
    matrix, length = _matrix(pieces)
    size = 2 * BLOCK
    params = [*net.filters.values(), net.bias, net.out, net.out_bias]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    widths = list(FILTERS)
    starts = np.cumsum([0, *FILTERS.values()])
    for step in range(steps):
        rows, target, trusted = np.empty((BATCH, size), np.int64), np.empty(BATCH, np.int64), np.zeros(BATCH, bool)
        for b in range(BATCH):
            c = min(b % (len(net.classes) + 1), len(langs))  # no language has two shares, since it has many faces
            if c == len(langs):
                i = rng.integers(0, len(noise) - size)
                rows[b], trusted[b] = noise[i : i + size], True
            else:
                has = [k for k in ((langs[c], True), (langs[c], False)) if k in pools]
                key = has[0] if len(has) == 1 or rng.random() < 0.3 else has[1]
                pool, end = pools[key]
                i = rng.integers(len(pool))
                row = pool[i : min(i + size, end[i])]
                rows[b] = np.resize(row, size)
                if rng.random() < 0.3:  # some windows have few words, or words of no language among them
                    rows[b, rng.random(size) < 0.4] = noise[rng.integers(len(noise))] if rng.random() < 0.5 else rows[b, 0]
                trusted[b] = key[1]
            target[b] = c
        used, where = np.unique(rows, return_inverse=True)
        where = where.reshape(rows.shape)
        x = matrix[used, : length[used].max()]
        feats, places = net.features(x, length[used])
        per_word = feats[where]
        best = per_word.argmax(1)
        pooled = np.take_along_axis(per_word, best[:, None, :], 1)[:, 0]
        z = pooled @ net.out + net.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p.copy()
        d[np.arange(BATCH), target] -= 1
        if step > steps // 3:
            d[(p[np.arange(BATCH), target] < 0.05) & ~trusted] = 0
        d /= BATCH
        g_out, g_out_bias = pooled.T @ d, d.sum(0)
        g_pool = (d @ net.out.T) * (pooled > 0)
        word = np.take_along_axis(where, best, 1)
        grads = []
        for j, w in enumerate(widths):
            cols = slice(starts[j], starts[j + 1])
            u, g = word[:, cols], g_pool[:, cols]
            f = np.broadcast_to(np.arange(g.shape[1]), g.shape)
            at = places[:, cols][u, f]
            grad = np.zeros(net.filters[w].size, np.float32)
            for k in range(w):
                flat = (k * 256 + x[u, at + k].astype(np.int64)) * g.shape[1] + f
                grad += np.bincount(flat.ravel(), g.ravel(), net.filters[w].size).astype(np.float32)
            grad = grad.reshape(net.filters[w].shape)
            grad[:, 0, :] = 0
            grads.append(grad)
        rate = RATE * (1 if step < steps * 0.7 else 0.3)
        for p_, g, m, s in zip(params, [*grads, g_pool.sum(0), g_out, g_out_bias], means, squares):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p_ -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-6)
    any_ = rng.integers(0, len(matrix), 4096)
    some = net.features(matrix[any_], length[any_])[0]
    net.scale = float(100 / max(np.quantile(some, 0.999), 1e-3))
    return net


def viterbi(scores: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The best class of each row when each change between rows costs ``change``."""
    n, k = scores.shape
    back = np.empty((n, k), np.int16)
    total, own = scores[0].copy(), np.arange(k)
    for i in range(1, n):
        top = int(total.argmax())
        stay = total >= total[top] - change
        back[i] = np.where(stay, own, top)
        total = np.where(stay, total, total[top] - change) + scores[i]
    path = np.empty(n, np.int16)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _gain(scores: np.ndarray, main: int) -> float:
    """The most that a run of one other class would gain over class ``main``."""
    total = np.cumsum(scores - scores[:, main : main + 1], 0)
    low = np.minimum(np.minimum.accumulate(total, 0), 0)
    return float(np.maximum(total[0], total[1:] - low[:-1]).max())


class Reader:
    """Finds the passages of texts; keeps the features of the words it has met."""

    def __init__(self, net: ByteNet):
        self.net, self.langs = net, len(net.classes) - 1
        self.forget()

    def forget(self) -> None:
        # Number 0 is no word; it fills up a text's last block.
        self.numbers, self.known = Numbered({"": 0}), np.zeros((1, len(self.net.bias)), np.int8)

    def _table(self) -> np.ndarray:
        n = len(self.numbers)
        if n > len(self.known):
            fresh = self.net.word_features(list(self.numbers)[len(self.known) :])
            self.known = np.concatenate([self.known, fresh])
        return self.known

    def read(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """For each text its passages in order: (language, first word, word after, confidence)."""
        found: list = []
        if len(self.numbers) > KEPT_WORDS:
            self.forget()
        ids = [self.numbers.of(accented_words(t)) if t else np.empty(0, np.int32) for t in texts]
        for lo, hi in portions([len(i) for i in ids], 50_000):
            found += self._portion(ids[lo:hi])
        return found

    def _portion(self, ids: list[np.ndarray]) -> list:
        table, counts = self._table(), [len(i) for i in ids]
        blocks = [-(-n // BLOCK) for n in counts]
        if not sum(blocks):
            return [[] for _ in ids]
        ends = np.cumsum(blocks)
        filled = np.zeros(ends[-1] * BLOCK, np.int32)
        for i, end, b in zip(ids, ends, blocks):
            filled[(end - b) * BLOCK : (end - b) * BLOCK + len(i)] = i
        pooled = table[filled[::BLOCK]]
        for k in range(1, BLOCK):
            np.maximum(pooled, table[filled[k::BLOCK]], out=pooled)
        last = np.zeros(len(pooled), bool)
        last[[e - 1 for e, b in zip(ends, blocks) if b]] = True
        window = pooled.copy()
        window[:-1] = np.where(last[:-1, None], pooled[:-1], np.maximum(pooled[:-1], pooled[1:]))
        p = self.net.probabilities(window)
        p = p[:, : self.langs] + p[:, self.langs :] / self.langs
        # A block is covered by the window that begins with it and by the one that begins before it;
        # a text's last window is one block long and counts only if it is the only one.
        first = np.zeros(len(pooled), bool)
        first[[e - b for e, b in zip(ends, blocks) if b]] = True
        logs = np.log(p + FLOOR)
        before = np.roll(logs, 1, 0)
        score = np.where(first[:, None], logs, np.where(last[:, None], before, (logs + before) / 2))
        best = score.argmax(1)
        out = []
        for end, b, n in zip(ends, blocks, counts):
            if not b:
                out.append([])
                continue
            mine, sc = best[end - b : end], score[end - b : end]
            main = int(sc.sum(0).argmax())
            # A text is mixed only if some run says clearly more for another language: formulas at an end of it do not.
            if b > 3 and (mine != main).sum() >= 3 and _gain(sc, main) >= MIXED * CHANGE:
                path = viterbi(sc)
                edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b]
            else:
                path, edges = np.full(b, main), [0, b]
            parts = []
            for x, y in zip(edges[:-1], edges[1:]):
                lang = int(path[x])
                conf = float(np.exp(sc[x:y, lang].mean())) - FLOOR
                parts.append((lang, x * BLOCK, min(y * BLOCK, n), max(0.0, min(1.0, conf))))
            out.append(self._tidy(parts))
        return out

    def _tidy(self, parts: list[tuple[int, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """Runs too short or too unsure for a passage join their neighbour; neighbours of one language become one."""
        if len(parts) > 1:
            kept = [p for p in parts if p[2] - p[1] >= MIN_PASSAGE and p[3] >= MIN_CONFIDENCE] or [max(parts, key=lambda p: p[2] - p[1])]
            merged = []
            for lang, a, b, c in kept:
                if merged and merged[-1][0] == lang:
                    _, a0, b0, c0 = merged[-1]
                    merged[-1] = (lang, a0, b, (c0 * (b0 - a0) + c * (b - a)) / (b0 - a0 + b - a))
                else:
                    merged.append((lang, a, b, c))
            end = parts[-1][2]
            parts = [(lang, 0 if i == 0 else merged[i - 1][2], end if i == len(merged) - 1 else b, c) for i, (lang, a, b, c) in enumerate(merged)]
        sure = [(self.net.classes[lang], a, b, round(c, 4)) for lang, a, b, c in parts]
        return [(lang, a, b, c) if c >= UNSURE else (UNKNOWN, a, b, 0.0) for lang, a, b, c in sure]


def training_pairs(documents: DataFrame, samples: list[DataFrame], docs: int = TRAIN_DOCS) -> tuple[list, list]:
    """Clean (lang, text) pairs of ``samples``, whose languages are the known ones, and about ``docs`` documents labelled with one of them."""
    clean = []
    for s in samples:
        rows = s.select("lang", "text").filter("lang is not null and text is not null").orderBy(F.xxhash64("lang", "text")).limit(TRAIN_SAMPLES).collect()
        clean += [(code, r["text"]) for r in rows if (code := label_code(r["lang"])) and r["text"]]
    known = sorted({lang for lang, _ in clean})
    total = documents.count()
    share = min(1.0, docs / max(total, 1))
    picked = documents.select(_label_column(F.col("lang"), known).alias("code"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("h"), "doc_id")
    rows = picked.filter((F.col("h") < int(share * 1_000_000) + 1) & F.col("code").isNotNull() & F.col("text").isNotNull())
    return sorted(clean), [(r["code"], r["text"]) for r in rows.orderBy("h", "doc_id", "code", "text").limit(2 * docs).select("code", "text").collect()]


#: Networks of this process by what they were trained on, the last KEPT_NETS of them.
_trained: dict[str, ByteNet] = {}
KEPT_NETS = 4


def trained(clean: list[tuple[str, str]], labelled: list[tuple[str, str]]) -> ByteNet:
    """``train``, once for the same pairs; a network is a few hundred kilobytes."""
    key = hashlib.sha256(repr((clean, labelled)).encode("utf-8", "replace")).hexdigest()
    if key not in _trained:
        while len(_trained) >= KEPT_NETS:
            _trained.pop(next(iter(_trained)))
        _trained[key] = train(clean, labelled)
    return _trained[key]


PASSAGES = "doc_id bigint, label string, n_words bigint, n_passages int, passage_no int, lang string, first_word bigint, word_after bigint, confidence double, main_lang string, main_confidence double, mixed boolean"


def passages(documents: DataFrame, net: ByteNet) -> DataFrame:
    """One row per passage of each document, with the document's own language and label code.

    A document without words has one row with language ``und``.
    """
    # A few hundred kilobytes, whatever the data; plain values, since broadcasts name classes by their module.
    sent = documents.sparkSession.sparkContext.broadcast(vars(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(ByteNet.of(sent.value))
        known = reader.net.classes[:-1]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[list] = [[] for _ in _TYPES]
                for doc, label, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), reader.read(batch.column(2).to_pylist())):
                    n = found[-1][2] if found else 0
                    size: dict[str, int] = {}
                    for lang, a, b, _ in found:
                        if lang != UNKNOWN:
                            size[lang] = size.get(lang, 0) + b - a
                    main = min(size, key=lambda x: (-size[x], x)) if size else UNKNOWN
                    sure = sum(c * (b - a) for lang, a, b, c in found if lang == main) / max(1, size.get(main, 1))
                    for i, (lang, a, b, c) in enumerate(found or [(UNKNOWN, 0, 0, 0.0)]):
                        for col, v in zip(out, (doc, label_code(label, known), n, len(found), i, lang, a, b, c, main, round(sure, 4), len(size) > 1)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], names=_NAMES)

    return spread(documents.select("doc_id", "lang", "text")).mapInArrow(run, PASSAGES)


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.float64(), pa.bool_()]
_NAMES = [part.split()[0] for part in PASSAGES.split(", ")]


def language_cases(found: DataFrame) -> DataFrame:
    """(doc_id, lang): languages of documents whose label is missing or wrong, or that hold several languages."""
    known = (F.col("lang") != UNKNOWN) & (F.col("main_lang") != UNKNOWN)
    wrong = F.col("label").isNull() | (F.col("label") != F.col("main_lang"))
    return found.filter((F.col("n_words") >= MIN_WORDS) & known & (wrong | F.col("mixed"))).select("doc_id", "lang").distinct()
