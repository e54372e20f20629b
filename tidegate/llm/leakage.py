"""Evaluation texts inside training documents, verbatim or with other parameters.

Numbers, units and names are typed placeholders, so that a text is a template. Windows of ``WINDOW``
places of it are hashed; document windows are screened by the hashes of the items' windows and
hash-joined with them, and the slots of those that meet are compared.

``leaks`` looks for verbatim occurrences. Places are words there (see ``words.folded_words``), the
template of a window follows from its own words alone, and each slot has to stand for itself.

``leak_report`` looks for re-parameterised questions too. Places are tokens there: words, but a
number with its decimal and thousands marks is one. Windows of one template that follow each other
without a gap in both texts are one occurrence: if each value of the item, also one that was kept,
stands for the same value throughout it, it is a re-parameterised question. (Two values of the item
may become equal: 3 and 5 apples may be 4 and 4 in a variant.) Its verbatim occurrences are windows
of words without placeholders, since 13 words can be fewer tokens.

An item shorter than a window is one window of its own length.

Defined results:
* a null or wordless item or document takes part in nothing; repeated documents, items and
  passages give one row per pair of ids;
* every document window is hashed, in texts of any length; no window, document or match is capped;
* names are the words that the items write with a capital within a sentence and never without;
  an item table without any simply has no such placeholder. In a document, names are these and the
  words that it writes with a capital within a sentence, where they have the capital. Such a word
  that the items use as a plain word is read both ways, but within one window all of them alike;
* a unit is one of ``UNITS`` right behind a number; elsewhere the same letters are a word;
* a window of tokens of which less than a third are words says nothing and is none: else tables of
  numbers would all be alike. In ``leaks`` such a window has no placeholders;
* empty tables give empty results; extra columns are ignored.

The screen is a bit table with SCREEN_BITS bits for each item window, of 32 MB at most (with more item windows
it lets more through); besides it only the different words of the items are broadcast, not their windows. What is
shuffled are the document windows that pass the screen, and those join by hash with the items' windows. A window
that very many documents hold makes a skewed partition of that join, which adaptive execution splits.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.words import Numbered, _plan as plan, folded_words, once, portions
from tidegate.session import cut_and_count, spread

WINDOW = 13
#: Bits of the screen for each item window, of which each sets two (so about 1 of 1,000 other windows passes), and its bounds as powers of two.
SCREEN_BITS, LEAST_BITS, MOST_BITS = 64, 16, 28
#: The screen is put together in pages of 2^PAGE_BITS bits.
PAGE_BITS = 15
#: Different words that a task keeps hashes of.
KEPT_WORDS = 500_000

#: Symbols of units and the prefixes that go before them, in folded text, and units' names.
SYMBOLS = ("m", "g", "s", "a", "k", "mol", "cd", "hz", "n", "pa", "j", "w", "c", "v", "f", "ohm", "ω", "s", "wb", "t", "h", "lm", "lx", "l", "bar", "ev", "b", "bit", "byte", "wh", "ah", "rpm", "dpi")
PREFIXES = ("", "p", "n", "u", "µ", "μ", "m", "c", "d", "h", "k", "g", "t")
NAMES = (
    "percent", "prozent", "pourcent", "por", "degree", "degrees", "grad", "degrés", "grados", "graus", "gradi", "min", "minute", "minutes", "minuten", "minutos", "minuti",
    "second", "seconds", "sekunde", "sekunden", "secondes", "segundos", "secondi", "hour", "hours", "stunde", "stunden", "heures", "horas", "ore", "day", "days", "tage", "jours", "días", "dias", "giorni",
    "gram", "grams", "gramm", "grammes", "gramos", "gramas", "grammi", "kilogram", "kilograms", "kilogramm", "meter", "meters", "metre", "metres", "mètres", "metros", "metri", "kilometers", "kilometer",
    "liter", "liters", "litre", "litres", "litros", "litri", "inch", "inches", "zoll", "foot", "feet", "mile", "miles", "pound", "pounds", "volt", "volts", "watt", "watts", "ampere", "amperes", "bar", "rpm",
    "мм", "см", "м", "км", "г", "кг", "мг", "л", "мл", "с", "мин", "ч", "гц", "кгц", "мгц", "в", "вт", "квт", "а", "па", "кпа", "мпа", "процентов", "градусов",
)
UNITS = frozenset(" ".join(folded_words(w)) for w in (*(p + u for p in PREFIXES for u in SYMBOLS), *NAMES))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPLIT = re.compile(r"(?<=[.!?:;])\s+|\n")
#: Decimal and thousands marks between digits, and the letter that stands for them in a token.
_MARKS, _JOINT = re.compile(r"(?<=\d)(?:[.,'’·](?=\d)|[\u00a0\u2009\u202f](?=\d{3}(?!\d)))"), "\u02d1"


def tokens(text: str) -> list[str]:
    """The folded words of the text, but a number with its decimal and thousands marks is one."""
    return folded_words(_MARKS.sub(_JOINT, text))


def _flags() -> np.ndarray:
    """Per code point: 1 for a capital, 2 for blanks, 4 for the marks that end a sentence, 8 for digits."""
    return once("capitals", _build_flags)


def _build_flags() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        out[c] = ch.isupper() + 2 * ch.isspace() + 4 * (ch in ".!?:;") + 8 * ch.isdigit()
    return out


def capitals(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The tokens of the text; whether each is longer than a letter and begins with a capital; and whether it stands within a sentence."""
    text = _MARKS.sub(_JOINT, text)
    text = text if text.isascii() else unicodedata.normalize("NFKD", text)
    stays, becomes = plan()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes[stays[codes]]
    plain, flags = becomes[codes], _flags()[codes]
    found = plain.tobytes().decode("utf-32-le", "surrogatepass").lower().split()
    held = np.concatenate([[False], plain != ord(" "), [False]])
    edges = np.flatnonzero(held[1:] != held[:-1])
    starts, ends = edges[::2], edges[1::2]
    splits = (codes == ord("\n")) | ((flags & 2 > 0) & np.concatenate([[False], flags[:-1] & 4 > 0])[: len(codes)])
    sentence = np.cumsum(splits)[starts]
    lettered = np.flatnonzero(flags[starts] & 8 == 0)  # a sentence begins with its first word that is no number
    within = np.zeros(len(starts), bool)
    within[lettered[1:]] = sentence[lettered[1:]] == sentence[lettered[:-1]]
    return found, (flags[starts] & 1 > 0) & (ends - starts > 1), within


#: How a text is read for each kind of window.
READERS = {"verbatim": folded_words, "typed": folded_words, "template": tokens}


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sums(part: Callable[[int], np.ndarray], length: int) -> np.ndarray:
    """The hash of windows from the hashes of their first, second and further words."""
    out = part(0).copy()
    for k in range(1, length):
        out *= _BASE
        out += part(k)
    return _mixed(out)


def _hash(word: str) -> int:
    """A 64-bit hash that is the same in every process."""
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "replace"):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 33
    return h * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF


class Words:
    """Numbers words and knows the hash of each."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.numbers, self.hashes = Numbered(), np.empty(0, np.uint64)

    def slot(self, word: str) -> str | None:
        """The placeholder that stands for the word, or None."""
        return None

    def template(self, found: list[str], marks: Iterable[int] = ()) -> list[str]:
        return []

    def learn(self) -> None:
        if len(self.numbers) > len(self.hashes):
            fresh = list(self.numbers)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.array([_hash(self.slot(w) or w) for w in fresh], np.uint64)])

    def windows(self, h: np.ndarray, length: int) -> np.ndarray:
        """The hash of each run of ``length`` words that have the hashes ``h``."""
        n = len(h) - length + 1
        return _sums(lambda k: h[k : n + k], length) if n > 0 else np.empty(0, np.uint64)


#: What a place in a text is beside what its word says.
UNIT, NAME = 1, 2
MARKS = ("", "<unit>", "<name>")


class Templates(Words):
    """Numbers tokens and knows the template hash of each."""

    def __init__(self, names: frozenset[str], plain: frozenset[str] = frozenset(), units: frozenset[str] = UNITS):
        self.names, self.plain, self.units = names, plain, units
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.typed, self.known, self.digits, self.unit = (np.empty(0, bool) for _ in range(4))

    def learn(self) -> None:
        fresh = list(self.numbers)[len(self.typed) :] if len(self.numbers) > len(self.typed) else []
        slots = [self.slot(w) for w in fresh]
        self.typed = np.concatenate([self.typed, np.array([x is not None for x in slots], bool)])
        self.digits = np.concatenate([self.digits, np.array([x == "<number>" for x in slots], bool)])
        self.known = np.concatenate([self.known, np.array([w in self.plain for w in fresh], bool)])
        self.unit = np.concatenate([self.unit, np.array([w in self.units for w in fresh], bool)])
        super().learn()

    def units_of(self, ids: np.ndarray) -> np.ndarray:
        """Where a text has units: right behind numbers."""
        behind = np.zeros(len(ids), bool)
        behind[1:] = self.digits[ids[:-1]]
        return behind & self.unit[ids] & ~self.digits[ids]

    def own_names(self, ids: np.ndarray, capital: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Where a text has names of its own: not typed otherwise, with a capital, and here or elsewhere within a sentence."""
        own = capital & ~self.typed[ids] & ~self.units_of(ids)
        return own & np.isin(ids, ids[own & within])

    def slot(self, word: str) -> str | None:
        """What the word stands for whatever its place; units need a number before them."""
        if any(ch.isdigit() for ch in word):
            return "<number>"
        return "<name>" if word in self.names else None

    def template(self, found: list[str], marks: Iterable[int] = ()) -> list[str]:
        return [MARKS[mark] if mark == UNIT else self.slot(w) or (MARKS[mark] if mark else w) for w, mark in zip_longest(found, marks, fillvalue=0)]


class TypedWords(Templates):
    """Types words by nothing but their window: equal words have equal templates, whatever stands around them.

    A window of which less than a third are plain words has no placeholders.
    """

    def forget(self) -> None:
        super().forget()
        self.literal = np.empty(0, np.uint64)

    def learn(self) -> None:
        super().learn()
        if len(self.numbers) > len(self.literal):
            known = len(self.literal)
            self.literal = np.concatenate([self.literal, self.hashes[known:]])
            for i, w in enumerate(list(self.numbers)[known:], known):
                if self.typed[i]:
                    self.literal[i] = _hash(w)

    def typed_windows(self, ids: np.ndarray, units: np.ndarray, length: int) -> np.ndarray:
        """The hash of each window's template; the first word of a window is no unit, since its number is not in it."""
        n = len(ids) - length + 1
        if n < 1:
            return np.empty(0, np.uint64)
        first, upto = self.typed[ids], np.concatenate([[0], np.cumsum(self.typed[ids] | units)])
        plain = length - first[:n] - (upto[length:] - upto[1 : n + 1])
        alone = self.hashes[ids]
        h = np.where(units, np.uint64(_hash("<unit>")), alone)
        out = _sums(lambda k: h[k : n + k] if k else alone[:n], length)
        bare = np.flatnonzero(3 * plain < length)
        if len(bare):
            out[bare] = _sums(lambda k: self.literal[ids[bare + k]], length)
        return out

    def template(self, found: list[str], marks: Iterable[int] = ()) -> list[str]:
        slots = [self.slot(w) for w in found]
        out = ["<unit>" if before == "<number>" != own and w in self.units else own or w for w, before, own in zip(found, [None, *slots], slots)]
        return found if 3 * sum(w[0] != "<" for w in out) < len(out) else out


def hashers(kinds: Iterable[str], names: frozenset[str], plain: frozenset[str] = frozenset()) -> dict[str, Words]:
    made = {"verbatim": Words, "typed": lambda: TypedWords(names), "template": lambda: Templates(names, plain)}
    return {kind: made[kind]() for kind in kinds}


def item_names(items: DataFrame) -> frozenset[str]:
    """Words that the items write with a capital inside a sentence and never in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up: dict[str, int] = {}
            low: set[str] = set()
            for text in batch.column(0).to_pylist():
                for sentence in _SPLIT.split(text or ""):
                    for i, token in enumerate(re.findall(r"[^\W\d_]+", sentence)):
                        word = " ".join(folded_words(token))
                        if token[0].isupper() and i and len(token) > 1:
                            up[word] = up.get(word, 0) + 1
                        elif not token[0].isupper():
                            low.add(word)
            rows = [(w, n, False) for w, n in up.items()] + [(w, 0, True) for w in low]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_()))], names=["word", "n", "low"])

    found = items.select("text").mapInArrow(run, "word string, n bigint, low boolean").groupBy("word").agg(F.sum("n").alias("n"), F.max("low").alias("low"))
    rows = found.filter("n > 0 and not low and word != ''").select("word").collect()
    return frozenset(r["word"] for r in rows)


def plain_words(wanted: DataFrame) -> frozenset[str]:
    """Words that stand as themselves in the items' templates."""
    rows = wanted.filter("kind = 'template'").select(F.explode("template").alias("word")).distinct().filter("word not like '<%'").collect()
    return frozenset(r["word"] for r in rows)


_ITEM = "item_id bigint, item_words int, kind string, length int, at int, word_from int, word_to int, h bigint, found array<string>, template array<string>"


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def item_windows(items: DataFrame, names: frozenset[str], kinds: Iterable[str], window: int = WINDOW) -> DataFrame:
    """The windows of each item: of words (kind ``verbatim``), of words with placeholders (``typed``) and of tokens (``template``), with their hash.

    ``at`` counts words or tokens; ``word_from`` to ``word_to`` (not included) are the words that the window takes up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = hashers(kinds, names)
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or item is None:
                    continue
                for kind, t in readers.items():
                    ws = READERS[kind](text)
                    if not ws:
                        continue
                    begins = np.cumsum([0, *(w.count(_JOINT) + 1 if kind == "template" else 1 for w in ws)]).tolist()
                    n = min(window, len(ws))
                    ids = t.numbers.of(ws)
                    t.learn()
                    windows, marks, _ = next(_readings(t, [ids], [(np.zeros(len(ids), bool), np.zeros(len(ids), bool))]))
                    for at, h in enumerate(windows(n).view(np.int64).tolist()):
                        template = t.template(ws[at : at + n], marks[at : at + n].tolist() if marks is not None else ())
                        if kind == "template" and 3 * sum(w[0] != "<" for w in template) < n:
                            continue
                        for col, v in zip(out, (item, begins[-1], kind, n, at, begins[at], begins[at + n], h, ws[at : at + n], template)):
                            col.append(v)
            yield _batch(out, _ITEM)

    return items.select("item_id", "text").mapInArrow(run, _ITEM).dropDuplicates(["item_id", "kind", "at", "h", "length", "found"])


_DOC = "doc_id bigint, kind string, length int, doc_at int, h bigint, doc_found array<string>, doc_template array<string>"


def _readings(t: Words, ids: list[np.ndarray], caps: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[Callable[[int], np.ndarray], np.ndarray | None, np.ndarray | None]]:
    """What gives the hashes of joined texts' windows of a length, the marks of their places, and which windows are new: those over a place that is true here.

    Words that the items use too are read as themselves first, then as names.
    """
    joined = np.concatenate(ids)
    h = t.hashes[joined]
    if not isinstance(t, Templates):
        yield partial(t.windows, h), None, None
        return
    units = np.concatenate([t.units_of(i) for i in ids])
    if isinstance(t, TypedWords):
        yield partial(t.typed_windows, joined, units), None, None
        return
    own = np.concatenate([t.own_names(i, *c) for i, c in zip(ids, caps)])
    h = np.where(units, np.uint64(_hash("<unit>")), h)
    name = np.uint64(_hash("<name>"))
    both = own & t.known[joined]
    marks = np.where(units, UNIT, np.where(own & ~both, NAME, 0))
    yield partial(t.windows, np.where(marks == NAME, name, h)), marks, None
    if both.any():
        yield partial(t.windows, np.where(own, name, h)), np.where(units, UNIT, np.where(own, NAME, 0)), both


def _is_set(screen: np.ndarray, place: np.ndarray) -> np.ndarray:
    return screen[place >> 3] >> (place & 7).astype(np.uint8) & 1


def document_windows(documents: DataFrame, names: frozenset[str], plain: frozenset[str], sought: dict[str, tuple[list[int], np.ndarray]], bits: int) -> DataFrame:
    """The document windows that pass the screen; ``sought`` has the lengths and the screen, of 2^bits bits, of each kind."""
    sent = documents.sparkSession.sparkContext.broadcast((names, plain, sought))
    shift, low = np.uint64(64 - bits), np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, plain, sought = sent.value
        readers = hashers(sought, names, plain)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                docs, whole_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out: list[list] = [[] for _ in range(7)]
                for kind, t in readers.items():
                    lengths, screen = sought[kind]
                    if len(t.numbers) > KEPT_WORDS:
                        t.forget()
                    read = [x if d is not None and x else "" for d, x in zip(docs, whole_texts)]
                    caps: list = []
                    if kind == "template":
                        texts, *flags = zip(*map(capitals, read)) if read else ([], [], [])
                        caps = list(zip(*flags))
                    else:
                        texts = [READERS[kind](x) for x in read]
                    ids = [t.numbers.of(x) for x in texts]
                    t.learn()
                    for lo, hi in portions([len(i) for i in ids], 100_000):
                        ends = np.cumsum([len(i) for i in ids[lo:hi]])
                        for windows, marks, fresh in _readings(t, ids[lo:hi], caps[lo:hi]):
                            upto = np.concatenate([[0], np.cumsum(fresh)]) if fresh is not None else None
                            for n in lengths:
                                h = windows(n)
                                hits = np.flatnonzero(_is_set(screen, (h >> shift).astype(np.int64)))
                                hits = hits[_is_set(screen, (h[hits] & low).astype(np.int64)) > 0]
                                if upto is not None:
                                    hits = hits[upto[hits + n] > upto[hits]]
                                which = np.searchsorted(ends, hits, "right")
                                for at, d in zip(hits.tolist(), which.tolist()):
                                    if at + n <= ends[d]:  # windows lie within one text
                                        own = at - (int(ends[d - 1]) if d else 0)
                                        ws = texts[lo + d][own : own + n]
                                        template = t.template(ws, marks[at : at + n].tolist() if marks is not None else ())
                                        for col, v in zip(out, (docs[lo + d], kind, n, own, int(h[at : at + 1].view(np.int64)[0]), ws, template)):
                                            col.append(v)
                if out[0]:
                    yield _batch(out, _DOC)

    return spread(documents.select("doc_id", "text")).mapInArrow(run, _DOC)


def _screens(wanted: DataFrame, kinds: Iterable[str], bits: int) -> dict[str, tuple[list[int], np.ndarray]]:
    """The lengths of each kind's windows and its bit table, which comes to the driver in pages.

    A window sets the bits at the upper and at the lower end of its hash.
    """

    def page(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << PAGE_BITS, bool)
        own[rows["place"].to_numpy() & ((1 << PAGE_BITS) - 1)] = True
        return pa.table({"kind": rows["kind"][:1], "page": rows["page"][:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    both = F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1)))
    placed = wanted.select("kind", F.explode(both).alias("place")).select("kind", "place", F.shiftright("place", PAGE_BITS).alias("page"))
    pages = placed.groupBy("kind", "page").applyInArrow(page, "kind string, page bigint, bits binary").collect()
    lengths = wanted.select("kind", "length").distinct().collect()  # at most as many as a window has words
    out = {}
    for kind in kinds:
        screen = np.zeros(1 << (bits - 3), np.uint8)
        for r in pages:
            if r["kind"] == kind:
                at = r["page"] << (PAGE_BITS - 3)
                screen[at : at + (1 << (PAGE_BITS - 3))] = np.frombuffer(r["bits"], np.uint8)
        out[kind] = sorted(r["length"] for r in lengths if r["kind"] == kind), screen
    return out


def window_matches(documents: DataFrame, items: DataFrame, kinds: Iterable[str], window: int = WINDOW) -> DataFrame:
    """Pairs of windows with the same words (kind ``verbatim``) or the same template (``typed``, ``template``): doc_id, item_id, item_words, kind, length, at, word_from, word_to, doc_at, slots.

    ``slots`` are the values of the placeholders in the item and in the document. Words and templates
    are compared too, so equal hashes of different ones are left out.
    """
    names = item_names(items) if set(kinds) - {"verbatim"} else frozenset()
    wanted, n = cut_and_count(item_windows(items, names, kinds, window), "true")
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(SCREEN_BITS * max(1, n)))))
    sought = _screens(wanted, kinds, bits)
    plain = plain_words(wanted) if "template" in kinds else frozenset()
    met = document_windows(documents, names, plain, sought, bits)
    equal = (F.col("template") == F.col("doc_template")) & ((F.col("kind") != "verbatim") | (F.col("found") == F.col("doc_found")))
    typed = F.filter(F.arrays_zip("template", "found", "doc_found"), lambda p: p["template"].startswith("<"))
    slots = F.transform(typed, lambda p: F.struct(p["found"].alias("value"), p["doc_found"].alias("doc_value")))
    return met.join(wanted, ["kind", "h", "length"]).filter(equal).withColumn("slots", slots).drop("h", "template", "doc_template", "found", "doc_found")


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id): documents that hold a window of an item word for word: its template with each slot standing for itself."""
    same = F.forall("slots", lambda s: s["value"] == s["doc_value"])
    return window_matches(documents, items, ["typed"], window).filter(same).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, kind, windows, covered_words, item_words, share) of every affected pair.

    ``kind``: ``verbatim`` if some window is word for word, ``reparameterised`` if none is but the slots of some
    occurrence are consistent: each number, unit or name of the item stands for one value throughout it.
    ``windows`` is the number of words of the item at which a window that was found begins; windows of
    inconsistent occurrences count nowhere.
    """
    matches = window_matches(documents, items, ["verbatim", "template"], window)
    line = ["doc_id", "item_id", "kind", "length", F.col("doc_at") - F.col("at")]
    run = F.col("at") - F.dense_rank().over(Window.partitionBy(*line).orderBy("at"))
    occurrences = matches.select("*", line[-1].alias("shift"), run.alias("run")).groupBy("doc_id", "item_id", "kind", "length", "shift", "run").agg(
        F.max("item_words").alias("item_words"), F.collect_set("word_from").alias("places"), F.min("word_from").alias("word_from"), F.max("word_to").alias("word_to"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    consistent = occurrences.filter(F.size("slots") == F.size(F.array_distinct(F.col("slots.value"))))
    words = F.sequence("word_from", F.col("word_to") - 1)
    pairs = consistent.groupBy("doc_id", "item_id").agg(
        F.max(F.col("kind") == "verbatim").alias("verbatim"), F.max("item_words").alias("item_words"),
        *[F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("bigint").alias(n) for c, n in (("places", "windows"), (words, "covered_words"))],
    )
    kind = F.when(F.col("verbatim"), "verbatim").otherwise("reparameterised")
    return pairs.select("doc_id", "item_id", kind.alias("kind"), "windows", "covered_words", "item_words", F.round(F.col("covered_words") / F.col("item_words"), 4).alias("share"))
