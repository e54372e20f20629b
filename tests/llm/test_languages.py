import numpy as np
import pytest

from tests.conftest import DATA
from tidegate.llm import languages as L

DOCS = "doc_id bigint, lang string, text string, label string, main_lang int"


@pytest.fixture(scope="module")
def samples(duck):
    return duck.execute("SELECT lang, text FROM lang_samples ORDER BY sample_id").fetchall()


@pytest.fixture(scope="module")
def net(duck, samples):
    """Trained without the documents whose id is even."""
    rows = duck.execute("SELECT lang, text FROM read_parquet('/root/testdata/sf0.01/documents.parquet') WHERE doc_id % 2 = 1 AND text <> ''").fetchall()
    return L.train(samples, [(c, t) for lang, t in rows if (c := L.label_code(lang))])


def main(found):
    size: dict = {}
    for lang, a, b, _ in found:
        size[lang] = size.get(lang, 0) + b - a
    return max(size, key=size.get) if size else None


def test_held_out_accuracy(duck, net):
    rows = duck.execute("SELECT lang, text FROM read_parquet('/root/testdata/sf0.01/documents.parquet') WHERE doc_id % 2 = 0 AND length(text) > 200").fetchall()
    known = [(c, t) for lang, t in rows if (c := L.label_code(lang))]
    right = sum(main(f) == c for (c, _), f in zip(known, L.Reader(net).read([t for _, t in known])))
    assert right / len(known) > 0.9  # a few percent of the labels are wrong


def test_general_sentences(net, samples):
    texts: dict = {}
    for lang, t in samples:
        texts.setdefault(lang, []).append(t)
    for lang, sentences in texts.items():
        assert main(L.Reader(net).read([" ".join(sentences)])[0]) == lang


def test_passages_in_other_languages(net, samples):
    by: dict = {}
    for lang, t in samples:
        by.setdefault(lang, []).append(t)
    text = " ".join([*by["en"][:6], *by["de"][:4], *by["en"][6:], *by["ru"][:5]])
    found = L.Reader(net).read([text])[0]
    assert [p[0] for p in found] == ["en", "de", "en", "ru"]
    assert found[0][1] == 0 and found[-1][2] == len(L.accented_words(text))
    assert all(x[2] == y[1] for x, y in zip(found, found[1:]))
    short = " ".join([*by["en"][:6], by["de"][6], *by["en"][6:]])
    assert [p[0] for p in L.Reader(net).read([short])[0]] == ["en"]


def test_features_are_maxima_of_sliding_filters(net):
    """Word by word and filter by filter, whatever else is in the batch."""
    words = "the rotor wird gekühlt при давлении a".split()
    together = net.features(*L._matrix([L._bytes(w)[0] for w in words]))[0]
    for w, got in zip(words, together):
        raw = b" " + w.encode() + b" "
        raw = raw.ljust(L.WIDEST, b"\0")
        want = []
        for width, f in net.filters.items():
            want += [max(sum(f[k, raw[i + k], j] for k in range(width)) for i in range(len(raw) - width + 1)) for j in range(f.shape[2])]
        assert np.allclose(got, np.maximum(np.array(want) + net.bias, 0), atol=1e-4)


def test_long_words_are_read_whole(net):
    word = "a" * 500 + "щ" + "b" * 500
    pieces = L._bytes(word)
    joined = pieces[0] + b"".join(p[L.WIDEST - 1 :] for p in pieces[1:])
    assert joined == b" " + word.encode() + b" "


KNOWN = ["de", "en", "es", "fr", "it", "pt", "ru"]


def test_labels():
    assert [L.label_code(x, KNOWN) for x in ("EN", "en-US", "fr_FR", " Deutsch ", "por", "Russian", "xx", "und", "", None, "N/A", "nl")] == ["en", "en", "fr", "de", "pt", "ru", *[None] * 6]
    assert [L.label_code(x) for x in ("nl-BE", "NLD", "dutch", "12", "english")] == ["nl", "nld", None, None, "en"]


def test_an_eighth_language_comes_with_its_samples(spark):
    """Languages are those of the samples, whatever the table of spellings holds."""
    rng = np.random.default_rng(3)
    words = {"nl": "het een ijzer wordt gemaakt niet zijn voor deze waarbij vloeistof geleid naar tussen klep".split(), "en": "the of this fluid which between valve made being from into where steel not".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    samples = spark.createDataFrame([(lang, text(lang, 12), i) for i in range(40) for lang in words], "lang string, text string, n int")
    docs = spark.createDataFrame([(i, ["nl", "nl-NL", None, "en"][i % 4], text("nl" if i % 4 < 3 else "en", 60), "x", 1) for i in range(40)], DOCS)
    clean, labelled = L.training_pairs(docs, [samples])
    assert {c for c, _ in clean} == {"nl", "en"} and len(labelled) == 30
    net = L.trained(clean, labelled)
    assert L.trained(clean, labelled) is net
    assert {tuple(r) for r in L.language_cases(L.passages(docs, net)).collect()} == {(i, "nl") for i in range(2, 40, 4)}


def test_cases_and_odd_texts(spark, net, samples):
    by: dict = {}
    for lang, t in samples:
        by.setdefault(lang, []).append(t)
    en, de = " ".join(by["en"]), " ".join(by["de"])
    rows = [(1, "en", en), (2, "de-DE", en), (3, None, en), (4, "English", en + " " + de[: len(de) // 2]), (5, "xx", by["en"][0]), (6, "en", None), (7, "en", ""), (8, "en", "12 34 / ... \n" * 20), (9, "it", en), (9, "it", en), (10, "en", en * 300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    found = L.passages(docs, net)
    assert {tuple(r) for r in L.language_cases(found).collect()} == {(2, "en"), (3, "en"), (4, "en"), (4, "de"), (9, "en")}
    und = {r["doc_id"]: r for r in found.filter("doc_id in (6, 7, 8)").collect()}
    assert len(und) == 3 and und[6]["n_words"] == 0 and und[6]["lang"] == und[8]["lang"] == "und" and und[8]["confidence"] == 0
    assert found.filter("confidence < 0 or confidence > 1").count() == 0
    assert L.passages(docs.limit(0), net).count() == 0


def test_training_sample_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean, labelled = L.training_pairs(docs, [spark.read.parquet(f"{DATA}/lang_samples.parquet")], docs=100)
    assert len(clean) == 70 and 40 < len(labelled) <= 200
