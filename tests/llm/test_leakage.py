import random
import re
import unicodedata

from tidegate.llm.leakage import capitals, item_names, leak_report, leaks, tokens, window_matches
from tidegate.llm.words import folded_words

DOCS, ITEMS = "doc_id bigint, text string, item_id string, h int", "item_id bigint, text string, doc_id string, lang string"


def plain_words(text):
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if unicodedata.category(c)[0] != "M" and c != "­").lower()
    return re.findall(r"[^\W_]+", text)


def brute(docs, items):
    out = set()
    for d, t in docs:
        ws = plain_words(t or "")
        for i, x in items:
            its = plain_words(x or "")
            n = min(13, len(its))
            runs = {tuple(its[k : k + n]) for k in range(len(its) - n + 1)} if its else set()
            if any(tuple(ws[k : k + n]) in runs for k in range(len(ws) - n + 1)) and runs:
                out.add((d, i))
    return out


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, "x", "en") for i, t in items], ITEMS)
    return {tuple(r) for r in leaks(d, e).collect()}


def test_words_follow_the_definition():
    rng = random.Random(5)
    alphabet = list("abÄéß½²ﬁ İǅ_-.,0٣१ \n") + ["­", "́", "ẛ̣", "한", "中", "𝟘", "̈"]
    for _ in range(2_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        assert folded_words(text) == plain_words(text)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "rotor", "of", "7", "42", "mm", "bar", "Paris", "Müller", "weighs", "grams", "1.5"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 12, 13, 14, 30]))) for i in range(30)]
    docs = []
    for d in range(120):
        t = text(rng.randrange(40))
        if rng.random() < 0.6:
            ws = rng.choice(items)[1].split()
            k = rng.randrange(len(ws))
            t += " " + " ".join(ws[k : k + rng.randrange(1, 20)]).upper() + ", " + text(5)
        docs.append((d, t))
    assert found(spark, docs, items) == brute(docs, items)


def test_case_accents_hyphens_and_line_breaks(spark):
    item = "Der Prüfstand hält die äußere Spindel bei 633 mm während die Kupplung 895 Umdrehungen vollendet und stoppt"
    doc = "X " + unicodedata.normalize("NFD", item.upper().replace("ẞ", "SS")).replace(" ", "\n") + " Y"
    docs = [(1, doc.replace("SS", "ß")), (2, item.replace("Spindel", "Spin­del")), (3, item.replace("633", "634"))]
    assert found(spark, docs, [(9, item)]) == brute(docs, [(9, item)])
    assert (2, 9) in found(spark, docs, [(9, item)])


def test_windows_do_not_run_over_texts(spark):
    ws = [f"w{chr(97 + i)}" for i in range(13)]
    docs = [(1, " ".join(ws[:6])), (2, " ".join(ws[6:])), (3, " ".join(ws))]
    assert found(spark, docs, [(1, " ".join(ws))]) == {(3, 1)}


def test_nulls_empty_texts_repeats_and_empty_tables(spark):
    assert found(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b")], [(1, "a b"), (1, "a b"), (2, None), (3, "")]) == {(3, 1)}
    assert found(spark, [], [(1, "a")]) == set()
    assert found(spark, [(1, "a")], []) == set()


def test_verbatim_windows_are_templates_whose_slots_stand_for_themselves(spark, monkeypatch):
    from tidegate.llm import leakage

    met = []
    monkeypatch.setattr(leakage, "window_matches", lambda *a: met.append(window_matches(*a)) or met[-1])
    item = "The lower vessel of Newton holds 739 ml while the sealed shutter moves by 66 turns and stops"
    other = item.replace("739 ml", "12 bar").replace("66", "5")
    docs = [(1, f"So: {item}"), (2, other), (3, other.replace("sealed", "broken"))]
    items = [(7, item), (8, "He met Newton")]
    assert found(spark, docs, items) == brute(docs, items) == {(1, 7)}
    rows = met[0].filter("item_id = 7").collect()
    assert {r["doc_id"] for r in rows} == {1, 2}
    slots = {d: {(s["value"], s["doc_value"]) for r in rows if r["doc_id"] == d for s in r["slots"]} for d in (1, 2)}
    assert slots[1] == {("newton", "newton"), ("739", "739"), ("ml", "ml"), ("66", "66")}
    assert slots[2] == {("newton", "newton"), ("739", "12"), ("ml", "bar"), ("66", "5")}


def test_templates_lose_no_verbatim_window(spark):
    ws = "a clerk of Kepler counts twelve wheels on every bench and stops then"
    table = " ".join(str(i * 7) for i in range(30))
    docs = [
        (1, f"so 5 {ws}"), (2, ws.upper()), (3, f"x {table} y"), (4, table.replace("49", "50").replace("105", "106")), (5, "9 mm"), (6, "mm 9"), (7, "8 mm"),
        (8, ws.replace("Kepler", "Euler")), (9, "of Mm 5. Then 3 mm Kepler"),
    ]
    items = [(1, ws), (2, table), (3, "mm"), (4, "9 mm"), (5, "Of Kepler 7 bar"), (6, "kg"), (6, "7"), (6, "Then 3 mm"), (6, "Then 4 mm")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want and {(1, 1), (2, 1), (3, 2), (9, 6)} <= want
    turned = [(9, "Then 3 mm"), (9, "Then 4 mm"), (9, "Then 5 mm")]  # one id, one template, three texts
    assert all(found(spark, [(1, f"so then {n} mm")], turned) == {(1, 9)} for n in (3, 4, 5))


def test_very_long_text(spark):
    needle = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    assert found(spark, [(1, "x y " * 200_000 + needle)], [(1, needle)]) == {(1, 1)}


ITEM = "A bench keeps the outer spindle at 633 mm while the lower clutch of Newton completes 895 turns and 633 more; state which change lowers reading 232 first"


def test_other_parameters_are_reported_if_consistent(spark):
    other = ITEM.replace("633", "71").replace("mm", "bar").replace("895", "12").replace("232", "5")
    loose = other.replace("and 71", "and 72")
    docs = spark.createDataFrame([(1, "so: " + ITEM, "", 0), (2, other, "", 0), (3, loose, "", 0), (4, ITEM.replace("spindle", "rotor"), "", 0)], DOCS)
    items = spark.createDataFrame([(7, ITEM, "", "en"), (8, "He met Newton", "", "en")], ITEMS)
    got = {(r["doc_id"], r["item_id"]): r for r in leak_report(docs, items).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {(1, 7): "verbatim", (2, 7): "reparameterised", (4, 7): "verbatim"}
    assert got[1, 7]["share"] == 1.0 and got[4, 7]["share"] < 1
    assert "newton" in item_names(items)


def report(spark, docs, items):
    d = spark.createDataFrame([(i, t, "", 0) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, "", "en") for i, t in items], ITEMS)
    return {(r["doc_id"], r["item_id"]): r for r in leak_report(d, e).collect()}


def test_a_number_is_one_slot_with_or_without_decimals(spark):
    item = "The lower vessel holds 739 ml while the sealed shutter above it moves by 6.6 mm each turn"
    docs = [(1, item.replace("739", "77.9").replace("6.6", "28")), (2, item.replace("739", "1,250").replace("6.6", "28.2")), (3, item)]
    got = report(spark, docs, [(1, item)])
    assert {k: r["kind"] for k, r in got.items()} == {(1, 1): "reparameterised", (2, 1): "reparameterised", (3, 1): "verbatim"}
    assert {r["covered_words"] for r in got.values()} == {19} == {r["item_words"] for r in got.values()}
    assert [t.count("\u02d1") for t in tokens("70.1 bar, 1.250,75 and 12\u202f345; 3. 4, 5")] == [1, 0, 2, 0, 1, 0, 0, 0]


def test_thirteen_words_with_decimals_are_verbatim_in_the_report(spark):
    docs = [(1, "x a1b 1.5 and 2.5 and 3.5 or 4.5 of five y z")]
    items = [(1, "so 1.5 and 2.5 and 3.5 or 4.5 of five then more words follow here until its end")]
    assert set(report(spark, docs, items)) == found(spark, docs, items) == {(1, 1)}


def test_each_occurrence_is_checked_by_itself(spark):
    item = "The lower vessel holds 739 ml while the sealed shutter above it moves by 6.6 mm and then by 739 more"
    one, two = item.replace("739", "12").replace("6.6", "28.2"), item.replace("739", "5.5").replace("6.6", "9").replace("mm", "bar")
    loose = one.replace("by 12", "by 13")
    docs = [(1, f"{one}. Then: {two}"), (2, one), (3, loose), (4, f"{loose}. {two}"), (5, item.replace("by 739", "by 8").replace("6.6", "7").replace("ml", "bar"))]
    got = report(spark, docs, [(1, item)])
    assert {k: r["kind"] for k, r in got.items()} == {(d, 1): "reparameterised" for d in (1, 2, 4)}
    assert {r["share"] for r in got.values()} == {1.0}


def test_new_names_that_no_item_holds(spark):
    other = ITEM.replace("Newton", "Kepler").replace("633", "71").replace("895", "12").replace("232", "5")
    plain = other.replace("Kepler", "kepler")
    mark = other.replace("Kepler", "Change")  # the items use it as a plain word
    docs = [(1, f"See. {other}"), (2, plain), (3, mark), (4, ITEM.upper().replace("633", "71").replace("895", "4").replace("232", "5")), (5, other.upper())]
    got = report(spark, docs, [(7, ITEM), (8, "He met Newton")])
    assert {k for k, r in got.items() if r["share"] == 1} == {(d, 7) for d in (1, 3, 4, 5)}
    assert {r["kind"] for r in got.values()} == {"reparameterised"} and got[2, 7]["share"] < 1  # without the capital only what is beside the name


def test_capitals_follow_sentences():
    text = "The Rotor of Ärmel AB. Kepler moves; Then 12 Bars\nNext A 3 Lines. 7 Days at 70.1 Kelvin"
    found, capital, within = capitals(text)
    assert found == tokens(text)
    assert [w for w, c, i in zip(found, capital, within) if c and i] == ["rotor", "armel", "ab", "bars", "lines", "kelvin"]
    rng = random.Random(7)
    alphabet = list("abÄéß½²ﬁ İǅ_-.,0٣١ \n") + ["­", "́", "ẛ̣", "한", "中", "𝟘", "̈"]
    for _ in range(1_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        found, capital, within = capitals(text)
        assert found == tokens(text) and len(capital) == len(within) == len(found)


def test_units_stand_behind_numbers_only(spark):
    item = "On a bench a rotor of 5 mm and a shaft of 70 kg turn while a clerk counts a second time"
    docs = [(1, item.replace("5 mm", "12 bar").replace("70 kg", "3 lb")), (2, item.replace("5 mm", "12 bar").replace("70 kg", "3 g")), (3, item.replace("a second", "c second").replace("5", "6"))]
    got = report(spark, docs, [(1, item)])
    assert got[2, 1]["kind"] == "reparameterised" and got[2, 1]["share"] == 1
    assert all((d, 1) not in got or got[d, 1]["share"] < 1 for d in (1, 3))


def test_tables_of_numbers_are_no_templates(spark):
    table = " ".join(str(i * 7) for i in range(40))
    got = report(spark, [(1, " ".join(str(i * 3 + 1) for i in range(60))), (2, table)], [(1, table)])
    assert {k: r["kind"] for k, r in got.items()} == {(2, 1): "verbatim"}


def brute_report(docs, items, verbatim=brute):
    """Pairs with their kind: every window of every text compared in plain Python."""
    from tidegate.llm.leakage import UNITS

    names = set()
    lower = set()
    for _, t in items:
        for sentence in re.split(r"(?<=[.!?:;])\s+|\n", t):
            for k, w in enumerate(re.findall(r"[^\W\d_]+", sentence)):
                (names if w[0].isupper() and k and len(w) > 1 else lower if not w[0].isupper() else set()).add(plain_words(w)[0])
    names -= lower

    def number(w):
        return any(c.isdigit() for c in w)

    def template(ws, own=()):
        return [
            "<number>" if number(w) else "<name>" if w in names else "<unit>" if i and number(ws[i - 1]) and w in UNITS else "<name>" if i in own else w
            for i, w in enumerate(ws)
        ]

    wanted = {}
    for i, t in items:
        ws = tokens(t)
        n, typed = min(13, len(ws)), template(ws)
        wanted[i] = [(a, ws[a : a + n], typed[a : a + n]) for a in range(len(ws) - n + 1)] if ws else []
        wanted[i] = [w for w in wanted[i] if 3 * sum(x[0] != "<" for x in w[2]) >= n]
    plain = {x for ws in wanted.values() for _, _, t in ws for x in t if x[0] != "<"}
    out = {pair: "verbatim" for pair in verbatim(docs, items)}
    for d, t in docs:
        ws, capital, within = capitals(t)
        unit = {i for i, x in enumerate(template(ws)) if x == "<unit>"}
        free = [i for i, w in enumerate(ws) if capital[i] and not number(w) and w not in names and i not in unit]
        inner = {ws[i] for i in free if within[i]}
        own = {i for i in free if ws[i] in inner}
        places = {}
        for typed in (template(ws, {i for i in own if ws[i] not in plain}), template(ws, own)):
            for n in {len(w[2]) for windows in wanted.values() for w in windows[:1]}:
                for b in range(len(ws) - n + 1):
                    places.setdefault(tuple(typed[b : b + n]), set()).add(b)
        for i, windows in wanted.items():
            met = {}
            for a, found, want in windows:
                for b in places.get(tuple(want), ()):
                    met.setdefault(b - a, {})[a] = {(x, ws[b + k]) for k, x in enumerate(found) if want[k][0] == "<"}
            for line in met.values():
                for a in line:
                    if a - 1 in line:
                        continue
                    slots = set()
                    while a in line:
                        slots |= line[a]
                        a += 1
                    if len(slots) == len({x for x, _ in slots}):
                        out.setdefault((d, i), "reparameterised")
    return out


def test_report_against_brute_force(spark):
    rng = random.Random(11)
    words = ["the", "rotor", "of", "a", "shaft", "turns", "while", "Kepler", "Newton", "holds", "at", "and"]
    slot = {"N": lambda: str(rng.choice([5, 7, 12, 2.5])), "U": lambda: rng.choice(["mm", "bar", "c"]), "M": lambda: rng.choice(["Kepler", "Newton", "Euler", "Rotor"])}
    pattern = lambda n: [rng.choice([*words, "N", "N U", "M"]) for _ in range(n)]

    def say(p):
        """The pattern's text; mostly each kind of slot has one value throughout."""
        fixed, loose = {k: f() for k, f in slot.items()}, rng.random() < 0.3
        return " ".join(" ".join((slot[x]() if loose else fixed[x]) if x in slot else x for x in part.split()) for part in p)

    patterns = [pattern(rng.choice([6, 15, 25])) for _ in range(20)]
    items = [(i, say(p) + ".") for i, p in enumerate(patterns)]
    docs = [(d, f"{say(pattern(4))}. {say(rng.choice(patterns))}, {say(pattern(5))}. {say(rng.choice(patterns)[2:])}") for d in range(80)]
    got = {k: r["kind"] for k, r in report(spark, docs, items).items()}
    want = brute_report(docs, items)
    assert got == want and len(set(want.values())) == 2 and sum(v == "reparameterised" for v in want.values()) > 10
