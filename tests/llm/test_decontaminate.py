"""Decontamination: exact, edited and re-parameterised items; clean documents."""

import random
from collections import defaultdict

import pytest

from paperloom.llm import decontaminate as dec
from paperloom.llm import entry
from paperloom.llm.decontaminate import drop_contaminated, find_contamination

ITEMS = [
    (1, "A train leaves Paris with 240 passengers and travels 300 km in 4 hours before it stops for the night near Lyon."),
    (2, "short item of five"),
    (3, None),
    (4, ""),
    (5, "12 13 14 15 16 17 18 19 20 21"),
]
PAD = "the quiet garden behind the old house was full of stones and of grass that nobody had cut for years"


def found(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, h string, _gone int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in find_contamination(d, b).collect()}


def test_items_are_found_whole_and_with_other_values(spark):
    item = ITEMS[0][1]
    other = item.replace("Paris", "Rome").replace("240", "99").replace("300", "1,200.5").replace("4 hours", "7 days").replace("Lyon", "Bari")
    docs = [
        (10, f"{PAD} {item} {PAD}"),
        (11, f"{PAD} {other} {PAD}"),
        (12, PAD),
        (13, None),
        (14, ""),
        (15, f"{PAD} Short item, of FIVE! {PAD}"),
        (16, "12 13 14 15 16 17 18 19 20 21 22"),
        (17, f"{PAD} A train leaves Paris with 240 passengers {PAD}"),
        (10, PAD),
        (None, item),
        (18, item.upper().lower() + " " + " ".join(PAD.split() * 5000)),
    ]
    assert found(spark, docs) == {(10, 1), (11, 1), (15, 2), (16, 5), (18, 1), (None, 1)}


def test_inconsistent_slots_do_not_match(spark):
    item = [(1, "first there were 5 of the green ones then 5 of the blue ones and 7 of the red ones")]
    same = "first there were 8 of the green ones then 8 of the blue ones and 2 of the red ones"
    mixed = "first there were 8 of the green ones then 9 of the blue ones and 8 of the red ones"
    assert found(spark, [(1, same), (2, mixed)], item) == {(1, 1)}


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == set() == found(spark, [(1, PAD)], [])


def test_drop_keeps_columns_and_the_rest(spark):
    d = spark.createDataFrame([(1, ITEMS[0][1], 5), (1, PAD, 5), (2, PAD, 6), (2, PAD, 6), (None, ITEMS[0][1], 7), (None, PAD, 8), (None, None, 9)], "doc_id long, text string, _gone int")
    b = spark.createDataFrame([*ITEMS, (None, "an item that has no number of its own but is searched for")], "item_id long, text string")
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r["_gone"] for r in kept.collect()) == [6, 6, 8, 9]
    more = d.select("doc_id", "_gone").limit(1).selectExpr("3L as doc_id", "'We saw an item that has no number of its own but is searched for, today' as text", "_gone")
    assert drop_contaminated(more, b).count() == 0


def test_rows_of_one_id_are_judged_each_by_its_own_text(spark):
    item = ITEMS[0][1]
    assert found(spark, [(1, item), (1, item.replace("240", "99"))]) == {(1, 1)}  # together their values are not one to one
    words = PAD.split()  # 20 plain words, 13 windows
    assert found(spark, [(1, " ".join(words[:11])), (1, " ".join(words[9:]))], [(1, PAD)]) == set()  # 4 windows each, 8 together
    assert found(spark, [(1, item)] * 3, ITEMS * 2) == {(1, 1)}


def plain_windows(text, size):
    """(literal, form, slot values) of the window at each position."""
    kinds, lows, words = [], [], (text or "").split()
    for k, word in enumerate(words):
        bare = dec.core(word)
        kind = 1 if dec.NUMBER.match(bare) else 2 if bare.lower() in dec.UNITS else 0
        capital = bare[:1].isupper() and not (len(bare) > 1 and bare.isupper())
        if kind == 0 and capital and k and words[k - 1][-1] not in '.!?:|"”':
            kind = 3
        kinds.append(kind)
        lows.append(bare.lower())
    out = []
    for a in range(len(words) - size + 1):
        own, least = range(a, a + size), min(dec.PLAIN_WORDS, size)
        forms = []
        for named in (True, False):
            slot = [kinds[k] if named or kinds[k] != 3 else 0 for k in own]
            if slot.count(0) >= least:
                forms.append((False, tuple(dec.SLOT_NAMES[x] if x else lows[k] for x, k in zip(slot, own)), tuple(dec.slot_value(words[k]) for x, k in zip(slot, own) if x)))
        if sum(kinds[k] in (0, 3) for k in own) < least:
            forms.append((True, tuple(lows[k] for k in own), ()))
        out.append(set(forms))
    return out, any(k in (0, 3) for k in kinds)


def plain(docs, items, share=0.5):
    hits = set()
    for item_id, item in set(items):
        size = min(dec.WINDOW, len((item or "").split()))
        if not size:
            continue
        wanted, wordy = plain_windows(item, size)
        if not wordy and size < dec.WINDOW:
            wanted = [{f for f in forms if not f[0]} for forms in wanted]
        n_all, n_template = sum(map(bool, wanted)), sum(any(not f[0] for f in forms) for forms in wanted)
        for doc_id, text in set(docs):
            own, _ = plain_windows(text, size)
            runs = defaultdict(lambda: (set(), set(), set()))
            for a, forms in enumerate(own):
                for b, theirs in enumerate(wanted):
                    for literal, form, values in forms:
                        for l2, f2, v2 in theirs:
                            if (literal, form, len(values)) == (l2, f2, len(v2)):
                                every, template, slots = runs[a - b]
                                every.add(b)
                                template |= set() if literal else {b}
                                slots |= set(zip(v2, values))
            every, template = set(), set()
            for e, t, slots in runs.values():
                if len({i for i, _ in slots}) == len(slots) == len({d for _, d in slots}):
                    every, template = every | e, template | t
            if (n_template and len(template) >= share * n_template) or (every and len(every) >= share * n_all):
                hits.add((doc_id, item_id))
    return hits


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "train", "river", "of", "costs", "travels", "to", "Paris", "Rome", "Lyon", "NASA", "km", "kg", "hours"]
    word = lambda: rng.choice(vocabulary) if rng.random() < 0.75 else str(rng.randint(1, 30)) + rng.choice(["", "%", ".5", ",", ".", "th"])
    text = lambda n: " ".join(rng.choice(["", "", "(", "**"]) + word() + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    items = [(k, text(rng.randint(1, 22))) for k in range(14)] + [(None, text(12)), (3, text(9))]
    docs = []
    for k in range(60):
        own = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 4)):
            j = rng.randrange(len(own))
            own[j] = rng.choice([str(rng.randint(1, 30)), word(), own[j].lower(), own[j] + ","])
        cut = rng.randint(0, len(own) // 3)
        docs.append((rng.choice([k, k, k // 2, None]), f"{text(rng.randint(0, 9))} {' '.join(own[cut:])} {text(rng.randint(0, 9))}"))
    assert found(spark, docs, items) == plain(docs, items)


def test_random_prose_is_clean(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("the of and river stone mill bridge water light old small long".split()) for _ in range(n))
    assert found(spark, [(k, text(200)) for k in range(200)], [(k, text(30)) for k in range(50)]) == set()


def test_query_against_plain_containment(spark):
    folder = "/root/testdata/sf0.01"
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    norm = lambda t: " ".join(w.strip(".,;:!?").lower() for w in (t or "").split())
    docs = {r.doc_id: f" {norm(r.text)} " for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    whole = {(i, k) for i, t in docs.items() for k, x in items.items() if f" {norm(x)} " in t}
    grams = {k: {tuple(w[a : a + 6]) for w in [norm(x).split()] for a in range(len(w) - 5)} for k, x in items.items()}
    touched = {(i, k) for i, t in docs.items() for k, g in grams.items() if {tuple(w[a : a + 6]) for w in [t.split()] for a in range(len(w) - 5)} & g}
    got = {(r.doc_id, r.item_id) for r in entry.op4_decontaminate(spark, folder).collect()}
    assert whole <= got <= touched and whole


def test_items_with_few_plain_words_are_found_by_their_literal_words(spark):
    items = [
        (1, "5 km 10 km 15 km 20 km gives 25 km 30 km 35 km 40 km"),
        (2, "12 + 30 = 42"),
        (3, "7 kg 8 kg 9 kg"),
        (4, "Add the weights of the boxes below: 1 kg 2 kg 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg 9 kg 10 kg 11 kg 12 kg total 78 kg"),
    ]
    docs = [
        (10, f"{PAD} {items[0][1]} {PAD}"),
        (11, f"{PAD} {items[0][1].replace('15', '16').replace('30', '31')} {PAD}"),
        (12, f"{PAD} 12 + 30 = 42. {PAD}"),
        (13, f"{PAD} 12 + 30 = 43. {PAD}"),
        (14, f"{PAD} {items[3][1]} {PAD}"),
        (15, f"{PAD} {items[3][1][items[3][1].index('1 kg'):]} {PAD}"),
        (16, " ".join(str(k) for k in range(400))),
    ]
    assert found(spark, docs, items) == {(10, 1), (12, 2), (14, 4), (15, 4)}


def test_marks_around_a_slot_value_do_not_change_it(spark):
    item = [(1, "first there were 5 of the green ones then 5 of the blue ones and 7% of the red ones and 7 more")]
    docs = [(k, item[0][1].replace("then 5", f"then {v}")) for k, v in enumerate(["(5)", '"5"', "**5**", "“5”,", "$5$", "(6)"])]
    docs.append((10, item[0][1].replace("7%", "9%").replace("7 more", "4 more")))
    assert found(spark, docs, item) == {(k, 1) for k in (0, 1, 2, 3, 4, 10)}
