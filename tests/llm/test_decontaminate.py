from stallwright.llm import decontaminate as dc

from ..conftest import SMALL
from .brute import documents, empty, odd

ITEM = "If Maria walks 12 km in 3 hours and then Maria rests for 12 minutes before walking home again what is her speed"


def bench(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_template(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(dc.template(F.lit("Then Ann paid 12 km, or 3.")).alias("a"), dc.template(F.lit("Then Ann paid 12 km, or 3."), True).alias("b")).first()
    assert row.a == ["then", "\u0001n", "paid", "\u0001d", "\u0001u", "or", "\u0001d"]
    assert row.b == ["then", "\u0001nann", "paid", "\u0001d12", "\u0001ukm", "or", "\u0001d3"]
    texts = ["It is 3.5 l, or 1,200.", "He saw Twelve  boys\n\nin ten minutes (at 10:30)", "v1.5.2 and 1.5x cost $3.50", "tennis, weight 12km/h"]
    want = [["it", "is", "\1d3.5", "\1ul", "or", "\1d1,200"], ["he", "saw", "\1ntwelve", "boys", "in", "\1dten", "\1uminutes", "at", "\1d10\1d30"], ["v1.5.2", "and", "\1d1.5x", "cost", "$\1d3.50"], ["tennis", "weight", "\1d12", "\1ukm/h"]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(dc.template(F.col("t")).alias("a"), dc.template(F.col("t"), True).alias("b")).collect()
    assert [r.b for r in rows] == want
    assert all(len(r.a) == len(r.b) for r in rows)


def leaked(spark, docs, *items):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in dc.leaks(df, bench(spark, *items)).collect())


def test_new_numbers_and_names_are_caught_if_consistent(spark):
    same = f"Some words before. {ITEM}. And after."
    other = same.replace("12", "40").replace("Maria", "Ivan").replace("3 hours", "5 hours")
    mixed = same.replace("12 km", "40 km").replace("and then Maria", "and then Ivan")  # one slot, two values
    clean = "Maria walks to school each day and she likes it very much indeed as all her friends do in the sun"
    assert leaked(spark, [same, other, mixed, clean], ITEM) == [(0, 0), (1, 0)]


def slow_template(text, values):
    """The template rules in plain Python."""
    import regex

    value = (lambda *g: lambda m: "".join(x for x in map(m.group, g) if x)) if values else (lambda *g: lambda m: "")
    t = regex.sub(dc.SPACES, " ", (text or "").replace("\1", ""))
    t = regex.sub(dc._NAME, lambda m: "\1n" + value(0)(m), t)
    alone = r"(?<![0-9][.,])(?<![\x01\p{L}0-9])"
    t = regex.sub(alone + dc._QUANTITY, lambda m: f"\1d{value(1, 3)(m)} \1u{value(2, 4)(m)}", t)
    t = regex.sub(alone + dc._NUMBER, lambda m: "\1d" + value(0)(m), t)
    return regex.sub(dc._PUNCTUATION, "", t).strip(" ").lower().split()


def slow_leaks(docs, items, window=8, literal=5, coverage=0.5):
    """Every document against every item, window by window, without hashes or joins."""
    is_slot = lambda x: x.startswith("\1")
    unname = lambda xs: [x.removeprefix("\1n") for x in xs]
    enough = lambda xs: sum(not is_slot(x) for x in xs) >= literal
    out = {}
    read = [(d, slow_template(t, False), slow_template(t, True)) for d, t in docs]
    for item, text in items:
        w, v = slow_template(text, False), slow_template(text, True)
        if not w:
            continue
        named = ["\1n", *w[1:]]
        cuts = [(i, w[i : i + window]) for i in range(len(w) - window + 1)]
        usable = [(i, x) for i, x in cuts if enough(x)]
        ways = []
        if usable:
            ways.append((0, window, [*usable, *[(0, named[:window]) for i, _ in usable if i == 0]]))
        else:
            short = min(len(w), window)
            ways.append((1, short, [(i, unname(v)[i : i + short]) for i in range(len(w) - short + 1)]))
            if enough(w) or (sum(not is_slot(x) for x in w) >= dc.MIN_SHORT_LITERAL and len(w) >= dc.MIN_SHORT_TOKENS):
                ways.append((2, len(w), [(0, w), (0, named)]))
        for doc, dw, dv in read:
            best = None
            for way, width, xs in ways:
                own, met = unname(dv) if way == 1 else dw, {}
                for p in range(len(own) - width + 1):
                    for i, x in xs:
                        if own[p : p + width] == x:
                            met.setdefault(p - i, set()).add(i)
                found = set()
                for offset, starts in met.items():
                    ours = [dv[offset + i] if 0 <= offset + i < len(dv) else None for i in range(len(v))]
                    same = [o is not None and (o.removeprefix("\1n") == x.removeprefix("\1n") or (is_slot(x) and is_slot(o) and o[:2] == x[:2])) for x, o in zip(v, ours)]
                    inside = {k for s in range(len(v) - width + 1) if all(same[s : s + width]) for k in range(s, s + width)} if way != 1 else set()
                    values = {}
                    for k in inside:
                        if is_slot(v[k]):
                            values.setdefault(v[k], set()).add(ours[k])
                    bad = [k for k in inside if is_slot(v[k]) and len(values[v[k]]) > 1]
                    found |= {i for i in starts if not any(i <= k < i + width for k in bad)}
                n = len({i for i, _ in xs})
                if found and len(found) / n >= coverage:
                    best = max(best or (0,), (len(found) / n, len(found), n))
            if best:
                out[doc, item] = best[1:]
    return out


def test_query_against_brute_force(spark):
    import pandas as pd

    items = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    d = documents()
    want = slow_leaks(zip(d.doc_id, d.text), zip(items.item_id, items.text))
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows) for r in dc.op4_benchmark_decontamination(spark, SMALL).collect()}
    assert want and got == want


def test_templates_against_brute_force(spark):
    """Items of all ways, and documents that quote them with new values, cut, or shifted."""
    import random

    rng = random.Random(5)
    words = "the old mill has boys and girls who walk 12 km in 3 hours or ten minutes while Maria pays 3.5 l of milk to Ivan".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 9, 14, 25])))) for i in range(12)]
    docs = []
    for i in range(90):
        t = rng.choice(items)[1].split()
        if rng.random() < 0.6:
            t = [{"12": "40", "3": "5", "Maria": "Eva", "3.5": "7"}.get(x, x) if rng.random() < 0.7 else x for x in t]
        if rng.random() < 0.4:
            t.insert(rng.randrange(len(t)), rng.choice(words))
        pad = [rng.choice(words) for _ in range(rng.randrange(12))]
        docs.append((i, rng.choice([" ", "\n", "  "]).join([*pad, *t, *pad[:3]])))
    want = slow_leaks(docs, items)
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows) for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, *[t for _, t in items])).collect()}
    assert len(want) > 30 and got == want


def test_white_space_decimals_units_and_short_items(spark):
    other = [ITEM.replace(" ", "\n"), ITEM.replace(" ", "  "), ITEM.replace(" ", "\t")]
    assert leaked(spark, other, ITEM) == [(0, 0), (1, 0), (2, 0)]
    item = "A tank holds 3.5 l of clean water and a second tank holds 35 l so how much do both tanks hold in all"
    assert leaked(spark, [item.replace("3.5 l", "7 l").replace("35 l", "40 l")], item) == [(0, 0)]
    unit = "the road to the old mill is 12 km long and the way back over the green hill is 12 km long as well"
    clash = unit.replace("12 km long as", "12 miles long as")
    got = dc.leaks(spark.createDataFrame([(0, unit.replace("km", "miles")), (1, clash)], "doc_id long, text string"), bench(spark, unit)).collect()
    assert {r.doc_id: r.n_matched for r in got}[0] > {r.doc_id: r.n_matched for r in got}.get(1, 0)
    assert leaked(spark, ["x What is 12 km plus 3 km y"], "What is 12 km plus 3 km") == [(0, 0)]
    spelled = "Then three boys walk along the quiet river to the old mill and stay there for ten minutes in the sun"
    assert leaked(spark, [spelled.replace("three", "5").replace("ten minutes", "20 minutes")], spelled) == [(0, 0)]


def test_awkward_rows(spark):
    b = bench(spark, ITEM, None, "", "too short", ITEM)
    assert dc.leaks(odd(spark), b).count() == 0
    assert dc.leaks(empty(spark), b).count() == 0
    assert dc.leaks(odd(spark), b.limit(0)).count() == 0
    kept = dc.decontaminate(odd(spark), b)
    assert kept.columns == odd(spark).columns and kept.count() == 12
    twice = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM), (2, "x")], "doc_id long, text string")
    assert [r.doc_id for r in dc.decontaminate(twice, b).collect()] == [2]


def test_two_values_may_become_one(spark):
    item = "A farmer has 3 red baskets and then buys 5 more baskets at the market so how many baskets are there now"
    assert leaked(spark, [item.replace("3", "4").replace("5", "4")], item) == [(0, 0)]


def test_inserted_word_and_partial_quote(spark):
    item = "If Maria walks 12 km to the old town and back again then she sees 30 birds by the river and then counts 7 boats near the small bridge before lunch"
    inserted = item.replace("then counts 7", "then slowly counts 7")
    quote = item.split(" by the river")[0] + " by the river and then nobody there knew Ivan or 12 other people, 30 was the limit and 12 more came for Maria and 9 for Ann"
    assert leaked(spark, [inserted, quote], item) == [(0, 0), (1, 0)]
    # The item's 12 stands twice; the quote has another value outside the matched windows.
    item = "Then 12 boys walk along the quiet river to the old mill and play there until evening and 12 girls come"
    quote = "Then 40 boys walk along the quiet river to the old mill and play there until evening but 50 cows moo"
    clash = item.replace("12 girls", "50 girls")
    assert leaked(spark, [quote, clash], item) == [(0, 0), (1, 0)]


def test_short_items_with_new_values_and_spaces_of_any_script(spark):
    item = "What is 12 km plus 3 km"
    docs = ["x What is 40 km plus 7 km y", "What is 40 km plus 7 miles", "What is 40 km minus 7 km", "What\u00a0is 12\u00a0km plus 3\u3000km", "so What is 5 km plus 5 km"]
    # One unit stands for km twice, so the second text clashes; the third asks something else.
    assert leaked(spark, docs, item) == [(0, 0), (3, 0), (4, 0)]
    long = "Then 12 boys walk along the quiet river to the old mill and play there until late"
    assert leaked(spark, [long.replace(" ", "\u3000"), long.replace(" along ", "\u2003along\u00a0")], long) == [(0, 0), (1, 0)]


def test_items_without_usable_windows(spark):
    short, numbers, nouns = "Who wrote the novel about Ahab?", "3 4 8 15 16 23 42 7 9 11", "Der Hund von Anna und die Katze von Otto"
    tiny = "Is 7 prime?"
    docs = [
        f"Some text. Question: {short} Answer: him",
        f"The row {numbers} was read out",
        f"Erst kam der Satz: {nouns}, dann nichts",
        short.replace("Ahab", "Emma"),
        nouns.replace("Anna", "Eva").replace("Hund", "Vogel"),
        "The row 3 4 8 15 16 23 42 8 10 12 was read out",
        "Who wrote the letter about Ahab?",
        f"One asks, {tiny}",
        "Is 9 prime?",
    ]
    assert leaked(spark, docs, short, numbers, nouns, tiny) == [(0, 0), (1, 1), (2, 2), (3, 0), (4, 2), (7, 3)]
    assert leaked(spark, ["", " ", None, "..."], "", " ", "?", "...") == []
