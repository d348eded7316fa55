import random

from stallwright.llm import near_copies, simhash

from .brute import closure, empty, words


def shingles(text):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    return bool(a) and len(a & b) >= 0.8 * len(a | b)


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = " ".join(f"g{g}w{rng.randrange(500)}" for _ in range(200))
        texts += [base, base.upper(), *(edited(rng, base, n) for n in (1, 2, 3, 4, 5, 12, 30))]
        texts.append(edited(rng, texts[-4], 3))  # near an edited copy
    rng.shuffle(texts)
    sets = dict(enumerate(map(shingles, texts)))
    fps = {i: simhash.fingerprint(t) for i, t in enumerate(texts)}
    groups = closure(sorted(sets), lambda a, b: similar(sets[a], sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 3)
    want = sorted(set(groups.values()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == want
    assert len(want) < simhash.keep_one(docs).count()  # three bits leave edited copies


def test_awkward_rows(spark):
    rows = [(1, "a b c"), (2, "A  b c"), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "x"), (None, "x"), (6, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in near_copies.keep_one(docs).collect()) == [0, 0, 1, 3, 5, 6]
    assert near_copies.keep_one(empty(spark)).count() == 0


def test_equal_ids(spark):
    rows = [(1, "a b c", "y", None), (1, "a b c", "x", 2), (1, "a b c", "x", None), (1, "d e f", "z", 1), (2, "A B C", "w", 1), (3, "d e f", "w", 1), (4, "g h", "w", 1), (4, "g h", "w", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    got = sorted(map(repr, map(tuple, near_copies.keep_one(docs).collect())))
    assert got == sorted(map(repr, [(1, "a b c", "x", None), (1, "d e f", "z", 1), (4, "g h", "w", 1)]))


def test_a_chain_over_copies(spark):
    """Copies of one set stand in different op2 groups; all of them are one group here."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    near = edited(rng, " ".join(base), 2)
    docs = spark.createDataFrame([(5, " ".join(base)), (9, " ".join(base)), (3, near), (7, near.upper()), (8, "other text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [3, 8]


def test_memory_of_a_batch_is_bounded(spark):
    """The shingle sets of a whole Arrow batch stood in a worker's memory together."""
    import tracemalloc

    import pyarrow as pa

    class Captured:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(4_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    run, n = near_copies.signatures(Captured()), 0
    tracemalloc.start()
    for out in run(iter([batch])):
        n += out.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and most < 8e6
