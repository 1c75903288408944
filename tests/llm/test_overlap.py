import random

from ravand.llm.overlap import chain, chain_length, cross_split_pairs, extended, overlap_report, record_coverage


def near(a, b):
    """Whether at most a fifth of the longer text's words differ, by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return (max(len(a), len(b)) - row[-1]) * 5 <= max(len(a), len(b))


def test_chain():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert chain_length(a, b) == row[-1]


def test_pairs_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 7, 9, 10, 12, 14, 15, 20, 25]))] for _ in range(150)]
    for t in texts[:120]:
        copy = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 6))):
            k = rng.randrange(len(copy))
            change = rng.choice("saddm")
            if change == "s":
                copy[k] = rng.choice(vocabulary)
            elif change == "a":
                copy.insert(k, rng.choice(vocabulary))
            elif change == "d" and len(copy) > 1:
                del copy[k]
            else:
                copy.append(copy.pop(k))
        texts.append(copy)
    rows = []
    for i, t in enumerate(texts):
        line = " ".join(t)
        rows.append((i, rng.choice([line, line.upper(), line.replace(" ", "،  ") + "."]), ["train", " Training", "dev", "TEST "][i % 4]))
    rows += [(900, rows[0][1], "validation"), (901, rows[0][1], "train"), (902, None, "train"), (903, "  ", "test"), (904, rows[0][1], None), (905, "...", "train"), (906, "...", "test")]
    df = spark.createDataFrame(rows, "rec_id bigint, text string, split string").selectExpr("*", "'d' as dataset", "0 as cid", "'x' as side")
    side = lambda s: None if s is None else s.strip().lower() in ("train", "training")
    words = {i: t.lower().replace("،", " ").replace(".", "").split() if t else [] for i, t, _ in rows}
    expected = {(min(i, j), max(i, j)) for i, _, s in rows for j, _, u in rows if side(s) is True and side(u) is False and words[i] and words[j] and near(words[i], words[j])}
    found = [(r["rec_id_a"], r["rec_id_b"]) for r in cross_split_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 60
    report = overlap_report(df).collect()
    assert sum(r["n_overlapping"] for r in report) == len({x for p in expected for x in p if side(dict((i, s) for i, _, s in rows)[x]) is False})
    assert cross_split_pairs(df.where("false")).count() == 0


def test_changed_words_that_winnowing_selects(spark):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(16)]
    rows = [(i, " ".join(rng.sample(common, 15)), "train") for i in range(40)]
    # every fifth word is the rarest of its windows and differs, so no three selected words are the same
    for pair in range(10):
        kept = rng.sample(common, 16)
        for side, split in enumerate(("train", "test")):
            text = [f"rare{pair}x{side}x{k // 4}" if k % 5 == 2 else kept[k - (k + 2) // 5] for k in range(20)]
            rows.append((100 + 2 * pair + side, " ".join(text), split))
    df = spark.createDataFrame(rows, "rec_id bigint, text string, split string")
    expected = {(i, j) for i, t, s in rows for j, u, v in rows if s == "train" and v == "test" and near(t.split(), u.split())}
    assert {(r["rec_id_a"], r["rec_id_b"]) for r in cross_split_pairs(df).collect()} == expected and len(expected) == 10


def changed(rng, text, vocabulary):
    """`text` with as many words changed, added, dropped or moved at random as are allowed."""
    out = list(text)
    for _ in range(len(text) // 5):
        new, k, kind = list(out), rng.randrange(len(out)), rng.choice("sadm")
        if kind == "s":
            new[k] = rng.choice(vocabulary)
        elif kind == "a":
            new.insert(k, rng.choice(vocabulary))
        elif kind == "d" and len(new) > 1:
            del new[k]
        elif kind == "m":
            new.insert(rng.randrange(len(new)), new.pop(k))
        out = new if near(text, new) else out
    return out


def test_recall_at_the_limit():
    """Texts of 3 to 60 words, all changes that are allowed, words by their frequency; common and hot seeds too."""
    import numpy as np

    from ravand.llm import codepoints as cp
    from ravand.llm.overlap import COMMON, rolling, slots, text_seeds

    rng = random.Random(5)
    vocabulary = np.random.default_rng(5).integers(1, 2**32, 4000).tolist()
    weights = [1 / (i + 5) for i in range(4000)]
    for repeat in (1, 20):  # a small corpus, and one in which most rolling hashes are common
        texts = [rng.choices(vocabulary, weights, k=rng.randint(3, 60)) for _ in range(3000)] + [rng.choices(vocabulary, weights, k=rng.randint(60, 130)) for _ in range(600)]
        pairs = [(t, changed(rng, t, vocabulary)) for t in texts]
        arrays = []
        for side in range(2):
            words = np.array([w for p in pairs for w in p[side]], np.uint64)
            size = np.array([len(p[side]) for p in pairs])
            arrays.append((words, np.repeat(np.arange(len(size)), size), size))
        counters = np.ones(1 << 20, np.int64)
        for words, owner, _ in arrays:
            np.add.at(counters, slots(cp.mix(words), len(counters)), repeat)
            np.add.at(counters, slots(rolling(words, owner)[0], len(counters)), repeat * (COMMON // 20))
        plain = [text_seeds(*a, counters, np.zeros(0, np.uint64)) for a in arrays]
        every = np.unique(plain[0][0])
        lengths = np.array([len(a) for a, _ in pairs])
        assert (lengths > 60).sum() > 500
        for hot in (np.zeros(0, np.uint64), every, every[::2]):
            found = [set(zip(s.tolist(), o.tolist(), strict=True)) for s, o, _ in (text_seeds(*a, counters, hot) for a in arrays)]
            met = {o for _, o in found[0] & found[1]} | {i for i, (a, b) in enumerate(pairs) if a == b}
            for some in (lengths <= 60, lengths > 60):
                assert sum(i in met for i in np.flatnonzero(some)) >= 0.99 * some.sum(), (repeat, len(hot), len(met))


def test_seeds_of_a_long_text_grow_with_its_length():
    import numpy as np

    from ravand.llm.overlap import text_seeds

    words = np.random.default_rng(6).integers(1, 2**32, 100_000).astype(np.uint64)
    args = words, np.zeros(len(words), np.int64), np.array([len(words)]), np.ones(1 << 16, np.uint16)
    every = np.unique(text_seeds(*args, np.zeros(0, np.uint64))[0])
    assert len(text_seeds(*args, every)[0]) <= 18 * len(every)


def test_chained_seeds():
    a, b = [1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 9, 4, 5, 7, 8, 6]
    assert chain([(0, 0), (3, 3), (6, 5), (5, 7), (3, 3)]) == [(0, 0), (3, 3), (6, 5)]
    assert chain([]) == [] and extended(a, b, []) == chain_length(a, b) == 6
    assert extended(a, b, chain([(0, 0), (6, 5)])) == 6 and extended(a, b, [(5, 7)]) == 5


def test_template_shared_by_many_records(spark):
    rng = random.Random(3)
    template = [f"t{i}" for i in range(12)]
    rows = [(i, " ".join(template + rng.choices([f"w{k}" for k in range(5000)], k=12)), "dev" if i % 8 == 0 else "train") for i in range(12_000)]
    planted = set()
    for k in range(60):
        base = rows[8 * k][1].split()
        base[20 + k % 4] = "other"
        rows.append((20_000 + k, " ".join(base), "train"))
        planted.add((8 * k, 20_000 + k))
    found = {tuple(r) for r in cross_split_pairs(spark.createDataFrame(rows, "rec_id bigint, text string, split string")).collect()}
    assert planted <= found
    words = {i: t.split() for i, t, _ in rows}
    assert all(near(words[a], words[b]) for a, b in found)


def test_repeated_words_and_nulls(spark):
    long = " ".join(["na"] * 20_000)
    rows = [(1, long, "train"), (2, long + " end", "test"), (3, "a b c", "train"), (4, "a b", "test"), (None, "a b c", "test"), (5, "a b c", None)]
    df = spark.createDataFrame(rows, "rec_id bigint, text string, split string").selectExpr("*", "cast(null as string) as dataset")
    assert [tuple(r) for r in cross_split_pairs(df).collect()] == [(1, 2)]
    cover = record_coverage(df).collect()
    assert len(cover) == 1 and cover[0]["rec_id"] == 2 and cover[0]["n_train"] == 1 and 0.99 < cover[0]["coverage"] < 1


def test_texts_of_few_words(spark):
    """Texts of one to four words are near only if they are the same or, from four to five words, one word is added."""
    rows = [(1, "one", "train"), (2, "ONE!", "test"), (3, "two", "train"), (4, "a b c d", "train"), (5, "a b x c d", "dev"), (6, "a b c", "dev"), (7, "", "train"), (8, "a b c e", "valid")]
    df = spark.createDataFrame(rows, "rec_id bigint, text string, split string").selectExpr("*", "1 as k1", "'w' as words", "0 as sig")
    assert sorted(tuple(r) for r in cross_split_pairs(df).collect()) == [(1, 2), (4, 5)]
    assert cross_split_pairs(df.where("rec_id < 4")).count() == 1
