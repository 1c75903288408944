import random

import numpy as np

from ravand.llm.leakage import exact_leaks, leaked_passages, myers_distance


def test_distance():
    rng = np.random.default_rng(1)
    p, t = rng.integers(0, 3, (200, 8)).astype(np.uint64), rng.integers(0, 3, (200, 10)).astype(np.uint64)
    for a, b, d in zip(p, t, myers_distance(p, t), strict=True):
        row = [0] * (len(b) + 1)  # begins anywhere
        best = len(a)
        table = [row]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, table[-1][j] + 1, table[-1][j - 1] + (x != y)))
            table.append(row)
        best = min(table[-1])
        assert best == d


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"k{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 8, 12, 20])))) for i in range(40)] + [(90, None), (91, ""), (92, "Kа1, k2 k3")]
    items.append((93, items[3][1]))
    docs = []
    for d in range(120):
        text = [rng.choice(words) for _ in range(30)]
        source = rng.choice([t for _, t in items[:40]]).split()
        n = rng.choice([0, 5, 7, 8, 9, 30])
        at = rng.randrange(max(1, len(source) - n + 1))
        text[10:10] = source[at : at + n]
        line = " ".join(text)
        docs.append((d, rng.choice([line, line.upper(), line.replace(" ", ",\n"), line.replace("k", "k‌")])))
    docs += [(500, None), (501, " "), (502, docs[0][1])]
    clean = lambda t: t.lower().replace("‌", "").replace(",", " ").split() if t else []
    grams = lambda ws: {tuple(ws[k : k + 8]) for k in range(len(ws) - 7)}
    expected = {(i, d) for i, t in items for d, x in docs if grams(clean(t)) & grams(clean(x))}
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "0 as item_id", "0 as distance")
    idf = spark.createDataFrame(items, "item_id bigint, text string")
    found = [(r["item_id"], r["doc_id"]) for r in exact_leaks(ddf, idf).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 20
    one = leaked_passages(spark.createDataFrame([(1, "z a b c d e f g x h i")], "doc_id bigint, text string"), spark.createDataFrame([(7, "a b c d e f g h")], "item_id bigint, text string")).collect()
    assert [(r["item_id"], r["doc_id"], r["distance"]) for r in one] == [(7, 1, 1)]
    assert exact_leaks(ddf.where("false"), idf).count() == 0 and exact_leaks(ddf, idf.where("false")).count() == 0
