import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravand.functions import arrow
from ravand.functions import text as T


def column(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def runs(text, most):
    """Word runs collapsed, by itertools-free brute force."""
    ws = text.split()
    if len(ws) < 2:
        return text
    out, i = [], 0
    while i < len(ws):
        n = 1
        while i + n < len(ws) and ws[i + n] == ws[i]:
            n += 1
        out += [ws[i]] * (n if n <= most else 1)
        i += n
    return " ".join(out)


def phrases(text, least=3):
    ws = text.split()
    if len(ws) < 2 * least:
        return text
    out, i = [], 0
    while i < len(ws):
        for n in range(least, 10):
            if i + 2 * n <= len(ws) and ws[i : i + n] == ws[i + n : i + 2 * n]:
                out += ws[i : i + n]
                first = ws[i : i + n]
                while ws[i : i + n] == first and i + n <= len(ws):
                    i += n
                break
        else:
            out.append(ws[i])
            i += 1
    return " ".join(out)


SAMPLES = ["", " ", None, "hello world hello world", "hello hello hello hello hello", "a", " a ", "a  b\tb", "x x x y", "a b c a b c a b c d", "a b c d a b c d", "سلام سلام سلام سلام دنیا"]


def test_word_runs_golden(spark):
    assert column(spark, lambda t: T.collapse_word_runs(t, 2), ["hello world hello world", "hello hello hello hello hello", "one", "a a b"]) == ["hello world hello world", "hello", "one", "a a b"]


def test_runs_and_phrases_against_brute_force(spark):
    rng = random.Random(5)
    texts = SAMPLES + [" ".join(rng.choice(["a", "b", "ab", "."]) for _ in range(rng.randint(0, 24))) for _ in range(400)]
    assert column(spark, T.collapse_word_runs, texts) == [t if t is None else runs(t, 3) for t in texts]
    assert column(spark, T.collapse_phrases, texts) == [t if t is None else phrases(t) for t in texts]
    assert column(spark, T.clean_repetition, texts) == [t if t is None else " ".join(phrases(" ".join(runs(t, 3).split())).split()) for t in texts]
    assert any(phrases(t) != " ".join(t.split()) for t in texts if t)


def test_sentences_paragraphs_phrases(spark):
    assert column(spark, T.sentences, ["", "Hi", "First sentence. Second one here! And a third? Fourth."]) == [[], [], ["First sentence", "Second one here", "And a third"]]
    assert column(spark, T.paragraphs, ["Short", "x" * 60 + "\n\n" + "y" * 55 + ".\n" + "z" * 10]) == [[], ["x" * 60, "y" * 55]]
    assert column(spark, T.key_phrases, ["Short", "one two three four five six"]) == [[], ["one two three", "one two three four", "one two three four five", "one two three four five six", "two three four"]]


def test_preview(spark):
    found = column(spark, lambda t: T.preview(T.sentences(t), F.lit(3)), ["Hi", "First sentence. Second one here!"])
    assert found == ["Part 3: [No meaningful content]", "Part 3 Preview: First sentence\nPart 3.2 Preview:\nSecond one here\n" + "-" * 50]


def test_repeats_clauses_context(spark):
    assert column(spark, lambda t: T.drop_repeats(t)[0], ["heyyyy you you", "a", "آآآآ"]) == ["heyy you", "a", "آآ"]
    assert column(spark, lambda t: T.drop_repeats(t)[1], ["heyyyy you you", "a", "آآآآ"]) == [2, 0, 1]
    assert column(spark, T.capitalize_clauses, ["one. two! three"]) == ["One. Two! Three"]
    assert column(spark, T.correct_context, ["ایا میشه"]) == ["آیا می‌شه"]
    assert column(spark, T.close_text, [" a  b ", "c!", ""]) == ["a b.", "c!", ""]


def test_normal_forms_and_similarity(spark):
    assert column(spark, arrow.nfd_without_accents, ["\u00e9 \u0622", None]) == ["e \u0627\u0653", None]
    assert column(spark, arrow.nfkc, ["ﬁ①"]) == ["fi1"]
    pairs = spark.createDataFrame([("abc", "ABC"), ("", "x"), (None, "x"), ("abcd", "bcde")], "a string, b string").select(arrow.similarity("a", "b").alias("r")).collect()
    assert [r["r"] for r in pairs] == [1.0, 0.0, 0.0, 0.75]


def test_punctuation_score_closed_form(spark):
    assert column(spark, T.punctuation_accuracy, ["abc", "abc.", "a. b."]) == pytest.approx([0.5, 1 / 3, 4 / 9])


def test_blanks_are_those_of_python(spark):
    blanks = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
    assert column(spark, T.words, ["a" + b + "b" for b in blanks]) == [["a", "b"]] * len(blanks)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=12), min_size=20, max_size=40))
def test_word_distance(spark, seqs):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = list(zip(seqs[::2], seqs[1::2], strict=False))
    rows = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", T.word_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert {r["i"]: r["d"] for r in rows} == {i: distance(a, b) for i, (a, b) in enumerate(pairs)}


def test_word_distance_of_many_distinct_words(spark):
    a = [f"w{i}" for i in range(9000)]
    b = [*a[:4500], "new", *a[4502:], "end"]
    small = [f"v{i}" for i in range(2000)]
    found = spark.createDataFrame([(0, " ".join(a), " ".join(b)), (1, " ".join(small), " ".join(small[::-1]))], "i int, a string, b string").select("i", T.word_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert {r["i"]: r["d"] for r in found} == {0: 3, 1: 2000}


def test_truncation(spark):
    assert column(spark, lambda t: T.ellipsis(t, 5), ["abcdef", "abcde", None]) == ["abcde...", "abcde", None]
    assert column(spark, lambda t: T.ellipsis(t, 5, inside=True), ["abcdef", "abcde", None]) == ["ab...", "abcde", None]
