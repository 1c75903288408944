import random

import pytest

from ravand.llm.turns import parse_chunk, speaker_number, speaker_turns, turn_lines

SCHEMA = "row_id bigint, file_id string, chunk_id bigint, text string, start_time double, status string, speaker_id string, ingested_at timestamp"


@pytest.mark.parametrize(
    ("text", "speaker", "words"),
    [
        (">> Speaker 1: سلام (خنده) دنیا", 1, 2), ("[Speaker 1] (1234.50-1240.10): a b", 1, 2), ("گوینده یک - در پایان", 1, 2), ("گوینده سه بار آمد", None, 4), ("00:00:01,000 --> 00:00:04,000\n<spk2> x ((همهمه)) y", 2, 2),
        ("((همهمه)) ...", None, 0), ("[00:02:03] (گوینده‌ی ۲) در همممم، و آآ... هوم", 2, 2), ("[خنده] SPEAKER_02: x", 2, 1), ("Speaker two: (نفس)", 2, 0), ("♫ ♫ Uh", None, 0), ("12:30 ساعت", None, 1), ("- سلام", None, 1), ("هم امم", None, 1), ("a [open b", None, 3), ("", None, 0),
    ],
)
def test_parse(text, speaker, words):
    found, ws = parse_chunk(text)
    assert (found, len(ws)) == (speaker, words)


def test_names():
    assert [speaker_number(x) for x in ["SPEAKER_01", " speaker_1 ", "spk1", "1", "Speaker one", "گوینده 1", "گویندهٔ یک", "S1", "speaker-01", "", None, "Ali"]] == [1] * 9 + [None] * 3


def brute(rows):
    latest = {}
    for r in rows:
        if r[5] == "completed" and r[1] is not None and r[4] is not None:
            key = (r[1], r[2])
            if key not in latest or (r[7], r[0]) > (latest[key][7], latest[key][0]):
                latest[key] = r
    turns, speaker, file = [], None, None
    for r in sorted(latest.values(), key=lambda r: (r[1], r[4], r[2])):
        label, words = parse_chunk(r[3] or "")
        if not words:
            continue
        if r[1] != file:
            file, speaker, first = r[1], None, True
        who = speaker_number(r[6]) if speaker_number(r[6]) is not None else label
        who = speaker if who is None else who
        if first or who != speaker:
            turns.append([file, who, round(r[4] * 1000), 0])
        turns[-1][3] += len(words)
        speaker, first = who, False
    return sorted(map(tuple, turns), key=str)


def test_turns_against_brute_force(spark):
    import datetime

    rng = random.Random(4)
    rows = []
    for i in range(500):
        at = datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=rng.randint(0, 1000))
        text = rng.choice(["a b", "(x)", "Speaker 2: c", None, "", "um d", "e f g"])
        rows.append((i, rng.choice(["f", "f", "f", "g", None]), rng.randint(0, 150), text, rng.choice([rng.randint(0, 30_000_000) / 1000, None]), rng.choice(["completed", "completed", "failed"]), rng.choice([None, "S1", "گوینده 3"]), at))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as bucket", "0 as n_words", "0 as head")
    found = sorted(((r["file_id"], r["speaker_no"], r["start_ms"], r["n_words"]) for r in speaker_turns(df).collect()), key=str)
    assert found == brute(rows) and len(found) > 15
    assert speaker_turns(df.where("false")).count() == 0
    lines = turn_lines(df).collect()
    assert sum(r["n_words"] for r in lines) == sum(t[3] for t in found) and all(len(r["clean_text"].split()) == r["n_words"] for r in lines)
