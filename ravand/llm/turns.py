"""Speech transcripts into clean speaker turns.

A finite-state parser reads each line of a chunk: clock times, time ranges, sound notes and turn marks may
stand before a speaker label, then the spoken text follows; notes, times and standalone hesitation sounds are
taken out of it. Texts are read in the normal form of lookalikes.py. Consecutive chunks of one speaker are
merged. A file may hold any share of the rows: windows span a time bucket of a file, and only one summary row
per bucket is windowed over the file to carry speaker and open turn onwards.

Defined cases: a null or blank text, or one of notes only, has no words and is left out; chunks before the
first known speaker of a file form a turn with a null speaker; rows with a null file or start time are left
out; of rows with the same (file, chunk) the one ingested last counts, of those alike the largest row id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravand.llm import codepoints as cp
from ravand.session import materialize, spread

# Number words of speaker names.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "صفر": 0, "یک": 1, "دو": 2, "سه": 3, "چهار": 4, "پنج": 5, "شش": 6, "هفت": 7, "هشت": 8, "نه": 9, "ده": 10, "یازده": 11, "دوازده": 12,
}
_NUMBER = r"(\d+|" + "|".join(NUMBER_WORDS) + r")"
_PERSON = "(?:speaker|spk|گوینده(?:ٔ|‌ی| ی)?|سخنران|s(?=[ _-]?\\d))"
_NAME = _PERSON + r"[ _#-]*" + _NUMBER + r"(?!\w)"
SPEAKER_ID = re.compile(rf"\s*(?:{_PERSON})?[ _#-]*{_NUMBER}\s*", re.I)
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
#: What may stand before the text of a line, by state.
RANGE = re.compile(rf"{_CLOCK}\s*(?:-->|->|–|—|-)\s*{_CLOCK}")
CLOCK = re.compile(rf"(?<![\w:]){_CLOCK}(?![\w:])")
MARK = re.compile(r">>+|-(?=\s)")
LABEL = re.compile(rf"{_NAME}\s*(?::|-(?=\s|$)|–|—)|[\[(<{{]\s*{_NAME}\s*[\])>}}](?:\s*\([\d.,:\s–-]*\)\s*:|\s*:)?", re.I)
NOTE = re.compile(r"\([^()\[\]{}<>]*\)|\[[^()\[\]{}<>]*\]|\{[^()\[\]{}<>]*\}|<[^()\[\]{}<>]*>|\*[^*\n]*\*|[♩♪♫♬\U0001F3B5\U0001F3B6\U0001F3BC]")
BLANKS = re.compile(r"\s*")
#: A line that begins with none of these has no head: a label begins with one of its letters, a note, mark or time with the others.
_HEAD = re.compile(r"[\d(\[{<*>♩♪♫♬\U0001F3B5\U0001F3B6\U0001F3BC-]|speaker|spk|s[ _-]?\d|گوینده|سخنران", re.I)
_NOTED = re.compile(r"[(\[{<*♩♪♫♬\U0001F3B5\U0001F3B6\U0001F3BC]")
#: Hesitation sounds, as a whole word without the punctuation around it.
HESITATION = re.compile(r"u+m+|u+h+m*|e+r+m*|e+h+|e+m+|h+m+|a+h+|m+h*m+|آ{2,}|ا?و?م{2,}|او+م+|ا+م{2,}|ه+م{2,}|هو+م+|اه{2,}|(?:[اآإ]ِ+){2,}|(?:اِ?){3,}", re.I)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_EDGES_KEEP = re.compile("^[^\\wً-ٕ]+|[^\\wً-ٕ]+$")
_HOLDS_WORD = re.compile(r"[^\W_]")


def speaker_number(name: str | None) -> int | None:
    """The number in a speaker's name, in digits or in words; None where there is none."""
    found = SPEAKER_ID.fullmatch(name) if name else None
    return _number(found[1]) if found else None


def _number(word: str) -> int | None:
    word = word.lower()
    return int(word) if word.isdecimal() and len(word) < 18 else NUMBER_WORDS.get(word)


def _without_notes(text: str) -> str:
    """`text` without bracketed notes (from the innermost outwards), asterisk notes and music signs."""
    while True:
        shorter = NOTE.sub("", text)
        if shorter == text:
            return text
        text = shorter


@lru_cache(maxsize=200_000)
def is_word(piece: str) -> bool:
    """Whether a piece between blanks is a word: it holds a letter or digit and is no hesitation sound."""
    return _HOLDS_WORD.search(piece) is not None and HESITATION.fullmatch(_EDGES_KEEP.sub("", piece)) is None


def parse_chunk(text: str) -> tuple[int | None, list[str]]:
    """(speaker number of the first label, words) of one chunk's text in normal form."""
    speaker: int | None = None
    words: list[str] = []
    for line in text.splitlines():
        at, state = 0, "head"
        while state == "head":
            at = BLANKS.match(line, at).end()
            if not _HEAD.match(line, at):
                break
            for kind in (RANGE, LABEL, CLOCK, NOTE, MARK):
                if found := kind.match(line, at):
                    if kind is LABEL and speaker is None:
                        speaker = _number(next(g for g in found.groups() if g))
                    at = found.end()
                    break
            else:
                # a nested note has another note inside it: take the inner ones out and look again
                if line.startswith(("(", "[", "{", "<"), at) and (inner := NOTE.search(line, at + 1)):
                    line = line[: inner.start()] + line[inner.end() :]
                else:
                    state = "text"
        rest = line[at:]
        if ":" in rest:
            rest = CLOCK.sub("", RANGE.sub("", rest))
        if _NOTED.search(rest):
            rest = _without_notes(rest)
        words += filter(is_word, rest.split())
    return speaker, words


def parse_chunks(df: DataFrame, text: str, speaker: str, keep: list[str], with_text: bool = False) -> DataFrame:
    """The columns `keep` with speaker_no, n_words and, if asked for, clean_text of each chunk."""
    fields = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", speaker_no bigint, n_words bigint" + ", clean_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str | None, int | None] = {}
        for batch in batches:
            names = cp.encode(*cp.look(*cp.decode(batch.column(len(keep) + 1)))).to_pylist()
            column = batch.column(len(keep))
            speakers: list[int | None] = []
            counts: list[int] = []
            texts: list[str] = []
            for a, b in cp.blocks(column):
                for row, norm in enumerate(cp.encode(*cp.look(*cp.decode(column.slice(a, b - a)))).to_pylist(), a):
                    label, words = parse_chunk(norm) if norm else (None, [])
                    name = names[row]
                    if name not in numbers:
                        if len(numbers) > 100_000:
                            numbers.clear()
                        numbers[name] = speaker_number(name)
                    known = numbers[name]
                    speakers.append(label if known is None else known)
                    counts.append(len(words))
                    if with_text:
                        texts.append(" ".join(words))
            columns = [*batch.columns[: len(keep)], pa.array(speakers, pa.int64()), pa.array(counts, pa.int64())]
            names_out = [*keep, "speaker_no", "n_words"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names_out.append("clean_text")
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return spread(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"), F.col(f"`{speaker}`").alias("__speaker"))).mapInArrow(run, schema)


def turn_lines(df: DataFrame, with_text: bool = True, bucket_ms: int = 3_600_000) -> DataFrame:
    """Each chunk that counts with its turn: (file_id, chunk_id, start_ms, speaker_no, n_words[, clean_text], turn_start_ms, turn_chunk).

    `df` has the columns of chunk_info. A turn is named by the start and the number of its first chunk.
    """
    done = df.where("status = 'completed' and file_id is not null and start_time is not null and not isnan(start_time)")
    parsed = parse_chunks(done, "text", "speaker_id", ["file_id", "chunk_id", "row_id", "ingested_at", "start_time"], with_text)
    value = F.struct("ingested_at", "row_id", "start_time", "speaker_no", "n_words", *(["clean_text"] if with_text else []))
    latest = parsed.groupBy("file_id", "chunk_id").agg(F.max(value).alias("x")).select("file_id", "chunk_id", "x.*")
    start = F.round(F.col("start_time") * 1000).cast("bigint")
    rows = materialize(latest.where("n_words > 0").withColumn("start_ms", start).withColumn("bucket", F.floor(start / F.lit(bucket_ms)).cast("bigint")).drop("ingested_at", "row_id"))
    inside = Window.partitionBy("file_id", "bucket").orderBy("start_time", "chunk_id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # the speaker known so far, carried from bucket to bucket
    order = F.struct("start_time", "chunk_id")
    carried = rows.groupBy("file_id", "bucket").agg(F.max_by("speaker_no", F.when(F.col("speaker_no").isNotNull(), order)).alias("last_speaker"))
    carried = carried.select("file_id", "bucket", F.last("last_speaker", ignorenulls=True).over(earlier).alias("carry"), (F.count(F.lit(1)).over(earlier) > 0).alias("has_earlier"))
    rows = rows.join(carried, ["file_id", "bucket"])
    rows = rows.withColumn("who", F.coalesce(F.last("speaker_no", ignorenulls=True).over(so_far), "carry"))
    first = F.row_number().over(inside) == 1
    before = F.when(first, F.col("carry")).otherwise(F.lag("who").over(inside))
    opens = (first & ~F.col("has_earlier")) | ~F.col("who").eqNullSafe(before)
    rows = rows.withColumn("opens", opens)
    head = F.when(F.col("opens"), F.struct("start_ms", "chunk_id"))
    opened = rows.groupBy("file_id", "bucket").agg(F.max_by(head, F.when(F.col("opens"), order)).alias("last_head"))
    opened = opened.select("file_id", "bucket", F.last("last_head", ignorenulls=True).over(earlier).alias("open_head"))
    rows = rows.join(opened, ["file_id", "bucket"]).withColumn("head", F.coalesce(F.last(head, ignorenulls=True).over(so_far), "open_head"))
    return rows.select("file_id", "chunk_id", "start_ms", F.col("who").alias("speaker_no"), "n_words", *(["clean_text"] if with_text else []), F.col("head.start_ms").alias("turn_start_ms"), F.col("head.chunk_id").alias("turn_chunk"))


def speaker_turns(df: DataFrame) -> DataFrame:
    """(file_id, speaker_no, start_ms, n_words) of every turn."""
    lines = turn_lines(df, with_text=False)
    turns = lines.groupBy("file_id", "turn_start_ms", "turn_chunk").agg(F.max("speaker_no").alias("speaker_no"), F.sum("n_words").alias("n_words"))
    return turns.select("file_id", "speaker_no", F.col("turn_start_ms").alias("start_ms"), "n_words")
