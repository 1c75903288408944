"""Column builders of the text operators: tokens, repetition, sentences, normalisation, formatting.

Everything is a built-in expression inside code generation but for the Unicode normal forms and the sequence
matcher (functions/arrow.py). Blanks are those of Python's str.split, spelled out. A null text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravand.functions.arrays import let

#: The blanks of Python's str.isspace, as the inside of a Java character class, and the same for RE2.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_RE2 = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
ENDINGS = "،؛؟!."
PERSIAN = r"\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff"
PERSIAN_RE2 = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
# Digits and letters that normalisation maps one to one.
PERSIAN_DIGITS = ("۰۱۲۳۴۵۶۷۸۹", "0123456789")
ARABIC_LETTERS = ("يكةؤإأآئء", "یکهوااآیه")
# How a word of valid form ends or begins.
WORD_ENDINGS = "(?:ی|ان|ها|ات|ین|ون)$"
WORD_BEGINNINGS = "^(?:می|نمی|بی|با|در|از|به|که)"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^[{BLANK}]+|[{BLANK}]+$", "")


def squeeze(t: Column) -> Column:
    """Runs of blanks become one space."""
    return F.regexp_replace(t, f"[{BLANK}]+", " ")


def words(t: Column) -> Column:
    """Tokens between blanks, without empty ones."""
    return F.filter(F.split(t, f"[{BLANK}]+"), lambda x: x != "")


def joined_words(t: Column) -> Column:
    return F.trim(squeeze(t))


def _runs_collapsed(line: Column, most: int) -> Column:
    return F.regexp_replace(line, rf"(?<![^ ])([^ ]++)(?: \1(?![^ ])){{{most},}}", "$1")


def _phrases_collapsed(line: Column, least: int) -> Column:
    ways, to = [], ""
    for group, n in enumerate(range(least, 10), 1):
        ways.append(rf"([^ ]++(?: [^ ]++){{{n - 1}}})(?: \{group}(?![^ ]))+")
        to += f"${group}"
    return F.regexp_replace(line, "(?<![^ ])(?:" + "|".join(ways) + ")", to)


def collapse_word_runs(t: Column, most: int = 3) -> Column:
    """A run of up to `most` equal words stays, a longer one becomes one word (T2). One word or none: unchanged."""
    line = joined_words(t)
    return F.when(~F.contains(line, F.lit(" ")), t).otherwise(_runs_collapsed(line, most))


def collapse_phrases(t: Column, least: int = 3) -> Column:
    """Adjacent repeats of a phrase of `least` to 9 words become one, shortest first, left to right."""
    line = joined_words(t)
    return F.when(F.size(F.split(line, " ")) < 2 * least, t).otherwise(_phrases_collapsed(line, least))


def clean_repetition(t: Column, most: int = 3) -> Column:
    """T5: word runs, phrases, blanks. Texts too short for either rule match neither pattern."""
    return _phrases_collapsed(_runs_collapsed(joined_words(t), most), 3)


def sentences(t: Column, most: int | None = 3, clean: bool = True) -> Column:
    """Pieces between sentence marks of more than five characters, the first `most`."""
    source = clean_repetition(strip(t)) if clean else strip(t)
    found = F.filter(F.transform(F.split(source, rf"[.!?؟]+(?:[{BLANK}]+|\z)"), strip), lambda s: F.length(s) > 5)
    return found if most is None else F.slice(found, 1, most)


def paragraphs(t: Column, least: int = 50) -> Column:
    """Pieces between empty lines or full stops at line ends, of `least` characters or more."""
    return F.filter(F.transform(F.split(t, rf"\n[{BLANK}]*\n|\.[{BLANK}]*\n"), strip), lambda p: F.length(p) >= least)


def key_phrases(t: Column, most: int = 5) -> Column:
    """Phrases of three to seven words and more than ten characters, by place then length."""

    def phrases(sentence: Column) -> Column:
        ws = words(sentence)
        starts = F.when(F.size(ws) >= 3, F.sequence(F.lit(1), F.least(F.size(ws) - 2, F.lit(most)))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(3), F.least(F.lit(7), F.size(ws) - i + 1)), lambda n: F.array_join(F.slice(ws, i, n), " ")))), lambda p: F.length(p) > 10)

    return F.slice(F.flatten(F.transform(sentences(t, most * 2), phrases)), 1, most)


def preview(found: Column, part: Column) -> Column:
    """Preview lines of a part's sentences."""
    cut = F.transform(found, lambda s: F.when(F.length(s) > 100, F.concat(F.substring(s, 1, 100), F.lit("..."))).otherwise(s))
    number = part.cast("string")
    more = F.transform(F.slice(cut, 2, 1000), lambda s, i: F.concat(F.lit("\nPart "), number, F.lit("."), (i + 2).cast("string"), F.lit(" Preview:\n"), s, F.lit("\n" + "-" * 50)))
    return F.when(F.size(found) < 1, F.concat(F.lit("Part "), number, F.lit(": [No meaningful content]"))).otherwise(F.concat(F.lit("Part "), number, F.lit(" Preview: "), F.try_element_at(cut, F.lit(1)), F.array_join(more, "")))


def squeeze_marks(t: Column) -> Column:
    """T11 without the Unicode normal form: blanks, runs of dots and commas."""
    return F.regexp_replace(F.regexp_replace(strip(squeeze(t)), r"\.{2,}", "."), ",{2,}", ",")


def western_digits(t: Column) -> Column:
    return F.translate(t, *PERSIAN_DIGITS)  # T13


def space_marks(t: Column) -> Column:
    """One blank after marks, none before; blanks around brackets and quotes."""
    s = f"[{BLANK}]"
    for pattern, to in ((rf"{s}*([،؛؟!\.]){s}*", "$1 "), (rf"{s}*([,;?!]){s}*", "$1 "), (rf"\({s}*", " ("), (rf"{s}*\)", ") "), (rf'"{s}*', ' "'), (rf'{s}*"', '" '), (rf"{s}+([،؛؟!\.])\z", "$1"), (rf"{s}+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def drop_repeats(t: Column) -> tuple[Column, Column]:
    """(text, count): three or more of a character become two, adjacent equal words one."""
    chars = F.regexp_replace(t, r"(.)\1{2,}", "$1$1")
    line = joined_words(chars)
    once = F.regexp_replace(line, r"(?<![^ ])([^ ]++)(?: \1(?![^ ]))+", "$1")
    count = F.regexp_count(t, F.lit(r"(.)\1{2,}")) + F.size(F.split(line, " ")) - F.size(F.split(once, " "))
    return F.when(F.contains(line, F.lit(" ")), once).otherwise(chars), count


def capitalize_clauses(t: Column) -> Column:
    """The first letter of every clause in upper case, clauses joined by a blank."""

    def one(piece: Column) -> Column:
        mark = F.when(F.substring(piece, -1, 1).isin(*ENDINGS), F.substring(piece, -1, 1)).otherwise("")
        body = strip(F.when(mark != "", piece.substr(F.lit(1), F.length(piece) - 1)).otherwise(piece))
        return F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, 2, 2**31 - 1), mark)

    return F.array_join(F.transform(F.split(t, f"(?<=[{ENDINGS}])"), one), " ")


def correct_context(t: Column) -> Column:
    """Dictionary corrections in order, then the verb prefixes."""
    for wrong, right in (("ایا", "آیا"), ("میشه", "می‌شه"), ("نمیشه", "نمی‌شه")):
        t = F.replace(t, F.lit(wrong), F.lit(right))
    t = F.regexp_replace(t, f"([{WORD}]+)می([{WORD}]+)", "$1 می‌$2")
    return F.regexp_replace(t, f"([{WORD}]+)نمی([{WORD}]+)", "$1 نمی‌$2")


def close_text(t: Column) -> Column:
    """Squeezed, with a full stop unless it ends in a mark."""
    line = strip(squeeze(t))
    return F.when((line != "") & ~F.substring(line, -1, 1).isin(*ENDINGS), F.concat(line, F.lit("."))).otherwise(line)


def post_process(t: Column, nfkc) -> Column:
    """Basic cleaning (with a normal form), marks, repeats, clauses, context, closing."""
    return close_text(correct_context(capitalize_clauses(drop_repeats(space_marks(nfkc(squeeze_marks(t))))[0])))


def remove_urls(t: Column) -> Column:
    return F.regexp_replace(t, URL, "")  # T22


def remove_emails(t: Column) -> Column:
    return F.regexp_replace(t, EMAIL, "")  # T23


def remove_symbols(t: Column) -> Column:
    return F.regexp_replace(t, f"[^{WORD}{BLANK}{PERSIAN}]", "")  # T24


def persian_letters(t: Column) -> Column:
    return F.translate(t, *ARABIC_LETTERS)  # T25


def zero_width_to_space(t: Column) -> Column:
    return F.regexp_replace(t, r"[\u200b-\u200d\ufeff]", " ")  # T26


def remove_brackets(t: Column) -> Column:
    return F.translate(t, "()[]{}", "")  # T29


def bounded_text(t: Column, least: int = 3, most: int = 1000) -> Column:
    return F.when(F.length(t) < least, "").otherwise(F.substring(t, 1, most))  # F4


def normalize(t: Column, nfd) -> Column:
    """Addresses, symbols, digits, letters, blanks, marks (`nfd`), brackets, length."""
    t = persian_letters(western_digits(remove_symbols(remove_emails(remove_urls(t)))))
    return bounded_text(strip(remove_brackets(nfd(squeeze(zero_width_to_space(t))))))


def count_of(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def text_statistics(t: Column) -> dict[str, Column]:
    """T30."""
    return {
        "length": F.length(t),
        "word_count": F.size(words(t)),
        "persian_char_count": count_of(t, r"[\u0600-\u06ff]"),
        "english_char_count": count_of(t, "[a-zA-Z]"),
        "number_count": count_of(t, r"\p{Nd}"),
        "punctuation_count": count_of(t, f"[^{WORD}{BLANK}]"),
        "has_persian_numbers": t.rlike(f"[{PERSIAN_DIGITS[0]}]"),
        "has_arabic_chars": t.rlike(f"[{ARABIC_LETTERS[0]}]"),
    }


def fixed2(x: Column) -> Column:
    """Two decimals, rounded as Python rounds."""
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))


def ellipsis(t: Column, most: int, inside: bool = False) -> Column:
    """Cut with three dots behind `most` characters, or with them inside `most`."""
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3 if inside else most), F.lit("..."))).otherwise(t)


def word_distance(a: Column, b: Column) -> Column:
    """Word edits between two texts (T38): each distinct word becomes a character, then the built-in distance.

    The characters are those of UTF-32 from 256 on without surrogates; a pair of texts with more than 1,111,000
    distinct words is an error. Time grows with the product of the lengths, as that of any edit distance does.
    """

    def line(ws: Column, known: Column) -> Column:
        def code(w: Column) -> Column:
            place = F.array_position(known, w) + 255
            return F.lpad(F.hex(F.when(place < 0xD800, place).otherwise(place + 0x800)), 8, "0")

        return F.decode(F.unhex(F.array_join(F.transform(ws, code), "")), "UTF-32")

    def distance(pair: Column) -> Column:
        wa, wb = pair["a"], pair["b"]
        known = lambda use: let(F.array_distinct(F.concat(wa, wb)), use)
        return known(lambda k: F.when(F.size(k) > 1_111_000, F.raise_error(F.lit("over 1,111,000 distinct words")).cast("int")).otherwise(F.levenshtein(line(wa, k), line(wb, k))))

    return let(F.struct(words(a).alias("a"), words(b).alias("b")), distance)


# Quality scores of one text


def clauses(t: Column) -> Column:
    """Pieces between marks that are not blank."""
    return F.filter(F.transform(F.split(t, f"[{ENDINGS}]"), strip), lambda s: s != "")


def _blank(t: Column) -> Column:
    return strip(t) == ""


def word_accuracy(t: Column, ws: Column | None = None) -> Column:
    """Share of words of two or more characters with a letter of the Arabic block, or of valid form (Q1). `ws`: words(t), if at hand."""
    ws = words(t) if ws is None else ws

    def valid(w: Column) -> Column:
        def formed(bare: Column) -> Column:
            return (F.length(bare) >= 2) & (bare.rlike(r"[\u0600-\u06ff]") | bare.rlike(WORD_ENDINGS) | bare.rlike(WORD_BEGINNINGS))

        return ((F.length(w) >= 2) & w.rlike(r"[\u0600-\u06ff]")) | (w.rlike(f"[{PERSIAN}]") & let(F.regexp_replace(w, f"[^{PERSIAN}]", ""), formed))

    return F.when(_blank(t), 0.0).otherwise(F.size(F.filter(ws, valid)) / F.size(ws))


def sentence_fluency(t: Column, found: Column | None = None) -> Column:
    """Mean score of clauses: short 0.3, else 0.8, times 0.7 if long and 0.9 with doubled blanks (Q2), in integers first. `found`: clauses(t), if at hand."""
    found = clauses(t) if found is None else found

    def score(s: Column) -> Column:
        n = F.size(words(s))
        return F.when(n < 3, F.lit(3000)).otherwise(F.when(n > 25, 7).otherwise(10) * F.when(s.rlike(f"[{BLANK}]{{2,}}"), 9).otherwise(10) * F.lit(80)).cast("bigint")

    total = F.aggregate(F.transform(found, score), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(_blank(t) | (F.size(found) == 0), 0.0).otherwise(total / F.size(found) / 10000.0)


def punctuation_accuracy(t: Column) -> Column:
    """Q3: n marks: 0.5 for none, else (n / (n + 1)) / 1.5."""
    n = count_of(t, f"[{ENDINGS}]")
    return F.when(_blank(t), 0.0).when(n == 0, 0.5).otherwise(n / (n + 1) / 1.5)


# Speech verbs and connectors, each counted as a pattern of its own.
SPEECH_VERBS = ("گفت", "گفتند", "پرسید", "پاسخ داد", "اضافه کرد", "گفت:", "گفتند:", "پرسید:", "پاسخ داد:", "اضافه کرد:")
CONNECTORS = ("و", "اما", "ولی", "اگر", "چون", "زیرا", "بنابراین", "همچنین", "علاوه بر", "در نتیجه", "به عبارت دیگر")


def _total(t: Column, patterns: tuple[str, ...]) -> Column:
    out = count_of(t, patterns[0])
    for p in patterns[1:]:
        out = out + count_of(t, p)
    return out


def speaker_separation(t: Column, ws: Column | None = None) -> Column:
    """Q4."""
    n = F.size(words(t) if ws is None else ws)
    ratio = _total(t, SPEECH_VERBS) / n
    return F.when(n < 10, 0.5).when(ratio.between(0.005, 0.03), 1.0).when(ratio > 0.03, F.greatest(F.lit(0.0), 1.0 - (ratio - 0.03) / 0.02)).otherwise(ratio / 0.005)


def noise_level(snr: Column, quality: Column) -> Column:
    """Q6."""
    band = F.when(snr >= 25, 0.1).when(snr >= 15, 0.3).when(snr >= 10, 0.6).otherwise(0.9)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (band + (1.0 - quality)) / 2))


def repetition_score(t: Column, ws: Column | None = None) -> Column:
    """Q7."""
    ws = words(t) if ws is None else ws
    n = F.size(ws)
    return F.when(n < 5, 0.0).otherwise(F.least(F.lit(1.0), (n - F.size(F.array_distinct(ws))) / n * 2))


def context_coherence(t: Column, found: Column | None = None) -> Column:
    """Q8."""
    n = F.size(clauses(t) if found is None else found)
    ratio = _total(t, CONNECTORS) / n
    return F.when(_blank(t), 0.0).when(n < 2, 0.5).when(ratio.between(0.3, 1.2), 1.0).when(ratio > 1.2, F.greatest(F.lit(0.0), 1.0 - (ratio - 1.2) / 0.8)).otherwise(ratio / 0.3)


def overall_quality(t: Column, confidence: Column, noise: Column) -> Column:
    """Q9; words and clauses are taken once."""

    def score(x: Column) -> Column:
        ws, found = x["w"], x["c"]
        parts = word_accuracy(t, ws) * 0.25 + sentence_fluency(t, found) * 0.20 + punctuation_accuracy(t) * 0.15 + speaker_separation(t, ws) * 0.10
        return parts + confidence * 0.15 + (1.0 - noise) * 0.10 + (1.0 - repetition_score(t, ws)) * 0.05

    return let(F.struct(words(t).alias("w"), clauses(t).alias("c")), score)
