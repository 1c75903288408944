"""Queries of the text operators (T, Q) over whole tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravand.functions import arrow
from ravand.functions import text as T
from ravand.operators.islands import with_rank
from ravand.plans.registry import SQL, query, table
from ravand.session import spread

B = T.BLANK_RE2
ENDS = f"[{T.ENDINGS}]"


def s_strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{B}]+|[{B}]+$', '', 'g')"


def s_squeeze(t: str) -> str:
    return f"regexp_replace({t}, '[{B}]+', ' ', 'g')"


def s_words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '[{B}]+'), lambda x: x <> '')"


def s_count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def s_chain(t: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return t


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def per_document(name: str, column: Callable[[Column], Column], sql: str | None = None, out: str = "result") -> None:
    """A query that maps documents.text to one column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("doc_id", column(F.col("text")).alias(out))

    query(name, f"select doc_id, {sql} as {out} from documents" if sql else None)(run)


def joined(c: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: F.array_join(c(t), "\n")


per_document("t01_words", joined(T.words), f"array_to_string({s_words('text')}, chr(10))")


@query(
    "t02_word_runs",
    f"""
    with w as (select doc_id, text, {s_words("text")} as w from documents),
         e as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w where len(w) > 1),
         b as (select *, case when x = lag(x) over (partition by doc_id order by i) then 0 else 1 end as s from e),
         g as (select *, sum(s) over (partition by doc_id order by i) as r from b),
         c as (select doc_id, r, any_value(x) as x, count(*) as n from g group by doc_id, r),
         o as (select doc_id, string_agg(case when n > 3 then x else rtrim(repeat(x || ' ', n), ' ') end, ' ' order by r) as result from c group by doc_id)
    select w.doc_id, case when len(w.w) > 1 then o.result else w.text end as result from w left join o using (doc_id)""",
)
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.collapse_word_runs(F.col("text")).alias("result"))


def s_phrases(words: str) -> str:
    """CTEs that end in `phrased` (doc_id, t): adjacent repeats of phrases of three to nine words taken out of lists `w` of relation `words`.

    A step takes one word, or a phrase with its first repeat (n is its length then), or one repeat more.
    """
    return f"""walk as (
        select doc_id, 1 as i, 0 as n, cast(null as varchar) as o from {words}
        union all
        select doc_id, case when n > 0 then case when again then i + n else i end when k is not null then i + 2 * k else i + 1 end, case when n > 0 then case when again then n else 0 end else coalesce(k, 0) end,
               case when n > 0 then null when k is not null then array_to_string(w[i:i + k - 1], ' ') else w[i] end
        from (select walk.doc_id, i, n, w, n > 0 and i + n - 1 <= len(w) and w[i:i + n - 1] = w[i - n:i - 1] as again,
                     case when n = 0 then list_filter([3, 4, 5, 6, 7, 8, 9], lambda m: i + 2 * m - 1 <= len(w) and w[i:i + m - 1] = w[i + m:i + 2 * m - 1])[1] end as k
              from walk join {words} as d on walk.doc_id = d.doc_id where i <= len(w))),
        phrased as (select doc_id, string_agg(o, ' ' order by i) as t from walk where o is not null group by doc_id)"""


#: CTEs that end in `cleaned` (doc_id, text): T5 of every document.
S_CLEANED = f"""w as (select doc_id, {s_words("text")} as w from documents),
    e as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w),
    b as (select *, case when x = lag(x) over (partition by doc_id order by i) then 0 else 1 end as s from e),
    g as (select *, sum(s) over (partition by doc_id order by i) as r from b),
    c as (select doc_id, r, any_value(x) as x, count(*) as n from g group by doc_id, r),
    short as (select doc_id, flatten(list(case when n > 3 then [x] else list_transform(range(0, n), lambda i: x) end order by r)) as w from c group by doc_id),
    {s_phrases("short")},
    cleaned as (select doc_id, case when text is not null then coalesce(t, '') end as text from documents left join phrased using (doc_id))"""
S_SENTENCES = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?؟]+(?:[{B}]+|\\z)'), lambda s: {s_strip('s')}), lambda s: length(s) > 5)"
_SW = s_words("s")
S_KEY_PHRASES = f"list_filter(flatten(list_transform(ss, lambda s: flatten(list_transform(range(1, least(len({_SW}) - 2, 5) + 1), lambda i: list_transform(range(3, least(7, len({_SW}) - i + 1) + 1), lambda n: array_to_string(({_SW})[i:i + n - 1], ' ')))))), lambda p: length(p) > 10)[1:5]"
S_CUT = "case when length(s) > 100 then left(s, 100) || '...' else s end"

per_document("t03_phrases", T.collapse_phrases)
SQL["t03_phrases"] = f"with recursive v as (select doc_id, text, {s_words('text')} as w from documents), {s_phrases('v')} select v.doc_id, case when len(w) < 6 then text else t end as result from v left join phrased using (doc_id)"
per_document("t05_clean_repetition", T.clean_repetition)
SQL["t05_clean_repetition"] = f"with recursive {S_CLEANED} select doc_id, text as result from cleaned"
per_document("t07_sentences", joined(T.sentences))
SQL["t07_sentences"] = f"with recursive {S_CLEANED} select doc_id, array_to_string({S_SENTENCES}[1:3], chr(10)) as result from cleaned"
per_document(
    "t07_sentence_split",
    joined(lambda t: T.sentences(t, None, False)),
    f"array_to_string(list_filter(list_transform(regexp_split_to_array({s_strip('text')}, '[.!?؟]+(?:[{B}]+|\\z)'), lambda s: {s_strip('s')}), lambda s: length(s) > 5), chr(10))",
)
per_document("t08_paragraphs", joined(T.paragraphs), f"array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\n[{B}]*\\n|\\.[{B}]*\\n'), lambda p: {s_strip('p')}), lambda p: length(p) >= 50), chr(10))")
per_document("t09_key_phrases", joined(T.key_phrases))
SQL["t09_key_phrases"] = f"with recursive {S_CLEANED} select doc_id, array_to_string({S_KEY_PHRASES}, chr(10)) as result from (select doc_id, {S_SENTENCES}[1:10] as ss from cleaned)"
per_document("t10_preview", lambda t: T.preview(T.sentences(t), F.col("doc_id")))
SQL["t10_preview"] = f"""with recursive {S_CLEANED}
    select doc_id, case when len(ss) < 1 then 'Part ' || doc_id || ': [No meaningful content]' else 'Part ' || doc_id || ' Preview: ' || ss[1] || array_to_string(list_transform(ss[2:], lambda s, i: chr(10) || 'Part ' || doc_id || '.' || (i + 1) || ' Preview:' || chr(10) || s || chr(10) || repeat('-', 50)), '') end as result
    from (select doc_id, list_transform({S_SENTENCES}[1:3], lambda s: {S_CUT}) as ss from cleaned)"""
per_document("t11_basic_cleaning", lambda t: arrow.nfkc(T.squeeze_marks(t)))
per_document("t11_squeeze_marks", T.squeeze_marks, s_chain(s_strip(s_squeeze("text")), ("\\.{2,}", "."), (",{2,}", ",")))
per_document("t13_western_digits", T.western_digits, "translate(text, '۰۱۲۳۴۵۶۷۸۹', '0123456789')")
MARK_STEPS = ((f"[{B}]*([،؛؟!\\.])[{B}]*", "\\1 "), (f"[{B}]*([,;?!])[{B}]*", "\\1 "), (f"\\([{B}]*", " ("), (f"[{B}]*\\)", ") "), (f'"[{B}]*', ' "'), (f'[{B}]*"', '" '), (f"[{B}]+([،؛؟!\\.])\\z", "\\1"), (f"[{B}]+", " "))
per_document("t14_space_marks", T.space_marks, s_strip(s_chain("text", *MARK_STEPS)))
#: CTEs that end in `once` (doc_id, text, c, n_runs, w, o): characters of a run brought down to two, its words, and those without adjacent repeats.
S_ONCE = f"""ch as (select doc_id, unnest(regexp_extract_all(text, '(?s).')) as x, unnest(range(1, length(text) + 1)) as i from documents),
    cb as (select *, case when x = lag(x) over (partition by doc_id order by i) then 0 else 1 end as s from ch),
    cg as (select *, sum(s) over (partition by doc_id order by i) as r from cb),
    ck as (select *, row_number() over (partition by doc_id, r order by i) as k, x in (chr(10), chr(13), chr(133), chr(8232), chr(8233)) as line from cg),
    cc as (select doc_id, string_agg(x, '' order by i) filter (k <= 2 or line) as c, count(*) filter (k = 3 and not line) as n_runs from ck group by doc_id),
    cw as (select d.doc_id, text, case when text is not null then coalesce(c, '') end as c, coalesce(n_runs, 0) as n_runs from documents d left join cc using (doc_id)),
    once as (select *, list_filter(w, lambda x, i: i = 1 or x <> w[i - 1]) as o from (select *, {s_words("c")} as w from cw))"""
per_document("t15_drop_repeats", lambda t: T.drop_repeats(t)[0])
SQL["t15_drop_repeats"] = f"with {S_ONCE} select doc_id, case when len(w) > 1 then array_to_string(o, ' ') else c end as result from once"
per_document("t15_repeat_count", lambda t: T.drop_repeats(t)[1])
SQL["t15_repeat_count"] = f"with {S_ONCE} select doc_id, case when text is not null then n_runs + len(w) - len(o) end as result from once"
per_document(
    "t16_capitalize",
    T.capitalize_clauses,
    "array_to_string(list_concat(list_transform(regexp_extract_all(text, '(?s)[^،؛؟!.]*[،؛؟!.]'), lambda p: upper(left({0}, 1)) || substring({0}, 2) || right(p, 1)), [upper(left({1}, 1)) || substring({1}, 2)]), ' ')".format(
        s_strip("left(p, length(p) - 1)"), s_strip("regexp_extract(text, '(?s)[^،؛؟!.]*\\z')")
    ),
)
per_document(
    "t17_context",
    T.correct_context,
    s_chain("replace(replace(replace(text, 'ایا', 'آیا'), 'میشه', 'می‌شه'), 'نمیشه', 'نمی‌شه')", (f"([{T.WORD}]+)می([{T.WORD}]+)", "\\1 می‌\\2"), (f"([{T.WORD}]+)نمی([{T.WORD}]+)", "\\1 نمی‌\\2")),
)
per_document("t18_close", T.close_text, "case when {0} <> '' and right({0}, 1) not in ('،', '؛', '؟', '!', '.') then {0} || '.' else {0} end".format(s_strip(s_squeeze("text"))))


@query(
    "t19_text_quality",
    f"""
    with d as (select doc_id, {s_words("text")} as w, len(list_filter(list_transform(regexp_split_to_array(text, '{ENDS}'), lambda s: {s_strip("s")}), lambda s: s <> '')) as n_s, {s_count("text", ENDS)} as n_p from documents where text <> ''),
         e as (select doc_id, unnest(w) as x from d), f as (select doc_id, x, count(*) as n from e group by doc_id, x), m as (select doc_id, max(n) as top from f group by doc_id),
         a as (select d.doc_id, len(w) as word_count, n_s as sentence_count, n_p as punctuation_count, case when n_s > 0 then len(w) / cast(n_s as double) else 0.0 end as avg_len, coalesce(top, 0) as top from d left join m using (doc_id))
    select doc_id, word_count, sentence_count, punctuation_count,
           greatest(0, 100 - case when avg_len < 3 then 20 else 0 end - case when avg_len > 20 then 15 else 0 end - case when top * 10 > word_count then 25 else 0 end - case when punctuation_count * 2 < sentence_count then 15 else 0 end) as score,
           concat_ws(', ', case when avg_len < 3 then 'Very short sentences' end, case when avg_len > 20 then 'Very long sentences' end, case when top * 10 > word_count then 'High word repetition' end, case when punctuation_count * 2 < sentence_count then 'Missing punctuation' end) as issues
    from a""",
)
def t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and issues of a text (T19); word frequencies are counted in a shuffle, so long texts cost no square."""
    d = documents(spark, sf_dir).where("text <> ''")
    base = d.select("doc_id", F.size(T.words(F.col("text"))).alias("word_count"), F.size(T.clauses(F.col("text"))).alias("sentence_count"), T.count_of(F.col("text"), ENDS).alias("punctuation_count"))
    top = d.select("doc_id", F.explode(T.words(F.col("text"))).alias("x")).groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("top"))
    a = base.join(top, "doc_id", "left").fillna(0, ["top"])
    avg = F.when(F.col("sentence_count") > 0, F.col("word_count") / F.col("sentence_count")).otherwise(0.0)
    tests = [(avg < 3, 20, "Very short sentences"), (avg > 20, 15, "Very long sentences"), (F.col("top") * 10 > F.col("word_count"), 25, "High word repetition"), (F.col("punctuation_count") * 2 < F.col("sentence_count"), 15, "Missing punctuation")]
    score = F.lit(100)
    for test, minus, _ in tests:
        score = score - F.when(test, minus).otherwise(0)
    issues = F.concat_ws(", ", *[F.when(test, F.lit(name)) for test, _, name in tests])
    return a.select("doc_id", "word_count", "sentence_count", "punctuation_count", F.greatest(F.lit(0), score).alias("score"), issues.alias("issues"))


per_document("t20_post_process", lambda t: T.post_process(t, arrow.nfkc))
per_document("t21_normalize", lambda t: T.normalize(t, arrow.nfd_without_accents))
#: Documents hold no addresses, so each gets one of either kind.
ADDRESSED = "concat_ws(' ', text, 'see https://data.example/x?id=' || doc_id || '&a=(b)', 'mail a.' || doc_id || '@mail.example.org')"


def addressed(column: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda _: column(F.expr(ADDRESSED))


per_document("t22_urls", addressed(T.remove_urls), f"regexp_replace({ADDRESSED}, '{T.URL}', '', 'g')")
per_document("t23_emails", addressed(T.remove_emails), f"regexp_replace({ADDRESSED}, '{T.EMAIL}', '', 'g')")
per_document("t24_symbols", T.remove_symbols, f"regexp_replace(text, '[^{T.WORD}{B}{T.PERSIAN_RE2}]', '', 'g')")
per_document("t25_persian_letters", T.persian_letters, f"translate(text, '{T.ARABIC_LETTERS[0]}', '{T.ARABIC_LETTERS[1]}')")
per_document("t26_zero_width", T.zero_width_to_space, "regexp_replace(text, '[\\x{200B}-\\x{200D}\\x{FEFF}]', ' ', 'g')")
per_document("t27_squeeze", T.squeeze, s_squeeze("text"))
per_document("t28_accents", arrow.nfd_without_accents)
per_document("t29_brackets", T.remove_brackets, "translate(text, '()[]{}', '')")


@query(
    "t30_statistics",
    f"""select doc_id, length(text) as length, len({s_words("text")}) as word_count, {s_count("text", "[\\x{0600}-\\x{06FF}]")} as persian_char_count, {s_count("text", "[a-zA-Z]")} as english_char_count,
        {s_count("text", "\\p{Nd}")} as number_count, {s_count("text", f"[^{T.WORD}{B}]")} as punctuation_count, regexp_matches(text, '[۰۱۲۳۴۵۶۷۸۹]') as has_persian_numbers, regexp_matches(text, '[{T.ARABIC_LETTERS[0]}]') as has_arabic_chars
        from documents where text is not null""",
)
def t30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("text is not null").select("doc_id", *[c.alias(n) for n, c in T.text_statistics(F.col("text")).items()])


@query(
    "t31_report",
    f"""with n as (select text, {s_strip(s_squeeze("translate(text, '()[]{}', '')"))} as o from documents where text is not null), g as (select text, case when length(o) < 3 then '' else left(o, 1000) end as o from n)
        select count(*) as total_texts, count(*) filter (o <> '') as successful, count(*) filter (o = '') as failed, count(*) filter (o <> '') / cast(count(*) as double) as success_rate,
               avg(length(text)) as input_avg_length, avg(length(o)) filter (o <> '') as output_avg_length, min(length(text)) as input_min_length, min(length(o)) filter (o <> '') as output_min_length, max(length(text)) as input_max_length, max(length(o)) filter (o <> '') as output_max_length from g""",
)
def t31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report over texts and what brackets, blanks and bounds leave of them."""
    t = F.col("text")
    g = table(spark, sf_dir, "documents").where("text is not null").select("text", T.bounded_text(T.strip(T.squeeze(T.remove_brackets(t)))).alias("o"))
    ok = F.col("o") != ""
    n_in, n_out = F.length("text"), F.when(ok, F.length("o"))
    return g.agg(
        F.count(F.lit(1)).alias("total_texts"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"),
        F.avg(n_in).alias("input_avg_length"), F.avg(n_out).alias("output_avg_length"), F.min(n_in).alias("input_min_length"), F.min(n_out).alias("output_min_length"), F.max(n_in).alias("input_max_length"), F.max(n_out).alias("output_max_length"),
    )


#: Chunk numbers that are joined in one step before the steps of a file are; a bound of a task's first work, not of the result.
STEP = 500


@query(
    "t32_merge_chunks",
    f"""select file_id, trim(replace(string_agg({s_strip("text")}, ' ' order by chunk_id, row_id), '  ', ' ')) as merged, count(*) as n_chunks
        from chunk_info where {s_strip("coalesce(text, '')")} <> '' and file_id is not null group by file_id""",
)
def t32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk texts of a file merged in order, blank ones dropped, doubled blanks halved once.

    A transcript is one text, so a row grows with its file; it is put together from steps that other tasks have joined.
    A doubled blank lies within one chunk, so it is halved there.
    """
    rows = table(spark, sf_dir, "chunk_info").select("file_id", "chunk_id", "row_id", T.strip(F.col("text")).alias("t")).where("t <> '' and file_id is not null")
    rows = rows.select("file_id", F.expr(f"chunk_id div {STEP}").alias("step"), F.struct("chunk_id", "row_id", F.replace("t", F.lit("  "), F.lit(" ")).alias("t")).alias("x"))

    def joined(column: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda v: v["t"]), " ")

    steps = rows.groupBy("file_id", "step").agg(joined("x").alias("t"), F.count(F.lit(1)).alias("n")).select("file_id", F.struct("step", "t").alias("x"), "n")
    return steps.groupBy("file_id").agg(joined("x").alias("merged"), F.sum("n").alias("n_chunks"))


@query("t33_labelled_lines", "select seg_id, '[Speaker ' || speaker_id || '] (' || printf('%.2f', start_time) || '-' || printf('%.2f', end_time) || '): ' || trim(text, ' ') as line from speaker_segment where trim(coalesce(text, ''), ' ') <> '' and start_time is not null and end_time is not null and speaker_id is not null")
def t33(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "speaker_segment").where("trim(coalesce(text, '')) <> '' and start_time is not null and end_time is not null and speaker_id is not null")
    return s.select("seg_id", F.concat(F.lit("[Speaker "), "speaker_id", F.lit("] ("), T.fixed2(F.col("start_time")), F.lit("-"), T.fixed2(F.col("end_time")), F.lit("): "), F.trim("text")).alias("line"))


@query("t34_speaker_counts", "select file_id, count(distinct speaker_id) as speaker_count, count(*) as segment_count from speaker_segment where trim(coalesce(text, ''), ' ') <> '' group by file_id")
def t34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct speakers and spoken segments of each file (T34, AG6)."""
    return table(spark, sf_dir, "speaker_segment").where("trim(coalesce(text, '')) <> ''").groupBy("file_id").agg(F.countDistinct("speaker_id").alias("speaker_count"), F.count(F.lit(1)).alias("segment_count"))


@query(
    "t35_reduction",
    f"""with c as (select doc_id, text as o, {s_strip(s_squeeze(s_chain("text", *MARK_STEPS)))} as c from documents where text is not null)
        select doc_id, length(o) as original_length, length(c) as cleaned_length, len({s_words("o")}) as original_words, len({s_words("c")}) as cleaned_words,
               case when length(o) > 0 then (length(o) - length(c)) / cast(length(o) as double) * 100 else 0.0 end as reduction_percentage from c""",
)
def t35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes before and after cleaning and the reduction in per cent."""
    c = documents(spark, sf_dir).where("text is not null").select("doc_id", F.col("text").alias("o"), T.strip(T.squeeze(T.space_marks(F.col("text")))).alias("c"))
    n, m = F.length("o"), F.length("c")
    return c.select("doc_id", n.alias("original_length"), m.alias("cleaned_length"), F.size(T.words(F.col("o"))).alias("original_words"), F.size(T.words(F.col("c"))).alias("cleaned_words"), F.when(n > 0, (n - m) / n * 100).otherwise(0.0).alias("reduction_percentage"))


per_document("t36_truncate", lambda t: T.ellipsis(t, 80), "case when length(text) > 80 then left(text, 80) || '...' else text end")
per_document("t36_truncate_inside", lambda t: T.ellipsis(t, 80, inside=True), "case when length(text) > 80 then left(text, 77) || '...' else text end")


@query("t37_reverse", "select row_id, array_to_string(list_transform(range(length(text), 0, -1), lambda i: substring(text, i, 1)), '') as result from chunk_info where text is not null")
def t37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_info").where("text is not null").select("row_id", F.reverse("text").alias("result"))


@query(
    "t38_word_error_rate",
    f"""with p as (select rec_id, {s_words("text")} as a, {s_words("regexp_replace(replace(text, 'را', ''), 'کرد', 'کرده بود', 'g')")} as b from asr_manifest where text is not null),
             k as (select *, list_distinct(list_concat(a, b)) as d from p),
             c as (select rec_id, len(a) as n, levenshtein(array_to_string(list_transform(a, lambda x: chr(cast(32 + list_position(d, x) as int))), ''), array_to_string(list_transform(b, lambda x: chr(cast(32 + list_position(d, x) as int))), '')) as e from k)
        select sum(e) as edits, sum(n) as reference_words, 100.0 * sum(e) / sum(n) as wer from c""",
)
def t38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of a corpus: edits over reference words (T38). The hypotheses are the texts with two words altered."""
    p = spread(table(spark, sf_dir, "asr_manifest").where("text is not null").select("text")).select(F.col("text").alias("a"), F.regexp_replace(F.replace("text", F.lit("را"), F.lit("")), "کرد", "کرده بود").alias("b"))
    c = p.select(F.size(T.words(F.col("a"))).cast("bigint").alias("n"), T.word_distance(F.col("a"), F.col("b")).cast("bigint").alias("e"))
    return c.agg(F.sum("e").alias("edits"), F.sum("n").alias("reference_words"), (F.lit(100.0) * F.sum("e") / F.sum("n")).alias("wer"))


@query(
    "t39_listing",
    "select file_id, chunk_id, row_id, 'Part ' || row_number() over (partition by file_id order by chunk_id, row_id) || ': ' || case when length(text) > 50 then left(text, 47) || '...' else text end as line from chunk_info where text is not null and file_id is not null",
)
def t39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered listing of the chunks of a file (T39); ranked within steps of chunk numbers, so no window spans a file."""
    rows = table(spark, sf_dir, "chunk_info").where("text is not null and file_id is not null").select("file_id", "chunk_id", "row_id", "text")
    rows = with_rank(rows, ["file_id"], F.expr(f"chunk_id div {STEP}"), ["chunk_id", "row_id"], "n")
    return rows.select("file_id", "chunk_id", "row_id", F.concat(F.lit("Part "), F.col("n").cast("string"), F.lit(": "), T.ellipsis(F.col("text"), 50, inside=True)).alias("line"))


@query("t04_similarity")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each held-out item to the next of its language (T4)."""
    items = table(spark, sf_dir, "eval_items")
    nxt = F.lead("text").over(Window.partitionBy("lang").orderBy("item_id"))
    return items.select("item_id", "text", nxt.alias("other")).select("item_id", arrow.similarity("text", "other").alias("ratio"))


@query(
    "t06_common_run",
    f"""with p as (select item_id, {s_words("text")} as a, {s_words("lead(text) over (partition by lang order by item_id)")} as b from eval_items),
             x as (select item_id, unnest(a) as w, unnest(range(0, len(a))) as i from p), y as (select item_id, unnest(b) as w, unnest(range(0, len(b))) as j from p),
             m as (select x.item_id, i, j, i - row_number() over (partition by x.item_id, i - j order by i) as g from x join y on x.item_id = y.item_id and x.w = y.w),
             r as (select item_id, i - j as d, g, count(*) as n, min(i) as i, min(j) as j from m group by item_id, i - j, g),
             f as (select *, row_number() over (partition by item_id order by n desc, i, j) as k from r where n >= 2)
        select p.item_id, coalesce(n, 0) as length, coalesce(i, 0) as start1, coalesce(j, 0) as start2 from p left join f on p.item_id = f.item_id and k = 1""",
)
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common run of two or more words of each item and the next (T6): equal words joined, islands by diagonal."""
    p = table(spark, sf_dir, "eval_items").select("item_id", T.words(F.col("text")).alias("a"), T.words(F.lead("text").over(Window.partitionBy("lang").orderBy("item_id"))).alias("b"))
    x, y = p.select("item_id", F.posexplode("a").alias("i", "w")), p.select("item_id", F.posexplode("b").alias("j", "w"))
    m = x.join(y, ["item_id", "w"]).withColumn("d", F.col("i") - F.col("j"))
    m = m.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("item_id", "d").orderBy("i")))
    r = m.groupBy("item_id", "d", "g").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i"), F.min("j").alias("j")).where("n >= 2")
    best = r.groupBy("item_id").agg(F.max(F.struct("n", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("z"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return p.select("item_id").join(best, "item_id", "left").select("item_id", z("z.n").alias("length"), (-z("z.i")).alias("start1"), (-z("z.j")).alias("start2"))


# Quality scores

S_CLAUSES = f"list_filter(list_transform(regexp_split_to_array(text, '{ENDS}'), lambda s: {s_strip('s')}), lambda s: s <> '')"
S_BLANK = f"{s_strip('text')} = ''"
_bare = f"regexp_replace(w, '[^{T.PERSIAN_RE2}]', '', 'g')"
S_VALID = f"(regexp_matches(w, '[{T.PERSIAN_RE2}]') and ((length(w) >= 2 and regexp_matches(w, '[\\x{{0600}}-\\x{{06FF}}]')) or (length({_bare}) >= 2 and (regexp_matches({_bare}, '(?:ی|ان|ها|ات|ین|ون)$') or regexp_matches({_bare}, '^(?:می|نمی|بی|با|در|از|به|که)') or regexp_matches({_bare}, '[\\x{{0600}}-\\x{{06FF}}]')))))"
S_Q1 = f"case when {S_BLANK} then 0.0e0 else len(list_filter({s_words('text')}, lambda w: {S_VALID})) / cast(len({s_words('text')}) as double) end"
_score = f"case when len({s_words('s')}) < 3 then 3000 else (case when len({s_words('s')}) > 25 then 7 else 10 end) * (case when regexp_matches(s, '[{B}]{{2,}}') then 9 else 10 end) * 80 end"
S_Q2 = f"case when {S_BLANK} or len({S_CLAUSES}) = 0 then 0.0e0 else cast(list_sum(list_transform({S_CLAUSES}, lambda s: {_score})) as double) / len({S_CLAUSES}) / 10000.0e0 end"
S_Q3 = f"case when {S_BLANK} then 0.0e0 when {s_count('text', ENDS)} = 0 then 0.5e0 else {s_count('text', ENDS)} / cast({s_count('text', ENDS)} + 1 as double) / 1.5e0 end"
_verbs = "(" + " + ".join(s_count("text", v) for v in T.SPEECH_VERBS) + ")"
_ratio4 = f"({_verbs} / cast(len({s_words('text')}) as double))"
S_Q4 = f"case when len({s_words('text')}) < 10 then 0.5e0 when {_ratio4} between 0.005e0 and 0.03e0 then 1.0e0 when {_ratio4} > 0.03e0 then greatest(0.0e0, 1.0e0 - ({_ratio4} - 0.03e0) / 0.02e0) else {_ratio4} / 0.005e0 end"
_n7 = f"len({s_words('text')})"
S_Q7 = f"case when {_n7} < 5 then 0.0e0 else least(1.0e0, ({_n7} - len(list_distinct({s_words('text')}))) / cast({_n7} as double) * 2) end"
_links = "(" + " + ".join(s_count("text", v) for v in T.CONNECTORS) + ")"
_ratio8 = f"({_links} / cast(len({S_CLAUSES}) as double))"
S_Q8 = f"case when {S_BLANK} then 0.0e0 when len({S_CLAUSES}) < 2 then 0.5e0 when {_ratio8} between 0.3e0 and 1.2e0 then 1.0e0 when {_ratio8} > 1.2e0 then greatest(0.0e0, 1.0e0 - ({_ratio8} - 1.2e0) / 0.8e0) else {_ratio8} / 0.3e0 end"
S_NOISE = "least(1.0e0, greatest(0.0e0, ((case when snr >= 25 then 0.1e0 when snr >= 15 then 0.3e0 when snr >= 10 then 0.6e0 else 0.9e0 end) + (1.0e0 - quality)) / 2))"
per_document("q01_word_accuracy", T.word_accuracy, S_Q1)
per_document("q02_sentence_fluency", T.sentence_fluency, S_Q2)
per_document("q03_punctuation_accuracy", T.punctuation_accuracy, S_Q3)
per_document("q04_speaker_separation", T.speaker_separation, S_Q4)
per_document("q07_repetition", T.repetition_score, S_Q7)
per_document("q08_context_coherence", T.context_coherence, S_Q8)


@query("q06_noise_level", f"with m as (select seg_id, coalesce(confidence, 0.5e0) * 30 as snr, coalesce(confidence, 0.5e0) as quality from speaker_segment) select seg_id, {S_NOISE} as noise_level from m")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.5))
    return table(spark, sf_dir, "speaker_segment").select("seg_id", T.noise_level(c * 30, c).alias("noise_level"))


_METRICS = f"{S_Q1} as word_accuracy, {S_Q2} as sentence_fluency, {S_Q3} as punctuation_accuracy, {S_Q4} as speaker_separation, 0.5e0 as confidence, 0.25e0 as noise_level, {S_Q7} as repetition, {S_Q8} as coherence"
_METRICS_SQL = f"select doc_id, {_METRICS} from documents where text is not null"
_OVERALL = "word_accuracy * 0.25e0 + sentence_fluency * 0.20e0 + punctuation_accuracy * 0.15e0 + speaker_separation * 0.10e0 + confidence * 0.15e0 + (1.0e0 - noise_level) * 0.10e0 + (1.0e0 - repetition) * 0.05e0"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of each text; words and clauses are columns of a step before, so that they are taken once."""
    t, ws, found = F.col("text"), F.col("ws"), F.col("found")
    d = documents(spark, sf_dir).where("text is not null").select("doc_id", "text", T.words(t).alias("ws"), T.clauses(t).alias("found"))
    return d.select(
        "doc_id", T.word_accuracy(t, ws).alias("word_accuracy"), T.sentence_fluency(t, found).alias("sentence_fluency"), T.punctuation_accuracy(t).alias("punctuation_accuracy"), T.speaker_separation(t, ws).alias("speaker_separation"),
        F.lit(0.5).alias("confidence"), T.noise_level(F.lit(20.0), F.lit(0.8)).alias("noise_level"), T.repetition_score(t, ws).alias("repetition"), T.context_coherence(t, found).alias("coherence"),
    )


def _overall() -> Column:
    c = F.col
    return c("word_accuracy") * 0.25 + c("sentence_fluency") * 0.20 + c("punctuation_accuracy") * 0.15 + c("speaker_separation") * 0.10 + c("confidence") * 0.15 + (1.0 - c("noise_level")) * 0.10 + (1.0 - c("repetition")) * 0.05


@query("q09_overall", f"with m as ({_METRICS_SQL}) select doc_id, floor(({_OVERALL}) * 1e9 + 0.5) as overall_e9 from m")
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("doc_id", F.floor(_overall() * 1e9 + 0.5).cast("double").alias("overall_e9"))


@query(
    "q10_auto_tune",
    f"""with m as ({_METRICS_SQL})
        select doc_id, case when word_accuracy < 0.8e0 then least(30000, 20000 + 5000) else 20000 end as chunk_duration_ms, case when sentence_fluency < 0.7e0 then least(1000, 200 + 200) else 200 end as overlap_ms,
               case when noise_level > 0.5e0 then 0.3e0 else 0.4e0 end as noise_threshold, case when repetition > 0.3e0 then least(0.9e0, 0.85e0 + 0.05e0) else 0.85e0 end as repetition_threshold,
               case when repetition > 0.3e0 then greatest(1, 2 - 1) else 2 end as max_word_repetition, case when confidence < 0.7e0 then greatest(0.5e0, 0.7e0 - 0.1e0) else 0.7e0 end as min_chunk_confidence,
               sentence_fluency < 0.7e0 or punctuation_accuracy < 0.6e0 as enable_text_postprocessing, word_accuracy < 0.8e0 or punctuation_accuracy < 0.6e0 or confidence < 0.7e0 as greedy_decoding from m""",
)
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings tuned from the metrics of a text (Q10)."""
    c, w = F.col, F.when
    acc, flu, pun, rep, conf = c("word_accuracy") < 0.8, c("sentence_fluency") < 0.7, c("punctuation_accuracy") < 0.6, c("repetition") > 0.3, c("confidence") < 0.7
    return _metrics(spark, sf_dir).select(
        "doc_id", w(acc, F.least(F.lit(30000), F.lit(25000))).otherwise(20000).alias("chunk_duration_ms"), w(flu, F.least(F.lit(1000), F.lit(400))).otherwise(200).alias("overlap_ms"), w(c("noise_level") > 0.5, 0.3).otherwise(0.4).alias("noise_threshold"),
        w(rep, F.least(F.lit(0.9), F.lit(0.85) + 0.05)).otherwise(0.85).alias("repetition_threshold"), w(rep, 1).otherwise(2).alias("max_word_repetition"), w(conf, F.greatest(F.lit(0.5), F.lit(0.7) - 0.1)).otherwise(0.7).alias("min_chunk_confidence"),
        (flu | pun).alias("enable_text_postprocessing"), (acc | pun | conf).alias("greedy_decoding"),
    )


@query(
    "q11_report_band",
    f"""with m as (select *, floor(({_OVERALL}) * 1e9 + 0.5) / 1e9 as overall from ({_METRICS_SQL}))
        select doc_id, case when overall >= 0.95 then 'excellent' when overall >= 0.85 then 'good' when overall >= 0.70 then 'moderate' else 'poor' end as band,
               concat_ws(',', case when word_accuracy < 0.8e0 then 'words' end, case when sentence_fluency < 0.7e0 then 'fluency' end, case when punctuation_accuracy < 0.6e0 then 'punctuation' end, case when noise_level > 0.5e0 then 'noise' end, case when repetition > 0.3e0 then 'repetition' end) as recommendations from m""",
)
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, w = F.col, F.when
    m = _metrics(spark, sf_dir).withColumn("overall", F.floor(_overall() * 1e9 + 0.5) / 1e9)
    band = w(c("overall") >= 0.95, "excellent").when(c("overall") >= 0.85, "good").when(c("overall") >= 0.70, "moderate").otherwise("poor")
    advice = F.concat_ws(",", w(c("word_accuracy") < 0.8, F.lit("words")), w(c("sentence_fluency") < 0.7, F.lit("fluency")), w(c("punctuation_accuracy") < 0.6, F.lit("punctuation")), w(c("noise_level") > 0.5, F.lit("noise")), w(c("repetition") > 0.3, F.lit("repetition")))
    return m.select("doc_id", band.alias("band"), advice.alias("recommendations"))


#: A text that scores so much is not passed over again.
TARGET = 0.95


def best_pass(scores: list[Column], target: float = TARGET) -> Column:
    """(pass, score) of the best of the passes that are made, the earliest of equals: they stop behind the first at the target."""
    tried, going = [], F.lit(True)
    for k, score in enumerate(scores, 1):
        tried.append(F.when(going, F.struct(score.alias("score"), F.lit(-k).alias("turn"))))
        going = going & (score < target)
    return F.array_max(F.array(*tried))


@query(
    "q12_best_pass",
    f"""with recursive {S_CLEANED},
        p as (select doc_id, 1 as k, text from documents union all select doc_id, 2, text from cleaned union all select doc_id, 3, case when c <> '' and right(c, 1) not in ('،', '؛', '؟', '!', '.') then c || '.' else c end from (select doc_id, {s_strip(s_squeeze(s_chain("text", *MARK_STEPS)))} as c from documents)),
        m as (select doc_id, k, {_METRICS} from p where text is not null), s as (select doc_id, k, {_OVERALL} as s from m)
        select doc_id, arg_max(k, (s, -k)) as best_pass, floor(max(s) * 1e9 + 0.5) as score_e9 from s where not exists (select 1 from s as b where b.doc_id = s.doc_id and b.k < s.k and b.s >= {TARGET}) group by doc_id""",
)
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of up to three passes over a text: as it is, cleaned, post-processed."""
    t = F.col("text")
    passes = [t, T.clean_repetition(t), T.close_text(T.space_marks(t))]
    rows = documents(spark, sf_dir).where("text is not null").select("doc_id", *[v.alias(f"t{k}") for k, v in enumerate(passes)])
    scored = rows.select("doc_id", *[T.overall_quality(F.col(f"t{k}"), F.lit(0.5), F.lit(0.25)).alias(f"s{k}") for k in range(len(passes))])
    return scored.select("doc_id", best_pass([F.col(f"s{k}") for k in range(len(passes))]).alias("b")).select("doc_id", (-F.col("b.turn")).alias("best_pass"), F.floor(F.col("b.score") * 1e9 + 0.5).cast("double").alias("score_e9"))
