"""Quality rules, line first. Built-in functions only.

Rules on punctuation, navigation and boilerplate judge each line; lines that fail go, and a document that loses more
than half of its words that way is rejected, as is one that fails the base rules (too few words, or mostly repeated
word windows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD_BREAK, read

#: Phrases of boilerplate lines, lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "we use cookies", "enable javascript", "javascript is disabled", "sign up for our newsletter",
    "subscribe to our newsletter", "click here to", "share this", "powered by", "lorem ipsum",
)
#: Words that part the items of a navigation line.
SEPARATORS = ("|", "·", "•", "»", "›", "→", "/")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 50
#: A boilerplate phrase condemns lines of so many words at most.
BOILERPLATE_WORDS = 25
#: Positions that fit into the low bits of a sort key.
_BITS = 20


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though a lambda reads it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


def _repeated(windows: Column, key) -> Column:
    """Positions whose key is not alone: sort key and position packed into one long, then compare neighbours."""
    def near(packed: Column) -> Column:
        same = lambda x, i: F.get(packed, i).isNotNull() & (
            F.shiftrightunsigned(F.get(packed, i), _BITS) == F.shiftrightunsigned(x, _BITS))
        found = F.filter(packed, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False))
                         | F.coalesce(same(x, i + 1), F.lit(False)))
        return F.transform(found, lambda x: x.bitwiseAND(F.lit((1 << _BITS) - 1)))

    return once(F.sort_array(F.transform(windows, lambda h, i: key(h).bitwiseOR(i.cast("long")))), near)


def _repeated_long(windows: Column) -> Column:
    """The same for texts with more positions: sorts pairs, slower but without a bound."""
    def near(pairs: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        found = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.transform(found, lambda x: x["i"].cast("long"))

    return once(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), near)


def repeat_words(words: Column, size: int = 3) -> Column:
    """Words that stand in a window of ``size`` words which the text holds twice or more."""
    def covered(windows: Column) -> Column:
        # high and low bits of the hash, each with the position: a position repeats if it does in both
        high = _repeated(windows, lambda h: F.shiftleft(F.shiftrightunsigned(h, _BITS), _BITS))
        low = _repeated(windows, lambda h: F.shiftleft(h, _BITS))
        at = F.when(F.size(windows) < (1 << _BITS), F.array_intersect(high, low)).otherwise(_repeated_long(windows))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(*(p + k for k in range(size)))))))

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - size),
                              lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        return once(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return once(words, lambda w: F.when(F.size(w) < size, F.lit(0)).otherwise(count(w))).cast("long")


def line_fails(line: Column, words: Column) -> Column:
    """A line with words fails if it has no sentence mark at all or more symbols than half its words (punctuation),
    if three or more of its words part items (navigation), or if it is short and holds a set phrase (boilerplate)."""
    lower = F.lower(line)
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    parted = F.size(F.filter(words, lambda w: w.isin(*SEPARATORS)))
    phrase = lower.contains(BOILERPLATE[0])
    for p in BOILERPLATE[1:]:
        phrase = phrase | lower.contains(p)
    return (~line.rlike("[.!?…。！？؟।]") | (symbols * 2 > F.size(words)) | (parted >= 3)
            | ((F.size(words) <= BOILERPLATE_WORDS) & phrase))


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__q``: the base counts, the counts of the line rules, the cleaned text and the
    verdict. A null or empty text has no words and fails the base rules; repeated rows get the same verdict; no
    column is read but the text. White space around kept lines stays, blank lines stay."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), words_of(x).alias("words")))
    docs = docs.withColumn("__words", words_of(text)).withColumn("__lines", lines)
    docs = docs.withColumn("__lines", F.transform("__lines", lambda x: F.struct(
        x["line"].alias("line"), F.size(x["words"]).alias("n"),
        ((F.size(x["words"]) > 0) & line_fails(x["line"], x["words"])).alias("bad"))))
    with_words = F.transform(F.filter("__lines", lambda x: x["n"] > 0), lambda x: x["line"])
    bad = F.filter("__lines", lambda x: x["bad"])
    n = F.size("__words").cast("long")
    docs = docs.withColumn("__q", F.struct(
        n.alias("n_words"),
        F.length(F.regexp_replace(text, WORD_BREAK, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(with_words) - F.size(F.array_distinct(with_words))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__words")).alias("n_repeat_words"),
        F.size(bad).cast("long").alias("n_bad_lines"),
        F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_lost_words"),
        F.array_join(F.transform(F.filter("__lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("cleaned"),
    ))
    q = F.col("__q")
    failed = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MOST_REPEATED)
    return docs.withColumn("__q", q.withField("base_failed", failed).withField(
        "kept", ~failed & (q["n_lost_words"] * 100 <= q["n_words"] * MOST_LOST))).drop("__words", "__lines")


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that pass, without the lines that fail; n_chars, where there is one, is the new text's length."""
    kept = judged(docs).where("__q.kept").withColumn("text", F.col("__q.cleaned")).drop("__q")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if (
        "n_chars" in docs.columns) else kept


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts and verdicts."""
    q = judged(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *(f"__q.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "n_lost_words",
        "base_failed", "kept")))


OP6_SQL = """
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
lines as (
  select r, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as w
  from (select r, unnest(string_split(text, chr(10))) as line from docs)),
judged as (
  select r, line, len(w) as n, len(w) > 0 and (
    not regexp_matches(line, '[.!?…。！？؟।]')
    or 2 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) > len(w)
    or len(list_filter(w, lambda x: x in ('|', '·', '•', '»', '›', '→', '/'))) >= 3
    or (len(w) <= 25 and (""" + " or ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE) + """))) as bad
  from lines),
by_line as (
  select r, count(*) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup_lines,
         count(*) filter (bad) as n_bad_lines, coalesce(sum(n) filter (bad), 0) as n_lost_words
  from judged group by r),
spots as (
  select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select r, w, unnest(range(1, len(w) - 1)) as i from docs)),
twice as (
  select r, i from (select r, i, count(*) over (partition by r, a, b, c) as k from spots) where k > 1),
covered as (
  select r, count(distinct p) as n_repeat_words
  from (select r, unnest([i, i + 1, i + 2]) as p from twice) group by r),
base as (
  select r, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         n_dup_lines::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         n_bad_lines::bigint as n_bad_lines, n_lost_words::bigint as n_lost_words
  from docs join by_line using (r) left join covered using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, n_lost_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * n_lost_words <= 50 * n_words as kept
from base
"""
