"""Quality rules on words, and on lines that too many documents of a host or of the corpus share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import pick
from sentrylake.session import materialize

#: A line is removed if more documents of its host have it, or more documents of the whole corpus.
HOST_LIMIT, CORPUS_LIMIT = 10, 50
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.5
#: Base rules: fewest words, words of a window, and the most words in repeated windows, in hundredths.
FEWEST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SPACE = r"[\x20\x09-\x0D]+"


def _size(array: str) -> Column:
    return F.size(array).cast("long")


def base_measures(rows: DataFrame) -> DataFrame:
    """``rows`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` of column ``text`` (not null).

    ``n_repeat_words``: words in windows of ``WINDOW`` words that occur twice or more in the text. A window is
    known by its 64-bit hash. Only texts in which one repeats go on to sort them, and the words that the
    repeated ones cover are summed from the distances between their starts.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda x: x != "")).withColumn("full_lines", lines)
    out = out.withColumns({
        "n_words": _size("words"), "n_dup_lines": _size("full_lines") - F.size(F.array_distinct("full_lines")),
        "word_chars": F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long"),
        "windows": F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))),
    }).drop("words", "full_lines")
    # in order of the hashes, then of the places; null unless a window repeats
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    last = F.size("sorted") - 1

    def twice(x, k):
        before = (k > 0) & (F.get("sorted", k - 1)["h"] == x["h"])
        return before | ((k < last) & (F.get("sorted", k + 1)["h"] == x["h"]))

    out = out.withColumn("starts", F.sort_array(F.transform(F.filter("sorted", twice), lambda x: x["i"]))).drop("sorted")
    covered = F.transform("starts", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - x, F.lit(WINDOW))))
    covered = F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")


def _lines(with_text: bool) -> Column:
    """Each line with a word: hash of its normal form (lower case, single blanks), its words, its place, and the line itself if asked for."""
    plain = F.split(F.lower(F.regexp_replace("text", r"[\x20\x09\x0B-\x0D]+", " ")), "\n")
    lines = F.transform(plain, lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("i")))
    lines = F.filter(lines, lambda x: x["line"] != "")
    raw = F.split("text", "\n")
    return F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(x["line"]).alias("h"), (F.length(x["line"]) - F.length(F.translate(x["line"], " ", "")) + 1).alias("w"),
            *([F.get(raw, x["i"]).alias("line")] if with_text else []),
        ),
    )


def frequent_lines(docs: DataFrame, host_limit: int = HOST_LIMIT, corpus_limit: int = CORPUS_LIMIT) -> DataFrame:
    """``host, h`` of lines above a limit, from documents ``host, lines``; a document counts a line once.

    Counts are added up in each task before the shuffle, so a line that a third of all documents have is no
    hot key.
    """
    once = docs.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    by_host = once.groupBy("host", "h").agg(F.count("*").alias("n"))
    # a line that is on few hosts and rare on each needs no second look: only candidates are joined
    everywhere = by_host.groupBy("h").agg(F.sum("n").alias("total")).where(F.col("total") > corpus_limit).select("h")
    return by_host.where(F.col("n") > host_limit).select("host", "h").unionByName(by_host.join(everywhere, "h", "left_semi").select("host", "h")).distinct()


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    host_limit: int = HOST_LIMIT, corpus_limit: int = CORPUS_LIMIT, least_left: float = LEAST_LEFT, with_text: bool = False,
) -> DataFrame:
    """The measures, ``base_failed``, ``n_removed_words``, ``depleted`` and ``kept`` of every document; with ``with_text`` its ``text`` of the lines left.

    Words are those between white space of a whole text; a null text has none. A line counts as another's
    equal if they are alike in lower case with single blanks; documents of a null host are those of one host.
    A document that fails the base rules, or of whose words too few are left, isn't kept. Every row is a
    document, also repeated ones and those with a null id.
    """
    rows = pick(docs, doc_id=doc_id, text=text, host=host).withColumn("text", F.coalesce("text", F.lit("")))
    rows = base_measures(rows.withColumn("host", F.coalesce("host", F.lit("")))).withColumn("lines", _lines(with_text)).drop("text")
    # the number of a row is fixed once it is written
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "line-rows")
    heavy = materialize(frequent_lines(rows, host_limit, corpus_limit), "frequent-lines")
    hits = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    gone = hits.join(heavy, ["host", "h"]).groupBy("row").agg(F.sum("w").cast("long").alias("n_removed_words"), *([F.collect_set("h").alias("gone")] if with_text else []))
    out = rows.join(gone, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("depleted", (F.col("n_words") - F.col("n_removed_words")) < least_left * F.col("n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    if with_text:
        left = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("gone", x["h"]), F.lit(False)))
        out = out.withColumn("text", F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "depleted", "kept"]
    return out.select("doc_id", *names, *(["text"] if with_text else []))
