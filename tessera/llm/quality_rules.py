"""Quality rules on whole texts: base counts, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words and pairs of adjoining words go to BUCKETS buckets by hash. Two multinomials are counted over
them: the raw corpus (all documents) and the trusted target (documents that labels mark good, all of
them). A bucket weighs log((t + SMOOTHING) / (e + SMOOTHING)), where t is its count in the target and e
the count expected there from the raw corpus; a document's score is the mean weight of its n-grams,
summed in whole millionths so that it is the same whatever the order. It is kept at MIN_SCORE or more.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read_table

#: Buckets (a power of two), pseudo-count of each, weights of one, least mean weight.
BUCKETS, SMOOTHING, SCALE, MIN_SCORE = 2**16, 16.0, 1_000_000, -0.1
#: Ids of trusted documents up to this number are broadcast (about 64 bytes each as a hash relation); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(hashes: Column) -> Column:
    """Words that stand in a window of eight words found twice or more in the text."""
    n = F.size(hashes)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.transform(s, lambda e, k: F.when(F.get(s, k - 1)["x"].eqNullSafe(e["x"]) | F.get(s, k + 1)["x"].eqNullSafe(e["x"]), e["i"]))
            return F.sort_array(F.array_compact(twice))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("bigint"), lambda a, x: a + x)

        return _let(_let(ordered, positions), total)

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def _buckets(hashes: Column) -> Column:
    """Buckets of all words and pairs of adjoining words, given the words' hashes."""
    n = F.size(hashes)
    single = F.transform(hashes, lambda h: h.bitwiseAND(BUCKETS - 1).cast("int"))
    pairs = F.when(n > 1, F.zip_with(F.slice(hashes, 1, F.greatest(n - 1, F.lit(1))), F.slice(hashes, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.xxhash64(a, b).bitwiseAND(BUCKETS - 1).cast("int")))
    return F.concat(single, F.coalesce(pairs, F.array().cast("array<int>")))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """The weight of each bucket in millionths. trusted: a column doc_id of the documents of the target.

    Counts cover all of docs; BUCKETS rows reach the driver, whatever the size of docs. Without
    trusted documents all weights are 0.
    """
    trusted = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    if trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(trusted, F.col("id") == F.col("trusted_id"), "left")
    grams = flagged.select(F.col("trusted_id").isNotNull().cast("bigint").alias("good"), F.explode(_let(_hashes(F.col("text")), _buckets)).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()
    total, good = sum(r.raw for r in counted), sum(r.target for r in counted)
    out = [0] * BUCKETS
    if good:
        for r in counted:
            out[r.bucket] = round(SCALE * math.log((r.target + SMOOTHING) / (r.raw * good / total + SMOOTHING)))
    return out


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30, min_score: float = MIN_SCORE, carry: bool = False) -> DataFrame:
    """Counts and verdict for every row of docs.

    Returns (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed
    boolean, score double, kept boolean). base_failed: fewer than min_words words, or more than
    max_repeat_percent of them repeated. kept: not base_failed, and a score of min_score or more. Null
    and blank texts have no words: they fail, with a score of 0. Rows with null or repeated ids are
    rows like others. Other columns are not read, but with carry the whole input row comes back as the
    struct `row`, so that no name can clash. An empty table gives no rows.
    """
    table = ",".join(map(str, weights(docs, trusted, id_col, text_col)))
    weight = F.split(F.lit(table), ",").cast("array<int>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = ["row"] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    plain = F.col("text")
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def measured(w: Column) -> Column:
        def of(h: Column) -> Column:
            total = F.aggregate(_buckets(h), F.lit(0).cast("bigint"), lambda a, b: a + F.get(weight, b))
            return F.struct(F.size(w).cast("bigint").alias("n_words"), F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(h).alias("n_repeat_words"), total.alias("total"))

        return _let(F.transform(w, lambda x: F.xxhash64(x)), of)

    got = rows.select(
        "doc_id",
        *rest,
        _let(words(F.col("text")), measured).alias("m"),
        (F.octet_length("text") - F.octet_length(plain)).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
    )
    n = F.col("m.n_words")
    got = got.select("doc_id", *rest, n, "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", ((n < min_words) | (100 * F.col("m.n_repeat_words") > max_repeat_percent * n)).alias("base_failed"), F.when(n > 0, F.col("m.total") / (SCALE * (2 * n - 1))).otherwise(0.0).alias("score"))
    return got.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids of the documents that labels mark good."""
    return labels.where("quality = 1").select("doc_id")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The base counts, base_failed and kept of every document; trusted: labels.quality = 1."""
    return quality_rules(read_table(spark, sf_dir, "documents"), trusted_documents(read_table(spark, sf_dir, "labels")))
