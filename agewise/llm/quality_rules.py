"""Quality rules and an n-gram likelihood ratio, in DataFrame operations only.

Words are runs of anything but space and tab to carriage return.  Base rules fail a text with too few
words or with too many words inside 5-word windows that occur twice.  Of the rest a document is kept
if its n-grams speak for the trusted target rather than for the raw corpus:

* n-grams: each word's last character (letters and non-ASCII characters count as one), each word,
  and pairs of neighbouring words, where equal neighbours are one n-gram of their own; each is hashed
  into one of ``BUCKETS`` buckets;
* two multinomials over buckets, add-one smoothed: of the target (documents of the labels with quality
  1 and not toxic) and of the raw corpus, both counted over all their documents;
* a document's score is the mean over its n-grams of ``ln(target / raw)``, in millionths so that sums are exact
  and do not depend on the order; it is kept if the score is at least ``threshold``.

Buckets are counted map-side, so the counts shuffle at most ``BUCKETS`` rows a task; the table of
weights is one array of ``BUCKETS`` numbers (a scalar of fixed size); a document's n-grams are rows only
inside the task that reads it, which adds them up, so one row a document is shuffled.  Raw counts need no join; for the target's a bitmap of the trusted ids picks the texts to join.  Defined results: null or empty texts have no words and fail the base; a document
labelled more than once is trusted if any label trusts it; null labels trust nothing; with no trusted
document all scores follow the smoothing alone; repeated rows agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.frames import id_column, original_id

BUCKETS = 1 << 14
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
THRESHOLD = -0.5
_UNIT = 1_000_000
#: Bits of the bitmap of trusted ids (512 KB).
ID_BITS = 1 << 22


def words_column(text: str = "text"):
    """The words: every white character becomes a space, at which the text is split (no pattern is searched)."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), "")


def base_rules(rows: DataFrame) -> DataFrame:
    """Adds the counts and ``base_failed`` to rows with ``text``, ``words`` and ``hashes``."""
    lines = "filter(split(coalesce(text, ''), '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    # 5-word windows by the fingerprints of their words; only texts with equal ones look for their places
    windows = f"""if(size(hashes) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(hashes) - {WINDOW}),
        i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2], hashes[i + 3], hashes[i + 4])))"""
    placed = """if(size(prints) = size(array_distinct(prints)), cast(array() as array<struct<h:bigint,i:int>>),
        array_sort(transform(prints, (h, i) -> struct(h as h, i as i))))"""
    repeated = """array_sort(transform(filter(sequence(0, size(windows) - 1), k ->
        windows[k].h <=> get(windows, k - 1).h or windows[k].h <=> get(windows, k + 1).h), k -> windows[k].i))"""
    covered = f"""if(size(at) = 0, 0L, aggregate(sequence(0, size(at) - 1), 0L,
        (n, k) -> n + least({WINDOW}, coalesce(get(at, k + 1) - at[k], {WINDOW}))))"""
    return (rows.withColumn("n_words", F.size("words").cast("long"))
            .withColumn("word_chars", F.char_length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")).cast("long"))
            .withColumn("n_symbols", F.expr("cast(char_length(coalesce(text, '')) - char_length(translate(coalesce(text, ''), '#*$%&|<>', '')) as bigint)"))
            .withColumn("lines", F.expr(lines))
            .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
            .withColumn("prints", F.expr(windows)).withColumn("windows", F.expr(placed))
            .withColumn("at", F.expr(f"if(size(windows) < 2, cast(array() as array<int>), {repeated})"))
            .withColumn("n_repeat_words", F.expr(covered)).drop("lines", "prints", "windows", "at")
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))))


def hashes_column(words: str = "words"):
    """The fingerprint of each word; windows are made of these."""
    return F.expr(f"transform({words}, w -> xxhash64(w))")


def mark_buckets(spark) -> str:
    """An array literal: the bucket of the mark of each code of a word's last character (cut off at 128)."""
    letter = "c between 97 and 122 or c = 128 or c between 65 and 90"
    row = spark.range(1).select(F.expr(f"transform(sequence(0, 128), c -> pmod(xxhash64(if({letter}, 0, c)), {BUCKETS}))")).first()  # 129 numbers
    return "array(" + ", ".join(f"{int(x)}" for x in row[0]) + ")"


def trusted_documents(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows whose ``id`` is among ``trusted``.

    A bitmap of the ids' hashes, of a fixed size, drops most other rows where they are read, so only few texts
    are shuffled for the join that decides."""
    slot = f"pmod(xxhash64(id), {ID_BITS}L)"
    words = trusted.selectExpr(f"cast({slot} div 64 as int) as word", f"shiftleft(1L, cast({slot} % 64 as int)) as bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = rows.sparkSession.range(ID_BITS // 64).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    bitmap = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w")).select(
        F.expr("transform(w, x -> x.bits)"))
    # a scalar, not a join, behind which the optimizer would move the filter
    bits = F.call_function("shiftright", F.get(bitmap.scalar(), F.expr(f"cast({slot} div 64 as int)")), F.expr(f"cast({slot} % 64 as int)"))
    return rows.where(bits.bitwiseAND(F.lit(1)) == 1).join(trusted, "id", "left_semi")


def grams(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each word and its follower, with the buckets of the n-grams that begin there: ``mark``, ``word``, ``pair``.

    The pair of the last word is null; a row without words stays, with nulls.  No lambda: all of it is compiled code."""
    marks = mark_buckets(rows.sparkSession)
    words = rows.select(*keep, F.explode_outer(F.expr("arrays_zip(words, slice(words, 2, size(words)))")).alias("p"))
    hashes = words.selectExpr(*keep, "if(p is null, null, xxhash64(p['words'])) as h", "if(p['1'] is null, null, xxhash64(p['1'])) as g",
                              "least(128, ascii(substring(p['words'], -1, 1))) as code")
    return hashes.selectExpr(*keep, f"if(h is null, null, get({marks}, code)) as mark", f"cast(pmod(h, {BUCKETS}) as int) as word",
                             f"if(g is null, null, cast(pmod(if(g = h, 3L, xxhash64(h, g)), {BUCKETS}) as int)) as pair")


def _bucket_counts(rows: DataFrame, name: str) -> DataFrame:
    """``(bucket, name)``: how often each n-gram occurs."""
    each = grams(rows.select(words_column().alias("words"))).select(F.explode(F.array("mark", "word", "pair")).alias("bucket"))
    return each.groupBy("bucket").agg(F.count("*").alias(name))


def weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(bucket, weight)`` for every bucket: millionths of ``ln(target share / raw share)``."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct()
    rows = docs.select(id_column().alias("id"), "text")
    counts = _bucket_counts(rows, "raw").join(_bucket_counts(trusted_documents(rows, trusted), "target"), "bucket", "left")
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    every = every.select("bucket", (F.coalesce("raw", F.lit(0)) + 1).alias("raw"), (F.coalesce("target", F.lit(0)) + 1).alias("target"))
    total = every.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    share = F.log(F.col("target") / F.col("all_target")) - F.log(F.col("raw") / F.col("all_raw"))
    return every.join(F.broadcast(total)).select("bucket", F.round(share * _UNIT).cast("long").alias("weight"))


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and decisions for every row: ``id``, the base columns, ``score``, ``kept``."""
    table = weights(docs, labels).agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("table"))
    table = table.select(F.expr("transform(table, x -> x.weight)")).scalar()
    rows = base_rules(docs.select(F.monotonically_increasing_id().alias("row"), id_column().alias("id"), "text")
                      .withColumn("words", words_column()).withColumn("hashes", hashes_column()))
    base = [c for c in rows.columns if c not in ("row", "text", "words", "hashes")]
    # all n-grams of a row lie in one task, which adds them up before the shuffle, whatever numbers the rows have
    weight = sum((F.coalesce(F.get(table, F.col(c)), F.lit(0)) for c in ("word", "pair")), F.coalesce(F.get(table, F.col("mark")), F.lit(0)))
    scored = (grams(rows, "row", *base).groupBy("row").agg(*[F.first(c).alias(c) for c in base], F.sum(weight).alias("total")))
    n_grams = F.greatest(3 * F.col("n_words") - 1, F.lit(1))
    score = F.when(F.col("n_words") > 0, F.col("total") / n_grams / _UNIT).otherwise(0.0)
    return (scored.withColumn("score", score)
            .withColumn("kept", ~F.col("base_failed") & (F.col("total") >= F.lit(round(threshold * _UNIT)) * n_grams))
            .drop("row", "total"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its counts and decisions."""
    out = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(original_id().alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "score")
