"""Importance resampling toward a target: documents whose hashed n-grams look like those of a target corpus are drawn more often.

Every document becomes one array of buckets, made by higher-order functions within its row; the arrays are stored once. Counts of a bucket
are partial sums in each task, so that only ``BUCKETS`` totals a task are shuffled, and the gains, one number a bucket, are a literal in the
plan of the scoring: a document's weight is an ``aggregate`` over its array, without exploding, joining or shuffling it.

Drawing the highest scores needs no sort of all documents: a histogram of the scores gives the score at which the draw ends. Only documents
at or above it are put in order, in ranges of (score, id, row) that no repeated value can make uneven, and ranks are a range's offset and
the place within it.

Defined results: a null text has no words; a null id comes last among ties and is hashed as an empty one; rows that repeat are rows of their own,
ranked one after the other. Without features a weight is 0. Of an empty table nothing is drawn; an empty target gives
gains too. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .spelling import CRC_TABLE, crc_of

BUCKETS, NGRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: A word: digits, letters and all that is not ASCII; A-Z are lower-cased later.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(word: Column) -> Column:
    """A-Z only; an ASCII word, as most are, goes the short way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def buckets_of(words: Column, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``ngrams`` of the words, as one array."""
    hashed = lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: hashed(F.concat_ws(" ", w, *(F.get(words, i + k) for k in range(1, n)))))

    found = [F.transform(words, hashed), *(runs(n) for n in range(2, ngrams + 1))]
    return found[0] if ngrams == 1 else F.concat(*found)


def featured(table: DataFrame, *keep: str, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``keep``, n_words and the array of buckets of each row's text."""
    found = table.select(*keep, F.coalesce(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.array().cast("array<string>")).alias("words"))
    lowered = found.select(*keep, F.transform("words", _lower).alias("words"))
    return lowered.select(*keep, F.size("words").alias("n_words"), buckets_of(F.col("words"), ngrams, buckets).alias("buckets"))


def _totals(table: DataFrame) -> dict[int, int]:
    """Features by bucket: no more rows than there are buckets."""
    return {r["b"]: r["n"] for r in table.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """How much likelier a bucket is in the target, in thousandths of a natural logarithm, smoothed by one."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def scores(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    rows = stored(featured(docs, "doc_id", ngrams=ngrams, buckets=buckets), "features")
    gain = F.split(F.lit(",".join(map(str, gains(_totals(rows), _totals(featured(target, ngrams=ngrams, buckets=buckets)), buckets)))), ",").cast("array<bigint>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
    n = F.size("buckets").cast("long")
    summed = rows.select("doc_id", "n_words", n.alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return summed.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, words: int = LEAST_WORDS, ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``rank`` is 1, 2, 3, ... of the documents drawn, else null."""
    spark = docs.sparkSession
    scored = stored(scores(docs, target, ngrams, buckets, seed), "scored")
    fit = F.col("n_words") >= words
    bins = sorted(((r["score"], r["n"]) for r in scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)  # scores are thousandths of logarithms: some ten thousands at most
    most = percent * sum(n for _, n in bins) // 100
    out = ["doc_id", "n_features", "weight", "score"]
    seen, cut = 0, None
    for score, n in bins:
        if seen >= most:
            break
        seen, cut = seen + n, score
    if cut is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    above = fit & (F.col("score") >= cut)
    numbered = stored(scored.where(above).select(*out, F.monotonically_increasing_id().alias("row")), "numbered")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = stored(numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*out, F.monotonically_increasing_id().alias("place")), "placed")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    held = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a range
    offsets, before = {}, 0
    for k, n in held:
        offsets[k], before = before, before + n
    offset = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{k}":{n}' for k, n in offsets.items()) + "}"), "map<string,bigint>"), part.cast("string"))
    rank = offset + within + 1
    drawn = placed.select(*out, F.when(rank <= most, rank).alias("rank"))
    return drawn.unionByName(scored.where(~F.coalesce(above, F.lit(False))).select(*out, F.lit(None).cast("long").alias("rank")))


ORACLE = f"""
WITH {CRC_TABLE.strip()},
texts AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
split AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
each_word AS (SELECT side, row, unnest(words) AS w FROM split),
known AS (SELECT w, ({crc_of("w")} % 10000)::INT AS b FROM (SELECT DISTINCT w FROM each_word), remainders),
counted AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM each_word JOIN known USING (w) GROUP BY b),
sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counted),
gain AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM counted, sums),
weighed AS (SELECT row, sum(g)::BIGINT AS total FROM each_word JOIN known USING (w) JOIN gain USING (b) WHERE side = 'd' GROUP BY row),
doc AS (SELECT doc_id, len(words)::BIGINT AS n_features, CASE WHEN len(words) > 0 THEN floor(total / len(words))::BIGINT ELSE 0 END AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM split LEFT JOIN weighed USING (row) WHERE side = 'd'),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked"""
