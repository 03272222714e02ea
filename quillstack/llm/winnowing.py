"""Document fingerprints by winnowing, in SQL functions only (operator 6).

A text is a sequence of units: a character of a script that is written without spaces between words, else a word (a run without
spaces). Unit hashes w give the rolling (Karp-Rabin) hash of GRAM units, w0 B^4 + w1 B^3 + ... + w4 modulo a
prime; SQL has no running state over an array that stays linear, so all grams get their value at once, from those of 2 and 4
units, and not one from the last. Of every WINDOW consecutive grams the least is chosen, the rightmost on ties, and
kept with its position. Two texts that share GRAM + WINDOW - 1 units in a row share a fingerprint entry, and
nothing shorter than GRAM units is ever matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._tables import table

GRAM, WINDOW = 5, 8
ROWS_A_BUCKET, MOST_BUCKETS = 1000, 1 << 14
_LOW = (1 << 32) - 1
#: Modulus and base of the rolling hash: products of two residues fit into 62 bits.
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
#: Java regex for a unit.
_SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
UNIT = rf"[{_SCRIPTS}]|[^\x20\x09-\x0D{_SCRIPTS}]+"


def _without_first(values: str, n: int) -> Column:
    return F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))


def _first(values: str, other: str, n: int) -> Column:
    """As many leading values as `other` has after its first n."""
    return F.slice(values, 1, F.greatest(F.size(other) - n, F.lit(0)))


def add_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds `name`: array<long> of chosen grams in text order, hash in the upper and position in the lower half.

    A text of 1 to GRAM - 1 units is one gram; fewer grams than WINDOW are one window; a text without units has an
    empty fingerprint. Each step is a column of its own, so that no step is computed twice.
    """
    a, b, c = (f"_{x}_{name}" for x in "abc")
    units = F.regexp_extract_all(F.col(text_col), F.lit(UNIT), F.lit(0))
    df = df.withColumn(a, F.transform(units, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))
    two = pow(BASE, 2, PRIME)
    df = df.withColumn(b, F.zip_with(_first(a, a, 1), _without_first(a, 1), lambda x, y: (x * F.lit(BASE) + y) % F.lit(PRIME)))
    df = df.withColumn(b, F.zip_with(_first(b, b, 2), _without_first(b, 2), lambda x, y: (x * F.lit(two) + y) % F.lit(PRIME)))
    df = df.withColumn(b, F.zip_with(_first(b, a, 4), _without_first(a, 4), lambda x, y: (x * F.lit(BASE) + y) % F.lit(PRIME)))
    few = F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.pmod(F.xxhash64(a), F.lit(PRIME))))
    df = df.withColumn(b, F.when(F.size(a) >= GRAM, F.col(b)).otherwise(few))
    # Smaller is better: the hash first, then the later position.
    df = df.withColumn(c, F.transform(b, lambda x, i: F.shiftleft(x, 32).bitwiseOR(F.lit(_LOW) - i))).drop(a, b)
    least = c
    for step in (1, 2, 4):
        now = f"_{step}_{name}"
        df = df.withColumn(now, F.zip_with(_first(least, least, step), _without_first(least, step), lambda x, y: F.least(x, y)))
        least = now
    short = F.when(F.size(c) == 0, F.col(c)).otherwise(F.array(F.array_min(c)))
    df = df.withColumn(name, F.array_distinct(F.when(F.size(c) >= WINDOW, F.col(least)).otherwise(short)))
    return df.drop(c, "_1_" + name, "_2_" + name, "_4_" + name)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def as_text(fingerprint: Column) -> Column:
    """hash@position of each entry, in text order, joined by one space."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.hex(F.shiftright(x, 32)), F.lit("@"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("string"))), " ")


def likeness(x: Column, y: Column) -> Column:
    """Share of common hashes among all hashes of two fingerprints; two empty ones are alike."""
    both = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_next(df: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """Adds next_<c> for the columns carried: their values in the row after, by descending order, then first again.

    Rows are dealt to ranges of the order column at approximate quantiles, found by a binary search in a
    bounded array; the first row of each range is copied to the range before it, so that no window spans
    all rows. Nulls come last. Rows of equal order follow the hash of the first column
    carried.
    """
    low = -(1 << 63)
    rows = df.withColumns({"_o": F.coalesce(F.col(order).cast("long"), F.lit(low)), "_t": F.xxhash64(carried[0])})
    size = rows.count()
    n = max(1, min(MOST_BUCKETS, size // ROWS_A_BUCKET))
    cuts = rows.agg(F.percentile_approx("_o", [i / n for i in range(1, n)] or [0.5], 20 * n)).head()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array(F.lit(low))

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s.lo + s.hi) / 2).cast("int")
        right = F.get(bounds, middle) < F.col("_o")
        return F.when(s.lo >= s.hi, s).otherwise(F.struct(F.when(right, middle + 1).otherwise(s.lo).alias("lo"), F.when(right, s.hi).otherwise(middle).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts) or 1).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit((len(cuts) + 1).bit_length() + 1))
    rows = rows.withColumn("_b", F.aggregate(steps, start, half).lo)
    tops = rows.groupBy("_b").agg(F.max(F.struct("_o", "_t")).alias("top"))
    ascending = W.orderBy("_b")
    tops = tops.select(F.col("_b").alias("tb"), F.col("top._o").alias("to"), F.col("top._t").alias("tt"), F.coalesce(F.lead("_b").over(ascending), F.min("_b").over(W.partitionBy())).alias("before"))
    # At most MOST_BUCKETS rows.
    copied = rows.join(F.broadcast(tops), (F.col("_b") == F.col("tb")) & (F.col("_o") == F.col("to")) & (F.col("_t") == F.col("tt")), "left")
    places = F.filter(F.array(F.struct(F.col("_b").alias("at"), F.lit(0).alias("copy")), F.struct(F.col("before").alias("at"), F.lit(1).alias("copy"))), lambda x: x["at"].isNotNull())
    placed = copied.withColumn("_p", F.explode(places)).withColumns({"_at": F.col("_p.at"), "_copy": F.col("_p.copy")})
    follow = W.partitionBy("_at").orderBy("_copy", F.desc("_o"), F.desc("_t"))
    placed = placed.select(*df.columns, "_at", "_copy", "_o", "_t").withColumns({f"next_{c}": F.lead(c).over(follow) for c in carried})
    return placed.filter("_copy = 0").select(*df.columns, *(f"next_{c}" for c in carried))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited forms, and how alike they are to that and to the next document.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next
    document, by descending id (after the last the first). Null texts count as empty. Rows without an id come
    last. Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = add_fingerprint(rows, "text", "own")
    rows = with_next(rows, "id", ["text", "own"])
    n = F.length("text").cast("long")
    cut = F.floor(n / 3)
    rows = rows.withColumns({"n_chars": n, "edited": F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("next_text", F.lit(1), cut.cast("int")))}).drop("text", "next_text")
    rows = add_fingerprint(rows, "edited", "changed")
    rows = rows.withColumns({"h": hashes(F.col("own")), "e": hashes(F.col("changed")), "x": hashes(F.col("next_own"))})
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("e")).alias("near_edited"),
        likeness(F.col("h"), F.col("x")).alias("near_next"),
    )


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
