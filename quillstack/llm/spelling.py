"""Spelling variants: words one edit apart, and the frequent word that a rare one stands for (operator 11).

1. Count the words of the whole corpus.
2. One edit leaves a half of a word as it is. The dictionary sorted forwards is read in blocks of words that share their first
   half, the dictionary sorted backwards in blocks that share their last half. A block compares words of m and of m + 1 letters,
   m being the length of the shorter word of a pair.
3. A block of more than MOST words is subdivided by the same rule: of the letters that its words need not share, an
   edit leaves a half alone, so each word goes on to a block with a longer head and one with a longer tail. A block in which
   one letter is open is never too large: its words of m letters differ in that letter only, so there are as many as the
   alphabet has letters, and those of m + 1 letters at most as many as it has pairs of letters.
4. Words of a block, next to each other after the sort, are verified by edit distance.

A pair may show up in two blocks and is counted once. No block is skipped or cut short, whatever its size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import bound_batches, shared_checkpoint, table
from ._text import returning_memory, utf8

LETTERS = "A-Za-zÀ-ÿ"
#: Words that a block may have before it is subdivided.
MOST = 128
#: One run in so many loses a letter.
SLIP = 199
#: Words that a task counts before it sends them on, and code points from which on the runs of a text are not listed at once.
FLUSH, LONG_TEXT = 1 << 17, 1 << 20
_BLOCK = ["m", "lo", "hi", "head", "tail"]


@returning_memory
def _counted(batches, shortest: int):
    """Counts of words, those of a task added up before they are sent. Runs that are too short for a word are not looked at."""
    run_of = re.compile(f"[{LETTERS}]{{{shortest},}}")
    counts: Counter[str] = Counter()

    def sent():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        data, at = utf8(batch.column("text"))
        for id_, a, b in zip(batch.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            text = data[a:b].tobytes().lower().decode()  # of bytes: A-Z only
            runs = Counter(run_of.findall(text)) if len(text) < LONG_TEXT else Counter(m[0] for m in run_of.finditer(text))
            if id_ is not None:
                prefix = zlib.crc32(f"{id_}:".encode())
                for run in [r for r in runs if zlib.crc32(r.encode(), prefix) % SLIP == 0]:
                    i = zlib.crc32(run.encode(), prefix) % len(run)
                    if len(run) > shortest:
                        counts[run[:i] + run[i + 1 :]] += runs[run]
                    del runs[run]
            counts.update(runs)
            if len(counts) >= FLUSH:
                yield sent()
    if counts:
        yield sent()


def dictionary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n (long): words of at least `shortest` letters that occur at least `least` times.

    A run loses a letter where the crc32 of id and run is divisible by SLIP; one of a row without an id never does.
    """
    bound_batches(df.sparkSession)
    counted = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_counted, shortest=shortest), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds what the words of a block share: the first `lo` and the last `hi` letters."""
    size = F.length("word")
    return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("lo")), "tail": F.substring(F.col("word"), size - F.col("hi") + 1, F.col("hi"))})


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of its open letters added to the head, and with the rest added to the tail."""
    open_ = F.col("m") - F.col("lo") - F.col("hi")
    half = F.floor(open_ / 2).cast("int")
    first = F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"))
    last = F.struct(F.col("lo").alias("lo"), (F.col("hi") + open_ - half).cast("int").alias("hi"))
    cut = rows.select("word", "n", "m", F.explode(F.array(first, last)).alias("cut"))
    return _keyed(cut.select("word", "n", "m", "cut.lo", "cut.hi"))


def _verified(rows: DataFrame) -> DataFrame:
    """Pairs of near words: the merge join scans the sorted words of each block beside each other."""
    short = rows.filter(F.length("word") == F.col("m")).select(*_BLOCK, F.col("word").alias("a"), F.col("n").alias("an"))
    other = rows.select(*_BLOCK, F.col("word").alias("b"), F.col("n").alias("bn"))
    near = ((F.length("b") > F.col("m")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return short.hint("merge").join(other, _BLOCK).filter(near).select("a", "an", "b", "bn")


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """a, an, b, bn: each pair of words one edit apart, once, with their counts. words: distinct word, n."""
    size = F.length("word")
    both = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter("m > 0")
    level = _halves(both.withColumns({"lo": F.lit(0), "hi": F.lit(0)}))
    found = []
    while True:
        members = level.groupBy(*_BLOCK).agg(F.count("*").alias("members"), F.min(F.length("word")).alias("shortest"))
        blocks = shared_checkpoint(level.join(members.filter("members > 1 and shortest = m"), _BLOCK))
        over = (F.col("members") > most) & (F.col("m") - F.col("lo") - F.col("hi") > 1)
        found.append(shared_checkpoint(_verified(blocks.filter(~over))))
        wide = blocks.filter(over)
        if wide.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        level = _halves(wide)


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: from each word along its form to the last one. Steps double, and a form has several times the word's count, so a few
    rounds do."""
    now = shared_checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = shared_checkpoint(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ahead.filter("moved").isEmpty():
            return now
        now = ahead.drop("moved")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, factor: int = 5, most: int = MOST) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long): a row for each word of the dictionary.

    form is the near word of largest n (ties: the first in code-point order) if it has at least `factor` times the word's n, else
    null, form_n its n; root the last word along the forms, the word itself where it has none. Null texts have no
    words, a row counts as often as it is repeated, an empty table gives no rows. Other columns are not read.
    """
    words = shared_checkpoint(dictionary(df, id_col, text_col, shortest, least))
    pairs = near_words(words, most)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    best = F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form")))
    near = shared_checkpoint(both.groupBy(F.col("a").alias("word"), F.col("an").alias("own")).agg(F.count("*").alias("n_near"), best.alias("best")))
    enough = -F.col("best.less") >= factor * F.col("own")
    near = near.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    roots = last_forms(near.filter("form is not null").select("word", "form"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 is linear: the value of a text is that of as many zero bytes, and a term for each byte by its distance from the end.
SQL = """
WITH RECURSIVE byte(b, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM byte WHERE k < 8
), one AS MATERIALIZED (SELECT b, v FROM byte WHERE k = 8),
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), own AS MATERIALIZED (SELECT doc_id, run, count(*) AS n, doc_id || ':' || run AS k FROM run GROUP BY ALL),
far AS (SELECT max(strlen(k)) AS far FROM own),
term(d, b, v) AS (
  SELECT 0, b, v FROM one
  UNION ALL
  SELECT d + 1, term.b, xor(term.v >> 8, one.v) FROM term JOIN one ON one.b = term.v & 255 WHERE d + 1 < (SELECT far FROM far)
), zero(size, v) AS (
  SELECT 0, 4294967295
  UNION ALL
  SELECT size + 1, xor(zero.v >> 8, one.v) FROM zero JOIN one ON one.b = zero.v & 255 WHERE size < (SELECT far FROM far)
), letter AS (SELECT k, strlen(k) AS size, unnest(range(strlen(k))) AS i, hex(encode(k)) AS code FROM own WHERE k IS NOT NULL),
crc AS (
  SELECT k, xor(xor(bit_xor(term.v), any_value(zero.v)), 4294967295) AS h
  FROM letter JOIN term ON term.d = size - 1 - i AND term.b = CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT) JOIN zero USING (size) GROUP BY k
), word AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM own LEFT JOIN crc USING (k) GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6
), cut AS MATERIALIZED (SELECT word, n, unnest(range(length(word))) AS i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM word),
pair AS MATERIALIZED (
  SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT cut.word, word.word FROM cut JOIN word ON word.word = cut.rest
  UNION SELECT word.word, cut.word FROM cut JOIN word ON word.word = cut.rest
), near AS MATERIALIZED (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY y.n DESC, b) AS form, max(y.n) AS form_n, any_value(x.n) AS n
  FROM pair JOIN word x ON x.word = a JOIN word y ON y.word = b GROUP BY a
), form AS MATERIALIZED (SELECT word, form, form_n FROM near WHERE form_n >= 5 * n),
path(word, root) AS (SELECT word, form FROM form UNION ALL SELECT path.word, form.form FROM path JOIN form ON form.word = path.root)
SELECT word.word, form.form, coalesce(path.root, word.word) AS root, word.n, coalesce(near.n_near, 0) AS n_near, form.form_n
FROM word LEFT JOIN near USING (word) LEFT JOIN form USING (word)
LEFT JOIN (SELECT * FROM path WHERE root NOT IN (SELECT word FROM form)) path USING (word)
"""
