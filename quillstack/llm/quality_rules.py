"""Quality rules with risk-controlled thresholds (operator 7).

Every rule compares one measure of a text with a cutoff. Labelled documents are halved by a hash of their id. On one
half, the steps (a rule with one of its cutoffs) that reject more bad documents than PRICE times the good ones are put in
order, the most precise first: one nested sequence of settings for each length stratum, each of them all steps so far together.
On the other half, the holdout, the settings are tested in that order: a test passes if the exact binomial bound says
that the setting rejects at most RISK of good documents, at a level of LEVEL / strata (Bonferroni over the strata; inside
a stratum the first failure ends the sequence, so each test has the whole level). So with probability 1 - LEVEL no
stratum loses more than RISK of its good documents to the rules. 39 good holdout documents, none of them rejected, certify a step.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import bound_batches, shared_checkpoint, table
from ._text import BYTE_SYMBOL, IS_SPACE, Rolling, chunks, returning_memory, utf8, word_bounds

REPEAT_WORDS, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
RISK, LEVEL, PRICE = 0.1, 0.05, 10
#: Upper ends of the strata, in words.
STRATA = (100, 400)
#: Measure and cutoffs, lenient first; a text goes if the measure is above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15),
    "repeat_share": (0.28, 0.25, 0.2, 0.15, 0.1, 0.05),
    "dup_line_share": (0.8, 0.65, 0.5, 0.4, 0.3, 0.2, 0.1),
    "marks_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25),
    "echo_share": (0.8, 0.65, 0.5, 0.4, 0.3, 0.2),
    "upper_share": (0.9, 0.75, 0.6, 0.45, 0.3, 0.2),
    "chars_per_word": (20.0, 16.0, 14.0, 12.0, 10.0, 9.0),
}
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_echo")


def _repeated(hashes: np.ndarray, k: int) -> int:
    """Words in k-word windows found twice or more."""
    if len(hashes) <= k:
        return 0
    gram = Rolling(hashes).grams(k)
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    again = np.zeros(len(gram), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, dtype=np.int64)
    step[: len(gram)] += again
    step[k : k + len(gram)] -= again
    return int((np.cumsum(step[:-1]) > 0).sum())


def _dup_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.translate(None, b" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def counts(text: pa.Array) -> np.ndarray:
    """_COUNTS of each text, a column each."""
    data, at = utf8(text)
    out = np.zeros((len(at) - 1, len(_COUNTS)), dtype=np.int64)
    for first, last in chunks(at):
        part, own = data[at[first] : at[last]], at[first : last + 1] - at[first]
        start, end = word_bounds(part, own)
        hashes = Rolling(BYTE_SYMBOL[part]).slices(start, end) + (end - start).astype(np.uint64)
        word_at = np.searchsorted(start, own)

        def sums(flags: np.ndarray, own: np.ndarray = own) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flags)))
            return total[own[1:]] - total[own[:-1]]

        rows = out[first:last]
        rows[:, 0] = np.diff(word_at)
        rows[:, 1] = sums(~IS_SPACE[part] & ((part & 0xC0) != 0x80))
        rows[:, 2] = sums(_SYMBOL[part])
        rows[:, 6] = sums(part == ord("!"))
        rows[:, 7] = sums((part >= 65) & (part <= 90))
        echo = np.zeros(len(hashes) + 1, dtype=np.int64)
        echo[2:] = np.cumsum(hashes[1:] == hashes[:-1]) if len(hashes) else 0
        # An echo across a document's edge is the one counted at its first word.
        rows[:, 8] = echo[word_at[1:]] - echo[np.minimum(word_at[:-1] + 1, word_at[1:])]
        raw = part.tobytes()
        for d in range(last - first):
            rows[d, 5], rows[d, 3] = _dup_lines(raw[own[d] : own[d + 1]])
            rows[d, 4] = _repeated(hashes[word_at[d] : word_at[d + 1]], REPEAT_WORDS)
    return out


@returning_memory
def _counted(batches, text: int, keep: int):
    for batch in batches:
        lists = [pa.array(c) for c in counts(batch.column(text)).T]
        q = pa.StructArray.from_arrays(lists, names=list(_COUNTS))
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], q], names=[*batch.schema.names[:keep], "q"])


def with_counts(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and q, a struct of counts; one pass over the texts."""
    bound_batches(df.sparkSession)
    names = keep if text_col in keep else [*keep, text_col]
    rows = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[: len(keep)])]
    kind = ", ".join(f"{c}: bigint" for c in _COUNTS)
    found = rows.mapInArrow(partial(_counted, text=names.index(text_col), keep=len(keep)), ", ".join([*kinds, f"q struct<{kind}>"]))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "q")


def measures(q: Column) -> dict[str, Column]:
    words, chars, lines = (F.greatest(q[c], F.lit(1).cast("long")) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "symbols_per_word": q.n_symbols / words,
        "repeat_share": q.n_repeat_words / words,
        "dup_line_share": q.n_dup_lines / lines,
        "marks_per_word": q.n_marks / words,
        "echo_share": q.n_echo / words,
        "upper_share": q.n_upper / chars,
        "chars_per_word": q.word_chars / words,
    }


def base_failed(q: Column) -> Column:
    return (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_REPEAT_PERCENT * q.n_words)


def stratum(q: Column) -> Column:
    return sum(((q.n_words >= n).cast("int") for n in STRATA), F.lit(0))


def tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) at rate p: the exact binomial p-value of "the rate is p or more"."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return math.exp(top) * sum(math.exp(x - top) for x in logs)


def fit_cutoffs(labelled: DataFrame) -> dict[tuple[int, str], float]:
    """Certified cutoffs by (stratum, rule) from (id, quality, q: counts). Rules without one are left out.

    Counting is two aggregates over all labelled rows; a row a stratum and half, then a row a stratum and step come to the driver.
    """
    rows = labelled.filter(~base_failed(F.col("q"))).select("quality", "q", stratum(F.col("q")).alias("stratum"), (F.pmod(F.xxhash64(F.lit("holdout"), "id"), F.lit(2)) == 1).alias("holdout"))
    good = F.col("quality") == 1
    m = measures(F.col("q"))
    sums = [F.count_if(good).alias("good")]
    for rule, cuts in RULES.items():
        for i, c in enumerate(cuts):
            sums += [F.count_if(good & (m[rule] > c)).alias(f"{rule}_{i}_good"), F.count_if(~good & (m[rule] > c)).alias(f"{rule}_{i}_bad")]
    proposed = {}
    for r in rows.filter("not holdout").groupBy("stratum").agg(*sums).collect():
        steps = [(r[f"{rule}_{i}_bad"], r[f"{rule}_{i}_good"], rule, c) for rule, cuts in RULES.items() for i, c in enumerate(cuts)]
        steps = [x for x in steps if x[0] > PRICE * x[1]]
        proposed[r.stratum] = sorted(steps, key=lambda x: (-x[0] / (x[1] + 1), x[1], x[2], -x[3]))
    if not any(proposed.values()):
        return {}
    # The first step that rejects a document; a setting of t steps rejects those with a place below t.
    place = F.lit(None).cast("int")
    for s, steps in proposed.items():
        hits = [F.when(m[rule] > c, F.lit(i)) for i, (_, _, rule, c) in enumerate(steps)]
        place = F.when(F.col("stratum") == s, F.array_min(F.array(*hits)) if hits else F.lit(None).cast("int")).otherwise(place)
    tested: dict[int, dict] = {}
    for r in rows.filter(F.col("holdout") & good).groupBy("stratum", place.alias("place")).agg(F.count("*").alias("n")).collect():
        tested.setdefault(r.stratum, {})[r.place] = r.n
    found = {}
    for s, steps in proposed.items():
        n, rejected = sum(tested.get(s, {}).values()), 0
        for i, (_, _, rule, c) in enumerate(steps):
            rejected += tested.get(s, {}).get(i, 0)
            if not n or tail(rejected, n, RISK) > LEVEL / (len(STRATA) + 1):
                break
            found[s, rule] = min(c, found.get((s, rule), c))
    return found


def cutoffs_for(measured: DataFrame, labels: DataFrame, id_col: str) -> dict[tuple[int, str], float]:
    """Cutoffs from (id_col, q) and labels; of several labels of an id the least counts, null ones are passed over."""
    truth = labels.filter(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"))
    return fit_cutoffs(shared_checkpoint(measured.select(F.col(id_col).alias("id"), "q").join(truth, "id")))


def verdicts(counted: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """Adds base_failed and kept to rows with q."""
    q, m = F.col("q"), measures(F.col("q"))
    rejected = reduce(lambda a, b: a | b, ((stratum(q) == s) & (m[rule] > c) for (s, rule), c in cutoffs.items()), F.lit(False))
    return counted.withColumn("base_failed", base_failed(q)).withColumn("kept", ~F.col("base_failed") & ~rejected)


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with q (struct of counts), base_failed and kept added, other columns of these names replaced.

    labels has the id and quality (1 good, 0 bad). Null and empty texts have no words and fail the base rule. With too few
    labels no cutoff is certified and the base rule alone decides. Texts are read twice: once for the counts of labelled
    documents, once for the rows that are returned; `judged_counts` reads them once.
    """
    cutoffs = cutoffs_for(with_counts(df, text_col, [id_col]), labels, id_col)
    return verdicts(with_counts(df, text_col, [c for c in df.columns if c not in ("q", "base_failed", "kept")]), cutoffs)


def judged_counts(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, q, base_failed, kept) of every row of df, from one pass over the texts."""
    measured = shared_checkpoint(with_counts(df, text_col, [id_col]))
    return verdicts(measured, cutoffs_for(measured, labels, id_col))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judged_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *(f"q.{c}" for c in _COUNTS[:5]), "base_failed", "kept")
