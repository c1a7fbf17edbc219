"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; a policy is a mask over those bits, so a new policy version or an
ablation never reads the texts again. Everything is a narrow projection of a row: no
shuffle, no Python, and nothing that grows with the table is held anywhere.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from raterkit.llm.common import BLANK, ROW, packed, unpacked, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rule name -> condition under which a document fails; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
}
BASE_RULES = ("few_words", "repeated_words")
#: Policy version -> rules it applies. Versions are only ever added.
POLICIES: dict[int, tuple[str, ...]] = {
    1: BASE_RULES,
    2: ("few_words", "repeated_words", "word_length", "symbols", "repeated_lines"),
}
CURRENT = 2


def mask_of(names: tuple[str, ...], rules: Mapping[str, str] = RULES) -> int:
    """The bits of the named rules."""
    order = list(rules)
    return sum(1 << order.index(name) for name in names)


def measure(texts: DataFrame, text: Column, carry: list[Column]) -> DataFrame:
    """``carry`` and the measurements of each text, all exact and over the whole text.

    ``n_repeat_words`` counts the words inside a window of three words that occurs at
    least twice in the text. Windows are compared as strings. Only texts with a repeated
    window pay for sorting them.
    """
    kept = [c for c in texts.select(*carry).columns]
    base = texts.select(*carry, F.coalesce(text, F.lit("")).alias("t"))
    words = base.select(
        *kept,
        words_of(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("t", BLANK + "+", "")).cast("bigint").alias("word_chars"),
    )
    none = F.array().cast("array<string>")
    windows = words.select(
        *kept,
        "n_symbols",
        "word_chars",
        F.size("w").cast("bigint").alias("n_words"),
        F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            F.size("w") >= WINDOW,
            F.transform(
                F.slice("w", F.lit(1), F.size("w") - (WINDOW - 1)),
                lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)),
            ),
        ).otherwise(none).alias("g"),
    )
    empty = F.array().cast("array<struct<g:string,i:int>>")
    ranked = windows.withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("g")) < F.size("g"),
            F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i")))),
        ).otherwise(empty),
    ).drop("g")
    twice = ranked.withColumn(
        "p",
        F.sort_array(
            F.transform(
                F.filter(
                    "s",
                    lambda x, i: F.coalesce(F.get("s", i - 1)["g"] == x["g"], F.lit(False))
                    | F.coalesce(F.get("s", i + 1)["g"] == x["g"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    ).drop("s")
    covered = F.transform(
        "p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW)))
    )
    return twice.withColumn(
        "n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("bigint")
    ).drop("p")


def failure_bits(rules: Mapping[str, str] = RULES) -> Column:
    """One bit per failed rule, from the measurement columns."""
    bits = [F.expr(f"IF({test}, {1 << i}L, 0L)") for i, test in enumerate(rules.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, measurements, ``failed`` bits of all rules.

    Null, empty and blank texts have no words and fail ``few_words``; a null key and
    repeated rows are kept as they are; other columns are not read.
    """
    return measure(docs, F.col(text), [F.col(key)]).withColumn("failed", failure_bits())


def apply_policy(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """Ledger entries with ``base_failed``, ``kept`` and ``policy``, from the bits alone."""
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE_RULES)))
    applied = F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version]) | mask_of(BASE_RULES)))
    return entries.select(
        "*", (base != 0).alias("base_failed"), (applied == 0).alias("kept"), F.lit(version).alias("policy")
    )


def ablations(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of the policy: how many fail it, fail it alone, and are kept without it.

    Entries are first counted per bit pattern, of which there are at most 2 ** rules.
    """
    names = POLICIES[version]
    mask = mask_of(names)
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(mask_of((n,))).alias("bit")) for n in names)))
    bit = F.col("r.bit")
    add = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    return (
        patterns.select("m", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            add(F.col("m").bitwiseAND(bit) != 0)("n_failed"),
            add(F.col("m") == bit)("n_failed_alone"),
            add(F.col("m").bitwiseAND(F.bitwise_not(bit)) == 0)("n_kept_without"),
        )
    )


def keep_good(docs: DataFrame, version: int = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, all their columns unchanged."""
    judged = measure(packed(docs), F.col(f"{ROW}.`{text}`"), [F.col(ROW)])
    # a filter on the bits would be pushed down and repeat every measurement it mentions;
    # one on a generated column stays above them
    bits = judged.select(ROW, F.explode(F.array(failure_bits())).alias("failed"))
    return unpacked(apply_policy(bits, version).filter("kept"), docs)
