"""Fill-in-the-middle rearrangement of texts, cut at whole units such as lines.

``regexp_count`` gives a text's number of units, and two hashes of its id choose where prefix and middle end.  One
pattern for each row, with the possessive groups ``unit{a}`` and ``unit{b-a}``, captures prefix, middle and suffix in
one match whose replacement is the rearranged text.  Possessive counted groups are matched in a loop, so texts of any
number of units need neither a deep stack nor backtracking.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, stays as it is (form ``plain``);
a row without id is hashed like an empty id; rows that repeat an id are cut at the same places if their texts do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line with its line feed, or the rest of the text.
LINE = r"[^\n]*\n|[^\n]+"


def draws(key: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def rearranged(
    df: DataFrame,
    keep: list[str],
    seed: int = 7,
    share: int = 100,
    spm: int = 50,
    unit: str = LINE,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Columns ``keep``, then ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (null
    where plain) and ``output``.

    ``share`` of a hundred texts are rearranged, ``spm`` of a hundred of these with the suffix first.  ``unit`` is a
    pattern that never matches the empty string and whose matches leave nothing out.
    """
    kept = [F.col(c).alias(f"_{i}_keep") for i, c in enumerate(keep)]
    hashes = [h.alias(f"_h{i}") for i, h in enumerate(draws(key, seed))]
    rows = df.select(*kept, *hashes, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_n", F.regexp_count("_text", F.lit(unit)).cast("bigint"))
    ends = [F.pmod(f"_h{i}", F.col("_n") + 1) for i in (0, 1)]
    marked = [F.col("_text").contains(s) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("_text") == "") | marked[0] | marked[1] | marked[2] | (F.col("_h2") % 100 >= share)
    form = F.when(plain, "plain").when(F.col("_h3") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("*", F.least(*ends).alias("_a"), F.greatest(*ends).alias("_b"), form.alias("_form"))

    def group(count: Column) -> Column:
        return F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)"))

    pattern = F.concat(F.lit(r"(?s)\A"), group(F.col("_a")), group(F.col("_b") - F.col("_a")), F.lit(r"(.*)\z"))
    order = F.when(F.col("_form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(
        f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"
    )
    moved = F.regexp_replace("_text", pattern, order)
    rows = rows.withColumn("_output", F.when(F.col("_form") == "plain", F.col("_text")).otherwise(moved))
    # the sentinels of the output occur once, so their places give the lengths
    at = {s: F.instr("_output", s) for s in (PREFIX, SUFFIX, MIDDLE)}
    after = F.when(F.col("_form") == "spm", at[MIDDLE]).otherwise(at[SUFFIX])
    moved = F.col("_form") != "plain"
    return rows.select(
        *(F.col(f"_{i}_keep").alias(c) for i, c in enumerate(keep)),
        F.col("_n").alias("n"),
        F.col("_form").alias("form"),
        F.when(moved, after - at[PREFIX] - len(PREFIX)).cast("bigint").alias("prefix_chars"),
        F.when(moved, F.length("_output") - at[MIDDLE] - len(MIDDLE) + 1).cast("bigint").alias("middle_chars"),
        F.col("_output").alias("output"),
    )


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that ``output`` was made of."""
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\z"), F.lit("$2$3$1"))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
