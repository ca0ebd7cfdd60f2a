"""Texts cut off by field limits or in transfer, and how often each source cuts.

The corpus gives a vocabulary trie: every word that stands before other text, and every prefix of such words with the number of
occurrences below it, kept as a table (prefix, mass) that is joined only to the final tokens in question. A final token that is
(almost) never a word of its own but a proper prefix of known words is a cut word. For whole final words the corpus tells how
often a sentence ends after them. Lengths at which a source shows a spike of different texts are its limits; a text of such a
length needs less other evidence.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlode.core import stage, trimmed

TOKEN = r"(?:--?)?[\p{L}\p{N}]+(?:['’_.\-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
#: Fixed patterns: marks that say the rest was left out, full stops, and marks after which a text must go on.
LEFT_OUT = r"(?:\.{2,}|…|\x{FFFD}|[\[(<]\s*(?:\.{2,}|…|more|cut|truncated|continued|cont\.?)\s*[\])>]|\b(?:read|show) more)\s*$"
FULL_STOP = r"[.!?。！？]['\"”’»)\]]*$"
DANGLING = r"[,;:(\[{“‘«–—→/&+=\-]$"
WORD_END = r"[\p{L}\p{N}]$"


def _limits(texts: DataFrame, chance: float, factor: float) -> DataFrame:
    """Lengths (source, unit, size) of a source, in letters or bytes, at which factor times as many different texts lie as around it.

    So many must also be unlikely (at most chance, by the Chernoff bound of a Poisson count) at the mean of the lengths around it.
    """
    sizes = F.explode(F.array(*(F.struct(F.lit(unit).alias("unit"), F.col(unit).alias("size")) for unit in ("letters", "bytes"))))
    by_size = texts.select("source", sizes.alias("s")).select("source", "s.*").groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-6, 6)
    around = (F.sum("n").over(w) - F.col("n") + 1) / 12  # one text more, so that a length without neighbours has a mean too
    surprise = F.col("n") * F.log(F.col("n") / F.col("around")) - F.col("n") + F.col("around")
    return by_size.withColumn("around", around).where((F.col("n") >= factor * F.col("around")) & (surprise >= -math.log(chance))).select("source", "unit", "size")


def truncated(
    records: DataFrame, row_id: str, text: str, source: str, rare: float = 0.004, least_mass: int = 4, ends_at_limit: float = 0.5, ends_elsewhere: float = 0.002, spike: float = 1e-6, spike_factor: float = 4.0, cut_words: float = 0.2,
    shared: int = 3,
) -> DataFrame:
    """One row per record: row_id, source, cut, reason in mark, dangling, word, sentence, null where not cut.

    rare: a final token with at most this share of the occurrences of longer words that begin with it is a fragment, if those are
    at least least_mass. ends_at_limit, ends_elsewhere: a final word after which sentences end with a smaller probability is inside
    a sentence, for texts at a limit of their source and for others. spike, spike_factor: a length is a spike where so many texts have
    at most this probability beside the lengths around it, and are this many times as many. cut_words: the share of cut words that
    makes a spike a limit. shared: a text that so many sources state alike, away from their limits, is a phrase of its own, as cuts
    do not agree. Null, blank and stand-in texts (without any letter or digit) are not cut. A text is judged the same wherever it is repeated in a source, rows with a null id or source are judged too.
    """
    state = (
        F.when(F.col("t").isNull() | ~F.col("t").rlike(r"[\p{L}\p{N}]"), "none").when(F.lower("t").rlike(LEFT_OUT), "mark").when(F.col("t").rlike(FULL_STOP), "whole")
        .when(F.col("t").rlike(DANGLING) & F.col("t").rlike(r"\s"), "dangling").when(F.col("t").rlike(WORD_END), "open").otherwise("whole")
    )
    rows = stage(
        records.select(F.col(row_id).alias("row_id"), F.col(source).alias("source"), F.col(text).alias("text")).withColumn("t", trimmed(F.col("text")))
        .select("row_id", "source", "t", state.alias("state"), F.length("text").alias("letters"), F.octet_length("text").alias("bytes"))
    )
    # Each text counts once a source, however often it is delivered. Its tokens are found once.
    once = rows.where("state <> 'none'").groupBy("source", "t").agg(F.first("state").alias("state"), F.min("letters").alias("letters"), F.min("bytes").alias("bytes"))
    texts = stage(once.withColumn("pattern", F.lit(TOKEN)).withColumn("tokens", F.expr("regexp_extract_all(lower(t), pattern, 0)")).drop("pattern"))
    at_limit = stage(_limits(texts, spike, spike_factor))
    sizes = [at_limit.where(F.col("unit") == unit).select(F.col("source").alias("_s"), F.col("size").alias("_n"), F.lit(True).alias(f"_{unit}")) for unit in ("letters", "bytes")]

    def placed(df: DataFrame) -> DataFrame:
        """df with at_limit: whether the text has a length at which its source has a spike."""
        for unit, table in zip(("letters", "bytes"), sizes):
            df = df.join(table, F.expr(f"source <=> _s and {unit} = _n"), "left").drop("_s", "_n")
        return df.withColumn("at_limit", F.coalesce("_letters", "_bytes", F.lit(False))).drop("_letters", "_bytes")

    # Each token with the two before it, and whether a sentence ends there: 1 yes, 0 no, null where the text stops without a stop.
    step = F.expr(
        "transform(sequence(1, size(tokens)), i -> struct(get(tokens, i - 3) as u, get(tokens, i - 2) as v, tokens[i - 1] as w,"
        " case when i < size(tokens) then int(tokens[i] in ('.', '!', '?', '。', '！', '？')) end as stops))"
    )
    words = texts.select(F.explode(step).alias("s")).select("s.*")
    grams = stage(
        words.where(r"w rlike '[\\p{L}\\p{N}]'").withColumn("u", F.coalesce("u", F.lit("^"))).withColumn("v", F.coalesce("v", F.lit("^")))
        .groupBy("u", "v", "w").agg(F.sum(F.when(F.col("stops") == 1, 1).otherwise(0)).alias("e3"), F.sum(F.when(F.col("stops") == 0, 1).otherwise(0)).alias("i3"))
    )
    two = stage(grams.groupBy("v", "w").agg(F.sum("e3").alias("e2"), F.sum("i3").alias("i2")))
    one = stage(two.groupBy("w").agg(F.sum("e2").alias("e1"), F.sum("i2").alias("i1")))
    last = texts.where("state = 'open'").select("source", "t", "letters", "bytes", F.expr("coalesce(get(tokens, size(tokens) - 3), '^')").alias("u"), F.expr("coalesce(get(tokens, size(tokens) - 2), '^')").alias("v"), F.expr("tokens[size(tokens) - 1]").alias("w"))
    last = stage(placed(last).drop("letters", "bytes"))
    # Texts that stop without a stop and away from a limit count half as ends, each once a source and never for themselves.
    opens = last.groupBy("u", "v", "w").agg(F.sum(F.expr("int(not at_limit)")).alias("o3"))
    kinds = stage(opens)
    pairs = kinds.groupBy("v", "w").agg(F.sum("o3").alias("o2"))
    asked = stage(pairs.groupBy("w").agg(F.sum("o2").alias("o1")))
    # The trie below the tokens in question: occurrences of longer words, alone and after the same word.
    prefixes = F.expr("transform(sequence(1, length(w) - 1), i -> left(w, i))")
    longer = "length(w) > 1"
    trie1 = one.where(longer).select((F.col("e1") + F.col("i1")).alias("n"), F.explode(prefixes).alias("w")).join(asked.select("w"), "w", "left_semi").groupBy("w").agg(F.sum("n").alias("mass1"))
    trie2 = two.where(longer).select("v", (F.col("e2") + F.col("i2")).alias("n"), F.explode(prefixes).alias("w")).join(pairs.select("v", "w"), ["v", "w"], "left_semi").groupBy("v", "w").agg(F.sum("n").alias("mass2"))

    def chance(others: str, weight: str):
        o1, o2, o3 = (f"0.5D * greatest(o{k} - {others}, 0)" for k in (1, 2, 3))
        p1 = f"(e1 + {o1} + 0.05D) / (e1 + i1 + {o1} + 1D)"
        p2 = f"(e2 + {o2} + {weight} * {p1}) / (e2 + i2 + {o2} + {weight})"
        return F.expr(f"(e3 + {o3} + {weight} * {p2}) / (e3 + i3 + {o3} + {weight})")

    # What is known of a word, of a word after another, and of the three together is put together level by level.
    of_word = asked.join(one, "w", "left").join(trie1, "w", "left")
    of_pair = pairs.join(two, ["v", "w"], "left").join(trie2, ["v", "w"], "left").join(of_word, "w")
    verdict = (
        kinds.join(grams, ["u", "v", "w"], "left").join(of_pair, ["v", "w"]).na.fill(0)
        .withColumn("p_limit", chance("0", "2D")).withColumn("p_else", chance("1", "20D"))
        .withColumn("fragment", F.expr(f"(mass1 >= {least_mass} and e1 + i1 <= {rare}D * mass1) or (mass2 >= {least_mass} and e2 + i2 + greatest(o2 - 1, 0) <= {rare}D * mass2 and e1 + i1 <= 10 * mass2)"))
    )
    judged = stage(last.join(verdict.select("u", "v", "w", "p_limit", "p_else", "fragment"), ["u", "v", "w"]).select("source", "t", "at_limit", "p_limit", "p_else", "fragment"))
    # A spike is a limit only where many of its texts end inside words; texts of one make may share a length without being cut.
    sure = judged.where("at_limit").groupBy(F.col("source").alias("limiting")).agg(F.avg(F.col("fragment").cast("double")).alias("f")).where(F.col("f") >= cut_words)
    phrases = judged.groupBy("t").agg(F.count("*").alias("n"), F.max("at_limit").alias("any")).where((F.col("n") >= shared) & ~F.col("any")).select(F.col("t").alias("_p"))
    ended = judged.join(F.broadcast(sure), F.expr("source <=> limiting"), "left").withColumn("at_limit", F.col("at_limit") & F.col("f").isNotNull()).join(phrases, F.expr("t = _p"), "left").select(
        F.col("source").alias("_s"), F.col("t").alias("_t"),
        F.when(F.col("_p").isNotNull(), None).when(F.col("fragment"), "word").when(F.when(F.col("at_limit"), F.col("p_limit") < ends_at_limit).otherwise(F.col("p_else") < ends_elsewhere), "sentence").alias("open_reason"))
    found = rows.join(ended, F.expr("state = 'open' and source <=> _s and t = _t"), "left").withColumn("reason", F.when(F.col("state").isin("mark", "dangling"), F.col("state")).otherwise(F.col("open_reason")))
    return found.select("row_id", "source", F.col("reason").isNotNull().alias("cut"), "reason")


def truncation_report(records: DataFrame, row_id: str, text: str, source: str) -> DataFrame:
    """Per source: rows, cut rows and their share, by reason; a null source is reported as one."""
    found = truncated(records, row_id, text, source)
    return found.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"),
        *(F.sum(F.when(F.col("reason") == r, 1).otherwise(0)).alias(f"n_{r}") for r in ("mark", "dangling", "word", "sentence")))
