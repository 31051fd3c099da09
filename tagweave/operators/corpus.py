"""Text to id lists as joins: a counted vocabulary, ids by equi-join, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import pad_tokens
from tagweave.operators.ranking import ordered_index
from tagweave.schema import ID

# Ids with a special meaning; words start after them.
PAD, UNKNOWN, BEGIN, END = 0, 1, 2, 3
FIRST_WORD = 4


def words(text) -> Column:
    """Lower-case runs of letters and digits of any script."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def leading_words(text: Column, n: int) -> Column:
    """The first n words, and one more element if the text has more: the splitter stops there and leaves the rest whole."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", n + 2), lambda w: w != "")


def build_vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, token_id) by falling count then token, over the whole texts. Counts are combined map-side."""
    counts = df.select(F.explode(words(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered_index(counts.withColumn("_minus", -F.col("n")), ["_minus", "token"], out="_r")
    return ranked.select("token", "n", (F.col("_r") + FIRST_WORD).cast("int").alias("token_id"))


def encode_corpus(df: DataFrame, vocabulary: DataFrame | None = None, maxlen: int = 72, text: str = "text",
                  prompt_fn=None, tokenizer=None, side: str = "front", id_col: str = ID) -> DataFrame:
    """(id, token_ids): begin mark, words, end mark, cut to `maxlen` and padded.

    `prompt_fn` maps a text Column to a Column (a built-in expression or a pandas UDF); `tokenizer` is a pandas UDF
    text -> ARRAY<INT> used instead of the vocabulary. No word after the first `maxlen` survives the cut, so none is
    looked up.
    """
    source = df.select(id_col, (prompt_fn(F.col(text)) if prompt_fn else F.col(text)).alias("_t"))
    if tokenizer is not None:
        marked = source.select(id_col, tokenizer(F.col("_t")).alias("_ids"))
    else:
        kept = source.select(id_col, leading_words(F.col("_t"), maxlen).alias("_w")).withColumn("_n", F.size("_w"))
        tokens = kept.select(id_col, "_n", F.posexplode_outer(F.slice("_w", 1, maxlen)).alias("pos", "token"))
        entry = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN)).alias("i")))
        found = tokens.join(vocabulary.select("token", "token_id"), "token", "left").groupBy(id_col).agg(
            F.max("_n").alias("_n"), F.sort_array(F.collect_list(entry)).alias("_s"))
        last = F.when(F.col("_n") <= maxlen, F.array(F.lit(END))).otherwise(F.array().cast("array<int>"))
        marked = found.select(id_col, F.concat(F.array(F.lit(BEGIN)), F.col("_s.i"), last).alias("_ids"))
    return marked.select(id_col, pad_tokens("_ids", maxlen, side).alias("token_ids"))
