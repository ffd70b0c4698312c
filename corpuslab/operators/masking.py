"""Masking the schema-bound words of a question, from supplied score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MENTION_WEIGHT, NOUN_SCORE, KEEP_ABOVE = 0.5, 0.9, 0.65
NEVER_MASKED = ["name", "number"]
MASK = "[Mask]"
WORD = r"[\p{L}\p{N}_]+"
NOUN_TAGS = ["NOUN", "NUM", "PROPN"]
# A sum of fractions differs in its last digits with the order of the rows; scores are
# compared with the limit after rounding.
DIGITS = 12


def question_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def vocabulary(items: DataFrame) -> DataFrame:
    """items: question_id, items (array, tables then columns). One row per item word:
    item_idx, word, token_idx running over all words of the question's items, n_words."""
    words = F.flatten(
        F.transform(
            "items",
            lambda item, i: F.transform(
                question_words(item),
                lambda w: F.struct(i.alias("item_idx"), w.alias("word"), F.size(question_words(item)).alias("n_words")),
            ),
        )
    )
    return items.select("question_id", F.size("items").alias("n_items"), F.posexplode(words).alias("token_idx", "w")).select(
        "question_id", "n_items", "token_idx", "w.*"
    )


def mentions(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(question_id, pos, n): in how many items the token is a word."""
    words = vocab.select("question_id", F.col("word").alias("token"), "item_idx").distinct()
    per_word = words.groupBy("question_id", "token").agg(F.count("*").alias("n"))
    return tokens.select("question_id", "pos", "token").join(per_word.hint("merge"), ["question_id", "token"]).select("question_id", "pos", "n")


def token_scores(tokens: DataFrame, vocab: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """Score per question token.

    tokens: question_id, pos, token, tag;  sensitivity: question_id, pos, token_idx, value.
    Values are scaled by the question's maximum, averaged per item and summed over items,
    half a point is added per item the token is a word of; the mean over items is then
    averaged with the noun score.

    All tables here grow with the questions, and files of few distinct words are far smaller than their rows:
    by their size Spark would broadcast them, so the joins are set to merge.
    """
    high = sensitivity.groupBy("question_id").agg(F.max("value").alias("_high"))
    shape = vocab.where("token_idx IS NOT NULL").groupBy("question_id", "token_idx").agg(F.collect_list("n_words").alias("n"))
    shape = shape.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("token_idx", "n"))).alias("_shape"))
    # All on the question alone, so sensitivities that are dealt by it stay where they are.
    scaled = sensitivity.join(high.join(shape.hint("merge"), "question_id").hint("merge"), "question_id")
    share = F.col("value") / F.when(F.col("_high") == 0, F.lit(1.0)).otherwise(F.col("_high"))
    effect = (
        scaled.select("question_id", "pos", share.alias("_share"), F.explode(F.col("_shape")[F.col("token_idx")]).alias("n_words"))
        .groupBy("question_id", "pos")
        .agg(F.sum(F.col("_share") / F.col("n_words")).alias("_effect"))
    )
    n_items = vocab.select("question_id", "n_items").distinct()
    noun = F.when(F.col("tag").isin(NOUN_TAGS), F.lit(NOUN_SCORE)).otherwise(F.lit(0.0))
    total = F.coalesce("_effect", F.lit(0.0)) + MENTION_WEIGHT * F.coalesce("n", F.lit(0))
    return (
        tokens.join(n_items.hint("merge"), "question_id")
        .join(effect.hint("merge"), ["question_id", "pos"], "left")
        .join(mentions(tokens, vocab).hint("merge"), ["question_id", "pos"], "left")
        .select("question_id", "pos", "token", F.round((total / F.col("n_items") + noun) / 2, DIGITS).alias("score"))
    )


def mask_questions(questions: DataFrame, scores: DataFrame) -> DataFrame:
    """questions: question_id, question. Words scored above the limit become the mask,
    whole words in any case; a question without such words stays as it is."""
    chosen = (
        scores.where((F.col("score") > KEEP_ABOVE) & ~F.col("token").isin(NEVER_MASKED))
        .groupBy("question_id")
        .agg(F.collect_set("token").alias("_masked"))
    )
    parts = F.regexp_extract_all("question", F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}_]+"), F.lit(0))
    masked = F.array_join(
        F.transform(parts, lambda p: F.when(F.array_contains("_masked", F.lower(p)), F.lit(MASK)).otherwise(p)), ""
    )
    return questions.join(chosen.hint("merge"), "question_id", "left").select(
        "question_id", F.when(F.col("_masked").isNull(), F.col("question")).otherwise(masked).alias("skeleton")
    )
