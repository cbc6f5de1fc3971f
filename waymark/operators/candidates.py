"""Candidate streets of parsed queries: exact names, typos, and parts of names.

The input is a table of splits: key columns, ``c`` (words that name the commune), ``phrase`` (the street's words) and
``commune_phrase`` (null for c = 0).  The output has a row for each key and street, with the features that hold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from waymark.functions import words
from waymark.functions.rules import Rules
from waymark.operators.gazetteer import WORD_CAP, Gazetteer
from waymark.operators.places import lookup_communes
from waymark.runtime import materialize, spread

MANY = 300
TYPOS = 400
PARTS = 200
SINGLE_WORD = 8
FLAGS = ("street_exact", "street_fuzzy", "commune_exact", "commune_prefix")


def with_communes(splits: DataFrame, gaz: Gazetteer, rules: Rules = words.RULES) -> DataFrame:
    """Splits with a commune phrase, a row for each commune it stands for (code, exact)."""
    named = splits.where("c > 0")
    found = lookup_communes(named.select(F.col("commune_phrase").alias("phrase")), gaz, rules)
    return named.join(found.withColumnRenamed("phrase", "commune_phrase"), "commune_phrase")


def _feature_columns(exact_name: bool, commune) -> list:
    on = F.lit(True)
    off = F.lit(False)
    return [
        (on if exact_name else off).alias("street_exact"), (off if exact_name else on).alias("street_fuzzy"),
        (commune if commune is not None else off).alias("commune_exact"), (~commune if commune is not None else off).alias("commune_prefix"),
    ]


def merged(cands: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key and street; features that hold in any row hold."""
    return cands.groupBy(*keys, "street_norm", "code").agg(*[F.bool_or(f).alias(f) for f in FLAGS])


def variants(phrases: DataFrame, rules: Rules = words.RULES, wide: bool = False) -> DataFrame:
    """phrase, variant for each distinct phrase."""

    @F.pandas_udf("array<string>")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda p: list(dict.fromkeys(words.wider_phrases(p, rules) if wide else words.phrases_of(p, rules))))

    return phrases.select("phrase").distinct().select("phrase", F.explode(of("phrase")).alias("variant"))


def exact(splits: DataFrame, keys: list[str], gaz: Gazetteer, rules: Rules = words.RULES) -> DataFrame:
    """Streets whose name is a variant of the phrase: in the named commune, or anywhere (the first MANY, by code)."""
    streets = gaz.streets.select("street_norm", "code", "pc_num")
    known = with_communes(splits, gaz, rules)
    known = known.join(variants(known, rules, wide=True), "phrase")
    known = known.join(streets.drop("pc_num"), [known["variant"] == streets["street_norm"], known["code"] == streets["code"]])
    known = known.select(*keys, "street_norm", streets["code"], *_feature_columns(True, F.col("exact")))
    free = splits.where("c = 0")
    free = free.join(variants(free, rules), "phrase").join(streets, F.col("variant") == F.col("street_norm"))
    free = free.where(F.col("query_pc").isNull() | (F.col("pc_num") == 0) | (F.floor(F.col("pc_num") / 1000) == F.floor(F.col("query_pc") / 1000)))
    order = W.partitionBy(*keys, "variant").orderBy("code")
    free = free.withColumn("_w_n", F.row_number().over(order)).where(F.col("_w_n") <= MANY).select(*keys, "street_norm", "code", *_feature_columns(True, None))
    return merged(known.unionByName(free), keys)


def deletions(word: str) -> list[str]:
    """The word and what is left of it without one letter: words within one edit share one of these."""
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]))


def word_neighbours(left: DataFrame, right: DataFrame) -> DataFrame:
    """word, other: distinct words of both sides that may be within one edit or swap, by shared deletions."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(deletions)

    side = lambda df, name: df.select("word").distinct().select(F.col("word").alias(name), F.explode(cut("word")).alias("_w_key"))
    return side(left, "word").join(side(right, "other"), "_w_key").select("word", "other").distinct()


def may_be_typo(phrase, name):
    """Needed for two edits or fewer between the phrase and the name or a beginning of it: of three pieces of the phrase one is whole in the name."""
    third = F.floor(F.length(phrase) / 3).cast("int")
    whole = lambda start, size: name.contains(F.substring(phrase, start, size))
    return (F.length(name) >= F.length(phrase) - 2) & (whole(F.lit(1), third) | whole(third + 1, third) | whole(2 * third + 1, F.length(phrase)))


def typos(splits: DataFrame, keys: list[str], gaz: Gazetteer, rules: Rules = words.RULES) -> DataFrame:
    """Streets whose name is within an edit of the phrase, or begins with it within one or two edits.

    Names are found by their words: a name shares, within one edit, a content word of the phrase (any word if it has
    none).  For each key the shortest commune split that finds anything counts, after what is found without a commune.
    """
    n = F.length("phrase")
    usable = splits.where(n >= 5).withColumn("most", F.when(n <= 11, 1).otherwise(2))
    # read several times below
    known = materialize(with_communes(usable, gaz, rules), "typos-known")
    rows = known.select(*keys, "c", "phrase", "most", "query_pc", "code", "exact").unionByName(
        usable.where("c = 0").select(*keys, "c", "phrase", "most", "query_pc", F.lit(None).cast("string").alias("code"), F.lit(False).alias("exact"))
    )
    affixes = [*rules.types_cyrillic, *rules.types_latin, *rules.types_extra, *rules.affix_extra]
    every = F.filter(F.split("phrase", " "), lambda w: w != "")
    content = F.filter(every, lambda w: (F.length(w) >= 3) & ~w.isin(affixes))
    phrases = materialize(rows.select("phrase").distinct().withColumn("content", content), "typos-phrases")
    asked = phrases.select("phrase", F.explode(F.when(F.size("content") > 0, F.col("content")).otherwise(every)).alias("word"))
    named = gaz.streets.select("street_norm").distinct().select("street_norm", F.explode(F.array_distinct(F.split("street_norm", " "))).alias("word"))
    near = spread(asked.join(materialize(word_neighbours(asked, named), "typos-words"), "word"), "phrase")  # each row meets all names with its word
    names = near.join(named.withColumnRenamed("word", "other"), "other").where(may_be_typo(F.col("phrase"), F.col("street_norm")))
    names = names.withColumn("close", F.levenshtein("word", "other") <= 1).groupBy("phrase", "street_norm").agg(F.bool_or("close").alias("close"))
    names = names.join(phrases, "phrase")
    size, own = F.length("phrase"), F.length("street_norm")
    edits = F.levenshtein("phrase", "street_norm")
    swapped = F.exists(
        F.sequence(F.lit(1), size - 1),
        lambda i: F.concat(
            F.substring("phrase", F.lit(1), i - 1), F.substring("phrase", i + 1, F.lit(1)), F.substring("phrase", i, F.lit(1)), F.substring("phrase", i + 2, F.lit(4000))
        ) == F.col("street_norm"),
    )
    swap = (size == own) & (edits == 2) & swapped
    shorter = (own == size - 1) & (edits == 1)
    wider = (edits == 1) & (own >= size) & (size <= 26)
    ascii_ = ~F.col("phrase").rlike(r"[^\x{00}-\x{7F}]")

    def begins(most: int):
        lengths = F.sequence(size - most, size + most)
        return F.exists(lengths, lambda l: F.levenshtein(F.substring(F.col("street_norm"), F.lit(1), l), F.col("phrase")) <= most)

    names = names.withColumn("one", shorter | swap).withColumn("any_one", shorter | swap | wider)
    gate = ascii_ & (F.col("close") | (F.size("content") == 0))
    names = names.withColumn("start", gate & F.when(size <= 11, begins(1)).otherwise(begins(2))).where("any_one OR start").drop("content", "close")
    names = materialize(names, "typos-names")
    streets = gaz.streets.select("street_norm", F.col("code").alias("s_code"), "pc_num")
    pairs = rows.join(names, "phrase").join(streets, "street_norm").where(F.col("code").isNull() | (F.col("code") == F.col("s_code")))
    here = F.col("query_pc").isNull() | (F.col("pc_num") == 0) | (F.floor(F.col("pc_num") / 1000) == F.floor(F.col("query_pc") / 1000)) | F.col("code").isNotNull()
    pairs = pairs.where(here).withColumn("edit", F.when(F.col("c") > 0, F.col("any_one")).otherwise(F.col("one"))).where("edit OR start")
    best = F.max(F.col("edit").cast("int")).over(W.partitionBy(*keys, "c"))
    pairs = pairs.withColumn("edits_there", best)
    # what counts at each split: edits if there are any, else beginnings
    pairs = pairs.where((F.col("edits_there") == 0) | F.col("edit"))
    whole = W.partitionBy(*keys)
    pairs = pairs.withColumn("free", F.max((F.col("c") == 0).cast("int")).over(whole))
    firsts = known.groupBy(*keys).agg(F.min("c").alias("first_known"))
    pairs = pairs.join(firsts, keys, "left").withColumn("found_at", F.min(F.when(F.col("c") > 0, F.col("c"))).over(whole))
    with_free = (F.col("c") == F.col("first_known")) & F.col("edit")
    pairs = pairs.where((F.col("c") == 0) | F.when(F.col("free") == 1, with_free).otherwise(F.col("c") == F.col("found_at")))
    order = W.partitionBy(*keys, "c").orderBy("street_norm", "s_code")
    pairs = pairs.withColumn("_w_n", F.row_number().over(order)).where(F.col("_w_n") <= TYPOS)
    commune = F.col("c") > 0
    out = pairs.select(
        *keys, "street_norm", F.col("s_code").alias("code"), F.lit(False).alias("street_exact"), F.lit(True).alias("street_fuzzy"),
        (commune & F.col("exact")).alias("commune_exact"), (commune & ~F.col("exact")).alias("commune_prefix"),
    )
    return merged(out, keys)


def parts(splits: DataFrame, keys: list[str], gaz: Gazetteer, rules: Rules = words.RULES) -> DataFrame:
    """Streets of the named commune that hold the phrase's words, of which those that would leave nothing are skipped.

    What a phrase finds in the whole country doesn't depend on the query, so each distinct phrase is searched once:
    streets with its rarest word are rows, each with a bit for every further word that it holds, and the distinct bits
    of a phrase (at most one row for each combination) say which words leave something.
    """

    @F.pandas_udf("array<struct<form: string, plain: boolean>>")
    def forms(s: pd.Series) -> pd.Series:
        def of(w):
            tried = [w, *(words.normalize(f(w)) for f in (words.cyrillic_to_latin, words.latin_to_cyrillic))]
            tried = [t for i, t in enumerate(tried) if len(t) >= 3 and t not in tried[:i]]
            plain = not any(rules.is_type(t) for t in tried)
            sound = words.phonetic_key(w)
            return [{"form": t, "plain": plain} for t in [*tried, *(["~" + sound] if len(sound) >= 3 else [])]]

        return s.map(of)

    known = with_communes(splits, gaz, rules)
    asked = known.select("phrase").distinct()
    asked = asked.select("phrase", F.posexplode(F.filter(F.split("phrase", " "), lambda w: F.length(w) >= 3)).alias("at", "word"))
    tried = asked.join(asked.select("word").distinct().select("word", F.explode(forms("word")).alias("f")).select("word", "f.*"), "word")
    tried = tried.join(gaz.counts.where(F.col("n") < WORD_CAP).withColumnRenamed("word", "form"), "form")
    best = tried.groupBy("phrase", "at").agg(F.min_by(F.struct("form", "plain", "n"), F.struct("n", "form")).alias("b")).select("phrase", "b.*")
    held = best.groupBy("phrase").agg(
        F.array_sort(F.collect_list(F.struct("n", "form"))).alias("sets"), F.count(F.lit(1)).alias("n_sets"), F.bool_or("plain").alias("plain")
    )
    held = materialize(held.where("plain").select("phrase", "n_sets", F.transform("sets", lambda s: s["form"]).alias("forms")), "parts-phrases")
    postings = gaz.words.withColumnRenamed("word", "form")
    many = held.where("n_sets > 1").withColumn("form", F.get("forms", F.lit(0))).join(postings, "form").join(gaz.spelled, ["street_norm", "code"])
    bits = F.concat_ws("", F.transform("forms", lambda f: F.when(F.array_contains("own", f), "1").otherwise("0")))
    many = materialize(many.select("phrase", "n_sets", "street_norm", F.col("code").alias("s_code"), bits.alias("bits")), "parts-bits")
    found = many.groupBy("phrase").agg(F.collect_set("bits").alias("kinds"), F.max("n_sets").cast("int").alias("size"))

    def with_word(kinds, i):
        return F.filter(kinds, lambda b: F.substring(b, i, F.lit(1)) == "1")

    left = F.aggregate(F.sequence(F.lit(1), F.col("size")), F.col("kinds"), lambda acc, i: F.when(F.size(with_word(acc, i)) > 0, with_word(acc, i)).otherwise(acc))
    # the kinds that are left differ only where a word was skipped, and all that hold the other words are among them
    many = many.join(found.select("phrase", F.explode(left).alias("bits")), ["phrase", "bits"]).drop("bits")
    single = held.where("n_sets = 1").withColumn("form", F.get("forms", F.lit(0))).join(postings, "form").select("phrase", "n_sets", "street_norm", F.col("code").alias("s_code"))
    streets = many.unionByName(single)
    left = known.select(*keys, "c", "phrase", "code", "exact").distinct().join(streets, "phrase").where(F.col("code") == F.col("s_code"))
    w = W.partitionBy(*keys, "c")
    left = left.withColumn("many", F.count(F.lit(1)).over(w)).where((F.col("n_sets") > 1) | (F.col("many") <= SINGLE_WORD))
    left = left.withColumn("_w_n", F.row_number().over(w.orderBy("street_norm", "code"))).where(F.col("_w_n") <= PARTS)
    return merged(left.select(*keys, "street_norm", "code", *_feature_columns(False, F.col("exact"))), keys)
