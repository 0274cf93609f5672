"""Language identification by cross-parsing: the fewest phrases of labelled text that a text falls into.

A suffix automaton of each language's sample accepts exactly the sample's substrings, so walking it gives the longest
match at every point. Whole texts are parsed, in lower case, with all their characters; phrases run across words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import below, crc_mod, table

#: The bounded sample. Learnt texts are cut into pieces of PIECE characters over their whole length, each with the same chance:
#: at most PIECES pieces for a language, and ALL_PIECES for all of them together (of more languages each has fewer).
PIECE, PIECES, ALL_PIECES = 200, 200, 3200


def suffix_automaton(text: str) -> dict:
    """The start of the smallest automaton that accepts the substrings of ``text``; a state maps characters to states."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    for state in step:  # places become the states themselves, which a walk follows faster
        for c, after in state.items():
            state[c] = step[after]
    return step[0]


def phrases(start: dict, text: str) -> int:
    """Phrases of the greedy parse: longest substrings of the sample, or single unseen characters."""
    count, state, begins = 0, start, start.get
    for c in text:
        after = state.get(c)
        if after is None:
            count += state is not start
            after = begins(c)
            if after is None:
                count += 1
                after = start
        state = after
    return count + (state is not start)


def learn(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, sample) for every non-null language of ``docs`` (text, lang), sorted by language.

    The sample holds the distinct pieces of smallest hash: the documented bound on what is fitted on and collected. Equal
    pieces count once, so a large group of copies cannot fill it.
    """
    known = docs.where("text is not null and lang is not null").select("lang", F.lower("text").alias("text"))
    counts = known.groupBy("lang").agg(F.sum(F.ceil(F.length("text") / PIECE)).alias("n"))
    most = max(1, min(PIECES, ALL_PIECES // max(1, counts.count())))
    pieces = known.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece"))
    pieces = pieces.withColumn("h", F.xxhash64("piece")).where(below(counts, "lang", "h", 8 * most))  # room for copies
    first = pieces.groupBy("lang", "h").agg(F.min("piece").alias("piece")).groupBy("lang")
    found = first.agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "piece"))), 1, most)["piece"].alias("pieces")).orderBy("lang").collect()
    return [(r["lang"], "\n".join(r["pieces"])) for r in found if any(r["pieces"])]


def predictor(model: list[tuple[str, str]]):
    """A column function: struct(lang_pred, score, rate) of a text.

    lang_pred is the language with the least phrases x log2(sample length) for each character, ties going to the first in
    alphabetical order; ``und`` with score 0 if the text is null or has no letter, or if nothing was learnt. score is the
    winner's share of the inverse fourth powers of these rates, rate the winner's rate itself.
    """
    langs = [lang for lang, _ in model]
    bits = [math.log2(len(sample) + 1) for _, sample in model]

    @F.pandas_udf("lang_pred string, score double, rate double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = [suffix_automaton(sample) for _, sample in model]  # made anew: a worker holds nothing between tasks
        for batch in texts:
            rows = []
            for text in batch:
                if not langs or not any(map(str.isalpha, text or "")):
                    rows.append(("und", 0.0, None))
                    continue
                low = text.lower()
                rates = [phrases(a, low) * b / len(low) for a, b in zip(automata, bits, strict=True)]
                best = min(range(len(langs)), key=rates.__getitem__)
                share = [(rates[best] / r) ** 4 for r in rates]
                rows.append((langs[best], 1 / sum(share), rates[best]))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rate"])

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, a row for each input row (doc_id, text, lang).

    Learns from rows whose crc32(doc_id as text) mod 5 is not 0 (a null id counts as an empty string and is held out).
    Nothing but the text enters a prediction. Empty tables and tables without labels give ``und``.
    """
    held_out = crc_mod("doc_id", 5) == 0
    predict = predictor(learn(docs.where(~held_out)))
    return docs.select("doc_id", held_out.alias("held_out"), predict(F.col("text")).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(table(spark, sf_dir, "documents"))
