"""The pipeline against a brute-force version of each stage on its own input."""

import hashlib
import random

import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_operators import base, brute_simhash, components, contaminated, prose  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(23)
    items = [(1, prose(900, 40)), (2, prose(901, 30))]
    texts = [prose(i, 60) for i in range(60)] + [None, "", "123 456 !!", prose(3, 60), prose(4, 59), items[0][1] + " " + prose(70, 100), prose(71, 900) + " " + " ".join(items[1][1].split()[:13])]
    texts += [prose(80 + i, 40) + f" write to me{i}@mail.example.com or 10.0.0.{i} " + prose(90 + i, 20) for i in range(5)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, prose(500, 40), "en", "s", 0), (None, prose(501, 40), "en", "s", 0), rows[5], rows[5]]
    r.shuffle(rows)
    folder = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        kept[name] = docs.collect()
        assert name == "sentencepiece" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [x for x in rows if x[1] and any(map(str.isalpha, x[1]))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(key, kept["language_id"])) == sorted(map(key, want))
    distinct = sorted(set(map(key, want)))
    prints = {i: brute_simhash(x[2]) for i, x in enumerate(distinct)}
    want = [distinct[i] for i, root in components(prints).items() if i == root]
    assert sorted(map(key, kept["simhash_near_dedup"])) == want
    want = [x for x in want if not contaminated(x[2], items)[3]]
    assert sorted(map(key, kept["benchmark_decontamination"])) == want

    def redacted(text):
        for kind, start, stop in sorted(base(text), key=lambda s: -s[1]):
            text = text[:start] + f"[{kind.upper()}]" + text[stop:]
        return text

    assert all(x["lang"] == "en" for x in kept["language_id"])
    want = sorted((*x[:2], redacted(x[2])) for x in want)
    assert sorted(map(key, kept["pii"])) == want and any("[EMAIL]" in x[2] for x in want)
    lib = sentencepiece.SentencePieceProcessor(model_proto=corpus_pipeline.model_bytes())
    digests = sorted(hashlib.sha256(",".join(map(str, lib.encode(x[2]))).encode()).hexdigest() for x in want)
    assert sorted(x["ids_sha256"] for x in kept["sentencepiece"]) == digests
    assert sorted(x["ids_sha256"] for x in corpus_pipeline.run(spark, folder).collect()) == digests


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_are_handed_on(spark, tmp_path):
    """Extra columns with the names of helper columns stay as they are in every stage."""
    extra = ["key", "_key", "_added", "_row", "_spans", "row", "spans", "said", "doc", "text_2", "h"]
    rows = [(i, prose(i, 50) + f" m{i}@mail.example.com", "en", "s", 1, *[f"{c}{i}" for c in extra]) for i in range(6)]
    docs = spark.createDataFrame([*rows, rows[0]], COLUMNS + "".join(f", `{c}` string" for c in extra))
    spark.createDataFrame([(1, prose(900, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        found = got.collect()
        assert len(found) == (6 if name == "simhash_near_dedup" else 7), name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in found for c in extra)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 7
