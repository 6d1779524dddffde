"""The corpus pipeline stage by stage against brute force, and as a whole."""

from collections import Counter

import numpy as np

import corpus_pipeline as P
from caseflow.llm import langid
from caseflow.llm.common import stage
from tests.llm.helpers import frame
from tests.llm.test_text_operators import BLANK_WORDS, brute_components, brute_decontam, brute_lines, lower


def test_stages(spark, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    items = [tuple(x) for x in spark.read.parquet(f"{smoke_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, step in P.STAGES:
        before = [x.asDict() for x in docs.collect()]
        docs = stage(step(spark, docs, smoke_dir), "test")
        after = docs.collect()
        texts = [(x["doc_id"], x["text"]) for x in before]
        if step is P.language:
            assert len(after) >= 0.99 * len(before)
        elif step is P.lines:
            want = [(i, t) for (i, n, gone, t), k in brute_lines(texts).items() for _ in range(k) if not gone or t]
            assert Counter((x["doc_id"], x["text"]) for x in after) == Counter(want)
            assert all(x["n_chars"] == len(x["text"]) for x in after)
        elif step is P.near_duplicates:
            sets = {}
            for i, t in texts:
                w = BLANK_WORDS.findall(lower(t))
                sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            ids = sorted(sets)
            links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            comp = brute_components(ids, links)
            assert {x["doc_id"] for x in after} == {i for i in ids if comp[i] == i}
        elif step is P.decontaminated:
            assert {x["doc_id"] for x in after} == {x[0] for x in brute_decontam(texts, items) if not x[4]}
        else:
            assert {x["doc_id"] for x in after} == {i for i, _ in texts}
            used = sum(x["length"] for x in after)
            assert len({x["sequence_id"] for x in after}) <= 1.02 * used / 2048 + 1
        if step is not P.packed:
            assert docs.columns == list(P.COLUMNS)


def test_odd_documents(spark, tmp_path):
    odd = [(1, None), (2, ""), (3, "12 !"), (4, "the house and the garden"), (5, "a house of the garden and others"), (None, "the text without an id")]
    docs = frame(spark, odd, False).selectExpr("doc_id", "text", "cast(if(doc_id = 5, null, 'en') as string) as lang", "'s' as source",
                                               "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {x["doc_id"] for x in P.run(spark, str(tmp_path)).collect()} == {4, 5, None}
    first = P.language(spark, docs, str(tmp_path)).collect()
    assert {x["lang"] for x in first} == {"en"}


def test_texts_in_several_languages_stay(spark):
    words = {"en": "the house and garden with others", "el": "το σπίτι και ο κήπος", "ru": "дом и большой сад", "ar": "البيت و الحديقة الكبيرة"}
    rows = [(i, f"{w} " * 20, lang, "s", 1) for i, (lang, w) in enumerate(words.items())]
    rows += [(10, " ".join(f"{w} " * 9 for w in words.values()), None, "s", 1), (11, "12 !", "en", "s", 1), (12, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(docs)
    assert [x["score"] < 0.4 and len(x["spans"]) == 4 for x in langid.identify(docs.where("doc_id = 10"), model).collect()] == [True]
    assert {x["doc_id"] for x in P.language(spark, docs, "").collect()} == {0, 1, 2, 3, 10}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
    assert langid.UNKNOWN == "und" and np is not None
