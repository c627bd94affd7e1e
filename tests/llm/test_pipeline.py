"""The pipeline's stages, one after the other, and the registered queries of the subpackage."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from merkleframe.llm import similar, simhash

from .conftest import DOCUMENTS, SF


@pytest.fixture
def tables(spark, tmp_path):
    r = random.Random(1)
    syllables = {"en": ["the", "tion", "ing", "er"], "de": ["sch", "keit", "ung", "ein"]}
    sentence = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows, labels = [], []
    for k in range(240):
        lang = "de" if k % 3 == 0 else "en"
        text = sentence(lang, 60)
        if k % 5 == 0 and lang == "en":
            text += " zwackhead blorgfish snivelplug zwackhead " + sentence(lang, 20)
        rows.append((k, text, lang, "s", len(text)))
        labels.append((k, 1, int(k % 5 == 0 and lang == "en")))
    passage = "\n".join(sentence("en", 20) for _ in range(4))
    clean = 500
    rows += [(clean, sentence("en", 80) + "\n" + passage, "en", "s", 0), (clean + 1, sentence("en", 80) + "\n" + passage + "\nend", "en", "s", 0)]
    rows += [(600, None, None, None, None), (601, "", "en", "s", 0), (602, "123 456", "en", "s", 7), (603, rows[1][1] + " more", "en", "s", 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.schema.fieldNames() == docs.schema.fieldNames()
            out.write.parquet(f"{tables}/{name}")
            out = spark.read.parquet(f"{tables}/{name}")
            kept[name] = {r.doc_id: r for r in out.collect()}
        docs = out
    assert not {600, 601, 602} & set(kept["language_id"]) and len(kept["language_id"]) == 243
    toxic = {k for k in range(240) if k % 5 == 0 and k % 3}
    assert len(toxic & set(kept["toxicity"])) <= 3 and len(kept["toxicity"]) >= 170
    assert kept["line_dedup"][501].text.endswith("\nend") and kept["line_dedup"][501].n_chars < len(kept["toxicity"][501].text)
    assert kept["line_dedup"][500].text == kept["toxicity"][500].text
    prints = {k: simhash.fingerprint_text(r.text) for k, r in kept["line_dedup"].items()}
    near = bin(prints[1] ^ prints[603]).count("1") <= 2
    assert (603 in kept["near_dedup"]) != near
    assert {r.doc_id for r in docs.collect()} == set(kept["near_dedup"])


def test_unlearned_language_goes(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    r = random.Random(3)
    other = [(700 + k, " ".join("".join(r.choice(["ució", "qal", "oxu", "vyk"]) for _ in range(2)) for _ in range(60)), None, "s", 0) for k in range(3)]
    kept = {row.doc_id for row in corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(other, DOCUMENTS)), tables).collect()}
    assert not {700, 701, 702} & kept and len(kept) == 243


def test_near_dedup_goes_by_similarity(spark, monkeypatch):
    monkeypatch.setattr(similar, "CROWD", 6)
    monkeypatch.setattr(similar, "BLOCK", 8)
    r = random.Random(2)
    words = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    changed = lambda base, *at: " ".join("changed" if k in at else w for k, w in enumerate(base))
    a, b, c = words(300), words(300), words(300)
    texts = [changed(a), changed(a, 150), changed(a, 20, 150, 280), changed(a, 50, 90, 130, 170, 210)]  # similarities 0.97, 0.9 and 0.85 to the first
    texts += [changed(b), changed(b, *range(10, 100, 10))]  # 0.74
    texts += [changed(c, k) for k in range(40)] + [None, "", "a b"]
    table = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCUMENTS)
    kept = sorted(row.doc_id for row in corpus_pipeline.near_dedup(spark, table, "").collect())
    assert kept == [0, 4, 5, 6, 46, 48]


def test_near_dedup_searches_by_fingerprint(spark, monkeypatch):
    kinds = "node string, bands array<bigint>, fp bigint"

    @F.pandas_udf(kinds)
    def without_bands(texts: pd.Series) -> pd.DataFrame:
        sets = [similar.shingles(t) for t in texts]
        prints = np.array([simhash.fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"node": [s.tobytes().hex() for s in sets], "bands": [[] for _ in sets], "fp": prints})

    monkeypatch.setattr(similar, "_keys", without_bands)
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base) + " end", " ".join(reversed(base))]
    assert all(bin(simhash.fingerprint_of(similar.shingles(texts[0])) ^ simhash.fingerprint_of(similar.shingles(t))).count("1") <= 2 for t in texts[1:3])
    table = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCUMENTS)
    assert sorted(row.doc_id for row in corpus_pipeline.near_dedup(spark, table, "").collect()) == [0, 3]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()])
def test_registered(spark, name):
    got = entry.queries()[name](spark, SF)
    assert got.count() > 0


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op") and n[2:3].isdigit()])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF)
    expected = con.sql(entry.oracle_sql()[name]).df()[got.columns]
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(expected, got.schema).collect()))
