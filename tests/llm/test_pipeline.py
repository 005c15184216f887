"""The pipeline's stages on a small corpus with planted cases."""

import random
from collections import Counter

import corpus_pipeline
from tests.conftest import SF01
from tests.llm import corpora
from txlens.llm import simhash


def plant(spark, folder):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        words = corpora.sentence(rng, rng.randint(30, 90)).split()
        docs.append((i, " ".join(words) if good else "*** ".join(words), "en", f"src{0 if i < 200 else i % 3}", 1))
        labels.append((i, int(good), 0))
    item = corpora.sentence(rng, 30)
    docs[101] = (101, docs[101][1] + " " + item, *docs[101][2:])
    docs += [(400, docs[5][1], "en", "src1", 1), (401, docs[6][1], "en", "src2", 1), (402, docs[6][1], "en", "src2", 1)]
    spark.createDataFrame(docs, corpora.SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_act_in_order(spark, tmp_dir):
    docs = plant(spark, tmp_dir)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "simhash near-dedup", "benchmark decontamination",
                     "mixing sources to target weights", "sharding"]
    now = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, tmp_dir)
        if k < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_dir}/{k}")
        now = spark.read.parquet(f"{tmp_dir}/{k}")
        seen.append(Counter(r.doc_id for r in now.select("doc_id").collect()))
    good = {d[0] for d in docs if d[0] % 4 or d[0] >= 400}
    assert set(seen[0]) == good
    one = good - {400, 401, 402}
    assert set(seen[1]) == one and set(seen[1].values()) == {1}
    assert set(seen[2]) == one - {101}
    assert set(seen[3]) == set(seen[2]) and set(seen[3].values()) <= {1, 2} and 2 in seen[3].values()
    assert seen[4] == seen[3]
    rows = now.collect()
    for s in range(corpus_pipeline.SHARDS):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_run_on_the_table(spark):
    got = corpus_pipeline.run(spark, SF01).toPandas()
    assert set(got.shard) == set(range(40))
    texts = spark.read.parquet(f"{SF01}/documents.parquet").toPandas().set_index("doc_id").text
    codes = simhash.fingerprints([texts[i].encode() for i in got.doc_id.unique()])
    for i in range(1, len(codes)):
        assert int((simhash.popcount(codes[:i] ^ codes[i])).min()) > 4
