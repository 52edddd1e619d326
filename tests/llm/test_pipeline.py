import re

import corpus_pipeline
from gaugeworks.llm import packing, queries

LIVE = "Zk3vQ9xT7bLm2RwY8sHd4NfPq6Uc1"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, docs, rows, tmp_path):
    """Each stage on what its predecessor kept; then run() gives the last one's rows."""
    docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame([(900, f"{LIVE} " + " ".join(f"w{i}" for i in range(40)), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, now = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append(now)
        if k < 4:
            assert now.columns == corpus_pipeline.COLUMNS
    texts = [[r["text"] for r in x.collect()] for x in kept[:4]]
    assert all(len(WORD.findall(t or "")) >= 20 for t in texts[0])
    base = next(r[1] for r in rows if r[0] == 38)
    assert texts[0].count(base) == 7
    assert texts[1].count(base) == 1
    assert len(texts[1]) == len(set(texts[1]))
    assert len(texts[1]) == len(texts[2]) == len(texts[3])
    windows = {}
    for i, t in enumerate(texts[1]):
        words = WORD.findall(t)
        for j in range(len(words) - 34):
            windows.setdefault(tuple(words[j : j + 35]), []).append((i, j))
    assert any(len(v) > 1 for v in windows.values())
    left = {tuple(w[j : j + 35]) for t in texts[2] for w in [WORD.findall(t)] for j in range(len(w) - 34)}
    assert not any(w in left for w, v in windows.items() if len(v) > 1)
    assert any(LIVE in t for t in texts[2])
    assert not any(LIVE in t for t in texts[3])
    assert kept[4].groupBy("doc_id").count().count() == kept[3].select("doc_id").distinct().count()
    assert kept[4].where(f"offset + length > {packing.LENGTH}").count() == 0
    again = corpus_pipeline.run(spark, sf)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(*cols).fillna(-1).collect())) == sorted(map(tuple, kept[4].select(*cols).fillna(-1).collect()))


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for query in queries.QUERIES.values():
        assert query(spark, str(tmp_path)).count() == 0
