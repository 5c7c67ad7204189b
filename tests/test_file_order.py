"""Generated ids follow the files by path, whatever their sizes and however a reader deals them out."""

import duckdb

from attestor import queries
from attestor.sources import corpus


def test_numbers_follow_files_of_uneven_size(spark, tmp_path):
    folder, at = tmp_path / "documents.parquet", 0
    folder.mkdir()
    for name, n in (("a 1", 5), ("a", 3000), ("b", 40), ("c", 9000), ("d", 700)):
        duckdb.sql(f"COPY (SELECT i + {at} AS doc_id, 'text ' || (i + {at}) || repeat(' w', (i % 50)::INT) AS text FROM range({n}) t(i)) TO '{folder}/{name}.parquet' (ROW_GROUP_SIZE 2048)")
        at += n
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    want = sorted(duckdb.sql(queries.SQL["numbered_items"]).fetchall())
    duckdb.sql("DROP VIEW documents")
    limit = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(limit)
    try:
        for size in (before, "20k"):
            spark.conf.set(limit, size)
            assert sorted(map(tuple, queries.numbered_items(spark, str(tmp_path)).collect())) == want
    finally:
        spark.conf.set(limit, before)


def test_a_loaded_folder_of_csv_is_numbered_by_path(spark, tmp_path):
    folder = tmp_path / "rows.csv"
    folder.mkdir()
    for name, ids in (("a b", range(1)), ("b", range(1, 300)), ("c", range(300, 310))):
        (folder / f"{name}.csv").write_text("text,_metadata\n" + "".join(f"t{i},m\n" for i in ids))
    got = corpus.load_corpus(spark, str(folder)).orderBy("ord").collect()
    assert [r["text"] for r in got] == [f"t{i}" for i in range(310)] and [r["ord"] for r in got] == list(range(1, 311))


def test_rows_of_another_frame_keep_their_own_order(spark):
    rows = spark.range(0, 100, 1, 5).selectExpr("concat('t', id) AS text").orderBy("text")
    assert [r["text"] for r in corpus.build_items(rows).orderBy("ord").collect()] == sorted(f"t{i}" for i in range(100))
