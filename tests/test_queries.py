"""Every query with SQL agrees with DuckDB on the smallest tables; the others give rows."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from palimpsest.plans import content, records, registry, scope, surfaces, work  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return v if isinstance(v, str) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect())
    if name not in registry.SQL:
        assert rows
        return
    got = duck.sql(registry.SQL[name])
    names = got.columns
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in got.fetchall())


def test_anchors_of_intervals(spark):
    from tests.conftest import DATA

    sf = str(DATA / "sf0.01")
    segs = work.segments(spark, sf)
    assert segs.count() == 9147
    assert segs.filter("end_us > start_us").count() == 784


def test_human_sizes_keeps_documents_of_a_mebibyte_and_more(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 1536), (2, "x" * (3 << 19))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r["size"] for r in content.human_sizes(spark, str(tmp_path)).collect()}
    assert got == {1: "1.5 KiB", 2: "1.5 MiB"}


def test_baseline_report_tells_sizes_in_the_units_of_its_sql(spark, small, tmp_path):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    (tmp_path / "documents.parquet").unlink()
    n = 1100  # texts of a mebibyte, stored once
    text = pa.DictionaryArray.from_arrays(pa.array([0] * n, pa.int32()), pa.array(["x" * (1 << 20)]))
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": text, "lang": ["de"] * n, "source": ["src1"] * n, "n_chars": pa.array([1 << 20] * n, pa.int64())}), tmp_path / "documents.parquet")
    at = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(at)
    spark.conf.set(at, 16)
    try:
        got = [r.line for r in surfaces.baseline_report(spark, str(tmp_path)).filter("section = 1 and line like '%Sources%'").collect()]
    finally:
        spark.conf.set(at, before)
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        want = c.sql(f"SELECT line FROM ({registry.SQL['baseline_report']}) WHERE section = 1 AND line LIKE '%Sources%'").fetchall()
    assert got == [w[0] for w in want] == ["- Sources: **1** (1100.0 MiB)"]


def test_episode_search_reads_texts_to_their_ends(spark, small, tmp_path):
    rows = [(0, 0, "needle thread"), (1, 0, "hay " * 2000 + "needle thread"), (2, 4, "hay " * 20_000 + "needle straw thread"), (4, 3, None), (10, 0, "outcome messages")]
    rows += [(3, t, f"{t} " + "hay " * 900 + "thread needle" * (t == 18)) for t in range(19) if t != 12]  # beyond 24,000 characters in all
    rows += [(5, t, "hay " * 1500 + end) for t, end in ((4, "needle thread"), (8, "needle x thread"), (None, "thread needle"))]  # texts of one beginning
    conv, turn, text = zip(*rows, strict=True)
    pq.write_table(pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": ["user"] * len(rows), "text": list(text)}), tmp_path / "conversations.parquet")
    got = sorted((r.query_id, r.position, r.session_id, plain(r.score)) for r in records.episode_search(spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{tmp_path if t == 'conversations' else small}/{t}.parquet'")
        want = sorted((q, p, s, plain(x)) for q, p, s, x in c.sql(f"SELECT query_id, position, session_id, score FROM ({registry.SQL['episode_search']})").fetchall())
    assert got == want and {s for _, _, s, _ in got} == {0, 1, 2, 3, 5, 10}
