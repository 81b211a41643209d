"""Every query with SQL against DuckDB on the smallest tables; the entry points."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from loglathe.plans.oracle import ORACLE_SQL
from loglathe.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return None if math.isnan(v) else round(float(v), 5)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=str)
    out = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == names
    want = sorted((tuple(value(r[columns.index(c)]) for c in names) for r in out.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_query_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["drain", "lenma", "spell", "shiso", "fttree"])
def test_stream_equals_batch(spark, sf, name):
    rows = lambda q: sorted(map(str, QUERIES[q](spark, sf).collect()))
    assert rows(name) == rows(f"{name}_stream")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/loglathe", tmp_path / "loglathe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_text_source_and_distinct(spark, tmp_path):
    from loglathe.sources import lines as src

    (tmp_path / "x.log").write_text("b\na\nb\n\nc\n")
    df = src.text_lines(spark, str(tmp_path / "x.log"))
    assert [r["line"] for r in df.orderBy("line_id").collect()] == ["b", "a", "b", "", "c"]
    assert [r["line"] for r in src.distinct_lines(df, 2).orderBy("line_id").collect()] == ["b", "a"]
    src.write_templates(df, str(tmp_path / "t"))
    assert src.read_templates(spark, str(tmp_path / "t")).count() == 5


def test_text_source_of_several_files_and_blocks(spark, tmp_path):
    """Files in the order of their names, whatever their sizes, also when a file is read in many blocks."""
    from loglathe.sources import lines as src

    want = []
    for name, n in (("a.log", 30), ("b.log", 4000), ("c.log", 5)):
        lines = [f"{name} {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "20000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = src.text_lines(spark, str(tmp_path)).orderBy("line_id").collect()
            assert [r["line"] for r in rows] == want and [r["line_id"] for r in rows] == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_ids_never_meet(spark, tmp_path):
    """A conversation of over 1,000 turns and its successor, a document of many lines and its: no number twice."""
    from loglathe.sources import lines as src

    spark.createDataFrame([(1, 1000, "u", "a"), (2, 0, "u", "b"), (1, 0, "u", "c")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(1, "\n".join("x" * 3 for _ in range(1500))), (2, "y\nz")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["line"] for r in src.conversation_lines(spark, str(tmp_path)).orderBy("line_id").collect()] == ["c", "a", "b"]
    assert src.conversation_lines(spark, str(tmp_path)).select("line_id").distinct().count() == 3
    docs = src.document_lines(spark, str(tmp_path))
    assert docs.select("line_id").distinct().count() == 1502 and docs.orderBy("line_id").collect()[-1]["line"] == "z"


def test_template_table(spark, tmp_path):
    from loglathe.sources import templates as tt

    mined = spark.createDataFrame([(["a", None], 5), (["b"], 2)], "template array<string>, first_line_id long")
    first = tt.add_templates(tt.empty_table(spark), mined)
    assert [tuple(r) for r in first.orderBy("template_id").collect()] == [(0, ["b"]), (1, ["a", None])]
    more = tt.add_templates(first, mined.unionByName(spark.createDataFrame([(["c", "d"], 9)], mined.schema)))
    assert more.count() == 3 and more.where("template_id = 2").first()["template"] == ["c", "d"]
    assert {tuple(r["template"]): r["template_id"] for r in tt.ids_of(more, mined.select("template").unionByName(spark.createDataFrame([(["zz"],)], "template array<string>"))).collect()} == {("a", None): 1, ("b",): 0, ("zz",): None}
    changed = tt.replace_templates(more, spark.createDataFrame([(2, ["c", None])], tt.SCHEMA))
    assert [tuple(r) for r in tt.updated(more, changed).collect()] == [(2, ["c", "d"], ["c", None])]
    assert [r["template_id"] for r in tt.updated(first, more).collect()] == [2]
    tt.dump_table(changed, str(tmp_path / "t"))
    assert sorted(map(str, tt.load_table(spark, str(tmp_path / "t")).collect())) == sorted(map(str, changed.collect()))


def test_table_function(spark):
    from loglathe.operators.drain import drain
    from loglathe.plans.registry import ONLINE, register_parse_logs

    rows = [(i, f"get item {i % 7} from host{i % 5} {'ok' if i % 2 else 'slow'}") for i in range(40)]
    df = spark.createDataFrame(rows, "line_id long, line string")
    df.createOrReplaceTempView("some_lines")
    register_parse_logs(spark)
    call = "SELECT * FROM parse_logs(TABLE(SELECT * FROM some_lines) WITH SINGLE PARTITION ORDER BY (line_id), '{}', '{}')"
    assert sorted(map(str, spark.sql(call.format("drain", '{"depth": 4}')).collect())) == sorted(map(str, drain(df).collect()))
    params = {"ael": '{"merge_pct": 0.5, "min_event_cnt": 3}', "lenma": '{"threshold": 0.9}', "shiso": '{"threshold": 0.8, "max_child": 4}', "spell": '{"tau": 0.5}'}
    for name in ONLINE:
        assert spark.sql(call.format(name, params.get(name, "{}"))).agg({"n_lines": "sum"}).first()[0] == 40
