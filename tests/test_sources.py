import json

import pytest

from tidegate import fs
from tidegate.errors import ConnectorError
from tidegate.sources import Config, ReadContext, default_registry
from tidegate.sources.base import Registry
from tidegate.sources.tables import bind


@pytest.fixture
def ctx(spark):
    return ReadContext(spark, "e1", {"date": "2025-01-02"})


def read(ctx, kind, **config):
    return default_registry().need(kind).read(ctx, Config(config))


def write(ctx, df, kind, **config):
    return default_registry().need(kind).write(ctx, df, Config(config))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_csv_with_and_without_header(ctx, tmp_path):
    (tmp_path / "o.csv").write_text("order_id, customer_id,total\n1,101,150.50\n2, 102 ,200.00\n")
    df = read(ctx, "csv", path=str(tmp_path / "o.csv"))
    assert df.dtypes == [("order_id", "string"), ("customer_id", "string"), ("total", "string")]
    assert rows(df) == [("1", "101", "150.50"), ("2", "102", "200.00")]
    (tmp_path / "n.csv").write_text("1;Ana;Lima\n2;Luis;Cusco\n")
    df = read(ctx, "CSV", path=str(tmp_path / "n.csv"), hasHeader="false", delimiter=";")
    assert df.columns == ["col_0", "col_1", "col_2"] and df.count() == 2


def test_strict_csv(ctx, tmp_path):
    (tmp_path / "s.csv").write_text('a|b|c\n 1 |"x|y"|3\n\na|b|c\n4|5|6|7\n8||\t9\n')
    df = read(ctx, "csv", path=str(tmp_path / "s.csv"), strict=True, delimiter=r"\|")
    assert rows(df) == sorted([("1", '"x', 'y"'), ("", None, None), ("a", "b", "c"), ("4", "5", "6"), ("8", "", "9")], key=str)


def test_csv_modes(ctx, spark, tmp_path):
    df = spark.createDataFrame([(1, "Ana, b"), (2, None)], "id int, name string")
    at = str(tmp_path / "out")
    with pytest.raises(ConnectorError, match="append"):
        write(ctx, df, "csv", path=at, mode="APPEND")
    assert write(ctx, df, "csv", path=at).written == 2
    write(ctx, df, "csv", path=at, mode="APPEND")
    assert rows(read(ctx, "csv", path=at)) == [("1", "Ana, b"), ("1", "Ana, b"), ("2", None), ("2", None)]
    one = str(tmp_path / "one.csv")
    write(ctx, df, "csv", path=one, singleFile=True)
    write(ctx, df, "csv", path=one, singleFile=True, mode="APPEND", directory=False)
    assert (tmp_path / "one.csv").read_text().splitlines() == ["id,name", '1,"Ana, b"', "2,", '1,"Ana, b"', "2,"]
    with pytest.raises(ConnectorError, match="mode"):
        write(ctx, df, "csv", path=at, mode="SIDEWAYS")


def test_json_arrays_and_lines(ctx, spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"z": 1, "b": null, "n": {"q": 1}},\n {"z": 2.5, "x": "new"}]')
    df = read(ctx, "json", path=str(tmp_path / "a.json"))
    assert df.columns == ["z", "b", "n", "x"] and [r["z"] for r in df.orderBy("z").collect()] == [1.0, 2.5]
    (tmp_path / "l.json").write_text('{"b": 1, "a": 2}\n\n{"b": 3}\n')
    df = read(ctx, "json", path=str(tmp_path / "l.json"), format="LINES")
    assert df.columns == ["b", "a"] and rows(df) == [(1, 2), (3, None)]
    (tmp_path / "bad.json").write_text('{"b": 1}\n{"b": ')
    with pytest.raises(ConnectorError, match="JSON"):
        read(ctx, "json", path=str(tmp_path / "bad.json"), format="LINES").collect()


@pytest.mark.parametrize("form", ["ARRAY", "LINES"])
@pytest.mark.parametrize("n", [0, 3])
def test_json_round_trip(ctx, spark, tmp_path, form, n):
    df = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN 'x\"y' END AS t")
    at = str(tmp_path / "j")
    assert write(ctx, df, "json", path=at, format=form, pretty=True).written == n
    text = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*")))
    got = json.loads(text) if form == "ARRAY" else [json.loads(x) for x in text.splitlines()]
    assert sorted(r["id"] for r in got) == list(range(n)) and all("t" in r for r in got)


def test_parquet_modes_and_upsert(ctx, spark, tmp_path):
    at = str(tmp_path / "p")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    write(ctx, first, "parquet", path=at, mode="UPSERT", key="id", orderBy="at")
    later = spark.createDataFrame([(2, "c", 5), (2, "d", 9), (2, "e", 7), (3, "f", 1), (None, "g", 1)], "id int, v string, at int")
    assert write(ctx, later, "parquet", path=at, mode="UPSERT", key=["id"], orderBy=["at"]).written == 5
    assert rows(read(ctx, "parquet", path=at, columns="id, v")) == [(1, "a"), (2, "d"), (3, "f")]
    assert [p.name for p in tmp_path.iterdir()] == ["p"]
    write(ctx, first, "parquet", path=at, mode="APPEND")
    assert read(ctx, "parquet", path=at).count() == 5


def test_jdbc_with_an_embedded_database(ctx, spark, tmp_path):
    url = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(1, "Orden A", 150.5), (2, "Orden B", 200.0), (3, "Orden C", 75.25)], 'id bigint, name string, amount double')
    assert write(ctx, df, "jdbc", table="orders", **url).written == 3
    assert read(ctx, "jdbc", query='SELECT * FROM orders WHERE "amount" > :least', params={"least": 100}, **url).count() == 2
    assert read(ctx, "jdbc", table="orders", columns=["id"], **url).columns == ["id"]
    part = read(ctx, "jdbc", table="orders", partitionColumn='"id"', lowerBound=1, upperBound=4, numPartitions=3, **url)
    assert part.count() == 3 and part.rdd.getNumPartitions() == 3
    write(ctx, spark.createDataFrame([(2, "new", 1.0), (4, "Orden D", 2.0)], df.schema), "jdbc", table="orders", mode="UPSERT", key="id", **url)
    assert rows(read(ctx, "jdbc", table="orders", **url)) == [(1, "Orden A", 150.5), (2, "new", 1.0), (3, "Orden C", 75.25), (4, "Orden D", 2.0)]
    write(ctx, df.limit(1), "jdbc", table="orders", mode="TRUNCATE_INSERT", **url)
    assert read(ctx, "jdbc", table="orders", **url).count() == 1
    assert default_registry().need("jdbc").health(ctx, Config(url)).ok
    assert not default_registry().need("jdbc").health(ctx, Config(url="jdbc:nothing:x")).ok


def test_kafka_on_files(ctx, spark, tmp_path):
    df = spark.createDataFrame([(1, 101, 150.5), (2, None, 200.0), (3, 103, 75.25)], "order_id int, customer_id int, total double")
    where = {"topic": "orders", "path": str(tmp_path)}
    assert write(ctx, df, "kafka", partitionBy="customer_id", **where).written == 3
    write(ctx, df.limit(1), "kafka", partitionBy="customer_id", **where)
    raw = spark.read.parquet(str(tmp_path / "orders"))
    assert raw.select("partition", "offset").distinct().count() == 4 and "null" in {r["key"] for r in raw.collect()}
    got = read(ctx, "kafka", **where)
    assert got.columns == ["customer_id", "order_id", "total", "_kafka_offset", "_kafka_partition", "_kafka_timestamp"] and got.count() == 4
    assert read(ctx, "kafka", maxRecords=2, schema="order_id int", **where).count() == 2
    with pytest.raises(ConnectorError, match="Kafka package"):
        read(ctx, "kafka", topic="t", bootstrapServers="localhost:1")
    assert not default_registry().need("kafka").health(ctx, Config()).ok


def test_sql_source_and_binding(ctx, spark):
    spark.range(5).createOrReplaceTempView("numbers")
    assert read(ctx, "sql", query="SELECT id FROM numbers WHERE id >= :least", params={"least": 3}).count() == 2
    assert read(ctx, "sql", table="numbers", columns="id").count() == 5
    assert bind("SELECT ':date', x::date FROM t WHERE d = :date AND e > :date_from", {"date": "o'clock", "date_from": 3}) == "SELECT ':date', x::date FROM t WHERE d = 'o''clock' AND e > 3"
    with pytest.raises(ConnectorError, match="missing_one"):
        bind("SELECT :missing_one", {})


def test_registry_and_settings(ctx):
    r = default_registry()
    assert r.get("POSTGRES") is not None and r.get("nothing") is None
    with pytest.raises(ConnectorError, match="csv"):
        r.need("nothing")
    with pytest.raises(ConnectorError, match="none"):
        Registry().need("csv")
    c = Config(a="5", b="TRUE", c=[1, 2], d=" x , y ", e="five")
    assert c.whole("a", 0) == 5 and c.flag("b", False) and c.names("c") == ["1", "2"] and c.names("d") == ["x", "y"]
    with pytest.raises(ConnectorError):
        c.whole("e", 1)
    with pytest.raises(ConnectorError, match="path"):
        read(ctx, "csv")
    assert not r.need("csv").health(ctx, Config(path=" ")).ok and r.need("csv").health(ctx, Config(path="/tmp")).ok


def test_small_files(spark, tmp_path):
    at = str(tmp_path / "d" / "x.json")
    fs.write_text(spark, at, "één")
    fs.write_text(spark, at, "two")
    assert fs.read_text(spark, at) == "two" and fs.children(spark, str(tmp_path / "d")) == ["x.json"]
    assert fs.children(spark, str(tmp_path / "none")) == []
