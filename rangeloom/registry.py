"""Queries of the sort engine and the SQL they are held against."""

from __future__ import annotations

from dataclasses import asdict
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import encode, ovc
from .operators import partition, sketch, sort, verify
from .plans import planner
from .sources import binary, delimited, generate
from .spec import COUNT, KEY, SIZE, SortSpec
from .storage import fresh_path

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(df: DataFrame) -> int:
    """As many partitions as shuffles have here."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spec_of(df: DataFrame, keys: str, tiebreak: str = "", policy: str = COUNT, n: int | None = None, **more) -> SortSpec:
    return SortSpec(tuple(keys.split()), None, tuple(tiebreak.split()), policy, n or parts_of(df), **more)


# --- total-order sorts ---------------------------------------------------------------------------------------------


def _sorted(table: str, keys: str, tiebreak: str, show: str, spark, sf_dir) -> DataFrame:
    df = load(spark, sf_dir, table).select(*dict.fromkeys(f"{keys} {tiebreak} {show}".split()))
    return sort.with_position(df, spec_of(df, keys, tiebreak)).select("pos", *show.split())


def _sort_query(name: str, table: str, keys: str, tiebreak: str, show: str) -> None:
    order, cols = (", ".join(x.split()) for x in (f"{keys} {tiebreak}", show))
    query(name, f"SELECT row_number() OVER (ORDER BY {order}) AS pos, {cols} FROM {table}")(partial(_sorted, table, keys, tiebreak, show))


_sort_query("sort_lineitem_ship_price_part", "lineitem", "l_shipdate l_extendedprice l_partkey", "l_orderkey l_linenumber", "l_shipdate l_extendedprice l_partkey l_orderkey l_linenumber")
_sort_query("sort_lineitem_flags", "lineitem", "l_returnflag l_linestatus", "l_orderkey l_linenumber", "l_returnflag l_linestatus l_orderkey l_linenumber")
_sort_query("sort_lineitem_quantity_tax", "lineitem", "l_quantity l_tax l_discount", "l_orderkey l_linenumber", "l_quantity l_tax l_discount l_orderkey l_linenumber")
_sort_query("sort_orders_text", "orders", "o_orderpriority o_orderstatus", "o_orderkey", "o_orderpriority o_orderstatus o_orderkey")
_sort_query("sort_events_ts", "events", "ts", "event_id", "ts event_id user_id")
_sort_query("sort_documents_text", "documents", "text", "doc_id", "doc_id")
_sort_query("sort_customer_balance", "customer", "c_acctbal", "c_custkey", "c_acctbal c_custkey")


@query(
    "sort_bag_duplicates",
    """SELECT l_shipdate, l_returnflag, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_rows
       FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_returnflag) AS pos FROM lineitem) GROUP BY ALL""",
)
def sort_bag_duplicates(spark, sf_dir):
    """All duplicates stay: a key's rows fill as many neighbouring positions. No tie-break, so a hot key isn't split."""
    df = load(spark, sf_dir, "lineitem").select("l_shipdate", "l_returnflag")
    rows = sort.with_position(df, spec_of(df, "l_shipdate l_returnflag", policy=KEY))
    return rows.groupBy("l_shipdate", "l_returnflag").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_rows"))


@query("sort_discard", "SELECT count(*) AS n_rows FROM lineitem")
def sort_discard(spark, sf_dir):
    """The whole sort with its output thrown away."""
    df = load(spark, sf_dir, "lineitem")
    n = sort.discard(sort.global_sort(df, spec_of(df, "l_shipdate l_extendedprice", "l_orderkey l_linenumber", SIZE)))
    return spark.createDataFrame([(n,)], "n_rows long")


@query("merge_sorted_runs", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, o_totalprice, o_orderkey FROM orders")
def merge_sorted_runs(spark, sf_dir):
    """Both phases: stored runs, then their merge."""
    df = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    spec = spec_of(df, "o_totalprice", "o_orderkey")
    runs, _ = sort.run_generation(df, spec, 5)
    return sort.with_position(runs.drop("run"), spec).select("pos", "o_totalprice", "o_orderkey")


@query("merge_in_passes", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, o_totalprice, o_orderkey, 2 AS passes FROM orders")
def merge_in_passes(spark, sf_dir):
    """Eleven runs at a fan-in of three: two passes that store merged runs, then the last merge."""
    df = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    spec = spec_of(df, "o_totalprice", "o_orderkey")
    runs, _ = sort.run_generation(df, spec, 11)
    merged, passes = sort.merge_in_passes(runs, spec, 3)
    return sort.with_position(merged, spec).select("pos", "o_totalprice", "o_orderkey", F.lit(passes).alias("passes"))


@query("run_generation_stats", "SELECT 6 AS n_runs, count(*) AS n_rows, (count(*) * 32)::BIGINT AS n_bytes, TRUE AS all_sorted FROM orders, (SELECT 1) WHERE TRUE")
def run_generation_stats(spark, sf_dir):
    """Runs, their rows and bytes, and whether each is in order."""
    df = load(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice", "o_orderkey", "o_custkey")
    runs, stats = sort.run_generation(df, spec_of(df, "o_orderdate o_totalprice", "o_orderkey"), 6)
    # Within a stored run the row order is the file's; the row index gives it back.
    indexed = spark.read.parquet(runs._stored_at).select("*", "_metadata.row_index", "_metadata.file_path")
    prev = F.lag(F.struct("o_orderdate", "o_totalprice", "o_orderkey")).over(Window.partitionBy("run", "file_path").orderBy("row_index"))
    ordered = indexed.withColumn("_p", prev).agg(F.count_if(F.struct("o_orderdate", "o_totalprice", "o_orderkey") < F.col("_p")).alias("bad")).first().bad == 0
    return spark.createDataFrame([(len(stats.runs), stats.rows, sum(r[2] for r in stats.runs), ordered)], "n_runs int, n_rows long, n_bytes long, all_sorted boolean")


@query("merge_stats", "SELECT 4 AS runs_in, count(*) AS n_rows FROM customer")
def merge_stats(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    _, stats = sort.sort_with_stats(df, spec_of(df, "c_acctbal", "c_custkey", SIZE), 4)
    return spark.createDataFrame([(stats.merges[0].runs_in, stats.merges[0].rows)], "runs_in int, n_rows long")


# --- scans by key range --------------------------------------------------------------------------------------------

_RANGE = "o_totalprice >= 50000 AND o_totalprice < 120000"


@query("range_scan_half_open", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_RANGE}")
def range_scan_half_open(spark, sf_dir):
    return sort.range_scan(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50000.0, 120000.0)


@query("range_scan_partitioned", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_RANGE}")
def range_scan_partitioned(spark, sf_dir):
    """The same over a stored, range-partitioned sort: row groups outside the bounds aren't read."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = fresh_path(spark, "range-partitioned")
    sort.global_sort(df, spec_of(df, "o_totalprice", "o_orderkey")).write.parquet(path)
    return sort.range_scan(spark.read.parquet(path), "o_totalprice", 50000.0, 120000.0)


# --- partition policies --------------------------------------------------------------------------------------------

_PARTS = 6


def _cuts_sql(test: str, total: str, imbalance: float) -> str:
    terms = [f"({test.format(t=f'floor({total} * {partition.target_ratio(_PARTS, imbalance, b)!r}::DOUBLE)')})::INT" for b in range(1, _PARTS)]
    return " + ".join(terms)


_ORDERED_DOCS = """
  SELECT source, doc_id, strlen(coalesce(text, '')) AS size, row_number() OVER (ORDER BY source, doc_id) AS pos, count(*) OVER () AS n,
    coalesce(sum(strlen(coalesce(text, ''))) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(strlen(coalesce(text, ''))) OVER () AS total FROM documents"""
_SHOW = "partition, count(*) AS n_rows, sum(size)::BIGINT AS n_bytes, min(source) AS first_key, max(source) AS last_key"


def _partition_stats(policy: str, imbalance: float, spark, sf_dir) -> DataFrame:
    df = load(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    spec = SortSpec(("source",), None, ("doc_id",), policy, _PARTS, imbalance)
    rows = sort.with_position(df, spec_of(df, "source", "doc_id"), before=F.col("size"))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    pid = partition.exact_key_partitions(rows, spec, n) if policy == KEY else partition.exact_partitions(rows, spec, n, total)
    return rows.groupBy(pid.cast("int").alias("partition")).agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), F.min("source").alias("first_key"), F.max("source").alias("last_key"))


for _name, _r in (("", 1.0), ("_imbalance_2", 2.0)):
    query(f"partition_count{_name}", f"SELECT {_SHOW} FROM (SELECT *, ({_cuts_sql('pos > {t}', 'n', _r)})::INT AS partition FROM ({_ORDERED_DOCS})) GROUP BY partition")(partial(_partition_stats, COUNT, _r))
    query(f"partition_size{_name}", f"SELECT {_SHOW} FROM (SELECT *, ({_cuts_sql('before >= {t}', 'total', _r)})::INT AS partition FROM ({_ORDERED_DOCS})) GROUP BY partition")(partial(_partition_stats, SIZE, _r))
query(
    "partition_key_only",
    f"""WITH o AS ({_ORDERED_DOCS}), c AS (SELECT DISTINCT source AS cut FROM o WHERE pos IN ({", ".join(f"floor(n * {partition.target_ratio(_PARTS, 1.0, b)!r}::DOUBLE) + 1" for b in range(1, _PARTS))}))
        SELECT {_SHOW} FROM (SELECT *, (SELECT count(*) FROM c WHERE cut <= o.source)::INT AS partition FROM o) GROUP BY partition""",
)(partial(_partition_stats, KEY, 1.0))


@query(
    "sort_then_partition_bounds",
    """WITH o AS (SELECT o_orderdate, o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos, count(*) OVER () AS n FROM orders)
       SELECT b AS bound, o_orderdate, o_orderkey FROM o, (SELECT unnest(range(1, 10))::INT AS b) WHERE pos = floor(n * (b * 0.1::DOUBLE)) + 1""",
)
def sort_then_partition_bounds(spark, sf_dir):
    """Exact equi-count bounds: the rows that open partitions 1 to 9 of 10."""
    df = load(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    rows = sort.with_position(df, spec_of(df, "o_orderdate", "o_orderkey"))
    n = df.count()
    at = F.broadcast(spark.createDataFrame([(b, int(n * (b * 0.1)) + 1) for b in range(1, 10)], "bound int, at long"))
    return rows.join(at, F.col("pos") == F.col("at")).select("bound", "o_orderdate", "o_orderkey")


@query(
    "imbalance_targets",
    """WITH t AS (SELECT n, f, greatest(CASE WHEN f <= 0 THEN 1 ELSE f END, 1) / n AS h0 FROM (VALUES (2), (4), (7), (40)) a(n), (VALUES (0.0::DOUBLE), (1.0), (1.5), (3.0), (9.0)) b(f)),
         u AS (SELECT n, f, least(h0, 1) AS h, unnest(range(1, n))::INT AS bound FROM t)
       SELECT n::INT AS parts, f AS imbalance, bound, floor(123457 * (h + (bound - 1) * ((1 - h) / (n - 1))))::BIGINT AS target FROM u
       WHERE floor(123457 * (h + (bound - 1) * ((1 - h) / (n - 1)))) < 123457""",
)
def imbalance_targets(spark, sf_dir):
    """Where partitions of a table of 123457 rows begin, by number of partitions and imbalance factor."""
    rows = [(n, f, b, t) for n in (2, 4, 7, 40) for f in (0.0, 1.0, 1.5, 3.0, 9.0) for b in range(1, n) if (t := partition.target(n, f, b, 123457)) is not None]
    return spark.createDataFrame(rows, "parts int, imbalance double, bound int, target long")


def _policy_balance(spark, sf_dir) -> DataFrame:
    """Rows and bytes of the physical partitions that sampled bounds give, per policy, on a key with a tenth of the rows and large payloads."""
    df = generate.heavy_key(spark, 20_000, heavy_bytes=4096).withColumn("id", F.monotonically_increasing_id())
    weight = F.octet_length("key") + F.octet_length("value")
    out = None
    for policy in (KEY, COUNT, SIZE):
        spec = SortSpec(("key",), None, ("id",), policy, 8)
        per = partition.metrics(partition.partition_by_range(df, spec, weight), "pid", weight)
        row = partition.spread(per).select(F.lit(policy).alias("policy"), "ratio_n_rows", "ratio_n_bytes")
        out = row if out is None else out.union(row)
    return out


Q["partition_policy_balance"] = _policy_balance


@query(
    "sparse_index_every_100",
    "SELECT pos, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS pos FROM lineitem) WHERE (pos - 1) % 100 = 0",
)
def sparse_index_every_100(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    rows = sort.with_position(df, spec_of(df, "l_extendedprice", "l_orderkey l_linenumber"))
    return partition.sparse_index(rows, 100).select("pos", "l_orderkey", "l_linenumber")


@query(
    "sparse_index_every_64k",
    f"""SELECT pos, before, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY before // 65536 ORDER BY pos) AS k FROM (SELECT pos, before::BIGINT AS before, doc_id FROM ({_ORDERED_DOCS}))) WHERE k = 1""",
)
def sparse_index_every_64k(spark, sf_dir):
    df = load(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    rows = sort.with_position(df, spec_of(df, "source", "doc_id"), before=F.col("size"))
    return partition.sparse_index(rows, 1 << 16, "bytes").select("pos", "before", "doc_id")


_CUTS = (50_000.0, 200_000.0)
_WANTED = [0.0, 1_500.0, 50_000.0, 123_456.78, 250_000.0, 1e9]
_SEGMENT_SQL = f"""WITH s AS (SELECT o_totalprice AS price, o_orderkey AS k, (o_totalprice >= {_CUTS[0]})::INT + (o_totalprice >= {_CUTS[1]})::INT AS segment FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY price, k) - 1 AS nth, row_number() OVER (ORDER BY price, k) - 1 AS pos FROM s),
  e AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS entry FROM r WHERE nth % 50 = 0)"""


def _segments(spark, sf_dir) -> DataFrame:
    """Sorted orders in three stored segments, an index entry every 50 records of 16 bytes in each."""
    df = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    rows = sort.with_position(df, spec_of(df, "o_totalprice", "o_orderkey"))
    price = F.col("o_totalprice")
    rows = rows.withColumn("segment", (price >= _CUTS[0]).cast("int") + (price >= _CUTS[1]).cast("int"))
    sizes = rows.groupBy("segment").agg((F.count("*") * 16).alias("n_bytes"), F.min("pos").alias("opens"))
    index = partition.sparse_index(rows.join(sizes, "segment").withColumn("pos", F.col("pos") - F.col("opens") + 1), 50)
    return partition.joined_index(index.select("segment", "o_totalprice", "o_orderkey", ((F.col("pos") - 1) * 16).alias("before")), sizes.select("segment", "n_bytes"))


@query("multi_segment_index", _SEGMENT_SQL + " SELECT segment, k AS o_orderkey, entry, (nth * 16)::BIGINT AS before, (pos * 16)::BIGINT AS global_before FROM e")
def multi_segment_index(spark, sf_dir):
    return _segments(spark, sf_dir).select("segment", "o_orderkey", "entry", "before", "global_before")


@query("multi_segment_bounds", _SEGMENT_SQL + f" SELECT wanted, count(*) FILTER (price < wanted) AS lower, count(*) FILTER (price <= wanted) AS upper FROM e, (SELECT unnest({_WANTED}::DOUBLE[]) AS wanted) GROUP BY wanted")
def multi_segment_bounds(spark, sf_dir):
    """Places of keys in the index of all segments."""
    return partition.index_bounds(_segments(spark, sf_dir), "o_totalprice", _WANTED)


@query("key_frequency", "SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM lineitem GROUP BY ALL")
def key_frequency(spark, sf_dir):
    return partition.by_distinct_duplicates(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


# --- encodings and offset-value codes ------------------------------------------------------------------------------


@query("encode_i32", "SELECT l_orderkey, l_linenumber, lpad(to_hex(l_linenumber::BIGINT + 2147483648), 8, '0') AS hex FROM lineitem")
def encode_i32(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.hex(encode.encode_i32(F.col("l_linenumber"))).alias("hex"))


@query("encode_i64", "SELECT c_custkey, v, lpad(to_hex((v::HUGEINT + 9223372036854775808::HUGEINT)::UBIGINT), 16, '0') AS hex FROM (SELECT c_custkey, round(c_acctbal * 100)::BIGINT AS v FROM customer)")
def encode_i64(spark, sf_dir):
    df = load(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("v"))
    return df.select("c_custkey", "v", F.hex(encode.encode_i64(F.col("v"))).alias("hex"))


@query("encode_date", "SELECT o_orderkey, lpad(to_hex((o_orderdate::DATE - DATE '1970-01-01')::BIGINT + 719163 + 2147483648), 8, '0') AS hex FROM orders")
def encode_date(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.hex(encode.encode_date(F.col("o_orderdate").cast("date"))).alias("hex"))


@query("encode_text", "SELECT o_orderkey, hex(encode(o_orderpriority)) AS hex FROM orders")
def encode_text(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.hex(encode.encode_text(F.col("o_orderpriority"))).alias("hex"))


@query("encode_f64_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos FROM customer")
def encode_f64_order(spark, sf_dir):
    """Sorting by encoded bytes is sorting by value."""
    df = load(spark, sf_dir, "customer").select("c_custkey", encode.encode_f64(F.col("c_acctbal")).alias("bytes"))
    return sort.with_position(df, spec_of(df, "bytes", "c_custkey")).select("c_custkey", "pos")


@query("encode_decode_round_trip", "SELECT c_custkey, c_acctbal, c_acctbal::FLOAT::DOUBLE AS as_float, c_nationkey, c_name, (c_custkey * 1000003)::BIGINT AS wide FROM customer")
def encode_decode_round_trip(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    e = df.select(
        encode.encode_i64(F.col("c_custkey")).alias("a"), encode.encode_f64(F.col("c_acctbal")).alias("b"), encode.encode_f32(F.col("c_acctbal").cast("float")).alias("c"),
        encode.encode_i32(F.col("c_nationkey")).alias("d"), encode.encode_text(F.col("c_name")).alias("e"), encode.encode_i128((F.col("c_custkey") * 1000003).cast("decimal(38,0)")).alias("f"),
    )
    return e.select(
        encode.decode_i64(F.col("a")).alias("c_custkey"), encode.decode_f64(F.col("b")).alias("c_acctbal"), encode.decode_f32(F.col("c")).cast("double").alias("as_float"),
        encode.decode_i32(F.col("d")).alias("c_nationkey"), encode.decode_text(F.col("e")).alias("c_name"), encode.decode_i128(F.col("f")).cast("long").alias("wide"),
    )


_KEY_SQL = """hex(encode(l_returnflag)) || '00' || hex(encode(l_linestatus)) || '00' || lpad(to_hex((l_shipdate::DATE - DATE '1970-01-01')::BIGINT + 719163 + 2147483648), 8, '0') || '00' || lpad(to_hex(l_linenumber::BIGINT + 2147483648), 8, '0')"""


def _key(df: DataFrame) -> Column:
    return encode.composite([(F.col("l_returnflag"), "string"), (F.col("l_linestatus"), "string"), (F.col("l_shipdate").cast("date"), "date"), (F.col("l_linenumber"), "int")])


@query("composite_key_hex", f"SELECT l_orderkey, l_linenumber, {_KEY_SQL} AS hex FROM lineitem")
def composite_key_hex(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", F.hex(_key(df)).alias("hex"))


@query("composite_key_decoded", "SELECT l_orderkey, l_linenumber, l_returnflag AS flag, l_linestatus AS status, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_linenumber::VARCHAR AS line FROM lineitem")
def composite_key_decoded(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    kinds = ["string", "string", "date", "int"]
    p = encode.composite_parts(_key(df), kinds)
    df = df.select("l_orderkey", "l_linenumber", p.alias("p"))
    return df.select("l_orderkey", "l_linenumber", *(encode.decode_any(F.col("p")[i], k).alias(n) for i, (k, n) in enumerate(zip(kinds, ("flag", "status", "shipped", "line"), strict=True))))


# Runs: keys of text, one run per market segment. Keys are ASCII, so characters are bytes.
_RUN_SQL = """
WITH k AS (SELECT c_mktsegment AS run, c_custkey AS id, c_name || '/' || c_mktsegment AS key FROM customer),
  p AS (SELECT *, lag(key) OVER (PARTITION BY run ORDER BY key, id) AS before FROM k),
  l AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE coalesce(list_min([j FOR j IN range(1, least(strlen(key), strlen(before)) + 2) IF j > least(strlen(key), strlen(before)) OR substr(key, j, 1) <> substr(before, j, 1)]), 1) - 1 END AS lcp FROM p),
  o AS (SELECT *, lcp // {c} * {c} AS off, rpad(hex(encode(substr(key, lcp // {c} * {c} + 1, {c}))), {h}, '0') AS val FROM l)"""


def _runs(spark, sf_dir, bits) -> DataFrame:
    df = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("run"), F.col("c_custkey").alias("id"), F.encode(F.concat_ws("/", "c_name", "c_mktsegment"), "UTF-8").alias("key"))
    return ovc.with_codes(df, "key", ["run"], ["id"], bits)


for _bits, _c in ovc.CHUNK.items():
    _s = 8 * _c
    query(
        f"ovc{_bits}_codes",
        _RUN_SQL.format(c=_c, h=2 * _c)
        + f" SELECT id, run, CASE WHEN before IS NULL THEN {3 << (_s + 13)} WHEN key = before THEN {1 << (_s + 13)} ELSE ('0x' || val)::BIGINT + (8191 - off) * {1 << _s} + {2 << (_s + 13)} END::BIGINT AS ovc FROM o",
    )(lambda spark, sf_dir, bits=_bits: _runs(spark, sf_dir, bits).select("id", "run", "ovc"))


@query("ovc_consistency", "SELECT c_mktsegment AS run, count(*) AS n_rows, TRUE AS consistent, TRUE AS optimal FROM customer GROUP BY ALL")
def ovc_consistency(spark, sf_dir):
    return ovc.consistency(_runs(spark, sf_dir, 32), "key", ["run"], ["id"])


@query(
    "ovc_prefix_savings",
    _RUN_SQL.format(c=2, h=4)
    + " SELECT run, sum(strlen(key) + 16)::BIGINT AS plain_bytes, sum(CASE WHEN key = before THEN 16 ELSE strlen(key) - CASE WHEN before IS NULL THEN 0 ELSE off END + 20 END)::BIGINT AS coded_bytes FROM o GROUP BY run",
)
def ovc_prefix_savings(spark, sf_dir):
    """Bytes of each run stored plain and with codes, for 8-byte values."""
    df = _runs(spark, sf_dir, 32).withColumn("value", encode.encode_i64(F.col("id")))
    plain, coded = ovc.stored_bytes(F.col("key"), F.col("value"), F.col("ovc"), F.col("ovc_offset"))
    return df.groupBy("run").agg(F.sum(plain).alias("plain_bytes"), F.sum(coded).alias("coded_bytes"))


_PAIRS_SQL = """
WITH k AS (SELECT c_mktsegment AS run, c_custkey AS id, c_name || '/' || c_mktsegment AS key FROM customer),
  p AS (SELECT *, lead(key) OVER w AS other_key, lead(id) OVER w AS other FROM k WINDOW w AS (PARTITION BY run ORDER BY id % 97, id)),
  q AS (SELECT *, least(key, other_key) AS low, greatest(key, other_key) AS high FROM p WHERE other IS NOT NULL),
  l AS (SELECT *, coalesce(list_min([j FOR j IN range(1, least(strlen(low), strlen(high)) + 2) IF j > least(strlen(low), strlen(high)) OR substr(low, j, 1) <> substr(high, j, 1)]), 1) - 1 AS lcp FROM q)
SELECT id, other, CASE WHEN key < other_key THEN -1 WHEN key > other_key THEN 1 ELSE 0 END AS "order",
  CASE WHEN low = high THEN {dup} ELSE ('0x' || rpad(hex(encode(substr(high, lcp // {c} * {c} + 1, {c}))), {h}, '0'))::BIGINT + (8191 - lcp // {c} * {c}) * {one} + {normal} END::BIGINT AS loser_code FROM l"""

for _bits, _c in ovc.CHUNK.items():
    _s = 8 * _c

    @query(f"ovc{_bits}_compare", _PAIRS_SQL.format(c=_c, h=2 * _c, one=1 << _s, dup=1 << (_s + 13), normal=2 << (_s + 13)))
    def _ovc_compare(spark, sf_dir, bits=_bits):
        """Keys of a run in pairs, compared by their codes after the run's least key; the loser's code is told from these where they differ."""
        df = _runs(spark, sf_dir, bits).select("run", "id", "key")
        df = df.join(df.groupBy("run").agg(F.min("key").alias("base")), "run").withColumn("ovc", ovc.code(F.col("key"), F.col("base"), bits))
        w = Window.partitionBy("run").orderBy(F.col("id") % 97, "id")
        df = df.withColumns({"other": F.lead("id").over(w), "other_key": F.lead("key").over(w), "other_ovc": F.lead("ovc").over(w)}).where("other is not null")
        met = ovc.compare(F.col("key"), F.col("ovc"), F.col("other_key"), F.col("other_ovc"), bits)
        return df.withColumn("met", met).select("id", "other", "met.order", "met.loser_code")


# --- verification and statistics -----------------------------------------------------------------------------------


@query("verify_sorted", "SELECT count(*) AS n_rows, 0::BIGINT AS violations FROM lineitem")
def verify_sorted(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber")
    rows = sort.with_position(df, spec_of(df, "l_shipdate l_extendedprice", "l_orderkey l_linenumber"))
    return verify.order_violations(rows, ["l_shipdate", "l_extendedprice"])


@query("verify_complete", "SELECT count(*) AS n_rows, TRUE AS same_rows FROM orders")
def verify_complete(spark, sf_dir):
    """The sorted table holds the rows of the input, each as often."""
    df = load(spark, sf_dir, "orders")
    out = sort.global_sort(df, spec_of(df, "o_orderdate", "o_orderkey", SIZE))
    return spark.createDataFrame([(df.count(), verify.same_rows(df, out))], "n_rows long, same_rows boolean")


@query("key_value_size_stats", "SELECT count(*) AS n_rows, sum(strlen(o_orderpriority))::BIGINT AS key_bytes, sum(strlen(o_orderstatus))::BIGINT AS value_bytes, avg(strlen(o_orderpriority)) AS avg_key, avg(strlen(o_orderstatus)) AS avg_value FROM orders")
def key_value_size_stats(spark, sf_dir):
    return verify.size_stats(load(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderstatus"))


@query("edge_rows", "SELECT pos, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, count(*) OVER () AS n FROM orders) WHERE pos <= 10 OR pos > n - 10")
def edge_rows(spark, sf_dir):
    """First and last ten rows, as a verifier shows them."""
    df = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    rows = sort.with_position(df, spec_of(df, "o_totalprice", "o_orderkey"))
    n = df.count()
    return rows.where((F.col("pos") <= 10) | (F.col("pos") > n - 10)).select("pos", "o_orderkey")


@query("lineitem_size_estimate", """SELECT round(avg(b), 4) AS mean_bytes, count(*) AS n_rows FROM (SELECT strlen(l_returnflag) + 2 + strlen(l_linestatus) + 2 + 9 + 5 AS b FROM lineitem)""")
def lineitem_size_estimate(spark, sf_dir):
    """Mean estimated bytes of two text keys, an integer of 64 and one of 32 bits."""
    df = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    return df.agg(F.round(F.avg(delimited.selected_bytes(df.schema, df.columns)), 4).alias("mean_bytes"), F.count("*").alias("n_rows"))


# --- planner -------------------------------------------------------------------------------------------------------

_PLANS = [(204800, 28800, 16), (204800, 256, 16), (204800, 200, 16), (10000, 2048, 8), (199659.46, 29491, 16)]


@query(
    "plan_resources",
    """SELECT * FROM (VALUES (204800.0::DOUBLE, 28800.0::DOUBLE, 'ThreadBound', 16, 16, 40.0::DOUBLE, 21887, 5120, TRUE), (204800, 256, 'MemoryBound', 5, 1, 40.96, 3111, 5000, FALSE), (204800, 200, 'MemoryBound', 4, 1, 40, 2431, 5120, FALSE),
       (10000, 2048, 'ThreadBound', 8, 8, 40, 3111, 250, TRUE), (199659.46, 29491, 'ThreadBound', 16, 16, 40, 22412, 4992, TRUE)) t(dataset_mb, memory_mb, regime, run_gen_threads, merge_threads, buffer_mb, fan_in, runs, single_step)""",
)
def plan_resources(spark, sf_dir):
    rows = []
    for d, m, t in _PLANS:
        p = asdict(planner.plan(planner.PlannerConfig(d, m, t)))
        rows.append((float(d), float(m), p["regime"], p["run_gen_threads"], p["merge_threads"], round(p["buffer_mb"], 6), p["fan_in"], p["runs"], p["single_step"]))
    return spark.createDataFrame(rows, "dataset_mb double, memory_mb double, regime string, run_gen_threads int, merge_threads int, buffer_mb double, fan_in int, runs int, single_step boolean")


@query(
    "merge_pass_plan",
    """SELECT n::INT AS runs, f::INT AS fan_in, CASE WHEN n <= f THEN 0 ELSE (f - 1 - ((n - 1) % (f - 1))) % (f - 1) END::INT AS dummies,
       CASE WHEN n <= 1 THEN 0 WHEN n <= f THEN 1 ELSE (n + (f - 1 - ((n - 1) % (f - 1))) % (f - 1) - 1) // (f - 1) END::INT AS merges FROM range(0, 60) a(n), range(2, 9) b(f)""",
)
def merge_pass_plan(spark, sf_dir):
    rows = [(n, f, *planner.merge_passes(n, f).values()) for n in range(60) for f in range(2, 9)]
    return spark.createDataFrame(rows, "runs int, fan_in int, dummies int, merges int")


# --- sketches ------------------------------------------------------------------------------------------------------

_SHARES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


@query(
    "exact_cdf",
    "SELECT l_quantity AS value, count(*) AS n_rows, (sum(count(*)) OVER (ORDER BY l_quantity))::BIGINT AS n_upto, (sum(count(*)) OVER (ORDER BY l_quantity))::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS share FROM lineitem GROUP BY l_quantity",
)
def exact_cdf(spark, sf_dir):
    return sketch.exact_cdf(load(spark, sf_dir, "lineitem"), "l_quantity")


@query(
    "quantile_exact_cdf",
    f"""WITH c AS (SELECT l_extendedprice AS v, (sum(count(*)) OVER (ORDER BY l_extendedprice))::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS share FROM lineitem GROUP BY 1)
        SELECT p, min(v) AS value FROM c, (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in _SHARES)}]) AS p) WHERE share >= p GROUP BY p""",
)
def quantile_exact_cdf(spark, sf_dir):
    return sketch.cdf_query(sketch.exact_cdf(load(spark, sf_dir, "lineitem"), "l_extendedprice"), _SHARES)


@query("kll_rank_error_ok", "SELECT count(*) AS n_rows, TRUE AS within FROM lineitem")
def kll_rank_error_ok(spark, sf_dir):
    """Merged KLL sketches of chunks place every quantile within 3 % of its exact share."""
    df = load(spark, sf_dir, "lineitem").select("l_extendedprice", F.pmod(F.xxhash64("l_orderkey"), F.lit(40)).alias("chunk"))
    whole = sketch.kll(df, "l_extendedprice", 200, ["chunk"]).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    got = whole.select(F.kll_sketch_get_n_double("sketch").alias("n"), *(F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"q{i}") for i, p in enumerate(_SHARES[:-1]))).first()
    n = df.agg(*(F.count_if(F.col("l_extendedprice") <= got[f"q{i}"]).alias(f"r{i}") for i in range(len(_SHARES) - 1))).first()
    ok = all(abs(n[i] / got.n - p) <= 0.03 for i, p in enumerate(_SHARES[:-1]))
    return spark.createDataFrame([(got.n, ok)], "n_rows long, within boolean")


@query("text_sketch_error_ok", "SELECT count(*) AS n_rows, TRUE AS within FROM customer")
def text_sketch_error_ok(spark, sf_dir):
    """The same for text, by sketches merged from partitions."""
    df = load(spark, sf_dir, "customer").select("c_name")
    s = sketch.sketch_column(df, "c_name", "kll", 200)
    cdf = s.cdf()
    qs = [(p, cdf.query(p)) for p in _SHARES[:-1]]
    n = df.agg(F.count("*"), *(F.count_if(F.col("c_name") <= q) for _, q in qs)).first()
    return spark.createDataFrame([(s.count(), all(abs(r / n[0] - p) <= 0.03 for (p, _), r in zip(qs, n[1:], strict=True)))], "n_rows long, within boolean")


@query("reservoir_count", "SELECT least(600, count(*)) AS n_rows, least(600, count(*)) AS n_distinct FROM orders")
def reservoir_count(spark, sf_dir):
    """A reservoir of 600 rows, without repeats."""
    return sketch.reservoir(load(spark, sf_dir, "orders").select("o_orderkey"), 600, 7).agg(F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_distinct"))


@query("preagg_distinct_per_chunk", "SELECT l_orderkey % 10 AS chunk, l_quantity AS value, count(*) AS n_rows FROM lineitem GROUP BY ALL")
def preagg_distinct_per_chunk(spark, sf_dir):
    return sketch.distinct_per_chunk(load(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_orderkey") % 10)


@query("top3_frequency", "SELECT l_quantity AS value, count(*) AS n_rows FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top3_frequency(spark, sf_dir):
    return sketch.top_frequencies(load(spark, sf_dir, "lineitem"), "l_quantity", 3)


@query(
    "equi_depth_buckets",
    """WITH c AS (SELECT l_quantity AS v, (sum(count(*)) OVER (ORDER BY l_quantity))::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS share, count(*) AS n FROM lineitem GROUP BY 1),
         b AS (SELECT i, (SELECT min(v) FROM c WHERE share >= i / 8.0::DOUBLE) AS bound FROM range(1, 8) r(i))
       SELECT (SELECT count(*) FROM b WHERE bound < v)::INT AS bucket, sum(n)::BIGINT AS n_rows FROM c GROUP BY 1""",
)
def equi_depth_buckets(spark, sf_dir):
    """Rows in the buckets between exact octiles; a bucket includes its upper bound."""
    df = load(spark, sf_dir, "lineitem").select("l_quantity")
    bounds = [r.value for r in sketch.cdf_query(sketch.exact_cdf(df, "l_quantity"), [i / 8 for i in range(1, 8)]).orderBy("p").collect()]
    return df.groupBy(sketch.bucket_of(F.col("l_quantity"), bounds).alias("bucket")).agg(F.count("*").alias("n_rows"))


def _sketch_balance(spark, sf_dir) -> DataFrame:
    """Balance of 40 equi-depth partitions of Zipf ranks, by bounds from four kinds of sketch."""
    df = spark.range(200_000).select(generate.zipf(generate.uniform(3, 1), 100_000, 0.9).alias("v"))
    once = df.distinct()
    out = None
    for name, kind, k, rows in (("kll", "kll", 200, df), ("reservoir", "reservoir", 600, df), ("kll-preagg", "kll", 200, once), ("reservoir-preagg", "reservoir", 600, once)):
        bounds = sketch.equi_depth_bounds(sketch.sketch_column(rows, "v", kind, k).cdf(), 40)
        row = sketch.bucket_balance(df, "v", bounds).select(F.lit(name).alias("sketch"), "items", "largest", "imbalance", "variance")
        out = row if out is None else out.union(row)
    return out


Q["sketch_partition_balance"] = _sketch_balance


# --- sources and sinks ---------------------------------------------------------------------------------------------


@query("csv_round_trip", "SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def csv_round_trip(spark, sf_dir):
    """Written as delimited text and read back by position."""
    from pyspark.sql import types as T

    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    path = fresh_path(spark, "csv")
    df.write.csv(path, header=True, sep="|")
    return delimited.read_delimited(spark, path, T.StructType(df.schema.fields), [3, 4], [0, 1, 2], "|")


@query("kvbin_round_trip", f"SELECT {_KEY_SQL} AS key_hex, lpad(to_hex(l_orderkey - 9223372036854775807 - 1), 16, '0') AS value_hex FROM lineitem")
def kvbin_round_trip(spark, sf_dir):
    """Composite keys written as length-prefixed records with an index, and read back in splits."""
    df = load(spark, sf_dir, "lineitem")
    # The writer opens files by pyarrow: a store that only Spark reaches can't hold them.
    path = fresh_path(spark, "kvbin")
    binary.write_kvbin(df.select(_key(df).alias("key"), encode.encode_i64(F.col("l_orderkey")).alias("value")), path, 1 << 16)
    back = binary.read_kvbin(spark, path, 8)
    return back.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


@query(
    "sort_gensort",
    "SELECT row_number() OVER (ORDER BY k, v) AS pos, k AS key, v AS value FROM (SELECT lpad(reverse(o_orderkey::VARCHAR), 10, '0') AS k, rpad(o_orderpriority || o_orderkey::VARCHAR, 90, '.') AS v FROM orders)",
)
def sort_gensort(spark, sf_dir):
    """Orders written as 100-byte records, read back in splits and sorted by their key bytes."""
    df = load(spark, sf_dir, "orders")
    key, value = F.lpad(F.reverse(F.col("o_orderkey").cast("string")), 10, "0"), F.rpad(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")), 90, ".")
    path = fresh_path(spark, "gensort")
    binary.write_gensort(df.select(F.encode(key, "UTF-8").alias("key"), F.encode(value, "UTF-8").alias("value")), path)
    back = binary.read_gensort(spark, path)
    return sort.with_position(back, spec_of(back, "key", "value")).select("pos", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


# The generators' rows in SQL: digits of the same hash of the row number, as a share of 1 and as 64 bits.
def _share(salt: int, seed: int = 1) -> str:
    return f"(('0x' || substr(md5('{seed}:{salt}:' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _bits(salt: int, seed: int = 1) -> str:
    half = lambda at: f"('0x' || substr(md5('{seed}:{salt}:' || id), {at}, 8))::HUGEINT"
    return f"({half(1)} * 4294967296::HUGEINT + {half(9)})"


_ZIPF = generate.zeta_fast(100_000, 0.9)
_ETA = (1 - (2 / 100_000) ** (1 - 0.9)) / (1 - generate.zeta(2, 0.9) / _ZIPF)


@query(
    "generate_zipf_gensort",
    f"""WITH u AS (SELECT {_share(1)} AS u FROM range(100000) r(id)),
          k AS (SELECT CASE WHEN u * {_ZIPF!r}::DOUBLE < 1 THEN 0 WHEN u * {_ZIPF!r}::DOUBLE < {1 + 0.5**0.9!r}::DOUBLE THEN 1
            ELSE least(floor(100000 * pow({_ETA!r}::DOUBLE * u - {_ETA!r}::DOUBLE + 1, {1 / (1 - 0.9)!r}::DOUBLE)), 99999) END::BIGINT AS k FROM u)
        SELECT lpad(k::VARCHAR, 10, '0') AS key, count(*) AS n_rows, (90 * count(*))::BIGINT AS n_bytes FROM k GROUP BY 1""",
)
def _gensort(spark, sf_dir) -> DataFrame:
    """Zipf keys of a hundred thousand records: rows and bytes per key."""
    df = generate.zipf_gensort(spark, 100_000, 0.9)
    return df.groupBy(F.decode("key", "UTF-8").alias("key")).agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("value")).alias("n_bytes"))


def _generated(make, spark, sf_dir) -> DataFrame:
    df = make(spark, 20_000)
    return df.groupBy(F.hex("key").alias("key_hex")).agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("value")).alias("n_bytes"))


def _generated_sql(key: str, size: str) -> str:
    """``key`` is an unsigned number of the columns u (share) and r (64 bits); its bytes are written lowest first."""
    hexed = " || ".join(f"substr(h, {15 - 2 * i}, 2)" for i in range(8))
    return f"""WITH g AS (SELECT {_share(1)} AS u, {_bits(2)} AS r FROM range(20000) t(id)),
      k AS (SELECT {key} AS k, {size} AS n FROM g),
      b AS (SELECT upper(lpad(to_hex((k // 4294967296::HUGEINT)::BIGINT), 8, '0') || lpad(to_hex((k % 4294967296::HUGEINT)::BIGINT), 8, '0')) AS h, n FROM k)
      SELECT {hexed} AS key_hex, count(*) AS n_rows, sum(n)::BIGINT AS n_bytes FROM b GROUP BY 1"""


_OTHER = "CASE WHEN r = 42 THEN 43 ELSE r END"
for _n, _f, _k, _v in (
    ("freq_key", generate.freq_key, f"CASE WHEN u < 0.5 THEN 42 ELSE {_OTHER} END", "512"),
    ("heavy_key", generate.heavy_key, f"CASE WHEN u < 0.1 THEN 42 ELSE {_OTHER} END", "CASE WHEN u < 0.1 THEN 32768 ELSE 128 END"),
    ("heavy_range", generate.heavy_range, "CASE WHEN u < 0.2 THEN r % 65536 WHEN r < 65536 THEN r + 65536 ELSE r END", "CASE WHEN u < 0.2 THEN 32768 ELSE 128 END"),
):
    query(f"generate_{_n}", _generated_sql(_k, _v))(partial(_generated, _f))
Q["generate_prefix_skew"] = partial(_generated, generate.prefix_skew)


@query(
    "normalise_trips",
    """SELECT l_orderkey AS vendorid, l_shipdate AS tpep_pickup_datetime, l_extendedprice AS total_amount, NULL::DOUBLE AS airport_fee, l_quantity AS passenger_count FROM lineitem WHERE year(l_shipdate) >= 1995
       UNION ALL SELECT o_orderkey, o_orderdate, o_totalprice, 1.25::DOUBLE, NULL FROM orders WHERE year(o_orderdate) >= 1995""",
)
def normalise_trips(spark, sf_dir):
    """Two tables of different columns, brought to the trips' columns."""
    a = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("VendorID"), F.col("l_shipdate").alias("tpep_pickup_datetime"), F.col("l_extendedprice").alias("Total_Amount"), F.col("l_quantity").cast("string").alias("passenger_count"))
    b = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vendorid"), F.col("o_orderdate").alias("tpep_pickup_datetime"), F.col("o_totalprice").alias("total_amount"), F.lit("1.25").alias("airport_fee"), F.lit("x").alias("passenger_count"))
    return delimited.normalise_trips([a, b], 1995).select("vendorid", "tpep_pickup_datetime", "total_amount", "airport_fee", "passenger_count")
