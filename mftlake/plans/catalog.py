"""Queries over the driver tables, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mftlake.functions import exprs as X
from mftlake.operators import attributes as A
from mftlake.operators import streams as S
from mftlake.operators import tree as T
from mftlake.plans import treeview as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WITH = f"WITH RECURSIVE {V.ENTRIES_SQL}"


def _known(column: str):
    """A number of a result, -1 where there is none."""
    return F.coalesce(F.col(column), F.lit(-1).cast("bigint")).alias(column)


def query(sql: str):
    """Registers a query under its function's name, with its DuckDB counterpart."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# --- directories -----------------------------------------------------------------------------------------------------


@query(f"""{WITH}
SELECT dir_ref, file_ref, name, is_dir, CASE WHEN is_dir THEN -1 ELSE size END AS size,
       CASE WHEN flags & 1 <> 0 THEN 'R' ELSE ' ' END || CASE WHEN flags & 2 <> 0 THEN 'H' ELSE ' ' END || CASE WHEN flags & 4 <> 0 THEN 'S' ELSE ' ' END AS attributes,
       strftime(ts, '%Y-%m-%d  %H:%M') AS time
FROM entries WHERE file_ref >= 16 AND namespace <> 2 AND name <> ''""")
def dir_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.list_directory(V.entries(spark, sf_dir)).drop("image").withColumn("size", _known("size"))


@query(f"""{WITH}
SELECT dir_ref, count(*) FILTER (WHERE NOT is_dir) AS files, count(*) FILTER (WHERE is_dir) AS directories
FROM entries WHERE file_ref >= 16 AND namespace <> 2 AND name <> '' GROUP BY dir_ref""")
def dir_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.count_entries(V.entries(spark, sf_dir)).drop("image")


@query(f"""{WITH}
SELECT dir_ref, file_ref, name, row_number() OVER (PARTITION BY dir_ref ORDER BY upper(name), name, file_ref) AS place FROM entries""")
def ordered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ordered_listing(V.entries(spark, sf_dir)).drop("image")


@query("SELECT DISTINCT l_orderkey AS record_no FROM lineitem WHERE l_returnflag <> 'R'")
def live_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.table(spark, sf_dir, "lineitem")
    records = lines.select(F.lit("driver").alias("image"), F.col("l_orderkey").alias("record_no"), (F.col("l_returnflag") != "R").alias("in_use"))
    return T.live_references(records).drop("image")


@query(f"""{WITH},
wanted AS (
  SELECT 'C:' || chr(92) || lower(r_name) || chr(92) || upper(n_name) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(92) || upper(c_name) END || CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '' END AS path,
         r_name, n_name, c_name, c_custkey, n_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)
SELECT path, CASE WHEN c_custkey % 5 = 0 THEN -1 WHEN c_custkey % 3 = 0 THEN n_nationkey + 100 ELSE c_custkey + 1000 END AS ref FROM wanted""")
def resolve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: V.table(spark, sf_dir, n)
    joined = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("\\"), F.upper("c_name")))
    odd = F.when(F.col("c_custkey") % 5 == 0, F.lit("x")).otherwise(F.lit(""))
    wanted = joined.select(F.lit("driver").alias("image"), F.concat(F.lit("C:\\"), F.lower("r_name"), F.lit("\\"), F.upper("n_name"), leaf, odd).alias("path"))
    return T.resolve_paths(V.entries(spark, sf_dir), wanted, depth=4).select("path", _known("ref"))


_CLIMB = """,
up AS (
  SELECT file_ref AS ref, dir_ref AS parent, name AS path, 1 AS depth FROM {start}
  UNION ALL
  SELECT up.ref, e.dir_ref, e.name || chr(92) || up.path, depth + 1 FROM up JOIN entries e ON up.parent = e.file_ref WHERE depth < 16
),
paths AS (SELECT ref, arg_max(path, depth) AS path FROM up GROUP BY ref)"""


@query(f"{WITH}{_CLIMB.format(start='entries')} SELECT ref, path FROM paths")
def full_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.full_paths(V.nodes(spark, sf_dir), V.DEPTH).select("ref", "path")


@query(f"""{WITH},
hits AS (SELECT * FROM entries WHERE regexp_full_match(name, '(order[0-9]*7|Customer.*9|[A-M].*)') ORDER BY file_ref LIMIT 5000)
{_CLIMB.format(start='hits')}
SELECT ref, path, strftime(ts, '%Y-%m-%d  %H:%M') AS time FROM paths JOIN hits ON ref = file_ref""")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.search(V.nodes(spark, sf_dir), "(order[0-9]*7|Customer.*9|[A-M].*)", V.DEPTH).drop("image")


@query("SELECT CAST(l_partkey AS BIGINT) AS ref, min(l_suppkey) AS parent FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY l_partkey")
def parent_map_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = V.table(spark, sf_dir, "lineitem").select(F.lit("driver").alias("image"), F.col("l_suppkey").alias("dir_ref"), F.col("l_partkey").alias("file_ref"))
    return T.parent_map(links).drop("image")


@query(f"""{WITH},
wanted AS (SELECT c_nationkey + 100 AS dir_ref, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE 'none' END AS component FROM customer)
SELECT w.dir_ref, w.component, coalesce(min(e.file_ref), -1) AS file_ref, coalesce(arg_min(e.is_dir, e.file_ref), false) AS is_dir
FROM (SELECT CAST(dir_ref AS BIGINT) AS dir_ref, component, row_number() OVER () AS r FROM wanted) w LEFT JOIN entries e ON w.dir_ref = e.dir_ref AND lower(w.component) = lower(e.name)
GROUP BY w.r, w.dir_ref, w.component""")
def find_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    component = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.lit("none"))
    wanted = V.table(spark, sf_dir, "customer").select(F.lit("driver").alias("image"), (F.col("c_nationkey") + V.NATION).cast("bigint").alias("dir_ref"), component.alias("component"))
    found = T.find_entry(V.entries(spark, sf_dir), wanted)
    return found.select("dir_ref", "component", _known("file_ref"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"))


@query("""
SELECT l_orderkey AS dir_ref, o_orderkey AS file_ref, l_linenumber AS file_seq, o_orderkey % 7 AS seq_no, coalesce(o_orderkey % 7 <> l_linenumber, true) AS stale
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def entry_to_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.lit("driver").alias("image")
    found = V.table(spark, sf_dir, "lineitem").select(image, F.col("l_orderkey").alias("dir_ref"), F.col("l_orderkey").alias("file_ref"), F.col("l_linenumber").alias("file_seq"))
    records = V.table(spark, sf_dir, "orders").select(image, F.col("o_orderkey").alias("record_no"), (F.col("o_orderkey") % 7).alias("seq_no"), F.lit(True).alias("in_use"))
    return T.directory_entries(found, records).drop("image", "in_use")


# --- attributes ------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey % 500 AS record_no, arg_min(p_name, p_partkey) AS name FROM part WHERE p_partkey % 4 <> 2 AND p_name <> '' GROUP BY 1")
def first_win32_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = V.table(spark, sf_dir, "part").select(
        F.lit("driver").alias("image"), (F.col("p_partkey") % 500).alias("record_no"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 4).alias("namespace"), F.col("p_name").alias("name")
    )
    return A.first_name(names).drop("image")


@query("""
SELECT o_custkey AS record_no, coalesce(arg_min(CAST(floor(o_totalprice) AS BIGINT), o_orderkey), 0) AS size FROM orders GROUP BY 1
UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def first_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.lit("driver").alias("image")
    records = V.table(spark, sf_dir, "customer").select(image, F.col("c_custkey").alias("record_no"))
    orders = V.table(spark, sf_dir, "orders").select(image, F.col("o_custkey").alias("record_no"), F.col("o_orderkey").alias("ord"), F.floor("o_totalprice").cast("bigint").alias("real_size"))
    return A.first_sizes(records, orders).drop("image")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attributes: a record per user, slots by event."""
    return V.table(spark, sf_dir, "events").select(
        F.lit("driver").alias("image"), F.col("user_id").alias("record_no"), F.col("event_id").alias("ord"), (F.col("event_id") % 16).cast("int").alias("slot"), F.col("event_type").alias("name"), F.col("value")
    )


_EVENTS = "SELECT user_id AS record_no, event_id AS ord, CAST(event_id % 16 AS INTEGER) AS slot, event_type AS name, value FROM events"


@query(f"SELECT slot, count(*) AS n, min(ord) AS first_ord FROM ({_EVENTS}) WHERE (1 << slot) & 2309 <> 0 GROUP BY slot")
def attr_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.masked(_events(spark, sf_dir), 2309).groupBy("slot").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query(f"SELECT record_no, ord, name FROM ({_EVENTS}) WHERE slot = 7")
def attrs_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.of_type(_events(spark, sf_dir), 7).select("record_no", "ord", "name")


@query(f"""
SELECT o_orderkey AS record_no, o_orderkey % 3 = 0 AS deleted, o_orderkey % 2 = 0 AS directory,
       coalesce(p & 1 <> 0, false) AS read_only, coalesce(p & 2 <> 0, false) AS hidden, coalesce(p & 4 <> 0, false) AS system,
       false AS sparse, false AS compressed, false AS encrypted
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {V.FLAGS_SQL} END AS p FROM orders)""")
def std_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders").select(F.lit("driver").alias("image"), F.col("o_orderkey").alias("record_no"), V.order_flags().alias("permission"))
    live = F.when(F.col("record_no") % 3 == 0, F.lit(0)).otherwise(F.lit(1)) + F.when(F.col("record_no") % 2 == 0, F.lit(2)).otherwise(F.lit(0))
    information = orders.filter("record_no % 5 <> 0").withColumn("ord", F.lit(0))
    return A.record_flags(orders.select("image", "record_no", live.alias("flags")), information).drop("image")


@query(f"""SELECT record_no, ord, slot FROM ({_EVENTS})
WHERE NOT coalesce(CASE WHEN slot = 3 THEN value > 50 WHEN slot = 5 THEN true END, CASE WHEN slot IN (3, 7) THEN value > 10 END, false)""")
def discard_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.when(F.col("slot") == 3, F.col("value") > 50).when(F.col("slot") == 5, F.lit(True))
    volume = F.when(F.col("slot").isin(3, 7), F.col("value") > 10)
    return A.keep(_events(spark, sf_dir), record, volume).select("record_no", "ord", "slot")


@query(f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY record_no ORDER BY slot, ord) AS visit FROM ({_EVENTS}) WHERE (1 << slot) & 65535 <> 0),
s AS (SELECT record_no, min(visit) AS last FROM v WHERE name = 'purchase' OR slot = 9 GROUP BY record_no)
SELECT record_no, slot, ord, CAST(visit AS INTEGER) AS visit FROM v LEFT JOIN s USING (record_no) WHERE last IS NULL OR visit <= last""")
def attr_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = (F.col("name") == "purchase") | (F.col("slot") == 9)
    return A.traverse(_events(spark, sf_dir), 0xFFFF, stop).select("record_no", "slot", "ord", "visit")


@query("""
WITH attr AS (SELECT o_orderkey AS record_no, o_orderkey AS ord, CAST(o_orderkey % 16 AS INTEGER) AS slot FROM orders),
items AS (SELECT DISTINCT l_suppkey AS record_no, l_orderkey AS target_ref, CAST(l_linenumber AS INTEGER) AS slot FROM lineitem WHERE l_suppkey <> l_orderkey)
SELECT record_no, record_no AS src_record_no, ord, slot FROM attr
UNION ALL
SELECT i.record_no, a.record_no, a.ord, a.slot FROM items i JOIN attr a ON i.target_ref = a.record_no AND i.slot = a.slot""")
def attr_list_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.lit("driver").alias("image")
    own = V.table(spark, sf_dir, "orders").select(image, F.col("o_orderkey").alias("record_no"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 16).cast("int").alias("slot"))
    items = V.table(spark, sf_dir, "lineitem").select(image, F.col("l_suppkey").alias("record_no"), F.col("l_orderkey").alias("target_ref"), F.col("l_linenumber").cast("int").alias("slot"))
    return A.merge_lists(own, items).select("record_no", "src_record_no", "ord", "slot")


@query(f"""
WITH attr AS (SELECT *, CASE WHEN ord % 3 = 0 THEN name ELSE '' END AS own, name || ':' || name || ':' || name AS body FROM ({_EVENTS})),
cut AS (SELECT record_no, ord, slot, own, body, unnest(range(0, greatest(strlen(body), 1), 16)) AS i FROM attr),
lines AS (SELECT *, rpad(hex(substr(body, i + 1, 16)), 32, 'F') AS d, rpad(substr(body, i + 1, 16), 16, '.') AS letters, CASE WHEN strlen(body) - i <= 8 THEN 8 ELSE 16 END AS width FROM cut)
SELECT record_no, ord,
       ['STANDARD_INFORMATION', 'ATTRIBUTE_LIST', 'FILE_NAME', 'OBJECT_ID', 'SECURITY_DESCRIPTOR', 'VOLUME_NAME', 'VOLUME_INFORMATION', 'DATA',
        'INDEX_ROOT', 'INDEX_ALLOCATION', 'BITMAP', 'REPARSE_POINT', 'EA_INFORMATION', 'EA', 'PROPERTY_SET', 'LOGGED_UTILITY_STREAM'][slot + 1]
         || CASE WHEN own <> '' THEN ' (' || own || ')' ELSE '' END AS label,
       CAST(i // 16 AS INTEGER) AS line_no, substr(letters, 1, width) AS ascii,
       substr(rtrim(regexp_replace(substr(d, 1, 16), '(..)', '\\1 ', 'g')) || ' - ' || rtrim(regexp_replace(substr(d, 17, 16), '(..)', '\\1 ', 'g')), 1, width * 3 + 1 - CASE width WHEN 8 THEN 2 ELSE 0 END) AS hex
FROM lines""")
def attr_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    rows = _events(spark, sf_dir).withColumn("body", F.encode(F.concat_ws(":", name, name, name), "UTF-8")).withColumn("name", F.when(F.col("ord") % 3 == 0, name).otherwise(F.lit("")))
    return A.dump(rows).select("record_no", "ord", "label", "line_no", "ascii", "hex")


def _name_flags_sql() -> str:
    return ", ".join(f"o_orderkey * 7919 % 536870912 & {bit} <> 0 AS {name}" for name, bit in A.NAME_FLAGS.items())


@query(f"SELECT o_custkey AS record_no, o_orderkey AS ord, {_name_flags_sql()} FROM orders")
def name_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders")
    return A.name_flags(orders.select(F.lit("driver").alias("image"), F.col("o_custkey").alias("record_no"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * 7919 % 536870912).alias("flags"))).drop("image")


@query("""
SELECT c_custkey AS record_no, coalesce(k * 3, 0) AS create_ft, coalesce(k * 5, 0) AS alter_ft, coalesce(k * 7, 0) AS mft_ft, coalesce(k * 11, 0) AS read_ft
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey) ON c_custkey = o_custkey""")
def first_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    image, key = F.lit("driver").alias("image"), F.col("o_orderkey")
    records = V.table(spark, sf_dir, "customer").select(image, F.col("c_custkey").alias("record_no"))
    # a third of the orders stand for standard information, so that some records have none
    information = V.table(spark, sf_dir, "orders").filter(key % 3 == 0).select(image, F.col("o_custkey").alias("record_no"), key.alias("ord"), *((key * n).alias(t) for n, t in zip((3, 5, 7, 11), A.TIMES)))
    return A.first_times(records, information).drop("image")


# --- extents and streams ---------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream per customer whose extents are its orders."""
    return V.table(spark, sf_dir, "orders").select(
        F.lit("driver").alias("image"), F.col("o_custkey").alias("record_no"), F.lit(0).alias("attr"), F.col("o_orderkey").alias("run_no"), (F.col("o_orderkey") % 7 + 1).alias("clusters"), (F.col("o_orderkey") % 11 - 3).alias("delta")
    )


_PLACED = """
runs AS (SELECT o_custkey AS record_no, o_orderkey AS run_no, o_orderkey % 7 + 1 AS clusters, o_orderkey % 11 - 3 AS delta FROM orders),
summed AS (
  SELECT *, CAST(sum(clusters) OVER w AS BIGINT) - clusters AS start_vcn, CAST(sum(delta) OVER w AS BIGINT) AS spot FROM runs
  WINDOW w AS (PARTITION BY record_no ORDER BY run_no ROWS UNBOUNDED PRECEDING)
),
placed AS (
  SELECT record_no, run_no, clusters, start_vcn, start_vcn + clusters - 1 AS last_vcn, CASE WHEN delta <> 0 THEN spot END AS lcn,
         min(spot) OVER (PARTITION BY record_no ORDER BY run_no ROWS UNBOUNDED PRECEDING) >= 0 AS valid
  FROM summed
)"""


@query(f"WITH {_PLACED} SELECT record_no, run_no, clusters, start_vcn, last_vcn, coalesce(lcn, -1) AS lcn, valid FROM placed")
def data_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.place_runs(_runs(spark, sf_dir)).drop("image", "attr").withColumn("lcn", _known("lcn"))


@query(f"""WITH {_PLACED}
SELECT r.record_no, r.vcn, coalesce(p.run_no, -1) AS run_no, coalesce(p.lcn + r.vcn - p.start_vcn, -1) AS lcn
FROM (SELECT o_custkey AS record_no, o_orderkey % 40 AS vcn FROM orders) r LEFT JOIN placed p ON r.record_no = p.record_no AND r.vcn BETWEEN p.start_vcn AND p.last_vcn""")
def vcn_to_lcn(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    requests = runs.select("image", "record_no", "attr", (F.col("run_no") % 40).alias("vcn"))
    return S.locate(requests, S.place_runs(runs)).select("record_no", "vcn", _known("run_no"), _known("lcn"))


@query(f"""WITH {_PLACED}, cut AS (SELECT *, unnest(range(0, clusters, 3)) AS i FROM placed WHERE valid)
SELECT record_no, start_vcn + i AS vcn, coalesce(lcn + i, -1) AS lcn, least(3, clusters - i) AS count FROM cut""")
def read_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_tasks(S.place_runs(_runs(spark, sf_dir)), 3).drop("image", "attr").withColumn("lcn", _known("lcn"))


@query("SELECT o_orderkey AS record_no, o_orderkey % 7 + 1 AS clusters, (o_orderkey * 37) % 100000 - 50000 AS delta FROM orders")
def run_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as the volume stores them, then decoded by the relation builder's own decoder."""
    from mftlake.sources import relations as R

    delta = (F.col("o_orderkey") * 37) % 100_000 - 50_000
    unsigned = F.when(delta < 0, delta + (1 << 24)).otherwise(delta)
    raw = F.concat(F.unhex(F.lit("32")), X.le_bytes(F.col("o_orderkey") % 7 + 1, 2), X.le_bytes(unsigned, 3), F.unhex(F.lit("00")))
    coded = V.table(spark, sf_dir, "orders").select(F.lit("driver").alias("image"), F.col("o_orderkey").alias("record_no"), F.lit(0).alias("attr"), raw.alias("runs"))
    return R.decode_runs(coded).select("record_no", "clusters", "delta")


@query("SELECT o_orderkey AS u64, CAST(o_custkey % 65536 AS BIGINT) AS u16, o_orderkey % 256 AS u8, CAST(o_orderkey % 65536 - CASE WHEN o_orderkey % 65536 >= 32768 THEN 65536 ELSE 0 END AS BIGINT) AS s16, CAST((o_orderkey * 4295) % 281474976710656 AS BIGINT) AS ref, CAST(o_custkey % 1000 AS INTEGER) AS seq FROM orders")
def le_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    packed = F.call_function("shiftleft", c % 1000, F.lit(48)).bitwiseOR((k * 4295) % (1 << 48))
    raw = F.concat(X.le_bytes(k, 7), X.le_bytes(c % 65536, 2), X.le_bytes(k % 256, 1), X.le_bytes(k % 65536, 2), X.le_bytes(packed, 8)).alias("raw")
    rows = V.table(spark, sf_dir, "orders").select(raw)
    at = lambda o, w: X.le_uint(F.col("raw"), o, w)
    whole = at(12, 8).cast("bigint")
    return rows.select(at(0, 7).alias("u64"), at(7, 2).alias("u16"), at(9, 1).alias("u8"), X.sign_extend(at(10, 2), 2).alias("s16"), X.reference(whole).alias("ref"), X.reference_sequence(whole).alias("seq"))


@query("SELECT o_orderkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) * 10 + 116444736000000000 AS ticks, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS micros FROM orders")
def filetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = X.filetime(F.col("o_orderdate"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", ticks.alias("ticks"), F.unix_micros(X.from_filetime(ticks)).alias("micros"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d  %H:%M') AS time FROM events")
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").select("event_id", X.format_time(F.col("ts")).alias("time"))


@query("""
WITH h AS (SELECT doc_id, substr(hex(encode(text)), 1, 32768) AS h FROM documents),
lines AS (SELECT doc_id, h, unnest(range(0, len(h) // 2, 16)) AS i FROM h WHERE h <> ''),
padded AS (SELECT doc_id, i, rpad(substr(h, i * 2 + 1, 32), 32, 'F') AS d FROM lines)
SELECT doc_id, i // 16 AS line_no, lpad(printf('%X', i), 4, '0') AS "offset",
       rtrim(regexp_replace(substr(d, 1, 16), '(..)', '\\1 ', 'g')) || ' - ' || rtrim(regexp_replace(substr(d, 17, 16), '(..)', '\\1 ', 'g')) AS hex,
       list_aggregate(list_transform(range(0, 16), lambda k: CASE WHEN substr(d, k * 2 + 1, 2) BETWEEN '20' AND '7E' THEN chr(CAST(('0x' || substr(d, k * 2 + 1, 2)) AS INTEGER)) ELSE '.' END), 'string_agg', '') AS ascii
FROM padded""")
def hexdump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hexdump(_streams(spark, sf_dir), "doc_id")


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4096 <= octet_length(encode(text)) THEN substr(hex(encode(text)), (doc_id % 4096) * 2 + 1, 200) END AS part FROM documents""")
def stream_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streams(spark, sf_dir).withColumn("offset", F.col("doc_id") % 4096).withColumn("length", F.lit(100))
    return S.read_range(rows).select("doc_id", F.hex("part").alias("part"))


@query("""
WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
c AS (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 4095) // 4096)) AS chunk_no FROM h)
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(len(substr(h, chunk_no * 8192 + 1, 8192)) // 2 AS BIGINT) AS n_bytes, md5(substr(h, chunk_no * 8192 + 1, 8192)) AS digest FROM c""")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(_streams(spark, sf_dir), 4096).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.octet_length("bytes").cast("bigint").alias("n_bytes"), F.md5(F.hex("bytes")).alias("digest"))


@query(f"""SELECT record_no, min(ord) AS ord, arg_min(value, ord) AS value FROM ({_EVENTS}) WHERE slot = 7 AND name = 'click' GROUP BY record_no""")
def find_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find_stream(_events(spark, sf_dir), "click").select("record_no", "ord", "value")


def _bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bitmap whose bytes come from parts."""
    return V.table(spark, sf_dir, "part").select(F.lit("driver").alias("image"), F.col("p_partkey").alias("byte_no"), (F.col("p_partkey") * 37 % 256).cast("int").alias("b"))


@query("""
SELECT o_orderkey AS cluster, coalesce((b >> (o_orderkey % 8)) & 1 = 0, true) AS free
FROM orders LEFT JOIN (SELECT p_partkey AS byte_no, CAST(p_partkey * 37 % 256 AS INTEGER) AS b FROM part) ON o_orderkey // 8 = byte_no""")
def bitmap_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = V.table(spark, sf_dir, "orders").select(F.lit("driver").alias("image"), F.col("o_orderkey").alias("cluster"))
    return S.clusters_free(wanted, _bitmap(spark, sf_dir)).drop("image")


@query("""
SELECT CAST(count(*) * 8 - sum(bit_count(CAST(p_partkey * 37 % 256 AS INTEGER))) AS BIGINT) AS free_clusters, CAST(sum(bit_count(CAST(p_partkey * 37 % 256 AS INTEGER))) AS BIGINT) AS used_clusters,
       CAST((count(*) * 8 - sum(bit_count(CAST(p_partkey * 37 % 256 AS INTEGER)))) * 4096 AS BIGINT) AS free_bytes
FROM part""")
def free_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.free_space(_bitmap(spark, sf_dir), 4096).drop("image")


@query("""
SELECT p_partkey, CAST(CASE WHEN c > 0 THEN c * 512 * s ELSE 1 << CAST(-c AS INTEGER) END AS BIGINT) AS record_size, CAST(512 * s AS BIGINT) AS cluster_size,
       CAST(p_partkey * 512 * s AS BIGINT) AS mft_addr
FROM (SELECT p_partkey, CAST(p_partkey % 21 - 12 AS BIGINT) AS c, CAST(1 << CAST(p_size % 8 AS INTEGER) AS BIGINT) AS s FROM part)""")
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 21 - 12).alias("c"), F.call_function("shiftleft", F.lit(512).cast("bigint"), (F.col("p_size") % 8).cast("int")).alias("cluster_size"))
    return rows.select("p_partkey", X.size_code(F.col("c"), F.col("cluster_size")).alias("record_size"), "cluster_size", (F.col("p_partkey") * F.col("cluster_size")).alias("mft_addr"))


@query(r"""
SELECT page_id, upper(regexp_extract('"' || chr(65 + CAST(page_id % 26 AS INTEGER)) || ':\' || replace(url, '/', '\') || '\"', '^["\s]*([A-Za-z])\s*:', 1)) AS volume,
       array_to_string(list_filter(string_split(replace(url, '/', '\'), '\'), lambda p: p <> ''), '|') AS parts
FROM pages""")
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit('"'), F.char(F.col("page_id") % 26 + 65), F.lit(":\\"), F.replace("url", F.lit("/"), F.lit("\\")), F.lit('\\"'))
    return V.table(spark, sf_dir, "pages").select("page_id", X.path_volume(path).alias("volume"), F.array_join(X.path_parts(path), "|").alias("parts"))
