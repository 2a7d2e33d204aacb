"""Generic tables as inputs of the engine: order lines as a graph and as usage, documents as modules and lines, pages as imports.

Each view comes as a DataFrame and as the SQL of a common table expression of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNEL_SQL = "['direct_calls', 'runtime_calls', 'qualified_refs', 'callback_calls', 'event_bindings', 'api_imports', 'inheritance']"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of neighbouring lines of an order; ids are texts, an edge in five is soft."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    pairs = read(spark, sf_dir, "lineitem").select("l_suppkey", F.lead("l_suppkey").over(w).alias("n"))
    pairs = pairs.filter("n is not null and n <> l_suppkey").distinct()
    kind = F.when((F.col("l_suppkey") + F.col("n")) % 5 == 0, "soft").otherwise("hard")
    return pairs.select(F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("m"), F.col("n").cast("string")).alias("dst"), kind.alias("edge_type"))


EDGES = """edges AS (
  SELECT DISTINCT 'm' || CAST(s AS VARCHAR) AS src, 'm' || CAST(n AS VARCHAR) AS dst, CASE WHEN (s + n) % 5 = 0 THEN 'soft' ELSE 'hard' END AS edge_type
  FROM (SELECT l_suppkey AS s, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS n FROM lineitem)
  WHERE n IS NOT NULL AND n <> s),
hard AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'hard'),
nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
deg AS (
  SELECT id, (SELECT count(*) FROM hard WHERE dst = id) AS in_degree, (SELECT count(*) FROM hard WHERE src = id) AS out_degree FROM nodes)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier (definer), part (symbol) and one of 97 customers' groups (consumer), in the same name space as the graph's nodes."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    channel = F.element_at(F.array(*[F.lit(c) for c in ("direct_calls", "runtime_calls", "qualified_refs", "callback_calls", "event_bindings", "api_imports", "inheritance")]), (F.col("l_partkey") % 7 + 1).cast("int"))
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    return both.select(name(F.col("l_suppkey")).alias("definer"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol"), name(F.col("o_custkey") % 97 + 1).alias("consumer"), channel.alias("channel")).distinct()


USAGE = f"""usage AS (
  SELECT DISTINCT 'm' || CAST(l_suppkey AS VARCHAR) AS definer, 'p' || CAST(l_partkey AS VARCHAR) AS symbol, 'm' || CAST(o_custkey % 97 + 1 AS VARCHAR) AS consumer,
    ({CHANNEL_SQL})[CAST(l_partkey % 7 + 1 AS INT)] AS channel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as modules, their region as one of the known layers."""
    layer = F.element_at(F.array(*[F.lit(x) for x in ("ui", "cli", "engine", "runtime", "contract")]), F.col("n_regionkey") + 1)
    both = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    return both.select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("module_id"), layer.alias("layer"), (F.col("s_suppkey") % 10 == 0).alias("is_test"))


MEMBERS = """members AS (
  SELECT 'm' || CAST(s_suppkey AS VARCHAR) AS module_id, (['ui', 'cli', 'engine', 'runtime', 'contract'])[n_regionkey + 1] AS layer, s_suppkey % 10 = 0 AS is_test
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that suppliers deliver, as symbols; their size says of what kind."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("class", "function", "method", "global")]), (F.col("p_size") % 4 + 1).cast("int"))
    parts = read(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("signature"), "p_name")
    held = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    both = held.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("module_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("symbol"), "kind", "signature")


SYMBOLS = """symbols AS (
  SELECT DISTINCT 'm' || CAST(l_suppkey AS VARCHAR) AS module_id, 'p' || CAST(p_partkey AS VARCHAR) AS symbol,
    (['class', 'function', 'method', 'global'])[CAST(p_size % 4 + 1 AS INT)] AS kind, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS signature
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def owner_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and what they did: type of event and value by fives."""
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner"), F.concat_ws(":", "event_type", F.floor(F.col("value") / 5).cast("string")).alias("item")).distinct()


ITEMS = """items AS (
  SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS owner, event_type || ':' || CAST(CAST(floor(value / 5) AS BIGINT) AS VARCHAR) AS item FROM events)"""


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as modules named by source, language and number."""
    d = read(spark, sf_dir, "documents")
    name = F.concat_ws(".", "source", "lang", F.col("doc_id").cast("string"))
    return d.select(name.alias("module_id"), F.concat(F.translate(name, ".", "/"), F.lit(".py")).alias("path"), "doc_id")


MODULES = """modules AS (
  SELECT source || '.' || lang || '.' || CAST(doc_id AS VARCHAR) AS module_id, replace(source || '.' || lang || '.' || CAST(doc_id AS VARCHAR), '.', '/') || '.py' AS path, doc_id FROM documents)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as definitions: the name is the first word, the text the code."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("module_id"), F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("name"), F.element_at(F.array(F.lit("class"), F.lit("function"), F.lit("variable")), (F.length("lang") + F.ascii("lang") % 2).cast("int") % 3 + 1).alias("type"), F.col("text").alias("code"))


DEFS = r"""defs AS (
  SELECT source || '.' || CAST(doc_id AS VARCHAR) AS module_id, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS name,
    (['class', 'function', 'variable'])[(length(lang) + ascii(lang) % 2) % 3 + 1] AS type, text AS code FROM documents)"""


def page_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as modules: reversed host and path segments, dotted."""
    p = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    name = F.concat_ws(".", F.array_join(F.reverse(F.split(host, r"\.")), "."), F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "."))
    return p.select("page_id", F.regexp_replace(name, r"\.$", "").alias("module_id"))


PAGES = r"""page_modules AS (
  SELECT page_id, regexp_replace(array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')), '.') || '.' ||
    array_to_string(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''), '.'), '\.$', '') AS module_id FROM pages)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal of revisions."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("revision"), F.col("event_type").alias("operation"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("module_id"), "ts", "value")
