"""Name and content search, the catalogue, and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytefleet.functions import scalars as X
from bytefleet.functions.text import hex_inside, inside_matches
from bytefleet.operators import listing, search
from bytefleet.plans.tables import table
from bytefleet.plans.views import DOCUMENTS_SQL, documents, parts, up


def _size():
    return F.char_length("text").cast("bigint").alias("size")


def _inside(pattern, case_sensitive=False):
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents")
        return docs.filter(inside_matches(F.col("text"), pattern, case_sensitive)).select("doc_id", "source", _size())

    return run


def _named(pattern, case_sensitive=False):
    def run(spark, sf_dir):
        return search.search(parts(spark, sf_dir), pattern, case_sensitive=case_sensitive).select("p_partkey", "file_name")

    return run


def inside_hex(spark, sf_dir):
    return documents(spark, sf_dir).filter(hex_inside(F.col("data"), "746865")).select("doc_id")


def prefix_filter(spark, sf_dir):
    f = documents(spark, sf_dir).filter((F.octet_length("data") >= 3) & F.hex(F.substring("data", 1, 2)).isin("5468", "416E", "C389"))
    return f.select("doc_id", F.hex(F.substring("data", 1, 2)).alias("prefix"))


def platform_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.unhex(F.element_at(F.array(*[F.lit(v) for v in X.PLATFORMS.values()]), (F.col("p_partkey") % 6 + 1).cast("int"))), F.encode("p_name", "UTF-8")).alias("data")).filter(X.on_platform(F.col("data"), "C64", "C128")).select("p_partkey")


def catalog_export(spark, sf_dir):
    f = documents(spark, sf_dir)
    return search.catalog(f)


def catalog_images(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    files = t.select(F.col("conv_id").cast("string").alias("image"), F.concat_ws("#", "role", F.col("turn").cast("string")).alias("file_name"), F.col("turn").alias("ord"), F.encode("text", "UTF-8").alias("data"), F.col("role").alias("file_type"))
    images = t.groupBy(F.col("conv_id").cast("string").alias("image")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x")).select("image", F.encode(F.array_join(F.col("x.text"), ""), "UTF-8").alias("content"))
    return search.catalog(files, images)


def list_projection(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", listing.list_lines(F.col("file_name"), F.col("file_type")).alias("line"))


def dir_projection(spark, sf_dir):
    f = documents(spark, sf_dir)
    return f.select("doc_id", listing.dir_lines(X.blocks_up(F.octet_length("data")), F.col("file_name"), F.col("file_type")).alias("line"))


def path_lookup_ci(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("path"))
    return listing.lookup(p, "path", "red widget", "p_brand").select("p_brand", "path")


def depth_mask_exclude(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("path", F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", "")))
    name = X.base_name(F.col("path"))
    return p.filter(listing.within_depth(F.col("path"), "", 3) & ~listing.excluded(F.col("path"), "7", "[xz]$") & (F.char_length(name) > 0)).select("page_id", name.alias("name"))


def glob_mask(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(listing.glob(F.col("c_name"), "CUST*#*1?")).select("c_custkey")


def ext_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", X.extension(F.concat(F.regexp_extract("url", "([^/]*)$", 1), F.element_at(F.array(F.lit(".d64"), F.lit(".T64.gz"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")))).alias("ext"))
    return p.filter(F.col("ext").isin("D64", "GZ"))


def size_cap(spark, sf_dir):
    return search.present(documents(spark, sf_dir), "data", 5000).select("doc_id", F.octet_length("data").cast("bigint").alias("size"))


def subtree(spark, sf_dir):
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    tree = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).join(customer, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))
    return listing.subtree(tree, "path", "ASIA")


def descendants(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    edges = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent")).unionByName(customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent")))
    return listing.descendants(edges, spark.range(1).select(F.lit("r2").alias("node"))).select("node", F.col("depth").cast("bigint").alias("depth"))


def next_start_fix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_seconds(F.col("ts").cast("timestamp")) % 40000).alias("start"), F.when(F.col("event_id") % 3 == 0, 50118).otherwise(F.unix_seconds(F.col("ts").cast("timestamp")) % 40000 + 7).cast("bigint").alias("end"))
    return listing.repaired_ends(e, "user_id", "start", "end", F.lit(65536).cast("bigint")).select("event_id", "user_id", "start", "end_fixed")


def solid_offsets(spark, sf_dir):
    f = documents(spark, sf_dir).withColumn("n", F.octet_length("data").cast("bigint"))
    return listing.offsets(f, "image", "ord", "n").select("doc_id", "offset")


def file_numbers(spark, sf_dir):
    return search.numbered(documents(spark, sf_dir), "image", "ord").select("doc_id", "filenum")


def partition_addr(spark, sf_dir):
    k = F.col("p_partkey").cast("bigint")
    return table(spark, sf_dir, "part").select("p_partkey", (X.big_endian(F.substring(X.number_bytes(k * 7919), 1, 3), 1, 3) * 512).alias("address"), X.long_hex(k % 70000).alias("digits"), X.little_endian(X.number_bytes(k * 65537, 8), 1, 8).alias("back"))


def scalar_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.pad_right(F.col("p_brand"), 12).alias("padded"), X.base_name(F.col("p_type")).alias("base"), X.lineage(F.col("p_brand"), F.col("p_name")).alias("lineage"), X.to_integer(F.regexp_extract("p_brand", "([0-9]*)$", 1)).cast("bigint").alias("number"), X.is_integer(F.col("p_type")).alias("is_number"), X.blocks_up(F.col("p_size") * 100).alias("up"), X.blocks_down(F.col("p_size") * 100).alias("down"), X.blocks_next(F.col("p_size") * 100).alias("next"))


def scalar_bytes(spark, sf_dir):
    d = F.encode("p_name", "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", X.unsigned(d, 2).cast("bigint").alias("second"), X.to_hex(d).alias("digits"), X.bit(F.col("p_size"), F.col("p_partkey")).alias("lsb"), X.bit(F.col("p_size"), F.col("p_partkey"), True).alias("msb"), X.filled(F.encode(F.repeat(F.lit("a"), F.col("p_size") % 3), "UTF-8")).alias("uniform"), X.equal_range(d, F.encode("p_type", "UTF-8"), 1, 1).alias("same"))


def report_order(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return listing.report_order(n.select("r_name", "n_name"), "r_name", "n_name")


def xor_hash(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.xor_hash(F.encode("text", "UTF-8")).alias("hash"))


QUERIES = {
    "inside_ci": _inside("in the"),
    "inside_cs": _inside("The ", True),
    "inside_wild": _inside("t?e and"),
    "inside_hex": inside_hex,
    "name_exact": _named("small ring"),
    "name_prefix": _named("red%"),
    "name_suffix_first": _named("%ring"),
    "name_inside_first": _named("%re%"),
    "name_question": _named("?ed%"),
    "name_skip_question": _named("%b?l%"),
    "name_case": _named("re%", True),
} | {
    f.__name__: f
    for f in (prefix_filter, platform_filter, catalog_export, catalog_images, list_projection, dir_projection, path_lookup_ci, depth_mask_exclude, glob_mask, ext_filter, size_cap, subtree, descendants, next_start_fix, solid_offsets, file_numbers, partition_addr, scalar_text, scalar_bytes, report_order, xor_hash)
}


def _inside_sql(condition: str) -> str:
    return f"SELECT doc_id, source, CAST(length(text) AS BIGINT) AS size FROM documents WHERE {condition}"


def _name_sql(condition: str) -> str:
    return f"WITH p AS (SELECT p_partkey, p_name AS file_name, {up('p_name')} AS u FROM part) SELECT p_partkey, file_name FROM p WHERE {condition}"


_PATHS = "p AS (SELECT page_id, '/' || regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"
ORACLE_SQL = {
    "inside_ci": _inside_sql(f"contains({up('text')}, 'IN THE')"),
    "inside_cs": _inside_sql("contains(text, 'The ')"),
    "inside_wild": _inside_sql(f"regexp_matches({up('text')}, 'T.E AND', 's')"),
    "inside_hex": "SELECT doc_id FROM documents WHERE contains(text, 'the')",
    "name_exact": _name_sql("u = 'SMALL RING'"),
    "name_prefix": _name_sql("starts_with(u, 'RED')"),
    "name_suffix_first": _name_sql("strpos(u, 'R') > 0 AND substr(u, strpos(u, 'R')) = 'RING'"),
    "name_inside_first": _name_sql("strpos(u, 'R') > 0 AND starts_with(substr(u, strpos(u, 'R')), 'RE')"),
    "name_question": _name_sql("length(u) >= 3 AND substr(u, 2, 2) = 'ED'"),
    "name_skip_question": _name_sql("strpos(u, 'B') > 0 AND regexp_matches(substr(u, strpos(u, 'B')), '^B.L') AND length(u) - strpos(u, 'B') + 1 > 2"),
    "name_case": "SELECT p_partkey, p_name AS file_name FROM part WHERE starts_with(p_name, 're')",
    "prefix_filter": f"WITH {DOCUMENTS_SQL} SELECT doc_id, left(hex(data), 4) AS prefix FROM f WHERE octet_length(data) >= 3 AND left(hex(data), 4) IN ('5468', '416E', 'C389')",
    "platform_filter": "SELECT p_partkey FROM part WHERE p_partkey % 6 IN (2, 4)",
    "catalog_export": f"WITH {DOCUMENTS_SQL} SELECT image AS imagepath, file_name AS filename, row_number() OVER (PARTITION BY image ORDER BY ord) AS filenum, octet_length(data) AS size, upper(md5(text)) AS md5, lower(file_type) AS filetype FROM f",
    "catalog_images": """WITH w AS (SELECT CAST(conv_id AS VARCHAR) AS imagepath, string_agg(text, '' ORDER BY turn, role, text) AS content FROM conversations GROUP BY conv_id)
SELECT imagepath, '*' AS filename, CAST(0 AS BIGINT) AS filenum, octet_length(encode(content)) AS size, upper(md5(content)) AS md5, 'dsk' AS filetype FROM w
UNION ALL SELECT CAST(conv_id AS VARCHAR), concat_ws('#', role, CAST(turn AS VARCHAR)), row_number() OVER (PARTITION BY conv_id ORDER BY turn), octet_length(encode(text)), upper(md5(text)), lower(role) FROM conversations""",
    "list_projection": f"WITH {DOCUMENTS_SQL} SELECT doc_id, file_name || ',' || left(lower(file_type), 1) AS line FROM f",
    "dir_projection": f"""WITH {DOCUMENTS_SQL}, g AS (SELECT doc_id, CAST(CAST(ceil(octet_length(data) / 254.0) AS BIGINT) AS VARCHAR) AS b, '"' || file_name || '"' AS q, lower(file_type) AS t FROM f)
SELECT doc_id, CASE WHEN length(b) < 5 THEN rpad(b, 5, ' ') ELSE b END || CASE WHEN length(q) < 24 THEN rpad(q, 24, ' ') ELSE q END || t AS line FROM g""",
    "path_lookup_ci": f"WITH r AS (SELECT p_brand, p_name AS path, row_number() OVER (PARTITION BY p_brand ORDER BY (p_name = 'red widget') DESC, p_name) AS n FROM part WHERE {up('p_name')} = 'RED WIDGET') SELECT p_brand, path FROM r WHERE n = 1",
    "depth_mask_exclude": f"WITH {_PATHS}, q AS (SELECT page_id, path, list_last(string_split(path, '/')) AS name FROM p) SELECT page_id, name FROM q WHERE len(string_split(substr(path, 2), '/')) - 1 <= 3 AND NOT contains(path, '7') AND NOT regexp_matches(path, '[xz]$') AND length(name) > 0",
    "glob_mask": f"SELECT c_custkey FROM customer WHERE regexp_full_match({up('c_name')}, 'CUST.*#.*1.', 's')",
    "ext_filter": "WITH p AS (SELECT page_id, upper(regexp_extract(regexp_extract(url, '([^/]*)$', 1) || ['.d64', '.T64.gz', ''][page_id % 3 + 1], '\\.([^.]*)$', 1)) AS ext FROM pages) SELECT page_id, ext FROM p WHERE ext IN ('D64', 'GZ')",
    "size_cap": "SELECT doc_id, octet_length(encode(text)) AS size FROM documents WHERE octet_length(encode(text)) <= 5000",
    "subtree": "SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS path FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'",
    "descendants": "SELECT 'r2' AS node, CAST(0 AS BIGINT) AS depth UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
    "next_start_fix": """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) % 40000 AS start, CASE WHEN event_id % 3 = 0 THEN 50118 ELSE CAST(floor(epoch(ts)) AS BIGINT) % 40000 + 7 END AS e FROM events),
s AS (SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nx FROM (SELECT DISTINCT user_id, start FROM e))
SELECT event_id, e.user_id, e.start, CAST(CASE WHEN e.e = 50118 THEN coalesce(nx - 1, 65535) ELSE e.e END AS BIGINT) AS end_fixed FROM e JOIN s ON e.user_id = s.user_id AND e.start = s.start""",
    "solid_offsets": "SELECT doc_id, CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents",
    "file_numbers": "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS filenum FROM documents",
    "partition_addr": """SELECT p_partkey, CAST((((p_partkey * 7919) % 256) * 65536 + ((p_partkey * 7919) // 256 % 256) * 256 + (p_partkey * 7919) // 65536 % 256) * 512 AS BIGINT) AS address,
CASE WHEN p_partkey % 70000 = 0 THEN '' WHEN length(to_hex(p_partkey % 70000)) % 2 = 1 THEN '0' || to_hex(p_partkey % 70000) ELSE to_hex(p_partkey % 70000) END AS digits, CAST(p_partkey * 65537 AS BIGINT) AS back FROM part""",
    "scalar_text": """SELECT p_partkey, CASE WHEN length(p_brand) < 12 THEN rpad(p_brand, 12, ' ') ELSE p_brand END AS padded, list_last(string_split(p_type, '/')) AS base, p_brand || '@' || p_name AS lineage,
CAST(coalesce(TRY_CAST(regexp_extract(p_brand, '([0-9]*)$', 1) AS INTEGER), 0) AS BIGINT) AS number, coalesce(TRY_CAST(p_type AS INTEGER) > 0, false) AS is_number,
CAST(ceil(p_size * 100 / 254.0) AS BIGINT) AS up, CAST(floor(p_size * 100 / 254.0) AS BIGINT) AS down, CAST(floor(p_size * 100 / 254.0) AS BIGINT) + 1 AS next FROM part""",
    "scalar_bytes": """SELECT p_partkey, CAST(ascii(substr(p_name, 2, 1)) AS BIGINT) AS second, hex(encode(p_name)) AS digits, (p_size >> CAST(p_partkey % 8 AS INTEGER)) & 1 = 1 AS lsb, (p_size >> CAST(7 - p_partkey % 8 AS INTEGER)) & 1 = 1 AS msb,
true AS uniform, substr(p_name, 2, 1) = substr(p_type, 2, 1) AS same FROM part""",
    "report_order": "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "xor_hash": """WITH c AS (SELECT conv_id, turn, octet_length(encode(text)) AS n, list_transform(range(0, octet_length(encode(text))), lambda k: CAST('0x' || substr(hex(encode(text)), 2 * k + 1, 2) AS BIGINT)) AS b FROM conversations),
s AS (SELECT conv_id, turn, n, list_transform(b, lambda x: CASE WHEN x > 127 THEN x - 256 ELSE x END) AS b FROM c)
SELECT conv_id, turn, list_reduce(list_prepend(n, list_transform(range(1, n, 2), lambda k: (b[k + 1] * 256) | b[k])), lambda a, x: xor(a, x)) AS hash FROM s""",
}
