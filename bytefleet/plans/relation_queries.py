"""Comparison, duplicates, matching and integrity over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bytefleet.operators import compare, duplicates, integrity, matching
from bytefleet.plans.tables import table
from bytefleet.plans.views import DOCUMENTS_SQL, documents, up


def _even(image="image"):
    return F.substring(image, 4, 5).cast("int") % 2 == 0


def _whole_disk(spark, sf_dir, even):
    # images are compared in pairs, 0 with 1, 2 with 3 and so on; every document has a path of its own: the row number tells apart those of one image pair, language and run of ids
    f = documents(spark, sf_dir).filter(_even() if even else ~_even())
    cell = F.concat_ws("/", F.floor(F.substring("image", 4, 5).cast("int") / 2).cast("string"), "lang", F.floor(F.col("doc_id") / 20).cast("string"), F.col("file_type"))
    rows = f.select(cell.alias("cell"), "doc_id", F.col("lang").alias("name"), F.col("file_type").alias("type"), F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("digest"))
    n = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "digest"))
    return rows.select(F.concat_ws("/", "cell", n.cast("string")).alias("path"), "name", "type", "size", "digest")


def _found(kind):
    def run(spark, sf_dir):
        return compare.compare(_whole_disk(spark, sf_dir, True), _whole_disk(spark, sf_dir, False)).filter(F.col("kind") == kind)

    return run


def _catalog(spark, sf_dir):
    f = documents(spark, sf_dir)
    return duplicates.digests(f.withColumn("path", F.lpad(F.col("doc_id").cast("string"), 12, "0")), "path", "data", "image")


def _halves(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return c.filter(_even("dir")), c.filter(~_even("dir"))


def dup_groups(spark, sf_dir):
    return duplicates.groups(_catalog(spark, sf_dir))


def coverage_by_dir(spark, sf_dir):
    return duplicates.coverage(*_halves(spark, sf_dir))


def coverage_missing(spark, sf_dir):
    f = documents(spark, sf_dir).withColumn("path", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    known = duplicates.digests(f.filter("lang <> 'es'"), "path", "data", "image")
    return duplicates.nearly_complete(duplicates.digests(f, "path", "data", "image"), known, over=90)


def unknown_files(spark, sf_dir):
    return duplicates.unknown(*_halves(spark, sf_dir)).select("path", "dir")


def first_partner(spark, sf_dir):
    return duplicates.partners(*_halves(spark, sf_dir)).filter("partner is not null").select("path", "partner")


def collision_suffix(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "source", "lang").alias("name"))
    return duplicates.suffixed(t, "name", "doc_id").select("doc_id", "target")


def _sides(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("en/"), F.col("item_id").cast("string")).alias("name"), F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), "text")
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("file_name").alias("name"), F.sha2("data", 256).alias("digest"), "text")
    return items, docs


def approx_pairs(spark, sf_dir):
    items, docs = _sides(spark, sf_dir)
    return matching.scores(items, docs, "id", "id")


def approx_bytes(spark, sf_dir):
    sides = [f.withColumn("text", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")) for f in _sides(spark, sf_dir)]
    return matching.scores(*sides, "id", "id", binary=True)


def match_classes(spark, sf_dir):
    items, docs = _sides(spark, sf_dir)
    return matching.classify(items, docs, 20)


def _collections(spark, sf_dir):
    f = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("image").alias("container"), (F.col("lang") == "es").alias("is_dir"), F.sha2("data", 256).alias("digest"), F.col("file_name").alias("name"), "text")
    return f.filter(_even("container")), f.filter(~_even("container"))


def match_exact_pairs(spark, sf_dir):
    return matching.classify(*_collections(spark, sf_dir)).filter("equal").select("id1", "id2", "label")


def match_exact_classes(spark, sf_dir):
    return matching.exact_classes(*_collections(spark, sf_dir))


def compare_moved_classes(spark, sf_dir):
    return compare.moved_classes(_whole_disk(spark, sf_dir, True), _whole_disk(spark, sf_dir, False))


def match_diff_same_name(spark, sf_dir):
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.md5(F.col("s_acctbal").cast("string")).alias("digest"), F.col("s_name").alias("text"))
    return matching.classify(o, o.withColumn("digest", F.concat(F.lit("x"), "digest")))


def match_summary(spark, sf_dir):
    a, b = _collections(spark, sf_dir)
    hits = matching.exact_classes(a, b).filter("side = 1")
    return matching.summary(hits.select(F.col("id").alias("id1"), (F.col("links") > 0).alias("equal")), a, "container")


def full_containment(spark, sf_dir):
    a, b = _collections(spark, sf_dir)
    return matching.exact_containment(a, b, "container")


def running_match_pct(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return matching.running(d, "source", "doc_id", F.col("n_chars") > 2000).select("doc_id", "running_pct")


def _use(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 16).alias("image"), F.col("l_orderkey").alias("file"), (F.col("l_suppkey") % 100).cast("int").alias("track"), (F.col("l_partkey") % 256).cast("int").alias("sector"))


def _bam(spark, sf_dir):
    grid = spark.range(16).withColumnRenamed("id", "image").select("image", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("track")).select("image", "track", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("sector"))
    return grid.withColumn("is_free", (F.col("image") * 7 + F.col("track") * 3 + F.col("sector")) % 5 == 0)


def alloc_check(spark, sf_dir):
    return integrity.allocation(_bam(spark, sf_dir), _use(spark, sf_dir))


def alloc_counts(spark, sf_dir):
    return integrity.allocation_counts(alloc_check(spark, sf_dir))


def alloc_repair(spark, sf_dir):
    return integrity.free_by_track(integrity.repaired(alloc_check(spark, sf_dir)))


def affected_files(spark, sf_dir):
    used = _use(spark, sf_dir).distinct()
    return integrity.affected_files(integrity.allocation(_bam(spark, sf_dir), used), used)


def free_by_track(spark, sf_dir):
    return integrity.free_by_track(_bam(spark, sf_dir), skip=(18,))


def total_free(spark, sf_dir):
    return integrity.total_free(_bam(spark, sf_dir), skip=(18,))


def cross_links(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    used = li.select((F.col("l_orderkey") % 16).alias("image"), F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("track"), F.col("l_partkey").alias("sector"))
    return integrity.cross_links(used.repartition("image", "file"))


def free_blocks(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    used = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("block"))
    from bytefleet.operators.listing import unused

    return unused(part.select(F.col("p_partkey").alias("block")), used)


def file_issues(spark, sf_dir):
    used = _use(spark, sf_dir).repartition("image", "file").distinct()  # one shuffle for all that is asked of files
    files = used.groupBy("image", "file").agg(F.count("*").alias("n")).select("image", "file", (F.col("n") + F.when(F.col("file") % 2 == 0, 1).otherwise(0)).alias("blocks"))
    return integrity.file_issues(files, integrity.allocation(_bam(spark, sf_dir), used), used)


_KINDS = ("differs", "moved", "missing1", "missing2")
QUERIES = {f"compare_all_{k}": _found(k) for k in _KINDS} | {
    f.__name__: f
    for f in (dup_groups, coverage_by_dir, coverage_missing, unknown_files, first_partner, collision_suffix, approx_pairs, approx_bytes, match_classes, match_exact_pairs, match_exact_classes, compare_moved_classes, match_diff_same_name, match_summary, full_containment, running_match_pct, alloc_check, alloc_counts, alloc_repair, affected_files, free_by_track, total_free, cross_links, free_blocks, file_issues)
}

_DISK = """SELECT cell || '/' || row_number() OVER (PARTITION BY cell ORDER BY doc_id, digest) AS path, name, type, size, digest FROM (SELECT concat_ws('/', CAST(CAST(floor(CAST(substr(image, 4, 5) AS INTEGER) / 2) AS BIGINT) AS VARCHAR), lang, CAST(CAST(floor(doc_id / 20) AS BIGINT) AS VARCHAR), file_type) AS cell, doc_id, lang AS name, file_type AS type, octet_length(data) AS size, sha256(text) AS digest FROM f WHERE CAST(substr(image, 4, 5) AS INTEGER) % 2 = {})"""
_DISKS = f"WITH {DOCUMENTS_SQL}, a AS ({_DISK.format(0)}), b AS ({_DISK.format(1)}), o1 AS (SELECT * FROM a WHERE path NOT IN (SELECT path FROM b)), o2 AS (SELECT * FROM b WHERE path NOT IN (SELECT path FROM a))"
_PAIR = "a.path AS path1, b.path AS path2, a.type AS type1, b.type AS type2, a.size AS size1, b.size AS size2"
_SAME = f"{up('a.name')} = {up('b.name')} AND a.digest = b.digest"
_CAT = f"WITH {DOCUMENTS_SQL}, c AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, image AS dir, octet_length(data) AS length, upper(sha256(text)) AS hash FROM f), p AS (SELECT * FROM c WHERE CAST(substr(dir, 4, 5) AS INTEGER) % 2 = 0), k AS (SELECT * FROM c WHERE CAST(substr(dir, 4, 5) AS INTEGER) % 2 <> 0)"
_GRAMS = f"""WITH a AS (SELECT item_id AS id, text FROM benchmark), b AS (SELECT doc_id AS id, text FROM documents),
ab AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(text) - 6, 8), lambda k: substr(text, k, 8)) || CASE WHEN length(text) > 8 AND length(text) % 8 <> 0 THEN [right(text, 8)] ELSE [] END) AS g FROM a WHERE length(text) >= 8),
bb AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(text) - 6, 8), lambda k: substr(text, k, 8)) || CASE WHEN length(text) > 8 AND length(text) % 8 <> 0 THEN [right(text, 8)] ELSE [] END) AS g FROM b WHERE length(text) >= 8),
ar AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(text) - 6), lambda k: substr(text, k, 8))) AS g FROM a), br AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(text) - 6), lambda k: substr(text, k, 8))) AS g FROM b),
c1 AS (SELECT ab.id AS i1, br.id AS i2, count(*) AS ct1 FROM ab JOIN br USING (g) GROUP BY ALL), c2 AS (SELECT ar.id AS i1, bb.id AS i2, count(*) AS ct2 FROM bb JOIN ar USING (g) GROUP BY ALL),
n1 AS (SELECT id AS i1, octet_length(encode(text)) AS s1, (SELECT count(*) FROM ab WHERE ab.id = a.id) AS b1 FROM a), n2 AS (SELECT id AS i2, octet_length(encode(text)) AS s2, (SELECT count(*) FROM bb WHERE bb.id = b.id) AS b2 FROM b),
j AS (SELECT i1, i2, coalesce(ct1, 0) / b1 AS p1, coalesce(ct2, 0) / b2 AS p2, least(s1, s2) / greatest(s1, s2) AS lp FROM c1 FULL JOIN c2 USING (i1, i2) JOIN n1 USING (i1) JOIN n2 USING (i2) WHERE b1 > 0 AND b2 > 0),
sc AS (SELECT i1 AS id1, i2 AS id2, CAST(floor(lp * p1 * p2 * 30 + p1 * 35 + p2 * 35 + 0.5) AS BIGINT) AS score FROM j)"""
_SIGNED = "list_transform({}, lambda g: lpad(regexp_replace(g, '^(?:..)*([89A-F].)', '\\1'), 16, 'F'))"
_BLOCKS = _SIGNED.format("list_transform(range(1, length(h) - 14, 16), lambda k: substr(h, k, 16)) || CASE WHEN length(h) > 16 AND length(h) % 16 <> 0 THEN [right(h, 16)] ELSE [] END")
_WINDOWS = _SIGNED.format("list_transform(range(1, least(length(h) // 2, 7) + 1), lambda k: lpad(substr(h, 1, 2 * k), 16, '0')) || list_transform(range(1, length(h) - 14, 2), lambda k: substr(h, k, 16))")
_BYTE_GRAMS = f"""WITH a AS (SELECT item_id AS id, hex(encode(text)) AS h FROM benchmark), b AS (SELECT doc_id AS id, hex(encode(text)) AS h FROM documents),
ab AS (SELECT DISTINCT id, unnest({_BLOCKS}) AS g FROM a), bb AS (SELECT DISTINCT id, unnest({_BLOCKS}) AS g FROM b), ar AS (SELECT DISTINCT id, unnest({_WINDOWS}) AS g FROM a), br AS (SELECT DISTINCT id, unnest({_WINDOWS}) AS g FROM b),
c1 AS (SELECT ab.id AS i1, br.id AS i2, count(*) AS ct1 FROM ab JOIN br USING (g) GROUP BY ALL), c2 AS (SELECT ar.id AS i1, bb.id AS i2, count(*) AS ct2 FROM bb JOIN ar USING (g) GROUP BY ALL),
n1 AS (SELECT id AS i1, length(h) AS s1, (SELECT count(*) FROM ab WHERE ab.id = a.id) AS b1 FROM a), n2 AS (SELECT id AS i2, length(h) AS s2, (SELECT count(*) FROM bb WHERE bb.id = b.id) AS b2 FROM b),
j AS (SELECT i1, i2, coalesce(ct1, 0) / greatest(b1, 1) AS p1, coalesce(ct2, 0) / greatest(b2, 1) AS p2, least(s1, s2) / greatest(s1, s2) AS lp FROM c1 FULL JOIN c2 USING (i1, i2) JOIN n1 USING (i1) JOIN n2 USING (i2))
SELECT i1 AS id1, i2 AS id2, CAST(floor(lp * p1 * p2 * 30 + p1 * 35 + p2 * 35 + 0.5) AS BIGINT) AS score FROM j WHERE floor(lp * p1 * p2 * 30 + p1 * 35 + p2 * 35 + 0.5) > 0"""
_USE = "u AS (SELECT l_orderkey % 16 AS image, l_orderkey AS file, CAST(l_suppkey % 100 AS INTEGER) AS track, CAST(l_partkey % 256 AS INTEGER) AS sector FROM lineitem)"
_BAM = "m AS (SELECT image, CAST(track AS INTEGER) AS track, CAST(sector AS INTEGER) AS sector, (image * 7 + track * 3 + sector) % 5 = 0 AS is_free FROM range(16) i(image), range(100) t(track), range(256) s(sector))"


def _marks() -> str:
    return f"""WITH {_USE}, {_BAM}, v AS (SELECT DISTINCT * FROM u), h AS (SELECT DISTINCT image, track, sector, true AS hit FROM v),
k AS (SELECT m.image, m.track, m.sector, is_free, CASE WHEN hit AND NOT is_free THEN 'x' WHEN hit IS NULL AND is_free THEN 'o' WHEN hit THEN '0' ELSE '#' END AS mark FROM m LEFT JOIN h ON m.image = h.image AND m.track = h.track AND m.sector = h.sector)"""


_M = _marks()
_LINKS = """n AS (SELECT image, file, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT a.image, a.file, b.file AS other, count(*) AS shared FROM v a JOIN v b ON a.image = b.image AND a.track = b.track AND a.sector = b.sector AND a.file <> b.file GROUP BY ALL),
l AS (SELECT s.image, s.file, s.other, shared, CASE WHEN shared = n1.n THEN 'inside' WHEN shared = n2.n THEN 'contains' ELSE 'overlaps' END AS kind FROM s JOIN n n1 ON s.image = n1.image AND s.file = n1.file JOIN n n2 ON s.image = n2.image AND s.other = n2.file)"""
_AFFECTED = "af AS (SELECT v.image, v.file, count(*) AS n_sectors, count(*) FILTER (mark = '0') AS n_free FROM v JOIN k ON v.image = k.image AND v.track = k.track AND v.sector = k.sector GROUP BY ALL HAVING n_free > 0)"
_EQUAL = f"WITH {DOCUMENTS_SQL}, e AS (SELECT a.doc_id AS id1, b.doc_id AS id2, a.image AS c1, b.image AS c2 FROM f a JOIN f b ON a.text = b.text AND octet_length(a.data) > 0 WHERE CAST(substr(a.image, 4, 5) AS INTEGER) % 2 = 0 AND CAST(substr(b.image, 4, 5) AS INTEGER) % 2 = 1)"
ORACLE_SQL = {
    "compare_all_differs": f"{_DISKS} SELECT 'differs' AS kind, {_PAIR} FROM a JOIN b ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest",
    "compare_all_moved": f"{_DISKS} SELECT 'moved' AS kind, {_PAIR} FROM o1 a JOIN o2 b ON {_SAME}",
    "compare_all_missing1": f"{_DISKS} SELECT 'missing1' AS kind, CAST(NULL AS VARCHAR) AS path1, b.path AS path2, CAST(NULL AS VARCHAR) AS type1, b.type AS type2, CAST(NULL AS BIGINT) AS size1, b.size AS size2 FROM o2 b WHERE NOT EXISTS (SELECT 1 FROM o1 a WHERE {_SAME})",
    "compare_all_missing2": f"{_DISKS} SELECT 'missing2' AS kind, a.path AS path1, CAST(NULL AS VARCHAR) AS path2, a.type AS type1, CAST(NULL AS VARCHAR) AS type2, a.size AS size1, CAST(NULL AS BIGINT) AS size2 FROM o1 a WHERE NOT EXISTS (SELECT 1 FROM o2 b WHERE {_SAME})",
    "compare_moved_classes": f"""{_DISKS}, u AS (SELECT 1 AS side, * FROM o1 UNION ALL SELECT 2, * FROM o2), c AS (SELECT {up('name')} AS k, digest AS d, min(path) FILTER (side = 1) AS class_path, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2 FROM u GROUP BY ALL)
SELECT side, path, type, size, class_path, CASE side WHEN 1 THEN n2 ELSE n1 END AS links FROM u JOIN c ON {up('u.name')} = k AND digest = d WHERE n1 > 0 AND n2 > 0""",
    "dup_groups": f"{_CAT} SELECT hash, length, count(*) AS n_files, min(path) AS first_path FROM c GROUP BY ALL HAVING count(*) >= 2",
    "coverage_by_dir": f"{_CAT}, d AS (SELECT DISTINCT hash, length FROM k) SELECT dir, count(*) AS total, count(d.hash) AS matches, CAST(floor(100.0 * count(d.hash) / count(*) + 0.5) AS BIGINT) AS pct FROM p LEFT JOIN d ON p.hash = d.hash AND p.length = d.length GROUP BY dir",
    "coverage_missing": f"{_CAT}, kk AS (SELECT DISTINCT upper(sha256(text)) AS hash, octet_length(data) AS length FROM f WHERE lang <> 'es'), r AS (SELECT c.dir, c.path, kk.hash IS NOT NULL AS ok FROM c LEFT JOIN kk ON c.hash = kk.hash AND c.length = kk.length), g AS (SELECT dir FROM r GROUP BY dir HAVING floor(100.0 * count(*) FILTER (ok) / count(*) + 0.5) > 90) SELECT dir, path FROM r WHERE NOT ok AND dir IN (SELECT dir FROM g)",
    "unknown_files": f"{_CAT} SELECT path, dir FROM p WHERE hash NOT IN (SELECT hash FROM k)",
    "first_partner": f"{_CAT} SELECT p.path, min(k.path) AS partner FROM p JOIN k ON p.hash = k.hash AND p.length = k.length GROUP BY p.path",
    "collision_suffix": "WITH n AS (SELECT doc_id, source || '.' || lang AS name, row_number() OVER (PARTITION BY source || '.' || lang ORDER BY doc_id) - 1 AS n FROM documents) SELECT doc_id, CASE WHEN n = 0 THEN name ELSE name || '_' || n END AS target FROM n",
    "approx_pairs": f"{_GRAMS} SELECT id1, id2, score FROM sc WHERE score > 0",
    "approx_bytes": _BYTE_GRAMS,
    "match_classes": f"""{_GRAMS}, e AS (SELECT a.id AS id1, b.id AS id2 FROM a JOIN b ON a.text = b.text WHERE length(a.text) > 0), nm AS (SELECT a.id AS id1, b.doc_id AS id2 FROM a JOIN documents b ON b.lang = 'en' AND b.doc_id = a.id),
r AS (SELECT id1, id2, true AS equal, CAST(0 AS BIGINT) AS approx, 1 AS rank FROM e UNION ALL SELECT id1, id2, score >= 20, score, 2 FROM sc WHERE score > 0 AND (score >= 20 OR (id1, id2) IN (SELECT (id1, id2) FROM nm)) UNION ALL SELECT id1, id2, false, 0, 3 FROM nm),
t AS (SELECT id1, id2, equal, approx, row_number() OVER (PARTITION BY id1, id2 ORDER BY rank) AS n FROM r)
SELECT id1, id2, CASE WHEN equal AND approx = 0 THEN 'MATCH' WHEN equal THEN 'M-' || approx || '%' WHEN approx > 0 THEN rpad(approx || '%', CAST(greatest(5, length(approx || '%')) AS INTEGER), ' ') ELSE 'DIFF' END AS label, equal, approx FROM t WHERE n = 1""",
    "match_exact_pairs": f"WITH {DOCUMENTS_SQL} SELECT a.doc_id AS id1, b.doc_id AS id2, 'MATCH' AS label FROM f a JOIN f b ON a.text = b.text AND octet_length(a.data) > 0 WHERE CAST(substr(a.image, 4, 5) AS INTEGER) % 2 = 0 AND CAST(substr(b.image, 4, 5) AS INTEGER) % 2 = 1",
    "match_exact_classes": f"""WITH {DOCUMENTS_SQL}, s AS (SELECT 1 + CAST(substr(image, 4, 5) AS INTEGER) % 2 AS side, doc_id AS id, CASE WHEN octet_length(data) > 0 THEN text END AS t FROM f), c AS (SELECT t, coalesce(min(id) FILTER (side = 1), min(id)) AS class_id, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2 FROM s WHERE t IS NOT NULL GROUP BY t)
SELECT side, id, class_id, coalesce(CASE side WHEN 1 THEN n2 ELSE n1 END, 0) AS links FROM s LEFT JOIN c USING (t)""",
    "match_diff_same_name": "SELECT a.s_suppkey AS id1, b.s_suppkey AS id2, 'DIFF' AS label, false AS equal, CAST(0 AS BIGINT) AS approx FROM supplier a JOIN supplier b ON a.s_name = b.s_name",
    "match_summary": f"{_EQUAL} SELECT image AS container, count(*) AS num_files, count(*) FILTER (doc_id IN (SELECT id1 FROM e)) AS matched_anywhere FROM f WHERE CAST(substr(image, 4, 5) AS INTEGER) % 2 = 0 AND NOT coalesce(lang = 'es', false) GROUP BY image",
    "full_containment": f"{_EQUAL}, g AS (SELECT c1 AS container1, c2 AS container2, count(*) AS pairs, count(DISTINCT id1) AS files FROM e GROUP BY ALL) SELECT g.*, num_files, pairs >= num_files AS \"full\" FROM g JOIN (SELECT image, count(*) AS num_files FROM f WHERE NOT coalesce(lang = 'es', false) GROUP BY image) ON image = container1",
    "running_match_pct": "SELECT doc_id, CAST(floor(100.0 * sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) OVER w / count(*) OVER w + 0.5) AS BIGINT) AS running_pct FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "alloc_check": f"{_M} SELECT image, track, sector, mark FROM k",
    "alloc_counts": f"{_M} SELECT image, count(*) FILTER (mark = '#') AS over, count(*) FILTER (mark = '0') AS under FROM k GROUP BY image",
    "alloc_repair": f"{_M} SELECT image, track, count(*) FILTER (mark IN ('o', '#')) AS free FROM k GROUP BY image, track",
    "affected_files": f"{_M}, {_AFFECTED} SELECT image, file, n_sectors, n_free, CAST(floor(100.0 * n_free / n_sectors + 0.5) AS BIGINT) AS pct FROM af",
    "free_by_track": f"WITH {_BAM} SELECT image, track, count(*) FILTER (is_free) AS free FROM m WHERE track <> 18 GROUP BY image, track",
    "total_free": f"WITH {_BAM} SELECT image, count(*) FILTER (is_free) AS free FROM m WHERE track <> 18 GROUP BY image",
    "cross_links": f"WITH v AS (SELECT DISTINCT l_orderkey % 16 AS image, l_orderkey AS file, l_suppkey AS track, l_partkey AS sector FROM lineitem), {_LINKS} SELECT image, file, other, shared, kind FROM l",
    "free_blocks": "SELECT p_partkey AS block FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)",
    "file_issues": f"""{_M}, {_LINKS}, {_AFFECTED} SELECT image, file, CAST(NULL AS BIGINT) AS other, 'block count' AS kind FROM n WHERE file % 2 = 0
UNION ALL SELECT image, file, NULL, 'not allocated' FROM af UNION ALL SELECT image, file, other, kind FROM l""",
}
