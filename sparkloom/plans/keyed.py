"""Ordered and keyed storage, sets, maps, lists, queues, top-k, strings and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered
from ..sources import files
from .registry import query, table

c = F.col
EV = "(SELECT user_id AS k, event_id AS seq, event_type AS t, value AS v FROM events)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(c("user_id").alias("k"), c("event_id").alias("seq"), c("event_type").alias("t"), c("value").alias("v"))


@query("kv_insert", f"SELECT k, first(seq ORDER BY seq) AS seq, first(v ORDER BY seq) AS v, count(*) > 1 AS existed FROM {EV} GROUP BY k")
def _(spark, sf_dir):
    return ordered.insert_if_absent(events(spark, sf_dir), "k", "seq").select("k", "seq", "v", "existed")


@query("kv_overwrite", f"SELECT k, last(seq ORDER BY seq) AS seq, last(t ORDER BY seq) AS t, last(v ORDER BY seq) AS v FROM {EV} GROUP BY k")
def _(spark, sf_dir):
    return ordered.upsert(events(spark, sf_dir), "k", "seq")


@query("kv_find", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


CEILING = "SELECT p.x, k.k AS found FROM (SELECT DISTINCT {probe} AS x FROM {probes}) p ASOF LEFT JOIN (SELECT DISTINCT {key} AS k FROM {keys}) k ON p.x <= k.k"


def _ceiling(probes, probe, keys, key):
    return ordered.ceiling(probes.select(c(probe).alias("x")), keys.select(c(key).alias("k")), "x", "k")


@query("kv_findnext", CEILING.format(probe="l_extendedprice", probes="lineitem", key="o_totalprice", keys="orders"))
def _(spark, sf_dir):
    return _ceiling(table(spark, sf_dir, "lineitem"), "l_extendedprice", table(spark, sf_dir, "orders"), "o_totalprice")


@query("kv_remove", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("kv_validate", """SELECT 'orders' AS t, count(*)::BIGINT AS n, count(*) FILTER (o_custkey IS NULL)::BIGINT AS no_key, (count(o_custkey) - count(DISTINCT o_custkey))::BIGINT AS again FROM orders
    UNION ALL SELECT 'customer', count(*), count(*) FILTER (c_custkey IS NULL), count(c_custkey) - count(DISTINCT c_custkey) FROM customer""")
def _(spark, sf_dir):
    """Rows, rows without a key and rows that repeat one, of a table that is a tree by its key and one that isn't."""
    parts = [ordered.validate(table(spark, sf_dir, t), k).select(F.lit(t).alias("t"), "n", "no_key", "again") for t, k in (("orders", "o_custkey"), ("customer", "c_custkey"))]
    return parts[0].union(parts[1])


@query("kv_open", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, sf_dir):
    return files.write_and_read(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "tree")


def _frozen(spark, sf_dir):
    """A sorted run: range-partitioned and sorted files, pruned by their minima and maxima."""
    return files.write_and_read(table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartitionByRange(8, "c_custkey").sortWithinPartitions("c_custkey"), "frozen")


@query("frozen_build", "SELECT count(*)::BIGINT AS n, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer")
def _(spark, sf_dir):
    return _frozen(spark, sf_dir).agg(F.count("*").alias("n"), F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))


@query("frozen_find", "SELECT c_name FROM customer WHERE c_custkey = 77")
def _(spark, sf_dir):
    return _frozen(spark, sf_dir).where("c_custkey = 77").select("c_name")


@query("frozen_findnext", CEILING.format(probe="o_orderkey", probes="orders", key="c_custkey", keys="customer"))
def _(spark, sf_dir):
    return _ceiling(table(spark, sf_dir, "orders"), "o_orderkey", _frozen(spark, sf_dir), "c_custkey")


@query("bt_insert", "SELECT url AS k, min(page_id) AS v, count(*) > 1 AS existed FROM pages WHERE url <> '' GROUP BY url")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where("url <> ''").select(c("url").alias("k"), c("page_id").alias("v"))
    return ordered.insert_if_absent(rows, "k", "v")


@query("bt_overwrite", "SELECT url AS k, max(page_id) AS v FROM pages WHERE url <> '' GROUP BY url")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url <> ''").groupBy(c("url").alias("k")).agg(F.max("page_id").alias("v"))


@query("bt_find", "SELECT o_orderkey, coalesce(c_custkey, 0) AS v FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return table(spark, sf_dir, "orders").join(keys, c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", F.coalesce("c_custkey", F.lit(0)).alias("v"))


@query("bt_remove", "SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE url LIKE '%/en/%')")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.join(p.where("url like '%/en/%'").select("page_id"), "page_id", "left_anti").select("page_id", "url")


@query("bt_nearest", "SELECT p.p_name AS name, max(k) AS prefix FROM (SELECT DISTINCT p_name FROM part) p JOIN (SELECT DISTINCT left(p_name, 5) AS k FROM part) q ON starts_with(p.p_name, q.k) GROUP BY p.p_name")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(c("p_name").alias("name")).distinct()
    return ordered.longest_prefix(p, p.select(F.left("name", F.lit(5)).alias("k")), "name", "k", 32)


NEAREST = """WITH p AS (SELECT DISTINCT p_name AS p FROM part), k AS (SELECT DISTINCT left(p_name, 5 + length(p_name) % 5) AS k FROM part WHERE p_partkey % 3 = 0),
    x AS (SELECT k, unnest(range(0, length(k) + 1)) AS n FROM k), nodes AS (SELECT left(k, n) AS path, bool_or(n = length(k)) OR count(DISTINCT substr(k, n + 1, 1)) > 1 OR bool_or(n = 0) AS node FROM x GROUP BY ALL),
    m AS (SELECT p, path, node, row_number() OVER (PARTITION BY p ORDER BY length(path) DESC) AS r FROM p JOIN nodes ON starts_with(p, path))
    SELECT p, path AS prefix, CASE WHEN node AND p = path THEN 'exact' WHEN node THEN 'empty entry' ELSE 'to split' END AS outcome FROM m WHERE r = 1"""


@query("bt_nearest_outcomes", NEAREST)
def _(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    keys = t.where("p_partkey % 3 = 0").select(F.left("p_name", 5 + F.length("p_name") % 5).cast("binary").alias("k"))
    found = ordered.nearest(t.select(c("p_name").cast("binary").alias("p")), keys, "p", "k")
    return found.select(c("p").cast("string").alias("p"), c("prefix").cast("string").alias("prefix"), "outcome")


@query("bt_find_bytes", "SELECT page_id, coalesce(v, 0)::BIGINT AS v FROM pages LEFT JOIN (SELECT url AS u, min(page_id) AS v FROM pages WHERE page_id % 2 = 0 AND url <> '' GROUP BY url) ON url = u")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    b = c("url").cast("binary")
    keys = ordered.insert_if_absent(p.where((c("page_id") % 2 == 0) & (F.octet_length(b) > 0)).select(b.alias("u"), c("page_id").alias("v")), "u", "v")
    return p.join(keys.select("u", "v"), b == c("u"), "left").select("page_id", F.coalesce("v", F.lit(0)).alias("v"))


@query("bt_order", "SELECT url, row_number() OVER (ORDER BY encode(url), page_id) AS pos FROM pages")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", c("url").cast("binary").alias("b"))
    return ordered.positions(p, ["b", "page_id"], "pos").select("url", "pos")


@query("bytes_cmp", "SELECT p_partkey, p_name < p_type AS lt, p_name = p_type AS eq FROM part")
def _(spark, sf_dir):
    b = lambda x: c(x).cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", (b("p_name") < b("p_type")).alias("lt"), (b("p_name") == b("p_type")).alias("eq"))


REGIONS = "(SELECT p_partkey * 4096 AS \"offset\", p_size * 100 AS size FROM part)"


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "part").select((c("p_partkey") * 4096).alias("offset"), (c("p_size") * 100).alias("size"))


@query("free_get", f"SELECT * FROM {REGIONS} WHERE size >= 1234 ORDER BY size, \"offset\" LIMIT 1")
def _(spark, sf_dir):
    return ordered.best_fit(_regions(spark, sf_dir), 1234)


@query("free_extend", f"SELECT (max(\"offset\" + size) + 7) // 8 * 8 AS \"offset\", 999999999::BIGINT AS size FROM {REGIONS}")
def _(spark, sf_dir):
    """A request that no region holds goes to the end of the file, at a multiple of eight."""
    r = _regions(spark, sf_dir)
    return ordered.best_fit(r, 999_999_999, r.agg(F.max(c("offset") + c("size"))).first()[0]).select("offset", c("size").cast("bigint").alias("size"))


@query("free_mark", f"SELECT size, count(*)::BIGINT AS n, min(\"offset\") AS first FROM {REGIONS} GROUP BY size")
def _(spark, sf_dir):
    return _regions(spark, sf_dir).groupBy("size").agg(F.count("*").alias("n"), F.min("offset").alias("first"))


# sets
@query("set_contains", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(c("o_custkey").alias("k")).distinct()
    return table(spark, sf_dir, "customer").join(keys, c("c_custkey") == c("k"), "left").select("c_custkey", c("k").isNotNull().alias("found"))


@query("set_add", "SELECT DISTINCT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_orderkey FROM orders)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("k")).union(table(spark, sf_dir, "orders").select("o_orderkey")).distinct()


@query("set_remove", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


USERS = "(SELECT user_id AS k, list_sort(list_distinct(list(event_type))) AS s, list(event_type ORDER BY event_id) AS l, list(event_id ORDER BY event_id) AS q FROM events GROUP BY user_id)"


def users(spark, sf_dir):
    """Small lists: a user's events, in order."""
    l = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])  # noqa: E741
    return table(spark, sf_dir, "events").groupBy(c("user_id").alias("k")).agg(
        F.array_sort(F.collect_set("event_type")).alias("s"), l.alias("l"), F.array_sort(F.collect_list("event_id")).alias("q"))


AB = "['click', 'view']"
ab = lambda: F.array(F.lit("click"), F.lit("view"))


def _cell(name, f, sql, typed="VARCHAR"):
    @query(name, f"SELECT k, ({sql})::{typed} AS v FROM {USERS}")
    def run(spark, sf_dir):
        return users(spark, sf_dir).select("k", f().alias("v"))


_join = lambda a: F.concat_ws(",", a)
_cell("set_subset", lambda: F.size(F.array_except(ab(), "s")) == 0, f"list_has_all(s, {AB})", "BOOLEAN")
_cell("set_superset", lambda: F.size(F.array_except("s", ab())) == 0, f"list_has_all({AB}, s)", "BOOLEAN")
_cell("set_equal", lambda: (F.size(F.array_except("s", ab())) == 0) & (F.size(F.array_except(ab(), "s")) == 0), f"list_has_all({AB}, s) AND list_has_all(s, {AB})", "BOOLEAN")
_cell("set_sorted", lambda: _join(F.array_sort(F.array_distinct("l"))), "array_to_string(list_sort(list_distinct(l)), ',')")
_cell("set_pop", lambda: F.array_max("s"), "s[-1]")
_cell("set_addfrom", lambda: _join(F.array_sort(F.array_union("s", F.array(F.lit("zz"))))), "array_to_string(list_sort(list_distinct(list_append(s, 'zz'))), ',')")
_cell("set_tolist", lambda: _join("s"), "array_to_string(s, ',')")
_cell("list_add", lambda: _join(F.array_append("s", F.lit("x"))), "array_to_string(list_append(s, 'x'), ',')")
_cell("list_addfirst", lambda: _join(F.array_prepend("s", F.lit("x"))), "array_to_string(list_prepend('x', s), ',')")
_cell("list_addmany", lambda: _join(F.concat("s", ab())), f"array_to_string(list_concat(s, {AB}), ',')")
_cell("list_addcopies", lambda: _join(F.concat("s", F.array_repeat(F.lit("x"), 3))), "array_to_string(list_concat(s, ['x', 'x', 'x']), ',')")
_cell("list_set", lambda: _join(F.transform("s", lambda x, i: F.when(i == 1, "x").otherwise(x))), "array_to_string(list_transform(s, lambda e, i: CASE WHEN i = 2 THEN 'x' ELSE e END), ',')")
_cell("list_pop", lambda: _join(F.slice("s", F.lit(1), F.size("s") - 1)), "array_to_string(s[1:len(s) - 1], ',')")
_cell("list_unordered_remove", lambda: _join(F.concat(F.slice("s", F.size("s"), F.when(F.size("s") > 1, 1).otherwise(0)), F.slice("s", F.lit(2), F.greatest(F.lit(0), F.size("s") - 2)))),
      "array_to_string(list_concat(CASE WHEN len(s) > 1 THEN s[len(s):len(s)] ELSE s[1:0] END, s[2:len(s) - 1]), ',')")
_cell("list_resize", lambda: _join(F.slice(F.concat("s", F.array_repeat(F.lit(""), 6)), 1, 6)), "array_to_string(list_concat(s, ['', '', '', '', '', ''])[1:6], ',')")
_cell("list_slice", lambda: _join(F.slice("l", -2, 2)), "array_to_string(CASE WHEN len(l) < 2 THEN [] ELSE l[-2:] END, ',')")
_cell("list_find", lambda: (F.array_position("l", F.lit("click")) - 1).cast("int"), "coalesce(list_position(l, 'click'), 0) - 1", "INT")
_cell("list_clear", lambda: _join(F.array_append(F.filter("l", lambda x: F.lit(False)), F.element_at("l", 1))), "l[1]")
_cell("llist_insert", lambda: _join(F.array_insert("s", 1, F.lit("x"))), "array_to_string(list_prepend('x', s), ',')")
_cell("llist_remove", lambda: _join(F.array_remove("l", "click")), "array_to_string(list_filter(l, lambda e: e <> 'click'), ',')")
_cell("iter_reverse", lambda: _join(F.reverse("l")), "array_to_string(list_reverse(l), ',')")
_cell("iter_range", lambda: _join(F.slice("l", 1, 3)), "array_to_string(l[1:3], ',')")
_cell("iter_equal", lambda: F.col("l") == F.reverse("l"), "l = list_reverse(l)", "BOOLEAN")
_cell("iter_equal_types", lambda: F.array_sort(F.array_distinct("l")) == F.col("s"), "list_sort(list_distinct(l)) = s", "BOOLEAN")
_cell("queue_pop", lambda: F.element_at("q", 1), "q[1]", "BIGINT")
_cell("queue_peek", lambda: F.element_at("q", 1), "q[1]", "BIGINT")
_cell("queue_peeklast", lambda: F.element_at("q", -1), "q[-1]", "BIGINT")


@query("queue_fifo", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 25")
def _(spark, sf_dir):
    return ordered.top_k(table(spark, sf_dir, "events").select("event_id", "event_type"), [c("event_id")], 25)


# maps
LAST = f"(SELECT k, t, last(v ORDER BY seq) AS v FROM {EV} GROUP BY k, t)"


def maps(spark, sf_dir):
    """A map per user: the last value of each event type."""
    last = events(spark, sf_dir).groupBy("k", "t").agg(F.max_by("v", "seq").alias("v"))
    return last.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))


@query("map_put", f"SELECT k, t, CASE WHEN t = 'click' THEN 0.5 ELSE v END::DOUBLE AS v FROM (SELECT * FROM {LAST} UNION ALL SELECT DISTINCT k, 'click', NULL FROM {LAST} WHERE k NOT IN (SELECT k FROM {LAST} WHERE t = 'click'))")
def _(spark, sf_dir):
    put = F.map_concat(F.map_filter("m", lambda k, v: k != "click"), F.create_map(F.lit("click"), F.lit(0.5)))
    return maps(spark, sf_dir).select("k", F.explode(put).alias("t", "v"))


@query("map_get", f"SELECT k, max(v) FILTER (t = 'click') AS v, bool_or(t = 'click') AS has, coalesce(max(v) FILTER (t = 'none'), -1)::DOUBLE AS other FROM {LAST} GROUP BY k")
def _(spark, sf_dir):
    m = maps(spark, sf_dir)
    return m.select("k", F.try_element_at("m", F.lit("click")).alias("v"), F.map_contains_key("m", F.lit("click")).alias("has"), F.coalesce(F.try_element_at("m", F.lit("none")), F.lit(-1.0)).alias("other"))


@query("map_remove", f"SELECT k, t, v FROM {LAST} WHERE t <> 'click'")
def _(spark, sf_dir):
    return maps(spark, sf_dir).select("k", F.explode(F.map_filter("m", lambda k, v: k != "click")).alias("t", "v"))


# top-k
@query("topk_min", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def _(spark, sf_dir):
    return ordered.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [c("o_totalprice"), c("o_orderkey")], 20)


@query("topk_max", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, sf_dir):
    return ordered.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), c("o_orderkey")], 20)


@query("topk_update", "SELECT o_orderkey, p FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN -o_totalprice ELSE o_totalprice END AS p FROM orders) ORDER BY p, o_orderkey LIMIT 20")
def _(spark, sf_dir):
    p = F.when(c("o_orderkey") % 10 == 0, -c("o_totalprice")).otherwise(c("o_totalprice"))
    return ordered.top_k(table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")), [c("p"), c("o_orderkey")], 20)


@query("topk_per_key", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def _(spark, sf_dir):
    return ordered.top_k_per_key(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), c("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


# strings and hashes
def _text(name, f, sql):
    @query(name, f"SELECT p_partkey AS i, {sql} AS v FROM part")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), f().alias("v"))


_text("str_isnumber", lambda: F.substring("p_brand", 7, 3).rlike("^[0-9]+$"), "regexp_full_match(substr(p_brand, 7, 3), '[0-9]+')")
HEXES = ["", "0x", "0X"]
_text("str_parsehex32", lambda: F.conv(F.regexp_replace(F.concat(F.get(F.array(*map(F.lit, HEXES)), (c("p_partkey") % 3).cast("int")), F.lower(F.hex((c("p_partkey") * 2654435761) % 4294967296))), "^0[xX]", ""), 16, 10).cast("bigint"),
      "(p_partkey * 2654435761) % 4294967296")
_text("str_parsehex64", lambda: F.conv(F.hex(c("p_partkey") * 4294967296), 16, 10).cast("decimal(20,0)").cast("string"), "(p_partkey * 4294967296)::VARCHAR")
_text("str_tohex_int", lambda: F.lower(F.hex(c("p_partkey") * 65521)), "lower(hex(p_partkey * 65521))")
_text("str_tohex", lambda: F.lower(F.hex(c("p_name").cast("binary"))), "lower(hex(encode(p_name)))")
_text("str_concatf", lambda: F.format_string("%s-%05d", "p_brand", "p_partkey"), "printf('%s-%05d', p_brand, p_partkey)")
_text("hash_cmp", lambda: c("p_name").eqNullSafe(c("p_type")), "p_name IS NOT DISTINCT FROM p_type")


DUMP = """WITH t AS (SELECT p_partkey AS i, encode(left(p_name || ' ' || p_type || ' ' || p_brand, (p_partkey % 40)::INT)) AS b FROM part),
    x AS (SELECT i, lower(hex(b)) AS h, octet_length(b) AS n, octet_length(b) > 16 AS several FROM t),
    l AS (SELECT i, several, k, n, (SELECT string_agg(substr(h, 32 * k + 2 * j + 1, 2) || ' ' || CASE WHEN j = 7 AND 16 * k + 8 < n THEN ' ' ELSE '' END, '' ORDER BY j) FROM range(16) r(j) WHERE 16 * k + j < n) AS bytes
        FROM x, range(3) q(k) WHERE 16 * k < n),
    g AS (SELECT l.i, string_agg(CASE WHEN several THEN printf('%04x  ', 16 * k) ELSE '' END || bytes || ' |' || decode(b)[16 * k + 1:16 * k + 16] || '|' || CASE WHEN several THEN chr(10) ELSE '' END, '' ORDER BY k) AS v FROM l JOIN t USING (i) GROUP BY l.i)
    SELECT i, coalesce(v, '(empty)') AS v FROM t LEFT JOIN g USING (i)"""


@query("str_hexdump", DUMP)
def _(spark, sf_dir):
    text = F.left(F.concat_ws(" ", "p_name", "p_type", "p_brand"), (c("p_partkey") % 40).cast("int"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), files.hex_dump(text.cast("binary")).alias("v"))


@query("hash_block", "SELECT count(DISTINCT (p_partkey, p_size))::BIGINT AS n FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count_distinct(F.xxhash64("p_partkey", "p_size")).alias("n"))


@query("hash_str", "SELECT count(DISTINCT url)::BIGINT AS n, true AS avalanche FROM pages")
def _(spark, sf_dir):
    flips = F.bit_count(F.xxhash64("url").bitwiseXOR(F.xxhash64(F.concat("url", F.lit("x")))))
    return table(spark, sf_dir, "pages").agg(F.count_distinct(F.xxhash64("url")).alias("n"), F.avg(flips).between(30, 34).alias("avalanche"))


@query("map_haskey", f"SELECT k, bool_or(t = 'purchase') AS has FROM {LAST} GROUP BY k")
def _(spark, sf_dir):
    return maps(spark, sf_dir).select("k", F.map_contains_key("m", F.lit("purchase")).alias("has"))


@query("map_getordefault", f"SELECT k, coalesce(max(v) FILTER (t = 'purchase'), 0.25)::DOUBLE AS v FROM {LAST} GROUP BY k")
def _(spark, sf_dir):
    return maps(spark, sf_dir).select("k", F.coalesce(F.try_element_at("m", F.lit("purchase")), F.lit(0.25)).alias("v"))


@query("map_drop", f"SELECT k, count(*)::BIGINT AS before, 1::BIGINT AS after FROM {LAST} GROUP BY k")
def _(spark, sf_dir):
    """Everything goes, then one entry is put."""
    dropped = F.map_concat(F.map_filter("m", lambda k, v: F.lit(False)), F.create_map(F.lit("new"), F.lit(1.5)))
    return maps(spark, sf_dir).select("k", F.size("m").cast("bigint").alias("before"), F.size(dropped).cast("bigint").alias("after"))


@query("map_putfrom", f"SELECT k, t, CASE WHEN t IN ('click', 'new') THEN 1.5 ELSE v END::DOUBLE AS v FROM (SELECT * FROM {LAST} WHERE t NOT IN ('click', 'new') UNION ALL SELECT DISTINCT k, u, 0 FROM {LAST}, (VALUES ('click'), ('new')) n(u))")
def _(spark, sf_dir):
    other = F.create_map(F.lit("click"), F.lit(1.5), F.lit("new"), F.lit(1.5))
    merged = F.map_concat(F.map_filter("m", lambda k, v: ~F.map_contains_key(other, k)), other)
    return maps(spark, sf_dir).select("k", F.explode(merged).alias("t", "v"))


_cell("queue_addmany", lambda: _join(F.concat("l", ab())), f"array_to_string(list_concat(l, {AB}), ',')")
_cell("queue_add", lambda: F.size(F.array_append("q", F.lit(0).cast("bigint"))), "len(q) + 1", "INT")
_cell("llist_insertat", lambda: _join(F.when(F.size("l") >= 2, F.array_insert("l", 3, F.lit("x"))).otherwise(c("l"))), "array_to_string(CASE WHEN len(l) >= 2 THEN list_concat(list_append(l[1:2], 'x'), l[3:]) ELSE l END, ',')")
_cell("llist_removeat", lambda: _join(F.concat(F.slice("l", 1, 1), F.slice("l", F.lit(3), F.greatest(F.size("l") - 2, F.lit(0))))), "array_to_string(list_concat(l[1:1], l[3:]), ',')")
_cell("llist_add", lambda: _join(F.array_append("l", F.lit("x"))), "array_to_string(list_append(l, 'x'), ',')")
_cell("llist_pop", lambda: _join(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))), "array_to_string(l[2:], ',')")
