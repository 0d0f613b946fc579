"""Sources, cleaning and sinks over capture documents written from the driver's tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..functions import ordering as O
from ..operators import aggregates as A
from ..params import PUBLIC_FIELDS
from ..session import shared_dir
from ..sources import captures as C
from ..sources import sinks as K
from ..sources import views as V
from .projections import flagged, labelled_source, LABELLED_SOURCE
from .registry import query, shared_sql

_PATHS: dict = {}


def capture_documents(spark, sf):
    """Capture files of at most 200 records each, in the shapes captures really have."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _PATHS:
        return _PATHS[key]
    c = F.col
    day = F.date_format("pub_ts", "yyyyMMdd")
    named = F.struct(F.concat(F.lit("u"), "owner_id").alias("name"), c("owner_id").alias("mid"))

    def record(owner, stat, **more):
        return F.to_json(F.struct(c("item_id").cast("string").alias("item_id"), "title", owner.alias("owner"), "category", "source", "duration", day.alias("pub_day"),
                                  stat.alias("stat"), *[v.alias(k) for k, v in more.items()]))

    full = F.struct("view", "coin", c("like_cnt").alias("like"), c("fav").alias("favorite"))
    old = F.struct("coin", c("like_cnt").alias("like"), c("fav"))
    items = V.items(spark, sf)
    text = (F.when(c("rotate") == 90, record(named, F.struct("view", "coin", c("like_cnt").alias("like"))))  # no favourites: dropped
            .when(c("category") == "5-LOW", record(F.concat(F.lit("u"), "owner_id"), full))
            .when(c("category") == "2-HIGH", record(named, F.struct("view", F.lit(-1).alias("coin"), c("like_cnt").alias("like"), "fav")))  # negative: dropped
            .when(c("category") == "1-URGENT", record(named, old, view=c("view"))).otherwise(record(named, full)))
    docs = items.select(F.floor(c("item_id") / 200).alias("doc"), text.alias("r")).groupBy("doc").agg(F.array_join(F.collect_list("r"), ",").alias("r"))
    line = F.when(F.col("doc") % 2 == 0, F.concat(F.lit('{"meta":{"collected_at":"20240101","arm":"home"},"videos":['), "r", F.lit("]}"))).otherwise(F.concat(F.lit("["), "r", F.lit("]")))
    path = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    docs.select(line.alias("value")).write.text(path)
    _PATHS[key] = path
    return path


@query("scan_capture_json", ["items"], "SELECT CAST(item_id AS VARCHAR) AS item_id, title, category, duration, strftime(pub_ts, '%Y%m%d') AS pub_day, CASE WHEN item_id // 200 % 2 = 0 THEN 'home' END AS arm FROM items")
def scan_capture_json(spark, sf):
    return C.scan_captures(spark, capture_documents(spark, sf)).select("video.item_id", "video.title", "video.category", "video.duration", "video.pub_day", "meta.arm")


@query("normalize_item", ["items"], """SELECT CAST(item_id AS VARCHAR) AS item_id, title, view::DOUBLE AS view, coin::DOUBLE AS coin, fav::DOUBLE AS fav, like_cnt::DOUBLE AS like_cnt, 'u' || owner_id AS owner, CASE WHEN category = '5-LOW' THEN '' ELSE CAST(owner_id AS VARCHAR) END AS owner_id
  FROM items WHERE rotate <> 90 AND category <> '2-HIGH'""")
def normalize_item(spark, sf):
    return C.normalize(C.scan_captures(spark, capture_documents(spark, sf))).drop("file", "duration")


NAME_SQL = "CASE WHEN event_id % 7 = 0 THEN 'zz_' ELSE 'capture_' END || strftime(ts, '%Y%m%d') || CASE WHEN event_type = 'click' THEN '' ELSE strftime(ts, '_%H%M%S') END || CASE event_type WHEN 'error' THEN '_analysis' WHEN 'signup' THEN '_part' ELSE '' END || '.json'"


@query("capture_key_cutoff", [], f"""SELECT name, day || rpad(clock, 6, '0') AS capture_key FROM (SELECT name, regexp_extract(name, '20\\d{{6}}') AS day, regexp_extract(name, '20\\d{{6}}_(\\d{{6}})', 1) AS clock FROM (SELECT {NAME_SQL} AS name FROM events)) WHERE NOT contains(name, '_analysis') AND day <= '20240120'""")
def capture_key_cutoff(spark, sf):
    e = V.table(spark, sf, "events")
    name = F.concat(F.when(F.col("event_id") % 7 == 0, "zz_").otherwise("capture_"), F.date_format("ts", "yyyyMMdd"),
                    F.when(F.col("event_type") == "click", "").otherwise(F.date_format("ts", "_HHmmss")),
                    F.when(F.col("event_type") == "error", "_analysis").when(F.col("event_type") == "signup", "_part").otherwise(""), F.lit(".json"))
    return C.keep_files(e.select(name.alias("name")), "name", "20240120")


@query("capture_files_until", ["captures"], """SELECT day, count(*) AS n, round(sum(counter), 3) AS total FROM (SELECT *, strftime(ts, '%Y%m%d') AS day FROM captures) WHERE event_type <> 'error' AND day <= '20240120' GROUP BY day""")
def capture_files_until(spark, sf):
    """Capture folders named by day and kind; those after the cutoff and derived products are not part of the scan."""
    stamp = F.date_format("ts", "yyyyMMdd")
    kind = F.when(F.col("event_type") == "error", "_analysis").otherwise("")
    rows = V.captures(spark, sf).withColumn("capture", F.concat(F.lit("capture_"), stamp, kind)).withColumn("day", stamp)
    path = f"{shared_dir(spark)}/capture-files-{uuid.uuid4().hex}"
    rows.write.partitionBy("capture").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return C.keep_files(stored, "capture", "20240120").groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("counter"), 3).alias("total"))


@query("counter_completeness", ["items"], """SELECT item_id, coalesce(nullif(favorite, 0), favourite, 0) AS fav, view > 0 AND (coalesce(l, 0) > 0 OR coalesce(c, 0) > 0) AS usable, view > 0 AND l IS NOT NULL AND c IS NOT NULL AS complete
  FROM (SELECT item_id, view, CASE WHEN rotate = 90 THEN 0 ELSE fav END AS favorite, CASE WHEN rotate = 90 THEN fav END AS favourite, CASE WHEN width > height THEN coin END AS c, CASE WHEN category <> '5-LOW' THEN like_cnt END AS l FROM items)""")
def counter_completeness(spark, sf):
    """Legacy spelling of one counter, and two completeness flags."""
    c = F.col
    raw = V.items(spark, sf).select("item_id", "view", F.when(c("rotate") == 90, 0).otherwise(c("fav")).alias("favorite"), F.when(c("rotate") == 90, c("fav")).alias("favourite"),
                                    F.when(c("width") > c("height"), c("coin")).alias("c"), F.when(c("category") != "5-LOW", c("like_cnt")).alias("l"))
    return raw.select("item_id", F.coalesce(F.nullif("favorite", F.lit(0)), "favourite", F.lit(0)).alias("fav"),
                      ((c("view") > 0) & ((F.coalesce("l", F.lit(0)) > 0) | (F.coalesce("c", F.lit(0)) > 0))).alias("usable"),
                      ((c("view") > 0) & c("l").isNotNull() & c("c").isNotNull()).alias("complete"))


@query("first_source_wins_dedupe", ["captures"], """SELECT item_id, arg_min(event_type, (p, capture_id)) AS event_type, arg_min(capture_id, (p, capture_id)) AS capture_id FROM (SELECT *, list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) AS p FROM captures WHERE counter > 5) GROUP BY item_id""")
def first_source_wins_dedupe(spark, sf):
    prio = F.array_position(F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup", "error")]), F.col("event_type"))
    return C.first_source_wins(V.captures(spark, sf).filter("counter > 5").select("item_id", "event_type", "capture_id", prio.alias("p")), "item_id", ["p", "capture_id"]).drop("p")


@query("backfill_incomplete", ["items"], """WITH_X SELECT b.item_id, coalesce(b.coin, s.coin) AS coin, coalesce(b.title, s.title) AS title, s.item_id IS NOT NULL AND b.coin IS NULL AS filled FROM (SELECT item_id, CASE WHEN rotate <> 90 THEN coin END AS coin, CASE WHEN rotate <> 90 THEN title END AS title FROM items) b
  LEFT JOIN (SELECT * FROM items WHERE category <> '5-LOW' AND rotate = 90) s ON s.item_id = b.item_id""".replace("WITH_X ", ""))
def backfill_incomplete(spark, sf):
    """Every broken row takes what the side table knows."""
    items = V.items(spark, sf)
    base = items.select("item_id", *[F.when(F.col("rotate") != 90, F.col(c)).alias(c) for c in ("coin", "title")])
    broken = base.filter("coin is null").select("item_id")
    side = items.filter("category <> '5-LOW'").join(broken, "item_id", "left_semi").select("item_id", *[F.col(c).alias(f"s_{c}") for c in ("coin", "title")])
    out = base.join(side, "item_id", "left")
    return out.select("item_id", *[F.coalesce(c, f"s_{c}").alias(c) for c in ("coin", "title")], (F.col("coin").isNull() & F.col("s_title").isNotNull()).alias("filled"))


@query("new_item_antijoin", ["items", "walk_nodes"], """SELECT item_id FROM (SELECT item_id FROM items WHERE pub_ts >= TIMESTAMP '2001-01-01' UNION SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01')
  WHERE item_id NOT IN (SELECT doc_id FROM documents) AND item_id NOT IN (SELECT item_id FROM walk_nodes)""")
def new_item_antijoin(spark, sf):
    today = V.items(spark, sf).filter("pub_ts >= '2001-01-01'").select("item_id").union(
        V.table(spark, sf, "lineitem").filter("l_shipdate >= '2001-06-01'").select("l_orderkey")).distinct()
    known = V.documents(spark, sf).select(F.col("doc_id").alias("item_id"))
    nodes = V.walk_nodes(spark, sf)
    return today.join(known, "item_id", "left_anti").join(nodes, "item_id", "left_anti")


NODE_SQL = "SELECT l_partkey AS node_id, strftime(o_orderdate, '%Y%m%d') AS snapshot, CAST(l_quantity * 1000 AS BIGINT) AS view, l_discount AS coin_rate, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS fav_rate, round(l_tax * 2, 4) AS like_rate FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@query("graph_node_union", [], f"""SELECT node_id, coalesce(b.snapshot, n.snapshot) AS snapshot, coalesce(b.view, n.view) AS view, round(CASE WHEN b IS NOT NULL THEN b.coin_rate ELSE n.coin_rate END, 6) AS coin_rate, round(CASE WHEN b IS NOT NULL THEN b.fav_rate ELSE n.fav_rate END, 6) AS fav_rate, first_seen, mentions FROM (
  SELECT node_id, max({{'snapshot': snapshot, 'view': view, 'coin_rate': coin_rate, 'fav_rate': fav_rate, 'like_rate': like_rate}}) FILTER (fav_rate IS NOT NULL) AS b, arg_max({{'snapshot': snapshot, 'view': view, 'coin_rate': coin_rate, 'fav_rate': fav_rate}}, {{'snapshot': snapshot, 'view': view, 'coin_rate': coin_rate}}) AS n,
    min(snapshot) AS first_seen, count(*) AS mentions FROM ({NODE_SQL}) GROUP BY node_id)""")
def graph_node_union(spark, sf):
    """Runs as nested documents: flows of each order's lines, some lines inside an arm map."""
    lines = V.table(spark, sf, "lineitem").join(V.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("snapshot")), F.col("l_orderkey") == F.col("o_orderkey"))
    node = F.struct(F.col("l_partkey").alias("node_id"), (F.col("l_quantity") * 1000).cast("long").alias("view"), F.col("l_discount").alias("coin_rate"),
                    F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("fav_rate"), F.round(F.col("l_tax") * 2, 4).alias("like_rate"))
    flow = F.array(F.struct(F.array(node).alias("nodes")))
    direct = F.col("l_linestatus") == "O"
    runs = lines.select("snapshot", F.when(direct, flow).alias("flows"), F.when(~direct, F.create_map(F.lit("arm"), F.struct(flow.alias("flows")))).alias("arms"))
    return C.flow_nodes(runs).select("node_id", "snapshot", "view", "coin_rate", "fav_rate", "first_seen", "mentions")


DUR_TEXT = """CASE WHEN rotate = 90 THEN 'n/a' WHEN category = '5-LOW' THEN CAST(duration AS VARCHAR) WHEN duration >= 600 THEN '1:' || lpad(CAST(duration // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(duration % 60 AS VARCHAR), 2, '0')
  ELSE CAST(duration // 60 AS VARCHAR) || ':' || lpad(CAST(duration % 60 AS VARCHAR), 2, '0') END"""


@query("duration_text_to_seconds", ["items"], f"SELECT item_id, t, CAST(CASE WHEN rotate = 90 THEN 0 WHEN category <> '5-LOW' AND duration >= 600 THEN 3600 + duration ELSE duration END AS BIGINT) AS seconds FROM (SELECT *, {DUR_TEXT} AS t FROM items)")
def duration_text_to_seconds(spark, sf):
    m, s = F.floor(F.col("duration") / 60).cast("string"), F.lpad((F.col("duration") % 60).cast("string"), 2, "0")
    text = (F.when(F.col("rotate") == 90, "n/a").when(F.col("category") == "5-LOW", F.col("duration").cast("string"))
            .when(F.col("duration") >= 600, F.concat(F.lit("1:"), F.lpad(m, 2, "0"), F.lit(":"), s)).otherwise(F.concat(m, F.lit(":"), s)))
    return V.items(spark, sf).select("item_id", text.alias("t")).withColumn("seconds", C.duration_seconds(F.col("t")))


@query("anonymise_id", [], "SELECT c_custkey, substr(sha1('user:' || c_custkey), 1, 10) AS user_hash FROM customer")
def anonymise_id(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", C.anonymise(F.col("c_custkey"), "user:").alias("user_hash"))


@query("frozen_reference_manifest")
def frozen_reference_manifest(spark, sf):
    """The input files against the manifest of the first run over this folder, which is kept in the shared folder."""
    store = f"{shared_dir(spark)}/reference-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    actual = C.manifest(spark, sf, "*.parquet")
    if C.frozen(spark, store) is None:
        C.freeze(spark, actual, store)
    return C.manifest_report(actual, C.frozen(spark, store)[0]).select("file", "sha256", "problem")


FP_FIELDS = ("item_id", "title", "view", "coin", "fav", "like_cnt")
FP_ROW = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in FP_FIELDS) + ")"


FP_LANES = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {15 * k + 1}, 15)) AS BIGINT)) AS VARCHAR)" for k in range(4))
FP_SQL = f"SELECT sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {FP_LANES})) AS fingerprint FROM (SELECT sha256({FP_ROW}) AS h FROM items)"


@query("catalog_fingerprint", ["items"], FP_SQL)
def catalog_fingerprint(spark, sf):
    return K.fingerprint(V.items(spark, sf), FP_FIELDS)


@query("append_only_sink", ["captures"], "SELECT strftime(ts, '%Y%m%d') AS capture_day, count(*) AS n, round(sum(counter), 3) AS total FROM captures GROUP BY 1")
def append_only_sink(spark, sf):
    path = f"{shared_dir(spark)}/append-{uuid.uuid4().hex}"
    K.append_only(V.captures(spark, sf).withColumn("capture_day", F.date_format("ts", "yyyyMMdd")), path)
    return spark.read.parquet(path).groupBy(F.col("capture_day").cast("string").alias("capture_day")).agg(F.count("*").alias("n"), F.round(F.sum("counter"), 3).alias("total"))


@query("content_addressed_pages", ["items"], """SELECT source, page, count(*) AS n, substr(sha256(string_agg(item_id || '|' || title || '|' || view, chr(10) ORDER BY pos)), 1, 20) AS page_id FROM (SELECT *, pos // 96 AS page FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY view DESC, item_id) - 1 AS pos FROM items)) GROUP BY source, page""")
def content_addressed_pages(spark, sf):
    return K.pages(V.items(spark, sf), "source", [F.desc("view"), "item_id"], ["item_id", "title", "view"]).drop("body")


@query("published_pages", ["items"], """SELECT source AS stream, page, count(*) AS n, sha256(string_agg(item_id || '|' || title || '|' || view, chr(10) ORDER BY pos)) AS body_sha256 FROM (SELECT *, pos // 96 AS page FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY view DESC, item_id) - 1 AS pos FROM items)) GROUP BY source, page""")
def published_pages(spark, sf):
    """Pages read back from a store that first held the lower half of the items."""
    store = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    items = V.items(spark, sf)
    for rows in (items.filter("view < 3000"), items):
        K.publish_pages(spark, K.pages(rows, "source", [F.desc("view"), "item_id"], ["item_id", "title", "view"]), store, "source")
    return K.read_pages(spark, store).select("stream", "page", "n", F.sha2("body", 256).alias("body_sha256"))


@query("public_projection", ["flagged"], """SELECT item_id, title, owner_id, view, coin, fav, like_cnt, duration, strftime(pub_ts, '%Y%m%d') AS pub_day, strftime(pub_ts, '%Y%m%d') AS first_seen, category, round(pct, 6) AS pct, ref_n, flags AS screen_flags, cues AS motive_cues FROM flagged""")
def public_projection(spark, sf):
    day = F.date_format("pub_ts", "yyyyMMdd")
    rows = flagged(spark, sf).withColumns({"pub_day": day, "first_seen": day, "screen_flags": F.array_join("screen_flags", ";"), "motive_cues": F.array_join("motive_cues", ";")})
    return rows.select(*PUBLIC_FIELDS)


@query("summary_sink_nan_to_null", ["items"], "SELECT source, count(*) AS n, round(avg(coin * 1e0 / nullif(fav, 0)), 6) AS mean_ratio, CASE WHEN source <> 'MACHINERY' THEN round(avg(view), 2) END AS mean_view FROM items GROUP BY source")
def summary_sink_nan_to_null(spark, sf):
    ratio = F.when(F.col("fav") > 0, F.col("coin") / F.col("fav"))
    out = V.items(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.avg(ratio).alias("mean_ratio"), F.round(F.avg("view"), 2).alias("v")).withColumn(
        "mean_view", F.when(F.col("source") == "MACHINERY", F.lit(float("nan"))).otherwise(F.col("v"))).drop("v")
    path = f"{shared_dir(spark)}/summary-{uuid.uuid4().hex}"
    K.nan_to_null(out).write.json(path)
    return spark.read.schema(out.schema).json(path)


@query("capture_layer_counts", ["items"], f"SELECT split_part({LABELLED_SOURCE}, ':', 1) AS layer, count(*) AS n FROM items GROUP BY 1")
def capture_layer_counts(spark, sf):
    return V.items(spark, sf).groupBy(F.split_part(labelled_source(), F.lit(":"), F.lit(1)).alias("layer")).agg(F.count("*").alias("n"))


@query("equidistant_gap_sample", [], """SELECT number, n AS missing FROM (SELECT number, row_number() OVER (ORDER BY number) - 1 AS pos, count(*) OVER () AS n FROM (SELECT unnest(generate_series(1, (SELECT max(o_orderkey) FROM orders))) AS number)
  WHERE number NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)) WHERE pos % greatest(1, n // 180) = 0""")
def equidistant_gap_sample(spark, sf):
    """Numbers with no record, thinned to about 180 at even steps."""
    present = V.table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("number"))
    top = V.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    missing = spark.range(1, top + 1).withColumnRenamed("id", "number").join(present, "number", "left_anti")
    placed = O.positions(missing, [], ["number"])
    return placed.filter(F.col("pos") % F.greatest(F.lit(1), F.floor(F.col("group_n") / 180)) == 0).select("number", F.col("group_n").alias("missing"))
