"""Queries on score tables, run logs and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import compare as c
from tessella.plans.fixtures import scores, sql, table
from tessella.plans.registry import register
from tessella.sources import tables

A, B = "1-URGENT", "5-LOW"
ROI = ("dataset", "category", "sample_id")
METHODS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@register("macro_means", sql("scores", "SELECT dataset, method, round(avg(br_mean_strict), 6) AS br, round(avg(fb_mean_strict), 6) AS fb, round(avg(f_area_mean_strict), 6) AS fa, round(avg(pixel_dice), 6) AS dice, count(*) AS n FROM scores GROUP BY ALL"))
def macro_means(spark, d):
    rows = c.means(scores(spark, d), ["br_mean_strict", "fb_mean_strict", "f_area_mean_strict", "pixel_dice"], ("dataset", "method"))
    return rows.select("dataset", "method", *[F.round(k, 6).alias(n) for k, n in (("br_mean_strict", "br"), ("fb_mean_strict", "fb"), ("f_area_mean_strict", "fa"), ("pixel_dice", "dice"))], "n")


MEANS = "SELECT method, avg(br_mean_strict) AS br, count(*) AS n FROM scores GROUP BY method"


@register("macro_winner", sql("scores", "SELECT method, round(br, 6) AS mean FROM m ORDER BY br DESC, method LIMIT 1", m=MEANS))
def macro_winner(spark, d):
    means = c.means(scores(spark, d), ["br_mean_strict"])
    ranked = means.withColumn("order", F.substr("method", F.lit(1), F.lit(1)).cast("int"))
    return c.winner(ranked, "br_mean_strict", "order").select("method", F.round("mean", 6).alias("mean"))


PAIRS = f"SELECT dataset, category, sample_id, max(br_mean_strict) FILTER (method = '{A}') AS a, max(br_mean_strict) FILTER (method = '{B}') AS b FROM scores GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL"


def pairs(spark, d):
    return c.paired(scores(spark, d), A, B, "br_mean_strict", ROI)


@register("pairwise_wins", sql("scores", "SELECT count(*) FILTER (a - b > 0.01) AS wins, count(*) FILTER (a - b < -0.01) AS losses, count(*) FILTER (abs(a - b) <= 0.01) AS ties FROM p", p=PAIRS))
def pairwise_wins(spark, d):
    return c.head_to_head(pairs(spark, d))


@register("best_on_roi", sql("scores", """SELECT CASE WHEN k = 1 THEN method ELSE 'tie' END AS winner, count(*) AS n FROM (SELECT dataset, category, sample_id, count(*) AS k, min(method) AS method FROM (
    SELECT *, max(br_mean_strict) OVER w AS top, count(*) OVER w AS m FROM scores WINDOW w AS (PARTITION BY dataset, category, sample_id)) WHERE m >= 2 AND abs(br_mean_strict - top) <= 0.01 GROUP BY ALL) GROUP BY 1"""))  # fmt: skip
def best_on_roi(spark, d):
    return c.best_on_sample(scores(spark, d), "br_mean_strict", ROI)


@register("multiway_wins", sql("scores", """SELECT CASE WHEN v1 - v2 > 0.02 THEN method ELSE 'tie' END AS winner, count(*) AS n FROM (SELECT k.*, s.method, coalesce(br_mean_strict, 0) AS v1, lead(coalesce(br_mean_strict, 0)) OVER w AS v2, row_number() OVER w AS r
    FROM (SELECT DISTINCT dataset, category, sample_id FROM scores) k CROSS JOIN (SELECT DISTINCT method FROM scores) s LEFT JOIN scores USING (dataset, category, sample_id, method) WINDOW w AS (PARTITION BY dataset, category, sample_id ORDER BY coalesce(br_mean_strict, 0) DESC, s.method)) WHERE r = 1 GROUP BY 1"""))  # fmt: skip
def multiway_wins(spark, d):
    return c.multiway(scores(spark, d), "br_mean_strict", ROI, METHODS)


@register("delta_vs_reference", sql("scores", f"SELECT method, round(br, 6) AS br, round(br - (SELECT br FROM m WHERE method = '{A}'), 6) AS delta, n FROM m", m=MEANS))
def delta_vs_reference(spark, d):
    rows = c.against(c.means(scores(spark, d), ["br_mean_strict"]), A, "br_mean_strict")
    return rows.select("method", F.round("br_mean_strict", 6).alias("br"), F.round("delta", 6).alias("delta"), "n")


@register("method_pivot", sql("scores", "SELECT dataset, category, sample_id, " + ", ".join(f"max(br_mean_strict) FILTER (method = '{m}') AS m{m[0]}" for m in METHODS) + " FROM scores GROUP BY ALL"))
def method_pivot(spark, d):
    return scores(spark, d).groupBy(*ROI).pivot("method", list(METHODS)).agg(F.max("br_mean_strict")).select(*ROI, *[F.col(f"`{m}`").alias(f"m{m[0]}") for m in METHODS])


@register("grouping_sets_summary", sql("scores", "SELECT coalesce(dataset, 'ALL') AS dataset, method, round(avg(pixel_dice), 6) AS dice, count(*) AS n FROM scores GROUP BY GROUPING SETS ((dataset, method), (method))"))
def grouping_sets_summary(spark, d):
    rows = tables.report(scores(spark, d), ["pixel_dice"])
    again = scores(spark, d).groupingSets([["dataset", "method"], ["method"]], "dataset", "method").agg(F.round(F.avg("pixel_dice"), 6).alias("dice"))
    return again.withColumn("dataset", F.coalesce("dataset", F.lit("ALL"))).join(rows.select("dataset", "method", "n"), ["dataset", "method"])


DELTA = "SELECT *, round(a - b, 9) AS d FROM p"


@register("topk_winners", sql("scores", "SELECT side, place, dataset, category, sample_id, d FROM (SELECT *, CASE WHEN d > 0 THEN 'a' ELSE 'b' END AS side, CAST(row_number() OVER (PARTITION BY d > 0 ORDER BY abs(d) DESC, dataset, category, sample_id) AS INTEGER) AS place FROM q WHERE abs(d) >= 0.01) WHERE place <= 8", p=PAIRS, q=DELTA))
def topk_winners(spark, d):
    """The eight largest differences of each side that exceed a least difference."""
    rows = pairs(spark, d).withColumn("d", F.round(F.col("a") - F.col("b"), 9)).where("abs(d) >= 0.01").withColumn("side", F.when(F.col("d") > 0, "a").otherwise("b"))
    at = F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs("d")), *ROI))
    return rows.withColumn("place", at).where("place <= 8").select("side", "place", *ROI, "d")


@register("exemplar_pick", sql("scores", "SELECT category, arg_max(sample_id, struct_pack(d := d, s := sample_id)) AS sample_id, round(max(d), 6) AS d FROM (SELECT category, sample_id, round(avg(a - b), 9) AS d FROM p GROUP BY ALL) WHERE d > 0.0 GROUP BY category", p=PAIRS))
def exemplar_pick(spark, d):
    rows = pairs(spark, d).groupBy("category", "sample_id").agg(F.round(F.avg(F.col("a") - F.col("b")), 9).alias("d")).where("d > 0.0")
    return rows.groupBy("category").agg(F.max_by("sample_id", F.struct("d", "sample_id")).alias("sample_id"), F.round(F.max("d"), 6).alias("d"))


@register("paired_stats_core", sql("scores", "SELECT count(*) AS n, round(avg(a - b), 6) AS delta, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t, round(avg(a - b) / stddev_samp(a - b), 6) AS cohens_d FROM p", p=PAIRS))
def paired_stats_core(spark, d):
    return c.paired_statistics(pairs(spark, d)).select("n", F.round("delta", 6).alias("delta"), F.round("t", 6).alias("t"), F.round("cohens_d", 6).alias("cohens_d"))


@register("signed_rank_sums", sql("scores", """SELECT CAST(coalesce(sum(t), 0) AS BIGINT) AS n, CAST(coalesce(sum(up * r), 0) AS DOUBLE) AS plus, CAST(coalesce(sum((t - up) * r), 0) AS DOUBLE) AS minus, CAST(coalesce(sum(t * t * t - t), 0) AS BIGINT) AS ties, CAST((SELECT count(*) FILTER (d = 0) FROM g) AS BIGINT) AS zeros
    FROM (SELECT size, count(*) AS t, count(*) FILTER (d > 0) AS up, min(low) + (count(*) - 1) / 2.0 AS r FROM (SELECT d, abs(d) AS size, rank() OVER (ORDER BY abs(d)) AS low FROM g WHERE d <> 0) GROUP BY size)""",
    p=PAIRS, g="SELECT round(a - b, 9) AS d FROM p"))
def signed_rank_sums(spark, d):
    return c.signed_ranks(pairs(spark, d))


#: Tails of the t and the normal distribution as finite or fast series of positive terms; more than 50 differences, so no exact count of rank sums.
TAILS = {
    "core": "SELECT count(*) AS n, avg(a - b) AS delta, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t, avg(a - b) / stddev_samp(a - b) AS cohens_d FROM p",
    "turned": "SELECT n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS theta FROM core",
    "terms": "SELECT v, theta, j, exp(sum(ln(CASE WHEN v % 2 = 0 THEN (2 * j - 1) / (2.0 * j) ELSE 2 * j / (2 * j + 1.0) END * cos(theta) * cos(theta))) OVER (ORDER BY j)) AS term FROM turned, range(1, 5000) r(j) WHERE j <= CASE WHEN v % 2 = 0 THEN (v - 2) // 2 ELSE (v - 3) // 2 END",
    "tail": "SELECT CASE WHEN any_value(v) % 2 = 0 THEN 1 - sin(any_value(theta)) * (1 + sum(term)) ELSE 1 - 2 / pi() * (any_value(theta) + sin(any_value(theta)) * cos(any_value(theta)) * (1 + sum(term))) END AS p_t FROM terms",
    "sized": "SELECT size, count(*) AS t, count(*) FILTER (d > 0) AS up, min(low) + (count(*) - 1) / 2.0 AS r FROM (SELECT d, abs(d) AS size, rank() OVER (ORDER BY abs(d)) AS low FROM (SELECT round(a - b, 9) AS d FROM p) WHERE d <> 0) GROUP BY size",
    "z": "SELECT abs(sum(up * r) - sum(t) * (sum(t) + 1) / 4.0) / sqrt((sum(t) * (sum(t) + 1) * (2 * sum(t) + 1) - sum(t * t * t - t) / 2.0) / 24) / sqrt(2.0) AS x FROM sized",
    "normal": "SELECT 1 - 2 / sqrt(pi()) * exp(-x * x) * sum(term) AS p_w FROM (SELECT x, exp(sum(ln(CASE WHEN j = 0 THEN x ELSE 2 * x * x / (2 * j + 1) END)) OVER (ORDER BY j)) AS term FROM z, range(0, 200) r(j)) GROUP BY x",
}


@register("paired_tests", sql("scores", "SELECT n, round(delta, 9) AS delta, round(t, 9) AS t, round(cohens_d, 9) AS cohens_d, round(p_t, 9) AS p_t, round(p_w, 9) AS p_w FROM core, tail, normal", p=PAIRS, **TAILS))
def paired_tests(spark, d):
    return c.paired_tests(pairs(spark, d)).select("n", *[F.round(x, 9).alias(x) for x in ("delta", "t", "cohens_d", "p_t", "p_w")])


@register("macro_spread", sql("scores", f"""SELECT s.method, s.metric, count(*) AS n, round(avg(s.v), 6) AS mean, round(stddev_samp(s.v), 6) AS sd, count(b.v) AS pairs, round(avg(s.v - b.v), 6) AS delta, round(CASE WHEN stddev_samp(s.v - b.v) > 0 THEN avg(s.v - b.v) / (stddev_samp(s.v - b.v) / sqrt(count(b.v))) END, 6) AS t
    FROM long s LEFT JOIN long b ON b.method = '{B}' AND s.metric = b.metric AND s.dataset = b.dataset AND s.category = b.category AND s.sample_id = b.sample_id GROUP BY ALL""",
    long="SELECT * FROM (UNPIVOT (SELECT dataset, category, sample_id, method, br_mean_strict, fb_mean_strict, f_area_mean_strict, pixel_dice FROM scores) ON br_mean_strict, fb_mean_strict, f_area_mean_strict, pixel_dice INTO NAME metric VALUE v)"))
def macro_spread(spark, d):
    """Means with their spread by method and metric, and paired differences from one method."""
    found = c.spread(scores(spark, d), ["br_mean_strict", "fb_mean_strict", "f_area_mean_strict", "pixel_dice"], B, ROI)
    return found.select("method", "metric", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "pairs", F.round("delta", 6).alias("delta"), F.round("t", 6).alias("t"))


@register("bootstrap_ci_hash", sql("scores", """SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (SELECT round, avg(d) AS m FROM (SELECT r.round, 1 + CAST('0x' || md5(r.round || '-' || i)[1:8] AS BIGINT) % n AS pick FROM num, range(1, 201) r(round)) JOIN (SELECT i AS pick, d FROM num) USING (pick) GROUP BY round)""",
    p=PAIRS, num="SELECT a - b AS d, row_number() OVER (ORDER BY dataset, category, sample_id) AS i, count(*) OVER () AS n FROM p"))
def bootstrap_ci_hash(spark, d):
    return c.bootstrap(pairs(spark, d), ROI).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@register("keep_latest", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_latest(spark, d):
    return c.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@register("skip_done_antijoin", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def skip_done_antijoin(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return c.pending(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@register("shard_limit", "SELECT url, place FROM (SELECT url, CAST(row_number() OVER (ORDER BY url, page_id) - 1 AS INTEGER) AS place FROM pages) WHERE place % 4 = 1 AND place < 4 * 20")
def shard_limit(spark, d):
    pages = table(spark, d, "pages").withColumn("key", F.struct("url", "page_id"))
    return c.shard(pages, "key", 4, 1, 20).select("url", F.col("at").alias("place"))


@register("progress_eta", "SELECT event_type, done, total, round(CASE WHEN total > 0 THEN 100 * done / total ELSE 0 END, 2) AS pct, round(CASE WHEN el > 0 AND done > 0 THEN (total - done) / (done / el) ELSE 0 END, 1) AS eta FROM (SELECT event_type, count(*) FILTER (value > 50) AS done, count(*) AS total, CAST(max(user_id) + 1 AS DOUBLE) AS el FROM events GROUP BY event_type)")
def progress_eta(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("done"), F.count("*").alias("total"), (F.max("user_id") + 1).cast("double").alias("el"))
    p = c.progress(F.col("done"), F.col("total"), F.col("el"))
    return rows.select("event_type", "done", "total", p["pct"].alias("pct"), p["eta"].alias("eta"))


@register("configuration_grid", "SELECT DISTINCT n_name, conn, crit FROM nation, (SELECT unnest(['fmax', 'fsum']) AS conn), (SELECT unnest(['minsc', 'maxsc', 'size']) AS crit) WHERE NOT (conn = 'fsum' AND crit = 'size')")
def configuration_grid(spark, d):
    """Every sample with every configuration that a small table allows."""
    kinds = spark.createDataFrame([(a, b) for a in ("fmax", "fsum") for b in ("minsc", "maxsc", "size") if (a, b) != ("fsum", "size")], "conn string, crit string")
    return table(spark, d, "nation").select("n_name").distinct().crossJoin(F.broadcast(kinds))  # five configurations


@register("report_lines", sql("scores", "SELECT coalesce(dataset, 'ALL') AS dataset, n, '| ' || method || ' | ' || printf('%.4f', br) || ' | ' || n || ' |' AS line FROM (SELECT dataset, method, avg(br_mean_strict) AS br, count(*) AS n FROM scores GROUP BY GROUPING SETS ((dataset, method), (method)))"))
def report_lines(spark, d):
    return tables.report(scores(spark, d), ["br_mean_strict"]).select("dataset", "n", "line")


@register("natural_sort", "SELECT p_name || p_size AS name, array_to_string(list_transform(regexp_extract_all(p_name || p_size, '(\\d+|\\D+)'), lambda s: CASE WHEN regexp_matches(s, '^\\d') THEN lpad(s, 20, '0') ELSE s END), '') AS key FROM part")
def natural_sort(spark, d):
    return table(spark, d, "part").select(F.concat("p_name", "p_size").alias("name")).withColumn("key", t.natural_key(F.col("name")))


NAMES = "SELECT p_partkey, 'dir/img' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '_masks' WHEN 1 THEN '_flows' WHEN 2 THEN '' ELSE '_x' END || CASE p_size % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.TIF' ELSE '.txt' END AS path FROM part"


@register("suffix_antifilter", f"SELECT path FROM ({NAMES}) WHERE p_partkey % 4 >= 2 AND (path LIKE '%.png' OR path LIKE '%.TIF')")
def suffix_antifilter(spark, d):
    k = F.col("p_partkey") % 4
    path = F.concat(F.lit("dir/img"), "p_partkey", F.when(k == 0, "_masks").when(k == 1, "_flows").when(k == 2, "").otherwise("_x"), F.when(F.col("p_size") % 3 == 0, ".png").when(F.col("p_size") % 3 == 1, ".TIF").otherwise(".txt"))
    return table(spark, d, "part").select(path.alias("path")).where(t.is_image(F.col("path")))


@register("slug", "SELECT p_partkey, CASE WHEN s = '' THEN 'layer' ELSE s END AS slug FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_brand || ') ' || p_type)), '\\s*\\(.*?\\)\\s*', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM part)")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", t.slug(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") "), F.col("p_type"))).alias("slug"))


LINES = """SELECT event_id AS n, CASE event_id % 5 WHEN 0 THEN 'label ' || user_id || ': bbox=(' || (event_id % 7) || ',9,' || (event_id % 3) || ',8) placed_pixels=' || (event_id % 90) WHEN 1 THEN 'label ' || user_id || ': area=' || (event_id % 50) || ' < min_cell_area, kept Base mask'
    WHEN 2 THEN 'label ' || user_id || ': no fg seeds, kept Base mask' WHEN 3 THEN 'label ' || user_id || ': Tool failed (code ' || (event_id % 4) || '), kept Base mask' ELSE 'start of ' || user_id END AS line FROM events"""


@register("log_regex_parse", f"""SELECT CAST(user_id AS INTEGER) AS label, status, r0, r1, c0, c1, placed, error FROM (SELECT user_id, event_id, ['pasted', 'min_cell_area_fallback', 'no_fg_seeds_fallback', 'failed_fallback'][event_id % 5 + 1] AS status,
    CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 7 END AS INTEGER) AS r0, CASE WHEN event_id % 5 = 0 THEN 9 END AS r1, CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 3 END AS INTEGER) AS c0, CASE WHEN event_id % 5 = 0 THEN 8 END AS c1,
    CAST(CASE event_id % 5 WHEN 0 THEN event_id % 90 WHEN 1 THEN event_id % 50 END AS INTEGER) AS placed, CASE WHEN event_id % 5 = 3 THEN 'code ' || (event_id % 4) END AS error FROM events WHERE event_id % 5 < 4)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")  # fmt: skip
def log_regex_parse(spark, d):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    head = F.concat(F.lit("label "), u, F.lit(": "))
    s = lambda x: x.cast("string")
    line = (
        F.when(e % 5 == 0, F.concat(head, F.lit("bbox=("), s(e % 7), F.lit(",9,"), s(e % 3), F.lit(",8) placed_pixels="), s(e % 90)))
        .when(e % 5 == 1, F.concat(head, F.lit("area="), s(e % 50), F.lit(" < min_cell_area, kept Base mask")))
        .when(e % 5 == 2, F.concat(head, F.lit("no fg seeds, kept Base mask")))
        .when(e % 5 == 3, F.concat(head, F.lit("Tool failed (code "), s(e % 4), F.lit("), kept Base mask")))
        .otherwise(F.concat(F.lit("start of "), u))
    )
    return t.parse_log(table(spark, d, "events").select(e.alias("n"), line.alias("line"))).select("label", "status", "r0", "r1", "c0", "c1", "placed", "error")


@register("first_existing", "SELECT c_nationkey, c_custkey, c_name FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1")
def first_existing(spark, d):
    rows = table(spark, d, "customer").where("c_acctbal > 0").select("c_nationkey", "c_custkey", "c_name")
    return t.first_existing(rows, "c_nationkey", "c_custkey")


@register("latex_escape", "SELECT p_partkey, replace(replace(replace(replace(p_brand || '_100%&' || p_type, '&', '\\&'), '%', '\\%'), '_', '\\_'), '#', '\\#') AS tex FROM part")
def latex_escape(spark, d):
    return table(spark, d, "part").select("p_partkey", t.latex_escape(F.concat("p_brand", F.lit("_100%&"), "p_type")).alias("tex"))


XML = "'<Annotations><Region Id=\"1\"><Vertices><Vertex X=\"' || p_size || '\" Y=\"1.5\"/><Vertex X=\"2\" Y=\"' || p_partkey || '\"/></Vertices></Region><Region Id=\"2\"><Vertices><Vertex X=\"3\" Y=\"4\"/></Vertices></Region></Annotations>'"


@register("xml_polygons", """SELECT p_partkey, r AS region, v AS vertex, CAST(CASE WHEN r = 2 THEN 3 WHEN v = 1 THEN p_size ELSE 2 END AS DOUBLE) AS x, CAST(CASE WHEN r = 2 THEN 4 WHEN v = 1 THEN 1.5 ELSE p_partkey END AS DOUBLE) AS y FROM part, (VALUES (1, 1), (1, 2), (2, 1)) n(r, v)""")
def xml_polygons(spark, d):
    xml = F.concat(F.lit('<Annotations><Region Id="1"><Vertices><Vertex X="'), F.col("p_size"), F.lit('" Y="1.5"/><Vertex X="2" Y="'), F.col("p_partkey"), F.lit('"/></Vertices></Region><Region Id="2"><Vertices><Vertex X="3" Y="4"/></Vertices></Region></Annotations>'))
    return tables.polygons(table(spark, d, "part").select("p_partkey", xml.alias("xml"))).select("p_partkey", "region", "vertex", "x", "y")


@register("tile_rectangles", "SELECT p_partkey, CAST(p_size AS INTEGER) AS x1, 2 AS y1, CAST(p_size + 9 AS INTEGER) AS x2, 30 AS y2 FROM part")
def tile_rectangles(spark, d):
    xml = F.concat(F.lit('<tile><bounds x1="'), F.col("p_size"), F.lit('" y1="2" x2="'), F.col("p_size") + 9, F.lit('" y2="30"/></tile>'))
    return table(spark, d, "part").select("p_partkey", xml.alias("xml")).select("p_partkey", *[c_.alias(n) for n, c_ in tables.tile_rectangle("xml").items()])


@register("metric_completeness", "SELECT o_orderkey, CASE WHEN isfinite(v) THEN v END AS v FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE ELSE o_orderkey / 2 END AS v FROM orders)")
def metric_completeness(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, "").when(k % 4 == 1, "NaN").when(k % 4 == 2, "Infinity").otherwise((k / 2).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", c.finite(raw).alias("v"))


@register("path_cost_presets", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'fmax' ELSE 'fsum' END AS conn, CASE WHEN o_orderkey % 2 = 0 THEN 'minsc' ELSE 'maxsc' END AS crit FROM orders")
def path_cost_presets(spark, d):
    """A preset's pair of options, looked up in a map of fixed values."""
    presets = F.create_map(F.lit("irregular"), F.struct(F.lit("fmax").alias("conn"), F.lit("minsc").alias("crit")), F.lit("compact"), F.struct(F.lit("fsum").alias("conn"), F.lit("maxsc").alias("crit")))
    chosen = F.element_at(presets, F.when(F.col("o_orderkey") % 2 == 0, "irregular").otherwise("compact"))
    return table(spark, d, "orders").select("o_orderkey", chosen.alias("p")).select("o_orderkey", "p.conn", "p.crit")
