"""Queries over content streams and object graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.operators import contentstream as cs
from inkfold.operators import graphs as gr
from inkfold.plans.registry import query
from inkfold.plans.sql import with_
from inkfold.sources import evidence as ev
from inkfold.sources.tables import table


def _streams(spark, d):
    """One stream per path of strokes: style, a polyline, a curve or a rectangle, and now and then an unknown operator."""
    s = ev.strokes(spark, d)
    num = lambda c: F.format_string("%.2f", F.col(c))
    line = F.concat_ws(" ", num("ax"), num("ay"), F.lit("m"), num("bx"), num("by"), F.when(F.expr("seg % 3 = 0"), F.concat(num("mx0"), F.lit(" "), num("my1"), F.lit(" "), num("mx1"), F.lit(" "), num("my0"), F.lit(" c"))).otherwise("l"))
    line = F.when(F.expr("seg % 5 = 0"), F.concat_ws(" ", num("ax"), num("ay"), F.lit("20 30 re"))).otherwise(line)
    paint = F.when(F.expr("seg % 4 = 3"), "f").when(F.expr("seg % 7 = 6"), "B").otherwise("S")
    style = F.concat_ws(" ", num("line_width"), F.lit("w"), F.expr("path % 3").cast("string"), F.lit("J [5 3] 0 d 0.2 0.4 0.6 RG"))
    odd = F.when(F.expr("path % 101 = 0 and seg = 1"), " zz").otherwise("")
    part = F.concat(F.lit("q "), style, F.lit("\n"), line, F.lit(" "), paint, F.lit(" Q"), odd)
    grouped = s.withColumn("part", part).groupBy("path").agg(
        F.expr("listagg(part, '\n') WITHIN GROUP (ORDER BY seg)").cast("binary").alias("stream"), F.array(F.array(*[F.max(c) for c in ("mx0", "my0", "mx1", "my1")])).alias("marks"),
    )
    return grouped.withColumnRenamed("path", "doc_id")


@query("content_stream_tokens")
def content_stream_tokens(spark, d):
    return cs.token_counts(_streams(spark, d))


@query("content_stream_clip")
def content_stream_clip(spark, d):
    out = cs.clip_streams(_streams(spark, d))
    return out.select("doc_id", F.col("clipped").isNotNull().alias("changed"), F.octet_length("clipped").cast("long").alias("clipped_bytes"), F.md5("clipped").alias("clipped_md5"), "error")


@query("stroke_rewrites")
def stroke_rewrites(spark, d):
    """How many runs each rewritten stream has, and how many fills for its round or square caps."""
    out = cs.clip_streams(_streams(spark, d)).where("clipped is not null").withColumn("text", F.decode("clipped", "ISO-8859-1"))
    return out.select("doc_id", F.regexp_count("text", F.lit(r"(?m)^S$")).cast("long").alias("stroke_runs"), F.regexp_count("text", F.lit(r"(?m)^f$")).cast("long").alias("cap_fills"), F.md5("clipped").alias("clipped_md5"))


@query("form_clip")
def form_clip(spark, d):
    """Pages that draw their strokes as a form, shifted; one path in 13 draws it within itself, one in 17 lacks it."""
    s = _streams(spark, d)
    drawn = F.lit("q 1 0 0 1 5 7 cm /F0 Do Q\n").cast("binary")
    inner = F.when(F.expr("doc_id % 13 = 0"), F.concat("stream", F.lit("\n/F0 Do").cast("binary"))).when(F.expr("doc_id % 17 <> 0"), F.col("stream"))
    form = F.struct(F.lit("F0").alias("name"), inner.alias("stream"), F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1, -5, -7)]).alias("matrix"))
    out = cs.clip_pages(s.select("doc_id", drawn.alias("stream"), "marks", F.array(form).alias("forms")))
    changed = F.element_at("forms", F.lit("F0"))
    return out.select("doc_id", F.col("clipped").isNotNull().alias("changed"), changed.isNotNull().alias("form_changed"), F.md5(changed).alias("form_md5"), "error")


@query("curve_partition")
def curve_partition(spark, d):
    s = ev.strokes(spark, d).select(
        (F.col("path") * 100 + F.col("seg")).alias("id"), F.array("ax", "ay", "mx0", "my1", "mx1", "my0", "bx", "by").alias("points"), F.array("mx0", "my0", "mx1", "my1").alias("mark"),
    )
    out = cs.curve_ranges(s)
    return out.select("id", "ranges", F.round("share", 6).alias("share"), F.round("length", 4).alias("length"), F.round("kept_length", 4).alias("kept_length"))


def _objects(spark, d, count: str):
    """doc_id, parent, child: a binary tree of ``count`` objects under node 0, with a back edge in every ninth document."""
    ids = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.expr(count).alias("n"))
    tree = ids.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("child")).select("doc_id", F.expr("(child - 1) div 2").alias("parent"), "child")
    back = ids.where("doc_id % 9 = 0 and n > 1").select("doc_id", F.col("n").alias("parent"), F.lit(1).cast("long").alias("child"))
    return ids.select("doc_id"), tree.unionByName(back)


_TREE = "SELECT page_id AS doc_id, (k - 1) // 2 AS parent, k AS child FROM (SELECT page_id, unnest(range(1, {0} + 1)) AS k FROM pages) UNION ALL SELECT page_id, {0}, 1 FROM pages WHERE page_id % 9 = 0 AND {0} > 1"


@query(
    "object_graph_walk",
    with_(
        """SELECT doc_id, count(*) - 1 AS objects, coalesce(max(CASE WHEN node > 0 AND node % 3 = 0 AND level <= 3 THEN 10000 * (1 + (doc_id + node) % 30) * (1 + (doc_id * node) % 40) END), 0) AS max_image_pixels,
        bool_or(node % 7 = 5 AND level <= 3) AS uses_optional_content, bool_or(node % 11 = 10 AND level <= 4) AS mentions_script FROM w GROUP BY doc_id""",
        recursive=True, edges=_TREE.format("page_id % 24"),
        w="SELECT page_id AS doc_id, 0::BIGINT AS node, 0 AS level, [0::BIGINT] AS trail FROM pages UNION ALL SELECT w.doc_id, e.child, level + 1, list_append(trail, e.child) FROM w JOIN edges e ON e.doc_id = w.doc_id AND e.parent = w.node WHERE level < 4 AND NOT list_contains(trail, e.child)",
    ),
)
def object_graph_walk(spark, d):
    """Objects within four steps; images within three (two nested forms); gates and scripts by depth."""
    ids, edges = _objects(spark, d, "page_id % 24")
    seen = gr.walk(ids.withColumn("node", F.lit(0).cast("long")), edges, 4, {})
    pixels = F.expr("10000 * (1 + (doc_id + node) % 30) * (1 + (doc_id * node) % 40)")
    return seen.groupBy("doc_id").agg(
        (F.count("*") - 1).alias("objects"), F.coalesce(F.max(F.when(F.expr("node > 0 and node % 3 = 0 and level <= 3"), pixels)), F.lit(0)).alias("max_image_pixels"),
        F.bool_or(F.expr("node % 7 = 5 and level <= 3")).alias("uses_optional_content"), F.bool_or(F.expr("node % 11 = 10 and level <= 4")).alias("mentions_script"),
    )


@query(
    "name_tree_walk",
    with_(
        "SELECT doc_id, name FROM w WHERE node > 0 AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.doc_id = w.doc_id AND t.parent = w.node)",
        recursive=True, tree="SELECT page_id AS doc_id, (k - 1) // 2 AS parent, k AS child FROM (SELECT page_id, unnest(range(1, page_id % 14 + 1)) AS k FROM pages)",
        w="SELECT page_id AS doc_id, 0::BIGINT AS node, '' AS name, 0 AS level FROM pages UNION ALL SELECT w.doc_id, t.child, CASE WHEN name = '' THEN '' ELSE name || '.' END || 'f' || t.child, level + 1 FROM w JOIN tree t ON t.doc_id = w.doc_id AND t.parent = w.node WHERE level < 8",
    ),
)
def name_tree_walk(spark, d):
    """Field names flattened along the tree, leaves only."""
    ids = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.expr("page_id % 14").alias("n"))
    edges = ids.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("child")).select("doc_id", F.expr("(child - 1) div 2").alias("parent"), "child")
    step = F.concat(F.when(F.col("name") == "", "").otherwise(F.concat("name", F.lit("."))), F.lit("f"), F.col("child").cast("string"))
    seen = gr.walk(ids.select("doc_id", F.lit(0).cast("long").alias("node"), F.lit("").alias("name")), edges, 8, {"name": step})
    inner = edges.select("doc_id", F.col("parent").alias("node")).distinct()
    return seen.where("node > 0").join(inner, ["doc_id", "node"], "left_anti").select("doc_id", "name")


@query(
    "form_recursion",
    with_(
        """SELECT w.doc_id, count(DISTINCT (node, s, e)) AS placements, max(level)::BIGINT AS depth, round(max(e), 6) AS farthest, bool_or(EXISTS (SELECT 1 FROM edges x WHERE x.doc_id = w.doc_id AND x.parent = w.node AND list_contains(w.trail, x.child))) AS is_cyclic FROM w GROUP BY w.doc_id""",
        recursive=True, edges=_TREE.format("page_id % 10"),
        w="""SELECT page_id AS doc_id, 0::BIGINT AS node, 1e0 AS s, 0e0 AS e, 0 AS level, [0::BIGINT] AS trail FROM pages UNION ALL
          SELECT w.doc_id, x.child, s * (1 + x.child % 2), s * 10 * x.child + e, level + 1, list_append(trail, x.child) FROM w JOIN edges x ON x.doc_id = w.doc_id AND x.parent = w.node WHERE level < 16 AND NOT list_contains(trail, x.child)""",
    ),
)
def form_recursion(spark, d):
    """Nested forms with their placement: scale and offset compose outward, a form on its own trail is a cycle."""
    ids, edges = _objects(spark, d, "page_id % 10")
    roots = ids.select("doc_id", F.lit(0).cast("long").alias("node"), F.lit(1.0).alias("s"), F.lit(0.0).alias("e"))
    scale = (1 + F.col("child") % 2).cast("double")
    seen = gr.walk(roots, edges, 16, {"s": F.col("s") * scale, "e": F.col("s") * 10 * F.col("child") + F.col("e")})
    loops = gr.cyclic(seen, edges).withColumn("is_cyclic", F.lit(True))
    out = seen.groupBy("doc_id").agg(F.count_distinct("node", "s", "e").alias("placements"), F.max("level").cast("long").alias("depth"), F.round(F.max("e"), 6).alias("farthest"))
    return out.join(loops, "doc_id", "left").withColumn("is_cyclic", F.coalesce("is_cyclic", F.lit(False)))
