"""Queries on boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benthos.operators import boxes as B
from benthos.operators import evaluation as E
from benthos.plans.evaluation import LAST
from benthos.plans.registry import query
from benthos.session import written
from benthos.sources.tables import table

PLAIN = r"""lines AS (SELECT pred_no, field, regexp_replace(unnest(string_split(txt, E'\n')), '</?(ref|box)>', '', 'g') AS line FROM (SELECT pred_no, 'text' AS field, text AS txt FROM predictions UNION ALL SELECT pred_no, 'gt', gt FROM predictions) WHERE txt IS NOT NULL),
parted AS (SELECT pred_no, field, CASE WHEN contains(line, '[[') THEN string_split(line, '[[') ELSE string_split(line, ':') END AS p FROM lines),
shaped AS (SELECT pred_no, field, lower(trim(regexp_replace(p[1], '[0-9:]', '', 'g'))) AS category, list_transform(list_filter(list_transform(string_split(trim(trim(p[2]), '[]'), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: try_cast(x AS DOUBLE)) AS v FROM parted WHERE len(p) = 2),
bad AS (SELECT DISTINCT pred_no, field FROM shaped WHERE len(v) = 0 OR len(list_filter(v, lambda x: x IS NULL)) > 0),
plain AS (SELECT pred_no, field, category, CASE WHEN list_max(v) > 1 THEN list_transform(v, lambda x: x/1000) ELSE v END AS v FROM shaped s ANTI JOIN bad b ON s.pred_no=b.pred_no AND s.field=b.field WHERE len(v) = 4)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(pred_no, field, txt)"""
    p = table(spark, d, "predictions")
    return p.select("pred_no", F.inline(F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("txt")), F.struct(F.lit("gt").alias("field"), F.col("gt").alias("txt"))))).where("txt is not null")


@query(f"WITH {PLAIN} SELECT pred_no, field, category, v[1] AS x1, v[2] AS y1, v[3] AS x2, v[4] AS y2 FROM plain")
def box_parse_plain(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("pred_no", "field", F.inline(B.parse_plain(F.col("txt"))))


JSON = r"""objs AS (SELECT pred_no, field, input_width AS w, input_height AS h, lower(o->>'$.label') AS category, CAST(o->'$.bbox_2d' AS DOUBLE[]) AS v FROM (SELECT pred_no, field, input_width, input_height, unnest(CAST('[' || txt || ']' AS JSON[])) AS o FROM (SELECT pred_no, 'text' AS field, text AS txt, input_width, input_height FROM predictions UNION ALL SELECT pred_no, 'gt', gt, input_width, input_height FROM predictions) WHERE json_valid('[' || txt || ']') AND starts_with(ltrim(txt), '{')))"""


@query(f"WITH {JSON} SELECT pred_no, field, category, v[1] AS x1, v[2] AS y1, v[3] AS x2, v[4] AS y2 FROM objs WHERE len(v) = 4")
def box_parse_json(spark: SparkSession, d: str) -> DataFrame:
    whole = F.col("txt").rlike(r"^\s*\{") & F.try_parse_json(F.concat(F.lit("["), F.col("txt"), F.lit("]"))).isNotNull()
    return _texts(spark, d).where(whole).select("pred_no", "field", F.inline(B.parse_json(F.col("txt"))))


@query(r"""SELECT pred_no, field, pos::INT AS pos, lower(o->>'$.label') AS category, CAST(o->'$.bbox_2d' AS DOUBLE[]) AS box FROM (SELECT pred_no, field, pos, b2[pos] AS o FROM (SELECT pred_no, field, b2, unnest(range(1, len(b2) + 1)) AS pos FROM (SELECT *, list_filter(b, lambda o: json_valid(o) AND json_array_length(o->'$.bbox_2d') = 4) AS b2 FROM (SELECT pred_no, field, regexp_extract_all(txt, '\{[^{}]*"bbox_2d"[^{}]*\}') AS b FROM (SELECT pred_no, 'text' AS field, text AS txt FROM predictions UNION ALL SELECT pred_no, 'gt', gt FROM predictions)))))""")
def box_extract_json(spark: SparkSession, d: str) -> DataFrame:
    """The box objects that stand anywhere in a text, in order; broken ones are skipped."""
    found = _texts(spark, d).select("pred_no", "field", F.posexplode(B.extract_json(F.col("txt"))).alias("k", "o"))
    return found.select("pred_no", "field", (F.col("k") + 1).alias("pos"), F.lower("o.label").alias("category"), F.col("o.bbox_2d").alias("box"))


ONE = r"""SELECT pred_no, field, dialect, v FROM (
SELECT pred_no, field, 'plain' AS dialect, CASE WHEN list_max(v) > 1 THEN list_transform(v, lambda x: x/1000) ELSE v END AS v FROM (SELECT pred_no, field, list_transform(list_filter(list_transform(string_split(inner_, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: try_cast(x AS DOUBLE)) AS v FROM (SELECT *, trim(trim(CASE WHEN contains(txt, '[[') THEN string_split(regexp_replace(txt, '</?(ref|box)>', '', 'g'), '[[')[-1] ELSE txt END), '[]') AS inner_ FROM t WHERE NOT contains(txt, '],[') AND NOT contains(txt, '], [') AND NOT contains(txt, E'\n')) WHERE NOT contains(inner_, ':')) WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL)) = 0
UNION ALL
SELECT pred_no, field, 'json', CASE WHEN box IS NULL THEN [0.0, 0.0, 0.0, 0.0]::DOUBLE[] ELSE box END FROM (SELECT *, CASE WHEN json_valid(txt) THEN coalesce(try_cast(txt->'$[0].bbox_2d' AS DOUBLE[]), try_cast(txt->'$.bbox_2d' AS DOUBLE[])) END AS box FROM t) WHERE box IS NULL OR NOT (contains(txt, 'Fish') OR contains(txt, '],[') OR contains(txt, '], [')))"""


@query("WITH t AS (SELECT pred_no, field, txt FROM (SELECT pred_no, id, 'text' AS field, text AS txt FROM predictions UNION ALL SELECT pred_no, id, 'gt', gt FROM predictions) WHERE txt IS NOT NULL AND substr(id, 2, 1) = '1') " + ONE)
def grounding_parse(spark: SparkSession, d: str) -> DataFrame:
    """The one box of each grounding answer by the rules of either dialect: left out, or read."""
    ids = table(spark, d, "predictions").where("substring(id, 2, 1) = '1'").select("pred_no")
    t = _texts(spark, d).join(ids, "pred_no")
    both = t.select("pred_no", "field", F.inline(F.array(*(F.struct(F.lit(k).alias("dialect"), f(F.col("txt")).alias("v")) for k, f in (("plain", B.one_plain), ("json", B.one_json))))))
    return both.where("v is not null")


@query(r"""SELECT pred_no, pos::INT AS pos, round_even(x1*sw, 0)::BIGINT AS x1, round_even(y1*sh, 0)::BIGINT AS y1, round_even(x2*sw, 0)::BIGINT AS x2, round_even(y2*sh, 0)::BIGINT AS y2 FROM (
SELECT pred_no, i AS pos, 640.0::DOUBLE/input_width AS sw, 480.0::DOUBLE/input_height AS sh, CAST(v[1] AS DOUBLE) AS x1, CAST(v[2] AS DOUBLE) AS y1, CAST(v[3] AS DOUBLE) AS x2, CAST(v[4] AS DOUBLE) AS y2 FROM (
SELECT pred_no, input_width, input_height, i, regexp_extract_all(b[i], '[0-9]+') AS v FROM (SELECT pred_no, input_width, input_height, b, unnest(range(1, len(b)+1)) AS i FROM (SELECT pred_no, input_width, input_height, regexp_extract_all(prompt, '\[\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*\]') AS b FROM predictions WHERE substr(id,2,1) IN ('2','7') AND input_width IS NOT NULL AND input_height IS NOT NULL))))""")
def box_rescale_text(spark: SparkSession, d: str) -> DataFrame:
    """The coordinates of region prompts after the prompt's boxes are scaled from the input size to 640 x 480."""
    p = table(spark, d, "predictions").where("substring(id, 2, 1) in ('2', '7') and input_width is not null and input_height is not null")
    text = B.rescale_text(F.col("prompt"), F.lit(640.0) / F.col("input_width"), F.lit(480.0) / F.col("input_height"))
    found = p.select("pred_no", F.posexplode(F.regexp_extract_all(text, F.lit(r"\[\d+, \d+, \d+, \d+\]"), 0)).alias("i", "b")).select("pred_no", (F.col("i") + 1).alias("pos"), F.regexp_extract_all("b", F.lit(r"\d+"), 0).cast("array<bigint>").alias("v"))
    return found.select("pred_no", "pos", *(F.col("v")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))


@query(f"WITH {JSON} SELECT pred_no, field, " + ", ".join(f"greatest(0, least(1000, round_even(v[{k+1}]/{s}*1000, 0)))::BIGINT AS {c}" for k, (c, s) in enumerate((("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h")))) + " FROM objs WHERE len(v) = 4 AND w IS NOT NULL AND h IS NOT NULL")
def box_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Absolute boxes as thousandths of the input's sides, clamped."""
    sizes = table(spark, d, "predictions").where("input_width is not null and input_height is not null").select("pred_no", F.col("input_width").alias("w"), F.col("input_height").alias("h"))
    b = box_parse_json(spark, d).join(sizes, "pred_no")
    return b.select("pred_no", "field", *(F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(F.col(c) / F.col(s) * 1000))).cast("bigint").alias(c) for c, s in (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h"))))


SIZES = "(SELECT image, width AS w, height AS h FROM image_meta WHERE image IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL GROUP BY ALL)"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "image_meta").where("image is not null and width is not null and height is not null").select("image", F.col("width").alias("w"), F.col("height").alias("h")).distinct()


@query(f"""WITH b AS (SELECT *, greatest(28, round_even(h/28.0, 0)*28)::BIGINT AS hb, greatest(28, round_even(w/28.0, 0)*28)::BIGINT AS wb, sqrt(h::DOUBLE*w/1003520) AS dn, sqrt(3136.0/(h::DOUBLE*w)) AS up FROM {SIZES} WHERE least(w,h) >= 28 AND greatest(w,h)/least(w,h) <= 200)
SELECT image, w, h, (CASE WHEN hb*wb>1003520 THEN greatest(28, floor(h/dn/28)*28) WHEN hb*wb<3136 THEN ceil(h*up/28)*28 ELSE hb END)::BIGINT AS new_h, (CASE WHEN hb*wb>1003520 THEN greatest(28, floor(w/dn/28)*28) WHEN hb*wb<3136 THEN ceil(w*up/28)*28 ELSE wb END)::BIGINT AS new_w FROM b""")
def box_smart_resize(spark: SparkSession, d: str) -> DataFrame:
    r = _sizes(spark, d).withColumn("r", B.smart_resize(F.col("h"), F.col("w"))).where("r is not null")
    return r.select("image", "w", "h", F.col("r.height").alias("new_h"), F.col("r.width").alias("new_w"))


CANDIDATES = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]


@query(f"""WITH c(i, cw, ch) AS (VALUES {', '.join(f'({i},{a},{b})' for i, (a, b) in enumerate(CANDIDATES))}), k AS (SELECT image, w, h, i, cw, ch, least(floor(w*least(cw::DOUBLE/w, ch::DOUBLE/h))*floor(h*least(cw::DOUBLE/w, ch::DOUBLE/h)), w::BIGINT*h) AS kept FROM {SIZES} CROSS JOIN c)
SELECT image, w, h, cw AS best_w, ch AS best_h, (cw // 336 * (ch // 336))::BIGINT AS n_patches FROM (SELECT *, row_number() OVER (PARTITION BY image, w, h ORDER BY kept DESC, cw*ch-kept, i) AS rn FROM k) WHERE rn=1""")
def box_best_resolution(spark: SparkSession, d: str) -> DataFrame:
    r = _sizes(spark, d).withColumn("b", B.best_resolution(F.col("w"), F.col("h"), CANDIDATES))
    return r.select("image", "w", "h", F.col("b.width").alias("best_w"), F.col("b.height").alias("best_h"), F.size(B.patches(F.col("b.width"), F.col("b.height"), 336)).cast("long").alias("n_patches"))


@query(f"""SELECT image, w, h, greatest(w,h) AS side, (greatest(w,h)-w)//2 AS left_pad, (greatest(w,h)-h)//2 AS top_pad,
CASE WHEN greatest(w,h)>1344 THEN floor(w*least(1344.0::DOUBLE/greatest(w,h), 672.0::DOUBLE/least(w,h)))::BIGINT ELSE w END AS shown_w, CASE WHEN greatest(w,h)>1344 THEN floor(h*least(1344.0::DOUBLE/greatest(w,h), 672.0::DOUBLE/least(w,h)))::BIGINT ELSE h END AS shown_h FROM {SIZES}""")
def box_square_pad(spark: SparkSession, d: str) -> DataFrame:
    """Padding to a square, and the size at which the longer side is at most 1344 and the shorter at most 672."""
    side, less = F.greatest("w", "h"), F.least("w", "h")
    scale = F.least(F.lit(1344.0) / side, F.lit(672.0) / less)
    shown = lambda c: F.when(side > 1344, F.floor(F.col(c) * scale)).otherwise(F.col(c).cast("bigint"))
    half = lambda c: ((side - F.col(c)) / 2).cast("int")
    return _sizes(spark, d).select("image", "w", "h", side.alias("side"), half("w").alias("left_pad"), half("h").alias("top_pad"), shown("w").alias("shown_w"), shown("h").alias("shown_h"))


SIDES = "(SELECT *, coalesce(input_width > 0 AND input_height > 0, false) AS sized FROM lastp)"
BOTH = f"""WITH {LAST}, {PLAIN.replace('FROM predictions', 'FROM lastp')}, {JSON.replace('FROM predictions', 'FROM lastp')},
wrong AS (SELECT DISTINCT pred_no, field FROM objs WHERE len(v) = 4 AND len(list_filter(v, lambda x: x IS NULL)) > 0),
every AS (SELECT p.pred_no, p.field, 'plain' AS kind, p.category, p.v FROM plain p JOIN lastp l USING (pred_no) WHERE NOT regexp_matches(CASE WHEN p.field = 'gt' THEN l.gt ELSE l.text END, '^\\s*\\{{')
UNION ALL SELECT pred_no, field, 'json', category, v FROM objs ANTI JOIN wrong USING (pred_no, field) WHERE len(v) = 4),
clash AS (SELECT pred_no FROM every JOIN {SIDES} s USING (pred_no) WHERE NOT sized GROUP BY pred_no HAVING count(DISTINCT kind) = 2),
bx AS (SELECT model_id, id, field, category, CASE WHEN kind = 'plain' THEN v WHEN sized THEN [v[1]/input_width, v[2]/input_height, v[3]/input_width, v[4]/input_height] ELSE list_transform(v, lambda x: x/1000) END AS v FROM every JOIN {SIDES} s USING (pred_no) ANTI JOIN clash USING (pred_no))"""
BOXES = BOTH.replace("bx AS (SELECT model_id, id, field, category,", "bx AS (SELECT model_id, id, field, category, row_number() OVER (PARTITION BY model_id, id, field ORDER BY v) AS no,") + """,
g AS (SELECT * FROM bx WHERE field='gt'), f AS (SELECT * FROM bx WHERE field='text'),
j AS (SELECT g.model_id, g.id, g.no AS gno, f.no AS fno, CASE WHEN f.no IS NULL THEN 0 ELSE greatest(0, least(g.v[3],f.v[3])-greatest(g.v[1],f.v[1]))*greatest(0, least(g.v[4],f.v[4])-greatest(g.v[2],f.v[2])) END AS inter, (g.v[3]-g.v[1])*(g.v[4]-g.v[2]) AS ga, (f.v[3]-f.v[1])*(f.v[4]-f.v[2]) AS fa FROM g LEFT JOIN f USING (model_id, id)),
o AS (SELECT *, coalesce(inter/nullif(ga+fa-inter,0),0) AS iou FROM j)"""
GROUND = """, bt AS (SELECT model_id, id, gno, max(iou) AS iou FROM o GROUP BY ALL), pic AS (SELECT model_id, id, avg(iou) AS m, count(*) AS n FROM bt GROUP BY ALL), l AS (SELECT model_id, count(*) AS n_pictures, sum(n)::BIGINT AS n_boxes, avg(m) AS miou FROM pic GROUP BY ALL),
bf AS (SELECT model_id, id, fno, max(iou) AS iou FROM o WHERE fno IS NOT NULL GROUP BY ALL), r AS (SELECT model_id, count(*) AS n_found, count(*) FILTER (iou>=0.5) AS h5, count(*) FILTER (iou>=0.75) AS h7 FROM bf GROUP BY ALL)
SELECT model_id, n_pictures, n_boxes, n_found, miou, h5/n_found AS precision50, h7/n_found AS precision75, h5/n_boxes AS recall50, h7/n_boxes AS recall75 FROM l JOIN r USING (model_id)"""


def _plain_boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """True and found boxes of the last answers in the plain dialect: (model_id, id, category, box_no, x1, y1, x2, y2)."""
    last = E.last_predictions(table(spark, d, "predictions").select("model_id", "id", "text", "gt", "answered_at", "pred_no"))
    of = lambda c: last.select("model_id", "id", F.posexplode(B.parse_plain(F.col(c))).alias("box_no", "b")).select("model_id", "id", "box_no", "b.*")
    return of("gt"), of("text")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """The last answers with gt_kind, gt_boxes, text_kind, text_boxes, sized (the input's sides are known), unscaled (JSON boxes
    without them) and unscalable (these on one side, plain ones on the other: nothing brings them to one scale)."""
    last = E.last_predictions(table(spark, d, "predictions").select("model_id", "id", "text", "gt", "input_width", "input_height", "answered_at", "pred_no"))
    both = B.parse_any(B.parse_any(last, "gt"), "text")
    sized = F.coalesce((F.col("input_width") > 0) & (F.col("input_height") > 0), F.lit(False))
    kinds = F.array("gt_kind", "text_kind")
    unscaled = ~F.col("sized") & F.array_contains(kinds, "json")
    return both.withColumn("sized", sized).withColumns({"unscaled": unscaled, "unscalable": unscaled & F.array_contains(kinds, "plain")})


def _boxes(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """True and found boxes of the last answers in either dialect: (model_id, id, category, box_no, x1, y1, x2, y2), as shares of
    the sides. JSON boxes are divided by the input's sides; where these are unknown, both sides stay in pixels, by the thousand,
    which leaves the overlap as it is. Only unscalable answers are left out."""
    answers = answers.where("not unscalable")

    def of(c: str) -> DataFrame:
        b = answers.select("model_id", "id", "sized", "input_width", "input_height", F.col(f"{c}_kind").alias("kind"), F.posexplode(f"{c}_boxes").alias("box_no", "b"))
        side = lambda x, s: F.when(F.col("kind") == "plain", F.col(f"b.{x}")).otherwise(F.col(f"b.{x}") / F.when(F.col("sized"), F.col(s)).otherwise(1000)).alias(x)
        return b.select("model_id", "id", "box_no", "b.category", side("x1", "input_width"), side("y1", "input_height"), side("x2", "input_width"), side("y2", "input_height"))

    return of("gt"), of("text")


@query()
def box_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per model, the last answers by what their truth and text are read as, their boxes, and those that were not brought to one
    scale: unscaled (compared in pixels) and, among these, unscalable (not compared)."""
    return _audit(_answers(spark, d))


def _audit(answers: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col(f"{c}_kind") == k).alias(f"n_{name}_{k}") for c, name in (("gt", "true"), ("text", "found")) for k in ("plain", "json", "none", "unreadable")]
    boxes = [F.sum(F.when(F.col(f"{c}_boxes").isNotNull(), F.size(f"{c}_boxes")).otherwise(0)).alias(f"n_boxes_{name}") for c, name in (("gt", "true"), ("text", "found"))]
    return answers.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_answers"), *kinds, *boxes, F.count_if("unscaled").alias("n_unscaled"), F.count_if("unscalable").alias("n_unscalable"))


def _dropped(answers: DataFrame) -> DataFrame:
    """What box_audit counts as unread or unscaled, to stand beside a metric."""
    return _audit(answers).select("model_id", "n_true_unreadable", "n_found_unreadable", "n_unscaled", "n_unscalable")


@query(BOXES + GROUND)
def grounding_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of boxes in both dialects; box_audit counts the answers that could not be read or scaled."""
    truth, found = _boxes(_answers(spark, d))
    return B.grounding(truth, found, ["model_id", "id"], ["model_id"])


def _read(spark: SparkSession, d: str) -> DataFrame:
    """The answers without their texts, as a table: their boxes are parsed once."""
    return written(_answers(spark, d).drop("text", "gt"), "answers")


def _coco(spark: SparkSession, d: str, answers: DataFrame, most: tuple[int, ...] = (100,)) -> DataFrame:
    """Cells of average precision of the last answers to detection records: boxes in pixels of the record's picture (its first size
    in image_meta, else the input's, else thousandths), so that areas mean what they say."""
    truth, found = _boxes(answers)
    pictures = E.last_of(table(spark, d, "samples").select("id", "row_no", F.get("image", F.lit(0)).alias("picture")), ["id"], ["row_no"]).select("id", "picture")
    sizes = table(spark, d, "image_meta").where("width > 0 and height > 0").groupBy("image").agg(F.max(F.struct("width", "height")).alias("s")).select(F.col("image").alias("picture"), "s.*")
    known = pictures.join(sizes.hint("merge"), "picture").select("id", "width", "height")

    def scaled(df: DataFrame) -> DataFrame:
        side = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1000.0))
        b = df.join(known.hint("merge"), "id", "left")
        return b.select(F.col("model_id").alias("run"), F.col("id").alias("image"), "category", F.col("box_no").cast("long").alias("box_no"), *((F.col(c) * side("width" if c[0] == "x" else "height")).alias(c) for c in ("x1", "y1", "x2", "y2")))

    matched = B.matches(scaled(truth), scaled(found).withColumn("score", F.lit(0.9)), max(most))
    return B.average_precision(matched, most)


@query()
def detection_coco_ap(spark: SparkSession, d: str) -> DataFrame:
    """The twelve figures per model: ap, ap50, ap75, ap by area, ar at 1, 10 and 100 found boxes, ar by area; -1 where no category
    has a true box. Means over categories and thresholds; all found boxes have one score. Beside them the answers not read or scaled."""
    answers = _read(spark, d)
    cells = _coco(spark, d, answers, (1, 10, 100))
    at = lambda v, area="all", most=100, t=None: F.coalesce(F.avg(F.when((F.col("area") == area) & (F.col("most") == most) & ((F.col("t") == t) if t is not None else F.lit(True)), F.col(v))), F.lit(-1.0))
    figures = [at("ap").alias("ap"), at("ap", t=0).alias("ap50"), at("ap", t=5).alias("ap75"), *(at("ap", a).alias(f"ap_{a}") for a in ("small", "medium", "large")), *(at("recall", most=m).alias(f"ar{m}") for m in (1, 10, 100)), *(at("recall", a).alias(f"ar_{a}") for a in ("small", "medium", "large"))]
    return cells.groupBy("run").agg(*figures).join(_dropped(answers).withColumnRenamed("model_id", "run"), "run")


@query()
def detection_by_category(spark: SparkSession, d: str) -> DataFrame:
    """The cells of detection_coco_ap at 0.5 and 0.75; box_audit counts what was not read or scaled."""
    return _coco(spark, d, _read(spark, d)).where("area = 'all' and t in (0, 5)")


SINGLE = f"""WITH {LAST}, {PLAIN.replace('FROM predictions', 'FROM lastp')}, bx AS (SELECT p.model_id, p.id, field, v, count(*) OVER (PARTITION BY p.pred_no, field) AS n FROM plain JOIN lastp p USING (pred_no)),
g AS (SELECT * FROM bx WHERE field='gt' AND n = 1), f AS (SELECT * FROM bx WHERE field='text' AND n = 1),
j AS (SELECT f.model_id, f.id, greatest(0, least(g.v[3],f.v[3])-greatest(g.v[1],f.v[1]))*greatest(0, least(g.v[4],f.v[4])-greatest(g.v[2],f.v[2])) AS inter, (g.v[3]-g.v[1])*(g.v[4]-g.v[2]) AS ga, (f.v[3]-f.v[1])*(f.v[4]-f.v[2]) AS fa FROM g JOIN f USING (model_id, id)),
hits AS (SELECT model_id, id, coalesce(inter/nullif(ga+fa-inter,0),0) >= 0.5 AS hit FROM j), n AS (SELECT model_id, count(*) AS n_truth FROM g GROUP BY 1),
curve AS (SELECT model_id, id, sum(hit::INT) OVER w AS tp, row_number() OVER w AS k FROM hits WINDOW w AS (PARTITION BY model_id ORDER BY id)),
pts AS (SELECT c.model_id, id, tp/n_truth AS r, tp/k AS p FROM curve c JOIN n USING (model_id)),
env AS (SELECT q.model_id, q.k, coalesce(max(p) FILTER (r >= q.k/100.0 - 1e-12), 0) AS p FROM (SELECT model_id, unnest(range(0, 101)) AS k FROM n) q LEFT JOIN pts USING (model_id) GROUP BY ALL)
SELECT model_id, n_truth, sum(p)/101 AS ap50, max(r0) AS recall50 FROM env JOIN n USING (model_id) LEFT JOIN (SELECT model_id, max(r) AS r0 FROM pts GROUP BY 1) USING (model_id) GROUP BY ALL"""


@query(SINGLE)
def grounding_ap50_single_box(spark: SparkSession, d: str) -> DataFrame:
    """Average precision at 0.5 of answers with one plain box, held against truths with one: the general matcher and curve."""
    truth, found = _plain_boxes(spark, d)
    one = lambda df: df.join(df.groupBy("model_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n"), ["model_id", "id"])
    g, f = one(truth), one(found)
    as_run = lambda df: df.select(F.col("model_id").alias("run"), F.col("id").alias("image"), F.lit("default").alias("category"), F.col("box_no").cast("long").alias("box_no"), "x1", "y1", "x2", "y2")
    cells = B.average_precision(B.matches(as_run(g), as_run(f.join(g.select("model_id", "id"), ["model_id", "id"], "left_semi")).withColumn("score", F.lit(0.9)), 100))
    return cells.where("area = 'all' and t = 0").select(F.col("run").alias("model_id"), "n_truth", F.col("ap").alias("ap50"), F.col("recall").alias("recall50"))


RESIZED = f"""b AS (SELECT *, greatest(28, round_even(h/28.0, 0)*28)::BIGINT AS hb, greatest(28, round_even(w/28.0, 0)*28)::BIGINT AS wb, sqrt(h::DOUBLE*w/1003520) AS dn, sqrt(3136.0/(h::DOUBLE*w)) AS up FROM objs WHERE len(v) = 4 AND least(w,h) >= 28 AND greatest(w,h)/least(w,h) <= 200),
r AS (SELECT *, (CASE WHEN hb*wb>1003520 THEN greatest(28, floor(h/dn/28)*28) WHEN hb*wb<3136 THEN ceil(h*up/28)*28 ELSE hb END)::BIGINT AS nh, (CASE WHEN hb*wb>1003520 THEN greatest(28, floor(w/dn/28)*28) WHEN hb*wb<3136 THEN ceil(w*up/28)*28 ELSE wb END)::BIGINT AS nw FROM b)"""
CORNERS = (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h"))


@query(f"WITH {JSON}, {RESIZED} SELECT pred_no, field, nw, nh, " + ", ".join(f"greatest(0, least(round_even(v[{k+1}]*(n{s}::DOUBLE/{s}), 0)::BIGINT, n{s}-1)) AS {c}, round_even(greatest(0, least(round_even(v[{k+1}]*(n{s}::DOUBLE/{s}), 0)::BIGINT, n{s}-1))*({s}::DOUBLE/n{s}), 0)::BIGINT AS back_{c}" for k, (c, s) in enumerate(CORNERS)) + " FROM r")
def box_resized(spark: SparkSession, d: str) -> DataFrame:
    """Absolute boxes in the resized picture, clamped to it, and scaled back to the picture."""
    sizes = table(spark, d, "predictions").where("input_width is not null and input_height is not null").select("pred_no", F.col("input_width").alias("w"), F.col("input_height").alias("h"))
    b = box_parse_json(spark, d).join(sizes, "pred_no").withColumn("r", B.smart_resize(F.col("h"), F.col("w"))).where("r is not null").withColumns({"nw": F.col("r.width"), "nh": F.col("r.height")})
    for c, side in CORNERS:
        b = b.withColumn(c, B.between_sizes(F.col(c), F.col(f"n{side}") / F.col(side), F.col(f"n{side}") - 1)).withColumn(f"back_{c}", B.between_sizes(F.col(c), F.col(side) / F.col(f"n{side}")))
    return b.select("pred_no", "field", "nw", "nh", *(x for c, _ in CORNERS for x in (c, f"back_{c}")))


@query(f"WITH {PLAIN}, s AS (SELECT pred_no, input_width AS w, input_height AS h FROM predictions WHERE input_width > 0 AND input_height > 0) SELECT pred_no, field, category, v[1]*w AS x, v[2]*h AS y, v[3]*w-v[1]*w AS width, v[4]*h-v[2]*h AS height, (v[3]*w-v[1]*w)*(v[4]*h-v[2]*h) AS area FROM plain JOIN s USING (pred_no)")
def box_to_coco(spark: SparkSession, d: str) -> DataFrame:
    """Plain boxes in pixels of the input, as corner, sides and area."""
    sizes = table(spark, d, "predictions").where("input_width > 0 and input_height > 0").select("pred_no", F.col("input_width").alias("w"), F.col("input_height").alias("h"))
    b = box_parse_plain(spark, d).join(sizes, "pred_no")
    return b.select("pred_no", "field", "category", F.inline(F.array(B.to_pixels(F.struct("x1", "y1", "x2", "y2"), F.col("w"), F.col("h")))))


@query(r"""SELECT row_no, turn::INT AS turn, pos::INT AS pos, round_even(CAST(v[1] AS DOUBLE)*0.5, 0)::BIGINT AS x1, round_even(CAST(v[2] AS DOUBLE)*0.25, 0)::BIGINT AS y1, round_even(CAST(v[3] AS DOUBLE)*0.5, 0)::BIGINT AS x2, round_even(CAST(v[4] AS DOUBLE)*0.25, 0)::BIGINT AS y2 FROM (
SELECT row_no, turn, pos, regexp_extract_all(b[pos], '[0-9]+') AS v FROM (SELECT row_no, turn, b, unnest(range(1, len(b)+1)) AS pos FROM (SELECT row_no, turn, regexp_extract_all(conversations[turn+1].value, '\[\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*\]') AS b FROM (SELECT row_no, conversations, unnest(range(0, len(conversations))) AS turn FROM samples WHERE substr(id,2,1) IN ('1','2','5','7')))))""")
def box_rescale_samples(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in both kinds of turns of the tasks that have them, after a resize to half the width and a quarter of the height."""
    s = table(spark, d, "samples").where("substring(id, 2, 1) in ('1', '2', '5', '7')").select("row_no", F.posexplode("conversations").alias("turn", "t"))
    text = B.rescale_text(F.col("t.value"), F.lit(0.5), F.lit(0.25))
    found = s.select("row_no", "turn", F.posexplode(F.regexp_extract_all(text, F.lit(r"\[\d+, \d+, \d+, \d+\]"), 0)).alias("i", "b")).select("row_no", "turn", (F.col("i") + 1).alias("pos"), F.regexp_extract_all("b", F.lit(r"\d+"), 0).cast("array<bigint>").alias("v"))
    return found.select("row_no", "turn", "pos", *(F.col("v")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))


@query("WITH g AS (SELECT image, w, h, 672 AS tw, 336 AS th FROM " + SIZES + "), s AS (SELECT *, tw::DOUBLE/w AS sw, th::DOUBLE/h AS sh FROM g) SELECT image, w, h, CASE WHEN sw < sh THEN tw ELSE least(ceil(w*sh), tw) END::BIGINT AS new_w, CASE WHEN sw < sh THEN least(ceil(h*sw), th) ELSE th END::BIGINT AS new_h, ((tw - CASE WHEN sw < sh THEN tw ELSE least(ceil(w*sh), tw) END)::BIGINT // 2) AS left_pad, ((th - CASE WHEN sw < sh THEN least(ceil(h*sw), th) ELSE th END)::BIGINT // 2) AS top_pad FROM s")
def box_resize_pad(spark: SparkSession, d: str) -> DataFrame:
    """A picture fitted into 672 x 336 with its sides' ratio kept, and the padding before it; without the padding, what stays is new_w x new_h."""
    sw, sh = F.lit(672.0) / F.col("w"), F.lit(336.0) / F.col("h")
    wide, high = F.when(sw < sh, F.lit(672)).otherwise(F.least(F.ceil(F.col("w") * sh), F.lit(672))), F.when(sw < sh, F.least(F.ceil(F.col("h") * sw), F.lit(336))).otherwise(F.lit(336))
    half = lambda x: F.floor(x / 2).cast("bigint")
    return _sizes(spark, d).select("image", "w", "h", wide.cast("bigint").alias("new_w"), high.cast("bigint").alias("new_h"), half(F.lit(672) - wide).alias("left_pad"), half(F.lit(336) - high).alias("top_pad"))


@query(f"WITH {PLAIN} SELECT pred_no, category, (dense_rank() OVER (PARTITION BY pred_no ORDER BY first) - 1) % 20 AS colour FROM (SELECT pred_no, category, min(no) AS first FROM (SELECT pred_no, category, row_number() OVER (PARTITION BY pred_no ORDER BY (SELECT min(category) FROM plain), category) AS no FROM plain WHERE field = 'text') GROUP BY ALL)")
def box_colours(spark: SparkSession, d: str) -> DataFrame:
    """The number of the colour, of twenty, that each label of an answer gets: labels in order."""
    w = Window.partitionBy("pred_no").orderBy("category")
    labels = box_parse_plain(spark, d).where("field = 'text'").select("pred_no", "category").distinct()
    return labels.select("pred_no", "category", ((F.row_number().over(w) - 1) % 20).cast("long").alias("colour"))
