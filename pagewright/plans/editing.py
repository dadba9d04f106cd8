"""The queries of forms, page operations and edit logs, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.operators import forms, pages
from pagewright.plans.catalog import LINES, doc_lines, longs, read

NAMES = ["a.pdf", "A.pdf", "b", "a.PDF", "b", "c.d.txt", "a.pdf"]


def widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven widgets for each customer: a text, a box, two radio buttons, a choice, a list and a push button."""
    k = F.col("c_custkey")
    no = F.lit(False)

    def one(at: int, name: str, kind: str, value, export: str = "", radio=no, check=no, combo=no, push=no, multi=no, lines=no):
        return F.struct(F.lit(at % 3).alias("page"), F.lit(at).alias("at"), F.lit(name).alias("name"), F.lit(kind).alias("type"), value.alias("value"), F.lit(export).alias("export"), radio.alias("radio"), check.alias("check"), combo.alias("combo"), push.alias("push"), multi.alias("multi"), lines.alias("multi_line"), (k % 5 == at % 5).alias("read_only"))

    yes = F.lit(True)
    on = lambda c, v: F.array(F.when(c, v).otherwise("Off"))
    each = F.array(
        one(1, "name", "Tx", F.array(F.col("c_name")), lines=k % 2 == 0), one(2, "ok", "Btn", on(k % 3 == 0, "Yes"), "Yes", check=yes), one(3, "pick", "Btn", on(k % 4 == 0, "0"), radio=yes), one(4, "pick", "Btn", on(k % 4 < 2, "1"), radio=yes),
        one(5, "city", "Ch", F.when(k % 2 == 0, F.array(F.lit("Goa"), F.lit("Pune"))), combo=yes), one(6, "langs", "Ch", F.array(F.lit("x"), F.lit("y")), multi=yes), one(7, "go", "Btn", F.array(F.lit("z")), push=yes),
    )
    return read(spark, sf_dir, "customer").select(k.alias("doc"), F.explode(each).alias("w")).select("doc", "w.*")


def read_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(forms.fields_of(widgets(spark, sf_dir)).withColumn("value", F.array_join("value", ",")))


def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = forms.read_back(forms.fields_of(widgets(spark, sf_dir)))
    return back.select("doc", F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("stored"))


def radio_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as buttons; lines of one number stand at one place, in the order of the file."""
    table = read(spark, sf_dir, "lineitem")
    row = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row")
    lines = table.select(F.col("l_orderkey").alias("doc"), F.lit("r").alias("name"), F.col("l_linenumber").cast("long").alias("at"), (F.col("l_linenumber") % 3).cast("string").alias("on"), F.when(F.col("l_linenumber") < 5, F.col("l_returnflag")).alias("option"), row)
    return forms.mapped_radios(lines.drop("option", "row"), lines.select("doc", "name", "at", "option", "row"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    docs = read(spark, sf_dir, "orders").select(k.alias("doc"), F.when(k % 7 != 0, k % 5 == 0).alias("certified"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_linenumber") == 2, "Sig").otherwise("Tx").alias("type"), F.when(F.col("l_quantity") > 25, "x").alias("value"))
    return forms.signed(docs, lines)


def sized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") + F.col("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), (300 + k % 50).cast("double").alias("w"), (400 + k % 70).cast("double").alias("h"), (k % 4 * 90).cast("int").alias("base_rot"), (k % 3 * 90).cast("int").alias("rot"))


def blank_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_blank(sized_pages(spark, sf_dir), 2).select("conv_id", "turn", "w", "h", "new_at", "is_blank")


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of two turns, the first page of each twice; a link from each turn to the one after or, from every third, to the first."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("long").alias("page"))
    part = F.floor(F.col("page") / 2)
    own = turns.select("doc", part.alias("part"), (F.col("page") % 2).alias("at"), "page")
    twice = turns.where("page % 2 = 0").select("doc", part.alias("part"), F.lit(2).cast("long").alias("at"), "page")
    links = turns.select("doc", "page", F.when(F.col("page") % 3 == 2, 0).otherwise(F.col("page") + 1).cast("long").alias("target"), F.concat(F.lit("l"), F.col("page").cast("string")).alias("link"))
    return pages.split_links(own.union(twice), links)


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat_ws("-", F.col("l_linenumber").cast("string"), (F.col("l_linenumber") + 2).cast("string"))
    groups = scalars.parse_ranges(F.concat(spec, F.lit(", 2, 3")), F.lit(40))["groups"]
    return read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.array_join(pages.extracted(groups), ",").alias("pages"))


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").cast("long").alias("at"), F.get(F.array(*map(F.lit, NAMES)), ((F.col("l_linenumber") + F.col("l_orderkey")) % len(NAMES)).cast("int")).alias("name"))
    return pages.archive_names(files)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def edited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines under an edit log: of each 4 lines one is replaced, one moved, one dropped; each document gets one line and one flows in."""
    n = F.col("line_no").cast("long")
    lines = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("page"), n.alias("id"), "text", F.lit(40.0).alias("x"), (800 - 14 * n).cast("double").alias("y"), (6.0 * F.length("text")).alias("width"), (n % 3).cast("double").alias("shift"))
    edit = lambda rows, version, kind, text, dx, dy, width: rows.select("page", "id", F.lit(version).alias("version"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), width.alias("new_width"), F.lit(50.0).alias("x"), F.lit(60.0).alias("y"))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("double")
    edits = edit(lines.where("id % 4 < 2"), 1, "move", none, 1.0, -2.0, nothing).union(edit(lines.where("id % 4 = 0"), 2, "text", F.lit("new"), 0.5, 0.0, F.lit(0.25)))
    edits = edits.union(edit(lines.where("id = 0").withColumn("id", F.lit(-1).cast("long")), 3, "insert", F.lit("added"), 0.0, 1.0, F.lit(33.0)))
    incoming = lines.where("id = 1").select("page", "id", "text", "x", "y", "width", F.lit(2.0).alias("dx"), F.lit(3.0).alias("dy"))
    return pages.current_text(lines, edits, lines.where("id % 4 = 3").select("page", "id"), incoming)


def line_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = (F.col("event_id") % 5 - 2).cast("double")
    return pages.moves(log(spark, sf_dir).select(F.col("user_id").alias("page"), F.col("event_type").alias("id"), F.col("event_id").alias("version"), step.alias("dx"), (step * 0.5).alias("dy")))


def undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    kind = F.when(k.isin(2, 5), "undo").when(k == 6, "redo").otherwise("commit")
    return pages.after_undo(log(spark, sf_dir).select(F.col("user_id").alias("doc"), F.col("event_id").alias("version"), kind.alias("kind"), F.col("value")))


def edit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first line replaced by "abc" on the page, but for every third document."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("t"))
    first = F.substring_index("t", "\n", 1)
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    told = docs.select("page", bare("t").alias("before"), F.when(F.col("page") % 3 == 0, bare("t")).otherwise(F.concat(F.lit("abc"), F.substring(bare("t"), F.length(bare(first)) + 1, F.length("t")))).alias("after"))
    return pages.verified_edits(told, docs.select("page", F.lit(0).cast("long").alias("id"), first.alias("old"), F.lit("abc").alias("new")))


def edits_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.edits_key(log(spark, sf_dir).select(F.col("user_id").alias("page"), F.col("event_id").alias("version"), F.col("event_type").alias("id"), F.col("props").alias("text")))


def untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id")
    turns = read(spark, sf_dir, "conversations").select(k.alias("doc"), F.col("turn").alias("at"), F.when((k % 7 == 0) & (F.col("turn") == 1), "b").when(k % 11 != 0, "a").alias("src"), F.when(k % 5 == 0, F.lit(0)).otherwise(F.col("turn")).alias("page"), F.lit(2).alias("n_source"), F.when(k % 3 == 0, 360).otherwise(0).alias("rot"), F.when(k % 13 == 0, 1).otherwise(0).alias("n_changes"))
    return pages.untouched(turns)


QUERIES = {
    "read_fields": read_fields, "form_values": form_values, "radio_values": radio_values, "signatures": signatures, "blank_page": blank_page, "part_links": part_links, "extract_pages": extract_pages, "archive_names": archive_names,
    "edited_lines": edited_lines, "line_moves": line_moves, "undo_redo": undo_redo, "edit_checks": edit_checks, "edits_keys": edits_keys, "untouched": untouched,
}

FIELDS = """fields AS (SELECT c_custkey AS doc, c_custkey AS k, c_name FROM customer),
told AS (SELECT doc, 'name' AS name, CASE WHEN k % 2 = 0 THEN 'textarea' ELSE 'text' END AS kind, k % 5 = 1 AS read_only, false AS multi, c_name AS value, 1 AS n_widgets, 1 AS first_page FROM fields
UNION ALL SELECT doc, 'ok', 'checkbox', k % 5 = 2, false, CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END, 1, 2 FROM fields
UNION ALL SELECT doc, 'pick', 'radio', k % 5 = 3, false, CASE WHEN k % 4 = 0 THEN '0' WHEN k % 4 = 1 THEN '1' ELSE '' END, 2, 0 FROM fields
UNION ALL SELECT doc, 'city', 'select', k % 5 = 0, false, CASE WHEN k % 2 = 0 THEN 'Goa' ELSE '' END, 1, 2 FROM fields
UNION ALL SELECT doc, 'langs', 'list', k % 5 = 1, true, 'x,y', 1, 0 FROM fields)"""
ORACLE_SQL = {
    # of the two radio buttons the first is on page 0, the other, which counts as the later one, on page 1
    "read_fields": f"WITH {FIELDS} SELECT doc, name, kind, read_only, multi, CASE WHEN name = 'pick' AND doc % 4 < 2 THEN '1' ELSE value END AS value, n_widgets::BIGINT AS n_widgets, first_page::BIGINT AS first_page FROM told",
    "form_values": f"WITH {FIELDS} SELECT doc, string_agg(name || '=' || CASE WHEN name = 'pick' AND doc % 4 < 2 THEN '1' ELSE value END, ';' ORDER BY name) AS stored FROM told GROUP BY doc",
    "radio_values": """WITH b AS (SELECT l_orderkey AS doc, 'r' AS name, l_linenumber::BIGINT AS pos, (l_linenumber % 3)::VARCHAR AS state, CASE WHEN l_linenumber < 5 THEN l_returnflag END AS option FROM lineitem)
SELECT doc, name, pos AS "at", state AS "on", coalesce((SELECT arg_max(o.option, o.pos) FROM b o WHERE o.doc = b.doc AND o.state = b.state AND o.option IS NOT NULL), state) AS mapped FROM b""",
    "signatures": "SELECT o_orderkey AS doc, o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2 AND l_quantity > 25) AS signed FROM orders",
    "blank_page": """WITH p AS (SELECT conv_id, turn::BIGINT AS turn, (300 + (conv_id + turn) % 50)::DOUBLE AS w, (400 + (conv_id + turn) % 70)::DOUBLE AS h, ((conv_id + turn) % 4 * 90 + (conv_id + turn) % 3 * 90) % 180 = 90 AS sideways FROM conversations)
SELECT conv_id, turn, w, h, turn + (turn > 2)::INT AS new_at, false AS is_blank FROM p UNION ALL
SELECT conv_id, NULL, coalesce(max(CASE WHEN turn = 2 THEN CASE WHEN sideways THEN h ELSE w END END), 595.28::DOUBLE), coalesce(max(CASE WHEN turn = 2 THEN CASE WHEN sideways THEN w ELSE h END END), 841.89::DOUBLE), least(3, max(turn) + 1), true FROM p GROUP BY conv_id""",
    "part_links": """WITH t AS (SELECT conv_id AS doc, turn::BIGINT AS page, CASE WHEN turn % 3 = 2 THEN 0 ELSE turn + 1 END AS target FROM conversations), has AS (SELECT DISTINCT conv_id AS doc, turn AS page FROM conversations),
l AS (SELECT t.* FROM t JOIN has ON has.doc = t.doc AND has.page = t.target AND t.target // 2 = t.page // 2)
SELECT doc, page // 2 AS part, page % 2 AS page_at, target % 2 AS target_at, 'l' || page AS link FROM l UNION ALL SELECT doc, page // 2, 2, target % 2, 'l' || page FROM l WHERE page % 2 = 0""",
    "extract_pages": """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE l_linenumber WHEN 1 THEN '0,1,2' WHEN 2 THEN '1,2,3' WHEN 3 THEN '2,3,4,1' ELSE (l_linenumber - 1) || ',' || l_linenumber || ',' || (l_linenumber + 1) || ',1,2' END AS pages FROM lineitem""",
    "archive_names": f"""WITH f AS (SELECT l_orderkey AS archive, l_linenumber::BIGINT AS pos, [{', '.join(f"'{n}'" for n in NAMES)}][((l_linenumber + l_orderkey) % {len(NAMES)} + 1)::INT] AS name FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY archive, lower(name) ORDER BY pos) AS n FROM f)
SELECT archive, pos AS "at", name, CASE WHEN n = 1 THEN name WHEN contains(name, '.') THEN regexp_replace(name, '[.]([^.]*)$', '-' || n || '.\\1') ELSE name || '-' || n END AS stored FROM n""",
    "edited_lines": f"""WITH {LINES}, l AS (SELECT doc_id AS page, line_no AS id, text, 40.0::DOUBLE AS x, (800 - 14 * line_no)::DOUBLE AS y, 6.0::DOUBLE * length(text) AS width FROM lines)
SELECT page, id::VARCHAR AS id, CASE WHEN id % 4 = 0 THEN 'new' ELSE text END AS text, x + CASE id % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1 ELSE 0 END AS x, y + CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN -2 ELSE id % 3 END AS y, CASE WHEN id % 4 = 0 THEN 1 ELSE width END AS width,
  CASE id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'move' ELSE 'kept' END AS state FROM l WHERE id % 4 < 3 UNION ALL SELECT page, '-1', 'added', 50, 61, 33, 'inserted' FROM l WHERE id = 0 UNION ALL SELECT page, 'flow:1', text, x + 2, y + 3, width, 'flowed' FROM l WHERE id = 1""",
    "line_moves": """SELECT user_id AS page, event_type AS id, sum(event_id % 5 - 2)::DOUBLE AS dx, sum(event_id % 5 - 2)::DOUBLE / 2 AS dy, count(*) AS n FROM events GROUP BY ALL HAVING dx <> 0""",
    # a step for each event, with the stacks of versions; 0 stands for the empty document
    "undo_redo": """WITH RECURSIVE e AS (SELECT user_id AS doc, event_id AS v, CASE WHEN event_id % 7 IN (2, 5) THEN 'undo' WHEN event_id % 7 = 6 THEN 'redo' ELSE 'commit' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id AS doc, 0::BIGINT AS n, 0::BIGINT AS v, []::BIGINT[] AS past, []::BIGINT[] AS future FROM events UNION ALL
  SELECT s.doc, e.n, CASE WHEN kind = 'commit' THEN e.v WHEN kind = 'undo' AND len(past) > 0 THEN past[-1] WHEN kind = 'redo' AND len(future) > 0 THEN future[-1] ELSE s.v END,
    CASE WHEN kind = 'commit' THEN (past || [s.v])[-150:] WHEN kind = 'undo' THEN past[:-2] WHEN len(future) > 0 THEN past || [s.v] ELSE past END,
    CASE WHEN kind = 'commit' THEN [] WHEN kind = 'redo' THEN future[:-2] WHEN len(past) > 0 THEN future || [s.v] ELSE future END FROM s JOIN e ON e.doc = s.doc AND e.n = s.n + 1)
SELECT s.doc, nullif(s.v, 0) AS version, value FROM s LEFT JOIN events ON event_id = s.v WHERE s.n = (SELECT max(n) FROM e WHERE e.doc = s.doc)""",
    "edit_checks": r"""WITH t AS (SELECT doc_id AS page, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS before, regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '\s+', '', 'g') AS old FROM documents),
a AS (SELECT *, CASE WHEN page % 3 = 0 THEN before ELSE 'abc' || before[length(old) + 1:] END AS after FROM t)
SELECT page, 0::BIGINT AS id, contains(after, 'abc') AS has_new, old = '' OR len(string_split(after, old)) - 1 <= greatest(0, len(string_split(before, old)) - 2) + len(string_split('abc', old)) - 1 AS old_gone FROM a""",
    "edits_keys": "SELECT user_id AS page, sha256(string_agg(event_id || chr(1) || event_type || chr(1) || props, chr(2) ORDER BY event_id)) AS key FROM events GROUP BY user_id",
    "untouched": """SELECT conv_id AS doc, count(*) = 2 AND conv_id % 7 <> 0 AND conv_id % 11 <> 0 AND (conv_id % 5 <> 0 OR max(turn) = 0) AND conv_id % 13 <> 0 AND bool_and(turn < 2) AS untouched FROM conversations GROUP BY conv_id""",
}
