"""Answers put into form fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import dealt_by


def filled(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc, name, status, stored) for each answer (doc, name, value: an array of strings) to fields (doc, name, kind, options, max_len).

    Text is cut at max_len; a box is true or false; radio buttons and lists take options only and are cleared by an empty
    answer. Answers to unknown fields, of unknown kinds or outside the options are skipped and store null.
    """
    known = fields.select("doc", "name", "kind", "options", "max_len", F.lit(True).alias("_known"))
    said = F.filter(F.coalesce("value", F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    rows = answers.select("doc", "name", said.alias("v")).join(known, ["doc", "name"], "left")
    one = F.coalesce(F.get("v", F.lit(0)), F.lit(""))
    in_options = F.forall("v", lambda v: F.array_contains(F.coalesce("options", F.array().cast("array<string>")), v))
    ok = F.col("_known").isNotNull() & (F.col("kind").isin("text", "textarea", "checkbox") | (F.col("kind") == "list") & in_options | F.col("kind").isin("radio", "select") & in_options & (F.size("v") <= 1))
    text = F.when(F.coalesce("max_len", F.lit(0)) > 0, F.substring(one, F.lit(1), F.col("max_len"))).otherwise(one)
    stored = F.when(F.col("kind").isin("text", "textarea"), F.array(text)).when(F.col("kind") == "checkbox", F.array(F.when(one.isin("", "false"), "false").otherwise("true"))).otherwise(F.col("v"))
    done = F.coalesce(ok, F.lit(False))
    return rows.select("doc", "name", F.when(done, "filled").otherwise("skipped").alias("status"), F.when(done, stored).alias("stored"))


def counter(fields: DataFrame, values: DataFrame) -> DataFrame:
    """(doc, n_filled, n_fields) over the fields that may be edited; values: (doc, name, stored). Blank text, false and no choice count as empty."""
    held = F.coalesce(F.exists("stored", lambda v: ~v.isin("", "false")), F.lit(False))
    rows = fields.where(~F.coalesce("read_only", F.lit(False))).select("doc", "name").join(values.select("doc", "name", held.alias("_held")), ["doc", "name"], "left")
    return rows.groupBy("doc").agg(F.count_if(F.coalesce("_held", F.lit(False))).alias("n_filled"), F.count("*").alias("n_fields"))


def kind_of(w: str = "") -> Column:
    """The kind of a widget (type, multi_line, radio, check, combo, push); null for buttons and unknown ones."""
    c = lambda n: F.col(w + n)
    button = F.when(c("push"), F.lit(None)).when(c("radio"), "radio").when(c("check"), "checkbox")
    return F.when(c("type") == "Tx", F.when(c("multi_line"), "textarea").otherwise("text")).when(c("type") == "Btn", button).when(c("type") == "Ch", F.when(c("combo"), "select").otherwise("list"))


def initial_value() -> Column:
    """What a widget (type, check, value: strings, export, multi) holds at first, as an array of strings: a box true or false, one string for others, all for a list of several."""
    one = F.coalesce(F.get("value", F.lit(0)), F.lit(""))
    chosen = (one != "") & (one != "Off")
    button = F.when(F.col("check"), F.array(F.when(chosen & (one == F.coalesce("export", F.lit(""))), "true").otherwise("false"))).otherwise(F.array(F.when(chosen, one).otherwise("")))
    several = F.when(F.col("multi") & F.col("value").isNotNull(), F.col("value")).otherwise(F.array(one))
    return F.when(F.col("type") == "Btn", button).when(F.col("type") == "Ch", several).otherwise(F.array(one))


def fields_of(widgets: DataFrame) -> DataFrame:
    """(doc, name, kind, read_only, multi, value, n_widgets, first_page) of widgets (doc, page, at, name, ...): the first widget of a name tells its field; a radio button that is on gives the value, the last one if several are."""
    known = widgets.where(~F.col("push") & (F.col("name") != "")).withColumn("kind", kind_of()).where("kind is not null")
    order = F.struct("page", "at")
    on = F.when((F.col("kind") == "radio") & ~F.coalesce(F.get("value", F.lit(0)), F.lit("")).isin("", "Off"), F.struct(order.alias("o"), F.col("value").alias("v")))
    first = F.min(F.struct(order.alias("o"), "kind", "read_only", "multi", initial_value().alias("value"))).alias("f")
    # the groups are sorted: dealt by document first, a task sorts no more than it was dealt
    told = dealt_by(known, "doc").groupBy("doc", "name").agg(first, F.max(on).alias("on"), F.count("*").alias("n_widgets"))
    value = F.when(F.col("f.kind") == "radio", F.coalesce(F.col("on.v"), F.col("f.value"))).otherwise(F.col("f.value"))
    return told.select("doc", "name", "f.kind", "f.read_only", "f.multi", value.alias("value"), "n_widgets", F.col("f.o.page").alias("first_page"))


def mapped_radios(buttons: DataFrame, options: DataFrame) -> DataFrame:
    """buttons (doc, name, at, on) with `mapped`: the option (doc, name, at, option; row, if there: their order) at the place of the last button of the same state, or the state itself. Of several options at one place the first row counts."""
    row = F.col("row") if "row" in options.columns else F.col("option")
    told = options.where("option is not null").groupBy("doc", "name", "at").agg(F.min_by("option", row).alias("option"))
    by_state = buttons.where("on is not null").select("doc", "name", "at", "on").distinct().join(told, ["doc", "name", "at"]).groupBy("doc", "name", "on").agg(F.max_by("option", "at").alias("option"))
    return buttons.join(by_state, ["doc", "name", "on"], "left").select("doc", "name", "at", "on", F.coalesce("option", "on").alias("mapped"))


def read_back(stored: DataFrame) -> DataFrame:
    """(doc, values): a map of all fields (doc, name, kind, value: strings) to what is stored in them; null is '' or, for a box, false."""
    empty = F.when(F.col("kind") == "checkbox", F.array(F.lit("false"))).when(F.col("kind") == "list", F.array().cast("array<string>")).otherwise(F.array(F.lit("")))
    return stored.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.coalesce("value", empty).alias("value"))))).alias("values"))


def signed(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc, signed) of docs (doc, certified): certified, or with a signature field (doc, type, value) that has a value. Usage rights don't count."""
    held = fields.where("type = 'Sig' and value is not null").select("doc").distinct().withColumn("_held", F.lit(True))
    return docs.join(held, "doc", "left").select("doc", (F.coalesce("certified", F.lit(False)) | F.coalesce("_held", F.lit(False))).alias("signed"))
