"""Queries of the document lifecycle: edit logs, page states, files, edit plans, budgets; and supplements that Spark adds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import geometry as geo
from quireflow.operators import edits, editlog
from quireflow.sources import files
from quireflow.sources.words import read
from quireflow.streaming import pages as streams


def edit_log_fold(spark, sf_dir):
    return editlog.fold(editlog.from_events(read(spark, sf_dir, "events")))


def undo_redo_depth(spark, sf_dir):
    folded = editlog.fold(editlog.from_events(read(spark, sf_dir, "events")))
    return folded.groupBy("doc_id").agg(F.max("n_past").alias("n_past"), F.max("n_future").alias("n_future"))


_LOG = """WITH RECURSIVE named AS (SELECT user_id AS doc_id, event_id AS n, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE CASE WHEN event_id % 11 < 2 THEN 'system' ELSE 'user' END END AS kind,
  CASE WHEN event_id % 11 = 0 THEN 'setSourceText' WHEN event_id % 11 = 1 THEN 'setTypography' WHEN event_type = 'view' THEN ['deleteElement', 'restoreElement', 'setAlignment', 'moveElement'][event_id % 4 + 1]
    WHEN event_type = 'purchase' THEN ['setText', 'applyStyle', 'applyStyle', 'setStyleOverrides'][event_id % 4 + 1] WHEN event_id % 5 = 0 THEN 'addElement' WHEN event_id % 13 = 12 THEN 'updatePage' WHEN event_id % 17 = 16 THEN 'noCommand' ELSE 'setText' END AS type FROM events),
log AS (SELECT *, CASE WHEN type IN ('addElement', 'moveElement') OR n % 7 = 6 THEN 'p0-a' || n % 3 ELSE 'p0-e' || n % 5 END AS target, CASE WHEN type = 'setText' AND n % 3 = 0 THEN 'source ' || n % 5 ELSE 'text ' || n % 3 END AS said FROM named)"""
_CHANGED = """CASE WHEN e.id <> target OR type = 'updatePage' THEN e WHEN type = 'addElement' THEN struct_pack(id := e.id, here := true, source := said, text := said, state := 'edited', alignment := 'left', locked := false, styled := false, x := 0.0::DOUBLE)
  WHEN NOT e.here THEN e ELSE struct_pack(id := e.id, here := true, source := CASE WHEN type = 'setSourceText' THEN said ELSE e.source END,
    text := CASE WHEN type = 'setText' OR (type = 'setSourceText' AND e.state = 'original') THEN said ELSE e.text END,
    state := CASE WHEN type = 'deleteElement' THEN 'deleted' WHEN type = 'setText' THEN CASE WHEN said = e.source AND NOT e.styled THEN 'original' ELSE 'edited' END
      WHEN type = 'restoreElement' THEN CASE WHEN e.text = e.source AND NOT e.styled THEN 'original' ELSE 'edited' END
      WHEN type = 'setSourceText' AND e.state <> 'deleted' THEN CASE WHEN (e.state = 'original' OR e.text = said) AND NOT e.styled THEN 'original' ELSE 'edited' END
      WHEN type = 'applyStyle' AND e.state <> 'deleted' AND starts_with(e.id, 'p0-a') THEN 'edited'
      WHEN type IN ('applyStyle', 'setStyleOverrides') AND e.state <> 'deleted' THEN CASE WHEN e.text = e.source AND n % 4 = 2 THEN 'original' ELSE 'edited' END ELSE e.state END,
    alignment := CASE WHEN type = 'setAlignment' THEN 'right' WHEN type = 'setTypography' AND NOT e.locked THEN 'center' ELSE e.alignment END, locked := e.locked OR type = 'setAlignment',
    styled := CASE WHEN type IN ('applyStyle', 'setStyleOverrides') THEN n % 4 <> 2 ELSE e.styled END, x := CASE WHEN type = 'moveElement' THEN e.x + 1 ELSE e.x END) END"""
def _fold_sql(select: str) -> str:
    """The fold as a recursive query: the present, the undone and the redone documents are lists of elements."""
    element = "STRUCT(id VARCHAR, here BOOLEAN, source VARCHAR, text VARCHAR, state VARCHAR, alignment VARCHAR, locked BOOLEAN, styled BOOLEAN, x DOUBLE)"
    first = "list_transform(['e0', 'e1', 'e2', 'e3', 'e4', 'a0', 'a1', 'a2'], lambda i: struct_pack(id := 'p0-' || i, here := i[1] = 'e', source := 'source ' || i[2], text := 'source ' || i[2], state := CASE WHEN i[1] = 'e' THEN 'original' ELSE 'edited' END, alignment := 'left', locked := false, styled := false, x := 0.0::DOUBLE))"
    there = "len(list_filter(now, lambda e: e.id = target AND e.here)) > 0"
    ok = f"CASE type WHEN 'addElement' THEN true WHEN 'updatePage' THEN n % 2 = 1 WHEN 'noCommand' THEN false WHEN 'moveElement' THEN {there} AND starts_with(target, 'p0-a') ELSE {there} END"
    after = f"list_transform(now, lambda e: {_CHANGED})"
    every = lambda docs: f"list_transform({docs}, lambda d: list_transform(d, lambda e: {_CHANGED}))"
    return f"""{_LOG}, f(doc_id, seq, now, past, future, failed, error) AS (
      SELECT DISTINCT doc_id, 0::BIGINT, {first}::{element}[], []::{element}[][], []::{element}[][], 0::BIGINT, NULL::VARCHAR FROM log
      UNION ALL SELECT doc_id, seq,
        CASE WHEN kind = 'undo' AND len(past) > 0 THEN past[-1] WHEN kind = 'redo' AND len(future) > 0 THEN future[1] WHEN kind = 'system' OR (kind = 'user' AND ok) THEN after ELSE now END,
        CASE WHEN kind = 'undo' THEN past[:-2] WHEN kind = 'redo' THEN CASE WHEN len(future) > 0 THEN list_append(past, now) ELSE past END WHEN kind = 'system' THEN {every('past')} WHEN ok THEN list_append(past, now)[-200:] ELSE past END,
        CASE WHEN kind = 'undo' THEN CASE WHEN len(past) > 0 THEN list_prepend(now, future) ELSE future END WHEN kind = 'redo' THEN future[2:] WHEN kind = 'system' THEN {every('future')} WHEN ok THEN []::{element}[][] ELSE future END,
        CASE WHEN kind = 'user' AND NOT ok THEN failed + 1 ELSE failed END,
        CASE WHEN kind = 'user' AND NOT ok THEN CASE type WHEN 'updatePage' THEN 'UnknownTarget: no page p9' WHEN 'noCommand' THEN 'ValueError: no command noCommand' WHEN 'moveElement' THEN 'UnknownTarget: no element ' || target ELSE 'UnknownTarget: no element ' || target END ELSE error END
      FROM (SELECT f.doc_id, log.seq, now, past, future, failed, error, kind, type, n, target, {ok} AS ok, {after} AS after, said FROM f JOIN log ON log.doc_id = f.doc_id AND log.seq = f.seq + 1)),
    last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1) {select}"""


def last_write_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    rows = e.select(F.col("user_id").alias("doc_id"), F.concat(F.lit("p0-e"), F.col("event_id") % 5).alias("element_id"), F.concat(F.lit("text "), F.col("event_id") % 3).alias("text"), "ts", "event_id")
    return editlog.last_texts(rows)


def versioned_upsert(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("event_id").alias("newest"), F.count("*").alias("n"))


def compare_and_set(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 50).alias("version"), (F.col("event_id") * 7 % 60).alias("base"))
    return editlog.compare_and_set(e, ["user_id"], "base", ["ts", "event_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


def capped_history(spark, sf_dir):
    log = editlog.from_events(read(spark, sf_dir, "events"))
    return editlog.capped_history(log, 20).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("seq").cast("long").alias("first_seq"))


def page_status_rollup(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "ready").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 4 == 0), "pending").otherwise("failed")
    return editlog.export_rollup(read(spark, sf_dir, "orders").withColumn("status", status), "o_custkey", "status")


_STATUS = "CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'pending' ELSE 'failed' END"


def page_counters(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "ready").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 4 == 0), "pending").otherwise("failed")
    return read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count_if(status == "ready").alias("done"), F.count_if(status == "failed").alias("failed"), F.count("*").alias("pages"))


def lru_cache_sim(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.concat(F.lit("p"), F.col("event_id") * 13 % 7).alias("key"), (F.col("event_id") * 13 % 7 * 10 + 30).cast("long").alias("bytes"))
    return editlog.lru_cache(log, 120).groupBy("doc_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"), F.max("raw").alias("most_raw"))


def debounce_last(spark, sf_dir):
    return editlog.debounced(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", "6 hours").select("user_id", "event_id", "event_type")


def single_flight(spark, sf_dir):
    return editlog.single_flight(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


_BYTES = ("89504E470D0A1A0A", "FFD8FFE000104A46", "524946460000000057454250", "255044462D312E37", "000102255044462D312E34", "00", "", "FFD8FF255044462D", "5249464600000000574156455F", "02550444620D0000", "89504E47")


def sniff_magic(spark, sf_dir):
    first = F.element_at(F.array(*[F.lit(b) for b in _BYTES]), (F.col("page_id") % len(_BYTES) + 1).cast("int"))
    body = F.when(F.col("page_id") % (2 * len(_BYTES)) == len(_BYTES) + 6, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.unhex(first), F.encode(body, "UTF-8")).alias("content"))
    return files.validated(rows).select("id", "mime", "reason")


def sha256_provenance(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    made = files.provenance(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    return p.select("page_id", made["sha256"].alias("sha256"), made["doc_id"].alias("doc_id"))


def image_plan(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    w, h = F.col("l_partkey") % 9000 + 1, F.col("l_suppkey") * 37 % 9000 + 1
    plan = files.decode_plan(w, h, 16_000_000)
    return li.groupBy(plan["reject"].alias("reject")).agg(F.count("*").alias("n"), F.count_if(plan["scale"] < 1).alias("n_scaled"), F.sum(F.floor(plan["scale"] * 1000).cast("long")).alias("scale_sum"), F.sum(F.floor(files.image_points(w)).cast("long")).alias("points"))


def pdf_native_scale(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    k = F.col("l_partkey") % 5
    fn = F.when(k == 0, "save").when(k == 1, "restore").when(k == 2, "image").otherwise("transform")
    d = lambda e: F.expr(f"cast({e} as double)")
    image = F.array(d("l_partkey % 3000 + 100"), d("l_suppkey * 10 % 4000 + 100"))
    matrix = F.array(d("l_quantity * 12"), d("l_partkey % 3 * 10"), d("l_suppkey % 3 * -10"), d("l_quantity * 16"), d("36"), d("18"))
    nested = F.when(F.col("l_partkey") % 10 == 3, F.array(d("0.5"), d("0"), d("0"), d("0.75"), d("1"), d("2"))).otherwise(matrix)
    ops = li.select(F.col("l_orderkey").alias("page_id"), turn.alias("seq"), fn.alias("fn"), F.when(k == 2, image).otherwise(nested).alias("args"), d("612").alias("page_width"), d("792").alias("page_height"))
    return files.pdf_scales(ops).select("page_id", F.round("native", 6).alias("native"), F.round("scale", 6).alias("scale"))


def export_names(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(".pdf")).alias("name"), (F.col("p_size") % 3 + 1).alias("pages"))
    return p.select("p_partkey", files.export_name(F.col("name"), F.col("pages"), F.lit(0), F.when(F.col("p_partkey") % 2 == 0, "image/png").otherwise("image/jpeg")).alias("name"), files.pdf_text(F.col("name")).alias("title"), files.pdf_number(F.col("p_partkey") / 8.0).alias("number"))


def device_budget(spark, sf_dir):
    n = F.col("event_id")
    rows = read(spark, sf_dir, "events").select("event_id", F.nullif(n % 33, F.lit(0)).cast("int").alias("memory"), F.nullif(n * 7 % 17, F.lit(0)).cast("int").alias("cores"))
    tier = edits.device_tier(F.col("memory"), F.col("cores"))
    return rows.select("event_id", "memory", "cores", tier.alias("tier"), edits.device_budget(tier, 1).cast("long").alias("pixels"))


def ocr_scale(spark, sf_dir):
    s = edits.recognition_scale(F.col("l_quantity") % 15, F.col("l_partkey") % 4000 + 500, F.col("l_suppkey") % 4000 + 500, F.lit(20_000_000))
    return read(spark, sf_dir, "lineitem").select(s.cast("long").alias("scale")).groupBy("scale").agg(F.count("*").alias("n"))


def confidence_bands(spark, sf_dir):
    c = F.col("l_quantity") * 2
    return read(spark, sf_dir, "lineitem").groupBy(edits.confidence_band(c).alias("band")).agg(F.count("*").alias("n"), F.sum(F.floor(edits.fit_confidence(F.col("l_discount") * 10, c) * 1000).cast("long")).alias("trust"))


def edit_plan_prefix_suffix(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.expr("concat(substr(text, 1, length(text) div 2), turn, substr(text, length(text) div 2 + 2))").alias("b"))
    plan = edits.edit_plan(F.col("a"), F.col("b"), F.lit(10), F.lit(100), F.lit(100))
    return t.select("conv_id", "turn", plan["text"].alias("text"), plan["from_x"].cast("long").alias("from_x"), plan["full"].alias("full"))


def replacement_layout(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    n = (F.col("l_partkey") % 40 + 2).cast("int")
    out = edits.replacement_layout(F.lit(200.0), n, F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(16.0), F.col("l_linenumber") == 1)
    return li.groupBy(n.cast("long").alias("glyphs"), out["overflow"].alias("overflow")).agg(F.count("*").alias("rows"), F.round(F.min(out["size"]), 6).alias("size"), F.round(F.min(out["scale_x"]), 6).alias("scale_x"))


def affine_chain(spark, sf_dir):
    c = lambda n: (F.col("n_nationkey") * n % 7 + 1).cast("double")
    m, n = [c(k) for k in (1, 2, 3, 4, 5, 6)], [c(k) for k in (6, 5, 4, 3, 2, 1)]
    return read(spark, sf_dir, "nation").select("n_nationkey", *[v.alias(k) for k, v in zip("abcdef", geo.affine_product(m, n), strict=True)])


def oriented_boxes(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 10.0).alias("cx"), (F.col("n_nationkey") * 3.0).alias("cy"), F.lit(40.0).alias("w"), F.lit(20.0).alias("h"), (F.col("n_nationkey") / 100.0).alias("t"))
    box = geo.oriented_bounds(geo.oriented_corners(*[F.col(c) for c in ("cx", "cy", "w", "h", "t")]))
    local = geo.to_local(F.lit(50.0), F.lit(20.0), *[F.col(c) for c in ("cx", "cy", "w", "h", "t")])
    return n.select("n_nationkey", F.round(box["x"], 6).alias("x"), F.round(box["width"], 6).alias("width"), F.round(box["height"], 6).alias("height"), F.round(local["x"], 6).alias("u"), F.round(local["y"], 6).alias("v"))


# ------------------------------------------------------------------ streams over the events table


def _drained(spark, stream, name: str, mode: str, keys: list[str] | None = None):
    return streams.drain(stream, name, mode, f"{streams.shared_folder(spark)}/stream-{uuid.uuid4().hex}", keys)


def _event_stream(spark, sf_dir):
    return streams.event_stream(spark, f"{sf_dir}/events.parquet")


def tumbling_events(spark, sf_dir):
    return _drained(spark, streams.tumbling(_event_stream(spark, sf_dir), "ts", "1 day", "30 days"), "tumbling", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def session_events(spark, sf_dir):
    return _drained(spark, streams.bursts(_event_stream(spark, sf_dir), "ts", "user_id", "6 hours", "365 days"), "bursts", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stateful_edit_log(spark, sf_dir):
    log = editlog.from_events(read(spark, sf_dir, "events"))
    folder = f"{streams.shared_folder(spark)}/edit-log-{uuid.uuid4().hex}"
    log.select("doc_id", F.col("seq").cast("long").alias("seq"), "kind", "payload").write.parquet(folder)
    stream = spark.readStream.schema("doc_id long, seq long, kind string, payload string").parquet(folder)
    return _drained(spark, editlog.fold_stream(stream), "edits", "update", ["doc_id"])


# ------------------------------------------------------------------ supplements: what Spark adds to the model


def star_join(spark, sf_dir):
    li, o, c = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    sold = li.where("l_shipdate >= timestamp '1995-01-01'").select("l_orderkey", F.floor(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return sold.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def cube_rollup(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.floor("l_quantity").cast("long")).alias("quantity"))


def approx_distinct(spark, sf_dir):
    """Distinct parts by a sketch beside the exact number: within a tenth, five times its standard error."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("about"))
    return rows.select("l_returnflag", "parts", (F.abs(F.col("about") - F.col("parts")) <= F.col("parts") * 0.1).alias("near"))


QUERIES = {f.__name__: f for f in (
    edit_log_fold, undo_redo_depth, last_write_wins, versioned_upsert, compare_and_set, capped_history, page_status_rollup, page_counters, lru_cache_sim, debounce_last, single_flight, sniff_magic, sha256_provenance, image_plan, pdf_native_scale,
    export_names, device_budget, ocr_scale, confidence_bands, edit_plan_prefix_suffix, replacement_layout, affine_chain, oriented_boxes, tumbling_events, session_events, stateful_edit_log, star_join, cube_rollup, approx_distinct,
)}

ORACLES = {
    "lru_cache_sim": """WITH RECURSIVE log AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, 'p' || event_id * 13 % 7 AS key, event_id * 13 % 7 * 10 + 30 AS size FROM events),
      f(doc_id, seq, raw, hit) AS (SELECT DISTINCT doc_id, 0::BIGINT, []::STRUCT(key VARCHAR, size BIGINT)[], false FROM log UNION ALL
        SELECT doc_id, seq, CASE WHEN known THEN list_append(others, struct_pack(key := key, size := size)) ELSE list_append(others[coalesce(
          list_filter(range(0, len(others) + 1), lambda i: coalesce(list_sum(list_transform(others[i + 1:], lambda o: o.size)), 0) + size <= 120)[1], len(others)) + 1:], struct_pack(key := key, size := size)) END, known
        FROM (SELECT f.doc_id, log.seq, log.key, log.size, list_filter(raw, lambda r: r.key <> log.key) AS others, len(list_filter(raw, lambda r: r.key = log.key)) > 0 AS known FROM f JOIN log ON log.doc_id = f.doc_id AND log.seq = f.seq + 1))
      SELECT doc_id, count_if(hit)::BIGINT AS hits, count(*) AS n, max(list_sum(list_transform(raw, lambda r: r.size)))::BIGINT AS most_raw FROM f WHERE seq > 0 GROUP BY doc_id""",
    "edit_log_fold": _fold_sql("""SELECT doc_id, e.id AS element_id, e.source, e.text, e.state, e.alignment, e.styled, e.x, e.state = 'deleted' OR e.text <> e.source OR e.styled AS modified,
      len(past)::BIGINT AS n_past, len(future)::BIGINT AS n_future, failed AS n_failed, error AS last_error FROM (SELECT *, unnest(now) AS e FROM last) WHERE e.here"""),
    "undo_redo_depth": _fold_sql("SELECT doc_id, len(past)::BIGINT AS n_past, len(future)::BIGINT AS n_future FROM last"),
    "last_write_wins": """SELECT user_id AS doc_id, 'p0-e' || event_id % 5 AS element_id, arg_max('text ' || event_id % 3, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS text, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL""",
    "versioned_upsert": "SELECT user_id, max(event_id) AS newest, count(*) AS n, list(event_type ORDER BY ts, event_id)[-1] AS event_type FROM events GROUP BY user_id",
    "compare_and_set": """SELECT user_id, count(*) AS n, sum(version)::BIGINT AS versions FROM (SELECT user_id, event_id % 50 AS version, event_id * 7 % 60 AS base,
      coalesce(max(event_id % 50) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM events) WHERE base >= seen GROUP BY user_id""",
    "capped_history": f"""{_LOG}, u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS back FROM log WHERE kind = 'user')
      SELECT doc_id, count(*) AS n, min(seq) AS first_seq FROM u WHERE back <= 20 GROUP BY doc_id""",
    "page_status_rollup": f"""WITH s AS (SELECT o_custkey, {_STATUS} AS status FROM orders)
      SELECT o_custkey, bool_and(status IN ('ready', 'failed')) AND bool_or(status = 'ready') AS can_export, count_if(status = 'ready')::BIGINT AS n_ready, count_if(status <> 'ready')::BIGINT AS skipped FROM s GROUP BY o_custkey""",
    "page_counters": f"SELECT year(o_orderdate) AS year, count_if({_STATUS} = 'ready')::BIGINT AS done, count_if({_STATUS} = 'failed')::BIGINT AS failed, count(*) AS pages FROM orders GROUP BY 1",
    "debounce_last": """SELECT user_id, event_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt > ts + INTERVAL 6 HOURS""",
    "single_flight": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "sniff_magic": f"""WITH h AS (SELECT page_id AS id, [{', '.join(f"'{b}'" for b in _BYTES)}][(page_id % {len(_BYTES)})::INT + 1] || CASE WHEN page_id % {2 * len(_BYTES)} = {len(_BYTES) + 6} THEN '' ELSE hex(coalesce(html, '')) END AS h FROM pages),
      m AS (SELECT id, h, CASE WHEN starts_with(h, '89504E47') AND length(h) >= 16 THEN 'image/png' WHEN starts_with(h, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'image/webp'
        WHEN list_contains(list_transform(range(0, 1020), lambda k: substr(h, (2 * k + 1)::INT, 10)), '255044462D') THEN 'application/pdf' END AS mime FROM h)
      SELECT id, mime, CASE WHEN h = '' THEN 'empty' WHEN mime IS NULL THEN 'unsupported' END AS reason FROM m""",
    "sha256_provenance": "SELECT page_id, sha256(coalesce(html, '')) AS sha256, 'doc-' || substr(sha256(coalesce(html, '')), 1, 16) AS doc_id FROM pages",
    "image_plan": """WITH s AS (SELECT l_partkey % 9000 + 1 AS w, l_suppkey * 37 % 9000 + 1 AS h FROM lineitem), p AS (SELECT w, w * h > 60000000 AS reject, CASE WHEN w * h > 16000000 THEN sqrt(16000000.0::DOUBLE / (w * h)) ELSE 1.0 END AS scale FROM s)
      SELECT reject, count(*) AS n, count_if(scale < 1)::BIGINT AS n_scaled, sum(floor(scale * 1000)::BIGINT)::BIGINT AS scale_sum, sum(floor(w * 72 / 300)::BIGINT)::BIGINT AS points FROM p GROUP BY reject""",
    "pdf_native_scale": """WITH RECURSIVE ops AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_partkey % 5 AS k,
        [l_partkey % 3000 + 100, l_suppkey * 10 % 4000 + 100]::DOUBLE[] AS image, CASE WHEN l_partkey % 10 = 3 THEN [0.5, 0, 0, 0.75, 1, 2]::DOUBLE[] ELSE [l_quantity * 12, l_partkey % 3 * 10, l_suppkey % 3 * -10, l_quantity * 16, 36, 18]::DOUBLE[] END AS m FROM lineitem),
      f(page_id, seq, c, stack, best) AS (SELECT DISTINCT page_id, 0::BIGINT, [1, 0, 0, 1, 0, 0]::DOUBLE[], []::DOUBLE[][], NULL::DOUBLE FROM ops UNION ALL
        SELECT page_id, seq, CASE k WHEN 0 THEN c WHEN 1 THEN CASE WHEN len(stack) > 0 THEN stack[-1] ELSE [1, 0, 0, 1, 0, 0]::DOUBLE[] END WHEN 2 THEN c
            ELSE [c[1] * m[1] + c[3] * m[2], c[2] * m[1] + c[4] * m[2], c[1] * m[3] + c[3] * m[4], c[2] * m[3] + c[4] * m[4], c[1] * m[5] + c[3] * m[6] + c[5], c[2] * m[5] + c[4] * m[6] + c[6]] END,
          CASE k WHEN 0 THEN list_append(stack, c) WHEN 1 THEN stack[:-2] ELSE stack END,
          CASE WHEN k = 2 AND w * h >= 612 * 792 * 0.25 THEN greatest(best, image[1] / w, image[2] / h) ELSE best END
        FROM (SELECT f.page_id, ops.seq, k, m, image, c, stack, best, sqrt(c[1] * c[1] + c[2] * c[2]) AS w, sqrt(c[3] * c[3] + c[4] * c[4]) AS h FROM f JOIN ops ON ops.page_id = f.page_id AND ops.seq = f.seq + 1)),
      l AS (SELECT page_id, arg_max(best, seq) AS native FROM f GROUP BY page_id),
      s AS (SELECT page_id, native, least(600 / 72::DOUBLE, greatest(150 / 72::DOUBLE, coalesce(native, 300 / 72::DOUBLE))) AS scale FROM l)
      SELECT page_id, round(native, 6) AS native, round(CASE WHEN 612 * 792 * scale * scale > 16000000 THEN scale * sqrt(16000000::DOUBLE / (612 * 792 * scale * scale)) ELSE scale END, 6) AS scale FROM s""",
    "export_names": r"""SELECT p_partkey, p_name || CASE WHEN p_size % 3 + 1 > 1 THEN '-page1' ELSE '' END || '-edited.' || CASE WHEN p_partkey % 2 = 0 THEN 'png' ELSE 'jpg' END AS name,
      '(' || regexp_replace(regexp_replace(p_name || '.pdf', '[^\x20-\x7e]', '?', 'g'), '([\\()])', '\\\1', 'g') || ')' AS title, regexp_replace(regexp_replace(printf('%.4f', p_partkey / 8.0::DOUBLE), '0+$', ''), '\.$', '') AS number FROM part""",
    "device_budget": """WITH g AS (SELECT event_id, nullif(event_id % 33, 0)::INT AS memory, nullif(event_id * 7 % 17, 0)::INT AS cores FROM events),
      t AS (SELECT *, CASE WHEN coalesce(memory, 4) <= 2 OR coalesce(cores, 4) <= 2 THEN 'low' WHEN coalesce(memory, 4) < 8 OR coalesce(cores, 4) < 4 THEN 'mid' ELSE 'high' END AS tier FROM g)
      SELECT event_id, memory, cores, tier, (CASE tier WHEN 'high' THEN 40000000 WHEN 'mid' THEN 20000000 ELSE 10000000 END)::BIGINT AS pixels FROM t""",
    "ocr_scale": """WITH r AS (SELECT l_quantity % 15 AS t, l_partkey % 4000 + 500 AS w, l_suppkey % 4000 + 500 AS h FROM lineitem),
      s AS (SELECT *, CASE WHEN t > 0 AND t < 12 THEN least(4, floor(30.0 / t + 0.5)) ELSE 1 END AS wanted FROM r)
      SELECT (CASE WHEN wanted >= 4 AND w * h * 16 <= 20000000 THEN 4 WHEN wanted >= 3 AND w * h * 9 <= 20000000 THEN 3 WHEN wanted >= 2 AND w * h * 4 <= 20000000 THEN 2 ELSE 1 END)::BIGINT AS scale, count(*) AS n FROM s GROUP BY 1""",
    "confidence_bands": """SELECT CASE WHEN 2 * l_quantity < 60 THEN 'low' WHEN 2 * l_quantity < 85 THEN 'mid' ELSE 'high' END AS band, count(*) AS n,
      sum(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_discount * 10 * (l_quantity * 2 / 100 * 0.4::DOUBLE + 0.6::DOUBLE))) * 1000)::BIGINT)::BIGINT AS trust FROM lineitem GROUP BY 1""",
    "edit_plan_prefix_suffix": """WITH t AS (SELECT conv_id, turn, text AS a, substr(text, 1, length(text) // 2) || turn || substr(text, length(text) // 2 + 2) AS b FROM conversations),
      l AS (SELECT *, length(a) AS la, length(b) AS lb, least(length(a), length(b)) AS m FROM t),
      p AS (SELECT *, len(list_filter(range(1, m + 1), lambda k: substr(a, 1, k) = substr(b, 1, k))) AS p FROM l),
      s AS (SELECT *, len(list_filter(range(1, m - p + 1), lambda k: substr(a, la - k + 1, k) = substr(b, lb - k + 1, k))) AS s FROM p),
      k AS (SELECT *, p > 0 AS keep_p, s > 0 AND la = lb AS keep_s FROM s)
      SELECT conv_id, turn, CASE WHEN NOT (keep_p OR keep_s) THEN b ELSE substr(b, CASE WHEN keep_p THEN p ELSE 0 END + 1, greatest(0, lb - CASE WHEN keep_s THEN s ELSE 0 END - CASE WHEN keep_p THEN p ELSE 0 END)) END AS text,
        (CASE WHEN keep_p THEN 100 + 10 * p ELSE 100 END)::BIGINT AS from_x, NOT (keep_p OR keep_s) AS "full" FROM k""",
    "replacement_layout": """WITH r AS (SELECT (l_partkey % 40 + 2)::BIGINT AS n, l_linenumber = 1 AS con FROM lineitem),
      a AS (SELECT *, n * 8.0::DOUBLE AS adv0 FROM r), b AS (SELECT *, CASE WHEN adv0 > 200 AND NOT con THEN greatest(-0.48::DOUBLE, (200 - adv0) / greatest(1, n - 1)) ELSE 0.0::DOUBLE END AS sp FROM a),
      c AS (SELECT *, adv0 + (n - 1) * sp AS a1 FROM b), d AS (SELECT *, CASE WHEN a1 > 200 THEN greatest(0.88::DOUBLE, (200 - sp * greatest(1, n - 1)) / greatest(1, a1 - sp * greatest(1, n - 1))) ELSE 1.0::DOUBLE END AS sx FROM c),
      e AS (SELECT *, a1 * sx AS a2 FROM d), f AS (SELECT *, CASE WHEN a2 > 200 THEN greatest(12.8::DOUBLE, 16 * (200 / a2)) ELSE 16.0::DOUBLE END AS sz FROM e), g AS (SELECT *, (n * 0.5::DOUBLE * sz + (n - 1) * sp) * sx AS a3 FROM f)
      SELECT n AS glyphs, a3 > 200.5 AS overflow, count(*) AS "rows", round(min(sz), 6) AS size, round(min(sx), 6) AS scale_x FROM g GROUP BY 1, 2""",
    "affine_chain": """WITH m AS (SELECT n_nationkey, (n_nationkey % 7 + 1)::DOUBLE AS a, (n_nationkey * 2 % 7 + 1)::DOUBLE AS b, (n_nationkey * 3 % 7 + 1)::DOUBLE AS c, (n_nationkey * 4 % 7 + 1)::DOUBLE AS d, (n_nationkey * 5 % 7 + 1)::DOUBLE AS e, (n_nationkey * 6 % 7 + 1)::DOUBLE AS f FROM nation)
      SELECT n_nationkey, a * f + c * e AS a, b * f + d * e AS b, a * d + c * c AS c, b * d + d * c AS d, a * b + c * a + e AS e, b * b + d * a + f AS f FROM m""",
    "oriented_boxes": """WITH n AS (SELECT n_nationkey, n_nationkey * 10.0::DOUBLE AS cx, n_nationkey * 3.0::DOUBLE AS cy, n_nationkey / 100.0::DOUBLE AS t FROM nation), b AS (SELECT *, 40 * abs(cos(t)) + 20 * abs(sin(t)) AS w, 40 * abs(sin(t)) + 20 * abs(cos(t)) AS h FROM n)
      SELECT n_nationkey, round(cx - w / 2, 6) AS x, round(w, 6) AS width, round(h, 6) AS height, round((50 - cx) * cos(t) + (20 - cy) * sin(t) + 20, 6) AS u, round((20 - cy) * cos(t) - (50 - cx) * sin(t) + 10, 6) AS v FROM b""",
    "tumbling_events": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(floor(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL",
    "session_events": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id, min(ts) AS start, count(*) AS n, list(event_id ORDER BY ts, event_id)[-1] AS last_id FROM s GROUP BY user_id, k""",
    "star_join": """SELECT r_name, n_name, count(*) AS n, sum(floor(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL""",
    "approx_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY l_returnflag",
    "cube_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(floor(l_quantity)::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
ORACLES["stateful_edit_log"] = ORACLES["edit_log_fold"]
