"""Queries over sources, stores, layouts, rules and streams, and SQL for them; they join those of the catalogue.

What they store lies in the shared folder of the session (spark.checkpoint.dir), a new one for each run.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, scalars, text
from ..operators import merge, relational, retrieval, service, vector_index
from ..sources import layouts, pages, records, tables
from ..streaming import dispatch, job_stream
from . import catalog
from .catalog import _ALIVE, _BATCH, _FIRST, _NOTES, NOW, USER, _now, _stream, _t, query
from .pipelines import hash_embedder


def _folder(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Sources


def _as_json_lines(spark: SparkSession, d: str) -> str:
    """documents as JSON lines; every 50th is cut short, and a document without text has no content."""
    doc = _t(spark, d, "documents").select(F.struct(F.col("text").alias("page_content"), F.struct("doc_id", "lang", "source").alias("metadata")).alias("r"))
    line = F.to_json("r")
    at = _folder(spark, "json-lines")
    doc.select(F.when(F.col("r.metadata.doc_id") % 50 == 0, F.concat(F.lit("{"), F.col("r.metadata.doc_id").cast("string"))).otherwise(line).alias("value")).write.text(at)
    return at


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"SELECT doc_id::VARCHAR AS doc_id, lang, source, length(trim(text, {_SPACE})) AS n_chars FROM documents WHERE doc_id % 50 <> 0 AND trim(coalesce(text, ''), {_SPACE}) <> ''")
def json_line_records(spark, d):
    found, _ = records.read_records(spark, [_as_json_lines(spark, d)])
    return found.select(*(F.col("metadata")[k].alias(k) for k in ("doc_id", "lang", "source")), F.length("content").cast("long").alias("n_chars"))


@query("SELECT '{' || doc_id AS line FROM documents WHERE doc_id % 50 = 0")
def json_line_rejects(spark, d):
    return records.read_records(spark, [_as_json_lines(spark, d)])[1].select("line")


@query("SELECT lang AS source_type, source AS doc_title, NULL::VARCHAR AS authority, NULL::VARCHAR AS issue, doc_id::VARCHAR AS source_id, 2 + (source IS NOT NULL)::INT AS n_keys FROM documents WHERE lang IS NOT NULL")
def metadata_flatten(spark, d):
    meta = F.create_map(F.lit("source_type"), F.col("lang"), F.lit("doc_title"), F.col("source"), F.lit("source_id"), F.col("doc_id").cast("string"))
    rows = _t(spark, d, "documents").where("lang is not null").select(F.map_filter(meta, lambda _, v: v.isNotNull()).alias("metadata"))
    return pages.flatten(rows).select(*pages.FLAT, F.size("metadata").alias("n_keys"))


@query("SELECT lang AS source_type, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM documents GROUP BY 1")
def passage_batches(spark, d):
    """documents as two batches of the passage table, one of them sent twice, then compacted by language."""
    docs, at = _t(spark, d, "documents").select("doc_id", "lang"), _folder(spark, "passages")
    for batch, rest in (("even", 0), ("odd", 1), ("even", 0)):
        tables.append_batch(docs.where(F.pmod("doc_id", F.lit(2)) == rest), at, batch)
    tables.compact(spark, at, docs.schema, "lang", batch="whole", files=4)
    return tables.read_table(spark, at, docs.schema).groupBy(F.col("lang").alias("source_type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids"))


@query("""SELECT 'first' AS batch, count(DISTINCT coalesce(text, '')) AS n_embedded FROM documents WHERE doc_id % 2 = 0 UNION ALL
  SELECT 'second', (SELECT count(DISTINCT coalesce(text, '')) FROM documents) - (SELECT count(DISTINCT coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0) UNION ALL SELECT 'third', 0""")
def incremental_embedding(spark, d):
    """How many texts the embedder gets when a half, then all, then all documents again are ingested."""
    docs, at = _t(spark, d, "documents"), _folder(spark, "vectors")
    schema = "content_key string, embedding array<float>"
    for batch, rows in (("first", docs.where("doc_id % 2 = 0")), ("second", docs), ("third", docs)):
        tables.embed_incremental(rows, "text", at, hash_embedder(16), 16, batch=batch)
    held = [(b, tables.read_table(spark, at, schema, batch=b).agg(F.count(F.lit(1)).alias("n_embedded"))) for b in ("first", "second", "third")]
    out = None
    for b, n in held:
        one = n.select(F.lit(b).alias("batch"), "n_embedded")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT doc_id, n::INT AS n_pages, octet_length(encode(array_to_string(p, chr(10)))) - n + 1 AS n_bytes FROM (SELECT doc_id, string_split(text, chr(10)) AS p, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)""")
def rendered_pages(spark, d):
    """Uploads rendered to all their pages by an injected renderer; this one takes a line as a page."""

    def render(content, dpi):
        return bytes(content).split(b"\n")

    uploads = _t(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    got = pages.render_pages(uploads, render, max_pages=None).groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n_pages"), F.sum(F.octet_length("image")).cast("long").alias("n_bytes"))
    return got.select(F.col("path").cast("long").alias("doc_id"), "n_pages", "n_bytes")


@query("SELECT conv_id, turn::INT AS page, i::INT AS region, t AS text FROM (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS t FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL))")
def ocr_images(spark, d):
    """Page images read by an injected engine; this one reads an image's bytes as lines."""

    def engine(image):
        return image.decode().split("\n")

    images = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.encode("text", "utf-8").alias("image"))
    return pages.read_images(images, engine).withColumnRenamed("doc_id", "conv_id")


@query("""SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN 7 ELSE doc_id % 5 END)::INT AS page_index, len(list_filter(l, lambda x: x <> ''))::INT AS n_regions, list_filter(l, lambda x: x <> '')[1] AS first,
  CASE WHEN len(list_filter(l, lambda x: x <> '')) > 0 THEN 'text' END AS label FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)""")
def ocr_parse(spark, d):
    """OCR results of documents, a block for each line: plain or under `res`, with or without a page number."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("block_content"), F.array(i * 1.0, F.lit(0.0), i + 1.0, F.lit(9.0)).alias("block_bbox"), F.lit("").alias("block_label")))
    body = F.struct(F.when(F.col("doc_id") % 3 == 0, F.lit(7)).alias("page_index"), lines.alias("parsing_res_list"))
    payload = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(body.alias("res")))).otherwise(F.to_json(body))
    got = _t(spark, d, "documents").where("text is not null").select("doc_id", pages.ocr_page(payload, (F.col("doc_id") % 5).cast("int")).alias("p"))
    first = F.try_element_at("p.regions", F.lit(1))
    return got.select("doc_id", "p.page_index", F.size("p.regions").alias("n_regions"), first["text"].alias("first"), first["label"].alias("label"))


@query("""SELECT doc_id, len(w)::INT AS n_regions, w[1] AS first, 1.0::DOUBLE AS x1, 5.0::DOUBLE AS x2 FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: trim(x, ' ' || chr(10)) <> '') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0 AND w[1] NOT LIKE '%' || chr(10) || '%'""")
def ocr_spotting(spark, d):
    """Spotted words with their polygons; blank ones are left out."""
    words = F.col("_words")
    polygon = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(5.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("_words"))
    got = docs.select("doc_id", pages.spotted_regions(words, F.transform(words, lambda _: polygon)).alias("r"), F.get(F.filter(words, lambda x: text.trim(x) != ""), F.lit(0)).alias("_first"))
    # a first word is there if a region is; the regions themselves are not asked, which would compute them twice
    return got.where(~F.col("_first").contains("\n")).select("doc_id", F.size("r").alias("n_regions"), F.col("r")[0]["text"].alias("first"), F.col("r")[0]["bbox"]["x1"].alias("x1"), F.col("r")[0]["bbox"]["x2"].alias("x2"))


_WORDS = "SELECT conv_id, turn AS block, w, i FROM (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS w FROM (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations WHERE text IS NOT NULL))"


@query(f"""SELECT conv_id, block, i // 8 AS line, string_agg(w, ' ' ORDER BY i) AS text, min(i % 8) AS x1, max(i % 8 + 1) AS x2, round(avg(CASE WHEN i % 5 > 0 THEN i % 5 - 1 END), 6) AS conf FROM ({_WORDS}) GROUP BY ALL""")
def words_to_lines(spark, d):
    w = _t(spark, d, "conversations").where("text is not null").select("conv_id", F.col("turn").alias("block"), F.posexplode(F.split("text", " ")).alias("i", "text"))
    i = F.col("i").cast("long")
    words = w.select("conv_id", "block", F.lit(0).alias("par"), F.floor(i / 8).alias("line"), F.col("i").alias("word"), "text", (i % 8).alias("x1"), F.lit(0).alias("y1"), (i % 8 + 1).alias("x2"), F.lit(1).alias("y2"), (i % 5 - 1).alias("conf"))
    return pages.lines_of_words(words, ["conv_id"]).select("conv_id", "block", "line", "text", "x1", "x2", F.round("conf", 6).alias("conf"))


_FILES = "SELECT user_id AS session, event_id AS position, event_id % 9 = 0 AS existing, 'f' || (event_id % 6) || CASE event_id % 7 WHEN 0 THEN '.exe' WHEN 1 THEN '.PDF' ELSE '.png' END AS name, event_id % 4 * 8000000 AS size, event_id % 2 AS modified FROM events"
_MERGED = f"""WITH files AS ({_FILES}), k AS (SELECT *, CASE WHEN existing THEN 'existing' WHEN NOT regexp_matches(lower(name), '(\\.pdf|\\.png)$') THEN 'extension' WHEN size > 20971520 THEN 'size' END AS v FROM files),
  c AS (SELECT *, v IS NULL OR v = 'existing' AS may FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY session, name, size, modified, may ORDER BY existing DESC, position) AS nth FROM c),
  u AS (SELECT *, CASE WHEN v IS NULL AND nth > 1 THEN 'duplicate' ELSE v END AS v2 FROM o), n AS (SELECT *, count(*) FILTER (v2 IS NULL) OVER (PARTITION BY session ORDER BY position) AS took FROM u),
  l AS (SELECT *, CASE WHEN v2 IS NULL AND took > 5 THEN 'limit' ELSE v2 END AS v3 FROM n),
  merged AS (SELECT session, position, name, coalesce(CASE WHEN v3 = 'duplicate' AND bool_or(v3 = 'limit') OVER (PARTITION BY session, name, size, modified, may) THEN 'limit' ELSE v3 END, 'taken') AS verdict FROM l)"""


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 7 == 0, ".exe").when(i % 7 == 1, ".PDF").otherwise(".png")
    files = _t(spark, d, "events").select(F.col("user_id").alias("session"), i.alias("position"), (i % 9 == 0).alias("existing"), F.concat(F.lit("f"), (i % 6).cast("string"), kind).alias("name"), (i % 4 * 8000000).alias("size"), (i % 2).alias("modified"))
    return pages.merge_uploads(files, 5, max_bytes=20 << 20, suffixes=(".pdf", ".png"))


@query(_MERGED + " SELECT session, position, verdict FROM merged")
def upload_merge(spark, d):
    return _uploads(spark, d).select("session", "position", "verdict")


@query(_MERGED + """, r AS (SELECT session, verdict AS reason, min_by(name, position) AS first, count(*) AS n FROM merged WHERE verdict IN ('extension', 'size', 'limit', 'duplicate') GROUP BY ALL)
  SELECT session, list_position(['extension', 'size', 'limit', 'duplicate'], reason)::BIGINT AS place, reason, CASE WHEN n = 1 THEN first ELSE first || ' +' || (n - 1) END AS target FROM r""")
def upload_notices(spark, d):
    got = pages.rejection_notices(_uploads(spark, d))
    return got.select("session", F.col("place").cast("long").alias("place"), "reason", "target")


# Layouts and the index


@query(_ALIVE + f" SELECT *, (SELECT count(*) FROM mine) > 10 AS has_more FROM ({_FIRST})")
def layout_owner_page(spark, d):
    """An owner's first page from the layout of alive notifications: the files that hold it, no others."""
    notes, at = catalog.notifications(spark, d).select("id", "user_id", "type", "created_at", "deleted_at"), _folder(spark, "alive")
    layouts.write_layout(notes, layouts.NOTES["alive"], at, file_rows=20_000)
    return layouts.owner_page(spark, layouts.NOTES["alive"], at, notes.schema, USER, limit=10).select("id", "type", "created_at", "has_more")


def _jobs_with_deletion(spark: SparkSession, d: str) -> DataFrame:
    return catalog.job_states(spark, d).withColumn("deleted_at", F.when(F.col("job_id") % 6 == 0, F.col("queued_at")))


@query(catalog._JOBS + "SELECT user_id, count(*) AS n_active, count(*) FILTER (job_id % 6 = 0) AS n_deleted FROM jobs WHERE status IN ('QUEUED', 'RUNNING') GROUP BY user_id")
def queue_path_view(spark, d):
    """Active jobs as the queue sees them, deleted ones too."""
    states, at = _jobs_with_deletion(spark, d), _folder(spark, "active")
    layouts.write_layout(states, layouts.JOBS["active"], at, file_rows=20_000)
    rows = spark.read.schema(states.schema).parquet(f"{at}/rows")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_active"), F.count("deleted_at").alias("n_deleted"))


@query(catalog._JOBS + "SELECT job_id, lease_until FROM jobs WHERE status = 'RUNNING' ORDER BY lease_until, job_id LIMIT 20")
def lease_layout(spark, d):
    """The leases that end first, from the layout of running jobs."""
    states, at = _jobs_with_deletion(spark, d), _folder(spark, "lease")
    layouts.write_layout(states, layouts.JOBS["lease"], at, file_rows=20_000)
    return layouts.oldest(spark, layouts.JOBS["lease"], at, states.schema, 20).select("job_id", "lease_until")


@query("SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM embeddings))::BIGINT AS n, true AS recall_is_90 FROM embeddings WHERE vec_id % 100 = 0")
def index_recall(spark, d):
    """Ten hits for each hundredth vector from the inverted-file index, and whether they hold 90 % of the exact ones."""
    e, at = _t(spark, d, "embeddings"), _folder(spark, "index")
    vector_index.build_index(e, at)
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = vector_index.search_index(spark, at, asked, k=10).select("query_id", F.col("id").alias("vec_id"))
    want = retrieval.batch_topk(e, asked, k=10).select("query_id", "vec_id").withColumn("_exact", F.lit(1))
    both = got.join(want, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("_exact").alias("_hits"))
    share = both.agg((F.sum("_hits") / F.sum("n") >= 0.9).alias("recall_is_90"))
    return both.select("query_id", "n").crossJoin(F.broadcast(share))  # one row


# Retrieval of all questions

_TEXTS = "(SELECT v.vec_id, v.embedding, coalesce(t.text, 'vector ' || v.vec_id) AS content FROM embeddings v LEFT JOIN (SELECT doc_id, any_value(text) AS text FROM documents GROUP BY doc_id) t ON t.doc_id = v.vec_id)"
_ROUND = """SELECT query_id, id, similarity, content FROM (SELECT a.query_id, p.vec_id AS id, p.content, round(list_cosine_similarity(p.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS similarity
    FROM {0} a JOIN embeddings e ON e.vec_id = a.vec, {1} p WHERE p.vec_id <> a.vec) WHERE similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 12"""


@query(f"""WITH asked AS (SELECT item_id AS query_id, item_id AS vec FROM benchmark), r1 AS ({_ROUND.format('asked', _TEXTS)}),
  best AS (SELECT a.query_id, coalesce(max(similarity), 0) AS top, count(id) AS n FROM asked a LEFT JOIN r1 USING (query_id) GROUP BY 1), weak AS (SELECT query_id, n, CASE WHEN query_id % 5 = 0 THEN query_id ELSE query_id + 7 END AS vec FROM best WHERE top < 0.35),
  again AS (SELECT query_id, vec FROM weak WHERE vec <> query_id OR n = 0), r2 AS ({_ROUND.format('again', _TEXTS)}),
  allhits AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2), one AS (SELECT * FROM allhits WHERE query_id IN (SELECT query_id FROM again) QUALIFY row_number() OVER (PARTITION BY query_id, substr(content, 1, 120) ORDER BY similarity DESC, id) = 1),
  kept AS (SELECT * FROM r1 WHERE query_id NOT IN (SELECT query_id FROM again) UNION ALL SELECT * FROM one), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM kept QUALIFY place <= 12)
  SELECT a.query_id, id, round(similarity, 6) AS similarity, place, (a.query_id IN (SELECT query_id FROM weak))::INT AS rewrites FROM asked a LEFT JOIN placed USING (query_id)""")
def question_loop(spark, d):
    """Search, grade, rewrite and search again for all questions.  A question's vector is that of the number it names, and
    its new form names another; every fifth question's new form is the old one."""
    e = _t(spark, d, "embeddings")
    texts = _t(spark, d, "documents").groupBy("doc_id").agg(F.any_value("text").alias("_t"))
    content = F.coalesce("_t", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    contents = e.select("vec_id").join(texts, F.col("vec_id") == F.col("doc_id"), "left").select("vec_id", content.alias("content"))

    def search(asked: DataFrame) -> DataFrame:
        q = asked.select("query_id", F.col("query").cast("long").alias("at")).join(e, F.col("at") == F.col("vec_id")).select("query_id", "at", F.col("embedding").alias("q"))
        hits = retrieval.batch_topk(e, q.select("query_id", "q"), k=retrieval.TOP_K + 1).join(q.select("query_id", "at"), "query_id").where("vec_id <> at")
        hits = relational.last_n(hits.withColumn("_key", -F.col("vec_id")), ["query_id"], ["similarity", "_key"], retrieval.TOP_K)
        return hits.join(contents, "vec_id").select("query_id", F.col("vec_id").alias("id"), "similarity", "content")

    def rewrite(q):
        return F.when(q.cast("long") % 5 == 0, q).otherwise((q.cast("long") + 7).cast("string"))

    def written(df: DataFrame) -> DataFrame:
        at = _folder(spark, "hits")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").cast("string").alias("query"))
    got = retrieval.answer_all(asked, search, rewrite, checkpoint=written)
    return got.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"), "rewrites")


# Accounts, rooms and feeds


@query("SELECT c_custkey, c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS withdrawn FROM customer")
def withdrawn_accounts(spark, d):
    k = F.col("c_custkey")
    c = _t(spark, d, "customer").select("c_custkey", F.when(k % 3 != 0, k % 5 == 0).when(k % 5 == 0, True).alias("is_deleted"), F.when(k % 7 == 0, _now()).alias("deleted_at"))
    return c.select("c_custkey", relational.withdrawn().alias("withdrawn"))


@query(_NOTES + """SELECT 'all' AS ids, count(*) FILTER (read_at IS NULL) AS affected FROM notes UNION ALL SELECT 'none', 0 UNION ALL SELECT 'three', count(*) FILTER (read_at IS NULL AND id IN (1, 2, 3)) FROM notes""")
def ids_none_or_empty(spark, d):
    """A guarded update without a list of ids (all rows), with an empty one (no row) and with three."""
    n, out = catalog.notifications(spark, d), None
    for name, ids in (("all", None), ("none", []), ("three", [1, 2, 3])):
        one = relational.guarded_update(n, "read_at", _now(), ids).agg(F.count_if("affected").alias("affected")).select(F.lit(name).alias("ids"), "affected")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 1 AND o_orderkey % 5 <> 0 THEN CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'text ' || o_orderkey END END AS text
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0""")
def room_text_lookup(spark, d):
    """Rooms to the text of their job's result; a missing link, another user's job, a blank text or a number gives none."""
    o = _t(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("job"))
    k = F.col("c_custkey")
    rooms = _t(spark, d, "customer").join(last, k == F.col("o_custkey"), "left").select(k.alias("id"), F.lit(1).alias("user_id"), F.when(k % 3 == 0, _now()).alias("deleted_at"), F.when(k % 2 == 1, F.col("job")).alias("analysis_job_id"))
    j = F.col("o_orderkey")
    jobs_ = o.select(j.alias("id"), F.when(j % 5 == 0, 2).otherwise(1).alias("user_id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    said = F.when(j % 4 == 0, F.lit('"  "')).when(j % 4 == 1, F.lit("17")).otherwise(F.concat(F.lit('" text '), j.cast("string"), F.lit('"')))
    results = o.select(j.alias("job_id"), F.concat(F.lit('{"sanitized_text": '), said, F.lit("}")).alias("payload"))
    return service.room_texts(rooms, jobs_, results, 1)


@query("SELECT conv_id AS room_id, turn FROM conversations WHERE turn % 4 <> 3 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def history_trim(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("room_id"), "turn", F.col("turn").alias("created_at"), F.col("turn").alias("id"), F.when(F.col("turn") % 4 == 3, True).when(F.col("turn") % 4 == 1, False).alias("is_error"))
    return service.recent_turns(c).select("room_id", "turn")


@query(f"""SELECT coalesce(c.k, n.k) AS user_id, CASE WHEN n.k IS NOT NULL THEN n.nick ELSE c.nick END AS nickname, CASE WHEN n.k IS NOT NULL AND n.nick IS DISTINCT FROM c.nick THEN TIMESTAMP '{NOW}' ELSE c.t END AS nickname_at
  FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS nick, TIMESTAMP '2020-01-01' AS t FROM customer WHERE c_custkey % 4 <> 0) c
  FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'new ' || c_custkey WHEN c_custkey % 6 <> 0 THEN c_name END AS nick FROM customer WHERE c_custkey % 3 <> 0) n ON c.k = n.k""")
def profile_upsert(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    named = F.when(k % 6 != 0, F.col("c_name"))
    old = c.where(k % 4 != 0).select(k.alias("user_id"), named.alias("nickname"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("nickname_at"))
    new = c.where(k % 3 != 0).select(k.alias("user_id"), F.when(k % 5 == 0, F.concat(F.lit("new "), k.cast("string"))).otherwise(named).alias("nickname"))
    return relational.upsert_profile(old, new, _now())


_FRESH = "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0"


@query(f"""WITH n AS ({_FRESH}) SELECT 'users' AS target, k AS user_id, 'u' || k || '@x.org' AS value FROM n UNION ALL SELECT 'profiles', k, CASE WHEN k % 3 = 0 THEN 'u' || k ELSE c_name END FROM n
  UNION ALL SELECT 'agreements', k, kind || '=' || CASE WHEN kind = 'marketing' AND k % 2 = 0 THEN 'false' ELSE 'true' END FROM n, (SELECT unnest(['terms', 'privacy', 'marketing']) AS kind) UNION ALL SELECT 'notifications', k, 'welcome' FROM n""")
def account_provisioning(spark, d):
    """New identities to users, profiles, agreements and a greeting; a quarter is of the social provider, a fifth are
    members, and every identity comes twice."""
    k = F.col("c_custkey")
    c = _t(spark, d, "customer")
    new = c.select(k.alias("user_id"), F.concat(F.lit("u"), k.cast("string"), F.lit("@x.org")).alias("email"), F.when(k % 4 == 0, "kakao").alias("provider"), F.when(k % 3 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("nickname"), F.when(k % 2 == 1, True).alias("marketing"))
    out = None
    for name, rows in service.provision(new.unionByName(new), c.where(k % 5 == 0).select(k.alias("user_id")), "kakao").items():
        value = {"users": F.col("username") if name == "users" else None, "profiles": F.col("nickname") if name == "profiles" else None, "notifications": F.col("dedupe_key") if name == "notifications" else None}.get(name)
        value = F.concat_ws("=", "agreement_type", F.col("is_agreed").cast("string")) if name == "agreements" else value
        one = rows.select(F.lit(name).alias("target"), "user_id", value.alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


_TARGETS = {
    "users": merge.Target("users", "user_id long, username string", ("user_id",)),
    "profiles": merge.Target("profiles", "user_id long, nickname string", ("user_id",), ("nickname",)),
}


@query("""WITH c AS (SELECT c_custkey AS k, c_name FROM customer), v AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'renamed' ELSE c_name END AS nick FROM c)
  SELECT 'users' AS target, 'insert' AS action, count(*) AS n FROM c UNION ALL SELECT 'profiles', 'insert', count(*) FROM c UNION ALL SELECT 'profiles', 'update', count(*) FILTER (k % 3 = 0) FROM c""")
def account_merge(spark, d):
    """Half of all customers, then all, then all with a third renamed, then the same again: what the journal holds."""
    at, k = _folder(spark, "accounts"), F.col("c_custkey")
    c = _t(spark, d, "customer")
    users = c.select(k.alias("user_id"), F.col("c_name").alias("username"))
    names = users.withColumnRenamed("username", "nickname")
    renamed = names.withColumn("nickname", F.when(F.col("user_id") % 3 == 0, "renamed").otherwise(F.col("nickname")))
    for batch, u, p in (("1", users.where("user_id % 2 = 0"), names.where("user_id % 2 = 0")), ("2", users, names), ("3", users, renamed), ("4", users, renamed)):
        merge.merge_tables(spark, at, [(_TARGETS["users"], u), (_TARGETS["profiles"], p)], batch=batch)
    return merge.read_journal(spark, at).groupBy("target", "action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN ts WHEN event_id % 2 = 0 THEN ts END AS read_at, CASE WHEN event_id % 7 = 0 THEN ts END AS deleted_at FROM events")
def notification_backfill(spark, d):
    i = F.col("event_id")
    old = _t(spark, d, "events").select(i.alias("id"), F.col("ts").alias("created_at"), F.when(i % 3 == 0, F.col("ts")).alias("read_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"), (i % 2 == 0).alias("is_read"), (i % 7 == 0).alias("is_deleted"))
    return service.backfilled_notifications(old).select("id", "read_at", "deleted_at")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'updated' ELSE 'created' END AS last_chat_at FROM orders")
def room_backfill(spark, d):
    j = F.col("o_orderkey")
    rooms = _t(spark, d, "orders").select(j.alias("id"), F.when(j % 3 == 0, "chat").alias("last_chat_at"), F.when(j % 3 == 1, "updated").alias("updated_at"), F.lit("created").alias("created_at"))
    return service.backfilled_rooms(rooms).select("id", "last_chat_at")


@query("SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 4 = 0 AS social FROM customer")
def provider_check(spark, d):
    k = F.col("c_custkey")
    one, several = F.when(k % 3 == 0, "kakao").when(k % 3 == 1, "email"), F.when(k % 4 == 0, F.array(F.lit("email"), F.lit("kakao"))).when(k % 4 == 1, F.array(F.lit("email")))
    return _t(spark, d, "customer").select("c_custkey", service.has_provider(one, several, "kakao").alias("social"))


@query("""SELECT doc_id, trim(concat_ws(' ', nullif(coalesce(source, ''), ''), CASE WHEN doc_id % 2 = 0 THEN '(' || (2000 + doc_id % 20) || ')' END, 'p.' || CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 + 1 ELSE 9 END)) AS header,
  concat_ws(' ', nullif(coalesce(source, ''), ''), CASE WHEN doc_id % 4 <> 0 THEN 'Act' END) AS article FROM documents""")
def context_headers(spark, d):
    i = F.col("doc_id")
    header = text.page_header(F.coalesce("source", F.lit("")), F.when(i % 2 == 0, 2000 + i % 20), [F.when(i % 3 == 0, i % 5 + 1).when(i % 3 == 1, 0), F.lit("").cast("string"), F.lit(9)])
    return _t(spark, d, "documents").select("doc_id", header.alias("header"), text.article_header(F.col("source"), F.when(i % 4 != 0, F.lit("Act"))).alias("article"))


_LEASES = (
    ("보증금: 1억원\n월세: 50만원\n소재지: 서울시 마포구 1\n계약 2024.1.2 부터 2026.1.1\n용도 아파트\n특약 수리", "아파트", 1, 0),
    ("보증금 3천만원\n주소 부산시 2\n특약\n특약 사항: 없음\n 특약 둘 ", None, 2, 3),
    ("차임 없음\n오피스텔 계약", "오피스텔", 0, 3),
    ("", None, 0, 4),
)


@query("SELECT event_id, [" + ", ".join("NULL" if p is None else f"'{p}'" for _, p, _, _ in _LEASES) + "][(event_id % 4 + 1)::INT] AS property_type, [" + ", ".join(str(n) for _, _, n, _ in _LEASES) + "][(event_id % 4 + 1)::INT]::INT AS n_special, [" + ", ".join(str(m) for *_, m in _LEASES) + "][(event_id % 4 + 1)::INT]::INT AS n_missing FROM events")
def lease_terms(spark, d):
    """Property type, special terms and missing fields of four leases."""
    t = F.element_at(F.array(*(F.lit(x) for x, *_ in _LEASES)), (F.col("event_id") % 4 + 1).cast("int"))
    got = _t(spark, d, "events").select("event_id", rules.terms(t).alias("t"))
    return got.select("event_id", "t.property_type", F.size("t.special_terms").alias("n_special"), F.size(rules.missing(F.col("t"))).alias("n_missing"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN '{\"n\": ' || length(coalesce(text, '')) || '}' END AS analysis, true AS ruled FROM documents")
def structured_analysis(spark, d):
    """An injected analyser's word beside the rules'; where it fails, the rules stand alone."""

    def analyser(t):
        number, _, rest = t.partition("|")
        if int(number) % 4 == 0:
            raise RuntimeError("no answer")
        return f'{{"n": {len(rest)}}}'

    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("text", F.lit(""))).alias("text"))
    return rules.analyze(docs, analyser).select("doc_id", "analysis", F.col("missing_information").isNotNull().alias("ruled"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OCR' WHEN 1 THEN 'OCR' WHEN 2 THEN 'LLM' WHEN 3 THEN 'SAVING' ELSE 'COMPLETED' END AS stage,
  CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 10 + round_even(60.0 * (event_id % 4 + 1) / 4, 0) WHEN 2 THEN 80 WHEN 3 THEN 95 ELSE 100 END::INT AS progress FROM events""")
def stage_progress(spark, d):
    i = F.col("event_id")
    stage = F.when(i % 5 < 2, "OCR").when(i % 5 == 2, "LLM").when(i % 5 == 3, "SAVING").otherwise("COMPLETED")
    done = F.when(i % 5 == 1, i % 4 + 1).otherwise(0)
    return _t(spark, d, "events").select("event_id", stage.alias("stage"), scalars.stage_progress(stage, done, F.lit(4)).alias("progress"))


# Streams


@query("""WITH e AS (SELECT user_id, event_id, ts, epoch_us(date_trunc('day', ts)) // 86400000000 AS poll, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'STARTED' END AS type FROM events),
  f AS (SELECT *, min(poll) OVER (PARTITION BY user_id) AS first FROM e)
  SELECT user_id, poll, event_id AS id, type, row_number() OVER (PARTITION BY user_id, poll ORDER BY ts, event_id)::INT AS place FROM f WHERE poll > first AND type <> 'STARTED'""")
def feed_announcements(spark, d):
    """A poll a day, whose page shows the events of this day and of the day before: what each poll announces."""
    kind = F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("STARTED")
    day = F.floor(F.unix_micros("at") / 86_400_000_000)
    feed = _stream(spark, d).select("user_id", F.explode(F.array(day, day + 1)).alias("poll"), F.col("event_id").alias("id"), kind.alias("type"), F.col("at").alias("created_at"))
    with dispatch.keyed_state(spark):
        got = catalog._drain(spark, dispatch.announce(feed), "feed", "append")
    return got.select("user_id", "poll", "id", "type", "place")


def _queue_events(spark: SparkSession, d: str) -> DataFrame:
    kind, i = F.col("event_type"), F.col("event_id")
    event = F.when(kind == "view", "SUBMIT").when(kind == "click", "ASK").when(kind == "signup", "HEARTBEAT").when(kind == "purchase", "SUCCEED").otherwise("FAIL")
    worker = F.when(kind != "view", F.concat(F.lit("w"), (i % 5).cast("string")))
    return _stream(spark, d).select((F.col("user_id") % 50).alias("queue"), event.alias("event"), F.when(kind == "view", i).alias("job"), worker.alias("worker"), "at", i.alias("seq"))


@query()
def dispatch_stream(spark, d):
    """Jobs of 50 queues given to workers; a queue's rules over all its jobs have no SQL form here, so tests fold the same
    events one by one."""
    with dispatch.keyed_state(spark):
        return catalog._drain(spark, dispatch.dispatch(_queue_events(spark, d)), "dispatch", "append").drop("passed")


@query()
def failure_notices(spark, d):
    """One notice for each job that failed, from the dispatcher in the same stream."""
    with dispatch.keyed_state(spark):
        return catalog._drain(spark, dispatch.failure_notices(dispatch.dispatch(_queue_events(spark, d))), "failed", "append")
