"""Registered queries over the driver's tables, each with the SQL that says the same.

Boxes are made from lineitem (a page is an order), tasks from orders, progress
from events, texts from documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import stats as S
from pagemill.functions import text as X
from pagemill.operators import gates, geometry, linking, render, snapshots, tasks
from pagemill.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Tasks.

TASKS = "tasks AS (SELECT o_orderkey AS id, 'file-' || o_orderkey AS file_path, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'completed' END AS status, o_custkey % 5 AS attempts, o_orderpriority AS last_error, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders)"


def task_table(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "pending").otherwise("completed")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("file-"), "o_orderkey").alias("file_path"), status.alias("status"), (F.col("o_custkey") % 5).alias("attempts"), F.col("o_orderpriority").alias("last_error"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


@query("SELECT sha256(text) AS file_hash, min_by('doc-' || doc_id, (doc_id, 'doc-' || doc_id)) AS file_path, min(doc_id) AS created_at, count(*) AS copies FROM documents GROUP BY 1")
def task_dedup_sha256(spark, sf):
    d = table(spark, sf, "documents")
    return tasks.new_tasks(d.select(F.concat(F.lit("doc-"), "doc_id").alias("file_path"), tasks.content_hash(F.col("text")).alias("file_hash"), F.col("doc_id").alias("created_at")))


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS file_hash FROM documents)
SELECT file_hash, 'doc-' || min(doc_id) AS file_path, min(doc_id) AS created_at, count(*) AS copies FROM h WHERE file_hash NOT IN (SELECT file_hash FROM h WHERE doc_id % 3 = 0) GROUP BY 1""")
def task_dedup_known(spark, sf):
    h = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("file_path"), tasks.content_hash(F.col("text")).alias("file_hash"), F.col("doc_id").alias("created_at"))
    return tasks.new_tasks(h, h.where("created_at % 3 = 0"))


@query(f"WITH {TASKS}, k(status) AS (VALUES ('pending'), ('processing'), ('completed'), ('failed')) SELECT k.status, count(t.id) AS n FROM k LEFT JOIN tasks t USING (status) GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM tasks")
def task_status_summary(spark, sf):
    return tasks.status_summary(task_table(spark, sf))


@query(f"WITH {TASKS} SELECT id, file_path, attempts FROM tasks WHERE status = 'pending' AND attempts < 3 ORDER BY created_at, id LIMIT 1")
def next_pending_task(spark, sf):
    return tasks.next_pending(task_table(spark, sf)).select("id", "file_path", "attempts")


@query(f"WITH {TASKS} SELECT id, status, attempts FROM tasks WHERE status = 'pending' OR (status = 'failed' AND attempts < 3)")
def resume_tasks(spark, sf):
    return tasks.resumable(task_table(spark, sf)).select("id", "status", "attempts")


@query(f"WITH {TASKS} SELECT id, file_path, last_error FROM tasks WHERE status = 'failed' ORDER BY updated_at DESC, id DESC LIMIT 5")
def recent_failures_top5(spark, sf):
    return tasks.recent_failures(task_table(spark, sf)).drop("updated_at")


EVENT_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'processing' ELSE 'pending' END"


def task_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    t = F.col("event_type")
    status = F.when(t == "error", "failed").when(t == "purchase", "completed").when(t == "view", "processing").otherwise("pending")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("task_id"), status.alias("status"), F.when(status == "failed", F.concat(F.lit("e"), "event_id")).otherwise("").alias("error"), F.col("event_id").alias("at"), F.concat(F.lit("f"), "user_id").alias("file_path"))


@query(f"SELECT user_id AS task_id, max_by({EVENT_STATUS}, event_id) AS status, count(*) FILTER (event_type = 'error') AS attempts, max_by(CASE event_type WHEN 'error' THEN 'e' || event_id ELSE '' END, event_id) AS last_error, max(event_id) AS updated_at FROM events GROUP BY 1")
def task_state_fold(spark, sf):
    return tasks.fold_events(task_events(spark, sf))


@query(f"SELECT user_id AS task_id, max(event_id) AS seq, max_by({EVENT_STATUS}, event_id) AS status, count(*) FILTER (event_type = 'error') AS attempts, max_by(CASE event_type WHEN 'error' THEN 'e' || event_id ELSE '' END, event_id) AS last_error, max(event_id) AS updated_at, min('f' || user_id) AS file_path FROM events GROUP BY 1")
def task_log_compacted(spark, sf):
    """The log as it is kept: days are folded into states, those of all but the last days into a snapshot, and the rest merged with it on reading."""
    e = task_events(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.to_date("ts").alias("day")), "seq")
    last = e.agg(F.date_sub(F.max("day"), 6).alias("since"))
    parted = e.join(F.broadcast(last), F.lit(True), "left").withColumn("old", F.col("day") < F.col("since"))
    firsts = ("file_path",)
    snapshot = tasks.merged(tasks.state_of(parted.where("old"), firsts), firsts)
    return tasks.merged(snapshot.union(tasks.state_of(parted.where("not old"), firsts)), firsts)


@query(f"WITH e AS (SELECT *, {EVENT_STATUS} AS s FROM events) SELECT count(*) FILTER (s = 'completed') AS total_processed, count(*) FILTER (s = 'failed') AS total_failed, max_by('f' || user_id, event_id) AS last_file, max(event_id) AS last_updated FROM e")
def progress_counters(spark, sf):
    return tasks.progress(task_events(spark, sf))


@query(f"SELECT event_id AS seq, user_id AS task_id, {EVENT_STATUS} AS status FROM events ORDER BY event_id DESC LIMIT 100")
def progress_history_100(spark, sf):
    return tasks.history(task_events(spark, sf)).select("seq", "task_id", "status")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_event_per_task(spark, sf):
    return tasks.latest_per_key(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", ["event_id"])


@query("""
WITH p AS (SELECT doc_id, 'raw/' || source || CASE doc_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.tmp' ELSE '.txt' END AS path FROM documents)
SELECT doc_id, path FROM p WHERE lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'heic', 'bmp', 'tiff') AND NOT contains(path, 'src1') AND NOT ends_with(path, '5.PNG')""")
def accepted_paths(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    path = F.concat(F.lit("raw/"), "source", F.when(k == 0, ".PNG").when(k == 1, ".jpeg").when(k == 2, ".tmp").otherwise(".txt"))
    return d.select("doc_id", path.alias("path")).where(X.accepts_path(F.col("path"), files.EXTENSIONS, ("**/src1", "*5.PNG")))


# Titles and links.

TITLES = "titles AS (SELECT DISTINCT list_aggregate(list_slice(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), 1, 2), 'string_agg', ' ') AS title FROM benchmark)"


def title_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.array_join(F.slice(X.tokens(F.col("text")), 1, 2), " ").alias("title")).distinct()


@query("""
WITH n AS (SELECT 'vault/' || CASE WHEN page_id % 7 = 0 THEN '.hidden/' ELSE '' END || 'note ' || page_id || '.md' AS path, chr(10) || 'title: "' || regexp_extract(html, '<title>([^<]*)</title>', 1) || '"' AS content FROM pages),
s AS (SELECT * FROM n WHERE NOT regexp_matches(path, '/\\.[^/]+/'))
SELECT DISTINCT title FROM (SELECT regexp_extract(path, '([^/]*)\\.md$', 1) AS title FROM s UNION ALL SELECT nullif(regexp_replace(regexp_extract(left(content, 500), 'title:[ \\t]*["'']?([^"''\\r\\n]+)', 1), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '') FROM s) WHERE title IS NOT NULL""")
def vault_titles(spark, sf):
    p = table(spark, sf, "pages")
    path = F.concat(F.lit("vault/"), F.when(F.col("page_id") % 7 == 0, ".hidden/").otherwise(""), F.lit("note "), "page_id", F.lit(".md"))
    content = F.concat(F.lit('\ntitle: "'), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit('"'))
    return files.titles_of(p.select(path.alias("path"), content.alias("content")))


GRAMS = "toks AS (SELECT {id} AS doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w FROM {t}), grams AS (SELECT doc_id, n, pos, array_to_string(list_slice(w, pos + 1, pos + n), ' ') AS text FROM toks, (SELECT unnest(range(1, 6)) AS n), LATERAL (SELECT unnest(range(0, greatest(0, len(w) - n + 1))) AS pos))"


@query(f"WITH {GRAMS.format(id='item_id', t='benchmark')} SELECT * FROM grams")
def ngrams_1_5(spark, sf):
    words = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), X.tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.inline(X.ngrams(F.col("words"))))


NORM = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g')"
SIGNS = "list_distinct(string_split({0}, ''))"
BLACK = ", ".join(f"'{w}'" for w in linking.BLACKLIST)
CANDIDATES = f"""
WITH {TITLES}, {GRAMS.format(id="doc_id", t="documents")},
g AS MATERIALIZED (SELECT *, lower(text) AS low, {NORM.format("text")} AS norm FROM (SELECT DISTINCT text FROM grams) WHERE lower(text) NOT IN ({BLACK})),
t AS MATERIALIZED (SELECT title AS target, lower(title) AS t_low, {NORM.format("title")} AS t_norm FROM titles),
m AS MATERIALIZED (SELECT text, target, CASE WHEN low = t_low THEN 1.0::DOUBLE WHEN norm = t_norm THEN 0.9::DOUBLE
        ELSE len(list_intersect({SIGNS.format("norm")}, {SIGNS.format("t_norm")}))::DOUBLE / greatest(length(norm), length(t_norm)) * 0.8 END AS confidence,
      CASE WHEN low = t_low THEN 'exact' WHEN norm = t_norm THEN 'normalized' ELSE 'partial' END AS match_type
      FROM g, t WHERE length(norm) * 4 >= length(t_norm) * 3 AND length(t_norm) * 4 >= length(norm) * 3 AND (contains(norm, t_norm) OR contains(t_norm, norm))),
c AS MATERIALIZED (SELECT doc_id, n, pos, text, target, confidence, match_type FROM grams JOIN m USING (text) WHERE confidence >= 0.6),
top AS MATERIALIZED (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, target ORDER BY confidence DESC, n, pos) = 1),
x AS (SELECT top.*, lower(d.text) AS ctx FROM top JOIN documents d USING (doc_id)),
y AS (SELECT *, CASE WHEN match_type = 'exact' THEN least(confidence + 0.1, 1.0) ELSE confidence END AS c1, (length(ctx) - length(replace(ctx, lower(text), ''))) // length(text) AS times FROM x),
z AS (SELECT doc_id, n, pos, text, target, confidence, match_type, (CASE WHEN times > 1 THEN least(c1 + 0.05 * (times - 1), 1.0) ELSE c1 END) * (CASE WHEN length(text) < 3 THEN 0.8 ELSE 1.0 END) AS adjusted FROM y)
"""


@query(CANDIDATES + "SELECT * FROM c")
def link_candidates(spark, sf):
    return linking.link_candidates(table(spark, sf, "documents"), title_table(spark, sf))


@query(f"""
WITH {TITLES}, {GRAMS.format(id="item_id", t="benchmark")},
g AS MATERIALIZED (SELECT *, lower(text) AS low, {NORM.format("text")} AS norm FROM (SELECT DISTINCT text FROM grams) WHERE lower(text) NOT IN ({BLACK})),
t AS MATERIALIZED (SELECT title AS target, lower(title) AS t_low, {NORM.format("title")} AS t_norm FROM titles),
m AS MATERIALIZED (SELECT text, target, CASE WHEN low = t_low THEN 1.0::DOUBLE WHEN norm = t_norm THEN 0.9::DOUBLE
        ELSE len(list_intersect({SIGNS.format("norm")}, {SIGNS.format("t_norm")}))::DOUBLE / greatest(length(norm), length(t_norm)) * 0.8 END AS confidence
      FROM g, t WHERE norm <> '' AND t_norm <> '' AND (contains(norm, t_norm) OR contains(t_norm, norm)))
SELECT doc_id, n, pos, text, target, confidence FROM grams JOIN m USING (text) WHERE confidence > 0.4""")
def link_candidates_all(spark, sf):
    """Every tier, the one of 0.4 to 0.6 too; the SQL has no band of lengths."""
    grams = linking.document_ngrams(table(spark, sf, "benchmark"), "item_id", "text")
    return linking.match_titles_all(grams, title_table(spark, sf)).drop("match_type")


def _top(spark, sf):
    return linking.top_per_target(link_candidates(spark, sf))


def _scored(spark, sf):
    return linking.score(_top(spark, sf), table(spark, sf, "documents"))


@query(CANDIDATES + "SELECT * FROM top")
def link_top_per_target(spark, sf):
    return _top(spark, sf)


@query(CANDIDATES + "SELECT * FROM z")
def link_scored(spark, sf):
    return _scored(spark, sf)


@query(CANDIDATES + "SELECT CASE WHEN adjusted > 0.85 THEN 'high' WHEN adjusted >= 0.6 THEN 'medium' ELSE 'low' END AS category, count(*) AS n, min(doc_id) AS first_doc FROM z GROUP BY 1")
def link_categories(spark, sf):
    return _scored(spark, sf).groupBy(linking.category(F.col("adjusted")).alias("category")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(CANDIDATES + "SELECT doc_id, target, n, pos, text, adjusted FROM z WHERE (doc_id, target) NOT IN (SELECT doc_id, target FROM z WHERE doc_id % 2 = 0)")
def link_not_yet_linked(spark, sf):
    s = _scored(spark, sf)
    return linking.drop_linked(s, s.where("doc_id % 2 = 0")).select("doc_id", "target", "n", "pos", "text", "adjusted")


@query(CANDIDATES + f""", k AS (SELECT doc_id, string_agg('<!-- LINK: ' || text || ' -> [[' || target || ']] (conf: ' || printf('%.2f', confidence) || ') -->', chr(10) ORDER BY adjusted DESC, n, pos, target) AS body FROM z WHERE confidence > 0.6 GROUP BY 1)
SELECT doc_id, '{X.LINKS_HEAD}' || chr(10) || body AS comments FROM k""")
def link_comment_lines(spark, sf):
    return linking.link_comments(_scored(spark, sf))


# Text rules.

LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
PACK = "regexp_replace({0}, '[\\s\\p{{Z}}]+', '', 'g')"
TRIM = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def line_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _terms(column: str, terms) -> str:
    return "(" + " + ".join(f"contains({column}, '{t}')::INT" for t in terms) + ")"


@query(f"""
WITH {LINES}, l AS (SELECT doc_id, pos, {PACK.format("line")} AS c FROM lines)
SELECT doc_id, pos, CASE WHEN c = '' THEN 'empty' WHEN {_terms("c", X.STRONG_TERMS)} > 0 OR {_terms("c", X.WEAK_TERMS)} >= 2 THEN 'toolbar'
  WHEN regexp_full_match(c, '[-_—=+*/\\\\|.·,:;!?()\\[\\]{{}}<>]+') THEN 'symbol' WHEN regexp_full_match(c, '第?\\p{{Nd}}+页|\\p{{Nd}}+/\\p{{Nd}}+') THEN 'page_number' END AS kind FROM l""")
def line_noise_kind(spark, sf):
    return line_table(spark, sf).select("doc_id", "pos", X.noise_kind(F.col("line"), False).alias("kind"))


@query(f"""
WITH {LINES}, l AS (SELECT doc_id, pos, {PACK.format("line")} AS c FROM lines)
SELECT doc_id, pos, NOT regexp_full_match(c, '[\\p{{Nd}}.,%+\\-/~():：·¥$€]+') AND (length(c) <= 6 OR {_terms("lower(c)", X.FOOTER_TERMS)} > 0) AS noise FROM l""")
def margin_noise(spark, sf):
    return line_table(spark, sf).select("doc_id", "pos", X.is_margin_noise(F.col("line")).alias("noise"))


@query(f"""
WITH w AS (SELECT l_orderkey * 10 + l_linenumber AS k, CASE l_linenumber % 4 WHEN 0 THEN l_partkey || ' / ' || l_suppkey WHEN 1 THEN '第 ' || l_partkey || ' 页' WHEN 2 THEN l_suppkey || '' ELSE 'no page' END AS t FROM lineitem),
c AS (SELECT k, t, {PACK.format("t")} AS c FROM w)
SELECT k, t, coalesce(CASE WHEN regexp_matches(c, '(\\p{{Nd}}+)/(\\p{{Nd}}+)') THEN regexp_extract(c, '\\p{{Nd}}+/\\p{{Nd}}+') WHEN regexp_full_match(c, '第?(\\p{{Nd}}+)页') THEN regexp_extract(c, '\\p{{Nd}}+') END, CASE WHEN regexp_full_match(c, '\\p{{Nd}}{{1,4}}') THEN c END) AS page FROM c""")
def page_number_values(spark, sf):
    i = table(spark, sf, "lineitem")
    m = F.col("l_linenumber") % 4
    t = F.when(m == 0, F.concat("l_partkey", F.lit(" / "), "l_suppkey")).when(m == 1, F.concat(F.lit("第 "), "l_partkey", F.lit(" 页"))).when(m == 2, F.col("l_suppkey").cast("string")).otherwise("no page")
    return i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), t.alias("t")).select("k", "t", F.coalesce(X.explicit_page_number(F.col("t")), X.bare_page_number(F.col("t"))).alias("page"))


STITCH = """
k AS (SELECT doc_id, part, pos, line, lower(regexp_replace(line, '[|\\-\\s\\p{{Z}}]', '', 'g')) AS key FROM {0}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY part, pos) AS rn FROM k)
SELECT doc_id, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY part, pos), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS text FROM r WHERE rn = 1 OR length(key) < 4 GROUP BY 1"""


@query("WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) || [''] AS l FROM documents WHERE text <> ''), x AS (SELECT doc_id, 0 AS part, unnest(range(len(l))) AS pos, unnest(l) AS line FROM p), " + STITCH.format("x"))
def stitch_dedup_lines(spark, sf):
    return render.stitch_regions(table(spark, sf, "documents").select("doc_id", F.lit(0).alias("part"), "text"))


@query("WITH p AS (SELECT conv_id AS doc_id, turn AS part, string_split(regexp_replace(text, '\\n$', ''), chr(10)) || [''] AS l FROM conversations WHERE text <> ''), x AS (SELECT doc_id, part, unnest(range(len(l))) AS pos, unnest(l) AS line FROM p), " + STITCH.format("x"))
def stitch_turns(spark, sf):
    return render.stitch_regions(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"), "text"))


CONSISTENT = """
WITH pair AS (SELECT d.doc_id, d.text AS a, coalesce(n.text, d.text) AS b FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1),
ta AS (SELECT doc_id, replace(unnest(regexp_extract_all(a, '[0-9]+(?:[.,][0-9]+)*%?')), ',', '') AS t FROM pair),
tb AS (SELECT doc_id, replace(unnest(regexp_extract_all(b, '[0-9]+(?:[.,][0-9]+)*%?')), ',', '') AS t FROM pair),
ca AS (SELECT doc_id, t, count(*) AS a FROM ta GROUP BY ALL), cb AS (SELECT doc_id, t, count(*) AS b FROM tb GROUP BY ALL),
j AS (SELECT doc_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM ca FULL JOIN cb USING (doc_id, t)),
s AS (SELECT doc_id, sum(a) AS na, sum(b) AS nb, sum(least(a, b)) AS kept, sum(greatest(b - a, 0)) AS new FROM j GROUP BY 1),
m AS (SELECT doc_id, coalesce(na, 0)::BIGINT AS n_ocr, coalesce(nb, 0)::BIGINT AS n_vlm, CASE WHEN coalesce(na, 0) = 0 THEN 0.0 ELSE kept / na::DOUBLE END AS hit, CASE WHEN coalesce(na, 0) = 0 THEN CASE WHEN coalesce(nb, 0) > 0 THEN 1.0 ELSE 0.0 END WHEN nb > 0 THEN new / nb::DOUBLE ELSE 0.0 END AS fabricate FROM pair LEFT JOIN s USING (doc_id))
"""


def _consistency(spark, sf):
    """Each document's numbers against those of the next one by id."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b"))
    return gates.consistency_of(d.join(following, "doc_id", "left").withColumn("b", F.coalesce("b", "text")), "doc_id", "text", "b")


@query(CONSISTENT + "SELECT * FROM m")
def numeric_consistency(spark, sf):
    return _consistency(spark, sf)


@query(CONSISTENT + "SELECT doc_id, hit >= 0.9 AND fabricate <= 0.05 AND (doc_id % 10) / 10.0 >= 0.5 AS adopt, (hit < 0.9)::INT + (fabricate > 0.05)::INT + ((doc_id % 10) / 10.0 < 0.5)::INT AS n_reasons FROM m")
def rebuild_verdicts(spark, sf):
    v = gates.rebuild_verdict(_consistency(spark, sf).withColumn("struct", (F.col("doc_id") % 10) / 10.0))
    return v.select("doc_id", "adopt", F.size("reasons").alias("n_reasons"))


ERRORS = "((contains({0}, '0') AND contains({0}, 'O')) OR (contains({0}, '1') AND contains({0}, 'l')) OR (contains({0}, '5') AND contains({0}, 'S')) OR (contains({0}, '8') AND contains({0}, 'B')) OR regexp_matches({0}, '[^\\x00-\\x7F]'))"


@query(f"SELECT doc_id, {ERRORS.format('text')} AS flagged FROM documents")
def ocr_error_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.has_ocr_errors(F.col("text")).alias("flagged"))


def _text_blocks(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.floor(F.col("doc_id") / 10).alias("page_id"), F.col("doc_id").alias("block_id"), F.when(F.col("doc_id") % 9 == 0, "table").otherwise("text").alias("type"), "text", ((F.col("doc_id") * 37 % 100) / 100).alias("confidence"), ((F.floor(F.col("doc_id") / 10) * 13 % 100) / 100).alias("page_confidence"))


@query(f"SELECT doc_id // 10 AS page_id, doc_id AS block_id FROM documents WHERE (doc_id // 10 * 13 % 100) / 100.0 < 0.85 AND doc_id % 9 <> 0 AND (doc_id * 37 % 100) / 100.0 < 0.95 AND {ERRORS.format('text')}")
def correction_candidates(spark, sf):
    return gates.correction_candidates(_text_blocks(spark, sf)).select("page_id", "block_id")


@query("SELECT doc_id // 10 AS page_id, least(1.0, avg((doc_id * 37 % 100) / 100.0) * 1.1) AS confidence FROM documents GROUP BY 1")
def corrected_confidence(spark, sf):
    return gates.corrected_confidence(_text_blocks(spark, sf))


@query("SELECT doc_id // 10 AS page_id, avg(CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE (doc_id * 37 % 100) / 100.0 END) AS confidence FROM documents GROUP BY 1")
def table_confidence(spark, sf):
    return gates.table_confidence(_text_blocks(spark, sf).withColumn("confidence", F.when(F.col("block_id") % 4 != 0, F.col("confidence"))))


@query(f"SELECT doc_id, length(translate(text, '{X.MATH_SIGNS}', '')) < length(text) AS math FROM documents")
def math_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.has_math(F.col("text")).alias("math"))


@query(f"""
WITH {LINES}, t AS (SELECT doc_id, pos, replace({TRIM.format("regexp_replace(line, '^[>#*\\-–—•·\\s\\p{Z}]+', '')")}, '"', '\'\'') AS t FROM lines),
s AS (SELECT doc_id, pos, t, {TRIM.format("regexp_extract(t, '^[^。！？；;.!?]*')")} AS first FROM t),
u AS (SELECT doc_id, pos, CASE WHEN first = '' THEN t ELSE first END AS sentence FROM s)
SELECT doc_id, pos, sentence, CASE WHEN length(sentence) <= 30 THEN 'complete' WHEN (length(sentence) - 30) / 30.0 < 0.3 THEN 'tolerated' ELSE 'condensed' END AS mode FROM u""")
def summary_sentences(spark, sf):
    s = line_table(spark, sf).select("doc_id", "pos", X.leading_sentence(F.col("line")).alias("sentence"))
    return s.select("doc_id", "pos", "sentence", X.summary_mode(F.col("sentence")).alias("mode"))


@query(f"""
WITH {LINES}, t AS (SELECT doc_id, pos, replace({TRIM.format("regexp_replace(line, '^[>#*\\-–—•·\\s\\p{Z}]+', '')")}, '"', '\'\'') AS t FROM lines),
s AS (SELECT doc_id, pos, t, {TRIM.format("regexp_extract(t, '^[^。！？；;.!?]*')")} AS first FROM t),
u AS (SELECT doc_id, pos, CASE WHEN first = '' THEN t ELSE first END AS sentence FROM s),
c AS (SELECT doc_id, pos, sentence, regexp_extract_all(sentence, '[^，、：,;]*[，、：,;]|[^，、：,;]+$') AS cl FROM u WHERE (length(sentence) - 30) / 30.0 >= 0.3),
k AS (SELECT *, list_max(list_filter(range(1, len(cl) + 1), lambda k: length(array_to_string(cl[1:k - 1], '')) + length(regexp_replace(cl[k], '[，、：,;]$', '')) <= 30)) AS n FROM c),
h AS (SELECT doc_id, pos, {TRIM.format("regexp_replace(array_to_string(cl[1:coalesce(n, 0)], ''), '[，、：,; ]+$', '')")} AS held, substr(sentence, 1, 30) AS part FROM k),
w AS (SELECT *, regexp_extract(part, '^(.*)[，、：, ]', 1) AS before FROM h)
SELECT doc_id, pos, CASE WHEN held <> '' THEN held ELSE {TRIM.format("CASE WHEN length(before) >= 15 THEN before ELSE part END")} END AS title FROM w""")
def condensed_titles(spark, sf):
    """Sentences too long for a title, cut to their leading clauses."""
    s = line_table(spark, sf).select("doc_id", "pos", X.leading_sentence(F.col("line")).alias("sentence"))
    return s.where(X.summary_mode(F.col("sentence")) == "condensed").select("doc_id", "pos", X.condensed(F.col("sentence")).alias("title"))


@query("SELECT doc_id, " + TRIM.format("text") + " AS body FROM documents")
def without_fences(spark, sf):
    d = table(spark, sf, "documents")
    fenced = F.concat(F.lit("```markdown\n"), "text", F.when(F.col("doc_id") % 2 == 0, "\n```").otherwise("```\n"))
    return d.select("doc_id", X.without_fences(fenced).alias("body"))


@query(f"WITH {TASKS} SELECT id, file_path, status FROM tasks WHERE sha256(file_path) = sha256('file-1')")
def task_by_hash(spark, sf):
    t = task_table(spark, sf).withColumn("file_hash", F.sha2(F.col("file_path").cast("binary"), 256))
    return tasks.by_hash(t, hashlib.sha256(b"file-1").hexdigest()).select("id", "file_path", "status")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS cached FROM documents")
def cached_files(spark, sf):
    held, rest = files.cached(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
    return held.withColumn("cached", F.lit(True)).union(rest.withColumn("cached", F.lit(False)))


SAFE = "regexp_replace(translate(regexp_replace({0}, '[^\\p{{L}}\\p{{N}} \\-_.]', '_', 'g'), ' ', '-'), '-{{2,}}', '-', 'g')"


@query(f"SELECT page_id, {SAFE.format('url')} AS name FROM pages")
def sanitized_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.sanitize_filename(F.col("url")).alias("name"))


STEM = "regexp_replace(regexp_extract(url, '[^/\\\\]*$'), '(.)\\.[^.]*$', '\\1')"


@query(f"SELECT page_id, '2024-03-05_' || {SAFE.format(STEM)} || '.md' AS name FROM pages")
def note_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.note_file_name(F.col("url"), F.to_date(F.lit("2024-03-05"))).alias("name"))


@query("""SELECT doc_id, '---' || chr(10) || 'title: "' || source || '"' || chr(10) || 'date: 2024-03-05' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'page: ' || doc_id ELSE '' END || chr(10) || 'tags: ["ocr/pending"' || CASE WHEN doc_id % 3 = 0 THEN ', "ocr/table"' ELSE '' END || ']' || chr(10) || 'status: pending' || chr(10) || 'source: "[[00-RAW/' || source || '.png]]"' || chr(10) || 'ocr_confidence: 0.' || CASE WHEN doc_id % 8 = 0 THEN '25' ELSE '50' END || chr(10) || '---' AS front FROM documents""")
def front_matter(spark, sf):
    d = table(spark, sf, "documents")
    page = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string"))
    c = F.when(F.col("doc_id") % 8 == 0, 0.25).otherwise(0.5)
    return d.select("doc_id", X.front_matter(F.col("source"), F.concat(F.lit("a\\b/"), "source", F.lit(".png")), c, F.col("doc_id") % 3 == 0, F.to_date(F.lit("2024-03-05")), page).alias("front"))


@query("SELECT page_id, regexp_extract(html, '(?is)<ul.*?</ul>') AS ul, len(list_filter(list_transform(regexp_extract_all('<table>' || replace(replace(html, '<li>', '<td>'), '</li>', '</td>') || '</table>', '(?s)<td[^>]*>(.*?)</td>', 1), lambda x: regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '[\\s\\p{Z}]+', '', 'g')), lambda x: x <> '')) AS n_cells FROM pages")
def html_cell_texts(spark, sf):
    p = table(spark, sf, "pages")
    as_table = F.concat(F.lit("<table>"), F.replace(F.replace("html", F.lit("<li>"), F.lit("<td>")), F.lit("</li>"), F.lit("</td>")), F.lit("</table>"))
    return p.select("page_id", F.regexp_extract("html", "(?is)<ul.*?</ul>", 0).alias("ul"), F.size(X.cell_texts(X.first_table_html(as_table))).alias("n_cells"))


@query(f"WITH {LINES} SELECT doc_id, pos, " + TRIM.format("replace(replace(line, '|', chr(92) || '|'), chr(10), ' ')") + " AS cell FROM lines")
def escaped_cells(spark, sf):
    return line_table(spark, sf).select("doc_id", "pos", X.escape_cell(F.col("line")).alias("cell"))


# Boxes.

BOXES = """
boxes AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS block_id,
  ((l_suppkey * 13) % 600)::DOUBLE AS center_x, ((l_partkey * 7) % 400)::DOUBLE AS center_y, (10 + l_quantity)::DOUBLE AS width, (12 + l_linenumber)::DOUBLE AS height, l_returnflag || l_linenumber AS text FROM lineitem),
b AS (SELECT *, center_x - width / 2 AS min_x, center_x + width / 2 AS max_x, center_y - height / 2 AS min_y, center_y + height / 2 AS max_y FROM boxes)"""
MH = "list_sort(list(height))[count(*) // 2 + 1]"
ROWS = f"""{BOXES},
ord AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY center_y, block_id) AS k FROM b),
tol AS (SELECT page_id, greatest(0.7 * {MH}, 8.0) AS t FROM b GROUP BY 1),
fold AS (SELECT page_id, k, 0 AS row_no, center_y AS s, 1 AS n FROM ord WHERE k = 1
  UNION ALL SELECT o.page_id, o.k, CASE WHEN abs(o.center_y - f.s / f.n) <= t.t THEN f.row_no ELSE f.row_no + 1 END, CASE WHEN abs(o.center_y - f.s / f.n) <= t.t THEN f.s + o.center_y ELSE o.center_y END, CASE WHEN abs(o.center_y - f.s / f.n) <= t.t THEN f.n + 1 ELSE 1 END
  FROM fold f JOIN ord o ON o.page_id = f.page_id AND o.k = f.k + 1 JOIN tol t ON t.page_id = f.page_id),
r AS (SELECT ord.*, fold.row_no FROM ord JOIN fold USING (page_id, k))"""
ANCHORS = f"""{ROWS},
mh AS (SELECT page_id, {MH} AS mh, count(DISTINCT row_no) AS n_rows FROM r GROUP BY 1),
step AS (SELECT r.page_id, center_x, n_rows, CASE WHEN center_x - lag(center_x) OVER w > greatest(1.5 * mh, 20.0) THEN 1 ELSE 0 END AS new FROM r JOIN mh USING (page_id) WINDOW w AS (PARTITION BY r.page_id ORDER BY center_x)),
run AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY center_x) AS c FROM step),
cl AS (SELECT page_id, c, avg(center_x) AS anchor, count(*) AS n, any_value(n_rows) AS n_rows FROM run GROUP BY 1, 2),
an AS (SELECT page_id, any_value(n_rows) AS n_rows, CASE WHEN count(*) FILTER (n >= 2 OR n_rows < 3) > 0 THEN list_sort(list(anchor) FILTER (n >= 2 OR n_rows < 3)) ELSE list_sort(list(anchor)) END AS anchors FROM cl GROUP BY 1)"""
SNAP = f"""{ANCHORS},
pick AS (SELECT r.page_id, r.block_id, r.row_no, abs(a - r.center_x) AS off, i, len(anchors) AS n_cols FROM r JOIN an USING (page_id), LATERAL (SELECT unnest(anchors) AS a, unnest(range(len(anchors))) AS i)),
sn AS (SELECT * FROM pick QUALIFY row_number() OVER (PARTITION BY page_id, block_id ORDER BY off, i) = 1)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    cx, cy = ((F.col(c) * k % m).cast("double") for c, k, m in (("l_suppkey", 13, 600), ("l_partkey", 7, 400)))
    width, height = F.col("l_quantity") + 10.0, F.col("l_linenumber") + 12.0
    b = i.select(F.col("l_orderkey").alias("page_id"), (F.row_number().over(w) - 1).cast("long").alias("block_id"), F.lit("text").alias("type"), F.concat("l_returnflag", "l_linenumber").alias("text"), cx.alias("cx"), cy.alias("cy"), width.alias("w"), height.alias("h"))
    corner = lambda sx, sy: F.struct((F.col("cx") + sx * F.col("w") / 2).alias("x"), (F.col("cy") + sy * F.col("h") / 2).alias("y"))
    return geometry.with_metrics(b.select("page_id", "block_id", "type", "text", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("bbox"))).drop("bbox")


def rowed(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.assign_rows(boxes(spark, sf))


@query(f"WITH {BOXES} SELECT page_id, block_id, min_x, max_x, min_y, max_y, center_x, center_y, width, height FROM b")
def box_metrics(spark, sf):
    return boxes(spark, sf).drop("type", "text")


@query(f"WITH {BOXES} SELECT page_id, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y, {MH} AS median_height FROM b GROUP BY 1")
def page_extents(spark, sf):
    return boxes(spark, sf).groupBy("page_id").agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), S.upper_median("height").alias("median_height"))


@query(f"""
WITH {BOXES}, t AS (SELECT * REPLACE (CASE block_id % 4 WHEN 0 THEN 'a longer line of prose' WHEN 1 THEN '7' WHEN 2 THEN text ELSE block_id || '/9' END AS text) FROM b),
e AS (SELECT *, min(min_y) OVER w AS top, max(max_y) OVER w AS bot, min(min_x) OVER w AS l, max(max_x) OVER w AS r FROM t WINDOW w AS (PARTITION BY page_id)),
f AS (SELECT *, max_y <= top + greatest(bot - top, 1.0) * 0.07 OR min_y >= bot - greatest(bot - top, 1.0) * 0.07 AS margin, min_y >= bot - greatest(bot - top, 1.0) * 0.07 AS foot, (center_x - l) / greatest(r - l, 1.0) >= 0.75 AS far FROM e),
g AS (SELECT *, CASE WHEN block_id % 4 = 3 THEN text END AS explicit, CASE WHEN block_id % 4 = 1 AND margin AND far THEN text END AS bare FROM f),
h AS (SELECT *, coalesce(explicit, CASE WHEN count(bare) OVER (PARTITION BY page_id) = 1 THEN bare END) AS page_number FROM g)
SELECT page_id, block_id, page_number, CASE WHEN page_number IS NOT NULL THEN 'page_number' WHEN margin AND block_id % 4 = 2 THEN CASE WHEN foot THEN 'footer' ELSE 'header' END END AS reason FROM h""")
def partitioned_blocks(spark, sf):
    k = F.col("block_id") % 4
    t = F.when(k == 0, "a longer line of prose").when(k == 1, "7").when(k == 2, F.col("text")).otherwise(F.concat("block_id", F.lit("/9")))
    return geometry.partition_blocks(boxes(spark, sf).withColumn("text", t)).select("page_id", "block_id", "page_number", "reason")


@query(f"WITH RECURSIVE {ROWS} SELECT page_id, block_id, row_no FROM r")
def row_clusters(spark, sf):
    return rowed(spark, sf).select("page_id", "block_id", "row_no")


@query(f"WITH RECURSIVE {ROWS} SELECT page_id, row_no, min(min_y) AS top, max(max_y) AS bottom, count(*) AS n_blocks, string_agg(text, ' ' ORDER BY min_x, center_y, block_id) AS row_text FROM r GROUP BY 1, 2")
def row_texts(spark, sf):
    return geometry.row_boxes(rowed(spark, sf)).select("page_id", "row_no", "top", "bottom", "n_blocks", "row_text")


@query(f"""
WITH RECURSIVE {ROWS}, g AS (SELECT page_id, row_no, min(min_y) AS top, max(max_y) AS bottom FROM r GROUP BY 1, 2), m AS (SELECT page_id, {MH} AS mh FROM b GROUP BY 1),
c AS (SELECT g.*, CASE WHEN top - lag(bottom) OVER (PARTITION BY page_id ORDER BY row_no) > greatest(2.8 * mh, 28.0) THEN 1 ELSE 0 END AS cut FROM g JOIN m USING (page_id))
SELECT page_id, row_no, sum(cut) OVER (PARTITION BY page_id ORDER BY row_no)::INT AS band_no FROM c""")
def page_bands(spark, sf):
    return geometry.bands(rowed(spark, sf))


@query(f"WITH RECURSIVE {ANCHORS} SELECT page_id, n_rows, len(anchors) AS n_cols, anchors[1] AS first_anchor, anchors[-1] AS last_anchor FROM an")
def column_anchors(spark, sf):
    a = geometry.column_anchors(rowed(spark, sf))
    return a.select("page_id", "n_rows", F.size("anchors").alias("n_cols"), F.element_at("anchors", 1).alias("first_anchor"), F.element_at("anchors", -1).alias("last_anchor"))


@query(f"WITH RECURSIVE {SNAP} SELECT page_id, block_id, i AS col, off AS \"offset\" FROM sn")
def snapped_columns(spark, sf):
    r = rowed(spark, sf)
    return geometry.snapped(r).select("page_id", "block_id", "col", "offset")


@query(f"""
WITH RECURSIVE {SNAP}, g AS (SELECT page_id, row_no, count(*) AS n, count(DISTINCT i) AS filled, any_value(n_cols) AS n_cols FROM sn GROUP BY 1, 2),
p AS (SELECT page_id, count(*) AS n_rows, count(*) FILTER (n >= 2) AS n_multi, any_value(n_cols) AS n_cols, count(*) FILTER (filled >= 2) AS n_aligned FROM g GROUP BY 1)
SELECT *, n_rows >= 2 AND n_multi >= 2 AND n_multi / n_rows >= 0.6 AND n_cols >= 2 AND n_aligned >= 2 AND n_aligned / n_rows >= 0.6 AS is_table FROM p""")
def table_like(spark, sf):
    return geometry.table_like(rowed(spark, sf))


@query(f"""
WITH RECURSIVE {SNAP}, c AS (SELECT page_id, row_no, i, count(*) AS n FROM sn GROUP BY ALL), g AS (SELECT page_id, row_no, count(*) AS used, max(n) AS most FROM c GROUP BY ALL),
p AS (SELECT page_id, count(*) AS n_rows, sum(used) AS filled, avg(used) AS mean, stddev_pop(used) AS dev, count(*) FILTER (most >= 2) AS hits FROM g GROUP BY 1),
o AS (SELECT page_id, list_sort(list(off))[count(*) // 2 + 1] AS drift, any_value(n_cols) AS n_cols FROM sn GROUP BY 1),
d AS (SELECT page_id, greatest(list_sort(list_transform(range(1, len(anchors)), lambda k: anchors[k + 1] - anchors[k]))[(len(anchors) - 1) // 2 + 1], 1.0) AS gap FROM an WHERE len(anchors) >= 2),
q AS (SELECT page_id, filled / (n_rows * n_cols)::DOUBLE AS fill, greatest(0.0, 1 - drift / (gap * 0.5)) AS align, greatest(0.0, 1 - dev / greatest(mean, 1.0)) AS stab, hits / n_rows::DOUBLE AS collision, least(1.0, greatest(0.0, (n_cols - 9) / 9.0::DOUBLE)) AS col_penalty, n_cols FROM p JOIN o USING (page_id) JOIN d USING (page_id))
SELECT page_id, fill, align, stab, collision, col_penalty, n_cols, greatest(0.0, least(1.0, 0.30 * fill + 0.30 * align + 0.20 * stab + 0.20 * (1 - collision) - 0.35 * col_penalty)) AS score FROM q""")
def grid_quality(spark, sf):
    return geometry.grid_quality(rowed(spark, sf))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    x0, y0 = F.col("o_custkey") % 300, F.col("o_orderkey") % 200
    return o.select(F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 3).alias("region_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 250).alias("x1"), (y0 + 150).alias("y1"))


REGIONS = "regions AS (SELECT o_orderkey AS page_id, o_custkey % 3 AS region_id, o_custkey % 300 AS x0, o_orderkey % 200 AS y0, o_custkey % 300 + 250 AS x1, o_orderkey % 200 + 150 AS y1 FROM orders)"


@query(f"WITH {BOXES}, {REGIONS} SELECT b.page_id, region_id, count(*) AS n, min(block_id) AS first_block FROM b JOIN regions g ON b.page_id = g.page_id AND center_x BETWEEN x0 AND x1 AND center_y BETWEEN y0 AND y1 GROUP BY 1, 2")
def blocks_in_regions(spark, sf):
    return geometry.blocks_in_regions(boxes(spark, sf), regions(spark, sf)).groupBy("page_id", "region_id").agg(F.count("*").alias("n"), F.min("block_id").alias("first_block"))


@query(f"""
WITH {REGIONS}, e AS (SELECT l_orderkey AS page_id, l_linenumber AS item_id, l_partkey % 300 AS x0, l_suppkey % 200 AS y0, l_partkey % 300 + 240 AS x1, l_suppkey % 200 + 160 AS y1 FROM lineitem),
p AS (SELECT a.page_id, a.region_id, b.item_id, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS inter FROM regions a JOIN e b USING (page_id)),
q AS (SELECT *, inter / (250 * 150 + 240 * 160 - inter)::DOUBLE AS iou FROM p WHERE inter > 0)
SELECT page_id, region_id, item_id, iou FROM q WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY page_id, region_id ORDER BY iou DESC, item_id) = 1""")
def enhanced_match_iou(spark, sf):
    i = table(spark, sf, "lineitem")
    x0, y0 = F.col("l_partkey") % 300, F.col("l_suppkey") % 200
    e = i.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("item_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 240).alias("x1"), (y0 + 160).alias("y1"))
    return geometry.match_enhanced(regions(spark, sf), e)


@query(f"""
WITH {REGIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY region_id) AS rn FROM regions), p AS (SELECT page_id, region_id, greatest(x0 - 14, 0) AS x0, greatest(y0 - 14, 0) AS y0, least(x1 + 14, 400) AS x1, least(y1 + 14, 300) AS y1 FROM n WHERE rn <= 4)
SELECT * FROM p WHERE x1 - x0 >= 8 AND y1 - y0 >= 8""")
def padded_regions(spark, sf):
    r = regions(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")})
    return geometry.padded_boxes(r, F.lit(400), F.lit(300))


RUNS = """
{n}s AS (SELECT page_id, {v}, CASE WHEN {v} - lag({v}) OVER (PARTITION BY page_id ORDER BY {v}) > greatest({k} * mh, {m}) THEN 1 ELSE 0 END AS new FROM b JOIN med USING (page_id)),
{n}r AS (SELECT page_id, {v}, sum(new) OVER (PARTITION BY page_id ORDER BY {v}) AS c FROM {n}s)"""
FIT = f"{BOXES}, med AS (SELECT page_id, {MH} AS mh FROM b GROUP BY 1), {RUNS.format(n='y', v='center_y', k=0.8, m='8.0')}, {RUNS.format(n='x', v='center_x', k=1.2, m='12.0')}"


@query(f"""
WITH {FIT}, yc AS (SELECT page_id, c, avg(center_y) AS m FROM yr GROUP BY 1, 2), xc AS (SELECT page_id, c, avg(center_x) AS m FROM xr GROUP BY 1, 2),
py AS (SELECT b.page_id, block_id, c FROM b JOIN yc USING (page_id) QUALIFY row_number() OVER (PARTITION BY b.page_id, block_id ORDER BY abs(m - center_y), m) = 1),
px AS (SELECT b.page_id, block_id, c FROM b JOIN xc USING (page_id) QUALIFY row_number() OVER (PARTITION BY b.page_id, block_id ORDER BY abs(m - center_x), m) = 1),
rw AS (SELECT yc.page_id, yc.c, count(DISTINCT px.c) AS used FROM yc LEFT JOIN py ON py.page_id = yc.page_id AND py.c = yc.c LEFT JOIN px ON px.page_id = py.page_id AND px.block_id = py.block_id GROUP BY 1, 2),
st AS (SELECT page_id, count(*) AS n_rows, greatest(0.0, 1 - stddev_pop(used) / greatest(avg(used), 1.0)) AS row_stab FROM rw GROUP BY 1),
al AS (SELECT st.*, (SELECT count(*) FROM xc WHERE xc.page_id = st.page_id) AS n_cols, (SELECT count(*) FROM b WHERE b.page_id = st.page_id) AS n FROM st),
z AS (SELECT *, CASE WHEN n < 3 THEN 'too few text boxes' WHEN n_rows < 3 THEN 'too few rows' WHEN n_cols < 2 THEN 'too few columns (not tabular)' WHEN n_cols > 12 THEN 'ultra-dense matrix' WHEN row_stab < 0.55 THEN 'irregular layout (flowchart?)' ELSE 'regular ruled table' END AS reason FROM al)
SELECT page_id, n_rows, n_cols, row_stab, reason, reason = 'regular ruled table' AS applicable FROM z""")
def table_applicability(spark, sf):
    return geometry.applicability(boxes(spark, sf), ["page_id"])


@query(f"""
WITH {FIT}, e AS (SELECT page_id, 'row' AS axis, c, min(center_y) AS low, max(center_y) AS high FROM yr GROUP BY 1, 2, 3 UNION ALL SELECT page_id, 'column', c, min(center_x), max(center_x) FROM xr GROUP BY 1, 2, 3),
l AS (SELECT page_id, axis, trunc((high + lead(low) OVER (PARTITION BY page_id, axis ORDER BY c)) / 2)::INT AS line FROM e) SELECT * FROM l WHERE line IS NOT NULL""")
def virtual_grid_lines(spark, sf):
    return geometry.grid_lines(boxes(spark, sf), ["page_id"])


@query("""
WITH s AS (SELECT o_orderkey AS page_id, (o_custkey % 100) / 100.0::DOUBLE AS s_b, (o_orderkey % 100) / 100.0::DOUBLE AS s_e FROM orders)
SELECT page_id, CASE WHEN s_b < 0.55 AND s_e - s_b >= 0.30 AND s_e >= 0.90 THEN 'adopt' ELSE 'compare' END AS verdict FROM s""")
def adopt_gate(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("page_id"), gates.adopt_verdict((F.col("o_custkey") % 100) / 100.0, (F.col("o_orderkey") % 100) / 100.0).alias("verdict"))


FOLD1 = """
{n}o AS (SELECT page_id, {v} AS v, row_number() OVER (PARTITION BY page_id ORDER BY {v}) AS k FROM b), {n}t AS (SELECT page_id, greatest(list_sort(list({s}))[count(*) // 2 + 1] * {f}, {m}) AS t FROM b GROUP BY 1),
{n}f AS (SELECT page_id, k, 0 AS c, v AS s, 1 AS n FROM {n}o WHERE k = 1 UNION ALL SELECT o.page_id, o.k, CASE WHEN abs(o.v - f.s / f.n) <= t.t THEN f.c ELSE f.c + 1 END, CASE WHEN abs(o.v - f.s / f.n) <= t.t THEN f.s + o.v ELSE o.v END, CASE WHEN abs(o.v - f.s / f.n) <= t.t THEN f.n + 1 ELSE 1 END FROM {n}f f JOIN {n}o o ON o.page_id = f.page_id AND o.k = f.k + 1 JOIN {n}t t ON t.page_id = f.page_id),
{n}g AS (SELECT page_id, c, count(*) AS n FROM {n}f GROUP BY 1, 2), {n}h AS (SELECT page_id, count(*) AS groups, count(*) FILTER (n >= 2) AS multi FROM {n}g GROUP BY 1)"""


@query(f"""
WITH RECURSIVE {BOXES}, {FOLD1.format(n="y", v="center_y", s="height", f=0.7, m="8.0")}, {FOLD1.format(n="x", v="center_x", s="width", f=0.5, m="12.0")},
a AS (SELECT page_id, count(*) AS n, var_pop(width * height) AS v, avg(width * height) AS m, bool_or(length(translate(text, '{X.MATH_SIGNS}', '')) < length(text)) AS has_math FROM b GROUP BY 1),
z AS (SELECT a.page_id, a.n, has_math, a.n >= 4 AND yh.groups >= 2 AND xh.groups >= 2 AND yh.multi >= 2 AND xh.multi >= 2 AND a.n / (yh.groups * xh.groups)::DOUBLE >= 0.35 AS is_grid, a.n >= 6 AND v > m * 0.5 AS is_complex FROM a JOIN yh USING (page_id) JOIN xh USING (page_id)),
k AS (SELECT *, CASE WHEN is_grid THEN CASE WHEN is_complex THEN 'complex_table' ELSE 'simple_table' END WHEN has_math THEN 'math_special' ELSE 'pure_text' END AS content_type FROM z)
SELECT *, CASE WHEN content_type = 'complex_table' THEN 'mineru' ELSE 'paddleocr_vl' END AS engine FROM k""")
def content_routing(spark, sf):
    return geometry.content_features(boxes(spark, sf)).withColumn("engine", geometry.engine_for(F.col("content_type")))


BUILT = f"""{ROWS}, g AS (SELECT page_id, row_no, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT page_id, n, count(*) AS k FROM g GROUP BY 1, 2),
mo AS (SELECT page_id, sum(k) AS multi, arg_max(n, k * 1000 - n) AS mode FROM k GROUP BY 1), ok AS (SELECT g.page_id, g.row_no, mode, multi FROM g JOIN mo USING (page_id) WHERE abs(n - mode) <= 1),
pg AS (SELECT page_id FROM ok GROUP BY page_id HAVING any_value(multi) >= 3 AND any_value(mode) >= 3 AND count(*) >= 3 AND count(*) / any_value(multi) >= 0.6)"""


#: The boxes of each page on three lines.
DENSE = BOXES.replace("((l_partkey * 7) % 400)::DOUBLE", "((l_partkey % 3) * 40 + 30)::DOUBLE")


@query(f"WITH RECURSIVE {BUILT.replace(BOXES, DENSE)} SELECT r.page_id, r.row_no, count(*) AS n FROM r JOIN ok USING (page_id, row_no) JOIN pg USING (page_id) GROUP BY 1, 2")
def built_table_rows(spark, sf):
    return geometry.built_tables(_dense(spark, sf)).groupBy("page_id", "row_no").agg(F.count("*").alias("n"))



@query(f"WITH RECURSIVE {BUILT.replace(BOXES, DENSE)}, t AS (SELECT r.* FROM r JOIN ok USING (page_id, row_no) JOIN pg USING (page_id)) SELECT page_id, greatest(trunc(greatest(min(min_x), 0)) - 8, 0)::INT AS x, greatest(trunc(greatest(min(min_y), 0)) - 8, 0)::INT AS y, greatest(trunc(max(max_x)) - trunc(greatest(min(min_x), 0)), 1)::INT + 16 AS w, greatest(trunc(max(max_y)) - trunc(greatest(min(min_y), 0)), 1)::INT + 16 AS h FROM t GROUP BY 1")
def table_regions(spark, sf):
    return geometry.table_regions(geometry.built_tables(_dense(spark, sf)))


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    """The same boxes on three lines a page, so that grids come up."""
    i = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    cx, cy = (F.col("l_suppkey") * 13 % 600).cast("double"), (F.col("l_partkey") % 3 * 40 + 30).cast("double")
    width, height = F.col("l_quantity") + 10.0, F.col("l_linenumber") + 12.0
    return i.select(F.col("l_orderkey").alias("page_id"), (F.row_number().over(w) - 1).cast("long").alias("block_id"), F.lit("text").alias("type"), F.concat("l_returnflag", "l_linenumber").alias("text"), cx.alias("center_x"), cy.alias("center_y"), width.alias("width"), height.alias("height"), (cx - width / 2).alias("min_x"), (cx + width / 2).alias("max_x"), (cy - height / 2).alias("min_y"), (cy + height / 2).alias("max_y"))


# Tables and notes.

CELLS = "cells AS (SELECT doc_id // 10 AS page_id, (doc_id % 10)::INT AS row_no, coalesce(source, 'none') AS name, doc_id FROM documents)"


def source_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A table of each ten documents: their sources, and their ids between signs that HTML and Markdown escape."""
    d = table(spark, sf, "documents")
    cell = F.posexplode(F.array(F.coalesce("source", F.lit("none")), F.concat(F.lit("<"), F.col("doc_id"), F.lit("|&"))))
    return d.select(F.expr("doc_id div 10").alias("page_id"), (F.col("doc_id") % 10).cast("int").alias("row_no"), cell.alias("place", "text"))


HTML = "html AS (SELECT page_id, '<table border=\"1\" style=\"border-collapse: collapse;\">' || string_agg('<tr><td bgcolor=\"#ffffff\">' || name || '</td><td>&lt;' || doc_id || '|&amp;</td></tr>', '' ORDER BY row_no) || '</table>' AS html FROM cells GROUP BY 1)"


def source_html(spark: SparkSession, sf: str) -> DataFrame:
    grids = table(spark, sf, "documents").select(F.expr("doc_id div 10").alias("page_id")).distinct().withColumn("grid", F.array_repeat(F.array(F.lit("#ffffff")), 30))
    return render.html_tables(render.colored_cells(source_cells(spark, sf), grids))


@query(f"WITH {CELLS}, {HTML} SELECT * FROM html")
def html_tables(spark, sf):
    return source_html(spark, sf)


@query(f"WITH {CELLS} SELECT page_id, row_no, 0 AS col, name AS text FROM cells UNION ALL SELECT page_id, row_no, 1, '<' || doc_id || '|&' FROM cells")
def html_roundtrip(spark, sf):
    return render.html_cells(source_html(spark, sf))


PIPES = "md AS (SELECT page_id, string_agg('| ' || name || ' | <' || doc_id || chr(92) || '|& |' || CASE WHEN row_no = 0 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY row_no) AS markdown FROM cells GROUP BY 1 HAVING count(*) >= 2)"


@query(f"WITH {CELLS}, {PIPES} SELECT * FROM md")
def markdown_tables(spark, sf):
    c = source_cells(spark, sf)
    return render.pipe_tables(c.select("page_id", "row_no", F.col("place").alias("col"), F.lit(2).alias("n_cols"), "text", F.col("place").cast("double").alias("center_x"), F.col("place").alias("block_id")))


@query(f"WITH {CELLS}, {PIPES} SELECT * FROM md")
def html_to_markdown(spark, sf):
    return source_html(spark, sf).select("page_id", render.html_to_markdown(F.col("html")).alias("markdown"))


@query("""
WITH md AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, list_transform(l, lambda x: len(string_split(x, ' '))) AS c, l FROM md),
s AS (SELECT doc_id, c, len(c) AS n, list_sum(c)::DOUBLE AS total, list_max(c) AS cols FROM r),
v AS (SELECT *, total / n AS mean, sqrt(list_sum(list_transform(c, lambda x: (x - total / n) ** 2)) / n) AS dev FROM s WHERE n > 0)
SELECT doc_id, 0.45 * 1.0 + 0.35 * greatest(0.0, 1 - dev / greatest(mean, 1.0)) + 0.20 * least(1.0, n * cols / 12.0::DOUBLE) AS score FROM v""")
def structure_scores(spark, sf):
    rows = F.transform(F.split("text", "\n"), lambda x: F.transform(F.split(x, " "), lambda c: F.concat(F.lit("c"), c)))
    return table(spark, sf, "documents").select("doc_id", rows.alias("rows")).where(F.size("rows") > 0).select("doc_id", gates.table_structure(F.col("rows")).alias("score"))


@query("""SELECT doc_id AS k, CASE WHEN doc_id % 2 = 0 THEN 0.45 + 0.35 + 0.20 * least(1.0, 6 / 12.0)
  WHEN length(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g')) >= 40 THEN 0.55 ELSE 0.0 END AS score FROM documents""")
def markdown_structure(spark, sf):
    """Even documents stand in a table by their source, odd ones as they are, without pipes."""
    d = table(spark, sf, "documents")
    grid = F.concat(F.lit("| a | b |\n|---|:-:|\n| "), F.coalesce("source", F.lit("none")), F.lit(" | x |\n  | c | d |  "))
    md = F.when(F.col("doc_id") % 2 == 0, grid).otherwise(F.translate("text", "|", "!"))
    return d.select(F.col("doc_id").alias("k"), gates.markdown_structure(md).alias("score"))


@query("SELECT doc_id AS image, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, (length(text) - length(replace(text, 'the', ''))) // 3 AS hits FROM documents")
def snapshot_metrics(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("image"), "text")
    m = snapshots.note_metrics(d, "image", "text").join(d, "image")
    return m.select("image", "chars", "lines", X.occurrences(F.col("text"), F.lit("the")).alias("hits"))


CHANGED = """
o AS (SELECT doc_id AS image, 'date: 1' || chr(10) || text AS old FROM documents WHERE doc_id % 10 <> 1), n AS (SELECT doc_id AS image, 'date: 2' || chr(10) || CASE WHEN doc_id % 10 = 2 THEN text || 'x' ELSE text END AS new FROM documents WHERE doc_id % 10 <> 3),
s AS (SELECT image, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN substr(old, 8) = substr(new, 8) THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n USING (image))"""


def _compared(spark, sf):
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("image"), F.concat(F.lit("date: 1\n"), "text").alias("markdown"))
    new = d.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("image"), F.concat(F.lit("date: 2\n"), "text", F.when(F.col("doc_id") % 10 == 2, "x").otherwise("")).alias("markdown"))
    return snapshots.compare(old, new)


@query(f"WITH {CHANGED} SELECT * FROM s")
def snapshot_compare(spark, sf):
    return _compared(spark, sf).select("image", "state")


@query(f"WITH {CHANGED} SELECT state, count(*) AS n FROM s GROUP BY 1")
def snapshot_summary(spark, sf):
    return snapshots.summary(_compared(spark, sf))


@query("""
WITH l AS (SELECT doc_id AS image, text, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 10 = 2),
n AS (SELECT *, len(l) AS n FROM l)
SELECT image, '--- ' || chr(10) || '+++ ' || chr(10) || CASE WHEN text = '' THEN '@@ -0,0 +1 @@' || chr(10) || '+x'
  WHEN n = 1 THEN '@@ -1 +1 @@' || chr(10) || '-' || l[1] || chr(10) || '+' || l[1] || 'x'
  ELSE '@@ -' || (n - 1) || ',2 +' || (n - 1) || ',2 @@' || chr(10) || ' ' || l[n - 1] || chr(10) || '-' || l[n] || chr(10) || '+' || l[n] || 'x' END AS diff FROM n""")
def snapshot_diffs(spark, sf):
    return snapshots.diffs(_compared(spark, sf))


@query("""
WITH c AS (SELECT doc_id // 10 AS page_id, doc_id AS table_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS cell FROM documents),
b AS (SELECT DISTINCT page_id, cell, 1 AS hit FROM c WHERE table_id % 2 = 1),
k AS (SELECT table_id, count(*) AS n, count(hit) AS k FROM c LEFT JOIN b USING (page_id, cell) WHERE table_id % 2 = 0 GROUP BY 1)
SELECT doc_id // 10 AS page_id, doc_id AS table_id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT table_id FROM k WHERE n >= 3 AND k / n >= 0.6)""")
def body_duplicate_tables(spark, sf):
    """Of each ten documents the even ones are tables of words, the odd ones the body; a table goes if the body repeats most of it."""
    d = table(spark, sf, "documents").withColumn("page_id", F.expr("doc_id div 10"))
    words = d.select("page_id", F.col("doc_id").alias("table_id"), F.explode(X.tokens(F.col("text"))).alias("cell"))
    body = words.where("table_id % 2 = 1").select("page_id", F.lit("text").alias("type"), F.col("cell").alias("text"))
    return gates.drop_body_duplicates(d.where("doc_id % 2 = 0").select("page_id", F.col("doc_id").alias("table_id")), words.where("table_id % 2 = 0"), body)


@query("SELECT token, n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS token, 1 AS n FROM documents) INTERSECT ALL SELECT token, n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS token, 1 AS n FROM benchmark)")
def shared_tokens_multiset(spark, sf):
    one = lambda d: d.select(F.explode(X.tokens(F.col("text"))).alias("token"), F.lit(1).alias("n"))
    return one(table(spark, sf, "documents")).intersectAll(one(table(spark, sf, "benchmark")))


def _pages(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("raw/scan-"), "o_orderkey", F.lit(".png")).alias("source_path"), F.lit(0.9).alias("confidence"))
