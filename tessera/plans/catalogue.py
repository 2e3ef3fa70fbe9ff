"""The registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express it.

What stands for what: ``documents`` are indexed texts (chunks of one document each; heading: source), ``benchmark`` items are
questions, ``embeddings`` chunk vectors (document: label), ``conversations`` turn logs, ``events`` state writes, ``customer`` characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.backends import embed
from tessera.functions import dates as D
from tessera.functions import text as T
from tessera.operators import blocks, cells, chunking, context, evaluate, index, postings, recall, retrieval, segments, turns
from tessera.operators.scratch import shared_folder, written
from tessera.sources import loaders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def trim(x: str) -> str:
    return f"trim({x}, {BLANK})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


# -- sources ---------------------------------------------------------------------------------------------------------

_EXT = "lower(regexp_extract(url, '[^/.][^/]*?(\\.[^./]*)$', 1))"


@query("listing_filter", f"""
SELECT page_id, CASE
  WHEN len(list_filter(string_split(url, '/'), lambda p: p IN ({", ".join(f"'{x}'" for x in loaders.IGNORED)}) OR starts_with(p, '~$'))) > 0 THEN 'ignored'
  WHEN {_EXT} NOT IN ({", ".join(f"'{x}'" for x in (*loaders.TEXT_EXTENSIONS, *loaders.DOCUMENT_EXTENSIONS))}) THEN 'unsupported'
  WHEN length(html) > 20000 THEN 'oversize' ELSE 'ok' END AS status, {_EXT} AS ext
FROM pages""")
def listing_filter(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", loaders.listing_status(F.col("url"), F.length("html"), most=20_000).alias("status"), loaders.extension(F.col("url")).alias("ext"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", index.content_hash(F.col("text")).alias("sha"))


@query("csv_blocks", """
WITH l AS (SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n,
  concat_ws(' | ', c_custkey::VARCHAR, c_name, c_mktsegment) AS line FROM customer)
SELECT file, ((n - 1) // 40)::INT AS block, 'c_custkey | c_name | c_mktsegment' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS text FROM l GROUP BY ALL""")
def csv_blocks(spark, sf):
    return loaders.csv_blocks(table(spark, sf, "customer"), "c_nationkey", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"])


def _collapse_sql(x: str) -> str:
    one = f"regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return trim(f"array_to_string(list_transform(string_split({one}, chr(10)), lambda l: {trim('l')}), chr(10))")


@query("markup_to_text", f"""
SELECT page_id, {_collapse_sql("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>|</p>|</div>|</li>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")} AS text
FROM pages""")
def markup_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.markup_to_text(F.col("html")).alias("text"))


@query("collapse", f"SELECT conv_id, turn, {_collapse_sql('text')} AS text FROM conversations")
def collapse(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.collapse(F.col("text")).alias("text"))


@query("document_title", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:12]) AS raw, generate_subscripts(string_split(text, chr(10))[1:12], 1) AS i FROM documents),
b AS (SELECT doc_id, i, {trim('raw')} AS line, {trim("regexp_replace(" + trim('raw') + ", '^#+', '')")} AS bare FROM l),
f AS (SELECT doc_id, i, CASE WHEN starts_with(line, '#') AND length(bare) BETWEEN 3 AND 120 THEN bare
  WHEN length(line) BETWEEN 8 AND 90 AND regexp_matches(line, '^[A-Z]') AND NOT ends_with(line, '.') THEN line END AS t FROM b),
p AS (SELECT doc_id, arg_min(t, i) FILTER (t IS NOT NULL) AS t FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(t, replace(replace('doc_' || source || '-' || doc_id, '_', ' '), '-', ' ')) AS title FROM documents JOIN p USING (doc_id)""")
def document_title(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.title(F.col("text"), F.concat(F.lit("doc_"), "source", F.lit("-"), F.col("doc_id").cast("string"))).alias("title"))


_FLAT = "array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || json_extract_string(props, k)), chr(10))"


def _parsed(files: DataFrame, key: str) -> DataFrame:
    """(key, text) of files (key, path, content) as their loader reads them; texts of several blocks are joined."""
    paths = files.select(key, "path").alias("f")
    return loaders.load_files(files.select("path", "content")).join(paths, "path").select(key, F.array_join(F.col("blocks.text"), "\n~\n").alias("text"))


def _file(folder: str, id_: str, suffix: str):
    return F.concat(F.lit(f"/{folder}/"), F.col(id_).cast("string"), F.lit(suffix)).alias("path")


@query("json_flatten", f"SELECT event_id, {_FLAT} AS text FROM events")
def json_flatten(spark, sf):
    """The events' props as JSON files: a line for each value."""
    return _parsed(table(spark, sf, "events").select("event_id", _file("e", "event_id", ".json"), F.encode("props", "UTF-8").alias("content")), "event_id")


@query("json_lines", f"""
SELECT user_id, array_to_string(list(l ORDER BY event_id), chr(10) || chr(10)) AS text FROM (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN props || ' broken' ELSE {_FLAT} END AS l FROM events) GROUP BY user_id""")
def json_lines(spark, sf):
    """Each user's events as a file of JSON lines, some of them broken: these stay as they are."""
    line = F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit(" broken"))).otherwise(F.col("props"))
    lines = F.array_sort(F.collect_list(F.struct("event_id", line.alias("l"))))
    files = table(spark, sf, "events").groupBy("user_id").agg(F.encode(F.array_join(lines["l"], "\n"), "UTF-8").alias("content"))
    return _parsed(files.select("user_id", _file("u", "user_id", ".jsonl"), "content"), "user_id")


@query("text_files", "SELECT doc_id, text FROM documents WHERE lang <> 'en'")
def text_files(spark, sf):
    """Texts in Western European letters as files in one of two encodings, decoded again."""
    d = table(spark, sf, "documents").where("lang <> 'en'")
    bytes_ = F.when(F.col("lang") == "de", F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return _parsed(d.select("doc_id", _file("t", "doc_id", ".txt"), bytes_.alias("content")), "doc_id")


@query("document_stream", "SELECT conv_id, turn, role, text FROM conversations")
def document_stream(spark, sf):
    """Turns as lines of text files, which arrive as a stream of documents a few files at a time."""
    root = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    kinds = "conv_id bigint, turn bigint, role string, text string"
    lines = table(spark, sf, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")))
    lines.write.option("maxRecordsPerFile", 10_000).text(f"{root}/in")
    found = loaders.documents(spark, f"{root}/in", stream=True).writeStream.format("parquet").option("path", f"{root}/out")
    found.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    each = spark.read.parquet(f"{root}/out").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return each.select(F.from_json("line", kinds).alias("t")).select("t.conv_id", "t.turn", "t.role", "t.text")


@query("csv_files", """
WITH l AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, c_custkey || ' | ' || c_name || ', ' || c_mktsegment AS line FROM customer),
b AS (SELECT c_nationkey, (n - 1) // 40 AS block, 'key | name' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS t FROM l GROUP BY ALL)
SELECT c_nationkey, string_agg(t, chr(10) || '~' || chr(10) ORDER BY block) AS text FROM b GROUP BY c_nationkey""")
def csv_files(spark, sf):
    """Customers of each nation as a CSV file with quoted commas, in blocks of 40 rows under the header."""
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(", "), "c_mktsegment", F.lit('"'))
    lines = F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l"))))
    files = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.encode(F.concat(F.lit("key,name\n"), F.array_join(lines["l"], "\n")), "UTF-8").alias("content"))
    return _parsed(files.select("c_nationkey", _file("n", "c_nationkey", ".csv"), "content"), "c_nationkey")


# -- projections -----------------------------------------------------------------------------------------------------

_MARKDOWN = "'# Conversation ' || conv_id || chr(10) || '## ' || role || chr(10) || text || chr(10) || chr(10) || 'End of turn.'"
_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({_MARKDOWN}, '(?m)^([ \\t]*#{{1,6}}[ \\t]+\\S.*)$', chr(10) || chr(10) || '\\1' || chr(10) || chr(10), 'g'), '\\n\\s*\\n'), lambda p: {trim('p')}), lambda p: p <> '')"


def _markdown(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    body = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n## "), "role", F.lit("\n"), "text", F.lit("\n\nEnd of turn."))
    return c.select("conv_id", "turn", F.posexplode(T.paragraphs(body)).alias("i", "paragraph"))


@query("paragraphs", f"""
SELECT conv_id, turn, (generate_subscripts({_PARAGRAPHS}, 1) - 1)::INT AS i, unnest({_PARAGRAPHS}) AS paragraph FROM conversations""")
def paragraphs(spark, sf):
    return _markdown(spark, sf)


@query("headings", f"""
WITH p AS (SELECT conv_id, turn, generate_subscripts({_PARAGRAPHS}, 1) - 1 AS i, unnest({_PARAGRAPHS}) AS paragraph FROM conversations)
SELECT conv_id, turn, i::INT AS i, length(regexp_extract(paragraph, '^(#{{1,6}})\\s+(.*\\S)\\s*$', 1))::INT AS level, regexp_extract(paragraph, '^(#{{1,6}})\\s+(.*\\S)\\s*$', 2) AS heading FROM p""")
def headings(spark, sf):
    return _markdown(spark, sf).select("conv_id", "turn", "i", T.heading_level(F.col("paragraph")).alias("level"), T.heading_text(F.col("paragraph")).alias("heading"))


@query("breadcrumbs", """
WITH h AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, role || ' ' || turn AS t FROM conversations),
p AS (SELECT conv_id, turn, level, t, max(CASE WHEN level = 1 THEN turn END) OVER w AS p1, max(CASE WHEN level = 2 THEN turn END) OVER w AS p2, max(CASE WHEN level = 3 THEN turn END) OVER w AS p3
  FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT p.conv_id, 'Body of ' || p.turn || '.' AS text, concat_ws(' > ', a.t, b.t, c.t) AS trail FROM p
LEFT JOIN h a ON a.conv_id = p.conv_id AND a.turn = p.p1
LEFT JOIN h b ON b.conv_id = p.conv_id AND b.turn = p.p2 AND p.p2 > coalesce(p.p1, -1)
LEFT JOIN h c ON c.conv_id = p.conv_id AND c.turn = p.p3 AND p.p3 > greatest(coalesce(p.p1, -1), coalesce(p.p2, -1))""")
def breadcrumbs(spark, sf):
    """Conversations as documents with headings of three levels, a sentence under each: the chunker's trails."""
    c = table(spark, sf, "conversations")
    marks = F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "## ").otherwise("### ")
    turn = F.col("turn").cast("string")
    part = F.concat(marks, "role", F.lit(" "), turn, F.lit("\nBody of "), turn, F.lit("."))
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("l"))
    blocks = F.array(F.struct(F.array_join("l.p", "\n").alias("text"), F.lit(None).cast("int").alias("page")))
    cut = chunking.chunk_documents(docs.select(F.col("conv_id").alias("doc_id"), blocks.alias("blocks")), least=0)
    return cut.select(F.col("doc_id").alias("conv_id"), "text", F.col("heading").alias("trail"))


_SENTENCES = "string_split(regexp_replace(text, '([.!?])\\s+([A-Z\"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@query("sentences", f"SELECT doc_id, len({_SENTENCES})::INT AS n, md5(array_to_string({_SENTENCES}, '|')) AS digest FROM documents")
def sentences(spark, sf):
    s = T.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query("overlap_tail", f"""
WITH t AS (SELECT doc_id, text, right(text, 300) AS last, regexp_replace(right(text, 300), '([.!?])\\s+([A-Z"''(\\[])', '\\1' || chr(1) || '\\2') AS cut FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN '' WHEN instr(cut, chr(1)) > 0 THEN {trim("substr(cut, instr(cut, chr(1)) + 1)")} ELSE {trim('last')} END AS tail FROM t""")
def overlap_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tail(F.col("text"), 300).alias("tail"))


_PARTS = "list_filter(string_split(heading, ' > '), lambda p: p <> '')"
_STRIPPED = f"array_to_string(CASE WHEN lower({_PARTS}[1]) = lower(title) THEN {_PARTS}[2:] ELSE {_PARTS} END, ' > ')"
_HEADED = "SELECT c_custkey, c_mktsegment AS title, CASE WHEN c_acctbal > 0 THEN c_mktsegment || ' > ' || c_name ELSE c_name || ' > ' || c_mktsegment END AS heading FROM customer"


def _headed(spark, sf) -> DataFrame:
    both = F.when(F.col("c_acctbal") > 0, F.concat_ws(" > ", "c_mktsegment", "c_name")).otherwise(F.concat_ws(" > ", "c_name", "c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("title"), both.alias("heading"))


@query("strip_title", f"SELECT c_custkey, {_STRIPPED} AS section FROM ({_HEADED})")
def strip_title(spark, sf):
    return _headed(spark, sf).select("c_custkey", T.strip_title(F.col("title"), F.col("heading")).alias("section"))


@query("trail", f"SELECT c_custkey, concat_ws(' > ', nullif(title, ''), nullif({_STRIPPED}, '')) AS trail FROM ({_HEADED})")
def trail(spark, sf):
    return _headed(spark, sf).select("c_custkey", T.trail(F.col("title"), F.col("heading")).alias("trail"))


@query("rerank_text", """
SELECT doc_id, concat_ws(' > ', source, lang) || chr(10) || substr(text, 1, 2000) AS rerank_text, concat_ws(' > ', source, lang) || chr(10) || chr(10) || text AS embed_text FROM documents""")
def rerank_text(spark, sf):
    d = table(spark, sf, "documents")
    args = F.col("source"), F.concat_ws(" > ", "source", "lang"), F.col("text")
    return d.select("doc_id", T.rerank_text(*args).alias("rerank_text"), T.embed_text(*args).alias("embed_text"))


@query("citation", f"""
SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN title ELSE lower(title) || '.md' END || CASE WHEN c_nationkey > 0 THEN ' p.' || c_nationkey ELSE '' END ||
  CASE WHEN {_STRIPPED} <> '' THEN ' — ' || {_STRIPPED} ELSE '' END AS label
FROM ({_HEADED}) JOIN (SELECT c_custkey, c_nationkey FROM customer) USING (c_custkey)""")
def citation(spark, sf):
    h = _headed(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    path = F.when(F.col("c_nationkey") < 12, F.concat(F.lit("memory://"), "title")).otherwise(F.concat(F.lit("/docs/"), F.lower("title"), F.lit(".md")))
    return h.select("c_custkey", T.citation(path, F.col("title"), F.col("c_nationkey"), F.col("heading")).alias("label"))


@query("strip_thinking", f"""
SELECT conv_id, turn, {trim("regexp_replace(regexp_replace(said, '(?is)<think>.*?</think>', '', 'g'), '(?is)^\\s*<think>.*$', '')")} AS said
FROM (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN '<think>' || role || chr(10) || '</think> ' || text WHEN 'user' THEN ' <THINK>' || text ELSE text END AS said FROM conversations)""")
def strip_thinking(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>"), "role", F.lit("\n</think> "), "text")).when(F.col("role") == "user", F.concat(F.lit(" <THINK>"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.strip_thinking(said).alias("said"))


# -- filters ---------------------------------------------------------------------------------------------------------

_STORED = "SELECT doc_id, n_chars AS bytes, CASE WHEN lang = 'fr' THEN 5.0 ELSE 1.0 END AS mtime, sha256(CASE WHEN lang = 'de' THEN 'old' ELSE text END) AS sha, CASE WHEN lang = 'es' THEN 0 ELSE 1 END AS n FROM documents"


@query("scan_status", f"""
SELECT d.doc_id, CASE WHEN n > 0 AND bytes = n_chars + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AND abs(mtime - 1.0) < 1e-6 THEN 'unchanged'
  WHEN n > 0 AND sha = sha256(text) THEN 'touched' ELSE 'parse' END AS status FROM documents d JOIN ({_STORED}) s USING (doc_id)""")
def scan_status(spark, sf):
    d = table(spark, sf, "documents")
    is_ = lambda x: F.col("lang") == x
    stored = d.select(
        "doc_id", F.col("n_chars").alias("bytes"), F.when(is_("fr"), 5.0).otherwise(1.0).alias("mtime"), F.sha2(F.when(is_("de"), "old").otherwise(F.col("text")), 256).alias("sha256"),
        F.when(is_("es"), 0).otherwise(1).alias("n_chunks"),
    ).alias("stored")
    files = d.select("doc_id", (F.col("n_chars") + F.when(is_("de"), 1).otherwise(0)).alias("size"), F.lit(1.0).alias("time"), F.sha2("text", 256).alias("sha"))
    both = files.join(stored, "doc_id", "left")
    return both.select("doc_id", index.change_status(F.col("size"), F.col("time"), F.col("sha")).alias("status"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def terms_sql(x: str) -> str:
    tokens = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]+(?:[.\\-/][a-z0-9_]+)*'), lambda t: length(t) > 1)"
    kept = f"list_filter({tokens}, lambda t: t NOT IN ({_STOP}))"
    first = lambda l: f"list_transform(list_sort(list_transform(list_distinct({l}), lambda t: {{'i': list_position({l}, t), 't': t}})), lambda s: s.t)[1:{T.MAX_TERMS}]"
    return f"CASE WHEN len({kept}) > 0 THEN {first(kept)} ELSE {first(tokens)} END"


@query("query_terms", f"SELECT item_id, {terms_sql('text')} AS terms FROM benchmark")
def query_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.query_terms(F.col("text")).alias("terms"))


@query("relevance_floor", """
SELECT query_id, chunk_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS first FROM (
  SELECT label AS query_id, vec_id AS chunk_id, round(10 * embedding[1]::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS rank FROM embeddings))
WHERE first = 1 OR (score >= best - 2 AND score >= 1.5)""")
def relevance_floor(spark, sf):
    e = table(spark, sf, "embeddings")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    hits = e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.round(10 * F.element_at("embedding", 1).cast("double"), 6).alias("score"), rank.alias("rank"))
    return retrieval.floor(hits, margin=2.0, minimum=1.5)


_ENTRIES = "SELECT role AS kind, turn, CASE WHEN conv_id > 20 THEN 'Day ' || conv_id ELSE '' END AS w, conv_id, string_split(text, '. ') AS texts FROM conversations"


def _entries(spark, sf) -> DataFrame:
    """Turns as lists of memories: the system's are lore, the user's facts, the assistant's summaries."""
    kind = F.when(F.col("role") == "system", "lore").when(F.col("role") == "user", "fact").when(F.col("role") == "assistant", "summary").otherwise("other")
    c = table(spark, sf, "conversations")
    return c.select("conv_id", kind.alias("kind"), "turn", F.when(F.col("conv_id") > 20, F.concat(F.lit("Day "), F.col("conv_id").cast("string"))).otherwise("").alias("when"), F.split("text", r"\. ").alias("texts"))


_MEMORIES = f"""
WITH e AS (SELECT conv_id, turn, w, CASE kind WHEN 'system' THEN 'lore' WHEN 'user' THEN 'fact' WHEN 'assistant' THEN 'summary' ELSE 'other' END AS kind,
  unnest(texts) AS raw, generate_subscripts(texts, 1) - 1 AS i FROM ({_ENTRIES})),
m AS (SELECT *, array_to_string({words('raw')}, ' ') AS text FROM e)
SELECT conv_id, format('memory://{{}}/{{:05d}}/{{:02d}}', kind, turn, i) AS path, CASE WHEN kind = 'lore' THEN 'Lore' ELSE 'Turn ' || turn END AS title,
  CASE WHEN w = '' THEN kind ELSE w || ' > ' || kind END AS heading, kind, turn, text FROM m WHERE length(text) >= 12 AND kind <> 'other'"""


@query("memory_rows", _MEMORIES)
def memory_rows(spark, sf):
    return turns.memories(_entries(spark, sf), "conv_id")


@query("memory_counts", f"SELECT kind, count(*) AS n FROM ({_MEMORIES}) GROUP BY kind")
def memory_counts(spark, sf):
    return turns.memory_counts(turns.memories(_entries(spark, sf), "conv_id"))


@query("new_memories", f"""
SELECT DISTINCT ON (path) path, text FROM ({_MEMORIES}) WHERE conv_id = 1 AND path NOT IN (SELECT path FROM ({_MEMORIES}) WHERE kind = 'fact' AND conv_id = 1)""")
def new_memories(spark, sf):
    """One conversation's memories that its archive does not have yet."""
    one = _entries(spark, sf).where("conv_id = 1")
    return turns.new_memories(one, turns.memories(one).where("kind = 'fact'")).select("path", "text")


@query("fact_list", f"""
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: array_to_string({words('l')}, ' ')), lambda t: length(t) >= 8)[1:12] AS facts FROM documents""")
def fact_list(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.facts(F.split("text", "\n")).alias("facts"))


@query("slug_list", f"""
SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda s: replace(lower(array_to_string({words('s')}, ' ')), ' ', '_')), lambda s: regexp_full_match(s, '[a-z0-9_\\-]{{2,40}}'))[1:20] AS slugs FROM documents""")
def slug_list(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.slugs(F.split("text", " ")).alias("slugs"))


@query("chat_history", """
WITH h AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(list_filter(l[greatest(len(l) - 3, 1):], lambda m: m.role IN ('user', 'assistant') AND m.content <> ''), lambda m: m.role || ': ' || m.content), chr(10)) AS history FROM h""")
def chat_history(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("l"))
    kept = context.history(F.col("l"))
    return c.select("conv_id", F.array_join(F.transform(kept, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("history"))


@query("unarchived", "SELECT conv_id, turn AS n, text FROM conversations WHERE role <> 'assistant'")
def unarchived(spark, sf):
    log = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("n"), "text", F.when(F.col("role") != "system", F.col("role") == "assistant").alias("archived"))
    return turns.unarchived(log).select("conv_id", "n", "text")


@query("present_cast", """
SELECT c_nationkey, c_custkey AS slug, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'BUILDING') DESC, c_name)::INT AS place FROM customer WHERE c_acctbal > 0""")
def present_cast(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("present"), (F.col("c_mktsegment") == "BUILDING").alias("protagonist"))
    return turns.present(c, "c_nationkey").select("c_nationkey", "slug", "name", "place")


@query("forget", "SELECT page_id, url AS path FROM pages WHERE NOT starts_with(lower(url), 'http://www.')")
def forget(spark, sf):
    return index.forget(table(spark, sf, "pages").select("page_id", F.col("url").alias("path")), "http://www.")


@query("prune", """
SELECT page_id, url AS path FROM pages WHERE (url = 'https:' OR starts_with(url, 'https:/')) AND url NOT IN (SELECT url FROM pages WHERE length(html) > 3000)
  AND url NOT IN (SELECT url FROM pages WHERE ends_with(url, '.html'))""")
def prune(spark, sf):
    p = table(spark, sf, "pages")
    docs = p.select("page_id", F.col("url").alias("path"))
    seen, listing = p.where(F.length("html") > 3000).select(F.col("url").alias("path")), p.where(F.col("url").endswith(".html")).select(F.col("url").alias("path"))
    return index.prune(docs, seen, listing, ["https:"])


@query("last_turn", "SELECT conv_id, max(turn) AS n, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_turn(spark, sf):
    return turns.last_turn(table(spark, sf, "conversations").withColumn("n", F.col("turn")), ["conv_id"], "text")


# -- joins -----------------------------------------------------------------------------------------------------------


@query("hydrate", """
SELECT c.c_custkey AS chunk_id, n.n_nationkey::BIGINT AS doc_id, n.n_name AS title, c.c_name AS text, c.rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.rank <= 5""")
def hydrate(spark, sf):
    c = table(spark, sf, "customer")
    chunks = c.select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").cast("bigint").alias("doc_id"), F.col("c_name").alias("text"))
    best = retrieval.top(c, 5, ["c_nationkey"], F.desc("c_acctbal"), F.asc("c_custkey")).select(F.col("c_custkey").alias("chunk_id"), "rank")
    docs = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("doc_id"), F.col("n_name").alias("title"))
    return retrieval.hydrate(best, chunks, docs).select("chunk_id", "doc_id", "title", "text", "rank")


@query("neighbours", """
SELECT a.conv_id * 1000 + a.turn AS chunk_id, b.conv_id * 1000 + b.turn AS near_id, b.turn AS ord FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 2""")
def neighbours(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"))
    return retrieval.neighbours(c, c.select("chunk_id"), 1, 2)


@query("standing", """
SELECT o.o_orderkey AS other, o.o_totalprice AS closeness, c.c_name AS name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey""")
def standing(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"))
    ties = table(spark, sf, "orders").select(F.col("o_custkey").alias("other"), "o_orderkey", F.col("o_totalprice").alias("closeness"))
    return turns.standing(ties, known).select(F.col("o_orderkey").alias("other"), "closeness", "name")


@query("known_slugs", "SELECT o_orderkey, o_custkey AS slug FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def known_slugs(spark, sf):
    """Rows that name a character of the cast; others are dropped."""
    said = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("slug"))
    return turns.known(said, table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("slug"))).select("o_orderkey", "slug")


# -- retrieval -------------------------------------------------------------------------------------------------------


@query("normalise", """
SELECT vec_id, list_transform(v, lambda x: round(x / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6)) AS unit FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings)""")
def normalise(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    return table(spark, sf, "embeddings").select("vec_id", F.transform(retrieval.normalise(scaled), lambda x: T.rounded(x, 6)).alias("unit"))


_DENSE = """
SELECT query_id, chunk_id, score, rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id)::INT AS rank
  FROM embeddings q, embeddings c) WHERE rank <= {k}"""


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), F.col("label").cast("bigint").alias("doc_id")), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


@query("dense_topk", f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_DENSE.format(k=10)})")
def dense_topk(spark, sf):
    chunks, queries = _vectors(spark, sf)
    return retrieval.dense_search(chunks, queries, 10).withColumn("score", F.round("score", 6))


@query("dense_cells", f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_DENSE.format(k=10)})")
def dense_cells(spark, sf):
    """The same rows from vectors in cells, of which those beyond each query's threshold are passed over."""
    chunks, queries = _vectors(spark, sf)
    return cells.CellSearch(cells.build(chunks), queries, 10).found.withColumn("score", F.round("score", 6))


def _chunks(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("heading"), "text")


def _questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_TOKENS = "regexp_extract_all(translate(lower({x}), '" + T.ACCENTED + "', '" + T.PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"
_POSTED = f"""
t AS (SELECT doc_id AS chunk_id, 'text' AS field, {_TOKENS.format(x='text')} AS l FROM documents UNION ALL SELECT doc_id, 'heading', {_TOKENS.format(x='source')} FROM documents),
posted AS (SELECT chunk_id, field, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM t)"""
def hits_sql(questions: str, x: str = "") -> str:
    """hits{x}: (query_id, term, chunk_id, field, tf) of the terms of ``questions`` (query_id, query)."""
    return f"""
q{x} AS (SELECT query_id, unnest({terms_sql('query')}) AS term FROM ({questions})),
parts{x} AS (SELECT query_id, term, len({_TOKENS.format(x='term')}) AS m, unnest({_TOKENS.format(x='term')}) AS token, generate_subscripts({_TOKENS.format(x='term')}, 1) - 1 AS k FROM q{x}),
starts{x} AS (SELECT query_id, term, m, chunk_id, field, pos - k AS start, count(*) AS n FROM posted JOIN parts{x} USING (token) GROUP BY ALL),
hits{x} AS (SELECT query_id, term, chunk_id, field, count(*) AS tf FROM starts{x} WHERE n = m GROUP BY ALL)"""


def bm25_sql(x: str = "") -> str:
    """bm25{x}: (query_id, chunk_id, score, rank) from hits{x}."""
    return f"""
w{x} AS (SELECT query_id, term, chunk_id, sum(tf * CASE field WHEN 'heading' THEN 2 ELSE 1 END)::DOUBLE AS f FROM hits{x} GROUP BY ALL),
df{x} AS (SELECT term, count(DISTINCT chunk_id) AS df FROM w{x} GROUP BY ALL), len{x} AS (SELECT chunk_id, count(*) AS d FROM posted GROUP BY ALL),
c{x} AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM posted)::DOUBLE / (SELECT count(*) FROM documents) AS a),
s{x} AS (SELECT query_id, chunk_id, round(sum(CASE WHEN ln((n - df + .5) / (df + .5)) > 0 THEN ln((n - df + .5) / (df + .5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (.25 + .75 * d / a))), 9) AS score
  FROM w{x} JOIN df{x} USING (term) JOIN len{x} USING (chunk_id), c{x} GROUP BY ALL),
bm25{x} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s{x})"""


_ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark"
_HITS = f"{_POSTED},{hits_sql(_ASKED)}"
_BM25 = f"{_HITS},{bm25_sql()}"


@query("document_frequency", f"WITH {_POSTED} SELECT token, count(DISTINCT chunk_id) AS df, count(*) AS n FROM posted GROUP BY token")
def document_frequency(spark, sf):
    each = postings.entries(_chunks(spark, sf)).select("token", F.size("places").alias("n"))  # one row for each token of a chunk
    return each.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("n"))


@query("phrase_match", f"WITH {_HITS} SELECT query_id, term, chunk_id, field, tf FROM hits")
def phrase_match(spark, sf):
    return retrieval.phrase_hits(postings.prepared(_chunks(spark, sf), _questions(spark, sf)), _questions(spark, sf))


@query("bm25", f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 40")
def bm25(spark, sf):
    return retrieval.bm25_search(_chunks(spark, sf), _questions(spark, sf)).withColumn("score", F.round("score", 6))


@query("bm25_blocks", f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 40")
def bm25_blocks(spark, sf):
    """The same rows from blocks of postings, of which those below each question's threshold are passed over."""
    kept = blocks.Store.build(_chunks(spark, sf))
    return blocks.BlockSearch(kept, _questions(spark, sf)).found.withColumn("score", F.round("score", 6))


# documents as three commits leave them: all are written, then those in German with new wording, then those in French are deleted
_LIVE = """
live AS (SELECT doc_id + CASE WHEN lang = 'de' THEN 1000000000000 ELSE 0 END AS doc_id, source, text || CASE WHEN lang = 'de' THEN ' revised wording' ELSE '' END AS text FROM documents WHERE coalesce(lang, '') <> 'fr')"""
_LIVE_BM25 = f"{_LIVE},{_BM25.replace('FROM documents', 'FROM live')}"


def _segments(spark, sf) -> segments.Segments:
    """An index of the documents, made by three commits."""
    ix = segments.Segments(spark, f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}", T.index_tokens)
    d = table(spark, sf, "documents")
    for rows, gone in ((d, None), (d.where("lang = 'de'").withColumn("text", F.concat("text", F.lit(" revised wording"))), None), (d.limit(0), d.where("lang = 'fr'"))):
        version, meta = ix.manifest()
        stored = rows.select(
            "doc_id", F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("title"), F.lit(".md").alias("ext"), F.col("n_chars").cast("bigint").alias("bytes"),
            F.lit(0.0).alias("mtime"), F.lit("").alias("sha256"), F.lit(1).alias("n_chunks"),
        )
        cut = rows.select("doc_id", F.lit(0).alias("ord"), F.col("source").alias("heading"), F.lit(None).cast("int").alias("page"), "text", F.lit(None).cast("array<float>").alias("vec"), F.lit("").alias("embedded"))
        ix.commit(stored, cut, (rows if gone is None else gone).select("doc_id"), meta=meta, version=version)
    return ix


@query("segment_search", f"WITH {_LIVE_BM25} SELECT query_id, chunk_id % 1000000000000 AS doc_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 40")
def segment_search(spark, sf):
    """BM25 over the segments that the commits leave: the same as over the live documents in one table."""
    ix = _segments(spark, sf)
    hits = blocks.BlockSearch(ix.store(), _questions(spark, sf)).found
    return hits.join(ix.chunks().select("chunk_id", "doc_id"), "chunk_id").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("segment_documents", f"""
WITH {_LIVE}, n AS (SELECT count(*) AS n, sum(len({_TOKENS.format(x='text')}) + len({_TOKENS.format(x='source')}))::BIGINT AS t FROM live)
SELECT doc_id % 1000000000000 AS doc_id, md5(text) AS digest, n AS n_chunks, t AS n_tokens FROM live, n""")
def segment_documents(spark, sf):
    """The live documents after the commits, with the figures that the manifest keeps of the corpus."""
    ix = _segments(spark, sf)
    meta = ix.manifest()[1]
    both = ix.documents().select("doc_id").join(ix.chunks(digest=F.md5("text")).select("doc_id", "digest"), "doc_id")
    return both.select("doc_id", "digest", F.lit(meta["n_chunks"]).cast("bigint").alias("n_chunks"), F.lit(meta["n_tokens"]).cast("bigint").alias("n_tokens"))


_OVERLAP = f"""
o AS (SELECT query_id, chunk_id, count(DISTINCT term)::INT AS score FROM hits GROUP BY ALL),
ov AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM o)"""


def fused_sql(*lists: str) -> str:
    """fused: (query_id, chunk_id, score, rank) from selects of (query_id, chunk_id, l, rank, weight)."""
    return f"""
lists AS ({" UNION ALL ".join(lists)}),
g AS (SELECT query_id, chunk_id, list_sum(list_transform(list_sort(list({{'l': l, 'p': weight::DOUBLE / (60 + rank)}})), lambda v: v.p)) AS score, min({{'l': l, 'r': rank}}) AS first FROM lists GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first.l, first.r)::INT AS rank FROM g)"""


def list_sql(name: str, number: int, most: int = 40) -> str:
    return f"SELECT query_id, chunk_id, {number} AS l, rank, 1.0 AS weight FROM {name} WHERE rank <= {most}"


_FUSED = fused_sql(list_sql("ov", 0), list_sql("bm25", 1))
#: Questions and documents that have a vector: those whose number a row of the table of vectors has.
_NEAR = """
near AS (SELECT query_id, chunk_id, rank FROM (SELECT b.item_id AS query_id, c.vec_id AS chunk_id,
  row_number() OVER (PARTITION BY b.item_id ORDER BY list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id)::INT AS rank
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings c WHERE c.vec_id IN (SELECT doc_id FROM documents)) WHERE rank <= 40)"""
_HYBRID = fused_sql(list_sql("near", 0), list_sql("bm25", 1))


def _with_vectors(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as chunks, questions with the vectors of their numbers, and the vectors of the documents' numbers."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    source = F.regexp_extract("heading", "([0-9]+)", 1).cast("bigint")
    chunks = _chunks(spark, sf)
    vectors = e.withColumnRenamed("vec_id", "chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return chunks.withColumn("doc_id", source), _questions(spark, sf).join(e.withColumnRenamed("vec_id", "query_id"), "query_id", "left"), vectors


def _sources(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("title")).distinct()
    return d.select(F.regexp_extract("title", "([0-9]+)", 1).cast("bigint").alias("doc_id"), "title")


def _overlap(spark, sf, kept: postings.Prepared) -> DataFrame:
    """A second list for fusion: chunks by how many of the query's terms they have."""
    return retrieval.overlap(kept, _questions(spark, sf))


def _fused(spark, sf) -> DataFrame:
    chunks = _chunks(spark, sf)
    kept = postings.prepared(chunks, _questions(spark, sf))
    return retrieval.fuse([(_overlap(spark, sf, kept), 1.0), (retrieval.bm25_search(chunks, _questions(spark, sf), kept=kept), 1.0)])


@query("rank_fusion", f"WITH {_BM25}, {_OVERLAP}, {_FUSED} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM fused")
def rank_fusion(spark, sf):
    return _fused(spark, sf).withColumn("score", F.round("score", 9))


_CAPPED = """
n AS (SELECT f.query_id, f.chunk_id, source AS doc_id, score, rank, row_number() OVER (PARTITION BY f.query_id, source ORDER BY rank) AS nth FROM fused f JOIN documents d ON d.doc_id = f.chunk_id WHERE rank <= 40),
capped AS (SELECT query_id, chunk_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY (nth > 3)::INT, rank)::INT AS rank FROM n)"""


def _capped(spark, sf) -> DataFrame:
    sources = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"))
    return retrieval.cap(retrieval.beside(_fused(spark, sf).where("rank <= 40"), _questions(spark, sf), 40).join(sources, "chunk_id"))


@query("document_cap", f"WITH {_BM25}, {_OVERLAP}, {_FUSED}, {_CAPPED} SELECT query_id, chunk_id, doc_id, rank FROM capped")
def document_cap(spark, sf):
    return _capped(spark, sf).select("query_id", "chunk_id", "doc_id", "rank")


@query("hybrid_search", f"""WITH {_BM25}, {_NEAR}, {_HYBRID}, {_CAPPED}
SELECT query_id, chunk_id, capped.doc_id AS title, round(score, 9) AS score, rank, md5(text) AS digest FROM capped JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 6""")
def hybrid_search(spark, sf):
    """Dense and BM25 lists, fused, capped by source: the flagship."""
    chunks, questions, vectors = _with_vectors(spark, sf)
    found = retrieval.search(chunks, _sources(spark, sf), questions, vectors=vectors)
    return found.select("query_id", "chunk_id", "title", F.round("score", 9).alias("score"), "rank", F.md5("text").alias("digest"))


@query("dense_fusion_cap", f"""
WITH dense AS ({_DENSE.format(k=20)}),
l2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(chunk_id - query_id), chunk_id)::INT AS rank FROM dense),
lists AS (SELECT query_id, chunk_id, 0 AS l, rank FROM dense UNION ALL SELECT query_id, chunk_id, 1, rank FROM l2),
g AS (SELECT query_id, chunk_id, coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (l = 0), 0) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (l = 1), 0) AS score, min({{'l': l, 'r': rank}}) AS first FROM lists GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first.l, first.r) AS rank FROM g),
n AS (SELECT f.query_id, f.chunk_id, label AS doc_id, rank, row_number() OVER (PARTITION BY f.query_id, label ORDER BY rank) AS nth FROM fused f JOIN embeddings e ON e.vec_id = f.chunk_id)
SELECT * FROM (SELECT query_id, chunk_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (nth > 3)::INT, rank)::INT AS rank FROM n) WHERE rank <= 6""")
def dense_fusion_cap(spark, sf):
    chunks, queries = _vectors(spark, sf)
    dense = retrieval.dense_search(chunks, queries, 20)
    near = retrieval.top(dense.select("query_id", "chunk_id"), 20, ["query_id"], F.abs(F.col("chunk_id") - F.col("query_id")), F.asc("chunk_id"))
    fused = retrieval.fuse([(dense, 1.0), (near, 1.0)]).join(chunks.select("chunk_id", F.col("doc_id").cast("int").alias("doc_id")), "chunk_id")
    return retrieval.cap(fused).where("rank <= 6").select("query_id", "chunk_id", "doc_id", "rank")


@query("clauses", f"""
WITH q AS (SELECT conv_id, turn, text, list_transform(regexp_split_to_array(text, '(?i)\\s*(?:[,;?]|\\band\\b|\\bor\\b|\\balso\\b|\\bplus\\b)\\s*'), lambda p: {trim('p')}) AS parts FROM conversations),
l AS (SELECT conv_id, turn, text, list_filter(parts, lambda p: len({words('p')}) >= 3) AS long FROM q)
SELECT conv_id, turn, CASE WHEN len({words('text')}) >= 7 AND len(long) >= 2 THEN array_to_string(long, '|') ELSE '' END AS clauses FROM l""")
def clauses(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.clauses(F.col("text")), "|").alias("clauses"))


@query("recall_query", """
WITH h AS (SELECT conv_id, arg_max(text, turn) AS action, list(text ORDER BY turn) FILTER (role = 'assistant') AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, substr(array_to_string(list_concat([""" + trim("action") + """], list_filter(coalesce(l, [])[greatest(len(coalesce(l, [])) - 1, 1):], lambda s: s <> '')), ' '), 1, 1200) AS q FROM h""")
def recall_query(spark, sf):
    h = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("action"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("l")
    )
    return h.select("conv_id", context.recall_query(F.col("action"), F.col("l.text")).alias("q"))


_RECALL_SQL = """
WITH h AS (SELECT conv_id, arg_max(text, turn) AS action, list(text ORDER BY turn) FILTER (role = 'assistant') AS l FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id AS query_id, substr(array_to_string(list_concat([""" + trim("action") + """], list_filter(coalesce(l, [])[greatest(len(coalesce(l, [])) - 1, 1):], lambda s: s <> '')), ' '), 1, 1200) AS query FROM h),
m AS (SELECT conv_id, turn, role, text FROM conversations),
t AS (SELECT conv_id, turn, 'text' AS field, {tokens} AS l FROM m UNION ALL SELECT conv_id, turn, 'heading', {heads} FROM m),
posted AS (SELECT conv_id, turn, field, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM t),
q AS (SELECT query_id, unnest({terms}) AS term FROM a),
parts AS (SELECT query_id, term, len({term_tokens}) AS m, unnest({term_tokens}) AS token, generate_subscripts({term_tokens}, 1) - 1 AS k FROM q),
starts AS (SELECT conv_id, term, m, turn, field, pos - k AS start, count(*) AS n FROM posted JOIN parts ON parts.query_id = posted.conv_id AND parts.token = posted.token GROUP BY ALL),
w AS (SELECT conv_id, term, turn, count(*) FILTER (field = 'text') + 2 * count(*) FILTER (field = 'heading') AS f FROM starts WHERE n = m GROUP BY ALL),
df AS (SELECT conv_id, term, count(*) AS df FROM w GROUP BY ALL), len AS (SELECT conv_id, turn, count(*) AS d FROM posted GROUP BY ALL),
c AS (SELECT m.conv_id, count(*)::DOUBLE AS n, sum(coalesce(d, 0))::DOUBLE / count(*) AS a FROM m LEFT JOIN len USING (conv_id, turn) GROUP BY m.conv_id),
s AS (SELECT conv_id, turn, round(sum(CASE WHEN ln((n - df + .5) / (df + .5)) > 0 THEN ln((n - df + .5) / (df + .5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (.25 + .75 * d / a))), 9) AS score
  FROM w JOIN df USING (conv_id, term) JOIN len USING (conv_id, turn) JOIN c USING (conv_id) GROUP BY ALL)
SELECT conv_id, turn, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn)::INT AS rank FROM s) WHERE rank <= 6"""


@query("campaign_recall", _RECALL_SQL.format(tokens=_TOKENS.format(x="text"), heads=_TOKENS.format(x="role"), terms=terms_sql("query"), term_tokens=_TOKENS.format(x="term")))
def campaign_recall(spark, sf):
    """What each of many campaigns recalls for its next turn, in one plan: every conversation is a campaign, its turns are memories."""
    c = table(spark, sf, "conversations")
    memories = c.select(F.col("conv_id").alias("campaign"), F.col("turn").alias("chunk_id"), F.col("role").alias("heading"), "text")
    asked = recall_query(spark, sf).select(F.col("conv_id").alias("campaign"), F.col("q").alias("query"))
    found = recall.bm25_by_group(memories, asked, 6, group="campaign")
    return found.select(F.col("campaign").alias("conv_id"), F.col("chunk_id").alias("turn"), F.round("score", 6).alias("score"), "rank")


def _clauses_sql(x: str) -> str:
    parts = f"list_transform(regexp_split_to_array({x}, '(?i)\\s*(?:[,;?]|\\band\\b|\\bor\\b|\\balso\\b|\\bplus\\b)\\s*'), lambda p: {trim('p')})"
    long = f"list_filter({parts}, lambda p: len({words('p')}) >= 3)"
    return f"CASE WHEN len({words(x)}) >= 7 AND len({long}) >= 2 THEN {long} ELSE [] END"


def reranked_sql(texts: str, *, expand: bool = False) -> str:
    """reranked: the fused candidates by the lexical stand-in for a cross-encoder, over the question (with ``expand``, and its
    clauses), and the floor.

    ``texts`` gives (chunk_id, t)."""
    tokens = lambda c: _TOKENS.format(x=c)
    questions = f"list_concat([query], {_clauses_sql('query')})" if expand else "[query]"
    return f"""
texts AS (SELECT chunk_id, list_distinct({tokens('t')}) AS have FROM ({texts})),
asked AS (SELECT query_id, unnest({questions}) AS a FROM ({_ASKED})),
want AS (SELECT query_id, a, list_distinct(flatten(list_transform({terms_sql('a')}, lambda t: {tokens('t')}))) AS want FROM asked),
pairs AS (SELECT query_id, chunk_id, rank AS old, max(round(20.0::DOUBLE * len(list_intersect(want, have)) / greatest(len(want), 1) - 10.0, 6)) AS score FROM fused JOIN texts USING (chunk_id) JOIN want USING (query_id) WHERE rank <= 40 GROUP BY ALL),
best AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old)::INT AS rank FROM pairs),
reranked AS (SELECT query_id, chunk_id, score, rank FROM best WHERE rank = 1 OR score >= top - 12)"""


_HEADED_TEXT = "SELECT doc_id AS chunk_id, source || chr(10) || substr(text, 1, 2000) AS t FROM documents"


@query("rerank", f"WITH {_BM25}, {_OVERLAP}, {_FUSED}, {reranked_sql(_HEADED_TEXT, expand=True)} SELECT query_id, chunk_id, score, rank FROM reranked")
def rerank(spark, sf):
    """The deterministic stand-in for a cross-encoder over the fused candidates, by the best of the question and its clauses, then the floor."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.lit("").alias("heading"), "text")
    hits = retrieval.beside(_fused(spark, sf).where("rank <= 40"), _questions(spark, sf), 40).join(docs, "chunk_id")
    return retrieval.floor(retrieval.rerank(hits, _questions(spark, sf), expand=True)).select("query_id", "chunk_id", "score", "rank")


@query("hash_embedding")
def hash_embedding(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", embed(F.col("text")).alias("vec"))


_LAST = """
nth AS (SELECT r.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth FROM {found} r JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 40),
final AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY (nth > 3)::INT, rank)::INT AS rank FROM nth)
SELECT f.query_id, f.chunk_id, f.rank, round(f.score, 9) AS score, coalesce(near.rank, 0) AS dense_rank, coalesce(bm25.rank, 0) AS bm25_rank FROM final f
LEFT JOIN near ON near.query_id = f.query_id AND near.chunk_id = f.chunk_id LEFT JOIN bm25 ON bm25.query_id = f.query_id AND bm25.chunk_id = f.chunk_id AND bm25.rank <= 40 WHERE f.rank <= 6"""


def _searched(found: DataFrame) -> DataFrame:
    """0 stands for a list that does not have the chunk."""
    rank = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), rank("dense_rank"), rank("bm25_rank"))


@query("full_search", f"WITH {_BM25}, {_NEAR}, {_HYBRID}, {reranked_sql(_HEADED_TEXT)}, {_LAST.format(found='reranked')}")
def full_search(spark, sf):
    """Dense and BM25 lists, fused, reranked, floored and capped."""
    chunks, questions, vectors = _with_vectors(spark, sf)
    return _searched(retrieval.search(chunks, _sources(spark, sf), questions, vectors=vectors, reranker=retrieval.lexical_score))


@query("search_counts", f"""WITH {_BM25}, {_NEAR}, {_HYBRID}, {reranked_sql(_HEADED_TEXT)},
n AS (SELECT query_id, source, count(*) AS n FROM reranked r JOIN documents d ON d.doc_id = r.chunk_id GROUP BY ALL)
SELECT q.query_id, (SELECT count(*) FROM near x WHERE x.query_id = q.query_id) AS dense, (SELECT count(*) FROM bm25 x WHERE x.query_id = q.query_id AND rank <= 40) AS bm25, 0::BIGINT AS clauses,
  (SELECT count(*) FROM fused x WHERE x.query_id = q.query_id) AS fused, (SELECT count(*) FROM reranked x WHERE x.query_id = q.query_id) AS reranked,
  least((SELECT count(*) FROM reranked x WHERE x.query_id = q.query_id), 6) AS returned FROM ({_ASKED}) q""")
def search_counts(spark, sf):
    """How many candidates each step of the search leaves."""
    chunks, questions, vectors = _with_vectors(spark, sf)
    return retrieval.Search(chunks, _sources(spark, sf), questions, vectors=vectors, reranker=retrieval.lexical_score).counts()


@query("hit_projection", f"""WITH {_BM25}, {_NEAR}, {_HYBRID}, {reranked_sql(_HEADED_TEXT)}, {_LAST.format(found='reranked').replace('SELECT f.query_id', ', shown AS (SELECT f.query_id')})
SELECT query_id, rank, chunk_id, '/docs/' || source || '.md' AS path, source AS title, source AS heading, 0 AS page, text, source || '.md' AS label, round(score, 4) AS score, dense_rank, bm25_rank,
  round(score, 3) AS rerank_score FROM shown JOIN documents d ON d.doc_id = chunk_id""")
def hit_projection(spark, sf):
    """Hits as they are shown; 0 stands for a list that does not have the chunk."""
    chunks, questions, vectors = _with_vectors(spark, sf)
    documents = _sources(spark, sf).withColumn("path", F.concat(F.lit("/docs/"), "title", F.lit(".md")))
    shown = retrieval.project(retrieval.search(chunks.withColumn("page", F.lit(0)), documents, questions, vectors=vectors, reranker=retrieval.lexical_score))
    return shown.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("dense_rank", "bm25_rank")})


_CLAUSES = f"SELECT struct_pack(q := query_id, n := n) AS query_id, query, query_id AS own, n FROM (SELECT query_id, unnest(c) AS query, generate_subscripts(c, 1) - 1 AS n FROM (SELECT query_id, {_clauses_sql('query')} AS c FROM ({_ASKED})))"


_EXPANDED = f"""{_BM25}, {_NEAR}, clauses AS ({_CLAUSES}), {hits_sql('SELECT query_id, query FROM clauses', '2')}, {bm25_sql('2')},
{fused_sql(list_sql("near", 0), list_sql("bm25", 1), "SELECT own AS query_id, chunk_id, (3 + 2 * n)::INT AS l, rank, 0.5 AS weight FROM bm252 JOIN clauses USING (query_id) WHERE rank <= 20")}"""


@query("expanded_search", f"WITH {_EXPANDED}, {_LAST.format(found='fused')}")
def expanded_search(spark, sf):
    """Hybrid search of compound questions with their clauses as further lists."""
    chunks, questions, vectors = _with_vectors(spark, sf)
    return _searched(retrieval.search(chunks, _sources(spark, sf), questions, vectors=vectors, expand=True))


@query("expanded_rerank", f"WITH {_EXPANDED}, {reranked_sql(_HEADED_TEXT, expand=True)}, {_LAST.format(found='reranked')}")
def expanded_rerank(spark, sf):
    """The same, reranked by the best of the question and its clauses."""
    chunks, questions, vectors = _with_vectors(spark, sf)
    return _searched(retrieval.search(chunks, _sources(spark, sf), questions, vectors=vectors, expand=True, reranker=retrieval.lexical_score))


# -- aggregations ----------------------------------------------------------------------------------------------------


@query("index_stats", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT coalesce(sum(n_chars), 0)::BIGINT FROM documents) AS bytes, (SELECT count(*) FROM embeddings) AS chunks")
def index_stats(spark, sf):
    return index.stats(table(spark, sf, "documents").withColumnRenamed("n_chars", "bytes"), table(spark, sf, "embeddings"))


@query("by_extension", "SELECT source AS ext, count(*) AS n FROM documents GROUP BY source")
def by_extension(spark, sf):
    return index.by_extension(table(spark, sf, "documents").select(F.col("source").alias("ext")))


@query("chunk_counts", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 30))::INT AS n_chunks FROM documents")
def chunk_counts(spark, sf):
    """Documents with their stale counts set to the number of their chunks, here their longer lines."""
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("text")).where(F.length("text") > 30)
    return index.refresh_counts(d.select("doc_id", F.lit(-1).alias("n_chunks")), lines).select("doc_id", "n_chunks")


@query("ingest_report", """
SELECT count_if(lang = 'en')::BIGINT AS added, count_if(lang = 'fr')::BIGINT AS updated, count_if(lang = 'de')::BIGINT AS unchanged, count_if(lang NOT IN ('en', 'fr', 'de'))::BIGINT AS skipped, 0::BIGINT AS failed, coalesce(sum(n_chars), 0)::BIGINT AS chunks FROM documents""")
def ingest_report(spark, sf):
    action = F.when(F.col("lang") == "en", "added").when(F.col("lang") == "fr", "updated").when(F.col("lang") == "de", "unchanged").otherwise("skipped")
    return index.report(table(spark, sf, "documents").select(action.alias("action"), F.col("n_chars").alias("n_chunks")))


@query("turn_count", "SELECT p.page_id AS conv_id, coalesce(max(c.turn), 0) AS last FROM pages p LEFT JOIN conversations c ON c.conv_id = p.page_id GROUP BY p.page_id")
def turn_count(spark, sf):
    """The last turn of campaigns of which some have none."""
    log = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("n"))
    return turns.turn_count(table(spark, sf, "pages").select(F.col("page_id").alias("conv_id")), log, ["conv_id"])


_PLAIN = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
_RANKS = f"""
results AS (SELECT query_id, rank, text FROM fused JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 5),
best AS (SELECT item_id AS query_id, min(rank) FILTER (contains({_PLAIN.format(x='r.text')}, {_PLAIN.format(x='b.text')})) AS rank, count(r.rank) AS n_returned FROM benchmark b LEFT JOIN results r ON r.query_id = item_id GROUP BY item_id)"""
_SCORES = """round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_3, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_5,
round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(count(rank)::DOUBLE / count(*), 6) AS coverage, count_if(rank IS NULL)::BIGINT AS misses, round(avg(n_returned::DOUBLE), 6) AS returned"""


def _results(spark, sf, ranked: DataFrame) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.beside(ranked.where("rank <= 5"), _questions(spark, sf), 5).join(texts, "chunk_id").select("query_id", "rank", "text")


def _expected(spark, sf) -> DataFrame:
    return _questions(spark, sf).select("query_id", F.col("query").alias("expect"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("best_rank", f"WITH {_BM25}, {_OVERLAP}, {_FUSED}, {_RANKS} SELECT query_id, coalesce(rank, 0)::INT AS rank FROM best")
def best_rank(spark, sf):
    """0 stands for a miss."""
    found = evaluate.ranks(_results(spark, sf, _fused(spark, sf)), _expected(spark, sf))
    return found.select("query_id", F.coalesce("rank", F.lit(0)).alias("rank"))


@query("retrieval_scores", f"WITH {_BM25}, {_OVERLAP}, {_FUSED}, {_RANKS} SELECT {_SCORES} FROM best")
def retrieval_scores(spark, sf):
    results = _results(spark, sf, _fused(spark, sf))
    return _rounded(evaluate.scores(evaluate.ranks(results, _expected(spark, sf)), results))


@query("retrieval_modes", f"""
WITH {_BM25}, {_NEAR}, {_HYBRID}, {reranked_sql(_HEADED_TEXT, expand=True)},
modes AS (SELECT 'dense' AS mode, query_id, chunk_id, rank FROM near UNION ALL SELECT 'bm25', query_id, chunk_id, rank FROM bm25 UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM fused
  UNION ALL SELECT 'hybrid+rerank', query_id, chunk_id, rank FROM reranked),
results AS (SELECT mode, query_id, rank, text FROM modes JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 5),
found AS (SELECT m.mode, item_id AS query_id, min(rank) FILTER (contains({_PLAIN.format(x='r.text')}, {_PLAIN.format(x='b.text')})) AS rank, count(r.rank) AS n_returned
  FROM benchmark b CROSS JOIN (SELECT DISTINCT mode FROM modes) m LEFT JOIN results r ON r.query_id = item_id AND r.mode = m.mode GROUP BY ALL)
SELECT mode, {_SCORES} FROM found GROUP BY mode""")
def retrieval_modes(spark, sf):
    """The scores of four ways to search, side by side."""
    chunks, questions, vectors = _with_vectors(spark, sf)
    # each list is searched for once; all modes read what is written
    dense, lexical = written(retrieval.dense_search(vectors, questions), "dense"), written(retrieval.bm25_search(chunks, questions), "bm25")
    hybrid = retrieval.fuse([(dense, 1.0), (lexical, 1.0)])
    ranked = retrieval.hydrate(retrieval.beside(hybrid.where("rank <= 40"), questions, 40), chunks, _sources(spark, sf))
    modes, out = {"dense": dense, "bm25": lexical, "hybrid": hybrid, "hybrid+rerank": retrieval.floor(retrieval.rerank(ranked, questions, expand=True))}, None
    for mode, found in modes.items():
        results = _results(spark, sf, found.select("query_id", "chunk_id", "rank"))
        row = evaluate.scores(evaluate.ranks(results, _expected(spark, sf)), results).withColumn("mode", F.lit(mode))
        out = row if out is None else out.unionByName(row)
    return _rounded(out)


@query("arcs", """
WITH n AS (SELECT conv_id, turn + 1 AS n, text FROM conversations), g AS (SELECT conv_id, (n - 1) // 2 AS a, min(n) AS from_turn, max(n) AS to_turn, count(*) AS k, list(text ORDER BY n) AS l FROM n GROUP BY ALL)
SELECT conv_id, from_turn, to_turn, '1. ' || l[1] || chr(10) || '2. ' || l[2] AS text FROM g WHERE k = 2""")
def arcs(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("n"), F.col("text").alias("summary"))
    return turns.arcs(t, ["conv_id"], every=2)


# -- windows and state -----------------------------------------------------------------------------------------------

_HIT_ROWS = "SELECT conv_id AS query_id, turn + 1 AS rank, role AS heading, text FROM conversations"


def _hit_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("heading"), "text")


@query("recall_budget", f"""
SELECT query_id, rank, line FROM (SELECT query_id, rank, line, sum(length(line)) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM (
  SELECT query_id, rank, '[m' || rank || '] ' || heading || ' — ' || {trim('text')} AS line FROM ({_HIT_ROWS}))) WHERE spent <= 600 OR rank = 1""")
def recall_budget(spark, sf):
    return context.recalled(_hit_rows(spark, sf), 600).select("query_id", "rank", "line")


_SOURCES = """
WITH h AS (SELECT query_id, list({'r': rank, 'id': query_id * 1000 + rank, 'label': heading, 'body': """ + trim("text") + """} ORDER BY rank) AS hits FROM (""" + _HIT_ROWS + """) GROUP BY query_id),
p AS (SELECT query_id, list_reduce(hits, lambda s, h: CASE WHEN len(s.used) > 0 AND s.spent + length('[' || (len(s.used) + 1) || '] ' || h.label) + length(h.body) + 4 > 900 THEN s
  ELSE {'r': 0::BIGINT, 'spent': (s.spent + length('[' || (len(s.used) + 1) || '] ' || h.label) + length(BODY) + 4)::BIGINT, 'blocks': list_append(s.blocks, '[' || (len(s.used) + 1) || '] ' || h.label || chr(10) || BODY), 'used': list_append(s.used, h.id)} END,
  {'r': 0::BIGINT, 'spent': 0::BIGINT, 'blocks': []::VARCHAR[], 'used': []::BIGINT[]}) AS s FROM h)
SELECT query_id, array_to_string(s.blocks, chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS context, s.used AS used FROM p""".replace(
    "BODY", "CASE WHEN s.spent + length('[' || (len(s.used) + 1) || '] ' || h.label) + length(h.body) + 4 > 900 THEN substr(h.body, 1, greatest(500, 896 - length('[' || (len(s.used) + 1) || '] ' || h.label))) ELSE h.body END"
)


@query("source_budget", _SOURCES)
def source_budget(spark, sf):
    hits = _hit_rows(spark, sf).select("query_id", "rank", (F.col("query_id") * 1000 + F.col("rank")).alias("chunk_id"), F.col("heading").alias("label"), "text")
    return context.pack_sources(hits, 900).select("query_id", "context", "used")


@query("recent_turns", "SELECT conv_id, turn AS n, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def recent_turns(spark, sf):
    return turns.recent(table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("n"), "text"), 3, ["conv_id"])


@query("story_clock", """
SELECT conv_id, n, TIMESTAMP '2025-04-14 08:30:00' + to_minutes(coalesce(sum(least(greatest(minutes, 0), 43200)) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS at
FROM (SELECT conv_id, turn AS n, length(text) - 40 AS minutes FROM conversations)""")
def story_clock(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("n"), (F.length("text") - 40).alias("minutes"))
    return turns.with_clock(t, F.lit("2025-04-14 08:30:00").cast("timestamp_ntz"), ["conv_id"]).select("conv_id", "n", "at")


@query("last_write", """
SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(v, event_id) FILTER (v IS NOT NULL) AS value FROM (SELECT *, CASE WHEN event_type = 'click' THEN value END AS v FROM events) GROUP BY user_id""")
def last_write(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("event_type") == "click", F.col("value")))
    return turns.last_write(e, ["user_id"], "event_id", "event_type", "value")


_OLD = "SELECT c_custkey AS slug, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS role, c_mktsegment AS sheet, c_acctbal > 0 AS present, c_nationkey = 3 AS protagonist, 1 AS first_turn FROM customer WHERE c_nationkey < 20"
_NEW = "SELECT c_custkey AS slug, upper(c_name) AS name, CASE WHEN c_nationkey > 10 THEN 'new' ELSE '' END AS role, '' AS sheet, c_acctbal < 0 AS present, false AS protagonist, 2 AS first_turn FROM customer WHERE c_nationkey >= 5"


@query("upsert_characters", f"""
SELECT slug, coalesce(n.name, o.name) AS name, coalesce(nullif(n.role, ''), o.role, '') AS role, coalesce(nullif(n.sheet, ''), o.sheet, '') AS sheet, coalesce(n.present, o.present) AS present,
  coalesce(o.protagonist, n.protagonist) AS protagonist, coalesce(o.first_turn, n.first_turn) AS first_turn FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (slug)""")
def upsert_characters(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_nationkey < 20").selectExpr("c_custkey slug", "c_name name", "if(c_acctbal > 0, c_mktsegment, '') role", "c_mktsegment sheet", "c_acctbal > 0 present", "c_nationkey = 3 protagonist", "1 first_turn")
    new = c.where("c_nationkey >= 5").selectExpr("c_custkey slug", "upper(c_name) name", "if(c_nationkey > 10, 'new', '') role", "'' sheet", "c_acctbal < 0 present", "false protagonist", "2 first_turn")
    return turns.upsert_characters(old, new)


@query("upsert_relationships", """
WITH o AS (SELECT c_custkey AS other, c_mktsegment AS label, 4 AS closeness, 'old' AS note FROM customer WHERE c_nationkey < 20),
n AS (SELECT c_custkey AS other, CASE WHEN c_acctbal > 0 THEN 'ally' END AS label, CASE WHEN c_acctbal > 2000 THEN (c_acctbal / 500)::INT END AS closeness, CAST(NULL AS VARCHAR) AS note FROM customer WHERE c_nationkey >= 5)
SELECT other, coalesce(n.label, o.label, '') AS label, CASE WHEN n.closeness IS NULL THEN coalesce(o.closeness, 5) ELSE least(greatest(n.closeness, 0), 10) END AS closeness, coalesce(n.note, o.note, '') AS note FROM o FULL JOIN n USING (other)""")
def upsert_relationships(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_nationkey < 20").selectExpr("c_custkey other", "c_mktsegment label", "4 closeness", "'old' note")
    new = c.where("c_nationkey >= 5").select(
        F.col("c_custkey").alias("other"), F.when(F.col("c_acctbal") > 0, "ally").alias("label"), F.when(F.col("c_acctbal") > 2000, F.rint(F.col("c_acctbal") / 500).cast("int")).alias("closeness"), F.lit(None).cast("string").alias("note")
    )
    return turns.upsert_relationships(old, new)


# -- scalars ---------------------------------------------------------------------------------------------------------

_DAY = "CASE WHEN day(ts) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN day(ts) % 10 = 1 THEN 'st' WHEN day(ts) % 10 = 2 THEN 'nd' WHEN day(ts) % 10 = 3 THEN 'rd' ELSE 'th' END"
_DATE = f"strftime(ts, '%A, %B ') || day(ts) || {_DAY} || ', ' || year(ts)"
_TIME = "strftime(ts, '%-I:%M %p')"
_SIGN = "CASE WHEN hour(ts) < 5 THEN '🌙' WHEN hour(ts) < 8 THEN '🌅' WHEN hour(ts) < 12 THEN '🕘' WHEN hour(ts) < 17 THEN '🕛' WHEN hour(ts) < 20 THEN '🌆' ELSE '🌙' END"


@query("pretty_clock", f"SELECT event_id, {_DATE} AS date, {_TIME} AS time, {_SIGN} AS sign, ts + to_minutes(greatest(user_id, 0)) AS later FROM events")
def pretty_clock(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", D.pretty_date(ts).alias("date"), D.pretty_time(ts).alias("time"), D.hour_sign(F.hour(ts)).alias("sign"), D.advance(ts, F.col("user_id")).alias("later"))


@query("entry_header", f"SELECT event_id, '📅 ' || {_DATE} || ' — ' || {_SIGN} || ' ' || {_TIME} || ' — ' || event_type AS header FROM events")
def entry_header(spark, sf):
    return table(spark, sf, "events").select("event_id", D.header(F.col("ts"), F.col("event_type")).alias("header"))


@query("word_count", f"SELECT doc_id, len({words('text')})::INT AS n FROM documents")
def word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.count_words(F.col("text")).alias("n"))


@query("clean_choice", f"SELECT conv_id, turn, regexp_replace({trim("trim(" + trim("'** ' || text || '  x_*'") + ", '*_')")}, '\\s{{2,}}', ' ', 'g') AS choice FROM conversations")
def clean_choice(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.clean_choice(F.concat(F.lit("** "), "text", F.lit("  x_*"))).alias("choice"))


_FIVE = "list_concat(l, ['" + "', '".join(D.FILLER) + "'])[1:5]"
_PENDING = "SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY conv_id"


def _pending(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return c.select("conv_id", F.col("l.text").alias("l"))


@query("ensure_five", f"SELECT conv_id, {_FIVE} AS choices FROM ({_PENDING})")
def ensure_five(spark, sf):
    return _pending(spark, sf).select("conv_id", D.ensure_five(F.col("l")).alias("choices"))


@query("resolve_input", f"""
SELECT conv_id, CASE WHEN len(l) >= conv_id % 9 AND conv_id % 9 BETWEEN 1 AND 5 THEN l[conv_id % 9] ELSE (conv_id % 9)::VARCHAR END AS action FROM ({_PENDING})""")
def resolve_input(spark, sf):
    return _pending(spark, sf).select("conv_id", D.resolve_input(F.concat(F.lit(" "), (F.col("conv_id") % 9).cast("string"), F.lit(" ")), F.col("l")).alias("action"))


@query("entry_text", f"""
SELECT conv_id, '📅 Monday, April 14th, 2025 — 🕘 8:30 AM — Turn' || chr(10) || chr(10) || {trim('l[1]')} || chr(10) || chr(10) || '**What will you do?**' || chr(10) || chr(10) ||
  array_to_string(list_transform(l[1:5], lambda c, i: ['{"', '".join(D.KEYCAPS)}'][i] || ' ' || c), chr(10)) AS entry FROM ({_PENDING})""")
def entry_text(spark, sf):
    return _pending(spark, sf).select("conv_id", D.entry(F.lit("2025-04-14 08:30:00").cast("timestamp_ntz"), F.lit(" Turn "), F.col("l")[0], F.col("l")).alias("entry"))


@query("clamp", "SELECT event_id, least(greatest((value / 10)::BIGINT, 0), 10)::INT AS closeness, least(greatest(user_id * 100, 0), 43200)::INT AS minutes FROM events")
def clamp(spark, sf):
    close = F.least(F.greatest(F.bround(F.col("value") / 10), F.lit(0.0)), F.lit(10.0)).cast("int")
    return table(spark, sf, "events").select("event_id", close.alias("closeness"), D.clamp_minutes((F.col("user_id") * 100).cast("string")).alias("minutes"))


# -- rows only -------------------------------------------------------------------------------------------------------


def _pieces_sql(x: str) -> str:
    """A paragraph in pieces of whole sentences, by a fold: what is done, and the run that is open."""
    split = f"string_split(regexp_replace({x}, '([.!?])\\s+([A-Z\"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    both = "CASE WHEN s.run = '' THEN x ELSE s.run || ' ' || x END"
    step = f"""CASE WHEN length({both}) <= 1800 THEN {{'done': s.done, 'run': {both}}} WHEN s.run <> '' THEN {{'done': list_append(s.done, s.run), 'run': x}}
      ELSE {{'done': list_concat(s.done, list_transform(range(0, length(x), 1800), lambda i: substr(x, i + 1, 1800))), 'run': ''}} END"""
    fold = f"list_reduce({split}, lambda s, x: {step}, {{'done': []::VARCHAR[], 'run': ''}})"
    return f"CASE WHEN length({x}) <= 1800 THEN [{x}] ELSE list_filter(list_append(({fold}).done, ({fold}).run), lambda p: p <> '') END"


_CUT = "regexp_replace(right(BODY, 300), '([.!?])\\s+([A-Z\"''(\\[])', '\\1' || chr(1) || '\\2')"
_AGAIN = f"CASE WHEN length(BODY) <= 300 THEN '' WHEN instr({_CUT}, chr(1)) > 0 THEN {trim('substr(' + _CUT + ', instr(' + _CUT + ', chr(1)) + 1)')} ELSE {trim('right(BODY, 300)')} END".replace("BODY", trim("s.held"))
_GAP = "chr(10) || chr(10)"


@query("chunks", f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: {trim('p')}), lambda p: p <> '') AS ps FROM documents),
e AS (SELECT doc_id, flatten(list_transform(ps, lambda p: {_pieces_sql('p')})) AS pieces FROM p),
f AS (SELECT doc_id, list_reduce(pieces, lambda s, x: CASE WHEN s.size > 0 AND s.size + length(x) > 1800
    THEN {{'done': list_append(s.done, {trim('s.held')}), 'held': CASE WHEN {_AGAIN} = '' THEN x ELSE {_AGAIN} || {_GAP} || x END, 'size': (length({_AGAIN}) + length(x) + 2)::BIGINT}}
    ELSE {{'done': s.done, 'held': CASE WHEN s.size = 0 THEN x ELSE s.held || {_GAP} || x END, 'size': (s.size + length(x) + 2)::BIGINT}} END,
  {{'done': []::VARCHAR[], 'held': '', 'size': 0::BIGINT}}) AS s FROM e WHERE len(pieces) > 0),
m AS (SELECT doc_id, list_reduce(list_append(s.done, {trim('s.held')}), lambda a, x: CASE WHEN len(a) > 0 AND length(x) < 120 AND length(a[-1]) + length(x) <= 2700
    THEN list_append(a[1:len(a) - 1], a[-1] || {_GAP} || x) ELSE list_append(a, x) END, []::VARCHAR[]) AS texts FROM f)
SELECT doc_id, (generate_subscripts(texts, 1) - 1)::INT AS ord, '' AS heading, CAST(NULL AS INT) AS page, unnest(texts) AS text FROM m""")
def chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array(F.struct(F.col("text").alias("text"), F.lit(None).cast("int").alias("page"))).alias("blocks"))
    return chunking.chunk_documents(d)


@query("page_chunks")
def page_chunks(spark, sf):
    """Pages parsed as HTML files, then chunked."""
    p = table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return chunking.chunk_documents(loaders.load_files(p).select(F.col("path").alias("doc_id"), "blocks"))


@query("stemmed_bm25")
def stemmed_bm25(spark, sf):
    from tessera.functions.porter import stemmed_tokens

    return retrieval.bm25_search(_chunks(spark, sf), _questions(spark, sf), 10, tokens=stemmed_tokens)
