"""Registered queries of the state, the log and model output; the registry is that of ``catalogue``."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.backends import HASH_MODEL
from tessera.functions import dates as D
from tessera.functions import text as T
from tessera.operators import context, evaluate, index, retrieval, turns
from tessera.plans.catalogue import _chunks, _questions, query, table

# -- key-value state -------------------------------------------------------------------------------------------------


@query("latest_values", "SELECT user_id, event_type, arg_max(props, event_id) AS value, max(event_id) AS turn FROM events GROUP BY ALL")
def latest_values(spark, sf):
    """Key-value upserts: the last write of each key."""
    log = table(spark, sf, "events").select("user_id", "event_type", F.col("props").alias("value"), F.col("event_id").alias("turn"), "event_id")
    return turns.last_write(log, ["user_id", "event_type"], "event_id", "value", "turn")


@query("settings", """
WITH l AS (SELECT user_id, event_type, arg_max(props, event_id) AS v FROM events GROUP BY ALL)
SELECT user_id, coalesce(max(v) FILTER (event_type = 'click'), 'none') AS date, coalesce(max(v) FILTER (event_type = 'view'), '') AS location, coalesce(max(v) FILTER (event_type = 'purchase'), '') AS title,
  count(*) FILTER (event_type = 'purchase') > 0 AS started FROM l GROUP BY user_id""")
def settings(spark, sf):
    """Accessors with defaults: the latest value of each key, as columns."""
    key = F.when(F.col("event_type") == "click", "date").when(F.col("event_type") == "view", "location").when(F.col("event_type") == "purchase", "title").otherwise("other")
    log = table(spark, sf, "events").select("user_id", key.alias("key"), F.col("props").alias("value"), F.col("event_id").alias("turn"))
    return turns.settings(log, ["user_id"], {"date": "none", "location": "", "title": ""})


@query("flag_items", """
SELECT event_id, substr(k, 1, 60) AS key, json_extract_string(props, k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def flag_items(spark, sf):
    return turns.flags(table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("flags")), "event_id")


@query("remember_roots", """
SELECT conv_id, list_sort(list_distinct(list_concat(list(role), list('/' || turn % 3)))) AS roots FROM conversations GROUP BY conv_id""")
def remember_roots(spark, sf):
    """The union of remembered and given roots, sorted."""
    sets = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("a"), F.collect_list(F.concat(F.lit("/"), (F.col("turn") % 3).cast("string"))).alias("b"))
    return sets.select("conv_id", index.remembered(F.col("a"), F.col("b")).alias("roots"))


@query("set_present", """
SELECT c_custkey AS slug, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS present FROM customer""")
def set_present(spark, sf):
    cast = table(spark, sf, "customer").select(F.col("c_custkey").alias("slug"), F.lit(True).alias("present"))
    return turns.set_present(cast, table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("slug"))).select("slug", "present")


@query("roster", """
SELECT c_nationkey, string_agg('- ' || c_custkey || ': ' || c_name || ' (' || c_mktsegment || ')', chr(10) ORDER BY c_custkey) AS roster FROM customer GROUP BY c_nationkey""")
def roster(spark, sf):
    cast = table(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    return turns.roster(cast, "c_nationkey")


@query("character_block", """
SELECT c_custkey, c_name || CASE WHEN c_mktsegment <> '' THEN ' — ' || c_mktsegment ELSE '' END || CASE WHEN c_acctbal > 0 THEN chr(10) || 'rich' ELSE '' END AS block FROM customer""")
def character_block(spark, sf):
    sheet = F.when(F.col("c_acctbal") > 0, " rich ").otherwise("")
    return table(spark, sf, "customer").select("c_custkey", T.character_block(F.col("c_name"), F.col("c_mktsegment"), sheet).alias("block"))


# -- documents and log -----------------------------------------------------------------------------------------------


@query("document_upsert", """
WITH o AS (SELECT min(page_id) AS doc_id, url AS path, min(length(html)) AS bytes FROM pages GROUP BY url),
n AS (SELECT 'http://' || source || '/' || doc_id AS path, n_chars AS bytes FROM documents UNION ALL SELECT path, 1 FROM o WHERE ends_with(path, '.html')),
fresh AS (SELECT path, bytes, (SELECT max(doc_id) FROM o) + row_number() OVER (ORDER BY encode(path)) AS doc_id FROM n WHERE path NOT IN (SELECT path FROM o))
SELECT doc_id::BIGINT AS doc_id, path, bytes::BIGINT AS bytes FROM fresh UNION ALL SELECT o.doc_id, o.path, coalesce(n.bytes, o.bytes) FROM o LEFT JOIN n USING (path)""")
def document_upsert(spark, sf):
    """New documents get new ids in order of path, known paths keep theirs."""
    old = table(spark, sf, "pages").groupBy(F.col("url").alias("path")).agg(F.min("page_id").alias("doc_id"), F.min(F.length("html")).cast("bigint").alias("bytes"))
    fresh = table(spark, sf, "documents").select(F.concat(F.lit("http://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").cast("bigint").alias("bytes"))
    new = fresh.unionByName(old.where(F.col("path").endswith(".html")).select("path", F.lit(1).cast("bigint").alias("bytes")))
    return index.upsert(old, new, ["bytes"])


@query("document_delete", "SELECT conv_id AS doc_id, turn AS chunk_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def document_delete(spark, sf):
    """Chunks of deleted documents go with them."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), "role")
    documents, chunks = index.delete(c.select("doc_id").distinct(), c.select("doc_id", "chunk_id"), c.where("role = 'system'"))
    return chunks.join(documents, "doc_id", "left_semi").select("doc_id", "chunk_id")


@query("append_turn", """
SELECT conv_id, turn AS n, text FROM conversations UNION ALL SELECT page_id, coalesce((SELECT max(turn) FROM conversations c WHERE c.conv_id = p.page_id), 0) + 1, 'new ' || page_id FROM pages p""")
def append_turn(spark, sf):
    """A turn for each of many campaigns, some of them new."""
    log = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("n"), "text")
    new = table(spark, sf, "pages").select(F.col("page_id").alias("conv_id"), F.concat(F.lit("new "), F.col("page_id").cast("string")).alias("text"))
    return turns.append(log, new, ["conv_id"]).select("conv_id", "n", "text")


@query("set_summary", "SELECT conv_id, turn AS n, CASE WHEN role = 'user' THEN 'done: ' || text ELSE text END AS summary, role = 'user' AS archived FROM conversations")
def set_summary(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("n"), "role", F.col("text").alias("summary"), F.lit(False).alias("archived"))
    new = c.where("role = 'user'").select("conv_id", "n", F.concat(F.lit("done: "), "summary").alias("summary"))
    return turns.with_summaries(c, new, ["conv_id"]).select("conv_id", "n", "summary", "archived")


@query("verbatim_and_earlier", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn AS n, CASE WHEN back <= 1 THEN 'verbatim' ELSE 'earlier' END AS part, CASE WHEN back <= 1 THEN text ELSE 'Turn ' || turn || ': ' || role END AS line FROM r WHERE back <= 7""")
def verbatim_and_earlier(spark, sf):
    log = turns.recent(table(spark, sf, "conversations").withColumn("n", F.col("turn")), turns.VERBATIM + turns.SUMMARIES, ["conv_id"])
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"))) <= turns.VERBATIM
    return log.withColumn("v", last).select(
        "conv_id", "n", F.when(F.col("v"), "verbatim").otherwise("earlier").alias("part"), F.when(F.col("v"), F.col("text")).otherwise(F.concat(F.lit("Turn "), F.col("n").cast("string"), F.lit(": "), "role")).alias("line")
    )


@query("chat_session", """
SELECT conv_id, turn AS n, string_agg(role || ': ' || text, chr(10) ORDER BY t) AS memory FROM (
  SELECT a.conv_id, a.turn, b.turn AS t, b.role, b.text FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn BETWEEN a.turn - 4 AND a.turn - 1 AND b.role IN ('user', 'assistant') AND b.text <> '') GROUP BY ALL""")
def chat_session(spark, sf):
    """What a chat remembers before each entry."""
    log = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("n"), "role", F.col("text").alias("content"))
    said = F.transform("memory", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return context.session_memory(log, ["conv_id"]).select("conv_id", "n", F.array_join(said, "\n").alias("memory"))


@query("chat_resets", """
WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 0 THEN ' Reset' WHEN role = 'assistant' AND (conv_id + turn) % 7 = 0 THEN 'clear' ELSE text END AS text FROM conversations),
s AS (SELECT *, role = 'user' AND text = ' Reset' AS ends, count(*) FILTER (role = 'user' AND text = ' Reset') OVER (PARTITION BY conv_id ORDER BY turn) AS session FROM c)
SELECT conv_id, turn AS n, string_agg(role || ': ' || text, chr(10) ORDER BY t) AS memory FROM (
  SELECT a.conv_id, a.turn, b.turn AS t, b.role, b.text FROM s a JOIN s b ON b.conv_id = a.conv_id AND b.session = a.session AND b.turn BETWEEN a.turn - 4 AND a.turn - 1
    AND NOT b.ends AND b.role IN ('user', 'assistant') AND b.text <> '' WHERE NOT a.ends) GROUP BY ALL""")
def chat_resets(spark, sf):
    """What a chat remembers where some entries end the session; an assistant that says so ends nothing."""
    planted = F.when((F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 5 == 0), " Reset")
    planted = planted.when((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 7 == 0), "clear").otherwise(F.col("text"))
    log = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("n"), "role", planted.alias("content"))
    said = F.transform("memory", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return context.session_memory(log, ["conv_id"], until_reset=True).select("conv_id", "n", F.array_join(said, "\n").alias("memory"))


@query("arc_folds", """
WITH RECURSIVE t AS (SELECT conv_id, turn + 1 AS n, text, length(text) % 3 <> 0 AS folded FROM conversations),
a AS (SELECT DISTINCT conv_id, 0::BIGINT AS from_turn, 0::BIGINT AS to_turn FROM t
  UNION ALL SELECT a.conv_id, a.to_turn + 1, min(t.n)::BIGINT FROM a JOIN t ON t.conv_id = a.conv_id AND t.folded AND t.n >= a.to_turn + 2 GROUP BY a.conv_id, a.to_turn),
m AS (SELECT a.*, n, text, row_number() OVER (PARTITION BY a.conv_id, from_turn ORDER BY n) AS i FROM a JOIN t ON t.conv_id = a.conv_id AND t.n BETWEEN a.from_turn AND a.to_turn WHERE a.to_turn > 0)
SELECT conv_id, from_turn, to_turn, string_agg(i || '. ' || text, chr(10) ORDER BY i) AS text FROM m GROUP BY ALL""")
def arc_folds(spark, sf):
    """Ranges of two turns or more: a third of the folds fail, and their ranges go on into the next."""
    t = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("n"), F.col("text").alias("summary"), (F.length("text") % 3 != 0).alias("folded"))
    return turns.folds(t, ["conv_id"], every=2)


@query("clock_jump", """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN strftime(ts, '2025-06-01 %H:%M') ELSE strftime(ts, '%Y-%m-%d 07:45') END AS at FROM events""")
def clock_jump(spark, sf):
    """Either the date or the time is given, the other cannot be read and is ignored."""
    even = F.col("user_id") % 2 == 0
    at = D.jump_to(F.col("ts"), F.when(even, "2025-06-01").otherwise("soon"), F.when(even, "25:99").otherwise("07:45"))
    return table(spark, sf, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))


_PROMPT = ("Protagonist", "Present", "Standing", "Ongoing", "Story so far", "Recalled", "Earlier")


@query("turn_prompt", """
WITH t AS (SELECT conv_id, max(turn) + 1 AS n, arg_max(text, turn) AS action, string_agg(text, ' ' ORDER BY turn) AS said FROM conversations GROUP BY conv_id),
p AS (SELECT *, CASE WHEN length(said) > 5200 THEN '…' || right(said, 5200) ELSE said END AS previous FROM t)
SELECT conv_id AS campaign, '## World state' || chr(10) || 'Now: Monday, April 14th, 2025 — 8:30 AM' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'Place: quay' || chr(10) ELSE '' END || 'Entry number: ' || (n + 1) || chr(10) || chr(10) || """
+ " || ".join(f"CASE WHEN conv_id % {k + 2} > 0 THEN '## {title}' || chr(10) || '{title} ' || conv_id || chr(10) || chr(10) ELSE '' END" for k, title in enumerate(_PROMPT))
+ """ || CASE WHEN previous <> '' THEN '## Previous entry' || chr(10) || previous || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN trim(action, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN '## Action' || chr(10) || trim(action, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) ELSE '' END || 'Write the next entry.' AS prompt FROM p""")
def turn_prompt(spark, sf):
    """All parts of a prompt, each left out where it is empty; a long previous entry is cut at its start."""
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    t = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("campaign")).agg((F.max("turn") + 1).alias("turns"), F.max_by("text", "turn").alias("action"), F.array_join(said["text"], " ").alias("previous"))
    columns = ("protagonist", "present", "standing", "flags", "arcs", "recalled", "earlier")
    parts = {c: F.when(F.col("campaign") % (k + 2) > 0, F.concat(F.lit(f"{_PROMPT[k]} "), F.col("campaign").cast("string"))).otherwise("") for k, c in enumerate(columns)}
    place = F.when(F.col("campaign") % 2 == 0, "quay").otherwise("")
    return turns.turn_prompt(t.withColumns(parts | {"location": place, "clock": F.lit("2025-04-14 08:30:00").cast("timestamp_ntz")}))


# -- retrieval extras ------------------------------------------------------------------------------------------------


@query("query_source", """
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN [text] ELSE [text, text[1:20]] END AS expect FROM benchmark""")
def query_source(spark, sf):
    """Evaluation queries from JSON lines, with one expected passage or a list of them."""
    b = table(spark, sf, "benchmark")
    one = F.to_json(F.struct(F.col("item_id").cast("string").alias("query"), F.col("text").alias("expect")))
    many = F.to_json(F.struct(F.col("item_id").cast("string").alias("query"), F.array("text", F.substring("text", 1, 20)).alias("expect")))
    lines = b.select(F.explode(F.array(F.lit("# a comment"), F.lit(" "), F.when(F.col("item_id") % 2 == 0, one).otherwise(many))).alias("value"))
    return evaluate.query_source(lines).select(F.col("query").cast("bigint").alias("item_id"), "expect")


@query("dimension_guard", "SELECT vec_id AS chunk_id, len(embedding)::INT - 1 AS dims FROM embeddings WHERE label = 3")
def dimension_guard(spark, sf):
    """Vectors that are a number short."""
    e = table(spark, sf, "embeddings")
    vec = F.when(F.col("label") == 3, F.slice("embedding", 2, 10_000)).otherwise(F.col("embedding"))
    return retrieval.misfits(e.select(F.col("vec_id").alias("chunk_id"), vec.alias("vec")), 64)


@query("composite_stats", """
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT coalesce(sum(n_chars), 0)::BIGINT FROM documents) AS bytes, (SELECT count(*) FROM embeddings) AS chunks, 64 AS dims, ['/a', '/b'] AS roots, 'hash-test' AS embed_model, 'none' AS rerank_model""")
def composite_stats(spark, sf):
    meta = {"roots": ["/a", "/b"], "embed_model": HASH_MODEL}
    return index.composite(table(spark, sf, "documents").withColumnRenamed("n_chars", "bytes"), table(spark, sf, "embeddings").withColumnRenamed("embedding", "vec"), meta, "none")


@query("clock_fields", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time, strftime(ts, '%A') AS weekday, strftime(ts, '%Y-%m-%d %H:%M:00') AS parsed FROM events""")
def clock_fields(spark, sf):
    """The parts of a clock, and the clock that is read from them again."""
    e = table(spark, sf, "events").select("event_id", D.fields(F.col("ts")).alias("f"))
    return e.select("event_id", "f.*", F.date_format(D.parse(F.col("f.date"), F.col("f.time")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("last_arcs", """
WITH a AS (SELECT conv_id, turn AS from_turn, turn + 4 AS to_turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS late FROM conversations)
SELECT conv_id, string_agg('(turns ' || from_turn || '-' || to_turn || ') ' || text, chr(10) || chr(10) ORDER BY from_turn) AS arcs FROM a WHERE late <= 3 GROUP BY conv_id""")
def last_arcs(spark, sf):
    told = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("from_turn"), (F.col("turn") + 4).alias("to_turn"), "text")
    return turns.last_arcs(told, ["conv_id"], 3)


# -- model output ----------------------------------------------------------------------------------------------------


def _parsed(df, parse, schema: str):
    """JSON of ``parse`` over a text column, by Arrow batches, then its fields."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks:
            said = [json.dumps(parse(t.as_py() or "")) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(said, pa.string())], names=["conv_id", "turn", "j"])

    return df.mapInArrow(run, "conv_id bigint, turn bigint, j string").select("conv_id", "turn", F.from_json("j", schema).alias("p")).select("conv_id", "turn", "p.*")


@query("parse_entry", """
WITH t AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS narration, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INT AS words FROM conversations)
SELECT conv_id, turn, 'Dawn' AS title, narration, ['a', 'b', 'c', 'd', 'e'] AS choices, words,
  list_concat(CASE WHEN words < 20 THEN [words || ' words, at least 20 needed'] ELSE [] END, CASE WHEN words > 60 THEN [words || ' words, at most 60 allowed'] ELSE [] END) AS problems FROM t""")
def parse_entry(spark, sf):
    """Entries built from the log's texts with a header and five options, taken apart again."""
    c = table(spark, sf, "conversations")
    body = F.concat(F.lit("📅 Monday — 🌅 7:00 AM — *Dawn*\n\n"), "text", F.lit("\n\n**What will you do?**\n\n1. a\n2. b\n3) c\n4: d\n5. e\n5. f"))
    return _parsed(c.select("conv_id", "turn", body.alias("t")), lambda t: turns.parse_entry(t, least=20, most=60), "title string, narration string, choices array<string>, words int, problems array<string>")


_PLAIN_TEXT = "array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' ')"


@query("distillate", f"""
SELECT conv_id, turn, '' AS error, {_PLAIN_TEXT} AS summary, list_filter([{_PLAIN_TEXT}], lambda t: length(t) >= 8) AS facts, list_filter([{_PLAIN_TEXT}, 'a bell rang'], lambda t: length(t) >= 8) AS events,
  [role] AS present, 'old_' || role AS other, least(greatest(turn - 2, 0), 10)::INT AS closeness, substr({_PLAIN_TEXT}, 1, 40) AS label, substr({_PLAIN_TEXT}, 1, 200) AS note, role AS flag,
  least(greatest(length(text) * 100, 0), 43200)::INT AS minutes, role AS location, 'The ' || role AS title FROM conversations WHERE text <> ''""")
def distillate(spark, sf):
    """Archivist answers built from the log's texts, fenced and with trailing commas, coerced again."""
    c = table(spark, sf, "conversations").where("text <> ''")
    tie = F.struct(F.concat(F.lit("Old "), "role").alias("other"), (F.col("turn") - 2).alias("closeness"), F.col("text").alias("label"), F.col("text").alias("note"))
    told = F.to_json(F.struct(
        F.col("text").alias("summary"), F.col("text").alias("facts"), F.array(F.struct("text"), F.struct(F.lit("a bell rang").alias("text"))).alias("events"), F.array(F.upper("role"), F.lit("!")).alias("present"),
        F.array(tie).alias("relationships"), F.struct(F.col("role").alias("door")).alias("flags"), (F.length("text") * 100).alias("minutes_elapsed"), F.col("role").alias("location"), F.concat(F.lit("The "), "role").alias("title"),
    ))
    said = F.concat(F.lit("Here it is: ```json\n"), F.regexp_replace(told, r"\}$", ",}"), F.lit("\n``` done"))
    kinds = "error string, summary string, facts array<string>, events array<string>, present array<string>, relationships array<struct<other string, closeness int, label string, note string>>, flags map<string,string>, minutes int, location string, title string"
    out = _parsed(c.select("conv_id", "turn", said.alias("t")), turns.distillate, kinds)
    first = F.col("relationships")[0]
    tied = [first[k].alias(k) for k in ("other", "closeness", "label", "note")]
    return out.select("conv_id", "turn", "error", "summary", "facts", "events", "present", *tied, F.col("flags")["door"].alias("flag"), "minutes", "location", "title")


@query("turn_stream", """
WITH t AS (SELECT conv_id::VARCHAR AS campaign, turn + 1 AS n, text, list_filter(list_transform(string_split(text, '. '), lambda s: array_to_string(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''), ' ')), lambda s: length(s) >= 8)[1:12] AS facts FROM conversations),
e AS (SELECT campaign, n, 'summary' AS kind, 0 AS i, CASE WHEN text = '' THEN '(turn ' || n || ') no summary' ELSE text END AS raw FROM t
  UNION ALL SELECT campaign, n, 'fact', generate_subscripts(facts, 1) - 1, unnest(facts) FROM t),
m AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(raw, '\\s+'), lambda w: w <> ''), ' ') AS text FROM e)
SELECT campaign, format('memory://{}/{:05d}/{:02d}', kind, n, i) AS path, 'Turn ' || n AS title, 'Day 1 > ' || kind AS heading, kind, n AS turn, text FROM m WHERE length(text) >= 12""")
def turn_stream(spark, sf):
    """The log as a stream into an archive, its memories after the run; the archive lies in the session's shared folder.

    Turns come in four micro-batches without order, so many are late, and every other one comes again in a later batch."""
    import uuid

    from tessera.streaming.keyed_log import KeyedArchive
    from tessera.streaming.turn_log import TURNS, shared_folder

    root = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    c = table(spark, sf, "conversations")
    log = c.select(
        F.col("conv_id").cast("string").alias("campaign"), (F.col("turn") + 1).alias("n"), F.length("text").alias("minutes"), F.col("role").alias("location"), F.col("text").alias("summary"),
        T.facts(F.split("text", r"\. ")).alias("facts"), F.array().cast("array<string>").alias("events"), F.lit("Day 1").alias("when"),
    )
    for part in range(4):
        again = log.where((F.pmod(F.xxhash64("campaign", "n"), F.lit(4)) == part - 1) & (F.col("n") % 2 == 0))
        log.where(F.pmod(F.xxhash64("campaign", "n"), F.lit(4)) == part).unionByName(again).write.parquet(f"{root}/log/part={part}")
    files = spark.read.parquet(f"{root}/log").inputFiles()
    archive = KeyedArchive(spark, f"{root}/archive")
    archive.run(spark.readStream.schema(TURNS).option("maxFilesPerTrigger", -(-len(files) // 4)).parquet(f"{root}/log/part=*"), f"{root}/checkpoint")
    return archive.memories()
