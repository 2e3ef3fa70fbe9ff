"""Prompt contexts under character budgets, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

BUDGET, RECALL_BUDGET = 9_000, 2_200
#: What a user says to end a session.
RESETS = ("reset", "clear")
NOTHING = "I could not find anything about that in the indexed documents."
INSTRUCTIONS = "Answer from the numbered sources only, and cite them by number. Say so if they do not hold the answer."


def pack_sources(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, context, used): numbered sources in order of rank.

    A source that does not fit is passed over and later ones are still tried; the first is cut to fit instead. The number in a
    source's header depends on how many are used so far, hence a fold over each query's few sources.
    """
    ordered = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").alias("chunk_id"), F.col("label").alias("label"), T.trim(F.col("text")).alias("body")))).alias("hits")
    )
    start = F.struct(F.lit(0).alias("spent"), F.array().cast("array<string>").alias("blocks"), F.array().cast("array<bigint>").alias("used"))

    def step(s: Column, h: Column) -> Column:
        n = F.size(s["blocks"])
        head = F.concat(F.lit("["), (n + 1).cast("string"), F.lit("] "), h["label"])
        over = s["spent"] + F.length(head) + F.length(h["body"]) + 4 > budget
        body = F.when(over, F.substring(h["body"], F.lit(1), F.greatest(F.lit(500), F.lit(budget - 4) - F.length(head)))).otherwise(h["body"])
        taken = F.struct(
            (s["spent"] + F.length(head) + F.length(body) + 4).alias("spent"),
            F.concat(s["blocks"], F.array(F.concat(head, F.lit("\n"), body))).alias("blocks"),
            F.concat(s["used"], F.array(h["chunk_id"].cast("bigint"))).alias("used"),
        )
        return F.when((n > 0) & over, s).otherwise(taken)

    packed = ordered.select("query_id", F.aggregate("hits", start, step).alias("p"))
    return packed.select("query_id", F.array_join("p.blocks", "\n\n---\n\n").alias("context"), F.col("p.used").alias("used"))


def recalled(hits: DataFrame, budget: int = RECALL_BUDGET) -> DataFrame:
    """Hits of each query in order of rank until the budget is spent; the first is always in. Adds ``line``."""
    line = F.concat(F.lit("[m"), F.col("rank").cast("string"), F.lit("] "), F.col("heading"), F.lit(" — "), T.trim(F.col("text")))
    spent = F.sum(F.length("line")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("line", line).withColumn("_spent", spent).where((F.col("_spent") <= budget) | (F.col("rank") == 1)).drop("_spent")


def history(entries: Column, last: int = 4) -> Column:
    """The last entries, and of these the ones by user or assistant that say something."""
    n = F.size(entries)
    recent = F.slice(entries, F.greatest(n - (last - 1), F.lit(1)), last)
    return F.filter(recent, lambda m: m["role"].isin("user", "assistant") & (m["content"] != ""))


def resets(role: Column, content: Column) -> Column:
    """Whether a user's entry ends the session instead of asking something."""
    return F.coalesce((role == "user") & F.lower(T.trim(content)).isin(*RESETS), F.lit(False))


def session_memory(log: DataFrame, by: list[str], last: int = 4, *, until_reset: bool = False) -> DataFrame:
    """(by, n, memory) of chat logs (by, n, role, content): what is remembered before each entry, as messages; see :func:`history`.

    Entries before which nothing is remembered are left out. With ``until_reset`` an entry of :func:`resets` ends the session: nothing up to
    it is remembered after it, and it has no row of its own."""
    if until_reset:
        ended = F.sum(resets(F.col("role"), F.col("content")).cast("int")).over(Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
        log = log.withColumn("_session", ended).where(~resets(F.col("role"), F.col("content")))
        return session_memory(log, [*by, "_session"], last).drop("_session")
    before = Window.partitionBy(*by).orderBy("n").rowsBetween(-last, -1)
    said = F.collect_list(F.struct("role", "content")).over(before)
    found = log.select(*by, "n", said.alias("_said")).withColumn("memory", history(F.col("_said"), last))
    return found.where(F.size("memory") > 0).select(*by, "n", "memory")


def recall_query(action: Column, summaries: Column) -> Column:
    n = F.size(summaries)
    recent = F.filter(F.slice(summaries, F.greatest(n - 1, F.lit(1)), 2), lambda s: s != "")
    return F.substring(F.array_join(F.concat(F.array(T.trim(action)), recent), " "), 1, 1200)


def remembered(past: list[dict], last: int = 4) -> list[dict]:
    """As :func:`history`, of the one chat that a driver holds."""
    return [m for m in past[-last:] if m.get("role") in ("user", "assistant") and m.get("content")]


def messages(question: str, context: str, past: list[dict]) -> list[dict]:
    """A chat: instructions, what was said before, the fenced sources with the question."""
    kept = remembered(past)
    asked = f"<sources>\n{context}\n</sources>\n\nQuestion: {question}"
    return [{"role": "system", "content": INSTRUCTIONS}, *kept, {"role": "user", "content": asked}]


def answer_events(question: str, context: str, sources: list, model, past: list[dict] = ()):
    """Events of one answer: sources, then tokens, then done or error; without sources a fixed text."""
    from tessera.backends import ModelError, strip_thinking

    yield {"type": "sources", "sources": sources}
    if not sources:
        yield {"type": "token", "text": NOTHING}
        yield {"type": "done", "text": NOTHING}
        return
    said = ""
    try:
        for token in model.chat(messages(question, context, list(past))):
            said += token
            yield {"type": "token", "text": token}
    except ModelError as e:
        yield {"type": "error", "error": str(e)}
        return
    yield {"type": "done", "text": strip_thinking(said)}
