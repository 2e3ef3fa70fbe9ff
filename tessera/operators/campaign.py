"""A campaign: a turn log with its derived state and memories, kept as snapshots of small tables.

Log, state and memories are DataFrames; every change writes the tables it touches under a new generation and then moves the pointer.
A turn is committed before it is archived, so a failed archive loses nothing: unarchived turns are taken up before the next one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.backends import ModelError, complete, embed, strip_thinking
from tessera.functions import dates as D
from tessera.functions import text as T
from tessera.functions.porter import stemmed_tokens
from tessera.operators import context, retrieval, turns
from tessera.operators.chunking import chunk_documents
from tessera.operators.pointer import Pointer
from tessera.sources.loaders import contents, list_files, load_files

SCHEMAS = {
    "campaign": "key string, value string, turn bigint",
    "characters": "slug string, name string, role string, sheet string, present boolean, protagonist boolean, first_turn int",
    "relationships": "other string, label string, closeness int, note string",
    "flags": "key string, value string, turn bigint",
    "turns": "n bigint, at timestamp_ntz, title string, location string, action string, narration string, choices array<string>, words int, summary string, archived boolean",
    "arcs": "from_turn bigint, to_turn bigint, text string",
    "memories": "path string, title string, heading string, kind string, turn bigint, text string",
}
DEFAULTS = {"date": "2025-04-14", "time": "08:30", "location": "", "title": ""}


class Tables:
    """Named tables in a folder; a pointer says which generation of each is current.

    The generation before stays for those who read it; older ones, and what a crash left, go with the next commit of their table.
    A folder has one writer at a time: of two that commit at once the later fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> Pointer:
        return Pointer(self.spark, self.root, "tables")

    def read(self, name: str) -> DataFrame:
        folder = (self._pointer().read() or {}).get(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], SCHEMAS[name])

    def commit(self, **changed: DataFrame) -> None:
        """All of the tables or none: the pointer moves once, when every table is written."""
        version, before = self._pointer().latest()
        folders = dict(before or {})
        for name, df in changed.items():
            folders[name] = f"{name}/{uuid.uuid4().hex}"
            df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).hint("rebalance").write.parquet(f"{self.root}/{folders[name]}")
        self._pointer().write(folders, after=version)
        kept = {*folders.values(), *(before or {}).values()}
        for name in changed:
            self._drop(name, kept)

    def _drop(self, name: str, kept: set[str]) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(where):
            if f"{name}/{s.getPath().getName()}" not in kept:
                fs.delete(s.getPath(), True)


def campaigns(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders that hold a campaign, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(name for name in found if Pointer(spark, f"{root.rstrip('/')}/{name}", "tables").read() is not None)


class Campaign:
    def __init__(self, spark: SparkSession, root: str, model, *, least: int = 800, most: int = 900, repairs: int = 1, arc_every: int = turns.ARC_EVERY, recall: int = 6):
        self.spark, self.tables, self.model = spark, Tables(spark, root), model
        self.least, self.most, self.repairs, self.arc_every, self.recall_k = least, most, repairs, arc_every, recall

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name])

    # -- key-value state ---------------------------------------------------------------------------------------------

    def all_settings(self) -> dict:
        """Date, time, location and title, with their defaults, and whether the campaign has started."""
        log = self.tables.read("campaign").withColumn("c", F.lit(0))
        row = turns.settings(log, ["c"], {k: json.dumps(v) for k, v in DEFAULTS.items()}).first()
        return {k: json.loads(row[k]) for k in DEFAULTS} | {"started": row["started"]} if row else DEFAULTS | {"started": False}

    def setting(self, key: str) -> str:
        return self.all_settings()[key]

    def _settings(self, turn: int, **values) -> DataFrame:
        """The key-value table with these keys written, last write wins."""
        new = self._rows("campaign", [(k, json.dumps(v), turn) for k, v in values.items()])
        return self.tables.read("campaign").join(new.select("key"), "key", "left_anti").unionByName(new)

    def clock(self):
        now = self.all_settings()
        return self.spark.range(1).select(D.parse(F.lit(now["date"]), F.lit(now["time"]))).first()[0]

    @property
    def started(self) -> bool:
        return self.all_settings()["started"]

    # -- sources -----------------------------------------------------------------------------------------------------

    def seed(self, path: str) -> dict[str, int]:
        """Title, clock, cast, relationships, flags and lore from one JSON file; how many of each."""
        seed = json.loads("\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))
        clock = seed.get("clock") or {}
        known = {k: clock[k] for k in ("date", "time", "location") if clock.get(k)}
        cast = [(c["slug"], c["name"], c.get("role", ""), c.get("sheet", ""), bool(c.get("present")), bool(c.get("protagonist")), 0) for c in seed.get("characters", [])]
        ties = [(r["other"], r.get("label") or "", max(0, min(10, int(r.get("closeness", 5)))), r.get("note") or "") for r in seed.get("relationships", [])]
        flags = [(str(k), json.dumps(v), 0) for k, v in (seed.get("flags") or {}).items()]
        lore = self._entries([("lore", 0, "", list(seed.get("lore", [])))])
        characters = turns.upsert_characters(self.tables.read("characters"), self._rows("characters", cast))
        relationships = turns.upsert_relationships(self.tables.read("relationships"), self._rows("relationships", ties))
        memories = self.tables.read("memories").unionByName(turns.new_memories(lore, self.tables.read("memories")))
        self.tables.commit(
            campaign=self._settings(0, title=seed.get("title", ""), **known), characters=characters, relationships=relationships, flags=self._written(flags), memories=memories
        )
        return {"characters": len(cast), "relationships": len(ties), "flags": len(flags), "lore": len(seed.get("lore", []))}

    def _entries(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "kind string, turn bigint, `when` string, texts array<string>")

    def _written(self, rows: list[tuple]) -> DataFrame:
        return self._set_flags(self._rows("flags", rows))

    def _set_flags(self, new: DataFrame) -> DataFrame:
        return self.tables.read("flags").join(new.select("key"), "key", "left_anti").unionByName(new)

    def lore(self, texts: list[str], turn: int = 0) -> int:
        new = turns.new_memories(self._entries([("lore", turn, "", texts)]), self.tables.read("memories"))
        n = new.count()
        if n:
            self.tables.commit(memories=self.tables.read("memories").unionByName(new))
        return n

    def ingest_lore(self, paths: list[str], *, turn: int = 0) -> dict:
        """Files and folders as lore: each chunk a memory that is found beside those of the story. Counters of what was done.

        A memory is known by its file and place, so reading a file again adds only what it did not have."""
        memories, held = self.tables.read("memories"), []
        out = {"added": 0, "failed": 0, "skipped": 0, "missing": []}
        for path in paths:
            try:
                files = list_files(self.spark, path).persist()
                held.append(files)
            except FileNotFoundError:
                out["missing"].append(path)
                continue
            good = contents(self.spark, [path]).join(files.where("status = 'ok'").select("path"), "path", "left_semi")
            loaded = load_files(good).persist()
            cut = chunk_documents(loaded.where("error IS NULL").select(F.col("path").alias("doc_id"), "blocks"))
            name = F.regexp_extract("doc_id", r"([^/]*)\z", 1)
            rows = cut.select(
                F.concat(F.lit("file://"), "doc_id", F.lit("#"), F.col("ord").cast("string")).alias("path"), name.alias("title"),
                F.concat_ws(" > ", F.nullif("heading", F.lit("")), F.lit("lore")).alias("heading"), F.lit("lore").alias("kind"), F.lit(turn).cast("bigint").alias("turn"), "text",
            )
            new = rows.join(memories.select("path"), "path", "left_anti").persist()
            out["added"] += new.count()
            out["failed"] += loaded.where("error IS NOT NULL").count()
            out["skipped"] += files.where("status IN ('unsupported', 'oversize')").count()
            held += [loaded, new]
            memories = memories.unionByName(new)
        if out["added"]:
            self.tables.commit(memories=memories)
        for df in held:
            df.unpersist()
        return out

    # -- the log -----------------------------------------------------------------------------------------------------

    def _log(self) -> DataFrame:
        return self.tables.read("turns").withColumn("c", F.lit(0))

    def turn_count(self) -> int:
        one = self.spark.range(1).select(F.lit(0).alias("c"))
        return int(turns.turn_count(one, self._log(), ["c"]).first()["last"])

    def _append(self, entry: dict, action: str) -> int:
        now = self.all_settings()
        kinds = SCHEMAS["turns"].split(", ", 1)[1]
        row = (self.clock(), entry["title"], now["location"], action, entry["narration"], entry["choices"], entry["words"], "", False)
        log = turns.append(self._log(), self.spark.createDataFrame([row], kinds).withColumn("c", F.lit(0)), ["c"])
        self.tables.commit(turns=log)
        return self.turn_count()

    def open_with(self, prose: str, title: str = "Opening", choices: list[str] | None = None) -> int:
        """Prose as the first turn, archived like any other."""
        n = self._append({"title": title, "narration": prose, "choices": self._five(choices or []), "words": len(prose.split())}, "")
        self._archive(n)
        return n

    @staticmethod
    def _five(choices: list[str]) -> list[str]:
        return [*choices, *D.FILLER][:5]

    def pending(self) -> list[str]:
        row = turns.last_turn(self._log(), ["c"], "choices").first()
        return list(row["choices"] or []) if row else []

    def history(self, last: int = 12) -> list:
        text = D.entry(F.col("at"), F.col("title"), F.col("narration"), F.col("choices"))
        shown = turns.recent(self._log(), last, ["c"]).select("n", "title", F.col("at").cast("string").alias("when"), "action", "summary", "words", text.alias("entry"))
        return shown.orderBy("n").collect()

    # -- memory ------------------------------------------------------------------------------------------------------

    def recall(self, query: str, top_k: int = 0) -> list:
        """Memories for a query, as :func:`retrieval.project` shows them."""
        memories = self.tables.read("memories")
        if memories.isEmpty():
            return []
        chunks = memories.select(F.xxhash64("path").alias("chunk_id"), F.xxhash64("path").alias("doc_id"), "heading", "text", F.lit(0).alias("page"), embed(F.concat_ws("\n", "heading", "text")).alias("vec"))
        documents = memories.select(F.xxhash64("path").alias("doc_id"), "path", "title", "kind", "turn")
        asked = self.spark.createDataFrame([(0, query)], "query_id bigint, query string").withColumn("vec", embed(F.col("query")))
        return retrieval.project(retrieval.search(chunks, documents, asked, top_k=top_k or self.recall_k, tokens=stemmed_tokens)).orderBy("rank").collect()

    def _archive(self, n: int, latest: bool = True) -> dict:
        """Distil a turn into memories; the state follows only the latest turn."""
        turn = self.tables.read("turns").where(F.col("n") == n).first()
        characters = self.tables.read("characters")
        listed = turns.roster(characters.withColumn("c", F.lit(0)), "c").first()
        cast = listed["roster"] if listed else "(nobody yet)"
        ask = f"Cast:\n{cast}\n\nAction: {turn.action}\n\n{turn.narration}\n\nAnswer with one JSON object: summary, facts, events, present, relationships, flags, minutes_elapsed, location, title."
        try:
            found = turns.distillate(complete(self.model, [{"role": "system", "content": "You keep the archive."}, {"role": "user", "content": ask}], temperature=0.0, max_tokens=900))
        except ModelError as e:
            found = turns.distillate("") | {"error": str(e)}
        summary = found["summary"] or f"(turn {n}) {turn.action}"
        when = self.spark.range(1).select(D.pretty_date(F.lit(turn.at))).first()[0]
        known = self.tables.read("memories")
        new = turns.new_memories(self._entries([("summary", n, when, [summary]), ("fact", n, when, found["facts"]), ("event", n, when, found["events"])]), known)
        said = self.spark.createDataFrame([(0, n, summary)], "c int, n bigint, summary string")
        log = turns.with_summaries(self._log(), said, ["c"])
        if latest and found["title"]:  # a turn that was left without a title takes the archivist's
            log = log.withColumn("title", F.when((F.col("n") == n) & (F.coalesce("title", F.lit("")) == ""), F.lit(found["title"])).otherwise(F.col("title")))
        changed: dict[str, DataFrame] = {"memories": known.unionByName(new), "turns": log}
        if latest:
            later = self.spark.range(1).select(D.fields(D.advance(F.lit(turn.at), F.lit(found["minutes"]))).alias("f")).first()["f"]
            values = {"date": later["date"], "time": later["time"]} | ({"location": found["location"]} if found["location"] else {})
            changed["campaign"] = self._settings(n, **values)
            if found["present"]:
                changed["characters"] = turns.set_present(characters, self.spark.createDataFrame([(s,) for s in found["present"]], "slug string"))
            ties = [(r["other"], r["label"], r["closeness"], r["note"]) for r in found["relationships"]]
            if ties:
                changed["relationships"] = turns.upsert_relationships(self.tables.read("relationships"), turns.known(self._rows("relationships", ties), characters, "other"))
            if found["flags"]:
                said = self.spark.createDataFrame([({k: json.dumps(v) for k, v in found["flags"].items()}, n)], "flags map<string,string>, turn bigint")
                changed["flags"] = self._set_flags(turns.flags(said, "turn"))
        self.tables.commit(**changed)
        return found

    def catch_up(self) -> list[int]:
        """Archive what was left over, in order; only the latest turn moves the state."""
        left = [r.n for r in turns.unarchived(self.tables.read("turns")).select("n").orderBy("n").collect()]
        last = self.turn_count()
        for n in left:
            self._archive(n, latest=n == last)
        return left

    def _fold(self) -> str:
        """One arc when enough turns have passed since the last; if the model fails the range stays open and the next arc is longer."""
        start = int(self.tables.read("arcs").agg(F.coalesce(F.max("to_turn"), F.lit(0))).first()[0]) + 1
        end = self.turn_count()
        if end - start + 1 < self.arc_every:
            return ""
        rows = self.tables.read("turns").where(F.col("n").between(start, end)).select("summary").orderBy("n").collect()
        listed = "\n".join(f"{i}. {r[0]}" for i, r in enumerate(rows, 1))
        try:
            text = complete(self.model, [{"role": "user", "content": f"Fold these summaries into one paragraph:\n{listed}"}]).strip()
        except ModelError:
            return ""
        if text:
            new = turns.new_memories(self._entries([("arc", end, "", [text])]), self.tables.read("memories"))
            self.tables.commit(arcs=self.tables.read("arcs").unionByName(self._rows("arcs", [(start, end, text)])), memories=self.tables.read("memories").unionByName(new))
        return text

    # -- a turn ------------------------------------------------------------------------------------------------------

    def prompt(self, action: str, recalled: list) -> str:
        people = self.tables.read("characters").withColumn("block", T.character_block(F.col("name"), F.col("role"), F.col("sheet")))
        cast = turns.present(people).orderBy("place").collect()
        hero = people.where("protagonist").orderBy("slug").first()
        ties = turns.standing(self.tables.read("relationships"), self.tables.read("characters")).collect()
        log = turns.recent(self._log(), turns.VERBATIM + turns.SUMMARIES, ["c"]).orderBy("n").collect()
        arcs = turns.last_arcs(self.tables.read("arcs").withColumn("c", F.lit(0)), ["c"]).first()
        memory, spent = [], 0
        for i, h in enumerate(recalled, 1):
            line = f"[m{i}] {h['heading']} — {h['text'].strip()}"
            if memory and spent + len(line) > context.RECALL_BUDGET:
                break
            memory.append(line)
            spent += len(line)
        older, last = log[: -turns.VERBATIM], log[-turns.VERBATIM :]
        state = {
            "campaign": "", "clock": self.clock(), "location": self.setting("location"), "turns": self.turn_count(), "protagonist": hero["block"] if hero else "",
            "present": "\n\n".join(c["block"] for c in cast if not c["protagonist"]),
            "standing": "\n".join(f"{r['name'] or r['other']} — {r['label'] or 'known'} ({r['closeness']}/10)" + (f". {r['note']}" if r["note"] else "") for r in ties),
            "flags": "\n".join(f"{r.key}: {json.loads(r.value)}" for r in self.tables.read("flags").orderBy("key").collect()),
            "arcs": arcs["arcs"] if arcs else "", "recalled": "\n".join(memory),
            "earlier": "\n".join(f"Turn {t.n}: {t.summary or t.title or '(not yet distilled)'}" for t in older), "previous": "\n\n".join(t.narration.strip() for t in last), "action": action,
        }
        kinds = ", ".join(f"{k} {'timestamp_ntz' if k == 'clock' else 'bigint' if k == 'turns' else 'string'}" for k in state)
        return turns.turn_prompt(self.spark.createDataFrame([tuple(state.values())], kinds)).first()["prompt"]

    def play(self, raw: str) -> Iterator[dict]:
        """Events of one turn: repaired, recall, token, revised, entry, archiving, arc, turn; or error, and then nothing is written."""
        caught = self.catch_up()
        if caught:
            yield {"type": "repaired", "turns": caught}
        row = self.spark.createDataFrame([(raw, self.pending())], "raw string, pending array<string>").select(D.resolve_input(F.col("raw"), F.col("pending"))).first()
        action = row[0]
        if not action:
            yield {"type": "error", "error": "an action is needed"}
            return
        recent = [r[0] for r in self.tables.read("turns").orderBy(F.desc("n")).limit(2).select("summary").collect()][::-1]
        recalled = self.recall(" ".join([action, *[s for s in recent if s]])[:1200])
        yield {"type": "recall", "memories": [h["path"] for h in recalled]}
        messages = [{"role": "system", "content": f"Narrate {self.least} to {self.most} words, then ask what the player will do and give five numbered options."}, {"role": "user", "content": self.prompt(action, recalled)}]
        raw_entry = ""
        try:
            for token in self.model.chat(messages):
                raw_entry += token
                yield {"type": "token", "text": token}
        except ModelError as e:
            yield {"type": "error", "error": str(e)}
            return
        first = turns.parse_entry(strip_thinking(raw_entry), least=self.least, most=self.most)
        entry, notes = turns.repair(self.model, messages, raw_entry, least=self.least, most=self.most, repairs=self.repairs)
        if entry["narration"] != first["narration"] or entry["choices"] != first["choices"]:
            yield {"type": "revised", "problems": first["problems"]}
        entry["choices"] = self._five(entry["choices"])
        n = self._append(entry, action)
        yield {"type": "entry", "entry": entry, "notes": notes}
        yield {"type": "archiving"}
        found = self._archive(n)
        arc = self._fold()
        if arc:
            yield {"type": "arc", "text": arc}
        yield {"type": "turn", "n": n, "error": found["error"], "notes": notes + ([f"archivist: {found['error']}"] if found["error"] else [])}

    def status(self) -> dict:
        counts = {r.kind: r.n for r in turns.memory_counts(self.tables.read("memories")).collect()}
        return {
            "title": self.setting("title"), "clock": str(self.clock()), "location": self.setting("location"), "turns": self.turn_count(), "memories": counts,
            "present": [r["slug"] for r in turns.present(self.tables.read("characters")).orderBy("place").collect()], "arcs": self.tables.read("arcs").count(),
            "characters": self.tables.read("characters").count(), "flags": {r.key: json.loads(r.value) for r in self.tables.read("flags").orderBy("key").collect()},
        }
