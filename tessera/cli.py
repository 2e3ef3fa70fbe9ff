"""Command line over an index folder: ingest, reindex, search, ask, chat, serve, stats, forget, doctor, evaluate.

Exit codes: 0, 1 when nothing matched or a check failed or an error was reported, 130 on interrupt."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.backends import Echo, Http, ModelError, megabytes, setting
from tessera.operators import context, evaluate, index, retrieval, search_index


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--index", default=argparse.SUPPRESS)
    common.add_argument("--top-k", type=int, default=argparse.SUPPRESS)
    common.add_argument("--llm", choices=("echo", "http"), default=argparse.SUPPRESS)
    common.add_argument("--show-sources", action="store_true", default=argparse.SUPPRESS)
    out = argparse.ArgumentParser(prog="tessera", parents=[common])
    commands = out.add_subparsers(dest="command", required=True)
    add = lambda name: commands.add_parser(name, parents=[common])
    ingest = add("ingest")
    ingest.add_argument("paths", nargs="*")
    ingest.add_argument("--force", action="store_true")
    ingest.add_argument("--no-prune", action="store_true")
    for name in ("search", "ask"):
        add(name).add_argument("question", nargs="+")
    for name in ("reindex", "chat", "stats", "doctor"):
        add(name)
    add("forget").add_argument("paths", nargs="+")
    serve = add("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8080)
    evaluation = add("evaluate")
    evaluation.add_argument("queries")
    evaluation.add_argument("--depth", type=int, default=5)
    return out


def options(argv: list[str] | None, of: argparse.ArgumentParser) -> argparse.Namespace:
    """Arguments, with the defaults of options that may stand before or after the command."""
    args = of.parse_args(argv)
    for name, default in {"index": setting("TESSERA_INDEX", "index"), "top_k": setting("TESSERA_TOP_K", retrieval.TOP_K), "llm": setting("TESSERA_LLM", "echo"), "show_sources": False}.items():
        if not hasattr(args, name):
            setattr(args, name, default)
    return args


def say(events) -> tuple[int, str]:
    """Print an answer's tokens as they come; exit code and text."""
    text = ""
    for event in events:
        if event["type"] == "token":
            print(event["text"], end="", flush=True)
        elif event["type"] == "error":
            print(event["error"], file=sys.stderr)
            return 1, ""
        elif event["type"] == "done":
            text = event["text"]
    print()
    return 0, text


def chat(ix: index.Index, model, top_k: int, lines, **options) -> int:
    """Questions line by line, with what was said before; 'reset' forgets it, 'exit' ends."""
    past: list[dict] = []
    for line in lines:
        question = line.strip()
        if question.lower() in ("exit", "quit", ":q"):
            break
        if question.lower() in context.RESETS:
            past.clear()
        elif question:
            code, text = say(search_index.answer(ix, question, model, top_k, past, **options))
            past += [{"role": "user", "content": question}, {"role": "assistant", "content": text}] if not code else []
            past[:] = context.remembered(past, 8)
    return 0


def stats(ix: index.Index) -> int:
    meta, found = ix.meta(), index.stats(ix.documents(), ix.chunks()).first()
    dims = ix.chunks().agg(F.max(F.size("vec"))).first()[0] or 0
    print(f"index       {found['documents']} documents, {found['chunks']} chunks, vectors of {dims}")
    print(f"sources     {megabytes(found['bytes'])} MB")
    print(f"embeddings  {meta['embed_model'] or '-'}")
    print("file types  " + ", ".join(f"{r['ext'] or '?'} {r['n']}" for r in index.by_extension(ix.documents()).collect()))
    for root in meta["roots"]:
        print(f"root        {root}")
    return 0


def doctor(ix: index.Index, model) -> int:
    """Whether the index, its model and the language model are in order; a model that spills over from the GPU is not."""
    meta = ix.meta()
    checks = [("index", bool(meta["generation"])), ("chunks", not ix.chunks().isEmpty()), (f"embeddings: {meta['embed_model']}", meta["embed_model"] is not None)]
    if isinstance(model, Http):
        try:
            checks.append((f"model {model.model} installed", model.has_model(model.model)))
            checks += [(f"{m['name']}: {m['gpu_percent']:.0f} % of {megabytes(m['bytes'])} MB on the GPU", m["gpu_percent"] > 98) for m in model.running()]
        except ModelError as e:
            checks.append((str(e), False))
    for name, good in checks:
        print(f"{'ok  ' if good else 'FAIL'} {name}")
    return 0 if all(good for _, good in checks) else 1


def evaluation(ix: index.Index, path: str, depth: int, **options) -> int:
    """Scores of four ways to search for the labelled questions of a JSON-lines file."""
    spark = ix.spark
    labelled = evaluate.query_source(spark.read.text(path)).withColumn("query_id", F.row_number().over(evaluate.Window.orderBy("query")).cast("bigint")).persist()
    questions, expected = labelled.select("query_id", "query"), labelled.select("query_id", F.explode("expect").alias("expect"))
    search = search_index.plan(ix, questions, depth, **options)
    modes = {"dense": search.dense, "bm25": search.bm25, "hybrid": search.fused, "hybrid+rerank": search.found}
    for mode, ranked in modes.items():
        start = time.perf_counter()
        results = ranked.select("query_id", "chunk_id", "rank").where(F.col("rank") <= depth).join(ix.chunks().select("chunk_id", "text"), "chunk_id")
        row = evaluate.scores(evaluate.ranks(results, expected), results).first()
        spent = 1000 * (time.perf_counter() - start) / max(labelled.count(), 1)
        print(f"{mode:<14} " + "  ".join(f"{k} {row[k]:.3f}" for k in ("hit_1", "hit_3", "hit_5", "mrr", "coverage")) + f"  misses {row['misses']}  returned {row['returned']:.1f}  {spent:.0f} ms a question")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = options(argv, parser())
    model = Http() if args.llm == "http" else Echo()
    models = search_index.Models.named(setting("TESSERA_EMBED_MODEL", ""), setting("TESSERA_RERANK_MODEL", ""))
    built = {"model": models.name, "embedder": models.documents}
    try:
        ix = index.Index(session(), args.index)
        if args.command == "ingest":
            done = {"force": args.force, "prune_missing": not args.no_prune} | built
            report = ix.ingest(args.paths, **done) if args.paths else ix.rescan(**done)
            for root in report["missing"]:
                print(f"{root} does not exist", file=sys.stderr)
            print(report)
        elif args.command == "reindex":
            print(ix.reindex(**built))
        elif args.command == "forget":
            removed = sum(ix.forget(p) for p in args.paths)
            print(f"{removed} documents forgotten")
            return 0 if removed else 1
        elif args.command == "stats":
            return stats(ix)
        elif args.command == "doctor":
            return doctor(ix, model)
        elif args.command == "evaluate":
            return evaluation(ix, args.queries, args.depth, models=models)
        elif args.command == "chat":
            return chat(ix, model, args.top_k, sys.stdin, models=models)
        elif args.command == "serve":
            from tessera.server import serve

            serve(ix, args.port, model, args.host).serve_forever()
        elif args.command == "search":
            found = search_index.ask(ix, " ".join(args.question), args.top_k, counted=True, models=models)
            for h in found.hits:
                print(f"{h['rank']}. {h['label']}  {h['score']:.3f}\n    {h['text'][:200]}")
            print(" ".join(f"{k.removesuffix('_ms')}={v:.0f}ms" for k, v in found.timings.items()) + "  |  " + " ".join(f"{k}={v}" for k, v in found.counts.items()))
            return 0 if found.hits else 1
        else:
            question = " ".join(args.question)
            code, _ = say(search_index.answer(ix, question, model, args.top_k, models=models))
            if args.show_sources:
                for h in search_index.ask(ix, question, args.top_k, models=models).hits:
                    print(f"[{h['rank']}] {h['path']}")
            return code
        return 0
    except KeyboardInterrupt:
        return 130
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
