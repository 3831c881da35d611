"""Command line: index, search, status and watch a folder of notes.

Embedders, extractors and rerankers are named as module:attribute; the attribute is called without arguments unless it
is an embedder, which is a function from texts to vectors.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import SparkSession

from lakequill.functions.format import pretty_rows, to_json_rows
from lakequill.operators.assets import AssetCache
from lakequill.operators.chunking import chunk_files, with_hash, with_id
from lakequill.operators.embed import embed_chunks, hash_embedder
from lakequill.operators.metrics import Metrics
from lakequill.operators.search import SearchOptions, search, write_index
from lakequill.operators.store import ChunkStore, status
from lakequill.plans.index import index
from lakequill.streaming.apply import reader, run_until_signal, watch
from lakequill.streaming.folder import folder_events


def named(name: str | None):
    if name is None:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def made(name: str | None):
    found = named(name)
    return found and found()


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--data-dir", help="where the index lies; .lakequill of the folder, or of the working directory, unless given")
    shared.add_argument("--log-level", default="WARN")
    shared.add_argument("--embedder", help="module:function from texts to vectors; a hash of the text unless given")
    shared.add_argument("--model", default="hash-64")
    shared.add_argument("--width", type=int, default=64)
    out = argparse.ArgumentParser(prog="lakequill")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("index", "watch"):
        p = sub.add_parser(name, parents=[shared])
        p.add_argument("root")
        p.add_argument("--extractor", help="module:class that reads assets")
        p.add_argument("--exclude", action="append", default=[], help="glob of assets to leave out")
        if name == "index":
            p.add_argument("--force", action="store_true", help="start anew if another model wrote the index")
        else:
            p.add_argument("--events", help="folder of event files; without it the folder itself is watched")
            p.add_argument("--quiet", type=int, default=500, help="milliseconds that a file stays untouched before it is indexed")
    p = sub.add_parser("search", parents=[shared])
    p.add_argument("query")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--min-score", type=float)
    p.add_argument("--mode", choices=("semantic", "fts", "hybrid"), default="hybrid")
    p.add_argument("--path-filter")
    p.add_argument("--tag-filter")
    p.add_argument("--context", type=int, default=0)
    p.add_argument("--format", choices=("json", "pretty"), default="json")
    p.add_argument("--reranker", help="module:class")
    p.add_argument("--no-rerank", action="store_true")
    sub.add_parser("status", parents=[shared])
    return out


def run(spark: SparkSession, args: argparse.Namespace, show=print) -> None:
    home = args.data_dir or os.path.join(getattr(args, "root", os.getcwd()), ".lakequill")
    home = home if "://" in home else "file://" + os.path.abspath(home)
    store, embed = ChunkStore(spark, f"{home}/chunks"), named(args.embedder) or hash_embedder(args.width)
    cache = AssetCache(spark, f"{home}/asset-cache")
    if args.command == "index":
        show(json.dumps(index(spark, args.root, store, embed, args.model, args.width, args.force, made(args.extractor), args.exclude, cache)))
        write_index(store.read(), f"{home}/fts", source=store.version)
    elif args.command == "watch":
        read = reader(spark, args.root, made(args.extractor), cache, args.exclude)
        metrics = Metrics()
        events = args.events or folder_events(spark, args.root, f"{home}/listings", 0.5)
        chunked = lambda f: embed_chunks(with_id(with_hash(chunk_files(f))), embed, args.model, args.width)
        run_until_signal(watch(spark, events, store, read, chunked, f"{home}/watch", metrics=metrics, index_root=f"{home}/fts", quiet_ms=args.quiet))
        show(metrics.render())
    elif args.command == "status":
        show(status(store.read()).toJSON().first())
    else:
        rerank = None if args.no_rerank else made(args.reranker)
        got = search(store.read(), SearchOptions(args.query, args.limit, args.min_score, args.mode, args.path_filter, args.tag_filter, args.context, rerank, embed=embed), f"{home}/fts", source=store.version)
        for row in (to_json_rows(got) if args.format == "json" else pretty_rows(got).select("block")).collect():  # a search's results: a bounded list
            show(row[0])


def main(argv=None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lakequill").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel(args.log_level)
    try:
        run(spark, args)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
